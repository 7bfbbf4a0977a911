import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from atomloom.functions import arrays as A
from atomloom.functions import symbols as S
from atomloom.operators import chunking as C
from atomloom.operators import names


def one(spark, column, **values):
    names_, kinds = zip(*((k, "string" if v is None or isinstance(v, str) else "array<string>") for k, v in values.items()))
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {k}" for n, k in zip(names_, kinds)))
    return df.select(column.alias("r")).first().r


@pytest.mark.parametrize("word, want", [("dogs", "dog"), ("houses", "hous"), ("cities", "city"), ("ties", "tie"), ("glass", "glass"), ("bus", "bus"), ("is", "is"), ("men", "men"), ("ses", "ses"), ("", ""), (None, None)])
def test_singular(spark, word, want):
    assert one(spark, S.singular(F.col("w")), w=word) == want


@pytest.mark.parametrize("word, want", [("physics", "physics"), ("famous", "famous"), ("ships", "ship"), ("friendship", "friendship"), ("news", "news"), ("stories", "story")])
def test_singular_guarded(spark, word, want):
    assert one(spark, S.singular_guarded(F.col("w")), w=word) == want


@pytest.mark.parametrize("word, want", [("city", "cities"), ("my", "mys"), ("box", "boxes"), ("church", "churches"), ("dog", "dogs")])
def test_plural(spark, word, want):
    assert one(spark, S.plural(F.col("w")), w=word) == want


@pytest.mark.parametrize("token, want", [(" HomeDogs ", "home_dog"), ("ice-cream", "ice_cream"), ("a__b", "a_b"), ("语言", ""), ("Éa", "a"), ("", ""), (None, None)])
def test_canonical(spark, token, want):
    assert one(spark, S.canonical(F.col("t")), t=token) == want


def test_case_forms(spark):
    assert one(spark, S.pascal(F.col("t")), t="usedFor") == "Usedfor" and one(spark, S.pascal(F.col("t")), t="IsA") == "IsA" and one(spark, S.pascal(F.col("t")), t="--") == "--"
    assert one(spark, S.kebab(F.col("t")), t="UsedFor Things") == "used-for-things" and one(spark, S.snake(F.col("t"), True), t="aB c") == "a_B_c"
    assert one(spark, S.value(F.col("t")), t="  Big Dogs x-1s B2s ") == "big-dog-x-1s-B2s" and one(spark, S.value(F.col("t")), t=" ") is None
    assert one(spark, S.predicate(F.col("t")), t=" Used For ") == "used-for" and one(spark, S.predicate(F.col("t")), t=" ") is None
    assert one(spark, S.clean_concept(F.col("t")), t="/c/en/big_dogs/n/x") == "big_dog" and one(spark, S.clean_concept(F.col("t")), t="/c/de/hund") is None
    assert one(spark, S.canonical_phrase(F.col("t")), t="The Socrates, a dog!") == "socrate_dog"
    assert one(spark, S.first_nonempty(F.col("a"), F.col("b"), F.col("c")), a=None, b=" ", c=" x") == " x"
    assert one(spark, S.slug(F.col("t")), t="A b-C") == "a_b_c" and one(spark, S.model_name(F.col("t")), t="openai/m") == "m"


def test_lists(spark):
    t = "Dogs and cats of Paris. The Dogs met Anna-Maria in Paris, ok"
    assert one(spark, A.extract_concepts(F.col("t")), t=t) == ["dog", "cat", "paris", "met", "anna", "maria"]
    assert one(spark, A.constants(F.col("t")), t=t) == ["dogs", "paris", "the", "anna_maria"]
    m = one(spark, A.proper_name_map(F.col("t")), t=t)
    assert m["dog"] == "dogs" and m["paris"] == "paris" and m["the"] == "the" and "pari" not in m
    assert one(spark, A.dedupe(F.col("x")), x=[" a  b", "a b", None, "", "\t", "c"]) == ["a b", "c"]
    assert one(spark, A.dedupe_trimmed(F.col("x")), x=[" a  b", "a  b ", None, ""]) == ["a  b"]
    assert one(spark, A.context_heads(F.col("x")), x=["(: a (is_a x y) (STV 1 1))", None, "(: b (LocatedAt x) (STV 1 1))"]) == ["IsA", "STV", "AtLocation"]
    assert one(spark, A.domain_heads(F.col("x")), x=["(: a (IsA x y) (STV 1 1))", "(: b (Foo x) (STV 1 1))"]) == ["Foo"]
    arg = lambda v, lst, split=False: one(spark, A.argument_list(F.lit(lst), F.col("v"), split), v=v)
    assert arg([" a b "], False) == ["a b"] and arg([" a b "], False, True) == ["a", "b"] and arg(["a, b,"], False, True) == ["a", "b"] and arg(["a", " ", "b"], True) == ["a", "b"] and arg([" "], False) == []


def test_positional_names(spark):
    t = "Anna met Bob. Dogs bark at Dogs. bob saw anna. The anna ran"
    got = {(r.word, r.name) for r in names.positional(spark.createDataFrame([(1, t), (2, None), (3, "")], "id int, text string"), "id", "text").collect()}
    assert got == {("dogs", "Dogs")}


PARTS = ["It ran. ", "This result holds! ", "So what? ", "Dogs bark ", "a.b ", "\n", "\n\n", "word ", "x" * 30, "He left. ", "As a result it fell. ", "  "]
WHITE = re.compile(r"\s+")


def plain_merge(parts, cues, prefixes):
    out = []
    for p in parts:
        t = p.lower().split()
        if out and (t[0] in cues or " ".join(t[:2]) in prefixes or " ".join(t[:3]) in prefixes):
            out[-1] += " " + p
        else:
            out.append(p)
    return out


def plain_window(text, size, overlap):
    if len(text) <= size:
        return [text]
    out, start = [], 0
    while True:
        end = start + size
        if end >= len(text):
            return [p for p in out + [text[start:].strip()] if p]
        cut = next((i + 1 for i in range(end, max(0, end - int(size * 0.2)), -1) if text[i] in ".!?\n"), end)
        out.append(text[start:cut].strip())
        start = cut - overlap


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=40).map("".join), st.integers(20, 80))
def test_windows_and_paragraphs(text, size):
    assert C.size_pieces(text, size, size // 4) == plain_window(text, size, size // 4)
    chunks = C.paragraph_chunks(text, size)
    assert WHITE.sub("", "".join(chunks)) == WHITE.sub("", text) and all(c.strip() for c in chunks)


def test_chunks_of_rows(spark):
    import random

    rng = random.Random(1)
    texts = [None, "", " \n ", "One sentence", "z" * 1300] + ["".join(rng.choices(PARTS, k=rng.randint(1, 60))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "chunks int, text string")
    got = {r.chunks_id: r.chunks for r in C.chunks(df.withColumnRenamed("chunks", "chunks_id"), "chunks_id", "text", 60, 10).collect()}
    for i, t in enumerate(texts):
        t = (t or "").strip()
        s = [p.strip() for p in re.split(r"(?<=[.!?])\s+", t) if p.strip()]
        units = [] if not t else [t] if len(s) <= 1 else plain_merge(s, C.CUES, C.PREFIXES)
        assert got[i] == [p for u in units for p in plain_window(u, 60, 10)], ascii(t)


def test_batches(spark):
    lens = [5, 5, 5, 5, 5, 3000, 1999, 1, 1000, 998, 2, 2000]
    units = ["u" * n for n in lens]
    numbers = one(spark, C.batch_numbers(F.col("u")), u=units)
    out, current = [], []
    for u in units:
        if current and (len(current) >= 4 or len(" ".join(current)) + 1 + len(u) > 2000):
            out.append(current)
            current = []
        current = current + [u]
    out.append(current)
    assert [[u for u, n in zip(units, numbers) if n == b] for b in range(max(numbers) + 1)] == out
    assert one(spark, C.batch_numbers(F.col("u")), u=[]) == []
    df = spark.createDataFrame([(units, numbers), ([], [])], "u array<string>, n array<int>")
    assert [r.b for r in df.select(C.batches(F.col("u"), F.col("n")).alias("b")).collect()] == [out, []]


def test_overlap_that_cannot_move_on_is_refused():
    with pytest.raises(ValueError):
        C.size_pieces("x" * 100, 10, 9)
