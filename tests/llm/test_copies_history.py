import random
import re
from collections import Counter

import pytest

from atomloom.llm import copies, history

SCHEMA = "id bigint, batch_no int, items array<string>, root string, leaves int"


def plain(s):
    return "".join(c for c in s.lower() if c.isalnum())


def words(items):
    return Counter(w for s in items for w in re.findall(r"[^\W_]+", s.lower()))


def made(seed, n=220):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        kind = rng.random()
        if rows and kind < 0.55:
            items = [s for s in rng.choice(rows)[2] or []]
            rng.shuffle(items)
            items = [rng.choice([s, s.upper(), s.replace(" ", "  "), s.replace("_", "-"), f'"{s}"', s.replace("_", "")]) for s in items if s]
            if items and rng.random() < 0.5:
                j = rng.randrange(len(items))
                items[j] = re.sub(r"[a-z]{4,}", lambda m: m[0] if rng.random() < 0.7 else m[0] + "x", items[j])
            items += rng.choice([[], [None], [""], ["  \t"]])
        elif kind < 0.6:
            items = rng.choice([None, [], [None], ["  "], ["..."], ["!?", "..."]])
        else:
            items = [f"(: {w}_at_{j} (AtLocation {w}_{rng.choice('abcd')}box place{rng.randint(1, 9)}) (STV 1.0 0.{rng.randint(1, 9999)}))" for j in range(rng.randint(1, 6)) for w in ["".join(rng.choices("aeioubdgk", k=8))]]
        rows.append((i, 1 + i * 5 // n, items, "x", 1))
    return rows


def truth(rows):
    own = [(i, b, [s for s in it or [] if s and s.strip()]) for i, b, it, *_ in rows]
    own = [(i, b, s, sorted(map(plain, s)), words(s)) for i, b, s in own if s]
    out = set()
    for i, b, _, p, w in own:
        for j, b2, _, p2, w2 in own:
            if b < b2:
                n = sum((w & w2).values())
                if p == p2 or (w and w2 and 5 * n >= 4 * (sum(w.values()) + sum(w2.values()) - n)):
                    out.add((i, j))
    groups = {}
    for i, _, _, p, _ in own:
        groups.setdefault(tuple(p), []).append(i)
    return out, {(min(g), i) for g in groups.values() for i in g if i != min(g)}, groups


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = made(seed)
    df = spark.createDataFrame(rows, SCHEMA)
    near, same, groups = truth(rows)
    recs = copies.records(df, "t", "id", "items")
    assert {(r.id_a, r.id_b) for r in copies.copies(recs).collect()} == same
    assert {r.id: r.copies for r in copies.collapsed(recs).collect()} == {min(g): len(g) for g in groups.values()}
    tagged = df.selectExpr("'t' rec_table", "id", "batch_no", "items")
    got = history.pairs(tagged).collect()
    assert len(got) == len(set(got))
    got = {(r.id_a, r.id_b) for r in got}
    assert got <= near and len(got) >= 0.995 * len(near) and len(near) > 100


def test_batches_one_after_another(spark, tmp_path, monkeypatch):
    """Each batch through an index of its own object over one folder, with renewals, small buckets and a batch that comes twice."""
    monkeypatch.setattr(history, "RENEWED_AT", 1.2)
    monkeypatch.setattr(history, "BUCKET_ROWS", 16)
    rows = made(3, 150)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("'t' rec_table", "id", "batch_no", "items")
    got, generations = set(), set()
    for b in (1, 2, 3, 3, 4, 5):
        index = history.Index(spark, str(tmp_path))
        mine = {(r.id_a, r.id_b) for r in index.add(df.where(f"batch_no = {b}"), f"b{b}").collect()}
        assert b != 3 or not (got & mine) or mine <= got
        got |= mine
        generations.add(index.state.generation)
    assert got == truth(rows)[0] and len(generations) > 1
    assert history.Index(spark, str(tmp_path))._read("members", None, "k", 0).where("is_bag").count() == sum(bool(words([s for s in i or [] if s])) for _, _, i, *_ in rows)


def test_a_batch_that_broke_off_is_not_there(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([("t", i, 1 + i // 2, ["(: a (Has b c) (STV 1 1))"]) for i in range(6)], "rec_table string, id bigint, batch_no int, items array<string>")
    history.Index(spark, str(tmp_path)).add(df.where("batch_no = 1"), "1")
    with monkeypatch.context() as m:
        m.setattr(history.Index, "_commit", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            history.Index(spark, str(tmp_path)).add(df.where("batch_no = 2"), "2")
    got = {(r.id_a, r.id_b) for r in history.Index(spark, str(tmp_path)).add(df.where("batch_no = 3"), "3").collect()}
    assert got == {(0, 4), (0, 5), (1, 4), (1, 5)}
    got = {(r.id_a, r.id_b) for r in history.Index(spark, str(tmp_path)).add(df.where("batch_no = 2"), "2").collect()}
    assert got == {(0, 2), (0, 3), (1, 2), (1, 3)}


def test_rows_read_of_the_history_do_not_grow(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(history, "BUCKET_ROWS", 32)
    read = {}
    for n in (400, 3200):
        old = spark.createDataFrame([("t", i, 1, [f"(: f{i} (Has thing{i} part{i} in the house) (STV 1 0.{i}))"]) for i in range(n)], "rec_table string, id bigint, batch_no int, items array<string>")
        new = spark.createDataFrame([("t", n + 1, 2, ["(: f7 (Has thing7 part7 in the house) (STV 1 0.8))"])], old.schema)
        index = history.Index(spark, f"{tmp_path}/{n}")
        index.add(old, "1")
        seen, scan = [], history.Index._read

        def counted(self, table, asked, on, rows, by=None):
            seen.append(scan(self, table, None, on, rows, by if by is not None else asked).count())
            return scan(self, table, asked, on, rows, by)

        with monkeypatch.context() as m:
            m.setattr(history.Index, "_read", counted)
            assert [(r.id_a, r.id_b) for r in index.add(new, "2").collect()] == [(7, n + 1)]
        read[n] = sum(seen)
    assert read[3200] < 2 * read[400] < 2 * 4 * 400


def test_equal_digests_are_compared_in_full(spark, monkeypatch):
    rows = [("t", 1, ["a"]), ("t", 2, ["b"]), ("t", 3, ["a"]), ("t", 4, ["b"]), ("u", 5, ["a"]), ("t", 6, ["c"])]
    monkeypatch.setattr(copies.F, "xxhash64", lambda *a: copies.F.lit(1).cast("bigint"))
    got = copies.copies(spark.createDataFrame(rows, "rec_table string, id bigint, leaves array<string>")).collect()
    assert {(r.id_a, r.id_b) for r in got} == {(1, 3), (2, 4)}


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert copies.copies(copies.records(df, "t", "id", "items")).collect() == []
    assert history.pairs(df.selectExpr("'t' rec_table", "id", "batch_no", "items")).collect() == []


def test_very_long_statement_and_hot_copies(spark):
    long = "(: big (Has " + " ".join(f"w{i}" for i in range(60_000)) + ") (STV 1.0 1.0))"
    rows = [(1, 1, [long], "x", 1), (2, 2, [long.upper()], "x", 1), (3, 2, [long.replace("w5 ", "v ")], "x", 1)]
    rows += [(10 + i, 1 + i % 3, ["(: hot (Has a b) (STV 1.0 0.9))"], "x", 1) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    same = {(r.id_a, r.id_b) for r in copies.copies(copies.records(df, "t", "id", "items")).collect()}
    assert same == {(1, 2)} | {(10, 10 + i) for i in range(1, 60)}
    got = {(r.id_a, r.id_b) for r in history.pairs(df.selectExpr("'t' rec_table", "id", "batch_no", "items")).collect()}
    assert got == {(1, 2), (1, 3)} | {(10 + i, 10 + j) for i in range(60) for j in range(60) if i % 3 < j % 3}


def test_null_keys(spark):
    rows = [(None, 1, ["a b"], "x", 1), (1, None, ["a b"], "x", 1), (2, 1, ["a b"], "x", 1), (3, 2, ["A  b"], "x", 1)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("'t' rec_table", "id", "batch_no", "items")
    assert [(r.id_a, r.id_b) for r in history.pairs(df).collect()] == [(2, 3)]


def test_hot_near_copies(spark):
    rows = [(i, 1 + i % 4, [f"(: fact{i} (AtLocation red_box_on the_shelf place_nine) (STV 1.0 0.9))"], "x", 1) for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("'t' rec_table", "id", "batch_no", "items")
    got = {(r.id_a, r.id_b) for r in history.pairs(df).collect()}
    assert got == {(i, j) for i in range(200) for j in range(200) if i % 4 < j % 4}


@pytest.mark.parametrize("n", [9, 18, 36, 90])
def test_edits_anywhere(spark, tmp_path, n):
    rng, rows = random.Random(n), []
    for i in range(60):
        own = [f"w{i}_{j}".replace("_", "x") for j in range(n)]
        edited = list(own)
        for e, j in enumerate(rng.sample(range(n), n // 9) if i % 2 else range(4, n, 9)):
            edited[j] = f"e{i}x{e}"
        rows += [(2 * i, 1, [" ".join(own)], "x", 1), (2 * i + 1, 2, [" ".join(edited)], "x", 1)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("'t' rec_table", "id", "batch_no", "items")
    near = {(2 * i, 2 * i + 1) for i in range(60)}
    assert truth(rows)[0] == near
    assert {(r.id_a, r.id_b) for r in history.pairs(df).collect()} == near
    if n == 36:
        index = history.Index(spark, str(tmp_path))
        assert [{(r.id_a, r.id_b) for r in index.add(df.where(f"batch_no = {b}"), str(b)).collect()} for b in (1, 2)] == [set(), near]
