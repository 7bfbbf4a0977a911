import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from atomloom.llm import split


def walk(text, size, overlap):
    """The greedy cuts one after another."""
    n, at, out = len(text), 0, []
    sentence, word = split.boundaries(text)
    while True:
        begin = max(0, at - overlap)
        if begin + size >= n:
            return out + [n]
        step = min(split.LEAST_STEP, size - overlap)
        at = next((p for p in range(begin + size, at + step - 1, -1) if sentence[p]), None) or next((p for p in range(begin + size, at, -1) if word[p]), None) or begin + size
        out.append(at)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .!?\n。é\U0001f642", max_size=400), st.integers(2, 90), st.integers(0, 60))
def test_pointer_doubling_is_the_greedy_walk(text, size, overlap):
    if overlap >= size:
        with pytest.raises(ValueError):
            split.cuts(text + "x" * 100, size, overlap)
        return
    assert split.cuts(text, size, overlap) == (walk(text, size, overlap) if len(text) > size else [len(text)])
    spans = split.spans(text, size, overlap)
    assert all(b - a <= size for a, b in spans) and spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(b1 - a2 == min(overlap, b1) and b2 > b1 for (_, b1), (a2, b2) in zip(spans, spans[1:]))
    whole = text[: spans[0][1]] + "".join(text[b1:b2] for (_, b1), (_, b2) in zip(spans, spans[1:]))
    assert whole == text


def test_natural_boundaries():
    s = "This is approx. 15.6 m, cf. no. 244 in the list. "
    text = (s * 40).strip()
    ends = split.cuts(text)
    assert all(text[:e].endswith("list.") for e in ends)
    assert split.cuts("x" * 1000) == [512, 960, 1000]
    words = "wort " * 300
    assert all(words[e - 1] == " " or words[e] == " " for e in split.cuts(words.strip())[:-1])


def test_rows(spark):
    long = " ".join(f"Sentence number {i} is here." for i in range(200))
    rows = [(1, [" \n" + long + "\t ", None, "", "  ", "x" * 512, " " * 600 + "y"], "a"), (1, [" \n" + long + "\t ", None, "", "  ", "x" * 512, " " * 600 + "y"], "a"), (2, None, "a"), (3, [], "a"), (4, ["z" * 513], "a"), (None, ["q" * 600], "a"), (5, ["k" * 200000], "a")]
    df = spark.createDataFrame(rows, "request_id bigint, texts array<string>, piece string")
    got = split.pieces(df).collect()
    assert {(r.request_id, r.text_no) for r in got} == {(1, 0), (4, 0), (None, 0), (5, 0)}
    mine = sorted((r for r in got if r.request_id == 1), key=lambda r: r.piece_no)
    assert [r.piece_no for r in mine] == list(range(len(mine))) and all(r.piece == long[r.begin : r.end] and len(r.piece) <= 512 for r in mine)
    assert len({(r.request_id, r.text_no, r.piece_no) for r in got}) == len(got)
    everything = split.pieces(df, all_texts=True).collect()
    assert {(r.request_id, r.text_no) for r in everything} == {(1, 0), (1, 4), (1, 5), (4, 0), (None, 0), (5, 0)}
    items = spark.createDataFrame([(7, 1, 0, len(mine)), (8, 4, 0, None), (9, 4, 1, 1)], "item_id bigint, request_id bigint, item_no int, chunk_count int")
    c = {(r.request_id, r.text_no): (r.pieces, r.item_id, r.same) for r in split.counts(split.pieces(df, with_text=False), items).collect()}
    assert c[1, 0] == (len(mine), 7, True) and c[4, 0] == (2, 8, False) and c[5, 0][1] is None
    assert split.pieces(df.limit(0)).collect() == []


def test_different_texts_under_one_key(spark):
    texts = [" ".join(f"{w} number {i} is here." for i in range(40 + 20 * k)) for k, w in enumerate(("Sentence", "Item"))]
    for key in (1, None):
        got = split.pieces(spark.createDataFrame([(key, [t]) for t in texts + texts[:1]], "request_id bigint, texts array<string>")).collect()
        groups = {}
        for r in got:
            groups.setdefault(r.text_hash, []).append(r)
        assert len(groups) == 2
        for t in texts:
            own = sorted((r for r in got if t[r.begin : r.end] == r.piece and r.end <= len(t)), key=lambda r: r.piece_no)
            mine = [r for r in own if r.text_hash == own[-1].text_hash]
            assert {(r.begin, r.end) for r in mine} == set(split.spans(t))
        n = sum(len(split.spans(t)) for t in texts)
        assert len(got) == (n if key else n + len(split.spans(texts[0])))
        c = split.counts(split.pieces(spark.createDataFrame([(key, [t]) for t in texts], "request_id bigint, texts array<string>"), with_text=False), spark.createDataFrame([], "item_id bigint, request_id bigint, item_no int, chunk_count int"))
        assert sorted(r.pieces for r in c.collect()) == sorted(len(split.spans(t)) for t in texts)


@pytest.mark.parametrize("rows", [0, 10**6])
def test_requests_sent_again(spark, monkeypatch, rows):
    monkeypatch.setattr(split, "BROADCAST_ROWS", rows)
    data = [(i % 7, [None, "x" * (520 + i % 14), ""]) for i in range(60)]
    got = split.pieces(spark.createDataFrame(data, "request_id bigint, texts array<string>"), with_text=False).collect()
    assert sorted((r.request_id, r.end) for r in got if r.piece_no == 1) == sorted({(k, len(t[1])) for k, t in data})
