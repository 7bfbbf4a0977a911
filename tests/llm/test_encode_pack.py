import random

import numpy as np
import pytest

from atomloom.llm import bpe, pack
from atomloom.llm.encode import encode, token_counts

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def public():
    t = tokenizers.Tokenizer.from_file(f"{bpe.TOKENIZER_DIR}/{bpe.TOKENIZER_FILE}")
    t.encode_special_tokens = True
    return t


def texts():
    rng = random.Random(3)
    parts = ["a", "aa", "e", "ss", "in", "ing", " the", "  ", "\n", "=", "'ll", "9", "é", "语", "🙂", "<|endoftext|>", " ", "\x1c", "²"]
    return ["", " ", "x", "a" * 500, "=" * 77, "ab" * 90] + ["".join(rng.choices(parts, k=rng.randint(1, 40))) for _ in range(400)]


def test_same_ids_as_public_tokenizer(public):
    e = bpe.encoder()
    for t in texts():
        assert np.frombuffer(e.encode_bytes(t), "<i4").tolist() == public.encode(t, add_special_tokens=False).ids, ascii(t)


def test_encode_rows(spark, public):
    rows = [(i, t, 7) for i, t in enumerate(texts())] + [(-1, None, 1), (None, "null key", 1), (3, "again", 2)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids int")
    got = encode(df).collect()
    assert sorted((str(r.doc_id), r.ids) for r in got) == sorted((str(i), public.encode(t or "", add_special_tokens=False).ids) for i, t, _ in rows)
    assert {r.doc_id: r.n_tokens for r in token_counts(df).collect()}[-1] == 0
    assert encode(df.limit(0)).collect() == []


def test_long_word_and_full_cache(public, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    e = bpe.PrefixEncoder(f"{bpe.TOKENIZER_DIR}/{bpe.TOKENIZER_FILE}")
    for t in ["one two three four five six seven", "q" * 20000]:
        assert np.frombuffer(e.encode_bytes(t), "<i4").tolist() == public.encode(t, add_special_tokens=False).ids


def used(steps, histogram):
    load, seen = {}, {}
    by = {}
    for step in steps:
        by.setdefault(step[0], []).append(step)
    for s, n in histogram.items():
        mine = sorted(by[s], key=lambda x: x[1])
        for j, (_, first, box, each) in enumerate(mine):
            for r in range(first, mine[j + 1][1] if j + 1 < len(mine) else n):
                load[box + (r - first) // each] = load.get(box + (r - first) // each, 0) + s
                seen[s] = seen.get(s, 0) + 1
    return load, seen


@pytest.mark.parametrize("seed", range(12))
def test_plan_fills(seed):
    rng = random.Random(seed)
    cap = rng.choice([10, 60, 100, 2048])
    h = {}
    for _ in range(rng.choice([1, 40, 900])):
        s = min(cap, int(rng.expovariate(1 / (cap / rng.choice([2, 4, 12])))))
        h[s] = h.get(s, 0) + rng.choice([1, 1, 1, 30])
    steps, boxes = pack.plan(h, cap)
    load, seen = used(steps, h)
    assert seen == h and max(load.values()) <= cap and len(load) <= boxes
    assert set(load) <= set(range(boxes))
    total = sum(s * n for s, n in h.items())
    big = sum(n for s, n in h.items() if 2 * s > cap)
    assert boxes <= max(big, -(-total // cap)) * 1.25 + 2


@pytest.mark.parametrize("part_items", [10**6, 20])
def test_assign(spark, part_items):
    rows = [(i, n) for i, n in enumerate([0] * 300 + [7] * 200 + [60, 41, 40, 100, 101, 250, 300, 33, 34, 1])] + [(9999, None)]
    got = pack.assign(spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint"), capacity=100, part_items=part_items).collect()
    load, pieces = {}, {}
    for r in got:
        load[r.container_id] = load.get(r.container_id, 0) + r.size
        pieces.setdefault(r.doc_id, []).append(r.size)
    assert max(load.values()) <= 100
    assert {k: sum(v) for k, v in pieces.items()} == {k: v or 0 for k, v in rows}
    assert sorted(pieces[505]) == [50, 100, 100] and len(pieces[506]) == 3 and len(pieces[503]) == 1
    assert pack.assign(spark.createDataFrame([], "doc_id bigint, n_tokens bigint")).collect() == []


def test_hot_size_is_ranked_in_parts(spark):
    """Nine tenths of the items have one size: no part of it holds many more than part_items."""
    df = spark.createDataFrame([(i, 5 if i % 10 else 60) for i in range(4000)], "doc_id bigint, n_tokens bigint")
    got = pack.assign(df, capacity=100, part_items=300)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "part#" in plan and got.count() == 4000
    many = {r["n"] for r in df.selectExpr("n_tokens", "pmod(xxhash64(doc_id, 0), 13) p").groupBy("n_tokens", "p").count().withColumnRenamed("count", "n").collect()}
    assert max(many) < 450
    load = {}
    for r in got.collect():
        load[r.container_id] = load.get(r.container_id, 0) + r.size
    assert max(load.values()) <= 100 and sum(load.values()) >= 0.99 * 100 * len(load)
