import datetime as dt
import random

from atomloom.operators import orphans as O

START = dt.datetime(2024, 1, 1)


def at(rng):
    return START + dt.timedelta(days=rng.randint(0, 200), microseconds=rng.choice([0, 1, 10**9]))


def plain(s):
    return "".join(c for c in s.lower() if c.isalnum())


def test_against_brute_force(spark):
    rng = random.Random(4)
    names = [f"key_{i}" for i in range(60)] + ["hot"]
    writing = lambda s: rng.choice([s, s.upper(), s.replace("_", "-"), f" {s} "])
    lived = []
    for n in names[:55] + names[:20] + ["hot"]:
        a = at(rng)
        lived.append((n, a, rng.choice([None, a, at(rng), a + dt.timedelta(days=3)]), 1))
    refs = []
    for i in range(900):
        src = rng.choice([None, "", " \t", writing("hot"), writing(rng.choice(names))])
        items = rng.choice([None, [], [rng.choice([None, "", "  ", "no colon", f"(: {writing(rng.choice(names)).strip()} (IsA a b) (STV 1 1))", f'(:\t"{rng.choice(names)}"(IsA a b))']) for _ in range(rng.randint(1, 4))]])
        refs.append((i, rng.choice([None] + [at(rng)] * 30), src, items, 0))
    df = spark.createDataFrame(refs, "id bigint, stored timestamp, source string, pln array<string>, key int")
    ld = spark.createDataFrame(lived, "name string, since timestamp, until timestamp, kind int")
    got = O.orphans(O.references(df, "t", "id", "stored", "source", "pln"), O.targets(ld, "statement", "name", "since", "until").unionByName(O.targets(ld.where("name <> 'key_3'"), "source", "name", "since", "until"))).collect()
    alive = lambda k, t, skip=None: t is not None and any(plain(n) == k and n != skip and s <= t and (u is None or u > t) for n, s, u, _ in lived)
    want = set()
    for i, t, src, items, _ in refs:
        if src and src.strip() and not alive(plain(src), t, "key_3"):
            want.add((i, "source", 0))
        for j, x in enumerate(items or []):
            if x and x.strip():
                word = x.partition(":")[2].replace("(", " ").split()
                if not word or not alive(plain(word[0]), t):
                    want.add((i, "pln", j))
    assert {(r.row_id, r.ref_field, r.ref_no) for r in got} == want and len(got) == len(want) and len(want) > 300
    assert sum(r.orphans for r in O.counted(spark.createDataFrame(got)).collect()) == len(want)


def test_empty_sides(spark):
    df = spark.createDataFrame([(1, START, "a", ["(: b (IsA c d) (STV 1 1))"])], "id bigint, stored timestamp, source string, pln array<string>")
    none = spark.createDataFrame([], "name string, since timestamp, until timestamp")
    refs = O.references(df, "t", "id", "stored", "source", "pln")
    assert len(O.orphans(refs, O.targets(none, "source", "name", "since", "until")).collect()) == 2
    assert O.orphans(refs.limit(0), O.targets(none, "source", "name", "since", "until")).collect() == []


def test_a_key_stored_again_and_again(spark, monkeypatch):
    """A key with nine tenths of the targets and references: no task numbers more rows of it than there are months."""
    tables, keep = {}, O.written
    monkeypatch.setattr(O, "written", lambda df, label: tables.setdefault(label, keep(df, label)))
    lived = [("hot", START + dt.timedelta(hours=6 * i), START + dt.timedelta(hours=6 * i + 3), 0) for i in range(900)] + [(f"k{i}", START, None, 0) for i in range(100)]
    refs = [(i, START + dt.timedelta(hours=2 * i + 1), "hot", []) for i in range(900)] + [(900 + i, START + dt.timedelta(days=9), f"K {i}", []) for i in range(110)]
    df = spark.createDataFrame(refs, "id bigint, stored timestamp, source string, pln array<string>")
    ld = spark.createDataFrame(lived, "name string, since timestamp, until timestamp, kind int")
    got = {r.row_id for r in O.orphans(O.references(df, "t", "id", "stored", "source"), O.targets(ld, "source", "name", "since", "until")).collect()}
    assert got == {i for i in range(900) if (2 * i + 1) % 6 >= 3} | set(range(1000, 1010))
    assert tables["reference-codes"].groupBy("key").count().agg({"count": "max"}).first()[0] <= 9
