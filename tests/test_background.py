import gzip
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from atomloom.operators import background as B
from atomloom.sources import files

ROWS = [
    "a\t/r/IsA\t/c/en/dogs/n\t/c/en/animals\t{\"weight\": 2.0}",
    "a\t/r/HasProperty\t/c/en/dog\t/c/en/animal\t{\"weight\": 9.0}",
    "a\t/r/PartOf\t/c/en/big_wheel\t/c/en/car\t{\"weight\": 3.5}",
    "a\t/r/PartOf\t/c/de/rad\t/c/en/car\t{\"weight\": 3.5}",
    "a\t/r/PartOf\t/c/en/语\t/c/en/car\t{\"weight\": 3.5}",
    "a\t/r/Nope\t/c/en/x\t/c/en/car\t{\"weight\": 3.5}",
    "a\t/r/HasA\t/c/en/x\t/c/en/y\t{broken",
    "a\t/r/HasA\t/c/en/x\t/c/en/y\t{\"dataset\": 1}",
    "a\t/r/HasA\t/c/en/x\t/c/en/z\t{\"weight\": \"abc\"}",
    "a\t/r/HasA\t/c/en/x\t/c/en/w\t{\"weight\": 1.9999}",
    "a\t/r/HasA\t/c/en/x",
    "a\t/r/HasA\t/c/en/x\t/c/en/v\t{\"weight\": 5}\textra",
    "",
    "a\t/r/HasProperty\t/c/en/Red_Things\t/c/en/hot_stuff\t{\"weight\": 2.5}",
]


@pytest.fixture(scope="module")
def dump(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("dump") / "rows.csv.gz")
    with gzip.open(path, "wt", encoding="utf-8") as f:
        f.write("\n".join(ROWS) + "\n")
    return files.assertions(spark, path)


def test_scan(dump):
    rows, lines, wide = dump
    assert lines.count() == len(ROWS) and rows.count() == 11 and [r.line.endswith("extra") for r in wide.collect()] == [True]


def test_pipeline(dump):
    fit = B.eligible(dump[0])
    assert sorted((r.predicate, r.source, r.target, r.weight) for r in fit.collect()) == [("IsA", "dog", "animal", 2.0), ("IsA", "dog", "animal", 9.0), ("IsA", "red_thing", "hot_stuff", 2.5), ("PartOf", "big_wheel", "car", 3.5)]
    assert ("HasA", "x", "y", 1.0) in {(r.predicate, r.source, r.target, r.weight) for r in B.eligible(dump[0], 1.0).collect()}
    stm = {(r.predicate, r.source): r for r in B.statements(B.first_of_triple(fit)).collect()}
    dog = stm["IsA", "dog"]
    digest = hashlib.md5(b"IsA|dog|animal").hexdigest()[:10]
    assert dog.atom == f"(: cnet_isa_{digest} (IsA dog animal) (STV 1.0 {2.0 / 2.2:.4f}))" and dog.nl == "dog is a kind of animal"
    assert stm["IsA", "red_thing"].nl == "red_thing is hot_stuff" and stm["PartOf", "big_wheel"].nl == "big wheel is part of car"
    c = B.counts(dump[0]).first()
    assert (c.scanned, c.eligible, c.sampled, c.deduped) == (11, 4, 4, 3)
    assert {r.relation: r.n for r in B.relation_counts(B.statements(B.first_of_triple(fit))).collect()} == {"IsA": 2, "PartOf": 1}


def test_sample(spark):
    rows = [(i, "/r/IsA", "IsA", f"s{i}", "t", 2.0) for i in range(500)]
    df = spark.createDataFrame(rows, "line_no bigint, relation string, predicate string, source string, target string, weight double")
    keep = lambda p: {r.line_no for r in B.sampled(df, p, 7).collect()}
    want = {i for i in range(500) if int(hashlib.sha256(f"7|IsA|s{i}|t".encode()).hexdigest()[:16], 16) / 2.0**64 < 0.3}
    assert keep(30) == want and keep(10) <= keep(30) <= keep(60) and len(keep(100)) == 500
    for bad in (0, -1, 101):
        with pytest.raises(ValueError):
            B.sampled(df, bad)


def test_sinks_and_manifest(spark, dump, tmp_path):
    stm = B.statements(B.first_of_triple(B.eligible(dump[0])))
    files.write_statements(stm, str(tmp_path / "kb"))
    good, bad = files.statement_lines(spark, str(tmp_path / "kb"), "bg")
    assert good.count() == 3 and bad.count() == 0
    files.write_payloads(stm.withColumn("nl", F.concat("nl", F.lit(" é🙂"))), str(tmp_path / "pay"), "bg")
    text = "".join(r.value for r in spark.read.text(str(tmp_path / "pay")).collect())
    assert text.isascii() and "\\u00e9\\ud83d\\ude42" in text
    back = files.payloads(spark, str(tmp_path / "pay")).collect()
    assert len(back) == 3 and all(r.nl.endswith(" é🙂") and r.background and r.source == "bg" and len(r.pln) == 1 for r in back)
    m = B.manifest(dump[0], "dump.gz", percent=50.0)
    files.write_manifest(m, str(tmp_path / "man"))
    stored = files.read_manifest(spark, str(tmp_path / "man"))
    wanted = {"source_file": "dump.gz", "normalization_version": 1, "min_weight": 2.0, "coverage_percent": 50.0, "sample_seed": 42}
    assert B.is_current(stored, wanted) and not B.is_current(stored, wanted | {"min_weight": 1.0}) and not B.is_current(None, wanted)
    assert files.read_manifest(spark, str(tmp_path / "none")) is None and files.expected_count(stored) == stored["atom_count"] and files.expected_count({"atom_count": "x"}) == files.expected_count(None) == 0


def test_payload_reader(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"nl": "a", "pln": ["x"]}\n\n{"nl": "b"}\n{"pln": []}\n')
    assert [r.nl for r in files.payloads(spark, str(tmp_path / "a.jsonl")).collect()] == ["a"]
    (tmp_path / "b.jsonl").write_text("{oops\n")
    with pytest.raises(Exception):
        files.payloads(spark, str(tmp_path / "b.jsonl")).collect()


def test_empty(spark, dump):
    none = dump[0].limit(0)
    assert B.counts(none).first().eligible == 0 and B.manifest(none, "x").first().atom_count == 0 and B.statements(B.first_of_triple(B.eligible(none))).count() == 0
    assert json.loads(json.dumps(B.manifest(none, "x").first().asDict()))["relation_counts"] == ""
