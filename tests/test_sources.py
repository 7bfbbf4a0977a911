import json

import pytest

from atomloom.settings import Settings
from atomloom.sources import files
from atomloom.sources.points import PointTable


def test_statement_table(spark, tmp_path):
    t = files.StatementTable(spark, str(tmp_path / "kb"))
    assert t.read().count() == 0 and t.size() == 0
    df = spark.createDataFrame([("(: a  (X b)\n(STV 1 1))",), (" ",), (None,), ("(: a (X b) (STV 1 1))",)], "raw string")
    assert t.append(df).count() == 2 and t.size() == 2  # stored again, as it came
    assert t.append(df, unique=True).count() == 0 and t.size() == 2
    (tmp_path / "bg.txt").write_text("(: b (X c) (STV 1 1))\n\nbroken (\n  (: c (X d) (STV 1 1))  \n")
    assert t.load_background(str(tmp_path / "bg.txt")) and not t.load_background(str(tmp_path / "bg.txt"))
    assert t.size(background=True) == 2 and t.size() == 2
    good, bad = files.statement_lines(spark, str(tmp_path / "bg.txt"), "x")
    assert bad.first().raw == "broken ("
    t.reset("kb")
    assert t.size() == 0 and t.size(background=True) == 2
    t.reset()
    assert t.read().count() == 0


def test_points(spark, tmp_path):
    t = PointTable(spark, str(tmp_path / "points"), 64)
    df = spark.createDataFrame([("dogs bark", ["(a)"]), ("cats sleep", ["(b)"]), (None, None)], "nl string, pln array<string>")
    assert t.count() == 0 and t.add(df) == 3 and t.count() == 3
    q = spark.createDataFrame([(1, "dogs bark loud")], "q int, text string")
    from pyspark.sql import functions as F

    from atomloom.operators import retrieval as R

    hits = t.search(q.select("q", R.embed(F.col("text")).alias("v")), "q", "v", 2).collect()
    assert len(hits) == 2 and hits[0].rank == 1 and hits[0].score > hits[1].score
    best = t.read().where(F.col("point_id") == hits[0].id).first()
    assert best.nl == "dogs bark" and best.source is None
    assert t.index_state("bg", 2) == "absent" and t.replace_source(df.where("nl is not null"), "bg", 2) and t.index_state("bg", 2) == "complete"
    assert not t.replace_source(df, "bg", 2) and t.replace_source(df.limit(1), "bg", 3) and t.index_state("bg", 3) == "partial" and t.count("bg") == 1
    t.delete("bg")
    assert t.count("bg") == 0 and t.count() == 3
    with pytest.raises(Exception):
        t.add(spark.createDataFrame([("x", ["(a)"], [1.0])], "nl string, pln array<string>, vector array<float>"))
    t.drop()
    assert t.count() == 0


def test_what_is_there_is_not_stored_twice(spark, tmp_path):
    t = PointTable(spark, str(tmp_path / "points"), 64)
    df = spark.createDataFrame([("dogs bark", ["(a)"]), ("dogs bark", ["(a)"]), ("cats sleep", ["(b)"])], "nl string, pln array<string>")
    assert t.add(df) == 2 and t.add(df) == 0 and t.count() == 2
    s = files.StatementTable(spark, str(tmp_path / "kb"))
    for i in range(12):
        s.append(spark.createDataFrame([(f"(: s{i} (X b) (STV 1 1))",), ("(: s0 (X b) (STV 1 1))",)], "raw string").coalesce(1), unique=True)
    assert [r.raw.split()[1] for r in s.read().orderBy("seq").collect()] == [f"s{i}" for i in range(12)]


def test_lines_follow_files_and_places(spark, tmp_path):
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "a.txt").write_text("first\n")
    (tmp_path / "lines" / "b.txt").write_text("".join(f"{i:05d}\n" for i in range(5000)))
    (tmp_path / "lines" / "c.txt").write_text("last\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = [r.line for r in files.numbered(spark, str(tmp_path / "lines")).orderBy("line_no").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == ["first", *(f"{i:05d}" for i in range(5000)), "last"]


def test_other_files(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps(["a", "b\nc"]))
    (tmp_path / "c.txt").write_text("a\n\n  b \r\n")
    assert [r.item for r in files.context_items(spark, str(tmp_path / "c.json")).collect()] == ["a", "b\nc"]
    assert [r.item for r in files.context_items(spark, str(tmp_path / "c.txt")).collect()] == ["a", "b"]
    spec = {"statement_prompt": "s", "query_prompt": "q", "statement_examples": [], "query_examples": []}
    (tmp_path / "e.json").write_text(json.dumps(spec, indent=1))
    assert files.example_spec(spark, str(tmp_path / "e.json")) == spec
    del spec["query_prompt"]
    (tmp_path / "e.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="query_prompt"):
        files.example_spec(spark, str(tmp_path / "e.json"))
    df = spark.createDataFrame([("p", 1)], "parser string, cases int")
    assert files.report_markdown(df) == "| parser | cases |\n|---|---|\n| p | 1 |"


def test_settings(tmp_path, monkeypatch):
    env = tmp_path / ".env"
    env.write_text('# x\nATOMLOOM_CHUNK_SIZE=99\nATOMLOOM_PARSER="other"\nUNRELATED=1\n')
    monkeypatch.setenv("ATOMLOOM_QUERY_FALLBACK_ENABLED", "no")
    monkeypatch.setenv("ATOMLOOM_CHUNK_SIZE", "77")
    s = Settings.load(str(env))
    assert (s.chunk_size, s.parser, s.query_fallback_enabled, s.chunk_overlap) == (77, "other", False, 64)
    monkeypatch.setenv("ATOMLOOM_CHUNK_SIZE", "many")
    with pytest.raises(ValueError, match="CHUNK_SIZE"):
        Settings.load()
