import gzip

import pytest

from atomloom.operators import parsers
from atomloom.operators import planning as P
from atomloom.service import BACKGROUND, KnowledgeBase
from atomloom.settings import Settings


def test_ingest_query_reset(spark, tmp_path):
    kb = KnowledgeBase(spark, f"file://{tmp_path}")
    assert kb.query("Is Rex an animal?")["answer"].startswith("I couldn't find") and kb.query("???")["query_status"] == "no_query"
    done = kb.ingest(["Dogs are animals. Rex is a dog.", "A wheel is part of a car.", "", "gibberish text of no form"]).collect()
    assert sorted(r.status for r in done) == ["failed", "success", "success", "success"]
    r = kb.query("Is Rex an animal?")
    assert "(IsA rex dog)" in r["proof"] and "Implication" in r["proof"] and r["query_status"] == "well_aligned" and r["answer"].startswith("Yes")
    r = kb.query("Is a wheel part of a car?")
    assert "(PartOf wheel car)" in r["proof"] and not r["fallback_used"] and r["executed_query"] == r["original_query"]
    assert kb.query("Who is an animal?")["proof"] and kb.query("Is Rex a plant?")["proof"] is None
    assert len({x.atom for x in kb.context("wheel of a car").collect()}) == 4
    h = kb.health()
    assert (h["atomspace_size"], h["background_atomspace_size"], h["vectordb_count"], h["status"]) == (4, 0, 2, "ok")
    kb.ingest(["A wheel is part of a car."], unique=True)
    assert kb.health()["atomspace_size"] == 4 and kb.health()["vectordb_count"] == 2
    kb.ingest(["A wheel is part of a car.", "A wheel is part of a car."], one_by_one=True)
    assert kb.health()["atomspace_size"] == 6
    kb.reset("vectordb")
    assert kb.health()["vectordb_count"] == 0 and kb.health()["atomspace_size"] == 6
    kb.reset()
    assert kb.health()["atomspace_size"] == 0
    with pytest.raises(ValueError):
        kb.reset("everything")


def test_background(spark, tmp_path):
    dump = tmp_path / "dump.csv.gz"
    with gzip.open(dump, "wt") as f:
        f.write("".join(f'a\t/r/PartOf\t/c/en/wheel_{i}\t/c/en/car\t{{"weight": 2.5}}\n' for i in range(5)))
    kb = KnowledgeBase(spark, f"file://{tmp_path}/kb")
    assert kb.load_background(str(dump)) and not kb.load_background(str(dump))
    h = kb.health()
    assert (h["background_atomspace_size"], h["vectors_indexed"], h["vectors_expected"]) == (5, 5, 5)
    assert "wheel_3" in kb.query("Is wheel-3 part of a car?")["proof"]
    kb.points.delete(BACKGROUND)
    assert kb.load_background(str(dump)) and kb.health()["vectors_indexed"] == 5 and kb.health()["background_atomspace_size"] == 5
    kb.reset(restore=str(dump))
    assert kb.health()["background_atomspace_size"] == 5
    with pytest.raises(Exception):
        kb.load_background(str(tmp_path / "none.gz"), force=True)
    assert kb.health()["status"] == "degraded"
    kb.settings = Settings(background_fail_open=True)
    assert not kb.load_background(str(tmp_path / "none.gz"), force=True) and kb.health()["status"] == "degraded"


class Spy(parsers.TemplateParser):
    """Remembers what it is given."""

    def __init__(self):
        self.given = []

    def parse_batch(self, df, key, texts):
        self.given.append(df.collect())
        return super().parse_batch(df, key, texts)

    def parse_query(self, df, key, text):
        self.given.append(df.collect())
        return super().parse_query(df, key, text)


def test_context_settings_and_skipped_rules(spark, tmp_path):
    kb = KnowledgeBase(spark, f"file://{tmp_path}", Settings(chunk_size=120, chunk_overlap=0, batch_max_sentences=1))
    spy = Spy()
    kb.parser = parsers.CanonicalParser(spy)
    kb.ingest(["Dogs are animals."])
    done = kb.ingest(["Rex is a dog. Tom is a dog. " + "Hana reads books " * 20]).first()
    assert done.batch_sizes[0] == 1 and done.batch_count == done.chunk_count > 3
    given = next(g for g in reversed(spy.given) if g)[0].context
    assert given[0].startswith("(: ") and P.BATCH_LINES[0] in given and given[-1] == P.STATEMENT_LINE and any(x.startswith(P.CONCEPT_LINE) for x in given)
    assert "(IsA rex dog)" in kb.query("Is Rex an animal?")["proof"]
    assert P.QUERY_LINE in next(g for g in reversed(spy.given) if g)[0].context
    kb.statements.append(spark.createDataFrame([("(: odd (Implication (Premises (Mapped (f $x) y)) (Conclusions (IsA $x plant))) (STV 1 1))",)], "raw string"))
    r = kb.query("Is Rex a plant?")
    assert r["proof"] is None and len(r["skipped_rules"]) == 1 and r["unfinished"] is None
    kb.settings = Settings(chaining_max_steps=0)
    assert "0 rounds" in kb.query("Is Rex an animal?")["unfinished"]


@pytest.mark.parametrize("name", ["extraction", "merging"])
def test_other_parsers(spark, tmp_path, name):
    kb = KnowledgeBase(spark, f"file://{tmp_path}", Settings(parser=name))
    done = kb.ingest(["Birds have wings.\n\nPolly is a bird. Sam is not a bird.", None]).collect()
    one = next(r for r in done if r.doc_id == 0)
    assert (one.status, one.chunk_count, one.batch_count, one.parser_calls) == ("success", 1, 0, 1) if name == "extraction" else one.batch_count == 0
    assert kb.query("Does Polly have wings?")["proof"] and kb.query("Is Sam a bird?")["proof"] is None
    if name == "extraction":
        assert kb.parser.heads and kb.parser.rejects.count() == 0
        kb.reset()
        assert kb.parser.heads == []
