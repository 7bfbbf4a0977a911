"""Ingestion, answering and the state of the knowledge base as DataFrames, and benchmark runs over them."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atomloom.operators import chunking as C
from atomloom.operators import planning as P
from atomloom.session import written

#: What is told when nothing was made, translated or proved.
NO_STATEMENTS = "Parser produced no statements for any chunk or batch. Check parser logs and model configuration."
NO_GOAL = "I couldn't translate this question into a logical query."
NO_PROOF = "I couldn't find a proof for that."
WEAK = "No proof was found. The generated query is only weakly aligned with the current knowledge base, so the failure may come from query shape mismatch or missing witness facts."


@dataclass(frozen=True)
class Limits:
    """How texts are cut and batched; paragraph_size, where it isn't 0, keeps paragraphs together, and by_chunk hands chunks over one at a time."""

    size: int = C.SIZE
    overlap: int = C.OVERLAP
    most_sentences: int = C.MOST_SENTENCES
    most_chars: int = C.MOST_CHARS
    paragraph_size: int = 0
    by_chunk: bool = False


def sized(docs: DataFrame, key: str, text: str, limits: Limits = Limits()) -> DataFrame:
    """(key, chunk_count, batch_count, batch_sizes array<int>, parser_calls, chunks, numbers): how each text is handed to a parser in batches, or chunk by chunk (no batches then)."""
    df = docs.select(key, C.paragraphs_first(F.col(text), limits.paragraph_size).alias("chunks")) if limits.paragraph_size else C.chunks(docs, key, text, limits.size, limits.overlap)
    if limits.by_chunk:
        numbers = F.transform("chunks", lambda c, i: i)
        return df.select(key, F.size("chunks").alias("chunk_count"), F.lit(0).alias("batch_count"), F.array().cast("array<int>").alias("batch_sizes"), F.size("chunks").alias("parser_calls"), "chunks", numbers.alias("numbers"))
    df = df.withColumn("numbers", C.batch_numbers(F.col("chunks"), limits.most_sentences, limits.most_chars))
    last = F.coalesce(F.try_element_at("numbers", F.lit(-1)), F.lit(-1))
    each = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    df = df.withColumn("batch_sizes", F.transform(each, lambda b: F.size(F.filter("numbers", lambda n: n == b))))
    return df.select(key, F.size("chunks").alias("chunk_count"), F.size("batch_sizes").alias("batch_count"), "batch_sizes", F.size("batch_sizes").alias("parser_calls"), "chunks", "numbers")


def outcome(parser_calls: Column, empty_results: Column, atoms: Column, error: Column | None = None) -> Column:
    """struct(status, error): failed on an error, or if every call was empty and no atom came; no chunk is a success."""
    nothing = (parser_calls > 0) & (empty_results == parser_calls) & (atoms == 0)
    err = F.when(nothing, F.lit(NO_STATEMENTS))
    if error is not None:
        err = F.coalesce(error, err)
    return F.struct(F.when(err.isNotNull(), "failed").otherwise("success").alias("status"), err.alias("error"))


def ingest(docs: DataFrame, key: str, text: str, parser, limits: Limits = Limits(), context=None) -> DataFrame:
    """(key, atoms array<string>, status, error, chunk_count, batch_count, batch_sizes, parser_calls, units) for each text.

    units is array<struct<nl, pln>>: the text of each batch that gave statements, with them. A parser with a chunk size
    or a way of its own to take chunks goes before the limits. context is a function from (key, text) of all batches
    to (key, context array<string>). All texts of one call see the knowledge base as it stood before: to have each see
    those before it, call it once a text.
    """
    own = getattr(parser, "paragraph_size", None)
    limits = replace(limits, paragraph_size=limits.paragraph_size or own or 0, by_chunk=limits.by_chunk or getattr(parser, "by_chunk", False))
    units = written(sized(docs, key, text, limits), "ingest-units")
    batches = units.select(key, F.posexplode(C.batches(F.col("chunks"), F.col("numbers"))).alias("batch_no", "texts")).select(F.struct(key, "batch_no").alias("k"), "texts")
    if context is not None:
        batches = batches.join(context(batches.select("k", F.array_join("texts", " ").alias("text"))), "k", "left")
    made = parser.parse_batch(batches, "k", "texts").select("k", "statements").join(batches.select("k", F.array_join("texts", " ").alias("nl")), "k")
    made = made.select(F.col(f"k.{key}").alias(key), F.col("k.batch_no").alias("batch_no"), "statements", "nl")
    per_text = made.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("batch_no", "statements", "nl"))).alias("all"))
    none = F.array().cast("array<string>")
    per_text = per_text.select(key, F.array_distinct(F.flatten(F.transform("all", lambda x: x["statements"]))).alias("atoms"), F.size(F.filter("all", lambda x: F.size(x["statements"]) == 0)).alias("empty"), F.transform(F.filter("all", lambda x: F.size(x["statements"]) > 0), lambda x: F.struct(x["nl"].alias("nl"), x["statements"].alias("pln"))).alias("units"))
    df = units.drop("chunks", "numbers").join(per_text, key, "left")
    atoms = F.coalesce("atoms", none)
    o = outcome(F.col("parser_calls"), F.coalesce("empty", F.lit(0)), F.size(atoms))
    return df.select(key, atoms.alias("atoms"), o["status"].alias("status"), o["error"].alias("error"), "chunk_count", "batch_count", "batch_sizes", "parser_calls", F.coalesce("units", F.array().cast("array<struct<nl:string,pln:array<string>>>")).alias("units"))


def answer(goal: Column, proof: Column, status: Column) -> Column:
    """A sentence for a proof; a fixed one without goal or proof, another if the goal was only weakly aligned."""
    return F.when(F.coalesce(goal, F.lit("")) == "", F.lit(NO_GOAL)).when(proof.isNotNull(), F.concat(F.lit("Yes: "), proof)).when(status == "weakly_aligned", F.lit(WEAK)).otherwise(F.lit(NO_PROOF))


def responses(plan: DataFrame, questions: DataFrame, found: DataFrame, fallback: bool = True) -> DataFrame:
    """(question_no, question, original_query, executed_query, fallback_used, query_status, proof, answer) of each question."""
    original = plan.where("rank = 1").select("question_no", F.col("goal").alias("original_query"))
    df = questions.join(original, "question_no", "left").join(P.executed(plan, found, fallback), "question_no", "left")
    df = df.withColumn("fallback_used", F.coalesce(F.col("executed") != F.col("original_query"), F.lit(False)))
    df = df.withColumn("query_status", P.status(F.col("question"), F.col("original_query"), F.col("fallback_used")))
    none = lambda c: F.coalesce(c, F.lit(""))
    return df.select("question_no", "question", none(F.col("original_query")).alias("original_query"), none(F.col("executed")).alias("executed_query"), "fallback_used", "query_status", "proof", answer(F.col("original_query"), F.col("proof"), F.col("query_status")).alias("answer"))


def health(statements: DataFrame, points: DataFrame, background: str, expected: Column, parser: str, last_error: str | None = None) -> DataFrame:
    """One row on sizes and state; statements has source (null for ingested), points too."""
    s = statements.agg(F.count_if(F.col("source").isNull()).alias("atomspace_size"), F.count_if(F.col("source").isNotNull()).alias("background_atomspace_size"))
    p = points.agg(F.count("*").alias("vectordb_count"), F.count_if(F.col("source") == background).alias("vectors_indexed"))
    return s.crossJoin(p).select("*", expected.cast("bigint").alias("vectors_expected"), F.lit(parser).alias("parser"), F.lit(last_error).cast("string").alias("last_error"), F.lit("degraded" if last_error else "ok").alias("status"))


def summary(results: DataFrame) -> DataFrame:
    """(parser, cases, correct, proof_found, no_query, weakly_aligned, fallback_used, avg_latency_seconds, median_latency_seconds) of results with these fields and total_seconds."""
    yes = lambda c: F.count_if(c)
    return results.groupBy("parser").agg(
        F.count("*").alias("cases"), yes(F.col("correct")).alias("correct"), yes(F.col("proof_found")).alias("proof_found"), yes(F.col("query_status") == "no_query").alias("no_query"), yes(F.col("query_status") == "weakly_aligned").alias("weakly_aligned"), yes(F.col("fallback_used")).alias("fallback_used"),
        F.round(F.avg("total_seconds"), 4).alias("avg_latency_seconds"), F.round(F.median("total_seconds"), 4).alias("median_latency_seconds"),
    )


def proof_found(proof: Column) -> Column:
    return F.coalesce(~F.trim(proof).isin("", "[]"), F.lit(False))


def cases(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cases, rejects) from (id, name, category, texts, premises, question, expected_proof): the name from id or question, texts from premises, a category; a case without expectation is rejected."""
    from atomloom.functions import symbols as S

    name = F.coalesce("name", "id", S.slug(F.col("question")))
    df = raw.select(name.alias("name"), F.coalesce("category", F.lit("external")).alias("category"), F.coalesce("texts", "premises", F.array().cast("array<string>")).alias("texts"), "question", "expected_proof")
    return df.where("expected_proof is not null"), df.where("expected_proof is null").select("name", F.concat(F.lit("Case "), "name", F.lit(" is missing expected_proof")).alias("reason"))


def selected(case_table: DataFrame, quick: bool, quick_names: list[str] | None = None, first: int = 3) -> DataFrame:
    """All cases, or the quick ones: those named, else the first few by case_no."""
    if not quick:
        return case_table
    return case_table.where(F.col("name").isin(quick_names)) if quick_names else case_table.orderBy("case_no").limit(first)


def cumulative(results: DataFrame) -> DataFrame:
    """Adds the sizes of the knowledge base before and after each case of a run, from (run_id, case_no, added)."""
    w = Window.partitionBy("run_id").orderBy("case_no")
    after = F.sum("added").over(w)
    return results.withColumn("knowledge_before", after - F.col("added")).withColumn("knowledge_after", after)
