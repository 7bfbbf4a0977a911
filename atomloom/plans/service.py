"""Queries on ingestion, the state of the knowledge base, benchmark runs and streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from atomloom.operators import chunking as C
from atomloom.operators import runs, service
from atomloom.plans.text import _CHUNKS
from atomloom.session import shared_folder, spread

BACKGROUND = "conceptdump_main"


def _read(spark, folder, name, *columns):
    return spark.read.parquet(f"{folder}/{name}.parquet").select(*columns)


def ingest_result(spark, folder):
    """Chunks and batches of every document as a parser would get them."""
    df = service.sized(spread(_read(spark, folder, "documents", "doc_id", "text")), "doc_id", "text")
    return df.select("doc_id", "chunk_count", "batch_count", F.array_join(F.col("batch_sizes").cast("array<string>"), ",").alias("batch_sizes"), "parser_calls")


def ingest_outcome(spark, folder):
    """Stored item results by the outcome their atoms mean and the one they say."""
    df = _read(spark, folder, "ingest_item_result", "item_id", "atoms", "parser_calls", "status")
    n = F.coalesce(F.size(F.filter("atoms", lambda a: a.rlike(r"\S"))), F.lit(0))
    n = F.when(F.col("atoms").isNull(), 0).otherwise(n)
    calls = F.coalesce("parser_calls", F.lit(0))
    o = service.outcome(calls, F.when(n == 0, calls).otherwise(F.lit(0)), n)
    return df.groupBy(o["status"].alias("outcome"), F.lower("status").alias("stated")).agg(F.count("*").alias("items"), F.sum(n).alias("atoms"))


def health_row(spark, folder):
    expected = F.lit(_read(spark, folder, "vector_payload", "background").where("background").count())
    return service.health(_read(spark, folder, "statement_log", "source", "deleted_at").where("deleted_at is null"), _read(spark, folder, "vector_payload", "source"), BACKGROUND, expected, "template")


def bench_summary(spark, folder):
    """The summary of a benchmark, over events as results: the type as parser, the value as seconds."""
    e = _read(spark, folder, "events", "event_id", "user_id", "event_type", "value")
    status = F.when(F.col("user_id") % 7 == 0, "no_query").when(F.col("user_id") % 5 == 0, "weakly_aligned").otherwise("well_aligned")
    df = e.select(F.col("event_type").alias("parser"), (F.col("user_id") % 2 == 0).alias("correct"), (F.col("user_id") % 3 == 0).alias("proof_found"), status.alias("query_status"), (F.col("event_id") % 11 == 0).alias("fallback_used"), F.col("value").alias("total_seconds"))
    return service.summary(df)


def bench_cumulative(spark, folder):
    """The size of the knowledge base before and after each case of a cumulative run: items of a request as cases."""
    i = _read(spark, folder, "ingest_item_result", F.col("request_id").alias("run_id"), F.col("item_id").alias("case_no"), "atoms")
    return service.cumulative(i.select("run_id", "case_no", F.when(F.col("atoms").isNull(), 0).otherwise(F.size("atoms")).cast("bigint").alias("added")))


def bench_run(spark, folder):
    """Our own suite, isolated and cumulative."""
    both = runs.run(spark, runs.CASES).unionByName(runs.run(spark, runs.CASES, mode="cumulative"))
    return both.drop("total_seconds")


def bench_smoke(spark, folder):
    """The built-in suite through three parsers: each case proved or not as it should be."""
    return runs.compared(spark, runs.SMOKE, ["template", "canonical", "extraction"]).select("case_name", "category", "parser", "proof_found", "correct")


def stream_ingest(spark, folder):
    """All request texts through the streaming job: the statements in the knowledge base when all input has been taken."""
    from atomloom.streaming import ingest

    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    _read(spark, folder, "ingest_request", F.col("request_id").alias("doc_id"), F.array_join("texts", " ").alias("text")).write.parquet(f"{base}/in")
    ingest.start(spark, f"{base}/in", f"{base}/kb", f"{base}/checkpoint", "doc_id bigint, text string").awaitTermination()
    return ingest.StatementTable(spark, f"{base}/kb").read().select("raw")


QUERIES = {f.__name__: f for f in (ingest_result, ingest_outcome, health_row, bench_summary, bench_cumulative, bench_run, bench_smoke, stream_ingest)}

SQL = {
    "bench_smoke": f"""select case_name, category, parser, expected proof_found, true correct from (values {', '.join(f"('{c[0]}', '{c[1]}', {c[4]})" for c in runs.SMOKE)}) c(case_name, category, expected), (values ('template'), ('canonical'), ('extraction')) p(parser)""",
    "ingest_result": f"""{_CHUNKS}, n as (select doc_id, row_number() over (partition by doc_id order by chunk_no, n) - 1 k, length(chunk) c from e where chunk <> ''),
        r as (select doc_id, k, 0 b, 1 m, c from n where k = 0 union all select n.doc_id, n.k, case when r.m >= {C.MOST_SENTENCES} or r.c + 1 + n.c > {C.MOST_CHARS} then b + 1 else b end, case when r.m >= {C.MOST_SENTENCES} or r.c + 1 + n.c > {C.MOST_CHARS} then 1 else r.m + 1 end,
            case when r.m >= {C.MOST_SENTENCES} or r.c + 1 + n.c > {C.MOST_CHARS} then n.c else r.c + 1 + n.c end from r join n on n.doc_id = r.doc_id and n.k = r.k + 1),
        gg as (select doc_id, b, count(*) z from r group by all), ss as (select doc_id, sum(z)::integer chunk_count, count(*)::integer batch_count, string_agg(z::varchar, ',' order by b) batch_sizes from gg group by 1)
        select doc_id, coalesce(chunk_count, 0)::integer chunk_count, coalesce(batch_count, 0)::integer batch_count, coalesce(batch_sizes, '') batch_sizes, coalesce(batch_count, 0)::integer parser_calls from documents left join ss using (doc_id)""",
    "ingest_outcome": r"""with t as (select status, coalesce(parser_calls, 0) p, coalesce(len(list_filter(atoms, lambda a: regexp_matches(a, '\S'))), 0) n from ingest_item_result)
        select case when p > 0 and n = 0 then 'failed' else 'success' end outcome, lower(status) stated, count(*) items, sum(n)::bigint atoms from t group by all""",
    "health_row": f"""select (select count(*) from statement_log where deleted_at is null and source is null) atomspace_size, (select count(*) from statement_log where deleted_at is null and source is not null) background_atomspace_size, count(*) vectordb_count,
        count(*) filter (source = '{BACKGROUND}') vectors_indexed, count(*) filter (background) vectors_expected, 'template' parser, null::varchar last_error, 'ok' status from vector_payload""",
    "bench_summary": """select event_type parser, count(*) cases, count(*) filter (user_id % 2 = 0) correct, count(*) filter (user_id % 3 = 0) proof_found, count(*) filter (user_id % 7 = 0) no_query, count(*) filter (user_id % 7 <> 0 and user_id % 5 = 0) weakly_aligned,
        count(*) filter (event_id % 11 = 0) fallback_used, round(avg(value), 4) avg_latency_seconds, round(median(value), 4) median_latency_seconds from events group by 1""",
    "bench_cumulative": "with t as (select request_id run_id, item_id case_no, coalesce(len(atoms), 0)::bigint added from ingest_item_result), s as (select *, sum(added) over (partition by run_id order by case_no)::bigint knowledge_after from t) select run_id, case_no, added, knowledge_after - added knowledge_before, knowledge_after from s",
}
