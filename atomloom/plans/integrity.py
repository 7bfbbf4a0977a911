"""Queries on references between the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from atomloom.operators import orphans as O


def _found(spark: SparkSession, folder: str) -> DataFrame:
    read = lambda name: spark.read.parquet(f"{folder}/{name}.parquet")
    points, log, sources = read("vector_payload"), read("statement_log"), read("kb_source")
    refs = O.references(points, "vector_payload", "point_id", "stored_at", "source", "pln").unionByName(O.references(log, "statement_log", "stmt_no", "stored_at", "source"))
    lived = O.targets(log, "statement", "stmt_id", "stored_at", "deleted_at").unionByName(O.targets(sources, "source", "source", "loaded_at", "removed_at"))
    return O.orphans(refs, lived)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _found(spark, folder).select("ref_table", "row_id", "ref_field", "ref_no")


def p3_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Orphan references by table and month."""
    return O.counted(_found(spark, folder))


QUERIES = {f.__name__: f for f in (p3_found, p3_counts)}

_P = lambda x: rf"regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}]+', '', 'g')"
_FOUND = rf"""
    r as (
        select 'vector_payload' ref_table, point_id row_id, 'source' ref_field, 0 ref_no, 'source' kind, {_P('source')} k, stored_at t from vector_payload where regexp_matches(source, '[^\s\p{{Z}}\p{{Cc}}]')
        union all select 'statement_log', stmt_no, 'source', 0, 'source', {_P('source')}, stored_at from statement_log where regexp_matches(source, '[^\s\p{{Z}}\p{{Cc}}]')
        union all select 'vector_payload', point_id, 'pln', cast(i - 1 as integer), 'statement', {_P(r"regexp_extract(pln[i], '^[^:]*:[\s\p{Z}]*([^\s\p{Z}()]+)', 1)")}, stored_at
            from (select point_id, stored_at, pln, unnest(range(1, len(pln) + 1)) i from vector_payload) where regexp_matches(pln[i], '[^\s\p{{Z}}\p{{Cc}}]')),
    l as (select 'statement' kind, {_P('stmt_id')} k, stored_at since, deleted_at until from statement_log union all select 'source', {_P('source')}, loaded_at, removed_at from kb_source),
    f as (select * from r where not exists (select 1 from l where l.kind = r.kind and l.k = r.k and l.k <> '' and l.since <= r.t and (l.until is null or l.until > r.t)))"""
SQL = {
    "p3_found": f"with {_FOUND} select ref_table, row_id, ref_field, ref_no from f",
    "p3_counts": f"with {_FOUND} select ref_table, ref_field, strftime(t, '%Y-%m') period, count(*) orphans from f group by all",
}
