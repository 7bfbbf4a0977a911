"""Queries on bulk background knowledge."""

from __future__ import annotations

from pyspark.sql import functions as F

from atomloom.operators import background as B
from atomloom.plans import facts as K

PERCENT = 10.0


def kb_assertions(spark, folder):
    """Assertions that pass the filters, with predicate, concepts and weight."""
    return B.eligible(K.assertions(spark, folder))


def stv_weight(spark, folder):
    df = B.eligible(K.assertions(spark, folder))
    return df.select("line_no", F.format_number(B.confidence(F.col("weight")), 4).alias("confidence"))


def seeded_sample(spark, folder):
    return B.sampled(B.eligible(K.assertions(spark, folder)), PERCENT, B.SEED).select("line_no", "predicate", "source", "target", B.unit_score(F.col("predicate"), F.col("source"), F.col("target"), B.SEED).alias("score"))


def dedup_first(spark, folder):
    return B.first_eligible(K.assertions(spark, folder))


def kb_statements(spark, folder):
    return K.triples(spark, folder)


def relation_counts(spark, folder):
    return B.relation_counts(K.triples(spark, folder))


def kb_counts(spark, folder):
    return B.counts(K.assertions(spark, folder), percent=PERCENT)


def kb_manifest(spark, folder):
    return B.manifest(K.assertions(spark, folder), "assertions")


QUERIES = {f.__name__: f for f in (kb_assertions, stv_weight, seeded_sample, dedup_first, kb_statements, relation_counts, kb_counts, kb_manifest)}

_F = K.sql()
_score = f"('0x' || left(sha256('{B.SEED}|' || predicate || '|' || source || '|' || target), 16))::ubigint::double / 18446744073709551616.0"
_sum = lambda c: f"cast(sum(('0x' || left(sha256({c}), 15))::bigint::hugeint) as varchar)"
SQL = {
    "kb_assertions": f"with {_F} select * from fit",
    "stv_weight": f"with {_F} select line_no, printf('%.4f', least(weight / (weight + {B.WEIGHT_HALF}), {B.MOST_CONFIDENCE})) confidence from fit",
    "seeded_sample": f"with {_F} select line_no, predicate, source, target, {_score} score from fit where {_score} < {PERCENT / 100}",
    "dedup_first": f"with {_F} select * from first_",
    "kb_statements": f"with {_F} select * from atom",
    "relation_counts": f"with {_F} select predicate relation, count(*) n from stm group by 1",
    "kb_counts": f"with {_F} select (select count(*) from rows_) scanned, count(*) eligible, count(*) filter ({_score} < {PERCENT / 100}) sampled, count(distinct (predicate, source, target)) filter ({_score} < {PERCENT / 100}) deduped from fit",
    "kb_manifest": f"""with {_F}, c as (select predicate, count(*) n from stm group by 1)
        select 'assertions' source_file, {B.NORMALIZATION_VERSION} normalization_version, {B.LEAST_WEIGHT}::double min_weight, {B.PERCENT}::double coverage_percent, {B.SEED} sample_seed, 0 max_rows, (select count(*) from rows_) scanned, (select count(*) from fit) eligible, (select count(*) from fit) sampled,
        (select count(*) from first_) deduped, (select count(*) from stm) atom_count, (select string_agg(predicate || '=' || n, ',' order by predicate) from c) relation_counts, (select {_sum('atom')} from atom) atom_checksum, (select {_sum('nl')} from atom) payload_checksum""",
}
