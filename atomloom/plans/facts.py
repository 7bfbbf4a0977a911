"""The fact base the queries on knowledge work on: assertions projected from the tables of trade, and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atomloom.operators import background as B
from atomloom.session import spread, written

KIND = 1_000_000_000_000
#: kind number: (relation, start, end, weight key, table) as SQL expressions that Spark and DuckDB read alike.
SOURCES = {
    1: ("/r/PartOf", "n_name", "r_name", "n_nationkey", "nation join region on n_regionkey = r_regionkey"),
    2: ("/r/AtLocation", "c_name", "n_name", "c_custkey", "customer join nation on c_nationkey = n_nationkey"),
    3: ("/r/AtLocation", "s_name", "n_name", "s_suppkey", "supplier join nation on s_nationkey = n_nationkey"),
    4: ("/r/IsA", "p_name", "p_type", "p_partkey", "part"),
    5: ("/r/HasProperty", "p_name", "p_type", "p_partkey + 7", "part"),
    6: ("/r/MadeOf", "p_name", "p_brand", "p_partkey", "part"),
    7: ("/r/RelatedTo", "p_name", "p_brand", "p_partkey", "part"),
    8: ("/r/AtLocation", "p_name", "s_name", "l_orderkey", "lineitem join part on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey"),
}
_UNIQUE = {8: "l_orderkey * 8 + l_linenumber"}


def _select(k: int) -> str:
    relation, start, end, key, table = SOURCES[k]
    lang = f"case when {key} % 97 = 5 then '/c/de/' else '/c/en/' end"
    meta = f"""case when {key} % 31 = 3 then '{{"dataset": 1}}' when {key} % 37 = 4 then 'oops' when {key} % 41 = 6 then null else concat('{{"weight": ', cast(({key} % 40) * 0.5 as double), '}}') end"""
    return f"select {k} * {KIND} + {_UNIQUE.get(k, key)} line_no, '{relation}' relation, concat({lang}, {start}, '/n') as start, concat('/c/en/', {end}) as \"end\", {meta} metadata from {table}"


def assertions(spark: SparkSession, folder: str, heads: tuple[str, ...] | None = None) -> DataFrame:
    """(line_no, relation, start, end, metadata): some without or with malformed weight, some of another language or relation; with heads, of the relations that become these alone."""
    kinds = [k for k in SOURCES if heads is None or B.RELATIONS.get(SOURCES[k][0]) in heads]
    names = [n for n in ("nation", "region", "customer", "supplier", "part", "lineitem") if any(n in SOURCES[k][4] for k in kinds)]
    tables = {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}
    if "lineitem" in tables:
        tables["lineitem"] = spread(tables["lineitem"].select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    out = None
    for k in kinds:
        text = _select(k).replace('"end"', "`end`").replace("{", "{{").replace("}", "}}")
        for n in names:
            text = text.replace(f"from {n}", f"from {{{n}}}").replace(f"join {n} ", f"join {{{n}}} ")
        part = spark.sql(text, **{n: t for n, t in tables.items() if f"{{{n}}}" in text})
        out = part if out is None else out.unionByName(part)
    return out.select(F.col("line_no").cast("bigint"), "relation", "start", "end", "metadata")


def triples(spark: SparkSession, folder: str, heads: tuple[str, ...] | None = None) -> DataFrame:
    """The statements of all eligible assertions, each triple once."""
    return B.statements(B.first_eligible(assertions(spark, folder, heads)))


def facts(spark: SparkSession, folder: str, heads: tuple[str, ...] | None = None) -> DataFrame:
    """(seq, head, subject, object, strength, confidence, stmt_id, raw): the triples as facts; those with one of the heads, if given."""
    c = F.col("confidence").cast("double")
    return triples(spark, folder, heads).select(F.col("line_no").alias("seq"), F.col("predicate").alias("head"), F.col("source").alias("subject"), F.col("target").alias("object"), F.lit(1.0).alias("strength"), c.alias("confidence"), "stmt_id", F.col("atom").alias("raw"))


def stored_facts(spark: SparkSession, folder: str, heads: tuple[str, ...] | None = None, columns: tuple[str, ...] = ("head", "subject", "object", "strength", "confidence", "stmt_id")) -> DataFrame:
    """The facts as a written table, for queries that read them several times: no more heads and columns than they read."""
    return written(facts(spark, folder, heads).select(*columns), "fact-base")


def sql() -> str:
    """CTEs rows_, fit, first_, stm and fact for DuckDB."""
    from atomloom.functions import sql as Q

    concept = lambda c: f"case when starts_with({c}, '/c/en/') then {Q.canonical(f'split_part({c}[7:], chr(47), 1)')} end"
    pred = " ".join(f"when '{k}' then '{v}'" for k, v in B.RELATIONS.items())
    mid = " ".join(f"when '{k}' then '{v}'" for k, v in B.TEMPLATES.items())
    weight = """case when metadata is null or not json_valid(metadata) then null when json_exists(metadata, '$.weight') then try_cast(json_extract_string(metadata, '$.weight') as double) else 1.0 end"""
    return f"""rows_ as ({' union all '.join(_select(k) for k in SOURCES)}),
    fit0 as (select line_no, relation, case relation {pred} end predicate, {concept('start')} source, {concept('"end"')} target, {weight} weight from rows_),
    fit as (select * from fit0 where predicate is not null and source <> '' and target <> '' and weight >= {B.LEAST_WEIGHT}),
    first_ as (select * from fit qualify row_number() over (partition by predicate, source, target order by line_no) = 1),
    stm as (select line_no, predicate, source, target, 'cnet_' || lower(predicate) || '_' || left(md5(predicate || '|' || source || '|' || target), 10) stmt_id, printf('%.4f', least(weight / (weight + {B.WEIGHT_HALF}), {B.MOST_CONFIDENCE})) confidence,
        case when relation = '{B.PROPERTY}' then source || ' is ' || target else replace(source, '_', ' ') || case predicate {mid} end || replace(target, '_', ' ') end nl from first_),
    atom as (select *, '(: ' || stmt_id || ' (' || predicate || ' ' || source || ' ' || target || ') (STV 1.0 ' || confidence || '))' atom from stm),
    fact as (select line_no seq, predicate head, source subject, target as object, 1.0::double strength, confidence::double confidence, atom raw from atom)"""
