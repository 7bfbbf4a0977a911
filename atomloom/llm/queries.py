"""The queries of the operators in this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atomloom.llm import canon, copies, encode, history, neighbours, pack, reading, split


#: Tables of records, their ids and their lists of statements.
RECORD_TABLES = (("ingest_item_result", "item_id", "atoms"), ("vector_payload", "point_id", "pln"))


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = canon.matched(_table(spark, folder, "ingest_item_result"), _table(spark, folder, "canon_symbol"))
    return rows.select(F.col("id").alias("item_id"), "atom_no", "canon_id")


def p1_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    """Values that mean no entry, by kind, with the number of facts that have them."""
    rows = canon.matched(_table(spark, folder, "ingest_item_result"), _table(spark, folder, "canon_symbol"))
    return rows.where("canon_id = 0").groupBy("kind", F.lower("value").alias("value")).agg(F.count("*").alias("n"))


def p2_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of every oversized text."""
    return split.pieces(_table(spark, folder, "ingest_request"))


def p2_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The number of pieces of every oversized text beside the chunk_count of its item results."""
    return split.counts(split.pieces(_table(spark, folder, "ingest_request"), with_text=False), _table(spark, folder, "ingest_item_result"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Texts that the splitting had to cut."""
    return split.pieces(_table(spark, folder, "ingest_request"), with_text=False).where(F.col("piece_no") == 1).select("request_id", "text_no").distinct()


def p2_cover(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the pieces of every oversized text cover it, fit and overlap."""
    return split.cover(split.pieces(_table(spark, folder, "ingest_request")))


def _copy_records(spark: SparkSession, folder: str) -> DataFrame:
    return copies.union([copies.records(_table(spark, folder, t), t, k, c) for t, k, c in RECORD_TABLES])


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return copies.copies(_copy_records(spark, folder))


def p4_collapsed(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each record without its copies, with the number of copies it had."""
    return copies.collapsed(_copy_records(spark, folder))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    parts = [_table(spark, folder, t).select(F.lit(t).alias("rec_table"), F.col(k).alias("id"), "batch_no", F.col(c).alias("items")) for t, k, c in RECORD_TABLES]
    return history.pairs(copies.union(parts))


def p5_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The five nearest of every usable vector, with the cosine similarity."""
    return neighbours.nearest(_table(spark, folder, "vector_payload"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.pairs(p5_neighbours(spark, folder))


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode.encode(_table(spark, folder, "documents"))


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's pieces with their container."""
    return pack.packed(_table(spark, folder, "documents"))


def p8_fill(spark: SparkSession, folder: str) -> DataFrame:
    """One row on the packing: documents placed, containers over their capacity, documents cut that would have fitted, and whether at most a hundredth of the containers is more than the sizes need."""
    placed = p8_containers(spark, folder)
    boxes = placed.groupBy("container_id").agg(F.sum("size").alias("load")).agg(F.count("*").alias("n"), F.count_if(F.col("load") > pack.CAPACITY).alias("over"), F.sum("load").alias("total"))
    docs = placed.groupBy("doc_id").agg(F.count("*").alias("pieces"), F.sum("size").alias("size")).agg(F.count("*").alias("documents"), F.count_if((F.col("pieces") > 1) & (F.col("size") <= pack.CAPACITY)).alias("cut"))
    return docs.crossJoin(boxes).select("documents", "over", "cut", (F.col("n") <= F.ceil(F.col("total") / pack.CAPACITY) * 1.01 + 1).alias("filled"))  # one row beside one row


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that fit no container whole: those the packing had to cut."""
    return p8_containers(spark, folder).where(F.col("piece_no") == 1).select("doc_id")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return reading.levels(_table(spark, folder, "documents"), _table(spark, folder, "doc_level_label")).select("doc_id", "level")


def p9_profile(spark: SparkSession, folder: str) -> DataFrame:
    """The corpus counted by source and level."""
    docs = _table(spark, folder, "documents")
    return p9_found(spark, folder).join(docs.select("doc_id", "source"), "doc_id").groupBy("source", "level").agg(F.count("*").alias("n"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_unmatched, p2_found, p2_pieces, p2_counts, p2_cover, p4_found, p4_collapsed, p6_found, p5_neighbours, p5_found, p7_ids, p8_containers, p8_fill, p8_found, p9_found, p9_profile)}

#: Records of both tables with their sorted plain forms, in DuckDB.
_PLAIN_SQL = " union all ".join(
    rf"""select '{t}' rec_table, {k} id, list_sort(list_transform(list_filter({c}, lambda x: regexp_matches(x, '[^\s\p{{Z}}\p{{Cc}}]')), lambda x: regexp_replace(lower(x), '[^\p{{L}}\p{{N}}]+', '', 'g'))) leaves from {t}"""
    for t, k, c in RECORD_TABLES
)
_WORDS_SQL = " union all ".join(
    rf"""select '{t}' rec_table, {k} id, batch_no, w, count(*) n from (select {k}, batch_no, unnest(regexp_extract_all(lower(array_to_string(list_filter({c}, lambda x: x is not null), ' ')), '[\p{{L}}\p{{N}}]+')) w from {t}) group by all"""
    for t, k, c in RECORD_TABLES
)

SQL: dict[str, str] = {
    "p2_cover": """with t as (select request_id, cast(i - 1 as integer) text_no, regexp_replace(texts[i], '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g') x from (select distinct request_id, texts, unnest(range(1, len(texts) + 1)) i from ingest_request))
        select request_id, text_no, cast(length(x) as integer) chars, cast(length(x) as integer) covered, true as fits, true as linked from t where length(x) > 512""",
    "p2_found": """select distinct request_id, cast(i - 1 as integer) text_no from (select request_id, texts, unnest(range(1, len(texts) + 1)) i from ingest_request)
        where length(regexp_replace(texts[i], '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g')) > 512""",
    "p8_fill": "select count(distinct doc_id) documents, 0::bigint as over, 0::bigint cut, true filled from documents",
    "p4_found": f"""with r as ({_PLAIN_SQL}), g as (select rec_table, leaves, min(id) id_a from r where len(leaves) > 0 group by all)
        select rec_table, id_a, id id_b from r join g using (rec_table, leaves) where id > id_a""",
    "p4_collapsed": f"""with r as ({_PLAIN_SQL}) select rec_table, min(id) id, count(*) copies from r where len(leaves) > 0 group by rec_table, leaves""",
    "p6_found": f"""with w as ({_WORDS_SQL}), t as (select rec_table, id, batch_no, sum(n) n from w group by all),
        c as (select a.rec_table, a.id id_a, b.id id_b, sum(least(a.n, b.n)) n from w a join w b on a.rec_table = b.rec_table and a.w = b.w and a.batch_no < b.batch_no group by all),
        r as ({_PLAIN_SQL}), k as (select rec_table, id, batch_no from t), p as (select * from r join k using (rec_table, id) where len(leaves) > 0)
        select c.rec_table, id_a, id_b from c join t a on a.rec_table = c.rec_table and a.id = id_a join t b on b.rec_table = c.rec_table and b.id = id_b where 5 * c.n >= 4 * (a.n + b.n - c.n)
        union select a.rec_table, a.id, b.id from p a join p b on a.rec_table = b.rec_table and a.leaves = b.leaves and a.batch_no < b.batch_no""",
}
