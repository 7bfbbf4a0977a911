"""Problem 4: records that differ only in formatting, by hashing from the leaves up."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atomloom.session import written

#: Rows of one digest are spread over so many join keys, since one group of copies can hold any share of the rows.
SALTS = 8


def plain(x: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]+", "")


def leaves(items: Column) -> Column:
    """The plain forms of the elements that are not null, empty or blank, sorted: the order of the list carries no meaning."""
    return F.array_sort(F.transform(F.filter(items, lambda x: x.rlike(r"[^\s\p{Z}\p{Cc}]")), plain))


def records(df: DataFrame, name: str, key: str, items: str) -> DataFrame:
    """(rec_table, id, leaves) of the rows with at least one element."""
    return df.select(F.lit(name).alias("rec_table"), F.col(key).cast("bigint").alias("id"), leaves(F.col(items)).alias("leaves")).where(F.size("leaves") > 0)


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def copies(recs: DataFrame) -> DataFrame:
    """(rec_table, id_a, id_b): for each record that is not the first of its set, the smallest id of the set and its own.

    recs is (rec_table, id, leaves) as records() gives it; ids are unique within a table. The digest of a leaf is a
    hash of its plain form, that of a record the hash of its leaves' digests in sorted order; records that agree in
    the digest are then compared in full. Records whose digest agrees but not their leaves are grouped by the leaves
    themselves. Empty tables give no rows.

    Only (digest, id) is aggregated, combined before the shuffle; leaves are shuffled for the comparison.
    """
    digest = F.xxhash64(F.array_sort(F.transform("leaves", lambda x: F.xxhash64(x))))
    rooted = recs.withColumn("root", digest).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    groups = rooted.groupBy("rec_table", "root").agg(F.min("id").alias("id_a"), F.count("*").alias("n")).where("n > 1").drop("n")
    salted = groups.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    members = written(rooted.join(salted, ["rec_table", "root", "salt"]), "copy-candidates")
    first = members.where("id = id_a").select("rec_table", "root", F.col("leaves").alias("whole")).withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    compared = members.where("id <> id_a").join(first, ["rec_table", "root", "salt"]).withColumn("same", F.col("leaves") == F.col("whole"))
    compared = written(compared.select("rec_table", "id_a", "id", "same", F.when(~F.col("same"), F.col("leaves")).alias("leaves")), "copies-compared")
    apart = compared.where(~F.col("same"))
    regrouped = apart.groupBy("rec_table", "leaves").agg(F.min("id").alias("least")).join(apart, ["rec_table", "leaves"]).where("id > least")
    return compared.where("same").select("rec_table", "id_a", F.col("id").alias("id_b")).unionByName(regrouped.select("rec_table", F.col("least").alias("id_a"), F.col("id").alias("id_b")))


def collapsed(recs: DataFrame) -> DataFrame:
    """(rec_table, id, copies): one row for each set of copies and each single record, by the smallest id."""
    gone = written(copies(recs), "copies")
    more = gone.groupBy("rec_table", F.col("id_a").alias("id")).agg(F.count("*").alias("more"))
    kept = recs.select("rec_table", "id").join(gone.select("rec_table", F.col("id_b").alias("id")), ["rec_table", "id"], "left_anti")
    return kept.join(more, ["rec_table", "id"], "left").select("rec_table", "id", (F.coalesce("more", F.lit(0)) + 1).alias("copies"))
