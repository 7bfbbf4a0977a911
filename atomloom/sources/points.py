"""Stored vector points in a folder of Parquet, partitioned by source."""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atomloom.operators import retrieval as R
from atomloom.session import laid, written

NO_SOURCE = "__none__"
SCHEMA = "point_id bigint, nl string, pln array<string>, background boolean, relation string, vector array<float>, source string"


class PointTable:
    """Points with a sentence, its atoms and a vector. The id is a hash of sentence, atoms and source, so writing again adds no other id."""

    def __init__(self, spark: SparkSession, path: str, dimension: int = R.DIMENSION):
        self.spark, self.path, self.dimension = spark, path.rstrip("/"), dimension

    def _hadoop(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def read(self) -> DataFrame:
        fs, p = self._hadoop(self.path)
        if not fs.exists(p):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(self.path).withColumn("source", F.nullif("source", F.lit(NO_SOURCE)))

    def add(self, records: DataFrame, embed=None) -> int:
        """Embeds and stores (nl, pln[, source, background, relation]); returns how many were new. A record that is there already, or stands in records twice, is one point. Vectors must have the length of the table."""
        have = set(records.columns)
        col = lambda n, kind: (F.col(n) if n in have else F.lit(None)).cast(kind).alias(n)
        vector = F.col("vector") if "vector" in have else (embed or (lambda x: R.embed(x, self.dimension)))(F.col("nl"))
        df = records.select("nl", "pln", col("background", "boolean"), col("relation", "string"), F.coalesce(col("source", "string"), F.lit(NO_SOURCE)).alias("source"), vector.alias("vector"))
        checked = F.when(F.size("vector") == self.dimension, F.col("vector").cast("array<float>")).otherwise(F.raise_error(F.lit(f"vectors of this table have {self.dimension} numbers")))
        df = df.withColumn("vector", checked).withColumn("point_id", F.xxhash64("nl", "pln", "source"))
        df = laid(df.select("point_id", "nl", "pln", "background", "relation", "vector", "source").dropDuplicates(["point_id"]), "new-points")
        there = self.read().select("point_id").join(df.select("point_id"), "point_id", "left_semi").distinct()
        new = written(df.join(there, "point_id", "left_anti"), "added-points")
        new.write.mode("append").partitionBy("source").parquet(self.path)
        return new.count()

    def search(self, queries: DataFrame, key: str, vector: str, k: int = R.TOP_K) -> DataFrame:
        return R.top_k(queries.select(F.col(key), F.col(vector).alias("vector")), self.read(), key, "point_id", "vector", k, self.dimension)

    def count(self, source: str | None = None) -> int:
        t = self.read()
        return (t if source is None else t.where(F.col("source") == source)).count()

    def index_state(self, source: str, expected: int) -> str:
        """complete, partial or absent: what is stored of a source against what there should be."""
        n = self.count(source)
        return "complete" if n >= expected > 0 else "partial" if n else "absent"

    def replace_source(self, records: DataFrame, source: str, expected: int, force: bool = False) -> bool:
        """Indexes a source unless it is complete; what is there of it is deleted first. Returns whether it was written."""
        if not force and self.index_state(source, expected) == "complete":
            return False
        self.delete(source)
        self.add(records.withColumn("source", F.lit(source)))
        return True

    def delete(self, source: str) -> None:
        fs, p = self._hadoop(f"{self.path}/source={quote(source, safe=' .-_()')}")
        fs.delete(p, True)

    def drop(self) -> None:
        fs, p = self._hadoop(self.path)
        fs.delete(p, True)
