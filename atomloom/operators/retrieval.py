"""Retrieval: embeddings, most similar points of a query set, context for a parser, sources of proofs."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOP_K, CONTEXT_ATOMS, LEAST_SCORE = 10, 50, 0.6
DIMENSION = 64
#: Queries of one block, which is sent to all executors; a larger set is searched block by block.
MOST_QUERIES = 50_000


def embed(text: Column, dimension: int = DIMENSION) -> Column:
    """Hashed word features of unit length, array<float>; zeros for null and empty texts. Stands where a model would."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        def one(t):
            v = np.zeros(dimension, np.float32)
            for w in re.findall(r"[^\W_]+", (t or "").lower()):
                h = zlib.crc32(w.encode())
                v[h % dimension] += 1 if h & 0x10000 else -1
            n = np.linalg.norm(v)
            return v / n if n else v

        return texts.map(one)

    return run(text)


def _unit(column: pa.Array, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows with a usable vector and these vectors with length one."""
    sizes = np.where(np.asarray(column.is_null()), -1, np.diff(column.offsets.to_numpy()))
    rows = np.flatnonzero(sizes == dimension)
    flat = column.values.to_numpy(zero_copy_only=False).astype(float)
    x = flat[column.offsets.to_numpy()[rows][:, None] + np.arange(dimension)] if len(rows) else np.zeros((0, dimension))
    with np.errstate(invalid="ignore", over="ignore"):
        n = np.linalg.norm(x, axis=1)
        fine = np.isfinite(n) & (n > 0)
    return rows[fine], x[fine] / n[fine, None]


def top_k(queries: DataFrame, points: DataFrame, query_key: str, key: str, vector: str, k: int = TOP_K, dimension: int | None = None) -> DataFrame:
    """(query_id, rank int, id, score double): for each query the k points with the highest cosine similarity, ties by id.

    queries (query_key, vector) is a stated set, sent out in blocks of MOST_QUERIES; every batch of points keeps its own k best for each query, so only those are shuffled. Vectors that are null, of
    another length than the queries', not finite or all zero are in no result, nor are rows with a null id.
    """
    asked = queries.select(F.col(query_key).cast("bigint"), F.col(vector).cast("array<double>"))
    n = asked.count()
    if n > MOST_QUERIES:
        blocks = -(-n * 5 // (MOST_QUERIES * 4))
        block = F.pmod(F.xxhash64(query_key, F.lit(3)), F.lit(blocks))
        out = None
        for i in range(blocks):
            one = top_k(queries.where(block == i), points, query_key, key, vector, k, dimension)
            out = one if out is None else out.unionByName(one)
        return out
    asked = asked.toArrow()
    vectors = asked.column(1).combine_chunks()
    if dimension is None:
        sizes = [len(v) for v in vectors.to_pylist() if v is not None]
        dimension = max(set(sizes), key=sizes.count) if sizes else 0
    rows, q = _unit(vectors, dimension)
    shared = points.sparkSession.sparkContext.broadcast((asked.column(0).to_numpy()[rows] if len(rows) else np.zeros(0, np.int64), q))

    def run(batches):
        names = ["query_id", "id", "score"]
        for batch in batches:
            ids, q = shared.value
            rows, x = _unit(batch.column(1), dimension)
            if not len(rows) or not len(ids):
                continue
            own = batch.column(0).to_numpy()[rows]
            best = min(k, len(rows))
            for a in range(0, len(ids), 1024):
                s = q[a : a + 1024] @ x.T
                # ties at the border of the k best are kept: the exact order is made after the shuffle
                least = -np.partition(-s, best - 1, axis=1)[:, best - 1]
                i, j = np.nonzero(s >= least[:, None] - 1e-12)
                yield pa.RecordBatch.from_arrays([pa.array(ids[a : a + 1024][i]), pa.array(own[j]), pa.array(s[i, j])], names=names)

    found = points.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint"), F.col(vector).cast("array<double>")).mapInArrow(run, "query_id bigint, id bigint, score double")
    from pyspark.sql import Window

    ranked = found.withColumn("score", F.round("score", 9)).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def payload_atoms(hits: DataFrame, points: DataFrame, key: str, pln: str) -> DataFrame:
    """(query_id, rank, pos int, atom): the atoms of the points found, in rank order, not deduplicated."""
    return hits.join(points.select(F.col(key).alias("id"), pln), "id").select("query_id", "rank", F.posexplode(pln).alias("pos", "atom"))


def last_lines(kb: DataFrame, most: int = CONTEXT_ATOMS) -> list[str]:
    """The last `most` distinct lines of (seq, atom), blank ones left out, in the order in which each came first.

    The newest rows are taken, then it is looked up whether they stood there before: nothing but them is aggregated.
    If too few are left, more are taken.
    """
    kb = kb.select("seq", F.regexp_replace("atom", r"^\s+|\s+$", "").alias("atom")).where("atom <> ''")
    n = 4 * most
    while True:
        newest = kb.orderBy(F.desc("seq")).limit(n)
        edge = newest.agg(F.min("seq"), F.count("*")).first()
        if not edge[1]:
            return []
        first = kb.join(F.broadcast(newest.select("atom").distinct()), "atom").groupBy("atom").agg(F.min("seq").alias("seq")).where(F.col("seq") >= edge[0])
        rows = first.orderBy(F.desc("seq"), F.desc("atom")).limit(most).collect()
        if len(rows) == most or edge[1] < n:
            return [r.atom for r in reversed(rows)]
        n *= 8


def enriched(kb: DataFrame, retrieved: DataFrame, most: int = CONTEXT_ATOMS) -> DataFrame:
    """(place int, atom): KB lines by seq, then retrieved atoms by seq, the first of equal ones kept, the last `most` of all.

    Both are (seq, atom). A retrieved atom that is in the KB keeps its old place there and can so be cut.
    """
    from pyspark.sql import Window

    spark = kb.sparkSession
    stripped = kb.select(F.regexp_replace("atom", r"^\s+|\s+$", "").alias("atom"))
    new = retrieved.where("atom is not null").groupBy("atom").agg(F.min("seq").alias("seq")).join(stripped, "atom", "left_anti")
    lines = spark.createDataFrame(list(enumerate(last_lines(kb, most))), "seq bigint, atom string").select(F.lit(0).alias("tier"), "seq", "atom")
    last = lines.unionByName(new.select(F.lit(1).alias("tier"), "seq", "atom")).orderBy(F.desc("tier"), F.desc("seq"), F.desc("atom")).limit(most)  # a bounded number of rows from here on
    return last.select((F.row_number().over(Window.orderBy("tier", "seq", "atom")) - 1).alias("place"), "atom")


def proof_fragments(proof: Column) -> Column:
    """Innermost parenthesised groups without a truth value and of five characters or more, each once."""
    return F.array_distinct(F.filter(F.regexp_extract_all(proof, F.lit(r"\([^()]+?\)"), F.lit(0)), lambda g: ~F.contains(g, F.lit("STV")) & (F.length(g) >= 5)))


def sources(hits: DataFrame, points: DataFrame, key: str, nl: str, least: float = LEAST_SCORE) -> DataFrame:
    """(nl): the distinct sentences of best hits whose score is above `least`; empty ones are none."""
    best = hits.where((F.col("rank") == 1) & (F.col("score") > least))
    return best.join(points.select(F.col(key).alias("id"), F.col(nl).alias("nl")), "id").where("nl <> ''").select("nl").distinct()


def count_by_source(points: DataFrame, source: str) -> DataFrame:
    return points.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("n"))
