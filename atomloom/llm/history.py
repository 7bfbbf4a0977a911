"""Problem 6: new batches against all history, by a persistent table from words to records.

A posting leads from an occurrence of a word to sets of words; sets that share one among their rarest are compared by
what they have in common, counted over all words. If two sets have four fifths of all words in common, these are at
least a = ceil(4/9 (m + n)) of their m and n, so in any order that is the same for all sets they share one of the
first m - a + 1 and n - a + 1 of each: no pair is lost, whatever was edited where. How rare a word is comes from
counters over the history; it decides the work only. Chunks of several words have no such bound, since an edit breaks
all chunks it touches.

Index keeps postings, sets and records in a folder and takes one batch after another; `pairs` runs a table through it.
"""

from __future__ import annotations

import json
import zlib
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atomloom.llm import chunks as C
from atomloom.session import laid, scratch, temporary, together, written

#: Counters: one for each so many occurrences of words in the history, within these limits.
WORDS_EACH, LEAST_COUNTERS, MOST_COUNTERS = 4, 1 << 16, 1 << 23
MERGES = 8
#: Postings a bucket should get: their number follows the history, so what a small batch reads of it doesn't grow.
BUCKET_ROWS = 1 << 18
#: The history is counted and laid into buckets anew when it has grown by this factor.
RENEWED_AT = 2
#: Common words against all words of both, as a fraction: 4/5.
NUMERATOR, DENOMINATOR = 4, 5
SIGNATURE = "rec_table string, id bigint, batch_no int, root_a bigint, root_b bigint, bag bigint, words int, occurrences array<bigint>"
#: Tables of the index. members has two rows for a record: by its words (is_bag) and by its plain forms, with the hash of the other in `other`.
TABLES = {"postings": "key bigint, bag bigint, words int, reach int", "sets": "bag bigint, words int, occurrences array<bigint>", "members": "k bigint, l bigint, is_bag boolean, other bigint, rec_table string, id bigint, batch_no int"}
BUCKETED_BY = {"postings": "key", "sets": "bag", "members": "k"}


def _seeds(tables: list[str]) -> np.ndarray:
    """A number for each table name, folded into hashes so that those of different tables never meet."""
    known = {t: np.uint64(xxhash.xxh3_64_intdigest(t)) for t in set(tables)}
    return np.array([known[t] for t in tables], np.uint64)


def signatures(recs: DataFrame) -> DataFrame:
    """One row of SIGNATURE for each record with at least one statement; recs is (rec_table, id, batch_no, items).

    root_a and root_b are the digest of the sorted plain forms, bag that of the words as often as they occur,
    occurrences the hash of each occurrence of a word. A record of punctuation only has no words. A null name of the
    table is an error.
    """

    def run(batches):
        for batch in batches:
            b = C.Batch(batch.column(3).to_pylist())
            n = batch.num_rows
            seed = _seeds(batch.column(0).to_pylist())
            root = np.frombuffer(b"".join(b.root), np.uint64).reshape(-1, 2)
            columns = [batch.column(0), batch.column(1), batch.column(2), *(pa.array((x ^ seed).view(np.int64)) for x in (root[:, 0], root[:, 1], b.bag)), pa.array(b.words.astype(np.int32)), C.lists(b.element ^ seed[b.element_of], b.element_of, n)]
            yield pa.RecordBatch.from_arrays(columns, names=["rec_table", "id", "batch_no", "root_a", "root_b", "bag", "words", "occurrences"]).filter(pa.array(b.has))

    return recs.select("rec_table", F.col("id").cast("bigint"), F.col("batch_no").cast("int"), "items").mapInArrow(run, SIGNATURE)


def counters(sets: DataFrame, cells: int) -> np.ndarray:
    """How often the occurrences of words of each counter occur, over all sets: partial sums in the tasks, MERGES of them to the driver."""

    def count(batches):
        total = np.zeros(cells, np.int32)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy().view(np.uint64) & np.uint64(cells - 1), minlength=cells).astype(np.int32)
        if total.any():
            code = zlib.compress(total.tobytes(), 1)
            yield pa.RecordBatch.from_arrays([pa.array([zlib.crc32(code) % MERGES], pa.int32()), pa.array([code], pa.binary())], names=["part", "sums"])

    def merge(table: pa.Table) -> pa.Table:
        total = np.zeros(cells, np.int64)
        for code in table["sums"]:
            total += np.frombuffer(zlib.decompress(code.as_py()), np.int32)
        return pa.table({"sums": [zlib.compress(np.minimum(total, 2**31 - 1).astype(np.int32).tobytes(), 1)]}, schema=pa.schema([("sums", pa.binary())]))

    parts = sets.select("occurrences").mapInArrow(count, "part int, sums binary").groupBy("part").applyInArrow(merge, "sums binary").collect()
    total = sum((np.frombuffer(zlib.decompress(r.sums), np.int32).astype(np.int64) for r in parts), np.zeros(cells, np.int64))
    return np.minimum(total, 2**31 - 1).astype(np.int32)


def lookups(sets: DataFrame, counts: np.ndarray) -> DataFrame:
    """(key, bag, words, reach): the rarest words of each set.

    The order by count, then hash, is the same for all sets. reach is the greatest number of words of a set that can
    still be a near-copy if this is the first word both share; words without a reach to any are left out.
    """
    shared = sets.sparkSession.sparkContext.broadcast(counts)
    both = NUMERATOR + DENOMINATOR

    def run(batches):
        counts = shared.value
        for batch in batches:
            bag, words, one = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64), batch.column(2)
            at = np.repeat(np.arange(len(one)), np.diff(one.offsets.to_numpy()))
            key = one.flatten().to_numpy()
            order = np.lexsort((key, counts[key.view(np.uint64) & np.uint64(len(counts) - 1)], at))
            key, n = key[order], words[at]  # at stays as it is: it leads the order
            many = np.bincount(at, minlength=len(one))
            place = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
            # place <= n - a, where a = ceil(4/9 (m + n)) for a set of m words
            reach = (both * (n - place) - NUMERATOR * n) // NUMERATOR
            keep = DENOMINATOR * reach >= NUMERATOR * n
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key[keep], bag[at[keep]], n[keep].astype(np.int32), reach[keep].astype(np.int32))], names=["key", "bag", "words", "reach"])

    return sets.select("bag", "words", "occurrences").mapInArrow(run, TABLES["postings"])


def pairs(recs: DataFrame) -> DataFrame:
    """(rec_table, id_a, id_b): all pairs of records of one table in different batches that are copies or near-copies.

    recs is (rec_table, id, batch_no, items); id_a is the one in the earlier batch. Batches are taken one after
    another, the least batch_no first, each through Index against all before it. Copies are records with the same
    plain forms in any order; near-copies have at least 4/5 of all words in common. Rows with a null id or batch_no or
    without a statement have no pairs; ids are unique within a table. A group of c copies has as many pairs as the
    batches make of it: this follows from the required result; its join is split by AQE where one group is large.
    """
    spark, path = recs.sparkSession, scratch(recs.sparkSession, "signatures")
    signatures(recs.where("id is not null and batch_no is not null")).write.option("compression", "zstd").partitionBy("batch_no").parquet(path)
    signed, index = spark.read.schema(SIGNATURE).parquet(path), Index(spark, scratch(spark, "history"))
    found = [index.take(signed.where(F.col("batch_no") == r.batch_no), f"batch{r.batch_no}") for r in signed.select("batch_no").distinct().orderBy("batch_no").collect()]
    out = found[0] if found else spark.createDataFrame([], "rec_table string, id_a bigint, id_b bigint")
    for more in found[1:]:
        out = out.unionByName(more)
    return out


@dataclass
class State:
    """What an index has accepted: names of batches, where they lie, how many words they have and for how many the counters are."""

    generation: int = 0
    buckets: int = 1
    words: int = 0
    counted: int = 0
    commits: list[str] = field(default_factory=list)
    names: list[str] = field(default_factory=list)


class Index:
    """Tables of postings, sets of words and records in a folder that grow by each accepted batch. One writer at a time.

    A batch is looked up by its rarest words; of the history only the buckets are read that its words, and then its
    candidates, fall into, and nothing of it is made anew. Postings and sets are stored for sets of words that are new,
    so copies add a row for themselves and no more. All of a batch is written before one file of state makes it part of
    the history: a batch that broke off leaves nothing behind that is read, and one that was taken before is compared
    again but not stored twice. Another object over the same folder goes on where the last one ended.

    The order of the words is fixed by counters of the history as it was; when it has doubled, all is counted and laid
    into more buckets once, which over time costs as much again as each batch did.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.state = State(**json.loads(self._newest()[1] or "{}"))
        self._counts: np.ndarray | None = None

    def add(self, recs: DataFrame, name: str) -> DataFrame:
        """Pairs (rec_table, id_a, id_b) of the records of a batch with those of lower batch_no in the history; the batch is accepted after that."""
        with temporary(self.spark, ("batch-pairs",)):
            return self.take(written(signatures(recs.where("id is not null and batch_no is not null")), "batch-signatures"), name)

    def take(self, signed: DataFrame, name: str) -> DataFrame:
        """As add(), for rows of SIGNATURE."""
        if self.state.commits and self.state.words > RENEWED_AT * self.state.counted:
            self._renew()
        with temporary(self.spark, ("batch-pairs",)):
            sets = written(signed.where("words > 0").groupBy("bag").agg(F.first("words").alias("words"), F.first("occurrences").alias("occurrences")), "batch-sets")
            count = lambda: sets.agg(F.count("*"), F.coalesce(F.sum("words"), F.lit(0))).first()
            place = f"{len(self.state.names)}-{xxhash.xxh3_64_hexdigest(name)}"
            if self.state.commits:
                (rows, words), look = together(count, lambda: laid(lookups(sets, self._counters()), "batch-postings"))
            else:
                rows, words = count()
                self._count(sets, words)
                look = laid(lookups(sets, self._counters()), "batch-postings")
            both = F.array(F.struct(F.col("bag").alias("k"), F.lit(0).cast("bigint").alias("l"), F.lit(True).alias("is_bag"), F.col("root_a").alias("other")), F.struct(F.col("root_a").alias("k"), F.col("root_b").alias("l"), F.lit(False).alias("is_bag"), F.when(F.col("words") > 0, F.col("bag")).alias("other")))
            mine = signed.select("rec_table", "id", "batch_no", F.explode(F.when(F.col("words") > 0, both).otherwise(F.slice(both, 2, 1))).alias("m")).select("m.*", "rec_table", "id", "batch_no")
            new, known = name not in self.state.names, None
            found = self.spark.createDataFrame([], "rec_table string, id_a bigint, id_b bigint")
            members = lambda: self._lay("members", mine, place) if new else None
            if self.state.commits:
                (found, known), _ = together(lambda: self._compared(look, sets, rows, words, mine), members)
                look, sets = (t.join(known, "bag", "left_anti") for t in (look, sets))
            else:
                members()
            if new:
                together(lambda: self._lay("postings", look, place), lambda: self._lay("sets", sets, place))
                self._commit(State(**asdict(self.state) | {"words": self.state.words + words, "commits": [*self.state.commits, place], "names": [*self.state.names, name]}))
        return found

    def _compared(self, look: DataFrame, sets: DataFrame, rows: int, words: int, mine: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Pairs of records of the batch with earlier ones: by equal words, by equal plain forms, by words nearly all of which are common. Also the sets of words that are known."""
        a, b = self._read("postings", None, "key", words, look).alias("a"), look.alias("b")
        meet = (F.col("a.key") == F.col("b.key")) & (F.col("b.words") <= F.col("a.reach")) & (F.col("a.words") <= F.col("b.reach"))
        near = laid(a.join(b, meet).select(F.col("a.bag").alias("bag"), F.col("b.bag").alias("bag_b")).distinct(), "batch-near")
        known, near = near.where("bag = bag_b").select("bag"), near.where("bag <> bag_b")
        old = self._read("sets", near, "bag", rows).select("bag", "bag_b", F.col("words").alias("m"), F.col("occurrences").alias("theirs"))
        shared = F.size(F.array_intersect("theirs", "occurrences"))
        near = old.join(sets.withColumnRenamed("bag", "bag_b"), "bag_b").where(DENOMINATOR * shared >= NUMERATOR * (F.col("m") + F.col("words") - shared)).select("bag", "bag_b")
        own = mine.select("k", "l", "is_bag", F.lit(False).alias("near"), F.col("other").alias("own"), F.col("id").alias("id_b"), F.col("batch_no").alias("batch_b"))
        others = near.join(own.where("is_bag").withColumnRenamed("k", "bag_b"), "bag_b").select(F.col("bag").alias("k"), "l", "is_bag", F.lit(True).alias("near"), "own", "id_b", "batch_b")
        asked = laid(own.unionByName(others), "batch-asked")
        # each pair once: equal words whatever else, equal plain forms of other words, nearly equal words of other plain forms
        met = self._read("members", asked, ["k", "l", "is_bag"], 2 * rows).where("batch_no < batch_b").where(F.expr("(is_bag and not near) or coalesce(other <> own, true)"))
        return written(met.select("rec_table", F.col("id").alias("id_a"), "id_b"), "batch-pairs"), known

    def _lay(self, table: str, df: DataFrame, place: str) -> None:
        """Writes a part of a table, which is read once a file of state names its place; what an attempt before left there goes."""
        bucket = F.pmod(F.col(BUCKETED_BY[table]), F.lit(self.state.buckets)).cast("int")
        df.withColumn("bucket", bucket).write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{self._root()}/{table}/place={place}")

    def _read(self, table: str, asked: DataFrame | None, on, rows: int, by: DataFrame | None = None) -> DataFrame:
        """A table of the history joined with what is asked of it; only the buckets that fall under that are read, where the batch is small enough to leave some out."""
        root, b = f"{self._root()}/{table}", self.state.buckets
        df = self.spark.read.schema(TABLES[table] + ", bucket int").option("basePath", root).parquet(*(f"{root}/place={c}" for c in self.state.commits))
        by = asked if by is None else by
        if by is not None and rows < 8 * b > 8:
            touched = by.select(F.pmod(F.col(BUCKETED_BY[table]), F.lit(b)).cast("int").alias("bucket")).distinct()
            df = df.where(F.col("bucket").isin([r.bucket for r in touched.collect()]))
        df = df.drop("bucket", "place")
        return df if asked is None else df.join(asked, on)

    def _root(self) -> str:
        return f"{self.folder}/generation{self.state.generation}"

    def _count(self, sets: DataFrame, words: int) -> None:
        """Counters of the sets, kept in the folder, and the buckets that so many words need. Two postings in nine words, and some more, is what the rarest make."""
        cells = 1 << int(np.clip(np.ceil(np.log2(max(1, words // WORDS_EACH))), np.log2(LEAST_COUNTERS), np.log2(MOST_COUNTERS)))
        self.state.buckets = 1 << max(0, int(np.ceil(np.log2(max(1, words * 2 / 9 / BUCKET_ROWS)))))
        self.state.counted, self._counts = max(1, words), counters(sets, cells)
        self.spark.createDataFrame([(zlib.compress(self._counts.tobytes(), 1),)], "counts binary").coalesce(1).write.mode("overwrite").parquet(f"{self._root()}/counters")

    def _counters(self) -> np.ndarray:
        if self._counts is None:
            self._counts = np.frombuffer(zlib.decompress(self.spark.read.parquet(f"{self._root()}/counters").first().counts), np.int32)
        return self._counts

    def _renew(self) -> None:
        """Counts the history and lays it into the buckets it needs by now, as one commit of a new generation."""
        sets, members, old = self._read("sets", None, "bag", 0), self._read("members", None, "k", 0), self.state
        words = sets.agg(F.sum("words")).first()[0]
        self.state = State(**asdict(old) | {"generation": old.generation + 1, "words": words, "commits": ["all"]})
        self._count(sets, words)
        for table, df in (("postings", lookups(sets, self._counts)), ("sets", sets), ("members", members)):
            self._lay(table, df, "all")
        gone = f"{self.folder}/generation{old.generation}"
        self._commit(self.state)
        fs, p = self._hadoop(gone)
        fs.delete(p, True)

    def _hadoop(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _newest(self) -> tuple[int, str | None]:
        """Number and content of the newest file of state."""
        fs, p = self._hadoop(f"{self.folder}/state")
        numbers = [int(f.getPath().getName()) for f in fs.listStatus(p) if f.getPath().getName().isdigit()] if fs.exists(p) else []
        if not numbers:
            return 0, None
        stream = fs.open(self._hadoop(f"{self.folder}/state/{max(numbers)}")[1])
        try:
            return max(numbers), self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _commit(self, state: State) -> None:
        """A file of state under a name of its own, then renamed to its number: there as a whole or not at all."""
        number = self._newest()[0] + 1
        fs, p = self._hadoop(f"{self.folder}/state/writing-{number}")
        out = fs.create(p, True)
        out.write(bytearray(json.dumps(asdict(state)).encode()))
        out.close()
        if not fs.rename(p, self._hadoop(f"{self.folder}/state/{number}")[1]):
            raise RuntimeError(f"another writer has changed {self.folder}")
        self.state = state
