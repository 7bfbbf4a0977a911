"""Readers and writers of the text formats: statement lines, assertion dumps, JSON lines, manifests, context and example files."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from atomloom.session import laid, written

PAYLOAD = "nl string, pln array<string>, source string, background boolean, relation string"
ASSERTION_FIELDS = 5


#: Bits of a line number for the place in a file, and of a statement's number for that within one call.
LINE_BITS, CALL_BITS = 43, 45


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """(line_no bigint, line): the lines of a text file or folder. line_no follows the order of the files' paths, then that within a file; it has gaps."""
    df = spark.read.text(path).select(F.col("value").alias("line"), F.monotonically_increasing_id().alias("id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    if len(df.inputFiles()) <= 1:  # parts of one file come in their order
        return df.select(F.col("id").alias("line_no"), "line")
    # Spark packs files into tasks by their size: the rows of a part are numbered from where it begins in its file
    parts = df.groupBy("file", "block").agg(F.min("id").alias("first")).collect()  # a row for each split of the scan
    rank = {f: i for i, f in enumerate(sorted({p.file for p in parts}))}
    starts = spark.createDataFrame([(p.file, p.block, (rank[p.file] << LINE_BITS) + p.block - p.first) for p in parts], "file string, block bigint, start bigint")
    return df.join(F.broadcast(starts), ["file", "block"]).select((F.col("start") + F.col("id")).alias("line_no"), "line")


def balanced(line: Column) -> Column:
    return (F.length(F.regexp_replace(line, r"[^(]", "")) == F.length(F.regexp_replace(line, r"[^)]", ""))) & line.startswith("(")


def statement_lines(spark: SparkSession, path: str, source: str) -> tuple[DataFrame, DataFrame]:
    """((seq, source, raw), (seq, source, raw, reason)): non-blank trimmed lines that are expressions, and the others."""
    lines = numbered(spark, path).select(F.col("line_no").alias("seq"), F.lit(source).alias("source"), F.regexp_replace("line", r"^\s+|\s+$", "").alias("raw")).where("raw <> ''")
    return lines.where(balanced(F.col("raw"))), lines.where(~balanced(F.col("raw"))).withColumn("reason", F.lit("not a balanced expression"))


class StatementTable:
    """Stored statements in a folder of Parquet, partitioned by source. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self) -> bool:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def read(self) -> DataFrame:
        """(seq, raw, source); empty if nothing was written yet."""
        empty = self.spark.createDataFrame([], "seq bigint, raw string, source string")
        return self.spark.read.schema(empty.schema).parquet(self.path) if self._exists() else empty

    def _calls(self) -> int:
        """How many calls have written, by the log of the table, an empty file each: nothing of the table is read."""
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/_calls")  # a name that readers pass over
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        number = 1 + max((int(f.getPath().getName()) for f in fs.listStatus(p)), default=0) if fs.exists(p) else 1
        if not fs.createNewFile(jvm.org.apache.hadoop.fs.Path(f"{self.path}/_calls/{number}")):
            raise RuntimeError(f"another writer has changed {self.path}")
        return number

    def append(self, statements: DataFrame, raw: str = "raw", source: str = "kb", unique: bool = False) -> DataFrame:
        """Appends statements with white space collapsed; blank ones are dropped. Returns what was added. unique drops repeated ones and those already stored; without it they are stored again.

        seq grows from call to call. Of the table only the texts are read, for unique, and none of it is shuffled as
        long as the new statements are few enough to be sent to all executors.
        """
        clean = statements.select(F.trim(F.regexp_replace(raw, r"[\s\p{Z}]+", " ")).alias("raw")).where("raw <> ''")
        if unique:
            clean = laid(clean.distinct(), "new-statements")
            there = self.read().select("raw").join(clean, "raw", "left_semi").distinct()
            clean = clean.join(there, "raw", "left_anti")
        start = F.shiftleft(F.lit(self._calls()).cast("bigint"), CALL_BITS)
        added = written(clean.select((F.monotonically_increasing_id() + start).alias("seq"), "raw", F.lit(source).alias("source")), "added")
        added.write.mode("append").partitionBy("source").parquet(self.path)
        return added

    def load_background(self, path: str) -> bool:
        """Adds a file of statement lines once under its own path as source; False if it is there already."""
        if self.read().where(F.col("source") == path).limit(1).count():
            return False
        good, _ = statement_lines(self.spark, path, path)
        self.append(good, source=path)
        return True

    def size(self, background: bool = False) -> int:
        t = self.read()
        return t.where((F.col("source") != "kb") if background else (F.col("source") == "kb")).count()

    def reset(self, source: str | None = None) -> None:
        """Deletes the statements of one source, or all. Files of other sources aren't touched."""
        jvm = self.spark.sparkContext._jvm
        from urllib.parse import quote

        target = self.path if source is None else f"{self.path}/source={quote(source, safe=' .-_()')}"
        p = jvm.org.apache.hadoop.fs.Path(target)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def assertions(spark: SparkSession, path: str, max_rows: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, all lines, quarantine) of a tab-separated dump, gzip or not.

    rows is (line_no, relation, start, end, metadata) of lines with five fields. Lines with fewer are skipped, lines
    with more go to the quarantine. max_rows keeps the first so many lines. A gzip file is read by one task; its lines are then spread.
    """
    lines = numbered(spark, path)
    if max_rows:
        lines = lines.orderBy("line_no").limit(max_rows)
    elif path.endswith(".gz"):
        lines = lines.repartition(spark.sparkContext.defaultParallelism)
    f = F.split("line", "\t", -1)
    cut = lines.withColumn("f", f)
    rows = cut.where(F.size("f") == ASSERTION_FIELDS).select("line_no", F.get("f", F.lit(1)).alias("relation"), F.get("f", F.lit(2)).alias("start"), F.get("f", F.lit(3)).alias("end"), F.get("f", F.lit(4)).alias("metadata"))
    return rows, lines, cut.where(F.size("f") > ASSERTION_FIELDS).select("line_no", "line")


def write_statements(stmts: DataFrame, path: str) -> None:
    stmts.select("atom").write.mode("overwrite").text(path)


def ascii_escaped(x: Column) -> Column:
    """JSON text in which everything beyond ASCII stands as \\u escapes, as UTF-16 units."""

    @F.pandas_udf("string")
    def run(s):
        return s.map(lambda t: re.sub(r"[^\x00-\x7f]", lambda m: "".join(f"\\u{u:04x}" for u in memoryview(m[0].encode("utf-16-le")).cast("H")), t))

    return run(x)


def write_payloads(stmts: DataFrame, path: str, source: str) -> None:
    """One JSON object a line for each statement, ASCII only."""
    record = F.struct("nl", F.array("atom").alias("pln"), F.lit(source).alias("source"), F.lit(True).alias("background"), F.col("predicate").alias("relation"))
    stmts.select(ascii_escaped(F.to_json(record)).alias("value")).write.mode("overwrite").text(path)


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """Payload records: blank lines and records without nl or pln are skipped, malformed JSON is an error."""
    df = spark.read.schema(PAYLOAD).option("mode", "FAILFAST").json(path)
    return df.where("nl is not null and pln is not null")


def write_manifest(manifest: DataFrame, path: str) -> None:
    manifest.coalesce(1).write.mode("overwrite").json(path)


def read_manifest(spark: SparkSession, path: str) -> dict | None:
    """The stored manifest; None if there is none."""
    try:
        rows = spark.read.json(path).limit(1).collect()
    except Exception as e:  # Spark has no narrower class for a missing path through every connector
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    return rows[0].asDict(recursive=True) if rows else None


def expected_count(manifest: dict | None, key: str = "atom_count") -> int:
    """The number of records a manifest promises; 0 without one or for a value that is no number."""
    try:
        return int((manifest or {}).get(key) or 0)
    except (TypeError, ValueError):
        return 0


def context_items(spark: SparkSession, path: str) -> DataFrame:
    """(item): a JSON list of strings, or the non-blank lines of a text file."""
    whole = spark.read.text(path, wholetext=True).select(F.col("value"))
    as_list = F.from_json("value", "array<string>")
    lines = F.transform(F.split("value", r"\r?\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    looks = F.col("value").rlike(r"^\s*\[")
    return whole.select(F.explode(F.when(looks, as_list).otherwise(F.filter(lines, lambda x: x != ""))).alias("item"))


def example_spec(spark: SparkSession, path: str) -> dict:
    """A JSON file with two prompts and two lists of examples; a missing key is an error that names it."""
    spec = json.loads(spark.read.text(path, wholetext=True).first()[0])
    for key in ("statement_prompt", "query_prompt", "statement_examples", "query_examples"):
        if key not in spec:
            raise ValueError(f"example file without {key}")
    return spec


def report_markdown(summary: DataFrame) -> str:
    """A table of a benchmark summary, which has one row for each parser."""
    rows = summary.orderBy("parser").collect()
    names = summary.columns
    return "\n".join(["| " + " | ".join(names) + " |", "|" + "---|" * len(names), *("| " + " | ".join(str(r[n]) for n in names) + " |" for r in rows)])


def write_report(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").json(path)
