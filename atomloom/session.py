"""Sessions for tests and the bench, and the shared folder that jobs write intermediate tables to."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")
#: Compressed size of a table that is sent to all executors, who hold a few times as much.
BROADCAST_BYTES = 8 << 20
_made: list[str] = []
_written: list[str] = []


def _delete(spark: SparkSession) -> None:
    """Deletes the intermediate tables of this process when it ends; what can't be deleted any more is left to the folder's owner."""
    for path in _written:
        try:
            _remove(spark, path)
        except Exception:  # noqa: BLE001 the session may be gone by now
            return


def _remove(spark: SparkSession, path: str) -> None:
    if path.startswith("file:"):
        shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), True)
    else:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def local_session(cores: str = "*", partitions: int = 8, name: str = "atomloom") -> SparkSession:
    """A local session as tests and the bench use it; on a cluster the session comes from outside."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def spread(df: DataFrame) -> DataFrame:
    """Rows of a scan that comes in fewer parts than there are cores (few files, or files that cannot be split), spread over the cores; else df as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir as the session has it.

    Only a local session without that setting gets a folder of its own; on a cluster the absence is an error,
    since a machine-local folder would lose data with its machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _made:
        _made.append(tempfile.mkdtemp(prefix="atomloom-"))
        atexit.register(shutil.rmtree, _made[0], True)
    return f"file://{_made[0]}"


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; what is written there is deleted when the process ends, or at the end of a temporary() around it."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_delete, spark)
    _written.append(path)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives the loss of executors.

    The table is written once as compressed Parquet, which takes a fraction of what a checkpoint of rows takes.
    """
    path = scratch(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def laid(df: DataFrame, label: str, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """A written table, sent to all executors in joins if its files have at most so many bytes; their size is read from the folder, without a job."""
    path = scratch(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    p = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    size = p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength()
    return F.broadcast(out) if size <= most_bytes else out


def together(*steps: Callable[[], T]) -> list[T]:
    """Runs steps that don't depend on each other at the same time, so that small jobs fill the cores; the first error is raised when all have ended."""
    with ThreadPoolExecutor(len(steps)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(s)) for s in steps]]


@contextmanager
def temporary(spark: SparkSession, keep: tuple[str, ...] = ()) -> Iterator[None]:
    """Tables written within are deleted at the end, as soon as they are consumed, but for those with a label in keep."""
    before = len(_written)
    try:
        yield
    finally:
        own, kept = _written[before:], []
        for path in own:
            if path.rsplit("/", 1)[-1].rsplit("-", 1)[0] in keep:
                kept.append(path)
            else:
                _remove(spark, path)
        _written[before:] = kept
