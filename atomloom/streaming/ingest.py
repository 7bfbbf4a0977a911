"""Incremental ingestion: new files of texts become statements of the knowledge base, micro-batch by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atomloom.operators import parsers, service
from atomloom.session import temporary
from atomloom.sources.files import StatementTable


def start(spark: SparkSession, source: str, kb: str, checkpoint: str, schema: str, key: str = "doc_id", text: str = "text", parser: str = "template", files_each: int = 16, once: bool = True):
    """Starts a query that reads Parquet files as they come to `source`, parses their texts and appends the statements to the table at `kb`.

    A statement is stored once: each micro-batch leaves out what is there already, so a batch that is run again after
    a failure adds nothing twice. Within a micro-batch all texts see the knowledge base as of its start. With once,
    all files there are are taken and the query ends.
    """
    table = StatementTable(spark, kb)

    def take(batch: DataFrame, number: int) -> None:
        with temporary(spark):  # a batch leaves nothing behind but its statements
            done = service.ingest(batch, key, text, parsers.parser(parser))
            table.append(done.select(F.explode("atoms").alias("raw")), unique=True)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).parquet(source)
    writer = stream.select(key, text).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()
