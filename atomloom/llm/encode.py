"""Problem 7: the corpus as ids of a public tokenizer."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from atomloom.llm import bpe


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, ids array<int>) for every row: the ids of the text, without special tokens.

    Null and empty texts give an empty list; a blank text has the ids of its spaces. The strings of special tokens
    are ordinary text. Rows with a null or repeated key are kept. No shuffle: one Arrow pass, memory bounded by a batch.
    """

    def run(batches):
        code = bpe.encoder(path).encode_bytes
        for batch in batches:
            coded = [code(x) for x in batch.column(1).to_pylist()]
            ends = np.zeros(len(coded) + 1, np.int64)
            np.cumsum([len(x) // 4 for x in coded], out=ends[1:])
            values = pa.array(np.frombuffer(b"".join(coded), "<i4"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)], names=[key, "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, n_tokens bigint) for every row, by the same encoder; null and empty texts have 0."""

    def run(batches):
        code = bpe.encoder(path).encode_bytes
        for batch in batches:
            sizes = pa.array([len(code(x)) // 4 for x in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes], names=[key, "n_tokens"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens bigint")
