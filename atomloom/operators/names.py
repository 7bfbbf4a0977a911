"""Proper names by where words stand in a text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = r"\b[A-Za-z][A-Za-z0-9_'-]*\b"


def positional(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, word, name): words that occur after the start of a sentence and are capitalised at every such place.

    word is lower case, name the first such spelling. A sentence starts at the start of the text and where white space
    follows one of . ! ?; only the places of capitalised words can be starts. Null texts give nothing.
    """
    # mark each start of a sentence before a capitalised word, then read the words with their marks in order
    marked = F.regexp_replace(text, r"(^|[.!?]\s+)(?=[A-Z])", "$1\u0001")
    tokens = F.regexp_extract_all(marked, F.lit("(?U)\u0001?" + WORD), F.lit(0))
    word = df.select(key, F.posexplode(tokens).alias("at", "token")).where(~F.col("token").startswith("\u0001"))
    word = word.groupBy(key, F.lower("token").alias("word")).agg(F.bool_and(F.col("token").rlike("^[A-Z]")).alias("all"), F.min_by("token", "at").alias("name"))
    return word.where("all").select(key, "word", "name")
