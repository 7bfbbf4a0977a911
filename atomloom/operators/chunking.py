"""Text splitting: sentences, dependent sentences merged, size limits, batches for a parser, paragraphs first.

Everything works on one row's text at a time, without a shuffle. Null and blank texts give empty lists.
"""

from __future__ import annotations

import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atomloom.functions.symbols import let

WS = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
#: First words and first phrases of a sentence that depends on the one before; the second list is for paragraph-first chunks.
CUES = ["it", "its", "they", "their", "them", "this", "these", "those", "he", "she", "therefore", "thus", "hence", "however", "so"]
PREFIXES = ["this result", "this finding", "these findings", "this method", "this approach", "this model", "this suggests", "this indicates", "these results"]
MORE_CUES = ["his", "her"]
MORE_PREFIXES = ["as a result", "for this reason"]
SIZE, OVERLAP, LOOK_BACK = 512, 64, 0.2
MOST_SENTENCES, MOST_CHARS = 4, 2000
TEXTS = "array<string>"


def strip(x: Column) -> Column:
    return F.regexp_replace(x, f"^{WS}+|{WS}+$", "")


def sentences(text: Column) -> Column:
    """Parts that end where white space follows one of . ! ?, trimmed, without empty ones."""
    parts = F.split(text, f"(?<=[.!?]){WS}+")
    return F.coalesce(F.filter(F.transform(parts, strip), lambda s: s != ""), F.array().cast(TEXTS))


def depends(sentence: Column, cues: list[str] = CUES, prefixes: list[str] = PREFIXES) -> Column:
    """Whether a sentence goes with the one before: its first token is a cue, or its first two or three tokens are a prefix."""
    tokens = F.slice(F.filter(F.split(F.lower(sentence), f"{WS}+", 5), lambda t: t != ""), 1, 3)
    first = lambda t, n: F.array_join(F.slice(t, 1, n), " ")
    return let(tokens, lambda t: first(t, 1).isin(cues) | first(t, 2).isin(prefixes) | first(t, 3).isin(prefixes))


def merged(parts: Column, cues: list[str] = CUES, prefixes: list[str] = PREFIXES) -> Column:
    """Sentences joined by a space to the one they depend on; the first never depends."""

    def join(ps: Column) -> Column:
        numbered = F.transform(ps, lambda s, i: F.when((i == 0) | ~depends(s, cues, prefixes), i + 1))
        return let(F.filter(numbered, lambda i: i.isNotNull()), lambda starts: F.transform(starts, lambda s, k: F.array_join(F.slice(ps, s, F.coalesce(F.get(starts, k + 1), F.size(ps) + 1) - s), " ")))

    return let(parts, join)


def size_pieces(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """Pieces of one text: the window ends after the last sentence mark or line end within its last fifth.

    The search starts at the end of the window, so a piece can be one longer than size. An overlap so large that a
    window could fail to move on is refused.
    """
    back = int(size * LOOK_BACK)
    if not 0 <= overlap < size - back:
        raise ValueError("overlap must be less than four fifths of size")
    if len(text) <= size:
        return [text]
    out, start = [], 0
    while start < len(text):
        end = start + size
        if end >= len(text):
            out.append(text[start:].strip())
            break
        low = max(0, end - back) + 1
        cut = max((text.rfind(mark, low, end + 1) for mark in ".!?\n"), default=-1)
        cut = cut + 1 if cut >= 0 else end
        out.append(text[start:cut].strip())
        start = cut - overlap
    return [p for p in out if p]


def size_limited(parts: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Each part longer than size in its pieces, the others as they are. Only lists with an oversized part leave the JVM."""

    @F.pandas_udf(TEXTS)
    def cut(lists: pd.Series) -> pd.Series:
        return lists.map(lambda xs: None if xs is None else [p for x in xs for p in size_pieces(x, size, overlap)])

    size_pieces("", size, overlap)
    return F.coalesce(cut(F.when(F.exists(parts, lambda p: F.length(p) > size), parts)), parts)


def whole_units(text: Column) -> Column:
    """Sentences, merged; a text with at most one sentence is one unit as it is."""
    units = lambda t, s: F.when((t == "") | t.isNull(), F.array().cast(TEXTS)).when(F.size(s) <= 1, F.array(t)).otherwise(merged(s))
    return let(strip(text), lambda t: let(sentences(t), lambda s: units(t, s)))


def chunks(df: DataFrame, key: str, text: str, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(key, chunks array<string>) for every row: sentences, merged in the JVM, then size-limited in one Arrow pass."""
    size_pieces("", size, overlap)

    def cut(batches):
        for batch in batches:
            lists = [[p for x in xs for p in size_pieces(x, size, overlap)] for xs in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(pa.string()))], names=[key, "chunks"])

    return df.select(key, whole_units(F.col(text)).alias("units")).mapInArrow(cut, f"`{key}` {df.schema[key].dataType.simpleString()}, chunks array<string>")


def batch_numbers(units: Column, most_sentences: int = MOST_SENTENCES, most_chars: int = MOST_CHARS) -> Column:
    """For each chunk the number of its batch, from 0: batches are filled in order up to both limits; limits are at least 1."""
    most_sentences, most_chars = max(1, most_sentences), max(1, most_chars)

    def add(state: Column, unit: Column) -> Column:
        n = F.length(unit)
        full = (state["n"] > 0) & ((state["n"] >= most_sentences) | (state["chars"] + 1 + n > most_chars))
        number = F.when(full, state["no"] + 1).otherwise(state["no"])
        chars = F.when(full | (state["chars"] == 0), n).otherwise(state["chars"] + 1 + n)
        return F.struct(number.alias("no"), F.when(full, F.lit(1)).otherwise(state["n"] + 1).alias("n"), chars.alias("chars"), F.concat(state["all"], F.array(number)).alias("all"))

    zero = F.struct(F.lit(0).alias("no"), F.lit(0).alias("n"), F.lit(0).alias("chars"), F.array().cast("array<int>").alias("all"))
    return F.aggregate(units, zero, add, lambda s: s["all"])


def batches(units: Column, numbers: Column) -> Column:
    """Chunks as lists by batch."""
    last = F.coalesce(F.try_element_at(numbers, F.lit(-1)), F.lit(-1))
    each = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(each, lambda b: F.transform(F.filter(F.arrays_zip(units.alias("u"), numbers.alias("b")), lambda z: z["b"] == b), lambda z: z["u"]))


_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_PARAGRAPH = re.compile(r"\n\s*\n")


def _merge(parts: list[str]) -> list[str]:
    cues, prefixes, out = {*CUES, *MORE_CUES}, {*PREFIXES, *MORE_PREFIXES}, []
    for part in parts:
        t = part.lower().split()
        if out and t and (t[0] in cues or " ".join(t[:2]) in prefixes or " ".join(t[:3]) in prefixes):
            out[-1] += " " + part
        else:
            out.append(part)
    return out


def _packed(parts: list[str], joint: str, size: int, after_first: bool) -> list[str]:
    """Parts joined while their lengths and the joints counted so far leave room; after_first: no joint is counted after the part that opens a new pack."""
    out: list[list[str]] = []
    used = 0
    for part in parts:
        if out and used + len(part) > size:
            out.append([part])
            used = len(part) + (0 if after_first else len(joint))
        else:
            if not out:
                out.append([])
            out[-1].append(part)
            used += len(part) + len(joint)
    return [joint.join(p) for p in out]


def paragraph_chunks(text: str | None, size: int = SIZE) -> list[str]:
    """Chunks of whole paragraphs; an oversized paragraph becomes chunks of whole merged sentences, a single oversized sentence stays whole."""
    text = (text or "").strip()
    if len(text) <= size:
        return [text] if text else []
    out: list[str] = []
    run: list[str] = []
    for p in [p.strip() for p in _PARAGRAPH.split(text)]:
        if not p:
            continue
        if len(p) <= size:
            run.append(p)
            continue
        out += _packed(run, "\n\n", size, False)
        run = []
        out += _packed(_merge([s.strip() for s in _SENTENCE.split(p) if s.strip()]), " ", size, True)
    return [c for c in out + _packed(run, "\n\n", size, False) if c.strip()]


def paragraphs_first(text: Column, size: int = SIZE) -> Column:
    @F.pandas_udf(TEXTS)
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: paragraph_chunks(t, size))

    return cut(text)
