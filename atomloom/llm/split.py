"""Problem 2: texts over a size limit in pieces that end at natural boundaries and overlap, by pointer doubling.

Every place of a text gets a pointer: the farthest legal end of a piece that begins `overlap` characters before it.
The greedy cuts are the places reached from the first one. Squaring the table of pointers doubles the reach in each
round, so all cuts are known after as many rounds as their number has binary digits, all places at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from atomloom.session import written

SIZE, OVERLAP = 512, 64
#: Keys of requests sent again that are sent to all executors; more are joined by shuffle.
BROADCAST_ROWS = 200_000
#: A sentence boundary counts only if a piece gets at least so many characters beyond the overlap; else white space does.
LEAST_STEP = 64
#: Characters that end a sentence, those that may close it, and words before a dot that end none. Ours, in natural order.
ENDS, WIDE_ENDS, CLOSERS = ".!?", "。！？", "\"')]}’”»"
ABBREVIATIONS = {"approx", "ca", "cf", "co", "dr", "e.g", "eg", "etc", "fig", "i.e", "ie", "inc", "jr", "ltd", "mr", "mrs", "ms", "no", "nr", "p", "pp", "prof", "sr", "st", "vol", "vs"}
SPACES = " \t\r\n\x0b\x0c"
_CODES = {k: np.array([ord(c) for c in v], np.uint32) for k, v in (("ends", ENDS), ("wide", WIDE_ENDS), ("closers", CLOSERS), ("spaces", SPACES), ("lines", "\r\n"))}


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Flags over the places 0..len(text): a sentence or line ends there; white space ends or begins there."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(code)
    space = np.isin(code, _CODES["spaces"]) | (code == 0xA0) | ((code >= 0x2000) & (code <= 0x200A)) | (code == 0x3000) | (code == 0x85) | (code == 0x2028) | (code == 0x2029)
    sentence, word = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    word[1:] = space
    word[:-1] |= space
    sentence[1:] = np.isin(code, _CODES["lines"]) | np.isin(code, _CODES["wide"])
    for i in np.flatnonzero(np.isin(code, _CODES["ends"])):
        j = i + 1
        while j < n and text[j] in CLOSERS:
            j += 1
        if j < n and not space[j]:
            continue
        if text[i] == ".":
            k = i
            while k > 0 and i - k < 8 and not space[k - 1] and text[k - 1] not in "([{\"'":
                k -= 1
            if text[k:i].lower() in ABBREVIATIONS:
                continue
        sentence[j] = True
    sentence[0] = word[0] = False
    return sentence, word


def cuts(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[int]:
    """Ends of the pieces of a text, the last one its length; the piece before end e begins at the end before it less overlap.

    A piece ends at the farthest sentence or line end that leaves it at most `size` long and brings at least
    LEAST_STEP new characters (or the room for them, if less); if there is none, at the farthest place next to white
    space that brings at least one; if there is none, after `size` characters. A text of at most `size` is one piece.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than size")
    n = len(text)
    if n <= size:
        return [n]
    sentence, word = boundaries(text)
    place = np.arange(n + 1)
    last_sentence = np.maximum.accumulate(np.where(sentence, place, 0))
    last_word = np.maximum.accumulate(np.where(word, place, 0))
    begin = np.maximum(place - overlap, 0)
    limit = np.minimum(begin + size, n)
    step = min(LEAST_STEP, size - overlap)
    pointer = np.where(last_sentence[limit] >= place + step, last_sentence[limit], np.where(last_word[limit] > place, last_word[limit], limit))
    pointer[limit == n] = n
    reached = np.zeros(n + 1, bool)
    reached[pointer[0]] = True
    while True:
        more = reached.copy()
        more[pointer[np.flatnonzero(reached)]] = True
        if (more == reached).all():
            return np.flatnonzero(reached).tolist()
        reached = more
        pointer = pointer[pointer]


def spans(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    ends = cuts(text, size, overlap)
    return [(max(0, a - overlap) if k else 0, b) for k, (a, b) in enumerate(zip([0, *ends], ends))]


def once(df: DataFrame, key: str, texts: str) -> DataFrame:
    """(key, texts) with each request once: rows of one key whose texts are equal are one. Rows with a null key are all kept.

    Only keys and digests are shuffled to find the keys that stand in several rows; texts of these alone are compared.
    """
    base = df.select(key, texts)
    digest = base.select(key, F.xxhash64(texts).alias("h")).where(F.col(key).isNotNull())
    repeated = written(digest.groupBy(key, "h").agg(F.count("*").alias("n")).where("n > 1").select(key).distinct(), "sent-again")
    repeated = F.broadcast(repeated) if repeated.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else repeated
    return base.join(repeated, key, "left_anti").unionByName(base.join(repeated, key, "left_semi").dropDuplicates([key, texts]))


def pieces(df: DataFrame, key: str = "request_id", texts: str = "texts", size: int = SIZE, overlap: int = OVERLAP, with_text: bool = True, all_texts: bool = False) -> DataFrame:
    """(key, text_no int, text_hash bigint, piece_no int, begin int, end int[, piece string]) of the elements of texts longer than size.

    An element is first freed of outer spaces, tabs and line ends; begin and end count code points of what is left.
    Pieces follow each other with exactly `overlap` characters in common, are at most `size` long and never empty. With
    all_texts, elements that fit come out as one piece, except empty ones; null elements and null lists give nothing.
    A list that stands in several rows of one key, as of a request sent again, counts once. Different lists of one key
    come out each, as do all rows with a null key; text_hash, a hash of the element, tells their pieces apart.
    """
    kind = df.schema[key].dataType.simpleString()
    least = 0 if all_texts else size
    long = df.where(F.exists(texts, lambda t: F.length(t) > least))  # what has no such element needs no comparison
    names = ["text_no", "text_hash", "piece_no", "begin", "end", *["piece"] * with_text]
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), *[pa.string()] * with_text]

    def run(batches):
        for batch in batches:
            rows, out = [], []
            for i, items in enumerate(batch.column(1).to_pylist()):
                for no, t in enumerate(items or ()):
                    t = t.strip(" \t\r\n") if t else ""
                    if len(t) > size or (all_texts and t):
                        code = xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) - (1 << 63)
                        for p, (a, b) in enumerate(spans(t, size, overlap)):
                            rows.append(i)
                            out.append((no, code, p, a, b, t[a:b]) if with_text else (no, code, p, a, b))
            columns = list(zip(*out)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int32())), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=[key, *names])

    return once(long, key, texts).mapInArrow(run, f"`{key}` {kind}, text_no int, text_hash bigint, piece_no int, begin int, end int" + ", piece string" * with_text)


def counts(cut: DataFrame, items: DataFrame, key: str = "request_id") -> DataFrame:
    """(key, text_no, pieces bigint, item_id, chunk_count, same boolean): the number of pieces beside the count that each item result has.

    An oversized text without an item result has null there; a null chunk_count is not the same. Different texts at
    one place of one key have a row each.
    """
    n = cut.groupBy(key, "text_no", "text_hash").agg(F.count("*").alias("pieces")).drop("text_hash")
    held = items.select(key, F.col("item_no").alias("text_no"), "item_id", "chunk_count")
    return n.join(held, [key, "text_no"], "left").withColumn("same", F.coalesce(F.col("pieces") == F.col("chunk_count"), F.lit(False)))


def cover(cut: DataFrame, key: str = "request_id", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(key, text_no, chars, covered, fits, linked): of each text its length, the characters its pieces bring one after another, and whether all pieces keep to size and overlap."""
    before = F.lag("end").over(Window.partitionBy(key, "text_no", "text_hash").orderBy("piece_no"))
    one = cut.withColumn("before", F.coalesce(before, F.lit(0)))
    fits = (F.length("piece") == F.col("end") - F.col("begin")) & F.col("end").between(F.col("begin") + 1, F.col("begin") + size)
    return one.groupBy(key, "text_no", "text_hash").agg(
        F.max("end").alias("chars"), F.sum(F.col("end") - F.col("before")).cast("int").alias("covered"), F.bool_and(fits).alias("fits"), F.bool_and((F.col("piece_no") == 0) | (F.col("begin") == F.greatest(F.lit(0), F.col("before") - overlap))).alias("linked")
    ).drop("text_hash")
