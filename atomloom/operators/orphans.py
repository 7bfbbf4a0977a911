"""Problem 3: references to records that are missing, deleted or arrive later, by bitmaps.

Keys get dense integer codes; references and parents are bitmaps over the codes, one for each key range and period, of
which only the words of 64 bits that aren't zero are kept. Reference AND NOT parent leaves the references whose key
lived at no time of the period; those whose key lived for a part of the period only are decided by their exact times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atomloom.session import written

#: Parts in which codes are given out; each sorts its own keys, so the dictionary needs no single order.
CODE_PARTS = 1024
#: Codes of one part start at part x 2^44.
PART_BITS = 44
#: A key and month with more than one in so many references is hot: there are at most so many of them.
HOT_SHARE = 1000
#: Rows of a hot key are spread over so many join keys.
SALTS = 32
END_OF_TIME = "9999-01-01"


def plain(x: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]+", "")


def not_blank(x: Column) -> Column:
    return F.coalesce(x.rlike(r"[^\s\p{Z}\p{Cc}]"), F.lit(False))


def statement_id(x: Column) -> Column:
    """The word after the first colon of a statement; null if there is none."""
    return F.nullif(F.regexp_extract(x, r"^[^:]*:[\s\p{Z}]*([^\s\p{Z}()]+)", 1), F.lit(""))


def references(df: DataFrame, table: str, key: str, at: str, source: str, items: str | None = None) -> DataFrame:
    """(ref_table, row_id, ref_field, ref_no, kind, key, at): the source of each row and the ids named in its list of statements.

    Null, empty and blank sources and elements refer to nothing; an element without an id refers to a key that is
    empty, so to no target. Rows with a null time live at no moment: their references come out as orphans.
    """
    base = df.select(F.col(key).cast("bigint").alias("row_id"), F.col(at).alias("at"), F.col(source).alias("source"), *([F.col(items).alias("items")] if items else []))
    out = base.where(not_blank(F.col("source"))).select(F.lit(table).alias("ref_table"), "row_id", F.lit("source").alias("ref_field"), F.lit(0).alias("ref_no"), F.lit("source").alias("kind"), plain(F.col("source")).alias("key"), "at")
    if items:
        e = base.select("row_id", "at", F.posexplode("items").alias("ref_no", "item")).where(not_blank(F.col("item")))
        e = e.select(F.lit(table).alias("ref_table"), "row_id", F.lit(items).alias("ref_field"), "ref_no", F.lit("statement").alias("kind"), F.coalesce(plain(statement_id(F.col("item"))), F.lit("")).alias("key"), "at")
        out = out.unionByName(e)
    return out


def targets(df: DataFrame, kind: str, key: str, since: str, until: str) -> DataFrame:
    """(kind, key, since, until): when each target row lived; until is null while it does. Rows that never lived are left out."""
    out = df.select(F.lit(kind).alias("kind"), plain(F.col(key)).alias("key"), F.col(since).alias("since"), F.col(until).alias("until"))
    return out.where("key <> '' and since is not null and (until is null or until > since)")


def bit(code: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(code, F.lit(64)).cast("int"))


def month(t: Column) -> Column:
    return (F.year(t) * 12 + F.month(t) - 1).cast("int")


def month_start(m: Column) -> Column:
    return F.make_timestamp((m / 12).cast("int"), F.pmod(m, F.lit(12)) + 1, F.lit(1), F.lit(0), F.lit(0), F.lit(0))


def orphans(refs: DataFrame, lived: DataFrame) -> DataFrame:
    """The rows of refs whose key had no target row living at their time: since <= at and (until null or until > at).

    refs is as references() gives it, lived as targets(); keys are compared within a kind. Empty tables on either side
    are fine: without targets every reference is an orphan.

    Shuffles: distinct (key, month) of references and targets, combined before it, so a hot key is one row a month,
    however often it is named or was stored again; words of bits by key range; and the references once by (key, month)
    against the keys that failed, salted for hot keys. The list of hot ones has at most HOT_SHARE rows. Times are
    looked at for the keys alone that lived for a part of the month. Months without references are left out.
    """
    spark = refs.sparkSession
    refs = refs.withColumn("period", F.coalesce(month(F.col("at").cast("timestamp")), F.lit(-1)))
    lived = lived.select("kind", "key", F.col("since").cast("timestamp").alias("since"), F.col("until").cast("timestamp").alias("until"))
    used = written(refs.groupBy("kind", "key", "period").agg(F.count("*").alias("n")), "reference-uses")
    first, last, total = used.agg(F.min(F.when(F.col("period") >= 0, F.col("period"))), F.max("period"), F.sum("n")).first()
    first, last = (F.lit(0), F.lit(-1)) if first is None else (F.lit(first), F.lit(last))
    no, yes = F.lit(False), F.lit(True)
    used = used.select("*", no.alias("begun"), no.alias("some"), no.alias("whole"))
    # a target that still lives is one bit in the month it began (or the first that counts); it lives for all of each later month
    still = lived.where(F.col("until").isNull() & (month(F.col("since")) <= last)).select("kind", "key", F.greatest(month(F.col("since")), first - 1).alias("period"), F.lit(0).cast("bigint").alias("n"), yes.alias("begun"), no.alias("some"), no.alias("whole"))
    gone = lived.where(F.col("until").isNotNull() & (month(F.col("since")) <= last) & (month(F.col("until")) >= first))
    gone = gone.select("kind", "key", "since", "until", F.explode(F.sequence(F.greatest(month(F.col("since")), first), F.least(month(F.col("until")), last))).alias("period"))
    covers = (F.col("since") <= month_start(F.col("period"))) & (F.col("until") >= month_start(F.col("period") + 1))
    gone = gone.select("kind", "key", "period", F.lit(0).cast("bigint").alias("n"), no.alias("begun"), yes.alias("some"), covers.alias("whole"))
    rows = used.unionByName(still).unionByName(gone).groupBy("kind", "key", "period").agg(F.sum("n").alias("n"), *(F.max(c).alias(c) for c in ("begun", "some", "whole")))
    # dictionary: a dense rank within each part of the keys; of a key there are as many rows as months
    rows = rows.withColumn("part", F.pmod(F.xxhash64("kind", "key"), F.lit(CODE_PARTS)))
    rank = F.dense_rank().over(Window.partitionBy("part").orderBy("kind", "key"))
    rows = written(rows.withColumn("code", F.shiftleft(F.col("part"), PART_BITS) + rank), "reference-codes")
    word, bits = F.shiftright("code", 6).alias("word"), bit(F.col("code"))
    none = F.lit(0).cast("bigint")
    bit_if = lambda c: F.when(c, bits).otherwise(none)
    words = rows.select(word, "period", bit_if(F.col("n") > 0).alias("ref"), bit_if(F.col("begun")).alias("since"), bit_if(F.col("some")).alias("any"), bit_if(F.col("whole")).alias("full"))
    words = words.groupBy("word", "period").agg(*(F.bit_or(c).alias(c) for c in ("ref", "since", "any", "full")))
    by_range = Window.partitionBy("word").orderBy("period")
    begun = F.coalesce(F.bit_or("since").over(by_range.rowsBetween(Window.unboundedPreceding, -1)), none)
    words = words.withColumn("begun", begun).where("ref <> 0")
    missing = F.col("ref").bitwiseAND(F.bitwise_not(F.col("begun").bitwiseOR(F.col("since")).bitwiseOR(F.col("any"))))
    unsure = F.col("ref").bitwiseAND(F.col("since").bitwiseOR(F.col("any"))).bitwiseAND(F.bitwise_not(F.col("begun").bitwiseOR(F.col("full"))))
    left = words.select("word", "period", missing.alias("missing"), unsure.alias("unsure")).where("missing <> 0 or unsure <> 0")
    # decode the surviving bits
    place = F.explode(F.sequence(F.lit(0), F.lit(63))).alias("place")
    left = left.select("word", "period", "missing", "unsure", place)
    set_ = lambda c: F.call_function("shiftright", F.col(c), F.col("place")).bitwiseAND(F.lit(1)) == 1
    left = left.select((F.shiftleft("word", 6) + F.col("place")).alias("code"), "period", set_("missing").alias("missing"), set_("unsure").alias("unsure")).where("missing or unsure")
    named = rows.where("n > 0").select("kind", "key", "code", "period").join(left, ["code", "period"]).select("kind", "key", "period", "missing")
    named = written(named, "reference-verdicts")
    hot = spark.createDataFrame(rows.where(F.col("n") > max(1, (total or 0) // HOT_SHARE)).select("kind", "key", "period").collect(), "kind string, key string, period int").withColumn("hot", F.lit(True))
    parts = F.when(F.col("hot"), F.lit(SALTS)).otherwise(F.lit(1))
    named = named.join(F.broadcast(hot), ["kind", "key", "period"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("hot")
    salted = refs.join(F.broadcast(hot), ["kind", "key", "period"], "left").withColumn("salt", F.pmod(F.xxhash64("row_id", "ref_no"), parts).cast("int")).drop("hot")
    hit = written(salted.join(named, ["kind", "key", "period", "salt"]), "reference-hits")
    # keys that lived for a part of the month: by their times
    times = lived.join(named.where("not missing").select("kind", "key").distinct(), ["kind", "key"]).select("kind", "key", "since", F.coalesce("until", F.lit(END_OF_TIME).cast("timestamp")).alias("until"))
    warm = hot.select("kind", "key", "hot").distinct()  # of hot keys the rows of all months
    doubtful = hit.drop("salt").where("not missing").join(F.broadcast(warm), ["kind", "key"], "left").withColumn("salt", F.pmod(F.xxhash64("row_id", "ref_no"), parts).cast("int")).alias("r")
    t = times.join(F.broadcast(warm), ["kind", "key"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1))).alias("t")
    same = (F.col("r.kind") == F.col("t.kind")) & (F.col("r.key") == F.col("t.key")) & (F.col("r.salt") == F.col("t.salt"))
    dead = doubtful.join(t, same & (F.col("t.since") <= F.col("r.at")) & (F.col("t.until") > F.col("r.at")), "left_anti")
    columns = ["ref_table", "row_id", "ref_field", "ref_no", "kind", "key", "at"]
    return hit.where("missing").select(*columns).unionByName(dead.select(*columns))


def counted(found: DataFrame) -> DataFrame:
    """(ref_table, ref_field, period string 'yyyy-MM', orphans bigint)."""
    return found.groupBy("ref_table", "ref_field", F.date_format("at", "yyyy-MM").alias("period")).agg(F.count("*").alias("orphans"))
