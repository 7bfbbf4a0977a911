"""Problem 1: freely typed values mapped to a reference list, by token repair and soft TF-IDF.

Distinct tokens of the values are joined to the vocabulary of the reference list by edit distance (both sides by what
is left of them after up to two deletions, then verified), complete entries are ranked by how much weight of theirs
the repaired tokens bear.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atomloom.llm.copies import plain
from atomloom.session import written

#: Plain form of a predicate: kind of its last argument.
KINDS = {"atlocation": "place", "madeof": "material", "usedfor": "purpose"}
#: Largest edit distance, and the shortest words for which 1 and 2 edits are taken.
EDITS, ONE_FROM, TWO_FROM = 2, 4, 6
#: Longest abbreviation: letters of a word in their order, from its first on, at least three. Counts less than any repair.
ABBREVIATION, ABBREVIATED = 6, 0.5
#: The weight of a token of the value that nothing in the vocabulary is near, against that of a known one.
UNKNOWN_WEIGHT = 0.25
#: Rows of any one table made of the reference list, or of the table of values, that are sent to all executors; more are
#: shuffled. Each such table is counted as it is sent, its keys and words included; a row has some 60 bytes.
BROADCAST_ROWS = 200_000
#: Letters with marks and digits typed for letters, with what they stand for, in natural order.
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
UNMARKED = "aaaaaaceeeeiiiinooooouuuuyy"
DIGITS, LETTERS = "01345789", "oleastbg"
#: A fact: an id after the first colon, then one group without inner groups; quotes, commas and any spaces may stand between.
FACT = r"^[^(]*\([\s\p{Z}]*[\"']?:[\s\p{Z}]*[^\s\p{Z}()]+[\s\p{Z}]*\(([^()]*)\)"
ARGUMENT = r"\"[^\"]*\"|[^\s\p{Z},\"']+"


def facts(items: DataFrame, key: str = "item_id", atoms: str = "atoms") -> DataFrame:
    """(id, atom_no int, kind, value, plain_value) of the facts with one of the predicates of KINDS; value is their last argument."""
    e = items.select(F.col(key).cast("bigint").alias("id"), F.posexplode(atoms).alias("atom_no", "atom")).where(F.lower("atom").rlike("|".join(r"[^\p{L}\p{N}]*".join(k) for k in KINDS)))
    e = e.withColumn("args", F.regexp_extract_all(F.regexp_extract("atom", FACT, 1), F.lit(ARGUMENT), F.lit(0)))
    e = e.where(F.size("args") >= 2).withColumn("kind", F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv))[plain(F.get("args", F.lit(0)))]).where("kind is not null")
    return e.select("id", "atom_no", "kind", F.element_at("args", -1).alias("value")).withColumn("plain_value", plain(F.col("value")))


def tokens(value: Column) -> Column:
    """Lower-case tokens: cut between letters in camel case and at all but letters and digits; marks and digits among letters made letters."""
    cut = F.lower(F.regexp_replace(value, r"(?<=\p{Ll})(?=\p{Lu})", "_"))
    bare = F.translate(cut, MARKED, UNMARKED)
    t = F.filter(F.split(bare, r"[^\p{L}\p{N}]+"), lambda x: x != "")
    return F.transform(t, lambda x: F.when(x.rlike(r"\p{L}") & x.rlike("[0-9]"), F.translate(x, DIGITS, LETTERS)).otherwise(x))


def without(word: Column, times: int) -> Column:
    """The word and all that up to `times` deletions leave of it."""
    once = lambda x: F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))
    left = [F.array(word)]
    for _ in range(times):
        left.append(F.flatten(F.transform(F.filter(left[-1], lambda x: F.length(x) > 1), once)))
    return F.array_distinct(F.concat(*left))


def keys(word: Column, typed: bool) -> Column:
    """What the join goes by: the remains after deletions, the consonants, the first letters of what may be an abbreviation, and the singular of a plural in -ies.

    An abbreviation begins with the first letter of its word and goes on with any two later ones in their order: a word
    has a key for each such three letters, a typed one that for its own.
    """
    none = F.array().cast("array<string>")
    few = F.when(F.length(word) >= TWO_FROM - 1, without(word, 2)).otherwise(without(word, 1))
    at = lambda i: F.substring(word, i, F.lit(1))
    pairs = lambda i: F.transform(F.sequence(i + 1, F.length(word)), lambda j: F.concat(F.lit("a"), F.substring(word, 1, 1), at(i), at(j)))
    threes = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(2), F.length(word) - 1), pairs)))
    return F.concat(
        F.transform(few, lambda x: F.concat(F.lit("d"), x)),
        F.array(F.concat(F.lit("c"), F.regexp_replace(word, "[aeiou]", ""))),
        F.when(F.length(word).between(3, ABBREVIATION), F.array(F.concat(F.lit("a"), F.substring(word, 1, 3)))).otherwise(none) if typed else F.when(F.length(word) >= 3, threes).otherwise(none),
        F.when(word.endswith("ies"), F.array(F.concat(F.lit("d"), F.regexp_replace(word, "ies$", "y")))).otherwise(none),
    )


def nearness(typed: Column, word: Column) -> Column:
    """1 for equal words, less for each edit; null where they are too far apart."""
    d, n = F.levenshtein(typed, word), F.length(word)
    allowed = F.when(n >= TWO_FROM, 2).when(n >= ONE_FROM, 1).otherwise(0)
    swapped = (d == 2) & (F.length(typed) == n) & (F.array_sort(F.split(typed, "")) == F.array_sort(F.split(word, "")))
    vowels = (d == n - F.length(typed)) & (F.regexp_replace(typed, "[aeiou]", "") == F.regexp_replace(word, "[aeiou]", "")) & (2 * F.length(typed) >= n) & (F.length(typed) >= 3)
    plural = (typed.endswith("ies") & (F.regexp_replace(typed, "ies$", "y") == word)) | (typed == F.concat(word, F.lit("es")))
    pattern = F.concat(F.lit("^"), F.array_join(F.filter(F.split(typed, ""), lambda x: x != ""), ".*"))
    short = F.length(typed).between(3, ABBREVIATION) & typed.rlike("^[a-z]+$") & F.rlike(word, pattern)
    return F.when(swapped | plural, 1 - 1.0 / n).when(d <= allowed, 1 - d.cast("double") / n).when(vowels, F.greatest(F.lit(0.6), 1 - 0.5 * d / n)).when(short, ABBREVIATED)


def forms(canon: DataFrame) -> DataFrame:
    """(form_id, canon_id, kind, words, joined): each symbol and each alias of an entry, with its tokens."""
    one = canon.select("canon_id", F.lower(F.trim("kind")).alias("kind"), F.explode(F.array_distinct(F.concat(F.array("symbol"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("form"))
    one = one.withColumn("words", tokens(F.col("form"))).where(F.size("words") > 0)
    return one.withColumn("form_id", F.xxhash64("kind", "canon_id", "words"))


def mapped(values: DataFrame, canon: DataFrame) -> DataFrame:
    """(kind, value, canon_id int) for distinct (kind, value): the entry of the kind that the value means, 0 for none.

    An entry is meant if every token of its symbol or of one of its aliases is repaired from a token of the value of
    its own (or the whole value from the form written as one word, in either order). Of several the one with the
    highest soft TF-IDF score is taken, then the smallest canon_id. Null and empty values mean none.

    What is made of the reference list is counted before it is sent to all executors. Values are shuffled once by token
    and once by value; every other join is with the list. A value meets an entry by the rarest word of it alone, so a
    word that many values and many entries have makes no pairs.
    """
    form = written(forms(canon), "forms").withColumn("words", F.array_distinct("words")).withColumn("size", F.size("words"))
    vocabulary = form.select("kind", F.explode("words").alias("word")).groupBy("kind", "word").agg(F.count("*").alias("n"))
    total = form.groupBy("kind").agg(F.count("*").alias("all"))
    vocabulary = vocabulary.join(total, "kind").select("kind", "word", F.log(1 + F.col("all") / F.col("n")).alias("idf"))
    whole = form.where("size > 1").select("kind", "form_id", F.explode(F.array(F.array_join("words", ""), F.array_join(F.reverse("words"), ""))).alias("word")).distinct()
    longest = vocabulary.select(F.max(F.length("word")).alias("n")).unionByName(whole.select(F.max(F.length("word")).alias("n"))).agg(F.max("n")).first()[0] or 0
    v = written(values.select("kind", "value", F.array_distinct(tokens(F.col("value"))).alias("typed")).where(F.size("typed") > 0), "values")
    # tokens longer than the longest word and its edits can be near none; the consonants of longer ones equal none's
    distinct = v.select("kind", F.explode("typed").alias("token")).where(F.length("token") <= longest + EDITS).distinct()
    by_key = laid(vocabulary.withColumn("k", F.explode(keys(F.col("word"), False))).select("kind", "k", "word", "idf").distinct(), "vocabulary-keys")
    near = distinct.withColumn("k", F.explode(keys(F.col("token"), True))).join(by_key, ["kind", "k"]).select("kind", "token", "word", "idf").distinct()
    near = written(near.withColumn("sim", nearness(F.col("token"), F.col("word"))).where("sim is not null"), "repairs")
    # whole values written as one word
    single = v.where(F.size("typed") == 1).select("kind", "value", F.get("typed", F.lit(0)).alias("token")).where(F.length("token").between(TWO_FROM, longest + EDITS))
    whole_keys = laid(whole.withColumn("k", F.explode(without(F.col("word"), 2))), "whole-keys")
    ones = single.withColumn("k", F.explode(without(F.col("token"), 2))).join(whole_keys, ["kind", "k"]).select("kind", "value", "token", "form_id", "word").distinct()
    ones = ones.withColumn("sim", 1 - F.levenshtein("token", "word").cast("double") / F.length("word")).where(F.levenshtein("token", "word") <= EDITS)
    ones = ones.select("kind", "value", "form_id", F.col("sim").alias("score"))
    # each form with the idf of its words, to be met by its rarest one
    weighed = form.select("kind", "form_id", "size", F.explode("words").alias("word")).join(vocabulary, ["kind", "word"]).groupBy("kind", "form_id", "size").agg(F.collect_list(F.struct("idf", "word")).alias("parts"))
    by_rarest = laid(weighed.withColumn("word", F.array_max("parts")["word"]), "forms-by-rarest-word")
    token_of = v.select("kind", "value", F.size("typed").alias("typed_n"), F.explode("typed").alias("token"))
    repaired = token_of.join(near, ["kind", "token"]).groupBy("kind", "value", "typed_n").agg(F.collect_list(F.struct("word", "sim", "token")).alias("repairs"))
    met = repaired.withColumn("word", F.explode(F.array_distinct(F.transform("repairs", lambda r: r["word"])))).join(by_rarest, ["kind", "word"])
    best = lambda p: F.array_max(F.transform(F.filter("repairs", lambda r: r["word"] == p["word"]), lambda r: F.struct(r["sim"].alias("sim"), r["token"].alias("token"), p["idf"].alias("idf"))))
    met = met.select("kind", "value", "typed_n", "form_id", "size", F.transform("parts", best).alias("parts")).where(F.forall("parts", lambda p: p.isNotNull()) & (F.size(F.array_distinct(F.transform("parts", lambda p: p["token"]))) == F.col("size")))
    summed = lambda f: F.aggregate("parts", F.lit(0.0), lambda total, p: total + f(p))
    met = met.withColumn("square", summed(lambda p: p["idf"] * p["idf"])).withColumn("dot", summed(lambda p: p["sim"] * p["idf"] * p["idf"]))
    # the score: the weight that the repaired tokens bear
    extra = (F.col("typed_n") - F.col("size")) * F.col("square") / F.col("size") * UNKNOWN_WEIGHT**2
    ranked = met.select("kind", "value", "form_id", (F.col("dot") / F.sqrt(F.col("square") * (F.col("square") + extra))).alias("score")).unionByName(ones)
    found = ranked.join(laid(form.select("form_id", "canon_id"), "form-entries"), "form_id").groupBy("kind", "value").agg(F.max(F.struct("score", (-F.col("canon_id")).alias("c"))).alias("x"))
    return v.select("kind", "value").join(found.select("kind", "value", (-F.col("x.c")).cast("int").alias("canon_id")), ["kind", "value"], "left").withColumn("canon_id", F.coalesce("canon_id", F.lit(0)))


def laid(df: DataFrame, label: str) -> DataFrame:
    """df as a written table, sent to all executors if it has at most BROADCAST_ROWS rows."""
    df = written(df, label)
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def matched(items: DataFrame, canon: DataFrame, key: str = "item_id", atoms: str = "atoms") -> DataFrame:
    """(id, atom_no, kind, value, canon_id): every fact whose last argument isn't written as a symbol, with the entry meant, 0 if none.

    Null lists and null, blank or malformed elements are no facts, rules neither. Repeated rows come out repeatedly.
    """
    rows = facts(items, key, atoms)
    symbols = laid(canon.select(plain(F.col("symbol")).alias("plain_value")).distinct(), "symbols")
    rows = written(rows.join(symbols, "plain_value", "left_anti"), "typed")
    table = laid(mapped(rows.select("kind", "value").distinct(), canon), "mapped")
    return rows.join(table, ["kind", "value"], "left").select("id", "atom_no", "kind", "value", F.coalesce("canon_id", F.lit(0)).alias("canon_id"))
