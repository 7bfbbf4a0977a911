"""Bulk background knowledge: assertion rows to statements with truth values, sampled and deduplicated, with counts and a manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atomloom.functions import symbols as S
from atomloom.session import written

#: Relations that are kept and the predicates they become.
RELATIONS = {
    "/r/IsA": "IsA", "/r/HasProperty": "IsA", "/r/PartOf": "PartOf", "/r/UsedFor": "UsedFor", "/r/CapableOf": "CapableOf", "/r/AtLocation": "AtLocation", "/r/HasA": "HasA", "/r/MadeOf": "MadeOf",
}
#: Sentences by predicate, as the text between subject and object.
TEMPLATES = {"IsA": " is a kind of ", "PartOf": " is part of ", "UsedFor": " is used for ", "CapableOf": " is capable of ", "AtLocation": " is located at ", "HasA": " has a ", "MadeOf": " is made of "}
PROPERTY = "/r/HasProperty"
#: A path of the language with a letter or digit in its concept: just those have a canonical form that isn't empty.
CONCEPT = f"^{S.LANGUAGE_PREFIX}[^/]*[A-Za-z0-9]"
LEAST_WEIGHT, PERCENT, SEED = 2.0, 100.0, 42
DEFAULT_WEIGHT, WEIGHT_HALF, MOST_CONFIDENCE = 1.0, 0.2, 0.9999
NORMALIZATION_VERSION = 1
#: Settings a manifest is held against.
SETTINGS = ("source_file", "normalization_version", "min_weight", "coverage_percent", "sample_seed")


def fits(weight: Column, least_weight: float = LEAST_WEIGHT) -> Column:
    """Whether an assertion is kept: a known relation, concepts of the language and enough weight; the cheap conditions come first."""
    return F.coalesce(F.when(F.col("relation").isin(list(RELATIONS)) & F.col("start").rlike(CONCEPT) & F.col("end").rlike(CONCEPT) & F.col("metadata").rlike(r"^\s*\{"), weight >= least_weight), F.lit(False))


def weight_of(metadata: Column) -> Column:
    value = lambda m: F.when(m.isNotNull(), F.when(F.map_contains_key(m, F.lit("weight")), m["weight"].try_cast("double")).otherwise(F.lit(DEFAULT_WEIGHT)))
    return S.let(F.from_json(metadata, "map<string,string>", {"mode": "PERMISSIVE"}), value)


def weighed(rows: DataFrame, least_weight: float = LEAST_WEIGHT) -> DataFrame:
    """(line_no, relation, start, end, weight) of the assertions with a known relation, concepts of the language and enough weight; the cheap conditions come first."""
    df = rows.where(F.col("relation").isin(list(RELATIONS))).where(F.col("start").rlike(CONCEPT) & F.col("end").rlike(CONCEPT)).where(F.col("metadata").rlike(r"^\s*\{"))
    df = df.withColumn("weight", weight_of(F.col("metadata")))
    return df.where(F.col("weight") >= least_weight).select("line_no", "relation", "start", "end", "weight")


def projected(df: DataFrame) -> DataFrame:
    known = F.create_map(*(F.lit(x) for kv in RELATIONS.items() for x in kv))
    return df.select("line_no", "relation", known[F.col("relation")].alias("predicate"), S.clean_concept(F.col("start")).alias("source"), S.clean_concept(F.col("end")).alias("target"), "weight")


def eligible(rows: DataFrame, least_weight: float = LEAST_WEIGHT) -> DataFrame:
    """(line_no, relation, predicate, source, target, weight) of the assertions kept.

    rows is (line_no, relation, start, end, metadata). Dropped are other relations, concepts of other languages or
    without a letter or digit, malformed metadata (null too) and weights below the least; a missing weight is 1.
    """
    return projected(weighed(rows, least_weight))


def first_eligible(rows: DataFrame, least_weight: float = LEAST_WEIGHT) -> DataFrame:
    """first_of_triple(eligible(rows)), but rows that repeat as they stand are reduced to the first before any symbol is made."""
    first = weighed(rows, least_weight).groupBy("relation", "start", "end").agg(F.min(F.struct("line_no", "weight")).alias("r"))
    return first_of_triple(projected(first.select("r.line_no", "relation", "start", "end", "r.weight")))


def unit_score(predicate: Column, source: Column, target: Column, seed: int) -> Column:
    """The triple's place in [0, 1): the first 64 bits of a hash of it and the seed."""
    digest = F.sha2(F.concat_ws("|", F.lit(str(seed)), predicate, source, target), 256)
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("double") / F.lit(2.0**64)


def sampled(df: DataFrame, percent: float = PERCENT, seed: int = SEED) -> DataFrame:
    """The triples whose place is below percent: the same ones on every run, and a larger percent keeps all of a smaller one."""
    if not 0 < percent <= 100:
        raise ValueError("percent must be above 0 and at most 100")
    return df if percent >= 100 else df.where(unit_score(F.col("predicate"), F.col("source"), F.col("target"), seed) < percent / 100)


def first_of_triple(df: DataFrame) -> DataFrame:
    """One row for each triple: the one with the smallest line_no. Aggregated before the shuffle, so repeated triples cost nothing."""
    best = df.groupBy("predicate", "source", "target").agg(F.min(F.struct("line_no", "relation", "weight")).alias("r"))
    return best.select("r.line_no", "r.relation", "predicate", "source", "target", "r.weight")


def confidence(weight: Column) -> Column:
    return F.least(weight / (weight + WEIGHT_HALF), F.lit(MOST_CONFIDENCE))


def statements(df: DataFrame) -> DataFrame:
    """(line_no, predicate, source, target, stmt_id, confidence string, atom, nl) of deduplicated triples."""
    triple = F.concat_ws("|", "predicate", "source", "target")
    spaced = lambda c: F.replace(F.col(c), F.lit("_"), F.lit(" "))
    middle = F.create_map(*(F.lit(x) for kv in TEMPLATES.items() for x in kv))[F.col("predicate")]
    nl = F.when(F.col("relation") == PROPERTY, F.concat("source", F.lit(" is "), "target")).otherwise(F.concat(spaced("source"), middle, spaced("target")))
    df = df.withColumn("stmt_id", F.concat(F.lit("cnet_"), F.lower("predicate"), F.lit("_"), F.substring(F.md5(triple), 1, 10))).withColumn("confidence", F.format_number(confidence(F.col("weight")), 4))
    atom = F.concat(F.lit("(: "), "stmt_id", F.lit(" ("), F.concat_ws(" ", "predicate", "source", "target"), F.lit(") (STV 1.0 "), "confidence", F.lit("))"))
    return df.select("line_no", "predicate", "source", "target", "stmt_id", "confidence", atom.alias("atom"), nl.alias("nl"))


def relation_counts(stmts: DataFrame) -> DataFrame:
    return stmts.groupBy(F.col("predicate").alias("relation")).agg(F.count("*").alias("n"))


def checksum(x: Column) -> Column:
    """A sum over rows that doesn't depend on their order: of the first 15 hexadecimal digits of each row's digest."""
    return F.sum(F.conv(F.substring(F.sha2(x, 256), 1, 15), 16, 10).cast("decimal(20,0)")).cast("string")


def reduced(rows: DataFrame, least_weight: float = LEAST_WEIGHT) -> DataFrame:
    """(relation, start, end, n, r struct<line_no, weight>): rows that repeat as they stand as one with their number and the first; all that are not kept as one with nulls. One pass."""
    weight = weight_of(F.col("metadata"))
    kept = rows.withColumn("weight", F.when(F.col("relation").isin(list(RELATIONS)), weight)).withColumn("kept", fits(F.col("weight"), least_weight))
    own = lambda c: F.when(F.col("kept"), F.col(c)).alias(c)
    return kept.select("line_no", "weight", own("relation"), own("start"), own("end")).groupBy("relation", "start", "end").agg(F.count("*").alias("n"), F.min(F.struct("line_no", "weight")).alias("r"))


def per_triple(once: DataFrame, percent: float = PERCENT, seed: int = SEED) -> DataFrame:
    """(predicate, source, target, n, r struct<line_no, relation, weight>, taken) of reduced() rows."""
    df = projected(once.where("relation is not null").select(F.col("r.line_no").alias("line_no"), "relation", "start", "end", F.struct("n", "r.weight").alias("weight")))
    df = df.groupBy("predicate", "source", "target").agg(F.sum("weight.n").alias("n"), F.min(F.struct("line_no", "relation", F.col("weight.weight").alias("weight"))).alias("r"))
    return df.withColumn("taken", F.lit(True) if percent >= 100 else unit_score(F.col("predicate"), F.col("source"), F.col("target"), seed) < percent / 100)


def _totals(once: DataFrame, triples: DataFrame) -> DataFrame:
    """One row beside one row: what was scanned, and what became of it."""
    sums = triples.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("eligible"), F.coalesce(F.sum(F.when(F.col("taken"), F.col("n"))), F.lit(0)).alias("sampled"), F.count_if("taken").alias("deduped"))
    return once.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("scanned")).crossJoin(sums)


def counts(rows: DataFrame, least_weight: float = LEAST_WEIGHT, percent: float = PERCENT, seed: int = SEED) -> DataFrame:
    """(scanned, eligible, sampled, deduped) in one row; eligible is counted before sampling, sampled before deduplication."""
    once = written(reduced(rows, least_weight), "assertions-once")
    return _totals(once, per_triple(once, percent, seed))


def manifest(rows: DataFrame, source_file: str, max_rows: int = 0, least_weight: float = LEAST_WEIGHT, percent: float = PERCENT, seed: int = SEED) -> DataFrame:
    """One row: settings, counts, relations and checksums of one run. The rows are read once."""
    once = written(reduced(rows, least_weight), "assertions-once")
    triples = written(per_triple(once, percent, seed), "triples")
    stmts = statements(triples.where("taken").select("r.line_no", "r.relation", "predicate", "source", "target", "r.weight"))
    n = F.count("*")
    made = stmts.groupBy("predicate").agg(n.alias("n"), checksum(F.col("atom")).cast("decimal(38,0)").alias("a"), checksum(F.col("nl")).cast("decimal(38,0)").alias("v"))
    made = made.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("atom_count"), F.array_join(F.array_sort(F.collect_list(F.concat("predicate", F.lit("="), "n"))), ",").alias("relation_counts"), F.sum("a").cast("string").alias("atom_checksum"), F.sum("v").cast("string").alias("payload_checksum"))
    settings = [F.lit(source_file).alias("source_file"), F.lit(NORMALIZATION_VERSION).alias("normalization_version"), F.lit(float(least_weight)).alias("min_weight"), F.lit(float(percent)).alias("coverage_percent"), F.lit(seed).alias("sample_seed"), F.lit(max_rows).alias("max_rows")]
    return _totals(once, triples).crossJoin(made).select(*settings, "*")


def is_current(stored: dict | None, wanted: dict) -> bool:
    """Whether a stored manifest was made with the wanted settings; a missing one was not. A source file is compared as a path."""
    import os.path

    path = lambda x: os.path.abspath(str(x)) if x else ""
    return stored is not None and all((path(stored.get(k)) == path(wanted[k])) if k == "source_file" else stored.get(k) == wanted[k] for k in SETTINGS)
