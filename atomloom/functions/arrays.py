"""Functions on lists of words, atoms and arguments, as Column expressions. Order is that of the input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from atomloom.functions import symbols as S

#: Words that are no concepts.
STOP_WORDS = "a an and are as at be by for from how in is it of on or that the this to was were what when where who why with does do did can could would should has have had if then than into about after before under over not no yes".split()
#: Heads of the language itself, which are no predicates of a domain; and those the translator knows.
STRUCTURAL_HEADS = ["Implication", "Premises", "Conclusions", "STV", "And", "Or", "Not", "IsA", "PointMass", "ParticleFromNormal", "ParticleFromPairs", "GreaterThan", "MapDist", "Map2Dist", "AverageDist", "FoldAll", "FoldAllValue", "Compute"]
TRANSLATOR_HEADS = ["Implication", "Premises", "Conclusions", "STV", "And", "Or", "Not", "IsA"]
#: Other names of predicates, by their canonical form.
PREDICATE_ALIASES = {
    "isa": "IsA", "is_a": "IsA", "kind_of": "IsA", "type_of": "IsA", "located_at": "AtLocation", "locatedat": "AtLocation", "used_for": "UsedFor", "usedfor": "UsedFor",
    "capable_of": "CapableOf", "capableof": "CapableOf", "part_of": "PartOf", "partof": "PartOf",
}
MOST_CONCEPTS = MOST_HEADS = 12
HINTED_HEADS = 24
CAPITALISED = r"(?U)\b[A-Z][A-Za-z0-9_-]*\b"
HEAD = r"\(([A-Za-z][A-Za-z0-9_]*)"


def extract_concepts(x: Column, most: int = MOST_CONCEPTS) -> Column:
    """Singular forms of words of three letters and more that are no stop words, each once, the first ones."""
    words = F.filter(F.split(S.normalize_text(x), " "), lambda w: (F.length(w) >= 3) & ~w.isin(STOP_WORDS))
    return F.slice(F.array_distinct(F.transform(words, S.singular)), 1, most)


def capitalised(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(CAPITALISED), F.lit(0))


def constants(x: Column) -> Column:
    """Capitalised words in canonical form, not lemmatised, each once, in order: the protected constants of a text or question."""
    return F.array_distinct(F.filter(F.transform(capitalised(x), lambda w: S.canonical(w, False)), lambda w: w != ""))


def entries_last(pairs: Column) -> Column:
    """A map from (key, value) structs in which the last value of a key counts."""
    return entries_first(F.reverse(pairs))


def entries_first(pairs: Column) -> Column:
    """A map from (key, value) structs in which the first value of a key counts. Quadratic in the number of pairs: pass distinct ones."""
    own = lambda ps, ks: F.filter(F.transform(ps, lambda p, i: F.when(F.array_position(ks, p["key"]) == i + 1, p)), lambda p: p.isNotNull())
    return F.map_from_entries(S.let(pairs, lambda ps: S.let(F.transform(ps, lambda p: p["key"]), lambda ks: own(ps, ks))))


def pair(key: Column, value: Column) -> Column:
    return F.struct(key.alias("key"), value.alias("value"))


def proper_name_map(x: Column) -> Column:
    """Each capitalised word, sentence-initial ones too, from its canonical and its singular form to the canonical one; later words win."""
    last = F.reverse(F.array_distinct(F.reverse(capitalised(x))))
    words = F.filter(F.transform(last, lambda w: F.struct(S.canonical(w, False).alias("c"), S.canonical(w).alias("s"))), lambda w: w["c"] != "")
    pairs = F.flatten(F.transform(words, lambda w: F.when((w["s"] != "") & (w["s"] != w["c"]), F.array(pair(w["c"], w["c"]), pair(w["s"], w["c"]))).otherwise(F.array(pair(w["c"], w["c"])))))
    return entries_last(pairs)


def canonical_head(h: Column) -> Column:
    """Structural heads as they are, other names of known predicates by the known name, all others unchanged."""
    alias = F.create_map(*(F.lit(x) for kv in PREDICATE_ALIASES.items() for x in kv))
    return F.when(h.isin(STRUCTURAL_HEADS), h).otherwise(F.coalesce(alias[S.canonical(h, False)], h))


def context_heads(atoms: Column, most: int = MOST_HEADS) -> Column:
    """Heads in the atoms, structural ones too, by their known names, each once, the first ones."""
    found = F.flatten(F.transform(F.array_compact(atoms), lambda a: F.regexp_extract_all(a, F.lit(HEAD), F.lit(1))))
    return F.slice(F.array_distinct(F.transform(found, canonical_head)), 1, most)


def domain_heads(atoms: Column) -> Column:
    """Heads in the atoms as written without those the translator knows, each once; no limit."""
    found = F.flatten(F.transform(F.array_compact(atoms), lambda a: F.regexp_extract_all(a, F.lit(HEAD), F.lit(1))))
    return F.array_distinct(F.filter(found, lambda h: ~h.isin(TRANSLATOR_HEADS)))


def dedupe(xs: Column) -> Column:
    """White space collapsed, blanks dropped, the first of equal ones kept."""
    return F.array_distinct(F.filter(F.transform(xs, lambda x: F.trim(F.regexp_replace(x, r"[\s\p{Z}]+", " "))), lambda x: x != ""))


def dedupe_trimmed(xs: Column) -> Column:
    """As dedupe, but only outer white space goes."""
    return F.array_distinct(F.filter(F.transform(xs, S.stripped), lambda x: x != ""))


def argument_list(is_list: Column, vals: Column, split_strings: bool = False) -> Column:
    """Arguments of an attribute: a list gives its non-blank items; a scalar itself, or its parts at commas, else at white space, if asked."""
    items = F.filter(F.transform(vals, S.stripped), lambda v: v != "")
    one = F.coalesce(F.try_element_at(items, F.lit(1)), F.lit(""))
    parts = F.filter(F.transform(F.split(one, ","), S.stripped), lambda v: v != "") if split_strings else F.array(one)
    spaced = F.filter(F.split(one, r"[\s\p{Z}]+"), lambda v: v != "")
    scalar = F.when(one == "", F.array().cast("array<string>")).otherwise(F.when(one.contains(","), parts).otherwise(spaced) if split_strings else parts)
    return F.when(vals.isNull(), F.array().cast("array<string>")).when(is_list, items).otherwise(scalar)


def vocabulary_hint(heads: Column) -> Column:
    """A line that maps up to 24 heads to their kebab form; empty without heads."""
    shown = F.transform(F.slice(heads, 1, HINTED_HEADS), lambda h: F.concat(h, F.lit("->"), S.kebab(h)))
    return F.array_join(shown, ", ")
