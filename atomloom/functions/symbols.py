"""Scalar string functions on symbols, words and phrases, as Column expressions.

All stay in the JVM. Null gives null; an empty string gives an empty one unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words and endings that the second singular rule leaves alone.
INVARIANT_WORDS = ["series", "species", "rabies", "news", "physics", "mathematics", "economics", "electronics", "ethics", "politics"]
INVARIANT_ENDINGS = ["ics", "ous", "ness", "ship", "ment"]
#: Names that the pascal form leaves alone.
PASCAL_KEPT = ["IsA", "And", "Or", "Not"]
#: Fixed value: concept paths of the language that is kept begin so.
LANGUAGE_PREFIX = "/c/en/"
ARTICLES = ["a", "an", "the"]


def let(x: Column, body) -> Column:
    """body(x) with x evaluated once: a column used within a lambda would else be computed anew for every element."""
    return F.get(F.transform(F.array(x), lambda v: body(v)), F.lit(0))


def stripped(x: Column) -> Column:
    """Without outer white space of any kind."""
    return F.regexp_replace(x, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def normalize_text(x: Column) -> Column:
    """Lower-case words of a-z and 0-9 with one space between; all else separates."""
    return F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))


def singular(w: Column) -> Column:
    """By suffix only: -ies, -ses, -s; no irregular words. Words of up to three letters stay."""
    n = F.length(w)
    return (
        F.when(n <= 3, w)
        .when(w.endswith("ies") & (n > 4), F.concat(F.left(w, n - 3), F.lit("y")))
        .when(w.endswith("ses") & (n > 4), F.left(w, n - 2))
        .when(w.endswith("s") & ~w.rlike("(ss|us|is)$"), F.left(w, n - 1))
        .otherwise(w)
    )


def plural(w: Column) -> Column:
    n = F.length(w)
    return F.when(w.endswith("y") & (n > 2), F.concat(F.left(w, n - 1), F.lit("ies"))).when(w.rlike("(s|x|z|ch|sh)$"), F.concat(w, F.lit("es"))).otherwise(F.concat(w, F.lit("s")))


def singular_guarded(w: Column) -> Column:
    """singular() with words and endings that stay: the words before all suffix rules, the endings after -ies and -ses."""
    n = F.length(w)
    return (
        F.when((n <= 3) | w.isin(INVARIANT_WORDS), w)
        .when(w.endswith("ies") & (n > 4), F.concat(F.left(w, n - 3), F.lit("y")))
        .when(w.endswith("ses") & (n > 4), F.left(w, n - 2))
        .when(w.rlike(f"({'|'.join(INVARIANT_ENDINGS)})$"), w)
        .when(w.endswith("s") & ~w.rlike("(ss|us|is)$"), F.left(w, n - 1))
        .otherwise(w)
    )


def camel_cut(x: Column) -> Column:
    return F.regexp_replace(x, "(?<=[a-z0-9])(?=[A-Z])", "_")


def snake(x: Column, keep_case: bool = False) -> Column:
    """Parts of letters and digits joined by one underscore; camel case is cut. Not lemmatised."""
    out = F.regexp_replace(F.regexp_replace(camel_cut(x), "[^A-Za-z0-9]+", "_"), "^_|_$", "")
    return out if keep_case else F.lower(out)


def singular_parts(s: Column) -> Column:
    """singular() on every part between underscores, as three replacements that stay in generated code; \x01 keeps a cut -ses from the next rule."""
    s = F.regexp_replace(s, r"(^|_)([^_]{2,})ies(?=_|$)", "$1$2y")
    s = F.regexp_replace(s, r"(^|_)([^_]{2,}s)es(?=_|$)", "$1$2\u0001")
    s = F.regexp_replace(s, r"(^|_)([^_\x01]{2,}[^_\x01sui])s(?=_|$)", "$1$2")
    return F.replace(s, F.lit("\u0001"), F.lit(""))


def canonical(x: Column, lemmatize: bool = True) -> Column:
    """snake() with every part made singular; a token of other letters only becomes empty."""
    return singular_parts(snake(x)) if lemmatize else snake(x)


def kebab(x: Column) -> Column:
    return F.replace(snake(x), F.lit("_"), F.lit("-"))


def pascal(x: Column) -> Column:
    """Parts capitalised with the rest lowered (usedFor gives Usedfor); four names pass through."""
    parts = F.filter(F.split(x, "[^A-Za-z0-9]+"), lambda p: p != "")
    joined = F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.lower(F.substring(p, F.lit(2), F.length(p))))), "")
    return F.when(x.isin(PASCAL_KEPT) | (F.size(parts) == 0), x).otherwise(joined)


def value_token(t: Column, proper: Column | None = None) -> Column:
    """A token of a value: variables and tokens with a hyphen or digit stay, proper names keep their source case, others are lowered and made singular."""
    plain = singular_guarded(F.lower(t))
    known = F.coalesce(proper[F.lower(t)], plain) if proper is not None else plain
    return F.when(t.rlike(r"^[$?]|-|\d"), t).otherwise(known)


def value(x: Column, proper: Column | None = None) -> Column:
    """Tokens of a value joined by hyphens; null for a blank value, which is an error to the caller."""
    parts = F.filter(F.split(x, r"[\s\p{Z}]+"), lambda p: p != "")
    return F.when(F.size(parts) > 0, F.array_join(F.filter(F.transform(parts, lambda p: value_token(p, proper)), lambda p: p != ""), "-"))


def predicate(x: Column) -> Column:
    """Trimmed, lower, spaces to hyphens; null for a blank one, which is an error to the caller."""
    t = stripped(x)
    return F.when(t != "", F.replace(F.lower(t), F.lit(" "), F.lit("-")))


def slug(x: Column) -> Column:
    return F.translate(F.lower(x), " -", "__")


def clean_concept(uri: Column) -> Column:
    """Canonical form of the concept of a path in the language kept; null for other paths."""
    return F.when(uri.startswith(LANGUAGE_PREFIX), canonical(F.split_part(F.substring(uri, F.lit(len(LANGUAGE_PREFIX) + 1), F.length(uri)), F.lit("/"), F.lit(1))))


def canonical_phrase(x: Column) -> Column:
    """Words without articles, canonical, joined by underscores (socrates becomes socrate)."""
    words = F.filter(F.split(normalize_text(x), " "), lambda w: (w != "") & ~w.isin(ARTICLES))
    return F.array_join(F.filter(F.transform(words, lambda w: canonical(w)), lambda w: w != ""), "_")


def model_name(x: Column) -> Column:
    return F.regexp_replace(x, "^openai/", "")


def first_nonempty(*xs: Column) -> Column:
    """The first value that isn't blank, as it stands; null if none."""
    return F.coalesce(*(F.when(stripped(x) != "", x) for x in xs))
