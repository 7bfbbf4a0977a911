"""Statements and atoms as text: reading their parts, bringing their symbols to canonical form, filtering and pruning."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from atomloom.functions import arrays as A
from atomloom.functions import symbols as S
from atomloom.functions.symbols import let

WS = r"[\s\p{Z}]"
#: The forms that facts, conclusions, goals and statements have.
SIMPLE = r"^\(([A-Za-z][A-Za-z0-9_]*)((?:\s+[^()\s]+)*)\)$"
STATEMENT = r"^\(:\s+[^\s]+\s+(\(.+\))\s+\(STV\s+[^\s]+\s+[^\s]+\)\)$"
FACT = r"\(:\s+[^\s()]+\s+(\([^()]+\))\s+\((?:STV|PointMass|ParticleFromNormal|ParticleFromPairs)"
BLOCK = r"\s+((?:\([^()]+\)\s*)+)\)"
GOAL = r"\(:\s+[^\s()]+\s+(\([^()]+\))\s+\$?[A-Za-z_][A-Za-z0-9_]*\)"
GROUND_GOAL = r"^\(:\s+[$?][^\s]+\s+(\(.+\))\s+[$?][^\s]+\)$"
STV = r"\(STV\s+([^\s()]+)\s+([^\s()]+)\)\s*\)\s*$"
FLAT = r"\([^()]+\)"
ISA = r"\(IsA\s+([^()\s]+)\s+([^()\s]+)\)"
RUNS = r"[$?\p{L}_][\p{L}\p{N}_]*|[^$?\p{L}_]+"
TOKENS = "struct<tokens:array<string>,depths:array<int>,error:string>"


def collapsed(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, f"{WS}+", " "))


def null_if_empty(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def is_variable(x: Column) -> Column:
    return x.rlike(r"^[$?]")


def simple_atom(x: Column) -> Column:
    """struct(head, args, arity, variables) of an atom without inner parentheses; null for anything else."""

    def parts(t: Column) -> Column:
        args = F.filter(F.split(F.regexp_extract(t, SIMPLE, 2), r"\s+"), lambda a: a != "")
        whole = lambda a: F.struct(F.regexp_extract(t, SIMPLE, 1).alias("head"), a.alias("args"), F.size(a).alias("arity"), F.filter(a, is_variable).alias("variables"))
        return F.when(t.rlike(SIMPLE), let(args, whole))

    return let(S.stripped(x), parts)


def statement_body(x: Column) -> Column:
    """The body of a statement with a truth value of two fields, white space collapsed; null for anything else."""
    return null_if_empty(collapsed(F.regexp_extract(S.stripped(x), STATEMENT, 1)))


def statement_id(x: Column) -> Column:
    return null_if_empty(F.regexp_extract(x, r"^\s*\(:\s+([^\s()]+)", 1))


def truth_value(x: Column) -> Column:
    """struct(strength, confidence); both null if there is no such truth value at the end."""
    return F.struct(F.regexp_extract(x, STV, 1).try_cast("double").alias("strength"), F.regexp_extract(x, STV, 2).try_cast("double").alias("confidence"))


def kind(x: Column) -> Column:
    return F.when(F.contains(x, F.lit("(Implication")), "rule").when(F.size(fact_signatures(x)) > 0, "fact").otherwise("other")


def _parsed(atoms: Column) -> Column:
    return F.filter(F.transform(atoms, simple_atom), lambda a: a.isNotNull())


def fact_signatures(x: Column) -> Column:
    """Parsed flat atoms that a truth value or distribution follows, without implications."""
    return F.filter(_parsed(F.regexp_extract_all(x, F.lit(FACT), F.lit(1))), lambda a: a["head"] != "Implication")


def flat_atoms(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(FLAT), F.lit(0))


def conclusion_signatures(x: Column) -> Column:
    """Parsed flat atoms in the blocks of conclusions."""
    return _parsed(F.flatten(F.transform(F.regexp_extract_all(x, F.lit(r"\(Conclusions" + BLOCK), F.lit(1)), flat_atoms)))


def premises(x: Column) -> Column:
    """Flat atoms of the first block of premises that holds flat atoms only."""
    return flat_atoms(F.regexp_extract(x, r"\(Premises" + BLOCK, 1))


def goal_signature(x: Column) -> Column:
    """The parsed flat atom in goal position; null for nested goals and truth variables named with ?."""
    return simple_atom(F.regexp_extract(x, GOAL, 1))


def ground_goal(x: Column) -> Column:
    """The body of a goal with variable id and truth slot and no variable in it, white space collapsed; else null."""
    body = F.regexp_extract(S.stripped(x), GROUND_GOAL, 1)
    return F.when(~body.rlike(r"[$?]"), null_if_empty(collapsed(body)))


def goal_of(signature: Column) -> Column:
    """A signature as a goal; null for null."""
    return F.when(signature.isNotNull(), F.concat(F.lit("(: $prf ("), F.concat_ws(" ", signature["head"], F.array_join(signature["args"], " ")), F.lit(") $tv)")))


def canonical_atom(x: Column, proper: Column, concepts: Column, protected: Column) -> Column:
    """Every word of an atom in canonical form, all other characters as they are; ids are words too.

    After $ and ? names are not lemmatised; a word after an opening parenthesis is a head; others are looked up among
    proper names, then concepts, both maps from lower case; else they are made canonical, lemmatised if not protected.
    """

    def word(w: Column, before: Column) -> Column:
        low = F.lower(w)
        rest = lambda: S.canonical(F.substring(w, F.lit(2), F.length(w)), False)
        plain = F.when(F.array_contains(protected, low), S.canonical(w, False)).otherwise(S.canonical(w))
        return (
            F.when(~w.rlike(r"^[$?\p{L}_]"), w).when(is_variable(w), F.concat(F.left(w, F.lit(1)), rest())).when(F.coalesce(before, F.lit("")).rlike(r"\([\s\p{Z}]*$"), A.canonical_head(w)).otherwise(F.coalesce(proper[low], concepts[low], plain))
        )

    return let(F.regexp_extract_all(x, F.lit(RUNS), F.lit(0)), lambda runs: F.array_join(F.transform(runs, lambda w, i: word(w, F.when(i > 0, F.get(runs, i - 1)))), ""))


def canonical_classes(x: Column) -> Column:
    """The class of every flat IsA made canonical."""
    fixed = lambda m: F.concat(F.lit("(IsA "), F.regexp_extract(m, ISA, 1), F.lit(" "), S.canonical(F.regexp_extract(m, ISA, 2)), F.lit(")"))
    return let(F.regexp_extract_all(x, F.lit(ISA), F.lit(0)), lambda ms: F.array_join(F.transform(F.split(x, ISA), lambda p, i: F.concat(p, F.coalesce(fixed(F.get(ms, i)), F.lit("")))), ""))


def concept_map(concepts: Column, context: Column | None = None) -> Column:
    """Concepts and their plurals, each to the concept, overridden by a map of the symbols in the context."""
    own = A.entries_last(F.flatten(F.transform(concepts, lambda c: F.array(A.pair(c, c), A.pair(S.plural(c), c)))))
    if context is None:
        return own
    return F.map_concat(F.map_filter(own, lambda k, v: ~F.map_contains_key(context, k)), context)


def context_symbols(atoms: Column) -> Column:
    """A map: every ground argument of facts and conclusions, its singular and plural lead to it; the first wins. Facts of all atoms come before conclusions."""
    args = lambda f: F.flatten(F.transform(F.flatten(F.transform(F.array_compact(atoms), f)), lambda s: s["args"]))
    ground = F.array_distinct(F.filter(F.concat(args(fact_signatures), args(conclusion_signatures)), lambda a: ~is_variable(a)))

    def entries(a: Column) -> Column:
        s = S.canonical(a)
        return F.when(s == "", F.array(A.pair(a, a))).otherwise(F.array(A.pair(a, a), A.pair(s, a), A.pair(S.plural(s), a)))

    return A.entries_first(F.flatten(F.transform(ground, entries)))


def canonical_outputs(items: Column, concepts: Column, protected: Column, proper: Column) -> Column:
    """Atoms made canonical, classes lemmatised, repeated ones dropped; concepts is the map of concept_map()."""
    return A.dedupe(F.transform(items, lambda x: canonical_classes(canonical_atom(x, proper, concepts, protected))))


def keeps(statement: Column) -> Column:
    """False for implications without premises or conclusions and for other statements with a $ variable."""
    rule = F.contains(statement, F.lit("Implication"))
    whole = F.contains(statement, F.lit("(Premises")) & F.contains(statement, F.lit("(Conclusions"))
    return F.when(rule, whole).otherwise(~statement.rlike(r"\$[A-Za-z_]"))


def pruned(x: Column) -> Column:
    """A rule without its premises that only say what class a variable is of, unless these are all or none of several."""
    pattern = r"\(Premises" + BLOCK
    generic = lambda p: p.rlike(r"^\(IsA\s+[$?][^()\s]*\s+[^()\s]+\)$")

    def cut(all_: Column) -> Column:
        kept = F.filter(all_, lambda p: ~generic(p))
        block = F.regexp_extract(x, pattern, 0)
        at = F.instr(x, block)
        new = F.concat(F.left(x, at - 1), F.lit("(Premises "), F.array_join(kept, " "), F.lit(")"), F.substring(x, at + F.length(block), F.length(x)))
        return F.when(F.contains(x, F.lit("Implication")) & (F.size(all_) > 1) & (F.size(kept) > 0) & (F.size(kept) < F.size(all_)), new).otherwise(x)

    return let(premises(x), cut)


def processed(items: Column, concepts: Column, protected: Column, proper: Column) -> Column:
    """The whole of it: repeated ones dropped, made canonical, pruned, filtered."""
    return F.filter(F.transform(canonical_outputs(A.dedupe(items), concepts, protected, proper), pruned), keeps)


def tokenized(x: Column) -> Column:
    """struct(tokens, depths, error) of an expression; error is null for one well-formed expression.

    The depth of a parenthesis is that of what it encloses. One Arrow pass, linear in the text.
    """

    @F.pandas_udf(TOKENS)
    def run(texts: pd.Series) -> pd.DataFrame:
        import re

        find = re.compile(r"[()]|[^\s()]+").findall
        rows = []
        for t in texts:
            tokens, depths, depth, error, over = find(t or ""), [], 0, None, False
            for token in tokens:
                if over:
                    error = error or "unexpected trailing tokens"
                depth += token == "("
                depths.append(depth)
                if token == ")" and depth:
                    depth -= 1
                over = over or depth == 0
            if not tokens:
                error = "empty expression"
            elif depth:
                error = "missing closing parenthesis"
            rows.append((tokens, depths, error))
        return pd.DataFrame(rows, columns=["tokens", "depths", "error"])

    return run(x)
