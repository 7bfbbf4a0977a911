"""Structured extractions to statements and goals, with a table of what was rejected and why.

Extractions are (doc_id, ext_no, extraction_class, extraction_text, alignment_status, attributes) with attributes a
map<string, struct<is_list boolean, vals array<string>>>: a scalar is a list of one with is_list false. A list where a
scalar is required counts as missing. Optional is a column proper, a map of proper names of the document.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atomloom.functions import arrays as A
from atomloom.functions import symbols as S
from atomloom.operators.chaining import parse

#: Alignments that count as exact, classes of statements, attributes that may hold no variable, heads of structure and of class membership.
EXACT = ["MATCH_EXACT", "MATCH_GREATER", "MATCH_LESSER"]
CLASSES = ["fact", "type_decl", "property", "inheritance", "rule", "negation"]
GROUND_KEYS = ["subject", "object", "entity", "type", "value", "child", "parent"]
AND_HEADS, OR_NOT_HEADS = [",", "and", "And"], {"or": "Or", "Or": "Or", "not": "Not", "Not": "Not"}
MEMBERSHIP = ["isa", "Inheritance", "IsA", ":"]
SUFFIXES = {"fact": "fact", "type_decl": "type", "property": "property", "inheritance": "inheritance", "negation": "neg", "rule": "rule"}
#: The reasons that rejects are told with; what stands in braces is filled in.
MISSING, FEW, HOLLOW, NO_PREMISES = "missing required attribute '{}'", "{} requires at least one argument", "symbol cannot be empty", "rule body produced no premises"
FREE, NO_HEAD, NO_BODY, UNPARSEABLE = "free variable in '{}' for ", "rule has empty head_predicate", "rule has empty body", "rule body unparseable: "
FUZZY, UNSUPPORTED, UNSUPPORTED_QUERY, RULE_TARGET = "fuzzy alignment", "unsupported statement class '", "unsupported query class '", "query cannot target a rule"
TRUTH = "(STV 1.0 1.0)"
LONGEST_NAME = 80
PREMISES = "struct<premises:array<string>,parse_error:string,error:string>"


def attr(name: str) -> Column:
    return F.col("attributes")[name]


def scalar(name: str) -> Column:
    """The trimmed value; null if missing, blank or a list."""
    a = attr(name)
    return F.when(~a["is_list"], F.nullif(S.stripped(F.get(a["vals"], F.lit(0))), F.lit("")))


def items(name: str, split: bool = False, default: str | None = None) -> Column:
    a = attr(name)
    out = A.argument_list(a["is_list"], a["vals"], split)
    return out if default is None else F.when(a.isNull(), F.array(F.lit(default))).otherwise(out)


def has_free_variable(name: str) -> Column:
    return F.coalesce(F.exists(attr(name)["vals"], lambda v: v.rlike(r"^\s*[$?]")), F.lit(False))


def arg_text(x: Column, proper: Column | None) -> Column:
    """An argument as it stands in an atom; null if it is empty."""
    t = S.stripped(x)
    return F.when(t.rlike("^[$?]"), F.concat(F.lit("$"), S.snake(F.substring(t, F.lit(2), F.length(t)), True))).otherwise(S.snake(S.value(t, proper)))


def atom_text(head: Column, args: Column, proper: Column | None) -> Column:
    shown = F.when(head.isin(MEMBERSHIP) & (F.size(args) == 2), F.lit("IsA")).otherwise(S.pascal(S.predicate(head)))
    return F.concat(F.lit("("), F.array_join(F.concat(F.array(shown), F.transform(args, lambda a: arg_text(a, proper))), " "), F.lit(")"))


def name_text(head: Column, args: Column, suffix: Column, proper: Column | None) -> Column:
    own = F.transform(F.slice(args, 1, 2), lambda a: S.snake(S.value(F.regexp_replace(a, r"^[$?]+", ""), proper)))
    parts = F.concat(own, F.array(S.snake(S.predicate(head)), suffix))
    return F.left(F.array_join(F.filter(parts, lambda p: p != ""), "_"), F.lit(LONGEST_NAME))


# The same few rules on Python strings, for the bodies of rules, which nest to any depth.
def _snake(v: str, keep: bool = False) -> str:
    v = re.sub(r"[^A-Za-z0-9]+", "_", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", v.strip())).strip("_")
    return v if keep else v.lower()


def _pascal(v: str) -> str:
    parts = [p for p in re.split(r"[^A-Za-z0-9]+", v) if p]
    return v if v in S.PASCAL_KEPT or not parts else "".join(p[0].upper() + p[1:].lower() for p in parts)


def _singular(w: str) -> str:
    if len(w) <= 3 or w in S.INVARIANT_WORDS:
        return w
    if len(w) > 4 and w.endswith("ies"):
        return w[:-3] + "y"
    if len(w) > 4 and w.endswith("ses"):
        return w[:-2]
    keep = w.endswith(tuple(S.INVARIANT_ENDINGS)) or not w.endswith("s") or w.endswith(("ss", "us", "is"))
    return w if keep else w[:-1]


def _value(text: str, proper: dict) -> str:
    one = lambda t: t if t[0] in "$?" or re.search(r"-|\d", t) else proper.get(t.lower()) or _singular(t.lower())
    if not text.split():
        raise ValueError("symbol cannot be empty")
    return "-".join(map(one, text.split()))


def _render(e, proper: dict) -> str:
    if not isinstance(e, list) or not e:
        raise ValueError(f"predicate must be an S-expression: {e!r}")
    head = e[0]
    if not isinstance(head, str):
        head = str(head)
    if head in OR_NOT_HEADS or head in AND_HEADS:
        return f"({OR_NOT_HEADS.get(head, 'And')} {' '.join(_render(c, proper) for c in e[1:])})"
    shown = "IsA" if head in MEMBERSHIP and len(e) == 3 else _pascal(head.strip().lower().replace(" ", "-"))
    arg = lambda a: _render(a, proper) if isinstance(a, list) else "$" + _snake(a[1:], True) if a[0] in "$?" else _snake(_value(a, proper))
    return f"({' '.join([shown, *map(arg, e[1:])])})"


def _premises(e, proper: dict) -> list[str]:
    if not isinstance(e, list) or not e:
        raise ValueError(f"rule premise must be an expression: {e!r}")
    if e[0] in AND_HEADS:
        return [p for c in e[1:] for p in _premises(c, proper)]
    return [_render(e, proper)]


def rule_premises(body: Column, proper: Column | None) -> Column:
    """struct(premises, parse_error, error) of the body of a rule; a match wrapper is taken off, conjunctions are flattened, Or and Not kept."""

    @F.pandas_udf(PREMISES)
    def run(bodies: pd.Series, propers: pd.Series) -> pd.DataFrame:
        rows = []
        for body, names in zip(bodies, propers):
            if body is None:
                rows.append((None, None, None))
                continue
            try:
                e = parse(body)
            except ValueError as x:
                rows.append((None, str(x), None))
                continue
            try:
                if isinstance(e, list) and len(e) >= 4 and e[0] == "match" and e[1] == "&self":
                    e = e[2]
                rows.append((_premises(e, dict(names or {})), None, None))
            except ValueError as x:
                rows.append((None, None, str(x)))
        return pd.DataFrame(rows, columns=["premises", "parse_error", "error"])

    return run(body, F.create_map().cast("map<string,string>") if proper is None else proper)


def _expressions(ext: DataFrame) -> DataFrame:
    """Adds cls, ptext, head, args, problem (of a missing attribute), premises and payload of each extraction."""
    proper = F.col("proper") if "proper" in ext.columns else None
    cls = S.stripped(F.col("extraction_class"))
    ext = ext.withColumn("cls", F.coalesce(cls, F.lit(""))).withColumn("ptext", F.coalesce(S.stripped(F.col("extraction_text")), F.lit("")))
    ext = ext.withColumn("body", F.when(F.col("cls") == "rule", scalar("body"))).withColumn("r", rule_premises(F.col("body"), proper))
    subject_object = F.array_compact(F.array(scalar("subject"), scalar("object")))
    own = F.when(attr("arguments").isNotNull(), items("arguments")).otherwise(subject_object)
    of = lambda c: F.col("cls") == c
    needs = {"fact": ["predicate"], "negation": ["predicate"], "type_decl": ["entity", "type"], "property": ["entity", "property", "value"], "inheritance": ["child", "parent"], "rule": ["head_predicate", "body"], "query": ["predicate"]}
    missing = F.lit(None).cast("string")
    for c, names in needs.items():
        first = F.coalesce(*(F.when(scalar(n).isNull(), F.lit(MISSING.format(n))) for n in names))
        missing = F.when(of(c), first).otherwise(missing)
    asked = items("arguments", True)
    asked = F.when(F.size(asked) > 0, asked).otherwise(own)
    head = F.when(of("fact") | of("negation") | of("query"), scalar("predicate")).when(of("type_decl") | of("inheritance"), F.lit("isa")).when(of("property"), F.lit("has")).when(of("rule"), scalar("head_predicate"))
    args = (
        F.when(of("fact") | of("negation"), own).when(of("type_decl"), F.array(scalar("entity"), scalar("type"))).when(of("inheritance"), F.array(scalar("child"), scalar("parent")))
        .when(of("property"), F.array(scalar("entity"), scalar("property"), scalar("value"))).when(of("rule"), items("head_args", True, "$x")).when(of("query"), asked)
    )
    ext = ext.withColumn("head", head).withColumn("args", args)
    few = F.when(F.col("cls").isin("fact", "negation") & (F.size("args") == 0), FEW.format("fact")).when(of("query") & (F.size("args") == 0), FEW.format("query"))
    hollow = F.when(F.exists("args", lambda a: F.regexp_replace(a, r"^[$?]+", "") == ""), HOLLOW)
    body = F.when(of("rule") & (F.size("r.premises") == 0), NO_PREMISES)
    ext = ext.withColumn("problem", F.coalesce(missing, few, F.when(of("rule"), F.col("r.error")), body, hollow))
    atom = atom_text(F.col("head"), F.col("args"), proper)
    payload = F.when(of("negation"), F.concat(F.lit("(Not "), atom, F.lit(")"))).when(of("rule"), F.concat(F.lit("(Implication (Premises "), F.array_join("r.premises", " "), F.lit(") (Conclusions "), atom, F.lit("))"))).otherwise(atom)
    suffix = F.create_map(*(F.lit(x) for kv in SUFFIXES.items() for x in kv))[F.col("cls")]
    return ext.withColumn("payload", payload).withColumn("name", name_text(F.col("head"), F.col("args"), suffix, proper))


def _with_reason(ext: DataFrame, skip_fuzzy: bool) -> DataFrame:
    free = [F.when((F.col("cls") != "rule") & has_free_variable(k), F.concat(F.lit(FREE.format(k)), "cls")) for k in GROUND_KEYS]
    rule = F.when(F.col("cls") == "rule", F.when(scalar("head_predicate").isNull(), NO_HEAD).when(scalar("body").isNull(), NO_BODY).when(F.col("r.parse_error").isNotNull(), F.concat(F.lit(UNPARSEABLE), "r.parse_error")))
    fuzzy = F.when(F.col("alignment_status").isNotNull() & ~F.col("alignment_status").isin(EXACT), FUZZY) if skip_fuzzy else F.lit(None).cast("string")
    unknown = F.when(~F.col("cls").isin(CLASSES), F.concat(F.lit(UNSUPPORTED), "cls", F.lit("'")))
    return _expressions(ext).withColumn("reason", F.coalesce(fuzzy, unknown, *free, rule, F.col("problem")))


def translated(ext: DataFrame, skip_fuzzy: bool = True) -> DataFrame:
    """(doc_id, ext_no, statement) of the safe extractions; of equal statements of one document the first."""
    df = _with_reason(ext, skip_fuzzy).where("reason is null")
    text = F.concat(F.lit("(: "), "name", F.lit(" "), "payload", F.lit(f" {TRUTH})"))
    return df.groupBy("doc_id", text.alias("statement")).agg(F.min("ext_no").alias("ext_no")).select("doc_id", "ext_no", "statement")


def rejected(ext: DataFrame, skip_fuzzy: bool = True) -> DataFrame:
    """(doc_id, ext_no, extraction_class, extraction_text, reason) of the others."""
    return _with_reason(ext, skip_fuzzy).where("reason is not null").select("doc_id", "ext_no", F.col("cls").alias("extraction_class"), F.col("ptext").alias("extraction_text"), "reason")


def _as_queries(ext: DataFrame) -> DataFrame:
    parse_error = F.when(F.col("cls") == "rule", F.col("r.parse_error"))
    target = F.when(F.col("cls") == "rule", RULE_TARGET)
    unknown = F.when(~F.col("cls").isin([*CLASSES, "query"]), F.concat(F.lit(UNSUPPORTED_QUERY), "cls", F.lit("'")))
    return _expressions(ext).withColumn("reason", F.coalesce(unknown, F.col("problem"), parse_error, target))


def queries(ext: DataFrame) -> DataFrame:
    """(doc_id, ext_no, query): extractions as goals; of equal goals of one document the first. No alignment is asked for."""
    goal = F.concat(F.lit("(: $prf "), "payload", F.lit(" $tv)"))
    return _as_queries(ext).where("reason is null").groupBy("doc_id", goal.alias("query")).agg(F.min("ext_no").alias("ext_no")).select("doc_id", "ext_no", "query")


def query_rejects(ext: DataFrame) -> DataFrame:
    return _as_queries(ext).where("reason is not null").select("doc_id", "ext_no", F.col("cls").alias("extraction_class"), F.col("ptext").alias("extraction_text"), "reason")


def predicate_heads(ext: DataFrame) -> DataFrame:
    """(doc_id, head, first_ext): heads of predicates and rules as a session remembers them."""
    both = F.explode(F.array_compact(F.array(scalar("predicate"), scalar("head_predicate")))).alias("h")
    return ext.select("doc_id", "ext_no", both).groupBy("doc_id", S.predicate(F.col("h")).alias("head")).agg(F.min("ext_no").alias("first_ext"))
