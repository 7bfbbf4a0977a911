"""Rule chaining as joins over fact tables, round by round until nothing improves.

A fact is a head with arguments, a strength and a confidence. A rule's premises are joined on the variables they
share. The strength of a conclusion is the rule's times those of the premises, its confidence the least of all; of
several proofs of one fact each of the two is maximised on its own, which reaches a fixpoint for cyclic rules too: they
are bounds that need not come from one proof.

A fact whose truth value is a distribution has a value (mean and standard deviation) besides. Premises can compute from
bound values, map distributions, and average or fold over all matches of a pattern; what they read has to be complete
before, so their rules are fired in strata.
"""

from __future__ import annotations

import re
import time
import warnings
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atomloom.session import written

MOST_ROUNDS, TIMEOUT_S = 100, 30.0
COMPARISONS = {"GreaterThan": "gt", "LessThan": "lt", "GreaterOrEqual": "ge", "LessOrEqual": "le", "Different": "ne"}
#: The forms of premises that yield a value, with the number of parts before their arrow.
YIELDING = {"Compute": 2, "MapDist": 2, "Map2Dist": 3, "AverageDist": 1, "FoldAll": 4, "FoldAllValue": 4}
VALUE = "struct<mu:double,sigma:double>"
FACT = "head string, args array<string>, strength double, confidence double, steps int, trace array<string>"
_TOKEN = re.compile(r"[()]|[^\s()]+")


def parse(text: str):
    """An expression as nested lists of words."""
    stack, done = [[]], None
    for t in _TOKEN.findall(text):
        if done is not None:
            raise ValueError("unexpected trailing tokens")
        if t == "(":
            stack.append([])
        elif t == ")":
            if len(stack) < 2:
                raise ValueError("unexpected closing parenthesis")
            top = stack.pop()
            stack[-1].append(top)
        else:
            stack[-1].append(t)
        if len(stack) == 1:
            done = stack[0][0]
    if done is None:
        raise ValueError("empty expression" if stack == [[]] else "missing closing parenthesis")
    return done


def is_var(x: str) -> bool:
    return x[:1] in "$?"


@dataclass(frozen=True)
class Atom:
    head: str
    args: tuple[str, ...]

    @staticmethod
    def of(e) -> "Atom":
        """A flat atom; Not of one has a head of its own, so it meets explicit negations only."""
        if e[0] == "Not" and len(e) == 2 and isinstance(e[1], list):
            inner = Atom.of(e[1])
            return Atom(f"Not {inner.head}", inner.args)
        if any(isinstance(x, list) for x in e):
            raise ValueError(f"not a flat atom: {e}")
        return Atom(e[0], tuple(e[1:]))

    @property
    def variables(self) -> list[str]:
        return list(dict.fromkeys(a for a in self.args if is_var(a)))


@dataclass(frozen=True)
class Term:
    """A premise that is no atom: a comparison with distributions in it, or one of YIELDING with the variable it binds.

    patterns are the atoms it reads; args are values, variables or, for a pattern, its number as an int.
    """

    op: str
    args: tuple
    patterns: tuple[Atom, ...] = ()
    out: str | None = None

    @staticmethod
    def of(e) -> "Term | None":
        """The term of an expression, None if it is an atom."""
        patterns: list[Atom] = []

        def part(x):
            if not isinstance(x, list):
                return x
            patterns.append(Atom.of(x))
            return len(patterns) - 1

        if e[0] in COMPARISONS and len(e) == 3 and any(isinstance(x, list) for x in e[1:]):
            args = tuple(map(part, e[1:]))
            return Term(e[0], args, tuple(patterns))
        if e[0] not in YIELDING:
            return None
        n = YIELDING[e[0]]
        if len(e) != n + 3 or e[n + 1] != "->" or not isinstance(e[n + 2], str) or not is_var(e[n + 2]):
            raise ValueError(f"{e[0]} takes {n} parts, an arrow and a variable: {_text(e)}")
        if e[0] == "Compute":
            if not isinstance(e[2], list) or any(isinstance(x, list) for x in e[2]):
                raise ValueError(f"Compute takes a list of values: {_text(e)}")
            args = (e[1], *e[2])
        else:
            args = tuple(map(part, e[1 : n + 1]))
            if len(patterns) != (2 if e[0] == "Map2Dist" else 1):
                raise ValueError(f"{e[0]} lacks a pattern: {_text(e)}")
        known = {"Compute": FUNCTIONS, "MapDist": MAPS, "Map2Dist": FUNCTIONS, "FoldAll": FOLDED, "FoldAllValue": FOLDED}.get(e[0])
        name = args[3] if e[0].startswith("FoldAll") else args[0]
        if known is not None and name not in known:
            raise ValueError(f"unknown function {name}: {sorted(known)}")
        if e[0] == "Compute" and len(args) != 3:
            raise ValueError(f"Compute takes two values: {_text(e)}")
        return Term(e[0], args, tuple(patterns), e[n + 2])

    @property
    def variables(self) -> list[str]:
        """Variables it needs or can share with other premises."""
        own = [a for a in self.args if isinstance(a, str) and is_var(a)]
        return list(dict.fromkeys([*own, *(v for p in self.patterns for v in p.variables)]))


def _text(e) -> str:
    return e if isinstance(e, str) else f"({' '.join(map(_text, e))})"


@dataclass(frozen=True)
class Rule:
    name: str
    premises: tuple["Atom | Term", ...]
    conclusion: Atom
    strength: float = 1.0
    confidence: float = 1.0


def compiled(texts: list[str]) -> tuple[list[Rule], list[tuple[str, str]]]:
    """The rules of statements, and those that can't be compiled with the reason: these prove nothing."""
    out, skipped = [], []
    for t in texts:
        try:
            out += rules(t)
        except (ValueError, KeyError, IndexError) as e:
            skipped.append((t, str(e)))
    return out, skipped


def rules(text: str) -> list[Rule]:
    """The rules of one statement: one for each way through its Or premises and for each conclusion."""
    e = parse(text)
    if len(e) != 4 or e[0] != ":" or e[2][0] != "Implication":
        raise ValueError("not a rule")
    blocks = {b[0]: b[1:] for b in e[2][1:]}
    tv = e[3]
    strength, confidence = (float(tv[1]), float(tv[2])) if tv[0] == "STV" else (1.0, 1.0)

    def ways(p) -> list[list[Atom]]:
        if p[0] in ("And", "Or") and all(isinstance(c, list) for c in p[1:]):
            each = [ways(c) for c in p[1:]]
            if p[0] == "Or":
                return [w for ws in each for w in ws]
            out: list[list[Atom]] = [[]]
            for ws in each:
                out = [a + w for a in out for w in ws]
            return out
        return [[Term.of(p) or Atom.of(p)]]

    if not blocks.get("Premises") or not blocks.get("Conclusions"):
        raise ValueError("a rule without premises or conclusions")
    out = []
    for way in ways(["And", *blocks["Premises"]]):
        for c in blocks["Conclusions"]:
            conclusion = Atom.of(c)
            free = set(conclusion.variables) - {v for a in way for v in (*a.variables, getattr(a, "out", None))}
            if free:
                raise ValueError(f"{sorted(free)} in a conclusion but in no premise")
            out.append(Rule(e[1], tuple(way), conclusion, strength, confidence))
    return out


def distribution(x) -> "F.Column":
    """struct(mu, sigma) of the distribution at the end of a statement: a point, a normal one, or pairs of value and weight by their moments; null if there is none."""
    number = r"([^\s()]+)"
    point = F.regexp_extract(x, rf"\(PointMass\s+{number}\s*\)\s*\)\s*$", 1).try_cast("double")
    normal = [F.regexp_extract(x, rf"\(ParticleFromNormal\s+{number}\s+{number}\s*\)\s*\)\s*$", i).try_cast("double") for i in (1, 2)]
    block = F.regexp_extract(x, r"\(ParticleFromPairs\s+(\(.*\))\s*\)\s*\)\s*$", 1)
    pair = rf"\(\s*{number}\s+{number}\s*\)"
    of = lambda i: F.transform(F.regexp_extract_all(block, F.lit(pair), F.lit(i)), lambda v: v.try_cast("double"))
    both = F.filter(F.arrays_zip(of(1).alias("x"), of(2).alias("w")), lambda p: p["x"].isNotNull() & (p["w"] > 0))
    total = lambda f: F.aggregate(both, F.lit(0.0), lambda t, p: t + f(p))
    weight = F.nullif(total(lambda p: p["w"]), F.lit(0.0))
    mean = total(lambda p: p["x"] * p["w"]) / weight
    spread = F.sqrt(F.greatest(F.lit(0.0), total(lambda p: p["x"] * p["x"] * p["w"]) / weight - mean * mean))
    value = lambda m, s: F.struct(m.alias("mu"), s.alias("sigma"))
    return F.when(point.isNotNull(), value(point, F.lit(0.0))).when(normal[0].isNotNull() & (normal[1] >= 0), value(*normal)).when(mean.isNotNull(), value(mean, spread))


def facts_of(statements: DataFrame, raw: str = "raw") -> DataFrame:
    """Stored statements that are flat facts, as a table for chaining with a column value; Not facts and those with a distribution too. Others are left out."""
    from atomloom.operators import atoms as A

    inner = F.regexp_extract(F.col(raw), r"^\s*\(:\s+[^\s()]+\s+\(Not\s+(\([^()]+\))\s*\)\s+\(STV", 1)
    spread = F.regexp_extract(F.col(raw), r"^\s*\(:\s+[^\s()]+\s+(\([^()]+\))\s+\((?:PointMass|ParticleFromNormal|ParticleFromPairs)", 1)
    x = F.when(inner != "", inner).when(spread != "", spread).otherwise(A.statement_body(F.col(raw)))
    df = statements.select(A.simple_atom(x).alias("a"), (inner != "").alias("neg"), A.truth_value(F.col(raw)).alias("tv"), A.statement_id(F.col(raw)).alias("id"), F.when(spread != "", distribution(F.col(raw))).alias("value"), (spread != "").alias("dist"))
    df = df.where("a is not null and (value is not null or not dist)")
    one = lambda c: F.when(F.col("dist"), F.lit(1.0)).otherwise(F.col(f"tv.{c}")).alias(c)
    return df.select(F.when(F.col("neg"), F.concat(F.lit("Not "), "a.head")).otherwise(F.col("a.head")).alias("head"), F.col("a.args").alias("args"), one("strength"), one("confidence"), F.lit(0).alias("steps"), F.array("id").alias("trace"), "value")


def matches(facts: DataFrame, atom: Atom, prefix: str) -> DataFrame:
    """Bindings of an atom's variables, each a column named after it, with truth value, steps and trace of the fact."""
    cond = (F.col("head") == atom.head) & (F.size("args") == len(atom.args))
    seen: dict[str, int] = {}
    for i, a in enumerate(atom.args):
        if not is_var(a):
            cond &= F.get("args", F.lit(i)) == a
        elif a in seen:
            cond &= F.get("args", F.lit(i)) == F.get("args", F.lit(seen[a]))
        else:
            seen[a] = i
    extra = ("value",) if "value" in facts.columns else ()
    return facts.where(cond).select(*(F.get("args", F.lit(i)).alias(v) for v, i in seen.items()), *(F.col(c).alias(f"{prefix}{c}") for c in ("strength", "confidence", "steps", "trace", *extra)))


def _compared(df: DataFrame, atom: Atom) -> DataFrame:
    l, r = (F.col(f"`{a}`") if is_var(a) else F.lit(a) for a in atom.args)
    if atom.head == "Different":
        return df.where(l != r)
    l, r = l.try_cast("double"), r.try_cast("double")
    return df.where({"gt": l > r, "lt": l < r, "ge": l >= r, "le": l <= r}[COMPARISONS[atom.head]])


def fire(rule: Rule, tables: list[DataFrame]) -> DataFrame:
    """What a rule concludes when premise i is matched in tables[i]. Comparisons are conditions on values bound before."""
    df, tests, used, value = None, [], [], None
    atoms = [(i, a) for i, a in enumerate(rule.premises) if isinstance(a, Atom)]
    terms = [(i, a) for i, a in enumerate(rule.premises) if isinstance(a, Term)]
    valued = "value" in tables[0].columns
    for i, atom in atoms:
        if atom.head in COMPARISONS:
            tests.append(atom)
            continue
        df = _joined(df, matches(tables[i], atom, f"p{i}_"), rule)
        used.append(f"p{i}_")
    for i, term in terms:
        others = {v for j, a in enumerate(rule.premises) if j != i for v in (*a.variables, getattr(a, "out", None))} | set(rule.conclusion.variables)
        df, value = _with_term(df, term, tables[i], f"p{i}_", others, rule, used), term.out if term.out and term.op != "Compute" else value
    for atom in tests:
        df = _compared(df, atom)
    strength, least, steps = F.lit(rule.strength), F.lit(rule.confidence), F.lit(1)
    for p in used:
        strength, steps = strength * F.col(f"{p}strength"), steps + F.col(f"{p}steps")
    least = F.least(least, *(F.col(f"{p}confidence") for p in used))
    args = F.array(*((F.col(f"`{a}`").cast("string") if a in df.columns and df.schema[a].dataType.typeName() != "struct" else F.col(f"`{a}`")["mu"].cast("string")) if is_var(a) else F.lit(a) for a in rule.conclusion.args))
    shown = [F.lit(rule.conclusion.head).alias("head"), args.alias("args"), strength.alias("strength"), least.alias("confidence"), steps.alias("steps"), F.concat(F.array(F.lit(rule.name)), *(F.col(f"{p}trace") for p in used)).alias("trace")]
    if valued or value:
        shown.append((F.col(f"`{value}`") if value else F.lit(None)).cast(VALUE).alias("value"))
    return df.select(*shown)


def _joined(df: DataFrame | None, m: DataFrame, rule: Rule) -> DataFrame:
    if df is None:
        return m
    for one, other in ((m, df), (df, m)):  # an atom without variables is one fact, there or not
        if not any(is_var(c) for c in one.columns):
            return other.crossJoin(F.broadcast(one.limit(1)))
    shared = [v for v in m.columns if is_var(v) and v in df.columns]
    if not shared:
        raise ValueError(f"premises of {rule.name} share no variable")
    return df.join(m, shared)


def _number(df: DataFrame, a):
    """A value as struct(mu, sigma): of a bound variable, a distribution or a number, or of a constant."""
    if is_var(a):
        if a not in df.columns:
            raise ValueError(f"{a} is not bound")
        if df.schema[a].dataType.typeName() == "struct":
            return F.col(f"`{a}`")
        return F.struct(F.col(f"`{a}`").try_cast("double").alias("mu"), F.lit(0.0).alias("sigma"))
    return F.struct(F.lit(a).try_cast("double").alias("mu"), F.lit(0.0).alias("sigma"))


def _with_term(df: DataFrame | None, t: Term, facts: DataFrame, prefix: str, others: set, rule: Rule, used: list[str]) -> DataFrame:
    """df with what a term binds, or without the rows its comparison denies."""
    if t.op == "Compute":
        a, b = (_number(df, x)["mu"] for x in t.args[1:])
        return df.withColumn(t.out, FUNCTIONS[t.args[0]](a, b)).where(F.col(f"`{t.out}`").isNotNull())
    if "value" not in facts.columns:
        facts = facts.withColumn("value", F.lit(None).cast(VALUE))
    for n, p in enumerate(t.patterns):
        m, own = matches(facts, p, f"{prefix}{n}_"), f"{prefix}{n}_"
        if t.op in ("AverageDist", "FoldAll", "FoldAllValue"):
            keys = [v for v in p.variables if v in others]
            if t.op == "AverageDist":  # of independent distributions
                mean = F.avg(F.col(f"{own}value.mu"))
                out = F.struct(mean.alias("mu"), (F.sqrt(F.sum(F.col(f"{own}value.sigma") * F.col(f"{own}value.sigma"))) / F.count(f"{own}value.mu")).alias("sigma"))
                m = m.where(F.col(f"{own}value").isNotNull())
            else:
                v = t.args[1]
                x = F.col(f"`{v}`").try_cast("double") if v in p.variables else F.col(f"{own}value.mu") if is_var(v) else F.lit(v).try_cast("double")
                out = F.struct(FOLDED[t.args[3]](x, F.lit(t.args[2]).try_cast("double")).alias("mu"), F.lit(0.0).alias("sigma"))
            m = m.groupBy(*(F.col(f"`{k}`") for k in keys)).agg(out.alias(t.out), F.min(f"{own}strength").alias(f"{own}strength"), F.min(f"{own}confidence").alias(f"{own}confidence"), F.max(f"{own}steps").alias(f"{own}steps"), F.count("*").alias(f"{own}n"))
            m = m.where(F.col(f"{own}n") > 0).where(F.col(f"`{t.out}`.mu").isNotNull()).drop(f"{own}n").withColumn(f"{own}trace", F.array().cast("array<string>"))
        else:
            m = m.where(F.col(f"{own}value").isNotNull())
        if df is not None and t.out in m.columns and not any(is_var(c) and c != t.out for c in m.columns):
            df = df.crossJoin(F.broadcast(m.limit(1)))  # one row: an aggregate over all
        else:
            df = _joined(df, m, rule)
        used.append(own)
    side = lambda a: F.col(f"{prefix}{a}_value") if isinstance(a, int) else _number(df, a)
    if t.op in COMPARISONS:
        l, r = (side(a)["mu"] for a in t.args)
        return df.where({"gt": l > r, "lt": l < r, "ge": l >= r, "le": l <= r, "ne": l != r}[COMPARISONS[t.op]])
    if t.op == "MapDist":
        f, slope = MAPS[t.args[0]]
        x = F.col(f"{prefix}0_value")
        return df.withColumn(t.out, F.struct(f(x["mu"]).alias("mu"), (x["sigma"] * F.abs(slope(x["mu"]))).alias("sigma"))).where(F.col(f"`{t.out}`.mu").isNotNull())
    if t.op == "Map2Dist":
        a, b = F.col(f"{prefix}0_value"), F.col(f"{prefix}1_value")
        return df.withColumn(t.out, F.struct(FUNCTIONS[t.args[0]](a["mu"], b["mu"]).alias("mu"), SPREADS[t.args[0]](a, b).alias("sigma"))).where(F.col(f"`{t.out}`.mu").isNotNull())
    return df


def best(df: DataFrame) -> DataFrame:
    """One row for each fact: strength and confidence each at its greatest, the trace of the strongest proof, then of the one with fewest steps, then the least ids."""
    extra = ["value"] if "value" in df.columns else []
    order = F.struct((-F.col("strength")).alias("a"), (-F.col("confidence")).alias("b"), "steps", "trace", *extra)
    out = df.groupBy("head", "args").agg(F.max("strength").alias("strength"), F.max("confidence").alias("confidence"), F.min(order).alias("o"))
    return out.select("head", "args", "strength", "confidence", "o.steps", "o.trace", *(f"o.{c}" for c in extra))


class Unfinished(RuntimeError):
    """Chaining ended by time or rounds while facts still improved."""


def strata(rule_list: list[Rule]) -> list[list[Rule]]:
    """The rules in the order in which they can be fired: one with terms after all rules that make what its patterns read."""
    level = {r.conclusion.head: 0 for r in rule_list}
    for n in range(len(rule_list) + 2):
        before = dict(level)
        for r in rule_list:
            flat = [level.get(a.head, 0) for a in r.premises if isinstance(a, Atom)]
            read = [level.get(p.head, 0) + 1 if p.head in level else 0 for t in r.premises if isinstance(t, Term) for p in t.patterns]
            level[r.conclusion.head] = max(level[r.conclusion.head], *flat, *read, 0)
        if level == before:
            return [[r for r in rule_list if level[r.conclusion.head] == k] for k in sorted(set(level.values()))]
    raise ValueError("rules with distributions or folds over what they conclude have no order")


def chain(facts: DataFrame, rule_list: list[Rule], most_rounds: int = MOST_ROUNDS, timeout_s: float = TIMEOUT_S, whole: bool = False, unfinished=None) -> DataFrame:
    """All facts, given and derived, at the fixpoint, or when the rounds or the time are used up.

    The latter, while the last round still improved facts, is a warning, and with whole an error; unfinished, a
    function of the reason, is called in place of both.

    In each round every rule is fired with the newest facts in each of its premises in turn and all facts in the
    others; what is no improvement is dropped. Rules with terms are fired once, when all that they read is there. Only
    facts with a head that some rule reads or makes are carried through the rounds. Each round writes its new facts to
    the shared folder, which cuts lineage.
    """
    terms = any(isinstance(a, Term) for r in rule_list for a in r.premises)
    if terms and "value" not in facts.columns:
        facts = facts.withColumn("value", F.lit(None).cast(VALUE))
    heads = {a.head for r in rule_list for p in (*r.premises, r.conclusion) for a in (p.patterns if isinstance(p, Term) else (p,))}
    rest = facts.where(~F.col("head").isin(list(heads)))
    known = written(best(facts.where(F.col("head").isin(list(heads)))), "facts")
    began, left = time.monotonic(), most_rounds
    for level in strata(rule_list):
        plain = [r for r in level if all(isinstance(a, Atom) for a in r.premises)]
        once = [r for r in level if r not in plain]
        newest, first = known, True
        while True:
            fired = None
            for r in plain:
                for i, a in enumerate(r.premises):
                    if a.head not in COMPARISONS:
                        fired = _union(fired, fire(r, [newest if j == i else known for j in range(len(r.premises))]))
            for r in once if first else ():
                fired = _union(fired, fire(r, [known] * len(r.premises)))
            for r in once if not first else ():  # a term's rule reads flat facts too, which can be new in this stratum
                for i, a in enumerate(r.premises):
                    if isinstance(a, Atom) and a.head not in COMPARISONS:
                        fired = _union(fired, fire(r, [newest if j == i else known for j in range(len(r.premises))]))
            first = False
            if fired is None:
                break
            if left == 0:
                _unfinished(f"{most_rounds} rounds", whole, unfinished)
                return known.unionByName(rest)
            left -= 1
            old = known.select("head", "args", F.col("strength").alias("s0"), F.col("confidence").alias("c0"))
            better = best(fired).join(old, ["head", "args"], "left").where("s0 is null or strength > s0 or confidence > c0").drop("s0", "c0")
            better = written(better, "derived")
            if better.isEmpty():
                break
            known = written(best(known.unionByName(better)), "facts")
            newest = better.select("head", "args").join(known, ["head", "args"])
            if time.monotonic() - began > timeout_s:
                _unfinished(f"{timeout_s} s", whole, unfinished)
                return known.unionByName(rest)
    return known.unionByName(rest)


def _union(a: DataFrame | None, b: DataFrame) -> DataFrame:
    return b if a is None else a.unionByName(b)


def _unfinished(after: str, whole: bool, told) -> None:
    text = f"chaining ended after {after} while facts still improved: the result is not the fixpoint"
    if told is not None:
        told(text)
    elif whole:
        raise Unfinished(text)
    else:
        warnings.warn(text, RuntimeWarning, stacklevel=3)


def relevant(rule_list: list[Rule], heads: set[str]) -> list[Rule]:
    """The rules that can have a part in a proof of facts with one of the heads."""
    wanted, grown = set(heads), True
    while grown:
        more = {h for r in rule_list if r.conclusion.head in wanted for h in read_heads(r)} - wanted
        wanted, grown = wanted | more, bool(more)
    return [r for r in rule_list if r.conclusion.head in wanted]


def read_heads(rule: Rule) -> list[str]:
    return [a.head for p in rule.premises for a in (p.patterns if isinstance(p, Term) else (p,))]


def bound_places(rule_list: list[Rule], goal: Atom) -> list[int]:
    """Places of a goal's constants that may restrict the facts of its head from the start.

    A place may if every rule that makes facts of this head carries the argument there unchanged from each premise of
    this head, and no rule for another head reads facts of this one: then no proof needs a fact with another constant.
    """
    mine = relevant(rule_list, {goal.head})
    if any(p.head == goal.head for r in mine for t in r.premises if isinstance(t, Term) for p in t.patterns):
        return []
    out = []
    for i, c in enumerate(goal.args):
        if is_var(c):
            continue
        carried = all(
            a.head != goal.head or (r.conclusion.head == goal.head and len(a.args) > i and i < len(r.conclusion.args) and is_var(a.args[i]) and a.args[i] == r.conclusion.args[i])
            for r in mine
            for a in r.premises
            if isinstance(a, Atom)
        )
        if carried:
            out.append(i)
    return out


def prove(facts: DataFrame, rule_list: list[Rule], goal: str, most_rounds: int = MOST_ROUNDS, timeout_s: float = TIMEOUT_S, unfinished=None) -> DataFrame:
    """answers() of a goal over what the rules relevant to it derive; its constants restrict the facts where that loses no proof."""
    atom = Atom.of(parse(goal)[2])
    mine = relevant(rule_list, {atom.head})
    heads = {h for r in mine for h in (*read_heads(r), r.conclusion.head)} | {atom.head}
    seed = facts.where(F.col("head").isin(list(heads)))
    for i in bound_places(rule_list, atom):
        seed = seed.where((F.col("head") != atom.head) | (F.get("args", F.lit(i)) == atom.args[i]))
    return answers(chain(seed, mine, most_rounds, timeout_s, unfinished=unfinished) if mine else seed, goal)


def answers(facts: DataFrame, goal: str) -> DataFrame:
    """Bindings of the variables of a goal `(: $prf (Head ...) $tv)`, with truth value and trace (and value, where facts have one); named without their $."""
    e = parse(goal)
    m = matches(facts, Atom.of(e[2]), "")
    return m.toDF(*(c.lstrip("$?") for c in m.columns))


def average(facts: DataFrame, pattern: Atom, value: str, by: list[str]) -> DataFrame:
    """Mean of a variable of the pattern over its matches, for each binding of other variables."""
    m = matches(facts, pattern, "_")
    return m.groupBy(*(F.col(f"`{v}`").alias(v.lstrip("$?")) for v in by)).agg(F.avg(F.col(f"`{value}`").try_cast("double")).alias("average"))


FOLDS = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.count}


def fold(facts: DataFrame, pattern: Atom, value: str, by: list[str], how: str, initial: float | None = None) -> DataFrame:
    """A fold of a variable over the matches: one of FOLDS, starting from initial where it is given."""
    if how not in FOLDS:
        raise ValueError(f"unknown fold {how}: {sorted(FOLDS)}")
    m = matches(facts, pattern, "_")
    v = FOLDS[how](F.col(f"`{value}`").try_cast("double"))
    if initial is not None:
        v = {"sum": lambda: v + initial, "count": lambda: v + initial, "min": lambda: F.least(v, F.lit(initial)), "max": lambda: F.greatest(v, F.lit(initial))}[how]()
    return m.groupBy(*(F.col(f"`{x}`").alias(x.lstrip("$?")) for x in by)).agg(v.alias("folded"))


FUNCTIONS = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: a / F.nullif(b, F.lit(0.0)), "min": F.least, "max": F.greatest}


FUNCTIONS[">"], FUNCTIONS["GreaterThan"] = (lambda a, b: (a > b).cast("double"),) * 2
_slope2 = lambda a, b, da, db: F.sqrt(a["sigma"] * a["sigma"] * da * da + b["sigma"] * b["sigma"] * db * db)
#: Standard deviation of a function of two independent distributions, to the first order.
SPREADS = {
    "+": lambda a, b: _slope2(a, b, F.lit(1.0), F.lit(1.0)), "-": lambda a, b: _slope2(a, b, F.lit(1.0), F.lit(1.0)), "*": lambda a, b: _slope2(a, b, b["mu"], a["mu"]),
    "/": lambda a, b: _slope2(a, b, 1 / F.nullif(b["mu"], F.lit(0.0)), a["mu"] / F.nullif(b["mu"] * b["mu"], F.lit(0.0))),
    "min": lambda a, b: F.when(a["mu"] <= b["mu"], a["sigma"]).otherwise(b["sigma"]), "max": lambda a, b: F.when(a["mu"] >= b["mu"], a["sigma"]).otherwise(b["sigma"]), ">": lambda a, b: F.lit(0.0), "GreaterThan": lambda a, b: F.lit(0.0),
}
#: Functions of one value with their slopes.
MAPS = {
    "negate": (lambda x: -x, lambda x: F.lit(1.0)), "abs": (F.abs, lambda x: F.lit(1.0)), "double": (lambda x: 2 * x, lambda x: F.lit(2.0)), "half": (lambda x: x / 2, lambda x: F.lit(0.5)), "square": (lambda x: x * x, lambda x: 2 * x),
    "sqrt": (lambda x: F.when(x >= 0, F.sqrt(x)), lambda x: F.when(x > 0, 0.5 / F.sqrt(x)).otherwise(F.lit(0.0))), "exp": (F.exp, F.exp), "log": (lambda x: F.when(x > 0, F.log(x)), lambda x: 1 / x),
}
#: Folds of a column from an initial value.
FOLDED = {"+": lambda x, i: F.sum(x) + i, "sum": lambda x, i: F.sum(x) + i, "*": lambda x, i: F.product(x) * i, "min": lambda x, i: F.least(F.min(x), i), "max": lambda x, i: F.greatest(F.max(x), i), "count": lambda x, i: F.count("*") + i}


def compute(df: DataFrame, function: str, left: str, right: str, out: str) -> DataFrame:
    """A whitelisted function of two bound values as a new column."""
    if function not in FUNCTIONS:
        raise ValueError(f"unknown function {function}: {sorted(FUNCTIONS)}")
    return df.withColumn(out, FUNCTIONS[function](F.col(left).try_cast("double"), F.col(right).try_cast("double")))


def map_normal(mean, sigma, scale: float = 1.0, shift: float = 0.0):
    """A normal distribution under x -> scale x + shift, as struct(mu, sigma)."""
    return F.struct((mean * scale + shift).alias("mu"), (sigma * abs(scale)).alias("sigma"))


def add_normals(mean_a, sigma_a, mean_b, sigma_b):
    """The sum of two independent normal distributions."""
    return F.struct((mean_a + mean_b).alias("mu"), F.sqrt(sigma_a * sigma_a + sigma_b * sigma_b).alias("sigma"))


def exists(facts: DataFrame, pattern: Atom, keep: str, head: str) -> DataFrame:
    """A unary fact for every value of one variable that has any match: the helper for goals with 'something'."""
    m = matches(facts, pattern, "").select(F.lit(head).alias("head"), F.array(F.col(f"`{keep}`")).alias("args"), "strength", "confidence", (F.col("steps") + 1).alias("steps"), "trace")
    return best(m)


def location(facts: DataFrame) -> DataFrame:
    """(subject, place, whole, strength, confidence): who is in what, as a part of what; one join of binary facts (head, subject, object, ...)."""
    at = facts.where("head = 'AtLocation'").select("subject", F.col("object").alias("place"), F.col("strength").alias("s1"), F.col("confidence").alias("c1"))
    part = facts.where("head = 'PartOf'").select(F.col("subject").alias("place"), F.col("object").alias("whole"), F.col("strength").alias("s2"), F.col("confidence").alias("c2"))
    return at.join(part, "place").select("subject", "place", "whole", (F.col("s1") * F.col("s2")).alias("strength"), F.least("c1", "c2").alias("confidence"))


def widest(start: DataFrame, links: DataFrame) -> DataFrame:
    """(subject, object, confidence): of the chains of a row of start and links behind it, the best by its least confidence; both have these columns.

    To the fixpoint, without a limit to rows or rounds: each round goes on from the pairs that the last one made or
    improved, so each pair is kept once, not once a path, and circles end.
    """
    pair = ["subject", "object"]
    top = lambda df: df.groupBy(*pair).agg(F.max("confidence").alias("confidence"))
    links = links.select(F.col("subject").alias("object"), F.col("object").alias("next"), F.col("confidence").alias("c"))
    known = newest = written(top(start), "chains")
    while True:
        longer = newest.join(links, "object").select("subject", F.col("next").alias("object"), F.least("confidence", "c").alias("confidence"))
        old = known.select(*pair, F.col("confidence").alias("c0"))
        newest = written(top(longer).join(old, pair, "left").where("c0 is null or confidence > c0").drop("c0"), "chains")
        if newest.isEmpty():
            return known
        known = written(top(known.unionByName(newest)), "chains")
