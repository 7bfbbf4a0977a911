"""Queries on statements and atoms."""

from __future__ import annotations

from pyspark.sql import functions as F

from atomloom.functions import arrays as A
from atomloom.functions import sql as Q
from atomloom.functions import symbols as S
from atomloom.operators import atoms as O
from atomloom.plans.text import _CAPS
from atomloom.session import spread

#: Rules in several writings: for the operators on rules, beside the tables.
RULES = [
    "(: r1 (Implication (Premises (AtLocation $c $n) (PartOf $n $r)) (Conclusions (AtLocation $c $r))) (STV 1.0 0.9))",
    "(: r2 (Implication (Premises (IsA $x dog) (HasA $x tail)) (Conclusions (CanWag $x))) (STV 1.0 1.0))",
    "(: r3 (Implication (Premises (IsA ?x dog) (IsA ?y cat)) (Conclusions (Chases ?x ?y))) (STV 0.8 0.9))",
    "(: r4 (Implication (Premises (IsA $x dog)) (Conclusions (IsA $x animal) (HasA $x leg))) (STV 1.0 1.0))",
    "(: r5 (Implication (Premises (And (IsA $x a) (IsA $y b))) (Conclusions (Near $x $y))) (STV 1.0 1.0))",
    "(: r6 (Implication (HasA $x y)) (STV 1.0 1.0))",
    "(: f1 (HasA $x tail) (STV 1.0 1.0))",
    "(: f2 (HasA ?x tail) (STV 1.0 1.0))",
    "(: h1 (Height bob) (PointMass 1.8))",
    "(: h2 (Height eve) (ParticleFromNormal 1.7 0.1))",
    "(: n1 (Not (HasA bob tail)) (STV 1.0 1.0))",
]


def _rules(spark):
    return spark.createDataFrame(list(enumerate(RULES)), "rule_no int, raw string")


def _log(spark, folder):
    return spark.read.parquet(f"{folder}/statement_log.parquet").select("stmt_no", "raw")


def _items(spark, folder):
    return spread(spark.read.parquet(f"{folder}/ingest_item_result.parquet").select("item_id", "text", "atoms"))


def _flat(sig, prefix=""):
    return sig["head"].alias("head"), F.array_join(sig["args"], " ").alias("args"), sig["arity"].alias("arity"), F.size(sig["variables"]).alias("variables")


def atom_parse(spark, folder):
    """Stored statements in their parts."""
    raw, a = F.col("raw"), O.simple_atom(O.statement_body(F.col("raw")))
    df = _log(spark, folder).select("stmt_no", O.statement_id(raw).alias("stmt_id"), O.statement_body(raw).alias("body"), a.alias("a"), O.truth_value(raw).alias("tv"), O.kind(raw).alias("kind"))
    return df.select("stmt_no", "stmt_id", "kind", "body", F.col("a.head").alias("head"), F.array_join("a.args", " ").alias("args"), F.col("a.arity").alias("arity"), F.col("tv.strength").alias("strength"), F.col("tv.confidence").alias("confidence"))


def fact_signatures(spark, folder):
    atoms = _items(spark, folder).select("item_id", F.posexplode("atoms").alias("atom_no", "atom"))
    return atoms.select("item_id", "atom_no", F.explode(O.fact_signatures(F.col("atom"))).alias("s")).select("item_id", "atom_no", *_flat(F.col("s")))


def conclusion_signatures(spark, folder):
    rules = _log(spark, folder).select(F.col("stmt_no").alias("id"), "raw").unionByName(_rules(spark).select((-F.col("rule_no") - 1).cast("bigint").alias("id"), "raw"))
    return rules.select("id", F.posexplode(O.conclusion_signatures(F.col("raw"))).alias("no", "s")).select("id", "no", *_flat(F.col("s")))


def goal_signatures(spark, folder):
    """Statements asked as goals: signature, ground body, and the signature as a goal again."""
    goal = F.concat(F.lit("(: $prf "), O.statement_body(F.col("raw")), F.lit(" $tv)"))
    df = _log(spark, folder).select("stmt_no", goal.alias("goal")).where("goal is not null")
    return df.select("stmt_no", O.goal_of(O.goal_signature(F.col("goal"))).alias("rendered"), O.ground_goal(F.col("goal")).alias("ground"))


def _context(df):
    text = F.col("text")
    return df.select("item_id", "atoms", O.concept_map(A.extract_concepts(text)).alias("concepts"), A.constants(text).alias("protected"), A.proper_name_map(text).alias("proper"))


def canon_atoms(spark, folder):
    """Atoms of each item in canonical form, by the concepts and names of its text."""
    df = _context(_items(spark, folder).where("text is not null and atoms is not null"))
    out = df.select("item_id", F.posexplode(O.canonical_outputs(A.dedupe(F.col("atoms")), F.col("concepts"), F.col("protected"), F.col("proper"))).alias("no", "atom"))
    return out.select("item_id", "no", "atom")


def post_process(spark, folder):
    """Canonical atoms, pruned and filtered."""
    df = _context(_items(spark, folder).where("text is not null and atoms is not null"))
    return df.select("item_id", F.posexplode(O.processed(F.col("atoms"), F.col("concepts"), F.col("protected"), F.col("proper"))).alias("no", "atom"))


def filter_statements(spark, folder):
    return _log(spark, folder).where(O.keeps(F.col("raw"))).select(F.col("stmt_no").alias("id"), "raw").unionByName(_rules(spark).where(O.keeps(F.col("raw"))).select((-F.col("rule_no") - 1).cast("bigint").alias("id"), "raw"))


def prune_premises(spark, folder):
    return _log(spark, folder).where(F.contains("raw", F.lit("Implication"))).select(F.col("stmt_no").alias("id"), O.pruned(F.col("raw")).alias("rule")).unionByName(_rules(spark).select((-F.col("rule_no") - 1).cast("bigint").alias("id"), O.pruned(F.col("raw")).alias("rule")))


def sexpr_tokens(spark, folder):
    t = _log(spark, folder).select("stmt_no", O.tokenized(F.col("raw")).alias("t")).where("t.error is null")
    return t.select("stmt_no", F.posexplode(F.arrays_zip("t.tokens", "t.depths")).alias("pos", "x")).select("stmt_no", "pos", F.col("x.tokens").alias("token"), F.col("x.depths").alias("depth"))


def context_predicates(spark, folder):
    df = _items(spark, folder).where("atoms is not null")
    return df.select("item_id", F.array_join(A.context_heads(F.col("atoms")), ",").alias("known"), F.array_join(A.domain_heads(F.col("atoms")), ",").alias("domain"), A.vocabulary_hint(A.domain_heads(F.col("atoms"))).alias("hint"))


def context_symbol_map(spark, folder):
    pairs = F.transform(F.map_entries(O.context_symbols(F.col("atoms"))), lambda e: F.concat(e["key"], F.lit(">"), e["value"]))
    return _items(spark, folder).where("atoms is not null").select("item_id", F.array_join(F.array_sort(pairs), ",").alias("symbols"))


def predicate_memory(spark, folder):
    """Heads seen in each collection so far, in the order of their first item: what a session remembers."""
    df = spark.read.parquet(f"{folder}/ingest_item_result.parquet").select("collection", "item_id", F.posexplode("atoms").alias("atom_no", "atom"))
    heads = df.select("collection", "item_id", "atom_no", F.posexplode(F.regexp_extract_all("atom", F.lit(A.HEAD), F.lit(1))).alias("no", "head"))
    return heads.where(~F.col("head").isin(A.TRANSLATOR_HEADS)).groupBy("collection", "head").agg(F.min("item_id").alias("first_item"), F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (atom_parse, fact_signatures, conclusion_signatures, goal_signatures, canon_atoms, post_process, filter_statements, prune_premises, sexpr_tokens, context_predicates, context_symbol_map, predicate_memory)}

_values = ", ".join(f"({i}, '{r}')" for i, r in enumerate(RULES))
_RULES = f"rules as (select * from (values {_values}) v(rule_no, raw))"
_ALL = "z as (select stmt_no id, raw from statement_log union all select -rule_no - 1, raw from rules)"
_body = rf"nullif(trim(regexp_replace(regexp_extract({Q.strip('raw')}, '{O.STATEMENT}', 1), '[\s\p{{Z}}]+', ' ', 'g')), '')"
_args = lambda x, g=2: rf"list_filter(regexp_split_to_array(regexp_extract({x}, '{O.SIMPLE}', {g}), '\s+'), lambda a: a <> '')"
_sig = lambda x: f"regexp_extract({x}, '{O.SIMPLE}', 1) head, array_to_string({_args(x)}, ' ') args, len({_args(x)})::integer arity, len(list_filter({_args(x)}, lambda a: regexp_matches(a, '^[$?]'))) variables"
_unnested = lambda key, lst, src: f"select {key}, i, l[i] x from (select {key}, l, unnest(range(1, len(l) + 1)) i from (select {key}, {lst} l from {src}))"
_prune = rf"""(select id, raw, b, l, k, case when contains(raw, 'Implication') and len(l) > 1 and len(k) > 0 and len(k) < len(l) then left(raw, instr(raw, b) - 1) || '(Premises ' || array_to_string(k, ' ') || ')' || substr(raw, instr(raw, b) + length(b)) else raw end rule
    from (select *, list_filter(l, lambda p: not regexp_matches(p, '^\(IsA\s+[$?][^()\s]*\s+[^()\s]+\)$')) k from (select id, raw, regexp_extract(raw, '\(Premises{O.BLOCK}') b, regexp_extract_all(regexp_extract(raw, '\(Premises{O.BLOCK}', 1), '{O.FLAT}') l from z)))"""
_keeps = r"case when contains(raw, 'Implication') then contains(raw, '(Premises') and contains(raw, '(Conclusions') else not regexp_matches(raw, '\$[A-Za-z_]') end"


def _head(h: str) -> str:
    s = Q.snake(h)
    return f"case when {h} in ({Q.quoted(A.STRUCTURAL_HEADS)}) then {h} " + " ".join(f"when {s} = '{k}' then '{v}'" for k, v in A.PREDICATE_ALIASES.items()) + f" else {h} end"


_lookup = lambda ks, vs: f"{vs}[list_position({ks}, lower(w))]"
_word = rf"""case when not regexp_matches(w, '^[$?\p{{L}}_]') then w when regexp_matches(w, '^[$?]') then w[1] || {Q.snake('w[2:]')} when regexp_matches(before, '\([\s\p{{Z}}]*$') then {_head('w')}
    else coalesce({_lookup('pk', 'pv')}, {_lookup('ck', 'cv')}, case when list_contains(protected, lower(w)) then {Q.snake('w')} else {Q.canonical('w')} end) end"""
#: Relation canon(item_id, no, atom): the atoms of each item, deduped, canonical, deduped again.
_CANON = rf"""t as (select item_id, atoms, {_CAPS} caps, string_split({Q.norm('text')}, ' ') ws from ingest_item_result where text is not null and atoms is not null),
    t1 as (select item_id, atoms, list_transform(list_filter(caps, lambda w: {Q.snake('w')} <> ''), lambda w: {{'c': {Q.snake('w')}, 's': {Q.canonical('w')}}}) caps, list_transform(list_filter(ws, lambda w: length(w) >= 3 and not list_contains([{Q.quoted(A.STOP_WORDS)}], w)), lambda w: {Q.singular('w')}) cs from t),
    t2 as (select item_id, atoms, list_transform(caps, lambda x: x.c) protected, list_reverse(flatten(list_transform(caps, lambda x: case when x.s <> '' and x.s <> x.c then [{{'k': x.c, 'v': x.c}}, {{'k': x.s, 'v': x.c}}] else [{{'k': x.c, 'v': x.c}}] end))) p, (list_filter(cs, lambda c, i: list_position(cs, c) = i))[1:{A.MOST_CONCEPTS}] cs from t1),
    t3 as (select item_id, atoms, protected, list_transform(p, lambda e: e.k) pk, list_transform(p, lambda e: e.v) pv, list_reverse(flatten(list_transform(cs, lambda c: [c, {Q.plural('c')}]))) ck, list_reverse(flatten(list_transform(cs, lambda c: [c, c]))) cv from t2),
    a0 as (select item_id, i, trim(regexp_replace(atoms[i], '[\s\p{{Z}}]+', ' ', 'g')) atom from (select item_id, atoms, unnest(range(1, len(atoms) + 1)) i from t3)),
    a1 as (select item_id, atom, min(i) i from a0 where atom <> '' group by all),
    r0 as (select item_id, i, regexp_extract_all(atom, '{O.RUNS}') runs from a1), r1 as (select item_id, i, j, runs[j] w, case when j > 1 then runs[j - 1] else '' end before from (select *, unnest(range(1, len(runs) + 1)) j from r0)),
    r2 as (select r1.item_id, i, string_agg({_word}, '' order by j) x from r1 join t3 on t3.item_id = r1.item_id group by all),
    r3 as (select item_id, i, list_transform(regexp_split_to_array(x, '{O.ISA}'), lambda p: p) ps, regexp_extract_all(x, '{O.ISA}') ms from r2),
    r4 as (select item_id, i, array_to_string(list_transform(ps, lambda p, j: p || coalesce('(IsA ' || regexp_extract(ms[j], '{O.ISA}', 1) || ' ' || {Q.canonical(f"regexp_extract(ms[j], '{O.ISA}', 2)")} || ')', '')), '') atom from r3),
    r5 as (select item_id, atom, min(i) i from r4 where atom <> '' group by all)"""
_MAP = rf"""u as (select item_id, i, atoms[i] a from (select item_id, atoms, unnest(range(1, len(atoms) + 1)) i from ingest_item_result)),
    s as (select item_id, 0 tier, i, regexp_extract_all(a, '{O.FACT}', 1) l from u union all select item_id, 1, i, flatten(list_transform(regexp_extract_all(a, '\(Conclusions{O.BLOCK}', 1), lambda b: regexp_extract_all(b, '{O.FLAT}'))) from u),
    e as (select item_id, tier, i, j, {_args('l[j]')} g from (select *, unnest(range(1, len(l) + 1)) j from s) where regexp_matches(l[j], '{O.SIMPLE}')), f as (select item_id, g[k] a, min((tier, i, j, k)) o from (select *, unnest(range(1, len(g) + 1)) k from e) where not regexp_matches(g[k], '^[$?]') group by all),
    v as (select item_id, a, o, {Q.canonical('a')} c from f), m as (select item_id, a k, a v, (o, 0) o from v union all select item_id, c, a, (o, 1) from v where c <> '' union all select item_id, {Q.plural('c')}, a, (o, 2) from v where c <> ''),
    n as (select item_id, k || '>' || arg_min(v, o) x from m group by item_id, k)"""
_heads = lambda flt, out, most: f"""(select item_id, string_agg(h, ',' order by p) {out} from (select item_id, h, p, row_number() over (partition by item_id order by p) n from (select item_id, h, min(p) p from (select item_id, {flt} h, (i, j) p from h) group by all)) where n <= {most} group by all)"""

SQL = {
    "atom_parse": rf"""select stmt_no, nullif(regexp_extract(raw, '^\s*\(:\s+([^\s()]+)', 1), '') stmt_id, case when contains(raw, '(Implication') then 'rule' when regexp_matches(raw, '{O.FACT}') then 'fact' else 'other' end kind, {_body} body,
        nullif(regexp_extract({_body}, '{O.SIMPLE}', 1), '') head, case when regexp_matches({_body}, '{O.SIMPLE}') then array_to_string({_args(_body)}, ' ') end args, case when regexp_matches({_body}, '{O.SIMPLE}') then len({_args(_body)})::integer end arity,
        try_cast(regexp_extract(raw, '{O.STV}', 1) as double) strength, try_cast(regexp_extract(raw, '{O.STV}', 2) as double) confidence from statement_log""",
    "fact_signatures": rf"""with a as ({_unnested('item_id', 'atoms', 'ingest_item_result')}), f as (select item_id, cast(i - 1 as integer) atom_no, unnest(regexp_extract_all(x, '{O.FACT}', 1)) f from a)
        select item_id, atom_no, {_sig('f')} from f where regexp_matches(f, '{O.SIMPLE}') and regexp_extract(f, '{O.SIMPLE}', 1) <> 'Implication'""",
    "conclusion_signatures": rf"""with {_RULES}, {_ALL}, c as ({_unnested('id', rf"list_filter(flatten(list_transform(regexp_extract_all(raw, '\(Conclusions{O.BLOCK}', 1), lambda b: regexp_extract_all(b, '{O.FLAT}'))), lambda a: regexp_matches(a, '{O.SIMPLE}'))", 'z')})
        select id, cast(i - 1 as integer) as no, {_sig('x')} from c""",
    "goal_signatures": rf"""with g as (select stmt_no, '(: $prf ' || {_body} || ' $tv)' goal from statement_log), s as (select stmt_no, goal, regexp_extract(goal, '{O.GOAL}', 1) f, regexp_extract(goal, '{O.GROUND_GOAL}', 1) b from g where goal is not null)
        select stmt_no, case when regexp_matches(f, '{O.SIMPLE}') then '(: $prf (' || regexp_extract(f, '{O.SIMPLE}', 1) || ' ' || array_to_string({_args('f')}, ' ') || ') $tv)' end rendered, case when not regexp_matches(b, '[$?]') then nullif(b, '') end ground from s""",
    "canon_atoms": f"with {_CANON} select item_id, cast(row_number() over (partition by item_id order by i) - 1 as integer) as no, atom from r5",
    "post_process": f"with {_CANON}, z as (select (item_id, i) id, atom raw from r5), q as (select id, rule raw from {_prune}) select id[1] item_id, cast(row_number() over (partition by id[1] order by id[2]) - 1 as integer) as no, raw atom from q where {_keeps}",
    "filter_statements": f"with {_RULES}, {_ALL} select id, raw from z where {_keeps}",
    "prune_premises": f"with {_RULES}, {_ALL} select id, rule from {_prune} where contains(raw, 'Implication') or id < 0",
    "sexpr_tokens": r"""with t as (select stmt_no, regexp_extract_all(raw, '[()]|[^\s()]+') l from statement_log), u as (select stmt_no, i, l[i] token from (select *, unnest(range(1, len(l) + 1)) i from t)),
        d as (select stmt_no, i, token, sum(case token when '(' then 1 when ')' then -1 else 0 end) over (partition by stmt_no order by i) s from u),
        e as (select stmt_no from d group by 1 having max(s) filter (i = 1) >= 1 and bool_and(s >= 0) and sum((s = 0)::int) = 1 and arg_max(s, i) = 0)
        select stmt_no, cast(i - 1 as integer) pos, token, cast(case when token = ')' then s + 1 else s end as integer) as depth from d semi join e using (stmt_no)""",
    "context_predicates": rf"""with a as ({_unnested('item_id', 'atoms', 'ingest_item_result')}), h as (select item_id, i, j, l[j] r from (select *, unnest(range(1, len(l) + 1)) j from (select item_id, i, regexp_extract_all(x, '{A.HEAD}', 1) l from a))),
        k as {_heads(_head('r'), 'known', A.MOST_HEADS)}, d0 as (select item_id, r h, min((i, j)) p from h where r not in ({Q.quoted(A.TRANSLATOR_HEADS)}) group by all),
        d as (select item_id, string_agg(h, ',' order by p) as domain, string_agg(case when n <= {A.HINTED_HEADS} then h || '->' || replace({Q.snake('h')}, '_', '-') end, ', ' order by p) hint from (select *, row_number() over (partition by item_id order by p) n from d0) group by all)
        select item_id, coalesce(known, '') known, coalesce(domain, '') as domain, coalesce(hint, '') hint from ingest_item_result left join k using (item_id) left join d using (item_id) where atoms is not null""",
    "context_symbol_map": f"with {_MAP}, g as (select item_id, string_agg(x, ',' order by x) symbols from n group by all) select item_id, coalesce(symbols, '') symbols from ingest_item_result left join g using (item_id) where atoms is not null",
    "predicate_memory": rf"""with h as (select collection, item_id, unnest(regexp_extract_all(a, '{A.HEAD}', 1)) head from (select collection, item_id, unnest(atoms) a from ingest_item_result))
        select collection, head, min(item_id) first_item, count(*) n from h where head not in ({Q.quoted(A.TRANSLATOR_HEADS)}) group by all""",
}
