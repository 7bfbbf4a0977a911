"""Queries on goal planning."""

from __future__ import annotations

from pyspark.sql import functions as F

from atomloom.functions import sql as Q
from atomloom.operators import planning as P
from atomloom.plans import facts as K
from atomloom.session import written

QUESTIONS = [
    "Is supplier 000000001 located in nation 3?", "Is NATION_3 part of ASIA?", "Who is in the Nation_4?", "Does customer 000000007 have a balance?", "What is part of EUROPE?",
    "Is anything located in a NATION_5?", "Are the Dogs capable of running in the park?", "Is glue used for building chairs?", "", "Why not?", "Can Customer_000000009 be located at NATION_2?",
]
GOALS = [
    (0, "(: $prf (AtLocation supplier_000000001 nation_3) $tv)"), (0, "(: $prf (AtLocation $x nation_3) $tv)"), (1, "(: $prf (PartOf nation_3 asia) $tv)"), (1, "(: $prf (IsA nation_3 asia) $tv)"), (1, "(: $prf (PartOf nation_3 $r) $tv)"),
    (2, "(: $prf (AtLocation $who nation_4) $tv)"), (2, "(: $prf (HasA $who nation_4) $tv)"), (3, "(: $prf (HasA customer_000000007 balance) $tv)"), (4, "(: $prf (PartOf $what europe) $tv)"), (4, "(: $prf (PartOf $what $where) $tv)"),
    (5, "(: $prf (Near $a nation_5) $tv)"), (5, "(: $prf (AtLocation customer nation_5) $tv)"), (6, "(: $prf (CapableOf dog running) $tv)"), (7, "(: $prf (And (UsedFor glue chair)) $tv)"), (9, "(: $prf (Unknown a) $tv)"), (9, "(: $prf (Unknown b) $tv)"),
    (10, "(: $prf (AtLocation customer_000000009 nation_2) ?tv)"), (10, "(: $prf (IsA $c nation_2) $tv)"), (10, "(: $prf (MadeOf customer_000000009 nation_2) $tv)"),
]
CONCLUSIONS = [("AtLocation", ["$a", "$c"]), ("BrandIn", ["$b", "$n"]), ("PartOf", ["nation_3", "asia"]), ("CapableOf", ["dogs", "run"])]


def _questions(spark):
    return spark.createDataFrame(list(enumerate(QUESTIONS)), "question_no int, question string")


def _candidates(spark):
    return spark.createDataFrame([(q, i, g) for i, (q, g) in enumerate(GOALS)], "question_no int, pos int, goal string")


#: Heads that goals have or questions can name: no other fact can have a part in a plan.
_HEADS = tuple(sorted({g.split("(")[2].split()[0] for _, g in GOALS} | {*P.HEAD_PHRASES, "AtLocation"}))


def _signatures(spark, folder):
    given = K.facts(spark, folder, _HEADS).select(F.lit(0).alias("tier"), "seq", "head", F.array("subject", "object").alias("args"))
    made = spark.createDataFrame([(1, i, h, a) for i, (h, a) in enumerate(CONCLUSIONS)], "tier int, seq bigint, head string, args array<string>")
    return written(given.unionByName(made), "signatures")


def plan_score(spark, folder):
    return P.scored(_candidates(spark), _questions(spark), _signatures(spark, folder))


def plan_grounded(spark, folder):
    return P.grounded(_candidates(spark), _questions(spark), _signatures(spark, folder))


def plan_aligned(spark, folder):
    return P.aligned(_candidates(spark), _questions(spark), _signatures(spark, folder))


def plan_heuristic(spark, folder):
    return P.heuristic(_questions(spark))


def plan_goals(spark, folder):
    """The whole plan of every question."""
    return P.planned(_candidates(spark), _questions(spark), _signatures(spark, folder))


def plan_ranked(spark, folder):
    """The plan of a parser that makes no goals of its own."""
    return P.scored_or_first(_candidates(spark), _questions(spark), _signatures(spark, folder))


def query_status(spark, folder):
    df = _questions(spark).join(_candidates(spark), "question_no", "left").crossJoin(spark.createDataFrame([(True,), (False,)], "fallback_used boolean"))
    return df.select("question_no", F.coalesce("pos", F.lit(-1)).alias("pos"), "fallback_used", P.status(F.col("question"), F.col("goal"), F.col("fallback_used")).alias("status"))


def query_hints(spark, folder):
    heads = F.array(*map(F.lit, ["IsA", "PartOf"]))
    return _questions(spark).select("question_no", F.array_join(P.hints(F.col("question"), heads), "|").alias("hints"), P.is_yes_no(F.col("question")).alias("yes_no"))


def plan_executed(spark, folder):
    """The goal of each plan that is answered first by lookup, with the statement that answers it."""
    from atomloom.operators import lookup as L

    plan = written(plan_goals(spark, folder), "plan")
    stored = K.facts(spark, folder, _HEADS).select(F.lit(0).alias("file_rank"), "seq", "raw")
    hit = L.looked_up(plan.select(F.struct("question_no", "rank").alias("goal_no"), "goal"), stored)
    return P.executed(plan, hit.select("goal_no.question_no", "goal_no.rank", F.col("raw").alias("proof")))


QUERIES = {f.__name__: f for f in (plan_score, plan_grounded, plan_aligned, plan_heuristic, plan_goals, plan_ranked, query_status, query_hints, plan_executed)}

_q = lambda s: "'" + s.replace("'", "''") + "'"
_IN = f"""qs as (select * from (values {', '.join(f'({i}, {_q(x)})' for i, x in enumerate(QUESTIONS))}) v(question_no, question)), cs as (select * from (values {', '.join(f'({n}, {i}, {_q(g)})' for i, (n, g) in enumerate(GOALS))}) v(question_no, pos, goal)),
    kon as (select * from (values {', '.join(f"(1, {i}, '{h}', {a})" for i, (h, a) in enumerate(CONCLUSIONS))}) v(tier, seq, head, args))"""
_AUX = f"string_split({Q.norm('question')}, ' ')[1] in ({Q.quoted(P.AUXILIARIES)})"
_GOAL = r"\(:\s+[^\s()]+\s+\(([A-Za-z][A-Za-z0-9_]*)((?:\s+[^()\s]+)*)\)\s+\$?[A-Za-z_][A-Za-z0-9_]*\)"
_const = r"list_transform(regexp_extract_all(question, '\b[A-Z][A-Za-z0-9_-]*\b'), lambda w: " + Q.snake("w") + ")"
_BASE = rf"""{{facts}}, {_IN}, sg as (select 0 tier, seq, head, [subject, object] args from fact union all select tier, seq, head, args from kon),
    pc as (select question_no, pos, goal, question, {_AUX} yn, {Q.norm('question')} norm, {_const} kons, regexp_extract(goal, '{_GOAL}', 1) h, list_filter(regexp_split_to_array(regexp_extract(goal, '{_GOAL}', 2), '\s+'), lambda a: a <> '') g from cs join qs using (question_no) where regexp_matches(goal, '{_GOAL}')),
    p as (select *, list_bool_or(list_transform(g, lambda a: regexp_matches(a, '^[$?]'))) as isopen from pc),
    m as (select p.*, s.tier, s.seq, s.args, s.head from p join sg s on p.h = s.head and len(p.g) = len(s.args)),
    mb as (select *, list_bool_and(list_transform(g, lambda a, i: regexp_matches(a, '^[$?]') or a = args[i])) and (not isopen or list_bool_or(list_transform(g, lambda a, i: regexp_matches(a, '^[$?]') and not regexp_matches(args[i], '^[$?]')))) b from m)""".replace("{facts}", K.sql())
_SC = """ag as (select question_no, pos, bool_or(tier = 0) f, bool_or(tier = 1) k, bool_or(b) w, bool_or(tier = 0 and g = args) gv from mb group by 1, 2),
    sc0 as (select p.question_no, p.pos, p.goal, case when f then 6 else 0 end + case when k then 4 else 0 end + case when not isopen then case when yn then 3 else 1 end else case when yn then 0 else 3 end end + case when gv then 2 else 0 end score, yn and isopen and not coalesce(w, false) dropped from p left join ag using (question_no, pos)),
    sc as (select question_no, pos, goal, score from sc0 where not dropped and score > 0)"""
_render = "'(: $prf (' || head || ' ' || array_to_string(args, ' ') || ') $tv)'"
_GR = f"""gr0 as (select question_no, {_render} goal, pos, tier, seq, kons, args from mb where b and isopen and not list_bool_or(list_transform(args, lambda a: regexp_matches(a, '^[$?]')))),
    gr1 as (select question_no, goal, pos, min((tier, seq)) o, case when list_has_any(any_value(kons), any_value(args)) then 5 else 0 end + max(case when tier = 0 then 3 else 0 end) + max(case when tier = 1 then 2 else 0 end) score from gr0 group by question_no, goal, pos),
    gr2 as (select question_no, goal, min((-score, pos, o)) o from gr1 group by 1, 2), gr as (select question_no, row_number() over (partition by question_no order by o)::integer rank, goal from gr2)"""
_place = " or ".join(f"contains(norm, '{x}')" for x in P.PLACE_PHRASES)
_one = f"case when a = args[i] then 4 when {Q.canonical('a')} = {Q.canonical('args[i]')} then 3 when list_has_all(string_split(args[i], '_'), string_split(a, '_')) then 2 when list_has_any(string_split(args[i], '_'), ws) then 1 else -1000 end"


def _al(cand: str) -> str:
    return f"""al0 as (select c.question_no, c.pos, p.h, p.g, string_split(p.norm, ' ') ws, unnest(list_filter([case when {_place} then 'AtLocation' end, {', '.join(f"case when contains(norm, '{x}') then '{h}' end" for h, x in P.HEAD_PHRASES.items())}], lambda x: x is not null)) wanted from {cand} c join p on p.question_no = c.question_no and p.goal = c.goal where not isopen),
    al1 as (select distinct question_no, pos, h, g, ws, head, args, min((tier, seq)) over (partition by head, args) o from al0 join sg on sg.head = wanted and len(g) = len(args)),
    al2 as (select question_no, pos, head, args, o, list_sum(list_transform(g, lambda a, i: {_one})) + case when h <> head then 3 else 0 end score from al1),
    al3 as (select question_no, {_render} goal, min((-score, pos, o)) o from al2 where score > 0 group by all), al as (select question_no, row_number() over (partition by question_no order by o)::integer rank, goal from al3)"""


_heur = ", ".join(f"case when {Q.phrase(f'regexp_extract(n, {_q(pat)}, 1)')} <> '' and {Q.phrase(f'regexp_extract(n, {_q(pat)}, 2)')} <> '' then '(: $prf ({h} ' || {Q.phrase(f'regexp_extract(n, {_q(pat)}, 1)')} || ' ' || {Q.phrase(f'regexp_extract(n, {_q(pat)}, 2)')} || ') $tv)' end" for h, pat in P.PATTERNS.items())
_HE = f"he0 as (select question_no, list_filter([{_heur}], lambda x: x is not null) l from (select question_no, {Q.norm('question')} n from qs)), he as (select question_no, i::integer rank, l[i] goal from (select question_no, l, unnest(range(1, len(l) + 1)) i from he0))"
_PLAN = f"""{_BASE}, {_SC}, so as (select question_no, goal, row_number() over (partition by question_no order by score desc, pos) pos from sc), {_GR}, {_al('so')}, {_HE}, yq as (select question_no from qs where {_AUX}),
    al_ as (select * from al), pl0 as (select question_no, goal, 0 tier, -score k0, pos k1 from sc union all select question_no, goal, 0, 0, pos from cs where question_no not in (select question_no from sc) and question_no in (select question_no from yq)
        union all select question_no, arg_min(goal, pos), 0, 0, 0 from cs where question_no not in (select question_no from sc) and question_no not in (select question_no from yq) group by 1
        union all select question_no, goal, 1, rank, 0 from al union all select question_no, goal, 2, rank, 0 from gr where question_no in (select question_no from yq) union all select question_no, goal, 3, rank, 0 from he where question_no in (select question_no from yq) and question_no in (select question_no from cs)),
    pl1 as (select question_no, goal, min((tier, k0, k1)) o from pl0 group by 1, 2), pl as (select question_no, row_number() over (partition by question_no order by o)::integer rank, goal from pl1)"""
_hint = [f"case when w[1] in ({Q.quoted(P.AUXILIARIES)}) then {_q(P.HINT_YES_NO)} when list_has_any(w, [{Q.quoted(P.OPEN_WORDS)}]) then {_q(P.HINT_OPEN)} end",
    f"case when list_has_any(w, [{Q.quoted(P.EXISTENTIAL)}]) then {_q(P.HINT_EXISTENTIAL)} end", f"case when list_has_any(w, ['not', 'never']) then {_q(P.HINT_NEGATIVE)} end",
    f"{_q(P.HINT_HEADS)} || 'IsA, PartOf'", f"case when question like '%?' then {_q(P.HINT_EXECUTABLE)} end"]
SQL = {
    "plan_executed": f"""with {_PLAN}, lk as (select question_no, rank, goal, fact.raw proof from pl left join fact on goal = '(: $prf (' || head || ' ' || subject || ' ' || object || ') $tv)'),
        ok as (select question_no, min(rank) rank from lk where proof is not null group by 1), no_ as (select question_no, max(rank) rank from lk where question_no not in (select question_no from ok) group by 1)
        select question_no, goal executed, proof from lk semi join (from ok union all from no_) using (question_no, rank)""",
    "plan_score": f"with {_BASE}, {_SC} select * from sc",
    "plan_grounded": f"with {_BASE}, {_GR} select * from gr",
    "plan_aligned": f"with {_BASE}, {_al('cs')} select * from al",
    "plan_ranked": f"""with {_BASE}, {_SC}, f0 as (select question_no, goal, -score k, pos from sc union all select question_no, arg_min(goal, pos), 0, 0 from cs where question_no not in (select question_no from sc) group by 1),
        f1 as (select question_no, goal, min((k, pos)) o from f0 group by 1, 2) select question_no, row_number() over (partition by question_no order by o)::integer rank, goal from f1""",
    "plan_heuristic": f"with {_IN}, {_HE} select * from he",
    "plan_goals": f"with {_PLAN} select * from pl",
    "query_status": rf"""with {_IN} select question_no, coalesce(pos, -1) pos, f fallback_used, case when coalesce(goal, '') = '' then 'no_query' when f or (regexp_matches(lower(trim(question)), '^(?:{'|'.join(P.AUXILIARIES)}) ')
        and len(list_filter(regexp_extract_all(goal, '[$?][A-Za-z_][A-Za-z0-9_]*'), lambda x: x not in ({Q.quoted(P.SLOTS)}))) > 0) then 'weakly_aligned' else 'well_aligned' end status from qs left join cs using (question_no), (values (true), (false)) v(f)""",
    "query_hints": f"with {_IN}, t as (select question_no, question, string_split({Q.norm('question')}, ' ') w, {_AUX} yes_no from qs) select question_no, case when array_to_string(w, '') = '' then '' else array_to_string(list_filter([{', '.join(_hint)}], lambda x: x is not null), '|') end hints, yes_no from t",
}
