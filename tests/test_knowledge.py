import pytest
from pyspark.sql import functions as F

from atomloom.operators import chaining as C
from atomloom.operators import lookup as L
from atomloom.operators import planning as P
from atomloom.operators import retrieval as R


def facts(spark, *texts):
    return C.facts_of(spark.createDataFrame([(t,) for t in texts], "raw string"))


def derived(spark, given, rules, **kw):
    out = C.chain(facts(spark, *given), [r for t in rules for r in C.rules(t)], **kw).collect()
    return {(r.head, *r.args): (round(r.strength, 6), round(r.confidence, 6)) for r in out}


def test_lookup(spark):
    stored = [(1, 5, "(: bg1 (Has dog tail) (STV 1.0 0.9))"), (0, 9, "(: kb2 (Has dog tail) (STV 0.0 0.9))"), (0, 2, "(: kb1 (Has dogs tails) (STV 1.0 0.9))"), (0, 1, "(: h (Height bob) (PointMass 1))"), (1, 1, None)]
    goals = [(1, "(: $prf (Has dog  tail) $tv)"), (2, "(: $prf (Has Dogs tail) $tv)"), (3, "(: $prf (Has $x tail) $tv)"), (4, "(: $prf (Has cat tail) $tv)"), (5, None), (6, "(: $prf (And (Has dog tail)) $tv)"), (7, "(: ?p (Has dogs tails) ?t)")]
    got = {r.goal_no: (r.tier, r.raw.split()[1]) for r in L.looked_up(spark.createDataFrame(goals, "goal_no int, goal string"), spark.createDataFrame(stored, "file_rank int, seq bigint, raw string")).collect()}
    assert got == {1: ("exact", "kb2"), 2: ("canonical", "kb1"), 7: ("exact", "kb1")}


def test_facts_of(spark):
    got = {(r.head, tuple(r.args), r.confidence) for r in facts(spark, "(: a (P x y) (STV 1.0 0.5))", "(: b (Not (P x z)) (STV 1.0 0.4))", "(: r (Implication (Premises (P $x y)) (Conclusions (Q $x))) (STV 1 1))", "junk", "").collect()}
    assert got == {("P", ("x", "y"), 0.5), ("Not P", ("x", "z"), 0.4)}


def test_conjunction_chain_and_trace(spark):
    given = ["(: f1 (Owns ann dog1) (STV 0.9 0.8))", "(: f2 (Likes ann dogs) (STV 0.5 0.6))", "(: f3 (Owns bob dog2) (STV 1.0 1.0))"]
    rules = ["(: r1 (Implication (Premises (Owns $x $y) (Likes $x dogs)) (Conclusions (Walks $x $y) (Happy $x))) (STV 0.8 0.9))", "(: r2 (Implication (Premises (Happy $x)) (Conclusions (Sings $x))) (STV 1.0 0.5))"]
    got = derived(spark, given, rules)
    assert got["Walks", "ann", "dog1"] == (0.36, 0.6) and got["Sings", "ann"] == (0.36, 0.5) and ("Happy", "bob") not in got
    trace = C.chain(facts(spark, *given), [r for t in rules for r in C.rules(t)]).where("head = 'Sings'").first()
    assert trace.trace == ["r2", "r1", "f1", "f2"] and trace.steps == 2


def test_cycles_reach_a_fixpoint_and_facts_only_add(spark):
    given = [f"(: e{i} (Edge n{i} n{(i + 1) % 5}) (STV 1.0 0.{9 - i}))" for i in range(5)]
    rules = ["(: t (Implication (Premises (Edge $a $b) (Edge $b $c)) (Conclusions (Edge $a $c))) (STV 1.0 1.0))"]
    got = derived(spark, given, rules)
    assert len(got) == 25 and got["Edge", "n0", "n0"] == (1.0, 0.5) and got["Edge", "n0", "n3"] == (1.0, 0.7)
    fewer = derived(spark, given[:4], rules)
    assert set(fewer) <= set(got) and all(got[k][1] >= v[1] for k, v in fewer.items())
    assert len(derived(spark, given, rules, most_rounds=1)) == 10


def test_alternatives_negation_comparison(spark):
    given = ["(: a (Size ann 10) (STV 1 1))", "(: b (Size bob 3) (STV 1 1))", "(: c (Not (Sick ann)) (STV 1 0.7))", "(: d (Tall bob) (STV 1 1))", "(: e (Size cat x) (STV 1 1))"]
    rules = ["(: big (Implication (Premises (Size $x $n) (GreaterThan $n 5)) (Conclusions (Big $x))) (STV 1 1))", "(: any (Implication (Premises (Or (Big $x) (Tall $x))) (Conclusions (Seen $x))) (STV 1 1))", "(: well (Implication (Premises (And (Seen $x) (Not (Sick $x)))) (Conclusions (Well $x))) (STV 1 1))", "(: two (Implication (Premises (Size $x $n) (Size $y $m) (Different $x $y)) (Conclusions (Pair $x $y))) (STV 1 1))"]
    got = derived(spark, given, rules[:3])
    assert {k for k in got if k[0] in ("Big", "Seen", "Well")} == {("Big", "ann"), ("Seen", "ann"), ("Seen", "bob"), ("Well", "ann")} and got["Well", "ann"] == (1.0, 0.7)
    with pytest.raises(ValueError, match="share no variable"):
        derived(spark, given, rules[3:])


def test_rules_that_are_refused():
    for bad in ("(: r (Implication (Premises (P $x)) (Conclusions (Q $y))) (STV 1 1))", "(: f (P x) (STV 1 1))", "(: r (Implication (Premises (P $x) (Compute pow ($x 2) -> $y)) (Conclusions (Q $y))) (STV 1 1))", "(: r (Implication (Premises (AverageDist $x -> $y)) (Conclusions (Q $y))) (STV 1 1))", "(: r (Implication (Conclusions (Q a))) (STV 1 1))"):
        with pytest.raises(ValueError):
            C.rules(bad)
    for bad in ("", "(a", "a b", "a)"):
        with pytest.raises(ValueError):
            C.parse(bad)


def test_open_goals_and_repeated_variables(spark):
    f = facts(spark, "(: a (P x x) (STV 1 1))", "(: b (P x y) (STV 1 1))")
    assert {r.v for r in C.answers(f, "(: $prf (P $v $v) $tv)").collect()} == {"x"}
    assert {(r.u, r.w) for r in C.answers(f, "(: $prf (P $u $w) $tv)").collect()} == {("x", "x"), ("x", "y")}
    assert C.answers(f.limit(0), "(: $prf (P $u y) $tv)").collect() == []


def test_folds(spark):
    f = facts(spark, "(: a (H ann 2) (STV 1 1))", "(: b (H ann 4) (STV 1 1))", "(: c (H bob x) (STV 1 1))")
    h = C.Atom("H", ("$p", "$v"))
    assert {r.p: r.average for r in C.average(f, h, "$v", ["$p"]).collect()} == {"ann": 3.0, "bob": None}
    assert {r.p: r.folded for r in C.fold(f, h, "$v", ["$p"], "sum", 1.0).collect()}["ann"] == 7.0
    with pytest.raises(ValueError):
        C.fold(f, h, "$v", ["$p"], "product")


def test_distributions(spark):
    given = ["(: g (Group g1) (STV 1 1))", "(: h1 (HeightDist g1 alice) (PointMass 160.0))", "(: h2 (HeightDist g1 bob) (ParticleFromNormal 170.0 3.0))", "(: h3 (HeightDist g2 eve) (ParticleFromPairs ((1 1.0) (3 3))))", "(: h4 (HeightDist g1 joe) (ParticleFromNormal x y))", "(: r (Rectangle r1) (STV 0.9 0.8))", "(: l (LengthDist r1) (ParticleFromNormal 3 0.4))", "(: w (WidthDist r1) (PointMass 2))", "(: five (P $a $b $c $d $e) (STV 1 1))"]
    rules = [
        "(: avg (Implication (Premises (Group $g) (AverageDist (HeightDist $g $person) -> $d)) (Conclusions (AvgHeightDist $g))) (STV 1.0 1.0))",
        "(: area (Implication (Premises (Rectangle $r) (Map2Dist * (LengthDist $r) (WidthDist $r) -> $a)) (Conclusions (AreaDist $r))) (STV 1.0 0.9))",
        "(: tall (Implication (Premises (AvgHeightDist $g) (GreaterThan (AvgHeightDist $g) (LengthDist r1))) (Conclusions (Tall $g))) (STV 1 1))",
        "(: all (Implication (Premises (Group $g) (FoldAllValue (HeightDist $x $y) $v 0 max -> $m)) (Conclusions (MostDist $g))) (STV 1 1))",
        "(: size (Implication (Premises (Group $g) (AreaDist r1) (MapDist square (AreaDist r1) -> $m) (Compute + ($m 1) -> $n)) (Conclusions (Size $g $n))) (STV 1 1))",
    ]
    f = facts(spark, *given)
    made, skipped = C.compiled([*rules, "(: x (Implication (Premises (Odd (a b) c d)) (Conclusions (Q z))) (STV 1 1))"])
    assert len(made) == 5 and len(skipped) == 1 and "flat" in skipped[0][1]
    got = {(r.head, *r.args): (round(r.value.mu, 6), round(r.value.sigma, 6)) if r.value else None for r in C.chain(f, made, whole=True).collect()}
    assert got["HeightDist", "g2", "eve"] == (2.5, round(0.75**0.5, 6)) and ("HeightDist", "g1", "joe") not in got
    assert got["AvgHeightDist", "g1"] == (165.0, 1.5) and got["AreaDist", "r1"] == (6.0, 0.8) and got["Tall", "g1"] is None and got["MostDist", "g1"] == (170.0, 0.0)
    assert ("Size", "g1", "37.0") in got
    assert {(r.strength, r.confidence, r.value.mu) for r in C.prove(f, made, "(: $prf (AreaDist r1) $a)").collect()} == {(0.9, 0.8, 6.0)}
    assert C.prove(f.limit(0), made, "(: $prf (AvgHeightDist $g) $a)").collect() == []
    loop = C.rules("(: l (Implication (Premises (Group $g) (AverageDist (ADist $g $p) -> $d)) (Conclusions (ADist $g $g))) (STV 1 1))")
    with pytest.raises(ValueError):
        C.chain(f, loop)


def test_top_k(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [2.0, 0.0]), (None, [1.0, 0.0]), (8, [float("nan"), 1.0])]
    df = spark.createDataFrame(rows, "id bigint, v array<double>")
    got = [(r.query_id, r["rank"], r.id, round(r.score, 4)) for r in R.top_k(df.where("id in (1, 4)"), df, "id", "id", "v", 3).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, 1, 1.0), (1, 2, 7, 1.0), (1, 3, 3, 0.7071)]
    assert R.top_k(df.limit(0), df, "id", "id", "v").collect() == [] and R.top_k(df.where("id = 1"), df.limit(0), "id", "id", "v").collect() == []


def test_context_and_fragments(spark):
    kb = spark.createDataFrame([(i, f"a{i}") for i in range(60)] + [(60, " "), (61, "a5")], "seq bigint, atom string")
    got = [r.atom for r in R.enriched(kb, spark.createDataFrame([(1, "a3"), (2, "new"), (3, None)], "seq bigint, atom string"), 5).orderBy("place").collect()]
    assert got == ["a56", "a57", "a58", "a59", "new"]
    x = spark.createDataFrame([("(: p (Has dog tail) (STV 1 1)) (a) (Has dog tail)",)], "x string")
    assert x.select(R.proof_fragments(F.col("x")).alias("r")).first().r == ["(Has dog tail)"]


QS, CS, SG = "question_no int, question string", "question_no int, pos int, goal string", "tier int, seq bigint, head string, args array<string>"


def test_plans(spark):
    q = spark.createDataFrame([(1, "Is Rex an animal?"), (2, "Who barks?"), (3, "Is the cup located in the kitchen?"), (4, ""), (5, None)], QS)
    c = spark.createDataFrame([(1, 0, "(: $prf (IsA $x animal) $tv)"), (1, 1, "(: $prf (IsA rex animal) $tv)"), (2, 0, "(: $prf (Nope $x) $tv)"), (2, 1, "(: $prf (Bark $x) $tv)"), (3, 0, "(: $prf (At cup kitchen) $tv)"), (3, 1, "junk")], CS)
    s = spark.createDataFrame([(0, 1, "IsA", ["rex", "dog"]), (1, 2, "IsA", ["$x", "animal"]), (0, 3, "AtLocation", ["cups", "kitchen"]), (0, 4, "Bark", ["rex"])], SG)
    scores = {(r.question_no, r.pos): r.score for r in P.scored(c, q, s).collect()}
    assert scores == {(1, 1): 13, (2, 0): 3, (2, 1): 9, (3, 0): 3}
    plan = {}
    for r in P.planned(c, q, s).orderBy("question_no", "rank").collect():
        plan.setdefault(r.question_no, []).append(r.goal)
    assert plan[1] == ["(: $prf (IsA rex animal) $tv)"] and plan[2] == ["(: $prf (Bark $x) $tv)", "(: $prf (Nope $x) $tv)"]
    assert plan[3] == ["(: $prf (At cup kitchen) $tv)", "(: $prf (AtLocation cups kitchen) $tv)", "(: $prf (AtLocation cup kitchen) $tv)"]
    done = {r.question_no: (r.executed, r.proof) for r in P.executed(P.planned(c, q, s), spark.createDataFrame([(3, 2, "p2"), (3, 3, "p3")], "question_no int, rank int, proof string")).collect()}
    assert done[3] == (plan[3][1], "p2") and done[1] == (plan[1][0], None) and done[2] == (plan[2][1], None)
    assert P.planned(c.limit(0), q, s).collect() == [] and P.scored(c, q, s.limit(0)).count() == 4


def test_hints_of_blank(spark):
    r = spark.createDataFrame([("",), ("Is it never so?",)], "q string").select(P.hints(F.col("q"), F.array().cast("array<string>")).alias("h")).collect()
    assert r[0].h == [] and len(r[1].h) == 3


def test_prepared_context(spark):
    df = spark.createDataFrame([(["; a"], ["(x  y)", "(x y)", None]), (None, None)], "h array<string>, c array<string>")
    assert [r.p for r in df.select(P.prepared(F.col("h"), F.col("c")).alias("p")).collect()] == [["(x y)", "; a"], []]


def test_goal_direction(spark):
    part = "(: p (Implication (Premises (At $a $b) (Part $b $c)) (Conclusions (At $a $c))) (STV 1 1))"
    both = "(: q (Implication (Premises (At $a $b) (At $b $c)) (Conclusions (At $a $c))) (STV 1 1))"
    other = "(: o (Implication (Premises (At $a $b) (Big $b)) (Conclusions (Lost $a))) (STV 1 1))"
    rules = lambda *ts: [r for t in ts for r in C.rules(t)]
    assert {r.name for r in C.relevant(rules(part, other), {"At"})} == {"p"} and {r.name for r in C.relevant(rules(part, other), {"Lost"})} == {"p", "o"}
    assert C.bound_places(rules(part), C.Atom("At", ("x", "y"))) == [0] and C.bound_places(rules(both), C.Atom("At", ("x", "$y"))) == []
    assert C.bound_places(rules(part, other), C.Atom("Lost", ("x",))) == [0] and C.bound_places([], C.Atom("At", ("x", "y"))) == [0, 1]
    given = [f"(: f{i} (At n{i} n{i + 1}) (STV 1 1))" for i in range(4)] + ["(: g (Part n1 n9) (STV 1 1))", "(: h (Big n9) (STV 1 1))"]
    f = facts(spark, *given)
    for goal, want in (("(: $prf (At n0 $y) $tv)", {"n1", "n9"}), ("(: $prf (At $y n9) $tv)", {"n0"})):
        assert {r.y for r in C.prove(f, rules(part, other), goal).collect()} == want
    assert {r.y for r in C.prove(f, rules(part, both, other), "(: $prf (Lost $y) $tv)").collect()} == {"n0"}
    assert {r.y for r in C.prove(f, rules(both), "(: $prf (At n0 $y) $tv)").collect()} == {"n1", "n2", "n3", "n4"}


def test_chain_without_fixpoint_is_no_silent_result(spark):
    rule = C.rules("(: in_in (Implication (Premises (At $a $b) (At $b $c)) (Conclusions (At $a $c))) (STV 1.0 1.0))")
    given = spark.createDataFrame([("At", [f"n{i}", f"n{i + 1}"], 1.0, 1.0, 0, [f"f{i}"]) for i in range(6)], C.FACT)
    for limits in ({"most_rounds": 1}, {"timeout_s": 0.0}):
        with pytest.raises(RuntimeError, match="not the fixpoint"):
            C.chain(given, rule, whole=True, **limits)
        with pytest.warns(RuntimeWarning, match="not the fixpoint"):
            C.chain(given, rule, **limits)
    assert C.chain(given, rule, whole=True).count() == 21


def test_second_way_of_chaining_has_no_limit_of_rows_and_ends_on_circles(spark, monkeypatch):
    from atomloom.plans import knowledge as Q

    rows = [("AtLocation", f"p{i}", f"s{i % 5}", 0.5 + i / 100) for i in range(40)] + [("AtLocation", f"s{i}", "n", 0.9 - i / 10) for i in range(5)] + [("PartOf", "n", "r", 0.6)]
    rows += [("AtLocation", "a", "b", 0.9), ("AtLocation", "b", "c", 0.8), ("PartOf", "c", "a", 0.7), ("AtLocation", "a", "c", 0.5)]
    monkeypatch.setattr(Q.K, "stored_facts", lambda *a: spark.createDataFrame(rows, "head string, subject string, object string, confidence double"))
    spark.conf.set("spark.sql.cteRecursionRowLimit", "50")
    try:
        got = {(r.subject, r.object): r.confidence for r in Q.chain_transitive_cte(spark, "").collect()}
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")
    assert len(got) == 40 * 3 + 5 * 2 + 6
    assert got["p3", "n"] == 0.53 and got["p39", "n"] == 0.5 and got["p39", "r"] == 0.5 and got["s0", "r"] == 0.6
    assert got["a", "c"] == 0.8 and got["a", "a"] == 0.7 and got["b", "b"] == 0.7 and ("c", "a") not in got
