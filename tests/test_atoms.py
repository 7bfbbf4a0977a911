import pytest
from pyspark.sql import functions as F

from atomloom.functions import arrays as A
from atomloom.operators import atoms as X


def one(spark, column, x):
    kind = "string" if x is None or isinstance(x, str) else "array<string>"
    return spark.createDataFrame([(x,)], f"x {kind}").select(column.alias("r")).first().r


def test_simple_atom(spark):
    r = one(spark, X.simple_atom(F.col("x")), " (Has $x  a-b ?y) ")
    assert (r.head, r.args, r.arity, r.variables) == ("Has", ["$x", "a-b", "?y"], 3, ["$x", "?y"])
    assert one(spark, X.simple_atom(F.col("x")), "(Nullary)").arity == 0
    for bad in ("(a (b))", "x", "", "(1a b)", "(a b", None):
        assert one(spark, X.simple_atom(F.col("x")), bad) is None


def test_statement_parts(spark):
    s = "(: id1 (Has  a (b c)) (STV 0.5 0.25))"
    assert one(spark, X.statement_body(F.col("x")), s) == "(Has a (b c))" and one(spark, X.statement_id(F.col("x")), s) == "id1"
    tv = one(spark, X.truth_value(F.col("x")), s)
    assert (tv.strength, tv.confidence) == (0.5, 0.25)
    for bad in ("(: h (Height bob) (PointMass 1.8))", "(: a b (STV 1 1))", "", None):
        assert one(spark, X.statement_body(F.col("x")), bad) is None
    assert [a.head for a in one(spark, X.fact_signatures(F.col("x")), "(: h (Height bob) (ParticleFromNormal 1 2)) (: i (Implication x) (STV 1 1))")] == ["Height"]
    rule = "(: r (Implication (Premises (A $x) (B $x)) (Conclusions (C $x) (D $x y))) (STV 1 1))"
    assert [(a.head, a.arity) for a in one(spark, X.conclusion_signatures(F.col("x")), rule)] == [("C", 1), ("D", 2)]
    assert one(spark, X.premises(F.col("x")), rule) == ["(A $x)", "(B $x)"]


def test_goals(spark):
    assert one(spark, X.goal_signature(F.col("x")), "(: $prf (Has a $y) $tv)").args == ["a", "$y"]
    assert one(spark, X.goal_signature(F.col("x")), "(: $prf (And (Has a b)) $tv)") is None and one(spark, X.goal_signature(F.col("x")), "(: $prf (Has a b) ?tv)") is None
    assert one(spark, X.ground_goal(F.col("x")), "(: ?p (Has  a b) ?t)") == "(Has a b)" and one(spark, X.ground_goal(F.col("x")), "(: $p (Has a $b) $t)") is None
    assert one(spark, X.goal_of(X.goal_signature(F.col("x"))), "(: $p (Has a b) $tv)") == "(: $prf (Has a b) $tv)"


def test_canonical_atom(spark):
    maps = lambda d: F.create_map(*(F.lit(v) for kv in d.items() for v in kv)) if d else F.create_map().cast("map<string,string>")
    f = lambda x, proper={}, concepts={}, protected=(): one(spark, X.canonical_atom(F.col("x"), maps(proper), maps(concepts), F.array(*map(F.lit, protected)).cast("array<string>")), x)
    assert f("(: fooBars (is_a Dogs $bigCats) (STV 1.0 0.9))") == "(: foo_bar (IsA dog $big_cats) (STV 1.0 0.9))"
    assert f("( located_at rack-01s paris)", protected=["paris"]) == "( AtLocation rack-01s paris)"
    assert f("(Has dogs cats)", {"dogs": "Dogs"}, {"cats": "kitten"}) == "(Has Dogs kitten)"
    assert one(spark, X.canonical_classes(F.col("x")), "(IsA a Big-Dogs) x (IsA b cats)") == "(IsA a big_dog) x (IsA b cat)"
    assert f("") == ""


def test_context_symbols(spark):
    m = one(spark, X.context_symbols(F.col("x")), ["(: a (Has dogs box) (STV 1 1))", None, "(: r (Implication (Premises (A $x)) (Conclusions (C $x dog))) (STV 1 1))"])
    assert m == {"dogs": "dogs", "dog": "dogs", "box": "box", "boxes": "box"}
    assert one(spark, X.context_symbols(F.col("x")), []) == {}


@pytest.mark.parametrize(
    "x, keep",
    [("(: r (Implication (Premises (A $x)) (Conclusions (B $x))) (STV 1 1))", True), ("(: r (Implication (A $x)) (STV 1 1))", False), ("(: f (A $x) (STV 1 1))", False), ("(: f (A ?x) (STV 1 1))", True), ("(: f (A x) (STV 1 1))", True)],
)
def test_filter(spark, x, keep):
    assert one(spark, X.keeps(F.col("x")), x) is keep


def test_prune(spark):
    p = lambda premises: one(spark, X.pruned(F.col("x")), f"(: r (Implication (Premises {premises}) (Conclusions (C $x))) (STV 1 1))")
    keep = lambda premises: p(premises) == f"(: r (Implication (Premises {premises}) (Conclusions (C $x))) (STV 1 1))"
    assert "(Premises (B $x y))" in p("(IsA $x dog) (B $x y)")
    assert keep("(IsA $x dog)") and keep("(IsA $x dog) (IsA ?y cat)") and keep("(IsA bob dog) (B $x)") and keep("(And (IsA $x a)) (B $x)")


def test_process_is_idempotent(spark):
    items = ["(: Ab (is_a Cats  animals) (STV 1 1))", "(: Ab (is_a Cats animals) (STV 1 1))", "(: q (Has $x y) (STV 1 1))"]
    none, no = F.create_map().cast("map<string,string>"), F.array().cast("array<string>")
    once = one(spark, X.processed(F.col("x"), none, no, none), items)
    assert once == ["(: ab (IsA cat animal) (STV 1 1))"] and one(spark, X.processed(F.col("x"), none, no, none), once) == once
    assert one(spark, A.dedupe(F.col("x")), once) == once


@pytest.mark.parametrize("x, error", [("(a (b c))", None), ("word", None), ("", "empty expression"), (None, "empty expression"), ("(a (b)", "missing closing parenthesis"), ("(a) b", "unexpected trailing tokens"), (")", None)])
def test_tokens(spark, x, error):
    r = one(spark, X.tokenized(F.col("x")), x)
    assert r.error == error
    if x == "(a (b c))":
        assert list(zip(r.tokens, r.depths)) == [("(", 1), ("a", 1), ("(", 2), ("b", 2), ("c", 2), (")", 2), (")", 1)]
