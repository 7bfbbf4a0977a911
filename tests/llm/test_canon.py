import random

import pytest

from atomloom.llm import canon

PLACES = ["amber_chapel", "amber_wharf", "salt_wharf", "salt_lighthouse", "lower_granary", "north_quarry", "upper_reservoir"]
MATERIALS = ["woven_wool", "pressed_pewter", "smoked_walnut"]


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i + 1, s, "place", ["cinder_spot"] if i == 1 else []) for i, s in enumerate(PLACES)] + [(i + 101, s, "material", None) for i, s in enumerate(MATERIALS)]
    return spark.createDataFrame(rows, "canon_id int, symbol string, kind string, aliases array<string>")


def fact(value, predicate="AtLocation"):
    return f"(: x_1 ({predicate} x_cup {value}) (STV 1.0 0.9))"


def test_cases(spark, table):
    cases = {
        "amber_chapl": 1, "chapel_amber": 1, "AMBER-CHAPELS": 1, "amberChappel": 1, "aamberchapel": 1, "chapelambr": 1, "the_amber_chapel_area": 1, "cinder_spot": 2, "CINDER-SPOT": 2, "cindr_spot": 2,
        "slt_whrf": 3, "salt_lghths": 4, "salt_lthse": 4, "lower_granaries": 5, "lowér_gr4nary": 5, "nth_qry": 6, "upper_resv": 7, "lunar_igloo": 0, "amber_quarry": 0, "amber": 0, "woven_wool": None, "woven_woool": 0, "unknown": 0,
    }
    values = list(cases)
    items = spark.createDataFrame([(1, [fact(v) for v in values], "k")], "item_id bigint, atoms array<string>, kind string")
    got = {r.value: r.canon_id for r in canon.matched(items, table).collect()}
    assert got == {k: v for k, v in cases.items() if v is not None}


def test_writings_and_nulls(spark, table):
    atoms = ['(: "x" ( "AtLocation" "x_cup" "amber_chapl" ) ("STV" 1.0 0.9))', "'(: x ( atlocation x_cup amber_chapl ) (stv 1.0 0.9)) .'", "  (:  X (AT_LOCATION, X_CUP, AMBER_CHAPL)\r\n(STV 1 1))", fact("woven_wol", "MadeOf"), fact("amber_chapl", "IsA"), "(: r (Implication (Premises (AtLocation $x amber_chapl)) (Conclusions (HasA $x y))) (STV 1.0 1.0))", None, "", "  ", "AtLocation", "(AtLocation a", "(: x (AtLocation) (STV 1 1))", fact("amber_chapel"), fact("z" * 5000), "(: x (A_t_Loc.ation x_cup amber_chapl) (STV 1.0 0.9))", "(: x (U-s-e-d-F-o-r x_cup unknown_thing) (STV 1.0 0.9))"]
    rows = [(1, atoms, "a"), (1, atoms[:1], "a"), (2, None, "a"), (3, [], "a"), (None, atoms[:1], "b")]
    got = sorted((str(r.id), r.atom_no, r.canon_id) for r in canon.matched(spark.createDataFrame(rows, "item_id bigint, atoms array<string>, value string"), table).collect())
    assert got == sorted([("1", 0, 1), ("1", 0, 1), ("1", 1, 1), ("1", 2, 1), ("1", 3, 101), ("1", 13, 0), ("1", 14, 1), ("1", 15, 0), ("None", 0, 1)])
    assert canon.matched(spark.createDataFrame([], "item_id bigint, atoms array<string>"), table).collect() == []
    assert [r.canon_id for r in canon.matched(spark.createDataFrame(rows[:2], "item_id bigint, atoms array<string>, value string"), table.limit(0)).collect()] == [0] * 9  # without a list even the exact one is no symbol


@pytest.mark.parametrize("rows", [10**9, 0])
def test_random_edits_with_and_without_broadcast(spark, table, monkeypatch, rows):
    monkeypatch.setattr(canon, "BROADCAST_ROWS", rows)
    rng = random.Random(5)

    def edit(w):
        i = rng.randrange(1, len(w))
        return rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("qxzj") + w[i:], w[:i] + "x" + w[i + 1 :]])

    made = []
    for _ in range(120):
        n = rng.randrange(len(PLACES))
        a, b = PLACES[n].split("_")
        a, b = edit(a), edit(b)
        made.append((fact("_".join(rng.choice([(a, b), (b, a)]))), n + 1))
    got = {r.atom_no: r.canon_id for r in canon.matched(spark.createDataFrame([(1, [m for m, _ in made])], "item_id bigint, atoms array<string>"), table).collect()}
    assert sum(got.get(i) == n for i, (_, n) in enumerate(made)) >= 118
