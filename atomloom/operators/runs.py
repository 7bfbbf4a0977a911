"""Benchmark runs: cases of texts and a question through a parser, the knowledge base and the chaining engine."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atomloom.operators import chaining as C
from atomloom.operators import parsers
from atomloom.operators import planning as P
from atomloom.operators.retrieval import CONTEXT_ATOMS

RESULT = "case_name string, category string, parser string, mode string, statements int, queries int, executed_query string, query_status string, fallback_used boolean, proof_found boolean, correct boolean, total_seconds double, error string"
#: Our own cases: (name, category, texts, question, whether a proof is expected).
CASES = [
    ("cat-animal", "isa", ["Cats are animals.", "Tom is a cat."], "Is Tom an animal?", True),
    ("greek-mortal", "isa", ["Greeks are mortal.", "Plato is a greek."], "Is Plato mortal?", True),
    ("reader-wise", "rule", ["People who read books are wise.", "Hana reads books."], "Is Hana wise?", True),
    ("baker-bakes", "rule", ["Bakers bake bread.", "Ada is a baker."], "Does Ada bake bread?", True),
    ("birds-wings", "rule", ["Birds have wings.", "Polly is a bird."], "Does Polly have wings?", True),
    ("who-wise", "open", ["People who read books are wise.", "Hana reads books."], "Who is wise?", True),
    ("what-read", "open", ["Hana reads books."], "What does Hana read?", True),
    ("glue-used", "relation", ["Glue is used for fixing chairs."], "Is glue used for fixing chairs?", True),
    ("bird-capable", "relation", ["Polly is capable of flying."], "Is Polly capable of flying?", True),
    ("wheel-part", "relation", ["A wheel is part of a car."], "Is a wheel part of a car?", True),
    ("oven-kitchen", "relation", ["The oven is located in the kitchen."], "Is the oven located in the kitchen?", True),
    ("plural-question", "normalization", ["A wheel is part of a car."], "Are wheels part of cars?", True),
    ("missing", "negative", ["Cats are animals."], "Is Tom an animal?", False),
    ("unrelated", "negative", ["Cats are animals.", "Tom is a cat."], "Is Tom a plant?", False),
]
QUICK = ["cat-animal", "reader-wise", "who-wise", "glue-used", "missing"]
#: The built-in smoke suite in its order, and its quick part.
SMOKE = [
    ("dog-animal-yesno", "isa", ["Dogs are animals.", "Fido is a dog."], "Is Fido an animal?", True),
    ("human-mortal-yesno", "isa", ["Humans are mortal.", "Socrates is a human."], "Is Socrates mortal?", True),
    ("fish-smart-yesno", "rule", ["People who eat fish are smart.", "Kebede eats fish."], "Is Kebede smart?", True),
    ("teacher-educates-yesno", "rule", ["Teachers educate students.", "Marta is a teacher."], "Does Marta educate students?", True),
    ("programmer-solves-yesno", "rule", ["Programmers solve problems.", "Bekele is a programmer."], "Does Bekele solve problems?", True),
    ("who-is-smart-open", "open", ["People who eat fish are smart.", "Kebede eats fish."], "Who is smart?", True),
    ("what-does-kebede-eat-open", "open", ["Kebede eats fish."], "What does Kebede eat?", True),
    ("hasa-dog-nose", "relation", ["Dogs have noses.", "Fido is a dog."], "Does Fido have a nose?", True),
    ("usedfor-soap-cleaning", "relation", ["Soap is used for cleaning."], "Is soap used for cleaning?", True),
    ("capableof-dog-drink-water", "relation", ["Dogs are capable of drinking water."], "Is dog capable of drinking water?", True),
    ("partof-automobile-horn-car", "relation", ["An automobile horn is part of a car."], "Is automobile horn part of car?", True),
    ("plural-dolphins-mammals", "normalization", ["Dolphins are mammals."], "Are dolphins mammals?", True),
    ("negative-missing-fido", "negative", ["Dogs are animals."], "Is Fido an animal?", False),
    ("negative-unrelated-query", "negative", ["Cats are animals."], "Is soap used for cleaning?", False),
]
SMOKE_QUICK = ["dog-animal-yesno", "fish-smart-yesno", "what-does-kebede-eat-open", "usedfor-soap-cleaning", "negative-missing-fido"]


def _spaced(e, space: str):
    """An expression with every head put into a name space, so cases don't see each other's facts."""
    if not isinstance(e, list):
        return e
    if e[0] in ("Implication", "Premises", "Conclusions", "And", "Or", "Not"):
        return [e[0], *(_spaced(x, space) for x in e[1:])]
    return [f"{space}/{e[0]}", *e[1:]]


def _text(e) -> str:
    return e if isinstance(e, str) else f"({' '.join(map(_text, e))})"


def run(spark: SparkSession, cases: list[tuple], parser_name: str = "template", mode: str = "isolated") -> DataFrame:
    """A row for each case (RESULT). isolated: each case has a knowledge base of its own; cumulative: a case sees the texts of all cases up to its own.

    A suite is a bounded list held by the driver. All cases are proved by one run of the chaining engine, each in a
    name space of heads; a case that fails becomes a row with status error and no time.
    """
    began, rows, statements, asked = time.time(), {}, [], {}
    table = spark.createDataFrame([(i, c[2], c[3]) for i, c in enumerate(cases)], "case_no int, texts array<string>, question string")
    p = parsers.parser(parser_name)
    made = {r.case_no: r.statements for r in p.parse_batch(table, "case_no", "texts").collect()}
    own = lambda i: [s for j in (range(i + 1) if mode == "cumulative" else [i]) for s in made.get(j) or []]
    seen = spark.createDataFrame([(i, c[3], own(i)[-CONTEXT_ATOMS:]) for i, c in enumerate(cases)], "case_no int, question string, context array<string>")
    goals = {r.case_no: r.queries for r in p.parse_query(seen, "case_no", "question").collect()}
    for i in range(len(cases)):
        try:
            spaced = [_text([e[0], e[1], _spaced(e[2], str(i)), e[3]]) for e in map(C.parse, own(i))]
            asked[i] = [(q, C.Atom.of(_spaced(C.parse(q)[2], str(i)))) for q in goals[i]]
            statements += spaced
            rows[i] = None
        except (ValueError, KeyError) as e:
            rows[i] = str(e)
    rules = [r for s in dict.fromkeys(statements) if "(Implication" in s for r in C.rules(s)]
    heads = {a.head for _, a in (x for xs in asked.values() for x in xs)}
    facts = []
    for s in statements:
        e = C.parse(s)
        if e[2][0] != "Implication":
            a = C.Atom.of(e[2])
            facts.append((a.head, list(a.args), float(e[3][1]), float(e[3][2]), 0, [e[1]]))
    known = C.chain(spark.createDataFrame(facts, C.FACT), rules, timeout_s=600) if facts else spark.createDataFrame([], C.FACT)
    proved = [(r.head, tuple(r.args)) for r in known.where(F.col("head").isin(list(heads))).select("head", "args").collect()]  # facts of a suite's goals only
    seconds = (time.time() - began) / max(1, len(cases))

    def fits(a: C.Atom) -> bool:
        def one(args):
            bound: dict[str, str] = {}
            return len(args) == len(a.args) and all(bound.setdefault(g, x) == x if C.is_var(g) else g == x for g, x in zip(a.args, args))

        return any(h == a.head and one(args) for h, args in proved)

    out = []
    for i, (name, category, _, question, expected) in enumerate(cases):
        if rows[i] is not None:
            out.append((name, category, parser_name, mode, 0, 0, None, "error", False, False, False, 0.0, rows[i]))
            continue
        hit = next((q for q, a in asked[i] if fits(a)), None)
        original = asked[i][0][0] if asked[i] else None
        tried = hit or (asked[i][-1][0] if asked[i] else None)
        out.append((name, category, parser_name, mode, len(made[i]), len(goals[i]), tried, question if original is None else original, tried != original, hit is not None, (hit is not None) == expected, seconds, None))
    df = spark.createDataFrame(out, RESULT)
    texts = spark.createDataFrame([(c[0], c[3]) for c in cases], "case_name string, question string")
    status = F.when(F.col("query_status") == "error", "error").otherwise(P.status(F.col("question"), F.when(F.col("executed_query").isNotNull(), F.col("query_status")), F.col("fallback_used")))
    return df.join(texts, "case_name").withColumn("query_status", status).drop("question")


def compared(spark: SparkSession, cases: list[tuple], names: list[str]) -> DataFrame:
    """The same cases through several parsers; a parser that can't be had gives error rows."""
    out = None
    for n in names:
        try:
            one = run(spark, cases, n)
        except ValueError as e:
            one = spark.createDataFrame([(c[0], c[1], n, "isolated", 0, 0, None, "error", False, False, False, 0.0, str(e)) for c in cases], RESULT)
        out = one if out is None else out.unionByName(one)
    return out
