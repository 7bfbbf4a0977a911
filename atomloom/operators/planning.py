"""Goal planning: candidate goals of questions scored against the signatures that facts and conclusions have.

candidates is (question_no, pos, goal), questions (question_no, question), signatures (tier, seq, head, args) with tier 0
for facts and 1 for conclusions; with a column question_no they are those of one question each. Candidates are few by nature; they are checked for their number before they are sent
to all executors, so signatures are never shuffled but by the aggregates made of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atomloom.functions import arrays as A
from atomloom.functions import symbols as S
from atomloom.operators import atoms as X

#: First words of yes/no questions, words of open ones, phrases that name a head, goal patterns of questions.
AUXILIARIES = ["is", "are", "was", "were", "does", "do", "did", "can", "could", "has", "have", "had"]
OPEN_WORDS = ["who", "what", "when", "where", "why", "how", "which"]
PLACE_PHRASES = ["located at", "located in", " in the ", " in a ", " in an "]
HEAD_PHRASES = {"UsedFor": "used for", "CapableOf": "capable of", "PartOf": "part of"}
PATTERNS = {
    "HasA": r"^(?:does|do|did|has|have|had)\s+(.+?)\s+have\s+(.+)$",
    "UsedFor": r"^(?:is|are|was|were)\s+(.+?)\s+used for\s+(.+)$",
    "CapableOf": r"^(?:is|are|was|were|can|could)\s+(.+?)\s+capable of\s+(.+)$",
    "PartOf": r"^(?:is|are|was|were)\s+(.+?)\s+part of\s+(.+)$",
    "AtLocation": r"^(?:is|are|was|were)\s+(.+?)\s+located (?:at|in|on)\s+(.+)$",
}
SLOTS = ["$prf", "$tv", "?prf", "?tv"]
EXISTENTIAL = ["any", "anything", "someone", "somebody", "something"]
#: Most candidates and questions of one call.
MOST_CANDIDATES = 100_000
HINTED_HEADS, BATCH_HEADS, HINTED_CONCEPTS = 5, 8, 12
#: The comment lines that a parser gets, by what they are for.
HINT_YES_NO = "; query intent: yes/no question - prefer a direct provable query"
HINT_OPEN = "; query intent: open question - prefer a variable-bearing query"
HINT_EXISTENTIAL = "; existential wording may justify a helper predicate when a direct query shape is not derivable"
HINT_NEGATIVE = "; use negation only if it is directly supported by explicit facts or rules"
HINT_HEADS = "; prioritize these predicate heads first: "
HINT_EXECUTABLE = "; preserve the question semantics while keeping the final query executable"
NEGATIVE = ["not", "never"]
BATCH_LINES = [
    "; keep PLN structural constructors exactly as Implication, Premises, Conclusions, STV, And, Not",
    "; keep IsA as the canonical class-membership predicate",
    "; normalize entity and class symbols to lowercase snake_case",
    "; lemmatize common nouns and verbs so plural and singular forms reuse one symbol",
    "; reuse existing predicate heads from context when possible",
    "; keep symbols consistent across all sentences in this batch",
]
CONCEPT_LINE, HEADS_LINE = "; canonical common concepts: ", "; preferred predicate heads: "
QUERY_LINE = "; query mode: ask only for forms that your own facts or rules can directly derive"
STATEMENT_LINE = "; statement mode: prefer rules whose conclusions match the eventual query predicate shape"


def is_yes_no(question: Column) -> Column:
    return F.split_part(S.normalize_text(question), F.lit(" "), F.lit(1)).isin(AUXILIARIES)


def begins_yes_no(question: Column) -> Column:
    """The service's own test: on the raw text, with the space that follows."""
    return F.lower(S.stripped(question)).rlike(f"^(?:{'|'.join(AUXILIARIES)}) ")


def has_goal_variables(goal: Column) -> Column:
    return F.size(F.array_except(F.regexp_extract_all(goal, F.lit(r"[$?][A-Za-z_][A-Za-z0-9_]*"), F.lit(0)), F.array(*map(F.lit, SLOTS)))) > 0


def status(question: Column, goal: Column, fallback_used: Column) -> Column:
    """no_query without a goal, weakly_aligned after a fallback or for a yes/no question with an open goal, else well_aligned."""
    return F.when(F.coalesce(goal, F.lit("")) == "", "no_query").when(fallback_used | (begins_yes_no(question) & has_goal_variables(goal)), "weakly_aligned").otherwise("well_aligned")


def _own(signatures: DataFrame) -> list[str]:
    """question_no, if each question has signatures of its own."""
    return [c for c in ("question_no",) if c in signatures.columns]


def _same(signatures: DataFrame) -> list[Column]:
    return [F.col("c.question_no") == F.col("s.question_no") for _ in _own(signatures)]


def few(df: DataFrame) -> DataFrame:
    """A table that is sent to all executors, after a check of its size."""
    if df.limit(MOST_CANDIDATES + 1).count() > MOST_CANDIDATES:
        raise ValueError(f"more than {MOST_CANDIDATES} candidates in one call: plan them in parts")
    return F.broadcast(df)


def parsed(candidates: DataFrame, questions: DataFrame) -> DataFrame:
    """(question_no, pos, goal, head, args, open, yes_no, constants): candidates that are flat goals."""
    df = candidates.join(questions, "question_no").withColumn("a", X.goal_signature(F.col("goal"))).where("a is not null")
    return df.select("question_no", "pos", "goal", F.col("a.head").alias("head"), F.col("a.args").alias("args"), (F.size("a.variables") > 0).alias("open"), is_yes_no(F.col("question")).alias("yes_no"), A.constants(F.col("question")).alias("constants"), S.normalize_text(F.col("question")).alias("norm"))


def binds(goal: Column, sig: Column) -> Column:
    """Every constant of the goal is equal; if it has variables, at least one meets a constant."""
    pairs = F.arrays_zip(goal.alias("g"), sig.alias("s"))
    var = X.is_variable
    fits = F.forall(pairs, lambda p: var(p["g"]) | (p["g"] == p["s"]))
    witness = F.exists(pairs, lambda p: var(p["g"]) & ~var(p["s"]))
    return fits & (witness | ~F.exists(goal, var))


def scored(candidates: DataFrame, questions: DataFrame, signatures: DataFrame) -> DataFrame:
    """(question_no, pos, goal, score int) of the candidates that score: 6 for a fact and 4 for a conclusion of its shape; ground 3 in a yes/no question, else 1;
    open 3 in an open question, else 0; 2 if a fact has its arguments. An open goal of a yes/no question without a signature it can bind to is dropped."""
    c = few(parsed(candidates, questions))
    shape = [F.col("c.head") == F.col("s.head"), F.size("c.args") == F.size("s.args")]
    shape += _same(signatures)
    s = signatures.groupBy(*_own(signatures), "head", "args").agg(F.bool_or(F.col("tier") == 0).alias("fact"), F.bool_or(F.col("tier") == 1).alias("conclusion"))
    same_args = F.col("c.args") == F.col("s.args")
    seen = s.alias("s").join(c.alias("c"), shape).groupBy("c.question_no", "c.pos").agg(F.bool_or("fact").alias("fact"), F.bool_or("conclusion").alias("conclusion"), F.bool_or(binds(F.col("c.args"), F.col("s.args"))).alias("witness"), F.bool_or(F.col("fact") & same_args).alias("given"))
    df = c.join(seen, ["question_no", "pos"], "left")
    yes = lambda x, n: F.when(F.coalesce(F.col(x), F.lit(False)), n).otherwise(0)
    kind = F.when(~F.col("open"), F.when(F.col("yes_no"), 3).otherwise(1)).otherwise(F.when(F.col("yes_no"), 0).otherwise(3))
    df = df.withColumn("score", yes("fact", 6) + yes("conclusion", 4) + kind + yes("given", 2))
    return df.where(~(F.col("yes_no") & F.col("open") & ~F.coalesce("witness", F.lit(False))) & (F.col("score") > 0)).select("question_no", "pos", "goal", "score")


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """(question_no, rank, goal): goals of each question by the order, repeated ones dropped."""
    first = df.groupBy("question_no", "goal").agg(F.min(F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)))).alias("o"))
    return first.select("question_no", F.row_number().over(Window.partitionBy("question_no").orderBy("o")).alias("rank"), "goal")


def rendered(head: Column, args: Column) -> Column:
    return F.concat(F.lit("(: $prf ("), F.concat_ws(" ", head, F.array_join(args, " ")), F.lit(") $tv)"))


def grounded(candidates: DataFrame, questions: DataFrame, signatures: DataFrame) -> DataFrame:
    """(question_no, rank, goal): for open candidates the ground signatures of their shape that keep their constants: 5 if one has a constant of the question, 3 for a fact, 2 for a conclusion."""
    c = few(parsed(candidates, questions).where("open"))
    s = signatures.where(~F.exists("args", X.is_variable)).groupBy(*_own(signatures), "head", "args").agg(F.max(F.when(F.col("tier") == 0, 3).otherwise(0)).alias("f"), F.max(F.when(F.col("tier") == 1, 2).otherwise(0)).alias("k"), F.min(F.struct("tier", "seq")).alias("at"))
    j = s.alias("s").join(c.alias("c"), [F.col("c.head") == F.col("s.head"), F.size("c.args") == F.size("s.args"), *_same(signatures), binds(F.col("c.args"), F.col("s.args"))])
    score = F.when(F.arrays_overlap("c.constants", "s.args"), 5).otherwise(0) + F.col("f") + F.col("k")
    return ranked(j.select("c.question_no", rendered(F.col("s.head"), F.col("s.args")).alias("goal"), score.alias("score"), "pos", "at"), -F.col("score"), F.col("pos"), F.col("at"))


def preferred_heads(norm: Column) -> Column:
    """Heads that phrases of the question name."""
    place = F.when(F.lit(False), F.lit(None))
    for p in PLACE_PHRASES:
        place = place.when(F.contains(norm, F.lit(p)), F.lit("AtLocation"))
    return F.array_compact(F.array(place, *(F.when(F.contains(norm, F.lit(p)), F.lit(h)) for h, p in HEAD_PHRASES.items())))


def alignment(goal_head: Column, goal: Column, sig_head: Column, sig: Column, words: Column) -> Column:
    """Per argument 4 if equal, 3 if canonically equal, 2 if its parts are among the signature's, 1 if the question has one of these; 3 for another head; null if an argument has nothing."""
    parts = lambda x: F.split(x, "_")

    def one(g: Column, s: Column) -> Column:
        return F.when(g == s, 4).when(S.canonical(g) == S.canonical(s), 3).when(F.size(F.array_except(parts(g), parts(s))) == 0, 2).when(F.arrays_overlap(parts(s), words), 1)

    each = F.zip_with(goal, sig, one)
    total = F.aggregate(each, F.lit(0), lambda a, b: a + b)
    return F.when(F.forall(each, lambda x: x.isNotNull()), total + F.when(goal_head != sig_head, 3).otherwise(0))


def aligned(candidates: DataFrame, questions: DataFrame, signatures: DataFrame) -> DataFrame:
    """(question_no, rank, goal): signatures with a head the question prefers that align with a ground candidate of the same arity."""
    c = few(parsed(candidates, questions).where(~F.col("open")).withColumn("heads", preferred_heads(F.col("norm"))).where(F.size("heads") > 0).withColumn("words", F.split("norm", " ")).withColumn("head_wanted", F.explode("heads")))
    s = signatures.groupBy(*_own(signatures), "head", "args").agg(F.min(F.struct("tier", "seq")).alias("at"))
    j = s.alias("s").join(c.alias("c"), [F.col("c.head_wanted") == F.col("s.head"), F.size("c.args") == F.size("s.args"), *_same(signatures)])
    j = j.withColumn("score", alignment(F.col("c.head"), F.col("c.args"), F.col("s.head"), F.col("s.args"), F.col("words"))).where("score > 0")
    return ranked(j.select("c.question_no", rendered(F.col("s.head"), F.col("s.args")).alias("goal"), "score", "pos", "at"), -F.col("score"), F.col("pos"), F.col("at"))


def heuristic(questions: DataFrame) -> DataFrame:
    """(question_no, rank, goal): ground goals by five patterns of the question."""
    norm = S.normalize_text(F.col("question"))
    made = []
    for head, pattern in PATTERNS.items():
        a, b = (S.canonical_phrase(F.regexp_extract(norm, pattern, i)) for i in (1, 2))
        made.append(F.when((a != "") & (b != ""), F.concat(F.lit(f"(: $prf ({head} "), a, F.lit(" "), b, F.lit(") $tv)"))))
    return questions.select("question_no", F.posexplode(F.array_compact(F.array(*made))).alias("rank", "goal")).withColumn("rank", F.col("rank") + 1)


def planned(candidates: DataFrame, questions: DataFrame, signatures: DataFrame) -> DataFrame:
    """(question_no, rank, goal): scored candidates, then aligned goals, then for yes/no questions grounded and heuristic ones.

    If no candidate scores: for a yes/no question all candidates, then grounded and heuristic ones; else the first candidate.
    """
    cand = few(candidates)
    s = scored(cand, questions, signatures)
    ok = s.select("question_no").distinct()
    yes = questions.where(is_yes_no(F.col("question"))).select("question_no")
    has = cand.select("question_no").distinct()
    tier = lambda df, n, *o: df.select("question_no", "goal", F.lit(n).alias("tier"), *(x.alias(f"k{i}") for i, x in enumerate(o)))
    zero = F.lit(0)
    parts = [
        tier(s, 0, -F.col("score"), F.col("pos")),
        tier(cand.join(ok, "question_no", "left_anti").join(yes, "question_no"), 0, zero, F.col("pos")),
        tier(cand.join(ok, "question_no", "left_anti").join(yes, "question_no", "left_anti").groupBy("question_no").agg(F.min_by("goal", "pos").alias("goal")), 0, zero, zero),
        tier(aligned(s.select("question_no", F.row_number().over(Window.partitionBy("question_no").orderBy(F.desc("score"), "pos")).alias("pos"), "goal"), questions, signatures), 1, F.col("rank"), zero),
        tier(grounded(cand, questions, signatures).join(yes, "question_no"), 2, F.col("rank"), zero),
        tier(heuristic(questions).join(yes, "question_no").join(has, "question_no"), 3, F.col("rank"), zero),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return ranked(out, F.col("tier"), F.col("k0"), F.col("k1"))


def scored_or_first(candidates: DataFrame, questions: DataFrame, signatures: DataFrame) -> DataFrame:
    """(question_no, rank, goal): the plan without goals of its own making: scored candidates by score, then place; where none scores the first candidate."""
    cand = few(candidates)
    s = scored(cand, questions, signatures)
    first = cand.join(s.select("question_no").distinct(), "question_no", "left_anti").groupBy("question_no").agg(F.min_by("goal", "pos").alias("goal"))
    both = s.select("question_no", "goal", (-F.col("score")).alias("k"), "pos").unionByName(first.select("question_no", "goal", F.lit(0).alias("k"), F.lit(0).alias("pos")))
    return ranked(both, F.col("k"), F.col("pos"))


def executed(plan: DataFrame, found: DataFrame, fallback: bool = True) -> DataFrame:
    """(question_no, executed, proof): the first goal of each plan that was proved, else the last tried; found is (question_no, rank, proof)."""
    tried = plan if fallback else plan.where("rank = 1")
    j = tried.join(found, ["question_no", "rank"], "left")
    key = F.struct(F.col("proof").isNull(), F.when(F.col("proof").isNull(), -F.col("rank")).otherwise(F.col("rank")))
    return j.groupBy("question_no").agg(F.min_by("goal", key).alias("executed"), F.min_by("proof", key).alias("proof"))


def prepared(batch_hints: Column, context: Column) -> Column:
    """The context a parser gets: atoms, then hints of the batch, white space collapsed and repeated ones dropped."""
    return A.dedupe(F.concat(F.coalesce(context, F.array().cast("array<string>")), F.coalesce(batch_hints, F.array().cast("array<string>"))))


def batch_hints(concepts: Column, context: Column, question: Column | None = None) -> Column:
    """Comment lines for a batch of sentences, or for a question if it is given: fixed ones, its concepts, heads of the context, its mode."""
    heads = A.context_heads(F.coalesce(context, F.array().cast("array<string>")))
    listed = lambda text, xs: F.when(F.size(xs) > 0, F.concat(F.lit(text), F.array_join(xs, ", ")))
    lines = F.array_compact(F.array(*map(F.lit, BATCH_LINES), listed(CONCEPT_LINE, F.slice(concepts, 1, HINTED_CONCEPTS)), listed(HEADS_LINE, F.slice(heads, 1, BATCH_HEADS)), F.lit(STATEMENT_LINE if question is None else QUERY_LINE)))
    return lines if question is None else F.concat(lines, hints(question, heads))


def hints(question: Column, heads: Column) -> Column:
    """Comment lines on the intent of a question, for a model."""
    norm = S.normalize_text(question)
    words = F.split(norm, " ")
    any_of = lambda xs: F.arrays_overlap(words, F.array(*map(F.lit, xs)))
    intent = F.when(words[0].isin(AUXILIARIES), HINT_YES_NO).when(any_of(OPEN_WORDS), HINT_OPEN)
    lines = F.array_compact(
        F.array(
            intent,
            F.when(any_of(EXISTENTIAL), F.lit(HINT_EXISTENTIAL)),
            F.when(any_of(NEGATIVE), F.lit(HINT_NEGATIVE)),
            F.when(F.size(heads) > 0, F.concat(F.lit(HINT_HEADS), F.array_join(F.slice(heads, 1, HINTED_HEADS), ", "))),
            F.when(question.endswith("?"), F.lit(HINT_EXECUTABLE)),
        )
    )
    return F.when(norm == "", F.array().cast("array<string>")).otherwise(lines)
