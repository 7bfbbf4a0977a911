"""Parsers from text to statements and goals, chosen by name; others can be registered.

A parser has parse_batch(df) -> df: from (key, texts array<string>[, context array<string>]) to (key, statements
array<string>, queries array<string>); parse_query(df) does the same for questions, given as one text each. A text that
fits no rule gives nothing. What would be a model is a parser of its own (by default a small grammar of ours) that the
others are put around. A parser may have a size of its own for chunks that keep paragraphs (paragraph_size), take
chunks one at a time (by_chunk) and have a reset().
"""

from __future__ import annotations

import re
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atomloom.functions import arrays as A
from atomloom.functions import symbols as S
from atomloom.operators import atoms as X
from atomloom.operators import planning as P
from atomloom.operators import translate as K
from atomloom.operators.chaining import parse
from atomloom.operators.translate import _singular
from atomloom.session import written

RESULT = "struct<statements:array<string>,queries:array<string>>"
TRUTH = "(STV 1.0 1.0)"


class Parser(Protocol):
    def parse_batch(self, df: DataFrame, key: str, texts: str) -> DataFrame: ...

    def parse_query(self, df: DataFrame, key: str, text: str) -> DataFrame: ...


def symbol(phrase: str) -> str:
    """Words without articles, each made singular, joined by underscores."""
    words = [w for w in re.sub(r"[^a-z0-9_ ]", " ", phrase.lower().replace("-", "_")).split() if w not in ("a", "an", "the")]
    return "_".join(map(_one, words))


def _one(word: str) -> str:
    """Singular of a word: as the translator has it, but -ses loses its s alone (noses, houses, cases) where it is not -sses or a consonant and -uses (buses)."""
    own = len(word) > 4 and word.endswith("ses") and not word.endswith("sses") and not re.search(r"[^aeo]uses$", word)
    return word[:-1] if own else _singular(word)


def head(verb: str) -> str:
    """A verb as a predicate: its third person ending taken off, capitalised."""
    v = verb.lower()
    v = v[:-2] if v.endswith(("shes", "ches", "xes", "sses", "oes")) else v[:-3] + "y" if v.endswith("ies") else v[:-1] if v.endswith("s") and not v.endswith("ss") else v
    return v.capitalize()


#: Sentence forms with two places: the predicate, and the words between.
RELATIONS = {"UsedFor": r"(?:is|are) used for", "CapableOf": r"(?:is|are) capable of", "PartOf": r"(?:is|are) part of", "AtLocation": r"(?:is|are) located (?:at|in|on)", "MadeOf": r"(?:is|are) made of"}
_PLURAL_SUBJECT = r"^(?:all |every )?([a-z][\w-]*s)"


def statement(body: str) -> str:
    name = "_".join(w for w in re.sub(r"[()$]", " ", body).lower().split())[:60]
    return f"(: {name} {body} {TRUTH})"


def rule(premises: list[str], conclusion: str) -> str:
    return statement(f"(Implication (Premises {' '.join(premises)}) (Conclusions {conclusion}))")


def parse_sentence(text: str) -> list[str]:
    """Statements of one sentence."""
    s = text.strip().rstrip(".!").strip()
    low = s.lower()
    for h, words in RELATIONS.items():
        if m := re.match(rf"^(.+?) {words} (.+)$", low):
            return [statement(f"({h} {symbol(m[1])} {symbol(m[2])})")]
    if m := re.match(r"^(?:people|those|anyone|everyone) who (\w+) (.+?) (?:are|is) (.+)$", low):
        return [rule([f"({head(m[1])} $x {symbol(m[2])})"], f"(IsA $x {symbol(m[3])})")]
    if m := re.match(_PLURAL_SUBJECT + r" are (.+)$", low):
        return [rule([f"(IsA $x {symbol(m[1])})"], f"(IsA $x {symbol(m[2])})"), statement(f"(IsA {symbol(m[1])} {symbol(m[2])})")]
    if m := re.match(r"^(.+?) is (?:not) (?:an? )?(.+)$", low):
        return [statement(f"(Not (IsA {symbol(m[1])} {symbol(m[2])}))")]
    if m := re.match(r"^(.+?) is (?:an? )?(.+)$", low):
        return [statement(f"(IsA {symbol(m[1])} {symbol(m[2])})")]
    if m := re.match(_PLURAL_SUBJECT + r" have (.+)$", low):
        return [rule([f"(IsA $x {symbol(m[1])})"], f"(HasA $x {symbol(m[2])})")]
    if m := re.match(r"^(.+?) has (.+)$", low):
        return [statement(f"(HasA {symbol(m[1])} {symbol(m[2])})")]
    if (m := re.match(r"^([a-z][\w-]*s) (\w+) (.+)$", low)) and not m[2].endswith("s"):
        return [rule([f"(IsA $x {symbol(m[1])})"], f"({head(m[2])} $x {symbol(m[3])})")]
    if m := re.match(r"^([\w-]+) (\w+s) (.+)$", low):
        return [statement(f"({head(m[2])} {symbol(m[1])} {symbol(m[3])})")]
    return []


def goal(body: str) -> str:
    return f"(: $prf {body} $tv)"


def parse_question(text: str) -> list[str]:
    """Goals of one question, best first."""
    low = text.strip().rstrip("? ").lower()
    for h, words in RELATIONS.items():
        between = re.sub(r"^\(\?:is\|are\) ", "", words)
        if m := re.match(rf"^(?:is|are) (.+?) {between} (.+)$", low):
            return [goal(f"({h} {symbol(m[1])} {symbol(m[2])})")]
        if m := re.match(rf"^(?:what|who) (?:is|are) {between} (.+)$", low):
            return [goal(f"({h} $what {symbol(m[1])})")]
        if m := re.match(rf"^what (?:is|are) (.+?) {between}$", low):
            return [goal(f"({h} {symbol(m[1])} $what)")]
    if m := re.match(r"^(?:where|what) is (.+?) (?:located|kept)(?: (?:at|in|on))?$", low):
        return [goal(f"(AtLocation {symbol(m[1])} $where)")]
    if m := re.match(r"^(?:who|what) is (?:an? )?(.+)$", low):
        return [goal(f"(IsA $who {symbol(m[1])})")]
    if m := re.match(r"^(?:is|are) ([\w-]+) (?:an? )?(.+)$", low):
        return [goal(f"(IsA {symbol(m[1])} {symbol(m[2])})")]
    if m := re.match(r"^(?:does|do|did) ([\w-]+) have (.+)$", low):
        return [goal(f"(HasA {symbol(m[1])} {symbol(m[2])})")]
    if m := re.match(r"^what (?:does|do) ([\w-]+) (\w+)$", low):
        return [goal(f"({head(m[2])} {symbol(m[1])} $what)")]
    if m := re.match(r"^(?:does|do|did|can) ([\w-]+) (\w+) (.+)$", low):
        return [goal(f"({head(m[2])} {symbol(m[1])} {symbol(m[3])})")]
    if m := re.match(r"^who (\w+) (.+)$", low):
        return [goal(f"({head(m[1])} $who {symbol(m[2])})")]
    return []


NO_TEXTS = "array<string>"


def context_of(df: DataFrame) -> Column:
    """The atoms a parser gets with each row; none if there is no such column."""
    none = F.array().cast(NO_TEXTS)
    return F.coalesce("context", none) if "context" in df.columns else none


class TemplateParser:
    """The grammar by itself: rules for simple sentences and their questions. No session, no context; what stands where a model would."""

    paragraph_size: int | None = None
    by_chunk = False

    def _run(self, df: DataFrame, key: str, value, parse, field: int) -> DataFrame:
        @F.pandas_udf("array<string>")
        def run(lists: pd.Series) -> pd.Series:
            return lists.map(lambda xs: list(dict.fromkeys(out for x in (xs if xs is not None else ()) if x for out in parse(x))))

        empty = F.array().cast("array<string>")
        both = (run(value), empty) if field == 0 else (empty, run(value))
        return df.select(key, both[0].alias("statements"), both[1].alias("queries"))

    def parse_batch(self, df: DataFrame, key: str, texts: str) -> DataFrame:
        split = lambda t: [s for part in re.split(r"(?<=[.!?])\s+", t) for s in parse_sentence(part)]
        return self._run(df, key, F.col(texts), split, 0)

    def parse_query(self, df: DataFrame, key: str, text: str) -> DataFrame:
        return self._run(df, key, F.array(text), parse_question, 1)


class CanonicalParser:
    """The default: what a model makes of texts and hints, brought to canonical form, pruned and filtered, its goals planned against its own statements and the context.

    The model is a parser that gets the texts with white space collapsed and, as its context, atoms and then hints. A
    question for which no goal is left goes to the model once more as it stands.
    """

    paragraph_size: int | None = None
    by_chunk = False
    plans = True

    def __init__(self, model: Parser | None = None):
        self.model = model or TemplateParser()

    def _about(self, df: DataFrame, texts: Column) -> DataFrame:
        """Adds texts, context, concepts, protected and proper names of each row."""
        kept = F.coalesce(F.filter(F.transform(texts, S.stripped), lambda t: t != ""), F.array().cast(NO_TEXTS))
        df = df.withColumn("context", context_of(df)).withColumn("own", kept)
        concepts = F.array_distinct(F.flatten(F.transform("own", lambda t: A.extract_concepts(t))))
        joined = F.array_join("own", " . ")
        return df.withColumn("concepts", concepts).withColumn("protected", A.constants(joined)).withColumn("proper", A.proper_name_map(joined)).withColumn("own", F.transform("own", lambda t: F.trim(F.regexp_replace(t, r"[\s\p{Z}]+", " "))))

    def _made(self, df: DataFrame, made: DataFrame, key: str) -> DataFrame:
        """Statements and goals of the model in canonical form, by key, beside what _about() says."""
        df = df.join(made, key, "left")
        concepts = X.concept_map(F.col("concepts"), X.context_symbols(F.col("context")))
        none = F.array().cast(NO_TEXTS)
        df = df.withColumn("known", concepts)
        args = (F.col("known"), F.col("protected"), F.col("proper"))
        return df.withColumn("statements", X.processed(F.coalesce("statements", none), *args)).withColumn("queries", X.canonical_outputs(A.dedupe(F.coalesce("queries", none)), *args))

    def parse_batch(self, df: DataFrame, key: str, texts: str) -> DataFrame:
        about = written(self._about(df, F.col(texts)), "parser-texts")
        asked = about.select(key, "own", P.prepared(P.batch_hints(F.col("concepts"), F.col("context")), F.col("context")).alias("context"))
        return self._made(about, self.model.parse_batch(asked, key, "own"), key).select(key, "statements", "queries")

    def parse_query(self, df: DataFrame, key: str, text: str) -> DataFrame:
        about = written(self._about(df.withColumn("asked", F.col(text)), F.array(text)), "parser-questions")
        first = written(self._goals(about, F.array_join("own", " "), key), "parser-planned")
        without = first.where(F.size("queries") == 0)
        if without.isEmpty():
            return first
        again = about.join(without.select(key), key)
        second = self._goals(again, S.stripped(F.col("asked")), key).select(key, F.col("statements").alias("more"), F.col("queries").alias("other"))
        df = first.join(second, key, "left")
        return df.select(key, F.when(F.size("more") > 0, F.col("more")).otherwise(F.col("statements")).alias("statements"), F.when(F.size("queries") > 0, F.col("queries")).otherwise(F.coalesce("other", F.col("queries"))).alias("queries"))

    def _goals(self, about: DataFrame, sentence: Column, key: str) -> DataFrame:
        question = F.array_join("own", " ")
        hints = P.batch_hints(F.col("concepts"), F.col("context"), question)
        asked = about.select(key, sentence.alias("sentence"), P.prepared(hints, F.col("context")).alias("context"))
        made = written(self._made(about, self.model.parse_query(asked, key, "sentence"), key), "parser-goals")
        return planned(made, key, question)


def planned(made: DataFrame, key: str, question: Column, plan=P.planned) -> DataFrame:
    """(key, statements, queries): the goals of each row planned against the signatures of its own statements, then its context; plan is P.planned or P.scored_or_first."""
    rows = made.withColumn("question_no", F.col(key))
    both = F.concat("statements", "context")
    one = lambda f, tier: rows.select("question_no", F.posexplode(both).alias("at", "raw")).select("question_no", F.lit(tier).alias("tier"), "at", F.posexplode(f(F.col("raw"))).alias("n", "s")).select("question_no", "tier", (F.col("at").cast("bigint") * 1_000_000 + F.col("n")).alias("seq"), "s.head", "s.args")
    signatures = one(X.fact_signatures, 0).unionByName(one(X.conclusion_signatures, 1))
    candidates = rows.select("question_no", F.posexplode("queries").alias("pos", "goal"))
    goals = plan(candidates, rows.select("question_no", question.alias("question")), signatures)
    goals = goals.groupBy("question_no").agg(F.array_sort(F.collect_list(F.struct("rank", "goal"))).alias("g")).select(F.col("question_no").alias(key), F.transform("g", lambda g: g["goal"]).alias("planned"))
    return made.select(key, "statements").join(goals, key, "left").select(key, "statements", F.coalesce("planned", F.array().cast(NO_TEXTS)).alias("queries"))


EXTRACTION = "struct<extraction_class:string,extraction_text:string,alignment_status:string,attributes:map<string,struct<is_list:boolean,vals:array<string>>>>"


def template_extractions(text: Column, query: bool) -> Column:
    """What the grammar makes of a text as structured extractions, array<EXTRACTION>: stands where a model that extracts would."""

    def one(source: str, cls: str, **attributes):
        return {"extraction_class": cls, "extraction_text": source, "alignment_status": None if cls == "query" else "MATCH_EXACT", "attributes": {k: {"is_list": isinstance(v, list), "vals": v if isinstance(v, list) else [v]} for k, v in attributes.items()}}

    def shown(e) -> str:
        return e if isinstance(e, str) else f"({' '.join(map(shown, e))})"

    def statement_of(source: str, raw: str):
        body = parse(raw)[2]
        if body[0] == "Implication":
            (_, *premises), (_, conclusion) = body[1], body[2]
            return one(source, "rule", head_predicate=conclusion[0], head_args=conclusion[1:], body=shown(premises[0] if len(premises) == 1 else ["and", *premises]))
        if body[0] == "Not":
            return one(source, "negation", predicate=body[1][0], arguments=body[1][1:])
        if body[0] == "IsA":
            return one(source, "type_decl", entity=body[1], type=body[2])
        return one(source, "fact", predicate=body[0], arguments=body[1:])

    @F.pandas_udf(f"array<{EXTRACTION}>")
    def run(texts: pd.Series) -> pd.Series:
        def extract(t):
            if not t:
                return []
            if query:
                return [one(t, "query", predicate=g[0], arguments=g[1:]) for g in (parse(q)[2] for q in parse_question(t))]
            return [statement_of(part, raw) for part in re.split(r"(?<=[.!?])\s+", t) for raw in parse_sentence(part)]

        return texts.map(extract)

    return run(text)


class ExtractionParser:
    """Structured extractions translated to statements and goals and post-processed; chunks keep paragraphs, heads of predicates are remembered.

    extract(text, query) gives the extractions of a text; the hint it may use, of the heads in the context and those
    remembered, is a column. What could not be translated is kept in `rejects`, one table a call.
    """

    paragraph_size = 512
    by_chunk = plans = True

    def __init__(self, extract=template_extractions, skip_fuzzy: bool = True):
        self.extract, self.skip_fuzzy = extract, skip_fuzzy
        self.heads: list[str] = []
        self.rejects: DataFrame | None = None

    def reset(self) -> None:
        self.heads, self.rejects = [], None

    def hint(self, context: Column) -> Column:
        """The line on known heads: those of the context, then those remembered."""
        return A.vocabulary_hint(F.array_distinct(F.concat(A.domain_heads(context), F.array(*map(F.lit, self.heads)).cast(NO_TEXTS))))

    def _extracted(self, df: DataFrame, key: str, text: Column, query: bool) -> DataFrame:
        ext = df.select(F.col(key).alias("doc_id"), F.posexplode(self.extract(text, query)).alias("ext_no", "e")).select("doc_id", "ext_no", "e.*")
        return written(ext, "extractions")

    def _processed(self, df: DataFrame, made: DataFrame, key: str, text: Column, column: str) -> DataFrame:
        listed = made.groupBy(F.col("doc_id").alias(key)).agg(F.array_sort(F.collect_list(F.struct("ext_no", column))).alias("l"))
        df = df.withColumn("context", context_of(df)).withColumn("text_", F.coalesce(text, F.lit(""))).join(listed.select(key, F.transform("l", lambda x: x[column]).alias("made")), key, "left")
        concepts = X.concept_map(A.extract_concepts(F.col("text_")), X.context_symbols(F.col("context")))
        args = (concepts, A.constants(F.col("text_")), A.proper_name_map(F.col("text_")))
        raw = F.coalesce("made", F.array().cast(NO_TEXTS))
        return df.withColumn("made", X.processed(raw, *args) if column == "statement" else X.canonical_outputs(A.dedupe(raw), *args))

    def parse_batch(self, df: DataFrame, key: str, texts: str) -> DataFrame:
        text = F.array_join(texts, " ")
        ext = self._extracted(df, key, text, False)
        self.remember(ext)
        self.rejects = K.rejected(ext, self.skip_fuzzy)
        return self._processed(df, K.translated(ext, self.skip_fuzzy), key, text, "statement").select(key, F.col("made").alias("statements"), F.array().cast(NO_TEXTS).alias("queries"))

    def parse_query(self, df: DataFrame, key: str, text: str) -> DataFrame:
        ext = self._extracted(df, key, F.col(text), True)
        self.rejects = K.query_rejects(ext)
        made = self._processed(df, K.queries(ext), key, F.col(text), "query").withColumn("statements", F.array().cast(NO_TEXTS)).withColumn("queries", F.col("made"))
        return planned(written(made, "extracted-goals"), key, F.col(text), P.scored_or_first)

    def remember(self, ext: DataFrame) -> None:
        """Heads of predicates in the order they came in; those of one call by their first place. Heads are a vocabulary: the driver holds them."""
        new = [r.head for r in K.predicate_heads(ext).groupBy("head").agg(F.min(F.struct("doc_id", "first_ext")).alias("at")).orderBy("at", "head").collect()]
        self.heads = list(dict.fromkeys([*self.heads, *new]))


class MergingParser:
    """A model that gives type definitions, statements, goals and further expressions: definitions are dropped, expressions join the statements, goals of statements are dropped.

    The model has tell(df, key, texts, query) -> (key, types, statements, queries, extras), all array<string>.
    """

    paragraph_size: int | None = None
    by_chunk = True

    def __init__(self, model=None):
        self.model = model or TypedTemplate()

    def _merged(self, made: DataFrame, key: str, query: bool) -> DataFrame:
        none = F.array().cast(NO_TEXTS)
        both = F.array_distinct(F.concat(F.coalesce("statements", none), F.coalesce("extras", none)))
        return made.select(key, both.alias("statements"), F.coalesce("queries", none).alias("queries") if query else none.alias("queries"))

    def parse_batch(self, df: DataFrame, key: str, texts: str) -> DataFrame:
        return self._merged(self.model.tell(df, key, F.col(texts), False), key, False)

    def parse_query(self, df: DataFrame, key: str, text: str) -> DataFrame:
        return self._merged(self.model.tell(df, key, F.array(text), True), key, True)


class TypedTemplate:
    """The grammar as such a model: rules come as further expressions, classes also as type definitions."""

    def tell(self, df: DataFrame, key: str, texts: Column, query: bool) -> DataFrame:
        grammar = TemplateParser()
        asked = df.select(key, F.array_join(texts, " ").alias("t_"), texts.alias("ts_"))
        made = grammar.parse_query(asked, key, "t_") if query else grammar.parse_batch(asked, key, "ts_")
        is_rule = lambda s: F.contains(s, F.lit("(Implication"))
        types = F.array_distinct(F.transform(F.filter("statements", lambda s: s.rlike(X.ISA)), lambda s: F.concat(F.lit("(: "), F.regexp_extract(s, X.ISA, 2), F.lit(" Type)"))))
        return made.select(key, types.alias("types"), F.filter("statements", lambda s: ~is_rule(s)).alias("statements"), "queries", F.filter("statements", is_rule).alias("extras"))


PARSERS: dict[str, type] = {"template": TemplateParser, "canonical": CanonicalParser, "extraction": ExtractionParser, "merging": MergingParser}


def parser(name: str) -> Parser:
    """The parser of that name; unknown names are an error that lists the known ones."""
    if name not in PARSERS:
        raise ValueError(f"unknown parser {name}: {sorted(PARSERS)}")
    return PARSERS[name]()


def register(name: str, cls: type) -> None:
    PARSERS[name] = cls


__all__ = ["Parser", "TemplateParser", "CanonicalParser", "ExtractionParser", "MergingParser", "parser", "register", "parse_sentence", "parse_question"]
