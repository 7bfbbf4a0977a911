"""Problem 9: the reading level of texts, by label propagation on a graph of documents and words.

Documents are joined to the words they contain, by as many edges as there are, without any table of fixed size. Graded
documents are clamped to their grade. A harmonic step gives every word the weighted mean of the scores of its
documents, then every document the weighted mean of the scores of its words, where words whose documents agree weigh
more; the means shrink towards the middle, so after each step the scores are stretched back by a curve fitted on the
clamped documents, each scored without its own grade. Steps are made until the scores of the words stand still.

Sums of words are made in the tasks, then by a shuffle by word. As long as the words are few enough they are sent to
all executors, and documents are passed over once a step, in place; beyond that edges are joined with them.
"""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atomloom.session import laid, written

#: Words sent to all executors, of 32 bytes each; more are joined with the edges by shuffle.
BROADCAST_NODES = 1_000_000
#: A word of fewer documents leads nowhere.
LEAST_DOCUMENTS = 2
#: Steps end when the scores of words, weighted by what they bear, have moved by less than this, or after so many.
RESIDUAL, MOST_STEPS = 0.001, 20
LEAST_WORDS = 50
LOWEST, HIGHEST = 1, 5
#: Pull of a document without grade on its words, against 1 of a graded one.
UNGRADED = 0.1
#: A word counts as having so many occurrences with the mean grade beside its own, of this variance.
PRIOR, PRIOR_VARIANCE = 1.0, 1.4
LEAST_VARIANCE = 0.05
#: In the final level of a graded document its score weighs as much as so many grades.
TRUST = 4.0
#: Documents for which a curve of the third degree is fitted; with fewer a line, with fewer than 10 the mean.
CURVE_FROM = 60
CACHE_WORDS = 500_000
_WORD = re.compile(r"[^\W\d_]+")


class _Nodes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        code = self[word] = xxhash.xxh3_64_intdigest(word)
        return code


_nodes = _Nodes()


def edges(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(id, nodes array<bigint>, times array<int>) of the English texts with at least LEAST_WORDS words between white space: hashes of their words, 64 bits each."""

    def run(batches):
        for batch in batches:
            ids, codes, sizes = [], [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if t is not None and len(t.split()) >= LEAST_WORDS:
                    words = _WORD.findall(t.lower())
                    ids.append(i)
                    sizes.append(len(words))
                    codes.extend(map(_nodes.__getitem__, words))
            word, of = np.array(codes, np.uint64).view(np.int64), np.repeat(np.arange(len(ids)), sizes)
            order = np.lexsort((word, of))
            word, of = word[order], of[order]
            first = np.flatnonzero(np.r_[True, (word[1:] != word[:-1]) | (of[1:] != of[:-1])]) if len(word) else np.zeros(0, np.int64)
            times = np.diff(np.r_[first, len(word)]).astype(np.int32)
            offsets = pa.array(np.searchsorted(of[first], np.arange(len(ids) + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(word[first])), pa.ListArray.from_arrays(offsets, pa.array(times))], names=["id", "nodes", "times"])

    return docs.where(F.lower(lang) == "en").select(F.col(key).cast("bigint"), text).mapInArrow(run, "id bigint, nodes array<bigint>, times array<int>")


@dataclass
class Curve:
    """Stretches mean word scores to the scale of the grades."""

    coefficients: np.ndarray
    low: float
    high: float

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.polynomial.polynomial.polyval(np.clip(x, self.low, self.high), self.coefficients), LOWEST, HIGHEST)

    def column(self, x: Column) -> Column:
        """The same for a column."""
        x = F.least(F.greatest(x, F.lit(self.low)), F.lit(self.high))
        y = F.lit(0.0)
        for c in self.coefficients[::-1]:
            y = y * x + F.lit(float(c))
        return F.least(F.greatest(y, F.lit(float(LOWEST))), F.lit(float(HIGHEST)))


def weight_of(times: np.ndarray) -> np.ndarray:
    return 1 + np.log(times.astype(float))


@dataclass
class Words:
    """Sums over the documents of each word: weight, weight x score, weight x score squared; and the mean grade. nodes is sorted."""

    nodes: np.ndarray
    sums: np.ndarray
    mean: float

    def score(self, g: "Batch", own: np.ndarray | None = None, known: np.ndarray | None = None) -> np.ndarray:
        """Mean score of each document's words, those whose documents agree weighing more; without the document's own share if it is given."""
        total, first, second = (s[g.at] for s in self.sums)
        if own is not None:
            w, s = g.weight * known[g.row], own[g.row]
            total, first, second = total - w, first - w * s, second - w * s * s
        total = np.maximum(total, 0) + PRIOR
        m = (first + PRIOR * self.mean) / total
        spread = (second + PRIOR * (self.mean**2 + PRIOR_VARIANCE)) / total - m * m
        a = g.weight / np.maximum(spread, LEAST_VARIANCE)
        sums = np.bincount(g.row, a, g.n)
        return np.where(sums > 0, np.bincount(g.row, a * m, g.n) / np.maximum(sums, 1e-12), self.mean)

    def moved(self, before: "Words") -> float:
        """How far the scores of the words are from those before, weighted by what they bear now."""
        a, b = ((w.sums[1] + PRIOR * w.mean) / (w.sums[0] + PRIOR) for w in (self, before))
        return float((self.sums[0] * np.abs(a - b)).sum() / max(self.sums[0].sum(), 1e-12))


@dataclass
class Batch:
    """The edges of an Arrow batch to words of the graph: row of the document, place of the word, weight."""

    row: np.ndarray
    at: np.ndarray
    weight: np.ndarray
    n: int

    @staticmethod
    def of(batch: pa.RecordBatch, nodes: np.ndarray) -> "Batch":
        lists = batch.column(batch.schema.get_field_index("nodes"))
        row, node = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()
        at = np.minimum(np.searchsorted(nodes, node), max(0, len(nodes) - 1))
        there = nodes[at] == node if len(nodes) else np.zeros(len(node), bool)
        weight = weight_of(batch.column(batch.schema.get_field_index("times")).flatten().to_numpy())
        return Batch(row[there], at[there], weight[there], batch.num_rows)


def _numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False).astype(float)


class InPlace:
    """Steps that pass over the documents, with all words at hand."""

    columns = ("nodes", "times", "grade", "grades")

    def __init__(self, graph: DataFrame, clamped: DataFrame, vocabulary: DataFrame, mean: float):
        self.graph, self.clamped, self.mean = graph, clamped, mean
        self.nodes = np.sort(vocabulary.toArrow()["node"].to_numpy())

    def _sent(self, *values):
        return self.graph.sparkSession.sparkContext.broadcast((self.nodes, *values))

    def step(self, words: Words | None, curve: Curve | None) -> Words:
        """The words by the scores the documents have from words and curve; without these by the grades alone."""
        shared = self._sent(words, curve)

        def run(batches):
            nodes, words, curve = shared.value
            total = np.zeros((3, len(nodes)))
            for batch in batches:
                g, grade = Batch.of(batch, nodes), _numbers(batch, "grade")
                s, pull = grade, np.ones(len(grade))
                if words is not None:
                    is_graded = ~np.isnan(grade)
                    s, pull = np.where(is_graded, grade, curve(words.score(g))), np.where(is_graded, 1.0, UNGRADED)
                w = g.weight * pull[g.row]
                ws = w * s[g.row]
                total += [np.bincount(g.at, x, len(nodes)) for x in (w, ws, ws * s[g.row])]
            some = np.flatnonzero(total[0])
            yield pa.RecordBatch.from_arrays([pa.array(nodes[some]), *(pa.array(t[some]) for t in total)], names=["node", "w", "ws", "wss"])

        rows = (self.clamped if words is None else self.graph).select(*self.columns).mapInArrow(run, "node bigint, w double, ws double, wss double")
        got = rows.groupBy("node").agg(*(F.sum(c).alias(c) for c in ("w", "ws", "wss"))).toArrow()
        sums = np.zeros((3, len(self.nodes)))
        sums[:, np.searchsorted(self.nodes, got["node"].to_numpy())] = [got[c].to_numpy() for c in ("w", "ws", "wss")]
        return Words(self.nodes, sums, self.mean)

    def without_own(self, words: Words) -> DataFrame:
        """(grade, x): what the words of each graded document say without it."""
        shared = self._sent(words)

        def run(batches):
            nodes, words = shared.value
            for batch in batches:
                grade = _numbers(batch, "grade")
                yield pa.RecordBatch.from_arrays([pa.array(grade), pa.array(words.score(Batch.of(batch, nodes), grade, np.ones(len(grade))))], names=["grade", "x"])

        return self.clamped.select(*self.columns).mapInArrow(run, "grade double, x double")

    def scores(self, words: Words, curve: Curve) -> DataFrame:
        """(id, grade, grades, score) of each document."""
        shared = self._sent(words, curve)

        def run(batches):
            nodes, words, curve = shared.value
            for batch in batches:
                grade = _numbers(batch, "grade")
                known = (~np.isnan(grade)).astype(float)
                score = curve(words.score(Batch.of(batch, nodes), np.nan_to_num(grade), known))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), batch.column(4), pa.array(score)], names=["id", "grade", "grades", "score"])

        return self.graph.select("id", *self.columns).mapInArrow(run, "id bigint, grade double, grades double, score double")

    @staticmethod
    def moved(words: Words, before: Words) -> float:
        return words.moved(before)


class ByShuffle:
    """The same steps as joins of edges with words, for any number of words."""

    def __init__(self, graph: DataFrame, clamped: DataFrame, vocabulary: DataFrame, mean: float):
        self.mean = mean
        self.docs = graph.select("row", "id", "grade", "grades")
        pairs = graph.select("row", "grade", F.explode(F.arrays_zip("nodes", "times")).alias("e")).select("row", "grade", F.col("e.nodes").alias("node"), (1 + F.log(F.col("e.times").cast("double"))).alias("weight"))
        self.edges = written(pairs.join(vocabulary.select("node"), "node"), "word-edges")

    def _said(self, words: DataFrame, own: Column) -> DataFrame:
        """(row, x): what the words say of each document; own is the share of its grade that is taken out."""
        e = self.edges.join(words, "node")
        w, g = F.when(F.col("grade").isNotNull() & own, F.col("weight")).otherwise(F.lit(0.0)), F.coalesce("grade", F.lit(0.0))
        total = F.greatest(F.lit(0.0), F.col("w") - w) + PRIOR
        m = (F.col("ws") - w * g + PRIOR * self.mean) / total
        e = e.select("row", "weight", m.alias("m"), ((F.col("wss") - w * g * g + PRIOR * (self.mean**2 + PRIOR_VARIANCE)) / total).alias("square"))
        a = F.col("weight") / F.greatest(F.col("square") - F.col("m") * F.col("m"), F.lit(LEAST_VARIANCE))
        x = e.groupBy("row").agg((F.sum(a * F.col("m")) / F.sum(a)).alias("x"))
        return self.docs.join(x, "row", "left").withColumn("x", F.coalesce("x", F.lit(self.mean)))

    def step(self, words: DataFrame | None, curve: Curve | None) -> DataFrame:
        if words is None:
            e = self.edges.where("grade is not null").withColumns({"s": F.col("grade"), "pull": F.lit(1.0)})
        else:
            said = self._said(words, F.lit(False)).select("row", F.coalesce("grade", curve.column(F.col("x"))).alias("s"), F.when(F.col("grade").isNotNull(), 1.0).otherwise(UNGRADED).alias("pull"))
            e = self.edges.join(said, "row")
        w = F.col("weight") * F.col("pull")
        sums = e.groupBy("node").agg(F.sum(w).alias("w"), F.sum(w * F.col("s")).alias("ws"), F.sum(w * F.col("s") * F.col("s")).alias("wss"))
        all_ = self.edges.select("node").distinct().join(sums, "node", "left")
        return written(all_.select("node", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("w", "ws", "wss"))), "words")

    def without_own(self, words: DataFrame) -> DataFrame:
        return self._said(words, F.lit(True)).where("grade is not null").select("grade", "x")

    def scores(self, words: DataFrame, curve: Curve) -> DataFrame:
        return self._said(words, F.lit(True)).select("id", "grade", "grades", curve.column(F.col("x")).alias("score"))

    def moved(self, words: DataFrame, before: DataFrame) -> float:
        m = (F.col("ws") + PRIOR * self.mean) / (F.col("w") + PRIOR)
        both = words.select("node", "w", m.alias("m")).join(before.select("node", m.alias("b")), "node")
        return both.agg(F.sum(F.col("w") * F.abs(F.col("m") - F.col("b"))) / F.sum("w")).first()[0] or 0.0


def curve_of(said: DataFrame, n: int, mean: float) -> Curve:
    """Fitted on (grade, x) by their moments, which are summed up where they are."""
    x = F.col("x") - mean
    sums = [F.sum(F.pow(x, F.lit(k))) for k in range(7)] + [F.sum(F.pow(x, F.lit(k)) * F.col("grade")) for k in range(4)]
    m = said.agg(*(c.alias(f"m{i}") for i, c in enumerate(sums)), F.min("x"), F.max("x")).first()
    degree = 3 if n >= CURVE_FROM else 1 if n >= 10 else 0
    normal = np.array([[m[i + j] for j in range(degree + 1)] for i in range(degree + 1)])
    c = np.linalg.lstsq(normal, np.array(m[7 : 8 + degree]), rcond=None)[0]
    shifted = np.polynomial.Polynomial(c)(np.polynomial.Polynomial([-mean, 1.0]))  # from x - mean to x
    return Curve(np.atleast_1d(shifted.coef), m[11], m[12])


def levels(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", level: str = "level", residual: float = RESIDUAL, most_steps: int = MOST_STEPS) -> DataFrame:
    """(doc_id, level int, score double) of the English texts with at least LEAST_WORDS words.

    lang is compared without regard to letter case; null texts and languages are left out. Of the grades of a document
    the mean counts; null grades and those outside 1 to 5 don't, grades of other documents neither. The score lies
    between 1 and 5, the level is its nearest whole number; for a graded document its grades count into the level
    too. Without any grade every level is 3. Rows with a repeated key are scored each. Steps that end by their number
    before the scores stand still give a warning.
    """
    graded = labels.where(F.col(level).between(LOWEST, HIGHEST)).groupBy(F.col(key).cast("bigint").alias("id")).agg(F.avg(level).alias("grade"), F.count("*").cast("double").alias("grades"))
    graph = written(edges(docs, key, text, lang).join(laid(graded, "grades"), "id", "left").withColumn("row", F.monotonically_increasing_id()), "word-graph")
    clamped = written(graph.where("grade is not null"), "clamped")
    n, mean = clamped.agg(F.count("*"), F.avg("grade")).first()
    if not n:
        return graph.select(F.col("id").alias("doc_id"), F.lit((LOWEST + HIGHEST) // 2).alias("level"), F.lit((LOWEST + HIGHEST) / 2).alias("score"))
    vocabulary = written(graph.select(F.explode("nodes").alias("node")).groupBy("node").agg(F.count("*").alias("documents")).where(F.col("documents") >= LEAST_DOCUMENTS).select("node"), "vocabulary")
    make = InPlace if vocabulary.count() <= BROADCAST_NODES else ByShuffle
    steps = make(graph, clamped, vocabulary, float(mean))
    words = steps.step(None, None)
    curve = curve_of(steps.without_own(words), n, float(mean))
    for _ in range(most_steps):
        before, words = words, steps.step(words, curve)
        curve = curve_of(steps.without_own(words), n, float(mean))
        if steps.moved(words, before) < residual:
            break
    else:
        warnings.warn(f"scores still moved after {most_steps} steps", RuntimeWarning, stacklevel=2)
    score = F.col("score")
    both = F.when(F.col("grade").isNotNull(), (TRUST * score + F.col("grades") * F.col("grade")) / (TRUST + F.col("grades"))).otherwise(score)
    return steps.scores(words, curve).select(F.col("id").alias("doc_id"), F.least(F.greatest(F.floor(both + 0.5), F.lit(LOWEST)), F.lit(HIGHEST)).cast("int").alias("level"), "score")
