"""The service in one object: ingest texts, answer questions, load background knowledge, reset, report health."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atomloom.operators import atoms, background, chaining, lookup, parsers, planning, retrieval, service
from atomloom.session import laid, temporary, written
from atomloom.settings import Settings
from atomloom.sources import files
from atomloom.sources.points import PointTable

BACKGROUND = "background"
SCOPES = ("all", "atomspace", "vectordb")
#: Rules that can have a part in the proof of one goal and are compiled to joins; more are refused, whatever the whole rule base holds.
MOST_RULES = 1000


class KnowledgeBase:
    """Statements and vector points under one folder, which has to be one that all executors share. One writer at a time."""

    def __init__(self, spark: SparkSession, folder: str, settings: Settings | None = None):
        self.spark, self.folder, self.settings = spark, folder.rstrip("/"), settings or Settings()
        s = self.settings
        self.parser = parsers.parser(s.parser)
        self.statements = files.StatementTable(spark, f"{self.folder}/{s.kb_path}")
        self.points = PointTable(spark, f"{self.folder}/{s.vector_path}")
        self.last_error: str | None = None

    def ingest(self, texts: DataFrame | list[str], key: str = "doc_id", text: str = "text", one_by_one: bool = False, unique: bool = False) -> DataFrame:
        """Parses texts, stores their statements and points, and returns a result for each (see operators.service.ingest).

        All texts of a call see the knowledge base as it stood before it; one_by_one makes each a call of its own.
        """
        if isinstance(texts, list):
            texts = self.spark.createDataFrame(list(enumerate(texts)), f"{key} bigint, {text} string")
        if one_by_one:
            out = None
            for r in texts.select(key, text).collect():  # a conversation's few texts, each a call
                one = self.ingest(self.spark.createDataFrame([(r[0], r[1])], texts.select(key, text).schema), key, text, unique=unique)
                out = one if out is None else out.unionByName(one)
            return out if out is not None else self.ingest(texts.limit(0), key, text)
        s = self.settings
        limits = service.Limits(s.chunk_size, s.chunk_overlap, s.batch_max_sentences, s.batch_max_chars, s.paragraph_chunk_size)
        with temporary(self.spark, ("ingested", "extractions")):  # the latter are what a parser's rejects are read from
            done = written(service.ingest(texts, key, text, self.parser, limits, self.contexts if s.ingest_context else None), "ingested")
            self.statements.append(done.select(F.explode("atoms").alias("raw")), unique=unique)
            self.points.add(done.select(F.explode("units").alias("u")).select("u.nl", "u.pln"))
        return done.drop("units")

    def load_background(self, dump: str, max_rows: int = 0, force: bool = False) -> bool:
        """Makes statements of a dump of assertions and stores them and their points as background knowledge.

        Nothing is done if the stored manifest was made with the same settings and all its records are there. What is
        there of an earlier or broken-off run is replaced. Returns whether it was made anew. A failure is in health(); with
        background_fail_open the service goes on without.
        """
        s = self.settings
        wanted = {"source_file": dump, "normalization_version": background.NORMALIZATION_VERSION, "min_weight": float(s.background_min_weight), "coverage_percent": float(s.background_coverage_percent), "sample_seed": s.background_sample_seed}
        manifest = files.read_manifest(self.spark, f"{self.folder}/{s.manifest_path}")
        whole = self.points.index_state(BACKGROUND, files.expected_count(manifest)) == "complete"
        if not force and whole and (background.is_current(manifest, wanted) or not s.background_auto_rebuild):
            return False
        try:
            rows, _, _ = files.assertions(self.spark, dump, max_rows)
            rows = written(rows, "assertions")
            args = (s.background_min_weight, s.background_coverage_percent, s.background_sample_seed)
            made = written(background.statements(background.sampled(background.first_eligible(rows, args[0]), *args[1:])), "background")
            self.statements.reset(BACKGROUND)
            self.statements.append(made.select(F.col("atom").alias("raw")), source=BACKGROUND)
            self.points.delete(BACKGROUND)
            self.points.add(made.select("nl", F.array("atom").alias("pln"), F.lit(BACKGROUND).alias("source"), F.lit(True).alias("background"), F.col("predicate").alias("relation")))
            files.write_manifest(background.manifest(rows, dump, max_rows, *args), f"{self.folder}/{s.manifest_path}")
            self.last_error = None
        except Exception as e:
            self.last_error = str(e).splitlines()[0][:500]
            if s.background_fail_open:
                return False
            raise
        return True

    def contexts(self, asked: DataFrame) -> DataFrame:
        """(k, context array<string>) of texts (k, text): the last stored lines, then the atoms of the nearest points that are not stored lines, 50 in all.

        The texts are a stated set, searched in blocks; the last lines are the same for all.
        """
        kb = self.statements.read().where("source = 'kb'").select("seq", F.col("raw").alias("atom"))
        lines = retrieval.last_lines(kb)
        asked = written(asked.select("k", F.xxhash64(F.to_json(F.struct("k"))).alias("q"), retrieval.embed(F.col("text"), self.points.dimension).alias("v")), "context-questions")
        hits = self.points.search(asked, "q", "v", self.settings.context_top_k)
        got = retrieval.payload_atoms(hits, self.points.read(), "point_id", "pln").groupBy("query_id", "atom").agg(F.min(F.struct("rank", "pos")).alias("at"))
        got = written(got, "context-atoms")
        stored = kb.select("atom").join(laid(got.select("atom").distinct(), "context-lines"), "atom", "left_semi").distinct()
        extra = got.join(stored, "atom", "left_anti").groupBy(F.col("query_id").alias("q")).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "atom"))), lambda x: x["atom"]).alias("extra"))
        both = F.concat(F.array(*map(F.lit, lines)).cast("array<string>"), F.coalesce("extra", F.array().cast("array<string>")))
        return asked.select("k", "q").join(extra, "q", "left").select("k", F.slice(both, F.greatest(F.lit(1), F.size(both) - retrieval.CONTEXT_ATOMS + 1), retrieval.CONTEXT_ATOMS).alias("context"))

    def context(self, question: str) -> DataFrame:
        """(place, atom): what a parser gets beside a question."""
        asked = self.spark.createDataFrame([(0, question)], "k int, text string")
        return self.contexts(asked).select(F.posexplode("context").alias("place", "atom"))

    def query(self, question: str, store_support: bool = False) -> dict:
        """Answers a question: goals from the parser, which sees the context, proved in their order by lookup, then by chaining.

        Goals of a parser that doesn't plan them are planned against all that is stored. The keys are question,
        original_query, executed_query, fallback_used, query_status, proof, sources, answer, skipped_rules (those that
        could not be compiled, with the reason) and unfinished (why chaining ended early, else null: then no proof
        says nothing). Statements that the parser makes of a question are stored only with store_support.
        """
        with temporary(self.spark, ("extractions",)):
            return self._answered(question, store_support)

    def _answered(self, question: str, store_support: bool) -> dict:
        s = self.settings
        asked = self.spark.createDataFrame([(0, question)], "question_no int, question string")
        seen = self.contexts(asked.select(F.col("question_no").alias("k"), F.col("question").alias("text"))).withColumnRenamed("k", "question_no")
        made = self.parser.parse_query(asked.join(seen, "question_no"), "question_no", "question").first()
        if store_support and made.statements:
            self.statements.append(self.spark.createDataFrame([(x,) for x in made.statements], "raw string"))
        stored = self.statements.read()
        candidates = self.spark.createDataFrame([(0, i, g) for i, g in enumerate(made.queries)], "question_no int, pos int, goal string")
        if getattr(self.parser, "plans", False):
            plan = candidates.select("question_no", (F.col("pos") + 1).alias("rank"), "goal")
        else:
            sig = lambda f, t: stored.select(F.lit(t).alias("tier"), "seq", F.explode(f(F.col("raw"))).alias("s")).select("tier", "seq", "s.head", "s.args")
            plan = planning.planned(candidates, asked, sig(atoms.fact_signatures, 0).unionByName(sig(atoms.conclusion_signatures, 1)))
        plan = written(plan, "plan")
        goals = [r.goal for r in plan.orderBy("rank").collect()]  # goals of one question
        if not s.query_fallback_enabled:
            goals = goals[:1]
        numbered = self.spark.createDataFrame(list(enumerate(goals)), "goal_no int, goal string")
        ranked = stored.select(F.when(F.col("source") == "kb", 0).otherwise(1).alias("file_rank"), "seq", "raw")
        found = {r.goal_no: r.raw for r in lookup.looked_up(numbered, ranked).collect()}
        hit, proof, told = None, None, {"skipped_rules": [], "unfinished": None}
        for i, g in enumerate(goals):  # in their order: one that is looked up does not go before an earlier one that is derived
            hit, proof = (i, found[i]) if i in found else self._chained(stored, i, g, told)
            if hit is not None:
                break
        state = self.spark.createDataFrame([(0, hit + 1, proof)] if hit is not None else [], "question_no int, rank int, proof string")
        row = service.responses(plan, asked, state, s.query_fallback_enabled).first().asDict()
        row.pop("question_no")
        return row | {"sources": self._sources(proof) if proof else []} | told

    def _rules(self, stored: DataFrame, goal: chaining.Atom, told: dict) -> list[chaining.Rule]:
        """The rules that can have a part in a proof of a goal, found by their conclusions from the goal's head on."""
        heads, done, texts = {goal.head}, set(), {}
        rules = stored.where(F.contains("raw", F.lit("(Implication"))).select("raw")
        while heads - done:
            want = [h.removeprefix("Not ") for h in heads - done]
            done |= heads
            named = F.regexp_extract("raw", r"\(Conclusions(.*)$", 1)
            mine = rules.where(F.arrays_overlap(F.regexp_extract_all(named, F.lit(r"\(([^\s()]+)"), F.lit(1)), F.array(*map(F.lit, want))))
            for r in mine.distinct().limit(MOST_RULES + 1).collect():
                texts.setdefault(r.raw, None)
            if len(texts) > MOST_RULES:
                raise ValueError(f"more than {MOST_RULES} rules have a part in one goal")
            made, skipped = chaining.compiled(list(texts))
            heads |= {h for r in made for h in chaining.read_heads(r)}
        if not texts:
            return []
        told["skipped_rules"] = sorted({*told["skipped_rules"], *skipped})
        return made

    def _chained(self, stored: DataFrame, place: int, goal: str, told: dict) -> tuple[int | None, str | None]:
        try:
            atom = chaining.Atom.of(chaining.parse(goal)[2])
        except (ValueError, IndexError):
            return None, None  # a goal that is no flat atom
        rules = self._rules(stored, atom, told)
        m = chaining.prove(chaining.facts_of(stored), rules, goal, self.settings.chaining_max_steps, self.settings.chaining_timeout, unfinished=lambda why: told.update(unfinished=why)).select("trace").first()
        if m is None:
            return None, None
        ids = self.spark.createDataFrame([(x,) for x in m.trace], "id string").distinct()
        used = stored.withColumn("id", atoms.statement_id(F.col("raw"))).join(F.broadcast(ids), "id").groupBy("id").agg(F.min_by("raw", "seq").alias("raw"))
        return place, " ".join(r.raw for r in used.orderBy("id").collect())

    def _sources(self, proof: str) -> list[str]:
        parts = self.spark.createDataFrame([(proof,)], "p string").select(F.posexplode(retrieval.proof_fragments(F.col("p"))).alias("q", "text"))
        hits = self.points.search(parts.select("q", retrieval.embed(F.col("text")).alias("v")), "q", "v", 1)
        return sorted(r.nl for r in retrieval.sources(hits, self.points.read(), "point_id", "nl").collect())

    def reset(self, scope: str = "all", restore: str | None = None) -> None:
        """Deletes statements (atomspace), points (vectordb) or all; restore names a dump that is loaded again afterwards."""
        if scope not in SCOPES:
            raise ValueError(f"unknown scope {scope}: {SCOPES}")
        if scope == "all" and hasattr(self.parser, "reset"):
            self.parser.reset()
        if scope in ("all", "atomspace"):
            self.statements.reset()
        if scope in ("all", "vectordb"):
            self.points.drop()
        if restore:
            self.load_background(restore, force=True)

    def health(self) -> dict:
        expected = files.expected_count(files.read_manifest(self.spark, f"{self.folder}/{self.settings.manifest_path}"))
        st = self.statements.read().select(F.nullif("source", F.lit("kb")).alias("source"))
        return service.health(st, self.points.read(), BACKGROUND, F.lit(expected), self.settings.parser, self.last_error).first().asDict()
