"""Queries on retrieval, lookup and chaining."""

from __future__ import annotations

from pyspark.sql import functions as F

from atomloom.operators import chaining as C
from atomloom.operators import lookup as L
from atomloom.operators import retrieval as R
from atomloom.plans import facts as K
from atomloom.session import spread

#: Queries of the similarity searches: ids divisible by 50, against all rows.
EVERY = 50
RULES = [
    "(: in_part (Implication (Premises (AtLocation $a $b) (PartOf $b $c)) (Conclusions (AtLocation $a $c))) (STV 1.0 0.99))",
    "(: in_in (Implication (Premises (AtLocation $a $b) (AtLocation $b $c)) (Conclusions (AtLocation $a $c))) (STV 0.95 0.98))",
]
CONJUNCTIVE = "(: near_brand (Implication (Premises (MadeOf $p $b) (AtLocation $p $s) (AtLocation $s $n)) (Conclusions (BrandIn $b $n))) (STV 0.9 0.97))"
TERMS = [
    "(: mean (Implication (Premises (Part $p) (AverageDist (QuantityDist $p $l) -> $m)) (Conclusions (MeanDist $p))) (STV 1.0 0.95))",
    "(: sum (Implication (Premises (Part $p) (FoldAllValue (QuantityDist $p $l) $v 5 + -> $s)) (Conclusions (SumDist $p))) (STV 1.0 0.9))",
    "(: most (Implication (Premises (Part $p) (FoldAll (Sold $p $q) $q 10 max -> $s)) (Conclusions (MostDist $p))) (STV 1.0 0.9))",
    "(: worth (Implication (Premises (Part $p) (Map2Dist * (MeanDist $p) (PriceDist $p) -> $w)) (Conclusions (WorthDist $p))) (STV 0.9 1.0))",
    "(: half (Implication (Premises (Part $p) (MapDist half (WorthDist $p) -> $w)) (Conclusions (HalfDist $p))) (STV 1.0 1.0))",
    "(: big (Implication (Premises (Part $p) (GreaterThan (MeanDist $p) 25)) (Conclusions (Big $p))) (STV 1.0 1.0))",
    "(: dear (Implication (Premises (Retail $p $r) (Compute * ($r 2) -> $d) (GreaterThan $d 2500)) (Conclusions (Dear $p))) (STV 1.0 0.8))",
]
OR_NOT = [
    "(: rich (Implication (Premises (Or (Balance $c $v high) (Balance $c $v top))) (Conclusions (Rich $c))) (STV 1.0 0.9))",
    "(: lend (Implication (Premises (Rich $c) (Not (Blocked $c))) (Conclusions (Lend $c))) (STV 1.0 0.8))",
]


def _read(spark, folder, name, *columns):
    return spark.read.parquet(f"{folder}/{name}.parquet").select(*columns)


def vector_topk(spark, folder):
    e = _read(spark, folder, "embeddings", "vec_id", "embedding")
    hits = R.top_k(e.where(F.col("vec_id") % EVERY == 0), e, "vec_id", "vec_id", "embedding")
    return hits.select("query_id", "rank", F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


def _hits(spark, folder, k):
    p = _read(spark, folder, "vector_payload", "point_id", "batch_no", "vector")
    asked = p.where((F.col("batch_no") > 1) & (F.col("point_id") % EVERY == 0))
    return R.top_k(asked, p.where("batch_no = 1"), "point_id", "point_id", "vector", k, 96)


def source_lookup(spark, folder):
    """Sentences of the history that are the sources of later points."""
    return R.sources(_hits(spark, folder, 1), _read(spark, folder, "vector_payload", "point_id", "nl"), "point_id", "nl")


def payload_atoms(spark, folder):
    hits = _hits(spark, folder, R.TOP_K)
    return R.payload_atoms(hits, _read(spark, folder, "vector_payload", "point_id", "pln"), "point_id", "pln")


def context_enrich(spark, folder):
    """The last 50 of all stored lines and the atoms of background points."""
    kb = _read(spark, folder, "statement_log", F.col("stmt_no").alias("seq"), F.col("raw").alias("atom"), "deleted_at").where("deleted_at is null")
    got = _read(spark, folder, "vector_payload", "point_id", "background", F.posexplode("pln").alias("pos", "atom")).where("background")
    return R.enriched(kb.drop("deleted_at"), got.select((F.col("point_id") * 1000 + F.col("pos")).alias("seq"), "atom"))


def count_by_source(spark, folder):
    return R.count_by_source(_read(spark, folder, "vector_payload", "source"), "source")


def _asked(spark, folder):
    from atomloom.operators import atoms as A

    pln = spread(_read(spark, folder, "vector_payload", "point_id", "pln")).select("point_id", F.posexplode("pln").alias("pos", "atom"))
    return pln.select((F.col("point_id") * 1000 + F.col("pos")).alias("goal_no"), F.concat(F.lit("(: $prf "), A.statement_body(F.col("atom")), F.lit(" $tv)")).alias("goal"))


def _stored(spark, folder):
    log = _read(spark, folder, "statement_log", "stmt_no", "source", "raw")
    return log.select(F.when(F.col("source").isNull(), 0).otherwise(1).alias("file_rank"), F.col("stmt_no").alias("seq"), "raw")


def exact_lookup(spark, folder):
    return L.looked_up(_asked(spark, folder), _stored(spark, folder)).where("tier = 'exact'").select("goal_no", "raw")


def canonical_lookup(spark, folder):
    return L.looked_up(_asked(spark, folder), _stored(spark, folder)).where("tier = 'canonical'").select("goal_no", "raw")


def _facts(spark, folder, *heads):
    return K.stored_facts(spark, folder, heads).select("head", F.array("subject", "object").alias("args"), "strength", "confidence", F.lit(0).alias("steps"), F.array("stmt_id").alias("trace"))


def _flat(df):
    r = lambda c: F.round(c, 6).alias(c)
    return df.select("head", F.array_join("args", " ").alias("args"), r("strength"), r("confidence"))


def chain_location(spark, folder):
    """Which customers are located in which region, and with what confidence?"""
    return C.location(K.stored_facts(spark, folder, ("AtLocation", "PartOf"), ("head", "subject", "object", "strength", "confidence")))


def chain_conjunctive(spark, folder):
    """One rule with three premises."""
    facts = _facts(spark, folder, "MadeOf", "AtLocation")
    return _flat(C.best(C.fire(C.rules(CONJUNCTIVE)[0], [facts] * 3)))


def chain_transitive(spark, folder):
    """Locations through locations and parts, to the fixpoint."""
    rules = [r for t in RULES for r in C.rules(t)]
    return _flat(C.chain(_facts(spark, folder, "AtLocation", "PartOf"), rules, timeout_s=600, whole=True))


def chain_transitive_cte(spark, folder):
    """The confidence of the best chain of locations and parts: a second way, by widest paths of confidences alone."""
    f = K.stored_facts(spark, folder, ("AtLocation", "PartOf"), ("head", "subject", "object", "confidence"))
    return C.widest(f.where("head = 'AtLocation'"), f)


def chain_open_goal(spark, folder):
    """Every binding of an open goal: what is located in the nations' regions."""
    facts = K.facts(spark, folder, ("AtLocation",)).where("object = 'nation_3'")  # the goal's constant, where it restricts
    facts = facts.select("head", F.array("subject", "object").alias("args"), "strength", "confidence", F.lit(0).alias("steps"), F.array("stmt_id").alias("trace"))
    got = C.answers(facts, "(: $prf (AtLocation $who nation_3) $tv)")
    return got.select("who", F.round("confidence", 6).alias("confidence"))


def _balances(spark, folder):
    c = _read(spark, folder, "customer", "c_custkey", "c_acctbal")
    level = F.when(F.col("c_acctbal") > 9000, "top").when(F.col("c_acctbal") > 7500, "high").otherwise("low")
    name = F.concat(F.lit("c"), "c_custkey")
    value = lambda head, *a: c.select(F.lit(head).alias("head"), F.array(name, *a).alias("args"), F.lit(1.0).alias("strength"), (0.5 + F.col("c_custkey") % 50 / 100).alias("confidence"), F.lit(0).alias("steps"), F.array(name).alias("trace"))
    blocked = value("Not Blocked").where(F.expr("cast(substr(args[0], 2) as bigint) % 3 = 0"))
    return value("Balance", F.col("c_acctbal").cast("string"), level).unionByName(blocked)


def chain_compare(spark, folder):
    """A rule with a comparison of a value."""
    rule = C.rules("(: over (Implication (Premises (Balance $c $v $l) (GreaterThan $v 5000)) (Conclusions (Over $c $l))) (STV 1.0 0.9))")[0]
    return _flat(C.fire(rule, [_balances(spark, folder)] * 2))


def chain_or_not(spark, folder):
    """Rules with alternatives and with explicit negation, one feeding the other."""
    rules = [r for t in OR_NOT for r in C.rules(t)]
    return _flat(C.chain(_balances(spark, folder), rules, timeout_s=600, whole=True).where("head in ('Rich', 'Lend')"))


def _quantities(spark, folder):
    q = _read(spark, folder, "lineitem", "l_partkey", "l_quantity")
    return q.select(F.lit("Quantity").alias("head"), F.array(F.concat(F.lit("p"), "l_partkey"), F.col("l_quantity").cast("string")).alias("args"), F.lit(1.0).alias("strength"), F.lit(1.0).alias("confidence"), F.lit(0).alias("steps"), F.array().cast("array<string>").alias("trace"))


def chain_average(spark, folder):
    return C.average(_quantities(spark, folder), C.Atom("Quantity", ("$part", "$q")), "$q", ["$part"]).select("part", F.round("average", 6).alias("average"))


def chain_fold(spark, folder):
    q, p = _quantities(spark, folder), C.Atom("Quantity", ("$part", "$q"))
    out = None
    for how, initial in (("sum", 10.0), ("min", None), ("max", 3.0), ("count", None)):
        one = C.fold(q, p, "$q", ["$part"], how, initial).select("part", F.lit(how).alias("fold"), F.round(F.col("folded").cast("double"), 6).alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


def chain_compute(spark, folder):
    """A function of two bound values, and distributions under maps."""
    li = _read(spark, folder, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice", "l_discount")
    d = C.compute(li, "*", "l_extendedprice", "l_discount", "off")
    m = C.map_normal(F.col("l_extendedprice"), F.lit(2.0), 0.5, 1.0)
    a = C.add_normals(F.col("l_extendedprice"), F.lit(3.0), F.col("l_discount"), F.lit(4.0))
    return d.select("l_orderkey", "l_linenumber", F.round("off", 4).alias("off"), F.round(m["mu"], 4).alias("mapped"), m["sigma"].alias("mapped_sigma"), F.round(a["mu"], 4).alias("added"), a["sigma"].alias("added_sigma"))


def chain_terms(spark, folder):
    """Rules that average, fold, map and compare distributions and compute values, each reading what others conclude."""
    li = _read(spark, folder, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    part = _read(spark, folder, "part", "p_partkey", "p_retailprice")
    value = lambda m, s: F.struct(F.col(m).cast("double").alias("mu"), s.cast("double").alias("sigma")) if m else F.lit(None).cast(C.VALUE)
    fact = lambda df, head, v, *a: df.select(F.lit(head).alias("head"), F.array(*(x.cast("string") for x in a)).alias("args"), F.lit(1.0).alias("strength"), F.lit(1.0).alias("confidence"), F.lit(0).alias("steps"), F.array().cast("array<string>").alias("trace"), v.alias("value"))
    p, l = F.concat(F.lit("p"), "p_partkey"), F.concat(F.lit("p"), "l_partkey")
    facts = fact(part, "Part", value(None, None), p).unionByName(fact(part, "Retail", value(None, None), p, F.col("p_retailprice"))).unionByName(fact(part, "PriceDist", value("p_retailprice", F.lit(2.0)), p))
    facts = facts.unionByName(fact(li, "QuantityDist", value("l_quantity", F.lit(1.0)), l, F.concat_ws("_", "l_orderkey", "l_linenumber"))).unionByName(fact(li, "Sold", value(None, None), l, F.col("l_quantity")))
    rules = [r for t in TERMS for r in C.rules(t)]
    got = C.chain(facts, rules, timeout_s=600, whole=True).where(F.col("head").isin([r.conclusion.head for r in rules]))
    return got.select("head", F.get("args", F.lit(0)).alias("part"), F.round("strength", 6).alias("strength"), F.round("confidence", 6).alias("confidence"), F.round("value.mu", 4).alias("mu"), F.round("value.sigma", 4).alias("sigma"))


def chain_exists(spark, folder):
    """Unary helper facts: suppliers where something is."""
    return _flat(C.exists(_facts(spark, folder, "AtLocation"), C.Atom("AtLocation", ("$x", "$y")), "$y", "HoldsSomething"))


QUERIES = {f.__name__: f for f in (vector_topk, source_lookup, payload_atoms, context_enrich, count_by_source, exact_lookup, canonical_lookup, chain_location, chain_conjunctive, chain_transitive, chain_transitive_cte, chain_open_goal, chain_compare, chain_or_not, chain_average, chain_fold, chain_compute, chain_terms, chain_exists)}

_F = K.sql()
from atomloom.functions import sql as Q  # noqa: E402
from atomloom.operators import atoms as A  # noqa: E402

_usable = "len(vector) = 96 and list_bool_and(list_transform(vector, lambda x: x is not null and isfinite(x))) and list_bool_or(list_transform(vector, lambda x: x <> 0))"
_hit = lambda k: f"""u as (select point_id, batch_no, vector::double[] v from vector_payload where {_usable}), c as (select q.point_id query_id, p.point_id id, round(list_cosine_similarity(q.v, p.v), 9) score from u q, u p where q.batch_no > 1 and q.point_id % {EVERY} = 0 and p.batch_no = 1),
    h as (select *, row_number() over (partition by query_id order by score desc, id) rank from c qualify rank <= {k})"""  # noqa: E731
_b = lambda x: rf"nullif(trim(regexp_replace(regexp_extract({Q.strip(x)}, '{A.STATEMENT}', 1), '[\s\p{{Z}}]+', ' ', 'g')), '')"
_key = lambda b: rf"case when regexp_matches({b}, '{A.SIMPLE}') then regexp_extract({b}, '{A.SIMPLE}', 1) || ' ' || array_to_string(list_transform(list_filter(regexp_split_to_array(regexp_extract({b}, '{A.SIMPLE}', 2), '\s+'), lambda a: a <> ''), lambda x: {Q.canonical('x')}), ' ') end"
_look = rf"""g as (select point_id * 1000 + i - 1 goal_no, {_b('pln[i]')} b from (select point_id, pln, unnest(range(1, len(pln) + 1)) i from vector_payload)), q as (select * from g where b is not null and not regexp_matches(b, '[$?]')),
    s as (select case when source is null then 0 else 1 end f, stmt_no, raw, {_b('raw')} b from statement_log), e as (select b, arg_min(raw, (f, stmt_no)) raw from s where b is not null group by 1), x as (select goal_no, q.b, raw from q left join e on e.b = q.b),
    k as (select {_key('b')} k, arg_min(raw, (f, stmt_no)) raw from s where b is not null group by 1)"""
_path = """p1 as (select subject s, object o, strength st, confidence c from fact where head = 'AtLocation'), part as (select subject s, object o, confidence c from fact where head = 'PartOf')"""
_bal = "b as (select 'c' || c_custkey c, c_custkey k, c_acctbal v, case when c_acctbal > 9000 then 'top' when c_acctbal > 7500 then 'high' else 'low' end l, 0.5 + c_custkey % 50 / 100.0 f from customer)"
SQL = {
    "vector_topk": f"""with c as (select q.vec_id query_id, p.vec_id, round(list_cosine_similarity(q.embedding::double[], p.embedding::double[]), 9) s from embeddings q, embeddings p where q.vec_id % {EVERY} = 0)
        select query_id, row_number() over (partition by query_id order by s desc, vec_id)::integer rank, vec_id, round(s, 6) score from c qualify rank <= {R.TOP_K}""",
    "source_lookup": f"with {_hit(1)} select distinct nl from h join vector_payload on point_id = id where score > {R.LEAST_SCORE} and nl <> ''",
    "payload_atoms": f"with {_hit(R.TOP_K)} select query_id, rank::integer rank, (i - 1)::integer pos, pln[i] atom from (select query_id, rank, pln, unnest(range(1, len(pln) + 1)) i from h join vector_payload on point_id = id)",
    "context_enrich": rf"""with a as (select 0 t, stmt_no s, {Q.strip('raw')} atom from statement_log where deleted_at is null union all select 1, point_id * 1000 + i - 1, pln[i] from (select point_id, pln, unnest(range(1, len(pln) + 1)) i from vector_payload where background)),
        f as (select atom, min((t, s)) o from a where atom is not null and (t = 1 or atom <> '') group by 1), l as (select atom, o from f order by o desc, atom desc limit {R.CONTEXT_ATOMS}) select (row_number() over (order by o, atom) - 1)::integer place, atom from l""",
    "count_by_source": "select source, count(*) n from vector_payload group by 1",
    "exact_lookup": f"with {_look} select goal_no, raw from x where raw is not null",
    "canonical_lookup": f"with {_look} select goal_no, k.raw from x join k on k.k = {_key('x.b')} where x.raw is null",
    "chain_location": f"with {_F} select a.subject, a.object place, p.object whole, a.strength * p.strength strength, least(a.confidence, p.confidence) confidence from fact a join fact p on a.object = p.subject where a.head = 'AtLocation' and p.head = 'PartOf'",
    "chain_conjunctive": f"with {_F} select 'BrandIn' head, m.object || ' ' || n.object args, 0.9::double strength, round(max(least(0.97, m.confidence, s.confidence, n.confidence)), 6) confidence from fact m join fact s on m.subject = s.subject join fact n on s.object = n.subject where m.head = 'MadeOf' and s.head = 'AtLocation' and n.head = 'AtLocation' group by m.object, n.object",
    "chain_transitive": f"""with recursive {_F}, {_path}, e as (select s, o, 0.95 * st k, least(c, 0.98) c from p1 union all select s, o, 1.0, least(c, 0.99) from part),
        w as (select s, o, st, c from p1 union select w.s, e.o, w.st * e.k, least(w.c, e.c) from w join e on e.s = w.o)
        select 'AtLocation' head, s || ' ' || o args, round(max(st), 6) strength, round(max(c), 6) confidence from w group by s, o union all select 'PartOf', s || ' ' || o, 1.0, round(c, 6) from part""",
    "chain_transitive_cte": f"with recursive {_F}, f as (select * from fact where head in ('AtLocation', 'PartOf')), w as (select subject, object, confidence from f where head = 'AtLocation' union select w.subject, f.object, least(w.confidence, f.confidence) from w join f on f.subject = w.object) select subject, object, max(confidence) confidence from w group by all",
    "chain_open_goal": f"with {_F} select subject who, round(confidence, 6) confidence from fact where head = 'AtLocation' and object = 'nation_3'",
    "chain_compare": f"with {_bal} select 'Over' head, c || ' ' || l args, 1.0::double strength, round(least(0.9, f), 6) confidence from b where v > 5000",
    "chain_or_not": f"with {_bal}, r as (select c, k, least(0.9, f) f from b where l in ('high', 'top')) select 'Rich' head, c args, 1.0::double strength, round(f, 6) confidence from r union all select 'Lend', c, 1.0, round(least(0.8, r.f, b.f), 6) from r join b using (c) where b.k % 3 = 0",
    "chain_average": "select 'p' || l_partkey part, round(avg(l_quantity), 6) average from lineitem group by 1",
    "chain_fold": "with g as (select 'p' || l_partkey part, sum(l_quantity) + 10 a, min(l_quantity) b, greatest(max(l_quantity), 3) c, count(*)::double d from lineitem group by 1) select part, 'sum' as fold, round(a, 6) as value from g union all select part, 'min', round(b, 6) from g union all select part, 'max', round(c, 6) from g union all select part, 'count', d from g",
    "chain_compute": "select l_orderkey, l_linenumber, round(l_extendedprice * l_discount, 4) off, round(l_extendedprice * 0.5 + 1, 4) mapped, 1.0::double mapped_sigma, round(l_extendedprice + l_discount, 4) added, 5.0::double added_sigma from lineitem",
    "chain_terms": """with m as (select 'p' || l_partkey part, avg(l_quantity) mu, sqrt(count(*)) / count(*) sigma, sum(l_quantity) s, max(l_quantity) x from (select l_partkey, l_orderkey, l_linenumber, min(l_quantity) l_quantity from lineitem group by all) group by 1), p as (select 'p' || p_partkey part, p_retailprice r from part),
        j as (select * from m join p using (part)), w as (select part, mu * r mu, sqrt(power(sigma * r, 2) + power(2.0 * mu, 2)) sigma from j),
        u as (select 'MeanDist' head, part, 1.0::double strength, 0.95::double confidence, mu, sigma from j union all select 'SumDist', part, 1.0, 0.9, s + 5, 0.0 from j union all select 'MostDist', part, 1.0, 0.9, greatest(x, 10), 0.0 from j
            union all select 'WorthDist', part, 0.9, 0.95, mu, sigma from w union all select 'HalfDist', part, 0.9, 0.95, mu / 2, sigma / 2 from w union all select 'Big', part, 1.0, 0.95, null, null from j where mu > 25 union all select 'Dear', part, 1.0, 0.8, null, null from p where r * 2 > 2500)
        select head, part, strength, confidence, round(mu, 4) mu, round(sigma, 4) sigma from u""",
    "chain_exists": f"with {_F} select 'HoldsSomething' head, object args, round(max(strength), 6) strength, round(max(confidence), 6) confidence from fact where head = 'AtLocation' group by object",
}
