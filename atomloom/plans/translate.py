"""Queries on the translation of extractions, which are projected from the tables of trade."""

from __future__ import annotations

from pyspark.sql import functions as F

from atomloom.functions import sql as Q
from atomloom.operators import translate as T

CUSTOMERS = 1_000_000_000
#: Rules and broken extractions: (class, attributes as scalars), and the statement, goal or reasons they must give.
RULE_ROWS = [
    ("rule", {"head_predicate": "located in", "head_args": "$x, $z", "body": "(and (isa $x Cities) (in $x $z))"}, "(: x_z_located_in_rule (Implication (Premises (IsA $x city) (In $x $z)) (Conclusions (LocatedIn $x $z))) (STV 1.0 1.0))", None, "query cannot target a rule"),
    ("rule", {"head_predicate": "isa", "head_args": "?a Animals", "body": "(match &self (or (dog ?a) (not (plant ?a))) x)"}, "(: a_animal_isa_rule (Implication (Premises (Or (Dog $a) (Not (Plant $a)))) (Conclusions (IsA $a animal))) (STV 1.0 1.0))", None, "query cannot target a rule"),
    ("rule", {"head_predicate": "p", "body": "(a (b"}, None, "rule body unparseable: missing closing parenthesis", "missing closing parenthesis"),
    ("rule", {"body": "(a b)"}, None, "rule has empty head_predicate", "missing required attribute 'head_predicate'"),
    ("rule", {"head_predicate": "p"}, None, "rule has empty body", "missing required attribute 'body'"),
    ("rule", {"head_predicate": "p", "body": "word"}, None, "rule premise must be an expression: 'word'", "rule premise must be an expression: 'word'"),
    ("fact", {"subject": "x"}, None, "missing required attribute 'predicate'", "missing required attribute 'predicate'"),
    ("fact", {"predicate": "runs"}, None, "fact requires at least one argument", "fact requires at least one argument"),
    ("query", {"predicate": "used for", "arguments": "Hammers, $what"}, "(: $prf (UsedFor hammer $what) $tv)", "unsupported statement class 'query'", None),
    ("query", {"predicate": "runs"}, None, "unsupported statement class 'query'", "query requires at least one argument"),
]


def extractions(spark, folder):
    read = lambda n, *c: spark.read.parquet(f"{folder}/{n}.parquet").select(*c)
    s = lambda x: F.struct(F.lit(False).alias("is_list"), F.array(x if not isinstance(x, str) else F.lit(x)).alias("vals"))
    l = lambda *xs: F.struct(F.lit(True).alias("is_list"), F.array(*xs).alias("vals"))
    m = lambda **kw: F.create_map(*(x for k, v in kw.items() for x in (F.lit(k), v)))
    row = lambda df, doc, no, cls, attrs, align=F.lit(None): df.select(doc.alias("doc_id"), F.lit(no).alias("ext_no"), F.lit(cls).alias("extraction_class"), F.concat(F.lit(" "), F.lit(cls)).alias("extraction_text"), align.cast("string").alias("alignment_status"), attrs.alias("attributes"))
    part, cust = read("part", "p_partkey", "p_name", "p_brand", "p_type", "p_size"), read("customer", "c_custkey", "c_name", "c_mktsegment")
    p, c = F.col("p_partkey"), F.col("c_custkey") + CUSTOMERS
    fact = m(predicate=s("made of"), subject=s(F.col("p_name")), object=s(F.col("p_brand")))
    fuzzy = F.when(F.col("p_partkey") % 5 == 0, F.lit("MATCH_FUZZY")).otherwise(F.lit("MATCH_EXACT"))
    child = F.when(F.col("c_custkey") % 4 == 0, F.lit(" $x")).otherwise(F.col("c_mktsegment"))
    out = [
        row(part, p, 1, "fact", fact), row(part, p, 2, "type_decl", m(entity=s(F.col("p_name")), type=s(F.col("p_type")))), row(part, p, 3, "property", m(entity=s(F.col("p_name")), property=s("Sizes"), value=s(F.col("p_size").cast("string"))), fuzzy), row(part, p, 4, "fact", fact),
        row(cust, c, 1, "negation", m(predicate=s("LocatedIn"), arguments=l(F.col("c_name"), F.lit(" "), F.col("c_mktsegment")))), row(cust, c, 2, "inheritance", m(child=s(child), parent=s("Segments"))), row(cust, c, 3, "note", m(predicate=s("x"))),
    ]
    rules = spark.createDataFrame([(-1 - i, 1, c, " " + c, None, {k: (False, [v]) for k, v in a.items()}) for i, (c, a, *_) in enumerate(RULE_ROWS)], "doc_id bigint, ext_no int, extraction_class string, extraction_text string, alignment_status string, attributes map<string, struct<is_list: boolean, vals: array<string>>>")
    for o in out:
        rules = rules.unionByName(o)
    return rules


def extract_translate(spark, folder):
    return T.translated(extractions(spark, folder))


def extract_rejects(spark, folder):
    return T.rejected(extractions(spark, folder))


def extract_queries(spark, folder):
    return T.queries(extractions(spark, folder))


def extract_query_rejects(spark, folder):
    return T.query_rejects(extractions(spark, folder))


def extract_heads(spark, folder):
    return T.predicate_heads(extractions(spark, folder))


QUERIES = {f.__name__: f for f in (extract_translate, extract_rejects, extract_queries, extract_query_rejects, extract_heads)}

_v = lambda x: Q.snake(Q.value(x))
_nm = lambda suffix, *a: "left(" + " || '_' || ".join([*map(_v, a), f"'{suffix}'"]) + f", {T.LONGEST_NAME})"
_ok = f"""ok as (select p_partkey doc_id, 1 ext_no, 'fact' cls, {_nm('made_of_fact', 'p_name', 'p_brand')} nm, '(MadeOf ' || {_v('p_name')} || ' ' || {_v('p_brand')} || ')' payload from part
    union all select p_partkey, 2, 'type_decl', {_nm('isa_type', 'p_name', 'p_type')}, '(IsA ' || {_v('p_name')} || ' ' || {_v('p_type')} || ')' from part
    union all select p_partkey, 3, 'property', left({_v('p_name')} || '_size_has_property', {T.LONGEST_NAME}), '(Has ' || {_v('p_name')} || ' size ' || p_size || ')' from part
    union all select c_custkey + {CUSTOMERS}, 1, 'negation', {_nm('locatedin_neg', 'c_name', 'c_mktsegment')}, '(Not (Locatedin ' || {_v('c_name')} || ' ' || {_v('c_mktsegment')} || '))' from customer
    union all select c_custkey + {CUSTOMERS}, 2, 'inheritance', {_nm('segment_isa_inheritance', 'c_mktsegment')}, '(IsA ' || {_v('c_mktsegment')} || ' segment)' from customer where c_custkey % 4 <> 0)"""
_x = lambda s: "null" if s is None else "'" + s.replace("'", "''") + "'"
_rules = f"rr as (select * from (values {', '.join(f'({-1 - i}, {_x(c)}, {_x(st)}, {_x(why)}, {_x(qwhy)})' for i, (c, _, st, why, qwhy) in enumerate(RULE_ROWS))}) v(doc_id, cls, st, why, qwhy))"
SQL = {
    "extract_translate": f"with {_ok}, {_rules} select doc_id, ext_no, '(: ' || nm || ' ' || payload || ' {T.TRUTH})' as statement from ok where not (cls = 'property' and doc_id % 5 = 0) union all select doc_id, 1, st from rr where why is null",
    "extract_rejects": f"with {_rules} select p_partkey doc_id, 3 ext_no, 'property' extraction_class, 'property' extraction_text, 'fuzzy alignment' reason from part where p_partkey % 5 = 0 union all select c_custkey + {CUSTOMERS}, 2, 'inheritance', 'inheritance', 'free variable in ''child'' for inheritance' from customer where c_custkey % 4 = 0 union all select c_custkey + {CUSTOMERS}, 3, 'note', 'note', 'unsupported statement class ''note''' from customer union all select doc_id, 1, cls, cls, why from rr where why is not null",
    "extract_queries": f"with {_ok}, {_rules} select doc_id, ext_no, '(: $prf ' || payload || ' $tv)' query from ok union all select c_custkey + {CUSTOMERS}, 2, '(: $prf (IsA $x segment) $tv)' from customer where c_custkey % 4 = 0 union all select doc_id, 1, st from rr where qwhy is null",
    "extract_query_rejects": f"with {_rules} select c_custkey + {CUSTOMERS} doc_id, 3 ext_no, 'note' extraction_class, 'note' extraction_text, 'unsupported query class ''note''' reason from customer union all select doc_id, 1, cls, cls, qwhy from rr where qwhy is not null",
    "extract_heads": f"""select p_partkey doc_id, 'made-of' head, 1 first_ext from part union all select c_custkey + {CUSTOMERS}, 'locatedin', 1 from customer union all select c_custkey + {CUSTOMERS}, 'x', 3 from customer
        union all select * from (values {', '.join(f"({-1 - i}, '{h.lower().replace(' ', '-')}', 1)" for i, (_, a, *_) in enumerate(RULE_ROWS) for h in [a.get('predicate') or a.get('head_predicate')] if h)})""",
}
