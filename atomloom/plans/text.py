"""Queries on text: words and symbols, lists, chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atomloom.functions import arrays as A
from atomloom.functions import sql as Q
from atomloom.functions import symbols as S
from atomloom.operators import chunking as C
from atomloom.session import spread


def _read(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet").select(*columns)


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(_read(spark, folder, "documents", "doc_id", "text"))


def _symbols(spark: SparkSession, folder: str) -> DataFrame:
    """Names from the tables of parts and nations and the reference list, with their origin."""
    part = _read(spark, folder, "part", "p_partkey", "p_name", "p_brand", "p_type")
    one = part.select(F.col("p_partkey").alias("id"), F.explode(F.map_from_arrays(F.array(F.lit("name"), F.lit("brand"), F.lit("type")), F.array("p_name", "p_brand", "p_type"))).alias("origin", "token"))
    nation = _read(spark, folder, "nation", "n_nationkey", "n_name").select(F.col("n_nationkey").cast("bigint").alias("id"), F.lit("nation").alias("origin"), F.col("n_name").alias("token"))
    canon = _read(spark, folder, "canon_symbol", "canon_id", "symbol").select(F.col("canon_id").cast("bigint").alias("id"), F.lit("canon").alias("origin"), F.col("symbol").alias("token"))
    return one.unionByName(nation).unionByName(canon)


_SYMBOLS_SQL = """s as (select p_partkey id, 'name' origin, p_name token from part union all select p_partkey, 'brand', p_brand from part union all select p_partkey, 'type', p_type from part
    union all select n_nationkey, 'nation', n_name from nation union all select canon_id, 'canon', symbol from canon_symbol)"""


def normalize_text(spark, folder):
    return _documents(spark, folder).select("doc_id", S.normalize_text(F.col("text")).alias("normalized"))


def canon_symbols(spark, folder):
    t = F.col("token")
    return _symbols(spark, folder).select("id", "origin", S.canonical(t).alias("canonical"), S.canonical(t, False).alias("unlemmatised"), S.clean_concept(F.concat(F.lit("/c/en/"), t, F.lit("/n"))).alias("concept"))


def singular_plural(spark, folder):
    w = F.explode(F.array_distinct(F.filter(F.split(S.normalize_text(F.col("text")), " "), lambda x: x != ""))).alias("w")
    words = _documents(spark, folder).select(w).distinct()
    return words.select("w", S.singular(F.col("w")).alias("singular"), S.singular_guarded(F.col("w")).alias("guarded"), S.plural(F.col("w")).alias("plural"))


def case_symbols(spark, folder):
    t = F.col("token")
    return _symbols(spark, folder).select("id", "origin", S.snake(t).alias("snake"), S.snake(t, True).alias("snake_kept"), S.pascal(S.predicate(t)).alias("pascal"), S.kebab(t).alias("kebab"), S.slug(t).alias("slug"))


def value_symbols(spark, folder):
    """Values and predicates as the translator normalises them, phrases, and the first non-empty of several columns."""
    t = F.col("token")
    cols = S.value(t).alias("value"), S.predicate(t).alias("predicate"), S.canonical_phrase(F.concat(F.lit("The "), t)).alias("phrase")
    return _symbols(spark, folder).select("id", "origin", *cols, S.model_name(F.concat(F.lit("openai/"), t)).alias("model"), S.first_nonempty(F.lit(" "), F.lit(None).cast("string"), t).alias("first"))


def _joined(df: DataFrame, value) -> DataFrame:
    return df.select("doc_id", F.array_join(value, ",").alias("joined")).where("joined <> ''")


def extract_concepts(spark, folder):
    return _joined(_documents(spark, folder), A.extract_concepts(F.col("text")))


def protected_constants(spark, folder):
    return _joined(_documents(spark, folder), A.constants(F.col("text")))


def proper_name_map(spark, folder):
    pairs = F.transform(F.map_entries(A.proper_name_map(F.col("text"))), lambda e: F.concat(e["key"], F.lit(">"), e["value"]))
    return _joined(_documents(spark, folder), F.array_sort(pairs))


def proper_names(spark, folder):
    from atomloom.operators.names import positional

    return positional(_documents(spark, folder), "doc_id", "text")


def dedupe_items(spark, folder):
    lists = _read(spark, folder, "ingest_item_result", "item_id", "atoms")
    return lists.select("item_id", F.array_join(A.dedupe(F.col("atoms")), "|").alias("collapsed"), F.array_join(A.dedupe_trimmed(F.col("atoms")), "|").alias("trimmed")).where("atoms is not null")


def argument_lists(spark, folder):
    """Arguments of scalar and list attributes, split and not."""
    req = _read(spark, folder, "part", "p_partkey", "p_name", "p_type")
    scalar, both = F.array(F.concat_ws(", ", "p_name", "p_type")), F.array("p_name", F.lit(" "), "p_type")
    j = lambda c: F.array_join(c, "|")
    return req.select(
        "p_partkey", j(A.argument_list(F.lit(False), scalar)).alias("whole"), j(A.argument_list(F.lit(False), scalar, True)).alias("at_commas"), j(A.argument_list(F.lit(False), F.array("p_name"), True)).alias("at_spaces"), j(A.argument_list(F.lit(True), both, True)).alias("listed")
    )


def sent_split(spark, folder):
    return _documents(spark, folder).select("doc_id", F.posexplode(C.sentences(F.col("text"))).alias("sent_no", "sentence"))


def chunk_merge(spark, folder):
    return _documents(spark, folder).select("doc_id", F.posexplode(C.merged(C.sentences(F.col("text")))).alias("chunk_no", "chunk"))


def chunk_oversize(spark, folder):
    docs = _documents(spark, folder).where(F.length("text") > C.SIZE)
    return docs.select("doc_id", F.posexplode(C.size_limited(F.array("text"))).alias("piece_no", "piece"))


def text_chunks(spark, folder):
    """The whole chunker: sentences, merged, size-limited."""
    return C.chunks(_documents(spark, folder), "doc_id", "text").select("doc_id", F.posexplode("chunks").alias("chunk_no", "chunk"))


def batch_pack(spark, folder):
    docs = _documents(spark, folder).select("doc_id", C.merged(C.sentences(F.col("text"))).alias("units"))
    return docs.select("doc_id", F.posexplode(C.batch_numbers(F.col("units"))).alias("chunk_no", "batch_no"))


def para_chunks(spark, folder):
    return _documents(spark, folder).select("doc_id", F.posexplode(C.paragraphs_first(F.col("text"))).alias("chunk_no", "chunk"))


QUERIES = {f.__name__: f for f in (normalize_text, canon_symbols, singular_plural, case_symbols, value_symbols, extract_concepts, protected_constants, proper_name_map, proper_names, dedupe_items, argument_lists, sent_split, chunk_merge, chunk_oversize, text_chunks, batch_pack, para_chunks)}

#: Letters beyond ASCII, which RE2 takes for no word characters: a word that touches one is none of ASCII letters.
_WIDE = r"[\x{aa}\x{b5}\x{ba}\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{2ff}\x{370}-\x{1fff}\x{3040}-\x{9fff}\x{ac00}-\x{d7af}\x{fb00}-\x{fb06}]"
_CAPS = rf"list_filter(regexp_extract_all(regexp_replace(text, '{_WIDE}', chr(2), 'g'), '\x02?\b[A-Z][A-Za-z0-9_-]*\x02?'), lambda w: not contains(w, chr(2)))"
_WS = C.WS
_strip = lambda x: f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"
_SENTS = lambda text: rf"list_filter(list_transform(string_split(regexp_replace({text}, '([.!?]){_WS}+', '\1' || chr(1), 'g'), chr(1)), lambda s: {_strip('s')}), lambda s: s <> '')"


def _depends(s: str, cues, prefixes) -> str:
    tokens = f"list_filter(regexp_split_to_array(lower({s}), '{_WS}+'), lambda t: t <> '')"
    first = lambda n: f"array_to_string({tokens}[1:{n}], ' ')"
    return f"({first(1)} in ({Q.quoted(cues)}) or {first(2)} in ({Q.quoted(prefixes)}) or {first(3)} in ({Q.quoted(prefixes)}))"


#: Relation u(doc_id, chunk_no, chunk): merged sentences.
_MERGED = f"""s as (select doc_id, i, p[i] s from (select doc_id, p, unnest(range(1, len(p) + 1)) i from (select doc_id, {_SENTS('text')} p from documents where text is not null))),
    g as (select doc_id, i, s, sum(case when i = 1 or not {_depends('s', C.CUES, C.PREFIXES)} then 1 else 0 end) over (partition by doc_id order by i) k from s),
    u as (select doc_id, cast(k - 1 as integer) chunk_no, string_agg(s, ' ' order by i) chunk from g group by doc_id, k)"""


def _oversize(src: str, key: str) -> str:
    """Recursive relation w over src(key..., chunk): pieces of chunks by windows; piece is the trimmed one."""
    near = f"(start + {C.SIZE})"
    back = int(C.SIZE * C.LOOK_BACK)
    found = rf"length(regexp_extract(substr(chunk, {near} - {back} + 2, {back}), '(?s)^.*[.!?\n]'))"
    cut = f"case when {near} >= length(chunk) then length(chunk) when {found} > 0 then {near} - {back} + 1 + {found} else {near} end"
    again = f"(stop - {C.OVERLAP})"
    return f"""w as (select {key}, chunk, 0 start, {cut.replace('start', '0')} stop, 0 n from {src} union all
        select {key}, chunk, {again}, {cut.replace('start', again)}, n + 1 from w where start + {C.SIZE} < length(chunk))"""


_CHUNKS = f"""with recursive {_MERGED}, t as (select doc_id, {_strip('text')} t from documents),
    k as (select doc_id, count(*) n from s group by 1),
    v as (select u.doc_id, chunk_no, chunk from u join k using (doc_id) where n > 1 union all select t.doc_id, 0, t from t left join k using (doc_id) where coalesce(n, 0) <= 1 and t <> ''),
    o as (select * from v where length(chunk) > {C.SIZE}), {_oversize('o', 'doc_id, chunk_no')},
    e as (select doc_id, chunk_no, 0 n, chunk from v where length(chunk) <= {C.SIZE} union all select doc_id, chunk_no, n, {_strip('substr(chunk, start + 1, stop - start)')} from w)"""

#: Units of a document: its paragraphs, or the merged sentences of oversized ones. Segments g are runs of small paragraphs (odd) and single oversized ones (even).
_PARA = rf"""with recursive t as (select doc_id, {_strip('text')} t from documents where text is not null), p0 as (select doc_id, regexp_split_to_array(t, '\n\s*\n') ps from t where length(t) > {C.SIZE}),
    p1 as (select doc_id, i, {_strip('ps[i]')} p from (select doc_id, ps, unnest(range(1, len(ps) + 1)) i from p0)), p2 as (select doc_id, i, p, length(p) > {C.SIZE} big, coalesce(lag(length(p) > {C.SIZE}) over (partition by doc_id order by i), true) before from p1 where p <> ''),
    p3 as (select *, sum((big or before)::int) over (partition by doc_id order by i) g from p2),
    s0 as (select doc_id, g, i, p[j] s, j from (select doc_id, g, i, p, unnest(range(1, len(p) + 1)) j from (select doc_id, g, i, {_SENTS('p')} p from p3 where big))),
    s1 as (select *, sum(case when j = 1 or not {_depends('s', C.CUES + C.MORE_CUES, C.PREFIXES + C.MORE_PREFIXES)} then 1 else 0 end) over (partition by doc_id, g order by j) k from s0),
    u as (select doc_id, g, row_number() over (partition by doc_id, g order by i) j, p u, false big from p3 where not big union all select doc_id, g, k, string_agg(s, ' ' order by j), true from s1 group by doc_id, g, k),
    r as (select doc_id, g, j, u, big, 1 pack, length(u) + case when big then 1 else 2 end used from u where j = 1 union all
        select u.doc_id, u.g, u.j, u.u, u.big, case when used + length(u.u) > {C.SIZE} then pack + 1 else pack end, case when used + length(u.u) > {C.SIZE} then length(u.u) + case when u.big then 0 else 2 end else used + length(u.u) + case when u.big then 1 else 2 end end
        from r join u on u.doc_id = r.doc_id and u.g = r.g and u.j = r.j + 1),
    c as (select doc_id, g, pack, case when big then string_agg(u, ' ' order by j) else string_agg(u, chr(10) || chr(10) order by j) end chunk from r group by doc_id, g, pack, big)
    select doc_id, cast(row_number() over (partition by doc_id order by g, pack) - 1 as integer) chunk_no, chunk from c union all select doc_id, 0, t from t where length(t) between 1 and {C.SIZE}"""

SQL = {
    "normalize_text": f"select doc_id, {Q.norm('text')} normalized from documents",
    "canon_symbols": f"with {_SYMBOLS_SQL} select id, origin, {Q.canonical('token')} canonical, {Q.snake('token')} unlemmatised, {Q.canonical('token')} concept from s where token not like '%/%'",
    "singular_plural": f"""with w as (select distinct unnest(string_split({Q.norm('text')}, ' ')) w from documents)
        select w, {Q.singular('w')} singular, {Q.singular('w', True)} guarded, {Q.plural('w')} plural from w where w <> ''""",
    "case_symbols": f"with {_SYMBOLS_SQL} select id, origin, {Q.snake('token')} snake, {Q.snake('token', True)} snake_kept, {Q.pascal(Q.predicate('token'))} pascal, replace({Q.snake('token')}, '_', '-') kebab, replace(replace(lower(token), ' ', '_'), '-', '_') slug from s",
    "value_symbols": f"with {_SYMBOLS_SQL} select id, origin, {Q.value('token')} as value, {Q.predicate('token')} predicate, {Q.phrase('token')} phrase, token model, token as first from s",
    "extract_concepts": f"""with t as (select doc_id, string_split({Q.norm('text')}, ' ') ws from documents), w as (select doc_id, i, ws[i] w from (select doc_id, ws, unnest(range(1, len(ws) + 1)) i from t)),
        c as (select doc_id, {Q.singular('w')} c, min(i) p from w where length(w) >= 3 and w not in ({Q.quoted(A.STOP_WORDS)}) group by all),
        r as (select *, row_number() over (partition by doc_id order by p) n from c) select doc_id, string_agg(c, ',' order by p) joined from r where n <= {A.MOST_CONCEPTS} group by all""",
    "protected_constants": rf"""with t as (select doc_id, {_CAPS} ws from documents), w as (select doc_id, i p, {Q.snake('ws[i]')} c from (select doc_id, ws, unnest(range(1, len(ws) + 1)) i from t))
        select doc_id, string_agg(c, ',' order by p) joined from (select doc_id, c, min(p) p from w where c <> '' group by all) group by all""",
    "proper_name_map": rf"""with t as (select doc_id, {_CAPS} ws from documents), w as (select doc_id, i p, {Q.snake('ws[i]')} c, {Q.canonical('ws[i]')} s from (select doc_id, ws, unnest(range(1, len(ws) + 1)) i from t)),
        e as (select doc_id, c k, c v, 2 * p p from w where c <> '' union all select doc_id, s, c, 2 * p + 1 from w where s <> '' and s <> c),
        l as (select doc_id, k || '>' || arg_max(v, p) x from e group by doc_id, k) select doc_id, string_agg(x, ',' order by x) joined from l group by all""",
    "proper_names": rf"""with t as (select doc_id, regexp_extract_all(regexp_replace(regexp_replace(text, '{_WIDE}', chr(2), 'g'), '(^|[.!?]\s+)([A-Z])', '\1' || chr(1) || '\2', 'g'), '[\x01\x02]?\b[A-Za-z][A-Za-z0-9_''-]*\b\x02?') ws from documents),
        w as (select doc_id, i, ws[i] w from (select doc_id, ws, unnest(range(1, len(ws) + 1)) i from t)) select doc_id, lower(w) word, arg_min(w, i) as name from w where not starts_with(w, chr(1)) and not contains(w, chr(2)) group by all having bool_and(regexp_matches(w, '^[A-Z]'))""",
    "dedupe_items": rf"""with t as (select item_id, i, atoms[i] a from (select item_id, atoms, unnest(range(1, len(atoms) + 1)) i from ingest_item_result)),
        b as (select item_id, i, trim(regexp_replace(a, '[\s\x0b\p{{Z}}]+', ' ', 'g')) c, {Q.strip('a')} d from t where a is not null),
        c as (select item_id, string_agg(c, '|' order by p) collapsed from (select item_id, c, min(i) p from b where c <> '' group by all) group by all), d as (select item_id, string_agg(d, '|' order by p) trimmed from (select item_id, d, min(i) p from b where d <> '' group by all) group by all)
        select item_id, coalesce(collapsed, '') collapsed, coalesce(trimmed, '') trimmed from ingest_item_result left join c using (item_id) left join d using (item_id) where atoms is not null""",
    "argument_lists": """select p_partkey, p_name || ', ' || p_type as whole, array_to_string(list_filter(list_transform(string_split(p_name || ', ' || p_type, ','), lambda x: trim(x)), lambda x: x <> ''), '|') at_commas,
        array_to_string(list_filter(string_split(p_name, ' '), lambda x: x <> ''), '|') at_spaces, p_name || '|' || p_type listed from part""",
    "sent_split": f"select doc_id, cast(i - 1 as integer) sent_no, p[i] sentence from (select doc_id, p, unnest(range(1, len(p) + 1)) i from (select doc_id, {_SENTS('text')} p from documents where text is not null))",
    "chunk_merge": f"with {_MERGED} select doc_id, chunk_no, chunk from u",
    "chunk_oversize": f"""with recursive o as (select doc_id, text chunk from documents where length(text) > {C.SIZE}), {_oversize('o', 'doc_id')},
        e as (select doc_id, n, {_strip('substr(chunk, start + 1, stop - start)')} piece from w) select doc_id, cast(row_number() over (partition by doc_id order by n) - 1 as integer) piece_no, piece from e where piece <> ''""",
    "text_chunks": f"{_CHUNKS} select doc_id, cast(row_number() over (partition by doc_id order by chunk_no, n) - 1 as integer) chunk_no, chunk from e where chunk <> ''",
    "batch_pack": f"""with recursive {_MERGED}, n as (select doc_id, chunk_no, length(chunk) c from u),
        r as (select doc_id, chunk_no, 0 batch_no, 1 k, c from n where chunk_no = 0 union all
            select n.doc_id, n.chunk_no, case when r.k >= {C.MOST_SENTENCES} or r.c + 1 + n.c > {C.MOST_CHARS} then batch_no + 1 else batch_no end, case when r.k >= {C.MOST_SENTENCES} or r.c + 1 + n.c > {C.MOST_CHARS} then 1 else r.k + 1 end,
                case when r.k >= {C.MOST_SENTENCES} or r.c + 1 + n.c > {C.MOST_CHARS} then n.c else r.c + 1 + n.c end from r join n on n.doc_id = r.doc_id and n.chunk_no = r.chunk_no + 1)
        select doc_id, chunk_no, batch_no from r""",
    "para_chunks": _PARA,
}
