"""Registered queries of the retrieval and conversation operators, with DuckDB SQL.

The chunk store is ``documents`` joined to ``embeddings`` by id, ``benchmark`` texts are the queries,
and a benchmark item's query vector is the embedding whose id is the item's.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from quern.functions import lexicons as lex, routing, text as T
from quern.operators import answers as A, block_index as K, chunking as C, conversation as G, corpus, lsa, positions, replies, retrieval as R, rules, scans, vector_index as V
from quern.sources import folder
from quern.sources.buckets import BucketedTable
from quern.sources.segments import SegmentedIndex
from quern.sources.shared import new_path
from quern.sources.store import Store
from quern.streaming import loop

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table over all cores, if its rows lie in few of its parts: a file is split by bytes, but one task reads a whole row group."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    largest, rows = df.groupBy(F.spark_partition_id()).count().agg(F.max("count"), F.sum("count")).first()  # of the files' footers
    return df.repartition(max(cores, df.rdd.getNumPartitions())) if rows and largest * cores > 2 * rows else df


def docs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("id"), "text", "source", "lang")


#: Texts beside those of the tables, which hold no Arabic, questions, addresses, headings or table rows.
INLINE = (
    "1. التسجيل مفتوح الآن في كلية الهندسة\n2) الرسوم 50 ألف جنيه\n3. Register now\n---\n(-) ،؛\n***\n  كِتابٌ جَديد  ",
    "ما هي رسوم كلية الهندسة؟ 97.80% والقبول إلى أن الكلية. نعم!\nالتقديم الآن\nسطر آخر",
    "س: كيف أسجل في الجامعة؟\nج: من الموقع https://example.org/a?b=1) ثم الدفع\nQ: How do I apply?\nA: See www.example.org/b» and pay the fees",
    "Mixed نص قليل with mostly latin letters, tuition and 12.5% discount\n\n\nA second paragraph . Short. End",
    "ـكـتـاب\uf0b7 \u200bزمن\u200d ٱلآن إن أَو آخر\u00a0هنا  \t 4.\n\n5. منحة تفوق",
    "[H1] الرسوم والمصاريف\n[TABLE] كلية الطب — المصاريف: 75 ألف جنيه\n[TABLE] كلية الطب — السنوات: 5 سنوات وسنة امتياز\n[TABLE] Art — Fee: 5 for each of the years of study\nشروط القبول تحددها الجامعة كل عام. يعلن عنها في الموقع\n[H2] Contact\nWrite to the office of admission. Call it as well. Come and see it in the city of Alexandria",
    "[H1] Questions\nQ: What is the tuition?\nA: It depends on the faculty and on the year\nq: And when can one apply?\nA: From June on, every day of the week\nس: متى؟\nج: في شهر يونيو من كل عام",
    "",
)
#: Questions in dialect beside those of ``benchmark``.
INLINE_QUERIES = ("عايز اعرف مصاريف كلية الهندسة بكام", "ازاي اسجل في الجامعة", "فين الموقع ؟", "مش فاهم زي ايه", "امتى التقديم")


def inline_docs(spark: SparkSession) -> DataFrame:
    """INLINE with the ids -1, -2 and so on."""
    return spark.createDataFrame([(-i, x, "inline", "ar") for i, x in enumerate(INLINE, 1)], "id long, text string, source string, lang string")


def all_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs_of(spark, sf_dir).unionByName(inline_docs(spark))


def all_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([(-i, x) for i, x in enumerate(INLINE_QUERIES, 1)], "query_id long, text string")
    return queries_of(spark, sf_dir).unionByName(own)


def queries_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def vectors_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def vector_queries_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = vectors_of(spark, sf_dir).select(F.col("id").alias("query_id"), "embedding")
    return queries_of(spark, sf_dir).join(vectors, "query_id")


def quoted(x: str) -> str:
    """A text as an SQL literal."""
    return "E'" + x.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\t", "\\t") + "'"


def rows_sql(texts: tuple[str, ...]) -> str:
    return ", ".join(f"({-i}, {quoted(x)})" for i, x in enumerate(texts, 1))


_DOCS = f"(SELECT doc_id AS id, text, source, lang FROM documents UNION ALL SELECT id, text, 'inline', 'ar' FROM (VALUES {rows_sql(INLINE)}) AS v(id, text))"
_QUERIES = f"(SELECT item_id AS query_id, text FROM benchmark UNION ALL SELECT * FROM (VALUES {rows_sql(INLINE_QUERIES)}) AS v(id, text))"

# The SQL's engine has ASCII classes and no look-around, so classes are spelled out and word edges consume a character.
_SP = r"\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_AR = r"\x{0600}-\x{06FF}"
_W = r"\p{L}\p{N}_"
_STOP = ", ".join(f"'{x}'" for x in T.stop_words())


def tokens_sql(c: str) -> str:
    return rf"list_filter(list_transform(string_split_regex(lower(regexp_replace(translate({c}, 'أإآٱ', 'اااا'), '[^{_W}{_SP}%]', ' ', 'g')), '[{_SP}]+'), lambda t: CASE WHEN starts_with(t, 'ال') AND length(t) > 3 THEN substr(t, 3) ELSE t END), lambda t: length(t) >= 2 AND t NOT IN ({_STOP}))"


def words_sql(c: str) -> str:
    return f"list_filter(string_split_regex({c}, '[{_SP}]+'), lambda w: w <> '')"


def strip_sql(c: str) -> str:
    return f"regexp_replace({c}, '^[{_SP}]+|[{_SP}]+$', '', 'g')"


def count_sql(c: str, chars: str) -> str:
    return f"length(regexp_replace({c}, '[^{chars}]', '', 'g'))"


def clean_sql(c: str) -> str:
    folded = rf"regexp_replace(translate({c}, 'أإآٱ', 'اااا'), '[\x{{0640}}\x{{F000}}-\x{{F0FF}}]', '', 'g')"
    marked = rf"string_split(regexp_replace({folded}, '(?m)^(\p{{Nd}}+)([.)][{_SP}]*)([^\n]*)', chr(64976) || '\1' || chr(64977) || '\2\3', 'g'), chr(64976))"
    # before the mark the number, after it what follows
    digits = f"split_part(p, chr(64977), 1)"
    follows = f"substr(p, strpos(p, chr(64977)) + 1)"
    numbered = rf"CASE WHEN strpos(p, chr(64977)) = 0 THEN p WHEN regexp_matches({follows}, '^[.)][{_SP}]*[^\n]*[{_AR}]') THEN translate({digits}, '0123456789', '٠١٢٣٤٥٦٧٨٩') || {follows} ELSE {digits} || {follows} END"
    text = f"array_to_string(list_transform({marked}, lambda p: {numbered}), '')"
    kept = rf"list_filter(list_transform(string_split({text}, chr(10)), lambda x: {strip_sql('x')}), lambda x: x <> '' AND NOT regexp_full_match(x, '[()\[\]{{}}{_SP}\-_/\\.،؛]+'))"
    return strip_sql(rf"regexp_replace(regexp_replace(array_to_string({kept}, chr(10)), '[ \t]{{2,}}', ' ', 'g'), '[\x{{200B}}\x{{200C}}\x{{200D}}\x{{FEFF}}]', '', 'g')")


def sentences_sql(c: str) -> str:
    ends = rf"regexp_replace(regexp_replace(regexp_replace({c}, '([.!?؟])[{_SP}]+', '\1' || chr(1), 'g'), '([{_AR}])\n', '\1' || chr(1), 'g'), '\n\n+', chr(1), 'g')"
    return f"list_filter(list_transform(string_split({ends}, chr(1)), lambda x: {strip_sql('x')}), lambda x: length(x) > 5)"


def re2(pattern: str) -> str:
    """A pattern of ours in the SQL's notation: a word's edge takes the character beside it, or the text's end."""
    out, edge = "", r"\b"
    while edge in pattern:
        before, _, pattern = pattern.partition(edge)
        out += before
        opens = not out or out[-1] in "|(" or pattern[:1] == "("
        out += rf"(?:^|[^{_W}])" if opens else rf"(?:$|[^{_W}])"
    return ("(?i)" + out + pattern).replace(r"\s", f"[{_SP}]").replace("'", "''")


def any_sql(c: str, patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches({c}, '{re2(p)}')" for p in patterns) + ")"


def contains_sql(c: str, words) -> str:
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


@query(f"SELECT id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct FROM (SELECT id, {tokens_sql('text')} AS t FROM {_DOCS})")
def tok_stats(spark, sf_dir):
    t = all_docs(spark, sf_dir).withColumn("t", T.tokenize(F.col("text")))
    return t.select("id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


@query(f"SELECT id, {clean_sql('text')} AS cleaned FROM {_DOCS}")
def clean_lines(spark, sf_dir):
    return all_docs(spark, sf_dir).select("id", T.clean(F.col("text")).alias("cleaned"))


@query(rf"SELECT id, ar, en, CASE WHEN en > wide THEN 'en' ELSE 'ar' END AS language, CASE WHEN ar > en THEN 'ar' WHEN en > ar THEN 'en' ELSE 'mixed' END AS chunk_language FROM (SELECT id, {count_sql('text', _AR)} AS ar, {count_sql('text', _AR + r'\x{0750}-\x{077F}')} AS wide, {count_sql('text', 'A-Za-z')} AS en FROM {_DOCS})")
def lang_script_counts(spark, sf_dir):
    c = F.col("text")
    return all_docs(spark, sf_dir).select("id", T.n_matches(c, T.ARABIC).cast("long").alias("ar"), T.n_matches(c, "A-Za-z").cast("long").alias("en"), T.language(c).alias("language"), T.chunk_language(c).alias("chunk_language"))


def section_sql(c: str) -> str:
    """The class most of whose patterns, with folded alefs, occur; the first of equal ones."""
    scores = {name: " + ".join(f"CAST(regexp_matches(lower({c}), '{x.translate(str.maketrans('أإآٱ', 'اااا'))}') AS INT)" for x in patterns) for name, patterns in lex.SECTIONS.items() if patterns}
    listed = ", ".join(scores.values())
    names = ", ".join(f"'{x}'" for x in scores)
    return f"CASE WHEN list_max([{listed}]) = 0 THEN 'general' ELSE [{names}][list_position([{listed}], list_max([{listed}]))] END"


@query(f"SELECT id, {section_sql('text')} AS section FROM {_DOCS}")
def section_argmax(spark, sf_dir):
    return all_docs(spark, sf_dir).select("id", T.section(F.col("text")).alias("section"))


def chunk_type_sql(c: str, kind: str) -> str:
    return rf"CASE WHEN {kind} = 'table' THEN 'table_row' WHEN regexp_matches({c}, '(?m)^(س:|ج:)') OR regexp_matches({c}, '(?mi)^(Q:|A:)') THEN 'faq' WHEN regexp_matches({c}, '\p{{Nd}}+[{_SP}]*(ألف|الف|جنيه|دولار|%)') THEN 'numeric_data' ELSE 'paragraph' END"


_KIND = "CASE WHEN id % 7 = 0 THEN 'table' ELSE 'prose' END"


@query(f"SELECT id, {chunk_type_sql('text', _KIND)} AS chunk_type FROM {_DOCS}")
def chunk_type_case(spark, sf_dir):
    kind = F.when(F.col("id") % 7 == 0, "table").otherwise("prose")
    return all_docs(spark, sf_dir).select("id", T.chunk_type(F.col("text"), kind).alias("chunk_type"))


_URL = rf"(https?://[^{_SP}{_AR}»«)\]}}]+|www\.[^{_SP}{_AR}»«)\]}}]+)"


def urls_sql(c: str) -> str:
    return f"list_transform(regexp_extract_all({c}, '{_URL}'), lambda u: CASE WHEN starts_with(u, 'www.') THEN 'https://' || u ELSE u END)"


@query(f"""SELECT page_id, unnest({urls_sql("concat_ws(' ', 'see', url, 'and www.example.org/x', html)")}) AS url FROM pages UNION ALL SELECT id, unnest({urls_sql('text')}) FROM (VALUES {rows_sql(INLINE)}) AS v(id, text)""")
def page_urls(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat_ws(" ", F.lit("see"), "url", F.lit("and www.example.org/x"), "html").alias("text"))
    rows = spread(pages).unionByName(inline_docs(spark).select(F.col("id").alias("page_id"), "text"))
    return rows.select("page_id", F.explode(T.urls(F.col("text"))).alias("url"))


@query("SELECT doc_id AS id, md5('question' || '||' || substr(text, 1, 200)) AS key FROM documents")
def cache_keys(spark, sf_dir):
    return docs_of(spark, sf_dir).select("id", T.cache_key(F.lit("question"), F.col("text")).alias("key"))


@query(f"SELECT id, i AS chunk_index, chunk FROM (SELECT id, CAST((s // 80) AS INT) AS i, array_to_string(list_slice(w, s + 1, s + 100), ' ') AS chunk FROM (SELECT id, {words_sql('text')} AS w FROM {_DOCS}), unnest(range(0, greatest(len(w), 1), 80)) AS t(s)) WHERE length(chunk) > 0")
def chunk_fixed(spark, sf_dir):
    return all_docs(spark, sf_dir).select("id", F.posexplode(C.chunk_fixed(F.col("text"), 100, 20, 0)).alias("chunk_index", "chunk"))


@query(f"SELECT id, CAST(i - 1 AS INT) AS place, s[i] AS sentence FROM (SELECT id, {sentences_sql('text')} AS s FROM {_DOCS}), unnest(range(1, len(s) + 1)) AS t(i)")
def sentence_split(spark, sf_dir):
    return all_docs(spark, sf_dir).select("id", F.posexplode(T.sentences(F.col("text"))).alias("place", "sentence"))


# a fold over sentences: done chunks, the open one's sentences and words; x and w are the sentence that comes
_OPEN = "list_transform(s.xs, lambda c: c.t)"
_FLUSHED = f"CASE WHEN len(s.xs) > 0 THEN list_append(s.done, array_to_string({_OPEN}, ' ')) ELSE s.done END"
_TAIL = "len(list_filter(range(1, len(s.xs) + 1), lambda k: list_sum(list_transform(list_slice(s.xs, len(s.xs) - k + 1, len(s.xs)), lambda c: c.n)) <= 40))"
_KEPT = f"list_slice(s.xs, len(s.xs) - ({_TAIL}) + 1, len(s.xs))"
_STEP = f"""CASE WHEN e.w > 200 THEN {{'done': list_append({_FLUSHED}, e.x), 'xs': [], 'n': 0, 'x': '', 'w': 0}}
WHEN s.n + e.w > 200 AND len(s.xs) > 0 THEN {{'done': {_FLUSHED}, 'xs': list_append({_KEPT}, {{'t': e.x, 'n': e.w}}), 'n': coalesce(list_sum(list_transform({_KEPT}, lambda c: c.n)), 0) + e.w, 'x': '', 'w': 0}}
ELSE {{'done': s.done, 'xs': list_append(s.xs, {{'t': e.x, 'n': e.w}}), 'n': s.n + e.w, 'x': '', 'w': 0}} END"""
_FOLD = "STRUCT(done VARCHAR[], xs STRUCT(t VARCHAR, n BIGINT)[], n BIGINT, x VARCHAR, w BIGINT)"


@query(f"""WITH u AS (SELECT id, list_transform({sentences_sql('text')}, lambda x: CAST({{'done': [], 'xs': [], 'n': 0, 'x': x, 'w': len({words_sql('x')})}} AS {_FOLD})) AS es FROM {_DOCS}),
f AS (SELECT id, list_reduce(es, lambda s, e: CAST({_STEP} AS {_FOLD}), CAST({{'done': [], 'xs': [], 'n': 0, 'x': '', 'w': 0}} AS {_FOLD})) AS s FROM u WHERE len(es) > 0),
c AS (SELECT id, list_filter({_FLUSHED}, lambda x: length(x) > 40) AS cs FROM f)
SELECT id, CAST(i - 1 AS INT) AS chunk_index, cs[i] AS chunk FROM c, unnest(range(1, len(cs) + 1)) AS t(i)""")
def pack_sentences(spark, sf_dir):
    return all_docs(spark, sf_dir).select("id", F.posexplode(C.chunk_sentences(F.col("text"))).alias("chunk_index", "chunk"))


def tail_sql(c: str, n: int) -> str:
    w = words_sql(c)
    return f"CASE WHEN len({w}) > {n} THEN array_to_string(list_slice({w}, len({w}) - {n - 1}, len({w})), ' ') ELSE {strip_sql(c)} END"


@query(f"SELECT id, {tail_sql('text', 30)} AS tail FROM {_DOCS}")
def overlap_tail(spark, sf_dir):
    return all_docs(spark, sf_dir).select("id", T.tail_words(F.col("text"), 30).alias("tail"))


def _units(spark, sf_dir):
    vectors = vectors_of(spark, sf_dir).select("id", "embedding", "label")
    return docs_of(spark, sf_dir).join(vectors, "id").select(F.col("label").alias("run"), F.col("id").alias("unit"), "text", "embedding")


_COS = "list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"


def groups_sql(units: str) -> str:
    """CTEs up to g (run, unit, text, sim, threshold, b), from units (run, unit, text, embedding)."""
    return f"""u AS ({units}),
s AS (SELECT run, unit, text, {_COS.format(a="embedding", b="lead(embedding) OVER w")} AS sim FROM u WINDOW w AS (PARTITION BY run ORDER BY unit)),
t AS (SELECT run, quantile_cont(sim, 0.3) AS threshold FROM s GROUP BY run),
g AS (SELECT s.run, unit, text, sim, threshold, coalesce(CAST(lag(sim) OVER (PARTITION BY s.run ORDER BY unit) < threshold AS INT), 0) AS b FROM s JOIN t ON s.run = t.run)
"""


def chunks_sql(max_words: int = 150, min_words: int = 40, overlap: int = 30) -> str:
    """CTEs from g to chunks (run, i, text): packed groups, small ones merged, overlap, the long ones."""
    fold = "STRUCT(done VARCHAR[], cur VARCHAR, n BIGINT, g BIGINT, x VARCHAR, w BIGINT)"
    none = "{'done': [], 'cur': '', 'n': 0, 'g': -1, 'x': '', 'w': 0}"
    flushed = "CASE WHEN s.cur <> '' THEN list_append(s.done, s.cur) ELSE s.done END"
    step = f"CASE WHEN s.cur <> '' AND (e.g <> s.g OR s.n + e.w > {max_words}) THEN {{'done': list_append(s.done, s.cur), 'cur': e.x, 'n': e.w, 'g': e.g, 'x': '', 'w': 0}} WHEN s.cur = '' THEN {{'done': s.done, 'cur': e.x, 'n': e.w, 'g': e.g, 'x': '', 'w': 0}} ELSE {{'done': s.done, 'cur': s.cur || ' ' || e.x, 'n': s.n + e.w, 'g': e.g, 'x': '', 'w': 0}} END"
    merge = f"CASE WHEN len(s) > 0 AND len({words_sql('e[1]')}) < {min_words} THEN list_concat(list_slice(s, 1, len(s) - 1), [s[len(s)] || ' ' || e[1]]) ELSE list_concat(s, e) END"
    return f"""k AS (SELECT run, unit, {strip_sql('text')} AS x, CAST(sum(b) OVER (PARTITION BY run ORDER BY unit) AS BIGINT) AS grp FROM g),
l AS (SELECT run, count(*) AS n, any_value(x) AS one, list(CAST({{'done': [], 'cur': '', 'n': 0, 'g': grp, 'x': x, 'w': len({words_sql('x')})}} AS {fold}) ORDER BY unit) AS es FROM k GROUP BY run),
p AS (SELECT run, n, one, list_reduce(es, lambda s, e: CAST({step} AS {fold}), CAST({none} AS {fold})) AS s FROM l),
m AS (SELECT run, n, one, list_reduce(list_transform({flushed}, lambda x: [x]), lambda s, e: {merge}, CAST([] AS VARCHAR[])) AS ms FROM p),
o AS (SELECT run, CASE WHEN n = 1 THEN [one] ELSE list_filter(list_transform(ms, lambda c, i: CASE WHEN i = 1 THEN c ELSE {strip_sql(f"({tail_sql('ms[i - 1]', overlap)}) || ' ' || c")} END), lambda c: length({strip_sql('c')}) > 40) END AS cs FROM m),
chunks AS (SELECT run, CAST(i - 1 AS INT) AS i, cs[i] AS text FROM o, unnest(range(1, len(cs) + 1)) AS t(i))
"""


_GROUPS = "WITH " + groups_sql("SELECT label AS run, doc_id AS unit, text, embedding FROM documents JOIN embeddings ON doc_id = vec_id")


@query(_GROUPS + 'SELECT run, unit, round(sim, 6) AS sim, round(threshold, 6) AS threshold, CAST(sum(b) OVER (PARTITION BY run ORDER BY unit) AS BIGINT) AS "group" FROM g')
def semantic_groups(spark, sf_dir):
    return C.semantic_groups(_units(spark, sf_dir)).select("run", "unit", F.round("sim", 6).alias("sim"), F.round("threshold", 6).alias("threshold"), F.col("group").cast("long").alias("group"))


@query(_GROUPS.rstrip() + ", " + chunks_sql() + "SELECT run, i AS chunk_index, text FROM chunks")
def semantic_chunks(spark, sf_dir):
    return C.semantic_chunks(_units(spark, sf_dir), large=True)


def bm25_sql(k: int, docs: str = "(SELECT doc_id AS id, text FROM documents)", queries: str = "(SELECT item_id AS query_id, text FROM benchmark)", where: str = "") -> str:
    """CTEs up to sparse (query_id, id, bm25_score, rank)."""
    return f"""WITH d AS MATERIALIZED (SELECT id, {tokens_sql('text')} AS t FROM {docs}),
st AS MATERIALIZED (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM d),
p AS MATERIALIZED (SELECT id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT id, len(t) AS dl, unnest(t) AS term FROM d) GROUP BY id, term),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
r AS MATERIALIZED (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM f, st),
mr AS MATERIALIZED (SELECT avg(raw) AS mean FROM r),
x AS MATERIALIZED (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * mean ELSE raw END AS idf FROM r, mr),
q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({tokens_sql('text')}) AS term FROM {queries}) GROUP BY query_id, term),
h AS (SELECT query_id, p.id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 9) AS bm25_score FROM p JOIN x ON p.term = x.term JOIN q ON q.term = p.term, st {where} GROUP BY query_id, p.id),
sparse AS MATERIALIZED (SELECT * FROM (SELECT query_id, id, bm25_score, row_number() OVER (PARTITION BY query_id ORDER BY bm25_score DESC, id) AS rank FROM h) WHERE rank <= {k} AND bm25_score > 0)
"""


@query(bm25_sql(10) + "SELECT term, CAST(df AS BIGINT) AS df, round(idf, 6) AS idf FROM x")
def bm25_terms(spark, sf_dir):
    return R.bm25_index(docs_of(spark, sf_dir)).terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query(bm25_sql(10) + "SELECT query_id, id, round(bm25_score, 6) AS bm25_score FROM sparse")
def bm25_search(spark, sf_dir):
    hits = R.bm25_search(R.bm25_index(docs_of(spark, sf_dir)), queries_of(spark, sf_dir), 10)
    return hits.select("query_id", "id", F.round("bm25_score", 6).alias("bm25_score"))


_FINAL = "(SELECT doc_id AS id, CASE WHEN doc_id % 10 = 1 THEN text || ' of the last batch' ELSE text END AS text FROM documents WHERE doc_id % 7 <> 0 OR doc_id % 14 = 0)"


@query(bm25_sql(10, _FINAL) + "SELECT query_id, id, round(bm25_score, 6) AS bm25_score, CAST(rank AS INT) AS rank FROM sparse")
def bm25_incremental(spark, sf_dir):
    """An index built in three batches, with changes, deletions, texts that come back, and a merge of two segments between."""
    docs, index = docs_of(spark, sf_dir).select("id", "text"), SegmentedIndex(Store(spark, new_path(spark, "collection")))
    index.add(docs.where("id % 3 <> 0").withColumn("text", F.when(F.col("id") % 5 == 0, F.concat(F.lit("an older form "), "text")).otherwise(F.col("text"))))
    index.add(docs.where("id % 3 = 0 or id % 5 = 0"), docs.where("id % 7 = 0 and id % 3 <> 0 and id % 5 <> 0"))
    index.compact()
    last = F.when(F.col("id") % 10 == 1, F.concat("text", F.lit(" of the last batch"))).otherwise(F.col("text"))
    index.add(docs.where("(id % 10 = 1 and id % 7 <> 0) or id % 14 = 0").withColumn("text", last), docs.where("id % 7 = 0 and id % 14 <> 0"))
    hits = R.bm25_search(index.index(), queries_of(spark, sf_dir), 10)
    return hits.withColumn("bm25_score", F.round("bm25_score", 6))


#: Texts of a block of neighbouring ids.
_BLOCK = 32


def _block_search(spark, sf_dir):
    index = K.block_index(R.bm25_index(docs_of(spark, sf_dir)), F.floor(F.col("id") / _BLOCK))
    return K.block_search(index, queries_of(spark, sf_dir), 10)


@query(bm25_sql(10) + "SELECT query_id, id, round(bm25_score, 6) AS bm25_score, CAST(rank AS INT) AS rank FROM sparse")
def bm25_block_search(spark, sf_dir):
    return _block_search(spark, sf_dir)[0].withColumn("bm25_score", F.round("bm25_score", 6))


@query(bm25_sql(10).rstrip() + f""",
u AS (SELECT term, id // {_BLOCK} AS block, max(tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) AS upper FROM p, st GROUP BY term, block),
bo AS (SELECT query_id, block, round(sum(greatest(qtf * idf, 0) * upper), 9) AS bound FROM u JOIN x ON x.term = u.term JOIN q ON q.term = u.term GROUP BY query_id, block),
ea AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bound DESC, block) <= 4 AS early FROM bo),
ks AS (SELECT query_id, bm25_score AS least FROM (SELECT h.*, row_number() OVER (PARTITION BY query_id ORDER BY bm25_score DESC, id) AS place FROM h JOIN ea USING (query_id) WHERE early AND block = id // {_BLOCK}) WHERE place = 10)
SELECT query_id, count(*) AS blocks, count(*) FILTER (WHERE early OR least IS NULL OR bound >= least) AS opened FROM ea LEFT JOIN ks USING (query_id) GROUP BY query_id""")
def bm25_blocks_read(spark, sf_dir):
    """How many of the blocks that hold a query's terms its search opens."""
    return _block_search(spark, sf_dir)[1]


_DENSE = f"""qv AS (SELECT item_id AS query_id, embedding AS e FROM benchmark JOIN embeddings ON item_id = vec_id),
ds AS (SELECT query_id, vec_id AS id, round((1 + {_COS.format(a="embedding", b="e")}) / 2, 4) AS score FROM embeddings, qv :where),
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM ds) WHERE rank <= :k AND score > 0.40)
"""


@query("WITH " + _DENSE.replace(":k", str(7)).replace(":where", "") + "SELECT query_id, id, score, CAST(rank AS INT) AS rank FROM dense")
def dense_topk(spark, sf_dir):
    return R.dense_search(vectors_of(spark, sf_dir), vector_queries_of(spark, sf_dir), 7)


@query("WITH " + _DENSE.replace(":k", str(7)).replace(":where", "WHERE label = 3") + "SELECT query_id, id, score, CAST(rank AS INT) AS rank FROM dense")
def dense_topk_filtered(spark, sf_dir):
    return R.dense_search(vectors_of(spark, sf_dir), vector_queries_of(spark, sf_dir), 7, F.col("label") == 3)


# a query asks section query_id % 14; some of these hold no vector, one asks all
_OWN_SECTION = "nullif(item_id % 14, 5) AS own"
_BY_SECTION = "WHERE own IS NULL OR own = label OR (:retry AND own NOT IN (SELECT label FROM embeddings WHERE label IS NOT NULL))"


def by_section_sql(retry: bool) -> str:
    dense = _DENSE.replace(":k", str(7)).replace("embedding AS e FROM", f"embedding AS e, {_OWN_SECTION} FROM").replace(":where", _BY_SECTION.replace(":retry", str(retry)))
    return "WITH " + dense + "SELECT query_id, id, score, CAST(rank AS INT) AS rank FROM dense"


def _by_section(spark, sf_dir, retry):
    vectors = vectors_of(spark, sf_dir).select("id", "embedding", F.col("label").cast("long").alias("section"))
    asked = vector_queries_of(spark, sf_dir).withColumn("section", F.nullif(F.col("query_id") % 14, F.lit(5)).cast("long"))
    return R.dense_search_by_section(vectors, asked, 7, retry)


@query(by_section_sql(False))
def dense_topk_by_section(spark, sf_dir):
    return _by_section(spark, sf_dir, retry=False)


@query(by_section_sql(True))
def dense_topk_retried(spark, sf_dir):
    """Queries whose section holds no vector are searched in all of them."""
    return _by_section(spark, sf_dir, retry=True)


@query("WITH " + _DENSE.replace(":k", str(7)).replace(":where", "") + "SELECT query_id, id, score, CAST(rank AS INT) AS rank FROM dense")
def ivf_topk(spark, sf_dir):
    """The cell index with all cells probed: exact."""
    return V.cell_search(V.build_cells(vectors_of(spark, sf_dir)), vector_queries_of(spark, sf_dir), 7, probes=None)


@query()
def ivf_recall(spark, sf_dir):
    """How many of the exact top 7 the cell index finds with as many probes as a sample says."""
    vectors, asked = vectors_of(spark, sf_dir), vector_queries_of(spark, sf_dir)
    index = V.build_cells(vectors)
    probes = V.probes_for(index, 7)
    return V.recall(V.cell_search(index, asked, 7, probes), R.dense_search(vectors, asked, 7)).select("*", F.lit(probes).alias("probes"), F.lit(len(index.centres)).alias("cells"))


def _fused_sql(k: int, keep: int, keys: str, dense_where: str = "", sparse_where: str = "") -> str:
    return (
        bm25_sql(k, where=sparse_where).rstrip()
        + ", "
        + _DENSE.replace(":k", str(k)).replace(":where", dense_where)
        + f""", parts AS (SELECT query_id, id, 0.6 / (rank + 60) AS part, 'dense' AS origin FROM dense UNION ALL SELECT query_id, id, 0.4 / (rank + 60), 'sparse' FROM sparse),
fu AS (SELECT {keys}, sum(CAST(part AS DOUBLE)) AS rrf_score FROM parts GROUP BY {keys}),
fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf_score, 12) DESC, {keys.removeprefix("query_id, ")}) AS rank FROM fu)
SELECT {keys}, round(rrf_score, 6) AS rrf_score, CAST(rank AS INT) AS rank FROM fr WHERE rank <= {keep}"""
    )


def _hybrid(spark, sf_dir, k, mode):
    hits = R.hybrid_search(R.bm25_index(docs_of(spark, sf_dir)), vectors_of(spark, sf_dir), vector_queries_of(spark, sf_dir).select("query_id", "embedding", "text"), k, key_mode=mode)
    return hits.withColumn("rrf_score", F.round("rrf_score", 6))


@query(_fused_sql(16, 8, "query_id, id"))
def hybrid_topk(spark, sf_dir):
    return _hybrid(spark, sf_dir, 8, "id")


@query(_fused_sql(16, 8, "query_id, id, origin"))
def hybrid_topk_compat(spark, sf_dir):
    return _hybrid(spark, sf_dir, 8, "compat")


_SECTION = 3


@query(_fused_sql(16, 8, "query_id, id", f"WHERE label = {_SECTION}", f"WHERE p.id IN (SELECT vec_id FROM embeddings WHERE label = {_SECTION})"))
def hybrid_topk_filtered(spark, sf_dir):
    """Both sides see one section alone, before they are cut."""
    vectors, section = vectors_of(spark, sf_dir), F.col("label") == _SECTION
    hits = R.hybrid_search(R.bm25_index(docs_of(spark, sf_dir)), vectors, vector_queries_of(spark, sf_dir).select("query_id", "embedding", "text"), 8, section, vectors)
    return hits.withColumn("rrf_score", F.round("rrf_score", 6))


_OVERLAP = "CASE WHEN len(qt) = 0 THEN 0.0 ELSE CAST(len(list_intersect(qt, list_distinct(dt))) AS DOUBLE) / len(qt) END"


@query("WITH fused AS (" + _fused_sql(48, 24, "query_id, id") + f"""),
rr AS (SELECT query_id, id, {_OVERLAP} AS rerank_score FROM (SELECT query_id, id, list_distinct({tokens_sql('b.text')}) AS qt, {tokens_sql('d.text')} AS dt FROM fused JOIN benchmark b ON b.item_id = query_id JOIN documents d ON d.doc_id = id)),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, id) AS INT) AS rank FROM rr)
SELECT query_id, id, rerank_score, rank FROM ranked WHERE rank <= 8""")
def hybrid_rerank(spark, sf_dir):
    q = vector_queries_of(spark, sf_dir)
    return R.hybrid_rerank_search(R.bm25_index(docs_of(spark, sf_dir)), vectors_of(spark, sf_dir), q, docs_of(spark, sf_dir), 8)


@query(bm25_sql(24).rstrip() + """,
tp AS (SELECT id, t[i] AS term, i FROM d, unnest(range(1, len(t) + 1)) AS u(i) WHERE id IN (SELECT id FROM sparse)),
ev AS MATERIALIZED (SELECT s.query_id, s.id, tp.term, tp.i FROM sparse s JOIN q ON q.query_id = s.query_id JOIN tp ON tp.id = s.id AND tp.term = q.term),
cv AS (SELECT query_id, id, count(DISTINCT term) AS covered FROM ev GROUP BY query_id, id),
pa AS (SELECT e.query_id, e.id, e.i, f.term, max(f.i) AS before FROM ev e JOIN ev f ON f.query_id = e.query_id AND f.id = e.id AND f.i <= e.i GROUP BY e.query_id, e.id, e.i, f.term),
wi AS (SELECT query_id, id, i, count(*) AS n, i - min(before) + 1 AS width FROM pa GROUP BY query_id, id, i),
sp AS (SELECT query_id, id, covered, min(width) AS span FROM wi JOIN cv USING (query_id, id) WHERE n = covered GROUP BY query_id, id, covered),
nt AS (SELECT query_id, count(*) AS terms FROM q GROUP BY query_id),
sc AS (SELECT *, round(covered / terms * (covered / span), 9) AS span_score FROM sp JOIN nt USING (query_id)),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY span_score DESC, id) AS rank FROM sc)
SELECT query_id, id, CAST(covered AS INT) AS covered, CAST(span AS INT) AS span, round(span_score, 6) AS span_score, CAST(rank AS INT) AS rank FROM rk WHERE rank <= 8""")
def span_rerank(spark, sf_dir):
    """Sparse hits ranked anew by the shortest stretch that holds the query's terms."""
    docs, asked = docs_of(spark, sf_dir), queries_of(spark, sf_dir)
    hits = R.bm25_search(R.bm25_index(docs), asked, 24)
    return positions.span_rerank(positions.positional_postings(R.with_texts(hits.select("id").distinct(), docs)), asked, hits).withColumn("span_score", F.round("span_score", 6))


@query("SELECT doc_id AS id, text FROM documents UNION ALL SELECT item_id + 500 AS id, text FROM benchmark WHERE item_id + 500 NOT IN (SELECT doc_id FROM documents)")
def kb_complete(spark, sf_dir):
    literal = queries_of(spark, sf_dir).select((F.col("query_id") + 500).alias("id"), "text")
    return R.complete(docs_of(spark, sf_dir).select("id", "text"), literal)


@query("SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN upper(source) ELSE source END AS source, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS version FROM documents")
def upsert_latest(spark, sf_dir):
    old = docs_of(spark, sf_dir).select("id", "source", F.lit(1).alias("version"))
    new = old.where("id % 3 = 0").select("id", F.upper("source").alias("source"), F.lit(2).alias("version"))
    return R.upsert(old, new)


@query("SELECT doc_id AS id, CASE WHEN doc_id % 4 = 1 THEN upper(source) WHEN doc_id % 3 = 0 THEN lang ELSE source END AS source, CASE WHEN doc_id % 4 = 1 THEN 3 WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS version FROM documents")
def upsert_buckets(spark, sf_dir):
    """Three upserts of a table in buckets, each of which rewrites the buckets that it touches."""
    stored, old = BucketedTable(Store(spark, new_path(spark, "collection")), "chunks", buckets=16), docs_of(spark, sf_dir).select("id", "source", "lang", F.lit(1).alias("version"))
    for rows in (old.where("id % 3 <> 0 or id % 2 = 0"), old.where("id % 3 = 0").withColumns({"source": F.col("lang"), "version": F.lit(2)}), old.where("id % 4 = 1").withColumns({"source": F.upper("source"), "version": F.lit(3)})):
        stored.upsert(rows.drop("lang"))
    return stored.rows().select("id", "source", "version")


#: Messages beside those of ``conversations``: one for each intent, and those on which rules meet.
INLINE_TURNS = (
    "Hi there", "hi what is the tuition of this faculty now", "ok thanks", "شكرا", "ok ok ok ok ok ok ok", "kill myself", "you idiot", "tell me a joke", "say it in english", "translate it to arabic", "in arabic", "ترجم للعربية",
    "ما هي شروط القبول", "رسوم كلية الهندسة", "عايز اموت", "كلب", "كلبة", "مرحبا بك في البيت الجديد يا صديقي", "طقس اليوم", "lorem ipsum dolor", "Can one swim?", "scholarship", "which way", "clear", "مساعدة", "quit", "مصادر", "هاي", "الكتاب جيد", "أ ب", "", " \t ", "damned", "damn", "can't go on",
)


def all_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` and INLINE_TURNS, five to a conversation of its own, all by a user."""
    own = spark.createDataFrame([(-1 - i // 5, i, "user", x) for i, x in enumerate(INLINE_TURNS)], "conv_id long, turn long, role string, text string")
    return spread(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")).unionByName(own)


_TURNS = "(SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({-1 - i // 5}, {i}, 'user', {quoted(x)})" for i, x in enumerate(INLINE_TURNS)) + ") AS v(conv_id, turn, role, text))"


def intent_sql(t: str) -> str:
    """The intent of a trimmed message in lower case."""
    w = words_sql(t)
    greets = " OR ".join(any_sql(t, [rf"\b{g}\b"]) if len(g) <= 4 else f"contains({t}, '{g}')" for g in lex.GREETINGS)
    known = ", ".join(f"'{x}'" for x in lex.ACKNOWLEDGMENTS)
    bare = f"list_filter(list_transform({w}, lambda w: regexp_replace(w, '^[.,!؟?]+|[.,!؟?]+$', '', 'g')), lambda w: length(w) > 1)"
    topics = contains_sql(t, (*lex.KEYWORDS_AR, *lex.KEYWORDS_EN))
    return f"""CASE WHEN {any_sql(t, lex.CRISIS)} THEN 'crisis' WHEN {any_sql(t, lex.OFFENSIVE)} THEN 'offensive'
WHEN {any_sql(t, (*lex.SWITCH_TO_EN, *lex.SWITCH_TO_AR))} THEN 'language_switch'
WHEN len({w}) <= 4 AND ({greets}) THEN 'greeting'
WHEN len({w}) BETWEEN 1 AND 6 AND len({bare}) > 0 AND len(list_filter({bare}, lambda w: w NOT IN ({known}))) = 0 THEN 'acknowledgment'
WHEN {any_sql(t, lex.OUT_OF_SCOPE)} THEN 'out_of_scope' WHEN {topics} OR {any_sql(t, lex.QUESTIONS)} THEN 'in_scope'
WHEN {count_sql(t, _AR)} >= 4 AND len({w}) >= 2 THEN 'in_scope' ELSE 'out_of_scope' END"""


def language_sql(c: str) -> str:
    return f"CASE WHEN {count_sql(c, 'A-Za-z')} > {count_sql(c, _AR + r'\x{0750}-\x{077F}')} THEN 'en' ELSE 'ar' END"


def switch_sql(t: str) -> str:
    return f"CASE WHEN {any_sql(t, lex.SWITCH_TO_EN)} THEN 'en' WHEN {any_sql(t, lex.SWITCH_TO_AR)} THEN 'ar' END"


def command_sql(t: str) -> str:
    return f"CASE WHEN {t} IN ('quit', 'exit', 'q', 'خروج') THEN 'quit' WHEN {t} IN ('help', 'مساعدة') THEN 'help' WHEN {t} IN ('clear', 'مسح') THEN 'clear' WHEN {t} IN ('sources', 'مصادر') THEN 'sources' END"


@query(f"SELECT conv_id, turn, {intent_sql('t')} AS intent, {switch_sql('t')} AS switch, {command_sql('t')} AS command, {language_sql('text')} AS language FROM (SELECT conv_id, turn, text, {strip_sql('lower(text)')} AS t FROM {_TURNS})")
def intent_route(spark, sf_dir):
    c = F.col("text")
    return all_turns(spark, sf_dir).select("conv_id", "turn", routing.intent(c).alias("intent"), routing.language_switch(c).alias("switch"), routing.command(c).alias("command"), T.language(c).alias("language"))


@query(f"SELECT conv_id, turn, {intent_sql('t')} AS intent FROM (SELECT conv_id, turn, text, {strip_sql('lower(text)')} AS t FROM {_TURNS})")
def intent_rules(spark, sf_dir):
    """The intents by a table of rules: one automaton over each message."""
    table_of_rules = spark.createDataFrame(rules.default_rules(), rules.SCHEMA)
    return rules.route(all_turns(spark, sf_dir), table_of_rules).select("conv_id", "turn", "intent")


_REAL = "role <> 'user' AND length(text) % 3 <> 0"


@query(f"""SELECT conv_id, turn, coalesce(array_to_string(list(turn || ':' || text) OVER r, '|'), '') AS recent, row_number() OVER w > 1 AS has_history, last_value(CASE WHEN {_REAL} THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_answer
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn), r AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)""")
def history3(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").withColumn("intent", F.when(F.expr(_REAL), "in_scope").otherwise("greeting"))
    recent = F.array_join(F.transform("recent", lambda r: F.concat_ws(":", r["turn"], r["text"])), "|")
    return G.history(turns).select("conv_id", "turn", recent.alias("recent"), "has_history", "last_answer")


def _hits(spark, sf_dir):
    hits = R.bm25_search(R.bm25_index(docs_of(spark, sf_dir)), queries_of(spark, sf_dir), 3)
    return R.with_texts(hits, docs_of(spark, sf_dir).select("id", "text", "source", F.col("lang").alias("section")))


_HITS = bm25_sql(3).rstrip() + ", hits AS (SELECT query_id, rank, text, source, lang AS section FROM sparse JOIN documents ON id = doc_id)\n"


@query(_HITS + r"SELECT query_id, string_agg('[' || rank || '] ' || source || ' - ' || section || chr(10) || text, chr(10) || '---' || chr(10) ORDER BY rank) AS context FROM hits GROUP BY query_id")
def context_build(spark, sf_dir):
    return G.build_context(_hits(spark, sf_dir))


@query(_HITS + "SELECT query_id, string_agg(source || ' - ' || section, chr(10) ORDER BY r) AS sources FROM (SELECT query_id, source, section, min(rank) AS r FROM hits GROUP BY query_id, source, section) GROUP BY query_id")
def sources_dedup(spark, sf_dir):
    return G.sources(_hits(spark, sf_dir))


@query(_HITS + "SELECT item_id AS query_id, CASE WHEN n IS NULL THEN 'No answer was found.' ELSE best || chr(10) || 'Source: ' || src END AS answer, CAST(coalesce(n, 0) AS BIGINT) AS chunks_found FROM benchmark LEFT JOIN (SELECT query_id, arg_min(text, rank) AS best, arg_min(source, rank) AS src, count(*) AS n FROM hits GROUP BY query_id) ON query_id = item_id")
def answer_extractive(spark, sf_dir):
    return G.answer_extractive(queries_of(spark, sf_dir), _hits(spark, sf_dir))


@query("SELECT CAST(o_custkey % 7 AS BIGINT) AS col_no, o_orderkey AS row_no, coalesce(last_value(CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus || o_orderkey END IGNORE NULLS) OVER (PARTITION BY o_custkey % 7 ORDER BY o_orderkey), '-') AS cell FROM orders")
def table_ffill(spark, sf_dir):
    cells = table(spark, sf_dir, "orders").select(F.lit(1).alias("doc"), F.lit(1).alias("table_no"), F.col("o_orderkey").alias("row_no"), (F.col("o_custkey") % 7).alias("col_no"), F.when(F.col("o_orderkey") % 3 != 0, F.concat("o_orderstatus", F.col("o_orderkey").cast("string"))).otherwise("-").alias("cell"))
    return C.forward_fill(cells).select("col_no", "row_no", "cell")


def ranges_of(spark: SparkSession) -> int:
    """As many ranges as a shuffle has partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@query("SELECT o_orderkey AS row_no, coalesce(last_value(CASE WHEN o_orderkey % 5 = 0 THEN o_orderstatus || o_orderkey END IGNORE NULLS) OVER (ORDER BY o_orderkey), '-') AS cell FROM orders")
def table_ffill_one_column(spark, sf_dir):
    """All rows in one column of one table, in many ranges."""
    cells = table(spark, sf_dir, "orders").select(F.lit(1).alias("doc"), F.lit(1).alias("table_no"), F.lit(1).alias("col_no"), F.col("o_orderkey").alias("row_no"), F.when(F.col("o_orderkey") % 5 == 0, F.concat("o_orderstatus", F.col("o_orderkey").cast("string"))).otherwise(" - ").alias("cell"))
    return C.forward_fill(cells, ranges=ranges_of(spark)).select("row_no", "cell")


@query("""WITH l AS (SELECT doc_id AS line_no, CASE WHEN doc_id % 17 = 0 THEN 'heading' WHEN doc_id % 11 < 4 THEN 'table' ELSE 'prose' END AS kind, text AS body FROM documents),
h AS (SELECT *, last_value(CASE WHEN kind = 'heading' THEN body END IGNORE NULLS) OVER w AS heading, sum(CAST(kind = 'heading' AS INT)) OVER w AS heads FROM l WINDOW w AS (ORDER BY line_no)),
c AS (SELECT *, CASE WHEN lag(kind) OVER w = kind AND lag(heads) OVER w = heads THEN 0 ELSE 1 END AS c FROM h WHERE kind <> 'heading' WINDOW w AS (ORDER BY line_no))
SELECT line_no, kind, body, heading, CAST(sum(c) OVER (ORDER BY line_no) AS BIGINT) AS run FROM c""")
def structure_runs_one_document(spark, sf_dir):
    """All texts as the lines of one document, in many ranges."""
    kind = F.when(F.col("id") % 17 == 0, "heading").when(F.col("id") % 11 < 4, "table").otherwise("prose")
    lines = docs_of(spark, sf_dir).select(F.lit(1).alias("doc"), F.col("id").alias("line_no"), kind.alias("kind"), F.col("text").alias("body"))
    return C.structure_runs(lines, ranges=ranges_of(spark)).drop("doc")


@query("SELECT CAST(l_linenumber AS INT) AS line, quantile_cont(l_extendedprice, 0.3) AS p30 FROM lineitem GROUP BY l_linenumber")
def price_percentile(spark, sf_dir):
    """Percentiles of groups of which none is held or sorted whole."""
    return scans.exact_percentile(table(spark, sf_dir, "lineitem"), "l_linenumber", "l_extendedprice", 0.3, "p30", small=500).withColumnRenamed("l_linenumber", "line")


@query("SELECT page, y, string_agg(t, ' | ' ORDER BY x0, t) AS text FROM (SELECT l_orderkey % 100 AS page, round_even(l_quantity * 7.5 / 15, 0) * 15 AS y, l_extendedprice AS x0, 'cell' || l_partkey AS t FROM lineitem) GROUP BY page, y")
def layout_rows(spark, sf_dir):
    blocks = table(spark, sf_dir, "lineitem").select(F.lit("d").alias("doc"), (F.col("l_orderkey") % 100).alias("page"), (F.col("l_quantity") * 7.5).alias("y0"), F.col("l_extendedprice").alias("x0"), F.concat(F.lit("cell"), F.col("l_partkey").cast("string")).alias("text"))
    return C.layout_lines(blocks).select("page", F.col("y").cast("double").alias("y"), "text")


@query("SELECT key, value FROM (SELECT md5(text || '||' || substr(text, 1, 200)) AS key, max(doc_id) AS value FROM documents GROUP BY 1)")
def cache_latest(spark, sf_dir):
    rows = docs_of(spark, sf_dir).select(T.cache_key(F.col("text"), F.col("text")).alias("key"), F.col("id").alias("value"), F.col("id").alias("version"))
    return G.cache_store(rows.where("id % 2 = 0"), rows.where("id % 2 = 1")).select("key", "value")


#: Blocks of broken lines, shaped letters, rules and zero-width characters, beside those of ``documents``.
BLOCKS = (
    "قال و\nالكتاب في\nالبيت\n\n ثم عاد \nال\nجامعة\nend of it",
    "من\nفي\nلا\nهو\nword\nوهو ب\nlatin ب",
    "و\n\n \nب",
    "\ufe94\u200b \ufedf\ufe8e  --- \ufedf___ab--c \ufe8e\ufeff\n-----\n\u200d x",
    "abc \u0627\u0628",
    "abcdefgh \u0627\u0628",
    "\n\n",
)
_BLOCKS = f"(SELECT doc_id AS id, replace(text, '. ', '.' || chr(10)) AS text FROM documents UNION ALL SELECT * FROM (VALUES {rows_sql(BLOCKS)}) AS v(id, text))"


def joined_sql(c: str) -> str:
    """Lines of a block in one: a fold whose state is the text, whether its end joins the next line, and whether it has begun."""
    fold = "STRUCT(t VARCHAR, glue BOOLEAN, used BOOLEAN, x VARCHAR)"
    lines = f"list_filter(list_transform(string_split({c}, chr(10)), lambda x: {strip_sql('x')}), lambda x: x <> '')"
    glued, short = f"(s.glue AND regexp_matches(e.x, '^[{_AR}]'))", f"regexp_matches(e.x, '(^|[{_SP}])[{_AR}]{{1,2}}$')"
    step = f"{{'t': CASE WHEN NOT s.used THEN e.x WHEN {glued} THEN s.t || e.x ELSE s.t || ' ' || e.x END, 'glue': NOT {glued} AND {short}, 'used': true, 'x': ''}}"
    each = f"list_transform({lines}, lambda x: CAST({{'t': '', 'glue': false, 'used': false, 'x': x}} AS {fold}))"
    return f"list_reduce({each}, lambda s, e: CAST({step} AS {fold}), CAST({{'t': '', 'glue': false, 'used': false, 'x': ''}} AS {fold})).t"


def inline_sql(c: str) -> str:
    out = f"regexp_replace(regexp_replace({c}, '[{_SP}]+', ' ', 'g'), '[-_]{{3,}}', '', 'g')"
    for shape, plain in lex.SHAPES.items():
        out = f"replace({out}, '{shape}', '{plain}')"
    return strip_sql(rf"regexp_replace({out}, '[\x{{200B}}\x{{200C}}\x{{200D}}\x{{FEFF}}]', '', 'g')")


@query(f"""SELECT id, {joined_sql('text')} AS joined, {inline_sql('text')} AS inline,
CASE WHEN {count_sql('text', _AR)} > 0.2 * length(text) THEN 'ar' ELSE 'en' END AS display_language FROM {_BLOCKS}""")
def block_text(spark, sf_dir):
    blocks = docs_of(spark, sf_dir).select("id", F.replace("text", F.lit(". "), F.lit(".\n")).alias("text"))
    c, more = F.col("text"), spark.createDataFrame([(-i, x) for i, x in enumerate(BLOCKS, 1)], "id long, text string")
    return blocks.unionByName(more).select("id", T.join_broken_lines(c).alias("joined"), T.clean_inline(c).alias("inline"), T.display_language(c).alias("display_language"))


@query(f"SELECT doc_id AS id, text LIKE '%http%' AS has_url, len({words_sql('text')}) AS word_count, CASE WHEN length(regexp_replace(text, '[^؀-ۿ]', '', 'g')) > 0.2 * length(text) THEN 'ar' ELSE 'en' END AS display_language FROM documents")
def word_stats(spark, sf_dir):
    c = F.col("text")
    return docs_of(spark, sf_dir).select("id", T.has_url(c).alias("has_url"), F.size(T.words(c)).cast("long").alias("word_count"), T.display_language(c).alias("display_language"))


def _search(spark, sf_dir, k=3):
    rows = all_docs(spark, sf_dir)
    index, docs = R.bm25_index(rows), rows.select("id", "text", "source", F.col("lang").alias("section"))
    return lambda asked: R.with_texts(R.bm25_search(index, asked, k).select("query_id", "id", "rank"), docs)


def plain_sql(c: str) -> str:
    """Dialect in standard form, rule after rule; each is applied twice, as words share the blanks between them."""
    rules = ", ".join(f"{{'t': '', 'p': '(?i)(^|[^{_W}]){word}($|[^{_W}])', 'v': '\\1{plain}\\2'}}" for word, plain in lex.DIALECT.items())
    once = "regexp_replace({}, e.p, e.v, 'g')"
    return f"list_reduce([{rules}], lambda s, e: {{'t': {once.format(once.format('s.t'))}, 'p': '', 'v': ''}}, {{'t': {c}, 'p': '', 'v': ''}}).t"


def twice_sql(questions: str, k: int = 3) -> str:
    """CTEs up to hits (query_id, rank, text, source, section) of questions in plain words, or as they were put if that finds nothing."""
    return f"""WITH asked AS MATERIALIZED (SELECT query_id, text, {language_sql('text')} AS language, CASE WHEN {language_sql('text')} = 'ar' THEN {plain_sql('text')} ELSE text END AS plain FROM {questions}),
both_ways AS (SELECT {{'q': query_id, 'way': 1}} AS query_id, plain AS text FROM asked UNION ALL SELECT {{'q': query_id, 'way': 2}}, text FROM asked WHERE plain <> text),
{bm25_sql(k, _DOCS, 'both_ways').removeprefix('WITH ').rstrip()},
hits AS MATERIALIZED (SELECT s.query_id.q AS query_id, s.rank, d.text, d.source, d.lang AS section FROM sparse s JOIN {_DOCS} d ON d.id = s.id WHERE s.query_id.way = 1 OR s.query_id.q NOT IN (SELECT z.query_id.q FROM sparse z WHERE z.query_id.way = 1)),
best AS (SELECT query_id, count(*) AS n, arg_min(text, rank) AS top_text, arg_min(source, rank) AS top_source, string_agg(text, repeat(chr(10), 2) ORDER BY rank) FILTER (WHERE rank <= 2) AS body FROM hits GROUP BY query_id),
named AS (SELECT query_id, string_agg(CASE WHEN section <> 'general' THEN source || ' - ' || section ELSE source END, chr(10) ORDER BY r) AS sources FROM (SELECT query_id, source, section, min(rank) AS r FROM hits GROUP BY query_id, source, section) GROUP BY query_id)
"""


def say_sql(texts: dict[str, str]) -> str:
    return f"CASE WHEN language = 'ar' THEN {quoted(texts['ar'])} ELSE {quoted(texts['en'])} END"


@query(twice_sql(_QUERIES) + f"""SELECT query_id, CASE WHEN n IS NULL THEN {say_sql(A.APOLOGY)} ELSE {strip_sql(f"({say_sql(A.LEAD)}) || repeat(chr(10), 2) || body")} END AS answer, sources, language, CAST(coalesce(n, 0) AS BIGINT) AS chunks_found
FROM asked LEFT JOIN best USING (query_id) LEFT JOIN named USING (query_id)""")
def retrieval_answers(spark, sf_dir):
    return A.retrieval_answer(all_queries(spark, sf_dir), _search(spark, sf_dir))


@query(twice_sql(_QUERIES) + f"""SELECT query_id, concat_ws(chr(10), CASE WHEN n IS NULL THEN {say_sql(A.APOLOGY)} ELSE top_text || chr(10) || 'Source: ' || top_source END, nullif(sources, ''), CASE WHEN n > 0 THEN '[Retrieved ' || n || ' relevant sections]' END) AS display
FROM asked LEFT JOIN best USING (query_id) LEFT JOIN named USING (query_id)""")
def model_answers(spark, sf_dir):
    asked = all_queries(spark, sf_dir).withColumn("recent", F.array().cast(A.EXCHANGES))
    return A.format_answer(A.answer(asked, _search(spark, sf_dir)))


_BATCH = "(SELECT query_id * 10 + j AS query_id, text FROM " + _QUERIES + " AS b, unnest([0, 1, 2]) AS t(j))"
_HISTORY = "abs(query_id) % 10 = 1"


def _model(messages):
    """A stand-in for a model that thinks aloud, answers from all of the messages, and sometimes too shortly."""
    last, n = F.get(messages, F.size(messages) - 1)["content"], F.size(messages).cast("string")
    return F.when(F.length(last) % 5 == 0, F.lit("<think>a\nb</think> no ")).otherwise(F.concat(F.lit("<think>hm</think>Said "), F.md5(last), F.lit(" of "), n))


@query(twice_sql(_BATCH).rstrip() + f""",
ctx AS (SELECT query_id, string_agg('[' || rank || '] ' || source || CASE WHEN section <> 'general' THEN ' - ' || section ELSE '' END || chr(10) || text, chr(10) || '---' || chr(10) ORDER BY rank) AS context FROM hits GROUP BY query_id),
kd AS (SELECT a.query_id, a.language, coalesce(n, 0) AS n, CASE WHEN n > 0 AND NOT ({_HISTORY.replace("query_id", "a.query_id")}) THEN md5(a.text || '||' || substr(top_text, 1, 200)) END AS key, -a.query_id AS seq, 'Context:' || chr(10) || coalesce(context, '') || chr(10) || chr(10) || 'Question: ' || a.text AS prompt,
CASE WHEN n IS NULL THEN {say_sql(A.APOLOGY)} ELSE top_text || chr(10) || 'Source: ' || top_source END AS first FROM asked a LEFT JOIN best ON best.query_id = a.query_id LEFT JOIN ctx ON ctx.query_id = a.query_id),
fr AS (SELECT *, key IS NOT NULL AND row_number() OVER (PARTITION BY key ORDER BY seq) > 1 AS cached, CASE WHEN length(prompt) % 5 = 0 THEN first ELSE 'Said ' || md5(prompt) || ' of ' || CASE WHEN {_HISTORY} THEN 4 ELSE 2 END END AS fresh FROM kd)
SELECT query_id, CASE WHEN key IS NULL THEN fresh ELSE first_value(fresh) OVER (PARTITION BY key ORDER BY seq) END AS answer, cached, key, CAST(n AS BIGINT) AS chunks_found FROM fr""")
def answers_in_order(spark, sf_dir):
    """Each question three times in a batch, once with a history, with a model and a cache that the batch fills."""
    rows = all_queries(spark, sf_dir).select(F.explode(F.array(*(F.col("query_id") * 10 + j for j in range(3)))).alias("query_id"), "text")
    before = F.array(F.struct(F.lit("u").alias("user"), F.lit("a").alias("assistant")))
    asked = rows.withColumns({"seq": -F.col("query_id"), "recent": F.when(F.expr(_HISTORY), before).otherwise(F.array().cast(A.EXCHANGES))})
    return A.answer_in_order(asked, _search(spark, sf_dir), _model).select("query_id", "answer", "cached", "key", "chunks_found")


_CANNED = ", ".join(f"({quoted(i)}, {quoted(x)}, {'NULL' if h is None else str(h).upper()}, {quoted(t)})" for i, x, h, t in replies.CANNED)


@query(f"""WITH routed AS MATERIALIZED (SELECT conv_id, turn, text, conv_id || ':' || turn AS query_id, {command_sql('t')} AS command, {switch_sql('t')} AS switch, {language_sql('text')} AS language, {intent_sql('t')} AS intent FROM (SELECT *, {strip_sql('lower(text)')} AS t FROM {_TURNS} WHERE role = 'user')),
told AS (SELECT *, coalesce(sum(CASE WHEN command = 'clear' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS session FROM routed),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, session ORDER BY turn) > 1 AS has_history FROM told WHERE command IS NULL),
canned(intent, language, fits, reply) AS (VALUES {_CANNED}),
{bm25_sql(3, _DOCS, "(SELECT query_id, text FROM seen WHERE intent = 'in_scope')").removeprefix('WITH ').rstrip()},
best AS (SELECT query_id, count(*) AS n, arg_min(d.text, rank) || chr(10) || 'Source: ' || arg_min(d.source, rank) AS found FROM sparse JOIN {_DOCS} d ON d.id = sparse.id GROUP BY query_id),
said AS (SELECT seen.*, CASE WHEN seen.intent = 'in_scope' THEN coalesce(found, 'No answer was found.') ELSE reply END AS said, coalesce(n, 0) AS n FROM seen LEFT JOIN best USING (query_id) LEFT JOIN canned c ON c.intent = seen.intent AND c.language = seen.language AND (c.fits IS NULL OR c.fits = has_history)),
lasts AS (SELECT *, last_value(CASE WHEN intent NOT IN ('greeting', 'acknowledgment', 'out_of_scope', 'language_switch') THEN said END IGNORE NULLS) OVER (PARTITION BY conv_id, session ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM said)
SELECT conv_id, turn, intent, language, CASE WHEN intent = 'language_switch' THEN coalesce(last, {quoted(replies.NOTHING_TO_TRANSLATE)}) ELSE said END AS answer, CAST(n AS BIGINT) AS chunks_found FROM lasts""")
def conversation_replies(spark, sf_dir):
    return replies.reply(all_turns(spark, sf_dir).where("role = 'user'"), _search(spark, sf_dir))


@query(SQL["conversation_replies"])
def conversation_replies_streamed(spark, sf_dir):
    """The turns as a stream that brings a third of each conversation's turn numbers at a time and starts anew for each."""
    turns = all_turns(spark, sf_dir).where("role = 'user'").select("conv_id", "turn", "text")
    low, high = turns.agg(F.min("turn"), F.max("turn")).first()
    source, out, state = (new_path(spark, x) for x in ("turns", "replies", "loop"))
    search, step = _search(spark, sf_dir), ((high or 0) - (low or 0)) // 3 + 1
    for at in range(low or 0, (high or 0) + 1, step):
        turns.where(F.col("turn").between(at, at + step - 1)).write.mode("append").parquet(source)
        loop.start(spark.readStream.schema(turns.schema).parquet(source), search, out, state).awaitTermination()
    return loop.read(spark, out)


#: Letters whose counts stand in for a model's vector, whole numbers being exact in both engines.
_LETTERS = "aeinorstlااليمنر"


def letter_counts(rows: DataFrame) -> DataFrame:
    low = F.lower("text")
    return rows.withColumn("embedding", F.array(*[(F.length(low) - F.length(F.replace(low, F.lit(x), F.lit("")))).cast("float") for x in _LETTERS]))


_COUNTS = "[" + ", ".join(f"length(lower(text)) - length(replace(lower(text), '{x}', ''))" for x in _LETTERS) + "]"
_WITH_HEADING = "CASE WHEN heading IS NOT NULL AND heading <> '' AND NOT contains({c}, heading) THEN heading || chr(10) || {c} ELSE {c} END"
_ROWS_FOLD = "STRUCT(done VARCHAR[], cur VARCHAR, n BIGINT, x VARCHAR, w BIGINT)"
_ROWS_STEP = "CASE WHEN s.cur = '' THEN {'done': s.done, 'cur': e.x, 'n': e.w, 'x': '', 'w': 0} WHEN s.n + e.w > 150 THEN {'done': list_append(s.done, s.cur), 'cur': e.x, 'n': e.w, 'x': '', 'w': 0} ELSE {'done': s.done, 'cur': s.cur || chr(10) || e.x, 'n': s.n + e.w, 'x': '', 'w': 0} END"


@query(f"""WITH cleaned AS (SELECT id AS doc, {clean_sql('text')} AS text FROM {_DOCS}),
lines AS (SELECT doc, i, ls[i] AS line FROM (SELECT doc, string_split(text, chr(10)) AS ls FROM cleaned), unnest(range(1, len(ls) + 1)) AS t(i) WHERE {strip_sql('ls[i]')} <> ''),
kinds AS (SELECT doc, i, CASE WHEN regexp_matches(line, '^\\[H[1-6]\\]') THEN 'heading' WHEN starts_with(line, '[TABLE] ') THEN 'table' ELSE 'prose' END AS kind, line FROM lines),
bodies AS (SELECT doc, i, kind, CASE kind WHEN 'heading' THEN {strip_sql("regexp_replace(line, '^\\[H[1-6]\\]', '')")} WHEN 'table' THEN {strip_sql("substr(line, 9)")} ELSE line END AS body FROM kinds),
heads AS (SELECT *, sum(CAST(kind = 'heading' AS INT)) OVER w AS h, last_value(CASE WHEN kind = 'heading' THEN body END IGNORE NULLS) OVER w AS heading FROM bodies WINDOW w AS (PARTITION BY doc ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
changes AS (SELECT *, CASE WHEN lag(kind) OVER w = kind AND lag(h) OVER w = h THEN 0 ELSE 1 END AS c FROM heads WHERE kind <> 'heading' WINDOW w AS (PARTITION BY doc ORDER BY i)),
runs AS MATERIALIZED (SELECT *, CAST(sum(c) OVER (PARTITION BY doc ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS rn FROM changes),
prose AS (SELECT {{'doc': doc, 'rn': rn}} AS run, any_value(heading) AS heading, string_agg(body, chr(10) ORDER BY i) AS text, list(body ORDER BY i) AS ls FROM runs WHERE kind = 'prose' GROUP BY doc, rn),
qa AS (SELECT run, j, ls[j] AS line FROM prose, unnest(range(1, len(ls) + 1)) AS t(j) WHERE regexp_matches(text, '(?im)^(س:|ج:|Q:|A:)')),
islands AS (SELECT run, j, line, sum(CAST(regexp_matches(line, '(?i)^(س:|Q:)') AS INT)) OVER (PARTITION BY run ORDER BY j) AS n FROM qa),
pairs AS (SELECT run, n AS unit, string_agg(line, ' ' ORDER BY j) AS text FROM islands GROUP BY run, n),
units AS (SELECT run, unit, text FROM pairs WHERE length({strip_sql('text')}) > 5 UNION ALL SELECT run, j, ss[j] FROM (SELECT run, {sentences_sql('text')} AS ss FROM prose WHERE NOT regexp_matches(text, '(?im)^(س:|ج:|Q:|A:)')), unnest(range(1, len(ss) + 1)) AS t(j)),
{groups_sql(f"SELECT run, unit, text, {_COUNTS} AS embedding FROM units").rstrip()}, {chunks_sql().rstrip()},
prosed AS (SELECT c.run.doc AS doc, c.run.rn AS rn, 0 AS part, c.i, 'prose' AS kind, {strip_sql('c.text')} AS text, heading FROM chunks c JOIN prose ON prose.run = c.run),
titles AS (SELECT *, {strip_sql("split_part(body, ' — ', 1)")} AS title FROM runs WHERE kind = 'table' AND body <> ''),
parted AS (SELECT *, CASE WHEN lag(title) OVER (PARTITION BY doc, rn ORDER BY i) <> title THEN 1 ELSE 0 END AS pc FROM titles),
parts AS (SELECT *, CAST(sum(pc) OVER (PARTITION BY doc, rn ORDER BY i) AS INT) AS part FROM parted),
packed AS (SELECT doc, rn, part, any_value(heading) AS heading, list_reduce(list(CAST({{'done': [], 'cur': '', 'n': 0, 'x': body, 'w': len({words_sql('body')})}} AS {_ROWS_FOLD}) ORDER BY i), lambda s, e: CAST({_ROWS_STEP} AS {_ROWS_FOLD}), CAST({{'done': [], 'cur': '', 'n': 0, 'x': '', 'w': 0}} AS {_ROWS_FOLD})) AS s FROM parts GROUP BY doc, rn, part),
tabled AS (SELECT doc, rn, part, CAST(j - 1 AS INT) AS i, 'table' AS kind, cs[j] AS text, heading FROM (SELECT *, list_append(s.done, s.cur) AS cs FROM packed), unnest(range(1, len(cs) + 1)) AS t(j)),
headed AS (SELECT doc, rn, part, i, kind, {_WITH_HEADING.format(c='text')} AS text FROM (SELECT * FROM prosed UNION ALL SELECT * FROM tabled)),
numbered AS (SELECT doc, kind, text, CAST(row_number() OVER (PARTITION BY doc ORDER BY rn, part, i) - 1 AS INT) AS chunk_index, count(*) OVER (PARTITION BY doc) AS total_chunks FROM headed WHERE length({strip_sql('text')}) > 40)
SELECT doc || '_' || chunk_index AS id, doc, chunk_index, total_chunks, kind, text, CAST(doc AS VARCHAR) AS source, {section_sql('text')} AS section, {chunk_type_sql('text', 'kind')} AS chunk_type,
CASE WHEN {count_sql('text', _AR)} > {count_sql('text', 'A-Za-z')} THEN 'ar' WHEN {count_sql('text', 'A-Za-z')} > {count_sql('text', _AR)} THEN 'en' ELSE 'mixed' END AS language,
contains(text, 'http') AS has_url, CAST(len({words_sql('text')}) AS INT) AS word_count, CAST({count_sql('text', _AR)} AS INT) AS arabic_letters, CAST({count_sql('text', 'A-Za-z')} AS INT) AS latin_letters FROM numbered""")
def structured_chunks(spark, sf_dir):
    docs = all_docs(spark, sf_dir).select(F.col("id").alias("doc"), T.clean(F.col("text")).alias("text"))
    return corpus.enrich(corpus.build_chunks(corpus.tagged_lines(docs), letter_counts))


@query(_GROUPS + "SELECT run, unit, round(sim, 6) AS sim, sim < threshold AS breaks FROM g WHERE sim IS NOT NULL")
def breakpoints(spark, sf_dir):
    return C.semantic_groups(_units(spark, sf_dir)).where("sim is not null").select("run", "unit", F.round("sim", 6).alias("sim"), (F.col("sim") < F.col("threshold")).alias("breaks"))


@query("WITH " + groups_sql(f"SELECT 1 AS run, doc_id AS unit, text, {_COUNTS} AS embedding FROM documents") + 'SELECT unit, round(sim, 6) AS sim, round(threshold, 6) AS threshold, CAST(sum(b) OVER (ORDER BY unit) AS BIGINT) AS "group" FROM g')
def semantic_groups_one_run(spark, sf_dir):
    """All texts as the units of one run, in many ranges, its percentile by passes of histograms."""
    units = letter_counts(docs_of(spark, sf_dir).select(F.lit(1).alias("run"), F.col("id").alias("unit"), "text")).drop("text")
    return C.semantic_groups(units, ranges=ranges_of(spark)).select("unit", F.round("sim", 6).alias("sim"), F.round("threshold", 6).alias("threshold"), "group")


@query()
def lsa_vectors(spark, sf_dir):
    """Vectors of all texts by latent semantic analysis, fitted to them."""
    docs = docs_of(spark, sf_dir).select("id", "text")
    return lsa.fit_encode(docs).select("id", "embedding")


@query()
def semantic_groups_fitted(spark, sf_dir):
    """Semantic groups of all texts of a source, by their fitted vectors."""
    docs = docs_of(spark, sf_dir).select("id", "text", "source")
    units = lsa.fit_encode(docs).select(F.col("source").alias("run"), F.col("id").alias("unit"), "embedding")
    return C.semantic_groups(units, ranges=ranges_of(spark)).select("run", "unit", F.round("sim", 6).alias("sim"), F.round("threshold", 6).alias("threshold"), "group")


def docx_file() -> bytes:
    """A file with a heading, a paragraph and a table one of whose cells stands for the one above."""
    p = lambda t, style="": f"<w:p>{style}<w:r><w:t>{t}</w:t></w:r></w:p>"
    row = lambda *cells: "<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in cells) + "</w:tr>"
    table = row("Name", "Fee (EGP)", "Years") + row("Law", "50", "4") + row("—", "60", "-")
    head = p("Fees", '<w:pPr><w:pStyle w:val="Heading 1"/></w:pPr>')
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{head}{p("All fees are  paid once a year.")}<w:tbl>{table}</w:tbl></w:body></w:document>')
    return out.getvalue()


def pdf_file(*shown: tuple[int, int, str]) -> bytes:
    """A file of one page with texts at places, from the lower left."""
    text = "\n".join(f"BT /F1 10 Tf 1 0 0 1 {x} {y} Tm ({t}) Tj ET" for x, y, t in shown).encode()
    objects = ("<</Type/Catalog/Pages 2 0 R>>", "<</Type/Pages/Kids[4 0 R]/Count 1/MediaBox[0 0 600 800]/Resources<</Font<</F1 3 0 R>>>>>>", "<</Type/Font/Subtype/Type1>>", "<</Type/Page/Parent 2 0 R/Contents 5 0 R>>")
    body = "".join(f"{n} 0 obj\n{x}\nendobj\n" for n, x in enumerate(objects, 1)).encode()
    return b"%PDF-1.4\n" + body + b"5 0 obj\n<</Length %d>>\nstream\n%s\nendstream\nendobj\ntrailer<</Root 1 0 R>>" % (len(text), text)


_SAID = ("The library is open through all of the night.", "Readers may stay until the first lesson begins.")
_FILES = (
    ("f/fees.docx", docx_file),
    ("f/prose.pdf", lambda: pdf_file((50, 700, _SAID[0]), (50, 660, _SAID[1]))),
    ("f/table.pdf", lambda: pdf_file((50, 700, "Name of school"), (250, 700, "Fee  a  year"), (50, 680, "Law and art"), (250, 680, "50 coins"), (50, 640, "End of it."))),
    ("f/image.pdf", lambda: pdf_file((50, 700, "x"))),
    ("f/broken.pdf", lambda: b"junk"),
)
_LINES = (
    ("fees", 0, "heading", "Fees"), ("fees", 1, "prose", "All fees are paid once a year."), ("fees", 3, "table", "Law — Fee: 50، Years: 4"), ("fees", 4, "table", "Law — Fee: 60، Years: 4"),
    ("prose", 0, "prose", "[صفحة 1 / Page 1]"), ("prose", 1, "prose", _SAID[0]), ("prose", 2, "prose", _SAID[1]),
    ("table", 0, "prose", "[صفحة 1]"), ("table", 1, "prose", "Name of school | Fee a year"), ("table", 2, "prose", "Law and art | 50 coins"), ("table", 3, "prose", "Name of school Fee a year"), ("table", 4, "prose", "Law and art 50 coins"), ("table", 5, "prose", "End of it."),
)


@query("SELECT * FROM (VALUES " + ", ".join(f"('{d}', CAST({n} AS INT), '{k}', {quoted(b)})" for d, n, k, b in _LINES) + ") AS v(doc, line_no, kind, body)")
def file_lines(spark, sf_dir):
    files = spark.createDataFrame([(path, path.rsplit(".", 1)[1], make()) for path, make in _FILES], "path string, ext string, content binary")
    return folder.parse(files)[0].select("doc", F.col("line_no").cast("int").alias("line_no"), "kind", "body")


@query("SELECT * FROM (VALUES ('fees.docx', 'docx'), ('prose.pdf', 'blocks'), ('table.pdf', 'fallback'), ('image.pdf', 'image_only'), ('broken.pdf', 'failed')) AS v(filename, method)")
def file_methods(spark, sf_dir):
    files = spark.createDataFrame([(path, path.rsplit(".", 1)[1], make()) for path, make in _FILES], "path string, ext string, content binary")
    _, read, skipped = folder.parse(files)
    return read.select("filename", F.col("extraction_method").alias("method")).unionByName(skipped.select("filename", F.substring_index("reason", ":", 1).alias("method")))
