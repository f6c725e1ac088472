"""All queries of the retrieval engine by name, each beside the SQL that gives the same rows.

The driver's tables stand in for a wiki: documents are pages (source is the space, the first 60 characters of the
first line the title), labels.toxic marks restricted pages, embeddings are dense vectors, benchmark items are questions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import folds
from ..functions import text as T
from ..functions.vectors import cosine
from ..operators import answer as A
from ..operators import chunk as C
from ..operators import evaluate as E
from ..operators import extract, parse, rerank, search, state, sync
from ..operators import index as I
from ..sources.files import dropped, materialised, read_jsonl, shared_folder, table
from ..streaming import events as S

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


# Shared inputs and their SQL.

TITLE = "substr(split_part(text, chr(10), 1), 1, 60)"
PAGES_SQL = f"(SELECT doc_id::VARCHAR AS page_id, source AS space_key, {TITLE} AS title, text, lang, doc_id FROM documents)"
HASH_SQL = "sha256(trim(title, ' ' || chr(10)) || chr(10) || text)"
TERMS_SQL = r"regexp_extract_all(lower(coalesce({}, '')), '[\p{{L}}\p{{N}}]+')"


def terms_sql(c: str) -> str:
    return TERMS_SQL.format(c)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    title = F.substring(F.split_part("text", F.lit("\n"), F.lit(1)), 1, 60)
    return d.select(F.col("doc_id").cast("string").alias("page_id"), F.col("source").alias("space_key"), title.alias("title"), "text", "lang", "doc_id")


def state_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pages(spark, sf_dir)
    url = F.concat(F.lit("https://wiki.example/"), F.col("page_id"))
    return p.withColumn("content_hash", T.content_hash(F.col("title"), F.col("text"))).select("page_id", "content_hash", F.col("lang").alias("last_modified"), "space_key", "title", url.alias("url"), "doc_id")


STATE_SQL = f"(SELECT page_id, {HASH_SQL} AS content_hash, lang AS last_modified, space_key, title, 'https://wiki.example/' || page_id AS url, doc_id FROM {PAGES_SQL} p)"


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))


# Text functions.


@query(f"SELECT page_id, {HASH_SQL} AS content_hash, substr({HASH_SQL}, 1, 12) AS preview FROM {PAGES_SQL} p")
def content_hash(spark, sf_dir):
    h = T.content_hash(F.col("title"), F.col("text"))
    return pages(spark, sf_dir).select("page_id", h.alias("content_hash"), T.hash_preview(h).alias("preview"))


@query("SELECT doc_id, greatest(1, ceil(length(text) / 4.0))::INTEGER AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


_H = "sha1(unhex('6f8e2b0a1c3d4e5f8a9b0c1d2e3f4a5b') || (doc_id::VARCHAR || ':0')::BLOB)"


@query(
    f"""SELECT doc_id, doc_id::VARCHAR || ':0' AS chunk_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' ||
    lower(hex(((('0x' || substr(h, 17, 2))::INTEGER & 63) | 128)::UTINYINT)) || substr(h, 19, 2) || '-' || substr(h, 21, 12) AS point_id FROM (SELECT doc_id, {_H} AS h FROM documents)"""
)
def point_id(spark, sf_dir):
    key = T.chunk_id(F.col("doc_id"), F.lit(0))
    return table(spark, sf_dir, "documents").select("doc_id", key.alias("chunk_id"), T.point_id(key).alias("point_id"))


@query(f"SELECT page_id, array_to_string(list_filter([space_key, '', lang, title], lambda x: x <> ''), ' > ') AS breadcrumb, array_to_string(list_filter([space_key, '', lang, title], lambda x: x <> ''), ' > ') || chr(10) || chr(10) || text AS chunk_text FROM {PAGES_SQL} p")
def breadcrumb(spark, sf_dir):
    crumb = T.breadcrumb(F.col("space_key"), F.array(F.lit(""), F.col("lang")), F.col("title"))
    return pages(spark, sf_dir).select("page_id", crumb.alias("breadcrumb"), T.chunk_text(crumb, F.col("text")).alias("chunk_text"))


@query("SELECT page_id, rtrim(CASE WHEN page_id % 3 = 0 THEN '' ELSE regexp_extract(url, '^[^/]*//[^/]*/') || '/' END, '/') || CASE WHEN page_id % 5 = 0 THEN '' ELSE '/display/' || page_id::VARCHAR END AS url FROM pages")
def build_url(spark, sf_dir):
    base = F.when(F.col("page_id") % 3 == 0, F.lit(None)).otherwise(F.concat(F.regexp_extract("url", "^[^/]*//[^/]*/", 0), F.lit("/")))
    web = F.when(F.col("page_id") % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("/display/"), F.col("page_id").cast("string")))
    return table(spark, sf_dir, "pages").select("page_id", T.page_url(base, web).alias("url"))


_BODY = "regexp_extract(html, '(?is)<body[^>]*>(.*)$', 1)"
for _p in ("(?is)<script[^>]*>.*?</script>", "(?is)<style[^>]*>.*?</style>", "(?is)<noscript[^>]*>.*?</noscript>", "(?is)<template[^>]*>.*?</template>", "(?s)<!--.*?-->", "<[^>]*>"):
    _BODY = f"regexp_replace({_BODY}, '{_p}', ' ', 'g')"
for _e, _t in (("copy", "©"), ("middot", "·"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("nbsp", " "), ("amp", "&")):
    _BODY = f"replace({_BODY}, '&{_e};', '{_t}')"


@query(f"SELECT page_id, trim(regexp_replace({_BODY}, '\\s+', ' ', 'g')) AS text FROM pages")
def html_to_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.html_text(F.col("html")).alias("text"))


@query("SELECT doc_id, list_filter([source, CASE WHEN doc_id % 2 = 0 THEN lang ELSE '' END, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'page' END], lambda x: x IS NOT NULL AND x <> '')::VARCHAR AS labels, len(list_filter([source, CASE WHEN doc_id % 2 = 0 THEN lang ELSE '' END], lambda x: x <> ''))::INTEGER AS n_ancestors FROM documents")
def labels_and_ancestors(spark, sf_dir):
    one = lambda c, f: F.struct(c.alias(f))
    even = F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise(F.lit(""))
    labels = F.array(one(F.col("source"), "name"), one(even, "name"), one(F.when(F.col("doc_id") % 3 != 0, F.lit("page")), "name"))
    ancestors = F.array(one(F.col("source"), "title"), one(even, "title"))
    shown = F.concat(F.lit("["), F.array_join(T.names(labels, "name"), ", "), F.lit("]"))
    return table(spark, sf_dir, "documents").select("doc_id", shown.alias("labels"), F.size(T.names(ancestors, "title")).alias("n_ancestors"))


@query("SELECT doc_id, list_filter(list_transform(string_split(source || ' , ' || lang || ',, x ', ','), lambda x: trim(x)), lambda x: x <> '')::VARCHAR AS parts FROM documents")
def comma_lists(spark, sf_dir):
    parts = T.comma_list(F.concat(F.col("source"), F.lit(" , "), F.col("lang"), F.lit(",, x ")))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("["), F.array_join(parts, ", "), F.lit("]")).alias("parts"))


@query(r"SELECT doc_id, len(list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> ''))::INTEGER AS sentences FROM documents")
def sentence_split(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.sentences(F.col("text"))).alias("sentences"))


@query(r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM documents")
def whitespace_normalise(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.normalise(F.col("text")).alias("text"))


# Extraction: nested rows to pages.


def raw_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in the nested shape of a wiki's pages."""
    p = pages(spark, sf_dir)
    s = lambda **k: F.struct(*(v.alias(n) for n, v in k.items()))
    return p.select(
        F.col("page_id").alias("id"),
        F.lit("page").alias("type"),
        F.when(F.col("doc_id") % 10 == 0, "draft").otherwise("current").alias("status"),
        "title",
        s(key=F.col("space_key")).alias("space"),
        s(when=F.concat(F.lit("2026-09-"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0"), F.lit("T10:00:00.000Z")), by=s(displayName=F.when(F.col("doc_id") % 4 != 0, F.col("lang")))).alias("version"),
        F.array(s(title=F.lit("Home")), s(title=F.col("lang"))).alias("ancestors"),
        s(labels=s(results=F.array(s(name=F.col("lang")), s(name=F.lit(""))))).alias("metadata"),
        s(view=s(value=F.concat(F.lit("<h1>"), F.col("title"), F.lit("</h1><p>"), F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</p>")))).alias("body"),
        s(base=F.lit("https://wiki.example/"), webui=F.concat(F.lit("/display/"), F.col("page_id"))).alias("_links"),
    )


_TEXT = r"trim(regexp_replace(title || ' ' || text, '\s+', ' ', 'g'))"


@query(
    f"""SELECT page_id, space_key, title, 'https://wiki.example/display/' || page_id AS url, '[' || lang || ']' AS labels, CASE WHEN doc_id % 4 <> 0 THEN lang ELSE '' END AS author,
    '2026-09-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') || 'T10:00:00.000Z' AS last_modified, space_key || ' > Home > ' || lang || CASE WHEN title <> '' THEN ' > ' || title ELSE '' END AS breadcrumb,
    {_TEXT} AS text, sha256(trim(title, ' ' || chr(10)) || chr(10) || {_TEXT}) AS content_hash FROM {PAGES_SQL} p"""
)
def extract_pages(spark, sf_dir):
    p = extract.extract_pages(raw_pages(spark, sf_dir))
    labels = F.concat(F.lit("["), F.array_join("labels", ", "), F.lit("]"))
    return p.select("page_id", "space_key", "title", "url", labels.alias("labels"), "author", "last_modified", "breadcrumb", "text", "content_hash")


@query(f"SELECT page_id, title FROM {PAGES_SQL} p WHERE doc_id % 10 <> 0")
def current_pages(spark, sf_dir):
    return sync.current_pages(raw_pages(spark, sf_dir)).select(F.col("id").alias("page_id"), "title")


@query("SELECT doc_id::VARCHAR AS page_id FROM labels WHERE toxic = 1")
def restricted_pages(spark, sf_dir):
    hit = F.col("toxic") == 1
    some = lambda on: F.struct(F.when(on, 1).otherwise(0).alias("size"), F.array().cast("array<string>").alias("results"))
    named = F.struct(F.lit(0).alias("size"), F.when(hit & (F.col("doc_id") % 2 == 1), F.array(F.lit("ops"))).otherwise(F.array().cast("array<string>")).alias("results"))
    wrapped = F.when(F.col("doc_id") % 3 == 0, F.struct(some(hit & (F.col("doc_id") % 2 == 0)).alias("user"), named.alias("group")))
    r = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("page_id"), wrapped.alias("restrictions"), some(hit & (F.col("doc_id") % 2 == 0)).alias("user"), named.alias("group"))
    return extract.restricted_pages(r)


# Scans.


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1996-06-01' AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
def delta_scan(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumnsRenamed({"o_orderpriority": "space_key", "o_orderdate": "last_modified"})
    found = sync.changed_since(o, "1996-06-01", ["1-URGENT", "2-HIGH"])
    return found.select("o_orderkey", F.date_format("last_modified", "yyyy-MM-dd HH:mm:ss").alias("o_orderdate"))


@query(f"SELECT page_id, title FROM {PAGES_SQL} p WHERE space_key IN ('src0', 'src3')")
def allowlist_scan(spark, sf_dir):
    return sync.in_spaces(pages(spark, sf_dir), ["src0", "src3"]).select("page_id", "title")


@query(f"SELECT page_id, title, text FROM {PAGES_SQL} p WHERE page_id IN ('7', '42')")
def point_lookup(spark, sf_dir):
    return sync.with_ids(pages(spark, sf_dir), ["7", "42"]).select("page_id", "title", "text")


# Sync, state and index.


def known_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an earlier run has recorded: four in five pages, one in seven of them since edited."""
    old = F.when(F.col("doc_id") % 7 == 0, F.sha2("content_hash", 256)).otherwise(F.col("content_hash"))
    return state_pages(spark, sf_dir).where("doc_id % 5 <> 0").withColumn("content_hash", old)


KNOWN_SQL = f"(SELECT page_id, CASE WHEN doc_id % 7 = 0 THEN sha256(content_hash) ELSE content_hash END AS content_hash, last_modified, space_key, title, url, doc_id FROM {STATE_SQL} s WHERE doc_id % 5 <> 0)"
RESTRICTED_SQL = "(SELECT doc_id::VARCHAR AS page_id FROM labels WHERE toxic = 1)"
OUTCOME_SQL = f"""(SELECT s.*, CASE WHEN r.page_id IS NOT NULL THEN 'restricted' WHEN k.content_hash = s.content_hash THEN 'unchanged' ELSE 'indexed' END AS outcome
FROM {STATE_SQL} s LEFT JOIN {RESTRICTED_SQL} r ON s.page_id = r.page_id LEFT JOIN {KNOWN_SQL} k ON s.page_id = k.page_id)"""


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    restricted = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").cast("string").alias("page_id"))
    return sync.outcomes(state_pages(spark, sf_dir), restricted, known_state(spark, sf_dir))


@query(f"SELECT page_id, outcome FROM {OUTCOME_SQL} o")
def hash_gate(spark, sf_dir):
    return judged(spark, sf_dir).select("page_id", "outcome")


@query(
    f"""SELECT count(*) AS seen, count_if(outcome = 'indexed')::BIGINT AS indexed, count_if(outcome = 'restricted')::BIGINT AS skipped_restricted,
    count_if(outcome = 'unchanged')::BIGINT AS skipped_unchanged, 0::BIGINT AS deleted, 0::BIGINT AS errors FROM {OUTCOME_SQL} o"""
)
def full_sync_stats(spark, sf_dir):
    return sync.stats(judged(spark, sf_dir))


_COLUMNS = "page_id, content_hash, last_modified, space_key, title, url"
_UPSERT = f"SELECT {_COLUMNS} FROM {KNOWN_SQL} k WHERE page_id NOT IN (SELECT page_id FROM {OUTCOME_SQL} o WHERE outcome = 'indexed') UNION ALL SELECT {_COLUMNS} FROM {OUTCOME_SQL} o WHERE outcome = 'indexed'"


@query(_UPSERT)
def state_upsert(spark, sf_dir):
    changed = sync.state_rows(judged(spark, sf_dir).where("outcome = 'indexed'"))
    return state.upserted(sync.state_rows(known_state(spark, sf_dir)), changed)


@query(f"SELECT {_COLUMNS} FROM {KNOWN_SQL} k WHERE page_id NOT IN (SELECT page_id FROM {RESTRICTED_SQL} r)")
def state_delete(spark, sf_dir):
    gone = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").cast("string").alias("page_id"))
    return state.deleted(sync.state_rows(known_state(spark, sf_dir)), gone)


@query(f"SELECT page_id FROM {KNOWN_SQL} k WHERE space_key IN ('src1', 'src2')")
def state_page_ids(spark, sf_dir):
    return state.page_ids(known_state(spark, sf_dir), ["src1", "src2"])


def old_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("page_id"), T.chunk_id(F.col("doc_id"), F.lit(0)).alias("chunk_id"), F.lit("old").alias("text"))


@query(
    """SELECT doc_id::VARCHAR AS page_id, doc_id::VARCHAR || ':0' AS chunk_id, 'old' AS text FROM documents WHERE doc_id % 7 <> 0 UNION ALL
    SELECT doc_id::VARCHAR, doc_id::VARCHAR || ':' || i::VARCHAR, 'new' FROM documents, range(2) r(i) WHERE doc_id % 7 = 0 AND doc_id % 14 <> 0"""
)
def replace_page(spark, sf_dir):
    changed = table(spark, sf_dir, "documents").where("doc_id % 7 = 0").select("doc_id", F.col("doc_id").cast("string").alias("page_id"))
    new = changed.where("doc_id % 14 <> 0").select("page_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("i"))
    points = new.select("page_id", T.chunk_id(F.col("page_id"), F.col("i")).alias("chunk_id"), F.lit("new").alias("text"))
    return I.replaced(old_index(spark, sf_dir), changed, points)


@query("SELECT doc_id::VARCHAR AS page_id, doc_id::VARCHAR || ':0' AS chunk_id, 'old' AS text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def delete_page(spark, sf_dir):
    gone = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").cast("string").alias("page_id"))
    return state.deleted(old_index(spark, sf_dir), gone)


@query("SELECT count(*) AS points, count(DISTINCT doc_id) AS pages FROM documents")
def exact_count(spark, sf_dir):
    return old_index(spark, sf_dir).agg(F.count("*").alias("points"), F.countDistinct("page_id").alias("pages"))


# Parsing and chunking.


@query()
def parse_blocks(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return parse.parse_blocks(p.select("page_id", F.col("html").alias("body_html"), F.lit("").alias("breadcrumb")))


@query()
def page_chunks(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("page_id"), F.col("url").alias("breadcrumb"), parse.block_list(F.col("html")).alias("blocks"))
    return C.chunk_pages(p, max_tokens=128)


@query()
def doc_chunks(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(folds.split_text(F.col("text"), F.lit(128))).alias("ordinal", "text"))


_BLOCKS_SQL = """(SELECT l_orderkey::VARCHAR AS page_id, l_linenumber AS pos, CASE WHEN l_linenumber % 3 = 2 THEN CASE WHEN l_returnflag = 'R' THEN 'table' ELSE 'text' END ELSE 'heading' END AS kind,
'h' || l_partkey::VARCHAR AS text, CASE WHEN l_linenumber % 3 <> 2 THEN (l_suppkey % 4 + 1)::INTEGER END AS level
FROM (SELECT l_orderkey, l_linenumber, max(l_returnflag) AS l_returnflag, max(l_partkey) AS l_partkey, max(l_suppkey) AS l_suppkey FROM lineitem GROUP BY ALL))"""
_W = "OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def synthetic_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.col("l_linenumber") % 3 != 2
    kind = F.when(head, "heading").when(F.col("l_returnflag") == "R", "table").otherwise("text")
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*(F.max(c).alias(c) for c in ("l_returnflag", "l_partkey", "l_suppkey")))
    return lines.select(F.col("l_orderkey").cast("string").alias("page_id"), F.col("l_linenumber").alias("pos"), kind.alias("kind"), F.concat(F.lit("h"), F.col("l_partkey").cast("string")).alias("text"), F.when(head, (F.col("l_suppkey") % 4 + 1).cast("int")).alias("level"))


@query(
    f"""WITH b AS (SELECT * FROM {_BLOCKS_SQL} x), m AS (SELECT *, sum(CASE WHEN kind <> 'text' THEN 1 ELSE 0 END) {_W} AS segment,
    {", ".join(f"max(CASE WHEN kind = 'heading' AND level = {n} THEN pos END) {_W} AS p{n}, max(CASE WHEN kind = 'heading' AND level < {n} THEN pos END) {_W} AS a{n}" for n in range(1, 5))} FROM b)
    SELECT m.page_id, m.pos, m.kind, concat_ws(' > ', h1.text, h2.text, h3.text, h4.text) AS path, m.segment::BIGINT AS segment FROM m
    {" ".join(f"LEFT JOIN b h{n} ON h{n}.page_id = m.page_id AND h{n}.kind = 'heading' AND h{n}.level = {n} AND h{n}.pos = CASE WHEN m.p{n} > coalesce(m.a{n}, -1) THEN m.p{n} END" for n in range(1, 5))}"""
)
def heading_paths(spark, sf_dir):
    return C.heading_paths(synthetic_blocks(spark, sf_dir))


@query(
    r"""SELECT doc_id::VARCHAR AS page_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INTEGER AS ordinal, doc_id::VARCHAR || ':' || (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::VARCHAR AS chunk_id, line AS text
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE trim(line) <> ''"""
)
def chunk_ordinals(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("page_id"), F.posexplode(F.split("text", "\n")).alias("i", "text")).where(F.trim("text") != "")
    return C.numbered(lines, "i").select("page_id", "ordinal", "chunk_id", "text")


# Retrieval.

_IDF = "ln(1 + (nd - df + 0.5) / (df + 0.5))"


def bm25_sql(questions: str, texts: str, k: int) -> str:
    """questions (qid, question), texts (key, text) as SQL; rows (qid, key, score, rank)."""
    return f"""(WITH t AS (SELECT key, {terms_sql('text')} AS w FROM {texts} x), s AS (SELECT count(*) AS nd, avg(len(w)) AS av FROM t),
    p AS (SELECT key, n, term, count(*) AS tf FROM (SELECT key, len(w) AS n, unnest(w) AS term FROM t) GROUP BY ALL), d AS (SELECT term, count(*) AS df FROM p GROUP BY term),
    q AS (SELECT qid, unnest(list_distinct({terms_sql('question')})) AS term FROM {questions} y),
    r AS (SELECT qid, key, round(sum({_IDF} * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / av))), 6) AS score FROM q JOIN d USING (term) JOIN p USING (term), s GROUP BY ALL),
    o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, key)::INTEGER AS rank FROM r) SELECT * FROM o WHERE rank <= {k})"""


_BENCH = "(SELECT item_id AS qid, text AS question FROM benchmark)"
_DOCS = "(SELECT doc_id AS key, text FROM documents)"


@query(f"SELECT qid, key AS doc_id, score, rank FROM {bm25_sql(_BENCH, _DOCS, 20)} b")
def bm25_search(spark, sf_dir):
    return search.bm25(questions(spark, sf_dir), table(spark, sf_dir, "documents"), 20, key="doc_id", digits=6).select("qid", "doc_id", "score", "rank")


@query(f"SELECT term, count(*) AS df, round(ln(1 + ((SELECT count(*) FROM documents) - count(*) + 0.5) / (count(*) + 0.5)), 6) AS idf FROM (SELECT DISTINCT doc_id, unnest({terms_sql('text')}) AS term FROM documents) GROUP BY term")
def term_stats(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    stats = I.term_stats(I.postings(d, "doc_id"), d.count())
    return stats.select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({terms_sql('text')}) AS term FROM documents) GROUP BY ALL")
def sparse_documents(spark, sf_dir):
    return I.postings(table(spark, sf_dir, "documents"), "doc_id")


@query(f"SELECT item_id AS qid, unnest(list_distinct({terms_sql('text')})) AS term FROM benchmark")
def sparse_queries(spark, sf_dir):
    return questions(spark, sf_dir).select("qid", F.explode(F.array_distinct(T.terms(F.col("question")))).alias("term"))


def dense_sql(questions: str, vectors: str, k: int, condition: str = "TRUE") -> str:
    return f"""(WITH r AS (SELECT q.qid, v.key, round(list_cosine_similarity(q.qvec::DOUBLE[], v.vec::DOUBLE[]), 6) AS score FROM {questions} q, {vectors} v WHERE {condition}),
    o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, key)::INTEGER AS rank FROM r) SELECT * FROM o WHERE rank <= {k})"""


_VECS = "(SELECT vec_id AS key, embedding AS vec, label FROM embeddings)"
_VQ = "(SELECT vec_id AS qid, embedding AS qvec FROM embeddings WHERE vec_id % 20 = 0)"


@query(f"SELECT qid, key AS vec_id, score, rank FROM {dense_sql(_VQ, _VECS, 20)} d")
def dense_search(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    return search.dense(q, e, 20, key="vec_id", vector="embedding", digits=6).select("qid", "vec_id", "score", "rank")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, e = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    return d.join(e, d["doc_id"] == e["vec_id"], "left").select("doc_id", F.col("source").alias("space_key"), "text", F.col("embedding").alias("dense"))


def vector_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).where("doc_id % 20 = 0 and dense is not null").select(F.col("doc_id").alias("qid"), F.col("text").alias("question"), F.col("dense").alias("qvec"))


_Q = "(SELECT doc_id AS qid, text AS question, embedding AS qvec FROM documents JOIN embeddings ON doc_id = vec_id WHERE doc_id % 20 = 0)"


def hybrid_sql(where: str) -> str:
    texts = f"(SELECT doc_id AS key, text FROM documents WHERE {where})"
    vecs = f"(SELECT doc_id AS key, embedding AS vec FROM documents JOIN embeddings ON doc_id = vec_id WHERE {where})"
    return f"""WITH l AS (SELECT qid, key, rank FROM {bm25_sql(_Q, texts, 20)} b UNION ALL SELECT qid, key, rank FROM {dense_sql(_Q, vecs, 20)} d),
    f AS (SELECT qid, key, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM l GROUP BY ALL),
    o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, key)::INTEGER AS rank FROM f) SELECT qid, key AS doc_id, score, rank FROM o WHERE rank <= 20"""


def _hybrid(spark: SparkSession, sf_dir: str, spaces: list[str] | None) -> DataFrame:
    found = search.hybrid(vector_questions(spark, sf_dir), points(spark, sf_dir), 20, spaces, key="doc_id", digits=6)
    return found.select("qid", "doc_id", F.round("score", 9).alias("score"), "rank")


@query(hybrid_sql("TRUE"))
def hybrid_rrf(spark, sf_dir):
    return _hybrid(spark, sf_dir, None)


@query(hybrid_sql("source IN ('src0', 'src3', 'src5')"))
def hybrid_rrf_filtered(spark, sf_dir):
    return _hybrid(spark, sf_dir, ["src0", "src3", "src5"])


def scored_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark question's BM25 candidates with the score of the default reranker."""
    found = bm25_search(spark, sf_dir).select("qid", "doc_id", "rank")
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return found.join(questions(spark, sf_dir), "qid").join(d, "doc_id").withColumn("score", F.round(rerank.overlap(F.col("question"), F.col("text")), 6))


_SCORED = f"""(SELECT b.qid, b.key AS doc_id, b.rank, q.question, d.text, round(len(list_intersect(list_distinct({terms_sql('q.question')}), {terms_sql('d.text')}))::DOUBLE / len(list_distinct({terms_sql('q.question')})), 6) AS score
FROM {bm25_sql(_BENCH, _DOCS, 20)} b JOIN {_BENCH} q ON b.qid = q.qid JOIN documents d ON b.key = d.doc_id)"""
_RERANKED = f"(SELECT qid, doc_id, score, text, row_number() OVER (PARTITION BY qid ORDER BY score DESC, rank)::INTEGER AS rank FROM {_SCORED} s WHERE score >= 0.5)"


@query(f"SELECT qid, doc_id, score, rank FROM {_RERANKED} r WHERE rank <= 5")
def rerank_gate(spark, sf_dir):
    return rerank.rerank(scored_candidates(spark, sf_dir), None, 5, 0.5).select("qid", "doc_id", "score", "rank")


@query(f"SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, rank)::INTEGER AS rank FROM {_SCORED} s")
def rerank_order(spark, sf_dir):
    return rerank.reordered(scored_candidates(spark, sf_dir), None).select("qid", "doc_id", "rank")


# Answers.


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as sources: each turn is one."""
    c = table(spark, sf_dir, "conversations")
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    return c.select(F.col("conv_id").alias("qid"), rank.alias("rank"), F.col("role").alias("title"), F.concat(F.lit("u/"), F.col("role")).alias("url"), "text", F.lit("2026").alias("last_modified"), F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("role")).alias("page_id"))


_TURNS = "(SELECT conv_id AS qid, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text)::INTEGER AS rank, role AS title, 'u/' || role AS url, text, '2026' AS last_modified, conv_id::VARCHAR || '-' || role AS page_id FROM conversations)"
_CONTEXT = f"(SELECT qid, count(*)::INTEGER AS n, string_agg('[' || rank || '] Titel: ' || title || ' | URL: ' || url || chr(10) || coalesce(text, ''), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context FROM {_TURNS} t GROUP BY qid)"


@query(f"SELECT qid, n, context FROM {_CONTEXT} c")
def source_block(spark, sf_dir):
    return A.source_blocks(turns(spark, sf_dir))


@query(f"SELECT qid, 2 AS n_messages, 'user' AS role, 'Frage: ' || qid::VARCHAR || chr(10) || chr(10) || 'Kontext:' || chr(10) || context AS content FROM {_CONTEXT} c")
def prompt_messages(spark, sf_dir):
    m = A.messages(F.col("qid").cast("string"), F.col("context"))
    rows = A.source_blocks(turns(spark, sf_dir)).select("qid", m.alias("m"))
    return rows.select("qid", F.size("m").alias("n_messages"), F.col("m")[1]["role"].alias("role"), F.col("m")[1]["content"].alias("content"))


def said(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer for each conversation: markers in range, twice, out of range, or none."""
    n = F.col("qid") % 5
    text = F.when(n == 0, F.lit("No marker.")).when(n == 1, F.lit("See [2] and [1], again [2].")).when(n == 2, F.lit("Only [99].")).when(n == 3, F.concat(F.lit("Both [1] and ["), (F.col("qid") % 4).cast("string"), F.lit("]."))).otherwise(F.lit("[3][2] and [0]"))
    return turns(spark, sf_dir).select("qid").distinct().withColumn("answer", text)


_SAID = f"(SELECT DISTINCT qid, CASE qid % 5 WHEN 0 THEN 'No marker.' WHEN 1 THEN 'See [2] and [1], again [2].' WHEN 2 THEN 'Only [99].' WHEN 3 THEN 'Both [1] and [' || (qid % 4)::VARCHAR || '].' ELSE '[3][2] and [0]' END AS answer FROM {_TURNS} t)"
_MARKS = rf"(SELECT qid, unnest(regexp_extract_all(answer, '\[(\d+)\]', 1))::INTEGER AS n, generate_subscripts(regexp_extract_all(answer, '\[(\d+)\]', 1), 1) - 1 AS place FROM {_SAID} s)"


@query(f"SELECT qid, place::INTEGER AS place, n FROM {_MARKS} m")
def citation_markers(spark, sf_dir):
    return A.markers(said(spark, sf_dir))


@query(
    f"""WITH t AS (SELECT * FROM {_TURNS} x), m AS (SELECT * FROM {_MARKS} y), h AS (SELECT m.qid, m.place::INTEGER AS place, t.page_id, t.title, t.url FROM m JOIN t ON m.qid = t.qid AND m.n = t.rank
    UNION ALL SELECT t.qid, t.rank, t.page_id, t.title, t.url FROM t WHERE t.qid NOT IN (SELECT qid FROM m)) SELECT qid, page_id, min(place) AS place, arg_min(title, place) AS title, arg_min(url, place) AS url FROM h GROUP BY qid, page_id"""
)
def citations(spark, sf_dir):
    return A.citations(said(spark, sf_dir), turns(spark, sf_dir)).select("qid", "page_id", "place", "title", "url")


@query(
    f"""SELECT q.qid, q.question, CASE WHEN r.qid IS NULL OR q.qid % 4 = 1 OR q.qid % 4 = 2 THEN '{A.NO_CONTEXT}' ELSE 'Said ' || q.qid::VARCHAR END AS answer, (r.qid IS NOT NULL AND q.qid % 4 IN (0, 3)) AS used_context
    FROM {_BENCH} q LEFT JOIN (SELECT DISTINCT qid FROM {_RERANKED} r) r ON q.qid = r.qid"""
)
def no_context_gate(spark, sf_dir):
    """Questions with no source reach no generator; of the others, some get no answer and some a refusal."""
    best = rerank.rerank(scored_candidates(spark, sf_dir), None, 5, 0.5)
    asked = questions(spark, sf_dir)
    sources = best.select("qid", "rank", F.col("doc_id").cast("string").alias("page_id"), F.lit("t").alias("title"), F.lit("u").alias("url"), F.lit("").alias("last_modified"), "text")

    def generate(question, context):
        number = F.regexp_extract(question, r"^(\d+)\|", 1).cast("long") % 4
        return F.when(number == 1, F.lit(" \n")).when(number == 2, F.lit(A.NO_CONTEXT + " Mehr.")).otherwise(F.concat(F.lit(" Said "), F.regexp_extract(question, r"^(\d+)\|", 1)))

    numbered = asked.withColumn("question", F.concat(F.col("qid").cast("string"), F.lit("|"), F.col("question")))
    out = A.answer(numbered, sources, generate)
    return out.select("qid", F.regexp_replace("question", r"^\d+\|", "").alias("question"), "answer", "used_context")


_RAG = f"""SELECT q.qid, CASE WHEN line <> '' THEN trim(line, ' ' || chr(9) || chr(10)) || ' [1]' ELSE '{A.NO_CONTEXT}' END AS answer, coalesce(line <> '', FALSE) AS used_context,
CASE WHEN line <> '' THEN 1 ELSE 0 END::INTEGER AS n_citations, CASE WHEN line <> '' THEN page_id END AS page_id, CASE WHEN line <> '' THEN title END AS title, CASE WHEN line <> '' THEN 'https://wiki.example/' || page_id END AS url
FROM {_BENCH} q LEFT JOIN (SELECT r.qid, p.page_id, p.title, regexp_extract(p.text, '^\\s*([^\\n]+)', 1) AS line FROM {_RERANKED} r JOIN {PAGES_SQL} p ON p.doc_id = r.doc_id WHERE r.rank = 1) s ON q.qid = s.qid"""


@query(_RAG)
def rag_answer(spark, sf_dir):
    """Question to cited answer: BM25, rerank, gate, prompt, the default generator, citations."""
    best = rerank.rerank(scored_candidates(spark, sf_dir), None, 5, 0.5).select("qid", "doc_id", "rank")
    p = pages(spark, sf_dir).select("doc_id", "page_id", "title", F.concat(F.lit("https://wiki.example/"), F.col("page_id")).alias("url"), F.lit("").alias("last_modified"), "text")
    out = A.answer(questions(spark, sf_dir), best.join(p, "doc_id"))
    first = F.get("citations", F.lit(0))
    return out.select("qid", "answer", "used_context", F.size("citations").alias("n_citations"), first["page_id"].alias("page_id"), first["title"].alias("title"), first["url"].alias("url"))


# Evaluation.


def retrieved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense_search(spark, sf_dir).where("qid <> vec_id").select("qid", F.col("vec_id").cast("string").alias("page_id"), "rank")


def first_of_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as questions; gold are the others of their label, which are looked up for what was found alone."""
    e = table(spark, sf_dir, "embeddings")
    asked = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("label").alias("wanted"))
    found = E.page_ranks(retrieved(spark, sf_dir)).join(e.select(F.col("vec_id").cast("string").alias("page_id"), "label"), "page_id").join(asked, "qid")
    return E.first_hit(found.withColumn("gold", F.col("label") == F.col("wanted")), asked)


_RETRIEVED = f"(SELECT qid, key AS vec_id, rank FROM {dense_sql(_VQ, _VECS, 20)} d WHERE qid <> key)"
_PAGES_RANKED = f"(SELECT qid, vec_id, row_number() OVER (PARTITION BY qid ORDER BY rank) AS rank FROM {_RETRIEVED} r)"
_FIRSTS = f"(SELECT q.qid, coalesce(min(CASE WHEN e.label = q.label THEN p.rank END), 0) AS first FROM (SELECT vec_id AS qid, label FROM embeddings WHERE vec_id % 20 = 0) q LEFT JOIN {_PAGES_RANKED} p ON p.qid = q.qid LEFT JOIN embeddings e ON e.vec_id = p.vec_id GROUP BY q.qid)"


@query(f"SELECT avg(CASE WHEN first BETWEEN 1 AND 5 THEN 1.0 ELSE 0.0 END)::DOUBLE AS hit_rate, round(avg(CASE WHEN first > 0 THEN 1.0::DOUBLE / first ELSE 0 END), 9) AS mrr FROM {_FIRSTS} f")
def eval_hit_rate_mrr(spark, sf_dir):
    return E.metrics(first_of_label(spark, sf_dir), 5).select("hit_rate", F.round("mrr", 9).alias("mrr"))


@query(f"SELECT qid, first::INTEGER AS first FROM {_FIRSTS} f WHERE first = 0 OR first > 5")
def eval_misses(spark, sf_dir):
    return E.misses(first_of_label(spark, sf_dir), 5)


_LINE_PAGES = "(SELECT l_orderkey AS qid, (l_suppkey % 5)::VARCHAR AS page_id, l_linenumber AS rank FROM lineitem)"


@query(f"SELECT qid, page_id, row_number() OVER (PARTITION BY qid ORDER BY f, page_id)::INTEGER AS rank FROM (SELECT qid, page_id, min(rank) AS f FROM {_LINE_PAGES} x GROUP BY ALL)")
def pages_in_order(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("qid"), (F.col("l_suppkey") % 5).cast("string").alias("page_id"), F.col("l_linenumber").alias("rank"))
    return E.page_ranks(r)


# Change events.


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as loose JSON of four shapes, some without an id, some that delete."""
    e = table(spark, sf_dir, "events")
    user = F.col("user_id").cast("string")
    n = F.col("event_id") % 5
    kind = F.when(F.col("event_type") == "error", F.lit("Page_Trashed")).otherwise(F.col("event_type"))
    body = F.when(n == 0, F.concat(F.lit('"page":{"id":'), user, F.lit("}"))).when(n == 1, F.concat(F.lit('"content":{"id":"'), user, F.lit('"}'))).when(n == 2, F.concat(F.lit('"page_id":"'), user, F.lit('"'))).when(n == 3, F.concat(F.lit('"page":7,"id":'), user)).otherwise(F.lit('"other":1'))
    name = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('"event":"'), kind, F.lit('"'))).otherwise(F.concat(F.lit('"event":"","eventType":"'), kind, F.lit('"')))
    return e.select("event_id", "ts", F.concat(F.lit("{"), name, F.lit(","), body, F.lit("}")).alias("value"))


_KIND = "CASE WHEN event_type = 'error' THEN 'page_trashed' ELSE lower(event_type) END"
_ROUTED = f"(SELECT event_id, ts, CASE WHEN event_id % 5 < 4 THEN user_id::VARCHAR END AS page_id, {_KIND} AS event, CASE WHEN event_id % 5 = 4 THEN NULL WHEN event_type = 'error' THEN 'delete' ELSE 'sync' END AS action FROM events)"


@query(f"SELECT event_id, page_id, event, action FROM {_ROUTED} r")
def webhook_route(spark, sf_dir):
    return S.routed(payloads(spark, sf_dir)).select("event_id", "page_id", "event", "action")


@query(f"SELECT page_id, arg_max(action, event_id) AS action, max(event_id) AS event_id FROM {_ROUTED} r WHERE action IS NOT NULL GROUP BY page_id")
def webhook_latest(spark, sf_dir):
    return S.latest(S.routed(payloads(spark, sf_dir)).where("action is not null"), order=("event_id",)).select("page_id", "action", "event_id")


@query("SELECT event_id, bool_and(ok) AS ok FROM (SELECT user_id AS event_id, event_type <> 'error' AS ok FROM events) GROUP BY event_id")
def health(spark, sf_dir):
    checks = table(spark, sf_dir, "events").select(F.col("user_id").alias("event_id"), F.when(F.col("event_type") != "error", "ok").otherwise("error: X").alias("state"))
    return E.all_ok(checks, "event_id")


@query()
def stream_sync(spark, sf_dir):
    """The events as a file stream, through foreachBatch, into a state table; then what the state holds."""
    import uuid

    top = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    payloads(spark, sf_dir).select("event_id", "value").write.parquet(f"{top}/events")
    stream = spark.readStream.schema("event_id long, value string").parquet(f"{top}/events")
    store = state.Snapshots(spark, f"{top}/state", "page_id string, content_hash string, last_modified string, space_key string, title string, url string")
    store.create()
    empty = F.lit("")
    nobody = spark.createDataFrame([], "page_id string")

    def on_sync(ids: DataFrame) -> None:
        fetched = ids.select("page_id", F.sha2("page_id", 256).alias("content_hash"), empty.alias("last_modified"), empty.alias("space_key"), empty.alias("title"), empty.alias("url"))
        sync.sync(fetched, nobody, store)

    S.sync_stream(stream, on_sync, lambda ids: sync.delete_pages(ids, store), f"{top}/checkpoint", order=("event_id",)).awaitTermination()
    out = materialised(store.read().select("page_id", "content_hash"))
    dropped(spark, top)
    return out


@query("SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_pairs(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    a, b = e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x")), e.select(F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    return a.join(b, F.col("b") == F.col("a") + 1).select("a", "b", F.round(cosine(F.col("x"), F.col("y")), 6).alias("score"))


# Small surfaces.


@query("SELECT 'Q ' || text AS question, len([item_id::VARCHAR, 'x'])::INTEGER AS n_gold, item_id::VARCHAR AS first_gold FROM benchmark")
def jsonl_scan(spark, sf_dir):
    """Questions written as JSON lines, with blank lines between, and read again."""
    import uuid

    path = f"{shared_folder(spark)}/jsonl-{uuid.uuid4().hex}"
    row = F.struct(F.concat(F.lit("Q "), F.col("text")).alias("question"), F.array(F.col("item_id").cast("string"), F.lit("x")).alias("gold_page_ids"))
    table(spark, sf_dir, "benchmark").select(F.explode(F.array(F.concat(F.lit(" "), F.to_json(row)), F.lit("  "))).alias("value")).write.text(path)
    out = materialised(read_jsonl(spark, path).select("question", F.size("gold_page_ids").alias("n_gold"), F.col("gold_page_ids")[0].alias("first_gold")))
    dropped(spark, path)
    return out


@query(
    f"""SELECT page_id, page_id || ':0' AS chunk_id, space_key, title, array_to_string(list_filter([space_key, title], lambda x: x <> ''), ' > ') AS breadcrumb, 'https://wiki.example/display/' || page_id AS url, 'old' AS last_modified, {HASH_SQL} AS content_hash,
    array_to_string(list_filter([space_key, title], lambda x: x <> ''), ' > ') || chr(10) || chr(10) || text AS text FROM {PAGES_SQL} p"""
)
def payload(spark, sf_dir):
    """The payload of a page's first chunk: the page's columns and the chunk's, without a join."""
    p = pages(spark, sf_dir).withColumns({"author": F.lit(""), "labels": F.array().cast("array<string>"), "last_modified": F.lit("old"), "url": F.concat(F.lit("https://wiki.example/display/"), F.col("page_id")), "content_hash": T.content_hash(F.col("title"), F.col("text"))})
    crumb = T.breadcrumb(F.col("space_key"), F.array().cast("array<string>"), F.col("title"))
    chunks = p.withColumns({"chunk_id": T.chunk_id(F.col("page_id"), F.lit(0)), "breadcrumb": crumb, "text": T.chunk_text(crumb, F.col("text"))})
    made = I.points(chunks, lambda text: F.array().cast("array<float>"))
    return made.select("page_id", "chunk_id", "space_key", "title", "breadcrumb", "url", "last_modified", "content_hash", "text")


@query("SELECT item_id, '{\"answer\":\"A' || item_id::VARCHAR || '\",\"citations\":[],\"used_context\":' || CASE WHEN item_id % 2 = 0 THEN 'true' ELSE 'false' END || '}' AS json FROM benchmark")
def dict_projection(spark, sf_dir):
    result = F.struct(F.concat(F.lit("A"), F.col("item_id").cast("string")).alias("answer"), F.array().cast(f"array<{A.CITATION}>").alias("citations"), (F.col("item_id") % 2 == 0).alias("used_context"))
    return table(spark, sf_dir, "benchmark").select("item_id", F.to_json(result).alias("json"))


@query(f"SELECT conv_id, turn, role, CASE WHEN turn % 3 = 0 OR trim(text, ' ' || chr(10)) = '' THEN '{A.NO_CONTEXT}' ELSE trim(text, ' ' || chr(10)) END AS answer FROM conversations")
def answer_normalise(spark, sf_dir):
    said = F.when(F.col("turn") % 3 != 0, F.concat(F.lit(" "), F.col("text"), F.lit("\n")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", A.gated(said).alias("answer"))


@query("SELECT item_id AS qid FROM benchmark WHERE item_id % 4 <> 0")
def blank_questions(spark, sf_dir):
    """Questions of white space alone are no questions."""
    asked = questions(spark, sf_dir).withColumn("question", F.when(F.col("qid") % 4 == 0, F.lit(" \t\u00a0\n")).otherwise(F.col("question")))
    nothing = spark.createDataFrame([], "qid long, rank int, page_id string, title string, url string, last_modified string, text string")
    return A.answer(asked, nothing).select("qid")


@query(
    f"""SELECT count(*) AS seen, count_if(outcome = 'indexed' AND doc_id % 11 <> 0)::BIGINT AS indexed, count_if(outcome = 'restricted')::BIGINT AS skipped_restricted,
    count_if(outcome = 'unchanged' AND doc_id % 11 <> 0)::BIGINT AS skipped_unchanged, 0::BIGINT AS deleted, count_if(outcome <> 'restricted' AND doc_id % 11 = 0)::BIGINT AS errors FROM {OUTCOME_SQL} o"""
)
def sync_errors(spark, sf_dir):
    """Pages that the parser can't read are counted and the others go on."""
    raw = raw_pages(spark, sf_dir)
    number = F.col("id").cast("long")
    broken = F.when(number % 11 == 0, F.concat(F.lit("<![unknown["), F.col("body.view.value"))).otherwise(F.col("body.view.value"))
    failing = extract.extract_pages(raw.withColumn("body", F.struct(F.struct(broken.alias("value")).alias("view"))))
    good = extract.extract_pages(raw).withColumn("_n", F.col("page_id").cast("long")).where("_n % 5 <> 0")
    old = F.when(F.col("_n") % 7 == 0, F.sha2("content_hash", 256)).otherwise(F.col("content_hash"))
    restricted = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").cast("string").alias("page_id"))
    return sync.stats(sync.outcomes(failing, restricted, good.select("page_id", old.alias("content_hash"))))


@query()
def dense_embed(spark, sf_dir):
    """Vectors of texts from the default embedder."""
    return table(spark, sf_dir, "documents").select("doc_id", I.hashing_embedding(64)(F.col("text")).alias("dense"))
