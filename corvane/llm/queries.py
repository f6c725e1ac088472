"""The queries opN_ of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, html, media, mixing, quality, simhash, substring, suffix, urls
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


#: The rules of op6, as its contract states them.
RULES = (urls.Rule("block", "net", "/"), urls.Rule("allow", "example.net", "/en/"), urls.Rule("block", "example.com", "/de/"), urls.Rule("allow", "org", "/fr/"))


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = mixing.plan(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return p.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.drop_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urls.judge(pages, urls.page_edges(pages), RULES)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.drop_repeats(table(spark, sf_dir, "documents"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(media.text_media(table(spark, sf_dir, "documents")))


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


OP2 = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  md5('7:' || coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))) AS o FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1]::DOUBLE AS w FROM d GROUP BY source),
k AS (SELECT *, 2.0::DOUBLE * source_size AS cap, row_number() OVER (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST) AS i FROM s),
r AS (SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS aim, coalesce(sum(cap) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
             sum(w) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_w FROM k),
l AS (SELECT coalesce((SELECT (aim - used) / left_w FROM r WHERE (aim - used) / left_w * w <= cap ORDER BY i LIMIT 1), 1e300) AS level),
t AS (SELECT source, source_size, CASE WHEN level * w > cap THEN cap ELSE level * w END AS target FROM k, l),
q AS (SELECT source, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
c AS (SELECT d.doc_id, d.size, q.source_size, q.target, q.whole, q.target - q.whole * q.source_size AS more,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.o, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size / 2 AS middle
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target, ((whole + CASE WHEN middle < more THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM c
"""


OP1 = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN embedding]) AND list_bool_or([x <> 0 FOR x IN embedding])),
d AS (SELECT a.vec_id AS query_id, b.vec_id, list_cosine_similarity(a.v, b.v) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM d)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

OP6 = r"""
WITH RECURSIVE l AS (SELECT url AS a, unnest(list_transform(list_filter(regexp_extract_all(html, '(?i)<link\b[^>]*>'), lambda t: regexp_matches(t, '(?i)\brel\s*=\s*["'']?canonical\b')),
                                          lambda t: regexp_extract(t, '(?i)\bhref\s*=\s*["'']?\s*([a-zA-Z][\w+.-]*://[^"''\s>]+)', 1))
                          || list_transform(list_filter(regexp_extract_all(html, '(?i)<meta\b[^>]*>'), lambda t: regexp_matches(t, '(?i)\bhttp-equiv\s*=\s*["'']?refresh\b')),
                                          lambda t: regexp_extract(t, '(?i)\burl\s*=\s*["'']?\s*([a-zA-Z][\w+.-]*://[^"''\s>]+)', 1))) AS b
                     FROM pages WHERE contains(lower(html), 'canonical') OR contains(lower(html), 'refresh')),
e AS (SELECT a, replace(b, '&amp;', '&') AS b FROM l WHERE b <> '' AND a IS NOT NULL),
w AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(a, b) AS (SELECT a, a FROM w UNION SELECT r.a, w.b FROM reach r JOIN w ON r.b = w.a),
r(verdict, rhost, rpath) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
urls AS (SELECT url FROM pages UNION SELECT b FROM reach),
u AS (SELECT url, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
             coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM urls),
m AS (SELECT url, host, path, arg_max(rhost || rpath, len(rhost || rpath)) AS rule, arg_max(verdict, len(rhost || rpath)) AS verdict
      FROM u LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY ALL),
c AS (SELECT reach.a AS url, CASE WHEN bool_or(m.verdict = 'allow') THEN 'allow' ELSE 'block' END AS verdict FROM reach JOIN m ON reach.b = m.url WHERE m.verdict IS NOT NULL GROUP BY 1)
SELECT p.page_id, m.host, m.path, m.rule, coalesce(m.verdict, c.verdict, 'allow') AS verdict
FROM pages p JOIN m ON p.url IS NOT DISTINCT FROM m.url LEFT JOIN c ON p.url = c.url
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_ann": OP1, "op2_mixing": OP2, "op6_urls": OP6}
