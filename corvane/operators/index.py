"""The index: chunks as points with a dense vector, and postings for BM25."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions import text as T
from .chunk import HARD_MAX_TOKENS, MAX_TOKENS, chunk_pages
from .parse import block_list

Embed = Callable[[Column], Column]
POINT_COLUMNS = ("id", "page_id", "chunk_id", "space_key", "title", "breadcrumb", "url", "labels", "author", "last_modified", "content_hash", "text", "dense", "n_terms", "terms", "tfs")


def hashing_embedding(dim: int = 64) -> Embed:
    """A deterministic vector of a text for use without a model: signed hashes of its terms, scaled to length 1."""
    find = re.compile(r"[^\W_]+").findall

    @pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        known: dict[str, tuple[int, float]] = {}

        def one(text: str | None) -> np.ndarray:
            v = np.zeros(dim)
            for w in find((text or "").lower()):
                if w not in known:
                    h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                    known[w] = h % dim, 1.0 if h >> 63 else -1.0
                i, sign = known[w]
                v[i] += sign
            n = math.sqrt(float(v @ v))
            return (v / n if n else v).astype(np.float32)

        return texts.map(one)

    return embed


def chunks_of(pages: DataFrame, max_tokens: int = MAX_TOKENS, hard_max_tokens: int = HARD_MAX_TOKENS) -> DataFrame:
    """Pages to chunks: parse and chunk, the page's columns carried along."""
    return chunk_pages(pages.withColumn("blocks", block_list(F.col("body_html"))).drop("body_html").withColumnRenamed("text", "page_text"), max_tokens, hard_max_tokens)


def points(chunks: DataFrame, embed: Embed) -> DataFrame:
    """Chunks with their page's columns to index points: a dense vector, and the sparse one, the text's terms and how often each stands there."""
    made = chunks.withColumn("id", T.point_id(F.col("chunk_id"))).withColumn("dense", embed(F.col("text")))
    return with_sparse(made).select(*POINT_COLUMNS)


def with_sparse(texts: DataFrame, text: str = "text") -> DataFrame:
    """Add n_terms, the distinct terms in order, and tfs, their counts. A sorted list is cut where its term changes, so no row is shuffled or exploded."""
    out = texts.withColumn("_t", F.array_sort(T.terms(F.col(text))))
    first = F.filter(F.sequence(F.lit(1), F.size("_t")), lambda i: (i == 1) | (F.element_at("_t", i) != F.element_at("_t", F.greatest(i - 1, F.lit(1)))))
    out = out.withColumn("n_terms", F.size("_t")).withColumn("_f", F.when(F.size("_t") > 0, first).otherwise(F.array().cast("array<int>")))
    ends = F.slice(F.array_append("_f", F.col("n_terms") + 1), 2, F.size("_f"))
    tfs = F.when(F.size("_f") > 0, F.zip_with("_f", ends, lambda a, b: b - a)).otherwise(F.array().cast("array<int>"))
    return out.withColumn("terms", F.transform("_f", lambda i: F.element_at("_t", i))).withColumn("tfs", tfs).drop("_t", "_f")


def replaced(index: DataFrame, pages: DataFrame, new_points: DataFrame) -> DataFrame:
    """The index with the points of ``pages`` in place of the old ones; a page without chunks is only taken out."""
    return index.join(pages.select("page_id").distinct(), "page_id", "left_anti").select(*index.columns).unionByName(new_points.select(*index.columns))


def postings(texts: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """(key, term, tf): how often each term stands in each text."""
    return texts.select(key, F.explode(T.terms(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def lengths(texts: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    return texts.select(key, F.size(T.terms(F.col(text))).alias("n"))


def term_stats(posted: DataFrame, total: int | Column) -> DataFrame:
    """(term, df, idf), idf = ln(1 + (N - df + 0.5) / (df + 0.5))."""
    n = F.lit(total) if isinstance(total, int) else total
    counted = posted.groupBy("term").agg(F.count("*").alias("df"))
    return counted.withColumn("idf", F.log1p((n - F.col("df") + 0.5) / (F.col("df") + 0.5)))
