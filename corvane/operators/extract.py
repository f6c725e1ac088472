"""Raw wiki pages to flat page rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .parse import read_text


def extract_pages(raw: DataFrame, base_url: str = "", read=read_text) -> DataFrame:
    """raw: the schema RAW_PAGE, and error and restricted if the source tells them. Missing values become empty strings and arrays.

    read: html column to struct<text, error>. error: what went wrong with a page, null if nothing did.
    """
    labels = T.names(F.col("metadata.labels.results"), "name")
    ancestors = T.names(F.col("ancestors"), "title")
    base = F.when(T.blank(F.col("_links.base")) != "", F.col("_links.base")).otherwise(F.lit(base_url))
    flat = raw.select(
        T.blank(F.col("id").cast("string")).alias("page_id"),
        T.blank(F.col("space.key")).alias("space_key"),
        T.blank(F.col("title")).alias("title"),
        T.page_url(base, F.col("_links.webui")).alias("url"),
        labels.alias("labels"),
        T.blank(F.col("version.by.displayName")).alias("author"),
        T.blank(F.col("version.when")).alias("last_modified"),
        ancestors.alias("ancestors"),
        T.blank(F.col("body.view.value")).alias("body_html"),
        *(c for c in ("error", "restricted") if c in raw.columns),
    )
    crumb = T.breadcrumb(F.col("space_key"), F.col("ancestors"), F.col("title"))
    parsed = flat.withColumn("breadcrumb", crumb).withColumn("_read", read(F.col("body_html")))
    before = [F.col("error")] if "error" in raw.columns else []
    with_text = parsed.withColumn("error", F.coalesce(*before, F.col("_read.error"))).withColumn("text", T.blank(F.col("_read.text"))).drop("_read")
    return with_text.withColumn("content_hash", T.content_hash(F.col("title"), F.col("text")))


def restricted(user: Column, group: Column) -> Column:
    """Whether a read restriction names a user or a group."""
    some = lambda s: (F.coalesce(s["size"], F.lit(0)) > 0) | (F.coalesce(F.size(s["results"]), F.lit(0)) > 0)
    return F.coalesce(some(user), F.lit(False)) | F.coalesce(some(group), F.lit(False))


def restricted_pages(restrictions: DataFrame) -> DataFrame:
    """page_id of the pages with read restrictions; the sets may stand under restrictions or at the top."""
    inner = F.col("restrictions").isNotNull()
    user = F.when(inner, F.col("restrictions.user")).otherwise(F.col("user"))
    group = F.when(inner, F.col("restrictions.group")).otherwise(F.col("group"))
    return restrictions.where(restricted(user, group)).select("page_id").distinct()


def is_restricted(answer: Column) -> Column:
    """Whether a source's answer about a page's read restrictions (JSON) names anybody; null if there is no answer."""
    inner = answer["restrictions"].isNotNull()
    sets = (F.when(inner, answer["restrictions"][name]).otherwise(answer[name]) for name in ("user", "group"))
    return F.when(answer.isNotNull(), restricted(*sets))
