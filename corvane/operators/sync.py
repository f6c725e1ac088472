"""Synchronisation: which pages are new, changed, restricted or gone, and what that does to index and state."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .state import Snapshots

log = logging.getLogger("corvane.sync")

RESTRICTED, UNCHANGED, INDEXED, ERROR = "restricted", "unchanged", "indexed", "error"
#: The counters of a run. deleted stays 0 in a crawl.
STATS = ("seen", "indexed", "skipped_restricted", "skipped_unchanged", "deleted", "errors")
IndexFn = Callable[[DataFrame], None]


def in_spaces(pages: DataFrame, spaces: list[str]) -> DataFrame:
    return pages.where(F.col("space_key").isin(spaces))


def current_pages(raw: DataFrame) -> DataFrame:
    return raw.where("type = 'page' and status = 'current'")


def changed_since(pages: DataFrame, since: str, spaces: list[str]) -> DataFrame:
    """Pages of the spaces whose last change is at ``since`` or later, oldest first."""
    return in_spaces(pages, spaces).where(F.col("last_modified") >= since).orderBy("last_modified")


def with_ids(pages: DataFrame, ids: list[str]) -> DataFrame:
    """Pages by id; a source that can look ids up gets the filter."""
    return pages.where(F.col("page_id").isin(ids))


def outcomes(pages: DataFrame, restricted: DataFrame | None, state: DataFrame) -> DataFrame:
    """pages with the column outcome: restricted, unchanged (the stored hash is the page's), indexed, or error.

    restricted: page_ids, or None if pages have the column restricted already; nobody syncs without knowing. Left joins on
    page_id, whose small sides Spark broadcasts only if they are below its threshold. A page that carries an error (a
    non-null column error) or of which it is not known whether it is restricted counts as an error and goes no further.
    """
    s = state.select(F.col("page_id").alias("_s"), F.col("content_hash").alias("_hash"))
    if restricted is not None:
        r = restricted.select(F.col("page_id").alias("_r")).distinct()
        pages = pages.drop("restricted").join(r, F.col("page_id") == F.col("_r"), "left").withColumn("restricted", F.col("_r").isNotNull()).drop("_r")
    elif "restricted" not in pages.columns:
        raise ValueError("whether pages are restricted is not known")
    joined = pages.join(s, F.col("page_id") == F.col("_s"), "left")
    failed = F.col("restricted").isNull() | (F.col("error").isNotNull() if "error" in pages.columns else F.lit(False))
    outcome = F.when(F.col("restricted"), RESTRICTED).when(failed, ERROR).when(F.col("_hash").eqNullSafe(F.col("content_hash")), UNCHANGED).otherwise(INDEXED)
    return joined.withColumn("outcome", outcome).drop("_s", "_hash", "restricted")


def stats(judged: DataFrame) -> DataFrame:
    """One row of counters."""
    n = lambda o: F.count_if(F.col("outcome") == o)
    return judged.agg(F.count("*").alias("seen"), n(INDEXED).alias("indexed"), n(RESTRICTED).alias("skipped_restricted"), n(UNCHANGED).alias("skipped_unchanged"), F.lit(0).cast("long").alias("deleted"), n(ERROR).alias("errors"))


def state_rows(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "content_hash", "last_modified", "space_key", "title", "url")


def latest_versions(pages: DataFrame) -> DataFrame:
    """Of pages that a scan met more than once, the one changed last."""
    w = Window.partitionBy("page_id").orderBy(F.col("last_modified").desc(), "content_hash")
    return pages.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def sync(pages: DataFrame, restricted: DataFrame | None, store: Snapshots, on_index: IndexFn = lambda pages: None, purge_restricted: bool = False, on_delete: IndexFn = lambda ids: None) -> dict[str, int]:
    """Judge the pages, index the changed ones, then record them: index first, state second, so that a run that breaks off is repeated.

    purge_restricted: also take pages that have become restricted out of the index (on_delete) and the state. Off, they
    stay as they are.
    """
    store.create()
    state = store.read()
    judged = outcomes(pages, restricted, state).persist()
    try:
        counted = stats(judged).first().asDict()
        changed = latest_versions(judged.where(F.col("outcome") == INDEXED).drop("outcome"))
        if counted["indexed"]:
            on_index(changed)
            store.replace(changed.select("page_id"), state_rows(changed))
        if purge_restricted and counted["skipped_restricted"]:
            gone = judged.where(F.col("outcome") == RESTRICTED).select("page_id").distinct()
            on_delete(gone)
            store.replace(gone)
        if counted["errors"] and "error" in judged.columns:
            for r in judged.where(F.col("outcome") == ERROR).select("page_id", "error").limit(20).collect():
                log.warning("page %s: %s", r.page_id, r.error)
    finally:
        judged.unpersist()
    log.info("sync: %s", counted)
    return counted


def delete_pages(ids: DataFrame, store: Snapshots, index: Snapshots | None = None) -> None:
    """Take pages out of the index, then out of the state."""
    if index is not None:
        index.replace(ids)
    store.replace(ids)
