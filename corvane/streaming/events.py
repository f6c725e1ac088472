"""Change events as a stream: each micro-batch syncs or deletes the pages that its events name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T

SYNC, DELETE = "sync", "delete"


def routed(events: DataFrame, payload: str = "value") -> DataFrame:
    """Add page_id, event and action; an event without a page id has the action null."""
    e = events.withColumn("page_id", T.event_page_id(F.col(payload))).withColumn("event", T.event_name(F.col(payload)))
    return e.withColumn("action", F.when(F.col("page_id").isNull(), F.lit(None)).when(T.is_delete(F.col("event")), DELETE).otherwise(SYNC))


def latest(events: DataFrame, key: str = "page_id", order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """The last event of each page. As pages are fetched anew, earlier ones have nothing to add."""
    w = Window.partitionBy(key).orderBy(*(F.col(c).desc() for c in order))
    return events.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def authorised(header: str | None, query: str | None, secret: str) -> bool:
    """Whether the shared secret came by header or else by query. Where none is set, nobody may."""
    import hmac

    return bool(secret) and hmac.compare_digest((header or query or "").encode(), secret.encode())


def sync_stream(events: DataFrame, on_sync: Callable[[DataFrame], None], on_delete: Callable[[DataFrame], None], checkpoint: str, order: tuple[str, ...] = ("seq",), available_now: bool = True) -> StreamingQuery:
    """Run events (value, and the order columns) through. Both actions are idempotent by page id, so a batch that is repeated does no harm.

    on_sync and on_delete get (page_id) frames; the first looks the pages up and syncs them.
    """

    def batch(df: DataFrame, _: int) -> None:
        last = latest(routed(df).where("action is not null"), order=order).select("page_id", "action").persist()
        try:
            on_delete(last.where(F.col("action") == DELETE).select("page_id"))
            on_sync(last.where(F.col("action") == SYNC).select("page_id"))
        finally:
            last.unpersist()

    writer = events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
