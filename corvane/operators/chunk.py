"""Blocks to chunks that know the headings they stand under.

Everything is an expression over the array of a page's blocks: a fold keeps the heading stack and gathers text runs, two
more folds cut runs, tables and code to their budgets. A page is one row throughout, so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.folds import Counter, split_lines, split_text

MAX_TOKENS, HARD_MAX_TOKENS = 512, 5000
SEPARATOR = "\n\n"
_STACK = "array<struct<level:int,text:string>>"
_UNIT = "struct<path:string,body:string,kind:string>"
_STATE = f"struct<units:array<{_UNIT}>,stack:{_STACK},run:string>"


def _path(crumb: Column, stack: Column) -> Column:
    return T.join_filled(F.concat(F.array(crumb), F.transform(stack, lambda h: h["text"])), T.BREADCRUMB_SEPARATOR)


def units(blocks: Column, crumb: Column) -> Column:
    """array<struct<path, body, kind>>: a run of text blocks, a table or code, with the breadcrumb of its section."""

    def unit(path: Column, body: Column, kind: Column) -> Column:
        return F.struct(path.alias("path"), body.alias("body"), kind.alias("kind"))

    def state(made: Column, stack: Column, run: Column) -> Column:
        return F.struct(made.alias("units"), stack.alias("stack"), run.alias("run"))

    none = F.lit(None).cast("string")

    def flushed(s: Column) -> Column:
        return F.when(s["run"].isNotNull(), F.array_append(s["units"], unit(_path(crumb, s["stack"]), s["run"], F.lit("text")))).otherwise(s["units"])

    def step(s: Column, b: Column) -> Column:
        level = F.coalesce(b["level"], F.lit(4))
        deeper = F.array_append(F.filter(s["stack"], lambda h: h["level"] < level), F.struct(level.alias("level"), b["text"].alias("text")))
        text = state(s["units"], s["stack"], F.when(s["run"].isNull(), b["text"]).otherwise(F.concat(s["run"], F.lit(SEPARATOR), b["text"])))
        whole = state(F.array_append(flushed(s), unit(_path(crumb, s["stack"]), b["text"], b["kind"])), s["stack"], none)
        return F.when(b["kind"] == "heading", state(flushed(s), deeper, none)).when(b["kind"].isin("table", "code"), whole).otherwise(text)

    start = F.struct(F.array().cast(f"array<{_UNIT}>").alias("units"), F.array().cast(_STACK).alias("stack"), none.alias("run")).cast(_STATE)
    return F.aggregate(blocks, start, step, flushed)


def chunk_pages(pages: DataFrame, max_tokens: int = MAX_TOKENS, hard_max_tokens: int = HARD_MAX_TOKENS, count: Counter = T.token_estimate, blocks: str = "blocks") -> DataFrame:
    """pages: page_id, breadcrumb and an array of blocks; other columns come along. One row per chunk.

    A run of text is cut to what max_tokens leaves beside the breadcrumb; tables and code stay whole up to
    hard_max_tokens. Ordinals count the chunks of a page from 0.
    """
    u = F.col("u")
    reserve = count(T.chunk_text(u["path"], F.lit("")))
    soft = F.greatest(F.lit(1), F.lit(max_tokens) - reserve)
    hard = F.greatest(F.lit(1), F.lit(hard_max_tokens) - reserve)
    fits = count(u["body"]) <= hard
    pieces = (
        F.when(u["kind"] == "text", split_text(u["body"], soft, count))
        .when(fits, F.array(u["body"]))
        .when(u["kind"] == "table", split_lines(u["body"], hard, count, repeat_header=True))
        .otherwise(split_lines(u["body"], hard, count))
    )
    rest = [c for c in pages.columns if c not in (blocks, "breadcrumb")]
    runs = pages.select(*rest, F.posexplode(units(F.col(blocks), F.col("breadcrumb"))).alias("unit", "u"))
    cut = runs.select(*rest, "unit", "u", ((u["kind"] != "text") & fits).alias("whole"), F.posexplode(pieces).alias("piece", "body"))
    cut = cut.where(F.trim(F.regexp_replace("body", r"(?U)\s", "")) != "")
    cut = numbered(cut, "unit", "piece")
    text = T.chunk_text(u["path"], F.col("body"))
    return cut.select(*rest, "ordinal", "chunk_id", u["path"].alias("breadcrumb"), text.alias("text"), count(text).alias("token_count"), u["kind"].alias("kind"), "whole")


def numbered(pieces: DataFrame, *order: str) -> DataFrame:
    """Add ordinal, which counts the pieces of a page from 0, and chunk_id."""
    out = pieces.withColumn("ordinal", F.row_number().over(Window.partitionBy("page_id").orderBy(*order)) - 1)
    return out.withColumn("chunk_id", T.chunk_id(F.col("page_id"), F.col("ordinal")))


def heading_paths(blocks: DataFrame) -> DataFrame:
    """The heading path of each row of a blocks table (page_id, pos, kind, text, level), for tables too large a page for one row.

    A heading is open if no later one up to here has a lower level. One window over the page finds the last heading of
    each level, with its text, and the last of all lower levels; nothing is joined.
    """
    w = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    heading = F.col("kind") == "heading"
    last = lambda test, value: F.last(F.when(heading & test, value), ignorenulls=True).over(w)
    level = F.col("level")
    found = {f"_h{n}": last(level == n, F.struct("pos", "text")) for n in range(1, 5)} | {f"_a{n}": last(level < n, F.col("pos")) for n in range(2, 5)}
    segment = F.sum(F.when(F.col("kind") != "text", 1).otherwise(0)).over(w)
    out = blocks.select("page_id", "pos", "kind", segment.alias("segment"), *(c.alias(name) for name, c in found.items()))
    open_ = [F.when(F.col(f"_h{n}.pos") > (F.coalesce(F.col(f"_a{n}"), F.lit(-1)) if n > 1 else F.lit(-1)), F.col(f"_h{n}.text")) for n in range(1, 5)]
    return out.select("page_id", "pos", "kind", T.join_filled(F.array(*open_), T.BREADCRUMB_SEPARATOR).alias("path"), "segment")
