"""Greedy packing to a token budget, as folds over arrays: no Python, no shuffle, one row at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import sentences, token_estimate

Counter = Callable[[Column], Column]
PACK = "struct<done:array<string>,held:string,n:int>"


def _pack(done: Column, held: Column, n: Column) -> Column:
    return F.struct(done.alias("done"), held.alias("held"), n.alias("n"))


def _start() -> Column:
    return F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("held"), F.lit(0).alias("n")).cast(PACK)


def _flushed(s: Column) -> Column:
    return F.when(s["held"].isNotNull(), F.array_append(s["done"], s["held"])).otherwise(s["done"])


def split_text(text: Column, budget: Column, count: Counter = token_estimate) -> Column:
    """Pieces of a text for a budget. A text that fits stays as it is. Else sentences are packed while the sum of
    their counts fits; a sentence over budget is cut by words, each piece closing with the word that reaches the budget,
    and the words left open the next piece."""

    def word(s: Column, w: Column) -> Column:
        held = F.when(s["held"].isNull(), w).otherwise(F.concat_ws(" ", s["held"], w))
        full = count(held) >= budget
        return F.when(full, _pack(F.array_append(s["done"], held), F.lit(None).cast("string"), F.lit(0))).otherwise(_pack(s["done"], held, F.lit(0)))

    def step(s: Column, x: Column) -> Column:
        n = count(x)
        words = F.filter(F.split(x, r"(?U)\s+"), lambda w: w != "")
        cut = F.aggregate(words, _pack(_flushed(s), F.lit(None).cast("string"), F.lit(0)), word, lambda a: _pack(a["done"], a["held"], F.when(a["held"].isNull(), 0).otherwise(count(F.coalesce(a["held"], F.lit("")))).cast("int")))
        over = s["n"] + n > budget
        joined = F.when(s["held"].isNull(), x).otherwise(F.concat_ws(" ", s["held"], x))
        packed = F.when(over, _pack(_flushed(s), x, n)).otherwise(_pack(s["done"], joined, s["n"] + n))
        return F.when(n > budget, cut).otherwise(packed)

    pieces = F.aggregate(F.filter(F.transform(sentences(text), lambda x: F.trim(x)), lambda x: x != ""), _start(), step, _flushed)
    return F.when(count(text) <= budget, F.array(text)).otherwise(F.filter(pieces, lambda p: p != ""))


def split_lines(body: Column, budget: Column, count: Counter = token_estimate, repeat_header: bool = False) -> Column:
    """Pieces of a table or of code, cut between lines; a table's first line is repeated on each. A line over budget
    makes a piece of its own. A table of a header alone gives nothing."""
    lines = F.split(body, "\n")
    head = F.element_at(lines, 1)
    rest = F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))) if repeat_header else lines

    def step(s: Column, x: Column) -> Column:
        joined = F.concat_ws("\n", s["held"], x)
        over = s["held"].isNotNull() & (count(F.concat(head, F.lit("\n"), joined) if repeat_header else joined) > budget)
        return F.when(over, _pack(_flushed(s), x, F.lit(0))).otherwise(_pack(s["done"], F.when(s["held"].isNull(), x).otherwise(joined), F.lit(0)))

    pieces = F.aggregate(rest, _start(), step, _flushed)
    if repeat_header:
        pieces = F.transform(pieces, lambda p: F.when(head != "", F.concat(head, F.lit("\n"), p)).otherwise(p))
    return F.filter(pieces, lambda p: F.trim(F.regexp_replace(p, r"(?U)\s", "")) != "")
