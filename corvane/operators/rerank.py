"""Reranking with a pluggable score, and the threshold below which nothing counts as an answer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

TOP_N, SCORE_MIN = 5, 0.3
Score = Callable[[Column, Column], Column]


def overlap(question: Column, text: Column) -> Column:
    """The share of the question's terms that the text holds: the default score, for use without a model."""
    asked = F.array_distinct(T.terms(question))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(asked, T.terms(text))), F.size(asked)), F.lit(0.0))


def rerank(candidates: DataFrame, score: Score | None = overlap, top_n: int | None = TOP_N, score_min: float | None = SCORE_MIN, order: str = "rank") -> DataFrame:
    """candidates (qid, question, text, rank, ...): those that reach score_min, best first, ties in the order they had, top_n of each question.

    top_n: None and 0 stand for the default. score_min: None stands for the default, 0 is 0. score: None if
    the candidates have a column score already.
    """
    scored = candidates if score is None else candidates.withColumn("score", score(F.col("question"), F.col("text")))
    least = SCORE_MIN if score_min is None else score_min
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col(order))
    best = scored.where(F.col("score") >= least).withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= (top_n or TOP_N))
    return best.drop(order).withColumnRenamed("_place", order)


def reordered(candidates: DataFrame, score: Score | None = overlap, order: str = "rank") -> DataFrame:
    """All candidates by score, for evaluation."""
    return rerank(candidates, score, 1 << 30, 0.0, order)
