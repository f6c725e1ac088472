"""Retrieval quality: hit rate and mean reciprocal rank over pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def page_ranks(results: DataFrame) -> DataFrame:
    """results (qid, page_id, rank) of chunks: each page once, at its first place, ranks without gaps."""
    first = results.groupBy("qid", "page_id").agg(F.min("rank").alias("_first"))
    return first.select("qid", "page_id", F.row_number().over(Window.partitionBy("qid").orderBy("_first", "page_id")).alias("rank"))


def first_hit(pages: DataFrame, questions: DataFrame) -> DataFrame:
    """(qid, first): of pages (qid, rank, gold), the rank of the first gold one for each question, 0 if there is none."""
    hit = pages.where("gold").groupBy("qid").agg(F.min("rank").alias("first"))
    return questions.select("qid").join(hit, "qid", "left").select("qid", F.coalesce("first", F.lit(0)).alias("first"))


def first_gold(pages: DataFrame, questions: DataFrame) -> DataFrame:
    """``first_hit`` where questions (qid, gold_page_ids) name their gold pages."""
    gold = questions.select("qid", F.explode("gold_page_ids").alias("page_id")).distinct()
    return first_hit(pages.join(gold, ["qid", "page_id"]).withColumn("gold", F.lit(True)), questions)


def metrics(firsts: DataFrame, k: int = 5) -> DataFrame:
    """hit_rate (within k) and mrr (over all ranks) of the questions."""
    f = F.col("first")
    return firsts.agg(F.avg(F.when((f > 0) & (f <= k), 1.0).otherwise(0.0)).alias("hit_rate"), F.avg(F.when(f > 0, F.lit(1.0) / f).otherwise(0.0)).alias("mrr"))


def misses(firsts: DataFrame, k: int = 5) -> DataFrame:
    """The questions whose first gold page is beyond rank k, or nowhere."""
    return firsts.where((F.col("first") == 0) | (F.col("first") > k))


def all_ok(checks: DataFrame, by: str) -> DataFrame:
    """Of checks (by, state), whether each group's are all ok; the engine's health is such a group."""
    return checks.groupBy(by).agg(F.every(F.col("state") == "ok").alias("ok"))
