"""Ranking metrics of groups (group, label, score, and a tie-breaker)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def placed(rows: DataFrame, tie: str) -> DataFrame:
    """``rows`` with their place by score and by label. A group is one query's candidates, at most its retrieved ones."""
    by = lambda c: F.row_number().over(Window.partitionBy("group").orderBy(F.col(c).desc(), tie))
    return rows.withColumns({"place": by("score"), "ideal": by("label")})


def evaluate(rows: DataFrame, tie: str) -> DataFrame:
    """One row per group: ndcg_10, mrr, precision_10, recall_100, top1, top5."""
    hit = F.col("label") > 0
    gain = lambda place, k: F.sum(F.when(F.col(place) <= k, (F.pow(F.lit(2.0), F.col("label")) - 1) / F.log2(F.col(place) + 1.0)).otherwise(0.0))
    first = F.min(F.when(hit, F.col("place")))
    within = lambda k: F.count_if(hit & (F.col("place") <= k))
    ideal = gain("ideal", 10)
    return placed(rows, tie).groupBy("group").agg(
        F.round(gain("place", 10) / F.when(ideal == 0, 1.0).otherwise(ideal), 6).alias("ndcg_10"),
        F.round(F.coalesce(1.0 / first, F.lit(0.0)), 6).alias("mrr"),
        F.round(within(10) / F.least(F.lit(10), F.count("*")), 6).alias("precision_10"),
        F.round(F.coalesce(F.try_divide(within(100), F.count_if(hit)), F.lit(0.0)), 6).alias("recall_100"),
        F.when(within(1) > 0, 1.0).otherwise(0.0).alias("top1"),
        F.when(within(5) > 0, 1.0).otherwise(0.0).alias("top5"),
    )


def overall(rows: DataFrame, tie: str) -> DataFrame:
    """The means over groups that have a positive label."""
    some = rows.groupBy("group").agg(F.max("label").alias("m")).where("m > 0").select("group")
    per = evaluate(rows.join(some, "group", "left_semi"), tie)
    return per.agg(*[F.round(F.avg(c), 6).alias(c) for c in per.columns if c != "group"])
