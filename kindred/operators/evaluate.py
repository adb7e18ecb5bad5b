"""Ranking metrics over users with held-out items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def user_metrics(recommended: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(user_id, hits, relevant, recall, ndcg) for every user with at least one true item.

    ``recommended`` is (user_id, item_id, rank), ``truth`` is (user_id, item_id).
    """
    truth = truth.select("user_id", "item_id").distinct()
    relevant = truth.groupBy("user_id").agg(F.count(F.lit(1)).alias("relevant"))
    gain = F.lit(1.0) / F.log2(F.col("rank") + 1)
    hits = (
        recommended.where(F.col("rank") <= k)
        .join(truth, ["user_id", "item_id"])
        .groupBy("user_id")
        .agg(F.count(F.lit(1)).alias("hits"), F.sum(gain).alias("dcg"))
    )
    # k is a small report depth; the ideal gain of min(k, relevant) hits is a k-entry sum.
    ideal = F.aggregate(
        F.sequence(F.lit(1), F.least(F.lit(k), F.col("relevant")).cast("int")),
        F.lit(0.0),
        lambda total, rank: total + F.lit(1.0) / F.log2(rank + 1),
    )
    none = F.lit(0)
    return relevant.join(hits, "user_id", "left").select(
        "user_id",
        F.coalesce("hits", none).alias("hits"),
        "relevant",
        (F.coalesce("hits", none) / F.col("relevant")).alias("recall"),
        (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg"),
    )


def ranking_metrics(recommended: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """One row (recall, ndcg, evaluated_users); zeros when nobody has a true item."""
    return user_metrics(recommended, truth, k).agg(
        F.coalesce(F.avg("recall"), F.lit(0.0)).alias("recall"),
        F.coalesce(F.avg("ndcg"), F.lit(0.0)).alias("ndcg"),
        F.count(F.lit(1)).alias("evaluated_users"),
    )
