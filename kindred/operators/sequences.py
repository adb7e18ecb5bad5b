"""Ordered interaction sequences: positions, adjacent pairs, last items, prefixes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.operators.positions import chunked, group_positions


def sequence_keys(train: DataFrame, order: Sequence[str]) -> list[Column]:
    """Timestamp counts only when every training row has one; then row order."""
    row = [F.col(c) for c in order]
    if "timestamp" not in train.columns:
        return row
    complete = train.where(F.col("timestamp").isNull()).isEmpty()
    return [F.col("timestamp"), *row] if complete else row


def ordered_events(
    train: DataFrame, order: Sequence[str], hot: DataFrame | None | str = "detect"
) -> DataFrame:
    """Training events with ``pos``, the 1-based place in the user's sequence.

    This long form is the sequence table: a user's list is never collected whole.
    """
    return group_positions(train, ["user_id"], sequence_keys(train, order), "pos", hot=hot)


def transitions(ordered: DataFrame) -> DataFrame:
    """(item_id, next_item, n): adjacent pairs of the same user, counted."""
    rows = chunked(ordered.select("user_id", "item_id", "pos"), ["user_id"], context=1)
    window = Window.partitionBy("user_id", "_chunk").orderBy("pos")
    pairs = rows.select(
        F.lag("item_id").over(window).alias("item_id"), F.col("item_id").alias("next_item"), "_own"
    ).where(F.col("_own") & F.col("item_id").isNotNull())
    return pairs.groupBy("item_id", "next_item").agg(F.count(F.lit(1)).alias("n"))


def transition_probabilities(pairs: DataFrame) -> DataFrame:
    """(item_id, other, weight): transition counts divided by their row total."""
    totals = pairs.groupBy("item_id").agg(F.sum("n").alias("total"))
    return pairs.join(totals, "item_id").select(
        "item_id", F.col("next_item").alias("other"), (F.col("n") / F.col("total")).alias("weight")
    )


def last_items(train: DataFrame, order: Sequence[str]) -> DataFrame:
    """(user_id, item_id) of each user's latest training event."""
    keys = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(sequence_keys(train, order))])
    return train.groupBy("user_id").agg(F.max_by("item_id", keys).alias("item_id"))


def recent_items(ordered: DataFrame, length: int, group: str = "user_id") -> DataFrame:
    """(group, items): the last ``length`` items, oldest first; ``length`` bounds the array."""
    latest = Window.partitionBy(group).orderBy(F.col("pos").desc())
    kept = ordered.withColumn("_r", F.row_number().over(latest)).where(F.col("_r") <= length)
    return kept.groupBy(group).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("pos", "item_id"))), lambda x: x["item_id"]
        ).alias("items")
    )


def pad_left(items: Column, length: int, padding: Column) -> Column:
    return F.concat(F.array_repeat(padding, F.lit(length) - F.size(items)), items)


def prefix_examples(ordered: DataFrame, max_length: int, item: str = "item_id") -> DataFrame:
    """(user_id, pos, prefix, target): up to ``max_length`` items before each later event."""
    rows = chunked(ordered.select("user_id", "pos", item), ["user_id"], context=max_length)
    window = Window.partitionBy("user_id", "_chunk").orderBy("pos")
    return (
        rows.withColumn("prefix", F.collect_list(item).over(window.rowsBetween(-max_length, -1)))
        .where(F.col("_own") & (F.size("prefix") > 0))
        .select("user_id", "pos", "prefix", F.col(item).alias("target"))
    )


def request_order(interactions: DataFrame) -> DataFrame:
    """Place in the request: by time when every row of the request has one, else as given.

    A request holds at most 5000 interactions, so the window is bounded by contract.
    """
    request = Window.partitionBy("request_id")
    if "timestamp" not in interactions.columns:
        return interactions.withColumn(
            "rank", F.row_number().over(request.orderBy("pos")).cast("bigint")
        )
    complete = F.min(F.col("timestamp").isNotNull()).over(request)
    timed = interactions.withColumn("_time", F.when(complete, F.unix_micros("timestamp")))
    window = request.orderBy(F.col("_time"), F.col("pos"))
    return timed.withColumn("rank", F.row_number().over(window).cast("bigint")).drop("_time")
