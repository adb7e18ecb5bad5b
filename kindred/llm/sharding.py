"""Sharding by vector bin packing: bytes, tokens and rows balanced jointly."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from kindred.llm.common import WORD, table
from kindred.session import pin

SHARDS = 24
#: A group above capacity / LARGE is placed before all others; one above capacity / SPLIT is cut.
LARGE, SPLIT = 64, 8
#: Groups in one task of the packing, and rows in one window of slots, on average.
GROUPS = 20_000
#: Bytes are the law; tokens and rows follow as far as bytes allow.
WEIGHTS = np.array([16.0, 1.0, 1.0])


def pack(items: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Shard of each item (rows of `items`): where its dot product with the room left is highest.

    Larger items first; room and items are in shares of a shard's capacity, weighted. `room` is used up.
    """
    scale = np.maximum(room.max(axis=0), 1e-12)
    parts, left = items / scale * np.sqrt(WEIGHTS), room / scale * np.sqrt(WEIGHTS)
    out = np.zeros(len(items), np.int32)
    for i in np.argsort(-parts[:, 0], kind="stable"):
        s = int(np.argmax(left @ parts[i]))
        out[i] = s
        left[s] -= parts[i]
    room[:] = left / np.sqrt(WEIGHTS) * scale
    return out


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, tokens, text_crc32, shard, slot for every row; law `bytes`: sizes near equal.

    Equal texts are one group and stay together, unless they exceed an eighth of a shard in bytes,
    tokens or rows: then rows are cut into pieces, by a hash of doc_id, or where null or repeated
    doc_ids make that uneven, by place. Large groups (a bounded number) are packed first; the
    others are packed in parallel tasks, each filling its share of the room that is left.
    Null texts are one group of 8 bytes a row (crc of no bytes: 0). An empty table gives an empty table.
    """
    text = F.coalesce("text", F.lit(""))
    rows = pin(docs.select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("tokens"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.when(F.col("text").isNull(), F.lit("null")).otherwise(F.md5(text.cast("binary"))).alias("key"),
        F.monotonically_increasing_id().alias("place"),
    ))
    spark = docs.sparkSession
    total = rows.agg(F.sum("size"), F.sum("tokens"), F.count("*")).first()
    n = total[2]
    capacity = np.array([max(x or 0, 1) for x in total], float) / shards
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows"))
    share = F.greatest(*[F.col(c) / F.lit(float(x)) for c, x in zip(("bytes", "tokens", "rows"), capacity)])
    # At most 3 * shards * SPLIT groups can be this large.
    hot = {r["key"]: int(np.ceil(r["share"] * SPLIT)) for r in groups.select("key", share.alias("share")).where(F.col("share") > 1 / SPLIT).collect()}
    cuts = spark.createDataFrame(list(hot.items()), "key string, cuts int")
    # Ids that hold a large part of a group's piece: rows alike, told apart by their places.
    same = rows.join(F.broadcast(cuts), "key").groupBy("key", "doc_id", "cuts").agg(F.count("*").alias("n"))
    same = same.where(F.col("n") > F.lit(capacity[2] / LARGE)).select(F.col("key").alias("same_key"), F.col("doc_id").alias("same_id"), F.lit(True).alias("alike"))
    found = (F.col("key") == F.col("same_key")) & F.col("doc_id").eqNullSafe(F.col("same_id"))
    rows = rows.join(F.broadcast(cuts), "key", "left").join(F.broadcast(same), found, "left").drop("same_key", "same_id")
    salt = F.when(F.col("alike"), F.xxhash64("place")).otherwise(F.xxhash64(F.coalesce("doc_id", F.lit(0))))
    rows = pin(rows.withColumn("piece", F.pmod(salt, F.coalesce("cuts", F.lit(1))).cast("int")).drop("cuts", "alike"))
    parts = pin(rows.groupBy("key", "piece").agg(
        F.sum("size").cast("double").alias("bytes"), F.sum("tokens").cast("double").alias("tokens"), F.count("*").cast("double").alias("rows")
    ))
    large = (F.col("bytes") > capacity[0] / LARGE) | (F.col("tokens") > capacity[1] / LARGE) | (F.col("rows") > capacity[2] / LARGE)
    first = parts.where(large).orderBy("key", "piece").toPandas()  # at most 3 * LARGE * shards rows
    room = np.tile(capacity, (shards, 1))
    first["shard"] = pack(first[["bytes", "tokens", "rows"]].to_numpy(float), room)
    placed = spark.createDataFrame(first[["key", "piece", "shard"]].values.tolist(), "key string, piece int, shard int")
    share = np.maximum(room, 0)
    share /= np.maximum(share.sum(axis=0), 1e-12)
    tasks = max(1, -(-parts.count() // GROUPS))

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["key", "piece"])
        items = group[["bytes", "tokens", "rows"]].to_numpy(float)
        turn = int(group["task"].iloc[0]) % shards  # ties begin at another shard in each task
        own = np.roll(share, turn, axis=0) * items.sum(axis=0)
        at = (pack(items, own) - turn) % shards
        return pd.DataFrame({"key": group["key"], "piece": group["piece"], "shard": at.astype(np.int32)})

    rest = (
        parts.where(~large).withColumn("task", F.pmod(F.xxhash64("key", "piece"), F.lit(tasks)).cast("int"))
        .groupBy("task").applyInPandas(fill, "key string, piece int, shard int")
    )
    at = pin(rest.union(placed))
    rows = rows.join(at, ["key", "piece"]).withColumn("bin", F.pmod(F.xxhash64("key", "doc_id", "place"), F.lit(max(1, n // GROUPS))).cast("int"))
    rows = pin(rows)
    counts = rows.groupBy("shard", "bin").agg(F.count("*").alias("n"))
    counts = counts.withColumn("before", F.sum("n").over(Window.partitionBy("shard").orderBy("bin")) - F.col("n")).drop("n")
    place = F.row_number().over(Window.partitionBy("shard", "bin").orderBy("key", "doc_id", "place"))
    return rows.withColumn("place", place).join(counts, ["shard", "bin"]).select(
        "doc_id", "size", "tokens", "text_crc32", "shard", (F.col("before") + F.col("place") - 1).alias("slot")
    )


def op6_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens"
    )
