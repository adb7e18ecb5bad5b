"""Structured Streaming: every row of the stream is one whole request, by a user or by a session."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from kindred.plans.serving import Server
from kindred.session import pin, pin_scope


def split_requests(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of `Server.request_schema` as (requests, interactions)."""
    requests = rows.select("request_id", "user_id", "top_k", "exclude_seen")
    interactions = rows.select("request_id", F.posexplode("interactions").alias("pos", "i")).select(
        "request_id", (F.col("pos") + 1).cast("bigint").alias("pos"), F.col("i.item_id").alias("item_id"),
        F.coalesce("i.value", F.lit(1.0)).alias("value"), F.col("i.timestamp").alias("timestamp"),
    )
    return requests, interactions


def recommend_stream(
    server: Server, stream: DataFrame, sink: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Answer a stream of requests (`Server.request_schema`); stateless, so no watermark.

    Each micro-batch overwrites its own folder, so a replayed batch leaves no duplicates, and drops
    every copy it has written on the way.
    """

    def write(batch: DataFrame, number: int) -> None:
        with pin_scope():
            found, status = server.answer(*split_requests(pin(batch)))
            found.write.mode("overwrite").parquet(f"{sink}/recommendations/batch={number}")
            status.write.mode("overwrite").parquet(f"{sink}/status/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if available_now else writer.start()
