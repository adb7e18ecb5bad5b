"""Interaction views over the given tables, and prepared data shared by the queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.operators.contract import Columns, normalize
from kindred.operators.split import Prepared, Split, prepare
from kindred.plans.fitted import FittedModel
from kindred.plans.registry import fit_component
from kindred.session import pin

CLICK_ORDER = ["event_id"]
PURCHASE_ORDER = ["ship_us", "l_orderkey", "l_linenumber", "item_id", "l_suppkey", "qty"]
TEMPORAL = Split("temporal", 0.1, 0.2)
SEEDED = Split("user_holdout", 0.1, 0.2, seed=42)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def raw_clicks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        "user_id",
        F.get_json_object("props", "$.k").cast("bigint").alias("item"),
        F.col("value").alias("strength"),
        F.col("ts").alias("at"),
        "event_type",
        "event_id",
    )


def raw_purchases(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate"
    )
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("account"),
        F.col("l_partkey").alias("product"),
        F.col("l_quantity").alias("strength"),
        F.col("l_shipdate").alias("occurred"),
        "l_orderkey",
        F.col("l_linenumber").cast("bigint").alias("l_linenumber"),
        "l_suppkey",
        F.col("l_quantity").cast("bigint").alias("qty"),
    )


def clicks(spark: SparkSession, sf: str, validate: bool = False) -> DataFrame:
    columns = Columns(item_id="item", value="strength", timestamp="at")
    return normalize(raw_clicks(spark, sf), columns, validate)


def purchases(spark: SparkSession, sf: str, validate: bool = False) -> DataFrame:
    columns = Columns("account", "product", "strength", "occurred")
    out = normalize(raw_purchases(spark, sf), columns, validate)
    return out.withColumn("ship_us", F.unix_micros("timestamp"))


def part_catalog(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("item_id"), "p_name", "p_brand", "p_type", "p_size",
        "p_retailprice",
    )


def part_documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("item_id"),
        F.concat_ws(" ", "p_name", "p_type").alias("doc"),
    )


def doc_texts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("doc"))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("item"), F.col("embedding").cast("array<double>").alias("vec")
    )


_PREPARED: dict[tuple[str, str, str], Prepared] = {}
_MODELS: dict[tuple, FittedModel] = {}


def _key(spark: SparkSession, sf: str) -> tuple[str, str]:
    return spark.sparkContext.applicationId, sf


def prepared_clicks(spark: SparkSession, sf: str) -> Prepared:
    """Written once per session and folder, as a prepared dataset is."""
    key = (*_key(spark, sf), "clicks")
    if key not in _PREPARED:
        _PREPARED[key] = prepare(clicks(spark, sf), CLICK_ORDER, TEMPORAL)
    return _PREPARED[key]


def prepared_purchases(spark: SparkSession, sf: str) -> Prepared:
    key = (*_key(spark, sf), "purchases")
    if key not in _PREPARED:
        _PREPARED[key] = prepare(
            purchases(spark, sf), PURCHASE_ORDER, TEMPORAL, catalog=part_catalog(spark, sf)
        )
    return _PREPARED[key]


def model(spark: SparkSession, sf: str, view: str, name: str, **params) -> FittedModel:
    """A fitted model, written once per session and folder, as a model artifact is."""
    key = (*_key(spark, sf), view, name, tuple(sorted(params.items())))
    if key not in _MODELS:
        data = (prepared_clicks if view == "clicks" else prepared_purchases)(spark, sf)
        _MODELS[key] = fit_component(name, data, params)
    return _MODELS[key]


def sessions(spark: SparkSession, sf: str) -> DataFrame:
    """(request_id, pos, item_id, value, timestamp): the training events of each user as a session.

    Every third session lacks a timestamp on its first row, so its given order counts.
    """
    key = (*_key(spark, sf), "sessions")
    if key in _PREPARED:
        return _PREPARED[key]
    from kindred.operators.sequences import ordered_events

    data = prepared_clicks(spark, sf)
    ordered = ordered_events(data.part("train"), data.order, data.hot_users)
    sizes = ordered.groupBy("user_id").agg(F.max("pos").alias("n"))
    # Given in reverse, so that the time order matters where it is complete.
    place = (F.col("n") - F.col("pos") + 1).alias("pos")
    rows = ordered.join(sizes, "user_id")
    timed = F.when(~((F.col("user_id") % 3 == 0) & (F.col("pos") == F.col("n"))), F.col("timestamp"))
    out = pin(rows.select(
        F.col("user_id").alias("request_id"), place, "item_id", "value", timed.alias("timestamp")
    ))
    _PREPARED[key] = out
    return out
