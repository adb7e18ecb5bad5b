"""Readers: CSV, Parquet, MovieLens, Yelp and a generator, behind one dispatch."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.functions.text import seeded_key
from kindred.functions.times import from_unix_seconds, to_utc
from kindred.operators.contract import Columns, ContractError
from kindred.session import hadoop_path, pin

# File names of the public exports, tried in this order.
MOVIELENS_FILES = ("ratings.csv", "ratings.dat")
YELP_FILES = ("reviews.parquet", "reviews.csv", "review.json")
RATINGS_DAT = "user_id bigint, item_id bigint, value double, timestamp bigint"


def path_exists(spark: SparkSession, path: str) -> bool:
    file_system, target = hadoop_path(spark, path)
    return file_system.exists(target)


def discover(spark: SparkSession, path: str, candidates: Sequence[str]) -> str:
    """The path itself, or in a directory the first candidate that exists (else the first)."""
    if any(path.endswith("." + c.rsplit(".", 1)[-1]) for c in candidates):
        return path
    found = [f"{path}/{c}" for c in candidates if path_exists(spark, f"{path}/{c}")]
    return found[0] if found else f"{path}/{candidates[0]}"


def read_table(
    spark: SparkSession, path: str, fmt: str | None = None, schema: T.StructType | str | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """CSV or Parquet by format or suffix. Give a schema for big CSVs: inference reads them twice.

    Quoted CSV fields may hold doubled quotes, and line breaks with ``multi_line``, for which one task
    must read a whole file.
    """
    kind = (fmt or path.rsplit(".", 1)[-1]).lower()
    if kind == "csv":
        reader = spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line)
        reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
        return reader.csv(path)
    if kind in ("parquet", "pq"):
        reader = spark.read.schema(schema) if schema else spark.read
        return reader.parquet(path)
    raise ContractError(f"unsupported table format: {kind}")


def _finish(df: DataFrame, time, what: str) -> DataFrame:
    if not {"user_id", "item_id"} <= set(df.columns):
        raise ContractError(f"{what} data must hold user and item identifiers")
    if "value" not in df.columns:
        df = df.withColumn("value", F.lit(1.0))
    if "timestamp" not in df.columns:
        return df
    bad = df.where(F.col("timestamp").isNotNull() & time.isNull())
    if not bad.isEmpty():
        raise ContractError(f"{what} timestamps are not readable")
    return df.withColumn("timestamp", time)


def read_movielens(spark: SparkSession, path: str) -> DataFrame:
    """ratings.csv (userId, movieId, rating, timestamp) or ratings.dat (:: separated)."""
    source = discover(spark, path, MOVIELENS_FILES)
    if source.endswith(".dat"):
        df = spark.read.schema(RATINGS_DAT).option("sep", "::").csv(source)
    else:
        names = {"userId": "user_id", "movieId": "item_id", "rating": "value"}
        # Ratings are numbers, without line breaks: large files are split.
        df = read_table(spark, source, "csv", multi_line=False).withColumnsRenamed(names)
    return _finish(df, from_unix_seconds(F.expr("try_cast(timestamp AS double)")), "MovieLens")


def read_yelp(spark: SparkSession, path: str) -> DataFrame:
    """Reviews as Parquet, CSV or JSON lines (business_id, stars, date)."""
    source = discover(spark, path, YELP_FILES)
    if source.endswith(".json"):
        df = spark.read.json(source)
    else:
        df = read_table(spark, source, "parquet" if source.endswith(".parquet") else "csv")
    df = df.withColumnsRenamed({"business_id": "item_id", "stars": "value", "date": "timestamp"})
    kind = df.schema["timestamp"].dataType if "timestamp" in df.columns else T.StringType()
    return _finish(df, to_utc("timestamp", kind), "Yelp")


def synthetic(
    spark: SparkSession, users: int = 32, items: int = 64, per_user: int = 12, seed: int = 42
) -> DataFrame:
    """Deterministic interactions: item = (5 i + 7 user) mod items, one event per day.

    Each user's ``per_user`` events (the bound of the window) come in a seeded order.
    """
    if users < 1 or items < 3 or not 3 <= per_user <= items:
        raise ContractError("need users >= 1, items >= 3 and 3 <= per_user <= items")
    cells = spark.range(users * per_user).select(
        F.floor(F.col("id") / per_user).cast("bigint").alias("u"),
        (F.col("id") % per_user).alias("i"),
    )
    shuffled = Window.partitionBy("u").orderBy(seeded_key(seed, F.col("u"), F.col("i")), "i")
    placed = cells.withColumn("offset", F.row_number().over(shuffled) - 1)
    item = (F.col("i") * 5 + F.col("u") * 7) % items
    day = F.col("u") * per_user + F.col("offset")
    start = F.lit("2020-01-01T00:00:00Z").cast("timestamp")
    return placed.select(
        F.format_string("user-%04d", F.col("u")).alias("user_id"),
        F.format_string("item-%05d", item).alias("item_id"),
        F.lit(1.0).alias("value"),
        F.timestamp_micros(F.unix_micros(start) + day * F.lit(86_400_000_000)).alias("timestamp"),
        F.concat(F.lit("group-"), (item % 5).cast("string")).alias("category"),
        day.cast("bigint").alias("event_order"),
    )


def with_row_order(df: DataFrame, column: str = "event_order") -> DataFrame:
    """Number the rows of files, from 1: by file path, then by place in the file.

    A task reads a stretch of a file from its start, so counting the rows of every stretch gives the
    numbers without a sort; how files are packed into tasks makes no difference. Rows are written out
    once. A table that comes from no file is numbered as it happens to be read.
    """
    try:
        named = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
        named.schema  # noqa: B018 - resolves the hidden column
    except AnalysisException:
        named = df.withColumns({"_file": F.lit(""), "_block": F.spark_partition_id().cast("bigint")})
    rows = pin(named.withColumn("_id", F.monotonically_increasing_id()))
    stretches = rows.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    # One row a stretch.
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    stretches = stretches.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    placed = rows.join(stretches, ["_file", "_block"])
    number = F.col("_before") + F.col("_id") - F.col("_first") + 1
    return placed.select(*df.columns, number.alias(column))


def _from_synthetic(spark, config) -> tuple[DataFrame, Columns]:
    p = config.get("parameters", {})
    frame = synthetic(
        spark, int(p.get("users", 32)), int(p.get("items", 64)),
        int(p.get("interactions_per_user", 12)), int(config.get("seed", 42)),
    )
    return frame, Columns(value="value", timestamp="timestamp")


def _from_table(spark, config) -> tuple[DataFrame, Columns]:
    if not config.get("path"):
        raise ContractError("the tabular adapter needs a path")
    frame = read_table(
        spark, config["path"], config.get("format"), config.get("schema"), bool(config.get("multi_line", False))
    )
    return frame, Columns(**config.get("columns", {}))


def _from_export(reader: Callable[[SparkSession, str], DataFrame]):
    def read(spark, config) -> tuple[DataFrame, Columns]:
        if not config.get("path"):
            raise ContractError("this adapter needs a path")
        # Exports have fixed names; a configured mapping does not apply.
        return reader(spark, config["path"]), Columns(value="value", timestamp="timestamp")

    return read


ADAPTERS: dict[str, Callable[[SparkSession, dict[str, Any]], tuple[DataFrame, Columns]]] = {
    "synthetic": _from_synthetic,
    "tabular": _from_table,
    "movielens": _from_export(read_movielens),
    "yelp": _from_export(read_yelp),
}


def load_interactions(
    spark: SparkSession, config: dict[str, Any]
) -> tuple[DataFrame, Columns, list[str]]:
    """(table, column mapping, order columns) for a dataset configuration."""
    name = config.get("name", "synthetic")
    if name not in ADAPTERS:
        raise ContractError(f"unknown dataset adapter: {name}")
    frame, columns = ADAPTERS[name](spark, config)
    order = list(config.get("order") or [])
    if not order:
        order = ["event_order"]
        if "event_order" not in frame.columns:
            frame = with_row_order(frame)
    return frame, columns, order
