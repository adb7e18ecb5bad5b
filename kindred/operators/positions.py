"""Row positions inside groups, safe when one group holds a large share of all rows.

A plain ``row_number`` window sorts a whole group in one task. Groups past a size threshold are
cut into ordered buckets first: every bucket is numbered on its own, and the rows of the earlier
buckets are added as an offset. Results are the same; only the work is spread.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.session import pin

HOT_ROWS = 2_000_000  # rows one task may sort without help
MAX_HOT_GROUPS = 65_536  # proven bound: hot groups hold more than total / MAX_HOT_GROUPS rows
BUCKETS_PER_GROUP = 512
SAMPLES_PER_BUCKET = 32


def hot_groups(df: DataFrame, group: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """Keys (with ``n`` rows each) too large for one task, or None when there are none."""
    spark = df.sparkSession
    counts = df.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    total, largest = counts.agg(F.sum("n"), F.max("n")).first()
    if largest is None or largest <= hot_rows:
        return None
    threshold = max(hot_rows, total // MAX_HOT_GROUPS)
    rows = counts.where(F.col("n") > threshold).collect()
    return spark.createDataFrame(rows, counts.schema) if rows else None


def _split_points(
    hot_df: DataFrame, hot: DataFrame, group: Sequence[str], key: Column, hot_rows: int
) -> DataFrame:
    """Ordered split points per hot group, taken from a sample and fixed on the driver.

    Their choice affects only how evenly the buckets fill, never a position.
    """
    spark = hot_df.sparkSession
    sized = hot.withColumn(
        "buckets", F.least(F.ceil(F.col("n") / F.lit(hot_rows)) + 1, F.lit(BUCKETS_PER_GROUP))
    )
    rows, buckets = sized.agg(F.sum("n"), F.sum("buckets")).first()
    fraction = min(1.0, SAMPLES_PER_BUCKET * buckets / rows)
    sample = hot_df.select(*group, key.alias("_key")).sample(fraction, seed=17)
    points = (
        sample.groupBy(*group)
        .agg(F.array_sort(F.collect_list("_key")).alias("_keys"))
        .join(F.broadcast(sized), [*group])
        .withColumn("_step", F.greatest(F.floor(F.size("_keys") / F.col("buckets")), F.lit(1)))
        .select(
            *group,
            F.expr("filter(_keys, (k, i) -> i > 0 and i % _step = 0)").alias("_splits"),
        )
    )
    return spark.createDataFrame(points.collect(), points.schema)


def group_positions(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    out: str = "pos",
    hot: DataFrame | None | str = "detect",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add the 1-based position of each row in its group, ascending by ``order``.

    ``order`` must be a total order inside a group. ``hot`` takes the result of
    :func:`hot_groups` when the caller already has it.
    """
    group = list(group)
    if not group:
        return _global_positions(df, order, out, hot_rows)
    if isinstance(hot, str):
        hot = hot_groups(df, group, hot_rows)
    window = Window.partitionBy(*group)
    if hot is None:
        return df.withColumn(out, F.row_number().over(window.orderBy(*order)).cast("bigint"))
    # Hot and ordinary rows go separate ways, so ordinary rows keep the plain single shuffle.
    keys = F.broadcast(hot.select(*group))
    calm = df.join(keys, group, "left_anti")
    calm = calm.withColumn(out, F.row_number().over(window.orderBy(*order)).cast("bigint"))
    hot_df = df.join(keys, group, "left_semi")
    return calm.unionByName(_bucketed(hot_df, hot, group, order, out, hot_rows))


def _bucketed(
    hot_df: DataFrame,
    hot: DataFrame,
    group: list[str],
    order: Sequence[Column],
    out: str,
    hot_rows: int,
) -> DataFrame:
    key = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    splits = _split_points(hot_df, hot, group, key, hot_rows)
    placed = (
        hot_df.withColumn("_key", key)
        .join(F.broadcast(splits), group, "left")
        .withColumn(
            "_bucket", F.expr("coalesce(size(filter(_splits, s -> s <= _key)), 0)")
        )
        .drop("_splits")
    )
    sizes = placed.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = sizes.select(
        *group, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    # At most one row per hot group and bucket: bounded by construction.
    local = Window.partitionBy(*group, "_bucket").orderBy("_key")
    return (
        placed.withColumn("_rn", F.row_number().over(local))
        .join(F.broadcast(offsets), [*group, "_bucket"])
        .withColumn(out, (F.col("_rn") + F.col("_offset")).cast("bigint"))
        .select(*hot_df.columns, out)
    )


def _global_positions(df: DataFrame, order: Sequence[Column], out: str, rows: int) -> DataFrame:
    """Positions among all rows: one range sort, rows counted in every sorted part.

    The sorted parts are written once, so that a row keeps its part and its place in it.
    """
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows))
    keys = [o.alias(f"_o{i}") for i, o in enumerate(order)]
    names = [f"_o{i}" for i in range(len(keys))]
    dealt = df.select("*", *keys).repartitionByRange(parts, *names).sortWithinPartitions(*names)
    placed = pin(dealt.drop(*names).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33).alias("_part")
    sizes = placed.groupBy(part).agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    # One row a part.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).select("_part", "_first", "_before")
    number = F.col("_before") + F.col("_id") - F.col("_first") + 1
    return placed.withColumn("_part", F.shiftright("_id", 33)).join(F.broadcast(starts), "_part").select(
        *df.columns, number.cast("bigint").alias(out)
    )


def chunked(
    df: DataFrame, group: Sequence[str], context: int, chunk: int = 1_000_000, pos: str = "pos"
) -> DataFrame:
    """Cut long groups into chunks that repeat the ``context`` rows before them.

    Adds ``_chunk`` and ``_own``; windows partitioned by (group, _chunk) then see the same
    preceding rows as a window over the whole group, for rows with ``_own`` true.
    """
    chunk = max(chunk, context + 1)
    home = F.floor((F.col(pos) - 1) / F.lit(chunk)).cast("bigint")
    last = (F.col(pos) - 1) % F.lit(chunk) >= F.lit(chunk - context)
    return (
        df.withColumn("_home", home)
        .withColumn(
            "_chunk",
            F.explode(
                F.when(last, F.array("_home", F.col("_home") + 1)).otherwise(F.array("_home"))
            ),
        )
        .withColumn("_own", F.col("_chunk") == F.col("_home"))
        .drop("_home")
    )


def first_free(
    excluded: DataFrame, need: DataFrame, group: str, total: int | Column, pos: str = "pos",
    hot: DataFrame | None | str = None, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """The first ``need`` positions of 1..total that are not excluded, per group.

    ``excluded`` holds (group, pos), ``need`` holds (group, need). With the excluded positions in
    order, e_j - j free positions lie before the j-th; it stands in the way exactly while that
    is less than ``need``. So only those are counted, and ``need`` + that count positions are
    written out: no groups times positions product.
    """
    need = need.where(F.col("need") > 0).select(group, "need")
    excluded = excluded.select(group, pos)
    sizes = excluded.groupBy(group).agg(F.count(F.lit(1)).alias("_size"))
    near = (
        excluded.join(need.join(sizes, group), group)
        .where(F.col(pos) <= F.col("need") + F.col("_size"))
    )
    ranked = group_positions(near, [group], [F.col(pos)], "_j", hot=hot, hot_rows=hot_rows)
    blocked = (
        ranked.where(F.col(pos) - F.col("_j") < F.col("need"))
        .groupBy(group)
        .agg(F.count(F.lit(1)).alias("_blocked"))
    )
    limit = F.lit(total) if isinstance(total, int) else total
    upper = F.least(limit, F.col("need") + F.coalesce(F.col("_blocked"), F.lit(0)))
    spans = need.join(blocked, group, "left").withColumn("_upper", upper.cast("bigint"))
    listed = spans.where(F.col("_upper") >= 1).select(
        group, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_upper"))).alias(pos)
    )
    return listed.join(excluded, [group, pos], "left_anti")
