"""Products of sparse tables with themselves: co-occurrence, cosine neighbours, top-n."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kindred.functions.numbers import quantize
from kindred.operators.positions import hot_groups

CELL = 512  # entries of one group that may meet in one cell
DENSE = 16  # products per pair of items from which sums before the shuffle pay
HOT_ITEM = 200_000  # groups of one item that one task may sum
SUMS = 4_000_000  # products that one task sums, about


def _cells(table: DataFrame, group: str, item: str, weight: str, cell: int) -> DataFrame:
    """(g, lo, hi, left, right): the entries (i, w) of two parts of a group that meet in a cell."""
    entries = table.select(
        F.col(group).alias("g"), F.col(item).alias("i"), F.col(weight).cast("double").alias("w")
    )
    sizes = entries.groupBy("g").agg(
        F.ceil(F.count(F.lit(1)) / F.lit(cell)).cast("int").alias("parts")
    )
    part = F.pmod(F.xxhash64("i"), F.col("parts")).cast("int")
    dealt = (
        entries.join(sizes, "g")
        .withColumn("p", part)
        .withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(
            "g", "i", "w", "p", F.least("p", "q").alias("lo"), F.greatest("p", "q").alias("hi")
        )
        .repartition("g", "lo", "hi")
    )
    entry = F.struct("i", "w")
    return dealt.groupBy("g", "lo", "hi").agg(
        F.array_sort(F.collect_list(F.when(F.col("p") == F.col("lo"), entry))).alias("left"),
        F.collect_list(
            F.when((F.col("p") == F.col("hi")) & (F.col("lo") != F.col("hi")), entry)
        ).alias("right"),
    )


def gram(table: DataFrame, group: str, item: str, weight: str, cell: int = CELL) -> DataFrame:
    """(item, other, weight): sums over groups of products of two different items' weights.

    Holds each unordered pair once, item < other. A group is never expanded whole: its entries
    are dealt into parts of about ``cell`` entries, every two parts meet in a cell of their own,
    cells are spread over all tasks by hash, and products are summed before they are shuffled.
    """
    cells = _cells(table, group, item, weight, cell)
    # Inside one part each entry meets the later ones; across parts it meets the other part.
    partners = F.when(
        F.col("lo") == F.col("hi"), F.slice("left", F.col("at") + 2, F.size("left"))
    ).otherwise(F.col("right"))
    pairs = (
        cells.select("lo", "hi", "left", "right", F.posexplode("left").alias("at", "a"))
        .select("a", F.explode(partners).alias("b"))
        .select(
            F.least("a.i", "b.i").alias("item"),
            F.greatest("a.i", "b.i").alias("other"),
            (F.col("a.w") * F.col("b.w")).alias("w"),
        )
    )
    return pairs.groupBy("item", "other").agg(F.sum("w").alias("weight"))


def sum_tasks(spark: SparkSession, products: float) -> int:
    """Tasks for so many products, a bounded number in each."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(products / SUMS))


def gram_both(table: DataFrame, group: str, item: str, weight: str, cell: int = CELL) -> DataFrame:
    """:func:`gram` in both directions.

    Where items outnumber what groups share, hardly any product repeats inside a task, so summing early
    saves nothing. There the entries of a cell travel as one row to the task that sums an item, and sums
    need no further shuffle. Items in too many groups for one task are summed early as in ``gram``.
    """
    sizes = table.groupBy(group).agg(F.count(F.lit(1)).cast("double").alias("n"))
    products = sizes.agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0.0
    items = table.groupBy(item).agg(F.count(F.lit(1)).alias("n"))
    known, unknown = items.agg(F.count(item), F.count_if(F.col(item).isNull())).first()
    if unknown or products > DENSE * float(known) ** 2:
        return mirror(gram(table, group, item, weight, cell))
    cells = _cells(table, group, item, weight, cell)
    sides = F.when(
        F.col("lo") == F.col("hi"), F.array(F.struct(F.col("left").alias("to"), F.col("left").alias("by")))
    ).otherwise(F.array(
        F.struct(F.col("left").alias("to"), F.col("right").alias("by")),
        F.struct(F.col("right").alias("to"), F.col("left").alias("by")),
    ))
    rows = cells.select(F.explode(sides).alias("s")).select(
        F.explode("s.to").alias("a"), F.col("s.by.i").alias("others"), F.col("s.by.w").alias("ws")
    ).select(F.col("a.i").alias("item"), F.col("a.w").alias("w"), "others", "ws")

    def summed(some: DataFrame) -> DataFrame:
        products = some.select("item", "w", F.explode(F.arrays_zip("others", "ws")).alias("b")).where(
            F.col("b.others") != F.col("item")
        ).select("item", F.col("b.others").alias("other"), (F.col("w") * F.col("b.ws")).alias("w"))
        return products.groupBy("item", "other").agg(F.sum("w").alias("weight"))

    hot = hot_groups(table.select(F.col(item).alias("item")), ["item"], HOT_ITEM)
    parts = sum_tasks(table.sparkSession, products)
    if hot is None:
        return summed(rows.repartition(parts, "item"))
    keys = F.broadcast(hot.select("item"))
    calm = rows.join(keys, "item", "left_anti").repartition(parts, "item")
    return summed(calm).unionByName(summed(rows.join(keys, "item", "left_semi")))


def mirror(pairs: DataFrame) -> DataFrame:
    """Both directions of a table of unordered pairs."""
    both = F.array(
        F.struct(F.col("item").alias("a"), F.col("other").alias("b")),
        F.struct(F.col("other").alias("a"), F.col("item").alias("b")),
    )
    return pairs.select(F.explode(both).alias("p"), "weight").select(
        F.col("p.a").alias("item"), F.col("p.b").alias("other"), "weight"
    )


def top_neighbours(edges: DataFrame, n: int) -> DataFrame:
    """Best ``n`` positive neighbours per item; ties go to the lower id."""
    ranked = Window.partitionBy("item").orderBy(F.col("weight").desc(), F.col("other"))
    return (
        edges.withColumn("weight", quantize(F.col("weight")))
        .where(F.col("weight") > 0)
        .withColumn("rank", F.row_number().over(ranked).cast("bigint"))
        .where(F.col("rank") <= n)
    )


def item_norms(ratings: DataFrame) -> DataFrame:
    return ratings.groupBy("item_id").agg(
        F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm")
    )


def cosine_neighbours(ratings: DataFrame, neighbours: int = 100, cell: int = CELL) -> DataFrame:
    """(item, other, weight, rank): item cosine over users, pruned to the top positive ones."""
    norms = item_norms(ratings).where(F.col("norm") > 0)
    unit = ratings.join(norms, "item_id").select(
        "user_id", "item_id", (F.col("value") / F.col("norm")).alias("w")
    ).where(F.col("w") != 0)
    return top_neighbours(gram_both(unit, "user_id", "item_id", "w", cell), neighbours)


def cooccurrence(ratings: DataFrame, min_count: int = 1, cell: int = CELL) -> DataFrame:
    """(item, other, weight): users holding both items, zero-valued entries included."""
    ones = ratings.select("user_id", "item_id", F.lit(1.0).alias("w"))
    return gram_both(ones, "user_id", "item_id", "w", cell).where(F.col("weight") >= min_count)
