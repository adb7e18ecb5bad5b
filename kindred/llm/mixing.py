"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from kindred.llm.common import WORD, table
from kindred.session import pin

WEIGHTS, CAP = (5, 2, 1), 3
#: Rows in one window of running totals, on average.
ROWS = 20_000
#: What offers are sorted by.
PLACE = {"finish": "double", "name": "string", "key": "string", "size": "long"}


def targets(sizes: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size) -> with weight and target; one row per source.

    Sources by code point, null last, take the weights in turn. They share the sum of all sizes by
    weight; a target stops at cap times its source's size and the excess goes to the others.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    rows = sizes.withColumn("weight", w).withColumn("most", F.lit(cap) * F.col("source_size"))
    ratio = F.col("most") / F.col("weight")
    by_ratio = Window.orderBy("ratio", F.col("source").isNull(), "source")
    rest = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    rows = (
        rows.withColumn("ratio", ratio)
        .withColumn("budget", F.sum("source_size").over(Window.partitionBy()))
        .withColumn("full", F.coalesce(F.sum("most").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("level", (F.col("budget") - F.col("full")) / F.sum("weight").over(rest))
        .withColumn("level", F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "level"))).over(Window.partitionBy())["level"])
    )
    share = F.col("level") * F.col("weight")
    target = F.when(F.col("level").isNull() | (F.col("most") <= share), F.col("most").cast("double")).otherwise(share)
    return rows.select("source", "source_size", "weight", target.alias("target"))


def place_key(seed: str = "mix"):
    """What a row is shuffled by: a hash of doc_id and text."""
    text = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), text))


def mix(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, seed: str = "mix") -> DataFrame:
    """doc_id, size, source, source_size, target, repeats, taken for every row of `docs`.

    Every source is shuffled by a hash and offered `cap` times over. An offer's virtual finish time
    is the words its source has offered up to and with it, divided by the source's target. All
    offers in the order of their finish times are taken until the sum of all sizes is used up.
    A row's place follows from its doc_id and text; rows alike in both stand one behind the other, so that
    some of them can be taken and others not, and it does not matter which.
    Null texts have size 0 and take nothing; null sources are one source; an empty table gives an
    empty table.
    """
    offered = pin(docs.select(
        "doc_id", "source",
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"),
        place_key(seed).alias("key"),
    ))
    sums = pin(targets(offered.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap))
    total, n = sums.agg(F.sum("source_size")).first()[0] or 0, offered.count()
    pieces = max(1, -(-n // ROWS))
    piece = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * pieces / F.lit(2**32)).cast("int")
    # Null sources join as a value of their own.
    name = F.coalesce(F.concat(F.lit("="), "source"), F.lit("null"))
    offered = offered.select("*", piece.alias("piece"), name.alias("name"))
    before = (
        offered.groupBy("name", "piece").agg(F.sum("size").alias("words"))
        .withColumn("before", F.sum("words").over(Window.partitionBy("name").orderBy("piece")) - F.col("words"))
        .drop("words")
    )
    running = F.sum("size").over(Window.partitionBy("name", "piece").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, 0))
    placed = (
        offered.withColumn("running", running)
        .join(before, ["name", "piece"])
        .join(sums.select(name.alias("name"), "source_size", "target"), "name")
        .withColumn("up_to", F.col("before") + F.col("running"))
        .drop("before", "running", "piece")
    )
    placed = pin(placed)

    def finish(turn):
        # Null for sources without words: this is evaluated before their rows are left out.
        return F.try_divide(turn * F.col("source_size") + F.col("up_to"), F.col("target"))

    slots = max(64, -(-n * cap // ROWS))
    offers = (
        placed.where("target > 0 and size > 0").withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(cap - 1))))
        .withColumn("finish", finish(F.col("turn")))
        .withColumn("slot", F.least(F.floor(F.col("finish") * slots), F.lit(4 * slots)).cast("int"))
    )
    filled = offers.groupBy("slot").agg(F.sum("size").alias("words")).withColumn("end", F.sum("words").over(Window.orderBy("slot")))
    last = filled.where(F.col("end") > total).orderBy("slot").first()
    place = F.struct(*PLACE)
    if last is None:
        repeats = F.when((F.col("target") > 0) & (F.col("size") > 0), F.lit(cap)).otherwise(F.lit(0))
    else:
        # Inside the slot that the budget ends in, places are counted one by one.
        ends = offers.where(F.col("slot") == last["slot"]).withColumn("place", place)
        ends = ends.withColumn("end", F.sum("size").over(Window.orderBy("place")) + F.lit(last["end"] - last["words"]))
        cut = ends.where(F.col("end") <= total).agg(F.max("place").alias("cut")).first()["cut"]
        if cut is None:
            within = [F.floor(finish(F.lit(t)) * slots) < last["slot"] for t in range(cap)]
        else:
            edge = F.struct(*[F.lit(cut[x]).cast(kind).alias(x) for x, kind in PLACE.items()])
            within = [F.struct(finish(F.lit(t)).alias("finish"), "name", "key", "size") <= edge for t in range(cap)]
        repeats = sum((F.when(w & (F.col("target") > 0) & (F.col("size") > 0), 1).otherwise(0) for w in within), F.lit(0))
    return placed.select(
        "doc_id", "source", "size", "source_size", "target", repeats.cast("int").alias("repeats"),
        (repeats * F.col("size")).cast("long").alias("taken"), "key",
    )


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS weight, 3 * source_size AS most FROM s),
l AS (SELECT *, most / weight AS ratio,
    (sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY most / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
v AS (SELECT arg_min(level, ratio) AS level FROM l WHERE ratio >= level),
t AS (SELECT source, source_size, CASE WHEN v.level IS NULL OR most <= v.level * weight THEN CAST(most AS DOUBLE) ELSE v.level * weight END AS target FROM l, v),
p AS (SELECT d.*, t.source_size, t.target, coalesce('=' || d.source, 'null') AS name, row_number() OVER () AS row_id,
    sum(size) OVER (PARTITION BY d.source ORDER BY key, size ROWS UNBOUNDED PRECEDING) AS up_to
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
o AS (SELECT p.*, turn, (turn * source_size + up_to) / target AS finish FROM p, (VALUES (0), (1), (2)) e(turn) WHERE size > 0 AND target > 0),
r AS (SELECT *, sum(size) OVER (ORDER BY finish, name, key, size RANGE UNBOUNDED PRECEDING) AS used FROM o),
c AS (SELECT row_id, count(*) AS repeats FROM r WHERE used <= (SELECT sum(size) FROM d) GROUP BY row_id)
SELECT p.doc_id, p.size, p.source_size, p.target, CAST(coalesce(c.repeats, 0) * p.size AS BIGINT) AS taken
FROM p LEFT JOIN c USING (row_id)
"""
