"""Shared pieces: reading tables, components of a link table, blocks of large groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from kindred.session import pin, release

#: What a word is, for sizes: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_key(column: str = "text"):
    """128 bits of a text; null and empty texts are alike."""
    return F.unhex(F.md5(F.coalesce(F.col(column).cast("binary"), F.lit("").cast("binary"))))


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links of any ordered type -> (node, root); root is the least node of its component.

    Alternates large-star and small-star steps, each an aggregate and a join, so a hub is never
    gathered in one task. The table of links is written after every round.
    """
    a, b = F.greatest("a", "b"), F.least("a", "b")
    links = pin(edges.where("a <> b").select(a.alias("a"), b.alias("b")).distinct())
    before = None
    while True:
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before or now[0] == 0:
            break
        before = now
        both = links.union(links.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = pin(small.union(lowest.select("a", F.col("m").alias("b"))).distinct())
        release(links)
        links = after
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)


def in_blocks(rows: DataFrame, group: str, member: str, block: int) -> DataFrame:
    """Groups of two and more, cut into blocks; each pair of blocks becomes one piece of work.

    Adds `own` (the row's block), `left`, `right` (the pair of blocks this copy is for). A group of
    n rows has n / block blocks, so a piece holds about 2 * block rows whatever n is.
    """
    sizes = rows.groupBy(group).agg(F.count("*").alias("members")).where("members > 1")
    cut = rows.join(sizes, group).withColumn("blocks", F.ceil(F.col("members") / block).cast("int"))
    cut = cut.withColumn("own", F.pmod(F.xxhash64(member), F.col("blocks")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return cut.select(
        *rows.columns, "own", F.least("own", "other").alias("left"), F.greatest("own", "other").alias("right")
    )


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows of the same keys next to each other in one partition."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, *keys).sortWithinPartitions(*keys)


def runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Consecutive rows with equal keys, whole, out of batches of any cut."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        change = np.zeros(len(batch), bool)
        for key in keys:
            values = batch[key].to_numpy()
            change[1:] |= values[1:] != values[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), len(batch)]
        for start, stop in zip(cuts[:-1], cuts[1:]):
            piece = batch.iloc[start:stop]
            if held and start == 0 and any(held[-1][k].iloc[0] != piece[k].iloc[0] for k in keys):
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held.append(piece)
            if stop < len(batch):
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def whole_runs(batches: Iterator[pd.DataFrame], keys: list[str], rows: int = 20_000) -> Iterator[tuple[pd.DataFrame, list[int]]]:
    """Rows of many whole groups at once, with the places where a group begins, and the end.

    Groups are of bounded size here, so a piece holds about `rows` rows and one group more.
    """
    held: list[pd.DataFrame] = []
    many = 0

    def cut(piece: pd.DataFrame) -> list[int]:
        change = np.ones(len(piece), bool)
        change[1:] = False
        for key in keys:
            values = piece[key].to_numpy()
            change[1:] |= values[1:] != values[:-1]
        return [*np.flatnonzero(change).tolist(), len(piece)]

    for batch in batches:
        held.append(batch)
        many += len(batch)
        if many < rows:
            continue
        piece = pd.concat(held, ignore_index=True)
        bounds = cut(piece)
        if len(bounds) > 2:  # the last group may go on
            yield piece.iloc[: bounds[-2]], bounds[:-1]
            piece = piece.iloc[bounds[-2] :]
        held, many = [piece], len(piece)
    piece = pd.concat(held, ignore_index=True) if held else pd.DataFrame()
    if len(piece):
        yield piece, cut(piece)


def forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Component label of 0..n-1 under the links left[i] - right[i]: the least index."""
    label = np.arange(n)
    while len(left):
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        new = new[new[new]]
        new = np.minimum(new, new[label])
        if (new == label).all():
            break
        label = new
    return label
