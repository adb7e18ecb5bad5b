"""Embedding near-duplicates: random-hyperplane tables, exact cosines, components."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from kindred.llm.common import components, dealt, forest, in_blocks, runs, table
from kindred.session import pin

COSINE = 0.95
#: Wanted share of the pairs at the threshold that meet in some table, and extra bits of a table
#: beyond log2(rows), so that unlike vectors seldom meet.
RECALL, SPARE_BITS = 0.999, 4
BLOCK = 1024


def shape(n: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int]:
    """(bits, tables) for n vectors: each table is met with (1 - angle / pi) ** bits."""
    bits = min(48, max(8, math.ceil(math.log2(max(n, 2))) + SPARE_BITS))
    meet = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - meet))


def _clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        classes, units = [], []
        for v in batch["embedding"]:
            x = None if v is None or not len(v) else np.array(v, dtype=float) + 0.0
            if x is None or not np.isfinite(x).all() or not x.any():
                classes.append(None)
                units.append(None)
                continue
            classes.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest())
            x = x / np.abs(x).max()
            units.append((x / np.sqrt(x @ x)).tobytes())
        yield pd.DataFrame({"vec_id": batch["vec_id"].astype("Int64"), "class": classes, "unit": units})


def _tables(bits: int, tables: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes: dict[int, np.ndarray] = {}
        powers = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            width = batch["unit"].map(len).to_numpy() // 8
            for d in np.unique(width):
                part = batch[width == d]
                x = np.frombuffer(b"".join(part["unit"]), float).reshape(len(part), d)
                if d not in planes:
                    planes[d] = np.random.default_rng([d, bits]).normal(size=(tables * bits, d))
                signs = (x @ planes[d].T > 0).reshape(len(part), tables, bits)
                where = (signs * powers).sum(axis=2)
                ids = part["class"].to_numpy()
                for t in range(tables):
                    key = where[:, t] + ((np.int64(t) + (np.int64(d) << 12)) << np.int64(bits))
                    yield pd.DataFrame({"bucket": key, "class": ids})

    return run


def _linked(piece: pd.DataFrame, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    own, n = piece["own"].to_numpy(), len(piece)
    x = np.frombuffer(b"".join(piece["unit"]), float).reshape(n, -1)
    first, second = np.flatnonzero(own == piece["left"].iloc[0]), np.flatnonzero(own == piece["right"].iloc[0])
    i, j = np.nonzero(x[first] @ x[second].T >= threshold)
    i, j = first[i], second[j]
    if piece["left"].iloc[0] == piece["right"].iloc[0]:
        keep = i < j
        i, j = i[keep], j[keep]
    return i, j


def _near(threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for piece in runs(batches, ["bucket", "left", "right"]):
            label = forest(len(piece), *_linked(piece, threshold))
            far = label != np.arange(len(piece))
            if far.any():
                ids = piece["class"].to_numpy()
                yield pd.DataFrame({"a": ids[far], "b": ids[label[far]]})

    return run


def _counted(threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for piece in runs(batches, ["root", "left", "right"]):
            i, j = _linked(piece, threshold)
            copies = piece["copies"].to_numpy()
            links = np.bincount(i, copies[j], len(piece)) + np.bincount(j, copies[i], len(piece))
            some = links > 0
            if some.any():
                yield pd.DataFrame({"class": piece["class"].to_numpy()[some], "links": links[some].astype(np.int64)})

    return run


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of (vec_id, embedding).

    Buckets of the tables give candidate pairs, whose cosines are computed in double precision; their
    links make components. All pairs inside a component are then compared, so a pair that no table
    brought together still counts if its two vectors are connected otherwise. Equal vectors are
    compared once. Vectors that are null, empty, zero or hold null or non-finite values, and rows
    without vec_id, link with nothing: n_links 0, component_id = vec_id, kept if vec_id is not
    null. Vectors of different lengths are never linked. Repeated rows are linked with each other.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    rows = pin(rows.mapInPandas(_clean, "vec_id long, class binary, unit binary"))
    # Only the bucket of a vector and its hash move; vectors follow where a bucket is shared.
    usable = rows.where("class is not null and vec_id is not null")
    classes = pin(usable.groupBy("class").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"), F.first("unit").alias("unit")))
    bits, tables = shape(classes.count(), cosine)
    keys = pin(classes.select("class", "unit").mapInPandas(_tables(bits, tables), "bucket long, class binary"))
    shared = keys.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1").select("bucket")
    met = keys.join(shared, "bucket").join(classes.select("class", "unit"), "class")
    edges = dealt(in_blocks(met, "bucket", "class", BLOCK), "bucket", "left", "right").mapInPandas(_near(cosine), "a binary, b binary")
    roots = pin(components(edges).withColumnRenamed("node", "class").join(classes, "class"))
    pieces = dealt(in_blocks(roots.drop("least"), "root", "class", BLOCK), "root", "left", "right")
    counts = pieces.mapInPandas(_counted(cosine), "class binary, links long").groupBy("class").agg(F.sum("links").alias("links"))
    least = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    placed = roots.select("class", "root").join(least, "root").drop("root")
    found = classes.drop("unit").join(counts, "class", "left").join(placed, "class", "left").select(
        "class", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "least").alias("component_id")
    )
    linked = F.col("vec_id").isNotNull()
    out = rows.select("vec_id", "class").join(pin(found), "class", "left")
    component = F.when(linked & F.col("component_id").isNotNull(), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select(
        "vec_id", F.when(linked, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
        component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )


def op5_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
