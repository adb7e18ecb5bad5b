"""Graph operators: truncated spectrum of an item graph, bipartite normalization, propagation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions.text import seeded_unit
from kindred.operators.vectors import sum_vectors
from kindred.session import pin, release


def seeded_normals(ids: DataFrame, key: str, dim: int, seed: int, scale: float) -> DataFrame:
    """(key, vec): reproducible normal draws per id, by Box-Muller on hashed uniforms."""

    def draw(d: int):
        radius = F.sqrt(F.lit(-2.0) * F.log(seeded_unit(seed, F.col(key), F.lit(2 * d))))
        angle = F.lit(2 * np.pi) * seeded_unit(seed, F.col(key), F.lit(2 * d + 1))
        return radius * F.cos(angle) * F.lit(scale)

    return ids.select(key, F.array(*[draw(d) for d in range(dim)]).alias("vec"))


def small_gram(vectors: DataFrame, dim: int) -> np.ndarray:
    """Sum of v v' over all rows: dim * dim sums, whatever the row count."""

    def partial(frames):
        total = None
        for frame in frames:
            if len(frame):
                a = np.stack(frame["vec"].to_numpy()).astype(float)
                total = a.T @ a if total is None else total + a.T @ a
        if total is not None:
            yield pd.DataFrame({"cell": np.arange(dim * dim), "v": total.ravel()})

    cells = vectors.select("vec").mapInPandas(partial, "cell bigint, v double")
    out = np.zeros(dim * dim)
    for row in cells.groupBy("cell").agg(F.sum("v").alias("v")).collect():
        out[row["cell"]] = row["v"]
    return out.reshape(dim, dim)


def _times(vectors: DataFrame, small: np.ndarray) -> DataFrame:
    """Multiply every row by a dim x d matrix held by all tasks."""

    def apply(frames):
        for frame in frames:
            if len(frame):
                rows = np.stack(frame["vec"].to_numpy()).astype(float) @ small
                yield pd.DataFrame({"item": frame["item"], "vec": list(rows)})

    kind = vectors.schema["item"].dataType.simpleString()
    return vectors.mapInPandas(apply, f"item {kind}, vec array<double>")


def _graph_product(edges: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    right = vectors.select(F.col("item").alias("other"), "vec")
    joined = edges.join(right, "other").select("item", "weight", "vec")
    return sum_vectors(joined.groupBy("item"), "vec", dim, weight=F.col("weight"))


def graph_vectors(
    edges: DataFrame,
    n_items: int,
    dim: int = 32,
    iterations: int = 1000,
    width: int = 128,
    seed: int = 42,
    tolerance: float = 1e-6,
) -> DataFrame:
    """(item, vec): V * sqrt(sigma) of the symmetric graph's truncated SVD.

    Subspace iteration: with Y = G Q written once per round, Y'Y is a width x width matrix, the only
    thing the driver sees; its spectrum gives the squared singular values and the next orthonormal
    Q = Y S. Up to ``width`` items the first round is exact; beyond, the surplus over ``dim``
    speeds convergence, and rounds go on until no singular value moves by more than ``tolerance`` of
    the largest; an error says so if ``iterations`` rounds were not enough. Items without edges have
    zero vectors and are left out.
    """
    edges = pin(edges)
    nodes = edges.select("item").distinct()
    found = nodes.count()
    if found == 0:
        return edges.select("item", F.array().cast("array<double>").alias("vec"))
    wide = max(1, min(max(width, 2 * dim), found))
    take = max(1, min(dim, n_items, wide))
    y = pin(seeded_normals(nodes, "item", wide, seed, 1.0))
    small = _whitening(small_gram(y, wide))
    sigma = np.zeros(take)
    for _ in range(max(1, iterations)):
        image = pin(_graph_product(edges, _times(y, small), wide))
        squares, rotation = np.linalg.eigh(small_gram(image, wide))
        best = np.argsort(-squares, kind="stable")[:take]
        fresh = np.sqrt(np.maximum(squares[best], 0.0))
        moved = np.max(np.abs(fresh - sigma)) / max(fresh[0], 1e-300)
        sigma = fresh
        factors = small @ (rotation[:, best] * np.sqrt(sigma))
        if moved <= tolerance or wide == found:
            return _times(y, factors)
        release(y)
        y, small = image, _whitening((rotation * squares) @ rotation.T)
    raise RuntimeError(
        f"spectrum not settled after {max(1, iterations)} rounds: a singular value still moves by "
        f"{moved:.1e} of the largest, tolerance {tolerance:.1e}"
    )


def _whitening(gram: np.ndarray) -> np.ndarray:
    """S with (Y S)'(Y S) = 1 for Y'Y = gram; directions without spread become zero."""
    values, basis = np.linalg.eigh(gram)
    floor = max(values[-1], 1e-300) * 1e-14
    return basis * np.where(values > floor, 1.0 / np.sqrt(np.maximum(values, floor)), 0.0)


# --------------------------------------------------------------------------- bipartite graph


def normalized_edges(ratings: DataFrame) -> DataFrame:
    """(user_id, item_id, weight): 1 / sqrt(degree(user) * degree(item)); values are ignored."""
    users = ratings.groupBy("user_id").agg(F.count(F.lit(1)).alias("du"))
    items = ratings.groupBy("item_id").agg(F.count(F.lit(1)).alias("di"))
    return (
        ratings.join(users, "user_id")
        .join(items, "item_id")
        .select(
            "user_id", "item_id", (F.lit(1.0) / F.sqrt(F.col("du") * F.col("di"))).alias("weight")
        )
    )


def _hop(edges: DataFrame, vectors: DataFrame, source: str, target: str, dim: int) -> DataFrame:
    joined = edges.join(vectors, source).select(target, "weight", "vec")
    return sum_vectors(joined.groupBy(target), "vec", dim, weight=F.col("weight"))


def _plus(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    added = F.when(F.col("_r").isNull(), F.col("vec")).otherwise(
        F.zip_with("vec", "_r", lambda a, b: a + b)
    )
    return left.join(right.withColumnRenamed("vec", "_r"), key, "left").select(
        key, added.alias("vec")
    )


def propagate(
    edges: DataFrame, users: DataFrame, items: DataFrame, layers: int, dim: int
) -> tuple[DataFrame, DataFrame]:
    """Mean of layers 0..L of A^k E for users (user_id, vec) and items (item_id, vec)."""
    if layers < 1:
        raise ValueError("layers must be positive")
    current_u, current_i, total_u, total_i = users, items, users, items
    for _ in range(layers):
        next_u = _hop(edges, current_i, "item_id", "user_id", dim)
        next_i = _hop(edges, current_u, "user_id", "item_id", dim)
        total_u, total_i = _plus(total_u, next_u, "user_id"), _plus(total_i, next_i, "item_id")
        current_u, current_i = next_u, next_i
    share = F.lit(float(layers + 1))
    mean = F.transform("vec", lambda x: x / share).alias("vec")
    return total_u.select("user_id", mean), total_i.select("item_id", mean)
