"""Shared training parts: integer nodes, pair sampling, parameter tables and Adam steps.

Parameters keyed by id stay DataFrames; a step is joins, a summed gradient and an element-wise
update. Users are the negative nodes, items the positive ones, so one table holds both.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions.text import seeded_unit
from kindred.operators.graph import seeded_normals
from kindred.operators.positions import group_positions
from kindred.operators.scoring import marks_ahead
from kindred.operators.split import Prepared, dense_index
from kindred.operators.vectors import sum_vectors
from kindred.session import pin, release

BETA1, BETA2, EPSILON = 0.9, 0.999, 1e-8


@dataclass(frozen=True)
class Training:
    seed: int = 42
    epochs: int = 2
    batch_size: int = 128
    learning_rate: float = 0.001

    @staticmethod
    def of(params: dict) -> "Training":
        known = {k: params[k] for k in ("seed", "epochs", "batch_size", "learning_rate")
                 if k in params}
        return Training(**known)

    def steps(self, params: dict, entries: int) -> int:
        per_epoch = int(params.get("steps", max(1, entries // max(1, self.batch_size))))
        return max(1, self.epochs) * per_epoch


# --------------------------------------------------------------------------- nodes and samples


@dataclass
class NodeSpace:
    """Users (user_id, node < 0), items (item_id, node > 0), entries (user, item, value)."""

    users: DataFrame
    items: DataFrame
    entries: DataFrame
    n_users: int
    n_items: int
    hot: DataFrame | None = None

    @staticmethod
    def of(prepared: Prepared) -> "NodeSpace":
        users = pin(dense_index(prepared.users, "user_id", "pos").select(
            "user_id", (-F.col("pos")).alias("node")
        ))
        items = prepared.indexed_items.select("item_id", F.col("pos").alias("node"))
        entries = pin(
            prepared.ratings("train")
            .join(users.withColumnRenamed("node", "user"), "user_id")
            .join(items.withColumnRenamed("node", "item"), "item_id")
            .select("user", "item", "value")
        )
        hot = prepared.hot_users
        if hot is not None:
            hot = hot.join(users, "user_id").select(F.col("node").alias("user"), "n")
        return NodeSpace(users, items, entries, prepared.n_users, prepared.n_items, hot)


def sample_pairs(space: NodeSpace, size: int, steps: int, seed: int) -> DataFrame:
    """(step, user, positive, negative): ``size`` draws for every step.

    Users are uniform over those with a stored and an unseen item; the positive is uniform over
    the user's stored entries, the negative uniform over the items without one. Draws are hashes,
    so they do not depend on partitioning, and negatives are found by counting, not by retrying.
    """
    spark = space.entries.sparkSession
    degrees = space.entries.groupBy("user").agg(F.count(F.lit(1)).alias("stored"))
    eligible = degrees.where(F.col("stored") < space.n_items)
    eligible = pin(group_positions(eligible, [], [-F.col("user")], "at"))
    n = eligible.count()
    if n == 0:
        raise ValueError("pair sampling needs a user with both stored and unseen items")
    placed = pin(group_positions(
        space.entries.select("user", "item"), ["user"], [F.col("item")], "at", hot=space.hot
    ))

    def below(part: int, limit: Column) -> Column:
        draw = F.floor(seeded_unit(seed, F.col("draw"), F.lit(part)) * limit)
        return F.least(draw, limit - 1).cast("bigint")

    draws = (
        spark.range(size * steps)
        .select(F.col("id").alias("draw"), F.floor(F.col("id") / F.lit(size)).alias("step"))
        .withColumn("at", below(0, F.lit(n)) + 1)
        .join(eligible, "at")
        .select(
            "draw", "step", "user",
            (below(1, F.col("stored")) + 1).alias("at"),
            below(2, F.lit(space.n_items) - F.col("stored")).alias("free"),
        )
    )
    positives = draws.join(placed, ["user", "at"]).select(
        "draw", "step", "user", F.col("item").alias("positive"), "free"
    )
    # item - at unseen items lie before a stored entry; it precedes the (free + 1)-th unseen item
    # exactly when that count does not exceed free. Draws and entries of a user are sorted together.
    marks = placed.select(F.col("user").alias("request_id"), (F.col("item") - F.col("at")).alias("pos"))
    points = draws.select(F.col("user").alias("request_id"), F.col("free").alias("pos"), "draw")
    ahead = marks_ahead(points, marks, space.hot).select("draw", "ahead")
    negative = F.col("free") + 1 + F.coalesce("ahead", F.lit(0))
    return positives.join(ahead, "draw", "left").select(
        F.col("step").cast("bigint").alias("step"), "user", "positive", negative.alias("negative")
    )


# --------------------------------------------------------------------------- parameter tables


def all_nodes(space: NodeSpace) -> DataFrame:
    return space.users.select("node").unionByName(space.items.select("node"))


def normal_parameters(nodes: DataFrame, dim: int, seed: int, scale: float = 0.02) -> DataFrame:
    return pin(with_moments(seeded_normals(nodes, "node", dim, seed, scale), dim))


def uniform_parameters(nodes: DataFrame, dim: int, seed: int, limit: Column) -> DataFrame:
    cells = [
        (seeded_unit(seed, F.col("node"), F.lit(d)) * 2 - 1) * limit for d in range(dim)
    ]
    return pin(with_moments(nodes.select("node", F.array(*cells).alias("vec")), dim))


def with_moments(vectors: DataFrame, dim: int) -> DataFrame:
    zero = F.array_repeat(F.lit(0.0), dim)
    return vectors.select("node", "vec", zero.alias("m"), zero.alias("v"))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def scale(a: Column, factor: Column) -> Column:
    return F.transform(a, lambda x: x * factor)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def summed_gradient(rows: DataFrame, dim: int) -> DataFrame:
    """(node, g) from gradient rows (node, g)."""
    return sum_vectors(rows.groupBy("node"), "g", dim)


def adam_step(
    parameters: DataFrame, gradient: DataFrame, dim: int, step: int, rate: float
) -> DataFrame:
    """One Adam update of a parameter table; ids without gradient still follow their moments."""
    zero = F.array_repeat(F.lit(0.0), dim)
    joined = parameters.join(gradient, "node", "left").withColumn("g", F.coalesce("g", zero))
    moved = joined.select(
        "node", "vec",
        F.zip_with("m", "g", lambda m, g: m * BETA1 + g * (1 - BETA1)).alias("m"),
        F.zip_with("v", "g", lambda v, g: v * BETA2 + g * g * (1 - BETA2)).alias("v"),
    )
    c1, c2 = 1 - BETA1**step, 1 - BETA2**step
    move = F.zip_with("m", "v", lambda m, v: (m / c1) / (F.sqrt(v / c2) + EPSILON) * rate)
    updated = pin(moved.select("node", subtract(F.col("vec"), move).alias("vec"), "m", "v"))
    release(parameters)
    return updated


@dataclass
class DenseAdam:
    """Adam for the few dense weights that every task needs; they live on the driver."""

    weights: dict[str, np.ndarray]
    rate: float
    step: int = 0
    m: dict[str, np.ndarray] = field(default_factory=dict)
    v: dict[str, np.ndarray] = field(default_factory=dict)

    def update(self, gradient: dict[str, np.ndarray]) -> None:
        self.step += 1
        for name, g in gradient.items():
            self.m[name] = BETA1 * self.m.get(name, 0.0) + (1 - BETA1) * g
            self.v[name] = BETA2 * self.v.get(name, 0.0) + (1 - BETA2) * g * g
            m_hat = self.m[name] / (1 - BETA1**self.step)
            v_hat = self.v[name] / (1 - BETA2**self.step)
            self.weights[name] = self.weights[name] - self.rate * m_hat / (np.sqrt(v_hat) + EPSILON)


def pack(weights: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([weights[k].ravel() for k in sorted(weights)])


def unpack(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        size = like[k].size
        out[k] = flat[at : at + size].reshape(like[k].shape)
        at += size
    return out


DENSE_NODE = 0  # gradient rows of the dense weights travel under the unused node 0


def dense_gradient(rows: DataFrame, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Sum of the flattened gradients that tasks emitted under DENSE_NODE."""
    cells = (
        rows.where(F.col("node") == DENSE_NODE)
        .select(F.posexplode("g").alias("cell", "x"))
        .groupBy("cell")
        .agg(F.sum("x").alias("x"))
    )
    flat = np.zeros(sum(w.size for w in like.values()))
    for row in cells.collect():
        flat[row["cell"]] = row["x"]
    return unpack(flat, like)


def linear(rng: np.random.Generator, fan_in: int, fan_out: int) -> tuple[np.ndarray, np.ndarray]:
    limit = 1.0 / np.sqrt(fan_in)
    return (
        rng.uniform(-limit, limit, (fan_in, fan_out)), rng.uniform(-limit, limit, fan_out)
    )
