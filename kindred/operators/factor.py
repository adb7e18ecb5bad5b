"""Pairwise models on parameter tables: matrix factorization, LightGCN, two towers."""

from __future__ import annotations

from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.operators import blocks
from kindred.operators.split import Prepared
from kindred.operators.training import (
    DENSE_NODE,
    DenseAdam,
    NodeSpace,
    Training,
    adam_step,
    all_nodes,
    dense_gradient,
    linear,
    normal_parameters,
    pack,
    sample_pairs,
    scale,
    subtract,
    summed_gradient,
    uniform_parameters,
    unpack,
)
from kindred.operators.vectors import dot, sum_vectors
from kindred.plans.fitted import HISTORY, KNOWN_USER, FittedModel
from kindred.session import pin, release


def _embedding_model(
    plugin: str, space: NodeSpace, vectors: DataFrame, dim: int, modes: tuple[str, ...], **params
) -> FittedModel:
    users = space.users.join(vectors, "node").select("user_id", "vec")
    items = space.items.join(vectors, "node").select(F.col("item_id").alias("item"), "vec")
    tables = {"users": pin(users), "items": pin(items)}
    return FittedModel(plugin, "embedding", modes, tables, {"dim": dim, **params})


#: Pairs of a batch whose vectors and gradients go to all tasks as a whole, three rows a pair.
SENT = 1 << 16


def sent(rows: DataFrame, size: int | None) -> DataFrame:
    """Rows of a batch of ``size`` pairs, marked to go to all tasks where the batch bounds them."""
    return F.broadcast(rows) if size is not None and size <= SENT else rows


def with_vectors(batch: DataFrame, vectors: DataFrame, size: int | None = None) -> DataFrame:
    """Attach u, p, n: the vectors of each pair's user, positive and negative.

    The nodes of a batch of few pairs go to the vectors, and those found to the pairs, so that the
    table of all vectors is neither shuffled nor sorted.
    """
    if size is not None and size <= SENT:
        nodes = batch.select(F.explode(F.array("user", "positive", "negative")).alias("node")).distinct()
        vectors = vectors.join(sent(nodes, size), "node", "left_semi")
    out = batch
    for key, name in (("user", "u"), ("positive", "p"), ("negative", "n")):
        side = vectors.select(F.col("node").alias(key), F.col("vec").alias(name))
        out = out.join(sent(side, size), key)
    return out


def pair_gradient(joined: DataFrame, size: int, extra: Column | None = None) -> DataFrame:
    """(node, g) rows of mean -log sigmoid(u.p - u.n); ``extra`` adds further (node, g) structs."""
    margin = dot(F.col("u"), subtract(F.col("p"), F.col("n")))
    pull = (-F.lit(1.0) / (F.lit(1.0) + F.exp(margin)) / size).alias("c")
    rows = joined.withColumn("c", pull)
    parts = F.array(
        F.struct(F.col("user").alias("node"),
                 scale(subtract(F.col("p"), F.col("n")), F.col("c")).alias("g")),
        F.struct(F.col("positive").alias("node"), scale(F.col("u"), F.col("c")).alias("g")),
        F.struct(F.col("negative").alias("node"), scale(F.col("u"), -F.col("c")).alias("g")),
    )
    return rows.select(F.explode(parts).alias("r")).select("r.node", "r.g")


def pair_table(space: NodeSpace, training: Training, params: dict[str, Any], entries: int) -> tuple[DataFrame, int, int]:
    """(pairs, batch size, steps); a step's pairs lie in a folder of their own and are all that it reads."""
    size, steps = max(1, training.batch_size), training.steps(params, entries)
    return pin(sample_pairs(space, size, steps, training.seed), by="step"), size, steps


def of_step(pairs: DataFrame, step: int) -> DataFrame:
    return pairs.where(F.col("step") == step)


def bpr_step(table: DataFrame, batch: DataFrame, size: int, dim: int, step: int, rate: float) -> DataFrame:
    """One step on a batch of pairs; ``table`` is (node, vec, m, v)."""
    gradient = summed_gradient(pair_gradient(with_vectors(batch, table, size), size), dim)
    return adam_step(table, sent(gradient, size), dim, step, rate)


def of_block(pairs: DataFrame, low: int, high: int) -> DataFrame:
    """The pairs of steps low .. high - 1, which are numbered from 1 for Adam."""
    return pairs.where(F.col("step").between(low, high - 1)).select(
        (F.col("step") + 1).alias("step"), "user", "positive", "negative"
    )


def bpr_blocks(table: DataFrame, pairs: DataFrame, size: int, dim: int, steps: int, rate: float) -> DataFrame:
    """(node, vec) after all steps; as many of them at a time as :func:`blocks.block_steps` allows."""

    def gradient(step, u, p, n):
        c = (-1.0 / (1.0 + np.exp(np.einsum("ij,ij->i", u, p - n))) / size)[:, None]
        return (p - n) * c, u * c, u * -c

    many, moved = blocks.block_steps(size, dim), blocks.start(table)
    release(table)
    for low in range(0, steps, many):
        moved = blocks.run_block(moved, of_block(pairs, low, min(steps, low + many)), dim, rate, gradient)
    return pin(blocks.finish(moved, dim, rate, steps))


def fit_bpr(prepared: Prepared, params: dict[str, Any]) -> FittedModel:
    """Matrix factorization with pairwise ranking loss and Adam on the factor table."""
    training, dim = Training.of(params), int(params.get("embedding_dim", 32))
    space = NodeSpace.of(prepared)
    pairs, size, steps = pair_table(space, training, params, prepared.ratings("train").count())
    table = normal_parameters(all_nodes(space), dim, training.seed)
    if blocks.block_steps(size, dim):
        vectors = bpr_blocks(table, pairs, size, dim, steps, training.learning_rate)
        return _embedding_model("bpr", space, vectors, dim, (HISTORY, KNOWN_USER))
    for step in range(steps):
        table = bpr_step(table, of_step(pairs, step), size, dim, step + 1, training.learning_rate)
    return _embedding_model("bpr", space, table.select("node", "vec"), dim, (HISTORY, KNOWN_USER))


# --------------------------------------------------------------------------- LightGCN


def node_arcs(space: NodeSpace) -> DataFrame:
    """(node, other, weight) in both directions, 1 / sqrt(degree * degree)."""
    du = space.entries.groupBy("user").agg(F.count(F.lit(1)).alias("du"))
    di = space.entries.groupBy("item").agg(F.count(F.lit(1)).alias("di"))
    weight = F.lit(1.0) / F.sqrt(F.col("du") * F.col("di"))
    edges = space.entries.join(du, "user").join(di, "item").select("user", "item", weight.alias("w"))
    both = F.array(
        F.struct(F.col("user").alias("node"), F.col("item").alias("other")),
        F.struct(F.col("item").alias("node"), F.col("user").alias("other")),
    )
    return edges.select(F.explode(both).alias("e"), "w").select("e.node", "e.other", "w")


def propagate_nodes(arcs: DataFrame, vectors: DataFrame, layers: int, dim: int) -> DataFrame:
    """Mean of layers 0..L of A^k E over one node table (node, vec)."""
    total, current = vectors, vectors
    for _ in range(layers):
        spread = arcs.join(current.withColumnRenamed("node", "other"), "other")
        current = sum_vectors(spread.groupBy("node"), "vec", dim, weight=F.col("w"))
        total = total.unionByName(current)
    mean = sum_vectors(total.groupBy("node"), "vec", dim)
    return mean.select("node", scale(F.col("vec"), F.lit(1.0 / (layers + 1))).alias("vec"))


def lightgcn_step(
    table: DataFrame, arcs: DataFrame, batch: DataFrame, size: int, dim: int, layers: int, l2: float, step: int, rate: float
) -> DataFrame:
    """One step: gradients of the propagated vectors, propagated back, and the decay of the drawn rows."""
    start = table.select("node", "vec")
    joined = with_vectors(batch, propagate_nodes(arcs, start, layers, dim), size)
    outer = summed_gradient(pair_gradient(joined, size), dim)
    back = propagate_nodes(arcs, outer.withColumnRenamed("g", "vec"), layers, dim)
    uses = batch.select(F.explode(F.array("user", "positive", "negative")).alias("node"))
    decay = uses.groupBy("node").agg(F.count(F.lit(1)).alias("k")).join(start, "node").select(
        "node", scale(F.col("vec"), F.col("k") * (2 * l2 / size)).alias("g")
    )
    rows = back.withColumnRenamed("vec", "g").unionByName(decay)
    return adam_step(table, summed_gradient(rows, dim), dim, step, rate)


def fit_lightgcn(prepared: Prepared, params: dict[str, Any]) -> FittedModel:
    """The adjacency is symmetric, so gradients flow back through the same propagation."""
    training, dim = Training.of(params), int(params.get("embedding_dim", 32))
    layers, l2 = int(params.get("layers", 2)), float(params.get("l2", 0.0001))
    if layers < 1:
        raise ValueError("layers must be positive")
    space = NodeSpace.of(prepared)
    pairs, size, steps = pair_table(space, training, params, prepared.ratings("train").count())
    arcs = pin(node_arcs(space))
    side = F.when(F.col("node") < 0, F.lit(space.n_users)).otherwise(F.lit(space.n_items))
    limit = F.sqrt(F.lit(6.0) / (side + dim))
    table = uniform_parameters(all_nodes(space), dim, training.seed, limit)
    for step in range(steps):
        table = lightgcn_step(
            table, arcs, of_step(pairs, step), size, dim, layers, l2, step + 1, training.learning_rate
        )
    vectors = propagate_nodes(arcs, table.select("node", "vec"), layers, dim)
    return _embedding_model("lightgcn", space, pin(vectors), dim, (KNOWN_USER,), layers=layers)


# --------------------------------------------------------------------------- two towers


def tower_weights(hidden: int, dim: int, seed: int) -> dict[str, np.ndarray]:
    rng, weights = np.random.default_rng(seed), {}
    for side in ("u", "i"):
        weights[side + "W1"], weights[side + "b1"] = linear(rng, hidden, hidden)
        weights[side + "W2"], weights[side + "b2"] = linear(rng, hidden, dim)
    return weights


def tower_forward(x: np.ndarray, w: dict[str, np.ndarray], side: str):
    """Linear, ReLU, linear, L2 norm; returns the output and what the backward pass needs."""
    a = x @ w[side + "W1"] + w[side + "b1"]
    h = np.maximum(a, 0.0)
    z = h @ w[side + "W2"] + w[side + "b2"]
    norm = np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    return z / norm, (x, a, h, norm)


def tower_backward(g: np.ndarray, y: np.ndarray, cache, w: dict[str, np.ndarray], side: str):
    x, a, h, norm = cache
    gz = (g - y * (g * y).sum(axis=1, keepdims=True)) / norm
    gh = gz @ w[side + "W2"].T * (a > 0)
    grads = {
        side + "W2": h.T @ gz, side + "b2": gz.sum(axis=0),
        side + "W1": x.T @ gh, side + "b1": gh.sum(axis=0),
    }
    return gh @ w[side + "W1"].T, grads


def two_tower_gradient(u, p, n, w: dict[str, np.ndarray], size: int):
    """Feature gradients and tower gradients of the mean pairwise loss."""
    yu, cu = tower_forward(u, w, "u")
    yp, cp = tower_forward(p, w, "i")
    yn, cn = tower_forward(n, w, "i")
    margin = (yu * (yp - yn)).sum(axis=1, keepdims=True)
    c = -1.0 / (1.0 + np.exp(margin)) / size
    gu, du = tower_backward(c * (yp - yn), yu, cu, w, "u")
    gp, dp = tower_backward(c * yu, yp, cp, w, "i")
    gn, dn = tower_backward(-c * yu, yn, cn, w, "i")
    total = {**du, **{k: dp[k] + dn[k] for k in dp}}
    return gu, gp, gn, total


def tower_blocks(table: DataFrame, pairs: DataFrame, size: int, hidden: int, steps: int, towers: DenseAdam) -> DataFrame:
    """(node, vec) after all steps, which also move ``towers``; blocks as in :func:`bpr_blocks`."""
    many, moved, rate = blocks.block_steps(size, hidden), blocks.start(table), towers.rate
    release(table)
    for low in range(0, steps, many):
        mine = DenseAdam(dict(towers.weights), rate, towers.step, dict(towers.m), dict(towers.v))

        def gradient(step, u, p, n, mine=mine):
            gu, gp, gn, total = two_tower_gradient(u, p, n, mine.weights, size)
            mine.update(total)
            return gu, gp, gn

        def left(mine=mine):
            return [pack(mine.weights), pack(mine.m), pack(mine.v)]

        high = min(steps, low + many)
        moved = blocks.run_block(moved, of_block(pairs, low, high), hidden, rate, gradient, left)
        dense = moved.where(F.col("node") == DENSE_NODE).first()
        towers.m, towers.v = (unpack(np.array(dense[c]), towers.weights) for c in ("m", "v"))
        towers.weights, towers.step = unpack(np.array(dense["vec"]), towers.weights), high
    return blocks.finish(moved, hidden, rate, steps)


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def fit_two_tower(prepared: Prepared, params: dict[str, Any]) -> FittedModel:
    """Feature rows are a parameter table; the small tower weights go out with each step."""
    training, dim = Training.of(params), int(params.get("embedding_dim", 32))
    hidden = max(dim * 2, 8)
    space = NodeSpace.of(prepared)
    pairs, size, steps = pair_table(space, training, params, prepared.ratings("train").count())
    table = normal_parameters(all_nodes(space), hidden, training.seed)
    towers = DenseAdam(tower_weights(hidden, dim, training.seed), training.learning_rate)
    many = blocks.block_steps(size, hidden)
    if many:
        table = tower_blocks(table, pairs, size, hidden, steps, towers)
    for step in range(0 if many else steps):
        weights = dict(towers.weights)

        def gradient(frames, weights=weights):
            for f in frames:
                if not len(f):
                    continue
                gu, gp, gn, total = two_tower_gradient(
                    _stack(f["u"]), _stack(f["p"]), _stack(f["n"]), weights, size
                )
                yield pd.DataFrame({
                    "node": np.concatenate([f["user"], f["positive"], f["negative"], [DENSE_NODE]]),
                    "g": [*gu, *gp, *gn, pack(total)],
                })

        joined = with_vectors(of_step(pairs, step), table, size)
        rows = pin(joined.mapInPandas(gradient, "node bigint, g array<double>"))
        features = summed_gradient(rows.where(F.col("node") != DENSE_NODE), hidden)
        table = adam_step(table, sent(features, size), hidden, step + 1, training.learning_rate)
        towers.update(dense_gradient(rows, towers.weights))
    weights = dict(towers.weights)

    def encode(frames):
        for f in frames:
            if not len(f):
                continue
            x, node = _stack(f["vec"]), f["node"].to_numpy()
            out = np.where(
                (node < 0)[:, None], tower_forward(x, weights, "u")[0],
                tower_forward(x, weights, "i")[0],
            )
            yield pd.DataFrame({"node": node, "vec": list(out)})

    vectors = table.select("node", "vec").mapInPandas(encode, "node bigint, vec array<double>")
    return _embedding_model(
        "two_tower", space, pin(vectors), dim, (HISTORY, KNOWN_USER), architecture="two_tower"
    )
