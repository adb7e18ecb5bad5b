"""Autoencoder and self-attention recommenders as synchronous data-parallel Spark jobs.

Everything keyed by item is a parameter table (encoder and decoder rows, item embeddings); only the
small dense layers, whose size does not depend on the data, travel with a step.
"""

from __future__ import annotations

from math import ceil
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions.text import seeded_unit
from kindred.operators import attention
from kindred.operators.factor import _stack
from kindred.operators.scoring import RUNTIMES, encoded
from kindred.operators.sequences import ordered_events, prefix_examples, recent_items
from kindred.operators.softmax import softmax_rows
from kindred.operators.split import Prepared
from kindred.operators.training import (
    DENSE_NODE,
    DenseAdam,
    NodeSpace,
    Training,
    adam_step,
    dense_gradient,
    normal_parameters,
    pack,
    scale,
    summed_gradient,
    unpack,
    with_moments,
)
from kindred.operators.vectors import sum_vectors
from kindred.plans.fitted import HISTORY, KNOWN_USER, FittedModel, QueryBatch
from kindred.session import pin, release

Weights = dict[str, np.ndarray]

#: Sequences that meet their vectors in one group, and cells (sequences x length x dimension) worked on at once.
CHUNK, CELLS = 2048, 1 << 18


def weights_to_lists(w: Weights) -> dict[str, Any]:
    return {"shapes": {k: list(v.shape) for k, v in w.items()}, "flat": pack(w).tolist()}


def weights_from_lists(stored: dict[str, Any]) -> Weights:
    like = {k: np.zeros(s) for k, s in stored["shapes"].items()}
    return unpack(np.array(stored["flat"]), like)


def batches_of(rows: int, size: int) -> int:
    return max(1, ceil(rows / max(1, size)))


# --------------------------------------------------------------------------- MultiVAE


def vae_weights(hidden: int, latent: int, seed: int) -> Weights:
    rng = np.random.default_rng(seed)

    def xavier(a: int, b: int) -> np.ndarray:
        limit = np.sqrt(6.0 / (a + b))
        return rng.uniform(-limit, limit, (a, b))

    return {
        "enc_b": np.zeros(hidden),
        "mu_W": xavier(hidden, latent), "mu_b": np.zeros(latent),
        "lv_W": xavier(hidden, latent), "lv_b": np.zeros(latent),
        "dec_W": xavier(latent, hidden), "dec_b": np.zeros(hidden),
    }


def vae_forward(a: np.ndarray, w: Weights, noise: np.ndarray | float):
    """Hidden, mean, log variance, latent and decoder activations from summed encoder rows."""
    hid = np.tanh(a + w["enc_b"])
    mu, lv = hid @ w["mu_W"] + w["mu_b"], hid @ w["lv_W"] + w["lv_b"]
    z = mu + noise * np.exp(0.5 * lv)
    return hid, mu, lv, z, np.tanh(z @ w["dec_W"] + w["dec_b"])


def vae_backward(g_out, a, noise, w: Weights, beta: float, size: int):
    """Gradient of the encoder sums and of the dense layers; the KL term is averaged over size."""
    hid, mu, lv, z, out = vae_forward(a, w, noise)
    g = g_out * (1 - out**2)
    grads = {"dec_W": z.T @ g, "dec_b": g.sum(axis=0)}
    g_z = g @ w["dec_W"].T
    g_mu = g_z + beta * mu / size
    g_lv = g_z * noise * 0.5 * np.exp(0.5 * lv) + beta * 0.5 * (np.exp(lv) - 1) / size
    grads |= {"mu_W": hid.T @ g_mu, "mu_b": g_mu.sum(axis=0),
              "lv_W": hid.T @ g_lv, "lv_b": g_lv.sum(axis=0)}
    g_a = (g_mu @ w["mu_W"].T + g_lv @ w["lv_W"].T) * (1 - hid**2)
    grads["enc_b"] = g_a.sum(axis=0)
    return g_a, grads


def _noise(keys: list, latent: int) -> np.ndarray:
    return np.stack([np.random.default_rng(k).standard_normal(latent) for k in keys])


def _user_sums(rows: DataFrame, table: DataFrame, hidden: int) -> DataFrame:
    """(user, a): sums over a user's entries (user, item, value, x) of x * encoder row and value * decoder row."""
    joined = rows.join(table.select(F.col("node").alias("item"), "vec"), "item")
    factor = [F.col("x")] * hidden + [F.col("value")] * (hidden + 1)
    cells = [F.sum(F.col("vec")[d] * c).alias(f"_d{d}") for d, c in enumerate(factor)]
    summed = joined.groupBy("user").agg(F.sum("value").alias("T"), *cells)
    return summed.select("user", "T", F.array(*[f"_d{d}" for d in range(len(cells))]).alias("a"))


def fit_multivae(prepared: Prepared, params: dict[str, Any]) -> FittedModel:
    training = Training.of(params)
    hidden, latent = int(params.get("hidden_dim", 64)), int(params.get("latent_dim", 32))
    dropout, seed = float(params.get("dropout", 0.2)), training.seed
    if hidden < 1 or latent < 1:
        raise ValueError("MultiVAE dimensions must be positive")
    if not 0 <= dropout < 1:
        raise ValueError("dropout must be in [0, 1)")
    space = NodeSpace.of(prepared)
    wide = hidden + 1  # the decoder bias is one more coordinate
    nodes = space.items.select("node")
    limit = F.lit(float(np.sqrt(6.0 / (space.n_items + hidden))))
    cells = [
        (seeded_unit(seed + part, F.col("node"), F.lit(d)) * 2 - 1) * limit for part in (0, 1) for d in range(hidden)
    ]
    # One table holds encoder and decoder rows, so that a step writes it once.
    table = pin(with_moments(nodes.select("node", F.array(*cells, F.lit(0.0)).alias("vec")), hidden + wide))
    dense = DenseAdam(vae_weights(hidden, latent, seed), training.learning_rate)
    norms = space.entries.groupBy("user").agg(
        F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm")
    )
    unit = F.when(F.col("norm") > 0, F.col("value") / F.col("norm")).otherwise(F.lit(0.0))
    entries = pin(space.entries.join(norms, "user").select("user", "item", "value", unit.alias("x")))
    n_batches = batches_of(space.n_users, training.batch_size)
    step = 0
    for epoch in range(max(1, training.epochs)):
        beta = min(0.2, (epoch + 1) / max(training.epochs, 1) * 0.2)
        place = F.pmod(F.xxhash64("user", F.lit(seed), F.lit(epoch)), F.lit(n_batches))
        batches = pin(entries.withColumn("batch", place), by="batch")
        counted = batches.groupBy("batch").agg(F.count_distinct("user").alias("n"))
        sizes = {int(r["batch"]): r["n"] for r in counted.collect()}  # one number a step
        for number in range(n_batches):
            step += 1
            size = sizes.get(number, 0)
            if not size:
                continue
            kept = F.when(
                seeded_unit(seed, F.lit(step), F.col("user"), F.col("item")) >= dropout,
                F.col("x") / (1 - dropout),
            ).otherwise(F.lit(0.0))
            rows = batches.where(F.col("batch") == number).drop("batch").withColumn("x", kept)
            weights = dict(dense.weights)

            def run(frames, weights=weights, step=step, size=size):
                for f in frames:
                    if len(f):
                        noise = _noise([(seed, step, -int(u)) for u in f["user"]], latent)
                        sums = _stack(f["a"])
                        out = vae_forward(sums[:, :hidden], weights, noise)[-1]
                        one = np.ones((len(f), 1))
                        yield pd.DataFrame({
                            "user": f["user"], "t": f["T"] / size, "a": list(sums[:, :hidden]),
                            "pull": list(sums[:, hidden:] / -size), "noise": list(noise),
                            "h": list(np.hstack([out, one])),
                        })

            made = pin(_user_sums(rows, table, hidden).mapInPandas(
                run, "user bigint, t double, a array<double>, pull array<double>, noise array<double>, "
                "h array<double>",
            ))
            queries = made.select(F.col("user").alias("qid"), F.col("h").alias("vec"), "t")
            items = table.select(F.col("node").alias("item"), F.slice("vec", hidden + 1, wide).alias("vec"))
            spread = softmax_rows(queries, items, (size, space.n_items))
            summed = pin(summed_gradient(spread.select(F.col("id").alias("node"), "g"), wide))

            def back(frames, weights=weights, beta=beta, size=size):
                for f in frames:
                    if len(f):
                        g_out = _stack(f["g"]) + _stack(f["pull"])
                        g_a, grads = vae_backward(
                            g_out[:, :hidden], _stack(f["a"]), _stack(f["noise"]), weights, beta, size
                        )
                        # A user's row of gradients, as its entries pass them on to encoder and decoder.
                        to_items = np.hstack([g_a, _stack(f["h"]) / -size])
                        yield pd.DataFrame({
                            "node": np.append(f["user"].to_numpy(), DENSE_NODE),
                            "g": [*to_items, pack(grads)],
                        })

            of_users = summed.withColumnRenamed("node", "user")
            flowed = pin(made.join(of_users, "user").mapInPandas(
                back, "node bigint, g array<double>"
            ))
            per_user = flowed.where(F.col("node") != DENSE_NODE).withColumnRenamed("node", "user")
            factor = [F.col("x")] * hidden + [F.col("value")] * wide
            to_items = rows.join(per_user, "user").groupBy(F.col("item").alias("node")).agg(
                *[F.sum(F.col("g")[d] * c).alias(f"_d{d}") for d, c in enumerate(factor)]
            )
            cells = [F.coalesce(F.col(f"_d{d}"), F.lit(0.0)) for d in range(hidden + wide)]
            decoder = [c + F.coalesce(F.col("g")[d], F.lit(0.0)) for d, c in enumerate(cells[hidden:])]
            gradient = summed.where(F.col("node") > 0).join(to_items, "node", "full").select(
                "node", F.array(*cells[:hidden], *decoder).alias("g")
            )
            table = adam_step(table, gradient, hidden + wide, step, training.learning_rate)
            dense.update(dense_gradient(flowed, dense.weights))
            for done in (made, summed, flowed):
                release(done)

    def named(first: int, size: int) -> DataFrame:
        part = F.slice("vec", first, size).alias("vec")
        return pin(space.items.join(table, "node").select(F.col("item_id").alias("item"), part))

    return FittedModel(
        "multivae", "autoencoder", (HISTORY, KNOWN_USER),
        {"encoder": named(1, hidden), "items": named(hidden + 1, wide)},
        {"hidden": hidden, "weights": weights_to_lists(dense.weights)},
    )


def encode_autoencoder(model: FittedModel, batch: QueryBatch) -> DataFrame:
    """(qid, vec): decoder activations of each request's normalized row, without noise."""
    hidden = model.params["hidden"]
    weights = weights_from_lists(model.params["weights"])
    norms = batch.vector.groupBy("request_id").agg(
        F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm")
    )
    side = model.tables["encoder"].withColumnRenamed("item", "item_id")
    unit = F.when(F.col("norm") > 0, F.col("value") / F.col("norm")).otherwise(F.lit(0.0))
    rows = batch.vector.join(norms, "request_id").join(side, "item_id").select(
        "request_id", unit.alias("x"), F.col("vec").alias("a")
    )
    sums = sum_vectors(rows.groupBy("request_id"), "a", hidden, weight=F.col("x"))
    zero = F.array_repeat(F.lit(0.0), hidden)
    sums = batch.requests.select("request_id").join(sums, "request_id", "left").select(
        F.col("request_id").alias("qid"), F.coalesce("a", zero).alias("a")
    )

    def run(frames):
        for f in frames:
            if len(f):
                out = vae_forward(_stack(f["a"]), weights, 0.0)[-1]
                vec = np.hstack([out, np.ones((len(f), 1))])
                yield pd.DataFrame({"qid": f["qid"], "vec": list(vec)})

    kind = sums.schema["qid"].dataType.simpleString()
    return pin(sums.mapInPandas(run, f"qid {kind}, vec array<double>"))


# --------------------------------------------------------------------------- SASRec


def gather(sequences: DataFrame, key: str, items: DataFrame) -> DataFrame:
    """(key, flat): vectors of sequence entries end to end; ``items`` (column ``items``) holds few entries."""
    slots = sequences.select(key, F.posexplode("items").alias("at", "node")).join(items, "node")
    listed = F.array_sort(F.collect_list(F.struct("at", "vec")))
    return slots.groupBy(key).agg(F.flatten(F.transform(listed, lambda x: x["vec"])).alias("flat"))


def padded(sizes: np.ndarray, vectors: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, tuple]:
    """Embedded inputs and pad flags, sequences pushed to the right, and where each entry went.

    ``vectors`` holds the entries of all sequences, ``sizes`` (at most ``length``) of each, one after the other.
    """
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = length - np.repeat(np.cumsum(sizes), sizes) + np.arange(len(row))
    emb = np.zeros((len(sizes), length, vectors.shape[-1]))
    pad = np.ones((len(sizes), length), dtype=bool)
    emb[row, at], pad[row, at] = vectors, False
    return emb, pad, (row, at)


def _with_vectors(sequences: DataFrame, items: DataFrame, chunks: int, also: str, function, schema: str) -> DataFrame:
    """``function(rows, nodes, vectors)`` on chunks of sequences, with the vectors of their entries and of ``also``.

    A chunk gets each vector it reads once, sorted by node, and is given out in slices of few cells.
    """
    chunk = F.pmod(F.xxhash64("ex"), F.lit(chunks)).alias("chunk")
    rows = sequences.select("*", chunk)
    read = rows.select("chunk", F.explode(F.concat("items", F.array(also))).alias("node")).distinct()
    vectors = read.join(items, "node").select(F.col("chunk").alias("of"), "node", "vec")

    def run(frame: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values("node")
        return function(frame, table["node"].to_numpy(), _stack(table["vec"]))

    # A number of partitions of its own: little data, much work.
    left, right = (x.repartition(chunks, by).groupBy(by) for x, by in ((rows, "chunk"), (vectors, "of")))
    return left.cogroup(right).applyInPandas(run, schema)


def fit_sasrec(prepared: Prepared, params: dict[str, Any]) -> FittedModel:
    training = Training.of(params)
    length, dim = int(params.get("max_length", 50)), int(params.get("embedding_dim", 32))
    layers, dropout = int(params.get("layers", 2)), float(params.get("dropout", 0.1))
    if min(length, dim, layers) < 1:
        raise ValueError("SASRec dimensions and layers must be positive")
    seed, space = training.seed, NodeSpace.of(prepared)
    ordered = ordered_events(prepared.part("train"), prepared.order, prepared.hot_users).join(
        space.items, "item_id"
    ).select("user_id", "pos", "node", "item_id")
    examples = prefix_examples(ordered, length, item="node")
    examples = pin(examples.select(
        F.monotonically_increasing_id().alias("ex"), F.col("prefix").alias("items"), "target"
    ))
    count = examples.count()
    if count == 0:
        raise ValueError("SASRec needs at least one ordered item transition")
    table = normal_parameters(space.items.select("node"), dim, seed)
    dense = DenseAdam(attention.block_weights(length, dim, layers, seed), training.learning_rate)
    n_batches = batches_of(count, training.batch_size)
    chunks = batches_of(min(count, training.batch_size), CHUNK)
    step = 0
    for epoch in range(max(1, training.epochs)):
        place = F.pmod(F.xxhash64("ex", F.lit(seed), F.lit(epoch)), F.lit(n_batches))
        batches = pin(examples.withColumn("batch", place), by="batch")
        sizes = {int(r["batch"]): r["count"] for r in batches.groupBy("batch").count().collect()}  # one number a step
        for number in range(n_batches):
            step += 1
            size = sizes.get(number, 0)
            if not size:
                continue
            batch = batches.where(F.col("batch") == number).drop("batch")
            weights, items = dict(dense.weights), table.select("node", "vec")

            def slices(f, nodes, vectors, step=step):
                """(rows, nodes, places, embedded, pads, masks) of few cells each."""
                most = max(1, CELLS // (length * dim))
                for part in (f.iloc[i : i + most] for i in range(0, len(f), most)):
                    entries = np.concatenate(part["items"].to_numpy())
                    sizes = part["items"].map(len).to_numpy()
                    emb, pad, at = padded(sizes, vectors[np.searchsorted(nodes, entries)], length)
                    keys = [(seed, step, int(x)) for x in part["ex"]]
                    yield part, entries, at, emb, pad, attention.dropout_masks(keys, layers, length, dim, dropout)

            def run(f, nodes, vectors, weights=weights, slices=slices):
                h = [attention.forward(emb, pad, weights, layers, masks)[0]
                     for _, _, _, emb, pad, masks in slices(f, nodes, vectors)]
                aim = vectors[np.searchsorted(nodes, f["target"].to_numpy())]
                return f[["ex", "items", "target"]].assign(h=list(np.concatenate(h)), aim=list(aim))

            made = pin(_with_vectors(
                batch, items, chunks, "target", run,
                "ex bigint, items array<bigint>, target bigint, h array<double>, aim array<double>",
            ))
            queries = made.select(
                F.col("ex").alias("qid"), F.col("h").alias("vec"), F.lit(1.0 / size).alias("t")
            )
            catalog = items.withColumnRenamed("node", "item")
            pull = F.lit(-1.0 / size)
            spread = softmax_rows(queries, catalog, (size, space.n_items)).unionByName(
                made.select(F.lit(0).alias("side"), F.col("ex").alias("id"), scale(F.col("aim"), pull).alias("g"))
            ).unionByName(
                made.select(F.lit(1).alias("side"), F.col("target").alias("id"), scale(F.col("h"), pull).alias("g"))
            )
            summed = pin(sum_vectors(spread.groupBy("side", "id"), "g", dim))
            g_last = summed.where(F.col("side") == 0).select(F.col("id").alias("ex"), "g")

            def back(f, nodes, vectors, weights=weights, slices=slices):
                total, sums = 0.0, np.zeros(vectors.shape)
                for part, entries, at, emb, pad, masks in slices(f, nodes, vectors):
                    _, cache = attention.forward(emb, pad, weights, layers, masks)
                    g, grads = attention.backward(_stack(part["g"]), cache, weights, layers)
                    total = total + pack(grads)
                    np.add.at(sums, np.searchsorted(nodes, entries), g[at])
                return pd.DataFrame({"node": np.append(nodes, DENSE_NODE), "g": [*sums, total]})

            flowed = pin(_with_vectors(
                made.select("ex", "items", "target").join(g_last, "ex"), items, chunks, "target", back,
                "node bigint, g array<double>",
            ))
            to_items = flowed.where(F.col("node") != DENSE_NODE).unionByName(
                summed.where(F.col("side") == 1).select(F.col("id").alias("node"), "g")
            )
            table = adam_step(
                table, summed_gradient(to_items, dim), dim, step, training.learning_rate
            )
            dense.update(dense_gradient(flowed, dense.weights))
            for done in (made, summed, flowed):
                release(done)
    items = pin(space.items.join(table, "node").select(F.col("item_id").alias("item"), "vec"))
    known = pin(recent_items(ordered, length).select("user_id", "items"))
    return FittedModel(
        "sasrec", "sequence", (HISTORY, KNOWN_USER), {"items": items, "known": known},
        {"max_length": length, "dim": dim, "layers": layers,
         "weights": weights_to_lists(dense.weights)},
    )


def encode_sequence(model: FittedModel, batch: QueryBatch) -> DataFrame:
    """(qid, vec): attention output of each request's last items."""
    length, dim, layers = (model.params[k] for k in ("max_length", "dim", "layers"))
    weights = weights_from_lists(model.params["weights"])
    if batch.mode == KNOWN_USER:
        recent = batch.of_users(model.tables["known"])
    else:
        recent = recent_items(batch.recent, length, "request_id")
    items = model.tables["items"].withColumnRenamed("item", "node")
    found = gather(recent, "request_id", items)
    slots = batch.requests.select("request_id").join(found, "request_id", "left").select(
        F.col("request_id").alias("qid"), F.coalesce("flat", F.array().cast("array<double>")).alias("flat")
    )

    def run(frames):
        most = max(1, CELLS // (length * dim))
        for f in (frame.iloc[i : i + most] for frame in frames for i in range(0, len(frame), most)):
            sizes = f["flat"].map(len).to_numpy() // dim
            emb, pad, _ = padded(sizes, np.concatenate(f["flat"].to_numpy()).reshape(-1, dim), length)
            out, _ = attention.forward(emb, pad, weights, layers)
            yield pd.DataFrame({"qid": f["qid"], "vec": list(out)})

    kind = slots.schema["qid"].dataType.simpleString()
    return pin(slots.mapInPandas(run, f"qid {kind}, vec array<double>"))


RUNTIMES["autoencoder"] = encoded(encode_autoencoder)
RUNTIMES["sequence"] = encoded(encode_sequence)
