"""Fusing several score views into one ranking, exactly, without requests x items rows."""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from kindred.functions.numbers import quantize
from kindred.operators import lists
from kindred.operators.positions import first_free, group_positions
from kindred.operators.scoring import (
    ScoreView,
    _base_requests,
    _sparse_requests,
    near_positions,
    prefix,
    seen_pairs,
    top_k,
    union_all,
    view_ranks,
)
from kindred.operators.vectors import inner_product_topk
from kindred.plans.fitted import ItemSpace, QueryBatch
from kindred.session import pin

RRF_CONSTANT = 60.0
RRF_DIGITS = 12


def pool_depth(batch: QueryBatch, views: int, k: int, constant: float, masked: bool) -> DataFrame:
    """(request_id, depth) that provably holds the fused top k.

    The first view's best k unseen items rank within k + seen, so the k-th fused score is at least
    1 / (c + k + seen). An item past depth D in all m views scores less than m / (c + D). So
    D = m * (c + k + seen) - c is deep enough.
    """
    if not masked:
        deep = ceil(views * (constant + k) - constant)
        return batch.requests.select("request_id", F.lit(deep).cast("bigint").alias("depth"))
    seen = seen_pairs(batch).groupBy("request_id").agg(F.count(F.lit(1)).alias("seen"))
    ahead = F.lit(constant + k) + F.coalesce(F.col("seen"), F.lit(0))
    depth = F.ceil(F.lit(views) * ahead - F.lit(constant)).cast("bigint")
    return batch.requests.select("request_id").join(seen, "request_id", "left").select(
        "request_id", depth.alias("depth")
    )


def component_ranks(
    views: list[ScoreView],
    batch: QueryBatch,
    space: ItemSpace,
    pool: DataFrame,
    masked: DataFrame | None = None,
) -> DataFrame:
    """(request_id, item_id, component, score, rank) for every pool pair and view."""
    return union_all([
        view_ranks(v, batch, space, pool, masked).withColumn("component", F.lit(v.name))
        for v in views
    ])


def candidate_pool(
    views: list[ScoreView], batch: QueryBatch, space: ItemSpace, depth: DataFrame
) -> DataFrame:
    """(request_id, item_id): union of every view's items ranked within the depth."""
    return union_all([prefix(v, batch, space, depth) for v in views]).distinct()


def rrf_topk(
    views: list[ScoreView],
    batch: QueryBatch,
    space: ItemSpace,
    k: int,
    seen: DataFrame | None,
    constant: float = RRF_CONSTANT,
) -> DataFrame:
    """Top k by sum of 1 / (constant + rank); seen items take part in ranks, not in results."""
    if constant <= 0:
        raise ValueError("rank_constant must be positive")
    if not views:
        raise ValueError("fusion requires at least one component")
    if lists.applies(views, batch) and (found := lists.rrf_lists(views, batch, space, k, seen, constant)) is not None:
        return found
    views = [v.expanded() for v in views]
    depth = pool_depth(batch, len(views), k, constant, seen is not None)
    pool = candidate_pool(views, batch, space, depth)
    if seen is not None:
        pool = pool.join(seen, ["request_id", "item_id"], "left_anti")
    pool = pin(pool)
    ranks = component_ranks(views, batch, space, pool)
    fused = ranks.groupBy("request_id", "item_id").agg(
        quantize(F.sum(F.lit(1.0) / (F.lit(constant) + F.col("rank"))), RRF_DIGITS).alias("score")
    )
    return top_k(fused, k)


# --------------------------------------------------------------------------- weighted z-scores

def _listed() -> list[Column]:
    return [
        F.count("score").alias("c"), F.avg("score").alias("m"), F.var_pop("score").alias("v"),
        F.min("score").alias("lo"), F.max("score").alias("hi"),
    ]


def _listed_moments(view: ScoreView) -> Row:
    """Count, mean, variance, least and greatest score of a shared ranking."""
    return view.base.agg(*_listed()).first()


def _moments(view: ScoreView, batch: QueryBatch, space: ItemSpace) -> DataFrame:
    """(request_id, mean, std): population moments of the view's scores over the catalog."""
    parts: list[DataFrame] = []
    n = F.lit(float(space.n))

    def finish(sums: DataFrame) -> DataFrame:
        mean = F.col("s") / n
        var = F.greatest(F.col("ss") / n, F.lit(0.0))
        # ``ss`` is taken around the mean vector; what is left of a constant score is rounding.
        flat = var <= F.lit(1e-24) * mean * mean
        return sums.select(
            "request_id", mean.alias("mean"), F.when(flat, 1.0).otherwise(F.sqrt(var)).alias("std")
        )

    # Explicit scores: spread of the listed ones around their own mean, then the implicit zeros, so
    # that large scores lying close together keep their spread. Only equal scores have none.
    listed = _listed()

    def spread(stats: DataFrame) -> DataFrame:
        stats = stats.select("request_id", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("c", "m", "v", "lo", "hi")])
        share = F.col("c") / n
        mean = share * F.col("m")
        off = F.col("m") - mean
        var = share * (F.col("v") + off * off) + (1 - share) * mean * mean
        flat = (F.col("lo") == F.col("hi")) & ((F.col("c") == n) | (F.col("hi") == 0))
        return stats.select(
            "request_id", mean.alias("mean"), F.when(flat, 1.0).otherwise(F.sqrt(var)).alias("std")
        )

    if view.base is not None:
        total = _listed_moments(view)
        parts.append(spread(_base_requests(view, batch.requests).select(
            "request_id", *[F.lit(total[c]).cast("double").alias(c) for c in ("c", "m", "v", "lo", "hi")]
        )))
    if view.nonzero is not None:
        stats = view.nonzero.groupBy("request_id").agg(*listed)
        parts.append(spread(_sparse_requests(view, batch.requests).join(stats, "request_id", "left")))
    if view.vectors is not None:
        queries, items = view.vectors
        mean, second = item_moments(items)

        def quadratic(frames):
            for frame in frames:
                q = np.stack(frame["vec"].to_numpy()).astype(float) if len(frame) else (
                    np.empty((0, len(mean)))
                )
                yield pd.DataFrame({
                    "request_id": frame["qid"],
                    "s": q @ mean,
                    "ss": np.einsum("ij,jk,ik->i", q, second, q),
                })

        kind = queries.schema["qid"].dataType.simpleString()
        parts.append(finish(
            queries.mapInPandas(quadratic, f"request_id {kind}, s double, ss double")
        ))
    return union_all(parts)


def item_moments(items: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sum of item vectors, and the second-moment sum around their mean: small partials per partition.

    Around the mean, so that vectors far from the origin keep their spread.
    """
    count, first = _vector_sums(items, None)
    _, second = _vector_sums(items, first[0] / max(count, 1))
    return first[0], second


def _vector_sums(items: DataFrame, centre: np.ndarray | None) -> tuple[int, np.ndarray]:
    """(number of vectors, sum of vectors as one row); with a centre, the sum of products around it."""

    def partial(frames):
        n, total = 0, None
        for frame in frames:
            if len(frame):
                e = np.stack(frame["vec"].to_numpy()).astype(float)
                part = e.sum(axis=0)[None, :] if centre is None else (e - centre).T @ (e - centre)
                n, total = n + len(e), part if total is None else total + part
        if total is not None:
            cells = np.concatenate([[float(n)], total.ravel()])
            yield pd.DataFrame({"cell": np.arange(len(cells)), "v": cells})

    cells = items.select("vec").mapInPandas(partial, "cell bigint, v double")
    # dim or dim * dim sums, whatever the number of items.
    rows = cells.groupBy("cell").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros(max(len(rows), 1))
    for row in rows:
        flat[row["cell"]] = row["v"]
    size = len(flat) - 1
    return int(flat[0]), flat[1:].reshape((1, size) if centre is None else (len(centre), len(centre)))


def weighted_topk(
    views: list[ScoreView],
    batch: QueryBatch,
    space: ItemSpace,
    k: int,
    seen: DataFrame | None,
    weights: dict[str, float] | None = None,
) -> DataFrame:
    """Top k by the weighted sum of z-scores; a missing weight is 1.

    A fused score is linear in the raw scores, so outside the explicitly scored items it depends
    on the shared base rankings and inner products alone, whose top k is found directly.
    """
    if not views:
        raise ValueError("fusion requires at least one component")
    weights = weights or {}
    if lists.applies(views, batch):
        dense = [v for v in views if v.base is not None]
        found = lists.weighted_lists(
            views, batch, space, k, seen, weights, lambda: _outer_order(dense[0] if dense else None, weights, space), _listed_moments
        )
        if found is not None:
            return found
    views = [v.expanded() for v in views]
    moments = union_all([
        _moments(v, batch, space).select(
            "request_id", F.lit(v.name).alias("component"),
            (F.lit(float(weights.get(v.name, 1.0))) / F.col("std")).alias("slope"),
            (-F.lit(float(weights.get(v.name, 1.0))) * F.col("mean") / F.col("std")).alias("shift"),
        )
        for v in views
    ])
    moments = pin(moments)
    explicit = [v.nonzero.select("request_id", "item_id") for v in views if v.nonzero is not None]
    touched = explicit[0] if len(explicit) == 1 else (
        pin(union_all(explicit).distinct()) if explicit else None
    )
    parts_taken = [t for t in (seen, touched) if t is not None]
    taken = union_all([t.select("request_id", "item_id") for t in parts_taken]).distinct() if parts_taken else None
    dense = [v for v in views if v.base is not None or v.vectors is not None]
    need = batch.requests.select("request_id", F.lit(k).alias("need"))
    rest: list[DataFrame] = []  # best items outside the explicit ones, disjoint from them
    if not dense:
        rest.append(_free_items(parts_taken, need, space.items, batch, space, k))
    elif len(dense) == 1 and dense[0].base is not None:
        view, order = dense[0], _outer_order(dense[0], weights, space)
        using = need.join(_base_requests(view, batch.requests), "request_id", "left_semi")
        rest.append(_free_items(parts_taken, using, order, batch, space, k))
        if view.base_requests is not None:
            others = need.join(view.base_requests, "request_id", "left_anti")
            rest.append(_free_items(parts_taken, others, space.items, batch, space, k))
    else:
        rest.append(_dense_pool(dense, moments, batch, k, taken))
    outside = pin(union_all(rest))
    pool = outside if touched is None else outside.unionByName(touched)
    parts = [outside.select("request_id", "item_id", F.lit(0.0).alias("part"))]
    for v in views:
        slope = moments.where(F.col("component") == v.name).select("request_id", "slope")
        for scores in _explicit_and_dense(v, batch, space, pool):
            parts.append(scores.join(slope, "request_id").select(
                "request_id", "item_id", (F.col("slope") * F.col("score")).alias("part")
            ))
    summed = union_all(parts).groupBy("request_id", "item_id").agg(F.sum("part").alias("part"))
    shifts = moments.groupBy("request_id").agg(F.sum("shift").alias("shift"))
    fused = summed.join(shifts, "request_id").select(
        "request_id", "item_id", quantize(F.col("part") + F.col("shift")).alias("score")
    )
    return top_k(fused, k, seen)


def _outer_order(view: ScoreView | None, weights: dict[str, float], space: ItemSpace) -> DataFrame:
    """(item_id, pos): items that only the shared ranking scores, the best fused score first."""
    weight = 0.0 if view is None else float(weights.get(view.name, 1.0))
    if weight > 0:
        return view.base.select("item_id", "pos")
    if weight == 0:
        return space.items
    return group_positions(view.base.drop("pos"), [], [F.col("score"), F.col("item_id")], "pos").select("item_id", "pos")


def _explicit_and_dense(
    view: ScoreView, batch: QueryBatch, space: ItemSpace, pool: DataFrame
) -> list[DataFrame]:
    """(request_id, item_id, score) tables that add up to the view's scores of the pool."""
    if view.vectors is not None:
        return [view_ranks(view, batch, space, pool).drop("rank")]
    parts = []
    if view.nonzero is not None:
        parts.append(view.nonzero.select("request_id", "item_id", "score"))
    if view.base is not None:
        mine = pool
        if view.base_requests is not None:
            mine = pool.join(view.base_requests, "request_id", "left_semi")
        parts.append(mine.join(view.base.select("item_id", "score"), "item_id").select(
            "request_id", "item_id", "score"
        ))
    return parts


def _free_items(
    taken: list[DataFrame], need: DataFrame, order: DataFrame, batch: QueryBatch, space: ItemSpace, k: int
) -> DataFrame:
    """The best ``need`` (k at most) items of a shared order that none of the taken tables holds."""
    if not taken:
        first = F.explode(F.sequence(
            F.lit(1).cast("bigint"), F.least(F.col("need"), F.lit(space.n)).cast("bigint")
        ))
        free = need.select("request_id", first.alias("pos"))
    else:
        free = first_free(
            near_positions(taken, order, k), need, "request_id", space.n, hot=batch.hot
        )
    return free.join(order, "pos").select("request_id", "item_id")


def _dense_pool(
    dense: list[ScoreView], moments: DataFrame, batch: QueryBatch, k: int, taken: DataFrame | None
) -> DataFrame:
    """Top k of the combined dense part: one inner product over joined-up vectors."""
    queries = batch.requests.select(F.col("request_id").alias("qid"), F.array().cast(
        "array<double>").alias("vec"))
    items = None
    for v in dense:
        slope = moments.where(F.col("component") == v.name).select(
            F.col("request_id").alias("qid"), "slope"
        )
        if v.vectors is not None:
            q, e = v.vectors
            mine = q.join(slope, "qid").select(
                "qid", F.transform("vec", lambda x: x * F.col("slope")).alias("part")
            )
            side = e.select("item", F.col("vec").cast("array<double>").alias("part"))
            empty = None
        else:
            using = _base_requests(v, batch.requests).select(F.col("request_id").alias("qid"))
            mine = using.join(slope, "qid").select("qid", F.array("slope").alias("part"))
            side = v.base.select(F.col("item_id").alias("item"), F.array("score").alias("part"))
            empty = F.array(F.lit(0.0))
        joined = queries.join(mine, "qid", "inner" if empty is None else "left")
        part = F.col("part") if empty is None else F.coalesce("part", empty)
        queries = joined.select("qid", F.concat("vec", part).alias("vec"))
        items = side.withColumnRenamed("part", "vec") if items is None else (
            items.join(side, "item").select("item", F.concat("vec", "part").alias("vec"))
        )
    masked = None if taken is None else taken.select(
        F.col("request_id").alias("qid"), F.col("item_id").alias("item")
    )
    best = inner_product_topk(queries, items, k, masked)
    return best.select(F.col("qid").alias("request_id"), F.col("item").alias("item_id"))
