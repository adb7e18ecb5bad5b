"""Learned fusion: a lambdarank gradient-boosted tree ensemble over component features.

Lambdas are computed per query group (bounded by the candidate pool) on a table that carries the
scores from round to round; trees grow from histograms of binned features, one aggregate a level; rows
are scored in batches of arrays, or by one expression where the ensemble is small.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.operators.fusion import RRF_CONSTANT, component_ranks
from kindred.operators.positions import first_free, group_positions, hot_groups
from kindred.operators.scoring import (
    ScoreView,
    _base_requests,
    _sparse_requests,
    _with_pos,
    marks_ahead,
    prefix,
    seen_pairs,
    top_k,
    union_all,
    view_topk,
)
from kindred.plans.fitted import ItemSpace, QueryBatch
from kindred.session import pin, release

TRUNCATION = 30  # ranks that pairs are taken from
BINS = 255  # a bin fits a byte
BOX_SHARE = 4  # a pool by boxes pays where boxes x k is below the catalog by this factor
FIXED = 2.0**30  # gradients are added up as integers of this scale


def feature_names(views: list[ScoreView]) -> list[str]:
    return [f"{v.name}_{kind}" for v in sorted(views, key=lambda v: v.name)
            for kind in ("score", "rr")]


def features(
    views: list[ScoreView],
    batch: QueryBatch,
    space: ItemSpace,
    pool: DataFrame,
    masked: DataFrame | None,
    constant: float = RRF_CONSTANT,
) -> DataFrame:
    """(request_id, item_id, <component>_score, <component>_rr...), one row per pool pair."""
    ranks = component_ranks(views, batch, space, pool, masked)
    columns = []
    for v in sorted(views, key=lambda v: v.name):
        mine = F.col("component") == v.name
        columns.append(F.max(F.when(mine, F.col("score"))).alias(f"{v.name}_score"))
        reciprocal = F.lit(1.0) / (F.lit(constant) + F.col("rank"))
        columns.append(F.max(F.when(mine, reciprocal)).alias(f"{v.name}_rr"))
    return ranks.groupBy("request_id", "item_id").agg(*columns)


def fusion_training_set(
    views: list[ScoreView],
    batch: QueryBatch,
    space: ItemSpace,
    truth: DataFrame,
    pool_size: int = 100,
    constant: float = RRF_CONSTANT,
) -> DataFrame:
    """Features and ``label`` of each view's best unseen items; ``truth`` (request_id, item_id).

    Only requests with a true item take part; seen items are masked before ranking.
    """
    seen, views = pin(seen_pairs(batch)), [v.expanded() for v in views]
    pool = pin(union_all([
        view_topk(v, batch, space, pool_size, seen).select("request_id", "item_id") for v in views
    ]).distinct())
    hits = truth.select("request_id", "item_id").distinct().withColumn("label", F.lit(1))
    rows = features(views, batch, space, pool, seen, constant)
    return rows.join(hits, ["request_id", "item_id"], "left").fillna(0, ["label"])


# --------------------------------------------------------------------------- trees


def tree_column(tree: dict[str, Any], names: list[str]) -> Column:
    """Left when the feature is at most the threshold."""
    if "value" in tree:
        return F.lit(float(tree["value"]))
    below = F.col(names[tree["feature"]]) <= F.lit(float(tree["threshold"]))
    return F.when(below, tree_column(tree["left"], names)).otherwise(
        tree_column(tree["right"], names)
    )


def ensemble_column(ensemble: dict[str, Any]) -> Column:
    """The whole ensemble as one expression; for a handful of trees, as generated code is bounded."""
    total = F.lit(0.0)
    for tree in ensemble["trees"]:
        total = total + F.lit(float(ensemble["rate"])) * tree_column(tree, ensemble["features"])
    return total


@dataclass
class FlatTree:
    """A tree as arrays; node 0 is the root, ``feature`` -1 marks a leaf."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[float] = field(default_factory=lambda: [0.0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: float) -> tuple[int, int]:
        made = len(self.feature)
        self.feature[node], self.cut[node] = feature, cut
        self.left[node], self.right[node] = made, made + 1
        for _ in range(2):
            self.feature.append(-1)
            self.cut.append(0.0)
            self.left.append(0)
            self.right.append(0)
            self.value.append(0.0)
        return made, made + 1

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Node that each row of ``x`` (rows, features) ends in; a missing value goes right."""
        feature, cut = np.array(self.feature), np.array(self.cut)
        left, right = np.array(self.left), np.array(self.right)
        at = np.zeros(len(x), dtype=int)
        rows = np.arange(len(x))
        while True:
            f = feature[at]
            if (f < 0).all():
                return at
            below = x[rows, np.maximum(f, 0)] <= cut[at]
            at = np.where(f < 0, at, np.where(below, left[at], right[at]))

    def nested(self, edges: list[np.ndarray], node: int = 0) -> dict[str, Any]:
        """As plain data, with thresholds instead of bins."""
        f = self.feature[node]
        if f < 0:
            return {"value": self.value[node]}
        return {
            "feature": f, "threshold": float(edges[f][int(self.cut[node])]),
            "left": self.nested(edges, self.left[node]), "right": self.nested(edges, self.right[node]),
        }


def flat(tree: dict[str, Any]) -> FlatTree:
    out = FlatTree()
    open_ = [(0, tree)]
    while open_:
        node, part = open_.pop()
        if "value" in part:
            out.value[node] = float(part["value"])
            continue
        left, right = out.split(node, int(part["feature"]), float(part["threshold"]))
        open_ += [(left, part["left"]), (right, part["right"])]
    return out


def ensemble_scores(ensemble: dict[str, Any], columns: list[Column] | None = None) -> Column:
    """Score of every row, many rows at once; equal to :func:`ensemble_column` for any number of trees."""
    trees, rate = [flat(t) for t in ensemble["trees"]], float(ensemble["rate"])

    def score(x: pd.Series) -> pd.Series:
        total = np.zeros(len(x))
        if len(x):
            table = np.stack(x.to_numpy()).astype(float)
            for tree in trees:
                total = total + rate * np.array(tree.value)[tree.leaves(table)]
        return pd.Series(total)

    named = [F.col(n).cast("double") for n in ensemble["features"]]
    return F.pandas_udf(score, "double")(F.array(*(columns or named)))


# --------------------------------------------------------------------------- training


def lambdas(
    scores: np.ndarray, labels: np.ndarray, truncation: int = TRUNCATION
) -> tuple[np.ndarray, np.ndarray]:
    """Lambdarank gradients (ascent direction) and hessians of one group, binary labels.

    Pairs count where one of the two stands among the first ``truncation``.
    """
    gradient, hessian = np.zeros(len(scores)), np.zeros(len(scores))
    positives = int(labels.sum())
    if positives == 0 or positives == len(labels):
        return gradient, hessian
    order = np.argsort(-scores, kind="stable")
    place = np.empty(len(scores), dtype=int)
    place[order] = np.arange(len(scores))
    discount = 1.0 / np.log2(place + 2.0)
    ideal = (1.0 / np.log2(np.arange(min(positives, truncation)) + 2.0)).sum()
    up, down = np.flatnonzero(labels > 0), np.flatnonzero(labels == 0)
    delta = np.abs(discount[up][:, None] - discount[down][None, :]) / ideal
    near = (place[up][:, None] < truncation) | (place[down][None, :] < truncation)
    miss = 1.0 / (1.0 + np.exp(scores[up][:, None] - scores[down][None, :]))
    pull, curve = miss * delta * near, miss * (1 - miss) * delta * near
    gradient[up], gradient[down] = pull.sum(axis=1), -pull.sum(axis=0)
    hessian[up], hessian[down] = curve.sum(axis=1), curve.sum(axis=0)
    return gradient, hessian


def gradients(rows: DataFrame, truncation: int = TRUNCATION) -> DataFrame:
    """(request_id, item_id, score, label) -> (request_id, item_id, g, h); equal scores go by item.

    A request is one row of lists while its gradients are taken; ids never leave Spark.
    """
    listed = F.array_sort(F.collect_list(F.struct("item_id", F.col("score").cast("double").alias("score"), "label")))
    packed = rows.groupBy("request_id").agg(listed.alias("t")).select(
        "request_id", *[F.col("t")[c].alias(c) for c in ("item_id", "score", "label")]
    )

    def run(scores: pd.Series, labels: pd.Series) -> pd.DataFrame:
        found = [lambdas(np.asarray(s, float), np.asarray(y), truncation) for s, y in zip(scores, labels)]
        return pd.DataFrame(found, columns=["g", "h"])

    taken = F.pandas_udf(run, "g array<double>, h array<double>")("score", "label")
    pairs = packed.select("request_id", "item_id", taken.alias("p")).select(
        "request_id", F.arrays_zip("item_id", F.col("p.g").alias("g"), F.col("p.h").alias("h")).alias("t")
    )
    return pairs.select("request_id", F.explode("t").alias("t")).select("request_id", "t.*")


def bin_edges(rows: DataFrame, names: list[str], bins: int = BINS) -> list[np.ndarray]:
    """Upper bounds of each feature's bins but the last one, at most ``bins`` of them.

    A feature with few values gets a bound between any two neighbours, others get quantiles.
    """
    values = rows.select(F.posexplode(F.array(*[F.col(n).cast("double") for n in names])).alias("f", "v")).where(
        F.col("v").isNotNull() & ~F.isnan("v")
    )
    distinct = pin(values.distinct())
    counts = {r["f"]: r["n"] for r in distinct.groupBy("f").agg(F.count(F.lit(1)).alias("n")).collect()}
    few = [f for f, n in counts.items() if n <= bins + 1]
    edges = [np.empty(0) for _ in names]
    listed: dict[int, list[float]] = {f: [] for f in few}
    for f, v in distinct.where(F.col("f").isin(few)).collect():  # at most names * (bins + 1) values
        listed[f].append(v)
    for f, v in listed.items():
        v = np.sort(v)
        edges[f] = np.maximum((v[:-1] + v[1:]) / 2, v[:-1])
    if len(few) < len(counts):
        shares = [(i + 1) / (bins + 1) for i in range(bins)]
        wide = values.where(~F.col("f").isin(few)).groupBy("f").agg(F.percentile_approx("v", shares, 100_000).alias("q"))
        for f, q in wide.collect():
            edges[f] = np.unique(q)
    release(distinct)
    return edges


_STATE = "codes binary, label binary, score binary, g binary, h binary"
_HISTOGRAM = "node int, feature int, bin int, g bigint, h bigint, n bigint"


def _packed(rows: DataFrame, names: list[str], edges: list[np.ndarray]) -> DataFrame:
    """One row a request: bins of its items' features, labels, scores of 0. A pool bounds a request."""
    x = F.array(*[F.col(n).cast("double") for n in names])
    listed = F.array_sort(F.collect_list(F.struct("item_id", F.col("label").cast("int").alias("label"), x.alias("x"))))
    packed = rows.groupBy("request_id").agg(listed.alias("t")).select(
        F.transform("t", lambda r: r["label"]).alias("label"),
        F.flatten(F.transform("t", lambda r: r["x"])).alias("x"),
    )

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for label, flat_x in zip(frame["label"], frame["x"]):
                label = np.asarray(label, dtype=np.uint8)
                table = np.asarray(flat_x, dtype=float).reshape(len(label), len(edges))
                # Bin b holds values up to edge b; a missing one sorts last.
                codes = np.stack([np.searchsorted(e, table[:, f]) for f, e in enumerate(edges)], axis=1)
                zeros = np.zeros(len(label)).tobytes()
                out.append((codes.astype(np.uint8).tobytes(), label.tobytes(), zeros, b"", b""))
            yield pd.DataFrame(out, columns=["codes", "label", "score", "g", "h"])

    return packed.mapInPandas(pack, _STATE)


def _codes(raw: bytes, features: int) -> np.ndarray:
    return np.frombuffer(raw, np.uint8).reshape(-1, features)


def _advance(state: DataFrame, tree: FlatTree | None, features: int, rate: float, truncation: int) -> DataFrame:
    """Scores with the last tree added, and the gradients at them in fixed point, so that sums are exact."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for codes, label, score in zip(frame["codes"], frame["label"], frame["score"]):
                now = np.frombuffer(score)
                if tree is not None:
                    now = now + rate * np.array(tree.value)[tree.leaves(_codes(codes, features))]
                g, h = lambdas(now, np.frombuffer(label, np.uint8).astype(int), truncation)
                fixed = [np.rint(v * FIXED).astype(np.int64).tobytes() for v in (g, h)]
                out.append((codes, label, now.tobytes(), *fixed))
            yield pd.DataFrame(out, columns=["codes", "label", "score", "g", "h"])

    return state.mapInPandas(run, _STATE)


def _histogram(state: DataFrame, tree: FlatTree, nodes: list[int], features: int) -> np.ndarray:
    """(node, feature, bin, [g, h, n]) sums of the rows in the given leaves, exact integers.

    Every task adds up its rows first; nodes x features x bins cells come to the driver.
    """
    slot = np.full(len(tree.feature), -1)
    slot[nodes] = np.arange(len(nodes))
    shape = (len(nodes), features, BINS + 1)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((3, int(np.prod(shape))), dtype=np.int64)
        for frame in frames:
            if not len(frame):
                continue
            codes = _codes(b"".join(frame["codes"]), features)
            own = slot[tree.leaves(codes)]
            g, h = (np.frombuffer(b"".join(frame[c]), np.int64) for c in ("g", "h"))
            codes, g, h, own = codes[own >= 0], g[own >= 0], h[own >= 0], own[own >= 0]
            for f in range(features):
                cell = (own * features + f) * (BINS + 1) + codes[:, f]
                for at, v in enumerate((g, h, 1)):
                    np.add.at(sums[at], cell, v)
        cell = np.flatnonzero(sums[2])
        node, feature, bin_ = np.unravel_index(cell, shape)
        yield pd.DataFrame({
            "node": node.astype(np.int32), "feature": feature.astype(np.int32), "bin": bin_.astype(np.int32),
            "g": sums[0][cell], "h": sums[1][cell], "n": sums[2][cell],
        })

    cells = state.mapInPandas(run, _HISTOGRAM).groupBy("node", "feature", "bin").agg(
        *[F.sum(c).alias(c) for c in ("g", "h", "n")]
    )
    out = np.zeros((*shape, 3), dtype=np.int64)
    for r in cells.collect():
        out[r["node"], r["feature"], r["bin"]] = r["g"], r["h"], r["n"]
    return out


def _best_split(cells: np.ndarray, edges: list[np.ndarray], min_rows: int, min_hessian: float):
    """(gain, feature, bin, left sums, right sums) of one node, or None; the first of equal gains."""
    total = cells[0].sum(axis=0)

    def worth(g, h):
        return np.where(h > 0, g * g / np.maximum(h, 1e-300), 0.0)

    best = None
    for f, e in enumerate(edges):
        left = np.cumsum(cells[f], axis=0)[: len(e)]
        right = total - left
        g, h = left[:, 0] / FIXED, left[:, 1] / FIXED
        G, H = right[:, 0] / FIXED, right[:, 1] / FIXED
        gain = worth(g, h) + worth(G, H) - worth(total[0] / FIXED, total[1] / FIXED)
        fits = (left[:, 2] >= min_rows) & (right[:, 2] >= min_rows) & (h >= min_hessian) & (H >= min_hessian)
        gain = np.where(fits, gain, -np.inf)
        if len(e) and gain.max() > 1e-12 and (best is None or gain.max() > best[0]):
            b = int(np.argmax(gain))
            best = (float(gain[b]), f, b, left[b], right[b])
    return best


def _grow(
    state: DataFrame, edges: list[np.ndarray], depth: int, leaves: int, min_rows: int, min_hessian: float
) -> FlatTree:
    """One tree, a level at a time: one aggregate a level, splits by gain while leaves are left."""
    tree, frontier = FlatTree(), [0]
    for level in range(max(1, depth)):
        cells = _histogram(state, tree, frontier, len(edges))
        if level == 0:
            g, h, _ = cells[0][0].sum(axis=0)
            tree.value[0] = float(g / h) if h > 0 else 0.0
        found = [(node, _best_split(c, edges, min_rows, min_hessian)) for node, c in zip(frontier, cells)]
        found = sorted(((n, s) for n, s in found if s is not None), key=lambda x: (-x[1][0], x[0]))
        room = leaves - sum(f < 0 for f in tree.feature)
        frontier = []
        for node, (_, feature, bin_, *sides) in found[: max(0, room)]:
            for child, (g, h, _) in zip(tree.split(node, feature, bin_), sides):
                tree.value[child] = float(g / h) if h > 0 else 0.0
                frontier.append(child)
        if not frontier:
            break
    return tree


def fit_lambdamart(
    rows: DataFrame,
    names: list[str],
    rounds: int = 50,
    depth: int = 5,
    rate: float = 0.1,
    min_rows: int = 20,
    leaves: int = 31,
    truncation: int = TRUNCATION,
    min_hessian: float = 1e-3,
    bins: int = BINS,
    seed: int = 42,
) -> dict[str, Any]:
    """Ensemble as plain data: {"features", "rate", "trees"}. ``rows``: (request_id, item_id, names, label).

    Features are binned once. A round adds the last tree to the scores that the table of requests
    carries, takes the gradients at them, and grows one tree from histograms: one small aggregate a
    level, so cost is linear in rounds. A leaf's value is its Newton step. Rows that nothing pulls at
    count for ``min_rows`` and weigh nothing. ``leaves`` bounds a tree, ``truncation`` the ranks that
    pairs are taken from. Nothing is drawn, so ``seed`` changes nothing; sums are integers, so reruns agree.
    """
    if rows.where(F.col("label") == 1).isEmpty():
        raise ValueError("learned fusion needs validation positives in the candidate pools")
    if not 1 <= bins <= BINS or leaves < 2 or truncation < 1:
        raise ValueError(f"bins must be 1 to {BINS}, leaves at least 2 and truncation positive")
    edges = bin_edges(rows, names, bins)
    state = pin(_packed(rows, names, edges))
    tree, trees = None, []
    for _ in range(max(1, rounds)):
        after = pin(_advance(state, tree, len(names), rate, truncation))
        release(state)
        state = after
        tree = _grow(state, edges, depth, leaves, min_rows, min_hessian)
        trees.append(tree.nested(edges))
    release(state)
    return {"features": names, "rate": rate, "trees": trees}


# --------------------------------------------------------------------------- exact serving


def _thresholds(tree: dict[str, Any], out: dict[int, set[float]]) -> None:
    if "value" not in tree:
        out.setdefault(tree["feature"], set()).add(float(tree["threshold"]))
        _thresholds(tree["left"], out)
        _thresholds(tree["right"], out)


def ensemble_cuts(ensemble: dict[str, Any], view: ScoreView) -> tuple[list[float], list[float]]:
    """Thresholds on a view's (score, reciprocal rank) in any tree."""
    cuts: dict[int, set[float]] = {}
    for tree in ensemble["trees"]:
        _thresholds(tree, cuts)
    names = ensemble["features"]
    return tuple(sorted(cuts.get(names.index(f"{view.name}_{kind}"), ())) for kind in ("score", "rr"))


def rank_cuts(thresholds: list[float], n: int, constant: float) -> list[int]:
    """Ranks after which a split on the reciprocal rank goes the other way, inside 1..n."""
    out = set()
    for t in thresholds:
        if t <= 0:
            continue
        rank = max(0, int(min(1.0 / t - constant, n + 1.0)))
        while rank > 0 and 1.0 / (constant + rank) <= t:
            rank -= 1
        while rank < n and 1.0 / (constant + rank + 1) > t:
            rank += 1
        if 0 < rank < n:
            out.add(rank)
    return sorted(out)


def vector_depth(ensemble: dict[str, Any], view: ScoreView, space: ItemSpace, constant: float) -> int:
    """Rank past which no split tells two items apart by their inner products."""
    scores, ranks = ensemble_cuts(ensemble, view)
    return space.n if scores else min(space.n, max(rank_cuts(ranks, space.n, constant), default=0) + 1)


def _cells(
    ensemble: dict[str, Any], views: list[ScoreView], space: ItemSpace, constant: float
) -> tuple[DataFrame, dict[str, list[int]]]:
    """(item_id, pos, cell, q), and the rank cuts of every view.

    Items of one cell lie between the same cuts of every shared base ranking; q is the item's place
    among them in id order. The cuts of scores and ranks bound the number of cells, not the items.
    """
    items, cell, cuts = space.items, F.lit(0).cast("bigint"), {}
    for view in views:
        scores, rr = ensemble_cuts(ensemble, view)
        cuts[view.name] = rank_cuts(rr, space.n, constant)
        if view.base is None:
            continue
        edges = set(cuts[view.name])
        if scores:
            above = view.base.agg(*[F.count_if(F.col("score") > t).alias(f"s{i}") for i, t in enumerate(scores)]).first()
            edges |= {int(x) for x in above if 0 < x < space.n}
        if not edges:
            continue
        listed = F.array(*[F.lit(e).cast("bigint") for e in sorted(edges)])
        column = f"_seg_{view.name}"
        place = F.size(F.filter(listed, lambda e: e < F.col("_base"))).cast("bigint")
        base = view.base.select("item_id", F.col("pos").alias("_base")).select("item_id", place.alias(column))
        items = items.join(base, "item_id")
        cell = cell * (len(edges) + 1) + F.col(column)
    placed = items.select("item_id", "pos", cell.alias("cell"))
    return pin(group_positions(placed, ["cell"], [F.col("pos")], "q")), cuts


def _zero_cuts(
    view: ScoreView, ranks: list[int], batch: QueryBatch, space: ItemSpace, seen: DataFrame | None
) -> DataFrame:
    """(request_id, beta): id-order places after which the view's unscored items pass a rank cut."""
    requests = _sparse_requests(view, batch.requests)
    live = view.nonzero if seen is None else view.nonzero.join(seen, ["request_id", "item_id"], "left_anti")
    blocked = live.select("request_id", "item_id")
    if seen is not None:
        blocked = blocked.union(seen.select("request_id", "item_id")).distinct()
    ahead = live.groupBy("request_id").agg(F.count_if(F.col("score") > 0).alias("p"))
    free = requests.join(ahead, "request_id", "left").withColumn(
        "cut", F.explode(F.array(*[F.lit(r).cast("bigint") for r in ranks]))
    ).withColumn("nth", F.col("cut") - F.coalesce("p", F.lit(0))).where("nth > 0")
    # The j-th blocked place, e, stands before the nth free one exactly when e - j < nth.
    order = group_positions(_with_pos(blocked, space.items), ["request_id"], [F.col("pos")], "j", hot=batch.hot)
    marks = order.select("request_id", (F.col("pos") - F.col("j")).alias("pos"))
    points = free.select("request_id", (F.col("nth") - 1).alias("pos"))
    found = marks_ahead(points, marks, batch.hot)
    return found.select("request_id", (F.col("pos") + 1 + F.col("ahead")).alias("beta")).where(F.col("beta") < space.n)


def learned_pool(
    ensemble: dict[str, Any],
    views: list[ScoreView],
    batch: QueryBatch,
    space: ItemSpace,
    k: int,
    seen: DataFrame | None,
    constant: float,
) -> DataFrame:
    """(request_id, item_id) pairs that hold the ensemble's top k of every request.

    Trees are constant on boxes: stretches of the base rankings between cuts, crossed with stretches of
    id order between the cuts of unscored ranks. In a box all unscored items tie, so only its k lowest
    free ids compete. Explicit scores, items near the top of a vector ranking, and base items that
    seen items may carry across a cut are in the pool by name; so a request's pool is bounded by
    those and boxes x k. Where that is more than the catalog, the pool is the catalog.
    """
    named = [v.nonzero.select("request_id", "item_id") for v in views if v.nonzero is not None]
    hidden = None if seen is None else seen.select("request_id", "item_id")
    shift = None if seen is None else seen.groupBy("request_id").agg(F.count(F.lit(1)).alias("n"))
    for view in views:
        if view.vectors is not None:
            depth = batch.requests.select("request_id", F.lit(vector_depth(ensemble, view, space, constant)).alias("depth"))
            if shift is not None:
                depth = depth.join(shift, "request_id", "left").select(
                    "request_id", (F.col("depth") + F.coalesce("n", F.lit(0))).cast("bigint").alias("depth")
                )
            named.append(prefix(view, batch, space, depth))
    cells, cuts = _cells(ensemble, views, space, constant)
    sizes = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("size"))
    for view in views:
        if view.base is not None and shift is not None and cuts[view.name]:
            using = shift.join(_base_requests(view, batch.requests), "request_id", "left_semi")
            at = using.withColumn("cut", F.explode(F.array(*[F.lit(r).cast("bigint") for r in cuts[view.name]])))
            moved = at.select("request_id", F.explode(F.sequence(
                F.col("cut") + 1, F.least(F.col("cut") + F.col("n"), F.lit(space.n))
            )).alias("pos"))
            named.append(moved.join(view.base.select("item_id", "pos"), "pos").select("request_id", "item_id"))
    pool = union_all(named).distinct() if named else None
    if pool is not None and hidden is not None:
        pool = pool.join(hidden, ["request_id", "item_id"], "left_anti")
    pool = None if pool is None else pin(pool)
    taken = [x for x in (pool, hidden) if x is not None]
    taken = union_all(taken) if taken else None
    zero = [v for v in views if v.nonzero is not None and cuts[v.name]]
    boxes = sizes.count() * (1 + sum(len(cuts[v.name]) for v in zero))
    if boxes * k * BOX_SHARE >= space.n:
        need = batch.requests.select("request_id", F.lit(space.n).cast("bigint").alias("need"))
        excluded = space.items.select(F.lit(None).cast(batch.requests.schema["request_id"].dataType).alias("request_id"), "pos").limit(0)
        if taken is not None:
            excluded = _with_pos(taken, space.items)
        rest = first_free(excluded, need, "request_id", space.n, hot=batch.hot).join(space.items, "pos")
    else:
        rest = _lowest_of_boxes(cells, sizes, [_zero_cuts(v, cuts[v.name], batch, space, seen) for v in zero], batch, k, taken)
    rest = rest.select("request_id", "item_id")
    return pin(rest if pool is None else pool.select("request_id", "item_id").union(rest))


def _lowest_of_boxes(
    cells: DataFrame, sizes: DataFrame, betas: list[DataFrame], batch: QueryBatch, k: int, taken: DataFrame | None
) -> DataFrame:
    """The k lowest items of every box that are not taken: of every cell, from every id-order cut on."""
    first = batch.requests.select("request_id", F.lit(0).cast("bigint").alias("beta"))
    cuts = pin(union_all([first, *betas]).distinct())
    boxes = cuts.join(F.broadcast(sizes), how="cross")  # cells are bounded by the cuts of the trees
    # How many of a cell's items lie at or before the cut: cuts and items of a cell sorted together.
    points = boxes.select(F.col("cell").alias("request_id"), F.col("beta").alias("pos"), F.col("request_id").alias("r"), "size")
    marks = cells.select(F.col("cell").alias("request_id"), "pos")
    counted = marks_ahead(points, marks, hot_groups(cells, ["cell"]))
    box = F.struct(
        F.col("r"), F.col("request_id").alias("cell"), F.col("ahead").alias("start"), (F.col("size") - F.col("ahead")).alias("left")
    )
    starts = pin(counted.select(box.alias("g")).distinct().where("g.left > 0"))
    need = starts.select("g", F.least(F.lit(k), F.col("g.left")).cast("bigint").alias("need"))
    if taken is None:
        free = need.select("g", F.explode(F.sequence(F.lit(1).cast("bigint"), "need")).alias("pos"))
    else:
        there = taken.join(cells.select("item_id", "cell", "q"), "item_id")
        same = (there["request_id"] == F.col("g.r")) & (there["cell"] == F.col("g.cell"))
        excluded = starts.join(there, same).where(F.col("q") > F.col("g.start")).select("g", (F.col("q") - F.col("g.start")).alias("pos"))
        free = first_free(excluded, need, "g", F.col("g.left"))
    found = free.select(F.col("g.r").alias("request_id"), F.col("g.cell").alias("cell"), (F.col("pos") + F.col("g.start")).alias("q"))
    return found.distinct().join(cells.select("cell", "q", "item_id"), ["cell", "q"])


def learned_topk(
    ensemble: dict[str, Any],
    views: list[ScoreView],
    batch: QueryBatch,
    space: ItemSpace,
    k: int,
    seen: DataFrame | None,
    constant: float = RRF_CONSTANT,
) -> DataFrame:
    """Top k of the ensemble over the whole catalog; equal scores go by item."""
    views = [v.expanded() for v in views]
    pool = learned_pool(ensemble, views, batch, space, k, seen, constant)
    rows = features(views, batch, space, pool, seen, constant)
    return top_k(rows.select("request_id", "item_id", ensemble_scores(ensemble).alias("score")), k)
