"""Scores of many requests over the whole catalog, kept sparse.

Every model scores every item, but most scores are implied. A :class:`ScoreView` states a model's
scores as one of: explicit non-zero rows over an all-zero base; a base ranking shared by all
requests; or inner products. Ranks, top-k and prefixes are exact without requests x items rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions.ids import plain_ids, restore_ids
from kindred.functions.names import find
from kindred.functions.numbers import SCORE_DIGITS, is_finite, quantize
from kindred.operators import textsim
from kindred.operators.lists import exact
from kindred.operators.pairs import sum_tasks
from kindred.operators.positions import first_free, group_positions
from kindred.operators.vectors import inner_product_topk, locate, matrix, sum_vectors, tiled
from kindred.plans.fitted import KNOWN_USER, FittedModel, ItemSpace, QueryBatch
from kindred.session import pin


POINTS = 1024  # pool entries of one request that travel together


@dataclass
class ScoreView:
    """``nonzero`` (request_id, item_id, score), ``base`` (item_id, score, pos), or ``vectors``.

    ``base_requests`` lists the requests that use the base; None means all of them.
    ``factored`` (history, item_docs, weights) states text scores per document; they are expanded to
    ``nonzero`` rows only where a caller needs every one of them. ``listed`` (vector, similarity, hot) states
    weighted histories; they are written out as ``nonzero`` rows where a caller needs the rows.
    """

    name: str
    nonzero: DataFrame | None = None
    base: DataFrame | None = None
    base_requests: DataFrame | None = None
    vectors: tuple[DataFrame, DataFrame] | None = None
    factored: tuple[DataFrame, DataFrame, DataFrame] | None = None
    listed: tuple[DataFrame, DataFrame, DataFrame | None] | None = None
    _ranked: DataFrame | None = None

    def expanded(self) -> "ScoreView":
        """The same view with its factored or listed scores written out per item."""
        if self.listed is not None and self.nonzero is None:
            self.nonzero = pin(weighted_history(*self.listed))
        if self.factored is None or self.nonzero is not None:
            return self
        history, item_docs, weights = self.factored
        near = pin(textsim.near_documents(history, item_docs, weights))
        return ScoreView(self.name, nonzero=pin(textsim.factored_scores(near, history, item_docs)))

    def ranked(self, batch: QueryBatch) -> DataFrame:
        """Explicit scores with their rank among those of the same sign, written once."""
        if self._ranked is None:
            self._ranked = pin(_signed_ranks(self.nonzero, batch))
        return self._ranked


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


# --------------------------------------------------------------------------- building views


def popularity_base(train: DataFrame, space: ItemSpace) -> DataFrame:
    """(item_id, score, pos): summed training values of every item, ranked best first."""
    sums = train.groupBy("item_id").agg(quantize(F.sum("value")).alias("score"))
    scored = space.items.select("item_id").join(sums, "item_id", "left").select(
        "item_id", F.coalesce("score", F.lit(0.0)).alias("score")
    )
    return group_positions(scored, [], [-F.col("score"), F.col("item_id")], "pos")


def weighted_history(vector: DataFrame, similarity: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """Sum of value * weight over the rows of the history items.

    Without ``hot`` requests the products of an item travel as one row to the task that sums the request;
    otherwise they are single rows, which spread a request over all tasks.
    """
    used = vector.where(F.col("value") != 0)
    edges = similarity.withColumnRenamed("item", "item_id")
    if hot is None:
        edge_rows, items, whole = edges.agg(F.count(F.lit(1)), F.count_distinct("item_id"), F.bool_and(exact(F.col("weight")))).first()
        kind = edges.schema["other"].dataType.simpleString()
        low, high = edges.agg(F.min("other"), F.max("other")).first() if kind == "bigint" else (None, None)
        # Ids and grid steps of weights travel in four bytes where they fit.
        other = F.col("other").cast("int") if low is not None and -(1 << 31) <= low and high < 1 << 31 else F.col("other")
        grid = F.lit(10.0**SCORE_DIGITS)
        weight = F.rint(F.col("weight") * grid).cast("int") if whole else F.col("weight")
        near = edges.groupBy("item_id").agg(F.collect_list(F.struct(other.alias("other"), weight.alias("weight"))).alias("_near"))
        lists = near.select("item_id", F.col("_near.other").alias("_others"), F.col("_near.weight").alias("_weights"))
        parts = sum_tasks(vector.sparkSession, used.count() * edge_rows / max(items, 1))
        packed = used.join(lists, "item_id").select("request_id", "value", "_others", "_weights").repartition(parts, "request_id")
        products = packed.select("request_id", "value", F.explode(F.arrays_zip("_others", "_weights")).alias("_n")).select(
            "request_id", "value", F.col("_n._others").cast(kind).alias("other"),
            (F.col("_n._weights") / grid if whole else F.col("_n._weights")).alias("weight"),
        )
    else:
        products = used.join(edges, "item_id")
    return (
        products.groupBy("request_id", "other")
        .agg(quantize(F.sum(F.col("value") * F.col("weight"))).alias("score"))
        .where(F.col("score") != 0)
        .select("request_id", F.col("other").alias("item_id"), "score")
    )


def last_item_rows(last: DataFrame, similarity: DataFrame) -> DataFrame:
    """The similarity row of each request's last item."""
    return (
        last.join(similarity.withColumnRenamed("item", "item_id"), "item_id")
        .where(F.col("weight") != 0)
        .select("request_id", F.col("other").alias("item_id"), F.col("weight").alias("score"))
    )


def history_profile(vector: DataFrame, items: DataFrame, dim: int) -> DataFrame:
    """(qid, vec): sum(w * e) / sum(|w|) over the history; items is (item, vec)."""
    joined = vector.where(F.col("value") != 0).join(
        items.withColumnRenamed("item", "item_id"), "item_id"
    ).select("request_id", "value", F.col("vec").cast("array<double>").alias("vec"))
    total = F.sum(F.abs("value")).alias("total")
    summed = sum_vectors(joined.groupBy("request_id"), "vec", dim, [total], F.col("value"))
    scale = F.when(F.col("total") > 0, F.col("total")).otherwise(F.lit(1.0))
    return summed.select(
        F.col("request_id").alias("qid"), F.transform("vec", lambda x: x / scale).alias("vec")
    )


def _popularity_view(model: FittedModel, batch: QueryBatch) -> ScoreView:
    return ScoreView(model.plugin, base=model.tables["scores"])


def _sparse_view(model: FittedModel, batch: QueryBatch) -> ScoreView:
    name, tables = model.plugin, model.tables
    if model.params.get("form") == "factored":
        history = batch.vector.where(F.col("value") != 0)
        return ScoreView(name, factored=(history, tables["item_docs"], tables["weights"]))
    if model.params.get("aggregation") == "last_item" and batch.last is not None:
        return ScoreView(name, nonzero=pin(last_item_rows(batch.last, tables["similarity"])))
    return ScoreView(name, listed=(batch.vector, tables["similarity"], batch.hot))


def _sequential_view(model: FittedModel, batch: QueryBatch) -> ScoreView:
    """The last item's row; requests without one get the popularity base."""
    tables, last = model.tables, batch.last
    if batch.mode == KNOWN_USER:
        last = batch.of_users(tables["last_items"])
    rows = pin(last_item_rows(last, tables["similarity"]))
    others = batch.requests.select("request_id").join(rows.select("request_id").distinct(), "request_id", "left_anti")
    return ScoreView(model.plugin, nonzero=rows, base=tables["scores"], base_requests=others)


def _embedding_view(model: FittedModel, batch: QueryBatch) -> ScoreView:
    items = model.tables["items"]
    if batch.mode == KNOWN_USER:
        queries = batch.of_users(model.tables["users"]).select(F.col("request_id").alias("qid"), "vec")
    else:
        queries = history_profile(batch.vector, items, model.params["dim"])
    return ScoreView(model.plugin, vectors=(queries, items))


def encoded(encode: Callable[[FittedModel, QueryBatch], DataFrame]) -> Callable[[FittedModel, QueryBatch], ScoreView]:
    """Runtime of a model that turns requests into query vectors (qid, vec) for its item vectors."""
    return lambda model, batch: ScoreView(model.plugin, vectors=(encode(model, batch), model.tables["items"]))


#: (model, batch) -> ScoreView, by the runtime that a fitted model names.
RUNTIMES: dict[str, Callable[[FittedModel, QueryBatch], ScoreView]] = {
    "popularity": _popularity_view, "sparse": _sparse_view, "sequential": _sequential_view, "embedding": _embedding_view,
}


def score_view(model: FittedModel, batch: QueryBatch) -> ScoreView:
    """Scores of one non-hybrid model for a batch of queries; explicit scores are written once."""
    return find(RUNTIMES, "runtime", model.runtime)(model, batch)


# --------------------------------------------------------------------------- masks and ranks


def seen_pairs(batch: QueryBatch) -> DataFrame:
    """(request_id, item_id) with a non-zero value; stored zeros are not seen."""
    return batch.vector.where(F.col("value") != 0).select("request_id", "item_id")


def _rank(by: str, order: list[Column], k: int, df: DataFrame) -> DataFrame:
    window = Window.partitionBy(by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(window).cast("bigint")).where(
        F.col("rank") <= k
    )


def top_k(scores: DataFrame, k: int, seen: DataFrame | None = None) -> DataFrame:
    """Best k finite, unseen rows per request: score descending, then item ascending.

    The literal bound lets Spark drop rows past k in every map task, before the shuffle.
    """
    kept = scores.where(is_finite(F.col("score")))
    if seen is not None:
        kept = kept.join(seen, ["request_id", "item_id"], "left_anti")
    return _rank("request_id", [F.col("score").desc(), F.col("item_id")], k, kept)


def _with_pos(pairs: DataFrame, table: DataFrame) -> DataFrame:
    return pairs.select("request_id", "item_id").join(table.select("item_id", "pos"), "item_id")


#: Base positions that every task may hold.
FIRST_POSITIONS = 100_000


def near_positions(tables: list[DataFrame], order: DataFrame, k: int) -> DataFrame:
    """(request_id, item_id, pos): pairs of any of the tables that can stand before the first k free places.

    None lies past k + the pairs of a request. Where no request has many, few places of the order matter
    and the pairs elsewhere do not travel.
    """
    counts = union_all([t.select("request_id") for t in tables]).groupBy("request_id").agg(F.count(F.lit(1)).alias("n"))
    last = k + (counts.agg(F.max("n")).first()[0] or 0)
    first = order.where(F.col("pos") <= last)
    first = F.broadcast(first) if last <= FIRST_POSITIONS else first
    placed = [_with_pos(t, first) for t in tables]
    return placed[0] if len(placed) == 1 else union_all(placed).distinct()


def _base_requests(view: ScoreView, requests: DataFrame) -> DataFrame:
    return requests.select("request_id") if view.base_requests is None else view.base_requests


def _sparse_requests(view: ScoreView, requests: DataFrame) -> DataFrame:
    ids = requests.select("request_id")
    if view.base is None:
        return ids
    return ids.join(view.base_requests, "request_id", "left_anti")


def view_topk(
    view: ScoreView, batch: QueryBatch, space: ItemSpace, k: int, seen: DataFrame | None
) -> DataFrame:
    """(request_id, item_id, score, rank): exact top-k over the whole catalog."""
    if view.factored is not None and view.nonzero is None:
        return _factored_topk(view, batch, space, k, seen)
    view = view.expanded()
    parts: list[DataFrame] = []
    none_seen = seen is None
    if view.vectors is not None:
        queries, items = view.vectors
        masked = None if none_seen else seen.select(
            F.col("request_id").alias("qid"), F.col("item_id").alias("item")
        )
        best = inner_product_topk(queries, items, k, masked)
        parts.append(best.select(
            F.col("qid").alias("request_id"), F.col("item").alias("item_id"), "score"
        ))
    if view.base is not None:
        requests = _base_requests(view, batch.requests)
        excluded = _empty_positions(requests) if none_seen else near_positions([seen], view.base, k)
        free = first_free(
            excluded, requests.withColumn("need", F.lit(k)), "request_id", space.n, hot=batch.hot
        )
        # Few positions, many requests: adaptive skew join splits the left side.
        parts.append(free.join(view.base, "pos").select("request_id", "item_id", "score"))
    if view.nonzero is not None:
        requests = _sparse_requests(view, batch.requests)
        unseen = view.nonzero if none_seen else view.nonzero.join(
            seen, ["request_id", "item_id"], "left_anti"
        )
        above = top_k(unseen.where(F.col("score") > 0), k).drop("rank")
        below = top_k(unseen.where(F.col("score") < 0), k).drop("rank")
        found = above.groupBy("request_id").agg(F.count(F.lit(1)).alias("found"))
        need = requests.join(found, "request_id", "left").select(
            "request_id", (F.lit(k) - F.coalesce("found", F.lit(0))).alias("need")
        )
        taken = [view.nonzero] if none_seen else [view.nonzero, seen]
        free = first_free(
            near_positions(taken, space.items, k), need, "request_id", space.n, hot=batch.hot
        )
        zeros = free.join(space.items, "pos").select(
            "request_id", "item_id", F.lit(0.0).alias("score")
        )
        parts += [above, zeros, below]
    return top_k(union_all(parts), k)


def _factored_topk(
    view: ScoreView, batch: QueryBatch, space: ItemSpace, k: int, seen: DataFrame | None
) -> DataFrame:
    """Positive scores come from the best documents; only requests short of k expand the rest."""
    history, item_docs, weights = view.factored
    reach = history.groupBy("request_id").agg((F.count(F.lit(1)) + k).alias("reach"))
    near = pin(textsim.best_documents(history, item_docs, weights, reach))
    candidates = textsim.factored_candidates(near, history, item_docs, k)
    above = pin(top_k(candidates.where(F.col("score") > 0), k, seen))
    full = above.groupBy("request_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == k)
    short = pin(batch.requests.select("request_id").join(full, "request_id", "left_anti"))
    if short.isEmpty():
        return above

    def only(df: DataFrame | None) -> DataFrame | None:
        return None if df is None else df.join(short, "request_id", "left_semi")

    some = QueryBatch(batch.mode, short, only(batch.vector), hot=batch.hot)
    left = pin(only(history))
    rest = ScoreView(view.name, nonzero=pin(textsim.factored_scores(
        pin(textsim.near_documents(left, item_docs, weights)), left, item_docs
    )))
    served = above.join(short, "request_id", "left_anti")
    return served.unionByName(view_topk(rest, some, space, k, only(seen)).select(served.columns))


def _empty_positions(requests: DataFrame) -> DataFrame:
    return requests.select("request_id", F.lit(1).cast("bigint").alias("pos")).limit(0)


def prefix(
    view: ScoreView, batch: QueryBatch, space: ItemSpace, depth: DataFrame
) -> DataFrame:
    """(request_id, item_id): items ranked within ``depth`` (request_id, depth) by the view."""
    view = view.expanded()
    parts: list[DataFrame] = []
    if view.vectors is not None:
        deepest = min(space.n, depth.agg(F.max("depth")).first()[0] or 1)
        ranked = inner_product_topk(*view.vectors, int(deepest)).select(
            F.col("qid").alias("request_id"), F.col("item").alias("item_id"), "rank"
        )
        parts.append(ranked.join(depth, "request_id").where(F.col("rank") <= F.col("depth")))
    if view.base is not None:
        spans = depth.join(_base_requests(view, batch.requests), "request_id", "left_semi")
        listed = spans.select("request_id", F.explode(F.sequence(
            F.lit(1).cast("bigint"), F.least(F.col("depth"), F.lit(space.n)).cast("bigint")
        )).alias("pos"))
        parts.append(listed.join(view.base, "pos"))
    if view.nonzero is not None:
        spans = depth.join(_sparse_requests(view, batch.requests), "request_id", "left_semi")
        signed = view.ranked(batch)
        above = signed.where(F.col("score") > 0).join(spans, "request_id").where(
            F.col("rank") <= F.col("depth")
        )
        sizes = _sizes(view.nonzero)
        need = spans.join(sizes, "request_id", "left").select(
            "request_id", "depth",
            F.coalesce("positives", F.lit(0)).alias("positives"),
            F.coalesce("stored", F.lit(0)).alias("stored"),
        )
        deepest = spans.agg(F.max("depth")).first()[0] or 0
        free = first_free(
            near_positions([view.nonzero], space.items, deepest),
            need.select("request_id", (F.col("depth") - F.col("positives")).alias("need")),
            "request_id", space.n, hot=batch.hot,
        )
        parts += [above, free.join(space.items, "pos")]
        below = signed.where(F.col("score") < 0).join(need, "request_id").where(
            F.col("rank") + F.col("positives") + F.lit(space.n) - F.col("stored") <= F.col("depth")
        )
        parts.append(below)
    return union_all([p.select("request_id", "item_id") for p in parts])


def _sizes(nonzero: DataFrame) -> DataFrame:
    return nonzero.groupBy("request_id").agg(
        F.count_if(F.col("score") > 0).alias("positives"), F.count(F.lit(1)).alias("stored")
    )


def _signed_ranks(nonzero: DataFrame, batch: QueryBatch) -> DataFrame:
    """Rank among the request's scores of the same sign, best first."""
    signed = nonzero.withColumn("_up", F.col("score") > 0)
    return group_positions(
        signed, ["request_id", "_up"], [-F.col("score"), F.col("item_id")], "rank",
        hot=None if batch.hot is None else "detect",
    ).drop("_up")


def marks_ahead(points: DataFrame, marks: DataFrame, hot: DataFrame | None) -> DataFrame:
    """Add ``ahead``: marks (request_id, pos) of the same request at or before each point.

    Points and marks are sorted together once and the marks counted on the way.
    """
    columns = points.columns
    both = points.withColumn("_mark", F.lit(0)).unionByName(
        marks.select("request_id", "pos", F.lit(1).alias("_mark")), allowMissingColumns=True
    )
    if hot is None:
        window = Window.partitionBy("request_id").orderBy("pos").rangeBetween(
            Window.unboundedPreceding, Window.currentRow
        )
        return both.withColumn("ahead", F.sum("_mark").over(window)).where(
            F.col("_mark") == 0
        ).select(*columns, "ahead")
    order = [F.col("pos"), -F.col("_mark")]
    placed = group_positions(both, ["request_id"], order, "_at")
    own = group_positions(placed.where(F.col("_mark") == 0), ["request_id"], [F.col("_at")], "_own")
    return own.withColumn("ahead", F.col("_at") - F.col("_own")).select(*columns, "ahead")


def view_ranks(
    view: ScoreView,
    batch: QueryBatch,
    space: ItemSpace,
    pool: DataFrame,
    masked: DataFrame | None = None,
) -> DataFrame:
    """(request_id, item_id, score, rank) of the pool's pairs among the whole catalog.

    With ``masked`` the ranking leaves those pairs out (the pool must not contain them).
    """
    view = view.expanded()
    parts: list[DataFrame] = []
    pool = pool.select("request_id", "item_id")
    if view.vectors is not None:
        parts.append(_vector_ranks(view, pool, masked, batch))
    if view.base is not None:
        mine = pool
        if view.base_requests is not None:
            mine = pool.join(view.base_requests, "request_id", "left_semi")
        placed = mine.join(view.base, "item_id")
        if masked is None:
            ranked = placed.withColumn("rank", F.col("pos"))
        else:
            ranked = marks_ahead(placed, _with_pos(masked, view.base), batch.hot).withColumn(
                "rank", F.col("pos") - F.col("ahead")
            )
        parts.append(ranked)
    if view.nonzero is not None:
        mine = pool
        if view.base_requests is not None:
            mine = pool.join(view.base_requests, "request_id", "left_anti")
        stored = view.nonzero
        live = stored if masked is None else stored.join(
            masked, ["request_id", "item_id"], "left_anti"
        )
        ranked = view.ranked(batch) if masked is None else _signed_ranks(live, batch)
        sizes = _sizes(live)
        marks = live.select("request_id", "item_id")
        if masked is not None:
            marks = marks.union(masked.select("request_id", "item_id")).distinct()
        blocked = marks.groupBy("request_id").agg(F.count(F.lit(1)).alias("blocked"))
        hits = (
            mine.join(ranked, ["request_id", "item_id"])
            .join(sizes, "request_id")
            .join(blocked, "request_id")
            .withColumn("rank", F.when(F.col("score") > 0, F.col("rank")).otherwise(
                F.col("rank") + F.col("positives") + F.lit(space.n) - F.col("blocked")
            ))
        )
        zeros = mine.join(ranked, ["request_id", "item_id"], "left_anti").join(
            space.items, "item_id"
        )
        zeros = (
            marks_ahead(zeros, _with_pos(marks, space.items), batch.hot)
            .join(sizes, "request_id", "left")
            .withColumn("score", F.lit(0.0))
            .withColumn(
                "rank", F.coalesce("positives", F.lit(0)) + F.col("pos") - F.col("ahead")
            )
        )
        parts += [hits, zeros]
    return union_all([
        p.select("request_id", "item_id", "score", F.col("rank").cast("bigint").alias("rank"))
        for p in parts
    ])


def _vector_ranks(
    view: ScoreView, pool: DataFrame, masked: DataFrame | None, batch: QueryBatch
) -> DataFrame:
    """Score the pool's pairs, then count the better items tile by tile."""
    queries, items = view.vectors
    ids = {"request_id": pool.schema["request_id"].dataType,
           "item_id": pool.schema["item_id"].dataType}
    queries, items = plain_ids(queries, "qid"), plain_ids(items, "item")
    pool = plain_ids(pool, "request_id", "item_id")
    q_type = queries.schema["qid"].dataType.simpleString()
    i_type = items.schema["item"].dataType.simpleString()
    pairs = pool.select(F.col("request_id").alias("qid"), F.col("item_id").alias("item"))
    scale = 1e9

    def product(q: pd.DataFrame, i: pd.DataFrame) -> np.ndarray:
        return np.rint(matrix(q) @ matrix(i).T * scale) / scale

    def score(q: pd.DataFrame, i: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        at = locate(p["qid"], q["qid"]), locate(p["item"], i["item"])
        return pd.DataFrame({"qid": p["qid"], "item": p["item"], "score": product(q, i)[at]})

    def scores_of(some: DataFrame) -> DataFrame:
        known = some.join(queries.select("qid"), "qid", "left_semi").join(
            items.select("item"), "item", "left_semi"
        ).select("qid", "item")
        return tiled(queries, items, score, f"qid {q_type}, item {i_type}, score double", known)

    scored = scores_of(pairs)
    # Points travel with their query vector in lists of about POINTS entries, each list a row of
    # its own, so a request with a deep pool is spread like any other.
    sizes = scored.groupBy("qid").agg(
        F.ceil(F.count(F.lit(1)) / F.lit(POINTS)).cast("int").alias("parts")
    )
    lists = (
        scored.join(sizes, "qid")
        .withColumn("part", F.pmod(F.xxhash64("item"), F.col("parts")))
        .groupBy("qid", "part")
        .agg(F.collect_list(F.struct("qid", "score", "item")).alias("points"))
    )
    carried = queries.join(lists, "qid").select(
        F.concat_ws("#", F.col("qid").cast("string"), "part").alias("qid"), "vec", "points"
    )

    def count(q: pd.DataFrame, i: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        scores, ids = product(q, i), i["item"].to_numpy()
        out = []
        for row, points in enumerate(q["points"]):
            values = np.array([x["score"] for x in points])
            ordered = np.sort(scores[row])
            ahead = len(ids) - np.searchsorted(ordered, values, side="right")
            tied = np.searchsorted(ordered, values, side="left") < len(ids) - ahead
            for at, point in enumerate(points):
                more = 0
                if tied[at]:
                    more = int(((scores[row] == values[at]) & (ids < point["item"])).sum())
                out.append((point["qid"], point["item"], values[at], int(ahead[at]) + more))
        return pd.DataFrame(out, columns=["qid", "item", "score", "ahead"])

    counted = tiled(
        carried, items, count, f"qid {q_type}, item {i_type}, score double, ahead bigint",
        carry="points",
    )
    ranked = counted.groupBy("qid", "item").agg(
        F.first("score").alias("score"), (F.sum("ahead") + 1).alias("rank")
    ).select(F.col("qid").alias("request_id"), F.col("item").alias("item_id"), "score", "rank")
    ranked = restore_ids(ranked, ids)
    if masked is None:
        return ranked
    # Masked items ahead of a point have a smaller rank themselves.
    hidden = _vector_ranks(view, masked, None, batch).select(
        "request_id", F.col("rank").alias("pos")
    )
    return marks_ahead(ranked.withColumn("pos", F.col("rank")), hidden, batch.hot).withColumn(
        "rank", F.col("rank") - F.col("ahead")
    )
