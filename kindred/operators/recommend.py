"""Batch recommendation for known users and for session histories."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions.names import find
from kindred.operators.fusion import RRF_CONSTANT, rrf_topk, weighted_topk
from kindred.operators.positions import hot_groups
from kindred.operators.ranker import learned_topk
from kindred.operators.scoring import score_view, seen_pairs, top_k, view_topk
from kindred.operators.sequences import request_order
from kindred.operators.split import Prepared
from kindred.plans.fitted import HISTORY, KNOWN_USER, FittedModel, ItemSpace, QueryBatch

MAX_TOP_K = 1000
MAX_INTERACTIONS = 5000


# --------------------------------------------------------------------------- building batches


def user_batch(prepared: Prepared, users: DataFrame | None = None) -> QueryBatch:
    """Known users: the vector is the user's training row, its order is id order."""
    train = prepared.ratings("train").withColumnRenamed("user_id", "request_id")
    requests = (prepared.users if users is None else users).select(
        F.col("user_id").alias("request_id")
    )
    if users is not None:
        train = train.join(requests, "request_id", "left_semi")
    last = train.where(F.col("value") != 0).groupBy("request_id").agg(
        F.max("item_id").alias("item_id")
    )
    hot = prepared.hot_users
    return QueryBatch(
        KNOWN_USER, requests, train, last,
        hot=None if hot is None else hot.withColumnRenamed("user_id", "request_id"),
    )


def session_batch(interactions: DataFrame, bounded: bool = True) -> QueryBatch:
    """Sessions: (request_id, pos, item_id, value[, timestamp]); repeated items add up.

    Requests within the contract hold at most 5000 rows; pass ``bounded=False`` for anything else
    (evaluation replays whole user histories this way).
    """
    ranked = request_order(interactions) if bounded else interactions.withColumn(
        "rank", F.col("pos")
    )
    vector = interactions.groupBy("request_id", "item_id").agg(F.sum("value").alias("value"))
    last = ranked.groupBy("request_id").agg(F.max_by("item_id", "rank").alias("item_id"))
    hot = None if bounded else hot_groups(vector, ["request_id"])
    return QueryBatch(
        HISTORY,
        interactions.select("request_id").distinct(),
        vector,
        last,
        recent=ranked.select("request_id", "item_id", F.col("rank").alias("pos")),
        hot=hot,
    )


# --------------------------------------------------------------------------- request checks


def request_status(
    requests: DataFrame,
    interactions: DataFrame,
    users: DataFrame,
    items: DataFrame,
    modes: tuple[str, ...] = (KNOWN_USER, HISTORY),
) -> DataFrame:
    """(request_id, mode, status): bad requests become rows, they do not fail the batch.

    ``requests`` is (request_id, user_id, top_k), ``interactions`` (request_id, item_id, ...).
    """
    known = items.select("item_id", F.lit(1).alias("_known")).distinct()
    history = interactions.join(known, "item_id", "left").groupBy("request_id").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("_known").isNull()).alias("unknown")
    )
    known_users = users.select("user_id", F.lit(1).alias("_user")).distinct()
    has_user = F.col("user_id").isNotNull()
    rows = F.coalesce("rows", F.lit(0))
    mode = F.when(has_user, F.lit(KNOWN_USER)).otherwise(F.lit(HISTORY))
    status = (
        F.when(has_user == (rows > 0), "invalid_request")
        .when(F.col("top_k").isNull() | ~F.col("top_k").between(1, MAX_TOP_K), "invalid_request")
        .when(rows > MAX_INTERACTIONS, "invalid_request")
        .when(~mode.isin(*modes), "unsupported_query_mode")
        .when(has_user & F.col("_user").isNull(), "unknown_identifier")
        .when(~has_user & (F.col("unknown") > 0), "unknown_identifier")
        .otherwise("ok")
    )
    return (
        requests.join(history, "request_id", "left")
        .join(known_users, "user_id", "left")
        .select("request_id", mode.alias("mode"), status.alias("status"))
    )


def with_exhaustion(status: DataFrame, recommended: DataFrame) -> DataFrame:
    """Mark valid requests that got no row: nothing recommendable was left."""
    served = recommended.select("request_id").distinct().withColumn("_served", F.lit(1))
    empty = (F.col("status") == "ok") & F.col("_served").isNull()
    return status.join(served, "request_id", "left").select(
        "request_id", "mode", F.when(empty, "catalog_exhausted").otherwise(F.col("status")).alias(
            "status")
    )


# --------------------------------------------------------------------------- recommendation


def _fuse_rrf(views, batch, space, k, seen, params) -> DataFrame:
    constant = float(params.get("parameters", {}).get("rank_constant", RRF_CONSTANT))
    return rrf_topk(views, batch, space, k, seen, constant)


def _fuse_weighted(views, batch, space, k, seen, params) -> DataFrame:
    return weighted_topk(views, batch, space, k, seen, params.get("weights"))


def _fuse_learned(views, batch, space, k, seen, params) -> DataFrame:
    return learned_topk(params["trees"], views, batch, space, k, seen, params["trees"]["constant"])


def _rerank_external(candidates: DataFrame, batch: QueryBatch, k: int, scores: DataFrame | None) -> DataFrame:
    """Scores from outside replace the fused ones; before they exist, candidates are as they are."""
    return candidates if scores is None else rerank(candidates, scores, k)


#: (views, batch, space, k, seen, params) -> top k as (request_id, item_id, score, rank). ``params`` are a
#: hybrid's settings: what `fit_hybrid` got as ``fusion_params`` is in ``params["parameters"]``.
FUSIONS: dict[str, Callable[..., DataFrame]] = {
    "rrf": _fuse_rrf, "weighted": _fuse_weighted, "learned": _fuse_learned,
}
#: (candidates, batch, k, scores) -> (request_id, item_id, score, rank).
RERANKERS: dict[str, Callable[..., DataFrame]] = {
    "none": lambda candidates, batch, k, scores: candidates, "external": _rerank_external,
}


def recommend(
    model: FittedModel,
    batch: QueryBatch,
    space: ItemSpace,
    k: int = 10,
    exclude_seen: bool | DataFrame = True,
    scores: DataFrame | None = None,
) -> DataFrame:
    """(request_id, item_id, score, rank) for every request of the batch.

    ``exclude_seen`` can be a table (request_id) of the requests that hide what they have seen.

    A hybrid's fusion and reranker are looked up by the names it was fitted with; ``scores``
    (request_id, item_id, score) goes to the reranker.
    """
    if batch.mode not in model.modes:
        raise ValueError(f"{model.plugin} does not support {batch.mode} queries")
    if isinstance(exclude_seen, DataFrame):
        seen = seen_pairs(batch).join(exclude_seen.select("request_id"), "request_id", "left_semi")
    else:
        seen = seen_pairs(batch) if exclude_seen else None
    if model.runtime != "hybrid":
        return view_topk(score_view(model, batch), batch, space, k, seen)
    fuse = find(FUSIONS, "fusion strategy", model.params.get("fusion", "rrf"))
    order = find(RERANKERS, "reranker", model.params.get("reranker", "none"))
    views = [score_view(c, batch) for c in model.components]
    return order(fuse(views, batch, space, k, seen, model.params), batch, k, scores)


def recommend_users(
    model: FittedModel,
    prepared: Prepared,
    users: DataFrame | None = None,
    k: int = 10,
    exclude_seen: bool = True,
) -> DataFrame:
    space = ItemSpace(prepared.indexed_items, prepared.n_items)
    found = recommend(model, user_batch(prepared, users), space, k, exclude_seen)
    return found.withColumnRenamed("request_id", "user_id")


def recommend_sessions(
    model: FittedModel,
    space: ItemSpace,
    interactions: DataFrame,
    requests: DataFrame | None = None,
    k: int = 10,
) -> DataFrame:
    """Sessions with their own ``top_k`` and ``exclude_seen`` when ``requests`` carries them.

    ``k`` is the depth of requests without a top_k, and seen items are hidden where exclude_seen is
    null. The deepest request is looked up first and stays a literal, so that ranking prunes early.
    """
    batch = session_batch(interactions)
    if requests is None:
        return recommend(model, batch, space, k)
    requests = requests.withColumns({
        "top_k": F.coalesce("top_k", F.lit(k)), "exclude_seen": F.coalesce("exclude_seen", F.lit(True)),
    })
    k = requests.agg(F.max("top_k")).first()[0] or k
    hide = requests.where("exclude_seen").select("request_id")
    found = recommend(model, restrict(batch, requests), space, k, hide)
    return within_depth(found, requests)


def within_depth(found: DataFrame, requests: DataFrame) -> DataFrame:
    """Rows within each request's own ``top_k``."""
    deep = requests.select("request_id", "top_k")
    return found.join(deep, "request_id").where(F.col("rank") <= F.col("top_k")).drop("top_k")


def known_user_batch(requests: DataFrame, train: DataFrame) -> QueryBatch:
    """Requests (request_id, user_id) by known users; several may name one user.

    ``train`` is (user_id, item_id, value); the order of a user's items is id order.
    """
    user_of = requests.select("request_id", "user_id")
    vector = train.join(user_of, "user_id").select("request_id", "item_id", "value")
    last = vector.where(F.col("value") != 0).groupBy("request_id").agg(F.max("item_id").alias("item_id"))
    return QueryBatch(
        KNOWN_USER, user_of.select("request_id"), vector, last, hot=hot_groups(vector, ["request_id"]), user_of=user_of
    )


def restrict(batch: QueryBatch, requests: DataFrame) -> QueryBatch:
    ids = requests.select("request_id")

    def only(df: DataFrame | None) -> DataFrame | None:
        return None if df is None else df.join(ids, "request_id", "left_semi")

    return QueryBatch(
        batch.mode, only(batch.requests), only(batch.vector), only(batch.last),
        only(batch.recent), batch.hot, only(batch.user_of),
    )


def attach_metadata(recommended: DataFrame, catalog: DataFrame) -> DataFrame:
    """Join each item's catalog record; items without one get nulls."""
    columns = [c for c in catalog.columns if c != "item_id"]
    if not columns:
        return recommended
    record = catalog.select("item_id", F.struct(*columns).alias("metadata"))
    return recommended.join(record, "item_id", "left")


# --------------------------------------------------------------------------- reranking

PROMPT_TEMPLATE = (
    "A customer chose, oldest first:\n{history}\n\nItem under review:\n{candidate}\n\n"
    'How well does it suit the customer? Answer with {"score": x}, x from 0 (not at all) to 1.'
)


def prompts(
    candidates: DataFrame,
    history: DataFrame,
    catalog: DataFrame,
    template: str = PROMPT_TEMPLATE,
) -> DataFrame:
    """(request_id, item_id, prompt) for an external scorer.

    ``history`` is (request_id, pos, item_id, value) and goes in whole: sessions are bounded by
    the request contract (`request_status`), known users by what they did.
    """
    columns = [c for c in catalog.columns if c != "item_id"]
    record = catalog.select("item_id", F.struct(*columns).alias("metadata"))
    line = F.struct("pos", F.to_json(F.struct("item_id", "value", "metadata")).alias("j"))
    lines = (
        history.join(record, "item_id", "left")
        .groupBy("request_id")
        .agg(F.array_sort(F.collect_list(line)).alias("lines"))
        .select("request_id", F.concat(
            F.lit("["), F.array_join(F.transform("lines", lambda x: x["j"]), ", "), F.lit("]")
        ).alias("history"))
    )
    shown = candidates.join(record, "item_id", "left").join(lines, "request_id", "left")
    filled: Column = F.lit(template)
    for mark, value in (
        ("{history}", F.coalesce("history", F.lit("[]"))),
        ("{candidate}", F.coalesce(F.to_json("metadata"), F.lit("{}"))),
    ):
        filled = F.replace(filled, F.lit(mark), value)
    return shown.select("request_id", "item_id", filled.alias("prompt"))


def rerank(candidates: DataFrame, scores: DataFrame, k: int) -> DataFrame:
    """Replace scores by external ones (request_id, item_id, score), best first, at most k.

    A candidate without an external score is dropped, as a failed reply has no place to rank.
    """
    replaced = candidates.select("request_id", "item_id").join(scores, ["request_id", "item_id"])
    return top_k(replaced, k)
