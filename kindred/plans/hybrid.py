"""Hybrid models: several fitted components and one fusion."""

from __future__ import annotations

from typing import Any

from pyspark.sql import functions as F

from kindred.functions.names import find, plugin_name
from kindred.operators.ranker import feature_names, fit_lambdamart, fusion_training_set
from kindred.operators.recommend import restrict, user_batch
from kindred.operators.retrievers import item_space
from kindred.operators.scoring import score_view
from kindred.operators.sequences import last_items, ordered_events
from kindred.operators.split import Prepared
from kindred.plans.fitted import HISTORY, KNOWN_USER, FittedModel, QueryBatch
from kindred.plans.registry import FUSIONS, RERANKERS, fit_component

POOL_KEYS = ("candidate_pool_size", "rank_constant")


def shared_modes(components: list[FittedModel]) -> tuple[str, ...]:
    modes = set(components[0].modes).intersection(*[c.modes for c in components[1:]])
    return tuple(sorted(modes))


def training_batch(prepared: Prepared, mode: str) -> QueryBatch:
    """Training rows as queries, with the time-ordered sequence as the history."""
    batch = user_batch(prepared)
    if mode == KNOWN_USER:
        return batch
    train = prepared.part("train")
    batch.mode = HISTORY
    batch.last = last_items(train, prepared.order).withColumnRenamed("user_id", "request_id")
    batch.recent = ordered_events(train, prepared.order, prepared.hot_users).select(
        F.col("user_id").alias("request_id"), "item_id", "pos"
    )
    return batch


def fit_hybrid(
    prepared: Prepared,
    components: list[str],
    fusion: str = "rrf",
    params: dict[str, dict[str, Any]] | None = None,
    weights: dict[str, float] | None = None,
    fusion_params: dict[str, Any] | None = None,
    reranker: str = "none",
    seed: int = 42,
) -> FittedModel:
    if not components:
        raise ValueError("a hybrid needs at least one component")
    if len(set(components)) != len(components):
        raise ValueError("hybrid components must be unique")
    find(FUSIONS, "fusion strategy", fusion)
    find(RERANKERS, "reranker", reranker)
    fitted = [fit_component(n, prepared, (params or {}).get(n, {})) for n in components]
    modes = shared_modes(fitted)
    if not modes:
        raise ValueError("the components share no query mode")
    options = dict(fusion_params or {})
    settings: dict[str, Any] = {
        "fusion": plugin_name(fusion), "weights": dict(weights or {}), "parameters": options,
        "reranker": plugin_name(reranker),
    }
    if settings["fusion"] == "learned":
        settings["trees"] = fit_learned_fusion(prepared, fitted, modes[0], options, seed)
    return FittedModel("hybrid", "hybrid", modes, {}, settings, tuple(fitted))


def fit_learned_fusion(
    prepared: Prepared, fitted: list[FittedModel], mode: str, options: dict[str, Any], seed: int
) -> dict[str, Any]:
    """Train on validation rows only, queried with the training rows."""
    truth = prepared.ratings("validation").select(
        F.col("user_id").alias("request_id"), "item_id"
    )
    batch = restrict(training_batch(prepared, mode), truth.select("request_id").distinct())
    views = [score_view(c, batch) for c in fitted]
    constant = float(options.get("rank_constant", 60))
    rows = fusion_training_set(
        views, batch, item_space(prepared), truth,
        int(options.get("candidate_pool_size", 100)), constant,
    )
    tree_options = {k: v for k, v in options.items() if k not in POOL_KEYS}
    ensemble = fit_lambdamart(rows, feature_names(views), seed=seed, **tree_options)
    return {**ensemble, "constant": constant}
