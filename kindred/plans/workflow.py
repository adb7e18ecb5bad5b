"""Prepare, train and evaluate, with stages that are reused once they are complete."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions.names import plugin_name
from kindred.operators.contract import normalize
from kindred.operators.evaluate import ranking_metrics
from kindred.operators.recommend import recommend, restrict, session_batch, user_batch
from kindred.operators.retrievers import item_space
from kindred.operators.sequences import ordered_events
from kindred.operators.split import Prepared, Split, prepare
from kindred.plans.fitted import KNOWN_USER, FittedModel
from kindred.plans.hybrid import fit_hybrid
from kindred.plans.registry import fit_model
from kindred.sources.digests import value_digest
from kindred.sources.store import (
    StoredModel,
    load_model,
    load_prepared,
    save_model,
    save_prepared,
    write_json_lines,
)
from kindred.sources.tables import load_interactions, path_exists


def prepare_dataset(spark: SparkSession, config: dict[str, Any]) -> Prepared:
    frame, columns, order = load_interactions(spark, config)
    events = normalize(frame, columns)
    return prepare(
        events, order, Split(**config.get("split", {})), adapter=config.get("name", "synthetic")
    )


def train_model(prepared: Prepared, config: dict[str, Any]) -> FittedModel:
    """``config`` holds model {name, parameters}, training and, for hybrids, the fusion parts."""
    model, training = config.get("model", {}), config.get("training", {})
    name = plugin_name(model.get("name", "multivae"))
    if name == "hybrid":
        retrieval, fusion = config.get("retrieval", {}), config.get("fusion", {})
        params = {
            n: {**training, **retrieval.get("parameters", {}).get(n, {})}
            for n in retrieval.get("components", ["popularity", "itemknn"])
        }
        return fit_hybrid(
            prepared, list(params), fusion.get("name", "rrf"), params, fusion.get("weights"),
            fusion.get("parameters"), config.get("reranker", {}).get("name", "none"),
            int(training.get("seed", 42)),
        )
    return fit_model(name, prepared, {**training, **model.get("parameters", {})})


def evaluate(
    model: FittedModel, prepared: Prepared, k: int = 10, trained_on: str | None = None
) -> DataFrame:
    """(recall, ndcg, evaluated_users) over all users with test items, in one plan.

    Known-user queries when the model supports them, else the ordered training events as a
    history. ``trained_on`` guards against metrics on another dataset.
    """
    if trained_on is not None and trained_on != prepared.digest:
        raise ValueError("the model was trained on another dataset")
    truth = prepared.ratings("test").select("user_id", "item_id")
    users = truth.select("user_id").distinct()
    if KNOWN_USER in model.modes:
        batch = user_batch(prepared, users)
    else:
        ordered = ordered_events(prepared.part("train"), prepared.order, prepared.hot_users)
        batch = session_batch(
            ordered.withColumnRenamed("user_id", "request_id"), bounded=False
        )
        batch = restrict(batch, users.withColumnRenamed("user_id", "request_id"))
    found = recommend(model, batch, item_space(prepared), k)
    return ranking_metrics(found.withColumnRenamed("request_id", "user_id"), truth, k)


def run(spark: SparkSession, config: dict[str, Any], folder: str) -> dict[str, Any]:
    """Run all stages under ``folder``; completed ones are loaded instead of repeated.

    The folder keeps the digest of its configuration and refuses any other.
    """
    digest = value_digest(config)
    state = _read_state(spark, folder)
    if state and state["config_digest"] != digest:
        raise ValueError("this run folder belongs to another configuration")
    state = state or {"config_digest": digest}
    _write_state(spark, folder, state)
    if "dataset" in state:
        prepared = load_prepared(spark, state["dataset"])
    else:
        made = prepare_dataset(spark, config.get("dataset", {}))
        prepared = save_prepared(made, f"{folder}/data")
        token = prepared.digest.partition(":")[2]
        state["dataset"] = f"{folder}/data/{token}"
        _write_state(spark, folder, state)
    if "model" in state:
        stored: StoredModel = load_model(spark, state["model"])
    else:
        stored = save_model(train_model(prepared, config), prepared, f"{folder}/models", config)
        state["model"] = stored.path
        _write_state(spark, folder, state)
    k = int(config.get("evaluation", {}).get("top_k", 10))
    if "metrics" not in state:
        row = evaluate(stored.model, prepared, k, stored.manifest["dataset_digest"]).first()
        state["metrics"] = {
            f"recall@{k}": row["recall"], f"ndcg@{k}": row["ndcg"],
            "evaluated_users": row["evaluated_users"],
        }
        _write_state(spark, folder, state)
        record = spark.createDataFrame([(json.dumps(state["metrics"]),)], "metrics string").select(
            F.lit(stored.manifest["artifact_id"]).alias("artifact_id"), "metrics"
        )
        write_json_lines(record, f"{folder}/metrics")
    return {
        "dataset_digest": prepared.digest, "artifact_id": stored.manifest["artifact_id"],
        "artifact": stored.path, "metrics": state["metrics"],
    }


def _read_state(spark: SparkSession, folder: str) -> dict[str, Any] | None:
    """The last complete state; states are numbered and never rewritten."""
    number, found = 0, None
    while path_exists(spark, f"{folder}/state/{number}/_SUCCESS"):
        found = json.loads(spark.read.text(f"{folder}/state/{number}").first()["value"])
        number += 1
    return found


def _write_state(spark: SparkSession, folder: str, state: dict[str, Any]) -> None:
    number = 0
    while path_exists(spark, f"{folder}/state/{number}/_SUCCESS"):
        number += 1
    line = spark.createDataFrame([(json.dumps(state, sort_keys=True),)], "value string")
    line.coalesce(1).write.mode("overwrite").text(f"{folder}/state/{number}")
