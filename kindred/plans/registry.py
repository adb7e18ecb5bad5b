"""What can be asked for by name: retrievers, models, fusions, rerankers and runtimes.

Each kind is a dict of functions; `kindred.functions.names.register` adds to one of them, and fitting,
scoring and recommending look their plugins up there:

* retriever, model: (prepared, params) -> FittedModel
* fusion: (views, batch, space, k, seen, params) -> (request_id, item_id, score, rank)
* reranker: (candidates, batch, k, scores) -> (request_id, item_id, score, rank)
* runtime: (model, batch) -> ScoreView
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession

from kindred.functions.names import find
from kindred.operators import factor, neural, retrievers
from kindred.operators.recommend import FUSIONS, RERANKERS
from kindred.operators.scoring import RUNTIMES
from kindred.operators.split import Prepared
from kindred.plans.fitted import FittedModel

MODELS: dict[str, Any] = {
    "bpr": factor.fit_bpr, "lightgcn": factor.fit_lightgcn, "two_tower": factor.fit_two_tower,
    "multivae": neural.fit_multivae, "sasrec": neural.fit_sasrec,
}
#: Models can stand in as retrievers.
RETRIEVERS: dict[str, Any] = {
    "popularity": retrievers.fit_popularity, "itemknn": retrievers.fit_itemknn,
    "tfidf": retrievers.fit_tfidf, "semantic": retrievers.fit_semantic, "markov": retrievers.fit_markov,
    "graph_cooccurrence": retrievers.fit_graph_cooccurrence,
    "graph_embeddings": retrievers.fit_graph_embeddings, **MODELS,
}
PLUGINS = {"fusion": FUSIONS, "model": MODELS, "reranker": RERANKERS, "retriever": RETRIEVERS, "runtime": RUNTIMES}


def fit_component(name: str, prepared: Prepared, params: dict[str, Any] | None = None) -> FittedModel:
    """Fit a retriever, or a model used as one."""
    return find(RETRIEVERS, "retriever", name)(prepared, dict(params or {}))


def fit_model(name: str, prepared: Prepared, params: dict[str, Any] | None = None) -> FittedModel:
    return find(MODELS, "model", name)(prepared, dict(params or {}))


def list_plugins(spark: SparkSession) -> DataFrame:
    """(kind, name) of everything that can be asked for."""
    rows = [(kind, name) for kind, table in PLUGINS.items() for name in table]
    return spark.createDataFrame(rows, "kind string, name string").orderBy("kind", "name")
