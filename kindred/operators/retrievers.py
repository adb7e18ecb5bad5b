"""Fitting candidate retrievers on a prepared dataset."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions.numbers import quantize
from kindred.operators import pairs, sequences, textsim
from kindred.operators.contract import catalog_documents
from kindred.operators.graph import graph_vectors
from kindred.operators.scoring import popularity_base
from kindred.operators.split import Prepared
from kindred.operators.vectors import embedding_neighbours
from kindred.plans.fitted import HISTORY, KNOWN_USER, FittedModel, ItemSpace
from kindred.session import pin

BOTH = (HISTORY, KNOWN_USER)


def item_space(prepared: Prepared) -> ItemSpace:
    return ItemSpace(prepared.indexed_items, prepared.n_items)


def item_documents(prepared: Prepared) -> DataFrame:
    return catalog_documents(prepared.catalog)


def fit_popularity(prepared: Prepared, params: dict[str, Any]) -> FittedModel:
    base = pin(popularity_base(prepared.ratings("train"), item_space(prepared)))
    return FittedModel("popularity", "popularity", BOTH, {"scores": base})


def _sparse(plugin: str, edges: DataFrame, **params: Any) -> FittedModel:
    similarity = pin(edges.select("item", "other", "weight"))
    return FittedModel(plugin, "sparse", (HISTORY,), {"similarity": similarity}, params)


def fit_itemknn(prepared: Prepared, params: dict[str, Any]) -> FittedModel:
    n = int(params.get("neighbours", 100))
    return _sparse("itemknn", pairs.cosine_neighbours(prepared.ratings("train"), n), neighbours=n)


def fit_tfidf(prepared: Prepared, params: dict[str, Any]) -> FittedModel:
    """Kept factored: the full similarity matrix is T T' minus its diagonal."""
    item_docs, texts = textsim.distinct_documents(item_documents(prepared))
    item_docs = pin(textsim.with_places(item_docs))
    weights = pin(textsim.tfidf(texts, prepared.n_items))
    tables = {"item_docs": item_docs, "weights": weights}
    return FittedModel(
        "tfidf", "sparse", (HISTORY,), tables, {"form": "factored", "representation": "tfidf"}
    )


def fit_semantic(prepared: Prepared, params: dict[str, Any]) -> FittedModel:
    dim, n = int(params.get("embedding_dim", 128)), int(params.get("neighbours", 100))
    item_docs, texts = textsim.distinct_documents(item_documents(prepared))
    item_docs = pin(item_docs)
    vectors = pin(textsim.feature_vectors(textsim.hashed_features(texts, dim), dim))
    edges = textsim.document_neighbours(item_docs, vectors, n)
    return _sparse("semantic", edges, representation="feature_hash_embeddings", dim=dim)


def fit_markov(prepared: Prepared, params: dict[str, Any]) -> FittedModel:
    train = prepared.part("train")
    ordered = sequences.ordered_events(train, prepared.order, prepared.hot_users)
    edges = sequences.transition_probabilities(sequences.transitions(ordered))
    edges = edges.select(
        F.col("item_id").alias("item"), "other", quantize(F.col("weight")).alias("weight")
    )
    return FittedModel(
        "markov",
        "sequential",
        BOTH,
        {
            "similarity": pin(edges),
            "last_items": pin(sequences.last_items(train, prepared.order)),
            "scores": pin(popularity_base(prepared.ratings("train"), item_space(prepared))),
        },
    )


def fit_graph_cooccurrence(prepared: Prepared, params: dict[str, Any]) -> FittedModel:
    least = int(params.get("min_count", 1))
    return _sparse(
        "graph_cooccurrence", pairs.cooccurrence(prepared.ratings("train"), least), min_count=least
    )


def fit_graph_embeddings(prepared: Prepared, params: dict[str, Any]) -> FittedModel:
    dim, n = int(params.get("embedding_dim", 32)), int(params.get("neighbours", 100))
    edges = pairs.cooccurrence(prepared.ratings("train"))
    vectors = pin(graph_vectors(
        edges, prepared.n_items, dim, iterations=int(params.get("iterations", 30)),
        seed=int(params.get("seed", 42)),
    ))
    return _sparse(
        "graph_embeddings", embedding_neighbours(vectors, n), representation="graph_svd", dim=dim
    )
