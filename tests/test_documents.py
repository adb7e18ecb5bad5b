"""Texts of items at size: features without a shuffle, neighbours and scores of many copies."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.functions.text import hash_column, hash_sign
from kindred.operators import scoring, textsim, vectors
from kindred.session import pin


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hashed_features_stay_where_the_text_is(spark):
    docs = [("a", "Red red apple-Tart ÄÖ"), ("b", ""), ("c", None), ("d", "x y z x"), ("e", "... !")]
    texts = pin(spark.createDataFrame([(k, d, 1) for k, d in docs], "doc_key string, doc string, items long"))
    found = textsim.hashed_features(texts, 4)
    assert "Exchange" not in plan(found)
    got = {(r.doc_key, r.col): r.weight for r in found.collect()}
    words = [(k, w) for k, d in docs for w in (d or "").lower().split() if w.strip(".!")]
    frame = spark.createDataFrame(words, "k string, w string").select("k", hash_column(F.col("w"), 4).alias("c"), hash_sign(F.col("w")).alias("s"))
    sums = {}
    for r in frame.collect():
        sums[r.k, r.c] = sums.get((r.k, r.c), 0.0) + r.s
    norm = {k: math.sqrt(sum(v * v for (x, _), v in sums.items() if x == k)) for k, _ in docs}
    assert got == {(k, c): v / norm[k] for (k, c), v in sums.items() if v}
    vec = {r.doc_key: r.vec for r in textsim.feature_vectors(found, 4).collect()}
    assert vec == {k: [got.get((k, c), 0.0) for c in range(4)] for k, _ in got}


def test_neighbours_of_copies_are_not_ranked_row_by_row(spark):
    """Items of a document share its list; only items that repeat are ranked again."""
    docs = [(i, f"word w{i % 4}") for i in range(40)] + [(3, "word w3"), (5, "word w2")]
    item_docs, texts = textsim.distinct_documents(spark.createDataFrame(docs, "item_id long, doc string"))
    vecs = textsim.feature_vectors(textsim.hashed_features(texts, 16), 16)
    edges = textsim.document_neighbours(item_docs, vecs, 3)
    logical = edges._jdf.queryExecution().optimizedPlan().toString()
    ranked = logical[logical.index("Window"):]
    assert "LeftSemi" in ranked and "LeftAnti" in logical  # only repeated items come to the window
    got = sorted((r.item, r.rank, r.other, round(r.weight, 6)) for r in edges.collect())
    key = {r.item_id: r.doc_key for r in item_docs.collect() if r.item_id not in (3, 5)}
    by_key = {r.doc_key: np.array(r.vec) for r in vecs.collect()}
    keys = [(r.item_id, r.doc_key) for r in item_docs.collect()]
    for item in key:
        scores = sorted((-round(float(by_key[key[item]] @ by_key[k]), 9), i) for i, k in keys if i != item)
        want = [(item, n + 1, i, round(-s, 6)) for n, (s, i) in enumerate(x for x in scores if x[0] < 0) if n < 3]
        assert [g for g in got if g[0] == item] == want
    assert len([g for g in got if g[0] == 3]) == 3 and len([g for g in got if g[0] == 5]) == 3


def test_tiles_of_documents_travel_seldom():
    """Half a million documents: a row went to 62 tiles before."""
    assert sum(vectors._grown(500_000, 500_000, vectors.TILE, textsim.DOC_WIDER, textsim.DOC_MANY)) == 16


@pytest.mark.parametrize("entries", [60, 1 << 22])
def test_best_documents_in_tiles(spark, entries):
    rng = np.random.default_rng(2)
    docs = [(i, " ".join(f"w{x}" for x in rng.integers(0, 40, rng.integers(1, 7)))) for i in range(120)]
    item_docs, texts = textsim.distinct_documents(spark.createDataFrame(docs, "item_id long, doc string"))
    weights = textsim.tfidf(texts, len(docs)).cache()
    rows = {(int(r), int(i)): float(rng.integers(-1, 4) or 1) for r, i in rng.integers(0, [9, 120], (40, 2))}
    history = spark.createDataFrame([(r, i, v) for (r, i), v in rows.items()], "request_id long, item_id long, value double")
    reach = history.groupBy("request_id").agg((F.count("*") + 3).alias("reach"))
    found = textsim.best_documents(history, item_docs, weights, reach, probe=1, entries=entries)
    got = {(r.request_id, r.doc_key): r.s for r in found.collect()}
    every = {(r.request_id, r.doc_key): r.s for r in textsim.near_documents(history, item_docs, weights).collect()}
    assert all(abs(every[x] - s) < 1e-9 for x, s in got.items())
    for r, n in ((r.request_id, r.reach) for r in reach.collect()):
        mine = sorted((s for (x, _), s in every.items() if x == r), reverse=True)
        floor = mine[min(n, len(mine)) - 1]
        assert all(x in got for x, s in every.items() if x[0] == r and s > max(floor, 0) + 1e-9)
    key = {r.item_id: r.doc_key for r in item_docs.collect()}
    assert all((r, key[i]) in got for r, i in rows if (r, key[i]) in every)


def test_candidates_of_copies_are_few(spark):
    """The items of the best document fill a request; the worse ones were listed before as well."""
    docs = [(i, f"a{i % 5} b{i % 3}") for i in range(600)]
    item_docs, texts = textsim.distinct_documents(spark.createDataFrame(docs, "item_id long, doc string"))
    item_docs = textsim.with_places(item_docs).cache()
    weights = textsim.tfidf(texts, len(docs)).cache()
    rows = [(r, i) for r in range(6) for i in range(r, 150, 15)]
    history = spark.createDataFrame([(r, i, 1.0) for r, i in rows], "request_id long, item_id long, value double").cache()
    near = textsim.near_documents(history, item_docs, weights).cache()
    found = textsim.factored_candidates(near, history, item_docs, 4).cache()
    assert found.count() <= 6 * (10 + 4 + 10)
    every = textsim.factored_scores(near, history, item_docs).where("score > 0")
    want, got = scoring.top_k(every, 4).collect(), scoring.top_k(found.where("score > 0"), 4).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 24
