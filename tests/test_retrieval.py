import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import mixed
from kindred.operators import fusion, pairs, scoring, textsim
from kindred.operators.evaluate import ranking_metrics
from kindred.operators.graph import graph_vectors
from kindred.operators.recommend import (
    recommend, recommend_users, request_status, rerank, session_batch, user_batch, with_exhaustion,
)
from kindred.operators.retrievers import item_space
from kindred.operators.scoring import ScoreView
from kindred.operators.vectors import embedding_neighbours, inner_product_topk
from kindred.plans.fitted import HISTORY, KNOWN_USER, FittedModel, ItemSpace, QueryBatch
from kindred.functions.names import find, register
from kindred.plans.registry import MODELS, RETRIEVERS, fit_component, list_plugins


def test_topk_ties_mask_and_nan(spark):
    s = spark.createDataFrame([(1, i, x) for i, x in enumerate([1.0, 2.0, 2.0, float("nan")])],
                              "request_id long, item_id long, score double")
    seen = spark.createDataFrame([(1, 1)], "request_id long, item_id long")
    rows = scoring.top_k(s, 3, seen).orderBy("rank").collect()
    assert [(r.item_id, r.score) for r in rows] == [(2, 2.0), (0, 1.0)]


def test_metrics_literals(spark):
    recs = spark.createDataFrame([(0, 1, 1), (0, 2, 2), (1, 4, 1), (1, 3, 2)],
                                 "user_id long, item_id long, rank long")
    truth = spark.createDataFrame([(0, 2), (1, 4), (1, 5)], "user_id long, item_id long")
    row = ranking_metrics(recs, truth, 2).first()
    assert row.recall == 0.75 and row.evaluated_users == 2 and 0 < row.ndcg <= 1
    empty = ranking_metrics(recs, truth.limit(0), 2).first()
    assert (empty.recall, empty.ndcg, empty.evaluated_users) == (0.0, 0.0, 0)


def test_hashed_documents_are_deterministic(spark):
    docs = spark.createDataFrame([(1, "red apple"), (2, "green apple"), (3, "blue sky")],
                                 "item_id long, doc string")
    _, texts = textsim.distinct_documents(docs)
    one = textsim.hashed_features(texts, 16)
    assert one.exceptAll(textsim.hashed_features(texts.repartition(3), 16)).isEmpty()
    with pytest.raises(ValueError):
        textsim.hashed_features(texts, 1)


def test_document_neighbours_with_many_copies(spark):
    """A third of all items share one document; results equal brute force."""
    texts = ["same words here"] * 12 + [f"same word number {i} x{i % 4}" for i in range(24)]
    docs = spark.createDataFrame(list(enumerate(texts)), "item_id long, doc string")
    item_docs, distinct = textsim.distinct_documents(docs)
    vectors = textsim.feature_vectors(textsim.hashed_features(distinct, 32), 32).cache()
    got = {(r.item, r.other): (r.weight, r.rank)
           for r in textsim.document_neighbours(item_docs, vectors, 5).collect()}
    keyed = {r.item_id: r.doc_key for r in item_docs.collect()}
    by_key = {r.doc_key: np.array(r.vec) for r in vectors.collect()}
    want = {}
    for i in range(36):
        scores = [(-round(float(by_key[keyed[i]] @ by_key[keyed[j]]), 9), j)
                  for j in range(36) if j != i]
        best = sorted(s for s in scores if s[0] < 0)[:5]
        want |= {(i, j): (-s, n + 1) for n, (s, j) in enumerate(best)}
    assert {k: (round(w, 6), r) for k, (w, r) in got.items()} == {
        k: (round(w, 6), r) for k, (w, r) in want.items()}


@pytest.mark.parametrize("tile", [7, 4096])
def test_inner_products_in_tiles(spark, tile):
    rng = np.random.default_rng(0)
    q, e = rng.integers(-3, 4, (20, 3)), rng.integers(-3, 4, (30, 3))
    queries = spark.createDataFrame([(n, [float(x) for x in v]) for n, v in enumerate(q)],
                                    "qid long, vec array<double>")
    items = spark.createDataFrame([(n, [float(x) for x in v]) for n, v in enumerate(e)],
                                  "item long, vec array<double>")
    masked = spark.createDataFrame([(n, (n * 7) % 30) for n in range(20)], "qid long, item long")
    got = {(r.qid, r.rank): (r.item, r.score)
           for r in inner_product_topk(queries, items, 4, masked, tile=tile).collect()}
    for n in range(20):
        s = (e @ q[n]).astype(float)
        s[(n * 7) % 30] = -np.inf
        order = np.lexsort((np.arange(30), -s))[:4]
        assert [got[n, r + 1] for r in range(4)] == [(int(i), s[i]) for i in order]


def test_graph_vectors_match_numpy(spark):
    rng = np.random.default_rng(1)
    a = rng.random((40, 6))
    g = a @ a.T
    np.fill_diagonal(g, 0)
    edges = spark.createDataFrame([(i, j, float(g[i, j])) for i in range(40) for j in range(40)
                                   if i != j], "item long, other long, weight double")
    u, s, vt = np.linalg.svd(g)
    want = (vt[:4].T * s[:4]) @ vt[:4]
    rows = graph_vectors(edges, 40, 4, width=12, iterations=60, tolerance=1e-10).collect()
    e = np.stack([r.vec for r in sorted(rows, key=lambda r: r.item)])
    assert np.abs(e @ e.T - want).max() < 1e-3 * np.abs(want).max()


def test_graph_vectors_raise_when_not_settled(spark):
    """A path: its singular values lie close together, so that few rounds are not enough."""
    n = 60
    edges = spark.createDataFrame([(i, j, 1.0) for i in range(n) for j in (i - 1, i + 1) if 0 <= j < n],
                                  "item long, other long, weight double")
    with pytest.raises(RuntimeError, match="not settled after 3 rounds"):
        graph_vectors(edges, n, 2, iterations=3, width=4)


# ------------------------------------------------------------------ dense reference for fusion


@pytest.fixture(scope="module")
def views(spark):
    rng = np.random.default_rng(5)
    n, users = 60, 8
    sparse = np.where(rng.random((users, n)) < 0.2, rng.integers(-3, 6, (users, n)), 0) / 4.0
    pop = rng.integers(0, 9, n).astype(float)
    qv, ev = rng.integers(-2, 3, (users, 2)), rng.integers(-2, 3, (n, 2))
    seen = rng.random((users, n)) < 0.25
    items = spark.createDataFrame([(i, i + 1) for i in range(n)], "item_id long, pos long").cache()
    order = np.lexsort((np.arange(n), -pop))
    base = spark.createDataFrame([(int(i), float(pop[i]), r + 1) for r, i in enumerate(order)],
                                 "item_id long, score double, pos long").cache()
    nonzero = spark.createDataFrame(
        [(u, i, float(sparse[u, i])) for u in range(users) for i in range(n) if sparse[u, i]],
        "request_id long, item_id long, score double").cache()
    queries = spark.createDataFrame([(u, [float(x) for x in qv[u]]) for u in range(users)],
                                    "qid long, vec array<double>")
    evs = spark.createDataFrame([(i, [float(x) for x in ev[i]]) for i in range(n)],
                                "item long, vec array<double>")
    vector = spark.createDataFrame(
        [(u, i, 1.0) for u in range(users) for i in range(n) if seen[u, i]],
        "request_id long, item_id long, value double").cache()
    requests = spark.range(users).withColumnRenamed("id", "request_id")
    batch = QueryBatch(HISTORY, requests, vector)
    fallback = [0, 3]
    mixed_view = ScoreView("m", nonzero.where(~F.col("request_id").isin(fallback)), base,
                           requests.where(F.col("request_id").isin(fallback)))
    mixed_scores = sparse.copy()
    mixed_scores[fallback] = pop
    dense = {"p": np.tile(pop, (users, 1)), "s": sparse, "v": (qv @ ev.T).astype(float),
             "m": mixed_scores}
    built = {"p": ScoreView("p", base=base), "s": ScoreView("s", nonzero=nonzero),
             "v": ScoreView("v", vectors=(queries, evs)), "m": mixed_view}
    return built, dense, batch, ItemSpace(items, n), seen


def dense_ranks(scores):
    rank = np.empty(scores.shape, dtype=int)
    for u, row in enumerate(scores):
        rank[u, np.lexsort((np.arange(len(row)), -row))] = np.arange(1, len(row) + 1)
    return rank


def expect(scores, seen, k):
    s = np.where(seen, -np.inf, scores)
    out = {}
    for u, row in enumerate(s):
        for r, i in enumerate(np.lexsort((np.arange(len(row)), -row))[:k]):
            if np.isfinite(row[i]):
                out[u, r + 1] = (int(i), round(float(row[i]), 6))
    return out


def found(df):
    return {(r.request_id, r["rank"]): (r.item_id, round(r.score, 6)) for r in df.collect()}


@pytest.mark.parametrize("name", ["p", "s", "v", "m"])
@pytest.mark.parametrize("mask", [True, False])
def test_view_topk(views, name, mask):
    built, dense, batch, space, seen = views
    hide = scoring.seen_pairs(batch) if mask else None
    got = scoring.view_topk(built[name], batch, space, 55, hide)
    assert found(got) == expect(dense[name], seen if mask else np.zeros_like(seen), 55)


@pytest.mark.parametrize("name", ["p", "s", "v", "m"])
@pytest.mark.parametrize("mask", [True, False])
def test_view_ranks(spark, views, name, mask):
    built, dense, batch, space, seen = views
    pool = spark.createDataFrame([(u, i) for u in range(8) for i in range(60) if not seen[u, i]],
                                 "request_id long, item_id long")
    hide = scoring.seen_pairs(batch) if mask else None
    scores = np.where(seen, -np.inf, dense[name]) if mask else dense[name]
    rank = dense_ranks(scores)
    rows = scoring.view_ranks(built[name], batch, space, pool, hide).collect()
    assert len(rows) == int((~seen).sum())
    for r in rows:
        assert r["rank"] == rank[r.request_id, r.item_id]
        assert r.score == pytest.approx(dense[name][r.request_id, r.item_id])


@pytest.mark.parametrize("names", ["ps", "psv", "mv", "s", "pm"])
def test_rrf_is_exact(views, names):
    built, dense, batch, space, seen = views
    total = sum(1.0 / (60 + dense_ranks(dense[n])) for n in names)
    total = np.rint(total * 1e12) / 1e12
    got = fusion.rrf_topk([built[n] for n in names], batch, space, 7, scoring.seen_pairs(batch))
    assert {k: v[0] for k, v in found(got).items()} == {
        k: v[0] for k, v in expect(total, seen, 7).items()}


@pytest.mark.parametrize("names,weights", [("ps", {}), ("s", {}), ("psv", {"v": 2.0}),
                                           ("mv", {}), ("ps", {"p": -1.0}), ("ms", {"m": 0.0})])
def test_weighted_is_exact(views, names, weights):
    built, dense, batch, space, seen = views
    total = 0
    for n in names:
        d = dense[n]
        std = d.std(axis=1, keepdims=True)
        total = total + weights.get(n, 1.0) * (d - d.mean(axis=1, keepdims=True)) / np.where(
            std > 0, std, 1.0)
    total = np.rint(total * 1e9) / 1e9
    got = fusion.weighted_topk([built[n] for n in names], batch, space, 7,
                               scoring.seen_pairs(batch), weights)
    want = expect(total, seen, 7)
    assert {k: v[0] for k, v in found(got).items()} == {k: v[0] for k, v in want.items()}


def test_fusion_errors(views):
    _, _, batch, space, _ = views
    with pytest.raises(ValueError):
        fusion.rrf_topk([], batch, space, 3, None)
    with pytest.raises(ValueError):
        fusion.rrf_topk([ScoreView("x")], batch, space, 3, None, constant=0)
    with pytest.raises(ValueError):
        fusion.weighted_topk([], batch, space, 3, None)


# ------------------------------------------------------------------ retrievers on mixed ids


@pytest.mark.parametrize("name", ["popularity", "itemknn", "tfidf", "semantic", "markov",
                                  "graph_cooccurrence", "graph_embeddings"])
def test_retrievers_with_mixed_ids(ring_prepared, name):
    model = fit_component(name, ring_prepared, {"embedding_dim": 4, "neighbours": 3})
    batch = user_batch(ring_prepared)
    batch.mode = HISTORY
    rows = recommend(model, batch, item_space(ring_prepared), 3).collect()
    per_user = {}
    for r in rows:
        per_user.setdefault(r.request_id, []).append(r)
    assert len(per_user) == 5 and all(len(v) == 3 for v in per_user.values())
    seen = {(r.request_id, r.item_id) for r in scoring.seen_pairs(batch).collect()}
    assert not seen & {(r.request_id, r.item_id) for r in rows}
    if "similarity" in model.tables:
        assert model.tables["similarity"].where(F.col("item") == F.col("other")).isEmpty() or (
            name == "markov")


def test_transition_rows_sum_to_one(ring_prepared):
    edges = fit_component("markov", ring_prepared).tables["similarity"]
    for r in edges.groupBy("item").agg(F.sum("weight").alias("s")).collect():
        assert r.s == pytest.approx(1.0)


def test_cooccurrence_counts_stored_zeros(spark):
    r = spark.createDataFrame([(1, 1, 0.0), (1, 2, 5.0), (2, 1, 1.0), (2, 2, 1.0)],
                              "user_id long, item_id long, value double")
    rows = {(x.item, x.other): x.weight for x in pairs.cooccurrence(r).collect()}
    assert rows == {(1, 2): 2.0, (2, 1): 2.0}


# ------------------------------------------------------------------ engine rules


def test_engine_rules(spark, ring_prepared):
    space = item_space(ring_prepared)
    model = fit_component("popularity", ring_prepared)
    everything = recommend_users(model, ring_prepared, k=1000, exclude_seen=False)
    assert everything.groupBy("user_id").count().where("count = 10").count() == 5
    sparse = fit_component("itemknn", ring_prepared)
    with pytest.raises(ValueError, match="known_user"):
        recommend_users(sparse, ring_prepared)
    items = [r.item_id for r in space.items.collect()]
    history = space.items.select(
        F.lit("all").alias("request_id"), "pos", "item_id", F.lit(1.0).alias("value"))
    batch = session_batch(history)
    found_rows = recommend(model, batch, space, 5)
    assert found_rows.isEmpty() and len(items) == 10
    requests = spark.createDataFrame([("all", None, 5)], "request_id string, user_id string, top_k int")
    users = spark.createDataFrame([("u",)], "user_id string")
    status = request_status(requests, history, users, ring_prepared.items)
    assert with_exhaustion(status, found_rows).first().status == "catalog_exhausted"


def test_request_status_rules(spark):
    requests = spark.createDataFrame(
        [("a", 1, 10), ("b", None, 10), ("c", 1, 10), ("d", None, 10), ("e", 9, 10),
         ("f", 1, 0), ("g", 1, 1001), ("h", None, 5)],
        "request_id string, user_id long, top_k int")
    history = spark.createDataFrame(
        [("b", 5, 1.0), ("c", 5, 1.0), ("h", 77, 1.0)], "request_id string, item_id long, value double")
    users = spark.createDataFrame([(1,)], "user_id long")
    items = spark.createDataFrame([(5,)], "item_id long")
    got = {r.request_id: r.status for r in request_status(requests, history, users, items).collect()}
    assert got == {"a": "ok", "b": "ok", "c": "invalid_request", "d": "invalid_request",
                   "e": "unknown_identifier", "f": "invalid_request", "g": "invalid_request",
                   "h": "unknown_identifier"}
    only_known = request_status(requests, history, users, items, (KNOWN_USER,))
    assert {r.request_id: r.status for r in only_known.collect()}["b"] == "unsupported_query_mode"


def test_session_repeats_add_up_and_last_item(spark):
    rows = spark.createDataFrame(
        [("r", 1, 5, 1.0, "2024-01-03"), ("r", 2, 6, 1.0, "2024-01-01"), ("r", 3, 5, 2.0, "2024-01-02"),
         ("q", 1, 5, 1.0, "2024-01-03"), ("q", 2, 6, 1.0, None)],
        "request_id string, pos long, item_id long, value double, t string",
    ).withColumn("timestamp", F.to_timestamp("t")).drop("t")
    batch = session_batch(rows)
    values = {(r.request_id, r.item_id): r.value for r in batch.vector.collect()}
    assert values == {("r", 5): 3.0, ("r", 6): 1.0, ("q", 5): 1.0, ("q", 6): 1.0}
    assert {r.request_id: r.item_id for r in batch.last.collect()} == {"r": 5, "q": 6}


def test_rerank(spark):
    c = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "request_id long, item_id long")
    s = spark.createDataFrame([(1, 1, 0.2), (1, 2, 0.9), (1, 3, 0.9)],
                              "request_id long, item_id long, score double")
    assert [r.item_id for r in rerank(c, s, 2).orderBy("rank").collect()] == [2, 3]


def test_plugins_by_name(spark):
    assert sorted(MODELS) == ["bpr", "lightgcn", "multivae", "sasrec", "two_tower"]
    assert len(RETRIEVERS) == 12 and find(RETRIEVERS, "retriever", "Graph-Embeddings") is RETRIEVERS["graph_embeddings"]
    own = {}
    register(own, "My-Name", 1)
    assert find(own, "thing", " my_name") == 1
    for name in ("my_name", " "):
        with pytest.raises(ValueError):
            register(own, name, 2)
    with pytest.raises(ValueError, match="my_name"):
        find(own, "thing", "other")
    assert list_plugins(spark).groupBy("kind").count().count() == 5
    assert list_plugins(spark).count() == 12 + 5 + 3 + 2 + 6


def test_similarity_is_symmetric_before_pruning(ring_prepared):
    full = pairs.mirror(pairs.gram(ring_prepared.ratings("train"), "user_id", "item_id", "value"))
    back = full.select(F.col("other").alias("item"), F.col("item").alias("other"), "weight")
    assert full.exceptAll(back).isEmpty()


def test_last_item_aggregation(spark, ring_prepared):
    model = fit_component("itemknn", ring_prepared)
    last = FittedModel("itemknn", "sparse", (HISTORY,), model.tables, {"aggregation": "last_item"})
    batch = user_batch(ring_prepared)
    batch.mode = HISTORY
    assert recommend(last, batch, item_space(ring_prepared), 2).count() == 10


def test_embedding_neighbours_mixed(spark):
    from pyspark.sql import types as T

    from kindred.functions.ids import MIXED_ID

    schema = T.StructType([T.StructField("item", MIXED_ID),
                           T.StructField("vec", T.ArrayType(T.DoubleType()))])
    df = spark.createDataFrame([(mixed(-5), [1.0, 0.0]), (mixed("é"), [1.0, 0.0]),
                                (mixed(7), [1.0, 1.0])], schema)
    rows = embedding_neighbours(df, 5).orderBy("item", "rank").collect()
    ids = [(r.item.i if r.item.kind == 0 else r.item.s, r.other.i if r.other.kind == 0 else r.other.s)
           for r in rows]
    assert ids == [(-5, 7), (-5, "é"), (7, -5), (7, "é"), ("é", -5), ("é", 7)]


@pytest.mark.parametrize("k", [2, 30])
@pytest.mark.parametrize("mask", [True, False])
def test_factored_text_scores_equal_the_full_similarity(spark, k, mask):
    """Many items share documents, some have no common token with anything."""
    texts = [["red apple", "green apple", "blue sky", "lone"][i % 4] for i in range(11)] + [
        "red sky", "other word"]
    docs = spark.createDataFrame(list(enumerate(texts)), "item_id long, doc string")
    item_docs, distinct = textsim.distinct_documents(docs)
    weights = textsim.tfidf(distinct, 13).cache()
    model = FittedModel("tfidf", "sparse", (HISTORY,), {
        "item_docs": textsim.with_places(item_docs), "weights": weights}, {"form": "factored"})
    key = {r.item_id: r.doc_key for r in item_docs.collect()}
    tokens = sorted({r.token for r in weights.collect()})
    dense = {}
    for r in weights.collect():
        dense.setdefault(r.doc_key, np.zeros(len(tokens)))[tokens.index(r.token)] = r.weight
    t = np.stack([dense[key[i]] for i in range(13)])
    sim = t @ t.T
    np.fill_diagonal(sim, 0)
    history = [("a", 0, 1.0), ("a", 4, 2.0), ("b", 3, 1.0), ("c", 11, -1.0), ("d", 12, 1.0)]
    rows = spark.createDataFrame([(r, n, i, v) for n, (r, i, v) in enumerate(history)],
                                 "request_id string, pos long, item_id long, value double")
    space = ItemSpace(docs.select("item_id", (F.col("item_id") + 1).alias("pos")), 13)
    got = {}
    for r in recommend(model, session_batch(rows), space, k, mask).collect():
        got[r.request_id, r["rank"]] = r.item_id
    want = {}
    for request in "abcd":
        v = np.zeros(13)
        for r, i, x in history:
            if r == request:
                v[i] += x
        s = np.rint(v @ sim * 1e9) / 1e9
        if mask:
            s[v != 0] = -np.inf
        for n, i in enumerate(np.lexsort((np.arange(13), -s))[:k]):
            if np.isfinite(s[i]):
                want[request, n + 1] = int(i)
    assert got == want


def test_best_documents_skip_frequent_tokens(spark):
    """Same best documents as scoring all of them, with a token in every document left out."""
    import random

    rng = random.Random(4)
    docs = [(i, " ".join(["the", "of", *(f"w{rng.randint(0, 150)}" for _ in range(rng.randint(2, 9)))])) for i in range(300)]
    docs += [(300, "the of"), (301, "the of the the")]
    frame = spark.createDataFrame(docs, "item_id long, doc string")
    item_docs, texts = textsim.distinct_documents(frame)
    weights = textsim.tfidf(texts, len(docs)).cache()
    rows = [(r, rng.randrange(302), float(rng.randint(1, 4))) for r in range(12) for _ in range(r % 4 + 1)]
    rows = list({(r, i): v for r, i, v in rows}.items())
    history = spark.createDataFrame([(r, i, v) for (r, i), v in rows], "request_id long, item_id long, value double")
    reach = history.groupBy("request_id").agg((F.count("*") + 3).alias("reach"))
    got = {(r.request_id, r.doc_key): r.s for r in textsim.best_documents(history, item_docs, weights, reach, probe=4).collect()}
    every = textsim.near_documents(history, item_docs, weights).collect()
    deep = {r.request_id: r.reach for r in reach.collect()}
    for request, n in deep.items():
        mine = sorted((r for r in every if r.request_id == request), key=lambda r: -r.s)
        floor = mine[min(n, len(mine)) - 1].s
        assert all(got.get((request, r.doc_key)) == r.s for r in mine if r.s >= floor)
    assert len(got) < 0.7 * len(every)
    with_all = {(r.request_id, r.doc_key): r.s for r in every}
    assert all(with_all[k] == v for k, v in got.items())
