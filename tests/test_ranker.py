"""Trees from histograms against trees grown by brute force; settings of a fusion reach serving."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.functions.names import register
from kindred.operators import ranker, recommend as rec
from kindred.operators.retrievers import item_space
from kindred.operators.scoring import RUNTIMES, ScoreView
from kindred.plans.fitted import FittedModel
from kindred.plans.hybrid import fit_hybrid, training_batch

KIND = "request_id long, item_id long, a double, b double, label int"


def rows_of(requests, items, seed=5):
    rng = np.random.default_rng(seed)
    out = []
    for r in range(requests):
        for i in range(items):
            a, b = float(rng.integers(0, 9)), round(float(rng.normal()), 2)
            out.append((r, i, a, b, int(rng.random() < 0.15 + 0.08 * a)))
    return out


def brute_tree(x, g, h, depth, min_rows, min_hessian, cuts):
    """Every threshold between two values of a feature, node by node; the first of equal ones."""
    leaf = {"value": g.sum() / h.sum() if h.sum() > 0 else 0.0}
    if depth == 0:
        return leaf, 0.0
    worth = lambda m: g[m].sum() ** 2 / h[m].sum() if h[m].sum() > 0 else 0.0
    best = None
    for f in range(x.shape[1]):
        for t in cuts[f]:
            m = x[:, f] <= t
            if min(m.sum(), (~m).sum()) < min_rows or min(h[m].sum(), h[~m].sum()) < min_hessian:
                continue
            gain = worth(m) + worth(~m) - worth(m | ~m)
            if gain > 1e-12 and (best is None or gain > best[0] + 1e-9):
                best = (gain, f, t, m)
    if best is None:
        return leaf, 0.0
    _, f, t, m = best
    left, right = (brute_tree(x[k], g[k], h[k], depth - 1, min_rows, min_hessian, cuts)[0] for k in (m, ~m))
    return {"feature": f, "threshold": float(t), "left": left, "right": right}, best[0]


def same(a, b):
    if "value" in a or "value" in b:
        return "value" in a and "value" in b and a["value"] == pytest.approx(b["value"], rel=1e-5, abs=1e-6)
    return a["feature"] == b["feature"] and a["threshold"] == pytest.approx(b["threshold"]) and same(a["left"], b["left"]) and same(a["right"], b["right"])


def test_trees_equal_brute_force(spark):
    """Three rounds: the gradients are taken at the scores that the trees before have made."""
    rows = rows_of(14, 20)
    got = ranker.fit_lambdamart(spark.createDataFrame(rows, KIND).repartition(3), ["a", "b"], rounds=3, depth=3, min_rows=9, truncation=7)
    table = np.array(rows)
    x, label, request = table[:, 2:4], table[:, 4].astype(int), table[:, 0]
    score = np.zeros(len(rows))
    cuts = [(v[:-1] + v[1:]) / 2 for v in (np.unique(x[:, 0]), np.unique(x[:, 1]))]
    for tree in got["trees"]:
        g, h = np.zeros(len(rows)), np.zeros(len(rows))
        for r in np.unique(request):
            g[request == r], h[request == r] = ranker.lambdas(score[request == r], label[request == r], 7)
        want, _ = brute_tree(x, g, h, 3, 9, 1e-3, cuts)
        assert same(tree, want)
        score += got["rate"] * np.array([ranker.flat(tree).value[i] for i in ranker.flat(tree).leaves(x)])
    again = ranker.fit_lambdamart(spark.createDataFrame(rows[::-1], KIND).repartition(5), ["a", "b"], rounds=3, depth=3, min_rows=9, truncation=7)
    assert again == got


def test_settings_of_trees(spark):
    df = spark.createDataFrame(rows_of(12, 25, 6), KIND)
    count = lambda t: 1 if "value" in t else count(t["left"]) + count(t["right"])
    for leaves in (2, 3, 6):
        tree = ranker.fit_lambdamart(df, ["a", "b"], rounds=1, depth=5, min_rows=3, leaves=leaves)["trees"][0]
        assert count(tree) == leaves
    one, all_ = (ranker.fit_lambdamart(df, ["a", "b"], rounds=1, min_rows=3, truncation=t) for t in (1, 30))
    assert one != all_
    few = ranker.fit_lambdamart(df, ["b"], rounds=1, min_rows=3, bins=4)
    assert count(few["trees"][0]) <= 5
    for bad in ({"bins": 0}, {"bins": 300}, {"leaves": 1}, {"truncation": 0}):
        with pytest.raises(ValueError):
            ranker.fit_lambdamart(df, ["a"], **bad)


def test_bins_hold_equal_shares(spark):
    df = spark.range(4000).select(F.lit(1).alias("request_id"), (F.col("id") ** 2).cast("double").alias("a"), F.lit(2.0).alias("b"))
    wide, flat = ranker.bin_edges(df, ["a", "b"], 15)
    assert len(flat) == 0 and 13 <= len(wide) <= 15
    counts = np.histogram(np.arange(4000.0) ** 2, [-1, *wide, np.inf])[0]
    assert counts.min() > 200 and counts.max() < 320


def test_scores_in_batches_equal_the_expression(spark):
    rows = rows_of(10, 20, 7)
    df = spark.createDataFrame([*rows, (99, 1, None, 0.5, 0)], KIND)
    trees = ranker.fit_lambdamart(df.where("a is not null"), ["a", "b"], rounds=4, min_rows=4)
    both = df.select(ranker.ensemble_scores(trees).alias("x"), ranker.ensemble_column(trees).alias("y")).collect()
    assert all(r.x == r.y for r in both) and len({r.x for r in both}) > 5


def test_rounds_are_linear_in_jobs(spark):
    """A round costs one pass for the gradients and one aggregate a level, whatever came before it."""
    df = spark.createDataFrame(rows_of(6, 12, 9), KIND)
    tracker = spark.sparkContext.statusTracker()

    def jobs(rounds):
        spark.sparkContext.setJobGroup(f"rounds{rounds}", "")
        ranker.fit_lambdamart(df, ["a", "b"], rounds=rounds, depth=2, min_rows=2)
        n = len(tracker.getJobIdsForGroup(f"rounds{rounds}"))
        spark.sparkContext._jsc.clearJobGroup()
        return n

    two, four, eight = jobs(2), jobs(4), jobs(8)
    assert eight - four == pytest.approx(2 * (four - two), abs=6)


# ---------------------------------------------------------------- settings, extensions


def test_rank_constant_reaches_serving(small_prepared):
    batch, space = training_batch(small_prepared, "history"), item_space(small_prepared)
    scores = {}
    for constant in (1, 60, 1000):
        model = fit_hybrid(small_prepared, ["popularity", "itemknn"], "rrf", fusion_params={"rank_constant": constant})
        best = rec.recommend(model, batch, space, 3).agg(F.max("score")).first()[0]
        scores[constant] = best
        assert best <= 2 / (constant + 1) + 1e-9
    assert scores[1] > scores[60] > scores[1000]
    bad = fit_hybrid(small_prepared, ["popularity"], "rrf", fusion_params={"rank_constant": 0})
    with pytest.raises(ValueError, match="positive"):
        rec.recommend(bad, batch, space, 3)


@pytest.fixture
def restored():
    kept = [dict(t) for t in (rec.FUSIONS, rec.RERANKERS, RUNTIMES)]
    yield
    for table, old in zip((rec.FUSIONS, rec.RERANKERS, RUNTIMES), kept):
        table.clear()
        table.update(old)


def test_registered_fusion_and_reranker_serve(small_prepared, restored):
    batch, space = training_batch(small_prepared, "history"), item_space(small_prepared)

    def first_view(views, batch, space, k, seen, params):
        assert params["parameters"] == {"note": 1}
        return rec.view_topk(views[0], batch, space, k, seen)

    def backwards(candidates, batch, k, scores):
        turned = candidates.select("request_id", "item_id", (-F.col("item_id")).cast("double").alias("score"))
        return rec.top_k(turned, k)

    register(rec.FUSIONS, "First-View", first_view)
    register(rec.RERANKERS, "Low-Ids", backwards)
    model = fit_hybrid(small_prepared, ["popularity", "itemknn"], "first-view", fusion_params={"note": 1}, reranker="low-ids")
    got = {(r.request_id, r.rank): r.item_id for r in rec.recommend(model, batch, space, 4).collect()}
    plain = rec.recommend(model.components[0], batch, space, 4).collect()
    for user in {r.request_id for r in plain}:
        assert [got[user, i] for i in range(1, 5)] == sorted(r.item_id for r in plain if r.request_id == user)


def test_external_reranker_takes_scores(spark, small_prepared):
    batch, space = training_batch(small_prepared, "history"), item_space(small_prepared)
    model = fit_hybrid(small_prepared, ["popularity", "itemknn"], reranker="external")
    before = rec.recommend(model, batch, space, 4)
    outside = before.select("request_id", "item_id", (F.col("rank") * 1.0).alias("score"))
    after = rec.recommend(model, batch, space, 4, scores=outside)
    turned = before.select("request_id", "item_id", (5 - F.col("rank")).alias("rank"))
    assert after.select("request_id", "item_id", "rank").exceptAll(turned).isEmpty() and after.count() == turned.count()


def test_registered_runtime_scores(small_prepared, restored):
    batch, space = training_batch(small_prepared, "history"), item_space(small_prepared)
    model = FittedModel("mine", "by_id", ("history",))
    with pytest.raises(ValueError, match="by_id"):
        rec.recommend(model, batch, space, 2)
    base = space.items.select("item_id", (-F.col("pos")).cast("double").alias("score"), "pos")
    register(RUNTIMES, "by-id", lambda model, batch: ScoreView(model.plugin, base=base))
    rows = rec.recommend(model, batch, space, 2, exclude_seen=False).collect()
    assert {r.item_id for r in rows} == {r.item_id for r in space.items.where("pos <= 2").collect()}


# ---------------------------------------------------------------- serving over boxes


def boxed_case(spark, n=400, requests=6, seed=2):
    """A shared base, a sparse view and a vector view over n items, and what requests have seen."""
    from kindred.plans.fitted import ItemSpace, QueryBatch

    rng = np.random.default_rng(seed)
    items = spark.createDataFrame([(10 * i, i) for i in range(1, n + 1)], "item_id long, pos long")
    order = rng.permutation(n)
    ties = sorted((-(n - i // 3), int(10 * (order[i] + 1))) for i in range(n))
    base = spark.createDataFrame([(item, float(-s), i + 1) for i, (s, item) in enumerate(ties)], "item_id long, score double, pos long")
    sparse, seen = [], []
    for r in range(requests):
        for i in rng.choice(n, rng.integers(0, 25), replace=False):
            sparse.append((r, int(10 * (i + 1)), float(np.round(rng.normal(0.5, 1), 3)) or 0.5))
        for i in rng.choice(n, rng.integers(0, 20), replace=False):
            seen.append((r, int(10 * (i + 1)), 1.0))
    nonzero = spark.createDataFrame(sparse, "request_id long, item_id long, score double")
    vector = spark.createDataFrame(seen, "request_id long, item_id long, value double")
    asked = spark.createDataFrame([(r,) for r in range(requests)], "request_id long")
    q = spark.createDataFrame([(r, rng.normal(size=3).tolist()) for r in range(requests)], "qid long, vec array<double>")
    e = spark.createDataFrame([(10 * i, rng.normal(size=3).tolist()) for i in range(1, n + 1)], "item long, vec array<double>")
    views = {"base": ScoreView("base", base=base), "near": ScoreView("near", nonzero=nonzero), "vec": ScoreView("vec", vectors=(q, e))}
    return views, QueryBatch("history", asked, vector), ItemSpace(items, n)


def random_trees(names, rng, n):
    def threshold(f):
        if names[f].endswith("rr"):
            return 1.0 / (60 + float(rng.integers(1, n)) + 0.5)
        return {"base_score": float(rng.integers(250, 400)), "near_score": float(rng.normal())}[names[f]]

    def grow(depth):
        if depth == 0:
            return {"value": float(np.round(rng.normal(), 3))}
        usable = [f for f in range(len(names)) if names[f] != "vec_score"]
        f = int(rng.choice(usable))
        return {"feature": f, "threshold": threshold(f), "left": grow(depth - 1), "right": grow(depth - 1)}

    return {"features": names, "rate": 0.5, "trees": [grow(2) for _ in range(3)]}


@pytest.mark.parametrize("names,hide", [(("base", "near"), True), (("near",), True), (("base", "near"), False), (("base", "near", "vec"), True)])
def test_pool_of_boxes_holds_the_top_k(spark, monkeypatch, names, hide):
    """Against scoring every unseen item, over ties, masks, deep cuts; the pool stays below the catalog."""
    monkeypatch.setattr(ranker, "BOX_SHARE", 0)
    all_views, batch, space = boxed_case(spark)
    views = [all_views[n] for n in names]
    seen = batch.vector.select("request_id", "item_id") if hide else None
    every = batch.requests.crossJoin(space.items.select("item_id"))
    if hide:
        every = every.join(seen, ["request_id", "item_id"], "left_anti")
    rows = ranker.features(views, batch, space, every, seen)
    trees = random_trees(ranker.feature_names(views), np.random.default_rng(len(names) + hide), space.n)
    want = rec.top_k(rows.select("request_id", "item_id", ranker.ensemble_scores(trees).alias("score")), 4)
    got = ranker.learned_topk(trees, views, batch, space, 4, seen)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    if "vec" not in names:
        pool = ranker.learned_pool(trees, views, batch, space, 4, seen, 60.0)
        assert pool.count() == pool.distinct().count() < 0.8 * every.count()


def test_gradients_take_requests_in_lists(spark):
    """No group of pandas rows for a request; ids of any type come back, ties go by item."""
    rows = spark.createDataFrame(
        [("a", "y", 0.0, 1), ("a", "x", 0.0, 0), ("a", "z", 2.0, 0), ("b", "x", 1.0, 0), (None, "x", 1.0, 1), (None, "w", 3.0, 0)],
        "request_id string, item_id string, score double, label int",
    )
    found = ranker.gradients(rows)
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().executedPlan().toString()
    got = {(r.request_id, r.item_id): (r.g, r.h) for r in found.collect()}
    want = {}
    for request, items in (("a", [("x", 0.0, 0), ("y", 0.0, 1), ("z", 2.0, 0)]), ("b", [("x", 1.0, 0)]), (None, [("w", 3.0, 0), ("x", 1.0, 1)])):
        g, h = ranker.lambdas(np.array([x[1] for x in items]), np.array([x[2] for x in items]))
        want |= {(request, x[0]): (g[i], h[i]) for i, x in enumerate(items)}
    assert set(got) == set(want)
    assert all(np.allclose(got[k], want[k]) for k in want)
