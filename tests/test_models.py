import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.operators import attention, evaluate, neural, ranker
from kindred.operators.factor import (
    node_arcs, pair_gradient, propagate_nodes, tower_weights, two_tower_gradient, with_vectors,
)
from kindred.operators.recommend import recommend_sessions, recommend_users
from kindred.operators.retrievers import item_space
from kindred.operators.softmax import softmax_gradient, softmax_rows
from kindred.operators.training import (
    DenseAdam, NodeSpace, adam_step, all_nodes, normal_parameters, sample_pairs, summed_gradient,
    with_moments,
)
from kindred.operators.vectors import sum_vectors
from kindred.plans.hybrid import fit_hybrid
from kindred.plans.registry import fit_model
from kindred.session import pin

SMALL = {"embedding_dim": 4, "steps": 2, "epochs": 1, "batch_size": 16, "learning_rate": 0.05,
         "seed": 3, "layers": 1, "max_length": 4, "hidden_dim": 6, "latent_dim": 3}


def numeric(f, x, eps=1e-6):
    g = np.zeros_like(x)
    for at in np.ndindex(x.shape):
        keep = x[at]
        x[at] = keep + eps
        up = f()
        x[at] = keep - eps
        down = f()
        x[at] = keep
        g[at] = (up - down) / (2 * eps)
    return g


def test_sampler_never_returns_seen_items(ring_prepared):
    space = NodeSpace.of(ring_prepared)
    pairs = sample_pairs(space, 50, 3, 4)
    assert pairs.count() == 150 and pairs.select("step").distinct().count() == 3
    held = space.entries.select("user", "item")
    assert pairs.join(held, (pairs.positive == held.item) & (pairs.user == held.user),
                      "left_anti").isEmpty()
    assert pairs.join(held, (pairs.negative == held.item) & (pairs.user == held.user),
                      "left_semi").isEmpty()
    assert pairs.where(~F.col("negative").between(1, 10)).isEmpty()
    assert pairs.exceptAll(sample_pairs(space, 50, 3, 4)).isEmpty()


def test_sampler_reaches_every_unseen_item(spark):
    entries = spark.createDataFrame([(-1, i, 1.0) for i in (1, 2, 4, 7)],
                                    "user long, item long, value double")
    space = NodeSpace(None, None, entries, 1, 8)
    rows = sample_pairs(space, 300, 1, 1)
    assert {r.negative for r in rows.select("negative").distinct().collect()} == {3, 5, 6, 8}
    assert {r.positive for r in rows.select("positive").distinct().collect()} == {1, 2, 4, 7}
    full = NodeSpace(None, None, entries, 1, 4)
    with pytest.raises(ValueError):
        sample_pairs(full, 5, 1, 1)


def test_pair_gradient_by_differences(spark):
    rng = np.random.default_rng(0)
    vecs = {n: rng.normal(size=3) for n in (-1, -2, 1, 2, 3)}
    pairs = [(-1, 1, 2), (-1, 3, 2), (-2, 2, 1)]
    table = spark.createDataFrame([(n, v.tolist()) for n, v in vecs.items()],
                                  "node long, vec array<double>")
    batch = spark.createDataFrame(pairs, "user long, positive long, negative long")
    got = {r.node: np.array(r.g) for r in summed_gradient(
        pair_gradient(with_vectors(batch, table), 3), 3).collect()}

    def loss():
        return np.mean([np.log1p(np.exp(-(vecs[u] @ vecs[p] - vecs[u] @ vecs[n])))
                        for u, p, n in pairs])

    for n, v in vecs.items():
        assert np.allclose(got[n], numeric(loss, v), atol=1e-7)


def test_small_batches_leave_the_table_in_place(spark):
    """The vectors of a batch of few pairs are found without a shuffle or sort of all vectors."""
    table = spark.range(1, 40).select(
        F.when(F.col("id") < 20, -F.col("id")).otherwise(F.col("id") - 19).alias("node"),
        F.array(F.col("id") / 7, F.col("id") / 3).alias("vec"),
    )
    batch = spark.createDataFrame([(-1, 2, 3), (-1, 2, 3), (-7, 5, 5), (-99, 1, 2)], "user bigint, positive bigint, negative bigint")
    few, many = with_vectors(batch, table, 4), with_vectors(batch, table)
    columns = ["user", "positive", "negative", "u", "p", "n"]
    assert sorted(few.select(columns).collect()) == sorted(many.select(columns).collect())
    assert few.count() == 3
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = with_vectors(batch, table, 4)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_adam_matches_dense_rule(spark):
    table = with_moments(spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])],
                                               "node long, vec array<double>"), 2)
    dense = DenseAdam({"w": np.array([[1.0, 2.0], [3.0, 4.0]])}, 0.1)
    for step, g in enumerate([[0.5, -1.0], [0.25, 2.0]], start=1):
        grad = spark.createDataFrame([(1, g)], "node long, g array<double>")
        table = adam_step(table, grad, 2, step, 0.1)
        dense.update({"w": np.array([g, [0.0, 0.0]])})
    rows = np.array([r.vec for r in table.orderBy("node").collect()])
    assert np.allclose(rows, dense.weights["w"])


def test_propagation_is_its_own_adjoint(ring_prepared):
    """<A x, y> = <x, A y>: gradients may flow back through the same operator."""
    space = NodeSpace.of(ring_prepared)
    arcs = node_arcs(space).cache()
    x = normal_parameters(all_nodes(space), 2, 1, 1.0).select("node", "vec")
    y = normal_parameters(all_nodes(space), 2, 2, 1.0).select("node", "vec")

    def inner(a, b):
        j = a.join(b.withColumnRenamed("vec", "o"), "node")
        return j.agg(F.sum(F.col("vec")[0] * F.col("o")[0] + F.col("vec")[1] * F.col("o")[1])).first()[0]

    one = inner(propagate_nodes(arcs, x, 2, 2), y)
    assert one == pytest.approx(inner(x, propagate_nodes(arcs, y, 2, 2)))


def test_two_tower_gradient_by_differences():
    rng = np.random.default_rng(1)
    w = tower_weights(8, 4, 2)
    u, p, n = (rng.normal(size=(3, 8)) for _ in range(3))

    def loss():
        from kindred.operators.factor import tower_forward

        a, b, c = (tower_forward(x, w, s)[0] for x, s in ((u, "u"), (p, "i"), (n, "i")))
        return np.log1p(np.exp(-(a * (b - c)).sum(axis=1))).mean()

    gu, gp, gn, total = two_tower_gradient(u, p, n, w, 3)
    for x, g in ((u, gu), (p, gp), (n, gn)):
        assert np.allclose(g, numeric(loss, x), atol=1e-6)
    for k in w:
        assert np.allclose(total[k], numeric(loss, w[k]), atol=1e-6), k


def test_attention_gradient_by_differences():
    rng = np.random.default_rng(2)
    w = attention.block_weights(4, 3, 2, 1)
    for k in w:
        w[k] = w[k] + rng.normal(scale=0.3, size=w[k].shape)
    emb, pad = rng.normal(size=(2, 4, 3)), np.array([[True, True, False, False], [False] * 4])
    emb[pad] = 0.0
    target = rng.normal(size=(2, 3))
    masks = attention.dropout_masks([(1, 0), (1, 1)], 2, 4, 3, 0.3)

    def loss():
        return float((attention.forward(emb, pad, w, 2, masks)[0] * target).sum())

    _, cache = attention.forward(emb, pad, w, 2, masks)
    g, grads = attention.backward(target, cache, w, 2)
    want = numeric(loss, emb)
    assert np.allclose(g[~pad], want[~pad], atol=1e-6)
    for k in w:
        assert np.allclose(grads[k], numeric(loss, w[k]), atol=1e-6), k


def test_autoencoder_gradient_by_differences():
    rng = np.random.default_rng(3)
    w = neural.vae_weights(5, 3, 1)
    a, noise, aim = rng.normal(size=(4, 5)), rng.normal(size=(4, 3)), rng.normal(size=(4, 5))
    beta = 0.15

    def loss():
        _, mu, lv, _, out = neural.vae_forward(a, w, noise)
        kl = -0.5 * (1 + lv - mu**2 - np.exp(lv)).sum(axis=1).mean()
        return float((out * aim).sum()) + beta * kl

    g_a, grads = neural.vae_backward(aim, a, noise, w, beta, 4)
    assert np.allclose(g_a, numeric(loss, a), atol=1e-6)
    for k in w:
        assert np.allclose(grads[k], numeric(loss, w[k]), atol=1e-6), k


def test_softmax_gradient_in_tiles(spark, monkeypatch):
    import kindred.operators.softmax as module
    from kindred.operators.vectors import tiled

    def small(*a, **k):
        return tiled(*a, **{**k, "tile": 3})

    monkeypatch.setattr(module, "tiled", small)
    rng = np.random.default_rng(4)
    h, e, t = rng.normal(size=(7, 3)), rng.normal(size=(11, 3)), rng.random(7)
    q = spark.createDataFrame([(n, h[n].tolist(), float(t[n])) for n in range(7)],
                              "qid long, vec array<double>, t double")
    i = spark.createDataFrame([(n, e[n].tolist()) for n in range(11)], "item long, vec array<double>")
    gq, gi = softmax_gradient(q, i, 3)

    def loss():
        return float((t * np.log(np.exp(h @ e.T).sum(axis=1))).sum())

    got_q = np.array([r.g for r in gq.orderBy("qid").collect()])
    got_i = np.array([r.g for r in gi.orderBy("item").collect()])
    assert np.allclose(got_q, numeric(loss, h), atol=1e-6)
    assert np.allclose(got_i, numeric(loss, e), atol=1e-6)


def test_softmax_rows_of_one_tile(spark):
    """Where one tile holds all items there is one pass, with the same sums as two passes."""
    rng = np.random.default_rng(6)
    q = spark.createDataFrame([(n, rng.normal(size=3).tolist(), float(rng.random())) for n in range(7)],
                              "qid long, vec array<double>, t double")
    i = spark.createDataFrame([(n, rng.normal(size=3).tolist()) for n in range(5)], "item long, vec array<double>")
    one = sum_vectors(softmax_rows(q, i, (7, 5)).groupBy("side", "id"), "g", 3)
    for side, key, want in zip((0, 1), ("qid", "item"), softmax_gradient(q, i, 3)):
        got = np.array([r.g for r in one.where(F.col("side") == side).orderBy("id").collect()])
        assert np.allclose(got, [r.g for r in want.orderBy(key).collect()])


def test_last_layer_works_on_the_last_slot():
    w = attention.block_weights(4, 3, 2, 1)
    emb, pad = np.random.default_rng(5).normal(size=(2, 4, 3)), np.zeros((2, 4), dtype=bool)
    out, (caches, _, _) = attention.forward(emb, pad, w, 2)
    assert out.shape == (2, 3)
    assert [c[8].shape[1] for c in caches] == [4, 1]  # slots that the feed-forward part works on


@pytest.mark.parametrize("name", ["multivae", "sasrec"])
def test_a_step_writes_four_tables(small_prepared, monkeypatch, name):
    from kindred.operators import softmax, training

    written = []

    def counted(df, by=None):
        written.append(df)
        return pin(df, by)

    def tables(batch_size):
        written.clear()
        fit_model(name, small_prepared, {**SMALL, "epochs": 1, "batch_size": batch_size})
        return len(written)

    for module in (neural, softmax, training):
        monkeypatch.setattr(module, "pin", counted)
    rows = {"multivae": 6, "sasrec": prefix_rows(small_prepared)}[name]
    one, more = tables(rows), tables(rows // 3)
    assert more - one <= 4 * (neural.batches_of(rows, rows // 3) - 1)


def prefix_rows(prepared):
    train = prepared.part("train")
    return train.count() - train.select("user_id").distinct().count()


def test_sasrec_is_the_same_in_small_chunks(small_prepared, monkeypatch):
    def vectors():
        model = fit_model("sasrec", small_prepared, {**SMALL, "epochs": 1})
        return np.array([r.vec for r in model.tables["items"].orderBy("item").collect()])

    whole = vectors()
    monkeypatch.setattr(neural, "CHUNK", 5)
    monkeypatch.setattr(neural, "CELLS", 1)
    assert np.allclose(whole, vectors(), atol=1e-9)


@pytest.mark.parametrize("name,modes", [
    ("bpr", {"known_user", "history"}), ("lightgcn", {"known_user"}),
    ("two_tower", {"known_user", "history"}), ("multivae", {"known_user", "history"}),
    ("sasrec", {"known_user", "history"}),
])
def test_models_train_and_serve(spark, small_prepared, name, modes):
    model = fit_model(name, small_prepared, SMALL)
    assert set(model.modes) == modes
    rows = recommend_users(model, small_prepared, k=3)
    assert rows.count() == 18
    assert rows.where(F.isnan("score") | F.col("score").isNull()).isEmpty()
    metrics = evaluate.ranking_metrics(rows, small_prepared.ratings("test"), 3).first()
    assert metrics.evaluated_users == 6
    if "history" in modes:
        history = spark.createDataFrame([("a", 1, 0, 1.0), ("a", 2, 5, 2.0), ("b", 1, 7, 1.0)],
                                        "request_id string, pos long, item_id long, value double")
        got = recommend_sessions(model, item_space(small_prepared), history, k=4)
        assert got.count() == 8


def test_model_parameter_checks(small_prepared):
    for name, bad in (("multivae", {"hidden_dim": 0}), ("multivae", {"dropout": 1.0}),
                      ("lightgcn", {"layers": 0}), ("sasrec", {"layers": 0})):
        with pytest.raises(ValueError):
            fit_model(name, small_prepared, {**SMALL, **bad})


def test_training_lowers_the_loss(small_prepared):
    def score(steps):
        m = fit_model("bpr", small_prepared, {**SMALL, "steps": steps, "batch_size": 200})
        held = small_prepared.ratings("train").join(m.tables["users"], "user_id").join(
            m.tables["items"].select(F.col("item").alias("item_id"), F.col("vec").alias("o")), "item_id")
        dots = F.aggregate(F.zip_with("vec", "o", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
        return held.agg(F.avg(dots)).first()[0]

    assert score(12) > score(1)


@pytest.mark.parametrize("name", ["bpr", "lightgcn", "two_tower"])
def test_registered_training_grows_with_the_data(monkeypatch, name):
    from catalog import queries, views
    from kindred.operators.training import Training

    seen = {}
    monkeypatch.setattr(views, "model", lambda spark, sf, view, name, **params: seen.update(params))
    monkeypatch.setattr(queries, "_recommend", lambda *a: None)
    monkeypatch.setattr(queries, "_topk", lambda df: df)
    queries.QUERIES[f"{name}_top10"](None, "")
    assert Training.of(seen).steps(seen, 100 * 8192) == 100


def test_registered_fusion_is_trained_in_full(monkeypatch, spark):
    from catalog import queries, views

    asked = []
    monkeypatch.setattr(views, "_MODELS", {})
    monkeypatch.setattr(views, "prepared_clicks", lambda *a: None)
    monkeypatch.setattr(queries, "_hybrid", lambda *a: queries.FittedModel("hybrid", "hybrid", (), {}, {}, ()))
    monkeypatch.setattr(queries.hybrid, "fit_learned_fusion", lambda *a: asked.append(a[3]) or {})
    monkeypatch.setattr(queries, "_recommend", lambda *a: None)
    monkeypatch.setattr(queries, "_topk", lambda df: df)
    queries.lambdamart_top10(spark, "")
    assert asked[0].get("rounds", 50) >= 50 and asked[0].get("candidate_pool_size", 100) >= 100


def test_lambdas_push_positives_up():
    g, h = ranker.lambdas(np.array([0.3, 0.1, 0.2]), np.array([0, 1, 0]))
    assert g[1] > 0 > g[0] and g.sum() == pytest.approx(0) and (h >= 0).all()
    assert not ranker.lambdas(np.array([1.0, 2.0]), np.array([1, 1]))[0].any()


def test_trees_load_and_score(spark):
    rows = [(g, i, float(i % 2) + 0.1 * g, 0.5 * i, i % 2) for g in range(6) for i in range(4)]
    df = spark.createDataFrame(rows, "request_id long, item_id long, a double, b double, label int")
    ensemble = ranker.fit_lambdamart(df, ["a", "b"], rounds=2, depth=2, min_rows=1)
    scored = df.select("label", ranker.ensemble_column(ensemble).alias("s"))
    means = {r.label: r.s for r in scored.groupBy("label").agg(F.avg("s").alias("s")).collect()}
    assert means[1] > means[0]
    with pytest.raises(ValueError):
        ranker.fit_lambdamart(df.withColumn("label", F.lit(0)), ["a", "b"])


def test_trees_count_rows_of_pools_with_one_label(spark):
    """Request 1 has only one label: its rows count for ``min_rows`` and weigh nothing."""
    own = [(0, i, float(i), int(i >= 2)) for i in range(4)]
    other = [(1, i, float(i), 0) for i in range(4)]
    kind = "request_id long, item_id long, a double, label int"

    def tree(rows):
        return ranker.fit_lambdamart(
            spark.createDataFrame(rows, kind), ["a"], rounds=1, depth=1, min_rows=4)["trees"][0]

    alone, both = tree(own), tree(own + other)
    assert "value" in alone and both["feature"] == 0 and 1 <= both["threshold"] < 2
    assert both["left"]["value"] < 0 < both["right"]["value"]
    same = [(g, i, float(i), g) for g in range(2) for i in range(4)]
    assert tree(same) == {"value": 0.0}


def test_learned_serving_is_exact(small_prepared):
    """Same top k as scoring the features of every unseen item."""
    model = fit_hybrid(small_prepared, ["popularity", "itemknn"], "learned",
                       fusion_params={"rounds": 2, "candidate_pool_size": 8, "min_rows": 2})
    from kindred.operators.recommend import recommend
    from kindred.operators.scoring import score_view, seen_pairs, top_k
    from kindred.plans.hybrid import training_batch

    assert model.modes == ("history",)
    batch, space = training_batch(small_prepared, "history"), item_space(small_prepared)
    got = recommend(model, batch, space, 5)
    views = [score_view(c, batch) for c in model.components]
    seen = seen_pairs(batch)
    every = batch.requests.crossJoin(space.items.select("item_id")).join(
        seen, ["request_id", "item_id"], "left_anti")
    rows = ranker.features(views, batch, space, every, seen)
    want = top_k(rows.select("request_id", "item_id",
                             ranker.ensemble_column(model.params["trees"]).alias("score")), 5)
    assert got.select(want.columns).exceptAll(want).isEmpty() and got.count() == 30


def test_hybrid_checks(small_prepared):
    for bad in ({"components": []}, {"components": ["popularity", "popularity"]},
                {"components": ["popularity"], "fusion": "nope"},
                {"components": ["popularity"], "reranker": "nope"}):
        with pytest.raises(ValueError):
            fit_hybrid(small_prepared, **bad)
    with pytest.raises(ValueError, match="share no"):
        fit_hybrid(small_prepared, ["itemknn", "lightgcn"], params={"lightgcn": SMALL})
