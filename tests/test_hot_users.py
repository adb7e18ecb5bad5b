"""Every step gives the same rows when users are treated as too large for one task."""

import pytest
from pyspark.sql import functions as F

import kindred.operators.positions as positions
from kindred.operators.recommend import recommend
from kindred.operators.retrievers import item_space
from kindred.operators.split import Split, prepare
from kindred.plans.fitted import FittedModel
from kindred.plans.hybrid import training_batch
from kindred.plans.registry import fit_component


@pytest.fixture(scope="module")
def events(spark):
    """One user holds a third of all rows and most of the items."""
    ids = spark.range(180)
    return ids.select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 9 + 1).alias("user_id"),
        (F.col("id") * 37 % 64 + F.floor(F.col("id") / 64)).cast("bigint").alias("item_id"),
        (F.col("id") % 5 + 1).cast("double").alias("value"),
        F.timestamp_micros((F.col("id") * 13 % 29).cast("bigint")).alias("timestamp"),
        F.col("id").alias("row"),
    )


@pytest.mark.parametrize("name", ["popularity", "itemknn", "markov", "rrf", "weighted"])
def test_recommendations_do_not_depend_on_the_hot_path(events, name, monkeypatch):
    results = []
    for limit in (10**9, 20):
        monkeypatch.setattr(positions, "HOT_ROWS", limit)
        data = prepare(events, ["row"], Split("temporal", 0.1, 0.2), hot_rows=limit)
        assert (data.hot_users is None) == (limit > 180)
        parts = tuple(
            fit_component(n, data, {"neighbours": 5}) for n in ("popularity", "itemknn", "markov")
            if name in ("rrf", "weighted", n)
        )
        model = parts[0]
        if name in ("rrf", "weighted"):
            model = FittedModel("hybrid", "hybrid", ("history",), {}, {"fusion": name}, parts)
        batch = training_batch(data, "history")
        rows = recommend(model, batch, item_space(data), 6).orderBy("request_id", "rank").collect()
        results.append([(r.request_id, r.item_id, round(r.score, 6)) for r in rows])
    assert results[0] == results[1] and len(results[0]) > 20
