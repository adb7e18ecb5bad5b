"""Fusions of listed scores, request by request, against the general way over written score tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.operators import fusion, lists, scoring
from kindred.operators.scoring import ScoreView
from kindred.plans.fitted import HISTORY, ItemSpace, QueryBatch

N, USERS = 40, 12


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(11)

    def edges(coarse):
        rows = [(i, j, float(w)) for i in range(N) for j in range(N) if i != j and rng.random() < 0.15
                for w in [rng.normal() if not coarse else rng.integers(-8, 30) / 16] if w]
        return spark.createDataFrame(rows, "item long, other long, weight double")

    held = rng.random((USERS, N)) < 0.2
    held[3] = False  # a request without history
    value = rng.integers(-2, 5, (USERS, N)) / 2.0  # some stored zeros
    vector = spark.createDataFrame(
        [(u, i, float(value[u, i])) for u in range(USERS) for i in range(N) if held[u, i]],
        "request_id long, item_id long, value double")
    pop = rng.integers(0, 9, N).astype(float)
    order = np.lexsort((np.arange(N), -pop))
    base = spark.createDataFrame([(int(i), float(pop[i]), r + 1) for r, i in enumerate(order)], "item_id long, score double, pos long")
    items = spark.createDataFrame([(i, i + 1) for i in range(N)], "item_id long, pos long")
    requests = spark.range(USERS).withColumnRenamed("id", "request_id")
    batch = QueryBatch(HISTORY, requests, vector)
    return base, {"a": edges(True), "b": edges(False)}, batch, ItemSpace(items, N)


def both(tables, names):
    """The same views with listed and with written scores."""
    base, edges, batch, _ = tables
    for written in (False, True):
        views = [
            ScoreView("p", base=base) if n == "p" else ScoreView(n, listed=(batch.vector, edges[n], None)) for n in names
        ]
        yield [ScoreView(v.name, nonzero=v.expanded().nonzero) if written and v.listed else v for v in views]


def rows(df):
    return {(r.request_id, r["rank"]): (r.item_id, round(r.score, 8)) for r in df.collect()}


@pytest.mark.parametrize("names,mask,k,constant", [("pa", True, 7, 60.0), ("b", False, 3, 1.0), ("apb", True, N, 5.0)])
def test_rrf_without_score_tables(tables, names, mask, k, constant):
    batch, space = tables[2:]
    seen = scoring.seen_pairs(batch) if mask else None
    here, general = both(tables, names)
    got = rows(fusion.rrf_topk(here, batch, space, k, seen, constant))
    assert all(v.nonzero is None for v in here)  # no table of scores was written
    assert got == rows(fusion.rrf_topk(general, batch, space, k, seen, constant)) and got


@pytest.mark.parametrize("names,weights,mask,k", [
    ("pa", {}, True, 6), ("apb", {"p": -0.5, "b": 2.0}, True, N), ("pb", {"p": 0.0}, False, 6), ("ab", {"a": -1.0}, True, 6),
])
def test_weighted_without_score_tables(tables, names, weights, mask, k):
    batch, space = tables[2:]
    seen = scoring.seen_pairs(batch) if mask else None
    here, general = both(tables, names)
    got = rows(fusion.weighted_topk(here, batch, space, k, seen, weights))
    assert all(v.nonzero is None for v in here)
    assert got == rows(fusion.weighted_topk(general, batch, space, k, seen, weights)) and got


def test_small_pieces_and_large_requests(tables, monkeypatch):
    """Pieces of a task end between requests; a request past the bound takes the general way."""
    batch, space = tables[2:]
    want = rows(fusion.rrf_topk(next(both(tables, "pa")), batch, space, 5, None))
    monkeypatch.setattr(lists, "TOGETHER", 300)
    assert rows(fusion.rrf_topk(next(both(tables, "pa")), batch, space, 5, None)) == want
    monkeypatch.setattr(lists, "MOST", 10)
    here = next(both(tables, "pa"))
    assert rows(fusion.rrf_topk(here, batch, space, 5, None)) == want and here[1].nonzero is not None


def test_a_pinned_table_leaves_no_shuffle_files(spark, monkeypatch):
    """The files of a write's shuffles go when it ends; the caller's setting stays as it was."""
    from pyspark.sql import DataFrameWriter

    from kindred import session

    before, during = spark.conf.get(session._CLEANUP), []
    write = DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **k: during.append(spark.conf.get(session._CLEANUP)) or write(self, *a, **k))
    assert session.pin(spark.range(50).repartition(3, "id")).count() == 50
    assert during == ["true"] and spark.conf.get(session._CLEANUP) == before


@pytest.mark.parametrize("coarse", [True, False])
def test_lists_travel_in_four_bytes_where_they_fit(spark, tables, coarse):
    """Ids and weights on the grid go as whole numbers, others as they are; sums are the same."""
    from kindred.functions.numbers import quantize

    vector = tables[2].vector
    edges = tables[1]["a"] if coarse else tables[1]["b"].withColumn("other", F.col("other") + F.lit(1 << 40))
    want = vector.where("value <> 0").join(edges.withColumnRenamed("item", "item_id"), "item_id").groupBy("request_id", "other").agg(
        quantize(F.sum(F.col("value") * F.col("weight"))).alias("score")).where("score <> 0")
    got = scoring.weighted_history(vector, edges)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert ("cast(other" in plan) == coarse
