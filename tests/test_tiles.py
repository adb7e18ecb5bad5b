"""Inner products with tile pairs skipped by length: same rows as brute force."""

import numpy as np
import pytest

from kindred.operators import vectors
from kindred.operators.vectors import _length_levels, inner_product_topk


def made(spark, n_items, n_queries, steep, seed=1):
    rng = np.random.default_rng(seed)
    e = rng.normal(size=(n_items, 6))
    e *= (np.arange(1, n_items + 1) ** -steep / np.linalg.norm(e, axis=1))[:, None]
    e[-3:] = 0.0
    q = rng.normal(size=(n_queries, 6)) * rng.uniform(0.1, 5, (n_queries, 1))
    q[0] = 0.0
    order = rng.permutation(n_items)
    items = [(int(order[i]), e[i].tolist()) for i in range(n_items)]
    frame = spark.createDataFrame(items, "item long, vec array<double>")
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "qid long, vec array<double>")
    by_id = np.empty_like(e)
    by_id[order] = e
    return frame, asked, by_id, q


def brute(e, q, k, hidden=(), positive=False):
    scores = np.rint(q @ e.T * 1e9) / 1e9
    for a, b in hidden:
        scores[a, b] = -np.inf
    if positive:
        scores[~(scores > 0)] = -np.inf
    out = set()
    for i, row in enumerate(scores):
        best = sorted((x for x in range(len(row)) if np.isfinite(row[x])), key=lambda x: (-row[x], x))[:k]
        out |= {(i, x, float(row[x]), r + 1) for r, x in enumerate(best)}
    return out


@pytest.mark.parametrize("masked,positive", [(False, False), (True, False), (True, True)])
def test_skipped_tiles_change_nothing(spark, masked, positive):
    items, queries, e, q = made(spark, 600, 90, 0.9)
    rng = np.random.default_rng(3)
    hidden = [(a, b) for a in range(90) for b in np.argsort(-(q[a] @ e.T))[: rng.integers(0, 30)].tolist()] if masked else []
    mask = spark.createDataFrame(hidden or [(0, 0)], "qid long, item long") if masked else None
    report = {}
    got = inner_product_topk(queries, items, 5, mask, positive_only=positive, tile=20, report=report)
    assert {tuple(r) for r in got.select("qid", "item", "score", "rank").collect()} == brute(e, q, 5, hidden, positive)
    assert report["skipped"] > 0.25 * (report["skipped"] + report["wanted"])


def test_like_lengths_are_compared_at_once(spark):
    items, queries, e, q = made(spark, 200, 10, 0.0)
    assert _length_levels(items.where("item >= 0"), 20, 20) is None
    report = {}
    got = inner_product_topk(queries, items, 3, tile=20, report=report)
    assert {tuple(r) for r in got.select("qid", "item", "score", "rank").collect()} == brute(e, q, 3) and not report


@pytest.mark.parametrize("tile", [8, 2000])
def test_many_tiles_grow_and_are_scored_in_blocks(spark, tile):
    assert vectors._grown(700, 100, 8, 4) == (44, 7) and vectors._grown(700, 100, 8, 1) == (88, 13)
    assert vectors._grown(425_000, 425_000, vectors.TILE, vectors.WIDER) == (26, 26)
    items, asked, e, q = made(spark, 100, 700, 0.0)
    hidden = [(5, 3), (600, 4), (600, 99), (699, 0)]
    masked = spark.createDataFrame(hidden, "qid long, item long")
    got = {(r.qid, r.rank): (r.item, r.score) for r in inner_product_topk(asked, items, 4, masked, tile=tile).collect()}
    want = np.rint(q @ e.T * 1e9) / 1e9
    for a, b in hidden:
        want[a, b] = -np.inf
    for row in range(700):
        best = np.lexsort((np.arange(100), -want[row]))[:4]
        assert [got[row, i + 1][0] for i in range(4)] == best.tolist()
