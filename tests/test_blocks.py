"""Blocks of training steps against single steps."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.operators import blocks, factor

PARAMS = {"embedding_dim": 4, "batch_size": 4, "steps": 5, "epochs": 1, "learning_rate": 0.05}


def vectors(model):
    rows = model.tables["users"].collect() + model.tables["items"].collect()
    return np.array([r.vec for r in sorted(rows, key=lambda r: (r.asDict().keys() != {"user_id", "vec"}, r[0]))])


@pytest.mark.parametrize("fit", [factor.fit_bpr, factor.fit_two_tower])
def test_blocks_equal_single_steps(small_prepared, monkeypatch, fit):
    """Five steps in one block, in blocks of two, and one by one; a block writes one table."""
    pins = []
    monkeypatch.setattr(blocks, "pin", lambda df, keep=blocks.pin: pins.append(1) or keep(df))
    whole = vectors(fit(small_prepared, PARAMS))
    assert len(pins) == 2  # the start and one block
    dim = 8 if fit is factor.fit_two_tower else 4
    monkeypatch.setattr(blocks, "CELLS", 2 * 9 * dim * 4)
    pins.clear()
    cut = vectors(fit(small_prepared, PARAMS))
    assert len(pins) == 4
    monkeypatch.setattr(blocks, "CELLS", 0)
    single = vectors(fit(small_prepared, PARAMS))
    assert np.allclose(cut, whole, rtol=1e-12, atol=1e-14)
    assert np.allclose(single, whole, rtol=1e-6, atol=1e-9)


def test_rows_without_pairs_follow_their_moments(spark):
    """A row that no pair touches is moved by its moments alone, over all steps."""
    start = [(1, [0.5, -0.5], [0.1, 0.2], [0.01, 0.04])]
    table = spark.createDataFrame(start, "node long, vec array<double>, m array<double>, v array<double>").withColumn("at", F.lit(0).cast("bigint"))
    got = blocks.finish(table, 2, 0.1, 3).first().vec
    vec, m, v = (np.array([x]) for x in start[0][1:])
    for step in (1, 2, 3):
        m, v = m * 0.9, v * 0.999
        vec = vec - (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8) * 0.1
    assert np.allclose(got, vec[0], rtol=1e-14)


def test_advance_rows_of_different_steps():
    rng = np.random.default_rng(3)
    n = 3 * blocks.ROWS // 2
    state = [rng.normal(size=(n, 2)), rng.normal(size=(n, 2)), rng.random((n, 2))]
    at, until = rng.integers(0, 5, n), rng.integers(0, 8, n)
    want = [x.copy() for x in state]
    for i in range(n):
        row = [x[i : i + 1] for x in want]
        for step in range(at[i] + 1, until[i] + 1):
            blocks.move(*row, step, 0.05)
    blocks.advance(*state, at, until, 0.05)
    assert all(np.array_equal(x, y) for x, y in zip(state, want))
