"""Blocks of small training steps: the rows that a block touches meet its pairs in one task.

Steps follow one another, so a block of them is a chain whatever the size of the table; its rows are bounded
by its pairs. All other rows stay where they are: a row carries the step up to which Adam has moved it, and
its steps without gradient are made up for where it is wanted next, by the tasks that read the table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.session import pin, release

BETA1, BETA2, EPSILON = 0.9, 0.999, 1e-8
#: Numbers (vectors with both moments) that the rows of a block may hold.
CELLS = 1 << 25

#: (step, vectors of users, positives, negatives) -> gradients of the three.
Gradient = Callable[[int, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def block_steps(size: int, dim: int) -> int:
    """Steps of ``size`` pairs that a block may have; 0 where one step is already too large."""
    return CELLS // (9 * dim * max(size, 1))


#: Rows that are moved at a time, so that they stay in the cache.
ROWS = 2048


def move(vec: np.ndarray, m: np.ndarray, v: np.ndarray, step: int, rate: float, g: np.ndarray | None = None) -> None:
    """One Adam step in place; ids without gradient still follow their moments."""
    c1, c2 = 1 - BETA1**step, 1 - BETA2**step
    m *= BETA1
    v *= BETA2
    if g is not None:
        m += g * (1 - BETA1)
        v += g * g * (1 - BETA2)
    root = v / c2
    np.sqrt(root, out=root)
    root += EPSILON
    by = m / c1
    by /= root
    by *= rate
    vec -= by


def advance(vec: np.ndarray, m: np.ndarray, v: np.ndarray, at: np.ndarray, until: np.ndarray, rate: float) -> None:
    """The steps without gradient after ``at`` up to ``until``, row by row its own, in place."""
    behind = np.flatnonzero(at < until)
    behind = behind[np.lexsort((at[behind], until[behind]))]
    for low in range(0, len(behind), ROWS):
        rows = behind[low : low + ROWS]
        some, begin, end = (vec[rows], m[rows], v[rows]), at[rows], until[rows]
        same = begin[0] <= begin[-1] and end[0] == end[-1]  # then the rows of a step come first
        for step in range(int(begin.min()) + 1, int(end.max()) + 1):
            if same:
                here = slice(0, int(np.searchsorted(begin, step)))
                move(*(x[here] for x in some), step, rate)
                continue
            here = np.flatnonzero((begin < step) & (end >= step))
            part = tuple(x[here] for x in some)
            move(*part, step, rate)
            for x, y in zip(some, part):
                x[here] = y
        vec[rows], m[rows], v[rows] = some


def _cells(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def _lists(cells: np.ndarray) -> pa.Array:
    offsets = np.arange(len(cells) + 1, dtype=np.int32) * cells.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(cells).ravel()))


_ROW = "node bigint, vec array<double>, m array<double>, v array<double>, at bigint"
_NAMES = ["node", "vec", "m", "v", "at"]


def _advanced(dim: int, rate: float):
    """Batches of rows, each moved on to its ``until``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vec, m, v = (_cells(batch.column(c), dim).copy() for c in ("vec", "m", "v"))
            at, until = batch.column("at").to_numpy(), batch.column("until").to_numpy()
            advance(vec, m, v, at, until, rate)
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), _lists(vec), _lists(m), _lists(v), pa.array(np.maximum(at, until))], _NAMES
            )

    return run


def _chained(dim: int, rate: float, gradient: Gradient, left: Callable[[], list | None]):
    """The rows and pairs of a block to its rows after the last step; ``left`` adds a row of the caller's own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, cells, ats, pairs = [], [[], [], []], [], []
        for batch in batches:
            step = batch.column("step").to_numpy(zero_copy_only=False)
            rows = np.flatnonzero(~(step > 0))
            if len(rows):
                some = batch.take(pa.array(rows))
                nodes.append(some.column("node").to_numpy())
                ats.append(some.column("at").to_numpy())
                for out, name in zip(cells, ("vec", "m", "v")):
                    out.append(_cells(some.column(name), dim))
            rows = np.flatnonzero(step > 0)
            if len(rows):
                some = batch.take(pa.array(rows))
                pairs.append(np.stack([some.column(c).to_numpy().astype(np.int64) for c in ("step", "node", "positive", "negative")]))
        if not nodes:
            return
        node = np.concatenate(nodes)
        order = np.argsort(node)
        node, at = node[order], np.concatenate(ats)[order]
        vec, m, v = (np.concatenate(c)[order] for c in cells)
        del nodes, cells, ats
        steps = np.concatenate(pairs, axis=1) if pairs else np.zeros((4, 0), np.int64)
        # In one order whatever the partitions, as sums of doubles depend on it.
        steps = steps[:, np.lexsort(steps[::-1])]
        for step in np.unique(steps[0]).tolist():
            low, high = np.searchsorted(steps[0], [step, step + 1])
            places = np.searchsorted(node, steps[1:, low:high])
            rows, where = np.unique(places, return_inverse=True)
            where = where.reshape(places.shape)
            some = vec[rows], m[rows], v[rows]
            advance(*some, at[rows], np.full(len(rows), step - 1), rate)
            parts = gradient(step, *(some[0][w] for w in where))
            flat, each = where.ravel(), np.concatenate(parts)
            total = np.stack([np.bincount(flat, each[:, d], len(rows)) for d in range(dim)], axis=1)
            move(*some, step, rate, total)
            vec[rows], m[rows], v[rows] = some
            at[rows] = step
        yield pa.RecordBatch.from_arrays([pa.array(node), _lists(vec), _lists(m), _lists(v), pa.array(at)], _NAMES)
        own = left()
        if own is not None:
            flat = [pa.array([x.tolist()], pa.list_(pa.float64())) for x in own]
            yield pa.RecordBatch.from_arrays([pa.array([0]), *flat, pa.array([int(at.max())])], _NAMES)

    return run


def start(table: DataFrame) -> DataFrame:
    """A parameter table (node, vec, m, v) before its first step."""
    return pin(table.withColumn("at", F.lit(0).cast("bigint")))


def run_block(
    table: DataFrame, pairs: DataFrame, dim: int, rate: float, gradient: Gradient, left: Callable[[], list | None] = lambda: None
) -> DataFrame:
    """The table after the steps of ``pairs`` (step from 1, user, positive, negative), all in one task.

    What ``left`` returns comes back under the unused node 0.
    """
    uses = pairs.select("step", F.explode(F.array("user", "positive", "negative")).alias("node"))
    touched = F.broadcast(uses.groupBy("node").agg((F.min("step") - 1).alias("until")))
    own = table.where(F.col("node") != 0)
    wanted = own.join(touched, "node").mapInArrow(_advanced(dim, rate), _ROW)
    none, empty = F.lit(None), F.array().cast("array<double>")  # null lists are slow to hand over
    rows = wanted.select(none.cast("bigint").alias("step"), "*", none.cast("bigint").alias("positive"), none.cast("bigint").alias("negative"))
    draws = pairs.select(
        F.col("step").cast("bigint").alias("step"), F.col("user").alias("node"), *[empty.alias(c) for c in ("vec", "m", "v")],
        none.cast("bigint").alias("at"), "positive", "negative",
    )
    chained = rows.unionByName(draws).repartition(1).mapInArrow(_chained(dim, rate, gradient, left), _ROW)
    rest = own.join(touched.select("node"), "node", "left_anti").select(*_NAMES)
    moved = pin(rest.unionByName(chained))
    release(table)
    return moved


def finish(table: DataFrame, dim: int, rate: float, steps: int) -> DataFrame:
    """(node, vec) with every row moved on to the last step."""
    until = table.where(F.col("node") != 0).withColumn("until", F.lit(steps).cast("bigint"))
    return until.mapInArrow(_advanced(dim, rate), _ROW).select("node", "vec")
