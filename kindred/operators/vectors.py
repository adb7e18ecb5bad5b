"""Dense vectors: exact top-k by inner product, in tiles.

Queries and items are hashed into tiles of bounded size, each pair of tiles is one Spark group,
and only the best k of a query leave a tile. The tile's matrix product runs in numpy.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.functions.ids import plain_ids, restore_ids
from kindred.session import pin

TILE = 4096
WIDER = 4  # times that a tile may grow where tile pairs are many, so that rows travel less often
MANY = 256  # tile pairs that are left for tasks to share
BLOCK = 512  # query rows of a tile that are scored at once
CELLS = BLOCK * TILE * WIDER  # scores that a block holds at most
QUERY, ITEM, PAIR = 0, 1, 2


def l2_normalize(vector: Column) -> Column:
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm > 0, F.transform(vector, lambda x: x / norm)).otherwise(vector)


def as_double(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def sum_vectors(
    grouped, vector: str, dim: int, extra: list[Column] = (), weight: Column | None = None
) -> DataFrame:
    """Element-wise (weighted) sum of an array column as ``dim`` plain sums.

    Sums aggregate partially before the shuffle and stay in generated code.
    """
    def cell(d: int) -> Column:
        return F.col(vector)[d] if weight is None else F.col(vector)[d] * weight

    summed = grouped.agg(*[F.sum(cell(d)).alias(f"_d{d}") for d in range(dim)], *extra)
    names = [f"_d{d}" for d in range(dim)]
    return summed.withColumn(vector, F.array(*names)).drop(*names)


def _tiles(rows: int, tile: int) -> int:
    return max(1, ceil(rows / tile))


def _grown(queries: int, items: int, tile: int, wider: int, many: int = MANY) -> tuple[int, int]:
    """Numbers of tiles of both sides, from tiles that grow while enough pairs of them are left."""
    size = tile
    while 2 * size <= wider * tile and _tiles(queries, 2 * size) * _tiles(items, 2 * size) >= many:
        size *= 2
    return _tiles(queries, size), _tiles(items, size)


def tiled(
    queries: DataFrame,
    items: DataFrame,
    function: Callable[[pd.DataFrame, pd.DataFrame, pd.DataFrame], pd.DataFrame],
    schema: T.StructType | str,
    pairs: DataFrame | None = None,
    tile: int = TILE,
    carry: str | None = None,
    placed: bool = False,
    wider: int = 1,
    many: int = MANY,
    sizes: tuple[int, int] | None = None,
) -> DataFrame:
    """Run ``function(queries, items, pairs)`` on every pair of tiles.

    ``queries`` is (qid, vec), ``items`` is (item, vec), ``pairs`` is (qid, item[, x]): pairs
    reach only the tile that holds both their ends. Frames arrive sorted by id. ``carry`` names
    a further column that travels with the queries. ``placed`` tables say themselves where they go:
    queries and items have (tq, ti), one of them an array of all tiles that the row is wanted in, and
    pairs have both numbers. Tiles of many rows grow up to ``wider`` times while ``many`` pairs of them are
    left, for functions whose memory does not grow with the product of a tile pair. ``sizes`` are the
    numbers of queries and items where the caller knows them.
    """
    tq = ti = 1
    if not placed:
        tq, ti = _grown(*(sizes or (queries.count(), items.count())), tile, wider, many)
    q_type = queries.schema["qid"].dataType.simpleString()
    i_type = items.schema["item"].dataType.simpleString()

    def bucket(column: str, n: int) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")

    def null(kind: str) -> Column:
        return F.lit(None).cast(kind)

    if placed:
        own = {"q": F.col("tq"), "i": F.col("ti")}
        every = {"q": F.explode("tq"), "i": F.explode("ti")}
    else:
        own = {"q": bucket("qid", tq), "i": bucket("item", ti)}
        every = {"q": F.explode(F.sequence(F.lit(0), F.lit(tq - 1))),
                 "i": F.explode(F.sequence(F.lit(0), F.lit(ti - 1)))}
    load = [] if carry is None else [queries.schema[carry].dataType.simpleString()]
    carried = [F.col(carry)] if load else []
    unloaded = [null(load[0]).alias(carry)] if load else []
    rows = queries.select(
        own["q"].alias("tq"), every["i"].alias("ti"), F.lit(QUERY).alias("kind"),
        "qid", null(i_type).alias("item"), as_double(F.col("vec")).alias("vec"),
        null("double").alias("x"), *carried,
    ).unionByName(
        items.select(
            every["q"].alias("tq"), own["i"].alias("ti"), F.lit(ITEM).alias("kind"),
            null(q_type).alias("qid"), "item", as_double(F.col("vec")).alias("vec"),
            null("double").alias("x"), *unloaded,
        )
    )
    if pairs is not None:
        x = F.col("x").cast("double") if "x" in pairs.columns else null("double")
        rows = rows.unionByName(
            pairs.select(
                own["q"].alias("tq"), own["i"].alias("ti"),
                F.lit(PAIR).alias("kind"), "qid", "item", null("array<double>").alias("vec"),
                x.alias("x"), *unloaded,
            )
        )

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        q = frame[frame["kind"] == QUERY].sort_values("qid", ignore_index=True)
        i = frame[frame["kind"] == ITEM].sort_values("item", ignore_index=True)
        return function(q, i, frame[frame["kind"] == PAIR])

    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    empty = {f.name: [] for f in schema.fields}

    def guarded(frame: pd.DataFrame) -> pd.DataFrame:
        kinds = frame["kind"]
        if not (kinds == QUERY).any() or not (kinds == ITEM).any():
            return pd.DataFrame(empty)
        return run(frame)

    return rows.groupBy("tq", "ti").applyInPandas(guarded, schema)


def matrix(frame: pd.DataFrame, column: str = "vec") -> np.ndarray:
    return np.stack(frame[column].to_numpy()).astype(np.float64)


def locate(values: pd.Series, ids: pd.Series) -> np.ndarray:
    """Row numbers of ``values`` in the sorted ``ids``; -1 when absent."""
    ids = ids.to_numpy()
    at = np.searchsorted(ids, values.to_numpy())
    at = np.minimum(at, len(ids) - 1)
    return np.where(ids[at] == values.to_numpy(), at, -1)


def best_in_rows(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the k best entries per row; ties to the lower column."""
    n = scores.shape[1]
    if n > k:
        floor = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
        rows, columns = np.nonzero((scores >= floor) & np.isfinite(scores))
    else:
        rows, columns = np.nonzero(np.isfinite(scores))
    order = np.lexsort((columns, -scores[rows, columns], rows))
    rows, columns = rows[order], columns[order]
    first = np.searchsorted(rows, rows)
    keep = np.arange(len(rows)) - first < k
    return rows[keep], columns[keep]


def inner_product_topk(
    queries: DataFrame,
    items: DataFrame,
    k: int,
    masked: DataFrame | None = None,
    positive_only: bool = False,
    exclude_same: bool = False,
    digits: int = 9,
    tile: int = TILE,
    report: dict[str, int] | None = None,
    wider: int = WIDER,
    many: int = MANY,
) -> DataFrame:
    """(qid, item, score, rank): exact top-k inner products; ``masked`` (qid, item) left out.

    Where lengths of item vectors differ, the longest items are compared first; an item of length c
    scores at most |q| c, so a query then meets only the levels of length that can still reach its k-th
    score, and tile pairs that no query wants are not made. ``report`` gets the numbers of tile pairs.
    """
    ids = {"qid": queries.schema["qid"].dataType, "item": items.schema["item"].dataType}
    queries, items = plain_ids(queries, "qid"), plain_ids(items, "item")
    masked = None if masked is None else plain_ids(masked, "qid", "item")
    q_type = queries.schema["qid"].dataType.simpleString()
    i_type = items.schema["item"].dataType.simpleString()

    def local(q: pd.DataFrame, i: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        left, right = matrix(q), matrix(i).T
        hide_q, hide_i = np.empty(0, int), np.empty(0, int)
        if len(pairs):
            hide_q, hide_i = locate(pairs["qid"], q["qid"]), locate(pairs["item"], i["item"])
        same = locate(q["qid"], i["item"]) if exclude_same else np.full(len(q), -1)
        found = []
        block = max(1, min(BLOCK, CELLS // len(i)))
        for start in range(0, len(q), block):
            scores = left[start : start + block] @ right
            scores *= 10.0**digits
            np.rint(scores, out=scores)
            scores /= 10.0**digits
            here = (hide_q >= start) & (hide_q < start + block)
            scores[hide_q[here] - start, hide_i[here]] = -np.inf
            at = same[start : start + block]
            present = np.flatnonzero(at >= 0)
            scores[present, at[present]] = -np.inf
            if positive_only:
                scores[~(scores > 0)] = -np.inf
            rows, columns = best_in_rows(scores, k)
            found.append((rows + start, columns, scores[rows, columns]))
        rows, columns, best = (np.concatenate(part) for part in zip(*found))
        return pd.DataFrame({"qid": q["qid"].to_numpy()[rows], "item": i["item"].to_numpy()[columns], "score": best})

    if masked is not None:
        # A pair can only mask something when both its ends exist.
        masked = masked.join(queries.select("qid"), "qid", "left_semi").join(
            items.select("item"), "item", "left_semi"
        ).select("qid", "item")
    schema = f"qid {q_type}, item {i_type}, score double"
    levels = _length_levels(items, max(k, tile), tile)
    if levels is None:
        best = tiled(queries, items, local, schema, masked, tile, wider=wider, many=many)
    else:
        best = _by_length(queries, items, local, schema, masked, tile, k, levels, 10.0**-digits, report)
    ranked = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("item"))
    ranked_rows = best.withColumn("rank", F.row_number().over(ranked).cast("bigint"))
    return restore_ids(ranked_rows.where(F.col("rank") <= k), ids)


#: Levels of length that items are cut into, and the ratio of lengths from which it pays.
LEVELS, SPREAD = 32, 1.25


def _length(vec: Column) -> Column:
    return F.sqrt(F.aggregate(as_double(vec), F.lit(0.0), lambda s, x: s + x * x))


@dataclass
class Levels:
    """Levels of items by length, the longest first: lower bounds, greatest lengths, numbers of items."""

    bounds: list[float]
    longest: list[float]
    counts: list[int]

    def of(self, length: Column) -> Column:
        return sum((F.when(length < b, 1).otherwise(0) for b in self.bounds), F.lit(0))


def _length_levels(items: DataFrame, least: int, tile: int) -> Levels | None:
    """None where one comparison of everything is cheaper: few tiles, or lengths that are much alike."""
    sized = items.select(_length(F.col("vec")).alias("c"))
    shares = [i / LEVELS for i in range(1, LEVELS)]
    n, cuts = sized.agg(F.count("c"), F.percentile_approx("c", shares, 10_000)).first()
    if n < 4 * least or not cuts or cuts[-1] < SPREAD * cuts[0]:
        return None
    step = max(1, -(-least * LEVELS // n))  # a level holds at least ``least`` items, about
    bounds = sorted({c for c in cuts[::-1][step - 1 :: step] if c > 0}, reverse=True)
    draft = Levels(bounds, [], [])
    found = sized.groupBy(draft.of(F.col("c")).alias("level")).agg(F.max("c").alias("most"), F.count("c").alias("n"))
    rows = {r["level"]: (r["most"], r["n"]) for r in found.collect()}  # at most LEVELS rows
    return Levels(bounds, [rows.get(i, (0.0, 0))[0] for i in range(len(bounds) + 1)], [rows.get(i, (0.0, 0))[1] for i in range(len(bounds) + 1)])


def _starts(counts: list[int], tile: int) -> list[int]:
    """First tile of each group, and the number of tiles, when groups of rows are cut into tiles."""
    out = [0]
    for n in counts:
        out.append(out[-1] + -(-n // tile))
    return out


def _pick(values: list[int], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _by_length(
    queries: DataFrame, items: DataFrame, local, schema: str, masked: DataFrame | None, tile: int, k: int,
    levels: Levels, grain: float, report: dict[str, int] | None,
) -> DataFrame:
    """Candidates (qid, item, score) that hold every query's top k."""
    longest = pin(items.withColumn("level", levels.of(_length(F.col("vec")))))
    first = longest.where("level = 0").drop("level")
    held = None if masked is None else masked.join(first.select("item"), "item", "left_semi").select("qid", "item")
    best = pin(tiled(queries, first, local, schema, held, tile))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("item"))))
    floor = ranked.where(F.col("rank") == k).select("qid", F.col("score").alias("floor"))
    # Levels get shorter, so a query wants the first ones only; a rounded score may be a grain higher.
    reach = [_length(F.col("vec")) * F.lit(most) * (1 + 1e-12) + F.lit(grain) >= F.col("floor") for most in levels.longest[1:]]
    wanted = sum((F.when(F.col("floor").isNull() | r, 1).otherwise(0) for r in reach), F.lit(0))
    asked = pin(queries.join(floor, "qid", "left").withColumn("wants", wanted).drop("floor").where("wants > 0"))
    many = {r["wants"]: r["n"] for r in asked.groupBy("wants").agg(F.count(F.lit(1)).alias("n")).collect()}
    deepest = len(levels.counts) - 1
    # Queries that want most come first, cut into classes of a tile or more; so a level is wanted by a
    # first stretch of query tiles.
    class_of, tops, sizes = [0] * (deepest + 1), [], []
    for want in range(deepest, 0, -1):
        if not sizes or sizes[-1] >= tile:
            tops.append(want)
            sizes.append(0)
        sizes[-1] += many.get(want, 0)
        class_of[want] = len(sizes) - 1
    at_q, at_i = _starts(sizes, tile), _starts(levels.counts[1:], tile)
    until = [at_q[sum(t >= lv for t in tops)] for lv in range(1, deepest + 1)]  # query tiles of a level
    used = sum((at_i[lv] - at_i[lv - 1]) * until[lv - 1] for lv in range(1, deepest + 1))
    if report is not None:
        report.update(wanted=used, skipped=_starts([queries.count()], tile)[1] * at_i[-1] - used)
    if not used:
        return best

    def place(start: list[int], group: Column, key: str) -> Column:
        width = F.greatest(_pick(start[1:], group) - _pick(start[:-1], group), F.lit(1))
        return (_pick(start[:-1], group) + F.pmod(F.xxhash64(key), width)).cast("int")

    at = asked.select(
        "qid", "vec", place(at_q, _pick(class_of, F.col("wants")), "qid").alias("tq"),
        F.sequence(F.lit(0), _pick(at_i[1:], F.col("wants") - 1) - 1).alias("ti"),
    )
    rest = longest.where("level > 0").withColumn("until", _pick(until, F.col("level") - 1)).where("until > 0").select(
        "item", "vec", F.sequence(F.lit(0), F.col("until") - 1).alias("tq"), place(at_i, F.col("level") - 1, "item").alias("ti"),
    )
    hidden = None
    if masked is not None:
        hidden = masked.join(at.select("qid", "tq", F.array_max("ti").alias("most")), "qid").join(rest.select("item", "ti"), "item")
        hidden = hidden.where("ti <= most").select("qid", "item", "tq", "ti")
    return best.unionByName(tiled(at, rest, local, schema, hidden, tile, placed=True))


def embedding_neighbours(vectors: DataFrame, n: int = 100, tile: int = TILE) -> DataFrame:
    """(item, other, weight, rank): top-n positive inner products with the other rows."""
    queries = vectors.select(F.col("item").alias("qid"), "vec")
    return inner_product_topk(
        queries, vectors, n, positive_only=True, exclude_same=True, tile=tile
    ).select(
        F.col("qid").alias("item"), F.col("item").alias("other"), F.col("score").alias("weight"),
        "rank",
    )
