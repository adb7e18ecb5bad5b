"""Fusions of shared rankings and of listed scores, request by request.

A listed view states its scores as the lists of a request's history items. These lists travel once to
the task that holds the request; scores, ranks, masks and the best k are worked out there, so that no
table of scores is written or shuffled. Items travel as their positions in id order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions.ids import plain_ids, restore_ids
from kindred.functions.numbers import DUST, SCORE_DIGITS
from kindred.operators.pairs import sum_tasks
from kindred.session import pin

#: Listed scores of one request, and first places of a shared order, that a task may hold.
MOST, FIRST = 1 << 20, 1 << 20
#: Listed scores that are worked on at once.
TOGETHER = 1 << 21
REQUEST, SEEN, LISTED = 0, 1, 2  # kinds of rows; LISTED + v are those of the v-th listed view


def exact(weight: Column) -> Column:
    """Whether a weight is a whole number of grid steps that fits four bytes."""
    steps = F.rint(weight * F.lit(10.0**SCORE_DIGITS))
    return (steps / F.lit(10.0**SCORE_DIGITS) == weight) & (F.abs(steps) < F.lit(2.0**31))


def snapped(values: np.ndarray, digits: int = SCORE_DIGITS) -> np.ndarray:
    """:func:`kindred.functions.numbers.quantize` of an array."""
    out = np.rint(values * 10.0**digits) / 10.0**digits
    tiny = (out == 0) & (np.abs(values) > DUST)
    if tiny.any():
        fine = np.power(10.0, 6.0 - np.floor(np.log10(np.abs(values[tiny]))))
        out[tiny] = np.rint(values[tiny] * fine) / fine
    return out


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every stretch, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def within(keys: np.ndarray, sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of each key in the sorted keys, whether it is there)."""
    at = np.searchsorted(sorted_keys, keys)
    if not len(sorted_keys):
        return at, np.zeros(len(keys), bool)
    return at, sorted_keys[np.minimum(at, len(sorted_keys) - 1)] == keys


class Scored:
    """Non-zero scores of one listed view for some requests, by request and position of the item."""

    def __init__(self, key: np.ndarray, product: np.ndarray, extra: np.ndarray, many: int, wide: int):
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        score = snapped(np.add.reduceat(product[order], first)) if len(key) else np.zeros(0)
        live = score != 0
        self.key, self.score, self.extra = key[first][live], score[live], extra[order[first]][live]
        self.who, self.pos = self.key // wide, self.key % wide
        self.stored = np.bincount(self.who, minlength=many)
        self.positives = np.bincount(self.who[self.score > 0], minlength=many)
        self.start = np.cumsum(self.stored) - self.stored

    def ranks(self, n: int) -> np.ndarray:
        """Rank of every listed score among all n items, unlisted ones being zero."""
        order = np.lexsort((self.pos, -self.score, self.who))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order)) - self.start[self.who[order]] + 1
        return rank + np.where(self.score > 0, 0, n - self.stored[self.who])

    def free(self, need: np.ndarray, n: int, wide: int) -> np.ndarray:
        """Keys of the first ``need`` unlisted positions of each request."""
        need = np.maximum(need, 0)
        place = np.arange(len(self.key)) - self.start[self.who] + 1
        blocked = np.bincount(self.who[self.pos - place < need[self.who]], minlength=len(need))
        upper = np.where(need > 0, np.minimum(n, need + blocked), 0)
        keys = np.repeat(np.arange(len(need)) * wide, upper) + spans(np.ones(len(need), np.int64), upper)
        return keys[~within(keys, self.key)[1]]


def best_of(who: np.ndarray, pos: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, ranks) of the k best of each request: score descending, then position."""
    order = np.lexsort((pos, -score, who))
    grouped = who[order]
    rank = np.arange(len(order)) - np.searchsorted(grouped, grouped) + 1
    return order[rank <= k], rank[rank <= k]


def _rrf(bases: list, parts: list[Scored], seen: np.ndarray, many: int, n: int, wide: int, k: int, constant: float, masked: bool):
    """Keys and fused scores of all that can be among the k best; a base is (positions by rank, rank by position)."""
    views = len(bases) + len(parts)
    count = np.bincount(seen // wide, minlength=many) if masked else np.zeros(many, np.int64)
    depth = np.ceil(views * (constant + k + count) - constant).astype(np.int64)
    keys, extras = [], []
    for first, _ in bases:
        size = np.minimum(depth, n)
        at = spans(np.zeros(many, np.int64), size)
        key = np.repeat(np.arange(many) * wide, size) + first[at]
        keys.append(key)
        extras.append(at[:, None] + 1)
    ranks = [s.ranks(n) for s in parts]
    for scored, rank in zip(parts, ranks):
        near = rank <= depth[scored.who]
        keys.append(scored.key[near])
        extras.append(scored.extra[near])
        key = scored.free(depth - scored.positives, n, wide)
        keys.append(key)
        extras.append(np.stack([place[key % wide - 1] for _, place in bases], axis=1) if bases else np.zeros((len(key), 1)))
    key, at = np.unique(np.concatenate(keys), return_index=True)
    extra = np.concatenate(extras)[at]
    if masked:
        open_ = ~within(key, seen)[1]
        key, extra = key[open_], extra[open_]
    total = (1.0 / (constant + extra)).sum(axis=1) if bases else np.zeros(len(key))
    who = key // wide
    for scored, rank in zip(parts, ranks):
        at, listed = within(key, scored.key)
        ahead = at - scored.start[who]
        mine = scored.positives[who] + key % wide - ahead
        mine[listed] = rank[at[listed]]
        total += 1.0 / (constant + mine)
    return key, snapped(total, 12)


def _moments(count: np.ndarray, mean: np.ndarray, var: np.ndarray, low: np.ndarray, high: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and spread of n scores of which ``count`` are listed and the others zero; equal scores have spread 1."""
    share = count / n
    middle = share * mean
    off = mean - middle
    spread = share * (var + off * off) + (1 - share) * middle * middle
    flat = (low == high) & ((count == n) | (high == 0))
    return middle, np.where(flat, 1.0, np.sqrt(spread))


def _listed_moments(s: Scored, many: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    count = s.stored.astype(float)
    safe = np.maximum(count, 1)
    mean = np.bincount(s.who, s.score, many) / safe
    off = s.score - mean[s.who]
    var = np.bincount(s.who, off * off, many) / safe
    low, high, some = np.zeros(many), np.zeros(many), s.stored > 0
    if some.any():
        low[some], high[some] = np.minimum.reduceat(s.score, s.start[some]), np.maximum.reduceat(s.score, s.start[some])
    return _moments(count, mean, var, low, high, n)


def _weighted(
    base: tuple | None, parts: list[Scored], seen: np.ndarray, many: int, wide: int, n: int, k: int,
    weights: list[float], first: np.ndarray, first_scores: np.ndarray,
):
    """Keys and fused scores of the listed items and of the best others; ``first`` are the best positions outside."""
    slopes, shift = [], np.zeros(many)
    for weight, scored in zip(weights, parts):
        mean, std = _listed_moments(scored, many, n)
        slopes.append(weight / std)
        shift -= weight * mean / std
    steep = 0.0
    if base is not None:
        weight, mean, std = base
        steep = weight / std
        shift -= weight * mean / std
    key, at = np.unique(np.concatenate([s.key for s in parts]), return_index=True)
    extra = np.concatenate([s.extra for s in parts])[at]
    who = key // wide
    part = steep * extra[:, 0] if base is not None else np.zeros(len(key))
    for slope, scored in zip(slopes, parts):
        at, listed = within(key, scored.key)
        part[listed] += slope[who[listed]] * scored.score[at[listed]]
    taken = np.union1d(key, seen)
    found_key, found_part = [key], [part]
    missing, low, size = np.full(many, k), 0, 2 * k
    short = np.arange(many)
    while len(short) and low < len(first):
        high = min(len(first), low + size)
        place = np.tile(np.arange(low, high), len(short))
        own = np.repeat(short, high - low)
        keys = own * wide + first[place]
        free = ~within(keys, taken)[1]
        before = np.cumsum(free.reshape(len(short), -1), axis=1)
        use = free & (before.ravel() <= missing[own])
        found_key.append(keys[use])
        found_part.append(steep * first_scores[place[use]])
        missing[short] -= np.minimum(before[:, -1], missing[short])
        short, low, size = short[missing[short] > 0], high, min(2 * size, 1 << 12)
    key = np.concatenate(found_key)
    score = snapped(np.concatenate(found_part) + shift[key // wide])
    open_ = ~within(key, seen)[1]
    return key[open_], score[open_]


def _whole_requests(batches: Iterator[pa.RecordBatch], each: int) -> Iterator[pa.Table]:
    """Tables of whole requests from batches that are sorted by request; a request stands for ``each`` candidates."""
    held: list[pa.RecordBatch] = []
    size = 0

    def changes(table: pa.Table) -> np.ndarray:
        ids = table["request_id"].combine_chunks()
        other = pc.fill_null(pc.not_equal(ids.slice(1), ids.slice(0, len(ids) - 1)), True)  # null requests hold no rows
        return np.flatnonzero(other.to_numpy(zero_copy_only=False)) + 1

    def work(batch: pa.RecordBatch) -> int:
        asked = pc.sum(pc.equal(batch.column("kind"), REQUEST)).as_py() or 0
        return batch.num_rows + len(batch.column("entries").flatten()) + each * asked

    for batch in batches:
        held.append(batch)
        size += work(batch)
        if size < TOGETHER:
            continue
        table = pa.Table.from_batches(held)
        cuts = changes(table)
        if not len(cuts):
            continue
        last = int(cuts[-1])
        yield table.slice(0, last)
        held = table.slice(last).combine_chunks().to_batches()
        size = sum(work(b) for b in held)
    if held:
        yield pa.Table.from_batches(held)


def _served(find: Callable, views: int, wide: int, k: int, whole: bool, each: int):
    """Batches of rows to batches of (request_id, pos, score, rank)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_requests(batches, each):
            table = table.combine_chunks()
            if not table.num_rows:
                continue
            ids = table["request_id"].combine_chunks()
            ids = ids.dictionary_encode("encode")
            names, who = ids.dictionary, ids.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            kind = table["kind"].to_numpy()
            many = len(names)
            asked = np.zeros(many, bool)
            asked[who[kind == REQUEST]] = True
            own = kind == SEEN
            seen = np.unique(who[own] * wide + table["p"].to_numpy(zero_copy_only=False)[own].astype(np.int64)) if own.any() else np.zeros(0, np.int64)
            entries = table["entries"].combine_chunks()
            lengths = pc.fill_null(pc.list_value_length(entries), 0).to_numpy(zero_copy_only=False)
            flat = entries.flatten()
            row = np.repeat(np.arange(len(who)), lengths)
            at, weight, extra = (c.to_numpy(zero_copy_only=False) for c in flat.flatten())
            value = pc.fill_null(table["value"].combine_chunks(), 0.0).to_numpy(zero_copy_only=False)
            weight = weight / 10.0**SCORE_DIGITS if whole else weight
            parts = []
            for v in range(views):
                mine = kind[row] == LISTED + v
                rows = row[mine]
                parts.append(Scored(who[rows] * wide + at[mine], value[rows] * weight[mine], extra[mine][:, None], many, wide))
            key, score = find(parts, seen, many)
            keep = asked[key // wide]
            key, score = key[keep], score[keep]
            rows, rank = best_of(key // wide, key % wide, score, k)
            key = key[rows]
            yield pa.RecordBatch.from_arrays([
                names.take(pa.array(key // wide)), pa.array(key % wide), pa.array(score[rows]), pa.array(rank.astype(np.int64)),
            ], ["request_id", "pos", "score", "rank"])

    return run


# --------------------------------------------------------------------------- tables around the tasks


def _base_of(views: list) -> tuple:
    return next(((i, v) for i, v in enumerate(views) if v.base is not None), (None, None))


def applies(views: list, batch) -> bool:
    """At least one listed view, at most one ranking shared by all requests, nothing else; no hot requests."""
    plain = all(v.listed is not None or (v.base is not None and v.base_requests is None and v.nonzero is None and v.vectors is None and v.factored is None) for v in views)
    listed = sum(v.listed is not None for v in views)
    return batch.hot is None and plain and listed >= 1 and len(views) - listed <= 1


def _collected(df: DataFrame, by: str, names: list[str]) -> list[np.ndarray]:
    frame = df.select(by, *names).toPandas().sort_values(by, ignore_index=True)
    return [frame[n].to_numpy() for n in names]


def _dealt(views: list, batch, space, seen: DataFrame | None, place: DataFrame, each: int) -> tuple | None:
    """(rows by request, whether weights are whole numbers, most listed and most seen items of a request).

    None where an item has no place, or where one request holds more than a task should.
    """
    spark = batch.requests.sparkSession
    small = "int" if space.n < 1 << 31 else "bigint"
    spot = place.select("item_id", F.col("p").cast(small).alias("p"), "extra")
    listed = [v.listed for v in views if v.listed is not None]
    edges, facts = [], []
    for _, similarity, _ in listed:
        found = similarity.join(spot.withColumnRenamed("item_id", "other"), "other")
        edges.append(found)
        facts.append((similarity.count(), *found.agg(
            F.count(F.lit(1)), F.coalesce(F.bool_and(exact(F.col("weight"))), F.lit(True)), F.count_distinct("item")
        ).first()))
    if any(f[0] != f[1] for f in facts):
        return None
    whole = all(f[2] for f in facts)
    weight = F.rint(F.col("weight") * F.lit(10.0**SCORE_DIGITS)).cast("int") if whole else F.col("weight")
    lists = [
        e.groupBy("item").agg(F.collect_list(F.struct("p", weight.alias("weight"), "extra")).alias("entries")) for e in edges
    ]
    used = [vector.where((F.col("value") != 0) & F.col("request_id").isNotNull()) for vector, _, _ in listed]
    most, products = 0, 0.0
    for u, one, (_, rows, _, items) in zip(used, lists, facts):
        total, largest = u.groupBy("request_id").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n"), F.max("n")).first()
        longest = one.agg(F.max(F.size("entries"))).first()[0] or 0
        most += (largest or 0) * longest
        products += (total or 0) * rows / max(items, 1)
    if most > MOST:
        return None
    nothing = [F.lit(None).cast(small).alias("p"), F.lit(None).cast("double").alias("value")]
    kind = lists[0].schema["entries"].dataType
    empty = F.array().cast(kind).alias("entries")  # null lists are slow to hand over
    rows = [batch.requests.select("request_id", F.lit(REQUEST).alias("kind"), *nothing, empty)]
    masked = 0
    if seen is not None:
        hidden = seen.where(F.col("request_id").isNotNull())
        masked = hidden.groupBy("request_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        if masked > MOST:
            return None
        rows.append(hidden.join(spot.select("item_id", "p"), "item_id").select(
            "request_id", F.lit(SEEN).alias("kind"), "p", nothing[1], empty
        ))
    for v, (u, one) in enumerate(zip(used, lists)):
        rows.append(u.join(one.withColumnRenamed("item", "item_id"), "item_id").select(
            "request_id", F.lit(LISTED + v).alias("kind"), nothing[0], "value", "entries"
        ))
    every = plain_ids(reduce(DataFrame.unionByName, rows), "request_id")
    parts = sum_tasks(spark, products + float(each) * batch.requests.count())
    return every.repartition(parts, "request_id").sortWithinPartitions("request_id"), whole, most, masked


def _answered(rows: DataFrame, run: Callable, batch, space) -> DataFrame:
    ids = {"request_id": batch.requests.schema["request_id"].dataType}
    kind = rows.schema["request_id"].dataType.simpleString()
    found = rows.mapInArrow(run, f"request_id {kind}, pos bigint, score double, rank bigint")
    return restore_ids(found, ids).join(space.items, "pos").select("request_id", "item_id", "score", "rank")


def rrf_lists(views: list, batch, space, k: int, seen: DataFrame | None, constant: float) -> DataFrame | None:
    """:func:`kindred.operators.fusion.rrf_topk` of such views; None where the general way has to be taken."""
    _, base = _base_of(views)
    extra = F.lit(0).cast("int") if base is None else F.col("b")
    place = space.items.select("item_id", F.col("pos").alias("p"))
    if base is not None:
        small = "int" if space.n < 1 << 31 else "bigint"
        place = place.join(base.base.select("item_id", F.col("pos").cast(small).alias("b")), "item_id")
    place = pin(place.withColumn("extra", extra))
    if place.count() != space.n:
        return None
    each = ceil(2 * (len(views) * (constant + k) - constant))
    dealt = _dealt(views, batch, space, seen, place, each)
    if dealt is None:
        return None
    rows, whole, most, masked = dealt
    deepest = ceil(len(views) * (constant + k + masked) - constant)
    if deepest + most > FIRST:
        return None
    wide = space.n + 1
    bases = []
    if base is not None:
        (first,) = _collected(place.where(F.col("b") <= deepest), "b", ["p"])
        (ranks,) = _collected(place.where(F.col("p") <= deepest + most), "p", ["b"])
        bases = [(first.astype(np.int64), ranks.astype(np.int64))]
    n, parts, hides = space.n, len(views) - len(bases), seen is not None

    def find(scored: list[Scored], hidden: np.ndarray, many: int):
        return _rrf(bases, scored, hidden, many, n, wide, k, constant, hides)

    return _answered(rows, _served(find, parts, wide, k, whole, each), batch, space)


def weighted_lists(
    views: list, batch, space, k: int, seen: DataFrame | None, weights: dict[str, float], order: Callable[[], DataFrame], moments: Callable
) -> DataFrame | None:
    """:func:`kindred.operators.fusion.weighted_topk` of such views; ``order`` gives (item_id, pos), the best first
    of what no view lists, and ``moments`` count, mean, variance, least and greatest score of a shared ranking."""
    _, base = _base_of(views)
    place = space.items.select("item_id", F.col("pos").alias("p"))
    if base is None:
        place = place.withColumn("extra", F.lit(0.0))
    else:
        place = place.join(base.base.select("item_id", F.col("score").alias("extra")), "item_id")
    place = pin(place)
    if place.count() != space.n:
        return None
    dealt = _dealt(views, batch, space, seen, place, 8 * k)
    if dealt is None:
        return None
    rows, whole, most, masked = dealt
    if k + most + masked > FIRST:
        return None
    first, scores = _collected(order().where(F.col("pos") <= k + most + masked).join(place, "item_id"), "pos", ["p", "extra"])
    first, scores = first.astype(np.int64), scores.astype(float)
    n, wide = space.n, space.n + 1
    steep = None
    if base is not None:
        found = [np.array([float(x or 0.0)]) for x in moments(base)]
        mean, std = _moments(*found, n)
        steep = (weights.get(base.name, 1.0), float(mean[0]), float(std[0]))
    own = [float(weights.get(v.name, 1.0)) for v in views if v.listed is not None]

    def find(scored: list[Scored], hidden: np.ndarray, many: int):
        return _weighted(steep, scored, hidden, many, wide, n, k, own, first, scores)

    return _answered(rows, _served(find, len(own), wide, k, whole, 8 * k), batch, space)
