"""Deterministic train / validation / test splits and the rating tables made from them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass, field
from functools import cached_property
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions.numbers import holdout_counts
from kindred.functions.text import seeded_key
from kindred.operators.contract import ContractError, item_catalog
from kindred.operators.positions import HOT_ROWS, group_positions, hot_groups
from kindred.session import pin, release

STRATEGIES = ("user_holdout", "temporal")


@dataclass(frozen=True)
class Split:
    strategy: str = "user_holdout"
    validation_ratio: float = 0.1
    test_ratio: float = 0.2
    seed: int = 42

    def check(self) -> None:
        if not (0 <= self.validation_ratio < 1 and 0 <= self.test_ratio < 1):
            raise ContractError("split ratios must be in [0, 1)")
        if self.validation_ratio + self.test_ratio >= 1:
            raise ContractError("validation_ratio + test_ratio must be less than one")
        if self.strategy not in STRATEGIES:
            raise ContractError(f"unsupported split strategy: {self.strategy}")


@dataclass
class Prepared:
    """Split interaction data and the tables derived from it."""

    events: DataFrame
    order: tuple[str, ...]
    split: Split
    catalog: DataFrame
    hot_users: DataFrame | None = None
    adapter: str = "tabular"
    digest: str | None = None
    _ratings: dict[str, DataFrame] = field(default_factory=dict, repr=False)

    def part(self, split: str) -> DataFrame:
        return self.events.where(F.col("split") == split)

    def ratings(self, split: str) -> DataFrame:
        """Summed values per (user, item), written once per split and then shared."""
        if split not in self._ratings:
            events = self.part(split)
            # Rows of a user lie together in the written files, so counts by user merge before they travel.
            self._ratings[split] = pin(ratings(events if self.hot_users is not None else events.repartition("user_id")))
        return self._ratings[split]

    @cached_property
    def users(self) -> DataFrame:
        return self.events.select("user_id").distinct()

    @cached_property
    def items(self) -> DataFrame:
        return self.events.select("item_id").distinct()

    @cached_property
    def indexed_items(self) -> DataFrame:
        """(item_id, pos): 1-based position in id order."""
        return pin(dense_index(self.items, "item_id"))

    @cached_property
    def n_items(self) -> int:
        return self.items.count()

    @cached_property
    def n_users(self) -> int:
        return self.users.count()

    @property
    def settings(self) -> dict[str, Any]:
        return {"adapter": self.adapter, "order": list(self.order), "split": asdict(self.split)}


def dense_index(df: DataFrame, column: str, out: str = "pos") -> DataFrame:
    """1-based position of every distinct value in sorted order."""
    distinct = df.select(column).distinct()
    return group_positions(distinct, [], [F.col(column)], out)


def holdout_table(events: DataFrame, split: Split) -> DataFrame:
    """(user_id, n, n_validation, n_test): pre-aggregated counts, one row per user."""
    split.check()
    n = events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    v, t = holdout_counts(F.col("n"), split.validation_ratio, split.test_ratio)
    return n.select("user_id", "n", v.alias("n_validation"), t.alias("n_test"))


def split_events(
    events: DataFrame,
    order: Sequence[str],
    split: Split = Split(),
    hot: DataFrame | None | str = "detect",
    hot_rows: int = HOT_ROWS,
    check_times: bool = True,
) -> DataFrame:
    """Add ``split``: per user the last rows are test, those before them validation.

    Temporal order is (timestamp, row order); user_holdout order is a seeded hash.
    """
    split.check()
    row = [F.col(c) for c in order]
    if split.strategy == "temporal":
        if "timestamp" not in events.columns:
            raise ContractError("temporal split requires a timestamp for every interaction")
        if check_times and not events.where(F.col("timestamp").isNull()).isEmpty():
            raise ContractError("temporal split requires a timestamp for every interaction")
        keys = [F.col("timestamp"), *row]
    else:
        keys = [seeded_key(split.seed, F.col("user_id"), *row), *row]
    if isinstance(hot, str):
        hot = hot_groups(events, ["user_id"], hot_rows)
    placed = group_positions(events, ["user_id"], keys, "_pos", hot=hot, hot_rows=hot_rows)
    if hot is None:
        # Same partitioning as the position window, so the count needs no further shuffle.
        counted = placed.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("user_id")))
    else:
        counted = placed.join(
            events.groupBy("user_id").agg(F.count(F.lit(1)).alias("_n")), "user_id"
        )
    v, t = holdout_counts(F.col("_n"), split.validation_ratio, split.test_ratio)
    after = F.col("_n") - F.col("_pos")
    label = F.when(after < t, "test").when(after < t + v, "validation").otherwise("train")
    return counted.withColumn("split", label).select(*events.columns, "split")


def split_integrity(split: DataFrame, events: DataFrame, order: Sequence[str]) -> DataFrame:
    """Counts of rows missing from, foreign to, or repeated in the split table."""
    key = F.struct(*order).alias("_key")  # a struct also equals where it holds nulls
    split, events = split.select(key), events.select(key)
    lost = events.join(split, "_key", "left_anti").agg(F.count(F.lit(1)).alias("missing_rows"))
    foreign = split.join(events, "_key", "left_anti").agg(F.count(F.lit(1)).alias("foreign_rows"))
    repeated = (
        split.groupBy("_key")
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(F.count_if(F.col("n") > 1).alias("repeated_rows"))
    )
    one = F.lit(1).alias("_one")
    return (
        lost.select("*", one)
        .join(foreign.select("*", one), "_one")
        .join(repeated.select("*", one), "_one")
        .drop("_one")
    )


def ratings(events: DataFrame) -> DataFrame:
    """(user_id, item_id, value): repeated events of a pair add up."""
    return events.groupBy("user_id", "item_id").agg(F.sum("value").alias("value"))


def _ties(events: DataFrame, order: Sequence[str], rows: int) -> int:
    """Rows that ``order`` does not tell apart; whole keys travel only where their hashes repeat."""
    hashes = events.select(F.xxhash64(*order).alias("_hash")).repartition("_hash")
    if hashes.distinct().count() == rows:
        return 0
    return rows - events.agg(F.count_distinct(F.struct(*order))).first()[0]


def prepare(
    events: DataFrame,
    order: Sequence[str],
    split: Split = Split(),
    adapter: str = "tabular",
    catalog: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
) -> Prepared:
    """Split normalized events; the labelled events and the catalog are written once.

    The given rows are written once before they are checked and split, so joins behind them run once.
    Checks: ``order`` tells all rows apart (ties would make the split and the last catalog record a
    matter of chance) and, for a temporal split, every row has a time.
    """
    split.check()
    timed = split.strategy == "temporal" and "timestamp" in events.columns
    given = pin(events)
    rows, untimed = given.agg(
        F.count(F.lit(1)), F.count_if(F.col("timestamp").isNull()) if timed else F.lit(0)
    ).first()
    if untimed:
        release(given)
        raise ContractError("temporal split requires a timestamp for every interaction")
    ties = _ties(given, order, rows)
    if ties:
        release(given)
        raise ContractError(f"{', '.join(order)} must tell all rows apart ({ties} ties)")
    hot = hot_groups(given, ["user_id"], hot_rows)
    labelled = pin(split_events(given, order, split, hot=hot, hot_rows=hot_rows, check_times=False))
    release(given)
    return Prepared(
        events=labelled,
        order=tuple(order),
        split=split,
        catalog=pin(item_catalog(labelled, order)) if catalog is None else catalog,
        hot_users=hot,
        adapter=adapter,
    )


def profile(events: DataFrame) -> DataFrame:
    """Users, items and events of a table, in one pass."""
    return events.agg(
        F.count_distinct("user_id").alias("users"),
        F.count_distinct("item_id").alias("items"),
        F.count(F.lit(1)).alias("events"),
    )
