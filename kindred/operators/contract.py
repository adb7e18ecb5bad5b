"""Interaction contract: required columns, renames, identifier / value / time validation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.functions.ids import canonical_identifier, is_identifier_type, is_invalid_identifier
from kindred.functions.numbers import is_finite
from kindred.functions.text import document
from kindred.functions.times import to_utc


class ContractError(ValueError):
    """The table breaks the interaction contract."""


@dataclass(frozen=True)
class Columns:
    user_id: str = "user_id"
    item_id: str = "item_id"
    value: str | None = None
    timestamp: str | None = None


def rename_plan(present: Sequence[str], columns: Columns) -> dict[str, str]:
    """Source to canonical names; raises on missing, overlapping or shadowed columns."""
    missing = sorted({columns.user_id, columns.item_id} - set(present))
    if missing:
        raise ContractError(f"interaction table is missing columns: {missing}")
    pairs = [(columns.user_id, "user_id"), (columns.item_id, "item_id")]
    for source, target in ((columns.value, "value"), (columns.timestamp, "timestamp")):
        if source is not None and source in present:
            pairs.append((source, target))
    plan = dict(pairs)
    if len(plan) != len(pairs):
        raise ContractError("two canonical columns are mapped to the same source column")
    shadowed = [t for s, t in pairs if s != t and t in present and t not in plan]
    if shadowed:
        raise ContractError(f"mapping would duplicate canonical columns: {sorted(shadowed)}")
    return plan


def _mapped(df: DataFrame, columns: Columns) -> DataFrame:
    renamed = df.withColumnsRenamed(rename_plan(df.columns, columns))
    for name in ("user_id", "item_id"):
        dtype = renamed.schema[name].dataType
        if not is_identifier_type(dtype):
            raise ContractError(f"{name} must be a string or an integer, not {dtype.simpleString()}")
    return renamed


def _value(df: DataFrame) -> Column:
    if "value" not in df.columns:
        return F.lit(1.0)
    return F.expr("try_cast(value AS double)")


def violations(df: DataFrame, columns: Columns = Columns()) -> DataFrame:
    """One row of violation counts, from one pass over the table."""
    raw = _mapped(df, columns)

    def bad_id(name: str) -> Column:
        return is_invalid_identifier(name, raw.schema[name].dataType)

    checks = {
        "bad_user_id": bad_id("user_id"),
        "bad_item_id": bad_id("item_id"),
        "bad_value": ~is_finite(_value(raw)),
    }
    if "timestamp" in raw.columns:
        parsed = to_utc("timestamp", raw.schema["timestamp"].dataType)
        checks["bad_timestamp"] = F.col("timestamp").isNotNull() & parsed.isNull()
    else:
        checks["bad_timestamp"] = F.lit(False)
    return raw.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(c).alias(n) for n, c in checks.items()],
    )


def normalize(df: DataFrame, columns: Columns = Columns(), validate: bool = True) -> DataFrame:
    """Canonical interaction table; extra columns pass through.

    ``validate`` runs one aggregate job and raises on the first kind of violation found.
    """
    raw = _mapped(df, columns)
    if validate:
        found = violations(df, columns).first()
        if found["rows"] == 0:
            raise ContractError("interaction table must contain at least one row")
        messages = {
            "bad_user_id": "user_id must be a non-empty string or an integer",
            "bad_item_id": "item_id must be a non-empty string or an integer",
            "bad_value": "interaction values must be finite numbers",
            "bad_timestamp": "interaction timestamps must be valid",
        }
        for name, message in messages.items():
            if found[name]:
                raise ContractError(f"{message} ({found[name]} rows)")
    changes = {n: canonical_identifier(n, raw.schema[n].dataType) for n in ("user_id", "item_id")}
    changes["value"] = _value(raw)
    if "timestamp" in raw.columns:
        changes["timestamp"] = to_utc("timestamp", raw.schema["timestamp"].dataType)
    return raw.withColumns(changes)


def item_catalog(events: DataFrame, order: Sequence[str]) -> DataFrame:
    """One metadata record per item, taken from its last row; only the id without metadata."""
    excluded = {"user_id", "item_id", "value", "timestamp", "split", *order}
    metadata = [c for c in events.columns if c not in excluded]
    if not metadata:
        return events.select("item_id").distinct()
    last = F.max_by(F.struct(*metadata), F.struct(*order)).alias("_last")
    return events.groupBy("item_id").agg(last).select("item_id", "_last.*")


def catalog_documents(catalog: DataFrame) -> DataFrame:
    """(item_id, doc): all metadata values of an item as one text; nested ones as JSON."""
    nested = {
        c: F.to_json(c) for c in catalog.columns
        if c != "item_id" and isinstance(catalog.schema[c].dataType, (T.StructType, T.ArrayType, T.MapType))
    }
    columns = [c for c in catalog.columns if c != "item_id"]
    return catalog.withColumns(nested).select("item_id", document(columns, F.col("item_id")).alias("doc"))
