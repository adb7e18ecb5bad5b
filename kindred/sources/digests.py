"""Content digests: canonical JSON for settings, order-free row hashes for tables."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def _spelled(value: Any) -> Any:
    """What JSON has no form for: records, sets and numpy scalars; anything else is an error."""
    if dataclasses.is_dataclass(value) and not isinstance(value, type):
        return dataclasses.asdict(value)
    if isinstance(value, (set, frozenset)):
        return sorted(value, key=canonical_json)
    if callable(getattr(value, "tolist", None)):
        return value.tolist()
    raise TypeError(f"settings cannot hold a {type(value).__name__}")


def canonical_json(value: Any) -> str:
    """One spelling per value: sorted keys, no spaces; NaN and infinities are errors."""
    return json.dumps(
        value, default=_spelled, allow_nan=False, ensure_ascii=False, separators=(",", ":"), sort_keys=True
    )


def plain(value: Any) -> Any:
    """The value as JSON gives it back."""
    return json.loads(canonical_json(value))


def value_digest(value: Any) -> str:
    return "sha256:" + hashlib.sha256(canonical_json(value).encode()).hexdigest()


def digest_token(digest: str) -> str:
    """The hexadecimal part, usable as a folder name."""
    found = re.fullmatch("sha256:([0-9a-f]{64})", digest)
    if found is None:
        raise ValueError(f"not a digest of this library: {digest!r}")
    return found[1]


def digest_aggregates(df: DataFrame) -> list[Column]:
    """Sums over a table's rows that its digest is made of; free of row order."""
    # The hash passes over nulls, so their places are hashed too.
    marked = [c for name in sorted(df.columns) for c in (F.col(f"`{name}`").isNull(), F.col(f"`{name}`"))]
    one, two = F.xxhash64(*marked), F.xxhash64(F.lit("second"), *marked)
    return [
        F.count(F.lit(1)).alias("rows"), F.bit_xor(one).alias("mixed"), F.sum(two.cast("decimal(38,0)")).alias("total"),
    ]


def digest_of(df: DataFrame, row: dict[str, Any]) -> str:
    columns = sorted(df.columns)
    types = [df.schema[c].dataType.simpleString() for c in columns]
    return value_digest([columns, types, row["rows"], row["mixed"], str(row["total"])])


def table_digest(df: DataFrame) -> str:
    """Digest of a table as a bag of rows, in one distributed pass."""
    return digest_of(df, df.agg(*digest_aggregates(df)).first().asDict())


def digest_while(df: DataFrame, write: Callable[[DataFrame], None]) -> tuple[str, int]:
    """(digest, rows) of a table, taken on the way while ``write`` writes it."""
    seen = Observation()
    write(df.observe(seen, *digest_aggregates(df)))
    row = seen.get
    return digest_of(df, row), int(row["rows"])
