"""Text helpers: documents from metadata, tokens, hashed token features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN_PATTERN = r"[\p{L}\p{N}_-]+"


def document(columns: list[str], identifier: Column) -> Column:
    """Space-join of the non-null metadata values; the identifier when nothing is left."""
    if not columns:
        return identifier.cast("string")
    joined = F.concat_ws(" ", *[F.col(c).cast("string") for c in columns])
    return F.coalesce(F.nullif(joined, F.lit("")), identifier.cast("string"))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0))


def hash_column(token: Column, dimension: int) -> Column:
    """First four SHA-256 bytes, big endian, modulo the dimension."""
    head = F.conv(F.substring(F.sha2(token, 256), 1, 8), 16, 10).cast("bigint")
    return F.pmod(head, F.lit(dimension)).cast("bigint")


def hash_sign(token: Column) -> Column:
    """+1 when the lowest bit of the fifth SHA-256 byte is set, else -1."""
    fifth = F.conv(F.substring(F.sha2(token, 256), 9, 2), 16, 10).cast("bigint")
    return F.when(fifth.bitwiseAND(F.lit(1)) == 1, F.lit(1.0)).otherwise(F.lit(-1.0))


def seeded_key(seed: int, *parts: Column) -> Column:
    """Hex key that is uniform, reproducible and independent of partitioning."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]), 256)


def seeded_unit(seed: int, *parts: Column) -> Column:
    """Uniform double in (0, 1) from the seeded key."""
    head = F.conv(F.substring(seeded_key(seed, *parts), 1, 12), 16, 10).cast("double")
    return (head + F.lit(0.5)) / F.lit(float(2**48))
