"""Identifiers: integers or non-empty strings, never mixed silently."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)

# A column that mixes integers and strings travels as this struct; Spark's struct order
# (kind, i, s) sorts integers before strings.
MIXED_ID = T.StructType(
    [
        T.StructField("kind", T.IntegerType(), False),
        T.StructField("i", T.LongType()),
        T.StructField("s", T.StringType()),
    ]
)


def mixed_id(integer: Column | None = None, string: Column | None = None) -> Column:
    """Build a mixed identifier from an integer column, a string column, or both."""
    i = F.lit(None).cast("bigint") if integer is None else integer.cast("bigint")
    s = F.lit(None).cast("string") if string is None else string
    kind = F.when(i.isNotNull(), F.lit(0)).otherwise(F.lit(1))
    return F.struct(kind.alias("kind"), i.alias("i"), F.when(i.isNull(), s).alias("s"))


def is_identifier_type(dtype: T.DataType) -> bool:
    return isinstance(dtype, (*INTEGERS, T.StringType)) or dtype == MIXED_ID or (
        isinstance(dtype, T.StructType) and dtype.fieldNames() == ["kind", "i", "s"]
    )


def is_invalid_identifier(name: str, dtype: T.DataType) -> Column:
    """True for null and for empty strings; other wrong types are schema errors."""
    c = F.col(name)
    if isinstance(dtype, T.StringType):
        return c.isNull() | (c == "")
    if isinstance(dtype, T.StructType):
        return c.isNull() | (
            F.col(f"{name}.i").isNull() & (F.coalesce(F.col(f"{name}.s"), F.lit("")) == "")
        )
    return c.isNull()


def canonical_identifier(name: str, dtype: T.DataType) -> Column:
    return F.col(name).cast("bigint") if isinstance(dtype, INTEGERS) else F.col(name)


def encode_identifier(df: DataFrame, name: str) -> Column:
    """Typed JSON form: {"type":"integer","value":4} or {"type":"string","value":"a"}."""
    dtype = df.schema[name].dataType

    def as_json(kind: str, value: Column) -> Column:
        return F.to_json(F.struct(F.lit(kind).alias("type"), value.alias("value")))

    if isinstance(dtype, T.StructType):
        return F.when(
            F.col(f"{name}.kind") == 0, as_json("integer", F.col(f"{name}.i"))
        ).otherwise(as_json("string", F.col(f"{name}.s")))
    kind = "string" if isinstance(dtype, T.StringType) else "integer"
    return as_json(kind, F.col(name))


def decode_identifier(encoded: Column) -> Column:
    """Mixed identifier from the typed JSON form; null when the form is invalid."""
    kind = F.get_json_object(encoded, "$.type")
    raw = F.get_json_object(encoded, "$.value")
    integer = F.when(kind == "integer", F.try_to_number(raw, F.lit("S9999999999999999999")))
    integer = integer.cast("bigint")
    string = F.when((kind == "string") & (raw != ""), raw)
    return F.when(integer.isNotNull() | string.isNotNull(), mixed_id(integer, string))


def identifier_text(name: str, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.StructType):
        return F.coalesce(F.col(f"{name}.i").cast("string"), F.col(f"{name}.s"))
    return F.col(name).cast("string")


# Python workers compare plain values, so mixed identifiers visit them as strings of equal order.
_SHIFT = 2**63


def plain_ids(df: DataFrame, *names: str) -> DataFrame:
    """Replace mixed identifiers by strings that sort the same way; other types stay."""
    mixed = [n for n in names if isinstance(df.schema[n].dataType, T.StructType)]
    shift = F.lit(str(_SHIFT)).cast("decimal(20,0)")
    for n in mixed:
        number = (F.col(f"{n}.i").cast("decimal(20,0)") + shift).cast("decimal(20,0)")
        digits = F.lpad(number.cast("string"), 20, "0")
        key = F.when(F.col(f"{n}.kind") == 0, F.concat(F.lit("0"), digits)).otherwise(
            F.concat(F.lit("1"), F.col(f"{n}.s"))
        )
        df = df.withColumn(n, key)
    return df


def restore_ids(df: DataFrame, dtypes: dict[str, T.DataType]) -> DataFrame:
    """Undo :func:`plain_ids` for the columns whose original type was mixed."""
    shift = F.lit(str(_SHIFT)).cast("decimal(20,0)")
    for n, dtype in dtypes.items():
        if isinstance(dtype, T.StructType):
            rest = F.substring(F.col(n), 2, 1_000_000_000)
            is_int = F.substring(F.col(n), 1, 1) == "0"
            number = F.when(is_int, (rest.cast("decimal(20,0)") - shift).cast("bigint"))
            df = df.withColumn(n, mixed_id(number, F.when(~is_int, rest)))
    return df
