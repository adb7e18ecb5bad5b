"""Numeric helpers whose rounding rules matter for results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCORE_DIGITS = 9
DUST = 1e-12


def quantize(value: Column, digits: int = SCORE_DIGITS) -> Column:
    """Snap a sum to a decimal grid so that partial-sum order cannot flip a tie.

    A value too small for the grid keeps six digits of its own instead of becoming zero, down to
    the dust that cancelling terms leave.
    """
    scale = F.lit(float(10**digits))
    snapped = F.rint(value * scale) / scale
    fine = F.pow(F.lit(10.0), F.lit(6.0) - F.floor(F.log10(F.abs(value))))
    tiny = (snapped == 0) & (F.abs(value) > F.lit(DUST))
    return F.when(tiny, F.rint(value * fine) / fine).otherwise(snapped)


def is_finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))


def finite_or_null(value: Column) -> Column:
    return F.when(is_finite(value), value)


def clean_metadata(df: DataFrame) -> DataFrame:
    """Replace NaN and infinities by null in every floating column."""
    floats = {
        f.name: finite_or_null(F.col(f.name)).alias(f.name)
        for f in df.schema.fields
        if isinstance(f.dataType, (T.FloatType, T.DoubleType))
    }
    return df.select(*[floats.get(c, F.col(c)) for c in df.columns])


def holdout_counts(n: Column, validation_ratio: float, test_ratio: float) -> tuple[Column, Column]:
    """Validation and test rows of a user with ``n`` events.

    Under three events nothing is held out. Otherwise each positive ratio takes
    max(1, half-even round(n * ratio)); while both together leave no training row, the larger
    count shrinks by one, validation first on ties. The excess over n - 1 is known up front, so
    the shrinking is closed form: level the larger count first, then alternate.
    """

    def raw(ratio: float) -> Column:
        if ratio <= 0:
            return F.lit(0).cast("bigint")
        return F.greatest(F.lit(1), F.rint(n * F.lit(float(ratio)))).cast("bigint")

    v, t = raw(validation_ratio), raw(test_ratio)
    excess = F.greatest(v + t - n + 1, F.lit(0))
    gap = F.abs(v - t)
    level = F.least(excess, gap)
    rest = excess - level
    from_v = F.when(v > t, level).otherwise(0) + F.ceil(rest / 2).cast("bigint")
    from_t = F.when(t > v, level).otherwise(0) + F.floor(rest / 2).cast("bigint")
    small = n < 3
    zero = F.lit(0).cast("bigint")
    return F.when(small, zero).otherwise(v - from_v), F.when(small, zero).otherwise(t - from_t)
