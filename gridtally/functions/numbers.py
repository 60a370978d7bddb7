"""Numeric coercion and sums that do not depend on the order of partial results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


# Plain decimal and exponent forms, or an infinity. try_cast alone would also read Java's own forms
# ('1.5d', '0x1p3') and 'nan'.
_NUMBER = r"^[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|(?i:inf|infinity))$"


def to_number(text: Column) -> Column:
    """Double value of a trimmed text, or null. The text is evaluated once."""
    return F.regexp_extract(text, _NUMBER, 0).try_cast("double")


def as_number(value: Column, kind: T.DataType) -> Column:
    """Numeric view of a column of any type, null where it holds no number."""
    if isinstance(kind, T.StringType):
        return to_number(value)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(value), value).cast("double")
    if isinstance(kind, T.NumericType):
        return value.cast("double")
    if isinstance(kind, T.BooleanType):
        return value.cast("int").cast("double")
    return F.lit(None).cast("double")


def total(value: Column, scale: int | None = None) -> Column:
    """Sum of a measure, 0.0 when every value is null.

    With a scale the values are added as decimals, which is exact for money and makes the
    result independent of partitioning. The caller states the scale; without one the values
    are added as doubles, so nothing is rounded.
    """
    if scale is None:
        return F.coalesce(F.sum(value), F.lit(0.0))
    return F.coalesce(F.sum(value.cast(T.DecimalType(18, scale))).cast("double"), F.lit(0.0))


def mean(value: Column, scale: int | None = None) -> Column:
    """Mean of the non-null values, 0.0 when there is none."""
    if scale is None:
        return F.coalesce(F.avg(value), F.lit(0.0))
    return F.coalesce(total(value, scale) / F.nullif(F.count(value), F.lit(0)), F.lit(0.0))


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole as a double, 0.0 for an empty whole."""
    return F.when(whole > 0, part / whole * F.lit(100.0)).otherwise(F.lit(0.0))
