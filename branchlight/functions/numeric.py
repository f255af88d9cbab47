"""Number helpers that stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(value: Column, digits: int = 0) -> Column:
    """Round a double half to even by scaling first, which is how data frames in Python round."""
    if digits == 0:
        return F.rint(value)
    scale = float(10 ** digits)
    return F.rint(value * F.lit(scale)) / F.lit(scale)


def ratio(top: Column, bottom: Column, default: float | None = None) -> Column:
    """Division that yields ``default`` (NULL when not given) for a zero or missing divisor."""
    out = F.try_divide(top.cast("double"), bottom.cast("double"))
    return out if default is None else F.coalesce(out, F.lit(float(default)))


def money(value: Column) -> Column:
    """A decimal sum as a two-digit double."""
    return F.round(value, 2).cast("double")


def number_or_zero(value: Column, kind: str = "double") -> Column:
    return F.coalesce(value.try_cast(kind), F.lit(0).cast(kind))


def whole_text(value: Column) -> Column:
    """A double shown without decimals, rounded half to even."""
    return F.rint(value).cast("bigint").cast("string")


def clip(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(value, F.lit(float(high))), F.lit(float(low)))
