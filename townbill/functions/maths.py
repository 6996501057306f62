"""Small numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den, and 0 when the denominator is 0 or the input was empty."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def half_up(c: Column) -> Column:
    """Round half towards positive infinity."""
    return F.floor(c + F.lit(0.5))


def call_cost(calls: Column, per_call: str) -> Column:
    return F.round(calls.cast("decimal(20,0)") * F.lit(per_call).cast("decimal(10,6)"), 4).cast("decimal(10,4)")


def percent_text(share: Column) -> Column:
    return F.format_string("%.0f", share * 100)
