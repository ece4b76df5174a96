"""Numeric helpers shared by every operator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_to(value: Column, digits: int) -> Column:
    """Round half up through ``floor``, the same in any SQL engine; null stays null."""
    scale = float(10**digits)
    return F.floor(value * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def finite(value: Column) -> Column:
    """NaN and infinities become null, so that comparisons are three-valued."""
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def pct_change(now: Column, base: Column) -> Column:
    """Percent change; null for a missing or zero base."""
    return (F.try_divide(now, base) - 1) * 100


def pct_from(now: Column, base: Column) -> Column:
    """Percent change as difference over base; null for a missing or zero base."""
    return F.try_divide(now - base, base) * 100
