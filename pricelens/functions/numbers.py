"""Scalar rules for prices and times, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percentile_won(price: Column, p: float) -> Column:
    """Exact percentile with linear interpolation, halves rounded up."""
    return F.round(F.percentile(price, F.lit(p))).cast("long")


def gap(current: Column, reference: Column) -> tuple[Column, Column]:
    """Won and percent (one decimal, halves away from zero) by which current exceeds reference; null if either is."""
    won = current - reference
    return won, F.round(F.try_divide(won.cast("decimal(20,0)") * 100, reference.cast("decimal(20,0)")), 1).cast("decimal(12,1)")


def used_percent(benchmark: Column, price: Column) -> Column:
    """Percent below the benchmark, floor(x + 0.5); null without a positive benchmark."""
    return F.when(benchmark > 0, F.floor((benchmark - price) * 100.0 / benchmark + 0.5))


def in_quiet_hours(hour: Column, start: Column, end: Column) -> Column:
    """[start, end) round midnight; none where a bound is null or both are equal."""
    inside = F.when(start < end, (hour >= start) & (hour < end)).otherwise((hour >= start) | (hour < end))
    return F.coalesce((start != end) & inside, F.lit(False))


def months_before(ts: Column, months: Column | int) -> Column:
    """Keeps the time of day and clamps the day."""
    return ts - F.make_ym_interval(F.lit(0), months if isinstance(months, Column) else F.lit(months))
