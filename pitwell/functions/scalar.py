"""Column functions used across the operators. NaN is mapped to NULL where data enters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INFINITY = float("inf")


def clean(x: Column) -> Column:
    """NaN to NULL."""
    return F.when(~F.isnan(x), x)


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(INFINITY))


def ratio(x: Column, y: Column) -> Column:
    """x / y; NULL for y = 0 or a result that isn't finite."""
    q = F.try_divide(x, y)
    return F.when(F.abs(q) < F.lit(INFINITY), q)


def end_of_day(day: Column) -> Column:
    """The last microsecond of a day, UTC."""
    return (F.date_add(day, 1).cast("timestamp") - F.expr("INTERVAL 1 MICROSECOND")).cast("timestamp")


def normal_ticker(x: Column) -> Column:
    return F.upper(F.trim(x))


def padded_cik(x: Column) -> Column:
    return F.lpad(x.cast("string"), 10, "0")


def collapsed(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def ticker_set(x: Column) -> Column:
    """Sorted distinct tickers of a comma list."""
    return F.array_sort(F.array_distinct(F.transform(F.split(F.upper(x), ","), lambda s: F.trim(s))))


def content_id(*parts: Column) -> Column:
    """Deterministic identity of some values."""
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts)), 256)
