"""Row windows with minimum counts, ranks, quantiles and calendar positions (E).

Every helper takes the partition and order it needs, so that one shuffle by
security serves all rolling columns of a query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from pitwell.functions.scalar import ratio


def last_rows(keys: list[str], order: list[str], n: int, skip: int = 0) -> WindowSpec:
    """The n rows that end `skip` rows before the current one."""
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(n - 1) - skip, -skip)


def next_rows(keys: list[str], order: list[str], n: int) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(1, n)


def gated(value: Column, counted: Column, w: WindowSpec, least: int) -> Column:
    return F.when(F.count(counted).over(w) >= least, value)


def rolling_mean(x: Column, w: WindowSpec, least: int) -> Column:
    return gated(F.avg(x).over(w), x, w, least)


def rolling_std(x: Column, w: WindowSpec, least: int) -> Column:
    return gated(F.stddev_samp(x).over(w), x, w, max(2, least))


def rolling_var(x: Column, w: WindowSpec, least: int) -> Column:
    return gated(F.var_samp(x).over(w), x, w, max(2, least))


def _pairs(x: Column, y: Column) -> Column:
    return F.when(x.isNotNull() & y.isNotNull(), F.lit(1))


def rolling_cov(x: Column, y: Column, w: WindowSpec, least: int) -> Column:
    return gated(F.covar_samp(x, y).over(w), _pairs(x, y), w, max(2, least))


def rolling_corr(x: Column, y: Column, w: WindowSpec, least: int) -> Column:
    return gated(F.corr(x, y).over(w), _pairs(x, y), w, max(2, least))


def rolling_beta(x: Column, m: Column, w: WindowSpec, least: int) -> Column:
    """Pairwise covariance over the variance of all market values in the frame."""
    return ratio(rolling_cov(x, m, w, least), rolling_var(m, w, least))


def rolling_compound(r: Column, w: WindowSpec, least: int) -> Column:
    """Product of 1 + r less 1; any NULL in the frame gives NULL."""
    whole = (F.count(r).over(w) == F.count(F.lit(1)).over(w)) & (F.count(r).over(w) >= least)
    return F.when(whole, F.product(1 + r).over(w) - 1)


def compound(r: Column) -> Column:
    """The same over a group."""
    return F.when(F.count(r) == F.count(F.lit(1)), F.product(1 + r) - 1)


def ordinal_rank(x: str, keys: list[str], ties: list[str]) -> Column:
    """1, 2, ... over the values; equal values in the order of `ties`. NULL for NULL."""
    w = Window.partitionBy(*keys).orderBy(F.col(x).asc_nulls_last(), *ties)
    return F.when(F.col(x).isNotNull(), F.row_number().over(w))


def average_rank(x: str, keys: list[str]) -> Column:
    w = Window.partitionBy(*keys).orderBy(F.col(x).asc_nulls_last())
    same = Window.partitionBy(*keys, x)
    return F.when(F.col(x).isNotNull(), F.rank().over(w) + (F.count(F.lit(1)).over(same) - 1) / 2)


def percentile_rank(x: str, keys: list[str]) -> Column:
    return average_rank(x, keys) / F.count(F.col(x)).over(Window.partitionBy(*keys))


def quantile_of(rank: Column, n: Column, q: int) -> Column:
    """min(Q, max(1, ceil(rank / n * Q)))."""
    return F.least(F.lit(q), F.greatest(F.lit(1), F.ceil(rank / n * q)))


def equal_count_bucket(rank: Column, n: Column, q: int) -> Column:
    """Buckets from 0 with edges at linear quantiles of the ranks, right-closed; at most n buckets."""
    k = F.least(F.lit(q), n)
    return F.when(n == 1, F.lit(0)).otherwise(F.greatest(F.ceil(F.try_divide((rank - 1) * k, n - 1)) - 1, F.lit(0)))


def common_month_end(df: DataFrame, date: str = "date") -> DataFrame:
    """Rows whose date is the last date of its month over all securities."""
    ends = df.groupBy(F.trunc(date, "MM").alias("month_")).agg(F.max(date).alias("end_"))
    return df.join(F.broadcast(ends), F.col(date) == F.col("end_"), "left_semi")


def monthly_cycles(calendar: DataFrame, date: str = "date") -> DataFrame:
    """signal (last session of a month), execution (next session), exit (next month's execution). One row a session goes in."""
    w = Window.orderBy(date)
    days = calendar.select(F.col(date).alias("signal"), F.lead(date).over(w).alias("execution"))
    ends = days.filter("trunc(signal, 'MM') <> trunc(execution, 'MM')")
    return ends.withColumn("exit", F.lead("execution").over(Window.orderBy("signal"))).filter("exit IS NOT NULL")


def session_positions(calendar: DataFrame, date: str = "date") -> DataFrame:
    return calendar.select(date).distinct().withColumn("session", F.dense_rank().over(Window.orderBy(date)).cast("long"))


def missing_sessions(df: DataFrame, key: str, date: str = "date") -> DataFrame:
    """key, date of the calendar's sessions that a key has no row on; the calendar is all dates of df.

    Rows carry the number of their session, so that gaps are ranges of numbers between a key's neighbouring rows, before
    its first and behind its last; only missing sessions become rows.
    """
    calendar = session_positions(df, date)
    rows = df.select(key, date).distinct().join(calendar, date)
    up = Window.partitionBy(key).orderBy("session")
    last = calendar.agg(F.max("session").alias("last_"))
    rows = rows.crossJoin(F.broadcast(last)).select(key, "session", F.lag("session", 1, 0).over(up).alias("was_"), F.when(F.lead("session").over(up).isNull(), F.col("last_")).alias("last_"))
    span = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>"))
    gaps = F.concat(span(F.col("was_") + 1, F.col("session") - 1), F.when(F.col("last_").isNull(), F.array().cast("array<bigint>")).otherwise(span(F.col("session") + 1, F.col("last_"))))
    return rows.select(key, F.explode(gaps).alias("session")).join(calendar, "session").select(key, date)


def drawdown_path(df: DataFrame, keys: list[str], order: list[str], r: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("wealth", F.product(1 + F.col(r)).over(w))
    return out.withColumn("drawdown", F.col("wealth") / F.greatest(F.lit(1.0), F.max("wealth").over(w)) - 1)


def next_value(df: DataFrame, keys: list[str], order: str, end: Column, name: str) -> DataFrame:
    """The next value of `order`, the last one `end`."""
    return df.withColumn(name, F.coalesce(F.lead(order).over(Window.partitionBy(*keys).orderBy(order)), end))


def compound_over(r: Column, w: WindowSpec) -> Column:
    """Compounded rows of a frame; NULL if any is missing or the frame is empty."""
    return F.when((F.count(r).over(w) == F.count(F.lit(1)).over(w)) & (F.count(r).over(w) > 0), F.product(1 + r).over(w) - 1)
