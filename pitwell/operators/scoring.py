"""Cross-sectional winsorising, normalising and scoring (G), by date and optionally a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitwell.operators.characteristics import NEGATIVE
from pitwell.operators.windows import average_rank, percentile_rank

METHODS = ("none", "winsorized", "robust_zscore", "zscore", "zscore_pop", "minmax", "rank", "percentile")


def winsorized(x: str, keys: list[str], low: float = 0.01, high: float = 0.99) -> Column:
    """Clipped to interpolated quantiles of the group; NULL stays."""
    w = Window.partitionBy(*keys)
    bounds = F.percentile(x, F.array(F.lit(low), F.lit(high))).over(w)
    return F.when(F.col(x).isNotNull(), F.greatest(F.get(bounds, F.lit(0)), F.least(F.get(bounds, F.lit(1)), F.col(x))))


def normalised(df: DataFrame, x: str, keys: list[str], method: str, name: str = "normalized") -> DataFrame:
    w, c = Window.partitionBy(*keys), F.col(x)
    if method in ("none", "winsorized"):
        return df.withColumn(name, c)
    if method == "robust_zscore":
        out = df.withColumn("med_", F.median(x).over(w)).withColumn("mad_", F.median(F.abs(c - F.col("med_"))).over(w))
        return out.withColumn(name, F.when(F.col("mad_") > 0, (c - F.col("med_")) / (1.4826 * F.col("mad_")))).drop("med_", "mad_")
    if method in ("zscore", "zscore_pop"):
        sd = (F.stddev_samp if method == "zscore" else F.stddev_pop)(x).over(w)
        return df.withColumn(name, F.when(sd > 0, (c - F.avg(x).over(w)) / sd))
    if method == "minmax":
        low, high = F.min(x).over(w), F.max(x).over(w)
        return df.withColumn(name, F.when(high > low, (c - low) / (high - low)))
    if method == "rank":
        return df.withColumn(name, average_rank(x, keys))
    if method == "percentile":
        return df.withColumn(name, percentile_rank(x, keys))
    raise ValueError(f"unknown method {method!r}")


def score_factors(wide: DataFrame, factors: list[str], ids: list[str], method: str = "robust_zscore", least: int = 5, low: float = 0.01, high: float = 0.99, group: str | None = None) -> DataFrame:
    """Long table: ids, factor_id, raw, winsorized, normalized, score. One shuffle by factor, date and group serves all factors.

    Below `least` values of a cross-section only normalized and score are NULL.
    """
    long = wide.unpivot([*ids, *([group] if group else [])], factors, "factor_id", "raw")
    keys = ["factor_id", "date", *([group] if group else [])]
    enough = F.count("raw").over(Window.partitionBy(*keys)) >= least
    out = long.withColumn("enough_", enough).withColumn("winsorized", winsorized("raw", keys, low, high))
    out = normalised(out, "winsorized", keys, method)
    out = out.withColumn("normalized", F.when(F.col("enough_"), F.col("normalized"))).drop("enough_")
    sign = F.when(F.col("factor_id").isin(*NEGATIVE), -1.0).otherwise(1.0)
    return out.withColumn("score", F.col("normalized") * sign).withColumn("method", F.lit(method))
