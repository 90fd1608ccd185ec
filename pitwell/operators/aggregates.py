"""Grouped aggregates over panels, facts and fit tables (D)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitwell.operators.joins import block_pairs, pairwise


def factor_coverage(scores: DataFrame) -> DataFrame:
    """Observed and total rows, coverage, status, and rows changed by clipping, per factor."""
    seen = F.count("raw")
    status = F.when(seen == 0, "UNAVAILABLE").when(seen < F.count("*"), "PARTIAL").otherwise("COMPLETE")
    return scores.groupBy("factor_id").agg(seen.alias("observed"), F.count("*").alias("total"), F.try_divide(seen, F.count("*")).alias("coverage"), status.alias("status"), F.count_if(F.col("raw") != F.col("winsorized")).alias("clipped"))


def factor_correlations(scores: DataFrame, value: str = "raw", least: int = 2) -> DataFrame:
    """Pairwise-complete correlations of factors over security and date."""
    keyed = scores.select("factor_id", F.struct("security_id", "date").alias("at"), value)
    return pairwise(keyed, "factor_id", "at", value, least)


def annual_facts(facts: DataFrame, precedence: DataFrame, filing: list[str]) -> DataFrame:
    """facts: filing keys, concept, period_end, value; precedence: field, concept, rank.

    Per filing the latest period; per field the value of the first concept in precedence; conflict where one concept has two values.
    """
    latest = facts.withColumn("m_", F.max("period_end").over(Window.partitionBy(*filing))).filter("period_end = m_").drop("m_")
    ranked = latest.join(F.broadcast(precedence), "concept")
    first = ranked.withColumn("best_", F.min("rank").over(Window.partitionBy(*filing, "field"))).filter("rank = best_")
    return first.groupBy(*filing, "field").agg(F.min("period_end").alias("period_end"), F.min("concept").alias("concept"), F.min("value").alias("value"), (F.count_distinct("value") > 1).alias("conflict"))


def derived_fields(fields: DataFrame, filing: list[str], names: list[str], derivations: dict[str, Column]) -> DataFrame:
    """One row a filing with the named fields as columns and the derived ones beside them."""
    return fields.groupBy(*filing).pivot("field", names).agg(F.first("value")).withColumns(derivations)


def prior_value(rows: DataFrame, keys: list[str], period: str, available: str, value: str) -> DataFrame:
    """For each row the value of the greatest earlier period, as last known by this row's availability."""
    earlier = rows.select(*keys, F.col(period).alias("p_"), F.col(available).alias("a_"), F.col(value).alias("v_"))
    both = rows.join(earlier, keys, "left").filter(F.col("p_").isNull() | ((F.col("p_") < F.col(period)) & (F.col("a_") <= F.col(available))))
    best = both.groupBy(*keys, period, available).agg(F.max_by("v_", F.struct("p_", "a_")).alias(f"prior_{value}"))
    return rows.join(best, [*keys, period, available], "left")


def unique_latest(facts: DataFrame, keys: list[str], period: str, value: str) -> DataFrame:
    """Rows of the latest period per key with one positive value; others are conflicts."""
    latest = facts.withColumn("m_", F.max(period).over(Window.partitionBy(*keys))).filter(F.col(period) == F.col("m_"))
    return latest.groupBy(*keys).agg(F.max(period).alias(period), F.min(value).alias(value), ((F.count_distinct(value) == 1) & (F.min(value) > 0)).alias("valid"))


def unique_per_group(rows: DataFrame, keys: list[str], concept: str, value: str, wanted: list[str]) -> DataFrame:
    """Groups that hold exactly one distinct value of each wanted concept, as columns."""
    sets = {c: F.collect_set(F.when(F.col(concept) == c, F.col(value))) for c in wanted}
    out = rows.groupBy(*keys).agg(*(v.alias(f"s_{c}") for c, v in sets.items()))
    for c in wanted:
        out = out.filter(F.size(f"s_{c}") == 1)
    return out.select(*keys, *(F.get(f"s_{c}", F.lit(0)).alias(c) for c in wanted))


def model_summary(fits: DataFrame, keys: list[str], estimate: str, se: str, r2: str, level_z: float = 1.959963984540054) -> DataFrame:
    e, lower, upper = F.col(estimate), F.col(estimate) - level_z * F.col(se), F.col(estimate) + level_z * F.col(se)
    return fits.groupBy(*keys).agg(
        F.count("*").alias("fits"), F.avg(e).alias("mean"), F.median(e).alias("median"), F.stddev_samp(e).alias("sd"), F.sqrt(F.avg(e * e)).alias("rms"), F.avg(F.abs(e)).alias("mean_abs"), F.count_if(e > 0).alias("positive"),
        F.count_if(e < 0).alias("negative"), F.count_if((lower <= 0) & (upper >= 0)).alias("contains_zero"), F.count_if((lower > 0) | (upper < 0)).alias("significant"), F.avg(r2).alias("mean_r2"), F.percentile(r2, 0.25).alias("r2_q25"),
        F.percentile(r2, 0.75).alias("r2_q75"), (F.percentile(r2, 0.75) - F.percentile(r2, 0.25)).alias("r2_iqr"))


def profile(df: DataFrame, security: str, date: str) -> DataFrame:
    """One row: counts, distinct securities and dates, first and last date, NULLs of each column."""
    nulls = [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in df.columns]
    return df.agg(F.count("*").alias("rows"), F.lit(len(df.columns)).cast("long").alias("columns"), F.count_distinct(security).alias("securities"), F.count_distinct(date).alias("dates"), F.min(date).alias("first"), F.max(date).alias("last"), *nulls)


def metric_stability(metrics: DataFrame, fold: str) -> DataFrame:
    """metric, mean, sd (0 for one fold), min, max over folds."""
    names = [c for c in metrics.columns if c != fold]
    long = metrics.unpivot([fold], names, "metric", "value")
    return long.groupBy("metric").agg(F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("sd"), F.min("value").alias("low"), F.max("value").alias("high"))


def month_gaps(df: DataFrame, keys: list[str], date: str) -> DataFrame:
    month = F.year(date) * 12 + F.month(date)
    step = month - F.lag(month).over(Window.partitionBy(*keys).orderBy(date))
    return df.withColumn("step_", step).groupBy(*keys).agg(F.count_if(F.col("step_") != 1).alias("gaps"))


def residual_dependence(residuals: DataFrame, entity: str, date: str, value: str, least: int = 24, high: float = 0.95) -> DataFrame:
    pairs = block_pairs(residuals, entity, date, value, least, gap=False)
    return pairs.agg(F.count("*").alias("pairs"), F.avg("corr").alias("mean_corr"), F.median("corr").alias("median_corr"), F.min("corr").alias("min_corr"), F.max("corr").alias("max_corr"), F.count_if(F.col("corr") > high).alias("high_pairs"))


def model_differences(fits: DataFrame, entity: str, model: str, values: list[str]) -> DataFrame:
    """Differences of values of every model pair per entity."""
    a = fits.select(entity, F.col(model).alias("a"), *(F.col(v).alias(f"a_{v}") for v in values))
    b = fits.select(entity, F.col(model).alias("b"), *(F.col(v).alias(f"b_{v}") for v in values))
    return a.join(b, entity).filter("a < b").select(entity, "a", "b", *((F.col(f"b_{v}") - F.col(f"a_{v}")).alias(f"d_{v}") for v in values))


def leave_one_out(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    w = Window.partitionBy(*keys)
    out = df.withColumn("loo_", F.try_divide(F.sum(value).over(w) - F.col(value), F.count(value).over(w) - 1))
    return out.groupBy(*keys).agg(F.avg(value).alias("mean"), F.median(value).alias("median"), F.min("loo_").alias("loo_min"), F.max("loo_").alias("loo_max"))
