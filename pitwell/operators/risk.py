"""Risk and performance metrics (K): grouped aggregates over periodic returns."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitwell.functions.scalar import ratio
from pitwell.operators.windows import drawdown_path


def volatility(r: Column, ann: float) -> Column:
    return F.stddev_samp(r) * ann**0.5


def beta(r: Column, b: Column) -> Column:
    both = r.isNotNull() & b.isNotNull()
    return ratio(F.covar_samp(r, b), F.var_samp(F.when(both, b)))


def alpha(r: Column, b: Column, ann: float) -> Column:
    return (F.avg(r) - beta(r, b) * F.avg(b)) * ann


def downside_deviation(r: Column, ann: float, target: float = 0.0) -> Column:
    return F.sqrt(F.avg(F.pow(F.least(r - target, F.lit(0.0)), 2))) * ann**0.5


def var_historical(r: Column, level: float) -> Column:
    return F.greatest(F.lit(0.0), -F.percentile(r, 1 - level))


def var_parametric(r: Column, level: float) -> Column:
    return F.greatest(F.lit(0.0), -(F.avg(r) + NormalDist().inv_cdf(1 - level) * F.stddev_samp(r)))


def sharpe(excess: Column, ann: float) -> Column:
    sd = F.stddev_samp(excess)
    return F.when(sd > 1e-15, F.avg(excess) * ann**0.5 / sd)


def sortino(excess: Column, ann: float) -> Column:
    return ratio(F.avg(excess) * ann, downside_deviation(excess, ann))


def omega(r: Column, threshold: float = 0.0) -> Column:
    gap = r - threshold
    return ratio(F.sum(F.greatest(gap, F.lit(0.0))), -F.sum(F.least(gap, F.lit(0.0))))


def cumulative(r: Column) -> Column:
    return F.product(1 + r) - 1


def geometric_annualised(r: Column, ann: float) -> Column:
    return F.pow(F.product(1 + r), ann / F.count(r)) - 1


def expected_shortfall(df: DataFrame, keys: list[str], r: str, level: float = 0.95) -> DataFrame:
    """Mean of the returns at or below the quantile, sign turned; and the number of them."""
    cut = df.withColumn("q_", F.percentile(r, 1 - level).over(Window.partitionBy(*keys)))
    tail = F.when(F.col(r) <= F.col("q_"), F.col(r))
    return cut.groupBy(*keys).agg((-F.avg(tail)).alias("expected_shortfall"), F.count(tail).alias("tail_count"))


def max_drawdown(df: DataFrame, keys: list[str], order: list[str], r: str) -> DataFrame:
    return drawdown_path(df, keys, order, r).groupBy(*keys).agg(F.min("drawdown").alias("max_drawdown"))


def risk_summary(df: DataFrame, keys: list[str], order: list[str], r: str, benchmark: str, rf: str, ann: float, level: float = 0.95) -> DataFrame:
    """All metrics in one row a group; df must hold complete, aligned rows."""
    c, active, excess = F.col(r), F.col(r) - F.col(benchmark), F.col(r) - F.col(rf)
    main = df.groupBy(*keys).agg(
        F.count(c).alias("n"), cumulative(c).alias("cumulative_return"), geometric_annualised(c, ann).alias("geometric_annualised"), (F.avg(c) * ann).alias("mean_annual"), volatility(c, ann).alias("volatility"),
        downside_deviation(c, ann).alias("downside_deviation"), beta(c, F.col(benchmark)).alias("beta"), alpha(c, F.col(benchmark), ann).alias("alpha"), var_historical(c, level).alias("var_historical"),
        var_parametric(c, level).alias("var_parametric"), sharpe(excess, ann).alias("sharpe"), sortino(excess, ann).alias("sortino"), omega(c).alias("omega"), volatility(active, ann).alias("tracking_error"), sharpe(active, ann).alias("information_ratio"))
    out = main.join(expected_shortfall(df, keys, r, level), keys).join(max_drawdown(df, keys, order, r), keys)
    return out.withColumn("calmar", ratio(F.col("mean_annual"), F.abs("max_drawdown")))


def covariance_long(df: DataFrame, asset: str, time: str, r: str, ann: float = 1.0) -> DataFrame:
    """(i, j, cov) of all asset pairs over their common dates."""
    a = df.select(F.col(asset).alias("i"), F.col(time).alias("t"), F.col(r).alias("x"))
    b = df.select(F.col(asset).alias("j"), F.col(time).alias("t"), F.col(r).alias("y"))
    return a.join(b, "t").groupBy("i", "j").agg((F.covar_samp("x", "y") * ann).alias("cov"))


def risk_contributions(weights: DataFrame, cov: DataFrame) -> DataFrame:
    """weights: asset, w. Per asset: marginal (row of the covariance times w over sigma), component (w times it), sigma of the whole."""
    row = cov.join(weights.select(F.col("asset").alias("j"), F.col("w").alias("wj")), "j").groupBy("i").agg(F.sum(F.col("cov") * F.col("wj")).alias("sw"))
    own = row.join(weights.select(F.col("asset").alias("i"), "w"), "i")
    sigma = own.agg(F.sqrt(F.sum(F.col("w") * F.col("sw"))).alias("sigma"))
    out = own.crossJoin(F.broadcast(sigma))
    return out.select(F.col("i").alias("asset"), "w", (F.col("sw") / F.col("sigma")).alias("marginal"), (F.col("w") * F.col("sw") / F.col("sigma")).alias("component"), "sigma")


def diversification_ratio(weights: DataFrame, cov: DataFrame) -> DataFrame:
    own = cov.filter("i = j").select(F.col("i").alias("asset"), F.sqrt("cov").alias("sd"))
    total = weights.join(own, "asset").agg(F.sum(F.col("w") * F.col("sd")).alias("weighted"))
    sigma = risk_contributions(weights, cov).agg(F.max("sigma").alias("sigma"))
    return total.crossJoin(F.broadcast(sigma)).select((F.col("weighted") / F.col("sigma")).alias("ratio"))
