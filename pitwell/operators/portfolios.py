"""Factor portfolios (H), weights, accounting, costs and performance (J)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitwell.functions.scalar import finite, ratio
from pitwell.operators import windows as W
from pitwell.operators.joins import interval_join, require_none


def value_weighted(members: DataFrame, keys: list[str], ret: str, benchmark: str, cap: str, score: str = "score") -> DataFrame:
    """Count, cap-weighted return, benchmark and active return, over members with positive cap and a score."""
    m = members.filter((F.col(cap) > 0) & F.col(score).isNotNull() & F.col(ret).isNotNull())
    total = F.sum(cap)
    out = m.groupBy(*keys).agg(F.count("*").alias("members"), (F.sum(F.col(cap) * F.col(ret)) / total).alias("value_weighted_return"), (F.sum(F.col(cap) * F.col(benchmark)) / total).alias("benchmark_return"))
    return out.withColumn("active_return", F.col("value_weighted_return") - F.col("benchmark_return"))


def formed_quantiles(scores: DataFrame, keys: list[str], q: int = 3, least: int = 3, member: str = "security_id", score: str = "score") -> DataFrame:
    """Quantile of each scored member; factors with fewer than `least` names fall out."""
    known = scores.filter(F.col(score).isNotNull()).withColumn("rank_", W.ordinal_rank(score, keys, [member])).withColumn("n_", F.count("*").over(Window.partitionBy(*keys)))
    return known.filter(F.col("n_") >= least).withColumn("quantile", W.quantile_of(F.col("rank_"), F.col("n_"), q).cast("long")).drop("rank_", "n_")


def formation_weights(members: DataFrame, keys: list[str], cap: str = "cap") -> DataFrame:
    """Cap share within factor and quantile."""
    return members.withColumn("weight", F.col(cap) / F.sum(cap).over(Window.partitionBy(*keys, "quantile")))


def verified_paths(quotes: DataFrame, cycles: DataFrame, key: str = "security_id", tolerance: float = 1e-10) -> DataFrame:
    """Status of each security and cycle (entry, exit]: quotes must be finite and positive at both ends and agree with the returns between.

    quotes: key, date, price, ret; cycles: entry, exit. One range join, then one window by security and cycle.
    """
    rows = interval_join(quotes.select(key, "date", "price", "ret"), cycles.select("entry", "exit"), [], "date", "entry", "exit")
    w = Window.partitionBy(key, "entry").orderBy("date")
    chain = F.abs(F.try_divide(F.col("price"), F.lag("price").over(w)) - 1 - F.col("ret")) <= tolerance
    good = finite(F.col("price")) & (F.col("price") > 0)
    rows = rows.withColumn("good_", good).withColumn("chain_", F.when(F.lag("price").over(w).isNull(), True).otherwise(F.coalesce(chain, F.lit(False))))
    after = F.when(F.col("date") > F.col("entry"), 1 + F.col("ret"))
    out = rows.groupBy(key, "entry", "exit").agg(
        F.count("*").alias("quotes"), F.max(F.when(F.col("date") == F.col("entry"), F.col("price"))).alias("p0"), F.max(F.when(F.col("date") == F.col("exit"), F.col("price"))).alias("p1"),
        F.bool_and("good_").alias("good"), F.bool_and("chain_").alias("chain"), F.product(after).alias("path"))
    whole = F.abs(F.col("path") - F.try_divide("p1", "p0")) <= tolerance * 100
    status = (F.when(~F.col("good"), "INVALID_QUOTE").when(F.col("p0").isNull() | F.col("p1").isNull(), "MISSING_ENDPOINT_NO_AUTHENTIC_TERMINAL")
              .when(~F.col("chain") | ~F.coalesce(whole, F.lit(False)), "UNRECONCILED_QUOTE_RETURN_CHAIN").otherwise("COMPLETE_VALID"))
    return out.select(key, "entry", "exit", "quotes", status.alias("status"), F.when(status == "COMPLETE_VALID", F.try_divide("p1", "p0") - 1).alias("realized"))


def admitted_groups(members: DataFrame, paths: DataFrame, keys: list[str], key: str = "security_id") -> DataFrame:
    """Each member with its path and whether its whole group (keys, quantile) is valid: one failed member rejects the group."""
    joined = members.join(paths, [key, "entry"], "left")
    w = Window.partitionBy(*keys, "quantile")
    valid = F.coalesce(F.col("status") == "COMPLETE_VALID", F.lit(False))
    return joined.withColumn("admitted", F.bool_and(valid).over(w))


def admissibility(admitted: DataFrame, keys: list[str], key: str = "security_id") -> DataFrame:
    valid = F.coalesce(F.col("status") == "COMPLETE_VALID", F.lit(False))
    reasons = F.array_join(F.array_sort(F.collect_set(F.when(~valid, F.coalesce("status", F.lit("NO_QUOTES"))))), ",")
    return admitted.groupBy(*keys, "quantile").agg(F.count("*").alias("members"), F.count_if(~valid).alias("failed"), reasons.alias("reasons"), F.bool_and("admitted").alias("admitted"),
                                                   F.sum(F.when(F.col("admitted"), F.col("weight") * F.col("realized"))).alias("portfolio_return"))


def holding_coverage(rows: DataFrame, sessions: DataFrame, keys: list[str], period: list[str], strict: bool = False) -> DataFrame:
    """Formed securities whose observed return count differs from the sessions of the period. rows: keys, period, date, ret; sessions: period, n_sessions."""
    seen = rows.groupBy(*keys, *period).agg(F.count_distinct("date").alias("dates"), F.count("ret").alias("returns"), F.count("*").alias("rows"))
    out = seen.join(sessions, period).withColumn("complete", (F.col("dates") == F.col("n_sessions")) & (F.col("returns") == F.col("n_sessions")) & (F.col("rows") == F.col("n_sessions")))
    if strict:
        require_none(out.filter("NOT complete"), "a holding is incomplete")
    return out


def drifted(df: DataFrame, keys: list[str], asset: str = "asset_id", date: str = "date") -> DataFrame:
    """Adds gross (sum of w * r), pre_trade (last weight drifted by its return over 1 + gross; 0 at the start) and trade."""
    own = df.withColumn("gross", F.sum(F.col("weight") * F.col("ret")).over(Window.partitionBy(*keys, date)))
    grown = F.col("weight") * (1 + F.col("ret")) / (1 + F.col("gross"))
    out = own.withColumn("pre_trade", F.coalesce(F.lag(grown).over(Window.partitionBy(*keys, asset).orderBy(date)), F.lit(0.0)))
    return out.withColumn("trade", F.col("weight") - F.col("pre_trade"))


def trade_costs(commission: float, spread: float, slippage: float, impact: float = 0.0, liquidity: str | None = None) -> tuple[Column, Column, Column, Column]:
    """Costs of one trade in return units: commission, half the quoted spread, slippage, impact ~ |t|**1.5 / sqrt(liquidity)."""
    size = F.abs("trade")
    push = F.lit(impact) * F.pow(size, 1.5) / F.sqrt(liquidity) if liquidity else F.lit(0.0)
    return size * commission / 1e4, size * spread / 2e4, size * slippage / 1e4, push


def backtest(df: DataFrame, keys: list[str], benchmark: str, costs: tuple[Column, Column, Column, Column], date: str = "date", asset: str = "asset_id") -> DataFrame:
    """Per key and date: turnover (L1), cost, gross, net, benchmark, active. Target weights are set every date."""
    rows = drifted(df, keys, asset, date)
    total = costs[0] + costs[1] + costs[2] + costs[3]
    out = rows.groupBy(*keys, date).agg(F.sum(F.abs("trade")).alias("turnover"), F.sum(total).alias("cost"), F.max("gross").alias("gross"), F.max(benchmark).alias("benchmark"))
    return out.withColumn("net", F.col("gross") - F.col("cost")).withColumn("active", F.col("net") - F.col("benchmark"))


def backtest_every(df: DataFrame, keys: list[str], k: int, date: str = "date", asset: str = "asset_id") -> DataFrame:
    """Weights held between rebalances every k-th date: target * growth since the rebalance over that of the whole. df: position (from 0) of the date."""
    since = F.floor(F.col("position") / k) * k
    rows = df.withColumn("block", since)
    before = Window.partitionBy(*keys, asset, "block").orderBy(date).rowsBetween(Window.unboundedPreceding, -1)
    first = Window.partitionBy(*keys, asset, "block").orderBy(date)
    rows = rows.withColumn("grown", F.first("weight").over(first) * F.coalesce(F.product(1 + F.col("ret")).over(before), F.lit(1.0)))
    return rows.withColumn("held", F.col("grown") / F.sum("grown").over(Window.partitionBy(*keys, date)))


def equal_weights(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.withColumn("weight", 1 / F.count("*").over(Window.partitionBy(*keys)))


def cap_weights(df: DataFrame, keys: list[str], cap: str) -> DataFrame:
    return df.filter(finite(F.col(cap)) & (F.col(cap) > 0)).withColumn("weight", F.col(cap) / F.sum(cap).over(Window.partitionBy(*keys)))


def ranked_signal_weights(df: DataFrame, keys: list[str], prediction: str, share: float, member: str) -> DataFrame:
    """The top ceil(share * n) by prediction, equally weighted; ties by member."""
    w = Window.partitionBy(*keys)
    out = df.withColumn("k_", F.row_number().over(w.orderBy(F.col(prediction).desc(), member))).withColumn("n_", F.count("*").over(w))
    out = out.filter(F.col("k_") <= F.ceil(F.col("n_") * share))
    return out.withColumn("weight", 1 / F.count("*").over(w)).drop("k_", "n_")


def constraint_rows(weights: DataFrame, keys: list[str], lower: float, upper: float, turnover: DataFrame | None = None, most_turnover: float | None = None, groups: str | None = None, group_cap: float | None = None, tolerance: float = 1e-9) -> DataFrame:
    """One row per key and constraint: value, limit and whether it holds."""
    agg = weights.groupBy(*keys).agg(F.sum("weight").alias("budget"), F.min("weight").alias("low"), F.max("weight").alias("high"), F.sum(F.abs("weight")).alias("gross"))
    stack = agg.select(*keys, F.explode(F.array(
        F.struct(F.lit("budget").alias("constraint"), F.col("budget").alias("value"), F.lit(1.0).alias("limit"), (F.abs(F.col("budget") - 1) <= tolerance).alias("holds")),
        F.struct(F.lit("lower").alias("constraint"), F.col("low").alias("value"), F.lit(lower).alias("limit"), (F.col("low") >= lower - tolerance).alias("holds")),
        F.struct(F.lit("upper").alias("constraint"), F.col("high").alias("value"), F.lit(upper).alias("limit"), (F.col("high") <= upper + tolerance).alias("holds")),
        F.struct(F.lit("gross").alias("constraint"), F.col("gross").alias("value"), F.lit(1.0).alias("limit"), (F.col("gross") <= 1 + tolerance).alias("holds")),
    )).alias("c")).select(*keys, "c.*")
    if groups and group_cap is not None:
        g = weights.groupBy(*keys, groups).agg(F.sum("weight").alias("s")).groupBy(*keys).agg(F.max("s").alias("value"))
        stack = stack.unionByName(g.select(*keys, F.lit("group_cap").alias("constraint"), "value", F.lit(group_cap).alias("limit"), (F.col("value") <= group_cap + tolerance).alias("holds")))
    if turnover is not None and most_turnover is not None:
        stack = stack.unionByName(turnover.select(*keys, F.lit("turnover").alias("constraint"), F.col("turnover").alias("value"), F.lit(most_turnover).alias("limit"), (F.col("turnover") <= most_turnover + tolerance).alias("holds")))
    return stack


def scenario_impact(weights: DataFrame, exposures: DataFrame, shocks: DataFrame, keys: list[str], asset: str) -> tuple[DataFrame, DataFrame]:
    """(keys, scenario, impact) and the shocks that no exposure maps. exposures: asset, factor, exposure; shocks: scenario, factor, shock."""
    hit = weights.join(exposures, asset).join(F.broadcast(shocks), "factor")
    impact = hit.groupBy(*keys, "scenario").agg(F.sum(F.col("weight") * F.col("exposure") * F.col("shock")).alias("impact"))
    return impact, shocks.join(exposures.select("factor").distinct(), "factor", "left_anti")


def nav_audit(ledger: DataFrame, keys: list[str], date: str = "date") -> DataFrame:
    """NAV by compounding net returns, and the largest error of NAV_t = NAV_(t-1) * (1 + net) and of net = gross - cost."""
    w = Window.partitionBy(*keys).orderBy(date)
    nav = ledger.withColumn("nav", F.product(1 + F.col("net")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    step = nav.withColumn("step_", F.abs(F.col("nav") - F.coalesce(F.lag("nav").over(w), F.lit(1.0)) * (1 + F.col("net"))))
    return step.groupBy(*keys).agg(F.max("step_").alias("nav_error"), F.max(F.abs(F.col("gross") - F.col("cost") - F.col("net"))).alias("net_error"), F.max_by("nav", date).alias("final_nav"))


def solve_quality(weights: DataFrame, means: DataFrame, cov: DataFrame) -> DataFrame:
    """Expected return, volatility, weight-sum error and bounds of one solution. weights: asset, w; means: asset, mu; cov: i, j, cov."""
    first = weights.join(means, "asset").agg(F.sum(F.col("w") * F.col("mu")).alias("expected"), F.abs(F.sum("w") - 1).alias("sum_error"), F.min("w").alias("min_w"), F.max("w").alias("max_w"))
    i, j = weights.select(F.col("asset").alias("i"), F.col("w").alias("wi")), weights.select(F.col("asset").alias("j"), F.col("w").alias("wj"))
    second = cov.join(i, "i").join(j, "j").agg(F.sqrt(F.sum(F.col("wi") * F.col("wj") * F.col("cov"))).alias("volatility"))
    return first.crossJoin(F.broadcast(second))


def leg_turnover(members: DataFrame, keys: list[str], date: str, member: str) -> DataFrame:
    """Mean over successive dates of |A symmetric difference B| / |A union B|."""
    sets = members.groupBy(*keys, date).agg(F.collect_set(member).alias("now"))
    before = F.lag("now").over(Window.partitionBy(*keys).orderBy(date))
    pairs = sets.withColumn("was", before).filter("was IS NOT NULL")
    moved = F.size(F.array_except("now", "was")) + F.size(F.array_except("was", "now"))
    return pairs.groupBy(*keys).agg(F.avg(ratio(moved.cast("double"), F.size(F.array_union("now", "was")).cast("double"))).alias("turnover"))
