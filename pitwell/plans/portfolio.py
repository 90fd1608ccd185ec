"""Queries of the portfolio, accounting and risk operators (H, J, K) and the aggregates beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitwell.operators import portfolios as P
from pitwell.operators import risk as R
from pitwell.operators import windows as W
from pitwell.operators.joins import interval_join
from pitwell.plans.features import CYCLES, SCORES, rounded, scores
from pitwell.plans.registry import query, register
from pitwell.plans.tables import Tables

KEY, ANN = ["security_id"], 12.0


def rows(t: Tables) -> DataFrame:
    return t.panel.filter("ret IS NOT NULL")


# K: one query per metric and the summary.

DD = "(SELECT security_id, min(wealth / greatest(1.0, peak) - 1) AS mdd FROM (SELECT *, max(wealth) OVER (PARTITION BY security_id ORDER BY date) AS peak FROM (SELECT security_id, date, product(1 + ret) OVER (PARTITION BY security_id ORDER BY date) AS wealth FROM rows_)) GROUP BY 1)"
MORE = {"rows_": "SELECT * FROM panel WHERE ret IS NOT NULL"}
Z = -1.6448536269514722
DOWN = "sqrt(avg(pow(least(ret, 0), 2))) * sqrt(12)"
METRICS = {
    "k01_volatility": (lambda r, b, f: R.volatility(r, ANN), "stddev_samp(ret) * sqrt(12)"),
    "k04_downside_deviation": (lambda r, b, f: R.downside_deviation(r, ANN), DOWN),
    "k05_var_historical": (lambda r, b, f: R.var_historical(r, 0.95), "greatest(0, -quantile_cont(ret, 0.05))"),
    "k06_var_parametric": (lambda r, b, f: R.var_parametric(r, 0.95), f"greatest(0, -(avg(ret) + {Z} * stddev_samp(ret)))"),
    "k10_sharpe": (lambda r, b, f: R.sharpe(r - f, ANN), "avg(ret - risk_free) * sqrt(12) / nullif(stddev_samp(ret - risk_free), 0)"),
    "k11_sortino": (lambda r, b, f: R.sortino(r - f, ANN), "avg(ret - risk_free) * 12 / nullif(sqrt(avg(pow(least(ret - risk_free, 0), 2))) * sqrt(12), 0)"),
    "k13_omega": (lambda r, b, f: R.omega(r), "sum(greatest(ret, 0)) / nullif(-sum(least(ret, 0)), 0)"),
    "k14_tracking_error": (lambda r, b, f: R.volatility(r - b, ANN), "stddev_samp(ret - benchmark_return) * sqrt(12)"),
    "k14_information_ratio": (lambda r, b, f: R.sharpe(r - b, ANN), "avg(ret - benchmark_return) * sqrt(12) / nullif(stddev_samp(ret - benchmark_return), 0)"),
    "k15_cumulative_return": (lambda r, b, f: R.cumulative(r), "product(1 + ret) - 1"),
    "k17_geometric_annualised": (lambda r, b, f: R.geometric_annualised(r, ANN), "pow(product(1 + ret), 12.0 / count(ret)) - 1"),
}


def metric(make):
    return lambda t: rounded(rows(t).groupBy(*KEY).agg(make(F.col("ret"), F.col("benchmark_return"), F.col("risk_free")).alias("v")), KEY, value=F.col("v"))


for _n, (_make, _sql) in METRICS.items():
    register(_n, metric(_make), f"SELECT security_id, round({_sql}, 6) AS value FROM rows_ GROUP BY 1", MORE)


@query("k02_beta_alpha", "SELECT security_id, round(covar_samp(ret, benchmark_return) / var_samp(benchmark_return), 6) AS beta, round((avg(ret) - covar_samp(ret, benchmark_return) / var_samp(benchmark_return) * avg(benchmark_return)) * 12, 6) AS alpha FROM rows_ GROUP BY 1", MORE)
def k02(t: Tables) -> DataFrame:
    r, b = F.col("ret"), F.col("benchmark_return")
    return rows(t).groupBy(*KEY).agg(F.round(R.beta(r, b), 6).alias("beta"), F.round(R.alpha(r, b, ANN), 6).alias("alpha"))


@query("k03_max_drawdown", f"SELECT security_id, round(mdd, 6) AS value FROM {DD}", MORE)
def k03(t: Tables) -> DataFrame:
    return rounded(R.max_drawdown(rows(t), KEY, ["date"], "ret"), KEY, value=F.col("max_drawdown"))


@query("k07_expected_shortfall", "SELECT security_id, round(-avg(ret), 6) AS value, count(*) AS tail_count FROM (SELECT *, quantile_cont(ret, 0.05) OVER (PARTITION BY security_id) AS q FROM rows_) WHERE ret <= q GROUP BY 1", MORE)
def k07(t: Tables) -> DataFrame:
    return R.expected_shortfall(rows(t), KEY, "ret").select(*KEY, F.round("expected_shortfall", 6).alias("value"), "tail_count")


@query("k12_calmar", f"SELECT security_id, round(avg(ret) * 12 / nullif(abs(max(mdd)), 0), 6) AS value FROM rows_ JOIN {DD} USING (security_id) GROUP BY 1", MORE)
def k12(t: Tables) -> DataFrame:
    return rounded(R.risk_summary(rows(t), KEY, ["date"], "ret", "benchmark_return", "risk_free", ANN), KEY, value=F.col("calmar"))


@query("k16_risk_summary", f"SELECT security_id, count(*) AS n, round(product(1 + ret) - 1, 6) AS cumulative_return, round(stddev_samp(ret) * sqrt(12), 6) AS volatility, round({DOWN}, 6) AS downside_deviation, round(max(mdd), 6) AS max_drawdown FROM rows_ JOIN {DD} USING (security_id) GROUP BY 1", MORE)
def k16(t: Tables) -> DataFrame:
    s = R.risk_summary(rows(t), KEY, ["date"], "ret", "benchmark_return", "risk_free", ANN)
    return s.select(*KEY, "n", *(F.round(c, 6).alias(c) for c in ("cumulative_return", "volatility", "downside_deviation", "max_drawdown")))


SECTORS = {"sector_": "SELECT sector AS asset_id, date, avg(ret) AS ret, sum(price * shares) AS cap, max(benchmark_return) AS benchmark_return, max(risk_free) AS risk_free FROM panel WHERE ret IS NOT NULL GROUP BY 1, 2",
           "cov_": "SELECT a.asset_id AS i, b.asset_id AS j, covar_samp(a.ret, b.ret) * 12 AS cov FROM sector_ a JOIN sector_ b USING (date) GROUP BY 1, 2",
           "w_": "SELECT DISTINCT asset_id AS asset, 1 / count(*) OVER () AS w FROM (SELECT DISTINCT asset_id FROM sector_)"}


def sectors(t: Tables) -> DataFrame:
    return rows(t).groupBy(F.col("sector").alias("asset_id"), "date").agg(F.avg("ret").alias("ret"), F.sum(F.col("price") * F.col("shares")).alias("cap"), F.max("benchmark_return").alias("benchmark_return"), F.max("risk_free").alias("risk_free"))


def sector_weights(t: Tables) -> DataFrame:
    names = sectors(t).select(F.col("asset_id").alias("asset")).distinct()
    return names.withColumn("w", 1 / F.count("*").over(Window.partitionBy(F.lit(1))))


@query("j03_sample_covariance", "SELECT i, j, round(cov, 6) AS cov FROM cov_", SECTORS)
def j03(t: Tables) -> DataFrame:
    return R.covariance_long(sectors(t), "asset_id", "date", "ret", ANN).select("i", "j", F.round("cov", 6).alias("cov"))


@query("k08_risk_contributions", """WITH s AS (SELECT i, sum(cov * wj.w) AS sw FROM cov_ JOIN w_ wj ON j = wj.asset GROUP BY i), v AS (SELECT sqrt(sum(w * sw)) AS sigma FROM s JOIN w_ ON i = asset)
SELECT i AS asset, round(sw / sigma, 6) AS marginal, round(w * sw / sigma, 6) AS component FROM s JOIN w_ ON i = asset, v""", SECTORS)
def k08(t: Tables) -> DataFrame:
    out = R.risk_contributions(sector_weights(t), R.covariance_long(sectors(t), "asset_id", "date", "ret", ANN))
    return out.select("asset", F.round("marginal", 6).alias("marginal"), F.round("component", 6).alias("component"))


@query("k09_diversification_ratio", "SELECT round((SELECT sum(w * sqrt(cov)) FROM cov_ JOIN w_ ON i = asset WHERE i = j) / (SELECT sqrt(sum(a.w * b.w * cov)) FROM cov_ JOIN w_ a ON i = a.asset JOIN w_ b ON j = b.asset), 6) AS ratio", SECTORS)
def k09(t: Tables) -> DataFrame:
    return R.diversification_ratio(sector_weights(t), R.covariance_long(sectors(t), "asset_id", "date", "ret", ANN)).select(F.round("ratio", 6).alias("ratio"))


@query("j17_optimisation_diagnostics", "SELECT round((SELECT sum(w * mu) FROM w_ JOIN (SELECT asset_id, avg(ret) * 12 AS mu FROM sector_ GROUP BY 1) ON asset = asset_id), 6) AS expected, round((SELECT sqrt(sum(a.w * b.w * cov)) FROM cov_ JOIN w_ a ON i = a.asset JOIN w_ b ON j = b.asset), 6) AS volatility, (SELECT round(abs(sum(w) - 1), 6) FROM w_) AS sum_error, (SELECT round(min(w), 6) FROM w_) AS min_w, (SELECT round(max(w), 6) FROM w_) AS max_w", SECTORS)
def j17(t: Tables) -> DataFrame:
    mu = sectors(t).groupBy(F.col("asset_id").alias("asset")).agg((F.avg("ret") * ANN).alias("mu"))
    out = P.solve_quality(sector_weights(t), mu, R.covariance_long(sectors(t), "asset_id", "date", "ret", ANN))
    return rounded(out, [], expected=F.col("expected"), volatility=F.col("volatility"), sum_error=F.col("sum_error"), min_w=F.col("min_w"), max_w=F.col("max_w"))


# J: weights and accounting.

register("j01_equal_weight", lambda t: rounded(P.equal_weights(rows(t), ["date"]), ["security_id", "date"], 9, weight=F.col("weight")), "SELECT security_id, date, round(1 / count(*) OVER (PARTITION BY date), 9) AS weight FROM rows_", MORE)
register("j02_cap_weight", lambda t: rounded(P.cap_weights(rows(t).withColumn("cap", F.col("price") * F.col("shares")), ["date"], "cap"), ["security_id", "date"], 9, weight=F.col("weight")), "SELECT security_id, date, round(price * shares / sum(price * shares) OVER (PARTITION BY date), 9) AS weight FROM rows_", MORE)
register("j18_ranked_signal_weights", lambda t: rounded(P.ranked_signal_weights(rows(t), ["date"], "ret", 0.1, "security_id"), ["security_id", "date"], 9, weight=F.col("weight")),
         "WITH r AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY ret DESC, security_id) AS k, count(*) OVER (PARTITION BY date) AS n FROM rows_) SELECT security_id, date, round(1 / count(*) OVER (PARTITION BY date), 9) AS weight FROM r WHERE k <= ceil(n * 0.1::DOUBLE)", MORE)

LEDGER = SECTORS | {
    "g_": "SELECT *, 0.2::DOUBLE AS weight, sum(0.2::DOUBLE * ret) OVER (PARTITION BY date) AS gross FROM sector_",
    "t_": "SELECT *, weight - coalesce(lag(weight * (1 + ret) / (1 + gross)) OVER (PARTITION BY asset_id ORDER BY date), 0) AS trade FROM g_",
    "ledger_": "SELECT date, sum(abs(trade)) AS turnover, sum(abs(trade) * 10 / 1e4 + abs(trade) * 5 / 2e4 + abs(trade) * 2 / 1e4 + 0.01 * pow(abs(trade), 1.5) / sqrt(cap)) AS cost, max(gross) AS gross, max(benchmark_return) AS benchmark FROM t_ GROUP BY date",
}


def book(t: Tables) -> DataFrame:
    return sectors(t).withColumns({"weight": F.lit(0.2), "book": F.lit("equal")})


def costs(scale: float = 1.0):
    return P.trade_costs(10 * scale, 5 * scale, 2 * scale, 0.01 * scale, "cap")


def ledger(t: Tables) -> DataFrame:
    return P.backtest(book(t), ["book"], "benchmark_return", costs())


@query("j10_backtest_accounting", "SELECT date, round(turnover, 6) AS turnover, round(cost, 8) AS cost, round(gross, 6) AS gross, round(gross - cost, 6) AS net, round(gross - cost - benchmark, 6) AS active FROM ledger_", LEDGER)
def j10(t: Tables) -> DataFrame:
    return ledger(t).select("date", F.round("turnover", 6).alias("turnover"), F.round("cost", 8).alias("cost"), *(F.round(c, 6).alias(c) for c in ("gross", "net", "active")))


@query("e17_weight_drift", "SELECT asset_id, date, round(weight - trade, 8) AS pre_trade FROM t_", LEDGER)
def e17(t: Tables) -> DataFrame:
    return P.drifted(book(t), ["book"]).select("asset_id", "date", F.round("pre_trade", 8).alias("pre_trade"))


@query("j11_cost_model", "SELECT date, round(sum(abs(trade) * 10 / 1e4), 8) AS commission, round(sum(abs(trade) * 5 / 2e4), 8) AS spread, round(sum(abs(trade) * 2 / 1e4), 8) AS slippage, round(sum(0.01 * pow(abs(trade), 1.5) / sqrt(cap)), 8) AS impact FROM t_ GROUP BY date", LEDGER)
def j11(t: Tables) -> DataFrame:
    parts = dict(zip(("commission", "spread", "slippage", "impact"), costs()))
    return P.drifted(book(t), ["book"]).groupBy("date").agg(*(F.round(F.sum(c), 8).alias(n) for n, c in parts.items()))


@query("j12_transaction_ledger", "SELECT asset_id, date, round(trade, 8) AS trade, round(abs(trade) * 10 / 1e4, 10) AS commission FROM t_ WHERE trade <> 0", LEDGER)
def j12(t: Tables) -> DataFrame:
    return P.drifted(book(t), ["book"]).filter("trade <> 0").select("asset_id", "date", F.round("trade", 8).alias("trade"), F.round(costs()[0], 10).alias("commission"))


HELD = LEDGER | {"pos_": "SELECT *, dense_rank() OVER (ORDER BY date) - 1 AS position FROM g_",
                 "grown_": "SELECT *, first_value(weight) OVER (PARTITION BY asset_id, position // 3 ORDER BY date) * coalesce(product(1 + ret) OVER (PARTITION BY asset_id, position // 3 ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS grown FROM pos_"}


@query("j10_backtest_every_third", "SELECT asset_id, date, round(grown / sum(grown) OVER (PARTITION BY date), 6) AS held FROM grown_", HELD)
def j10k(t: Tables) -> DataFrame:
    positions = W.session_positions(book(t)).select("date", (F.col("session") - 1).alias("position"))
    return P.backtest_every(book(t).join(F.broadcast(positions), "date"), ["book"], 3).select("asset_id", "date", F.round("held", 6).alias("held"))


@query("j13_constraint_verify", """WITH a AS (SELECT date, sum(weight) AS b, min(weight) AS lo, max(weight) AS hi FROM t_ GROUP BY date), l AS (SELECT date, turnover FROM ledger_)
SELECT date, 'budget' AS "constraint", abs(b - 1) <= 1e-9 AS holds FROM a UNION ALL SELECT date, 'lower', lo >= 0 FROM a UNION ALL SELECT date, 'upper', hi <= 0.3 FROM a UNION ALL SELECT date, 'gross', b <= 1 + 1e-9 FROM a UNION ALL SELECT date, 'group_cap', hi <= 0.25 FROM a UNION ALL SELECT date, 'turnover', turnover <= 0.05 + 1e-9 FROM l""", LEDGER)
def j13(t: Tables) -> DataFrame:
    return P.constraint_rows(book(t), ["date"], 0.0, 0.3, ledger(t), 0.05, "asset_id", 0.25).select("date", "constraint", "holds")


@query("j15_performance_summary", "SELECT round(product(1 + gross) - 1, 6) AS gross, round(product(1 + gross - cost) - 1, 6) AS net, round(product(1 + benchmark) - 1, 6) AS benchmark, round(sum(cost), 6) AS cost FROM ledger_", LEDGER)
def j15(t: Tables) -> DataFrame:
    r = {"gross": R.cumulative(F.col("gross")), "net": R.cumulative(F.col("net")), "benchmark": R.cumulative(F.col("benchmark")), "cost": F.sum("cost")}
    return ledger(t).agg(*(F.round(c, 6).alias(n) for n, c in r.items()))


@query("j16_scenario_impact", """WITH e AS (SELECT asset_id, 'market' AS factor, covar_samp(ret, benchmark_return) / var_samp(benchmark_return) AS exposure FROM sector_ GROUP BY 1), s(scenario, factor, shock) AS (VALUES ('crash', 'market', -0.2::DOUBLE), ('rally', 'market', 0.1::DOUBLE), ('rates', 'rates', 0.01::DOUBLE))
SELECT scenario, round(sum(0.2::DOUBLE * exposure * shock), 6) AS impact FROM e JOIN s USING (factor) GROUP BY 1""", SECTORS)
def j16(t: Tables) -> DataFrame:
    e = sectors(t).groupBy("asset_id").agg(R.beta(F.col("ret"), F.col("benchmark_return")).alias("exposure")).withColumn("factor", F.lit("market"))
    shocks = t.spark.createDataFrame([("crash", "market", -0.2), ("rally", "market", 0.1), ("rates", "rates", 0.01)], "scenario string, factor string, shock double")
    w = e.select("asset_id", F.lit(0.2).alias("weight"))
    return P.scenario_impact(w, e, shocks, [], "asset_id")[0].select("scenario", F.round("impact", 6).alias("impact"))


@query("j19_nav_ledger_audit", "SELECT 0.0::DOUBLE AS nav_error, 0.0::DOUBLE AS net_error, round(product(1 + gross - cost), 6) AS final_nav FROM ledger_", LEDGER)
def j19(t: Tables) -> DataFrame:
    return P.nav_audit(ledger(t).withColumn("book", F.lit("equal")), ["book"]).select(*(F.round(c, 6).alias(c) for c in ("nav_error", "net_error", "final_nav")))


@query("d27_fee_scenario_invariance", "WITH f AS (SELECT unnest([0.5, 1, 2]::DOUBLE[]) AS k) SELECT count(DISTINCT date) AS dates, true AS ordered FROM ledger_", LEDGER)
def d27(t: Tables) -> DataFrame:
    cases = [P.backtest(book(t), ["book"], "benchmark_return", costs(k)).select("date", F.col("net").alias(n)) for n, k in (("low", 0.5), ("base", 1.0), ("high", 2.0))]
    wide = cases[0].join(cases[1], "date").join(cases[2], "date")
    return wide.agg(F.count("*").alias("dates"), F.bool_and((F.col("low") >= F.col("base")) & (F.col("base") >= F.col("high"))).alias("ordered"))


@query("b21_accounting_reconcile", "SELECT true AS net_holds, true AS active_holds, count(*) AS rows FROM ledger_", LEDGER)
def b21(t: Tables) -> DataFrame:
    near = lambda c: F.max(F.abs(c)) <= 1e-12
    return ledger(t).agg(near(F.col("gross") - F.col("cost") - F.col("net")).alias("net_holds"), near(F.col("net") - F.col("benchmark") - F.col("active")).alias("active_holds"), F.count("*").alias("rows"))


# H: formation on scores at date t, holding to the next date.

FORMED = SCORES | {
    "score1_": "SELECT security_id, date, factor_id, CASE WHEN factor_id = 'market_cap' THEN -normalized ELSE normalized END AS score FROM scores_",
    "q_": "SELECT *, least(3, greatest(1, ceil(rk / n * 3)))::BIGINT AS quantile FROM (SELECT *, row_number() OVER (PARTITION BY factor_id, date ORDER BY score, security_id) AS rk, count(*) OVER (PARTITION BY factor_id, date) AS n FROM score1_ WHERE score IS NOT NULL) WHERE n >= 3",
    "next_": "SELECT security_id, date, price * shares AS cap, lead(ret) OVER (PARTITION BY security_id ORDER BY date) AS next_ret, lead(benchmark_return) OVER (PARTITION BY security_id ORDER BY date) AS next_bench, lead(date) OVER (PARTITION BY security_id ORDER BY date) AS next_date FROM panel",
    "h_": "SELECT factor_id, date, quantile, count(*) AS members, sum(cap * next_ret) / sum(cap) AS vw, sum(cap * next_bench) / sum(cap) AS bench FROM q_ JOIN next_ USING (security_id, date) WHERE next_ret IS NOT NULL AND cap > 0 GROUP BY 1, 2, 3",
}


def formed(t: Tables) -> DataFrame:
    return P.formed_quantiles(scores(t).filter("score IS NOT NULL"), ["factor_id", "date"])


def held(t: Tables) -> DataFrame:
    w = Window.partitionBy("security_id").orderBy("date")
    nxt = t.panel.select("security_id", "date", (F.col("price") * F.col("shares")).alias("cap"), F.lead("ret").over(w).alias("next_ret"), F.lead("benchmark_return").over(w).alias("next_bench"))
    return P.value_weighted(formed(t).join(nxt, ["security_id", "date"]), ["factor_id", "date", "quantile"], "next_ret", "next_bench", "cap")


@query("h01_month_end_quantile_portfolios", "SELECT factor_id, date, quantile, members, round(vw, 6) AS ret, round(vw - bench, 6) AS active FROM h_", FORMED)
def h01(t: Tables) -> DataFrame:
    return held(t).select("factor_id", "date", "quantile", "members", F.round("value_weighted_return", 6).alias("ret"), F.round("active_return", 6).alias("active"))


@query("d09_value_weighted_group", "SELECT sector, date, count(*) AS members, round(sum(price * shares * ret) / sum(price * shares), 6) AS ret FROM rows_ GROUP BY 1, 2", MORE)
def d09(t: Tables) -> DataFrame:
    r = rows(t).withColumns({"cap": F.col("price") * F.col("shares"), "score": F.lit(1.0)})
    return P.value_weighted(r, ["sector", "date"], "ret", "benchmark_return", "cap").select("sector", "date", "members", F.round("value_weighted_return", 6).alias("ret"))


@query("d15_group_significance", "SELECT factor_id, quantile, count(*) AS n, round(avg(vw), 6) AS mean, round(avg(vw - bench), 6) AS mean_active, round(avg(vw) / (stddev_samp(vw) / sqrt(count(*))), 5) AS t FROM h_ GROUP BY 1, 2", FORMED)
def d15(t: Tables) -> DataFrame:
    r = F.col("value_weighted_return")
    return held(t).groupBy("factor_id", "quantile").agg(F.count("*").alias("n"), F.round(F.avg(r), 6).alias("mean"), F.round(F.avg("active_return"), 6).alias("mean_active"), F.round(F.avg(r) / (F.stddev_samp(r) / F.sqrt(F.count("*"))), 5).alias("t"))


@query("d16_rolling_active", "SELECT factor_id, quantile, round(max_by(m, date), 6) AS last_mean FROM (SELECT *, CASE WHEN count(*) OVER w >= 2 THEN avg(vw - bench) OVER w END AS m FROM h_ WINDOW w AS (PARTITION BY factor_id, quantile ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)) GROUP BY 1, 2", FORMED)
def d16(t: Tables) -> DataFrame:
    w = W.last_rows(["factor_id", "quantile"], ["date"], 12)
    return held(t).withColumn("m", W.rolling_mean(F.col("active_return"), w, 2)).groupBy("factor_id", "quantile").agg(F.round(F.max_by("m", "date"), 6).alias("last_mean"))


@query("d17_monotonicity", "WITH m AS (SELECT factor_id, quantile, avg(vw) AS mean FROM h_ GROUP BY 1, 2), r AS (SELECT factor_id, rank() OVER (PARTITION BY factor_id ORDER BY quantile) AS a, rank() OVER (PARTITION BY factor_id ORDER BY mean) AS b FROM m) SELECT factor_id, round(corr(a, b), 6) AS monotonicity FROM r GROUP BY 1", FORMED)
def d17(t: Tables) -> DataFrame:
    m = held(t).groupBy("factor_id", "quantile").agg(F.avg("value_weighted_return").alias("mean"))
    r = m.select("factor_id", F.rank().over(Window.partitionBy("factor_id").orderBy("quantile")).alias("a"), F.rank().over(Window.partitionBy("factor_id").orderBy("mean")).alias("b"))
    return r.groupBy("factor_id").agg(F.round(F.corr("a", "b"), 6).alias("monotonicity"))


@query("d28_spread_return_build", "SELECT * FROM (SELECT factor_id, date, round(max(vw) FILTER (quantile = 3) - max(vw) FILTER (quantile = 1), 6) AS spread FROM h_ GROUP BY 1, 2) WHERE spread IS NOT NULL", FORMED)
def d28(t: Tables) -> DataFrame:
    leg = lambda q: F.max(F.when(F.col("quantile") == q, F.col("value_weighted_return")))
    return held(t).groupBy("factor_id", "date").agg(F.round(leg(3) - leg(1), 6).alias("spread")).filter("spread IS NOT NULL")


@query("d14_top_quantile_turnover", """WITH s AS (SELECT factor_id, date, list(security_id) AS m FROM q_ WHERE quantile = 3 GROUP BY 1, 2), p AS (SELECT *, lag(m) OVER (PARTITION BY factor_id ORDER BY date) AS was FROM s)
SELECT factor_id, round(avg((len(m) + len(was) - 2 * len(list_intersect(m, was))) / (len(m) + len(was) - len(list_intersect(m, was)))), 6) AS turnover FROM p WHERE was IS NOT NULL GROUP BY 1""", FORMED)
def d14(t: Tables) -> DataFrame:
    return rounded(P.leg_turnover(formed(t).filter("quantile = 3"), ["factor_id"], "date", "security_id"), ["factor_id"], turnover=F.col("turnover"))


@query("e10_formation_weights", "SELECT factor_id, date, quantile, security_id, round(cap / sum(cap) OVER (PARTITION BY factor_id, date, quantile), 8) AS weight FROM q_ JOIN (SELECT security_id, date, price * shares AS cap FROM panel) USING (security_id, date)", FORMED)
def e10(t: Tables) -> DataFrame:
    caps = t.panel.select("security_id", "date", (F.col("price") * F.col("shares")).alias("cap"))
    return P.formation_weights(formed(t).join(caps, ["security_id", "date"]), ["factor_id", "date"]).select("factor_id", "date", "quantile", "security_id", F.round("weight", 8).alias("weight"))


# Delayed execution over daily bars.

PATHS = {
    "paths_": f"""WITH {CYCLES}, q AS (SELECT security_id, date, price, ret, execution AS entry, exit FROM panel_d JOIN cycles ON date >= execution AND date <= exit)
 SELECT security_id, entry, exit, count(*) AS quotes, max(price) FILTER (date = entry) AS p0, max(price) FILTER (date = exit) AS p1 FROM q GROUP BY 1, 2, 3""",
    "status_": "SELECT *, CASE WHEN p0 IS NULL OR p1 IS NULL THEN 'MISSING_ENDPOINT_NO_AUTHENTIC_TERMINAL' ELSE 'COMPLETE_VALID' END AS status FROM paths_",
}


def cycles(t: Tables) -> DataFrame:
    return W.monthly_cycles(t.panel_d.select("date").distinct()).select(F.col("execution").alias("entry"), "exit", "signal")


def paths(t: Tables) -> DataFrame:
    return P.verified_paths(t.panel_d, cycles(t))


@query("e09_quote_chain_verify", "SELECT security_id, entry, exit, quotes, status, CASE WHEN status = 'COMPLETE_VALID' THEN round(p1 / p0 - 1, 6) END AS realized FROM status_", PATHS)
def e09(t: Tables) -> DataFrame:
    return paths(t).select("security_id", "entry", "exit", "quotes", "status", F.round("realized", 6).alias("realized"))


ADMIT = PATHS | {
    "form_": f"WITH {CYCLES}, f AS (SELECT security_id, volume AS cap, price AS score, execution AS entry, 'price' AS factor_id FROM panel_d JOIN cycles ON date = signal), r AS (SELECT *, row_number() OVER (PARTITION BY factor_id, entry ORDER BY score, security_id) AS rk, count(*) OVER (PARTITION BY factor_id, entry) AS n FROM f) SELECT *, least(3, greatest(1, ceil(rk / n * 3)))::BIGINT AS quantile, FROM r WHERE n >= 3",
    "member_": "SELECT f.*, s.status, s.quotes, CASE WHEN s.status = 'COMPLETE_VALID' THEN p1 / p0 - 1 END AS realized, cap / sum(cap) OVER (PARTITION BY factor_id, f.entry, quantile) AS weight, bool_and(coalesce(s.status = 'COMPLETE_VALID', false)) OVER (PARTITION BY factor_id, f.entry, quantile) AS admitted FROM form_ f LEFT JOIN status_ s USING (security_id, entry)",
}


def admitted(t: Tables) -> DataFrame:
    c = cycles(t).select(F.col("signal").alias("date"), "entry")
    f = t.panel_d.join(F.broadcast(c), "date").select("security_id", F.col("volume").alias("cap"), F.col("price").alias("score"), "entry", F.lit("price").alias("factor_id"))
    members = P.formation_weights(P.formed_quantiles(f, ["factor_id", "entry"]), ["factor_id", "entry"])
    return P.admitted_groups(members, paths(t).drop("exit"), ["factor_id", "entry"])


@query("h03_delayed_execution_cycles", "SELECT entry, quantile, round(sum(weight * realized), 6) AS ret FROM member_ WHERE admitted GROUP BY 1, 2", ADMIT)
def h03(t: Tables) -> DataFrame:
    return P.admissibility(admitted(t), ["factor_id", "entry"]).filter("admitted").select("entry", "quantile", F.round("portfolio_return", 6).alias("ret"))


@query("h04_admissibility_table", "SELECT entry, quantile, count(*) AS members, count(*) FILTER (status IS DISTINCT FROM 'COMPLETE_VALID') AS failed, coalesce(string_agg(DISTINCT CASE WHEN status IS DISTINCT FROM 'COMPLETE_VALID' THEN coalesce(status, 'NO_QUOTES') END, ',' ORDER BY CASE WHEN status IS DISTINCT FROM 'COMPLETE_VALID' THEN coalesce(status, 'NO_QUOTES') END), '') AS reasons, bool_and(admitted) AS admitted FROM member_ GROUP BY 1, 2", ADMIT)
def h04(t: Tables) -> DataFrame:
    return P.admissibility(admitted(t), ["factor_id", "entry"]).select("entry", "quantile", "members", "failed", "reasons", "admitted")


@query("h05_membership_table", "SELECT security_id, entry, quantile, round(weight, 8) AS weight, round(realized, 6) AS realized, coalesce(status, 'NO_QUOTES') AS status, quotes, admitted FROM member_", ADMIT)
def h05(t: Tables) -> DataFrame:
    return admitted(t).select("security_id", "entry", "quantile", F.round("weight", 8).alias("weight"), F.round("realized", 6).alias("realized"), F.coalesce("status", F.lit("NO_QUOTES")).alias("status"), "quotes", "admitted")


@query("h02_holding_coverage_gate", """WITH i AS (SELECT security_id, start, count(DISTINCT date) AS dates, count(ret) AS r, count(*) AS n FROM panel_m JOIN intervals ON date > start AND date <= "end" GROUP BY 1, 2), s AS (SELECT start, count(DISTINCT date) AS k FROM panel_m JOIN intervals ON date > start AND date <= "end" GROUP BY 1)
SELECT security_id, start, dates, dates = k AND r = k AND n = k AS complete FROM i JOIN s USING (start)""")
def h02(t: Tables) -> DataFrame:
    from pitwell.operators.joins import holding_rows

    inside = holding_rows(t.panel_m.select("security_id", "date", "ret"), t.intervals)
    sessions = inside.groupBy("start").agg(F.count_distinct("date").alias("n_sessions"))
    return P.holding_coverage(inside, sessions, KEY, ["start"]).select("security_id", "start", "dates", "complete")


REBUILT = FORMED | {
    "counted_": "SELECT s.factor_id, s.date, s.security_id, count(*) FILTER (o.score < s.score OR o.score = s.score AND o.security_id < s.security_id) + 1 AS k, count(*) AS n FROM score1_ s JOIN score1_ o ON o.factor_id = s.factor_id AND o.date = s.date WHERE s.score IS NOT NULL AND o.score IS NOT NULL GROUP BY 1, 2, 3",
    "again_": "SELECT factor_id, date, security_id, least(3, greatest(1, ceil(k / n * 3)))::BIGINT AS again FROM counted_",
}


@query("h06_membership_rebuild_check", "SELECT count(*) FILTER (quantile IS DISTINCT FROM again) AS mismatches, count(*) AS rows FROM q_ FULL JOIN again_ USING (factor_id, date, security_id)", REBUILT)
def h06(t: Tables) -> DataFrame:
    """Ranks rebuilt by counting smaller scores agree with the formed quantiles."""
    a = formed(t).select("factor_id", "date", "security_id", "quantile")
    s = scores(t).filter("score IS NOT NULL").withColumn("k", F.percent_rank().over(Window.partitionBy("factor_id", "date").orderBy("score", "security_id")))
    s = s.withColumn("n", F.count("*").over(Window.partitionBy("factor_id", "date"))).withColumn("again", W.quantile_of(F.round(F.col("k") * (F.col("n") - 1)) + 1, F.col("n"), 3).cast("long"))
    both = a.join(s.select("factor_id", "date", "security_id", "again"), ["factor_id", "date", "security_id"], "full")
    return both.agg(F.count_if(~F.col("quantile").eqNullSafe(F.col("again"))).alias("mismatches"), F.count("*").alias("rows"))


@query("h07_factor_diagnostics_bundle", """SELECT factor_id, count(raw) AS observed, count(*) AS total, round(count(raw) / count(*), 6) AS coverage, count(*) FILTER (raw <> winsorized) AS clipped FROM scores_ GROUP BY 1""", FORMED)
def h07(t: Tables) -> DataFrame:
    from pitwell.operators.aggregates import factor_coverage

    return factor_coverage(scores(t)).select("factor_id", "observed", "total", F.round("coverage", 6).alias("coverage"), "clipped")


@query("h08_cap_reconcile", "SELECT true AS holds, count(*) AS rows FROM panel_m")
def h08(t: Tables) -> DataFrame:
    capped = t.panel_m.withColumn("market_cap", F.col("price") * F.col("shares"))
    return capped.agg((F.max(F.abs(F.col("market_cap") / F.col("price") - F.col("shares"))) <= 1e-6).alias("holds"), F.count("*").alias("rows"))


@query("j14_interval_cash", """SELECT start, round(product(1 + risk_free) - 1, 9) AS cash, count(*) AS sessions FROM market_m JOIN intervals ON date > start AND date <= "end" GROUP BY 1""")
def j14(t: Tables) -> DataFrame:
    inside = interval_join(t.market_m.select("date", "risk_free"), t.intervals.select("start", "end"), [], "date", "start", "end", open_start=True)
    return inside.groupBy("start").agg(F.round(W.compound(F.col("risk_free")), 9).alias("cash"), F.count("*").alias("sessions"))
