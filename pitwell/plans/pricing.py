"""Queries of the regression operators (I) and the tables built on fits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitwell.operators import aggregates as A
from pitwell.operators import portfolios as P
from pitwell.operators import regress as R
from pitwell.operators import windows as W
from pitwell.operators.characteristics import characteristics
from pitwell.operators.joins import interval_join, reconcile
from pitwell.operators.storage import settled
from pitwell.plans.features import ASOF, F_SQL, H, rounded, wide_panel
from pitwell.plans.portfolio import FORMED, MORE, formed, held, rows
from pitwell.plans.registry import query, register
from pitwell.plans.tables import Tables

S, X = ["security_id"], ["market_return"]
FIT = MORE | {
    "m_": "SELECT security_id, count(*) AS n, avg(market_return) AS mx, var_pop(market_return) * count(*) AS sxx, regr_slope(ret, market_return) AS b, regr_intercept(ret, market_return) AS a, regr_r2(ret, market_return) AS r2 FROM rows_ GROUP BY 1",
    "e_": "SELECT r.*, m.n, mx, sxx, a, b, r2, ret - a - b * market_return AS e, 1 / m.n + pow(market_return - mx, 2) / sxx AS h FROM rows_ r JOIN m_ m USING (security_id)",
}


def fits(t: Tables) -> DataFrame:
    return R.ols_fit(rows(t), S, "ret", X)


def resid(t: Tables) -> DataFrame:
    return R.residuals(rows(t), fits(t), S, "ret", X)


@query("i01_holding_period_market", 'SELECT start, round(product(1 + market_return) - 1, 6) AS market, round(product(1 + risk_free) - 1, 6) AS cash, round(product(1 + market_return) - product(1 + risk_free), 6) AS excess FROM market_m JOIN intervals ON date > start AND date <= "end" GROUP BY 1')
def i01(t: Tables) -> DataFrame:
    inside = interval_join(t.market_m, t.intervals, [], "date", "start", "end", open_start=True)
    out = inside.groupBy("start").agg(W.compound(F.col("market_return")).alias("m"), W.compound(F.col("risk_free")).alias("c"))
    return rounded(out, ["start"], market=F.col("m"), cash=F.col("c"), excess=F.col("m") - F.col("c"))


SPREADS = ", ".join(f"max(vw) FILTER (factor_id = '{f}' AND quantile = 3) - max(vw) FILTER (factor_id = '{f}' AND quantile = 1) AS {f}" for f in ("market_cap", "momentum_1m", "turnover"))
PANEL = f"WITH s AS (SELECT date, {SPREADS} FROM h_ GROUP BY 1) SELECT factor_id || ':Q' || quantile AS asset, date, round(vw, 6) AS ret, market_return, benchmark_return, risk_free, round(market_cap, 6) AS market_cap, round(momentum_1m, 6) AS momentum_1m, round(turnover, 6) AS turnover, round(vw - risk_free, 6) AS excess_return FROM h_ JOIN market_m USING (date) JOIN s USING (date)"


@query("i02_research_panel", PANEL, FORMED)
def i02(t: Tables) -> DataFrame:
    """Assets factor:Qk with the market and the spreads of the factors as columns."""
    h = held(t)
    leg = lambda q: F.max(F.when(F.col("quantile") == q, F.col("value_weighted_return")))
    spreads = h.groupBy("factor_id", "date").agg((leg(3) - leg(1)).alias("s")).groupBy("date").pivot("factor_id", ["market_cap", "momentum_1m", "turnover"]).agg(F.first("s"))
    assets = h.select(F.concat_ws(":Q", "factor_id", "quantile").alias("asset"), "date", F.col("value_weighted_return").alias("ret"))
    out = assets.join(t.market_m, "date").join(spreads, "date").withColumn("excess_return", F.col("ret") - F.col("risk_free"))
    return out.withColumns({c: F.round(c, 6) for c in ("ret", "market_cap", "momentum_1m", "turnover", "excess_return")})


@query("i03_model_registry", "SELECT * FROM (VALUES ('CAPM', 1), ('FF3', 3), ('CARHART4', 4), ('FF5', 5), ('Q', 4)) v(model_id, regressors), (SELECT count(DISTINCT date) AS dates FROM market_m)")
def i03(t: Tables) -> DataFrame:
    models = t.spark.createDataFrame([(k, len(v)) for k, v in R.MODELS.items()], "model_id string, regressors long")
    return t.market_m.agg(F.count_distinct("date").alias("dates")).crossJoin(F.broadcast(models))


@query("i04_ols_fit", "SELECT security_id, n, round(a, 6) AS alpha, round(b, 6) AS beta, round(r2, 6) AS r2, round(1 - (1 - r2) * (n - 1) / (n - 2), 6) AS adj_r2 FROM m_", FIT)
def i04(t: Tables) -> DataFrame:
    return fits(t).select("security_id", "n", F.round(F.get("beta", F.lit(0)), 6).alias("alpha"), F.round(F.get("beta", F.lit(1)), 6).alias("beta"), F.round("r2", 6).alias("r2"), F.round("adj_r2", 6).alias("adj_r2"))


@query("i05_wls_fit", "SELECT security_id, round((sum(volume * market_return * ret) - sum(volume * market_return) * sum(volume * ret) / sum(volume)) / (sum(volume * market_return * market_return) - pow(sum(volume * market_return), 2) / sum(volume)), 6) AS beta FROM rows_ GROUP BY 1", MORE)
def i05(t: Tables) -> DataFrame:
    return R.ols_fit(rows(t), S, "ret", X, weight="volume").select("security_id", F.round(F.get("beta", F.lit(1)), 6).alias("beta"))


def slope_se(t: Tables, kind: str, lags: int = 3) -> DataFrame:
    c = R.covariance(rows(t), fits(t), S, "ret", X, kind, lags)
    return c.select("security_id", F.round(F.sqrt(F.get("cov", F.lit(3))), 6).alias("se"))


register("i06_cov_nonrobust", lambda t: slope_se(t, "nonrobust"), "SELECT security_id, round(sqrt(sum(e * e) / (max(n) - 2) / max(sxx)), 6) AS se FROM e_ GROUP BY 1", FIT)
for _kind, _scale in (("hc0", "1"), ("hc1", "n / (n - 2)"), ("hc2", "1 / (1 - h)"), ("hc3", "1 / pow(1 - h, 2)")):
    register(f"i06_cov_{_kind}", (lambda k: lambda t: slope_se(t, k.upper()))(_kind), f"SELECT security_id, round(sqrt(sum(e * e * pow(market_return - mx, 2) * {_scale})) / max(sxx), 6) AS se FROM e_ GROUP BY 1", FIT)


def hac_sql(lags: int, name: str = "se") -> str:
    terms = "".join(f" + 2 * (1 - {k} / {lags + 1}) * coalesce(sum(u * l{k}), 0)" for k in range(1, lags + 1))
    return f"SELECT security_id, round(sqrt((sum(u * u){terms}) * max(n) / (max(n) - 2)) / max(sxx), 6) AS {name} FROM lag_ GROUP BY 1"


HAC = FIT | {"u_": "SELECT *, (market_return - mx) * e AS u FROM e_", "lag_": "SELECT *, " + ", ".join(f"lag(u, {k}) OVER (PARTITION BY security_id ORDER BY date) AS l{k}" for k in range(1, 7)) + " FROM u_"}
register("i07_cov_hac", lambda t: slope_se(t, "HAC", 3), hac_sql(3), HAC)


@query("i08_coefficient_table", "SELECT security_id, 'market_return' AS term, round(max(b), 6) AS estimate, round(sqrt(sum(e * e) / (max(n) - 2) / max(sxx)), 6) AS se, round(max(b) / sqrt(sum(e * e) / (max(n) - 2) / max(sxx)), 4) AS t FROM e_ GROUP BY 1", FIT)
def i08(t: Tables) -> DataFrame:
    c = R.coefficients(R.covariance(rows(t), fits(t), S, "ret", X), S, ["const", "market_return"])
    return c.filter("term = 'market_return'").select("security_id", "term", F.round("estimate", 6).alias("estimate"), F.round("se", 6).alias("se"), F.round("t", 4).alias("t"))


def window_beta(size):
    def build(t: Tables) -> DataFrame:
        return R.window_regression(rows(t), S, "date", "ret", X, size, 12).select("security_id", "date", "n", F.round(F.get("beta", F.lit(1)), 5).alias("beta"))

    return build


for _n, _size, _frame in (("i09_rolling_regression", 24, "23 PRECEDING"), ("i10_expanding_regression", None, "UNBOUNDED PRECEDING")):
    register(_n, window_beta(_size), f"SELECT * FROM (SELECT security_id, date, count(*) OVER w AS n, round(regr_slope(ret, market_return) OVER w, 5) AS beta FROM rows_ WINDOW w AS (PARTITION BY security_id ORDER BY date ROWS BETWEEN {_frame} AND CURRENT ROW)) WHERE n >= 12", MORE)

WINDOWED = MORE | {
    "numbered_": "SELECT security_id, date, ret, market_return, row_number() OVER (PARTITION BY security_id ORDER BY date) AS i FROM rows_",
    "w_": "SELECT e.date AS wend, r.* FROM numbered_ e JOIN numbered_ r ON r.security_id = e.security_id AND r.i BETWEEN e.i - 23 AND e.i",
    "wm_": "SELECT security_id, wend, count(*) AS n, avg(market_return) AS mx, var_pop(market_return) * count(*) AS sxx, regr_slope(ret, market_return) AS b, regr_intercept(ret, market_return) AS a FROM w_ GROUP BY 1, 2 HAVING count(*) >= 12",
    "wu_": "SELECT *, (market_return - mx) * (ret - a - b * market_return) AS u FROM w_ JOIN wm_ USING (security_id, wend)",
    "wl_": "SELECT *, " + ", ".join(f"lag(u, {k}) OVER (PARTITION BY security_id, wend ORDER BY date) AS l{k}" for k in (1, 2, 3)) + " FROM wu_",
}


@query("i09_rolling_hac", 'SELECT security_id, wend AS "end", max(n) AS n, round(max(b), 5) AS beta, round(sqrt(greatest((sum(u * u) + 1.5 * sum(u * l1) + sum(u * l2) + 0.5 * sum(u * l3)) * max(n) / (max(n) - 2), 0)) / max(sxx), 5) AS se FROM wl_ GROUP BY 1, 2', WINDOWED)
def i09_hac(t: Tables) -> DataFrame:
    found = R.window_slope(rows(t), S, "date", "ret", X[0], 24, 12)
    return found.select("security_id", "end", "n", F.round("beta", 5).alias("beta"), F.round("se", 5).alias("se"))


@query("i11_panel_fixed_effects", "SELECT count(*) AS n, round(sum(x * y) / sum(x * x), 6) AS slope FROM (SELECT ret - avg(ret) OVER (PARTITION BY security_id) AS y, turn - avg(turn) OVER (PARTITION BY security_id) AS x FROM (SELECT *, ln(volume) AS turn FROM rows_))", MORE)
def i11(t: Tables) -> DataFrame:
    d = R.within(rows(t).withColumn("turn", F.log("volume")), ["ret", "turn"], "security_id").withColumn("all", F.lit(1))
    return R.ols_fit(d, ["all"], "ret", ["turn"], constant=False).select("n", F.round(F.get("beta", F.lit(0)), 6).alias("slope"))


FM = MORE | {"b_": "SELECT date, regr_slope(ret, ln(volume)) AS b FROM rows_ GROUP BY 1 HAVING count(*) >= 30 AND var_pop(ln(volume)) > 0", "bd_": "SELECT date, b - avg(b) OVER () AS d, avg(b) OVER () AS m FROM b_", "bl_": "SELECT *, lag(d) OVER (ORDER BY date) AS l1, lag(d, 2) OVER (ORDER BY date) AS l2, lag(d, 3) OVER (ORDER BY date) AS l3 FROM bd_"}


@query("i12_fama_macbeth", "SELECT 'turn' AS term, round(max(m), 6) AS estimate, round(sqrt((sum(d * d) + 1.5 * sum(d * l1) + sum(d * l2) + 0.5 * sum(d * l3)) / (count(*) * (count(*) - 1))), 6) AS se FROM bl_", FM)
def i12(t: Tables) -> DataFrame:
    out = R.fama_macbeth(rows(t).withColumn("turn", F.log("volume")), "date", "ret", ["turn"], 30, 3)
    return out.filter("term = 'turn'").select("term", F.round("estimate", 6).alias("estimate"), F.round("se", 6).alias("se"))


register("i13_matched_sample", lambda t: R.complete(t.panel, ["ret", "market_return", "benchmark_return"]).groupBy("security_id").agg(F.count("*").alias("n")), "SELECT security_id, count(*) AS n FROM panel WHERE ret IS NOT NULL GROUP BY 1")


@query("i14_hac_lag_sensitivity", " ".join(f"{'UNION ALL' if k else ''} SELECT security_id, {k} AS lags, se FROM ({hac_sql(k)})" for k in (0, 3, 6)), HAC)
def i14(t: Tables) -> DataFrame:
    out = None
    for k in (0, 3, 6):
        part = slope_se(t, "HAC", k).select("security_id", F.lit(k).cast("long").alias("lags"), "se")
        out = part if out is None else out.unionByName(part)
    return out


@query("i15_vif", "SELECT security_id, round(1 / (1 - pow(corr(market_return, benchmark_return), 2)), 4) AS vif FROM rows_ GROUP BY 1", MORE)
def i15(t: Tables) -> DataFrame:
    return R.vif(rows(t), S, ["market_return", "benchmark_return"]).filter("term = 'market_return'").select("security_id", F.round("vif", 4).alias("vif"))


@query("i16_condition_rank_cov", "SELECT security_id, 2 AS rank, round((1 + abs(c)) / (1 - abs(c)), 3) AS condition FROM (SELECT security_id, corr(market_return, benchmark_return) AS c FROM rows_ GROUP BY 1)", MORE)
def i16(t: Tables) -> DataFrame:
    return R.vif(rows(t), S, ["market_return", "benchmark_return"]).filter("term = 'market_return'").select("security_id", "rank", F.round("condition", 3).alias("condition"))


@query("i17_influence_table", "SELECT security_id, date, round(h, 6) AS leverage, round(e / (s * sqrt(1 - h)), 4) AS studentized, round(pow(e / (s * sqrt(1 - h)), 2) * h / ((1 - h) * 2), 5) AS cooks FROM (SELECT *, sqrt(sum(e * e) OVER (PARTITION BY security_id) / (n - 2)) AS s FROM e_)", FIT)
def i17(t: Tables) -> DataFrame:
    return R.influence(resid(t), 2).select("security_id", "date", F.round("h", 6).alias("leverage"), F.round("studentized", 4).alias("studentized"), F.round("cooks", 5).alias("cooks"))


MOM = "avg(pow(e, 2)) AS m2, avg(pow(e, 3)) AS m3, avg(pow(e, 4)) AS m4, count(*) AS n"


@query("i18_jarque_bera", f"SELECT security_id, round(n / 6 * (pow(m3 / pow(m2, 1.5), 2) + pow(m4 / pow(m2, 2) - 3, 2) / 4), 4) AS jb FROM (SELECT security_id, {MOM} FROM e_ GROUP BY 1)", FIT)
def i18(t: Tables) -> DataFrame:
    return R.jarque_bera(resid(t), S, "e").select("security_id", F.round("jb", 4).alias("jb"))


register("i19_breusch_pagan", lambda t: R.breusch_pagan(resid(t), S, X).select("security_id", F.round("lm", 5).alias("lm")), "SELECT security_id, round(count(*) * regr_r2(e * e, market_return), 5) AS lm FROM e_ GROUP BY 1", FIT)
WHITE = "WITH c AS (SELECT security_id, count(*) AS n, corr(e * e, market_return) AS c1, corr(e * e, pow(market_return, 2)) AS c2, corr(market_return, pow(market_return, 2)) AS c12 FROM e_ GROUP BY 1), l AS (SELECT security_id, n * (c1 * c1 + c2 * c2 - 2 * c1 * c2 * c12) / (1 - c12 * c12) AS lm FROM c WHERE n > 6) SELECT security_id, round(lm, 5) AS lm, round(exp(-lm / 2), 6) AS p FROM l"
register("i20_white_test", lambda t: R.white_test(resid(t), S, X).select("security_id", F.round("lm", 5).alias("lm"), F.round("p", 6).alias("p")), WHITE, FIT)
register("i21_durbin_watson", lambda t: rounded(R.durbin_watson(resid(t), S, "date"), S, 5, dw=F.col("dw")), "SELECT security_id, round(sum(pow(e - l, 2)) / sum(e * e), 5) AS dw FROM (SELECT *, lag(e) OVER (PARTITION BY security_id ORDER BY date) AS l FROM e_) GROUP BY 1", FIT)
LB = ", ".join(f"lag(e, {k}) OVER (PARTITION BY security_id ORDER BY date) AS l{k}" for k in range(1, 6))
register("i22_ljung_box", lambda t: rounded(R.ljung_box(resid(t), S, "date"), S, 4, q=F.col("q")), "SELECT security_id, round(count(*) * (count(*) + 2) * (" + " + ".join(f"pow(sum(e * l{k}) / sum(e * e), 2) / (count(*) - {k})" for k in range(1, 6)) + f"), 4) AS q FROM (SELECT *, {LB} FROM e_) GROUP BY 1", FIT)
#: Most lags of the SQL form; series of up to 100 rows need no more.
ADF_LAGS = 12


def adf_sql(fixed: int | None = None) -> dict[str, str]:
    """Views that take the constant, the level and the lagged differences out of dx step by step, then refit with the level last."""
    lags = range(1, ADF_LAGS + 1)
    most = str(fixed) if fixed is not None else f"least(ceil(12 * pow(n / 100, 0.25)), n // 2 - 2, {ADF_LAGS})::BIGINT"
    after = f"n >= {2 * fixed + 5}" if fixed is not None else "most >= 0"
    less = lambda r, x: f"{r} - {x} * coalesce(sum({r} * {x}) OVER w / nullif(sum({x} * {x}) OVER w, 0), 0) AS {r}"
    views = {
        "adfx_": f"SELECT *, {most} AS most FROM (SELECT security_id, row_number() OVER w AS i, count(*) OVER (PARTITION BY security_id) AS n, price - lag(price) OVER w AS y, lag(price) OVER w - first(price) OVER w AS v FROM rows_ WINDOW w AS (PARTITION BY security_id ORDER BY date))",
        "adfd_": f"SELECT * FROM (SELECT *, 1.0::DOUBLE AS c, {', '.join(f'lag(y, {h}) OVER (PARTITION BY security_id ORDER BY i) AS l{h}' for h in lags)} FROM adfx_) WHERE {after}",
        "adf0_": "SELECT security_id, n, most, c, v, y, " + ", ".join(f"CASE WHEN {h} <= most THEN l{h} ELSE 0 END AS d{h}" for h in lags) + " FROM adfd_ WHERE i >= most + 2",
    }
    order, last = ["c", "v", *(f"d{h}" for h in lags)], "adf0_"
    for k, x in enumerate(order):
        views[f"adf{k + 1}_"] = f"SELECT security_id, n, most, {', '.join(less(r, x) for r in ['y', *order[k + 1 :]])} FROM {last} WINDOW w AS (PARTITION BY security_id)"
        last = f"adf{k + 1}_"
    tried = " UNION ALL ".join(f"SELECT security_id, {h}::BIGINT AS lags, count(*) * ln(sum(y * y)) + {2 * h} AS aic FROM adf{h + 2}_ GROUP BY 1 HAVING max(most) >= {h} AND sum(y * y) > 0" for h in [0, *lags])
    views["adfb_"] = f"SELECT security_id, arg_min(lags, (aic, lags)) AS best FROM ({tried}) GROUP BY 1" if fixed is None else f"SELECT DISTINCT security_id, {fixed}::BIGINT AS best FROM adf0_"
    views["adfr0_"] = "SELECT security_id, n, best, c, v, y, " + ", ".join(f"CASE WHEN {h} <= best THEN l{h} ELSE 0 END AS d{h}" for h in lags) + " FROM adfd_ JOIN adfb_ USING (security_id) WHERE i >= best + 2"
    order, last = ["c", *(f"d{h}" for h in lags)], "adfr0_"
    for k, x in enumerate(order):
        views[f"adfr{k + 1}_"] = f"SELECT security_id, n, best, {', '.join(less(r, x) for r in ['y', 'v', *order[k + 1 :]])} FROM {last} WINDOW w AS (PARTITION BY security_id)"
        last = f"adfr{k + 1}_"
    views["adfs_"] = f"SELECT security_id, best AS lags, n - 1 - best AS n_obs, sum(v * y) / sum(v * v) / sqrt((sum(y * y) - pow(sum(v * y), 2) / sum(v * v)) / (n - 1 - best - best - 2) / sum(v * v)) AS statistic FROM {last} GROUP BY 1, 2, 3, n, best HAVING n - 1 - best > best + 2"
    return views


register("i23_adf_unit_root", lambda t: R.adf_test(rows(t), S, "date", "price").select("security_id", "lags", "n_obs", F.round("statistic", 4).alias("statistic")), "SELECT security_id, lags, n_obs, round(statistic, 4) AS statistic FROM adfs_", MORE | adf_sql())
register("i23_adf_fixed_lag", lambda t: R.adf_test(rows(t), S, "date", "price", lags=2).select("security_id", "n_obs", F.round("statistic", 4).alias("statistic")), "SELECT security_id, n_obs, round(statistic, 4) AS statistic FROM adfs_", MORE | adf_sql(2))
register("i24_prediction_interval", lambda t: rounded(resid(t).withColumn("se", F.col("se_resid") * F.sqrt(1 + F.col("h"))), ["security_id", "date"], lower=F.col("fitted") - 1.959963984540054 * F.col("se"), upper=F.col("fitted") + 1.959963984540054 * F.col("se")),
         "SELECT security_id, date, round(a + b * market_return - 1.959963984540054 * s * sqrt(1 + h), 6) AS lower, round(a + b * market_return + 1.959963984540054 * s * sqrt(1 + h), 6) AS upper FROM (SELECT *, sqrt(sum(e * e) OVER (PARTITION BY security_id) / (n - 2)) AS s FROM e_)", FIT)


@query("i25_holm_adjust", "WITH p AS (SELECT security_id, sector, (security_id * 37 % 101) / 1000 AS p FROM panel_m GROUP BY 1, 2), k AS (SELECT *, p * (count(*) OVER (PARTITION BY sector) - row_number() OVER (PARTITION BY sector ORDER BY p, security_id) + 1) AS s FROM p) SELECT security_id, round(least(1, max(s) OVER (PARTITION BY sector ORDER BY p, security_id)), 6) AS p_holm FROM k")
def i25(t: Tables) -> DataFrame:
    p = t.panel_m.select("security_id", "sector").distinct().withColumn("p", (F.col("security_id") * 37 % 101) / 1000)
    return R.holm(p, ["sector"], "p", "security_id").select("security_id", F.round("p_holm", 6).alias("p_holm"))


@query("i26_alpha_sample_table", "SELECT security_id, count(*) AS n, round(max(a), 6) AS alpha, round(sqrt(sum(e * e) / (max(n) - 2) * (1 / max(n) + pow(max(mx), 2) / max(sxx))), 6) AS se FROM e_ GROUP BY 1", FIT)
def i26(t: Tables) -> DataFrame:
    c = R.coefficients(R.covariance(rows(t), fits(t), S, "ret", X), S, ["const", "market_return"]).filter("term = 'const'")
    return c.join(fits(t).select("security_id", "n"), "security_id").select("security_id", "n", F.round("estimate", 6).alias("alpha"), F.round("se", 6).alias("se"))


@query("i27_fit_reconciliation", "SELECT count(DISTINCT security_id) AS fits, true AS agrees FROM rows_", MORE)
def i27(t: Tables) -> DataFrame:
    """Moment-based slopes against the built-in simple regression."""
    a = fits(t).select("security_id", F.get("beta", F.lit(1)).alias("slope"))
    b = rows(t).groupBy("security_id").agg(F.regr_slope("ret", "market_return").alias("slope"))
    return reconcile(a, b, S, ["slope"]).agg(F.count("*").alias("fits"), F.bool_and((F.col("side") == "both") & (F.col("diff_slope") < 1e-8)).alias("agrees"))


REGRESSORS = ["market", "size", "value", "momentum", "profitability", "investment"]
#: Characteristic and sign behind each spread of the models.
BEHIND = {"size": ("market_cap", -1), "value": ("book_to_market", 1), "momentum": ("momentum_12_1m", 1), "profitability": ("roe", 1), "investment": ("asset_growth", -1)}
_TEXT = {name[4:]: sql for name, sql in F_SQL.items()}
_LEGS = ", ".join(f"max(vw) FILTER (factor = '{f}' AND quantile = 3) - max(vw) FILTER (factor = '{f}' AND quantile = 1) AS \"{f}\"" for f in BEHIND)
_ALL = ", ".join(f'"{x}"' for x in REGRESSORS)
PRICED = ASOF | {
    "sorted_": " UNION ALL ".join(f"SELECT security_id, date, '{f}' AS factor, {sign} * ({_TEXT[c]}) AS score FROM wide_" for f, (c, sign) in BEHIND.items()),
    "cut_": "SELECT *, least(3, greatest(1, ceil(rk / n * 3)))::BIGINT AS quantile FROM (SELECT *, row_number() OVER (PARTITION BY factor, date ORDER BY score, security_id) AS rk, count(*) OVER (PARTITION BY factor, date) AS n FROM sorted_ WHERE score IS NOT NULL) WHERE n >= 3",
    "ahead_": "SELECT * FROM (SELECT security_id, date, risk_free, price * shares AS cap, lead(ret) OVER (PARTITION BY security_id ORDER BY date) AS r FROM panel) WHERE r IS NOT NULL AND cap > 0",
    "leg_": "SELECT factor, quantile, date, sum(cap * r) / sum(cap) AS vw FROM cut_ JOIN ahead_ USING (security_id, date) GROUP BY 1, 2, 3",
    "spread_": f"SELECT * FROM (SELECT date, {_LEGS} FROM leg_ GROUP BY 1) JOIN (SELECT date, max(risk_free) AS rf, sum(cap * r) / sum(cap) - max(risk_free) AS market FROM ahead_ GROUP BY 1) USING (date)",
    "pf_": f"SELECT factor || ':Q' || quantile AS asset, date, vw - rf AS y, {_ALL} FROM leg_ JOIN spread_ USING (date) WHERE " + " AND ".join(f'"{x}" IS NOT NULL' for x in REGRESSORS),
}


def orthogonal(prefix: str, xs: list[str], source: str = "pf_", group: str = "asset") -> dict[str, str]:
    """Views prefix1_, prefix2_, ...: the constant c and y less their parts along the first regressors, step by step, in each group."""
    out, last = {}, f"SELECT {group}, date, 1.0::DOUBLE AS c, y, {_ALL} FROM {source}"
    for i, x in enumerate(xs):
        rest = ["c", "y", *(f'"{v}"' for v in xs[i + 1 :])]
        less = ", ".join(f'{r} - "{x}" * (sum({r} * "{x}") OVER w / sum("{x}" * "{x}") OVER w) AS {r}' for r in rest)
        out[f"{prefix}{i + 1}_"] = f"SELECT {group}, date, {less} FROM ({last}) WINDOW w AS (PARTITION BY {group})"
        last = f"SELECT * FROM {prefix}{i + 1}_"
    return out


_FITTED = {"CAPM": ("va1_", 1), "FF3": ("va3_", 3), "CARHART4": ("va4_", 4), "Q": ("vb4_", 4), "FF5": ("vb5_", 5)}
GRID = PRICED | orthogonal("va", ["market", "size", "value", "momentum"]) | orthogonal("vb", ["market", "size", "investment", "profitability", "value"]) | {
    "each_": " UNION ALL ".join(f"SELECT '{m}' AS model, {k} + 1 AS k, asset, date, c, y FROM {v}" for m, (v, k) in _FITTED.items()),
    "alpha_": "SELECT *, y - a * c AS e, c * (y - a * c) / cc AS u FROM (SELECT *, sum(y * c) OVER w / sum(c * c) OVER w AS a, sum(c * c) OVER w AS cc FROM each_ WINDOW w AS (PARTITION BY model, asset))",
    "late_": "SELECT *, " + ", ".join(f"lag(u, {k}) OVER (PARTITION BY model, asset ORDER BY date) AS u{k}" for k in (1, 2, 3)) + " FROM alpha_",
    "grid_": "SELECT model, asset, n, alpha, sqrt(rss / (n - k) / cc) AS se, sqrt(greatest(meat * n / (n - k), 0)) AS hac_se, 1 - rss / tss AS r2, 1 - rss / tss * (n - 1) / (n - k) AS adj_r2 FROM (SELECT model, asset, max(k) AS k, count(*) AS n, max(a) AS alpha, max(cc) AS cc, sum(e * e) AS rss, sum(u * u) + 1.5 * coalesce(sum(u * u1), 0) + coalesce(sum(u * u2), 0) + 0.5 * coalesce(sum(u * u3), 0) AS meat FROM late_ GROUP BY 1, 2) JOIN (SELECT asset, var_pop(y) * count(*) AS tss FROM pf_ GROUP BY 1) USING (asset) WHERE n > 6",
}


def priced(t: Tables) -> DataFrame:
    """asset (spread:Qk), date, y (excess return to the next date) and REGRESSORS: the dates on which all spreads are known."""
    names = {c: f for f, (c, _) in BEHIND.items()}
    wide = characteristics(wide_panel(t), H).select("security_id", "date", *((F.col(c) * sign).alias(names[c]) for c, sign in BEHIND.values()))
    scores = wide.unpivot(["security_id", "date"], list(BEHIND), "factor", "score").filter("score IS NOT NULL")
    ahead = t.panel.withColumns({"cap": F.col("price") * F.col("shares"), "r": F.lead("ret").over(Window.partitionBy("security_id").orderBy("date"))}).filter("r IS NOT NULL AND cap > 0").select("security_id", "date", "risk_free", "cap", "r")
    mean = F.sum(F.col("cap") * F.col("r")) / F.sum("cap")
    legs = P.formed_quantiles(scores, ["factor", "date"]).join(ahead, ["security_id", "date"]).groupBy("factor", "quantile", "date").agg(mean.alias("vw"))
    leg = lambda f, q: F.max(F.when((F.col("factor") == f) & (F.col("quantile") == q), F.col("vw")))
    spreads = legs.groupBy("date").agg(*((leg(f, 3) - leg(f, 1)).alias(f) for f in BEHIND))
    market = ahead.groupBy("date").agg(F.max("risk_free").alias("rf"), (mean - F.max("risk_free")).alias("market"))
    out = legs.join(market, "date").join(spreads, "date").select(F.concat_ws(":Q", "factor", "quantile").alias("asset"), "date", (F.col("vw") - F.col("rf")).alias("y"), *REGRESSORS)
    return out.dropna(subset=REGRESSORS)


def grid_fits(t: Tables, own: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Every formed asset under every registered model and those of the caller's own, on one matched sample."""
    return R.model_fits(priced(t), ["asset"], "y", REGRESSORS, R.registered(own or {}, REGRESSORS)).filter("n > 6")


OWN = {"MARKET_MOMENTUM": ("market", "momentum")}


@query("i29_custom_model", "SELECT 'MARKET_MOMENTUM' AS model, asset, n, round(alpha, 6) AS alpha, round(1 - rss / tss, 6) AS r2 FROM (SELECT asset, count(*) AS n, max(a) AS alpha, sum(pow(y - a * c, 2)) AS rss FROM (SELECT *, sum(y * c) OVER w / sum(c * c) OVER w AS a FROM vo2_ WINDOW w AS (PARTITION BY asset)) GROUP BY 1) JOIN (SELECT asset, var_pop(y) * count(*) AS tss FROM pf_ GROUP BY 1) USING (asset) WHERE n > 6", PRICED | orthogonal("vo", ["market", "momentum"]))
def i29_own(t: Tables) -> DataFrame:
    fits = grid_fits(t, OWN).filter(F.col("model").isin(*OWN))
    return fits.select("model", "asset", "n", F.round(F.get("beta", F.lit(0)), 6).alias("alpha"), F.round("r2", 6).alias("r2"))


@query("i29_pricing_grid", "SELECT model, asset, n, round(alpha, 6) AS alpha, round(se, 6) AS se, round(hac_se, 6) AS hac_se, round(r2, 6) AS r2, round(adj_r2, 6) AS adj_r2 FROM grid_", GRID)
def i29(t: Tables) -> DataFrame:
    """Alphas with classical and HAC errors of all models: moments once an asset, residuals once an asset and model."""
    fits = grid_fits(t)
    rows = priced(t).withColumn("model", F.explode(F.array(*map(F.lit, R.MODELS))))
    robust = R.covariance(rows, fits, ["asset", "model"], "y", REGRESSORS, "HAC", 3)
    se, hac = F.col("se_resid") * F.sqrt(F.get("inv", F.lit(0))), F.sqrt(F.greatest(F.get("cov", F.lit(0)), F.lit(0.0)))
    return robust.select("model", "asset", "n", *(F.round(c, 6).alias(n) for n, c in (("alpha", F.get("beta", F.lit(0))), ("se", se), ("hac_se", hac), ("r2", F.col("r2")), ("adj_r2", F.col("adj_r2")))))


WINDOW_ROWS = 24
_AT = "asset, wend"


def windowed_grid(name: str, size: int | None) -> dict[str, str]:
    """The grid's views with a row for each window and member: orthogonal steps, alphas and their errors by window."""
    span = f"r.i BETWEEN e.i - {size - 1} AND e.i" if size else "r.i <= e.i"
    views = {
        f"{name}i_": "SELECT *, row_number() OVER (PARTITION BY asset ORDER BY date) AS i FROM pf_",
        f"{name}w_": f"SELECT e.asset, e.date AS wend, r.date, r.y, {', '.join('r.' + chr(34) + x + chr(34) for x in REGRESSORS)} FROM {name}i_ e JOIN {name}i_ r ON r.asset = e.asset AND {span} WHERE e.i >= {WINDOW_ROWS}",
    }
    views |= orthogonal(f"{name}a", ["market", "size", "value", "momentum"], f"{name}w_", _AT) | orthogonal(f"{name}b", ["market", "size", "investment", "profitability", "value"], f"{name}w_", _AT)
    fitted = {m: (v.replace("v", name, 1), k) for m, (v, k) in _FITTED.items()}
    views[f"{name}e_"] = " UNION ALL ".join(f"SELECT '{m}' AS model, {k} + 1 AS k, {_AT}, date, c, y FROM {v}" for m, (v, k) in fitted.items())
    views[f"{name}u_"] = f"SELECT *, y - a * c AS e, c * (y - a * c) / cc AS u FROM (SELECT *, sum(y * c) OVER w / sum(c * c) OVER w AS a, sum(c * c) OVER w AS cc FROM {name}e_ WINDOW w AS (PARTITION BY model, {_AT}))"
    views[f"{name}l_"] = "SELECT *, " + ", ".join(f"lag(u, {k}) OVER (PARTITION BY model, {_AT} ORDER BY date) AS u{k}" for k in (1, 2, 3)) + f" FROM {name}u_"
    views[f"{name}g_"] = f"SELECT model, {_AT}, n, alpha, sqrt(greatest(meat * n / (n - k), 0)) AS se, 1 - rss / tss AS r2 FROM (SELECT model, {_AT}, max(k) AS k, count(*) AS n, max(a) AS alpha, sum(e * e) AS rss, sum(u * u) + 1.5 * coalesce(sum(u * u1), 0) + coalesce(sum(u * u2), 0) + 0.5 * coalesce(sum(u * u3), 0) AS meat FROM {name}l_ GROUP BY ALL) JOIN (SELECT {_AT}, var_pop(y) * count(*) AS tss FROM {name}w_ GROUP BY ALL) USING ({_AT})"
    return views


def windowed(size: int | None):
    def build(t: Tables) -> DataFrame:
        out = R.window_models(priced(t), ["asset"], "date", "y", REGRESSORS, R.MODELS, size, WINDOW_ROWS)
        return out.select("model", "asset", F.col("date").alias("wend"), "n", F.round(F.get("beta", F.lit(0)), 6).alias("alpha"), F.round(F.get("se", F.lit(0)), 6).alias("se"), F.round("r2", 6).alias("r2"))

    return build


for _n, _size, _name in (("i09_rolling_models", WINDOW_ROWS, "vr"), ("i10_expanding_models", None, "vx")):
    register(_n, windowed(_size), f"SELECT model, asset, wend, n, round(alpha, 6) AS alpha, round(se, 6) AS se, round(r2, 6) AS r2 FROM {_name}g_", PRICED | windowed_grid(_name, _size))


@query("i09_rolling_market_slopes", "SELECT * FROM (SELECT asset, date AS wend, count(*) OVER w AS n, round(regr_slope(y, market) OVER w, 5) AS beta, round(regr_intercept(y, market) OVER w, 6) AS alpha FROM pf_ WINDOW w AS (PARTITION BY asset ORDER BY date ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)) WHERE n >= 24", PRICED)
def i09_slopes(t: Tables) -> DataFrame:
    out = R.window_models(priced(t), ["asset"], "date", "y", REGRESSORS, {"CAPM": R.MODELS["CAPM"]}, WINDOW_ROWS, WINDOW_ROWS)
    return out.select("asset", F.col("date").alias("wend"), "n", F.round(F.get("beta", F.lit(1)), 5).alias("beta"), F.round(F.get("beta", F.lit(0)), 6).alias("alpha"))


EXCLUDED = """WITH m AS (SELECT factor_id, date, quantile, security_id, cap, next_ret FROM q_ JOIN next_ USING (security_id, date) WHERE next_ret IS NOT NULL AND cap > 0),
a AS (SELECT DISTINCT factor_id AS f, quantile AS q FROM q_),
g AS (SELECT f, q, m.factor_id AS factor, m.date, sum(cap * next_ret) FILTER (m.quantile = 3 AND o.security_id IS NULL) / sum(cap) FILTER (m.quantile = 3 AND o.security_id IS NULL) - sum(cap * next_ret) FILTER (m.quantile = 1 AND o.security_id IS NULL) / sum(cap) FILTER (m.quantile = 1 AND o.security_id IS NULL) AS without,
 sum(cap * next_ret) FILTER (m.quantile = 3) / sum(cap) FILTER (m.quantile = 3) - sum(cap * next_ret) FILTER (m.quantile = 1) / sum(cap) FILTER (m.quantile = 1) AS whole
 FROM a JOIN m ON m.factor_id <> f LEFT JOIN (SELECT factor_id, date, quantile, security_id FROM q_) o ON o.factor_id = f AND o.quantile = q AND o.date = m.date AND o.security_id = m.security_id GROUP BY 1, 2, 3, 4),
r AS (SELECT f || ':Q' || q AS asset, factor, vw - risk_free AS y, market_return AS x, whole, without FROM g JOIN h_ ON h_.factor_id = f AND h_.quantile = q AND h_.date = g.date JOIN market_m ON market_m.date = g.date WHERE whole IS NOT NULL AND without IS NOT NULL)
SELECT asset, factor, count(*) AS n, round((covar_pop(y, whole) * var_pop(x) - covar_pop(y, x) * covar_pop(x, whole)) / (var_pop(x) * var_pop(whole) - pow(covar_pop(x, whole), 2)), 5) AS whole,
 round((covar_pop(y, without) * var_pop(x) - covar_pop(y, x) * covar_pop(x, without)) / (var_pop(x) * var_pop(without) - pow(covar_pop(x, without), 2)), 5) AS without FROM r GROUP BY 1, 2"""


@query("i28_self_exclusion_refit", EXCLUDED, FORMED)
def i28(t: Tables) -> DataFrame:
    """Formed assets on the market and each other factor's spread, with and without the asset's own members in the spread, on the matched sample."""
    w = Window.partitionBy("security_id").orderBy("date")
    nxt = t.panel.select("security_id", "date", (F.col("price") * F.col("shares")).alias("cap"), F.lead("ret").over(w).alias("next_ret")).filter("next_ret IS NOT NULL AND cap > 0")
    q = settled(formed(t).select("security_id", "date", "factor_id", "quantile"), "formed")
    names = q.select(F.col("factor_id").alias("f")).distinct()
    # Cells by the security's own quantile in the asset's factor, so that leaving an asset out is leaving a cell out.
    members = q.join(nxt, ["security_id", "date"]).withColumnRenamed("factor_id", "factor").filter("quantile <> 2").join(F.broadcast(names), F.col("factor") != F.col("f"))
    own = q.select("security_id", "date", F.col("factor_id").alias("f"), F.col("quantile").alias("mine"))
    cells = members.join(own, ["security_id", "date", "f"], "left").groupBy("f", "factor", "date", "quantile", "mine").agg(F.sum(F.col("cap") * F.col("next_ret")).alias("gain"), F.sum("cap").alias("cap"))
    cells = cells.withColumn("q", F.explode(F.array(*(F.lit(k).cast("long") for k in (1, 2, 3)))))
    other = F.col("mine").isNull() | (F.col("mine") != F.col("q"))
    leg = lambda k, held: F.try_divide(F.sum(F.when(held & (F.col("quantile") == k), F.col("gain"))), F.sum(F.when(held & (F.col("quantile") == k), F.col("cap"))))
    spreads = cells.groupBy("f", "q", "factor", "date").agg((leg(3, F.lit(True)) - leg(1, F.lit(True))).alias("whole"), (leg(3, other) - leg(1, other)).alias("without")).filter("whole IS NOT NULL AND without IS NOT NULL")
    h = held(t).select(F.col("factor_id").alias("f"), F.col("quantile").alias("q"), "date", "value_weighted_return").join(t.market_m, "date")
    r = spreads.join(h, ["f", "q", "date"]).select(F.concat_ws(":Q", "f", "q").alias("asset"), "factor", (F.col("value_weighted_return") - F.col("risk_free")).alias("y"), "market_return", "whole", "without")
    r = settled(r, "spreads")  # a row an asset, factor and date, read by both fits
    fit = lambda c: R.ols_fit(r, ["asset", "factor"], "y", ["market_return", c]).select("asset", "factor", "n", F.round(F.get("beta", F.lit(2)), 5).alias(c))
    return fit("whole").join(fit("without").drop("n"), ["asset", "factor"])


SUM = FIT | {"fit_": "SELECT security_id, max(a) AS alpha, sqrt(sum(e * e) / (max(n) - 2) * (1 / max(n) + pow(max(mx), 2) / max(sxx))) AS se, max(r2) AS r2 FROM e_ GROUP BY 1"}


@query("d19_model_level_summary", "SELECT count(*) AS fits, round(avg(alpha), 6) AS mean, round(median(alpha), 6) AS median, round(sqrt(avg(alpha * alpha)), 6) AS rms, count(*) FILTER (alpha > 0) AS positive, round(avg(r2), 6) AS mean_r2, round(quantile_cont(r2, 0.75) - quantile_cont(r2, 0.25), 6) AS r2_iqr FROM fit_", SUM)
def d19(t: Tables) -> DataFrame:
    c = R.coefficients(R.covariance(rows(t), fits(t), S, "ret", X), S, ["const", "market_return"]).filter("term = 'const'").join(fits(t).select("security_id", "r2"), "security_id")
    out = A.model_summary(c.withColumn("model", F.lit("CAPM")), ["model"], "estimate", "se", "r2")
    return out.select("fits", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"), F.round("rms", 6).alias("rms"), "positive", F.round("mean_r2", 6).alias("mean_r2"), F.round("r2_iqr", 6).alias("r2_iqr"))


@query("d23_residual_dependence", "SELECT count(*) AS pairs, round(avg(c), 6) AS mean_corr, round(max(c), 6) AS max_corr FROM (SELECT corr(a.e, b.e) AS c FROM e_ a JOIN e_ b ON a.date = b.date AND a.security_id < b.security_id GROUP BY a.security_id, b.security_id HAVING count(*) >= 24)", FIT)
def d23(t: Tables) -> DataFrame:
    return A.residual_dependence(resid(t).select("security_id", "date", "e"), "security_id", "date", "e").select("pairs", F.round("mean_corr", 6).alias("mean_corr"), F.round("max_corr", 6).alias("max_corr"))


@query("d25_paired_model_difference", "SELECT a.asset, a.model AS a, b.model AS b, round(b.adj_r2 - a.adj_r2, 6) AS d_adj_r2, round(b.alpha - a.alpha, 6) AS d_alpha FROM grid_ a JOIN grid_ b ON a.asset = b.asset AND a.model < b.model", GRID)
def d25(t: Tables) -> DataFrame:
    fits = grid_fits(t).withColumn("alpha", F.get("beta", F.lit(0)))
    out = A.model_differences(fits, "asset", "model", ["adj_r2", "alpha"])
    return out.select("asset", "a", "b", F.round("d_adj_r2", 6).alias("d_adj_r2"), F.round("d_alpha", 6).alias("d_alpha"))
