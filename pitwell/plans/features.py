"""Queries of the window, characteristic and scoring operators (E, F, G)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitwell.operators import scoring
from pitwell.operators import windows as W
from pitwell.operators.characteristics import GROWTHS, RATIOS, Horizons, characteristics, size_breakpoints
from pitwell.operators.joins import pit_asof_panel
from pitwell.plans.registry import query, register
from pitwell.plans.tables import FIELDS, Tables

H = Horizons(short=3, medium=6, half=9, year=12, two_years=24, least=3, periods=12)
KEY, ORDER = ["security_id"], ["date"]
OVER = "OVER (PARTITION BY security_id ORDER BY date ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"


def rounded(df: DataFrame, keys: list[str], digits: int = 6, **columns) -> DataFrame:
    return df.select(*keys, *(F.round(c, digits).alias(n) for n, c in columns.items()))


def over(n: int) -> str:
    return OVER.format(n - 1)


def gate(value: str, counted: str, n: int, least: int) -> str:
    return f"CASE WHEN count({counted}) {over(n)} >= {least} THEN {value} {over(n)} END"


@query("e01_rolling_moments", f"SELECT security_id, date, round({gate('avg(ret)', 'ret', 6, 3)}, 6) AS mean, round({gate('stddev_samp(ret)', 'ret', 6, 3)}, 6) AS sd, round({gate('var_samp(ret)', 'ret', 6, 3)}, 6) AS var FROM panel_m")
def e01(t: Tables) -> DataFrame:
    w, r = W.last_rows(KEY, ORDER, 6), F.col("ret")
    return rounded(t.panel_m, KEY + ORDER, mean=W.rolling_mean(r, w, 3), sd=W.rolling_std(r, w, 3), var=W.rolling_var(r, w, 3))


@query("e02_rolling_cov_corr", f"SELECT security_id, date, round({gate('covar_samp(ret, market_return)', 'ret + market_return', 12, 3)}, 6) AS cov, round({gate('corr(ret, market_return)', 'ret + market_return', 12, 3)}, 6) AS corr FROM panel")
def e02(t: Tables) -> DataFrame:
    w, r, m = W.last_rows(KEY, ORDER, 12), F.col("ret"), F.col("market_return")
    return rounded(t.panel, KEY + ORDER, cov=W.rolling_cov(r, m, w, 3), corr=W.rolling_corr(r, m, w, 3))


COMPOUND = "CASE WHEN count(ret) {0} = count(*) {0} AND count(ret) {0} >= {1} THEN product(1 + ret) {0} - 1 END"


@query("e03_rolling_compound", f"SELECT security_id, date, round({COMPOUND.format(over(6), 3)}, 6) AS value FROM panel_m")
def e03(t: Tables) -> DataFrame:
    return rounded(t.panel_m, KEY + ORDER, value=W.rolling_compound(F.col("ret"), W.last_rows(KEY, ORDER, 6), 3))


LAGGED = "OVER (PARTITION BY security_id ORDER BY date ROWS BETWEEN 10 PRECEDING AND 3 PRECEDING)"


@query("e04_skip_lag", f"SELECT security_id, date, round({COMPOUND.format(LAGGED, 3)}, 6) AS value FROM panel_m")
def e04(t: Tables) -> DataFrame:
    return rounded(t.panel_m, KEY + ORDER, value=W.rolling_compound(F.col("ret"), W.last_rows(KEY, ORDER, 8, 3), 3))


@query("e05_cross_section_rank", """SELECT security_id, date, CASE WHEN ret IS NOT NULL THEN row_number() OVER (PARTITION BY date ORDER BY ret NULLS LAST, security_id) END AS ordinal,
 CASE WHEN ret IS NOT NULL THEN rank() OVER (PARTITION BY date ORDER BY ret NULLS LAST) + (count(*) OVER (PARTITION BY date, ret) - 1) / 2 END AS average,
 round(CASE WHEN ret IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY ret NULLS LAST) + (count(*) OVER (PARTITION BY date, ret) - 1) / 2) / count(ret) OVER (PARTITION BY date) END, 9) AS pct FROM panel_m""")
def e05(t: Tables) -> DataFrame:
    return t.panel_m.select(*KEY, *ORDER, W.ordinal_rank("ret", ORDER, KEY).cast("long").alias("ordinal"), W.average_rank("ret", ORDER).alias("average"), F.round(W.percentile_rank("ret", ORDER), 9).alias("pct"))


RANKED = "WITH r AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY ret, security_id) AS rk, count(*) OVER (PARTITION BY date) AS n FROM panel_m WHERE ret IS NOT NULL) "


def ranked(t: Tables) -> DataFrame:
    known = t.panel_m.filter("ret IS NOT NULL")
    return known.withColumn("rk", W.ordinal_rank("ret", ORDER, KEY)).withColumn("n", F.count("*").over(Window.partitionBy(*ORDER)))


@query("e06_quantile_assign", RANKED + "SELECT security_id, date, least(5, greatest(1, ceil(rk / n * 5)))::BIGINT AS quantile FROM r")
def e06(t: Tables) -> DataFrame:
    return ranked(t).select(*KEY, *ORDER, W.quantile_of(F.col("rk"), F.col("n"), 5).cast("long").alias("quantile"))


@query("e13_qcut_bucket", RANKED + "SELECT security_id, date, CASE WHEN n = 1 THEN 0 ELSE greatest(ceil((rk - 1) * least(4, n) / (n - 1)) - 1, 0) END::BIGINT AS bucket FROM r")
def e13(t: Tables) -> DataFrame:
    return ranked(t).select(*KEY, *ORDER, W.equal_count_bucket(F.col("rk"), F.col("n"), 4).cast("long").alias("bucket"))


@query("e07_common_month_end", "SELECT security_id, date, price FROM (SELECT *, max(date) OVER (PARTITION BY date_trunc('month', date)) AS e FROM panel_d) WHERE date = e")
def e07(t: Tables) -> DataFrame:
    return W.common_month_end(t.panel_d).select("security_id", "date", "price")


CYCLES = """cycles AS (SELECT signal, execution, exit FROM (SELECT signal, execution, lead(execution) OVER (ORDER BY signal) AS exit FROM (SELECT date AS signal, lead(date) OVER (ORDER BY date) AS execution FROM (SELECT DISTINCT date FROM panel_d)) WHERE date_trunc('month', signal) <> date_trunc('month', execution)) WHERE exit IS NOT NULL)"""


@query("e08_monthly_cycles", f"WITH {CYCLES} SELECT * FROM cycles")
def e08(t: Tables) -> DataFrame:
    return W.monthly_cycles(t.panel_d.select("date").distinct())


@query("e11_drawdown_path", """WITH w AS (SELECT security_id, date, product(1 + ret) OVER (PARTITION BY security_id ORDER BY date) AS wealth FROM panel_m WHERE ret IS NOT NULL)
SELECT security_id, date, round(wealth / greatest(1.0, max(wealth) OVER (PARTITION BY security_id ORDER BY date)) - 1, 6) AS drawdown FROM w""")
def e11(t: Tables) -> DataFrame:
    return rounded(W.drawdown_path(t.panel_m.filter("ret IS NOT NULL"), KEY, ORDER, "ret"), KEY + ORDER, drawdown=F.col("drawdown"))


def forward_frame(t: Tables, h: int = 3) -> DataFrame:
    """Rows with the h-th next row only where it is the h-th next common session; fwd compounds the rows between."""
    s = W.session_positions(t.panel_m)
    w, nxt = Window.partitionBy(*KEY).orderBy(*ORDER), W.next_rows(KEY, ORDER, h)
    out = t.panel_m.join(F.broadcast(s), "date")
    valid = F.lead("session", h).over(w) == F.col("session") + h
    return out.withColumn("fwd", F.when(valid, W.compound_over(F.col("ret"), nxt)))


FORWARD = """s AS (SELECT date, dense_rank() OVER (ORDER BY date) AS session FROM (SELECT DISTINCT date FROM panel_m)),
fwd AS (SELECT p.*, session, CASE WHEN lead(session, 3) OVER w = session + 3 AND count(ret) OVER n = 3 THEN product(1 + ret) OVER n - 1 END AS fwd FROM panel_m p JOIN s USING (date)
  WINDOW w AS (PARTITION BY security_id ORDER BY date), n AS (PARTITION BY security_id ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING))"""


@query("e12_forward_targets_frame", f"WITH {FORWARD} SELECT security_id, date, round(fwd, 6) AS value FROM fwd")
def e12(t: Tables) -> DataFrame:
    return rounded(forward_frame(t), KEY + ORDER, value=F.col("fwd"))


@query("e14_rolling_risk", f"SELECT security_id, date, round({gate('stddev_samp(ret)', 'ret', 12, 12)} * sqrt(12), 6) AS vol, round({gate('covar_samp(ret, market_return)', 'ret + market_return', 12, 12)} / nullif({gate('var_samp(market_return)', 'market_return', 12, 12)}, 0), 6) AS beta FROM panel")
def e14(t: Tables) -> DataFrame:
    w = W.last_rows(KEY, ORDER, 12)
    return rounded(t.panel, KEY + ORDER, vol=W.rolling_std(F.col("ret"), w, 12) * 12**0.5, beta=W.rolling_beta(F.col("ret"), F.col("market_return"), w, 12))


PCT = "(rank() OVER (PARTITION BY date ORDER BY ret) + (count(*) OVER (PARTITION BY date, ret) - 1) / 2) / count(*) OVER (PARTITION BY date)"


@query("e15_rank_turnover", f"""WITH p AS (SELECT security_id, date, {PCT} AS pct, dense_rank() OVER (ORDER BY date) AS k FROM panel_m WHERE ret IS NOT NULL),
d AS (SELECT date, abs(pct - lag(pct) OVER w) AS x, k - lag(k) OVER w AS step FROM p WINDOW w AS (PARTITION BY security_id ORDER BY date)),
e AS (SELECT date, avg(x) AS m FROM d WHERE step = 1 GROUP BY date) SELECT count(*) AS dates, round(avg(m), 9) AS turnover FROM e""")
def e15(t: Tables) -> DataFrame:
    known = t.panel_m.filter("ret IS NOT NULL")
    p = known.withColumn("pct", W.percentile_rank("ret", ORDER)).join(F.broadcast(W.session_positions(known)), "date")
    w = Window.partitionBy(*KEY).orderBy(*ORDER)
    steps = p.withColumns({"x": F.abs(F.col("pct") - F.lag("pct").over(w)), "step": F.col("session") - F.lag("session").over(w)}).filter("step = 1")
    return steps.groupBy("date").agg(F.avg("x").alias("m")).agg(F.count("*").alias("dates"), F.round(F.avg("m"), 9).alias("turnover"))


@query("e16_next_period_lead", "SELECT security_id, date, coalesce(lead(date) OVER (PARTITION BY security_id ORDER BY date), (SELECT max(date) FROM market_m)) AS holding_end FROM panel_m")
def e16(t: Tables) -> DataFrame:
    last = t.market_m.agg(F.max("date").alias("last_"))
    rows = t.panel_m.crossJoin(F.broadcast(last))
    return W.next_value(rows, KEY, "date", F.col("last_"), "holding_end").select(*KEY, *ORDER, "holding_end")


@query("e18_session_position", "SELECT security_id, date, session FROM panel_m JOIN (SELECT date, dense_rank() OVER (ORDER BY date) AS session FROM (SELECT DISTINCT date FROM panel_m)) USING (date)")
def e18(t: Tables) -> DataFrame:
    return t.panel_m.join(F.broadcast(W.session_positions(t.panel_m)), "date").select(*KEY, *ORDER, "session")


# F: one plan for all characteristics, one query each.

LAST = "last_value({0} IGNORE NULLS) OVER (PARTITION BY security_id ORDER BY at_, kind ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {0}"
ASOF = {
    "events_": f"SELECT security_id, available_at AS at_, 0 AS kind, NULL::DATE AS date, {', '.join(f'max(value) FILTER (field = {f!r}) AS {f}' for f in FIELDS)} FROM fundamentals GROUP BY 1, 2 UNION ALL SELECT security_id, date, 1, date, {', '.join(['NULL'] * len(FIELDS))} FROM panel_m",
    "asof_": f"SELECT * FROM (SELECT security_id, date, kind, {', '.join(LAST.format(f) for f in FIELDS)} FROM events_) WHERE kind = 1",
    "wide_": "SELECT p.*, price * shares AS cap, a.* EXCLUDE (security_id, date, kind) FROM panel p JOIN asof_ a USING (security_id, date)",
    "bps_": "SELECT date, quantile_cont(price * shares, 0.3) AS bp_low, quantile_cont(price * shares, 0.7) AS bp_high FROM panel_m WHERE exchange = 'XNYS' GROUP BY date",
}


def wide_panel(t: Tables) -> DataFrame:
    return pit_asof_panel(t.panel, t.fundamentals, list(FIELDS))


BETA = f"{gate('covar_samp(ret, market_return)', 'ret + market_return', 12, 3)} / nullif({gate('var_samp(market_return)', 'market_return', 12, 3)}, 0)"
LAG12 = "OVER (PARTITION BY security_id ORDER BY date ROWS BETWEEN 11 PRECEDING AND 3 PRECEDING)"
DOWN = "CASE WHEN ret < 0 THEN ret END"
F_SQL = {
    "f01_market_return": "market_return", "f02_excess_return": "market_return - risk_free", "f03_risk_free_rate": "risk_free", "f04_rolling_market_beta": BETA, "f05_market_cap": "cap", "f06_log_market_cap": "CASE WHEN cap > 0 THEN ln(cap) END",
    "f15_momentum_1m": COMPOUND.format(over(3), 3), "f16_momentum_3m": COMPOUND.format(over(6), 3), "f17_momentum_6m": COMPOUND.format(over(9), 3), "f19_momentum_12m": COMPOUND.format(over(12), 3), "f20_momentum_24m": COMPOUND.format(over(24), 3),
    "f18_momentum_12_1m": f"CASE WHEN row_number() OVER (PARTITION BY security_id ORDER BY date) >= 12 THEN {COMPOUND.format(LAG12, 3)} END",
    "f36_rolling_volatility": f"{gate('stddev_samp(ret)', 'ret', 12, 3)} * sqrt(12)", "f37_downside_volatility": f"{gate(f'stddev_samp({DOWN})', DOWN, 12, 3)} * sqrt(12)",
    "f38_semi_variance": f"{gate('avg(CASE WHEN ret < 0 THEN ret * ret END)', DOWN, 12, 3)} * 12", "f39_beta": BETA, "f41_average_dollar_volume": gate("avg(price * volume)", "price * volume", 3, 3),
    "f43_amihud_illiquidity": "abs(ret) / nullif(price * volume, 0)", "f44_bid_ask_proxy": "(high - low) / nullif((high + low) / 2, 0)", "f45_rolling_beta": BETA, "f46_rolling_correlation": gate("corr(ret, market_return)", "ret + market_return", 12, 3),
    "f47_tracking_error": f"{gate('stddev_samp(ret - benchmark_return)', 'ret - benchmark_return', 12, 3)} * sqrt(12)",
    "f48_downside_beta": f"{gate('covar_samp(CASE WHEN market_return < 0 THEN ret END, CASE WHEN market_return < 0 THEN market_return END)', 'CASE WHEN market_return < 0 THEN ret END', 12, 3)} / nullif({gate('var_samp(CASE WHEN market_return < 0 THEN market_return END)', 'CASE WHEN market_return < 0 THEN market_return END', 12, 3)}, 0)",
}
NUMBERS = {"book_to_market": 10, "price_to_book": 11, "earnings_yield": 12, "cash_flow_yield": 13, "dividend_yield": 14, "roe": 22, "roa": 23, "gross_profitability": 24, "operating_margin": 25, "net_margin": 26, "asset_turnover": 27, "accruals": 28, "leverage": 29, "debt_to_equity": 30, "interest_coverage": 31, "asset_growth": 32, "capex_growth": 33, "equity_issuance": 34, "working_capital_growth": 35, "turnover": 42}
F_SQL |= {f"f{NUMBERS[k]:02}_{k}": f"{a} / nullif({b}, 0)" for k, (a, b) in RATIOS.items()}
F_SQL |= {f"f{NUMBERS[k]:02}_{k}": f"{a} / nullif({b}, 0) - 1" for k, (a, b) in GROWTHS.items()}
#: Digits kept: small ratios need more, money less.
DIGITS = {"f43_amihud_illiquidity": 12, "f41_average_dollar_volume": 2, "f05_market_cap": 2, "f42_turnover": 6}


def characteristic(name: str):
    column = name[4:]

    def build(t: Tables) -> DataFrame:
        return characteristics(wide_panel(t), H).select(*KEY, *ORDER, F.round(column, DIGITS.get(name, 6)).alias("value"))

    return build


for _name, _sql in sorted(F_SQL.items()):
    register(_name, characteristic(_name), f"SELECT security_id, date, round({_sql}, {DIGITS.get(_name, 6)}) AS value FROM wide_", ASOF)

RESIDUAL = f"WITH b AS (SELECT security_id, date, ret - ({BETA}) * market_return AS ret FROM wide_) "
register("f21_residual_momentum", characteristic("f21_residual_momentum"), RESIDUAL + f"SELECT security_id, date, round(CASE WHEN row_number() OVER (PARTITION BY security_id ORDER BY date) >= 12 THEN {COMPOUND.format(LAG12, 3)} END, 6) AS value FROM b", ASOF)
register("f40_idiosyncratic_volatility", characteristic("f40_idiosyncratic_volatility"), RESIDUAL + f"SELECT security_id, date, round({gate('stddev_samp(ret)', 'ret', 12, 3)} * sqrt(12), 6) AS value FROM b", ASOF)
for _k, _flag in (("f07_size_small", "cap <= bp_low"), ("f08_size_mid", "cap > bp_low AND cap < bp_high"), ("f09_size_large", "cap >= bp_high")):
    register(_k, characteristic(_k), f"SELECT security_id, date, CASE WHEN bp_low IS NOT NULL THEN coalesce({_flag}, false)::INT::DOUBLE END AS value FROM wide_ LEFT JOIN bps_ USING (date)", ASOF)


@query("f00_available_column", "SELECT security_id, date, NULL::DOUBLE AS value FROM panel")
def f00(t: Tables) -> DataFrame:
    return characteristics(t.panel, H).select(*KEY, *ORDER, F.col("book_to_market").alias("value"))


@query("f49_safe_div", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount <> 0 THEN round(l_tax / l_discount, 9) END AS value FROM lineitem")
def f49(t: Tables) -> DataFrame:
    from pitwell.functions.scalar import ratio

    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(ratio(F.col("l_tax"), F.col("l_discount")), 9).alias("value"))


@query("d10_exchange_breakpoints", "SELECT date, round(bp_low, 4) AS bp_low, round(bp_high, 4) AS bp_high FROM bps_", ASOF)
def d10(t: Tables) -> DataFrame:
    return rounded(size_breakpoints(t.panel_m, "XNYS"), ["date"], 4, bp_low=F.col("bp_low"), bp_high=F.col("bp_high"))


# G

CLIP = "CASE WHEN ret IS NOT NULL THEN greatest(quantile_cont(ret, 0.01) OVER (PARTITION BY {0}), least(quantile_cont(ret, 0.99) OVER (PARTITION BY {0}), ret)) END"


@query("g01_winsorize", f"SELECT security_id, date, round({CLIP.format('date')}, 8) AS value FROM panel_m")
def g01(t: Tables) -> DataFrame:
    return rounded(t.panel_m, KEY + ORDER, 8, value=scoring.winsorized("ret", ORDER))


def g(method: str, keys: list[str], digits: int = 6):
    return lambda t: rounded(scoring.normalised(t.panel_m, "ret", keys, method), KEY + ORDER, digits, value=F.col("normalized"))


P = "OVER (PARTITION BY date)"
register("g02_normalize_none", g("none", ORDER), "SELECT security_id, date, round(ret, 6) AS value FROM panel_m")
register("g03_robust_zscore", g("robust_zscore", ORDER), f"WITH m AS (SELECT *, median(ret) {P} AS med FROM panel_m), d AS (SELECT *, median(abs(ret - med)) {P} AS mad FROM m) SELECT security_id, date, round(CASE WHEN mad > 0 THEN (ret - med) / (1.4826 * mad) END, 6) AS value FROM d")
register("g04_zscore", g("zscore", ORDER), f"SELECT security_id, date, round((ret - avg(ret) {P}) / nullif(stddev_samp(ret) {P}, 0), 6) AS value FROM panel_m")
register("g05_minmax", g("minmax", ORDER), f"SELECT security_id, date, round((ret - min(ret) {P}) / nullif(max(ret) {P} - min(ret) {P}, 0), 6) AS value FROM panel_m")
register("g06_rank", g("rank", ORDER), "SELECT security_id, date, round(CASE WHEN ret IS NOT NULL THEN rank() OVER (PARTITION BY date ORDER BY ret NULLS LAST) + (count(*) OVER (PARTITION BY date, ret) - 1) / 2 END, 6) AS value FROM panel_m")
register("g07_percentile", g("percentile", ORDER), "SELECT security_id, date, round(CASE WHEN ret IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY ret NULLS LAST) + (count(*) OVER (PARTITION BY date, ret) - 1) / 2) / count(ret) OVER (PARTITION BY date) END, 6) AS value FROM panel_m")
register("g09_neutralize_by", g("zscore", ["date", "sector"]), "SELECT security_id, date, round((ret - avg(ret) OVER (PARTITION BY date, sector)) / nullif(stddev_samp(ret) OVER (PARTITION BY date, sector), 0), 6) AS value FROM panel_m")

SCORES = {
    "long_": f"SELECT security_id, date, 'momentum_1m' AS factor_id, {COMPOUND.format(over(3), 3)} AS raw FROM panel UNION ALL SELECT security_id, date, 'market_cap', price * shares FROM panel UNION ALL SELECT security_id, date, 'turnover', volume / shares FROM panel",
    "clip_": "SELECT *, count(raw) OVER k >= 5 AS enough, CASE WHEN raw IS NOT NULL THEN greatest(quantile_cont(raw, 0.01) OVER k, least(quantile_cont(raw, 0.99) OVER k, raw)) END AS winsorized FROM long_ WINDOW k AS (PARTITION BY factor_id, date)",
    "med_": "SELECT *, median(winsorized) OVER (PARTITION BY factor_id, date) AS med FROM clip_",
    "mad_": "SELECT *, median(abs(winsorized - med)) OVER (PARTITION BY factor_id, date) AS mad FROM med_",
    "scores_": "SELECT security_id, date, factor_id, raw, winsorized, CASE WHEN enough AND mad > 0 THEN (winsorized - med) / (1.4826 * mad) END AS normalized FROM mad_",
}


def scores(t: Tables) -> DataFrame:
    wide = characteristics(t.panel, H).select(*KEY, *ORDER, "momentum_1m", "market_cap", "turnover")
    return scoring.score_factors(wide, ["momentum_1m", "market_cap", "turnover"], KEY + ORDER)


@query("g08_score_factors", "SELECT security_id, date, factor_id, round(raw, 2) AS raw, round(winsorized, 2) AS winsorized, round(CASE WHEN factor_id = 'market_cap' THEN -normalized ELSE normalized END, 6) AS score FROM scores_", SCORES)
def g08(t: Tables) -> DataFrame:
    return scores(t).select(*KEY, *ORDER, "factor_id", F.round("raw", 2).alias("raw"), F.round("winsorized", 2).alias("winsorized"), F.round("score", 6).alias("score"))
