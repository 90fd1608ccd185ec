"""The 48 security characteristics (F) as columns over one panel.

All rolling columns share one partition (security by date), so the whole set
costs one shuffle and one sort. Inputs that a panel lacks give NULL columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitwell.functions.scalar import ratio
from pitwell.operators import windows as W


@dataclass(frozen=True)
class Horizons:
    """Window lengths in rows."""

    short: int = 21
    medium: int = 63
    half: int = 126
    year: int = 252
    two_years: int = 504
    least: int = 20
    periods: int = 252
    keys: tuple[str, ...] = ("security_id",)
    order: tuple[str, ...] = ("date",)

    def rows(self, n: int, skip: int = 0):
        return W.last_rows(list(self.keys), list(self.order), n, skip)


INPUTS = (
    "price", "high", "low", "volume", "ret", "market_return", "benchmark_return", "risk_free", "shares",
    "book_equity", "net_income", "operating_cash_flow", "dividends", "shareholder_equity", "total_assets", "gross_profit",
    "operating_income", "revenue", "average_assets", "total_accruals", "total_debt", "interest_expense", "prior_total_assets",
    "capex", "prior_capex", "net_equity_issuance", "working_capital", "prior_working_capital",
)

#: Direction of each characteristic: a score of a -1 characteristic is flipped.
NEGATIVE = frozenset((
    "market_cap", "log_market_cap", "price_to_book", "accruals", "leverage", "debt_to_equity", "asset_growth", "capex_growth", "equity_issuance",
    "working_capital_growth", "rolling_volatility", "downside_volatility", "semi_variance", "beta", "idiosyncratic_volatility", "amihud_illiquidity",
    "bid_ask_proxy", "tracking_error", "downside_beta",
))

RATIOS = {
    "book_to_market": ("book_equity", "cap"),
    "price_to_book": ("cap", "book_equity"),
    "earnings_yield": ("net_income", "cap"),
    "cash_flow_yield": ("operating_cash_flow", "cap"),
    "dividend_yield": ("dividends", "cap"),
    "roe": ("net_income", "shareholder_equity"),
    "roa": ("net_income", "total_assets"),
    "gross_profitability": ("gross_profit", "total_assets"),
    "operating_margin": ("operating_income", "revenue"),
    "net_margin": ("net_income", "revenue"),
    "asset_turnover": ("revenue", "average_assets"),
    "accruals": ("total_accruals", "total_assets"),
    "leverage": ("total_debt", "total_assets"),
    "debt_to_equity": ("total_debt", "shareholder_equity"),
    "interest_coverage": ("operating_income", "interest_expense"),
    "equity_issuance": ("net_equity_issuance", "shareholder_equity"),
    "turnover": ("volume", "shares"),
}
GROWTHS = {
    "asset_growth": ("total_assets", "prior_total_assets"),
    "capex_growth": ("capex", "prior_capex"),
    "working_capital_growth": ("working_capital", "prior_working_capital"),
}


def with_inputs(panel: DataFrame) -> DataFrame:
    """Adds the inputs that are missing as NULL columns."""
    missing = {c: F.lit(None).cast("double") for c in INPUTS if c not in panel.columns}
    return panel.withColumns(missing).withColumn("cap", F.col("price") * F.col("shares"))


def size_breakpoints(panel: DataFrame, exchange: str, low: float = 0.3, high: float = 0.7) -> DataFrame:
    """date, bp_low, bp_high: interpolated quantiles of market cap on one exchange."""
    caps = panel.filter(F.col("exchange") == exchange).withColumn("cap", F.col("price") * F.col("shares"))
    q = F.percentile("cap", F.array(F.lit(low), F.lit(high)))
    return caps.groupBy("date").agg(q.alias("q")).select("date", F.get("q", F.lit(0)).alias("bp_low"), F.get("q", F.lit(1)).alias("bp_high"))


def size_flags(panel: DataFrame, breakpoints: DataFrame) -> DataFrame:
    """size_small, size_mid, size_large as 0 / 1; NULL only where a date has no breakpoint. One small row a date is joined."""
    out = panel.join(breakpoints, "date", "left")
    flag = lambda c: F.when(F.col("bp_low").isNotNull(), F.coalesce(c, F.lit(False)).cast("double"))
    cap, low, high = F.col("cap"), F.col("bp_low"), F.col("bp_high")
    return out.withColumns({"size_small": flag(cap <= low), "size_mid": flag((cap > low) & (cap < high)), "size_large": flag(cap >= high)})


def expressions(h: Horizons) -> dict[str, Column]:
    """All characteristics that need one pass over the panel."""
    c, year, root = F.col, h.rows(h.year), h.periods**0.5
    r, m = c("ret"), c("market_return")
    beta = W.rolling_beta(r, m, year, h.least)
    out = {
        "market_return": m,
        "excess_return": m - c("risk_free"),
        "risk_free_rate": c("risk_free"),
        "rolling_market_beta": beta,
        "market_cap": c("cap"),
        "log_market_cap": F.when(c("cap") > 0, F.log("cap")),
        "momentum_1m": W.rolling_compound(r, h.rows(h.short), min(h.least, h.short)),
        "momentum_3m": W.rolling_compound(r, h.rows(h.medium), min(h.least, h.medium)),
        "momentum_6m": W.rolling_compound(r, h.rows(h.half), h.least),
        "momentum_12m": W.rolling_compound(r, year, h.least),
        "momentum_24m": W.rolling_compound(r, h.rows(h.two_years), h.least),
        "rolling_volatility": W.rolling_std(r, year, h.least) * root,
        "downside_volatility": W.rolling_std(F.when(r < 0, r), year, h.least) * root,
        "semi_variance": W.rolling_mean(F.when(r < 0, r * r), year, h.least) * h.periods,
        "beta": beta,
        "average_dollar_volume": W.rolling_mean(c("price") * c("volume"), h.rows(h.short), min(h.least, h.short)),
        "amihud_illiquidity": ratio(F.abs(r), c("price") * c("volume")),
        "bid_ask_proxy": ratio(c("high") - c("low"), (c("high") + c("low")) / 2),
        "rolling_beta": beta,
        "rolling_correlation": W.rolling_corr(r, m, year, h.least),
        "tracking_error": W.rolling_std(r - c("benchmark_return"), year, h.least) * root,
        "downside_beta": ratio(W.rolling_cov(F.when(m < 0, r), F.when(m < 0, m), year, h.least), W.rolling_var(F.when(m < 0, m), year, h.least)),
    }
    out |= {k: ratio(c(a), c(b)) for k, (a, b) in RATIOS.items()}
    out |= {k: ratio(c(a), c(b)) - 1 for k, (a, b) in GROWTHS.items()}
    return out


def characteristics(panel: DataFrame, h: Horizons = Horizons(), exchange: str = "XNYS") -> DataFrame:
    """security_id, date and all 48 characteristics."""
    base = with_inputs(panel)
    first = expressions(h)
    row = F.row_number().over(Window.partitionBy(*h.keys).orderBy(*h.order))
    wide = base.withColumns({f"f_{k}": v for k, v in first.items()} | {"row_": row})
    residual = F.col("ret") - F.col("f_rolling_market_beta") * F.col("market_return")
    wide = wide.withColumn("residual_", residual)
    lagged, span = h.short, h.year - h.short
    # Lagged rows before a series' start count as missing.
    whole = F.col("row_") >= lagged + span
    skipped = lambda x: F.when(whole, W.rolling_compound(F.col(x), h.rows(span, lagged), min(h.least, span)))
    wide = wide.withColumns({
        "f_momentum_12_1m": skipped("ret"),
        "f_residual_momentum": skipped("residual_"),
        "f_idiosyncratic_volatility": W.rolling_std(F.col("residual_"), h.rows(h.year), h.least) * h.periods**0.5,
    })
    wide = size_flags(wide, size_breakpoints(base, exchange))
    named = {k: F.col(f"f_{k}") for k in (*first, "momentum_12_1m", "residual_momentum", "idiosyncratic_volatility")}
    named |= {k: F.col(k) for k in ("size_small", "size_mid", "size_large")}
    return wide.select(*h.keys, *h.order, *(v.alias(k) for k, v in named.items()))
