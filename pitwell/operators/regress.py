"""Grouped least squares from moments, robust inference and diagnostics (I).

One aggregation gathers the moments of every group; only k x k systems are
solved in Python, one row a group. Residual-based steps join the coefficients
back and stay in the JVM.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitwell.functions.scalar import finite
from pitwell.functions.tails import chi2_upper, f_upper, t_two_sided

#: Regressors of the registered pricing models; the dependent variable is the excess return.
MODELS = {"CAPM": ("market",), "FF3": ("market", "size", "value"), "CARHART4": ("market", "size", "value", "momentum"), "FF5": ("market", "size", "value", "profitability", "investment"), "Q": ("market", "size", "investment", "profitability")}


def registered(own: dict[str, tuple[str, ...]], known: list[str]) -> dict[str, tuple[str, ...]]:
    """MODELS with models of the caller's own; a name that is taken and a regressor that isn't known or comes twice are refused."""
    for name, xs in own.items():
        if not name or name in MODELS:
            raise ValueError(f"model {name!r} is registered")
        if not xs or len(set(xs)) < len(xs) or not set(xs) <= set(known):
            raise ValueError(f"model {name!r} has regressors {xs}, not different ones of {known}")
    return MODELS | own


def design(xs: list[str], constant: bool = True) -> list[Column]:
    return ([F.lit(1.0)] if constant else []) + [F.col(x).cast("double") for x in xs]


def complete(df: DataFrame, columns: list[str]) -> DataFrame:
    for c in columns:
        df = df.filter(finite(F.col(c).cast("double")))
    return df


def moments(df: DataFrame, keys: list[str], y: str, xs: list[str], weight: str | None = None, constant: bool = True) -> DataFrame:
    """keys, n, xtx (row-major), xty, yty, sy over complete rows."""
    d, w, target = design(xs, constant), F.col(weight) if weight else F.lit(1.0), F.col(y).cast("double")
    rows = complete(df, [y, *xs] + ([weight] if weight else []))
    if weight:
        rows = rows.filter(F.col(weight) > 0)
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.array(*(F.sum(w * a * b) for a in d for b in d)).alias("xtx"), F.array(*(F.sum(w * a * target) for a in d)).alias("xty"),
        F.sum(w * target * target).alias("yty"), F.sum(w * target).alias("sy"), F.sum(w).alias("sw"))


def key_schema(df: DataFrame, keys: list[str]) -> str:
    return "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys)


def ols_fit(df: DataFrame, keys: list[str], y: str, xs: list[str], weight: str | None = None, constant: bool = True) -> DataFrame:
    """One row a group: n, df_resid, beta, inv (of X'X), rss, r2, adj_r2, aic, bic, se_resid. Groups without full rank or freedom fall out."""
    m = moments(df, keys, y, xs, weight, constant)
    k = len(xs) + constant

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.to_dict("records"):
                fit = solution(r, np.arange(k), constant)
                if fit:
                    out.append((*(r[c] for c in keys), *fit))
            yield pd.DataFrame(out, columns=[*keys, *FIT_COLUMNS])

    return m.mapInPandas(solve, key_schema(df, keys) + FIT_SCHEMA)


FIT_SCHEMA = "n long, df_resid long, beta array<double>, inv array<double>, rss double, r2 double, adj_r2 double, aic double, bic double, se_resid double"
FIT_COLUMNS = [c.split()[0] for c in FIT_SCHEMA.split(", ")]


def solution(r: dict, use: np.ndarray, constant: bool = True) -> tuple | None:
    """FIT_COLUMNS of one row of `moments` with the design columns `use`; beta and inv have zeros for the others."""
    b, n, k = np.array(r["xty"]), r["n"], len(use)
    whole = len(b)
    a, b = np.array(r["xtx"]).reshape(whole, whole)[np.ix_(use, use)], b[use]
    scale = np.sqrt(np.maximum(np.diag(a), 1e-300))
    unit = a / np.outer(scale, scale)
    if n <= k or np.linalg.matrix_rank(unit, tol=1e-11) < k:
        return None
    inv = np.linalg.inv(unit) / np.outer(scale, scale)
    beta = inv @ b
    rss = max(r["yty"] - beta @ b, 0.0)
    tss = r["yty"] - (r["sy"] ** 2 / r["sw"] if constant else 0.0)
    r2 = 1 - rss / tss if tss > 0 else None
    loglik = -n / 2 * (np.log(2 * np.pi) + np.log(max(rss, 1e-300) / n) + 1)
    adj = None if r2 is None else 1 - (1 - r2) * (n - constant) / (n - k)
    all_beta, all_inv = np.zeros(whole), np.zeros((whole, whole))
    all_beta[use], all_inv[np.ix_(use, use)] = beta, inv
    return n, n - k, all_beta.tolist(), all_inv.ravel().tolist(), rss, r2, adj, 2 * k - 2 * loglik, k * np.log(n) - 2 * loglik, float(np.sqrt(rss / (n - k)))


def model_fits(df: DataFrame, keys: list[str], y: str, xs: list[str], models: dict[str, tuple[str, ...]]) -> DataFrame:
    """One row a group and model, on the rows that are complete for all of xs: the columns of `ols_fit`.

    The moments of all regressors are gathered once. beta and inv have a place for each of xs, zeros where a model
    leaves it out, so that `residuals` and `covariance` take them with rows by group and model.
    """
    places = {m: np.array([0, *(1 + xs.index(x) for x in used)]) for m, used in models.items()}

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.to_dict("records"):
                for model, use in places.items():
                    fit = solution(r, use)
                    if fit:
                        out.append((*(r[c] for c in keys), model, *fit))
            yield pd.DataFrame(out, columns=[*keys, "model", *FIT_COLUMNS])

    return moments(df, keys, y, xs).mapInPandas(solve, key_schema(df, keys) + "model string, " + FIT_SCHEMA)


def residuals(df: DataFrame, fits: DataFrame, keys: list[str], y: str, xs: list[str], constant: bool = True) -> DataFrame:
    """Complete rows with fitted, e (residual), h (leverage) and the fit's n, df_resid, se_resid."""
    d = design(xs, constant)
    k = len(d)
    rows = complete(df, [y, *xs]).join(fits.select(*keys, "n", "df_resid", "beta", "inv", "se_resid"), keys)
    fitted = sum((F.get("beta", F.lit(i)) * d[i] for i in range(k)), F.lit(0.0))
    h = sum((F.get("inv", F.lit(i * k + j)) * d[i] * d[j] for i in range(k) for j in range(k)), F.lit(0.0))
    return rows.withColumn("fitted", fitted).withColumn("e", F.col(y) - F.col("fitted")).withColumn("h", h)


def covariance(df: DataFrame, fits: DataFrame, keys: list[str], y: str, xs: list[str], kind: str = "nonrobust", lags: int = 3, order: str = "date", constant: bool = True) -> DataFrame:
    """fits with cov (row-major). kind: nonrobust, HC0, HC1, HC2, HC3 or HAC (Bartlett, n / (n - k))."""
    k = len(xs) + constant
    if kind == "nonrobust":
        return fits.withColumn("cov", F.transform("inv", lambda v: v * F.col("se_resid") * F.col("se_resid")))
    d, rows = design(xs, constant), residuals(df, fits, keys, y, xs, constant)
    e2 = F.col("e") * F.col("e")
    if kind == "HAC":
        rows = rows.withColumns({f"u{i}": d[i] * F.col("e") for i in range(k)})
        w = Window.partitionBy(*keys).orderBy(order)
        total = []
        for i in range(k):
            for j in range(k):
                cell = F.col(f"u{i}") * F.col(f"u{j}")
                for lag in range(1, lags + 1):
                    part = F.col(f"u{i}") * F.lag(f"u{j}", lag).over(w) + F.col(f"u{j}") * F.lag(f"u{i}", lag).over(w)
                    cell = cell + (1 - lag / (lags + 1)) * F.coalesce(part, F.lit(0.0))
                total.append(cell.alias(f"m{i}_{j}"))
        rows = rows.select(*keys, *total)
        meat = rows.groupBy(*keys).agg(F.array(*(F.sum(f"m{i}_{j}") for i in range(k) for j in range(k))).alias("meat"))
    else:
        scale = {"HC0": F.lit(1.0), "HC1": F.col("n") / F.col("df_resid"), "HC2": 1 / (1 - F.col("h")), "HC3": 1 / F.pow(1 - F.col("h"), 2)}[kind]
        meat = rows.groupBy(*keys).agg(F.array(*(F.sum(e2 * scale * a * b) for a in d for b in d)).alias("meat"))

    def sandwich(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            cov = []
            for r in f.to_dict("records"):
                inv, mid = np.array(r["inv"]).reshape(k, k), np.array(r["meat"]).reshape(k, k)
                c = inv @ mid @ inv
                cov.append((c * (r["n"] / r["df_resid"] if kind == "HAC" else 1.0)).ravel().tolist())
            yield f.drop(columns="meat").assign(cov=cov)

    joined = fits.join(meat, keys)
    schema = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in fits.schema) + ", cov array<double>"
    return joined.mapInPandas(sandwich, schema)


def coefficients(fits: DataFrame, keys: list[str], terms: list[str], normal: bool = False, z: float = 1.959963984540054) -> DataFrame:
    """Long table: term, estimate, se, t, p (t law, or normal), lower, upper."""
    k = len(terms)

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.to_dict("records"):
                beta, se = np.array(r["beta"]), np.sqrt(np.maximum(np.array(r["cov"]).reshape(k, k).diagonal(), 0))
                with np.errstate(divide="ignore", invalid="ignore"):
                    t = np.where(se > 0, beta / se, np.nan)
                p = t_two_sided(t, 1e7 if normal else float(r["df_resid"]))
                out += [(*(r[c] for c in keys), terms[i], *map(float, (beta[i], se[i], t[i], p[i], beta[i] - z * se[i], beta[i] + z * se[i]))) for i in range(k)]
            yield pd.DataFrame(out, columns=[*keys, "term", "estimate", "se", "t", "p", "lower", "upper"])

    return fits.mapInPandas(rows, key_schema(fits, keys) + "term string, estimate double, se double, t double, p double, lower double, upper double")


def window_regression(df: DataFrame, keys: list[str], order: str, y: str, xs: list[str], size: int | None, least: int) -> DataFrame:
    """Rolling (size rows) or expanding (None) fits at each row with at least `least` rows: beta and r2 from window sums."""
    rows = complete(df, [y, *xs])
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding if size is None else -(size - 1), 0)
    d, k = design(xs), len(xs) + 1
    target = F.col(y)
    sums = rows.select(*keys, order, F.count("*").over(w).alias("n"), F.array(*(F.sum(a * b).over(w) for a in d for b in d)).alias("xtx"), F.array(*(F.sum(a * target).over(w) for a in d)).alias("xty"), F.sum(target * target).over(w).alias("yty"), F.sum(target).over(w).alias("sy"))
    sums = sums.filter(F.col("n") >= least)

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if not len(f):
                continue
            a, b = np.stack(f["xtx"]).reshape(-1, k, k), np.stack(f["xty"])
            good = np.linalg.cond(a) < 1e12
            beta = np.full(b.shape, np.nan)
            beta[good] = np.linalg.solve(a[good], b[good][:, :, None])[:, :, 0]
            tss = f["yty"] - f["sy"] ** 2 / f["n"]
            r2 = 1 - (f["yty"] - (beta * b).sum(axis=1)) / tss.where(tss > 0)
            yield f[[*keys, order, "n"]].assign(beta=[x.tolist() for x in beta], r2=r2)[good]

    return sums.mapInPandas(solve, key_schema(df, [*keys, order]) + "n long, beta array<double>, r2 double")


def window_covariance(df: DataFrame, keys: list[str], order: str, y: str, xs: list[str], size: int, least: int, kind: str = "HAC", lags: int = 3) -> DataFrame:
    """Rolling fits with robust covariance: keys, end (the window's last row), n, beta, cov.

    Residuals belong to a window, so every row goes once into each of the at most `size` windows it lies in.
    """
    ahead = Window.partitionBy(*keys).orderBy(order).rowsBetween(0, size - 1)
    rows = complete(df, [y, *xs]).select(*keys, order, y, *xs).withColumn("ends", F.collect_list(order).over(ahead)).withColumn("end", F.explode("ends")).drop("ends")
    groups = [*keys, "end"]
    fits = ols_fit(rows, groups, y, xs).filter(F.col("n") >= least)
    return covariance(rows, fits, groups, y, xs, kind, lags, order).select(*groups, "n", "beta", "cov")


def window_slope(df: DataFrame, keys: list[str], order: str, y: str, x: str, size: int, least: int, lags: int = 3) -> DataFrame:
    """Rolling fits on one regressor with HAC errors: keys, end (the window's last row), n, beta, se. `window_covariance` without a row for each window.

    A row carries its window as two short arrays over one sort of the series; a batch of windows is one matrix.
    Windows in which x does not vary fall out.
    """
    behind = Window.partitionBy(*keys).orderBy(order).rowsBetween(1 - size, 0)
    rows = complete(df, [y, x]).select(*keys, F.col(order).alias("end"), F.collect_list(F.col(y).cast("double")).over(behind).alias("y_"), F.collect_list(F.col(x).cast("double")).over(behind).alias("x_"))
    rows = rows.filter(F.size("y_") >= max(least, 3))
    names = [*keys, "end"]

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            n = f["y_"].map(len).to_numpy()
            out = pd.DataFrame({**{k: f[k] for k in names}, "n": n.astype("int64"), "beta": np.nan, "se": np.nan})
            for m in np.unique(n):
                at = np.flatnonzero(n == m)
                v, u = (np.stack(f[c].to_numpy()[at]) for c in ("y_", "x_"))
                raw = (u * u).sum(axis=1)
                v, u = v - v.mean(axis=1, keepdims=True), u - u.mean(axis=1, keepdims=True)
                with np.errstate(divide="ignore", invalid="ignore"):
                    sxx = (u * u).sum(axis=1)
                    beta = (u * v).sum(axis=1) / sxx
                    s = u * (v - beta[:, None] * u)
                    meat = (s * s).sum(axis=1) + sum(2 * (1 - k / (lags + 1)) * (s[:, k:] * s[:, : m - k]).sum(axis=1) for k in range(1, min(lags, m - 1) + 1))
                    out.iloc[at, -2], out.iloc[at, -1] = beta, np.where(sxx > 2e-11 * raw, np.sqrt(np.maximum(meat * m / (m - 2), 0)) / sxx, np.nan)
            yield out[out["se"].notna()]

    schema = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in names)
    return rows.mapInPandas(solve, f"{schema}, n long, beta double, se double")


class MovingMoments:
    """Sums of one series over a window that moves on row by row, enough for fits with HAC errors of any of its regressors.

    z holds y, the constant and the regressors of a row, p all products of z with the design. Besides the moments the
    sums of p p' at distance 0 to `lags` are kept: scores are p times known coefficients, so the window's own residuals
    need no second pass. A row enters and leaves with its partners inside the window.
    """

    def __init__(self, k: int, lags: int, size: int | None):
        self.k, self.size = k, size
        self.moments = np.zeros((k + 1, k + 1))
        self.lagged = np.zeros((lags + 1, k * (k + 1), k * (k + 1)))
        self.rows: deque = deque()
        self.n = 0

    def step(self, z: np.ndarray) -> None:
        p = np.outer(z[1:], z).ravel()
        if self.size is not None and self.n == self.size:
            old, gone = self.rows.popleft()
            self.moments -= np.outer(old, old)
            self.lagged[0] -= np.outer(gone, gone)
            for lag in range(1, min(len(self.lagged), self.n)):
                self.lagged[lag] -= np.outer(self.rows[lag - 1][1], gone)
            self.n -= 1
        self.rows.append((z, p))
        self.n += 1
        self.moments += np.outer(z, z)
        for lag in range(min(len(self.lagged), len(self.rows))):
            self.lagged[lag] += np.outer(p, self.rows[-1 - lag][1])
        if self.size is None and len(self.rows) >= len(self.lagged):
            self.rows.popleft()

    def fit(self, use: np.ndarray) -> tuple | None:
        """beta, HAC standard errors, r2 of the design columns `use` (0 is the constant)."""
        k, n, at = len(use), self.n, use + 1
        xtx, xty = self.moments[np.ix_(at, at)], self.moments[at, 0]
        scale = np.sqrt(np.maximum(np.diag(xtx), 1e-300))
        unit = xtx / np.outer(scale, scale)
        if n <= k or np.linalg.cond(unit) > 1e11:
            return None
        inverse = np.linalg.inv(unit) / np.outer(scale, scale)
        beta = inverse @ xty
        g = np.zeros(self.k + 1)
        g[0], g[at] = 1.0, -beta
        cells = self.lagged.reshape(-1, self.k, self.k + 1, self.k, self.k + 1)[:, use][:, :, :, use]
        part = np.einsum("laibj,i,j->lab", cells, g, g)
        lags = len(part) - 1
        meat = part[0] + sum((1 - lag / (lags + 1)) * (part[lag] + part[lag].T) for lag in range(1, lags + 1))
        se = np.sqrt(np.maximum(np.diag(inverse @ meat @ inverse) * n / (n - k), 0))
        tss = self.moments[0, 0] - self.moments[0, 1] ** 2 / n
        rss = self.moments[0, 0] - beta @ xty
        return beta, se, 1 - rss / tss if tss > 0 else None


def window_models(df: DataFrame, keys: list[str], order: str, y: str, xs: list[str], models: dict[str, tuple[str, ...]], size: int | None, least: int, lags: int = 3) -> DataFrame:
    """keys, order (the window's last row), model, n, beta, se (HAC), r2 of every model over rolling (size rows) or expanding (None) windows of at least `least` rows.

    A series is read once in its order; what a task holds is the sums of one series, however long it is. beta and se
    have a place for each of xs behind the constant, zeros where a model leaves it out.
    """
    places = {m: np.array([0, *(1 + xs.index(x) for x in used)]) for m, used in models.items()}
    rows = complete(df, [y, *xs]).select(*keys, order, *(F.col(c).cast("double").alias(c) for c in [y, *xs]))
    names = [*keys, order, "model", "n", "beta", "se", "r2"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        series, state = None, None
        for f in frames:
            out = []
            values = f[[y, *xs]].to_numpy(float)
            for key, at, v in zip(f[keys].itertuples(index=False, name=None), f[order], values):
                if key != series:
                    series, state = key, MovingMoments(len(xs) + 1, lags, size)
                state.step(np.concatenate([v[:1], [1.0], v[1:]]))
                if state.n < least:
                    continue
                for model, use in places.items():
                    if fit := state.fit(use):
                        whole = np.zeros((2, len(xs) + 1))
                        whole[:, use] = fit[:2]
                        out.append((*key, at, model, state.n, whole[0].tolist(), whole[1].tolist(), fit[2]))
            yield pd.DataFrame(out, columns=names)

    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, order)
    return dealt.mapInPandas(run, key_schema(rows, [*keys, order]) + "model string, n long, beta array<double>, se array<double>, r2 double")


def within(df: DataFrame, columns: list[str], entity: str, time: str | None = None, rounds: int = 20) -> DataFrame:
    """Columns less their entity means, and for two ways alternately less their time means."""
    for _ in range(rounds if time else 1):
        for key in [entity, time] if time else [entity]:
            w = Window.partitionBy(key)
            df = df.withColumns({c: F.col(c) - F.avg(c).over(w) for c in columns})
    return df


def fama_macbeth(df: DataFrame, date: str, y: str, xs: list[str], least: int, lags: int) -> DataFrame:
    """Cross-section fits by date, then mean, HAC standard error, t and normal p of each term."""
    fits = ols_fit(df, [date], y, xs).filter(F.col("n") >= least)
    terms = ["const", *xs]
    long = fits.select(date, F.posexplode("beta").alias("i", "b")).select(date, F.element_at(F.array(*map(F.lit, terms)), F.col("i") + 1).alias("name"), "b")
    own = ols_fit(long, ["name"], "b", [])
    cov = covariance(long, own, ["name"], "b", [], "HAC", lags, date)
    return coefficients(cov, ["name"], ["mean"], normal=True).drop("lower", "upper", "term").withColumnRenamed("name", "term")


def vif(df: DataFrame, keys: list[str], xs: list[str]) -> DataFrame:
    """Variance inflation of each regressor from the inverse of their correlation matrix."""
    rows = complete(df, xs)
    c = rows.groupBy(*keys).agg(F.array(*(F.corr(a, b) for a in xs for b in xs)).alias("c"))
    k = len(xs)

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.to_dict("records"):
                m = np.array(r["c"], float).reshape(k, k)
                np.fill_diagonal(m, 1.0)
                v = np.diag(np.linalg.pinv(m)) if np.isfinite(m).all() else np.full(k, np.nan)
                rank, cond = (int(np.linalg.matrix_rank(m)), float(np.linalg.cond(m))) if np.isfinite(m).all() else (0, np.nan)
                out += [(*(r[x] for x in keys), xs[i], float(v[i]), rank, cond) for i in range(k)]
            yield pd.DataFrame(out, columns=[*keys, "term", "vif", "rank", "condition"])

    return c.mapInPandas(solve, key_schema(df, keys) + "term string, vif double, rank long, condition double")


def influence(rows: DataFrame, k: int) -> DataFrame:
    """Adds studentized residual and Cook's distance to `residuals`."""
    s = F.col("e") / (F.col("se_resid") * F.sqrt(1 - F.col("h")))
    return rows.withColumn("studentized", s).withColumn("cooks", s * s * F.col("h") / ((1 - F.col("h")) * k))


def jarque_bera(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    s, kurt = F.skewness(x), F.kurtosis(x) + 3
    jb = F.count(x) / 6 * (s * s + F.pow(kurt - 3, 2) / 4)
    return df.groupBy(*keys).agg(jb.alias("jb"), F.exp(-jb / 2).alias("p"), s.alias("skew"), kurt.alias("kurtosis"))


def with_tail(df: DataFrame, statistic: str, law: str, *freedom: float) -> DataFrame:
    """Adds p, the upper tail of a statistic; one small row a group goes through Python."""
    tail = (lambda x: chi2_upper(x, *freedom)) if law == "chi2" else (lambda x: float(f_upper(np.array([x]), *freedom)[0]))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(p=[tail(x) if x == x else None for x in f[statistic]])

    return df.mapInPandas(run, ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in df.schema) + ", p double")


def breusch_pagan(rows: DataFrame, keys: list[str], xs: list[str]) -> DataFrame:
    """n R2 of squared residuals on the regressors, with its chi-square tail."""
    own = rows.select(*keys, *xs, (F.col("e") * F.col("e")).alias("e2"))
    fits = ols_fit(own, keys, "e2", xs).select(*keys, (F.col("n") * F.col("r2")).alias("lm"))
    return with_tail(fits, "lm", "chi2", len(xs))


def white_test(rows: DataFrame, keys: list[str], xs: list[str]) -> DataFrame:
    """The same on squares and products too; groups with n <= 2 terms fall out."""
    products = {f"{a}_x_{b}": F.col(a) * F.col(b) for i, a in enumerate(xs) for b in xs[i:]}
    own = rows.withColumns(products).withColumn("e2", F.col("e") * F.col("e"))
    terms = [*xs, *products]
    fits = ols_fit(own, keys, "e2", terms).filter(F.col("n") > 2 * (len(terms) + 1)).select(*keys, (F.col("n") * F.col("r2")).alias("lm"))
    return with_tail(fits, "lm", "chi2", len(terms))


def durbin_watson(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    step = F.col("e") - F.lag("e").over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("d_", step).groupBy(*keys).agg((F.sum(F.col("d_") * F.col("d_")) / F.sum(F.col("e") * F.col("e"))).alias("dw"))


def ljung_box(rows: DataFrame, keys: list[str], order: str, lags: int = 5) -> DataFrame:
    """Q at `lags` of centred residuals."""
    w = Window.partitionBy(*keys)
    c = rows.withColumn("c_", F.col("e") - F.avg("e").over(w))
    c = c.withColumns({f"l{k}": F.col("c_") * F.lag("c_", k).over(w.orderBy(order)) for k in range(1, lags + 1)})
    s = c.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.col("c_") * F.col("c_")).alias("v"), *(F.sum(f"l{k}").alias(f"s{k}") for k in range(1, lags + 1)))
    q = sum((F.pow(F.col(f"s{k}") / F.col("v"), 2) / (F.col("n") - k) for k in range(1, lags + 1)), F.lit(0.0)) * F.col("n") * (F.col("n") + 2)
    return with_tail(s.select(*keys, q.alias("q")), "q", "chi2", lags)


#: Response surface of the unit-root law with a constant: bounds of the statistic, where its form changes, and the
#: polynomials of both forms from the constant term on (fixed values, MacKinnon 1994).
ADF_LEAST, ADF_MOST, ADF_TURN = -18.83, 2.74, -1.61
ADF_SMALL, ADF_LARGE = (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)


def adf_tail(statistic: float) -> float:
    """p of a unit-root statistic (regression with a constant) from the response surface."""
    if statistic >= ADF_MOST:
        return 1.0
    if statistic <= ADF_LEAST:
        return 0.0
    surface = ADF_SMALL if statistic <= ADF_TURN else ADF_LARGE
    return NormalDist().cdf(sum(c * statistic**i for i, c in enumerate(surface)))


def adf_system(r: dict) -> tuple[np.ndarray, np.ndarray]:
    """Cross products of (1, level, d1 ... dL, dx) over the sample common to all lags, and the rows that smaller lags add (NaN beyond)."""
    most, head, tail = r["most"], np.array([x["x"] for x in r["head"]]), np.array([x["d"] for x in r["tail"]])
    product, first = np.zeros((most + 3, most + 3)), np.diff(head)
    d = np.arange(2, most + 2)
    product[0, 0] = r["held"]
    product[0, 1], product[1, 1], product[0, -1], product[1, -1] = r["level"], r["level2"], r["sums"][0], r["crosses"][0]
    product[0, d], product[1, d], product[d, -1] = r["sums"][1 : most + 1], r["crosses"][1 : most + 1], r["lagged"][1 : most + 1]
    product[-1, -1] = r["lagged"][0]
    for h in range(most):
        # Sums of products h apart, moved back by one place: one product enters at the start, one leaves at the end.
        now = r["lagged"][h]
        for i in range(1, most - h + 1):
            now += first[most - i] * first[most - i - h] - tail[len(tail) - i] * tail[len(tail) - i - h]
            product[1 + i, 1 + i + h] = now
    product = np.triu(product) + np.triu(product, 1).T
    early = np.full((most, most + 3), np.nan)
    for t in range(1, most + 1):
        early[t - 1, : t + 1] = [1.0, head[t - 1] - head[0], *first[: t - 1][::-1]]
        early[t - 1, -1] = first[t - 1]
    return product, early


def adf_choice(product: np.ndarray, early: np.ndarray, lags: int | None = None) -> tuple[int, int, float] | None:
    """Lags of least AIC (or those asked for), observations and statistic: one factorisation tells the residual sums of all lags."""
    most = len(product) - 3
    scale = np.sqrt(np.diag(product)[:-1])
    if not (scale > 0).all():
        return None
    unit = product[:-1, :-1] / np.outer(scale, scale)
    try:
        z = np.linalg.solve(np.linalg.cholesky(unit), product[:-1, -1] / scale)
    except np.linalg.LinAlgError:
        return None
    if lags is None:
        held, rss = product[0, 0], product[-1, -1] - np.cumsum(z * z)[1:]
        lags = int(np.argmin(held * np.log(np.maximum(rss, 1e-300)) + 2 * np.arange(most + 1)))
    use = np.array([*range(lags + 2), most + 2])
    p = product[np.ix_(use, use)] + early[lags:, use].T @ early[lags:, use]
    held, beta, inverse = p[0, 0], np.linalg.solve(p[:-1, :-1], p[:-1, -1]), np.linalg.inv(p[:-1, :-1])
    rss = p[-1, -1] - beta @ p[:-1, -1]
    if held <= lags + 2 or rss <= 0:
        return None
    return lags, round(held), float(beta[1] / np.sqrt(rss / (held - lags - 2) * inverse[1, 1]))


def adf_test(df: DataFrame, keys: list[str], order: str, x: str, lags: int | None = None) -> DataFrame:
    """keys, lags, n_obs, statistic, p of the Dickey-Fuller test with a constant.

    Lags up to 12 (n / 100)^(1/4) (n / 2 - 2 at most) are compared by AIC on one common sample, then the chosen
    number is fitted on all rows it can use; `lags` fixes the number instead. A group is aggregated to sums of
    products at each distance and its first and last few values, from which the cross products of all lags follow.
    """
    whole, up = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("order_")
    rows = complete(df, [x]).select(*keys, F.col(order).alias("order_"), F.col(x).cast("double").alias("x_"))
    rows = rows.withColumns({"n_": F.count("*").over(whole), "i_": F.row_number().over(up), "first_": F.first("x_").over(up)})
    bound = F.least(F.ceil(12 * F.pow(F.col("n_") / 100, 0.25)), F.floor(F.col("n_") / 2) - 2).cast("int") if lags is None else F.when(F.col("n_") >= 2 * lags + 5, F.lit(lags))
    rows = rows.withColumn("most", bound).filter("most >= 0")
    most = rows.agg(F.max("most")).first()[0] or 0
    d = F.col("x_") - F.lag("x_").over(up)
    rows = rows.withColumn("d0", d).withColumn("level_", F.lag("x_").over(up) - F.col("first_")).withColumns({f"d{h}": F.lag("d0", h).over(up) for h in range(1, most + 1)})
    held = F.col("i_") >= F.col("most") + 2
    total = lambda c: F.coalesce(F.sum(F.when(held, c)), F.lit(0.0))
    every = [F.col(f"d{h}") for h in range(most + 1)]
    gathered = rows.groupBy(*keys, "most").agg(
        F.count(F.when(held, 1)).alias("held"), total(F.col("level_")).alias("level"), total(F.col("level_") * F.col("level_")).alias("level2"),
        F.array(*map(total, every)).alias("sums"), F.array(*(total(F.col("level_") * c) for c in every)).alias("crosses"), F.array(*(total(every[0] * c) for c in every)).alias("lagged"),
        F.array_sort(F.collect_list(F.when(F.col("i_") <= F.col("most") + 1, F.struct("i_", F.col("x_").alias("x"))))).alias("head"),
        F.array_sort(F.collect_list(F.when(F.col("i_") > F.col("n_") - F.col("most"), F.struct("i_", F.col("d0").alias("d"))))).alias("tail"))

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.to_dict("records"):
                if found := adf_choice(*adf_system(r), lags):
                    out.append((*(r[k] for k in keys), *found, adf_tail(found[2])))
            yield pd.DataFrame(out, columns=[*keys, "lags", "n_obs", "statistic", "p"])

    return gathered.mapInPandas(solve, key_schema(df, keys) + "lags long, n_obs long, statistic double, p double")


def holm(df: DataFrame, family: list[str], p: str, ties: str) -> DataFrame:
    """Step-down familywise adjusted p."""
    w = Window.partitionBy(*family)
    out = df.withColumn("k_", F.row_number().over(w.orderBy(F.col(p).asc_nulls_last(), ties))).withColumn("m_", F.count(p).over(w))
    step = F.col(p) * (F.col("m_") - F.col("k_") + 1)
    out = out.withColumn("s_", step).withColumn("p_holm", F.least(F.lit(1.0), F.max("s_").over(w.orderBy(F.col(p).asc_nulls_last(), ties).rowsBetween(Window.unboundedPreceding, 0))))
    return out.drop("k_", "m_", "s_")
