"""Unit-root tests and windows of models against plain least squares."""

import numpy as np
import pytest

from pitwell.operators import regress as R


def plain_adf(x, lags=None):
    """Every lag fitted by itself on the common sample, then the chosen one on all rows it can use."""
    d, n = np.diff(x), len(x)
    most = min(int(np.ceil(12 * (n / 100) ** 0.25)), n // 2 - 2) if lags is None else lags
    if most < 0:
        return None

    def fit(p, skip):
        y = d[skip:]
        z = np.column_stack([np.ones(len(y)), x[skip:-1], *(d[skip - j : len(d) - j] for j in range(1, p + 1))])
        beta, *_ = np.linalg.lstsq(z, y, rcond=None)
        rss = ((y - z @ beta) ** 2).sum()
        return len(y) * np.log(rss) + 2 * p, len(y), beta[1] / np.sqrt(rss / (len(y) - p - 2) * np.linalg.inv(z.T @ z)[1, 1])

    best = min(range(most + 1), key=lambda p: (fit(p, most)[0], p)) if lags is None else lags
    return best, *fit(best, best)[1:]


@pytest.mark.parametrize("lags", [None, 0, 3])
def test_unit_root(spark, lags):
    r = np.random.default_rng(4)
    series = {"walk": np.cumsum(r.normal(size=300)) + 50, "noise": r.normal(size=60), "short": r.normal(size=9)}
    long = np.zeros(500)
    for t in range(7, 500):
        long[t] = 0.4 * long[t - 1] - 0.5 * long[t - 4] + 0.3 * long[t - 7] + r.normal()
    series["long"] = long
    series["tiny"], series["level"] = r.normal(size=3), np.ones(40)
    rows = [(k, i, float(v)) for k, x in series.items() for i, v in enumerate(x)] + [("walk", -1, None), ("gone", 0, None)]
    got = {x.key: x for x in R.adf_test(spark.createDataFrame(rows, "key string, date long, x double"), ["key"], "date", "x", lags).collect()}
    assert set(got) == {"walk", "noise", "long"} | ({"short"} if lags in (None, 0) else set())
    for k, x in got.items():
        best, n, statistic = plain_adf(series[k], lags)
        assert (x.lags, x.n_obs) == (best, n) and abs(x.statistic - statistic) < 1e-6 * max(1, abs(statistic))
    if lags is None:
        assert got["long"].lags >= 6 and got["walk"].p > 0.05 and got["noise"].p < 0.01


def test_unit_root_tail():
    """Known critical values of the law with a constant: -3.43, -2.86 and -2.57."""
    assert [round(R.adf_tail(x), 2) for x in (-3.43, -2.86, -2.57)] == [0.01, 0.05, 0.1]
    assert (R.adf_tail(3), R.adf_tail(-19)) == (1.0, 0.0) and abs(R.adf_tail(-1.6099999) - R.adf_tail(-1.61)) < 0.01


@pytest.mark.parametrize("size", [12, None])
def test_window_models(spark, size):
    r = np.random.default_rng(1)
    models, xs = {"one": ("a",), "two": ("c", "a"), "none": ()}, ["a", "b", "c"]
    rows = [(k, i, *map(float, r.normal(size=4))) for k in ("u", "v") for i in range(40)]
    rows = [(k, i, y + 0.5 * a, a, b, c) for k, i, y, a, b, c in rows] + [("u", 99, None, 1.0, 1.0, 1.0), ("w", 0, 1.0, 1.0, 1.0, 1.0)]
    got = R.window_models(spark.createDataFrame(rows, "key string, date long, y double, a double, b double, c double"), ["key"], "date", "y", xs, models, size, 10, 2).collect()
    assert len(got) == 2 * 3 * 31
    for x in got:
        part = np.array([v[2:] for v in rows if v[0] == x.key and v[1] <= x.date and (size is None or v[1] > x.date - size)])
        use = [1 + xs.index(m) for m in models[x.model]]
        z = np.column_stack([np.ones(len(part)), part[:, use]])
        beta = np.linalg.lstsq(z, part[:, 0], rcond=None)[0]
        u = z * (part[:, 0] - z @ beta)[:, None]
        meat = u.T @ u + sum((1 - k / 3) * (u[k:].T @ u[:-k] + u[:-k].T @ u[k:]) for k in (1, 2))
        inverse = np.linalg.inv(z.T @ z)
        se = np.sqrt(np.diag(inverse @ meat @ inverse) * len(z) / (len(z) - z.shape[1]))
        at = [0, *use]
        assert x.n == len(part) and np.allclose(np.array(x.beta)[at], beta) and np.allclose(np.array(x.se)[at], se) and x.beta[2] == 0


def test_window_slope(spark):
    """Windows as arrays give the fits of the exploded windows; no row is made for a window's row; windows without variance fall out."""
    r = np.random.default_rng(2)
    rows = [(k, i, float(y + 0.5 * x), float(x)) for k in ("u", "v") for i, (y, x) in enumerate(r.normal(size=(40, 2)))] + [("flat", i, float(i), 2.0) for i in range(15)] + [("u", 99, None, 1.0)]
    df = spark.createDataFrame(rows, "key string, date long, y double, x double")
    got = R.window_slope(df, ["key"], "date", "y", "x", 9, 5)
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()
    got = {(x.key, x.end): x for x in got.collect()}
    want = {(x.key, x.end): x for x in R.window_covariance(df, ["key"], "date", "y", ["x"], 9, 5).collect()}
    assert got.keys() == want.keys() and len(got) == 72
    for k, x in want.items():
        assert got[k].n == x.n and abs(got[k].beta - x.beta[1]) < 1e-9 and abs(got[k].se - max(x["cov"][3], 0) ** 0.5) < 1e-9
