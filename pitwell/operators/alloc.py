"""Batch covariance and allocation over many problems at once (J04 to J09).

Returns stay long; one problem (a date's window of at most a few hundred assets)
meets in one grouped call, and Spark spreads the problems over tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METHODS = ("minimum_variance", "mean_variance", "maximum_sharpe", "maximum_diversification", "risk_parity", "hierarchical_risk_parity", "minimum_cvar")


def windows_of(returns: DataFrame, dates: DataFrame, size: int, asset: str = "asset_id") -> DataFrame:
    """problem, date, asset, ret: the last `size` dates up to each problem date. dates: problem (position) in positions of `returns`."""
    p = dates.select(F.col("position").alias("problem")).withColumn("position", F.explode(F.sequence(F.col("problem") - (size - 1), F.col("problem"))))
    return returns.join(F.broadcast(p), "position").select("problem", "date", asset, "ret")


def dense(block: pd.DataFrame, asset: str) -> tuple[list, np.ndarray]:
    """Assets with complete rows and their returns, dates by assets."""
    wide = block.pivot_table(index="date", columns=asset, values="ret").dropna(axis=1)
    return list(wide.columns), wide.to_numpy()


def ledoit_wolf(x: np.ndarray) -> tuple[np.ndarray, float]:
    """Covariance shrunk to a scaled identity, and the shrinkage."""
    n, p = x.shape
    x = x - x.mean(axis=0)
    s = x.T @ x / n
    mu = np.trace(s) / p
    spread = ((s - mu * np.eye(p)) ** 2).sum() / p
    noise = ((x**2).T @ (x**2) / n - s**2).sum() / (n * p)
    k = 0.0 if spread <= 0 else min(noise, spread) / spread
    return (1 - k) * s + k * mu * np.eye(p), float(k)


def repaired(cov: np.ndarray, floor: float = 1e-10) -> np.ndarray:
    """Symmetric, eigenvalues not below the floor."""
    w, v = np.linalg.eigh((cov + cov.T) / 2)
    return (v * np.maximum(w, floor)) @ v.T


def to_simplex(w: np.ndarray, upper: float = 1.0) -> np.ndarray:
    """Nearest weights with sum 1 in [0, upper], by bisection on the shift."""
    low, high = w.min() - 1.0, w.max()
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if np.clip(w - mid, 0, upper).sum() > 1 else (low, mid)
    out = np.clip(w - high, 0, upper)
    return out / out.sum()


def descend(value_gradient, n: int, upper: float, steps: int = 500) -> np.ndarray:
    """Projected gradient with backtracking from equal weights."""
    w, size = np.full(n, 1 / n), 1.0
    v, g = value_gradient(w)
    for _ in range(steps):
        while size > 1e-14:
            new = to_simplex(w - size * g, upper)
            nv, ng = value_gradient(new)
            if nv <= v - 1e-4 / size * ((new - w) ** 2).sum():
                break
            size /= 2
        if size <= 1e-14 or np.abs(new - w).max() < 1e-10:
            break
        w, v, g, size = new, nv, ng, size * 2
    return w


def hierarchical(cov: np.ndarray) -> np.ndarray:
    """Order of a single-linkage tree on correlation distance, then bisection with inverse-variance clusters."""
    n, sd = len(cov), np.sqrt(np.diag(cov))
    distance = np.sqrt(np.maximum(0.5 * (1 - cov / np.outer(sd, sd)), 0))
    clusters = [[i] for i in range(n)]
    while len(clusters) > 1:
        best = min(((distance[np.ix_(a, b)].min(), i, j) for i, a in enumerate(clusters) for j, b in enumerate(clusters) if i < j), key=lambda x: x)
        clusters[best[1]] = clusters[best[1]] + clusters.pop(best[2])
    w, stack = np.ones(n), [clusters[0]]

    def variance(part: list[int]) -> float:
        iv = 1 / np.diag(cov)[part]
        iv /= iv.sum()
        return float(iv @ cov[np.ix_(part, part)] @ iv)

    while stack:
        part = stack.pop()
        if len(part) < 2:
            continue
        a, b = part[: len(part) // 2], part[len(part) // 2 :]
        va, vb = variance(a), variance(b)
        share = 1 - va / (va + vb)
        w[a] *= share
        w[b] *= 1 - share
        stack += [a, b]
    return w


def solve(method: str, cov: np.ndarray, mu: np.ndarray, x: np.ndarray, upper: float, aversion: float = 5.0, level: float = 0.95) -> np.ndarray:
    n, sd = len(mu), np.sqrt(np.diag(cov))
    scale = np.trace(cov) / n
    if method == "minimum_variance":
        return descend(lambda w: (w @ cov @ w / scale, 2 * cov @ w / scale), n, upper)
    if method == "mean_variance":
        return descend(lambda w: ((aversion / 2 * w @ cov @ w - mu @ w) / scale, (aversion * cov @ w - mu) / scale), n, upper)
    if method in ("maximum_sharpe", "maximum_diversification"):
        gain = mu if method == "maximum_sharpe" else sd

        def value(w: np.ndarray) -> tuple[float, np.ndarray]:
            s = np.sqrt(w @ cov @ w)
            return -(gain @ w) / s, -gain / s + (gain @ w) * (cov @ w) / s**3

        return descend(value, n, upper)
    if method == "risk_parity":
        w = 1 / sd
        for _ in range(500):  # cyclical: w_i solves w_i (cov w)_i = 1 / n
            for i in range(n):
                b = cov[i] @ w - cov[i, i] * w[i]
                w[i] = (-b + np.sqrt(b * b + 4 * cov[i, i] / n)) / (2 * cov[i, i])
        return w / w.sum()
    if method == "hierarchical_risk_parity":
        return hierarchical(cov)

    def tail(w: np.ndarray) -> tuple[float, np.ndarray]:
        loss = -x @ w
        worst = loss >= np.quantile(loss, level)
        return float(loss[worst].mean()), -x[worst].mean(axis=0)

    w, best = np.full(n, 1 / n), (np.inf, None)
    for k in range(400):  # subgradient steps that shrink
        v, g = tail(w)
        best = min(best, (v, w), key=lambda b: b[0])
        w = to_simplex(w - 0.5 / np.sqrt(k + 1) * g / max(np.linalg.norm(g), 1e-12), upper)
    return best[1]


def covariances(windows: DataFrame, asset: str = "asset_id") -> DataFrame:
    """problem, shrinkage, condition, rank, min_eigenvalue of the shrunk and repaired matrix of each problem."""

    def one(block: pd.DataFrame) -> pd.DataFrame:
        names, x = dense(block, asset)
        cov, k = ledoit_wolf(x)
        w = np.linalg.eigvalsh(repaired(cov))
        return pd.DataFrame([(block["problem"].iloc[0], len(names), k, float(w[-1] / w[0]), int((w > 1e-9).sum()), float(w[0]))], columns=["problem", "assets", "shrinkage", "condition", "rank", "min_eigenvalue"])

    return windows.groupBy("problem").applyInPandas(one, "problem long, assets long, shrinkage double, condition double, rank long, min_eigenvalue double")


def allocate(windows: DataFrame, methods: list[str], ann: float = 12.0, upper: float = 1.0, asset: str = "asset_id") -> DataFrame:
    """problem, method, asset, weight, for every problem and method; long only, sum 1."""
    cases = windows.withColumn("method", F.explode(F.array(*map(F.lit, methods))))
    # A stated number of partitions: the rows are few and the work a problem is long, so they must not end up in one task.
    cases = cases.repartition(4 * windows.sparkSession.sparkContext.defaultParallelism, "problem", "method")

    def one(block: pd.DataFrame) -> pd.DataFrame:
        names, x = dense(block, asset)
        cov = repaired(ledoit_wolf(x)[0] * ann)
        method = block["method"].iloc[0]
        w = solve(method, cov, x.mean(axis=0) * ann, x, max(upper, 1.0 / len(names)))
        return pd.DataFrame({"problem": block["problem"].iloc[0], "method": method, asset: names, "weight": w})

    kind = windows.schema[asset].dataType.simpleString()
    return cases.groupBy("problem", "method").applyInPandas(one, f"problem long, method string, {asset} {kind}, weight double")


def black_litterman(windows: DataFrame, tau: float = 0.05, aversion: float = 2.5, ann: float = 12.0, asset: str = "asset_id") -> DataFrame:
    """problem, asset, prior, posterior: equilibrium means of equal weights blended with the view that the window's best asset beats its worst by its own gap."""

    def one(block: pd.DataFrame) -> pd.DataFrame:
        names, x = dense(block, asset)
        cov, mu = repaired(ledoit_wolf(x)[0] * ann), x.mean(axis=0) * ann
        prior = aversion * cov @ np.full(len(names), 1 / len(names))
        p = np.zeros((1, len(names)))
        p[0, mu.argmax()], p[0, mu.argmin()] = 1, -1
        omega = tau * p @ cov @ p.T + 1e-12
        gain = tau * cov @ p.T @ np.linalg.inv(tau * p @ cov @ p.T + omega)
        return pd.DataFrame({"problem": block["problem"].iloc[0], asset: names, "prior": prior, "posterior": prior + gain @ (p @ mu - p @ prior)})

    kind = windows.schema[asset].dataType.simpleString()
    return windows.groupBy("problem").applyInPandas(one, f"problem long, {asset} {kind}, prior double, posterior double")
