import numpy as np
from pyspark.sql import functions as F

from pitwell.operators import alloc

_SPREAD = np.array([[0.3, 0.1, 0.0, 0.1], [0.0, 0.2, 0.1, -0.1], [0.1, 0.0, 0.2, 0.1]])
COV = _SPREAD @ _SPREAD.T


def test_minimum_variance_is_stationary():
    w = alloc.solve("minimum_variance", COV, np.zeros(3), np.zeros((1, 3)), 1.0)
    exact = np.linalg.solve(COV, np.ones(3))
    assert abs(w.sum() - 1) < 1e-9 and np.allclose(w, exact / exact.sum(), atol=1e-5)


def test_risk_parity_shares():
    w = alloc.solve("risk_parity", COV, np.zeros(3), np.zeros((1, 3)), 1.0)
    share = w * (COV @ w)
    assert np.allclose(share / share.sum(), 1 / 3, atol=1e-8)


def test_maximum_sharpe_direction():
    mu = np.array([0.08, 0.05, 0.04])
    exact = np.linalg.solve(COV, mu)
    assert np.allclose(alloc.solve("maximum_sharpe", COV, mu, np.zeros((1, 3)), 1.0), exact / exact.sum(), atol=1e-4)


def test_hierarchical_and_simplex():
    w = alloc.hierarchical(COV)
    assert abs(w.sum() - 1) < 1e-12 and (w > 0).all()
    assert np.allclose(alloc.to_simplex(np.array([0.5, 0.5, 3.0]), 0.6).sum(), 1)


def test_every_whole_window(spark):
    from pitwell.plans import allocation, tables
    from pitwell.plans.portfolio import held

    t = tables.Tables(spark, "/root/testdata/sf0.001")
    dates = held(t).select("date").distinct().count()
    got = allocation.problems(t).groupBy("problem").agg(F.count_distinct("date").alias("n")).collect()
    assert sorted(x.problem for x in got) == list(range(24, dates + 1)) and {x.n for x in got} == {24}


def test_portfolios_read_once(spark):
    """The windows start from the written portfolios: nothing of the given tables is left in their plan."""
    from pitwell.plans import allocation, tables

    plan = allocation.problems(tables.Tables(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    assert "l_suppkey" not in plan and "l_shipdate" not in plan
