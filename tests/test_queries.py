"""A query of each family against its DuckDB text, and identities with hand answers."""

import glob
import os
from datetime import date, datetime

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
SAMPLE = ("a12_tagged_html_facts", "a13_xml_instance_facts", "a13_rejected_instances", "a14_filing_header_fields", "a17_content_fingerprint", "b13_succession_graph_check", "c15_constituent_overlap", "d22_missing_sessions", "h06_membership_rebuild_check", "i09_rolling_models", "i10_expanding_models", "i23_adf_unit_root", "i23_adf_fixed_lag", "i29_custom_model", "l12_assign_and_purge", "l17_saved_pipeline", "l29_permutation_importance",
          "a10_column_arrays_to_rows", "a16_immutable_publish", "a23_quarantine_sink", "i09_rolling_hac", "b02_daily_market_rules", "b06_calendar_coverage", "b25_lineage_graph_check", "b29_temporal_fold_audit", "b30_benchmark_conflict", "h02_holding_coverage_gate", "i01_holding_period_market", "i02_research_panel", "i20_white_test", "i28_self_exclusion_refit", "i29_pricing_grid", "d25_paired_model_difference", "l38_economic_check", "b10_mapping_overlap_conflicts", "c01_pit_asof_panel", "c03_effective_dated_lookup", "c06_holding_interval_join", "d03_prior_year_lags", "e09_quote_chain_verify", "e12_forward_targets_frame",
          "f18_momentum_12_1m", "g08_score_factors", "h01_month_end_quantile_portfolios", "i04_ols_fit", "i07_cov_hac", "j10_backtest_accounting", "k16_risk_summary", "l08_future_drawdown", "m04_symmetric_difference", "n01_scalar_strings")


def plain(v):
    if v is None or v != v:
        return ""
    if isinstance(v, (date, datetime)):
        return str(v)[:10]
    return v if isinstance(v, float) else str(v)


def key(row):
    return tuple("" if isinstance(v, float) else v for v in row), tuple(v for v in row if isinstance(v, float))


def alike(x, y):
    if isinstance(x, float) and isinstance(y, float):
        return abs(x - y) <= 1e-5 * max(1.0, abs(x))
    return x == y


#: ALL_QUERIES=1 compares every query that has SQL, the corpus operators included.
NAMES = sorted(entry.oracle_sql()) if os.environ.get("ALL_QUERIES") else SAMPLE


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    found = entry.queries()[name](spark, DATA)
    want = con.sql(entry.oracle_sql()[name])
    assert sorted(found.columns) == sorted(want.columns)
    order = [want.columns.index(c) for c in found.columns]
    a = sorted((tuple(map(plain, r)) for r in found.collect()), key=key)
    b = sorted((tuple(plain(r[i]) for i in order) for r in want.fetchall()), key=key)
    assert len(a) == len(b)
    assert not [(x, y) for x, y in zip(a, b) if not all(map(alike, x, y))][:5]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_quote_path(spark):
    from pitwell.operators.portfolios import verified_paths

    days = [date(2020, 1, d) for d in (1, 2, 3, 6)]
    def status(prices, rets):
        q = spark.createDataFrame([("a", d, p, r) for d, p, r in zip(days, prices, rets) if p is not None], "security_id string, date date, price double, ret double")
        c = spark.createDataFrame([(days[0], days[-1])], "entry date, exit date")
        return verified_paths(q, c).first()

    good = status([40.0, 50.0, 45.0, 54.0], [0.0, 0.25, -0.1, 0.2])
    assert good.status == "COMPLETE_VALID" and abs(good.realized - 0.35) < 1e-12
    assert status([40.0, 50.0, 45.0, None], [0.0, 0.25, -0.1, 0.0]).status == "MISSING_ENDPOINT_NO_AUTHENTIC_TERMINAL"
    assert status([40.0, 0.0, 45.0, 54.0], [0.0, 0.25, -0.1, 0.2]).status == "INVALID_QUOTE"
    assert status([40.0, 50.0, 45.0, 54.0], [0.0, 0.25, 0.3, 0.2]).status == "UNRECONCILED_QUOTE_RETURN_CHAIN"


def test_trade_costs(spark):
    from pyspark.sql import functions as F

    from pitwell.operators.portfolios import backtest, trade_costs

    rows = [(d, a, 0.5, r) for d, ra in ((1, 0.0), (2, 0.1)) for a, r in (("A", ra), ("B", 0.0))]
    df = spark.createDataFrame(rows, "date int, asset_id string, weight double, ret double").withColumns({"book": F.lit("x"), "bench": F.lit(0.0)})
    out = {r.date: r for r in backtest(df, ["book"], "bench", trade_costs(0, 10, 5)).collect()}
    assert abs(out[1].cost - 0.001) < 1e-12 and abs(out[2].gross - 0.05) < 1e-12


def test_tails():
    import numpy as np

    from pitwell.functions.tails import chi2_upper, f_upper, t_two_sided

    assert abs(t_two_sided(np.array([2.2281388519649385]), 10)[0] - 0.05) < 1e-10
    assert abs(chi2_upper(3.841458820694124, 1) - 0.05) < 1e-10
    assert abs(f_upper(np.array([4.964602743730711]), 1, 10)[0] - 0.05) < 1e-9


def test_strict_joins_raise(spark):
    from pitwell.operators.joins import JoinError, checked_join

    left = spark.createDataFrame([(1,)], "k int")
    right = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(JoinError):
        checked_join(left, right, ["k"])


def test_publish_once(spark, tmp_path):
    from pitwell.operators.joins import JoinError
    from pitwell.sources.sinks import publish

    df, path = spark.range(5).toDF("k"), f"file://{tmp_path}/t"
    assert publish(df, path) == publish(df, path)
    with pytest.raises(JoinError):
        publish(spark.range(6).toDF("k"), path)


def test_deep_graphs(spark):
    from pitwell.operators import checks, lineage

    ring = spark.createDataFrame([(i, (i + 1) % 100) for i in range(100)] + [(200 + i, 201 + i) for i in range(100)] + [(200, 300)], "predecessor long, successor long")
    found = {(x.rule, x.node) for x in checks.succession(ring).collect()}
    assert found == {("cycle", i) for i in range(100)} | {("several_successors", 200)}
    chain = spark.createDataFrame([(i, i + 1) for i in range(150)], "child long, parent long")
    assert {tuple(x) for x in lineage.ancestors(chain).collect()} == {(i, j) for i in range(150) for j in range(i + 1, 151)}


def test_learning_of_every_fold(spark):
    run = entry.queries()
    folds = {x.fold for x in run["l11_temporal_folds"](spark, DATA).select("fold").distinct().collect()}
    for name in ("l22_lasso", "l27_calibrate_classifier", "l29_permutation_importance"):
        assert {x.fold for x in run[name](spark, DATA).select("fold").distinct().collect()} == folds and len(folds) > 1
