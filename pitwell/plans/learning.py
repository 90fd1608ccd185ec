"""Queries of the learning operators (L)."""

from __future__ import annotations

from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitwell.operators import checks as B
from pitwell.operators import learning as L
from pitwell.operators import portfolios as P
from pitwell.operators import windows as W
from pitwell.operators.storage import new_folder, settled
from pitwell.plans.features import rounded, scores
from pitwell.plans.portfolio import FORMED
from pitwell.plans.registry import query, register
from pitwell.plans.tables import Tables

K = ["security_id", "date"]
FACTORS = ["market_cap", "momentum_1m", "turnover"]
PIVOT = "SELECT security_id, date, max(raw) FILTER (factor_id = 'market_cap') AS market_cap, max(raw) FILTER (factor_id = 'momentum_1m') AS momentum_1m, max(raw) FILTER (factor_id = 'turnover') AS turnover FROM scores_ GROUP BY 1, 2"
NXT = "(PARTITION BY security_id ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)"
DATA = FORMED | {
    "feat_": f"SELECT * FROM ({PIVOT}) WHERE (market_cap IS NOT NULL)::INT + (momentum_1m IS NOT NULL)::INT + (turnover IS NOT NULL)::INT >= 2",
    "sess_": "SELECT date, dense_rank() OVER (ORDER BY date) AS session FROM (SELECT DISTINCT date FROM panel)",
    "tgt_": f"""SELECT security_id, date, lead(date, 3) OVER (PARTITION BY security_id ORDER BY date) AS label_end, lead(session, 3) OVER (PARTITION BY security_id ORDER BY date) = session + 3 AND count(ret) OVER {NXT} = 3 AS ok, product(1 + ret) OVER {NXT} - 1 AS gain, product(1 + benchmark_return) OVER {NXT} - 1 AS bench,
 stddev_samp(ret) OVER {NXT} * sqrt(12) AS vol, sqrt(avg(pow(least(ret, 0), 2)) OVER {NXT}) * sqrt(12) AS down, greatest(0, -quantile_cont(ret, 0.05) OVER {NXT}) AS rq,
 lead(ret, 1) OVER o AS r1, lead(ret, 2) OVER o AS r2, lead(ret, 3) OVER o AS r3 FROM panel JOIN sess_ USING (date) WINDOW o AS (PARTITION BY security_id ORDER BY date)""",
    "set_": "SELECT f.*, t.label_end, t.gain AS y FROM feat_ f JOIN tgt_ t USING (security_id, date) WHERE ok",
    "days_": "SELECT date, dense_rank() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM set_)",
    "fold_": "SELECT k AS fold, k * 6 AS shift FROM range(0, ((SELECT count(*) FROM days_) - 50) // 6 + 1) r(k)",
    "split_": """SELECT s.*, fold, CASE WHEN d.i < shift + 36 THEN CASE WHEN label_end >= v.date THEN 'purged' ELSE 'train' END WHEN d.i BETWEEN shift + 37 AND shift + 42 THEN CASE WHEN label_end >= w.date THEN 'purged' ELSE 'validation' END
 WHEN d.i BETWEEN shift + 44 AND shift + 49 THEN 'test' ELSE 'unused' END AS role FROM set_ s JOIN days_ d USING (date) CROSS JOIN fold_ JOIN days_ v ON v.i = shift + 37 JOIN days_ w ON w.i = shift + 44""",
}


def features(t: Tables) -> DataFrame:
    return L.assemble(scores(t), FACTORS, 0.5)


def panel_sessions(t: Tables) -> DataFrame:
    return t.panel.join(F.broadcast(W.session_positions(t.panel)), "date")


def target(t: Tables, kind: str) -> DataFrame:
    p = panel_sessions(t)
    value = L.forward_target(p, kind, 3, ["security_id"], "date", "ret", "benchmark_return", "session", 12.0)
    return p.select(*K, value.alias("y"), F.lead("date", 3).over(Window.partitionBy("security_id").orderBy("date")).alias("label_end"))


def learning_set(t: Tables) -> DataFrame:
    return features(t).join(target(t, "return").filter("y IS NOT NULL"), K)


def split(t: Tables) -> DataFrame:
    """Purged rows of all folds; written once, as several fits of one query read them."""
    if "split" not in t.__dict__:
        d = settled(learning_set(t), "learning-set")
        t.__dict__["split"] = settled(L.assign_and_purge(d, folds(t, d), "date", "label_end"), "split")
    return t.__dict__["split"]


def folds(t: Tables, d: DataFrame | None = None) -> DataFrame:
    return L.temporal_folds(d if d is not None else learning_set(t), "date", 36, 6, 6, embargo=1, step=6)


register("l01_assemble_features", lambda t: features(t).select(*K, F.round("market_cap", 2).alias("market_cap"), F.round("momentum_1m", 6).alias("momentum_1m"), F.round("turnover", 6).alias("turnover")), "SELECT security_id, date, round(market_cap, 2) AS market_cap, round(momentum_1m, 6) AS momentum_1m, round(turnover, 6) AS turnover FROM feat_", DATA)
register("l02_add_interactions", lambda t: L.interactions(features(t), [("momentum_1m", "turnover")]).select(*K, F.round("momentum_1m__x__turnover", 6).alias("value")), "SELECT security_id, date, round(momentum_1m * turnover, 6) AS value FROM feat_", DATA)
register("l03_monthly_decisions", lambda t: W.common_month_end(features(t)).select(*K), "SELECT security_id, date FROM feat_ WHERE date IN (SELECT max(date) FROM feat_ GROUP BY date_trunc('month', date))", DATA)
for _n, _kind, _sql in (("l04_future_return", "return", "gain"), ("l05_future_excess_return", "excess_return", "gain - bench"), ("l05_outperformance", "outperformance", "(gain - bench > 0)::INT::DOUBLE"), ("l06_future_volatility", "volatility", "vol"), ("l07_future_downside_volatility", "downside_volatility", "down"),
                        ("l08_future_drawdown", "drawdown", "least(r1, (1 + r1) * (1 + r2) / greatest(1, 1 + r1) - 1, (1 + r1) * (1 + r2) * (1 + r3) / greatest(1, 1 + r1, (1 + r1) * (1 + r2)) - 1)"), ("l09_future_risk_quantile", "risk_quantile", "rq")):
    register(_n, (lambda k: lambda t: target(t, k).select(*K, F.round("y", 6).alias("value")))(_kind), f"SELECT security_id, date, CASE WHEN ok THEN round({_sql}, 6) END AS value FROM tgt_", DATA)


@query("l10_cross_section_targets", "SELECT security_id, date, round(rank() OVER (PARTITION BY date ORDER BY y) / count(*) OVER (PARTITION BY date), 6) AS pct, row_number() OVER (PARTITION BY date ORDER BY y, security_id) AS ordinal FROM set_", DATA)
def l10(t: Tables) -> DataFrame:
    return learning_set(t).select(*K, F.round(W.percentile_rank("y", ["date"]), 6).alias("pct"), W.ordinal_rank("y", ["date"], ["security_id"]).cast("long").alias("ordinal"))


register("l11_temporal_folds", folds, "SELECT fold, 'train' AS role, 0 AS first, shift + 35 AS last FROM fold_ UNION ALL SELECT fold, 'validation', shift + 37, shift + 42 FROM fold_ UNION ALL SELECT fold, 'test', shift + 44, shift + 49 FROM fold_", DATA)
register("l12_assign_and_purge", lambda t: split(t).groupBy("fold", "role").agg(F.count("*").alias("n")), "SELECT fold, role, count(*) AS n FROM split_ GROUP BY 1, 2", DATA)
register("b29_temporal_fold_audit", lambda t: B.temporal_folds_audit(split(t), learning_set(t).select("date").distinct().withColumn("session", F.dense_rank().over(Window.orderBy("date"))), 1),
         """WITH m AS (SELECT fold, role, min(s.date) AS a, max(s.date) AS b, max(label_end) AS e, min(d.i) AS ai, max(d.i) AS bi FROM split_ s JOIN days_ d USING (date) WHERE role IN ('train', 'validation', 'test') GROUP BY 1, 2),
f AS (SELECT fold, max(e) FILTER (role = 'train') AS te, max(bi) FILTER (role = 'train') AS tb, min(a) FILTER (role = 'validation') AS va, min(ai) FILTER (role = 'validation') AS vi, max(e) FILTER (role = 'validation') AS ve, max(bi) FILTER (role = 'validation') AS vb, min(a) FILTER (role = 'test') AS sa, min(ai) FILTER (role = 'test') AS si FROM m GROUP BY 1)
SELECT fold, coalesce(te < va, true) AS train_before_validation, coalesce(ve < sa, true) AS validation_before_test, coalesce(vi - tb > 1 AND si - vb > 1, true) AS embargo_kept FROM f""", DATA)  # fmt: skip
register("l14_impute_training_median", lambda t: L.train_statistics(split(t), ["fold"], ["turnover"]).select("fold", F.round(F.get("turnover_q", F.lit(2)), 6).alias("median")), "SELECT fold, round(median(turnover), 6) AS median FROM split_ WHERE role = 'train' GROUP BY 1", DATA)
register("l15_impute_cross_sectional_median", lambda t: L.cross_sectional_median(t.panel_m, ["ret"]).select(*K, F.round("ret", 8).alias("ret")), "SELECT security_id, date, round(coalesce(ret, median(ret) OVER (PARTITION BY date)), 8) AS ret FROM panel_m")
register("l16_winsorize_train_bounds", lambda t: L.train_statistics(split(t), ["fold"], ["turnover"]).select("fold", F.round(F.get("turnover_q", F.lit(0)), 6).alias("low"), F.round(F.get("turnover_q", F.lit(4)), 6).alias("high")), "SELECT fold, round(quantile_cont(turnover, 0.01), 6) AS low, round(quantile_cont(turnover, 0.99), 6) AS high FROM split_ WHERE role = 'train' GROUP BY 1", DATA)
TR = "(SELECT fold, avg(turnover) AS m, stddev_pop(turnover) AS s, quantile_cont(turnover, 0.25) AS a, median(turnover) AS b, quantile_cont(turnover, 0.75) AS c FROM split_ WHERE role = 'train' GROUP BY 1)"
register("l17_scale_standard", lambda t: L.preprocess(split(t), ["fold"], ["turnover"], clip=False).filter("role = 'test'").select("fold", *K, F.round("turnover", 5).alias("value")), f"SELECT fold, security_id, date, round((coalesce(turnover, b) - m) / s, 5) AS value FROM split_ JOIN {TR} USING (fold) WHERE role = 'test'", DATA)
register("l17_scale_robust", lambda t: L.preprocess(split(t), ["fold"], ["turnover"], clip=False, scale="robust").filter("role = 'test'").select("fold", *K, F.round("turnover", 5).alias("value")), f"SELECT fold, security_id, date, round((coalesce(turnover, b) - b) / (c - a), 5) AS value FROM split_ JOIN {TR} USING (fold) WHERE role = 'test'", DATA)


@query("l17_saved_pipeline", f"SELECT fold, security_id, date, round((coalesce(turnover, b) - m) / s, 5) AS value FROM split_ JOIN {TR} USING (fold) WHERE role = 'test'", DATA)
def l17_saved(t: Tables) -> DataFrame:
    """Each fold's scaler fitted, saved, loaded and applied; the number of folds is small."""
    from pyspark.ml import Pipeline, PipelineModel

    from pitwell.operators.estimators import TrainingScaler

    rows, parts = split(t), []
    for fold in sorted(r.fold for r in rows.select("fold").distinct().collect()):
        path = new_folder(t.spark, "pipeline")
        one = rows.filter(F.col("fold") == fold)
        Pipeline(stages=[TrainingScaler(inputCols=["turnover"], clip=False)]).fit(one.filter("role = 'train'")).write().save(path)
        parts.append(PipelineModel.load(path).transform(one.filter("role = 'test'")))
    return reduce(DataFrame.unionByName, parts).select("fold", *K, F.round("turnover", 5).alias("value"))


register("l18_scale_rank", lambda t: features(t).select(*K, F.round(W.percentile_rank("turnover", ["date"]), 6).alias("value")), "SELECT security_id, date, round((rank() OVER (PARTITION BY date ORDER BY turnover) + (count(*) OVER (PARTITION BY date, turnover) - 1) / 2) / count(*) OVER (PARTITION BY date), 6) AS value FROM feat_", DATA)
register("l19_fit_window_gate", lambda t: split(t).filter("role = 'train'").groupBy("fold").agg(F.max("date").alias("last_fit"), (F.max("label_end") > F.max("date")).alias("label_after")), "SELECT fold, max(date) AS last_fit, max(label_end) > max(date) AS label_after FROM split_ WHERE role = 'train' GROUP BY 1", DATA)
register("l20_baseline_models", lambda t: split(t).filter("role = 'train'").groupBy("fold").agg(F.lit(0.0).alias("zero"), F.round(F.avg("y"), 6).alias("train_mean")), "SELECT fold, 0.0::DOUBLE AS zero, round(avg(y), 6) AS train_mean FROM split_ WHERE role = 'train' GROUP BY 1", DATA)


def predictions(t: Tables, l2: float = 0.0, names=("momentum_1m", "turnover")) -> DataFrame:
    return L.linear_model(split(t).filter("turnover IS NOT NULL AND momentum_1m IS NOT NULL"), "fold", list(names), "y", l2)


ONE = DATA | {"pred_": "SELECT s.*, a + b * turnover AS prediction FROM split_ s JOIN (SELECT fold, regr_intercept(y, turnover) AS a, regr_slope(y, turnover) AS b FROM split_ WHERE role = 'train' AND turnover IS NOT NULL AND momentum_1m IS NOT NULL GROUP BY 1) USING (fold) WHERE role = 'test' AND turnover IS NOT NULL AND momentum_1m IS NOT NULL"}
register("l21_linear", lambda t: predictions(t, 0.0, ["turnover"]).select("fold", *K, F.round("prediction", 6).alias("prediction")), "SELECT fold, security_id, date, round(prediction, 6) AS prediction FROM pred_", ONE)


def ridge_sql(l2: float, role: str) -> str:
    """Rows of a role with the prediction of the two-feature ridge: centred normal equations, so that the constant isn't shrunk."""
    known = "turnover IS NOT NULL AND momentum_1m IS NOT NULL"
    return f"""SELECT s.*, b1, b2, my + b1 * (momentum_1m - m1) + b2 * (turnover - m2) AS prediction FROM split_ s JOIN (
 SELECT fold, my, m1, m2, (c1 * (v2 + {l2}) - c2 * c12) / ((v1 + {l2}) * (v2 + {l2}) - c12 * c12) AS b1, (c2 * (v1 + {l2}) - c1 * c12) / ((v1 + {l2}) * (v2 + {l2}) - c12 * c12) AS b2
 FROM (SELECT fold, avg(y) AS my, avg(momentum_1m) AS m1, avg(turnover) AS m2, var_pop(momentum_1m) * count(*) AS v1, var_pop(turnover) * count(*) AS v2, covar_pop(y, momentum_1m) * count(*) AS c1, covar_pop(y, turnover) * count(*) AS c2, covar_pop(momentum_1m, turnover) * count(*) AS c12
 FROM split_ WHERE role = 'train' AND {known} GROUP BY 1)) USING (fold) WHERE role = '{role}' AND {known}"""


def measures_sql(table: str, head: str) -> str:
    """RMSE and Spearman per fold of a table with y and prediction."""
    ranks = ", ".join(f"rank() OVER (PARTITION BY fold ORDER BY {c}) + (count(*) OVER (PARTITION BY fold, {c}) - 1) / 2 AS {r}" for c, r in (("y", "ry"), ("prediction", "rp")))
    return f"SELECT {head}, fold, round(sqrt(avg(pow(prediction - y, 2))), 6) AS rmse, round(corr(ry, rp), 6) AS spearman FROM (SELECT *, {ranks} FROM {table}) GROUP BY fold"


register("l21_ridge", lambda t: predictions(t, 1.0).select("fold", *K, F.round("prediction", 6).alias("prediction")), f"SELECT fold, security_id, date, round(prediction, 6) AS prediction FROM ({ridge_sql(1.0, 'test')})", DATA)


#: Folds whose models are fitted at the same time; their jobs are short beside the driver's part.
FOLDS_AT_ONCE = 3


def by_fold(t: Tables, one, classifier: bool = False) -> DataFrame:
    """one(rows by role) of every fold, rows with label and features, in one table; the number of folds is small.

    The rows are written by fold and role, so that a fit, which reads them again and again, reads its own only.
    """
    from pyspark import inheritable_thread_target
    from pyspark.ml.feature import VectorAssembler

    rows = split(t).filter("role IN ('train', 'validation', 'test')").na.drop(subset=["turnover", "momentum_1m", "y"]).select("fold", "role", *K, "turnover", "momentum_1m", "y")
    rows = settled(rows, "by-fold", ("fold", "role")).withColumn("label", (F.col("y") > 0).cast("double") if classifier else F.col("y"))
    rows = VectorAssembler(inputCols=["turnover", "momentum_1m"], outputCol="features").transform(rows)
    ids = [r.fold for r in split(t).select("fold").distinct().orderBy("fold").collect()]

    def fitted(k: int) -> DataFrame:
        mine = rows.filter(F.col("fold") == k)
        return one({role: mine.filter(F.col("role") == role) for role in ("train", "validation", "test")})

    with ThreadPool(FOLDS_AT_ONCE) as pool:
        parts = pool.map(inheritable_thread_target(t.spark)(fitted), ids)
    return reduce(DataFrame.unionByName, parts)


def ml(t: Tables, make, classifier: bool = False) -> DataFrame:
    """A pyspark.ml model on the train rows of every fold, scored on its test rows."""

    def one(rows: dict[str, DataFrame]) -> DataFrame:
        return make().fit(rows["train"]).transform(rows["test"]).select("fold", *K, "label", F.col("prediction").cast("double").alias("prediction"))

    return by_fold(t, one, classifier)


def boosted(t: Tables) -> DataFrame:
    """Boosted trees of every fold, fitted on the cells of binned train rows: a hundred rounds over at most 32 x 32 rows."""

    def one(rows: dict[str, DataFrame]) -> DataFrame:
        cells, binned = L.binned_cells(rows["train"], ["turnover", "momentum_1m"], "label")
        model = _models()["l25_gradient_boosted_trees"][0]().setWeightCol("weight").fit(cells)
        return model.transform(binned(rows["test"])).select("fold", *K, "label", "prediction")

    return by_fold(t, one)


def _models():
    from pyspark.ml import classification as C
    from pyspark.ml import regression as M

    return {
        "l22_lasso": (lambda: M.LinearRegression(regParam=0.001, elasticNetParam=1.0, standardization=False), False),
        "l22_elastic_net": (lambda: M.LinearRegression(regParam=0.001, elasticNetParam=0.5, standardization=False), False),
        "l23_logistic": (lambda: C.LogisticRegression(regParam=0.01, standardization=False), True),
        "l24_random_forest": (lambda: M.RandomForestRegressor(numTrees=20, maxDepth=4, seed=1), False),
        "l25_gradient_boosted_trees": (lambda: M.GBTRegressor(maxIter=100, maxDepth=3, stepSize=0.05, seed=1), False),
    }


for _n in ("l22_lasso", "l22_elastic_net", "l23_logistic", "l24_random_forest"):
    register(_n, (lambda n: lambda t: ml(t, *_models()[n]))(_n))
register("l25_gradient_boosted_trees", boosted)


PENALTIES = (0.0, 1.0, 100.0)
TRIALS = " UNION ALL ".join(measures_sql(f"({ridge_sql(l2, 'validation')})", f"{k} AS trial, {l2}::DOUBLE AS l2") for k, l2 in enumerate(PENALTIES))


@query("l26_bounded_grid_search", f"SELECT fold, trial, l2, spearman FROM ({TRIALS}) QUALIFY row_number() OVER (PARTITION BY fold ORDER BY coalesce(spearman, -2) DESC, trial) = 1", DATA)
def l26(t: Tables) -> DataFrame:
    """Ridge penalties scored by Spearman (to 6 digits) on validation rows; the first strict best per fold."""
    d = split(t).filter("turnover IS NOT NULL AND momentum_1m IS NOT NULL").withColumn("role", F.when(F.col("role") == "validation", "test").when(F.col("role") == "test", "held").otherwise(F.col("role")))
    out = None
    for trial, l2 in enumerate(PENALTIES):
        m = L.regression_metrics(L.linear_model(d, "fold", ["momentum_1m", "turnover"], "y", l2), ["fold"], "y", "prediction")
        part = m.select("fold", F.lit(trial).alias("trial"), F.lit(l2).alias("l2"), F.round("spearman", 6).alias("spearman"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("fold").agg(F.max_by(F.struct("trial", "l2", "spearman"), F.struct(F.coalesce("spearman", F.lit(-2.0)), -F.col("trial"))).alias("b")).select("fold", "b.*")


@query("l27_calibrate_classifier")
def l27(t: Tables) -> DataFrame:
    """Per fold: logistic regression on train rows, isotonic calibration on validation rows, both applied to test rows."""
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import IsotonicRegression

    def one(rows: dict[str, DataFrame]) -> DataFrame:
        model = _models()["l23_logistic"][0]().fit(rows["train"])
        scored = {role: model.transform(rows[role]).withColumn("p", F.get(vector_to_array("probability"), F.lit(1))).drop("prediction") for role in ("validation", "test")}
        out = IsotonicRegression(featuresCol="p", labelCol="label").fit(scored["validation"]).transform(scored["test"])
        return out.select("fold", *K, "label", "p", F.col("prediction").alias("calibrated"))

    return by_fold(t, one, True)


@query("l28_coefficient_explanation", "SELECT fold, 'turnover' AS feature, round(regr_slope(y, turnover), 6) AS coefficient FROM split_ WHERE role = 'train' AND turnover IS NOT NULL AND momentum_1m IS NOT NULL GROUP BY 1", DATA)
def l28(t: Tables) -> DataFrame:
    return predictions(t, 0.0, ["turnover"]).groupBy("fold").agg(F.round(F.first(F.get("beta", F.lit(1))), 6).alias("coefficient")).withColumn("feature", F.lit("turnover"))


_DEALT = {
    "fit_": ridge_sql(0.0, "test"),
    "own_": "SELECT *, row_number() OVER (PARTITION BY fold ORDER BY md5(security_id || '|' || date)) AS k FROM fit_",
    "anew_": "SELECT fold, r AS repeat, turnover, momentum_1m, row_number() OVER (PARTITION BY fold, r ORDER BY md5('1|' || r || '|' || security_id || '|' || date)) AS k FROM fit_, range(1, 4) t(r)",
    "dealt_": "SELECT o.fold, repeat, feature, o.y, o.prediction + CASE feature WHEN 'turnover' THEN b2 * (a.turnover - o.turnover) ELSE b1 * (a.momentum_1m - o.momentum_1m) END AS p FROM own_ o JOIN anew_ a USING (fold, k), (VALUES ('turnover'), ('momentum_1m')) f(feature)",
}


@query("l29_permutation_importance", "SELECT fold, feature, round(max(base) - avg(r2), 6) AS importance FROM (SELECT fold, feature, repeat, 1 - sum(pow(p - y, 2)) / (var_pop(y) * count(*)) AS r2 FROM dealt_ GROUP BY ALL) JOIN (SELECT fold, 1 - sum(pow(prediction - y, 2)) / (var_pop(y) * count(*)) AS base FROM fit_ GROUP BY 1) USING (fold) GROUP BY 1, 2", DATA | _DEALT)
def l29(t: Tables) -> DataFrame:
    p = settled(predictions(t).select("fold", *K, "turnover", "momentum_1m", "y", "beta"))
    predict = lambda d: d.withColumn("prediction", F.get("beta", F.lit(0)) + F.get("beta", F.lit(1)) * F.col("momentum_1m") + F.get("beta", F.lit(2)) * F.col("turnover"))
    return L.permutation_importance(p, ["fold"], K, ["momentum_1m", "turnover"], "y", predict).withColumn("importance", F.round("importance", 6))


DRIFT = "WITH r AS (SELECT o_totalprice AS x FROM orders WHERE o_orderkey % 2 = 0), c AS (SELECT o_totalprice * 1.1 AS x FROM orders WHERE o_orderkey % 2 = 1), u AS (SELECT x, 1 AS a, 0 AS b FROM r UNION ALL SELECT x, 0, 1 FROM c), g AS (SELECT x, sum(a) AS a, sum(b) AS b FROM u GROUP BY x), k AS (SELECT x, abs(sum(a) OVER (ORDER BY x) / (SELECT count(*) FROM r) - sum(b) OVER (ORDER BY x) / (SELECT count(*) FROM c)) AS gap, lead(x) OVER (ORDER BY x) - x AS dx FROM g) SELECT 'x' AS feature, round((SELECT avg(x) FROM c) - (SELECT avg(x) FROM r), 2) AS mean_shift, round(max(gap), 6) AS ks, round(sum(gap * dx), 2) AS wasserstein FROM k"


@query("l30_drift_report", DRIFT)
def l30(t: Tables) -> DataFrame:
    r = t.orders.filter("o_orderkey % 2 = 0").select(F.col("o_totalprice").alias("x"))
    c = t.orders.filter("o_orderkey % 2 = 1").select((F.col("o_totalprice") * 1.1).alias("x"))
    return L.drift(r, c, ["x"]).select("feature", F.round("mean_shift", 2).alias("mean_shift"), F.round("ks", 6).alias("ks"), F.round("wasserstein", 2).alias("wasserstein"))


def single_sql(x: str) -> str:
    return f"(SELECT s.fold, y, a + b * {x} AS prediction FROM split_ s JOIN (SELECT fold, regr_intercept(y, {x}) AS a, regr_slope(y, {x}) AS b FROM split_ WHERE role = 'train' AND turnover IS NOT NULL AND momentum_1m IS NOT NULL GROUP BY 1) USING (fold) WHERE role = 'test' AND turnover IS NOT NULL AND momentum_1m IS NOT NULL)"


ABLATIONS = {"complete": f"({ridge_sql(0.0, 'test')})", "without_turnover": single_sql("momentum_1m"), "without_momentum": single_sql("turnover")}


@query("l31_feature_ablations", " UNION ALL ".join(measures_sql(v, f"'{k}' AS features") for k, v in ABLATIONS.items()), DATA)
def l31(t: Tables) -> DataFrame:
    out = None
    for name, xs in (("complete", ["momentum_1m", "turnover"]), ("without_turnover", ["momentum_1m"]), ("without_momentum", ["turnover"])):
        m = L.regression_metrics(predictions(t, 0.0, xs), ["fold"], "y", "prediction").select(F.lit(name).alias("features"), "fold", F.round("rmse", 6).alias("rmse"), F.round("spearman", 6).alias("spearman"))
        out = m if out is None else out.unionByName(m)
    return out


@query("l32_regression_metrics", "WITH r AS (SELECT *, rank() OVER (PARTITION BY fold ORDER BY y) + (count(*) OVER (PARTITION BY fold, y) - 1) / 2 AS ry, rank() OVER (PARTITION BY fold ORDER BY prediction) + (count(*) OVER (PARTITION BY fold, prediction) - 1) / 2 AS rp FROM pred_) SELECT fold, count(*) AS n, round(avg(abs(prediction - y)), 6) AS mae, round(sqrt(avg(pow(prediction - y, 2))), 6) AS rmse, round(corr(y, prediction), 6) AS pearson, round(corr(ry, rp), 6) AS spearman FROM r GROUP BY 1", ONE)
def l32(t: Tables) -> DataFrame:
    m = L.regression_metrics(predictions(t, 0.0, ["turnover"]), ["fold"], "y", "prediction")
    return m.select("fold", "n", *(F.round(c, 6).alias(c) for c in ("mae", "rmse", "pearson", "spearman")))


@query("l33_classification_metrics", "WITH r AS (SELECT *, rank() OVER (PARTITION BY grp ORDER BY p) + (count(*) OVER (PARTITION BY grp, p) - 1) / 2 AS rk FROM scored) SELECT grp, count(*) FILTER (y = 1 AND p >= 0.5) AS tp, count(*) FILTER (y = 0 AND p >= 0.5) AS fp, round(avg(pow(p - y, 2)), 6) AS brier, round(-avg(CASE WHEN y = 1 THEN ln(p) ELSE ln(1 - p) END), 6) AS log_loss, round((sum(rk) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / nullif(count(*) FILTER (y = 1) * count(*) FILTER (y = 0), 0), 6) AS roc_auc FROM r GROUP BY 1")
def l33(t: Tables) -> DataFrame:
    m = L.classification_metrics(t.scored, ["grp"], "y", "p")
    return m.select("grp", "tp", "fp", F.round("brier", 6).alias("brier"), F.round("log_loss", 6).alias("log_loss"), F.round("roc_auc", 6).alias("roc_auc"))


register("l34_calibration_error", lambda t: rounded(L.calibration_error(t.scored, ["grp"], "y", "p"), ["grp"], ece=F.col("ece")), "SELECT grp, round(sum(n * abs(m - r)) / sum(n), 6) AS ece FROM (SELECT grp, least(floor(p * 10), 9) AS b, count(*) AS n, avg(p) AS m, avg(y) AS r FROM scored GROUP BY 1, 2) GROUP BY 1")
IC = "WITH r AS (SELECT *, rank() OVER (PARTITION BY date ORDER BY y) + (count(*) OVER (PARTITION BY date, y) - 1) / 2 AS ry, rank() OVER (PARTITION BY date ORDER BY turnover) + (count(*) OVER (PARTITION BY date, turnover) - 1) / 2 AS rp FROM set_), i AS (SELECT date, corr(ry, rp) AS ic FROM r GROUP BY 1)"


@query("l35_ranking_metrics", IC + ", p AS (SELECT y, rp / count(*) OVER (PARTITION BY date) AS pct FROM r) SELECT (SELECT round(avg(ic), 6) FROM i) AS mean_ic, (SELECT round(stddev_samp(ic), 6) FROM i) AS sd_ic, round(avg(y) FILTER (pct >= 0.8) - avg(y) FILTER (pct <= 0.2), 6) AS spread FROM p", DATA)
def l35(t: Tables) -> DataFrame:
    return rounded(L.ranking_metrics(learning_set(t), "date", "y", "turnover"), [], mean_ic=F.col("mean_ic"), sd_ic=F.col("sd_ic"), spread=F.col("spread"))


register("l36_block_bootstrap_ic", lambda t: L.block_bootstrap(L.daily_ic(learning_set(t), "date", "y", "turnover"), "date", 6, 500, 7))
register("l37_prediction_table", lambda t: predictions(t, 0.0, ["turnover"]).select("fold", *K, F.round("y", 6).alias("y"), F.round("prediction", 6).alias("prediction"), F.lit("linear").alias("model")), "SELECT fold, security_id, date, round(y, 6) AS y, round(prediction, 6) AS prediction, 'linear' AS model FROM pred_", ONE)


TOP = """WITH k AS (SELECT fold, security_id, date, row_number() OVER (PARTITION BY fold, date ORDER BY prediction DESC, security_id) AS k, count(*) OVER (PARTITION BY fold, date) AS n FROM pred_),
w AS (SELECT fold, security_id, date, 1 / count(*) OVER (PARTITION BY fold, date) AS weight FROM k WHERE k <= ceil(n * 0.1::DOUBLE)),
b AS (SELECT w.*, next_ret AS ret, sum(weight * next_ret) OVER (PARTITION BY fold, date) AS gross FROM w JOIN next_ USING (security_id, date) WHERE next_ret IS NOT NULL),
d AS (SELECT *, abs(weight - coalesce(lag(weight * (1 + ret) / (1 + gross)) OVER (PARTITION BY fold, security_id ORDER BY date), 0)) AS trade FROM b),
e AS (SELECT fold, date, sum(trade) AS turnover, sum(trade * 14.5 / 1e4) AS cost, max(gross) AS gross FROM d GROUP BY 1, 2)
SELECT fold, round(sum(gross), 6) AS gross, round(sum(gross - cost), 6) AS net, round(sum(turnover), 6) AS turnover FROM e GROUP BY 1"""


@query("l38_economic_check", TOP, ONE)
def l38(t: Tables) -> DataFrame:
    """Top tenth by prediction at each date, held one period, with costs, per fold."""
    nxt = t.panel.select(*K, F.lead("ret").over(Window.partitionBy("security_id").orderBy("date")).alias("ret"), "benchmark_return")
    w = P.ranked_signal_weights(predictions(t, 0.0, ["turnover"]), ["fold", "date"], "prediction", 0.1, "security_id")
    book = w.select("fold", *K, "weight").join(nxt.filter("ret IS NOT NULL"), K).withColumnRenamed("security_id", "asset_id")
    return P.backtest(book, ["fold"], "benchmark_return", P.trade_costs(10, 5, 2)).groupBy("fold").agg(*(F.round(F.sum(c), 6).alias(c) for c in ("gross", "net", "turnover")))


@query("l39_challenger_comparison", "SELECT fold, 'train_mean' AS model, round(sqrt(avg(pow(y - m, 2))), 6) AS rmse FROM pred_ JOIN (SELECT fold, avg(y) AS m FROM split_ WHERE role = 'train' AND turnover IS NOT NULL AND momentum_1m IS NOT NULL GROUP BY 1) USING (fold) GROUP BY 1 UNION ALL SELECT fold, 'linear', round(sqrt(avg(pow(y - prediction, 2))), 6) FROM pred_ GROUP BY 1", ONE)
def l39(t: Tables) -> DataFrame:
    p = predictions(t, 0.0, ["turnover"]).select("fold", "y", "prediction")
    known = split(t).filter("role = 'train' AND turnover IS NOT NULL AND momentum_1m IS NOT NULL")
    base = p.drop("prediction").join(F.broadcast(known.groupBy("fold").agg(F.avg("y").alias("prediction"))), "fold")
    both = p.withColumn("model", F.lit("linear")).unionByName(base.withColumn("model", F.lit("train_mean")))
    return both.groupBy("fold", "model").agg(F.round(F.sqrt(F.avg(F.pow(F.col("y") - F.col("prediction"), 2))), 6).alias("rmse"))


register("l40_retrain_cadence", lambda t: folds(t).select("fold", (F.floor(F.col("fold") / 3) * 3).cast("long").alias("fit_fold")).distinct(), "SELECT fold, fold // 3 * 3 AS fit_fold FROM fold_", DATA)
register("l41_build_dataset", lambda t: learning_set(t).select(*K, F.round("y", 6).alias("y"), "label_end"), "SELECT security_id, date, round(y, 6) AS y, label_end FROM set_", DATA)
register("l42_explanation_disagreement", lambda t: predictions(t).groupBy("fold").agg(F.first("beta").alias("b"), F.stddev_samp("momentum_1m").alias("s1"), F.stddev_samp("turnover").alias("s2")).select("fold", (F.abs(F.get("b", F.lit(1))) > F.abs(F.get("b", F.lit(2)))).alias("raw_top"), (F.abs(F.get("b", F.lit(1)) * F.col("s1")) > F.abs(F.get("b", F.lit(2)) * F.col("s2"))).alias("scaled_top")).withColumn("disagree", F.col("raw_top") != F.col("scaled_top")), f"SELECT fold, abs(b1) > abs(b2) AS raw_top, abs(b1 * s1) > abs(b2 * s2) AS scaled_top, (abs(b1) > abs(b2)) <> (abs(b1 * s1) > abs(b2 * s2)) AS disagree FROM (SELECT fold, max(b1) AS b1, max(b2) AS b2, stddev_samp(momentum_1m) AS s1, stddev_samp(turnover) AS s2 FROM ({ridge_sql(0.0, 'test')}) GROUP BY 1)", DATA)
register("l43_overlap_of_test_targets", lambda t: L.overlap_of_tests(split(t), "fold", "date", "label_end"), "SELECT fold, first_start, last_end, coalesce(lead(first_start) OVER (ORDER BY fold) <= last_end, false) AS overlaps_next FROM (SELECT fold, min(date) AS first_start, max(label_end) AS last_end FROM split_ WHERE role = 'test' GROUP BY 1)", DATA)
