"""Graphs, gaps, folds, permutations and saved pipelines against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from pitwell.operators import joins as J
from pitwell.operators import learning as L
from pitwell.operators import lineage as M
from pitwell.operators import regress as R
from pitwell.operators import windows as W


def reached(edges, start):
    seen, todo = set(), [b for a, b in edges if a == start]
    while todo:
        x = todo.pop()
        if x not in seen:
            seen.add(x)
            todo += [b for a, b in edges if a == x]
    return seen


@pytest.mark.parametrize("seed", range(3))
def test_cycles_and_ancestors(spark, seed):
    r = random.Random(seed)
    # Random graphs side by side: sparse ones, chains, rings, rings with tails, two rings joined by a path, self edges.
    edges = {(r.randrange(12), r.randrange(12)) for _ in range(11 + 3 * seed)}
    edges |= {(100 + i, 101 + i) for i in range(9)} | {(200 + i, 200 + (i + 1) % 5) for i in range(5)} | {(300 + i, 301 + i) for i in range(6)} | {(303, 301)}
    edges |= {(401, 402), (402, 401), (402, 403), (403, 404), (404, 405), (405, 404), (500, 500), (500, 501)}
    df = spark.createDataFrame(sorted(edges), "a long, b long")
    nodes = {x for e in edges for x in e}
    assert {x.node for x in M.cyclic_nodes(df, "a", "b").collect()} == {x for x in nodes if x in reached(edges, x)}
    pairs = df.select(F.col("a").alias("child"), F.col("b").alias("parent"))
    asked = [0, 1, 100, 200, 401, 500, 999]
    got = {(x.artifact, x.ancestor) for x in M.ancestors(pairs, spark.createDataFrame([(x,) for x in [*asked, 0]], "artifact long")).collect()}
    assert got == {(x, y) for x in asked for y in reached(edges, x)}


def test_long_chain(spark):
    """100,000 nodes in a row with a ring at the end: joins of the chain's length, never its square."""
    n = 100_000
    edges = spark.range(n).select(F.col("id").alias("child"), (F.col("id") + 1).alias("parent")).union(spark.createDataFrame([(n, n - 2)], "child long, parent long"))
    assert {x.node for x in M.cyclic_nodes(edges, "child", "parent").collect()} == {n - 2, n - 1, n}
    got = M.ancestors(edges, spark.createDataFrame([(5,), (n - 10,)], "artifact long")).groupBy("artifact").count().collect()
    assert {x.artifact: x["count"] for x in got} == {5: n - 5, n - 10: 10}


def test_missing_sessions(spark):
    rows = [("a", 1), ("a", 2), ("b", 4), ("c", 1), ("c", 5), ("c", 5), ("d", 3)]
    days = "date '2020-01-01' + d"
    df = spark.createDataFrame(rows, "k string, d int").select("k", F.expr(days).alias("date"))
    got = sorted((x.k, x.date.day - 1) for x in W.missing_sessions(df, "k").collect())
    assert got == [("a", 3), ("a", 4), ("a", 5), ("b", 1), ("b", 2), ("b", 3), ("b", 5), ("c", 2), ("c", 3), ("c", 4), ("d", 1), ("d", 2), ("d", 4), ("d", 5)]
    assert W.missing_sessions(df.limit(0), "k").count() == 0


def test_overlap(spark):
    members = spark.createDataFrame([("p", 1, 3.0), ("p", 2, 1.0), ("q", 4, 1.0)], "book string, security_id long, weight double")
    legs = spark.createDataFrame([("x", 1), ("x", 1), ("x", 9), ("y", 2), ("z", 7)], "factor_id string, security_id long")
    got = {(x.book, x.signal): (x.count_share, x.weight_share) for x in J.constituent_overlap(members, legs, ["book"]).collect()}
    assert got == {("p", "x"): (0.5, 0.75), ("p", "y"): (0.5, 0.25), ("p", "z"): (0, 0), ("q", "x"): (0, 0), ("q", "y"): (0, 0), ("q", "z"): (0, 0)}


def test_folds_meet_rows_by_days(spark):
    df = spark.range(40).select(F.expr("date '2020-01-01' + cast(id div 2 as int)").alias("date"), F.when(F.col("id") == 7, None).otherwise(F.expr("date '2020-01-01' + cast(id div 2 as int) + 2")).alias("label_end"))
    folds = L.temporal_folds(df, "date", 6, 3, 3, embargo=1, step=2, mode="rolling")
    out = L.assign_and_purge(df, folds, "date", "label_end")
    n = folds.select("fold").distinct().count()
    assert n == 4 and out.count() == 40 * n and out.filter("fold = 1").groupBy("date").count().count() == 20
    role = {(x.fold, x.date.day - 1, x.label_end is None): x.role for x in out.collect()}
    assert [role[0, d, False] for d in (0, 5, 6, 7, 9, 10, 11, 13, 14)] == ["train", "purged", "unused", "validation", "purged", "unused", "test", "test", "unused"] and role[1, 1, False] == "unused"
    assert role[0, 3, True] == "train"
    assert "CartesianProduct" not in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("cell_rows", [10_000, 7])
def test_permutations_are_whole(spark, cell_rows):
    """Numbers are the same however many cells there are, and values come from anywhere in the key."""
    df = spark.range(400).select((F.col("id") % 2).alias("fold"), "id", F.col("id").cast("double").alias("x"))
    got = L.numbered(df, ["fold"], F.md5(F.col("id").cast("string")), "k", cell_rows).collect()
    import hashlib

    for fold in (0, 1):
        want = sorted(range(fold, 400, 2), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
        assert [x.id for x in sorted((x for x in got if x.fold == fold), key=lambda x: x.k)] == want and sorted(x.k for x in got if x.fold == fold) == list(range(1, 201))
    seen = []
    predict = lambda d: (seen.append(d), d.withColumn("prediction", F.col("x")))[1]
    out = L.permutation_importance(df.withColumn("y", F.col("x")), ["fold"], ["id"], ["x"], "y", predict, repeats=2, cell_rows=cell_rows).collect()
    assert len(out) == 2 and all(1.2 < x.importance < 2.8 for x in out)
    dealt = seen[1].filter("repeat = 1").collect()
    assert sorted(x.x for x in dealt) == list(map(float, range(400))) and sum(x.x == x.id for x in dealt) < 20
    # Cells of the own order are far apart in the values' origins.
    assert len({(int(x.id) // 40, int(x.x) // 40) for x in dealt}) > 60


def test_saved_pipeline(spark, tmp_path):
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    from pitwell.operators.estimators import RankScaler, TrainingScaler

    r = random.Random(1)
    df = spark.createDataFrame([(i // 20, r.gauss(0, 1) if i % 9 else None, r.gauss(5, 2), 7.0, r.gauss(0, 1)) for i in range(200)], "date int, a double, b double, c double, y double")
    stages = [TrainingScaler(inputCols=["a", "c"], scale="robust"), RankScaler(inputCols=["b"]), VectorAssembler(inputCols=["a", "b", "c"], outputCol="x"), LinearRegression(featuresCol="x", labelCol="y")]
    model = Pipeline(stages=stages).fit(df)
    model.write().save(f"file://{tmp_path}/p")
    Pipeline(stages=stages).write().save(f"file://{tmp_path}/q")
    again, refit = PipelineModel.load(f"file://{tmp_path}/p"), Pipeline.load(f"file://{tmp_path}/q").fit(df)
    scores = [[x.prediction for x in m.transform(df).orderBy("date", "y").collect()] for m in (model, again, refit)]
    assert scores[0] == scores[1] and scores[0] == pytest.approx(scores[2])
    out = again.stages[0].transform(df)
    known = sorted(x.a for x in df.collect() if x.a is not None)
    median = (known[len(known) // 2 - 1] + known[len(known) // 2]) / 2 if len(known) % 2 == 0 else known[len(known) // 2]
    assert all(x.c == 0 for x in out.collect()) and out.filter("a IS NULL").count() == 0 and abs(out.agg(F.median("a")).first()[0]) < 1e-9 and abs(median) < 1


def test_own_models():
    assert set(R.registered({"MINE": ("market", "size")}, ["market", "size"])) == {*R.MODELS, "MINE"}
    for bad in ({"CAPM": ("market",)}, {"X": ()}, {"X": ("market", "market")}, {"X": ("other",)}):
        with pytest.raises(ValueError):
            R.registered(bad, ["market", "size"])


def test_block_pairs(spark):
    """Blocks of a few series give the rows of the plain join, without a row a pair and time: also gaps, repeated times, short and nearly flat series."""
    import math

    import numpy as np

    from pitwell.operators.joins import block_pairs, pairwise

    r = np.random.default_rng(3)
    rows = [(f"s{k:02d}", int(d), float(v)) for k in range(23) for d, v in enumerate(r.normal(size=30)) if r.random() < 0.7]
    rows += [("near", d, 5.0 + 1e-9 * d) for d in range(30)] + [("twice", d % 9, float(d)) for d in range(14)] + [("late", 99, 1.0), ("pair", 3, 1.0), ("pair", 4, 2.0), ("none", 3, None), (None, 3, 1.0)] + [("nan", 0, math.nan), ("nan", 1, 2.0), ("nan", 2, 3.0)]
    df = spark.createDataFrame(rows, "key string, at int, x double")
    want = {(x.a, x.b): x for x in pairwise(df, "key", "at", "x").collect()}
    for size in (4, 500):
        pairs = block_pairs(df, "key", "at", "x", block_series=size)
        got = {(x.a, x.b): x for x in pairs.collect()}
        assert got.keys() == want.keys() and len(got) == pairs.count()
        for k, x in want.items():
            assert x.n == got[k].n and (got[k].max_diff == x.max_diff or math.isnan(x.max_diff) and math.isnan(got[k].max_diff))
            assert abs(got[k].corr - x.corr) < 1e-6 or math.isnan(x.corr) and math.isnan(got[k].corr)
    flat = spark.createDataFrame([(k, d, float(d * (k == "b"))) for k in "ab" for d in range(3)], "key string, at int, x double")
    assert [tuple(x) for x in block_pairs(flat, "key", "at", "x").collect()] == [("a", "b", 3, 2.0, None)]


def test_equal_series(spark):
    """Copies of a series give all pairs of keys, in batches, and rows of equal values leave side by side."""
    import numpy as np
    import pyarrow as pa

    from pitwell.operators import joins
    from pitwell.operators.joins import block_pairs, pairwise

    r = np.random.default_rng(7)
    base = [(k, d, float(v)) for k in range(4) for d, v in enumerate(r.normal(size=20)) if d % 7 != k]
    df = spark.createDataFrame(base, "key long, at int, x double")
    want = {(x.a, x.b): (x.n, x.max_diff, x.corr) for x in pairwise(df, "key", "at", "x").collect()} | {(k, k): (sum(y[0] == k for y in base), 0.0, 1.0) for k in range(4)}
    # More copies than one row of equal series holds, and keys of copies far apart.
    copies = joins.EQUAL_SERIES + 44
    out = block_pairs(df.crossJoin(spark.range(copies)).withColumn("key", F.col("id") * 4 + F.col("key")), "key", "at", "x", block_series=100).toArrow()
    a, b, n, far, corr = (out[c].to_numpy() for c in ("a", "b", "n", "max_diff", "corr"))
    series = 4 * copies
    assert len(a) == series * (series - 1) // 2 == len(np.unique(a * series + b)) and (a < b).all() and b.max() < series
    lo, hi = np.minimum(a % 4, b % 4), np.maximum(a % 4, b % 4)
    for (i, j), x in want.items():
        at = (lo == i) & (hi == j)
        assert at.any() and (n[at] == x[0]).all() and (far[at] == x[1]).all() and np.abs(corr[at] - x[2]).max() < 1e-9
    assert ((lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])).sum() < 100
    one = pa.table({"p": [0, 0], "q": [0, 0], "second": [False, False], "ks": [list(range(0, 1400, 2)), list(range(1, 1400, 2))], "t": [[1, 2, 3]] * 2, "x": [[1.0, 2.0, 4.0], [3.0, 2.0, 5.0]]})
    sizes = [x.num_rows for x in joins._two_blocks(one, 2, True)]
    assert sum(sizes) == 1400 * 1399 // 2 and max(sizes) <= joins.BATCH_ROWS


def test_boosted_cells(spark):
    """Boosted trees on weighted cells predict what those on the binned rows predict; a fit on cells reads few rows."""
    import numpy as np
    from pyspark.ml.regression import GBTRegressor

    r = np.random.default_rng(5)
    x = r.normal(size=(3000, 2))
    rows = [(float(a), float(b), float(a * b + (a > 0.3) + 0.1 * e)) for (a, b), e in zip(x, r.normal(size=3000))] + [(0.0, 0.0, 1.0)] * 50
    df = spark.createDataFrame(rows, "a double, b double, label double")
    cells, binned = L.binned_cells(df, ["a", "b"], "label", 16)
    assert cells.count() <= 256 and cells.agg(F.sum("weight")).first()[0] == 3050
    make = lambda: GBTRegressor(maxIter=8, maxDepth=3, stepSize=0.3, seed=1)
    p = [m.transform(binned(df)).select("a", "b", "prediction").orderBy("a", "b").toPandas()["prediction"].to_numpy() for m in (make().setWeightCol("weight").fit(cells), make().fit(binned(df)))]
    assert np.abs(p[0] - p[1]).max() < 1e-9 and p[0].std() > 0.5


def test_refits_read_spreads_once(spark):
    """Both fits of the self-exclusion query start from one written table."""
    import __spark_entry__ as entry

    plan = entry.queries()["i28_self_exclusion_refit"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "l_suppkey" not in plan
