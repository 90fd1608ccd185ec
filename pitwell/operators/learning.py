"""Point-in-time learning sets, purged folds, preprocessing, models and metrics (L)."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitwell.functions.scalar import ratio
from pitwell.operators import regress as R
from pitwell.operators import windows as W
from pitwell.operators.joins import interval_join


def assemble(scores: DataFrame, factors: list[str], least_coverage: float, value: str = "raw", banned: tuple[str, ...] = ("target", "future", "label")) -> DataFrame:
    """One row per security and date with factors as columns and their coverage; target-like names are refused."""
    if bad := [f for f in factors if any(b in f for b in banned)]:
        raise ValueError(f"target-like features: {bad}")
    wide = scores.groupBy("security_id", "date").pivot("factor_id", factors).agg(F.first(value))
    have = sum((F.col(f).isNotNull().cast("int") for f in factors), F.lit(0))
    return wide.withColumn("coverage", have / len(factors)).filter(F.col("coverage") >= least_coverage)


def interactions(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    return df.withColumns({f"{a}__x__{b}": F.col(a) * F.col(b) for a, b in pairs})


def forward_target(df: DataFrame, kind: str, h: int, keys: list[str], order: str, r: str, benchmark: str, session: str, ann: float, level: float = 0.05, threshold: float = 0.0) -> Column:
    """Target over the next h rows; NULL unless the h-th is the h-th next common session and none is missing."""
    w, at = W.next_rows(keys, [order], h), Window.partitionBy(*keys).orderBy(order)
    x, b = F.col(r), F.col(benchmark)
    whole = (F.lead(session, h).over(at) == F.col(session) + h) & (F.count(x).over(w) == h)
    gain = F.product(1 + x).over(w) - 1
    excess = gain - (F.product(1 + b).over(w) - 1)
    path = F.collect_list(x).over(w)
    start = F.struct(F.lit(1.0).alias("wealth"), F.lit(1.0).alias("peak"), F.lit(None).cast("double").alias("low"))

    def step(s: Column, v: Column) -> Column:
        wealth = s["wealth"] * (1 + v)
        return F.struct(wealth.alias("wealth"), F.greatest(s["peak"], wealth).alias("peak"), F.least(s["low"], wealth / s["peak"] - 1).alias("low"))

    value = {
        "return": gain,
        "excess_return": excess,
        "outperformance": (excess > threshold).cast("double"),
        "volatility": F.stddev_samp(x).over(w) * ann**0.5,
        "downside_volatility": F.sqrt(F.avg(F.pow(F.least(x, F.lit(0.0)), 2)).over(w)) * ann**0.5,
        "drawdown": F.aggregate(path, start, step, lambda s: s["low"]),
        "risk_quantile": F.greatest(F.lit(0.0), -F.percentile(x, level).over(w)),
    }[kind]
    return F.when(whole, value)


def temporal_folds(df: DataFrame, date: str, train: int, validation: int, test: int, embargo: int = 0, step: int | None = None, mode: str = "expanding") -> DataFrame:
    """(fold, role, first, last) in distinct dates. The dates' count is one small number; folds are a sequence over it."""
    n = df.select(F.count_distinct(date).alias("n"))
    span = train + validation + test + 2 * embargo
    step = step or test
    last = F.col("n") - span
    starts = n.select("n", F.posexplode(F.when(last >= 0, F.sequence(F.lit(0), F.floor((F.lit(0) if mode == "holdout" else last) / step).cast("int"))).otherwise(F.array().cast("array<int>"))).alias("fold", "k"))
    shift = F.col("k") * step
    first = shift if mode == "rolling" else F.lit(0)
    t_end, v_start = shift + train, shift + train + embargo
    v_end, s_start = v_start + validation, v_start + validation + embargo
    parts = F.array(*(F.struct(F.lit(role).alias("role"), a.cast("long").alias("first"), (b - 1).cast("long").alias("last")) for role, a, b in (("train", first, t_end), ("validation", v_start, v_end), ("test", s_start, s_start + test))))
    return starts.select(F.col("fold").cast("long").alias("fold"), F.explode(parts).alias("p")).select("fold", "p.*")


def fold_spans(folds: DataFrame, index: DataFrame, date: str) -> DataFrame:
    """fold, role, start, end, limit: day ranges that tile the calendar of each fold, 'unused' ones included.

    index: date, session (from 0). limit: the date from which on a label ends too late for the role.
    """
    wide = folds.groupBy("fold").pivot("role", ["train", "validation", "test"]).agg(F.first(F.struct("first", "last")))
    wide = wide.crossJoin(F.broadcast(index.agg(F.max("session").alias("end_"))))
    part = lambda role, a, b, limit=None: F.struct(F.lit(role).alias("role"), a.cast("long").alias("a_"), b.cast("long").alias("b_"), (limit if limit is not None else F.lit(None)).cast("long").alias("c_"))
    t, v, s = (lambda e, r=r: F.col(f"{r}.{e}") for r in ("train", "validation", "test"))
    tiles = F.array(
        part("unused", F.lit(0), t("first") - 1), part("train", t("first"), t("last"), v("first")), part("unused", t("last") + 1, v("first") - 1), part("validation", v("first"), v("last"), s("first")),
        part("unused", v("last") + 1, s("first") - 1), part("test", s("first"), s("last")), part("unused", s("last") + 1, F.col("end_")))
    spans = wide.select("fold", F.explode(tiles).alias("p")).select("fold", "p.*").filter("a_ <= b_")
    for number, name in (("a_", "start_"), ("b_", "stop_"), ("c_", "limit_")):
        spans = spans.join(index.select(F.col("session").alias(number), F.col(date).alias(name)), number, "left")
    return spans.select("fold", "role", "start_", "stop_", "limit_")


def assign_and_purge(df: DataFrame, folds: DataFrame, date: str, label_end: str) -> DataFrame:
    """Every row once per fold with its role: train, validation, test, purged or unused. df's label_end is a date.

    Rows are collapsed to their dates, the dates meet the folds' day ranges in day buckets, and rows take the roles of
    their dates; there is no join without a key.
    """
    index = W.session_positions(df, date).withColumn("session", F.col("session") - 1)
    spans = fold_spans(folds, index, date)
    days = df.select(F.col(date).alias("d_"), F.col(label_end).alias("e_")).distinct()
    placed = interval_join(days, spans, [], "d_", "start_", "stop_")
    role = F.when(F.col("e_") >= F.col("limit_"), "purged").otherwise(F.col("role"))
    placed = placed.select("d_", "e_", "fold", role.alias("role"))
    return df.join(placed, (F.col(date) == F.col("d_")) & F.col(label_end).eqNullSafe(F.col("e_"))).drop("d_", "e_")


def train_statistics(df: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """Per fold, over train rows only: median, mean, population sd, quartiles and 1 % / 99 % of every feature."""
    t = df.filter("role = 'train'")
    aggs = []
    for f in features:
        q = F.percentile(f, F.array(*map(F.lit, (0.01, 0.25, 0.5, 0.75, 0.99))))
        aggs += [F.avg(f).alias(f"{f}_mean"), F.stddev_pop(f).alias(f"{f}_sd"), q.alias(f"{f}_q")]
    return t.groupBy(*keys).agg(*aggs)


def preprocess(df: DataFrame, keys: list[str], features: list[str], impute: bool = True, clip: bool = True, scale: str = "standard") -> DataFrame:
    """Imputes train medians, clips to train bounds and scales by train statistics. One small row a fold is joined."""
    out = df.join(F.broadcast(train_statistics(df, keys, features)), keys)
    for f in features:
        q = lambda i: F.get(f"{f}_q", F.lit(i))  # noqa: B023, E731
        x = F.coalesce(F.col(f), q(2)) if impute else F.col(f)
        if clip:
            x = F.when(x.isNotNull(), F.greatest(q(0), F.least(q(4), x)))
        if scale == "standard":
            x = F.when(F.col(f"{f}_sd") > 0, (x - F.col(f"{f}_mean")) / F.col(f"{f}_sd")).otherwise(F.lit(0.0))
        elif scale == "robust":
            x = F.when(q(3) > q(1), (x - q(2)) / (q(3) - q(1))).otherwise(F.lit(0.0))
        out = out.withColumn(f, x)
    return out.drop(*(f"{f}_{s}" for f in features for s in ("mean", "sd", "q")))


def cross_sectional_median(df: DataFrame, features: list[str], date: str = "date") -> DataFrame:
    w = Window.partitionBy(date)
    return df.withColumns({f: F.coalesce(F.col(f), F.median(f).over(w)) for f in features})


def linear_model(df: DataFrame, fold: str, features: list[str], target: str, l2: float = 0.0) -> DataFrame:
    """Least squares (ridge with l2) per fold from the moments of train rows; predictions for test rows. The constant isn't shrunk."""
    import numpy as np
    import pandas as pd

    k = len(features) + 1
    m = R.moments(df.filter("role = 'train'"), [fold], target, features)

    def solve(frames):
        for f in frames:
            out = []
            for r in f.to_dict("records"):
                a = np.array(r["xtx"]).reshape(k, k) + np.diag([0.0] + [l2] * (k - 1))
                out.append((r[fold], np.linalg.lstsq(a, np.array(r["xty"]), rcond=1e-12)[0].tolist()))
            yield pd.DataFrame(out, columns=[fold, "beta"])

    beta = m.mapInPandas(solve, f"{R.key_schema(df, [fold])}beta array<double>")
    rows = df.filter("role = 'test'").join(F.broadcast(beta), fold)
    d = R.design(features)
    return rows.withColumn("prediction", sum((F.get("beta", F.lit(i)) * d[i] for i in range(k)), F.lit(0.0)))


def binned_cells(train: DataFrame, features: list[str], label: str, bins: int = 32) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """Train rows as cells of binned features (features, label: the mean, weight: the count), and the binning of other rows.

    Trees split binned features by sums of weights and labels, and the squares within a cell are in every split's loss alike,
    so least-squares trees fitted on the weighted cells are those of the rows. Bins come from quantiles of all train rows;
    what passes the driver is `bins` edges a feature, what a model reads at most bins^features rows.
    """
    from pyspark.ml.feature import Bucketizer, VectorAssembler

    shares = F.array(*(F.lit(i / bins) for i in range(1, bins)))
    edges = train.agg(*(F.percentile_approx(f, shares, 10000).alias(f) for f in features)).first()
    splits = [[-math.inf, *(sorted({x for x in edges[f] or () if math.isfinite(x)}) or [0.0]), math.inf] for f in features]
    names = [f"{f}_bin" for f in features]
    cut = Bucketizer(splitsArray=splits, inputCols=features, outputCols=names)
    whole = VectorAssembler(inputCols=names, outputCol="features")
    cells = cut.transform(train).groupBy(*names).agg(F.avg(label).alias("label"), F.count("*").cast("double").alias("weight"))
    return whole.transform(cells).coalesce(1), lambda df: whole.transform(cut.transform(df.drop("features"))).drop(*names)


def regression_metrics(df: DataFrame, keys: list[str], y: str, p: str) -> DataFrame:
    e = F.col(p) - F.col(y)
    r = df.withColumn("ry_", W.average_rank(y, keys)).withColumn("rp_", W.average_rank(p, keys))
    varies = (F.max(y) > F.min(y)) & (F.max(p) > F.min(p))
    return r.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.median(F.abs(e)).alias("median_ae"), ratio(-F.sum(e * e), F.var_pop(y) * F.count("*")).alias("r2_"),
        F.when(varies, F.corr(y, p)).alias("pearson"), F.when(varies, F.corr("ry_", "rp_")).alias("spearman"), F.avg((F.signum(y) == F.signum(p)).cast("double")).alias("directional"), F.avg(e).alias("bias"), F.stddev_samp(e).alias("residual_sd"),
    ).withColumn("r2", 1 + F.col("r2_")).drop("r2_")


def roc_auc(df: DataFrame, keys: list[str], y: str, p: str) -> DataFrame:
    """By the rank sum, ties at their average rank."""
    r = df.withColumn("r_", W.average_rank(p, keys))
    n1 = F.count_if(F.col(y) == 1)
    n0 = F.count_if(F.col(y) == 0)
    return r.groupBy(*keys).agg(F.try_divide(F.sum(F.when(F.col(y) == 1, F.col("r_"))) - n1 * (n1 + 1) / 2, n1 * n0).alias("roc_auc"))


def average_precision(df: DataFrame, keys: list[str], y: str, p: str) -> DataFrame:
    """Precision at each distinct score times the recall it adds. Scores are grouped before the window runs."""
    g = df.groupBy(*keys, p).agg(F.sum(y).alias("pos"), F.count("*").alias("n"))
    w = Window.partitionBy(*keys).orderBy(F.col(p).desc()).rowsBetween(Window.unboundedPreceding, 0)
    g = g.withColumn("precision", F.sum("pos").over(w) / F.sum("n").over(w))
    return g.groupBy(*keys).agg(F.try_divide(F.sum(F.col("precision") * F.col("pos")), F.sum("pos")).alias("average_precision"))


def calibration_bins(df: DataFrame, keys: list[str], y: str, p: str, bins: int = 10) -> DataFrame:
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("long")
    return df.withColumn("bin", b).groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(y).alias("rate"))


def calibration_error(df: DataFrame, keys: list[str], y: str, p: str, bins: int = 10) -> DataFrame:
    b = calibration_bins(df, keys, y, p, bins)
    return b.groupBy(*keys).agg((F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("rate"))) / F.sum("n")).alias("ece"))


def classification_metrics(df: DataFrame, keys: list[str], y: str, p: str, cut: float = 0.5) -> DataFrame:
    t, h = F.col(y) == 1, F.col(p) >= cut
    c = {"tp": F.count_if(t & h), "fp": F.count_if(~t & h), "fn": F.count_if(t & ~h), "tn": F.count_if(~t & ~h)}
    q = F.least(F.greatest(F.col(p), F.lit(1e-15)), F.lit(1 - 1e-15))
    loss = -F.avg(F.when(t, F.log(q)).otherwise(F.log(1 - q)))
    m = df.groupBy(*keys).agg(*(v.alias(k) for k, v in c.items()), loss.alias("log_loss"), F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("brier"))
    tp, fp, fn, tn = (F.col(k) for k in c)
    recall, precision, special = F.try_divide(tp, tp + fn), F.try_divide(tp, tp + fp), F.try_divide(tn, tn + fp)
    m = m.withColumns({"accuracy": (tp + tn) / (tp + fp + fn + tn), "precision": precision, "recall": recall, "balanced_accuracy": (recall + special) / 2, "f1": F.try_divide(2 * tp, 2 * tp + fp + fn)})
    return m.join(roc_auc(df, keys, y, p), keys).join(average_precision(df, keys, y, p), keys).join(calibration_error(df, keys, y, p), keys)


def daily_ic(df: DataFrame, date: str, y: str, p: str) -> DataFrame:
    r = df.withColumn("ry_", W.average_rank(y, [date])).withColumn("rp_", W.average_rank(p, [date]))
    varies = (F.max(y) > F.min(y)) & (F.max(p) > F.min(p))
    return r.groupBy(date).agg(F.when(varies, F.corr("ry_", "rp_")).alias("ic"))


def ranking_metrics(df: DataFrame, date: str, y: str, p: str, share: float = 0.2) -> DataFrame:
    """Mean and sd of per-date Spearman; top less bottom share, pooled over dates."""
    ic = daily_ic(df, date, y, p).agg(F.avg("ic").alias("mean_ic"), F.stddev_samp("ic").alias("sd_ic"))
    k = df.withColumn("pct_", W.percentile_rank(p, [date]))
    spread = k.agg((F.avg(F.when(F.col("pct_") >= 1 - share, F.col(y))) - F.avg(F.when(F.col("pct_") <= share, F.col(y)))).alias("spread"))
    return ic.crossJoin(F.broadcast(spread))


def block_bootstrap(ic: DataFrame, date: str, block: int, resamples: int, seed: int) -> DataFrame:
    """Moving blocks of per-date values: mean observed, 2.5 % and 97.5 % of resampled means. resamples x dates rows, spread over tasks."""
    known = ic.filter("ic IS NOT NULL")
    rows = known.select("ic", (F.row_number().over(Window.orderBy(date)) - 1).alias("k")).withColumn("n", F.count("*").over(Window.partitionBy(F.lit(1))))
    size = rows.agg(F.max("n").alias("n"))
    draws = ic.sparkSession.range(resamples).withColumnRenamed("id", "b").join(F.broadcast(size))
    blocks = F.ceil(F.col("n") / block).cast("int")
    draws = draws.withColumn("j", F.explode(F.sequence(F.lit(0), blocks - 1)))
    start = F.pmod(F.xxhash64(F.lit(seed), "b", "j"), F.greatest(F.lit(1), F.col("n") - block + 1))
    picks = draws.withColumn("s", start).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(block - 1)))).filter(F.col("j") * block + F.col("i") < F.col("n"))
    means = picks.withColumn("k", F.least(F.col("s") + F.col("i"), F.col("n") - 1)).join(F.broadcast(rows.select("k", "ic")), "k").groupBy("b").agg(F.avg("ic").alias("m"))
    return means.agg(F.percentile("m", 0.025).alias("lower"), F.percentile("m", 0.975).alias("upper")).crossJoin(F.broadcast(known.agg(F.avg("ic").alias("estimate"))))


def drift(reference: DataFrame, current: DataFrame, features: list[str], bins: int = 10) -> DataFrame:
    """Per feature: mean and variance shift, missing shares, PSI over reference quantile bins, KS and Wasserstein-1.

    Values outside the reference edges count in the denominator only; proportions are floored at 1e-6.
    """
    long = lambda d, w: d.select(F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features))).alias("s")).select("s.*", F.lit(w).alias("w"))
    both = long(reference, 0).unionByName(long(current, 1))
    mine = lambda w, c: F.when(F.col("w") == w, c)
    base = both.groupBy("feature").agg(
        (F.avg(mine(1, F.col("x"))) - F.avg(mine(0, F.col("x")))).alias("mean_shift"), (F.var_pop(mine(1, F.col("x"))) - F.var_pop(mine(0, F.col("x")))).alias("variance_shift"),
        F.avg(mine(0, F.col("x").isNull().cast("double"))).alias("missing_reference"), F.avg(mine(1, F.col("x").isNull().cast("double"))).alias("missing_current"))
    edges = both.filter("w = 0 AND x IS NOT NULL").groupBy("feature").agg(F.array_sort(F.array_distinct(F.percentile("x", F.array(*(F.lit(i / bins) for i in range(bins + 1)))))).alias("edges"))
    known = both.filter("x IS NOT NULL").join(F.broadcast(edges), "feature")
    top = F.size("edges") - 1
    at = F.size(F.filter("edges", lambda e: e <= F.col("x")))
    bin_ = F.when(F.col("x") == F.element_at("edges", -1), top).when((at >= 1) & (at <= top), at)
    counts = known.withColumn("bin", bin_).groupBy("feature", "bin").agg(F.count(mine(0, F.lit(1))).alias("a"), F.count(mine(1, F.lit(1))).alias("b"))
    total = Window.partitionBy("feature")
    pa, pb = (F.greatest(F.col(c) / F.sum(c).over(total), F.lit(1e-6)) for c in ("a", "b"))
    psi = counts.withColumn("t", (pb - pa) * F.log(pb / pa)).filter("bin IS NOT NULL").groupBy("feature").agg(F.sum("t").alias("psi"))
    steps = known.groupBy("feature", "x").agg(F.count(mine(0, F.lit(1))).alias("a"), F.count(mine(1, F.lit(1))).alias("b"))
    run = Window.partitionBy("feature").orderBy("x")
    gap = F.abs(F.sum("a").over(run) / F.sum("a").over(total) - F.sum("b").over(run) / F.sum("b").over(total))
    cdf = steps.withColumn("gap", gap).withColumn("dx", F.lead("x").over(run) - F.col("x")).groupBy("feature").agg(F.max("gap").alias("ks"), F.sum(F.col("gap") * F.col("dx")).alias("wasserstein"))
    return base.join(psi, "feature").join(cdf, "feature")


#: Rows that `numbered` sorts in one task, about.
CELL_ROWS = 10_000


def numbered(df: DataFrame, keys: list[str], order: Column, name: str, cell_rows: int = CELL_ROWS) -> DataFrame:
    """df with the number of each row (from 1) within its keys, in the order of a hexadecimal digest.

    Ranges of digests are counted, the counts are summed up to offsets, and only rows of one range are sorted together:
    no task holds a whole key.
    """
    rows = df.withColumn("digest_", order)
    sizes = df.groupBy(*keys).agg(F.greatest(F.lit(1), F.floor(F.count("*") / cell_rows)).alias("cells_"))
    share = F.conv(F.substring("digest_", 1, 8), 16, 10).cast("long")
    rows = rows.join(sizes, keys).withColumn("cell_", F.floor(share * F.col("cells_") / (1 << 32))).drop("cells_")
    ahead = Window.partitionBy(*keys).orderBy("cell_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(*keys, "cell_").agg(F.count("*").alias("held_")).select(*keys, "cell_", F.coalesce(F.sum("held_").over(ahead), F.lit(0)).alias("ahead_"))
    place = F.row_number().over(Window.partitionBy(*keys, "cell_").orderBy("digest_"))
    return rows.withColumn("place_", place).join(offsets, [*keys, "cell_"]).withColumn(name, F.col("ahead_") + F.col("place_")).drop("digest_", "cell_", "place_", "ahead_")


def permutation_importance(df: DataFrame, keys: list[str], ids: list[str], features: list[str], target: str, predict, repeats: int = 3, seed: int = 1, cell_rows: int = CELL_ROWS) -> DataFrame:
    """keys, feature, importance: mean drop of R2 when a feature's values are dealt anew among all rows of a key. predict: df -> df with prediction.

    ids tell the rows of a key apart. The row that stands k-th by the digest of its ids takes the value of the row that
    stands k-th by the digest of seed, repeat and ids.
    """
    text = [F.col(c).cast("string") for c in ids]
    once = numbered(df, keys, F.md5(F.concat_ws("|", *text)), "k_", cell_rows)
    again = once.select(*keys, *ids, *features, F.explode(F.array(*map(F.lit, range(1, repeats + 1)))).alias("repeat"))
    other = numbered(again, [*keys, "repeat"], F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("repeat").cast("string"), *text)), "k_", cell_rows)
    other = other.select(*keys, "repeat", "k_", F.struct(*features).alias("v_"))
    both = once.join(other, [*keys, "k_"]).withColumn("feature", F.explode(F.array(*map(F.lit, features))))
    both = both.withColumns({f: F.when(F.col("feature") == f, F.col(f"v_.{f}")).otherwise(F.col(f)) for f in features})
    e = F.col("prediction") - F.col(target)
    r2 = (1 - F.sum(e * e) / (F.var_pop(target) * F.count("*"))).alias("r2")
    base = predict(df).groupBy(*keys).agg(r2).withColumnRenamed("r2", "base")
    dealt = predict(both).groupBy(*keys, "feature", "repeat").agg(r2)
    return dealt.join(base, keys).groupBy(*keys, "feature").agg((F.max("base") - F.avg("r2")).alias("importance"))


def overlap_of_tests(rows: DataFrame, fold: str, start: str, end: str) -> DataFrame:
    """Per fold the first label start and last label end of its test rows, and whether the next fold starts before that end."""
    s = rows.filter("role = 'test'").groupBy(fold).agg(F.min(start).alias("first_start"), F.max(end).alias("last_end"))
    return s.withColumn("overlaps_next", F.coalesce(F.lead("first_start").over(Window.orderBy(fold)) <= F.col("last_end"), F.lit(False)))
