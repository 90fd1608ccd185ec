"""Operator 4: quality rules with robust multivariate outliers.

Counts are taken from whole texts, a slice of documents at a time. The verdict
of the method is a regularised minimum covariance determinant for each language
and source over five transformed statistics, rounded to a grid of 1/32:

1. Rows that pass the base rule collapse to cells (group, grid point, count), so
   that the later passes don't grow with repeated statistics.
2. Four deterministic starts for each group: median with quartile ranges, plain
   mean and covariance, spatial signs, and hyperbolic tangents.
3. Concentration steps for all groups and starts at once: squared distances fall
   into narrow bins, sums by bin give the mean and covariance of the nearest
   INNER share (whole bins), until no start's determinant falls any more.
4. The start with the smallest determinant is the group's estimate. Documents
   whose squared Mahalanobis distance exceeds CUT are rejected.

An estimate is the group's own at every size: its sums are joined by those of
PRIOR rows that look like the estimate over all rows, which decides little in a
large group and most in a group of few; RIDGE is added to the diagonal because
clean documents often have no symbol or repeated line at all (variance 0).
Estimates are rounded, so that the order in which tasks add up changes nothing.

Defined results: a null text has no words and fails the base rule; null
language or source is a group of its own; repeated rows get equal results; a
group without a row that passes the base rule has no estimate and no kept row;
other columns are kept by `kept_documents` and ignored elsewhere.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitwell.llm.shared import Words, both, bytes_hash, covered, documents, in_batches, key_join, keyed, slices, spread_join, stored, sums

LEAST_WORDS, REPEAT_WINDOW, MOST_REPEATED = 20, 8, 30
#: Share of a group's rows that the scatter is estimated from, its consistency factor for five dimensions
#: (0.75 / P(chi2_7 <= chi2_5's 75 % point)), and the chi2_5 point with 1e-8 beyond it.
INNER, CONSISTENCY, CUT = 0.75, 1.41, 45.1
STATS = ("x_words", "x_length", "x_symbols", "x_lines", "x_repeats")
#: Standard deviations added to each statistic's own, rows that the estimate over all rows counts for, and grid points to one.
RIDGE, PRIOR, GRID = (0.3, 0.05, 0.12, 0.15, 0.12), 50, 32
#: Bins of squared distances for each doubling of 1 + distance.
BINS = 8
PAIRS = [(i, j) for i in range(len(STATS)) for j in range(i, len(STATS))]
STARTS = 4

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def counts_of(texts: pa.Array) -> dict[str, np.ndarray]:
    w = Words(texts)
    n_docs = len(w.count)
    points = np.zeros(len(w.data) + 1, np.int64)
    np.cumsum((w.data & 0xC0) != 0x80, out=points[1:])
    # Lines: from a document's start or behind a \n to the next \n or the document's end.
    breaks = np.flatnonzero(w.data == 10)
    start = np.unique(np.concatenate([w.offsets[:-1], breaks + 1]))  # empty lines at an end fall together with the next start
    line_doc = np.searchsorted(w.offsets[1:], start, "right")
    inside = line_doc < n_docs
    start, line_doc = start[inside], line_doc[inside]
    nxt = np.searchsorted(breaks, start)
    end = np.minimum(np.append(breaks, len(w.data))[nxt], w.offsets[line_doc + 1])
    worded = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
    start, end, line_doc = start[worded], end[worded], line_doc[worded]
    key = both(bytes_hash(w.data, start, end), line_doc.astype(np.uint64))
    once = np.unique(key, return_index=True)[1]
    n_lines = np.bincount(line_doc, minlength=n_docs)
    first, hashes = w.windows(REPEAT_WINDOW)
    repeats = np.zeros(len(w.start), bool)
    if len(first):
        key = both(hashes, w.doc[first].astype(np.uint64))
        order = np.argsort(key, kind="stable")
        same = np.zeros(len(key) + 1, bool)
        same[1:-1] = key[order][1:] == key[order][:-1]
        repeats = covered(first[order[same[1:] | same[:-1]]], REPEAT_WINDOW, len(w.start))
    return {
        "n_words": w.count,
        "word_chars": sums(points[w.end] - points[w.start], w.first),
        "n_symbols": sums(_SYMBOL[w.data], w.offsets),
        "n_dup_lines": n_lines - np.bincount(line_doc[once], minlength=n_docs),
        "n_repeat_words": sums(repeats, w.first),
        "n_lines": n_lines,
    }


def text_counts(docs: DataFrame, keys: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """The key columns of every row and the counts of its text."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b):
                c = counts_of(part.column("text"))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keys), *(pa.array(c[n].astype(np.int64)) for n in names)], names=[*keys, *names])

    kept = ", ".join(f"{k} {docs.schema[k].dataType.simpleString()}" for k in keys)
    return docs.select(*keys, "text").transform(in_batches, run, f"{kept}, " + ", ".join(f"{n} long" for n in names))


def transformed(counts: DataFrame) -> DataFrame:
    """The counts with the five statistics on the grid, and group, a digest of language and source."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    stats = (
        F.log1p("n_words"),
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / words),
        F.sqrt(F.col("n_symbols") / words),
        F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
        F.sqrt(F.col("n_repeat_words") / words),
    )
    told = [F.coalesce(F.concat(F.lit("+"), F.col(c).cast("string")), F.lit("-")) for c in ("lang", "source")]
    group = F.md5(F.concat_ws("\x1f", F.length(told[0]).cast("string"), *told))
    return counts.withColumns({name: F.round(x * GRID) / GRID for name, x in zip(STATS, stats)} | {"key": group})


def squared_distance() -> Column:
    """From the columns of STATS, c0.. (centre) and p0.. (precision, in the order of PAIRS)."""
    gap = [F.col(s) - F.col(f"c{i}") for i, s in enumerate(STATS)]
    return sum((F.col(f"p{k}") * gap[i] * gap[j] * (1.0 if i == j else 2.0) for k, (i, j) in enumerate(PAIRS)), F.lit(0.0))


ESTIMATE = "key string, start int, n long, det double, " + ", ".join(f"c{i} double" for i in range(len(STATS))) + ", " + ", ".join(f"p{k} double" for k in range(len(PAIRS))) + ", " + ", ".join(f"s{k} double" for k in range(len(PAIRS)))


def square(values: np.ndarray) -> np.ndarray:
    """The symmetric matrix of its entries in the order of PAIRS."""
    out = np.zeros((len(STATS), len(STATS)))
    for (i, j), x in zip(PAIRS, values):
        out[i, j] = out[j, i] = x
    return out


def flat(matrix: np.ndarray) -> list[float]:
    return [float(matrix[i, j]) for i, j in PAIRS]


def estimate(key: str, start: int, n: int, centre: np.ndarray, scatter: np.ndarray) -> tuple:
    """A row of ESTIMATE, rounded so that the last digits of sums don't show."""
    centre, scatter = np.round(centre, 9), np.round(scatter, 9)
    return (key, start, n, round(float(np.linalg.slogdet(scatter)[1]), 7), *centre.tolist(), *flat(np.linalg.inv(scatter)), *flat(scatter))


def shrunk(held: float, centre: np.ndarray, scatter: np.ndarray, prior: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
    """Mean and scatter of the rows held, joined by PRIOR rows like the prior, or without one with the ridge."""
    if prior is None:
        return centre, scatter + np.diag(np.square(RIDGE))
    share = held / (held + PRIOR)
    return share * centre + (1 - share) * prior[0], share * scatter + (1 - share) * prior[1] + share * np.diag(np.square(RIDGE))


def rows_of(make: Callable[[dict], list[tuple]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function that makes rows of ESTIMATE from each row."""
    kinds = [pa.string(), pa.int32(), pa.int64()] + [pa.float64()] * (1 + len(STATS) + 2 * len(PAIRS))
    names = [c.split()[0] for c in ESTIMATE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [x for row in b.to_pylist() for x in make(row)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * len(kinds), kinds)], names=names)

    return run


def middles(cells: DataFrame) -> DataFrame:
    """key, n, m0.. (medians), w0.. (robust standard deviations from the quartiles, the ridge at least): exact, from counts by grid point."""
    each = cells.select("key", "n", F.posexplode(F.array(*STATS)).alias("i", "x")).groupBy("key", "i", "x").agg(F.sum("n").alias("n"))
    up = Window.partitionBy("key", "i").orderBy("x")
    each = each.withColumn("below", F.sum("n").over(up)).withColumn("total", F.sum("n").over(Window.partitionBy("key", "i")))
    point = lambda q: F.min(F.when(F.col("below") >= q * F.col("total"), F.col("x")))
    each = each.groupBy("key", "i").agg(F.max("total").alias("n"), point(0.5).alias("m"), ((point(0.75) - point(0.25)) / 1.349).alias("w"))
    pick = lambda c, i: F.max(F.when(F.col("i") == i, F.col(c)))
    return each.groupBy("key").agg(F.max("n").alias("n"), *(pick("m", i).alias(f"m{i}") for i in range(len(STATS))), *(F.greatest(pick("w", i), F.lit(r)).alias(f"w{i}") for i, r in enumerate(RIDGE)))


def starts(cells: DataFrame, prior: tuple[np.ndarray, np.ndarray] | None) -> DataFrame:
    """The starting estimates of all groups, STARTS rows a key."""
    middle = stored(middles(cells), "op4-middles")
    p = len(STATS)
    z = [(F.col(s) - F.col(f"m{i}")) / F.col(f"w{i}") for i, s in enumerate(STATS)]
    rows = spread_join(cells.withColumnRenamed("n", "rows"), middle, "key")
    rows = rows.withColumn("length", F.greatest(F.sqrt(sum((x * x for x in z), F.lit(0.0))), F.lit(1e-9)))
    weigh = lambda xs: [F.sum(F.col("rows") * x) for x in xs]
    cross = lambda xs: weigh(xs[i] * xs[j] for i, j in PAIRS)
    plain, sign, bent = [F.col(s) for s in STATS], [x / F.col("length") for x in z], [F.tanh(x) for x in z]
    sums_ = rows.groupBy("key", "n", *(f"{c}{i}" for c in "mw" for i in range(p))).agg(
        F.array(*weigh(plain)).alias("first"), F.array(*cross(plain)).alias("second"), F.array(*cross(sign)).alias("signs"), F.array(*weigh(bent)).alias("bent1"), F.array(*cross(bent)).alias("bent2")
    )

    def make(r: dict) -> list[tuple]:
        n, m, w = r["n"], np.array([r[f"m{i}"] for i in range(p)]), np.array([r[f"w{i}"] for i in range(p)])
        scale = np.diag(w)
        mean, bent_ = np.array(r["first"]) / n, np.array(r["bent1"]) / n
        found = [
            (m, scale @ scale),
            (mean, square(r["second"]) / n - np.outer(mean, mean)),
            (m, scale @ (square(r["signs"]) / n * p) @ scale),
            (m, scale @ (square(r["bent2"]) / n - np.outer(bent_, bent_)) @ scale),
        ]
        # Starts have no place in the search for the smallest determinant, only where they lead to.
        return [(*(e := estimate(r["key"], k, n, *shrunk(n, c, s, prior)))[:3], float("inf"), *e[4:]) for k, (c, s) in enumerate(found)]

    return stored(sums_.transform(in_batches, rows_of(make), ESTIMATE), "op4-starts")


def concentrated(cells: DataFrame, now: DataFrame, prior: tuple[np.ndarray, np.ndarray] | None) -> DataFrame:
    """One concentration step from every row of `now`."""
    rows = spread_join(cells.withColumnRenamed("n", "rows"), now.select("key", "start", "n", *(c for c in now.columns if c[0] in "cp" and c[1:].isdigit())), "key")
    rows = rows.withColumn("bin", F.floor(F.log2(1 + F.greatest(squared_distance(), F.lit(0.0))) * BINS).cast("int"))
    weigh = lambda xs: F.array(*(F.sum(F.col("rows") * x) for x in xs))
    bins = rows.groupBy("key", "start", "n", "bin").agg(F.sum("rows").alias("rows"), weigh(F.col(s) for s in STATS).alias("first"), weigh(F.col(STATS[i]) * F.col(STATS[j]) for i, j in PAIRS).alias("second"))
    listed = bins.groupBy("key", "start", "n").agg(F.array_sort(F.collect_list(F.struct("bin", "rows", "first", "second"))).alias("bins"))

    def make(r: dict) -> list[tuple]:
        held, first, second = 0, np.zeros(len(STATS)), np.zeros(len(PAIRS))
        for x in r["bins"]:
            held, first, second = held + x["rows"], first + x["first"], second + x["second"]
            if held >= INNER * r["n"]:
                break
        mean = first / held
        return [estimate(r["key"], r["start"], r["n"], *shrunk(held, mean, CONSISTENCY * (square(second / held) - np.outer(mean, mean)), prior))]

    return listed.transform(in_batches, rows_of(make), ESTIMATE)


def smallest_determinants(cells: DataFrame, prior: tuple[np.ndarray, np.ndarray] | None) -> DataFrame:
    """One row of ESTIMATE for each key: where the start with the smallest determinant leads to. cells: key, STATS, n."""
    now = starts(cells, prior)
    done, open_ = None, now
    while True:
        new = concentrated(cells, open_, prior).select(*now.columns)
        old = open_.select("key", "start", F.col("det").alias("was"))
        new = stored(new.join(old, ["key", "start"]), "op4-step")
        better = new.filter("det < was - 1e-6").drop("was")
        # Starts whose determinant fell no further are done, with the estimate before.
        ended = open_.join(new.filter("NOT det < was - 1e-6").select("key", "start"), ["key", "start"], "left_semi")
        done = ended if done is None else done.unionByName(ended)
        if better.isEmpty():
            break
        open_ = better
    best = done.groupBy("key").agg(F.min(F.struct("det", "start")).alias("b")).select("key", F.col("b.start").alias("start"))
    return stored(done.join(best, ["key", "start"], "left_semi"), "op4-best")


def estimates(rows: DataFrame) -> DataFrame:
    """The estimate of every group of rows (key, STATS)."""
    cells = stored(rows.groupBy("key", *STATS).agg(F.count("*").alias("n")), "op4-cells")
    every = cells.groupBy(*STATS).agg(F.sum("n").alias("n")).withColumn("key", F.lit(""))
    over_all = smallest_determinants(stored(every, "op4-all"), None).collect()  # one row
    if not over_all:
        return smallest_determinants(cells, None)
    r = over_all[0]
    return smallest_determinants(cells, (np.array([r[f"c{i}"] for i in range(len(STATS))]), square([r[f"s{k}"] for k in range(len(PAIRS))])))


def verdicts(docs: DataFrame) -> DataFrame:
    """Counts of every row with base_failed, distance2 and kept."""
    rows = transformed(text_counts(docs))
    # Rows that fail the base rule are gone anyway and would only blur the estimates.
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    rows = stored(rows.withColumn("base_failed", failed), "op4-counts")
    found = estimates(rows.filter("NOT base_failed")).drop("n", "start", "det")
    groups = rows.groupBy("key").agg(F.count("*").alias("n"))
    chosen = stored(groups.join(found, "key", "left"), "op4-chosen")
    distance = F.coalesce(squared_distance(), F.lit(0.0))
    out = spread_join(rows, chosen, "key").withColumn("distance2", distance)
    kept = ~F.col("base_failed") & (F.col("distance2") <= CUT)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "distance2")


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents that pass, all columns. Each row stands for itself, also with a null or repeated id."""
    gone = stored(verdicts(keyed(docs)).filter("NOT kept").select("doc_id").distinct(), "op4-gone")
    return key_join(docs, gone, "left_anti", 500_000)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(documents(spark, sf_dir))
