"""Operator 6: repeated line runs by a suffix array over line ids, ranked by distributed prefix doubling.

A document is the sequence of its lines with a word; what stands between two of
them (lines without a word) belongs to the step from one to the next. Line ids are
ranks of the lines' digests. Doubling ranks the suffixes of all sequences by their
first 1, 2, 4, ... lines: the pairs (rank at a line, step, rank k lines further on)
are sorted over the cluster and numbered in that order, so that equal prefixes share
a rank and ranks rise along the suffix array. A rank that only one suffix has can
never repeat and falls out, so rounds shrink quickly. Once the ranks reach the least
run asked for, neighbours of one rank are an interval whose common prefixes have that
many lines; its first place (smallest doc_id, line) stays, all others are later
copies. Later copies that touch or overlap are one maximal run, and runs are deleted.
Longer prefixes decide nothing more, so doubling ends there, however long runs are.

`least` counts lines with a word. With 1, a line with a word goes if it stands
earlier, and the lines without a word after it go if the whole stretch to the next
line with a word stands earlier. Lines without a word are never repeats by
themselves. Line ids are 128 bits of SHA-256.

Defined results: lines are split at \\n; a null text has no line, an empty text
has one empty line; runs never cross documents; rows of one doc_id with different
texts are different documents, in the order of a digest of the row, and equal rows
are one; a null doc_id comes after all others (of several, by that digest); other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitwell.llm.shared import documents, spread_join, stored, told_apart

WORDED = r"[^\x20\x09-\x0D]"
LEAST_RUN = 1


def digest(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 32)


def line_table(docs: DataFrame, step: int) -> DataFrame:
    """doc_id, place (among lines with a word, from 0), line (from 0), stop (the line `step` places further on), name, gap (what follows before the next one; empty: nothing)."""
    # The array of lines is one column, so that it isn't split anew for each line.
    split = docs.filter("text IS NOT NULL").select("doc_id", F.split("text", "\n", -1).alias("lines"))
    numbered = F.transform("lines", lambda x, i: F.when(x.rlike(WORDED), i))
    split = split.select("doc_id", "lines", F.array_compact(numbered).alias("at"))

    def unit(i: Column, place: Column) -> Column:
        after = F.get("at", place + 1)
        between = F.when(after > i + 1, digest(F.array_join(F.slice("lines", i + 2, after - i - 1), "\n"))).otherwise("")
        return F.struct(place.alias("place"), i.alias("line"), F.get("at", place + step).alias("stop"), digest(F.get("lines", i)).alias("name"), between.alias("gap"))

    return split.select("doc_id", F.explode(F.transform("at", unit)).alias("x")).select("doc_id", "x.*").distinct()


def ranked(windows: DataFrame, keys: list[str]) -> DataFrame:
    """doc_id, place, rank, first of the windows that stand at two places or more; ranks rise in the order of the keys."""
    names = windows.groupBy(*keys).agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "place")).alias("first")).filter("n > 1")
    names = stored(names.orderBy(*keys).withColumn("rank", F.monotonically_increasing_id()), "op6-ranks")
    return stored(spread_join(windows, names, keys).select("doc_id", "place", "rank", "first"), "op6-windows")


def paired(ranks: DataFrame, ahead: int) -> DataFrame:
    """doc_id, place, here, then: the ranks at a place and `ahead` places further on."""
    other = ranks.select("doc_id", (F.col("place") - ahead).cast("int").alias("place"), F.col("rank").alias("then"))
    return ranks.select("doc_id", "place", F.col("rank").alias("here")).join(other, ["doc_id", "place"])


def suffix_ranks(lines: DataFrame, sizes: list[int]) -> dict[int, DataFrame]:
    """For each of the sizes: doc_id, place, rank, first of the suffixes that share their first lines, so many, with another."""
    now, length, out = ranked(lines, ["name"]), 1, {}
    for size in sorted(set(sizes)):
        while 2 * length <= size:
            steps = lines.select("doc_id", (F.col("place") - (length - 1)).cast("int").alias("place"), "gap")
            now, length = ranked(paired(now, length).join(steps, ["doc_id", "place"]), ["here", "gap", "then"]), 2 * length
        # Two overlapping prefixes cover any length between two powers of two.
        out[size] = now if size == length else ranked(paired(now, size - length), ["here", "then"])
    return out


def later_runs(docs: DataFrame, least: int = LEAST_RUN) -> DataFrame:
    """doc_id, low, high: the maximal runs of lines that are later copies."""
    sizes = sorted({least, max(least, 2)})
    lines = stored(line_table(docs, sizes[-1] - 1), "op6-lines")
    covered = None
    for size, ranks in suffix_ranks(lines, sizes).items():
        again = ranks.filter(F.col("first") != F.struct("doc_id", "place")).select("doc_id", "place")
        high = "line" if size == 1 else "stop"
        part = again.join(lines.select("doc_id", "place", F.col("line").alias("low"), F.col(high).alias("high")), ["doc_id", "place"]).select("doc_id", "low", "high")
        covered = part if covered is None else covered.unionByName(part)
    up = Window.partitionBy("doc_id").orderBy("low", "high")
    reach = F.max("high").over(up.rowsBetween(Window.unboundedPreceding, -1))
    runs = covered.withColumn("run", F.coalesce(F.col("low") > reach + 1, F.lit(True)).cast("int")).withColumn("run", F.sum("run").over(up))
    return runs.groupBy("doc_id", "run").agg(F.min("low").alias("low"), F.max("high").alias("high")).drop("run")


def drop_lines(docs: DataFrame, least: int = LEAST_RUN) -> DataFrame:
    """doc_id, lines, kept (arrays), runs (low, high of each run deleted): documents without the later copies of repeated runs."""
    docs, out = told_apart(docs)
    marks = later_runs(docs, least).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("low", "high"))).alias("runs"))
    joined = docs.select("doc_id", "text").join(marks.withColumnRenamed("doc_id", "marked"), F.col("doc_id") == F.col("marked"), "left")
    lines = F.when(F.col("text").isNull(), F.array().cast("array<string>")).otherwise(F.split("text", "\n", -1))
    joined = joined.select(out.alias("doc_id"), lines.alias("lines"), "runs")
    # What stays are the stretches between runs.
    low = F.concat(F.array(F.lit(0)), F.transform("runs", lambda x: x["high"] + 1))
    high = F.concat(F.transform("runs", lambda x: x["low"]), F.array(F.size("lines")))
    stays = F.flatten(F.transform(F.arrays_zip(low.alias("low"), high.alias("high")), lambda x: F.slice("lines", x["low"] + 1, x["high"] - x["low"])))
    none = F.array().cast("array<struct<low: int, high: int>>")
    return joined.select("doc_id", "lines", F.when(F.col("runs").isNull(), F.col("lines")).otherwise(stays).alias("kept"), F.coalesce("runs", none).alias("runs"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_lines(documents(spark, sf_dir))
    return out.select(
        "doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("kept")).cast("long").alias("n_removed"),
        F.sha2(F.array_join("kept", "\n"), 256).alias("kept_sha256"),
    )


SQL = r"""
WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents),
l AS (SELECT doc_id, unnest(a) AS x, generate_subscripts(a, 1) AS i FROM t),
w AS (SELECT doc_id, i, x, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM l WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
s AS (SELECT doc_id, i, row_number() OVER (PARTITION BY x ORDER BY doc_id, i) AS place FROM w),
r AS (SELECT w.doc_id, i, e, array_to_string(a[i:e], chr(10)) AS y FROM w JOIN t USING (doc_id) WHERE e > i + 1),
q AS (SELECT doc_id, i, e, row_number() OVER (PARTITION BY y ORDER BY doc_id, i) AS place FROM r),
g AS (SELECT doc_id, i FROM s WHERE place > 1 UNION SELECT doc_id, unnest(range(i + 1, e)) AS i FROM q WHERE place > 1),
k AS (SELECT l.doc_id, count(*) AS n_lines, count(g.i) AS n_removed, coalesce(string_agg(l.x, chr(10) ORDER BY l.i) FILTER (g.i IS NULL), '') AS t
      FROM l LEFT JOIN g USING (doc_id, i) GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM documents d LEFT JOIN k USING (doc_id)
"""
