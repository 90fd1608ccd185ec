"""Operator 1: mixing sources to target weights by systematic sampling.

The sources' targets are shares of `total_share` times all words by weight,
none above `most` times its source's own words; the excess goes to the others
by weight until none is above. Within a source every document has the same
expected number of copies, target / source_size. Documents stand in a fixed
order (size class, then a hash of the id); their expected copies are summed
along it, one random offset per source is added, and a document is emitted
once for each integer boundary that its stretch crosses. Standing by size
class keeps each source's taken words near its target although sizes vary.

The running sum needs no single-task window: documents fall into many small
cells (source, size class, hash range); cells are numbered by their own counts
and each document adds its place in its cell.

Defined results: a null text has size 0; a null source is a source of its own,
after all others; a null doc_id hashes as ''; a source without words has target
0 and takes nothing; repeated rows are separate documents; other columns are
ignored by `mix_plan`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitwell.llm.shared import SPACE_CLASS, documents, key_join, row_key, stored

WEIGHTS = (3, 1, 2)
TOTAL_SHARE = 1.5
MOST = 2
SEED = "mix-1"
#: Rows a cell holds on average within its size class.
CELL_ROWS = 4096


def word_count(text: Column) -> Column:
    """Number of words of a text, null: 0. Counts the places where a word begins."""
    spaced = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.filter(F.split(spaced, " +"), lambda w: w != "")).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = TOTAL_SHARE, most: int = MOST) -> DataFrame:
    """source, source_size, n_docs, target: filled like water, closed form over the sources in order of cap / weight."""
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    ranked = s.withColumn("i", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("i") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight.cast("long"))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), "i")
    below = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = ranked.select(
        "*",
        ((F.sum("source_size").over(every) * F.lit(share) - F.coalesce(F.sum("source_size").over(below), F.lit(0)) * most) / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))).alias("level"),
    )
    # Sources whose cap lies under the level reached before them are full; the first that isn't fixes the level of the rest.
    fixed = F.min(F.when(F.col("source_size") * most > F.col("level") * F.col("weight"), F.struct(F.col("source_size") / F.col("weight"), "i", "level"))).over(every)
    cap = (F.col("source_size") * most).cast("double")
    return level.select("source", "source_size", "n_docs", F.when(fixed.isNull(), cap).otherwise(F.least(cap, fixed["level"] * F.col("weight"))).alias("target"))


def size_class(size: Column) -> Column:
    """Four classes for each power of two."""
    bits = F.length(F.bin(size))
    return F.when(size < 8, size).otherwise(bits * 4 + F.expr("shiftright(size, length(bin(size)) - 3)")).cast("long")


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = TOTAL_SHARE, most: int = MOST, seed: str = SEED, cell_rows: int = CELL_ROWS, by_row: bool = False) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of every row; by_row also row, a digest that tells rows of one id apart."""
    row = [row_key(docs)["digest"].alias("row")] if by_row else []
    sizes = stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), *row), "op1-sizes")
    targets = stored(source_targets(sizes, weights, share, most), "op1-targets")
    cells = max(1, min(1 << 16, int((sizes.count() / cell_rows) ** 0.5) * 4))
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    placed = sizes.withColumn("band", size_class(F.col("size"))).withColumn("digest", digest)
    placed = placed.withColumn("cell", F.floor(F.conv(F.substring("digest", 1, 8), 16, 10).cast("long") * cells / (1 << 32)).cast("long"))
    counts = placed.groupBy("source", "band", "cell").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("source").orderBy("band", "cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0))).drop("n")
    counts = counts.join(targets.select(F.col("source").alias("s"), "source_size", "target"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    counts = counts.select(*(F.col(c).alias(f"c_{c}") if c in ("source", "band", "cell") else F.col(c) for c in counts.columns))
    place = Window.partitionBy("source", "band", "cell").orderBy("digest", "doc_id", "size", *(["row"] if by_row else []))
    placed = placed.withColumn("place", F.row_number().over(place))
    joined = placed.join(counts, F.col("source").eqNullSafe(F.col("c_source")) & (F.col("band") == F.col("c_band")) & (F.col("cell") == F.col("c_cell")))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce("source", F.lit("")))), 1, 8), 16, 10).cast("long") / (1 << 32)
    per_copy = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    rank = F.col("ahead") + F.col("place")
    copies = F.floor(rank * per_copy + offset) - F.floor((rank - 1) * per_copy + offset)
    copies = F.least(copies, F.lit(most)).cast("long")
    return joined.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *(["row"] if by_row else []))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row as often as the plan says, all columns kept."""
    plan = mix_plan(docs, by_row=True, **options)
    key = F.struct(F.col("doc_id").isNull().alias("absent"), F.col("doc_id").alias("id"), F.col("row").alias("digest"))
    plan = plan.groupBy(key.alias("doc_id")).agg(F.count("*").alias("__n"), F.sum("copies").alias("__total")).filter("__total > 0")
    plan = stored(plan, "op1-plan")
    out = key_join(docs, plan.filter("__n = 1"), "inner", 250_000).withColumn("__copies", F.col("__total"))
    equal = plan.filter("__n > 1")
    if not equal.isEmpty():
        # Equal rows stand side by side in the order, so their copies differ by one at most.
        rows = key_join(docs, equal, "inner", 250_000)
        nth = F.row_number().over(Window.partitionBy(row_key(docs)).orderBy(F.lit(1)))
        rows = rows.withColumn("__nth", nth)
        copies = F.floor(F.col("__total") / F.col("__n")) + (F.col("__nth") <= F.col("__total") % F.col("__n")).cast("long")
        out = out.unionByName(rows.withColumn("__copies", copies).drop("__nth").filter("__copies > 0"))
    out = out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))))
    return out.select(*docs.columns)


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mix_plan(documents(spark, sf_dir))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source),
w AS (SELECT *, CASE i % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END::BIGINT AS weight FROM s),
l AS (SELECT *, ((SELECT sum(source_size) FROM w)::BIGINT * 1.5::DOUBLE - coalesce(sum(source_size) OVER (ORDER BY source_size / weight, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT * 2)
    / (sum(weight) OVER (ORDER BY source_size / weight, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS level FROM w),
f AS (SELECT level FROM l WHERE source_size * 2 > level * weight ORDER BY source_size / weight, i LIMIT 1),
t AS (SELECT source, source_size, coalesce(least((source_size * 2)::DOUBLE, (SELECT level FROM f) * weight), (source_size * 2)::DOUBLE) AS target FROM l),
r AS (SELECT d.*, t.source_size, t.target, row_number() OVER (PARTITION BY d.source ORDER BY
        CASE WHEN size < 8 THEN size ELSE length(bin(size)) * 4 + (size >> (length(bin(size)) - 3)::INT) END,
        md5(coalesce(doc_id::VARCHAR, '')), doc_id, size) AS rank,
        coalesce(t.target / nullif(t.source_size, 0), 0) AS per_copy,
        ('0x' || substr(md5('mix-1' || coalesce(d.source, '')), 1, 8))::BIGINT / 4294967296 AS o
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       least(floor(rank * per_copy + o)::BIGINT - floor((rank - 1) * per_copy + o)::BIGINT, 2) * size AS taken FROM r
"""
