"""Contracted scans and source standardisation (A): DataFrames in, DataFrames out, no network clients."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pitwell.functions.scalar import end_of_day
from pitwell.operators.joins import JoinError, interval_join

MISSING_TOKENS = ("", ".", "NA", "NaN")


@dataclass(frozen=True)
class Contract:
    name: str
    schema: StructType
    key: tuple[str, ...]


def contracted_scan(spark: SparkSession, path: str, contract: Contract, kind: str = "parquet") -> DataFrame:
    """A file set under its contract; columns and order must agree, malformed rows raise."""
    if kind == "parquet":
        df = spark.read.parquet(path)
        if [(f.name, f.dataType) for f in df.schema] != [(f.name, f.dataType) for f in contract.schema]:
            raise JoinError(f"{path} does not follow {contract.name}")
        return df
    return spark.read.schema(contract.schema).option("mode", "FAILFAST").option("header", True).format(kind).load(path)


def unit_contract_findings(declared: DataFrame, allowed: DataFrame) -> DataFrame:
    """Declared (field, unit) pairs that aren't allowed."""
    return declared.join(allowed, ["field", "unit"], "left_anti")


def macro_observations(df: DataFrame, series: str, date: str, value: str, keep: list[str] = []) -> DataFrame:
    v = F.when(~F.trim(F.col(value)).isin(*MISSING_TOKENS), F.expr(f"try_cast(`{value}` AS DOUBLE)"))
    return df.select(*keep, F.lit(series).alias("series_id"), F.to_date(date).alias("observation_date"), v.alias("value"), v.isNull().alias("missing_value"))


def factor_text_to_long(lines: DataFrame, names: list[str]) -> DataFrame:
    """value lines 'yyyymmdd, a, b' -> date, factor, return / 100; -99.99 and -999 are missing. Other lines are headers and notes."""
    rows = lines.filter(F.col("value").rlike(r"^\s*[0-9]{8}\s*,")).select(F.split(F.col("value"), ",").alias("p"))
    wide = rows.select(F.to_date(F.trim(F.get("p", F.lit(0))), "yyyyMMdd").alias("date"), *(F.expr(f"try_cast(trim(get(p, {i + 1})) AS DOUBLE)").alias(n) for i, n in enumerate(names)))
    long = wide.unpivot(["date"], names, "factor", "pct")
    return long.filter(F.col("pct").isNotNull() & ~F.col("pct").isin(-99.99, -999.0)).select("date", "factor", (F.col("pct") / 100.0).alias("ret"))


def collapse_duplicates(df: DataFrame, columns: list[str], as_of: Column) -> DataFrame:
    cleaned = [F.lower(F.trim(F.col(c).cast("string"))).alias(c) for c in columns]
    return df.select(*cleaned).groupBy(*columns).agg(F.count("*").alias("source_duplicate_count")).withColumn("as_of_date", as_of)


def daily_bars(bars: DataFrame, mapping: DataFrame, key: str, first: str, last: str) -> DataFrame:
    """Vendor bars in a date range with the identity valid on each day."""
    return interval_join(bars.filter(F.col("date").between(first, last)), mapping, [key], "date", "valid_from", "valid_to")


def splice_breaks(bars: DataFrame, key: str, source: str, price: str = "price", limit: float = 0.5) -> DataFrame:
    """Rows at a change of upstream source whose price jumps beyond the limit."""
    w = Window.partitionBy(key).orderBy("date")
    rows = bars.withColumns({"was_": F.lag(source).over(w), "p_": F.lag(price).over(w)})
    return rows.filter((F.col("was_") != F.col(source)) & (F.abs(F.col(price) / F.col("p_") - 1) > limit)).drop("was_", "p_")


def wide_to_long(wide: DataFrame, key: str, names: list[str], zero: list[str] = []) -> DataFrame:
    long = wide.unpivot([key], names, "name", "value").filter("value IS NOT NULL")
    return long.withColumn("value", F.when(F.col("name").isin(*zero or [""]), F.coalesce("value", F.lit(0.0))).otherwise(F.col("value")))


def flatten_facts(docs: DataFrame, text: str) -> DataFrame:
    """JSON taxonomy -> concept -> unit -> [facts] to rows; availability is the end of the filing day. Facts without filed, end or value fall out."""
    fact = "array<struct<end: string, val: double, filed: string, form: string, accn: string>>"
    parsed = docs.withColumn("j_", F.from_json(text, f"map<string, map<string, map<string, {fact}>>>"))
    one = parsed.select("*", F.explode("j_").alias("taxonomy", "c_")).select("*", F.explode("c_").alias("concept", "u_")).select("*", F.explode("u_").alias("unit", "f_"))
    rows = one.select(*(c for c in docs.columns if c != text), "taxonomy", "concept", "unit", F.inline("f_"))
    rows = rows.filter("end IS NOT NULL AND val IS NOT NULL AND filed IS NOT NULL")
    return rows.withColumn("available_at", end_of_day(F.to_date("filed")))


def parallel_arrays(df: DataFrame, arrays: list[str]) -> DataFrame:
    """Parallel arrays to rows; unequal lengths raise."""
    sizes = F.array_distinct(F.array(*map(F.size, arrays)))
    kept = [c for c in df.columns if c not in arrays]
    checked = df.withColumn("ok_", F.when(F.size(sizes) > 1, F.raise_error(F.lit("arrays differ in length"))).otherwise(F.lit(True))).filter("ok_")
    return checked.select(*kept, F.inline(F.arrays_zip(*arrays)))


def availability(text: Column, filed: Column) -> tuple[Column, Column]:
    """Exact UTC time of an acceptance text with offset, else the end of the filing day; and the quality."""
    exact = F.when(text.rlike(r"(Z|[+-]\d\d:\d\d)$"), F.try_to_timestamp(text))
    return F.coalesce(exact, end_of_day(filed)), F.when(exact.isNotNull(), "SOURCE_TIMESTAMP").otherwise("INFERRED_DATE_LEVEL")


def reconcile_inventories(a: DataFrame, b: DataFrame, key: str, kind: str, wanted: str) -> DataFrame:
    both = a.select(key, kind, F.lit(True).alias("a_")).join(b.select(key, F.lit(True).alias("b_")), key, "full_outer")
    reason = F.when(F.col("b_").isNull(), "missing_in_second").when(F.col("a_").isNull(), "missing_in_first").when(F.col(kind) != wanted, "other_class").otherwise("selected")
    return both.select(key, reason.alias("reason"))
