"""Sinks and published tables (A16 to A23)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitwell.operators.joins import JoinError
from pitwell.operators.storage import new_folder  # noqa: F401  a sink's folder


def fingerprint(df: DataFrame) -> DataFrame:
    """One row: rows and an identity of the content that does not depend on row order."""
    part = F.conv(F.substring(F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    out = df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(part), F.lit(0)).alias("s"))
    return out.select("rows", F.sha2(F.concat_ws("|", F.col("rows").cast("string"), F.col("s").cast("string"), F.lit(str(sorted(df.dtypes)))), 256).alias("content_id"))


def publish(df: DataFrame, path: str) -> str:
    """Writes once, re-reads and compares schema, count and content; the same content again is fine, other content raises. Returns the content id."""
    spark: SparkSession = df.sparkSession
    wanted = fingerprint(df).first()
    try:
        found = spark.read.parquet(path)
    except Exception as e:  # the path does not exist yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
        found = spark.read.parquet(path)
    if fingerprint(found.select(*df.columns)).first() != wanted:
        raise JoinError(f"{path} holds other content")
    return wanted.content_id


def filtered_read(spark: SparkSession, path: str, columns: list[str], condition) -> DataFrame:
    return spark.read.parquet(path).filter(condition).select(*columns)


def validated_view(spark: SparkSession, parts: DataFrame, kind: str, name: str) -> DataFrame:
    """parts: path, dataset_type, status, state. A view over the finalized, passing parts of a type; their list is control data."""
    good = parts.filter((F.col("dataset_type") == kind) & F.col("status").isin("PASS", "PASS_WITH_WARNINGS") & (F.col("state") == "FINALIZED")).select("path")
    paths = [r.path for r in good.collect()]
    if not paths:
        raise JoinError(f"no valid part of {kind}")
    df = spark.read.parquet(*paths)
    df.createOrReplaceTempView(name)
    return df


def table_page(df: DataFrame, order: list[str], offset: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """One page in a stated order, and the total count."""
    return df.orderBy(*order).offset(offset).limit(limit), df.agg(F.count("*").alias("total"))


def quarantine(df: DataFrame, bad, reason, path: str) -> DataFrame:
    """Writes the rows that break a rule with the reason, and returns the others."""
    hit = F.coalesce(bad, F.lit(False))
    df.filter(hit).withColumn("reason", reason).write.mode("append").parquet(path)
    return df.filter(~hit)
