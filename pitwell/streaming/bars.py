"""Streaming checks of daily bars, and late filings behind a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def row_checks(bars: DataFrame) -> DataFrame:
    """Stateless rules on each bar of a stream: the rows that break one, with its name."""
    c = F.col
    rule = (F.when(c("date").isNull(), "invalid_date").when(~(c("price") > 0), "price_positive").when(c("high") < c("low"), "high_below_low")
            .when((c("price") > c("high")) | (c("price") < c("low")), "close_outside_range").when(c("volume") < 0, "negative_volume"))
    return bars.withColumn("rule", rule).filter("rule IS NOT NULL")


def latest_facts(filings: DataFrame, delay: str = "30 days") -> DataFrame:
    """Per security, field and day the value of the latest filing; filings later than the delay are dropped by the watermark."""
    day = F.window("available_at", "1 day")
    return filings.withWatermark("available_at", delay).groupBy("security_id", "field", day.alias("day")).agg(F.max_by("value", "available_at").alias("value"), F.max("available_at").alias("available_at"))


def event_counts(events: DataFrame, every: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).groupBy(F.window("ts", every).alias("span"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
