"""The given tables and the domain views derived from them, for Spark and as DuckDB text.

Sums of money run over decimals, so that both engines get the same doubles.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
FIELDS = (
    "book_equity", "net_income", "operating_cash_flow", "dividends", "shareholder_equity", "total_assets", "gross_profit", "operating_income", "revenue", "average_assets",
    "total_accruals", "total_debt", "interest_expense", "prior_total_assets", "capex", "prior_capex", "net_equity_issuance", "working_capital", "prior_working_capital",
)


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in NAMES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        raise AttributeError(name)

    @cached_property
    def panel_m(self) -> DataFrame:
        """Monthly bars by supplier."""
        unit = F.col("l_extendedprice") / F.col("l_quantity")
        total = lambda c: F.sum(F.col(c).cast("decimal(18,2)")).cast("double")
        cells = self.lineitem.groupBy(F.col("l_suppkey").alias("security_id"), F.trunc("l_shipdate", "MM").alias("date")).agg(
            (total("l_extendedprice") / total("l_quantity")).alias("price"), F.max(unit).alias("high"), F.min(unit).alias("low"), total("l_quantity").alias("volume"))
        w = Window.partitionBy("security_id").orderBy("date")
        bars = cells.withColumn("ret", F.col("price") / F.lag("price").over(w) - 1)
        s = self.supplier.join(F.broadcast(self.nation), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(self.region), F.col("n_regionkey") == F.col("r_regionkey"))
        s = s.select(F.col("s_suppkey").alias("security_id"), F.when(F.col("s_nationkey") % 2 == 0, "XNYS").otherwise("XNAS").alias("exchange"), F.col("r_name").alias("sector"), F.col("n_name").alias("industry"), (F.abs("s_acctbal") + 1).alias("shares"))
        return bars.join(s, "security_id")

    @cached_property
    def market_m(self) -> DataFrame:
        known = self.panel_m.filter("ret IS NOT NULL")
        return known.groupBy("date").agg(F.round(F.sum(F.col("volume") * F.col("ret")) / F.sum("volume"), 10).alias("market_return"), F.round(F.avg("ret"), 10).alias("benchmark_return"), F.lit(0.001).alias("risk_free"))

    @cached_property
    def panel(self) -> DataFrame:
        return self.panel_m.join(self.market_m, "date")

    @cached_property
    def panel_d(self) -> DataFrame:
        """Daily bars by brand."""
        total = lambda c: F.sum(F.col(c).cast("decimal(18,2)")).cast("double")
        unit = F.col("l_extendedprice") / F.col("l_quantity")
        rows = self.lineitem.join(self.part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
        cells = rows.groupBy(F.col("p_brand").alias("security_id"), F.to_date("l_shipdate").alias("date")).agg((total("l_extendedprice") / total("l_quantity")).alias("price"), F.max(unit).alias("high"), F.min(unit).alias("low"), total("l_quantity").alias("volume"))
        return cells.withColumn("ret", F.col("price") / F.lag("price").over(Window.partitionBy("security_id").orderBy("date")) - 1)

    @cached_property
    def fundamentals(self) -> DataFrame:
        field = F.element_at(F.array(*map(F.lit, FIELDS)), (F.col("o_orderkey") % len(FIELDS) + 1).cast("int"))
        return self.orders.groupBy((F.col("o_custkey") % 100 + 1).alias("security_id"), F.to_date("o_orderdate").alias("available_at"), field.alias("field")).agg(F.max("o_totalprice").alias("value"))

    @cached_property
    def mapping(self) -> DataFrame:
        """Consecutive orders of a customer as validity intervals of an identity."""
        w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
        rows = self.orders.select(F.col("o_custkey").alias("source_id"), F.col("o_orderkey").alias("security_id"), F.to_date("o_orderdate").alias("valid_from"), F.to_date(F.lead("o_orderdate").over(w)).alias("next_from"), F.col("o_orderstatus").alias("status"))
        return rows.withColumn("valid_to", F.date_sub("next_from", 1)).drop("next_from")

    @cached_property
    def journal(self) -> DataFrame:
        w = Window.partitionBy("user_id").orderBy("ts", "event_id")
        return self.events.select("user_id", "event_id", F.row_number().over(w).cast("long").alias("seq"), "ts", F.col("event_type").alias("state"), "value")

    @cached_property
    def scored(self) -> DataFrame:
        """Labelled documents with a bounded score."""
        d = self.documents.select("doc_id", "n_chars", F.col("lang").alias("grp"))
        p = (F.col("n_chars") % 1000 + 0.5) / 1000
        return self.labels.join(d, "doc_id").select("doc_id", F.col("quality").cast("int").alias("y"), p.alias("p"), "grp")

    @cached_property
    def intervals(self) -> DataFrame:
        """Quarterly holding intervals (start, end] over the monthly dates."""
        return self.market_m.select(F.trunc("date", "quarter").alias("start")).distinct().withColumn("end", F.add_months("start", 3))


FIXTURES = {
    "panel_m": """SELECT c.*, price / lag(price) OVER (PARTITION BY security_id ORDER BY date) - 1 AS ret, CASE WHEN s_nationkey % 2 = 0 THEN 'XNYS' ELSE 'XNAS' END AS exchange, r_name AS sector, n_name AS industry, abs(s_acctbal) + 1 AS shares
  FROM (SELECT l_suppkey AS security_id, date_trunc('month', l_shipdate)::DATE AS date, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE / sum(l_quantity::DECIMAL(18,2))::DOUBLE AS price,
    max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS volume FROM lineitem GROUP BY 1, 2) c
  JOIN supplier ON s_suppkey = security_id JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "market_m": "SELECT date, round(sum(volume * ret) / sum(volume), 10) AS market_return, round(avg(ret), 10) AS benchmark_return, 0.001::DOUBLE AS risk_free FROM panel_m WHERE ret IS NOT NULL GROUP BY date",
    "panel": "SELECT * FROM panel_m JOIN market_m USING (date)",
    "panel_d": """SELECT c.*, price / lag(price) OVER (PARTITION BY security_id ORDER BY date) - 1 AS ret FROM (SELECT p_brand AS security_id, l_shipdate::DATE AS date, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE / sum(l_quantity::DECIMAL(18,2))::DOUBLE AS price,
    max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS volume FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2) c""",
    "fundamentals": f"SELECT o_custkey % 100 + 1 AS security_id, o_orderdate::DATE AS available_at, ({list(FIELDS)!r})[o_orderkey % {len(FIELDS)} + 1] AS field, max(o_totalprice) AS value FROM orders GROUP BY 1, 2, 3",
    "mapping": """SELECT o_custkey AS source_id, o_orderkey AS security_id, o_orderdate::DATE AS valid_from, (lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))::DATE - 1 AS valid_to, o_orderstatus AS status FROM orders""",
    "journal": "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, ts, event_type AS state, value FROM events",
    "scored": "SELECT doc_id, quality::INT AS y, (n_chars % 1000 + 0.5::DOUBLE) / 1000 AS p, lang AS grp FROM labels JOIN documents USING (doc_id)",
    "intervals": "SELECT DISTINCT date_trunc('quarter', date)::DATE AS start, (date_trunc('quarter', date) + INTERVAL 3 MONTH)::DATE AS \"end\" FROM market_m",
}


def with_fixtures(sql: str, more: dict[str, str] | None = None) -> str:
    """Puts the views that a text names in front of it."""
    known, need = {**FIXTURES, **(more or {})}, []

    def add(text: str) -> None:
        for name, body in known.items():
            if name not in need and re.search(rf"\b{name}\b(?!\.)", text):
                add(body)
                if name not in need:
                    need.append(name)

    add(sql)
    if not need:
        return sql
    parts = [f"{n} AS MATERIALIZED ({known[n]})" for n in need]
    head = sql.lstrip()
    rest = ", " + head[5:] if head[:5].upper() == "WITH " else "\n" + head
    return "WITH " + ",\n".join(parts) + rest
