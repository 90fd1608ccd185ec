"""Validation operators (B): every check returns findings (rule, severity, field, affected, samples).

Row rules are counted in one aggregate over the table, whatever their number.
Strict callers pass findings to `enforce`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitwell.functions.scalar import end_of_day, finite
from pitwell.operators.joins import JoinError, interval_join
from pitwell.operators.lineage import cyclic_nodes

SEVERITIES = ("INFO", "WARNING", "ERROR", "CRITICAL")
SAMPLES = 5


def row_rules(df: DataFrame, rules: dict[str, tuple[Column, str, str]], key: Column) -> DataFrame:
    """rules: name -> (violation, severity, field). One row per rule, with the smallest keys that break it; one aggregate."""
    aggs = []
    for name, (bad, _, _) in rules.items():
        hit = F.coalesce(bad, F.lit(False))
        aggs += [F.count_if(hit).alias(f"n_{name}"), F.min(F.when(hit, key)).alias(f"s_{name}")]
    one = df.agg(*aggs)
    rows = [F.struct(F.lit(n).alias("rule"), F.lit(sev).alias("severity"), F.lit(field).alias("field"), F.col(f"n_{n}").alias("affected"), F.col(f"s_{n}").cast("string").alias("sample")) for n, (_, sev, field) in rules.items()]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def failed(findings: DataFrame) -> DataFrame:
    return findings.filter("affected > 0")


def enforce(findings: DataFrame) -> None:
    """Raises when a blocking rule is broken."""
    worst = failed(findings).filter(F.col("severity").isin("ERROR", "CRITICAL")).orderBy("rule").first()
    if worst:
        raise JoinError(f"{worst.rule}: {worst.affected} rows of {worst.field}")


def duplicate_keys(df: DataFrame, keys: list[str], rule: str = "duplicate_key", severity: str = "CRITICAL") -> DataFrame:
    again = df.groupBy(*keys).count().filter("count > 1")
    out = again.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("affected"), F.min(F.concat_ws("|", *(F.col(k).cast("string") for k in keys))).alias("sample"))
    return out.select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.lit(",".join(keys)).alias("field"), "affected", "sample")


def table_contract(df: DataFrame, keys: list[str], required: list[str]) -> DataFrame:
    key = F.concat_ws("|", *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys))
    nulls = row_rules(df, {f"null_{c}": (F.col(c).isNull(), "CRITICAL", c) for c in required}, key)
    empty = df.agg(F.count("*").alias("n")).select(F.lit("empty").alias("rule"), F.lit("CRITICAL").alias("severity"), F.lit("*").alias("field"), (F.col("n") == 0).cast("long").alias("affected"), F.lit(None).cast("string").alias("sample"))
    return nulls.unionByName(duplicate_keys(df, keys)).unionByName(empty)


def schema_difference(df: DataFrame, expected: list[str]) -> tuple[list[str], list[str]]:
    """(missing, extra) columns; only metadata."""
    return [c for c in expected if c not in df.columns], [c for c in df.columns if c not in expected]


def daily_market(df: DataFrame, jump: float = 0.5, repeats: int = 5) -> DataFrame:
    """security_id, date, open?, high, low, price, volume. Repeated closes count in total per security."""
    c, w = F.col, Window.partitionBy("security_id").orderBy("date")
    before = F.lag("price").over(w)
    rows = df.withColumns({"move_": c("price") / before - 1, "same_": (c("price") == before).cast("int")})
    rules = {
        "invalid_date": (c("date").isNull(), "CRITICAL", "date"),
        "price_positive": (~finite(c("price")) | (c("price") <= 0), "CRITICAL", "price"),
        "high_below_low": (c("high") < c("low"), "CRITICAL", "high"),
        "close_outside_range": ((c("price") > c("high")) | (c("price") < c("low")), "CRITICAL", "price"),
        "negative_volume": (c("volume") < 0, "CRITICAL", "volume"),
        "abnormal_move": (F.abs("move_") > jump, "WARNING", "price"),
    }
    key = F.concat_ws("|", c("security_id").cast("string"), c("date").cast("string"))
    stale = rows.groupBy("security_id").agg(F.sum("same_").alias("n")).filter(c("n") >= repeats)
    stale = stale.agg(F.count("*").alias("affected"), F.min(c("security_id").cast("string")).alias("sample")).select(F.lit("repeated_close").alias("rule"), F.lit("WARNING").alias("severity"), F.lit("price").alias("field"), "affected", "sample")
    return row_rules(rows, rules, key).unionByName(duplicate_keys(df, ["security_id", "date"])).unionByName(stale)


def missing_flag(df: DataFrame, value: str, flag: str, key: str) -> DataFrame:
    return row_rules(df, {"missing_flag": (F.col(flag) == F.col(value).isNotNull(), "ERROR", flag)}, F.col(key).cast("string"))


def finite_values(df: DataFrame, value: str, key: Column) -> DataFrame:
    return row_rules(df, {"finite": (F.col(value).isNotNull() & ~finite(F.col(value)), "ERROR", value)}, key)


def filing_times(df: DataFrame, key: str) -> DataFrame:
    """period_start, period_end, filing_date, available_at, retrieved_at, quality."""
    c = F.col
    return row_rules(df, {
        "start_after_end": (c("period_start") > c("period_end"), "ERROR", "period_start"),
        "filed_before_end": (c("filing_date") < c("period_end"), "ERROR", "filing_date"),
        "available_before_filing": (F.to_date("available_at") < c("filing_date"), "ERROR", "available_at"),
        "retrieved_before_available": (c("retrieved_at") < c("available_at"), "ERROR", "retrieved_at"),
        "unknown_quality": (~c("quality").isin("SOURCE_TIMESTAMP", "INFERRED_DATE_LEVEL"), "ERROR", "quality"),
    }, c(key).cast("string"))


def calendar_coverage(observed: DataFrame, sessions: DataFrame, listings: DataFrame, key: str = "security_id", warn: float = 0.99, fail: float = 0.9) -> DataFrame:
    """Per security: expected sessions in its listing window, observed, ratio, severity, first ten missing dates."""
    expected = interval_join(sessions.select("date"), listings.select(key, "first", "last"), [], "date", "first", "last")
    seen = expected.join(observed.select(key, "date").distinct().withColumn("seen_", F.lit(True)), [key, "date"], "left")
    missing = F.slice(F.array_sort(F.collect_list(F.when(F.col("seen_").isNull(), F.col("date").cast("string")))), 1, 10)
    out = seen.groupBy(key).agg(F.count("*").alias("expected"), F.count("seen_").alias("observed"), missing.alias("missing"))
    ratio_ = F.col("observed") / F.col("expected")
    level = F.when(ratio_ >= warn, "INFO").when(ratio_ >= fail, "WARNING").otherwise("CRITICAL")
    return out.withColumns({"ratio": ratio_, "severity": level, "missing": F.array_join("missing", ",")})


def status_of(findings: DataFrame) -> DataFrame:
    level = F.max(F.when(F.col("affected") == 0, 0).when(F.col("severity") == "CRITICAL", 3).when(F.col("severity") == "ERROR", 2).when(F.col("severity") == "WARNING", 1).otherwise(0))
    return findings.agg(level.alias("l")).select(F.when(F.col("l") == 3, "QUARANTINED").when(F.col("l") == 2, "FAIL").when(F.col("l") == 1, "PASS_WITH_WARNINGS").otherwise("PASS").alias("status"))


def quality_report(df: DataFrame, findings: DataFrame, entity: str, date: str) -> DataFrame:
    """The broken rules in order, each with the table's counts and observed range."""
    facts = df.agg(F.count("*").alias("rows"), F.count_distinct(entity).alias("entities"), F.min(date).alias("first"), F.max(date).alias("last"))
    return failed(findings).crossJoin(F.broadcast(facts)).orderBy("severity", "rule")


def security_master(df: DataFrame) -> DataFrame:
    c = F.col
    rules = {
        "asset_type": (c("asset_type") != "COMMON_STOCK", "ERROR", "asset_type"),
        "primary_only": (~c("primary_listing"), "ERROR", "primary_listing"),
        "currency_missing": (c("currency").isNull(), "ERROR", "currency"),
        "date_order": (c("listing_start") > c("listing_end"), "ERROR", "listing_start"),
        "active_with_end": (c("active") & c("listing_end").isNotNull(), "ERROR", "active"),
    }
    out = row_rules(df, rules, c("security_id").cast("string")).unionByName(duplicate_keys(df, ["security_id"]))
    return out.unionByName(duplicate_keys(df.filter("primary_listing"), ["issuer_id"], "several_primary", "ERROR"))


def overlaps(df: DataFrame, keys: list[str], value: str, start: str = "valid_from", end: str = "valid_to", same: bool = False) -> DataFrame:
    """Rows that overlap an earlier row of the key with another (or, with same, an equal) value.

    A sweep: rows by start, against the furthest end before them, per key or per key and value; no self join.
    """
    far = F.lit("9999-12-31").cast("date")
    stop = F.coalesce(F.col(end), far)
    rows = df.withColumn("stop_", stop)
    before = lambda *k: Window.partitionBy(*k).orderBy(start, "stop_", value).rowsBetween(Window.unboundedPreceding, -1)
    own = F.max("stop_").over(before(*keys, value))
    if same:
        return rows.withColumn("reach_", own).filter(F.col("reach_") >= F.col(start)).drop("stop_", "reach_")
    # The two furthest ends of distinct values before the row: another value overlaps if any other value's end reaches here.
    tops = F.max(F.struct("stop_", value)).over(before(*keys))
    rows = rows.withColumn("top_", tops)
    other = F.max(F.when(F.col("top_")[value] != F.col(value), F.col("top_")["stop_"])).over(before(*keys))
    hit = ((F.col("top_")[value] != F.col(value)) & (F.col("top_")["stop_"] >= F.col(start))) | (other >= F.col(start))
    return rows.withColumn("hit_", hit).filter("hit_").drop("stop_", "top_", "hit_")


def succession(edges: DataFrame) -> DataFrame:
    """edges: predecessor, successor. Nodes with two successors, and nodes on a cycle of any length."""
    several = edges.groupBy("predecessor").agg(F.count_distinct("successor").alias("n")).filter("n > 1").select(F.lit("several_successors").alias("rule"), F.col("predecessor").alias("node"))
    return several.unionByName(cyclic_nodes(edges, "predecessor", "successor").select(F.lit("cycle").alias("rule"), "node"))


def lineage_graph(artifacts: DataFrame, edges: DataFrame, required: DataFrame) -> DataFrame:
    """(rule, artifact) of a lineage graph: artifacts must be unique, edges (child, parent) must join known, different
    artifacts once and form no cycle, and required artifacts must be there."""
    finding = lambda df, rule, c="artifact": df.select(F.lit(rule).alias("rule"), F.col(c).alias("artifact")).distinct()
    ends = edges.select(F.explode(F.array("child", "parent")).alias("artifact")).distinct()
    parts = [
        finding(artifacts.groupBy("artifact").count().filter("count > 1"), "duplicate_artifact"),
        finding(ends.join(artifacts, "artifact", "left_anti"), "unknown_endpoint"),
        finding(edges.filter("child = parent"), "self_edge", "child"),
        finding(edges.groupBy("child", "parent").count().filter("count > 1"), "duplicate_edge", "child"),
        finding(cyclic_nodes(edges.filter("child <> parent"), "child", "parent"), "cycle", "node"),
        finding(required.join(artifacts, "artifact", "left_anti"), "missing_required"),
    ]
    return reduce(DataFrame.unionByName, parts)


def temporal_folds_audit(rows: DataFrame, sessions: DataFrame, embargo: int, date: str = "date", label_end: str = "label_end") -> DataFrame:
    """Per fold, from rows with a role: labels of training end before validation begins, those of validation before the
    test begins, and `embargo` sessions lie between the roles. sessions: date, session (a number without gaps)."""
    span = rows.filter(F.col("role").isin("train", "validation", "test")).groupBy("fold", "role").agg(F.min(date).alias("first"), F.max(date).alias("last"), F.max(label_end).alias("end"))
    at = sessions.select(F.col("date").alias("d_"), "session")
    for c in ("first", "last"):
        span = span.join(at.withColumnRenamed("session", f"{c}_session"), F.col(c) == F.col("d_"), "left").drop("d_")
    of = lambda role, c: F.max(F.when(F.col("role") == role, F.col(c)))
    gap = lambda a, b: (of(b, "first_session") - of(a, "last_session") - 1)
    return span.groupBy("fold").agg(
        F.coalesce(of("train", "end") < of("validation", "first"), F.lit(True)).alias("train_before_validation"),
        F.coalesce(of("validation", "end") < of("test", "first"), F.lit(True)).alias("validation_before_test"),
        F.coalesce((gap("train", "validation") >= embargo) & (gap("validation", "test") >= embargo), F.lit(True)).alias("embargo_kept"),
    )


def benchmark_conflict(df: DataFrame, date: str = "date", benchmark: str = "benchmark_return", tolerance: float = 1e-12) -> DataFrame:
    """Dates on which the benchmark has more than one value: date, values, spread."""
    out = df.groupBy(date).agg(F.count_distinct(benchmark).alias("values"), (F.max(benchmark) - F.min(benchmark)).alias("spread"))
    return out.filter(F.col("spread") > tolerance)


def unit_reconcile(rows: DataFrame, contract: DataFrame, field: str = "field", unit: str = "unit") -> DataFrame:
    """Fields whose units are mixed, or differ from the contract (field, unit), or have no contract."""
    seen = rows.groupBy(field).agg(F.array_sort(F.collect_set(unit)).alias("units"))
    out = seen.join(contract.select(field, F.col(unit).alias("wanted")), field, "full_outer")
    why = F.when(F.col("units").isNull(), "unused").when(F.col("wanted").isNull(), "no_contract").when(F.size("units") > 1, "mixed").when(F.get("units", F.lit(0)) != F.col("wanted"), "differs").otherwise("ok")
    return out.select(field, why.alias("status"))


def market_input(df: DataFrame, id_pattern: str = r"^sec_[a-f0-9]{32}$", largest: float = 10.0) -> DataFrame:
    c = F.col
    key = F.concat_ws("|", c("security_id").cast("string"), c("date").cast("string"))
    returns = ("ret", "market_return", "benchmark_return")
    rules = {
        "key_null": (c("security_id").isNull() | c("date").isNull(), "CRITICAL", "security_id"),
        "id_format": (~c("security_id").cast("string").rlike(id_pattern), "ERROR", "security_id"),
        "available_late": (c("available_at") > end_of_day(c("date")), "CRITICAL", "available_at"),
        "eligible_null": (c("eligible").isNull(), "ERROR", "eligible"),
        "sector_null": (c("sector").isNull(), "ERROR", "sector"),
        "price_negative": (c("price") < 0, "ERROR", "price"),
        "volume_negative": (c("volume") < 0, "ERROR", "volume"),
        "eligible_without_price": (c("eligible") & ~F.coalesce((c("price") > 0) & (c("shares") > 0), F.lit(False)), "ERROR", "price"),
        "high_below_low": (c("high") < c("low"), "ERROR", "high"),
    }
    for r in returns:
        rules[f"{r}_range"] = (c(r).isNotNull() & (~finite(c(r)) | (c(r) <= -1)), "ERROR", r)
        rules[f"{r}_implausible"] = (F.abs(r) > largest, "WARNING", r)
    return row_rules(df, rules, key).unionByName(duplicate_keys(df, ["security_id", "date"]))


def fundamental_input(df: DataFrame) -> DataFrame:
    c = F.col
    rules = {
        "period_after_available": (c("period_end") > F.to_date("available_at"), "ERROR", "period_end"),
        "finite": (~finite(c("value")), "ERROR", "value"),
        "field_null": (c("field").isNull(), "CRITICAL", "field"),
    }
    return row_rules(df, rules, F.concat_ws("|", c("security_id").cast("string"), c("field"))).unionByName(duplicate_keys(df, ["security_id", "available_at", "field"]))


def factor_output(scores: DataFrame, known: list[str], nonnegative: list[str] = [], flags: list[str] = []) -> DataFrame:
    c = F.col
    rules = {
        "unknown_factor": (~c("factor_id").isin(*known), "ERROR", "factor_id"),
        "not_finite": (c("raw").isNotNull() & ~finite(c("raw")), "ERROR", "raw"),
        "derived_without_raw": (c("raw").isNull() & (c("winsorized").isNotNull() | c("normalized").isNotNull()), "ERROR", "raw"),
        "negative": (c("factor_id").isin(*nonnegative or [""]) & (c("raw") < 0), "ERROR", "raw"),
        "not_a_flag": (c("factor_id").isin(*flags or [""]) & ~c("raw").isin(0.0, 1.0), "ERROR", "raw"),
        "missing": (c("raw").isNull(), "WARNING", "raw"),
    }
    key = F.concat_ws("|", c("factor_id"), c("security_id").cast("string"), c("date").cast("string"))
    return row_rules(scores, rules, key).unionByName(duplicate_keys(scores, ["security_id", "date", "factor_id"]))


def portfolio_output(df: DataFrame, q: int = 3) -> DataFrame:
    c = F.col
    rules = {
        "realized_before_formation": (c("date") <= c("formation_date"), "CRITICAL", "date"),
        "count_positive": (c("members") <= 0, "ERROR", "members"),
        "quantile_range": ((c("quantile") < 1) | (c("quantile") > q), "ERROR", "quantile"),
        "return_range": (~finite(c("ret")) | (c("ret") <= -1), "ERROR", "ret"),
    }
    key = F.concat_ws("|", c("factor_id"), c("formation_date").cast("string"), c("quantile").cast("string"))
    return row_rules(df, rules, key).unionByName(duplicate_keys(df, ["formation_date", "date", "factor_id", "quantile"]))


def session_series(df: DataFrame, values: list[str], calendar: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """Dates on which a market-wide value differs between rows, or that the calendar and the rows don't share."""
    spread = reduce(F.greatest, [F.max(v) - F.min(v) for v in values]) if len(values) > 1 else F.max(values[0]) - F.min(values[0])
    by_date = df.groupBy("date").agg(spread.alias("spread"))
    both = by_date.join(calendar.select("date").distinct().withColumn("in_calendar", F.lit(True)), "date", "full_outer")
    why = F.when(F.col("in_calendar").isNull(), "not_a_session").when(F.col("spread").isNull(), "unobserved").when(F.col("spread") > tolerance, "differs")
    return both.withColumn("finding", why).filter("finding IS NOT NULL").select("date", "finding")


def regression_frame(df: DataFrame, keys: list[str], y: str, xs: list[str], least: int) -> DataFrame:
    """Per group: complete cases, constant columns, and whether a fit is allowed (rank is checked where the moments are solved)."""
    whole = reduce(lambda a, b: a & b, [finite(F.col(c)) for c in (y, *xs)])
    rows = df.filter(whole)
    span = {c: (F.max(c) > F.min(c)).alias(f"varies_{c}") for c in (y, *xs)}
    out = rows.groupBy(*keys).agg(F.count("*").alias("cases"), *span.values())
    ok = reduce(lambda a, b: a & b, [F.col(f"varies_{c}") for c in (y, *xs)])
    return out.withColumn("usable", ok & (F.col("cases") >= least))


def breadth(df: DataFrame, date: str, member: str, least: int) -> DataFrame:
    per = df.groupBy(date).agg(F.count_distinct(member).alias("n"))
    return per.agg(F.max("n").alias("widest"), (F.max("n") >= least).alias("passes"))


def identity_authority(rows: DataFrame, resolved: str, own: str) -> DataFrame:
    """Rows whose id isn't the one the mapping resolves; and whether mapped and unmapped rows are mixed."""
    bad = ~F.col(own).eqNullSafe(F.col(resolved))
    return rows.agg(F.count_if(bad).alias("mismatched"), ((F.count_if(F.col(resolved).isNull()) > 0) & (F.count(resolved) > 0)).alias("mixed"))
