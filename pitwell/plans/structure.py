"""Queries of the joins, aggregates, checks and lineage operators (B, C, D, M)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitwell.operators import aggregates as A
from pitwell.operators import checks as B
from pitwell.operators import joins as J
from pitwell.operators import lineage as M
from pitwell.operators import windows as W
from pitwell.plans.features import ASOF, SCORES, forward_frame, rounded, scores, wide_panel
from pitwell.plans.portfolio import FORMED, formed, held
from pitwell.plans.registry import query, register
from pitwell.plans.tables import Tables

# C


@query("c01_pit_asof_panel", """SELECT a.security_id, a.date, round(book_equity, 2) AS book_equity, round(net_income, 2) AS net_income, (SELECT max(available_at) FROM fundamentals f WHERE f.security_id = a.security_id AND f.field IN ('book_equity', 'net_income') AND f.available_at <= a.date) AS evidence_at FROM asof_ a""", ASOF)
def c01(t: Tables) -> DataFrame:
    return J.pit_asof_panel(t.panel_m, t.fundamentals, ["book_equity", "net_income"]).select("security_id", "date", F.round("book_equity", 2).alias("book_equity"), F.round("net_income", 2).alias("net_income"), "evidence_at")


@query("c02_pit_shares_asof", "SELECT p.security_id, p.date, f.value FROM panel_m p ASOF LEFT JOIN (SELECT * FROM fundamentals WHERE field = 'revenue') f ON p.security_id = f.security_id AND p.date >= f.available_at")
def c02(t: Tables) -> DataFrame:
    facts = t.fundamentals.filter("field = 'revenue'").select("security_id", "available_at", "value")
    return J.asof_single(t.panel_m.select("security_id", "date"), facts, ["security_id"], "date", "available_at", "value", strict=True).select("security_id", "date", "value")


LOOKUP = """SELECT o_custkey AS source_id, o_orderdate::DATE AS at, count(DISTINCT m.security_id) AS n_ids, CASE WHEN count(DISTINCT m.security_id) = 1 THEN min(m.security_id) END AS security_id
 FROM (SELECT DISTINCT o_custkey, o_orderdate FROM orders) o LEFT JOIN mapping m ON o_custkey = source_id AND o_orderdate::DATE >= valid_from AND (valid_to IS NULL OR o_orderdate::DATE <= valid_to) GROUP BY 1, 2"""


def asked(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_custkey").alias("source_id"), F.to_date("o_orderdate").alias("at")).distinct()


@query("c03_effective_dated_lookup", LOOKUP)
def c03(t: Tables) -> DataFrame:
    return J.effective_id(asked(t), t.mapping, "source_id", "at").select("source_id", "at", "n_ids", "security_id")


@query("c04_issuer_to_listings", """WITH f AS (SELECT o.source_id, o.at, m.security_id, m.status FROM (SELECT DISTINCT o_custkey AS source_id, o_orderdate::DATE AS at FROM orders) o JOIN mapping m ON o.source_id = m.source_id AND o.at >= valid_from AND (valid_to IS NULL OR o.at <= valid_to))
SELECT f.source_id, f.at, f.security_id, bool_or(f.status <> 'F') OVER (PARTITION BY f.source_id, f.at) AS has_unresolved FROM f""")
def c04(t: Tables) -> DataFrame:
    return J.issuer_listings(asked(t), t.mapping, "source_id", "at", resolved="F").select("source_id", "at", "security_id", "has_unresolved")


@query("c05_issuer_successor", "SELECT m.source_id, m.valid_from AS at, CASE WHEN count(DISTINCT s.o_orderkey) = 1 THEN min(s.o_orderkey) END AS successor FROM mapping m LEFT JOIN orders s ON s.o_custkey = m.source_id AND s.o_orderdate::DATE <= m.valid_from AND s.o_orderpriority = '1-URGENT' GROUP BY m.source_id, m.security_id, m.valid_from")
def c05(t: Tables) -> DataFrame:
    s = t.orders.filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("source_id"), F.col("o_orderkey").alias("successor"), F.to_date("o_orderdate").alias("effective"))
    return J.successor_at(t.mapping.select("source_id", F.col("valid_from").alias("at")), s, "source_id", "at").select("source_id", "at", "successor")


@query("c06_holding_interval_join", 'SELECT security_id, date, start, "end", round(ret, 8) AS ret FROM panel_m JOIN intervals ON date > start AND date <= "end"')
def c06(t: Tables) -> DataFrame:
    return J.holding_rows(t.panel_m.select("security_id", "date", "ret"), t.intervals).select("security_id", "date", "start", "end", F.round("ret", 8).alias("ret"))


@query("c07_checked_equi_join", "SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def c07(t: Tables) -> DataFrame:
    o = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return J.checked_join(t.lineitem.select("l_orderkey", "l_linenumber"), o, ["l_orderkey"])


@query("c08_reconcile_outer_join", """WITH a AS (SELECT o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_orderkey % 3 <> 0), b AS (SELECT o_orderkey AS k, o_totalprice + o_orderkey % 2 AS v FROM orders WHERE o_orderkey % 5 <> 0)
SELECT CASE WHEN a.k IS NULL THEN 'right_only' WHEN b.k IS NULL THEN 'left_only' ELSE 'both' END AS side, count(*) AS rows, round(max(abs(a.v - b.v)), 6) AS max_diff FROM a FULL JOIN b USING (k) GROUP BY 1""")
def c08(t: Tables) -> DataFrame:
    k = t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    out = J.reconcile(k.filter("k % 3 <> 0"), k.filter("k % 5 <> 0").withColumn("v", F.col("v") + F.col("k") % 2), ["k"], ["v"])
    return out.groupBy("side").agg(F.count("*").alias("rows"), F.round(F.max("diff_v"), 6).alias("max_diff"))


register("c09_anti_join_losses", lambda t: J.anti(t.panel_m.select("security_id", "date"), forward_frame(t).filter("fwd IS NOT NULL").select("security_id", "date"), ["security_id", "date"]),
         """WITH s AS (SELECT date, dense_rank() OVER (ORDER BY date) AS k FROM (SELECT DISTINCT date FROM panel_m)), f AS (SELECT security_id, date, lead(k, 3) OVER w = k + 3 AND count(ret) OVER n = 3 AS ok FROM panel_m JOIN s USING (date) WINDOW w AS (PARTITION BY security_id ORDER BY date), n AS (PARTITION BY security_id ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)) SELECT security_id, date FROM f WHERE ok IS NOT TRUE""")  # fmt: skip
register("c10_membership_semi_join", lambda t: J.semi(t.orders, t.customer.filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey")), ["o_custkey"]).select("o_orderkey", "o_custkey"), "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")


@query("c11_endpoint_gather", 'SELECT s.security_id, start AS entry, "end" AS exit, round(b.price / a.price - 1, 8) AS path_return FROM intervals JOIN (SELECT DISTINCT security_id FROM panel_m) s ON true LEFT JOIN panel_m a ON a.security_id = s.security_id AND a.date = start LEFT JOIN panel_m b ON b.security_id = s.security_id AND b.date = "end"')
def c11(t: Tables) -> DataFrame:
    names = t.panel_m.select("security_id").distinct()
    # One row holds the intervals, a few for each year, and is made rows again beside each name.
    listed = t.intervals.agg(F.collect_list(F.struct(F.col("start").alias("entry"), F.col("end").alias("exit"))).alias("iv"))
    iv = names.crossJoin(F.broadcast(listed)).select("security_id", F.inline("iv"))
    return J.endpoint_return(iv, t.panel_m, "security_id").select("security_id", "entry", "exit", F.round("path_return", 8).alias("path_return"))


@query("c12_breakpoint_broadcast", "SELECT security_id, date, CASE WHEN price * shares <= bp_low THEN 'small' WHEN price * shares >= bp_high THEN 'large' ELSE 'mid' END AS size FROM panel_m JOIN bps_ USING (date)", ASOF)
def c12(t: Tables) -> DataFrame:
    from pitwell.operators.characteristics import size_breakpoints

    cap = F.col("price") * F.col("shares")
    out = t.panel_m.join(F.broadcast(size_breakpoints(t.panel_m, "XNYS")), "date")
    return out.select("security_id", "date", F.when(cap <= F.col("bp_low"), "small").when(cap >= F.col("bp_high"), "large").otherwise("mid").alias("size"))


@query("c13_exact_symbol_binding", f"SELECT l.source_id, l.at, l.security_id FROM ({LOOKUP}) l WHERE l.security_id IS NOT NULL")
def c13(t: Tables) -> DataFrame:
    return c03(t).filter("security_id IS NOT NULL").select("source_id", "at", "security_id")


@query("c14_pairwise_self_join", "SELECT a.security_id AS a, b.security_id AS b, count(*) AS n, round(max(abs(a.ret - b.ret)), 8) AS max_diff, round(corr(a.ret, b.ret), 6) AS corr FROM panel_m a JOIN panel_m b ON a.date = b.date AND a.security_id < b.security_id WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2")
def c14(t: Tables) -> DataFrame:
    return J.block_pairs(t.panel_m, "security_id", "date", "ret").select("a", "b", "n", F.round("max_diff", 8).alias("max_diff"), F.round("corr", 6).alias("corr"))


@query("c15_constituent_overlap", "WITH m AS (SELECT date, security_id, 1.0::DOUBLE AS w FROM q_ WHERE factor_id = 'market_cap' AND quantile = 3), l AS (SELECT DISTINCT factor_id, security_id FROM q_ WHERE factor_id <> 'market_cap' AND quantile = 1), s AS (SELECT DISTINCT factor_id FROM l) SELECT date, s.factor_id AS signal, round(avg((l.security_id IS NOT NULL)::INT), 6) AS count_share FROM m, s LEFT JOIN l ON l.factor_id = s.factor_id AND l.security_id = m.security_id GROUP BY 1, 2", FORMED)
def c15(t: Tables) -> DataFrame:
    q = formed(t)
    members = q.filter("factor_id = 'market_cap' AND quantile = 3").select("date", "security_id", F.lit(1.0).alias("weight"))
    return J.constituent_overlap(members, q.filter("factor_id <> 'market_cap' AND quantile = 1"), ["date"]).select("date", "signal", F.round("count_share", 6).alias("count_share"))


LEGS = "l AS (SELECT factor_id, date, quantile, security_id, cap, next_ret FROM q_ JOIN next_ USING (security_id, date) WHERE next_ret IS NOT NULL), x AS (SELECT date, security_id FROM q_ WHERE factor_id = 'turnover' AND quantile = 3)"


@query("c16_leg_exclusion_spread", f"WITH {LEGS}, k AS (SELECT factor_id, date, quantile, sum(cap * next_ret) / sum(cap) AS r FROM l ANTI JOIN x USING (date, security_id) GROUP BY 1, 2, 3) SELECT factor_id, date, round(max(r) FILTER (quantile = 3) - max(r) FILTER (quantile = 1), 6) AS spread FROM k GROUP BY 1, 2", FORMED)
def c16(t: Tables) -> DataFrame:
    w = Window.partitionBy("security_id").orderBy("date")
    nxt = t.panel.select("security_id", "date", (F.col("price") * F.col("shares")).alias("weight"), F.lead("ret").over(w).alias("ret"))
    legs = formed(t).join(nxt, ["security_id", "date"]).filter("ret IS NOT NULL")
    out = formed(t).filter("factor_id = 'turnover' AND quantile = 3").select("date", "security_id")
    return J.spread_without(legs, out, ["factor_id", "date"]).select("factor_id", "date", F.round("spread", 6).alias("spread"))


@query("c17_prediction_equivalence", "WITH r AS (SELECT grp AS fold, doc_id, p AS x, p * 2 AS y FROM scored) SELECT fold, round(max(abs(x - y)), 9) AS max_diff, true AS same_ranks, round(corr(x, y), 6) AS corr FROM r GROUP BY 1")
def c17(t: Tables) -> DataFrame:
    a = t.scored.select(F.col("grp").alias("fold"), "doc_id", F.col("p").alias("prediction"))
    out = J.prediction_equivalence(a, a.withColumn("prediction", F.col("prediction") * 2), ["doc_id"], "fold")
    return out.select("fold", F.round("max_diff", 9).alias("max_diff"), "same_ranks", F.round("corr", 6).alias("corr"))


# D. Orders stand for filings (filing = order), line items for facts (concept = return flag and status).

FACTS = {"facts_": "SELECT l_orderkey AS filing, l_returnflag || l_linestatus AS concept, l_shipdate::DATE AS period_end, l_extendedprice AS value FROM lineitem",
         "prec_": "SELECT * FROM (VALUES ('flow', 'AF', 1), ('flow', 'RF', 2), ('stock', 'NO', 1), ('stock', 'NF', 2), ('stock', 'AO', 3)) v(field, concept, rank)"}


def facts(t: Tables) -> DataFrame:
    return t.lineitem.select(F.col("l_orderkey").alias("filing"), F.concat("l_returnflag", "l_linestatus").alias("concept"), F.to_date("l_shipdate").alias("period_end"), F.col("l_extendedprice").alias("value"))


def precedence(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([("flow", "AF", 1), ("flow", "RF", 2), ("stock", "NO", 1), ("stock", "NF", 2), ("stock", "AO", 3)], "field string, concept string, rank int")


ANNUAL = """WITH m AS (SELECT *, max(period_end) OVER (PARTITION BY filing) AS m FROM facts_), r AS (SELECT *, min(rank) OVER (PARTITION BY filing, field) AS best FROM m JOIN prec_ USING (concept) WHERE period_end = m), p AS (SELECT filing, field, min(concept) AS concept, min(value) AS value, count(DISTINCT value) > 1 AS conflict FROM r WHERE rank = best GROUP BY 1, 2) """


@query("d01_annual_fact_projection", ANNUAL + "SELECT * FROM p", FACTS)
def d01(t: Tables) -> DataFrame:
    return A.annual_facts(facts(t), precedence(t), ["filing"]).select("filing", "field", "concept", "value", "conflict")


@query("d02_same_filing_derivations", ANNUAL + "SELECT filing, max(value) FILTER (field = 'flow') AS flow, max(value) FILTER (field = 'stock') AS stock, round(max(value) FILTER (field = 'flow') - max(value) FILTER (field = 'stock'), 2) AS accruals FROM p GROUP BY 1", FACTS)
def d02(t: Tables) -> DataFrame:
    fields = A.annual_facts(facts(t), precedence(t), ["filing"])
    return A.derived_fields(fields, ["filing"], ["flow", "stock"], {"accruals": F.round(F.col("flow") - F.col("stock"), 2)})


YEARS = {"y_": "SELECT o_custkey, year(o_orderdate) AS period, max(o_orderdate::DATE) AS available, max(o_totalprice) AS v FROM orders GROUP BY 1, 2"}


@query("d03_prior_year_lags", "SELECT a.o_custkey, a.period, a.v, (SELECT max_by(b.v, b.period) FROM y_ b WHERE b.o_custkey = a.o_custkey AND b.period < a.period AND b.available <= a.available) AS prior_v FROM y_ a", YEARS)
def d03(t: Tables) -> DataFrame:
    y = t.orders.groupBy("o_custkey", F.year("o_orderdate").cast("long").alias("period")).agg(F.max(F.to_date("o_orderdate")).alias("available"), F.max("o_totalprice").alias("v"))
    return A.prior_value(y, ["o_custkey"], "period", "available", "v").select("o_custkey", "period", "v", "prior_v")


@query("d04_shares_projection", "WITH m AS (SELECT *, max(o_orderdate::DATE) OVER (PARTITION BY o_custkey) AS m FROM orders) SELECT o_custkey, max(o_orderdate::DATE) AS period, min(o_totalprice) AS value, count(DISTINCT o_totalprice) = 1 AND min(o_totalprice) > 0 AS valid FROM m WHERE o_orderdate::DATE = m GROUP BY 1")
def d04(t: Tables) -> DataFrame:
    return A.unique_latest(t.orders.select("o_custkey", F.to_date("o_orderdate").alias("period"), F.col("o_totalprice").alias("value")), ["o_custkey"], "period", "value")


@query("d05_legacy_shares_translate", "SELECT p_partkey, TRY_CAST(p_size AS DECIMAL(38, 10))::DOUBLE AS shares FROM part WHERE string_split('xbrli:' || CASE WHEN p_partkey % 2 = 0 THEN 'shares' ELSE 'usd' END, ':')[-1] = 'shares' AND p_size > 0")
def d05(t: Tables) -> DataFrame:
    unit = F.concat(F.lit("xbrli:"), F.when(F.col("p_partkey") % 2 == 0, "shares").otherwise("usd"))
    rows = t.part.withColumn("unit", unit).filter("substring_index(unit, ':', -1) = 'shares'")
    return rows.select("p_partkey", F.expr("cast(try_cast(p_size AS DECIMAL(38, 10)) AS DOUBLE)").alias("shares")).filter("shares > 0")


@query("d06_listing_triples", "SELECT user_id, dt, min(v) FILTER (event_type = 'signup') AS signup, min(v) FILTER (event_type = 'purchase') AS purchase FROM (SELECT user_id, ts::DATE AS dt, event_type, props AS v FROM events) GROUP BY 1, 2 HAVING count(DISTINCT v) FILTER (event_type = 'signup') = 1 AND count(DISTINCT v) FILTER (event_type = 'purchase') = 1")
def d06(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", F.to_date("ts").alias("dt"), "event_type", F.col("props").alias("v"))
    return A.unique_per_group(rows, ["user_id", "dt"], "event_type", "v", ["signup", "purchase"])


@query("d07_legacy_ticker_sets", "SELECT c_custkey, array_to_string(list_sort(list_distinct(list_transform(string_split(upper(c_name || ', ' || c_mktsegment || ',' || c_name), ','), lambda x: trim(x)))), '|') AS tickers FROM customer")
def d07(t: Tables) -> DataFrame:
    from pitwell.functions.scalar import ticker_set

    text = F.concat_ws(",", "c_name", F.concat(F.lit(" "), F.col("c_mktsegment")), "c_name")
    return t.customer.select("c_custkey", F.array_join(ticker_set(text), "|").alias("tickers"))


register("d08_compound_return", lambda t: rounded(t.panel_m.groupBy("security_id", F.year("date").cast("long").alias("year")).agg(W.compound(F.col("ret")).alias("v")), ["security_id", "year"], value=F.col("v")), "SELECT security_id, year(date) AS year, round(CASE WHEN count(ret) = count(*) THEN product(1 + ret) - 1 END, 6) AS value FROM panel_m GROUP BY 1, 2")
register("d11_coverage_estimability", lambda t: A.factor_coverage(scores(t)).select("factor_id", "observed", "total", F.round("coverage", 6).alias("coverage"), "status"), "SELECT factor_id, count(raw) AS observed, count(*) AS total, round(count(raw) / count(*), 6) AS coverage, CASE WHEN count(raw) = 0 THEN 'UNAVAILABLE' WHEN count(raw) < count(*) THEN 'PARTIAL' ELSE 'COMPLETE' END AS status FROM scores_ GROUP BY 1", SCORES)
register("d12_winsorized_outliers", lambda t: A.factor_coverage(scores(t)).select("factor_id", "clipped"), "SELECT factor_id, count(*) FILTER (raw <> winsorized) AS clipped FROM scores_ GROUP BY 1", SCORES)
register("d13_pairwise_correlations", lambda t: A.factor_correlations(scores(t)).select("a", "b", "n", F.round("corr", 6).alias("corr")), "SELECT a.factor_id AS a, b.factor_id AS b, count(*) AS n, round(corr(a.raw, b.raw), 6) AS corr FROM scores_ a JOIN scores_ b USING (security_id, date) WHERE a.factor_id < b.factor_id AND a.raw IS NOT NULL AND b.raw IS NOT NULL GROUP BY 1, 2", SCORES)
register("d18_long_to_wide", lambda t: scores(t).groupBy("security_id", "date").pivot("factor_id", ["market_cap", "momentum_1m", "turnover"]).agg(F.first("score")).dropna().select("security_id", "date", *(F.round(c, 5).alias(c) for c in ("market_cap", "momentum_1m", "turnover"))), "SELECT * FROM (SELECT security_id, date, round(max(score) FILTER (factor_id = 'market_cap'), 5) AS market_cap, round(max(score) FILTER (factor_id = 'momentum_1m'), 5) AS momentum_1m, round(max(score) FILTER (factor_id = 'turnover'), 5) AS turnover FROM score1_ GROUP BY 1, 2) WHERE market_cap IS NOT NULL AND momentum_1m IS NOT NULL AND turnover IS NOT NULL", FORMED)


@query("d20_dataset_profile", 'SELECT count(*) AS rows, 11 AS columns, count(DISTINCT security_id) AS securities, count(DISTINCT date) AS dates, min(date) AS first, max(date) AS last, count(*) FILTER (ret IS NULL) AS null_ret FROM panel_m')
def d20(t: Tables) -> DataFrame:
    return A.profile(t.panel_m, "security_id", "date").select("rows", "columns", "securities", "dates", "first", "last", "null_ret")


@query("d21_fold_metric_stability", "WITH f AS (SELECT grp, avg(p) AS bias, avg(abs(y - p)) AS mae FROM scored GROUP BY 1), l AS (SELECT 'bias' AS metric, bias AS value FROM f UNION ALL SELECT 'mae', mae FROM f) SELECT metric, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS sd, round(min(value), 6) AS low, round(max(value), 6) AS high FROM l GROUP BY 1")
def d21(t: Tables) -> DataFrame:
    f = t.scored.groupBy("grp").agg(F.avg("p").alias("bias"), F.avg(F.abs(F.col("y") - F.col("p"))).alias("mae"))
    return rounded(A.metric_stability(f, "grp"), ["metric"], mean=F.col("mean"), sd=F.col("sd"), low=F.col("low"), high=F.col("high"))


@query("d22_missing_sessions", "SELECT s.security_id, d.date FROM (SELECT DISTINCT security_id FROM panel_m) s, (SELECT DISTINCT date FROM panel_m) d WHERE NOT EXISTS (SELECT 1 FROM panel_m p WHERE p.security_id = s.security_id AND p.date = d.date)")
def d22(t: Tables) -> DataFrame:
    return W.missing_sessions(t.panel_m, "security_id")


register("d24_month_gap_count", lambda t: A.month_gaps(t.panel_m, ["security_id"], "date"), "SELECT security_id, count(*) FILTER (m - lag <> 1) AS gaps FROM (SELECT security_id, year(date) * 12 + month(date) AS m, lag(year(date) * 12 + month(date)) OVER (PARTITION BY security_id ORDER BY date) AS lag FROM panel_m) GROUP BY 1")


@query("d26_paired_leave_one_out", "WITH l AS (SELECT *, (sum(ret) OVER (PARTITION BY security_id) - ret) / nullif(count(ret) OVER (PARTITION BY security_id) - 1, 0) AS loo FROM panel_m WHERE ret IS NOT NULL) SELECT security_id, round(avg(ret), 6) AS mean, round(median(ret), 6) AS median, round(min(loo), 6) AS loo_min, round(max(loo), 6) AS loo_max FROM l GROUP BY 1")
def d26(t: Tables) -> DataFrame:
    out = A.leave_one_out(t.panel_m.filter("ret IS NOT NULL"), ["security_id"], "ret")
    return rounded(out, ["security_id"], **{c: F.col(c) for c in ("mean", "median", "loo_min", "loo_max")})


# B


def findings_of(f: DataFrame) -> DataFrame:
    return f.select("rule", "severity", "field", F.col("affected").cast("long").alias("affected"))


def counts_sql(source: str, rules: list[tuple[str, str, str, str]], keys: str | None = None) -> str:
    parts = [f"SELECT '{n}' AS rule, '{s}' AS severity, '{f}' AS field, count(*) FILTER ({c}) AS affected FROM {source}" for n, s, f, c in rules]
    if keys:
        parts.append(f"SELECT 'duplicate_key', 'CRITICAL', '{keys}', coalesce(sum(n), 0)::BIGINT FROM (SELECT count(*) AS n FROM {source} GROUP BY {keys} HAVING count(*) > 1)")
    return " UNION ALL ".join(parts)


register("b01_table_contract", lambda t: findings_of(B.table_contract(t.panel_m, ["security_id", "date"], ["price", "ret"])),
         counts_sql("panel_m", [("null_price", "CRITICAL", "price", "price IS NULL"), ("null_ret", "CRITICAL", "ret", "ret IS NULL")], "security_id,date") + " UNION ALL SELECT 'empty', 'CRITICAL', '*', (count(*) = 0)::BIGINT FROM panel_m")
register("b02_daily_market_rules", lambda t: findings_of(B.daily_market(t.panel_d)),
         counts_sql("(SELECT *, price / lag(price) OVER (PARTITION BY security_id ORDER BY date) - 1 AS move FROM panel_d)", [("invalid_date", "CRITICAL", "date", "date IS NULL"), ("price_positive", "CRITICAL", "price", "price <= 0"), ("high_below_low", "CRITICAL", "high", "high < low"), ("close_outside_range", "CRITICAL", "price", "price > high OR price < low"), ("negative_volume", "CRITICAL", "volume", "volume < 0"), ("abnormal_move", "WARNING", "price", "abs(move) > 0.5")])
         + " UNION ALL SELECT 'duplicate_key', 'CRITICAL', 'security_id,date', coalesce(sum(n), 0)::BIGINT FROM (SELECT count(*) AS n FROM panel_d GROUP BY security_id, date HAVING count(*) > 1) UNION ALL SELECT 'repeated_close', 'WARNING', 'price', count(*) FROM (SELECT security_id FROM (SELECT security_id, price = lag(price) OVER (PARTITION BY security_id ORDER BY date) AS same FROM panel_d) GROUP BY 1 HAVING count(*) FILTER (same) >= 5)")
register("b03_macro_missingness", lambda t: findings_of(B.missing_flag(t.panel_m.withColumn("missing", F.col("ret").isNull() | (F.col("security_id") % 7 == 0)), "ret", "missing", "security_id")), "SELECT 'missing_flag' AS rule, 'ERROR' AS severity, 'missing' AS field, count(*) FILTER ((ret IS NULL OR security_id % 7 = 0) = (ret IS NOT NULL)) AS affected FROM panel_m")
register("b04_finite_factor_values", lambda t: findings_of(B.finite_values(scores(t).withColumn("raw", F.when(F.col("security_id") % 11 == 0, F.lit(float("inf"))).otherwise(F.col("raw"))), "raw", F.col("factor_id"))), "SELECT 'finite' AS rule, 'ERROR' AS severity, 'raw' AS field, count(*) FILTER (security_id % 11 = 0) AS affected FROM scores_", SCORES)


@query("b05_filing_temporal_rules", counts_sql("(SELECT l_shipdate::DATE AS s, o_orderdate::DATE AS e, o_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey)", [("start_after_end", "ERROR", "period_start", "s > e"), ("filed_before_end", "ERROR", "filing_date", "e + l_linenumber::INT - 2 < e"), ("available_before_filing", "ERROR", "available_at", "e < e + l_linenumber::INT - 2"), ("retrieved_before_available", "ERROR", "retrieved_at", "false"), ("unknown_quality", "ERROR", "quality", "o_orderkey % 10 = 0")]))
def b05(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    end = F.to_date("o_orderdate")
    rows = rows.select("o_orderkey", F.to_date("l_shipdate").alias("period_start"), end.alias("period_end"), F.date_add(end, F.col("l_linenumber") - 2).alias("filing_date"), end.cast("timestamp").alias("available_at"), end.cast("timestamp").alias("retrieved_at"), F.when(F.col("o_orderkey") % 10 == 0, "GUESS").otherwise("SOURCE_TIMESTAMP").alias("quality"))
    return findings_of(B.filing_times(rows, "o_orderkey"))


COVER = "WITH l AS (SELECT security_id, min(date) AS first, max(date) AS last FROM panel_d GROUP BY 1), e AS (SELECT l.security_id, d.date, p.date AS seen FROM l JOIN (SELECT DISTINCT date FROM panel_d) d ON d.date BETWEEN first AND last LEFT JOIN panel_d p ON p.security_id = l.security_id AND p.date = d.date) SELECT security_id, count(*) AS expected, count(seen) AS observed, round(count(seen) / count(*), 6) AS ratio, CASE WHEN count(seen) / count(*) >= 0.99 THEN 'INFO' WHEN count(seen) / count(*) >= 0.9 THEN 'WARNING' ELSE 'CRITICAL' END AS severity, coalesce(array_to_string(list_slice(list_sort(list(date::VARCHAR) FILTER (seen IS NULL)), 1, 10), ','), '') AS missing FROM e GROUP BY 1"


@query("b06_calendar_coverage", COVER)
def b06(t: Tables) -> DataFrame:
    listing = t.panel_d.groupBy("security_id").agg(F.min("date").alias("first"), F.max("date").alias("last"))
    out = B.calendar_coverage(t.panel_d, t.panel_d.select("date").distinct(), listing)
    return out.select("security_id", "expected", "observed", F.round("ratio", 6).alias("ratio"), "severity", "missing")


register("b07_status_rollup", lambda t: B.status_of(B.daily_market(t.panel_d)), "SELECT CASE WHEN count(*) FILTER (price > high OR price < low OR high < low) > 0 THEN 'QUARANTINED' WHEN count(*) FILTER (abs(move) > 0.5) > 0 THEN 'PASS_WITH_WARNINGS' ELSE 'PASS' END AS status FROM (SELECT *, price / lag(price) OVER (PARTITION BY security_id ORDER BY date) - 1 AS move FROM panel_d)")
register("b08_quality_report", lambda t: B.quality_report(t.panel_m, B.table_contract(t.panel_m, ["security_id", "date"], ["price", "ret"]), "security_id", "date").select("rule", "severity", F.col("affected").cast("long").alias("affected"), "rows", "entities", "first", "last"), "SELECT 'null_ret' AS rule, 'CRITICAL' AS severity, count(*) FILTER (ret IS NULL) AS affected, count(*) AS rows, count(DISTINCT security_id) AS entities, min(date) AS first, max(date) AS last FROM panel_m")
MASTER = "(SELECT s_suppkey AS security_id, s_nationkey AS issuer_id, CASE WHEN s_suppkey % 9 = 0 THEN 'ETF' ELSE 'COMMON_STOCK' END AS asset_type, s_suppkey % 5 <> 0 AS primary_listing, CASE WHEN s_suppkey % 8 = 0 THEN NULL ELSE 'USD' END AS currency, s_suppkey % 4 = 0 AS active FROM supplier)"


@query("b09_security_master_rules", counts_sql(MASTER, [("asset_type", "ERROR", "asset_type", "asset_type <> 'COMMON_STOCK'"), ("primary_only", "ERROR", "primary_listing", "NOT primary_listing"), ("currency_missing", "ERROR", "currency", "currency IS NULL"), ("date_order", "ERROR", "listing_start", "false"), ("active_with_end", "ERROR", "active", "active")], None) + f" UNION ALL SELECT 'duplicate_key', 'CRITICAL', 'security_id', 0 UNION ALL SELECT 'several_primary', 'ERROR', 'issuer_id', coalesce(sum(n), 0)::BIGINT FROM (SELECT count(*) AS n FROM {MASTER} WHERE primary_listing GROUP BY issuer_id HAVING count(*) > 1)")
def b09(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    m = t.supplier.select(k.alias("security_id"), F.col("s_nationkey").alias("issuer_id"), F.when(k % 9 == 0, "ETF").otherwise("COMMON_STOCK").alias("asset_type"), (k % 5 != 0).alias("primary_listing"), F.when(k % 8 != 0, "USD").alias("currency"), (k % 4 == 0).alias("active"), F.lit("1990-01-01").cast("date").alias("listing_start"), F.lit("2030-01-01").cast("date").alias("listing_end"))
    return findings_of(B.security_master(m))


WIDE_MAP = {"wmap_": "SELECT source_id, security_id % 3 AS security_id, valid_from, (valid_from + INTERVAL 200 DAY)::DATE AS valid_to FROM mapping"}


def wide_map(t: Tables) -> DataFrame:
    return t.mapping.select("source_id", (F.col("security_id") % 3).alias("security_id"), "valid_from", F.date_add("valid_from", 200).alias("valid_to"))


BEFORE = "(o.valid_from, o.valid_to, o.security_id) < (m.valid_from, m.valid_to, m.security_id)"


@query("b10_mapping_overlap_conflicts", f"SELECT count(*) AS conflicts FROM wmap_ m WHERE EXISTS (SELECT 1 FROM wmap_ o WHERE o.source_id = m.source_id AND o.security_id <> m.security_id AND {BEFORE} AND o.valid_to >= m.valid_from)", WIDE_MAP)
def b10(t: Tables) -> DataFrame:
    return B.overlaps(wide_map(t), ["source_id"], "security_id").agg(F.count("*").alias("conflicts"))


@query("b11_symbol_history_conflicts", f"SELECT (SELECT count(*) FROM wmap_ m WHERE EXISTS (SELECT 1 FROM wmap_ o WHERE o.source_id = m.source_id AND o.security_id <> m.security_id AND {BEFORE} AND o.valid_to >= m.valid_from)) AS by_listing, (SELECT count(*) FROM wmap_ m WHERE EXISTS (SELECT 1 FROM wmap_ o WHERE o.security_id = m.security_id AND o.source_id <> m.source_id AND (o.valid_from, o.valid_to, o.source_id) < (m.valid_from, m.valid_to, m.source_id) AND o.valid_to >= m.valid_from)) AS by_ticker", WIDE_MAP)
def b11(t: Tables) -> DataFrame:
    a = B.overlaps(wide_map(t), ["source_id"], "security_id").agg(F.count("*").alias("by_listing"))
    return a.crossJoin(B.overlaps(wide_map(t), ["security_id"], "source_id").agg(F.count("*").alias("by_ticker")))


@query("b12_issuer_listing_duplicates", "SELECT count(*) AS duplicates FROM (SELECT valid_from, max(valid_to) OVER (PARTITION BY source_id, security_id ORDER BY valid_from, valid_to ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM wmap_) WHERE reach >= valid_from", WIDE_MAP)
def b12(t: Tables) -> DataFrame:
    return B.overlaps(wide_map(t), ["source_id"], "security_id", same=True).agg(F.count("*").alias("duplicates"))




def edges(t: Tables) -> DataFrame:
    rows = t.supplier.join(F.broadcast(t.nation), F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.select(F.col("n_nationkey").cast("long").alias("predecessor"), ((F.col("n_nationkey") * 7 + F.col("s_suppkey") % 2) % 25).cast("long").alias("successor")).distinct()


EDGE_TEXT = "SELECT DISTINCT n_nationkey::BIGINT AS predecessor, ((n_nationkey * 7 + s_suppkey % 2) % 25)::BIGINT AS successor FROM nation JOIN supplier ON s_nationkey = n_nationkey"
RECURSIVE = f"WITH RECURSIVE edges_ AS ({EDGE_TEXT}), r AS (SELECT predecessor, successor FROM edges_ UNION SELECT r.predecessor, e.successor FROM r JOIN edges_ e ON r.successor = e.predecessor) "
register("b13_succession_graph_check", lambda t: B.succession(edges(t)), RECURSIVE + "SELECT 'several_successors' AS rule, predecessor AS node FROM edges_ GROUP BY 2 HAVING count(DISTINCT successor) > 1 UNION ALL SELECT 'cycle', predecessor FROM r WHERE predecessor = successor")
register("m01_lineage_ancestors", lambda t: M.ancestors(edges(t).select(F.col("predecessor").alias("child"), F.col("successor").alias("parent"))), RECURSIVE + "SELECT predecessor AS artifact, successor AS ancestor FROM r")


ARTIFACTS = "SELECT n_nationkey::BIGINT AS artifact FROM nation WHERE n_nationkey <> 24 UNION ALL SELECT r_regionkey::BIGINT FROM region WHERE r_regionkey < 2"
FLOWS = "SELECT s_nationkey::BIGINT AS child, ((s_nationkey * 7 + s_suppkey % 2) % 25)::BIGINT AS parent FROM supplier"
NEEDED = "SELECT DISTINCT p_size::BIGINT AS artifact FROM part WHERE p_size <= 30"


@query("b25_lineage_graph_check", f"""WITH RECURSIVE art AS ({ARTIFACTS}), e AS ({FLOWS}), d AS (SELECT DISTINCT child, parent FROM e WHERE child <> parent), r AS (SELECT child, parent FROM d UNION SELECT r.child, d.parent FROM r JOIN d ON r.parent = d.child), ends AS (SELECT child AS artifact FROM e UNION SELECT parent FROM e)
SELECT 'duplicate_artifact' AS rule, artifact FROM art GROUP BY 2 HAVING count(*) > 1 UNION ALL SELECT 'unknown_endpoint', artifact FROM ends WHERE artifact NOT IN (SELECT artifact FROM art) UNION ALL SELECT DISTINCT 'self_edge', child FROM e WHERE child = parent
UNION ALL SELECT DISTINCT 'duplicate_edge', child FROM (SELECT child, parent FROM e GROUP BY 1, 2 HAVING count(*) > 1) UNION ALL SELECT 'cycle', child FROM r WHERE child = parent UNION ALL SELECT 'missing_required', artifact FROM ({NEEDED}) WHERE artifact NOT IN (SELECT artifact FROM art)""")
def b25(t: Tables) -> DataFrame:
    artifacts = t.nation.filter("n_nationkey <> 24").select(F.col("n_nationkey").cast("long").alias("artifact")).unionAll(t.region.filter("r_regionkey < 2").select(F.col("r_regionkey").cast("long")))
    flows = t.supplier.select(F.col("s_nationkey").cast("long").alias("child"), ((F.col("s_nationkey") * 7 + F.col("s_suppkey") % 2) % 25).cast("long").alias("parent"))
    return B.lineage_graph(artifacts, flows, t.part.filter("p_size <= 30").select(F.col("p_size").cast("long").alias("artifact")).distinct())


@query("b30_benchmark_conflict", 'SELECT date, count(DISTINCT b) AS "values", round(max(b) - min(b), 8) AS spread FROM (SELECT date, benchmark_return + CASE WHEN security_id = 5 AND month(date) = 7 THEN 0.5 ELSE 0 END AS b FROM panel) GROUP BY date HAVING max(b) - min(b) > 1e-12')
def b30(t: Tables) -> DataFrame:
    odd = F.col("benchmark_return") + F.when((F.col("security_id") == 5) & (F.month("date") == 7), 0.5).otherwise(0.0)
    return B.benchmark_conflict(t.panel.withColumn("benchmark_return", odd)).withColumn("spread", F.round("spread", 8))


@query("b14_unit_reconcile", "SELECT o_orderpriority AS field, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'mixed' ELSE 'no_contract' END AS status FROM orders GROUP BY 1 HAVING o_orderpriority NOT IN ('3-MEDIUM') UNION ALL SELECT '3-MEDIUM', 'mixed' UNION ALL SELECT 'zz', 'unused'")
def b14(t: Tables) -> DataFrame:
    contract = t.spark.createDataFrame([("1-URGENT", "F"), ("2-HIGH", "O"), ("3-MEDIUM", "P"), ("zz", "F")], "field string, unit string")
    return B.unit_reconcile(t.orders.select(F.col("o_orderpriority").alias("field"), F.col("o_orderstatus").alias("unit")), contract)


MARKET = [("key_null", "CRITICAL", "security_id", "security_id IS NULL"), ("id_format", "ERROR", "security_id", "NOT regexp_matches(security_id::VARCHAR, '^[0-9]{1,2}$')"), ("available_late", "CRITICAL", "available_at", "security_id % 13 = 0"), ("eligible_null", "ERROR", "eligible", "false"), ("sector_null", "ERROR", "sector", "sector IS NULL"), ("price_negative", "ERROR", "price", "price < 0"), ("volume_negative", "ERROR", "volume", "volume < 0"), ("eligible_without_price", "ERROR", "price", "false"), ("high_below_low", "ERROR", "high", "high < low"), ("ret_range", "ERROR", "ret", "ret <= -1"), ("ret_implausible", "WARNING", "ret", "abs(ret) > 0.2"), ("market_return_range", "ERROR", "market_return", "market_return <= -1"), ("market_return_implausible", "WARNING", "market_return", "abs(market_return) > 0.2"), ("benchmark_return_range", "ERROR", "benchmark_return", "benchmark_return <= -1"), ("benchmark_return_implausible", "WARNING", "benchmark_return", "abs(benchmark_return) > 0.2")]
register("b15_market_input_rules", lambda t: findings_of(B.market_input(t.panel.withColumns({"eligible": F.lit(True), "available_at": F.date_add("date", F.when(F.col("security_id") % 13 == 0, 1).otherwise(0)).cast("timestamp")}), r"^[0-9]{1,2}$", 0.2)), counts_sql("panel", MARKET, "security_id,date"))
register("b16_fundamental_input_rules", lambda t: findings_of(B.fundamental_input(t.fundamentals.withColumn("period_end", F.date_add("available_at", F.when(F.col("security_id") % 10 == 0, 1).otherwise(-1))))), counts_sql("fundamentals", [("period_after_available", "ERROR", "period_end", "security_id % 10 = 0"), ("finite", "ERROR", "value", "false"), ("field_null", "CRITICAL", "field", "field IS NULL")], "security_id,available_at,field"))
register("b17_factor_output_rules", lambda t: findings_of(B.factor_output(scores(t), ["market_cap", "turnover"], ["turnover"])), counts_sql("scores_", [("unknown_factor", "ERROR", "factor_id", "factor_id = 'momentum_1m'"), ("not_finite", "ERROR", "raw", "false"), ("derived_without_raw", "ERROR", "raw", "raw IS NULL AND winsorized IS NOT NULL"), ("negative", "ERROR", "raw", "factor_id = 'turnover' AND raw < 0"), ("not_a_flag", "ERROR", "raw", "false"), ("missing", "WARNING", "raw", "raw IS NULL")], "security_id,date,factor_id"), SCORES)
register("b18_portfolio_output_rules", lambda t: findings_of(B.portfolio_output(held(t).select("factor_id", "quantile", "members", F.col("value_weighted_return").alias("ret"), F.col("date").alias("formation_date"), F.add_months("date", 1).alias("date")), 2)), counts_sql("h_", [("realized_before_formation", "CRITICAL", "date", "false"), ("count_positive", "ERROR", "members", "members <= 0"), ("quantile_range", "ERROR", "quantile", "quantile > 2"), ("return_range", "ERROR", "ret", "vw <= -1")]) + " UNION ALL SELECT 'duplicate_key', 'CRITICAL', 'formation_date,date,factor_id,quantile', 0", FORMED)
register("b19_session_series_check", lambda t: B.session_series(t.panel.filter("month(date) <> 3").withColumn("market_return", F.col("market_return") + F.when((F.col("security_id") == 5) & (F.month("date") == 7), 0.5).otherwise(0.0)), ["market_return", "risk_free"], t.market_m.filter("month(date) <> 4")), "SELECT date, CASE WHEN month(date) = 4 THEN 'not_a_session' WHEN month(date) = 3 THEN 'unobserved' ELSE 'differs' END AS finding FROM market_m WHERE month(date) IN (3, 4) OR (month(date) = 7 AND date IN (SELECT date FROM panel_m WHERE security_id = 5))")
register("b20_regression_frame_rules", lambda t: B.regression_frame(t.panel, ["security_id"], "ret", ["market_return", "benchmark_return"], 82).select("security_id", "cases", "usable"), "SELECT security_id, count(*) AS cases, count(*) >= 82 AND max(ret) > min(ret) AS usable FROM panel WHERE ret IS NOT NULL GROUP BY 1")
register("b22_universe_breadth_gate", lambda t: B.breadth(t.panel_m, "date", "security_id", 50), "SELECT max(n) AS widest, max(n) >= 50 AS passes FROM (SELECT count(DISTINCT security_id) AS n FROM panel_m GROUP BY date)")


@query("b23_identity_authority_check", f"WITH l AS ({LOOKUP}) SELECT count(*) FILTER (l.security_id IS DISTINCT FROM o_orderkey) AS mismatched, count(*) FILTER (l.security_id IS NULL) > 0 AND count(l.security_id) > 0 AS mixed FROM orders LEFT JOIN l ON l.source_id = o_custkey AND l.at = o_orderdate::DATE")
def b23(t: Tables) -> DataFrame:
    rows = t.orders.select(F.col("o_custkey").alias("source_id"), F.to_date("o_orderdate").alias("at"), F.col("o_orderkey").alias("own"))
    return B.identity_authority(rows.join(c03(t), ["source_id", "at"], "left"), "security_id", "own")


register("b24_exact_columns", lambda t: t.panel_m.select(F.lit(",".join(B.schema_difference(t.panel_m, ["security_id", "date", "open", "price"])[0])).alias("missing"), F.lit(len(B.schema_difference(t.panel_m, ["security_id", "date", "open", "price"])[1])).cast("long").alias("extra")).groupBy("missing", "extra").agg(F.count("*").alias("rows")), "SELECT 'open' AS missing, 8 AS extra, count(*) AS rows FROM panel_m")
#: Steps of the event journal that count as a legal life cycle here.
STEPS = {"signup": ("view", "click"), "view": ("click", "view", "purchase"), "click": ("view", "purchase"), "purchase": ("view",)}
register("b26_journal_transitions", lambda t: M.illegal_steps(t.journal, "user_id", "seq", "state", STEPS).select("user_id", "seq", "was", "state"), "SELECT user_id, seq, was, state FROM (SELECT *, lag(state) OVER (PARTITION BY user_id ORDER BY seq) AS was FROM journal) WHERE was IS NOT NULL AND was || '>' || state NOT IN ('signup>view', 'signup>click', 'view>click', 'view>view', 'view>purchase', 'click>view', 'click>purchase', 'purchase>view')")
register("b27_journal_last_state", lambda t: M.last_state(t.journal, "user_id", "seq", "state"), "SELECT user_id, max_by(state, seq) AS state, count(*) AS events FROM journal GROUP BY 1")

# M

register("m02_union_all", lambda t: t.customer.select(F.col("c_nationkey").alias("nation"), F.lit("customer").alias("kind")).unionByName(t.supplier.select(F.col("s_nationkey").alias("nation"), F.lit("supplier").alias("kind"))).groupBy("nation", "kind").agg(F.count("*").alias("n")), "SELECT nation, kind, count(*) AS n FROM (SELECT c_nationkey AS nation, 'customer' AS kind FROM customer UNION ALL SELECT s_nationkey, 'supplier' FROM supplier) GROUP BY 1, 2")


@query("m03_set_intersect_except", "SELECT 'both' AS side, date FROM (SELECT DISTINCT date FROM panel_m INTERSECT SELECT DISTINCT date_trunc('month', date)::DATE FROM panel_d WHERE month(date) <= 6) UNION ALL SELECT 'only', date FROM (SELECT DISTINCT date FROM panel_m EXCEPT SELECT date_trunc('month', date)::DATE FROM panel_d WHERE month(date) <= 6)")
def m03(t: Tables) -> DataFrame:
    a, b = t.panel_m.select("date").distinct(), t.panel_d.filter("month(date) <= 6").select(F.trunc("date", "MM").alias("date")).distinct()
    return a.intersect(b).select(F.lit("both").alias("side"), "date").unionByName(a.exceptAll(b).select(F.lit("only").alias("side"), "date"))


CHANGE = "WITH s AS (SELECT factor_id, date, list(security_id) AS m FROM q_ WHERE quantile = 3 GROUP BY 1, 2), p AS (SELECT *, lag(m) OVER (PARTITION BY factor_id ORDER BY date) AS was FROM s) SELECT factor_id, date, len(m) - len(list_intersect(m, was)) AS came, len(was) - len(list_intersect(m, was)) AS went, len(m) + len(was) - len(list_intersect(m, was)) AS either FROM p WHERE was IS NOT NULL"
register("m04_symmetric_difference", lambda t: M.membership_change(formed(t).filter("quantile = 3"), ["factor_id"], "date", "security_id"), CHANGE, FORMED)
register("m05_distinct_rows", lambda t: t.orders.groupBy("o_custkey", "o_orderstatus").agg(F.min("o_orderkey").alias("first_order")), "SELECT o_custkey, o_orderstatus, min(o_orderkey) AS first_order FROM orders GROUP BY 1, 2")
register("m06_top_k_per_group", lambda t: M.top_k(t.panel_m.filter("ret IS NOT NULL"), ["date"], "ret", 3, "security_id").select("security_id", "date", F.round("ret", 8).alias("ret")), "SELECT security_id, date, round(ret, 8) AS ret FROM panel_m WHERE ret IS NOT NULL QUALIFY row_number() OVER (PARTITION BY date ORDER BY ret DESC, security_id) <= 3")
register("m07_sort_stable", lambda t: t.nation.orderBy("n_regionkey", "n_name").select("n_regionkey", "n_name"), "SELECT n_regionkey, n_name FROM nation ORDER BY 1, 2")
register("m08_limit_head", lambda t: t.orders.orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice"), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
