"""Queries of the source, sink and scalar operators (A, N)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitwell.functions import scalar as S
from pitwell.operators.joins import JoinError
from pitwell.plans.registry import query, register
from pitwell.plans.tables import Tables
from pitwell.sources import filings as X
from pitwell.sources import readers as A
from pitwell.sources import sinks as K


@query("a01_contracted_scan", "SELECT count(*) AS rows, count(DISTINCT n_nationkey) AS keys FROM nation")
def a01(t: Tables) -> DataFrame:
    c = A.Contract("nation", t.nation.schema, ("n_nationkey",))
    return A.contracted_scan(t.spark, f"{t.sf_dir}/nation.parquet", c).agg(F.count("*").alias("rows"), F.count_distinct("n_nationkey").alias("keys"))


@query("a02_unit_contract_check", "SELECT DISTINCT o_orderpriority AS field, o_orderstatus AS unit FROM orders WHERE NOT (o_orderpriority = '1-URGENT' AND o_orderstatus IN ('F', 'O'))")
def a02(t: Tables) -> DataFrame:
    declared = t.orders.select(F.col("o_orderpriority").alias("field"), F.col("o_orderstatus").alias("unit")).distinct()
    return A.unit_contract_findings(declared, t.spark.createDataFrame([("1-URGENT", "F"), ("1-URGENT", "O")], "field string, unit string"))


@query("a03_macro_csv_standardize", "SELECT 'ACCT' AS series_id, c_custkey, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_acctbal END AS value, c_custkey % 10 = 0 AS missing_value FROM customer")
def a03(t: Tables) -> DataFrame:
    raw = t.customer.select("c_custkey", F.lit("2024-01-31").alias("d"), F.when(F.col("c_custkey") % 20 == 0, ".").when(F.col("c_custkey") % 10 == 0, " NA ").otherwise(F.col("c_acctbal").cast("string")).alias("v"))
    return A.macro_observations(raw, "ACCT", "d", "v", ["c_custkey"]).select("series_id", "c_custkey", "value", "missing_value")


@query("a04_wide_factor_csv_to_long", "SELECT o_orderdate::DATE AS date, factor, count(*) AS n FROM orders, (VALUES ('mkt'), ('smb')) f(factor) WHERE NOT (factor = 'smb' AND o_orderkey % 7 = 0) GROUP BY 1, 2")
def a04(t: Tables) -> DataFrame:
    smb = F.when(F.col("o_orderkey") % 7 == 0, "-99.99").otherwise("0.50")
    lines = t.orders.select(F.concat_ws(",", F.date_format("o_orderdate", "yyyyMMdd"), F.lit(" 1.25"), smb).alias("value"))
    notes = t.nation.select(F.concat(F.lit("note "), "n_name").alias("value"))
    return A.factor_text_to_long(lines.unionByName(notes), ["mkt", "smb"]).groupBy("date", "factor").agg(F.count("*").alias("n"))


register("a05_listing_snapshot_dedupe", lambda t: A.collapse_duplicates(t.customer, ["c_mktsegment", "c_nationkey"], F.lit("2024-01-31")), "SELECT lower(trim(c_mktsegment)) AS c_mktsegment, c_nationkey::VARCHAR AS c_nationkey, count(*) AS source_duplicate_count, '2024-01-31' AS as_of_date FROM customer GROUP BY 1, 2")
register("a06_daily_bar_standardize", lambda t: A.daily_bars(t.orders.select(F.col("o_custkey").alias("source_id"), F.to_date("o_orderdate").alias("date"), "o_totalprice"), t.mapping.select("source_id", "security_id", "valid_from", "valid_to"), "source_id", "1996-01-01", "1996-12-31").select("source_id", "date", "security_id", "o_totalprice"),
         "SELECT o.source_id, o.date, m.security_id, o_totalprice FROM (SELECT o_custkey AS source_id, o_orderdate::DATE AS date, o_totalprice FROM orders) o JOIN mapping m ON o.source_id = m.source_id AND o.date >= valid_from AND (valid_to IS NULL OR o.date <= valid_to) WHERE o.date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'")
register("a07_source_splice_check", lambda t: A.splice_breaks(t.panel_m.withColumn("src", F.month("date") % 2), "security_id", "src", limit=0.2).select("security_id", "date"), "SELECT security_id, date FROM (SELECT *, month(date) % 2 AS src, lag(month(date) % 2) OVER w AS was, lag(price) OVER w AS p FROM panel_m WINDOW w AS (PARTITION BY security_id ORDER BY date)) WHERE was <> src AND abs(price / p - 1) > 0.2")
register("a08_wide_bars_to_long", lambda t: A.wide_to_long(t.part.select("p_partkey", F.col("p_retailprice").alias("close"), F.when(F.col("p_size") > 25, F.col("p_size").cast("double")).alias("dividend")), "p_partkey", ["close", "dividend"]), "SELECT p_partkey, 'close' AS name, p_retailprice AS value FROM part UNION ALL SELECT p_partkey, 'dividend', p_size::DOUBLE FROM part WHERE p_size > 25")


@query("a09_company_facts_flatten", "SELECT o_orderkey, 'us-gaap' AS taxonomy, 'Revenue' AS concept, 'USD' AS unit, o_orderkey::DOUBLE AS val FROM orders WHERE o_orderkey % 3 <> 0")
def a09(t: Tables) -> DataFrame:
    fact = F.concat(F.lit('{"us-gaap":{"Revenue":{"USD":[{"end":"2020-12-31","val":'), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 3 != 0, ',"filed":"2021-02-01"').otherwise(""), F.lit("}]}}}"))
    return A.flatten_facts(t.orders.select("o_orderkey", fact.alias("j")), "j").select("o_orderkey", "taxonomy", "concept", "unit", "val")


register("a10_column_arrays_to_rows", lambda t: A.parallel_arrays(t.lineitem.groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("line"), F.collect_list("l_returnflag").alias("flag")), ["line", "flag"]), "SELECT l_orderkey, l_linenumber AS line, l_returnflag AS flag FROM lineitem")


@query("a11_availability_timestamp", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate::DATE + INTERVAL 10 HOUR, '%Y-%m-%d %H:%M:%S') ELSE strftime(o_orderdate::DATE, '%Y-%m-%d') || ' 23:59:59' END AS available, CASE WHEN o_orderkey % 2 = 0 THEN 'SOURCE_TIMESTAMP' ELSE 'INFERRED_DATE_LEVEL' END AS quality FROM orders")
def a11(t: Tables) -> DataFrame:
    text = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T12:00:00+02:00"))).otherwise("none")
    at, quality = A.availability(text, F.to_date("o_orderdate"))
    return t.orders.select("o_orderkey", F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("available"), quality.alias("quality"))


# A filing made of each page: its own markup with tags of facts around parts of it.
_COVER = "<ix:header><xbrli:context id='c{p}'><xbrli:period><xbrli:startDate>2019-01-01</xbrli:startDate><xbrli:endDate>{d}</xbrli:endDate></xbrli:period></xbrli:context><xbrli:context id=\"i{p}\"><xbrli:entity><xbrli:segment><xbrldi:explicitMember dimension=\"us-gaap:StatementClassOfStockAxis\">us-gaap:CommonClass{c}Member</xbrldi:explicitMember><xbrldi:explicitMember dimension=\"dei:LegalEntityAxis\">x:{u}</xbrldi:explicitMember></xbrli:segment></xbrli:entity><xbrli:period><xbrli:instant>{d}</xbrli:instant></xbrli:period></xbrli:context></ix:header>"
_TITLE = r"(?s)<title>(.*?)</title>"


def tagged_pages(t: Tables) -> DataFrame:
    """page_id, html: the title is a fact continued in the first and the second paragraph, a chain against the order of reading."""
    p = F.col("page_id").cast("string")
    day = F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (F.col("page_id") % 365).cast("int")), "yyyy-MM-dd")
    head = F.lit(_COVER)
    for name, value in (("{p}", p), ("{d}", day), ("{c}", F.when(F.col("page_id") % 2 == 0, "A").otherwise("B")), ("{u}", F.sha2("url", 256))):
        head = F.replace(head, F.lit(name), value)
    fact = F.concat(F.lit("<title><ix:nonNumeric name='dei:EntityRegistrantName' contextRef='"), F.when(F.col("page_id") % 7 == 3, "gone").otherwise("c"), p, F.lit("' continuedAt='k1'>$1</ix:nonNumeric></title>"))
    symbol = F.concat(F.lit("<IX:NONNUMERIC contextref=\"i"), p, F.lit("\" name=\"dei:TradingSymbol\"><b>S&amp;</b>&#"), (F.col("page_id") % 26 + 65).cast("string"), F.lit(";<!-- <ix:nonNumeric> --></IX:NONNUMERIC>"))
    html = F.regexp_replace(F.col("html"), F.lit(_TITLE), fact)
    html = F.regexp_replace(html, F.lit(r"(?s)<h1>(.*?)</h1>"), F.lit("<h1><ix:continuation id='k1' continuedAt='k2'>$1</ix:continuation></h1>"))
    html = F.regexp_replace(html, F.lit(r"(?s)<ul>(.*?)</ul>"), F.lit("<ix:continuation id='k2'><ul>$1</ul></ix:continuation>"))
    return t.pages.select("page_id", F.concat(head, symbol, html).alias("html"))


A12 = r"""WITH p AS (SELECT page_id, url, html, ('2020-01-01'::DATE + (page_id % 365)::INT)::DATE AS d,
 regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS a, regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) AS b, array_to_string(regexp_extract_all(html, '(?s)<ul>(.*?)</ul>', 1), '') AS c FROM pages),
v AS (SELECT *, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(a || ' ' || b || ' ' || c, '<[^>]*>', '', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '[\s\x{00A0}]+', ' ', 'g')) AS name FROM p WHERE page_id % 7 <> 3)
SELECT page_id, 'EntityRegistrantName' AS concept, 'c' || page_id AS context_ref, '2019-01-01'::DATE AS period_start, d AS period_end, NULL::DATE AS instant, '{}' AS dimensions_json, name AS value FROM v
UNION ALL SELECT page_id, 'TradingSymbol', 'i' || page_id, NULL, NULL, d, '{"dei:LegalEntityAxis":"x:' || sha256(url) || '","us-gaap:StatementClassOfStockAxis":"us-gaap:CommonClass' || CASE WHEN page_id % 2 = 0 THEN 'A' ELSE 'B' END || 'Member"}', 'S&' || chr((page_id % 26 + 65)::INT) FROM v"""
register("a12_tagged_html_facts", lambda t: X.accepted(X.tagged_facts(tagged_pages(t), "page_id", "html"), "page_id").drop("at"), A12)
register("a12_rejected_filings", lambda t: X.tagged_facts(tagged_pages(t), "page_id", "html").filter("reason IS NOT NULL").select("page_id", "concept", "context_ref", "reason"), "SELECT page_id, 'EntityRegistrantName' AS concept, 'gone' || page_id AS context_ref, 'missing_context' AS reason FROM pages WHERE page_id % 7 = 3")


def submissions(t: Tables) -> DataFrame:
    """o_orderkey, o_custkey, form, text: an order as a submission whose instance holds its values, some of them faulty."""
    k, key = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    amount = F.format_string("%.2f", F.col("o_totalprice"))
    context = lambda name, segment: F.concat(F.lit(f"<context id='{name}'><entity><identifier scheme='cik'>"), F.lpad(F.col("o_custkey").cast("string"), 10, "0"), F.lit(f"</identifier>{segment}</entity><period><instant>"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("</instant></period></context>"))
    member = "<segment><d:explicitMember dimension='us-gaap:ClassAxis'> x:A&amp;B </d:explicitMember><d:typedMember dimension='a:Lot'><a:n>7</a:n></d:typedMember></segment>"
    fact = lambda name, ref, value, more="": F.concat(F.lit(f"<dei:{name} contextRef='{ref}'{more}>"), value, F.lit(f"</dei:{name}>"))
    float_ = fact("EntityPublicFloat", "c1", amount, " unitRef='u' decimals='2'")
    xml = F.concat(
        F.lit("<XBRL><xbrl xmlns='http://www.xbrl.org/2003/instance' xmlns:dei='urn:dei' xmlns:d='urn:d' xmlns:a='urn:a'>"), context("c1", ""), context("c2", member), F.lit("<unit id='u'><measure>iso4217:USD</measure></unit>"),
        fact("DocumentType", "c1", F.when(k % 11 == 5, "8-K").otherwise(F.col("o_orderstatus"))), float_, float_, F.when(k % 5 == 0, fact("EntityPublicFloat", "c1", F.lit("1"), " unitRef='u'")).otherwise(""),
        fact("Security12bTitle", "c2", F.concat(F.lit("  Lot\n "), F.col("o_orderpriority"))), F.when(k % 13 == 1, fact("TradingSymbol", "c9", F.lit("T"))).otherwise(""), F.lit("</xbrl></XBRL>"))
    block = lambda kind, body: F.concat(F.lit(f"<DOCUMENT>\n<TYPE>{kind}\n<FILENAME>f-1.xml\n<TEXT>\n"), body, F.lit("\n</TEXT>\n</DOCUMENT>\n"))
    head = F.concat(F.lit("<SEC-HEADER>\n<ACCEPTANCE-DATETIME>\nACCESSION NUMBER:\t"), F.when(k % 9 == 4, "other").otherwise(key), F.lit("\nCONFORMED SUBMISSION TYPE: "), F.col("o_orderstatus"), F.lit("\nFILED AS OF DATE: "), F.date_format("o_orderdate", "yyyyMMdd"), F.when(k % 8 == 2, "x").otherwise(""),
                    F.lit("\nACCEPTANCE-DATETIME: "), F.date_format("o_orderdate", "yyyyMMddHHmmss"), F.lit("\nFILER:\n  CENTRAL INDEX KEY: "), F.lpad(F.col("o_custkey").cast("string"), 10, "0"), F.lit("\nFILER:\n  CENTRAL INDEX KEY: 42\n</SEC-HEADER>\n"))
    text = F.concat(head, block("10-K", F.col("o_comment") if "o_comment" in t.orders.columns else F.col("o_clerk") if "o_clerk" in t.orders.columns else key), block("EX-101.INS", xml), F.when(k % 17 == 2, block("EX-101.INS", xml)).otherwise(""))
    # Dealt before the texts are made: a file of few row groups would leave all reading to a few tasks.
    orders = t.orders.repartition(4 * t.spark.sparkContext.defaultParallelism, "o_orderkey")
    return orders.select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("form"), key.alias("asked"), text.alias("text"))


A13 = """WITH o AS (SELECT *, o_orderkey AS k, o_orderdate::DATE AS d FROM orders), good AS (SELECT * FROM o WHERE k % 17 <> 2 AND k % 5 <> 0 AND k % 13 <> 1 AND (k % 11 <> 5))
SELECT o_orderkey, 1 AS ordinal, 'DocumentType' AS concept, 'c1' AS context_ref, NULL::VARCHAR AS unit_ref, NULL::VARCHAR AS unit_measure, NULL::VARCHAR AS decimals, d AS instant, '{}' AS dimensions_json, o_orderstatus AS value FROM good
UNION ALL SELECT o_orderkey, 2, 'EntityPublicFloat', 'c1', 'u', 'iso4217:USD', '2', d, '{}', printf('%.2f', o_totalprice) FROM good
UNION ALL SELECT o_orderkey, 3, 'Security12bTitle', 'c2', NULL, NULL, NULL, d, '{"a:Lot":"7","us-gaap:ClassAxis":"x:A&B"}', 'Lot ' || o_orderpriority FROM good"""
A13_BAD = """WITH o AS (SELECT o_orderkey, o_orderkey AS k FROM orders)
SELECT o_orderkey, reason, count(*) AS rows FROM (
 SELECT o_orderkey, 'several_instances' AS reason FROM o WHERE k % 17 = 2 UNION ALL SELECT o_orderkey, 'missing_context' FROM o WHERE k % 17 <> 2 AND k % 13 = 1
 UNION ALL SELECT o_orderkey, 'conflicting_facts' FROM o WHERE k % 17 <> 2 AND k % 5 = 0
 UNION ALL SELECT o_orderkey, 'form_mismatch' FROM (SELECT o_orderkey, k, unnest(['DocumentType', 'EntityPublicFloat', 'Security12bTitle']) AS c FROM o WHERE k % 17 <> 2 AND k % 11 = 5) WHERE NOT (c = 'EntityPublicFloat' AND k % 5 = 0)) GROUP BY 1, 2"""


def a13_facts(t: Tables) -> DataFrame:
    return X.instance_facts(submissions(t), "o_orderkey", "text", "o_custkey", "form")


register("a13_xml_instance_facts", lambda t: X.accepted(a13_facts(t), "o_orderkey").drop("period_start", "period_end"), A13)
register("a13_rejected_instances", lambda t: a13_facts(t).filter("reason IS NOT NULL").groupBy("o_orderkey", "reason").agg(F.count("*").alias("rows")), A13_BAD)
register("a14_filing_header_fields", lambda t: X.filing_headers(submissions(t), "o_orderkey", "text", "asked", "o_custkey").withColumn("ciks", F.array_join("ciks", ",")),
         "SELECT o_orderkey, CASE WHEN k % 9 = 4 THEN 'other' ELSE k::VARCHAR END AS accession, o_orderstatus AS form, CASE WHEN k % 8 <> 2 THEN o_orderdate::DATE END AS filed, strftime(o_orderdate, '%Y%m%d%H%M%S') AS acceptance, array_to_string(list_sort(list_distinct([o_custkey::VARCHAR, '42'])), ',') AS ciks, CASE WHEN k % 9 = 4 THEN 'other_accession' WHEN k % 8 = 2 THEN 'bad_filing_date' END AS reason FROM (SELECT *, o_orderkey AS k FROM orders)")
register("a15_inventory_reconcile", lambda t: A.reconcile_inventories(t.customer.filter("c_custkey % 3 <> 0"), t.customer.filter("c_custkey % 5 <> 0"), "c_custkey", "c_mktsegment", "BUILDING").groupBy("reason").agg(F.count("*").alias("n")), "SELECT CASE WHEN c_custkey % 5 = 0 THEN 'missing_in_second' WHEN c_custkey % 3 = 0 THEN 'missing_in_first' WHEN c_mktsegment <> 'BUILDING' THEN 'other_class' ELSE 'selected' END AS reason, count(*) AS n FROM customer WHERE NOT (c_custkey % 3 = 0 AND c_custkey % 5 = 0) GROUP BY 1")


_SUMS = "count(*) AS rows, round(sum({p}o_totalprice), 2) AS total, min(o_orderkey) AS first, max(o_orderkey) AS last, count(DISTINCT o_custkey) AS customers"


def order_sums(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("rows"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"), F.count_distinct("o_custkey").alias("customers"))


@query("a16_immutable_publish", f"SELECT 'as published' AS step, true AS taken, {_SUMS.format(p='')} FROM orders UNION ALL SELECT 'the same again', true, {_SUMS.format(p='')} FROM orders UNION ALL SELECT 'other content', false, {_SUMS.format(p='')} FROM orders UNION ALL SELECT 'other place', true, {_SUMS.format(p='-')} FROM orders")
def a16(t: Tables) -> DataFrame:
    """What stands at a path after each attempt to publish there: other content never replaces what was published."""
    path, other = K.new_folder(t.spark, "a16"), K.new_folder(t.spark, "a16")
    changed = t.orders.withColumn("o_totalprice", -F.col("o_totalprice"))
    out = None
    for step, df, at in (("as published", t.orders, path), ("the same again", t.orders.orderBy("o_custkey"), path), ("other content", changed, path), ("other place", changed, other)):
        try:
            taken = bool(K.publish(df, at))
        except JoinError:
            taken = False
        now = order_sums(t.spark.read.parquet(at)).select(F.lit(step).alias("step"), F.lit(taken).alias("taken"), "*")
        out = now if out is None else out.unionByName(now)
    return out


@query("a23_quarantine_sink", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'PRICE' END AS reason FROM orders")
def a23(t: Tables) -> DataFrame:
    path = K.new_folder(t.spark, "a23")
    good = K.quarantine(t.orders, F.col("o_totalprice") > 200000, F.lit("PRICE"), path)
    return good.select("o_orderkey", F.lit(None).cast("string").alias("reason")).unionByName(t.spark.read.parquet(path).select("o_orderkey", "reason"))




@query("a17_content_fingerprint", """WITH r AS (SELECT n_nationkey, n_name, n_regionkey, '{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}' AS j FROM nation),
p AS (SELECT n_regionkey, ('0x' || sha256(j)[1:15])::HUGEINT AS part FROM r), s AS (SELECT n_regionkey, count(*) AS rows, sum(part)::HUGEINT AS s FROM p GROUP BY 1)
SELECT n_regionkey AS region, rows, sha256(rows || '|' || s || '|' || '[(''n_name'', ''string''), (''n_nationkey'', ''{key}''), (''n_regionkey'', ''{region}'')]') AS content_id FROM s""".replace("{key}", "bigint").replace("{region}", "bigint"))
def a17(t: Tables) -> DataFrame:
    """The identity of each region's nations: from their content alone, whatever the order of rows and columns."""
    nations = t.nation.select("n_regionkey", F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name").orderBy(F.col("n_name").desc())
    out = None
    for key in sorted(r.n_regionkey for r in nations.select("n_regionkey").distinct().collect()):
        one = nations.filter(F.col("n_regionkey") == key).withColumn("n_regionkey", F.col("n_regionkey").cast("long"))
        found = K.fingerprint(one).select(F.lit(key).cast("long").alias("region"), "rows", "content_id")
        out = found if out is None else out.unionByName(found)
    return out


register("a18_filtered_factor_read", lambda t: K.filtered_read(t.spark, f"{t.sf_dir}/lineitem.parquet", ["l_orderkey", "l_quantity"], F.col("l_returnflag") == "R"), "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_returnflag = 'R'")


@query("a19_validated_view", "SELECT count(*) AS rows FROM orders")
def a19(t: Tables) -> DataFrame:
    parts = t.spark.createDataFrame([(f"{t.sf_dir}/orders.parquet", "orders", "PASS", "FINALIZED"), (f"{t.sf_dir}/nothing.parquet", "orders", "FAIL", "FINALIZED")], "path string, dataset_type string, status string, state string")
    return K.validated_view(t.spark, parts, "orders", "valid_orders").agg(F.count("*").alias("rows"))


register("a21_table_page", lambda t: K.table_page(t.orders.select("o_orderkey", "o_totalprice"), ["o_orderkey"], 100, 50)[0], "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100")
register("n01_scalar_strings", lambda t: t.customer.select("c_custkey", S.normal_ticker(F.concat(F.lit(" "), "c_mktsegment")).alias("ticker"), S.padded_cik(F.col("c_custkey")).alias("cik"), S.collapsed(F.concat("c_name", F.lit("  \n x "))).alias("name")), "SELECT c_custkey, upper(trim(' ' || c_mktsegment)) AS ticker, lpad(c_custkey::VARCHAR, 10, '0') AS cik, c_name || ' x' AS name FROM customer")
register("n02_content_id", lambda t: t.nation.select("n_nationkey", S.content_id(F.col("n_name"), F.col("n_regionkey")).alias("id")), "SELECT n_nationkey, sha256(n_name || chr(31) || n_regionkey) AS id FROM nation")
