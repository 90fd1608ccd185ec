"""Facts of filings: tagged HTML, XML instances and submission headers (A12 to A14).

Nothing is parsed outside the plan. Tagged HTML becomes one row for each tag of
interest with the markup that follows it; running depths by document nest those
rows, and chains of continuations are resolved by pointer doubling. Instances are
read by `from_xml` with a schema made from the wanted concepts. Documents fail as
a whole: a row carries the reason of its document's first failure, and `accepted`
keeps the facts of documents without one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitwell.operators.storage import settled

#: Local names of the tags that nest into facts (fixed values of the format, lower case).
TAGS = ("context", "startdate", "enddate", "instant", "explicitmember", "nonnumeric", "continuation")
COVER = ("DocumentType", "EntityRegistrantName", "Security12bTitle", "SecurityExchangeName", "TradingSymbol")
#: Named character references that filings use, the ampersand last (fixed values of the format).
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&amp;": "&"}
TAG = r"(?is)</?[a-z_][\w.-]*:(?:" + "|".join(TAGS) + r")(?=[\s/>])(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+>"
UNREAD = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
ANY_TAG = r"(?s)</?[A-Za-z](?:[^>\"']++|\"[^\"]*\"|'[^']*')*+>"


def attribute(tag: Column, name: str) -> Column:
    """The trimmed value of an attribute of a start tag; NULL if it isn't there or empty."""
    value = F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", 1)
    other = F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", 2)
    return F.nullif(F.trim(F.concat(value, other)), F.lit(""))


def unescaped(text: Column) -> Column:
    """Text with character references replaced: numbers of any size and the names in ENTITIES."""
    number = lambda m: F.when(F.lower(m).startswith("&#x"), F.conv(F.regexp_extract(m, "([0-9A-Fa-f]+);", 1), 16, 10)).otherwise(F.regexp_extract(m, r"(\d+);", 1)).cast("int")
    char = lambda m: F.decode(F.unhex(F.lpad(F.hex(number(m)), 8, "0")), "UTF-32")
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"&#(?:[xX][0-9A-Fa-f]{1,5}|\d{1,6});"), F.lit(0)))
    out = F.aggregate(found, text, lambda done, m: F.replace(done, m, char(m)))
    for name, plain in ENTITIES.items():
        out = F.replace(out, F.lit(name), F.lit(plain))
    return out


def plain_text(markup: Column) -> Column:
    """Markup without tags, references replaced, white space collapsed."""
    return F.trim(F.regexp_replace(unescaped(F.regexp_replace(markup, ANY_TAG, "")), r"[\s ]+", " "))


def tag_events(docs: DataFrame, doc: str, html: str) -> DataFrame:
    """doc, at, kind, opens, closes, tag, after (the markup up to the next tag of interest), context_at (open context around it)."""
    read = docs.select(doc, F.regexp_replace(html, UNREAD, "").alias("html"))
    tags = read.select(doc, F.regexp_extract_all("html", F.lit(TAG), F.lit(0)).alias("tags"), F.split("html", TAG, -1).alias("texts"))
    rows = tags.select(doc, "texts", F.posexplode("tags").alias("at", "tag")).select(doc, "at", "tag", F.get("texts", F.col("at") + 1).alias("after"))
    rows = rows.select(doc, "at", F.lower(F.regexp_extract("tag", r"(?s)^</?[^\s/>]*:([^\s/>]+)", 1)).alias("kind"), (~F.col("tag").startswith("</")).alias("opens"), (F.col("tag").startswith("</") | F.col("tag").endswith("/>")).alias("closes"), "tag", "after")
    up = Window.partitionBy(doc).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    context = F.col("kind") == "context"
    inside = F.last(F.when(context, F.when(F.col("closes"), F.lit(-1)).otherwise(F.col("at"))), True).over(up)
    return rows.withColumn("context_at", F.when(inside >= 0, inside))


def tag_elements(events: DataFrame, doc: str) -> DataFrame:
    """doc, kind, at, tag, context_at, value of every element that is closed, whatever nests in it."""
    by_kind = Window.partitionBy(doc, "kind").orderBy("at")
    step = F.col("opens").cast("int") - F.col("closes").cast("int")
    depth = events.filter("kind <> 'context'").withColumn("level", F.sum(step).over(by_kind) + F.when(F.col("closes"), 1).otherwise(0))
    pair = Window.partitionBy(doc, "kind", "level").orderBy("at")
    end = F.when(F.col("opens") & F.col("closes"), F.col("at")).when(F.lead("closes").over(pair) & ~F.lead("opens").over(pair), F.lead("at").over(pair))
    found = depth.withColumn("end", end).filter("opens AND end IS NOT NULL").select(doc, "kind", "at", "end", "tag", "context_at")
    # Each element meets the events it holds by their places; an element that closes itself holds none.
    held = found.filter("end > at").select(doc, "kind", "at", F.explode(F.sequence("at", F.col("end") - 1)).alias("place"))
    texts = held.join(events.select(doc, F.col("at").alias("place"), "after"), [doc, "place"]).groupBy(doc, "kind", "at").agg(F.array_sort(F.collect_list(F.struct("place", "after"))).alias("parts"))
    texts = texts.select(doc, "kind", "at", plain_text(F.array_join(F.transform("parts", lambda p: p["after"]), "")).alias("value"))
    return found.drop("end").join(texts, [doc, "kind", "at"], "left").withColumn("value", F.coalesce("value", F.lit("")))


def contexts_of(events: DataFrame, elements: DataFrame, doc: str) -> DataFrame:
    """doc, context_ref, period_start, period_end, instant, dimensions_json. Of several contexts of one id, or values of one place, the last holds."""
    opened = events.filter("kind = 'context' AND opens").select(doc, F.col("at").alias("context_at"), attribute(F.col("tag"), "id").alias("context_ref")).filter("context_ref IS NOT NULL")
    last = opened.groupBy(doc, "context_ref").agg(F.max("context_at").alias("context_at"))
    inner = elements.filter("context_at IS NOT NULL").select(doc, "context_at", "at", "kind", "value", attribute(F.col("tag"), "dimension").alias("dimension"))
    single = F.when(F.col("kind") == "explicitmember", F.col("dimension")).otherwise(F.col("kind"))
    inner = inner.withColumn("name", single).filter("name IS NOT NULL").groupBy(doc, "context_at", "kind", "name").agg(F.max_by("value", "at").alias("value"))
    day = lambda k: F.try_to_date(F.max(F.when(F.col("kind") == k, F.col("value"))), "yyyy-MM-dd")
    members = F.array_sort(F.collect_list(F.when(F.col("kind") == "explicitmember", F.struct(F.col("name").alias("key"), F.col("value").alias("value")))))
    held = inner.groupBy(doc, "context_at").agg(day("startdate").alias("period_start"), day("enddate").alias("period_end"), day("instant").alias("instant"), F.to_json(F.map_from_entries(members)).alias("dimensions_json"))
    return last.join(held, [doc, "context_at"], "left").select(doc, "context_ref", "period_start", "period_end", "instant", F.coalesce("dimensions_json", F.lit("{}")).alias("dimensions_json"))


def continued(links: DataFrame, doc: str) -> DataFrame:
    """doc, link, value, next of continuations: whole chains; next is left where a chain breaks off or runs in a circle.

    Every round a link takes over the value and the pointer of the link it points to, so that a chain of n links
    takes log2(n) rounds; what still points to a link after that runs in a circle.
    """
    longest = links.groupBy(doc).count().agg(F.max("count")).first()[0] or 0
    now = links
    for _ in range(longest.bit_length()):
        ahead = now.select(doc, F.col("link").alias("next"), F.col("value").alias("more"), F.col("next").alias("then"))
        moved = now.join(ahead, [doc, "next"], "left")
        now = settled(moved.select(doc, "link", F.when(F.col("more").isNull(), F.col("value")).otherwise(F.concat_ws(" ", "value", "more")).alias("value"), F.when(F.col("more").isNull(), F.col("next")).otherwise(F.col("then")).alias("next")))
    return now


def tagged_facts(docs: DataFrame, doc: str, html: str, concepts: tuple[str, ...] = COVER) -> DataFrame:
    """doc, at, concept, context_ref, period_start, period_end, instant, dimensions_json, value, reason of every tagged fact of the concepts."""
    events = settled(tag_events(docs, doc, html))
    elements = settled(tag_elements(events, doc))
    facts = elements.filter("kind = 'nonnumeric'").select(doc, "at", F.element_at(F.split(attribute(F.col("tag"), "name"), ":"), -1).alias("concept"), attribute(F.col("tag"), "contextref").alias("context_ref"), attribute(F.col("tag"), "continuedat").alias("continued_at"), "value")
    facts = facts.filter(F.col("concept").isin(*concepts))
    links = elements.filter("kind = 'continuation'").select(doc, "at", attribute(F.col("tag"), "id").alias("link"), "value", attribute(F.col("tag"), "continuedat").alias("next")).filter("link IS NOT NULL")
    links = settled(links.groupBy(doc, "link").agg(F.max_by("value", "at").alias("value"), F.max_by("next", "at").alias("next")))
    chains = continued(links, doc).select(doc, F.col("link").alias("continued_at"), F.col("value").alias("more"), F.col("next").alias("left_over"))
    rows = facts.join(chains, [doc, "continued_at"], "left").join(contexts_of(events, elements, doc).withColumn("known", F.lit(True)), [doc, "context_ref"], "left")
    value = F.trim(F.concat_ws(" ", F.nullif("value", F.lit("")), F.nullif(F.trim("more"), F.lit(""))))
    reason = F.when(F.col("context_ref").isNull(), "no_context_ref").when(F.col("known").isNull(), "missing_context").when(F.col("continued_at").isNotNull() & F.col("more").isNull() | F.col("left_over").isNotNull(), "missing_continuation").when(value == "", "empty_value")
    return rows.select(doc, "at", "concept", "context_ref", "period_start", "period_end", "instant", "dimensions_json", value.alias("value"), reason.alias("reason"))


def accepted(facts: DataFrame, doc: str) -> DataFrame:
    """Facts of the documents in which nothing failed, without the reason."""
    failed = F.max("reason").over(Window.partitionBy(doc))
    return facts.withColumn("failed_", failed).filter("failed_ IS NULL").drop("failed_", "reason")


#: Concepts of an instance that carry numbers (fixed values of the format).
NUMERIC = ("EntityCommonStockSharesOutstanding", "EntityPublicFloat")
INSTANCE = (*COVER, "EntityCentralIndexKey", "DocumentPeriodEndDate", *NUMERIC)


def instance_documents(docs: DataFrame, doc: str, text: str, kind: str = "EX-101.INS", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc, keep (more columns of docs), xml, reason: the single attachment of a type out of a submission, without its envelope.

    What several columns need is a column of an earlier step, so that a pattern runs once a document.
    """
    blocks = docs.select(doc, *keep, F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?is)<DOCUMENT>(.*?)</DOCUMENT>"), F.lit(1)).alias("b"))
    typed = blocks.withColumn("b", F.filter("b", lambda b: F.upper(F.trim(F.regexp_extract(b, r"(?im)^\s*<TYPE>\s*([^\r\n<]+)", 1))) == kind))
    one = typed.select(doc, *keep, F.size("b").alias("n"), F.get("b", F.lit(0)).alias("one"))
    inner = F.trim(F.regexp_replace(F.regexp_extract("one", r"(?is)<TEXT>(.*?)(?:</TEXT>|$)", 1), r"(?is)^\s*<XBRL>|</XBRL>\s*$", ""))
    one = one.select(doc, *keep, "n", F.trim(F.regexp_extract("one", r"(?im)^\s*<FILENAME>\s*([^\r\n<]+)", 1)).alias("name"), inner.alias("xml"))
    reason = F.when(F.col("n") == 0, "no_instance").when(F.col("n") > 1, "several_instances").when(~F.col("name").rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]{0,254}$"), "unsafe_name").when(F.col("xml") == "", "empty_instance").when(F.upper("xml").rlike("<!DOCTYPE|<!ENTITY"), "declarations")
    return one.select(doc, *keep, "xml", reason.alias("reason"))


def instance_facts(docs: DataFrame, doc: str, text: str, cik: str, form: str, concepts: tuple[str, ...] = INSTANCE, numeric: tuple[str, ...] = NUMERIC) -> DataFrame:
    """doc, ordinal (by concept and place), concept, context_ref, unit_ref, unit_measure, decimals, period_start, period_end, instant, dimensions_json, value, reason.

    cik and form: columns of docs that the instance must agree with. Equal facts are merged, different values of one
    concept, context and unit fail; a document without facts is one row with a reason.
    """
    asked = docs.select(doc, text, F.regexp_replace(F.col(cik).cast("string"), r"^0+(?=\d)", "").alias("cik_"), F.col(form).alias("form_"))
    found = instance_documents(asked, doc, text, keep=("cik_", "form_"))
    fact = "array<struct<_VALUE: string, _contextRef: string, _unitRef: string, _decimals: string>>"
    period = "struct<startDate: string, endDate: string, instant: string>"
    schema = f"context array<struct<_id: string, entity: struct<identifier: struct<_VALUE: string>, segment: string>, scenario: string, period: {period}>>, unit array<struct<_id: string, measure: array<string>>>, " + ", ".join(f"{c} {fact}" for c in concepts)
    options = {"ignoreNamespace": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken_"}
    read = settled(found.select(doc, "cik_", "form_", "reason", F.from_xml(F.when(F.col("reason").isNull(), F.col("xml")), schema + ", broken_ string", options).alias("x")))
    parsed = read.filter("reason IS NULL")
    rows = parsed.select(doc, "cik_", "form_", F.coalesce(F.col("x.broken_").isNotNull(), F.lit(True)).alias("broken"), F.array_compact(F.array(*(F.when(F.col(f"x.{c}").isNotNull(), F.struct(F.lit(c).alias("concept"), F.col(f"x.{c}").alias("facts"))) for c in concepts))).alias("all"))
    facts = rows.select(doc, F.explode("all").alias("a")).select(doc, "a.concept", F.posexplode("a.facts").alias("place", "f"))
    facts = facts.select(doc, "concept", "place", F.trim("f._contextRef").alias("context_ref"), F.col("f._unitRef").alias("unit_ref"), F.col("f._decimals").alias("decimals"), F.trim(F.regexp_replace(F.coalesce("f._VALUE", F.lit("")), r"\s+", " ")).alias("value"))
    facts = facts.groupBy(doc, "concept", "context_ref", "unit_ref").agg(F.min("place").alias("place"), F.min_by("decimals", "place").alias("decimals"), F.min_by("value", "place").alias("value"), F.count_distinct("value").alias("values"))
    contexts = parsed.select(doc, "cik_", F.inline("x.context")).select(doc, "cik_", F.trim("_id").alias("context_ref"), F.regexp_replace(F.trim("entity.identifier._VALUE"), r"^0+(?=\d)", "").alias("of"), "period", F.concat_ws("", "entity.segment", "scenario").alias("members"))
    member = r"(?is)<(?:[\w.-]+:)?(?:explicit|typed)Member\b[^>]*?dimension\s*=\s*[\"']\s*([^\"']*?)\s*[\"'][^>]*>(.*?)</(?:[\w.-]+:)?(?:explicit|typed)Member\s*>"
    pairs = F.transform(F.regexp_extract_all("members", F.lit(member), F.lit(0)), lambda m: F.struct(F.regexp_extract(m, member, 1).alias("key"), plain_text(F.regexp_extract(m, member, 2)).alias("value")))
    contexts = contexts.withColumn("pairs", pairs)
    wrong = F.when(F.col("of").isNull() | (F.col("of") != F.col("cik_")), "foreign_context").when((F.size(F.array_distinct(F.transform("pairs", lambda p: p["key"]))) < F.size("pairs")) | F.exists("pairs", lambda p: (p["key"] == "") | (p["value"] == "")), "bad_dimensions")
    day = lambda c: F.try_to_date(F.trim(f"period.{c}"), "yyyy-MM-dd")
    contexts = contexts.groupBy(doc, "context_ref").agg(
        F.when(F.count("*") > 1, "duplicate_context").otherwise(F.max(wrong)).alias("context_fault"), F.max(day("startDate")).alias("period_start"), F.max(day("endDate")).alias("period_end"), F.max(day("instant")).alias("instant"), F.max(F.to_json(F.map_from_entries(F.when(wrong.isNull(), F.array_sort("pairs"))))).alias("dimensions_json"))
    units = parsed.select(doc, F.inline("x.unit")).select(doc, F.trim("_id").alias("unit_ref"), "measure").groupBy(doc, "unit_ref").agg(F.count("*").alias("units"), F.first(F.array_join(F.transform("measure", lambda m: F.trim(m)), "*")).alias("unit_measure"))
    number = F.col("concept").isin(*numeric)
    faults = contexts.groupBy(doc).agg(F.max("context_fault").alias("context_fault"))
    # All sides have rows for each document: sizes guessed from the packed table must not make one a broadcast.
    whole = facts.join(contexts.drop("context_fault").withColumn("known", F.lit(True)).hint("merge"), [doc, "context_ref"], "left").join(units.hint("merge"), [doc, "unit_ref"], "left").join(faults.hint("merge"), doc, "left")
    typed = Window.partitionBy(doc)
    kinds = F.collect_set(F.when(F.col("concept") == "DocumentType", F.col("value"))).over(typed)
    ciks = F.collect_set(F.when((F.col("concept") == "EntityCentralIndexKey") & (F.col("dimensions_json") == "{}"), F.regexp_replace("value", r"^0+(?=\d)", ""))).over(typed)
    whole = rows.select(doc, "cik_", "form_", "broken").join(whole.hint("merge"), doc, "left").withColumns({"kinds": kinds, "ciks": ciks})
    reason = (
        F.when(F.col("broken"), "malformed").when(F.col("context_fault").isNotNull(), F.col("context_fault")).when(F.col("concept").isNull(), "no_facts").when(F.col("known").isNull(), "missing_context").when(F.col("value") == "", "empty_value")
        .when(number & (F.col("units").isNull() | (F.col("units") > 1)), "unresolved_unit").when(number & F.col("value").try_cast("decimal(38,10)").isNull(), "bad_number").when(F.col("values") > 1, "conflicting_facts")
        .when((F.size("kinds") != 1) | (F.get("kinds", F.lit(0)) != F.col("form_")), "form_mismatch").when((F.size("ciks") > 0) & ((F.size("ciks") > 1) | (F.get("ciks", F.lit(0)) != F.col("cik_"))), "registrant_mismatch"))
    ordinal = F.row_number().over(Window.partitionBy(doc).orderBy("concept", "place"))
    out = whole.select(doc, ordinal.cast("long").alias("ordinal"), "concept", "context_ref", "unit_ref", F.when(number, F.col("unit_measure")).alias("unit_measure"), "decimals", "period_start", "period_end", "instant", F.coalesce("dimensions_json", F.lit("{}")).alias("dimensions_json"), "value", reason.alias("reason"))
    missing = read.filter("reason IS NOT NULL").select(doc, "reason")
    return out.unionByName(missing, allowMissingColumns=True)


def filing_headers(docs: DataFrame, doc: str, text: str, accession: str, cik: str) -> DataFrame:
    """doc, accession, form, filed, acceptance, ciks (sorted, without leading zeros), reason: header lines matched to what was asked for.

    accession and cik: columns of docs with the request. Rows with a reason are rejected, never returned as matches.
    """
    line = lambda label: F.nullif(F.trim(F.regexp_extract(text, rf"(?m)^\s*{label}:\s*(\S.*?)\s*$", 1)), F.lit(""))
    ciks = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"CENTRAL INDEX KEY:\s*(\d{1,10})"), F.lit(1)), lambda c: F.regexp_replace(c, r"^0+(?=\d)", ""))))
    rows = docs.select(doc, F.col(accession).alias("asked_"), F.regexp_replace(F.col(cik).cast("string"), r"^0+(?=\d)", "").alias("cik_"), line("ACCESSION NUMBER").alias("accession"), line("CONFORMED SUBMISSION TYPE").alias("form"), line("FILED AS OF DATE").alias("date_"), line("ACCEPTANCE-DATETIME").alias("acceptance"), ciks.alias("ciks"))
    filed = F.when(F.col("date_").rlike(r"^\d{8}$"), F.try_to_date("date_", "yyyyMMdd"))
    reason = (
        F.when(F.col("accession").isNull(), "no_accession").when(F.col("date_").isNull(), "no_filing_date").when(F.col("form").isNull(), "no_form")
        .when(F.col("accession") != F.col("asked_"), "other_accession").when(~F.array_contains("ciks", F.col("cik_")), "other_registrant").when(filed.isNull(), "bad_filing_date"))
    return rows.select(doc, "accession", "form", filed.alias("filed"), "acceptance", "ciks", reason.alias("reason"))
