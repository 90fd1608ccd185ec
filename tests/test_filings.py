"""Tagged HTML, instances and headers with hand answers."""

from datetime import date

from pitwell.sources import filings as X

HEAD = """<XBRLI:CONTEXT ID="c"><xbrli:startDate>2020-01-01</xbrli:startDate><xbrli:endDate> 2020-12-31 </xbrli:endDate>
<xbrldi:explicitMember dimension="b">v&#x2019;s</xbrldi:explicitMember><xbrldi:explicitMember dimension="a">w</xbrldi:explicitMember></XBRLI:CONTEXT><x:context id='i'><x:instant>2021-02-30</x:instant></x:context>"""


def fact(name, ref, value, more=""):
    return f"<ix:nonNumeric name='dei:{name}' contextRef='{ref}' {more}>{value}</ix:nonNumeric>"


def test_tagged_facts(spark):
    chain = "".join(f"<ix:continuation id='k{k}' continuedAt='k{k + 1}'>p{k}</ix:continuation>" for k in (2, 0, 1, 3, 5, 4)) + "<ix:continuation id='k6'>end</ix:continuation>"
    docs = {
        1: HEAD + fact("DocumentType", "c", "10-K<b title='a > b'> &amp;lt; </b>&#160;x") + fact("Other", "c", "not wanted") + "<ix:nonNumeric name='TradingSymbol' contextref='i'>ab&#x1F600;</ix:nonNumeric>",
        2: HEAD + chain + fact("EntityRegistrantName", "c", "name", "continuedAt='k0'"),
        3: HEAD + "<!-- " + fact("DocumentType", "c", "hidden") + " -->" + fact("EntityRegistrantName", "c", "outer " + fact("TradingSymbol", "c", "inner") + " rest"),
        4: HEAD + fact("DocumentType", "c", " ") + fact("TradingSymbol", "c", "good"),
        5: HEAD + fact("DocumentType", "none", "x"),
        6: HEAD + fact("DocumentType", "c", "x", "continuedAt='nowhere'"),
        7: HEAD + "<ix:continuation id='a' continuedAt='b'>1</ix:continuation><ix:continuation id='b' continuedAt='a'>2</ix:continuation>" + fact("DocumentType", "c", "x", "continuedAt='a'"),
        8: HEAD + "<ix:nonNumeric name='dei:DocumentType'>x</ix:nonNumeric>",
        9: "no tag at all", 10: "", 11: None,
        12: HEAD + "<ix:nonNumeric name='dei:DocumentType' contextRef='c'/>" + "<ix:nonNumeric name='dei:TradingSymbol' contextRef='c'>never closed",
    }
    found = X.tagged_facts(spark.createDataFrame([(k, v, 1) for k, v in docs.items()], "id long, page string, at int"), "id", "page")
    got = sorted((x.id, x.concept, x.context_ref, x.value, x.reason) for x in found.collect())
    assert got == [
        (1, "DocumentType", "c", "10-K &lt; x", None), (1, "TradingSymbol", "i", "ab\U0001f600", None), (2, "EntityRegistrantName", "c", "name p0 p1 p2 p3 p4 p5 end", None),
        (3, "EntityRegistrantName", "c", "outer inner rest", None), (3, "TradingSymbol", "c", "inner", None), (4, "DocumentType", "c", "", "empty_value"), (4, "TradingSymbol", "c", "good", None),
        (5, "DocumentType", "none", "x", "missing_context"), (6, "DocumentType", "c", "x", "missing_continuation"), (7, "DocumentType", "c", got[9][3], "missing_continuation"), (8, "DocumentType", None, "x", "no_context_ref"), (12, "DocumentType", "c", "", "empty_value")]
    one = found.filter("id = 1").orderBy("at").collect()
    assert (one[0].period_start, one[0].period_end, one[0].instant, one[0].dimensions_json) == (date(2020, 1, 1), date(2020, 12, 31), None, '{"a":"w","b":"v’s"}')
    assert (one[1].instant, one[1].dimensions_json) == (None, "{}")
    assert {x.id for x in X.accepted(found, "id").collect()} == {1, 2, 3}


def instance(body, cik="7", extra=""):
    context = f"<c:context id='c'><c:entity><c:identifier>{cik}</c:identifier></c:entity><c:period><c:startDate>2020-01-01</c:startDate><c:endDate>2020-03-31</c:endDate></c:period></c:context>"
    unit = "<c:unit id='u'><c:measure>a</c:measure><c:measure> b </c:measure></c:unit>"
    return f"<DOCUMENT>\n<TYPE>EX-101.INS\n<FILENAME>a.xml\n<TEXT><XBRL><c:xbrl xmlns:c='x' xmlns:dei='y'>{context}{unit}{extra}{body}</c:xbrl></XBRL></TEXT></DOCUMENT>"


def dei(name, value, ref="c", more=""):
    return f"<dei:{name} contextRef='{ref}'{more}>{value}</dei:{name}>"


def test_instance_facts(spark):
    form, shares = dei("DocumentType", "10-Q"), dei("EntityPublicFloat", "12.5", more=" unitRef='u' decimals='1'")
    docs = {
        "fine": instance(form + shares + dei("EntityCentralIndexKey", "0007")), "twice": instance(form + shares + shares), "conflict": instance(form + shares + shares.replace("12.5", "13")),
        "no unit": instance(form + shares.replace("'u'", "'w'")), "no number": instance(form + shares.replace("12.5", "many")), "no context": instance(form + dei("TradingSymbol", "x", "d")),
        "empty": instance(form + dei("TradingSymbol", " \n ")), "other form": instance(dei("DocumentType", "10-K")), "other key": instance(form + dei("EntityCentralIndexKey", "8")),
        "foreign": instance(form, "9"), "same context": instance(form, extra="<c:context id='c'><c:entity><c:identifier>7</c:identifier></c:entity></c:context>"), "nothing": instance("<dei:Unknown contextRef='c'>x</dei:Unknown>"),
        "broken": instance(form + "<dei:TradingSymbol"), "entity": instance(form).replace("<XBRL>", "<XBRL><!DOCTYPE x>"), "two": instance(form) * 2, "none": "text only", "name": instance(form).replace("a.xml", "../a"), "null": None,
        "dimension": instance(form + dei("TradingSymbol", "x", "e"), extra="<c:context id='e'><c:entity><c:identifier>7</c:identifier><c:segment><m dimension='q'/><z:explicitMember xmlns:z='z' dimension='q'>1</z:explicitMember><z:explicitMember xmlns:z='z' dimension='q'>2</z:explicitMember></c:segment></c:entity></c:context>"),
    }
    rows = spark.createDataFrame([(k, v, "0000000007", "10-Q") for k, v in docs.items()], "id string, text string, cik string, form string")
    found = X.instance_facts(rows, "id", "text", "cik", "form")
    reasons = {}
    for x in found.collect():
        reasons.setdefault(x.id, set()).add(x.reason)
    one = {k: next((r for r in v if r), None) for k, v in reasons.items()}
    assert one == {"fine": None, "twice": None, "conflict": "conflicting_facts", "no unit": "unresolved_unit", "no number": "bad_number", "no context": "missing_context", "empty": "empty_value", "other form": "form_mismatch",
                   "other key": "registrant_mismatch", "foreign": "foreign_context", "same context": "duplicate_context", "nothing": "no_facts", "broken": "malformed", "entity": "declarations", "two": "several_instances", "none": "no_instance", "null": "no_instance", "name": "unsafe_name", "dimension": "bad_dimensions"}
    good = [(x.id, x.ordinal, x.concept, x.value, x.unit_measure, x.decimals, x.period_end) for x in X.accepted(found, "id").orderBy("id", "ordinal").collect()]
    day = date(2020, 3, 31)
    assert good == [("fine", 1, "DocumentType", "10-Q", None, None, day), ("fine", 2, "EntityCentralIndexKey", "0007", None, None, day), ("fine", 3, "EntityPublicFloat", "12.5", "a*b", "1", day), ("twice", 1, "DocumentType", "10-Q", None, None, day), ("twice", 2, "EntityPublicFloat", "12.5", "a*b", "1", day)]


def test_headers(spark):
    text = "ACCESSION NUMBER:\t0001-20-3 \nCONFORMED SUBMISSION TYPE: 10-K/A\n FILED AS OF DATE: {}\n  CENTRAL INDEX KEY: 0012\nX CENTRAL INDEX KEY:\t3\n"
    rows = [(1, text.format("20200229"), "0001-20-3", "0000000003"), (2, text.format("20200229"), "0001-20-3", "4"), (3, text.format("20200229"), "0001-20-4", "3"), (4, text.format("20200230"), "0001-20-3", "12"), (5, "", "0001-20-3", "12"), (6, None, "a", "1"), (7, text.format("") + "ACCEPTANCE-DATETIME: 1", "0001-20-3", "12")]
    got = {x.id: x for x in X.filing_headers(spark.createDataFrame(rows, "id long, text string, asked string, cik string"), "id", "text", "asked", "cik").collect()}
    assert [got[k].reason for k in range(1, 8)] == [None, "other_registrant", "other_accession", "bad_filing_date", "no_accession", "no_accession", "bad_filing_date"]  # as in 7, an empty value reads on in the next line
    assert (got[1].form, got[1].filed, got[1].acceptance, got[1].ciks, got[7].acceptance) == ("10-K/A", date(2020, 2, 29), None, ["12", "3"], "1")


def test_instances_without_broadcast(spark):
    """Every side has rows for each document: none may pass the driver, however small its packed table looks."""
    rows = spark.createDataFrame([(k, instance(dei("DocumentType", "10-Q")), "7", "10-Q") for k in range(3)], "id long, text string, cik string, form string")
    found = X.instance_facts(rows, "id", "text", "cik", "form")
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert [(x.id, x.value, x.reason) for x in found.orderBy("id").collect()] == [(k, "10-Q", None) for k in range(3)]
