"""Functions on literal rows: the traps of names, money, dates, topics and claims."""

import pytest
from pyspark.sql import functions as F

from lodestar.functions import names, text, topics, urls


def values(rows, f, *inputs):
    return [r[0] for r in rows("i int, x string", *enumerate(inputs)).orderBy("i").select(f(F.col("x"))).collect()]


def test_squash_takes_all_white_space(rows):
    assert values(rows, names.squash, " a  b\tc ", None, "") == ["A B C", "", ""]


def test_org_key(rows):
    assert values(rows, names.org_key, "The Acme  Corporation, Inc.", "ACME CORP.", "Semi-Co Holdings", None) == ["ACME", "ACME", "SEMI-", ""]


def test_titles_and_person(rows):
    assert values(rows, names.person_key, "Hon. Rep. Ann Lee", "Sen Bo O'Neil", None) == ["ANN LEE", "BO O NEIL", ""]


def test_last_first(rows):
    got = values(rows, names.last_first_key, "Ann Lee", "Lee, Ann", "Lee, Dr. Ann (X-YY)", "Madonna", "X Y Jr", "", None, ", Ann")
    assert got == ["LEE|ANN", "LEE|ANN", "LEE|ANN", "MADONNA", "JR|X", "", "", "ANN"]


def test_campaign(rows):
    got = values(rows, names.campaign_candidate, "Ann Lee for Congress", "Friends of Bo Ray", "Re-Elect Cy for U.S. Senate Committee", "Health PAC for Congress", "Lee for Congressional Studies", "a b c d e for senate", None)
    assert got == ["ANN LEE", "BO RAY", "CY", None, None, None, None]


def test_money(rows):
    assert values(rows, names.money, "$1,234.50", "", "null", "1.0d", "1_000", " 7 ", "-3", None) == [1234.5, None, None, None, None, 7.0, -3.0, None]


def test_leading_int(rows):
    assert values(rows, names.leading_int, "12ab", " 7", "x", None) == [12, 7, 0, 0]


def test_text_year(rows):
    assert values(rows, names.text_year, "2025", "2025.0", "soon", None) == [2025, 2025, None, None]


def test_topics(rows):
    assert values(rows, topics.topics_in, "Medicare and the tax code", "hai", "AI for farms", None) == [["Health", "Taxes & Budget"], [], ["Tech & Telecom", "Agriculture & Food"], []]
    assert values(rows, topics.area_topic, " Taxation ", "none", None) == ["Taxes & Budget", None, None]
    assert values(rows, topics.issue_topic, " hcr", "ZZZ", None) == ["Health", None, None]
    assert values(rows, topics.first_label, "Acme Pharma Bank", "First Bank", None) == ["Health/Pharma", "Finance", "Other"]


def test_span_needs_whole_dates(rows):
    df = rows("a string, b string", ("2025-01-01", "2025-01-11T00:00"), ("2025-01", "2025-02-01"), (None, "2025-01-01"))
    assert [r[0] for r in df.select(text.day_span(F.col("a"), F.col("b"))).collect()] == [10, 0, 0]


def test_specificity_and_bills(rows):
    assert values(rows, text.specificity, "H.R. 12 gives $5 to Acme Big Town", "nothing") == [3, 0]
    assert values(rows, text.bill_kind, "HR 8739", "H J Res 1", "PN 3", None) == ["hr", "hjres", None, None]
    assert values(rows, text.bill_number, "HR 8739", "S12x") == ["8739", None]


def test_claims(rows):
    flags = values(rows, text.claim_flags, 'She said "we will pay it all" for $5 million.', "In 2025, 12% fell.", "Plain words here.")
    assert flags == [["dollar_amount", "direct_quote", "attribution"], ["percentage", "date"], []]
    assert values(rows, lambda c: text.claim_type(text.claim_flags(c)), 'A said "enough of this"', "It cost $5", "The first one", "Plain") == ["quote", "statistic", "comparison_or_superlative", "general_assertion"]
    assert values(rows, text.multi_claim, "5 more than before", "five more", "5 dogs") == [True, False, False]
    assert values(rows, text.claim_terms, "First of the first 5, and first $5")[0][:2] == ["$5", "5,"]


def test_sentences(spark):
    paragraphs = ["Mr. Lee paid 3.5 dollars. Then he left! \"Why?\" Nobody knew", None, "  ", "One.  Two of Acme Inc.\n Three vs. Four? Five", "A. B. C.", "No. Yes. Dr.  Ray. x"]
    frame = spark.createDataFrame([(i, p) for i, p in enumerate(paragraphs)], "i int, p string")
    got = {r["i"]: r["s"] for r in frame.select("i", text.split_sentences(F.col("p")).alias("s")).collect()}
    assert got[0] == ["Mr. Lee paid 3.5 dollars.", "Then he left!", "\"Why?\" Nobody knew"] and got[1] == [] and got[2] == []
    assert got[3] == ["One.", "Two of Acme Inc.\n Three vs. Four?", "Five"] and got[4] == ["A.", "B.", "C."] and got[5] == ["No. Yes.", "Dr.  Ray. x"]


def test_quote_and_thousands(rows):
    long = "One sentence is here. " * 40
    got = values(rows, text.trim_quote, long, "short")
    assert got[1] == "short" and len(got[0]) <= 486 and got[0].endswith(". [...]")
    assert values(rows, text.drop_thousands, "1,234,567 and 1,23") == ["1234567 and 1,23"]


@pytest.mark.parametrize(("url", "tier"), [("https://www.sec.gov/x", "primary"), ("http://data.cms.gov", "primary"), ("https://a.b.mil/", "primary"), ("https://user@en.wikipedia.org:80/x", "unacceptable"), ("https://x.edu", "authoritative_secondary"), ("https://notnpr.org", "unknown"), ("nonsense", "unknown")])
def test_tiers(rows, url, tier):
    assert values(rows, lambda c: urls.tier(urls.host(c)), url) == [tier]


def test_like_escapes_wildcards(rows):
    df = rows("x string", ("100% sure",), ("100 sure",))
    assert df.where(names.like_literal(F.col("x"), "100%")).count() == 1


def test_name_list(rows):
    df = rows("n array<struct<name:string>>", ([("b",), (" a ",), ("b",), ("",), (None,)],), (None,))
    assert [r[0] for r in df.select(names.name_list(F.col("n"))).collect()] == ["a; b", None]
