"""The commands end to end over invented files."""

import json

import pytest

from lodestar.plans import commands as C


def sets(df, *columns):
    return {tuple(r[c] for c in (columns or df.columns)) for r in df.collect()}


@pytest.fixture(scope="module")
def records(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("raw")
    filing = lambda uuid, client, income, posted, period="first_quarter", reg=1: {"filing_uuid": uuid, "filing_year": 2025, "filing_period": period, "income": income, "dt_posted": posted, "registrant": {"id": reg, "name": "Big Firm LLC"}, "client": {"id": 10 + len(client), "name": client, "country": "XX"}, "lobbying_activities": [{"general_issue_code": "TAX", "government_entities": [{"name": "SENATE"}], "lobbyists": [{"first_name": "Lo", "last_name": "By", "covered_position": "Aide"}]}]}
    (root / "filings_2025.json").write_text(json.dumps([filing("a", "Acme Inc", "100000", "2025-04-01"), filing("b", "Acme Inc", "900000", "2025-03-01"), filing("c", "Beta", "10000", "2025-04-01")]))
    items = [{"honoree_name": "Sen. Ann Lee", "amount": "1,000", "date": "2025-01-05", "payee_name": "p"}, {"honoree_name": "Lee for Congress", "amount": "500", "date": "2025-02-05"}, {"honoree_name": "Bo Ray", "amount": "70", "date": "2025-02-06"}]
    (root / "contributions_2025.json").write_text(json.dumps([{"filing_uuid": "r", "filing_year": 2025, "filer_type": "lobbyist", "registrant": {"id": 1, "name": "Pharma Works"}, "contribution_items": items}]))
    folder = root / "other" / "2025_1stQuarter_XML"
    folder.mkdir(parents=True)
    for i, income in ((300, 20), (301, 5)):
        (folder / f"{i}.xml").write_text(f"<F><organizationName>Big Firm</organizationName><clientName>Acme</clientName><senateID>1-18</senateID><reportYear>2025</reportYear><income>{income}</income></F>")
    press = root / "releases" / "2025"
    press.mkdir(parents=True)
    text = "We will protect hospital funding in every single county of this great state for all of our families. More"
    people = [("A", "Ann Lee", "D"), ("B", "Bo Ray", "R")]
    (press / "2025-01.jsonl").write_text("\n".join(json.dumps({"url": f"u{i}", "date": f"2025-01-0{i + 1}", "title": "Medicare" if i == 0 else "Tax", "text": text, "member": {"bioguide_id": m, "name": n, "party": p}}) for i, (m, n, p) in enumerate(people)))
    out = str(tmp_path_factory.mktemp("tables"))
    C.ingest(spark, str(root), out)
    r = C.Records(spark, out)
    r.resolve()
    r.build_bridge()
    return r


def test_money(records):
    assert sets(C.gatekeeper(records), "entity_id", "items", "total", "counterparties") == {("A", 2, 1500.0, 1), ("B", 1, 70.0, 1)}
    assert C.gatekeeper(records, 2024).count() == 0 and C.gatekeeper(records, 2025, "lobbyist", 1, dedup=True).count() == 1
    m = C.member(records, "Lee, Ann")
    assert sets(m["pay_by_year"]) == {(2025, 2, 1500.0)} and sets(m["top_payers"], "registrant_name") == {("Pharma Works",)} and m["samples"].count() == 1
    t = C.timeline(records, "A")
    assert sets(t["money_by_month"]) == {("2025-01", 1, 1000.0), ("2025-02", 1, 500.0)} and sets(t["money_by_industry"], "industry") == {("Health/Pharma",)}
    assert "bills" not in t and C.timeline(records, "A", 2024)["money_by_month"].count() == 0
    assert sets(t["range"], "first", "last") == {("2025-01-05", "2025-02-05")} and t["top_items"].first()["amount"] == 1000.0


def test_filings(records):
    # The later version counts, though its income is smaller.
    assert sets(C.anomaly(records), "client_key", "income", "x_over_next", "flagged") == {("ACME", 100000.0, 10.0, True), ("BETA", 10000.0, None, False)}
    got = C.mismatch(records)
    assert sets(got, "house_id", "income", "other_income", "gap") == {("301", 5.0, 100000.0, 99995.0)} and C.mismatch(records, 2024).count() == 0
    c = C.client(records, "acme, inc.")
    assert sets(c["by_year"]) == {(2025, 2, 1000000.0)} and sets(c["issues"]) == {("TAX", 2)} and sets(c["agencies"]) == {("SENATE", 2)} and sets(c["other_by_year"], "n") == {(2,)}
    assert sets(C.lobbyist(records, "Lo By"), "client_name", "n", "covered_position") == {("Acme Inc", 2, "Aide"), ("Beta", 1, "Aide")}
    assert sets(C.registry(records, ["Acme Corp"], records["filings"].selectExpr("client_name AS name").distinct()), "name") == {("Acme Inc",)}


def test_words(records, rows):
    s = C.say(records, "A")
    assert sets(s["topics"], "topic", "n", "share") == {("Health", 1, 1.0)} and sets(s["by_year"], "year") == {("2025",)}
    v = C.say_vs_do(records, "A", rows("area string, n int", ("Taxation", 3), ("Health", 1)))
    assert sets(v["says_more"], "topic", "gap") == {("Health", 0.75)} and sets(v["does_more"], "topic") == {("Taxes & Budget",)}
    found = C.clusters(records, 2025, "2025-01-01", "2025-12-31", min_members=2).first()
    assert (found["n_members"], found["parties"], found["span_days"]) == (2, "DR", 1)
    k = C.keyword(records, "HOSPITAL funding")
    assert sets(k["authors"]) == {("Ann Lee", 1), ("Bo Ray", 1)} and k["hits"].count() == 2


def test_topics_are_sought_in_one_members_texts_only(records, rows):
    # A filter on tags below the join would read all patterns in all texts.
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    found = [*C.say(records, "A").values(), C.say_vs_do(records, "A", rows("area string, n int", ("Taxation", 3)))["gaps"]]
    assert not any("RLIKE" in plan(df) for df in found)
    assert C.say(records, "nobody")["topics"].count() == 0


def test_enrichment(records, rows):
    roster = rows("entity_id string, roles array<struct<title:string>>", ("A", [("Chair",), ("Member",)]))
    a = C.annotate(records, roster)
    assert sets(a["leaders"]) == {(1, 2)}
    receipts = rows("entity_id string, candidate string, cycle int, receipts double", ("A", "x", 2026, 3000.0))
    assert sets(C.enrich_finance(records, receipts), "entity_id", "share_of_receipts") == {("A", 0.5), ("B", None)}
    assert sets(C.enrich_votes(records, rows("entity_id string, yea int", ("B", 4))), "entity_id", "yea") == {("A", None), ("B", 4)}
    assert C.enrich_act(records, rows("entity_id string, area string", ("A", "Health"), ("A", "Health"), ("A", "Law"))).where("entity_id = 'A'").first()["areas"][0]["n"] == 2


def test_profile_and_review(records, rows, spark):
    p = C.profile(rows("x int, y int, t string", *((i % 20, 2 * (i % 20), "a") for i in range(60))))
    assert sets(p["correlations"]) == {("x", "y", 1.0)} and "histogram_x" in p
    prov = records["contributions"].first()["prov"]
    assert json.loads(C.provenance(spark, prov).first()["record"])["filing_uuid"] == "r"
