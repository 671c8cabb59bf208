"""Readers and commands over raw records made from the driver's tables (see raw), each with DuckDB SQL on these tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, topics
from ..operators import resolution, rollups
from ..sources import provenance
from ..sources import records as sources
from . import commands as C
from .documents import reuse_urls
from .raw import day, pick, records, text as words
from .registry import query, re2, table

# What raw writes, in SQL.
FILINGS = """filings AS (
  SELECT 'F' || c_custkey AS filing_uuid, (c_custkey % 3 + 2023)::INT AS filing_year, ['first_quarter', 'second_quarter', 'third_quarter', 'fourth_quarter'][(c_custkey // 3) % 4 + 1] AS filing_period,
    CASE WHEN c_custkey % 5 <> 0 THEN abs(c_acctbal) END AS income, strftime(DATE '2025-01-01' + (c_custkey * 7 % 300)::INT, '%Y-%m-%d') AS dt_posted,
    (c_nationkey + 1)::BIGINT AS registrant_id, 'Firm N' || c_nationkey || ', Inc.' AS registrant_name, 'FIRM N' || c_nationkey AS registrant_key,
    c_custkey % 8 + 100 AS client_id, 'The Client K' || (c_custkey % 8) || ' Group' AS client_name, 'CLIENT K' || (c_custkey % 8) AS client_key, ['US', 'FR'][c_custkey % 2 + 1] AS client_country,
    ['HCR', 'TAX', 'DEF'][c_custkey % 3 + 1] AS code, 'On ' || c_mktsegment AS description, 'Fay' || (c_custkey % 7) || ' Lob' || (c_custkey % 11) AS person_name, CASE WHEN c_custkey % 2 = 0 THEN 'Aide ' || (c_custkey % 5) ELSE '' END AS covered
  FROM customer)"""
HEADS = """heads AS (
  SELECT s_suppkey AS s, 'C' || s_suppkey AS filing_uuid, (s_suppkey % 2 + 2024)::INT AS filing_year, CASE WHEN s_suppkey % 4 = 0 THEN 'registrant' ELSE 'lobbyist' END AS filer_type,
    (s_nationkey + 1)::BIGINT AS registrant_id, 'Firm N' || s_nationkey || ', Inc.' AS registrant_name, 'Fay' || (s_suppkey % 7) || ' Lob' || (s_suppkey % 11) AS person_name FROM supplier)"""
ITEMS = """items AS (
  SELECT p_partkey % (SELECT count(*) FROM supplier) AS s, (p_partkey // (SELECT count(*) FROM supplier))::INT AS item_idx, ['feca', 'he', 'pic'][p_partkey % 3 + 1] AS contribution_type, p_brand AS payee_name, p_partkey % 25 AS n,
    CASE WHEN p_partkey % 7 = 0 THEN 'MARY' || (p_partkey % 25) || ' NAME' || (p_partkey % 25) || ' FOR CONGRESS' WHEN p_partkey % 5 = 1 THEN 'Rep. Xena Name' || (p_partkey % 25) ELSE 'Sen. Mary' || (p_partkey % 25) || ' Name' || (p_partkey % 25) END AS honoree_name,
    CASE WHEN p_partkey % 7 = 0 THEN 'campaign_exact' WHEN p_partkey % 5 = 1 THEN 'lastname_unique' ELSE 'exact' END AS method,
    round(p_retailprice, 2) AS amount, strftime(DATE '2024-12-01' + (p_partkey % 90)::INT, '%Y-%m-%d') AS item_date, p_partkey FROM part)"""
RELEASES = """releases AS (
  SELECT doc_id, 'https://m.example/' || doc_id AS url, CASE doc_id % 3 WHEN 0 THEN 'Medicare and tax notes' WHEN 1 THEN 'On the border' ELSE 'Note ' || doc_id END AS title,
    strftime(DATE '2024-07-01' + (doc_id % 365)::INT, '%Y-%m-%d') AS date, regexp_extract(source, '([0-9]+)$', 1)::INT AS n, text FROM documents)"""
MEMBERS = """members AS (SELECT DISTINCT 'B' || n AS entity_id, 'Mary' || n || ' Name' || n AS name, ['D', 'R'][n % 2 + 1] AS party, 'S' || n AS state, 'senate' AS chamber, n FROM releases)"""
OTHERS = """others AS (
  SELECT (s_suppkey + 3000)::VARCHAR AS house_id, s_suppkey + 3000 AS number, 2025 AS report_year, ['1stQuarter', '2ndQuarter'][s_suppkey % 2 + 1] AS report_type, ['first_quarter', 'second_quarter'][s_suppkey % 2 + 1] AS period,
    'FIRM N' || s_nationkey AS organization_key, 'CLIENT K' || (s_suppkey % 8) AS client_key, CASE WHEN s_suppkey % 10 <> 9 THEN (s_nationkey + 1)::BIGINT END AS registrant_id, s_suppkey % 8 + 100 AS client_id,
    CASE WHEN s_suppkey % 3 <> 0 THEN abs(s_acctbal) END AS income FROM supplier)"""
MONEY = """money AS (SELECT items.*, h.filing_year, h.filer_type, h.registrant_id, h.registrant_name, h.filing_uuid, m.entity_id FROM items JOIN heads h USING (s) JOIN members m USING (n))"""
TOTAL = "sum({0}::DECIMAL(18,2))::DOUBLE"


def given(*parts: str) -> str:
    return "WITH " + ",\n".join(parts)


WHO = "Name3, Mary3"


def views(frames: dict[str, DataFrame], **columns: tuple[str | Column, str | Column, str | Column | None]) -> DataFrame:
    """(view, key, n, total) of several results, one below the other."""
    out = None
    for view, (key, n, total) in columns.items():
        col = lambda c: F.col(c) if isinstance(c, str) else c
        rows = frames[view].select(F.lit(view).alias("view"), col(key).cast("string").alias("key"), col(n).cast("bigint").alias("n"), (F.lit(None) if total is None else col(total)).cast("double").alias("total"))
        out = rows if out is None else out.unionByName(rows)
    return out


# Sources


@query(f"{given(FILINGS)} SELECT filing_uuid, filing_year, filing_period, income, NULL::DOUBLE AS expenses, registrant_id, registrant_key, client_id, client_key, client_country, dt_posted, filing_uuid AS place FROM filings")
def source_filings(spark: SparkSession, sf: str) -> DataFrame:
    rows = records(spark, sf)["filings"]
    return rows.select("filing_uuid", "filing_year", "filing_period", "income", "expenses", "registrant_id", "registrant_key", "client_id", "client_key", "client_country", "dt_posted", F.substring_index("prov", "#", -1).alias("place"))


@query(f"""{given(FILINGS)} SELECT filing_uuid, 0 AS act_idx, code AS issue_code, description, 'HOUSE; SENATE' AS gov_entities FROM filings UNION ALL SELECT filing_uuid, 1, 'BUD', NULL, '' FROM filings""")
def source_activities(spark: SparkSession, sf: str) -> DataFrame:
    return records(spark, sf)["activities"].select("filing_uuid", "act_idx", "issue_code", "description", "gov_entities")


@query(f"{given(FILINGS)} SELECT filing_uuid, 0 AS act_idx, 0 AS person_idx, person_name, upper(person_name) AS person_key, covered AS covered_position FROM filings")
def source_people(spark: SparkSession, sf: str) -> DataFrame:
    return records(spark, sf)["activity_people"].select("filing_uuid", "act_idx", "person_idx", "person_name", "person_key", "covered_position")


@query(f"{given(HEADS, ITEMS)} SELECT filing_uuid, filing_year, filer_type, registrant_id, registrant_name, person_name, false AS no_contributions FROM heads WHERE s IN (SELECT s FROM items)")
def source_contributions(spark: SparkSession, sf: str) -> DataFrame:
    return records(spark, sf)["contributions"].select("filing_uuid", "filing_year", "filer_type", "registrant_id", "registrant_name", "person_name", "no_contributions")


@query(f"""{given(HEADS, ITEMS)} SELECT filing_uuid, item_idx, contribution_type, payee_name, honoree_name, amount, item_date,
  CASE method WHEN 'exact' THEN 'MARY' || n || ' NAME' || n WHEN 'lastname_unique' THEN 'XENA NAME' || n ELSE honoree_name END AS honoree_norm, CASE method WHEN 'exact' THEN 'NAME' || n || '|MARY' || n WHEN 'lastname_unique' THEN 'NAME' || n || '|XENA' ELSE 'CONGRESS|MARY' || n END AS honoree_key
FROM items JOIN heads USING (s)""")
def source_items(spark: SparkSession, sf: str) -> DataFrame:
    return records(spark, sf)["contribution_items"].select("filing_uuid", "item_idx", "contribution_type", "payee_name", "honoree_name", "amount", "item_date", "honoree_norm", "honoree_key")


@query(f"{given(OTHERS)} SELECT house_id, report_year, report_type, organization_key, client_key, registrant_id AS senate_registrant_id, client_id AS senate_client_id, income, NULL::DOUBLE AS expenses FROM others")
def source_other_filings(spark: SparkSession, sf: str) -> DataFrame:
    return records(spark, sf)["other_filings"].select("house_id", "report_year", "report_type", "organization_key", "client_key", "senate_registrant_id", "senate_client_id", "income", "expenses")


@query(f"{given(OTHERS)} SELECT house_id, 0 AS ali_idx, 'TAX' AS issue_code, 'd' || (number - 3000) AS description, 'SENATE' AS federal_agencies FROM others")
def source_other_activities(spark: SparkSession, sf: str) -> DataFrame:
    return records(spark, sf)["other_activities"].select("house_id", "ali_idx", "issue_code", "description", "federal_agencies")


@query(f"""{given(RELEASES)} SELECT url, date, title, 'B' || n AS member_id, 'Mary' || n || ' Name' || n AS member_name, sha256(text) AS text_hash,
  left(date, 7) || '.jsonl#L' || row_number() OVER (PARTITION BY left(date, 7) ORDER BY doc_id) AS place FROM releases""")
def source_releases(spark: SparkSession, sf: str) -> DataFrame:
    return records(spark, sf)["releases"].select("url", "date", "title", "member_id", "member_name", F.sha2("text", 256).alias("text_hash"), F.substring_index("prov", "/", -1).alias("place"))


@query(f"{given(RELEASES, MEMBERS)} SELECT entity_id AS member_id, name, 'NAME' || n || '|MARY' || n AS name_key, party, state, chamber FROM members")
def source_members(spark: SparkSession, sf: str) -> DataFrame:
    return records(spark, sf)["members"].select("member_id", "name", "name_key", "party", "state", "chamber")


@query("""SELECT * FROM (VALUES ('filings#F4', 'F4', NULL), ('contributions#C1', 'C1', NULL), ('filings#none', NULL, 'no such record'), ('releases#L1', 'https://m.example/0', NULL), ('releases#L0', NULL, 'not a line: L0'),
  ('releases#Lx', NULL, 'not a line: Lx'), ('other', 'd1', NULL), ('missing', NULL, 'source file not found')) t(asked, found, error)""")
def provenance_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Raw records behind ids, by the place of each kind of source, and the errors of wrong ones."""
    r = records(spark, sf)
    place = lambda name, column, value: r[name].where(F.col(column) == value).first()["prov"]
    filing, report, release, other = place("filings", "filing_uuid", "F4"), place("contributions", "filing_uuid", "C1"), place("releases", "url", "https://m.example/0"), place("other_filings", "house_id", "3001")
    asked = [("filings#F4", filing, "$.filing_uuid"), ("contributions#C1", report, "$.filing_uuid"), ("filings#none", filing.partition("#")[0] + "#none", "$.filing_uuid"), ("releases#L1", release, "$.url"),
             ("releases#L0", release.partition("#")[0] + "#L0", "$.url"), ("releases#Lx", release.partition("#")[0] + "#Lx", "$.url"), ("other", other, None), ("missing", other + ".gone", None)]
    out = None
    for name, prov, field in asked:
        got = sources.provenance(spark, prov)
        found = F.get_json_object("record", field) if field else F.nullif(F.regexp_extract("record", "<description>([^<]*)<", 1), F.lit(""))
        rows = got.select(F.lit(name).alias("asked"), found.alias("found"), F.regexp_replace("error", "(source file not found).*", "$1").alias("error"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(f"""{given(FILINGS)}, asked AS (SELECT filing_uuid, income, filing_uuid AS key FROM filings WHERE c_custkey % 10 = 0 UNION ALL SELECT filing_uuid || '?', NULL, NULL FROM filings WHERE c_custkey % 70 = 0)
SELECT filing_uuid AS asked, key AS found, income, CASE WHEN key IS NULL THEN 'no such record' END AS error FROM asked
UNION ALL SELECT 'gone/' || filing_uuid, NULL, NULL, 'source file not found' FROM filings WHERE c_custkey % 90 = 0
UNION ALL SELECT 'https://m.example/' || doc_id, 'https://m.example/' || doc_id, NULL, NULL FROM documents WHERE doc_id % 10 = 0
UNION ALL SELECT '' || (s_suppkey + 3000), 'd' || s_suppkey, NULL, NULL FROM supplier WHERE s_suppkey % 10 = 0""".replace("SELECT 'F' || c_custkey AS filing_uuid", "SELECT c_custkey, 'F' || c_custkey AS filing_uuid"))
def provenance_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Every tenth filing, release and XML filing by its id, and ids that lead nowhere, looked up together: byte ranges are read, not files."""
    r = records(spark, sf)
    key = F.regexp_extract("filing_uuid", "[0-9]+", 0).cast("long")
    filings = r["filings"].select(F.col("filing_uuid").alias("asked"), "prov", key.alias("key"))
    wanted = filings.where("key % 10 = 0").unionByName(filings.where("key % 70 = 0").select(words(F.col("asked"), "?").alias("asked"), words(F.col("prov"), "?").alias("prov"), "key"))
    wanted = wanted.unionByName(filings.where("key % 90 = 0").select(words("gone/", F.col("asked")).alias("asked"), words("gone/", F.col("asked"), ".json#", F.col("asked")).alias("prov"), "key")).drop("key")
    number = F.regexp_extract("url", "[0-9]+$", 0).cast("long")
    wanted = wanted.unionByName(r["releases"].where(number % 10 == 0).select(F.col("url").alias("asked"), "prov"))
    wanted = wanted.unionByName(r["other_filings"].where("(house_id - 3000) % 10 = 0").select(F.col("house_id").alias("asked"), "prov"))
    got = provenance.look_up(wanted, r["provenance_index"]).join(wanted, "prov")
    found = F.coalesce(F.get_json_object("record", "$.filing_uuid"), F.get_json_object("record", "$.url"), F.nullif(F.regexp_extract("record", "<description>([^<]*)<", 1), F.lit("")))
    return got.select("asked", found.alias("found"), F.get_json_object("record", "$.income").cast("double").alias("income"), F.regexp_replace("error", "(source file not found).*", "$1").alias("error"))


# Resolution


@query(f"""{given(ITEMS, RELEASES, MEMBERS)} SELECT honoree_name AS name, count(*) AS n_items, {TOTAL.format('amount')} AS total_amount, any_value(entity_id) AS entity_id,
  CASE WHEN any_value(entity_id) IS NULL THEN 'unmatched' ELSE any_value(method) END AS match_method FROM items LEFT JOIN members USING (n) GROUP BY 1""")
def resolved_names(spark: SparkSession, sf: str) -> DataFrame:
    return records(spark, sf)["resolved"].select("name", "n_items", "total_amount", "entity_id", "match_method")


@query(f"{given(ITEMS, RELEASES, MEMBERS)} SELECT count(*) AS items, count(*) FILTER (n IN (SELECT n FROM members)) AS matched FROM items")
def resolution_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return resolution.coverage(records(spark, sf)["resolved"])


@query(f"""{given(FILINGS, OTHERS)},
by_id AS (SELECT house_id AS left_id, min(filing_uuid) AS right_id, 'id_bridge' AS match_method FROM others JOIN filings USING (registrant_id, client_id) GROUP BY 1),
by_name AS (SELECT house_id AS left_id, min(filing_uuid) AS right_id, 'name_bridge' AS match_method FROM others o JOIN filings f ON o.organization_key = f.registrant_key AND o.client_key = f.client_key WHERE house_id NOT IN (SELECT left_id FROM by_id) GROUP BY 1)
SELECT * FROM by_id UNION ALL SELECT * FROM by_name""")
def records_bridge(spark: SparkSession, sf: str) -> DataFrame:
    return records(spark, sf)["bridge"]


@query("""SELECT s_suppkey AS entity_id, CASE WHEN s_suppkey % 2 = 0 THEN 'Full L' || s_suppkey ELSE 'F L' || s_suppkey END AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'L' || s_suppkey || '|FULL' ELSE 'L' || s_suppkey || '|F' END AS key,
  CASE s_suppkey % 3 WHEN 0 THEN 'D' WHEN 1 THEN 'R' ELSE 'I' END AS party, CASE WHEN s_suppkey % 5 = 0 THEN 'YY' ELSE 'XX' END AS state, CASE s_suppkey % 4 WHEN 0 THEN 'Senate' WHEN 2 THEN 'House' ELSE 'old' END AS chamber FROM supplier""")
def roster_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Members with gaps, and a roster of every other one whose chamber stands only in its committee roles."""
    s, all_ = F.col("s_suppkey"), table(spark, sf, "supplier")
    members = all_.select(s.alias("entity_id"), words("F L", s).alias("name"), pick(["Democrat", "Republican", "Independent"], s).alias("party"), F.when(s % 5 != 0, "XX").alias("state"), F.when(s % 2 == 1, "old").alias("chamber"))
    members = members.where("entity_id % 10 <> 0")  # these the roster alone has
    role = F.struct(F.when(s % 4 == 0, "Senate Budget").when(s % 4 == 2, "House Rules").otherwise("Joint Economic").alias("committee"), F.lit("Member").alias("title"))
    joint = F.struct(F.lit("Joint Library").alias("committee"), F.lit("Member").alias("title"))
    roster = all_.where(s % 2 == 0).select(s.alias("entity_id"), words("Full L", s).alias("name"), pick(["D", "R", "I"], s).alias("party"), F.when(s % 5 == 0, "YY").otherwise("ZZ").alias("state"), F.lit(None).cast("string").alias("chamber"), F.array(joint, role).alias("roles"))
    odd = members.where("entity_id % 5 = 0 AND entity_id % 2 = 1").select("entity_id", F.lit("YY").alias("s"))
    merged = resolution.merge_roster(members, roster).join(odd, "entity_id", "left")
    return merged.select("entity_id", "name", "key", "party", F.coalesce("state", "s").alias("state"), "chamber")


@query(f"""{given(RELEASES, MEMBERS)} SELECT asked, (SELECT entity_id FROM members WHERE n = w) AS entity_id FROM (VALUES ('B3', 3), ('Mary4 Name4', 4), ('Name5, Mary5', 5), ('ary6 name6', 6)) t(asked, w)""")
def member_lookup(spark: SparkSession, sf: str) -> DataFrame:
    members, out = records(spark, sf).members(), None
    for asked in ("B3", "Mary4 Name4", "Name5, Mary5", "ary6 name6", "Name", "nobody"):
        rows = resolution.resolve_one(members, asked).select(F.lit(asked).alias("asked"), "entity_id")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("SELECT c_custkey, s_name AS name FROM customer, supplier WHERE contains(s_name, c_custkey::VARCHAR)")
def registry_check(spark: SparkSession, sf: str) -> DataFrame:
    """All customers as queries, by their number and a suffix that the key drops, against all suppliers' names."""
    asked = table(spark, sf, "customer").select("c_custkey", F.concat("c_custkey", F.lit(", Inc.")).alias("query"))
    hits = resolution.registry_hits(asked.select("query"), table(spark, sf, "supplier").select(F.col("s_name").alias("name")))
    return hits.join(asked, "query").select("c_custkey", "name")


@query("""SELECT c_custkey, c_name AS name FROM customer WHERE c_nationkey = 3 AND c_custkey % 2 = 0 AND c_custkey % 9 = 4""")
def candidate_lookup(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("c_custkey")
    people = table(spark, sf, "customer").select("c_custkey", "c_name", words("LAST", c % 9, ", FIRST", c % 5).alias("name"), F.col("c_nationkey").cast("string").alias("state"), pick(["H", "S"], c).alias("office"))
    found = resolution.candidate_search(people, "Other. Last4", "3", "H")  # no such first name: the last one counts
    return found.select("c_custkey", F.col("c_name").alias("name"))


# Commands


@query(f"""{given(ITEMS, HEADS, RELEASES, MEMBERS, MONEY)}
SELECT entity_id, items, total, counterparties, name, party, state, chamber FROM (
  SELECT entity_id, count(*) AS items, {TOTAL.format('amount')} AS total, count(DISTINCT registrant_id) AS counterparties FROM money WHERE filing_year = 2025 AND filer_type = 'lobbyist' GROUP BY 1 ORDER BY total DESC, entity_id LIMIT 25) JOIN members USING (entity_id)""")
def command_gatekeeper(spark: SparkSession, sf: str) -> DataFrame:
    return C.gatekeeper(records(spark, sf), 2025, "lobbyist")


@query(f"""{given(ITEMS, HEADS, RELEASES, MEMBERS, MONEY)}
SELECT 'pay_by_year' AS view, filing_year::VARCHAR AS key, count(*) AS n, {TOTAL.format('amount')} AS total FROM money WHERE n = 3 GROUP BY 2
UNION ALL SELECT * FROM (SELECT 'top_payers', registrant_name, count(*), {TOTAL.format('amount')} AS t FROM money WHERE n = 3 GROUP BY 2 ORDER BY t DESC, registrant_name LIMIT 15)
UNION ALL SELECT 'releases_by_year', left(date, 4), count(*), NULL FROM releases WHERE n = 3 GROUP BY 2
UNION ALL SELECT * FROM (SELECT 'samples', date, 1, NULL FROM releases WHERE n = 3 ORDER BY date DESC LIMIT 5)""")
def command_member(spark: SparkSession, sf: str) -> DataFrame:
    return views(C.member(records(spark, sf), WHO), pay_by_year=("filing_year", "items", "total"), top_payers=("registrant_name", "items", "total"), releases_by_year=("year", "n", None), samples=("date", F.lit(1), None))


@query(f"""{given(FILINGS, OTHERS)}, mine AS (SELECT * FROM filings WHERE contains(client_key, 'CLIENT K3')), other AS (SELECT * FROM others WHERE contains(client_key, 'CLIENT K3'))
SELECT 'by_year' AS view, filing_year::VARCHAR AS key, count(*) AS n, coalesce({TOTAL.format('income')}, 0) AS total FROM mine GROUP BY 2
UNION ALL SELECT * FROM (SELECT 'by_registrant', registrant_name, count(*), coalesce({TOTAL.format('income')}, 0) AS t FROM mine GROUP BY 2 ORDER BY t DESC, registrant_name LIMIT 15)
UNION ALL SELECT 'issues', code, count(*), NULL FROM (SELECT code FROM mine UNION ALL SELECT 'BUD' FROM mine) GROUP BY 2
UNION ALL SELECT 'agencies', a, count(*), NULL FROM mine, (VALUES ('HOUSE'), ('SENATE')) t(a) GROUP BY 2
UNION ALL SELECT 'countries', client_country, count(*), NULL FROM mine GROUP BY 2
UNION ALL SELECT 'other_by_year', report_year::VARCHAR, count(*), coalesce({TOTAL.format('income')}, 0) FROM other GROUP BY 2
UNION ALL SELECT * FROM (SELECT 'samples', filing_uuid, 1, NULL FROM mine ORDER BY filing_year DESC, filing_uuid LIMIT 5)""")
def command_client(spark: SparkSession, sf: str) -> DataFrame:
    found = C.client(records(spark, sf), "The Client K3, Inc.")
    return views(found, by_year=("filing_year", "n", "income"), by_registrant=("registrant_name", "n", "income"), issues=("issue_code", "n", None), agencies=("agency", "n", None), countries=("client_country", "n", None), other_by_year=("report_year", "n", "income"), samples=("filing_uuid", F.lit(1), None))


@query(f"""{given(FILINGS)}, latest AS (SELECT * FROM filings WHERE filing_year = 2025 QUALIFY row_number() OVER (PARTITION BY registrant_id, client_key, filing_period ORDER BY dt_posted DESC, filing_uuid DESC) = 1),
board AS (SELECT client_key, max(client_name) AS client_name, count(*) AS periods, coalesce({TOTAL.format('income')}, 0) AS income, count(DISTINCT registrant_id) AS registrants FROM latest GROUP BY 1 ORDER BY income DESC, client_key LIMIT 15)
SELECT *, round(CASE WHEN lead(income) OVER w > 0 THEN income / lead(income) OVER w END, 1) AS x_over_next, coalesce(round(income / lead(income) OVER w, 1) >= 1.1, false) AS flagged FROM board WINDOW w AS (ORDER BY income DESC, client_key)""")
def command_anomaly(spark: SparkSession, sf: str) -> DataFrame:
    return C.anomaly(records(spark, sf), 2025, 15, 1.1, over_zero=True)


@query(f"""{given(FILINGS, OTHERS)},
l AS (SELECT * FROM others WHERE income IS NOT NULL AND registrant_id IS NOT NULL AND (registrant_id, client_id) IN (SELECT (registrant_id, client_id) FROM filings) QUALIFY row_number() OVER (PARTITION BY registrant_id, client_id, report_type ORDER BY number DESC) = 1),
r AS (SELECT * FROM filings WHERE income IS NOT NULL AND filing_year = 2025 QUALIFY row_number() OVER (PARTITION BY registrant_id, client_id, filing_period ORDER BY dt_posted DESC, filing_uuid DESC) = 1)
SELECT house_id, registrant_id, client_id, l.period, l.income, r.income AS other_income, abs(l.income - r.income) AS gap FROM l JOIN r USING (registrant_id, client_id) WHERE l.period = r.filing_period AND abs(l.income - r.income) >= 100 ORDER BY gap DESC, house_id LIMIT 25""")
def command_mismatch(spark: SparkSession, sf: str) -> DataFrame:
    return C.mismatch(records(spark, sf), 2025, 100).select("house_id", "registrant_id", "client_id", "period", "income", "other_income", "gap")


@query(f"""{given(FILINGS)} SELECT person_name, client_name, count(*) AS n, min(filing_uuid) AS first_uuid FROM filings WHERE contains(upper(person_name), 'FAY2 LOB') AND covered <> '' GROUP BY 1, 2 ORDER BY n DESC, person_name, client_name LIMIT 20""")
def command_lobbyist(spark: SparkSession, sf: str) -> DataFrame:
    # All filings of a year stand in files of one folder; the first by provenance is the first by file and id.
    found = C.lobbyist(records(spark, sf), "Fay2 Lob")
    rows = records(spark, sf)["activity_people"].where("covered_position <> ''").join(records(spark, sf)["filings"].select("filing_uuid", "client_name"), "filing_uuid")
    first = rows.groupBy("person_name", "client_name").agg(F.min("filing_uuid").alias("first_uuid"), F.collect_set("prov").alias("all"))
    return found.join(first, ["person_name", "client_name"]).where(F.array_contains("all", F.col("prov"))).select("person_name", "client_name", "n", "first_uuid")


_TOPIC_LIST = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(said, {re2('(?i)' + '|'.join(p))}) THEN '{t}' END" for t, p in topics.TOPICS.items()) + "], LAMBDA x: x IS NOT NULL)"
TAGGED = f"""tagged AS (SELECT *, {_TOPIC_LIST} AS tags FROM (SELECT *, title || ' ' || left(text, 500) AS said FROM releases))"""


@query(f"""{given(RELEASES, TAGGED)}, mine AS (SELECT * FROM tagged WHERE n = 3 AND len(tags) > 0), each AS (SELECT unnest(tags) AS topic, left(date, 4) AS year, date FROM mine)
SELECT 'topics' AS view, topic AS key, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM mine), 3) AS total FROM each GROUP BY 2 UNION ALL SELECT 'by_year', topic || ' ' || year, count(*), NULL FROM each GROUP BY 2""")
def command_say(spark: SparkSession, sf: str) -> DataFrame:
    return views(C.say(records(spark, sf), WHO), topics=("topic", "n", "share"), by_year=(F.concat_ws(" ", "topic", "year"), "n", None))


AREAS = ["Health", "Taxation", "Immigration", "Energy", "Law", "Native Americans"]


@query(f"""{given(RELEASES, TAGGED)}, s AS (SELECT topic, count(*) AS n FROM (SELECT unnest(tags) AS topic FROM tagged WHERE n = 3) GROUP BY 1),
d AS (SELECT ['Health', 'Taxes & Budget', 'Immigration', 'Energy & Environment', 'Justice & Civil Rights', NULL][p_partkey % 6 + 1] AS topic, count(*) AS n FROM part GROUP BY 1),
b AS (SELECT coalesce(s.topic, d.topic) AS topic, coalesce(round(s.n::DOUBLE / (SELECT sum(n) FROM s), 3), 0) AS say_share, coalesce(round(d.n::DOUBLE / (SELECT sum(n) FROM d WHERE topic IS NOT NULL), 3), 0) AS do_share FROM s FULL JOIN (SELECT * FROM d WHERE topic IS NOT NULL) d ON s.topic = d.topic)
SELECT topic, say_share, do_share, round(say_share - do_share, 3) AS gap, CASE WHEN round(say_share - do_share, 3) >= 0.1 THEN 'says_more' WHEN round(say_share - do_share, 3) <= -0.1 THEN 'does_more' ELSE 'aligned' END AS lean FROM b""")
def command_say_vs_do(spark: SparkSession, sf: str) -> DataFrame:
    areas = table(spark, sf, "part").groupBy(pick(AREAS, F.col("p_partkey")).alias("area")).agg(F.count("*").alias("n"))
    return C.say_vs_do(records(spark, sf), WHO, areas)["gaps"].select("topic", "say_share", "do_share", "gap", "lean")


@query(f"""{given(ITEMS, HEADS, RELEASES, MEMBERS, MONEY)}, mine AS (SELECT * FROM money WHERE n = 3 AND filing_year = 2025 AND filer_type = 'lobbyist')
SELECT 'money_by_month' AS view, left(item_date, 7) AS key, count(*) AS n, {TOTAL.format('amount')} AS total FROM mine GROUP BY 2
UNION ALL SELECT 'releases_by_month', left(date, 7), count(*), NULL FROM releases WHERE n = 3 AND left(date, 4) = '2025' GROUP BY 2
UNION ALL SELECT 'money_by_industry', 'Other', count(*), {TOTAL.format('amount')} FROM mine HAVING count(*) > 0
UNION ALL SELECT 'range', min(item_date) || ' ' || max(item_date), count(*), coalesce({TOTAL.format('amount')}, 0) FROM mine
UNION ALL SELECT * FROM (SELECT 'top_items', 'item', 1, amount FROM mine ORDER BY amount DESC LIMIT 12)
UNION ALL SELECT 'bills', strftime(DATE '2025-01-01' + (p_partkey % 300)::INT, '%Y-%m-%d'), p_partkey, NULL FROM part WHERE p_partkey % 20 = 3""")
def command_timeline(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("p_partkey")
    bills = table(spark, sf, "part").select(words("B", p % 20).alias("entity_id"), day("2025-01-01", p % 300).alias("introduced"), p.alias("number"))
    found = C.timeline(records(spark, sf), WHO, bills=bills)
    return views(found, money_by_month=("period", "n", "total"), releases_by_month=("period", "n", None), money_by_industry=("industry", "n", "total"), range=(F.concat_ws(" ", "first", "last"), "items", "total"), top_items=(F.lit("item"), F.lit(1), "amount"), bills=("introduced", "number", None))


_LONG = r"""s AS (SELECT DISTINCT url, n, date, lower(s) AS low, s FROM (SELECT url, n, date, trim(regexp_replace(unnest(regexp_split_to_array(text, '[\n.]')), '\s+', ' ', 'g')) AS s FROM releases) WHERE length(s) >= 80)"""


@query(f"""{given(RELEASES, _LONG)},
g AS (SELECT low, count(DISTINCT n) AS n_members, string_agg(DISTINCT ['D', 'R'][n % 2 + 1], '' ORDER BY ['D', 'R'][n % 2 + 1]) AS parties, (max(date)::DATE - min(date)::DATE)::INT AS span_days, min(url) AS sample_url, {reuse_urls('url')} AS sample_urls, first(s ORDER BY url, s) AS sentence FROM s GROUP BY 1 HAVING count(DISTINCT n) >= 3),
h AS (SELECT *, regexp_matches(sentence, {re2(text.BILL)})::INT + regexp_matches(sentence, {re2(text.MONEY)})::INT + regexp_matches(sentence, {re2(text.PROPER)})::INT AS specificity FROM g)
SELECT n_members, parties, span_days, specificity, left(sentence, 200) AS sentence, sample_url, sample_urls, low FROM h ORDER BY length(parties) > 1 DESC, specificity DESC, n_members DESC, span_days, low LIMIT 30""")
def command_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return C.clusters(records(spark, sf), min_members=3).withColumn("sample_urls", F.array_join("sample_urls", " "))


@query(f"""{given(RELEASES)}, hits AS (SELECT * FROM releases WHERE left(date, 4) = '2025' AND contains(lower(text), 'of the'))
SELECT 'authors' AS view, 'Mary' || n || ' Name' || n AS key, count(*) AS n, NULL::DOUBLE AS total FROM hits GROUP BY 2 UNION ALL SELECT * FROM (SELECT 'hits', url, 1, NULL FROM hits ORDER BY date, url LIMIT 40)""")
def command_keyword(spark: SparkSession, sf: str) -> DataFrame:
    return views(C.keyword(records(spark, sf), "OF the", year=2025), authors=("label", "n", None), hits=("url", F.lit(1), None))


def _roster(spark: SparkSession, sf: str) -> DataFrame:
    """Roles of the members that have a nation's number."""
    n = F.col("n_nationkey")
    role = lambda title, committee: F.struct(title.alias("title"), F.lit(committee).alias("committee"))
    roles = F.array(role(pick(["Chair", "Ranking Member", "Vice Chair", "Member"], n), "Budget"), role(F.lit("Member"), "Rules"), role(F.lit("Chairman"), "Ethics"), role(F.lit("Member"), "Water"))
    return table(spark, sf, "nation").where(n % 3 != 0).select(words("B", n).alias("entity_id"), F.slice(roles, 1, F.when(n % 2 == 0, 4).otherwise(2)).alias("roles"))


_BOARD = f"""board AS (SELECT n, entity_id, count(*) AS items, {TOTAL.format('amount')} AS total FROM money WHERE filing_year = 2025 AND filer_type = 'lobbyist' GROUP BY 1, 2 ORDER BY total DESC, entity_id LIMIT {{0}})"""


@query(f"""{given(ITEMS, HEADS, RELEASES, MEMBERS, MONEY, _BOARD.format(12))}, t AS (SELECT *, n % 3 <> 0 AS listed, ['CHAIR', 'RANKING', '', ''][n % 4 + 1] AS a, CASE WHEN n % 2 = 0 THEN 'CHAIR' ELSE '' END AS b FROM board)
SELECT 'board' AS view, entity_id || CASE WHEN listed THEN ' ' || a || (CASE WHEN a <> '' AND b <> '' THEN '+' ELSE '' END) || b ELSE ' ' END AS key, CASE WHEN listed THEN CASE WHEN n % 2 = 0 THEN 3 ELSE 2 END END AS n, total FROM t
UNION ALL SELECT 'leaders', 'all', count(*) FILTER (listed AND (a <> '' OR b <> '')), count(*)::DOUBLE FROM t""")
def command_annotate(spark: SparkSession, sf: str) -> DataFrame:
    found = C.annotate(records(spark, sf), _roster(spark, sf))
    return views(found, board=(F.concat("entity_id", F.lit(" "), F.coalesce(F.array_join("tags", "+"), F.lit(""))), F.when(F.col("roles").isNotNull(), F.size("roles")), "total"), leaders=(F.lit("all"), "n", "of"))


@query("""SELECT 'B' || n_nationkey AS entity_id, CASE n_nationkey % 4 WHEN 0 THEN 'CHAIR Budget' WHEN 1 THEN 'RANKING Budget' ELSE '' END || CASE WHEN n_nationkey % 4 < 2 AND n_nationkey % 2 = 0 THEN ', ' ELSE '' END || CASE WHEN n_nationkey % 2 = 0 THEN 'CHAIR Ethics' ELSE '' END AS tags
FROM nation WHERE n_nationkey IN (4, 5, 10)""")
def command_committee(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    for who in ("B4", "B5", "B10", "B3"):
        rows = C.committee(_roster(spark, sf), who).select("entity_id", F.array_join("tags", ", ").alias("tags"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(f"""{given(ITEMS, HEADS, RELEASES, MEMBERS, MONEY, _BOARD.format(12))},
r AS (SELECT s_nationkey AS n, s_suppkey AS candidate, min(abs(s_acctbal)) AS receipts, 2024 AS cycle FROM supplier WHERE s_acctbal <> 0 GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY min(abs(s_acctbal)) DESC, s_suppkey DESC) = 1)
SELECT entity_id, items, total, 'K' || candidate AS candidate, receipts, round(total / nullif(receipts, 0), 4) AS share_of_receipts FROM board LEFT JOIN r USING (n)""")
def command_enrich_finance(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier")
    receipts = s.select(words("B", F.col("s_nationkey")).alias("entity_id"), F.col("s_suppkey").alias("candidate"), F.lit(2024).alias("cycle"), F.abs("s_acctbal").alias("receipts"))
    # Of equal receipts the greatest number counts, not the last name by its letters.
    return C.enrich_finance(records(spark, sf), receipts).select("entity_id", "items", "total", words("K", F.col("candidate")).alias("candidate"), "receipts", "share_of_receipts")


@query(f"""{given(ITEMS, HEADS, RELEASES, MEMBERS, MONEY, _BOARD.format(20))},
a AS (SELECT p_partkey % 20 AS n, ['Health', 'Taxation', 'Immigration', 'Energy', 'Law', 'Native Americans'][p_size % 6 + 1] AS area, count(*) AS k FROM part GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY n ORDER BY k DESC, area) <= 5)
SELECT entity_id, total, string_agg(area || ':' || k, ', ' ORDER BY k DESC, area) AS areas FROM board LEFT JOIN a USING (n) GROUP BY 1, 2""")
def command_enrich_act(spark: SparkSession, sf: str) -> DataFrame:
    bills = table(spark, sf, "part").select(words("B", F.col("p_partkey") % 20).alias("entity_id"), pick(AREAS, F.col("p_size")).alias("area"))
    found = C.enrich_act(records(spark, sf), bills)
    return found.select("entity_id", "total", F.array_join(F.transform("areas", lambda x: F.concat(x["area"], F.lit(":"), x["n"].cast("string"))), ", ").alias("areas"))


@query(f"""{given(ITEMS, HEADS, RELEASES, MEMBERS, MONEY, _BOARD.format(12))} SELECT entity_id, total, yea FROM board LEFT JOIN (SELECT user_id AS n, count(*) FILTER (event_type IN ('click', 'view')) AS yea FROM events WHERE user_id % 2 = 0 GROUP BY 1) USING (n)""")
def command_enrich_votes(spark: SparkSession, sf: str) -> DataFrame:
    profile = table(spark, sf, "events").where("user_id % 2 = 0").groupBy(words("B", F.col("user_id")).alias("entity_id")).agg(F.count_if(F.col("event_type").isin("click", "view")).alias("yea"))
    return C.enrich_votes(records(spark, sf), profile).select("entity_id", "total", "yea")


@query("""
WITH v AS (SELECT user_id AS member, CASE event_type WHEN 'click' THEN 1 WHEN 'purchase' THEN -1 END AS side, strftime(ts, '%Y-%m-%d') AS roll, user_id % 2 AS party FROM events),
p AS (SELECT party, roll, sum(side) AS lean FROM v GROUP BY 1, 2)
SELECT member, count(*) FILTER (side = 1) AS yea, count(*) FILTER (side = -1) AS nay, count(*) FILTER (side IS NOT NULL AND lean <> 0 AND sign(lean) = side) AS with_party FROM v JOIN p USING (party, roll) WHERE member = 7 GROUP BY 1""")
def command_votes(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    code = F.when(F.col("event_type") == "click", "1").when(F.col("event_type") == "purchase", "6").otherwise("9")
    cast = events.select(F.col("user_id").cast("string").alias("member"), F.date_format("ts", "yyyy-MM-dd").alias("roll"), code.alias("code"))
    members = events.select(F.col("user_id").cast("string").alias("member"), (F.col("user_id") % 2).alias("party")).distinct()
    return C.votes(cast, members, "7").select(F.col("member").cast("bigint").alias("member"), "yea", "nay", "with_party")


@query("""WITH v AS (SELECT o_orderkey AS roll, o_orderkey % 40 AS bill, o_orderdate AS date FROM orders WHERE o_custkey % 20 = 3)
SELECT 'area ' || (bill % 6) AS area, count(*) AS n FROM (SELECT * FROM v WHERE bill < 30 ORDER BY date DESC, roll DESC LIMIT 80) GROUP BY 1""")
def command_vote_align(spark: SparkSession, sf: str) -> DataFrame:
    cast = table(spark, sf, "orders").select(words("B", F.col("o_custkey") % 20).alias("member"), F.col("o_orderkey").cast("string").alias("roll"), (F.col("o_orderkey") % 40).alias("bill"), F.col("o_orderdate").alias("date"))
    return C.vote_align(cast, spark.range(30).select(F.col("id").alias("bill"), words("area ", F.col("id") % 6).alias("area")), "B3")


@query("SELECT 'HR' AS type, p_partkey AS number, left(repeat(p_name || ' ', 20), 120) AS title, strftime(DATE '2025-01-01' + (p_partkey % 300)::INT, '%Y-%m-%d') AS introduced FROM part WHERE p_partkey % 20 = 3 ORDER BY introduced DESC, number LIMIT 20")
def command_legislation(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("p_partkey")
    bills = table(spark, sf, "part").select(words("B", p % 20).alias("entity_id"), F.lit("HR").alias("type"), p.alias("number"), F.repeat(words(F.col("p_name"), " "), 20).alias("title"), day("2025-01-01", p % 300).alias("introduced"))
    return C.legislation(bills, "B3")


@query(f"""{given(ITEMS, HEADS)} SELECT CASE WHEN contains(upper(payee_name), '#1') THEN 'One' WHEN contains(upper(payee_name), '#2') THEN 'Two' ELSE 'Other' END AS cluster, count(*) AS items, {TOTAL.format('amount')} AS total, count(DISTINCT registrant_name) AS funders FROM items JOIN heads USING (s) WHERE contribution_type = 'he' GROUP BY 1""")
def honorary_channel(spark: SparkSession, sf: str) -> DataFrame:
    r = records(spark, sf)
    items = r["contribution_items"].join(r["contributions"].select("filing_uuid", "registrant_name"), "filing_uuid")
    return rollups.channel_totals(items, "he", "contribution_type", topics.first_label(F.col("payee_name"), {"One": ["#1"], "Two": ["#2"]}), "amount", "registrant_name")


@query(f"""{given(FILINGS)}, kept AS (SELECT * FROM filings WHERE code = 'TAX') SELECT dimension, value, count(*) AS n, coalesce({TOTAL.format('income')}, 0) AS total FROM (
  SELECT 'filing_year' AS dimension, filing_year::VARCHAR AS value, income FROM kept UNION ALL SELECT 'client_key', client_key, income FROM kept UNION ALL SELECT 'registrant_key', registrant_key, income FROM kept) GROUP BY 1, 2""")
def topic_totals(spark: SparkSession, sf: str) -> DataFrame:
    r = records(spark, sf)
    return rollups.code_totals(r["filings"], r["activities"], "filing_uuid", F.col("issue_code") == "TAX", ["filing_year", "client_key", "registrant_key"], "income")


@query("""
WITH s AS (SELECT event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY (event_id * 7919) % 1009, event_id) <= 40)
SELECT event_type, count(*) AS sampled, count(*) FILTER (value > 50) AS hits, any_value(size) AS size, round(count(*) FILTER (value > 50) * any_value(size)::DOUBLE / count(*), 2) AS estimate FROM s JOIN (SELECT event_type, count(*) AS size FROM events GROUP BY 1) USING (event_type) GROUP BY 1""")
def sample_estimate(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("event_type", "event_id", "value", (F.col("event_id") * 7919 % 1009).alias("h"))
    sample = rollups.cap_per_key(events, ["event_type"], ["h", "event_id"], 40)
    return rollups.extrapolate(sample, events.groupBy("event_type").agg(F.count("*").alias("size")), ["event_type"], F.col("value") > 50)
