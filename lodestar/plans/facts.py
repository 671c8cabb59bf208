"""Queries over orders, lines, parts, people and events."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names, text, topics
from ..operators import integrity, ranking, resolution, rollups
from ..scratch import shared_folder
from ..sources import cases
from .registry import made_once, query, table


def order_year() -> Column:
    return F.year("o_orderdate")


def sold(spark: SparkSession, sf: str) -> DataFrame:
    """Lines with their orders."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_returnflag", "l_shipdate")
    return lines.join(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus"), F.col("l_orderkey") == F.col("o_orderkey"))


@query("""
WITH latest AS (
  SELECT o_custkey, year(o_orderdate) AS y, o_totalprice FROM orders
  QUALIFY row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderdate DESC, o_orderkey DESC) = 1),
board AS (
  SELECT o_custkey, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS income, count(*) AS periods FROM latest GROUP BY 1 ORDER BY income DESC, o_custkey LIMIT 15)
SELECT o_custkey, periods, income, round(CASE WHEN lead(income) OVER w > 0 THEN income / lead(income) OVER w END, 1) AS x_over_next,
  coalesce(round(income / lead(income) OVER w, 1) >= 1.1, false) AS flagged FROM board WINDOW w AS (ORDER BY income DESC, o_custkey)""")
def latest_per_key_outliers(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").withColumn("y", order_year())
    latest = ranking.latest_per_key(orders, ["o_custkey", "y"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    board = latest.groupBy("o_custkey").agg(F.count("*").alias("periods"), ranking.exact_sum("o_totalprice").alias("income"))
    order = [F.desc("income"), F.asc("o_custkey")]
    return ranking.ratio_to_next(ranking.top(board, order, 15), "income", order, 1.1, over_zero=True)


@query("""
SELECT s_suppkey, s_name, n_name, count(*) AS items, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS total, count(DISTINCT o_custkey) AS counterparties
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
WHERE year(o_orderdate) = 1998 AND l_returnflag = 'N' GROUP BY 1, 2, 3 ORDER BY total DESC, s_suppkey LIMIT 25""")
def recipient_leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    # Aggregated by the key before names are joined: the joins see one row for each supplier.
    facts = sold(spark, sf).where((order_year() == 1998) & (F.col("l_returnflag") == "N"))
    board = ranking.leaderboard(facts, ["l_suppkey"], "l_extendedprice", "o_custkey")
    top = ranking.top(board, [F.desc("total"), F.asc("l_suppkey")], 25)
    named = top.join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return named.select("s_suppkey", "s_name", "n_name", "items", "total", "counterparties")


@query("""SELECT o_custkey, year(o_orderdate) AS year, count(*) AS n, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total FROM orders GROUP BY 1, 2""")
def entity_by_year(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").groupBy("o_custkey", order_year().alias("year")).agg(F.count("*").alias("n"), ranking.exact_sum("o_totalprice").alias("total"))


@query("""
SELECT o_custkey, l_suppkey, total FROM (
  SELECT o_custkey, l_suppkey, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY total DESC, l_suppkey) <= 3""")
def entity_top_counterparties(spark: SparkSession, sf: str) -> DataFrame:
    totals = sold(spark, sf).groupBy("o_custkey", "l_suppkey").agg(ranking.exact_sum("l_extendedprice").alias("total"))
    ranked = totals.withColumn("r", F.row_number().over(ranking.Window.partitionBy("o_custkey").orderBy(F.desc("total"), "l_suppkey")))
    return ranked.where("r <= 3").drop("r")


@query("""SELECT o_custkey, o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 5""")
def entity_samples(spark: SparkSession, sf: str) -> DataFrame:
    ranked = table(spark, sf, "orders").withColumn("r", F.row_number().over(ranking.Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))))
    return ranked.where("r <= 5").select("o_custkey", "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


WORD = "RED"
_FOOT = "lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey WHERE contains(upper(p_name), 'RED')"


def footprint(spark: SparkSession, sf: str) -> DataFrame:
    """All lines of parts whose name contains the word."""
    parts = table(spark, sf, "part").where(names.like_literal(F.col("p_name"), WORD))
    return sold(spark, sf).join(parts, F.col("l_partkey") == F.col("p_partkey"))


#: The views of a footprint and what each groups by: one aggregation makes all of them.
VIEWS = {"by_year": ["year"], "registrants": ["l_suppkey"], "issues": ["p_type"], "agencies": ["p_brand", "o_custkey"], "other_source_by_year": ["ship_year", "l_returnflag"]}


def footprint_sets(spark: SparkSession, sf: str) -> DataFrame:
    """(view, the columns of VIEWS, n, total) of all views: one scan of the lines, one shuffle."""
    rows = footprint(spark, sf).withColumns({"year": order_year(), "ship_year": F.year("l_shipdate")})
    return rollups.grouped_views(rows, VIEWS, F.count("*").alias("n"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("total"))


def footprint_view(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """One view of footprint_sets; the sets are made once for given tables and kept by what their files are like."""
    return made_once(spark, sf, ("lineitem", "orders", "part"), "footprint", footprint_sets).where(F.col("view") == name).select(*VIEWS[name], "n", F.col("total").cast("double").alias("total"))


@query(f"""SELECT 'by_year' AS view, year(o_orderdate)::VARCHAR AS key, NULL AS second, count(*) AS n, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS total FROM {_FOOT} GROUP BY 2
UNION ALL SELECT 'registrants', l_suppkey::VARCHAR, NULL, count(*), sum(l_extendedprice::DECIMAL(18,2))::DOUBLE FROM {_FOOT} GROUP BY 2
UNION ALL SELECT 'issues', p_type, NULL, count(*), sum(l_extendedprice::DECIMAL(18,2))::DOUBLE FROM {_FOOT} GROUP BY 2
UNION ALL SELECT 'agencies', p_brand, o_custkey::VARCHAR, count(*), sum(l_extendedprice::DECIMAL(18,2))::DOUBLE FROM {_FOOT} GROUP BY 2, 3
UNION ALL SELECT 'other_source_by_year', year(l_shipdate)::VARCHAR, l_returnflag, count(*), sum(l_extendedprice::DECIMAL(18,2))::DOUBLE FROM {_FOOT} GROUP BY 2, 3""")
def footprint_views(spark: SparkSession, sf: str) -> DataFrame:
    """All views of a footprint in one table, from one aggregation."""
    key = F.coalesce(*(F.when(F.col("view") == v, F.col(c[0]).cast("string")) for v, c in VIEWS.items()))
    second = F.coalesce(*(F.when(F.col("view") == v, F.col(c[1]).cast("string")) for v, c in VIEWS.items() if len(c) > 1))
    return footprint_sets(spark, sf).select("view", key.alias("key"), second.alias("second"), "n", F.col("total").cast("double").alias("total"))


@query(f"SELECT year(o_orderdate) AS year, count(*) AS n, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS total FROM {_FOOT} GROUP BY 1")
def footprint_by_year(spark: SparkSession, sf: str) -> DataFrame:
    return footprint_view(spark, sf, "by_year")


@query(f"SELECT l_suppkey, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS total FROM {_FOOT} GROUP BY 1 ORDER BY total DESC, l_suppkey LIMIT 15")
def footprint_registrants(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.top(footprint_view(spark, sf, "registrants").drop("n"), [F.desc("total"), F.asc("l_suppkey")], 15)


@query(f"SELECT p_type, count(*) AS n FROM {_FOOT} GROUP BY 1 ORDER BY n DESC, p_type LIMIT 15")
def footprint_issues(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.top(footprint_view(spark, sf, "issues").drop("total"), [F.desc("n"), F.asc("p_type")], 15)


@query(f"SELECT p_brand, count(DISTINCT o_custkey) AS n FROM {_FOOT} GROUP BY 1 ORDER BY n DESC, p_brand LIMIT 10")
def footprint_agencies(spark: SparkSession, sf: str) -> DataFrame:
    """The view has a row for each brand and customer: distinct customers are its rows."""
    counted = footprint_view(spark, sf, "agencies").groupBy("p_brand").agg(F.count("*").alias("n"))
    return ranking.top(counted, [F.desc("n"), F.asc("p_brand")], 10)


@query("SELECT DISTINCT n_name FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE contains(upper(p_name), 'RED')")
def footprint_countries(spark: SparkSession, sf: str) -> DataFrame:
    keys = footprint_view(spark, sf, "registrants").select("l_suppkey")
    return keys.join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("n_name").distinct()


@query(f"SELECT year(l_shipdate) AS year, l_returnflag, count(*) AS n FROM {_FOOT} GROUP BY 1, 2")
def footprint_other_source_by_year(spark: SparkSession, sf: str) -> DataFrame:
    return footprint_view(spark, sf, "other_source_by_year").select(F.col("ship_year").alias("year"), "l_returnflag", "n")


@query(f"SELECT l_orderkey, l_linenumber, p_name FROM {_FOOT} ORDER BY l_orderkey, l_linenumber LIMIT 5")
def footprint_samples(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.top(footprint(spark, sf), [F.asc("l_orderkey"), F.asc("l_linenumber")], 5).select("l_orderkey", "l_linenumber", "p_name")


@query("""
WITH l AS (SELECT o_custkey AS k, year(o_orderdate)::INT AS y, o_totalprice AS v FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderdate DESC, o_orderkey DESC) = 1),
r AS (SELECT o_custkey AS k, year(o_orderdate)::INT AS y, l_extendedprice AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag <> 'R' QUALIFY row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY l_shipdate DESC, l_extendedprice DESC) = 1)
SELECT k, y, l.v AS left_value, r.v AS right_value, abs(l.v - r.v) AS gap FROM l JOIN r USING (k, y) WHERE abs(l.v - r.v) >= 50000""")
def cross_source_gap(spark: SparkSession, sf: str) -> DataFrame:
    """The last order of a customer and year against the last line that wasn't returned: many versions of each key on both sides."""
    left = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), order_year().alias("y"), F.col("o_totalprice").alias("v"), "o_orderdate", "o_orderkey")
    kept = sold(spark, sf).where("l_returnflag <> 'R'")
    right = kept.select(F.col("o_custkey").alias("k"), order_year().alias("y"), F.col("l_extendedprice").alias("v"), "l_shipdate")
    return rollups.cross_source_gap(left, right, ["k", "y"], "v", [F.desc("o_orderdate"), F.desc("o_orderkey")], [F.desc("l_shipdate"), F.desc("v")], 50000)


@query("""SELECT l_suppkey, p_brand, count(*) AS n, arg_min(l_orderkey * 10 + l_linenumber, l_orderkey * 10 + l_linenumber) AS prov
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand <> '' GROUP BY 1, 2 ORDER BY n DESC, l_suppkey, p_brand LIMIT 20""")
def pair_counts_with_sample(spark: SparkSession, sf: str) -> DataFrame:
    rows = sold(spark, sf).join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).where("p_brand <> ''").withColumn("prov", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    pairs = rows.groupBy("l_suppkey", "p_brand").agg(F.count("*").alias("n"), rollups.sample_by(["prov"], ["prov"]).alias("s"))
    return ranking.top(pairs, [F.desc("n"), F.asc("l_suppkey"), F.asc("p_brand")], 20).select("l_suppkey", "p_brand", "n", "s.prov")


_ORG = "trim(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(upper({0}), '\\s+', ' ', 'g')), '[.,/#!$%^&*;:{{}}=_`~()\"'']', ' ', 'g'), '\\b(INCORPORATED|INC|CORPORATION|CORP|COMPANY|CO|LLC|L L C|LLP|LP|LTD|PLLC|PC|PA|LIMITED|HOLDINGS|GROUP|THE)\\b', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(f"SELECT s_suppkey, {_ORG.format('s_name')} AS key, {_ORG.format(chr(39) + 'The  ' + chr(39) + ' || s_name || ' + chr(39) + ', Inc.' + chr(39))} AS dressed FROM supplier")
def norm_org_keys(spark: SparkSession, sf: str) -> DataFrame:
    dressed = F.concat(F.lit("The  "), F.col("s_name"), F.lit(", Inc."))
    return table(spark, sf, "supplier").select("s_suppkey", names.org_key(F.col("s_name")).alias("key"), names.org_key(dressed).alias("dressed"))


@query("""SELECT c_custkey, split_part(upper(c_name), '#', 2) || '|' || split_part(upper(c_name), '#', 1) AS straight,
  upper(split_part(c_name, '#', 2)) || '|' || upper(split_part(c_name, '#', 1)) AS turned, upper(split_part(c_name, '#', 1)) || ' ' || split_part(c_name, '#', 2) AS person FROM customer""")
def person_keys(spark: SparkSession, sf: str) -> DataFrame:
    first, last = F.substring_index("c_name", "#", 1), F.substring_index("c_name", "#", -1)
    return table(spark, sf, "customer").select(
        "c_custkey",
        names.last_first_key(F.concat(F.lit("Sen. "), first, F.lit(" "), last, F.lit(" (R-XX)"))).alias("straight"),
        names.last_first_key(F.concat(last, F.lit(", Dr. "), first)).alias("turned"),
        names.person_key(F.concat(F.lit("Hon. Rep. "), first, F.lit("  "), last)).alias("person"),
    )


@query("SELECT o_orderkey, o_totalprice AS amount, NULL::DOUBLE AS bad, (o_orderkey % 7)::BIGINT AS id FROM orders")
def money_parse(spark: SparkSession, sf: str) -> DataFrame:
    shown = F.concat(F.lit("$"), F.format_number("o_totalprice", 2))
    return table(spark, sf, "orders").select("o_orderkey", names.money(shown).alias("amount"), names.money(F.concat(F.col("o_orderpriority"), F.lit("null"))).alias("bad"), names.leading_int(F.concat(F.lit("  "), F.col("o_orderkey") % 7, F.lit("x"))).alias("id"))


def _people(spark: SparkSession, sf: str, name: str, key: str, label: str) -> DataFrame:
    """(entity_id, name) from numbered names, with fewer distinct first and last names than people."""
    n = F.col(key)
    person = F.concat(F.lit("F"), n % 7, F.lit(" L"), F.floor(n / 3) % 97)
    return table(spark, sf, name).select(n.alias(label), person.alias("name"))


@query("""
WITH members AS (SELECT s_suppkey AS id, 'L' || ((s_suppkey // 3) % 97) AS last, 'L' || ((s_suppkey // 3) % 97) || '|F' || (s_suppkey % 7) AS key FROM supplier),
k AS (SELECT key, count(DISTINCT id) AS n, min(id) AS id FROM members GROUP BY 1), l AS (SELECT last, count(DISTINCT id) AS n, min(id) AS id FROM members GROUP BY 1),
items AS (SELECT c_custkey % 4 = 1 AS campaign, 'F' || (c_custkey % 7) || ' L' || ((c_custkey // 3) % 97) AS person, 'L' || ((c_custkey // 3) % 97) AS last, 'L' || ((c_custkey // 3) % 97) || '|F' || (c_custkey % 7) AS key, c_acctbal FROM customer),
g AS (SELECT CASE WHEN campaign THEN 'Re-Elect ' || person || ' for U.S. Senate' ELSE person END AS name, campaign, key, last, count(*) AS n_items, sum(c_acctbal::DECIMAL(18,2))::DOUBLE AS total_amount FROM items GROUP BY 1, 2, 3, 4),
m AS (SELECT g.*, CASE WHEN k.n = 1 THEN k.id WHEN k.n IS NULL AND l.n = 1 THEN l.id END AS entity_id, CASE WHEN k.n = 1 THEN 'exact' WHEN k.n > 1 THEN 'ambiguous_key' WHEN l.n = 1 THEN 'lastname_unique' ELSE 'unmatched' END AS method
  FROM g LEFT JOIN k ON g.key = k.key LEFT JOIN l ON g.last = l.last)
SELECT name, CASE WHEN campaign THEN 'SENATE|REELECT' ELSE key END AS key, n_items, total_amount, entity_id, CASE WHEN NOT campaign THEN method WHEN entity_id IS NOT NULL THEN 'campaign_' || method ELSE 'unmatched' END AS match_method FROM m""")
def resolve_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """Every fourth name is a campaign committee's, whose own last word is nobody's name."""
    members = _people(spark, sf, "supplier", "s_suppkey", "entity_id")
    index = resolution.alias_index(members, members)
    people = _people(spark, sf, "customer", "c_custkey", "id")
    shown = people.withColumn("name", F.when(F.col("id") % 4 == 1, F.concat(F.lit("Re-Elect "), "name", F.lit(" for U.S. Senate"))).otherwise(F.col("name")))
    items = shown.join(table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("amount")), "id")
    return resolution.resolve_names(items, index).withColumn("key", F.replace("key", F.lit("RE-ELECT"), F.lit("REELECT")))


@query("""SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'FAY LOB' || c_custkey WHEN 1 THEN 'FAY LOB' || c_custkey WHEN 2 THEN 'FAY LOB' || c_custkey END AS person FROM customer""")
def campaign_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names of committees of each form, and three that aren't of a person."""
    k = F.col("c_custkey")
    person = F.concat(F.lit("Fay  Lob"), k)
    forms = [F.concat(F.lit("The "), person, F.lit(" for U.S. Congress Committee.")), F.concat(F.lit("Friends of "), person), F.concat(F.lit("committee to re-elect "), person), F.concat(F.lit("Friends of the "), person, F.lit(" fund")), F.concat(F.lit("A B C D "), person, F.lit(" for Senate")), person]
    name = F.element_at(F.array(*forms), (k % 6 + 1).cast("int"))
    return table(spark, sf, "customer").select("c_custkey", names.campaign_candidate(name).alias("person"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN year(o_orderdate)::INT WHEN 1 THEN year(o_orderdate)::INT END AS year,
  CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE (DATE '1999-01-01' - o_orderdate::DATE)::INT END AS days FROM orders""")
def text_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Years and spans of days from text: whole dates, times after them, and text that is no date."""
    k, iso = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    year = F.element_at(F.array(F.substring(iso, 1, 4), F.concat(F.lit(" "), F.substring(iso, 1, 4), F.lit(".0")), F.concat(F.lit("FY"), F.substring(iso, 1, 4)), F.lit("")), (k % 4 + 1).cast("int"))
    first = F.when(k % 5 == 0, F.substring(iso, 1, 7)).when(k % 5 == 1, F.concat(iso, F.lit("T10:00:00Z"))).otherwise(iso)
    return table(spark, sf, "orders").select("o_orderkey", names.text_year(year).alias("year"), text.day_span(first, F.lit("1999-01-01")).alias("days"))


@query("""WITH x AS (SELECT o_orderkey, ((o_orderkey * 7919) % 100003)::DOUBLE / 97.0 AS v FROM orders)
SELECT o_orderkey, printf('%.0f', v) || ' ' || printf('%.1f', v) || ' ' || printf('%.2f', v) || ' ' || printf('%.3f', v) AS shown, 'of ' || printf('%.2f', v * 1000) || ' and 1,23' AS bare FROM x""")
def number_renderings(spark: SparkSession, sf: str) -> DataFrame:
    v = ((F.col("o_orderkey") * 7919) % 100003).cast("double") / 97.0
    line = F.concat(F.lit("of "), F.format_number(v * 1000, 2), F.lit(" and 1,23"))
    return table(spark, sf, "orders").select("o_orderkey", F.array_join(text.renderings(v), " ").alias("shown"), text.drop_thousands(line).alias("bare"))


_BRIDGE = """
WITH l AS (SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_linenumber % 2 = 1 THEN l_suppkey END AS r, CASE WHEN l_linenumber % 2 = 1 THEN l_partkey END AS c, 'S' || l_suppkey AS rn, 'P' || (l_partkey % 50) AS cn FROM lineitem WHERE l_returnflag = 'R'),
r AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey AS r, l_partkey AS c, 'S' || l_suppkey AS rn, 'P' || (l_partkey % 50) AS cn FROM lineitem WHERE l_returnflag = 'A'),
a AS (SELECT l.id AS left_id, k.right_id, 'id_bridge' AS match_method FROM l JOIN (SELECT r, c, min(id) AS right_id FROM r GROUP BY 1, 2) k ON l.r = k.r AND l.c = k.c),
b AS (SELECT l.id AS left_id, k.right_id, 'name_bridge' AS match_method FROM l JOIN (SELECT rn, cn, min(id) AS right_id FROM r GROUP BY 1, 2) k ON l.rn = k.rn AND l.cn = k.cn WHERE l.id NOT IN (SELECT left_id FROM a))
SELECT * FROM a UNION ALL SELECT * FROM b"""


@query(_BRIDGE)
def engagement_bridge(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    side = lambda flag: lines.where(F.col("l_returnflag") == flag).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_suppkey").alias("registrant_id"), F.col("l_partkey").alias("client_id"),
        F.concat(F.lit("S"), "l_suppkey", F.lit(", Inc.")).alias("registrant"), F.concat(F.lit("The P"), F.col("l_partkey") % 50).alias("client"), "l_linenumber")
    odd = F.col("l_linenumber") % 2 == 1
    left = side("R").withColumns({"registrant_id": F.when(odd, F.col("registrant_id")), "client_id": F.when(odd, F.col("client_id"))})
    return resolution.bridge(left, side("A"))


@query("SELECT strftime(o_orderdate, '%Y-%m') AS period, count(*) AS n, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total FROM orders GROUP BY 1")
def monthly_timeline(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.period_totals(table(spark, sf, "orders"), F.date_format("o_orderdate", "yyyy-MM"), "o_totalprice")


@query("""
SELECT kind, day, n FROM (
  SELECT 'order' AS kind, strftime(o_orderdate, '%m-%d') AS day, count(*) AS n FROM orders GROUP BY 2
  UNION ALL SELECT 'event', strftime(ts, '%m-%d'), count(*) FROM events GROUP BY 2)""")
def interleaved_timeline(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.interleave(order=(table(spark, sf, "orders"), F.date_format("o_orderdate", "MM-dd")), event=(table(spark, sf, "events"), F.date_format("ts", "MM-dd")))


@query("""SELECT p_partkey, CASE WHEN contains(upper(p_name), 'GREEN') OR contains(upper(p_name), 'LIME') THEN 'Green' WHEN contains(upper(p_name), 'RED') THEN 'Red' ELSE 'Other' END AS label FROM part""")
def industry_first_match(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", topics.first_label(F.col("p_name"), {"Green": ["GREEN", "LIME"], "Red": ["RED"]}).alias("label"))


@query("""
WITH v AS (SELECT user_id AS member, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 1 WHEN 'purchase' THEN -1 WHEN 'signup' THEN -1 END AS side, event_type = 'error' AS here, strftime(ts, '%Y-%m-%d') AS roll, user_id % 2 AS party FROM events),
p AS (SELECT party, roll, sum(side) AS lean FROM v GROUP BY 1, 2), n AS (SELECT count(DISTINCT roll) AS rolls FROM v)
SELECT member, v.party, count(*) FILTER (side = 1) AS yea, count(*) FILTER (side = -1) AS nay, count(*) FILTER (here) AS present,
  count(*) FILTER (side IS NOT NULL AND lean <> 0 AND sign(lean) = side) AS with_party, count(*) FILTER (side IS NOT NULL AND lean <> 0 AND sign(lean) <> side) AS against_party,
  round(count(*)::DOUBLE / any_value(rolls), 4) AS participation,
  round((count(*) FILTER (side IS NOT NULL AND lean <> 0 AND sign(lean) = side))::DOUBLE / nullif(count(*) FILTER (side IS NOT NULL AND lean <> 0), 0), 4) AS unity
FROM v JOIN p ON v.party = p.party AND v.roll = p.roll, n GROUP BY 1, 2""")
def rollcall_profile(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    codes = F.create_map(*(F.lit(x) for p in {"click": "1", "view": "2", "purchase": "6", "signup": "5", "error": "7"}.items() for x in p))
    votes = events.select(F.col("user_id").alias("member"), F.date_format("ts", "yyyy-MM-dd").alias("roll"), F.try_element_at(codes, F.col("event_type")).alias("code"))
    members = events.select(F.col("user_id").alias("member"), (F.col("user_id") % 2).alias("party")).distinct()
    return rollups.roll_call_profile(votes, members)


@query("""SELECT o_orderpriority, total, round(total / (SELECT sum(o_totalprice::DECIMAL(18,2))::DOUBLE FROM orders), 4) AS share FROM (
  SELECT o_orderpriority, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total FROM orders GROUP BY 1)""")
def ratio_to_total(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    return ranking.share_of_total(orders.groupBy("o_orderpriority").agg(ranking.exact_sum("o_totalprice").alias("total")), "total", orders.agg(ranking.exact_sum("o_totalprice")))


@query("SELECT event_type, count(*) AS n, count(*) FILTER (value > 50) AS filled, round((count(*) - count(*) FILTER (value > 50))::DOUBLE / count(*), 4) AS null_rate FROM events GROUP BY 1")
def null_rate(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.null_rate(table(spark, sf, "events").select("event_type", F.when(F.col("value") > 50, F.col("value")).alias("v")), "event_type", "v")


@query("""
SELECT c_custkey, observed, CASE WHEN observed > 0 THEN 'YES' ELSE 'NO' END AS disclosed FROM (SELECT c_custkey FROM customer) LEFT JOIN (
  SELECT o_custkey, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS observed FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) ON c_custkey = o_custkey""")
def reconciliation(spark: SparkSession, sf: str) -> DataFrame:
    observed = table(spark, sf, "orders").where("o_orderstatus = 'F'").withColumnRenamed("o_custkey", "c_custkey")
    return rollups.reconcile(table(spark, sf, "customer").select("c_custkey"), observed, "c_custkey", "o_totalprice")


@query("SELECT event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY (event_id * 7919) % 1009, event_id) <= 40")
def stratified_sample(spark: SparkSession, sf: str) -> DataFrame:
    keyed = table(spark, sf, "events").select("event_type", "event_id", (F.col("event_id") * 7919 % 1009).alias("h"))
    return rollups.cap_per_key(keyed, ["event_type"], ["h", "event_id"], 40).drop("h")


@query("SELECT event_type, event_id FROM events QUALIFY (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) % 25 = 0")
def systematic_sample(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.every_nth(table(spark, sf, "events").select("event_type", "event_id"), ["event_type"], ["event_id"], 25)


@query("SELECT event_type, event_id FROM events QUALIFY (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) % 25 = 0 OR user_id % 100 = 7")
def featured_sample(spark: SparkSession, sf: str) -> DataFrame:
    """All events of some users, and every 25th of each type besides."""
    events = table(spark, sf, "events").select("event_type", "event_id", "user_id")
    return rollups.featured_sample(events, F.col("user_id") % 100 == 7, ["event_type"], ["event_id"], 25).drop("user_id")


@query("""
WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS p, count(*)::DOUBLE AS a, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS b FROM orders GROUP BY 1),
l AS (SELECT a AS x, lag(b, 1) OVER (ORDER BY p) AS y FROM m)
SELECT count(*) AS n, round(corr(x, y), 6) AS r FROM l WHERE y IS NOT NULL""")
def lag_corr(spark: SparkSession, sf: str) -> DataFrame:
    months = table(spark, sf, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("p")).agg(F.count("*").cast("double").alias("a"), ranking.exact_sum("o_totalprice").alias("b"))
    return rollups.lag_correlation(months, "p", "a", "b", 1).withColumn("r", F.round("r", 6))


_THREADS = """t AS (
  SELECT o_orderkey::VARCHAR AS id, ['open', 'chasing', 'confirmed', 'cold', 'killed', 'odd'][o_orderkey % 6 + 1] AS status, CASE WHEN o_orderkey % 5 = 0 THEN ' ' ELSE 'call' END AS next_action, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE 'why' END AS reason,
    o_orderkey % 4 <> 0 AS sourced, 'C' || o_custkey AS entity, 'P' || (o_orderkey % 1000) AS source, o_custkey, (o_orderkey % 1000) AS part FROM orders)"""


def case_threads(spark: SparkSession, sf: str) -> DataFrame:
    """A thread for each order: by its customer, with a part as source."""
    k = F.col("o_orderkey")
    status = F.element_at(F.array(*map(F.lit, ["open", "chasing", "confirmed", "cold", "killed", "odd"])), (k % 6 + 1).cast("int"))
    source = F.when(k % 4 != 0, F.array(F.concat(F.lit("P"), k % 1000))).otherwise(F.slice(F.array(F.lit("x")), 1, 0))
    return table(spark, sf, "orders").select(k.cast("string").alias("id"), status.alias("status"), F.when(k % 5 == 0, " ").otherwise("call").alias("next_action"), F.when(k % 7 == 0, "").otherwise("why").alias("reason"), source.alias("source_records"), F.array(F.concat(F.lit("C"), "o_custkey")).alias("entities"), F.when(k % 9 == 0, "soon").otherwise((k % 8).cast("string")).alias("priority"), F.concat(F.lit("Thread "), k).alias("title"))


@query(f"""WITH {_THREADS}
SELECT id, 'unknown status' AS rule FROM t WHERE status = 'odd' UNION ALL SELECT id, 'empty next action' FROM t WHERE status IN ('open', 'chasing') AND trim(next_action) = ''
UNION ALL SELECT id, 'missing reason' FROM t WHERE status IN ('cold', 'killed') AND reason = '' UNION ALL SELECT id, 'missing sources' FROM t WHERE status = 'confirmed' AND NOT sourced
UNION ALL SELECT 'f' || s_suppkey, 'finding without source' FROM supplier WHERE s_suppkey % 3 = 0
UNION ALL SELECT id, 'orphan entity' FROM t WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey <> 3)
UNION ALL SELECT id, 'orphan source' FROM t WHERE sourced AND part NOT IN (SELECT p_partkey FROM part WHERE p_size > 5) UNION ALL SELECT 'f' || s_suppkey, 'orphan source' FROM supplier WHERE s_suppkey % 3 = 1""")
def integrity_violations(spark: SparkSession, sf: str) -> DataFrame:
    """All seven rules over threads, findings, a registry of entities and a corpus of sources."""
    s = F.col("s_suppkey")
    findings = table(spark, sf, "supplier").select(F.concat(F.lit("f"), s).alias("id"), F.when(s % 3 == 0, None).when(s % 3 == 1, F.array(F.lit("nowhere"))).otherwise(F.slice(F.array(F.lit("P"), F.lit("")), 1, 0)).alias("source_records"))
    # The third kind has an empty list in its place: a finding without source too, so it is given one that exists.
    some = table(spark, sf, "part").where("p_size > 5").agg(F.min("p_partkey").alias("k")).select(F.concat(F.lit("P"), "k").alias("known"))
    findings = findings.crossJoin(F.broadcast(some)).withColumn("source_records", F.when(F.size("source_records") == 0, F.array("known")).otherwise(F.col("source_records"))).drop("known")
    entities = table(spark, sf, "customer").where("c_nationkey <> 3").select(F.concat(F.lit("C"), "c_custkey").alias("entity_id"))
    corpus = table(spark, sf, "part").where("p_size > 5").select(F.concat(F.lit("P"), "p_partkey").alias("prov"))
    return integrity.lint(case_threads(spark, sf), entities, findings, corpus)


@query(f"""WITH {_THREADS}, e AS (SELECT 'C' || c_custkey AS id, c_name AS display, CASE c_nationkey WHEN 1 THEN 'Key' WHEN 2 THEN 'flag' WHEN 3 THEN 'other' END AS status FROM customer)
SELECT * FROM (SELECT 'active' AS view, id AS key, CASE WHEN trim(next_action) = '' THEN 'missing' ELSE next_action END AS value, CASE WHEN id::BIGINT % 9 = 0 THEN 9999 ELSE (id::BIGINT % 8) END AS n FROM t WHERE status IN ('open', 'chasing'))
UNION ALL SELECT 'cold', id, CASE WHEN reason = '' THEN 'no reason recorded' ELSE reason END, NULL FROM t WHERE status = 'cold'
UNION ALL SELECT 'entities', display, upper(status) || ' ' || left('because' || repeat(' so', 50), 110), NULL FROM e WHERE lower(status) IN ('key', 'flag')
UNION ALL SELECT 'journal', lpad(n::VARCHAR, 3, '0'), ['---', '### t' || lpad(((n - 1) // 4 + 1)::VARCHAR, 2, '0') || ' · session s', 'one', 'two'][(n - 1) % 4 + 1], n FROM range(9, 21) r(n)
UNION ALL SELECT 'scoreboard', 'confirmed', NULL, count(*) FILTER (status = 'confirmed') FROM t UNION ALL SELECT 'scoreboard', 'active', NULL, count(*) FILTER (status IN ('open', 'chasing')) FROM t
UNION ALL SELECT 'scoreboard', 'cold', NULL, count(*) FILTER (status = 'cold') FROM t UNION ALL SELECT 'scoreboard', 'total', NULL, count(*) FROM t
UNION ALL SELECT 'totals', 'threads', NULL, count(*) FROM t UNION ALL SELECT 'totals', 'findings', NULL, count(*) FROM supplier UNION ALL SELECT 'totals', 'entities', NULL, count(*) FROM customer""")
def case_brief(spark: SparkSession, sf: str) -> DataFrame:
    """The digest of a case: threads, the journal's last lines (of five entries), entities, scoreboard and the state file's totals."""
    folder = f"{shared_folder(spark)}/case-{uuid.uuid4().hex}"
    for i in range(1, 6):
        integrity.append_journal(spark, folder, "s", "one\ntwo", f"t{i:02}")
    entities = table(spark, sf, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("entity_id"), F.col("c_name").alias("display"), F.expr("CASE c_nationkey WHEN 1 THEN 'Key' WHEN 2 THEN 'flag' WHEN 3 THEN 'other' END").alias("status"), F.concat(F.lit("because"), F.repeat(F.lit(" so"), 50)).alias("why"))
    threads = case_threads(spark, sf)
    b = integrity.brief(threads, integrity.journal_lines(spark, folder), entities)
    count = integrity.totals(threads, table(spark, sf, "supplier"), entities)
    long_ = lambda df, view, names_: df.unpivot([], names_, "key", "n").select(F.lit(view).alias("view"), "key", F.lit(None).cast("string").alias("value"), F.col("n").cast("bigint").alias("n"))
    none = F.lit(None).cast("bigint").alias("n")
    return (
        b["active"].select(F.lit("active").alias("view"), F.col("id").alias("key"), F.col("next_action").alias("value"), F.col("rank").cast("bigint").alias("n"))
        .unionByName(b["cold"].select(F.lit("cold").alias("view"), F.col("id").alias("key"), F.col("reason").alias("value"), none))
        .unionByName(b["entities"].select(F.lit("entities").alias("view"), F.col("display").alias("key"), F.concat("status", F.lit(" "), "why").alias("value"), none))
        .unionByName(b["journal"].select(F.lit("journal").alias("view"), F.lpad(F.col("n").cast("string"), 3, "0").alias("key"), F.col("line").alias("value"), F.col("n").cast("bigint").alias("n")))
        .unionByName(long_(b["scoreboard"], "scoreboard", ["confirmed", "active", "cold", "total"]))
        .unionByName(long_(count.toDF("threads", "findings", "entities"), "totals", ["threads", "findings", "entities"]))
    )


_STATUS = "list_element(['open', 'chasing', 'confirmed', 'cold', 'dropped'], (o_orderkey % 5 + 1)::INT)"


@query(f"""SELECT status, coalesce(n, 0) AS n, coalesce(first_id, '') AS first_id FROM (SELECT unnest(['open', 'chasing', 'confirmed', 'cold', 'killed']) AS status) LEFT JOIN (
  SELECT {_STATUS} AS status, count(*) AS n, min(o_orderkey::VARCHAR) AS first_id FROM orders GROUP BY 1) USING (status)""")
def status_rollup(spark: SparkSession, sf: str) -> DataFrame:
    states = F.element_at(F.array(*map(F.lit, ["open", "chasing", "confirmed", "cold", "dropped"])), (F.col("o_orderkey") % 5 + 1).cast("int"))
    threads = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("id"), states.alias("status"))
    return integrity.status_rollup(threads).select("status", "n", F.coalesce(F.try_element_at("ids", F.lit(1)), F.lit("")).alias("first_id"))


@query("""
WITH m AS (SELECT o_orderkey AS id, list_element(['open', 'chasing', 'cold', 'killed'], (o_orderkey % 4 + 1)::INT) AS a, list_element(['chasing', 'cold', 'killed', 'confirmed', 'open'], (o_orderkey % 5 + 1)::INT) AS b,
  CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'why' END AS reason, (o_orderkey % 2)::BIGINT AS s FROM orders),
j AS (SELECT id, CASE WHEN NOT ((a = 'open' AND b IN ('chasing', 'cold', 'killed')) OR (a = 'chasing' AND b IN ('confirmed', 'cold', 'killed')) OR (a = 'cold' AND b = 'chasing')) THEN 'forbidden move'
  WHEN b IN ('cold', 'killed') AND reason = '' THEN 'reason required' WHEN b = 'confirmed' AND s = 0 THEN 'source required' END AS problem FROM m)
SELECT id, problem FROM j WHERE problem IS NOT NULL""")
def transition_check(spark: SparkSession, sf: str) -> DataFrame:
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("o_orderkey") % len(values) + 1).cast("int"))
    moves = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), pick(["open", "chasing", "cold", "killed"]).alias("from_status"), pick(["chasing", "cold", "killed", "confirmed", "open"]).alias("to_status"),
        F.when(F.col("o_orderkey") % 3 == 0, "").otherwise("why").alias("reason"), (F.col("o_orderkey") % 2).alias("n_sources"))
    return integrity.illegal_moves(moves).select("id", "problem")


@query("""
WITH t AS (SELECT p_partkey, string_split(lower(p_name), ' ') AS tags FROM part)
SELECT p_partkey AS source, len(list_filter(tags, LAMBDA x: contains(x, 'red') OR contains('red', x) OR contains(x, 'green') OR contains('green', x)))::INT AS score
FROM t WHERE len(list_filter(tags, LAMBDA x: contains(x, 'red') OR contains('red', x) OR contains(x, 'green') OR contains('green', x))) > 0 ORDER BY score DESC, source LIMIT 8""")
def tag_ranking(spark: SparkSession, sf: str) -> DataFrame:
    sources = table(spark, sf, "part").select(F.col("p_partkey").alias("source"), F.split(F.lower("p_name"), " ").alias("tags"))
    return rollups.tag_ranking(sources, ["red", "green"])


@query("""
SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45)""")
def topic_restricted(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), "o_orderpriority")
    lines = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "k")
    return rollups.with_code(orders, lines, "k", F.expr("l_returnflag = 'R' AND l_quantity > 45")).withColumnRenamed("k", "o_orderkey")


@query("""
SELECT s_suppkey, s_nationkey, s_acctbal, peer_median, round(s_acctbal / nullif(peer_median, 0), 6) AS deviation FROM supplier JOIN (SELECT s_nationkey AS k, median(s_acctbal) AS peer_median FROM supplier GROUP BY 1) ON s_nationkey = k""")
def peer_outliers(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    return ranking.peer_outliers(rows, "s_nationkey", "s_acctbal").withColumn("deviation", F.round("deviation", 6))


@query("""
SELECT c_mktsegment, o_orderpriority, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY n DESC, o_orderpriority) AS rank FROM (
  SELECT c_mktsegment, o_orderpriority, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)) WHERE rank <= 2""")
def most_common_items(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rollups.most_common(rows, "c_mktsegment", "o_orderpriority", 2)


@query("""
WITH t AS (SELECT s_nationkey AS who, s_suppkey AS candidate, (2000 + 2 * (s_suppkey % 5))::INT AS cycle, s_acctbal AS receipts FROM supplier UNION ALL SELECT s_nationkey, s_suppkey, (2006 + 2 * (s_suppkey % 3))::INT, s_acctbal * 2 FROM supplier),
f AS (SELECT who, candidate, min(cycle) AS cycle FROM t WHERE cycle >= 2004 AND receipts > 0 GROUP BY 1, 2),
g AS (SELECT f.who, f.candidate, f.cycle, min(t.receipts) AS receipts FROM f JOIN t ON f.who = t.who AND f.candidate = t.candidate AND f.cycle = t.cycle AND t.receipts > 0 GROUP BY 1, 2, 3)
SELECT who, candidate, cycle, receipts FROM g QUALIFY row_number() OVER (PARTITION BY who ORDER BY receipts DESC, candidate DESC) = 1""")
def cycle_pick(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier")
    a = s.select(F.col("s_nationkey").alias("who"), F.col("s_suppkey").alias("candidate"), (2000 + 2 * (F.col("s_suppkey") % 5)).cast("int").alias("cycle"), F.col("s_acctbal").alias("receipts"))
    b = s.select(F.col("s_nationkey").alias("who"), F.col("s_suppkey").alias("candidate"), (2006 + 2 * (F.col("s_suppkey") % 3)).cast("int").alias("cycle"), (F.col("s_acctbal") * 2).alias("receipts"))
    return rollups.best_cycle(a.unionByName(b).groupBy("who", "candidate", "cycle").agg(F.min(F.when(F.col("receipts") > 0, F.col("receipts"))).alias("receipts")), "who", 2004)


@query("""SELECT c_custkey, c_mktsegment, n, n_name FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey = 1""")
def snapshot_enrichment(spark: SparkSession, sf: str) -> DataFrame:
    counts = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    regional = table(spark, sf, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    board = rollups.enrich(table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_nationkey"), counts, "c_custkey")
    return rollups.enrich(board, regional, "c_nationkey").select("c_custkey", "c_mktsegment", "n", "n_name")


@query("""
WITH v AS (SELECT o_orderkey AS roll, o_custkey % 40 AS bill, o_orderdate AS date FROM orders)
SELECT area, count(*) AS n FROM (SELECT 'area ' || (bill % 6) AS area FROM v WHERE bill < 30 ORDER BY date DESC, roll DESC LIMIT 80) GROUP BY 1""")
def vote_topic_mix(spark: SparkSession, sf: str) -> DataFrame:
    votes = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("roll"), (F.col("o_custkey") % 40).alias("bill"), F.col("o_orderdate").alias("date"))
    bills = spark.range(30).select(F.col("id").alias("bill"), F.concat(F.lit("area "), F.col("id") % 6).alias("area"))
    return rollups.vote_mix(votes, bills)


@query("""WITH d AS (SELECT doc_id AS folder, CASE WHEN doc_id % 7 = 0 THEN '' WHEN doc_id % 3 = 0 THEN replace(source, 'src', 'Src_') ELSE source || '-' || lang END AS name, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS about FROM documents)
SELECT folder, unnest(CASE WHEN folder % 11 = 0 THEN ['no file'] WHEN folder % 13 = 0 THEN ['no block'] ELSE list_filter([CASE WHEN name = '' THEN 'no name' WHEN NOT regexp_full_match(name, '[a-z0-9]+(-[a-z0-9]+)*') THEN 'bad name' END,
  CASE WHEN about = '' THEN 'no description' WHEN length(about) > 1024 THEN 'long description' END], LAMBDA x: x IS NOT NULL) END) AS problem FROM d""")
def manifest_check(spark: SparkSession, sf: str) -> DataFrame:
    """A manifest for each document: its source and language make the name, its text, line by line, the description."""
    d = F.col("doc_id")
    name = F.when(d % 7 == 0, "").when(d % 3 == 0, F.regexp_replace("source", "src", "Src_")).otherwise(F.concat("source", F.lit("-"), "lang"))
    about = F.regexp_replace(F.regexp_replace("text", r"\s+", " "), r"(\. )", ".\n  ")
    whole = F.concat(F.lit("---\nname: '"), name, F.lit("'\ndescription: "), about, F.lit("\n---\nBody"))
    text_ = F.when(d % 11 == 0, None).when(d % 13 == 0, F.concat(F.lit("name: "), name)).otherwise(whole)
    return integrity.manifest_problems(table(spark, sf, "documents").select(d.alias("folder"), text_.alias("text")))


@query("""WITH e AS (SELECT o_orderkey AS seq, ['thread', 'entity', 'lead'][o_custkey % 3 + 1] AS kind, 'n' || o_custkey AS name, ['hot', '', NULL, 'cold'][o_orderkey % 4 + 1] AS status, CASE WHEN o_orderkey % 3 = 0 THEN 'note ' || o_orderkey ELSE '' END AS note, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders)
SELECT kind, name, coalesce(arg_max(status, seq) FILTER (status <> ''), CASE WHEN kind <> 'entity' THEN 'open' END) AS status, coalesce(arg_max(note, seq) FILTER (note <> ''), '') AS note, arg_min(day, seq) AS created FROM e GROUP BY kind, name""")
def session_tracker(spark: SparkSession, sf: str) -> DataFrame:
    """Threads, entities and leads as their events leave them; an order is an event of its customer."""
    pick = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (F.col(by) % len(values) + 1).cast("int"))
    note = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("note "), "o_orderkey")).otherwise("")
    events = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("seq"), pick(["thread", "entity", "lead"], "o_custkey").alias("kind"), F.concat(F.lit("n"), "o_custkey").alias("name"),
        pick(["hot", "", None, "cold"], "o_orderkey").alias("status"), note.alias("note"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
    )
    return integrity.tracker_state(events)


_HEADS = """SELECT o_orderkey, 'T-' || o_orderkey AS id, o_orderstatus AS status, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS priority, CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'C' || o_custkey ELSE 'C' || o_custkey || '|N: ' || o_orderstatus END AS entities,
  'why: ' || o_orderpriority AS reason, CASE WHEN o_orderkey % 5 = 0 THEN 'no head' ELSE 'of --- ' || o_orderdate::DATE END AS body FROM orders"""


@query(f"""WITH t AS ({_HEADS}) SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey::VARCHAR ELSE id END AS id, CASE WHEN o_orderkey % 5 > 0 THEN status END AS status, CASE WHEN o_orderkey % 5 > 0 THEN priority END AS priority,
  CASE WHEN o_orderkey % 5 > 0 THEN entities ELSE '' END AS entities, CASE WHEN o_orderkey % 5 > 0 THEN reason END AS reason, body FROM t""")
def case_heads(spark: SparkSession, sf: str) -> DataFrame:
    """A thread file for each order, written with quotes, lists and other lines in its head (or without one), and read back."""
    k = F.col("o_orderkey")
    entities = F.when(k % 3 == 0, "[]").when(k % 3 == 1, F.concat(F.lit("C"), "o_custkey")).otherwise(F.concat(F.lit("[C"), "o_custkey", F.lit(", 'N: "), "o_orderstatus", F.lit("']")))
    priority = F.when(k % 3 == 0, F.col("o_orderpriority")).otherwise("")
    head = F.concat(F.lit("---\nid: T-"), k, F.lit("\nstatus: x\nstatus: "), "o_orderstatus", F.lit("\n# a remark: none\npriority:  "), priority, F.lit("\nentities: "), entities, F.lit('\nreason: "why: '), "o_orderpriority", F.lit('"\n---\n\nof --- '), F.date_format("o_orderdate", "yyyy-MM-dd"))
    files = table(spark, sf, "orders").select(k, F.concat(F.lit("/t/"), k, F.lit(".md")).alias("file"), F.when(k % 5 == 0, "no head").otherwise(head).alias("text"))
    read = cases.thread_rows(files).withColumn("o_orderkey", F.regexp_extract("file", "([0-9]+)", 1).cast("bigint"))
    return read.select("o_orderkey", "id", "status", "priority", F.array_join("entities", "|").alias("entities"), "reason", "body")
