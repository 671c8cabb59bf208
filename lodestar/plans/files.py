"""Readers over files that Spark writes from whole tables: subtitles, URL lists, folders, roll calls, delimited files, rosters and profiles."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import shared_folder, write_files
from ..sources import records as sources
from ..sources import texts
from . import commands
from .registry import query, table


def _written(spark: SparkSession, write: Callable[[str], None]) -> str:
    folder = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    write(folder)
    return folder


@query(r"""WITH t AS (SELECT conv_id, turn, regexp_replace(trim(regexp_replace(regexp_replace(role || ' ' || text, '<[^>]+>', '', 'g'), '\s+', ' ', 'g')), '^$', '') AS said FROM conversations)
SELECT printf('%02d:%02d:%02d', conv_id // 60, conv_id % 60, turn) AS timecode, said AS text FROM t WHERE said <> ''""")
def source_cues(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as subtitle files, a cue for each turn, with milliseconds, a number and a voice tag that readers drop."""
    c, t = F.col("conv_id"), F.col("turn")
    said = F.regexp_replace("text", texts.SPACE, " ")
    block = F.concat(t, F.lit("\n"), F.format_string("%02d:%02d:%02d", F.floor(c / 60), c % 60, t), F.lit(".250 --> 23:59:59.000 line:1\n<v "), "role", F.lit(">"), "role", F.lit(" "), said, F.lit("\n"))
    rows = table(spark, sf, "conversations").select(c, t, block.alias("value"))
    folder = _written(spark, lambda f: rows.repartition(8, "conv_id").sortWithinPartitions("conv_id", "turn").select("value").write.option("maxRecordsPerFile", 10_000).text(f))
    return texts.cues(spark, folder).select("timecode", "text")


@query("SELECT trim(url) AS url, count(*) AS n FROM pages WHERE trim(url) <> '' GROUP BY 1")
def source_urls(spark: SparkSession, sf: str) -> DataFrame:
    """All URLs of pages as a list with remarks, blank lines and spaces about them."""
    u, p = F.col("url"), F.col("page_id")
    line = F.when(p % 3 == 0, F.concat(F.lit("# a remark\n  "), u, F.lit(" "))).when(p % 3 == 1, F.concat(u, F.lit("\n"))).otherwise(u)
    folder = _written(spark, lambda f: table(spark, sf, "pages").where("url IS NOT NULL").select(line).write.text(f))
    return texts.url_list(spark, folder).groupBy("url").agg(F.count("*").alias("n"))


@query("""WITH f AS (SELECT ['2025_1stQuarter_XML', '2025_2ndQuarter_XML'][s_suppkey % 2 + 1] || '/' || (s_suppkey + 3000) || CASE WHEN s_suppkey % 4 = 0 THEN '.txt' WHEN s_suppkey % 4 = 1 THEN '.vtt' ELSE '.xml' END AS path FROM supplier)
SELECT 'S' || lpad(n::VARCHAR, greatest(3, length(n::VARCHAR))::INT, '0') AS source_id, path, CASE WHEN suffix(path, '.txt') THEN 'text' WHEN suffix(path, '.vtt') THEN 'transcript' END AS kind FROM (SELECT path, row_number() OVER (ORDER BY path) AS n FROM f)""")
def source_walk(spark: SparkSession, sf: str) -> DataFrame:
    """A file for each supplier in two folders, numbered by path, with the kinds of their endings."""
    s = F.col("s_suppkey")
    name = F.concat(s + 3000, F.when(s % 4 == 0, ".txt").when(s % 4 == 1, ".vtt").otherwise(".xml"))
    folder = F.when(s % 2 == 0, "2025_1stQuarter_XML").otherwise("2025_2ndQuarter_XML")
    rows = table(spark, sf, "supplier").select(folder.alias("folder"), name.alias("name"), F.col("s_name").alias("value"))
    root = _written(spark, lambda f: write_files(rows, f))
    found = texts.walk(spark, root)
    return found.select("source_id", F.regexp_extract("path", "([^/]+/[^/]+)$", 1).alias("path"), "kind")


@query("SELECT (o_orderkey % 400)::VARCHAR AS rollnumber, o_custkey::VARCHAR AS icpsr, (o_orderkey % 9 + 1)::VARCHAR AS cast_code, count(*) AS n FROM orders GROUP BY 1, 2, 3")
def source_roll_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as votes of customers in roll calls, written as CSV with a header."""
    votes = table(spark, sf, "orders").select((F.col("o_orderkey") % 400).alias("rollnumber"), F.col("o_custkey").alias("icpsr"), (F.col("o_orderkey") % 9 + 1).alias("cast_code"))
    folder = _written(spark, lambda f: votes.write.option("header", True).csv(f))
    return sources.roll_call_table(spark, folder, "votes").groupBy("rollnumber", "icpsr", "cast_code").agg(F.count("*").alias("n"))


@query("""SELECT doc_id::VARCHAR AS doc_id, source, lang, nullif(regexp_replace(text, '[\\r\\n"]', ' ', 'g'), '') AS said FROM documents""")
def source_delimited(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as delimited text with a column that has neither name nor values; the delimiter and the encoding are found."""
    said = F.regexp_replace("text", r'[\r\n"]', " ")
    rows = table(spark, sf, "documents").select("doc_id", "source", "lang", said.alias("said"), F.lit(None).cast("string").alias("Unnamed: 4"))
    folder = _written(spark, lambda f: rows.write.option("header", True).option("sep", ";").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f))
    return texts.delimited(spark, folder)


@query("""WITH t AS (SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS status, arg_max(o_orderpriority, o_orderkey) AS party FROM orders GROUP BY 1), r AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1)
SELECT c_custkey::VARCHAR AS member_id, c_name AS name, CASE WHEN status = 'F' THEN 'senate' ELSE 'house' END AS chamber, party, 'S' || c_nationkey AS state,
  CASE WHEN c_custkey % 4 = 0 THEN 'X' || c_custkey WHEN status = 'F' THEN 'S' || c_custkey ELSE 'H' || c_custkey END AS candidates, coalesce(n, 0) AS n_roles FROM customer JOIN t ON c_custkey = o_custkey LEFT JOIN r ON c_custkey = r.o_custkey""")
def source_roster(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as members whose orders are their terms (the last one counts) and, every third, their committee roles."""
    o, member = table(spark, sf, "orders"), F.col("o_custkey").cast("string").alias("member_id")
    # A term's state is the member's nation, so the last term has it.
    people = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("member_id"), F.col("c_name").alias("name"), F.concat(F.lit("S"), "c_nationkey").alias("state"))
    each = o.select(member, "o_orderkey", F.when(F.col("o_orderstatus") == "F", "sen").otherwise("rep").alias("type"), F.col("o_orderpriority").alias("party")).join(people.select("member_id", "state"), "member_id")
    terms = each.groupBy("member_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "type", "party", "state"))), lambda x: F.struct(x["type"].alias("type"), x["party"].alias("party"), x["state"].alias("state"))).alias("terms"))
    ids = F.when(F.col("member_id").cast("long") % 4 == 0, F.array(F.concat(F.lit("X"), "member_id"))).otherwise(F.array(F.concat(F.lit("S"), "member_id"), F.concat(F.lit("H"), "member_id")))
    committees = o.where("o_orderkey % 3 = 0").select(member, F.col("o_orderkey").alias("rank"), F.col("o_orderstatus").alias("committee"), F.col("o_orderpriority").alias("title"))
    found = sources.roster(people.drop("state"), committees, terms.withColumn("candidate_ids", ids))
    return found.select("member_id", "name", "chamber", "party", "state", F.array_join("candidate_ids", "|").alias("candidates"), F.coalesce(F.size("roles"), F.lit(0)).cast("bigint").alias("n_roles"))


_NUMBERS = {"s_acctbal": "s_acctbal", "s_nationkey": "s_nationkey"}
_VIEWS = " UNION ALL ".join(f"SELECT 'statistics' AS view, '{c}' AS key, count({c}) AS n, round(avg({c}), 4) AS value FROM supplier" for c in _NUMBERS)


@query(f"""{_VIEWS} UNION ALL SELECT 'columns', c, n, u FROM (SELECT 's_name' AS c, count(s_name) AS n, count(DISTINCT s_name)::DOUBLE AS u FROM supplier UNION ALL SELECT 's_nationkey', count(s_nationkey), count(DISTINCT s_nationkey) FROM supplier
  UNION ALL SELECT 's_acctbal', count(s_acctbal), count(DISTINCT s_acctbal) FROM supplier UNION ALL SELECT 's_suppkey', count(s_suppkey), count(DISTINCT s_suppkey) FROM supplier)
UNION ALL SELECT 'histogram', c, n, NULL FROM (SELECT 's_acctbal' AS c, count(s_acctbal) AS n FROM supplier UNION ALL SELECT 's_nationkey', count(s_nationkey) FROM supplier)""")
def profile_assembly(spark: SparkSession, sf: str) -> DataFrame:
    """The whole profile of a table as one listing: columns with their distinct values, statistics of the numeric ones, and the rows in each histogram."""
    found = commands.profile(table(spark, sf, "supplier"))
    out = found["columns"].select(F.lit("columns").alias("view"), F.col("column").alias("key"), "n", F.col("n_distinct").cast("double").alias("value"))
    out = out.unionByName(found["statistics"].select(F.lit("statistics").alias("view"), F.col("column").alias("key"), "n", F.round("mean", 4).alias("value")))
    for name, bins in found.items():
        if name.startswith("histogram_"):
            out = out.unionByName(bins.agg(F.sum("n").alias("n")).select(F.lit("histogram").alias("view"), F.lit(name.removeprefix("histogram_")).alias("key"), "n", F.lit(None).cast("double").alias("value")))
    return out
