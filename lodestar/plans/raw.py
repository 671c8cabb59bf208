"""Raw record files made from whole tables of the driver, so that readers and commands run over them end to end."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import shared_folder, write_files
from ..sources.records import ingest
from .commands import Records
from .registry import files_like, table

#: Tables that are made, by application, folder and what the folder's files are like.
_made: dict[tuple, MadeRecords] = {}


def pick(values: list[str], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (at % len(values) + 1).cast("int"))


def text(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def day(first: str, plus: Column) -> Column:
    return F.date_format(F.date_add(F.lit(first).cast("date"), plus.cast("int")), "yyyy-MM-dd")


def spread(df: DataFrame, key: str) -> DataFrame:
    """df over many tasks: a small file of many short rows is read by one, and the records made of them are long."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, key)


def filing_records(spark: SparkSession, sf: str) -> DataFrame:
    """A filing for each customer."""
    c = F.col("c_custkey")
    income = F.when(c % 5 != 0, F.format_string("%.2f", F.abs("c_acctbal")))
    names = lambda *n: F.array(*(F.struct(F.lit(x).alias("name")) for x in n))
    person = F.struct(F.struct(text("Fay", c % 7).alias("first_name"), text("Lob", c % 11).alias("last_name")).alias("lobbyist"), F.when(c % 2 == 0, text("Aide ", c % 5)).otherwise("").alias("covered_position"))
    first = F.struct(pick(["HCR", "TAX", "DEF"], c).alias("general_issue_code"), text("On ", F.col("c_mktsegment")).alias("description"), names("SENATE", "HOUSE ", "SENATE").alias("government_entities"), F.array(person).alias("lobbyists"))
    none = F.struct(F.lit("BUD").alias("general_issue_code"), F.lit(None).cast("string").alias("description"), F.slice(names("x"), 1, 0).alias("government_entities"), F.slice(F.array(person), 1, 0).alias("lobbyists"))
    return spread(table(spark, sf, "customer"), "c_custkey").select(
        text("F", c).alias("filing_uuid"), F.lit("Q").alias("filing_type"), (c % 3 + 2023).cast("int").alias("filing_year"),
        pick(["first_quarter", "second_quarter", "third_quarter", "fourth_quarter"], F.floor(c / 3)).alias("filing_period"), income.alias("income"), F.lit(None).cast("string").alias("expenses"), day("2025-01-01", c * 7 % 300).alias("dt_posted"),
        F.struct((F.col("c_nationkey") + 1).alias("id"), text("Firm N", F.col("c_nationkey"), ", Inc.").alias("name"), (F.col("c_nationkey") + 1).alias("house_registrant_id")).alias("registrant"),
        F.struct((c % 8 + 100).alias("id"), text("The Client K", c % 8, " Group").alias("name"), F.lit(None).cast("string").alias("state"), pick(["US", "FR"], c).alias("country")).alias("client"),
        F.array(first, none).alias("lobbying_activities"), c.alias("key"))


def contribution_records(spark: SparkSession, sf: str) -> DataFrame:
    """A report for each supplier, with the parts whose number leaves its key over the suppliers' count."""
    suppliers, p = table(spark, sf, "supplier"), F.col("p_partkey")
    n, who = suppliers.count(), p % 25
    honoree = F.when(p % 7 == 0, text("MARY", who, " NAME", who, " FOR CONGRESS")).when(p % 5 == 1, text("Rep. Xena Name", who)).otherwise(text("Sen. Mary", who, " Name", who))
    item = F.struct(p.alias("at"), pick(["feca", "he", "pic"], p).alias("contribution_type"), F.lit("self").alias("contributor_name"), F.col("p_brand").alias("payee_name"), honoree.alias("honoree_name"), text("$", F.format_number("p_retailprice", 2)).alias("amount"), day("2024-12-01", p % 90).alias("date"))
    items = spread(table(spark, sf, "part"), "p_partkey").groupBy((p % n).alias("s_suppkey")).agg(F.array_sort(F.collect_list(item)).alias("contribution_items"))
    s = F.col("s_suppkey")
    return suppliers.join(items, "s_suppkey").select(
        text("C", s).alias("filing_uuid"), F.lit("MM").alias("filing_type"), (s % 2 + 2024).cast("int").alias("filing_year"), F.lit("mid_year").alias("filing_period"), pick(["registrant", "lobbyist", "lobbyist", "lobbyist"], s).alias("filer_type"),
        F.struct((F.col("s_nationkey") + 1).alias("id"), text("Firm N", F.col("s_nationkey"), ", Inc.").alias("name")).alias("registrant"),
        F.struct(text("Fay", s % 7).alias("first_name"), text("Lob", s % 11).alias("last_name")).alias("lobbyist"), "contribution_items", s.alias("key"))


def release_records(spark: SparkSession, sf: str) -> DataFrame:
    """A release for each document, by a member for each source."""
    d, n = F.col("doc_id"), F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    who = F.struct(text("B", n).alias("bioguide_id"), text("Mary", n, " Name", n).alias("name"), pick(["D", "R"], n).alias("party"), text("S", n).alias("state"), F.lit("senate").alias("chamber"))
    title = F.when(d % 3 == 0, "Medicare and tax notes").when(d % 3 == 1, "On the border").otherwise(text("Note ", d))
    return table(spark, sf, "documents").select(text("https://m.example/", d).alias("url"), title.alias("title"), day("2024-07-01", d % 365).alias("date"), who.alias("member"), "text", d.alias("key"))


def other_records(spark: SparkSession, sf: str) -> DataFrame:
    """(folder, name, value): an XML file for each supplier."""
    s, nation = F.col("s_suppkey"), F.col("s_nationkey")
    number = F.when(s % 10 == 9, "x").otherwise((nation + 1).cast("string"))
    income = F.when(s % 3 == 0, "").otherwise(F.format_string("%.2f", F.abs("s_acctbal")))
    value = text("<Filing><organizationName>Firm N", nation, " LLC</organizationName><clientName>Client K", s % 8, "</clientName><senateID>", number, "-", s % 8 + 100, "</senateID><reportYear>2025</reportYear><income>", income,
                 "</income><expenses></expenses><alis><ali_info><issueAreaCode>TAX</issueAreaCode><specific_issues><description>d", s, "</description></specific_issues><federal_agencies>SENATE</federal_agencies></ali_info>",
                 "<ali_info><issueAreaCode> </issueAreaCode></ali_info></alis></Filing>")
    return table(spark, sf, "supplier").select(pick(["2025_1stQuarter_XML", "2025_2ndQuarter_XML"], s).alias("folder"), text(s + 3000, ".xml").alias("name"), value.alias("value"))


def _arrays(df: DataFrame, root: str, label: str) -> None:
    """<root>/<label>_<year>.json: JSON arrays of up to 2,000 records, a file each."""
    record = F.to_json(F.struct(*(c for c in df.columns if c != "key")))
    arrays = df.select("filing_year", F.floor(F.col("key") / 2000).alias("part"), record.alias("r")).groupBy("filing_year", "part").agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list("r")), ",\n"), F.lit("]")).alias("value"))
    # All years in one pass, a folder each.
    arrays.select("filing_year", "value").write.option("maxRecordsPerFile", 1).mode("overwrite").partitionBy("filing_year").text(f"{root}/{label}")
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path
    store = path(root).getFileSystem(df.sparkSession._jsc.hadoopConfiguration())
    for folder in store.listStatus(path(f"{root}/{label}")):
        if folder.isDirectory():
            store.rename(folder.getPath(), path(f"{root}/{label}_{folder.getPath().getName().partition('=')[2]}.json"))


#: Tables of each source, and the sources that tables made of several need.
SOURCES = {"filings": ("filings", "activities", "activity_people"), "contributions": ("contributions", "contribution_items"), "other": ("other_filings", "other_activities"), "releases": ("releases", "members")}
NEEDS = {t: (source,) for source, tables in SOURCES.items() for t in tables} | {"resolved": ("contributions", "releases"), "bridge": ("filings", "other"), "provenance_index": tuple(SOURCES)}


def write_raw(spark: SparkSession, sf: str, root: str, sources: Iterable[str] = SOURCES) -> None:
    for source in sources:
        if source == "filings":
            _arrays(filing_records(spark, sf), root, source)
        elif source == "contributions":
            _arrays(contribution_records(spark, sf), root, source)
        elif source == "releases":
            _write_lines(release_records(spark, sf), root)
        elif source == "other":
            # One record a file is what this source is like.
            write_files(other_records(spark, sf), f"{root}/other")
        else:
            raise ValueError(f"no such source: {source}")


def _write_lines(lines: DataFrame, root: str) -> None:
    """<root>/releases/<year>/<year>-<month>.jsonl: lines by month and document; a month is one file, as its lines are numbered."""
    spark = lines.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path
    store = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    lines = lines.select(F.substring("date", 1, 7).alias("month"), "key", F.to_json(F.struct("url", "title", "date", "member", "text")).alias("value"))
    lines.repartition("month").sortWithinPartitions("month", "key").select("month", "value").write.mode("overwrite").partitionBy("month").text(f"{root}/lines")
    for folder in store.listStatus(path(f"{root}/lines")):
        month = folder.getPath().getName().partition("=")[2]
        for part in store.listStatus(folder.getPath()) if month else []:
            store.mkdirs(path(f"{root}/releases/{month[:4]}"))
            store.rename(part.getPath(), path(f"{root}/releases/{month[:4]}/{month}.jsonl"))


class MadeRecords(Records):
    """Tables that are made when they are first asked for: a query pays for the sources that it reads, each whole."""

    def __init__(self, spark: SparkSession, sf: str, base: str):
        super().__init__(spark, f"{base}/tables")
        self.sf, self.raw, self.done = sf, f"{base}/raw", set[str]()

    def __getitem__(self, name: str) -> DataFrame:
        self.make(name)
        return super().__getitem__(name)

    def make(self, *names: str) -> None:
        """Make these tables, all without names."""
        for name in names or NEEDS:
            for source in NEEDS[name]:
                if source not in self.done:
                    write_raw(self.spark, self.sf, self.raw, (source,))
                    ingest(self.spark, self.raw, self.root, [2023, 2024, 2025], (source,))
                    self.done.add(source)
            if name not in self.done and name in ("resolved", "bridge"):
                made = Records(self.spark, self.root)
                made.resolve() if name == "resolved" else made.build_bridge()
                self.done.add(name)


#: Tables that raw records are made of.
GIVEN = ("customer", "supplier", "part", "documents")


def records(spark: SparkSession, sf: str) -> MadeRecords:
    """The ingested tables, each made once in an application, and anew if a table they are made of has changed."""
    key = (spark.sparkContext.applicationId, sf, files_like(spark, sf, GIVEN))
    if key not in _made:
        _made[key] = MadeRecords(spark, sf, f"{shared_folder(spark)}/raw-{len(_made)}")
    return _made[key]
