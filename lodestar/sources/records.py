"""Raw record files to tables with a provenance id on every row.

Provenance: path#uuid for JSON arrays, path for one record a file, path#L<line> for line files. Arrays and line files are split among
tasks (see splits); ingest also writes `provenance_index`, the byte range behind each id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..operators.ranking import latest_per_key
from ..scratch import written
from . import schemas
from .provenance import index_of, look_up_by_scan
from .splits import array_records, file_path, numbered_lines


def _json_array(spark: SparkSession, paths: list[str], schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows with prov, records with prov, path, byte, length)."""
    found = array_records(spark, paths).withColumn("r", F.from_json("record", schema)).withColumn("prov", F.concat("path", F.lit("#"), F.col("r.filing_uuid")))
    return found.select("r.*", "prov"), found.select("prov", "path", "byte", "length", "record")


def last_by_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows with one key the last by provenance stays, as an upsert in the files' order would leave it."""
    return latest_per_key(df, keys, [F.desc("prov")])


def filings(spark: SparkSession, paths: list[str]) -> dict[str, DataFrame]:
    """Tables filings, activities, activity_people of JSON arrays of filings, and their records' places."""
    rows, places = _json_array(spark, paths, schemas.FILINGS_JSON)
    # Written once: three tables come from it.
    raw = written(last_by_key(rows.where("filing_uuid IS NOT NULL"), ["filing_uuid"]), "filings")
    head = raw.select(
        "filing_uuid", "filing_type", "filing_year", "filing_period", names.money(F.col("income")).alias("income"), names.money(F.col("expenses")).alias("expenses"),
        F.col("registrant.id").alias("registrant_id"), F.col("registrant.name").alias("registrant_name"), names.org_key(F.col("registrant.name")).alias("registrant_key"),
        F.col("registrant.house_registrant_id").alias("registrant_other_id"), F.col("client.id").alias("client_id"), F.col("client.name").alias("client_name"),
        names.org_key(F.col("client.name")).alias("client_key"), F.col("client.state").alias("client_state"), F.col("client.country").alias("client_country"), "dt_posted", "prov")
    acts = raw.select("filing_uuid", "prov", F.posexplode("lobbying_activities").alias("act_idx", "a"))
    activities = acts.select("filing_uuid", "act_idx", F.col("a.general_issue_code").alias("issue_code"), F.col("a.description").alias("description"), names.name_list(F.col("a.government_entities")).alias("gov_entities"), "prov")
    each = acts.select("filing_uuid", "act_idx", "prov", F.posexplode("a.lobbyists").alias("person_idx", "l"))
    person = names.full_name(F.coalesce("l.lobbyist.first_name", "l.first_name"), F.coalesce("l.lobbyist.last_name", "l.last_name"))
    people = each.select("filing_uuid", "act_idx", "person_idx", person.alias("person_name"), names.person_key(person).alias("person_key"), F.col("l.covered_position").alias("covered_position"), "prov").where("person_name <> ''")
    return {"filings": head, "activities": activities, "activity_people": people, "places": places}


def contributions(spark: SparkSession, paths: list[str]) -> dict[str, DataFrame]:
    """Tables contributions and contribution_items of JSON arrays of reports, and their records' places."""
    rows, places = _json_array(spark, paths, schemas.CONTRIBUTIONS_JSON)
    raw = written(last_by_key(rows.where("filing_uuid IS NOT NULL"), ["filing_uuid"]), "contributions")
    head = raw.select("filing_uuid", "filing_type", "filing_year", "filing_period", "filer_type", F.col("registrant.id").alias("registrant_id"), F.col("registrant.name").alias("registrant_name"), names.full_name(F.col("lobbyist.first_name"), F.col("lobbyist.last_name")).alias("person_name"), F.coalesce("no_contributions", F.lit(False)).alias("no_contributions"), "prov")
    items = raw.select("filing_uuid", "prov", F.posexplode("contribution_items").alias("item_idx", "i")).select(
        "filing_uuid", "item_idx", "i.contribution_type", "i.contributor_name", "i.payee_name", "i.honoree_name", names.person_key(F.col("i.honoree_name")).alias("honoree_norm"),
        names.last_first_key(F.col("i.honoree_name")).alias("honoree_key"), names.money(F.col("i.amount")).alias("amount"), F.col("i.date").alias("item_date"), "prov")
    return {"contributions": head, "contribution_items": items, "places": places}


def other_filings(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables other_filings and other_activities of XML files <year>_*_XML/<id>.xml, and the files' places; files that aren't XML are skipped.

    Each file is opened once, as opening is what small files cost: what is parsed is written, and the tables are made of that.
    """
    # Bytes, as the text reader takes more than twice as long over a small file. A task reads some 30 files; what they hold goes on in a number of tasks
    # of its own, so that no table has a part for each 30 records.
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.xml").option("recursiveFileLookup", True).load(path)
    raw = raw.select(file_path().alias("prov"), F.col("content").cast("string").alias("value")).repartition(4 * spark.sparkContext.defaultParallelism, "prov")
    folder = F.regexp_extract("prov", r"([^/]+)/[^/]+$", 1)
    # from_xml reads the children of whatever the root element is.
    shape = schemas.FILING_XML + ", _corrupt_record string"
    parsed = raw.select("prov", F.octet_length("value").cast("long").alias("length"), "value", folder.alias("folder"), F.from_xml("value", shape, {"mode": "PERMISSIVE"}).alias("x")).where("x IS NOT NULL AND x._corrupt_record IS NULL")
    parsed = written(parsed.where(F.col("folder").rlike(r"^\d{4}_.*_XML$") | F.contains("folder", F.lit("Registrations"))), "other")
    kind = F.when(F.contains("folder", F.lit("Registrations")), "REG").otherwise(F.split_part("folder", F.lit("_"), F.lit(2)))
    part = lambda n: F.when(F.split_part("x.senateID", F.lit("-"), F.lit(n)).rlike(r"^\d+$"), F.split_part("x.senateID", F.lit("-"), F.lit(n)).try_cast("bigint"))
    head = parsed.select(
        F.regexp_extract("prov", r"([^/]+)\.xml$", 1).alias("house_id"), names.text_year(F.col("x.reportYear")).alias("report_year"), kind.alias("report_type"),
        F.col("x.organizationName").alias("organization_name"), names.org_key(F.col("x.organizationName")).alias("organization_key"), F.col("x.clientName").alias("client_name"), names.org_key(F.col("x.clientName")).alias("client_key"),
        F.col("x.senateID").alias("senate_id_raw"), part(1).alias("senate_registrant_id"), part(2).alias("senate_client_id"), names.money(F.col("x.income")).alias("income"), names.money(F.col("x.expenses")).alias("expenses"), "prov")
    alis = parsed.select(F.regexp_extract("prov", r"([^/]+)\.xml$", 1).alias("house_id"), "prov", F.posexplode("x.alis.ali_info").alias("ali_idx", "a"))
    alis = alis.select("house_id", "ali_idx", F.col("a.issueAreaCode").alias("issue_code"), F.col("a.specific_issues.description").alias("description"), F.col("a.federal_agencies").alias("federal_agencies"), "prov")
    alis = alis.where("coalesce(trim(issue_code), '') <> '' OR coalesce(trim(description), '') <> ''")
    return {"other_filings": last_by_key(head, ["house_id"]), "other_activities": alis, "places": parsed.select("prov", F.col("prov").alias("path"), F.lit(0).cast("long").alias("byte"), "length", F.col("value").alias("record"))}


def releases(spark: SparkSession, path: str, year: int | None = None) -> dict[str, DataFrame]:
    """Tables releases and members of JSON lines, and the lines' places; files <year>/<year>-*.jsonl and <year>-*.jsonl.

    Line numbers are 1-based and count blank lines, in files of any size.
    """
    lines = numbered_lines(spark, path, pathGlobFilter=f"{year or '[0-9][0-9][0-9][0-9]'}-*.jsonl", recursiveFileLookup="true").where(F.trim("value") != "")
    lines = lines.withColumn("prov", F.concat(F.col("path"), F.lit("#L"), F.col("n")))
    rows = lines.select("prov", "path", "n", F.from_json("value", schemas.RELEASES_JSONL).alias("r")).where("r.url IS NOT NULL")
    order = [F.desc("path"), F.desc("n")]
    out = latest_per_key(rows.withColumn("url", F.col("r.url")), ["url"], order).select("url", "r.date", "r.title", F.col("r.member.bioguide_id").alias("member_id"), F.col("r.member.name").alias("member_name"), F.col("r.member.party").alias("member_party"), F.col("r.member.state").alias("member_state"), F.col("r.member.chamber").alias("member_chamber"), "r.text", "prov")
    named = rows.where("r.member.bioguide_id IS NOT NULL").withColumn("member_id", F.col("r.member.bioguide_id"))
    members = latest_per_key(named, ["member_id"], order).select("member_id", F.col("r.member.name").alias("name"), names.last_first_key(F.col("r.member.name")).alias("name_key"), F.col("r.member.party").alias("party"), F.col("r.member.state").alias("state"), F.col("r.member.chamber").alias("chamber"))
    return {"releases": out, "members": members, "places": lines.select("prov", "path", "byte", "length", F.col("value").alias("record"))}


def write_tables(tables: dict[str, DataFrame], root: str) -> None:
    """Parquet under root/<table>; a table with a year column is partitioned by it and only the years at hand are replaced.

    Writing the same records again leaves the same tables: children are replaced with their parents, not added.
    """
    for name, df in tables.items():
        if name == "places":  # the index is written by ingest
            continue
        _, part = schemas.TABLES[name]
        writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        (writer.partitionBy(part) if part else writer).parquet(f"{root}/{name}")


def ingest(spark: SparkSession, root: str, out: str, years: list[int] = [2025], datasets: tuple[str, ...] = ("filings", "contributions", "other", "releases")) -> list[str]:  # noqa: B006
    """Read what there is of each dataset and year below root and write its tables; missing files are left out.

    The table provenance_index has a part for each dataset, replaced with it.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    exists = lambda p: bool(hadoop(p).getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop(p)))
    done: list[str] = []
    for name, reader, pattern in (("filings", filings, "filings_{}.json"), ("contributions", contributions, "contributions_{}.json")):
        paths = [p for y in years if exists(p := f"{root}/{pattern.format(y)}")]
        if name in datasets and paths:
            done += _write(name, reader(spark, paths), out)
    for name, reader, pattern in (("other", other_filings, "*_XML/*.xml"), ("releases", releases, "*/*.jsonl")):
        if name in datasets and exists(f"{root}/{name}/{pattern}"):
            done += _write(name, reader(spark, f"{root}/{name}"), out)
    return done


def _write(dataset: str, tables: dict[str, DataFrame], out: str) -> list[str]:
    write_tables(tables, out)
    write_tables({"provenance_index": index_of(tables.pop("places")).withColumn("dataset", F.lit(dataset))}, out)
    return list(tables)


def places(spark: SparkSession, path: str) -> DataFrame:
    """(prov, path, byte, length, record) of a file, or of those that a pattern names, by its ending: .jsonl lines, .xml whole files, JSON arrays."""
    if path.endswith(".jsonl"):
        return numbered_lines(spark, path).select(F.concat("path", F.lit("#L"), "n").alias("prov"), "path", "byte", "length", F.col("value").alias("record")).where("record <> ''")
    if path.endswith(".xml"):
        raw = spark.read.text(path, wholetext=True).select(file_path().alias("path"), F.col("value").alias("record"))
        return raw.select(F.col("path").alias("prov"), "path", F.lit(0).cast("long").alias("byte"), F.octet_length("record").cast("long").alias("length"), "record")
    found = array_records(spark, path)
    return found.select(F.concat("path", F.lit("#"), F.get_json_object("record", "$.filing_uuid")).alias("prov"), "path", "byte", "length", "record")


def provenance(spark: SparkSession, prov: str, root: str = "") -> DataFrame:
    """(prov, record, error): the raw record behind one provenance id, without an index: its file is read. For many ids see `provenance.look_up`."""
    path, hash_, place = prov.partition("#")
    full = f"{root.rstrip('/')}/{path.removeprefix('data/')}" if root else path
    wanted = spark.createDataFrame([(full + hash_ + place, prov)], "prov string, asked string")
    at = spark._jvm.org.apache.hadoop.fs.Path
    if not path or not at(full).getFileSystem(spark._jsc.hadoopConfiguration()).exists(at(full)):
        return wanted.select(F.col("asked").alias("prov"), F.lit(None).cast("string").alias("record"), F.lit(f"source file not found: {full}").alias("error"))
    found = places(spark, full)
    if not hash_:  # the file is the record
        found = spark.read.text(full, wholetext=True).select(F.lit(full).alias("prov"), F.lit(full).alias("path"), F.lit(0).alias("byte"), F.col("value").alias("record"))
    return look_up_by_scan(wanted, found).join(wanted, "prov").select(F.col("asked").alias("prov"), "record", F.when(F.col("record").isNull() & F.startswith("error", F.lit("source file")), "no such record").otherwise(F.col("error")).alias("error"))


def flatten_snapshot(spark: SparkSession, path: str, member_schema: str) -> DataFrame:
    """A snapshot {members: {id: {...}}} as rows with their id."""
    raw = spark.read.schema(f"members map<string, struct<{member_schema}>>").option("multiLine", True).json(path)
    return raw.select(F.explode("members").alias("member_id", "m")).select("member_id", "m.*")


def write_snapshot(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def roll_call_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.option("header", True).schema(schemas.ROLL_CALLS[name]).csv(path)


def roster(members: DataFrame, committees: DataFrame, terms: DataFrame) -> DataFrame:
    """Members with committee roles, current-term chamber, party and state, and candidate ids of the chamber's prefix (all, if none has it)."""
    now = F.element_at("terms", -1)
    chamber = F.when(now["type"] == "sen", "senate").otherwise("house")
    prefix = F.when(now["type"] == "sen", "S").otherwise("H")
    mine = F.filter("candidate_ids", lambda x: x.startswith(prefix))
    current = terms.select("member_id", chamber.alias("chamber"), now["party"].alias("party"), now["state"].alias("state"), F.when(F.size(mine) > 0, mine).otherwise(F.col("candidate_ids")).alias("candidate_ids"))
    roles = committees.groupBy("member_id").agg(F.sort_array(F.collect_list(F.struct("rank", "committee", "title"))).alias("roles"))
    return members.join(current, "member_id").join(roles, "member_id", "left")


def dumps(df: DataFrame) -> DataFrame:
    """Rows as JSON lines, for output."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


