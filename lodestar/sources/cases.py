"""Case folders: thread files with a flat head, registries of entities and findings as JSON lines. Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .splits import file_path

#: The block between dashes that a thread begins with, and what follows it.
HEAD = r"(?s)\A---[ \t]*\n(.*?)(?:\n|(?<=\n))---[ \t]*(?:\n+(.*))?\z"


def head_of(text: Column) -> Column:
    """The lines `key: value` of a text's head as an array of (key, value), blanks and one pair of quotes about a value dropped; other lines are left out."""
    lines = F.filter(F.split(F.regexp_extract(text, HEAD, 1), "\n"), lambda x: x.rlike(r"^\w[\w-]*:"))
    bare = lambda v: F.regexp_replace(F.trim(v), r"""^(["'])(.*)\1$""", "$2")
    return F.transform(lines, lambda x: F.struct(F.substring_index(x, ":", 1).alias("key"), bare(F.regexp_extract(x, r"^[^:]*:(.*)$", 1)).alias("value")))


def field(head: Column, key: str) -> Column:
    """The last value of a key that isn't empty."""
    found = F.filter(head, lambda x: (x["key"] == key) & (x["value"] != ""))
    return F.try_element_at(found, F.lit(-1))["value"]


def listed(value: Column) -> Column:
    """[a, "b"] as an array; a bare value is a list of it, and none is empty."""
    inner = F.transform(F.split(F.regexp_extract(value, r"(?s)^\[(.*)\]$", 1), ","), lambda x: F.regexp_replace(F.trim(x), r"""^(["'])(.*)\1$""", "$2"))
    return F.when(value.startswith("["), F.filter(inner, lambda x: x != "")).when(value != "", F.array(value)).otherwise(F.array().cast("array<string>"))


def thread_rows(files: DataFrame) -> DataFrame:
    """Threads from (file, text): file, id (else the file's name), title, status, priority, next_action, reason, entities, source_records, body."""
    held = files.withColumn("__head", head_of(F.col("text")))
    body = F.when(F.col("text").rlike(HEAD), F.regexp_extract("text", HEAD, 2)).otherwise(F.col("text"))
    plain = [field(F.col("__head"), c).alias(c) for c in ("title", "status", "priority", "next_action", "reason")]
    lists = [listed(field(F.col("__head"), c)).alias(c) for c in ("entities", "source_records")]
    stem = F.regexp_extract("file", r"([^/]*)\.md$", 1)
    return held.select("file", F.coalesce(field(F.col("__head"), "id"), stem).alias("id"), *plain, *lists, body.alias("body"))


def threads(spark: SparkSession, folder: str) -> DataFrame:
    """Threads of <folder>/threads/*.md, see thread_rows."""
    return thread_rows(spark.read.text(f"{folder}/threads/*.md", wholetext=True).select(file_path().alias("file"), F.col("value").alias("text")))


def entities(spark: SparkSession, folder: str) -> DataFrame:
    """(entity_id, kind, display, status, why) of <folder>/entities.jsonl; entries without an id are left out."""
    return spark.read.schema("entity_id string, kind string, display string, status string, why string").json(f"{folder}/entities.jsonl").where("entity_id IS NOT NULL")


def findings(spark: SparkSession, folder: str) -> DataFrame:
    """(id, kind, summary, source_records) of <folder>/findings.jsonl."""
    return spark.read.schema("id string, kind string, summary string, source_records array<string>").json(f"{folder}/findings.jsonl")
