"""All queries of the records engine by name, each with DuckDB SQL for the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..scratch import written


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


QUERIES: dict[str, Query] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function (spark, sf_dir) -> DataFrame under its name."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = Query(f, sql)
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What made_once has written, by application, folder, name and what the given files are like.
_MADE: dict[tuple, DataFrame] = {}


def files_like(spark: SparkSession, sf_dir: str, names: tuple[str, ...]) -> tuple:
    """Length and time of the tables' files: another answer is another input."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    out = []
    for p in (path(f"{sf_dir}/{n}.parquet") for n in names):
        store = p.getFileSystem(spark._jsc.hadoopConfiguration())
        out += sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in store.listStatus(p))
    return tuple(out)


def made_once(spark: SparkSession, sf_dir: str, names: tuple[str, ...], label: str, make: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    """make(spark, sf_dir), written once for these tables as they are, and read from there."""
    key = (spark.sparkContext.applicationId, sf_dir, label, files_like(spark, sf_dir, names))
    if key not in _MADE:
        _MADE[key] = written(make(spark, sf_dir), label)
    return _MADE[key]


def re2(pattern: str) -> str:
    """A pattern as an SQL literal for an engine whose word boundary knows ASCII letters only: boundaries are spelt out.

    They take a character, so this is for tests whether a pattern occurs and not for what it matches.
    """
    ends = re.sub(r"\\b(?=$|[|)])", r"(?:[^\\p{L}\\p{N}_]|$)", pattern)
    return "'" + ends.replace(r"\b", r"(?:^|[^\p{L}\p{N}_])").replace("'", "''") + "'"


from . import documents, facts, files, incremental, investigation, profiles  # noqa: E402, F401  they fill QUERIES
