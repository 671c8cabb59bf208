"""From provenance ids back to raw records: an index of byte ranges, and look-ups that read these ranges only.

The index has a row for each record: prov, path, byte, length. It is written with the tables (`records.ingest`) and joined with what is asked, so a
look-up of many ids shuffles ids and never texts. Ranges are read in the order of the files, in tasks of one stretch of a file each, so
one large file is read by many tasks. Files are opened with pyarrow's file systems (local, HDFS, S3 and others) or a function of
one's own; where only Spark reads a store, `look_up_by_scan` joins the records themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a file that one task reads from.
STRETCH = 256 << 20


def place_of(prov: Column) -> Column:
    """What follows the first #, if anything."""
    return F.when(F.contains(prov, F.lit("#")), F.substring(prov, F.instr(prov, "#") + 1, F.length(prov)))


def index_of(records: DataFrame) -> DataFrame:
    """The index of records (prov, path, byte, length); of one id the first place holds."""
    first = records.where("prov IS NOT NULL").groupBy("prov").agg(F.min(F.struct("path", "byte", "length")).alias("at"))
    return first.select("prov", "at.*")


def open_file(path: str) -> pa.NativeFile:
    store, inside = fs.FileSystem.from_uri(path)
    return store.open_input_file(inside)


def _asked(wanted: DataFrame, index: DataFrame, found: DataFrame) -> DataFrame:
    """(prov, record, error) for each distinct id that is asked; found has prov and record."""
    path, place = F.substring_index("prov", "#", 1), place_of(F.col("prov"))
    files = index.select(F.col("path").alias("known")).distinct()
    # An id is a path and a place in it; without a place the file is the record.
    met = wanted.select("prov").distinct().join(found, "prov", "left").withColumns({"file": path, "place": place})
    met = met.join(files, F.col("file") == F.col("known"), "left")
    line = F.col("place").startswith("L") & F.regexp_like("file", F.lit(r"\.jsonl$")) & ~F.regexp_like("place", F.lit("^L0*[1-9][0-9]*$"))
    why = F.when(F.col("record").isNotNull(), None).when(F.col("known").isNull(), F.concat(F.lit("source file not found: "), "file")).when(line, F.concat(F.lit("not a line: "), "place")).otherwise("no such record")
    return met.select("prov", "record", why.alias("error"))


def look_up(wanted: DataFrame, index: DataFrame, open_: Callable[[str], pa.NativeFile] = open_file) -> DataFrame:
    """(prov, record, error) of every distinct prov in wanted: one of record and error is null. Only the ranges of what is asked are read."""
    ranges = index.join(wanted.select("prov").distinct(), "prov", "left_semi").withColumn("stretch", F.floor(F.col("byte") / STRETCH))
    ranges = ranges.repartition("path", "stretch").sortWithinPartitions("path", "byte").select("prov", "path", "byte", "length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, file = None, None
        for batch in batches:
            raw = []
            for where, byte, length in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                if where != path:
                    if file:
                        file.close()
                    path, file = where, open_(where)
                raw.append(file.read_at(length, byte).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.string())], ["prov", "record"])
        if file:
            file.close()

    return _asked(wanted, index, ranges.mapInArrow(run, "prov string, record string"))


def look_up_by_scan(wanted: DataFrame, records: DataFrame) -> DataFrame:
    """The same from records (prov, path, record), read whole: for stores that only Spark opens."""
    found = records.join(wanted.select("prov").distinct(), "prov", "left_semi").groupBy("prov").agg(F.min_by("record", F.struct("path", "byte")).alias("record"))
    return _asked(wanted, records, found)
