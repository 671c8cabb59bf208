"""Streams of records: files as they arrive, late corrections, windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from .parts import Parts


def stream_of(spark: SparkSession, folder: str, schema: StructType | str, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed_counts(events: DataFrame, time: str, keys: list[str], window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts by key and window; rows later than `late` behind the latest one seen are left out."""
    timed = events.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late)
    return timed.groupBy(F.window("__t", window).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def once(events: DataFrame, time: str, key: str, late: str = "2 days") -> DataFrame:
    """The first row of each key; copies that arrive within `late` are dropped with bounded state."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def latest_versions(records: DataFrame, keys: list[str], order: list[str], path: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Keep a table of the latest version of each key: each batch is merged with the table and the newest row stays.

    Keys are dealt into buckets by hash; a batch rewrites only the buckets that it touches (see Parts).
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        table = _versions(batch, path)
        dealt = batch.withColumn("__bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        touched = [r["__bucket"] for r in dealt.select("__bucket").distinct().collect()]  # `buckets` rows at most
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order)))
        newest = dealt.unionByName(table.read(touched, batch_id)).withColumn("__r", rank).where("__r = 1").drop("__r")
        table.replace(newest, touched, batch_id)

    return records.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _versions(like: DataFrame, path: str) -> Parts:
    return Parts(like.sparkSession, path, "__bucket", "int", ", ".join(f"`{c}` {t}" for c, t in like.dtypes if c != "__bucket"))


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """The table as of the last whole batch."""
    written_ = Parts(spark, path, "__bucket", "int", "")
    last = max(written_.current().values())
    return _versions(spark.read.parquet(f"{path}/data/{last}"), path).read().drop("__bucket")
