"""Tables written for the time of an application, in the folder that driver and executors share."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application below spark.checkpoint.dir, else below the checkpoint folder that was set; a temporary one on local masters only."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _temporary()
    return f"{base.rstrip('/')}/records-{context.applicationId}"


@functools.cache
def _temporary() -> str:
    return tempfile.mkdtemp(prefix="records-")


def written(df: DataFrame, label: str) -> DataFrame:
    """df, written once and read from there: what reads it twice sees the same rows in the same ranges."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_files(df: DataFrame, root: str) -> None:
    """root/<folder>/<name> for each row (folder, name, value): its value and a line feed.

    Tasks write each file under its own name (first hidden, then moved, so that a task may run twice), and the driver sees none of them. Files are
    opened with pyarrow's file systems; where only Spark writes a store, Spark does, and the driver renames file after file.
    """
    try:
        fs.FileSystem.from_uri(root)
    except (OSError, pa.ArrowInvalid):
        return _write_and_rename(df, root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(root)
        made, mark = set(), uuid.uuid4().hex
        for batch in batches:
            for folder, name, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if folder not in made:
                    store.create_dir(f"{base}/{folder}", recursive=True)
                    made.add(folder)
                with store.open_output_stream(f"{base}/{folder}/.{name}-{mark}") as out:
                    out.write(((value or "") + "\n").encode())
                store.move(f"{base}/{folder}/.{name}-{mark}", f"{base}/{folder}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    # A number of its own: by their bytes, rows this small would be put into few tasks.
    spread = df.select("folder", "name", "value").repartition(4 * df.sparkSession.sparkContext.defaultParallelism, "folder", "name")
    spread.mapInArrow(run, "n long").write.format("noop").mode("overwrite").save()


def _write_and_rename(df: DataFrame, root: str) -> None:
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path
    store = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    parts = f"{root}/parts-{uuid.uuid4().hex}"
    df.select("folder", "name", "value").repartition("folder", "name").write.option("lineSep", "\n").partitionBy("folder", "name").text(parts)
    for folder in store.listStatus(path(parts)):
        for name in store.listStatus(folder.getPath()) if folder.isDirectory() else []:
            to = f"{root}/{folder.getPath().getName().partition('=')[2]}"
            store.mkdirs(path(to))
            for part in store.listStatus(name.getPath()):
                store.rename(part.getPath(), path(f"{to}/{name.getPath().getName().partition('=')[2]}"))
    store.delete(path(parts), True)


def clear(spark: SparkSession) -> None:
    """Delete the application's folder: for its end, or when none of its DataFrames is read any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
