"""What the corpus operators share: scratch tables and row counts."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of bytes that are neither a space nor one of U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir, else that of setCheckpointDir; a temporary folder only on local masters.

    On a cluster without either it raises: executors could not see one another's files.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _local_scratch()
    return f"{base.rstrip('/')}/lodestar-{context.applicationId}"


@functools.cache
def _local_scratch() -> str:
    return tempfile.mkdtemp(prefix="lodestar-")


def unused(df: DataFrame, *stems: str) -> list[str]:
    """A column name for each stem that df doesn't have, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for stem in stems:
        name, i = f"__{stem}", 0
        while name.lower() in taken:
            name, i = f"__{stem}_{i}", i + 1
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> str:
    """A column's name as it is, dots and quotes included."""
    return "`" + name.replace("`", "``") + "`"


#: Hashes below this are compared with a share of it to thin a sample out.
PARTS = 1 << 40


def bounded_sample(df: DataFrame, keys: list[str], max_rows: int, n: int | None = None) -> DataFrame:
    """At most max_rows rows to fit a model on: those of the smallest hashes of keys, so that reruns agree.

    keys must tell rows apart, else rows go or stay together. A count (or n) and a filter on the hash come first, so that
    tasks don't send max_rows rows each to the driver.
    """
    at = F.pmod(F.xxhash64(*keys), F.lit(PARTS))
    n = df.count() if n is None else n
    if n > 2 * max_rows:
        df = df.where(at < 2 * max_rows * PARTS // n + 1)
    return df.orderBy(at, F.xxhash64(*keys), *df.columns).limit(max_rows)


#: What a Python worker keeps between tasks of one operator, by operator: how to let it go.
KEPT: dict[str, Callable[[], None]] = {}


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], operator: str = "") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow: a worker that goes on to another operator first drops what it kept for the last one, and unused
    memory goes back to the system after each task, as workers live on between tasks."""

    @functools.wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, let_go in KEPT.items():
            if name != operator:
                let_go()
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):
                pass  # another C library

    return tidied


SMALL = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(df: DataFrame, limit: str = "8m") -> DataFrame:
    """df; a session that has not chosen how many bytes of rows go to Python at once sends `limit` from now on (a longer row goes alone).

    The setting is read when a query runs, so it can't be put back here; one that the session has chosen stays.
    """
    spark = df.sparkSession
    if not spark._jsparkSession.sessionState().conf().settings().containsKey(SMALL):
        spark.conf.set(SMALL, limit)
    return df


class _Made(threading.local):
    """Scratch tables that this thread has written and not dropped: folder, and name in the catalogue or None."""

    def __init__(self) -> None:
        self.tables: dict[str, str | None] = {}


MADE = _Made()


def materialize(df: DataFrame, label: str, bucket: str | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and return the written table.

    It cuts the lineage: a lost executor costs a reread, not a recomputation. With bucket it is a table bucketed by that column, with
    as many buckets as shuffle partitions: later joins by it don't shuffle it.
    """
    spark, name = df.sparkSession, f"lodestar_{label.replace('-', '_')}_{uuid.uuid4().hex}"
    path = f"{scratch_dir(spark)}/{name}"
    if bucket is None:
        df.write.parquet(path)
        MADE.tables[path] = None
        out = spark.read.schema(df.schema).parquet(path)
    else:
        df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), bucket).option("path", path).saveAsTable(name)
        MADE.tables[path] = name
        out = spark.table(name)
    out._scratch = path
    return out


def drop(spark: SparkSession, *tables: DataFrame | str) -> None:
    """Delete scratch tables (or their folders) that nothing will read again.

    What the last DataFrame of an operator reads can't be dropped by the operator, as it is read later: `drop_all` does it.
    """
    for t in tables:
        path = t if isinstance(t, str) else t._scratch
        name = MADE.tables.pop(path, None)
        if name:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def drop_all(spark: SparkSession) -> None:
    """Delete all scratch tables of this thread; DataFrames that operators returned before can't be read any more."""
    drop(spark, *list(MADE.tables))
