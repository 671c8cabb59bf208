"""Tables in parts, of which a batch replaces those that it touches; what stands is a list of the batch that wrote each part last.

A batch writes its parts into a folder of its own and then the list. A batch that is run again after a failure starts from the list before it and
gives the same result; readers see whole batches only.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


class Parts:
    def __init__(self, spark: SparkSession, path: str, column: str, kind: str, schema: str):
        """A table below path with parts by a column of a kind (int or string); schema is that of its rows without the column."""
        self.spark, self.path, self.column, self.kind, self.schema = spark, path, column, kind, schema

    def _at(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def current(self, before: int | None = None) -> dict[int | str, int]:
        """The batch that wrote each part last, by the latest list (before a batch); nothing if there is none."""
        at = self._at(f"{self.path}/current")
        store = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not store.exists(at):
            return {}
        lists = [int(f.getPath().getName()) for f in store.listStatus(at)]
        done = [b for b in lists if (before is None or b < before) and store.exists(self._at(f"{self.path}/current/{b}/_SUCCESS"))]
        if not done:
            return {}
        return {r["part"]: r["batch"] for r in self.spark.read.schema(f"part {self.kind}, batch long").json(f"{self.path}/current/{max(done)}").collect()}

    def read(self, parts: Iterable[int | str] | None = None, before: int | None = None) -> DataFrame:
        """The rows of some parts, or of all, with the column."""
        known = self.current(before)
        wanted = known if parts is None else {p: known[p] for p in parts if p in known}
        store = self._at(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        # A part that a batch left empty has no folder.
        folders = [f for p, b in wanted.items() if store.exists(self._at(f := f"{self.path}/data/{b}/{self.column}={p}"))]
        whole = f"{self.schema}, {self.column} {self.kind}"
        if not folders:
            return self.spark.createDataFrame([], whole)
        # Each batch's folder is the base of its own parts.
        out = None
        for b in sorted(set(wanted.values())):
            mine = [f for f in folders if f.startswith(f"{self.path}/data/{b}/")]
            if mine:
                rows = self.spark.read.schema(whole).option("basePath", f"{self.path}/data/{b}").parquet(*mine)
                out = rows if out is None else out.unionByName(rows)
        return out

    def replace(self, rows: DataFrame, touched: Iterable[int | str], batch: int) -> None:
        """Write the touched parts (rows with the column) and the list that has them; the other parts' files stay as they are."""
        rows.repartition(self.column).write.mode("overwrite").partitionBy(self.column).parquet(f"{self.path}/data/{batch}")
        listed = [(p, b) for p, b in {**self.current(batch), **dict.fromkeys(touched, batch)}.items()]
        self.spark.createDataFrame(listed, f"part {self.kind}, batch long").coalesce(1).write.mode("overwrite").json(f"{self.path}/current/{batch}")
