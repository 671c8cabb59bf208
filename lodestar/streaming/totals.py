"""Totals that amendments keep up to date: records arrive in versions, and each batch moves totals by what it changes.

A batch's records are compared with the latest versions known of their keys (only buckets of these keys are read): the version before, if it is
superseded, is a row to retract, and the new one a row to insert. These signed rows are summed by period and group, and added to the totals of
the periods that they touch; other periods' files, and other buckets', are not rewritten. Sums are decimals, so any order of batches that has the same
latest versions gives the same totals as a recomputation.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from .parts import Parts

SIGN = "__sign"


def change_feed(known: DataFrame, batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Signed rows: -1 for a known version that the batch supersedes, 1 for what supersedes it, or is new.

    known has one row a key at most. Of versions that agree in `order` the one that is known stays; in a batch, the first by all columns.
    """
    by = Window.partitionBy(*keys)
    newest = by.orderBy(*(F.desc(c) for c in order), F.desc("__old"), *(F.asc(c) for c in batch.columns if c not in {*keys, *order}))
    both = batch.withColumn("__old", F.lit(0)).unionByName(known.select(*batch.columns, F.lit(1).alias("__old")))
    ranked = both.withColumns({"__place": F.row_number().over(newest), "__met": F.min("__old").over(by)}).where("__met = 0")
    kept_old = F.max(F.when((F.col("__place") == 1) & (F.col("__old") == 1), 1).otherwise(0)).over(by)
    moved = ranked.withColumn("__kept", kept_old).where("__kept = 0 AND (__place = 1 OR __old = 1)")
    return moved.withColumn(SIGN, F.when(F.col("__place") == 1, 1).otherwise(-1)).select(*batch.columns, SIGN)


@dataclass(frozen=True)
class Totals:
    """How records become totals: keys and order of versions, the period that parts the totals (an SQL expression), the groups in it, and the amount."""

    keys: tuple[str, ...]
    order: tuple[str, ...]
    period: str
    groups: tuple[str, ...]
    amount: str
    buckets: int = 64

    def versions(self, spark: SparkSession, root: str, schema: str) -> Parts:
        return Parts(spark, f"{root}/versions", "__bucket", "int", schema)

    def sums(self, spark: SparkSession, root: str, kinds: dict[str, str]) -> Parts:
        return Parts(spark, f"{root}/totals", "period", "string", ", ".join([*(f"`{g}` {kinds[g]}" for g in self.groups), "n long", "total decimal(38,2)"]))

    def apply(self, batch: DataFrame, root: str, batch_id: int) -> None:
        """Bring versions and totals below root up to date with one batch of records."""
        spark, kinds = batch.sparkSession, dict(batch.dtypes)
        versions = self.versions(spark, root, ", ".join(f"`{c}` {t}" for c, t in batch.dtypes))
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        dealt = batch.withColumn("__bucket", bucket)
        touched = [r[0] for r in dealt.select("__bucket").distinct().collect()]  # `buckets` rows at most
        before = versions.read(touched, batch_id)
        feed = change_feed(before.drop("__bucket"), batch, list(self.keys), list(self.order)).persist()
        try:
            gone = feed.where(F.col(SIGN) == -1).select(*self.keys).distinct()
            stay = before.join(gone, list(self.keys), "left_anti").unionByName(feed.where(F.col(SIGN) == 1).drop(SIGN).withColumn("__bucket", bucket))
            moved = feed.groupBy(F.expr(self.period).cast("string").alias("period"), *self.groups).agg(F.sum(SIGN).alias("n"), F.sum(F.col(self.amount).cast("decimal(18,2)") * F.col(SIGN)).cast("decimal(38,2)").alias("total"))
            moved = moved.where("period IS NOT NULL").persist()
            periods = [r[0] for r in moved.select("period").distinct().collect()]  # periods that one batch touches
            sums = self.sums(spark, root, kinds)
            added = sums.read(periods, batch_id).unionByName(moved).groupBy("period", *self.groups).agg(F.sum("n").alias("n"), F.coalesce(F.sum("total"), F.lit(0)).cast("decimal(38,2)").alias("total"))
            sums.replace(added.where("n > 0"), periods, batch_id)
            versions.replace(stay, touched, batch_id)
            moved.unpersist()
        finally:
            feed.unpersist()

    def read(self, spark: SparkSession, root: str, kinds: dict[str, str]) -> DataFrame:
        """(groups, n, total, period) as of the last batch; kinds: the groups' types."""
        return self.sums(spark, root, kinds).read()

    def leaders(self, spark: SparkSession, root: str, kinds: dict[str, str], group: str, k: int, periods: Column | None = None) -> DataFrame:
        """The k groups of the largest totals over periods, from the kept totals; ties by group."""
        rows = self.read(spark, root, kinds)
        rows = rows if periods is None else rows.where(periods)
        return rows.groupBy(group).agg(F.sum("n").alias("n"), F.sum("total").cast("double").alias("total")).orderBy(F.desc("total"), F.asc(group)).limit(k)

    def stream(self, records: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
        """Apply each batch of a stream of records once."""
        return records.writeStream.foreachBatch(lambda df, i: self.apply(df, root, i)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
