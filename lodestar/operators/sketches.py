"""Distinct counts for any set of periods from mergeable sketches, kept by key and period.

Exact distinct counts don't add up over periods; HyperLogLog sketches do. A sketch table has a row for each key and period, so counts over
any periods read some kilobytes a key and no facts. The standard error of a merged count is about 1.04 / 2**(lg / 2), 1.6 % for lg 12; exact
counts (`exact_distinct`) stay beside for where a number is quoted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG = 12


def bound(lg: int = LG, deviations: float = 4.0) -> float:
    """The relative error that a count stays within but for one in 16,000 (four standard errors)."""
    return deviations * 1.04 / 2 ** (lg / 2)


def sketch_table(facts: DataFrame, keys: Sequence[str], period: str, counted: str, lg: int = LG) -> DataFrame:
    """(keys, period, n, sketch): rows and a sketch of the distinct values of `counted`; nulls aren't counted."""
    return facts.groupBy(*keys, period).agg(F.count("*").alias("n"), F.hll_sketch_agg(F.col(counted).cast("string"), lg).alias("sketch"))


def write_sketches(table: DataFrame, period: str, path: str) -> None:
    """Parquet by period; periods at hand are replaced, others stay."""
    table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(period).parquet(path)


def distinct_over(table: DataFrame, keys: Sequence[str], periods: Column | None = None) -> DataFrame:
    """(keys, n, estimate) over the periods that meet a condition; a coarser set of keys than the table's will do."""
    rows = table if periods is None else table.where(periods)
    return rows.groupBy(*keys).agg(F.sum("n").alias("n"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))


def exact_distinct(facts: DataFrame, keys: Sequence[str], counted: str, periods: Column | None = None) -> DataFrame:
    rows = facts if periods is None else facts.where(periods)
    return rows.groupBy(*keys).agg(F.countDistinct(counted).alias("exact"))
