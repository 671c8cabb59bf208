"""Profiles of tables of any schema: types, statistics, correlations, histograms and checks of reported figures."""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import drop_thousands, renderings
from ..scratch import written
from .containment import contains_join
from .ranking import exact_median


def clean(c: str) -> Column:
    """A numeric column without NaN and infinities."""
    x = F.col(f"`{c}`").try_cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def column_types(df: DataFrame) -> DataFrame:
    """(column, type, detail, n, n_distinct) of every column: one aggregation over the table, and a narrow distinct for each column.

    Type: text, integer (all whole) or numeric. Detail: identifier, ordinal, categorical, continuous or free text by the
    name, the distinct count and its share.
    """
    names = df.columns
    aggs = []
    for i, c in enumerate(names):
        x, text = clean(c), F.trim(F.col(f"`{c}`").cast("string"))
        aggs += [F.count(F.nullif(text, F.lit(""))).alias(f"n{i}"), F.count(x).alias(f"f{i}"), F.count_if(x % 1 != 0).alias(f"d{i}")]
    row = df.agg(*aggs)
    distinct = functools.reduce(DataFrame.unionByName, (df.select(F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")).alias("v")).where("v IS NOT NULL").distinct().agg(F.lit(c).alias("column"), F.count("*").alias("u")) for c in names))
    kinds = dict(df.dtypes)
    boxes = F.array(*(F.struct(F.lit(c).alias("column"), F.lit(kinds[c] == "boolean").alias("flag"), *(F.col(f"{k}{i}").alias(k) for k in "nfd")) for i, c in enumerate(names)))
    rows = row.select(F.explode(boxes).alias("b")).select("b.*").join(distinct, "column")
    numeric = ~F.col("flag") & (F.col("n") > 0) & (F.col("f") == F.col("n"))
    type_ = F.when(~numeric, "text").when(F.col("d") > 0, "numeric").otherwise("integer")
    share = F.try_divide(F.col("u"), F.col("n"))
    named = F.lower("column").rlike("(^|_)id$")
    detail = (
        F.when(numeric & (named | (F.col("d") == 0) & (share > 0.95)), "identifier")
        .when(numeric & (F.col("u") <= 12), "ordinal")
        .when(numeric, "continuous")
        .when((share > 0.9) & (F.col("n") > 20), "identifier")
        .when(F.col("u") <= 20, "categorical")
        .otherwise("free text")
    )
    return rows.select("column", type_.alias("type"), detail.alias("detail"), F.col("n"), F.col("u").alias("n_distinct"))


def statistics(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, mean, median, min, max, sample standard deviation and range of each column; columns without numbers are left out."""
    aggs = []
    for i, c in enumerate(columns):
        x = clean(c)
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"a{i}"), F.min(x).alias(f"l{i}"), F.max(x).alias(f"h{i}"), F.stddev_samp(x).alias(f"s{i}")]
    boxes = F.array(*(F.struct(F.lit(c).alias("column"), *(F.col(f"{k}{i}").alias(n) for k, n in zip("nalhs", ("n", "mean", "min", "max", "std"), strict=True))) for i, c in enumerate(columns)))
    found = df.agg(*aggs).select(F.explode(boxes).alias("b")).select("b.*").where("n > 0").withColumn("range", F.col("max") - F.col("min"))
    values = df.select(*(clean(c).alias(c) for c in columns)).unpivot([], [F.col(f"`{c}`") for c in columns], "column", "value")
    return found.join(exact_median(values, "column", "value"), "column").select("column", "n", "mean", "median", "min", "max", "std", "range")


def correlations(df: DataFrame, columns: Sequence[str], least: float = 0.4) -> DataFrame:
    """Pearson correlation of each pair over rows where both are numbers, |r| > least, from one aggregation.

    A constant column has none.
    """
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    if not pairs:
        return df.sparkSession.createDataFrame([], "var1 string, var2 string, r double")
    aggs = []
    for i, (a, b) in enumerate(pairs):
        both = clean(a).isNotNull() & clean(b).isNotNull()
        x, y = F.when(both, clean(a)), F.when(both, clean(b))
        aggs += [F.covar_pop(x, y).alias(f"c{i}"), F.stddev_pop(x).alias(f"x{i}"), F.stddev_pop(y).alias(f"y{i}")]
    boxes = F.array(*(F.struct(F.lit(a).alias("var1"), F.lit(b).alias("var2"), F.when((F.col(f"x{i}") > 0) & (F.col(f"y{i}") > 0), F.round(F.try_divide(F.col(f"c{i}"), F.col(f"x{i}") * F.col(f"y{i}")), 4)).alias("r")) for i, (a, b) in enumerate(pairs)))
    return df.agg(*aggs).select(F.explode(boxes).alias("b")).select("b.*").where(F.abs("r") > least)


def histogram(df: DataFrame, column: str) -> DataFrame:
    """(bin, n): min(30, max(5, floor of the root of n)) bins of equal width; the largest value is in the last one."""
    stats = df.agg(F.count(clean(column)).alias("n"), F.min(clean(column)).alias("lo"), F.max(clean(column)).alias("hi")).first()
    if not stats["n"]:
        return df.sparkSession.createDataFrame([], "bin int, n long")
    bins, lo, hi = min(30, max(5, math.isqrt(stats["n"]))), stats["lo"], stats["hi"]
    place = F.when(F.lit(hi == lo), 1).otherwise(F.least(F.floor((F.col("x") - lo) * bins / F.lit(hi - lo if hi > lo else 1.0)) + 1, F.lit(bins)))
    return df.select(clean(column).alias("x")).where("x IS NOT NULL").groupBy(place.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """All pairs of a heat map, both ways, without a threshold."""
    half = correlations(df, columns, -1.0)
    return half.unionByName(half.select(F.col("var2").alias("var1"), F.col("var1").alias("var2"), "r"))


def missing_figures(stats: DataFrame, report: DataFrame) -> DataFrame:
    """Statistics (column, name, value) that occur in no line of the report in any rendering of none to three decimals: lines and renderings meet by their grams."""
    lines = report.select(drop_thousands(F.col("line")).alias("text"))
    wanted = written(stats.select("column", "name", "value"), "figures")
    shown = wanted.select("column", "name", F.explode(renderings(F.col("value"))).alias("needle"))
    seen = shown.join(contains_join(lines, shown.select("needle")).select("needle").distinct(), "needle").select("column", "name").distinct()
    return wanted.join(seen, ["column", "name"], "left_anti")


def pair_key(a: Column, b: Column) -> Column:
    """One key for a pair in either order."""
    return F.concat(F.least(a, b), F.lit("|"), F.greatest(a, b))


def unreported_pairs(pairs: DataFrame, reported: DataFrame, tolerance: float = 0.015) -> DataFrame:
    """Correlations without a reported one for the same pair within the tolerance; the sign isn't read."""
    p = pairs.withColumn("pair", pair_key(F.col("var1"), F.col("var2")))
    r = reported.select(pair_key(F.col("var1"), F.col("var2")).alias("pair"), F.col("r").alias("__r"))
    return p.alias("p").join(r.alias("r"), (F.col("p.pair") == F.col("r.pair")) & (F.abs(F.abs(F.col("p.r")) - F.abs(F.col("__r"))) <= tolerance), "left_anti").drop("pair")
