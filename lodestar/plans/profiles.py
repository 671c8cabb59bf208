"""Queries that profile tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import profiling
from .registry import query, table

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("""
SELECT * FROM (VALUES ('event_id', 'integer', 'identifier'), ('user_id', 'integer', 'identifier'), ('event_type', 'text', 'categorical'), ('value', 'numeric', 'continuous')) v("column", type, detail)
JOIN (SELECT 'event_id' AS "column", count(event_id) AS n, count(DISTINCT event_id) AS n_distinct FROM events UNION ALL SELECT 'user_id', count(user_id), count(DISTINCT user_id) FROM events
  UNION ALL SELECT 'event_type', count(event_type), count(DISTINCT event_type) FROM events UNION ALL SELECT 'value', count(value), count(DISTINCT value) FROM events) USING ("column")""")
def profile_types(spark: SparkSession, sf: str) -> DataFrame:
    return profiling.column_types(table(spark, sf, "events").select("event_id", "user_id", "event_type", "value"))


_STATS = " UNION ALL ".join(f"""SELECT '{c}' AS "column", count({c}) AS n, round(avg({c}), 6) AS mean, median({c}) AS median, min({c}) AS min, max({c}) AS max, round(stddev_samp({c}), 6) AS std, max({c}) - min({c}) AS range FROM lineitem""" for c in NUMBERS)


@query(_STATS)
def profile_stats(spark: SparkSession, sf: str) -> DataFrame:
    return profiling.statistics(table(spark, sf, "lineitem"), NUMBERS).withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


_NET = {"l_extendedprice": "l_extendedprice", "l_net": "l_extendedprice * (1 - l_discount)", "l_due": "-l_extendedprice * (1 - l_discount) * (1 + l_tax)", "l_tax": "l_tax", "l_one": "1.0"}
_STRONG = " UNION ALL ".join(f"SELECT '{a}' AS var1, '{b}' AS var2, round(corr({_NET[a]}, {_NET[b]}), 4) AS r FROM lineitem" for a, b in (("l_extendedprice", "l_net"), ("l_extendedprice", "l_due"), ("l_net", "l_due")))


@query(_STRONG)
def profile_corr(spark: SparkSession, sf: str) -> DataFrame:
    """Three columns that go together, one that goes with none, and a constant."""
    rows = table(spark, sf, "lineitem").select(*(F.expr(e).cast("double").alias(c) for c, e in _NET.items()))
    return profiling.correlations(rows, list(_NET))


@query("""
WITH s AS (SELECT count(*) AS n, min(value) AS lo, max(value) AS hi, least(30, greatest(5, floor(sqrt(count(*)))))::INT AS b FROM events)
SELECT least(floor((value - lo) * b / (hi - lo)) + 1, b)::INT AS bin, count(*) AS n FROM events, s GROUP BY 1""")
def profile_hist(spark: SparkSession, sf: str) -> DataFrame:
    return profiling.histogram(table(spark, sf, "events"), "value")


_LONG = " UNION ALL ".join(f"""SELECT '{c}' AS "column", unnest(['n', 'mean', 'median', 'min', 'max', 'std', 'range']) AS name, unnest([count({c})::DOUBLE, avg({c}), median({c}), min({c}), max({c}), stddev_samp({c}), max({c}) - min({c})]) AS value FROM lineitem""" for c in NUMBERS)


@query(f"""WITH s AS ({_LONG}), lines AS (SELECT 'The figure is ' || printf('%.2f', value) || ' here.' AS line FROM s WHERE name IN ('mean', 'max') AND "column" <> 'l_tax'),
r AS (SELECT "column", name, unnest([printf('%.0f', value), printf('%.1f', value), printf('%.2f', value), printf('%.3f', value)]) AS shown FROM s)
SELECT DISTINCT "column", name FROM s WHERE ("column", name) NOT IN (SELECT ("column", name) FROM r JOIN lines ON contains(line, shown))""")
def figure_check(spark: SparkSession, sf: str) -> DataFrame:
    """Statistics of the lines that a report with the means and largest values of three columns lacks."""
    stats = profiling.statistics(table(spark, sf, "lineitem"), NUMBERS)
    long_ = stats.withColumn("n", F.col("n").cast("double")).unpivot(["column"], ["n", "mean", "median", "min", "max", "std", "range"], "name", "value")
    told = long_.where("name IN ('mean', 'max') AND `column` <> 'l_tax'")
    report = told.select(F.concat(F.lit("The figure is "), F.format_number("value", 2), F.lit(" here.")).alias("line"))
    return profiling.missing_figures(long_, report).select("column", "name")


_PAIRS = [(a, b) for i, a in enumerate(NUMBERS) for b in NUMBERS[i + 1 :]]
_MATRIX = " UNION ALL ".join(f"SELECT '{x}' AS var1, '{y}' AS var2, round(corr({a}, {b}), 4) AS r FROM lineitem" for a, b in _PAIRS for x, y in ((a, b), (b, a)))


@query(_MATRIX)
def profile_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return profiling.correlation_matrix(table(spark, sf, "lineitem"), NUMBERS)


_REPORTED = " UNION ALL ".join(f"SELECT '{a}' AS var1, '{b}' AS var2, round(corr({_NET[a]}, {_NET[b]}), 4) AS r, round(corr({_NET[a]}, {_NET[b]}) FILTER (l_returnflag = 'R' AND l_quantity < 20 + l_linenumber), 4) AS told FROM lineitem" for i, a in enumerate(_NET) for b in list(_NET)[i + 1 :] if b != "l_one")


@query(f"SELECT var1, var2 FROM ({_REPORTED}) WHERE abs(abs(r) - abs(told)) > 0.015 OR told IS NULL OR abs(told) <= 0.01")
def reported_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Correlations over all lines that a report drawn up from some of the lines lacks, or states too far off; it names pairs the other way round and
    leaves out weak ones."""
    lines = table(spark, sf, "lineitem")
    net = lambda rows: rows.select(*(F.expr(e).cast("double").alias(c) for c, e in _NET.items() if c != "l_one"))
    names = [c for c in _NET if c != "l_one"]
    pairs = profiling.correlations(net(lines), names, -1.0)
    told = profiling.correlations(net(lines.where("l_returnflag = 'R' AND l_quantity < 20 + l_linenumber")), names, 0.01)
    return profiling.unreported_pairs(pairs, told.select(F.col("var2").alias("var1"), F.col("var1").alias("var2"), (-F.col("r")).alias("r"))).select("var1", "var2")
