"""Queries over kept sketches, totals that amendments move, and moves of a state machine."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import integrity, sketches
from ..scratch import shared_folder
from ..streaming import totals
from .registry import made_once, query, table

#: Spans of years that one sketch table answers.
SPANS = {"1995": [1995], "1994-1996": [1994, 1995, 1996], "even": [1992, 1994, 1996, 1998, 2000], "all": None}
_IN = {s: "true" if years is None else f"y IN ({', '.join(map(str, years))})" for s, years in SPANS.items()}


def _counterparties(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey")
    return lines.join(table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("y")), F.col("l_orderkey") == F.col("o_orderkey"))


@query("WITH f AS (SELECT l_suppkey, o_custkey, year(o_orderdate) AS y FROM lineitem JOIN orders ON l_orderkey = o_orderkey) " + " UNION ALL ".join(f"SELECT '{s}' AS span, l_suppkey, count(*) AS n, count(DISTINCT o_custkey) AS customers, true AS near FROM f WHERE {c} GROUP BY l_suppkey" for s, c in _IN.items()))
def counterparties_by_span(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct customers of each supplier over four spans of years: exact, and whether the estimate from the kept sketches is within the stated bound."""
    kept = made_once(spark, sf, ("lineitem", "orders"), "sketches", lambda s, d: sketches.sketch_table(_counterparties(s, d), ["l_suppkey"], "y", "o_custkey"))
    facts, out = _counterparties(spark, sf), None
    for span, years in SPANS.items():
        some = None if years is None else F.col("y").isin(years)
        both = sketches.distinct_over(kept, ["l_suppkey"], some).join(sketches.exact_distinct(facts, ["l_suppkey"], "o_custkey", some), "l_suppkey")
        near = F.abs(F.col("estimate") - F.col("exact")) <= F.greatest(F.lit(1.0), F.col("exact") * sketches.bound())
        rows = both.select(F.lit(span).alias("span"), "l_suppkey", "n", F.col("exact").alias("customers"), near.alias("near"))
        out = rows if out is None else out.unionByName(rows)
    return out


HOW = totals.Totals(("id",), ("version",), "date_format(day, 'yyyy-MM')", ("status",), "amount")


@query("""WITH v AS (SELECT o_orderkey AS id, 1 AS version, o_orderdate::DATE AS day, o_orderstatus AS status, o_totalprice AS amount FROM orders
UNION ALL SELECT o_orderkey, 2, o_orderdate::DATE + 20, o_orderstatus, o_totalprice * 2 FROM orders WHERE o_orderkey % 10 = 0 UNION ALL SELECT o_orderkey, 3, o_orderdate::DATE, 'Z', -1 FROM orders WHERE o_orderkey % 15 = 0 AND o_custkey % 4 = 1)
SELECT strftime(day, '%Y-%m') AS period, status, count(*) AS n, sum(amount::DECIMAL(18,2))::DOUBLE AS total FROM (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC) = 1) GROUP BY 1, 2""")
def amended_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Totals by month and status after three batches, two of them of amendments that change amounts, days and statuses; the last repeats old versions too."""
    orders, root = table(spark, sf, "orders"), f"{shared_folder(spark)}/totals-{uuid.uuid4().hex}"
    k = F.col("o_orderkey")
    record = lambda rows, version, day, status, amount: rows.select(k.alias("id"), F.lit(version).alias("version"), day.cast("date").alias("day"), status.alias("status"), amount.cast("double").alias("amount"))
    day, status, amount = F.col("o_orderdate").cast("date"), F.col("o_orderstatus"), F.col("o_totalprice")
    HOW.apply(record(orders, 1, day, status, amount), root, 0)
    HOW.apply(record(orders.where(k % 10 == 0), 2, F.date_add(day, 20), status, amount * 2), root, 1)
    late = record(orders.where((k % 15 == 0) & (F.col("o_custkey") % 4 == 1)), 3, day, F.lit("Z"), F.lit(-1.0))
    HOW.apply(late.unionByName(record(orders.where(k % 25 == 0), 1, day, status, amount)), root, 2)
    return HOW.read(spark, root, {"status": "string"}).select("period", "status", "n", F.col("total").cast("double").alias("total"))


_TO = ["chasing", "confirmed", "cold", "killed", "open"]
_LEGAL = "[" + ", ".join(f"'{a}>{b}'" for a, to in integrity.TRANSITIONS.items() for b in to) + "]"
_STEP = f"""CASE WHEN list_contains({_LEGAL}, split_part(a, '|', 1) || '>' || split_part(x, '|', 1)) AND NOT (split_part(x, '|', 1) IN ('cold', 'killed') AND split_part(x, '|', 2) = '') AND NOT (split_part(x, '|', 1) = 'confirmed' AND split_part(x, '|', 3) = '0')
  THEN split_part(x, '|', 1) || '|' || (split_part(a, '|', 2)::INT + 1) ELSE split_part(a, '|', 1) || '|' || split_part(a, '|', 2) END"""


@query(f"""WITH m AS (SELECT o_custkey AS id, o_orderkey AS seq, {_TO}[o_orderkey % 7 % 5 + 1] || '|' || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'why' END || '|' || (o_orderkey % 2) AS x FROM orders),
l AS (SELECT id, count(*) AS n, list_reduce(list_prepend(CASE WHEN id % 6 = 0 THEN 'cold|0' ELSE 'open|0' END, list(x ORDER BY seq)), LAMBDA a, x: {_STEP}) AS s FROM m GROUP BY id)
SELECT id, split_part(s, '|', 1) AS status, split_part(s, '|', 2)::BIGINT AS n_moves, n - split_part(s, '|', 2)::BIGINT AS n_rejected FROM l""")
def replayed_moves(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer's orders as moves of a thread, some of which the machine rejects; every sixth thread begins cold."""
    k = F.col("o_orderkey")
    to = F.element_at(F.array(*map(F.lit, _TO)), (k % 7 % 5 + 1).cast("int"))
    given = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), k.alias("seq"), to.alias("to_status"), F.when(k % 3 == 0, " ").otherwise("why").alias("reason"), (k % 2).cast("int").alias("n_sources"))
    begun = given.select("id").distinct().select("id", F.when(F.col("id") % 6 == 0, "cold").otherwise("open").alias("status"))
    return integrity.replay(given, begun)
