"""Mixing sources to target weights by systematic sampling.

Targets: sources share all words by weight; a target stops at `max_copies` times its source's words and the excess is
shared again by weight until none is above (closed form over the sources in order of cap / weight). Within a source documents expect
rate = target / words copies. Large documents (more than a hundredth of the target; the 512 largest at most) expect a whole number of
copies next to that rate, so chosen that the words taken stay near those expected; what is left of the target is spread over the
others, which expect copies at one rate: they lie on a line in an order close to ascending size, the prefix sums of the expected
copies are shifted by one random offset, and a document is taken once for each integer that its interval crosses:
floor(rank x rate + offset) - floor((rank - 1) x rate + offset), at most ceil(rate) <= max_copies. (A whole number of expected
copies crosses as many integers whatever the offset, so large documents need no place on the line.) A source's words miss the target by about
its largest document that isn't large, or, where all are, by half the least.

The prefix sums are hierarchical: (source, size class) -> hash block -> row, each level's sums partly aggregated before
the shuffle, so that a source with a third of all rows, or many rows of one size, spreads over blocks. Blocks follow
the row count. Sources may be as many as hosts: their order and sums are computed over range partitions, and only a
row for each partition, or one for all, reaches one task or the driver.

Null text has size 0; null is a source of its own, last; rows that repeat are taken one by one; an empty table gives an
empty result. A source without words has target 0. Reruns agree: offsets and blocks are hashes of seed, source and id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, materialize, quoted, unused


#: A document is large if it has more than this share of its source's target in words; a source has LARGEST large ones at most.
LARGE, LARGEST = 0.01, 512

#: The plan, one row for each source, is broadcast up to this many sources and joined by a shuffle beyond.
BROADCAST_SOURCES = 10_000


def md5_number(text: Column) -> Column:
    """A number below 2**32 from the first 8 hex digits of the MD5."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def running(rows: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """rows with, for each name in sums, the sum of its column over all rows before in the order (0 for the first).

    Rows are cut into ranges; the ranges' totals, one row for each partition, go through one task.
    """
    value = {f"value_{k}": v for k, v in sums.items()}
    cut = materialize(rows.repartitionByRange(*order).withColumns({"range": F.spark_partition_id(), **value}), "ranges")
    ahead = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy("range").agg(*(F.sum(f"value_{k}").alias(f"total_{k}") for k in sums))
    totals = totals.select("range", *(F.coalesce(F.sum(f"total_{k}").over(ahead), F.lit(0)).alias(f"start_{k}") for k in sums))
    before = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = cut.join(totals, "range")
    return out.select(*(F.col(c) for c in rows.columns), *((F.col(f"start_{k}") + F.coalesce(F.sum(f"value_{k}").over(before), F.lit(0))).alias(k) for k in sums))


def targets(totals: DataFrame, weights: Sequence[int], max_copies: int) -> DataFrame:
    """source, source_size, target of every row (source, size); sources by code point, null last, weights repeating in that order."""
    ranked = running(totals, [F.col("source").asc_nulls_last()], {"place": F.lit(1)})
    weight = F.element_at(F.lit(list(weights)), (F.col("place") % len(weights) + 1).cast("int"))
    weighed = ranked.select("source", "size", weight.cast("long").alias("w"))
    by_cap = F.col("size").cast("double") / F.col("w")
    filled = materialize(running(weighed.withColumn("by_cap", by_cap), [F.col("by_cap"), F.col("source").asc_nulls_last()], {"capped": F.col("size") * max_copies, "used": F.col("w")}), "levels")
    all_ = filled.agg(F.sum("size").alias("size"), F.sum("w").alias("w")).first()
    share = (F.lit(all_["size"] or 0) - F.col("capped")).cast("double") / (F.lit(all_["w"] or 1) - F.col("used")).cast("double")
    # The first source, in order of cap / weight, whose share is within its cap sets the level.
    fits = filled.withColumn("share", share).where(F.col("share") * F.col("w") <= F.col("size") * max_copies)
    level = fits.agg(F.min_by("share", F.struct("by_cap", F.col("source").isNull(), "source")).alias("share")).first()["share"] or 0.0
    target = F.least(F.lit(level) * F.col("w"), (F.col("size") * max_copies).cast("double"))
    return filled.select("source", F.col("size").alias("source_size"), target.alias("target"))


def plan_mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), max_copies: int = 3, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", rows_per_block: int = 20_000) -> DataFrame:
    """A row for each input row: id, source, size, text_key, source_size, target, copies."""
    text = F.col(quoted(text_col)).cast("string")
    narrow = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(source_col)).cast("string").alias("source"), word_count(text).alias("size"), F.xxhash64(text).alias("text_key"))
    return _plan(materialize(narrow, "mix-sizes"), weights, max_copies, seed, rows_per_block).withColumnsRenamed({"id": id_col})


def _null_safe(a: str, b: str, keys: Sequence[str]) -> list[Column]:
    return [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]


def large_documents(rows: DataFrame, plan: DataFrame, max_copies: int) -> DataFrame:
    """source, cut (documents above it are large), and large, an array of (id, text_key, size, copies), for each source that has any.

    The largest come first; each gets the whole number of copies next to the source's rate that leaves the words taken so far nearest to those
    expected. A source's list has LARGEST documents at most.
    """
    rate, low = F.col("target") / F.col("source_size"), F.floor(F.col("target") / F.col("source_size"))
    largest = rows.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("size"), "id", "text_key"))).where(F.col("rank") <= LARGEST + 1)
    above = largest.alias("r").join(plan.alias("p"), _null_safe("r", "p", ["source"])).where(F.col("size") > F.col("target") * LARGE).select("r.*", "target", "source_size")
    held = above.groupBy("source", "target", "source_size").agg(F.array_sort(F.collect_list(F.struct("rank", "size", "id", "text_key"))).alias("docs"))
    cut = F.when(F.size("docs") > LARGEST, F.element_at("docs", -1)["size"].cast("double")).otherwise(F.col("target") * LARGE)
    held = held.withColumn("cut", cut).withColumn("docs", F.filter("docs", lambda d: d["size"] > F.col("cut")))

    def step(a, d):
        less, more = a["ahead"] + (low - rate) * d["size"], a["ahead"] + (low + 1 - rate) * d["size"]
        up = (F.abs(more) < F.abs(less)) & (low + 1 <= max_copies)
        return F.struct(F.when(up, more).otherwise(less).alias("ahead"), F.concat(a["copies"], F.array(F.when(up, low + 1).otherwise(low))).alias("copies"))

    zero = F.struct(F.lit(0.0).alias("ahead"), F.array().cast("array<bigint>").alias("copies"))
    copies = F.aggregate("docs", zero, step, lambda a: a["copies"])
    named = F.transform(F.arrays_zip(F.col("docs").alias("d"), copies.alias("c")), lambda x: F.struct(x["d"]["id"].alias("id"), x["d"]["text_key"].alias("text_key"), x["d"]["size"].alias("size"), x["c"].alias("copies")))
    return held.select("source", "cut", named.alias("large"))


def _plan(rows: DataFrame, weights: Sequence[int], max_copies: int, seed: int, rows_per_block: int) -> DataFrame:
    name = F.coalesce(F.col("source"), F.lit("\x00null"))
    offset = md5_number(F.concat_ws(":", F.lit(f"offset {seed}"), name)) / F.lit(float(2**32))
    goal = materialize(targets(rows.groupBy("source").agg(F.sum("size").alias("size")), weights, max_copies).withColumn("offset", offset), "mix-targets")
    large = materialize(large_documents(rows, goal, max_copies), "mix-large")
    words = lambda part: F.aggregate(F.coalesce("large", F.array().cast(large.schema["large"].dataType)), F.lit(0).cast("long"), lambda n, d: n + part(d))
    plan = goal.alias("g").join(large.alias("l"), _null_safe("g", "l", ["source"]), "left").select("g.*", F.coalesce("cut", F.col("target") * LARGE).alias("cut"), words(lambda d: d["size"]).alias("large_size"), words(lambda d: d["size"] * d["copies"]).alias("large_taken"))
    # What large documents don't take of the target is spread over the others.
    spread = F.least(F.greatest((F.col("target") - F.col("large_taken")) / (F.col("source_size") - F.col("large_size")), F.lit(0.0)), F.lit(float(max_copies)))
    rate = F.when(F.col("source_size") > F.col("large_size"), spread).when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = materialize(plan.withColumn("rate", rate).drop("large_size", "large_taken"), "mix-plan")
    if plan.count() <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    blocks = max(16, rows.count() // rows_per_block)
    # Sizes whose bit length and next three bits agree form a class: about nine per cent wide.
    size = F.col("size")
    bits = F.length(F.bin(size)).cast("int")
    size_class = F.when(size < 16, size).otherwise(bits * 8 + F.expr("shiftright(size, length(bin(size)) - 4) & 7")).cast("int")
    small = rows.alias("r").join(plan.alias("p"), _null_safe("r", "p", ["source"])).where(F.col("size") <= F.col("cut")).select("r.*")
    cells = small.select("*", size_class.alias("size_class"), F.pmod(md5_number(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string"))), F.lit(blocks)).alias("block"))
    counted = cells.groupBy("source", "size_class", "block").agg(F.count("*").alias("rows"))
    before = lambda part, by: F.coalesce(F.sum("rows").over(Window.partitionBy(*part).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    classes = counted.groupBy("source", "size_class").agg(F.sum("rows").alias("rows")).select("source", "size_class", before(["source"], "size_class").alias("class_start"))
    blocks_ = counted.select("source", "size_class", "block", before(["source", "size_class"], "block").alias("block_start"))
    starts = blocks_.alias("b").join(classes.alias("c"), _null_safe("b", "c", ["source", "size_class"])).select("b.source", "b.size_class", "b.block", (F.col("class_start") + F.col("block_start")).alias("start"))
    rank = F.row_number().over(Window.partitionBy("source", "size_class", "block").orderBy("size", "id", "text_key"))
    ranked = cells.withColumn("rank", rank).alias("r").join(starts.alias("s"), _null_safe("r", "s", ["source", "size_class", "block"])).select("r.*", (F.col("start") + F.col("rank")).alias("place"))
    copies = F.floor(F.col("place") * F.col("rate") + F.col("offset")) - F.floor((F.col("place") - 1) * F.col("rate") + F.col("offset"))
    planned = ranked.alias("r").join(plan.alias("p"), _null_safe("r", "p", ["source"]))
    planned = planned.select("r.id", "r.source", "r.size", "r.text_key", "source_size", "target", copies.cast("long").alias("copies"))
    each = large.select("source", F.explode("large").alias("d")).alias("r").join(plan.alias("p"), _null_safe("r", "p", ["source"]))
    return planned.unionByName(each.select("d.id", "r.source", "d.size", "d.text_key", "source_size", "target", "d.copies"))


def mix_documents(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), max_copies: int = 3, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The input rows, each as often as the mix takes it, with the input's columns.

    Rows are joined to their plan by id, source and text hash, and rows that agree in all three by their number.
    """
    id_, source, text, number, copies, copy = unused(docs, "id", "source", "text", "number", "copies", "copy")
    keys = [id_, source, text]
    order = F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0)))
    plan = plan_mix(docs, weights, max_copies, seed, id_col, text_col, source_col).where("copies > 0")
    plan = plan.select(F.col(quoted(id_col)).alias(id_), F.col("source").alias(source), F.col("text_key").alias(text), F.col("copies").cast("int").alias(copies)).withColumn(number, order)
    rows = docs.withColumns({id_: F.col(quoted(id_col)), source: F.col(quoted(source_col)).cast("string"), text: F.xxhash64(F.col(quoted(text_col)).cast("string"))}).withColumn(number, order)
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"p.{k}")) for k in [*keys, number]]
    taken = rows.alias("r").join(plan.alias("p"), same)
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*(F.col(f"r.{quoted(c)}") for c in docs.columns))
