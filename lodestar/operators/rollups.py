"""Footprints, timelines, gaps, alignments and other aggregates over facts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranking import exact_sum, latest_per_key, numbered

# Spellings of reporting periods.
PERIODS = {"Q1": "first_quarter", "Q2": "second_quarter", "Q3": "third_quarter", "Q4": "fourth_quarter", "1stQuarter": "first_quarter", "2ndQuarter": "second_quarter", "3rdQuarter": "third_quarter", "4thQuarter": "fourth_quarter"}
# Codes of votes.
YEA, NAY, PRESENT = ["1", "2", "3"], ["4", "5", "6"], ["7", "8"]


def period_name(report_type: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for p in PERIODS.items() for x in p)), report_type)


def sample_by(order: Sequence[str], columns: Sequence[str]) -> Column:
    """A struct of columns of the first row by order: a definite pick where any row would do."""
    return F.min_by(F.struct(*columns), F.struct(*order))


def cross_source_gap(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str, left_order: Sequence[Column], right_order: Sequence[Column], least: float) -> DataFrame:
    """Latest left and latest right value by key, where they differ by `least` or more; null values are dropped first."""
    a = latest_per_key(left.where(F.col(value).isNotNull()), keys, left_order).select(*keys, F.col(value).alias("left_value"))
    b = latest_per_key(right.where(F.col(value).isNotNull()), keys, right_order).select(*keys, F.col(value).alias("right_value"))
    return a.join(b, list(keys)).withColumn("gap", F.abs(F.col("left_value") - F.col("right_value"))).where(F.col("gap") >= least)


def period_totals(facts: DataFrame, period: Column, amount: str) -> DataFrame:
    return facts.groupBy(period.alias("period")).agg(F.count("*").alias("n"), exact_sum(amount).alias("total"))


def share_gap(say: DataFrame, do: DataFrame, key: str = "topic", places: int = 3, cut: float = 0.10) -> DataFrame:
    """Shares of two counts by key, side by side; the rounded difference and which side it leans to."""
    share = lambda df, name: df.select(key, F.round(F.try_divide(F.col("n"), F.sum("n").over(Window.partitionBy())), places).alias(name))
    both = share(say, "say_share").join(share(do, "do_share"), key, "full_outer").na.fill(0.0, ["say_share", "do_share"])
    gap = F.round(F.col("say_share") - F.col("do_share"), places)
    return both.withColumn("gap", gap).withColumn("lean", F.when(F.col("gap") >= cut, "says_more").when(F.col("gap") <= -cut, "does_more").otherwise("aligned"))


def tag_counts(tagged: DataFrame, tags: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows with each tag, and their share of the rows with any tag."""
    rows = tagged.where(F.size(tags) > 0)
    total = rows.agg(F.count("*").alias("__n"))
    counted = rows.select(*by, F.explode(tags).alias("topic")).groupBy(*by, "topic").agg(F.count("*").alias("n"))
    return counted.crossJoin(F.broadcast(total)).withColumn("share", F.round(F.col("n") / F.col("__n"), 3)).drop("__n")


def roll_call_profile(votes: DataFrame, members: DataFrame) -> DataFrame:
    """(member, party) with votes (member, roll, code): yea, nay, present, participation and unity with the party.

    A vote counts for unity on rolls where the member's party isn't tied.
    """
    rolls = votes.select("roll").distinct().agg(F.count("*").alias("rolls"))
    side = F.when(F.col("code").isin(YEA), 1).when(F.col("code").isin(NAY), -1)
    cast = votes.join(members, "member").withColumn("side", side)
    party = cast.groupBy("party", "roll").agg(F.sum("side").alias("lean"))
    own = cast.join(party, ["party", "roll"])
    agrees = F.signum(F.col("lean")) == F.col("side")
    decided = F.col("side").isNotNull() & (F.col("lean") != 0)
    out = own.groupBy("member", "party").agg(
        F.count_if(F.col("side") == 1).alias("yea"),
        F.count_if(F.col("side") == -1).alias("nay"),
        F.count_if(F.col("code").isin(PRESENT)).alias("present"),
        F.count_if(decided & agrees).alias("with_party"),
        F.count_if(decided & ~agrees).alias("against_party"),
    )
    out = out.crossJoin(F.broadcast(rolls))
    return out.withColumn("participation", F.round(F.try_divide(F.col("yea") + F.col("nay") + F.col("present"), F.col("rolls")), 4)).withColumn("unity", F.round(F.try_divide(F.col("with_party"), F.col("with_party") + F.col("against_party")), 4)).drop("rolls")


def vote_mix(votes: DataFrame, bills: DataFrame, most: int = 80) -> DataFrame:
    """Policy areas of the `most` latest votes on bills; roll numbers count as numbers."""
    linked = votes.join(bills, "bill")
    recent = linked.orderBy(F.desc("date"), F.desc(F.col("roll").cast("int"))).limit(most)
    return recent.groupBy("area").agg(F.count("*").alias("n"))


def most_common(df: DataFrame, group: str, item: str, k: int) -> DataFrame:
    """The k most frequent items of each group; ties by item."""
    counted = df.groupBy(group, item).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), item))
    return counted.withColumn("rank", rank).where(F.col("rank") <= k)


def best_cycle(totals: DataFrame, key: str, floor: int) -> DataFrame:
    """For each key and candidate the first cycle from `floor` on with receipts; of a key's candidates the largest receipts."""
    ready = totals.where((F.col("cycle") >= floor) & (F.col("receipts") > 0))
    first = ready.groupBy(key, "candidate").agg(F.min_by(F.struct("cycle", "receipts"), "cycle").alias("c"))
    return first.groupBy(key).agg(F.max_by(F.struct("candidate", "c.cycle", "c.receipts"), F.struct("c.receipts", "candidate")).alias("best")).select(key, "best.*")


def enrich(board: DataFrame, snapshot: DataFrame, key: str) -> DataFrame:
    """A board with a snapshot's columns; rows without one keep nulls."""
    return board.join(snapshot, key, "left")


def role_tags(roles: Column) -> Column:
    """CHAIR or RANKING for each role title that is one."""
    tag = lambda t: F.when(F.contains(F.lower(t), F.lit("chair")) & ~F.contains(F.lower(t), F.lit("vice")), "CHAIR").when(F.contains(F.lower(t), F.lit("ranking")), "RANKING")
    return F.filter(F.transform(roles, tag), lambda x: x.isNotNull())


def reconcile(listed: DataFrame, observed: DataFrame, key: str, amount: str) -> DataFrame:
    """Listed keys with the observed amount: YES, NO, or n/a where the key is null."""
    seen = observed.groupBy(key).agg(exact_sum(amount).alias("observed"))
    flag = F.when(F.col(key).isNull(), "n/a").when(F.col("observed") > 0, "YES").otherwise("NO")
    return listed.join(seen, key, "left").withColumn("disclosed", flag)


def with_code(parents: DataFrame, children: DataFrame, key: str, condition: Column) -> DataFrame:
    """Parents of which any child meets the condition."""
    return parents.join(children.where(condition).select(key).distinct(), key, "left_semi")


def cap_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], most: int) -> DataFrame:
    """A sampling operator: the first `most` rows of each key (each task keeps only its own first rows before the shuffle)."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__n") <= most).drop("__n")


def every_nth(df: DataFrame, keys: Sequence[str], order: Sequence[str], step: int) -> DataFrame:
    """A sampling operator: each key's rows 1, 1 + step, 1 + 2 step, ..."""
    return numbered(df, keys, [F.col(c) for c in order]).where(((F.col("__n") - 1) % step) == 0).drop("__n")


def featured_sample(df: DataFrame, featured: Column, keys: Sequence[str], order: Sequence[str], step: int) -> DataFrame:
    """A sampling operator: all featured rows, and of the rows of each key every step-th besides."""
    regular = ((F.col("__n") - 1) % step) == 0
    return numbered(df, keys, [F.col(c) for c in order]).where(F.coalesce(featured, F.lit(False)) | regular).drop("__n")


def grouped_views(rows: DataFrame, views: dict[str, list[str]], *aggregates: Column) -> DataFrame:
    """(view, the columns of all views, aggregates): each view's groups, from one aggregation with a grouping set for each; columns of other views are null."""
    columns = list(dict.fromkeys(c for cs in views.values() for c in cs))
    bits = {sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in cs): name for name, cs in views.items()}
    found = rows.groupingSets([[F.col(c) for c in cs] for cs in views.values()], *(F.col(c) for c in columns)).agg(F.grouping_id().alias("__set"), *aggregates)
    name = F.coalesce(*(F.when(F.col("__set") == b, F.lit(n)) for b, n in bits.items()))
    return found.withColumn("view", name).drop("__set")


def lag_correlation(series: DataFrame, period: str, a: str, b: str, lag: int) -> DataFrame:
    """Pearson correlation of a with b `lag` periods before, over a series of one row a period; null if either is constant."""
    moved = series.select(F.col(a).alias("x"), F.lag(b, lag).over(Window.orderBy(period)).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    return moved.agg(F.count("*").alias("n"), F.when((F.stddev_pop("x") > 0) & (F.stddev_pop("y") > 0), F.try_divide(F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y"))).alias("r"))


def tag_ranking(sources: DataFrame, words: Sequence[str], k: int = 8) -> DataFrame:
    """(source, tags): sources by the number of tags that contain a word or are contained in one; ties by name."""
    wanted = F.array(*(F.lit(w.lower()) for w in words))
    hits = F.size(F.filter("tags", lambda t: F.exists(wanted, lambda w: F.contains(F.lower(t), w) | F.contains(w, F.lower(t)))))
    return sources.withColumn("score", hits).where("score > 0").orderBy(F.desc("score"), "source").limit(k).select("source", "score")


def leadership(roles: Column) -> Column:
    """CHAIR or RANKING with the committee, for each role (committee, title) that is one."""
    tag = lambda r: F.when(F.contains(F.lower(r["title"]), F.lit("chair")) & ~F.contains(F.lower(r["title"]), F.lit("vice")), F.concat(F.lit("CHAIR "), r["committee"])).when(F.contains(F.lower(r["title"]), F.lit("ranking")), F.concat(F.lit("RANKING "), r["committee"]))
    return F.filter(F.transform(roles, tag), lambda x: x.isNotNull())


def null_rate(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, n, filled, null_rate): rows of each key, those with a value, and the share of those without."""
    return df.groupBy(key).agg(F.count("*").alias("n"), F.count(column).alias("filled"), F.round(F.count_if(F.col(column).isNull()) / F.count("*"), 4).alias("null_rate"))


def interleave(**series: tuple[DataFrame, Column]) -> DataFrame:
    """(kind, day, n): rows of several tables by period, one below the other."""
    out = None
    for kind, (df, day) in series.items():
        rows = df.groupBy(F.lit(kind).alias("kind"), day.alias("day")).agg(F.count("*").alias("n"))
        out = rows if out is None else out.unionByName(rows)
    return out


def channel_totals(items: DataFrame, kind: str, kind_col: str, cluster: Column, amount: str, funder: str) -> DataFrame:
    """(cluster, items, total, funders) of the items of one kind: what each cluster of recipients got by this channel."""
    rows = items.where(F.col(kind_col) == kind).withColumn("cluster", cluster)
    return rows.groupBy("cluster").agg(F.count("*").alias("items"), exact_sum(amount).alias("total"), F.countDistinct(funder).alias("funders"))


def code_totals(parents: DataFrame, children: DataFrame, key: str, condition: Column, by: Sequence[str], amount: str) -> DataFrame:
    """(dimension, value, n, total) over the parents of which any child meets the condition; each counts once in each dimension."""
    rows = with_code(parents, children, key, condition)
    boxes = F.array(*(F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in by))
    return rows.select(F.explode(boxes).alias("b"), amount).groupBy("b.dimension", "b.value").agg(F.count("*").alias("n"), exact_sum(amount).alias("total"))


def extrapolate(sample: DataFrame, sizes: DataFrame, keys: Sequence[str], hit: Column) -> DataFrame:
    """(keys, sampled, hits, size, estimate): a stratum's hits in the sample scaled by its size (keys, size)."""
    counted = sample.groupBy(*keys).agg(F.count("*").alias("sampled"), F.count_if(hit).alias("hits"))
    return counted.join(sizes, list(keys)).withColumn("estimate", F.round(F.try_divide(F.col("hits") * F.col("size"), F.col("sampled")), 2))
