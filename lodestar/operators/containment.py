"""Joins by containment and by shared words, over inverted indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Characters of a gram.
GRAM = 3
#: Texts of a gram that one part of its list holds.
PART = 4096


def grams(text: Column, size: int | Column) -> Column:
    """Distinct runs of `size` characters of a text; none of a shorter one."""
    size = F.lit(size)
    starts = F.sequence(F.lit(1), F.length(text) - size + 1)
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, size)))).otherwise(F.array().cast("array<string>"))


def contains_join(texts: DataFrame, needles: DataFrame, part: int = PART) -> DataFrame:
    """(text, needle) of each distinct text and needle that it contains; both have one column of that name, an empty needle matches nothing.

    A needle is looked up by its rarest gram of GRAM characters (by itself if it is shorter), so a text meets only needles with which it shares
    a gram, and lists of common grams are used only by needles all of whose grams are common. A long list is dealt into parts of about
    `part` texts, and its needles go to each part. Every meeting is verified.
    """
    texts, needles = texts.where("text IS NOT NULL").distinct(), needles.where("needle <> ''").distinct()
    wanted = needles.select("needle", F.explode(grams(F.col("needle"), F.least(F.lit(GRAM), F.length("needle")))).alias("gram"))
    listed = texts.select("text", F.explode(F.array_distinct(F.concat(*(grams(F.col("text"), n) for n in range(1, GRAM + 1))))).alias("gram"))
    listed = listed.join(wanted.select("gram").distinct(), "gram", "left_semi")
    counts = listed.groupBy("gram").agg(F.count("*").alias("n"))
    # A gram that no text holds rules its needles out.
    rated = wanted.join(counts, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = rated.groupBy("needle").agg(F.min(F.struct("n", "gram")).alias("r")).select("needle", "r.*").where("n > 0")
    keys = rarest.select("needle", "gram", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / part).cast("int"))).alias("part"))
    parts = rarest.groupBy("gram").agg(F.ceil(F.max("n") / part).cast("int").alias("parts"))
    dealt = listed.join(parts, "gram").select("text", "gram", F.pmod(F.xxhash64("text"), F.col("parts")).cast("int").alias("part"))
    return dealt.join(keys, ["gram", "part"]).where(F.contains("text", F.col("needle"))).select("text", "needle")


def ranked(rows: DataFrame, key: str | list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each key with their rank. Tasks keep k rows a key before the shuffle."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(*order))).where(F.col(name) <= k)


def most_shared(left: DataFrame, right: DataFrame, k: int, common: int = 1000) -> DataFrame:
    """(left_id, right_id, score, rank): for each left row the k right rows that share most of its words, ties to the lesser id.

    left: left_id, words; right: right_id, words, both arrays of distinct words. Exact, with upper bounds as in max-score retrieval: a left row first
    meets right rows through its words that at most `common` right rows hold, and these meetings are scored in full. A row not met shares none of
    these words, so its score is at most the number of the row's common words. If the k-th score is above that, the row is settled. If not,
    a row that reaches the k-th score s with the m common words alone holds one of the m - s + 1 rarest of them (m, if s is 0), so only these lists are
    read. `common` moves work between the two phases and changes no result.
    """
    left, right = left.where("size(words) > 0"), right.where("size(words) > 0")
    postings = right.select("right_id", F.explode("words").alias("word"))
    spread = postings.groupBy("word").agg(F.count("*").alias("n"))
    terms = left.select("left_id", F.explode("words").alias("word")).join(spread, "word")
    met = terms.where(F.col("n") <= common).select("left_id", "word").join(postings, "word").select("left_id", "right_id").distinct()
    shared = lambda pairs: pairs.join(left.select("left_id", F.col("words").alias("__a")), "left_id").join(right.select("right_id", F.col("words").alias("__b")), "right_id").select("left_id", "right_id", F.size(F.array_intersect("__a", "__b")).cast("long").alias("score"))
    best = ranked(shared(met), "left_id", [F.desc("score"), F.asc("right_id")], k)
    reached = best.where(F.col("rank") == k).select("left_id", F.col("score").alias("least"))
    more = terms.where(F.col("n") > common).withColumn("m", F.count("*").over(Window.partitionBy("left_id")))
    more = more.join(reached, "left_id", "left").withColumn("least", F.coalesce("least", F.lit(0))).where("least <= m")
    place = F.row_number().over(Window.partitionBy("left_id").orderBy("n", "word"))
    read = more.withColumn("place", place).where(F.col("place") <= F.col("m") - F.greatest("least", F.lit(1)) + 1)
    late = read.select("left_id", "word").join(postings, "word").select("left_id", "right_id").distinct()
    late = late.join(met, ["left_id", "right_id"], "left_anti")
    both = best.drop("rank").unionByName(ranked(shared(late), "left_id", [F.desc("score"), F.asc("right_id")], k).drop("rank"))
    return ranked(both, "left_id", [F.desc("score"), F.asc("right_id")], k)
