"""Text that several authors share word for word."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names, text
from ..scratch import written
from .containment import ranked


def shared_sentences(rows: DataFrame, min_members: int = 5, least: int = 80, samples: int = 3) -> DataFrame:
    """Sentences that `min_members` authors or more share; rows: url, author, party, date, text.

    Sentences are hashed before they are grouped: first distinct (hash, author) pairs are counted with partial sums, then only
    the sentences that pass come with their details. No task sees all rows of a common sentence unaggregated.
    """
    long_ = rows.where("author IS NOT NULL").select("url", "author", "party", "date", F.explode(F.array_distinct(text.long_lines(F.col("text"), least))).alias("s"))
    each = long_.select("url", "author", "party", "date", F.col("s.low").alias("low"), F.col("s.original").alias("original"), F.xxhash64("s.low").alias("h"))
    groups = each.select("h", "author").distinct().groupBy("h").agg(F.count("*").alias("members")).where(F.col("members") >= min_members).select("h")
    # Written once, as details and URLs both come from it: texts are cut twice, and not three times.
    shared = written(each.join(groups, "h"), "sentences")
    found = shared.groupBy("h", "low").agg(
        F.countDistinct("author").alias("n_members"),
        F.array_join(F.array_sort(F.collect_set(F.substring(F.coalesce(F.nullif("party", F.lit("")), F.lit("?")), 1, 1))), "").alias("parties"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.min_by("original", F.struct("url", "original")).alias("sentence"),
        F.min("url").alias("sample_url"),
    )
    # The least `samples` URLs: tasks rank their own before the shuffle, so none gathers all URLs of a sentence.
    urls = ranked(shared.select("h", "low", "url").distinct(), ["h", "low"], [F.asc("url")], samples)
    urls = urls.groupBy("h", "low").agg(F.array_sort(F.collect_list("url")).alias("sample_urls"))
    found = found.where(F.col("n_members") >= min_members).join(urls, ["h", "low"], "left").withColumn("sample_urls", F.coalesce("sample_urls", F.array().cast("array<string>")))
    return found.select("n_members", "parties", text.day_span(F.col("first_date"), F.col("last_date")).alias("span_days"), text.specificity(F.col("sentence")).alias("specificity"), F.substring("sentence", 1, 200).alias("sentence"), "sample_url", "sample_urls", "low")


def ranked_clusters(clusters: DataFrame, k: int = 30) -> DataFrame:
    """Bipartisan, specific, many members, tight window."""
    return clusters.orderBy(F.desc(F.length("parties") > 1), F.desc("specificity"), F.desc("n_members"), "span_days", "low").limit(k)


def phrase_search(rows: DataFrame, phrase: str) -> DataFrame:
    """Rows whose text contains the phrase, case-insensitively."""
    return rows.where(names.like_literal(F.col("text"), phrase))
