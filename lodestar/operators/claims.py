"""Claims in text, segments of sources and the notes that join them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from .containment import most_shared


def claim_table(paragraphs: DataFrame, key: str = "doc") -> DataFrame:
    """One row for each sentence of (doc, paragraph, text): flags, type, terms, and its place by a running cursor.

    The cursor counts the characters of the document's paragraphs before, one more for each.
    """
    before = Window.partitionBy(key).orderBy("paragraph").rowsBetween(Window.unboundedPreceding, -1)
    placed = paragraphs.withColumn("cursor", F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)))
    each = placed.select(key, "paragraph", "cursor", "text", F.posexplode(text.split_sentences(F.col("text"))).alias("sentence_index", "sentence"))
    flags = text.claim_flags(F.col("sentence"))
    start = F.col("cursor") + F.greatest(F.lit(0), F.instr(F.col("text"), F.col("sentence")) - 1)
    return each.select(key, "paragraph", "sentence_index", "sentence", start.alias("start"), (start + F.length("sentence")).alias("end"), flags.alias("flags"), text.claim_type(flags).alias("claim_type"), text.claim_terms(F.col("sentence")).alias("terms"), text.multi_claim(F.col("sentence")).alias("multi_claim"), (F.size(flags) > 0).alias("needs_note"))


def lexical_matches(claims: DataFrame, segments: DataFrame, k: int = 3, common: int = 1000) -> DataFrame:
    """For each claim the k segments that contain most of the words of its terms: claim_id, segment_id, score, rank. Every word counts."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}%$]+"), lambda w: F.length(w) > 1))
    found = most_shared(claims.select(F.col("claim_id").alias("left_id"), words(F.array_join("terms", " ")).alias("words")), segments.select(F.col("segment_id").alias("right_id"), words(F.col("text")).alias("words")), k, common)
    return found.withColumnsRenamed({"left_id": "claim_id", "right_id": "segment_id"})


def render_notes(matches: DataFrame, sources: DataFrame, segments: DataFrame) -> DataFrame:
    """A note for each match (claim_id, source_id, segment_id, quote); a match without source or segment gets a placeholder."""
    joined = matches.join(sources.select("source_id", "type", "title", "date", "url"), "source_id", "left").join(segments.select("source_id", "segment_id", "page", "timecode", F.col("text").alias("segment_text")), ["source_id", "segment_id"], "left")
    quote = F.concat(F.lit("“"), text.trim_quote(F.coalesce("quote", "segment_text", F.lit(""))), F.lit("”"))
    head = F.concat_ws(", ", F.col("title"), F.col("date"))
    body = (
        F.when(F.col("type") == "pdf", F.concat_ws(", ", head, F.concat(F.lit("p. "), F.col("page").cast("string"))))
        .when(F.col("type") == "transcript", F.concat_ws(", ", head, F.concat(F.lit("T/C "), F.col("timecode"))))
        .when(F.col("type") == "url", F.concat_ws(", ", head, F.col("url")))
        .otherwise(head)
    )
    missing = F.concat(F.lit("[source needed] "), F.substring(F.coalesce("quote", F.lit("")), 1, 140))
    found = F.col("type").isNotNull() & (F.col("segment_text").isNotNull() | (F.col("type") == "url"))
    return joined.select("claim_id", F.when(found, F.concat(body, F.lit(": "), quote)).otherwise(missing).alias("note"), F.when(found, "matched").otherwise("needs_source").alias("status"))


def note_cues(notes: DataFrame) -> DataFrame:
    """Whether a note has a URL, a date and a page or time cue."""
    return notes.withColumns({"has_url": F.col("note").rlike(r"https?://"), "has_date": F.col("note").rlike(text.DATE_LIKE), "has_cue": F.col("note").rlike(text.PAGE_CUE)})
