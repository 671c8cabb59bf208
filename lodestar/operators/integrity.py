"""Case files as tables: state machine, integrity rules, roll-up, digest and journal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import front_matter
from .ranking import numbered

# States, moves between them and what they require.
STATUSES = ["open", "chasing", "confirmed", "cold", "killed"]
TRANSITIONS = {"open": ["chasing", "cold", "killed"], "chasing": ["confirmed", "cold", "killed"], "confirmed": [], "cold": ["chasing"], "killed": []}
REASON_REQUIRED = ["cold", "killed"]
SOURCE_REQUIRED = ["confirmed"]
ACTIVE = ["open", "chasing"]


def problem_of(now: str, to: str, reason: str | None, n_sources: int) -> str | None:
    """What is wrong with one move, or nothing."""
    if to not in TRANSITIONS.get(now, []):
        return "forbidden move"
    if to in REASON_REQUIRED and not (reason or "").strip():
        return "reason required"
    return "source required" if to in SOURCE_REQUIRED and not n_sources else None


def replay(moves: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    """(id, status, n_moves, n_rejected) after all moves (id, seq, to_status, reason, n_sources) of each thread, by seq; threads begin as in initial (id, status), or open.

    Threads without moves stay as they are. The moves of one thread are one list in one task.
    """
    listed = moves.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("seq", "to_status", "reason", "n_sources"))).alias("moves"))
    threads = listed.withColumn("begun", F.lit("open")) if initial is None else initial.select("id", F.col("status").alias("begun")).join(listed, "id", "full_outer").withColumn("begun", F.coalesce("begun", F.lit("open")))

    def step(a, m):
        allowed = F.coalesce(*(F.when(a["status"] == s, m["to_status"].isin(to) if to else F.lit(False)) for s, to in TRANSITIONS.items()), F.lit(False))
        told = ~m["to_status"].isin(REASON_REQUIRED) | (F.trim(F.coalesce(m["reason"], F.lit(""))) != "")
        sourced = ~m["to_status"].isin(SOURCE_REQUIRED) | (F.coalesce(m["n_sources"], F.lit(0)) > 0)
        good = F.coalesce(allowed & told & sourced, F.lit(False))
        return F.struct(F.when(good, m["to_status"]).otherwise(a["status"]).alias("status"), (a["made"] + F.when(good, 1).otherwise(0)).alias("made"), (a["not_made"] + F.when(good, 0).otherwise(1)).alias("not_made"))

    zero = F.struct(F.col("begun").alias("status"), F.lit(0).alias("made"), F.lit(0).alias("not_made"))
    none = F.array().cast(listed.schema["moves"].dataType)
    end = threads.select("id", F.aggregate(F.coalesce("moves", none), zero, step).alias("s"))
    return end.select("id", "s.status", F.col("s.made").cast("long").alias("n_moves"), F.col("s.not_made").cast("long").alias("n_rejected"))


def illegal_moves(moves: DataFrame) -> DataFrame:
    """Requested moves (id, from_status, to_status, reason, n_sources) that the machine forbids, with what is wrong."""
    allowed = moves.sparkSession.createDataFrame([(a, b) for a, to in TRANSITIONS.items() for b in to], "from_status string, to_status string").withColumn("legal", F.lit(True))
    joined = moves.join(F.broadcast(allowed), ["from_status", "to_status"], "left")
    blank = F.trim(F.coalesce("reason", F.lit(""))) == ""
    problem = (
        F.when(F.col("legal").isNull(), "forbidden move")
        .when(F.col("to_status").isin(REASON_REQUIRED) & blank, "reason required")
        .when(F.col("to_status").isin(SOURCE_REQUIRED) & (F.coalesce("n_sources", F.lit(0)) == 0), "source required")
    )
    return joined.withColumn("problem", problem).where("problem IS NOT NULL").drop("legal")


def apply_moves(threads: DataFrame, moves: DataFrame) -> DataFrame:
    """Threads after their legal moves."""
    good = moves.join(illegal_moves(moves).select("id"), "id", "left_anti").select("id", "to_status", F.col("reason").alias("__reason"))
    return threads.join(good, "id", "left").withColumns({"status": F.coalesce("to_status", "status"), "reason": F.coalesce("__reason", "reason")}).drop("to_status", "__reason")


def lint(threads: DataFrame, entities: DataFrame, findings: DataFrame, corpus: DataFrame | None = None) -> DataFrame:
    """(id, rule) problems: seven rules. Without a registry of entities orphans aren't looked for; nor sources without a corpus."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    none = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    hit = lambda df, test, rule: df.where(test).select("id", F.lit(rule).alias("rule"))
    rules = [
        hit(threads, F.col("status").isNull() | ~F.col("status").isin(STATUSES), "unknown status"),
        hit(threads, F.col("status").isin(ACTIVE) & blank("next_action"), "empty next action"),
        hit(threads, F.col("status").isin(REASON_REQUIRED) & blank("reason"), "missing reason"),
        hit(threads, F.col("status").isin(SOURCE_REQUIRED) & none("source_records"), "missing sources"),
        hit(findings, none("source_records"), "finding without source"),
    ]
    named = threads.select("id", F.explode("entities").alias("entity_id"))
    some = entities.agg((F.count("*") > 0).alias("some"))
    orphans = named.join(entities.select("entity_id"), "entity_id", "left_anti").crossJoin(F.broadcast(some)).where("some")
    rules.append(orphans.select("id", F.lit("orphan entity").alias("rule")))
    if corpus is not None:
        cited = threads.select("id", F.explode("source_records").alias("prov")).unionByName(findings.select("id", F.explode("source_records").alias("prov")))
        rules.append(cited.join(corpus.select("prov"), "prov", "left_anti").select("id", F.lit("orphan source").alias("rule")))
    out = rules[0]
    for r in rules[1:]:
        out = out.unionByName(r)
    return out


def status_rollup(threads: DataFrame, most: int = 20) -> DataFrame:
    """(status, n, ids) of every status, those without threads too; ids are the first `most`, sorted."""
    every = threads.sparkSession.createDataFrame([(s,) for s in STATUSES], "status string")
    counted = threads.groupBy("status").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("status").orderBy("id"))
    first = threads.select("status", "id", place.alias("place")).where(F.col("place") <= most).groupBy("status").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    out = F.broadcast(every).join(counted, "status", "left").join(first, "status", "left")
    return out.select("status", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("ids", F.expr("cast(array() as array<string>)")).alias("ids"))


def totals(threads: DataFrame, findings: DataFrame, entities: DataFrame) -> DataFrame:
    """One row of the state file: threads_total, findings_total, entities_total."""
    count = lambda df, name: df.agg(F.count("*").alias(name))
    return count(threads, "threads_total").crossJoin(count(findings, "findings_total")).crossJoin(count(entities.select("entity_id").distinct(), "entities_total"))


def digest(threads: DataFrame) -> DataFrame:
    """Active threads by priority (what isn't a number comes last), then id."""
    return threads.where(F.col("status").isin(ACTIVE)).withColumn("rank", F.coalesce(F.col("priority").cast("string").try_cast("int"), F.lit(9999))).orderBy("rank", "id")


def brief(threads: DataFrame, journal: DataFrame, entities: DataFrame, lines: int = 12) -> dict[str, DataFrame]:
    """The whole digest: active threads, last journal lines (n, line), cold threads with their reasons, key and flagged entities, scoreboard.

    Line breaks in next actions, reasons and explanations become spaces; explanations end after 110 characters.
    """
    flat = lambda c: F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), "\n", " "))
    told = lambda c, other: F.coalesce(F.nullif(flat(c), F.lit("")), F.lit(other))
    last = journal.where(F.trim("line") != "").orderBy(F.desc("n")).limit(lines)
    status = F.lower(F.coalesce("status", F.lit("")))
    return {
        "active": digest(threads).withColumn("next_action", told("next_action", "missing")),
        "journal": last.orderBy("n"),
        "cold": threads.where("status = 'cold'").select("id", "title", told("reason", "no reason recorded").alias("reason")).orderBy("id"),
        "entities": entities.where(status.isin("key", "flag")).select(F.upper("status").alias("status"), F.coalesce("display", "entity_id").alias("display"), F.substring(flat("why"), 1, 110).alias("why")),
        "scoreboard": threads.agg(F.count_if(F.col("status") == "confirmed").alias("confirmed"), F.count_if(F.col("status").isin(ACTIVE)).alias("active"), F.count_if(F.col("status") == "cold").alias("cold"), F.count("*").alias("total")),
    }


def append_journal(spark: SparkSession, folder: str, session: str, message: str, stamp: str) -> None:
    """Add an entry to a journal kept as JSON lines; a blank message is an error."""
    if not message.strip():
        raise ValueError("empty log message")
    entry = spark.createDataFrame([(stamp, session, message)], "stamp string, session string, message string")
    entry.coalesce(1).write.mode("append").json(f"{folder}/journal")


def journal_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(n, line): the journal as it reads, entries by time, each with a rule and a head."""
    entries = spark.read.schema("stamp string, session string, message string").json(f"{folder}/journal")
    text = F.concat(F.lit("---\n### "), F.col("stamp"), F.lit(" \u00b7 session "), F.col("session"), F.lit("\n"), F.col("message"))
    lines = entries.select("stamp", "session", F.posexplode(F.split(text, "\n")).alias("at", "line"))
    return numbered(lines, [], [F.col("stamp"), F.col("session"), F.col("at")], "n").select("n", "line")


def manifest_problems(manifests: DataFrame) -> DataFrame:
    """(folder, problem) of manifests (folder, text; null text: no file): a block with a name of a-z and 0-9 with single dashes between, and a description of 1 to 1024 characters."""
    name = F.trim(F.regexp_replace(front_matter(F.col("text"), "name"), "^[\"']+|[\"']+$", ""))
    about = front_matter(F.col("text"), "description")
    named = F.when(name == "", "no name").when(~name.rlike(r"^[a-z0-9]+(?:-[a-z0-9]+)*$"), "bad name")
    told = F.when(about == "", "no description").when(F.length(about) > 1024, "long description")
    found = F.when(F.col("text").isNull(), F.array(F.lit("no file"))).when(name.isNull(), F.array(F.lit("no block"))).otherwise(F.array_compact(F.array(named, told)))
    return manifests.select("folder", F.explode(found).alias("problem"))


def tracker_state(events: DataFrame) -> DataFrame:
    """(kind, name, status, note, created) of threads, entities and leads from their events (seq, kind, name, status, note, day).

    The last status and the last note that say something hold; a thread or lead is open until an event says otherwise.
    """
    last = lambda c: F.max_by(c, F.when(F.col(c) != "", F.col("seq"))).alias(c)
    state = events.groupBy("kind", "name").agg(last("status"), last("note"), F.min_by("day", "seq").alias("created"))
    return state.withColumns({"status": F.coalesce("status", F.when(F.col("kind") != "entity", F.lit("open"))), "note": F.coalesce("note", F.lit(""))})
