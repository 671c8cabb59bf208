"""Sketches, totals that amendments move, and the state machine over streams."""

import os
import random

import pytest
from pyspark.sql import functions as F

from lodestar.operators import integrity, sketches
from lodestar.streaming import moves, totals
from lodestar.streaming.parts import Parts


def sets(df, *columns):
    return {tuple(r[c] for c in (columns or df.columns)) for r in df.collect()}


def test_counts_over_any_years(spark, tmp_path):
    facts = spark.range(60_000).select((F.col("id") % 3).alias("k"), (F.col("id") % 5 + 2020).cast("int").alias("year"), F.when(F.col("id") % 11 > 0, F.pmod(F.hash("id"), F.lit(9000))).alias("who"))
    path = str(tmp_path / "s")
    sketches.write_sketches(sketches.sketch_table(facts, ["k"], "year", "who"), "year", path)
    # A year that is written again replaces itself only.
    sketches.write_sketches(sketches.sketch_table(facts.where("year = 2021"), ["k"], "year", "who"), "year", path)
    kept = spark.read.parquet(path)
    for years in ([2020], [2021, 2023], [2020, 2021, 2022, 2023, 2024]):
        some = F.col("year").isin(years)
        both = sketches.distinct_over(kept, ["k"], some).join(sketches.exact_distinct(facts, ["k"], "who", some), "k").collect()
        assert len(both) == 3 and all(abs(r["estimate"] - r["exact"]) <= sketches.bound() * r["exact"] for r in both)
        assert {r["n"] for r in both} == {facts.where(some & (F.col("k") == 0)).count()}


RECORDS = "k int, version int, day string, client string, amount double"
HOW = totals.Totals(("k",), ("version",), "substring(day, 1, 7)", ("client",), "amount", buckets=8)


def recomputed(rows):
    latest = {}
    for b, r in rows:
        if r[0] not in latest or r[1] > latest[r[0]][0][1] or (b == latest[r[0]][1] and r[1] == latest[r[0]][0][1] and r < latest[r[0]][0]):
            latest[r[0]] = (r, b)
    out = {}
    for (k, v, day, client, amount), _ in latest.values():
        n, t = out.get((day[:7], client), (0, 0))
        out[day[:7], client] = (n + 1, t + round(amount * 100))
    return {(p, c, n, t) for (p, c), (n, t) in out.items()}


def test_amendments_move_totals(spark, tmp_path):
    r, root, seen = random.Random(4), str(tmp_path / "t"), []
    record = lambda k, v, months: (k, v, f"2025-{r.choice(months):02}-0{r.randint(1, 9)}", r.choice("ABC"), round(r.uniform(-50, 99), 2))
    batches = [
        [record(k, 1, range(1, 5) if k < 20 else range(1, 9)) for k in range(80)],
        [record(k, 2, [2, 3]) for k in range(0, 20)] + [record(k, 1, [2]) for k in range(80, 90)] + [record(5, 0, [2])],
        [record(k, 3, [3]) for k in range(0, 10)] + [record(k, 1, [3]) for k in range(3)] + [record(200, 1, [12]), record(200, 4, [11]), record(200, 4, [11])],
    ]
    files = {}
    for i, batch in enumerate(batches):
        df = spark.createDataFrame(batch, RECORDS)
        HOW.apply(df, root, i)
        HOW.apply(df, root, i)  # run again after a failure
        seen += [(i, row) for row in batch]
        got = {(x["period"], x["client"], x["n"], round(x["total"] * 100)) for x in HOW.read(spark, root, {"client": "string"}).collect()}
        assert got == recomputed(seen), i
        now = Parts(spark, f"{root}/totals", "period", "string", "n long").current()
        files[i] = now
    moved = {p for p, b in files[1].items() if b == 1}
    assert files[0].keys() >= {p for p in files[1] if p not in moved} and moved < set(files[1]) and all(files[1][p] == 0 for p in files[1] if p not in moved)
    leaders = HOW.leaders(spark, root, {"client": "string"}, "client", 2).collect()
    by = {}
    for p, c, n, t in recomputed(seen):
        by[c] = by.get(c, 0) + t
    assert [(x["client"], round(x["total"] * 100)) for x in leaders] == sorted(by.items(), key=lambda x: (-x[1], x[0]))[:2]


def test_changes_of_a_batch(spark, rows):
    known = rows(RECORDS, (1, 2, "2025-01-01", "A", 1.0), (2, 1, "2025-01-01", "A", 2.0), (3, 1, "2025-01-01", "A", 3.0))
    batch = rows(RECORDS, (1, 1, "x", "late", 9.0), (2, 2, "y", "B", 4.0), (3, 1, "z", "same version", 5.0), (4, 1, "w", "new", 6.0), (4, 0, "w", "older", 7.0))
    assert sets(totals.change_feed(known, batch, ["k"], ["version"]), "k", "client", totals.SIGN) == {(2, "A", -1), (2, "B", 1), (4, "new", 1)}


def test_totals_by_stream(spark, tmp_path):
    folder, root = str(tmp_path / "in"), str(tmp_path / "t")
    for i, rows_ in enumerate([[(1, 1, "2025-01-01", "A", 5.0)], [(1, 2, "2025-02-01", "A", 7.0), (2, 1, "2025-02-03", "B", 1.0)]]):
        spark.createDataFrame(rows_, RECORDS).coalesce(1).write.mode("append").parquet(folder)
        HOW.stream(spark.readStream.schema(RECORDS).parquet(folder), root, str(tmp_path / "c")).awaitTermination()
    assert sets(HOW.read(spark, root, {"client": "string"}), "period", "client", "n") == {("2025-02", "A", 1), ("2025-02", "B", 1)}


MOVES = "id string, seq long, to_status string, reason string, n_sources int"


def some_moves(r, n):
    return [(f"t{r.randrange(25)}", i, r.choice([*integrity.STATUSES, "nowhere"]), r.choice([None, "", " ", "why"]), r.choice([None, 0, 1])) for i in range(n)]


def by_hand(rows, initial):
    now, made, lost, out = dict(initial), {}, {}, []
    for id_, seq, to, reason, n in sorted(rows, key=lambda m: m[1]):
        problem = integrity.problem_of(now.get(id_, "open"), to, reason, n or 0)
        out.append((id_, seq, now.get(id_, "open"), to, problem))
        now[id_] = to if problem is None else now.get(id_, "open")
        made[id_], lost[id_] = made.get(id_, 0) + (problem is None), lost.get(id_, 0) + (problem is not None)
    return {(i, s, made.get(i, 0), lost.get(i, 0)) for i, s in now.items()}, set(out)


def test_replay(rows):
    given, initial = some_moves(random.Random(1), 300), [("t1", "cold"), ("t2", "killed"), ("only", "chasing")]
    got = integrity.replay(rows(MOVES, *given), rows("id string, status string", *initial))
    assert sets(got) == by_hand(given, initial)[0]
    assert sets(integrity.replay(rows(MOVES, *given))) == by_hand(given, [])[0]


def test_machine_over_a_stream(spark, tmp_path):
    """Three runs of a stream, each from where the last one stopped, answer as one replay does."""
    before = spark.conf.get(moves.STORE[0], None)
    spark.conf.set(*moves.STORE)
    try:
        given, initial = some_moves(random.Random(2), 240), [("t1", "cold"), ("t2", "killed"), ("only", "chasing")]
        folder, out = str(tmp_path / "in"), str(tmp_path / "out")
        first = spark.createDataFrame(initial, "id string, status string")
        for k in range(3):
            spark.createDataFrame(given[80 * k : 80 * k + 80], MOVES).coalesce(1).write.mode("append").parquet(folder)
            stream = moves.run_machine(spark.readStream.schema(MOVES).parquet(folder), first)
            stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        answers = spark.read.parquet(out)
        end, each = by_hand(given, initial)
        assert sets(answers, "id", "seq", "from_status", "to_status", "problem") == each
        assert sum(1 for _ in each) == answers.count()
        most = {r["id"]: r["n"] for r in answers.groupBy("id").agg(F.max("n_moves").alias("n")).collect()}
        assert most == {i: n for i, _, n, _ in end if i in most}
    finally:
        spark.conf.unset(moves.STORE[0]) if before is None else spark.conf.set(moves.STORE[0], before)


@pytest.mark.skipif(not os.path.isdir("/proc"), reason="paths of this system")
def test_parts_that_become_empty(spark, tmp_path):
    parts = Parts(spark, str(tmp_path / "p"), "part", "int", "v int")
    make = lambda *r: spark.createDataFrame(r, "v int, part int")
    parts.replace(make((1, 1), (2, 2)), [1, 2], 0)
    parts.replace(make((3, 2)), [1, 2], 1)
    assert sets(parts.read(), "v", "part") == {(3, 2)} and parts.read([7]).count() == 0
    assert sets(parts.read(before=1), "v", "part") == {(1, 1), (2, 2)}
