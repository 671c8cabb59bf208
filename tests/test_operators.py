"""Operators on literal rows."""

import random
import statistics

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestar.plans import registry  # its modules need it first
from lodestar.plans import investigation
from lodestar.operators import claims, containment, integrity, profiling, ranking, resolution, reuse, rollups


def sets(df, *columns):
    return {tuple(r[c] for c in (columns or df.columns)) for r in df.collect()}


def test_latest_breaks_ties(rows):
    df = rows("k int, at string, id string, v int", (1, "b", "x", 1), (1, "b", "y", 2), (1, "a", "z", 3), (2, None, "q", 4))
    assert sets(ranking.latest_per_key(df, ["k"], [F.desc("at"), F.desc("id")]), "k", "v") == {(1, 2), (2, 4)}


def test_ratio_uses_the_rounded_value_and_the_cut_list(rows):
    df = rows("id int, v double", (1, 49.96), (2, 10.0), (3, 0.0))
    got = sets(ranking.ratio_to_next(df, "v", [F.desc("v")], 5.0), "id", "x_over_next", "flagged")
    assert got == {(1, 5.0, True), (2, None, False), (3, None, False)}


def test_ratio_over_zero_has_no_limit(rows):
    df = rows("id int, v double", (1, 49.96), (2, 10.0), (3, 0.0), (4, 0.0), (5, None))
    got = sets(ranking.ratio_to_next(df, "v", [F.desc("v")], 5.0, over_zero=True), "id", "x_over_next", "flagged")
    assert got == {(1, 5.0, True), (2, None, True), (3, None, True), (4, None, False), (5, None, False)}


@pytest.mark.parametrize("incomes", [(49.96, 10.0, 0.0, 0.0), (5.0, 0.0), (0.0,)])
def test_anomaly_query_flags_as_its_sql_does(spark, incomes, monkeypatch):
    """A client without any reported income ends the list: what stands above it is flagged."""
    fields = [(f"F{i}", 2025, "first_quarter", i, f"CLIENT K{i}", f"K{i}", v, "2025-01-01") for i, v in enumerate(incomes)]
    filings = spark.createDataFrame(fields, "filing_uuid string, filing_year int, filing_period string, registrant_id int, client_key string, client_name string, income double, dt_posted string")
    monkeypatch.setattr(investigation, "records", lambda *_: {"filings": filings})
    con = duckdb.connect()
    con.execute("CREATE TABLE filings (filing_uuid VARCHAR, filing_year INT, filing_period VARCHAR, registrant_id INT, client_key VARCHAR, client_name VARCHAR, income DOUBLE, dt_posted VARCHAR)")
    con.executemany("INSERT INTO filings VALUES (?, ?, ?, ?, ?, ?, ?, ?)", fields)
    sql = registry.QUERIES["command_anomaly"].sql.replace(investigation.FILINGS + ", ", "")
    got = investigation.command_anomaly(spark, "").select("client_key", "x_over_next", "flagged")
    assert sets(got) == set(con.execute(f"SELECT client_key, x_over_next, flagged FROM ({sql})").fetchall())


def test_equal_receipts_go_to_the_greatest_number(spark, rows, tmp_path, monkeypatch):
    rows("s_suppkey long, s_nationkey int, s_acctbal double", (9, 1, -5.0), (10, 1, 5.0), (7, 1, 4.0)).write.parquet(str(tmp_path / "supplier.parquet"))
    monkeypatch.setattr(investigation, "records", lambda *_: None)
    monkeypatch.setattr(investigation.C, "gatekeeper", lambda *_: rows("entity_id string, items long, total double", ("B1", 2, 10.0), ("B2", 1, 1.0)))
    got = investigation.command_enrich_finance(spark, str(tmp_path))
    assert sets(got, "entity_id", "candidate", "receipts", "share_of_receipts") == {("B1", "K10", 5.0, 2.0), ("B2", None, None, None)}


def test_gap_drops_nulls_before_ranking(rows):
    left = rows("k int, v double, at int", (1, 100.0, 1), (1, None, 2), (2, 5.0, 1))
    right = rows("k int, v double, at int", (1, 10.0, 1), (2, 4.0, 1))
    assert sets(rollups.cross_source_gap(left, right, ["k"], "v", [F.desc("at")], [F.desc("at")], 50), "k", "gap") == {(1, 90.0)}


def test_period_names(rows):
    assert sets(rows("t string", ("Q1",), ("2ndQuarter",), ("REG",)).select(rollups.period_name(F.col("t")))) == {("first_quarter",), ("second_quarter",), (None,)}


def test_cascade_and_campaign(rows):
    members = rows("entity_id string, name string", ("a", "Ann Lee"), ("b", "Bo Lee"), ("c", "Cy Ray"), ("d", "J. Max Dow"), ("e", "Eve Fox"), ("f", "Eve Fox"))
    index = resolution.alias_index(members, rows("entity_id string, name string", ("c", "Cyrus Ray")))
    items = rows("name string, amount double", ("Sen. Ann Lee", 1.0), ("Ann Lee", 2.0), ("Zed Lee", 3.0), ("Unknown Ray", 4.0), ("Max Dow", 5.0), ("Eve Fox", 6.0), ("Ray for Congress", 7.0), ("", 8.0), (None, 9.0))
    got = {r["name"]: (r["entity_id"], r["match_method"]) for r in resolution.resolve_names(items, index).collect()}
    assert got == {"Sen. Ann Lee": ("a", "exact"), "Ann Lee": ("a", "exact"), "Zed Lee": (None, "unmatched"), "Unknown Ray": ("c", "lastname_unique"), "Max Dow": ("d", "exact"), "Eve Fox": (None, "ambiguous_key"), "Ray for Congress": ("c", "campaign_lastname_unique")}
    assert sets(resolution.coverage(resolution.resolve_names(items, index))) == {(7, 5)}


def test_roster_and_lookup(rows):
    members = rows("entity_id string, name string, party string, state string, chamber string", ("a", "A Lee", "Democratic", None, None))
    roster = rows("entity_id string, name string, party string, state string, chamber string", ("a", "Ann Lee", "D", "XX", "house"), ("b", "Bo Ray", "Independent", "YY", "senate"))
    got = resolution.merge_roster(members, roster)
    assert sets(got, "entity_id", "name", "party", "state", "key") == {("a", "Ann Lee", "D", "XX", "LEE|ANN"), ("b", "Bo Ray", "I", "YY", "RAY|BO")}
    assert sets(resolution.resolve_one(got, "Ray, Bo")) == {("b",)} and sets(resolution.resolve_one(got, "nn L")) == {("a",)} and not sets(resolution.resolve_one(got, "zzz"))


def test_bridge_prefers_ids(rows):
    schema = "id int, registrant_id int, client_id int, registrant string, client string"
    left = rows(schema, (1, 10, 20, "A", "B"), (2, None, None, "Acme, Inc.", "The Bee Co"), (3, None, None, "", "x"))
    right = rows(schema, (7, 10, 20, "A", "B"), (8, 10, 20, "A", "B"), (9, 1, 1, "ACME", "BEE"))
    assert sets(resolution.bridge(left, right)) == {(1, 7, "id_bridge"), (2, 9, "name_bridge")}


def test_registry(rows):
    hits = resolution.registry_hits(rows("query string", ("The Acme Corp",)), rows("name string", ("Acme Works",), ("Other",)))
    assert sets(hits, "name") == {("Acme Works",)}


def test_shared_sentences(rows):
    s = "This one sentence is long enough to be kept as it has more than eighty characters in it"
    data = [(f"u{i}", f"m{i}", "D" if i % 2 else None, f"2025-01-0{i + 1}", f"Hi.\n{s}. {s.upper() if i == 0 else s}") for i in range(5)]
    df = rows("url string, author string, party string, date string, text string", *data, ("u9", None, "R", "2025-01-01", s))
    got = reuse.shared_sentences(df, 5).collect()
    assert [(r["n_members"], r["parties"], r["span_days"], r["sample_url"]) for r in got] == [(5, "?D", 4, "u0")]
    assert reuse.ranked_clusters(reuse.shared_sentences(df, 5)).count() == 1


def test_shared_sentences_are_cut_before_the_result_is_read(rows):
    df = rows("url string, author string, party string, date string, text string", *((f"u{i}", f"m{i}", "D", "2025-01-01", "x" * 79 + "  y  z." + "short  " * 12) for i in range(5)))
    got = reuse.shared_sentences(df, 5)
    assert "split(" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert {(r["low"], r["n_members"]) for r in got.collect()} == {("x" * 79 + " y z", 5)}


def test_names_of_a_bridge_are_made_keys_once_a_pair(rows):
    columns = "id string, registrant_id int, client_id int, registrant string, client string"
    right = rows(columns, ("r2", 1, 1, "Firm, Inc.", "Acme"), ("r1", 2, 2, "FIRM", "Acme Corp"), ("r0", 3, 3, None, "Acme"))
    left = rows(columns, ("a", None, None, "Firm LLC", "ACME"), ("b", 3, 3, None, None))
    assert sets(resolution.bridge(left, right)) == {("a", "r1", "name_bridge"), ("b", "r0", "id_bridge")}


def test_roll_calls_leave_out_ties(rows):
    members = rows("member string, party string", ("a", "D"), ("b", "D"), ("c", "R"))
    votes = rows("member string, roll int, code string", ("a", 1, "1"), ("b", 1, "6"), ("c", 1, "1"), ("a", 2, "1"), ("b", 2, "2"), ("c", 2, "7"), ("a", 3, "9"))
    got = sets(rollups.roll_call_profile(votes, members), "member", "yea", "nay", "present", "with_party", "against_party", "participation", "unity")
    assert got == {("a", 2, 0, 0, 1, 0, 0.6667, 1.0), ("b", 1, 1, 0, 1, 0, 0.6667, 1.0), ("c", 1, 0, 1, 1, 0, 0.6667, 1.0)}


def test_roles_and_cycles(rows):
    assert sets(rows("r array<string>", (["Chairman", "Vice Chair", "Ranking Member"],)).select(F.array_join(rollups.role_tags(F.col("r")), ","))) == {("CHAIR,RANKING",)}
    totals = rows("who int, candidate string, cycle int, receipts double", (1, "x", 2022, 9.0), (1, "x", 2024, 0.0), (1, "x", 2026, 5.0), (1, "y", 2024, 7.0))
    assert sets(rollups.best_cycle(totals, "who", 2024)) == {(1, "y", 2024, 7.0)}


def test_reconcile(rows):
    listed = rows("who string", ("a",), ("b",), (None,))
    assert sets(rollups.reconcile(listed, rows("who string, amount double", ("a", 2.5)), "who", "amount"), "who", "disclosed") == {("a", "YES"), ("b", "NO"), (None, "n/a")}


def test_profile(rows):
    df = rows("my_id int, flat double, text string, none string, num string, big double", *((i, 1.0, f"t{i % 3}", None, str(i * 2) if i else "", float("inf") if i == 0 else float(i)) for i in range(30)))
    got = {r["column"]: (r["type"], r["detail"]) for r in profiling.column_types(df).collect()}
    assert got["my_id"] == ("integer", "identifier") and got["flat"] == ("integer", "ordinal") and got["text"] == ("text", "categorical") and got["none"][0] == "text" and got["num"][0] == "integer"
    stats = {r["column"]: r for r in profiling.statistics(df, ["flat", "big", "none"]).collect()}
    assert set(stats) == {"flat", "big"} and stats["big"]["n"] == 29 and stats["big"]["median"] == 15.0
    assert profiling.statistics(rows("x double", (3.0,)), ["x"]).first()["std"] is None
    assert sets(profiling.correlations(df, ["my_id", "flat", "big"])) == {("my_id", "big", 1.0)}
    assert profiling.correlation_matrix(df, ["my_id", "big"]).count() == 2
    bins = {r["bin"]: r["n"] for r in profiling.histogram(df, "my_id").collect()}
    assert sum(bins.values()) == 30 and max(bins) == 5
    assert sum(r["n"] for r in profiling.histogram(df, "flat").collect()) == 30 and profiling.histogram(df, "none").count() == 0


def test_figures(rows):
    stats = rows("column string, name string, value double", ("a", "mean", 1234.5), ("a", "max", 12.0), ("b", "mean", 7.25))
    report = rows("line string", ("The mean was 1,234.5 in 312 cases.",))
    assert sets(profiling.missing_figures(stats, report), "column", "name") == {("b", "mean")}
    pairs = rows("var1 string, var2 string, r double", ("x", "y", 0.5), ("x", "z", 0.9))
    assert sets(profiling.unreported_pairs(pairs, rows("var1 string, var2 string, r double", ("y", "x", -0.51))), "var1", "var2") == {("x", "z")}


def test_claims_and_notes(rows):
    table = claims.claim_table(rows("doc string, paragraph int, text string", ("d", 0, "It cost $5. Fine."), ("d", 1, "In 2025 it rose.")))
    assert sets(table, "paragraph", "sentence_index", "start", "end", "needs_note") == {(0, 0, 0, 11, True), (0, 1, 12, 17, False), (1, 0, 18, 34, True)}
    segments = rows("source_id string, segment_id string, page int, timecode string, text string", ("s", "g", 3, None, "it cost $5 then"), ("s", "h", 4, None, "nothing"))
    found = claims.lexical_matches(table.select(F.concat_ws("-", "paragraph", "sentence_index").alias("claim_id"), "terms"), segments)
    assert ("0-0", "g") in sets(found, "claim_id", "segment_id")
    matches = rows("claim_id string, source_id string, segment_id string, quote string", ("1", "s", "g", "it cost"), ("2", "zz", "g", "lost"))
    sources = rows("source_id string, type string, title string, date string, url string", ("s", "pdf", "Report", "2025", None))
    notes = claims.render_notes(matches, sources, segments)
    assert sets(notes) == {("1", "Report, 2025, p. 3: “it cost”", "matched"), ("2", "[source needed] lost", "needs_source")}
    assert sets(claims.note_cues(notes), "claim_id", "has_date", "has_cue", "has_url") == {("1", True, False, False), ("2", False, False, False)}  # "p. 3" ends no word, so it is no page cue


def test_moves(rows):
    moves = [(f"{a}>{b}", a, b, "r", 1) for a in integrity.STATUSES for b in integrity.STATUSES]
    df = rows("id string, from_status string, to_status string, reason string, n_sources int", *moves, ("noreason", "open", "cold", " ", 1), ("nosource", "chasing", "confirmed", "r", 0))
    bad = {r["id"]: r["problem"] for r in integrity.illegal_moves(df).collect()}
    assert bad.pop("noreason") == "reason required" and bad.pop("nosource") == "source required"
    assert {m[0] for m in moves} - set(bad) == {f"{a}>{b}" for a, to in integrity.TRANSITIONS.items() for b in to}
    threads = rows("id string, status string, reason string", ("open>cold", "open", None), ("cold>killed", "cold", "old"))
    assert sets(integrity.apply_moves(threads, df)) == {("open>cold", "cold", "r"), ("cold>killed", "cold", "old")}


def test_lint(rows):
    schema = "id string, status string, next_action string, reason string, entities array<string>, source_records array<string>, priority string"
    threads = rows(schema, ("a", "odd", "x", None, [], [], "1"), ("b", "open", " ", None, ["e9"], ["p1"], "2"), ("c", "cold", None, "", [], [], "x"), ("d", "confirmed", None, None, ["e1"], [], None), ("e", "chasing", "go", None, ["e1"], ["p9"], "1"))
    findings = rows("id string, source_records array<string>", ("f", []), ("g", ["p1"]))
    entities, corpus = rows("entity_id string", ("e1",)), rows("prov string", ("p1",))
    want = {("a", "unknown status"), ("b", "empty next action"), ("b", "orphan entity"), ("c", "missing reason"), ("d", "missing sources"), ("e", "orphan source"), ("f", "finding without source")}
    assert sets(integrity.lint(threads, entities, findings, corpus)) == want
    assert ("b", "orphan entity") not in sets(integrity.lint(threads, entities.limit(0), findings))
    assert {r["status"]: (r["n"], r["ids"]) for r in integrity.status_rollup(threads).collect()}["killed"] == (0, [])
    assert [r["id"] for r in integrity.digest(threads).collect()] == ["e", "b"]


def test_samples_and_lag(rows):
    df = rows("k int, i int", *((i % 2, i) for i in range(10)))
    assert sets(rollups.cap_per_key(df, ["k"], ["i"], 2), "i") == {(0,), (1,), (2,), (3,)}
    assert sets(rollups.every_nth(df, ["k"], ["i"], 3), "i") == {(0,), (1,), (6,), (7,)}
    assert rollups.lag_correlation(rows("p int, a double, b double", *((i, 1.0, float(i)) for i in range(5))), "p", "a", "b", 1).first()["r"] is None


def test_numbers_and_medians_over_ranges(rows, spark):
    r = random.Random(3)
    made = [(r.choice(["a", "b", None]), r.choice([1.0, 2.0, 2.5, r.random() * 9, None])) for _ in range(300)]
    df = rows("g string, v double", *made)
    placed = ranking.numbered(df, ["g"], [F.col("v")]).collect()
    for g in ("a", "b", None):
        mine = sorted((x["__n"], x["v"] is not None, x["v"]) for x in placed if x["g"] == g)
        assert [n for n, *_ in mine] == list(range(1, len(mine) + 1)) and [v for *_, v in mine] == sorted((v for *_, v in mine), key=lambda v: (v is not None, v or 0))
    got = {x["g"]: x["median"] for x in ranking.exact_median(df, "g", "v").collect()}
    assert got == {g: statistics.median(v for h, v in made if h == g and v is not None) for g in ("a", "b", None)}
    assert ranking.numbered(df.limit(0), ["g"], [F.col("v")]).count() == 0


def test_lookup_of_candidates_and_chambers(rows):
    people = rows("name string, state string, office string", ("JOHNSON, MIKE", "LA", "H"), ("JOHNSON, MIKE B.", "LA", "S"), ("JOHNSON, ANN", "LA", "H"), ("JOHNSONS, MIKE", "LA", "H"))
    assert sets(resolution.candidate_search(people, "Mike Johnson", "LA", "H"), "name") == {("JOHNSON, MIKE",)}
    assert sets(resolution.candidate_search(people, "James Johnson", "LA", "H"), "name") == {("JOHNSON, MIKE",), ("JOHNSON, ANN",)}
    assert resolution.candidate_search(people, "Nobody").count() == 0
    roles = rows("roles array<struct<committee:string>>", ([("Joint Tax",), ("House Rules",), ("Senate Budget",)],), ([("Joint Tax",)],), (None,))
    assert [x[0] for x in roles.select(resolution.role_chamber(F.col("roles"))).collect()] == ["House", None, None]


def test_channels_codes_and_estimates(rows):
    items = rows("kind string, to string, amount double, by string", ("he", "A x", 10.0, "p"), ("he", "A y", 5.0, "p"), ("he", "B", 1.0, "q"), ("feca", "A x", 99.0, "q"))
    assert sets(rollups.channel_totals(items, "he", "kind", F.substring("to", 1, 1), "amount", "by"), "cluster", "items", "total", "funders") == {("A", 2, 15.0, 1), ("B", 1, 1.0, 1)}
    parents = rows("k int, y int, c string, v double", (1, 2024, "a", 3.0), (2, 2024, "b", 4.0), (3, 2025, "a", 5.0))
    children = rows("k int, code string", (1, "TAX"), (1, "TAX"), (3, "TAX"), (2, "HCR"))
    assert sets(rollups.code_totals(parents, children, "k", F.col("code") == "TAX", ["y", "c"], "v")) == {("y", "2024", 1, 3.0), ("y", "2025", 1, 5.0), ("c", "a", 2, 8.0)}
    sample = rows("q int, hit boolean", (1, True), (1, False), (2, False))
    assert sets(rollups.extrapolate(sample, rows("q int, size long", (1, 10), (2, 7)), ["q"], F.col("hit"))) == {(1, 2, 1, 10, 5.0), (2, 1, 0, 7, 0.0)}


@pytest.mark.parametrize("common", [0, 2, 5, 1000])
@pytest.mark.parametrize("k", [1, 3, 12])
def test_most_shared_is_exact(rows, common, k):
    """Words of all rarities and ties, against scores of all pairs; `common` changes nothing."""
    r = random.Random(common + k)
    words = [f"w{i}" for i in range(14)]
    draw = lambda: sorted({w for i, w in enumerate(words) if r.random() < 1 / (i % 7 + 1)})
    left, right = [(i, draw()) for i in range(25)] + [(99, [])], [(i * 3 % 41, draw()) for i in range(40)]
    got = containment.most_shared(rows("left_id int, words array<string>", *left), rows("right_id int, words array<string>", *right), k, common)
    want = set()
    for i, a in left:
        scores = sorted((-len(set(a) & set(b)), j) for j, b in right if set(a) & set(b))
        want |= {(i, j, -s, n) for n, (s, j) in enumerate(scores[:k], 1)}
    assert sets(got, "left_id", "right_id", "score", "rank") == want


@pytest.mark.parametrize("part", [1, 3, 4096])
def test_contains_join_is_exact(rows, part):
    r = random.Random(part)
    text = lambda n: "".join(r.choice("aab é%_") for _ in range(r.randint(0, n)))
    texts, needles = [(text(12),) for _ in range(60)] + [(None,)], [(text(5),) for _ in range(60)] + [(None,), ("",)]
    got = containment.contains_join(rows("text string", *texts), rows("needle string", *needles), part)
    assert sets(got, "text", "needle") == {(t, n) for (t,) in texts for (n,) in needles if t is not None and n and n in t}
    assert containment.contains_join(rows("text string", *texts).limit(0), rows("needle string", *needles)).count() == 0


def test_registry_of_any_size(rows):
    queries, names_ = [(f"Q{i} Works Ltd",) for i in range(12_000)], [(f"the q{i} company",) for i in range(0, 12_000, 100)] + [(None,)]
    hits = resolution.registry_hits(rows("query string", *queries), rows("name string", *names_))
    assert sets(hits, "query", "name") == {(q, n) for i in range(0, 12_000, 100) for q, n in [(f"Q{i} Works Ltd", f"the q{i} company")]} | {
        (f"Q{str(i)[:m]} Works Ltd", f"the q{i} company") for i in range(0, 12_000, 100) for m in range(1, len(str(i)))}
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan


def test_three_least_urls(rows):
    line = "A sentence that is long enough to be looked at and that several authors share word for word"
    urls = [f"u{i}" for i in (31, 7, 12, 5, 5, 9)]
    got = reuse.shared_sentences(rows("url string, author string, party string, date string, text string", *((u, f"a{i}", "D", "2025-01-01", line) for i, u in enumerate(urls))), 3)
    assert [r["sample_urls"] for r in got.collect()] == [["u12", "u31", "u5"]]


def test_views_of_one_aggregation(rows):
    df = rows("a int, b string, c int, v int", (1, "x", None, 1), (1, "y", 2, 2), (None, "x", 2, 4))
    got = rollups.grouped_views(df, {"one": ["a"], "two": ["b", "c"]}, F.sum("v").alias("s"))
    assert sets(got, "view", "a", "b", "c", "s") == {("one", 1, None, None, 3), ("one", None, None, None, 4), ("two", None, "x", None, 1), ("two", None, "y", 2, 2), ("two", None, "x", 2, 4)}


def test_journal(spark, tmp_path):
    with pytest.raises(ValueError, match="empty"):
        integrity.append_journal(spark, str(tmp_path), "s", " \n", "t")
    integrity.append_journal(spark, str(tmp_path), "s", "b", "t2")
    integrity.append_journal(spark, str(tmp_path), "s", "a\nc", "t1")
    lines = [x["line"] for x in integrity.journal_lines(spark, str(tmp_path)).orderBy("n").collect()]
    assert lines == ["---", "### t1 \u00b7 session s", "a", "c", "---", "### t2 \u00b7 session s", "b"]
