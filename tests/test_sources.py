"""Ingest of invented files, provenance, and streams."""

import json
import os
import random
import zipfile
from types import SimpleNamespace

import duckdb
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from lodestar import scratch
from lodestar.plans import registry  # noqa: F401  its modules need it first
from lodestar.plans import files, raw
from lodestar.sources import provenance, records, splits, texts
from lodestar.streaming import records as streams


def sets(df, *columns):
    return {tuple(r[c] for c in (columns or df.columns)) for r in df.collect()}


FILING = {"filing_uuid": "u1", "filing_year": 2025, "income": "20000.00", "expenses": None, "dt_posted": "2025-02-01", "registrant": {"id": 1, "name": "Acme, Inc."}, "client": {"id": 2, "name": "The Bee Co"},
          "lobbying_activities": [{"general_issue_code": "TAX", "government_entities": [{"name": "B "}, {"name": "A"}, {"name": "B"}], "lobbyists": [{"lobbyist": {"first_name": "Ann", "last_name": "Lee"}}, {"first_name": "Bo", "last_name": ""}, {"first_name": " ", "last_name": None}]}]}


def test_filings(spark, tmp_path):
    path = tmp_path / "filings_2025.json"
    path.write_text(json.dumps([FILING, {"filing_uuid": "u2", "lobbying_activities": None}, {**FILING, "income": "x"}], indent=1))
    t = records.filings(spark, [str(path)])
    got = {r["filing_uuid"]: r for r in t["filings"].collect()}
    assert set(got) == {"u1", "u2"} and got["u1"]["registrant_key"] == "ACME" and got["u1"]["prov"] == f"{path}#u1" and got["u2"]["income"] is None
    assert sets(t["activities"], "issue_code", "gov_entities") == {("TAX", "A; B")}
    assert sets(t["activity_people"], "person_idx", "person_name") == {(0, "Ann Lee"), (1, "Bo")}
    for _ in range(2):  # written twice, there once
        records.write_tables(t, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/activity_people")).count() == 2
    assert json.loads(records.provenance(spark, f"{path}#u2").first()["record"])["filing_uuid"] == "u2"
    assert records.provenance(spark, f"{path}#zz").first()["error"] == "no such record"


def test_contributions(spark, tmp_path):
    path = tmp_path / "contributions_2025.json"
    path.write_text(json.dumps([{"filing_uuid": "c", "lobbyist": {"first_name": "", "last_name": "Ray"}, "contribution_items": [{"honoree_name": "Lee, Ann", "amount": "$1,000.00"}, {"honoree_name": None, "amount": ""}]}]))
    t = records.contributions(spark, [str(path)])
    assert sets(t["contributions"], "person_name", "no_contributions") == {("Ray", False)}
    assert sets(t["contribution_items"], "item_idx", "honoree_key", "amount") == {(0, "LEE|ANN", 1000.0), (1, "", None)}


def test_xml(spark, tmp_path):
    folder = tmp_path / "other" / "2025_1stQuarter_XML"
    folder.mkdir(parents=True)
    (folder / "300.xml").write_text("<Any><organizationName>Acme</organizationName><senateID>12-34</senateID><reportYear>2025</reportYear><income>5</income><alis><ali_info><issueAreaCode>TAX</issueAreaCode><specific_issues><description>d</description></specific_issues></ali_info><ali_info><issueAreaCode> </issueAreaCode></ali_info></alis></Any>")
    (folder / "301.xml").write_text("<Any><senateID>x-9</senateID></Any>")
    (folder / "302.xml").write_text("<Any><broken")
    t = records.other_filings(spark, str(tmp_path / "other"))
    assert sets(t["other_filings"], "house_id", "report_type", "senate_registrant_id", "senate_client_id") == {("300", "1stQuarter", 12, 34), ("301", "1stQuarter", None, 9)}
    assert sets(t["other_activities"], "house_id", "issue_code") == {("300", "TAX")}


def test_files_are_written_under_their_names_by_tasks(spark, rows, tmp_path, monkeypatch):
    df = rows("folder string, name string, value string", *(("ab"[i % 2], f"{i}.xml", f"<x>é{i}</x>" if i else None) for i in range(50)))
    want = {(("ab"[i % 2]), f"{i}.xml", f"<x>é{i}</x>\n" if i else "\n") for i in range(50)}
    held = lambda root: {(p.parent.name, p.name, p.read_text("utf-8")) for p in root.rglob("*") if p.is_file() and p.suffix != ".crc"}
    scratch.write_files(df, str(tmp_path / "tasks"))
    assert held(tmp_path / "tasks") == want and sorted(p.name for p in (tmp_path / "tasks").iterdir()) == ["a", "b"]

    def closed(uri):
        raise OSError(uri)

    monkeypatch.setattr(scratch, "fs", SimpleNamespace(FileSystem=SimpleNamespace(from_uri=closed)))
    scratch.write_files(df, str(tmp_path / "spark"))
    assert held(tmp_path / "spark") == want


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_raw_files_leave_no_folder_for_each_record(spark, tmp_path):
    raw.write_raw(spark, DATA, str(tmp_path))
    assert sorted(p.name for p in (tmp_path / "other").iterdir()) == ["2025_1stQuarter_XML", "2025_2ndQuarter_XML"]
    assert not (tmp_path / "others").exists()  # a folder a record, to be listed and renamed by the driver
    assert len(list(tmp_path.glob("other/*/*.xml"))) == spark.read.parquet(f"{DATA}/supplier.parquet").count()
    assert {p.name for p in tmp_path.glob("filings_*.json")} == {f"filings_{y}.json" for y in (2023, 2024, 2025)}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_only_the_sources_that_are_read_are_made(spark, tmp_path):
    made = raw.MadeRecords(spark, DATA, str(tmp_path))
    held = lambda: {p.name.partition("_")[0] for p in (tmp_path / "raw").iterdir()} - {"lines"} if (tmp_path / "raw").exists() else set()
    assert not held()
    parts = spark.read.parquet(f"{DATA}/part.parquet").count()
    assert made["contribution_items"].count() == parts and held() == {"contributions"}
    assert made["resolved"].agg(F.sum("n_items")).first()[0] == parts and held() == {"contributions", "releases"}
    made.make()
    assert held() == {"contributions", "releases", "filings", "other"} and made.done == held() | {"resolved", "bridge"}
    assert {r[0] for r in made["provenance_index"].select("dataset").distinct().collect()} == held()
    written = {p: p.stat().st_mtime_ns for p in (tmp_path / "tables").rglob("*.parquet")}
    made.make()  # nothing is made twice
    assert written == {p: p.stat().st_mtime_ns for p in (tmp_path / "tables").rglob("*.parquet")}


def test_small_files_are_opened_once(spark, tmp_path):
    folder = tmp_path / "other" / "2025_1stQuarter_XML"
    folder.mkdir(parents=True)
    (folder / "300.xml").write_text("<Any><senateID>12-34</senateID><alis><ali_info><issueAreaCode>TAX</issueAreaCode></ali_info></alis></Any>")
    t = records.other_filings(spark, str(tmp_path / "other"))
    (folder / "300.xml").unlink()
    assert [t[name].count() for name in ("other_filings", "other_activities", "places")] == [1, 1, 1]


def test_small_files_make_few_parts(spark, tmp_path):
    folder = tmp_path / "other" / "2025_1stQuarter_XML"
    folder.mkdir(parents=True)
    for i in range(700):  # a task reads some 30 files
        (folder / f"{i}.xml").write_text(f"<F><senateID>{i}-1</senateID></F>")
    t = records.other_filings(spark, str(tmp_path / "other"))
    assert len(t["places"].inputFiles()) <= 4 * spark.sparkContext.defaultParallelism
    assert sets(t["other_filings"], "house_id", "senate_registrant_id") == {(str(i), i) for i in range(700)}


def test_records_of_a_small_file_are_made_by_many_tasks(spark):
    assert raw.filing_records(spark, DATA).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_releases(spark, tmp_path):
    folder = tmp_path / "releases" / "2025"
    folder.mkdir(parents=True)
    line = lambda url, title, member: json.dumps({"url": url, "title": title, "member": member})
    ann = {"bioguide_id": "A1", "name": "Ann Lee", "party": "D"}
    (folder / "2025-01.jsonl").write_text("\n".join([line("u", "old", ann), "", line("v", "x", None), line("u", "new", {**ann, "name": "Ann B. Lee"})]) + "\n")
    t = records.releases(spark, str(tmp_path / "releases"))
    assert {(r["url"], r["title"], r["prov"].rsplit("#")[-1]) for r in t["releases"].collect()} == {("u", "new", "L4"), ("v", "x", "L3")}
    assert sets(t["members"], "member_id", "name") == {("A1", "Ann B. Lee")}
    assert "old" in records.provenance(spark, f"{folder}/2025-01.jsonl#L1").first()["record"]
    assert set(records.ingest(spark, str(tmp_path), str(tmp_path / "o"), datasets=("releases", "filings"))) == {"releases", "members"}


def test_snapshots_and_roster(spark, rows, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"_source": "x", "members": {"A1": {"yea": 3}, "B2": {"yea": None}}}))
    assert sets(records.flatten_snapshot(spark, str(tmp_path / "s.json"), "yea: int")) == {("A1", 3), ("B2", None)}
    (tmp_path / "votes.csv").write_text("rollnumber,icpsr,cast_code\n1,2,6\n")
    assert sets(records.roll_call_table(spark, str(tmp_path / "votes.csv"), "votes")) == {("1", "2", "6")}
    terms = rows("member_id string, terms array<struct<type:string,party:string,state:string>>, candidate_ids array<string>", ("A1", [("rep", "D", "XX"), ("sen", "D", "YY")], ["H1", "S2"]))
    roles = rows("member_id string, committee string, title string, rank int", ("A1", "Budget", "Chair", 1))
    got = records.roster(rows("member_id string", ("A1",)), roles, terms).first()
    assert (got["chamber"], got["state"], got["candidate_ids"], got["roles"][0]["committee"]) == ("senate", "YY", ["S2"], "Budget")
    records.write_snapshot(rows("a int", (1,)), str(tmp_path / "w"))
    assert records.dumps(rows("a int", (1,))).first()["json"] == '{"a":1}'


def test_texts(spark, tmp_path):
    (tmp_path / "a.md").write_text("# Title\n\nFirst one\nstill.\n\n\nSecond.\n")
    (tmp_path / "b.vtt").write_text("WEBVTT\n\n1\n00:00:01.000 --> 00:00:02.500\n<v Ann>Hello\nthere\n\n00:01:01.000 --> 00:01:02.000\nBye\n")
    (tmp_path / "urls.txt").write_text("# list\nhttps://x.org/a\n\nhttps://y.org\n")
    (tmp_path / "t.csv").write_text("id;v;Unnamed: 2\n1;a;\n2;b;\n")
    (tmp_path / ".hidden").write_text("x")
    assert sets(texts.walk(spark, str(tmp_path)), "source_id", "kind") == {("S001", "text"), ("S002", "transcript"), ("S003", None), ("S004", "url")}
    assert sets(texts.paragraphs(spark, str(tmp_path / "a.md")), "title", "position", "text") == {("Title", 0, "# Title"), ("Title", 1, "First one\nstill."), ("Title", 2, "Second.")}
    assert sets(texts.cues(spark, str(tmp_path / "b.vtt")), "timecode", "text") == {("00:00:01", "Hello there"), ("00:01:01", "Bye")}
    assert sets(texts.url_list(spark, str(tmp_path / "urls.txt"))) == {("https://x.org/a",), ("https://y.org",)}
    assert texts.delimited(spark, str(tmp_path / "t.csv")).columns == ["id", "v"]
    assert spark.createDataFrame([("D:20250102030405",), ("x",)], "d string").select(texts.clean_pdf_date("d")).collect()[0][0] == "2025-01-02"


def test_cues_after_the_hundredth_hour(spark, tmp_path):
    (tmp_path / "a.vtt").write_text("WEBVTT\n\n100:02:03.000 --> 1000:00:00.000\nlate\n\n99:02:03.000 --> 99:03:00.000\nsoon\n\n02:03,000 --> 02:04,000\nnow\n")
    assert sets(texts.cues(spark, str(tmp_path / "a.vtt")), "timecode", "text") == {("100:02:03", "late"), ("99:02:03", "soon"), ("02:03", "now")}


def test_cues_query_as_its_sql(spark, rows, tmp_path):
    """Conversations of high numbers, and texts with an arrow, tags, a vertical tab or a cue of their own."""
    said = ["a --> b", "<b>x</b>  y\r\n\r\nz", "p\x0bq", "", None, "00:00:01.000 --> 00:00:02.000 t", "1 < 2"]
    df = rows("conv_id long, turn long, role string, text string", *((c, t, "user", said[t]) for c in (59, 5999, 6000, 123456789) for t in range(len(said))))
    df.coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    got = [tuple(r) for r in files.source_cues(spark, str(tmp_path)).select("timecode", "text").collect()]
    assert sorted(got) == sorted(con.execute(f"SELECT timecode, text FROM ({registry.QUERIES['source_cues'].sql})").fetchall())


def test_provenance_of_what_is_not_there(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("{}\n")
    for place, error in (("b.jsonl#L1", "source file not found"), ("a.jsonl#Lx", "not a line"), ("a.jsonl#L0", "not a line"), ("a.jsonl#L9", "no such record"), ("a.jsonl#u", "no such record")):
        got = records.provenance(spark, f"data/{place}", str(tmp_path)).collect()
        assert len(got) == 1 and got[0]["record"] is None and got[0]["error"].startswith(error)
    assert records.provenance(spark, "data/a.jsonl#L1", str(tmp_path)).first()["record"] == "{}"


def test_docx(spark, tmp_path):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p>{''.join(f'<w:r><w:t>{t}</w:t></w:r>' for t in p)}</w:p>" for p in (["One ", "paragraph"], [], ["Two"]))
    with zipfile.ZipFile(tmp_path / "memo.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
        z.writestr("docProps/core.xml", '<c xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:t="http://purl.org/dc/terms/"><dc:title>The memo</dc:title><t:created>2025-01-02T03:04:05Z</t:created></c>')
    (tmp_path / "broken.docx").write_text("no zip")
    assert sets(texts.docx_paragraphs(spark, str(tmp_path)), "title", "created", "position", "text") == {("The memo", "2025-01-02T03:04:05Z", 1, "One paragraph"), ("The memo", "2025-01-02T03:04:05Z", 3, "Two")}


def test_batches_rewrite_only_the_buckets_they_touch(spark, rows, tmp_path):
    schema = "k int, at string, v int"
    for i, batch in enumerate([[(k, "2025-01-01", 0) for k in range(40)], [(7, "2025-01-02", 1)]]):
        rows(schema, *batch).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    source = streams.stream_of(spark, str(tmp_path / "in" / "*"), schema, 1)
    streams.latest_versions(source, ["k"], ["at"], str(tmp_path / "t"), str(tmp_path / "c"), buckets=8).awaitTermination()
    assert sets(streams.read_latest(spark, str(tmp_path / "t")), "k", "v") == {(k, int(k == 7)) for k in range(40)}
    folders = {p.name: len([x for x in p.iterdir() if x.is_dir()]) for p in (tmp_path / "t" / "data").iterdir()}
    assert folders["0"] == 8 and folders["1"] == 1


def test_streams(spark, rows, tmp_path):
    schema = "k int, at string, v int"
    for i, batch in enumerate([[(1, "2025-01-01", 1), (2, "2025-01-01", 1)], [(1, "2025-01-03", 2), (1, "2025-01-02", 3), (1, "2025-01-03", 2)]]):
        rows(schema, *batch).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    source = lambda: streams.stream_of(spark, str(tmp_path / "in" / "*"), schema, 1)
    streams.latest_versions(source(), ["k"], ["at"], str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    assert sets(streams.read_latest(spark, str(tmp_path / "t"))) == {(1, "2025-01-03", 2), (2, "2025-01-01", 1)}
    for name, df, mode in (("counts", streams.windowed_counts(source(), "at", ["k"]), "complete"), ("first", streams.once(source(), "at", "k", "30 days"), "append")):
        df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    assert {(r["start"].day, r["k"], r["n"]) for r in spark.table("counts").collect()} == {(1, 1, 1), (1, 2, 1), (2, 1, 1), (3, 1, 2)}
    assert spark.table("first").agg(F.count("*")).first()[0] == 2


def test_case_folder(spark, tmp_path):
    from lodestar.operators import integrity
    from lodestar.sources import cases

    (tmp_path / "threads").mkdir()
    (tmp_path / "threads/T-1.md").write_text("---\nid: T-1\nstatus: open\npriority: 1\nentities: [E1, 'E9']\nsource_records: P1\n---\n\nBody --- here\n")
    (tmp_path / "threads/T-2.md").write_text('---\nstatus: open\nstatus: cold\nreason: "no: more"\nentities: E1\nreason:\n---\n')
    (tmp_path / "threads/T-3.md").write_text("no head\n")
    (tmp_path / "threads/T-4.md").write_text("---\n---")
    (tmp_path / "entities.jsonl").write_text('{"entity_id": "E1", "kind": "member", "display": "One", "status": "key"}\n{"display": "nameless"}\n')
    (tmp_path / "findings.jsonl").write_text('{"id": "F-1", "source_records": ["P1", "P2"]}\n{"id": "L-1", "source_records": []}\n')
    threads, entities, findings = (f(spark, str(tmp_path)) for f in (cases.threads, cases.entities, cases.findings))
    got = {r["id"]: r for r in threads.collect()}
    assert set(got) == {"T-1", "T-2", "T-3", "T-4"} and got["T-1"]["body"] == "Body --- here\n" and got["T-3"]["body"] == "no head\n"
    assert (got["T-1"]["entities"], got["T-1"]["priority"], got["T-1"]["source_records"]) == (["E1", "E9"], "1", ["P1"])
    assert (got["T-2"]["reason"], got["T-2"]["entities"], got["T-2"]["source_records"], got["T-2"]["status"]) == ("no: more", ["E1"], [], "cold")
    problems = {tuple(r) for r in integrity.lint(threads, entities, findings).collect()}
    assert problems == {("T-1", "empty next action"), ("T-1", "orphan entity"), ("T-3", "unknown status"), ("T-4", "unknown status"), ("L-1", "finding without source")}


# Files that many tasks read


@pytest.fixture
def small_blocks(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def awkward(r, i):
    said = "".join(r.choice(["a", '"', "\\", "{", "}", "[", "]", "\n", "é", " ", "}{", '"}']) for _ in range(r.choice([0, 5, 50, 300])))
    return {"filing_uuid": f"u{i}", "said": said, "list": [{"x": [1, {"y": said[::-1]}]}], "none": {}}


def test_arrays_are_cut_anywhere(spark, tmp_path, small_blocks):
    r, made = random.Random(1), {}
    for name, kwargs, mark in (("dense", {"separators": (",", ":")}, ""), ("indented", {"indent": 2, "ensure_ascii": False}, "\ufeff"), ("one", {"ensure_ascii": False}, "")):
        rows = [awkward(r, i) for i in range(60)]
        if name == "one":
            rows[30]["said"] = 'z}"' * 6000  # longer than several blocks
        made[name] = (mark + json.dumps(rows, **kwargs), rows)
    made["cut"] = ('[{"filing_uuid":"a"}, 5, null, [{"q":1}], "x{", {"filing_uuid":"b"', [{"filing_uuid": "a"}])
    made["objects"] = ('{"a":1}\n{"a":{"b":2}}', [{"a": 1}, {"a": {"b": 2}}])
    made["nothing"], made["empty"] = ("", []), ("[]", [])
    for name, (text, _) in made.items():
        (tmp_path / f"{name}.json").write_text(text)
    found = splits.array_records(spark, str(tmp_path)).collect()
    for name, (text, rows) in made.items():
        mine = sorted((f for f in found if f["path"].endswith(f"/{name}.json")), key=lambda f: f["byte"])
        assert [json.loads(f["record"]) for f in mine] == rows, name
        assert all(text.encode()[f["byte"] : f["byte"] + f["length"]].decode() == f["record"] for f in mine)
    assert spark.read.text(str(tmp_path / "one.json")).rdd.getNumPartitions() >= 8


def test_arrays_of_short_lines_are_cut_at_line_feeds(spark, tmp_path, small_blocks, monkeypatch):
    r, seps, states = random.Random(5), [], splits._block_states
    monkeypatch.setattr(splits, "_block_states", lambda rows, sep: seps.append(sep) or states(rows, sep))
    made = {f"short{i}.json": (mark, [awkward(r, k) for k in range(120)], end) for i, (mark, end) in enumerate((("", ""), ("\ufeff", "\n"), ("\ufeff", ""), ("", "\r\n\n")))}

    def check():
        for name, (mark, rows, end) in made.items():
            (tmp_path / name).write_bytes((mark + "[" + ",\n".join(json.dumps(x, ensure_ascii=False) for x in rows) + "]" + end).encode())
        found = splits.array_records(spark, str(tmp_path)).collect()
        assert len(found) == sum(len(rows) for _, rows, _ in made.values())
        for name, (_, rows, _) in made.items():
            mine, raw = sorted((f for f in found if f["path"].endswith(f"/{name}")), key=lambda f: f["byte"]), (tmp_path / name).read_bytes()
            assert [json.loads(f["record"]) for f in mine] == rows, name
            assert all(raw[f["byte"] : f["byte"] + f["length"]].decode() == f["record"] for f in mine)

    check()
    assert seps == [b"\n"]
    # The reader leaves out the long line; its file, and no other, is cut at braces.
    made["long.json"] = ("", [awkward(r, 0), {"said": '}"{' * 40_000}, awkward(r, 1)], "\n")
    check()
    assert seps == [b"\n", b"\n", b"}"]


def test_large_arrays_as_the_plain_reader_reads_them(spark, tmp_path, small_blocks):
    from lodestar.sources import schemas

    path, r = tmp_path / "filings_2025.json", random.Random(3)
    path.write_text(json.dumps([{"filing_uuid": f"u{i}", "income": "5.50", "client": {"name": "".join(r.choice('{}[]",\\:') for _ in range(40))}, "filing_year": 2025} for i in range(200)]))
    got = records._json_array(spark, [str(path)], schemas.FILINGS_JSON)[0]
    plain = spark.read.schema(schemas.FILINGS_JSON).option("multiLine", True).json(str(path)).withColumn("prov", F.concat(F.lit(f"{path}#"), "filing_uuid"))
    assert sorted(map(str, got.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))


def test_lines_are_numbered_in_any_block(spark, tmp_path, small_blocks):
    r = random.Random(2)
    for name, mark, end in (("a", "\ufeff", ""), ("b", "", "\n")):
        lines = ["é" * r.randint(0, 30) + ("\r" if i % 9 == 0 else "") if i % 7 else "" for i in range(1500)] + ["last"]
        text = mark + "\n".join(lines) + end
        (tmp_path / f"{name}.jsonl").write_bytes(text.encode())
        found = sorted(splits.numbered_lines(spark, str(tmp_path / f"{name}.jsonl")).collect(), key=lambda f: f["n"])
        assert [f["value"] for f in found] == lines and [f["n"] for f in found] == list(range(1, 1502))
        assert all(text.encode()[f["byte"] : f["byte"] + f["length"]].decode() == f["value"] for f in found)


def test_blocks_that_change_are_an_error(spark, tmp_path, small_blocks):
    (tmp_path / "a.jsonl").write_text("x\n" * 9000)
    found = splits.numbered_lines(spark, str(tmp_path))
    rows = found.count()
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    again = splits._known(splits._rows(spark, str(tmp_path), "\n", {}).select("path", "block", "value"), spark.createDataFrame([(f"{tmp_path}/a.jsonl", 0, 1)], "path string, block long, n long"), "n")
    with pytest.raises(Exception, match="blocks of the files changed"):
        again.collect()
    assert rows == 9000


def test_look_up_reads_ranges_only(spark, tmp_path):
    path = tmp_path / "filings_2025.json"
    path.write_text(json.dumps([{"filing_uuid": f"u{i}", "x": "é" * i} for i in range(400)] + [{"filing_uuid": "u7", "x": "again"}], ensure_ascii=False))
    (tmp_path / "2025-01.jsonl").write_text("\n".join(json.dumps({"url": i}) for i in range(50)))
    places = records.places(spark, str(path)).unionByName(records.places(spark, str(tmp_path / "2025-01.jsonl")))
    index = provenance.index_of(places)
    lines = f"{tmp_path}/2025-01.jsonl"
    asked = [f"{path}#u{i}" for i in range(0, 400, 10)] + [f"{path}#u7", f"{path}#nobody", f"{lines}#L3", f"{lines}#L03", f"{lines}#L99", f"{lines}#L0", f"{lines}#Lx", "gone.json#u1", f"{path}#u0"]
    wanted = spark.createDataFrame([(a,) for a in asked], "prov string")
    read = spark.sparkContext.accumulator(0)

    def counted(where):
        file = provenance.open_file(where)

        class File:
            def read_at(self, n, at):
                read.add(n)
                return file.read_at(n, at)

            def close(self):
                file.close()

        return File()

    got = {r["prov"]: r for r in provenance.look_up(wanted, index, counted).collect()}
    assert set(got) == set(asked)
    for i in range(0, 400, 10):
        assert json.loads(got[f"{path}#u{i}"]["record"]) == {"filing_uuid": f"u{i}", "x": "é" * i} and got[f"{path}#u{i}"]["error"] is None
    assert json.loads(got[f"{path}#u7"]["record"])["x"] == "é" * 7 and json.loads(got[f"{lines}#L3"]["record"]) == {"url": 2}
    errors = {k.rsplit("#")[-1]: r["error"] for k, r in got.items() if r["record"] is None}
    assert errors == {"nobody": "no such record", "L03": "no such record", "L99": "no such record", "L0": "not a line: L0", "Lx": "not a line: Lx", "u1": "source file not found: gone.json"}
    assert read.value < path.stat().st_size / 8
    scanned = {r["prov"]: (r["record"], r["error"]) for r in provenance.look_up_by_scan(wanted, places).collect()}
    assert scanned == {k: (r["record"], r["error"]) for k, r in got.items()}


def test_encoding_is_decided_by_the_whole_file(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"id,v\n" + b"1,x\n" * 60 + "2,é\n".encode("latin-1"))
    (tmp_path / "b.csv").write_bytes(b"id,v\n" + b"1,x\n" * 60 + "2,é\n".encode())
    for name in "ab":
        assert texts.delimited(spark, str(tmp_path / f"{name}.csv")).where("id = 2").first()["v"] == "é"
