"""The investigator's commands over the ingested tables, with their usual defaults. Each returns DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names, topics
from ..operators import profiling, ranking, resolution, reuse, rollups
from ..operators.ranking import exact_sum, top
from ..scratch import written
from ..sources.records import ingest, provenance  # noqa: F401  commands of their own


class Records:
    """The tables of a folder, and what is resolved from them."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def __getitem__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")

    def members(self) -> DataFrame:
        return self["members"].select(F.col("member_id").alias("entity_id"), "name", "party", "state", "chamber")

    def resolve(self) -> DataFrame:
        """Write and return the table of names: honoree name to member with the method of the match."""
        forms = self["releases"].where("member_id IS NOT NULL").select(F.col("member_id").alias("entity_id"), F.col("member_name").alias("name"))
        # Few names, used four times; written, as they come from all releases.
        index = written(resolution.alias_index(self.members(), forms), "names")
        resolution.resolve_names(self["contribution_items"], index, "honoree_name").write.mode("overwrite").parquet(f"{self.root}/resolved")
        return self["resolved"]

    def build_bridge(self) -> DataFrame:
        """Write and return links between the two sources of filings."""
        a, b = self["other_filings"], self["filings"]
        left = a.select(F.col("house_id").alias("id"), F.col("senate_registrant_id").alias("registrant_id"), F.col("senate_client_id").alias("client_id"), F.col("organization_name").alias("registrant"), F.col("client_name").alias("client"))
        right = b.select(F.col("filing_uuid").alias("id"), "registrant_id", "client_id", F.col("registrant_name").alias("registrant"), F.col("client_name").alias("client"))
        resolution.bridge(left, right).write.mode("overwrite").parquet(f"{self.root}/bridge")
        return self["bridge"]

    def money(self, year: int | None = None, filer: str | None = None, dedup: bool = False) -> DataFrame:
        """Line items with their member and report. dedup keeps one report for each registrant, person and period, the last by id."""
        head = self["contributions"]
        head = head if year is None else head.where(F.col("filing_year") == year)
        head = head if filer is None else head.where(F.col("filer_type") == filer)
        if dedup:
            head = ranking.latest_per_key(head, ["registrant_id", "person_name", "filing_year", "filing_period"], [F.desc("filing_uuid")])
        items = self["contribution_items"].join(head.drop("prov"), "filing_uuid")
        who = self["resolved"].where("entity_id IS NOT NULL").select(F.col("name").alias("honoree_name"), "entity_id")
        return items.join(who, "honoree_name")


def _member(r: Records, who: str) -> DataFrame:
    return resolution.resolve_one(r.members(), who)


def _of(df: DataFrame, one: DataFrame, column: str) -> DataFrame:
    return df.join(F.broadcast(one.withColumnRenamed("entity_id", "__id")), F.col(column) == F.col("__id"), "left_semi")


def member(r: Records, who: str, top_: int = 15) -> dict[str, DataFrame]:
    one = _member(r, who)
    money, said = _of(r.money(), one, "entity_id"), _of(r["releases"], one, "member_id")
    return {
        "pay_by_year": money.groupBy("filing_year").agg(F.count("*").alias("items"), exact_sum("amount").alias("total")),
        "top_payers": top(money.groupBy("registrant_name").agg(F.count("*").alias("items"), exact_sum("amount").alias("total")), [F.desc("total"), F.asc("registrant_name")], top_),
        "releases_by_year": said.groupBy(F.substring("date", 1, 4).alias("year")).agg(F.count("*").alias("n")),
        "samples": top(said.select("date", "title", "prov"), [F.desc("date"), F.asc("prov")], 5),
    }


def client(r: Records, name: str, top_: int = 15) -> dict[str, DataFrame]:
    key = names.org_key(F.lit(name))
    mine = r["filings"].where(F.contains(F.col("client_key"), key))
    acts = r["activities"].join(mine.select("filing_uuid"), "filing_uuid")
    count = lambda df, c: df.where(F.coalesce(F.col(c), F.lit("")) != "").groupBy(c).agg(F.count("*").alias("n"))
    other = r["other_filings"].where(F.contains(F.col("client_key"), key))
    totals = [F.count("*").alias("n"), exact_sum("income").alias("income")]
    return {
        "by_year": mine.groupBy("filing_year").agg(*totals),
        "by_registrant": top(mine.groupBy("registrant_name").agg(*totals), [F.desc("income"), F.asc("registrant_name")], top_),
        "issues": top(count(acts, "issue_code"), [F.desc("n"), F.asc("issue_code")], 15),
        "agencies": top(count(acts.select(F.explode(F.split("gov_entities", "; ")).alias("agency")), "agency"), [F.desc("n"), F.asc("agency")], 10),
        "countries": count(mine, "client_country"),
        "other_by_year": other.groupBy("report_year").agg(*totals),
        "samples": top(mine.select("filing_uuid", "filing_year", "income", "prov"), [F.desc("filing_year"), F.asc("filing_uuid")], 5),
    }


def gatekeeper(r: Records, year: int | None = None, filer: str | None = None, top_: int = 25, dedup: bool = False) -> DataFrame:
    board = ranking.leaderboard(r.money(year, filer, dedup), ["entity_id"], "amount", "registrant_id")
    return top(board, [F.desc("total"), F.asc("entity_id")], top_).join(r.members(), "entity_id", "left")


def anomaly(r: Records, year: int | None = None, top_: int = 15, factor: float = 5.0, over_zero: bool = False) -> DataFrame:
    """Income by client from the latest version of each report, and the ratio to the next client on the list; over_zero as in `ratio_to_next`."""
    rows = r["filings"] if year is None else r["filings"].where(F.col("filing_year") == year)
    latest = ranking.latest_per_key(rows, ["registrant_id", "client_key", "filing_year", "filing_period"], [F.desc("dt_posted"), F.desc("filing_uuid")])
    board = latest.groupBy("client_key").agg(F.max("client_name").alias("client_name"), F.count("*").alias("periods"), exact_sum("income").alias("income"), F.countDistinct("registrant_id").alias("registrants"))
    order = [F.desc("income"), F.asc("client_key")]
    return ranking.ratio_to_next(top(board, order, top_), "income", order, factor, over_zero=over_zero)


def mismatch(r: Records, year: int | None = None, min_gap: float = 50_000, top_: int = 25) -> DataFrame:
    """Latest report against latest report of the bridged engagements; without a year all years are compared."""
    keys = ["registrant_id", "client_id", "year", "period"]
    linked = r["bridge"].where("match_method = 'id_bridge'").select(F.col("left_id").alias("house_id"))
    a = r["other_filings"].join(linked, "house_id", "left_semi").select(F.col("senate_registrant_id").alias("registrant_id"), F.col("senate_client_id").alias("client_id"), F.col("report_year").alias("year"), "report_type", rollups.period_name(F.col("report_type")).alias("period"), "income", "house_id")
    b = r["filings"].select("registrant_id", "client_id", F.col("filing_year").alias("year"), F.col("filing_period").alias("period"), "income", "dt_posted", "filing_uuid")
    if year is not None:
        a, b = a.where(F.col("year") == year), b.where(F.col("year") == year)
    # Spellings of a period rank apart on the left, as the reports do.
    left = ranking.latest_per_key(a.where("income IS NOT NULL"), ["registrant_id", "client_id", "year", "report_type"], [F.desc(names.leading_int(F.col("house_id")))])
    right = ranking.latest_per_key(b.where("income IS NOT NULL"), keys, [F.desc("dt_posted"), F.desc("filing_uuid")]).withColumnRenamed("income", "other_income")
    both = left.where("period IS NOT NULL").join(right, keys).withColumn("gap", F.abs(F.col("income") - F.col("other_income")))
    return top(both.where(F.col("gap") >= min_gap), [F.desc("gap"), F.asc("house_id")], top_)


def lobbyist(r: Records, name: str, top_: int = 20) -> DataFrame:
    mine = r["activity_people"].where(F.contains(F.col("person_key"), names.person_key(F.lit(name))) & (F.trim(F.coalesce("covered_position", F.lit(""))) != ""))
    rows = mine.join(r["filings"].select("filing_uuid", "client_name", "registrant_name"), "filing_uuid")
    pairs = rows.groupBy("person_name", "client_name").agg(F.count("*").alias("n"), rollups.sample_by(["prov"], ["covered_position", "registrant_name", "prov"]).alias("s"))
    return top(pairs, [F.desc("n"), F.asc("person_name"), F.asc("client_name")], top_).select("person_name", "client_name", "n", "s.*")


def _tagged(r: Records, who: str) -> DataFrame:
    """(date, title, prov, tags) of a member's releases, written once: a test of tags would else go below the join and read the patterns on all texts."""
    said = _of(r["releases"], _member(r, who), "member_id")
    return written(said.select("date", "title", "prov", topics.topics_in(topics.lede(F.col("title"), F.col("text"))).alias("tags")), "tagged")


def say(r: Records, who: str, top_: int = 15) -> dict[str, DataFrame]:
    said = _tagged(r, who)
    samples = said.select(F.explode("tags").alias("topic"), "date", "title", "prov").groupBy("topic").agg(rollups.sample_by(["prov"], ["date", "title", "prov"]).alias("sample"))
    by_year = said.where(F.size("tags") > 0).select(F.explode("tags").alias("topic"), F.substring("date", 1, 4).alias("year")).groupBy("topic", "year").agg(F.count("*").alias("n"))
    return {"topics": top(rollups.tag_counts(said, "tags").join(samples, "topic"), [F.desc("n"), F.asc("topic")], top_), "by_year": by_year}


def say_vs_do(r: Records, who: str, areas: DataFrame) -> dict[str, DataFrame]:
    """Shares of topics in releases against shares in (area, n) of sponsored bills; the five widest gaps each way."""
    say_ = _tagged(r, who).select(F.explode("tags").alias("topic")).groupBy("topic").agg(F.count("*").alias("n"))
    do = areas.withColumn("topic", topics.area_topic(F.col("area"))).where("topic IS NOT NULL").groupBy("topic").agg(F.sum("n").alias("n"))
    gaps = rollups.share_gap(say_, do)
    five = lambda lean: top(gaps.where(F.col("lean") == lean), [F.desc(F.abs("gap")), F.asc("topic")], 5)
    return {"gaps": gaps, "says_more": five("says_more"), "does_more": five("does_more")}


def timeline(r: Records, who: str, year: int | None = 2025, filer: str | None = "lobbyist", top_: int = 12, bills: DataFrame | None = None) -> dict[str, DataFrame]:
    """Dated items, releases and sponsored bills of one member by month; bills: entity_id, introduced and any columns.

    year is the year of the report for money and of the date for releases. An item without a registrant is labelled by its contributor.
    """
    one = _member(r, who)
    money = _of(r.money(year, filer), one, "entity_id").where(F.coalesce("item_date", F.lit("")) != "")
    said = _of(r["releases"], one, "member_id").where(F.coalesce("date", F.lit("")) != "")
    said = said if year is None else said.where(F.substring("date", 1, 4) == str(year))
    month = lambda c: F.substring(c, 1, 7)
    label = topics.first_label(F.coalesce(F.nullif("registrant_name", F.lit("")), F.col("contributor_name")))
    acts = {} if bills is None else {"bills": _of(bills.where("introduced IS NOT NULL"), one, "entity_id").orderBy("introduced")}
    return {
        "money_by_month": rollups.period_totals(money, month("item_date"), "amount"),
        "releases_by_month": said.groupBy(month("date").alias("period")).agg(F.count("*").alias("n")),
        "money_by_industry": money.groupBy(label.alias("industry")).agg(F.count("*").alias("n"), exact_sum("amount").alias("total")),
        "top_items": top(money.select("item_date", "registrant_name", "payee_name", "amount", "prov"), [F.desc("amount"), F.asc("prov"), F.asc("item_date")], top_),
        "range": money.agg(F.min("item_date").alias("first"), F.max("item_date").alias("last"), F.count("*").alias("items"), exact_sum("amount").alias("total")),
        **acts,
    }


def committee(roster: DataFrame, member_id: str) -> DataFrame:
    """A member's committee roles and the chairs and ranking seats among them; roster: entity_id, roles array<struct<committee, title>>."""
    return roster.where(F.col("entity_id") == member_id).withColumn("tags", rollups.leadership(F.col("roles")))


def votes(cast: DataFrame, members: DataFrame, member: str) -> DataFrame:
    """One member's roll-call profile; unity needs all votes of the party, so all are read."""
    return rollups.roll_call_profile(cast, members).where(F.col("member") == member)


def vote_align(cast: DataFrame, bills: DataFrame, member: str, most: int = 80) -> DataFrame:
    """Policy areas of one member's latest votes on bills; cast: member, roll, date, bill; bills: bill, area."""
    return rollups.vote_mix(cast.where(F.col("member") == member), bills, most)


def legislation(bills: DataFrame, member_id: str, most: int = 20) -> DataFrame:
    """A member's latest sponsored bills; bills: entity_id, type, number, introduced, title."""
    mine = bills.where(F.col("entity_id") == member_id).select("type", "number", F.substring("title", 1, 120).alias("title"), "introduced")
    return top(mine, [F.desc("introduced"), F.asc("type"), F.asc("number")], most)


def fec(candidates: DataFrame, name: str, state: str | None = None, office: str | None = None, most: int = 5) -> DataFrame:
    """Candidates of an offline snapshot that a name may mean."""
    return top(resolution.candidate_search(candidates, name, state, office), [F.asc("name"), F.asc("candidate_id")], most)


def _releases(r: Records, year: int | None, start: str | None, end: str | None) -> DataFrame:
    tests: list[Column] = []
    tests += [F.substring("date", 1, 4) == str(year)] if year else []
    tests += [F.col("date") >= start] if start else []
    tests += [F.col("date") <= end] if end else []
    rows = r["releases"]
    for t in tests:
        rows = rows.where(t)
    return rows.select("url", F.col("member_id").alias("author"), F.col("member_name").alias("label"), F.col("member_party").alias("party"), "date", "title", "text", "prov")


def clusters(r: Records, year: int | None = None, start: str | None = None, end: str | None = None, min_members: int = 5, top_: int = 30) -> DataFrame:
    return reuse.ranked_clusters(reuse.shared_sentences(_releases(r, year, start, end), min_members), top_)


def keyword(r: Records, phrase: str, top_: int = 40, year: int | None = None) -> dict[str, DataFrame]:
    hits = reuse.phrase_search(_releases(r, year, None, None), phrase)
    return {"authors": hits.groupBy("label").agg(F.count("*").alias("n")), "hits": top(hits.select("date", "label", "title", "url", "prov"), [F.asc("date"), F.asc("url")], top_)}


def annotate(r: Records, roster: DataFrame, year: int = 2025, filer: str | None = "lobbyist", top_: int = 12) -> dict[str, DataFrame]:
    """The leaderboard with up to three committee roles, and how many hold a chair or are ranking; roster: entity_id, roles array<struct<title>>."""
    board = rollups.enrich(gatekeeper(r, year, filer, top_), roster.select("entity_id", "roles"), "entity_id")
    tagged = board.withColumn("tags", rollups.role_tags(F.transform("roles", lambda x: x["title"]))).withColumn("roles", F.slice("roles", 1, 3))
    return {"board": tagged, "leaders": tagged.agg(F.count_if(F.size("tags") > 0).alias("n"), F.count("*").alias("of"))}


def enrich_finance(r: Records, receipts: DataFrame, year: int = 2025, filer: str | None = "lobbyist", top_: int = 12, floor: int = 2024) -> DataFrame:
    """The leaderboard with receipts of the best cycle and the share of them; receipts: entity_id, candidate, cycle, receipts."""
    board = rollups.enrich(gatekeeper(r, year, filer, top_), rollups.best_cycle(receipts, "entity_id", floor), "entity_id")
    return board.withColumn("share_of_receipts", F.round(F.try_divide(F.col("total"), F.nullif(F.col("receipts"), F.lit(0.0))), 4))


def enrich_votes(r: Records, profile: DataFrame, year: int = 2025, filer: str | None = "lobbyist", top_: int = 12) -> DataFrame:
    return rollups.enrich(gatekeeper(r, year, filer, top_), profile, "entity_id")


def enrich_act(r: Records, bills: DataFrame, year: int = 2025, filer: str | None = "lobbyist", top_: int = 20, most: int = 5) -> DataFrame:
    """The leaderboard with the most frequent policy areas of sponsored bills; bills: entity_id, area."""
    areas = rollups.most_common(bills, "entity_id", "area", most).groupBy("entity_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "area", "n"))), lambda x: F.struct(x["area"], x["n"])).alias("areas"))
    return rollups.enrich(gatekeeper(r, year, filer, top_), areas, "entity_id")


def registry(r: Records, queries: list[str], names_: DataFrame) -> DataFrame:
    return resolution.registry_hits(r.spark.createDataFrame([(q,) for q in queries], "query string"), names_)


def profile(df: DataFrame, corr_threshold: float = 0.4) -> dict[str, DataFrame]:
    """Types, statistics, correlations and histograms of a table."""
    kinds = profiling.column_types(df)
    numbers = [x["column"] for x in kinds.where("type <> 'text' AND detail <> 'identifier'").collect()]
    return {"columns": kinds, "statistics": profiling.statistics(df, numbers), "correlations": profiling.correlations(df, numbers, corr_threshold), **{f"histogram_{c}": profiling.histogram(df, c) for c in numbers}}
