"""Names to entities: a cascade of key matches with the method of each match kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names
from .containment import contains_join


def alias_index(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """(entity_id, key, last) of every name form: (entity_id, name) of both inputs; a leading initial may also be dropped."""
    forms = entities.select("entity_id", "name").unionByName(aliases.select("entity_id", "name")).where("name IS NOT NULL").distinct()
    words = F.split(names.person_key(F.col("name")), " ")
    short = forms.where((F.size(words) >= 3) & (F.length(words[0]) == 1)).select("entity_id", F.array_join(F.slice(words, 2, 99), " ").alias("name"))
    key = names.last_first_key(F.col("name"))
    return forms.unionByName(short).select("entity_id", key.alias("key"), F.substring_index(key, "|", 1).alias("last")).where("key <> ''").distinct()


def _unique(index: DataFrame, column: str) -> DataFrame:
    ids = F.countDistinct("entity_id")
    return index.groupBy(F.col(column).alias(column)).agg(ids.alias("n"), F.min("entity_id").alias("id"))


def match_cascade(candidates: DataFrame, index: DataFrame, key: str = "key", prefix: str = "") -> DataFrame:
    """Adds entity_id and match_method: exact; ambiguous_key (no further search); lastname_unique; unmatched."""
    by_key = _unique(index, "key").select(F.col("key").alias("__key"), F.col("n").alias("__kn"), F.col("id").alias("__kid"))
    by_last = _unique(index, "last").select(F.col("last").alias("__last"), F.col("n").alias("__ln"), F.col("id").alias("__lid"))
    joined = candidates.withColumn("__l", F.substring_index(F.col(key), "|", 1)).join(by_key, F.col(key) == F.col("__key"), "left").join(by_last, F.col("__l") == F.col("__last"), "left")
    method = F.when(F.col("__kn") == 1, "exact").when(F.col("__kn") > 1, "ambiguous_key").when(F.col("__ln") == 1, "lastname_unique").otherwise("unmatched")
    entity = F.when(F.col("__kn") == 1, F.col("__kid")).when(F.col("__kn").isNull() & (F.col("__ln") == 1), F.col("__lid"))
    return joined.select(*candidates.columns, entity.alias(f"{prefix}entity_id"), method.alias(f"{prefix}match_method"))


def resolve_names(items: DataFrame, index: DataFrame, name: str = "name", amount: str = "amount") -> DataFrame:
    """Distinct names with count and exact total, entity and method; a campaign committee's person is tried last.

    Names are grouped by name alone, so one name has one row.
    """
    found = items.where(F.col(name).isNotNull() & (F.trim(F.col(name)) != "")).groupBy(F.col(name).alias("name")).agg(F.count("*").alias("n_items"), F.coalesce(F.sum(F.col(amount).cast("decimal(18,2)")).cast("double"), F.lit(0.0)).alias("total_amount"))
    first = match_cascade(found.withColumn("key", names.last_first_key(F.col("name"))), index)
    person = names.last_first_key(names.campaign_candidate(F.col("name")))
    second = match_cascade(first.withColumn("key2", person), index, "key2", "c_")
    use = F.col("entity_id").isNull() & F.col("c_entity_id").isNotNull()
    return second.select("name", "key", "n_items", "total_amount", F.when(use, F.col("c_entity_id")).otherwise(F.col("entity_id")).alias("entity_id"), F.when(use, F.concat(F.lit("campaign_"), F.col("c_match_method"))).otherwise(F.col("match_method")).alias("match_method"))


def coverage(resolved: DataFrame) -> DataFrame:
    """Items in all and items matched."""
    return resolved.agg(F.sum("n_items").alias("items"), F.sum(F.when(F.col("entity_id").isNotNull(), F.col("n_items")).otherwise(0)).alias("matched"))


def role_chamber(roles: Column) -> Column:
    """The chamber by the first committee, of roles (committee, ...), whose name begins with one."""
    side = lambda r: F.when(F.startswith(r["committee"], F.lit("Senate")), "Senate").when(F.startswith(r["committee"], F.lit("House")), "House")
    return F.try_element_at(F.filter(F.transform(roles, side), lambda x: x.isNotNull()), F.lit(1))


def merge_roster(members: DataFrame, roster: DataFrame) -> DataFrame:
    """Members and roster by entity_id: the roster's name wins, missing fields are filled from it, parties become letters.

    Where the roster has roles, a chamber that is missing there is inferred from them.
    """
    if "roles" in roster.columns:
        roster = roster.withColumn("chamber", F.coalesce("chamber", role_chamber(F.col("roles"))))
    letter = lambda c: F.when(F.upper(c).startswith("DEM"), "D").when(F.upper(c).startswith("REP"), "R").when(F.upper(c).startswith("IND"), "I").otherwise(c)
    m, r = members.alias("m"), roster.alias("r")
    fill = lambda c: F.coalesce(F.col(f"m.{c}"), F.col(f"r.{c}"))
    return m.join(r, "entity_id", "full_outer").select("entity_id", F.coalesce("r.name", "m.name").alias("name"), letter(fill("party")).alias("party"), fill("state").alias("state"), fill("chamber").alias("chamber")).withColumn("key", names.last_first_key(F.col("name")))


def bridge(left: DataFrame, right: DataFrame) -> DataFrame:
    """Links (left_id, right_id, match_method) of two sources: by ids, and for rows left over by names.

    Both have registrant_id, client_id, registrant, client and id. The right side is reduced to one row for each key before
    the joins, so nothing fans out.
    """
    ids = ["registrant_id", "client_id"]
    by_id = left.where("registrant_id IS NOT NULL AND client_id IS NOT NULL").join(right.groupBy(*ids).agg(F.min("id").alias("right_id")), ids).select(F.col("id").alias("left_id"), "right_id", F.lit("id_bridge").alias("match_method"))
    keyed = lambda df: df.withColumns({"rk": names.org_key(F.col("registrant")), "ck": names.org_key(F.col("client"))}).where("rk <> '' AND ck <> ''")
    rest = left.join(by_id.select(F.col("left_id").alias("id")), "id", "left_anti")
    # Names repeat in many rows: each pair of them is made a key once.
    pairs = right.groupBy("registrant", "client").agg(F.min("id").alias("id"))
    by_name = keyed(rest).join(keyed(pairs).groupBy("rk", "ck").agg(F.min("id").alias("right_id")), ["rk", "ck"]).select(F.col("id").alias("left_id"), "right_id", F.lit("name_bridge").alias("match_method"))
    return by_id.unionByName(by_name)


def resolve_one(entities: DataFrame, who: str) -> DataFrame:
    """The entity whose id is `who`; else the only one with its key; else the only one whose name contains it."""
    key = names.last_first_key(F.lit(who))
    tries = [F.col("entity_id").cast("string") == who, names.last_first_key(F.col("name")) == key, names.like_literal(F.col("name"), who)]
    # Three counts and least ids in one row: each try counts on its own.
    stats = entities.agg(*(F.count_if(t).alias(f"n{i}") for i, t in enumerate(tries)), *(F.min(F.when(t, F.col("entity_id"))).alias(f"id{i}") for i, t in enumerate(tries)))
    return stats.select(F.coalesce(*(F.when(F.col(f"n{i}") == 1, F.col(f"id{i}")) for i in range(3))).alias("entity_id")).where("entity_id IS NOT NULL")


def registry_hits(queries: DataFrame, registry: DataFrame) -> DataFrame:
    """Registry rows whose upper-cased name contains the first word of the query's key, with query and word; any number of either."""
    q = queries.select("query", F.split(names.org_key(F.col("query")), " ")[0].alias("word")).where("word <> ''").distinct()
    found = contains_join(registry.select(F.upper("name").alias("text")), q.select(F.col("word").alias("needle")))
    met = q.join(found.withColumnRenamed("needle", "word"), "word")
    return registry.withColumn("__upper", F.upper("name")).join(met, F.col("__upper") == F.col("text")).drop("__upper", "text")


def candidate_search(candidates: DataFrame, name: str, state: str | None = None, office: str | None = None) -> DataFrame:
    """Candidates (name, state, office, ...) whose names hold all words of a name, of one state and office if given; if there are none, those
    with its last word."""
    words = [w for w in name.replace(".", "").replace(",", " ").upper().split() if w]
    near = candidates
    near = near if state is None else near.where(F.col("state") == state)
    near = near if office is None else near.where(F.col("office") == office)
    held = F.split(F.regexp_replace(F.upper("name"), "[.,]", " "), r"\s+")
    has = lambda some: F.forall(F.array(*map(F.lit, some)), lambda w: F.array_contains(held, w))
    marked = near.withColumns({"__all": has(words), "__last": has(words[-1:])}).where("__last")
    best = marked.agg(F.max("__all").alias("__best"))
    return marked.crossJoin(F.broadcast(best)).where("__all = __best").drop("__all", "__last", "__best")
