"""Queries over texts: topics, reuse, claims, segments and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, topics, urls
from ..operators import claims, reuse, rollups
from ..sources.texts import split_paragraphs
from .registry import query, re2, table

#: Topics by words that occur in the texts at hand.
WORDS = {"Being": ["that is", "und ist", "est "], "Going": ["ing the", "nach ", "pour "], "Having": ["have", "haben", "avoir", "with the"], "Place": ["from", "von ", "dans "]}
_TAGS = "list_filter([" + ", ".join(f"CASE WHEN {' OR '.join(f'contains(lower({{0}}), {chr(39)}{w}{chr(39)})' for w in ws)} THEN '{t}' END" for t, ws in WORDS.items()) + "], LAMBDA x: x IS NOT NULL)"


def _tags(spark: SparkSession, sf: str, name: str, *columns: str) -> DataFrame:
    return table(spark, sf, name).select(*columns, topics.topics_in(F.lower("text"), WORDS).alias("tags"))


@query(f"""
WITH d AS (SELECT source, {_TAGS.format('text')} AS tags FROM documents), t AS (SELECT * FROM d WHERE len(tags) > 0)
SELECT topic, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM t), 3) AS share FROM (SELECT unnest(tags) AS topic FROM t) GROUP BY 1""")
def topic_counts(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.tag_counts(_tags(spark, sf, "documents"), "tags")


@query(f"""
WITH d AS (SELECT lang, {_TAGS.format('text')} AS tags FROM documents), t AS (SELECT * FROM d WHERE len(tags) > 0)
SELECT lang, topic, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM t), 3) AS share FROM (SELECT lang, unnest(tags) AS topic FROM t) GROUP BY 1, 2""")
def topic_share(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.tag_counts(_tags(spark, sf, "documents", "lang"), "tags", ["lang"])


@query(f"""
WITH s AS (SELECT topic, count(*) AS n FROM (SELECT unnest({_TAGS.format('text')}) AS topic FROM documents) GROUP BY 1),
d AS (SELECT topic, count(*) AS n FROM (SELECT unnest({_TAGS.format('text')}) AS topic FROM conversations) GROUP BY 1),
b AS (SELECT coalesce(s.topic, d.topic) AS topic, coalesce(round(s.n::DOUBLE / (SELECT sum(n) FROM s), 3), 0) AS say_share, coalesce(round(d.n::DOUBLE / (SELECT sum(n) FROM d), 3), 0) AS do_share FROM s FULL JOIN d ON s.topic = d.topic)
SELECT *, round(say_share - do_share, 3) AS gap, CASE WHEN round(say_share - do_share, 3) >= 0.1 THEN 'says_more' WHEN round(say_share - do_share, 3) <= -0.1 THEN 'does_more' ELSE 'aligned' END AS lean FROM b""")
def topic_alignment(spark: SparkSession, sf: str) -> DataFrame:
    count = lambda t: _tags(spark, sf, t).select(F.explode("tags").alias("topic")).groupBy("topic").agg(F.count("*").alias("n"))
    return rollups.share_gap(count("documents"), count("conversations"))


#: Phrases that are added to texts, so that every pattern occurs somewhere.
PHRASES = [
    "It cost $5 million.", "Some 12% of it went.", "On January 5, 2024 it rained.", 'He said "we will not do it".', "It is so according to them.", "This was the biggest of all.",
    "The National Rivers Council met.", "Senator Lee spoke of hospital care.", "It took more than half of 1,200 tons.", "Plain words stand here.", "New tariffs hit 3 of 4 farms.", "The border bill and the tax on oil.",
]
_PHRASE = "[" + ", ".join(f"'{p}'" for p in PHRASES) + "]"


def phrase(at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, PHRASES)), (at % len(PHRASES) + 1).cast("int"))


def _lookup_sql(pairs: dict[str, str], key: str) -> str:
    return "CASE " + key + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs.items()) + " END"


_AREAS, _CODES = [*topics.AREA_TOPICS, "Native Americans"], [*topics.ISSUE_TOPICS, "XYZ"]
_DEFAULT_TAGS = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(said, {re2('(?i)' + '|'.join(p))}) THEN '{t}' END" for t, p in topics.TOPICS.items()) + "], LAMBDA x: x IS NOT NULL)"


@query(f"""WITH d AS (SELECT doc_id, text || ' ' || {_PHRASE}[doc_id % {len(PHRASES)} + 1] AS said, [{', '.join(f"'{a}'" for a in _AREAS)}][doc_id % {len(_AREAS)} + 1] AS a, [{', '.join(f"'{c}'" for c in _CODES)}][doc_id % {len(_CODES)} + 1] AS c FROM documents)
SELECT doc_id, array_to_string({_DEFAULT_TAGS}, '|') AS topics, {_lookup_sql(topics.AREA_TOPICS, 'a')} AS area, {_lookup_sql(topics.ISSUE_TOPICS, 'c')} AS issue FROM d""")
def topic_vocabularies(spark: SparkSession, sf: str) -> DataFrame:
    """All topic patterns over texts, and every policy area and issue code, blanks and case about them."""
    d = F.col("doc_id")
    said = F.concat("text", F.lit(" "), phrase(d))
    one = lambda values: F.element_at(F.array(*map(F.lit, values)), (d % len(values) + 1).cast("int"))
    return table(spark, sf, "documents").select("doc_id", F.array_join(topics.topics_in(said), "|").alias("topics"), topics.area_topic(F.concat(F.lit(" "), one(_AREAS), F.lit(" "))).alias("area"), topics.issue_topic(F.concat(F.lit(" "), F.lower(one(_CODES)))).alias("issue"))


def reuse_urls(url: str) -> str:
    """SQL: the three least URLs of a group."""
    return f"array_to_string(list_sort(list(DISTINCT {url}))[1:3], ' ')"


_SENTENCES = r"""(SELECT DISTINCT doc_id, source, lang, lower(s) AS low, s FROM (
  SELECT doc_id, source, lang, trim(regexp_replace(unnest(regexp_split_to_array(text, '[\n.]')), '\s+', ' ', 'g')) AS s FROM documents) WHERE length(s) >= 80)"""


@query(f"""WITH g AS (SELECT low, count(DISTINCT source) AS n_members, string_agg(DISTINCT left(lang, 1), '' ORDER BY left(lang, 1)) AS parties, min('doc' || doc_id) AS sample_url, {reuse_urls("'doc' || doc_id")} AS sample_urls, (max(doc_id % 300) - min(doc_id % 300))::INT AS span_days, first(s ORDER BY 'doc' || doc_id, s) AS sentence
  FROM {_SENTENCES} GROUP BY low HAVING count(DISTINCT source) >= 3)
SELECT low, n_members, parties, sample_url, sample_urls, span_days, left(sentence, 200) AS sentence, regexp_matches(sentence, {re2(text.BILL)})::INT + regexp_matches(sentence, {re2(text.MONEY)})::INT + regexp_matches(sentence, {re2(text.PROPER)})::INT AS specificity FROM g""")
def text_reuse_clusters(spark: SparkSession, sf: str) -> DataFrame:
    day = F.date_format(F.date_add(F.lit("2025-01-01").cast("date"), (F.col("doc_id") % 300).cast("int")), "yyyy-MM-dd")
    rows = table(spark, sf, "documents").select(F.concat(F.lit("doc"), "doc_id").alias("url"), F.col("source").alias("author"), F.col("lang").alias("party"), day.alias("date"), "text")
    return reuse.shared_sentences(rows, 3).withColumn("sample_urls", F.array_join("sample_urls", " "))


@query("SELECT source, count(*) AS n FROM documents WHERE contains(lower(text), 'of the') GROUP BY 1")
def phrase_search(spark: SparkSession, sf: str) -> DataFrame:
    return reuse.phrase_search(table(spark, sf, "documents"), "of the").groupBy("source").agg(F.count("*").alias("n"))


_FLAGS_OF = lambda c: "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({c}, {re2(p)}) THEN '{n}' END" for n, p in text.FLAGS.items()) + "], LAMBDA x: x IS NOT NULL)"
_TYPE_OF = """CASE WHEN list_contains({0}, 'direct_quote') THEN 'quote' WHEN list_contains({0}, 'attribution') THEN 'attribution' WHEN list_has_any({0}, ['dollar_amount', 'percentage']) THEN 'statistic'
  WHEN list_contains({0}, 'date') AND list_has_any({0}, ['named_organization', 'named_title']) THEN 'date_event' WHEN list_contains({0}, 'superlative') THEN 'comparison_or_superlative' WHEN len({0}) > 0 THEN 'named_fact' ELSE 'general_assertion' END"""


@query(f"""WITH d AS (SELECT doc_id, {_FLAGS_OF("(text || ' ' || " + _PHRASE + "[doc_id % " + str(len(PHRASES)) + " + 1])")} AS f FROM documents) SELECT doc_id, array_to_string(f, '|') AS flags, {_TYPE_OF.format('f')} AS claim_type FROM d""")
def claim_flags(spark: SparkSession, sf: str) -> DataFrame:
    """All eight flags and the type that follows from them."""
    flags = text.claim_flags(F.concat("text", F.lit(" "), phrase(F.col("doc_id"))))
    return table(spark, sf, "documents").select("doc_id", F.array_join(flags, "|").alias("flags"), text.claim_type(flags).alias("claim_type"))


_ALL = lambda p: "regexp_extract_all(t, '" + p.replace("'", "''") + "')"


@query(f"""WITH p AS (SELECT p_partkey, {_PHRASE}[p_partkey % {len(PHRASES)} + 1] || ' ' || {_PHRASE}[(p_partkey // 7) % {len(PHRASES)} + 1] || ' ' || {_PHRASE}[(p_partkey // 11) % {len(PHRASES)} + 1] AS t FROM part),
l AS (SELECT p_partkey, list_filter(list_transform({_ALL(text.DOLLAR)} || {_ALL(text.PERCENT)} || list_filter({_ALL(text.NUMBER)}, LAMBDA x: NOT regexp_full_match(trim(x), '{text.DATE}')) || {_ALL(text.DATE)} || {_ALL(text.SUPERLATIVE)} || {_ALL(text.ORGANIZATION)}, LAMBDA x: trim(x)), LAMBDA x: x <> '') AS l FROM p)
SELECT p_partkey, array_to_string(list_filter(l, LAMBDA x, i: list_position(list_transform(l, LAMBDA y: lower(y)), lower(x)) = i)[1:12], '|') AS terms FROM l""")
def claim_terms(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("p_partkey")
    said = F.concat_ws(" ", phrase(p), phrase(F.floor(p / 7)), phrase(F.floor(p / 11)))
    return table(spark, sf, "part").select("p_partkey", F.array_join(text.claim_terms(said), "|").alias("terms"))


@query(r"SELECT item_id, regexp_matches(text, '[0-9]') AND regexp_matches(text, '(?i)(^|[^a-z])(more|less|half|double)([^a-z]|$)') AS multi FROM benchmark")
def multi_claim(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select("item_id", text.multi_claim(F.col("text")).alias("multi"))


_ADDED = """ Mr. Lee met Gov. Ray vs. Acme Inc. "He left!" Why? Nobody on Jan. 5 paid 3.5 dollars. "Ok." End"""
_ABBREVIATIONS = "[" + ", ".join(f"'{a}'" for a in text.ABBREVIATIONS) + "]"


@query(rf"""
WITH p AS (SELECT doc, paragraph, t, sum(length(t) + 1) OVER (PARTITION BY doc ORDER BY paragraph) - length(t) - 1 AS cursor FROM (
  SELECT conv_id || '-' || turn AS doc, unnest(string_split(text || '{_ADDED}', chr(10))) AS t, unnest(range(len(string_split(text || '{_ADDED}', chr(10))))) AS paragraph FROM conversations)),
c AS (SELECT *, string_split(regexp_replace(t, '([.!?])(\s+[A-Z"“])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS pieces FROM p),
g AS (SELECT *, list_filter(list_transform(string_split(list_reduce(pieces, LAMBDA a, x: a || CASE WHEN list_contains({_ABBREVIATIONS}, rtrim(lower(regexp_extract(a, '(\S+)[.!?]$', 1)), '.')) THEN '' ELSE chr(2) END || x), chr(2)), LAMBDA x: regexp_replace(x, '^\s+|\s+$', '', 'g')), LAMBDA x: x <> '') AS s FROM c),
e AS (SELECT doc, paragraph, t, cursor, unnest(s) AS sentence, unnest(range(len(s)))::INT AS sentence_index FROM g),
f AS (SELECT *, {_FLAGS_OF('sentence')} AS f FROM e)
SELECT doc, paragraph::INT AS paragraph, sentence_index, sentence, (cursor + strpos(t, sentence) - 1)::BIGINT AS start, (cursor + strpos(t, sentence) - 1 + length(sentence))::BIGINT AS "end", array_to_string(f, '|') AS flags, {_TYPE_OF.format('f')} AS claim_type, len(f) > 0 AS needs_note FROM f""")
def sentence_index(spark: SparkSession, sf: str) -> DataFrame:
    """Every sentence of every conversation text, and of a paragraph of abbreviations, with its place, flags and type."""
    said = F.concat("text", F.lit(_ADDED))
    rows = table(spark, sf, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("doc"), F.posexplode(F.split(said, "\n")).alias("paragraph", "text"))
    found = claims.claim_table(rows)
    return found.select("doc", "paragraph", "sentence_index", "sentence", "start", "end", F.array_join("flags", "|").alias("flags"), "claim_type", "needs_note")


_RULE_HOSTS = [h for h, _, _ in urls.RULES] + ["nowhere.example"]
_TIERS = "CASE " + " ".join(f"WHEN host = '{h}'" + (f" OR suffix(host, '.{h}')" if below else "") + f" THEN '{t}'" for h, t, below in urls.RULES) + " ELSE 'unknown' END"


@query(f"""WITH h AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'www.' ELSE 'not' END || [{', '.join(f"'{h}'" for h in _RULE_HOSTS)}][page_id % {len(_RULE_HOSTS)} + 1] AS host FROM pages) SELECT page_id, host, {_TIERS} AS tier FROM h""")
def url_tiers(spark: SparkSession, sf: str) -> DataFrame:
    """Every host of the default rules, bare, below www and as the end of another name."""
    p = F.col("page_id")
    name = F.concat(F.element_at(F.array(F.lit(""), F.lit("www."), F.lit("not")), (p % 3 + 1).cast("int")), F.element_at(F.array(*map(F.lit, _RULE_HOSTS)), (p % len(_RULE_HOSTS) + 1).cast("int")))
    host = urls.host(F.concat(F.lit("HTTPS://me:pw@"), name, F.lit(":80/x?y")))
    return table(spark, sf, "pages").select("page_id", host.alias("host"), urls.tier(host).alias("tier"))


@query("""
WITH h AS (SELECT page_id, coalesce(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1), '') AS host FROM pages)
SELECT page_id, host, CASE WHEN host = 'example.org' OR suffix(host, '.example.org') THEN 'primary' WHEN suffix(host, '.net') THEN 'unacceptable' ELSE 'unknown' END AS tier FROM h""")
def url_tier(spark: SparkSession, sf: str) -> DataFrame:
    host = urls.host(F.col("url"))
    return table(spark, sf, "pages").select("page_id", host.alias("host"), urls.tier(host, [("example.org", "primary", True), ("net", "unacceptable", True)]).alias("tier"))


@query(r"SELECT doc_id, pos - 1 AS position, trim(p) AS text FROM (SELECT doc_id, unnest(list_filter(regexp_split_to_array(text, '\n'), LAMBDA x: trim(x) <> '')) AS p, generate_subscripts(list_filter(regexp_split_to_array(text, '\n'), LAMBDA x: trim(x) <> ''), 1) AS pos FROM documents)")
def text_segments(spark: SparkSession, sf: str) -> DataFrame:
    pieces = split_paragraphs(F.col("text"), "\n")
    return table(spark, sf, "documents").select("doc_id", F.posexplode(pieces).alias("position", "text")).withColumn("position", F.col("position").cast("bigint"))


_QUOTED = lambda t: f"CASE WHEN length({t}) <= 480 THEN {t} WHEN strpos(reverse(left({t}, 480)), ' .') > 0 AND 480 - strpos(reverse(left({t}, 480)), ' .') > 240 THEN left({t}, 480 - strpos(reverse(left({t}, 480)), ' .')) || ' [...]' ELSE rtrim(left({t}, 480)) || ' [...]' END"


@query(f"SELECT doc_id, {_QUOTED('text')} AS quote FROM documents")
def quote_trim(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", text.trim_quote(F.col("text")).alias("quote"))


@query("""SELECT page_id, coalesce(nullif(left(trim(regexp_replace(regexp_replace(url, '^https?://', ''), '[^A-Za-z0-9]+', '_', 'g'), '_'), 80), ''), 'source') AS slug,
  CASE page_id % 4 WHEN 0 THEN 'html' WHEN 1 THEN 'json' WHEN 2 THEN coalesce(nullif(regexp_extract(lower(url), '\\.([a-z0-9]{1,5})(?:\\?|$)', 1), ''), 'bin') ELSE 'pdf' END AS extension FROM pages""")
def snapshot_names(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("page_id")
    kind = F.element_at(F.array(F.lit("text/HTML; charset=utf-8"), F.lit("application/ld+json"), F.lit(None).cast("string"), F.lit("application/pdf")), (p % 4 + 1).cast("int"))
    return table(spark, sf, "pages").select("page_id", text.url_slug(F.col("url")).alias("slug"), text.extension(kind, F.col("url")).alias("extension"))


_NOTE_SOURCES = """src AS (SELECT item_id % 10 AS source_id, ['pdf', 'transcript', 'url', 'text'][item_id % 4 + 1] AS type, 'Title ' || (item_id % 10) AS title, CASE WHEN item_id % 3 = 0 THEN NULL ELSE 'May 5, 2024' END AS date, 'https://x.org/' || (item_id % 10) AS url FROM benchmark WHERE item_id < 8),
seg AS (SELECT item_id % 10 AS source_id, item_id AS segment_id, item_id AS page, '00:0' || (item_id % 10) AS timecode, text AS segment_text FROM benchmark WHERE item_id % 3 <> 1)"""


@query(f"""WITH {_NOTE_SOURCES}, m AS (SELECT item_id AS claim_id, item_id % 10 AS source_id, item_id AS segment_id, CASE WHEN item_id % 2 = 0 THEN text END AS quote FROM benchmark),
j AS (SELECT m.*, s.type, s.title, s.date, s.url, g.page, g.timecode, g.segment_text FROM m LEFT JOIN src s USING (source_id) LEFT JOIN seg g USING (source_id, segment_id)),
n AS (SELECT claim_id, CASE WHEN type IS NOT NULL AND (segment_text IS NOT NULL OR type = 'url') THEN concat_ws(', ', title, date, CASE type WHEN 'pdf' THEN 'p. ' || page WHEN 'transcript' THEN 'T/C ' || timecode WHEN 'url' THEN url END) || ': “' || {_QUOTED("coalesce(quote, segment_text, '')")} || '”' END AS found, left(coalesce(quote, ''), 140) AS quote FROM j)
SELECT claim_id, coalesce(found, '[source needed] ' || coalesce(quote, '')) AS note, CASE WHEN found IS NULL THEN 'needs_source' ELSE 'matched' END AS status, coalesce(contains(found, 'https://'), false) AS has_url,
  regexp_matches(coalesce(found, '[source needed] ' || coalesce(quote, '')), {re2(text.DATE_LIKE)}) AS has_date, contains(coalesce(found, ''), 'T/C ') AS has_cue FROM n""")
def source_notes(spark: SparkSession, sf: str) -> DataFrame:
    """Notes for claims whose sources and segments are there, partly or not at all, and the cues in them."""
    items, i = table(spark, sf, "benchmark"), F.col("item_id")
    key = (i % 10).alias("source_id")
    kinds = F.element_at(F.array(*map(F.lit, ["pdf", "transcript", "url", "text"])), (i % 4 + 1).cast("int"))
    of = items.where("item_id < 8").select(key, kinds.alias("type"), F.concat(F.lit("Title "), i % 10).alias("title"), F.when(i % 3 != 0, "May 5, 2024").alias("date"), F.concat(F.lit("https://x.org/"), i % 10).alias("url"))
    segments = items.where("item_id % 3 <> 1").select(key, i.alias("segment_id"), i.alias("page"), F.concat(F.lit("00:0"), i % 10).alias("timecode"), "text")
    matches = items.select(i.alias("claim_id"), key, i.alias("segment_id"), F.when(i % 2 == 0, F.col("text")).alias("quote"))
    return claims.note_cues(claims.render_notes(matches, of, segments))


@query(r"""WITH w AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}%$]+'), LAMBDA x: length(x) > 1)) AS l FROM benchmark),
c AS (SELECT item_id AS claim_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}%$]+'), LAMBDA x: length(x) > 1))) AS word FROM benchmark), s AS (SELECT item_id AS segment_id, unnest(l) AS word FROM w)
SELECT claim_id, segment_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY score DESC, segment_id)::INT AS rank FROM (SELECT claim_id, segment_id, count(*) AS score FROM c JOIN s USING (word) GROUP BY 1, 2)) WHERE rank <= 3""")
def claim_segments(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "benchmark")
    return claims.lexical_matches(items.select(F.col("item_id").alias("claim_id"), F.array("text").alias("terms")), items.select(F.col("item_id").alias("segment_id"), "text"))


@query("SELECT doc_id, sha256(text) AS sha256, substr(sha1(text), 1, 16) AS cache_key FROM documents")
def content_hashes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.substring(F.sha1("text"), 1, 16).alias("cache_key"))


#: How a bill may be written, and its kind; null for what is no bill.
_WRITTEN = {"HR ": "hr", "H J Res ": "hjres", "s ": "s", "PN ": None, "hres": "hres", "S Con Res ": "sconres", "HCONRES ": "hconres", "sjres  ": "sjres", "SRES": "sres", "H.R. ": None}


@query(f"""WITH b AS (SELECT page_id, [{', '.join('NULL' if k is None else f"'{k}'" for k in _WRITTEN.values())}][page_id % {len(_WRITTEN)} + 1] AS kind FROM pages) SELECT page_id, kind, CASE WHEN kind IS NOT NULL THEN (page_id + 1)::VARCHAR END AS n FROM b""")
def bill_numbers(spark: SparkSession, sf: str) -> DataFrame:
    bill = F.concat(F.element_at(F.array(*map(F.lit, _WRITTEN)), (F.col("page_id") % len(_WRITTEN) + 1).cast("int")), F.col("page_id") + 1)
    return table(spark, sf, "pages").select("page_id", text.bill_kind(bill).alias("kind"), text.bill_number(bill).alias("n"))


_WIDTH = 60


@query(f"""WITH d AS (SELECT item_id, list_filter(regexp_split_to_array(text, '[\\s\\p{{Z}}\\x{{85}}\\x0B]+'), LAMBDA w: w <> '') AS w FROM benchmark),
l AS (SELECT item_id, list_reduce(w, LAMBDA a, x: CASE WHEN length(split_part(a, chr(10), -1)) + 1 + length(x) > {_WIDTH} THEN a || chr(10) || x ELSE a || ' ' || x END) AS t FROM (SELECT item_id, CASE WHEN len(w) = 0 THEN [''] ELSE w END AS w FROM d))
SELECT item_id, t AS wrapped, len(string_split(t, chr(10))) AS n_lines FROM l""")
def wrapped_texts(spark: SparkSession, sf: str) -> DataFrame:
    lines = text.wrap_words(F.col("text"), _WIDTH)
    return table(spark, sf, "benchmark").select("item_id", F.array_join(lines, "\n").alias("wrapped"), F.size(lines).cast("bigint").alias("n_lines"))


_MARKED = """'<b a="' || doc_id || '">' || coalesce(text, '') || ' & ''more''</b>'"""


@query(f"SELECT doc_id, replace(replace(replace(replace(replace({_MARKED}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&#x27;') AS html FROM documents")
def escaped_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Texts between tags, made safe for HTML."""
    marked = F.concat(F.lit('<b a="'), "doc_id", F.lit('">'), F.coalesce("text", F.lit("")), F.lit(" & 'more'</b>"))
    return table(spark, sf, "documents").select("doc_id", text.escape_html(marked).alias("html"))


_HINTED = f"regexp_matches(q, {re2(rf'(?i)\b(?:{"|".join(topics.PLAN_HINTS)})\b')})"
_FIELD = "CASE doc_id % 4 WHEN 0 THEN ' ' || upper(source) || ' ' WHEN 1 THEN ' LOBBYING' ELSE '' END"


@query(f"""WITH q AS (SELECT doc_id, text || CASE WHEN doc_id % 5 = 0 THEN ' Who pays the LDA registrant?' ELSE '' END AS q, trim({_FIELD}) AS f FROM documents)
SELECT doc_id, CASE WHEN lower(f) IN ('lobbying', 'influence', 'campaign-finance') OR (f = '' AND {_HINTED}) THEN 'lobbying' WHEN f = '' THEN 'generic' ELSE f END AS plan, f = '' AND {_HINTED} AS guessed FROM q""")
def plan_choice(spark: SparkSession, sf: str) -> DataFrame:
    """The plan for each document's whole text as a question, with and without a stated field."""
    d = F.col("doc_id")
    said = F.concat("text", F.when(d % 5 == 0, " Who pays the LDA registrant?").otherwise(""))
    stated = F.when(d % 4 == 0, F.concat(F.lit(" "), F.upper("source"), F.lit(" "))).when(d % 4 == 1, " LOBBYING").otherwise("")
    return table(spark, sf, "documents").select(d, topics.plan_for(stated, said).alias("p")).select("doc_id", "p.*")
