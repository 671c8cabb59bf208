"""The queries opN_<name>: thin digests of the operators, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat_format, embedding_dedup, kd_sharding, minhash, mixing, packing, quality_cnn, quality_rules, suffix_dedup, url_filter, vector_codes, whitening
from .common import table


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    length = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["hi"] - s["lo"])
    cut = suffix_dedup.repeats(docs).select(
        "tid",
        "n_bytes",
        length.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        # What is left, as text: where a cut goes through a character, its bytes become U+FFFD.
        F.make_valid_utf8(F.col("kept").cast("string")).alias("text"),
    )
    rows = docs.select("doc_id", suffix_dedup.text_key("text").alias("tid"))
    return rows.join(cut, "tid").drop("tid")


#: (host, path, verdict)
URL_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op3_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = quality_cnn.fit_quality(docs, labels.where(~held_out))
    scored = quality_cnn.score_documents(docs, model)
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.link_embeddings(table(spark, sf_dir, "embeddings"))


def op5_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = kd_sharding.kd_shards(table(spark, sf_dir, "documents"))
    return shards.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))


#: The conversation that the contract adds: texts made of control strings.
ADDED = "SELECT * FROM VALUES (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)"


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(spark.sql(ADDED))
    read = chat_format.read_back(chat_format.format_chats(turns))
    listing = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(listing, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
        "valid",
    )


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.score_quality(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan_mix(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_decode(table(spark, sf_dir, "documents"), vocabulary_path(), cache_words=1 << 17)
    return coded.select(
        "doc_id",
        (F.octet_length("tokens") / 4).cast("long").alias("n_tokens"),
        F.sha2("tokens", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten_embeddings(table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").try_cast("long"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, books, _ = vector_codes.compress_vectors(table(spark, sf_dir, "embeddings"))
    return rows.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(vector_codes.digest(books)).alias("codebooks_sha256"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json"))


def _escaped(column: str, t: chat_format.Template, role: bool = False) -> str:
    out = f"replace({column}, '&', '&amp;')"
    for i, c in enumerate(t.controls):
        out = f"replace({out}, '{c}', '&c{i};')"
    return f"replace({out}, chr(10), '&n;')" if role else out


_T = chat_format.Template()

OP7_SQL = f"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
grouped AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS listing,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    sum(length({_escaped("role", _T, True)}) + length({_escaped("text", _T)}) + {len(_T.open) + len(_T.after_role) + len(_T.close)})::BIGINT AS formatted_chars,
    string_agg(role, ',' ORDER BY turn NULLS FIRST, role, text) AS order_
  FROM rows_ GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(listing) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars,
  regexp_full_match(order_, '(system,)?user,assistant(,user,assistant)*') AS valid
FROM grouped"""

OP9_SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
totals AS (
  SELECT source, sum(size)::BIGINT AS n, count(*) AS docs, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM sized GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER o AS k,
    (sum(n) OVER () - coalesce(sum(3 * n) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE / (sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS share
  FROM totals WINDOW o AS (ORDER BY n::DOUBLE / w, source NULLS LAST)),
level AS (SELECT arg_min(share, k) AS share FROM ranked WHERE share * w <= 3 * n),
plan AS (SELECT source, n, least(level.share * w, 3 * n)::DOUBLE AS target FROM totals, level),
ordered AS (
  SELECT s.doc_id, s.source, s.size, p.n, p.target, row_number() OVER (PARTITION BY s.source ORDER BY s.size DESC, s.doc_id) AS k
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source),
cuts AS (
  SELECT source, n, target, CASE WHEN count(*) FILTER (size > target * 0.01::DOUBLE) > 512 THEN (max(size) FILTER (k = 513))::DOUBLE ELSE target * 0.01::DOUBLE END AS cut
  FROM ordered GROUP BY source, n, target),
large AS (SELECT o.*, o.target / o.n AS r FROM ordered o JOIN cuts c ON o.source IS NOT DISTINCT FROM c.source WHERE o.size > c.cut),
walk AS (
  SELECT source, 0::BIGINT AS k, 0.0::DOUBLE AS ahead, 0::BIGINT AS copies, 0::BIGINT AS size, 0::BIGINT AS doc_id FROM plan
  UNION ALL
  SELECT source, k, CASE WHEN up THEN more ELSE less END, (CASE WHEN up THEN floor(r) + 1 ELSE floor(r) END)::BIGINT, size, doc_id FROM (
    SELECT *, abs(more) < abs(less) AND floor(r) + 1 <= 3 AS up FROM (
      SELECT l.source, l.k, l.size, l.doc_id, l.r, w.ahead + (floor(l.r) - l.r) * l.size AS less, w.ahead + (floor(l.r) + 1 - l.r) * l.size AS more
      FROM walk w JOIN large l ON w.source IS NOT DISTINCT FROM l.source AND l.k = w.k + 1))),
taken AS (SELECT source, sum(size)::BIGINT AS size, sum(size * copies)::BIGINT AS words FROM walk GROUP BY source),
rates AS (
  SELECT c.source, c.n, c.target, c.cut, CASE WHEN c.n > t.size THEN least(greatest((c.target - t.words) / (c.n - t.size), 0), 3) WHEN c.n > 0 THEN c.target / c.n ELSE 0 END AS rate,
    ('0x' || substr(md5('offset 7:' || coalesce(c.source, chr(0) || 'null')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM cuts c JOIN taken t ON c.source IS NOT DISTINCT FROM t.source),
cells AS (
  SELECT s.*, r.n, r.target, r.rate, r.u, (CASE WHEN size < 16 THEN size ELSE length(bin(size)) * 8 + ((size >> (length(bin(size)) - 4)) & 7) END) AS size_class,
    ('0x' || substr(md5('7:' || doc_id), 1, 8))::BIGINT % greatest(16, (SELECT count(*) FROM sized) // 20000) AS block
  FROM sized s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source WHERE s.size <= r.cut),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size_class, block, size, doc_id) AS place FROM cells)
SELECT doc_id, size, n AS source_size, target, size * (floor(place * rate + u) - floor((place - 1) * rate + u))::BIGINT AS taken FROM placed
UNION ALL SELECT w.doc_id, w.size, p.n, p.target, w.size * w.copies FROM walk w JOIN plan p ON w.source IS NOT DISTINCT FROM p.source WHERE w.k > 0"""


#: Codebooks of two rounds as (part, entry, place, value) rows; a part is a list of four integers. SQL divides towards zero, hence the remainder.
_ROUND = """
near{i} AS (
  SELECT vec_id, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (
    SELECT x.vec_id, x.part, b.entry, list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
    FROM parts x JOIN book{i} b ON x.part = b.part) GROUP BY vec_id, part)"""
_BOOK = """
book{j} AS (
  SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM book{i} b LEFT JOIN (
    SELECT part, entry, list(((total - (((total % n) + n) % n)) / n)::BIGINT ORDER BY place) AS v FROM (
      SELECT part, entry, place, count(*) AS n, sum(value)::BIGINT AS total FROM (
        SELECT near{i}.part, near{i}.entry, unnest(range(1, len(v) + 1)) AS place, unnest(v) AS value FROM near{i} JOIN parts USING (vec_id, part))
      GROUP BY part, entry, place) GROUP BY part, entry) m ON m.part = b.part AND m.entry = b.entry)"""

OP12_SQL = f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
parts AS MATERIALIZED (SELECT vec_id, p AS part, v[p * len(v) // 16 + 1 : (p + 1) * len(v) // 16] AS v FROM kept, range(16) r(p)),
book0 AS (SELECT part, entry, v FROM parts JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept QUALIFY entry < 64) USING (vec_id)),
{_ROUND.format(i=0)},{_BOOK.format(i=0, j=1)},{_ROUND.format(i=1)},{_BOOK.format(i=1, j=2)},{_ROUND.format(i=2)},
coded AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM near2 GROUP BY vec_id),
labelled AS (SELECT vec_id, label, code, error FROM coded JOIN kept USING (vec_id))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) FROM book2) AS codebooks_sha256
FROM labelled"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit() and callable(v)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    return {"op7_chat_format": OP7_SQL, "op9_mixing": OP9_SQL, "op12_vector_codes": OP12_SQL}
