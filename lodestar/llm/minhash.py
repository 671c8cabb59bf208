"""Near-duplicates by BagMinHash over multisets of word shingles.

Signatures. Each distinct shingle carries its number of occurrences as an integer weight. The weight axis is cut into
dyadic intervals (0,1], (1,2], (2,4], ...; each (shingle, interval) has its own Poisson process, driven by hashes, of rate
slots x interval length. A point has a time, a slot and a level in its interval and counts only if the level is within
the weight; so the points of a smaller weight are among those of a larger one, and the least time in a slot belongs to
the same point in two documents with a probability that is their weighted Jaccard similarity. Processes are followed
only as far as the slots of a document can still change: about slots x (ln slots + 3) points in all, however long it is.

Bands of the signature make candidates; every link is verified by exact multiset Jaccard similarity of whole texts.

Words are named by XXH3 of their bytes. Documents of equal multisets are one node from the start: those of equal fingerprints, two sums of 64 bits
over shingles that come from two independent hashes of the words. Two unlike documents agree in both with a probability of about 2**-128, two
unlike words in a comparison with 2**-64. In each band bucket the members are compared with the bucket's
least node, so a group of n near copies costs n comparisons and not n x n. Buckets that still hold several components
after that are searched for the links between them, in tiles of bounded size: no pair is a row, and no link between
components is lost. Counts are pre-aggregated, and large groups are verified in salted parts, each with the leader.

A document of fewer words than a shingle has one shingle of all its words; a document without words (null, empty or
blank) links with nothing, as does a row without an id. Ids name documents: rows that share one are one node.
An empty table gives an empty result. Other columns are not read, and pass through in `drop_near_duplicates`. A worker's memory
follows the longest text (about twenty bytes for each of its bytes), as its shingles are sorted together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import bytetext as B
from .common import drop, materialize, quoted, small_batches, tidy, unused
from .components import connected

SLICE = 1 << 19
U = np.uint64


def shingles(hashes: np.ndarray, doc: np.ndarray, n_docs: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, shingle) of each run of width words, from the words' hashes; of fewer words all of them are one shingle."""
    shingle, at = B.window_hashes(hashes, doc, width)
    owner = doc[at]
    n_words = np.bincount(doc, minlength=n_docs)
    for i in np.flatnonzero((n_words > 0) & (n_words < width)):
        first = np.searchsorted(doc, i)
        x = np.array([n_words[i]], U)
        for k in range(first, first + n_words[i]):
            x = B.mix(x * U(0x9E3779B97F4A7C15) + hashes[k : k + 1])
        shingle, owner = np.append(shingle, x), np.append(owner, i)
    return owner, shingle


def bags(data: np.ndarray, off: np.ndarray, width: int, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, weight) of each distinct shingle of each document, by document and then shingle; hashes of its words, if known."""
    hashes = B.word_hashes(data, off)[0] if hashes is None else hashes
    owner, shingle = shingles(hashes, B.words(data, off)[2], len(off) - 1, width)
    order = np.lexsort((shingle, owner))
    shingle, owner = shingle[order], owner[order]
    new = np.ones(len(shingle), bool)
    new[1:] = (shingle[1:] != shingle[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    return owner[first], shingle[first], np.diff(np.append(first, len(shingle)))


def signatures(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int, slots: int) -> np.ndarray:
    """n x slots signature values; rows of documents without shingles are 0."""
    total = np.bincount(doc, weight, n)
    best, sign = np.full(n * slots, np.inf), np.zeros(n * slots, U)
    limit = np.where(total > 0, (np.log(slots) + 3) / np.maximum(total, 1), 0)
    todo = total > 0
    while todo.any():
        use = np.flatnonzero(todo[doc])
        lower = 0
        while len(use):
            length = max(lower, 1)
            seed = B.mix(shingle[use] + U((lower + 1) * 0xD1B54A32D192ED03 % 2**64))
            owner, heavy, until = doc[use], weight[use], limit[doc[use]]
            time, k = np.zeros(len(use)), 0
            while len(seed):
                k += 1
                a = B.mix(seed + U(2 * k * 0x9E3779B97F4A7C15 % 2**64))
                b = B.mix(a + U(0x632BE59BD9B4E019))
                time = time - np.log1p(-((a >> U(11)).astype(np.float64) * 2.0**-53)) / (slots * length)
                live = time <= until
                seed, owner, heavy, until, time, b = seed[live], owner[live], heavy[live], until[live], time[live], b[live]
                level = lower + 1 + ((b >> U(40)).astype(np.int64) * length >> 24)
                hit = level <= heavy
                at = owner[hit] * slots + (b[hit] & U(0xFFFFFFFF)).astype(np.int64) % slots
                np.minimum.at(best, at, time[hit])
                won = time[hit] == best[at]
                sign[at[won]] = b[hit][won]
            lower = max(2 * lower, 1)
            use = use[weight[use] > lower]
        full = np.isfinite(best.reshape(n, slots)).all(1)
        todo &= ~full
        limit = limit * 2
    return sign.reshape(n, slots)


def sketch(column: pa.Array, width: int, bands: int, rows: int) -> dict[str, np.ndarray]:
    """Multiset fingerprint (two numbers, from two independent hashes of words), total weight and band keys of each text."""
    data, off = B.column_bytes(column)
    out: dict[str, list] = {"fp1": [], "fp2": [], "weight": [], "keys": []}
    for a, b in B.slices(off, SLICE):
        part, at = np.ascontiguousarray(data[off[a] : off[b]]), off[a : b + 1] - off[a]
        n = b - a
        first, second = B.word_hashes(part, at)
        doc, shingle, weight = bags(part, at, width, first)
        owner, other = shingles(second, B.words(part, at)[2], n, width)
        order = np.argsort(owner, kind="stable")
        for name, whose, values in (("fp1", doc, B.mix(B.mix(shingle) + weight.astype(U) * U(0x8CB92BA72F3D8DD7))), ("fp2", owner[order], B.mix(other[order] ^ U(0xAEF17502108EF2D9)))):
            each = np.concatenate([np.zeros(1, U), np.cumsum(values, dtype=U)])
            cut = np.searchsorted(whose, np.arange(n + 1))
            out[name].append((each[cut[1:]] - each[cut[:-1]]).view(np.int64))
        out["weight"].append(np.bincount(doc, weight, n).astype(np.int64))
        sign = signatures(doc, shingle, weight, n, bands * rows).reshape(n, bands, rows)
        key = np.broadcast_to(np.arange(1, bands + 1, dtype=U), (n, bands)).copy()
        for r in range(rows):
            key = B.mix(key * U(0x9E3779B97F4A7C15) + sign[:, :, r])
        out["keys"].append(key.view(np.int64))
    return {k: np.concatenate(v) if v else np.zeros((0, bands) if k == "keys" else 0, np.int64) for k, v in out.items()}


def sketches(docs: DataFrame, width: int, bands: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    text = F.col(quoted(text_col)).cast("string")
    source = small_batches(docs).select(F.col(quoted(id_col)).cast("long").alias("id"), F.xxhash64(text).alias("text_key"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = sketch(batch.column(2), width, bands, rows)
            keys = pa.ListArray.from_arrays(pa.array(np.arange(0, got["keys"].size + 1, bands), pa.int32()), pa.array(got["keys"].ravel(), pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(got[k], pa.int64()) for k in ("fp1", "fp2", "weight")), keys], ["id", "text_key", "fp1", "fp2", "weight", "keys"])

    return source.mapInArrow(tidy(run), "id long, text_key long, fp1 long, fp2 long, weight long, keys array<long>")


def verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, width: int, threshold: float, part: int, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) whose multiset Jaccard similarity reaches the threshold; a's text meets its b's in salted parts."""
    sizes = pairs.groupBy("a").agg(F.count("*").alias("n")).select("a", F.ceil(F.col("n") / part).cast("int").alias("parts"))
    member = pairs.join(sizes, "a").select(F.col("b").alias("node"), F.col("a").alias("leader"), F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("salt"), F.lit(1).alias("role"))
    leads = sizes.select(F.col("a").alias("node"), F.col("a").alias("leader"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.lit(0).alias("role"))
    wanted = member.unionByName(leads).join(nodes.select(F.col("id").alias("node"), "text_key"), "node")
    text = F.col(quoted(text_col)).cast("string")
    texts = docs.select(F.col(quoted(id_col)).cast("long").alias("node"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    texts = texts.join(wanted.select("node", "text_key").distinct(), ["node", "text_key"], "left_semi").groupBy("node", "text_key").agg(F.first("text").alias("text"))
    met = wanted.join(texts, ["node", "text_key"]).select("leader", "salt", "role", "node", "text")
    met = met.repartition("leader", "salt").sortWithinPartitions("leader", "salt", "role", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, lead = None, None
        for batch in batches:
            leader, role, node = (np.asarray(batch.column(c)) for c in (0, 2, 3))
            data, off = B.column_bytes(batch.column(4))
            found = []
            for a, b in B.slices(off, SLICE):
                doc, shingle, weight = bags(np.ascontiguousarray(data[off[a] : off[b]]), off[a : b + 1] - off[a], width)
                at = np.searchsorted(doc, np.arange(b - a + 1))
                for i in range(b - a):
                    s, w = shingle[at[i] : at[i + 1]], weight[at[i] : at[i + 1]]
                    if role[a + i] == 0:
                        now, lead = leader[a + i], (s, w, w.sum())
                    elif now == leader[a + i] and len(s) and len(lead[0]):
                        k = np.minimum(np.searchsorted(lead[0], s), len(lead[0]) - 1)
                        shared = np.minimum(w, lead[1][k])[lead[0][k] == s].sum()
                        if shared >= threshold * (lead[2] + w.sum() - shared):
                            found.append((now, node[a + i]))
            x, y = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])

    return met.mapInArrow(tidy(run), "a long, b long")


def across(docs: DataFrame, nodes: DataFrame, members: DataFrame, width: int, threshold: float, tile: int, id_col: str, text_col: str) -> DataFrame:
    """Links (a, b) between the components of each bucket; members: key, id, n (members of the bucket), root, visits.

    Visitors, all but the members of the bucket's largest component, meet all members in tiles of about tile residents and
    2 x tile visitors. An inverted index over a tile's residents gives a visitor's exact intersections with all of them;
    a tile returns a spanning forest of the components that it links.
    """
    text = F.col(quoted(text_col)).cast("string")
    wanted = members.select("id").distinct().join(nodes.select("id", "text_key"), "id")
    texts = docs.select(F.col(quoted(id_col)).cast("long").alias("id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    texts = texts.join(wanted, ["id", "text_key"], "left_semi").groupBy("id").agg(F.first("text").alias("text"))
    sized = members.withColumns({"parts": F.ceil(F.col("n") / tile).cast("int"), "guests": F.ceil(F.col("n") / (2 * tile)).cast("int")})
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(n)).cast("int")
    residents = sized.select("key", "id", "root", F.lit(False).alias("visitor"), mine("parts", 1).alias("part"), spread("guests").alias("guest"))
    visitors = sized.where("visits").select("key", "id", "root", F.lit(True).alias("visitor"), mine("guests", 2).alias("guest"), spread("parts").alias("part"))
    met = residents.unionByName(visitors).join(texts, "id").select("key", "part", "guest", "visitor", "id", "root", "text")
    met = met.repartition("key", "part", "guest").sortWithinPartitions("key", "part", "guest", "visitor", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, index, up = None, None, {}
        held: list[tuple] = []  # residents until the first visitor: id, root, shingles, weights
        for batch in batches:
            key, part, guest, visitor, ids, roots = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
            data, off = B.column_bytes(batch.column(6))
            found: list[tuple[int, int]] = []
            for a, b in B.slices(off, SLICE):
                doc, shingle, weight = bags(np.ascontiguousarray(data[off[a] : off[b]]), off[a : b + 1] - off[a], width)
                at = np.searchsorted(doc, np.arange(b - a + 1))
                for i in range(a, b):
                    if now != (key[i], part[i], guest[i]):
                        now, index, up, held = (key[i], part[i], guest[i]), None, {}, []
                    s, w = shingle[at[i - a] : at[i - a + 1]], weight[at[i - a] : at[i - a + 1]]
                    if not visitor[i]:
                        held.append((ids[i], roots[i], s, w))
                    elif held:
                        index = index or TileIndex(held)
                        found += index.links(ids[i], roots[i], s, w, threshold, up)
            x, y = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])

    return met.mapInArrow(tidy(run), "a long, b long")


class TileIndex:
    """Postings of some documents' shingles."""

    def __init__(self, held: list[tuple]):
        self.ids, self.roots = np.array([h[0] for h in held]), np.array([h[1] for h in held])
        self.totals = np.array([h[3].sum() for h in held])
        shingle, weight = np.concatenate([h[2] for h in held]), np.concatenate([h[3] for h in held])
        owner = np.repeat(np.arange(len(held)), [len(h[2]) for h in held])
        order = np.argsort(shingle, kind="stable")
        self.shingle, self.weight, self.owner = shingle[order], weight[order], owner[order]

    def links(self, id_: int, root: int, shingle: np.ndarray, weight: np.ndarray, threshold: float, up: dict[int, int]) -> list[tuple[int, int]]:
        """Links of one document to residents of other components that up, a forest over roots, doesn't join yet."""
        lo, hi = np.searchsorted(self.shingle, shingle), np.searchsorted(self.shingle, shingle, "right")
        n = hi - lo
        at = np.arange(int(n.sum())) + np.repeat(lo - np.cumsum(n) + n, n)
        shared = np.bincount(self.owner[at], np.minimum(self.weight[at], np.repeat(weight, n)), len(self.ids))
        near = np.flatnonzero((shared >= threshold * (self.totals + weight.sum() - shared)) & (self.roots != root))
        out = []
        for k in near.tolist():
            x, y = int(root), int(self.roots[k])
            while x in up:
                x = up[x]
            while y in up:
                y = up[y]
            if x != y:
                up[max(x, y)] = min(x, y)
                out.append((int(id_), int(self.ids[k])))
        return out


def near_duplicates(docs: DataFrame, width: int = 5, threshold: float = 0.8, bands: int = 32, rows: int = 5, part: int = 128, tile: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text_key, class_id (the least id of its class) of every row; classes are components of verified links."""
    sketched = materialize(sketches(docs, width, bands, rows, id_col, text_col), "sketches")
    named = sketched.where("id IS NOT NULL AND weight > 0")
    same = named.groupBy("fp1", "fp2").agg(F.min(F.struct("id", "text_key", "weight", "keys")).alias("m"))
    nodes = materialize(same.select("fp1", "fp2", "m.*"), "nodes")
    placed = nodes.select("id", "weight", F.explode("keys").alias("key"))
    buckets = materialize(placed.groupBy("key").agg(F.min("id").alias("leader"), F.count("*").alias("n")).where("n > 1"), "buckets")
    placed = materialize(placed.join(buckets, "key"), "placed")
    # A pair can link only if the lighter document has the threshold's share of the heavier one's weight.
    heavy = nodes.select(F.col("id").alias("leader"), F.col("weight").alias("leader_weight"))
    near = F.least("weight", "leader_weight") >= threshold * F.greatest("weight", "leader_weight")
    stars = placed.where("id <> leader").select("id", "weight", "leader").distinct().join(heavy, "leader").where(near)
    tried = materialize(stars.select(F.col("leader").alias("a"), F.col("id").alias("b")), "stars")
    links = materialize(verified(docs, nodes, tried, width, threshold, part, id_col, text_col), "links")
    roots = connected(links)
    # Buckets that still hold several components: all pairs across components are compared, in tiles.
    rooted = placed.join(roots.withColumnRenamed("node", "id"), "id", "left").select("key", "id", "n", F.coalesce("root", "id").alias("root"))
    mixed = rooted.groupBy("key", "root").agg(F.count("*").alias("c")).groupBy("key").agg(F.count("*").alias("roots"), F.max_by("root", F.struct("c", "root")).alias("most")).where("roots > 1")
    open_ = materialize(rooted.join(mixed, "key").select("key", "id", "n", "root", (F.col("root") != F.col("most")).alias("visits")), "open")
    more = materialize(across(docs, nodes, open_, width, threshold, tile, id_col, text_col), "across")
    roots = connected(links.unionByName(more))
    drop(docs.sparkSession, buckets, placed, tried, open_)
    known = nodes.join(roots, nodes["id"] == roots["node"], "left").select("fp1", "fp2", F.coalesce("root", "id").alias("class_id"))
    out = sketched.select("id", "text_key", F.when(F.expr("id IS NOT NULL AND weight > 0"), F.col("fp1")).alias("fp1"), "fp2")
    return out.join(known, ["fp1", "fp2"], "left").select(F.col("id").alias(id_col), "text_key", F.coalesce("class_id", "id").alias("class_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The input rows without those whose class has a smaller id; of rows that agree in id and text one stays."""
    id_, text, number = unused(docs, "id", "text", "number")
    kept = near_duplicates(docs, id_col=id_col, text_col=text_col, **options).where(F.col(quoted(id_col)).isNull() | (F.col(quoted(id_col)) == F.col("class_id")))
    kept = kept.select(F.col(quoted(id_col)).alias(id_), F.col("text_key").alias(text)).distinct()
    rows = docs.withColumns({id_: F.col(quoted(id_col)).cast("long"), text: F.xxhash64(F.col(quoted(text_col)).cast("string"))})
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"k.{c}")) for c in (id_, text)]
    order = F.row_number().over(Window.partitionBy(f"r.{id_}", f"r.{text}").orderBy(F.lit(0)))
    stay = rows.alias("r").join(kept.alias("k"), same, "left_semi").withColumn(number, order)
    return stay.where((F.col(number) == 1) | F.col(id_).isNull()).select(*(F.col(quoted(c)) for c in docs.columns))
