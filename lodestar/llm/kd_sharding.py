"""Sharding by a k-d tree over metadata of the text, cut at distributed weighted medians. DataFrame functions only.

Each text has five metadata dimensions: bytes, lines, words, characters a word, and the share of bytes beyond one a
character. Equal texts have equal coordinates, so no cut parts a group of copies. A node that still holds more than one shard is cut along its widest
dimension (its extent as a share of the root's) at the weighted quantile that gives each side the bytes of its shards,
until every leaf holds one shard's bytes. The quantile comes from histograms: each pass sums bytes by at most `bins`
bins of a node's interval and narrows the interval to the bin in which the quantile falls, so the driver sees at most
nodes x bins rows whatever the input's size. Ties in a dimension are told apart by 31 bits of the content hash.

Null text has size 1 and is a text of its own content (empty); an empty table gives an empty result; repeated rows are
placed one by one and stand in the same shard. Only the id and the text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, materialize, quoted

TIE = 1 << 31
DIMS = ("k_bytes", "k_lines", "k_words", "k_word_length", "k_wide")


class Node:
    def __init__(self, shards: int):
        self.shards, self.dim, self.cut, self.left, self.right = shards, None, None, None, None

    def leaves(self, condition: Column | None = None):
        """(node, condition of its rows) from left to right."""
        if self.dim is None:
            yield self, condition
            return
        for side, test in ((self.left, F.col(self.dim) <= F.lit(self.cut)), (self.right, F.col(self.dim) > F.lit(self.cut))):
            yield from side.leaves(test if condition is None else condition & test)


def number_of(leaves: list[tuple[Node, Column | None]], values: list[int]) -> Column:
    out = F.lit(None).cast("int")
    for (_, condition), v in reversed(list(zip(leaves, values, strict=True))):
        out = F.lit(v) if condition is None else F.when(condition, F.lit(v)).otherwise(out)
    return out


def coordinates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit(""))
    tie = F.pmod(F.xxhash64(text), F.lit(TIE))
    words = F.regexp_count(text, F.lit(WORD))
    scaled = lambda v: F.least(v.cast("long"), F.lit(TIE - 1)) * F.lit(TIE) + tie
    return docs.select(
        F.col(quoted(id_col)).alias("id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
        scaled(F.octet_length(text)).alias("k_bytes"),
        scaled(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))).alias("k_lines"),
        scaled(words).alias("k_words"),
        # Characters a word in thousandths; bytes beyond one a character, in millionths of all bytes.
        scaled(F.floor(F.length(text).cast("long") * 1000 / F.greatest(words, F.lit(1)))).alias("k_word_length"),
        scaled(F.floor((F.octet_length(text) - F.length(text)).cast("long") * 1_000_000 / F.greatest(F.octet_length(text), F.lit(1)))).alias("k_wide"),
    )


def grow(keys: DataFrame, n_shards: int, bins: int, tolerance: float) -> Node:
    """The tree; every pass is one aggregation for all open nodes of a level."""
    root = Node(n_shards)
    extent: dict[str, int] = {}
    while True:
        leaves = list(root.leaves())
        open_ = [i for i, (x, _) in enumerate(leaves) if x.shards > 1]
        if not open_:
            return root
        node = number_of(leaves, list(range(len(leaves)))).alias("node")
        stats = {
            r["node"]: r
            for r in keys.groupBy(node).agg(F.sum("size").alias("bytes"), *(f(d).alias(f"{n}_{d}") for d in DIMS for n, f in (("lo", F.min), ("hi", F.max)))).collect()
        }
        if not extent and 0 in stats:
            extent = {d: max(1, stats[0][f"hi_{d}"] - stats[0][f"lo_{d}"]) for d in DIMS}
        search: dict[int, list] = {}  # node: dimension, interval, bytes before it, wanted bytes
        for i in open_:
            x, s = leaves[i][0], stats.get(i)
            half = x.shards // 2
            x.left, x.right = Node(half), Node(x.shards - half)
            if s is None:
                x.dim, x.cut = DIMS[0], 0
                continue
            dim = max(DIMS, key=lambda d: (s[f"hi_{d}"] - s[f"lo_{d}"]) / extent[d])
            search[i] = [dim, s[f"lo_{dim}"], s[f"hi_{dim}"], 0, s["bytes"] * half / x.shards, s["bytes"]]
        while search:
            width = {i: (hi - lo) // bins + 1 for i, (_, lo, hi, *_) in search.items()}
            part, value = F.lit(None).cast("long"), F.lit(None).cast("long")
            for i, (dim, lo, hi, *_) in search.items():
                c = F.col(dim)
                here = c.between(lo, hi) if leaves[i][1] is None else leaves[i][1] & c.between(lo, hi)
                part = F.when(here, F.expr(f"({dim} - {lo}L) div {width[i]}L")).otherwise(part)
                value = F.when(here, c).otherwise(value)
            rows = (
                keys.select(number_of(leaves, list(range(len(leaves)))).alias("node"), part.alias("bin"), value.alias("v"), "size")
                .where(F.col("bin").isNotNull())
                .groupBy("node", "bin")
                .agg(F.sum("size").alias("bytes"), F.min("v").alias("lo"), F.max("v").alias("hi"))
                .collect()
            )
            found: dict[int, list] = {}
            for r in rows:
                found.setdefault(r["node"], []).append(r)
            for i in list(search):
                dim, lo, hi, before, want, whole = search[i]
                x = leaves[i][0]
                previous = lo - 1
                for r in sorted(found.get(i, []), key=lambda r: r["bin"]):
                    if before + r["bytes"] >= want:
                        break
                    before, previous = before + r["bytes"], r["hi"]
                if r["lo"] == r["hi"] or r["bytes"] <= tolerance * whole:
                    # The nearer of the boundaries before and after the bin.
                    x.dim, x.cut = dim, previous if want - before < before + r["bytes"] - want else r["hi"]
                    del search[i]
                else:
                    search[i] = [dim, r["lo"], r["hi"], before, want, whole]


def kd_shards(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text", bins: int = 4096, tolerance: float = 0.0002, rows_per_block: int = 50_000) -> DataFrame:
    """doc id, size, text_crc32, shard and slot (gapless from 0 within the shard) of every row.

    Slots are numbered within (shard, hash block) and shifted by the rows of the blocks before, so that no task sees a
    whole shard.
    """
    keys = materialize(coordinates(docs, id_col, text_col), "kd-keys")
    tree = grow(keys, n_shards, bins, tolerance)
    leaves = list(tree.leaves())
    blocks = max(64, keys.count() // rows_per_block)
    placed = keys.select("id", "size", "crc", number_of(leaves, list(range(len(leaves)))).alias("shard"), F.pmod(F.xxhash64("id", "crc"), F.lit(blocks)).alias("block"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "block").agg(F.count("*").alias("rows")).select("shard", "block", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    rank = F.row_number().over(Window.partitionBy("shard", "block").orderBy("id", "crc"))
    return (
        placed.withColumn("rank", rank)
        .join(starts, ["shard", "block"])
        .select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("start") + F.col("rank") - 1).alias("slot"))
    )
