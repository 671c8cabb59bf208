"""Removal of repeated passages by per-shard suffix arrays.

Every byte covered by a string of `length` bytes that also starts anywhere else (in any document, or the same one) is removed;
strings are judged on the input. Texts are UTF-8 bytes; matches never cross documents.

Which bytes meet in a shard. In each window of `length` bytes the k-gram of least hash is an anchor (the leftmost, if tied);
equal windows have the same anchor at the same offset, so windows can only be equal if their anchors are. Anchors that
occur once are dropped after one pre-aggregated count. Around each other anchor lies a context: all windows that hold it.
Equal contexts of an anchor (by the xxh3 hash of their bytes) stand for one another. One context of each kind is cut into slices of
neighbouring windows, and slices that have the bytes common to all their windows with another slice go into shards, by anchor
and these bytes. Anchors only route: what is repeated is decided by the bytes.

In a shard, windows are sorted by Larsson-Sadakane refinement of their bytes: groups of equal rank are sorted again by the rank h
bytes on, h doubling and groups of one left alone, up to `length` bytes; each round ranks only the positions that later rounds
ask for. Kasai's common prefixes (all slices in step, eight bytes at a time) give the runs of equal windows. Shards are merged
by binary search: the runs of one are sought in the suffix array of the other. A class with more than `group_cap` kinds of slice
is dealt again by smaller slices; if it is still too large then, it is dealt over several shards in several tasks, whose
sorted runs are cut at common bounds (a range partitioning) and merged there.

Equal texts are one text with a number of copies: with two or more copies, each window is repeated. Null text is empty;
texts shorter than `length` keep all bytes; repeated rows are copies of one another (even with one id); an empty table
gives an empty result. Long texts are read in overlapping pieces of SLICE bytes. Other columns pass through in `remove_repeats`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytetext as B
from .common import drop, materialize, quoted, small_batches, tidy, unused

SLICE = 1 << 19
SHARD = 1 << 20
#: An anchor with this share of all rows is frequent.
HOT_ANCHORS = 4096
U = np.uint64


class Hasher:
    """Hashes of any data[start:end] by prefix sums of a polynomial modulo 2**64."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.total = np.zeros(n + 1, U)
        np.cumsum(B.BYTE_CODE[data] * B.powers(n, B.BASE, "up"), out=self.total[1:])
        self.back = B.powers(n + 1, B.INVERSE, "down")

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return B.mix((self.total[ends] - self.total[starts]) * self.back[starts] + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))

    def grams(self, k: int) -> np.ndarray:
        return B.mix((self.total[k:] - self.total[:-k]) * self.back[: len(self.total) - k])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours: minima from both ends of blocks of w."""
    n = len(x)
    padded = np.full(-(-n // w) * w, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    grid = padded.reshape(-1, w)
    front = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], front[w - 1 : n])


def anchor_positions(data: np.ndarray, off: np.ndarray, hasher: Hasher, length: int, k: int) -> np.ndarray:
    """Positions of all anchors in a slice of documents, ascending."""
    n, w = len(data), length - k + 1
    if n < length:
        return np.zeros(0, np.int64)
    bits = max(20, int(n).bit_length())
    grams = hasher.grams(k)
    grams >>= U(bits)
    grams <<= U(bits)
    grams |= np.arange(len(grams), dtype=U)
    least = sliding_min(grams, w)
    inside = np.zeros(len(least) + 1, np.int64)
    size = np.diff(off)
    for_windows = size >= length
    first, last = off[:-1][for_windows], off[1:][for_windows] - length + 1
    np.add.at(inside, first, 1)
    np.add.at(inside, np.minimum(last, len(least)), -1)
    valid = least[np.cumsum(inside[:-1]) > 0]
    if not len(valid):
        return np.zeros(0, np.int64)
    changed = np.ones(len(valid), bool)
    changed[1:] = valid[1:] != valid[:-1]
    return np.unique(valid[changed] & U((1 << bits) - 1)).astype(np.int64)


def merge_intervals(owner: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of the union of [lo, hi) for each owner."""
    if not len(owner):
        return owner, lo, hi
    order = np.lexsort((lo, owner))
    owner, lo, hi = owner[order], lo[order], hi[order]
    room = int(hi.max()) + 1
    reach = np.maximum.accumulate(hi + owner.astype(np.int64) * room)  # an owner's ends lie beyond those before
    new = np.ones(len(lo), bool)
    new[1:] = lo[1:] + owner[1:].astype(np.int64) * room > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(lo)) - 1
    return owner[first], lo[first], reach[last] - owner[first].astype(np.int64) * room


def byte_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """xxh3 of the bytes of each data[start:end]."""
    raw, digest = memoryview(data), xxhash.xxh3_64_intdigest
    return np.fromiter((digest(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), U, len(starts))


def anchors(data: np.ndarray, off: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """(document, lo, hi, anchor hash, context hash, count, bytes before the anchor) for each kind of context in each document, then spans of the
    further occurrences of a kind in one document with count 0: these are repeated whatever other documents hold.

    A document of more than SLICE bytes is read in pieces; an anchor that two pieces choose counts in the first.
    """
    found: list[tuple[np.ndarray, np.ndarray]] = []  # position, hash of the anchor
    for a, b in B.slices(off, SLICE):
        begin, end = int(off[a]), int(off[b])
        before = np.zeros(0, np.int64)
        for s in range(begin, end, SLICE) if b - a == 1 else (begin,):
            z = min(end, s + SLICE + length - 1) if b - a == 1 else end
            hasher = Hasher(np.ascontiguousarray(data[s:z]))
            inner = np.array([0, z - s]) if b - a == 1 else off[a : b + 1] - begin
            at = anchor_positions(data[s:z], inner, hasher, length, k)
            fresh = at[~np.isin(at + s, before)]
            before = at + s
            found.append((fresh + s, hasher.spans(fresh, fresh + k)))
    at, h = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, U))
    doc = np.searchsorted(off, at, "right") - 1
    lo, hi = np.maximum(off[doc], at - (length - k)), np.minimum(off[doc + 1], at + length)
    c = B.mix(byte_hashes(data, lo, hi) + (at - lo).astype(U) * U(0x9FB21C651E98DF25))
    order = np.lexsort((at, c, h, doc))
    doc, lo, hi, h, c = doc[order], lo[order] - off[doc[order]], hi[order] - off[doc[order]], h[order], c[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1]) | (c[1:] != c[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(doc)))
    d, a, z = merge_intervals(doc[~new], lo[~new], hi[~new])
    none = np.zeros(len(d), U)
    left = (at[order] - off[doc] - lo)[first]
    return (*(np.concatenate(x) for x in ((doc[first], d), (lo[first], a), (hi[first], z), (h[first], none), (c[first], none))), np.concatenate([count, np.zeros(len(d), np.int64)]), np.concatenate([left, np.zeros(len(d), np.int64)]))


class Shard:
    """Suffix array of the windows of `length` bytes in some slices of text, and its runs of equal windows.

    Windows whose bytes are equal stand in the order of their slices.
    """

    def __init__(self, data: np.ndarray, off: np.ndarray, origin: np.ndarray, length: int):
        """origin: a number for each slice's first byte; windows at one place of one text have one origin."""
        self.length, self.off = length, off
        n, size = len(data), np.diff(off)
        self.left = np.repeat(off[1:], size) - np.arange(n)  # bytes from each position to its slice's end
        padded = np.full(n + 8, 0xFF, np.uint8)
        padded[:n] = data
        self.word = np.zeros(n, U)  # eight bytes, big-endian, from each position on
        for k in range(8):
            self.word = (self.word << U(8)) | padded[k : k + n]
        self.sa = self.refine(n)
        lcp = self.kasai()
        self.context = np.searchsorted(off, self.sa, "right") - 1
        self.origin = origin[self.context] + (self.sa - off[:-1][self.context]).astype(U)
        new = lcp < length
        new[:1] = True
        self.run, self.of = np.flatnonzero(new), np.cumsum(new) - 1
        self.low = np.minimum.reduceat(self.origin, self.run) if len(self.run) else self.origin
        self.high = np.maximum.reduceat(self.origin, self.run) if len(self.run) else self.origin
        self.repeated = self.low != self.high

    def refine(self, n: int) -> np.ndarray:
        """All windows in order; each round sorts the groups that are still equal by the rank h bytes on.

        A window's first 2h bytes are its first h and the h after them (in the last round, which may overlap, the last h), so a round
        needs ranks only where the windows and the later rounds look.
        """
        steps, h = [], 8
        while h < self.length:
            steps.append(min(h, self.length - h))
            h *= 2
        wanted = [self.left >= self.length]
        for step in reversed(steps):
            shifted = np.zeros(n, bool)
            shifted[step:] = wanted[-1][: n - step]
            wanted.append(wanted[-1] | shifted)
        full = np.flatnonzero(wanted.pop())
        full = full[np.argsort(self.word[full])]
        key = self.word[full]
        rank = np.zeros(n, np.int64)
        for step in [*steps, None]:
            # Members of a group stand together and share the place of the first as their rank; unwanted positions leave.
            new = np.append(True, key[1:] != key[:-1])[: len(full)]
            rank[full] = np.maximum.accumulate(np.where(new, np.arange(len(full)), 0))
            if step is None:
                break
            full = full[wanted.pop()[full]]
            key = rank[full] << 32
            open_ = np.append(key[1:] == key[:-1], False)[: len(full)]
            open_[1:] |= open_[:-1]
            at = np.flatnonzero(open_)
            key[at] |= rank[full[at] + step]
            by = np.argsort(key[at])
            full[at], key[at] = full[at][by], key[at][by]
        start = np.flatnonzero(new)
        group = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(full))))
        return full[np.argsort(group << 32 | full)]

    def kasai(self) -> np.ndarray:
        """Common prefix, up to `length`, of each window and the one before it in the array; all slices go in step, eight bytes at a time.

        If window i shares h bytes with the one before it, p, then i + 1 shares h - 1 with the one before it, as long as p + 1
        is a window that stands before i + 1; else its prefix is counted anew.
        """
        word, n, length = self.word, len(self.sa), self.length
        lcp, place = np.zeros(n, np.int64), np.full(len(word) + 1, -1)
        place[self.sa] = np.arange(n)
        base, windows = self.off[:-1], np.diff(self.off) - length + 1
        h, prior = np.zeros(len(base), np.int64), np.full(len(base), len(word))
        for j in range(int(windows.max()) if len(windows) else 0):
            lanes = np.flatnonzero(windows > j)
            i = base[lanes] + j
            at = place[i]
            follows = place[prior[lanes]]
            before = self.sa[at - 1]
            got = np.where((follows >= 0) & (follows < at), np.maximum(h[lanes] - 1, 0), 0)
            live = np.flatnonzero(at > 0)
            got[at == 0] = 0
            while len(live):
                x = word[i[live] + got[live]] ^ word[before[live] + got[live]]
                same = x == 0
                got[live] += np.where(same, 8, (x < U(1) << U(56)).astype(np.int64) + (x < U(1) << U(48)) + (x < U(1) << U(40)) + (x < U(1) << U(32)) + (x < U(1) << U(24)) + (x < U(1) << U(16)) + (x < U(1) << U(8)))
                live = live[same & (got[live] < length)]
            got = np.minimum(got, length)
            h[lanes] = got
            prior[lanes] = np.where(at > 0, before + 1, len(word))
            lcp[at] = got
        return lcp

    def merge(self, other: Shard) -> None:
        """Mark the runs that both shards hold: one window of each of other's runs is sought here by binary search."""
        if not len(self.sa) or not len(other.sa):
            return
        sought = other.sa[other.run]
        lo, hi = np.zeros(len(sought), np.int64), np.full(len(sought), len(self.run))
        while (lo < hi).any():
            mid = np.minimum((lo + hi) // 2, len(self.run) - 1)
            order = self.compare(self.sa[self.run[mid]], other, sought)
            open_ = lo < hi
            lo = np.where(open_ & (order < 0), mid + 1, lo)
            hi = np.where(open_ & (order >= 0), mid, hi)
        there = np.flatnonzero(lo < len(self.run))
        there = there[self.compare(self.sa[self.run[lo[there]]], other, sought[there]) == 0]
        mine = lo[there]
        apart = (self.low[mine] != other.low[there]) | self.repeated[mine] | other.repeated[there]
        other.repeated[there[apart]] = True
        self.repeated[mine[apart]] = True

    def compare(self, mine: np.ndarray, other: Shard, theirs: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 for windows of this shard against windows of another."""
        out, live = np.zeros(len(mine), np.int64), np.arange(len(mine))
        for k in range(0, self.length, 8):
            step = min(k, self.length - 8)
            a, b = self.word[mine[live] + step], other.word[theirs[live] + step]
            out[live] = np.where(a < b, -1, np.where(a > b, 1, 0))
            live = live[a == b]
            if not len(live):
                break
        return out

    def spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(context, start, end) of repeated bytes, within each context."""
        hit = self.repeated[self.of]
        start = self.sa[hit] - self.off[:-1][self.context[hit]]
        return merge_intervals(self.context[hit], start, start + self.length)


def sorted_shards(data: np.ndarray, off: np.ndarray, origin: np.ndarray, length: int, shard: int = SHARD) -> list[tuple[int, Shard]]:
    """(first slice, shard) of slices that are compared with one another, merged."""
    made: list[tuple[int, Shard]] = []
    for a, b in B.slices(off, shard):
        now = Shard(data[off[a] : off[b]], off[a : b + 1] - off[a], origin[a:b], length)
        for _, s in made:
            s.merge(now)
        made.append((a, now))
    # A run found late in a merge counts for the shards merged before: pairs are marked both ways, so all are whole now.
    return made


def lot_spans(data: np.ndarray, off: np.ndarray, origin: np.ndarray, length: int, shard: int = SHARD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slice, start, end) of repeated bytes in slices that are compared with one another."""
    found = [(c + a, s, e) for a, sh in sorted_shards(data, off, origin, length, shard) for c, s, e in [sh.spans()]]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3


ITEM = "h long, c long, place long, lo long, left long, at long, first long, last long, bytes binary"


def classes(length: int, step: int):
    """mapInArrow over ITEM rows: each item's windows by classes of `step` offsets of the anchor.

    A class has a core, the bytes that all of its windows hold, and a slice, the bytes of its windows together. g names anchor,
    offsets and core; k the slice; s, e are the slice's place in the context, f and l its offsets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = B.column_bytes(batch.column(8))
            h, c, left, at, first, last = (np.asarray(batch.column(i)) for i in (0, 1, 4, 5, 6, 7))
            for a, b in B.slices(off, SLICE):
                base = off[a:b] - off[a]
                size = np.diff(off[a : b + 1])
                piece = data[off[a] : off[b]]
                out: list[tuple[np.ndarray, ...]] = []
                for j in range(0, int((last[a:b] - first[a:b]).max()) + 1, step):
                    # Offsets f to l, from each item's own first on; windows begin at left - offset, if the context has them whole.
                    f = first[a:b] + j
                    l = np.minimum(f + step - 1, last[a:b])
                    lo, hi = np.maximum(left[a:b] - l, 0), np.minimum(left[a:b] - f, size - length)
                    row = np.flatnonzero((lo <= hi) & (f <= last[a:b]))
                    lo, hi, f, l = lo[row], hi[row], f[row], l[row]
                    core = byte_hashes(piece, base[row] + left[a:b][row] - f, base[row] + left[a:b][row] - l + length)
                    g = B.mix(B.mix(h[a:b][row].view(U) + f.astype(U) * U(4096) + U(step)) + core)
                    k = B.mix(byte_hashes(piece, base[row] + lo, base[row] + hi + length) + (left[a:b][row] - f - lo).astype(U) * U(0x9FB21C651E98DF25))
                    out.append((row + a, g.view(np.int64), k.view(np.int64), lo, hi + length, f, l))
                row, g, k, lo, hi, f, l = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h[row], c[row], g, k, at[row] + lo, at[row] + hi, f, l)], ["h", "c", "g", "k", "s", "e", "f", "l"])

    return run


def settle(items: DataFrame, length: int, cap: int, steps: list[int]) -> DataFrame:
    """(h, c, s, e): repeated bytes of each context, from ITEM rows of anchors with several kinds of context.

    Windows are dealt by class. Equal slices of a class settle each other; slices of one core but unlike are compared in shards,
    at most `cap` kinds of slice of a class in each. Larger classes are dealt again by the next, smaller step, and at the last
    step over several shards, whose runs are merged.
    """
    spark = items.sparkSession
    dealt = materialize(items.mapInArrow(tidy(classes(length, steps[0])), "h long, c long, g long, k long, s long, e long, f long, l long"), "classes")
    kinds = dealt.groupBy("g", "k").agg(F.count("*").alias("n"), F.min(F.struct("h", "c", "s", "e", "f", "l")).alias("one"))
    kinds = materialize(kinds, "slices")
    several = kinds.groupBy("g").agg(F.count("*").alias("kinds")).where("kinds > 1")
    whole = dealt.join(kinds.where("n > 1").select("g", "k"), ["g", "k"]).select("h", "c", "s", "e")
    several = materialize(kinds.join(several, "g").select("g", "k", "kinds", "one.*"), "unlike")
    piece = F.expr("substring(bytes, cast(s - at + 1 as int), cast(e - s as int))").alias("bytes")
    final = len(steps) == 1
    # Where the core begins in the slice, and how many bytes of a window lie around it.
    core = [(F.col("left") - F.col("f") - F.col("s") + F.col("at")).cast("int").alias("core"), (F.col("l") - F.col("f")).cast("int").alias("around")]
    part = F.when(F.col("kinds") > cap, F.pmod(F.xxhash64("k"), F.ceil(F.col("kinds") / cap)).cast("int"))
    now = several if final else several.where(F.col("kinds") <= cap)
    sized = now.withColumn("part", part).join(items, ["h", "c"]).where("f >= first AND l <= last")
    lots = sized.select("g", "part", "k", "place", (F.col("lo") + F.col("s") - F.col("at")).alias("lo"), *core, piece).repartition("g", "part").sortWithinPartitions("g", "part")
    found = materialize(lots.mapInArrow(tidy(sort_lots(length)), FOUND), "sorted")
    hit = found.where("run IS NULL").select("g", "k", "x", "y")
    if final:
        # Runs of classes that are dealt over several shards meet at common bounds; what is repeated goes back to the windows.
        met = found.where("k IS NULL").select("g", "run", "low", "high").repartitionByRange("g", "run").sortWithinPartitions("g", "run")
        shared = met.mapInArrow(tidy(merge_runs), "g long, run long")
        again = found.where("k IS NOT NULL AND run IS NOT NULL").join(shared, ["g", "run"])
        hit = hit.unionByName(again.select("g", "k", "x", "y"))
    out = whole.unionByName(dealt.join(hit, ["g", "k"]).select("h", "c", (F.col("s") + F.col("x")).alias("s"), (F.col("s") + F.col("y")).alias("e")))
    large = several.where(F.col("kinds") > cap)
    if not final and large.limit(1).count():
        members = dealt.join(large.select("g").distinct(), "g").select("h", "c", "s", "e", "f", "l")
        again = members.join(items, ["h", "c"]).where("f >= first AND l <= last")
        again = again.select("h", "c", "place", (F.col("lo") + F.col("s") - F.col("at")).alias("lo"), (F.col("left") - F.col("s") + F.col("at")).alias("left"), F.col("s").alias("at"), F.col("f").alias("first"), F.col("l").alias("last"), piece)
        again = materialize(again, "large")
        out = out.unionByName(settle(again, length, cap, steps[1:]))
        drop(spark, again)
    out = materialize(out, "repeated")
    drop(spark, dealt, kinds, several, found)
    return out


#: Rows of sort_lots: repeated bytes x to y of slice k of class g (run null); and of classes dealt over several shards, runs (k null)
#: with their least and largest origin, and the windows of runs that one shard alone doesn't show to be repeated.
FOUND = "g long, k long, x long, y long, run long, low decimal(20,0), high decimal(20,0)"
MOST_AROUND = 7


def run_names(shard: Shard, core: np.ndarray, around: np.ndarray) -> np.ndarray:
    """A number for each window that names it in its class: how many bytes lie before the core, and the bytes around the core.

    These are at most MOST_AROUND bytes, so the number is exact.
    """
    at = shard.sa - shard.off[:-1][shard.context]
    before, size = core[shard.context] - at, around[shard.context]
    name, bytes_ = before.astype(U), (shard.word >> U(56)).astype(U)
    for j in range(MOST_AROUND):
        place = np.where(j < before, j, shard.length - size + j)
        name = (name << U(8)) | np.where(j < size, bytes_[shard.sa + np.where(j < size, place, 0)], U(0))
    return name


def sort_lots(length: int):
    """mapInArrow over (g, part, k, place, lo, core, around, bytes) rows sorted by g and part: FOUND rows, by lots of whole parts of groups."""

    def lot(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        batch = rows.combine_chunks().to_batches()[0]
        data, off = B.column_bytes(batch.column(7))
        origin = np.asarray(batch.column(3)).view(U) * U(0x9E3779B97F4A7C15) + np.asarray(batch.column(4)).astype(U)
        g, k, core, around = (np.asarray(batch.column(i)) for i in (0, 2, 5, 6))
        split = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
        for a, shard in sorted_shards(np.ascontiguousarray(data), off, origin, length):
            at, x, y = shard.spans()
            yield found(g[at + a], k[at + a], x, y)
            if not len(shard.run) or not split[a : a + len(shard.off) - 1].any():
                continue
            name = run_names(shard, core[a:], around[a:]).view(np.int64)
            # A run goes out once for each class that its windows belong to (a window can hold several anchors).
            w = np.flatnonzero(split[shard.context + a])
            order = np.lexsort((g[shard.context[w] + a], shard.of[w]))
            w = w[order]
            of, owner = shard.of[w], g[shard.context[w] + a]
            once = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (owner[1:] != owner[:-1])))
            yield found(owner[once], None, None, None, name[w[once]], shard.low[of[once]], shard.high[of[once]])
            w = np.flatnonzero(split[shard.context + a] & ~shard.repeated[shard.of])
            x = shard.sa[w] - shard.off[:-1][shard.context[w]]
            yield found(g[shard.context[w] + a], k[shard.context[w] + a], x, x + length, name[w])

    def found(g, k, x, y, run=None, low=None, high=None) -> pa.RecordBatch:
        n = len(g)
        column = lambda v: pa.nulls(n, pa.int64()) if v is None else pa.array(v, pa.int64())
        number = lambda v: (pa.nulls(n, pa.uint64()) if v is None else pa.array(v, pa.uint64())).cast(pa.decimal128(20, 0))
        return pa.RecordBatch.from_arrays([column(g), column(k), column(x), column(y), column(run), number(low), number(high)], ["g", "k", "x", "y", "run", "low", "high"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now])
            while held.num_rows:
                # A lot ends with a group, or a part of one, once it has a shard's bytes.
                sizes = np.cumsum(np.asarray(pa.compute.binary_length(held.column(7)).combine_chunks(), dtype=np.int64))
                g, part = held.column(0).to_numpy(), held.column(1).fill_null(-1).to_numpy()
                ends = np.flatnonzero((g[1:] != g[:-1]) | (part[1:] != part[:-1])) + 1
                ends = ends[sizes[ends - 1] >= SHARD]
                if not len(ends):
                    break
                yield from lot(held.slice(0, ends[0]))
                held = held.slice(ends[0])
        if held is not None and held.num_rows:
            yield from lot(held)

    return run


def merge_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over (g, run, low, high) rows sorted by g and run: the runs with more than one origin in all shards together."""
    last: tuple | None = None  # g, run, low, high, whether it is out
    for batch in batches:
        out = []
        for g, run, low, high in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if last is not None and (g, run) == last[:2]:
                low, high = min(low, last[2]), max(high, last[3])
                done = last[4]
            else:
                done = False
            if low != high and not done:
                out.append((g, run))
                done = True
            last = (g, run, low, high, done)
        x, y = zip(*out, strict=True) if out else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["g", "run"])


def text_key(column: str) -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(quoted(column)).cast("string"), F.lit(""))))


def repeats(docs: DataFrame, length: int = 400, k: int | None = None, group_cap: int = 4096, whole_chars: bool = False, text_col: str = "text") -> DataFrame:
    """For each distinct text (k: bytes of an anchor): tid (its MD5), n_bytes, spans array<struct<lo, hi>> (maximal removed runs) and kept (binary).

    whole_chars shrinks spans to whole characters, so that kept is UTF-8.
    """
    k = k or length * 2 // 5
    text = F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit(""))
    named = small_batches(docs).select(text_key(text_col).alias("tid"), text.alias("text"))
    texts = materialize(named.groupBy("tid").agg(F.first("text").alias("text"), F.count("*").alias("copies")), "texts", "tid")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = B.column_bytes(batch.column(1))
            for a, b in B.slices(off, SLICE):
                doc, lo, hi, h, c, n, left = anchors(np.ascontiguousarray(data[off[a] : off[b]]), off[a : b + 1] - off[a], length, k)
                tid = batch.column(0).take(pa.array(doc + a))
                yield pa.RecordBatch.from_arrays([tid, pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), pa.array(h.view(np.int64)), pa.array(c.view(np.int64)), pa.array(n, pa.int64()), pa.array(left, pa.int64())], ["tid", "lo", "hi", "h", "c", "n", "left"])

    found = materialize(texts.select("tid", "text").mapInArrow(tidy(find), "tid binary, lo long, hi long, h long, c long, n long, left long"), "anchors")
    again = materialize(found.where("n > 0").groupBy("h").agg(F.sum("n").alias("n"), F.count("*").alias("rows")).where("n > 1").select("h", "rows"), "again")
    # Frequent anchors are dealt over several tasks. Their names reach the driver: at most HOT_ANCHORS, as each has that share of all rows.
    least = found.count() // HOT_ANCHORS + 1
    hot = {r["h"]: r["rows"] for r in again.where(F.col("rows") >= least).collect()}
    many = lambda times: F.col("h").isin([h for h, n in hot.items() if n >= times * least])
    parts = F.when(many(64), 1024).when(many(1), 32).otherwise(1) if hot else F.lit(1)
    dealt = lambda df, by: df.withColumn("part", F.pmod(F.xxhash64(*by), parts).cast("int"))
    every = lambda df: df.select("h", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    met = materialize(dealt(found.where("n > 0"), ["tid", "lo"]).join(every(again), ["h", "part"], "left_semi").drop("part"), "met")
    kinds = materialize(met.groupBy("h", "c").agg(F.sum("n").alias("n"), F.min(F.struct("tid", "lo", "hi", "left")).alias("one")), "kinds")
    several = materialize(kinds.groupBy("h").agg(F.count("*").alias("kinds")).where("kinds > 1").select("h"), "several")
    unlike = dealt(kinds, ["c"]).join(every(several), ["h", "part"], "left_semi")

    cut = F.expr("substring(encode(text, 'UTF-8'), cast(one.lo + 1 as int), cast(one.hi - one.lo as int))")
    contexts = unlike.withColumn("tid", F.col("one.tid")).join(texts.select("tid", "text"), "tid")
    contexts = contexts.select("h", "c", F.expr("xxhash64(one.tid)").alias("place"), F.col("one.lo").alias("lo"), F.col("one.left").alias("left"), F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("first"), F.lit(length - k).cast("long").alias("last"), cut.alias("bytes"))
    contexts = materialize(contexts, "contexts")
    wide = (length - k) // 4 + 1
    inner = settle(contexts, length, group_cap, [wide, MOST_AROUND + 1] if wide > MOST_AROUND + 1 else [wide])
    whole = kinds.where("n > 1").select("h", "c", F.lit(0).cast("long").alias("s"), F.lit(None).cast("long").alias("e"))
    hits = materialize(inner.unionByName(whole), "hits")
    spans = met.join(hits, ["h", "c"]).select("tid", (F.col("lo") + F.col("s")).alias("lo"), F.coalesce(F.col("lo") + F.col("e"), F.col("hi")).alias("hi"))
    spans = spans.unionByName(found.where("n = 0").select("tid", "lo", "hi"))
    spans = materialize(spans.groupBy("tid").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")), "spans")
    drop(docs.sparkSession, found, again, met, kinds, several, contexts, hits)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = B.column_bytes(batch.column(1))
            copies = np.asarray(batch.column(2))
            listed = batch.column(3)
            first, size, rows = 0, 0, []
            for i in range(batch.num_rows):
                one = data[off[i] : off[i + 1]]
                n = len(one)
                if copies[i] > 1 and n >= length:
                    lo, hi = np.array([0]), np.array([n])
                elif listed[i].is_valid:
                    flat = listed[i].values
                    _, lo, hi = merge_intervals(np.zeros(len(flat), np.int64), np.asarray(flat.field("lo")), np.asarray(flat.field("hi")))
                else:
                    lo, hi = np.zeros(0, np.int64), np.zeros(0, np.int64)
                if whole_chars and len(lo):
                    start = np.append((one & 0xC0) != 0x80, True)
                    at = np.flatnonzero(start)
                    lo, hi = at[np.searchsorted(at, lo)], at[np.searchsorted(at, hi, "right") - 1]
                    lo, hi = lo[lo < hi], hi[lo < hi]
                edge = np.concatenate([[0], np.stack([lo, hi], 1).ravel(), [n]]).tolist()
                kept = b"".join([one[edge[j] : edge[j + 1]].tobytes() for j in range(0, len(edge), 2)])
                rows.append((n, [{"lo": x, "hi": y} for x, y in zip(lo.tolist(), hi.tolist(), strict=True)], kept))
                size += n
                if size > 1 << 21 or i == batch.num_rows - 1:
                    n_, s_, k_ = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, i + 1 - first), pa.array(n_, pa.int64()), pa.array(s_, pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))), pa.array(k_, pa.binary())], ["tid", "n_bytes", "spans", "kept"])
                    first, size, rows = i + 1, 0, []

    return texts.join(spans, "tid", "left").select("tid", "text", "copies", "spans").mapInArrow(tidy(remove), "tid binary, n_bytes long, spans array<struct<lo:long,hi:long>>, kept binary")


def remove_repeats(docs: DataFrame, length: int = 400, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """The input rows with the text that is left, in whole characters; chars_col, if there is one, counts it anew."""
    tid, null, left, cut = unused(docs, "tid", "null", "left", "cut")
    kept = repeats(docs, length, whole_chars=True, text_col=text_col).select(F.col("tid").alias(tid), F.decode("kept", "UTF-8").alias(left), (F.size("spans") > 0).alias(cut))
    rows = docs.withColumn(tid, text_key(text_col)).withColumn(null, F.col(quoted(text_col)).isNull()).drop(text_col)
    new = {text_col: F.when(~F.col(null), F.col(left))}
    if chars_col in docs.columns:
        new[chars_col] = F.when(F.col(cut), F.length(left)).otherwise(F.col(quoted(chars_col))).cast(docs.schema[chars_col].dataType)
    columns = [new[c].alias(c) if c in new else F.col(quoted(c)) for c in docs.columns]
    return rows.join(kept, tid).select(*columns)
