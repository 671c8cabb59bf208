"""Embedding near-duplicates by an inverted multi-index.

Unit vectors are cut into halves; each half has its own codebook, and pairs of centroids form a grid of cells. Every vector
lies in its home cell and visits the cells nearest to it in the order of the multi-sequence traversal (sums of the two
halves' squared distances, ascending). The number of cells to visit is fitted on a sample for a target recall at the
similarity threshold itself, the hardest case. Pairs that meet in a cell are verified by cosine in double precision;
a pair counts for both of its vectors whichever of the two visits the other.

Equal vectors become one with a multiplicity before the search, so copies are never compared. A cell's residents are
dealt into tiles of at most about `tile` vectors, visitors stream past them in batches; a tile returns counts and a
spanning forest of its links, not the pairs. Codebooks and cell counts are the only data sent to all tasks; their size is
bounded by the codebook size, at most `max_codes` a half (beyond per_cell x max_codes squared vectors cells grow with the data).

Vectors of different lengths link with nothing of one another; each length has an index of its own. Vectors that are null,
empty or zero, hold null or non-finite components, or whose id is null link with nothing: n_links 0, component their own id,
kept. Repeated rows count as copies. An empty table gives an empty result. No other column is read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, materialize, quoted, tidy
from .components import connected


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 11) -> np.ndarray:
    r = np.random.RandomState(seed)
    centres = x[r.choice(len(x), k, replace=len(x) < k)]
    for _ in range(rounds):
        near = ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)
        order = np.argsort(near, kind="stable")
        count = np.bincount(near, minlength=k)
        has = count > 0
        sums = np.add.reduceat(x[order], np.concatenate([[0], np.cumsum(count[has])[:-1]]), axis=0)
        centres[has] = sums / count[has][:, None]
    return centres


def multi_sequence(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each row, the first n cells i x codes + j in the order of a[i] + b[j].

    With both sides sorted, the traversal reaches the pair at places (i, j) only after the (i + 1)(j + 1) - 1 pairs before it in both, so
    n steps stay within (i + 1)(j + 1) <= n; these sums are formed and ordered for all rows in step (ties by cell).
    """
    codes = b.shape[1]
    x, y = (np.argsort(v, axis=1, kind="stable")[:, :n] for v in (a, b))
    i, j = np.nonzero(np.outer(np.arange(1, x.shape[1] + 1), np.arange(1, y.shape[1] + 1)) <= n)
    sums = np.take_along_axis(a, x, 1)[:, i] + np.take_along_axis(b, y, 1)[:, j]
    cell = x[:, i] * codes + y[:, j]
    order = np.lexsort((cell, sums), axis=1)[:, :n]
    return np.take_along_axis(cell, order, 1)


class MultiIndex:
    def __init__(self, sample: np.ndarray, codes: int, threshold: float, recall: float):
        half = sample.shape[1] // 2
        self.half, self.codes = half, codes
        self.one, self.two = k_means(sample[:, :half], codes), k_means(sample[:, half:], codes)
        # Neighbours at the threshold itself, in random directions: the rank at which their home cell is visited.
        r = np.random.RandomState(17)
        q = sample[:2000]
        g = r.normal(size=q.shape)
        g -= (g * q).sum(1, keepdims=True) * q
        norm = np.linalg.norm(g, axis=1, keepdims=True)
        y = threshold * q + np.sqrt(1 - threshold**2) * g / np.where(norm > 0, norm, 1)
        ranks = []
        for i in range(0, len(q), 256):
            d1, d2 = self.distances(q[i : i + 256])
            e1, e2 = self.distances(y[i : i + 256])
            rows = np.arange(len(d1))
            h1, h2 = e1.argmin(1), e2.argmin(1)
            at = d1[rows, h1] + d2[rows, h2]
            # Pairs with a smaller sum, counted by bisection in the sorted second half.
            s2 = np.sort(d2, axis=1)
            ranks += [int(np.searchsorted(s2[k], at[k] - d1[k]).sum()) + 1 for k in rows]
        self.visits = int(min(np.quantile(ranks, recall, method="higher"), codes * codes))

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances to both codebooks but for a constant; a vector's own don't depend on the rows beside it."""
        return tuple((c**2).sum(1) - 2 * np.einsum("ij,kj->ik", v, c) for v, c in ((x[:, : self.half], self.one), (x[:, self.half :], self.two)))

    def home(self, x: np.ndarray) -> np.ndarray:
        a, b = self.distances(x)
        return a.argmin(1) * self.codes + b.argmin(1)

    def cells(self, x: np.ndarray) -> np.ndarray:
        """The cells that each vector visits."""
        return multi_sequence(*self.distances(x), self.visits)


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of one length as unit vectors in double precision."""
    x = np.asarray(column.flatten()).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 2))
    x = x / np.abs(x).max(1, keepdims=True)  # squares of extreme components stay finite
    return x / np.sqrt((x * x).sum(1, keepdims=True))


class Forest:
    """Which residents of a tile are linked already."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def join(self, i: int, j: int) -> bool:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        while up[j] != j:
            up[j] = up[up[j]]
            j = up[j]
        up[max(i, j)] = min(i, j)
        return i != j


def tile_links(index: MultiIndex, residents: tuple, visitors: tuple, forest: Forest, threshold: float) -> tuple[list, list]:
    """([(ids, links)] counts, [(ids, ids)] forest edges) of visitors against residents; each side is (ids, copies, vectors)."""
    rid, rm, rx = residents
    vid, vm, vx = visitors
    near = (vx @ rx.T >= threshold) & (vid[:, None] != rid[None, :])
    vi, ri = np.nonzero(near)
    if not len(vi):
        return [], []
    found = np.bincount(vi, rm[ri], len(vid)).astype(np.int64)
    # What the residents don't find themselves, as they don't visit the visitor's home, counts for them here.
    met = np.unique(ri)
    visits, home, at = index.cells(rx[met]), index.home(vx), np.searchsorted(met, ri)
    back = np.concatenate([(visits[at[k : k + 65536]] == home[vi[k : k + 65536], None]).any(1) for k in range(0, len(vi), 65536)])
    extra = np.bincount(ri[~back], vm[vi[~back]], len(rid)).astype(np.int64)
    counts = [(vid[found > 0], found[found > 0]), (rid[extra > 0], extra[extra > 0])]
    starts = np.flatnonzero(np.diff(vi, prepend=-1))
    first = np.full(len(vid), -1)
    first[vi[starts]] = ri[starts]
    edges = [(vid[vi[starts]], rid[ri[starts]])]
    pairs = np.unique(ri * len(rid) + first[vi])
    joined = [(i, j) for i, j in zip((pairs // len(rid)).tolist(), (pairs % len(rid)).tolist(), strict=True) if i != j and forest.join(i, j)]
    if joined:
        i, j = np.array(joined).T
        edges.append((rid[i], rid[j]))
    return counts, edges


def link_embeddings(vectors: DataFrame, threshold: float = 0.95, recall: float = 0.99, sample_rows: int = 20_000, tile: int = 512, max_codes: int = 1024, per_cell: int = 200, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id, n_links, component_id and kept of every row; per_cell is the mean number of vectors of a cell that the codebooks are sized for."""
    given = vectors.schema[vec_col].dataType
    kind = "float" if getattr(getattr(given, "elementType", None), "typeName", str)() == "float" else "double"
    v = F.col(quoted(vec_col)).cast(f"array<{kind}>")
    # One component is a sign: it is searched as two, the second 0, under its own length.
    rows = vectors.select(F.col(quoted(id_col)).cast("long").alias("id"), F.size(v).alias("length"), F.when(F.size(v) == 1, F.concat(v, F.array(F.lit(0).cast(kind)))).otherwise(v).alias("v"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    good = F.col("id").isNotNull() & (F.col("length") > 0) & F.forall("v", finite) & F.exists("v", lambda x: x != 0)
    unique = materialize(rows.where(good).groupBy("length", "v").agg(F.min("id").alias("id"), F.count("*").alias("copies")), "vectors")
    lengths = unique.groupBy("length").count().orderBy("length").collect()
    found = [search_length(unique.where(F.col("length") == r["length"]).drop("length"), r["count"], f"v array<{kind}>", threshold, recall, sample_rows, tile, max_codes, per_cell) for r in lengths]
    if not found:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    found = functools.reduce(DataFrame.unionByName, found)
    links = found.where("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("links"))
    roots = connected(found.where("kind = 1").select("a", "b"))
    known = unique.join(links, unique["id"] == links["node"], "left").drop("node").join(roots, unique["id"] == roots["node"], "left")
    known = known.select(F.col("v").alias("w"), F.col("length").alias("l"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("root", "id").alias("root"))
    out = rows.withColumn("key", F.when(good, F.col("v"))).join(known, (F.col("key") == F.col("w")) & (F.col("length") == F.col("l")), "left")
    component = F.coalesce("root", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).alias("n_links"), component.alias("component_id"), (F.coalesce(F.col("id") == component, F.lit(True))).alias("kept"))


def search_length(unique: DataFrame, n: int, vector: str, threshold: float, recall: float, sample_rows: int, tile: int, max_codes: int, per_cell: int) -> DataFrame:
    """(kind, a, b) of n vectors (v, id, copies) of one length: kind 0 is b links found for node a, kind 1 a forest's edge."""
    sample = bounded_sample(unique.select("v"), ["v"], sample_rows, n).toArrow().column("v").combine_chunks()
    codes = int(min(max_codes, max(1, 2 ** round(np.log2(max(1.0, np.sqrt(n / per_cell)))))))
    index = MultiIndex(matrix(sample), codes, threshold, recall)

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(index.home(matrix(b.column(0))))], ["cell"])

    parts = np.zeros(codes * codes, np.int32)
    for r in unique.select("v").mapInArrow(tidy(homes), "cell long").groupBy("cell").count().collect():  # codes ** 2 rows at most
        parts[r["cell"]] = -(-r["count"] // tile)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 2048):
                part = b.slice(a, 2048)
                x, ids = matrix(part.column("v")), np.asarray(part.column("id"))
                home, cells = index.home(x), index.cells(x).ravel()
                times = parts[cells]
                which = np.repeat(np.arange(len(cells)), times)
                at = np.concatenate([np.arange(len(x)), which // index.visits])
                cell = np.concatenate([home, cells[which]])
                piece = np.concatenate([ids % parts[home], np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)])
                visitor = np.arange(len(at)) >= len(x)
                for k in range(0, len(at), 16384):
                    z = slice(k, k + 16384)
                    yield pa.RecordBatch.from_arrays([pa.array(cell[z], pa.int64()), pa.array(piece[z], pa.int64()), pa.array(visitor[z]), *(part.column(c).take(pa.array(at[z])) for c in ("id", "copies", "v"))], ["cell", "piece", "visitor", "id", "copies", "v"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, residents, forest = None, [], None, None
        for b in batches:
            cell, piece, visitor = (np.asarray(b.column(c).to_numpy(zero_copy_only=False)) for c in ("cell", "piece", "visitor"))
            ids, copies = np.asarray(b.column("id")), np.asarray(b.column("copies"))
            turn = np.flatnonzero((np.diff(cell) != 0) | (np.diff(piece) != 0) | (np.diff(visitor.astype(np.int8)) != 0)) + 1
            counts, edges = [], []
            for a, z in zip(np.append(0, turn), np.append(turn, b.num_rows), strict=True):
                if a == z:
                    continue
                if now != (cell[a], piece[a]):
                    now, held, residents = (cell[a], piece[a]), [], None
                for lo in range(a, z, 1024):
                    hi = min(z, lo + 1024)
                    block = (ids[lo:hi], copies[lo:hi], matrix(b.column("v").slice(lo, hi - lo)))
                    if not visitor[a]:
                        held.append(block)
                        continue
                    if residents is None:
                        if not held:
                            break
                        residents = tuple(np.concatenate(p) for p in zip(*held, strict=True))
                        forest = Forest(len(residents[0]))
                    c, e = tile_links(index, residents, block, forest, threshold)
                    counts += c
                    edges += e
            x, y = (np.concatenate([p[i] for p in counts + edges]) if counts or edges else np.zeros(0, np.int64) for i in (0, 1))
            n_counts = sum(len(p[0]) for p in counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(x)) >= n_counts).cast(pa.int32()), pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["kind", "a", "b"])

    dealt = unique.mapInArrow(tidy(deal), f"cell long, piece long, visitor boolean, id long, copies long, {vector}")
    tiles = dealt.repartition("cell", "piece").sortWithinPartitions("cell", "piece", "visitor")
    return materialize(tiles.mapInArrow(tidy(search), "kind int, a long, b long"), "links")
