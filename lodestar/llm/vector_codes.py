"""Vector code compression: product codes with exact integer codebooks, searched under segment-mean lower bounds.

Components become integers floor(256 c); a vector is cut into equal parts, each with a codebook of its own, which starts as the parts
of the vectors with the least ids and is refined by rounds of assignment and floored means. A part's nearest entry is found coarse to
fine. Cut into blocks, two vectors are at least as far apart as the means of their blocks are (times the blocks' width) plus
the squared difference of the norms of what the means leave: the first level takes the part as one block, the next ones halve the
blocks. An entry whose bound, less a slack for rounding, exceeds the exact distance of one entry already seen is out; those left
after the finest level get exact integer distances, the least of which wins, ties by index. Bounds never drop a nearest entry.

Each round is one pass over a written table of integers; tasks return sums and counts by entry, at most parts x entries x
width rows each, and Spark merges them. Codebooks are the only data sent to tasks; their size does not depend on the data.

Left out are the rows that `integer_vectors` leaves out (null, empty, null or non-finite components, components so large that
distances leave 64 bits, lengths other than the commonest). A length that the parts don't divide is filled up with zeros. Of equal ids
the lesser vector stands first, null ids last; with fewer vectors than entries codebooks are that much smaller. Rows that
repeat are coded one by one; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, tidy
from .vectors import integer_vectors, rows_of

#: Rows that are compared with all entries at once.
BLOCK = 2048
#: Share of both squared norms that a bound may be wrong by in float64.
SLACK = 1e-12
#: The sums by label are broadcast up to this many labels, and joined in salted parts beyond.
BROADCAST_LABELS = 10_000
SALTS = 64


def means(v: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(sums of blocks of width, norm of what the blocks' means leave) of rows of integers; sums and norms before the root are exact."""
    sums = v.reshape(len(v), -1, width).sum(2)
    left = width * (v * v).sum(1) - (sums * sums).sum(1)
    return sums.astype(np.float64), np.sqrt(left / width)


def nearest(v: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry of each row, ties to the lower index."""
    n, width = v.shape
    widths = [width]
    while widths[-1] % 2 == 0:
        widths.append(widths[-1] // 2)
    slack = SLACK * ((v * v).sum(1)[:, None] + (entries * entries).sum(1))
    sx, rx = means(v, width)
    sc, rc = means(entries, width)
    bound = (sx - sc.T) ** 2 / width + (rx[:, None] - rc) ** 2 - slack
    seed = bound.argmin(1)
    best = ((v - entries[seed]) ** 2).sum(1)
    row, entry = np.nonzero(bound <= best[:, None])
    for w in widths[1:-1]:  # blocks of one component are the distance itself
        (sx, rx), (sc, rc) = means(v, w), means(entries, w)
        fine = ((sx[row] - sc[entry]) ** 2).sum(1) / w + (rx[row] - rc[entry]) ** 2
        stay = fine - slack[row, entry] <= best[row]
        row, entry = row[stay], entry[stay]
    exact = ((v[row] - entries[entry]) ** 2).sum(1)
    first = np.flatnonzero(np.diff(row, prepend=-1))
    least = np.minimum.reduceat(exact, first)
    hit = np.flatnonzero(exact == least[row])
    hit = hit[np.diff(row[hit], prepend=-1) != 0]
    return entry[hit], least


def padded(x: np.ndarray, parts: int) -> np.ndarray:
    """rows x parts x width, filled up with zeros."""
    width = -(-x.shape[1] // parts)
    return np.pad(x, ((0, 0), (0, parts * width - x.shape[1]))).reshape(len(x), parts, width)


def assigned(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each row's parts."""
    found = [nearest(np.ascontiguousarray(x[:, p]), books[p]) for p in range(len(books))]
    return np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


def refine(table: DataFrame, length: int, books: np.ndarray) -> np.ndarray:
    """Codebooks after one round: floored means of the parts that chose an entry; unused entries stay."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, width), np.int64)
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(np.repeat(np.flatnonzero(count), width)), pa.array(np.tile(np.arange(width), np.count_nonzero(count))), pa.array(np.repeat(count[count > 0], width)), pa.array(sums[count > 0].ravel())], ["entry", "place", "n", "total"])
        rows = 0
        for b in batches:
            for lo in range(0, b.num_rows, BLOCK):
                x = padded(rows_of(b.column("x").slice(lo, BLOCK), length), parts)
                at = (assigned(x, books)[0] + np.arange(parts) * entries).ravel()
                order = np.argsort(at, kind="stable")
                first = np.flatnonzero(np.diff(at[order], prepend=-1))
                count += np.bincount(at, minlength=parts * entries)
                sums[at[order][first]] += np.add.reduceat(x.reshape(-1, width)[order], first)
                rows += len(x)
                if rows >= 1 << 24:  # sums stay within 64 bits, as components stay within limit()
                    yield flush()
                    rows = 0
                    count[:], sums[:] = 0, 0
        yield flush()

    found = table.select("x").mapInArrow(tidy(run), "entry long, place long, n long, total long").groupBy("entry", "place")
    out = books.reshape(-1, width).copy()
    for r in found.agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():  # parts x entries x width rows at most
        out[r["entry"], r["place"]] = int(r["total"]) // r["n"]
    return out.reshape(books.shape)


def limit(length: int) -> int:
    """Components below this have squared distances within 64 bits; never beyond 2**38, for sums of many of them."""
    return min(math.isqrt((1 << 61) // max(length, 1)), 1 << 38)


def fit_codebooks(table: DataFrame, length: int, parts: int = 16, entries: int = 64, rounds: int = 2) -> np.ndarray:
    """parts x entries x width integers; the table has id and x."""
    first = table.select("id", "x").orderBy(F.col("id").asc_nulls_last(), "x").limit(entries).collect()
    books = np.ascontiguousarray(padded(np.array([r["x"] for r in first], np.int64), parts).transpose(1, 0, 2))
    for _ in range(rounds):
        books = refine(table, length, books)
    return books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and position, with commas between."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(table: DataFrame, length: int, books: np.ndarray) -> DataFrame:
    """The table without x, with code (a byte for each part) and error."""
    kept = [c for c in table.columns if c != "x"]
    kinds = ", ".join(f"{c} {table.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, BLOCK):
                part = b.slice(lo, BLOCK)
                code, far = assigned(padded(rows_of(part.column("x"), length), len(books)), books)
                raw = code.astype(np.uint8).tobytes()
                codes = pa.array([raw[i : i + len(books)] for i in range(0, len(raw), len(books))], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), codes, pa.array(far.sum(1))], [*kept, "code", "error"])

    return table.mapInArrow(tidy(run), f"{kinds}, code binary, error long")


def decode(codes: DataFrame, books: np.ndarray, length: int, scale: int = 256, code_col: str = "code") -> DataFrame:
    """codes with a column approximation: the vector that the code stands for, an array of doubles; a null code gives null."""
    flat = F.lit([[float(v) / scale for v in entry] for part in books.tolist() for entry in part])
    at = lambda p: F.conv(F.substring(F.hex(code_col), 2 * p + 1, 2), 16, 10).cast("int") + 1 + p * books.shape[1]
    return codes.withColumn("approximation", F.slice(F.concat(*(F.element_at(flat, at(p)) for p in range(len(books)))), 1, length))


def compress_vectors(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray, int]:
    """(rows, codebooks, length); rows: id, label, code (binary), error, label_error (null if beyond 64 bits)."""
    if not 1 <= entries <= 256:
        raise ValueError("an index is one byte: 1 to 256 entries")
    width = F.size(F.col(f"`{vec_col.replace('`', '``')}`"))
    longest = vectors.agg(F.max(width).alias("n")).first()["n"] or 1
    table, length = integer_vectors(vectors, {"id": id_col, "label": label_col}, vec_col, scale, 0, limit(longest))
    books = fit_codebooks(table, length, parts, entries, rounds) if length else np.zeros((parts, 0, 1), np.int64)
    if length:
        coded = encode(table, length, books)
    else:
        coded = table.select("id", "label", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error")).limit(0)
    coded = materialize(coded, "codes")
    sums = materialize(coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error")), "label-errors")
    if sums.count() <= BROADCAST_LABELS:
        rows, sums, keys = coded, F.broadcast(sums), ["label"]
    else:
        rows = coded.withColumn("salt", F.pmod(F.xxhash64("id", "code"), F.lit(SALTS)))
        sums, keys = sums.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["label", "salt"]
    met = rows.alias("r").join(sums.alias("s"), [F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys])
    return met.select(F.col("r.id").alias(id_col), F.col("r.label").alias(label_col), "code", "error", "label_error"), books, length
