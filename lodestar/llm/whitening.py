"""Embedding whitening with an exact covariance by digit-slice products.

Components c become integers x = floor(64 c) + 1,000,000. With n vectors and sums S, y = n x - S is the centred vector times n, an
exact integer. y is split into signed limbs of 20 bits; in blocks of 4,096 rows the products of two limbs' matrices are sums of
4,096 products below 2**38, so float64 BLAS makes them without rounding. Products of equal weight are added as integers,
merged over all tasks by Spark as exact decimals and recombined to big integers: sum(y y') = n**3 V for the covariance V. Each
entry is rounded once, when it is divided, and the matrix is decomposed on the driver; it has length x length entries, however many
vectors there are. Whitened values are (y / n) projected on a component over the root of its eigenvalue; how far their own
covariance is from the identity is measured by the same products, on values rounded to 2**-40.

Two small shuffles: the limbs' products are length**2 / 2 rows a task and weight. Rows are read from one written table of integers.

Left out are the rows that `integer_vectors` leaves out (null, empty, null or non-finite components, components of 2**62 / 64
and more, lengths other than the commonest). Components whose eigenvalue is 0 to the precision of the decomposition have
no whitened value and aren't returned, so equal vectors, or one alone, give no rows; an empty table gives none either. Rows that
repeat count and return one by one; a null id stays null. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy
from .vectors import integer_vectors, rows_of

#: Bits of a limb and rows of a block: a block's sum of products stays below 2**50, exact in float64.
LIMB, BLOCK = 20, 4096
#: Blocks added as 64-bit integers before they leave the task.
FLUSH = 256
#: Whitened values are measured in steps of 2**-MEASURE.
MEASURE = 40


def limbs(y: np.ndarray) -> list[np.ndarray]:
    """Digits of y in base 2**LIMB between -2**(LIMB - 1) and 2**(LIMB - 1) - 1 as float64, lowest first; y may hold Python's integers."""
    half, out = 1 << LIMB - 1, []
    while y.any() or not out:
        digit = ((y + half) & ((1 << LIMB) - 1)) - half
        out.append(digit.astype(np.float64))
        y = (y - digit) >> LIMB
    return out


def products(y: np.ndarray) -> dict[int, np.ndarray]:
    """{weight: matrix} of at most BLOCK rows; sum(matrix << LIMB * weight) is y' y, exactly."""
    parts, out = limbs(y), {}
    for p, a in enumerate(parts):
        for q in range(p, len(parts)):
            m = (a.T @ parts[q]).astype(np.int64)
            out[p + q] = out.get(p + q, 0) + (m if p == q else m + m.T)
    return out


def gram(rows: DataFrame, blocks: Callable[[pa.RecordBatch], np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(sums, sums of products) of integer rows as big integers; blocks makes a matrix of `size` columns from a batch."""
    upper = np.triu_indices(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sums, n = {}, {}, 0

        def out() -> Iterator[pa.RecordBatch]:
            for kind, m in ((0, held), (1, sums)):
                for weight, v in m.items():
                    cell, value = (upper[0] * size + upper[1], v[upper]) if kind == 0 else (np.arange(size), v)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), kind, np.int32)), pa.array(np.full(len(cell), weight, np.int32)), pa.array(cell.astype(np.int64)), pa.array(value, pa.int64())], ["kind", "weight", "cell", "value"])

        for b in batches:
            for lo in range(0, b.num_rows, BLOCK):
                y = blocks(b.slice(lo, BLOCK))
                for weight, m in products(y).items():
                    held[weight] = held.get(weight, 0) + m
                for weight, part in enumerate(limbs(y)):
                    sums[weight] = sums.get(weight, 0) + part.sum(0).astype(np.int64)
                n += 1
                if n % FLUSH == 0:
                    yield from out()
                    held, sums = {}, {}
        yield from out()

    merged = rows.mapInArrow(tidy(run), "kind int, weight int, cell long, value long").groupBy("kind", "weight", "cell").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    total, square = np.zeros(size, object), np.zeros((size, size), object)
    for r in merged.toArrow().to_pylist():  # 2 x limbs x size**2 / 2 rows at most
        value, (i, j) = int(r["value"]) << LIMB * r["weight"], divmod(r["cell"], size)
        if r["kind"]:
            total[j] += value
        else:
            square[i, j] += value
            square[j, i] += value if i != j else 0
    return total, square


@dataclass(frozen=True)
class Whitening:
    """A fitted model: y = n x - sums; explained[k], values[k] and vectors[:, k] of component k + 1; identity_error as measured."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray
    exact: bool  # whether y fits 64-bit integers
    short: bool  # whether the sum of its squares does
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        return x * self.n - self.sums.astype(np.int64) if self.exact else x.astype(object) * self.n - self.sums

    def whiten(self, y: np.ndarray) -> np.ndarray:
        # A 64-bit integer over n is rounded once more than a big one.
        return (y / self.n).astype(np.float64) @ (self.vectors / np.sqrt(self.values))


def fit_whitening(table: DataFrame, length: int, components: int = 32) -> Whitening | None:
    """The model of a table of integer vectors x of one length; None if they have no variance."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = rows_of(b.column("x"), length)
                # A batch's sum may leave 64 bits, the halves' sums don't.
                high, low = (x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(length, dtype=np.int64)), pa.array(np.full(length, len(x))), pa.array(high), pa.array(low), pa.array(x.min(0)), pa.array(x.max(0))], ["dim", "n", "high", "low", "least", "most"])

    total = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    rows = table.select("x").mapInArrow(tidy(moments), "dim long, n long, high long, low long, least long, most long").groupBy("dim")
    found = sorted(rows.agg(F.sum("n").alias("n"), total("high"), total("low"), F.min("least").alias("least"), F.max("most").alias("most")).collect())
    if not found:
        return None
    n, sums = found[0]["n"], np.array([(int(r["high"]) << 32) + int(r["low"]) for r in found], object)
    bound = max(max(abs(n * r["least"] - s), abs(n * r["most"] - s)) for r, s in zip(found, sums, strict=True))
    scale = max(n * max(abs(r["least"]), abs(r["most"])) for r in found)
    model = Whitening(n, sums, np.zeros(0), np.zeros((length, 0)), np.zeros(0), scale < 1 << 62, scale < 1 << 62 and bound**2 * length < 1 << 63)
    _, square = gram(table.select("x"), lambda b: model.centred(rows_of(b.column("x"), length)), length)
    cube = n**3
    covariance = np.array([[v / cube for v in row] for row in square.tolist()], np.float64)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    used = values > values[0] * length * np.finfo(float).eps * 16 if values[0] > 0 else values > 0
    if not used.any():
        return None
    spread = sum(square[i, i] for i in range(length)) / cube
    model = Whitening(n, sums, values[used], vectors[:, used], values[used] / spread, model.exact, model.short)
    k = int(used.sum())
    measured = lambda b: np.rint(model.whiten(model.centred(rows_of(b.column("x"), length))) * 2.0**MEASURE).astype(np.int64)
    s, square = gram(table.select("x"), measured, k)
    unit = n * n << 2 * MEASURE
    error = max(abs(n * square[i, j] - s[i] * s[j] - (unit if i == j else 0)) / unit for i in range(k) for j in range(k))
    return Whitening(n, sums, model.values, model.vectors, model.explained, model.exact, model.short, float(error))


def whitened(table: DataFrame, length: int, model: Whitening) -> DataFrame:
    """id, deviation (decimal, null beyond 38 digits) and whitened, an array with a value for each component."""
    kind = table.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, BLOCK):
                part = b.slice(lo, BLOCK)
                y = model.centred(rows_of(part.column("x"), length))
                squares = (y * y if model.short else y.astype(object) ** 2).sum(1)
                deviation = pa.array(squares).cast(pa.decimal128(38, 0)) if model.short else pa.array([v if v < 10**38 else None for v in squares], pa.decimal128(38, 0))
                w = model.whiten(y)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, w.shape[1], dtype=np.int32)), pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("id"), deviation, lists], ["id", "deviation", "whitened"])

    return table.select("id", "x").mapInArrow(tidy(run), f"id {kind}, deviation decimal(38,0), whitened array<double>")


def whiten_embeddings(vectors: DataFrame, components: int = 32, scale: int = 64, shift: int = 1_000_000, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """A row for each vector and component: id, component, n, deviation, whitened, explained, identity_error."""
    table, length = integer_vectors(vectors, {"id": id_col}, vec_col, scale, shift)
    model = fit_whitening(table, length, components) if length else None
    if model is None:
        return table.select(F.col("id").alias(id_col), *(F.lit(None).cast(t).alias(c) for c, t in (("component", "int"), ("n", "long"), ("deviation", "decimal(38,0)"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")))).limit(0)
    explained = F.lit(model.explained.tolist())
    each = whitened(table, length, model).select("id", "deviation", F.posexplode("whitened").alias("place", "value"))
    return each.select(
        F.col("id").alias(id_col), (F.col("place") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation",
        F.col("value").alias("whitened"), F.element_at(explained, F.col("place") + 1).alias("explained"), F.lit(model.identity_error).alias("identity_error"),
    )
