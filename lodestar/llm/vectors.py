"""Vectors as exact integers: the form that whitening and code compression start from."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, quoted, small_batches, tidy


def rows_of(column: pa.Array, length: int) -> np.ndarray:
    """A list column whose rows all have one length and no nulls, as a matrix."""
    return np.asarray(column.flatten()).reshape(len(column), length)


def integer_vectors(vectors: DataFrame, carried: dict[str, str], vec_col: str, scale: int, shift: int, limit: int = 1 << 62) -> tuple[DataFrame, int]:
    """(written table, length): carried columns by new name, and x, an array of floor(scale * component) + shift.

    Left out are rows whose vector is null or empty, or holds a component that is null, not finite, or of magnitude limit and more once
    scaled; and, as one covariance or codebook has one length, vectors of other lengths than the commonest (of two, the longer).
    length is 0 where no vector is left.
    """
    names = list(carried)
    rows = small_batches(vectors).select(*(F.col(quoted(carried[c])).alias(c) for c in names), F.col(quoted(vec_col)).cast("array<double>").alias("v"))
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("v").fill_null([]) if b.column("v").null_count else b.column("v")
            sizes = np.asarray(lists.value_lengths()).astype(np.int64)
            flat = lists.flatten()
            c = np.asarray(flat.fill_null(np.nan) if flat.null_count else flat).astype(np.float64) * scale
            with np.errstate(invalid="ignore"):
                bad = ~(np.abs(c) < limit)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            good = sizes > 0
            good[owner[bad]] = False
            x = np.floor(np.where(bad, 0, c)).astype(np.int64)[good[owner]] + shift
            kept = b.filter(pa.array(good))
            off = np.append(0, np.cumsum(sizes[good])).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(kept.column(n) for n in names), pa.array(sizes[good].astype(np.int32)), pa.ListArray.from_arrays(pa.array(off), pa.array(x))], [*names, "length", "x"])

    table = materialize(rows.mapInArrow(tidy(run), f"{kinds}, length int, x array<long>"), "integers")
    common = table.groupBy("length").count().orderBy(F.desc("count"), F.desc("length")).first()
    length = common["length"] if common else 0
    out = table.where(F.col("length") == length).drop("length")
    out._scratch = table._scratch
    return out, length
