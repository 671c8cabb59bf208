"""Large JSON arrays and line files read by many tasks, with the byte place and the line number of each record.

Spark cuts a text file at any separator, and tells which block of the file a row comes from. Lines are counted by block; sums over
the blocks before give each block's first line and byte. An array has no separator of its own, so it is cut at closing braces: a first pass
finds, for each block, whether it holds an odd number of quotes and how its brackets add up if it begins outside or inside a string. Sums over the
blocks before settle which of the two is true, and at what depth the block begins. A second pass then finds the records. A record that
crosses blocks is put together from its pieces, at most two of each block.

A row for each brace is many rows. Where an array's lines are short it is cut at line feeds instead: Spark's reader leaves out lines over a limit, so a
file whose bytes are not all seen this way is cut at braces.

Both passes must see the same blocks (they do unless settings of the reader, or the number of cores that it derives the size of blocks from,
change meanwhile); a block that the first pass did not see is an error and not a wrong number. What is known of the blocks, a row each, is sent to
all tasks: about 100 bytes for every 128 MB. Compressed files are one block. All reading is Spark's own, so any store that it reads will do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scratch import written

#: The reader leaves out lines of this length and more (Hadoop's setting of that name, taken as an option).
LINE_LIMIT = {"mapreduce.input.linerecordreader.line.maxlength": str(64 << 10)}
#: Files whose size is not that of what is in them.
COMPRESSED = r"\.(gz|bz2|deflate|snappy|lz4|zst|xz)$"


def file_path() -> Column:
    return F.regexp_replace(F.col("_metadata.file_path"), "^file:(//)?", "")


def _rows(spark: SparkSession, paths: list[str] | str, sep: str, options: dict[str, str]) -> DataFrame:
    rows = spark.read.options(**options).option("lineSep", sep).text(paths)
    return rows.select(file_path().alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("file_size"), "value")


def _before(value: Column | str) -> Column:
    return F.coalesce(F.sum(value).over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _first_byte(blocks: DataFrame) -> DataFrame:
    """blocks (path, block, file_size, n_bytes) and first_byte. A byte-order mark, which readers skip, is what is missing at the end."""
    missing = F.col("file_size") - F.sum("n_bytes").over(Window.partitionBy("path"))
    # The last row may or may not end in a separator.
    return blocks.withColumn("first_byte", _before("n_bytes") + F.when(missing.isin(2, 3), 3).otherwise(0))


def _known(rows: DataFrame, blocks: DataFrame, *columns: str) -> DataFrame:
    """rows, in their order, with what is known of their blocks."""
    known = blocks.select("path", "block", *columns)
    met = rows.join(F.broadcast(known), ["path", "block"], "left")
    seen = F.when(F.col(columns[0]).isNull(), F.raise_error(F.lit("blocks of the files changed between two passes")).cast("long")).otherwise(F.col(columns[0]))
    return met.withColumn(columns[0], seen)


def _turns(batch: pa.RecordBatch) -> list[tuple[tuple[str, int], int, int]]:
    """((path, block), first row, row after the last) of runs of rows of one block."""
    block = np.asarray(batch.column("block"))
    path = batch.column("path").dictionary_encode()
    code = np.asarray(path.indices)
    edge = np.flatnonzero((np.diff(block) != 0) | (np.diff(code) != 0)) + 1
    at = [0, *edge.tolist(), batch.num_rows]
    return [((path.dictionary[int(code[a])].as_py(), int(block[a])), a, b) for a, b in zip(at, at[1:], strict=False) if b > a]


def numbered_lines(spark: SparkSession, paths: list[str] | str, **options: str) -> DataFrame:
    """(path, n, byte, length, value) of every line of files: n from 1 on, blank lines counted; byte and length without the line feed.

    A carriage return before a line feed is part of the line.
    """
    rows = _rows(spark, paths, "\n", options)
    counted = rows.groupBy("path", "block", "file_size").agg(F.count("*").alias("n_lines"), F.sum(F.octet_length("value") + 1).alias("n_bytes"))
    blocks = _first_byte(counted).withColumn("lines_before", _before("n_lines"))
    met = _known(rows.select("path", "block", "value"), blocks, "lines_before", "first_byte")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, at = None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            size = np.asarray(batch.column("size"))
            first_line, first_byte = np.asarray(batch.column("lines_before")), np.asarray(batch.column("first_byte"))
            number, byte = np.empty(batch.num_rows, np.int64), np.empty(batch.num_rows, np.int64)
            for key, a, b in _turns(batch):
                if key != now:
                    now, n, at = key, int(first_line[a]), int(first_byte[a])
                number[a:b] = n + np.arange(1, b - a + 1)
                ends = at + np.cumsum(size[a:b] + 1)
                byte[a:b] = ends - size[a:b] - 1
                n, at = n + b - a, int(ends[-1])
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(number), pa.array(byte), pa.array(size), batch.column("value")], ["path", "n", "byte", "length", "value"])

    sized = met.select("path", "block", "lines_before", "first_byte", F.octet_length("value").cast("long").alias("size"), "value")
    return sized.mapInArrow(run, "path string, n long, byte long, length long, value string")


def marks(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(running count of unescaped quotes, +1 and -1 for brackets) of bytes that don't begin after a backslash."""
    quote = data == ord('"')
    back = data == ord("\\")
    if back.any():
        edge = np.diff(back.astype(np.int8), prepend=0, append=0)
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        escaped = end[(end - begin) % 2 == 1]
        quote[escaped[escaped < len(data)]] = False
    bracket = ((data == ord("{")) | (data == ord("["))).astype(np.int8) - ((data == ord("}")) | (data == ord("]"))).astype(np.int8)
    return np.cumsum(quote), bracket


def _bytes(batch: pa.RecordBatch, a: int, b: int, sep: bytes) -> np.ndarray:
    """Rows a to b with the separators that were taken from between them."""
    pieces = batch.column("bytes").slice(a, b - a).to_pylist()
    return np.frombuffer(sep.join(pieces) + sep, np.uint8)


def _block_states(rows: DataFrame, sep: bytes) -> DataFrame:
    """(path, block, file_size, n_bytes, quotes, outside, inside, opening): quotes modulo 2, sums of brackets outside strings if the block begins
    outside or inside one, and the first byte that isn't white space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kept = None, None
        names = ["path", "block", "file_size", "n_bytes", "quotes", "outside", "inside", "opening"]
        row = lambda: pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*now, *kept), (pa.string(), *[pa.int64()] * 7), strict=True)], names)
        for batch in batches:
            for key, a, b in _turns(batch):
                if key != now:
                    if now:
                        yield row()
                    now, kept = key, [batch.column("file_size")[a].as_py(), 0, 0, 0, 0, None]
                data = _bytes(batch, a, b, sep)
                count, bracket = marks(data)
                inside = (count + kept[2]) & 1
                kept[1] += len(data)
                kept[3] += int(bracket[inside == 0].sum())
                kept[4] += int(bracket[inside == 1].sum())
                kept[2] = int(kept[2] + count[-1]) & 1
                if kept[5] is None:
                    seen = np.flatnonzero(~np.isin(data, np.frombuffer(b" \t\r\n", np.uint8)))
                    kept[5] = int(data[seen[0]]) if len(seen) else None
        if now:
            yield row()

    return rows.mapInArrow(run, "path string, block long, file_size long, n_bytes long, quotes long, outside long, inside long, opening long")


def array_records(spark: SparkSession, paths: list[str] | str, **options: str) -> DataFrame:
    """(path, byte, length, record) of the objects of JSON arrays, written once; files of objects one after the other are read too.

    Objects are direct members of a file's array; what else an array holds is passed over. A file whose brackets or quotes don't close gives the
    records that are whole.
    """
    read = lambda sep, **more: _rows(spark, paths, sep, options | more).withColumn("bytes", F.col("value").cast("binary")).drop("value")
    lines = read("\n", **LINE_LIMIT)
    states = written(_block_states(lines, b"\n"), "blocks")
    # Less a byte-order mark, and with a line feed after the last line if it has none.
    missing = F.first("file_size") - F.sum("n_bytes")
    seen = F.broadcast(states.groupBy("path").agg(missing.alias("missing")).where("missing IN (-1, 0, 2, 3)").where(~F.col("path").rlike(COMPRESSED)).select("path"))
    n_seen = seen.count()
    if n_seen == len(lines.inputFiles()):
        return _records(lines, states, b"\n")
    braces = read("}").join(seen, "path", "left_anti")
    found = _records(braces, _block_states(braces, b"}"), b"}")
    return found.unionByName(_records(lines.join(seen, "path", "left_semi"), states.join(seen, "path", "left_semi"), b"\n")) if n_seen else found


def _records(rows: DataFrame, states: DataFrame, sep: bytes) -> DataFrame:
    """(path, byte, length, record) of rows that were cut at sep, with the states of their blocks."""
    in_order = Window.partitionBy("path").orderBy("block")
    blocks = _first_byte(states).withColumn("string", _before("quotes") % 2)
    blocks = blocks.withColumn("depth", _before(F.when(F.col("string") == 0, F.col("outside")).otherwise(F.col("inside"))))
    opening = F.first("opening", ignorenulls=True).over(in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    blocks = blocks.withColumn("base", F.when(opening == ord("["), 1).otherwise(0))
    met = _known(rows, blocks, "first_byte", "string", "depth", "base")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at, string, depth, base = None, 0, 0, 0, 0
        held: list[bytes] = []  # of the record that is open
        began, head = 0, False  # where it began, and whether in a block before

        # Of a record in several blocks: 1 goes on, 2 ends, 3 begins here.
        def piece(part: int, raw: bytes) -> tuple:
            return (*now, began, len(raw), part, raw)

        for batch in batches:
            out = []
            for key, a, b in _turns(batch):
                if key != now:
                    if held:
                        out.append(piece(1 if head else 3, b"".join(held)))
                    now, at, string, depth, base = key, *(batch.column(c)[a].as_py() for c in ("first_byte", "string", "depth", "base"))
                    held, began, head = [], at, depth > base
                data = _bytes(batch, a, b, sep)
                if at + len(data) > batch.column("file_size")[a].as_py():
                    data = data[:-1]  # no separator follows a file's last piece
                if not len(data):
                    continue
                count, bracket = marks(data)
                step = np.where((count + string) & 1, 0, bracket)
                level = depth + np.cumsum(step, dtype=np.int64)
                starts = np.flatnonzero((step == 1) & (level == base + 1) & (data == ord("{")))
                ends = np.flatnonzero((step == -1) & (level == base) & (data == ord("}")))
                raw, first = data.tobytes(), 0
                if head or held:  # the open record goes on
                    first = int(ends[0]) + 1 if len(ends) else len(raw)
                    held.append(raw[:first])
                    if len(ends):
                        whole = b"".join(held)
                        out.append(piece(2 if head else 0, whole))
                        held, head, ends = [], False, ends[1:]
                        starts = starts[starts >= first]
                out += [(*now, at + s, e + 1 - s, 0, raw[s : e + 1]) for s, e in zip(starts.tolist(), ends.tolist(), strict=False)]
                if len(starts) > len(ends):
                    began, held = at + int(starts[-1]), [raw[starts[-1] :]]
                at, string, depth = at + len(raw), int(string + count[-1]) & 1, int(level[-1])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 6, KINDS.values(), strict=True)], list(KINDS))
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(piece(1 if head else 3, b"".join(held)), KINDS.values(), strict=True)], list(KINDS))

    found = written(met.mapInArrow(run, "path string, block long, byte long, length long, part int, raw binary"), "records")
    order = Window.partitionBy("path").orderBy("block", "part")
    pieces = found.where("part > 0").withColumn("record", F.sum(F.when(F.col("part") == 3, 1).otherwise(0)).over(order))
    joined = pieces.groupBy("path", "record").agg(F.min("byte").alias("byte"), F.sum("length").alias("length"), F.max_by("part", F.struct("block", "part")).alias("last"), F.array_sort(F.collect_list(F.struct("block", "part", "raw"))).alias("parts"))
    raw = F.aggregate("parts", F.lit(b""), lambda x, p: F.concat(x, p["raw"]))
    stitched = joined.where("record > 0 AND last = 2").select("path", "byte", "length", raw.alias("raw"))
    return found.where("part = 0").select("path", "byte", "length", "raw").unionByName(stitched).select("path", "byte", "length", F.col("raw").cast("string").alias("record"))


KINDS = {"path": pa.string(), "block": pa.int64(), "byte": pa.int64(), "length": pa.int64(), "part": pa.int32(), "raw": pa.binary()}
