"""Quality rules: counts of words, lines and symbols, and bands of zstandard compression ratios.

Bands have fixed outer limits, and least ratios by length that `fit_bands` takes from the documents themselves: prose of one
length compresses alike, and lists, menus and text full of symbols compress better. Every text is read as a whole, where it
lies; fitting reads all texts once before and shuffles a few bytes of each. Null text counts as empty; empty text has no words and
so fails the base rule. A worker's memory follows the longest text (about twenty bytes for each of its bytes), as its windows of words
are counted together. Rows that repeat are judged one by one, alike. Other columns of the input pass through
unchanged in `filter_quality` and are not read in `score_quality`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext as B
from .common import quoted, small_batches, tidy

#: Bytes of documents looked at together; bounds the memory of a worker (a longer document is one slice).
SLICE = 1 << 20

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"[#*$%&|<>]")] = True


@dataclass(frozen=True)
class Bands:
    """Accepted compressed / raw sizes.

    whole: (least bytes, least ratio, largest ratio) by ascending length; a document takes the last row it reaches and
    shorter documents than the first row are not judged, as a frame's fixed cost rules their ratio.
    chunk: the same for each full chunk of chunk_bytes, and where bytes are left after them, for one more chunk that ends at
    the document's end; a document fails by chunks if more than max_bad of its chunks leave the band.
    two_byte: (least bytes, largest ratio) where most characters take two bytes (Cyrillic, Greek, Arabic, Hebrew), whose
    lead bytes cost little; the lesser limit holds. chunk_two_byte is the same for chunks.

    The largest ratios lie between prose (manual pages in English, German, French, Japanese, Korean, Chinese, and Russian,
    Ukrainian, Serbian for two bytes) and random text (printable, base64, CJK; Cyrillic and Arabic letters for two bytes) as
    measured at each row's ends. Random text of few letters (hexadecimal, base32 in short documents, one case of one
    alphabet, two-byte letters below 1024 bytes) compresses as prose does and is beyond these rules.
    """

    whole: tuple[tuple[int, float, float], ...] = (
        (128, 0.35, 0.95), (192, 0.35, 0.90), (256, 0.35, 0.85), (384, 0.35, 0.81), (512, 0.28, 0.775), (768, 0.28, 0.75),
        (1024, 0.28, 0.72), (2048, 0.22, 0.68), (4096, 0.22, 0.65), (8192, 0.16, 0.60),
    )
    two_byte: tuple[tuple[int, float], ...] = ((1024, 0.58), (1536, 0.55), (2048, 0.53), (4096, 0.47), (8192, 0.43))
    chunk_bytes: int = 2048
    chunk: tuple[float, float] = (0.20, 0.68)
    chunk_two_byte: float = 0.53
    max_bad: float = 0.5
    level: int = 3
    #: (length class, least ratio) from the corpus, see fit_bands; the larger of it and the fixed limit holds.
    fitted: tuple[tuple[int, float], ...] = ()

    def outer(self, size: int) -> tuple[int, float, float] | None:
        return next((x for x in reversed(self.whole) if size >= x[0]), None)


def base_counts(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each document."""
    n = len(off) - 1
    starts, ends, doc = B.words(data, off)
    lead = (data & 0xC0) != 0x80
    out = {
        "n_words": np.bincount(doc, minlength=n),
        "word_chars": B.counts(lead & ~B.SEPARATOR[data], off),
        "n_symbols": B.counts(SYMBOL[data], off),
    }
    # Lines end at \n and at the document's end; only lines that hold a word count.
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    edge[1:] |= data == 10
    first = np.flatnonzero(edge[:-1])
    last = np.append(first[1:], len(data)) if len(first) else first
    held = np.searchsorted(starts, last) > np.searchsorted(starts, first)
    first, last = first[held], last[held]
    last = last - (data[last - 1] == 10) if len(last) else last
    line_doc = np.searchsorted(off, first, "right") - 1
    keys = B.mix(B.span_hashes(data, first, last) + line_doc.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    _, once = np.unique(keys, return_index=True)
    out["n_dup_lines"] = np.bincount(line_doc, minlength=n) - np.bincount(line_doc[once], minlength=n)
    # Windows of three words, found again in the same document.
    hashes, at = B.window_hashes(B.word_hashes(data, off)[0], doc, 3)
    keys = B.mix(hashes + doc[at].astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB))
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    again = np.zeros(len(keys), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(len(starts), bool)
    hit = at[again]
    for k in range(3):
        covered[hit + k] = True
    out["n_repeat_words"] = np.bincount(doc[covered], minlength=n)
    return out


def two_byte(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Whether most characters of each document take two bytes."""
    return 2 * B.counts((data >= 0xC0) & (data < 0xE0), off) > B.counts((data & 0xC0) != 0x80, off)


def length_class(size: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Quarter octaves of the length, apart by script: even for one-byte scripts, odd for two-byte ones."""
    return np.floor(4 * np.log2(np.maximum(size, 1))).astype(np.int64) * 2 + two


#: Ratios are counted in steps of 1 / RATIO_BINS.
RATIO_BINS = 2048


def limits(histogram: dict[int, tuple[np.ndarray, np.ndarray]], bands: Bands, spread: float, least: float, prior: float) -> tuple[tuple[int, float], ...]:
    """(class, least ratio) from (ratios, counts) by class: median - max(spread x deviation, least), drawn towards the fixed limit
    as if `prior` documents stood for it. The deviation is 1.4826 x the median distance from the median."""
    median = lambda x, n: float(x[np.searchsorted(np.cumsum(n), n.sum() / 2)])
    out = []
    for c, (ratio, n) in sorted(histogram.items()):
        order = np.argsort(ratio)
        middle = median(ratio[order], n[order])
        far = np.abs(ratio - middle)
        order = np.argsort(far)
        low = middle - max(spread * 1.4826 * median(far[order], n[order]), least)
        fixed = bands.outer(int(2 ** ((c // 2 + 1) / 4)) - 1)
        out.append((int(c), float((n.sum() * low + prior * (fixed[1] if fixed else 0.0)) / (n.sum() + prior))))
    return tuple(out)


def fit_bands(docs: DataFrame, bands: Bands = Bands(), text_col: str = "text", spread: float = 4.5, least: float = 0.03, prior: float = 10.0) -> Bands:
    """bands with least ratios by length class, from all documents that the fixed bands judge; equal texts count once.

    What reaches the driver is a histogram: length classes x RATIO_BINS rows at most, however many documents there are.
    """
    rows = small_batches(docs).select(F.col(quoted(text_col)).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=bands.level)
        for batch in batches:
            data, off = B.column_bytes(batch.column(0))
            raw, size = memoryview(data), np.diff(off)
            judged = np.flatnonzero(size >= bands.whole[0][0])
            ratio = [len(packer.compress(raw[off[i] : off[i + 1]])) / size[i] for i in judged]
            bins = np.minimum(np.round(np.array(ratio, float) * RATIO_BINS), RATIO_BINS - 1).astype(np.int64)
            classes = length_class(size, two_byte(data, off))[judged]
            text = [xxhash.xxh3_64_intdigest(raw[off[i] : off[i + 1]]) for i in judged]
            yield pa.RecordBatch.from_arrays([pa.array(classes, pa.int64()), pa.array(bins, pa.int64()), pa.array(np.array(text, np.uint64).view(np.int64))], ["class", "bin", "text"])

    once = rows.mapInArrow(tidy(run), "class long, bin long, text long").distinct()
    found = once.groupBy("class", "bin").count().collect()
    histogram: dict[int, list[tuple[float, int]]] = {}
    for r in found:
        histogram.setdefault(r["class"], []).append((r["bin"] / RATIO_BINS, r["count"]))
    return replace(bands, fitted=limits({c: tuple(map(np.array, zip(*x, strict=True))) for c, x in histogram.items()}, bands, spread, least, prior))


def band_verdict(data: np.ndarray, off: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ratio of the whole, share of chunks outside their band, accepted) of each document."""
    n = len(off) - 1
    packer = zstandard.ZstdCompressor(level=bands.level)
    ratio, bad, ok = np.ones(n), np.zeros(n), np.ones(n, bool)
    raw, fitted = memoryview(data), dict(bands.fitted)
    two = two_byte(data, off)
    classes = length_class(np.diff(off), two).tolist()
    for i in range(n):
        a, b = int(off[i]), int(off[i + 1])
        size = b - a
        band = bands.outer(size)
        if band is None:
            continue
        ratio[i] = len(packer.compress(raw[a:b])) / size
        starts = list(range(a, b - bands.chunk_bytes + 1, bands.chunk_bytes))
        if starts:
            if size % bands.chunk_bytes:
                starts.append(b - bands.chunk_bytes)  # the tail
            low, high = bands.chunk
            high = min(high, bands.chunk_two_byte) if two[i] else high
            out = 0
            for k in starts:
                r = len(packer.compress(raw[k : k + bands.chunk_bytes])) / bands.chunk_bytes
                out += not low <= r <= high
            bad[i] = out / len(starts)
        most = min([band[2], *(x[1] for x in bands.two_byte if two[i] and size >= x[0])])
        ok[i] = max(band[1], fitted.get(classes[i], 0.0)) <= ratio[i] <= most and bad[i] <= bands.max_bad
    return ratio, bad, ok


def judge(column: pa.Array, bands: Bands) -> dict[str, np.ndarray]:
    """All counts and verdicts of a text column."""
    data, off = B.column_bytes(column)
    parts: list[dict[str, np.ndarray]] = []
    for a, b in B.slices(off, SLICE):
        piece, at = np.ascontiguousarray(data[off[a] : off[b]]), off[a : b + 1] - off[a]
        got = base_counts(piece, at)
        got["ratio"], got["bad_chunks"], accepted = band_verdict(piece, at, bands)
        got["base_failed"] = (got["n_words"] < 50) | (100 * got["n_repeat_words"] > 50 * got["n_words"])
        got["kept"] = ~got["base_failed"] & accepted
        parts.append(got)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "ratio", "bad_chunks", "base_failed", "kept")
    return {k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0) for k in names}


def score_quality(docs: DataFrame, bands: Bands | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: its id, counts, ratios and verdict; bands are fitted to docs if none are given."""
    bands = bands or fit_bands(docs, text_col=text_col)
    kinds = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "ratio": "double", "bad_chunks": "double", "base_failed": "boolean", "kept": "boolean"}
    types = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
    rows = small_batches(docs).select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = judge(batch.column(1), bands)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(got[k]).cast(types[t]) for k, t in kinds.items())], ["id", *kinds])

    out = rows.mapInArrow(tidy(run), f"id {rows.schema['id'].dataType.simpleString()}, " + ", ".join(f"{k} {t}" for k, t in kinds.items()))
    return out.withColumnRenamed("id", id_col)


def filter_quality(docs: DataFrame, bands: Bands | None = None, text_col: str = "text") -> DataFrame:
    """The input rows that the rules keep, all columns as they were; bands are fitted to docs if none are given."""
    bands = bands or fit_bands(docs, text_col=text_col)
    where = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(judge(batch.column(where), bands)["kept"].astype(bool)))

    # Numbered columns meanwhile: any names go.
    plain = small_batches(docs).toDF(*(f"c{i}" for i in range(len(docs.columns))))
    return plain.mapInArrow(tidy(run), plain.schema).toDF(*docs.columns)
