"""Vectorised views of Arrow text columns as bytes: words, lines and their hashes.

A slice of documents is one array of UTF-8 bytes and the offsets at which documents begin. All functions work on whole
documents; a slice holds as many as fit in a number of bytes, and at least one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

_SEED = np.random.RandomState(20240229)
#: A random 64-bit value for each byte, and the base of the rolling polynomial that chooses anchors (odd, so that it has an inverse modulo
#: 2**64). Unlike texts can agree in it: it never stands for equality.
BYTE_CODE = _SEED.randint(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True

_powers: dict[str, np.ndarray] = {}


def powers(n: int, base: np.uint64, name: str) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64, kept between calls."""
    have = _powers.get(name)
    if have is None or len(have) < n:
        room = max(n, 1 << 16)
        steps = np.full(room, base, np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if room <= 1 << 22:
            _powers[name] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the output."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls are empty."""
    if pa.types.is_null(column.type):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    _, starts, data = column.buffers()
    if not len(column) or starts is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(starts, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(off: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of documents with at most limit bytes each, or one document."""
    first, n = 0, len(off) - 1
    while first < n:
        last = int(np.searchsorted(off, off[first] + limit, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def counts(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    """How many bytes of each document are marked."""
    at = off.tolist()
    return np.fromiter((np.count_nonzero(mask[a:b]) for a, b in zip(at, at[1:])), np.int64, len(at) - 1)


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, document) of every word; words end at document ends."""
    inside = ~SEPARATOR[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    before = np.concatenate([[False], inside[:-1]]) if len(data) else inside
    after = np.concatenate([inside[1:], [False]]) if len(data) else inside
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(off, starts, "right") - 1


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes, the halves of XXH3-128, of the bytes of each word, in the order of `words`."""
    raw, at = data.tobytes(), off.tolist()
    # bytes.split() ends words at the same bytes as SEPARATOR.
    each = b"".join(xxhash.xxh3_128_digest(w) for a, b in zip(at, at[1:]) for w in raw[a:b].split())
    both = np.frombuffer(each, ">u8").reshape(-1, 2).astype(np.uint64)
    return both[:, 1], both[:, 0]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """XXH3-64 of the bytes of each data[start:end]."""
    raw = memoryview(np.ascontiguousarray(data))
    return np.fromiter((xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist())), np.uint64, len(starts))


def window_hashes(values: np.ndarray, group: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first index) of each run of width neighbours within one group."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    same = np.flatnonzero(group[:n] == group[width - 1 :])
    out = np.zeros(len(same), np.uint64)
    for k in range(width):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + values[same + k])
    return out, same
