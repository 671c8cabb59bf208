"""Quality classifier: a convolutional network over bytes, in numpy.

A document's UTF-8 bytes are covered whole by chunks of two blocks that overlap by one block; the tail is padded with zero
bytes. Learned filters read each chunk's embedded bytes, their rectified outputs are max-pooled over all chunks, and
a hidden layer combines the pooled values (and nothing else) into one probability.

Training takes a bounded sample: `max_rows` labelled documents of at most `max_bytes` each, those of the smallest hashes;
it runs on the driver by Adam with a fixed seed, so reruns agree. Labels that contradict each other for one id are averaged.
Without labels of both kinds the score is the share of 1. Scoring reads every whole text where it lies, no shuffle, in
slices of bounded bytes. Null text counts as empty; empty text is one chunk of padding and gets that chunk's score.
Repeated rows are scored one by one, alike. No column but the text is an input of a score.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext as B
from .common import bounded_sample, quoted, small_batches, tidy

SLICE = 1 << 18


class ByteNetwork:
    def __init__(self, block: int = 16, embed: int = 6, filters: int = 48, hidden: int = 24, seed: int = 3):
        r = np.random.RandomState(seed)
        self.block, self.embed, self.filters = block, embed, filters
        width = block * embed
        self.p = {
            "e": r.normal(0, 0.5, (256, embed)),
            "w": r.normal(0, 1 / np.sqrt(2 * width), (width, 2 * filters)),
            "b": np.zeros(filters),
            "h": r.normal(0, 1 / np.sqrt(filters), (filters, hidden)),
            "hb": np.zeros(hidden),
            "o": r.normal(0, 1 / np.sqrt(hidden), hidden),
            "ob": np.zeros(1),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.constant: float | None = None

    def blocks(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(blocks of bytes, first block of each document): one block more than chunks in each document, at least two."""
        n = np.diff(off)
        rows = np.maximum(-(-n // self.block), 2)
        first = np.concatenate([[0], np.cumsum(rows)])
        out = np.zeros(int(first[-1]) * self.block, np.uint8)
        out[np.arange(len(data)) + np.repeat(first[:-1] * self.block - off[:-1], n)] = data
        return out.reshape(-1, self.block), first

    def chunks(self, blocks: np.ndarray) -> np.ndarray:
        """Filter outputs for each block and the next; the last row is void."""
        a = self.p["e"][blocks].reshape(len(blocks), -1) @ self.p["w"]
        out = a[:, : self.filters] + self.p["b"]
        out[:-1] += a[1:, self.filters :]
        return out

    def head(self, pooled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hidden = np.maximum(pooled @ self.p["h"] + self.p["hb"], 0)
        return hidden, 1 / (1 + np.exp(-(hidden @ self.p["o"] + self.p["ob"][0]).astype(np.float64)))

    def score(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        n = len(off) - 1
        if self.constant is not None:
            return np.full(n, self.constant)
        out = np.zeros(n)
        for a, b in B.slices(off, SLICE):
            out[a:b] = self.head(np.maximum(self.pool(data[off[a] : off[b]], off[a : b + 1] - off[a]), 0))[1]
        return out

    def pool(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Maxima over all chunks of each document; a document beyond a slice is pooled piece by piece."""
        if len(off) == 2 and off[1] > 2 * SLICE:
            step = SLICE // self.block * self.block
            pieces = [data[a : a + step + self.block] for a in range(0, len(data) - self.block, step)]
            return np.max([self.pool(p, np.array([0, len(p)])) for p in pieces], axis=0)
        blocks, first = self.blocks(data, off)
        got = self.chunks(blocks)
        got[first[1:] - 1] = -np.inf
        return np.maximum.reduceat(got, first[:-1], axis=0)

    def gradients(self, texts: Sequence[bytes], y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean logistic loss and its derivative by every parameter; each filter learns from the chunk that is its maximum."""
        p, kind = self.p, self.p["o"].dtype
        data = np.frombuffer(b"".join(texts), np.uint8)
        off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        blocks, first = self.blocks(data, off)
        got = self.chunks(blocks)
        at = np.stack([first[i] + got[first[i] : first[i + 1] - 1].argmax(0) for i in range(len(texts))])
        raw = got[at, np.arange(self.filters)]
        pooled = np.maximum(raw, 0)
        hidden, out = self.head(pooled)
        loss = float(-np.mean(y * np.log(out) + (1 - y) * np.log1p(-out)))
        d = ((out - y) / len(texts)).astype(kind)
        dh = np.outer(d, p["o"]) * (hidden > 0)
        dc = (dh @ p["h"].T) * (raw > 0)
        x = p["e"][blocks[np.stack([at, at + 1], -1)]]  # document, filter, block, byte, dimension
        x = x.reshape(len(texts), self.filters, 2, -1)
        dw = np.einsum("if,ifkx->kxf", dc, x)
        w = p["w"].reshape(-1, 2, self.filters)
        dx = np.einsum("if,xkf->ifkx", dc, w).reshape(-1, self.embed)
        which = blocks[np.stack([at, at + 1], -1)].ravel()
        de = np.stack([np.bincount(which, dx[:, j], 256) for j in range(self.embed)], 1)
        return loss, {"e": de, "w": np.concatenate([dw[0], dw[1]], 1), "b": dc.sum(0), "h": pooled.T @ dh, "hb": dh.sum(0), "o": hidden.T @ d, "ob": d.sum(keepdims=True)}

    def fit(self, texts: Sequence[bytes], y: np.ndarray, epochs: int | None = None, batch: int = 16, rate: float = 4e-3, decay: float = 1e-4, seed: int = 5) -> ByteNetwork:
        y = np.asarray(y, np.float64)
        if len(y) == 0 or y.min() == y.max():
            self.constant = float(y.mean()) if len(y) else 0.5
            return self
        epochs = epochs or max(10, -(-24_000 // len(texts)))
        p, r = self.p, np.random.RandomState(seed)
        m, v, step = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
        total = epochs * -(-len(texts) // batch)
        p["ob"][0] = np.log(y.mean() / (1 - y.mean())) if 0 < y.mean() < 1 else 0
        for _ in range(epochs):
            order = r.permutation(len(texts))
            for a in range(0, len(order), batch):
                pick = order[a : a + batch]
                _, grads = self.gradients([texts[i] for i in pick], y[pick])
                step += 1
                now = rate * min(1, 20 * step / total) * (1 - step / (total + 1))
                for k, g in grads.items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    p[k] -= (now * ((m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8) + decay * p[k])).astype(np.float32)
        return self


def fit_quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_rows: int = 4000, max_bytes: int = 1 << 16, id_col: str = "doc_id", text_col: str = "text") -> ByteNetwork:
    """A network from at most max_rows labelled documents of at most max_bytes."""
    wanted = labels.where(F.col(quoted(label_col)).isNotNull()).groupBy(F.col(quoted(id_col)).alias("labelled")).agg(F.avg(quoted(label_col)).alias("y"))
    wanted = bounded_sample(wanted, ["labelled"], max_rows)
    text = F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit("")).cast("binary").alias("text")
    # wanted has max_rows rows at most, so it may be sent to every executor.
    rows = docs.select(F.col(quoted(id_col)).alias("id"), text).join(F.broadcast(wanted), F.col("id") == F.col("labelled")).select("id", "text", "y").where(F.octet_length("text") <= max_bytes)
    # Repeated ids could bring more rows: the bound holds for rows too.
    found = rows.orderBy(F.xxhash64("id"), "id", F.xxhash64("text")).limit(max_rows).toPandas()
    return ByteNetwork().fit([bytes(t) for t in found["text"]], found["y"].to_numpy())


def score_documents(docs: DataFrame, model: ByteNetwork, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score of every row, none for an empty table; other columns are not read."""
    rows = small_batches(docs).select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(*B.column_bytes(batch.column(1))), pa.float64())], ["id", "score"])

    return rows.mapInArrow(tidy(run), f"id {rows.schema['id'].dataType.simpleString()}, score double").withColumnRenamed("id", id_col)
