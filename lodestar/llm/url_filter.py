"""URL filter: an explicit list of rules, and gradient-boosted trees on lexical features for the rest.

A rule is (host, path, verdict); it fits its host and all subdomains if the URL's path starts with the rule's, and the
longest rule wins. The trees learn from labelled URLs (here: those that a rule decides), from a sample bounded by
`max_rows`: the rows of the smallest hashes of each verdict, so that reruns agree. Scoring reads every URL where it lies; no shuffle.

Null URLs and URLs without `://` have empty host and path, no rule, and are judged by the trees from their own text.
An empty table gives an empty result; without labelled URLs of both verdicts the trees are a constant. Equal URLs get
equal verdicts. Other columns are not read. A worker holds some thirty bytes for each byte of a slice of 1 MB, and a longer URL once.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytetext as B
from .common import bounded_sample, quoted, small_batches, tidy

Rule = tuple[str, str, str]


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path): A-Z lower-cased host after the first ://, and the path up to ? or #."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest.substr(F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(host, upper, upper.lower()), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[Rule], value: int | None = None) -> Column:
    """The longest fitting rule as host and path, or its field `value`; null if none fits."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r[0] + r[1])):
        name, start, _ = rule
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        out = F.when(fits, F.lit(name + start if value is None else rule[value])).otherwise(out)
    return out


#: Lexical features, in the order in which `features` gives them.
NAMES = ("length", "host_length", "labels", "path_length", "depth", "digit_ratio", "entropy", "parameters", "hyphens", "upper_ratio", "escapes", "secure", "suffix1", "suffix2", "segment")


SEGMENT_END = np.zeros(256, bool)
SEGMENT_END[list(b"/?#")] = True


def url_keys(url: pa.Array) -> list[pa.Array]:
    """Last host label, last two labels, first path segment (whole, without a query) of each URL, lower-cased but for the segment."""
    rest = pc.if_else(pc.greater_equal(pc.find_substring(url, "://"), 0), pc.replace_substring_regex(url, r"(?s)^.*?://", ""), "")
    host = pc.utf8_lower(pc.struct_field(pc.extract_regex(rest, r"(?s)^(?P<x>[^/?#]*)"), "x"))
    last = pc.struct_field(pc.extract_regex(host, r"(?s)(?P<x>[^.]*)$"), "x")
    two = pc.struct_field(pc.extract_regex(host, r"(?s)(?P<x>[^.]*\.?[^.]*)$"), "x")
    segment = pc.struct_field(pc.extract_regex(rest, r"(?s)^[^/?#]*/?(?P<x>[^/?#]*)"), "x")
    return [last, two, segment]


#: Bytes of URLs looked at together; a longer URL is taken on its own, with one count of its bytes.
SLICE = 1 << 20


def features(url: pa.Array, rates: Sequence[np.ndarray]) -> np.ndarray:
    """One row for each URL of a string column without nulls; rates: the block rates of its keys (see url_keys)."""
    data, off = B.column_bytes(url)
    out = np.zeros((len(off) - 1, len(NAMES)), np.float32)
    for a, b in B.slices(off, SLICE):
        if off[b] - off[a] > SLICE:
            out[a, : -len(rates)] = long_features(data[off[a] : off[b]])
        else:
            out[a:b, : -len(rates)] = short_features(np.ascontiguousarray(data[off[a] : off[b]]), off[a : b + 1] - off[a])
    for k, rate in enumerate(rates):
        out[:, len(NAMES) - len(rates) + k] = rate
    return out


def long_features(data: np.ndarray) -> list[float]:
    """The features of one URL but for its rates."""
    raw, size, n = data.tobytes(), len(data), np.bincount(data, minlength=256)
    scheme = raw.find(b"://") if b"://" in raw else size
    host = min(scheme + 3, size)
    ends = lambda marks, at: min((i for m in marks if (i := raw.find(m, at)) >= 0), default=size)
    path = ends((b"/", b"?", b"#"), host)
    query = ends((b"?", b"#"), path)
    share = n[n > 0] / size
    return [
        size, path - host, raw.count(b".", host, path), query - path, raw.count(b"/", path, query), n[48:58].sum() / size, -(share * np.log2(share)).sum(),
        raw.count(b"=", query) + raw.count(b"&", query), n[ord("-")], n[65:91].sum() / size, n[ord("%")], raw.startswith(b"https://"),
    ]


def short_features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The features of each URL but for its rates."""
    n, rows = len(off) - 1, np.arange(len(off) - 1)
    size = np.diff(off)
    many = np.maximum(size, 1)
    doc = np.repeat(rows, size)
    at = np.arange(len(data)) - off[:-1][doc]

    def first(mask: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Place of the first marked byte from least on, in each URL; its size if there is none."""
        out = size.copy()
        hit = np.flatnonzero(mask & (at >= least[doc]))
        np.minimum.at(out, doc[hit], at[hit])
        return out

    colon = np.zeros(len(data), bool)
    if len(data) > 2:
        colon[:-2] = (data[:-2] == ord(":")) & (data[1:-1] == ord("/")) & (data[2:] == ord("/")) & (doc[:-2] == doc[2:])
    scheme = first(colon, np.zeros(n, np.int64))
    host = np.minimum(scheme + 3, size)
    path = first(SEGMENT_END[data], host)
    query = first((data == ord("?")) | (data == ord("#")), path)
    count = lambda mask: np.bincount(doc[mask], minlength=n).astype(float)
    inside = lambda lo, hi: (at >= lo[doc]) & (at < hi[doc])
    seen = np.bincount(doc * 256 + data, minlength=n * 256).reshape(n, 256) / many[:, None]
    entropy = -(seen * np.log2(np.where(seen > 0, seen, 1))).sum(1)
    secure = scheme == 5
    for k, letter in enumerate(b"https"):
        secure[secure] = data[off[:-1][secure] + k] == letter
    columns = [
        size, path - host, count((data == ord(".")) & inside(host, path)), query - path, count((data == ord("/")) & inside(path, query)),
        count((data >= 48) & (data < 58)) / many, entropy, count(((data == ord("=")) | (data == ord("&"))) & (at >= query[doc])), count(data == ord("-")),
        count((data >= 65) & (data < 91)) / many, count(data == ord("%")), secure,
    ]
    return np.stack(columns, 1).astype(np.float32)


class Trees:
    """Gradient-boosted regression trees on the logistic loss, grown level by level over binned features."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, l2: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.l2 = rounds, depth, rate, bins, l2
        self.base, self.edges, self.trees = 0.0, [], []

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], 1).astype(np.int64) if len(x) else np.zeros((0, x.shape[1]), np.int64)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Trees:
        weight = np.ones(len(y)) if weight is None else weight
        p = float(np.clip(np.average(y, weights=weight) if len(y) else 0.0, 1e-3, 1 - 1e-3))
        self.base = math.log(p / (1 - p))
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(x.shape[1])]
        if len(np.unique(y)) < 2:
            return self
        b, score = self.binned(x), np.full(len(y), self.base)
        width, n_features = self.bins + 1, x.shape[1]
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            grad, hess = weight * (p - y), weight * p * (1 - p)
            node, tree = np.zeros(len(y), np.int64), []
            for level in range(self.depth):
                n_nodes = 1 << level
                feature, cut = np.zeros(n_nodes, np.int64), np.full(n_nodes, width, np.int64)
                best = np.zeros(n_nodes)
                for j in range(n_features):
                    at = node * width + b[:, j]
                    g = np.bincount(at, grad, n_nodes * width).reshape(n_nodes, width).cumsum(1)
                    h = np.bincount(at, hess, n_nodes * width).reshape(n_nodes, width).cumsum(1)
                    total_g, total_h = g[:, -1:], h[:, -1:]
                    gain = g**2 / (h + self.l2) + (total_g - g) ** 2 / (total_h - h + self.l2) - total_g**2 / (total_h + self.l2)
                    k = gain.argmax(1)
                    better = gain[np.arange(n_nodes), k] > best + 1e-9
                    best = np.where(better, gain[np.arange(n_nodes), k], best)
                    feature, cut = np.where(better, j, feature), np.where(better, k, cut)
                tree.append((feature, cut))
                node = node * 2 + (b[np.arange(len(y)), feature[node]] > cut[node])
            leaf = -np.bincount(node, grad, 1 << self.depth) / (np.bincount(node, hess, 1 << self.depth) + self.l2) * self.rate
            self.trees.append((tree, leaf))
            score += leaf[node]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        if self.trees and len(x):
            b, rows = self.binned(x), np.arange(len(x))
            for tree, leaf in self.trees:
                node = np.zeros(len(x), np.int64)
                for feature, cut in tree:
                    node = node * 2 + (b[rows, feature[node]] > cut[node])
                out += leaf[node]
        return 1 / (1 + np.exp(-out))


class UrlModel:
    """Suffix statistics and trees, from (url, block, weight) rows.

    The statistics are block rates by key, smoothed to the prior. A training row's own label must not reach it through them, so
    the trees learn from rates of the other folds; equal URLs are in one fold. New URLs get the rates of all rows.
    """

    def __init__(self, urls: Sequence[str | None], block: np.ndarray, weight: np.ndarray | None = None, smooth: float = 20.0, folds: int = 5):
        y = np.asarray(block, float)
        w = np.ones(len(y)) if weight is None else np.asarray(weight, float)
        self.prior, self.smooth = float(np.average(y, weights=w)) if len(y) else 0.0, smooth
        column = pa.array([u or "" for u in urls], pa.string())
        keys = [k.to_pylist() for k in url_keys(column)]
        fold = np.array([zlib.crc32((u or "").encode()) % folds for u in urls], np.int64)
        self.stats, rates = [], []
        for key in keys:
            names = {k: i for i, k in enumerate(dict.fromkeys(key))}
            at = np.array([names[k] for k in key], np.int64)
            cells = lambda v: np.bincount(at * folds + fold, v, len(names) * folds).reshape(-1, folds)  # noqa: B023, E731
            good, total = cells(w * y), cells(w)
            rest = lambda c: c.sum(1, keepdims=True) - c
            rates.append(((rest(good) + smooth * self.prior) / (rest(total) + smooth))[at, fold] if len(y) else np.zeros(0))
            rate = (good.sum(1) + smooth * self.prior) / (total.sum(1) + smooth)
            self.stats.append({k: float(rate[i]) for k, i in names.items()})
        self.trees = Trees().fit(features(column, rates), y, w)

    def score(self, urls: pa.Array | Sequence[str | None]) -> np.ndarray:
        column = urls if isinstance(urls, pa.Array) else pa.array(urls, pa.string())
        column = column.cast(pa.string()).fill_null("") if len(column) else pa.array([], pa.string())
        rates = []
        for stats, key in zip(self.stats, url_keys(column), strict=True):
            coded = pc.dictionary_encode(key)
            coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
            rate = np.array([stats.get(k, self.prior) for k in coded.dictionary.to_pylist()])
            rates.append(rate[coded.indices.to_numpy()] if len(column) else np.zeros(0))
        return self.trees.score(features(column, rates))


def fit_urls(labelled: DataFrame, max_rows: int = 20_000) -> UrlModel:
    """Fit on rows (id, url, block boolean): at most max_rows / 2 of each verdict, weighted so that both have their share of all rows.

    Rows are those of the smallest hashes of id and URL together, so a URL that very many rows share is not in or out as a whole.
    """
    rows = labelled.select("id", "url", "block").where("block IS NOT NULL")
    found = {bool(r["block"]): r["count"] for r in rows.groupBy("block").count().collect()}
    parts = []
    for verdict, n in sorted(found.items()):
        part = bounded_sample(rows.where(F.col("block") == verdict), ["id", "url"], max_rows // 2, n).toPandas()
        parts += [(u, verdict, n / len(part)) for u in part["url"]]
    urls, block, weight = zip(*parts, strict=True) if parts else ((), (), ())
    w = np.array(weight, float)
    return UrlModel(urls, np.array(block, float), w / w.mean() if len(w) else w)


def filter_urls(pages: DataFrame, rules: Sequence[Rule], model: UrlModel | None = None, id_col: str = "page_id", url_col: str = "url", max_rows: int = 20_000, threshold: float = 0.5) -> DataFrame:
    """id, host, path, rule, verdict and block_score of every row."""
    url = F.col(quoted(url_col)).cast("string")
    host, path = parts(url)
    rows = small_batches(pages).select(F.col(quoted(id_col)).alias("id"), url.alias("url"), host.alias("host"), path.alias("path"), rule_of(host, path, rules).alias("rule"), rule_of(host, path, rules, 2).alias("ruled"))
    if model is None:
        model = fit_urls(rows.where("ruled IS NOT NULL").select("id", "url", (F.col("ruled") == "block").alias("block")), max_rows)
    fitted = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = fitted.score(batch.column("url"))
            ruled = batch.column("ruled").to_pylist()
            verdict = [r or ("block" if x >= threshold else "allow") for r, x in zip(ruled, p, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "host", "path", "rule")), pa.array(verdict, pa.string()), pa.array(p, pa.float64())], ["id", "host", "path", "rule", "verdict", "block_score"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(tidy(run), f"id {kind}, host string, path string, rule string, verdict string, block_score double").withColumnRenamed("id", id_col)
