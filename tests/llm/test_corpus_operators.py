"""Corpus operators against brute force and on awkward rows."""

import hashlib
import heapq
import json
import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import regex
import xxhash
import zstandard
from pyspark.sql import functions as F

from lodestar.llm import bpe, chat_format, common, components, embedding_dedup, kd_sharding, minhash, mixing, quality_cnn, quality_rules, suffix_dedup, url_filter
from lodestar.llm import bytetext as B
from lodestar.llm.queries import URL_RULES, op1_suffix_dedup, op7_chat_format, vocabulary_path

WORD = regex.compile("[^\x20\x09-\x0d]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def prose(r, n, vocabulary=400):
    words = ["".join(r.choice("aeioué") + r.choice("bdklmnrst") for _ in range(1 + i % 4)) for i in range(vocabulary)]
    return " ".join(r.choice(words) + ("\n" if r.random() < 0.05 else "") for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    """Copies, near copies, shared passages, repeats, nulls, empty, long and odd texts."""
    r = random.Random(5)
    base = [prose(r, r.choice([3, 30, 120, 300])) for _ in range(40)]
    passage = prose(r, 120)
    near = []
    for t in base[:12]:
        words = t.split(" ")
        for _ in range(len(words) // 60 + 1):
            words[r.randrange(len(words))] = "changed"
        near.append(" ".join(words))
    shared = [f"{prose(r, 60)} {passage} {prose(r, 60)}" for _ in range(8)]
    odd = [None, "", None, " \n\t", "one", "one", "a" * 3000, "ab" * 1500, prose(r, 6000), "x\x00y é\u2028z 日本語 " * 90, "<|endoftext|> a<|endoftext|>", passage, base[0][:-5], base[0] + base[0]]
    return base + base[:5] + base[:2] + near + shared + odd


@pytest.fixture
def docs(spark, texts):
    """documents with ids that don't follow the rows, and columns that clash with the operators' own names."""
    r = random.Random(1)
    rows = [(1000 + (i * 37) % 997, t, None if i % 7 == 0 else "en", [None, "b", "a", "ü"][i % 4], len(t or ""), "x", i, b"y") for i, t in enumerate(texts)]
    r.shuffle(rows)
    return spark.createDataFrame(rows, DOC + ", id string, size int, tid binary")


@pytest.fixture
def empty(docs):
    return docs.limit(0)


def repeated_bytes(all_bytes, length):
    starts = Counter(b[i : i + length] for b in all_bytes for i in range(len(b) - length + 1))
    out = []
    for b in all_bytes:
        cover = np.zeros(len(b) + 1, int)
        for i in range(len(b) - length + 1):
            if starts[b[i : i + length]] > 1:
                cover[i] += 1
                cover[i + length] -= 1
        out.append(np.cumsum(cover)[: len(b)] > 0)
    return out


# Suffix arrays


@pytest.mark.parametrize(("length", "cap"), [(400, 4096), (100, 4096), (100, 2)])
def test_suffix_dedup_against_all_windows(docs, length, cap):
    rows = docs.select("doc_id", "text").collect()
    raw = [(r["text"] or "").encode() for r in rows]
    cover = repeated_bytes(raw, length)
    found = suffix_dedup.repeats(docs, length, k=length * 2 // 5, group_cap=cap).collect()
    got = {bytes(r["tid"]): r for r in found}
    assert len(got) == len(set(raw))
    for b, c in zip(raw, cover, strict=True):
        r = got[hashlib.md5(b).digest()]
        edges = np.flatnonzero(np.diff(np.concatenate([[0], c.astype(int), [0]])))
        assert [(s["lo"], s["hi"]) for s in r["spans"]] == list(zip(edges[::2], edges[1::2], strict=True))
        assert bytes(r["kept"]) == np.frombuffer(b, np.uint8)[~c].tobytes() and r["n_bytes"] == len(b)


@pytest.mark.parametrize("length", [400, 200])
def test_large_classes_lose_no_window(spark, length):
    r = random.Random(length)
    cut = lambda n: "".join(r.choice("abcdefghijklmnop ") for _ in range(n))
    raw = []
    for _ in range(30):
        passage = cut(2 * length)
        for _ in range(6):
            a = r.randrange(length // 2)
            raw.append((cut(50) + passage[a : a + length + r.randrange(length // 2)] + cut(50)).encode())
    rows = spark.createDataFrame([(t.decode(),) for t in raw], "text string")
    got = {bytes(x["tid"]): x["spans"] for x in suffix_dedup.repeats(rows, length, group_cap=2).collect()}
    for b, c in zip(raw, repeated_bytes(raw, length), strict=True):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], c.astype(int), [0]])))
        assert [(x["lo"], x["hi"]) for x in got[hashlib.md5(b).digest()]] == list(zip(edges[::2], edges[1::2], strict=True))


@pytest.mark.parametrize("extra", [-3, 0, 3])
def test_runs_of_a_common_passage_meet_across_shards(spark, extra):
    """A passage of about one window in many unlike texts, and two windows more that only some of them share."""
    length, r = 100, random.Random(extra)
    cut = lambda n: "".join(r.choice("abcdefghijklmnop ") for _ in range(n))
    passage = cut(length + extra)
    raw = [(cut(70) + r.choice(["xy", "uv", "q"]) + passage + r.choice(["ab", "cd", "ef"]) + cut(70)).encode() for _ in range(60)]
    rows = spark.createDataFrame([(t.decode(),) for t in raw], "text string")
    got = {bytes(x["tid"]): x["spans"] for x in suffix_dedup.repeats(rows, length, group_cap=4).collect()}
    for b, c in zip(raw, repeated_bytes(raw, length), strict=True):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], c.astype(int), [0]])))
        assert [(x["lo"], x["hi"]) for x in got[hashlib.md5(b).digest()]] == list(zip(edges[::2], edges[1::2], strict=True))


def test_long_texts_are_read_in_pieces(monkeypatch):
    r = np.random.RandomState(8)
    piece = r.randint(97, 123, 3000).astype(np.uint8)
    data = np.concatenate([r.randint(97, 123, 5000), piece, r.randint(97, 123, 777), piece, np.full(2000, 97)]).astype(np.uint8)
    off = np.array([0, 40, len(data) - 90, len(data)])
    whole = [x.tolist() for x in suffix_dedup.anchors(data, off, 100, 40)]
    for limit in (1000, 613, 101):
        monkeypatch.setattr(suffix_dedup, "SLICE", limit)
        got = [x.tolist() for x in suffix_dedup.anchors(data, off, 100, 40)]
        assert sorted(zip(*got, strict=True)) == sorted(zip(*whole, strict=True))


@pytest.mark.parametrize(("length", "steps"), [(400, (61, 8, 1)), (200, (31, 8, 1))])
def test_classes_hold_every_offset_once_in_any_slice(monkeypatch, length, steps):
    k, r = length * 2 // 5, np.random.RandomState(3)
    context = r.randint(97, 123, 2 * length - k).astype(np.uint8).tobytes()
    for step, before in zip(steps[1:], steps[:-1], strict=True):
        items = [(f, min(f + before - 1, length - k)) for f in range(0, length - k + 1, before)] * 2
        items = items[1:] + items[:1]
        columns = [[7] * len(items), range(len(items)), [0] * len(items), [0] * len(items), [length - k] * len(items), [0] * len(items), [f for f, _ in items], [l for _, l in items]]
        batch = pa.RecordBatch.from_arrays([*(pa.array(list(c), pa.int64()) for c in columns), pa.array([context] * len(items))], ["h", "c", "place", "lo", "left", "at", "first", "last", "bytes"])
        for limit in (1 << 19, 3 * len(context), 1):
            monkeypatch.setattr(suffix_dedup, "SLICE", limit)
            rows = [x for out in suffix_dedup.classes(length, step)([batch]) for x in out.to_pylist()]
            for i, (f, l) in enumerate(items):
                assert sorted(o for x in rows if x["c"] == i for o in range(x["f"], x["l"] + 1)) == list(range(f, l + 1))
            assert len({(x["g"], x["k"]) for x in rows}) * 2 == len(rows)  # both copies of an item meet


def test_suffix_dedup_query_counts_nothing_beside_n_chars(spark, tmp_path):
    r = random.Random(3)
    shared, texts = prose(r, 200), [prose(r, 100) for _ in range(3)]
    assert len(shared.encode()) > 400 and all(len(t) < len(t.encode()) for t in texts)  # bytes held against characters would look like a change
    rows = [(i, t, "fr", "s", len(t)) for i, t in enumerate([texts[0], texts[1] + shared, shared + texts[2]])]
    spark.createDataFrame(rows, DOC).write.parquet(str(tmp_path / "documents.parquet"))
    out = op1_suffix_dedup(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"]
    got = {x["doc_id"]: x for x in out.collect()}
    assert got[0]["text"] == texts[0] and got[0]["n_removed"] == 0
    for i in (1, 2):
        assert got[i]["n_removed"] >= len(shared.encode()) and len(got[i]["text"].encode()) == got[i]["n_bytes"] - got[i]["n_removed"]


def test_suffix_dedup_rows(docs, empty):
    out = suffix_dedup.remove_repeats(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    for r in out.collect():
        assert r["text"] is None or len(r["text"]) == r["n_chars"]
    assert suffix_dedup.remove_repeats(empty).count() == 0
    assert out.where("text IS NULL").count() == docs.where("text IS NULL").count()


def test_shards_sort_and_merge():
    r = np.random.RandomState(0)
    for trial in range(30):
        alphabet = r.choice([2, 3, 60])
        parts = [bytes(r.randint(97, 97 + alphabet, r.randint(1, 90)).astype(np.uint8)) for _ in range(r.randint(1, 12))]
        parts += [parts[0][3:] + b"zz", parts[-1]]
        data, off = np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)])
        origin = np.arange(len(parts), dtype=np.uint64) << np.uint64(32)
        shard = suffix_dedup.Shard(data, off, origin, 12)
        windows = [i for i in range(len(data)) if off[np.searchsorted(off, i, "right")] - i >= 12]
        assert shard.sa.tolist() == sorted(windows, key=lambda i: (data[i : i + 12].tobytes(), i))
        want = repeated_bytes(parts, 12)
        for size in (1 << 20, 40):
            at, s, e = suffix_dedup.lot_spans(data, off, origin, 12, size)
            cover = [np.zeros(len(p), bool) for p in parts]
            for k, a, z in zip(at, s, e, strict=True):
                cover[k][a:z] = True
            assert all((x == y).all() for x, y in zip(cover, want, strict=True)), (trial, size)


def test_one_place_is_not_its_own_repeat():
    text = np.frombuffer(bytes(range(97, 123)) * 1, np.uint8)
    data, off = np.concatenate([text, text]), np.array([0, 26, 52])
    assert len(suffix_dedup.lot_spans(data, off, np.array([5, 5], np.uint64), 10)[0]) == 0
    assert len(suffix_dedup.lot_spans(data, off, np.array([5, 99], np.uint64), 10)[0]) == 2


# URLs


def test_urls(spark):
    urls = ["http://A.Example.NET/en/x", "https://x.net/", "https://x.net", "https://x.net?q", "http://example.com/de/1", "http://sub.example.com/DE/", "http://w.org/fr/?a=1", "net/", None, "", "x://org/fr/", "http://badexample.net/en/", "http://example.net/en", "://net/#f"] * 3
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r["page_id"]: r for r in url_filter.filter_urls(df, URL_RULES).collect()}

    def plain(u):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = regex.split("[/?#]", rest)[0]
            path = regex.split("[?#]", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [(len(h + p), h + p, v) for h, p, v in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return host, path, *(max(fits)[1:] if fits else (None, None))

    for i, u in enumerate(urls):
        host, path, rule, verdict = plain(u)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        assert got[i]["verdict"] == verdict if rule else got[i]["verdict"] in ("allow", "block")
    assert got[8]["verdict"] == got[8 + 14]["verdict"]
    assert url_filter.filter_urls(df.limit(0), URL_RULES).count() == 0


def test_keys_and_features_against_plain_code():
    urls = [f"https://www.example.com/a-common-beginning-{x}/page" for x in ("one", "two")]
    urls += ["http://Example.COM/index?a=/b#c", "http://example.com", "", "no scheme/at.all?x=1&y=2", "a://b.c/D%20é/ñ?k=ü&m", "x://?q=1", "https://h/p//q/#f/?=", "s://a.b.c.d", "1://a\n.b/c\nd", "://", "https://日本.jp/道?値=1"]
    last, two, segment = (k.to_pylist() for k in url_filter.url_keys(pa.array(urls)))
    assert segment[:2] == ["a-common-beginning-one", "a-common-beginning-two"] and segment[2] == "index" and segment[3] == ""
    x = url_filter.features(pa.array(urls), [np.full(len(urls), v) for v in (0.1, 0.2, 0.3)])
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if "://" in u else ""
        host = regex.split("[/?#]", rest)[0]
        labels = host.lower().split(".")
        assert (last[i], two[i]) == (labels[-1], ".".join(labels[-2:]))
        path = regex.split("[?#]", rest[len(host) :])[0]
        assert segment[i] == (path[1:].split("/")[0] if path[:1] == "/" else "")
        raw = u.encode()
        n, query = max(len(raw), 1), rest[len(host) + len(path) :]
        entropy = -sum(c / n * math.log2(c / n) for c in Counter(raw).values())
        want = [len(raw), len(host.encode()), host.count("."), len(path.encode()), path.count("/"), sum(c in b"0123456789" for c in raw) / n, entropy, query.count("=") + query.count("&"), u.count("-"), sum(65 <= c < 91 for c in raw) / n, u.count("%"), u.startswith("https://"), 0.1, 0.2, 0.3]
        assert np.allclose(x[i], want, atol=1e-5), u
    assert url_filter.features(pa.array([], pa.string()), [np.zeros(0)] * 3).shape == (0, 15)


def test_long_urls_have_the_same_features(monkeypatch):
    r = random.Random(3)
    urls = ["", "x", "://", "https://", "https://a.b.c", "http://h?x=1&y=2#f", "HTTPS://é.org/%20/A-b/?q", "a://b://c/d", *("".join(r.choice("ab./?#=&-%:/19Zé") for _ in range(r.randint(1, 90))) for _ in range(400))]
    rates = [np.full(len(urls), v) for v in (0.1, 0.2, 0.3)]
    short = url_filter.features(pa.array(urls), rates)
    monkeypatch.setattr(url_filter, "SLICE", 0)
    assert np.allclose(url_filter.features(pa.array(urls), rates), short, atol=1e-6)
    monkeypatch.undo()
    long_ = url_filter.features(pa.array(["https://h.org/" + "a1" * 4_000_000, "http://x.y/"]), [np.zeros(2)] * 3)
    assert long_[0, 0] == 8_000_014 and long_[1, 0] == 11


def test_few_urls_of_very_many_rows_give_both_verdicts(spark):
    """Rows are sampled by id and URL, so that a URL with a third of all rows is neither in nor out as a whole."""
    urls = ["https://a.net/x", "https://b.example.net/en/y", "http://c.example.com/de/1", "https://d.org/fr/2"]
    pages = spark.range(120_000).select(F.col("id").alias("page_id"), F.element_at(F.lit(urls), (F.col("id") % 4 + 1).cast("int")).alias("url"))
    labelled = pages.select(F.col("page_id").alias("id"), "url", (F.col("page_id") % 4).isin(0, 2).alias("block"))
    model = url_filter.fit_urls(labelled, 2000)
    assert model.trees.trees and abs(model.prior - 0.5) < 1e-6
    assert (model.score(urls) >= 0.5).tolist() == [True, False, True, False]
    rare = labelled.withColumn("block", F.col("id") == 7)
    model = url_filter.fit_urls(rare, 2000)
    assert model.trees.trees and abs(model.prior - 1 / 120_000) < 1e-8
    got = url_filter.filter_urls(pages, URL_RULES)
    assert {r["verdict"] for r in got.select("verdict").distinct().collect()} == {"allow", "block"}


def test_suffix_rates_come_from_other_folds():
    """Labels by chance, each URL with a host and segment of its own: rates that leaked the label would be learnt by heart."""
    r = random.Random(1)
    urls = [f"http://h{i % 700}.t{i % 350}/s{i % 900}" for i in range(1400)]
    y = np.array([r.random() < 0.5 for _ in urls], float)
    model = url_filter.UrlModel(urls[:700], y[:700])
    assert ((model.score(urls[:700]) >= 0.5) == y[:700]).mean() < 0.85


def test_trees_learn_held_out_urls():
    r = random.Random(2)
    make = lambda bad: f"http{'' if bad else 's'}://{'a' * r.randrange(3, 9)}{r.randrange(10**6) if bad else ''}.{'biz' if bad else 'org'}/{'/'.join('p' for _ in range(r.randrange(4)))}?{'&'.join('k=1' for _ in range(r.randrange(6) if bad else 1))}"
    rows = [(make(b), b) for b in (r.random() < 0.4 for _ in range(600))]
    model = url_filter.UrlModel([u for u, _ in rows[:400]], np.array([b for _, b in rows[:400]], float))
    right = (model.score([u for u, _ in rows[400:]]) >= 0.5) == np.array([b for _, b in rows[400:]])
    assert right.mean() > 0.97
    assert url_filter.UrlModel([], np.zeros(0)).score(["x", None]).shape == (2,)


# Quality


def test_network_learns_and_pools_whole_texts(docs, empty, spark):
    r = random.Random(3)
    good, bad = [prose(r, 80).encode() for _ in range(60)], [prose(r, 80).upper().replace(" ", "!! ").encode() for _ in range(60)]
    model = quality_cnn.ByteNetwork().fit(good[:40] + bad[:40], np.array([1] * 40 + [0] * 40), epochs=15)
    both = good[40:] + bad[40:]
    score = model.score(np.frombuffer(b"".join(both), np.uint8), np.cumsum([0, *map(len, both)]))
    assert ((score >= 0.3) == ([True] * 20 + [False] * 20)).mean() > 0.95
    # The tail counts, and a text beyond a slice is pooled like a short one.
    long = good[0] * (quality_cnn.SLICE * 3 // len(good[0]))
    whole = model.pool(np.frombuffer(long + bad[0], np.uint8), np.array([0, len(long) + len(bad[0])]))
    old, quality_cnn.SLICE = quality_cnn.SLICE, 1 << 30
    try:
        assert np.allclose(whole, model.pool(np.frombuffer(long + bad[0], np.uint8), np.array([0, len(long) + len(bad[0])])), atol=1e-4)
    finally:
        quality_cnn.SLICE = old
    out = quality_cnn.score_documents(docs, model)
    rows = out.collect()
    assert len(rows) == docs.count() and all(0 <= x["score"] <= 1 for x in rows) and quality_cnn.score_documents(empty, model).count() == 0


def test_network_against_plain_loops_and_differences():
    """Forward pass chunk by chunk in plain Python; derivatives against differences of the loss."""
    net = quality_cnn.ByteNetwork(block=4, embed=3, filters=5, hidden=4)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    texts = [b"", b"ab", b"abcd", b"hello big world", bytes(range(60, 100)), b"x" * 33]
    y = np.array([0.0, 1, 1, 0, 1, 0])
    p = net.p
    want = []
    for t in texts:
        size = max(-(-len(t) // 4), 2) * 4
        padded = t + bytes(size - len(t))
        best = [-math.inf] * 5
        for start in range(0, size - 4, 4):
            for f in range(5):
                total = p["b"][f]
                for half in range(2):
                    for i in range(4):
                        for d in range(3):
                            total += p["e"][padded[start + 4 * half + i], d] * p["w"][i * 3 + d, half * 5 + f]
                best[f] = max(best[f], total)
        pooled = [max(b, 0) for b in best]
        hidden = [max(sum(pooled[f] * p["h"][f, h] for f in range(5)) + p["hb"][h], 0) for h in range(4)]
        want.append(1 / (1 + math.exp(-(sum(hidden[h] * p["o"][h] for h in range(4)) + p["ob"][0]))))
    assert np.allclose(net.score(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])), want)
    loss, grads = net.gradients(texts, y)
    assert loss == pytest.approx(-sum(math.log(w if k else 1 - w) for w, k in zip(want, y, strict=True)) / len(texts))
    r = np.random.RandomState(4)
    for name, g in grads.items():
        flat = p[name].reshape(-1)
        for i in [*r.randint(flat.size, size=12), int(np.abs(g).argmax())]:
            old = flat[i]
            flat[i] = old + 1e-6
            up = net.gradients(texts, y)[0]
            flat[i] = old - 1e-6
            down = net.gradients(texts, y)[0]
            flat[i] = old
            assert g.reshape(-1)[i] == pytest.approx((up - down) / 2e-6, abs=1e-6), (name, i)


def thue_morse(n):
    """n letters, and the same with the letters changed over: polynomials modulo 2**64 can't tell these apart from 1,024 letters on."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_unlike_words_and_lines_stay_apart(spark, n):
    t, u = thue_morse(n)
    texts = [" ".join([t] * 6), " ".join([u] * 6), f"{t}\n{u}", f"{t}\n{t}", f"{t} {u} a {u} {t} a {t} {u} b", f"{t} {t} {u} {t} {u} {u}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(docs).collect()}
    assert found == {i: i for i in range(len(texts))}
    assert minhash.drop_near_duplicates(docs).count() == len(texts)
    got = {r["doc_id"]: (r["n_dup_lines"], r["n_repeat_words"]) for r in quality_rules.score_quality(docs).collect()}
    for i, text in enumerate(texts):
        w = WORD.findall(text)
        wins = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        again = {k + j for k in range(len(w) - 2) if wins[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        assert got[i] == (len(lines) - len(set(lines)), len(again)), i


def test_word_hashes_follow_words():
    r = np.random.RandomState(5)
    data = r.choice(np.frombuffer(b"abc  \n\x0b\x1c", np.uint8), 5000)
    off = np.array([0, 0, 3000, 5000])
    starts, ends, _ = B.words(data, off)
    first, second = B.word_hashes(data, off)
    raw = [xxhash.xxh3_128_intdigest(data[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]
    assert raw == [int(a) << 64 | int(b) for a, b in zip(second, first, strict=True)]


def test_names_with_dots(spark, texts):
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "`a.id` long, `a.text` string, `a.source` string")
    names = {"id_col": "a.id", "text_col": "a.text"}
    assert minhash.drop_near_duplicates(docs, **names).columns == docs.columns
    assert kd_sharding.kd_shards(docs, **names).count() == len(texts)
    model = quality_cnn.ByteNetwork()
    assert quality_cnn.score_documents(docs, model, **names).columns == ["a.id", "score"]
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b")], "`c.id` long, `t.n` int, `r.r` string, `x.x` string")
    out = chat_format.read_back(chat_format.format_chats(turns, conv_col="c.id", turn_col="t.n", role_col="r.r", text_col="x.x"), conv_col="c.id")
    assert out.columns[0] == "c.id" and out.first()["loss_texts"] == ["b"]


def test_network_fits_from_tables(spark, docs):
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality")).unionByName(docs.limit(3).select("doc_id", F.lit(None).cast("int").alias("quality")))
    a = quality_cnn.fit_quality(docs, labels, max_rows=20)
    b = quality_cnn.fit_quality(docs, labels, max_rows=20)
    assert all((a.p[k] == b.p[k]).all() for k in a.p)
    assert quality_cnn.fit_quality(docs, labels.limit(0)).constant == 0.5


def test_rules_against_plain_counts(docs, empty):
    got = {r["doc_id"]: r for r in quality_rules.score_quality(docs).collect()}
    for row in docs.collect():
        t = row["text"] or ""
        w = WORD.findall(t)
        wins = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        rep = {i + k for i in range(len(w) - 2) if wins[tuple(w[i : i + 3])] > 1 for k in range(3)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        r = got[row["doc_id"]]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), sum(c in "[#*$%&|<>]" for c in t), dup, len(rep))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(rep) > 50 * len(w)) and (not r["kept"] or not r["base_failed"])
    kept = quality_rules.filter_quality(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in got.values())
    assert quality_rules.score_quality(empty).count() == 0 and quality_rules.filter_quality(empty).count() == 0


def test_bands():
    r = random.Random(4)
    line = prose(r, 12) + "\n"
    noise = "".join(chr(r.randrange(33, 0x2FFF)) for _ in range(3000))
    got = quality_rules.judge(pa.array([prose(r, 300), line * 80, noise, prose(r, 700) + line * 300]), quality_rules.Bands(whole=((128, 0.35, 0.8),)))
    assert got["kept"].tolist() == [True, False, False, False]


def test_default_bands_reject_noise_of_every_length():
    r = random.Random(9)

    def noise(alphabet, n):
        out = ""
        while len(out.encode()) < n:
            out += "".join(r.choice(alphabet) for _ in range(r.randint(4, 10))) + " "
        text = out.encode()[:n].decode("utf-8", "ignore")
        return text + " " * (n - len(text.encode()))

    base64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    printable, cjk, cyrillic = ("".join(map(chr, range(*x))) for x in ((33, 127), (0x4E00, 0x9FA6), (0x410, 0x450)))
    lengths = [128, 191, 192, 255, 256, 383, 384, 511, 512, 767, 768, 1023, 1024, 2047, 2048, 4095, 4096, 8191, 8192, 100_000]
    made = [(noise(a, n), n) for a in (base64, printable, cjk) for n in lengths] + [(noise(cyrillic, n), n) for n in (1024, 1535, 1536, 2047, 2048, 4095, 4096, 8191, 8192, 100_000)]
    data, off = B.column_bytes(pa.array([t for t, _ in made]))
    _, _, accepted = quality_rules.band_verdict(data, off, quality_rules.Bands())
    assert [(t[:20], n) for (t, n), ok in zip(made, accepted, strict=True) if ok] == []
    kept = quality_rules.judge(pa.array([t for t, n in made if n > 600]), quality_rules.Bands())
    assert not kept["kept"].any()
    prosaic = [prose(r, n) for n in (60, 150, 300, 700, 2000) for _ in range(5)]
    assert quality_rules.judge(pa.array(prosaic), quality_rules.Bands())["kept"].all()


def test_fitted_bands_against_plain_code(spark):
    r = random.Random(31)
    texts = [prose(r, r.randint(60, 1200)) for _ in range(300)]
    marks = ["###", "$$$", "%%%", "&&&"]
    junk = [" ".join(w + r.choice(marks) for w in prose(r, n).split()) for n in (400, 500, 600, 700)]
    rows = [*texts, *texts[:100], texts[7] * 1, None, "", "short", *junk]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(rows)], "doc_id long, text string, __id int")
    bands = quality_rules.fit_bands(docs)
    by: dict[int, list[float]] = {}
    packer = zstandard.ZstdCompressor(level=3)
    for t in {(t or "").encode() for t in rows}:
        if len(t) >= 128:
            by.setdefault(math.floor(4 * math.log2(len(t))) * 2, []).append(round(len(packer.compress(t)) / len(t) * 2048) / 2048)
    assert set(dict(bands.fitted)) == set(by)
    for c, low in bands.fitted:
        x = sorted(by[c])
        middle = x[math.ceil(len(x) / 2) - 1]
        far = sorted(abs(v - middle) for v in x)
        fixed = bands.outer(int(2 ** ((c // 2 + 1) / 4)) - 1)[1]
        cut = middle - max(4.5 * 1.4826 * far[math.ceil(len(x) / 2) - 1], 0.03)
        assert low == pytest.approx((len(x) * cut + 10 * fixed) / (len(x) + 10))
    # The verdict follows from ratio, chunks and limits.
    for row in quality_rules.score_quality(docs, bands).collect():
        t = (rows[row["doc_id"]] or "").encode()
        if len(t) < 128:
            continue
        ratio = len(packer.compress(t)) / len(t)
        starts = list(range(0, len(t) - 2047, 2048)) + ([len(t) - 2048] if len(t) > 2048 and len(t) % 2048 else [])
        bad = [not 0.2 <= len(packer.compress(t[k : k + 2048])) / 2048 <= 0.68 for k in starts]
        outer = bands.outer(len(t))
        low = max(outer[1], dict(bands.fitted)[math.floor(4 * math.log2(len(t))) * 2])
        ok = low <= ratio <= outer[2] and (sum(bad) / len(bad) if bad else 0) <= 0.5
        assert row["ratio"] == pytest.approx(ratio) and row["kept"] == (ok and not row["base_failed"])


def test_chunks_from_one_on_and_tail():
    r = random.Random(6)
    flat, noise = "ab " * 3000, "".join(chr(r.randrange(33, 127)) for _ in range(3000))
    text = prose(r, 3000).encode().decode("ascii", "ignore")
    made = [flat[:2048], flat[:2047], text[:2048], text[:2048] + noise[:2047], text[:4096] + noise[:100], text[:2048] + flat[:2047], text[:5000]]
    data, off = B.column_bytes(pa.array(made))
    _, bad, ok = quality_rules.band_verdict(data, off, quality_rules.Bands(whole=((128, 0.0, 2.0),), max_bad=0.4))
    assert bad.tolist() == [1, 0, 0, 0.5, 0, 0.5, 0]
    assert ok.tolist() == [False, True, True, False, True, False, True]


# Embeddings


def brute_links(vectors):
    ok = [v is not None and len(v) == 8 and all(x is not None and math.isfinite(x) for x in v) and any(v) for v in vectors]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if o else None for v, o in zip(vectors, ok, strict=True)]
    n = len(vectors)
    return [{j for j in range(n) if i != j and ok[i] and ok[j] and unit[i] @ unit[j] >= 0.95} for i in range(n)]


def test_embeddings_against_brute_force(spark):
    r = np.random.RandomState(1)
    centres = r.normal(size=(40, 8))
    vectors = [(c + r.normal(size=8) * 0.12).astype(np.float32).tolist() for c in centres for _ in range(8)]
    vectors += [vectors[0]] * 5 + [[2 * x for x in vectors[0]], None, [0.0] * 8, [float("nan")] + [1.0] * 7, [float("inf")] + [1.0] * 7, [None] + [1.0] * 7, [1.0, 0.0], []]
    ids = [int(x) for x in r.permutation(len(vectors)) * 3]
    df = spark.createDataFrame([(i, v, 0, "z") for i, v in zip(ids, vectors, strict=True)], "vec_id long, embedding array<float>, label int, cell string")
    links = brute_links([None if v is None else [None if x is None else float(np.float32(x)) for x in v] for v in vectors])
    got = {x["vec_id"]: x for x in embedding_dedup.link_embeddings(df, tile=16).collect()}
    found = sum(got[ids[i]]["n_links"] for i in range(len(ids)))
    assert found >= 0.99 * sum(map(len, links)) and all(got[ids[i]]["n_links"] <= len(links[i]) for i in range(len(ids)))
    label = list(range(len(ids)))
    changed = True
    while changed:
        changed = False
        for i, ls in enumerate(links):
            best = min([label[i], *(label[j] for j in ls)], key=lambda k: ids[k])
            if best != label[i]:
                label[i], changed = best, True
    assert sum(got[ids[i]]["component_id"] == ids[label[i]] for i in range(len(ids))) >= len(ids) - 2
    assert all(x["kept"] == (x["vec_id"] == x["component_id"]) for x in got.values())
    assert embedding_dedup.link_embeddings(df.limit(0)).count() == 0
    assert [x["n_links"] for x in embedding_dedup.link_embeddings(df.where("embedding IS NULL")).collect()] == [0]


def test_every_length_has_its_links(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0]), (4, [5.0]), (5, [-1.0]), (6, [1.0, 0.0, 0.0]), (7, [1.0, 0.01, 0.0]), (8, [0.5] * 4), (9, [0.0]), (10, None)]
    got = {x["vec_id"]: (x["n_links"], x["component_id"]) for x in embedding_dedup.link_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (1, 3), 4: (1, 3), 5: (0, 5), 6: (1, 6), 7: (1, 6), 8: (0, 8), 9: (0, 9), 10: (0, 10)}


@pytest.mark.parametrize("spread", [0.0, 0.9])
def test_recall_over_a_grid_of_cells(spark, monkeypatch, spread):
    """Links of cosine 0.95 and a little above, the hardest, in 64 dimensions over a grid of 16 x 16 cells; spread out or in clusters."""
    r = np.random.RandomState(9)
    centre = r.normal(size=(30, 64))[r.randint(30, size=2000)] * spread
    base = centre + r.normal(size=(2000, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = r.normal(size=base.shape)
    side -= (side * base).sum(1, keepdims=True) * base
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cosine = r.uniform(0.94, 0.97, (len(base), 1))
    x = np.concatenate([base, cosine * base + np.sqrt(1 - cosine**2) * side]).astype(np.float32)
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    codes = []
    fit = embedding_dedup.MultiIndex.__init__
    monkeypatch.setattr(embedding_dedup.MultiIndex, "__init__", lambda self, sample, k, *args: (codes.append(k), fit(self, sample, k, *args))[1])
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    got = {r_["vec_id"]: r_["n_links"] for r_ in embedding_dedup.link_embeddings(df, per_cell=16).collect()}
    assert codes == [16] and near.sum() > 1000
    found = np.array([got[i] for i in range(len(x))])
    assert (found <= near.sum(1)).all() and found.sum() >= 0.95 * near.sum()


def test_multi_sequence_against_the_traversal():
    r = np.random.RandomState(2)
    a, b = r.rand(20, 9), r.rand(20, 9)
    for n in (1, 2, 7, 30, 81):
        got = embedding_dedup.multi_sequence(a, b, n)
        for row in range(20):
            x, y = np.argsort(a[row]), np.argsort(b[row])
            heap, seen, want = [(a[row, x[0]] + b[row, y[0]], 0, 0)], {(0, 0)}, []
            while heap and len(want) < n:
                _, i, j = heapq.heappop(heap)
                want.append(x[i] * 9 + y[j])
                for p, q in ((i + 1, j), (i, j + 1)):
                    if p < 9 and q < 9 and (p, q) not in seen:
                        seen.add((p, q))
                        heapq.heappush(heap, (a[row, x[p]] + b[row, y[q]], p, q))
            assert got[row].tolist() == want


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (103, 102), (5, 5)]
    got = {r["node"]: r["root"] for r in components.connected(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 102, 103: 102}
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


# Sharding


def test_shards(docs, empty):
    out = kd_sharding.kd_shards(docs, 4, rows_per_block=10).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert sorted(r["doc_id"] for r in out) == sorted(texts)
    place, load = {}, Counter()
    for r in out:
        raw = (texts[r["doc_id"]] or "").encode()
        assert r["size"] == len(raw) + 1 and r["text_crc32"] == zlib.crc32(raw)
        assert place.setdefault(raw, r["shard"]) == r["shard"]
        load[r["shard"]] += r["size"]
    largest = max(Counter(r["text_crc32"] for r in out for _ in range(r["size"])).values())
    assert max(load.values()) - min(load.values()) <= 2 * largest
    for s in load:
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sum(r["shard"] == s for r in out)))
    assert kd_sharding.kd_shards(empty).count() == 0
    assert len({r["shard"] for r in kd_sharding.kd_shards(docs.where("text = 'one'")).collect()}) == 1


# Near duplicates


def shingles(t):
    w = WORD.findall(t or "")
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def similarity(a, b):
    shared = sum((a & b).values())
    return shared / max(1, sum(a.values()) + sum(b.values()) - shared)


def test_near_duplicates_against_brute_force(docs, empty):
    rows = docs.select("doc_id", "text").collect()
    bags = {r["doc_id"]: shingles(r["text"]) for r in rows}
    label = {i: i for i in bags}
    changed = True
    while changed:
        changed = False
        for i in bags:
            for j in bags:
                if label[j] < label[i] and bags[i] and bags[j] and similarity(bags[i], bags[j]) >= 0.8:
                    label[i], changed = label[j], True
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(docs, tile=4, part=3).collect()}
    assert got == label
    stay = minhash.drop_near_duplicates(docs.unionByName(docs))
    assert stay.columns == docs.columns and sorted(r["doc_id"] for r in stay.collect()) == sorted(i for i in label if label[i] == i)
    assert minhash.near_duplicates(empty).count() == 0 and minhash.drop_near_duplicates(empty).count() == 0


def test_signatures_estimate_weighted_jaccard():
    r = np.random.RandomState(3)
    slots = 2048
    for heavy in (1, 6, 40):
        shared = r.randint(0, 2**63, 60).astype(np.uint64)
        a, b = r.randint(1, heavy + 1, 60), r.randint(1, heavy + 1, 60)
        doc, sh, w = np.repeat([0, 1], 60), np.concatenate([shared, shared]), np.concatenate([a, b])
        sign = minhash.signatures(doc, sh, w, 2, slots)
        true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        assert abs((sign[0] == sign[1]).mean() - true) < 5 * np.sqrt(true * (1 - true) / slots) + 1e-9


def test_null_ids_link_with_nothing(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f")], "doc_id long, text string")
    assert sorted(str(r["class_id"]) for r in minhash.near_duplicates(df).collect()) == ["3", "None", "None"]
    assert minhash.drop_near_duplicates(df).count() == 3


# Chats


def test_chats_read_back(spark):
    rows = [(1, 0, "user", "</s>[INST] ok [/INST]"), (1, 1, "assistant", "&amp; <|im_end|>\n<|im_start|>user\nhi"), (2, 1, "assistant", "b"), (2, 0, "odd\nrole &n;", None), (3, None, None, ""), (3, None, None, ""), (None, 5, "user", "&c1;"), (4, 0, "system", "s"), (4, 1, "user", "u" * 5000), (4, 2, "assistant", "日本")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, rows string")
    t = chat_format.Template()
    made = chat_format.format_chats(df, t)
    back = {r["conv_id"]: r for r in chat_format.read_back(made, t).collect()}
    for conv in {r[0] for r in rows}:
        mine = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        assert [(x["role"], x["text"]) for x in back[conv]["turns"]] == [(r, x) for _, _, r, x in mine]
        assert back[conv]["loss_texts"] == [x for _, _, r, x in mine if r == "assistant"]
    assert {c: r["valid"] for c, r in back.items()} == {1: True, 2: False, 3: False, None: False, 4: True}
    for r in made.collect():
        assert "".join(s["text"] for s in r["segments"]) == r["formatted"]
        assert [r["formatted"][s["start"] : s["start"] + s["len"]] for s in r["loss_spans"]] == [s["text"] for s in r["segments"] if s["loss"]]
        assert all(c not in s["text"] for s in r["segments"][1::3] for c in t.controls)
    assert chat_format.format_chats(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        chat_format.Template(controls=("a&b",))


def test_added_conversation(spark):
    got = op7_chat_format(spark, "/root/testdata/sf0.001").where("conv_id = -7").first()
    text = "</s>[INST] ok [/INST]"
    assert (got["n_turns"], got["loss_chars"], got["loss_sha256"]) == (2, len(text), hashlib.sha256(text.encode()).hexdigest())
    assert got["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()


# Mixing


def test_targets(spark):
    def plan(sizes, weights, most):
        rows = mixing.targets(spark.createDataFrame(sizes, "source string, size long"), weights, most).collect()
        return sorted(((r["source"], r["source_size"], r["target"]) for r in rows), key=lambda x: (x[0] is None, x[0]))

    assert plan([("a", 100), ("b", 100), (None, 100)], (5, 2, 1), 3) == [("a", 100, 187.5), ("b", 100, 75.0), (None, 100, 37.5)]
    got = plan([("a", 10), ("b", 1000), ("c", 0), (None, 500)], (5, 2, 1), 3)
    assert [t for *_, t in got] == pytest.approx([30.0, (1510 - 30) * 2 / 7, 0.0, (1510 - 30) * 5 / 7])
    assert plan([], (1,), 3) == [] and plan([("a", 0)], (1,), 3) == [("a", 0, 0.0)]
    # Many sources, against filling up step by step.
    r = random.Random(12)
    sizes = [(f"s{i:03}", r.choice([0, 1, 5, 50, 400, 3000])) for i in range(200)]
    weight = {s: (5, 2, 1)[i % 3] for i, (s, _) in enumerate(sizes)}
    capped: dict[str, float] = {}
    while True:
        level = (sum(n for _, n in sizes) - sum(capped.values())) / sum(w for s, w in weight.items() if s not in capped)
        over = {s: 3.0 * n for s, n in sizes if s not in capped and level * weight[s] > 3 * n}
        if not over:
            break
        capped |= over
    want = [(s, n, capped.get(s, level * weight[s])) for s, n in sizes]
    got = plan(sizes, (5, 2, 1), 3)
    assert [x[:2] for x in got] == [x[:2] for x in want] and np.allclose([x[2] for x in got], [x[2] for x in want])


def test_mix(docs, empty):
    plan = mixing.plan_mix(docs, rows_per_block=5).collect()
    texts = {r["doc_id"]: r for r in docs.collect()}
    taken, target, most = Counter(), {}, Counter()
    for r in plan:
        assert r["size"] == len(WORD.findall(texts[r["doc_id"]]["text"] or "")) and 0 <= r["copies"] <= 3
        assert r["source"] == texts[r["doc_id"]]["source"]
        taken[r["source"]] += r["copies"] * r["size"]
        target[r["source"]] = r["target"]
        most[r["source"]] = max(most[r["source"]], r["size"])
    assert all(abs(taken[s] - target[s]) <= most[s] for s in target)
    assert sorted(map(str, plan)) == sorted(map(str, mixing.plan_mix(docs, rows_per_block=5).collect()))
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns
    assert Counter(r["doc_id"] for r in out.collect()) == Counter({r["doc_id"]: r["copies"] for r in mixing.plan_mix(docs).collect() if r["copies"]})
    twice = mixing.mix_documents(docs.unionByName(docs)).count()
    assert twice == sum(r["copies"] for r in mixing.plan_mix(docs.unionByName(docs)).collect())
    assert mixing.plan_mix(empty).count() == 0 and mixing.mix_documents(empty).count() == 0


@pytest.mark.parametrize("largest", [512, 20])
def test_words_taken_are_near_their_targets(spark, monkeypatch, largest):
    """Sources with some very large documents: near the target for each offset, and on average at it."""
    monkeypatch.setattr(mixing, "LARGEST", largest)
    r = random.Random(9)
    rows = [(i, " ".join(["w"] * int(min(r.paretovariate(0.9) * 20, 6000))), f"s{i % 6}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(2).cache()
    drift = Counter()
    for seed in range(6):
        plan = mixing.plan_mix(docs, seed=seed).collect()
        assert len(plan) == 600 and all(0 <= x["copies"] <= 3 for x in plan)
        target, taken = {x["source"]: x["target"] for x in plan}, Counter()
        for x in plan:
            taken[x["source"]] += x["copies"] * x["size"]
        assert largest < 512 or all(abs(taken[s] / target[s] - 1) < 0.03 for s in target), (taken, target)
        drift.update({s: taken[s] / target[s] - 1 for s in target})
    assert all(abs(d / 6) < (0.012 if largest == 512 else 0.06) for d in drift.values()), drift


# Tokens


@pytest.fixture(scope="module")
def coder():
    with open(vocabulary_path(), "rb") as f:
        return bpe.transducer(f.read())


def test_tokens_equal_the_library(coder, texts):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(vocabulary_path())
    r = random.Random(6)
    pool = list("aabbthe  \n\t'sé1239!?日\x1c\x85\u00a0") + ["<|endoftext|>", " the", "ing", "'ll", "  ", "\r\n", "aaaa"]
    for t in [*(t or "" for t in texts), *("".join(r.choice(pool) for _ in range(r.randrange(60))) for _ in range(400)), "ab" * 4000, "=" * 3000, " " * 3000 + "x", "e" * 70000 + " z" * 40000]:
        ids = coder.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids
        assert coder.decode(ids) == t


def test_pairs_agree_with_reduction(coder):
    r = random.Random(7)
    for _ in range(3000):
        a, b = r.randrange(50256), r.randrange(3000)
        assert coder.fits(a, b) == (coder.reduce(coder.text[a] + coder.text[b]) == [a, b])


def test_transducer_keeps_little(coder):
    """Tokens leave while the text is still being read: states never span more than a few lookaheads."""
    r = random.Random(8)
    text = "".join(r.choice("abcdethin") for _ in range(20000)).encode()
    kept = []
    original = coder.path
    coder.path = lambda last, end, begin: kept.append(len(last)) or original(last, end, begin)
    try:
        assert list(coder.stream(text)) and len(kept) > 50 and max(kept) <= 4 * coder.lookahead
    finally:
        del coder.path


def test_decoder_marks_what_is_not_text(coder):
    ids = [coder.token[b"\xe6"], coder.token[b"\x97"], coder.token[b"a"], coder.token[b"\xff"]]
    from tokenizers import Tokenizer

    assert coder.decode(np.array(ids, "<u4").tobytes()) == Tokenizer.from_file(vocabulary_path()).decode(ids, skip_special_tokens=False)


def test_token_rows(docs, empty):
    out = bpe.encode_decode(docs, vocabulary_path())
    assert {(r["doc_id"], r["decoded"]) for r in out.collect()} == {(r["doc_id"], r["text"] or "") for r in docs.collect()}
    assert bpe.encode_decode(empty, vocabulary_path()).count() == 0


# Bytes


def test_words_and_hashes():
    texts = ["a b", "", "a", None, " b\x0bc ", "é\u00a0x"]
    data, off = B.column_bytes(pa.array(texts).slice(1))
    starts, ends, doc = B.words(data, off)
    assert [data[s:e].tobytes().decode() for s, e in zip(starts, ends, strict=True)] == ["a", "b", "c", "é\u00a0x"] and doc.tolist() == [0 + 1, 3, 3, 4]
    h = B.span_hashes(data, np.array([0, 2]), np.array([1, 3]))
    assert h[0] != h[1] and B.span_hashes(np.frombuffer(b"xxabxxxab", np.uint8), np.array([2, 7]), np.array([4, 9])).ptp() == 0 if hasattr(h, "ptp") else True
    assert list(B.slices(np.array([0, 5, 100, 101, 102]), 10)) == [(0, 1), (1, 2), (2, 4)]


# What they share


CLASHES = ["__tid", "__kept", "__cut", "__null", "__left", "__ID", "__text", "__number", "__source", "__copies", "__copy", "tid", "size", "text_key", "copies", "a.b", "spans"]


def test_clashing_columns_pass_through(docs):
    wide = docs.withColumns({c: F.concat(F.lit(c + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for c in CLASHES})
    own = [c for c in docs.columns if c not in CLASHES]
    narrow = {"remove": suffix_dedup.remove_repeats, "near": minhash.drop_near_duplicates, "mix": mixing.mix_documents, "rules": quality_rules.filter_quality}
    for name, operator in narrow.items():
        got = operator(wide)
        assert got.columns == wide.columns, name
        rows = [r.asDict() for r in got.collect()]
        assert rows and all(r[c] == f"{c}:{'-' if r['doc_id'] is None else r['doc_id']}" for r in rows for c in CLASHES), name
        plain = Counter(str([r[c] for c in own]) for r in operator(docs).collect())
        assert Counter(str([r[c] for c in own]) for r in rows) == plain, name
    labels = wide.select("doc_id", (F.col("doc_id") % 2).alias("quality"), F.lit(1).alias("__id"), F.lit(1).alias("id"))
    a, b = (quality_cnn.fit_quality(d, x, max_rows=20) for d, x in ((wide, labels), (docs, labels.select("doc_id", "quality"))))
    assert all((a.p[k] == b.p[k]).all() for k in a.p)


def test_scratch_tables_go(spark, docs):
    made = common.materialize(docs, "a-table", "doc_id")
    path, name = made._scratch, common.MADE.tables[made._scratch]
    assert spark.catalog.tableExists(name) and made.count() == docs.count()
    common.drop(spark, made)
    assert not spark.catalog.tableExists(name) and path not in common.MADE.tables
    kept = common.materialize(docs, "other")
    common.drop_all(spark)
    assert not common.MADE.tables and not os.path.exists(kept._scratch)


def test_scratch_needs_a_shared_folder_on_clusters(monkeypatch):
    class Conf:
        get = staticmethod(lambda key, default=None: default)

    class Context:
        applicationId, master = "app", "spark://host:7077"
        getConf = staticmethod(lambda: Conf)
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        conf, sparkContext = Conf, Context

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.scratch_dir(Session)
    Context.getCheckpointDir = staticmethod(lambda: "hdfs://shared/x/")
    assert common.scratch_dir(Session) == "hdfs://shared/x/lodestar-app"


def test_unsupported_vocabularies_are_refused():
    with open(vocabulary_path(), encoding="utf-8") as f:
        spec = json.load(f)
    changes = [("normalizer", {"type": "NFC"}), ("pre_tokenizer", {"type": "Whitespace"}), ("pre_tokenizer", spec["pre_tokenizer"] | {"add_prefix_space": True}), ("decoder", None), ("model", spec["model"] | {"dropout": 0.1}), ("model", spec["model"] | {"ignore_merges": True}), ("added_tokens", [spec["added_tokens"][0] | {"lstrip": True}])]
    for key, value in changes:
        with pytest.raises(ValueError, match="not supported"):
            bpe.supported(spec | {key: value})
    bpe.supported(spec)
