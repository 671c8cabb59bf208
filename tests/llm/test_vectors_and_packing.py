"""Whitening, vector codes and packing against brute force and on awkward rows."""

import hashlib
import json
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import packing, vector_codes, vectors, whitening
from lodestar.llm.queries import vocabulary_path

VECTORS = "vec_id long, embedding array<float>, label int, `x` int, `v.w` string, length string"


def vector_rows(n=300, d=16, seed=3, far=0.0):
    r = np.random.RandomState(seed)
    base = r.normal(size=(n, d)) @ r.normal(size=(d, d)) + far
    rows = [(int(i * 7 % 1009), [float(np.float32(v)) for v in base[i]], None if i % 5 == 0 else i % 3) for i in range(n)]
    rows += [(5000 + k, rows[k][1], rows[k][2]) for k in range(20)]  # equal vectors
    rows += [(rows[0][0], rows[1][1], 1), rows[2], rows[2]]  # an id twice, rows that repeat
    nan, inf = float("nan"), float("inf")
    bad = [None, [], [None] * d, [1.0] * (d - 1) + [nan], [inf] + [0.0] * (d - 1), [1.0, None] + [2.0] * (d - 2), [1.0] * (d + 1), [0.5, 0.5]]
    return [*rows, (None, rows[3][1], 2)], [(9000 + i, v, 1) for i, v in enumerate(bad)]


@pytest.fixture
def table(spark):
    def make(good, bad):
        rows = [(*r, 1, "a", "b") for r in good + bad]
        random.Random(2).shuffle(rows)
        return spark.createDataFrame(rows, VECTORS).repartition(3)

    return make


def exact_covariance(x):
    """n, sums and the covariance as fractions, entry by entry."""
    n, d = len(x), len(x[0])
    sums = [sum(r[j] for r in x) for j in range(d)]
    y = [[n * r[j] - sums[j] for j in range(d)] for r in x]
    return n, sums, [[Fraction(sum(r[i] * r[j] for r in y), n**3) for j in range(d)] for i in range(d)]


@pytest.mark.parametrize("far", [0.0, 1e5])
def test_whitening_against_fractions(table, far):
    good, bad = vector_rows(far=far)
    got = whitening.whiten_embeddings(table(good, bad), components=9).collect()
    x = [[int(np.floor(64 * c)) + 1_000_000 for c in v] for _, v, _ in good]
    n, sums, cov = exact_covariance(x)
    values, axes = np.linalg.eigh(np.array([[float(c) for c in row] for row in cov]))
    assert len(got) == 9 * len(good) and {r["n"] for r in got} == {n} and {r["component"] for r in got} == set(range(1, 10))
    deviations = sorted((str(i), sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True))) for (i, _, _), v in zip(good, x, strict=True))
    assert sorted((str(r["vec_id"]), int(r["deviation"])) for r in got if r["component"] == 1) == deviations
    (error,) = {r["identity_error"] for r in got}
    assert error < 1e-6
    trace = float(sum(cov[i][i] for i in range(16)))
    for k in range(1, 10):
        e, u = values[-k], axes[:, -k]
        assert all(abs(r["explained"] - e / trace) <= 1e-6 * e / trace for r in got if r["component"] == k)
        want = {}
        for (i, _, _), v in zip(good, x, strict=True):
            want.setdefault(str(i), []).append(float(sum((a - Fraction(s, n)) * Fraction(b) for a, s, b in zip(v, sums, u.tolist(), strict=True))) / e**0.5)
        have = {}
        for r in got:
            if r["component"] == k:
                have.setdefault(str(r["vec_id"]), []).append(r["whitened"])
        assert have.keys() == want.keys()
        sign = np.sign(sum(sum(have[i]) * sum(want[i]) for i in have))
        for i in have:
            assert np.allclose(sorted(sign * np.array(have[i])), sorted(want[i]), atol=1e-5 if far else 1e-8)


@pytest.mark.parametrize("most", [5, 1 << 21, 1 << 45, 1 << 90])
def test_products_of_limbs_are_exact(most):
    r = random.Random(most)
    rows = [[r.randint(-most, most) for _ in range(3)] for _ in range(50)]
    y = np.array(rows, np.int64 if most < 1 << 62 else object)
    assert all(np.abs(p).max() <= 1 << whitening.LIMB - 1 for p in whitening.limbs(y))
    total = sum((m.astype(object) << whitening.LIMB * w for w, m in whitening.products(y).items()), np.zeros((3, 3), object))
    assert total.tolist() == [[sum(row[i] * row[j] for row in rows) for j in range(3)] for i in range(3)]


def test_whitening_beyond_64_bits(spark):
    rows = [(i, [float(v) * 2.0**50 for v in (i % 7, i * i % 11, 3)]) for i in range(40)]
    got = whitening.whiten_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    x = [[int(64 * c) + 1_000_000 for c in v] for _, v in rows]
    n, sums, _ = exact_covariance(x)
    want = {i: sum((n * a - s) ** 2 for a, s in zip(x[i], sums, strict=True)) for i in range(40)}
    assert {r["component"] for r in got} == {1, 2}  # the third dimension has no variance
    assert all((int(r["deviation"]) if r["deviation"] is not None else None) == (want[r["vec_id"]] if want[r["vec_id"]] < 10**38 else None) for r in got)
    assert {r["identity_error"] < 1e-9 for r in got} == {True}


def test_whitening_without_variance(spark, table):
    good, bad = vector_rows()
    empty = whitening.whiten_embeddings(table(good, bad).limit(0))
    assert empty.count() == 0 and empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whitening.whiten_embeddings(table(good[:1], [])).count() == 0
    assert whitening.whiten_embeddings(table([(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1)], [])).count() == 0


def test_lengths_and_left_out_rows(table):
    good, bad = vector_rows()
    found, length = vectors.integer_vectors(table(good, bad), {"id": "vec_id"}, "embedding", 64, 0)
    assert length == 16 and found.count() == len(good)
    assert vectors.integer_vectors(table([(1, [1.0], 1), (2, [1.0, 1.0], 1)], []), {"id": "vec_id"}, "embedding", 64, 0)[1] == 2
    assert vectors.integer_vectors(table([], bad[:5]), {"id": "vec_id"}, "embedding", 64, 0)[1] == 0


def plain_codes(rows, parts, entries, rounds):
    """Loops over rows, parts and entries. rows: (id, integers, label)."""
    width = -(-len(rows[0][1]) // parts)
    cut = [[tuple((list(v) + [0] * (parts * width - len(v)))[p * width : (p + 1) * width]) for p in range(parts)] for _, v, _ in rows]
    first = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))[:entries]
    books = [[cut[i][p] for i in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def assign():
        return [[min((far(c[p], e), k) for k, e in enumerate(books[p])) for p in range(parts)] for c in cut]

    for _ in range(rounds):
        got = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [c[p] for c, g in zip(cut, got, strict=True) if g[p][1] == k]
                if mine:
                    books[p][k] = tuple(sum(z) // len(mine) for z in zip(*mine, strict=True))
    got = assign()
    return [(r[0], r[2], bytes(k for _, k in g), sum(f for f, _ in g)) for r, g in zip(rows, got, strict=True)], books


@pytest.mark.parametrize(("parts", "entries", "many"), [(4, 8, False), (4, 8, True), (3, 64, False), (2, 5, False), (1, 3, False)])
def test_codes_against_loops(table, monkeypatch, parts, entries, many):
    if many:
        monkeypatch.setattr(vector_codes, "BROADCAST_LABELS", 0)
    good, bad = vector_rows()
    rows, books, length = vector_codes.compress_vectors(table(good, bad), parts, entries, 2)
    want, plain = plain_codes([(i, [int(np.floor(256 * c)) for c in v], lab) for i, v, lab in good], parts, entries, 2)
    assert [[tuple(e) for e in b] for b in books.tolist()] == plain
    got = rows.collect()
    assert sorted(map(str, ((r["vec_id"], r["label"], bytes(r["code"]), r["error"]) for r in got))) == sorted(map(str, want))
    total = {}
    for _, label, _, error in want:
        total[label] = total.get(label, 0) + error
    assert {r["label"]: r["label_error"] for r in got} == total
    assert vector_codes.digest(books) == hashlib.sha256(",".join(str(v) for b in plain for e in b for v in e).encode()).hexdigest()
    back = {bytes(r["code"]): r["approximation"] for r in vector_codes.decode(rows, books, length).collect()}
    for code, v in back.items():
        assert v == [c / 256 for p, k in enumerate(code) for c in plain[p][k]][:16]


@pytest.mark.parametrize("width", [1, 2, 3, 4, 8, 12])
@pytest.mark.parametrize("most", [2, 300, 1 << 26])
def test_bounds_lose_no_nearest_entry(width, most):
    r = np.random.RandomState(width)
    v, entries = r.randint(-most, most, (400, width)), r.randint(-most, most, (64, width))
    entries[10], entries[20] = entries[5], entries[5]  # ties go to the lower index
    v[:64] = entries
    at, far = vector_codes.nearest(v, entries)
    exact = ((v[:, None] - entries) ** 2).sum(2)
    assert at.tolist() == exact.argmin(1).tolist() and far.tolist() == exact.min(1).tolist()


def test_codes_of_few_vectors_and_none(table):
    good, bad = vector_rows()
    rows, books, _ = vector_codes.compress_vectors(table(good[:3], bad))
    assert books.shape[1] == 3 and {r["error"] for r in rows.collect()} == {0}
    rows, books, length = vector_codes.compress_vectors(table([], bad[:5]))
    assert rows.count() == 0 and length == 0 and vector_codes.digest(books) == hashlib.sha256(b"").hexdigest()
    large = [(1, [3e38] * 4, 1), (2, [1.0, 2.0, 3.0, 4.0], 1)]  # beyond exact distances: left out
    assert [r["vec_id"] for r in vector_codes.compress_vectors(table(large, []))[0].collect()] == [2]


# Packing


def sequential_best_fit(lengths, capacity):
    """Longest first, each into the fullest bin that takes it."""
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [(r, i) for i, r in enumerate(room) if r >= n]
        if fits:
            room[min(fits)[1]] -= n
        else:
            room.append(capacity - n)
    return sorted(room)


@pytest.mark.parametrize("seed", range(12))
def test_plan_is_best_fit_decreasing(seed):
    r = random.Random(seed)
    capacity = r.choice([1, 7, 64, 100])
    lengths = [r.choice([1, capacity, r.randint(1, capacity), max(1, capacity // 3)]) for _ in range(r.choice([0, 1, 40, 400]))]
    counts = {n: lengths.count(n) for n in set(lengths)}
    plan = packing.best_fit(counts.items(), capacity).tolist()
    used = {}
    for k, (length, first, bin_, offset, each) in enumerate(plan):
        last = plan[k + 1][1] if k + 1 < len(plan) and plan[k + 1][0] == length else counts[length]
        for j in range(last - first):
            used.setdefault(bin_ + j // each, []).append((offset + j % each * length, length))
    for spans in used.values():
        spans.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and spans[0][0] == 0 and sum(spans[-1]) <= capacity
    assert sum(map(len, used.values())) == len(lengths)
    assert sorted(capacity - sum(n for _, n in spans) for spans in used.values()) == sequential_best_fit(lengths, capacity)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij'éßİΣ1") for _ in range(r.randint(1, 9)))
    some = [" ".join(word() for _ in range(r.choice([1, 20, 300]))) for _ in range(40)]
    return [*some, *some[:6], None, "", None, " \n\t ", "x" * 9000, "á ́b c d\x1ce\x85f", "<|endoftext|> a<|startoftext|>b", "don't WE'LL x's '", "日本語 テキスト" * 700, " ".join(word() for _ in range(9000)), "\n\n  two  spaces\t\n"]


@pytest.fixture
def docs(spark, texts):
    rows = [(None if i == 4 else i % 50, t, i, "x", b"y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, id int, `a.b` string, rank binary").repartition(5)


@pytest.mark.parametrize("capacity", [4096, 64])
def test_packing_against_the_library(docs, texts, capacity):
    from tokenizers import Tokenizer

    path = vocabulary_path("word_bpe_49k.json")
    plain, want, lengths = Tokenizer.from_file(path), [], []
    for i, t in enumerate(texts):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), capacity):
            part = ids[k : k + capacity]
            lengths.append(len(part))
            want.append((None if i == 4 else i % 50, k // capacity, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    got = packing.pack_documents(docs, path, capacity).collect()
    assert sorted(map(str, ((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got))) == sorted(map(str, want))
    room = []
    for s in {r["sequence_id"] for r in got}:
        spans = sorted((r["offset"], r["length"]) for r in got if r["sequence_id"] == s)
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and sum(spans[-1]) <= capacity
        room.append(capacity - sum(spans[-1]))
    assert sorted(room) == sequential_best_fit(lengths, capacity)


def test_packed_sequences_hold_the_tokens(docs):
    from tokenizers import Tokenizer

    path = vocabulary_path("word_bpe_49k.json")
    pieces = {(r["id"], r["piece"], r["length"]) for r in packing.token_pieces(docs, path, 512).collect()}
    found = packing.packed_sequences(docs, path, 512).collect()
    assert {(d["id"], d["piece"], d["length"]) for r in found for d in r["documents"]} == pieces
    for r in found:
        ids = np.frombuffer(bytes(r["tokens"]), "<u4")
        assert len(ids) == r["n_tokens"] == sum(d["length"] for d in r["documents"]) <= 512
    text = docs.where(F.col("doc_id") == 20).select("text").first()["text"]
    (place,) = [(r, d) for r in found for d in r["documents"] if d["id"] == 20 and d["piece"] == 0]
    ids = np.frombuffer(bytes(place[0]["tokens"]), "<u4")[place[1]["offset"] :][: place[1]["length"]]
    assert ids.tolist() == [*Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids, 1][:512]


def test_packing_nothing(docs):
    empty = packing.pack_documents(docs.limit(0), vocabulary_path("word_bpe_49k.json"))
    assert empty.count() == 0 and empty.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_runs_forget(texts):
    path = vocabulary_path("word_bpe_49k.json")
    with open(path, "rb") as f:
        vocabulary = f.read()
    small, whole = packing.Runs(vocabulary, packing.ranks_of(vocabulary), most=5, longest=3, part=10), packing.Runs(vocabulary)
    for t in texts:
        assert small.ids(t or "") == whole.ids(t or "")
        assert len(small.known) <= 5 + max(len(r) for r in small.parts(t)) if t else True


def test_runs_in_ascii_and_other_vocabularies(texts):
    from tokenizers import Tokenizer

    r = random.Random(4)
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path = vocabulary_path(name)
        with open(path, "rb") as f:
            vocabulary = f.read()
        rules = packing.ranks_of(vocabulary)
        assert (rules is not None) == (name == "word_bpe_49k.json")
        runs = packing.Runs(vocabulary, rules, most=300)
        assert runs.cut == (name == "word_bpe_49k.json")
        plain = Tokenizer.from_file(path)
        for t in ["".join(r.choice("ab'sStTrReEvVdDmMlL09 \n\t\r\x0b\x1c\x1f\x00.,<|>endoftext\x7fé́ΣÀßÿ×÷") for _ in range(r.randint(0, 60))) for _ in range(1500)] + texts:
            assert runs.ids(t or "") == np.array(plain.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes(), t


def test_merges_agree_with_the_library():
    """Tokens of the vocabulary one after the other, random letters, and a vocabulary with a token that tiktoken makes by another pair."""
    from tokenizers import Tokenizer

    path, r = vocabulary_path("word_bpe_49k.json"), random.Random(6)
    with open(path, "rb") as f:
        vocabulary = f.read()
    ranks, unsafe = packing.ranks_of(vocabulary)
    merges, plain = packing.Merges(ranks, unsafe), Tokenizer.from_file(path)
    words = [t.decode() for t in ranks if t.isalpha() and t.isascii() and t.islower()]
    tries = ["".join(r.choice(words) for _ in range(r.randint(1, 4))) for _ in range(4000)] + ["".join(r.choice("etaoinshrdlu") for _ in range(r.randint(1, 14))) for _ in range(4000)]
    known = [merges.ids(t) for t in tries]
    want = [np.array(e.ids, "<u4").tobytes() for e in plain.encode_batch(tries, add_special_tokens=False)]
    assert sum(k is not None for k in known) > 7000 and all(k in (None, w) for k, w in zip(known, want, strict=True))


def test_unsafe_tokens_are_found():
    """abc comes from ab and c by the list, but a and bc stand there: only tiktoken's rule joins them."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = [chr(b) for b in prints] + [chr(256 + i) for i in range(256 - len(prints))]
    tokens = [*chars, *(c + "</w>" for c in chars), "bc", "ab", "abc"]
    model = {"type": "BPE", "end_of_word_suffix": "</w>", "vocab": {t: i for i, t in enumerate(tokens)}, "merges": [["b", "c"], ["a", "b"], ["ab", "c"]]}
    ranks, unsafe = packing.ranks_of(json.dumps({"model": model}).encode())
    assert unsafe == {514} and packing.Merges(ranks, unsafe).ids("abcd") is None
    assert np.frombuffer(packing.Merges(ranks, unsafe).ids("abd"), "<u4").tolist() == [513, ranks[b"d\xff"]]
