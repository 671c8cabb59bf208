"""The pipeline's stages once more, on lists of rows, without Spark and without the library."""

import hashlib
import math
from collections import Counter, defaultdict

import regex
import zstandard

WORD = regex.compile("[^\x20\x09-\x0d]+")


def words(text):
    return WORD.findall(text or "")


def median(values):
    return sorted(values)[math.ceil(len(values) / 2) - 1]


# The default bands.
WHOLE = [(128, 0.35, 0.95), (192, 0.35, 0.90), (256, 0.35, 0.85), (384, 0.35, 0.81), (512, 0.28, 0.775), (768, 0.28, 0.75), (1024, 0.28, 0.72), (2048, 0.22, 0.68), (4096, 0.22, 0.65), (8192, 0.16, 0.60)]
TWO_BYTE = [(1024, 0.58), (1536, 0.55), (2048, 0.53), (4096, 0.47), (8192, 0.43)]


def quality(rows):
    """Rows that word counts and compression keep."""
    packer = zstandard.ZstdCompressor(level=3)
    size = lambda raw: len(packer.compress(raw)) / len(raw)
    two = lambda t: 2 * sum(0x80 <= ord(c) < 0x800 for c in t) > len(t)
    group = lambda t: math.floor(4 * math.log2(len(t.encode()))) * 2 + two(t)
    outer = lambda n: [w for w in WHOLE if n >= w[0]][-1:]
    by = defaultdict(list)
    for t in {r["text"] for r in rows if r["text"] and len(r["text"].encode()) >= 128}:
        by[group(t)].append(round(size(t.encode()) * 2048) / 2048)
    least = {}
    for g, ratios in by.items():
        middle = median(ratios)
        low = middle - max(4.5 * 1.4826 * median([abs(x - middle) for x in ratios]), 0.03)
        fixed = outer(int(2 ** ((g // 2 + 1) / 4)) - 1)[0][1]
        least[g] = (len(ratios) * low + 10 * fixed) / (len(ratios) + 10)
    out = []
    for r in rows:
        text = r["text"] or ""
        w, raw = words(text), text.encode()
        wins = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        again = {i + k for i in range(len(w) - 2) if wins[tuple(w[i : i + 3])] > 1 for k in range(3)}
        if len(w) < 50 or 100 * len(again) > 50 * len(w):
            continue
        if len(raw) >= 128:
            _, low, high = outer(len(raw))[0]
            high = min([high, *(h for n, h in TWO_BYTE if two(text) and len(raw) >= n)])
            starts = list(range(0, len(raw) - 2047, 2048)) + ([len(raw) - 2048] if len(raw) > 2048 and len(raw) % 2048 else [])
            bad = [not 0.2 <= size(raw[k : k + 2048]) <= (0.53 if two(text) else 0.68) for k in starts]
            if not max(low, least[group(text)]) <= size(raw) <= high or bad and sum(bad) / len(bad) > 0.5:
                continue
        out.append(r)
    return out


def bag(text):
    w = words(text)
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def near_copies(rows):
    """One row of each class of rows whose bags have a similarity of 0.8: the first by id."""
    bags = [bag(r["text"]) for r in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(bags):
        for j in range(i):
            b = bags[j]
            if min(sum(a.values()), sum(b.values())) < 0.8 * max(sum(a.values()), sum(b.values())):
                continue
            same = sum((a & b).values())
            if same and same >= 0.8 * (sum(a.values()) + sum(b.values()) - same):
                up[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        least[root(i)] = min(r["doc_id"], least.get(root(i), r["doc_id"]))
    seen, out = set(), []
    for i, r in enumerate(rows):
        if r["doc_id"] == least[root(i)] and (r["doc_id"], r["text"]) not in seen:
            seen.add((r["doc_id"], r["text"]))
            out.append(r)
    return out


def cut(rows, length):
    """Texts without what is covered by strings of length bytes that start twice; whole characters are cut."""
    raws = [(r["text"] or "").encode() for r in rows]
    starts = Counter(b[i : i + length] for b in raws for i in range(len(b) - length + 1))
    out = []
    for r, b in zip(rows, raws, strict=True):
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if starts[b[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        if not any(gone):
            out.append(r)
            continue
        left, at = "", 0
        for c in r["text"]:
            n = len(c.encode())
            left += "" if all(gone[at : at + n]) else c
            at += n
        out.append(r | {"text": left, "n_chars": len(left)})
    return out


def digits(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def mix(rows, weights=(5, 2, 1), most=3, seed=7):
    """Rows, each as often as a systematic sample with its source's target takes it."""
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append((len(words(r["text"])), r))
    order = sorted(by, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total = {s: sum(n for n, _ in by[s]) for s in by}
    capped = {}
    while len(capped) < len(by):
        level = (sum(total.values()) - sum(capped.values())) / sum(w for s, w in weight.items() if s not in capped)
        over = {s: most * total[s] for s in by if s not in capped and level * weight[s] > most * total[s]}
        if not over:
            break
        capped |= over
    out = []
    for s, members in by.items():
        if not total[s]:
            continue
        rate = capped.get(s, level * weight[s]) / total[s]
        offset = digits(f"offset {seed}:" + ("\0null" if s is None else s)) / 2**32
        bits = lambda n: n if n < 16 else n.bit_length() * 8 + (n >> n.bit_length() - 4 & 7)
        large = sorted((m for m in members if m[0] > 0.01 * rate * total[s]), key=lambda x: (-x[0], x[1]["doc_id"]))
        if len(large) > 512:
            large = [m for m in large if m[0] > large[512][0]]
        ahead, words_of, got = 0.0, sum(n for n, _ in large), 0
        for n, r in large:
            low = math.floor(rate)
            less, more = ahead + (low - rate) * n, ahead + (low + 1 - rate) * n
            up = abs(more) < abs(less) and low + 1 <= most
            ahead = more if up else less
            got += (low + up) * n
            out += [r] * (low + up)
        least = min((n for n, _ in large), default=math.inf)
        members = [m for m in members if m[0] < least]
        if total[s] > words_of:
            rate = min(max((rate * total[s] - got) / (total[s] - words_of), 0), most)
        line = sorted(members, key=lambda x: (bits(x[0]), digits(f"{seed}:{x[1]['doc_id']}") % 16, x[0], x[1]["doc_id"]))
        for place, (_, r) in enumerate(line, 1):
            out += [r] * (math.floor(place * rate + offset) - math.floor((place - 1) * rate + offset))
    return out
