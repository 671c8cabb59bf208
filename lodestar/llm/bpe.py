"""Byte-level BPE as a streaming transducer with bounded lookahead, and its decoder as a state machine over bytes.

Encoding. A pre-token's BPE sequence is the only one in which each neighbouring pair of tokens is stable, that is, BPE
leaves the pair's joined bytes as that pair. So each prefix has one last token, found from the prefixes that end at most
one token's length before: the transducer reads byte by byte and keeps these states for the last `lookahead` positions
only, where `lookahead` is computed from the merge list as the length of the longest token that its merges really make. Every
later token begins at one of the kept positions, so a token that lies on the paths of all of them is stable: it is emitted
and forgotten. Memory follows the lookahead and not the pre-token's length. All pre-tokens go through this one transducer; the
tokens of frequent short pre-tokens are remembered in tables of fixed size.

Decoding. Tokens give bytes; an incremental UTF-8 machine carries an unfinished character to the next block and puts
U+FFFD for what isn't UTF-8.

Special tokens of the vocabulary file are found in the text first, as the tokenizers library does by default.
A vocabulary file with settings that this encoder doesn't have is refused with a ValueError.
Null text counts as empty and gives no tokens. Rows that repeat are encoded one by one. Whole texts are read, in blocks cut
before single spaces between other characters, where the pattern always ends a pre-token.
"""

from __future__ import annotations

import codecs
import hashlib
import json
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEPT, quoted, small_batches, tidy

#: How text is cut before the merges of byte-level vocabularies (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK = 1 << 15
#: At most so many token pairs known to be stable or not are remembered.
KEPT_PAIRS = 1 << 18
#: Tokens are remembered of pre-tokens of so many bytes at most.
REMEMBERED = 64
#: Bytes of results sent to the JVM together.
OUT_BYTES = 1 << 21


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else one from 256 up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def supported(spec: dict) -> None:
    """Raise for settings of a vocabulary file under which the library would encode otherwise than this module."""
    model, split, back = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("decoder") or {}
    wrong = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
    wrong += [] if model.get("type", "BPE") == "BPE" else ["model type"]
    wrong += ["normalizer"] if spec.get("normalizer") else []
    wrong += [] if split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True) else ["pre_tokenizer"]
    wrong += [] if back.get("type") == "ByteLevel" else ["decoder"]
    wrong += [f"added token {t['content']!r}" for t in spec.get("added_tokens", []) if any(t.get(k) for k in ("single_word", "lstrip", "rstrip", "normalized"))]
    if wrong:
        raise ValueError(f"vocabulary settings not supported: {', '.join(wrong)}")


class Transducer:
    def __init__(self, vocabulary: bytes, cache_words: int = 1 << 15):
        self.cache_words = cache_words
        spec = json.loads(vocabulary)
        supported(spec)
        alphabet = byte_alphabet()
        as_bytes = lambda s: bytes(alphabet[c] for c in s)
        ids = spec["model"]["vocab"]
        self.token = {as_bytes(k): v for k, v in ids.items() if all(c in alphabet for c in k)}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.merge = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.halves = {new: (rank, *pair) for pair, (rank, new) in self.merge.items()}
        self.made: dict[int, bool] = {}
        self.text = [b""] * (max([*ids.values(), *(t["id"] for t in spec["added_tokens"])]) + 1)
        for k, v in self.token.items():
            self.text[v] = k
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for k, v in self.special.items():
            self.text[v] = k.encode()
            self.token.pop(k.encode(), None)
        self.sizes = [len(x) for x in self.text]
        self.packed = [i.to_bytes(4, "little") for i in range(len(self.text))]
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        made = sorted({new for _, new in self.merge.values()}, key=lambda t: -len(self.text[t]))
        self.lookahead = next((len(self.text[t]) for t in made if self.whole(t)), 1)
        self.pieces = regex.compile(PATTERN)
        self.cut = regex.compile(r"(?<=\S) (?=\S)")
        self.ends = ahocorasick.Automaton()
        for k, v in self.token.items():
            if len(k) <= self.lookahead:
                self.ends.add_word(k.decode("latin-1"), (v, len(k)))
        self.ends.make_automaton()
        self.stable: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def reduce(self, data: bytes) -> list[int]:
        """BPE by its definition: the merge of lowest rank first, leftmost first. For short strings."""
        seq, none = [self.token[data[i : i + 1]] for i in range(len(data))], (len(self.merge), -1)
        found = [self.merge.get(p, none) for p in zip(seq, seq[1:])]
        while found:
            best = min(found)
            if best is none:
                break
            i = found.index(best)
            seq[i : i + 2] = [best[1]]
            found[max(i - 1, 0) : i + 2] = [self.merge.get(p, none) for p in zip(seq[max(i - 1, 0) : i + 1], seq[max(i, 1) : i + 2])]
        return seq

    def fits(self, left: int, right: int) -> bool:
        """Whether BPE leaves this pair of tokens as it is; left -1 is the beginning."""
        key = left << 32 | right
        got = self.stable.get(key)
        if got is None:
            if len(self.stable) >= KEPT_PAIRS:
                self.stable.clear()
            got = self.whole(right) and (left < 0 or self.whole(left) and self.apart(left, right))
            self.stable[key] = got
        return got

    def whole(self, token: int) -> bool:
        """Whether BPE makes this one token of its bytes."""
        got = self.made.get(token)
        if got is None:
            got = self.made[token] = self.reduce(self.text[token]) == [token]
        return got

    def apart(self, left: int, right: int) -> bool:
        """Whether no merge crosses the boundary of two whole tokens.

        Taking their merges back, latest first, shows the two tokens that meet at the boundary at each time; they join
        if their merge comes before the one that ends this time (at equal ranks the left one goes first).
        """
        merge, halves, never = self.merge, self.halves, len(self.merge)
        until, left_goes = never, False
        while True:
            crossing = merge.get((left, right))
            if crossing is not None and (crossing[0] < until or crossing[0] == until and not left_goes):
                return False
            a, b = halves.get(left), halves.get(right)
            if a is None and b is None:
                return True
            left_goes = b is None or a is not None and a[0] > b[0]
            if left_goes:
                until, left = a[0], a[2]
            else:
                until, right = b[0], b[1]

    def stream(self, data: bytes) -> Iterator[bytes]:
        """The tokens of one pre-token as packed ids, each as soon as no later byte can change it."""
        stable, fits = self.stable.get, self.fits
        begun, done = 0, 0  # tokens up to begun are out; the prefix that ends at done has its last token
        last = [-1]  # last token of each prefix that ends at begun or later
        check = 2 * self.lookahead
        # The automaton names the tokens that end at each byte, the longest first.
        for end, (t, size) in self.ends.iter(data.decode("latin-1")):
            if end < done:
                continue
            begin = end + 1 - size - begun
            if begin < 0:
                continue
            left = last[begin]
            good = stable(left << 32 | t)
            if good or good is None and fits(left, t):
                last.append(t)
                done = end + 1
                if done >= check:
                    root = self.agreed(last, begun, done)
                    if root > begun:
                        yield self.path(last, begun, root)
                        del last[: root - begun]
                        begun = root
                    check = done + self.lookahead
        yield self.path(last, begun, done)

    def agreed(self, last: list[int], begun: int, end: int) -> int:
        """The last position on the paths of all prefixes at which a later token can begin."""
        sizes = self.sizes
        heads = set(range(max(begun, end - self.lookahead + 1), end + 1))
        while len(heads) > 1:
            top = max(heads)
            heads.remove(top)
            heads.add(top - sizes[last[top - begun]])
        return heads.pop()

    def path(self, last: list[int], begun: int, end: int) -> bytes:
        out, packed, sizes = [], self.packed, self.sizes
        while end > begun:
            t = last[end - begun]
            out.append(packed[t])
            end -= sizes[t]
        return b"".join(out[::-1])

    def word(self, word: str) -> bytes:
        got = self.older.get(word)
        if got is None:
            data = word.encode()
            got = b"".join(self.stream(data))
            if len(data) > REMEMBERED:
                return got
        if len(self.known) >= self.cache_words:
            self.older = dict(self.known)
            self.known.clear()
        self.known[word] = got
        return got

    def blocks(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > BLOCK:
            m = self.cut.search(text, at + BLOCK)
            if m is None:
                break
            yield text[at : m.start()]
            at = m.start()
        yield text[at:] if at else text

    def encode(self, text: str) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        parts = [text] if self.split_special is None else self.split_special.split(text)
        known, word = self.known, self.word
        for i, part in enumerate(parts):
            if i % 2:
                out.append(int(self.special[part]).to_bytes(4, "little"))
                continue
            for block in self.blocks(part):
                if block:
                    words = self.pieces.findall(block)
                    out.append(b"".join([known.get(w) or word(w) for w in words]))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        tokens, text = np.frombuffer(ids, "<u4"), self.text
        parts = [machine.decode(b"".join([text[t] for t in tokens[a : a + BLOCK].tolist()])) for a in range(0, len(tokens), BLOCK)]
        return "".join([*parts, machine.decode(b"", True)])


_made: dict[tuple[bytes, int], Transducer] = {}
KEPT["bpe"] = _made.clear


def transducer(vocabulary: bytes, cache_words: int = 1 << 15) -> Transducer:
    """One transducer for each vocabulary in a process."""
    key = hashlib.sha256(vocabulary).digest(), cache_words
    if key not in _made:
        _made.clear()
        _made[key] = Transducer(vocabulary, cache_words)
    return _made[key]


def encode_decode(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", cache_words: int = 1 << 15) -> DataFrame:
    """id, tokens (binary: little-endian unsigned 32-bit ids) and decoded (the text that the tokens give back) of every row.

    An empty table gives no rows; other columns are not read. The vocabulary file is read on the driver and travels with the tasks. No shuffle. A worker keeps the tokens of at most twice
    `cache_words` words.
    """
    with open(vocabulary_path, "rb") as f:
        vocabulary = f.read()
    rows = small_batches(docs).select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = transducer(vocabulary, cache_words)
        for batch in batches:
            first, size, tokens, decoded = 0, 0, [], []
            for i in range(batch.num_rows):
                ids = bpe.encode(batch.column(1)[i].as_py() or "")
                tokens.append(ids)
                decoded.append(bpe.decode(ids))
                size += len(ids) + len(decoded[-1])
                if size >= OUT_BYTES or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, i + 1 - first), pa.array(tokens, pa.binary()), pa.array(decoded, pa.string())], ["id", "tokens", "decoded"])
                    first, size, tokens, decoded = i + 1, 0, [], []

    out = rows.mapInArrow(tidy(run, "bpe"), f"id {rows.schema['id'].dataType.simpleString()}, tokens binary, decoded string")
    return out.withColumnRenamed("id", id_col)
