"""Best-fit-decreasing packing of tokenized documents into sequences of a fixed capacity.

Tokens. A document's ids are those of the tokenizers library, and an end id. Texts are cut at spaces and line feeds, where this
vocabulary's normalizer and pre-tokenizer end a token anyway (tested against whole texts), and a task asks the library once for each distinct
run between them. Ids longer than the capacity are cut into pieces of it. Pieces are written once, with the number that each has among the
pieces of its length in its task.

Plan. Which bin a piece gets depends on its length only, and lengths are 1 to capacity: so best-fit decreasing runs on the count of
pieces of each length, however many pieces there are. Open bins are counted by remaining capacity in a segment tree, which
finds the tightest remaining capacity in logarithmic time; as pieces of one length go on filling the bin that took the first, whole
runs of bins are filled in one step and stay intervals of numbers. The plan is the same as that of placing documents one by one, longest first.

Placing. Prefix sums over the tasks make a piece's number among all of its length (a few rows a task and length), and the plan's intervals,
looked up by length and number, give its bin and offset. Texts and ids are not shuffled for this; only `packed_sequences`, which
puts the tokens of a bin together, moves them.

Null text is empty: its document is the end id alone. Rows that repeat are packed one by one, null ids included; an empty table gives no
rows. Other columns are not read. The tokenizer holds the longest run between spaces as a whole, a task the ids of its longest document.
"""

from __future__ import annotations

import array
import functools
import json
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import KEPT, materialize, quoted, small_batches, tidy


@functools.lru_cache(1)
def tokenizer(vocabulary: bytes):
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    found = Tokenizer.from_buffer(vocabulary)
    found.no_truncation()
    found.no_padding()
    return found


# The normalizer and the pre-tokens of vocabularies that can be cut at spaces, and the same pre-tokens in lower-case Latin-1 letters and ASCII.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PLAIN_PRE_TOKENS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\t-\r a-z0-9ß-öø-ÿ]+")
PLAIN = re.compile(r"[\x00-\x7fÀ-ÖØ-öø-ÿ]*")
#: Ends a pre-token: a byte that UTF-8 never holds stands for the suffix of last symbols.
END = b"\xff"


class Merges:
    """The merges of a byte-level vocabulary with an end-of-word suffix, made by tiktoken.

    Tiktoken joins the neighbours whose union is the least token, by any pair; the tokenizers library only by the pairs of its merge list. As what
    stands beside a token has no part in how it came about, the two differ only where a token is in the result that tiktoken makes, from its own bytes
    alone, by a pair not in the list. These tokens are found beforehand (`unsafe`); a result with one of them doesn't count.
    """

    def __init__(self, ranks: dict[bytes, int], unsafe: frozenset[int]):
        import tiktoken

        self.encode = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.unsafe = unsafe

    def ids(self, pre_token: str) -> bytes | None:
        found = self.encode(pre_token.encode() + END)
        return None if self.unsafe and not self.unsafe.isdisjoint(found) else array.array("I", found).tobytes()


@functools.lru_cache(1)
def ranks_of(vocabulary: bytes) -> tuple[dict[bytes, int], frozenset[int]] | None:
    """(token of each byte string, unsafe tokens) for Merges; None if the vocabulary isn't one for it."""
    model = json.loads(vocabulary)["model"]
    suffix = model.get("end_of_word_suffix")
    if model.get("type") != "BPE" or not suffix or model.get("continuing_subword_prefix") or model.get("ignore_merges") or model.get("dropout"):
        return None
    # Byte-level vocabularies write bytes that don't print as characters from 256 on.
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in prints)}

    def raw(token: str) -> bytes:
        last = token.endswith(suffix)
        return bytes(byte_of[c] for c in (token.removesuffix(suffix) if last else token)) + (END if last else b"")

    try:
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        pairs = {(raw(a), raw(b)): model["vocab"][a + b] for a, b in merges}
        made = set(pairs.values())
        whole = {t for t in model["vocab"] if model["vocab"][t] in made or len(t.removesuffix(suffix)) == 1}
        ranks = {raw(t): model["vocab"][t] for t in whole}
    except KeyError:
        return None
    single = [bytes([b]) + e for b in range(256) for e in (b"", END) if (b, e) != (255, END)]
    order = list(pairs.values())
    if order != sorted(set(order)) or any(s not in ranks for s in single) or max(ranks[s] for s in single) >= order[0]:
        return None
    unsafe = set()
    for token, id_ in ranks.items():
        parts = [token[i : i + 1] for i in range(len(token))]
        if token.endswith(END) and len(parts) > 1:
            parts[-2:] = [parts[-2] + END]
        while len(parts) > 1:
            least, i = min((ranks.get(a + b, 1 << 32), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if pairs.get((parts[i], parts[i + 1])) != least:
                unsafe.add(id_)
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return ranks, frozenset(unsafe)


class Runs:
    """Ids of texts as little-endian unsigned 32-bit integers.

    It remembers those of up to twice `most` short runs between spaces and pre-tokens: those met of late stay. An unknown run of Latin-1 letters and
    ASCII is put together from its pre-tokens (see Merges, if rules has them); what else is unknown goes to the library, in one text. Vocabularies
    with other rules get whole texts.
    """

    def __init__(self, vocabulary: bytes, rules: tuple | None = None, most: int = 1 << 18, longest: int = 48, part: int = 1 << 20):
        self.tokens, self.most, self.longest, self.part = tokenizer(vocabulary), most, longest, part
        self.merges = Merges(*rules) if rules else None
        said = json.loads(vocabulary)
        steps = [n.get("type") for n in (said.get("normalizer") or {}).get("normalizers", [])]
        cuts = [(c.get("pattern") or {}).get("Regex") for c in (said.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        added = said.get("added_tokens", [])
        self.special = [t["content"] for t in added]
        spaced = any(" " in t or "\n" in t for t in self.special) or any(t.get("lstrip") or t.get("rstrip") for t in added)
        self.cut = steps == NORMALIZERS and cuts[:1] == [PRE_TOKENS] and said.get("post_processor") is None and not spaced
        self.known: dict[str, bytes] = {"": b""}
        self.before: dict[str, bytes] = {}

    def parts(self, text: str) -> Iterator[list[str]]:
        """The runs of a text, for about `part` characters at once."""
        text = text.replace("\n", " ")
        at = 0
        while at < len(text):
            end = at + self.part
            end = len(text) if end >= len(text) else text.find(" ", end)
            end = len(text) if end < 0 else end
            yield text[at:end].split(" ")
            at = end + 1

    def learn(self, new: Iterable[str]) -> None:
        """Make runs known that aren't."""
        known, before = self.known, self.before
        ask, made = [], []
        for run in new:
            ids = before.get(run)
            if ids is not None:
                known[run] = ids
            elif self.merges and PLAIN.fullmatch(run) and not any(t in run for t in self.special):
                out = []
                for t in PLAIN_PRE_TOKENS.findall(run.lower()):
                    ids = known.get(t)
                    if ids is None:
                        ids = self.merges.ids(t)
                        if ids is not None:
                            known[t] = ids
                    out.append(ids)
                if None in out:
                    ask.append(run)
                else:
                    known[run] = b"".join(out)
            else:
                ask.append(run)
        if ask:
            found = self.tokens.encode(" ".join(ask), add_special_tokens=False)
            ids = np.array(found.ids, "<u4").tobytes()
            first = np.cumsum([0, *(len(r) + 1 for r in ask)])
            at = np.searchsorted(np.fromiter((a for a, _ in found.offsets), np.int64, len(found.ids)), first) * 4
            for run, a, b in zip(ask, at[:-1].tolist(), at[1:].tolist(), strict=True):
                known[run] = ids[a:b]

    def ids(self, text: str) -> bytes:
        if not self.cut:
            return np.array(self.tokens.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        out = []
        for runs in self.parts(text):
            known = self.known
            self.learn(set(runs).difference(known))
            out.append(b"".join([known[r] for r in runs]))
            if len(known) > self.most:
                self.before = {r: i for r, i in known.items() if len(r) <= self.longest}
                self.known = {"": b""}
        return b"".join(out)


#: What a worker keeps between tasks, by the vocabulary.
_runs: dict[bytes, Runs] = {}
KEPT["packing"] = _runs.clear


def token_pieces(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A written row for each piece: id, piece, start, length, tokens (little-endian unsigned 32-bit ids), task, rank.

    The vocabulary file is read on the driver and travels with the tasks.
    """
    with open(path, "rb") as f:
        vocabulary = f.read()
    rules = ranks_of(vocabulary)
    rows = small_batches(docs).select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).cast("string").alias("text"))
    end, step = np.array([end_id], "<u4").tobytes(), 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = _runs.get(vocabulary) or _runs.setdefault(vocabulary, Runs(vocabulary, rules))
        task, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            owner, piece, tokens, rank = [], [], [], []
            for i, text in enumerate(batch.column("text")):
                ids = runs.ids(text.as_py() or "") + end
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    owner.append(i)
                    piece.append(k)
                    tokens.append(part)
                    rank.append(seen[len(part) // 4])
                    seen[len(part) // 4] += 1
            piece = np.array(piece, np.int64)
            length = np.array([len(t) // 4 for t in tokens], np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(owner, pa.int64())), pa.array(piece.astype(np.int32)), pa.array(piece * capacity), pa.array(length), pa.array(tokens, pa.binary()), pa.array(np.full(len(tokens), task, np.int32)), pa.array(rank, pa.int64())],
                ["id", "piece", "start", "length", "tokens", "task", "rank"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    return materialize(rows.mapInArrow(tidy(run, "packing"), f"id {kind}, piece int, start long, length long, tokens binary, task int, rank long"), "pieces")


class Tree:
    """Segment tree over remaining capacities 0 .. capacity, counting open bins."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.leaves)

    def add(self, remaining: int, bins: int) -> None:
        i = self.leaves + remaining
        while i:
            self.open[i] += bins
            i >>= 1

    def tightest(self, length: int) -> int | None:
        """The least remaining capacity of an open bin that is length or more."""
        i = self.leaves + length
        if self.open[i]:
            return length
        while i > 1 and (i & 1 or not self.open[i + 1]):
            i >>= 1
        if i <= 1:
            return None
        i += 1
        while i < self.leaves:
            i = 2 * i if self.open[2 * i] else 2 * i + 1
        return i - self.leaves


def best_fit(counts: Iterable[tuple[int, int]], capacity: int) -> np.ndarray:
    """Rows (length, first number, first bin, offset, pieces a bin) by length and number, for (length, pieces of it).

    Piece number j from the first one on goes to bin first + j // pieces, at offset + j % pieces x length.
    """
    tree, spans, plan, bins = Tree(capacity), {}, [], 0

    def leave(first: int, n: int, remaining: int) -> None:
        if n and remaining:
            spans.setdefault(remaining, []).append((first, n))
            tree.add(remaining, n)

    for length, n in sorted(counts, reverse=True):
        placed = 0
        while placed < n:
            room = tree.tightest(length)
            if room is None:
                room, (first, width) = capacity, (bins, -(-(n - placed) // (capacity // length)))
                bins += width
            else:
                first, width = spans[room].pop()
                tree.add(room, -width)
            each = room // length
            used = min(width, -(-(n - placed) // each))
            leave(first + used, width - used, room)
            now = min(n - placed, used * each)
            plan.append((length, placed, first, capacity - room, each))
            leave(first, now // each, room - each * length)
            leave(first + now // each, 1 if now % each else 0, room - now % each * length)
            placed += now
    return np.array(sorted(plan), np.int64).reshape(-1, 5)


#: Numbers of pieces of one length stay below this; with the length before it they are one key.
NUMBERS = 1 << 44


def place_pieces(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """pieces (with length, task and rank) and sequence_id and offset; their other columns stay."""
    counted = materialize(pieces.groupBy("length", "task").agg(F.count("*").alias("n")), "piece-counts")
    plan = best_fit([(r["length"], r["n"]) for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()], capacity)  # capacity rows at most
    keys = plan[:, 0] * NUMBERS + plan[:, 1]
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    numbered = pieces.join(starts, ["length", "task"]).withColumn("number", F.col("before") + F.col("rank"))
    other = [c for c in pieces.columns if c not in ("task", "rank")]
    kinds = ", ".join(f"{c} {numbered.schema[c].dataType.simpleString()}" for c in other)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            length, number = (np.asarray(b.column(c)) for c in ("length", "number"))
            row = plan[np.searchsorted(keys, length * NUMBERS + number, "right") - 1]
            ahead = number - row[:, 1]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in other), pa.array(row[:, 2] + ahead // row[:, 4]), pa.array(row[:, 3] + ahead % row[:, 4] * length)], [*other, "sequence_id", "offset"])

    return numbered.select(*other, "number").mapInArrow(tidy(run), f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: id, piece, start, length, ids_crc32, sequence_id, offset. `packed_sequences` makes the sequences."""
    pieces = token_pieces(docs, path, capacity, end_id, id_col, text_col)
    narrow = pieces.select("id", "piece", "start", "length", F.crc32("tokens").alias("ids_crc32"), "task", "rank")
    return place_pieces(narrow, capacity).withColumnRenamed("id", id_col)


def packed_sequences(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each sequence: sequence_id, n_tokens, tokens (little-endian unsigned 32-bit ids) and documents, an array of (id, piece, offset, length)."""
    placed = place_pieces(token_pieces(docs, path, capacity, end_id, id_col, text_col), capacity)
    part = F.struct("offset", "id", "piece", "length", "tokens")
    each = placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))  # capacity tokens at most
    tokens = F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["tokens"])), ""))
    documents = F.transform("parts", lambda p: F.struct(p["id"].alias("id"), p["piece"].alias("piece"), p["offset"].alias("offset"), p["length"].alias("length")))
    return each.select("sequence_id", (F.octet_length(tokens) / 4).cast("long").alias("n_tokens"), tokens.alias("tokens"), documents.alias("documents"))
