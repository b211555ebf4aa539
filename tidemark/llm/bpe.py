"""BPE encoding and decoding with a contiguous rank array.

A word's parts lie in one array and the ranks of adjacent parts in another. The smallest rank is
found by a scan, its boundary is deleted and the two neighbouring ranks are refreshed, until no
adjacent parts merge. That is fastest for the short words text consists of, and words of equally
many bytes take these steps together, as the rows of such arrays; very long words, where the scans
would add up, take the same merges from a heap over linked parts.

Texts are cut at single blanks between other characters, where no token can cross, and the pieces'
encodings are remembered, so a piece that comes again is worked out once per process while the memory lasts.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, per_batch, per_process, text_or_empty
from .pieces import ragged
from .tokens import Remembered

# Fixed value: how byte-level BPE cuts a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words of more bytes than this are merged with a heap.
LONG_WORD = 256
#: Fewer words of one length are merged one by one.
FEW_WORDS = 8
#: Words of Latin letters, which the pattern leaves whole.
ONE_WORD = "^ ?[A-Za-zÀ-ÖØ-öø-ÿ]+$"


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves,
    the others for the letters from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


class Ranks:
    """The ranks of pairs in an open hash table; ``none`` for pairs that do not merge."""

    def __init__(self, merges: dict[int, int]):
        self.none, self.bits = len(merges), max(len(merges), 1).bit_length() + 2
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, self.none, np.int32)
        keys, ranks = np.array(list(merges), np.int64), np.array(list(merges.values()), np.int32)
        slots = self._slots(keys)
        while len(keys):
            free = self.keys[slots] < 0
            self.keys[slots[free]] = keys[free]
            placed = self.keys[slots] == keys
            self.ranks[slots[placed]] = ranks[placed]
            keys, ranks, slots = keys[~placed], ranks[~placed], self._after(slots[~placed])

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).view(np.int64)

    def _after(self, slots: np.ndarray) -> np.ndarray:
        return slots + 1 & (1 << self.bits) - 1

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.int64) << 20 | right).ravel()
        slots = self._slots(keys)
        held, ranks = self.keys.take(slots), self.ranks.take(slots)
        more = np.flatnonzero((held != keys) & (held >= 0))
        ranks[held != keys] = self.none
        while len(more):
            slots[more] = self._after(slots[more])
            held = self.keys[slots[more]]
            ranks[more] = np.where(held == keys[more], self.ranks[slots[more]], self.none)
            more = more[(held != keys[more]) & (held >= 0)]
        return ranks.reshape(left.shape)


class Bpe(Remembered):
    """A byte-level BPE vocabulary from a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {
            i: bytes(letters[c] for c in token) for token, i in vocab.items() if token not in self.special
        } | {i: token.encode() for token, i in self.special.items()}
        self.first = [0] * 256
        for letter, b in letters.items():
            self.first[b] = vocab[letter]
        #: Rank of a pair by ``left << 20 | right``, and the part that each rank makes.
        self.merges: dict[int, int] = {}
        self.made: list[int] = []
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.merges[vocab[left] << 20 | vocab[right]] = rank
            self.made.append(vocab[left + right])
        self.cut = "lead" if all("<" in token for token in self.special) else "none"
        self.words = regex.compile(WORDS)
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.none, self.ranks = len(self.merges), Ranks(self.merges)
        self.first_of, self.made_of = np.array(self.first, np.int32), np.array(self.made, np.int32)
        #: The bytes of every id, and every id as text behind a comma.
        ids = range(max(self.bytes_of) + 1)
        self.raw = pa.array([self.bytes_of.get(i, b"") for i in ids], pa.large_binary())
        self.listed = pa.array([b",%d" % i for i in ids], pa.large_binary())
        self._forget()

    def merge_short(self, word: bytes) -> list[int]:
        """The parts of a word by scans of its rank array."""
        parts = list(map(self.first.__getitem__, word))
        rank_of, none = self.merges.get, self.none
        ranks = [rank_of(x << 20 | y, none) for x, y in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == none:
                break
            i = ranks.index(least)
            part = self.made[least]
            parts[i:i + 2] = [part]
            del ranks[i]
            if i:
                ranks[i - 1] = rank_of(parts[i - 1] << 20 | part, none)
            if i < len(ranks):
                ranks[i] = rank_of(part << 20 | parts[i + 1], none)
        return parts

    def merge_long(self, word: bytes) -> list[int]:
        """The same merges by a heap over linked parts."""
        parts: list[int | None] = list(map(self.first.__getitem__, word))
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap = []

        def offer(x: int, y: int) -> None:
            rank = self.merges.get(parts[x] << 20 | parts[y])
            if rank is not None:
                heapq.heappush(heap, (rank, x, parts[x], parts[y]))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if parts[i] != left or j >= len(parts) or parts[j] != right:
                continue
            parts[i], parts[j] = self.made[rank], None
            after[i] = after[j]
            if after[j] < len(parts):
                before[after[j]] = i
                offer(i, after[j])
            if before[i] >= 0:
                offer(before[i], i)
        return [p for p in parts if p is not None]

    def merge_equal(self, words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The same merges for words of equally many bytes, a row each: which rows end together, and their parts."""
        rows, parts = np.arange(len(words)), self.first_of[words]
        ranks = self.ranks.of(parts[:, :-1], parts[:, 1:])
        while len(rows):
            at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(rows), np.int64)
            least = ranks[np.arange(len(rows)), at] if ranks.shape[1] else np.full(len(rows), self.none)
            live = least < self.none
            if not live.all():
                yield rows[~live], parts[~live]
                rows, parts, ranks, at, least = rows[live], parts[live], ranks[live], at[live], least[live]
            if not len(rows):
                return
            every, part = np.arange(len(rows)), self.made_of[least]
            parts[every, at] = part
            parts, ranks = without(parts, at + 1), without(ranks, at)
            which = np.flatnonzero(at > 0)
            ranks[which, at[which] - 1] = self.ranks.of(parts[which, at[which] - 1], part[which])
            which = np.flatnonzero(at < ranks.shape[1])
            ranks[which, at[which]] = self.ranks.of(part[which], parts[which, at[which] + 1])

    def merge(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The parts of all words in a row and how many each has."""
        words = words.cast(pa.large_string()).cast(pa.large_binary())
        offsets = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, words.offset * 8)
        raw = np.frombuffer(words.buffers()[2] or b"", np.uint8)
        lengths = np.diff(offsets)
        order = np.argsort(lengths, kind="stable")
        found, sizes = [], np.zeros(len(words), np.int64)
        for which in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1) if len(order) else []:
            n = int(lengths[which[0]])
            if len(which) < FEW_WORDS or n > LONG_WORD:
                merged = self.merge_short if n <= LONG_WORD else self.merge_long
                found += [(which[k:k + 1], np.array([merged(words[int(w)].as_py())])) for k, w in enumerate(which)]
            else:
                found += [(which[r], p) for r, p in self.merge_equal(raw[offsets[which][:, None] + np.arange(n)])]
        for which, parts in found:
            sizes[which] = parts.shape[1]
        begins = np.cumsum(sizes) - sizes
        flat = np.zeros(sizes.sum(), "<u4")
        for which, parts in found:
            flat[begins[which][:, None] + np.arange(parts.shape[1])] = parts
        return flat, sizes

    def _words(self, text: str) -> list[str]:
        """The words and added tokens of any text."""
        if not any(token in text for token in self.special):
            return self.words.findall(text)
        words: list[str] = []
        for piece in self.cut_special.split(text):
            words += [piece] if piece in self.special else self.words.findall(piece)
        return words

    def _add(self, pieces: list[str], whole: bool) -> np.ndarray:
        array = pa.array(pieces, pa.large_string())
        lists = [[piece] if one else self._words(piece) for piece, one in zip(pieces, self._are_words(array).tolist())]
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        found = pa.array(chain.from_iterable(lists), pa.large_string()).dictionary_encode()
        ids, sizes = self.merge(found.dictionary)
        begins = np.cumsum(sizes) - sizes
        for n, word in self._added(found.dictionary):  # an added token is one id
            ids[begins[n]], sizes[n] = self.special[word], 1
        at = found.indices.to_numpy()
        ends = np.concatenate([[0], np.cumsum(sizes[at])])
        return self._store(ragged(ids, begins[at], sizes[at]), np.diff(ends[np.concatenate([[0], np.cumsum(counts)])]))

    def _are_words(self, pieces: pa.Array) -> np.ndarray:
        """Pieces that are one word at a glance; none where an added token may lie in letters."""
        if any(pc.match_substring_regex(pa.array(list(self.special), pa.string()), "[A-Za-zÀ-ÖØ-öø-ÿ]$").to_pylist()):
            return np.zeros(len(pieces), bool)
        return pc.match_substring_regex(pieces, ONE_WORD).to_numpy(zero_copy_only=False)

    def _added(self, words: pa.Array) -> list[tuple[int, str]]:
        which = np.flatnonzero(pc.is_in(words, pa.array(list(self.special), words.type)).to_numpy(zero_copy_only=False))
        return [(int(n), words[int(n)].as_py()) for n in which]

    def forms(self, texts: pa.Array) -> Iterator[tuple[int, memoryview, memoryview]]:
        """Of each text: how many ids, the ids as text, each behind a comma, and the bytes that they decode to."""
        numbers, at, ends = self.numbered(texts)
        sizes = self.sizes[numbers]
        ids = pa.array(ragged(self.flat, self.begins[numbers], sizes))
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        (listed, listed_ends), (raw, raw_ends) = (joined(table.take(ids), bounds, at, ends) for table in (self.listed, self.raw))
        totals = np.concatenate([[0], np.cumsum(sizes[at])])[ends]
        for t in range(len(texts)):
            yield int(totals[t + 1] - totals[t]), listed[listed_ends[t]:listed_ends[t + 1]], raw[raw_ends[t]:raw_ends[t + 1]]


def without(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The rows without their entries at ``at``."""
    keep = np.ones(rows.shape, bool)
    keep[np.arange(len(rows)), at] = False
    return rows[keep].reshape(len(rows), rows.shape[1] - 1)


def joined(parts: pa.Array, bounds: np.ndarray, at: np.ndarray, ends: np.ndarray) -> tuple[memoryview, list[int]]:
    """The bytes of texts in a row and where each text's begin and end, when piece ``n`` consists of the parts from
    ``bounds[n]`` on and the texts of the pieces ``at``."""

    def split(strings: pa.Array, where: np.ndarray) -> tuple[np.ndarray, pa.Buffer]:
        offsets = np.frombuffer(strings.buffers()[1], np.int64, len(strings) + 1, strings.offset * 8)
        return np.ascontiguousarray(offsets[where]), strings.buffers()[2] or pa.py_buffer(b"")

    offsets, data = split(parts, bounds)
    pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), data])
    offsets, data = split(pieces.take(pa.array(at)), ends)
    return memoryview(data), offsets.tolist()


def vocabulary(path: str) -> Bpe:
    """The vocabulary of a file, read once per process."""
    return per_process(("bpe", path), lambda: Bpe(path))


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row.

    ``path`` is a tokenizer file that the executors can read. Reads ``doc_id`` and ``text`` only;
    NULL text counts as empty (no ids, the digests of nothing), repeated rows give repeated results,
    an empty table gives none.
    """
    schema = T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()),
    ])

    def one(batch: pa.RecordBatch) -> dict:
        bpe = vocabulary(path)
        counts, ids, raws = [], [], []
        for n, listed, raw in bpe.forms(batch.column(1)):
            counts.append(n)
            ids.append(hashlib.sha256(listed[1:]).hexdigest())
            raws.append(hashlib.sha256(str(raw, "utf-8", "replace").encode()).hexdigest())
        return {"doc_id": batch.column(0), "n_tokens": counts, "ids_sha256": ids, "decoded_sha256": raws}

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(per_batch(one, schema), schema)
