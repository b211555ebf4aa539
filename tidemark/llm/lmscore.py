"""Scoring documents by cross-entropy difference of two matched n-gram models.

The target model is counted over trusted documents, the background model over all of them. Both are
interpolated bigram models of words with one vocabulary, the same order and the same smoothing. A
document's score is its loss per token under the target model less that under the background model:
the lower, the more it is like the target and unlike the rest.

Texts are read once, into chunks of documents that hold their words as small numbers. A chunk counts its
own word pairs, words and preceding words before anything is shuffled, and ships them sorted and packed by
ranges of their hashes. A range adds up the counts of all chunks and answers each chunk with the corpus's
counts of just its entries, in the chunk's own order. With these a chunk works out the losses of its tokens.
Nothing is kept per document and pair, all counts are kept, and none of them goes to the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import bounded_batches, text_or_empty, written

#: What word pairs have of the probability after a known word, and words of what is left.
PAIR_SHARE, WORD_SHARE = 0.6, 0.9
TOKEN = re.compile(r"\w+|[^\w\s]")
#: Tokens after which a chunk is closed, and entries of all chunks that one hash range should hold.
CHUNK, RANGE = 1 << 21, 1 << 21
PAIRS, WORDS, BEFORE = range(3)

LOSSES = "doc_id long, n_tokens long, target_loss double, background_loss double, score double"


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(*f) for f in fields])


_LONG, _BYTES = T.LongType(), T.BinaryType()
CHUNKS = _schema(
    ("chunk", _LONG), ("n_tokens", _LONG), ("n_words", _LONG), ("words", _BYTES), ("tokens", _BYTES),
    ("doc_ids", T.ArrayType(_LONG)), ("lengths", T.ArrayType(_LONG)),
)
COUNTS = _schema(("chunk", _LONG), ("kind", _LONG), ("range", _LONG), ("n", _LONG), ("keys", _BYTES), ("t", _BYTES), ("b", _BYTES))
TOTALS = _schema(("chunk", _LONG), ("kind", _LONG), ("range", _LONG), ("n", _LONG), ("distinct", _LONG), ("t", _BYTES), ("b", _BYTES))


def words(text: str) -> list[str]:
    """Words and single marks, in lower case."""
    return TOKEN.findall(text.lower())


def packed(values: np.ndarray) -> bytes:
    """Non-negative integers by byte planes, as many as the largest needs, compressed."""
    if not len(values):
        return b""
    width = max(1, (int(values.max()).bit_length() + 7) // 8)
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpacked(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if n:
        planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(-1, n)
        out[:, : len(planes)] = planes.T
    return out.reshape(-1).view("<u8")


def _chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents as chunks of word numbers, the most frequent word of a chunk first."""
    chunk = TaskContext.get().partitionId() << 33
    arrow = to_arrow_schema(CHUNKS)
    known: dict[str, int] = {}
    doc_ids, parts = [], []

    def closed() -> pa.RecordBatch:
        tokens = np.concatenate([*parts, np.zeros(0, np.int32)]).astype(np.int64)
        lengths = np.array([len(p) for p in parts], np.int64)
        often = np.argsort(-np.bincount(tokens, minlength=len(known)), kind="stable")
        number = np.empty(len(known), np.int64)
        number[often] = np.arange(len(known))
        hashes = np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in known], np.uint64)
        values = [chunk, len(tokens), len(known), packed(hashes[often]), packed(number[tokens]), doc_ids, lengths]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, arrow)], schema=arrow)

    held = 0
    for batch in batches:
        for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
            found = words(text)
            parts.append(np.fromiter((known.setdefault(w, len(known)) for w in found), np.int32, len(found)))
            doc_ids.append(doc_id)
            held += len(found) + 1
            if held >= CHUNK:
                yield closed()
                chunk, held, known = chunk + 1, 0, {}
                doc_ids, parts = [], []
    if doc_ids:
        yield closed()


def _entries(row: dict) -> tuple[dict[int, tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Of a chunk: by kind the sorted distinct keys and each token's place among them; and each token's document."""
    hashes = unpacked(row["words"], row["n_words"])
    tokens = unpacked(row["tokens"], row["n_tokens"]).astype(np.int64)
    lengths = np.array(row["lengths"], np.int64)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    # Number 0 is what stands before a document's first word.
    hashes = np.concatenate([np.zeros(1, np.uint64), hashes])
    now = tokens + 1
    last = np.concatenate([np.zeros(1, np.int64), now])[:-1]
    if len(doc):
        last[np.concatenate([[True], doc[1:] != doc[:-1]])] = 0
    pair = hashes[last] * np.uint64(0x9E3779B97F4A7C15) + hashes[now]
    pair ^= pair >> np.uint64(32)
    pair *= np.uint64(0xD6E8FEB86659FD93)
    pair ^= pair >> np.uint64(32)
    order = np.argsort(hashes, kind="stable")
    rank = np.empty(len(hashes), np.int64)
    rank[order] = np.arange(len(hashes))
    singles = hashes[order]
    return {PAIRS: np.unique(pair, return_inverse=True), WORDS: (singles, rank[now]), BEFORE: (singles, rank[last])}, doc


def _counted(bits: int):
    """The counts of a chunk's entries, cut by the first bits of their hashes."""
    arrow = to_arrow_schema(COUNTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if not row["n_tokens"]:
                    continue
                entries, doc = _entries(row)
                trusted = np.zeros(len(row["lengths"]), bool)
                trusted[np.array(row["targets"] or [], np.int64)] = True
                target = trusted[doc]
                out: list[list] = [[] for _ in arrow]
                for kind, (keys, at) in entries.items():
                    all_, ours = (np.bincount(x, minlength=len(keys)) for x in (at, at[target]))
                    part = keys >> np.uint64(64 - bits)
                    cuts = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(keys)]])
                    for lo, hi in zip(cuts[:-1], cuts[1:]):
                        steps = np.diff(keys[lo:hi], prepend=np.zeros(1, np.uint64))
                        for column, value in zip(out, (
                            row["chunk"], kind, int(part[lo]), int(hi - lo), packed(steps), packed(ours[lo:hi]), packed(all_[lo:hi]),
                        )):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(out, arrow)], schema=arrow)

    return run


def _totals(rows: pa.Table) -> pa.Table:
    """One hash range of one kind: every chunk's entries with their counts in the whole corpus."""
    sizes = rows.column("n").to_pylist()
    steps, ours, all_ = ([unpacked(d, n) for d, n in zip(rows.column(c).to_pylist(), sizes)] for c in ("keys", "t", "b"))
    keys, at = np.unique(np.concatenate([np.cumsum(s, dtype=np.uint64) for s in steps]), return_inverse=True)
    # Weighted counts are exact up to 2 ** 53.
    t, b = (np.bincount(at, np.concatenate(x).astype(np.float64)).astype(np.int64) for x in (ours, all_))
    places = np.split(at, np.cumsum(sizes)[:-1])
    distinct = [int((b > 0).sum())] + [0] * (len(sizes) - 1)
    values = [
        *(rows.column(c).combine_chunks() for c in ("chunk", "kind", "range", "n")), pa.array(distinct, pa.int64()),
        pa.array([packed(t[p]) for p in places], pa.binary()), pa.array([packed(b[p]) for p in places], pa.binary()),
    ]
    return pa.table(values, schema=to_arrow_schema(TOTALS))


def _scored(vocabulary: int, tokens: dict[str, int]):
    """The losses of a chunk's documents out of the totals of its entries."""
    arrow = pa.schema([
        ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("target_loss", pa.float64()),
        ("background_loss", pa.float64()), ("score", pa.float64()),
    ])

    def run(chunk: pa.Table, totals: pa.Table) -> pa.Table:
        (row,) = chunk.to_pylist()
        entries, doc = _entries(row)
        pieces = totals.sort_by([("kind", "ascending"), ("range", "ascending")]).to_pylist()
        lengths = np.array(row["lengths"], np.int64)
        uniform, means = 1.0 / max(vocabulary, 1), {}
        for which in "tb":
            count = {}
            for kind, (_, at) in entries.items():
                held = [unpacked(p[which], p["n"]) for p in pieces if p["kind"] == kind]
                count[kind] = np.concatenate([*held, np.zeros(0, np.uint64)])[at].astype(np.float64)
            one = WORD_SHARE * count[WORDS] / tokens[which] + (1 - WORD_SHARE) * uniform if tokens[which] else np.full(len(doc), uniform)
            two = PAIR_SHARE * count[PAIRS] / np.maximum(count[BEFORE], 1) + (1 - PAIR_SHARE) * one
            loss = -np.log2(np.where(count[BEFORE] > 0, two, one))
            means[which] = np.bincount(doc, loss, len(lengths)) / np.maximum(lengths, 1)
        none = lengths == 0
        return pa.table([
            pa.array(row["doc_ids"], pa.int64()), pa.array(lengths),
            *(pa.array(v, mask=none) for v in (means["t"], means["b"], means["t"] - means["b"])),
        ], schema=arrow)

    return run


def word_difference(docs: DataFrame, target: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, target_loss, background_loss, score`` of every row, by word bigram models.

    ``target`` has the ``doc_id`` of the trusted documents, which are scored by counts that hold their own.
    Both models share the vocabulary, all words of the documents, and the smoothing. Texts without words
    have no tokens and NULL losses and score; without any target document the target model is uniform;
    repeated rows score alike and count as often as they occur; an empty table gives no rows. Reads
    ``doc_id`` and ``text`` only. A text is never cut, so a chunk holds one very long text whole.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    chunks = written(rows.mapInArrow(_chunk_rows, CHUNKS), "lm-chunks")
    # Which documents are trusted is found by their ids alone, so that no text is shuffled for it.
    chosen = target.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    places = chunks.select("chunk", F.posexplode(F.arrays_zip("doc_ids", "lengths")).alias("at", "d"))
    places = places.select("chunk", "at", F.col("d.doc_ids").alias("doc_id"), F.col("d.lengths").alias("length"))
    targets = written(places.join(chosen, "doc_id", "left_semi").groupBy("chunk").agg(
        F.collect_list("at").alias("targets"), F.sum("length").alias("n_target")), "lm-targets")
    size = chunks.agg(F.sum("n_tokens").alias("b"), F.sum(F.col("n_tokens") + 2 * F.col("n_words") + 2).alias("entries")).first()
    trusted_tokens = targets.agg(F.sum("n_target")).first()[0] or 0
    bits = max(1, ((size["entries"] or 0) // RANGE).bit_length())
    # Joined alike at every size.
    counted = chunks.drop("doc_ids").join(targets.select("chunk", "targets").hint("merge"), "chunk", "left")
    counts = counted.mapInArrow(_counted(bits), COUNTS)
    totals = written(counts.groupBy("kind", "range").applyInArrow(_totals, TOTALS), "lm-totals")
    vocabulary = totals.filter(F.col("kind") == WORDS).agg(F.sum("distinct")).first()[0] or 0
    score = _scored(vocabulary, {"t": trusted_tokens, "b": size["b"] or 0})
    return chunks.groupBy("chunk").cogroup(totals.groupBy("chunk")).applyInArrow(score, LOSSES)
