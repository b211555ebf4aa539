"""Near copies by SimHash, linked over a byte-position inverted index with count filtering.

A 64-bit fingerprint is eight positional bytes. Two fingerprints that differ in at most two bits
share at least six of the eight, so six shared bytes are the guaranteed count. Single-byte posting
lists would hold 1/256 of the corpus each; the index therefore keys its lists by six positions and
their bytes at once, 28 lists per fingerprint. Members of a list differ in its two free bytes only,
so a list of distinct fingerprints has 65,536 members at most, whatever the corpus. Within a list
the shared bytes of a pair are tallied, pairs below six dropped, and the bits compared.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, per_batch, text_or_empty, written
from .graphs import components

BITS, NEAR = 64, 2
#: The two positions that a list leaves free; its key is the fingerprint without them.
FREE = list(combinations(range(8), 2))
KEYS = [((1 << 64) - 1) ^ (0xFF << 8 * i) ^ (0xFF << 8 * j) for i, j in FREE]
#: Up to so many members a list is compared pair by pair; beyond, each member looks its near
#: neighbours up, of which the two free bytes have no more than this.
PAIRWISE = 136


def fingerprint(text: str, width: int = 3, block: int = 1 << 16) -> int:
    """The unsigned SimHash of a whole text; 0 without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[i:] for i in range(width)))))
    ones, digest = np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(shingles), block):
        hashes = np.array([digest(s, 42) for s in shingles[at:at + block]], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(shingles), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a signed long) per row; NULL text counts as empty."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("fp", T.LongType())])

    def one(batch: pa.RecordBatch) -> dict:
        bits = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], "u8").view("i8")
        return {"doc_id": batch.column(0), "fp": bits}

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(per_batch(one, schema), schema)


def _offsets(free: tuple[int, int]) -> np.ndarray:
    """The bit patterns within two free bytes that have one or two bits."""
    bits = [1 << (8 * p + k) for p in free for k in range(8)]
    return np.array(bits + [x | y for x, y in combinations(bits, 2)], "u8")


def near_pairs(members: np.ndarray, free: int) -> tuple[np.ndarray, np.ndarray]:
    """The linked pairs of one list that are its to report: of the lists a pair meets in, the first."""
    members = np.unique(members.view("u8"))
    if len(members) <= PAIRWISE:
        i, j = np.triu_indices(len(members), 1)
        a, b = members[i], members[j]
    else:
        found = []
        for offset in _offsets(FREE[free]):
            other = members ^ offset
            at = np.minimum(np.searchsorted(members, other), len(members) - 1)
            hit = (members[at] == other) & (members < other)
            found.append((members[hit], other[hit]))
        a, b = (np.concatenate(x) for x in zip(*found))
    differ = a ^ b
    shared = np.ascontiguousarray(differ).view(np.uint8).reshape(-1, 8) == 0
    near = (shared.sum(1) >= 8 - NEAR) & (np.bitwise_count(differ) <= NEAR)
    a, b, shared = a[near], b[near], shared[near]
    first = np.full(len(a), len(FREE))
    for n in reversed(range(len(FREE))):
        fixed = [p for p in range(8) if p not in FREE[n]]
        first[shared[:, fixed].all(1)] = n
    own = first == free
    return a[own].view("i8"), b[own].view("i8")


def links(distinct: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of distinct fingerprints (column ``fp``) that differ in two bits at most, each once."""
    masks = F.array(*[F.col("fp").bitwiseAND(F.lit(int(np.uint64(m).view(np.int64)))) for m in KEYS])
    lists = (
        distinct.select("fp", F.posexplode(masks).alias("free", "key"))
        .groupBy("free", "key").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1).select("free", "fps")
    )
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def pairs(batch: pa.RecordBatch) -> dict:
        parts = [
            near_pairs(np.array(fps, "i8"), free)
            for free, fps in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
        ]
        empty = np.empty(0, "i8")
        return {n: np.concatenate([p[k] for p in parts] or [empty]) for k, n in enumerate("ab")}

    return lists.mapInArrow(per_batch(pairs, schema), schema)


def near_copies(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row.

    Reads ``doc_id`` and ``text`` only. NULL text counts as empty; texts without words have
    fingerprint zero and are linked like others; repeated rows fall into one component; a component
    whose ids are all NULL has a NULL id; an empty table gives no rows.
    """
    marked = written(fingerprints(docs), "simhash-docs")
    classes = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-classes")
    roots = components(written(links(classes.select("fp")), "simhash-links"), "simhash-stars")
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")
    )
    rooted = written(rooted, "simhash-roots")
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return marked.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id",
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents with one of each group of near copies: that with the group's smallest id.

    Of repeated rows with that id one stays; rows without an id have nothing to be kept or dropped
    by and all stay.
    """
    chosen = near_copies(docs).filter("doc_id = component_id").select("doc_id").distinct()
    chosen = written(chosen, "simhash-chosen")
    with_id = docs.filter("doc_id IS NOT NULL").join(chosen, docs["doc_id"] == chosen["doc_id"], "left_semi")
    return with_id.dropDuplicates(["doc_id"]).select(*docs.columns).union(docs.filter("doc_id IS NULL"))
