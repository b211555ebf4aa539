"""Alignment of two tokenizers' tokens, an Arrow-native pipeline inside Spark tasks.

Both tokenizers' ids are Arrow lists. Flattened, with their parents' indices, their byte lengths are
summed within each parent to byte ends; an Acero hash join on (parent, end) finds the ends that both
tokenizers share, those cut the tokens into groups, and a second hash join on the group pairs the
tokens up. ``Table.group_by`` reduces the pairs to distinct ones per document and counts them; Spark
merges these partial counts over the corpus, tells every pair its count and whether it is the best of
its first id, and brings that back to where the documents are.

A parent is a unit: a text, or what lies between two single blanks of it, where neither tokenizer can
merge and both therefore end a token. Equal units are aligned once per worker, and documents are lists
of units. Documents are gathered into chunks of bounded dictionaries; a chunk stores for every document
the units it holds and for every unit the pairs it links, which is all that scoring needs.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import work_dir
from .bpe import byte_letters
from .common import bounded_batches, per_batch, per_process, text_or_empty
from .pieces import cut
from .tokens import ragged

#: Units that a worker remembers of its last batches and units that came again, of at most so many characters.
RECENT, REMEMBERED, LONG_UNIT = 50_000, 100_000, 64
#: Units that are aligned at a time, as the tokenizers' results are many times the text.
ALIGNED = 1 << 14
#: A chunk is closed when its dictionary has so many units or pairs, or its units link so many.
MOST_UNITS, MOST_PAIRS, MOST_LINKS = 1 << 18, 1 << 20, 1 << 23

#: Of a unit: tokens of either side, groups, its linked pairs (``a << 32 | b``, a row per link), and
#: the groups as text. None where the tokens do not spell the text.
Aligned = tuple[int, int, int, bytes, str] | None


def lists(values: list[list[int]]) -> pa.ListArray:
    sizes = np.fromiter(map(len, values), np.int64, len(values))
    flat = np.fromiter(chain.from_iterable(values), np.int32, int(sizes.sum()))
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), flat)


def ends_in_parents(ids: pa.ListArray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The flattened ids, their parents, and the byte after each, counted within the parent."""
    flat, parents = pc.list_flatten(ids).to_numpy(), pc.list_parent_indices(ids).to_numpy().astype(np.int64)
    sums = np.concatenate([[0], np.cumsum(lengths[flat])])
    begins = sums[ids.offsets.to_numpy()[:-1]]
    return flat.astype(np.int64), parents, sums[1:] - begins[parents]


class Aligner:
    """Two tokenizer files: a byte-level one (A) and a piece model that adds a blank in front (B)."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True  # their strings are plain text
        letters = byte_letters()
        with open(a_path, encoding="utf-8") as file:
            spec = json.load(file)
        special = {t["content"] for t in spec["added_tokens"]}
        vocab = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.a_bytes[i] = token.encode() if token in special else bytes(letters[c] for c in token)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [
            bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]
        #: Whether no piece goes on over a blank after another character, so that texts may be cut there.
        self.cuts = not any(x != "▁" and y == "▁" for p in pieces for x, y in zip(p, p[1:]))
        self.a_sizes, self.b_sizes = (np.array([len(t) for t in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        self.recent: dict[str, Aligned] = {}
        self.kept: dict[str, Aligned] = {}

    def align(self, units: list[str]) -> list[Aligned]:
        """What the two tokenizers make of a blank and each unit."""
        return [made for at in range(0, len(units), ALIGNED) for made in self._align(units[at:at + ALIGNED])]

    def _align(self, units: list[str]) -> list[Aligned]:
        a_ids = [e.ids for e in self.a.encode_batch_fast([" " + u for u in units], add_special_tokens=False)]
        b_ids = self.b.encode(units, num_threads=1)
        spell = lambda ids, table: b"".join([table[i] for i in ids])
        texts = [b" " + u.encode("utf-8", "surrogatepass") for u in units]
        good = [spell(x, self.a_bytes) == t == spell(y, self.b_bytes) for t, x, y in zip(texts, a_ids, b_ids)]
        which = [n for n, ok in enumerate(good) if ok]
        made: list[Aligned] = [None] * len(units)
        if not which:
            return made
        a_lists, b_lists = lists([a_ids[n] for n in which]), lists([b_ids[n] for n in which])
        a, a_of, a_end = ends_in_parents(a_lists, self.a_sizes)
        b, b_of, b_end = ends_in_parents(b_lists, self.b_sizes)
        a_key, b_key = a_of << 32 | a_end, b_of << 32 | b_end
        both = pa.table({"end": a_key}).join(pa.table({"end": b_key}), "end", join_type="inner", use_threads=False)
        cuts = np.sort(both.column("end").to_numpy())
        a_group, b_group = np.searchsorted(cuts, a_key), np.searchsorted(cuts, b_key)
        linked = pa.table({"group": a_group, "a": a}).join(pa.table({"group": b_group, "b": b}), "group", join_type="inner", use_threads=False)
        of = cuts >> 32
        group, x, y = (linked.column(c).to_numpy() for c in ("group", "a", "b"))
        order = np.argsort(group, kind="stable")
        pairs, links = (x << 32 | y)[order], np.bincount(of[group], minlength=len(which))
        groups = np.bincount(of, minlength=len(which))
        texts = self._rendered((a, a_of, a_group), (b, b_of, b_group), len(which))
        n_a, n_b, upto = np.diff(a_lists.offsets.to_numpy()), np.diff(b_lists.offsets.to_numpy()), np.cumsum(links)
        for k, n in enumerate(which):
            made[n] = int(n_a[k]), int(n_b[k]), int(groups[k]), pairs[upto[k] - links[k]:upto[k]].tobytes(), texts[k]
        return made

    @staticmethod
    def _rendered(a_side: tuple, b_side: tuple, count: int) -> list[str]:
        """The groups of every parent as ``a,a|b;a|b,b``."""
        ids, of, group = (np.concatenate(c) for c in zip(a_side, b_side))
        place = group * 2 + np.repeat([0, 1], [len(a_side[0]), len(b_side[0])])
        order = np.argsort(place, kind="stable")
        place, of = place[order], of[order]
        same, last = np.append(place[1:] == place[:-1], False), np.append(of[1:] != of[:-1], True)
        marks = np.where(same, 0, np.where(place % 2 == 0, 1, np.where(last, 3, 2)))
        mark = pa.array([",", "|", ";", ""]).take(pa.array(marks))
        parts = pc.binary_join_element_wise(pc.cast(pa.array(ids[order]), pa.string()), mark, "")
        ends = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=count))]).astype(np.int32)
        return pc.binary_join(pa.ListArray.from_arrays(ends, parts), "").to_pylist()

    def units(self, texts: pa.Array) -> tuple[list[str], list[Aligned], np.ndarray, np.ndarray]:
        """The distinct units of some texts, what they align to, the units of all texts in a row, and
        where each text's begin and end."""
        if self.cuts:
            pieces = cut(texts, lead=True, marks=False)
            names = [p[1:] if p[:1] == " " else p for p in pieces.words]
            at, ends, whole = pieces.at, pieces.ends, pieces.whole
        else:
            names, at, ends, whole = [], np.zeros(len(texts), np.int64), np.arange(len(texts) + 1), np.ones(len(texts), bool)
        which = np.flatnonzero(whole)
        if len(which):  # each becomes one unit, its pieces are left out
            keep = np.repeat(~whole, np.diff(ends))
            keep[ends[which]] = True
            at = at.copy()
            at[ends[which]] = len(names) + np.arange(len(which))
            names = names + [texts[int(t)].as_py() for t in which]
            ends, at = np.concatenate([[0], np.cumsum(keep)])[ends], at[keep]
        used = np.zeros(len(names), bool)
        used[at] = True
        # Most units come once: those that a later batch has again are kept longer than the others.
        if len(self.kept) > REMEMBERED:
            self.kept = {}
        aligned: list[Aligned] = [None] * len(names)
        new: dict[str, list[int]] = {}
        for n in np.flatnonzero(used).tolist():
            name = names[n]
            if name in self.kept:
                aligned[n] = self.kept[name]
            elif name in self.recent:
                aligned[n] = self.kept[name] = self.recent.pop(name)
            else:
                new.setdefault(name, []).append(n)
        if len(self.recent) > RECENT:
            self.recent = {}
        for (name, places), made in zip(new.items(), self.align(list(new))):
            for n in places:
                aligned[n] = made
            if len(name) <= LONG_UNIT:
                self.recent[name] = made
        return names, aligned, at, ends


def aligner(a_path: str, b_path: str) -> Aligner:
    """The aligner of two files, one per process."""
    return per_process(("aligner", a_path, b_path), lambda: Aligner(a_path, b_path))


#: The rows that the first pass writes, by ``kind``: documents, a chunk's pairs, a chunk's units.
DOCUMENT, PAIR, UNITS = 0, 1, 2
STORED = T.StructType([
    T.StructField("kind", T.IntegerType()), T.StructField("chunk", T.LongType()),
    *[T.StructField(n, T.LongType()) for n in ("doc_id", "n_a", "n_b", "n_groups", "n_links")],
    T.StructField("groups_sha256", T.StringType()), T.StructField("which", T.BinaryType()), T.StructField("times", T.BinaryType()),
    *[T.StructField(n, T.IntegerType()) for n in ("pos", "a", "b")], T.StructField("n", T.LongType()),
])
ARROW = to_arrow_schema(STORED)


def stored(count: int, **columns) -> pa.RecordBatch:
    """Rows of ``STORED`` with the named columns, NULL in the others."""
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(count, f.type) for f in ARROW], schema=ARROW)


def sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The sums of the stretches of values between the ends."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[ends[1:]] - total[ends[:-1]]


class Chunk:
    """The dictionary of a stretch of documents: their units, and the pairs that those link."""

    def __init__(self, number: int):
        self.number, self.index = number, {}
        self.links: list[bytes] = []
        self.counts = pa.table({"pair": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})

    def add(self, names: list[str], aligned: list[Aligned], at: np.ndarray, ends: np.ndarray, doc_ids: pa.Array, empty: np.ndarray) -> pa.RecordBatch:
        """The documents' rows; their pairs are counted in the dictionary."""
        known = np.array([e is not None for e in aligned] or [False], bool)
        bad = empty | (sums(~known[at] if len(at) else np.zeros(0, bool), ends) > 0)
        at_doc = np.repeat(np.arange(len(empty)), np.diff(ends))
        keep = ~bad[at_doc]
        figures = np.array([e[:3] + (len(e[3]) // 8,) if e else (0, 0, 0, 0) for e in aligned] or [(0, 0, 0, 0)], np.int64)
        place = np.full(len(known), -1, np.int64)
        for n in np.unique(at[keep]).tolist():
            place[n] = self.index.setdefault(names[n], len(self.index))
            if place[n] == len(self.links):
                self.links.append(aligned[n][3])
        per_doc, times = np.unique(at_doc[keep] << 32 | place[at[keep]], return_counts=True)
        doc, unit = per_doc >> 32, per_doc & 0xFFFFFFFF
        # Every document's pairs: those of its distinct units.
        own = np.unique(unit)
        parts = [self.links[u] for u in own.tolist()]
        sizes = np.array([len(p) // 8 for p in parts], np.int64)
        nth = np.searchsorted(own, unit)
        counts = sizes[nth] if len(nth) else np.zeros(0, np.int64)
        begins = (np.cumsum(sizes) - sizes)[nth] if len(nth) else counts
        pairs = ragged(np.frombuffer(b"".join(parts), "<i8"), begins, counts)
        distinct = pa.table({"doc": np.repeat(doc, counts), "pair": pairs}).group_by(["doc", "pair"], use_threads=False).aggregate([])
        found = distinct.group_by("pair", use_threads=False).aggregate([([], "count_all")]).rename_columns(["pair", "n"])
        merged = pa.concat_tables([self.counts, found]).group_by("pair", use_threads=False).aggregate([("n", "sum")])
        self.counts = merged.rename_columns(["pair", "n"])
        text_of = [e[4] if e else "" for e in aligned]
        digests = [
            "" if no else sha256(";".join([text_of[u] for u in at[x:y].tolist()]).encode()).hexdigest()
            for no, x, y in zip(bad, ends[:-1].tolist(), ends[1:].tolist())
        ]
        totals = np.array([sums(np.where(keep, figures[at, c], 0) if len(at) else np.zeros(0, np.int64), ends) for c in range(4)])
        cuts = np.searchsorted(doc, np.arange(len(empty) + 1))
        unit, times = unit.astype("<u4"), times.astype("<u4")
        slices = lambda v: [v[x:y].tobytes() for x, y in zip(cuts[:-1], cuts[1:])]
        same = lambda v: np.full(len(empty), v)
        return stored(
            len(empty), kind=same(DOCUMENT), chunk=same(self.number), doc_id=doc_ids, n_a=totals[0], n_b=totals[1], n_groups=totals[2],
            n_links=totals[3], groups_sha256=digests, which=slices(unit), times=slices(times),
        )

    @property
    def full(self) -> bool:
        return len(self.links) >= MOST_UNITS or len(self.counts) >= MOST_PAIRS or sum(map(len, self.links)) >= MOST_LINKS * 8

    def closed(self) -> Iterator[pa.RecordBatch]:
        """The rows of the chunk's units and of its pairs, numbered."""
        counts = self.counts.sort_by("pair")
        pairs = counts.column("pair").to_numpy()
        flat = np.frombuffer(b"".join(self.links), "<i8")
        places, sizes = np.searchsorted(pairs, flat).astype("<u4"), np.array([len(x) // 8 for x in self.links], "<u4")
        yield stored(1, kind=[UNITS], chunk=[self.number], which=[places.tobytes()], times=[sizes.tobytes()])
        for x in range(0, len(pairs), 1 << 16):
            part = pairs[x:x + (1 << 16)]
            same = lambda v: np.full(len(part), v)
            yield stored(
                len(part), kind=same(PAIR), chunk=same(self.number), pos=np.arange(x, x + len(part)), a=part >> 32, b=part & 0xFFFFFFFF,
                n=counts.column("n").slice(x, len(part)).combine_chunks(),
            )


def _first_pass(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, chunk = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            if chunk is None:
                chunk = Chunk(part << 32 | made)
            texts = batch.column(1).cast(pa.string())
            empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
            yield chunk.add(*aligner(a_path, b_path).units(texts), batch.column(0), empty)
            if chunk.full:
                yield from chunk.closed()
                chunk, made = None, made + 1
        if chunk is not None:
            yield from chunk.closed()

    return docs.mapInArrow(run, STORED)


RESULT = T.StructType([
    *[T.StructField(n, T.LongType()) for n in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")],
    T.StructField("groups_sha256", T.StringType()),
])


def _scored(rows: pa.Table, told: pa.Table) -> pa.Table:
    """A chunk's documents with what its pairs' counts add up to."""
    arrow = to_arrow_schema(RESULT)
    kind = rows.column("kind").to_numpy()
    docs, units = rows.filter(pa.array(kind == DOCUMENT)), rows.filter(pa.array(kind == UNITS))
    count, best = np.zeros(len(told) + 1, np.int64), np.zeros(len(told) + 1, np.int64)
    place = told.column("pos").to_numpy()
    count[place], best[place] = told.column("count").to_numpy(), told.column("best").to_numpy()
    places, sizes = (np.frombuffer(units.column(c)[0].as_py(), "<u4") for c in ("which", "times"))
    ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    per_unit = [sums(v[places], ends) for v in (count, best)]
    which, times = (docs.column(c).to_pylist() for c in ("which", "times"))
    cuts = np.concatenate([[0], np.cumsum([len(w) // 4 for w in which], dtype=np.int64)]).astype(np.int64)
    which, times = (np.frombuffer(b"".join(c), "<u4") for c in (which, times))
    count_sum, n_best = (sums(v[which] * times, cuts) if len(which) else np.zeros(len(docs), np.int64) for v in per_unit)
    found = {n: docs.column(n) for n in docs.column_names} | {"n_best": pa.array(n_best), "count_sum": pa.array(count_sum)}
    return pa.table([found[f.name] for f in arrow], schema=arrow)


def link_counts(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row.

    Files A and B must be readable by the executors. Links are the pairs of tokens in one group, a
    pair's count the number of rows that hold it linked. Reads ``doc_id`` and ``text`` only. NULL and
    empty texts and those that the tokens do not spell have no tokens: zeros and an empty digest.
    Every row counts as a document, also repeated ones and those without an id. An empty table gives
    no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    path = work_dir(spark, "alignment")
    _first_pass(rows, a_path, b_path).write.partitionBy("kind").parquet(path)
    whole = spark.read.schema(T.StructType([*STORED.fields[1:], STORED.fields[0]])).parquet(path)
    pairs = whole.filter(F.col("kind") == PAIR).select("chunk", "pos", "a", "b", "n")
    counts = pairs.groupBy("a", "b").agg(F.sum("n").alias("count"))
    # An A id has at most as many partners as B has ids.
    most = F.max("count").over(Window.partitionBy("a"))
    counts = counts.withColumn("best", (F.col("count") == most).cast("int"))
    told = pairs.join(counts, ["a", "b"]).select(F.col("chunk").alias("of_chunk"), "pos", "count", "best")
    held = whole.filter(F.col("kind") != PAIR).select("chunk", "kind", *[f.name for f in RESULT if f.name in STORED.names], "which", "times")
    return held.groupBy("chunk").cogroup(told.groupBy("of_chunk")).applyInArrow(_scored, RESULT)


def groups(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``doc_id, groups``: the aligned groups of every row as ``a1,a2|b1;a3|b2,b3``, NULL without tokens."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("groups", T.StringType())])

    def one(batch: pa.RecordBatch) -> dict:
        texts = batch.column(1).cast(pa.string())
        _, aligned, at, ends = aligner(a_path, b_path).units(texts)
        told = []
        for n, text in enumerate(texts):
            own = [aligned[u] for u in at[ends[n]:ends[n + 1]].tolist()]
            told.append(";".join([e[4] for e in own]) if text.as_py() and None not in own else None)
        return {"doc_id": batch.column(0), "groups": told}

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(per_batch(one, schema), schema)
