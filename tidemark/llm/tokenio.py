"""Token-id files: documents' ids in ascending id order, coded by the context-mixing range coder.

A segment is self-contained: a header, the documents it holds whole (id and number of ids), a table
of its blocks (number of ids, bytes, CRC-32 of the code), the segment's model (the shares of its ids
and the mixture's weights) and the blocks' codes. Blocks restart the coder, so any block can be read,
checked and repaired with its segment's model alone. Spark writes the segments as rows of a
table, which gives them its commit protocol and any file system it knows; ``file`` and ``segment``
order them.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import work_dir
from . import rangecoder
from .common import bounded_batches, text_or_empty
from .rangecoder import BLOCK
from .tokens import piece_ids

MAGIC = b"TMIDS\x02"
HEADER = "<6sIIII"
#: A segment is closed at so many blocks; a longer document has a longer segment of its own.
SEGMENT_BLOCKS = 64
#: Blocks that a task codes together.
LANES = 2048

SEGMENT = T.StructType([
    T.StructField("file", T.IntegerType()), T.StructField("segment", T.IntegerType()),
    T.StructField("n_tokens", T.LongType()), T.StructField("payload", T.BinaryType()),
])
SPAN = T.StructType([
    T.StructField("file", T.IntegerType()), T.StructField("segment", T.IntegerType()), T.StructField("doc_id", T.LongType()),
    T.StructField("at", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()),
])


def pack_segments(groups: list[list[tuple[int | None, np.ndarray]]]) -> list[bytes]:
    """A segment out of each group of (document id, ids); all their blocks are coded in one run."""
    streams = [np.concatenate([ids for _, ids in g]) for g in groups]
    cuts = [[s[i:i + BLOCK] for i in range(0, len(s), BLOCK)] for s in streams]
    models, codes = rangecoder.encode_groups(cuts)
    segments = []
    for group, blocks, model, coded in zip(groups, cuts, models, codes):
        docs = b"".join(struct.pack("<?qI", d is not None, d or 0, len(ids)) for d, ids in group)
        table = b"".join(struct.pack("<III", len(b), len(c), zlib.crc32(c)) for b, c in zip(blocks, coded))
        index = docs + table + model.packed()
        head = struct.pack(HEADER, MAGIC, len(group), len(blocks), len(index), zlib.crc32(index))
        segments.append(b"".join([head, index, *coded]))
    return segments


def unpack_segments(payloads: list[bytes]) -> list[list[tuple[int | None, np.ndarray]]]:
    """The groups again. Raises ValueError where a segment is not one or a checksum differs."""
    heads, coded = [], []
    for payload in payloads:
        magic, n_docs, n_blocks, length, check = struct.unpack_from(HEADER, payload)
        at = struct.calcsize(HEADER)
        middle, models, end = at + 13 * n_docs, at + 13 * n_docs + 12 * n_blocks, at + length
        if magic != MAGIC or zlib.crc32(payload[at:end]) != check:
            raise ValueError("not a token segment, or its index is damaged")
        heads.append(list(struct.iter_unpack("<?qI", payload[at:middle])))
        model, _ = rangecoder.Model.unpacked(payload[models:end])
        codes, sizes = [], []
        for n, (size, length, crc) in enumerate(struct.iter_unpack("<III", payload[middle:models])):
            code = payload[end:end + length]
            if zlib.crc32(code) != crc:
                raise ValueError(f"block {n} of a token segment is damaged")
            codes.append(code)
            sizes.append(size)
            end += length
        coded.append((model, codes, sizes))
    groups = []
    for docs, blocks in zip(heads, rangecoder.decode_groups(coded)):
        stream = np.concatenate(blocks) if blocks else np.zeros(0, np.uint32)
        ends = np.cumsum([n for _, _, n in docs])
        groups.append([(d if known else None, stream[e - n:e]) for (known, d, n), e in zip(docs, ends)])
    return groups


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0) -> None:
    """Writes the ids of all documents, each ended by ``end_id``, in ascending order of ``doc_id``.

    Reads ``doc_id`` and ``text`` only. NULL text counts as empty and gives the end id alone; NULL
    ids come first; repeated ids follow each other by their texts' checksums. Ids from
    ``rangecoder.IDS`` on are refused.
    """
    schema = to_arrow_schema(SEGMENT)
    end = np.array([end_id], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, done = TaskContext.get().partitionId(), 0
        groups: list[list] = [[]]
        room, waiting = SEGMENT_BLOCKS * BLOCK, 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal done, waiting, groups
            full = [g for g in groups if g]
            for group, payload in zip(full, pack_segments(full)):
                total = sum(len(ids) for _, ids in group)
                columns = [[file], [done], [total], [payload]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
                done += 1
            groups, waiting = [[]], 0

        for batch in batches:
            ids, ends = piece_ids(tokenizer).encode(batch.column(1))
            for n, doc_id in enumerate(batch.column(0).to_pylist()):
                own = np.concatenate([ids[ends[n]:ends[n + 1]], end])
                if room < len(own) and groups[-1]:
                    groups.append([])
                    room = SEGMENT_BLOCKS * BLOCK
                groups[-1].append((doc_id, own))
                room -= len(own)
                waiting += len(own)
                if waiting >= LANES * BLOCK:
                    yield from flush()
                    room = SEGMENT_BLOCKS * BLOCK
        yield from flush()

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.crc32("text"))
    rows.mapInArrow(run, SEGMENT).write.option("compression", "uncompressed").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files: ``start`` counts the ids
    of all documents before it. Every block's checksum is verified on the way."""
    table = spark.read.schema(SEGMENT).parquet(path)
    schema = to_arrow_schema(SPAN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []
        tokens = 0

        def spans() -> pa.RecordBatch:
            rows = []
            for (file, segment, _), group in zip(held, unpack_segments([p for _, _, p in held])):
                at = 0
                for doc_id, ids in group:
                    rows.append((file, segment, doc_id, at, len(ids), zlib.crc32(ids.astype("<u4"))))
                    at += len(ids)
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * len(schema), schema)], schema=schema
            )

        for batch in batches:
            for file, segment, n, payload in zip(*(c.to_pylist() for c in batch.columns)):
                held.append((file, segment, payload))
                tokens += n
                if tokens >= LANES * BLOCK:
                    yield spans()
                    tokens = 0
        if held:
            yield spans()

    bounded_batches(spark)
    found = table.mapInArrow(run, SPAN)
    # Ids before each segment, in two steps: within its file, and in the files before.
    sizes = table.select("file", "segment", "n_tokens")
    inside = Window.partitionBy("file").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("file", "segment", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("inside"))
    files = table.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("earlier"))
    return found.join(sizes, ["file", "segment"]).join(files, "file").select(
        "doc_id", (F.col("earlier") + F.col("inside") + F.col("at")).alias("start"), "n_tokens", "ids_crc32",
    )


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 0, path: str | None = None) -> DataFrame:
    """Writes the token files (to the shared work folder unless told where) and reads them back.
    An empty table writes no segments and gives no rows."""
    path = path or work_dir(docs.sparkSession, "token-files")
    write_tokens(docs, path, tokenizer, end_id)
    return read_tokens(docs.sparkSession, path)
