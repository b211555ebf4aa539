"""Line dedup over levelled sorted runs of line hashes.

Documents are taken in batches of descending ids. A run holds the hashes of a batch's long lines,
sorted and bucketed by hash, each with the number of documents that hold it and the largest of their
ids. A new batch merges the runs written so far, leaves out the lines that they already show to be
repeated often enough (an anti-join: the batch's ids are smaller, so neither count nor keeper can
change what follows), and adds the rest as a run of its own. Whenever a level has ``FANOUT`` runs they
are compacted into one of the next level. All runs lie in one bucketed table, so that merging and
compacting them moves no row between tasks. The merged runs say in the end which lines are repeated
and who keeps them.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import work_dir
from .common import bounded_batches, per_batch, text_or_empty, written

#: A line counts from so many characters on and is repeated from so many documents on.
LEAST_CHARS, LEAST_DOCS = 40, 5
#: Batches of documents, and runs of a level that are compacted into one.
BATCHES, FANOUT = 8, 4
HASH = ["h1", "h2"]


def long_key(line: bytes, least: int) -> bytes | None:
    """What lines are compared by, the line without outer blanks and in lower case; None if it is short."""
    key = line.strip().lower()
    if len(key) < least or len(key) < 4 * least and len(key.decode("utf-8", "surrogatepass")) < least:
        return None
    return key


def line_hashes(text: bytes, least: int) -> list[bytes | None]:
    """The 128-bit hash of every line's key, None for short ones."""
    keys = (long_key(line, least) for line in text.split(b"\n"))
    return [None if k is None else xxhash.xxh3_128_digest(k) for k in keys]


def _rows(docs: DataFrame) -> DataFrame:
    """``doc_id, text, mark``: rows of one id and text are alike, and so is what happens to them."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.withColumn("mark", F.xxhash64("text"))


def _arrivals(rows: DataFrame, least: int) -> DataFrame:
    """``doc_id, mark, h1, h2`` per row and distinct long line."""
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "mark", *HASH)])

    def one(batch: pa.RecordBatch) -> dict:
        # A text of fewer characters has no long line.
        texts = [t.encode("utf-8", "surrogatepass") if len(t) >= least else None for t in batch.column("text").to_pylist()]
        found = [sorted(set(line_hashes(t, least)) - {None}) if t is not None else [] for t in texts]
        row = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
        hashes = np.frombuffer(b"".join(h for f in found for h in f), "<i8").reshape(-1, 2)
        return {
            "doc_id": batch.column("doc_id").take(row), "mark": batch.column("mark").take(row),
            "h1": hashes[:, 0], "h2": hashes[:, 1],
        }

    return rows.mapInArrow(per_batch(one, schema), schema)


class Runs:
    """The levelled runs: one table, bucketed and sorted by hash, with a partition a run."""

    def __init__(self, spark: SparkSession, fanout: int):
        self.spark, self.fanout = spark, fanout
        self.name, self.path = f"line_runs_{uuid.uuid4().hex}", work_dir(spark, "line-runs")
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[int]] = []
        self.made = 0

    def _write(self, run: DataFrame) -> int:
        number, self.made = self.made, self.made + 1
        (run.select(*HASH, "n", "keeper", F.lit(number).alias("run")).repartition(self.buckets, *HASH)
         .write.partitionBy("run").bucketBy(self.buckets, *HASH).sortBy(*HASH)
         .mode("append").option("path", self.path).saveAsTable(self.name))
        return number

    def read(self, numbers: list[int]) -> DataFrame:
        return self.spark.table(self.name).filter(F.col("run").isin(numbers))

    def merged(self, numbers: list[int]) -> DataFrame:
        """``h1, h2, n, keeper`` over some runs; every bucket is merged where it lies."""
        return self.read(numbers).groupBy(*HASH).agg(F.sum("n").alias("n"), F.max("keeper").alias("keeper"))

    @property
    def live(self) -> list[int]:
        return [n for level in self.levels for n in level]

    def unsettled(self, own: DataFrame, least: int) -> DataFrame:
        """What of a batch's lines the runs do not yet show to be repeated."""
        if not self.live:
            return own
        settled = self.merged(self.live).filter(F.col("n") >= least).select(*HASH)
        return own.join(settled.hint("merge"), HASH, "left_anti")

    def add(self, run: DataFrame, level: int = 0) -> None:
        """A new run on a level; a full level is compacted into a run of the next."""
        if len(self.levels) == level:
            self.levels.append([])
        self.levels[level].append(self._write(run))
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self.add(self.merged(full), level + 1)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def repeated_lines(arrivals: DataFrame, batches: int, fanout: int, least: int) -> DataFrame:
    """``h1, h2, keeper`` of the lines in ``least`` documents or more; ``arrivals`` has a ``batch``."""
    runs = Runs(arrivals.sparkSession, fanout)
    try:
        for batch in range(batches):
            own = arrivals.filter(F.col("batch") == batch).groupBy(*HASH).agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper"))
            runs.add(runs.unsettled(own, least))
        return written(runs.merged(runs.live).filter(F.col("n") >= least).select(*HASH, "keeper"), "lines-repeated")
    finally:
        runs.drop()


def drop_repeated_lines(
    docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, batches: int = BATCHES, fanout: int = FANOUT
) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept`` of every row; ``kept`` is the text without repeated lines.

    A line of at least ``least_chars`` characters that ``least_docs`` documents hold stays in that
    with the largest id only. Reads ``doc_id`` and ``text`` only. NULL text counts as empty, which is
    one empty line. Every row counts as a document, also repeated ones; rows of the largest id all
    keep the line. NULL ids are smaller than any other. An empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    rows = _rows(docs)
    shares = [n / batches for n in range(1, batches)] or [0.5]
    cuts = sorted(set(rows.agg(F.percentile_approx("doc_id", shares).alias("c")).first().c or []))[:batches - 1]
    batch = sum([F.when(F.col("doc_id") > c, 0).otherwise(1) for c in cuts], F.lit(0)).cast("int").alias("batch")
    path = work_dir(docs.sparkSession, "lines-arrivals")
    found = _arrivals(rows, least_chars)
    found.select("*", batch).write.partitionBy("batch").parquet(path)
    arrivals = docs.sparkSession.read.schema(T.StructType([*found.schema, T.StructField("batch", T.IntegerType())])).parquet(path)
    repeated = repeated_lines(arrivals, len(cuts) + 1, fanout, least_docs)
    gone = (
        arrivals.join(repeated, HASH).filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        .groupBy(F.col("doc_id").alias("gone_id"), F.col("mark").alias("gone_mark")).agg(F.collect_set("h1").alias("gone"))
    )
    mine = F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("mark") == F.col("gone_mark"))
    schema = T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("n_lines", T.LongType()),
        T.StructField("n_dropped", T.LongType()), T.StructField("kept", T.StringType()),
    ])

    def one(batch: pa.RecordBatch) -> dict:
        totals, dropped, kept = [], [], []
        for text, hashes in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            if not hashes:
                totals.append(text.count("\n") + 1), dropped.append(0), kept.append(text)
                continue
            raw, out = text.encode("utf-8", "surrogatepass"), {h.to_bytes(8, "little", signed=True) for h in hashes}
            lines = raw.split(b"\n")
            stay = [line for line, h in zip(lines, line_hashes(raw, least_chars)) if h is None or h[:8] not in out]
            totals.append(len(lines)), dropped.append(len(lines) - len(stay))
            kept.append(b"\n".join(stay).decode("utf-8", "surrogatepass"))
        return {"doc_id": batch.column(0), "n_lines": totals, "n_dropped": dropped, "kept": kept}

    told = rows.join(gone, mine, "left").select("doc_id", "text", "gone")
    return told.mapInArrow(per_batch(one, schema), schema)
