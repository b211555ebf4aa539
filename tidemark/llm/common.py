"""What the training-data operators share: bounded Arrow batches, written tables, defaults."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import work_dir

#: What separates words wherever a contract speaks of words: space, tab and the other ASCII blanks.
BLANKS = "[\\x20\\x09-\\x0D]+"


def text_or_empty(name: str = "text") -> Column:
    """The text, an empty one for NULL."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def bounded_batches(spark: SparkSession) -> None:
    """Python tasks get Arrow batches of few rows and bytes, so that long texts never pile up."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def written(df: DataFrame, purpose: str, partitions: int | None = None) -> DataFrame:
    """The frame as a table in the shared work folder: later steps reread it instead of repeating
    the work, and a lost executor costs no more than its own tasks."""
    path = work_dir(df.sparkSession, purpose)
    (df.coalesce(partitions) if partitions else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def per_batch(fn, schema: T.StructType):
    """A mapInArrow function out of ``fn(batch) -> dict of columns``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = fn(batch)
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in arrow], schema=arrow)

    return run


def per_process(key: tuple, make: Callable):
    """``make()``, once per Python process. Workers outlive tasks, but functions reach them anew with
    every task, so what is costly to build is kept with the interpreter and not with a module."""
    kept = vars(sys).setdefault("_tidemark_kept", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]
