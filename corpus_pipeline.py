"""The corpus pipeline: toxic documents and junk go, one of each group of near copies stays, and what
is left is packed into training sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; ``run`` writes
every stage's rows as Parquet to the shared work folder and rereads them for the next. All stages but
the last return the columns of ``documents``; the last returns the packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import copies, packing, quality, toxicity
from tidemark.llm.common import written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar, learned from the labels, scores below one half."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_junk(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep_good(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies (five-word shingles, similarity 0.8)."""
    return copies.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of the documents and their places in sequences of 4096 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("quality", drop_junk), ("near_copies", drop_copies), ("packing", pack)]

#: SQL can express neither the learned grammar nor hashed shingles nor tokens; the tests compare
#: the stages with plain loops instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, with all stages applied to ``documents``.

    NULL and empty texts are documents without words: the quality stage rejects them. Rows without an id pass
    the near-copy stage, of repeated rows with an id one stays. Columns besides ``doc_id`` and ``text`` travel
    along unread, apart from ``lang``, which names the language reference of the quality stage. An empty
    table gives no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
