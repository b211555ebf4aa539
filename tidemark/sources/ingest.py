"""Seeding dimensions and taking in records from outside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def seed_dimension(
    existing: DataFrame, seed: DataFrame, key: str, update_cols: list[str], on_conflict: str = "update"
) -> DataFrame:
    """Insert-or-update of dimension rows by key; running it again changes nothing.

    With ``update`` the named columns of a known row take the seed's values, with ``ignore`` a
    known row stays as it is.
    """
    if on_conflict not in ("update", "ignore"):
        raise ValueError("on_conflict is 'update' or 'ignore'")
    cols = [c for c in existing.columns if c != key]
    sown = seed.select(key, F.lit(True).alias("_sown"), *[F.col(c).alias("s_" + c) for c in cols if c in seed.columns])
    joined = existing.withColumn("_known", F.lit(True)).join(sown, key, "full")

    def value(c: str) -> Column:
        if c not in seed.columns:
            return F.col(c)
        overwrite = F.col("_known").isNull()
        if on_conflict == "update" and c in update_cols:
            overwrite = overwrite | F.coalesce("_sown", F.lit(False))
        return F.when(overwrite, F.col("s_" + c)).otherwise(F.col(c)).alias(c)

    return joined.select(key, *[value(c) for c in cols]).select(*existing.columns)


def ingest_records(state: DataFrame, records: DataFrame, keys: list[str], now: Column, order: list[str] = ()) -> DataFrame:
    """Upsert of outside records: one row per key, of which only the fields sent overwrite.

    A record carries its fields as a map of text, so that a field sent empty differs from one
    not sent; fields the inventory does not know are dropped. Metadata is JSON text. Of several records
    of a key the last by ``order`` counts, of equals the greatest by its JSON text. A value that cannot be
    read leaves the stored one; an empty one clears it.
    """
    types = dict(state.dtypes)
    rank = F.struct(*order, F.to_json(F.map_from_entries(F.array_sort(F.map_entries("fields")))).alias("_text"))
    records = records.groupBy(*keys).agg(F.max_by("fields", rank).alias("fields"))
    sent = lambda c: F.map_contains_key("fields", c)
    text = lambda c: F.try_element_at(F.col("fields"), F.lit(c))
    metadata = text("metadata")
    main = F.coalesce(
        F.nullif(F.get_json_object(metadata, "$.main_image"), F.lit("")), F.get_json_object(metadata, "$.images[0]")
    )
    no_main = F.coalesce(text("main_image_url"), F.lit("")) == ""
    has_metadata = F.coalesce(metadata, F.lit("{}")) != "{}"
    no_url = F.coalesce(text("source_url"), F.lit("")) == ""
    joined = state.withColumn("_known", F.lit(True)).join(records.withColumn("_sent", F.lit(True)), keys, "full")

    def value(c: str) -> Column:
        read = text(c).try_cast(types[c])
        unread = read.isNull() & (F.coalesce(F.trim(text(c)), F.lit("")) != "")
        new = F.when(sent(c) & ~unread, read).otherwise(F.col(c))
        if c == "source_url":
            new = F.when(no_url, text("url")).otherwise(text("source_url"))
        elif c == "main_image_url":
            new = F.when(has_metadata & no_main, main).otherwise(new)
        elif c == "last_seen_at":
            new = now
        elif c == "first_seen_at":
            new = F.when(F.col("_known"), F.coalesce(F.col(c), now)).otherwise(new)
        elif c == "status":
            new = F.lit("ACTIVE")
        elif c in ("missing_since", "removed_at"):
            new = F.lit(None).cast(types[c])
        return F.when(F.col("_sent"), new).otherwise(F.col(c)).cast(types[c]).alias(c)

    return joined.select(*keys, *[value(c) for c in state.columns if c not in keys])


def ingest_summary(records: DataFrame, required: list[str]) -> DataFrame:
    """How many records of a batch can be taken in and how many lack a required field."""
    whole = F.lit(True)
    for c in required:
        whole = whole & F.coalesce(F.trim(F.col(c).cast("string")) != "", F.lit(False))
    return records.agg(
        F.count_if(whole).alias("ingested"), F.count_if(~whole).alias("failed"), F.count("*").alias("total")
    )
