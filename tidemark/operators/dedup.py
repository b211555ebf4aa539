"""Removing repeats in discovery order, merging offers, set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import gallery
from ..functions.text import normalize_purpose


def keep_first(df: DataFrame, keys: list[str], order: list[str], times: str | None = None) -> DataFrame:
    """The first row of each key in discovery order.

    Written as an aggregate, not a rank: each task reduces its share of a key to one row before
    the shuffle, so a key that holds much of the table costs no more than any other. The other
    columns break a tie in the order, which keeps the choice the same on every run. ``times`` names a
    column for the number of rows that the key has.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    first = F.min(F.struct(*order, *rest)).alias("_first")
    counted = [F.count(F.lit(1)).alias(times)] if times else []
    out = df.groupBy(*keys).agg(first, *counted).select(*keys, "_first.*", *([times] if times else []))
    return out.select(*df.columns, *([times] if times else []))


def page_duplicates(cards: DataFrame, page_keys: list[str], key: str, position: str = "position") -> DataFrame:
    """Every further card with an id its page already listed, with the reason for the report."""
    by = [*page_keys, key]
    first = cards.groupBy(*by).agg(F.min(position).alias("_first"))
    return (
        cards.join(first, by)
        .filter(F.col(position) > F.col("_first"))
        .drop("_first")
        .withColumn("error", F.lit("duplicate external_id on page"))
    )


def last_per_purpose(offers: DataFrame, parent: list[str], order: str) -> DataFrame:
    """One offer per parent and normalised SALE/RENT purpose: the latest by ``order``."""
    known = offers.withColumn("purpose", normalize_purpose("purpose")).filter(F.col("purpose").isin("SALE", "RENT"))
    keys = [*parent, "purpose"]
    rest = [c for c in known.columns if c not in keys and c != order]
    last = F.max(F.struct(order, *rest)).alias("_last")
    return known.groupBy(*keys).agg(last).select(*keys, "_last.*").select(*known.columns)


def offers_by_purpose(offers: Column) -> Column:
    """``last_per_purpose`` inside one record's offer array, sorted by purpose."""
    of = lambda purpose: F.filter(offers, lambda o: normalize_purpose(o["purpose"]) == purpose)
    last = lambda purpose: F.try_element_at(of(purpose), F.lit(-1)).withField("purpose", F.lit(purpose))
    return F.filter(F.array(last("RENT"), last("SALE")), lambda o: o["purpose"].isNotNull() & o.isNotNull())


def merge_offers(listing: DataFrame, detail: DataFrame, parent: list[str]) -> DataFrame:
    """Offers of card and detail page by purpose; the detail's whole offer wins."""
    keys = [*parent, "purpose"]
    values = [c for c in listing.columns if c not in keys]
    left, right = listing.alias("l"), detail.withColumn("_has", F.lit(True)).alias("d")
    pick = lambda c: F.when(F.col("d._has"), F.col(f"d.{c}")).otherwise(F.col(f"l.{c}")).alias(c)
    return left.join(right, keys, "full").select(*keys, *[pick(c) for c in values])


def display_images(listings: DataFrame, photos: DataFrame, thumb_pattern: str, key: str = "listing_id") -> DataFrame:
    """The pictures to show of each listing and its main one.

    ``photos`` is unique by (listing, url), which bounds a listing's array by its gallery.
    """
    active = photos.filter(F.coalesce("is_active", F.lit(True)) & F.col("url").isNotNull())
    arrays = active.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("position", "url"))).alias("_p"))
    stored = F.col("_p.url")
    fallback = F.concat(
        F.array("main_image_url", F.get_json_object("metadata", "$.main_image")),
        F.coalesce(F.from_json(F.get_json_object("metadata", "$.images"), "array<string>"), F.array()),
    )
    shown = gallery(F.when(F.size(stored) > 0, stored).otherwise(fallback), thumb_pattern)
    return (
        listings.join(arrays, key, "left")
        .withColumn("image_urls", shown)
        .withColumn("main_image_url", F.coalesce(F.get("image_urls", F.lit(0)), F.col("main_image_url")))
        .drop("_p")
    )


def union_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys of both frames and where each occurs, from one shuffle."""
    tag = lambda df, left: df.select(*keys, F.lit(left).alias("_a"), F.lit(not left).alias("_b"))
    return (
        tag(a, True).unionByName(tag(b, False))
        .groupBy(*keys)
        .agg(F.bool_or("_a").alias("in_a"), F.bool_or("_b").alias("in_b"))
    )


def compare_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """One row: are the key sets equal, are they disjoint, and the three counts."""
    return union_keys(a, b, keys).agg(
        F.count_if(F.col("in_a") & ~F.col("in_b")).alias("only_a"),
        F.count_if(F.col("in_b") & ~F.col("in_a")).alias("only_b"),
        F.count_if(F.col("in_a") & F.col("in_b")).alias("both"),
    ).select("*", ((F.col("only_a") == 0) & (F.col("only_b") == 0)).alias("equal"), (F.col("both") == 0).alias("disjoint"))


def concat_results(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
