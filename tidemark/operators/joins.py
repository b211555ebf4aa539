"""Pairing listings with their children, their stored state and the run log.

No join here carries a broadcast hint: the planner broadcasts a side whose measured size is under
its threshold and otherwise shuffles on the keys, where adaptive execution splits hot ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def offers_with_listings(offers: DataFrame, listings: DataFrame, source, purposes: list[str]) -> DataFrame:
    """Offers of one source's listings, limited to some purposes."""
    own = listings.filter(F.col("source_key") == source)
    return offers.filter(F.col("purpose").isin(purposes)).join(own, "listing_id")


def with_children(listings: DataFrame, offers: DataFrame, photos: DataFrame, key: str = "listing_id") -> DataFrame:
    """Each listing with its offers by purpose and photos by position.

    Offers are unique by (listing, purpose) and photos by (listing, url), so an array is bounded
    by one listing's gallery, whatever the size of the tables.
    """
    by_purpose = offers.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct(*[c for c in _first(offers, "purpose") if c != key]))).alias("offers")
    )
    in_order = photos.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("position", "url"))).alias("photos")
    )
    empty = lambda c: F.coalesce(c, F.array())
    return (
        listings.join(by_purpose, key, "left")
        .join(in_order, key, "left")
        .withColumn("offers", empty(F.col("offers")))
        .withColumn("photos", empty(F.col("photos")))
    )


def _first(df: DataFrame, col: str) -> list[str]:
    return [col, *[c for c in df.columns if c != col]]


def match_existing(sightings: DataFrame, state: DataFrame, keys: list[str], prefix: str = "old_") -> DataFrame:
    """Every sighting with its stored row, if any, under prefixed names, in one join."""
    stored = state.select(
        *keys, F.lit(True).alias("_stored"),
        *[F.col(c).alias(prefix + c) for c in state.columns if c not in keys],
    )
    return sightings.join(stored, keys, "left").withColumn("is_new", F.col("_stored").isNull()).drop("_stored")


def unseen(state: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows that a run did not sight."""
    return state.join(seen.select(*keys), keys, "left_anti")


def missing_children(existing: DataFrame, incoming: DataFrame, parent: str, key: str) -> DataFrame:
    """Stored children their parent no longer lists; a parent that lists none loses none."""
    mentioned = incoming.select(parent).distinct()
    return existing.join(mentioned, parent, "left_semi").join(incoming.select(parent, key), [parent, key], "left_anti")


def purge_by_source(df: DataFrame, sources: DataFrame, source_key: str, guard: DataFrame | None = None) -> DataFrame:
    """Drop the rows of some sources; with ``guard``, only of those it has no rows for."""
    doomed = sources.select(source_key).distinct()
    if guard is not None:
        doomed = doomed.join(guard.select(source_key), source_key, "left_anti")
    return df.join(doomed, source_key, "left_anti")


def rekey_dimension(fact: DataFrame, mapping: DataFrame, fk: str) -> DataFrame:
    """Move facts from ``old_id`` to ``new_id``; other facts stay where they are."""
    return (
        fact.join(mapping.select(F.col("old_id").alias(fk), "new_id"), fk, "left")
        .withColumn(fk, F.coalesce("new_id", fk))
        .drop("new_id")
    )


def rekey_sources(sources: DataFrame, mapping: DataFrame) -> DataFrame:
    """The dimension's side of it: an old key goes if its new one exists, else it is renamed."""
    have = sources.select(F.col("key").alias("new_key"), F.lit(True).alias("_have"))
    plan = mapping.join(have, "new_key", "left").select(F.col("old_key").alias("key"), "new_key", "_have")
    return (
        sources.join(plan, "key", "left")
        .filter(F.col("_have").isNull())
        .withColumn("key", F.coalesce("new_key", "key"))
        .drop("new_key", "_have")
    )


def already_started(occurrences: DataFrame, runs: DataFrame, grace_minutes: int, how: str = "left_semi") -> DataFrame:
    """Occurrences a run of the same job began within the grace time and two minutes of.

    The interval condition is cut into time cells as wide as the interval, so that the join has
    an equality on time as well and a job with a long history does not meet all its runs.
    """
    width = (grace_minutes + 2) * 60_000_000
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    cell = F.floor(micros("created_at") / F.lit(width))
    begun = runs.select(
        F.col("provider_key").alias("_provider"),
        F.col("job_name").alias("_job"),
        F.get_json_object("summary", "$.schedule_job_id").alias("_id"),
        micros("created_at").alias("_begun"),
        F.explode(F.array(cell, cell - 1)).alias("_cell"),
    )
    slots = occurrences.withColumn("_slot", micros("scheduled_at"))
    cond = (
        (F.col("source_key") == F.col("_provider"))
        & (F.col("job_type") == F.col("_job"))
        & (F.col("job_id") == F.col("_id"))
        & (F.floor(F.col("_slot") / F.lit(width)) == F.col("_cell"))
        & (F.col("_begun") >= F.col("_slot"))
        & (F.col("_begun") <= F.col("_slot") + width)
    )
    return slots.join(begun, cond, how).drop("_slot")


def paired_verdict(results: DataFrame, keys: list[str], mode_col: str = "mode", result_col: str = "result") -> DataFrame:
    """Results of two ways to probe the same page on one row, with the step they call for."""
    wide = results.groupBy(*keys).pivot(mode_col, ["headless", "headed"]).agg(F.max(result_col))
    return wide.withColumn("next_step", _verdict(F.col("headless"), F.col("headed")))


def _verdict(headless: Column, headed: Column) -> Column:
    # Results of a probe and the next step each pair calls for.
    ok_less = F.coalesce(headless == "SUCCESS", F.lit(False))
    ok_headed = F.coalesce(headed == "SUCCESS", F.lit(False))
    either = lambda r: F.coalesce(headless == r, F.lit(False)) | F.coalesce(headed == r, F.lit(False))
    return (
        F.when(ok_less & (ok_headed | headed.isNull()), "PROCEED_WITH_PLAYWRIGHT_PROVIDER")
        .when(~ok_less & ok_headed, "HEADED_ONLY_NOT_SUITABLE_FOR_SERVER")
        .when(either("CAPTCHA_REQUIRED"), "CAPTCHA_REQUIRES_OFFICIAL_INTEGRATION")
        .when(either("SECURITY_CHALLENGE"), "BLOCKED_BY_SECURITY")
        .otherwise("INCONCLUSIVE")
    )
