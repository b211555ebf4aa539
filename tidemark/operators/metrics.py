"""Figures of a run: outcomes, quality, throughput, errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import _col, normalize_purpose

# Counters of a run and the (entity, outcome) each one counts.
COUNTERS = {
    "new_properties": ("listing", "created"),
    "updated_properties": ("listing", "updated"),
    "unchanged_properties": ("listing", "unchanged"),
    "reactivated_properties": ("listing", "reactivated"),
    "missing_properties": ("listing", "missing"),
    "removed_properties": ("listing", "removed"),
    "offers_created": ("offer", "created"),
    "offers_updated": ("offer", "updated"),
    "offers_unchanged": ("offer", "unchanged"),
    "reactivated_offers": ("offer", "reactivated"),
    "missing_offers": ("offer", "missing"),
    "removed_offers": ("offer", "removed"),
    "photos_created": ("photo", "created"),
    "photos_updated": ("photo", "updated"),
    "photos_unchanged": ("photo", "unchanged"),
    "photos_inactivated": ("photo", "inactivated"),
}


def run_metrics(outcomes: DataFrame, by: list[str]) -> DataFrame:
    """All counters of a run from rows of (entity, outcome, listing id), in one aggregation.

    An offer that came back counts as updated too.
    """
    is_ = lambda entity, outcome: (F.col("entity") == entity) & (F.col("outcome") == outcome)
    sighted = (F.col("entity") == "listing") & F.col("outcome").isin("created", "updated", "unchanged", "reactivated")
    counts = [F.count_if(is_(*pair)).alias(name) for name, pair in COUNTERS.items()]
    seen = [F.count_if(sighted).alias("listings_seen"), F.count_if(sighted).alias("unique_external_ids")]
    return outcomes.groupBy(*by).agg(*seen, *counts)


def offers_seen(offers: DataFrame, by: list[str]) -> DataFrame:
    purpose = normalize_purpose("purpose")
    return offers.groupBy(*by).agg(
        F.count_if(purpose == "SALE").alias("sale_offers_seen"),
        F.count_if(purpose == "RENT").alias("rent_offers_seen"),
    )


def invalid_rate(invalid, seen) -> Column:
    """Share of invalid cards; none seen means none invalid."""
    return F.coalesce(F.try_divide(_col(invalid).cast("double"), F.nullif(_col(seen), F.lit(0))), F.lit(0.0))


def card_quality(pages: DataFrame, by: list[str]) -> DataFrame:
    """Invalid share (0 with no cards) and valid share (NULL with no cards) of a run."""
    sums = pages.groupBy(*by).agg(
        F.sum("raw_cards").cast("bigint").alias("cards_seen"), F.sum("invalid_cards").cast("bigint").alias("invalid_cards")
    )
    return card_ratios(sums)


def card_ratios(runs: DataFrame) -> DataFrame:
    """Adds both shares to rows of ``cards_seen`` and ``invalid_cards``."""
    valid = (F.col("cards_seen") - F.col("invalid_cards")).cast("double")
    return runs.withColumn("invalid_rate", invalid_rate("invalid_cards", "cards_seen")).withColumn(
        "valid_cards_ratio", F.try_divide(valid, F.nullif(F.col("cards_seen"), F.lit(0)))
    )


def child_status(offers: DataFrame, parent: list[str]) -> DataFrame:
    """Status the children give their parent: any active, all removed, else missing."""
    status = F.upper(F.coalesce("status", F.lit("ACTIVE")))
    return offers.groupBy(*parent).agg(
        F.when(F.bool_or(status == "ACTIVE"), "ACTIVE")
        .when(F.bool_and(status == "REMOVED"), "REMOVED")
        .otherwise("MISSING")
        .alias("child_status")
    )


def rollup_status(listings: DataFrame, offers: DataFrame, parent: list[str], now: Column) -> DataFrame:
    """Listings with status and marks renewed from their offers; without offers they stay."""
    status = F.col("child_status")
    none = lambda c: F.lit(None).cast(dict(listings.dtypes)[c])
    return (
        listings.join(child_status(offers, parent), parent, "left")
        .withColumn("status", F.coalesce(status, F.col("status")))
        .withColumn(
            "missing_since",
            F.when(status == "ACTIVE", none("missing_since"))
            .when(status == "MISSING", F.coalesce("missing_since", now))
            .otherwise(F.col("missing_since")),
        )
        .withColumn(
            "removed_at",
            F.when(status == "ACTIVE", none("removed_at"))
            .when(status == "REMOVED", F.coalesce("removed_at", now))
            .otherwise(F.col("removed_at")),
        )
        .drop("child_status")
    )


def runs_by_status(runs: DataFrame) -> DataFrame:
    is_ = lambda s: F.count_if(F.col("status") == s).alias(s)
    return runs.agg(F.count("*").alias("total"), is_("running"), is_("success"), is_("failed"))


def throughput(runs: DataFrame) -> DataFrame:
    """Seconds a run took, never below 0, and its pages a second."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    taken = (micros("finished_at") - micros("started_at")) / F.lit(1e6)
    seconds = F.when(taken.isNotNull(), F.greatest(taken, F.lit(0.0)))
    out = runs.withColumn("_s", seconds)
    rate = F.round(F.try_divide(F.col("pages_fetched").cast("double"), F.nullif(F.col("_s"), F.lit(0.0))), 6)
    asked = F.nullif(F.col("requests_total"), F.lit(0))
    return (
        out.withColumn("duration_seconds", F.round("_s", 6))
        .withColumn("pages_per_second", rate)
        .withColumn("requests_total", F.coalesce(asked, F.col("pages_fetched") + F.col("detail_pages_fetched")))
        .drop("_s")
    )


def first_reported_total(pages: DataFrame, by: list[str]) -> DataFrame:
    """The first total a run's pages report."""
    return pages.groupBy(*by).agg(
        F.min_by("reported_total", F.when(F.col("reported_total").isNotNull(), F.col("page"))).alias("reported_total")
    )


def collect_errors(errors: DataFrame, by: list[str]) -> DataFrame:
    """The distinct errors of each run, whole, with how often each occurred; one row per error, so
    a run that fails on every page is as many rows and never one list."""
    return errors.groupBy(*by, "page", "status_code", "url", "error").agg(F.count("*").alias("times"))
