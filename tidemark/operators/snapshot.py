"""Merging a run's cards and detail pages into the stored inventory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import dedupe_array, dedupe_urls
from ..functions.hashing import offer_hash
from ..functions.text import _col, normalize_purpose
from .lifecycle import AbsencePolicy

# Columns of a listing by how a sighting or a detail page may change them.
CARD_COLUMNS = [
    "title", "transaction_type", "property_type", "property_subtype", "city", "state", "neighborhood",
    "address_line", "price", "bedrooms", "suites", "bathrooms", "parking_spaces", "area_m2", "main_image_url",
]
DETAIL_TEXT = [
    "title", "property_type", "property_subtype", "neighborhood", "address_line", "city", "state", "description",
]
DETAIL_NUMBERS = [
    "price", "bedrooms", "suites", "bathrooms", "parking_spaces", "area_m2", "condominium_fee", "property_tax",
    "price_per_m2", "latitude", "longitude",
]
TRACKED_FIELDS = [
    "title", "description", "transaction_type", "property_type", "property_subtype", "condominium_fee",
    "property_tax", "price_per_m2", "address_line", "city", "state", "neighborhood", "bedrooms", "suites",
    "bathrooms", "parking_spaces", "area_m2", "main_image_url", "latitude", "longitude", "detail_hash", "tags",
]
DEFAULT_CURRENCY = "BRL"


def merge_preserving(
    existing: DataFrame, incoming: DataFrame, keys: list[str], cols: list[str], defaults: dict[str, str] | None = None
) -> DataFrame:
    """New values overwrite old ones, a missing new value keeps the old, then the default."""
    value = lambda c: F.coalesce(
        F.col(f"n.{c}"), F.col(f"o.{c}"), *([F.lit(defaults[c])] if c in (defaults or {}) else [])
    ).alias(c)
    return existing.alias("o").join(incoming.alias("n"), keys, "full").select(*keys, *[value(c) for c in cols])


def overlay_rules(text: list[str], numbers: list[str], base: str, over: str) -> dict[str, Column]:
    """A detail page's text counts if not empty, its number if present."""
    rules = {c: F.coalesce(F.nullif(F.col(over + c), F.lit("")), F.col(base + c)) for c in text}
    rules.update({c: F.coalesce(F.col(over + c), F.col(base + c)) for c in numbers})
    return rules


def overlay_detail(sightings: DataFrame, details: DataFrame, keys: list[str], now: Column) -> DataFrame:
    """Cards with what their detail page adds or corrects."""
    have = set(details.columns) - set(keys)
    extra = details.select(*keys, F.lit(True).alias("d_here"), *[F.col(c).alias("d_" + c) for c in sorted(have)])
    joined = sightings.join(extra, keys, "left")
    fill = lambda cols: [c for c in cols if c in have]
    for c in fill(DETAIL_TEXT + DETAIL_NUMBERS):
        if c not in sightings.columns:
            joined = joined.withColumn(c, F.lit(None).cast(dict(details.dtypes)[c]))
    rules = overlay_rules(fill(DETAIL_TEXT), fill(DETAIL_NUMBERS), "", "d_")
    if {"main_image_url", "image_urls"} & have:
        own = [F.nullif("d_main_image_url", F.lit(""))] if "main_image_url" in have else []
        first = [F.get("d_image_urls", F.lit(0))] if "image_urls" in have else []
        rules["main_image_url"] = F.coalesce(*own, *first, "main_image_url")
    if "tags" in have:
        empty = F.array().cast("array<string>")
        both = F.concat(F.coalesce("tags", empty), F.coalesce("d_tags", empty))
        rules["tags"] = F.when(F.col("d_here"), dedupe_array(both)).otherwise(F.col("tags"))
    rules["detail_last_fetched_at"] = F.when(F.col("d_here"), now)
    rules["has_detail"] = F.coalesce("d_here", F.lit(False))
    return joined.withColumns(rules).drop(*[c for c in joined.columns if c.startswith("d_")])


def merge_metadata(old, new) -> Column:
    """Key by key, the right side wins; no setting for repeated keys is needed."""
    empty = F.create_map().cast("map<string,string>")
    old, new = F.coalesce(_col(old), empty), F.coalesce(_col(new), empty)
    return F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k)), new)


def _json_value(col: str, data_type: str) -> str:
    """SQL for one column's value as JSON text, a decimal in quotes."""
    value = f"CAST({col} AS STRING)" if data_type.startswith(("decimal", "timestamp")) else col
    return f"substr(to_json(array({value})), 2, length(to_json(array({value}))) - 2)"


def changed_fields(df: DataFrame, cols: list[str], old: str = "old_", new: str = "") -> Column:
    """The columns that differ, by name, as an array of (name, old, new) in JSON text."""
    types = dict(df.dtypes)
    entries = [
        f"""CASE WHEN NOT ({old}{c} <=> {new}{c}) THEN named_struct('name', '{c}',
          'old', {_json_value(old + c, types[old + c])}, 'new', {_json_value(new + c, types[new + c])}) END"""
        for c in sorted(cols)
    ]
    return F.expr(f"array_compact(array({', '.join(entries)}))")


def fields_json(changes: Column, side: str) -> Column:
    """The old or new values of ``changed_fields`` as a JSON object."""
    members = F.transform(changes, lambda e: F.concat(F.lit('"'), e["name"], F.lit('":'), e[side]))
    return F.concat(F.lit("{"), F.array_join(members, ","), F.lit("}"))


def was_absent(status) -> Column:
    return F.coalesce(F.upper(_col(status)).isin("MISSING", "REMOVED"), F.lit(False))


def reset_on_seen(df: DataFrame, now: Column, seen: Column | None = None) -> DataFrame:
    """A sighting makes a row active, renews its last-seen time and clears its absence marks."""
    seen = F.lit(True) if seen is None else seen
    types = dict(df.dtypes)
    clear = lambda c: F.when(~seen, F.col(c)).otherwise(F.lit(None).cast(types[c]))
    return df.withColumns(
        {
            "reactivated": seen & was_absent("status"),
            "last_seen_at": F.when(seen, now).otherwise(F.col("last_seen_at")),
            "missing_since": clear("missing_since"),
            "removed_at": clear("removed_at"),
            "status": F.when(seen, "ACTIVE").otherwise(F.col("status")),
        }
    )


def upsert_outcome(
    is_new: Column, reactivated: Column, hash_differs: Column, price_differs: Column, has_offers: Column,
    has_detail: Column, fields_differ: Column, offers_differ: Column,
) -> Column:
    """created, reactivated, updated or unchanged, in that order of precedence."""
    updated = hash_differs | (price_differs & ~has_offers) | (has_detail & fields_differ) | offers_differ
    return F.when(is_new, "created").when(reactivated, "reactivated").when(updated, "updated").otherwise("unchanged")


def _differs(a, b) -> Column:
    return ~_col(a).eqNullSafe(_col(b))


def sync_offers(offers: DataFrame, incoming: DataFrame, keys: list[str], now: Column) -> DataFrame:
    """Stored offers after a run's, with the outcome of each and its former status, price and hash.

    ``incoming`` has one row per listing and purpose (see ``last_per_purpose``) with price,
    currency, raw_label and scope_hash. Purposes a listing does not name stay as they are.
    """
    by = [*keys, "purpose"]
    sent = incoming.select(
        *by,
        F.lit(True).alias("_sent"),
        F.col("price").cast("decimal(12,2)").alias("n_price"),
        F.coalesce(F.nullif("currency", F.lit("")), F.lit(DEFAULT_CURRENCY)).alias("n_currency"),
        F.col("raw_label").alias("n_raw_label"),
        F.col("scope_hash").alias("n_scope_hash"),
    )
    joined = offers.withColumn("_kept", F.lit(True)).join(sent, by, "full")
    sent_, kept = F.coalesce("_sent", F.lit(False)), F.coalesce("_kept", F.lit(False))
    new_hash = offer_hash("purpose", "n_price", "n_currency")
    reactivated = sent_ & kept & was_absent("status")
    price_differs = sent_ & kept & _differs("price", "n_price")
    hash_differs = sent_ & kept & F.col("content_hash").isNotNull() & (F.col("content_hash") != new_hash)
    pick = lambda new, old: F.when(sent_, new).otherwise(F.col(old)).alias(old)
    none = lambda c: F.lit(None).cast(dict(offers.dtypes)[c])
    return joined.select(
        *by,
        pick(F.col("n_price"), "price"),
        pick(F.col("n_currency"), "currency"),
        pick(F.lit("ACTIVE"), "status"),
        pick(new_hash, "content_hash"),
        F.coalesce("first_seen_at", now).alias("first_seen_at"),
        pick(now, "last_seen_at"),
        pick(none("missing_since"), "missing_since"),
        pick(none("removed_at"), "removed_at"),
        pick(F.col("n_raw_label"), "raw_label"),
        pick(F.col("n_scope_hash"), "scope_hash"),
        pick(F.lit(0), "missing_count"),
        F.when(sent_ & ~kept, "created")
        .when(reactivated | price_differs | hash_differs, "updated")
        .when(sent_, "unchanged")
        .alias("outcome"),
        reactivated.alias("reactivated"),
        F.col("status").alias("old_status"),
        F.col("price").alias("old_price"),
        F.col("content_hash").alias("old_hash"),
        F.when(price_differs, "PRICE_CHANGED").when(hash_differs, "CONTENT_CHANGED").alias("change"),
    )


def sync_photos(photos: DataFrame, incoming: DataFrame, keys: list[str], now: Column) -> DataFrame:
    """Stored photos after a run's galleries, with the outcome of each.

    ``incoming`` has one row per (listing, url) with its position. A listing that sends none
    keeps all; one that sends some loses those it no longer names.
    """
    senders = incoming.select(*keys).distinct().withColumn("_sender", F.lit(True))
    sent = incoming.select(*keys, "url", F.col("position").alias("n_position"))
    stored = photos.withColumn("_kept", F.lit(True)).join(senders, keys, "left")
    joined = stored.join(sent, [*keys, "url"], "full")
    sent_, kept = F.col("n_position").isNotNull(), F.coalesce("_kept", F.lit(False))
    moved = _differs("position", "n_position") | F.coalesce(~F.col("is_active"), F.lit(False)) | F.col("removed_at").isNotNull()
    gone = kept & ~sent_ & F.coalesce("_sender", F.lit(False))
    news = F.coalesce("is_active", F.lit(False)) | F.col("removed_at").isNull()
    none = F.lit(None).cast(dict(photos.dtypes)["removed_at"])
    return joined.select(
        *keys,
        "url",
        F.coalesce("n_position", "position").alias("position"),
        F.when(sent_, True).when(gone, False).otherwise(F.col("is_active")).alias("is_active"),
        F.when(sent_, none).when(gone, F.coalesce("removed_at", now)).otherwise(F.col("removed_at")).alias("removed_at"),
        F.when(sent_ & ~kept, "created").when(sent_ & moved, "updated").when(sent_, "unchanged")
        .when(gone & news, "inactivated").alias("outcome"),
    )


def gallery_source(detail_urls, card_urls, has_detail: Column, is_new: Column, has_photos: Column) -> Column:
    """The detail page's pictures; else the card's, for a new listing or one without any yet."""
    empty = F.array().cast("array<string>")
    from_detail = dedupe_urls(F.coalesce(_col(detail_urls), empty))
    from_card = dedupe_urls(F.coalesce(_col(card_urls), empty))
    use_card = is_new | (~has_detail & ~has_photos)
    return F.when(F.size(F.coalesce(_col(detail_urls), empty)) > 0, from_detail).when(use_card, from_card).otherwise(empty)


def absence_step(df: DataFrame, absent: Column, policy: AbsencePolicy, now: Column) -> DataFrame:
    """One run's absence for the rows under ``absent``.

    Adds ``absence``: missing, removed or NULL where the status stays; the counter goes up for
    every absent row. ``old_status`` keeps the status before.
    """
    state = F.upper(F.coalesce("status", F.lit("ACTIVE")))
    count = F.coalesce("missing_count", F.lit(0)) + 1
    overdue = F.coalesce(now >= F.col("missing_since") + F.expr(f"INTERVAL {policy.removal_hours} HOURS"), F.lit(False))
    often = (F.col("status") == "MISSING") & (count >= policy.threshold)
    step = F.when(~absent, None).when(state == "ACTIVE", "missing").when((state == "MISSING") & (overdue | often), "removed")
    return (
        df.withColumn("absence", step)
        .withColumn("old_status", F.col("status"))
        .withColumn("missing_count", F.when(absent, count).otherwise(F.col("missing_count")))
        .withColumn("missing_since", F.when(F.col("absence") == "missing", F.coalesce("missing_since", now)).otherwise(F.col("missing_since")))
        .withColumn("removed_at", F.when(F.col("absence") == "removed", now).otherwise(F.col("removed_at")))
        .withColumn("status", F.coalesce(F.upper("absence"), "status"))
    )


def _same_scope(scope_hash: str | None) -> Column:
    return F.lit(True) if scope_hash is None else F.coalesce(F.col("scope_hash") == scope_hash, F.lit(False))


def reconcile_absent(
    state: DataFrame, seen: DataFrame, keys: list[str], policy: AbsencePolicy, scope_hash: str | None, now: Column
) -> DataFrame:
    """Listings after a trusted full run that did not sight some of them."""
    marked = state.join(seen.select(*keys).distinct().withColumn("_seen", F.lit(True)), keys, "left")
    absent = F.col("_seen").isNull() & F.coalesce(F.col("status") != "REMOVED", F.lit(False)) & _same_scope(scope_hash)
    return absence_step(marked, absent, policy, now).drop("_seen")


def reconcile_absent_offers(
    offers: DataFrame, seen: DataFrame, keys: list[str], purposes: list[str], policy: AbsencePolicy,
    scope_hash: str | None, now: Column,
) -> DataFrame:
    """Offers after such a run, for its purposes only; the listings then follow by ``rollup_status``."""
    by = [*keys, "purpose"]
    marked = offers.join(seen.select(*by).distinct().withColumn("_seen", F.lit(True)), by, "left")
    absent = F.col("_seen").isNull() & F.col("purpose").isin(purposes) & _same_scope(scope_hash)
    return absence_step(marked, absent, policy, now).drop("_seen")


def classify_run(metrics: DataFrame, ratio: float = 0.5) -> DataFrame:
    """Adds ``run_status``; a run cut short or suspiciously small is partial and says why.

    Needs mode, completed, http_errors, parse_errors, stopped_reason, reported_total,
    listings_seen and previous_count, which counts as no history when it is 0.
    """
    full = F.col("mode") == "full"
    cut = lambda *names: F.coalesce(F.col("stopped_reason").isin(*names), F.lit(False))
    below = lambda c: F.coalesce((F.col(c) > 0) & (F.col("listings_seen") < F.col(c) * F.lit(ratio)), F.lit(False))
    verdict = (
        F.when(~F.col("completed") | (F.col("http_errors") > 0) | (F.col("parse_errors") > 0), "errors")
        .when(cut("max_pages") | (full & cut("limit", "invalid_card_rate")), "cut")
        .when(full & below("reported_total"), "suspicious_reported_total_gap")
        .when(full & below("previous_count"), "suspicious_low_count")
    )
    # The reasons a run is given when its count is not believed.
    doubt = F.col("_verdict").startswith("suspicious")
    return (
        metrics.withColumn("_verdict", verdict)
        .withColumn("run_status", F.when(F.col("_verdict").isNull(), "success").otherwise("partial"))
        .withColumn("completed", F.col("completed") & (F.col("_verdict").isNull() | (F.col("_verdict") == "errors")))
        .withColumn("stopped_reason", F.when(doubt, F.col("_verdict")).otherwise(F.col("stopped_reason")))
        .drop("_verdict")
    )


def needs_detail(mode: str, ttl_hours: int, now: Column) -> Column:
    """Whether a matched card's detail page is to be read again."""
    fetched = F.col("old_detail_last_fetched_at")
    stale = (
        F.col("is_new") | fetched.isNull() | _differs("old_content_hash", "content_hash")
        | (now >= fetched + F.expr(f"INTERVAL {ttl_hours} HOURS"))
    )
    return F.lit(True) if mode == "full" else stale


def refresh_plan(
    matched: DataFrame, ttl_hours: int, mode: str, now: Column, order: list[str], max_details: int | None = None
) -> DataFrame:
    """The cards whose detail page is due, at most ``max_details`` of them in discovery order."""
    due = matched.filter(needs_detail(mode, ttl_hours, now))
    return due if max_details is None else due.orderBy(*order).limit(max_details)


def seen_keys(sightings: DataFrame, details: DataFrame, keys: list[str]) -> DataFrame:
    """The (listing, purpose) pairs a run sighted; a detail page's offers replace the card's."""
    own = details.select(*keys, F.col("offers").alias("_offers"))
    offers = F.when(F.size(F.coalesce("_offers", F.array())) > 0, F.col("_offers.purpose")).otherwise(F.col("offers.purpose"))
    return (
        sightings.join(own, keys, "left")
        .select(*keys, F.explode(offers).alias("purpose"))
        .withColumn("purpose", normalize_purpose("purpose"))
        .filter(F.col("purpose").isin("SALE", "RENT"))
        .distinct()
    )


def normalise_status_backfill(df: DataFrame) -> DataFrame:
    """Legacy rows: the three statuses in upper case, anything else active, NULL left; url copied."""
    lower = F.lower("status")
    status = F.when(lower.isin("active", "missing", "removed"), F.upper(lower)).when(lower.isNotNull(), "ACTIVE")
    return df.withColumn("status", status).withColumn("source_url", F.coalesce("source_url", "url"))
