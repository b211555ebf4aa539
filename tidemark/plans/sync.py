"""A whole run: cards and detail pages in, the new inventory, events and figures out."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import datetime
from functools import reduce
from hashlib import sha256
from operator import or_

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import card_hash
from ..functions.text import normalize_purpose
from ..operators import snapshot as snap
from ..operators.dedup import concat_results, keep_first, offers_by_purpose
from ..operators.lifecycle import AbsencePolicy
from ..operators.metrics import COUNTERS, card_ratios, child_status, run_metrics, throughput
from ..operators.ordered import last_full_count
from ..operators.search import allowed_purposes, offers_in_scope, samples
from ..session import at_once
from ..sources.state import BUCKETS, Store, delete_folder

KEY = ["external_id"]
EVENTS = "array<struct<seq:int,event_type:string,old_value:string,new_value:string>>"
OFFER = "struct<purpose:string,price:decimal(12,2),currency:string,raw_label:string>"

# The columns of the stored tables and of what a run brings.
_CARD = {
    "title": "string", "transaction_type": "string", "property_type": "string", "property_subtype": "string",
    "city": "string", "state": "string", "neighborhood": "string", "address_line": "string",
    "price": "decimal(12,2)", "bedrooms": "int", "suites": "int", "bathrooms": "int", "parking_spaces": "int",
    "area_m2": "decimal(8,2)", "main_image_url": "string",
}
_DETAIL_ONLY = {
    "description": "string", "condominium_fee": "decimal(12,2)", "property_tax": "decimal(12,2)",
    "price_per_m2": "decimal(12,2)", "latitude": "decimal(9,6)", "longitude": "decimal(9,6)", "detail_hash": "string",
}
SIGHTING_COLUMNS = {
    "page": "int", "position": "bigint", "external_id": "string", "source_url": "string", **_CARD,
    "currency": "string", "tags": "array<string>", "image_urls": "array<string>", "offers": f"array<{OFFER}>",
    "metadata": "map<string,string>",
}
DETAIL_COLUMNS = {
    "external_id": "string",
    **{c: t for c, t in {**_CARD, **_DETAIL_ONLY}.items() if c != "transaction_type"},
    "tags": "array<string>", "image_urls": "array<string>", "offers": f"array<{OFFER}>", "metadata": "map<string,string>",
}
LISTING_COLUMNS = {
    "external_id": "string", "source_key": "string", "source_url": "string", **_CARD, **_DETAIL_ONLY,
    "price_currency": "string", "tags": "array<string>", "metadata": "map<string,string>", "status": "string",
    "content_hash": "string", "scope_hash": "string", "missing_count": "int", "first_seen_at": "timestamp_ntz",
    "last_seen_at": "timestamp_ntz", "missing_since": "timestamp_ntz", "removed_at": "timestamp_ntz",
    "detail_last_fetched_at": "timestamp_ntz",
}
OFFER_COLUMNS = {
    "external_id": "string", "purpose": "string", "price": "decimal(12,2)", "currency": "string", "status": "string",
    "content_hash": "string", "first_seen_at": "timestamp_ntz", "last_seen_at": "timestamp_ntz",
    "missing_since": "timestamp_ntz", "removed_at": "timestamp_ntz", "raw_label": "string", "scope_hash": "string",
    "missing_count": "int",
}
PHOTO_COLUMNS = {
    "external_id": "string", "url": "string", "position": "int", "is_active": "boolean", "removed_at": "timestamp_ntz",
}


@dataclass(frozen=True)
class Run:
    """What is known of a run before its rows are looked at."""

    run_id: str
    source_key: str
    now: datetime
    mode: str = "delta"
    scope: dict = field(default_factory=dict)
    uses_offers: bool = False
    completed: bool = True
    stopped_reason: str | None = None
    http_errors: int = 0
    parse_errors: int = 0
    reported_total: int | None = None
    previous_count: int | None = None
    policy: AbsencePolicy = AbsencePolicy()
    detail_ttl_hours: int = 24
    min_listing_ratio: float = 0.5
    max_details: int | None = None
    started_at: datetime | None = None
    pages_fetched: int = 0
    detail_pages_fetched: int = 0
    requests_total: int = 0
    invalid_cards: int = 0

    @property
    def scope_hash(self) -> str:
        text = json.dumps(self.scope, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        return sha256(text.encode()).hexdigest()

    @property
    def purposes(self) -> list[str]:
        named = self.scope.get("purposes") or self.scope.get("purpose") or "sale"
        return allowed_purposes([named] if isinstance(named, str) else named)

    @property
    def offer_filter(self) -> list[str]:
        named = self.scope.get("sync_offer_purposes")
        return [named] if isinstance(named, str) else named if isinstance(named, list) else []


@dataclass
class Tables:
    """The stored tables of one source."""

    listings: DataFrame
    offers: DataFrame
    photos: DataFrame


@dataclass
class SyncResult:
    """The tables after a run, each row with what happened to it; all frames are lazy."""

    tables: Tables
    cards: DataFrame
    run: Run

    def events(self) -> DataFrame:
        return events_of(self.tables, self.run)

    def outcomes(self) -> DataFrame:
        return outcomes_of(self.tables)

    def metrics(self) -> DataFrame:
        return run_row(self.outcomes(), self.cards, self.run)


def conform(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The named columns in their types, NULL where the frame lacks one."""
    have = set(df.columns)
    return df.selectExpr(*[f"CAST({c if c in have else 'NULL'} AS {t}) AS {c}" for c, t in columns.items()])


def empty_tables(spark: SparkSession) -> Tables:
    make = lambda cols: spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t in cols.items()))
    return Tables(make(LISTING_COLUMNS), make(OFFER_COLUMNS), make(PHOTO_COLUMNS))


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]), {"ignoreNullFields": "false"})


def _event(kind, old: Column | None, new: Column | None, seq) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    none = F.lit(None).cast("string")
    return F.struct(
        (F.lit(seq) if isinstance(seq, int) else seq).alias("seq"), kind.alias("event_type"),
        (none if old is None else old).alias("old_value"), (none if new is None else new).alias("new_value"),
    )


def event_log(changes: DataFrame, run: Run) -> DataFrame:
    """One row per event of each changed row; several can come of one change."""
    return changes.select("external_id", F.explode("events").alias("e")).select(
        "external_id", F.lit(run.source_key).alias("source_key"), "e.*",
        F.lit(run.run_id).alias("run_id"), F.lit(run.now.isoformat(sep=" ")).cast("timestamp_ntz").alias("detected_at"),
    )


def events_of(tables: Tables, run: Run) -> DataFrame:
    """A run's events, read off the tables it left."""
    return concat_results(event_log(tables.listings, run), event_log(tables.offers, run))


def _offer_events() -> Column:
    """Events of an offer that came back, changed or went missing; a listing's RENT before its SALE."""
    of = lambda **f: _json(entity=F.lit("offer"), purpose=F.col("purpose"), **f)
    text = lambda c: F.col(c).cast("string")
    moved = F.col("change") == "PRICE_CHANGED"
    old = F.when(moved, of(price=text("old_price"))).otherwise(of(content_hash=F.col("old_hash")))
    new = F.when(moved, of(price=text("price"))).otherwise(of(content_hash=F.col("content_hash")))
    kind = F.when(F.col("absence") == "missing", "MARKED_MISSING").otherwise("REMOVED")
    rank = F.when(F.col("purpose") == "SALE", 10).otherwise(0)
    status = lambda c: of(status=F.col(c))
    return F.array_compact(F.array(
        F.when(F.col("reactivated"), _event("REACTIVATED", status("old_status"), of(status=F.lit("ACTIVE")), rank)),
        F.when(F.col("change").isNotNull(), _event(F.col("change"), old, new, rank + 1)),
        F.when(F.col("absence").isNotNull(), _event(kind, status("seen_status"), status("status"), rank + 200)),
    ))


def _matched(tables: Tables, cards: DataFrame, details: DataFrame, run: Run, now: Column) -> DataFrame:
    """Stored rows and cards side by side, each card with its detail page if that is to be read."""
    stored = tables.listings.selectExpr("external_id", *[f"{c} AS old_{c}" for c in LISTING_COLUMNS if c != "external_id"])
    both = (
        stored.withColumn("_stored", F.lit(True))
        .join(cards.withColumn("_carded", F.lit(True)), KEY, "full")
        .withColumn("is_new", F.col("_stored").isNull())
        .withColumn("sighted", F.coalesce("_carded", F.lit(False)))
    )
    extra = details.selectExpr("external_id", "true AS _detail", *[f"{c} AS d_{c}" for c in DETAIL_COLUMNS if c != "external_id"])
    if run.max_details is not None:
        due = snap.refresh_plan(both.filter("sighted"), run.detail_ttl_hours, run.mode, now, ["page", "position"], run.max_details)
        extra = extra.join(due.select(*KEY), KEY, "left_semi")
    joined = both.join(extra, KEY, "left")
    read = F.coalesce("_detail", F.lit(False)) & F.col("sighted") & snap.needs_detail(run.mode, run.detail_ttl_hours, now)
    return joined.withColumn("has_detail", F.coalesce(read, F.lit(False))).drop("_stored", "_carded", "_detail")


def _listing_values(m: DataFrame, run: Run, now: Column) -> DataFrame:
    """New values of every listing column a sighting or its detail page can change."""
    det = lambda c: F.when(F.col("has_detail"), F.col("d_" + c))
    base = {c: F.coalesce(c, "old_" + c) for c in snap.CARD_COLUMNS}
    base |= {c: F.col("old_" + c) for c in _DETAIL_ONLY if c != "detail_hash"}
    values = dict(base)
    for c in snap.DETAIL_TEXT:
        values[c] = F.coalesce(F.nullif(det(c), F.lit("")), base[c])
    for c in snap.DETAIL_NUMBERS:
        values[c] = F.coalesce(det(c), base[c])
    values["main_image_url"] = F.coalesce(
        F.nullif(det("main_image_url"), F.lit("")), F.get(det("image_urls"), F.lit(0)), base["main_image_url"]
    )
    empty = F.array().cast("array<string>")
    own_tags = F.coalesce("tags", empty)
    values["tags"] = F.when(
        F.col("has_detail"), snap.dedupe_array(F.concat(own_tags, F.coalesce("d_tags", empty)))
    ).otherwise(own_tags)
    values["detail_hash"] = F.when(F.col("has_detail"), F.col("d_detail_hash")).otherwise(F.col("old_detail_hash"))
    values["price_currency"] = F.coalesce(F.nullif("currency", F.lit("")), "old_price_currency", F.lit(snap.DEFAULT_CURRENCY))
    values["metadata"] = snap.merge_metadata(snap.merge_metadata("old_metadata", "metadata"), det("metadata"))
    values["detail_last_fetched_at"] = F.when(F.col("has_detail"), now).otherwise(F.col("old_detail_last_fetched_at"))
    values["source_key"] = F.lit(run.source_key)
    values["scope_hash"] = F.lit(run.scope_hash)
    values["missing_count"] = F.lit(0)
    values["first_seen_at"] = F.coalesce("old_first_seen_at", now)
    values["last_seen_at"] = now
    kept = {c: F.when(F.col("sighted"), v).otherwise(F.col("old_" + c)) for c, v in values.items()}
    kept["source_url"] = F.when(F.col("sighted"), F.col("source_url")).otherwise(F.col("old_source_url"))
    kept["content_hash"] = F.when(F.col("sighted"), F.col("content_hash")).otherwise(F.col("old_content_hash"))
    kept["status"] = F.when(F.col("sighted"), "ACTIVE").otherwise(F.col("old_status"))
    none = F.lit(None).cast("timestamp_ntz")
    for c in ("missing_since", "removed_at"):
        kept[c] = F.when(F.col("sighted"), none).otherwise(F.col("old_" + c))
    kept["missing_count"] = F.when(F.col("sighted"), F.lit(0)).otherwise(F.col("old_missing_count"))
    return m.withColumns(kept)


def prepare_cards(sightings: DataFrame, run: Run) -> DataFrame:
    """The run's distinct cards in discovery order, how often each came, their offers limited to the scope."""
    cards = conform(sightings, SIGHTING_COLUMNS).filter("external_id IS NOT NULL")
    # Maps cannot be compared, so the metadata travels through the aggregate as sorted entries.
    sortable = cards.withColumn("metadata", F.array_sort(F.map_entries("metadata")))
    first = keep_first(sortable, KEY, ["page", "position"], "times").withColumn("metadata", F.map_from_entries("metadata"))
    return offers_in_scope(first, run.offer_filter)


def _may_prove_absence(run: Run) -> bool:
    return (
        run.mode == "full" and run.completed and not run.http_errors and not run.parse_errors
        and run.stopped_reason not in ("max_pages", "limit", "invalid_card_rate")
    )


def _trusted(cards: DataFrame, run: Run) -> Column:
    """Whether a full run may be taken as proof that what it did not see is gone."""
    if not _may_prove_absence(run):
        return F.lit(False)
    floor = run.min_listing_ratio * max(run.reported_total or 0, run.previous_count or 0)
    return cards.agg(F.count(F.lit(1)).alias("n")).scalar() >= floor


def unique_details(details: DataFrame) -> DataFrame:
    """One detail row per listing: of several the first by its JSON text."""
    row = F.struct(*details.columns)
    return details.groupBy("external_id").agg(F.min_by(row, F.to_json(row)).alias("_d")).select("_d.*")


def hashed_cards(sightings: DataFrame, run: Run) -> DataFrame:
    cards = prepare_cards(sightings, run)
    return cards.withColumn("content_hash", card_hash(cards))


def sync(tables: Tables, sightings: DataFrame, details: DataFrame, run: Run) -> SyncResult:
    """One run over one source's tables; no action is run here."""
    return sync_cards(tables, hashed_cards(sightings, run), details, run)


def sync_cards(
    tables: Tables, cards: DataFrame, details: DataFrame, run: Run, keep: Callable[[str, DataFrame], DataFrame] = lambda name, df: df
) -> SyncResult:
    """The run over cards as ``hashed_cards`` gives them.

    The frames meet on the listing's id (cards, stored rows, detail pages), on (id, purpose) for
    offers and on (id, url) for photos; nothing is keyed by the source, so a source that owns
    most of the inventory spreads over all tasks. ``keep(name, frame)`` may write the frames that
    several results share (rows matched with cards, offers) and give back what it wrote.
    """
    now = F.lit(run.now.isoformat(sep=" ")).cast("timestamp_ntz")
    details = offers_in_scope(unique_details(conform(details, DETAIL_COLUMNS)), run.offer_filter)
    matched = _matched(tables, cards, details, run, now)
    trusted = _trusted(cards, run)

    # Offers: a detail page's replace the card's.
    no_offers = F.array().cast(f"array<{OFFER}>")
    sent = F.when(F.col("has_detail") & (F.size(F.coalesce("d_offers", no_offers)) > 0), F.col("d_offers")).otherwise(
        F.coalesce("offers", no_offers)
    )
    matched = keep("matched", matched.withColumn("sent_offers", F.when(F.col("sighted"), sent).otherwise(no_offers)))
    named = matched.filter(F.size("sent_offers") > 0).select(*KEY, F.explode(offers_by_purpose(F.col("sent_offers"))).alias("o"))
    incoming = named.select(*KEY, "o.*", F.lit(run.scope_hash).alias("scope_hash"))
    synced = snap.sync_offers(tables.offers, incoming, KEY, now).withColumnRenamed("old_status", "status_before")
    gone = F.lit(False)
    if run.uses_offers and run.purposes:
        gone = trusted & F.col("outcome").isNull() & F.col("purpose").isin(run.purposes) & (
            F.coalesce(F.col("scope_hash") == run.scope_hash, F.lit(False))
        )
    synced = (
        snap.absence_step(synced, gone, run.policy, now)
        .withColumnRenamed("old_status", "seen_status")
        .withColumnRenamed("status_before", "old_status")
    )
    traces = {"outcome": "string", "absence": "string", "events": EVENTS}
    synced = keep("offers", conform(synced.withColumn("events", _offer_events()), {**OFFER_COLUMNS, **traces, "reactivated": "boolean"}))
    per_listing = synced.groupBy(*KEY).agg(
        F.bool_or(F.coalesce(F.col("outcome").isin("created", "updated"), F.lit(False))).alias("offers_differ"),
        F.bool_or(F.col("outcome").isNotNull() | F.col("absence").isNotNull()).alias("offers_touched"),
    ).join(child_status(synced, KEY), KEY)

    # Photos.
    with_photos = tables.photos.select(*KEY).distinct().withColumn("_has_photos", F.lit(True))
    cards_urls = F.concat(F.array("main_image_url"), F.coalesce("image_urls", F.array().cast("array<string>")))
    urls = snap.gallery_source(
        F.when(F.col("has_detail"), F.col("d_image_urls")), cards_urls, F.col("has_detail"), F.col("is_new"),
        F.coalesce("_has_photos", F.lit(False)),
    )
    galleries = (
        matched.filter("sighted")
        .join(with_photos, KEY, "left")
        .select(*KEY, F.posexplode(urls).alias("_p", "url"))
        .select(*KEY, "url", (F.col("_p") + 1).alias("position"))
    )
    photos = snap.sync_photos(tables.photos, galleries, KEY, now)

    # Listings.
    valued = _listing_values(matched, run, now).join(per_listing, KEY, "left")
    child = F.when(F.coalesce("offers_touched", F.lit(False)), F.col("child_status"))
    valued = valued.withColumn("seen_status", F.col("status"))
    rolled = valued.withColumns({
        "status": F.coalesce(child, "status"),
        "missing_since": F.when(child == "ACTIVE", None).when(child == "MISSING", F.coalesce("missing_since", now)).otherwise(F.col("missing_since")),
        "removed_at": F.when(child == "ACTIVE", None).when(child == "REMOVED", F.coalesce("removed_at", now)).otherwise(F.col("removed_at")),
    })
    if run.uses_offers:
        step = F.when(F.upper(F.coalesce("seen_status", F.lit("ACTIVE"))) != F.col("status"), F.lower("status"))
        listings = rolled.withColumn("absence", F.when(step.isin("missing", "removed"), step)).withColumn("before", F.col("seen_status"))
    else:
        absent = (
            trusted & ~F.col("sighted") & F.coalesce(F.col("status") != "REMOVED", F.lit(False))
            & F.coalesce(F.col("scope_hash") == run.scope_hash, F.lit(False))
        )
        prior = rolled.withColumnRenamed("old_status", "stored_status")
        listings = (
            snap.absence_step(prior, absent, run.policy, now)
            .withColumnRenamed("old_status", "before")
            .withColumnRenamed("stored_status", "old_status")
        )
    reactivated = F.col("sighted") & ~F.col("is_new") & snap.was_absent("old_status")
    has_offers = F.size("sent_offers") > 0
    price_differs = ~F.col("old_price").eqNullSafe(F.col("price"))
    hash_differs = ~F.col("old_content_hash").eqNullSafe(F.col("content_hash"))
    sorted_tags = lambda c: F.array_sort(F.coalesce(c, F.array().cast("array<string>")))
    listings = listings.withColumns({"kept_tags": F.col("tags"), "tags": sorted_tags("tags"), "old_tags": sorted_tags("old_tags")})
    listings = listings.withColumn("changes", snap.changed_fields(listings, snap.TRACKED_FIELDS)).withColumn("tags", F.col("kept_tags"))
    outcome = snap.upsert_outcome(
        F.col("is_new"), reactivated, hash_differs, price_differs, has_offers, F.col("has_detail"),
        F.size("changes") > 0, F.coalesce("offers_differ", F.lit(False)),
    )
    listings = listings.withColumns({"outcome": F.when(F.col("sighted"), outcome), "reactivated": reactivated})

    listings = listings.withColumn(
        "events", _listing_events(run, price_differs & ~has_offers, hash_differs)
    )
    after = Tables(
        conform(listings, {**LISTING_COLUMNS, **traces}),
        synced,
        conform(photos, {**PHOTO_COLUMNS, "outcome": "string"}),
    )
    return SyncResult(after, cards, run)


def _listing_events(run: Run, price_moved: Column, hash_differs: Column) -> Column:
    """Events of a listing, in the order in which they are logged."""
    text = lambda c: F.col(c).cast("string")
    seen_before = F.col("sighted") & ~F.col("is_new")
    payload = F.transform(
        offers_by_purpose(F.col("sent_offers")),
        lambda o: F.struct(
            o["purpose"].alias("purpose"), o["price"].cast("string").alias("price"),
            F.coalesce(F.nullif(o["currency"], F.lit("")), F.lit(snap.DEFAULT_CURRENCY)).alias("currency"),
        ),
    )
    created = F.when(
        F.col("sighted") & F.col("is_new"),
        _event("CREATED", None, _json(external_id=F.col("external_id"), price=text("price"), offers=payload), 100),
    )
    back = F.when(
        F.col("reactivated"),
        _event("REACTIVATED", _json(status=F.col("old_status")), _json(status=F.lit("ACTIVE")), 101),
    )
    price = F.when(
        seen_before & price_moved, _event("PRICE_CHANGED", _json(price=text("old_price")), _json(price=text("price")), 102)
    )
    had_hash = F.col("old_content_hash").isNotNull()
    some = F.size("changes") > 0
    side = lambda name: snap.fields_json(F.col("changes"), name)
    with_hash = lambda h, name: F.concat(
        F.lit('{"content_hash":"'), F.col(h), F.lit('","fields":'), side(name), F.lit("}")
    )
    bare = lambda name: F.concat(F.lit('{"fields":'), side(name), F.lit("}"))
    by_hash = had_hash & hash_differs
    content = F.when(
        seen_before & some & (by_hash | F.col("has_detail")),
        _event(
            "CONTENT_CHANGED",
            F.when(by_hash, with_hash("old_content_hash", "old")).otherwise(bare("old")),
            F.when(by_hash, with_hash("content_hash", "new")).otherwise(bare("new")),
            103,
        ),
    )
    events = [created, back, price, content]
    if not run.uses_offers:
        kind = F.when(F.col("absence") == "missing", "MARKED_MISSING").otherwise("REMOVED")
        events.append(
            F.when(F.col("absence").isNotNull(), _event(kind, _json(status=F.col("before")), _json(status=F.col("status")), 300))
        )
    return F.array_compact(F.array(*events))


def outcomes_of(tables: Tables) -> DataFrame:
    """One row per counted fact: (external_id, entity, outcome)."""
    row = lambda df, entity, c: df.filter(F.col(c).isNotNull()).select(*KEY, F.lit(entity).alias("entity"), F.col(c).alias("outcome"))
    back = tables.offers.filter("reactivated").withColumn("outcome", F.lit("reactivated"))
    return concat_results(
        row(tables.listings, "listing", "outcome"), row(tables.listings, "listing", "absence"),
        row(tables.offers, "offer", "outcome"), row(back, "offer", "outcome"), row(tables.offers, "offer", "absence"),
        row(tables.photos, "photo", "outcome"),
    )


def _offers_sighted(cards: DataFrame) -> DataFrame:
    """One row: distinct cards and the SALE and RENT offers on them."""
    of = lambda purpose: F.coalesce(F.sum(F.size(F.filter("offers", lambda o: normalize_purpose(o["purpose"]) == purpose))), F.lit(0))
    return cards.withColumn("offers", F.coalesce("offers", F.array().cast(f"array<{OFFER}>"))).agg(
        F.count("*").alias("listings_seen"), of("SALE").alias("sale_offers_seen"), of("RENT").alias("rent_offers_seen")
    )


def run_row(outcomes: DataFrame, cards: DataFrame, run: Run) -> DataFrame:
    """The run's log row: counters, offers sighted, verdict. A run without rows still has one."""
    offers = _offers_sighted(cards).select(F.struct("sale_offers_seen", "rent_offers_seen")).scalar()
    known = run_metrics(outcomes, []).withColumn("_offers", offers).withColumns({
        "run_id": F.lit(run.run_id),
        "source_key": F.lit(run.source_key),
        "mode": F.lit(run.mode),
        "sale_offers_seen": F.col("_offers.sale_offers_seen"),
        "rent_offers_seen": F.col("_offers.rent_offers_seen"),
        "completed": F.lit(run.completed),
        "stopped_reason": F.lit(run.stopped_reason).cast("string"),
        "http_errors": F.lit(run.http_errors),
        "parse_errors": F.lit(run.parse_errors),
        "reported_total": F.lit(run.reported_total).cast("int"),
        "previous_count": F.lit(run.previous_count).cast("bigint"),
        "scope_json": F.lit(json.dumps(run.scope, sort_keys=True, ensure_ascii=False)),
        "finished_at": F.lit(run.now.isoformat(sep=" ")).cast("timestamp_ntz"),
    })
    return snap.classify_run(known.drop("_offers"), run.min_listing_ratio).withColumn("status", F.col("run_status"))


def figures_of(observed: dict[str, dict[str, int]], run: Run) -> dict:
    """The counters of a run from what its three tables and its cards showed while they were written."""
    of = lambda entity, outcome: observed[entity].get(outcome, 0) or 0
    counts = {name: of(*pair) for name, pair in COUNTERS.items()}
    seen = sum(of("listing", o) for o in ("created", "updated", "unchanged", "reactivated"))
    return {"listings_seen": seen, "unique_external_ids": seen, **counts, **observed["card"]}


def observed_rows(df: DataFrame, entity: str) -> tuple[DataFrame, Observation]:
    """The frame, counting its outcomes by the way."""
    seen = Observation()
    columns = [c for c in ("outcome", "absence") if c in df.columns]
    shows = lambda outcome: reduce(or_, [F.coalesce(F.col(c) == outcome, F.lit(False)) for c in columns])
    named = [outcome for kind, outcome in COUNTERS.values() if kind == entity and not (outcome == "reactivated" and "reactivated" in df.columns)]
    counts = [F.count_if(shows(outcome)).alias(outcome) for outcome in named]
    if "reactivated" in df.columns:
        counts.append(F.count_if(F.coalesce("reactivated", F.lit(False))).alias("reactivated"))
    return df.observe(seen, *counts), seen


def observed_cards(cards: DataFrame) -> tuple[DataFrame, Observation]:
    """A run's distinct cards, counting the SALE and RENT offers on them."""
    seen, none = Observation(), F.array().cast(f"array<{OFFER}>")
    of = lambda purpose: F.coalesce(
        F.sum(F.size(F.filter(F.coalesce("offers", none), lambda o: normalize_purpose(o["purpose"]) == purpose))), F.lit(0))
    counts = of("SALE").alias("sale_offers_seen"), of("RENT").alias("rent_offers_seen"), F.coalesce(F.sum("times"), F.lit(0)).alias("cards_seen")
    return cards.observe(seen, *counts), seen


def log_row(spark: SparkSession, figures: dict, run: Run, failure: str | None = None) -> DataFrame:
    """The run's row of the log, also of one that failed."""
    known = {
        **figures, "run_id": run.run_id, "source_key": run.source_key, "mode": run.mode, "completed": run.completed and failure is None,
        "stopped_reason": run.stopped_reason, "http_errors": run.http_errors, "parse_errors": run.parse_errors,
        "reported_total": run.reported_total, "previous_count": run.previous_count, "invalid_cards": run.invalid_cards,
        "scope_json": json.dumps(run.scope, sort_keys=True, ensure_ascii=False), "finished_at": run.now, "started_at": run.started_at,
        "pages_fetched": run.pages_fetched, "detail_pages_fetched": run.detail_pages_fetched, "requests_total": run.requests_total,
        "error": failure,
    }
    given = {c: t for c, t in RUN_COLUMNS.items() if c not in ("run_status", "status", "duration_seconds", "pages_per_second", "invalid_rate", "valid_cards_ratio")}
    row = spark.createDataFrame([tuple(known.get(c) for c in given)], ", ".join(f"{c} {t}" for c, t in given.items()))
    row = card_ratios(throughput(snap.classify_run(row, run.min_listing_ratio)))
    if failure is not None:
        row = row.withColumn("run_status", F.lit("failed"))
    return conform(row.withColumn("status", F.col("run_status")), RUN_COLUMNS)


def with_history(store: Store, run: Run) -> Run:
    """The run with the count of the last successful full run of its scope, from the stored run log."""
    if run.previous_count is not None:
        return run
    columns = ["run_id", "source_key", "mode", "status", "scope_json", "finished_at", "listings_seen"]
    scope = json.dumps(run.scope, sort_keys=True, ensure_ascii=False)
    own = store.spark.range(1).select(
        F.lit(run.run_id), F.lit(run.source_key), F.lit(run.mode), F.lit(None).cast("string"), F.lit(scope),
        F.lit(run.now.isoformat(sep=" ")).cast("timestamp_ntz"), F.lit(None).cast("bigint"),
    )
    log = store.history("runs").filter(F.col("run_id") != run.run_id)
    counted = last_full_count(log.select(*columns).union(own.toDF(*columns))).filter(F.col("run_id") == run.run_id)
    return replace(run, previous_count=counted.select("previous_count").first()[0])


def dry_run(sightings: DataFrame, details: DataFrame, run: Run) -> tuple[DataFrame, DataFrame]:
    """What a run would see, without any table: its offer counts and first cards."""
    cards = prepare_cards(sightings, run)
    cols = ["external_id", "source_url", "title", "price", "property_type", "neighborhood", "address_line", "area_m2",
            "bedrooms", "suites", "parking_spaces", "main_image_url", "offers", "tags"]
    shown = details.select("external_id", F.struct(*[c for c in details.columns if c != "external_id"]).alias("detail"))
    figures = _offers_sighted(cards).withColumn("run_id", F.lit(run.run_id))
    return figures, samples(cards, shown, ["page", "position"], cols)


# The columns of the run log and of the event log.
RUN_COLUMNS = {
    "run_id": "string", "source_key": "string", "mode": "string", "status": "string", "run_status": "string", "completed": "boolean",
    "stopped_reason": "string", "error": "string", "scope_json": "string", "started_at": "timestamp_ntz", "finished_at": "timestamp_ntz",
    **{c: "bigint" for c in ("listings_seen", "unique_external_ids", *COUNTERS, "sale_offers_seen", "rent_offers_seen")},
    "cards_seen": "bigint", "invalid_cards": "bigint", "invalid_rate": "double", "valid_cards_ratio": "double",
    "http_errors": "int", "parse_errors": "int", "reported_total": "int", "previous_count": "bigint",
    "pages_fetched": "bigint", "detail_pages_fetched": "bigint", "requests_total": "bigint",
    "duration_seconds": "double", "pages_per_second": "double",
}
EVENT_COLUMNS = {
    "external_id": "string", "source_key": "string", "seq": "int", "event_type": "string", "old_value": "string", "new_value": "string",
    "run_id": "string", "detected_at": "timestamp_ntz",
}


def open_store(spark: SparkSession, root: str, source_key: str, buckets: int = BUCKETS) -> Store:
    """A source's stored tables; ``buckets`` must be the same for all runs of an inventory."""
    text = lambda columns: ", ".join(f"{c} {t}" for c, t in columns.items())
    tables = {"listings": text(LISTING_COLUMNS), "offers": text(OFFER_COLUMNS), "photos": text(PHOTO_COLUMNS)}
    return Store(spark, root, source_key, tables, {"events": text(EVENT_COLUMNS), "runs": text(RUN_COLUMNS)}, "external_id", buckets)


def load_tables(spark: SparkSession, root: str, source_key: str) -> Tables:
    """A source's tables as the last published run left them."""
    store = open_store(spark, root, source_key)
    return Tables(*[store.read(t) for t in store.tables])


def _touched(store: Store, cards: DataFrame, run: Run) -> list[int]:
    """The buckets that a run's cards lie in, and those of rows that its silence may change."""
    ids = cards.select(*KEY)
    if not _may_prove_absence(run):
        return store.touched(ids)
    mine = (F.col("scope_hash") == run.scope_hash) & (F.coalesce("status", F.lit("ACTIVE")) != "REMOVED")
    if run.uses_offers:
        rows = store.read("offers").filter(mine & F.col("purpose").isin(run.purposes))
        return store.touched(ids, rows.select(*KEY))
    return store.touched(ids, store.read("listings").filter(mine).select(*KEY).join(ids, KEY, "left_anti"))


def apply_run(
    spark: SparkSession, root: str, sightings: DataFrame, details: DataFrame, run: Run, buckets: int = BUCKETS
) -> bool:
    """Run ``sync`` on the stored tables and write what comes of it; False if it was done before.

    Only the buckets that the run touches are read and rewritten. What the results share is written once,
    the run's figures are counted while its tables are, and a run that fails leaves a row in the log that
    says so; it may be tried again under its id.
    """
    store = open_store(spark, root, run.source_key, buckets)
    for died in store.ready():  # while it published
        store.publish(died)
    logged = {r.run_id: r.status for r in store.history("runs").select("run_id", "status").collect()}
    if logged.get(run.run_id, "failed") != "failed":
        return False
    path = store.staging()
    try:
        touched = _stage_run(store, path, sightings, details, with_history(store, run))
        store.note(run.run_id, path, touched, set(logged))
    except Exception as error:
        store.log("runs", log_row(spark, {}, run, f"{type(error).__name__}: {error}"[:500]), run.run_id)
        delete_folder(spark, path)
        raise
    store.publish(run.run_id)
    return True


def _stage_run(store: Store, path: str, sightings: DataFrame, details: DataFrame, run: Run) -> list[int]:
    """Everything that a run will publish, in its staging folder; returns the buckets it touches."""
    seen: dict[str, Observation] = {}

    def keep(name: str, df: DataFrame) -> DataFrame:
        if name == "offers":
            df, seen["offer"] = observed_rows(df, "offer")
        return store.stage(path, name, df)

    cards, seen["card"] = observed_cards(hashed_cards(sightings, run))
    cards = store.stage(path, "cards", cards)
    touched = _touched(store, cards, run)
    tables = Tables(*[store.read(t, touched) for t in store.tables])
    result = sync_cards(tables, cards, details, run, keep)
    listings, seen["listing"] = observed_rows(result.tables.listings, "listing")
    photos, seen["photo"] = observed_rows(result.tables.photos, "photo")
    listings, photos = at_once(lambda: store.stage(path, "listings", listings), lambda: store.stage(path, "photos", photos))
    store.stage(path, "events", conform(events_of(Tables(listings, result.tables.offers, photos), run), EVENT_COLUMNS))
    store.stage(path, "runs", log_row(store.spark, figures_of({entity: o.get for entity, o in seen.items()}, run), run))
    return touched
