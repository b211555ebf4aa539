"""Successive runs over small frames: what each leaves in tables, events and figures."""

from __future__ import annotations

import json
from datetime import datetime, timedelta
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.operators.lifecycle import AbsencePolicy
from tidemark.operators.ordered import price_history
from tidemark.operators.snapshot import classify_run
from tidemark.plans.sync import DETAIL_COLUMNS, SIGHTING_COLUMNS, Run, apply_run, dry_run, load_tables, open_store
from tidemark.session import work_dir
from tidemark.sources.ingest import ingest_records
from tidemark.sources.state import Store

START = datetime(2026, 1, 1, 3)


def frame(spark, rows, columns):
    schema = ", ".join(f"{c} {t}" for c, t in columns.items())
    return spark.createDataFrame([tuple(r.get(c) for c in columns) for r in rows], schema)


def card(i, ext, price, **more):
    row = {
        "page": 1, "position": i, "external_id": ext, "source_url": f"https://s.test/imovel/{ext}", "title": "Apartamento",
        "city": "São Paulo", "price": None if price is None else Decimal(price), "bedrooms": 3,
        "main_image_url": f"https://s.test/{ext}.jpg", "tags": [],
    }
    return {**row, **more}


def offer(purpose, price):
    return (purpose, Decimal(price), "BRL", "Venda")


class Inventory:
    def __init__(self, spark, **defaults):
        self.spark, self.root, self.n, self.defaults = spark, work_dir(spark, "inv"), 0, defaults

    def run(self, cards, details=(), hours=24, **kw):
        self.n += 1
        args = {"policy": AbsencePolicy(2, 9999), "detail_ttl_hours": 0, **self.defaults, **kw}
        run = Run(f"r{self.n}", "src", START + timedelta(hours=hours * self.n), **args)
        done = apply_run(
            self.spark, self.root, frame(self.spark, cards, SIGHTING_COLUMNS), frame(self.spark, details, DETAIL_COLUMNS), run
        )
        assert done
        return self.store().history("runs", run.run_id).first()

    def store(self):
        return open_store(self.spark, self.root, "src")

    def table(self, name):
        return self.store().read(name)

    def statuses(self):
        return {r.external_id: r.status for r in self.table("listings").collect()}

    def events(self, kind=None):
        events = self.store().history("events")
        return (events.filter(F.col("event_type") == kind) if kind else events).orderBy("detected_at", "external_id", "seq").collect()


def detail(ext, price, images):
    return {"external_id": ext, "title": f"Apartamento {ext}", "price": Decimal(price), "image_urls": images, "detail_hash": ext}


def test_listing_runs(spark):
    """Creation, price change, repeat, photo swap, absence, removal, return, failed run, history."""
    inv = Inventory(spark)
    a1, a2 = card(1, "1001", "3100000"), card(2, "1002", "2000000")
    d1, d2 = detail("1001", "3100000", ["/a", "/b"]), detail("1002", "2000000", ["/x"])
    row = inv.run([a1, a2, {**a1, "position": 9, "price": Decimal(1)}], [d1, d2])
    assert (row.new_properties, row.listings_seen, row.photos_created) == (2, 2, 3)
    assert len(inv.events("CREATED")) == 2 and len(inv.events()) == 2

    b1, a3 = card(1, "1001", "2950000"), card(3, "1003", "1500000")
    d1, d3 = detail("1001", "2950000", ["/a", "/c"]), detail("1003", "1500000", ["/z"])
    row = inv.run([b1, a2, a3], [d1, d2, d3])
    assert (row.new_properties, row.updated_properties, row.unchanged_properties) == (1, 1, 1)
    assert (row.photos_created, row.photos_inactivated, row.photos_unchanged) == (2, 1, 2)
    (change,) = inv.events("PRICE_CHANGED")
    assert json.loads(change.old_value) == {"price": "3100000.00"}
    assert json.loads(change.new_value) == {"price": "2950000.00"}
    assert not inv.events("CONTENT_CHANGED")

    row = inv.run([b1, a2, a3], [d1, d2, d3])
    assert (row.new_properties, row.updated_properties, row.unchanged_properties) == (0, 0, 3)
    assert len(inv.events("PRICE_CHANGED")) == 1
    photos = {p.url: p.is_active for p in inv.table("photos").filter("external_id = '1001'").collect()}
    assert photos == {"/a": True, "/b": False, "/c": True}

    row = inv.run([b1, a3], [d1, d3], mode="full")
    assert row.missing_properties == 1 and inv.statuses()["1002"] == "MISSING"
    assert len(inv.events("MARKED_MISSING")) == 1
    row = inv.run([b1, a3], [d1, d3], mode="full")
    assert row.removed_properties == 1 and inv.statuses()["1002"] == "REMOVED"
    assert len(inv.events("REMOVED")) == 1
    row = inv.run([b1, a2, a3], [d1, d2, d3])
    assert row.reactivated_properties == 1 and inv.statuses()["1002"] == "ACTIVE"
    (back,) = inv.events("REACTIVATED")
    assert json.loads(back.old_value) == {"status": "REMOVED"}

    row = inv.run([b1], [d1], mode="full", completed=False, http_errors=1, stopped_reason="http_429")
    assert row.run_status == "partial" and not row.completed and inv.statuses()["1002"] == "ACTIVE"

    events = inv.store().history("events").withColumnRenamed("external_id", "listing_id")
    mine = price_history(events.filter("listing_id = '1001'")).orderBy("detected_at", "seq").collect()
    assert [r.price for r in mine] == [3100000.0, 2950000.0]


def test_content_change_without_price(spark):
    inv = Inventory(spark)
    inv.run([card(1, "1", "10", tags=["Novo"])])
    row = inv.run([card(1, "1", "10", tags=["Novo", "Vídeo"], bedrooms=None, city="Santos")])
    assert row.updated_properties == 1
    (event,) = inv.events("CONTENT_CHANGED")
    assert json.loads(event.old_value)["fields"] == {"city": "São Paulo", "tags": ["Novo"]}
    assert json.loads(event.new_value)["fields"] == {"city": "Santos", "tags": ["Novo", "Vídeo"]}
    assert inv.table("listings").first().bedrooms == 3


def test_sale_absent_rent_kept(spark):
    both = {"scope": {"purpose": "sale"}, "uses_offers": True}
    inv = Inventory(spark, **both)
    inv.run([card(1, "a", "1", offers=[offer("sale", 100), offer("aluguel", 5)]), card(2, "b", "1", offers=[offer("venda", 7)])])
    row = inv.run([card(1, "a", "1", offers=[offer("aluguel", 5)]), card(2, "b", "1", offers=[offer("venda", 7)])], mode="full")
    assert (row.missing_offers, row.missing_properties) == (1, 0)
    offers = {(o.external_id, o.purpose): o.status for o in inv.table("offers").collect()}
    assert offers == {("a", "SALE"): "MISSING", ("a", "RENT"): "ACTIVE", ("b", "SALE"): "ACTIVE"}
    assert inv.statuses() == {"a": "ACTIVE", "b": "ACTIVE"}


def test_offer_run_removes_and_reactivates(spark):
    inv = Inventory(spark, scope={"purpose": "sale"}, uses_offers=True, policy=AbsencePolicy(2, 9999))
    a, b = card(1, "a", "1", offers=[offer("sale", 100)]), card(2, "b", "1", offers=[offer("sale", 7)])
    inv.run([a, b])
    row = inv.run([a], mode="full")
    assert (row.missing_offers, row.missing_properties) == (1, 1)
    row = inv.run([a], mode="full")
    assert (row.removed_offers, row.removed_properties) == (1, 1)
    assert inv.statuses() == {"a": "ACTIVE", "b": "REMOVED"}
    row = inv.run([a, {**b, "offers": [offer("sale", 8)]}])
    assert (row.reactivated_properties, row.reactivated_offers, row.offers_updated) == (1, 1, 1)
    assert len(inv.events("REACTIVATED")) == 2
    assert [json.loads(e.new_value) for e in inv.events("PRICE_CHANGED")] == [
        {"entity": "offer", "purpose": "SALE", "price": "8.00"}
    ]
    assert inv.statuses()["b"] == "ACTIVE"


def test_new_offer_on_known_listing_is_only_counted(spark):
    inv = Inventory(spark, uses_offers=True)
    inv.run([card(1, "a", "1", offers=[offer("sale", 100)])])
    row = inv.run([card(1, "a", "1", offers=[offer("sale", 100), offer("rent", 5)])])
    assert (row.offers_created, row.offers_unchanged, row.updated_properties) == (1, 1, 1)
    assert {e.event_type for e in inv.events()} == {"CREATED"}


def test_ids_with_a_common_prefix_stay_apart(spark):
    inv = Inventory(spark)
    row = inv.run([card(1, "Z-10", "1"), card(2, "Z-1", "1"), card(3, "A-10", "1")])
    assert row.new_properties == 3 and set(inv.statuses()) == {"Z-10", "Z-1", "A-10"}


def test_untrusted_full_run_marks_nothing(spark):
    inv = Inventory(spark)
    inv.run([card(1, "a", "1"), card(2, "b", "1")])
    row = inv.run([card(1, "a", "1")], mode="full", reported_total=10)
    assert (row.run_status, row.stopped_reason, row.missing_properties) == ("partial", "suspicious_reported_total_gap", 0)
    assert inv.statuses() == {"a": "ACTIVE", "b": "ACTIVE"}


def test_run_verdicts(spark):
    base = {"mode": "full", "completed": True, "http_errors": 0, "parse_errors": 0, "stopped_reason": None, "reported_total": None,
            "listings_seen": 5, "previous_count": None}
    types = {"mode": "string", "completed": "boolean", "http_errors": "int", "parse_errors": "int", "stopped_reason": "string",
             "reported_total": "int", "listings_seen": "int", "previous_count": "int"}
    cases = [
        ({}, ("success", None, True)),
        ({"http_errors": 1}, ("partial", None, True)),
        ({"completed": False, "stopped_reason": "http_429"}, ("partial", "http_429", False)),
        ({"stopped_reason": "limit"}, ("partial", "limit", False)),
        ({"stopped_reason": "limit", "mode": "delta"}, ("success", "limit", True)),
        ({"stopped_reason": "max_pages", "mode": "delta"}, ("partial", "max_pages", False)),
        ({"reported_total": 11}, ("partial", "suspicious_reported_total_gap", False)),
        ({"reported_total": 10, "previous_count": 10}, ("success", None, True)),
        ({"previous_count": 11}, ("partial", "suspicious_low_count", False)),
        ({"previous_count": 11, "mode": "delta"}, ("success", None, True)),
        ({"listings_seen": 0, "previous_count": 0, "reported_total": 0}, ("success", None, True)),
    ]
    out = classify_run(frame(spark, [{**base, **c, "n": i} for i, (c, _) in enumerate(cases)], {**types, "n": "int"}), 0.5)
    got = [(r.run_status, r.stopped_reason, r.completed) for r in out.orderBy("n").collect()]
    assert got == [want for _, want in cases]


def test_no_history_trusts_an_empty_run(spark):
    inv = Inventory(spark)
    inv.run([card(1, "a", "1")])
    row = inv.run([], mode="full", previous_count=0)
    assert row.run_status == "success" and row.missing_properties == 1


def test_other_scope_is_left_alone(spark):
    inv = Inventory(spark)
    inv.run([card(1, "a", "1")], scope={"q": "Perdizes"})
    assert inv.run([card(2, "b", "1")], mode="full", scope={"q": "Sao Paulo"}).missing_properties == 0
    assert inv.run([card(2, "b", "1")], mode="full", scope={"q": "Perdizes"}).missing_properties == 1


def test_removal_by_hours(spark):
    inv = Inventory(spark, policy=AbsencePolicy(99, 72))
    inv.run([card(1, "a", "1"), card(2, "b", "1")])
    got = []
    for _ in range(2):
        inv.run([card(2, "b", "1")], hours=73, mode="full")
        got.append(inv.statuses()["a"])
    assert got == ["MISSING", "REMOVED"]


def test_repeated_run_id_is_skipped_and_cap_on_details(spark):
    inv = Inventory(spark)
    row = inv.run([card(1, "a", "1"), card(2, "b", "1")], [detail("a", "5", ["/a"]), detail("b", "6", ["/b"])], max_details=1)
    prices = {r.external_id: r.price for r in inv.table("listings").collect()}
    assert prices == {"a": Decimal("5.00"), "b": Decimal("1.00")}
    run = Run("r1", "src", START)
    assert not apply_run(spark, inv.root, frame(spark, [], SIGHTING_COLUMNS), frame(spark, [], DETAIL_COLUMNS), run)
    assert load_tables(spark, inv.root, "src").listings.count() == 2


def test_dry_run_writes_nothing(spark):
    cards = frame(spark, [card(i, str(i), "1", offers=[offer("sale", i)]) for i in range(1, 9)], SIGHTING_COLUMNS)
    figures, first = dry_run(cards, frame(spark, [detail("2", "5", [])], DETAIL_COLUMNS), Run("r", "s", START))
    row = figures.first()
    assert (row.listings_seen, row.sale_offers_seen, row.rent_offers_seen) == (8, 8, 0)
    shown = {r.external_id: r.detail for r in first.collect()}
    assert set(shown) == {"1", "2", "3", "4", "5"} and shown["2"].price == Decimal("5.00") and shown["1"] is None


def files_of(root, name):
    """The data files of a stored table by bucket."""
    found = {}
    for path in Path(root, name).glob("_part=*/_bucket=*/*.parquet"):
        found.setdefault(int(path.parent.name.split("=")[1]), set()).add(path.name)
    return found


def test_a_run_rewrites_the_buckets_it_touches(spark):
    """A run over one listing in a hundred leaves the files of all other buckets as they are."""
    root, empty = work_dir(spark, "inv"), frame(spark, [], DETAIL_COLUMNS)
    ids = [str(n) for n in range(300)]
    apply_run(spark, root, frame(spark, [card(n, i, "5") for n, i in enumerate(ids)], SIGHTING_COLUMNS), empty, Run("r1", "src", START), 256)
    before = {t: files_of(root, t) for t in ("listings", "photos")}
    seen = ["7", "70", "170"]
    apply_run(spark, root, frame(spark, [card(n, i, "6") for n, i in enumerate(seen)], SIGHTING_COLUMNS), empty, Run("r2", "src", START + timedelta(days=1)), 256)
    store = open_store(spark, root, "src", 256)
    touched = set(store.touched(spark.createDataFrame([(i,) for i in seen], "external_id string")))
    for name, files in before.items():
        changed = {b for b, names in files_of(root, name).items() if names != files.get(b)}
        assert changed == touched and len(changed) <= 3 < 0.03 * len(files) + 1
    prices = {r.external_id: r.price for r in load_tables(spark, root, "src").listings.collect()}
    assert prices == {i: Decimal(6 if i in seen else 5) for i in ids}
    plan = store.read("listings", [3])._jdf.queryExecution().executedPlan().toString()
    assert "_bucket" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]


def test_a_failed_run_leaves_a_row_and_may_be_tried_again(spark):
    inv = Inventory(spark)
    inv.run([card(1, "a", "1")])
    cards, details = frame(spark, [card(1, "b", "2")], SIGHTING_COLUMNS), frame(spark, [], DETAIL_COLUMNS)
    run = Run("r2", "src", START + timedelta(days=2), started_at=START + timedelta(days=2, hours=-1), pages_fetched=3)
    broken = cards.withColumn("title", F.raise_error(F.lit("a page that cannot be read")))
    with pytest.raises(Exception, match="cannot be read"):
        apply_run(spark, inv.root, broken, details, run)
    row = inv.store().history("runs", "r2").first()
    assert (row.status, row.completed, row.listings_seen, row.duration_seconds) == ("failed", False, None, 3600.0) and "cannot be read" in row.error
    assert inv.statuses() == {"a": "ACTIVE"}
    assert apply_run(spark, inv.root, cards, details, run)
    row = inv.store().history("runs", "r2").first()
    assert (row.status, row.new_properties, row.cards_seen, row.valid_cards_ratio, row.pages_per_second) == ("success", 1, 1, 1.0, round(3 / 3600, 6))
    assert inv.store().history("runs").count() == 2


def test_a_run_that_died_while_publishing_is_finished_by_the_next(spark, monkeypatch):
    inv = Inventory(spark)
    inv.run([card(1, "a", "1"), card(2, "b", "1")])
    cards, details = frame(spark, [card(1, "a", "9"), card(2, "c", "2")], SIGHTING_COLUMNS), frame(spark, [], DETAIL_COLUMNS)
    log = Store.log
    monkeypatch.setattr(Store, "log", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        apply_run(spark, inv.root, cards, details, Run("r2", "src", START + timedelta(days=2)))
    monkeypatch.setattr(Store, "log", log)
    assert set(inv.store().ready()) == {"r2"}
    assert not apply_run(spark, inv.root, cards, details, Run("r2", "src", START + timedelta(days=2)))
    assert not inv.store().ready() and inv.store().history("runs", "r2").first().new_properties == 1
    assert {r.external_id: r.price for r in inv.table("listings").collect()} == {"a": Decimal(9), "b": Decimal(1), "c": Decimal(2)}
    assert len(inv.events("PRICE_CHANGED")) == 1 and len(inv.events("CREATED")) == 3
    known = inv.store().finished()
    path = inv.store().staging()
    inv.store().note("r3", path, [], known)
    with pytest.raises(RuntimeError, match="r3 came about"):
        inv.store().note("r4", path, [], known)


def test_ingest_takes_the_last_record_and_keeps_what_it_cannot_read(spark):
    state = spark.createDataFrame([("a", Decimal("5.00"), "x"), ("b", Decimal("7.00"), "y")], "external_id string, price decimal(12,2), title string")
    sent = [("a", 1, {"price": "9", "title": "old"}), ("a", 2, {"price": "no price", "title": "new"}), ("b", 1, {"price": ""}), ("c", 1, {"price": "3"})]
    records = spark.createDataFrame(sent, "external_id string, seq int, fields map<string,string>")
    out = ingest_records(state, records, ["external_id"], F.current_timestamp(), ["seq"]).collect()
    assert {(r.external_id, r.price, r.title) for r in out} == {("a", Decimal("5.00"), "new"), ("b", None, "y"), ("c", Decimal("3.00"), None)}
    assert len(out) == 3
