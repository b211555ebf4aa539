"""Ordered operators against plain loops over small frames."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import calendar, lifecycle, ordered, snapshot
from tidemark.operators.joins import already_started
from tidemark.session import work_dir
from tidemark.streaming import streams

START = datetime(2026, 1, 1)
POLICY = lifecycle.AbsencePolicy


def test_absence_transitions(spark):
    now = datetime(2026, 1, 10, 12)
    rows = [
        ("active", "ACTIVE", None, 0, True), ("late", "MISSING", now - timedelta(hours=73), 0, True),
        ("early", "MISSING", now - timedelta(hours=1), 0, True), ("often", "MISSING", now, 1, True),
        ("gone", "REMOVED", now, 5, True), ("untrusted", "ACTIVE", None, 0, False), ("lower", "missing", now, 9, True),
    ]
    frame = spark.createDataFrame(
        [(*r, None) for r in rows],
        "id string, status string, missing_since timestamp_ntz, missing_count int, absent boolean, removed_at timestamp_ntz",
    )
    out = snapshot.absence_step(frame, F.col("absent"), POLICY(2, 72), F.lit(now).cast("timestamp_ntz"))
    got = {r.id: (r.status, r.absence, r.missing_count) for r in out.collect()}
    assert got == {
        "active": ("MISSING", "missing", 1), "late": ("REMOVED", "removed", 1), "early": ("MISSING", None, 1),
        "often": ("REMOVED", "removed", 2), "gone": ("REMOVED", None, 6), "untrusted": ("ACTIVE", None, 0),
        "lower": ("missing", None, 10),
    }


def fold(seen, runs, policy):
    """Step by step: what each run does to one entity."""
    status, count, since, scope, rows = None, 0, None, None, []
    for number, (at, eligible, run_scope) in enumerate(runs):
        if number in seen:
            status, count, since, scope = "ACTIVE", 0, None, run_scope
        elif status is None or not eligible or run_scope != scope:
            continue
        else:
            count += 1
            if status == "ACTIVE":
                status, since = "MISSING", at
            elif status == "MISSING" and (count >= policy.threshold or at - since >= timedelta(hours=policy.removal_hours)):
                status = "REMOVED"
        rows.append((number, count, status, since))
    return rows


@pytest.mark.parametrize(("threshold", "hours"), [(1, 72), (2, 72), (4, 9999), (9, 50)])
def test_lifecycle_equals_fold(spark, threshold, hours):
    rng, policy = random.Random(threshold), POLICY(threshold, hours)
    runs = [(START + timedelta(hours=20 * n), rng.random() < 0.8, rng.choice("ab")) for n in range(25)]
    seen = {f"e{e}": sorted(rng.sample(range(25), rng.randint(1, 9))) for e in range(60)}
    log = spark.createDataFrame(
        [(f"r{n:02d}", *r) for n, r in enumerate(runs)], "run_id string, run_at timestamp_ntz, eligible boolean, scope_hash string"
    )
    cards = spark.createDataFrame(
        [(e, f"r{n:02d}") for e, ns in seen.items() for n in ns for _ in range(2)], "external_id string, run_id string"
    )
    out = lifecycle.absence_lifecycle(cards, log, ["external_id"], policy=policy).collect()
    got = sorted((r.external_id, int(r.run_id[1:]), r.absences, r.status, r.missing_since) for r in out)
    want = sorted((e, *row) for e, ns in seen.items() for row in fold(set(ns), runs, policy))
    assert got == want
    steps = {e: fold(set(ns), runs, policy) for e, ns in seen.items()}
    changes = lifecycle.status_changes(cards, log, ["external_id"], policy=policy).collect()
    assert sorted((r.external_id, int(r.run_id[1:]), r.absences, r.status, r.missing_since) for r in changes) == sorted(
        (e, *row) for e, rows in steps.items() for n, row in enumerate(rows) if n == 0 or rows[n - 1][2] != row[2]
    )
    counts = lifecycle.status_counts(cards, log, ["external_id"], policy=policy).collect()
    each = [(row[2], e) for e, rows in steps.items() for row in rows]
    assert {(r.status, r.entity_runs, r.entities) for r in counts} == {
        (s, sum(t == s for t, _ in each), len({e for t, e in each if t == s})) for s in {t for t, _ in each}
    }


def test_lifecycle_over_months_sources_and_no_scope(spark):
    """Two sources share run ids; the runs span months, half of them have no scope."""
    policy = POLICY(3, 24 * 40)
    runs = [(START + timedelta(days=9 * n), n % 5 != 3, None if n % 2 else "a") for n in range(40)]
    logs = [(s, f"r{n:02d}", *r) for s in ("x", "y") for n, r in enumerate(runs)]
    log = spark.createDataFrame(logs, "source_key string, run_id string, run_at timestamp_ntz, eligible boolean, scope_hash string")
    rng = random.Random(3)
    seen = {(s, f"e{e}"): set(rng.sample(range(40), rng.randint(1, 5))) for s in ("x", "y") for e in range(20)}
    cards = spark.createDataFrame(
        [(s, e, f"r{n:02d}") for (s, e), ns in seen.items() for n in ns], "source_key string, external_id string, run_id string"
    )
    out = lifecycle.absence_lifecycle(cards, log, ["external_id"], ["source_key"], policy).collect()
    got = sorted((r.source_key, r.external_id, int(r.run_id[1:]), r.absences, r.status) for r in out)
    assert got == sorted((*e, n, k, s) for e, ns in seen.items() for n, k, s, _ in fold(ns, runs, policy))
    empty = lifecycle.status_changes(cards.limit(0), log, ["external_id"], ["source_key"], policy)
    assert empty.count() == 0


def test_lifecycle_stream_over_batches(spark):
    """Five batches of two days each, one of them with a card for a run already closed."""
    rng, policy = random.Random(5), POLICY(2, 60)
    seen = {f"e{e}": sorted(rng.sample(range(10), rng.randint(1, 5))) for e in range(30)}
    folder = work_dir(spark, "cards")
    for batch in range(5):
        rows = [(e, START + timedelta(days=n, hours=7)) for e, ns in seen.items() for n in ns if n // 2 == batch]
        rows.append(("tick", START + timedelta(days=2 * batch + 1, hours=23)))
        spark.createDataFrame(rows, "external_id string, seen_at timestamp").coalesce(1).write.mode("append").parquet(folder)
    stream = streams.read_stream(spark, folder, "external_id string, seen_at timestamp", "*.parquet", files_per_batch=1)
    out = work_dir(spark, "life")
    streams.run_available(streams.lifecycle_stream(stream, policy), out, work_dir(spark, "cp"))
    got = sorted(
        ((r.run_at - START).days, r.external_id, r.absences, r.status)
        for r in spark.read.parquet(out).collect() if r.external_id != "tick"
    )
    runs = [(START + timedelta(days=n), True, None) for n in range(10)]
    want = sorted(
        (n, e, k, s) for e, ns in seen.items() for n, k, s, _ in fold(set(ns), runs, policy) if k == 0 or n < 9
    )
    assert got == want


def greedy(rows, minutes):
    kept, last = [], {}
    for key, ident, at in sorted(rows, key=lambda r: (r[2], r[1])):
        if key not in last or at - last[key] >= timedelta(minutes=minutes):
            last[key] = at
            kept.append((key, ident))
    return sorted(kept)


def alert_rows(seed, n=1500):
    rng = random.Random(seed)
    spread = rng.choice([500, 20000])
    return [
        ("hot" if rng.random() < 0.7 else f"k{rng.randint(1, 4)}", i, START + timedelta(minutes=rng.randint(0, spread)))
        for i in range(n)
    ]


@pytest.mark.parametrize(("seed", "minutes"), [(1, 30), (2, 7), (3, 600)])
def test_cooldown_equals_greedy(spark, seed, minutes):
    rows = alert_rows(seed)
    alerts = spark.createDataFrame(rows, "key string, id bigint, ts timestamp_ntz")
    out = ordered.cooldown_suppress(alerts, ["key"], "ts", minutes, "id", blocks_of=2)
    assert sorted((r.key, r.id) for r in out.collect()) == greedy(rows, minutes)


def test_cooldown_regular_alerts_and_zero(spark):
    rows = [("a", i, START + timedelta(minutes=i)) for i in range(400)]
    alerts = spark.createDataFrame(rows, "key string, id bigint, ts timestamp_ntz")
    out = ordered.cooldown_suppress(alerts, ["key"], "ts", 60, "id", blocks_of=3)
    assert sorted((r.key, r.id) for r in out.collect()) == greedy(rows, 60)
    assert ordered.cooldown_suppress(alerts, ["key"], "ts", 0, "id").count() == 400


def test_cooldown_of_one_hot_key_groups_no_key_whole(spark):
    """One key owns all alerts, over many blocks and several chunks of them, some of them far apart."""
    rng = random.Random(8)
    at = [START + timedelta(minutes=m) for m in sorted(rng.sample(range(30_000), 900)) + [90_000, 2_000_000, 2_000_004]]
    rows = [("hot", i, t) for i, t in enumerate(at)]
    alerts = spark.createDataFrame(rows, "key string, id bigint, ts timestamp_ntz")
    out = ordered.cooldown_suppress(alerts, ["key"], "ts", 20, "id", blocks_of=1)
    assert sorted((r.key, r.id) for r in out.collect()) == greedy(rows, 20)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert all("_block" in line for line in plan.splitlines() if "FlatMapGroupsInPandas" in line)


def alert_folder(spark, rows, cuts):
    folder, schema = work_dir(spark, "alerts"), "key string, id bigint, ts timestamp_ntz"
    for part in (rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    return folder, streams.read_stream(spark, folder, schema, "*.parquet", files_per_batch=1)


def test_cooldown_stream_over_batches(spark):
    rows, root = sorted(alert_rows(4, 600), key=lambda r: r[2]), work_dir(spark, "kept")
    _, stream = alert_folder(spark, rows, [200, 350])
    streams.cooldown_stream(stream, root, work_dir(spark, "cp"), ["key"], "ts", "id", 45)
    assert sorted((r.key, r.id) for r in streams.kept_alerts(spark, root).collect()) == greedy(rows, 45)


def test_cooldown_stream_goes_on_after_a_restart(spark):
    rows, root, checkpoint = sorted(alert_rows(6, 500), key=lambda r: r[2]), work_dir(spark, "kept"), work_dir(spark, "cp")
    folder, stream = alert_folder(spark, rows[:300], [100, 200])
    streams.cooldown_stream(stream, root, checkpoint, ["key"], "ts", "id", 45, delay="1 hour")
    assert sorted((r.key, r.id) for r in streams.kept_alerts(spark, root).collect()) == greedy(rows[:300], 45)
    spark.createDataFrame([*rows[300:], (None, 1, START), ("k1", 2, None)], stream.schema).coalesce(1).write.mode("append").parquet(folder)
    streams.cooldown_stream(stream, root, checkpoint, ["key"], "ts", "id", 45, delay="1 hour")
    assert sorted((r.key, r.id) for r in streams.kept_alerts(spark, root).collect()) == greedy(rows, 45)


def test_running_over_blocks(spark):
    rng = random.Random(9)
    rows = [("r", p, rng.randint(0, 5), rng.choice([None, rng.randint(0, 99)])) for p in rng.sample(range(1, 60), 40)]
    frame = spark.createDataFrame(rows, "run string, page int, n int, m int").withColumn("odd", F.col("n") % 2 == 1)
    out = ordered.running(frame, ["run"], "page", ["n"], ["m"], {"at_odd": ("odd", "n")}, ["m"], block=7)
    total, top, at_odd, before = 0, None, None, {}
    for (_, p, n, m), got in zip(sorted(rows, key=lambda r: r[1]), out.orderBy("page").collect(), strict=True):
        total += n
        top = m if top is None else top if m is None else max(top, m)
        at_odd = total if n % 2 else at_odd
        assert (got.n_upto, got.m_upto, got.at_odd, got.prev_m) == (total, top, at_odd, before.get(p - 1))
        before[p] = m


PAGE = "run string, mode string, page int, url string, next_url string, http_status int, parse_failed boolean, raw_cards int, invalid_cards int, reported_total int"
CRAWLS = {
    # run: (mode, pages as (ids, overrides), stop page, reason, complete)
    "clean": ("full", [("ab", {}), ("cd", {}), ("", {})], 3, "no_cards", True),
    "lost": ("full", [("ab", {}), ("", {"reported_total": 9})], 2, "reported_total_without_cards", False),
    "end404": ("full", [("ab", {}), ("", {"http_status": 404})], 2, "http_404", True),
    "first404": ("full", [("", {"http_status": 404})], 1, "http_404", False),
    "blocked": ("delta", [("ab", {}), ("cd", {"http_status": 429})], 2, "http_429", False),
    "broken": ("delta", [("ab", {"parse_failed": True})], 1, "parse_error", False),
    "invalid": ("delta", [("abcd", {"raw_cards": 5, "invalid_cards": 1}), ("ef", {"raw_cards": 4, "invalid_cards": 2})], 2, "invalid_card_rate", False),
    "loop_full": ("full", [("ab", {}), ("ba", {})], 2, "repeated_page", False),
    "loop_delta": ("delta", [("ab", {}), ("ba", {})], 2, "repeated_page", True),
    "stale_full": ("full", [("abc", {}), ("ab", {}), ("d", {})], 2, "no_new_external_ids", False),
    "stale_delta": ("delta", [("abc", {}), ("ab", {}), ("bc", {}), ("ac", {}), ("d", {})], 4, "no_new_external_ids", True),
    "patient": ("delta", [("abc", {}), ("ab", {}), ("d", {}), ("a", {}), ("", {})], 5, "no_cards", True),
    "back_url": ("delta", [("ab", {"next_url": "/2"}), ("cd", {"url": "/2", "next_url": "/1"}), ("ef", {"url": "/1"})], 3, "repeated_next_url", False),
    "same_url": ("delta", [("ab", {}), ("cd", {"url": "/1"})], 2, "repeated_listing_url", False),
    "limit": ("delta", [("abc", {}), ("defghi", {}), ("j", {})], 2, "limit", True),
    "ran_out": ("delta", [("ab", {}), ("cd", {})], None, None, True),
}


def test_crawl_stop_reasons(spark):
    pages, cards = [], []
    for run, (mode, content, *_) in CRAWLS.items():
        for n, (ids, more) in enumerate(content, start=1):
            row = {"url": f"/{n}", "next_url": None, "http_status": 200, "parse_failed": False, "raw_cards": 0, "invalid_cards": 0, "reported_total": None}
            pages.append((run, mode, n, *{**row, **more}.values()))
            cards += [(run, n, i, c) for i, c in enumerate(ids)]
    log = spark.createDataFrame(pages, PAGE)
    ids = spark.createDataFrame(cards, "run string, page int, position int, external_id string")
    out = {r.run: (r.stop_page, r.stopped_reason, r.completed) for r in ordered.crawl_stop_reason(log, ids, ["run"], limit=8).collect()}
    assert out == {run: tuple(want) for run, (_, _, *want) in CRAWLS.items()}
    capped = {r.run: (r.stopped_reason, r.completed) for r in ordered.crawl_stop_reason(log, ids, ["run"], max_pages=1).collect()}
    assert capped["clean"] == ("max_pages", False) and capped["first404"] == ("http_404", False)


def test_calendar(spark):
    at = lambda h, m=0: datetime(2026, 1, 10, h, m)
    cases = [
        # kind, now, hour, hours, interval, offset, jitter -> previous, next
        ("daily", at(1), 3, [], 0, 15, 0, datetime(2026, 1, 9, 3, 15), at(3, 15)),
        ("daily", at(3, 15), 3, [], 0, 15, 0, at(3, 15), datetime(2026, 1, 11, 3, 15)),
        ("hours", at(9), 0, [8, 12, 36], 0, 5, 2, at(8, 7), at(12, 7)),
        ("hours", at(7), 0, [8], 0, 0, 0, datetime(2026, 1, 9, 8), at(8)),
        ("hours", at(1), 0, [], 0, 0, 0, datetime(2026, 1, 9, 2), at(2)),
        ("interval", at(10, 20), 0, [], 60, 10, 3, at(10, 13), at(11, 13)),
        ("interval", at(10, 5), 0, [], 25, 10, 0, at(9, 45), at(10, 10)),
    ]
    jobs = spark.createDataFrame(
        [(f"j{i}", "s", "t", *c[:7]) for i, c in enumerate(cases)],
        "job_id string, source_key string, job_type string, kind string, now timestamp_ntz, hour int, hours array<int>, "
        "interval_minutes int, offset_minutes int, jitter_minutes int",
    )
    out = calendar.previous_occurrence(calendar.next_occurrence(jobs)).orderBy("job_id").collect()
    assert [(r.previous_run_at, r.next_run_at) for r in out] == [c[7:] for c in cases]
    slots = calendar.expected_occurrences(jobs.filter("job_id = 'j0'"), "2026-01-10 00:00:00", "2026-01-12 00:00:00")
    assert sorted((r.local_at, r.scheduled_at) for r in slots.collect()) == [
        (datetime(2026, 1, d, 3, 15), datetime(2026, 1, d, 6, 15)) for d in (10, 11)
    ]
    runs = spark.createDataFrame(
        [("s", "t", datetime(2026, 1, 10, 6, 47), '{"schedule_job_id":"j0"}'), ("s", "t", datetime(2026, 1, 11, 6, 48), '{"schedule_job_id":"j0"}')],
        "provider_key string, job_name string, created_at timestamp_ntz, summary string",
    )
    assert [r.local_at.day for r in already_started(slots, runs, 30).collect()] == [10]
    states = calendar.occurrence_status(slots, runs, "2026-01-11 06:20:00", 30)
    assert sorted((r.local_at.day, r.state) for r in states.collect()) == [(10, "misfired"), (11, "due")]
