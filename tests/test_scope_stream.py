"""The lifecycle stream of any calendar beside a fold over the runs."""

import random
from datetime import datetime, timedelta

import pandas as pd

from tidemark.operators.lifecycle import AbsencePolicy
from tidemark.session import work_dir
from tidemark.streaming import scopes, streams

START = datetime(2026, 1, 1)
CARDS = "source_key string, external_id string, run_id string, seen_at timestamp_ntz"
RUNS = "source_key string, run_id string, run_at timestamp_ntz, eligible boolean, scope_hash string"


def fold(runs, seen, policy):
    """Step by step: what each run does to each entity, an entity being forgotten when it is removed."""
    state, rows = {}, []
    for source, run, at, eligible, scope in sorted(runs, key=lambda r: (r[2], r[1])):
        sighted = seen.get((source, run), set())
        for (s, e), (own, n, since) in list(state.items()):
            if s == source and own == scope and e not in sighted and eligible:
                n, since = n + 1, since or at
                gone = n >= 2 and (n >= policy.threshold or at - since >= timedelta(hours=policy.removal_hours))
                rows.append((source, e, run, n, "REMOVED" if gone else "MISSING", since))
                if gone:
                    del state[s, e]
                else:
                    state[s, e] = own, n, since
        for e in sighted:
            state[source, e] = scope, 0, None
            rows.append((source, e, run, 0, "ACTIVE", None))
    return rows, state


def test_scope_stream_equals_fold_over_batches_and_a_restart(spark):
    rng, policy = random.Random(4), AbsencePolicy(3, 200)
    runs, at = [], START
    for n in range(24):
        at += timedelta(hours=rng.choice([5, 20, 31, 70]))
        runs.append((rng.choice("xy"), f"r{n:02d}", at, rng.random() < 0.8, rng.choice(["a", "b", None])))
    seen = {(s, r): {f"e{e}" for e in range(25) if rng.random() < 0.25} for s, r, *_ in runs}
    at_of = {(s, r): at for s, r, at, *_ in runs}
    cards = [(s, e, r, at_of[s, r] - timedelta(minutes=rng.randint(1, 200))) for (s, r), es in seen.items() for e in sorted(es) for _ in range(2)]
    folder_c, folder_r, out, checkpoint = (work_dir(spark, n) for n in ("cards", "runs", "life", "cp"))
    cuts = [START, *(runs[n][2] for n in (5, 11, 17)), START + timedelta(days=999)]

    def feed(lo, hi):
        spark.createDataFrame([c for c in cards if lo < at_of[c[0], c[2]] <= hi], CARDS).coalesce(1).write.mode("append").parquet(folder_c)
        spark.createDataFrame([r for r in runs if lo < r[2] <= hi], RUNS).coalesce(1).write.mode("append").parquet(folder_r)

    def run():
        c = streams.read_stream(spark, folder_c, CARDS, "*.parquet", files_per_batch=1)
        r = streams.read_stream(spark, folder_r, RUNS, "*.parquet", files_per_batch=1)
        scopes.run_scope_lifecycle(scopes.scope_lifecycle(c, r, policy, buckets=3, delay="4 hours"), out, checkpoint)

    for lo, hi in zip(cuts[:2], cuts[1:3]):
        feed(lo, hi)
    run()
    for lo, hi in zip(cuts[2:], cuts[3:]):
        feed(lo, hi)
    # A run far ahead lets the watermark pass the others; a row without a source is dropped.
    late = [("tick", "tick", START + timedelta(days=2000), False, None), (None, "r99", START, True, "a")]
    spark.createDataFrame(late, RUNS).coalesce(1).write.mode("append").parquet(folder_r)
    run()
    want, state = fold(runs, seen, policy)
    got = [(r.source_key, r.external_id, r.run_id, r.absences, r.status, r.missing_since) for r in spark.read.parquet(out).collect()]
    key = lambda r: (r[0], r[1], r[2], r[3])
    assert sorted(got, key=key) == sorted(want, key=key)
    assert sum(r[4] == "REMOVED" for r in got) > 5
    # Removed entities have left the state, the others are still there.
    kept = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "entities").load()
    assert {(r.key.source_key, r.user_map_key.external_id) for r in kept.select("key", "user_map_key").collect()} == set(state)


class Held(dict):
    """A map state in memory that counts its writes."""

    def __init__(self):
        super().__init__()
        self.writes = 0

    containsKey, getValue = dict.__contains__, dict.get

    def iterator(self):
        return iter(list(self.items()))

    def updateValue(self, key, value):
        self.writes += 1
        self[key] = value

    def removeKey(self, key):
        self.writes += 1
        del self[key]


class Handle:
    def __init__(self):
        self.maps, self.timers = {}, set()

    def getMapState(self, name, *_):
        return self.maps.setdefault(name, Held())

    def registerTimer(self, at):
        self.timers.add(at)


class At:
    def __init__(self, ms):
        self.ms = ms

    def getExpiryTimeInMs(self):
        return self.ms

    getCurrentWatermarkInMs = getExpiryTimeInMs


def test_scope_stream_writes_an_entity_once_however_many_runs_are_closed():
    rng, policy = random.Random(9), AbsencePolicy(3, 240)
    runs = [("x", f"r{n:02d}", START + timedelta(days=n + 1), n != 6, rng.choice("ab") if n > 8 else "a") for n in range(20)]
    seen = {("x", run): {f"e{e}" for e in range(60) if rng.random() < 0.4} for _, run, *_ in runs}
    handle, follow = Handle(), scopes.ScopeLifecycle(policy, 24 * 7)
    follow.init(handle)
    lines = [(None, run, at, eligible, scope) for _, run, at, eligible, scope in runs]
    lines += [(e, run, at - timedelta(hours=2), None, None) for _, run, at, *_ in runs for e in sorted(seen["x", run]) for _ in range(2)]
    rng.shuffle(lines)
    rows = pd.DataFrame(lines, columns=["external_id", "run_id", "at", "eligible", "scope"])
    list(follow.handleInputRows(("x", 0), (rows[n:n + 50] for n in range(0, len(rows), 50)), None))
    # Cards come in many parts, a run's are written once.
    assert handle.maps["cards"].writes == len(runs)
    parts = [part for ms in sorted(handle.timers) for part in follow.handleExpiredTimer(("x", 0), At(max(handle.timers) + 1), At(ms))]
    want, state = fold(runs, seen, policy)
    micros = lambda at: None if at is None else (at - datetime(1970, 1, 1)) // timedelta(microseconds=1)
    got = [tuple(None if v is pd.NA else v for v in r) for r in pd.concat(parts)[scopes.COLUMNS].astype(object).itertuples(index=False)]
    at_of = {run: at for _, run, at, *_ in runs}
    assert sorted(got, key=str) == sorted(((s, e, run, micros(at_of[run]), n, status, micros(since)) for s, e, run, n, status, since in want), key=str)
    entities = handle.maps["entities"]
    assert {e for e, in entities} == {e for _, e in state} and entities.writes <= 60
    assert not handle.maps["waiting"] and not handle.maps["cards"]
