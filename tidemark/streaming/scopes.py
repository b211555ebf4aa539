"""The lifecycle of entities on a stream of cards and a stream of runs, whatever calendar the runs keep.

The entities of a source are dealt into hash buckets; a bucket's entities are the map state of one key,
so a source of any size spreads over all tasks. A run's row goes to every bucket of its source and waits
there with a timer at the run's time. When the watermark passes it the run is closed: the entities that it
sighted start anew in its scope, those of the same scope that an eligible run did not sight are one
absence further, and an entity that is removed leaves the state. All runs of a bucket that the watermark
has passed are closed together: its entities are read once, stepped as arrays, and those that changed are
written back once, however many runs there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.lifecycle import AbsencePolicy
from .streams import run_available

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HOUR = 3_600_000_000
#: A time that stands for none, and the rows that a bucket hands on at a time.
NEVER, ROWS = np.iinfo(np.int64).min, 1 << 16
COLUMNS = ["source_key", "external_id", "run_id", "run_us", "absences", "status", "since_us"]
OUTPUT = "source_key string, external_id string, run_id string, run_us bigint, absences int, status string, since_us bigint"


class Bucket:
    """The entities of one bucket as arrays: number of the scope (-1: not followed), absences, and since when."""

    def __init__(self, entities: Iterator[tuple[tuple, tuple]], policy: AbsencePolicy):
        self.policy, self.scopes = policy, {}
        held = [(entity, self._scope(scope), absences, NEVER if since is None else since) for (entity,), (scope, absences, since) in entities]
        names, own, absences, since = zip(*held) if held else ((), (), (), ())
        self.names, self.number = np.array(names, object), {name: n for n, name in enumerate(names)}
        self.own, self.absences, self.since = (np.array(v, np.int64) for v in (own, absences, since))
        self.before = np.stack([self.own, self.absences, self.since])

    def _scope(self, scope: str) -> int:
        return self.scopes.setdefault(scope, len(self.scopes))

    def _places(self, entities: list[str]) -> np.ndarray:
        """Where the entities are; new ones are put behind the others."""
        if new := [e for e in entities if e not in self.number]:
            self.number.update((e, len(self.names) + n) for n, e in enumerate(new))
            self.names = np.concatenate([self.names, np.array(new, object)])
            self.own, self.absences, self.since = (
                np.concatenate([v, np.full(len(new), x)]) for v, x in ((self.own, -1), (self.absences, 0), (self.since, NEVER)))
        return np.fromiter(map(self.number.get, entities), np.int64, len(entities))

    def close(self, at: int, scope: str, eligible: bool, sighted: list[str]) -> Iterator[pd.DataFrame]:
        """Steps the entities over one run, and what the run says of those that it sighted or could have missed."""
        here, seen = self._scope(scope), self._places(sighted)
        if eligible:
            missed = self.own == here
            missed[seen] = False
            missed = np.flatnonzero(missed)
            absences = self.absences[missed] + 1
            since = np.where(self.since[missed] == NEVER, at, self.since[missed])
            late = at - since >= self.policy.removal_hours * HOUR
            removed = (absences >= 2) & ((absences >= self.policy.threshold) | late)
            self.absences[missed], self.since[missed] = absences, since
            self.own[missed[removed]] = -1
            if len(missed):
                yield self._rows(missed, np.where(removed, "REMOVED", "MISSING"))
        self.own[seen], self.absences[seen], self.since[seen] = here, 0, NEVER
        if len(seen):
            yield self._rows(seen, "ACTIVE")

    def _rows(self, which: np.ndarray, status) -> pd.DataFrame:
        since = self.since[which]
        return pd.DataFrame({
            "external_id": self.names[which], "absences": self.absences[which], "status": status,
            "since_us": pd.arrays.IntegerArray(since, since == NEVER),
        })

    def changes(self) -> Iterator[tuple[str, tuple | None]]:
        """The entities whose state is another than at first, with their state, None for those that left."""
        scopes, known = list(self.scopes), self.before.shape[1]
        changed = (self.own != -1) | (np.arange(len(self.own)) < known)
        same = self.own[:known] == self.before[0]
        changed[:known] = ~(same & (self.absences[:known] == self.before[1]) & (self.since[:known] == self.before[2]))
        for n in np.flatnonzero(changed).tolist():
            if self.own[n] < 0:
                yield self.names[n], None
            else:
                since = int(self.since[n])
                yield self.names[n], (scopes[self.own[n]], int(self.absences[n]), None if since == NEVER else since)


class ScopeLifecycle(StatefulProcessor):
    """Follows the entities of one bucket of a source."""

    def __init__(self, policy: AbsencePolicy, patience_hours: int):
        self.policy, self.patience = policy, patience_hours * HOUR

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entities = handle.getMapState("entities", "external_id string", "scope string, absences int, since bigint")
        self.waiting = handle.getMapState("waiting", "at bigint, run_id string", "eligible boolean, scope string")
        self.cards = handle.getMapState("cards", "run_id string", "ids array<string>, at bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found: dict[str, tuple[set, int]] = {}
        for pdf in rows:
            pdf = pdf.assign(us=pdf["at"].to_numpy().astype("datetime64[us]").astype("int64"))
            for r in pdf[pdf["external_id"].isna()].itertuples():
                self.waiting.updateValue((r.us, r.run_id), (bool(r.eligible), r.scope))
                self.handle.registerTimer(-(-r.us // 1000))
            for run_id, own in pdf[pdf["external_id"].notna()].groupby("run_id"):
                ids, seen = found.get(run_id, (set(), 0))
                ids.update(own["external_id"])
                found[run_id] = ids, max(int(own["us"].max()), seen)
        # A run's cards of a batch are merged with the earlier ones once, not with every part that comes in.
        for run_id, (ids, seen) in found.items():
            known = self.cards.getValue((run_id,)) if self.cards.containsKey((run_id,)) else None
            self.cards.updateValue((run_id,), (sorted(ids.union(known[0] if known else ())), max(seen, known[1] if known else 0)))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # What the watermark has passed is closed with the first of its timers; the others find nothing left.
        upto = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1) * 1000
        due = sorted(tuple(k) for k in self.waiting.keys() if k[0] <= upto)
        if not due:
            return
        cards = {run_id: (ids, seen) for (run_id,), (ids, seen) in self.cards.iterator()}
        bucket, made, size = Bucket(self.entities.iterator(), self.policy), [], 0
        for at, run_id in due:
            eligible, scope = self.waiting.getValue((at, run_id))
            self.waiting.removeKey((at, run_id))
            sighted = []
            if run_id in cards:
                sighted = cards.pop(run_id)[0]
                self.cards.removeKey((run_id,))
            for part in bucket.close(at, scope, eligible, sighted):
                made.append(part.assign(source_key=key[0], run_id=run_id, run_us=at)[COLUMNS])
                size += len(part)
            # Cards of a run that never came are given up.
            for other in [r for r, (_, seen) in cards.items() if seen < at - self.patience]:
                del cards[other]
                self.cards.removeKey((other,))
            if size >= ROWS:
                yield pd.concat(made)
                made, size = [], 0
        if size:
            yield pd.concat(made)
        for entity, value in bucket.changes():
            if value is None:
                self.entities.removeKey((entity,))
            else:
                self.entities.updateValue((entity,), value)

    def close(self) -> None:
        pass


def scope_lifecycle(
    cards: DataFrame, runs: DataFrame, policy: AbsencePolicy = AbsencePolicy(), buckets: int = 16, delay: str = "0 seconds",
    patience_hours: int = 24 * 7,
) -> DataFrame:
    """Status of every entity after every closed run that sighted it or could have missed it, up to its removal.

    ``cards`` has source_key, external_id, run_id and seen_at, ``runs`` has source_key, run_id, run_at (not
    before its cards), eligible and scope_hash, a NULL scope being a scope of its own. A run is closed once
    the watermark, ``delay`` behind the latest time of either stream, has passed run_at. Cards that come
    after that, or whose run does not come within ``patience_hours``, are dropped, as are rows without a
    source, run or time.
    """
    scope = F.coalesce(F.concat(F.lit("s"), "scope_hash"), F.lit(""))
    seen = cards.dropna(subset=["source_key", "external_id", "run_id", "seen_at"]).select(
        "source_key", F.pmod(F.xxhash64("external_id"), F.lit(buckets)).cast("int").alias("bucket"), "external_id", "run_id",
        F.col("seen_at").cast("timestamp").alias("at"), F.lit(None).cast("boolean").alias("eligible"), F.lit(None).cast("string").alias("scope"),
    )
    closing = runs.dropna(subset=["source_key", "run_id", "run_at"]).select(
        "source_key", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"), F.lit(None).cast("string").alias("external_id"),
        "run_id", F.col("run_at").cast("timestamp").alias("at"), F.coalesce("eligible", F.lit(False)).alias("eligible"), scope.alias("scope"),
    )
    rows = seen.union(closing).withWatermark("at", delay).groupBy("source_key", "bucket").transformWithStateInPandas(
        ScopeLifecycle(policy, patience_hours), OUTPUT, "append", "EventTime"
    )
    at = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    return rows.select(
        "source_key", "external_id", "run_id", at("run_us").alias("run_at"), "absences", "status", at("since_us").alias("missing_since")
    )


def run_scope_lifecycle(lifecycle: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """``run_available`` with the state store that keyed map state and timers need."""
    conf = lifecycle.sparkSession.conf
    before = conf.get(PROVIDER, None)
    conf.set(PROVIDER, ROCKSDB)
    try:
        return run_available(lifecycle, path, checkpoint)
    finally:
        conf.unset(PROVIDER) if before is None else conf.set(PROVIDER, before)
