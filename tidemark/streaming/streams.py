"""The same work on streams of sightings and alerts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.lifecycle import AbsencePolicy
from ..plans.sync import Run, apply_run

_SECOND = 1_000_000


def read_stream(spark: SparkSession, folder: str, schema, glob: str, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def run_available(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write all that a stream holds now to parquet and stop; exactly once over restarts."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def dedupe_stream(stream: DataFrame, keys: list[str], delay: str, ts: str = "seen_at") -> DataFrame:
    """Each key once, as long as its repeats come within the delay of one another.

    The state forgets a key when the watermark has passed it, so it holds a delay's worth of
    keys and not the whole history.
    """
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    return timed.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def _absence_row(entity: str, run: int, n: int, since: int | None, policy: AbsencePolicy) -> tuple:
    late = since is not None and run - since >= policy.removal_hours * 3600 * _SECOND
    status = "ACTIVE" if n == 0 else "REMOVED" if n >= 2 and (n >= policy.threshold or late) else "MISSING"
    return entity, run, n, status, -1 if since is None else since


def _lifecycle(policy: AbsencePolicy, every: int):
    """Follows one entity: state is its last sighted run and the last run reported on."""

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, told = state.get if state.exists else (None, None)
        rows: list[tuple] = []

        def absent_until(run: int) -> None:
            nonlocal told
            while told + every < run:
                told += every
                rows.append(_absence_row(key[0], told, (told - seen) // every, seen + every, policy))

        # One row a run and key reaches this point, so the list is as long as the batch has runs.
        for run in sorted(int(r) for batch in batches for r in batch["run_us"]):
            if seen is not None:
                run = max(run, told + every)
                absent_until(run)
            seen = told = run
            rows.append(_absence_row(key[0], run, 0, None, policy))
        closed = state.getCurrentWatermarkMs() * 1000
        if seen is not None:
            # A run is closed once the watermark has passed its end.
            absent_until(closed // every * every)
            state.update((seen, told))
            state.setTimeoutTimestamp(max((told + 2 * every) // 1000, state.getCurrentWatermarkMs() + 1))
        if rows:
            yield pd.DataFrame(rows, columns=["external_id", "run_us", "absences", "status", "since_us"])

    return follow


def lifecycle_stream(
    stream: DataFrame, policy: AbsencePolicy = AbsencePolicy(), every_hours: int = 24, delay: str = "0 seconds"
) -> DataFrame:
    """Status of every entity after every closed run, for a regular calendar of full runs.

    ``stream`` has external_id and seen_at. A run spans ``every_hours``; it closes when the
    watermark passes its end, at which the entities it did not sight time out and are reported
    absent. A card that comes after that counts in the next open run.
    """
    every = every_hours * 3600 * _SECOND
    run = F.floor(F.unix_micros("seen_at") / F.lit(every)) * every
    timed = stream.select("external_id", F.col("seen_at").cast("timestamp").alias("seen_at")).withWatermark("seen_at", delay)
    per_run = timed.withColumn("run_us", run)
    once = per_run.dropDuplicates(["external_id", "run_us"])
    rows = once.groupBy("external_id").applyInPandasWithState(
        _lifecycle(policy, every),
        "external_id string, run_us bigint, absences int, status string, since_us bigint",
        "seen bigint, told bigint",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )
    at = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    return rows.select("external_id", at("run_us").alias("run_at"), "absences", "status", at(F.nullif("since_us", F.lit(-1))).alias("missing_since"))


def _ranked(values: pd.Series) -> np.ndarray:
    """Numbers in the order of the values, missing ones last."""
    if pd.api.types.is_numeric_dtype(values):
        return values.to_numpy()
    codes = pd.factorize(values, sort=True)[0]
    return np.where(codes < 0, len(codes), codes)


def _cooldown(keys: list[str], ts: str, tiebreak: str, columns: list[str], cooldown: int, timed: bool):
    """Follows one key: the state is the time of its last kept alert."""

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        # Of alerts at one time only the first can be kept, so that is all that is held of a batch, as numbers
        # and without the key's own texts; the rows themselves are never sorted as a whole.
        own = {c: v for c, v in zip(keys, key) if isinstance(v, str)}
        rows = pd.concat(
            (b.drop(columns=list(own)).sort_values([ts, tiebreak]).drop_duplicates(ts) for b in batches), ignore_index=True)
        times = rows[ts].to_numpy().astype("datetime64[us]").astype("int64")
        order = np.lexsort((_ranked(rows[tiebreak]), times))
        times = times[order]
        first = np.append(True, times[1:] != times[:-1])
        times, order = times[first], order[first]
        last, picked = state.get[0] if state.exists else None, []
        at = 0 if last is None else int(times.searchsorted(last + cooldown))
        while at < len(times):
            picked.append(at)
            last = int(times[at])
            at = int(times.searchsorted(last + cooldown))
        if last is not None:
            state.update((last,))
            if timed:  # once no alert can come that this one holds back, it is forgotten
                state.setTimeoutTimestamp(max((last + cooldown) // 1000, state.getCurrentWatermarkMs()) + 1)
        if picked:
            yield rows.iloc[order[picked]].assign(**own)[columns]

    return follow


def cooldown_stream(
    stream: DataFrame, root: str, checkpoint: str, key: list[str], ts: str, tiebreak: str, minutes: int, delay: str | None = None
) -> StreamingQuery:
    """Cooldown over all batches: kept alerts go to the 'alerts' table under ``root``.

    Each key has one value in Spark's state store, the time of its last kept alert, which a restart from
    the checkpoint finds again. Alerts are taken in order of time within a batch; one that comes in a
    later batch than a kept one after it is held back by that. With ``delay`` the watermark drops alerts
    that are later than that and the state forgets keys that have been quiet for long enough. Alerts
    without a key or time are dropped.
    """
    alerts = stream.dropna(subset=[*key, ts])
    if delay is not None:
        alerts = alerts.withColumn("_event_time", F.col(ts).cast("timestamp")).withWatermark("_event_time", delay)
    follow = _cooldown(key, ts, tiebreak, stream.columns, minutes * 60 * _SECOND, delay is not None)
    timeout = GroupStateTimeout.NoTimeout if delay is None else GroupStateTimeout.EventTimeTimeout
    kept = alerts.groupBy(*key).applyInPandasWithState(follow, stream.schema, "last bigint", "append", timeout)
    return run_available(kept, f"{root}/alerts", checkpoint)


def kept_alerts(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/alerts")


def sync_stream(
    stream: DataFrame, root: str, checkpoint: str, run_of: Callable[[int], Run], details: DataFrame
) -> StreamingQuery:
    """Every micro-batch of cards as one run over the stored tables.

    ``run_of`` names the run of a batch number. The run's id is part of the commit, so a batch
    that Spark delivers again after a failure changes nothing.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        apply_run(batch.sparkSession, root, batch, details, run_of(batch_id))

    query = (
        stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query
