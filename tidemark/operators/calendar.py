"""The calendar of crawls: slots due, slots missed, runs that overlap.

A job row has job_id, source_key, job_type, kind (daily, hours or interval), hour, hours,
interval_minutes, offset_minutes and jitter_minutes. Times are local wall-clock times without a
zone; ``to_utc`` turns them into instants.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import stable_bucket

ZONE = "America/Sao_Paulo"
DEFAULT_HOUR = 2
_MINUTE = 60_000_000
_DAY = 24 * 60 * _MINUTE


def jitter(job_id: str, max_minutes: int) -> Column:
    """Minutes by which a job is shifted, the same on every run."""
    return stable_bucket(job_id, max(0, max_minutes)).cast("int")


def _micros(c: Column) -> Column:
    return F.unix_micros(F.from_utc_timestamp(c.cast("timestamp"), F.current_timezone()))


def _local(micros: Column) -> Column:
    return F.to_utc_timestamp(F.timestamp_micros(micros), F.current_timezone()).cast("timestamp_ntz")


def to_utc(c, zone: str = ZONE) -> Column:
    """A wall-clock time of a zone as the wall-clock time of UTC."""
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), c)


def _shift() -> Column:
    return (F.col("offset_minutes") + F.col("jitter_minutes")).cast("bigint") * _MINUTE


def _day_start(now: Column) -> Column:
    return F.floor(now / F.lit(_DAY)) * _DAY


def _hour_start(now: Column) -> Column:
    return F.floor(now / F.lit(60 * _MINUTE)) * (60 * _MINUTE)


def _hours() -> Column:
    listed = F.array_distinct(F.transform("hours", lambda h: F.pmod(h, F.lit(24))))
    return F.when(F.size(F.coalesce("hours", F.array())) > 0, listed).otherwise(F.array(F.lit(DEFAULT_HOUR)))


def _hour_slots(now: Column, days: tuple[int, int]) -> Column:
    of_day = lambda d: F.transform(_hours(), lambda h: _day_start(now) + d * _DAY + h.cast("bigint") * 60 * _MINUTE + _shift())
    return F.concat(*[of_day(d) for d in days])


def _step() -> Column:
    return F.greatest(F.col("interval_minutes"), F.lit(1)).cast("bigint") * _MINUTE


def next_occurrence(jobs: DataFrame, now: str = "now") -> DataFrame:
    """Adds ``next_run_at``: the first slot after ``now``."""
    t = _micros(F.col(now))
    today = _day_start(t) + F.col("hour").cast("bigint") * 60 * _MINUTE + _shift()
    daily = F.when(today > t, today).otherwise(today + _DAY)
    later = F.array_min(F.filter(_hour_slots(t, (0, 1)), lambda s: s > t))
    from_hours = F.coalesce(later, t + 4 * 60 * _MINUTE + _shift())
    anchor = _hour_start(t) + F.col("offset_minutes").cast("bigint") * _MINUTE
    steps = F.when(anchor > t, F.lit(0)).otherwise(F.floor((t - anchor) / _step()) + 1)
    interval = anchor + steps * _step() + F.col("jitter_minutes").cast("bigint") * _MINUTE
    return jobs.withColumn("next_run_at", _local(_by_kind(daily, from_hours, interval)))


def previous_occurrence(jobs: DataFrame, now: str = "now") -> DataFrame:
    """Adds ``previous_run_at``: the latest slot not after ``now``."""
    t = _micros(F.col(now))
    today = _day_start(t) + F.col("hour").cast("bigint") * 60 * _MINUTE + _shift()
    daily = F.when(today <= t, today).otherwise(today - _DAY)
    from_hours = F.coalesce(F.array_max(F.filter(_hour_slots(t, (0, -1)), lambda s: s <= t)), t - _DAY)
    anchor = _hour_start(t) + _shift()
    interval = anchor + F.floor((t - anchor) / _step()) * _step()
    return jobs.withColumn("previous_run_at", _local(_by_kind(daily, from_hours, interval)))


def _by_kind(daily: Column, hours: Column, interval: Column) -> Column:
    kind = F.col("kind")
    return F.when(kind == "daily", daily).when(kind == "hours", hours).when(kind == "interval", interval)


def expected_occurrences(jobs: DataFrame, start: str, end: str, zone: str = ZONE) -> DataFrame:
    """Every slot of every job from ``start`` up to but not at ``end``, local and in UTC."""
    lo, hi = (_micros(F.expr(f"TIMESTAMP_NTZ '{t}'")) for t in (start, end))
    # A slot may lie days from the midnight it is counted from, through its offset.
    days = F.sequence(
        _day_start(lo - F.greatest(_shift(), F.lit(0))) - F.lit(_DAY), hi - F.least(_shift(), F.lit(0)), F.lit(_DAY)
    )
    hours = F.when(F.col("kind") == "daily", F.array("hour")).otherwise(_hours())
    by_day = F.flatten(
        F.transform(days, lambda d: F.transform(hours, lambda h: d + h.cast("bigint") * 60 * _MINUTE + _shift()))
    )
    anchor = _hour_start(lo) + _shift()
    first = anchor + F.ceil((lo - anchor) / _step()) * _step()
    by_step = F.when(first < hi, F.sequence(first, hi, _step()))
    slots = F.when(F.col("kind") == "interval", by_step).otherwise(by_day)
    inside = F.array_distinct(F.filter(slots, lambda s: (s >= lo) & (s < hi)))
    return (
        jobs.select("job_id", "source_key", "job_type", F.explode(inside).alias("_slot"))
        .withColumn("local_at", _local(F.col("_slot")))
        .withColumn("scheduled_at", to_utc(F.col("local_at"), zone))
        .drop("_slot")
    )


def occurrence_status(occurrences: DataFrame, runs: DataFrame, now: str, grace_minutes: int) -> DataFrame:
    """Adds ``state``: not due, misfired, already started, or due."""
    from .joins import already_started

    t = F.expr(f"TIMESTAMP_NTZ '{now}'")
    late = t > F.col("scheduled_at") + F.make_dt_interval(mins=F.lit(grace_minutes))
    # Whether a run began matters only for slots that are neither to come nor late.
    open_ = occurrences.filter((F.col("scheduled_at") <= t) & ~late)
    begun = already_started(open_, runs, grace_minutes).select("job_id", "scheduled_at").withColumn("_begun", F.lit(True))
    return (
        occurrences.join(begun.distinct(), ["job_id", "scheduled_at"], "left")
        .withColumn(
            "state",
            F.when(F.col("scheduled_at") > t, "not_due")
            .when(late, "misfired")
            .when(F.col("_begun"), "already_started")
            .otherwise("due"),
        )
        .drop("_begun")
    )


def overlapping_runs(runs: DataFrame) -> DataFrame:
    """Full runs waiting or running beside another of the same source, provider and scope."""
    open_ = runs.filter((F.col("mode") == "full") & F.col("status").isin("pending", "running"))
    same = ["source_key", "provider_key", "scope_json"]
    return (
        open_.groupBy(*same)
        .agg(F.count("*").alias("open_runs"), F.min("run_id").alias("first_run"), F.max("run_id").alias("last_run"))
        .filter("open_runs > 1")
    )
