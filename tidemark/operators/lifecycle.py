"""What being absent from runs does to a listing over time."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


@dataclass(frozen=True)
class AbsencePolicy:
    """When a missing entry counts as removed: by number of absences or by hours."""

    threshold: int = 2
    removal_hours: int = 72


def absence_status(absences: Column, run_at: Column, missing_since: Column, policy: AbsencePolicy) -> Column:
    """Status after a number of absences in a row; the first one never removes."""
    late = run_at >= missing_since + F.expr(f"INTERVAL {policy.removal_hours} HOURS")
    return (
        F.when(absences == 0, "ACTIVE")
        .when((absences >= 2) & ((absences >= policy.threshold) | late), "REMOVED")
        .otherwise("MISSING")
    )


def eligible_runs(runs: DataFrame) -> DataFrame:
    """Runs whose silence counts: full and successful. Adds ``eligible``."""
    return runs.withColumn("eligible", F.coalesce((F.col("mode") == "full") & (F.col("status") == "success"), F.lit(False)))


def _ranked(log: DataFrame, moments: DataFrame, key: list[str]) -> DataFrame:
    """Runs and moments with ``_before``: how many eligible runs of their source and scope precede them,
    and ``_total``, how many there are.

    ``moments`` has the key, _at and _tie; its rows come back without a run_id. The running count
    goes by months, then over the months' totals, so no task numbers a whole run log.
    """
    runs = log.select(*key, "_at", "_tie", "run_id", F.col("eligible").cast("int").alias("_n"))
    each = runs.unionByName(moments.distinct().withColumn("_n", F.lit(0)), allowMissingColumns=True)
    each = each.withColumn("_month", F.date_trunc("month", "_at"))
    month = [*key, "_month"]
    totals = each.groupBy(*month).agg(F.sum("_n").alias("_in_month"))
    months = W.partitionBy(*key).orderBy("_month")
    earlier, all_ = months.rowsBetween(W.unboundedPreceding, -1), months.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    totals = totals.select(
        *month, F.coalesce(F.sum("_in_month").over(earlier), F.lit(0)).alias("_base"), F.sum("_in_month").over(all_).alias("_total")
    )
    inside = W.partitionBy(*month).orderBy("_at", "_tie", "_n").rowsBetween(W.unboundedPreceding, W.currentRow)
    counted = each.withColumn("_sum", F.sum("_n").over(inside))
    return counted.join(totals, month).select(
        *key, "_at", "_tie", "run_id", "_n", "_total", (F.col("_base") + F.col("_sum") - F.col("_n")).alias("_before")
    )


def _starts(log: DataFrame, key: list[str], policy: AbsencePolicy) -> tuple[DataFrame, DataFrame]:
    """What follows a sighting in each run, and the eligible runs by rank.

    The absence numbered n after a sighting is the eligible run of rank ``_first`` + n; ``_total`` is
    the last rank, ``_since`` the time of the first absence and ``_removal`` the number of the
    absence that removes.
    """
    late = F.col("_at") + F.expr(f"INTERVAL {policy.removal_hours} HOURS")
    ranked = _ranked(log, log.filter("eligible").select(*key, late.alias("_at"), F.lit("").alias("_tie")), key)
    runs = ranked.filter("run_id IS NOT NULL")
    steps = runs.filter("_n = 1").select(*key, (F.col("_before") + 1).alias("_rank"), "run_id", F.col("_at").alias("run_at"))
    expiry = ranked.filter("run_id IS NULL").select(*key, F.col("_at").alias("_late_at"), F.col("_before").alias("_late"))
    absent_at = runs.filter("_n = 1").select(
        *key, (F.col("_before") + 1).alias("_rank"), F.col("_at").alias("_since"), late.alias("_late_at")
    ).join(expiry, [*key, "_late_at"])
    first = F.col("_before") + F.col("_n")
    starts = runs.withColumn("_first", first).withColumn("_rank", first + 1).join(
        absent_at.drop("_late_at"), [*key, "_rank"], "left"
    )
    removal = F.greatest(F.lit(2), F.least(F.lit(policy.threshold), F.col("_late") + 1 - F.col("_first")))
    starts = starts.select(
        *key, "_at", "_tie", "run_id", "_n", "_first", "_total", "_since", removal.alias("_removal")
    )
    return starts, steps


def _spans(
    sightings: DataFrame, runs: DataFrame, entity: list[str], source: list[str], policy: AbsencePolicy
) -> tuple[DataFrame, DataFrame]:
    """One row per sighting run of an entity with the number of absences that follow it, and the
    eligible runs by rank.

    Absences after a sighting are the eligible runs of its scope up to the next sighting, so their
    number is a difference of ranks. Only where the next sighting is of another scope, its place
    among the runs of this one is looked up.
    """
    key = [*source, "_scope"]
    log = runs.select(
        *source, "run_id", F.col("run_at").alias("_at"), F.concat(F.lit("r"), "run_id").alias("_tie"),
        F.coalesce("eligible", F.lit(False)).alias("eligible"),
        F.coalesce(F.concat(F.lit("s"), "scope_hash"), F.lit("")).alias("_scope"),
    )
    starts, steps = _starts(log, key, policy)
    fields = ["_at", "_tie", "run_id", "_n", "_scope", "_first", "_total", "_since", "_removal"]
    seen = (
        sightings.select(*entity, *source, "run_id")
        .join(starts, [*source, "run_id"])
        .groupBy(*entity, *source)
        .agg(F.array_sort(F.collect_set(F.struct(*fields))).alias("_seen"))
    )
    pairs = F.transform("_seen", lambda s, i: F.struct(s.alias("on"), F.get("_seen", i + 1).alias("to")))
    spans = seen.select(*entity, *source, F.explode(pairs).alias("_p")).select(
        *entity, *source, "_p.on.*",
        F.when(F.col("_p.to").isNull(), F.col("_p.on._total"))
        .when(F.col("_p.to._scope") == F.col("_p.on._scope"), F.col("_p.to._first") - F.col("_p.to._n"))
        .alias("_same"),
        F.col("_p.to._at").alias("_to"), F.col("_p.to._tie").alias("_to_tie"),
    )
    elsewhere = spans.filter("_same IS NULL").select(*key, F.col("_to").alias("_at"), F.col("_to_tie").alias("_tie"))
    ends = _ranked(log, elsewhere, key).filter("run_id IS NULL").select(
        *key, F.col("_at").alias("_to"), F.col("_tie").alias("_to_tie"), F.col("_before").alias("_other")
    )
    spans = spans.join(ends, [*key, "_to", "_to_tie"], "left").select(
        *entity, *key, "run_id", F.col("_at").alias("run_at"), "_first", "_since", "_removal",
        (F.coalesce("_same", "_other") - F.col("_first")).alias("_absences"),
    )
    return spans, steps


def _rows(spans: DataFrame, steps: DataFrame, entity: list[str], source: list[str], numbers: Column) -> DataFrame:
    """The runs in which a span has reached the given numbers of absences, with the status then."""
    key = [*source, "_scope"]
    rows = spans.withColumn("absences", F.explode(numbers)).withColumn("_rank", F.col("_first") + F.col("absences"))
    runs = steps.select(*key, "_rank", F.col("run_id").alias("_run_id"), F.col("run_at").alias("_run_at"))
    rows = rows.join(runs, [*key, "_rank"], "left")
    missed = F.col("absences") > 0
    return rows.select(
        *entity,
        *source,
        F.when(missed, F.col("_run_id")).otherwise(F.col("run_id")).alias("run_id"),
        F.when(missed, F.col("_run_at")).otherwise(F.col("run_at")).alias("run_at"),
        F.col("absences").cast("int").alias("absences"),
        F.when(~missed, "ACTIVE").when(F.col("absences") >= F.col("_removal"), "REMOVED").otherwise("MISSING").alias("status"),
        F.when(missed, F.col("_since")).alias("missing_since"),
    )


def absence_lifecycle(
    sightings: DataFrame, runs: DataFrame, entity: list[str], source: list[str] = (), policy: AbsencePolicy = AbsencePolicy()
) -> DataFrame:
    """Status of every entity after every run that sighted it or could have missed it.

    ``sightings`` has the entity, the source columns and run_id; ``runs`` has the source columns,
    run_id, run_at, eligible and scope_hash. A sighting in any run starts anew; a run after it
    counts as an absence if it is eligible and its scope equals that of the sighting.

    This is one row per entity and run; ``status_changes`` and ``status_counts`` say the same in
    as many rows as there is news, and without the grid at all.
    """
    source = list(source)
    spans, steps = _spans(sightings, runs, entity, source, policy)
    return _rows(spans, steps, entity, source, F.sequence(F.lit(0).cast("bigint"), F.col("_absences")))


def status_changes(
    sightings: DataFrame, runs: DataFrame, entity: list[str], source: list[str] = (), policy: AbsencePolicy = AbsencePolicy()
) -> DataFrame:
    """The runs after which an entity's status is another than before, its first sighting included."""
    source = list(source)
    spans, steps = _spans(sightings, runs, entity, source, policy)
    before = F.lag("_absences").over(W.partitionBy(*entity, *source).orderBy("run_at", "run_id"))
    spans = spans.withColumn("_back", before.isNull() | (before > 0))
    news = F.array_compact(F.array(
        F.when(F.col("_back"), F.lit(0).cast("bigint")),
        F.when(F.col("_absences") >= 1, F.lit(1).cast("bigint")),
        F.when(F.col("_absences") >= F.col("_removal"), F.col("_removal")),
    ))
    return _rows(spans, steps, entity, source, news)


def status_counts(
    sightings: DataFrame, runs: DataFrame, entity: list[str], source: list[str] = (), policy: AbsencePolicy = AbsencePolicy()
) -> DataFrame:
    """How many entity runs and entities of each source had each status, without a row for any."""
    source = list(source)
    spans, _ = _spans(sightings, runs, entity, source, policy)
    missing = F.least(F.col("_absences"), F.coalesce(F.col("_removal") - 1, F.lit(0)))
    counts = F.array(*[
        F.struct(F.lit(status).alias("status"), n.cast("bigint").alias("n"))
        for status, n in (("ACTIVE", F.lit(1)), ("MISSING", missing), ("REMOVED", F.col("_absences") - missing))
    ])
    return (
        spans.select(*entity, *source, F.explode(counts).alias("_c"))
        .filter("_c.n > 0")
        .groupBy(*source, F.col("_c.status").alias("status"))
        .agg(F.sum("_c.n").alias("entity_runs"), F.count_distinct(*entity).alias("entities"))
    )
