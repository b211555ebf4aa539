"""Registered queries that drive a stream over the whole events table and read its result."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..operators.lifecycle import AbsencePolicy, eligible_runs
from ..session import work_dir
from ..streaming import scopes, streams
from .bindings import RUNS, SIGHTINGS, runs, table, with_
from .ordered_queries import _LIFE, scope_json
from .registry import query
from .sync import Run, load_tables


def event_stream(spark, sf):
    return streams.read_stream(spark, sf, table(spark, sf, "events").schema, "events.parquet")


@query(
    "l1_sync_stream",
    """WITH c AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)
      SELECT CAST(user_id AS VARCHAR) AS external_id, CAST(value AS DECIMAL(12,2)) AS price, 'ACTIVE' AS status FROM c WHERE n = 1""",
)
def l1(spark, sf):
    root = work_dir(spark, "stream-inventory")
    cards = event_stream(spark, sf).select(
        F.col("user_id").cast("string").alias("external_id"), F.lit(1).alias("page"), F.col("event_id").alias("position"),
        F.col("value").cast("decimal(12,2)").alias("price"),
    )
    details = spark.createDataFrame([], "external_id string")
    run_of = lambda batch: Run(f"batch-{batch}", "src", datetime(2024, 1, 31))
    streams.sync_stream(cards, root, work_dir(spark, "cp"), run_of, details)
    return load_tables(spark, root, "src").listings.select("external_id", "price", "status")


@query(
    "l2_lifecycle_stream",
    with_(_LIFE.format(t=2, h=72))
    + """SELECT CAST(user_id AS VARCHAR) AS external_id, CAST(d AS TIMESTAMP) AS run_at, CAST(k AS INTEGER) AS absences, status,
      CASE WHEN k > 0 THEN CAST(since AS TIMESTAMP) END AS missing_since FROM life
      WHERE k = 0 OR d < (SELECT max(CAST(ts AS DATE)) FROM events)""",
)
def l2(spark, sf):
    seen = event_stream(spark, sf).select(
        F.col("user_id").cast("string").alias("external_id"), F.col("ts").cast("timestamp").alias("seen_at")
    )
    out, checkpoint = work_dir(spark, "life"), work_dir(spark, "cp")
    streams.run_available(streams.lifecycle_stream(seen, AbsencePolicy(2, 72)), out, checkpoint)
    return spark.read.parquet(out)


@query(
    "l2_lifecycle_by_scope",
    with_(RUNS)
    + """, seen AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS external_id, event_type AS source_key, event_type || '-' || CAST(ts AS DATE) AS run_id FROM events),
      islands AS (SELECT s.*, r.run_date AS d, r.scope_json AS scope,
        lead(r.run_date) OVER (PARTITION BY external_id, s.source_key ORDER BY r.run_date) AS nxt FROM seen s JOIN runs r USING (run_id)),
      absent AS (SELECT i.external_id, i.source_key, i.d, r.run_id, r.run_date,
          row_number() OVER (PARTITION BY i.external_id, i.source_key, i.d ORDER BY r.run_date) AS k,
          min(r.run_date) OVER (PARTITION BY i.external_id, i.source_key, i.d) AS since
        FROM islands i JOIN runs r ON r.source_key = i.source_key AND r.run_date > i.d AND (i.nxt IS NULL OR r.run_date < i.nxt)
          AND r.mode = 'full' AND r.status = 'success' AND r.scope_json = i.scope),
      judged AS (SELECT *, CASE WHEN k >= 2 AND (k >= 3 OR run_date >= since + INTERVAL 240 HOUR) THEN 'REMOVED' ELSE 'MISSING' END AS status FROM absent),
      upto AS (SELECT *, count(*) FILTER (status = 'REMOVED') OVER (PARTITION BY external_id, source_key, d ORDER BY k) AS gone FROM judged)
      SELECT source_key, external_id, run_id, CAST(k AS INTEGER) AS absences, status FROM upto WHERE status = 'MISSING' OR gone = 1
      UNION ALL SELECT source_key, external_id, run_id, 0, 'ACTIVE' FROM islands""",
)
def l2_scope(spark, sf):
    """Cards and run log come in as two streams in four deliveries; a run is closed at the end of its day."""
    log = eligible_runs(runs(spark, sf)).select(
        "source_key", "run_id", (F.col("run_date") + F.expr("INTERVAL 1 DAY")).cast("timestamp_ntz").alias("run_at"), "eligible",
        scope_json("scope").alias("scope_hash"),
    )
    seen = table(spark, sf, "events").select(
        F.col("event_type").alias("source_key"), F.col("user_id").cast("string").alias("external_id"),
        F.concat_ws("-", "event_type", F.to_date("ts").cast("string")).alias("run_id"), F.col("ts").alias("seen_at"),
    )
    fed = {name: work_dir(spark, name) for name in ("cards", "log")}
    out, checkpoint = work_dir(spark, "life"), work_dir(spark, "cp")
    # What lets the watermark pass the last day is a run of no source, long after it.
    end = log.agg((F.max("run_at") + F.expr("INTERVAL 10 DAYS")).alias("run_at")).select(
        F.lit("end").alias("source_key"), F.lit("end").alias("run_id"), "run_at", F.lit(False).alias("eligible"), F.lit(None).cast("string").alias("scope_hash"))
    for quarter in range(4):
        part = lambda at: F.least(F.floor((F.dayofmonth(at) - 1) / 8), F.lit(3)) == quarter
        # A delivery has as many files as tasks write it, and the stream takes it up where it stopped.
        seen.filter(part("seen_at")).write.mode("append").parquet(fed["cards"])
        log.filter(part(F.col("run_at") - F.expr("INTERVAL 1 DAY"))).coalesce(1).write.mode("append").parquet(fed["log"])
        if quarter == 3:
            end.coalesce(1).write.mode("append").parquet(fed["log"])
        life = scopes.scope_lifecycle(*(streams.read_stream(spark, fed[n], df.schema, "*.parquet") for n, df in (("cards", seen), ("log", log))), AbsencePolicy(3, 240), delay="1 day")
        scopes.run_scope_lifecycle(life, out, checkpoint)
    return spark.read.schema(life.schema).parquet(out).select("source_key", "external_id", "run_id", "absences", "status")


@query(
    "l3_cooldown_stream",
    """WITH RECURSIVE a AS (SELECT event_type AS key, event_id, ts FROM events),
      chain(key, ts) AS (SELECT key, min(ts) FROM a GROUP BY key
        UNION ALL SELECT c.key, (SELECT min(a.ts) FROM a WHERE a.key = c.key AND a.ts >= c.ts + INTERVAL 240 MINUTE) FROM chain c
        WHERE c.ts IS NOT NULL)
      SELECT a.key, a.event_id, a.ts FROM a JOIN chain USING (key, ts)""",
)
def l3(spark, sf):
    alerts = event_stream(spark, sf).select(F.col("event_type").alias("key"), "event_id", "ts")
    root = work_dir(spark, "alerts")
    streams.cooldown_stream(alerts, root, work_dir(spark, "cp"), ["key"], "ts", "event_id", 240)
    return streams.kept_alerts(spark, root)


@query(
    "l4_dedupe_stream",
    with_(SIGHTINGS) + "SELECT DISTINCT run_date, external_id FROM sightings",
)
def l4(spark, sf):
    cards = event_stream(spark, sf).select(
        F.col("user_id").cast("string").alias("external_id"), F.to_date("ts").alias("run_date"), F.col("ts").alias("seen_at")
    )
    out = work_dir(spark, "deduped")
    streams.run_available(streams.dedupe_stream(cards, ["run_date", "external_id"], "1 day"), out, work_dir(spark, "cp"))
    return spark.read.parquet(out).select("run_date", "external_id")
