"""Registered queries over ordered pages, runs, prices, alerts and the calendar."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calendar, joins, lifecycle, ordered
from ..functions.hashing import scope_json
from .bindings import PAGE_LOG, RUNS, SIGHTINGS, page_log, runs, sightings, spread, table, with_
from .registry import query
from .sqltext import sql_untracked

# Crawls of one event type a day, with the mishaps that stop a crawl worked into them.
CRAWL = """crawl_cards AS (
  SELECT event_type || '-' || CAST(ts AS DATE) AS run_id, event_type, CAST(hour(ts) + 1 AS INTEGER) AS page,
    event_id AS position, CASE WHEN event_type = 'purchase' THEN '' || (user_id // 40)
      WHEN event_type = 'view' AND hour(ts) > 6 THEN '1' ELSE '' || user_id END AS external_id,
    CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events WHERE NOT (event_type = 'signup' AND hour(ts) IN (9, 10))),
crawl_pages AS (
  SELECT run_id, any_value(event_type) AS event_type, page,
    CASE WHEN event_type = 'signup' AND page > 9 THEN '/s/3' ELSE '/s/' || page END AS url,
    CASE WHEN event_type = 'signup' THEN '/s/' || (page + 1) END AS next_url,
    CASE WHEN dayofweek(CAST(right(run_id, 10) AS DATE)) IN (0, 6) THEN 'delta' ELSE 'full' END AS mode,
    CASE WHEN event_type = 'click' AND max(k) > 95 THEN 404 WHEN event_type = 'error' AND max(k) > 97 THEN 429 ELSE 200 END AS http_status,
    event_type = 'error' AND min(k) = 0 AS parse_failed, count(*) AS raw_cards,
    count(*) FILTER (event_type = 'click' AND k < 20) AS invalid_cards, CAST(NULL AS INTEGER) AS reported_total
  FROM crawl_cards GROUP BY run_id, event_type, page
  UNION ALL SELECT run_id, 'signup', 10, '/s/10', '/s/11', mode, 200, false, 0, 0, total FROM (
    SELECT 'signup-' || CAST(ts AS DATE) AS run_id, CASE WHEN dayofweek(CAST(ts AS DATE)) IN (0, 6) THEN 'delta' ELSE 'full' END AS mode,
      CASE WHEN count(*) > 330 THEN 500 WHEN count(*) > 40 AND count(*) % 2 = 0 THEN 7 END AS total
    FROM events GROUP BY CAST(ts AS DATE)))"""


def crawl_cards(spark, sf):
    kind, hour = F.col("event_type"), F.hour("ts")
    return (
        table(spark, sf, "events")
        .filter(~((kind == "signup") & hour.isin(9, 10)))
        .select(
            F.concat_ws("-", kind, F.to_date("ts").cast("string")).alias("run_id"),
            kind,
            F.to_date("ts").alias("run_date"),
            (hour + 1).alias("page"),
            F.col("event_id").alias("position"),
            F.when(kind == "purchase", F.expr("user_id div 40"))
            .when((kind == "view") & (hour > 6), 1)
            .otherwise(F.col("user_id"))
            .cast("string")
            .alias("external_id"),
            F.get_json_object("props", "$.k").cast("int").alias("k"),
        )
    )


def crawl_pages(spark, sf):
    kind, k, page = F.col("event_type"), F.col("k"), F.col("page")
    mode = F.when(F.dayofweek("run_date").isin(1, 7), "delta").otherwise("full").alias("mode")
    pages = crawl_cards(spark, sf).groupBy("run_id", "event_type", "run_date", "page").agg(
        F.max("k").alias("hi"), F.min("k").alias("lo"), F.count("*").alias("raw_cards"),
        F.count_if((kind == "click") & (k < 20)).alias("invalid_cards"),
    )
    signup = kind == "signup"
    real = pages.select(
        "run_id",
        page,
        F.concat(F.lit("/s/"), F.when(signup & (page > 9), 3).otherwise(page)).alias("url"),
        F.when(signup, F.concat(F.lit("/s/"), page + 1)).alias("next_url"),
        mode,
        F.when((kind == "click") & (F.col("hi") > 95), 404).when((kind == "error") & (F.col("hi") > 97), 429)
        .otherwise(200).alias("http_status"),
        ((kind == "error") & (F.col("lo") == 0)).alias("parse_failed"),
        "raw_cards",
        "invalid_cards",
        F.lit(None).cast("int").alias("reported_total"),
    )
    per_day = table(spark, sf, "events").groupBy(F.to_date("ts").alias("run_date")).agg(F.count("*").alias("n"))
    empty = per_day.select(
        F.concat(F.lit("signup-"), F.col("run_date").cast("string")).alias("run_id"),
        F.lit(10).alias("page"), F.lit("/s/10").alias("url"), F.lit("/s/11").alias("next_url"), mode,
        F.lit(200).alias("http_status"), F.lit(False).alias("parse_failed"), F.lit(0).alias("raw_cards"),
        F.lit(0).alias("invalid_cards"),
        F.when(F.col("n") > 330, 500).when((F.col("n") > 40) & (F.col("n") % 2 == 0), 7).alias("reported_total"),
    )
    return real.unionByName(empty)


NOVEL = """ids AS (SELECT DISTINCT run_id, page, external_id FROM crawl_cards WHERE external_id <> ''),
firsts AS (SELECT run_id, external_id, min(page) AS page FROM ids GROUP BY ALL),
novel AS (SELECT i.run_id, i.page, count(*) AS ids, count(f.page) AS novel,
    string_agg(i.external_id, ',' ORDER BY i.external_id) AS id_set
  FROM ids i LEFT JOIN firsts f USING (run_id, external_id, page) GROUP BY ALL),
streaks AS (SELECT *, sum(novel) OVER w AS ids_upto, row_number() OVER w AS n FROM novel
  WINDOW w AS (PARTITION BY run_id ORDER BY page)),
stale AS (SELECT *, n - coalesce(max(CASE WHEN novel > 0 THEN n END) OVER
    (PARTITION BY run_id ORDER BY page ROWS UNBOUNDED PRECEDING), 0) AS stale_streak FROM streaks)"""

_STOP = """
, log AS (SELECT p.*, coalesce(s.ids, 0) AS ids, s.novel, s.stale_streak, s.ids_upto,
    coalesce(s.id_set = q.id_set, false) AS repeated, min(p.page) OVER (PARTITION BY p.run_id, p.url) < p.page AS visited,
    v.next_url IS NOT NULL AS by_link,
    sum(p.invalid_cards) OVER w / greatest(sum(p.raw_cards) OVER w, 1) > 0.25 AS over_limit
  FROM crawl_pages p LEFT JOIN stale s USING (run_id, page) LEFT JOIN novel q ON q.run_id = p.run_id AND q.page = p.page - 1
  LEFT JOIN crawl_pages v ON v.run_id = p.run_id AND v.page = p.page - 1
  WINDOW w AS (PARTITION BY p.run_id ORDER BY p.page ROWS UNBOUNDED PRECEDING)),
reasons AS (SELECT *, CASE WHEN visited AND by_link THEN 'repeated_next_url' WHEN visited THEN 'repeated_listing_url'
    WHEN http_status = 404 AND page > 1 THEN 'http_404' WHEN http_status >= 400 THEN 'http_' || http_status
    WHEN parse_failed THEN 'parse_error' WHEN over_limit THEN 'invalid_card_rate'
    WHEN ids = 0 AND reported_total > 0 THEN 'reported_total_without_cards' WHEN ids = 0 THEN 'no_cards'
    WHEN page > 1 AND repeated THEN 'repeated_page'
    WHEN page > 1 AND novel = 0 AND stale_streak >= CASE WHEN mode = 'full' THEN 1 ELSE 3 END THEN 'no_new_external_ids'
    WHEN novel > 0 AND ids_upto >= 30 THEN 'limit' END AS reason FROM log)
SELECT run_id, min(page) FILTER (reason IS NOT NULL) AS stop_page,
  arg_min(reason, page) FILTER (reason IS NOT NULL) AS stopped_reason,
  coalesce(arg_min(reason IN ('no_cards', 'limit') OR (reason = 'http_404' AND page > 1) OR (mode = 'delta' AND reason IN
    ('repeated_page', 'no_new_external_ids')), page) FILTER (reason IS NOT NULL), true) AS completed,
  coalesce(arg_min(CASE WHEN reason LIKE 'repeated%url' OR reason LIKE 'http_%' THEN page - 1 ELSE page END, page)
    FILTER (reason IS NOT NULL), max(page))::BIGINT AS pages_fetched
FROM reasons GROUP BY run_id"""


@query("f1_crawl_stop_reason", with_(CRAWL, NOVEL) + _STOP)
def f1(spark, sf):
    return ordered.crawl_stop_reason(crawl_pages(spark, sf), crawl_cards(spark, sf), ["run_id"], limit=30)


@query(
    "f2_cumulative_invalid_rate",
    with_(SIGHTINGS, PAGE_LOG)
    + """SELECT run_id, page, sum(invalid_cards) OVER w::DOUBLE / sum(raw_cards) OVER w AS rate,
        sum(invalid_cards) OVER w / sum(raw_cards) OVER w > 0.25 AS over_limit FROM page_log
      WINDOW w AS (PARTITION BY run_id ORDER BY page ROWS UNBOUNDED PRECEDING)""",
)
def f2(spark, sf):
    return ordered.cumulative_invalid_rate(page_log(spark, sf), ["run_id"]).select("run_id", "page", "rate", "over_limit")


@query(
    "f3_repeated_page",
    with_(CRAWL, NOVEL)
    + """SELECT n.run_id, n.page, n.ids, coalesce(n.id_set = p.id_set, false) AS repeated FROM novel n
      LEFT JOIN novel p ON p.run_id = n.run_id AND p.page = n.page - 1""",
)
def f3(spark, sf):
    return ordered.repeated_page(crawl_cards(spark, sf), ["run_id"])


@query(
    "f4_novel_ids",
    with_(CRAWL, NOVEL) + "SELECT run_id, page, ids, novel, CAST(ids_upto AS BIGINT) AS ids_upto, stale_streak FROM stale",
)
def f4(spark, sf):
    return ordered.novel_ids(crawl_cards(spark, sf), ["run_id"])


def daily_runs(spark, sf):
    """One full run a day over all cards; ``run_at`` is the day's start."""
    days = sightings(spark, sf).groupBy("run_date").agg(F.count("*").alias("n"))
    return days.select(
        F.col("run_date").cast("string").alias("run_id"),
        F.col("run_date").cast("timestamp_ntz").alias("run_at"),
        F.lit(True).alias("eligible"),
        F.lit(None).cast("string").alias("scope_hash"),
    )


def daily_seen(spark, sf):
    return sightings(spark, sf).select("external_id", F.col("run_date").cast("string").alias("run_id"))


_LIFE = """s AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d FROM events),
      grid AS (SELECT u.user_id, r.d, s.d IS NOT NULL AS seen FROM (SELECT user_id, min(d) AS f FROM s GROUP BY 1) u
        JOIN (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events) r ON r.d >= u.f LEFT JOIN s ON s.user_id = u.user_id AND s.d = r.d),
      islands AS (SELECT *, sum(CAST(seen AS INTEGER)) OVER (PARTITION BY user_id ORDER BY d) AS island FROM grid),
      counted AS (SELECT *, row_number() OVER w - 1 AS k, nth_value(d, 2) OVER (PARTITION BY user_id, island ORDER BY d
        ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS since FROM islands
        WINDOW w AS (PARTITION BY user_id, island ORDER BY d)),
      life AS (SELECT *, CASE WHEN k = 0 THEN 'ACTIVE' WHEN k >= 2 AND (k >= {t} OR d >= since + INTERVAL {h} HOUR) THEN 'REMOVED'
        ELSE 'MISSING' END AS status FROM counted)"""


@query(
    "f5_absence_lifecycle",
    with_(_LIFE.format(t=2, h=72)) + "SELECT status, count(*) AS entity_runs, count(DISTINCT user_id) AS entities FROM life GROUP BY status",
)
def f5(spark, sf):
    return lifecycle.status_counts(daily_seen(spark, sf), daily_runs(spark, sf), ["external_id"])


@query(
    "f5_status_changes",
    with_(_LIFE.format(t=2, h=72))
    + """SELECT CAST(user_id AS VARCHAR) AS external_id, CAST(d AS VARCHAR) AS run_id, CAST(k AS INTEGER) AS absences, status
      FROM (SELECT *, lag(status) OVER (PARTITION BY user_id ORDER BY d) AS was FROM life) WHERE status IS DISTINCT FROM was""",
)
def f5_changes(spark, sf):
    life = lifecycle.status_changes(daily_seen(spark, sf), daily_runs(spark, sf), ["external_id"])
    return life.select("external_id", "run_id", "absences", "status")


@query(
    "f5_lifecycle_rows",
    with_(_LIFE.format(t=9, h=48))
    + """SELECT CAST(user_id AS VARCHAR) AS external_id, CAST(d AS VARCHAR) AS run_id, CAST(k AS INTEGER) AS absences, status,
      CASE WHEN k > 0 THEN CAST(since AS TIMESTAMP) END AS missing_since FROM life""",
)
def f5_rows(spark, sf):
    policy = lifecycle.AbsencePolicy(threshold=9, removal_hours=48)
    life = lifecycle.absence_lifecycle(daily_seen(spark, sf), daily_runs(spark, sf), ["external_id"], policy=policy)
    return life.select("external_id", "run_id", "absences", "status", "missing_since")


@query(
    "f5_lifecycle_by_scope",
    with_(RUNS)
    + """, seen AS (SELECT DISTINCT user_id, event_type AS source_key, event_type || '-' || CAST(ts AS DATE) AS run_id FROM events),
      islands AS (SELECT s.*, r.run_date AS d, r.scope_json AS scope,
        lead(r.run_date) OVER (PARTITION BY user_id, s.source_key ORDER BY r.run_date) AS nxt
        FROM seen s JOIN runs r USING (run_id)),
      absent AS (SELECT i.user_id, i.source_key, i.d, r.run_id, r.run_date,
          row_number() OVER (PARTITION BY i.user_id, i.source_key, i.d ORDER BY r.run_date) AS k,
          min(r.run_date) OVER (PARTITION BY i.user_id, i.source_key, i.d) AS since
        FROM islands i JOIN runs r ON r.source_key = i.source_key AND r.run_date > i.d AND (i.nxt IS NULL OR r.run_date < i.nxt)
          AND r.mode = 'full' AND r.status = 'success' AND r.scope_json = i.scope)
      SELECT source_key, status, count(*) AS n FROM (
        SELECT source_key, CASE WHEN k >= 2 AND (k >= 3 OR run_date >= since + INTERVAL 240 HOUR) THEN 'REMOVED' ELSE 'MISSING' END AS status
        FROM absent UNION ALL SELECT source_key, 'ACTIVE' FROM islands) GROUP BY ALL""",
)
def f5_scope(spark, sf):
    log = lifecycle.eligible_runs(runs(spark, sf)).select(
        "run_id", "source_key", F.col("run_date").cast("timestamp_ntz").alias("run_at"), "eligible",
        scope_json("scope").alias("scope_hash"),
    )
    seen = table(spark, sf, "events").select(
        F.col("user_id").alias("external_id"),
        F.col("event_type").alias("source_key"),
        F.concat_ws("-", "event_type", F.to_date("ts").cast("string")).alias("run_id"),
    )
    counts = lifecycle.status_counts(
        seen, log, ["external_id"], ["source_key"], lifecycle.AbsencePolicy(threshold=3, removal_hours=240)
    )
    return counts.select("source_key", "status", F.col("entity_runs").alias("n"))


@query(
    "f6_last_full_count",
    with_(RUNS)
    + """, o AS (SELECT *, row_number() OVER (PARTITION BY source_key ORDER BY finished_at ASC NULLS FIRST, run_id) AS n FROM runs),
      g AS (SELECT *, row_number() OVER (PARTITION BY source_key ORDER BY n) AS gn FROM o WHERE mode = 'full' AND status = 'success')
      SELECT o.run_id, (SELECT arg_max(g.listings_seen, g.n) FROM g WHERE g.source_key = o.source_key AND g.n < o.n
        AND g.scope_json = o.scope_json AND g.gn > (SELECT count(*) FROM g h WHERE h.source_key = o.source_key AND h.n < o.n) - 3)
        AS previous_count FROM o""",
)
def f6(spark, sf):
    log = runs(spark, sf).withColumn("scope_json", scope_json("scope"))
    return ordered.last_full_count(log, lookback=3).select("run_id", "previous_count")


def price_events(spark, sf):
    return table(spark, sf, "events").select(
        F.col("user_id").alias("listing_id"),
        F.when(F.col("event_type") == "signup", "CREATED").when(F.col("event_type") == "purchase", "PRICE_CHANGED")
        .otherwise("CONTENT_CHANGED").alias("event_type"),
        F.col("ts").alias("detected_at"),
        F.col("event_id").alias("seq"),
        F.to_json(F.struct(
            F.when(F.col("value") > 20, F.col("value").cast("decimal(12,2)").cast("string")).alias("price"),
            F.when(F.col("event_id") % 2 == 0, "SALE").otherwise("RENT").alias("purpose"),
        )).alias("new_value"),
    )


@query(
    "f7_price_history",
    """SELECT user_id AS listing_id, CASE WHEN event_id % 2 = 0 THEN 'SALE' ELSE 'RENT' END AS purpose, ts AS detected_at,
      event_id AS seq, CAST(value AS DECIMAL(12,2)) AS price FROM events WHERE event_type IN ('signup', 'purchase') AND value > 20
      AND user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""",
)
def f7(spark, sf):
    wanted = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("listing_id"))
    return ordered.price_history(price_events(spark, sf), wanted, by_purpose=True)


@query(
    "f8_price_changes",
    with_(SIGHTINGS)
    + """, once AS (SELECT external_id, norm_purpose, run_date, price FROM sightings
        QUALIFY row_number() OVER (PARTITION BY external_id, norm_purpose, run_date ORDER BY page, position) = 1),
      moved AS (SELECT *, lag(price) OVER w AS old_price, row_number() OVER w AS n FROM once
        WINDOW w AS (PARTITION BY external_id, norm_purpose ORDER BY run_date))
      SELECT external_id, norm_purpose AS purpose, run_date, old_price, price AS new_price FROM moved
      WHERE n > 1 AND price IS DISTINCT FROM old_price""",
)
def f8(spark, sf):
    return ordered.price_changes(sightings(spark, sf), ["external_id"], "run_date", ["page", "position"])


@query(
    "f9_positions",
    f"""SELECT page_id, url, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) AS INTEGER) AS position FROM (
      SELECT page_id, arg_min(url, pos) AS url, min(pos) AS pos FROM (SELECT page_id, {sql_untracked('href')} AS url, pos FROM (
        SELECT page_id, unnest(h) AS href, generate_subscripts(h, 1) AS pos FROM (
          SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS h FROM pages)))
      WHERE url <> '' GROUP BY page_id, lower(url))""",
)
def f9(spark, sf):
    hrefs = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))
    return ordered.positions(table(spark, sf, "pages"), ["page_id"], hrefs)


@query(
    "f10_cooldown_suppress",
    """WITH RECURSIVE a AS (SELECT event_type AS key, event_id, ts FROM events),
      chain(key, ts) AS (SELECT key, min(ts) FROM a GROUP BY key
        UNION ALL SELECT c.key, (SELECT min(a.ts) FROM a WHERE a.key = c.key AND a.ts >= c.ts + INTERVAL 90 MINUTE) FROM chain c
        WHERE c.ts IS NOT NULL)
      SELECT a.key, a.event_id, a.ts FROM a JOIN chain USING (key, ts)""",
)
def f10(spark, sf):
    alerts = table(spark, sf, "events").select(F.col("event_type").alias("key"), "event_id", "ts")
    return ordered.cooldown_suppress(alerts, ["key"], "ts", 90, "event_id")


JOBS = """jobs AS (
  SELECT s_suppkey, 'job:' || s_name AS job_id, n_name AS source_key, CASE s_suppkey % 3 WHEN 0 THEN 'daily' WHEN 1 THEN 'hours'
      ELSE 'interval' END AS kind, CAST(s_nationkey % 24 AS INTEGER) AS hour,
    [CAST(s_nationkey % 24 AS INTEGER), 20, CAST(n_regionkey AS INTEGER)] AS hours,
    CAST(20 + s_nationkey * 5 AS INTEGER) AS interval_minutes, CAST(n_regionkey * 15 AS INTEGER) AS offset_minutes,
    CAST(CAST('0x' || substr(sha256('job:' || s_name), 1, 8) AS BIGINT) % 11 AS INTEGER) AS jitter_minutes,
    TIMESTAMP '2024-01-10 00:30:00' + to_minutes(CAST(s_suppkey * 17 % 1440 AS INTEGER)) AS now
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


def jobs(spark, sf):
    joined = spread(table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey")).join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return joined.withColumn("job_id", F.concat(F.lit("job:"), "s_name")).select(
        "job_id",
        F.col("n_name").alias("source_key"),
        F.lit("crawl").alias("job_type"),
        F.when(F.col("s_suppkey") % 3 == 0, "daily").when(F.col("s_suppkey") % 3 == 1, "hours").otherwise("interval").alias("kind"),
        (F.col("s_nationkey") % 24).alias("hour"),
        F.array(F.col("s_nationkey") % 24, F.lit(20), F.col("n_regionkey")).alias("hours"),
        (20 + F.col("s_nationkey") * 5).alias("interval_minutes"),
        (F.col("n_regionkey") * 15).alias("offset_minutes"),
        calendar.jitter("job_id", 10).alias("jitter_minutes"),
        (F.expr("TIMESTAMP_NTZ '2024-01-10 00:30:00'") + F.make_dt_interval(mins=(F.col("s_suppkey") * 17 % 1440).cast("int"))).alias("now"),
    )


_MIN = "to_minutes(offset_minutes + jitter_minutes)"
_DAYSLOT = f"date_trunc('day', now) + to_hours(hour) + {_MIN}"


@query(
    "f11_occurrences",
    with_(JOBS)
    + f""", c AS (SELECT *, {_DAYSLOT} AS day_slot,
        [date_trunc('day', now) + to_hours(h) + {_MIN} FOR h IN hours] AS today,
        date_trunc('hour', now) + to_minutes(offset_minutes) AS anchor FROM jobs)
      SELECT job_id,
        CASE kind WHEN 'daily' THEN CASE WHEN day_slot > now THEN day_slot ELSE day_slot + INTERVAL 1 DAY END
          WHEN 'hours' THEN list_min(list_filter(list_concat(today, [x + INTERVAL 1 DAY FOR x IN today]), lambda x: x > now))
          ELSE anchor + to_minutes(jitter_minutes + interval_minutes * CASE WHEN anchor > now THEN 0 ELSE
            CAST(floor((epoch_us(now) - epoch_us(anchor)) / (interval_minutes * 60000000.0)) + 1 AS BIGINT) END) END AS next_run_at,
        CASE kind WHEN 'daily' THEN CASE WHEN day_slot <= now THEN day_slot ELSE day_slot - INTERVAL 1 DAY END
          WHEN 'hours' THEN coalesce(list_max(list_filter(list_concat(today, [x - INTERVAL 1 DAY FOR x IN today]), lambda x: x <= now)), now - INTERVAL 1 DAY)
          ELSE anchor + to_minutes(jitter_minutes) + to_minutes(interval_minutes *
            CAST(floor((epoch_us(now) - epoch_us(anchor + to_minutes(jitter_minutes))) / (interval_minutes * 60000000.0)) AS BIGINT)) END AS previous_run_at
      FROM c""",
)
def f11(spark, sf):
    both = calendar.previous_occurrence(calendar.next_occurrence(jobs(spark, sf)))
    return both.select("job_id", "next_run_at", "previous_run_at")


_K1 = f"""slots AS (
  SELECT job_id, source_key, unnest(list_distinct(CASE WHEN kind = 'interval' THEN
      [x FOR x IN generate_series(TIMESTAMP '2024-01-01' - INTERVAL 10 DAY + {_MIN}, TIMESTAMP '2024-02-01', to_minutes(1))
       IF (epoch_us(x) - epoch_us(TIMESTAMP '2024-01-01' + {_MIN})) % (CAST(interval_minutes AS BIGINT) * 60000000) = 0]
    ELSE flatten([[d + to_hours(h) + {_MIN} FOR h IN CASE WHEN kind = 'daily' THEN [hour] ELSE hours END] FOR d IN
      generate_series(TIMESTAMP '2023-12-20', TIMESTAMP '2024-02-02', INTERVAL 1 DAY)]) END)) AS local_at FROM jobs),
occurrences AS (SELECT job_id, source_key, local_at, local_at + INTERVAL 3 HOUR AS scheduled_at FROM slots
  WHERE local_at >= TIMESTAMP '2024-01-01' AND local_at < TIMESTAMP '2024-01-31')"""


def occurrences(spark, sf):
    return calendar.expected_occurrences(jobs(spark, sf), "2024-01-01 00:00:00", "2024-01-31 00:00:00")


@query("k1_expected_occurrences", with_(JOBS, _K1) + "SELECT job_id, local_at, scheduled_at FROM occurrences")
def k1(spark, sf):
    return occurrences(spark, sf).select("job_id", "local_at", "scheduled_at")


_JOB_RUNS = """job_runs AS (SELECT n_name AS provider_key, CASE WHEN event_type = 'error' THEN 'probe' ELSE 'crawl' END AS job_name,
    ts AS created_at, 'job:' || s_name AS started_id
  FROM events LEFT JOIN supplier ON s_suppkey = user_id LEFT JOIN nation ON s_nationkey = n_nationkey)"""
_BEGUN = """begun AS (SELECT DISTINCT job_id, scheduled_at FROM occurrences JOIN job_runs ON provider_key = source_key
    AND job_name = 'crawl' AND started_id = job_id AND created_at BETWEEN scheduled_at AND scheduled_at + INTERVAL 32 MINUTE)"""


def job_runs(spark, sf):
    """Events as runs the calendar started: a user's event is a run of the like-numbered supplier's job,
    or, without such a supplier, a run that belongs to no job."""
    events, supplier, nation = (table(spark, sf, n) for n in ("events", "supplier", "nation"))
    joined = events.join(supplier, F.col("user_id") == F.col("s_suppkey"), "left").join(
        nation, F.col("s_nationkey") == F.col("n_nationkey"), "left"
    )
    return joined.select(
        F.col("n_name").alias("provider_key"),
        F.when(F.col("event_type") == "error", "probe").otherwise("crawl").alias("job_name"),
        F.col("ts").alias("created_at"),
        F.to_json(F.struct(F.concat(F.lit("job:"), "s_name").alias("schedule_job_id"))).alias("summary"),
    )


@query(
    "c9_already_started",
    with_(JOBS, _K1, _JOB_RUNS, _BEGUN) + "SELECT job_id, scheduled_at FROM begun",
)
def c9(spark, sf):
    return joins.already_started(occurrences(spark, sf), job_runs(spark, sf), 30).select("job_id", "scheduled_at")


@query(
    "k2_occurrence_status",
    with_(JOBS, _K1, _JOB_RUNS, _BEGUN)
    + """SELECT job_id, o.scheduled_at, CASE WHEN o.scheduled_at > TIMESTAMP '2024-01-20 12:00:00' THEN 'not_due'
        WHEN TIMESTAMP '2024-01-20 12:00:00' - o.scheduled_at > INTERVAL 6000 MINUTE THEN 'misfired'
        WHEN b.job_id IS NOT NULL THEN 'already_started' ELSE 'due' END AS state
      FROM occurrences o LEFT JOIN (SELECT DISTINCT job_id, scheduled_at FROM occurrences JOIN job_runs ON provider_key = source_key
        AND job_name = 'crawl' AND started_id = job_id AND created_at BETWEEN scheduled_at AND scheduled_at + INTERVAL 6002 MINUTE) b
      USING (job_id, scheduled_at)""",
)
def k2(spark, sf):
    return calendar.occurrence_status(occurrences(spark, sf), job_runs(spark, sf), "2024-01-20 12:00:00", 6000).select(
        "job_id", "scheduled_at", "state"
    )


@query(
    "k3_overlapping_runs",
    with_(RUNS)
    + """SELECT source_key, scope_json, count(*) AS open_runs, min(run_id) AS first_run, max(run_id) AS last_run FROM runs
      WHERE mode = 'full' AND status IN ('failed', 'running') GROUP BY ALL HAVING count(*) > 1""",
)
def k3(spark, sf):
    log = runs(spark, sf).withColumn("scope_json", scope_json("scope")).withColumn("provider_key", F.col("source_key"))
    log = log.replace({"failed": "pending"}, subset=["status"])
    return calendar.overlapping_runs(log).drop("provider_key")
