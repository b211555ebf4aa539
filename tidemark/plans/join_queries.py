"""Registered queries for joins and run figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins, metrics
from ..operators.snapshot import overlay_detail
from .bindings import OFFERS, PAGE_LOG, PHOTOS, RUNS, SIGHTINGS, offers, page_log, photos, runs, sightings, table, with_
from .dedup_queries import LAST_OFFERS, UNIQUE_PHOTOS, last_offers, unique_photos
from .registry import query


def order_rows(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("listing_id"),
        F.col("o_orderpriority").alias("source_key"),
        F.col("o_orderstatus"),
        F.col("o_orderdate"),
    )


@query(
    "c1_offers_with_listings",
    with_(OFFERS, LAST_OFFERS)
    + """SELECT listing_id, purpose, price FROM last_offers JOIN orders ON listing_id = CAST(o_orderkey AS VARCHAR)
      WHERE o_orderpriority = '2-HIGH' AND purpose IN ('SALE')""",
)
def c1(spark, sf):
    rows = joins.offers_with_listings(last_offers(spark, sf), order_rows(spark, sf), "2-HIGH", ["SALE"])
    return rows.select("listing_id", "purpose", "price")


@query(
    "c2_with_children",
    with_(OFFERS, LAST_OFFERS, PHOTOS, UNIQUE_PHOTOS)
    + """SELECT CAST(o_orderkey AS VARCHAR) AS listing_id, coalesce(o, '') AS offers, coalesce(p, '') AS photos FROM orders
      LEFT JOIN (SELECT listing_id, string_agg(purpose || ':' || price, ',' ORDER BY purpose) AS o FROM last_offers
        GROUP BY listing_id) a ON a.listing_id = CAST(o_orderkey AS VARCHAR)
      LEFT JOIN (SELECT listing_id, string_agg(url, ',' ORDER BY position) AS p FROM unique_photos GROUP BY listing_id) b
        ON b.listing_id = CAST(o_orderkey AS VARCHAR)""",
)
def c2(spark, sf):
    rows = joins.with_children(
        order_rows(spark, sf), last_offers(spark, sf).select("listing_id", "purpose", "price"), unique_photos(spark, sf)
    )
    said = F.transform("offers", lambda o: F.concat(o["purpose"], F.lit(":"), o["price"]))
    return rows.select(
        "listing_id", F.array_join(said, ",").alias("offers"), F.array_join("photos.url", ",").alias("photos")
    )


@query(
    "c3_match_existing",
    with_(SIGHTINGS)
    + """SELECT position, external_id, CAST(c_acctbal AS DECIMAL(12,2)) AS old_price, c_custkey IS NULL AS is_new
      FROM sightings LEFT JOIN customer ON external_id = CAST(c_custkey AS VARCHAR) AND c_mktsegment <> 'BUILDING'""",
)
def c3(spark, sf):
    state = table(spark, sf, "customer").filter("c_mktsegment <> 'BUILDING'").select(
        F.col("c_custkey").cast("string").alias("external_id"), F.col("c_acctbal").cast("decimal(12,2)").alias("price")
    )
    return joins.match_existing(sightings(spark, sf), state, ["external_id"]).select(
        "position", "external_id", "old_price", "is_new"
    )


@query(
    "c4_overlay_detail",
    with_(SIGHTINGS)
    + """SELECT position, external_id, coalesce(CASE WHEN c_nationkey > 12 THEN c_name END, event_type) AS title,
        coalesce(CASE WHEN c_acctbal > 5000 THEN CAST(c_acctbal AS DECIMAL(12,2)) END, price) AS price, c_custkey IS NOT NULL AS has_detail
      FROM sightings LEFT JOIN customer ON external_id = CAST(c_custkey AS VARCHAR) AND c_mktsegment <> 'BUILDING'""",
)
def c4(spark, sf):
    cards = sightings(spark, sf).select("position", "external_id", F.col("event_type").alias("title"), "price")
    details = table(spark, sf, "customer").filter("c_mktsegment <> 'BUILDING'").select(
        F.col("c_custkey").cast("string").alias("external_id"),
        F.when(F.col("c_nationkey") > 12, F.col("c_name")).otherwise("").alias("title"),
        F.when(F.col("c_acctbal") > 5000, F.col("c_acctbal").cast("decimal(12,2)")).alias("price"),
    )
    return overlay_detail(cards, details, ["external_id"], F.current_timestamp()).drop("detail_last_fetched_at")


@query(
    "c5_unseen",
    """SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')""",
)
def c5(spark, sf):
    seen = table(spark, sf, "orders").filter("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey"))
    return joins.unseen(table(spark, sf, "customer"), seen, ["c_custkey"]).select("c_custkey", "c_name")


@query(
    "c6_missing_children",
    with_(PHOTOS, UNIQUE_PHOTOS)
    + """, incoming AS (SELECT DISTINCT listing_id, url FROM photos WHERE shipped >= TIMESTAMP '1999-01-01')
      SELECT listing_id, url FROM unique_photos WHERE listing_id IN (SELECT listing_id FROM incoming)
      AND (listing_id, url) NOT IN (SELECT listing_id, url FROM incoming)""",
)
def c6(spark, sf):
    incoming = photos(spark, sf).filter("shipped >= TIMESTAMP_NTZ '1999-01-01'")
    return joins.missing_children(unique_photos(spark, sf), incoming, "listing_id", "url").select("listing_id", "url")


@query(
    "c7_purge_by_source",
    """SELECT c_custkey, c_nationkey, 'plain' AS rule FROM customer WHERE c_nationkey NOT IN
        (SELECT n_nationkey FROM nation WHERE n_regionkey IN (1, 4))
      UNION ALL SELECT c_custkey, c_nationkey, 'guarded' FROM customer WHERE c_nationkey NOT IN
        (SELECT n_nationkey FROM nation WHERE n_regionkey IN (1, 4)
          AND n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 6000))""",
)
def c7(spark, sf):
    people = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    doomed = table(spark, sf, "nation").filter("n_regionkey IN (1, 4)").select(F.col("n_nationkey").alias("c_nationkey"))
    guard = table(spark, sf, "supplier").filter("s_acctbal > 6000").select(F.col("s_nationkey").alias("c_nationkey"))
    return joins.purge_by_source(people, doomed, "c_nationkey").withColumn("rule", F.lit("plain")).unionByName(
        joins.purge_by_source(people, doomed, "c_nationkey", guard).withColumn("rule", F.lit("guarded"))
    )


@query(
    "c8_rekey_dimension",
    """SELECT c_custkey, CASE c_nationkey WHEN 3 THEN 7 WHEN 5 THEN 99 ELSE c_nationkey END AS c_nationkey FROM customer""",
)
def c8(spark, sf):
    moves = table(spark, sf, "nation").filter("n_nationkey IN (3, 5)").select(
        F.col("n_nationkey").alias("old_id"), F.when(F.col("n_nationkey") == 3, 7).otherwise(99).alias("new_id")
    )
    return joins.rekey_dimension(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), moves, "c_nationkey")


@query(
    "c8_rekey_sources",
    """SELECT n_nationkey, CASE WHEN n_nationkey = 5 THEN 'NEW' ELSE n_name END AS key FROM nation WHERE n_nationkey <> 3""",
)
def c8_sources(spark, sf):
    nation = table(spark, sf, "nation")
    seventh = nation.filter("n_nationkey = 7").select(F.col("n_name").alias("new_key"))
    moves = nation.filter("n_nationkey = 3").select(F.col("n_name").alias("old_key"), seventh.scalar().alias("new_key"))
    moves = moves.unionByName(
        nation.filter("n_nationkey = 5").select(F.col("n_name").alias("old_key"), F.lit("NEW").alias("new_key"))
    )
    return joins.rekey_sources(nation.select("n_nationkey", F.col("n_name").alias("key")), moves)


_STATES = "['SUCCESS', 'CAPTCHA_REQUIRED', 'SECURITY_CHALLENGE', 'CONTENT_NOT_FOUND']"


@query(
    "c10_paired_verdict",
    f"""SELECT *, CASE WHEN headless = 'SUCCESS' AND (headed = 'SUCCESS' OR headed IS NULL) THEN 'PROCEED_WITH_PLAYWRIGHT_PROVIDER'
        WHEN headless IS DISTINCT FROM 'SUCCESS' AND headed = 'SUCCESS' THEN 'HEADED_ONLY_NOT_SUITABLE_FOR_SERVER'
        WHEN 'CAPTCHA_REQUIRED' IN (coalesce(headless, ''), coalesce(headed, '')) THEN 'CAPTCHA_REQUIRES_OFFICIAL_INTEGRATION'
        WHEN 'SECURITY_CHALLENGE' IN (coalesce(headless, ''), coalesce(headed, '')) THEN 'BLOCKED_BY_SECURITY'
        ELSE 'INCONCLUSIVE' END AS next_step FROM (
      SELECT user_id, max(r) FILTER (event_type = 'click') AS headless, max(r) FILTER (event_type = 'view') AS headed
      FROM (SELECT user_id, event_type, {_STATES}[1 + CAST(json_extract_string(props, '$.k') AS INTEGER) % 4] AS r
        FROM events WHERE event_type IN ('click', 'view') ) GROUP BY user_id)""",
)
def c10(spark, sf):
    states = F.array(*[F.lit(s) for s in ("SUCCESS", "CAPTCHA_REQUIRED", "SECURITY_CHALLENGE", "CONTENT_NOT_FOUND")])
    results = (
        table(spark, sf, "events")
        .filter("event_type IN ('click', 'view')")
        .select(
            "user_id",
            F.when(F.col("event_type") == "click", "headless").otherwise("headed").alias("mode"),
            F.get(states, F.get_json_object("props", "$.k").cast("int") % 4).alias("result"),
        )
    )
    return joins.paired_verdict(results, ["user_id"])


_OUTCOME = """CASE WHEN event_type = 'click' THEN 'created' WHEN event_type = 'view' THEN 'updated'
  WHEN event_type = 'signup' THEN 'reactivated' WHEN event_type = 'error' THEN 'missing' ELSE 'unchanged' END"""


@query(
    "e1_run_metrics",
    f"""WITH o AS (SELECT CAST(ts AS DATE) AS run_date, {_OUTCOME} AS outcome, CASE WHEN value > 100 THEN 'listing'
        WHEN value > 40 THEN 'offer' ELSE 'photo' END AS entity FROM events)
      SELECT run_date,
      count(*) FILTER (entity = 'listing' AND outcome IN ('created', 'updated', 'unchanged', 'reactivated')) AS listings_seen,
      count(*) FILTER (entity = 'listing' AND outcome IN ('created', 'updated', 'unchanged', 'reactivated')) AS unique_external_ids,
      {", ".join(f"count(*) FILTER (entity = '{e}' AND outcome = '{o}') AS {n}" for n, (e, o) in metrics.COUNTERS.items())}
      FROM o GROUP BY run_date""",
)
def e1(spark, sf):
    value = F.col("value")
    outcomes = table(spark, sf, "events").select(
        F.to_date("ts").alias("run_date"),
        F.expr(_OUTCOME).alias("outcome"),
        F.when(value > 100, "listing").when(value > 40, "offer").otherwise("photo").alias("entity"),
    )
    return metrics.run_metrics(outcomes, ["run_date"])


@query(
    "e2_offers_seen",
    with_(SIGHTINGS)
    + """SELECT run_date, count(*) FILTER (norm_purpose = 'SALE') AS sale_offers_seen,
      count(*) FILTER (norm_purpose = 'RENT') AS rent_offers_seen FROM sightings GROUP BY run_date""",
)
def e2(spark, sf):
    return metrics.offers_seen(sightings(spark, sf), ["run_date"])


@query(
    "e3_card_quality",
    with_(SIGHTINGS, PAGE_LOG)
    + """SELECT run_id, CAST(sum(raw_cards) AS BIGINT) AS cards_seen, CAST(sum(invalid_cards) AS BIGINT) AS invalid_cards,
      coalesce(sum(invalid_cards)::DOUBLE / nullif(sum(raw_cards), 0)::DOUBLE, 0.0) AS invalid_rate,
      (sum(raw_cards) - sum(invalid_cards))::DOUBLE / nullif(sum(raw_cards), 0)::DOUBLE AS valid_cards_ratio
      FROM page_log GROUP BY run_id""",
)
def e3(spark, sf):
    return metrics.card_quality(page_log(spark, sf), ["run_id"])


@query(
    "e4_rollup_status",
    with_(OFFERS)
    + """, r AS (SELECT listing_id, CASE WHEN bool_or(upper(coalesce(status, 'ACTIVE')) = 'ACTIVE') THEN 'ACTIVE'
        WHEN bool_and(upper(coalesce(status, 'ACTIVE')) = 'REMOVED') THEN 'REMOVED' ELSE 'MISSING' END AS s
        FROM (SELECT listing_id, CASE WHEN status IS NULL AND price > 30000 THEN 'missing' ELSE status END AS status FROM offers)
        GROUP BY listing_id)
      SELECT CAST(o_orderkey AS VARCHAR) AS listing_id, coalesce(s, o_orderstatus) AS status,
        CASE WHEN s = 'ACTIVE' THEN NULL WHEN s = 'MISSING' THEN coalesce(m, TIMESTAMP '2002-01-01') ELSE m END AS missing_since,
        CASE WHEN s = 'REMOVED' THEN TIMESTAMP '2002-01-01' END AS removed_at
      FROM (SELECT *, CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS m FROM orders) o
      LEFT JOIN r ON listing_id = CAST(o_orderkey AS VARCHAR)""",
)
def e4(spark, sf):
    rows = order_rows(spark, sf).select(
        "listing_id",
        F.col("o_orderstatus").alias("status"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("missing_since"),
        F.lit(None).cast("timestamp_ntz").alias("removed_at"),
    )
    children = offers(spark, sf).withColumn(
        "status", F.when(F.col("status").isNull() & (F.col("price") > 30000), "missing").otherwise(F.col("status"))
    )
    return metrics.rollup_status(rows, children, ["listing_id"], F.expr("TIMESTAMP_NTZ '2002-01-01'"))


@query(
    "e5_runs_by_status",
    with_(RUNS)
    + """SELECT count(*) AS total, count(*) FILTER (status = 'running') AS running,
      count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'failed') AS failed FROM runs""",
)
def e5(spark, sf):
    return metrics.runs_by_status(runs(spark, sf))


@query(
    "e6_throughput",
    with_(RUNS)
    + """SELECT run_id, round(s, 6) AS duration_seconds, round(pages_fetched / nullif(s, 0), 6) AS pages_per_second,
      CASE WHEN source_key = 'click' THEN cards_seen ELSE pages_fetched + listings_seen END AS requests_total
      FROM (SELECT *, CASE WHEN finished_at IS NOT NULL THEN greatest(CASE WHEN source_key = 'view' THEN 0.0
        ELSE (epoch_us(finished_at) - epoch_us(started_at)) / 1e6 END, 0.0) END AS s FROM runs)""",
)
def e6(spark, sf):
    log = runs(spark, sf).select(
        "run_id",
        "pages_fetched",
        F.col("listings_seen").alias("detail_pages_fetched"),
        F.when(F.col("source_key") == "click", F.col("cards_seen")).otherwise(0).alias("requests_total"),
        "started_at",
        F.when(F.col("source_key") == "view", F.when(F.col("finished_at").isNotNull(), F.col("started_at") - F.expr("INTERVAL 1 HOUR")))
        .otherwise(F.col("finished_at"))
        .alias("finished_at"),
    )
    return metrics.throughput(log).select("run_id", "duration_seconds", "pages_per_second", "requests_total")


@query(
    "e7_first_reported_total",
    with_(SIGHTINGS, PAGE_LOG)
    + """SELECT run_id, arg_min(reported_total, page) FILTER (reported_total IS NOT NULL) AS reported_total
      FROM page_log GROUP BY run_id""",
)
def e7(spark, sf):
    return metrics.first_reported_total(page_log(spark, sf), ["run_id"])


@query(
    "e9_collect_errors",
    with_(SIGHTINGS)
    + """SELECT run_date, page, CASE WHEN k > 50 THEN 429 ELSE 500 END AS status_code, '/p/' || page AS url, 'fetch failed' AS error,
      count(*) AS times FROM sightings WHERE event_type = 'error' GROUP BY 1, 2, 3""",
)
def e9(spark, sf):
    errors = sightings(spark, sf).filter("event_type = 'error'").select(
        "run_date",
        "page",
        F.when(F.col("k") > 50, 429).otherwise(500).alias("status_code"),
        F.concat(F.lit("/p/"), "page").alias("url"),
        F.lit("fetch failed").alias("error"),
    )
    return metrics.collect_errors(errors, ["run_date"])
