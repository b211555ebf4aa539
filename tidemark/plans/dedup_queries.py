"""Registered queries for deduplication and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dedup
from .bindings import OFFERS, PHOTOS, SIGHTINGS, offers, photos, sightings, table, with_
from .registry import query

UNIQUE_PHOTOS = """unique_photos AS (
  SELECT * FROM photos QUALIFY row_number() OVER
    (PARTITION BY listing_id, url ORDER BY position, shipped, part, supp, amount, is_active) = 1)"""
PHOTO_ORDER = ["position", "shipped", "part", "supp", "amount", "is_active"]


def unique_photos(spark, sf):
    return dedup.keep_first(photos(spark, sf), ["listing_id", "url"], PHOTO_ORDER)


@query(
    "d1_keep_first",
    with_(SIGHTINGS)
    + """SELECT run_date, external_id, page, position, price, purpose FROM sightings
      QUALIFY row_number() OVER (PARTITION BY run_date, external_id ORDER BY page, position) = 1""",
)
def d1(spark, sf):
    first = dedup.keep_first(sightings(spark, sf), ["run_date", "external_id"], ["page", "position"])
    return first.select("run_date", "external_id", "page", "position", "price", "purpose")


@query(
    "d2_page_duplicates",
    with_(SIGHTINGS)
    + """SELECT run_date, page, external_id, position, 'duplicate external_id on page' AS error FROM sightings
      QUALIFY row_number() OVER (PARTITION BY run_date, page, external_id ORDER BY position) > 1""",
)
def d2(spark, sf):
    return dedup.page_duplicates(sightings(spark, sf), ["run_date", "page"], "external_id").select(
        "run_date", "page", "external_id", "position", "error"
    )


LAST_OFFERS = """last_offers AS (
  SELECT * FROM offers QUALIFY row_number() OVER
    (PARTITION BY listing_id, purpose ORDER BY q1 DESC, q2 DESC, q3 DESC, q4 DESC, q5 DESC, status DESC NULLS LAST) = 1)"""


def last_offers(spark, sf):
    return dedup.last_per_purpose(offers(spark, sf), ["listing_id"], "seq")


@query(
    "d5_last_per_purpose",
    with_(OFFERS, LAST_OFFERS) + "SELECT listing_id, purpose, price, status FROM last_offers",
)
def d5(spark, sf):
    return last_offers(spark, sf).select("listing_id", "purpose", "price", "status")


@query(
    "d6_merge_offers",
    with_(OFFERS, LAST_OFFERS)
    + """SELECT listing_id, purpose, CASE WHEN d.listing_id IS NOT NULL THEN d.price ELSE l.price END AS price,
        CASE WHEN d.listing_id IS NOT NULL THEN d.status ELSE l.status END AS status
      FROM (SELECT * FROM last_offers WHERE status = 'ACTIVE' OR purpose = 'SALE') l
      FULL JOIN (SELECT listing_id, purpose, CAST(price + 1 AS DECIMAL(13,2)) AS price, status FROM last_offers
        WHERE status IS NULL OR purpose = 'RENT') d USING (listing_id, purpose)""",
)
def d6(spark, sf):
    rows = last_offers(spark, sf).select("listing_id", "purpose", "price", "status")
    cards = rows.filter("status = 'ACTIVE' OR purpose = 'SALE'")
    details = rows.filter("status IS NULL OR purpose = 'RENT'").withColumn("price", (F.col("price") + 1).cast("decimal(13,2)"))
    return dedup.merge_offers(cards, details, ["listing_id"])


@query(
    "d8_display_images",
    with_(PHOTOS, UNIQUE_PHOTOS)
    + """SELECT CAST(o_orderkey AS VARCHAR) AS listing_id,
        coalesce(urls, CASE WHEN o_orderstatus = 'F' THEN '/thumb/m.jpg' ELSE '/m.jpg|/i.jpg' END) AS urls,
        coalesce(string_split(urls, '|')[1], CASE WHEN o_orderstatus = 'F' THEN '/thumb/m.jpg' ELSE '/m.jpg' END) AS main
      FROM orders LEFT JOIN (SELECT listing_id, string_agg(url, '|' ORDER BY position, url) AS urls FROM unique_photos
        WHERE is_active GROUP BY listing_id) p ON p.listing_id = CAST(o_orderkey AS VARCHAR)""",
)
def d8(spark, sf):
    other = F.col("o_orderstatus") != "F"
    rows = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("listing_id"),
        F.lit("/thumb/m.jpg").alias("main_image_url"),
        F.when(other, '{"main_image": "/m.jpg", "images": ["/M.jpg", "/i.jpg"]}').alias("metadata"),
    )
    shown = dedup.display_images(rows, unique_photos(spark, sf), "^/thumb/")
    return shown.select(
        "listing_id", F.array_join("image_urls", "|").alias("urls"), F.col("main_image_url").alias("main")
    )


@query(
    "d9_union_keys",
    """SELECT k AS external_id, bool_or(a) AS in_a, bool_or(b) AS in_b FROM (
        SELECT user_id AS k, true AS a, false AS b FROM events WHERE event_type = 'purchase'
        UNION ALL SELECT user_id, false, true FROM events WHERE event_type = 'view') GROUP BY k""",
)
def d9(spark, sf):
    events = table(spark, sf, "events").select(F.col("user_id").alias("external_id"), "event_type", "value")
    return dedup.union_keys(
        events.filter("event_type = 'purchase'"),
        events.filter("event_type = 'view'"),
        ["external_id"],
    )


@query(
    "d9_compare_keys",
    """SELECT count(*) FILTER (a AND NOT b) AS only_a, count(*) FILTER (b AND NOT a) AS only_b,
        count(*) FILTER (a AND b) AS both, count(*) FILTER (a <> b) = 0 AS equal, count(*) FILTER (a AND b) = 0 AS disjoint
      FROM (SELECT k, bool_or(a) AS a, bool_or(b) AS b FROM (SELECT l_orderkey AS k, true AS a, false AS b FROM lineitem
        UNION ALL SELECT o_orderkey, false, true FROM orders) GROUP BY k)""",
)
def d9_compare(spark, sf):
    return dedup.compare_keys(
        table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k")),
        table(spark, sf, "orders").select(F.col("o_orderkey").alias("k")),
        ["k"],
    )


@query(
    "d10_concat_results",
    """SELECT c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer
      UNION ALL SELECT s_name, s_acctbal, NULL FROM supplier""",
)
def d10(spark, sf):
    return dedup.concat_results(
        table(spark, sf, "customer").select(
            F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")
        ),
        table(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")),
    )
