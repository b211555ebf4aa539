"""Registered queries for filters, sorts and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import scope_json
from ..operators import dedup, search
from .bindings import (
    LISTINGS, PAGE_LOG, PHOTOS, RUNS, SIGHTINGS, listings, runs, sightings, table, with_,
)
from .registry import query

_VISIBLE = "status = 'ACTIVE' AND property_subtype IS DISTINCT FROM 'Comercial'"


@query("b1_visible", with_(LISTINGS) + f"SELECT external_id, property_subtype, price FROM listings WHERE {_VISIBLE}")
def b1(spark, sf):
    return search.visible(listings(spark, sf)).select("external_id", "property_subtype", "price")


@query("b2_contains_ci", with_(LISTINGS) + "SELECT external_id, city FROM listings WHERE city ILIKE '%ation_1%'")
def b2(spark, sf):
    return search.contains_ci(listings(spark, sf), "city", "ATION_1").select("external_id", "city")


@query(
    "b3_price_between",
    with_(LISTINGS) + "SELECT external_id, price FROM listings WHERE price >= 100000.5 AND price <= 250000",
)
def b3(spark, sf):
    return search.price_between(listings(spark, sf), "price", 100000.5, 250000).select("external_id", "price")


@query(
    "b4_attribute_filters",
    with_(LISTINGS)
    + """SELECT external_id, bedrooms, 'equals' AS rule FROM listings WHERE bedrooms = 3
      UNION ALL SELECT external_id, bedrooms, 'at least' FROM listings WHERE coalesce(bedrooms, 0) >= 6""",
)
def b4(spark, sf):
    rows = listings(spark, sf).select("external_id", "bedrooms")
    return search.attr_equals(rows, "bedrooms", 3).withColumn("rule", F.lit("equals")).unionByName(
        search.attr_at_least(rows, "bedrooms", 6).withColumn("rule", F.lit("at least"))
    )


_HITS = f"hits AS (SELECT * FROM listings WHERE {_VISIBLE} AND city ILIKE '%nation%' AND price >= 20000 AND price <= 400000)"


@query(
    "b5_search",
    with_(LISTINGS, _HITS)
    + """SELECT external_id, city, price, bedrooms, (SELECT count(*) FROM hits) AS total
      FROM hits ORDER BY price DESC NULLS LAST, external_id LIMIT 20 OFFSET 20""",
)
def b5(spark, sf):
    items, total = search.search(
        listings(spark, sf), city="nation", lo=20000, hi=400000, sort="price_desc", page=2, per_page=20
    )
    return items.select("external_id", "city", "price", "bedrooms", total.scalar().alias("total"))


@query(
    "b6_lookup",
    with_(LISTINGS)
    + """SELECT external_id, source_key, price FROM listings WHERE (source_key, external_id) IN
      (SELECT DISTINCT c_mktsegment, CAST(l_orderkey AS VARCHAR) FROM lineitem, customer
       WHERE c_custkey = l_suppkey AND l_returnflag = 'R')""",
)
def b6(spark, sf):
    wanted = (
        table(spark, sf, "lineitem")
        .filter("l_returnflag = 'R'")
        .join(table(spark, sf, "customer"), F.col("l_suppkey") == F.col("c_custkey"))
        .select(F.col("c_mktsegment").alias("source_key"), F.col("l_orderkey").cast("string").alias("external_id"))
    )
    return search.lookup(listings(spark, sf), wanted).select("external_id", "source_key", "price")


_UUID = "substr(md5(n_name), 1, 8) || '-' || substr(md5(n_name), 9, 4) || '-' || substr(md5(n_name), 13, 4) || '-' || substr(md5(n_name), 17, 4) || '-' || substr(md5(n_name), 21, 12)"


def nation_sources(spark, sf):
    digest = F.md5("n_name")
    ident = F.concat_ws("-", *[F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    return table(spark, sf, "nation").select(
        ident.alias("id"),
        F.col("n_name").alias("key"),
        (F.col("n_regionkey") != 2).alias("enabled"),
        "n_nationkey",
        "n_regionkey",
    )


@query(
    "b6_lookup_source",
    f"SELECT {_UUID} AS id, n_name AS key FROM nation WHERE n_regionkey IN (1, 3)",
)
def b6_source(spark, sf):
    sources = nation_sources(spark, sf)
    asked = (
        sources.filter("n_regionkey IN (1, 3)")
        .select(F.when(F.col("n_regionkey") == 1, F.col("id")).otherwise(F.col("key")).alias("ask"))
    )
    return search.lookup_source(sources, asked).select("id", "key")


@query(
    "b7_enabled_sources",
    """SELECT n_name AS key FROM nation WHERE n_regionkey <> 2 AND n_nationkey IN
      (SELECT s_nationkey FROM supplier GROUP BY s_nationkey HAVING max(s_acctbal) > 3000) ORDER BY key""",
)
def b7(spark, sf):
    sources = nation_sources(spark, sf)
    registered = (
        table(spark, sf, "supplier")
        .groupBy(F.col("s_nationkey").alias("n_nationkey"))
        .agg((F.max("s_acctbal") > 3000).alias("supports_sale"))
        .join(sources.select("n_nationkey", "key"), "n_nationkey")
        .select("key", "supports_sale")
    )
    return search.enabled_sources(sources, registered).select("key")


@query(
    "b8_runs",
    with_(RUNS)
    + """SELECT run_id, started_at, finished_at, (SELECT count(*) FROM runs WHERE status = 'success') AS total FROM runs
      WHERE status = 'success' ORDER BY started_at DESC NULLS LAST, run_id LIMIT 10 OFFSET 10""",
)
def b8(spark, sf):
    items, total = search.runs_page(runs(spark, sf), "success", page=2, per_page=10)
    return items.select("run_id", "started_at", "finished_at", total.scalar().alias("total"))


@query(
    "b9_offers_in_scope",
    with_(SIGHTINGS)
    + """SELECT position, norm_purpose AS purpose, CASE WHEN norm_purpose = 'SALE' THEN 1 ELSE 0 END AS nested
      FROM sightings WHERE norm_purpose IN ('SALE')""",
)
def b9(spark, sf):
    offers = F.array(F.struct("purpose", "price"), F.struct(F.lit("outro").alias("purpose"), "price"))
    cards = sightings(spark, sf).withColumn("offers", offers)
    nested = search.offers_in_scope(cards, ["venda", "troca"])
    return search.offers_in_scope(nested, ["Sale"], "purpose").select(
        "position", F.lit("SALE").alias("purpose"), F.size("offers").alias("nested")
    )


@query(
    "b10_scope_purposes",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'RENT,SALE' WHEN 'P' THEN 'RENT'
      ELSE 'SALE' END AS purposes FROM orders""",
)
def b10(spark, sf):
    scope = (
        F.when(F.col("o_orderstatus") == "O", F.create_map(F.lit("purposes"), F.lit('["Locação", "venda", "x"]')))
        .when(F.col("o_orderstatus") == "P", F.create_map(F.lit("purposes"), F.lit(""), F.lit("purpose"), F.lit("rent")))
    )
    return search.scope_purposes(table(spark, sf, "orders").withColumn("scope", scope)).select(
        "o_orderkey", F.array_join("purposes", ",").alias("purposes")
    )


@query(
    "b11_expand_scopes",
    """SELECT o_orderkey, purpose, coalesce(purpose = 'troca', false) AS bad_purpose, o_orderpriority = '2-HIGH' AS bad_slug,
      CASE WHEN o_orderpriority <> '1-URGENT' THEN '{"city_slug":"' || CASE WHEN o_orderpriority = '2-HIGH' THEN 'S Paulo'
      ELSE 'sao-paulo' END || '","q":"' || o_orderstatus || '"}' ELSE '{"q":"' || o_orderstatus || '"}' END AS scope
      FROM (SELECT *, unnest(CASE o_orderstatus WHEN 'O' THEN ['sale', 'troca'] WHEN 'P' THEN ['rent'] ELSE [NULL] END)
        AS purpose FROM orders)""",
)
def b11(spark, sf):
    scope = F.create_map(
        F.lit("query"), F.col("o_orderstatus"),
        F.lit("purposes"), F.when(F.col("o_orderstatus") == "O", '["sale","troca"]'),
        F.lit("purpose"), F.when(F.col("o_orderstatus") == "P", "rent"),
        F.lit("city_slug"),
        F.when(F.col("o_orderpriority") == "2-HIGH", "S Paulo").when(F.col("o_orderpriority") != "1-URGENT", "sao-paulo"),
        F.lit("state_slug"), F.lit(""),
    )
    return search.expand_scopes(table(spark, sf, "orders").withColumn("scope", scope)).select(
        "o_orderkey", "purpose", "bad_purpose", "bad_slug", scope_json("scope").alias("scope")
    )


@query(
    "b12_json_field_equals",
    "SELECT event_id, props FROM events WHERE json_extract_string(props, '$.k') = '42'",
)
def b12(spark, sf):
    return search.json_field_equals(table(spark, sf, "events"), "props", "$.k", "42").select("event_id", "props")


@query(
    "b13_samples",
    with_(SIGHTINGS)
    + """, first5 AS (SELECT * FROM sightings ORDER BY run_date, page, position LIMIT 5),
      details AS (SELECT CAST(c_custkey AS VARCHAR) AS external_id, c_name AS title FROM customer WHERE c_acctbal > 0)
      SELECT f.external_id, CAST(price AS VARCHAR) AS price, purpose, title FROM first5 f
      LEFT JOIN details d ON f.external_id = d.external_id""",
)
def b13(spark, sf):
    details = table(spark, sf, "customer").filter("c_acctbal > 0").select(
        F.col("c_custkey").cast("string").alias("external_id"), F.col("c_name").alias("title")
    )
    return search.samples(
        sightings(spark, sf), details, ["run_date", "page", "position"], ["external_id", "price", "purpose"]
    )


_SORT_SQL = {
    "price_asc": "price ASC NULLS LAST,",
    "price_desc": "price DESC NULLS LAST,",
    "area_desc": "area_m2 DESC NULLS LAST,",
    "bedrooms_desc": "bedrooms DESC NULLS LAST,",
    "recent": "updated_at DESC NULLS LAST, last_seen_at DESC NULLS LAST,",
    "relevance": "",
}


@query(
    "g1_sort_listings",
    with_(LISTINGS)
    + " UNION ALL ".join(
        f"SELECT * FROM (SELECT '{k}' AS sort, external_id FROM listings ORDER BY {v} external_id LIMIT 50 OFFSET 50)"
        for k, v in _SORT_SQL.items()
    ),
)
def g1(spark, sf):
    rows = listings(spark, sf)
    pages = [
        search.paginate(search.sort_listings(rows, sort, ["external_id"]), 2, 50).select(
            F.lit(sort).alias("sort"), "external_id"
        )
        for sort in _SORT_SQL
    ]
    return dedup.concat_results(*pages)


_CLIENT_SQL = {
    "price_asc": "price ASC NULLS LAST",
    "price_desc": "coalesce(price, 0) DESC",
    "area_desc": "coalesce(area_m2, 0) DESC",
    "recent": "coalesce(updated_at, last_seen_at) DESC NULLS LAST",
}


@query(
    "g2_sort_page",
    with_(LISTINGS, "cut AS (SELECT * FROM listings ORDER BY bedrooms DESC NULLS LAST, external_id LIMIT 60)")
    + " UNION ALL ".join(
        f"SELECT * FROM (SELECT '{k}' AS sort, external_id FROM cut ORDER BY {v}, external_id LIMIT 15)"
        for k, v in _CLIENT_SQL.items()
    ),
)
def g2(spark, sf):
    cut = search.paginate(search.sort_listings(listings(spark, sf), "bedrooms_desc", ["external_id"]), 1, 60)
    pages = [
        search.sort_page(cut, sort, ["external_id"]).limit(15).select(F.lit(sort).alias("sort"), "external_id")
        for sort in _CLIENT_SQL
    ]
    return dedup.concat_results(*pages)


@query(
    "g3_page_count",
    with_(LISTINGS)
    + """SELECT city, count(*) AS total, CAST(greatest(1, ceil(count(*) / 20.0)) AS BIGINT) AS pages FROM listings
      GROUP BY city UNION ALL SELECT 'nowhere', count(*), 1 FROM listings WHERE city = 'nowhere'""",
)
def g3(spark, sf):
    rows = listings(spark, sf)
    nowhere = search.total(rows.filter("city = 'nowhere'")).select(F.lit("nowhere").alias("city"), "total")
    counts = rows.groupBy("city").agg(F.count("*").alias("total")).unionByName(nowhere)
    return counts.withColumn("pages", search.page_count("total", 20))


@query(
    "g4_first_n_per",
    with_(SIGHTINGS)
    + """SELECT run_date, page, position, external_id FROM sightings
      QUALIFY row_number() OVER (PARTITION BY run_date ORDER BY page, position) <= 50""",
)
def g4(spark, sf):
    first = search.first_n_per(sightings(spark, sf), ["run_date"], [F.col("page"), F.col("position")], 50)
    return first.select("run_date", "page", "position", "external_id")


@query("e8_total", with_(LISTINGS) + f"SELECT count(*) AS total FROM listings WHERE {_VISIBLE} AND bedrooms = 4")
def e8(spark, sf):
    return search.total(search.filtered(listings(spark, sf), bedrooms=4))
