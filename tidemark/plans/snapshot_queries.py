"""Registered queries for fingerprints, diffs, merges and whole runs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..functions import hashing
from ..operators import dedup, metrics, ordered, snapshot
from ..operators.joins import match_existing
from ..operators.lifecycle import AbsencePolicy
from .bindings import OFFERS, PHOTOS, RUNS, SIGHTINGS, offers, photos, runs, sightings, table, with_
from .dedup_queries import LAST_OFFERS, PHOTO_ORDER, UNIQUE_PHOTOS
from .registry import query
from ..session import work_dir
from .sync import Run, apply_run, dry_run, open_store

NOW = "TIMESTAMP_NTZ '2002-01-01 00:00:00'"
NOW_SQL = "TIMESTAMP '2002-01-01 00:00:00'"


def now():
    return F.expr(NOW)


@query(
    "h1_merge_preserving",
    """SELECT coalesce(c_custkey, k) AS id, coalesce(price, c_acctbal) AS price, coalesce(city, c_mktsegment) AS city,
        coalesce(currency, c_currency, 'BRL') AS currency
      FROM (SELECT c_custkey, CAST(c_acctbal AS DECIMAL(12,2)) AS c_acctbal, nullif(c_mktsegment, 'BUILDING') AS c_mktsegment,
        CASE WHEN c_nationkey = 3 THEN 'USD' END AS c_currency FROM customer WHERE c_nationkey < 20)
      FULL JOIN (SELECT o_custkey AS k, max(CASE WHEN o_orderstatus = 'O' THEN CAST(o_totalprice AS DECIMAL(12,2)) END) AS price,
        max(CASE WHEN o_orderstatus = 'P' THEN o_orderpriority END) AS city, max(CASE WHEN o_totalprice > 400000 THEN 'EUR' END) AS currency
        FROM orders GROUP BY o_custkey) ON c_custkey = k""",
)
def h1(spark, sf):
    old = table(spark, sf, "customer").filter("c_nationkey < 20").select(
        F.col("c_custkey").alias("id"),
        F.col("c_acctbal").cast("decimal(12,2)").alias("price"),
        F.nullif("c_mktsegment", F.lit("BUILDING")).alias("city"),
        F.when(F.col("c_nationkey") == 3, "USD").alias("currency"),
    )
    new = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(
        F.max(F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice").cast("decimal(12,2)"))).alias("price"),
        F.max(F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority"))).alias("city"),
        F.max(F.when(F.col("o_totalprice") > 400000, "EUR")).alias("currency"),
    )
    return snapshot.merge_preserving(old, new, ["id"], ["price", "city", "currency"], {"currency": "BRL"})


_DETAILS = """SELECT l_partkey, max(CASE WHEN l_returnflag = 'A' THEN CAST(l_extendedprice AS DECIMAL(12,2)) END) AS price,
    CASE WHEN max(l_linenumber) = 7 THEN '' ELSE 'Parte ' || l_partkey END AS title, max(l_suppkey) AS sup, min(l_shipdate) AS d
  FROM lineitem GROUP BY l_partkey"""


@query(
    "h2_overlay_detail",
    f"""SELECT CAST(p_partkey AS VARCHAR) AS external_id, coalesce(nullif(title, ''), p_name) AS title,
        coalesce(d.price, CAST(p_retailprice AS DECIMAL(12,2))) AS price,
        CASE WHEN l_partkey IS NOT NULL THEN '/' || sup || '.jpg' ELSE '/card.jpg' END AS main_image_url,
        CASE WHEN l_partkey IS NOT NULL THEN CASE WHEN p_type = 'SMALL' THEN 'SMALL|Novo' ELSE p_type || '|Novo|small' END
          ELSE p_type || '|' || lower(p_type) END AS tags, l_partkey IS NOT NULL AS has_detail FROM part LEFT JOIN ({_DETAILS}) d
        ON l_partkey = p_partkey AND sup > 30""",
)
def h2(spark, sf):
    cards = table(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias("external_id"),
        F.col("p_name").alias("title"),
        F.col("p_retailprice").cast("decimal(12,2)").alias("price"),
        F.lit("/card.jpg").alias("main_image_url"),
        F.array("p_type", F.lower("p_type")).alias("tags"),
    )
    details = (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_partkey").cast("string").alias("external_id"))
        .agg(
            F.max(F.when(F.col("l_returnflag") == "A", F.col("l_extendedprice").cast("decimal(12,2)"))).alias("price"),
            F.max("l_linenumber").alias("n"),
            F.max("l_suppkey").alias("sup"),
        )
        .filter("sup > 30")
        .select(
            "external_id",
            "price",
            F.when(F.col("n") == 7, "").otherwise(F.concat(F.lit("Parte "), "external_id")).alias("title"),
            F.array(F.concat(F.lit("/"), "sup", F.lit(".jpg")), F.lit("/x.jpg")).alias("image_urls"),
            F.array(F.lit(" Novo"), F.lit("novo"), F.lit("small")).alias("tags"),
        )
    )
    return snapshot.overlay_detail(cards, details, ["external_id"], now()).select(
        "external_id", "title", "price", "main_image_url", F.array_join("tags", "|").alias("tags"), "has_detail"
    )


@query(
    "h3_merge_metadata",
    """SELECT o_orderkey, '{"a":"' || o_orderstatus || '","b":"' || CASE WHEN o_orderstatus = 'O' THEN 'new' ELSE o_orderpriority END
      || '","c":"x","missing_count":"0"}' AS metadata FROM orders""",
)
def h3(spark, sf):
    old = F.create_map(
        F.lit("b"), F.col("o_orderpriority"), F.lit("a"), F.col("o_orderstatus"), F.lit("missing_count"), F.lit("3")
    )
    new = F.when(F.col("o_orderstatus") == "O", F.create_map(F.lit("b"), F.lit("new"), F.lit("c"), F.lit("x"))).otherwise(
        F.create_map(F.lit("c"), F.lit("x"))
    )
    seen = snapshot.merge_metadata(snapshot.merge_metadata(old, new), F.create_map(F.lit("missing_count"), F.lit("0")))
    return table(spark, sf, "orders").select("o_orderkey", hashing.scope_json(seen).alias("metadata"))


_LINE_JSON = """'{"address_line":null,"area_m2":"' || CAST(l_quantity AS DECIMAL(8,2)) || '","bathrooms":null,"bedrooms":' || l_linenumber ||
  ',"city":"São ' || l_returnflag || '","currency":"BRL","main_image_url":null,"neighborhood":null,"offers":[{"currency":"BRL","price":"' ||
  CAST(l_extendedprice AS DECIMAL(12,2)) || '","purpose":"RENT"},{"currency":null,"price":null,"purpose":"SALE"}],"parking_spaces":null,"price":"' ||
  CAST(l_extendedprice AS DECIMAL(12,2)) || '","property_subtype":null,"property_type":null,"state":null,"suites":null,"tags":["' || l_returnflag ||
  '","z \\"q\\""],"title":"' || l_linestatus || '","transaction_type":null}'"""


def line_cards(spark, sf):
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    none = lambda t: F.lit(None).cast(t)
    rent = F.struct(F.lit("RENT").alias("purpose"), price.alias("price"), F.lit("BRL").alias("currency"))
    sale = F.struct(F.lit("SALE").alias("purpose"), none("decimal(12,2)").alias("price"), none("string").alias("currency"))
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.col("l_linestatus").alias("title"),
        F.concat(F.lit("São "), "l_returnflag").alias("city"),
        price.alias("price"),
        F.lit("BRL").alias("currency"),
        F.col("l_linenumber").alias("bedrooms"),
        F.col("l_quantity").cast("decimal(8,2)").alias("area_m2"),
        F.array(F.lit('z "q"'), "l_returnflag").alias("tags"),
        F.array(sale, rent).alias("offers"),
    )


@query(
    "h4_content_hash",
    f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, sha256({_LINE_JSON}) AS content_hash FROM lineitem",
)
def h4(spark, sf):
    cards = line_cards(spark, sf)
    return cards.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", hashing.card_hash(cards).alias("content_hash"))


@query(
    "h5_hashes",
    """SELECT o_orderkey, sha256('{"currency":"BRL","price":"' || CAST(o_totalprice AS DECIMAL(12,2)) || '","purpose":"SALE"}') AS offer,
      sha256(CASE WHEN o_orderstatus = 'O' THEN '{}' ELSE '{"city":"' || o_orderpriority || '","purpose":"sale"}' END) AS scope,
      sha256('{"condominium_fee":"' || CAST(o_totalprice AS DECIMAL(12,2)) || '","description":null,"features":["' || o_orderstatus || '","a"],"seen":"'
        || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '"}') AS detail FROM orders""",
)
def h5(spark, sf):
    price = F.col("o_totalprice").cast("decimal(12,2)")
    scope = F.when(
        F.col("o_orderstatus") != "O",
        F.create_map(F.lit("purpose"), F.lit("sale"), F.lit("city"), F.col("o_orderpriority")),
    )
    rows = table(spark, sf, "orders").select(
        "o_orderkey",
        hashing.offer_hash(F.lit("SALE"), price, F.lit(None).cast("string")).alias("offer"),
        hashing.scope_hash(scope).alias("scope"),
        price.alias("condominium_fee"),
        F.lit(None).cast("string").alias("description"),
        F.array_sort(F.array(F.lit("a"), "o_orderstatus")).alias("features"),
        F.col("o_orderdate").alias("seen"),
    )
    detail = hashing.hash_columns(rows, ["description", "condominium_fee", "features", "seen"])
    return rows.select("o_orderkey", "offer", "scope", detail.alias("detail"))


_SNAP = """SELECT l_partkey, max(l_linenumber) AS bedrooms, min(CASE WHEN l_linestatus = 'O' THEN l_returnflag END) AS city,
    CAST(max(l_discount) AS DECIMAL(12,2)) AS fee FROM lineitem WHERE l_shipdate {cut} TIMESTAMP '1998-06-01' GROUP BY l_partkey"""


def part_snapshot(spark, sf, cut):
    return (
        table(spark, sf, "lineitem")
        .filter(f"l_shipdate {cut} TIMESTAMP_NTZ '1998-06-01'")
        .groupBy("l_partkey")
        .agg(
            F.max("l_linenumber").alias("bedrooms"),
            F.min(F.when(F.col("l_linestatus") == "O", F.col("l_returnflag"))).alias("city"),
            F.max("l_discount").cast("decimal(12,2)").alias("fee"),
        )
    )


@query(
    "h6_changed_fields",
    f"""WITH o AS ({_SNAP.format(cut='<')}), n AS ({_SNAP.format(cut='>=')}),
      j AS (SELECT n.l_partkey, o.bedrooms ob, n.bedrooms nb, o.city oc, n.city nc, o.fee of, n.fee nf FROM n JOIN o USING (l_partkey))
      SELECT l_partkey, 'bedrooms' AS name, CAST(ob AS VARCHAR) AS old, CAST(nb AS VARCHAR) AS new FROM j WHERE ob IS DISTINCT FROM nb
      UNION ALL SELECT l_partkey, 'city', coalesce('"' || oc || '"', 'null'), coalesce('"' || nc || '"', 'null') FROM j WHERE oc IS DISTINCT FROM nc
      UNION ALL SELECT l_partkey, 'fee', '"' || of || '"', '"' || nf || '"' FROM j WHERE of IS DISTINCT FROM nf""",
)
def h6(spark, sf):
    old, new = part_snapshot(spark, sf, "<"), part_snapshot(spark, sf, ">=")
    both = match_existing(new, old, ["l_partkey"]).filter("NOT is_new")
    changes = snapshot.changed_fields(both, ["bedrooms", "city", "fee"])
    return both.select("l_partkey", F.explode(changes).alias("c")).select("l_partkey", "c.*")


@query(
    "h7_upsert_outcome",
    f"""WITH o AS ({_SNAP.format(cut='<')}), n AS ({_SNAP.format(cut='>=')})
      SELECT n.l_partkey, CASE WHEN o.l_partkey IS NULL THEN 'created' WHEN o.city = 'R' THEN 'reactivated'
        WHEN n.bedrooms IS DISTINCT FROM o.bedrooms OR (n.fee IS DISTINCT FROM o.fee AND n.city IS DISTINCT FROM 'A')
          OR (n.bedrooms > 6 AND n.city IS DISTINCT FROM o.city) THEN 'updated' ELSE 'unchanged' END AS outcome
      FROM n LEFT JOIN o USING (l_partkey)""",
)
def h7(spark, sf):
    old, new = part_snapshot(spark, sf, "<"), part_snapshot(spark, sf, ">=")
    m = match_existing(new, old, ["l_partkey"])
    differs = lambda c: ~F.col(c).eqNullSafe(F.col("old_" + c))
    outcome = snapshot.upsert_outcome(
        F.col("is_new"), F.coalesce(F.col("old_city") == "R", F.lit(False)), differs("bedrooms"), differs("fee"),
        F.coalesce(F.col("city") == "A", F.lit(False)), F.col("bedrooms") > 6, differs("city"), F.lit(False),
    )
    return m.select("l_partkey", outcome.alias("outcome"))


_STATE = """SELECT CAST(o_orderkey AS VARCHAR) AS external_id, CASE o_orderstatus WHEN 'O' THEN 'ACTIVE' WHEN 'P' THEN 'MISSING'
    ELSE 'REMOVED' END AS status, CASE WHEN o_orderstatus <> 'O' THEN o_orderdate END AS missing_since,
    CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS removed_at, o_orderdate AS last_seen_at,
    CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS scope_hash, CAST(CASE WHEN o_totalprice > 250000 THEN 1 END AS INTEGER) AS missing_count
  FROM orders"""


def order_state(spark, sf):
    status = F.col("o_orderstatus")
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("external_id"),
        F.when(status == "O", "ACTIVE").when(status == "P", "MISSING").otherwise("REMOVED").alias("status"),
        F.when(status != "O", F.col("o_orderdate")).alias("missing_since"),
        F.when(status == "F", F.col("o_orderdate")).alias("removed_at"),
        F.col("o_orderdate").alias("last_seen_at"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("scope_hash"),
        F.when(F.col("o_totalprice") > 250000, 1).alias("missing_count"),
    )


def order_seen(spark, sf):
    return table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(
        F.col("l_orderkey").cast("string").alias("external_id"), "l_linestatus"
    )


@query(
    "h8_reset_on_seen",
    f"""SELECT external_id, CASE WHEN sn THEN 'ACTIVE' ELSE status END AS status, sn AND status <> 'ACTIVE' AS reactivated,
      CASE WHEN sn THEN {NOW_SQL} ELSE last_seen_at END AS last_seen_at, CASE WHEN NOT sn THEN missing_since END AS missing_since,
      CASE WHEN NOT sn THEN removed_at END AS removed_at
      FROM (SELECT *, external_id IN (SELECT CAST(l_orderkey AS VARCHAR) FROM lineitem WHERE l_returnflag = 'R') AS sn FROM ({_STATE}))""",
)
def h8(spark, sf):
    seen = order_seen(spark, sf).select("external_id").distinct().withColumn("sn", F.lit(True))
    marked = order_state(spark, sf).join(seen, "external_id", "left")
    return snapshot.reset_on_seen(marked, now(), F.coalesce("sn", F.lit(False))).select(
        "external_id", "status", "reactivated", "last_seen_at", "missing_since", "removed_at"
    )


_EARLY, _LATE = "l_shipdate < TIMESTAMP '1998-06-01'", "l_shipdate >= TIMESTAMP '1998-06-01'"
_STORED_OFFERS = f"""stored AS (SELECT listing_id, purpose, price, status, q2 AS seen, CASE WHEN q1 = 3 THEN NULL ELSE
    sha256('{{"currency":"BRL","price":"' || price || '","purpose":"' || CASE WHEN q1 = 5 THEN 'x' ELSE purpose END || '"}}') END AS h
  FROM (SELECT * FROM offers WHERE q2 < TIMESTAMP '1998-06-01') QUALIFY row_number() OVER
    (PARTITION BY listing_id, purpose ORDER BY q1 DESC, q2 DESC, q3 DESC, q4 DESC, q5 DESC) = 1),
sent AS (SELECT listing_id, purpose, CASE WHEN q1 > 3 THEN price END AS price FROM (SELECT * FROM offers WHERE q2 >= TIMESTAMP '1998-06-01')
  QUALIFY row_number() OVER (PARTITION BY listing_id, purpose ORDER BY q1 DESC, q2 DESC, q3 DESC, q4 DESC, q5 DESC) = 1)"""


def offer_halves(spark, sf):
    """Stored offers from the early line items, a run's offers from the late ones."""
    rows = offers(spark, sf)
    early = dedup.last_per_purpose(rows.filter("seq.l_shipdate < TIMESTAMP_NTZ '1998-06-01'"), ["listing_id"], "seq")
    late = dedup.last_per_purpose(rows.filter("seq.l_shipdate >= TIMESTAMP_NTZ '1998-06-01'"), ["listing_id"], "seq")
    line, none = F.col("seq.l_linenumber"), F.lit(None).cast("timestamp_ntz")
    stored = early.select(
        F.col("listing_id").alias("external_id"),
        "purpose",
        "price",
        F.lit("BRL").alias("currency"),
        "status",
        F.when(line == 3, None)
        .otherwise(hashing.offer_hash(F.when(line == 5, "x").otherwise(F.col("purpose")), "price", F.lit("BRL")))
        .alias("content_hash"),
        F.col("seq.l_shipdate").alias("first_seen_at"),
        F.col("seq.l_shipdate").alias("last_seen_at"),
        F.when(F.col("status") == "removed", F.col("seq.l_shipdate")).alias("missing_since"),
        none.alias("removed_at"),
        F.lit("Venda").alias("raw_label"),
        F.when(line > 2, "s1").otherwise("s2").alias("scope_hash"),
        F.when(line == 1, 1).alias("missing_count"),
    )
    sent = late.select(
        F.col("listing_id").alias("external_id"),
        "purpose",
        F.when(line > 3, F.col("price")).alias("price"),
        F.lit(None).cast("string").alias("currency"),
        F.lit("Venda").alias("raw_label"),
        F.lit("s1").alias("scope_hash"),
    )
    return stored, sent


@query(
    "h9_sync_offers",
    with_(OFFERS, _STORED_OFFERS)
    + f"""SELECT listing_id AS external_id, purpose, CASE WHEN n.listing_id IS NOT NULL THEN n.price ELSE o.price END AS price,
        CASE WHEN n.listing_id IS NOT NULL THEN 'ACTIVE' ELSE o.status END AS status,
        CASE WHEN n.listing_id IS NOT NULL THEN {NOW_SQL} ELSE o.seen END AS last_seen_at,
        CASE WHEN n.listing_id IS NULL THEN NULL WHEN o.listing_id IS NULL THEN 'created'
          WHEN o.status = 'removed' OR o.price IS DISTINCT FROM n.price OR o.h <> sha256('{{"currency":"BRL","price":' ||
            coalesce('"' || n.price || '"', 'null') || ',"purpose":"' || purpose || '"}}') THEN 'updated' ELSE 'unchanged' END AS outcome,
        o.listing_id IS NOT NULL AND n.listing_id IS NOT NULL AND coalesce(o.status = 'removed', false) AS reactivated
      FROM stored o FULL JOIN sent n USING (listing_id, purpose)""",
)
def h9(spark, sf):
    stored, sent = offer_halves(spark, sf)
    return snapshot.sync_offers(stored, sent, ["external_id"], now()).select(
        "external_id", "purpose", "price", "status", "last_seen_at", "outcome", "reactivated"
    )


@query(
    "h10_sync_photos",
    with_(PHOTOS, UNIQUE_PHOTOS.replace("unique_photos AS", "up AS"))
    + f""", stored AS (SELECT listing_id, url, position, is_active, CASE WHEN NOT is_active AND position > 2 THEN shipped END AS removed_at
        FROM up WHERE shipped < TIMESTAMP '1999-01-01'),
      sent AS (SELECT listing_id, url, row_number() OVER (PARTITION BY listing_id ORDER BY url) AS position FROM
        (SELECT DISTINCT listing_id, url FROM photos WHERE shipped >= TIMESTAMP '1997-06-01' AND part % 2 = 0))
      SELECT listing_id, url, CAST(coalesce(n.position, o.position) AS INTEGER) AS position,
        CASE WHEN n.url IS NOT NULL THEN true WHEN listing_id IN (SELECT listing_id FROM sent) THEN false ELSE o.is_active END AS is_active,
        CASE WHEN n.url IS NOT NULL THEN NULL WHEN listing_id IN (SELECT listing_id FROM sent) THEN coalesce(o.removed_at, {NOW_SQL})
          ELSE o.removed_at END AS removed_at,
        CASE WHEN n.url IS NOT NULL AND o.url IS NULL THEN 'created'
          WHEN n.url IS NOT NULL AND (n.position <> o.position OR NOT o.is_active OR o.removed_at IS NOT NULL) THEN 'updated'
          WHEN n.url IS NOT NULL THEN 'unchanged'
          WHEN listing_id IN (SELECT listing_id FROM sent) AND (o.is_active OR o.removed_at IS NULL) THEN 'inactivated' END AS outcome
      FROM stored o FULL JOIN sent n USING (listing_id, url)""",
)
def h10(spark, sf):
    rows = photos(spark, sf)
    stored = dedup.keep_first(rows, ["listing_id", "url"], PHOTO_ORDER).filter(
        "shipped < TIMESTAMP_NTZ '1999-01-01'"
    ).select(
        "listing_id", "url", "position", "is_active",
        F.when(~F.col("is_active") & (F.col("position") > 2), F.col("shipped")).alias("removed_at"),
    )
    sent = rows.filter("shipped >= TIMESTAMP_NTZ '1997-06-01' AND part % 2 = 0")
    galleries = sent.groupBy("listing_id").agg(F.array_sort(F.collect_set("url")).alias("urls"))
    incoming = ordered.positions(galleries, ["listing_id"], F.col("urls"))
    return snapshot.sync_photos(stored, incoming, ["listing_id"], now())


@query(
    "h11_gallery_source",
    """SELECT p_partkey, CASE WHEN p_type IN ('LARGE', 'SMALL') THEN '/d/' || p_partkey || '.jpg'
      WHEN p_type = 'ECONOMY' OR (p_type = 'PROMO' AND p_size > 25) THEN '/c/' || p_partkey || '.jpg|/c/2.jpg' ELSE '' END AS urls FROM part""",
)
def h11(spark, sf):
    kind, size = F.col("p_type"), F.col("p_size")
    empty = F.array().cast("array<string>")
    detail = F.when(
        kind.isin("LARGE", "SMALL"), F.array(F.concat(F.lit("/d/"), "p_partkey", F.lit(".jpg?utm_term=x")))
    ).otherwise(empty)
    card = F.array(F.concat(F.lit("/c/"), "p_partkey", F.lit(".jpg")), F.lit("/c/2.jpg"), F.lit("/C/2.jpg"))
    urls = snapshot.gallery_source(
        detail, card, kind.isin("LARGE", "SMALL", "MEDIUM"), kind == "ECONOMY", ~((kind == "PROMO") & (size > 25))
    )
    return table(spark, sf, "part").select("p_partkey", F.array_join(urls, "|").alias("urls"))


@query(
    "h12_reconcile_absent",
    f"""WITH a AS (SELECT *, status <> 'REMOVED' AND scope_hash = '2-HIGH' AND external_id NOT IN
        (SELECT CAST(l_orderkey AS VARCHAR) FROM lineitem WHERE l_returnflag = 'R') AS absent FROM ({_STATE})),
      s AS (SELECT *, CASE WHEN NOT coalesce(absent, false) THEN NULL WHEN status = 'ACTIVE' THEN 'missing'
        WHEN missing_since <= {NOW_SQL} - INTERVAL 30000 HOUR OR coalesce(missing_count, 0) + 1 >= 2 THEN 'removed' END AS absence FROM a)
      SELECT external_id, coalesce(upper(absence), status) AS status, absence,
        CASE WHEN coalesce(absent, false) THEN coalesce(missing_count, 0) + 1 ELSE missing_count END AS missing_count,
        CASE WHEN absence = 'missing' THEN coalesce(missing_since, {NOW_SQL}) ELSE missing_since END AS missing_since,
        CASE WHEN absence = 'removed' THEN {NOW_SQL} ELSE removed_at END AS removed_at FROM s""",
)
def h12(spark, sf):
    policy = AbsencePolicy(threshold=2, removal_hours=30000)
    after = snapshot.reconcile_absent(
        order_state(spark, sf), order_seen(spark, sf), ["external_id"], policy, "2-HIGH", now()
    )
    return after.select("external_id", "status", "absence", "missing_count", "missing_since", "removed_at")


@query(
    "h13_reconcile_absent_offers",
    with_(OFFERS, _STORED_OFFERS.replace("stored AS (SELECT", "stored AS (SELECT q1,"))
    + f""", a AS (SELECT s.*, CASE WHEN q1 = 1 THEN 1 END AS mc, CASE WHEN status = 'removed' THEN seen END AS ms,
        purpose = 'SALE' AND q1 > 2 AND (listing_id, purpose) NOT IN (SELECT listing_id, purpose FROM sent) AS absent FROM stored s)
      , b AS (SELECT *, CASE WHEN absent AND upper(coalesce(status, 'ACTIVE')) = 'ACTIVE' THEN 'missing' END AS absence FROM a)
      , r AS (SELECT *, coalesce(upper(absence), status) AS s2 FROM b)
      SELECT listing_id AS external_id, purpose, s2 AS status, absence,
        CASE WHEN absent THEN coalesce(mc, 0) + 1 ELSE mc END AS missing_count,
        CASE WHEN bool_or(upper(coalesce(s2, 'ACTIVE')) = 'ACTIVE') OVER w THEN 'ACTIVE'
          WHEN bool_and(upper(coalesce(s2, 'ACTIVE')) = 'REMOVED') OVER w THEN 'REMOVED' ELSE 'MISSING' END AS child_status
      FROM r WINDOW w AS (PARTITION BY listing_id)""",
)
def h13(spark, sf):
    stored, sent = offer_halves(spark, sf)
    after = snapshot.reconcile_absent_offers(
        stored, sent, ["external_id"], ["SALE"], AbsencePolicy(2, 72), "s1", now()
    )
    return after.join(metrics.child_status(after, ["external_id"]), "external_id").select(
        "external_id", "purpose", "status", "absence", "missing_count", "child_status"
    )


@query(
    "h15_classify_run",
    with_(RUNS)
    + """, m AS (SELECT *, CASE WHEN source_key = 'view' THEN 'limit' END AS reason, CASE WHEN source_key = 'click' THEN 120 END AS rep,
        lag(listings_seen) OVER (PARTITION BY source_key ORDER BY run_date) AS prev, source_key = 'error' AND cards_seen > 65 AS broken FROM runs)
      SELECT run_id, CASE WHEN broken OR (mode = 'full' AND (reason = 'limit' OR listings_seen < rep * CAST(0.5 AS DOUBLE)
            OR listings_seen < prev * CAST(0.9 AS DOUBLE))) THEN 'partial' ELSE 'success' END AS run_status,
        CASE WHEN NOT broken AND mode = 'full' AND reason IS NULL AND listings_seen < rep * CAST(0.9 AS DOUBLE) THEN 'suspicious_reported_total_gap'
          WHEN NOT broken AND mode = 'full' AND reason IS NULL AND listings_seen < prev * CAST(0.9 AS DOUBLE) THEN 'suspicious_low_count'
          ELSE reason END AS stopped_reason FROM m""".replace("listings_seen < rep * CAST(0.5", "listings_seen < rep * CAST(0.9"),
)
def h15(spark, sf):
    from pyspark.sql import Window as W

    log = runs(spark, sf)
    figures = log.select(
        "run_id", "mode", "listings_seen",
        (~((F.col("source_key") == "error") & (F.col("cards_seen") > 65))).alias("completed"),
        F.lit(0).alias("http_errors"), F.lit(0).alias("parse_errors"),
        F.when(F.col("source_key") == "view", "limit").alias("stopped_reason"),
        F.when(F.col("source_key") == "click", 120).alias("reported_total"),
        F.lag("listings_seen").over(W.partitionBy("source_key").orderBy("run_date")).alias("previous_count"),
    )
    return snapshot.classify_run(figures, 0.9).select("run_id", "run_status", "stopped_reason")


@query(
    "h16_refresh_plan",
    with_(SIGHTINGS)
    + """, c AS (SELECT * FROM sightings QUALIFY row_number() OVER (PARTITION BY external_id ORDER BY run_date, page, position) = 1),
      due AS (SELECT c.* FROM c LEFT JOIN (SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_mktsegment <> 'BUILDING' THEN
          TIMESTAMP '2024-01-30' - to_hours(CAST(c_nationkey AS INTEGER) * 20) END AS fetched, CASE WHEN c_acctbal > 8000 THEN 'x' ELSE 'h' END AS h FROM customer
          WHERE c_nationkey <> 9) s ON id = external_id
        WHERE id IS NULL OR fetched IS NULL OR h <> 'h' OR TIMESTAMP '2024-01-30' - fetched >= INTERVAL 168 HOUR)
      SELECT external_id, position FROM due ORDER BY run_date, page, position LIMIT 60""",
)
def h16(spark, sf):
    cards = dedup.keep_first(sightings(spark, sf), ["external_id"], ["run_date", "page", "position"])
    state = table(spark, sf, "customer").filter("c_nationkey <> 9").select(
        F.col("c_custkey").cast("string").alias("external_id"),
        F.when(
            F.col("c_mktsegment") != "BUILDING",
            F.expr("TIMESTAMP_NTZ '2024-01-30'") - F.make_dt_interval(hours=F.col("c_nationkey") * 20),
        ).alias("detail_last_fetched_at"),
        F.when(F.col("c_acctbal") > 8000, "x").otherwise("h").alias("content_hash"),
    )
    matched = match_existing(cards.withColumn("content_hash", F.lit("h")), state, ["external_id"])
    plan = snapshot.refresh_plan(
        matched, 168, "delta", F.expr("TIMESTAMP_NTZ '2024-01-30'"), ["run_date", "page", "position"], 60
    )
    return plan.select("external_id", "position")


@query(
    "h17_seen_keys",
    with_(SIGHTINGS)
    + """SELECT DISTINCT external_id, p AS purpose FROM (SELECT external_id, CASE WHEN c_custkey IS NOT NULL THEN 'SALE' ELSE norm_purpose END AS p
      FROM sightings LEFT JOIN customer ON external_id = CAST(c_custkey AS VARCHAR) AND c_mktsegment = 'BUILDING') WHERE p IN ('SALE', 'RENT')""",
)
def h17(spark, sf):
    cards = sightings(spark, sf).select("external_id", F.array(F.struct("purpose")).alias("offers"))
    details = table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("external_id"),
        F.when(F.col("c_mktsegment") == "BUILDING", F.array(F.struct(F.lit("Venda").alias("purpose"))))
        .otherwise(F.array().cast("array<struct<purpose:string>>"))
        .alias("offers"),
    )
    return snapshot.seen_keys(cards, details, ["external_id"])


@query(
    "h18_status_backfill",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN CASE WHEN o_orderpriority = '2-HIGH' THEN NULL ELSE 'MISSING' END
      WHEN 'F' THEN 'REMOVED' ELSE 'ACTIVE' END AS status, CASE WHEN o_orderstatus = 'O' THEN '/s' ELSE '/u' END AS source_url FROM orders""",
)
def h18(spark, sf):
    status = F.col("o_orderstatus")
    rows = table(spark, sf, "orders").select(
        "o_orderkey",
        F.when((status == "P") & (F.col("o_orderpriority") == "2-HIGH"), None)
        .when(status == "P", "missing").when(status == "F", "Removed").otherwise("sold").alias("status"),
        F.when(status == "O", "/s").alias("source_url"),
        F.lit("/u").alias("url"),
    )
    return snapshot.normalise_status_backfill(rows).drop("url")


# Two runs over all events: the first half of the month fills the tables, the second meets them. A
# user has several listings, by event number, so that some are in one half only. What is neither
# sold nor let has no offer.
_HALVES = """cards AS (SELECT s.* REPLACE (external_id || '-' || (position % 7) AS external_id),
    CASE WHEN norm_purpose IN ('SALE', 'RENT') THEN norm_purpose END AS p, CASE norm_purpose WHEN 'SALE' THEN 10 ELSE 0 END AS rank FROM sightings s),
c1 AS (SELECT * FROM cards WHERE run_date < DATE '2024-01-16'
    QUALIFY row_number() OVER (PARTITION BY external_id ORDER BY page, position) = 1),
c2 AS (SELECT * FROM cards WHERE run_date >= DATE '2024-01-16'
    QUALIFY row_number() OVER (PARTITION BY external_id ORDER BY page, position) = 1)"""


def run_cards(spark, sf, first: bool):
    cut = F.col("run_date") < F.lit("2024-01-16").cast("date")
    offer = F.struct("purpose", "price", F.lit("BRL").alias("currency"), F.lit("Preço").alias("raw_label"))
    return (
        sightings(spark, sf)
        .filter(cut if first else ~cut)
        .select(
            F.concat_ws("-", "external_id", F.col("position") % 7).alias("external_id"), "page", "position", F.lit("/l").alias("source_url"), F.lit("Casa").alias("title"),
            F.when(F.col("k") > 50, "Santos").otherwise("São Paulo").alias("city"),
            F.when(F.col("k") > 10, F.col("price")).alias("price"),
            F.array(offer).alias("offers"),
            F.array("event_type").alias("tags"),
            F.array(F.concat(F.lit("/"), "event_type", F.lit(".jpg"))).alias("image_urls"),
        )
    )


def two_runs(spark, sf):
    """Both runs on the stored tables; returns where those are."""
    root = work_dir(spark, "inventory")
    empty = spark.createDataFrame([], "external_id string")
    for n, day in ((1, datetime(2024, 1, 16)), (2, datetime(2024, 1, 31))):
        run = Run(f"r{n}", "src", day, "full", {"purpose": "sale"})
        apply_run(spark, root, run_cards(spark, sf, n == 1), empty, run, buckets=8)
    return root


_PAIR = """p AS (SELECT coalesce(a.external_id, b.external_id) AS external_id, a.external_id IS NOT NULL AS had, b.external_id IS NOT NULL AS has,
    CASE WHEN a.k > 10 THEN a.price END AS p1, CASE WHEN b.k > 10 THEN b.price END AS p2, a.price AS o1, b.price AS o2,
    a.event_type AS t1, b.event_type AS t2, a.p AS u1, b.p AS u2, b.rank, CASE WHEN a.k > 50 THEN 'Santos' ELSE 'São Paulo' END AS y1,
    CASE WHEN b.k > 50 THEN 'Santos' ELSE 'São Paulo' END AS y2 FROM c1 a FULL JOIN c2 b USING (external_id))"""


@query(
    "h14_event_log",
    with_(SIGHTINGS, _HALVES, _PAIR)
    + """, e AS (
      SELECT external_id, 100 AS seq, 'CREATED' AS event_type, NULL AS old_value, '{"external_id":"' || external_id || '","price":' ||
        coalesce('"' || p2 || '"', 'null') || ',"offers":[' || coalesce('{"purpose":"' || u2 || '","price":"' || o2 ||
        '","currency":"BRL"}', '') || ']}' AS new_value FROM p WHERE has AND NOT had
      UNION ALL SELECT external_id, rank + 1, 'PRICE_CHANGED',
        '{"entity":"offer","purpose":"' || u2 || '","price":"' || o1 || '"}',
        '{"entity":"offer","purpose":"' || u2 || '","price":"' || o2 || '"}'
        FROM p WHERE has AND had AND u1 = u2 AND o1 <> o2
      UNION ALL SELECT external_id, 103, 'CONTENT_CHANGED', f1, f2 FROM (SELECT *,
          concat_ws(',', CASE WHEN y1 <> y2 THEN '"city":"' || y1 || '"' END, CASE WHEN t1 <> t2 THEN '"tags":["' || t1 || '"]' END) AS f1,
          concat_ws(',', CASE WHEN y1 <> y2 THEN '"city":"' || y2 || '"' END, CASE WHEN t1 <> t2 THEN '"tags":["' || t2 || '"]' END) AS f2
          FROM p WHERE has AND had) WHERE f1 <> ''
      UNION ALL SELECT external_id, 300, 'MARKED_MISSING', '{"status":"ACTIVE"}', '{"status":"MISSING"}' FROM p
        WHERE had AND NOT has)
      SELECT external_id, seq, event_type, old_value, new_value FROM e""",
)
def h14(spark, sf):
    events = open_store(spark, two_runs(spark, sf), "src").history("events", "r2")
    # The hashes inside a content event are covered by h4; here only the fields are compared.
    bare = lambda c: F.when(
        F.col("event_type") == "CONTENT_CHANGED", F.regexp_extract(c, r'"fields":\{(.*)\}\}$', 1)
    ).otherwise(F.col(c))
    return events.select(
        "external_id", "seq", "event_type", bare("old_value").alias("old_value"), bare("new_value").alias("new_value")
    )


@query(
    "h19_sync",
    with_(SIGHTINGS, _HALVES, _PAIR)
    + """SELECT count(*) FILTER (has) AS listings_seen, count(*) FILTER (has AND NOT had) AS new_properties,
      count(*) FILTER (has AND had AND (p1 IS DISTINCT FROM p2 OR y1 <> y2 OR t1 <> t2 OR o1 <> o2)) AS updated_properties,
      count(*) FILTER (has AND had AND NOT (p1 IS DISTINCT FROM p2 OR y1 <> y2 OR t1 <> t2 OR o1 <> o2)) AS unchanged_properties,
      count(*) FILTER (had AND NOT has) AS missing_properties, 0::BIGINT AS removed_properties,
      count(*) FILTER (has AND u2 IS NOT NULL AND u1 IS DISTINCT FROM u2) AS offers_created, count(*) FILTER (has AND had AND u1 = u2 AND o1 <> o2) AS offers_updated,
      count(*) FILTER (has AND had AND u1 = u2 AND o1 = o2) AS offers_unchanged,
      count(*) FILTER (has AND NOT had) AS photos_created, 'success' AS run_status FROM p""",
)
def h19(spark, sf):
    return open_store(spark, two_runs(spark, sf), "src").history("runs", "r2").select(
        "listings_seen", "new_properties", "updated_properties", "unchanged_properties", "missing_properties",
        "removed_properties", "offers_created", "offers_updated", "offers_unchanged", "photos_created", "run_status",
    )


@query(
    "h20_dry_run",
    with_(SIGHTINGS, _HALVES)
    + """SELECT count(*) AS listings_seen, count(*) FILTER (norm_purpose = 'SALE') AS sale_offers_seen,
      count(*) FILTER (norm_purpose = 'RENT') AS rent_offers_seen FROM c2""",
)
def h20(spark, sf):
    details = spark.createDataFrame([], "external_id string, title string")
    run = Run("r", "src", datetime(2024, 1, 31))
    return dry_run(run_cards(spark, sf, False), details, run)[0].drop("run_id")
