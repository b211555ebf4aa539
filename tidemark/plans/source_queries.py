"""Registered queries for sources, sinks and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics
from ..session import work_dir
from ..sources import ingest, pages, profiles, state
from .bindings import PAGE_LOG, SIGHTINGS, page_log, table, with_
from .registry import query

_HOST = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"


@query("a1_read_pages", f"SELECT page_id, {_HOST} AS host, md5(html) AS body FROM pages")
def a1(spark, sf):
    return pages.read_pages(spark, f"{sf}/pages.parquet").select("page_id", "host", F.md5("html").alias("body"))


@query(
    "a2_unwrap_payload",
    """SELECT page_id, md5(html) AS body FROM pages UNION ALL SELECT -1 - page_id, md5('{"html": 5, "x": "' || page_id || '"}') FROM pages
      UNION ALL SELECT 1000000 + page_id, md5('{ broken ' || page_id) FROM pages""",
)
def a2(spark, sf):
    raw = table(spark, sf, "pages")
    wrapped = F.concat(F.lit("\n "), F.to_json(F.struct("page_id", "html")))
    unwrap = lambda c: F.md5(pages.unwrap_payload(c)).alias("body")
    number = F.concat(F.lit('{"html": 5, "x": "'), "page_id", F.lit('"}'))
    return (
        raw.select("page_id", unwrap(wrapped))
        .unionAll(raw.select((-1 - F.col("page_id")).alias("page_id"), unwrap(number)))
        .unionAll(raw.select((1000000 + F.col("page_id")).alias("page_id"), unwrap(F.concat(F.lit("{ broken "), "page_id"))))
    )


@query("a3_state_versions", "SELECT c_custkey, c_acctbal, 2::BIGINT AS version FROM customer WHERE c_acctbal > 1000")
def a3(spark, sf):
    """The second run leaves rows out, and rewrites the buckets that held them."""
    people = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    store = state.Store(spark, work_dir(spark, "state"), "src", {"people": "c_custkey bigint, c_acctbal double"}, {"runs": "version bigint"}, "c_custkey", shrinks=True)
    for version in (1, 2):
        touched = store.touched(people if version == 1 else store.read("people").filter("c_acctbal <= 1000"))
        path, rows = store.staging(), people if version == 1 else store.read("people", touched).filter("c_acctbal > 1000")
        store.stage(path, "people", rows)
        store.stage(path, "runs", spark.range(1).select(F.lit(version).cast("bigint").alias("version")))
        store.note(f"r{version}", path, touched, store.finished())
        store.publish(f"r{version}")
    return store.read("people").withColumn("version", store.history("runs").agg(F.max("version")).scalar())


@query(
    "a4_run_summary",
    with_(SIGHTINGS, PAGE_LOG)
    + """SELECT run_id, CAST(sum(raw_cards) AS BIGINT) AS cards_seen, CAST(sum(invalid_cards) AS BIGINT) AS invalid_cards
      FROM page_log GROUP BY run_id""",
)
def a4(spark, sf):
    path = work_dir(spark, "summaries")
    state.write_run_summary(metrics.card_quality(page_log(spark, sf), ["run_id"]), path)
    return spark.read.schema("run_id string, cards_seen bigint, invalid_cards bigint").json(path)


_SEEDED = """SELECT coalesce(n_name, key) AS key, CASE WHEN n_name IS NULL OR ({upd} AND key IS NOT NULL) THEN s_label ELSE 'old ' || n_nationkey END AS label,
    CASE WHEN n_name IS NULL THEN 'seeded' ELSE 'kept' END AS notes, '{mode}' AS mode
  FROM (SELECT * FROM nation WHERE n_regionkey <> 2) FULL JOIN (SELECT n_name AS key, max(s_name) AS s_label FROM supplier
    JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey IN (1, 2) GROUP BY n_name) ON key = n_name"""


@query("a5_seed_dimension", _SEEDED.format(upd="true", mode="update") + " UNION ALL " + _SEEDED.format(upd="false", mode="ignore"))
def a5(spark, sf):
    nation = table(spark, sf, "nation")
    existing = nation.filter("n_regionkey <> 2").select(
        F.col("n_name").alias("key"), F.concat(F.lit("old "), "n_nationkey").alias("label"), F.lit("kept").alias("notes")
    )
    seed = (
        table(spark, sf, "supplier")
        .join(nation.filter("n_regionkey IN (1, 2)"), F.col("s_nationkey") == F.col("n_nationkey"))
        .groupBy(F.col("n_name").alias("key"))
        .agg(F.max("s_name").alias("label"), F.lit("seeded").alias("notes"))
    )
    frames = [
        ingest.seed_dimension(existing, seed, "key", ["label"], mode).withColumn("mode", F.lit(mode)) for mode in ("update", "ignore")
    ]
    return frames[0].unionByName(frames[1])


@query(
    "a6_ingest_records",
    """SELECT coalesce(CAST(c_custkey AS VARCHAR), id) AS external_id, CASE WHEN s = 'O' THEN price WHEN s = 'P' THEN NULL
        ELSE CAST(c_acctbal AS DECIMAL(12,2)) END AS price, CASE WHEN id IS NOT NULL THEN '/u/' || id END AS source_url,
      CASE WHEN s = 'O' THEN '/m' WHEN s = 'P' THEN '/i1' WHEN s = 'F' THEN 'old.jpg' WHEN c_custkey IS NOT NULL THEN 'old.jpg' END AS main_image_url,
      CASE WHEN id IS NOT NULL THEN 'ACTIVE' ELSE 'REMOVED' END AS status,
      CASE WHEN id IS NOT NULL THEN TIMESTAMP '2002-01-01' END AS last_seen_at,
      CASE WHEN id IS NULL THEN TIMESTAMP '2001-01-01' END AS removed_at
    FROM customer FULL JOIN (SELECT CAST(o_custkey AS VARCHAR) AS id, max(o_orderstatus) FILTER (o_orderstatus <> 'P' OR o_totalprice > 450000) AS s,
        max(CAST(o_totalprice AS DECIMAL(12,2))) AS price FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' GROUP BY o_custkey
        HAVING s IS NOT NULL) ON id = CAST(c_custkey AS VARCHAR)""",
)
def a6(spark, sf):
    state_ = table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("external_id"),
        F.col("c_acctbal").cast("decimal(12,2)").alias("price"),
        F.lit(None).cast("string").alias("source_url"),
        F.lit("old.jpg").alias("main_image_url"),
        F.lit("REMOVED").alias("status"),
        F.lit(None).cast("timestamp_ntz").alias("last_seen_at"),
        F.expr("TIMESTAMP_NTZ '2001-01-01'").alias("removed_at"),
    )
    per_customer = (
        table(spark, sf, "orders")
        .filter("o_orderdate < TIMESTAMP_NTZ '1996-01-01'")
        .groupBy(F.col("o_custkey").cast("string").alias("external_id"))
        .agg(
            F.max(F.when((F.col("o_orderstatus") != "P") | (F.col("o_totalprice") > 450000), F.col("o_orderstatus"))).alias("s"),
            F.max(F.col("o_totalprice").cast("decimal(12,2)")).alias("price"),
        )
        .filter("s IS NOT NULL")
    )
    metadata = F.when(F.col("s") == "O", '{"main_image": "/m"}').when(F.col("s") == "P", '{"images": ["/i1", "/i2"]}')
    fields = F.map_filter(
        F.create_map(
            F.lit("price"), F.when(F.col("s") == "O", F.col("price").cast("string")).when(F.col("s") == "P", F.lit("")),
            F.lit("url"), F.concat(F.lit("/u/"), "external_id"),
            F.lit("metadata"), metadata,
            F.lit("unheard_of"), F.lit("x"),
        ),
        lambda k, v: v.isNotNull(),
    )
    records = per_customer.select("external_id", fields.alias("fields"))
    return ingest.ingest_records(state_, records, ["external_id"], F.expr("TIMESTAMP_NTZ '2002-01-01'"))


@query(
    "a7_ingest_summary",
    """SELECT count(*) FILTER (o_orderstatus <> 'P') AS ingested, count(*) FILTER (o_orderstatus = 'P') AS failed, count(*) AS total FROM orders""",
)
def a7(spark, sf):
    records = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("external_id"), F.when(F.col("o_orderstatus") == "P", " ").otherwise("t").alias("title")
    )
    return ingest.ingest_summary(records, ["external_id", "title"])


def supplier_profiles(spark, sf):
    return table(spark, sf, "supplier").select(
        F.lower("s_name").alias("key"),
        F.array(F.concat(F.lit("alias-"), "s_suppkey"), F.concat(F.lit("old-"), "s_suppkey")).alias("aliases"),
        (F.col("s_acctbal") > 0).alias("supports_sale"),
        (F.col("s_acctbal") > 5000).alias("supports_rent"),
        (F.col("s_nationkey") < 12).alias("supports_neighborhood"),
    )


_PATTERN = {"com": '<li><a href="([^"]*)"', "net": "<p>([^<]+)", "org": "<b>([^<]*)"}
_KIND = f"regexp_extract({_HOST}, '[a-z]+$')"


@query(
    "m1_profiles",
    f"SELECT kind, count(*) AS pages, CAST(sum(n) AS BIGINT) AS cards FROM (SELECT {_KIND} AS kind, CASE {_KIND} "
    + " ".join(f"WHEN '{k}' THEN len(regexp_extract_all(html, '{v}', 1))" for k, v in _PATTERN.items())
    + " END AS n FROM pages) GROUP BY kind",
)
def m1(spark, sf):
    """Each page is read by the pattern its host's profile row holds."""
    raw = pages.read_pages(spark, f"{sf}/pages.parquet")
    kind = F.regexp_extract("host", "[a-z]+$", 0)
    rules = F.create_map(*[F.lit(x) for pair in _PATTERN.items() for x in pair])
    hosts = raw.select("host").distinct().select("host", kind.alias("kind"), rules[kind].alias("card_pattern"))
    cards = F.size(F.regexp_extract_all("html", F.col("card_pattern"), F.lit(1)))
    return profiles.with_profile(raw, hosts).groupBy("kind").agg(F.count("*").alias("pages"), F.sum(cards).alias("cards"))


@query(
    "m2_capabilities",
    """SELECT lower(s_name) AS key, 'SALE' AS purpose FROM supplier WHERE s_acctbal > 0 AND s_nationkey < 12
      UNION ALL SELECT lower(s_name), 'RENT' FROM supplier WHERE s_acctbal > 5000""",
)
def m2(spark, sf):
    known = supplier_profiles(spark, sf)
    sale = profiles.supports_scope(known, "SALE", neighborhood=True).select("key", F.lit("SALE").alias("purpose"))
    return sale.unionByName(profiles.supports_scope(known, "RENT").select("key", F.lit("RENT").alias("purpose")))


@query(
    "m3_aliases",
    """SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 'alias-' || user_id WHEN event_type = 'error' THEN 'nobody'
        ELSE lower(s_name) END AS key, CASE WHEN event_type <> 'error' THEN lower(s_name) END AS source_key
      FROM events LEFT JOIN supplier ON s_suppkey = user_id""",
)
def m3(spark, sf):
    events = table(spark, sf, "events").join(table(spark, sf, "supplier"), F.col("user_id") == F.col("s_suppkey"), "left")
    asked = events.select(
        "event_id",
        F.when(F.col("event_type").isin("click", "view"), F.concat(F.lit(" ALIAS-"), "user_id"))
        .when(F.col("event_type") == "error", "nobody")
        .otherwise(F.col("s_name"))
        .alias("key"),
    )
    return profiles.resolve_aliases(asked, supplier_profiles(spark, sf)).select("event_id", "key", "source_key")
