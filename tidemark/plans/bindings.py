"""The listing-shaped views of the given tables that the registered queries run on.

Each view exists twice, as a DataFrame and as the SQL of a common table expression, so that a
query and its oracle start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """A table's rows dealt evenly to all cores, for work that costs much more a row than reading it: a
    table of few bytes is read by a few tasks, one a row group. What more tasks read stays in as many."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(2 * cores, rows.rdd.getNumPartitions()))


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customer's nation as an inventory of listings."""
    orders, customer, nation = (table(spark, sf_dir, n) for n in ("orders", "customer", "nation"))
    return (
        orders.join(customer, orders.o_custkey == customer.c_custkey)
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("o_orderkey").cast("string").alias("external_id"),
            F.col("c_mktsegment").alias("source_key"),
            F.col("n_name").alias("city"),
            F.when(F.col("o_orderstatus") == "F", "MISSING").otherwise("ACTIVE").alias("status"),
            F.when(F.col("o_orderpriority") == "5-LOW", "Comercial")
            .when(F.col("o_orderpriority") != "4-NOT SPECIFIED", "Residencial")
            .alias("property_subtype"),
            F.when(
                ~((F.col("o_orderpriority") == "3-MEDIUM") & (F.col("o_orderstatus") == "P")),
                F.col("o_totalprice").cast("decimal(12,2)"),
            ).alias("price"),
            F.when(F.col("o_orderpriority") != "1-URGENT", F.dayofweek("o_orderdate")).alias("bedrooms"),
            F.col("c_acctbal").cast("decimal(12,2)").alias("area_m2"),
            F.when(F.col("o_orderpriority") != "2-HIGH", F.col("o_orderdate")).alias("updated_at"),
            (F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")).alias("last_seen_at"),
        )
    )


LISTINGS = """listings AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS external_id, c_mktsegment AS source_key, n_name AS city,
    CASE WHEN o_orderstatus = 'F' THEN 'MISSING' ELSE 'ACTIVE' END AS status,
    CASE WHEN o_orderpriority = '5-LOW' THEN 'Comercial'
         WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN 'Residencial' END AS property_subtype,
    CASE WHEN NOT (o_orderpriority = '3-MEDIUM' AND o_orderstatus = 'P')
         THEN CAST(o_totalprice AS DECIMAL(12,2)) END AS price,
    CASE WHEN o_orderpriority <> '1-URGENT' THEN CAST(dayofweek(o_orderdate) + 1 AS INTEGER) END AS bedrooms,
    CAST(c_acctbal AS DECIMAL(12,2)) AS area_m2,
    CASE WHEN o_orderpriority <> '2-HIGH' THEN o_orderdate END AS updated_at,
    o_orderdate + INTERVAL 1 DAY AS last_seen_at
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as listing cards: a run a day, a page an hour, in order of event id."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("external_id"),
        F.to_date("ts").alias("run_date"),
        (F.hour("ts") + 1).alias("page"),
        F.col("event_id").alias("position"),
        F.col("ts").alias("seen_at"),
        F.col("event_type"),
        F.col("value").cast("decimal(12,2)").alias("price"),
        F.when(F.col("event_type") == "purchase", "SALE")
        .when(F.col("event_type") == "view", "Rent ")
        .when(F.col("event_type") == "signup", "venda")
        .when(F.col("event_type") == "click", "Aluguel")
        .otherwise("permuta")
        .alias("purpose"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


SIGHTINGS = """sightings AS (
  SELECT CAST(user_id AS VARCHAR) AS external_id, CAST(ts AS DATE) AS run_date,
    CAST(hour(ts) + 1 AS INTEGER) AS page, event_id AS position, ts AS seen_at, event_type,
    CAST(value AS DECIMAL(12,2)) AS price,
    CASE event_type WHEN 'purchase' THEN 'SALE' WHEN 'view' THEN 'Rent ' WHEN 'signup' THEN 'venda'
         WHEN 'click' THEN 'Aluguel' ELSE 'permuta' END AS purpose,
    CASE event_type WHEN 'purchase' THEN 'SALE' WHEN 'view' THEN 'RENT' WHEN 'signup' THEN 'SALE'
         WHEN 'click' THEN 'RENT' ELSE 'PERMUTA' END AS norm_purpose,
    CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events)"""


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as gallery rows of their order; a row per (listing, url) is not yet assured."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("listing_id"),
        F.concat(F.lit("/fotos/"), F.col("l_linenumber"), F.lit(".jpg")).alias("url"),
        F.col("l_linenumber").alias("position"),
        (F.col("l_returnflag") != "R").alias("is_active"),
        F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("supp"),
        F.col("l_shipdate").alias("shipped"),
        F.col("l_extendedprice").alias("amount"),
    )


PHOTOS = """photos AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS listing_id, '/fotos/' || l_linenumber || '.jpg' AS url,
    l_linenumber AS position, l_returnflag <> 'R' AS is_active, l_partkey AS part, l_suppkey AS supp,
    l_shipdate AS shipped, l_extendedprice AS amount
  FROM lineitem)"""


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as offers of their order, several a purpose; ``seq`` orders them."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("listing_id"),
        F.when(F.col("l_linestatus") == "O", "venda").otherwise("Locação").alias("purpose"),
        F.col("l_extendedprice").cast("decimal(12,2)").alias("price"),
        F.when(F.col("l_returnflag") == "A", "ACTIVE")
        .when(F.col("l_returnflag") == "R", "removed")
        .alias("status"),
        F.struct("l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice").alias("seq"),
    )


OFFERS = """offers AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS listing_id,
    CASE WHEN l_linestatus = 'O' THEN 'SALE' ELSE 'RENT' END AS purpose,
    CAST(l_extendedprice AS DECIMAL(12,2)) AS price,
    CASE l_returnflag WHEN 'A' THEN 'ACTIVE' WHEN 'R' THEN 'removed' END AS status,
    l_linenumber AS q1, l_shipdate AS q2, l_partkey AS q3, l_suppkey AS q4, l_extendedprice AS q5
  FROM lineitem)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run log: one run per day and event type, which stands for the source."""
    cards = table(spark, sf_dir, "events").withColumn("run_date", F.to_date("ts"))
    # A run with fewer cards than others is still running or has failed.
    usual = cards.agg((F.count("*") / F.count_distinct("event_type", "run_date")).alias("n")).scalar()
    return (
        cards.groupBy(F.col("event_type").alias("source_key"), "run_date")
        .agg(
            F.min("ts").alias("started_at"),
            F.max("ts").alias("last_at"),
            F.count("*").alias("cards_seen"),
            F.countDistinct("user_id").alias("listings_seen"),
            F.countDistinct(F.hour("ts")).alias("pages_fetched"),
        )
        .select(
            F.concat_ws("-", "source_key", F.col("run_date").cast("string")).alias("run_id"),
            "source_key",
            "run_date",
            "started_at",
            F.when(F.col("cards_seen") >= usual * 0.825, F.col("last_at")).alias("finished_at"),
            "cards_seen",
            "listings_seen",
            "pages_fetched",
            F.when(F.dayofweek("run_date").isin(1, 7), "delta").otherwise("full").alias("mode"),
            F.when(F.col("cards_seen") < usual * 0.825, "running")
            .when(F.col("cards_seen") < usual * 0.93, "failed")
            .otherwise("success")
            .alias("status"),
            F.when(
                F.dayofweek("run_date") != 2,
                F.create_map(F.lit("purpose"), F.lit("sale"), F.lit("city"),
                             F.when(F.dayofweek("run_date") == 4, "santos").otherwise("sao-paulo")),
            ).alias("scope"),
        )
    )


RUNS = """runs AS (
  SELECT event_type || '-' || CAST(CAST(ts AS DATE) AS VARCHAR) AS run_id, event_type AS source_key,
    CAST(ts AS DATE) AS run_date, min(ts) AS started_at,
    CASE WHEN count(*) >= avg(count(*)) OVER () * 0.825 THEN max(ts) END AS finished_at, count(*) AS cards_seen,
    count(DISTINCT user_id) AS listings_seen, count(DISTINCT hour(ts)) AS pages_fetched,
    CASE WHEN dayofweek(CAST(ts AS DATE)) IN (0, 6) THEN 'delta' ELSE 'full' END AS mode,
    CASE WHEN count(*) < avg(count(*)) OVER () * 0.825 THEN 'running' WHEN count(*) < avg(count(*)) OVER () * 0.93 THEN 'failed' ELSE 'success' END AS status,
    CASE WHEN dayofweek(CAST(ts AS DATE)) = 1 THEN '{}'
         WHEN dayofweek(CAST(ts AS DATE)) = 3 THEN '{"city":"santos","purpose":"sale"}'
         ELSE '{"city":"sao-paulo","purpose":"sale"}' END AS scope_json
  FROM events GROUP BY event_type, CAST(ts AS DATE))"""


def page_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page log: each day's run has a page an hour; errors stand for invalid cards."""
    per_page = ["run_date", "page"]
    return (
        sightings(spark, sf_dir)
        .groupBy(*per_page)
        .agg(
            F.count("*").alias("raw_cards"),
            F.count_if(F.col("event_type") == "error").alias("invalid_cards"),
            F.max("k").alias("k"),
        )
        .select(
            F.col("run_date").cast("string").alias("run_id"),
            "page",
            "raw_cards",
            "invalid_cards",
            F.when(F.col("k") < 90, F.col("k")).alias("reported_total"),
            F.when(F.col("k") > 97, 429).otherwise(200).alias("http_status"),
        )
    )


PAGE_LOG = """page_log AS (
  SELECT CAST(run_date AS VARCHAR) AS run_id, page, count(*) AS raw_cards,
    count(*) FILTER (event_type = 'error') AS invalid_cards,
    CASE WHEN max(k) < 90 THEN max(k) END AS reported_total,
    CASE WHEN max(k) > 97 THEN 429 ELSE 200 END AS http_status
  FROM sightings GROUP BY run_date, page)"""


def with_(*views: str) -> str:
    return "WITH " + ",\n".join(views) + "\n"
