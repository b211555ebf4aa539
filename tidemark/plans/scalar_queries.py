"""Registered queries for the column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays, hashing, numbers, text, urls
from .bindings import LISTINGS, SIGHTINGS, listings, sightings, spread, table, with_
from .registry import query
from .sqltext import (
    sql_br, sql_decimal, sql_fold, sql_key, sql_money, sql_space, sql_title, sql_untracked,
)

SITE = "https://www.site.test/lista/"


def _br(c, places: int = 2):
    """A number written the Brazilian way."""
    return F.translate(F.format_number(c, places), ",.", ".,")


@query(
    "i1_normalize_space",
    f"SELECT doc_id, length({sql_space('text')}) AS n, md5({sql_space('text')}) AS clean, "
    f"nullif({sql_space('substr(text, 1, 1)')}, '') AS first_char FROM documents",
)
def i1(spark, sf):
    clean = text.normalize_space("text")
    return table(spark, sf, "documents").select(
        "doc_id",
        F.length(clean).cast("bigint").alias("n"),
        F.md5(clean).alias("clean"),
        text.none_if_blank(F.substring("text", 1, 1)).alias("first_char"),
    )


@query(
    "i2_title_location",
    f"SELECT doc_id, md5({sql_title('text')}) AS titled FROM documents WHERE {sql_space('text')} <> '' "
    f"UNION ALL SELECT c_custkey, {sql_title('''c_name || '  ' || c_mktsegment''')} FROM customer",
)
def i2(spark, sf):
    docs = table(spark, sf, "documents").filter(text.normalize_space("text") != "")
    people = table(spark, sf, "customer")
    return docs.select("doc_id", F.md5(text.title_location("text")).alias("titled")).unionAll(
        people.select("c_custkey", text.title_location(F.concat("c_name", F.lit("  "), "c_mktsegment")))
    )


_I3 = f"""(SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
    'R$ ' || {sql_br('l_extendedprice')} AS price_text,
    {sql_br('floor(l_extendedprice)', 0)} || ' reais' AS whole_text,
    CAST(l_partkey AS VARCHAR) || '.' || l_linenumber || '5 m' AS dot_text,
    'taxa ' || l_returnflag AS bad_text,
    CAST(l_partkey AS VARCHAR) || ',' || l_linenumber || '25 m²' AS tie_text FROM lineitem)"""


def _number_texts(spark, sf):
    number, part = F.col("l_linenumber"), F.col("l_partkey")
    return table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        F.concat(F.lit("R$ "), _br(F.col("l_extendedprice"))).alias("price_text"),
        F.concat(_br(F.floor("l_extendedprice"), 0), F.lit(" reais")).alias("whole_text"),
        F.concat(part, F.lit("."), number, F.lit("5 m")).alias("dot_text"),
        F.concat(F.lit("taxa "), "l_returnflag").alias("bad_text"),
        F.concat(part, F.lit(","), number, F.lit("25 m²")).alias("tie_text"),
    )


@query(
    "i3_parse_decimal_br",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {sql_decimal('price_text')} AS price,
      {sql_decimal('whole_text')} AS whole, {sql_decimal('dot_text')} AS dotted,
      {sql_decimal('bad_text')} AS bad FROM {_I3}""",
)
def i3(spark, sf):
    return _number_texts(spark, sf).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        numbers.parse_decimal_br("price_text").alias("price"),
        numbers.parse_decimal_br("whole_text").alias("whole"),
        numbers.parse_decimal_br("dot_text").alias("dotted"),
        numbers.parse_decimal_br("bad_text").alias("bad"),
    )


@query(
    "i4_parse_money",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {sql_money('price_text')} AS price,
      {sql_money('tie_text')} AS area FROM {_I3}""",
)
def i4(spark, sf):
    return _number_texts(spark, sf).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        numbers.parse_money("price_text").alias("price"),
        numbers.parse_area("tie_text").alias("area"),
    )


@query("i5_normalize_key", f"SELECT doc_id, md5({sql_key('text')}) AS key FROM documents")
def i5(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(text.normalize_key("text")).alias("key"))


@query(
    "i6_normalize_purpose",
    with_(SIGHTINGS) + "SELECT purpose AS raw, norm_purpose AS purpose, count(*) AS n FROM sightings GROUP BY 1, 2",
)
def i6(spark, sf):
    return (
        sightings(spark, sf)
        .groupBy(F.col("purpose").alias("raw"), text.normalize_purpose("purpose").alias("purpose"))
        .agg(F.count("*").alias("n"))
    )


_TAG_TEXT = {
    "ECONOMY": "Imóvel em DESTAQUE",
    "LARGE": "tour em VÍDEO, aceita permuta",
    "MEDIUM": "Planta  Modificada",
    "PROMO": "Decorado com IA",
    "SMALL": "visita 360º",
}
_WORDS = {"the ": "English", " der ": "Deutsch", "que": "Romance"}


@query(
    "i7_known_tag",
    "SELECT 'd' || doc_id AS id, CASE "
    + " ".join(f"WHEN contains({sql_key('text')}, '{k}') THEN '{v}'" for k, v in _WORDS.items())
    + " END AS tag FROM documents UNION ALL SELECT 'p' || p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'Destaque' "
    "WHEN 'LARGE' THEN 'Vídeo' WHEN 'MEDIUM' THEN 'Planta Modificada' WHEN 'PROMO' THEN 'Decorado com IA' "
    "WHEN 'SMALL' THEN '360º' END FROM part",
)
def i7(spark, sf):
    wording = F.col("p_type")
    for kind, words in _TAG_TEXT.items():
        wording = F.when(F.col("p_type") == kind, F.concat(F.lit(words + " "), "p_name")).otherwise(wording)
    docs = table(spark, sf, "documents").select(
        F.concat(F.lit("d"), "doc_id").alias("id"), text.known_tag("text", _WORDS).alias("tag")
    )
    return docs.unionAll(
        table(spark, sf, "part").select(F.concat(F.lit("p"), "p_partkey"), text.known_tag(wording))
    )


@query(
    "i8_strip_tracking",
    f"""SELECT page_id, {sql_untracked('url')} AS url,
      regexp_extract(url, '^[^?#]*') || '?gclid=1&b=2&b=3&utm_term=x&c=a+b#top' AS busy
      FROM pages""".replace("gclid=1&b=2&b=3&utm_term=x&c=a+b", "b=2&b=3&c=a+b&d="),
)
def i8(spark, sf):
    busy = F.concat(F.regexp_extract("url", "^[^?#]*", 0), F.lit("?gclid=1&b=2&b=3&utm_term=x&c=a%20b&d#top"))
    return table(spark, sf, "pages").select(
        "page_id", urls.strip_tracking("url").alias("url"), urls.strip_tracking(busy).alias("busy")
    )


_HREFS = r"""(SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages)"""


@query(
    "i9_absolute_url",
    f"""SELECT page_id, 'https://www.site.test' || href AS rooted,
      'https://www.site.test/lista/x' || href AS relative,
      'https://www.site.test' || href AS parent FROM {_HREFS}""",
)
def i9(spark, sf):
    href = F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("href")
    return table(spark, sf, "pages").select("page_id", href).select(
        "page_id",
        urls.absolute_url("href", SITE).alias("rooted"),
        urls.absolute_url(F.concat(F.lit("x"), "href"), SITE).alias("relative"),
        urls.absolute_url(F.concat(F.lit(".."), "href"), SITE).alias("parent"),
    )


_PATH = "regexp_extract(url, '^[a-z]+://[^/]*([^?#]*)', 1)"


@query(
    "i10_url_segments",
    f"""SELECT page_id, array_to_string(list_filter(string_split({_PATH}, '/'), lambda s: s <> ''), '|') AS segments,
      nullif(regexp_extract({_PATH}, '^/en/(.*?)/?$', 1), '') AS after_en,
      nullif(regexp_extract({_PATH}, '/(\\d+)/?$', 1), '') AS numeric_id FROM pages""",
)
def i10(spark, sf):
    parts = urls.url_segments("url")
    return table(spark, sf, "pages").select(
        "page_id",
        F.array_join(parts, "|").alias("segments"),
        F.array_join(urls.url_segments("url", "en"), "/").alias("after_en"),
        urls.last_numeric_segment(parts).alias("numeric_id"),
    )


@query(
    "i11_slug_to_name",
    f"""SELECT p_partkey, CASE WHEN slug = 'small-ring' THEN 'Anel Pequeno' ELSE {sql_title("replace(slug, '-', ' ')")} END
      AS name FROM (SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' THEN upper(replace(p_name, ' ', '-'))
      ELSE replace(p_name, ' ', '-') END AS slug FROM part)""",
)
def i11(spark, sf):
    slug = F.replace("p_name", F.lit(" "), F.lit("-"))
    slug = F.when(F.col("p_type") == "ECONOMY", F.upper(slug)).otherwise(slug)
    return table(spark, sf, "part").select(
        "p_partkey", text.slug_to_name(slug, {"small-ring": "Anel Pequeno"}).alias("name")
    )


@query(
    "i12_reference_code",
    """SELECT p_partkey, upper('z' || p_size || '-' || p_partkey) AS from_text,
      upper('z-' || p_partkey) AS from_url FROM part""",
)
def i12(spark, sf):
    said = F.concat(F.lit("Ref. "), F.lit("z"), "p_size", F.lit("-"), "p_partkey", F.lit(" / b-1"))
    url = F.concat(F.lit("https://x.test/imoveis/a1-7/z-"), "p_partkey", F.lit("/fotos?q=b-2"))
    return table(spark, sf, "part").select(
        "p_partkey", text.reference_code(said).alias("from_text"), text.reference_code_from_url(url).alias("from_url")
    )


@query(
    "i13_attributes_from_text",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
      CAST(l_quantity + 0.5 AS DECIMAL(18,2)) AS area_m2, l_linenumber AS bedrooms,
      CASE WHEN l_returnflag = 'A' THEN 2 END AS suites,
      CASE WHEN l_linestatus = 'O' THEN 3 WHEN l_returnflag = 'A' THEN 2 END AS bathrooms,
      CASE WHEN l_returnflag <> 'R' THEN CAST(l_suppkey AS INTEGER) END AS parking_spaces FROM lineitem""",
)
def i13(spark, sf):
    said = F.concat_ws(
        " | ",
        F.concat(F.translate(F.format_number(F.col("l_quantity") + 0.5, 1), ".", ","), F.lit(" M²")),
        F.concat("l_linenumber", F.lit(" Dormitórios")),
        F.when(F.col("l_returnflag") == "A", "2 Suítes"),
        F.when(F.col("l_linestatus") == "O", "3 banheiros"),
        F.when(F.col("l_returnflag") != "R", F.concat("l_suppkey", F.lit(" vagas"))),
    )
    found = numbers.attributes_from_text(said).alias("f")
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return spread(table(spark, sf, "lineitem").select(*keys, "l_quantity", "l_returnflag", "l_linestatus")).select(*keys, found).select(*keys, "f.*")


@query(
    "i14_infer_bathrooms",
    """SELECT p_partkey, nullif(CASE WHEN p_size > 25 THEN p_size ELSE 0 END
      + CASE WHEN p_type = 'LARGE' THEN 2 WHEN p_type = 'SMALL' THEN 1 ELSE 0 END, 0) AS bathrooms FROM part""",
)
def i14(spark, sf):
    features = F.when(F.col("p_type") == "LARGE", "Lavabo, Banheiro de mármore, WC Serviço").when(
        F.col("p_type") == "SMALL", "banho social"
    )
    suites = F.when(F.col("p_size") > 25, F.col("p_size"))
    return table(spark, sf, "part").select("p_partkey", numbers.infer_bathrooms(suites, features).alias("bathrooms"))


@query(
    "i15_distance_m",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
      l_partkey || CASE WHEN l_linestatus = 'O' THEN ',' || l_linenumber || ' km' ELSE ' m' END AS distance_text,
      CAST(CASE WHEN l_linestatus = 'O' THEN l_partkey * 1000 + l_linenumber * 100 ELSE l_partkey END AS INTEGER)
      AS distance_meters FROM lineitem""",
)
def i15(spark, sf):
    far = F.concat("l_partkey", F.lit(","), "l_linenumber", F.lit(" KM"))
    said = F.concat(
        F.lit("Metrô a "), F.when(F.col("l_linestatus") == "O", far).otherwise(F.concat("l_partkey", F.lit(" m")))
    )
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return table(spark, sf, "lineitem").select(*keys, numbers.distance_m(said).alias("d")).select(*keys, "d.*")


@query(
    "i16_money_text",
    f"SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN 'R$ ' || {sql_br('o_totalprice')} END AS money FROM orders",
)
def i16(spark, sf):
    said = F.when(
        F.col("o_orderstatus") != "P", F.concat(F.lit("por R$ "), _br(F.col("o_totalprice")), F.lit(" ou R$ 1,00"))
    ).otherwise("sob consulta")
    return table(spark, sf, "orders").select("o_orderkey", text.money_text(said).alias("money"))


@query(
    "i17_public_title",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'Casa ' || o_orderpriority
      WHEN o_orderstatus = 'F' THEN 'Casa ' || o_orderpriority
      ELSE 'Casa - 12' END AS title FROM orders""",
)
def i17(spark, sf):
    ident = F.col("o_orderkey").cast("string")
    title = (
        F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("Casa  "), "o_orderpriority", F.lit(" - Cód.: "), ident))
        .when(F.col("o_orderstatus") == "F", F.concat(F.lit("Casa "), "o_orderpriority", F.lit(" – 98765 - "), ident))
        .otherwise("Casa - 12 ")
    )
    return table(spark, sf, "orders").withColumn("id", ident).select(
        "o_orderkey",
        text.public_title(title, F.when(F.col("o_orderstatus") != "O", F.col("id"))).alias("title"),
    )


@query(
    "i18_compose_title",
    """SELECT p_partkey, CASE WHEN p_type = 'SMALL' THEN p_name WHEN p_type = 'LARGE' THEN p_type
      ELSE p_type || ' em ' || p_name END AS title FROM part""",
)
def i18(spark, sf):
    kind = F.when(F.col("p_type") != "SMALL", F.col("p_type"))
    area = F.when(F.col("p_type") != "LARGE", F.col("p_name")).otherwise("")
    return table(spark, sf, "part").select("p_partkey", text.compose_title(kind, area).alias("title"))


@query(
    "i19_postal_code",
    """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN lpad(CAST(o_custkey AS VARCHAR), 5, '0') || '-' ||
      lpad(CAST(o_custkey % 1000 AS VARCHAR), 3, '0') END AS postal_code FROM orders""",
)
def i19(spark, sf):
    joint = F.when(F.col("o_orderstatus") == "O", " ").otherwise("")
    code = F.concat(
        F.lit("CEP "), F.lpad(F.col("o_custkey").cast("string"), 5, "0"), joint,
        F.lpad((F.col("o_custkey") % 1000).cast("string"), 3, "0"), F.lit(", SP"),
    )
    return table(spark, sf, "orders").select(
        "o_orderkey", text.postal_code(F.when(F.col("o_orderstatus") != "F", code).otherwise("12-345")).alias("postal_code")
    )


@query(
    "i20_coordinates",
    """SELECT c_custkey, CASE WHEN c_nationkey <> 3 THEN CAST(-c_nationkey - 0.540499 AS DECIMAL(9,6)) END AS latitude,
      CASE WHEN c_nationkey <> 3 THEN CAST(c_nationkey AS DECIMAL(9,6)) END AS longitude FROM customer""",
)
def i20(spark, sf):
    link = F.concat(F.lit("https://maps.test/?center=-"), "c_nationkey", F.lit(".540499,"), "c_nationkey")
    link = F.when(F.col("c_nationkey") != 3, link).otherwise("https://maps.test/?center=none")
    return table(spark, sf, "customer").select("c_custkey", numbers.coordinates(link).alias("p")).select("c_custkey", "p.*")


@query(
    "i21_largest_srcset",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
      CASE WHEN l_partkey > 800 THEN 'a.jpg' WHEN l_linenumber = 7 THEN 'c.jpg' ELSE 'b.jpg' END AS url
      FROM lineitem""",
)
def i21(spark, sf):
    tail = F.when(F.col("l_linenumber") == 7, ",  c.jpg 800w").otherwise(", c.jpg")
    entry = F.concat(F.lit("a.jpg "), "l_partkey", F.lit("w, b.jpg 800w"), tail)
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", urls.largest_srcset(entry).alias("url")
    )


@query(
    "i22_background_image",
    """SELECT p_partkey, CASE WHEN p_type NOT IN ('SMALL', 'LARGE')
      THEN 'https://www.site.test/f/' || p_partkey || '.jpg' END AS url FROM part""",
)
def i22(spark, sf):
    quote = F.when(F.col("p_type") == "PROMO", "'").otherwise("")
    suffix = F.when(F.col("p_type") == "SMALL", ".gif").otherwise(".jpg")
    rule = F.when(F.col("p_type") == "ECONOMY", "BACKGROUND: red url( ").otherwise("background-image : url(")
    style = F.when(F.col("p_type") == "LARGE", "color: red").otherwise(
        F.concat(F.lit("width:1px;"), rule, quote, F.lit("/f/"), "p_partkey", suffix, quote, F.lit(")"))
    )
    return table(spark, sf, "part").select("p_partkey", urls.background_image(style, SITE).alias("url"))


@query(
    "i23_upstream_ids",
    """SELECT p_partkey, CASE WHEN p_type <> 'SMALL' THEN 'vista' END AS upstream_platform,
      CASE WHEN p_type <> 'SMALL' THEN CAST(p_partkey AS VARCHAR) END AS upstream_numeric_id,
      CASE WHEN p_type = 'LARGE' THEN 'PI' || p_size END AS upstream_reference,
      CASE WHEN p_type <> 'LARGE' THEN 'REO' || p_size END AS reo_reference FROM part""",
)
def i23(spark, sf):
    small, large = F.col("p_type") == "SMALL", F.col("p_type") == "LARGE"
    given = F.array(
        F.when(~small, F.concat(F.lit("https://c.test/vista.imobi/fotos/"), "p_partkey", F.lit("/a.jpg"))),
        F.lit("https://c.test/vista.imobi/fotos/x/b.jpg"),
        F.when(~small, F.lit("https://c.test/vista.imobi/fotos/99/c.jpg")),
        F.when(large, F.concat(F.lit("https://c.test/imovel/PI/pi"), "p_size", F.lit("/d.jpg"))),
        F.when(~large, F.concat(F.lit("https://c.test/realestate/reo"), "p_size", F.lit("/e.jpg"))),
    )
    return table(spark, sf, "part").select("p_partkey", urls.upstream_ids(given).alias("u")).select("p_partkey", "u.*")


@query(
    "i24_unproxy_image",
    """SELECT p_partkey, CASE WHEN p_type = 'SMALL' THEN 'https://www.site.test/foto.php?url=%2Fa.jpg'
      WHEN p_type = 'LARGE' THEN 'https://www.site.test/x.jpg?url=https%3A%2F%2Fc.test%2Fa.jpg'
      ELSE 'https://c.test/' || p_partkey || '.jpg' END AS url FROM part""",
)
def i24(spark, sf):
    proxied = F.concat(F.lit("/foto.php?w=1&url=https%3A%2F%2Fc.test%2F"), "p_partkey", F.lit(".jpg&utm_term=1"))
    given = (
        F.when(F.col("p_type") == "SMALL", "/foto.php?url=/a.jpg")
        .when(F.col("p_type") == "LARGE", "/x.jpg?url=https://c.test/a.jpg")
        .otherwise(proxied)
    )
    return table(spark, sf, "part").select("p_partkey", urls.unproxy_image(given, SITE).alias("url"))


@query(
    "i25_valid_image_url",
    """SELECT p_partkey, CASE WHEN p_type NOT IN ('SMALL', 'LARGE') THEN 'https://www.site.test/i/' || p_partkey
      || CASE p_type WHEN 'PROMO' THEN '.JPEG' ELSE '.webp' END || '?v=1' END AS url FROM part""",
)
def i25(spark, sf):
    suffix = (
        F.when(F.col("p_type") == "PROMO", ".JPEG?v=1")
        .when(F.col("p_type") == "SMALL", ".svg?v=.png")
        .when(F.col("p_type") == "LARGE", "")
        .otherwise(".webp?v=1&fbclid=2")
    )
    return table(spark, sf, "part").select(
        "p_partkey", urls.valid_image_url(F.concat(F.lit("../i/"), "p_partkey", suffix), SITE).alias("url")
    )


@query(
    "i26_split_heading",
    f"""SELECT c_custkey, {sql_title('c_mktsegment')} AS kind, CASE WHEN c_nationkey > 5 THEN 'Residencial' END AS category,
      CASE WHEN c_nationkey > 15 THEN {sql_title("'VILA ' || c_name")} END AS area,
      'R A - B' AS address_line, {sql_title('c_mktsegment')} AS address_area FROM customer""",
)
def i26(spark, sf):
    head = F.concat_ws(
        " - ", "c_mktsegment",
        F.when(F.col("c_nationkey") > 5, "Residencial"),
        F.when(F.col("c_nationkey") > 15, F.concat(F.lit(" VILA "), "c_name")),
    )
    address = F.concat(F.lit("R A - B - "), "c_mktsegment")
    return (
        table(spark, sf, "customer")
        .select("c_custkey", text.split_heading(head).alias("h"), text.split_address(address).alias("s"))
        .select("c_custkey", "h.*", "s.address_line", F.col("s.area").alias("address_area"))
    )


@query(
    "i27_construction_year",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN CAST(year(o_orderdate) AS INTEGER) END AS year FROM orders""",
)
def i27(spark, sf):
    said = (
        F.when(F.col("o_orderstatus") == "O", F.concat(F.lit(" "), F.year("o_orderdate")))
        .when(F.col("o_orderstatus") == "F", F.concat(F.lit("em "), F.year("o_orderdate")))
        .otherwise("1799")
    )
    return table(spark, sf, "orders").select("o_orderkey", numbers.construction_year(said).alias("year"))


@query(
    "i28_stable_bucket",
    "SELECT c_custkey, CAST(CAST('0x' || substr(sha256(c_name), 1, 8) AS BIGINT) % 21 AS BIGINT) AS bucket FROM customer",
)
def i28(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", hashing.stable_bucket("c_name", 20).alias("bucket"))


@query(
    "i29_display_strings",
    with_(LISTINGS)
    + f"""SELECT external_id, CASE WHEN price IS NULL OR price = 0 THEN 'Preço não informado'
        ELSE 'R$' || chr(160) || {sql_br('price')} END AS price,
      CASE WHEN status = 'ACTIVE' AND property_subtype IS NOT NULL THEN property_subtype || ', ' || city
        WHEN status = 'ACTIVE' THEN city
        ELSE coalesce(property_subtype, 'Localização não informada') END AS location,
      CASE WHEN source_key = 'BUILDING' THEN 'Prédios' ELSE source_key END AS source FROM listings""",
)
def i29(spark, sf):
    city = F.when(F.col("status") == "ACTIVE", F.col("city"))
    return listings(spark, sf).select(
        "external_id",
        text.format_money("price").alias("price"),
        text.format_location(city, "property_subtype").alias("location"),
        text.source_label("source_key", {"BUILDING": "Prédios"}).alias("source"),
    )


@query(
    "i30_legacy_parsers",
    f"""SELECT p_partkey, CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS DOUBLE) AS price,
      CASE WHEN p_type = 'SMALL' THEN '' ELSE p_brand END AS area,
      CASE WHEN p_type = 'SMALL' THEN p_name ELSE p_type END AS city FROM part""",
)
def i30(spark, sf):
    address = F.when(F.col("p_type") == "SMALL", F.col("p_name")).otherwise(
        F.concat("p_brand", F.lit(" – "), "p_name", F.lit(", |"), "p_type")
    )
    return (
        table(spark, sf, "part")
        .select(
            "p_partkey",
            numbers.parse_number_simple(F.concat(F.lit("R$ "), _br(F.col("p_retailprice")))).alias("price"),
            text.parse_address(address).alias("a"),
        )
        .select("p_partkey", "price", "a.*")
    )


@query(
    "i31_json_safe",
    """SELECT event_id, '{"at":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') ||
      CASE WHEN strftime(ts, '%f') = '000000' THEN '' ELSE '.' || strftime(ts, '%f') END || '","k":' ||
      json_extract_string(props, '$.k') || ',"value":"' || CAST(value AS DECIMAL(12,2)) || '"}' AS payload FROM events""",
)
def i31(spark, sf):
    events = table(spark, sf, "events").select(
        "event_id",
        F.col("ts").alias("at"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.col("value").cast("decimal(12,2)").alias("value"),
    )
    types = dict(events.dtypes)
    return events.select(
        "event_id",
        hashing.canonical_json({n: hashing.json_safe(n, types[n]) for n in ("at", "k", "value")}).alias("payload"),
    )


_TAGS = "string_split(regexp_replace(text, '[.,\\n]', ' ', 'g'), ' ')"


@query(
    "d3_dedupe_array",
    f"""SELECT doc_id, count(DISTINCT {sql_fold(sql_space('w'))}) AS n FROM
      (SELECT doc_id, unnest({_TAGS}) AS w FROM documents) WHERE {sql_space('w')} <> '' GROUP BY doc_id""",
)
def d3(spark, sf):
    words = F.split(F.regexp_replace("text", r"[.,\n]", " "), " ")
    kept = arrays.dedupe_array(words)
    return (
        spread(table(spark, sf, "documents").select("doc_id", "text"))
        .select("doc_id", F.size(kept).cast("bigint").alias("n"))
        .filter("n > 0")
    )


@query(
    "d4_dedupe_urls",
    f"""SELECT page_id, string_agg(url, '|' ORDER BY pos) AS urls FROM (
      SELECT page_id, lower(href), arg_min('https://www.site.test' || href, pos) AS url, min(pos) AS pos FROM (
        SELECT page_id, unnest(h) AS href, generate_subscripts(h, 1) AS pos FROM (
          SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS h FROM pages))
      GROUP BY page_id, lower(href)) GROUP BY page_id""",
)
def d4(spark, sf):
    hrefs = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))
    tracked = F.transform(hrefs, lambda h: F.concat(h, F.lit("?utm_campaign=c")))
    both = F.concat(hrefs, tracked)
    return table(spark, sf, "pages").select(
        "page_id", F.array_join(arrays.dedupe_urls(both, SITE), "|").alias("urls")
    ).filter("urls <> ''")


@query(
    "d7_gallery",
    """SELECT p_partkey, CASE WHEN p_type = 'SMALL' THEN 'https://h.test/thumb/a.jpg'
      ELSE 'https://h.test/' || p_partkey || '.jpg|https://h.test/b.jpg' END AS urls FROM part""",
)
def d7(spark, sf):
    full = F.concat(F.lit("https://h.test/"), "p_partkey", F.lit(".jpg"))
    given = F.array(
        F.lit("https://h.test/thumb/a.jpg"),
        F.when(F.col("p_type") != "SMALL", full),
        F.lit("HTTPS://h.test/thumb/a.jpg"),
        F.when(F.col("p_type") != "SMALL", F.upper(full)),
        F.when(F.col("p_type") != "SMALL", F.lit("https://h.test/b.jpg")).otherwise(""),
    )
    return table(spark, sf, "part").select(
        "p_partkey", F.array_join(arrays.gallery(given, "(?i)^https://h.test/thumb/"), "|").alias("urls")
    )
