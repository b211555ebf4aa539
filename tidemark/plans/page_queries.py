"""Registered queries for page extraction.

The raw pages carry titles, headings, links and paragraphs. For the jobs that need prices,
galleries and tables, a listing page is put together from each order.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extract
from ..sources.pages import read_pages
from .bindings import spread, table, with_
from .registry import query
from .sqltext import sql_br, sql_space

SITE = "https://www.site.test"


def _br(c):
    return F.translate(F.format_number(c, 2), ",.", ".,")


def listing_pages(spark, sf):
    """A listing's detail page for every order."""
    key, price = F.col("o_orderkey").cast("string"), F.concat(F.lit("R$ "), _br(F.col("o_totalprice")))
    status, rank = F.col("o_orderstatus"), F.col("o_orderpriority")
    html = F.concat(
        F.lit('<!DOCTYPE html><html><head><title>Casa &amp; '), rank, F.lit(" - "), key, F.lit("</title>"),
        F.when(status != "F", F.concat(F.lit("<link href='/imovel/casa/"), key, F.lit("?utm_source=x' rel=\"canonical\">"))).otherwise(""),
        F.lit('<meta content=" /img/'), key, F.lit('.jpg " property="og:image"><style>b{}</style></head><body class="a postid-'), key, F.lit('">'),
        F.lit("<!-- <p>nada</p> --><h1>Casa</h1><dl><dt>Valor:</dt><dd><b>"), price, F.lit("</b></dd><dt>Bairro</dt><dd>"), rank, F.lit("</dd></dl>"),
        F.lit("<table><tr><th>Vagas</th><td>2</td></tr></table><p>IPTU: R$ 100</p>"),
        F.lit("<div><h2>Sobre o Imóvel</h2><p>Casa "), rank, F.lit("</p><p>casa  "), F.lower(rank), F.lit("</p><p>Cliente "),
        F.col("o_custkey").cast("string"), F.lit("</p></div>"),
        F.lit("<div><h2>Detalhes</h2><ul><li>Varanda</li><li>"), status, F.lit("</li><li>VARANDA</li></ul></div>"),
        F.lit('<div><h3>Pontos de Interesse</h3><div><span class="type">Metrô</span><span class="name">Estação '), key,
        F.lit('</span><span class="distance">'), F.col("o_custkey").cast("string"), F.lit(" m</span></div>"),
        F.lit('<div><b class="type">Parque</b><i class="distance">1,5 km</i></div></div>'),
        F.lit('<script type="application/ld+json">{"@type":"X","image":["/ld/'), key, F.lit('.jpg","/ld/a.gif"],"o":[{"url":"/ld/b.PNG"},{"image":"/LD/'),
        key, F.lit('.jpg"}]}</script><script>bad json</script>'),
        F.lit('<a href="/g/'), key, F.lit('.webp?utm_term=1"><img data-src="/g/t.png" src="/g/s.jpg" srcset="/g/1.jpg 300w, /g/2.jpg 600w"></a>'),
        F.lit('<img src="data:x"><a class="page-numbers" href="/p/7">7</a>'),
        F.when(status == "O", '<a class="x next" href="/p/next?gclid=1">&gt;</a>').otherwise(""),
        F.when(status == "P", '<link rel="next" href="/p/rel">').otherwise(""),
        F.lit("<b>"), F.translate(F.format_number(F.col("o_custkey"), 0), ",", "."), F.lit(" RESULTADOS</b>"),
        F.lit('<script>var m="https://maps/?q=RUA+A";var n="https://maps/?z=1&q=RUA+'), key, F.lit("+PINHEIROS%2C+SAO+PAULO+-+SP+CEP+01310-"),
        F.lpad((F.col("o_custkey") % 1000).cast("string"), 3, "0"), F.lit('";</script>'),
        F.lit("<p>Venda "), price, F.lit(" ou Locação  R$ 1.500,00 e venda R$ 9,90</p></body></html>"),
    )
    # Through explode the page is made once; as a plain column it would be made anew wherever it is named.
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority", "o_custkey")
    return spread(orders).select(
        F.col("o_orderkey").alias("page_id"), F.explode(F.array(html)).alias("html"), "o_orderstatus", "o_custkey"
    )


_TITLE = r"replace(replace(regexp_extract(html, '<title>(.*?)</title>', 1), '&lt;', '<'), '&amp;', '&')"


@query(
    "j1_page_meta",
    f"""SELECT page_id, {sql_space(_TITLE)} AS title, {sql_space("replace(regexp_extract(html, '<h1>(.*?)</h1>', 1), '&amp;', '&')")} AS h1,
        NULL AS canonical_url, NULL AS post_id FROM pages""",
)
def j1(spark, sf):
    return extract.page_meta(table(spark, sf, "pages"), base=SITE)


@query(
    "j1_listing_meta",
    """SELECT o_orderkey AS page_id, 'Casa & ' || o_orderpriority || ' - ' || o_orderkey AS title, 'Casa' AS h1,
        CASE WHEN o_orderstatus <> 'F' THEN 'https://www.site.test/imovel/casa/' || o_orderkey END AS canonical_url,
        '' || o_orderkey AS post_id, '/img/' || o_orderkey || '.jpg' AS og_image FROM orders""",
)
def j1_listing(spark, sf):
    return extract.page_meta(listing_pages(spark, sf), ["og:image"], SITE)


_CLEAN = r"regexp_replace(html, '(?is)<!--.*?-->|<!doctype[^>]*>|<script\b.*?</script>|<style\b.*?</style>', '<br>', 'g')"
_ENT = "replace(replace(replace(replace(replace(replace(w, '&quot;', chr(34)), '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"


@query(
    "j2_visible_text",
    f"""SELECT page_id, count(*) AS pieces, md5(string_agg(t, '|' ORDER BY n)) AS text FROM (
      SELECT page_id, n, {sql_space(_ENT)} AS t FROM (SELECT page_id, unnest(p) AS w, generate_subscripts(p, 1) AS n FROM (
        SELECT page_id, string_split_regex({_CLEAN}, '<[^>]*>') AS p FROM pages))) WHERE t <> '' GROUP BY page_id""",
)
def j2(spark, sf):
    rows = extract.visible_text(table(spark, sf, "pages"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda e: e["text"]), "|")
    return rows.groupBy("page_id").agg(F.count("*").alias("pieces"), F.md5(joined).alias("text"))


_CARDS = r"""cards AS (SELECT *, id <> '' AND row_number() OVER (PARTITION BY page_id, id ORDER BY position) > 1 AS again FROM (
    SELECT *, regexp_extract(card, '>([A-Za-z]+)</a>', 1) AS id FROM (
      SELECT page_id, unnest(c) AS card, CAST(generate_subscripts(c, 1) AS INTEGER) AS position FROM (
        SELECT page_id, regexp_extract_all(html, '<li>(.*?)</li>', 1) AS c FROM pages))))"""
_CARD_ROWS = """SELECT page_id, position, nullif(id, '') AS card_id, nullif(regexp_extract(card, 'href="([^"]+)"', 1), '') AS card_url,
        CASE WHEN id = '' THEN 'missing id' WHEN again THEN 'duplicate id' END AS error FROM cards"""


def menu_profiles(raw):
    """Menu entries as cards: the id is an entry's text if it is one word of letters."""
    return raw.select("host").distinct().select(
        "host", F.lit("<li>(.*?)</li>").alias("card_pattern"), F.lit(">([A-Za-z]+)</a>").alias("id_pattern"),
        F.lit('href="([^"]+)"').alias("url_pattern"),
    )


def menu_cards(spark, sf):
    raw = read_pages(spark, f"{sf}/pages.parquet")
    return extract.split_cards(raw, menu_profiles(raw))


def menu_entries(html: str):
    """The menu entries of a page, cut out by hand."""
    for piece in html.split("<li>")[1:]:
        card, closed, _ = piece.partition("</li>")
        if closed:
            url, _, text = card.partition('href="')[2].partition('"')
            label = text.rpartition(">")[0].rpartition(">")[2].removesuffix("</a")
            yield card, label if label.isascii() and label.isalpha() else None, url


@query("j3_split_cards", with_(_CARDS) + _CARD_ROWS)
def j3(spark, sf):
    return menu_cards(spark, sf).select("page_id", "position", "card_id", "card_url", "error")


@query(
    "j3_card_counts",
    with_(_CARDS)
    + """SELECT page_id, count(*) AS raw_cards, count(*) FILTER (id = '' OR again) AS invalid_cards
      FROM cards GROUP BY page_id""",
)
def j3_counts(spark, sf):
    return extract.card_counts(menu_cards(spark, sf))


@query("m1_read_cards", with_(_CARDS) + _CARD_ROWS)
def m1_cards(spark, sf):
    """Hosts under .com have a reading function of their own, the others patterns."""
    raw = read_pages(spark, f"{sf}/pages.parquet")
    profiles = menu_profiles(raw).withColumn("reader", F.when(F.col("host").endswith(".com"), "menu"))
    found = extract.read_cards(raw, profiles, {"menu": menu_entries})
    return found.select("page_id", "position", "card_id", "card_url", "error")


@query(
    "j4_labelled_values",
    f"""SELECT o_orderkey AS page_id, 'R$ ' || {sql_br('o_totalprice')} AS valor, o_orderpriority AS bairro, 'R$ 100' AS iptu,
      '2' AS vagas FROM orders""",
)
def j4(spark, sf):
    rows = extract.labelled_values(listing_pages(spark, sf), ["valor", "bairro", "iptu"])
    return rows.select("page_id", "valor", "bairro", "iptu", F.try_element_at("unknown", F.lit("Vagas")).alias("vagas"))


@query(
    "j5_links_and_images",
    """SELECT o_orderkey AS page_id, 'https://www.site.test/g/' || o_orderkey || '.webp|https://www.site.test/p/7' ||
        CASE WHEN o_orderstatus = 'O' THEN '|https://www.site.test/p/next' ELSE '' END AS links,
      'https://www.site.test/g/' || o_orderkey || '.webp|https://www.site.test/g/t.png|https://www.site.test/g/s.jpg|https://www.site.test/g/2.jpg' AS images
      FROM orders""",
)
def j5(spark, sf):
    return extract.links_and_images(listing_pages(spark, sf), SITE).select(
        "page_id", F.array_join("links", "|").alias("links"), F.array_join("images", "|").alias("images")
    )


@query(
    "j6_sections",
    """SELECT o_orderkey AS page_id, 'sobre o imovel' AS heading, 'Casa ' || o_orderpriority || chr(10) || chr(10) || 'Cliente ' || o_custkey AS text,
        'Casa ' || o_orderpriority || '|Cliente ' || o_custkey AS items FROM orders
      UNION ALL SELECT o_orderkey, 'Detalhes', 'Varanda' || chr(10) || chr(10) || o_orderstatus, 'Varanda|' || o_orderstatus FROM orders""",
)
def j6(spark, sf):
    found = extract.sections(listing_pages(spark, sf), ["sobre o imovel", "Detalhes", "Não existe"])
    return found.withColumn("items", F.array_join("items", "|"))


@query("j7_reported_total", "SELECT o_orderkey AS page_id, CAST(o_custkey AS INTEGER) AS reported_total FROM orders")
def j7(spark, sf):
    return extract.reported_total(listing_pages(spark, sf))


@query(
    "j8_next_url",
    """SELECT o_orderkey AS page_id, CASE o_orderstatus WHEN 'P' THEN 'https://www.site.test/p/rel' WHEN 'O' THEN 'https://www.site.test/p/next'
      ELSE CASE WHEN o_custkey > 500 THEN 'https://www.site.test/p/7' END END AS next_url FROM orders""",
)
def j8(spark, sf):
    pages = listing_pages(spark, sf).withColumn("page", F.when(F.col("o_custkey") > 500, 6).otherwise(2))
    return extract.next_url(pages, SITE)


@query(
    "j9_identity_check",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(c, u) AS external_id,
      CASE WHEN c <> u THEN 'external_id mismatch card=' || c || ' url=' || u WHEN coalesce(c, u, r) IS NULL THEN 'missing external_id'
        WHEN coalesce(c, u, r) <> r THEN 'expected ' || r || ', got ' || coalesce(c, u) END AS reason FROM (
      SELECT *, CASE WHEN l_returnflag <> 'N' THEN '' || l_partkey END AS c, CASE WHEN l_linestatus = 'O' THEN '' || CASE WHEN l_linenumber = 2
        THEN l_suppkey ELSE l_partkey END END AS u, CASE WHEN l_linenumber > 4 THEN '' || l_partkey WHEN l_linenumber = 4 THEN 'x' END AS r FROM lineitem)""",
)
def j9(spark, sf):
    line, part = F.col("l_linenumber"), F.col("l_partkey").cast("string")
    cards = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.when(F.col("l_returnflag") != "N", part).alias("card_id"),
        F.when(F.col("l_linestatus") == "O", F.when(line == 2, F.col("l_suppkey").cast("string")).otherwise(part)).alias("url_id"),
        F.when(line > 4, part).when(line == 4, "x").alias("requested_id"),
    )
    return extract.identity_check(cards).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "external_id", "reason")


@query(
    "j10_offers_from_labels",
    """SELECT o_orderkey AS page_id, 'rent' AS purpose, 1500.00::DECIMAL(18,2) AS price, 'BRL' AS currency, 'Locação' AS raw_label FROM orders
      UNION ALL SELECT o_orderkey, 'sale', 9.90::DECIMAL(18,2), 'BRL', 'venda' FROM orders""",
)
def j10(spark, sf):
    from ..functions.markup import flat_text

    return extract.offers_from_labels(listing_pages(spark, sf).select("page_id", flat_text("html").alias("text")))


@query(
    "j11_jsonld_images",
    """SELECT o_orderkey AS page_id, 'https://www.site.test/ld/' || o_orderkey || '.jpg|https://www.site.test/ld/b.PNG' AS urls FROM orders""",
)
def j11(spark, sf):
    return extract.jsonld_images(listing_pages(spark, sf), SITE).select("page_id", F.array_join("urls", "|").alias("urls"))


@query(
    "j12_nearby_points",
    """SELECT o_orderkey AS page_id, 1 AS position, 'Metrô' AS type, 'Estação ' || o_orderkey AS name, o_custkey || ' m' AS distance_text,
        CAST(o_custkey AS INTEGER) AS distance_meters FROM orders
      UNION ALL SELECT o_orderkey, 2, 'Parque', NULL, '1,5 km', 1500 FROM orders""",
)
def j12(spark, sf):
    return extract.nearby_points(listing_pages(spark, sf))


@query(
    "j13_address_from_query",
    """SELECT o_orderkey AS page_id, 'RUA ' || o_orderkey AS address_line, 'Pinheiros' AS neighborhood, 'São Paulo' AS city, 'SP' AS state,
      '01310-' || lpad('' || o_custkey % 1000, 3, '0') AS postal_code FROM orders""",
)
def j13(spark, sf):
    return extract.address_from_query(listing_pages(spark, sf).withColumn("area", F.lit("Pinheiros")), "area")


_NOISE = """CASE WHEN contains(url, 'utm_source') THEN ' CAPTCHA ' WHEN contains(url, '#top') THEN '<b>Access Denied</b> g-recaptcha'
  WHEN contains(url, '.html') THEN 'desafio: Complete o Desafio' ELSE '' END"""


@query(
    "j14_challenge_terms",
    f"""SELECT page_id, concat_ws('|', CASE WHEN contains(h, 'captcha') THEN 'captcha' END, CASE WHEN contains(h, 'recaptcha') THEN 'recaptcha' END,
        CASE WHEN contains(h, 'access denied') THEN 'access denied' END) AS matched,
      concat_ws('|', CASE WHEN contains(h, 'complete o desafio') THEN 'Complete o desafio' END, CASE WHEN contains(h, 'access denied') THEN 'access denied' END) AS blocking,
      contains(h, 'complete o desafio') OR contains(h, 'access denied') AS challenge_detected, contains(h, 'g-recaptcha') AS captcha_detected
      FROM (SELECT page_id, lower(html || {_NOISE}) AS h FROM pages)""",
)
def j14(spark, sf):
    noise = F.expr(_NOISE)
    pages = table(spark, sf, "pages").select("page_id", F.concat("html", noise).alias("html"))
    return extract.challenge_terms(pages).select(
        "page_id", F.array_join("matched_terms", "|").alias("matched"), F.array_join("blocking_terms", "|").alias("blocking"),
        "challenge_detected", "captcha_detected",
    )


@query(
    "j15_probe_result",
    """SELECT event_id, CASE WHEN NOT content AND event_type = 'error' THEN 'CAPTCHA_REQUIRED'
        WHEN NOT content AND event_type IN ('error', 'view') THEN 'SECURITY_CHALLENGE' WHEN NOT content THEN 'CONTENT_NOT_FOUND'
        WHEN k < 60 THEN 'SUCCESS' WHEN k < 75 THEN 'ENDPOINT_BLOCKED' WHEN k < 90 THEN 'ENDPOINT_INVALID_RESPONSE' ELSE 'SUCCESS' END AS result
      FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, value > 100 OR (value > 60 AND event_type = 'view') AS content FROM events)""",
)
def j15(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")
    probes = table(spark, sf, "events").select(
        "event_id",
        F.when(kind == "view", "Casas à VENDA").otherwise("Casas").alias("title"),
        F.when(F.col("value") > 100, 5).otherwise(0).alias("cards_count"),
        F.when(F.col("value") > 60, 3).otherwise(0).alias("listing_keys_count"),
        (kind == "error").alias("captcha_detected"),
        kind.isin("error", "view").alias("challenge_detected"),
        (k >= 60).alias("attempted"),
        F.when(k >= 75, 200).alias("endpoint_status"),
        (k >= 80).alias("json_valid"),
        F.lit("application/json; charset=utf-8").alias("content_type"),
        (k >= 85).alias("has_data"), F.lit(True).alias("has_count"), (k >= 90).alias("has_aggs"),
    )
    return extract.probe_result(probes).select("event_id", "result")


@query(
    "j16_health_status",
    f"""SELECT page_id, CASE WHEN contains(url, '?page=2') THEN 'BLOCKED' WHEN contains(lower(substr({_NOISE} || html, 1, 5000)), 'captcha') OR
        contains(lower(substr({_NOISE} || html, 1, 5000)), 'access denied') THEN 'BLOCKED' WHEN contains(url, '/es/') THEN 'DEGRADED'
        WHEN n = 0 THEN 'STRUCTURE_CHANGED' WHEN bad > n // 2 THEN 'DEGRADED' ELSE 'HEALTHY' END AS health
      FROM (SELECT *, len(regexp_extract_all(html, '<p>')) AS n, len(regexp_extract_all(html, '<b>')) * 3 AS bad FROM pages)""",
)
def j16(spark, sf):
    count = lambda p: F.size(F.regexp_extract_all("html", F.lit(f"({p})"), F.lit(1)))
    pages = table(spark, sf, "pages").select(
        "page_id",
        F.concat(F.expr(_NOISE), "html").alias("html"),
        F.when(F.col("url").contains("?page=2"), 429).otherwise(200).alias("http_status"),
        F.when(F.col("url").contains("/es/"), "application/pdf").otherwise("text/HTML; charset=utf-8").alias("content_type"),
        count("<p>").alias("raw_cards"),
        count("<p>").alias("valid_cards"),
        (count("<b>") * 3).alias("invalid_cards"),
        F.lit(False).alias("fetch_failed"),
        F.lit(False).alias("parse_failed"),
    )
    return extract.health_status(pages).select("page_id", "health")


@query(
    "j17_legacy_cards",
    """SELECT CASE WHEN p_type = 'LARGE' THEN 'ad' || p_partkey ELSE 'https://old.test/i/' || p_partkey END AS external_id,
      CASE WHEN p_type = 'SMALL' THEN 'ver' ELSE p_name END AS title, CASE WHEN p_type = 'MEDIUM' THEN 0.0 ELSE p_retailprice END::DOUBLE AS price,
      'https://old.test/i/' || p_partkey AS url, CASE WHEN p_type = 'PROMO' THEN 'Não informado' ELSE p_type END AS city,
      CASE WHEN p_type = 'PROMO' THEN '' ELSE p_brand END AS neighborhood, p_size AS bedrooms, NULL::INTEGER AS bathrooms, 70.5::DOUBLE AS area_m2,
      'https://cdn.test/' || p_partkey || '.jpg' AS main_image FROM part WHERE p_type <> 'STANDARD'""",
)
def j17(spark, sf):
    kind, part = F.col("p_type"), F.col("p_partkey").cast("string")
    article = F.concat(
        F.lit("<article "), F.when(kind == "LARGE", F.concat(F.lit('data-adid="ad'), part, F.lit('"'))).otherwise(""), F.lit(">"),
        F.when(kind != "STANDARD", F.concat(F.lit('<a href="/i/'), part, F.lit('">ver</a>'))).otherwise(""),
        F.when(kind != "SMALL", F.concat(F.lit("<h2>"), F.col("p_name"), F.lit("</h2>"))).otherwise(""),
        F.when(kind != "MEDIUM", F.concat(F.lit("<b>R$ "), _br(F.col("p_retailprice")), F.lit("</b>"))).otherwise(""),
        F.lit("<span>"), F.col("p_size"), F.lit(" Quartos</span><span>70,5 m²</span>"),
        F.when(kind != "PROMO", F.concat(F.lit('<span class="item-location">'), F.col("p_brand"), F.lit(" | "), kind, F.lit("</span>"))).otherwise(""),
        F.lit('<img src="/x.jpg" data-src="//cdn.test/'), part, F.lit('.jpg"></article>'),
    )
    parts = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")
    pages = spread(parts).select(F.col("p_partkey").alias("page_id"), article.alias("html"))
    return extract.legacy_cards(pages, "https://old.test").drop("page_id", "position", "description")


@query(
    "j18_card_flags",
    """SELECT p_partkey, p_type IN ('SMALL', 'LARGE') AS new_listing, p_type IN ('LARGE', 'PROMO') AS exclusive,
      CASE WHEN p_size > 25 THEN 'linha-azul|linha-verde-água' ELSE 'linha-azul' END AS metro_lines,
      CASE p_type WHEN 'SMALL' THEN 'Anúncio Novo' WHEN 'LARGE' THEN 'Anúncio Novo|Exclusivo' WHEN 'PROMO' THEN 'Exclusivo' ELSE '' END AS tags FROM part""",
)
def j18(spark, sf):
    kind = F.col("p_type")
    card = F.concat(
        F.lit('<div class="card linha-azul">'),
        F.when(kind.isin("SMALL", "LARGE"), "<span> Anúncio   NOVO </span>").otherwise("<span>anuncio novo já</span>"),
        F.when(kind.isin("LARGE", "PROMO"), "<b>EXCLUSIVO</b>").otherwise(""),
        F.when(F.col("p_size") > 25, "<i class='x linha-verde-água linha-azul'></i>").otherwise(""),
        F.lit("</div>"),
    )
    flags = extract.card_flags(table(spark, sf, "part").withColumn("card", card))
    return flags.select(
        "p_partkey", "new_listing", "exclusive", F.array_join("metro_lines", "|").alias("metro_lines"), F.array_join("tags", "|").alias("tags")
    )
