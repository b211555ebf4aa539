"""Page extraction on written-out pages."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import extract

SITE = "https://www.site.test"


def one(spark, html, **more):
    cols = {"page_id": 1, "html": html, **more}
    return spark.createDataFrame([tuple(cols.values())], list(cols))


def test_visible_text_follows_direct_parents(spark):
    html = "<p>a<!-- no --><form>no<b>yes</b></form><script>no</script><noscript>no<i>yes</i></noscript><br>b &eacute;"
    assert [r.text for r in extract.visible_text(one(spark, html)).orderBy("position").collect()] == ["a", "yes", "yes", "b é"]


def test_nested_sections(spark):
    html = """<div><div><h2>Sobre o <b>Imóvel</b></h2><div><p>Um</p><p>um </p></div><p>Dois</p></div></div>
      <section><strong>Extras</strong> Piscina <i>Sauna</i></section>"""
    rows = {r.heading: (r.text, r["items"]) for r in extract.sections(one(spark, html), ["sobre o imovel", "extras"]).collect()}
    # The words of a heading cut in two by a tag do not hold the heading, so they stay among the items.
    assert rows["sobre o imovel"] == ("Um\n\nDois", ["Sobre o", "Imóvel", "Um", "Dois"])
    assert rows["extras"] == ("Piscina\n\nSauna", ["Piscina", "Sauna"])


def test_nearby_list_items(spark):
    html = """<div><span>Pontos de interesse</span><ul><li data-type="Metrô">Estação A - 1,2 km</li>
      <li><b class="tipo-x">Parque</b> <i class="nome">Horto</i> <u data-distance="350 m"></u></li></ul></div>"""
    rows = extract.nearby_points(one(spark, html)).orderBy("position").collect()
    assert [(r.type, r.name, r.distance_text, r.distance_meters) for r in rows[:2]] == [
        ("Metrô", "Estação A - 1,2 km", "1,2 km", 1200), ("Parque", "Horto", "350 m", 350),
    ]


def test_linked_data_images(spark):
    html = """<script type="application/ld+json">[{"image": "/b.jpg", "url": "/a.png", "x": {"contentUrl": "/c.webp?utm_term=1"}},
      {"image": ["/B.jpg", {"url": "/d.jpeg"}, 5]}]</script><script type="application/ld+json">{oops</script>"""
    assert extract.jsonld_images(one(spark, html), SITE).first().urls == [f"{SITE}/{n}" for n in ("a.png", "b.jpg", "c.webp", "d.jpeg")]


def test_images_follow_the_attribute_order(spark):
    html = '<img src="/2.jpg" data-src="/1.jpg" srcset="/3.jpg 1x, /4.jpg 2x"><a href=\'/5.png\'><i style="x" src=/6.webp></i></a><img src="/2.JPG">'
    row = extract.links_and_images(one(spark, html), SITE).first()
    assert row.images == [f"{SITE}/{n}" for n in ("1.jpg", "2.jpg", "4.jpg", "5.png", "6.webp")] and row.links == [f"{SITE}/5.png"]


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ('<link href="/r" rel="prefetch next"><a class="next" href="/n">x</a>', "/r"),
        ('<a href="/n" class="page-numbers next">x</a><a href="/3">3</a>', "/n"),
        ('<a href="/9">9</a><a href="/3"> <b>3</b></a>', "/3"),
        ("<a href='/4'>4</a>", None),
    ],
)
def test_next_url(spark, html, want):
    assert extract.next_url(one(spark, html, page=2), SITE).first().next_url == (want and SITE + want)


@pytest.mark.parametrize(
    ("html", "want"),
    [("<b>11.709</b> <i>Resultados</i>", 11709), ("14.615 imóveis encontrados", 14615), ("12 IMOVEIS ENCONTRADOS", 12), ("nada", None)],
)
def test_reported_total(spark, html, want):
    assert extract.reported_total(one(spark, html)).first().reported_total == want


def test_labels_keep_unknown_ones(spark):
    html = "<dl><dt>Código:</dt><dd> <b>170805</b> </dd><dt>Vaga</dt><dd>1</dd></dl><p>IPTU (mês): R$ 80</p><p>Código: 2</p>"
    row = extract.labelled_values(one(spark, html), ["codigo"]).first()
    assert row.codigo == "170805" and row.unknown == {"Vaga": "1", "IPTU (mês)": "R$ 80"}


@pytest.mark.parametrize(
    ("more", "want"),
    [
        ({"http_status": 403}, "BLOCKED"), ({"fetch_failed": True, "http_status": 500}, "FAILED"), ({"parse_failed": True}, "STRUCTURE_CHANGED"),
        ({"html": "Access DENIED"}, "BLOCKED"), ({"content_type": "application/json"}, "DEGRADED"), ({"raw_cards": 0, "valid_cards": 0}, "STRUCTURE_CHANGED"),
        ({"raw_cards": 5, "invalid_cards": 3}, "DEGRADED"), ({"raw_cards": 5, "invalid_cards": 2}, "HEALTHY"), ({"content_type": ""}, "HEALTHY"),
        ({"html": "x" * 5000 + "captcha"}, "BLOCKED"),
    ],
)
def test_health(spark, more, want):
    base = {"http_status": 200, "content_type": "text/html", "raw_cards": 4, "valid_cards": 4, "invalid_cards": 0, "fetch_failed": False, "parse_failed": False}
    page = {"html": "<p>", **base, **more}
    assert extract.health_status(one(spark, page.pop("html"), **page)).first().health == want


def test_address_prefers_postal_code(spark):
    html = '<script>a="?q=AVENIDA+MUITO+COMPRIDA+DE+TODAS";b="x&q=RUA+BELA+10+PINHEIROS+SAO+PAULO+SP+CEP+01310-100"</script>'
    page = one(spark, html).withColumn("area", F.lit("Pinheiros"))
    row = extract.address_from_query(page, "area").first()
    assert (row.address_line, row.city, row.state, row.postal_code) == ("RUA BELA 10", "São Paulo", "SP", "01310-100")
    assert extract.address_from_query(one(spark, "<p>")).isEmpty()


def test_health_reads_a_window_only_if_asked(spark):
    page = one(spark, "x" * 5000 + "captcha", http_status=200, content_type="text/html", raw_cards=4, valid_cards=4, invalid_cards=0, fetch_failed=False, parse_failed=False)
    assert extract.health_status(page, 5000).first().health == "HEALTHY"


def test_unclosed_tags_and_character_references(spark):
    assert extract.visible_text(one(spark, "<p>x" * 1500)).count() == 1500
    html = "<h1>Cama&ccedil;ari &#233; &#xE9; &amp;lt; &apos;s &#39;q &nope; a&b</h1>"
    assert extract.page_meta(one(spark, html)).first().h1 == "Camaçari é é &lt; 's 'q &nope; a&b"


def test_long_labels_and_header_rows(spark):
    long = "Um rótulo " * 8
    html = f"<p>{long}: 7</p><table><tr><th>A</th><th>B</th></tr><tr><th>Vagas</th><td>2</td></tr></table>"
    rows = {r.label: r.value for r in extract.label_rows(one(spark, html)).collect()}
    assert rows[long.strip()] == "7" and rows["Vagas"] == "2"


def test_first_script_with_a_query_decides(spark):
    html = "<script>var x = 1;</script><script>a='?q=RUA+A'</script><script>b='&q=RUA+MUITO+LONGA+CEP+01310-100'</script>"
    assert extract.address_from_query(one(spark, html)).first().address_line == "RUA A"


def test_repeated_cards_are_invalid_in_both_readers(spark):
    cards = [("a", "1"), (None, "1"), ("a", "1"), ("b", None), ("b", "2"), ("c", "")]
    html = "".join(f"<li>{f'id={i};' if i else ''}{f'url={u};' if u else ''}</li>" for i, u in cards)
    patterns = ["<li>(.*?)</li>", "id=(.*?);", "url=(.*?);"]
    pages = spark.createDataFrame([(1, "x", html), (2, "y", html), (3, "y", None)], "page_id int, host string, html string")
    rows = [("x", *patterns, None), ("y", *patterns, "own")]
    profiles = spark.createDataFrame(rows, "host string, card_pattern string, id_pattern string, url_pattern string, reader string")
    own = lambda text: [(f"{i}{u}", i, u) for i, u in cards] if text else []
    found = extract.read_cards(pages, profiles, {"own": own}).orderBy("page_id", "position").collect()
    want = [None, "missing id", "duplicate id", "missing address", None, "missing address"]
    assert [(r.page_id, r.position, r.error) for r in found] == [(p, n, e) for p in (1, 2) for n, e in enumerate(want, 1)]
    assert extract.split_cards(pages, profiles.drop("reader")).count() == 12


def test_place_of_a_legacy_card_may_be_an_item_detail(spark):
    html = '<article><a href="/i/1">x</a><span class="item-detail">Moema | Santos</span></article>'
    assert extract.legacy_cards(one(spark, html), SITE).first().neighborhood == "Moema"
