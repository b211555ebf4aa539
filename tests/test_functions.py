"""Column functions on written-out values."""

from decimal import Decimal
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from tidemark.functions import arrays, hashing, markup, numbers, text, urls
from tidemark.plans.sync import Run
from tidemark.sources.pages import unwrap_payload

SITE = "https://www.site.test"


def check(spark, cases):
    """All (expression, expected) pairs in one job."""
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, (c, _) in enumerate(cases)]).first()
    for i, (column, want) in enumerate(cases):
        got = row[i].asDict() if hasattr(row[i], "asDict") else row[i]
        assert got == want, f"{column}: {got!r} != {want!r}"


def lit(*values):
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def test_numbers(spark):
    money = {
        "R$ 3.100.000": "3100000.00", "R$ 16.929": "16929.00", "": None, "R$ 8.850.000,00": "8850000.00",
        "183 m²": "183.00", "183,50 m2": "183.50", "1.5": "1.50", "-2,345": "-2.34", "2,355": "2.36", "1.234.5": None,
        "1,2,3": None, "5.": "5.00", "sob consulta": None, "12.345.678": "12345678.00",
    }
    check(spark, [(numbers.parse_money(F.lit(k)), v and Decimal(v)) for k, v in money.items()])
    check(spark, [
        (numbers.distance_m(F.lit("a 1,2 KM daqui")), {"distance_text": "1,2 km", "distance_meters": 1200}),
        (numbers.distance_m(F.lit("350 metros")), {"distance_text": "350 metros", "distance_meters": 350}),
        (numbers.distance_m(F.lit("perto")), {"distance_text": None, "distance_meters": None}),
        (numbers.infer_bathrooms(F.lit(2), F.lit("Lavabo; banheiro social; WC empregada")), 5),
        (numbers.infer_bathrooms(F.lit(0), F.lit("varanda")), None),
        (numbers.construction_year(F.lit("1799")), None),
        (numbers.construction_year(F.lit(" 2100 ")), 2100),
        (numbers.parse_number_simple(F.lit("R$ 1.234,5")), 1234.5),
    ])


def test_attributes(spark):
    got = numbers.attributes_from_text(F.lit("183,5 Metros quadrados · 4 Dormitórios · 2 suítes · 3 vagas"))
    check(spark, [(got, {"area_m2": Decimal("183.50"), "bedrooms": 4, "suites": 2, "bathrooms": 2, "parking_spaces": 3})])


def test_text(spark):
    check(spark, [
        (text.normalize_space(F.lit("  Rua   A\n\n  123 \x1c ")), "Rua A 123"),
        (text.none_if_blank(F.lit(" \t")), None),
        (text.title_location(F.lit("VILA  Madalena 1A de")), "Vila Madalena 1a de"),
        (text.normalize_key(F.lit("ÁREA  Útil ½ m² ß")), "area util ½ m2 ss"),
        (text.known_tag(F.lit("Tour 360º em VÍDEO")), "Vídeo"),
        (text.known_tag(F.lit("nada")), None),
        (text.public_title(F.lit("Apartamento à Venda - Cód.: 170805"), F.lit("170805")), "Apartamento à Venda"),
        (text.public_title(F.lit("Casa – 12345")), "Casa"),
        (text.public_title(F.lit("Casa - 123")), "Casa - 123"),
        (text.compose_title(F.lit("Casa"), F.lit(None).cast("string")), "Casa"),
        (text.postal_code(F.lit("CEP 01310 100")), "01310-100"),
        (text.split_heading(F.lit("APARTAMENTO - Residencial - VILA ANA")), {"kind": "Apartamento", "category": "Residencial", "area": "Vila Ana"}),
        (text.split_address(F.lit("R A - B - VILA ANA")), {"address_line": "R A - B", "area": "Vila Ana"}),
        (text.parse_address(F.lit("Centro – São Paulo")), {"area": "Centro", "city": "São Paulo"}),
        (text.format_money(F.lit(Decimal("0"))), "Preço não informado"),
        (text.format_money(F.lit(Decimal("1234.5"))), "R$ 1.234,50"),
        (text.reference_code_from_url(F.lit("https://x.test/imoveis/ap-2/z-268289/fotos")), "Z-268289"),
        (text.source_label(F.lit(None).cast("string")), "Fonte externa"),
        (text.normalize_purpose(F.lit(" Locação ")), "RENT"),
        (text.normalize_purpose(F.lit(None).cast("string")), ""),
    ])


def test_urls(spark):
    cases = {
        "/imovel/123?utm_source=x&id=1": f"{SITE}/imovel/123?id=1", "//cdn.test/a.jpg": "https://cdn.test/a.jpg",
        "b?x=1": f"{SITE}/b?x=1", "?p=2": f"{SITE}?p=2", "../a/./b/": f"{SITE}/a/b/", "/a/../../c": f"{SITE}/c",
        "http://o.test/x#f": "http://o.test/x#f", "  ": None, "mailto:a@b.test": "mailto:a@b.test",
        "/q?a=b%20c&d&a=b*~": f"{SITE}/q?a=b+c&d=&a=b%2A~", "/x?gclid=1#top": f"{SITE}/x#top",
    }
    check(spark, [(urls.absolute_url(F.lit(k), SITE), v) for k, v in cases.items()])
    check(spark, [
        (urls.absolute_url(F.lit("c"), f"{SITE}/a/b"), f"{SITE}/a/c"),
        (urls.url_segments(F.lit(f"{SITE}/imovel/s%C3%A3o/1001/"), "imovel"), ["são", "1001"]),
        (urls.url_segments(F.lit(f"{SITE}/outro/1"), "imovel"), None),
        (urls.last_numeric_segment(urls.url_segments(F.lit(f"{SITE}/7/a/9b"))), "7"),
        (urls.largest_srcset(F.lit("a 1x, b 2x, c 2x,")), "c"),
        (urls.valid_image_url(F.lit("/a.JPG?x#y"), SITE), f"{SITE}/a.JPG?x=#y"),
        (urls.valid_image_url(F.lit("/a.gif"), SITE), None),
        (urls.background_image(F.lit("background-image:url( '/f/a.png' )"), SITE), f"{SITE}/f/a.png"),
        (urls.background_image(F.lit("color:red")), None),
        (urls.unproxy_image(F.lit("/foto.php?url=https://c.test/a.jpg"), SITE), "https://c.test/a.jpg"),
    ])


def test_arrays(spark):
    check(spark, [
        (arrays.dedupe_array(lit("Novo", "novo", "  Piscina  ", "Piscina", None, " ")), ["Novo", "Piscina"]),
        (arrays.dedupe_array(F.lit(None).cast("array<string>")), []),
        (arrays.dedupe_urls(lit("/a?utm_campaign=x", "/a", "/b"), SITE), [f"{SITE}/a", f"{SITE}/b"]),
        (arrays.gallery(lit("/thumb/a", None, "/b", "/B"), "^/thumb/"), ["/b"]),
        (arrays.gallery(lit("/b", "/B", ""), "^/thumb/", fold=False), ["/b", "/B"]),
        (arrays.gallery(lit("/thumb/a", "/THUMB/a"), "^/thumb/"), ["/thumb/a"]),
    ])


def test_hashes(spark):
    digest = lambda s: sha256(s.encode()).hexdigest()
    scope = F.create_map(F.lit("q"), F.lit("São Paulo"), F.lit("a"), F.lit("x"))
    fields = {"b": F.lit(None).cast("string"), "a": F.lit('t"ab\t'), "c": F.lit(Decimal("3.10")).cast("string")}
    check(spark, [
        (hashing.scope_hash(scope), digest('{"a":"x","q":"São Paulo"}')),
        (hashing.scope_hash(F.lit(None).cast("map<string,string>")), digest("{}")),
        (hashing.content_hash(fields), digest('{"a":"t\\"ab\\t","b":null,"c":"3.10"}')),
        (hashing.stable_bucket(F.lit("job"), 0), 0),
        (hashing.stable_bucket(F.lit("job"), 9), int.from_bytes(sha256(b"job").digest()[:4], "big") % 10),
    ])
    assert Run("r", "s", None, scope={"q": "São Paulo", "a": "x"}).scope_hash == digest('{"a":"x","q":"São Paulo"}')


def test_markup_and_payload(spark):
    tag = F.lit("<a DATA-x='1' href=\"/p?a=1&amp;b=2\" title=''>")
    check(spark, [
        (markup.attribute(tag, "href"), "/p?a=1&b=2"), (markup.attribute(tag, "title"), ""), (markup.attribute(tag, "x"), None),
        (markup.text_pieces(F.lit("<p>a &amp;<b> b</b><script>x</script><!-- c --></p> ")), ["a &", "b"]),
        (unwrap_payload(F.lit(' {"html": "<p>"}')), "<p>"), (unwrap_payload(F.lit('{"html": 3}')), '{"html": 3}'),
        (unwrap_payload(F.lit("{x")), "{x"), (unwrap_payload(F.lit("<p>")), "<p>"),
    ])


@pytest.mark.parametrize("n", [0, 1, 300])
def test_dedupe_long_arrays(spark, n):
    words = [f"W{i % 97}" if i % 2 else f"w{i % 89}" for i in range(n)]
    frame = spark.createDataFrame([(words,)], "a array<string>").select(arrays.dedupe_array("a").alias("a"))
    first = {}
    for w in words:
        first.setdefault(w.lower(), w)
    assert frame.first().a == list(first.values())


def test_character_references_as_html_reads_them(spark):
    from html import unescape
    from html.entities import html5

    texts = [
        "&amp;lt; &AMP &ampx; &notit; &notin; &nosuch; &; & &#; &#x; &#xg; a&b&&amp;", "&#233 &#xe9;&#XE9 &#0; &#13;|&#11;|&#1;|&#127;",
        "&#128;&#x81;&#159; &#55296; &#1114112; &#99999999999999999999; &#xFFFFFFFFFFFFFFFFFFFF; &#65534; &#x1F600; &#xfdd0;",
        "&NewLine;&Tab;&nbsp;&nbsp &NotEqualTilde;&fjlig; &copy2024 &eacute &Eacutex",
        *(f"&{n}" for n in sorted(html5)),
    ]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", markup.unescape("t").alias("u")).collect()
    assert [(r.t, r.u) for r in rows if r.u != unescape(r.t).replace("\xa0", " ")] == []
