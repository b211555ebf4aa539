"""Jobs that turn raw pages into cards, fields, links, offers and verdicts.

``pages`` has page_id and html. All jobs but four are plain expressions; those four, which ask what
stands inside what, read flat outlines of the pages over Arrow batches (``outline``).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import markup
from ..functions.arrays import dedupe_array, dedupe_urls
from ..functions.numbers import distance_m, parse_decimal_br, parse_money, parse_number_simple
from ..functions.text import _col, let, none_if_blank, normalize_key, normalize_space, parse_address, postal_code
from ..functions.urls import IMAGE_SUFFIX, absolute_url, largest_srcset, query_value, valid_image_url
from . import outline

# Attributes that can hold a picture's address, in the order they are read.
IMAGE_ATTRIBUTES = [
    "href", "data-href", "data-src", "data-lazy", "data-original", "data-full", "data-large", "data-image", "src",
]
SECURITY_TERMS = [
    "Verificação de segurança", "captcha", "recaptcha", "verify you are human", "access denied", "forbidden",
    "challenge", "gocache-error-page",
]
BLOCKING_TERMS = [
    "Verificação de segurança", "Complete o desafio", "verify you are human", "access denied", "forbidden",
    "challenge", "gocache-error-page",
]
CAPTCHA_TERMS = ["captcha", "recaptcha", "hcaptcha", "cf-turnstile", "g-recaptcha", "data-sitekey"]
BLOCKED_TERMS = ["captcha", "cloudflare", "access denied", "too many requests"]
TOTAL_PATTERNS = [r"(\d[\d.]*)\s+im[oó]veis encontrados", r"(\d[\d.]*)\s+Resultados"]
LINKED_DATA = r"(?is)<script\b[^>]*application/ld\+json[^>]*>(.*?)</script>"
OFFER_PATTERN = r"(?i)(Venda|Aluguel|Loca[cç][aã]o)\s+(R\$\s*[\d.,]+)"


def page_meta(pages: DataFrame, names: list[str] = (), base: str | None = None) -> DataFrame:
    """Title, first heading, canonical address, named metas and the post id of each page."""
    canonical = markup.link_href("html", "canonical")
    body = markup.first_tag("html", r"<body\b[^>]*>")
    by_class = F.nullif(F.regexp_extract(markup.attribute(body, "class"), r"\bpostid-(\d+)\b", 1), F.lit(""))
    return pages.select(
        "page_id",
        markup.element_text("html", "title").alias("title"),
        markup.element_text("html", "h1").alias("h1"),
        (absolute_url(canonical, base) if base else canonical).alias("canonical_url"),
        F.coalesce(by_class, query_value(markup.link_href("html", "shortlink"), "p")).alias("post_id"),
        *[markup.meta_content("html", n).alias(n.replace(":", "_")) for n in names],
    )


def _over_pages(pages: DataFrame, schema: str, read: Callable[[str], list[tuple]]) -> DataFrame:
    """Rows a parser finds in each page: page_id and the named fields."""
    schema = f"page_id {dict(pages.dtypes)['page_id']}, {schema}"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for n, html in enumerate(batch.column("html").to_pylist()):
                found = read(html)
                rows += found
                at += [n] * len(found)
            columns = zip(*rows) if rows else [()] * (len(arrow) - 1)
            found = [pa.array(values, field.type) for values, field in zip(columns, list(arrow)[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("page_id").take(pa.array(at, "int64")), *found], schema=arrow)

    return pages.select("page_id", "html").mapInArrow(run, schema)


def visible_text(pages: DataFrame) -> DataFrame:
    """Pieces of shown text in order: not comments, and not what stands directly in a silent element."""

    def read(html: str) -> list[tuple]:
        return list(enumerate(outline.flat(html).shown(), start=1))

    return _over_pages(pages, "position int, text string", read)


def split_cards(pages: DataFrame, profiles: DataFrame) -> DataFrame:
    """One row per card, in order, with its id, address and why it is invalid, if it is.

    A profile row has host, card_pattern, id_pattern and url_pattern, each with one group. A card is
    invalid without an address or id, and if a valid card before it on the page has its id.
    """
    first = lambda card, pattern: F.nullif(F.call_function("regexp_extract", card, F.col(pattern), F.lit(1)), F.lit(""))
    read = F.transform(
        F.regexp_extract_all("html", F.col("card_pattern"), F.lit(1)),
        lambda c: F.struct(c.alias("card"), first(c, "id_pattern").alias("card_id"), first(c, "url_pattern").alias("card_url")),
    )

    def judged(cards: Column) -> Column:
        valid = F.transform(cards, lambda c: F.when(c["card_url"].isNotNull(), c["card_id"]))
        return let(valid, lambda ids: F.transform(cards, lambda c, i: F.struct(
            (i + 1).alias("position"), c["card"].alias("card"), c["card_id"].alias("card_id"), c["card_url"].alias("card_url"),
            F.when(c["card_url"].isNull(), "missing address").when(c["card_id"].isNull(), "missing id")
            .when(F.array_position(ids, c["card_id"]) <= i, "duplicate id").alias("error"),
        )))

    return pages.join(profiles, "host").select("page_id", "host", F.inline(let(read, judged)))


def _card_reader(functions: dict[str, Callable[[str], Iterable[tuple]]]):
    """A table function that reads a page by the function its profile names."""

    class ReadCards:
        def eval(self, reader: str, html: str) -> Iterator[tuple]:
            seen = set()
            for position, (card, card_id, url) in enumerate(functions[reader](html or ""), start=1):
                error = "missing address" if not url else "missing id" if not card_id else "duplicate id" if card_id in seen else None
                if error is None:
                    seen.add(card_id)
                yield position, card, card_id or None, url or None, error

    return F.udtf(ReadCards, returnType="position int, card string, card_id string, card_url string, error string")


def read_cards(pages: DataFrame, profiles: DataFrame, functions: dict[str, Callable[[str], Iterable[tuple]]]) -> DataFrame:
    """The columns of ``split_cards`` for sources that are read by patterns or by functions of their own.

    A profile whose ``reader`` names one of ``functions`` is read by it: from a page's markup it gives
    (card, card id, card address) in order. A profile without a reader is read by its patterns. A name
    that is not among the functions fails the job.
    """
    asked = pages.join(profiles.filter("reader IS NOT NULL").select("host", "reader"), "host").select("page_id", "host", "reader", "html")
    rows = asked.lateralJoin(_card_reader(functions)(F.col("reader").outer(), F.col("html").outer())).drop("reader", "html")
    return split_cards(pages, profiles.filter("reader IS NULL")).unionByName(rows)


def card_counts(cards: DataFrame) -> DataFrame:
    return cards.groupBy("page_id").agg(
        F.count("*").alias("raw_cards"), F.count_if(F.col("error").isNotNull()).alias("invalid_cards")
    )


def _pairs(pattern: str) -> Column:
    found = lambda n: F.regexp_extract_all("html", F.lit(pattern), F.lit(n))
    return F.arrays_zip(found(1).alias("label"), found(2).alias("value"))


def label_rows(pages: DataFrame) -> DataFrame:
    """Label and value pairs of a page: definition lists, table heads and 'Label: value' text."""
    listed = _pairs(r"(?is)<(?:dt|th)\b[^>]*>((?:(?!</(?:dt|th)\s*>).)*)</(?:dt|th)\s*>\s*<(?:dd|td)\b[^>]*>(.*?)</(?:dd|td)\s*>")
    listed = F.transform(listed, lambda p: F.struct(markup.flat_text(p["label"]).alias("label"), markup.flat_text(p["value"]).alias("value")))
    written = F.transform(
        F.filter(markup.text_pieces("html"), lambda t: t.rlike(r"^[^:]+:\s*\S")),
        lambda t: F.struct(
            F.trim(F.substring_index(t, ":", 1)).alias("label"),
            F.trim(F.regexp_replace(t, r"^[^:]+:\s*", "")).alias("value"),
        ),
    )
    return pages.select("page_id", F.posexplode(F.concat(listed, written)).alias("at", "_p")).select(
        "page_id", "at", F.regexp_replace(F.col("_p.label"), r"\s*:\s*$", "").alias("label"), F.col("_p.value").alias("value")
    ).filter("label <> '' AND value <> ''")


def labelled_values(pages: DataFrame, labels: list[str]) -> DataFrame:
    """Known labels as columns (first value counts), the others as a map by label."""
    rows = label_rows(pages).withColumn("_key", normalize_key("label"))
    keys = {label: F.col("_key") == normalize_key(F.lit(label)) for label in labels}
    known = F.lit(False)
    for match in keys.values():
        known = known | match
    first = [F.min_by("value", F.when(match, F.col("at"))).alias(label) for label, match in keys.items()]
    # Labels repeat little within one page, so its map stays as small as the page.
    others = F.array_sort(F.collect_set(F.when(~known, F.struct("label", "at", "value"))))
    merged = F.aggregate(
        others,
        F.create_map().cast("map<string,string>"),
        lambda m, e: F.when(F.map_contains_key(m, e["label"]), m).otherwise(
            F.map_concat(m, F.map_from_arrays(F.array(e["label"]), F.array(e["value"])))
        ),
    )
    return rows.groupBy("page_id").agg(*first, merged.alias("unknown"))


def links_and_images(pages: DataFrame, base: str) -> DataFrame:
    """Distinct link and picture addresses of each page, resolved, in reading order."""
    def found(tags: Column) -> Column:
        # Without such an ending, or a reference that may stand for one, a tag has no picture's address.
        may_show = F.filter(tags, lambda t: t.rlike(f"(?i)&|{IMAGE_SUFFIX}"))
        pictures = F.flatten(F.transform(may_show, lambda t: F.concat(
            F.transform(markup.attributes_in_order(t, IMAGE_ATTRIBUTES), lambda v: valid_image_url(v)),
            F.when(t.rlike(r"(?i)\ssrcset"), F.array(valid_image_url(largest_srcset(markup.attribute(t, "srcset")))))
            .otherwise(F.array().cast("array<string>")),
        )))
        anchors = F.filter(tags, lambda t: t.rlike(r"(?i)^<a\s"))
        links = F.transform(anchors, lambda t: markup.attribute(t, "href"))
        return F.struct(dedupe_urls(links, base).alias("links"), dedupe_urls(pictures, base).alias("images"))

    return pages.select("page_id", F.inline(F.array(let(markup.tags_of("html", "href|src|srcset|data-[a-z]+"), found))))


def sections(pages: DataFrame, headings: list[str]) -> DataFrame:
    """Text and list items under each heading: paragraphs once each, joined by a blank line."""

    def read(html: str) -> list[tuple]:
        page = outline.flat(html)
        return [(h, *found) for h in headings if (found := outline.section(page, h)) is not None]

    return _over_pages(pages, "heading string, text string, items array<string>", read)


def reported_total(pages: DataFrame, patterns: list[str] = TOTAL_PATTERNS) -> DataFrame:
    """The number of listings a page says there are; NULL if it says none."""

    def find(text: Column) -> Column:
        numbers = [F.nullif(F.regexp_extract(text, "(?i)" + p, 1), F.lit("")) for p in patterns]
        return F.floor(parse_decimal_br(F.coalesce(*numbers))).try_cast("int")

    return pages.select("page_id", let(markup.flat_text("html"), find).alias("reported_total"))


def next_url(pages: DataFrame, base: str, page_col: str = "page") -> DataFrame:
    """The following page: a rel=next link, else a 'next' anchor, else the anchor named page+1."""
    anchor = markup.first_tag("html", r"<a\b(?=[^>]*\bclass\s*=\s*[\"'][^\"']*\b(?:next|avancar)\b)(?=[^>]*\bhref)[^>]*>")
    anchors = F.regexp_extract_all("html", F.lit(r"(?is)<a\b[^>]*\bhref[^>]*>.*?</a\s*>"), F.lit(0))
    target = (F.col(page_col) + 1).cast("string")
    numbered = F.try_element_at(F.filter(anchors, lambda a: markup.flat_text(a) == target), F.lit(1))
    # The anchors' texts are looked at only where neither of the first two is there.
    href = F.coalesce(
        F.nullif(markup.link_href("html", "next"), F.lit("")),
        markup.attribute(anchor, "href"),
        markup.attribute(F.regexp_extract(numbered, r"(?is)^<a\b[^>]*>", 0), "href"),
    )
    return pages.select("page_id", absolute_url(href, base).alias("next_url"))


def identity_check(cards: DataFrame) -> DataFrame:
    """Adds ``reason`` where the ids of card, address and request disagree or there is none."""
    card, url, asked = (F.nullif(F.col(c), F.lit("")) for c in ("card_id", "url_id", "requested_id"))
    found = F.coalesce(card, url)
    return cards.withColumn("external_id", found).withColumn(
        "reason",
        F.when(card != url, F.concat(F.lit("external_id mismatch card="), card, F.lit(" url="), url))
        .when(found.isNull() & asked.isNull(), "missing external_id")
        .when(F.coalesce(found, asked) != asked, F.concat(F.lit("expected "), asked, F.lit(", got "), found)),
    )


def offers_from_labels(cards: DataFrame, text: str = "text") -> DataFrame:
    """Offers a text names by label and price; of two for one purpose the later counts."""
    found = lambda n: F.regexp_extract_all(normalize_space(text), F.lit(OFFER_PATTERN), F.lit(n))
    rows = cards.select("page_id", F.posexplode(F.arrays_zip(found(1).alias("label"), found(2).alias("price"))).alias("at", "o"))
    key = normalize_key(F.col("o.label"))
    purpose = F.when(key == "venda", "sale").when(key.isin("aluguel", "locacao"), "rent")
    last = F.max(F.struct("at", parse_money(F.col("o.price")).alias("price"), F.col("o.label").alias("raw_label")))
    return (
        rows.groupBy("page_id", purpose.alias("purpose"))
        .agg(last.alias("_l"))
        .select("page_id", "purpose", "_l.price", F.lit("BRL").alias("currency"), "_l.raw_label")
    )


def jsonld_images(pages: DataFrame, base: str) -> DataFrame:
    """Distinct picture addresses at any depth of a page's linked data; invalid scripts are skipped."""

    def read(html: str) -> list[tuple]:
        return [([url for body in re.findall(LINKED_DATA, html or "") for url in outline.addresses(body)],)]

    found = _over_pages(pages, "urls array<string>", read)
    return found.select("page_id", dedupe_urls(F.transform("urls", lambda u: valid_image_url(u)), base).alias("urls"))


def nearby_points(pages: DataFrame, heading: str = "Pontos de interesse") -> DataFrame:
    """Points of interest with their distance as written and in metres."""

    def read(html: str) -> list[tuple]:
        return [(n, *point) for n, point in enumerate(outline.points(outline.flat(html), heading), start=1)]

    rows = _over_pages(pages, "position int, type string, name string, said string, cut boolean", read)
    far = distance_m("said")
    text = F.when(F.col("cut"), far["distance_text"]).otherwise(F.col("said"))
    return rows.select("page_id", "position", "type", "name", text.alias("distance_text"), far["distance_meters"].alias("distance_meters"))


def address_from_query(pages: DataFrame, area: str | None = None) -> DataFrame:
    """Address in a page's best map query: one with a postal code, then a street, then the longest, all
    of the first script that holds a query.

    ``area`` names the column with the listing's neighbourhood, at which the address is cut.
    """
    scripts = F.regexp_extract_all("html", F.lit(r"(?is)<script\b[^>]*>(.*?)</script>"), F.lit(1))
    script = F.try_element_at(F.filter(scripts, lambda s: s.rlike(r"[?&]q=[^\"';]")), F.lit(1))
    queries = F.regexp_extract_all(script, F.lit(r"[?&]q=([^\"';]+)"), F.lit(1))
    decode = lambda q: F.coalesce(F.try_url_decode(q), q)
    ranked = F.transform(queries, lambda q, i: F.struct(
        F.upper(q).contains("CEP").alias("cep"), F.upper(decode(q)).contains("RUA").alias("rua"),
        F.length(q).alias("n"), (-i).alias("i"), q.alias("q"),
    ))
    text = F.regexp_replace(normalize_space(decode(F.array_max(ranked)["q"])), r"^.*&q=", "")
    found = pages.select("*", text.alias("_t"), (F.size(queries) > 0).alias("_any")).filter("_any")
    line = F.col("_t")
    if area:
        inside = normalize_key("_t").contains(normalize_key(area)) & (F.coalesce(F.col(area), F.lit("")) != "")
        at = F.instr(F.lower("_t"), F.lower(F.col(area)))
        line = F.when(inside & (at > 0), normalize_space(F.substring(F.col("_t"), F.lit(1), at - 1))).otherwise(line)
    for cut in (r"(?i)^.*\bq=", r"(?i)\bCEP\b.*$", r"(?i)\bS[AÃ]O PAULO\b.*$"):
        line = F.regexp_replace(line, cut, "")
    return found.select(
        "page_id",
        none_if_blank(line).alias("address_line"),
        (F.col(area) if area else F.lit(None).cast("string")).alias("neighborhood"),
        F.when(normalize_key("_t").contains("sao paulo"), "São Paulo").alias("city"),
        F.when(F.col("_t").rlike(r"(?i)\bSP\b"), "SP").alias("state"),
        postal_code("_t").alias("postal_code"),
    )


def challenge_terms(pages: DataFrame) -> DataFrame:
    """Terms of a security check that a page holds, and whether it blocks or asks for a captcha."""
    hay = F.lower(F.concat_ws("\n", "html", markup.flat_text("html")))
    held = lambda terms: F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.col("_hay").contains(F.lower(t)))
    found = pages.select("page_id", hay.alias("_hay")).select(
        "page_id", held(SECURITY_TERMS).alias("matched_terms"), held(BLOCKING_TERMS).alias("blocking_terms"),
        held(CAPTCHA_TERMS).alias("captcha_terms"),
    )
    blocks = F.size("blocking_terms") > 0
    return found.withColumn("challenge_detected", blocks).withColumn("captcha_detected", blocks & (F.size("captcha_terms") > 0))


def probe_result(probes: DataFrame) -> DataFrame:
    """Adds ``result``, from what a probe found on its page and at its endpoint."""
    title = F.lower(F.coalesce("title", F.lit("")))
    content = (F.col("cards_count") > 0) | ((F.col("listing_keys_count") > 0) & title.contains("venda"))
    said = lambda c: F.coalesce(F.col(c), F.lit(False))
    is_json = said("json_valid") & F.coalesce(F.col("content_type").contains("application/json"), F.lit(False))
    full = said("has_data") & said("has_count") & said("has_aggs")
    return probes.withColumn(
        "result",
        F.when(~content & said("captcha_detected"), "CAPTCHA_REQUIRED")
        .when(~content & said("challenge_detected"), "SECURITY_CHALLENGE")
        .when(~content, "CONTENT_NOT_FOUND")
        .when(~said("attempted"), "SUCCESS")
        .when(~F.col("endpoint_status").eqNullSafe(F.lit(200)), "ENDPOINT_BLOCKED")
        .when(~(is_json & full), "ENDPOINT_INVALID_RESPONSE")
        .otherwise("SUCCESS"),
    )


def health_status(pages: DataFrame, head_chars: int | None = None) -> DataFrame:
    """Adds ``health``. Blocking words count anywhere, or within the first characters if the caller says so."""
    html = F.coalesce("html", F.lit(""))
    head = F.lower(F.substring(html, 1, head_chars) if head_chars else html)
    wording = F.lit(False)
    for term in BLOCKED_TERMS:
        wording = wording | head.contains(term)
    kind = F.lower(F.coalesce("content_type", F.lit("")))
    raw, valid, invalid = (F.coalesce(F.col(c), F.lit(0)) for c in ("raw_cards", "valid_cards", "invalid_cards"))
    return pages.withColumn(
        "health",
        F.when(F.col("http_status").isin(403, 429), "BLOCKED")
        .when(F.coalesce("fetch_failed", F.lit(False)), "FAILED")
        .when(F.coalesce("parse_failed", F.lit(False)), "STRUCTURE_CHANGED")
        .when(wording, "BLOCKED")
        .when((kind != "") & ~kind.contains("html"), "DEGRADED")
        .when((raw <= 0) & (valid <= 0), "STRUCTURE_CHANGED")
        .when(invalid > F.greatest(F.lit(0), F.floor(raw / F.lit(2))), "DEGRADED")
        .otherwise("HEALTHY"),
    )


def legacy_cards(pages: DataFrame, base: str, default_title: str = "Imóvel", default_city: str = "Não informado") -> DataFrame:
    """Cards of a simple listing page, one per article, with defaults for what they lack."""
    articles = F.regexp_extract_all("html", F.lit(r"(?is)<article\b.*?</article\s*>"), F.lit(0))
    rows = pages.select("page_id", F.posexplode(articles).alias("_p", "a")).withColumn("position", F.col("_p") + 1)
    head = F.regexp_extract("a", r"(?is)^<article\b[^>]*>", 0)
    link = markup.first_tag("a", r"<a\b(?=[^>]*\bhref)[^>]*>")
    href = F.trim(markup.attribute(link, "href"))
    rooted = lambda u: F.when(u.startswith("//"), F.concat(F.lit("https:"), u)).when(
        u.startswith("/"), F.concat(F.lit(base), u)
    ).otherwise(u)
    spans = F.regexp_extract_all("a", F.lit(r"(?is)<span\b[^>]*>(.*?)</span\s*>"), F.lit(1))
    info = F.lower(F.array_join(F.transform(spans, markup.flat_text), " "))
    count = lambda p: F.regexp_extract(F.col("info"), p, 1).try_cast("int")
    money = F.try_element_at(F.filter(markup.text_pieces("a"), lambda t: t.contains("R$")), F.lit(1))
    place = F.regexp_extract("a", r"(?is)<span\b(?=[^>]*\bclass\s*=\s*[\"'][^\"']*(?:address|location|item-detail))[^>]*>(.*?)</span\s*>", 1)
    image = markup.first_tag("a", r"<img\b[^>]*>")
    source = F.coalesce(F.nullif(markup.attribute(image, "data-src"), F.lit("")), markup.attribute(image, "src"))
    area = parse_number_simple(F.regexp_extract("info", r"(\d+[.,]?\d*)\s*m²", 1))
    return (
        rows.withColumn("url", rooted(href))
        .filter("url <> ''")
        .withColumn("info", info)
        .withColumn("_place", parse_address(markup.flat_text(place)))
        .select(
            "page_id",
            "position",
            F.coalesce(
                F.nullif(markup.attribute(head, "data-adid"), F.lit("")),
                F.nullif(markup.attribute(head, "data-listing-id"), F.lit("")),
                "url",
            ).alias("external_id"),
            F.coalesce(markup.element_text("a", "h[1-5]"), markup.element_text("a", "a"), F.lit(default_title)).alias("title"),
            F.coalesce(markup.element_text("a", "p"), F.lit("")).alias("description"),
            F.coalesce(parse_number_simple(money), F.lit(0.0)).alias("price"),
            "url",
            F.coalesce(F.nullif("_place.city", F.lit("")), F.lit(default_city)).alias("city"),
            F.col("_place.area").alias("neighborhood"),
            count(r"(\d+)\s+quartos?").alias("bedrooms"),
            count(r"(\d+)\s+banheiros?").alias("bathrooms"),
            F.nullif(area, F.lit(0.0)).alias("area_m2"),
            rooted(F.trim(F.coalesce(source, F.lit("")))).alias("main_image"),
        )
    )


def card_flags(cards: DataFrame, html: str = "card") -> DataFrame:
    """New and exclusive flags, metro lines, and the tags that follow from the flags."""
    keys = F.transform(markup.text_pieces(html), normalize_key)
    classes = F.array_join(F.regexp_extract_all(_col(html), F.lit(r"(?is)\sclass\s*=\s*[\"']([^\"']*)"), F.lit(1)), " ")
    lines = F.array_sort(F.array_distinct(F.regexp_extract_all(classes, F.lit(r"linha-[A-Za-zÀ-ÿ-]+"), F.lit(0))))
    new, exclusive = F.array_contains(keys, "anuncio novo"), F.array_contains(keys, "exclusivo")
    tags = F.array_compact(F.array(F.when(new, "Anúncio Novo"), F.when(exclusive, "Exclusivo")))
    return cards.withColumns(
        {"new_listing": new, "exclusive": exclusive, "metro_lines": lines, "tags": dedupe_array(tags)}
    )


