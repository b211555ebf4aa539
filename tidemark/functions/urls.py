"""URL expressions: tracking removal, resolution, segments, image rules."""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import parse_decimal_br
from .text import _col, let, none_if_blank, normalize_space

# Query parameters that only track the visitor.
TRACKING_PARAMETERS = [
    "utm_source",
    "utm_medium",
    "utm_campaign",
    "utm_term",
    "utm_content",
    "gclid",
    "fbclid",
    "msclkid",
]
IMAGE_SUFFIX = r"\.(?:jpe?g|png|webp)"
# A path from the root that needs no resolving, alone or with a query of tracking parameters only.
_ROOTED = (
    r"^(?:/[!-~&&[^/?#.]][!-~&&[^/?#]]*+)++/?"
    rf"(?:\?(?:&|(?:{'|'.join(TRACKING_PARAMETERS)})(?:=[!-~&&[^&#]]*+)?(?=&|\z))*+)?\z"
)
# An address whose path, as ``url_path`` reads it, ends like a picture's.
_IMAGE_PATH = rf"(?i)^(?:[A-Z][A-Z0-9+.\-]*+:)?+(?://[^/?#]*+)?+[^?#]*{IMAGE_SUFFIX}(?:[?#]|$)"


def _decode(c: Column) -> Column:
    """Form decoding; a text with a malformed escape is kept as it is."""
    return F.coalesce(F.try_url_decode(c), c)


def _encode(c: Column) -> Column:
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _after(c: Column, head: Column) -> Column:
    """What follows ``head`` and the one separator after it."""
    return F.substring(c, F.length(head) + 2, F.length(c))


def _pieces(url: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a struct of the address, its query and its fragment."""
    cut_fragment = let(url, lambda u: F.struct(F.substring_index(u, "#", 1).alias("before"), u.alias("url")))
    cut_query = lambda p: F.struct(
        p["url"].alias("url"),
        F.substring_index(p["before"], "?", 1).alias("address"),
        _after(p["before"], F.substring_index(p["before"], "?", 1)).alias("query"),
        _after(p["url"], p["before"]).alias("fragment"),
    )
    return let(cut_fragment, lambda p: let(cut_query(p), body))


def strip_tracking(c) -> Column:
    """Drop tracking parameters; keep the order, blanks and fragment of the rest."""
    return _without_tracking(none_if_blank(c))


def _without_tracking(url: Column) -> Column:
    def rebuild(p: Column) -> Column:
        pairs = F.transform(
            F.filter(F.split(p["query"], "&"), lambda e: e != ""),
            lambda e: F.struct(
                _decode(F.substring_index(e, "=", 1)).alias("key"),
                _decode(_after(e, F.substring_index(e, "=", 1))).alias("value"),
            ),
        )
        kept = F.filter(pairs, lambda e: ~e["key"].isin(TRACKING_PARAMETERS))
        text = F.array_join(F.transform(kept, lambda e: F.concat(_encode(e["key"]), F.lit("="), _encode(e["value"]))), "&")
        return F.concat(
            p["address"],
            let(text, lambda t: F.when(t != "", F.concat(F.lit("?"), t)).otherwise("")),
            F.when(p["fragment"] != "", F.concat(F.lit("#"), p["fragment"])).otherwise(""),
        )

    return _pieces(url, rebuild)


def _resolve_dots(path: Column) -> Column:
    """Take '.' and '..' segments out of an absolute path."""
    empty = F.array().cast("array<string>")
    folded = lambda segments: F.aggregate(
        segments,
        empty,
        lambda done, s: F.when(s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
        .when((s == ".") | (s == ""), done)
        .otherwise(F.array_append(done, s)),
    )
    rebuilt = lambda segments: let(
        folded(segments),
        lambda done: F.concat(
            F.lit("/"),
            F.array_join(done, "/"),
            F.when(F.element_at(segments, -1).isin("", ".", "..") & (F.size(done) > 0), "/").otherwise(""),
        ),
    )
    return let(F.split(path, "/"), rebuilt)


def absolute_url(c, base: str) -> Column:
    """Resolve a reference against a fixed base address, then drop tracking."""
    parts = urlsplit(base)
    origin = f"{parts.scheme}://{parts.netloc}"
    folder = parts.path.rsplit("/", 1)[0] + "/"
    here = origin + parts.path
    own_query = F.lit(f"{here}?{parts.query}" if parts.query else here)

    def resolve(p: Column) -> Column:
        url, address = p["url"], p["address"]
        tail = F.substring(url, F.length(address) + 1, F.length(url))
        rooted = F.when(address.startswith("/"), address).otherwise(F.concat(F.lit(folder), address))
        has_dots = rooted.rlike(r"(?:^|/)\.{1,2}(?:/|$)")
        path = F.when(has_dots, _resolve_dots(rooted)).otherwise(rooted)
        return (
            F.when(url.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), url)
            .when(url.startswith("//"), F.concat(F.lit(parts.scheme + ":"), url))
            .when(url.startswith("#"), F.concat(own_query, url))
            .when(url.startswith("?"), F.concat(F.lit(here), url))
            .otherwise(F.concat(F.lit(origin), path, tail))
        )

    # Most addresses are paths from the root or whole, without dots, blanks or what is to be kept of a query: they are not taken apart.
    return let(_col(c), lambda u: (
        F.when(u.rlike(_ROOTED), F.concat(F.lit(origin), F.substring_index(u, "?", 1)))
        .when(u.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:[!-~&&[^?#]]*\z"), u)
        .otherwise(_without_tracking(_pieces(none_if_blank(u), resolve)))
    ))


def url_path(c) -> Column:
    """Path of an address, '' where there is none; never raises on odd input."""
    address = F.regexp_extract(_col(c), r"^[^?#]*", 0)
    return F.regexp_replace(address, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/]*)?", "")


def url_host(c) -> Column:
    return F.lower(F.regexp_extract(_col(c), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))


def query_value(c, name: str) -> Column:
    hits = lambda query: F.filter(F.split(query, "&"), lambda e: _decode(F.substring_index(e, "=", 1)) == name)
    value = lambda e: _decode(_after(e, F.substring_index(e, "=", 1)))
    return _pieces(_col(c), lambda p: let(F.try_element_at(hits(p["query"]), F.lit(-1)), value))


def url_segments(c, marker: str | None = None) -> Column:
    """Decoded path segments, after ``marker`` where one is named (NULL if it is not there)."""
    raw = F.filter(F.split(url_path(c), "/"), lambda s: s != "")
    parts = F.transform(raw, lambda s: _decode(F.replace(s, F.lit("+"), F.lit("%2B"))))
    if marker is None:
        return parts
    place = lambda all_: F.array_position(all_, F.lit(marker)).cast("int")
    return let(
        parts, lambda all_: F.when(place(all_) > 0, F.slice(all_, place(all_) + 1, F.size(all_)))
    )


def last_numeric_segment(segments) -> Column:
    return F.try_element_at(F.filter(_col(segments), lambda s: s.rlike(r"^\d+$")), F.lit(-1))


def largest_srcset(c) -> Column:
    """The address with the largest descriptor; a later one wins a tie."""
    entries = F.filter(F.transform(F.split(_col(c), ","), normalize_space), lambda e: e != "")
    scored = F.transform(
        entries,
        lambda e, i: F.struct(
            F.coalesce(parse_decimal_br(F.lower(F.try_element_at(F.split(e, " "), F.lit(2)))), F.lit(0))
            .cast("decimal(28,10)")
            .alias("score"),
            i.alias("at"),
            F.element_at(F.split(e, " "), 1).alias("url"),
        ),
    )
    return F.array_max(scored)["url"]


def background_image(c, base: str | None = None) -> Column:
    """Picture address in a style text, image files only."""
    style = _col(c)
    inner = r"url\(\s*(['\"]?)(.*?)\1\s*\)"
    named = F.regexp_extract(style, r"(?i)background-image\s*:\s*" + inner, 2)
    any_url = F.regexp_extract(style, "(?i)" + inner, 2)
    url = normalize_space(F.when(named != "", named).otherwise(any_url))
    picture = F.when(url.rlike("(?i)" + IMAGE_SUFFIX + r"(?:[?#].*)?$"), url)
    return absolute_url(picture, base) if base else picture


def valid_image_url(c, base: str | None = None) -> Column:
    url = absolute_url(c, base) if base else none_if_blank(c)
    return let(url, lambda u: F.when(u.rlike(_IMAGE_PATH), u))


def upstream_ids(urls) -> Column:
    """Ids that picture addresses give away; the first of each kind counts."""

    def first(pattern: str) -> Column:
        found = F.transform(_col(urls), lambda u: F.nullif(F.regexp_extract(u, pattern, 1), F.lit("")))
        return F.upper(F.try_element_at(F.filter(found, lambda v: v.isNotNull()), F.lit(1)))

    numeric = first(r"(?i)/vista\.imobi/fotos/(\d+)/")
    return F.struct(
        F.when(numeric.isNotNull(), "vista").alias("upstream_platform"),
        numeric.alias("upstream_numeric_id"),
        first(r"(?i)/imovel/PI/(PI\d+)/").alias("upstream_reference"),
        first(r"(?i)/realestate/(REO\d+)/").alias("reo_reference"),
    )


def unproxy_image(c, base: str | None = None) -> Column:
    """The picture behind a ``…/foto.php?url=`` address."""
    url = absolute_url(c, base) if base else strip_tracking(c)

    def look(p: Column) -> Column:
        through = url_path(p["url"]).endswith("/foto.php") & p["real"].rlike("^https?://")
        return F.when(through, _decode(F.replace(p["real"], F.lit("+"), F.lit("%2B")))).otherwise(p["url"])

    return let(url, lambda u: let(F.struct(u.alias("url"), query_value(u, "url").alias("real")), look))
