"""Text cleaning: spaces, accents, tags, titles, codes and display strings."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tag vocabulary, needle (in normalised text) -> label, first match wins.
TAG_VOCABULARY = {
    "video": "Vídeo",
    "vídeo": "Vídeo",
    "360": "360º",
    "360º": "360º",
    "permuta": "Permuta",
    "destaque": "Destaque",
    "especial": "Especial",
    "planta modificada": "Planta Modificada",
    "decorado com ia": "Decorado com IA",
    "exclusivo": "Exclusivo",
}
NO_PRICE = "Preço não informado"
NO_LOCATION = "Localização não informada"
NO_SOURCE = "Fonte externa"


def _fold_table() -> tuple[str, str]:
    """One-to-one compatibility foldings of the Latin, symbol and full-width blocks, by rule."""
    source, target = [], []
    blocks = (range(0xA0, 0x250), range(0x1E00, 0x1F00), range(0x2070, 0x20A0), range(0xFF01, 0xFF5F))
    for block in blocks:
        for point in block:
            char = chr(point)
            plain = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))
            if plain != char and len(plain) == 1:
                source.append(char)
                target.append(plain)
    return "".join(source), "".join(target)


_FOLD_FROM, _FOLD_TO = _fold_table()


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


# Unicode's whitespace and four separators. Visible ASCII is ruled out first, since the Unicode name costs a look-up.
_SPACE_RUN = r"(?U)[[^!-~]&&[\s\x1c-\x1f]]+"


def normalize_space(c) -> Column:
    """Whitespace runs (Unicode ones too) become one blank; ends trimmed; NULL becomes ''."""
    return F.coalesce(F.trim(F.regexp_replace(_col(c), _SPACE_RUN, " ")), F.lit(""))


def none_if_blank(c) -> Column:
    return let(normalize_space(c), lambda text: F.nullif(text, F.lit("")))


def casefold(c) -> Column:
    """Lower case with the two foldings in which case-insensitive matching differs from it."""
    return F.replace(F.replace(F.lower(_col(c)), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))


def strip_accents(c) -> Column:
    return F.translate(F.regexp_replace(_col(c), r"\p{M}", ""), _FOLD_FROM, _FOLD_TO)


def normalize_key(c) -> Column:
    """Comparison key: no accents, single blanks, folded case."""
    return casefold(normalize_space(strip_accents(c)))


def _capitalize(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, 2, 1 << 30)))


def title_location(c) -> Column:
    """Capitalise the words written wholly in upper case; leave the others alone."""
    words = F.transform(
        F.split(none_if_blank(c), " "),
        lambda w: F.when((w == F.upper(w)) & (w != F.lower(w)), _capitalize(w)).otherwise(w),
    )
    return F.array_join(words, " ")


def normalize_purpose(c) -> Column:
    key = F.lower(F.trim(F.coalesce(_col(c).cast("string"), F.lit(""))))
    return (
        F.when(key.isin("sale", "venda"), "SALE")
        .when(key.isin("rent", "locacao", "locação", "aluguel"), "RENT")
        .otherwise(F.upper(key))
    )


def known_tag(c, vocabulary: dict[str, str] = TAG_VOCABULARY) -> Column:
    return let(
        normalize_key(c),
        lambda key: F.coalesce(*[F.when(key.contains(n), F.lit(label)) for n, label in vocabulary.items()]),
    )


def slug_to_name(c, labels: dict[str, str] | None = None) -> Column:
    slug = F.nullif(_col(c), F.lit(""))
    name = title_location(F.replace(slug, F.lit("-"), F.lit(" ")))
    for key, label in (labels or {}).items():
        name = F.when(slug == key, F.lit(label)).otherwise(name)
    return name


def reference_code(c) -> Column:
    code = F.regexp_extract(_col(c), r"\b([A-Za-z][A-Za-z0-9]*-\d+)\b", 1)
    return F.upper(F.nullif(code, F.lit("")))


def reference_code_from_url(url) -> Column:
    """The code in the right-most path segment that has one."""
    segments = F.reverse(F.split(F.parse_url(_col(url), F.lit("PATH")), "/"))
    codes = F.filter(F.transform(segments, reference_code), lambda s: s.isNotNull())
    return F.try_element_at(codes, F.lit(1))


def money_text(c) -> Column:
    return F.nullif(F.regexp_extract(_col(c), r"R\$\s*[\d.,]+", 0), F.lit(""))


def public_title(title, listing_id=None) -> Column:
    """Drop a trailing listing id, and any trailing number of four or more digits."""
    dash = r"(?i)\s*[-–—]\s*(?:c[oó]d\.?\s*:?\s*)?"
    clean = normalize_space(title)
    if listing_id is not None:
        own = F.concat(F.lit(dash + r"\Q"), _col(listing_id).cast("string"), F.lit(r"\E\s*$"))
        clean = F.when(_col(listing_id).isNotNull(), F.regexp_replace(clean, own, F.lit(""))).otherwise(clean)
    return none_if_blank(F.regexp_replace(clean, dash + r"\d{4,}\s*$", ""))


def compose_title(kind, area) -> Column:
    kind, area = F.nullif(_col(kind), F.lit("")), F.nullif(_col(area), F.lit(""))
    return F.coalesce(F.concat(kind, F.lit(" em "), area), kind, area)


def postal_code(c) -> Column:
    return F.nullif(
        F.regexp_replace(F.regexp_extract(_col(c), r"\b\d{5}[-\s]?\d{3}\b", 0), r"(\d{5})[-\s]?(\d{3})", "$1-$2"),
        F.lit(""),
    )


def _heading_case(c: Column) -> Column:
    return F.when((c == F.upper(c)) & (c != F.lower(c)), title_location(c)).otherwise(c)


def split_heading(c) -> Column:
    """'A - B - C' as a struct of kind, category and area."""
    parts = F.filter(
        F.transform(F.split(_col(c), r"\s+-\s+"), normalize_space), lambda p: p != ""
    )
    part = lambda n: F.try_element_at(parts, F.lit(n))
    return F.struct(
        _heading_case(part(1)).alias("kind"),
        _heading_case(part(2)).alias("category"),
        title_location(part(3)).alias("area"),
    )


def split_address(c) -> Column:
    """'ADDRESS - AREA' cut at the last separator."""
    text = none_if_blank(c)
    cut = text.contains(" - ")
    area = F.element_at(F.split(text, " - "), -1)
    address = F.substring(text, F.lit(1), F.length(text) - F.length(area) - 3)
    return F.struct(
        title_location(F.when(cut, address).otherwise(text)).alias("address_line"),
        F.when(cut, title_location(area)).alias("area"),
    )


def parse_address(c) -> Column:
    """Free address text cut at dash, comma or bar: first part is the area, last the city."""
    text = _col(c)
    parts = F.filter(F.transform(F.split(text, "[–,|]"), lambda p: F.trim(p)), lambda p: p != "")
    several = F.size(parts) >= 2
    return F.struct(
        F.when(several, F.try_element_at(parts, F.lit(1))).otherwise("").alias("area"),
        F.when(several, F.try_element_at(parts, F.lit(-1))).otherwise(F.trim(text)).alias("city"),
    )


def format_money(price, currency: str = "R$") -> Column:
    price = _col(price)
    text = F.translate(F.format_number(F.abs(price), 2), ",.", ".,")
    sign = F.when(price < 0, "-").otherwise("")
    return F.when(price.isNull() | (price == 0), F.lit(NO_PRICE)).otherwise(
        F.concat(sign, F.lit(currency + "\u00a0"), text)
    )


def format_location(city, area) -> Column:
    city, area = F.nullif(_col(city), F.lit("")), F.nullif(_col(area), F.lit(""))
    return F.coalesce(F.concat(area, F.lit(", "), city), city, area, F.lit(NO_LOCATION))


def source_label(c, labels: dict[str, str] | None = None) -> Column:
    key = F.nullif(_col(c), F.lit(""))
    label = F.concat(F.upper(F.substring(key, 1, 1)), F.substring(key, 2, 1 << 30))
    for name, text in (labels or {}).items():
        label = F.when(key == name, F.lit(text)).otherwise(label)
    return F.coalesce(label, F.lit(NO_SOURCE))
