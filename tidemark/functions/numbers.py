"""Numbers in listing text: money, areas, counts, distances, coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col, let, normalize_key, normalize_space


def parse_decimal_br(c) -> Column:
    """First number of a text in Brazilian notation; NULL where there is none."""
    def read(token: Column) -> Column:
        no_dots = F.replace(token, F.lit("."), F.lit(""))
        plain = (
            F.when(token.contains(","), F.replace(no_dots, F.lit(","), F.lit(".")))
            .when(token.rlike(r"^[^.]+(\.[^.]{3})+$"), no_dots)
            .otherwise(token)
        )
        return plain.try_cast("decimal(28,10)")

    return let(F.regexp_extract(normalize_space(c), r"[-+]?\d[\d.,]*", 0), read)


def _two_places(number: Column) -> Column:
    return F.bround(number, 2).try_cast("decimal(18,2)")


def parse_money(c) -> Column:
    """Rounded half to even, as decimal quantisation does."""
    return _two_places(parse_decimal_br(c))


parse_area = parse_money


def parse_number_simple(c) -> Column:
    """Legacy reading: every dot separates thousands, the comma is the decimal point."""
    token = F.regexp_extract(F.replace(_col(c), F.lit(" "), F.lit("")), r"[\d.,]+", 0)
    return F.translate(token, ",.", ".").try_cast("double")


def _first_int(text: Column, pattern: str) -> Column:
    return F.regexp_extract(text, pattern, 1).try_cast("int")


def infer_bathrooms(suites, features=None) -> Column:
    """Suites plus a lavatory, a social and a service bathroom named in the features."""
    text = normalize_key(F.lit("") if features is None else features)
    room = r"\b(?:banheiro|banho|wc)\s+"
    total = (
        F.coalesce(_col(suites), F.lit(0))
        + text.contains("lavabo").cast("int")
        + text.rlike(room + r"social\b").cast("int")
        + text.rlike(room + r"(?:empregada|servico|auxiliar)\b").cast("int")
    )
    return let(total, lambda rooms: F.nullif(rooms, F.lit(0)))


def attributes_from_text(c) -> Column:
    """Area, bedrooms, suites, bathrooms and parking read from free text."""
    def read(text: Column) -> Column:
        suites = _first_int(text, r"(\d+)\s*suites?")
        baths = _first_int(text, r"(\d+)\s*(?:banheiros?|banhos?|bhs?|wcs?)")
        area = F.regexp_extract(text, r"(\d+(?:[.,]\d+)?)\s*(?:m\s*[²2]|metros?\s+quadrados?)", 1)
        return F.struct(
            parse_area(area).alias("area_m2"),
            _first_int(text, r"(\d+)\s*(?:dorms?|dormitorios?)").alias("bedrooms"),
            suites.alias("suites"),
            F.coalesce(baths, infer_bathrooms(suites)).alias("bathrooms"),
            _first_int(text, r"(\d+)\s*vagas?").alias("parking_spaces"),
        )

    return let(normalize_key(c), read)


def distance_m(c) -> Column:
    """Distance as written and in whole metres, cut not rounded."""
    pattern = r"(\d+(?:[.,]\d+)?)\s*(km|metros?|m)\b"

    def read(text: Column) -> Column:
        scale = F.when(F.regexp_extract(text, pattern, 2) == "km", 1000).otherwise(1)
        metres = parse_decimal_br(F.regexp_extract(text, pattern, 1)) * scale
        return F.struct(
            F.nullif(F.regexp_extract(text, pattern, 0), F.lit("")).alias("distance_text"),
            F.floor(metres).cast("int").alias("distance_meters"),
        )

    return let(normalize_key(c), read)


def coordinates(c) -> Column:
    pattern = r"center=(-?\d+(?:\.\d+)?),(-?\d+(?:\.\d+)?)"
    place = lambda n: F.regexp_extract(_col(c), pattern, n).try_cast("decimal(9,6)")
    return F.struct(place(1).alias("latitude"), place(2).alias("longitude"))


def construction_year(c) -> Column:
    text = normalize_space(c)
    year = F.when(text.rlike(r"^\d{4}$"), text).try_cast("int")
    return F.when(year.between(1800, 2100), year)
