"""Canonical JSON and the fingerprints made from it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col

# The fields of a listing card that its fingerprint covers.
CARD_FIELDS = [
    "title", "transaction_type", "property_type", "property_subtype", "city", "state",
    "neighborhood", "address_line", "price", "currency", "bedrooms", "suites", "bathrooms",
    "parking_spaces", "area_m2", "main_image_url", "offers", "tags",
]


def json_safe(c, data_type: str | None = None) -> Column:
    """Decimals and timestamps as the strings they are written as in JSON."""
    c = _col(c)
    if data_type and data_type.startswith("timestamp"):
        micros = F.date_format(c, "SSSSSS")
        return F.concat(
            F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"),
            F.when(micros != "000000", F.concat(F.lit("."), micros)).otherwise(""),
        )
    if data_type and not data_type.startswith("decimal"):
        return c
    return c.cast("string")


def canonical_json(fields: dict[str, Column]) -> Column:
    """Compact JSON with sorted keys; NULLs stay, so equal records give equal bytes."""
    ordered = [value.alias(name) for name, value in sorted(fields.items())]
    return F.to_json(F.struct(*ordered), {"ignoreNullFields": "false"})


def content_hash(fields: dict[str, Column]) -> Column:
    return F.sha2(canonical_json(fields), 256)


def hash_columns(df, cols: list[str]) -> Column:
    """``content_hash`` over columns of ``df``, decimals and timestamps written as strings."""
    types = dict(df.dtypes)
    return content_hash({name: json_safe(name, types[name]) for name in cols})


def offer_hash(purpose, price, currency) -> Column:
    return content_hash(
        {
            "purpose": _col(purpose),
            "price": json_safe(price),
            "currency": F.coalesce(_col(currency), F.lit("BRL")),
        }
    )


def scope_hash(scope) -> Column:
    """Fingerprint of a scope map; no scope equals the empty one."""
    return F.sha2(scope_json(scope), 256)


def scope_json(scope) -> Column:
    """A string map as canonical JSON, NULL as {}."""
    entries = F.array_sort(F.map_entries(_col(scope)))
    as_map = F.map_from_entries(entries)
    return F.coalesce(F.to_json(as_map, {"ignoreNullFields": "false"}), F.lit("{}"))


def sorted_offers(offers) -> Column:
    """Offers for hashing: by purpose, reduced to currency, price and purpose."""
    keyed = F.array_sort(
        F.transform(_col(offers), lambda o, i: F.struct(o["purpose"].alias("p"), i.alias("i"), o.alias("o")))
    )
    return F.transform(
        F.coalesce(keyed, F.array()),
        lambda e: F.struct(
            e["o"]["currency"].alias("currency"),
            e["o"]["price"].cast("string").alias("price"),
            e["o"]["purpose"].alias("purpose"),
        ),
    )


def card_hash(df) -> Column:
    """Fingerprint of a listing card; fields the frame lacks count as NULL."""
    types = dict(df.dtypes)
    fields = {}
    for name in CARD_FIELDS:
        if name == "offers":
            fields[name] = sorted_offers("offers") if "offers" in types else F.array()
        elif name == "tags":
            fields[name] = F.array_sort(F.coalesce(F.col("tags"), F.array())) if "tags" in types else F.array()
        else:
            fields[name] = json_safe(name, types[name]) if name in types else F.lit(None).cast("string")
    return content_hash(fields)


def stable_bucket(c, n: int) -> Column:
    """A bucket 0..n that depends only on the text."""
    if n <= 0:
        return F.lit(0).cast("bigint")
    return F.conv(F.substring(F.sha2(_col(c), 256), 1, 8), 16, 10).cast("bigint") % (n + 1)
