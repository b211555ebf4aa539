"""Filters, searches, sorts and pages over the inventory and the run log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import _col, normalize_purpose

MAX_PER_PAGE = 100

# Purposes a scope may name, and the form of its slugs.
SCOPE_PURPOSES = ["sale", "rent", "venda", "locacao", "locação"]
SLUG = r"^[a-z0-9]+(?:-[a-z0-9]+)*$"

# Sort name -> columns, each descending unless marked '+'; NULLs always last.
SORTS = {
    "price_asc": ["+price"],
    "price_desc": ["price"],
    "area_desc": ["area_m2"],
    "bedrooms_desc": ["bedrooms"],
    "recent": ["updated_at", "last_seen_at"],
}


def visible(df: DataFrame, status_col="status", subtype_col="property_subtype", hidden="Comercial") -> DataFrame:
    """Active rows whose subtype is not the hidden one; an unknown subtype stays visible."""
    return df.filter((F.col(status_col) == "ACTIVE") & ~F.col(subtype_col).eqNullSafe(hidden))


def contains_ci(df: DataFrame, col: str, text: str) -> DataFrame:
    """Case-insensitive substring; '%' and '_' in the text act as wildcards."""
    return df.filter(F.col(col).ilike(f"%{text}%"))


def price_between(df: DataFrame, col: str = "price", lo=None, hi=None) -> DataFrame:
    if lo is not None:
        df = df.filter(F.col(col) >= lo)
    if hi is not None:
        df = df.filter(F.col(col) <= hi)
    return df


def attr_equals(df: DataFrame, col: str, n: int) -> DataFrame:
    return df.filter(F.col(col) == n)


def attr_at_least(df: DataFrame, col: str, n: int) -> DataFrame:
    return df.filter(F.coalesce(F.col(col), F.lit(0)) >= n)


def sort_order(sort: str | None, tiebreak: list[str]) -> list[Column]:
    """Sort keys of a named order; the tie-break keeps pages stable, also with no order at all."""
    keys = [
        F.col(c[1:]).asc_nulls_last() if c.startswith("+") else F.col(c).desc_nulls_last()
        for c in SORTS.get(sort or "", [])
    ]
    return keys + [F.col(c).asc() for c in tiebreak]


def sort_listings(df: DataFrame, sort: str | None, tiebreak: list[str]) -> DataFrame:
    return df.orderBy(*sort_order(sort, tiebreak))


def sort_page(df: DataFrame, sort: str | None, tiebreak: list[str]) -> DataFrame:
    """The client's order within a page already cut: missing numbers count as 0 going down."""
    orders = {
        "price_asc": [F.col("price").asc_nulls_last()],
        "price_desc": [F.coalesce("price", F.lit(0)).desc()],
        "area_desc": [F.coalesce("area_m2", F.lit(0)).desc()],
        "bedrooms_desc": [F.coalesce("bedrooms", F.lit(0)).desc()],
        "recent": [F.coalesce("updated_at", "last_seen_at").desc_nulls_last()],
    }
    return df.orderBy(*orders.get(sort or "", []), *[F.col(c).asc() for c in tiebreak])


def paginate(df: DataFrame, page: int = 1, per_page: int = 20) -> DataFrame:
    """One page of an ordered frame; Spark plans it as a bounded top-k, not a full sort."""
    if page < 1 or not 1 <= per_page <= MAX_PER_PAGE:
        raise ValueError("page starts at 1 and per_page lies in 1..100")
    return df.offset((page - 1) * per_page).limit(per_page)


def page_count(total, per_page: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(_col(total) / F.lit(per_page))).cast("bigint")


def total(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total"))


def filtered(df: DataFrame, city=None, lo=None, hi=None, bedrooms=None) -> DataFrame:
    df = visible(df)
    if city:
        df = contains_ci(df, "city", city)
    df = price_between(df, "price", lo, hi)
    return df if bedrooms is None else attr_equals(df, "bedrooms", bedrooms)


def search(df, city=None, lo=None, hi=None, bedrooms=None, sort=None, page=1, per_page=20, tiebreak=("external_id",)):
    """A page of visible listings, and a one-row frame with the total of the same filter."""
    hits = filtered(df, city, lo, hi, bedrooms)
    return paginate(sort_listings(hits, sort, list(tiebreak)), page, per_page), total(hits)


def lookup(df: DataFrame, keys_df: DataFrame) -> DataFrame:
    """Rows for a batch of keys, in one join over the key columns both frames share."""
    return df.join(keys_df.distinct(), [c for c in keys_df.columns if c in df.columns], "left_semi")


def lookup_source(sources: DataFrame, wanted: DataFrame) -> DataFrame:
    """Sources asked for by id or by key: text in the form of a UUID is an id, else a key."""
    uuid = r"(?i)^(urn:uuid:)?\{?[0-9a-f]{8}-?([0-9a-f]{4}-?){3}[0-9a-f]{12}\}?$"
    asked = wanted.select(F.col(wanted.columns[0]).alias("_ask")).distinct()
    is_id = F.col("_ask").rlike(uuid)
    by_id = asked.filter(is_id).select(F.col("_ask").alias("id"))
    by_key = asked.filter(~is_id).select(F.col("_ask").alias("key"))
    return sources.join(by_id, "id", "left_semi").unionByName(sources.join(by_key, "key", "left_semi"))


def enabled_sources(sources: DataFrame, registered: DataFrame) -> DataFrame:
    """Enabled sources with a sale-capable profile, by key."""
    able = registered.filter(F.col("supports_sale")).select("key").distinct()
    return sources.filter(F.col("enabled") & F.col("key").isNotNull()).join(able, "key", "left_semi").orderBy("key")


def runs_page(runs: DataFrame, status: str | None = None, page: int = 1, per_page: int = 20, tiebreak="run_id"):
    hits = runs.filter(F.col("status") == status) if status else runs
    ordered = hits.orderBy(F.col("started_at").desc_nulls_last(), F.col(tiebreak).asc())
    return paginate(ordered, page, per_page), total(hits)


def allowed_purposes(purposes: list[str] | None) -> list[str]:
    """Purposes an offer filter may name, normalised; unknown ones are dropped."""
    known = {"sale": "SALE", "venda": "SALE", "rent": "RENT", "locacao": "RENT", "locação": "RENT", "aluguel": "RENT"}
    cleaned = [str(p or "").strip().lower() for p in purposes or []]
    return sorted({known[p] for p in cleaned if p in known})


def offers_in_scope(df: DataFrame, purposes: list[str] | None = None, col: str = "offers") -> DataFrame:
    """Keep the offers whose purpose is allowed; with nothing allowed by name, keep all."""
    allowed = allowed_purposes(purposes)
    if not allowed:
        return df
    if dict(df.dtypes)[col].startswith("array"):
        return df.withColumn(col, F.filter(col, lambda o: normalize_purpose(o["purpose"]).isin(allowed)))
    return df.filter(normalize_purpose(col).isin(allowed))


def scope_purposes(df: DataFrame, scope_col: str = "scope", out: str = "purposes") -> DataFrame:
    """SALE/RENT named by ``purposes``, else ``purpose``, else sale; a list is JSON text."""
    named = lambda key: F.try_element_at(F.col(scope_col), F.lit(key))
    filled = lambda c: F.when(~F.trim(c).isin("", "[]"), c)
    given = F.coalesce(filled(named("purposes")), filled(named("purpose")), F.lit("sale"))
    values = F.coalesce(F.when(given.startswith("["), F.from_json(given, "array<string>")), F.array(given))
    known = F.filter(F.transform(values, normalize_purpose), lambda p: p.isin("SALE", "RENT"))
    return df.withColumn(out, F.array_sort(F.array_distinct(known)))


def expand_scopes(df: DataFrame, scope_col: str = "scope") -> DataFrame:
    """One row per purpose of a scope map, cleaned, with a flag for each way it can be invalid."""
    scope = F.col(scope_col)
    kept = F.map_filter(scope, lambda k, v: v.isNotNull() & (v != "") & ~k.isin("query", "purposes", "purpose"))
    asked = F.nullif(F.try_element_at(scope, F.lit("query")), F.lit(""))
    kept = F.when(
        asked.isNotNull() & ~F.map_contains_key(kept, "q"), F.map_concat(kept, F.create_map(F.lit("q"), asked))
    ).otherwise(kept)
    listed = F.try_element_at(scope, F.lit("purposes"))
    purposes = F.coalesce(F.when(listed.startswith("["), F.from_json(listed, "array<string>")), F.array(listed))
    single = F.array(F.nullif(F.try_element_at(scope, F.lit("purpose")), F.lit("")))
    out = df.withColumn("purpose", F.explode_outer(F.when(F.nullif(listed, F.lit("")).isNotNull(), purposes).otherwise(single)))
    slug_ok = lambda key: F.coalesce(F.try_element_at(kept, F.lit(key)).rlike(SLUG), F.lit(True))
    return (
        out.withColumn("bad_purpose", F.coalesce(~F.col("purpose").isin("", *SCOPE_PURPOSES), F.trim(listed) == "[]", F.lit(False)))
        .withColumn("bad_slug", ~(slug_ok("state_slug") & slug_ok("city_slug")))
        .withColumn(scope_col, kept)
    )


def json_field_equals(df: DataFrame, col: str, path: str, value: str) -> DataFrame:
    return df.filter(F.get_json_object(col, path) == value)


def first_n_per(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group; the rank filter is applied before the shuffle as well."""
    rank = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def samples(sightings: DataFrame, details: DataFrame, order: list[str], cols: list[str], n: int = 5) -> DataFrame:
    """The first n cards in discovery order with numbers as text, and their detail if any."""
    types = dict(sightings.dtypes)
    text = lambda c: F.col(c).cast("string").alias(c) if types[c].startswith("decimal") else F.col(c)
    first = sightings.orderBy(*order).limit(n).select(*[text(c) for c in cols])
    return first.join(details.withColumnRenamed("external_id", "_id"), F.col("external_id") == F.col("_id"), "left").drop("_id")
