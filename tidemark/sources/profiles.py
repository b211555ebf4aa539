"""Source profiles: how a source's pages are read and what its crawls can do.

A profile row has host, key, aliases, card_pattern (a regular expression whose first group is a
card's markup), supports_sale, supports_rent and supports_neighborhood.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resolve_aliases(requests: DataFrame, profiles: DataFrame, col: str = "key") -> DataFrame:
    """Requests with the canonical key of the source they name by key or alias."""
    names = profiles.select(
        F.col("key").alias("source_key"),
        F.explode(F.concat(F.array("key"), F.coalesce("aliases", F.array().cast("array<string>")))).alias(col),
    ).distinct()
    return requests.withColumn(col, F.lower(F.trim(col))).join(names, col, "left")


def supports_scope(profiles: DataFrame, purpose: str, neighborhood: bool = False) -> DataFrame:
    """Profiles able to crawl a purpose, and single neighbourhoods where that is asked."""
    able = F.col("supports_sale") if purpose == "SALE" else F.col("supports_rent")
    return profiles.filter(able & (F.col("supports_neighborhood") | F.lit(not neighborhood)))


def with_profile(pages: DataFrame, profiles: DataFrame) -> DataFrame:
    """Pages with the profile of their host."""
    return pages.join(profiles, "host")
