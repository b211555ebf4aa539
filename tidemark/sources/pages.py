"""Raw pages and their payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import _col, let
from ..functions.urls import url_host


def read_pages(spark: SparkSession, path: str, url: str = "url", body: str = "html") -> DataFrame:
    """Raw pages with their host; a scan reads only the columns that are used later on."""
    pages = spark.read.parquet(path)
    return pages.withColumn("host", url_host(url)).withColumn(body, unwrap_payload(body))


def unwrap_payload(c) -> Column:
    """The ``html`` text of a JSON answer; any other body as it is."""
    body = _col(c)
    wrapped = F.trim(F.regexp_replace(body, r"^\s+", "")).startswith("{")
    # VARIANT keeps the field's type, so that a number or object named html is not taken for text.
    field = F.try_variant_get(F.try_parse_json(body), "$.html", "string")
    is_text = F.schema_of_variant(F.try_variant_get(F.try_parse_json(body), "$.html", "variant")) == "STRING"
    return F.when(wrapped, F.coalesce(F.when(is_text, field), body)).otherwise(body)
