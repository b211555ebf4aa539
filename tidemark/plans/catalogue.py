"""Imports every query module, so that the registry is complete."""

from .registry import ORACLES, QUERIES

from . import (  # noqa: F401
    dedup_queries,
    join_queries,
    ordered_queries,
    page_queries,
    scalar_queries,
    search_queries,
    snapshot_queries,
    source_queries,
    stream_queries,
)

__all__ = ["ORACLES", "QUERIES"]
