"""Order-preserving array clean-up; arrays are one record's tags or pictures, never a group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col, casefold, let, none_if_blank
from .urls import absolute_url, strip_tracking


def _first_of_each(values: Column, key: Callable[[Column], Column]) -> Column:
    """First value of each key in the order given, by sorting: n log n in the array's length."""
    # sort_array compares in one step; array_sort would evaluate its default comparator for every pair.
    keyed = F.sort_array(
        F.transform(values, lambda v, i: F.struct(key(v).alias("k"), i.alias("i"), v.alias("v")))
    )
    heads = let(
        keyed,
        lambda s: F.filter(s, lambda e, j: (j == 0) | (e["k"] != F.get(s, F.greatest(j - 1, F.lit(0)))["k"])),
    )
    in_order = F.sort_array(F.transform(heads, lambda e: F.struct(e["i"].alias("i"), e["v"].alias("v"))))
    return F.transform(in_order, lambda e: e["v"])


def dedupe_array(c, fold: bool = True) -> Column:
    """Blank entries dropped, spaces normalised, first spelling of each folded key kept in order."""
    # Plain repeats go first, by hash, so that only distinct spellings are cleaned and sorted.
    spellings = F.array_distinct(F.coalesce(_col(c), F.array()))
    values = F.array_distinct(F.filter(F.transform(spellings, none_if_blank), lambda v: v.isNotNull()))
    return _first_of_each(values, casefold if fold else lambda v: v)


def dedupe_urls(c, base: str | None = None) -> Column:
    """``dedupe_array`` after resolving against ``base``, or else after dropping tracking."""
    clean = (lambda u: absolute_url(u, base)) if base else strip_tracking
    return dedupe_array(F.transform(_col(c), clean))


def gallery(c, thumb_pattern: str, fold: bool = True) -> Column:
    """Distinct pictures in order; generated thumbnails only where there is nothing else."""
    urls = F.filter(F.coalesce(_col(c), F.array()), lambda u: u.isNotNull() & (u != ""))
    urls = _first_of_each(urls, casefold if fold else lambda v: v)
    real = lambda all_: F.filter(all_, lambda u: ~u.rlike(thumb_pattern))
    return let(urls, lambda all_: let(real(all_), lambda r: F.when(F.size(r) > 0, r).otherwise(all_)))


