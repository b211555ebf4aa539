"""Sharding by a hierarchical weighted hash tree.

A document descends region, rack and shard. At each level every child draws ``-ln(u) / weight``
with ``u`` hashed from (document, child), and the smallest draw wins, so a child gets its share of
the weight and a changed weight moves documents only into or out of the subtree that changed.
A shard added to a tree opens a region of its own: all that moves then moves into that shard.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty

#: Rows numbered by one task; a shard is numbered in so many slices that none holds many more.
ROWS_PER_SLICE = 2000


@dataclass(frozen=True)
class Leaf:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def even_tree(shards: int = 16, per_rack: int = 2, racks: int = 2) -> list[Leaf]:
    """``shards`` equal shards, ``per_rack`` to a rack and ``racks`` to a region."""
    return [Leaf(f"g{s // (per_rack * racks)}", f"r{s // per_rack % racks}", s) for s in range(shards)]


def with_shard(tree: list[Leaf], shard: int, weight: float = 1.0) -> list[Leaf]:
    """The tree with one more shard in a region of its own."""
    return [*tree, Leaf(f"new{shard}", "r0", shard, weight)]


def draw(key: Column, path: str, weight: float) -> Column:
    """An exponential clock of the node for a key: the earliest of several wins by weight."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(path)), 11)
    return -F.log((bits + F.lit(0.5)) / F.lit(float(1 << 53))) / F.lit(weight)


def winner(key: Column, children: list[tuple[str, float]], result) -> Column:
    """What ``result(path)`` gives for the child with the earliest clock; ties go to the smaller path."""
    children = sorted((c for c in children if c[1] > 0), key=lambda c: c[0])
    if len(children) == 1:
        return result(children[0][0])
    first = F.array_min(F.array(*[
        F.struct(draw(key, path, weight).alias("d"), F.lit(n).alias("n")) for n, (path, weight) in enumerate(children)
    ]))["n"]
    pick = None
    for n, (path, _) in enumerate(children):
        pick = F.when(first == n, result(path)) if pick is None else pick.when(first == n, result(path))
    return pick


def shard_of(key: Column, tree: list[Leaf]) -> Column:
    """The shard a key descends to. NULL keys share one path."""
    key = F.coalesce(key.cast("string"), F.lit("\0null"))

    def level(leaves: list[Leaf], path: str, names: list[str]) -> Column:
        if not names:
            return F.lit(leaves[0].shard)
        groups: dict[str, list[Leaf]] = {}
        for leaf in leaves:
            groups.setdefault(f"{path}/{getattr(leaf, names[0])}", []).append(leaf)
        weights = [(p, sum(leaf.weight for leaf in g)) for p, g in groups.items()]
        return winner(key, weights, lambda p: level(groups[p], p, names[1:]))

    return level(tree, "", ["region", "rack", "shard"])


def shards(docs: DataFrame, tree: list[Leaf], grown: list[Leaf] | None = None) -> DataFrame:
    """Every document with its shard and its slot there.

    Reads ``doc_id`` and ``text`` only, whatever further columns the table has. NULL text counts as
    empty, NULL ids form one key, repeated rows each get a slot (which of equal rows comes first is
    open, the set of slots is not), an empty table gives no rows.

    A slot needs a gapless number within a shard that may hold any share of the rows, so the shard
    is cut into hashed slices: rows are numbered within a slice, slices by their running counts.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text_or_empty()) + 1).cast("long").alias("size"),
        F.crc32(text_or_empty()).alias("text_crc32"),
    )
    rows = rows.select(
        "*",
        F.lit("key").alias("law"),
        shard_of(F.col("doc_id"), tree).cast("int").alias("shard"),
        (shard_of(F.col("doc_id"), grown) if grown else F.lit(None)).cast("int").alias("grown_shard"),
    )
    slices = max(1, -(-docs.count() // (ROWS_PER_SLICE * max(1, len(tree)))))
    rows = rows.withColumn("slice", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(slices)))
    counts = rows.groupBy("shard", "slice").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("shard", "slice").orderBy("doc_id", "text_crc32", "size")
    return (
        rows.join(counts, ["shard", "slice"])
        .withColumn("slot", F.col("before") + F.row_number().over(within) - 1)
        .select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
    )
