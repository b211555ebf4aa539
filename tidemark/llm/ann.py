"""Nearest neighbours by inner product over shifted space-filling curves.

Vectors are rotated, projected to a few dimensions, shifted and put on a Hilbert curve, several
times over. Each ordering is cut into ranges of keys that Spark deals out; a query meets the range
it lies in and the two beside it. The windows of all orderings are merged and ranked by the exact
inner product. How far the orderings agree on a query's neighbours tells how many they have missed;
a query whose agreement is low (its neighbourhood does not show in a few dimensions) has its window
in the first ordering widened over the ranges that it has not seen yet.

Equal vectors are one point. A point keeps its smallest ids only, as many as a result can name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, per_batch, written

ORDERINGS, DIMENSIONS, DEPTH = 4, 8, 7
#: Points in a range: so many, or a ten-thousandth of all, so that there are 10,000 ranges at most.
RANGE_POINTS, MOST_RANGES = 4096, 10_000
#: Queries whose estimated recall is below this are widened, in groups of so many.
ENOUGH, QUERY_GROUP = 0.97, 16_384
SEED = 7
#: Scores held at once while a block of points meets its queries.
TILE = 1 << 22


def hilbert(points: np.ndarray, depth: int) -> np.ndarray:
    """Positions on the Hilbert curve of integer points (rows) of ``depth`` bits a dimension."""
    x = points.astype(np.int64).copy()
    n = x.shape[1]
    for q in (1 << b for b in range(depth - 1, 0, -1)):
        low = q - 1
        for i in range(n):
            high = (x[:, i] & q) != 0
            swap = np.where(high, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(high, low, swap)
            if i:
                x[:, i] ^= swap
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    flip = np.zeros(len(x), np.int64)
    for q in (1 << b for b in range(depth - 1, 0, -1)):
        flip ^= np.where((x[:, n - 1] & q) != 0, q - 1, 0)
    x ^= flip[:, None]
    key = np.zeros(len(x), np.int64)
    for b in range(depth - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[:, i] >> b & 1)
    return key


def curve_keys(vectors: np.ndarray, longest: float) -> np.ndarray:
    """One key per vector and ordering. Vectors are completed to one length, which turns the
    greatest inner product into the smallest distance."""
    vectors = vectors.astype(np.float64) / longest
    spare = np.sqrt(np.maximum(0.0, 1.0 - (vectors ** 2).sum(1)))
    full = np.hstack([vectors, spare[:, None]])
    width, keys = full.shape[1], []
    dims = min(DIMENSIONS, width)
    for ordering in range(ORDERINGS):
        rng = np.random.default_rng([SEED, ordering])
        axes = np.linalg.qr(rng.standard_normal((width, dims)))[0]
        at = (full @ axes * np.sqrt(width) + 3.0) / 6.0 + rng.uniform(-0.5, 0.5, dims) / (1 << DEPTH - 2)
        keys.append(hilbert(np.clip(at * (1 << DEPTH), 0, (1 << DEPTH) - 1).astype(np.int64), DEPTH))
    return np.stack(keys, axis=1)


def points_of(embeddings: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """``point, v, ids`` (one row per distinct vector, its ``k + 1`` smallest ids, the first its
    name) and ``vec_id, point`` of every valid row."""
    v = F.col("embedding").cast("array<float>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(
        F.col("vec_id").isNotNull() & (F.size("v") > 0) & ~bad & F.exists("v", lambda x: x != 0)
    )
    usual = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    rows = rows.filter(F.size("v") == (usual["d"] if usual else 0))
    order = Window.partitionBy("v").orderBy("vec_id")
    few = rows.distinct().withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1)
    points = few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    points = written(points.select(F.col("ids")[0].alias("point"), "v", "ids"), "ann-points")
    return points, rows


def _nearest(rows: np.ndarray, ids: np.ndarray, queries: np.ndarray, names: np.ndarray, k: int) -> dict:
    """The ``k`` best of ``rows`` for each query: by score, then id."""
    out = {"query": [], "point": [], "score": []}
    few, tile = min(k, len(ids)), max(1, TILE // len(ids))
    for q, line in ((q, line) for at in range(0, len(names), tile) for q, line in zip(names[at:at + tile], queries[at:at + tile] @ rows.T)):
        edge = np.partition(line, len(line) - few)[len(line) - few]
        near = np.flatnonzero(line >= edge)
        near = near[np.lexsort((ids[near], -line[near]))][:few]
        out["query"].append(np.full(len(near), q))
        out["point"].append(ids[near])
        out["score"].append(line[near])
    return {c: np.concatenate(v) if v else np.empty(0) for c, v in out.items()}


def blocked(placed: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The placed points with the ``block`` of their range, and ``ordering, range, blocks``.

    Points with one key share a range however many they are, so a range of more than ``most`` points
    is dealt by hash into blocks of about so many; a query meets all blocks of a range."""
    sizes = written(placed.groupBy("ordering", "range").agg(F.ceil(F.count("*") / most).alias("blocks")), "ann-sizes")
    deal = F.pmod(F.xxhash64("point"), F.col("blocks"))
    return placed.join(sizes, ["ordering", "range"]).withColumn("block", deal).drop("blocks"), sizes


def search(embeddings: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row whose id divides by ``every``, the ``k`` nearest
    other rows found, best first, ties to the smaller id; ``score`` in double precision.

    Rows with a NULL id, a NULL, empty or zero vector, one with NULL or non-finite components, or of
    another width than the commonest take no part. Repeated rows count once; rows with equal vectors
    are found in order of their ids; fewer candidates give fewer rows; an empty table gives none.
    Reads ``vec_id`` and ``embedding`` only.
    """
    spark = embeddings.sparkSession
    bounded_batches(spark)
    points, rows = points_of(embeddings, k)
    asked = written(
        rows.filter(F.col("vec_id") % every == 0).distinct().join(points.select("point", "v"), "v")
        .select(F.col("vec_id").alias("query_id"), F.col("point").alias("query")), "ann-queries",
    )
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    size = points.agg(F.count("*").alias("n"), F.max(norm).alias("longest")).first()
    longest = size["longest"] or 1.0
    schema = T.StructType([*[points.schema[c] for c in ("point", "v")], T.StructField("keys", T.ArrayType(T.LongType()))])

    def keyed(batch: pa.RecordBatch) -> dict:
        vectors = np.array(batch.column("v").to_pylist(), np.float64)
        keys = curve_keys(vectors, longest).tolist() if len(vectors) else []
        return {"point": batch.column("point"), "v": batch.column("v"), "keys": keys}

    curves = written(points.select("point", "v").mapInArrow(per_batch(keyed, schema), schema), "ann-curves")
    each = max(RANGE_POINTS, size["n"] // MOST_RANGES)
    ranges = max(1, -(-size["n"] // each))
    cuts = [r / ranges for r in range(1, ranges)]
    edges = curves.agg(*[
        F.percentile_approx(F.col("keys")[o], cuts, 100 * ranges).alias(f"o{o}") for o in range(ORDERINGS)
    ]).first() if cuts else [[]] * ORDERINGS
    edges = [sorted(set(e or [])) for e in edges]

    def range_of(o: int):
        return F.size(F.filter(F.lit(edges[o]).cast("array<bigint>"), lambda e: e <= F.col("keys")[o])) if edges[o] else F.lit(0)

    placed = curves.select("point", "v", F.explode(F.array(*[
        F.struct(F.lit(o).alias("ordering"), range_of(o).alias("range")) for o in range(ORDERINGS)
    ])).alias("at")).select("point", "v", "at.ordering", "at.range")
    # Ordinary ranges hold about so many points and stay whole; only crowded ones get blocks.
    placed, sizes = blocked(written(placed, "ann-ranges"), 2 * each)
    placed = written(placed, "ann-placed")
    names = asked.select(F.col("query").alias("point")).distinct()
    queries = written(placed.join(names, "point", "left_semi").drop("block"), "ann-asked")
    found_schema = "query long, point long, score double, ordering int"

    def meet(key: tuple, data: pd.DataFrame, seekers: pd.DataFrame) -> pd.DataFrame:
        if not len(data) or not len(seekers):
            return pd.DataFrame({"query": [], "point": [], "score": [], "ordering": []})
        best = _nearest(np.stack(data["v"]).astype(np.float64), data["point"].to_numpy(),
                        np.stack(seekers["v"]).astype(np.float64), seekers["point"].to_numpy(), k + 1)
        return pd.DataFrame(best).assign(ordering=int(key[0]))

    def beside(seekers: DataFrame, data: DataFrame, by: list[str]) -> DataFrame:
        return data.groupBy(*by).cogroup(seekers.groupBy(*by)).applyInPandas(meet, found_schema)

    window = queries.withColumn("range", F.explode(F.sequence(F.col("range") - 1, F.col("range") + 1)))
    # Crowded seekers meet a range in groups, too.
    crowds = window.groupBy("ordering", "range").agg(F.ceil(F.count("*") / QUERY_GROUP).alias("groups"))
    crowds = written(crowds.join(sizes, ["ordering", "range"]), "ann-crowds")
    window = window.join(crowds, ["ordering", "range"]).withColumn("group", F.pmod(F.xxhash64("point"), F.col("groups")))
    window = window.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("groups", "blocks")
    met = placed.join(crowds, ["ordering", "range"]).withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)))
    per_ordering = Window.partitionBy("query", "ordering").orderBy(F.desc("score"), "point")
    near = beside(window, met.drop("groups", "blocks"), ["ordering", "range", "block", "group"])
    near = near.withColumn("n", F.row_number().over(per_ordering)).filter(F.col("n") <= k + 1).drop("n")
    near = written(near, "ann-near")

    best = Window.partitionBy("query").orderBy(F.desc("score"), "point")

    def merged(found: DataFrame) -> DataFrame:
        each = found.groupBy("query", "point").agg(F.max("score").alias("score"), F.count_distinct("ordering").alias("seen"))
        return each.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1)

    share = F.avg("seen") / ORDERINGS
    sure = merged(near).groupBy("query").agg((1 - F.pow(1 - share, F.lit(ORDERINGS))).alias("recall"), F.count("*").alias("n"))
    unsure = sure.filter((F.col("recall") < ENOUGH) | (F.col("n") <= k)).select(F.col("query").alias("point"))
    wide = queries.filter("ordering = 0").join(unsure, "point", "left_semi").select("point", "v", F.col("range").alias("own"))
    wide = written(wide, "ann-wide")
    groups = max(1, -(-wide.count() // QUERY_GROUP))
    group = F.pmod(F.xxhash64("point"), F.lit(groups))
    others = F.filter(F.sequence(F.lit(0), F.lit(len(edges[0]))), lambda r: F.abs(r - F.col("own")) > 1)
    seekers = wide.select("point", "v", F.explode(others).alias("range"), group.alias("group"))
    seekers = seekers.withColumn("ordering", F.lit(0)).join(sizes, ["ordering", "range"])
    seekers = seekers.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")
    whole = placed.filter("ordering = 0").withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    far = beside(seekers, whole, ["ordering", "range", "block", "group"])
    top = written(merged(near.union(far)).select("query", "point", "score"), "ann-top")

    named = top.join(points.select("point", "ids"), "point").select("query", "score", F.explode("ids").alias("vec_id"))
    result = asked.join(named, "query").filter("vec_id <> query_id")
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return result.withColumn("rank", F.row_number().over(last).cast("int")).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
