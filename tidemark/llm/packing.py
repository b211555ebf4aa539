"""Best-fit packing of token sequences by a configuration linear program.

The histogram of piece lengths has at most ``capacity`` entries however many documents there are.
Over it the configuration program (fewest sequences, each filled by some multiset of lengths,
covering the histogram) is solved by multiplicative weights: each round fills its share of the
sequences by configurations priced by an exact knapsack dynamic program, in integral steps, and lowers
the weights of lengths that are ahead of the others. Where lengths are rare and a step is held back by
them, a round goes on with the best configurations that contain the lengths furthest behind; all come from
the round's one dynamic program. What the rounds leave is placed by best fit, in the same aggregated form. The result is a short list of (configuration, how often); the pieces are then
numbered per length and look their places up.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, per_batch, text_or_empty, written
from .tokens import piece_ids

#: Rounds of the multiplicative weights method and how strongly progress moves the weights.
ROUNDS, RATE = 256, 4.0
#: The share of the least number of sequences that the rounds fill; what is awkward to place is left to the rounding.
FILLED = 0.95
#: Values grow with this power of the length, so that short pieces are left for what room remains.
LEAN = 1.2
#: Pieces of one length numbered by one task.
ROWS_PER_SLICE = 2000

Pattern = tuple[tuple[int, int], ...]


def prices(sizes: np.ndarray, values: np.ndarray, capacity: int) -> np.ndarray:
    """For each room up to the capacity the size that the multiset of the greatest value takes there, -1 for none
    (unbounded knapsack)."""
    best, taken = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    ends = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c], taken[c] = best[c - 1], -1
        if ends[c]:
            reach = best[c - sizes[:ends[c]]] + values[:ends[c]]
            k = int(reach.argmax())
            if reach[k] > best[c]:
                best[c], taken[c] = reach[k], k
    return taken


def priced(taken: np.ndarray, sizes: np.ndarray, room: int) -> Counter:
    """The multiset of sizes of the greatest value within the room."""
    found = Counter()
    while room > 0:
        if taken[room] < 0:
            room -= 1
        else:
            found[int(taken[room])] += 1
            room -= int(sizes[taken[room]])
    return found


def best_fit(rest: dict[int, int], bins: list[tuple[Pattern, int]], capacity: int) -> list[tuple[Pattern, int]]:
    """Places the rest, longest first, each into the fullest sequence with room; equal sequences
    are handled together."""
    room: dict[int, list[tuple[Pattern, int]]] = {}
    for pattern, times in bins:
        room.setdefault(capacity - sum(s * n for s, n in pattern), []).append((pattern, times))
    for size in sorted(rest, reverse=True):
        left = rest[size]
        while left:
            fits = [r for r in room if r >= size]
            if not fits:
                each = capacity // size
                for per, times in ((each, left // each), (left % each, 1)):
                    if per and times:
                        room.setdefault(capacity - per * size, []).append((((size, per),), times))
                break
            tight = min(fits)
            pattern, times = room[tight].pop()
            used = min(times, left)
            if times > used:
                room[tight].append((pattern, times - used))
            if not room[tight]:
                del room[tight]
            grown = tuple(sorted((Counter(dict(pattern)) + Counter({size: 1})).items(), reverse=True))
            room.setdefault(tight - size, []).append((grown, used))
            left -= used
    return [b for group in room.values() for b in group]


def fill(pattern: dict[int, int], sizes: np.ndarray, left: np.ndarray, capacity: int) -> None:
    """Uses the room of a pattern that was cut to what is left, by the longest lengths that fit."""
    room = capacity - sum(int(sizes[k]) * n for k, n in pattern.items())
    while room > 0:
        fits = np.flatnonzero((sizes <= room) & (left > 0))
        fits = [int(k) for k in fits[::-1] if left[k] > pattern.get(int(k), 0)][:1]
        if not fits:
            break
        pattern[fits[0]] = pattern.get(fits[0], 0) + 1
        room -= int(sizes[fits[0]])


def program(
    histogram: dict[int, int], capacity: int, rounds: int = ROUNDS,
) -> tuple[list[tuple[Pattern, int]], list[tuple[Pattern, int]], dict[int, int]]:
    """Full pieces, the configurations of the rounds with how often each is used, and the lengths that they leave."""
    done: list[tuple[Pattern, int]] = []
    if histogram.get(capacity):
        done.append((((capacity, 1),), histogram[capacity]))
    sizes = np.array(sorted(s for s in histogram if s < capacity), int)
    need = np.array([histogram[s] for s in sizes], float)
    left = need.copy()
    least = -(-int((sizes * need).sum()) // capacity)
    bins: list[tuple[Pattern, int]] = []
    goal, used = max(1, int(FILLED * least)), 0
    for n in range(rounds):
        live = np.flatnonzero(left > 0)
        if not len(live):
            break
        ahead = left[live] / need[live]
        here = sizes[live]
        taken = prices(here, here ** LEAN * np.exp(RATE * (ahead - ahead.mean()) / rounds ** 0.5), capacity)
        open_ = -(-goal * (n + 1) // rounds) - used
        for first in (None, *np.argsort(-ahead, kind="stable").tolist()):
            if not open_:
                break
            if first is None:
                found = priced(taken, here, capacity)
            elif left[live[first]] > 0:
                found = priced(taken, here, capacity - int(here[first])) + Counter({first: 1})
            else:
                continue
            pattern = {int(live[k]): min(n, int(left[live[k]])) for k, n in found.items() if left[live[k]] > 0}
            fill(pattern, sizes, left, capacity)
            times = int(min([open_, *(left[k] // n for k, n in pattern.items())]))
            for k, per in pattern.items():
                left[k] -= per * times
            bins.append((tuple(sorted(((int(sizes[k]), per) for k, per in pattern.items()), reverse=True)), times))
            open_, used = open_ - times, used + times
    return done, bins, {int(s): int(n) for s, n in zip(sizes, left) if n > 0}


def solve(histogram: dict[int, int], capacity: int, rounds: int = ROUNDS) -> list[tuple[Pattern, int]]:
    """Configurations and how often each is used; together they hold every length as often as the
    histogram. Deterministic. An empty histogram gives no configurations."""
    full, bins, rest = program(histogram, capacity, rounds)
    return full + best_fit(rest, bins, capacity)


def places(plan: list[tuple[Pattern, int]]) -> dict[str, np.ndarray]:
    """For each length the runs of its places, sorted by (length, first rank): the rank-th piece of
    a length lies in sequence ``base + (rank - first) // per`` at ``at + ((rank - first) % per) * length``."""
    runs, ranks, base = [], Counter(), 0
    for pattern, times in plan:
        at = 0
        for size, per in pattern:
            runs.append((size, ranks[size], base, per, at))
            ranks[size] += per * times
            at += size * per
        base += times
    table = np.array(sorted(runs), np.int64).reshape(-1, 5)
    return {"key": (table[:, 0] << 40) | table[:, 1], "first": table[:, 1], "base": table[:, 2], "per": table[:, 3], "at": table[:, 4]}


def token_pieces(docs: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: each document's ids with ``end_id`` behind them,
    cut into pieces of the capacity where longer."""
    schema = T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
    ])
    end = np.array([end_id], "<u4")

    def one(batch: pa.RecordBatch) -> dict:
        rows = {f.name: [] for f in schema}
        all_ids, ends = piece_ids(path).encode(batch.column(1))
        for n, doc_id in enumerate(batch.column(0).to_pylist()):
            ids = np.concatenate([all_ids[ends[n]:ends[n + 1]], end])
            for piece, at in enumerate(range(0, len(ids), capacity)):
                part = ids[at:at + capacity]
                for name, value in zip(rows, (doc_id, piece, at, len(part), zlib.crc32(part))):
                    rows[name].append(value)
        return rows

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(per_batch(one, schema), schema)


def numbered(pieces: DataFrame, most: int) -> DataFrame:
    """Adds ``rank``, gapless from 0 within each length. ``most`` is the count of the commonest
    length; lengths are numbered in hashed slices, so that no task meets one length whole."""
    slices = max(1, -(-most // ROWS_PER_SLICE))
    rows = pieces.withColumn("slice", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(slices)))
    counts = rows.groupBy("length", "slice").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "slice").orderBy("doc_id", "piece", "ids_crc32")
    return rows.join(counts, ["length", "slice"]).withColumn("rank", F.col("before") + F.row_number().over(within) - 1)


def pack(pieces: DataFrame, capacity: int, rounds: int = ROUNDS) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``; ``length`` is from 1 to the capacity."""
    histogram = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = places(solve(histogram, capacity, rounds))
    schema = T.StructType([
        *[f for f in pieces.schema], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()),
    ])
    names = pieces.columns

    def one(batch: pa.RecordBatch) -> dict:
        length, rank = (batch.column(n).to_numpy() for n in ("length", "rank"))
        run = np.searchsorted(table["key"], (length.astype(np.int64) << 40) | rank, side="right") - 1
        nth = rank - table["first"][run]
        return {n: batch.column(n) for n in names} | {
            "sequence_id": table["base"][run] + nth // table["per"][run],
            "offset": table["at"][run] + nth % table["per"][run] * length,
        }

    return numbered(pieces, max(histogram.values(), default=0)).select(*names, "rank").mapInArrow(per_batch(one, schema), schema)


def pack_documents(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """All documents as pieces placed in sequences of at most ``capacity`` tokens.

    Reads ``doc_id`` and ``text`` only. NULL text counts as empty and gives one piece, the end id;
    repeated rows and NULL ids are packed like any others; an empty table gives no rows.
    """
    return pack(written(token_pieces(docs, path, capacity, end_id), "packing-pieces"), capacity)
