"""Periodic run detection by scale-tiled distribution.

A run is a stretch of words with a smallest period, at least ``LEAST`` words and three periods long,
that cannot be made longer. The places where a word equals the one a period later form an interval at
least two periods long, so it meets a boundary of any grid that is no coarser. Periods are therefore
taken by octaves, each with a grid of boundaries and tiles of its own scale. At a boundary two
Z-functions (of the words after it, and backwards of the words before it) say for every period of the
octave how far the equality reaches on either side. What a tile sees of a run is a fragment, an
interval of that equality cut off at the boundary's reach; fragments of one document and period are
shuffled together and stitched where they touch.

A document that fits in one tile is solved where it is read, as a single tile of every octave. A longer
one is exploded by Spark into overlapping tiles per octave, which are dealt out over all tasks.
Boundaries without an equal stretch of ``GRAM`` words on either side cannot report anything and are
passed over by comparing hashes of word sequences; all that is reported comes from the Z-functions.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import work_dir
from .common import bounded_batches, per_batch, text_or_empty, written

#: A run has at least so many words and periods.
LEAST, EXPONENT = 24, 3
#: Words of a tile (more where the octave's periods need it).
TILE = 8192
#: The first octave's periods are from 1 to 8, as shorter runs than LEAST do not count; GRAM is half of
#: the words by which the equality of any run reaches past one of its boundaries, at least.
FIRST, GRAM = 8, 8
#: Octaves that a text can have periods in at all.
MOST_OCTAVES = 26


def octave(number: int) -> tuple[int, int, int]:
    """The first period of an octave, the first one beyond it, and the step of its boundaries."""
    return (1, FIRST + 1, 2 * GRAM) if number == 0 else ((FIRST << number - 1) + 1, (FIRST << number) + 1, FIRST << number)


def octaves(words: int) -> int:
    """How many octaves a text of so many words has periods in."""
    number = 0
    while words >= LEAST and octave(number)[0] * EXPONENT <= words:
        number += 1
    return number


def z_function(codes: list[int], most: int) -> list[int]:
    """How far the codes agree with themselves moved by 0, 1 ... ``most``."""
    n, z, left, right = len(codes), [0] * (most + 1), 0, 0
    z[0] = n
    for i in range(1, min(most, n - 1) + 1):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and codes[k] == codes[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def reach_back(codes: list[int], boundary: int, most: int, step: int) -> list[int]:
    """For every move up to ``most`` how far the codes before the boundary agree with the moved ones,
    read backwards: the Z-function of the reversed left side before the reversed whole."""
    before = codes[max(0, boundary - step):boundary][::-1]
    whole = codes[max(0, boundary - step):boundary + most][::-1]
    z = z_function([*before, -1, *whole], 1 + len(whole))
    at = 1 + len(whole)  # where the unmoved left side begins
    return [z[at - d] for d in range(most + 1)]


def at_boundary(codes: list[int], boundary: int, number: int) -> Iterator[tuple[int, int, int]]:
    """The fragments ``period, low, high`` that a boundary shows in an octave: codes equal those a period
    later from ``low`` up to ``high``. Periods with a smaller one inside the same stretch are left out."""
    low, high, step = octave(number)
    longest = min(high - 1, len(codes) - boundary)
    ahead = z_function(codes[boundary:boundary + step + longest], longest) if longest > 0 else [0]
    back = reach_back(codes, boundary, longest, step)
    forward = [min(a, step) for a in ahead]
    for period in range(low, longest + 1):
        f, b = forward[period], back[period]
        whole = f < step and b < min(step, boundary)
        if f + b < (max(2 * period, LEAST - period) if whole else GRAM):
            continue
        rest, factor, primitive = period, 2, True
        while rest > 1 and primitive:
            if factor * factor > rest:
                factor = rest
            if rest % factor:
                factor += 1
                continue
            while rest % factor == 0:
                rest //= factor
            part = period // factor
            # The smaller period holds in the whole stretch if its equality reaches as far.
            primitive = not (back[part] >= b and ahead[part] >= f + period - part)
        if primitive:
            yield period, boundary - b, boundary + f


def grams(codes: np.ndarray) -> np.ndarray:
    """A hash of the ``GRAM`` codes from each place on; places near the end are all different."""
    n = len(codes)
    hashes = np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)
    if n >= GRAM:
        full = np.zeros(n - GRAM + 1, np.uint64)
        for k in range(GRAM):
            full = full * np.uint64(0xD6E8FEB86659FD93) + codes[k:n - GRAM + 1 + k].astype(np.uint64)
            full ^= full >> np.uint64(29)
        hashes[:n - GRAM + 1] = full
    return hashes


def solve(codes: np.ndarray, number: int, hashes: np.ndarray, inner: tuple[int, int]) -> Iterator[tuple[int, int, int]]:
    """The fragments that a tile shows in an octave at its boundaries from ``inner[0]`` to ``inner[1]``,
    touching ones joined. ``hashes`` are those of ``grams``."""
    low, high, step = octave(number)
    n, width = len(codes), high - low
    # Some of the hashes beyond the end are compared with padding that equals nothing.
    pad = np.concatenate([hashes, np.zeros(high + GRAM, np.uint64)])
    spots = np.arange(inner[0], min(inner[1], n) + 1, step)
    view = np.lib.stride_tricks.sliding_window_view(pad, width)
    hit = np.zeros(len(spots), bool)
    for moved in (0, GRAM):  # the words after the boundary, and those before it
        at = spots - moved
        some = np.flatnonzero((at >= 0) & (at + low < n))
        hit[some] |= (view[at[some] + low] == hashes[at[some]][:, None]).any(1)
    found: dict[int, list[list[int]]] = {}
    for spot in spots[hit].tolist():
        base = max(0, spot - step)
        window = codes[base:spot + step + high].tolist()
        for period, a, b in at_boundary(window, spot - base, number):
            own = found.setdefault(period, [])
            if own and a + base <= own[-1][1]:
                own[-1][1] = max(own[-1][1], b + base)
            else:
                own.append([a + base, b + base])
    for period, intervals in found.items():
        for a, b in intervals:
            yield period, a, b


def _words(texts: pa.Array) -> list[list[bytes]]:
    """The words of every text; only the six ASCII blanks separate them."""
    return [t.encode("utf-8", "surrogatepass").split() for t in texts.to_pylist()]


def packed(codes: np.ndarray) -> bytes:
    """A document's words numbered anew, in two bytes each if that is enough, else in four."""
    names, codes = np.unique(codes, return_inverse=True)
    return codes.astype("<u2" if len(names) <= 1 << 16 else "<u4").tobytes()


def _read(rows: DataFrame, tile: int, digest: bool) -> DataFrame:
    """Every row with its words counted and, where they fit in a tile, solved.

    ``doc_id, k1, k2, n, words`` with ``fragments`` of short documents and ``codes`` of long ones. Words
    are numbered per batch of rows; the numbers of two documents never meet. With ``digest`` the words of
    a document that can have no run are their SHA-256 at once.
    """
    schema = T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()),
        T.StructField("n", T.LongType()), T.StructField("words", T.StringType()), T.StructField("codes", T.BinaryType()),
        T.StructField("fragments", T.ArrayType(T.StructType([
            T.StructField("period", T.LongType()), T.StructField("low", T.LongType()), T.StructField("high", T.LongType())]))),
    ])

    def one(batch: pa.RecordBatch) -> dict:
        ids, lists = batch.column(0).to_pylist(), _words(batch.column(1))
        sizes = np.array([len(w) for w in lists], np.int64)
        flat = pa.array([w for words in lists for w in words], pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
        ends = np.cumsum(sizes)
        fragments: list[list] = [[] for _ in lists]
        # Short documents in a row, each followed by a code of its own that no other place has.
        short = np.flatnonzero((sizes <= tile) & (sizes >= LEAST))
        if len(short):
            top = int(flat.max()) + 1
            starts = np.cumsum(sizes[short] + 1) - sizes[short] - 1
            row = np.concatenate([np.append(flat[ends[s] - sizes[s]:ends[s]], top + k) for k, s in enumerate(short)])
            hashes = grams(row)
            for number in range(octaves(int(sizes[short].max()))):
                for period, low, high in solve(row, number, hashes, (0, len(row))):
                    k = int(np.searchsorted(starts, low, "right")) - 1
                    fragments[short[k]].append((period, low - int(starts[k]), high - int(starts[k])))
        words = [b" ".join(w) for w in lists]
        keys = [xxhash.xxh3_128_digest(b"%r " % i + w) for i, w in zip(ids, words)]
        marks = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
        return {
            "doc_id": batch.column(0), "k1": marks[:, 0], "k2": marks[:, 1], "n": sizes,
            "words": [
                sha256(w).hexdigest() if digest and not own and s <= tile else w.decode("utf-8", "surrogatepass")
                for w, own, s in zip(words, fragments, sizes)
            ],
            "codes": [packed(flat[e - s:e]) if s > tile else None for s, e in zip(sizes, ends)],
            "fragments": [[dict(zip(("period", "low", "high"), f)) for f in own] for own in fragments],
        }

    return rows.mapInArrow(per_batch(one, schema), schema)


def _tiles(long: DataFrame, tile: int) -> DataFrame:
    """Long documents exploded into tiles ``k1, k2, octave, at, codes, width, first, last``: per octave
    stretches of ``tile`` words (more where its periods are longer) with what the boundaries from ``first``
    to ``last`` reach on both sides. Codes are cut as bytes, ``width`` each."""
    named = [dict(zip(("low", "high", "step"), octave(k)), octave=k) for k in range(MOST_OCTAVES)]
    numbers = F.array(*[F.struct(*[F.lit(v).cast("long").alias(n) for n, v in o.items()]) for o in named])
    per = long.select(
        "k1", "k2", "n", "codes", (F.octet_length("codes") / F.col("n")).cast("int").alias("width"),
        F.explode(F.filter(numbers, lambda o: o["low"] * EXPONENT <= F.col("n"))).alias("o"),
    ).select("k1", "k2", "n", "codes", "width", "o.*")
    size = (F.ceil(F.greatest(F.lit(tile), 2 * F.col("step")) / F.col("step")) * F.col("step")).cast("long")
    cut = per.withColumn("size", size).withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n"), F.col("size"))))
    cut = cut.withColumn("at", F.greatest(F.col("from") - F.col("step"), F.lit(0)))
    words = F.col("from") + F.col("size") + F.col("step") + F.col("high") - F.col("at")
    piece = F.substring("codes", (F.col("at") * F.col("width") + 1).cast("int"), (words * F.col("width")).cast("int"))
    first = F.col("from") - F.col("at")
    return cut.select("k1", "k2", "octave", "at", piece.alias("codes"), "width", first.alias("first"), (first + F.col("size")).alias("last"))


def _solved(tiles: DataFrame) -> DataFrame:
    """``k1, k2, period, low, high``: the fragments of tiles, in words of the document."""
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("k1", "k2", "period", "low", "high")])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                codes = np.frombuffer(r["codes"], f"<u{r['width']}").astype(np.int64)
                found = solve(codes, r["octave"], grams(codes), (r["first"], r["last"]))
                found = np.array(list(found), np.int64).reshape(-1, 3)
                same = lambda v: np.full(len(found), v, np.int64)
                columns = [same(r["k1"]), same(r["k2"]), found[:, 0], found[:, 1] + r["at"], found[:, 2] + r["at"]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=arrow)

    return tiles.mapInArrow(run, schema)


def _stitched(fragments: DataFrame) -> DataFrame:
    """``k1, k2, period, low, high``: fragments that overlap or touch as one."""
    one = ["k1", "k2", "period"]
    before = Window.partitionBy(*one).orderBy("low", "high").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*one).orderBy("low", "high").rowsBetween(Window.unboundedPreceding, 0)
    opens = F.coalesce(F.col("low") > F.max("high").over(before), F.lit(True)).cast("int")
    marked = fragments.withColumn("opens", opens).withColumn("stretch", F.sum("opens").over(upto))
    return marked.groupBy(*one, "stretch").agg(F.min("low").alias("low"), F.max("high").alias("high"))


def find_runs(docs: DataFrame, tile: int = TILE, digest: bool = False) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of every row: the runs ``start, length, period`` in order of
    start and period, and the text without the words that repeat a run's first period (with ``digest``
    its SHA-256, so that texts without runs are not stored on the way).

    Reads ``doc_id`` and ``text`` only. NULL text counts as empty; it has no words, no runs and
    collapses to nothing. Repeated rows and NULL ids are worked on like others; an empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    path = work_dir(docs.sparkSession, "runs-read")
    read = _read(rows, tile, digest)
    # Documents that can have runs lie apart, so that only they are read again for them.
    open_ = (F.size("fragments") > 0) | F.col("codes").isNotNull()
    read.withColumn("open", open_).write.partitionBy("open").parquet(path)
    read = docs.sparkSession.read.schema(T.StructType([*read.schema, T.StructField("open", T.BooleanType())])).parquet(path)
    opened = read.filter("open")
    own = opened.select("k1", "k2", F.explode("fragments").alias("f")).select("k1", "k2", "f.*")
    long = opened.filter("codes IS NOT NULL").groupBy("k1", "k2").agg(F.first("n").alias("n"), F.first("codes").alias("codes"))
    dealt = _tiles(long, tile).repartition("k1", "octave", "at")
    fragments = written(own.union(_solved(dealt)).distinct(), "runs-fragments")
    length = F.col("high") - F.col("low") + F.col("period")
    runs = _stitched(fragments).select("k1", "k2", F.col("low").alias("start"), length.alias("length"), "period")
    runs = runs.filter((F.col("length") >= LEAST) & (F.col("length") >= EXPONENT * F.col("period")))
    listed = runs.groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias("found"))
    told = opened.select("doc_id", "n", "words", "k1", "k2").join(listed, ["k1", "k2"], "left")
    runs_type = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))
    none = F.array().cast(runs_type)
    found = F.transform("found", lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length"), r["period"].alias("period")))
    told = told.select("doc_id", F.col("n").alias("n_words"), F.coalesce(found, none).alias("runs"), "words")
    schema = T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("runs", runs_type),
        T.StructField("collapsed", T.StringType()),
    ])

    def one(batch: pa.RecordBatch) -> dict:
        collapsed = []
        for runs, words in zip(batch.column("runs").to_pylist(), batch.column("words").to_pylist()):
            if runs:
                parts = words.split(" ")
                kept = np.ones(len(parts), bool)
                for r in runs:
                    kept[r["start"] + r["period"]:r["start"] + r["length"]] = False
                words = " ".join([parts[i] for i in np.flatnonzero(kept)])
            collapsed.append(sha256(words.encode("utf-8", "surrogatepass")).hexdigest() if digest else words)
        return {"doc_id": batch.column("doc_id"), "n_words": batch.column("n_words"), "runs": batch.column("runs"), "collapsed": collapsed}

    closed = read.filter("NOT open").select("doc_id", F.col("n").alias("n_words"), none.alias("runs"), F.col("words").alias("collapsed"))
    return closed.union(told.mapInArrow(per_batch(one, schema), schema))


def repeated(text: Column, doc_id: Column) -> Column:
    """The contract's text: in one document of ten, by its id, words from one place on repeat a period."""
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)

    def moved(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return F.array_join(F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, a + (i - a) % p))), " ")

    made = F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, moved(w)).otherwise("")), F.lit(0))
    return F.when(F.coalesce(h % 10 == 0, F.lit(False)), made).otherwise(text)


def digests(found: DataFrame) -> DataFrame:
    """The contract's columns from ``find_runs`` with ``digest``: the strongest run and the digests."""
    def stronger(x: Column, y: Column) -> Column:
        gap = y["length"] * x["period"] - x["length"] * y["period"]
        return F.when(gap != 0, F.signum(gap)).when(x["start"] != y["start"], F.signum(x["start"] - y["start"])).otherwise(
            F.signum(x["period"] - y["period"])).cast("int")

    best = F.get(F.array_sort("runs", stronger), F.lit(0))
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"),
        F.col("best.period").alias("period"), F.expr("1000 * best.length DIV best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.col("collapsed").alias("collapsed_sha256"),
    )
