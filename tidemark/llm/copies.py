"""Near copies by the Jaccard similarity of their five-word shingles, 0.8 or more.

Documents with equal shingle sets are one class. Classes share a bucket whose SimHash fingerprints of the
same shingles are linked by the byte-position index with count filtering (``simhash.links``), directly or
over others. Fingerprints of pairs at 0.8 often differ in more bits than an index can promise to find, so
classes that agree in all rows of one of ``BANDS`` MinHash bands share a bucket as well; a pair at 0.8
meets in one with a probability of 0.9999. In rounds, every
bucket whose members are not yet all in one component names up to ``LEADERS`` members as leaders, those
that share most buckets with others first, and compares each with the members of other components on the
whole shingle sets. A group of near copies is so joined after a few rounds by as many pairs as it has
members, whatever its size. After ``PRUNED`` rounds the shingles are counted that a class has alone among
those still in question. From then on the classes go that can have no near copy, and pairs are left out that
cannot be similar: sets of x and y shingles, u and v of them in no other set, have min(x - u, y - v) in common
at most. These bounds are exact. Leaders are then the classes with the smallest share of shingles of their own,
which are nearest to the middle of their group. What is still apart after ``ROUNDS`` rounds, or once all its pairs
are no more than one more round would compare, is compared with the
sets that hold one of its rare shingles (of ``FEW`` sets at most, so these pairs grow with the shingles), and
with all other members that the same bound leaves when the rare shingles count as not in common.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import simhash
from .common import bounded_batches, per_batch, text_or_empty, written
from .graphs import components

#: Words of a shingle and the similarity from which on two documents are near copies.
WIDTH, SIMILAR = 5, 0.8
BANDS, ROWS = 30, 6
#: Leaders of a bucket in a round, and rounds after which what is still apart is compared pair by pair.
LEADERS, ROUNDS = 4, 8
#: The round before which classes without a possible near copy are left out.
PRUNED = 2
#: A shingle of no more sets than this is rare: pairs that share one are all compared.
FEW = 16
_RNG = np.random.default_rng(23)
FACTORS = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted; a shorter text is one shingle, one without words none."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, "u8")
    grams = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams), "u8"))


def class_of(hashes: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(hashes.tobytes())


#: The class of the texts without words.
WORDLESS = int(np.array([class_of(np.zeros(0, "u8"))], "u8").view("i8")[0])


def bands(hashes: np.ndarray, block: int = 1 << 12) -> np.ndarray:
    """One key per band; none without shingles."""
    if not len(hashes):
        return np.zeros(0, "i8")
    least = np.full(BANDS * ROWS, (1 << 64) - 1, "u8")
    for at in range(0, len(hashes), block):
        least = np.minimum(least, (FACTORS[:, None] * hashes[at:at + block] + OFFSETS[:, None]).min(1))
    return np.array([xxhash.xxh3_64_intdigest(r.tobytes(), n) for n, r in enumerate(least.reshape(BANDS, ROWS))], "u8").view("i8")


def _each(docs: DataFrame, column: str, of, prints: bool = False) -> DataFrame:
    """``doc_id, class`` and a column of longs made from the shingles, with ``prints`` also the fingerprint ``fp``, per row with an id."""
    schema = T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("class", T.LongType()), T.StructField(column, T.ArrayType(T.LongType())),
        *[T.StructField("fp", T.LongType())] * prints,
    ])

    def one(batch: pa.RecordBatch) -> dict:
        texts = batch.column(1).to_pylist()
        sets = [shingles(t) for t in texts]
        classes = np.array([class_of(s) for s in sets], "u8").view("i8")
        fps = np.array([simhash.fingerprint(t, WIDTH) for t in texts] if prints else [], "u8").view("i8")
        return {"doc_id": batch.column(0), "class": classes, column: [of(s) for s in sets], "fp": fps}

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).filter("doc_id IS NOT NULL")
    return rows.mapInArrow(per_batch(one, schema), schema)


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``a, b`` of classes whose sets (``class, hashes``) are similar enough."""
    one, other = (sets.select(F.col("class").alias(n), F.col("hashes").alias(f"h{n}")) for n in "ab")
    common = F.size(F.array_intersect("ha", "hb"))
    return pairs.join(one, "a").join(other, "b").filter(common >= SIMILAR * (F.size("ha") + F.size("hb") - common)).select("a", "b")


def _enough(common: Column, sizes: Column) -> Column:
    """Whether sets of so many shingles together are near copies with so many in common; the margin is for rounding."""
    return common * (1 + SIMILAR) >= SIMILAR * sizes - 1e-6


def _mixed(members: DataFrame) -> DataFrame:
    """The members of the buckets that hold more than one component."""
    several = members.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x < y").select("key")
    return members.join(several, "key")


def _left(members: DataFrame) -> tuple[int, int]:
    """How many members there are, and how many pairs of one bucket and two components at most."""
    held = members.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.sum("n").alias("n"), F.max("n").alias("most"))
    apart = F.col("n").cast("double") * (F.col("n") - F.col("most"))
    return held.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(apart), F.lit(0.0))).first()


def _rare(members: DataFrame, sets: DataFrame, few: int) -> DataFrame:
    """``class, hash, n`` of the members' shingles that ``n``, at most ``few``, of the members' sets hold."""
    needed = sets.join(members.select("class").distinct(), "class", "left_semi")
    each = written(needed.select("class", F.explode("hashes").alias("hash")), "copies-shingles")
    counts = each.groupBy("hash").agg(F.count("*").alias("n")).filter(F.col("n") <= few)
    return written(each.join(counts, "hash").select("class", "hash", "n"), "copies-rare")


def _possible(members: DataFrame, rare: DataFrame) -> DataFrame:
    """The members that can be similar enough to another one. ``own`` becomes the count of their rare shingles. Members
    of one bucket are all here, and no partner is smaller than the smallest of them, so no pair is lost."""
    counts = rare.groupBy("class").agg(F.count_if(F.col("n") == 1).alias("alone"), F.count("*").alias("rare"))
    least = members.groupBy("key").agg(F.min("size").alias("least"))
    counted = members.join(counts, "class", "left").join(least, "key")
    alone, partner = F.coalesce("alone", F.lit(0)), F.greatest("least", SIMILAR * F.col("size"))
    own = F.coalesce("rare", F.lit(0))
    rank = F.struct((-own / F.col("size")).alias("near"), F.col("rank.shared").alias("shared"), "class").alias("rank")
    return counted.filter(_enough(F.col("size") - alone, F.col("size") + partner)).select(
        "key", "class", "root", "size", own.alias("own"), rank, "led")


def _sharing(leads: DataFrame, members: DataFrame, rare: DataFrame) -> DataFrame:
    """The pairs of a leader and a member of another component that hold a rare shingle in common."""
    roots = members.select("class", "root").distinct()
    held = rare.filter("n > 1").join(roots, "class").select("hash", "class", "root")
    ahead = leads.select(F.col("leader").alias("class")).distinct().join(held, "class")
    ahead = ahead.select("hash", F.col("class").alias("leader"), F.col("root").alias("lead_root"))
    return held.join(ahead, "hash").filter("root <> lead_root").select("class", "leader", "root", "lead_root").distinct()


def _merged(members: DataFrame, links: DataFrame) -> DataFrame:
    """The members with the components that links between components make."""
    found = components(links, "copies-stars").select(F.col("node").alias("root"), F.col("root").alias("to"))
    return members.join(found, "root", "left").select("key", "class", F.coalesce("to", "root").alias("root"), "size", "own", "rank", "led")


def joined(buckets: DataFrame, sets: DataFrame) -> DataFrame:
    """``node, root`` of the classes that are near copies of others; ``buckets`` has ``key, class``."""
    sizes = buckets.groupBy("key").agg(F.count("*").alias("n"))
    shared = buckets.join(sizes, "key").groupBy("class").agg(F.sum("n").alias("shared"))
    rank = F.struct(F.lit(0.0).alias("near"), "shared", "class").alias("rank")
    members = buckets.join(shared, "class").join(sets.select("class", F.col("size").cast("long").alias("size")), "class").select(
        "key", "class", F.col("class").alias("root"), "size", F.lit(0).cast("long").alias("own"), rank, F.lit(False).alias("led"))
    members, links = written(members, "copies-members"), None
    for n in range(ROUNDS + 1):
        members = written(_mixed(members), "copies-mixed")
        count, pairs = _left(members)
        if not count:
            break
        last = n == ROUNDS or n >= PRUNED and pairs <= LEADERS * count
        if last or n == PRUNED:
            rare = _rare(members, sets, FEW if last else 1)
            members = written(_mixed(_possible(members, rare)), "copies-mixed")
            if members.isEmpty():
                break
        if not last:
            slot = F.pmod(F.xxhash64("class"), F.lit(LEADERS))
            leads = members.filter("NOT led").groupBy("key", slot.alias("slot")).agg(F.max("rank").alias("rank"))
            leads = leads.select("key", F.col("rank.class").alias("leader"))
        else:
            most = members.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("most"))
            leads = members.join(most, "key").filter("root <> most AND NOT led").select("key", F.col("class").alias("leader"))
        heads = members.select("key", F.col("class").alias("leader"), F.col("root").alias("lead_root"),
                               F.col("size").alias("lead_size"), F.col("own").alias("lead_own"))
        heads = written(leads.join(heads, ["key", "leader"]), "copies-leaders")
        common = F.least(F.col("size") - F.col("own"), F.col("lead_size") - F.col("lead_own"))
        pairs = members.join(heads, "key").filter((F.col("root") != F.col("lead_root")) & _enough(common, F.col("size") + F.col("lead_size")))
        pairs = pairs.select("class", "leader", "root", "lead_root")
        if last:
            pairs = pairs.union(_sharing(leads, members, rare))
        pairs = pairs.select(
            F.least("class", "leader").alias("a"), F.greatest("class", "leader").alias("b"),
            F.least("root", "lead_root").alias("ra"), F.greatest("root", "lead_root").alias("rb")).distinct()
        found = similar(pairs.select("a", "b"), sets).join(pairs, ["a", "b"]).select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        found = written(found.distinct(), "copies-linked")
        links = found if links is None else links.union(found)
        if last:
            break
        led = heads.select("key", F.col("leader").alias("class"), F.lit(True).alias("_led"))
        members = members.join(led, ["key", "class"], "left").withColumn("led", F.col("led") | F.col("_led").isNotNull()).drop("_led")
        members = _merged(members, found)
    return components(links, "copies-all") if links is not None else buckets.select(F.col("class").alias("node"), F.col("class").alias("root")).limit(0)


def fingerprint_buckets(marked: DataFrame) -> DataFrame:
    """``key, class``: a bucket for the fingerprints that links hold together. Texts without words are in none."""
    prints = marked.filter(F.col("class") != F.lit(WORDLESS)).select("class", "fp").distinct()
    linked = components(written(simhash.links(prints.select("fp").distinct()), "copies-prints"), "copies-print-stars")
    roots = prints.join(linked.withColumnRenamed("node", "fp"), "fp", "left")
    return roots.select(F.xxhash64(F.lit("fp"), F.coalesce("root", "fp")).alias("key"), "class").distinct()


def near_copies(docs: DataFrame) -> DataFrame:
    """``doc_id, component_id`` of the documents with an id: the smallest id of the near copies around it.

    Reads ``doc_id`` and ``text`` only. NULL text counts as empty; texts without words are copies of
    each other; an empty table gives no rows.
    """
    marked = written(_each(docs, "bands", bands, True), "copies-docs")
    classes = written(marked.groupBy("class").agg(F.min("doc_id").alias("first_id"), F.first("bands").alias("bands")), "copies-classes")
    keys = classes.select(F.explode("bands").alias("key"), "class").union(fingerprint_buckets(marked)).select("class", "key")
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    buckets = written(keys.join(shared.select("key"), "key"), "copies-buckets")
    needed = buckets.select("class").distinct()
    # Sets are made anew for the classes that have a candidate; of rows that share an id, those of the class.
    firsts = classes.join(needed, "class", "left_semi").select("first_id").distinct()
    texts = docs.join(firsts, docs["doc_id"].cast("long") == firsts["first_id"], "left_semi")
    sets = written(_each(texts, "hashes", lambda s: s.view("i8")).dropDuplicates(["class"]).select("class", F.size("hashes").alias("size"), "hashes"), "copies-sets")
    roots = joined(buckets, sets)
    rooted = classes.join(roots.withColumnRenamed("node", "class"), "class", "left").select("class", "first_id", F.coalesce("root", "class").alias("root"))
    rooted = written(rooted, "copies-roots")
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return marked.select("doc_id", "class").join(rooted.join(least, "root").select("class", "component_id"), "class").select("doc_id", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents with one of each group of near copies: that with the group's smallest id.

    Of repeated rows with that id one stays; rows without an id have nothing to be kept or dropped
    by and all stay.
    """
    chosen = written(near_copies(docs).filter("doc_id = component_id").select("doc_id").distinct(), "copies-chosen")
    with_id = docs.filter("doc_id IS NOT NULL").join(chosen, docs["doc_id"] == chosen["doc_id"], "left_semi")
    return with_id.dropDuplicates(["doc_id"]).select(*docs.columns).union(docs.filter("doc_id IS NULL"))
