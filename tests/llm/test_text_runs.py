"""Line dedup and periodic runs beside plain loops."""

import collections
import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import lines, periodic

SCHEMA = "doc_id long, text string, n long, words string, runs string, batch int, keeper string, h1 string, mark string, gone string"
CLASH = (1, "w", "r", 2, "k", "h", "m", "g")
LINE = "A line that is surely longer than forty characters, {}"


def rows_of(spark, texts):
    """Texts by id, with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, *CLASH) for i, t in texts], SCHEMA)


def plain_lines(texts, least_chars, least_docs):
    """What stays of each row, every row a document."""
    blank = " \t\n\x0b\x0c\r"
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = [[(line, line.strip(blank).translate(lower)) for line in (t or "").split("\n")] for _, t in texts]
    holders = collections.defaultdict(list)
    for (i, _), own in zip(texts, split):
        for key in {k for _, k in own if len(k) >= least_chars}:
            holders[key].append(i)
    keeper = {k: max((i for i in ids if i is not None), default=None) for k, ids in holders.items() if len(ids) >= least_docs}
    out = []
    for (i, _), own in zip(texts, split):
        stay = [line for line, k in own if k not in keeper or keeper[k] == i]
        out.append((i, len(own), len(own) - len(stay), "\n".join(stay)))
    return out


@pytest.fixture(scope="module")
def line_texts():
    rng = np.random.default_rng(11)
    pool = [LINE.format(n) for n in range(60)] + ["short", "", "é" * 39, "é" * 40, "Ünï " + LINE.format("x")]
    texts = [(int(n), "\n".join(rng.choice(pool, rng.integers(1, 9)))) for n in rng.permutation(150)]
    texts += [(n, "  \t" + LINE.format("seen everywhere").upper() + "\r\nown " + str(n)) for n in range(200, 300)]
    texts += [(300, None), (301, ""), (302, "\n\n"), (303, LINE.format(1) + "\n" + LINE.format(1)), (303, LINE.format(1) + "\n" + LINE.format(1))]
    return texts + [(None, LINE.format(2)), (None, LINE.format(3)), (304, (LINE.format("long") + "\n") * 3000)]


@pytest.mark.parametrize(("batches", "fanout"), [(8, 4), (1, 2), (7, 2)])
def test_line_dedup_equals_plain_loops(spark, line_texts, batches, fanout):
    found = lines.drop_repeated_lines(rows_of(spark, line_texts), batches=batches, fanout=fanout)
    assert found.columns == ["doc_id", "n_lines", "n_dropped", "kept"]
    want = plain_lines(line_texts, 40, 5)
    assert sum(d for _, _, d, _ in want) > 100
    assert collections.Counter(map(tuple, found.collect())) == collections.Counter(want)


def test_line_dedup_counts_documents_not_lines(spark):
    texts = [(1, "\n".join([LINE.format(0)] * 9)), (2, LINE.format(0)), (3, LINE.format(0)), (4, LINE.format(0))]
    found = lines.drop_repeated_lines(rows_of(spark, texts)).collect()
    assert all(r.n_dropped == 0 for r in found)
    found = {r.doc_id: r for r in lines.drop_repeated_lines(rows_of(spark, [*texts, (0, LINE.format(0))])).collect()}
    assert [found[n].n_dropped for n in range(5)] == [1, 9, 1, 1, 0]


def test_line_dedup_of_nothing(spark):
    assert lines.drop_repeated_lines(rows_of(spark, [])).count() == 0
    assert [tuple(r) for r in lines.drop_repeated_lines(rows_of(spark, [(None, None)])).collect()] == [(None, 1, 0, "")]


def test_runs_are_merged_without_a_shuffle(spark):
    """Runs are leftovers of earlier batches, compacted by level, and merging them moves no row."""
    runs = lines.Runs(spark, fanout=2)
    try:
        for n in range(5):
            runs.add(spark.range(20).select(
                F.col("id").alias("h1"), (F.col("id") * 3).alias("h2"), F.lit(1).cast("long").alias("n"), F.lit(9 - n).cast("long").alias("keeper")))
        assert [len(level) for level in runs.levels] == [1, 0, 1]
        merged = runs.merged(runs.live)
        assert "Exchange" not in merged._jdf.queryExecution().executedPlan().toString()
        assert {tuple(r) for r in merged.collect()} == {(n, 3 * n, 5, 9) for n in range(20)}
        own = spark.range(30).select(F.col("id").alias("h1"), (F.col("id") * 3).alias("h2"))
        assert sorted(r.h1 for r in runs.unsettled(own, 5).collect()) == list(range(20, 30))
    finally:
        runs.drop()


def plain_runs(words):
    n, out = len(words), []
    for p in range(1, n // 3 + 1):
        i = 0
        while i < n - p:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j < n - p and words[j] == words[j + p]:
                j += 1
            size = j - i + p
            if size >= max(24, 3 * p) and not any(p % q == 0 and words[i:i + size - q] == words[i + q:i + size] for q in range(1, p)):
                out.append((i, size, p))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for start, size, p in runs for i in range(start + p, start + size)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


@pytest.fixture(scope="module")
def periodic_texts():
    rng = np.random.default_rng(5)
    texts = [None, "", " \t\n ", "one", "a " * 23, "a " * 24, "a " * 25 + "b " * 30, "x\x0by\x0c" * 40, "\x1c " * 30, "\xa0 b " * 20]
    for n in range(60):
        words = rng.choice(list("abcdefgh"), rng.integers(1, 200)).tolist()
        for _ in range(rng.integers(0, 4)):
            block = rng.choice(list("abc") + [f"w{k}" for k in range(30)], rng.integers(1, 60)).tolist()
            at, times = rng.integers(0, len(words) + 1), rng.integers(2, 9)
            words[at:at] = (block * times)[:int(len(block) * times - rng.integers(0, len(block)))]
        texts.append(" ".join(words))
    texts += ["ab cd " * 700, "a " * 1500, " ".join(f"w{n % 433}" for n in range(1500)), "z " + "a b a " * 300 + "y", " ".join(["p"] * 50 + ["q"] * 2) + " " + " ".join(["p"] * 50 + ["q"] * 2) * 6]
    return [(n, t) for n, t in enumerate(texts)] + [(None, "k " * 40), (7, "x\x0by\x0c" * 40)]


@pytest.mark.parametrize("tile", [periodic.TILE, 100, 32])
def test_runs_equal_plain_loops(spark, periodic_texts, tile):
    found = periodic.find_runs(rows_of(spark, periodic_texts), tile=tile).collect()
    want = collections.Counter()
    for i, t in periodic_texts:
        words = (t or "").encode().split()
        words = [w.decode() for w in words]
        runs = plain_runs(words)
        want[i, len(words), tuple(runs), collapsed(words, runs)] += 1
    assert sum(len(k[2]) for k in want) > 40
    assert collections.Counter((r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in found) == want


def test_runs_of_nothing(spark):
    assert periodic.find_runs(rows_of(spark, [])).count() == 0


def test_contract_columns_of_runs(spark, periodic_texts):
    texts = [t for n, (_, t) in enumerate(periodic_texts) if n % 3 == 0] * 4
    docs = rows_of(spark, enumerate(texts))
    docs = docs.select("doc_id", periodic.repeated(F.col("text"), F.col("doc_id")).alias("text"))
    found = {r.doc_id: r for r in periodic.digests(periodic.find_runs(docs, digest=True)).collect()}
    moved = 0
    for i, t in enumerate(texts):
        words = [w.decode() for w in (t or "").encode().split()]
        h, n = zlib.crc32(str(i).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words, moved = words[:a] + [words[a + (k - a) % p] for k in range(a, n)], moved + 1
        runs = plain_runs(words)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
        milli = 1000 * best[1] // best[2] if runs else None
        want = (len(runs), *best, milli, sha("".join(f"{a},{s},{p}\n" for a, s, p in runs)), sha(collapsed(words, runs)))
        assert tuple(found[i])[1:] == want
    assert moved > 3
