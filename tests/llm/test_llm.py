"""The training-data operators beside the libraries, plain loops and exact round trips."""

import collections
import hashlib
import math
import operator
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import ann, bpe, copies, graphs, licenses, lmscore, packing, quality, rangecoder, sharding, simhash, tokenio, tokens, toxicity

SF = "/root/testdata/sf0.001"
BYTES, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
ODD = [
    None, "", " ", "  a", "a  b", "x \n y", "\n\n", "don't 'll <|endoftext|> x<|endoftext|>y", "a" * 1000, "ab" * 300 + " cd",
    "日本語 テスト é é  x", "\x1ca \x1c b", "😀 x😀y 123abc", "tab\tx", "end ", " start", "a\r\n b", "same", "same", "ΑΣ İI", "long words " * 9000,
]
SCHEMA = "doc_id long, text string, lang string, score string, kept string, fp string, number string, slot string, length string"


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, a repeated row, a NULL id, and columns whose names the operators use inside."""
    rows = [(n, t, None, "s", "k", "f", "n", "l", "x") for n, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[3], (None, "no id", "en", *"abcdef")], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def library(path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return tokenizer, lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids


def ids_crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_pieces_give_the_library_ids(path):
    texts = [t or "" for t in ODD]
    ids, ends = tokens.PieceIds(path).encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [library(path)[1](t) for t in texts]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_pieces_of_any_letters_and_blanks_give_the_library_ids(path):
    """Marks, added tokens, combining letters and blanks in any order, encoded anew and from memory."""
    rng = np.random.default_rng(4)
    parts = ["a", "B", "'s", "'", "|", ".", ",", " ", "  ", "\n", "\t", "<|endoftext|>", "<", "é", "\u0301", "J\u030c", "7", "!", "\u0120", " |a", "="]
    texts = ["".join(rng.choice(parts, rng.integers(0, 14))) for _ in range(4000)]
    encoder, tokenizer = tokens.PieceIds(path), library(path)[0]
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    for _ in range(2):
        ids, ends = encoder.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == want
    ids, ends = encoder.encode(pa.array([], pa.string()))
    assert not len(ids) and ends.tolist() == [0]


def test_packing_places_every_token(spark, odd, documents):
    docs = documents.select("doc_id", "text").union(odd.select(F.col("doc_id") + 1000, "text"))
    rows = packing.pack_documents(docs, WORDS, capacity=512).collect()
    want = collections.Counter()
    for d in docs.collect():
        ids = library(WORDS)[1](d.text) + [1]
        for n, at in enumerate(range(0, len(ids), 512)):
            want[d.doc_id, n, at, len(ids[at:at + 512]), ids_crc(ids[at:at + 512])] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        ends = [0, *np.cumsum([n for _, n in sorted(places)])]
        assert [o for o, _ in sorted(places)] == ends[:-1] and ends[-1] <= 512
    assert len(sequences) <= 1.02 * math.ceil(sum(r.length for r in rows) / 512) + 1


def test_configuration_program_covers_the_histogram():
    rng = np.random.default_rng(3)
    for histogram in ({}, {64: 5}, {40: 3}, dict(collections.Counter(rng.integers(1, 65, 5000).tolist()))):
        plan, held = packing.solve(histogram, 64, rounds=32), collections.Counter()
        for pattern, times in plan:
            assert sum(s * n for s, n in pattern) <= 64
            for size, n in pattern:
                held[size] += n * times
        assert dict(held) == histogram
    least = math.ceil(sum(s * n for s, n in histogram.items()) / 64)
    assert sum(t for _, t in plan) <= 1.01 * least + 1


def test_program_places_nearly_all_tokens_of_rare_lengths():
    """As many lengths as pieces have, most of them once or twice: the rounds and not best fit place them."""
    rng = np.random.default_rng(7)
    histogram = dict(collections.Counter(np.clip(rng.lognormal(5, 1, 3000), 1, 1024).astype(int).tolist()))
    full, bins, rest = packing.program(histogram, 1024)
    inside = sum(s * n for s, n in histogram.items() if s < 1024)
    assert sum(s * n for s, n in rest.items()) <= 0.1 * inside
    used = sum(t for _, t in full + packing.best_fit(rest, bins, 1024))
    assert used <= 1.005 * math.ceil(sum(s * n for s, n in histogram.items()) / 1024) + 1


def test_knapsack_is_exact():
    rng = np.random.default_rng(5)
    for _ in range(20):
        sizes = np.array(sorted(rng.choice(np.arange(2, 20), 4, replace=False)))
        values = rng.random(4)
        best = [0.0] * 31
        for c in range(1, 31):
            best[c] = max([best[c - 1]] + [best[c - s] + v for s, v in zip(sizes, values) if s <= c])
        found = packing.priced(packing.prices(sizes, values, 30), sizes, 30)
        assert sum(sizes[k] * n for k, n in found.items()) <= 30
        assert sum(values[k] * n for k, n in found.items()) == pytest.approx(best[30])


def test_grammar_scores_clauses():
    grammar = toxicity.Grammar({"idiot": 5.0}, {"scum": 5.0})
    kinds = {t: next(iter(grammar.clauses(t)), None) for t in (
        "you idiot", "an idiot", "you are not an idiot", "he said you are an idiot", "scumbags everywhere", "fine. idiots", "I kill you", "unidiot")}
    weigh = {t: grammar.weights[k] if k is not None else 0.0 for t, k in kinds.items()}
    assert weigh["you idiot"] > weigh["an idiot"] > weigh["you are not an idiot"] > 0
    assert weigh["he said you are an idiot"] < weigh["you idiot"] < weigh["I kill you"]
    assert kinds["scumbags everywhere"] == kinds["an idiot"] and kinds["fine. idiots"] is None and kinds["unidiot"] is None
    assert sum(grammar.clauses("idiot! idiot? you idiot\nnot here").values()) == 3
    assert sum(grammar.clauses("word " * 30000 + "idiot " + "word " * 30000).values()) == 1


def test_toxicity_learns_from_labels_that_are_not_held_out(spark, odd, empty):
    rng = np.random.default_rng(7)
    plain = [f"w{n}" for n in range(300)]
    rows = []
    for n in range(1500):
        words = rng.choice(plain, 40).tolist()
        if n % 5 == 0:
            words[7:7] = [["zorg", "blefast", "blefin"][n % 3]]
        rows.append((n, " ".join(words) + ".", int(n % 5 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    found = {r.doc_id: r for r in toxicity.toxicity(docs, docs.select("doc_id", "toxic")).collect()}
    for n, _, toxic in rows:
        assert found[n].predicted == toxic and found[n].held_out == (zlib.crc32(str(n).encode()) % 5 == 0)
    flipped = docs.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r.score for r in toxicity.toxicity(docs, flipped.select("doc_id", "toxic")).collect()}
    assert again == {n: r.score for n, r in found.items()}
    kept = toxicity.drop_toxic(odd, docs.select("doc_id", "toxic").limit(0))
    assert kept.columns == odd.columns and kept.count() == odd.count()
    assert toxicity.toxicity(empty, docs.select("doc_id", "toxic")).count() == 0


def plain_quality(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    inside = {k + d for k, g in enumerate(zip(words, words[1:], words[2:])) if windows[g] > 1 for d in range(3)}
    lines = [s for s in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", s)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)),
            len(inside), len(words) < 50 or 100 * len(inside) > 50 * len(words))


def test_quality_counts_and_keeps(spark, odd, empty, documents):
    rows = documents.select("doc_id", "text", "lang").union(odd.select(F.col("doc_id") + 1000, "text", "lang"))
    found = quality.quality(rows).collect()
    texts = {r.doc_id: r.text for r in rows.collect()}
    for r in found:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_quality(texts[r.doc_id])
        assert not (r.kept and r.base_failed)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    judged = [(labels[r.doc_id], r.kept) for r in found if r.doc_id in labels and not r.base_failed]
    assert all(kept == bool(good) for good, kept in judged)
    kept = quality.keep_good(rows.union(odd.select("doc_id", "text", "lang").filter("doc_id = 1")))
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted(r.doc_id or -1 for r in found if r.kept)
    assert quality.quality(empty).count() == 0 and quality.keep_good(empty).columns == empty.columns


def test_divergence_is_jensen_shannon(spark):
    p, q = [3.0, 1.0, 0.0], [1.0, 1.0, 2.0]
    row = spark.createDataFrame([(p, q)], "p array<double>, q array<double>").select(quality.divergence(F.col("p"), F.col("q")).alias("d")).first()
    a, b = np.array(p) / 4, np.array(q) / 4
    m = (a + b) / 2
    want = sum(0.5 * x * math.log2(x / y) for v in (a, b) for x, y in zip(v, m) if x > 0)
    assert row.d == pytest.approx(want)


def test_license_families_are_found_and_confirmed(spark, odd, empty):
    rows, want = [], {}
    for family, texts in sorted(licenses.TEMPLATES.items()):
        for t in texts:
            want[len(rows)] = family
            rows.append((len(rows), f"first line\n{t}\nlast line"))
    rows += [(900, "we had permission to walk there"), (901, "no such terms here"), (902, "his driving license was old and brown")]
    found = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.family for r in found if r.confirmed} == want
    assert {r.paragraph for r in found if r.confirmed} == {1}
    assert licenses.scan(odd).count() == 0 and licenses.scan(empty).count() == 0


def plain_fingerprint(text):
    import xxhash

    words = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, near=2):
    root = list(range(len(prints)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    apart = np.bitwise_count(np.array(prints, "u8")[:, None] ^ np.array(prints, "u8")[None])
    for i, j in zip(*np.nonzero(apart <= near)):
        root[max(top(i), top(j))] = min(top(i), top(j))
    return [top(i) for i in range(len(prints))]


def test_near_copies_equal_all_pairs(spark, odd, empty, documents):
    docs = documents.select("doc_id", "text").union(odd.filter("doc_id IS NOT NULL").select(F.col("doc_id") + 1000, "text"))
    rows = docs.collect()
    prints = [plain_fingerprint(r.text) for r in rows]
    names = collections.defaultdict(list)
    for r, c in zip(rows, plain_components(prints)):
        names[c].append(r.doc_id)
    want = {i: min(ids) for ids in names.values() for i in ids}
    found = simhash.near_copies(docs).collect()
    assert len(found) == len(rows) and {r.doc_id: r.component_id for r in found} == want
    assert {r.doc_id: r.fingerprint for r in found} == {r.doc_id: f"{p:016x}" for r, p in zip(rows, prints)}
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and kept.filter("doc_id IS NULL").count() == 1
    assert simhash.near_copies(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def test_links_equal_all_pairs_also_in_large_lists(spark):
    rng = np.random.default_rng(11)
    base = int(rng.integers(0, 1 << 62))
    prints = {base ^ int(x) for x in rng.integers(0, 1 << 16, 400)} | {base ^ (int(x) << 30) for x in rng.integers(0, 1 << 12, 100)}
    prints |= {int(x) for x in rng.integers(0, 1 << 62, 50)}
    frame = spark.createDataFrame([(p,) for p in prints], "fp long")
    found = collections.Counter((r.a, r.b) for r in simhash.links(frame).collect())
    want = {(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 2}
    assert set(found) == want and max(found.values()) == 1


def test_shards_move_into_the_new_one_only(spark, odd, empty):
    ids = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("text").alias("text"))
    tree = sharding.even_tree(16)
    rows = sharding.shards(ids.union(odd.select("doc_id", "text")), tree, sharding.with_shard(tree, 16)).collect()
    assert all(r.grown_shard in (r.shard, 16) for r in rows)
    assert 0.04 < sum(r.grown_shard == 16 for r in rows) / len(rows) < 0.08
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert sorted(slots) == list(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) < 1.15 * len(rows) / 16
    null = next(r for r in sharding.shards(odd, tree).collect() if r.doc_id == 0)
    assert (null.size, null.text_crc32, null.grown_shard) == (1, 0, None)
    assert sharding.shards(empty, tree).count() == 0


def test_changed_weight_moves_nothing_between_other_subtrees(spark):
    tree = sharding.even_tree(8)
    heavy = [sharding.Leaf(x.region, x.rack, x.shard, 3.0 if x.shard == 7 else 1.0) for x in tree]
    rows = spark.range(5000).select(sharding.shard_of(F.col("id"), tree).alias("a"), sharding.shard_of(F.col("id"), heavy).alias("b")).collect()
    moved = [(r.a, r.b) for r in rows if r.a != r.b]
    assert moved and all(b // 4 == 7 // 4 for _, b in moved) and all(b // 2 == 7 // 2 for a, b in moved if a // 4 == 7 // 4)


def test_bpe_equals_the_library(spark, odd, empty):
    tokenizer, encode = library(BYTES)
    want = collections.Counter()
    for r in odd.collect():
        ids = encode(r.text)
        text = tokenizer.decode(ids, skip_special_tokens=False)
        want[r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
    assert collections.Counter(tuple(r) for r in bpe.encode_decode(odd, BYTES).collect()) == want
    assert bpe.encode_decode(empty, BYTES).count() == 0


def test_heap_merges_as_the_rank_array():
    vocabulary, rng = bpe.Bpe(BYTES), np.random.default_rng(13)
    for _ in range(200):
        word = bytes(rng.choice(list(b"thenadiougs "), int(rng.integers(1, 60))).astype(np.uint8))
        assert vocabulary.merge_short(word) == vocabulary.merge_long(word)


def test_words_of_equally_many_bytes_are_merged_together(monkeypatch):
    """A batch's new words are not merged one by one, and end as the heap ends them, added tokens between them."""
    vocabulary, rng, alone = bpe.Bpe(BYTES), np.random.default_rng(14), []
    one = vocabulary.merge_short
    monkeypatch.setattr(vocabulary, "merge_short", lambda word: alone.append(word) or one(word))
    words = ["".join(rng.choice(list("thenadiougs é"), int(rng.integers(0, 25)))) for _ in range(3000)] + ["x" * 300, "日本" * 200, ""]
    ids, sizes = vocabulary.merge(pa.array(words)[5:])
    ends = np.cumsum(sizes)
    assert [ids[e - n:e].tolist() for e, n in zip(ends, sizes)] == [vocabulary.merge_long(w.encode()) for w in words[5:]]
    assert len(alone) < 300
    encode, texts = library(BYTES)[1], [" ".join(words), "<|endoftext|>", "a <|endoftext|>b  c", ""]
    for _ in range(2):
        for text, (n, listed, raw) in zip(texts, vocabulary.forms(pa.array(texts))):
            assert bytes(listed) == b"".join(b",%d" % i for i in encode(text)) and (n, bytes(raw)) == (len(encode(text)), text.encode())
    assert list(vocabulary.forms(pa.array([], pa.string()))) == []


def test_range_coder_round_trip():
    rng = np.random.default_rng(17)
    blocks = [rng.integers(0, 50257, n) for n in (0, 1, 7, 4096)] + [np.zeros(4096, int), np.full(300, 50256), np.arange(4000) % 7]
    codes = rangecoder.encode(blocks)
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(blocks, rangecoder.decode(codes, [len(b) for b in blocks])))
    assert rangecoder.encode(blocks[3:5])[1] == codes[4] and len(codes[4]) < 200
    assert rangecoder.encode([]) == [] and rangecoder.decode([], []) == []


def test_both_orders_are_stepped_together_as_a_plain_loop_does():
    rng, sizes = np.random.default_rng(41), np.array([300, 300, 120, 7])
    ids = np.zeros((302, 4), np.int32)
    for lane, size in enumerate(sizes):
        ids[2:size + 2, lane] = rng.choice([1, 2, 3, 70_000, 200_000], size, p=[0.5, 0.3, 0.1, 0.05, 0.05])
    live = (np.arange(300)[:, None] < sizes).sum(1)
    found = rangecoder.predicted(ids, live)
    for lane, size in enumerate(sizes):
        kept = {}
        for t in range(size):
            before, last, x = (int(ids[t + k, lane]) for k in range(3))
            keys = (0, (last * 40503 >> 3) % rangecoder.ORDER1), (1, (before * 30011 + last * 40503 >> 5) % rangecoder.ORDER2)
            for key, entries in zip(keys, found):
                said, sure = kept.get(key, (0, 0))
                assert entries[t, lane] == said << 2 | sure
                kept[key] = (said, min(sure + 1, 3)) if said == x else (said, sure - 1) if sure else (x, 1)
    for size in (1, 126, 129, 4100):  # whole blocks that end beside the positions worked out together
        block = np.arange(size) % 50
        assert (rangecoder.decode(rangecoder.encode([block]), [size])[0] == block).all()
    tables = rangecoder.Tables(2)
    at = tables.places(np.array([5, 6], np.int32), np.array([0, 9], np.int32))
    assert at.shape == (2, 2) and len(np.unique(at)) == 4


def test_mixed_ids_take_fewer_bits_than_order_0_and_a_general_compressor(documents):
    texts = pa.array([r.text or "" for r in documents.select("text").collect()])
    ids = tokens.piece_ids(BYTES).encode(texts)[0][:48 * rangecoder.BLOCK]
    blocks = np.split(ids, range(rangecoder.BLOCK, len(ids), rangecoder.BLOCK))
    ((model,), (codes,)) = rangecoder.encode_groups([blocks])
    share = np.bincount(ids)[np.unique(ids)] / len(ids)
    assert 8 * (len(model.packed()) + sum(map(len, codes))) < -(share * np.log2(share)).sum() * len(ids)
    assert len(model.packed()) + sum(map(len, codes)) < sum(len(zlib.compress(b.astype("<u2").tobytes())) for b in blocks)
    model, _ = rangecoder.Model.unpacked(model.packed())
    (found,) = rangecoder.decode_groups([(model, codes[7:8], [rangecoder.BLOCK])])
    assert (found[0] == blocks[7]).all()


def test_ids_of_large_vocabularies_are_coded_or_refused():
    rng = np.random.default_rng(18)
    blocks = [rng.permutation(rangecoder.IDS), np.array([rangecoder.IDS - 1, 0, 70_000] * 50), np.zeros(0, np.int64)]
    assert all((a == b).all() for a, b in zip(blocks, rangecoder.decode(rangecoder.encode(blocks), [len(b) for b in blocks])))
    for wrong in (rangecoder.IDS, -1):
        with pytest.raises(ValueError):
            rangecoder.encode([np.array([wrong])])


def test_token_files_round_trip(spark, odd, empty, documents):
    docs = documents.select("doc_id", "text").union(odd.filter("doc_id IS NOT NULL").select(F.col("doc_id") + 1000, "text").distinct())
    found = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in tokenio.round_trip(docs, BYTES).collect()}
    at, encode = 0, library(BYTES)[1]
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        ids = encode(r.text) + [0]
        assert found.pop(r.doc_id) == (at, len(ids), ids_crc(ids))
        at += len(ids)
    assert not found and tokenio.round_trip(empty, BYTES).count() == 0
    assert tokenio.round_trip(odd, BYTES).count() == odd.count()


def test_damaged_segments_are_refused():
    groups = [[(None, np.array([5, 0])), (3, np.arange(9000) % 50)]]
    (segment,) = tokenio.pack_segments(groups)
    ((first, second),) = tokenio.unpack_segments([segment])
    assert first[0] is None and second[0] == 3 and (second[1] == groups[0][1][1]).all()
    for at in (2, 20, len(segment) - 1):
        broken = bytearray(segment)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            tokenio.unpack_segments([bytes(broken)])


def test_neighbours_beside_brute_force(spark):
    rng = np.random.default_rng(19)
    centres = rng.standard_normal((5, 12))
    vectors = np.vstack([centres[rng.integers(0, 5, 500)] + 0.1 * rng.standard_normal((500, 12)), rng.standard_normal((300, 12)), np.tile(centres[:1], (60, 1))]).astype(np.float32)
    rows = [(n, v.tolist(), "x", "y") for n, v in enumerate(vectors)]
    bad = [(900, None), (920, [0.0] * 12), (940, [float("nan")] * 12), (960, [1.0] * 3), (980, []), (None, [1.0] * 12), (901, [None] * 12)]
    frame = spark.createDataFrame([*rows, rows[0], *[(i, v, "x", "y") for i, v in bad]], "vec_id long, embedding array<float>, point string, score string")
    found = collections.defaultdict(list)
    for r in ann.search(frame).collect():
        found[r.query_id].append((r.rank, r.vec_id, r.score))
    exact, hits = vectors.astype(np.float64), 0
    assert sorted(found) == list(range(0, len(vectors), 20))
    for q, answer in found.items():
        scores = exact @ exact[q]
        scores[q] = -np.inf
        want = np.lexsort((np.arange(len(scores)), -scores))[:20]
        answer.sort()
        assert [r for r, _, _ in answer] == list(range(1, 21))
        assert all(s == pytest.approx(float(scores[v]), rel=1e-12) for _, v, s in answer)
        assert [(-s, v) for _, v, s in answer] == sorted((-s, v) for _, v, s in answer)
        hits += len({v for _, v, _ in answer} & set(want.tolist()))
    assert hits >= 0.95 * 20 * len(found)
    assert ann.search(frame.limit(0)).count() == 0
    few = ann.search(frame.filter("vec_id < 3")).collect()
    assert [(r.query_id, r.rank) for r in few] == [(0, 1), (0, 2)]


def test_hilbert_curve_visits_neighbours():
    grid = np.array([[x, y, z] for x in range(8) for y in range(8) for z in range(8)])
    keys = ann.hilbert(grid, 3)
    walk = grid[np.argsort(keys)]
    assert sorted(keys) == list(range(512)) and (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def plain_near_copies(texts):
    """The component of each text by all pairs of five-word shingle sets."""
    def shingles(text):
        words = (text or "").encode().lower().split()
        return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    for i, j in ((i, j) for i in range(len(sets)) for j in range(i)):
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            old, new = max(root[i], root[j]), min(root[i], root[j])
            root = [new if r == old else r for r in root]
    return root


def test_pipeline_equals_its_stages_by_plain_loops(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    grammar = toxicity.fit(documents, labels)
    rows = [r for r in documents.collect() if grammar.score(grammar.clauses(r.text)) < 0.5]
    stage = corpus_pipeline.STAGES[0][1](spark, documents, SF)
    assert stage.columns == documents.columns and {r.doc_id for r in stage.collect()} == {r.doc_id for r in rows}
    good = {r.doc_id for r in quality.quality(spark.createDataFrame(rows, documents.schema)).collect() if r.kept}
    rows = [r for r in rows if r.doc_id in good]
    roots = plain_near_copies([r.text for r in rows])
    least = {c: min(r.doc_id for r, d in zip(rows, roots) if d == c) for c in set(roots)}
    rows = [r for r, c in zip(rows, roots) if r.doc_id == least[c]]
    found = corpus_pipeline.run(spark, SF).collect()
    want = {(r.doc_id, ids_crc((library(WORDS)[1](r.text) + [1])[:4096])) for r in rows}
    assert {(r.doc_id, r.ids_crc32) for r in found if r.piece == 0} == want


def test_near_copies_stage_finds_edited_copies_by_shingles(spark, odd, empty):
    rng, texts = np.random.default_rng(29), []
    for n in range(40):
        words = [f"w{x}" for x in rng.integers(0, 5000, 200)]
        texts.append(words)
        for edits in (1, 3, 4, 12):
            edited = list(words)
            for at in rng.choice(200, edits, replace=False):
                edited[at] = f"e{n}x{at}"
            texts.append(edited)
    sets = [{tuple(t[i:i + 5]) for i in range(196)} for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    docs = spark.createDataFrame([(n, " ".join(t)) for n, t in enumerate(texts)], "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in copies.near_copies(docs).collect()}
    assert found == dict(enumerate(root)) and len(set(root)) < 90
    kept = corpus_pipeline.drop_copies(spark, docs, SF)
    assert {r.doc_id for r in kept.collect()} == set(root)
    assert copies.keep_one(odd).filter("doc_id IS NULL").count() == 1 and copies.keep_one(empty).count() == 0


def test_near_copies_of_a_large_group_take_few_pairs(spark, monkeypatch):
    """Copies of one text, edited so that many are no near copies of each other, and a bucket of strangers."""
    rng = np.random.default_rng(31)
    base, texts = [f"w{x}" for x in rng.integers(0, 9000, 120)], []
    for n in range(400):
        words = list(base)
        for at in rng.choice(120, 1 + n % 2, replace=False):
            words[at] = f"e{n}x{at}"
        texts.append(" ".join(words))
    texts += [" ".join([*base[:60], *(f"s{n}x{k}" for k in range(60))]) for n in range(30)]
    pairs, similar = [], copies.similar
    monkeypatch.setattr(copies, "similar", lambda p, s: pairs.append(p.count()) or similar(p, s))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in copies.near_copies(docs).collect()}
    assert found == dict(enumerate(plain_near_copies(texts)))
    assert sum(pairs) < 20 * len(texts)


def test_near_copies_stage_compares_what_little_is_apart_at_once(spark, monkeypatch):
    """Windows that slide over one text: neighbours share buckets and all their shingles, but are no near copies."""
    words = [f"w{x}" for x in np.random.default_rng(37).integers(0, 10**6, 1100)]
    texts = [" ".join(words[at:at + 200]) for at in range(0, 900, 30)]
    texts += [t.replace(" ", " x ", 1) for t in texts[::4]]
    tables, write = [], copies.written
    monkeypatch.setattr(copies, "written", lambda df, purpose, *a: tables.append(purpose) or write(df, purpose, *a))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in copies.near_copies(docs).collect()}
    assert found == dict(enumerate(plain_near_copies(texts))) and len(set(found.values())) == 30
    assert tables.count("copies-linked") <= copies.PRUNED + 1


def test_components_are_written_once_more_only_until_they_are_stars(spark, monkeypatch):
    tables, write = [], graphs.written
    monkeypatch.setattr(graphs, "written", lambda df, purpose: tables.append(purpose) or write(df, purpose))

    def found(edges):
        tables.clear()
        rows = graphs.components(spark.createDataFrame(edges, "a long, b long"), "stars").collect()
        assert len(rows) == len({r.node for r in rows})
        return {r.node: r.root for r in rows}

    assert found([(1, 2), (3, 1), (1, 3), (7, 8), (5, 5)]) == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7} and len(tables) == 1
    assert found([(n, n + 1) for n in range(40)] + [(60, 50), (60, 55)]) == dict.fromkeys(range(41), 0) | {50: 50, 55: 50, 60: 50}
    assert found([]) == {} and len(tables) == 1


def test_word_models_equal_plain_counts_and_tell_wordings_apart(spark, odd, empty, monkeypatch):
    monkeypatch.setattr(lmscore, "RANGE", 4)  # many hash ranges; three partitions make three chunks
    texts = [(1, "we sell the red house"), (2, "the house we sell, red"), (3, "house red the sell we"), (4, None), (None, "we sell boats")]
    docs = spark.createDataFrame([*texts, texts[0]], "doc_id long, text string").repartition(3)
    found = {r.doc_id: r for r in lmscore.word_difference(docs, docs.filter("doc_id = 1").select("doc_id")).collect()}
    everything = [t for _, t in [*texts, texts[0]] if t]
    size = len({w for t in everything for w in lmscore.words(t)})

    def loss(training, text):
        one, two, before = collections.Counter(), collections.Counter(), collections.Counter()
        for t in training:
            tokens = lmscore.words(t)
            one.update(tokens)
            two.update(zip(["", *tokens], tokens))
            before.update(["", *tokens[:-1]])
        tokens, total = lmscore.words(text), 0.0
        for a, b in zip(["", *tokens], tokens):
            p = lmscore.WORD_SHARE * one[b] / one.total() + (1 - lmscore.WORD_SHARE) / size
            if before[a]:
                p = lmscore.PAIR_SHARE * two[a, b] / before[a] + (1 - lmscore.PAIR_SHARE) * p
            total -= math.log2(p)
        return total / len(tokens)

    for i, t in texts:
        if t:
            assert found[i].n_tokens == len(lmscore.words(t))
            assert found[i].target_loss == pytest.approx(loss([texts[0][1]] * 2, t))
            assert found[i].background_loss == pytest.approx(loss(everything, t))
    assert found[1].score < found[3].score and found[4].score is None and found[4].n_tokens == 0
    assert lmscore.word_difference(odd, odd.select("doc_id")).count() == odd.count()
    assert lmscore.word_difference(empty, empty.select("doc_id")).count() == 0
    for values in ([], [0], [5, 0, 1 << 40, 255]):
        assert lmscore.unpacked(lmscore.packed(np.array(values, np.uint64)), len(values)).tolist() == values


@pytest.mark.parametrize("width,lead", [(72, ""), (78, "# "), (40, " * ")])
def test_wrapped_license_notices_are_confirmed(spark, width, lead):
    import textwrap

    chosen = {("MIT", 1), ("BSD", 1), ("GPL", 1), ("Apache-2.0", 1), ("Apache-2.0", 3)}
    rows, want = [], {}
    for family, n in sorted(chosen):
        notice = "\n".join(lead + x for x in textwrap.wrap(licenses.TEMPLATES[family][n], width))
        want[len(rows)] = family
        rows.append((len(rows), f"Some program.\n\n{notice}\n\nwe had permission to walk there"))
    rows.append((99, "Released under the MIT License.\nwe had permission to walk there"))
    found = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.family) for r in found if r.confirmed} == {*want.items(), (99, "MIT")}
    assert not any(r.confirmed for r in found if r.body.startswith("we had"))


def test_points_with_one_key_are_met_in_bounded_blocks(spark, monkeypatch):
    placed = spark.range(1000).selectExpr("id AS point", "array(1f) AS v", "0 AS ordering", "0 AS range")
    blocks, sizes = ann.blocked(placed, 50)
    counts = [r["count"] for r in blocks.groupBy("ordering", "range", "block").count().collect()]
    assert sum(counts) == 1000 and max(counts) <= 100 and sizes.first().blocks == 20
    monkeypatch.setattr(ann, "RANGE_POINTS", 8)
    monkeypatch.setattr(ann, "QUERY_GROUP", 4)
    monkeypatch.setattr(ann, "TILE", 16)
    vectors = np.random.default_rng(31).standard_normal((120, 6)).astype(np.float32)
    vectors[7] = 1e6  # presses all others into one cell of the curve
    frame = spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    scores = vectors.astype(np.float64) @ vectors.astype(np.float64).T
    np.fill_diagonal(scores, -np.inf)
    want = {(q, int(v)) for q in range(0, 120, 20) for v in np.argsort(-scores[q])[:5]}
    assert {(r.query_id, r.vec_id) for r in ann.search(frame, k=5).collect()} == want


def test_near_copies_stage_links_fingerprints_by_the_byte_index(spark, monkeypatch):
    """Without any MinHash band, texts whose fingerprints are near are compared, and linked at 0.8 only."""
    rng = random.Random(8)
    base = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(3000)) for _ in range(6)]
    edited = [t.rsplit(" ", 1)[0] + " other" for t in base]
    near = [n for n, (x, y) in enumerate(zip(base, edited)) if (simhash.fingerprint(x, 5) ^ simhash.fingerprint(y, 5)).bit_count() <= 2]
    docs = spark.createDataFrame([(n, t) for n, t in enumerate([*base, *edited])] + [(20, ""), (21, None)], "doc_id long, text string")
    monkeypatch.setattr(copies, "bands", operator.itemgetter(slice(0, 0)))
    found = {r.doc_id: r.component_id for r in copies.near_copies(docs).collect()}
    assert len(near) >= 3 and found == {n: n for n in range(6)} | {n + 6: n if n in near else n + 6 for n in range(6)} | {20: 20, 21: 20}


def test_piece_memory_is_bounded_and_keeps_what_comes_again(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 400)
    small = tokens.PieceIds(WORDS)
    for n in range(12):
        texts = pa.array([" ".join(["often seen words", *(f"rare{n}x{k}" for k in range(150))])] * 2)
        ids, ends = small.encode(texts)
        alone, sizes = small._alone(texts.to_pylist())
        assert np.array_equal(ids, alone) and np.array_equal(np.diff(ends), sizes)
    assert "often" in small.memory and len(small.memory) <= 400 + 200 and len(small.flat) < 8 * 400 + 3000
