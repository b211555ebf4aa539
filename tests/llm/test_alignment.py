"""Cross-tokenizer alignment beside a plain reading of every document."""

import bisect
import collections
import hashlib
import itertools
import json

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tidemark.llm import alignment
from tidemark.llm.bpe import byte_letters

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, kind string, chunk string, n_a string, which string, pos int, best string, n int"
CLASH = ("k", "c", "n", "w", 1, "b", 2)
ODD = [
    None, "", " ", "  a", "a  b", "x \n y", "\n\n", "don't 'll <|endoftext|> x<|endoftext|>y <s>", "a" * 300, "日本語 テスト é é  x", "\x1ca \x1c b",
    "😀 x😀y 123abc", "tab\tx", "end ", " start", "a\r\n b", "same words here", "same words here", "low▁line", "▁", "ends▁ here", "ﬁ ½ ㎡", "internationalization of tokenizers",
]


def plain(texts):
    """The contract's columns by loops over whole documents."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    letters = byte_letters()
    names = {i: t for t, i in json.load(open(A, encoding="utf-8"))["model"]["vocab"].items()}
    docs, counts = [], collections.Counter()
    for i, t in texts:
        x, y = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        xs = [bytes(letters[c] for c in names[k]) for k in x]
        ys = [bytes([int(b.id_to_piece(k)[3:-1], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in y]
        if not t or not b"".join(xs) == b"".join(ys) == (" " + t).encode():
            docs.append((i, [], []))
            continue
        ends = [list(itertools.accumulate(map(len, side))) for side in (xs, ys)]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups = [([], []) for _ in cuts]
        for side, (ids, own) in enumerate(zip((x, y), ends)):
            for k, e in zip(ids, own):
                groups[bisect.bisect_left(cuts, e)][side].append(k)
        links = [(p, q) for g in groups for p in g[0] for q in g[1]]
        counts.update(set(links))
        docs.append((i, groups, links))
    most = collections.defaultdict(int)
    for (p, _), n in counts.items():
        most[p] = max(most[p], n)
    for i, groups, links in docs:
        text = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        yield (
            i, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links),
            sum(counts[k] == most[k[0]] for k in links), sum(counts[k] for k in links),
            hashlib.sha256(text.encode()).hexdigest() if groups else "",
        )


def rows_of(spark, texts):
    return spark.createDataFrame([(i, t, *CLASH) for i, t in texts], SCHEMA)


@pytest.fixture(scope="module")
def texts(spark):
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    return [tuple(r) for r in given] + [(1000 + n, t) for n, t in enumerate(ODD)] + [(None, "no id"), (1016, "same words here"), (2000, "long words " * 4000)]


def test_alignment_equals_plain_loops(spark, texts):
    found = alignment.link_counts(rows_of(spark, texts).repartition(3), A, B)
    assert collections.Counter(map(tuple, found.collect())) == collections.Counter(plain(texts))


def test_chunks_do_not_change_the_counts(texts):
    few = texts[:12] + texts[200:]
    aligner = alignment.Aligner(A, B)

    def by_chunks(size):
        rows = []
        for at in range(0, len(few), size):
            chunk = alignment.Chunk(at)
            values = pa.array([t or "" for _, t in few[at:at + size]])
            empty = np.array([not t for _, t in few[at:at + size]])
            rows.append([chunk.add(*aligner.units(values), pa.array([i for i, _ in few[at:at + size]]), empty), *chunk.closed()])
        pairs = collections.Counter()
        for own in rows:
            for batch in own[2:]:
                for r in batch.to_pylist():
                    pairs[r["a"], r["b"]] += r["n"]
        most = collections.defaultdict(int)
        for (a, _), n in pairs.items():
            most[a] = max(most[a], n)
        for own in rows:
            counted = [r for batch in own[2:] for r in batch.to_pylist()]
            told = pa.table({"pos": [r["pos"] for r in counted], "count": [pairs[r["a"], r["b"]] for r in counted],
                             "best": [int(pairs[r["a"], r["b"]] == most[r["a"]]) for r in counted]})
            yield from map(tuple, (r.values() for r in alignment._scored(pa.Table.from_batches(own[:2]), told).to_pylist()))

    assert collections.Counter(by_chunks(len(few))) == collections.Counter(by_chunks(5)) == collections.Counter(plain(few))


def test_groups_are_given_as_text(spark):
    texts = [(n, t) for n, t in enumerate(ODD)]
    found = {r.doc_id: r.groups for r in alignment.groups(rows_of(spark, texts), A, B).collect()}
    for row in plain(texts):
        text = found[row[0]]
        assert ("" if text is None else hashlib.sha256(text.encode()).hexdigest()) == row[-1]


def test_alignment_of_nothing(spark):
    assert alignment.link_counts(rows_of(spark, []), A, B).count() == 0
    none = alignment.link_counts(rows_of(spark, [(1, None), (2, "")]), A, B).collect()
    assert sorted(map(tuple, none)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_units_that_come_again_are_kept_and_chunks_are_bounded(monkeypatch):
    monkeypatch.setattr(alignment, "RECENT", 10)
    monkeypatch.setattr(alignment, "ALIGNED", 7)
    monkeypatch.setattr(alignment, "MOST_UNITS", 300)
    aligner, chunk, calls = alignment.Aligner(A, B), alignment.Chunk(0), []
    align = aligner._align
    monkeypatch.setattr(aligner, "_align", lambda units: calls.append(list(units)) or align(units))
    for n in range(8):
        texts = pa.array([" ".join(["often seen words", *(f"rare{n}x{k}" for k in range(50))])] * 2)
        chunk.add(*aligner.units(texts), pa.array([1, 2]), np.zeros(2, bool))
        assert chunk.full == (len(chunk.links) >= 300)
    assert chunk.full and max(map(len, calls)) == 7
    assert sum(c.count("seen") for c in calls) == 1 and "seen" in aligner.kept and len(aligner.recent) < 110
