"""Library tokenization of whole texts, with remembered pieces.

A text is cut at blanks where the tokenizer itself can never join what lies on both sides, each
distinct piece of a batch is encoded by the library once and remembered while the memory lasts, and
a text's ids are its pieces' ids in a row. Which cuts are safe follows from the tokenizer file; a
file of another kind is applied to whole texts.

Short pieces go to the library many at a time, as one text: pieces that begin with a blank are told
apart by their first ids, others by a mark between them that is one id and lies in none of them. Words
of small Latin letters skip the normalizer and the pattern, which leave them as they are.
"""

from __future__ import annotations

import json
import os
from array import array
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import per_process
from .pieces import cut, ragged, stems, uncut

#: Pieces remembered by a process; beyond it those are forgotten that no later batch had again, or all if too few
#: are. Longer pieces are not remembered.
REMEMBERED, LONG_PIECE = 500_000, 64
#: Short pieces in one text for the library, and what may stand between them.
TOGETHER, MARKS = 512, "|=;"
#: The byte-level letter for a blank.
BLANK = "\u0120"
#: Words that are normal and lower-case and one match of the pattern of a lower-casing tokenizer.
PLAIN = "^[a-zà-öø-ÿ]+$"


class Remembered:
    """``encode(texts)``: the ids of all texts in a row and where each text's begin and end, put together from the
    remembered ids of pieces. ``cut`` says how pieces are cut, ``_add`` encodes those that are new."""

    cut = "lead"

    def _forget(self) -> None:
        """Remembered pieces as numbers; the ids of piece ``n`` are ``flat[begins[n]:begins[n] + sizes[n]]``."""
        self.memory: dict[str, int] = {}
        self.flat, self.begins, self.sizes = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.again = np.zeros(0, bool)

    def _thin(self) -> None:
        """Forgets the pieces that came in one batch only since the last time."""
        kept = [(word, n) for word, n in self.memory.items() if self.again[n]]
        if len(kept) > REMEMBERED // 2:
            return self._forget()
        which = np.array([n for _, n in kept], np.int64)
        self.flat, self.sizes = ragged(self.flat, self.begins[which], self.sizes[which]), self.sizes[which]
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.memory, self.again = {word: n for n, (word, _) in enumerate(kept)}, np.zeros(len(kept), bool)

    def _add(self, pieces: list[str], whole: bool) -> np.ndarray:
        """Encodes pieces, or whole texts, and gives their numbers."""
        raise NotImplementedError

    def _store(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Keeps the ids of pieces in a row and gives the pieces' numbers."""
        numbers = len(self.sizes) + np.arange(len(sizes))
        self.begins = np.concatenate([self.begins, len(self.flat) + np.cumsum(sizes) - sizes])
        self.again = np.concatenate([self.again, np.zeros(len(sizes), bool)])
        self.sizes, self.flat = np.concatenate([self.sizes, sizes]), np.concatenate([self.flat, ids])
        return numbers

    def numbered(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The numbers of the distinct pieces, which of them all texts have in a row, and where each text's begin and end."""
        pieces = {"lead": lambda: cut(texts, True), "drop": lambda: stems(texts), "none": lambda: uncut(texts)}[self.cut]()
        if len(self.memory) > REMEMBERED or len(self.flat) > 8 * REMEMBERED:
            self._thin()
        numbers = np.fromiter(map(self.memory.get, pieces.words, repeat(-1)), np.int64, len(pieces.words))
        self.again[numbers[numbers >= 0]] = True
        if len(new := np.flatnonzero(numbers < 0)):
            words = [pieces.words[n] for n in new]
            numbers[new] = self._add(words, False)
            self.memory.update(zip(words, numbers[new].tolist()))
            for word in words:
                if len(word) > LONG_PIECE:
                    del self.memory[word]
        at, ends = pieces.at, pieces.ends
        which = np.flatnonzero(pieces.whole)
        if len(which):  # each becomes one piece, its first; its others are left out
            keep = np.repeat(~pieces.whole, np.diff(ends))
            keep[ends[which]] = True
            at[ends[which]] = len(numbers) + np.arange(len(which))
            numbers = np.concatenate([numbers, self._add([texts[int(t)].as_py() for t in which], True)])
            at, ends = at[keep], np.concatenate([[0], np.cumsum(keep)])[ends]
        return numbers, at, ends

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        numbers, at, ends = self.numbered(texts)
        at = numbers[at]
        counts = self.sizes[at]
        return ragged(self.flat, self.begins[at], counts), np.concatenate([[0], np.cumsum(counts)])[ends]


class PieceIds(Remembered):
    """The ids that the library gives."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        for tokenizer in (self.tokenizer, self.plain):
            tokenizer.no_truncation()
            tokenizer.no_padding()
        self.plain.normalizer = None
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        with open(path, encoding="utf-8") as file:
            self.cut = self._safe_cut(json.load(file))
        self.mark = next((m for m in MARKS if len(self._library([m])[0]) == 4), None)
        self.mark_id = int(np.frombuffer(self._library([self.mark])[0], "<u4")[0]) if self.mark else -1
        self.leads = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        self.leads[[n for t, n in self.tokenizer.get_vocab().items() if t.startswith(BLANK)]] = True
        self._forget()

    @staticmethod
    def _safe_cut(spec: dict) -> str:
        """'drop' if blanks only separate, 'lead' if one blank begins the word after it, else 'none'."""
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]) or spec.get("post_processor"):
            return "none"
        before, normalizer = spec["pre_tokenizer"], spec["normalizer"]
        if before["type"] == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"] and normalizer is None:
            return "lead" if all("<" in t["content"] for t in spec["added_tokens"]) else "none"
        parts = before.get("pretokenizers", [])
        steps = [n["type"] for n in (normalizer or {}).get("normalizers", [])]
        if (parts and parts[0]["type"] == "Split" and parts[0]["behavior"] == "Removed" and parts[0]["invert"]
                and steps == ["NFC", "Replace", "Lowercase"] and all("<" in t["content"] for t in spec["added_tokens"])):
            return "drop"
        return "none"

    def _library(self, texts: list[str], tokenizer=None) -> list[bytes]:
        found = (tokenizer or self.tokenizer).encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def _alone(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts in a row and how many each has."""
        parts = self._library(texts)
        return np.frombuffer(b"".join(parts), "<u4"), np.array([len(p) // 4 for p in parts], np.int64)

    def _together(self, pieces: list[str], tokenizer=None) -> tuple[np.ndarray, np.ndarray]:
        """The same for pieces that may share a text."""
        between, behind = (f" {self.mark} ", f" {self.mark}") if self.cut == "drop" else ("", "")
        texts = [between.join(pieces[at:at + TOGETHER]) + behind for at in range(0, len(pieces), TOGETHER)]
        ids = np.frombuffer(b"".join(self._library(texts, tokenizer)), "<u4")
        if self.cut == "drop":
            sizes = np.diff(np.flatnonzero(ids == self.mark_id), prepend=-1) - 1
            ids = ids[ids != self.mark_id]
        else:
            sizes = np.diff(np.flatnonzero(self.leads[ids]), append=len(ids))
        if len(sizes) != len(pieces):
            raise ValueError("pieces joined for the library cannot be told apart")
        return ids, sizes

    def _ways(self, pieces: list[str]) -> np.ndarray:
        """How each piece may be encoded: 0 alone, 1 together with others, 2 together without normalizer."""
        words = pa.array(pieces, pa.string())
        length = pc.utf8_length(words).to_numpy(zero_copy_only=False)
        short = (length > 0) & (length <= LONG_PIECE)
        if self.cut == "lead":
            # Ends of printable ASCII or letters: no blank of any script beside the cut.
            return short * pc.match_substring_regex(words, r"^ [!-~\p{L}](?:[^ ]*[!-~\p{L}])?$").to_numpy(zero_copy_only=False)
        if self.mark is None:
            return np.zeros(len(pieces), int)
        short &= ~pc.match_substring(words, self.mark).to_numpy(zero_copy_only=False)
        return short * (1 + pc.match_substring_regex(words, PLAIN).to_numpy(zero_copy_only=False))

    def _add(self, pieces: list[str], whole: bool) -> np.ndarray:
        ways = np.zeros(len(pieces), int) if whole else self._ways(pieces)
        each = [np.flatnonzero(ways == w) for w in (0, 1, 2)]
        calls = self._alone, self._together, lambda p: self._together(p, self.plain)
        found = [call([pieces[n] for n in which]) for call, which in zip(calls, each)]
        numbers = np.empty(len(pieces), np.int64)
        numbers[np.concatenate(each)] = self._store(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))
        return numbers


def piece_ids(path: str) -> PieceIds:
    """The encoder of a tokenizer file, one per process."""
    return per_process(("piece ids", path), lambda: PieceIds(path))
