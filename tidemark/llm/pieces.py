"""A batch of texts as pieces: cut where no token can cross, every distinct piece named once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


#: A word with marks behind it, and perhaps the next line's word: five parts that a byte-level tokenizer's pattern takes one by one.
WITH_MARKS = "^( ?L+)([.,;:!?$&*%#]+)(\n?)(L*)([.,;:!?$&*%#]*)$".replace("L", "[A-Za-zÀ-ÖØ-öø-ÿ]")


def ragged(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The slices ``flat[starts[i]:starts[i] + counts[i]]`` in a row."""
    ends = np.cumsum(counts)
    return flat[np.repeat(starts - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)]


@dataclass
class Pieces:
    """``words[i]`` are the distinct pieces and ``at`` the pieces of all texts in a row, text ``t``
    owning ``at[ends[t]:ends[t + 1]]``. ``whole`` are texts that must be encoded uncut."""

    words: list[str]
    at: np.ndarray
    ends: np.ndarray
    whole: np.ndarray


def _strings(words: pa.Array) -> list[str]:
    return words.to_numpy(zero_copy_only=False).tolist()


def _are_lone(words: pa.Array) -> np.ndarray:
    """Which words are not empty and have no blank of any script at either end."""
    if not len(words):
        return np.zeros(0, bool)
    offsets = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, words.offset * 4)
    raw = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    lone = np.zeros(len(words), bool)
    filled = np.flatnonzero(np.diff(offsets))
    ends = raw[offsets[filled]], raw[offsets[filled + 1] - 1]
    lone[filled] = (ends[0] > 0x20) & (ends[0] < 0x7F) & (ends[1] > 0x20) & (ends[1] < 0x7F)
    rest = filled[~lone[filled]]
    lone[rest] = [not word[0].isspace() and not word[-1].isspace() for word in _strings(words.take(pa.array(rest)))]
    return lone


def _words(texts: pa.Array, lead: bool) -> tuple[np.ndarray, pa.DictionaryArray]:
    """What lies between single blanks, without ``lead`` also between line ends, and where each text's begin and end."""
    texts = texts.cast(pa.string()) if not pa.types.is_string(texts.type) else texts
    lists = pc.split_pattern(texts if lead else pc.replace_substring(texts, "\n", " "), " ")
    ends = lists.offsets.to_numpy().astype(np.int64)
    return ends - ends[0], lists.flatten().dictionary_encode()


def cut(texts: pa.Array, lead: bool, marks: bool = True) -> Pieces:
    """Cuts at single blanks.

    With ``lead`` a blank belongs to the word after it, so pieces but the first of a text start with
    one, and a text with a blank beside another blank, where the cut would not be safe, is whole; with ``marks``
    a word, the marks behind it and a next line's word are pieces of their own. That holds for byte-level
    tokenizers whose added tokens have a ``<``. Otherwise blanks and line ends only separate. No texts give no pieces.
    """
    ends, flat = _words(texts, lead)
    at = flat.indices.to_numpy().astype(np.int64)
    if not lead:
        return Pieces(_strings(flat.dictionary), at, ends, np.zeros(len(texts), bool))
    lone = _are_lone(flat.dictionary)
    # Every text has a first piece, empty for the empty text, which is then the only one.
    first = at[ends[:-1]]
    alone = np.diff(ends) == 1
    bad = ~lone[at]
    bad[ends[:-1][alone]] = False
    whole = np.add.reduceat(bad, ends[:-1]) > 0 if len(ends) > 1 else np.zeros(0, bool)
    heads, head_at = np.unique(first, return_inverse=True)
    at[ends[:-1]] = len(flat.dictionary) + head_at
    later = pc.binary_join_element_wise(pa.scalar(" "), flat.dictionary, pa.scalar(""))
    words = pa.concat_arrays([later, flat.dictionary.take(pa.array(heads))])
    return Pieces(*(_part_marks(words, at, ends) if marks else (_strings(words), at, ends)), whole)


def uncut(texts: pa.Array) -> Pieces:
    """Whole texts only."""
    return Pieces([], np.zeros(len(texts), np.int64), np.arange(len(texts) + 1), np.ones(len(texts), bool))


def _part_marks(words: pa.Array, at: np.ndarray, ends: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The pieces with those ``WITH_MARKS`` in their parts."""
    marked = pc.match_substring_regex(words, WITH_MARKS)
    lists = pc.split_pattern(pc.replace_substring_regex(words.filter(marked), WITH_MARKS, "\\1\0\\2\0\\3\0\\4\0\\5"), "\0")
    parts, marked = lists.flatten(), marked.to_numpy(zero_copy_only=False)
    filled = pc.greater(pc.binary_length(parts), 0)
    counts = np.ones(len(words), np.int64)
    counts[marked] = filled.to_numpy(zero_copy_only=False).reshape(-1, 5).sum(axis=1)
    found = pa.concat_arrays([parts.filter(filled), words.filter(pa.array(~marked))]).dictionary_encode()
    begins = np.empty(len(words), np.int64)
    behind = np.cumsum(counts[marked])
    begins[marked] = behind - counts[marked]
    begins[~marked] = (behind[-1] if len(behind) else 0) + np.arange(np.count_nonzero(~marked))
    counts = counts[at]
    at = ragged(found.indices.to_numpy().astype(np.int64), begins[at], counts)
    return _strings(found.dictionary), at, np.concatenate([[0], np.cumsum(counts)])[ends]


def stems(texts: pa.Array) -> Pieces:
    """Cuts for a tokenizer that lower-cases and parts letters from marks: at blanks and line ends, ASCII words in
    small letters, with the marks behind their last letter as a piece of its own. Words with ``<`` may be added
    tokens and stay. No texts give no pieces."""
    lists, flat = _words(texts, False)
    words = flat.dictionary
    plain = pc.and_(pc.string_is_ascii(words), pc.invert(pc.match_substring(words, "<")))
    small = pc.replace_substring_regex(pc.ascii_lower(words), "([a-z])([.,;:!?]+)$", "\\1 \\2")
    parts = pc.split_pattern(pc.if_else(plain, small, words), " ")
    begins, at = parts.offsets.to_numpy().astype(np.int64), flat.indices.to_numpy()
    stem = parts.flatten().dictionary_encode()
    counts = np.diff(begins)[at]
    ends = np.cumsum(counts)
    at = stem.indices.to_numpy()[np.repeat(begins[at] - ends + counts, counts) + np.arange(counts.sum())]
    return Pieces(_strings(stem.dictionary), at, np.concatenate([[0], ends])[lists], np.zeros(len(texts), bool))
