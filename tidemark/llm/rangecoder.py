"""A context-mixing range coder for token ids, run over many blocks in lockstep.

The ids after the last one and after the last two are remembered in hashed tables (order 1 and 2)
with a small confidence each, anew in every block; how often each id occurs at all (order 0) is
counted over a group of blocks. The next id is "as order 2 says", "as order 1 says" or drawn from
order 0; the three are mixed by weights counted for each pair of confidences over the group. Order 0
and the weights are a group's model, which its reader needs. One range coder step per id.

Blocks are coded on their own, so numpy works on the same position of all blocks of a task at once.
What an id is predicted from is known to the writer beforehand; only the tables and the coder's
interval are stepped there, shares and weights are looked up for many positions together.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Tokens per block. Ids are below ``IDS``.
BLOCK, IDS = 4096, 1 << 18
ORDER1, ORDER2 = 2048, 4096
#: What a block's tables take: a little more, so that equal contexts of many blocks don't meet in the same cache lines.
STRIDE1, STRIDE2 = ORDER1 + 16, ORDER2 + 16
STATES = 32
#: Bits of the mixture's weights and of the ids' shares. A model's own shares have ``bits`` of the latter.
MIX, SHARE = 12, 20
TOTAL = MIX + SHARE
#: Words of 16 bits that a token may need at most, and those that end a block.
PER_TOKEN, LAST = 2, 4
#: Positions whose intervals are worked out together.
TOGETHER = 128
HEAD = "<IIB"


class Model:
    """A group's ids, their shares of ``1 << bits``, and the weights of order 2 and 1 by state."""

    def __init__(self, ids: np.ndarray, shares: np.ndarray, bits: int, weights: np.ndarray):
        self.ids, self.shares, self.bits, self.weights = ids, shares, bits, weights

    @classmethod
    def counted(cls, ids: np.ndarray) -> tuple[Model, np.ndarray]:
        """The model of a group's ids, without weights yet, and the ids as numbers in it."""
        if len(ids) and not 0 <= int(ids.min()) <= int(ids.max()) < IDS:
            raise ValueError(f"ids from {IDS} on, or negative ones, cannot be coded")
        counts = np.bincount(ids)
        known = np.flatnonzero(counts)
        number = np.zeros(len(counts) + 1, np.int32)
        number[known] = np.arange(len(known))
        bits = min(SHARE, max(12, len(known).bit_length() + 2))
        counts = counts[known].astype(np.int64)
        shares = 1 + counts * ((1 << bits) - len(known)) // max(len(ids), 1)
        if len(known):
            shares[counts.argmax()] += (1 << bits) - shares.sum()
        return cls(known.astype(np.uint32), shares, bits, np.zeros((STATES, 2), np.int64)), number[ids]

    def packed(self) -> bytes:
        steps = np.diff(self.ids.astype(np.int64), prepend=0).astype("<u4")
        body = zlib.compress(steps.tobytes() + self.shares.astype("<u4").tobytes() + self.weights.astype("<u2").tobytes())
        return struct.pack(HEAD, len(body), len(self.ids), self.bits) + body

    @classmethod
    def unpacked(cls, packed: bytes) -> tuple[Model, int]:
        """The model that the bytes begin with, and how many they are."""
        size, n, bits = struct.unpack_from(HEAD, packed)
        end = struct.calcsize(HEAD) + size
        body = zlib.decompress(packed[struct.calcsize(HEAD):end])
        ids = np.cumsum(np.frombuffer(body, "<u4", n)).astype(np.uint32)
        shares = np.frombuffer(body, "<u4", n, 4 * n).astype(np.int64)
        return cls(ids, shares, bits, np.frombuffer(body, "<u2", 2 * STATES, 8 * n).astype(np.int64).reshape(STATES, 2)), end


class Shares:
    """The models of many blocks in a row, looked up by lane."""

    def __init__(self, models: list[Model], of: np.ndarray):
        sizes = np.array([len(m.ids) for m in models] or [0])
        bits = np.array([m.bits for m in models] or [SHARE])
        self.row = (np.cumsum(sizes) - sizes)[of]
        self.more = (SHARE - bits)[of].astype(np.uint32)
        self.row_slot = (np.cumsum(1 << bits) - (1 << bits))[of]
        self.row_state = of * STATES
        begins = [np.cumsum(m.shares) - m.shares << SHARE - m.bits for m in models]
        widths = [m.shares << SHARE - m.bits for m in models]
        self.begin, self.width = (np.concatenate([*x, [0]]).astype(np.uint64) for x in (begins, widths))
        self.models = models

    def weigh(self) -> None:
        """Ends of the first two cases by state, and the part that is left to order 0, in rows."""
        weights = np.concatenate([*[m.weights for m in self.models], np.zeros((1, 2), np.int64)])
        ends = np.cumsum(weights, axis=1)
        self.ends = np.stack([ends[:, 0] << SHARE, ends[:, 1] << SHARE, (1 << MIX) - ends[:, 1]]).astype(np.uint64)

    def slots(self) -> np.ndarray:
        """The number of the id at every share of every model."""
        return np.concatenate([*[np.repeat(np.arange(len(m.ids), dtype=np.int32), m.shares) if len(m.ids) else np.zeros(1 << m.bits, np.int32)
                                 for m in self.models], np.zeros(1, np.int32)])


class Tables:
    """What order 1 and order 2 of many lanes remember, as two rows of one array: both are read and stepped in one call."""

    SHIFT, MASK = np.array([[3], [5]]), np.array([[ORDER1 - 1], [ORDER2 - 1]])

    def __init__(self, lanes: int):
        lane = np.arange(lanes)
        self.row = np.stack([lane * STRIDE1, lanes * STRIDE1 + lane * STRIDE2])
        self.entries = np.zeros(lanes * (STRIDE1 + STRIDE2), np.int32)

    def places(self, last: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Where both remember what came after the last id and the one before it, order 1 first; the ids may be rows of positions."""
        n = last.shape[-1]
        at = np.empty((*last.shape[:-1], 2, n), np.int64)
        one, two = at[..., 0, :], at[..., 1, :]
        np.multiply(last, 40503, out=one, dtype=np.int32)
        np.multiply(before, 30011, out=two, dtype=np.int32)
        two += one
        at >>= self.SHIFT
        at &= self.MASK
        at += self.row[:, :n]
        return at

    def learn(self, at: np.ndarray, entry: np.ndarray, sure: np.ndarray) -> None:
        """A right prediction gains confidence up to ``sure``, a wrong one loses it or gives way to a fresh one."""
        same = entry ^ sure
        same -= 4
        same >>= 31
        held = -(entry & 3)
        held >>= 31
        fresh = sure - 2
        wrong = entry - 1
        right = np.minimum(entry + 1, sure)
        for mask, yes, no in ((held, wrong, fresh), (same, right, wrong)):  # chosen(), in place
            yes ^= no
            yes &= mask
            yes ^= no
        self.entries[at] = right


def states(entry1: np.ndarray, entry2: np.ndarray) -> np.ndarray:
    """The confidences of both predictions, and whether they agree."""
    return (entry2 & 3) << 3 | (entry1 & 3) << 1 | (entry1 ^ entry2 < 4)


def chosen(mask: np.ndarray, yes: np.ndarray, no: np.ndarray) -> np.ndarray:
    """``yes`` where the mask has all bits, ``no`` where it has none, faster than ``np.where`` where these take turns."""
    return no ^ (yes ^ no) & mask


def lanes_of(sizes: np.ndarray) -> tuple[np.ndarray, int, np.ndarray]:
    """The order of lanes by falling size, the longest, and how many are live at each position."""
    order = np.argsort(-sizes, kind="stable")
    longest = int(sizes.max(initial=0))
    return order, longest, np.searchsorted(-sizes[order], -np.arange(longest), side="left")


def encode_groups(groups: list[list[np.ndarray]]) -> tuple[list[Model], list[list[bytes]]]:
    """The model of each group of blocks and its blocks' codes."""
    models, numbers, of = [], [], []
    for g, blocks in enumerate(groups):
        model, number = Model.counted(np.concatenate(blocks) if blocks else np.zeros(0, np.int64))
        models.append(model)
        numbers += np.split(number, np.cumsum([len(b) for b in blocks])[:-1]) if blocks else []
        of += [g] * len(blocks)
    sizes = np.array([len(b) for b in numbers], np.int64)
    order, longest, live = lanes_of(sizes)
    lanes = len(numbers)
    ids = np.zeros((longest + 2, lanes), np.int32)
    for lane, n in enumerate(order):
        ids[2:sizes[n] + 2, lane] = numbers[n]
    found = Shares(models, np.array(of, np.int64)[order])
    entries = predicted(ids, live)
    count_weights(found, ids, entries, sizes[order])
    found.weigh()
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
    words = np.zeros((lanes, longest * PER_TOKEN + LAST + 1), np.uint32)
    flat, row = words.reshape(-1), np.arange(lanes) * words.shape[1]
    place, u = row.copy(), np.uint64

    def emit(n: int, full: np.ndarray) -> None:
        """The next word of all lanes is written; those that are ``full`` go on behind it, others write it again later."""
        flat[place[:n]] = low[:n] >> u(48)
        shift = full.astype(np.uint64) << u(4)
        low[:n] <<= shift
        span[:n] <<= shift
        place[:n] += full

    for t in range(longest):
        n = int(live[t])
        if t % TOGETHER == 0:
            begins, widths = intervals(found, ids[t + 2:t + 2 + TOGETHER, :n], *(e[t:t + TOGETHER, :n] for e in entries))
        unit = span[:n] >> u(TOTAL)
        more = unit * begins[t % TOGETHER, :n]
        low[:n] += more
        over = np.flatnonzero(low[:n] < more)
        if len(over):
            flat[place[over] - 1] += 1
        np.multiply(unit, widths[t % TOGETHER, :n], out=span[:n])
        emit(n, span[:n] < u(1 << 48))
        which = np.flatnonzero(span[:n] < u(1 << 48))
        while len(which):  # a few lanes have another word
            flat[place[which]] = low[which] >> u(48)
            low[which] <<= u(16)
            span[which] <<= u(16)
            place[which] += 1
            which = which[span[which] < u(1 << 48)]
    for _ in range(LAST):
        emit(lanes, np.ones(lanes, bool))
    used = place - row
    words = words[:, :int(used.max(initial=0))]
    while (words > 0xFFFF).any():
        carry = words >> 16
        words &= 0xFFFF
        words[:, :-1] += carry[:, 1:]
    codes: list[bytes] = [b""] * lanes
    for lane, n in enumerate(order):
        if sizes[n]:
            codes[n] = words[lane, :used[lane]].astype("<u2").tobytes()
    ends = np.cumsum([0, *map(len, groups)])
    return models, [codes[a:b] for a, b in zip(ends, ends[1:])]


def predicted(ids: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What order 1 and order 2 hold before each position; the first two rows of ``ids`` stand before the blocks."""
    longest, lanes = len(ids) - 2, ids.shape[1]
    tables, entries = Tables(lanes), np.zeros((longest, 2, lanes), np.int32)
    for t in range(longest):
        n, k = int(live[t]), t % TOGETHER
        if not k:
            stop = min(t + TOGETHER, longest)
            at = tables.places(ids[t + 1:stop + 1, :n], ids[t:stop, :n])
            sure = ids[t + 2:stop + 2, :n] << 2 | 3
        place = at[k, :, :n]
        entry = tables.entries.take(place)
        entries[t, :, :n] = entry
        tables.learn(place, entry, sure[k, :n])
    return entries[:, 0], entries[:, 1]


def count_weights(found: Shares, ids: np.ndarray, entries: tuple[np.ndarray, np.ndarray], sizes: np.ndarray) -> None:
    """Sets the models' weights: how often order 2, or else order 1, was right in each state."""
    cells = len(found.models) * STATES
    counts = np.zeros(cells * 3, np.int64)
    for t in range(0, len(ids) - 2, TOGETHER):
        entry1, entry2, x = entries[0][t:t + TOGETHER], entries[1][t:t + TOGETHER], ids[t + 2:t + 2 + TOGETHER]
        state = found.row_state + states(entry1, entry2)
        # By state: neither was right, order 1 was, order 2 was.
        hit2, hit1 = entry2 >> 2 == x, entry1 >> 2 == x
        case = state * 3 + (hit2.view(np.int8) * 2 + (hit1 > hit2))
        if sizes[-1] < t + len(x):
            case = case[np.arange(t, t + len(x))[:, None] < sizes]
        counts += np.bincount(case.reshape(-1), minlength=len(counts))
    right1, right2 = counts[1::3], counts[2::3]
    seen = counts[::3] + right1 + right2
    weights = ((np.stack([right2, right1], axis=1) * 16 + 1) << MIX) // (seen * 16 + 4)[:, None]
    weights[:, 0] = np.clip(weights[:, 0], 8, (1 << MIX) - 32)
    weights[:, 1] = np.clip(weights[:, 1], 8, (1 << MIX) - 16 - weights[:, 0])
    weights[1::2, 1] = 0  # the states in which both agree
    for model, own in zip(found.models, weights.reshape(-1, STATES, 2)):
        model.weights = own


def intervals(found: Shares, ids: np.ndarray, entry1: np.ndarray, entry2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The begin and width of each id's interval of ``1 << TOTAL``."""
    n, s = ids.shape[1], np.uint64(SHARE)
    state = found.row_state[:n] + states(entry1, entry2)
    end2, end1, rest = found.ends.take(state, axis=1)
    at = found.row[:n] + ids
    hit2, hit1 = entry2 >> 2 == ids, entry1 >> 2 == ids
    begins, widths = found.begin.take(at), found.width.take(at)
    begins *= rest
    begins += end1
    widths *= rest
    hit2, hit1 = (-h.astype(np.int64).view(np.uint64) for h in (hit2, hit1))
    begins = chosen(hit2 | hit1, end2 & ~hit2, begins)
    return begins, chosen(hit2, end2, chosen(hit1, end1 - end2, widths))


def decode_groups(groups: list[tuple[Model, list[bytes], list[int]]]) -> list[list[np.ndarray]]:
    """The blocks of each group again, from its model, its blocks' codes and numbers of ids."""
    models = [m for m, _, _ in groups]
    codes, sizes = [c for _, own, _ in groups for c in own], np.array([n for *_, own in groups for n in own], np.int64)
    of = np.repeat(np.arange(len(groups)), [len(own) for _, own, _ in groups])
    order, longest, live = lanes_of(sizes)
    lanes = len(codes)
    parts = [np.frombuffer(codes[n], "<u2") for n in order]
    words = np.zeros((lanes, max([len(p) for p in parts], default=0) + LAST + 2), np.uint16)
    for lane, part in enumerate(parts):
        words[lane, :len(part)] = part
    flat, row = words.reshape(-1), np.arange(lanes) * words.shape[1]
    found = Shares(models, of[order])
    found.weigh()
    slots = found.slots()
    tables, u = Tables(lanes), np.uint64
    code, span = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
    for k in range(LAST):
        code = code << u(16) | words[:, k]
    at = row + LAST
    ids = np.zeros((longest + 2, lanes), np.int32)
    for t in range(longest):
        n = int(live[t])
        places = tables.places(ids[t + 1, :n], ids[t, :n])
        entries = tables.entries.take(places)
        entry1, entry2 = entries
        end2, end1, rest = found.ends.take(found.row_state[:n] + states(entry1, entry2), axis=1)
        unit = span[:n] >> u(TOTAL)
        value = np.minimum(code[:n] // unit, u((1 << TOTAL) - 1))
        behind = value - end1
        hit2, listed = (value - end2).view(np.int64) >> 63, behind.view(np.int64) >> 63
        hit2_bits, listed_bits = hit2.view(np.uint64), listed.view(np.uint64)
        behind &= ~listed_bits
        place = behind.astype(np.uint32) // rest.astype(np.uint32)
        place >>= found.more[:n]
        x = slots.take(found.row_slot[:n] + place)
        share = found.row[:n] + x
        begin, width = found.begin.take(share), found.width.take(share)
        begin *= rest
        begin += end1
        width *= rest
        begin = chosen(listed_bits, end2 & ~hit2_bits, begin)
        width = chosen(listed_bits, chosen(hit2_bits, end2, end1 - end2), width)
        x = chosen(listed.astype(np.int32), chosen(hit2.astype(np.int32), entry2, entry1) >> 2, x)
        code[:n] -= unit * begin
        np.multiply(unit, width, out=span[:n])
        short = span[:n] < u(1 << 48)
        shift = short.astype(np.uint64) << u(4)
        code[:n] <<= shift
        code[:n] |= flat.take(at[:n]) * short
        span[:n] <<= shift
        at[:n] += short
        which = np.flatnonzero(span[:n] < u(1 << 48))
        while len(which):  # a few lanes need another word
            code[which] = code[which] << u(16) | flat[at[which]]
            span[which] <<= u(16)
            at[which] += 1
            which = which[span[which] < u(1 << 48)]
        ids[t + 2, :n] = x
        tables.learn(places, entries, x << 2 | 3)
    blocks: list[np.ndarray] = [np.zeros(0, np.uint32)] * lanes
    for lane, n in enumerate(order):
        if sizes[n]:
            blocks[n] = models[of[n]].ids[ids[2:sizes[n] + 2, lane]]
    ends = np.cumsum([0, *[len(own) for _, own, _ in groups]])
    return [blocks[a:b] for a, b in zip(ends, ends[1:])]


def encode(blocks: list[np.ndarray]) -> list[bytes]:
    """Each block's code behind a model of its own. Blocks hold up to any number of ids; equally long ones cost least."""
    models, codes = encode_groups([[b] for b in blocks])
    return [model.packed() + own for model, (own,) in zip(models, codes)]


def decode(codes: list[bytes], sizes: list[int]) -> list[np.ndarray]:
    """The blocks again, from their codes and numbers of ids."""
    groups = []
    for code, size in zip(codes, sizes):
        model, end = Model.unpacked(code)
        groups.append((model, [code[end:]], [size]))
    return [block for (block,) in decode_groups(groups)]
