"""Array kernels over suffix orders and integer columns. No Spark here.

Texts are arrays of code points. Every kernel takes whole arrays; those for many texts at once take the texts
one after the other, each followed by its end marker, with ``bounds`` between them.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3  # fixed values of FNV-1a


def codes(text: str) -> np.ndarray:
    """Code points of a text."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


@dataclass
class SuffixOrder:
    """Suffixes of many texts, text by text: positions by rank, ranks by position, common prefixes with the
    previous rank (0 at rank 0). All of these count from 0 within the text; ``bounds`` cut the arrays."""

    bounds: np.ndarray
    sa: np.ndarray
    isa: np.ndarray
    lcp: np.ndarray
    symbols: np.ndarray  # code point + 1, or 0 for the end marker, by position


def _dense(symbols: np.ndarray) -> tuple[np.ndarray, int]:
    """(place of each symbol among the different ones, their number): by a table where symbols are small, else by sorting."""
    if not len(symbols):
        return symbols, 0
    top = int(symbols.max())
    if symbols.min() >= 0 and top < 4 * len(symbols) + (1 << 16):
        known = np.zeros(top + 1, bool)
        known[symbols] = True
        places = np.cumsum(known) - 1
        return places[symbols], int(places[-1]) + 1
    distinct, back = np.unique(symbols, return_inverse=True)
    return back.astype(np.int64), len(distinct)


def sorted_places(major: np.ndarray, minor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(places in the order of the keys, equal ones in their own order; where a new key begins). Keys are not negative. Keys and
    places are sorted as one integer where they fit into 63 bits, which takes an eighth of the time of a stable sort."""
    n = len(major)
    new = np.ones(n, bool)
    bits = max(1, (n - 1).bit_length())
    low = 0 if minor is None else int(minor.max(initial=0)).bit_length()
    if int(major.max(initial=0)).bit_length() + low + bits <= 63:
        packed = (major if minor is None else (major << low) | minor) << bits
        packed |= np.arange(n)
        packed.sort()
        order = packed & ((1 << bits) - 1)
        packed >>= bits
        new[1:] = packed[1:] != packed[:-1]
        return order, new
    order = np.argsort(major, kind="stable") if minor is None else np.lexsort((minor, major))
    new[1:] = major[order[1:]] != major[order[:-1]]
    if minor is not None:
        new[1:] |= minor[order[1:]] != minor[order[:-1]]
    return order, new


def suffix_order(texts: Sequence[np.ndarray], end_marks: Sequence[int] | None = None, with_lcp: bool = True) -> SuffixOrder:
    """Prefix doubling over all texts at once. The first round sorts by as many symbols as fit one integer with the place; a
    later one only the suffixes that still share their rank, which are few in most texts. Ranks are the places where
    groups begin, so those of settled suffixes stay. Common prefixes come from the ranks of the rounds and, below the
    first of them, from the first differing bit of its keys."""
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    n = int(bounds[-1])
    symbols = np.zeros(n, np.int64)
    for k, t in enumerate(texts):
        symbols[bounds[k] : bounds[k + 1] - 1] = t + 1
    start = np.repeat(bounds[:-1], lengths)
    if not n:
        return SuffixOrder(bounds, symbols, symbols, symbols, symbols)
    dense, size = _dense(symbols)
    bits, text_bits = max(1, (size - 1).bit_length()), len(texts).bit_length()
    first = max(1, min(8, 52 // bits, (63 - n.bit_length() - text_bits) // bits))
    key = dense.copy()
    for j in range(1, first):
        key <<= bits
        key[:-j] |= dense[j:]
    for left in range(first - 1):  # the last places of a text: nothing of the next one
        at = bounds[1:] - 1 - left
        at = at[at >= bounds[:-1]]
        key[at] &= -1 << (bits * (first - 1 - left))
    order, new = sorted_places((np.repeat(np.arange(len(texts)), lengths) << (bits * first)) | key)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    step, level, levels, split = first, 0, [], np.zeros(n, np.int8)  # the round that parts each suffix from the one before
    open_ = np.flatnonzero(~(new & np.append(new[1:], True)))
    new = new[open_]
    while len(open_):
        if with_lcp:
            levels.append((step, rank.astype(np.int32)))
        level += 1
        own = order[open_]
        at, apart = sorted_places(np.cumsum(new) - 1, rank[own + step])  # no open suffix ends within its first ``step`` symbols
        own = own[at]
        order[open_] = own
        split[open_[apart & ~new]] = level
        rank[own] = open_[np.maximum.accumulate(np.where(apart, np.arange(len(own)), 0))]
        keep = ~(apart & np.append(apart[1:], True))
        open_, new = open_[keep], apart[keep]
        step *= 2
    lcp = np.zeros(n, np.int64)
    if with_lcp:
        before = np.concatenate([order[:1], order[:-1]])
        for k in range(len(levels) - 1, -1, -1):
            width, ranks = levels[k]
            at = np.flatnonzero(split > k)
            got = lcp[at]
            same = ranks[order[at] + got] == ranks[before[at] + got]
            lcp[at[same]] += width
        differ = key[order + lcp] ^ key[before + lcp] if levels else key[order] ^ key[before]
        lcp += (bits * first - np.frexp(differ.astype(np.float64))[1]) // bits
        lcp[bounds[:-1]] = 0
    return SuffixOrder(bounds, order - start, rank - start, lcp, symbols)


def occurrence_rank(symbols: np.ndarray, of: np.ndarray) -> np.ndarray:
    """How often each entry's symbol stood before in its own text."""
    order, new = sorted_places(of.astype(np.int64), _dense(symbols)[0])
    first = np.flatnonzero(new)
    out = np.empty(len(order), np.int64)
    out[order] = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    return out


def _narrow(values: np.ndarray) -> np.ndarray:
    """Integers in 4 bytes where they fit: half the memory to go through."""
    if values.dtype != np.int64 or not len(values) or values.min() < -(1 << 31) or values.max() >= 1 << 31:
        return values
    return values.astype(np.int32)


def previous_smaller(values: np.ndarray, bounds: np.ndarray, or_equal: bool = False) -> np.ndarray:
    """For each entry the nearest earlier place in its part with a smaller (or equal) value, else -1; counts
    over the whole array. Blocks of falling sizes without such a value are skipped, all entries at once."""
    n = len(values)
    values = _narrow(values)
    of_start = np.repeat(bounds[:-1], np.diff(bounds))
    place = np.arange(n) - 1
    table = [values]
    width = 1
    longest = int(np.diff(bounds).max(initial=0))
    while 2 * width <= longest:
        low = table[-1].copy()
        low[width:] = np.minimum(low[width:], table[-1][:-width])
        table.append(low)
        width *= 2
    for low in reversed(table):
        near = low[place]
        ok = (near > values) if or_equal else (near >= values)
        ok &= place - width + 1 >= of_start
        place -= width * ok
        width //= 2
    return np.where(place >= of_start, place, -1)


def next_smaller(values: np.ndarray, bounds: np.ndarray, or_equal: bool = False) -> np.ndarray:
    """As ``previous_smaller``, to the right."""
    n = len(values)
    found = previous_smaller(values[::-1].copy(), n - bounds[::-1], or_equal)[::-1]
    return np.where(found >= 0, n - 1 - found, -1)


class RangeMinimum:
    """Leftmost minima of ranges of one array, from a sparse table of places."""

    def __init__(self, values: np.ndarray):
        self.values, self.table = values, [np.arange(len(values))]
        width = 1
        while 2 * width <= len(values):
            a, b = self.table[-1][:-width], self.table[-1][width:]
            self.table.append(np.where(values[b] < values[a], b, a))
            width *= 2

    def places(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Place of the leftmost minimum of [low, high], -1 for a range that is empty or leaves the array."""
        out = np.full(len(low), -1, np.int64)
        ok = (low >= 0) & (low <= high) & (high < len(self.values))
        a, b = low[ok], high[ok]
        level = np.floor(np.log2(np.maximum(b - a + 1, 1))).astype(int)
        made = np.empty(len(a), np.int64)
        for k in np.unique(level):
            at = level == k
            x, y = self.table[k][a[at]], self.table[k][b[at] - (1 << k) + 1]
            made[at] = np.where(self.values[y] < self.values[x], y, x)
        out[ok] = made
        return out


@dataclass
class JointOrder:
    """Suffixes of pairs of texts (a, b), pair by pair, those of a pair in one order; of equal ones that of a first. ``of`` is
    the pair, ``pos`` counts within the own text, ``before`` is the symbol before each suffix (0 at the start of a text),
    ``rest`` the length of the suffix."""

    bounds: np.ndarray
    of: np.ndarray
    from_b: np.ndarray
    pos: np.ndarray
    lcp: np.ndarray
    before: np.ndarray
    rest: np.ndarray


def joint_order(a: Sequence[np.ndarray], b: Sequence[np.ndarray], with_lcp: bool = True) -> JointOrder:
    """Both texts of a pair are sorted as one, b first and a separator between them, below all symbols but the end."""
    order = suffix_order([np.concatenate([y + 1, [0], x + 1]) for x, y in zip(a, b)], with_lcp=with_lcp)
    lengths = np.diff(order.bounds)
    of = np.repeat(np.arange(len(lengths)), lengths)
    middle = np.array([len(y) for y in b], np.int64)[of]
    from_b = order.sa <= middle
    before = order.symbols[order.bounds[of] + (order.sa - 1) % lengths[of]]
    before[before == 1] = 0
    return JointOrder(order.bounds, of, from_b, np.where(from_b, order.sa, order.sa - middle - 1), order.lcp, before, np.where(from_b, middle, lengths[of] - 1) - order.sa)


def nearest_minima(lcp: np.ndarray, known: np.ndarray, until: bool) -> np.ndarray:
    """For each place the common prefix with the nearest known place before it (0 without one), or after it with ``until``.
    Running minima that begin anew after each known place: later stretches lie below all of the earlier ones."""
    if until:
        return nearest_minima(np.append(lcp[1:], 0)[::-1], known[::-1], False)[::-1]
    large = int(lcp.max(initial=0)) + 1
    shift = (np.cumsum(known) - known) * large
    out = np.minimum.accumulate(lcp - shift) + shift
    out[: int(np.argmax(known)) + 1 if known.any() else len(out)] = 0
    return out


class Windows:
    """Minima of stretches of 2 ** k values, for the nearest smaller place before or after given ones."""

    def __init__(self, values: np.ndarray, longest: int):
        self.tables, width = [_narrow(values)], 1
        while 2 * width <= longest:
            low = self.tables[-1].copy()
            low[width:] = np.minimum(low[width:], self.tables[-1][:-width])
            self.tables.append(low)
            width *= 2

    def before(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The nearest place up to ``at`` with a value below ``least``, -1 without one."""
        at, width = at.copy(), 1 << (len(self.tables) - 1)
        for low in reversed(self.tables):
            at -= width * ((at - width + 1 >= 0) & (low[at] >= least))
            width //= 2
        return at

    def after(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The nearest place after ``at`` with a value below ``least``, the number of values without one."""
        n = len(self.tables[0])
        at, width = at + 1, 1 << (len(self.tables) - 1)
        for low in reversed(self.tables):
            end = at + width - 1
            at += width * ((end < n) & (low[np.minimum(end, n - 1)] >= least))
            width //= 2
        return at


def longest_matches(joint: JointOrder) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(pair, position in a, length, place in the order) of every position of every a, in text order: the longest prefix from
    there that occurs in b. The nearest suffixes of b on both sides of one of a hold it."""
    length = np.maximum(nearest_minima(joint.lcp, joint.from_b, False), nearest_minima(joint.lcp, joint.from_b, True))
    at = np.flatnonzero(~joint.from_b & (joint.rest > 0))
    sizes = np.bincount(joint.of[at], minlength=len(joint.bounds) - 1)
    ends = np.cumsum(sizes)
    place = np.empty(len(at), np.int64)
    place[(ends - sizes)[joint.of[at]] + joint.pos[at]] = at
    return joint.of[place], joint.pos[place], length[place], place


def match_ranks(joint: JointOrder, place: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last suffix of b, counted over all pairs, that share ``length`` > 0 symbols with the suffixes at ``place``."""
    windows = Windows(joint.lcp, int(np.diff(joint.bounds).max(initial=1)))
    seen = np.cumsum(joint.from_b)
    low, high = windows.before(place, length), windows.after(place, length) - 1
    return seen[low] - joint.from_b[low], seen[high] - 1


def shared_blocks(joint: JointOrder, block: int, depth: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(first place in the order, size) of ranges whose suffixes share a prefix and come from both texts, split by the next
    symbol until one side is small; depth by depth for all ranges at once. The end markers of both texts are equal here."""
    n = len(joint.of)
    twin = np.zeros(n, bool)
    twin[1:] = joint.from_b[1:] & ~joint.from_b[:-1] & (joint.rest[1:] == joint.rest[:-1]) & (joint.lcp[1:] == joint.rest[1:])
    shared = joint.lcp + twin
    shared[joint.bounds[:-1]] = -1
    counted = np.concatenate([[0], np.cumsum(joint.from_b)])
    ended = np.flatnonzero(twin & (joint.rest < min(seed, depth) - 1)) - 1  # above the seed no range is over but by its end
    made, rows = [(ended, np.full(len(ended), 2))], np.arange(n)
    for d in range(min(seed, depth), depth + 1):
        first = np.flatnonzero(shared[rows] < d)
        starts, sizes = rows[first], np.diff(np.append(first, len(rows)))
        b = counted[starts + sizes] - counted[starts]
        both = (b > 0) & (b < sizes)
        over = (joint.rest[starts] < d) | (np.minimum(b, sizes - b) <= block)  # the end marker is part of the prefix, or a side is small
        if d >= depth:
            over[:] = True
        elif d < seed:
            over &= joint.rest[starts] < d
        made.append((starts[both & over], sizes[both & over]))
        rows = rows[np.repeat(both & ~over, sizes)]
        if not len(rows):
            break
    start, size = (np.concatenate(x) for x in zip(*made))
    order = np.argsort(start, kind="stable")
    return start[order], size[order]


MOST_CELLS, BATCH_CELLS = 1 << 20, 1 << 22  # of a table for one block; of the tables held at once


def block_subsequences(a: np.ndarray, b: np.ndarray, a_start: np.ndarray, a_size: np.ndarray, b_start: np.ndarray, b_size: np.ndarray, most_edits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(block, place in a's part, place in b's part) of the matches that ``common_subsequence`` finds in each block, or where that
    needs too many edits ``commonest_match``. Blocks with a small side go through tables of lengths, all at once."""
    made: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def alone(k: int) -> None:
        x, y = a[a_start[k] : a_start[k] + a_size[k]].tolist(), b[b_start[k] : b_start[k] + b_size[k]].tolist()
        found = common_subsequence(x, y, most_edits)
        flat = np.array(commonest_match(x, y) if found is None else found, np.int64).reshape(-1, 2)
        made.append((np.full(len(flat), k), flat[:, 0], flat[:, 1]))

    small, large = np.minimum(a_size, b_size), np.maximum(a_size, b_size)
    for k in np.flatnonzero(small * large > MOST_CELLS):
        alone(int(k))
    for a_small in (True, False):
        own = np.flatnonzero((small * large <= MOST_CELLS) & ((a_size <= b_size) == a_small))
        own = own[np.argsort(-small[own], kind="stable")]
        parts = np.cumsum(small[own] * (large[own] + 1)) // BATCH_CELLS
        for ks in np.split(own, np.flatnonzero(np.diff(parts)) + 1) if len(own) else []:
            sides = (a, a_start[ks], b, b_start[ks]) if a_small else (b, b_start[ks], a, a_start[ks])
            of, i, j, length = _tables(*sides, small[ks], large[ks], a_small)
            far = a_size[ks] + b_size[ks] - 2 * length > most_edits
            if far.any():
                i, j, of = i[~far[of]], j[~far[of]], of[~far[of]]
                for k in ks[far]:
                    alone(int(k))
            made.append((ks[of], i, j) if a_small else (ks[of], j, i))
    of, i, j = (np.concatenate(x) for x in zip(*made)) if made else [np.zeros(0, np.int64)] * 3
    order, _ = sorted_places(of, i)
    return of[order], i[order], j[order]


def _tables(a: np.ndarray, a_start: np.ndarray, b: np.ndarray, b_start: np.ndarray, n: np.ndarray, m: np.ndarray, first: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(block, place in a, place in b, length by block): a longest common subsequence of each block, n symbols of a and m of b;
    n falls from block to block. One step makes a row of all tables: the lengths for one more symbol of a, over all of b.
    Going back, ``first`` says that a is the first text of ``common_subsequence``, which gives up symbols of the second first."""
    wide = m + 1
    starts = np.cumsum(wide) - wide
    of = np.repeat(np.arange(len(n)), wide)
    column = np.arange(int(wide.sum())) - starts[of]
    symbols = b[b_start[of] + np.maximum(column, 1) - 1]
    symbols[column == 0] = -1
    base = np.arange(len(n)) * (int(n.max()) + 1)  # keeps the lengths of a block above those of earlier ones
    rows = [base[of]]
    for i in range(1, int(n.max()) + 1):
        active = int(np.searchsorted(-n, -i, "right"))
        end = int(starts[active - 1] + wide[active - 1])
        row = rows[-1][:end].copy()
        row[1:] += (symbols[1:end] == a[a_start[:active] + i - 1][of[1:end]]) & (rows[-1][: end - 1] == row[1:])
        rows.append(np.maximum.accumulate(row))
    at, made = starts + m, []
    length = np.array([rows[k][x] for k, x in zip(n.tolist(), at.tolist())], np.int64) - base
    left = length.copy()
    for i in range(int(n.max()), 0, -1):
        active = np.arange(int(np.searchsorted(-n, -i, "right")))
        here = at[active]
        if first:
            here = np.searchsorted(rows[i], base[active] + left[active])
            at[active] = here
        taken = rows[i - 1][here] != base[active] + left[active]
        active = active[taken]
        found = here[taken] if first else np.searchsorted(rows[i], base[active] + left[active])
        at[active] = found - 1
        left[active] -= 1
        made.append((active, np.full(len(active), i - 1), found - 1 - starts[active]))
    return *(np.concatenate(x) for x in zip(*made)), length


def fnv1a(values: Sequence[int], seed: int = FNV_OFFSET) -> int:
    """Fold 64-bit values, byte by byte from the low end, in order."""
    h = seed
    for v in values:
        for b in int(v).to_bytes(8, "little"):
            h = ((h ^ b) * FNV_PRIME) & 0xFFFFFFFFFFFFFFFF
    return h


def _odd_before(bits: np.ndarray) -> np.ndarray:
    """Whether the number of ones before each place is odd, for zeros and ones: 64 places are one word."""
    words = np.zeros(-(-len(bits) // 64), "<u8")
    packed = np.packbits(bits, bitorder="little")
    words.view(np.uint8)[: len(packed)] = packed
    run = words.copy()
    for width in (1, 2, 4, 8, 16, 32):
        run ^= run << np.uint64(width)
    odd = np.bitwise_xor.accumulate(run >> np.uint64(63))
    run[1:] ^= np.uint64(0) - odd[:-1]
    return np.unpackbits((run ^ words).view(np.uint8), count=len(bits), bitorder="little")


@lru_cache(4)
def _powers(n: int) -> np.ndarray:
    """The first ``n`` powers of the factor of a whole value."""
    powers = np.full(n, pow(FNV_PRIME, 8, 1 << 64), np.uint64)
    powers[0] = 1
    return np.multiply.accumulate(powers)


def fnv1a_array(values: np.ndarray, seed: int = FNV_OFFSET) -> int:
    """As ``fnv1a`` of an array, in whole-array steps. A step h -> (h ^ b) * p adds (x - low) to h before it multiplies, with low
    the low byte of h and x = low ^ b; a bit of the next low byte is that of x, flipped by what the lower bits carry. So the
    low bytes come bit by bit from running exclusive ors, and the digest is a sum with powers of p. High bytes that are 0 in
    all values are steps that only multiply."""
    values = np.ascontiguousarray(values, "<i8")
    if not len(values):
        return seed
    top = int(np.bitwise_or.reduce(values))
    kept = 8 if top < 0 else max(1, -(-top.bit_length() // 8))
    b = np.empty(len(values) * kept, np.uint8)
    for k in range(kept):
        b[k::kept] = (values >> (8 * k)).astype(np.uint8)
    times = np.full(len(b), FNV_PRIME & 0xFF, np.uint8)
    times[kept - 1 :: kept] = pow(FNV_PRIME, 9 - kept, 256)
    x, low = np.zeros(len(b), np.uint8), np.zeros(len(b), np.uint8)
    for k in range(8):
        carried = ((x * times) ^ b) >> np.uint8(k)
        own = _odd_before(carried & np.uint8(1))
        own ^= np.uint8((seed >> k) & 1)
        own <<= np.uint8(k)
        low |= own
        x |= own ^ (b & np.uint8(1 << k))
    delta = x.astype(np.int64)
    delta -= low
    delta = delta.view(np.uint64)
    parts = np.zeros(len(values), np.uint64)
    for k in range(kept):
        parts += delta[k::kept] * np.uint64(pow(FNV_PRIME, 8 - k, 1 << 64))
    powers = _powers(1 << (len(values) - 1).bit_length())
    total = int((parts * powers[: len(values)][::-1]).sum(dtype=np.uint64))
    return (seed * pow(FNV_PRIME, 8 * len(values), 1 << 64) + total) & 0xFFFFFFFFFFFFFFFF


def increasing_length(values: Sequence, tails: list | None = None) -> list:
    """Tails of the best strictly increasing subsequences; their number is the length. ``tails`` carries on."""
    tails = [] if tails is None else tails
    for v in values:
        i = bisect_left(tails, v)
        tails[i : i + 1] = [v]
    return tails


def increasing_choice(options: Sequence[Sequence[int]]) -> list[tuple[int, int]]:
    """A longest strictly increasing choice of at most one value of each entry: (entry, value) pairs."""
    tails: list[int] = []
    holder: list[int] = []
    nodes: list[tuple[int, int, int]] = []
    for entry, values in enumerate(options):
        for v in sorted(set(values), reverse=True):  # falling, so that one entry cannot extend itself
            i = bisect_left(tails, v)
            nodes.append((entry, v, holder[i - 1] if i else -1))
            tails[i : i + 1] = [v]
            holder[i : i + 1] = [len(nodes) - 1]
    out, at = [], holder[-1] if holder else -1
    while at >= 0:
        entry, v, at = nodes[at]
        out.append((entry, v))
    return out[::-1]


def common_subsequence(a: Sequence, b: Sequence, most_edits: int = 8192) -> list[tuple[int, int]] | None:
    """Places of a longest common subsequence by furthest-reaching paths; None beyond ``most_edits`` edits.

    Round d keeps the d + 1 ends that it makes, 4 bytes each: 2 * d * d bytes in all, 134 MB at 8,192 edits."""
    n, m = len(a), len(b)
    rounds: list[array] = []  # ends in ``a`` on the diagonals -d, -d + 2, .. d
    for d in range(min(n + m, most_edits) + 1):
        last, made = rounds[-1] if rounds else None, array("i")
        for i in range(d + 1):
            x = 0 if last is None else last[0] if i == 0 else last[d - 1] + 1 if i == d else max(last[i], last[i - 1] + 1)
            y = x - (2 * i - d)
            while x < n and y < m and a[x] == b[y]:
                x, y = x + 1, y + 1
            made.append(x)
            if x >= n and y >= m:
                return _backtrack(rounds, d, n, m)
        rounds.append(made)
    return None


def _backtrack(rounds: list[array], d: int, x: int, y: int) -> list[tuple[int, int]]:
    """The matches of the path that ends at (x, y) after ``d`` edits, from the ends of the earlier rounds."""
    pairs = []
    while d >= 0:
        i, last = (x - y + d) // 2, rounds[d - 1] if d else None
        down = last is not None and (i == 0 or (i < d and last[i] > last[i - 1]))
        start = 0 if last is None else last[i] if down else last[i - 1] + 1  # where this round's matches begin
        pairs += [(x - k, y - k) for k in range(1, x - start + 1)]
        y -= x - start
        x = start
        if last is not None:
            x, y = (x, y - 1) if down else (x - 1, y)
        d -= 1
    return pairs[::-1]


def match_runs(a: Sequence, b: Sequence) -> list[tuple[int, int]]:
    """Match runs of equal symbols of two sequences in order: equal symbols match as far as the shorter run goes and both
    runs are over; else the run of the smaller symbol is over."""
    if not len(a) or not len(b):
        return []
    i, j = run_matches(np.asarray(a), np.asarray(b))
    return list(zip(i.tolist(), j.tolist()))


def run_matches(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a and in b of the matches of ``match_runs``; neither is empty. Only the runs are gone through one by one."""
    starts = [np.concatenate([[0], np.flatnonzero(x[1:] != x[:-1]) + 1]) for x in (a, b)]
    sizes = [np.diff(np.append(s, len(x))) for s, x in zip(starts, (a, b))]
    left, right = a[starts[0]].tolist(), b[starts[1]].tolist()
    n, m, i, j = len(left), len(right), 0, 0
    first, second = [], []
    while i < n and j < m:
        x, y = left[i], right[j]
        if x == y:
            first.append(i)
            second.append(j)
            i += 1
            j += 1
        elif x < y:
            i += 1
        else:
            j += 1
    first, second = np.array(first, np.int64), np.array(second, np.int64)
    shared = np.minimum(sizes[0][first], sizes[1][second])
    inside = np.arange(int(shared.sum())) - np.repeat(np.cumsum(shared) - shared, shared)
    return np.repeat(starts[0][first], shared) + inside, np.repeat(starts[1][second], shared) + inside


def commonest_match(a: Sequence, b: Sequence) -> list[tuple[int, int]]:
    """Match copies of the one symbol with most common copies (ties: the smaller), first to first."""
    shared = Counter(a) & Counter(b)
    if not shared:
        return []
    best = min(shared, key=lambda c: (-shared[c], c))
    return list(zip([i for i, c in enumerate(a) if c == best], [j for j, c in enumerate(b) if c == best]))


def zigzag(x: np.ndarray) -> np.ndarray:
    """Signed to unsigned: 0, -1, 1, -2, 2 become 0, 1, 2, 3, 4."""
    return np.where(x < 0, -2 * x - 1, 2 * x)


def unzigzag(x: np.ndarray) -> np.ndarray:
    return np.where(x % 2 == 1, -(x + 1) // 2, x // 2)


def copy_parse(target: np.ndarray, source: np.ndarray, most: int = 1024) -> list[tuple[int, int, int, int | None]]:
    """Greedy parse of ``target`` into copies from ``source``: (start, entries copied, source place, literal).

    Every phrase is the longest match (leftmost in suffix order of the source) of at most most - 1 entries,
    then one literal; the last may end without (None). Source place -1 marks an empty copy.
    """
    of, start, copied, src, literal = copy_parses([target], [source], most)
    return [(i, n, p, int(target[x]) if x >= 0 else None) for i, n, p, x in zip(start.tolist(), copied.tolist(), src.tolist(), literal.tolist())]


def copy_parses(targets: Sequence[np.ndarray], sources: Sequence[np.ndarray], most: int) -> tuple[np.ndarray, ...]:
    """(pair, start, entries copied, source place or -1, place of the literal or -1) of the phrases of ``copy_parse`` of each
    target. The longest matches of all places come from one order of both columns; the greedy walk only adds them up."""
    least = min((int(x.min()) for x in (*targets, *sources) if len(x)), default=0)
    joint = joint_order([x - least for x in targets], [x - least for x in sources])
    of, pos, length, place = longest_matches(joint)
    length = np.minimum(length, most - 1)
    chosen: list[int] = []
    done = 0
    for x in targets:
        steps, i, n = length[done : done + len(x)].tolist(), 0, len(x)
        while i < n:
            chosen.append(done + i)
            i += steps[i] + 1
        done += n
    at = np.array(chosen, np.int64)
    of, pos, length, place = of[at], pos[at], length[at], place[at]
    copies = length > 0
    src = np.full(len(at), -1, np.int64)
    src[copies] = joint.pos[joint.from_b][match_ranks(joint, place[copies], length[copies])[0]]
    literal = pos + length
    literal[literal >= np.array([len(x) for x in targets], np.int64)[of]] = -1
    return of, pos, length, src, literal
