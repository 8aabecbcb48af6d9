"""Recompression: a parse of token sequences whose symbols depend on nearby content only.

A round splits the alphabet in two by a bit of each symbol's name and replaces every pair (left, right) by a
new symbol; the first round replaces runs of one token before that. A new name stands for the names of its parts, so equal
pairs and runs have equal names wherever in the corpus they stand; the rounds of ``substring`` settle across the
corpus which names of a level stand more than once, before the next level builds on them. Each symbol carries its
context: the span of tokens that settles that the symbol appears. Any other occurrence of that span parses into the
same symbol.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from stringloom.llm.common import mix64

FAR = np.int64(1 << 40)  # a context that reaches past the text


@dataclass
class Symbols:
    """Parallel arrays over the symbols of many texts; spans count tokens over all of them."""

    name: np.ndarray
    start: np.ndarray
    end: np.ndarray
    low: np.ndarray  # the context is [low, high)
    high: np.ndarray
    text: np.ndarray
    shared: np.ndarray  # false once the symbol is known to stand only once in the corpus
    fresh: np.ndarray  # made by the last round


def level_zero(tokens: np.ndarray, bounds: np.ndarray) -> Symbols:
    at = np.arange(len(tokens), dtype=np.int64)
    return Symbols(tokens, at, at + 1, at, at + 1, np.repeat(np.arange(len(bounds) - 1, dtype=np.int32), np.diff(bounds)), np.ones(len(tokens), bool), np.zeros(len(tokens), bool))


def pair_round(s: Symbols, number: int) -> Symbols:
    """Replace pairs of a left and a right symbol. Their classes alone settle a pair; a symbol that stays alone
    was settled by the neighbour that it could have joined. A pair can be shared only if both parts are."""
    n = len(s.name)
    if n < 2:
        return Symbols(s.name, s.start, s.end, s.low, s.high, s.text, s.shared, np.zeros(n, bool))
    left = (mix64(s.name ^ np.uint64(0x51ED270B * (number + 1))) & np.uint64(1)).astype(bool)
    same = s.text[1:] == s.text[:-1]
    joins = left[:-1] & ~left[1:] & same
    second = np.zeros(n, bool)
    second[1:] = joins
    kept = np.flatnonzero(~second)
    first = np.zeros(n, bool)
    first[:-1] = joins
    merged = first[kept]
    following = np.minimum(kept + 1, n - 1)
    name = np.where(merged, mix64(s.name[kept] * np.uint64(0x9E3779B97F4A7C15) + mix64(s.name[following] + np.uint64(0xD6E8FEB86659FD93))), s.name[kept])
    end = np.where(merged, s.end[following], s.end[kept])
    # An unmerged left symbol needs its right neighbour's context, an unmerged right symbol its left neighbour's.
    after = np.where(np.append(same, False), np.append(s.high[1:], FAR), FAR)
    before = np.where(np.insert(same, 0, False), np.insert(s.low[:-1], 0, -FAR), -FAR)
    alone_left, alone_right = left[kept] & ~merged, ~left[kept]
    high = np.where(merged, s.high[following], np.where(alone_left, np.maximum(s.high[kept], after[kept]), s.high[kept]))
    low = np.where(alone_right, np.minimum(s.low[kept], before[kept]), s.low[kept])
    shared = s.shared[kept] & (~merged | s.shared[following])
    return Symbols(name, s.start[kept], end, low, np.maximum(high, s.high[kept]), s.text[kept], shared, merged)


def run_round(s: Symbols) -> Symbols:
    """Replace runs of one symbol; both neighbours settle where a run ends."""
    n = len(s.name)
    if n < 2:
        return s
    same = s.text[1:] == s.text[:-1]
    new = np.ones(n, bool)
    new[1:] = (s.name[1:] != s.name[:-1]) | ~same
    first = np.flatnonzero(new)
    last = np.append(first[1:], n) - 1
    length = (last - first + 1).astype(np.uint64)
    name = np.where(length > 1, mix64(s.name[first] ^ (length * np.uint64(0xA24BAED4963EE407))), s.name[first])
    after = np.where(np.append(same, False), np.append(s.high[1:], FAR), FAR)
    before = np.where(np.insert(same, 0, False), np.insert(s.low[:-1], 0, -FAR), -FAR)
    return Symbols(name, s.start[first], s.end[last], np.minimum(s.low[first], before[first]), np.maximum(s.high[last], after[last]), s.text[first], s.shared[first], length > 1)


def next_level(s: Symbols, number: int) -> Symbols:
    """One round. A run round widens each context by a neighbour on both sides, so runs are named among the tokens
    themselves, where they occur, and pairs in all rounds."""
    return pair_round(run_round(s) if number == 0 else s, number)


def parse(tokens: np.ndarray, bounds: np.ndarray, rounds: int) -> Symbols:
    """The symbols after ``rounds`` rounds over texts whose tokens lie between consecutive ``bounds``."""
    s = level_zero(tokens, bounds)
    for number in range(rounds):
        s = next_level(s, number)
    return s


def windows_with(low: np.ndarray, high: np.ndarray, width: int, tokens: int) -> np.ndarray:
    """For each start of a window of ``width`` tokens, how many of the given contexts lie inside it."""
    fits = (low >= 0) & (high - low <= width) & (high <= tokens)
    change = np.zeros(tokens + 1, np.int32)
    np.add.at(change, np.maximum(high[fits] - width, 0), 1)
    np.add.at(change, low[fits] + 1, -1)
    return np.cumsum(change[:tokens])
