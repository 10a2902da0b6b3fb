"""Suffix order of many short strings at once, and what operators 9 and 10 read from it.

The strings of a batch lie one after the other in one array of symbols; each belongs to a block, and only
suffixes of one block are compared. Suffixes are ordered by prefix doubling: ranks of the first `base`
symbols, then of twice as many, and so on; only suffixes that are still tied are sorted again.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def ranks(key: np.ndarray, base: int, reach: int) -> list[tuple[int, np.ndarray]]:
    """(size, rank) for sizes base, 2 * base, ... and at last reach: rank[i] orders the `size` symbols at i; equal
    ones have equal ranks. key holds the first `base` symbols at each place."""
    n = len(key)
    order = np.argsort(key)
    first = np.maximum.accumulate(np.where(np.r_[True, key[order][1:] != key[order][:-1]], np.arange(n), 0)) if n else order
    rank = np.empty(n, np.int64)
    rank[order] = first
    levels, size = [(base, rank)], base
    while size < reach:
        step = min(size, reach - size)
        tied = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
        after = rank[np.minimum(tied + step, n - 1)] + 1
        after[tied + step >= n] = 0
        k = rank[tied].astype(np.uint64) << np.uint64(32) | after.astype(np.uint64)
        order = np.argsort(k)
        k, at, old = k[order], np.arange(len(k)), rank[tied][order]
        new = np.maximum.accumulate(np.where(np.r_[True, k[1:] != k[:-1]], at, 0)) if len(k) else at
        group = np.maximum.accumulate(np.where(np.r_[True, old[1:] != old[:-1]], at, 0)) if len(k) else at
        rank = rank.copy()
        rank[tied[order]] = old + new - group
        size += step
        levels.append((size, rank))
    return levels


@dataclass
class Order:
    """Suffixes in order: `suffix` are their numbers (places in `start`) by block, then by the first `reach`
    symbols, then by number; `common[i]` is how many symbols, up to reach, the ith has in common with the one before
    it, 0 at a block's first."""

    start: np.ndarray
    room: np.ndarray
    suffix: np.ndarray
    common: np.ndarray


def ordered(symbols: np.ndarray, key: np.ndarray, base: int, reach: int, start: np.ndarray, room: np.ndarray, block: np.ndarray) -> Order:
    """start: where each suffix begins in symbols, and room: how many symbols its string has from there. Numbers of
    suffixes are to grow with their positions in the documents."""
    levels = ranks(key, base, reach)
    by = block.astype(np.uint64) << np.uint64(32) | levels[-1][1][start].astype(np.uint64)
    suffix = np.argsort(by, kind="stable")
    common = np.zeros(len(start), np.int64)
    if len(start) > 1:
        same_block = np.flatnonzero(block[suffix][1:] == block[suffix][:-1]) + 1
        x, y = start[suffix[same_block - 1]], start[suffix[same_block]]
        most = np.minimum(np.minimum(room[suffix[same_block - 1]], room[suffix[same_block]]), reach)
        k = np.zeros(len(x), np.int64)
        last = len(key) - 1
        for size, rank in reversed([one for i, one in enumerate(levels) if one[0] == base << i]):
            k += np.where((k + size <= most) & (rank[np.minimum(x + k, last)] == rank[np.minimum(y + k, last)]), size, 0)
        if base > 1:
            going, end = np.ones(len(x), bool), len(symbols) - 1
            for _ in range(base - 1):
                going &= (k < most) & (symbols[np.minimum(x + k, end)] == symbols[np.minimum(y + k, end)])
                k += going
        common[same_block] = k
    return Order(start, room, suffix, common)


def with_smaller_before(number: np.ndarray, common: np.ndarray) -> np.ndarray:
    """For each place in the order: the common prefix with the nearest place before it that has a smaller number, 0 if
    there is none. Places between are jumped over, since their numbers are larger."""
    n = len(number)
    before, least = np.arange(n) - 1, common.copy()
    todo = np.flatnonzero(least > 0)
    while len(todo := todo[(number[before[todo]] > number[todo]) & (least[todo] > 0)]):
        over = before[todo]
        least[todo] = np.minimum(least[todo], least[over])
        before[todo] = before[over]
        least[todo[before[todo] < 0]] = 0
    return least


def longest_previous_factors(o: Order) -> np.ndarray:
    """For each suffix: how many of its first symbols, up to reach, also stand at a smaller number of its block. It is
    the longer of the common prefixes with the previous and the next smaller number in suffix order."""
    n = len(o.suffix)
    number = o.suffix.astype(np.int64)
    before = with_smaller_before(number, o.common)
    after = with_smaller_before(number[::-1], np.r_[0, o.common[1:][::-1]])[::-1] if n else before
    out = np.zeros(n, np.int64)
    out[o.suffix] = np.maximum(before, after)
    return out


def matches(o: Order) -> np.ndarray:
    """For each suffix: how many of its first symbols, up to reach, stand at any other number of its block."""
    out = np.zeros(len(o.suffix), np.int64)
    out[o.suffix] = np.maximum(o.common, np.r_[o.common[1:], 0])
    return np.minimum(out, o.room)


def parsed(longest: np.ndarray, first: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The greedy factors (suffix number, length) of strings that begin at suffix number first[i] and have windows[i]
    suffixes: each factor is the longest that stands elsewhere in the block, one symbol if there is none, and the next
    one begins where it ends. All strings are parsed in step."""
    at, end = first.copy(), first + windows
    found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64),) * 2]
    while len(at):
        size = np.maximum(longest[at], 1)
        found.append((at, size))
        going = at + size < end
        at, end = (at + size)[going], end[going]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))
