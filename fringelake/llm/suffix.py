"""Suffix arrays of many word sequences at once, in numpy: suffixes of a sequence are compared with each other only."""

from __future__ import annotations

import numpy as np


def suffix_order(codes: np.ndarray, seq: np.ndarray, ends: np.ndarray, longest: int | None = None):
    """The positions of `codes` ordered by (sequence, suffix), a suffix that ends before another one coming first,
    with the slot of each position and, by prefix doubling, its ranks by the first 1, 2, 4, ... words. `seq` is the
    number of each position's sequence and `ends` where that ends. With `longest`, suffixes that share as many
    words may be left in any order and share a rank."""
    n = len(codes)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), []
    key = seq.astype(np.int64) * (int(codes.max()) + 1) + codes
    order = np.argsort(key, kind="stable")
    slots, h, levels = np.arange(n), 1, []
    rank = np.empty(n, np.int64)
    slots = _settle(order, key[order], slots, rank)
    levels.append(rank.astype(np.int32))
    while len(slots) and (longest is None or h < longest):
        at = order[slots]
        after = at + h
        second = np.where(after < ends[at], rank[np.minimum(after, n - 1)] + 1, 0)
        key = rank[at] * (n + 1) + second
        sort = np.argsort(key, kind="stable")
        order[slots] = at[sort]
        slots = _settle(at[sort], key[sort], slots, rank)
        levels.append(rank.astype(np.int32))
        h *= 2
    return order, rank, levels


def _settle(at: np.ndarray, key: np.ndarray, slots: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Give positions in order of their keys the first slot of their group as rank; the slots still shared."""
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(key)))
    rank[at] = np.repeat(slots[first], size)
    return slots[np.repeat(size > 1, size)]


def common_prefixes(order: np.ndarray, ends: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Words that each suffix shares with the one before it in its sequence's order; 0 for the first."""
    n = len(order)
    lcp = np.zeros(n, np.int64)
    k = np.arange(1, n)
    if levels:
        k = k[levels[0][order[k - 1]] == levels[0][order[k]]]
    for level in range(len(levels) - 1, -1, -1):
        rank, h = levels[level], 1 << level
        a, b = order[k - 1] + lcp[k], order[k] + lcp[k]
        inside = (a < ends[order[k - 1]]) & (b < ends[order[k]])
        same = np.zeros(len(k), bool)
        same[inside] = rank[a[inside]] == rank[b[inside]]
        # Equal ranks mean h equal words, as shorter suffixes have ranks of their own.
        lcp[k[same]] += h
    return lcp
