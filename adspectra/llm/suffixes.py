"""Suffix arrays by prefix doubling, for many short texts at once.

All arrays hold one text per column.  Symbols are whole numbers from 0 to 255; the last symbol of a text
is 0 and occurs nowhere else in it.
"""

from __future__ import annotations

import numpy as np


def _ordered(text: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of one text in the order of their first ``depth`` symbols, at least.

    Suffixes are sorted by as many symbols as fit a word beside the place; those still alike are sorted by
    their ranks and the ranks of what follows, which doubles the symbols told apart at each step.
    """
    n = len(text)
    bits = np.uint64(n.bit_length())
    place = (np.uint64(1) << bits) - np.uint64(1)
    told = (64 - int(bits)) // 8
    padded = np.zeros(n + told, np.uint64)
    padded[:n] = text
    words = padded[:n].copy()
    for k in range(1, told):
        words <<= np.uint64(8)
        words |= padded[k : n + k]
    words = np.sort(words << bits | np.arange(n, dtype=np.uint64))
    sa = (words & place).astype(np.int64)
    words >>= bits
    slots = np.arange(n)
    rank = np.zeros(n + 1, np.uint64)  # the slot of the first of those alike, from 1; past the end 0
    while True:
        new = np.ones(len(slots) + 1, bool)
        new[1:-1] = words[1:] != words[:-1]
        rank[sa[slots]] = np.maximum.accumulate(np.where(new[:-1], slots, 0)) + 1
        slots = slots[~(new[:-1] & new[1:])]
        if told >= depth or not len(slots):
            return sa
        at = sa[slots]
        own, following = rank[at], rank[np.minimum(at + told, n)]
        if 3 * bits <= 64:
            words = np.sort(own << bits + bits | following << bits | at.astype(np.uint64))
            sa[slots] = words & place
            words >>= bits
        else:
            order = np.lexsort((following, own))
            sa[slots] = at[order]
            words = (own << bits | following)[order]
        told *= 2


def suffix_arrays(t: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Suffix arrays of the texts in the columns of ``t``; depth: the order is open among suffixes that share so many symbols."""
    n, width = t.shape
    # Suffixes of one text differ in it by their last symbol, so the texts can be sorted as one.
    sa = _ordered(np.ascontiguousarray(t.T).ravel(), min(n, depth or n))
    if width > 1:
        sa = sa[np.argsort(sa // n, kind="stable")]
    return (sa % n).astype(np.int32).reshape(width, n).T


def permuted_common_prefixes(t: np.ndarray, sa: np.ndarray, most: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """For each position of each text, the common prefix (at most ``most``) with the suffix sorted before it.

    Eight symbols (of 8 bits) are compared at a time. wanted: the positions to fill; others stay 0.
    """
    n, width = t.shape
    before = np.full(t.shape, -1, np.int32)
    before[sa[1:], np.arange(width)] = sa[:-1]
    out = np.zeros(t.shape, np.int32)
    padded = np.zeros((n + most + 8, width), np.uint64)
    padded[:n] = t
    eight = padded[: n + most].copy()
    for k in range(1, 8):
        eight |= padded[k : n + most + k] << np.uint64(8 * k)
    eight = eight.ravel()
    place = np.flatnonzero((before >= 0) if wanted is None else (before >= 0) & wanted)
    at, other = place, before.ravel()[place].astype(np.int64) * width + place % width
    flat = out.ravel()
    for k in range(0, most, 8):
        x = eight[at + k * width] ^ eight[other + k * width]
        unlike = x != 0
        low = x[unlike]
        flat[place[unlike]] = k + (np.bitwise_count((low & (~low + np.uint64(1))) - np.uint64(1)) >> 3)
        alike = ~unlike
        place, at, other = place[alike], at[alike], other[alike]
        if not len(place):
            break
    flat[place] = most
    return np.minimum(out, most)
