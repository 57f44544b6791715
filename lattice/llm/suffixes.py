"""Difference-cover suffix sorting in blocks, with numpy.

``equal_prefixes`` sorts chosen suffixes of a byte string and tells which of them share their first ``DEPTH`` bytes.  A
difference cover D modulo V has, for any two residues, a shift below V that takes both into D.  The suffixes at cover positions
are ranked once.  The others are sorted a bucket of leading bytes at a time, by their first V bytes; ties are resolved by the
ranks at the shift that takes both suffixes to cover positions, by three-way partitions around a pivot of each tied group.
So memory is bounded by the ranks of the sample and one bucket, however long the repeats are.
"""

from __future__ import annotations

import numpy as np

V, DEPTH = 32, 50
#: Suffixes that are sorted at once, about.
BUCKET = 1 << 19
_PAD = V + DEPTH + 16


def difference_cover(v: int = V) -> list[int]:
    """Residues whose differences give every residue; chosen greedily."""
    cover, missing = [0, 1], set(range(v)) - {0, 1, v - 1}
    while missing:
        gain = lambda c: len(missing & {(c - d) % v for d in cover} | missing & {(d - c) % v for d in cover})
        best = max((c for c in range(v) if c not in cover), key=gain)
        missing -= {(best - d) % v for d in cover} | {(d - best) % v for d in cover}
        cover.append(best)
    return sorted(cover)


COVER = difference_cover()
_SHIFT = np.array([[next(k for k in range(V) if (a + k) % V in COVER and (b + k) % V in COVER) for b in range(V)] for a in range(V)], np.int64)


def _words(data: bytes) -> np.ndarray:
    """Eight bytes from each position, as numbers that order like the bytes."""
    return np.ndarray((len(data) - 7,), ">u8", buffer=data, strides=(1,))


def _sorted_by(words: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of ``at`` by n words from each, whether an entry of that order differs from the one before)."""
    keys = [words[at + 8 * k].astype(np.uint64) for k in range(n)]
    order = np.lexsort(keys[::-1])
    new = np.ones(len(at), bool)
    if len(at) > 1:
        new[1:] = False
        for k in keys:
            s = k[order]
            new[1:] |= s[1:] != s[:-1]
    return order, new


def _resolve(at: np.ndarray, new: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """``at`` with the groups that start at ``new`` put in order by the ranks at cover positions."""
    at = at.copy()
    bounds = np.r_[np.flatnonzero(new), len(at)]
    first, size = bounds[:-1], np.diff(bounds)
    first, size = first[size > 1], size[size > 1]
    while len(first):
        where = np.repeat(first - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        group = np.repeat(np.arange(len(first)), size)
        own, pivot = at[where], np.repeat(at[first], size)
        shift = _SHIFT[own % V, pivot % V]
        side = np.sign(rank[own + shift] - rank[pivot + shift])
        at[where] = own[np.argsort(group * 3 + side + 1, kind="stable")]
        less, more = np.bincount(group[side < 0], minlength=len(first)), np.bincount(group[side > 0], minlength=len(first))
        first, size = np.r_[first, first + size - more], np.r_[less, more]
        first, size = first[size > 1], size[size > 1]
    return at


def equal_prefixes(text: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts in suffix order, class of each): equal classes are equal in their DEPTH first bytes, all within ``text``."""
    if not len(starts):
        return starts, starts
    data = text + b"\0" * _PAD
    words = _words(data)
    sample = np.arange(len(text) + V)
    sample = sample[np.isin(sample % V, COVER)]
    order, new = _sorted_by(words, sample, 7)
    rank = np.zeros(len(text) + V, np.int64)
    rank[sample[order]] = np.cumsum(new)
    lead = words[starts].astype(np.uint64)
    blocks = max(1, len(starts) // BUCKET)
    cuts = np.unique(np.quantile(lead.astype(np.float64), np.arange(1, blocks) / blocks)) if blocks > 1 else np.zeros(0)
    block = np.searchsorted(cuts, lead.astype(np.float64), side="right")
    out = []
    for b in range(len(cuts) + 1):
        at = starts[block == b]
        if len(at):
            order, new = _sorted_by(words, at, V // 8)
            out.append(_resolve(at[order], new, rank))
    at = np.concatenate(out)
    new = np.ones(len(at), bool)
    new[1:] = False
    for k in (*range(0, DEPTH - 8, 8), DEPTH - 8):
        s = words[at + k]
        new[1:] |= s[1:] != s[:-1]
    return at, np.cumsum(new) - 1
