"""Multinomial draws that any task can make for itself.

A replicate draws as many groups as there are, with replacement. How often it drew the groups of a range is split in two,
again and again, down to single groups: how many of m draws fall into the left half of a range is a binomial number,
counted from the set bits of a hash of (seed, replicate, range). So the draws of some groups depend on nothing but their
numbers; they are made again wherever rows of those groups are, and never joined on, stored or moved.
"""

from __future__ import annotations

import numpy as np

#: Hashed words counted at a time, the bits of a split's probability, and ranges x replicates split at a time.
WORDS, BITS, CELLS = 1 << 21, 32, 1 << 20
_LOW = 0xFFFFFFFF
#: Multipliers and shifts of a published 32-bit mixer.
MIXER = ((16, 0x7FEB352D), (15, 0x846CA68B), (16, None))


def mix(h: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Fold a 32-bit value into a 32-bit hash."""
    h = h ^ value
    for shift, factor in MIXER:
        h = h ^ (h >> np.uint32(shift))
        if factor:
            h = h * np.uint32(factor)
    return h


def _low(x: np.ndarray) -> np.ndarray:
    return (x & _LOW).astype(np.uint32)


def left_part(size: np.ndarray) -> np.ndarray:
    return np.left_shift(np.int64(1), np.frexp((size - 1).astype(float))[1] - 1)


def _set_bits(m: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Set bits among the first m (32 at most) of each word."""
    return np.bitwise_count(h & ((np.int64(1) << m) - 1).astype(np.uint32)).astype(np.int64)


def _ones(m: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Set bits among the first m bits that each hash leads to, 32 to a word."""
    out = np.empty(len(m), np.int64)
    few = m <= 32
    out[few] = _set_bits(m[few], mix(h[few], np.uint32(0)))
    many = np.flatnonzero(~few)
    words = -(-m[many] // 32)
    ends, lo = np.cumsum(words), 0
    while lo < len(many):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + WORDS, "right")))
        of = np.repeat(many[lo:hi], words[lo:hi])
        first = np.cumsum(words[lo:hi]) - words[lo:hi]
        w = np.arange(len(of)) - np.repeat(first, words[lo:hi])
        out[many[lo:hi]] = np.add.reduceat(_set_bits(np.minimum(m[of] - 32 * w, 32), mix(h[of], w.astype(np.uint32))), first)
        lo = hi
    return out


def _left(seed: int, m: np.ndarray, lo: np.ndarray, size: np.ndarray, reps: np.ndarray) -> np.ndarray:
    """How many of the m draws (ranges x replicates) of each range fall into its left part.

    That part is the largest power of two below the size, so all ranges but those at the right edge are halved. A draw is a random number in binary, compared with the left part's share from the first bit on: the draws that still
    agree with the share after a bit are what the next bit decides on.
    """
    share = (left_part(size) << BITS) // size
    h = mix(mix(np.uint32(seed & _LOW), _low(reps))[None, :], _low(lo)[:, None])
    h = mix(mix(h, _low(size)[:, None]), _low((lo >> 32) ^ ((size >> 32) << 16))[:, None])
    open_, taken = m.copy(), np.zeros_like(m)
    for bit in range(BITS - 1, -1, -1):
        some = np.flatnonzero(share & ((2 << bit) - 1))  # after the first bit the right edge alone, all others are halved
        if not len(some):
            break
        left = open_[some]
        live = left > 0
        ones = np.zeros_like(left)
        ones[live] = _ones(left[live], mix(h[some][live], np.uint32(bit)))
        here = (share[some] >> bit & 1).astype(bool)[:, None]
        taken[some] += np.where(here, left - ones, 0)
        open_[some] = np.where(here, ones, left - ones)
    return taken


def multiplicities(seed: int, n: int, ranks: np.ndarray, replicates: int) -> np.ndarray:
    """How often each replicate drew each of the groups `ranks` (0..n-1): an array of groups x replicates.

    Ranges are split level by level, and from ``CELLS`` on half of them at a time: memory beyond the result stays bounded,
    and the top of the tree, which costs as much as there are groups, is split once.
    """
    wanted, back = np.unique(np.asarray(ranks, np.int64), return_inverse=True)
    reps = np.arange(replicates)
    out = np.zeros((len(wanted), replicates), np.int32)
    todo = [(np.zeros(1, np.int64), np.full(1, n, np.int64), np.full((1, replicates), n, np.int64))]
    while todo:
        lo, size, m = todo.pop()
        if len(lo) > 1 and len(lo) * replicates > CELLS:
            half = len(lo) // 2
            todo += [(lo[half:], size[half:], m[half:]), (lo[:half], size[:half], m[:half])]
            continue
        at = np.searchsorted(wanted, [lo, lo + size])
        some = at[1] > at[0]
        lo, size, m, at = lo[some], size[some], m[some], at[0][some]
        single = size == 1
        out[at[single]] = m[single]
        lo, size, m = lo[~single], size[~single], m[~single]
        if len(lo):
            left, half = _left(seed, m, lo, size, reps), left_part(size)
            todo.append((np.concatenate((lo, lo + half)), np.concatenate((half, size - half)), np.concatenate((left, m - left))))
    return out[back]
