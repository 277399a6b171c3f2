"""Words of whole texts as numpy arrays: boundaries, 64-bit hashes and rolling window hashes.

Hashing runs over all bytes of many texts at once. A word's hash is the difference of two prefix sums of
``(byte + SALT) * R**position``, shifted back by ``R**-start``; a window's hash is the same over word hashes.
Work goes through blocks of about BLOCK bytes cut at white space, so memory is bounded by a block (or by one
word, if that is longer) plus eight bytes for each word.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1 << 17
_SALT = np.uint64(0xD6E8FEB86659FD93)
_R = np.uint64(0x9E3779B97F4A7C15)
_R_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        out = np.full(size, base, np.uint64)
        out[0] = 1
        have = np.cumprod(out, dtype=np.uint64)
        if size <= 1 << 20:
            _powers[int(base)] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def blank(data: np.ndarray) -> np.ndarray:
    """Which bytes are one of the six ASCII blanks."""
    return ((data - np.uint8(9)) <= np.uint8(4)) | (data == np.uint8(32))


def _hash_block(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words of one block."""
    solid = np.zeros(len(data) + 2, bool)
    np.logical_not(blank(data), out=solid[1:-1])
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    starts, ends = edges[::2], edges[1::2]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data + _SALT) * powers(_R, len(data)), out=sums[1:])
    h = (sums[ends] - sums[starts]) * powers(_R_INV, len(data) + 1)[starts]
    return mix(h + (ends - starts).astype(np.uint64)), starts, ends


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All words' hashes in order, and each text's first word (one entry more than texts)."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    bounds = np.concatenate(([0], np.cumsum(lengths)))
    hashes, places, at = [], [], 0
    while at < len(data):
        to = min(len(data), at + BLOCK)
        while to < len(data) and not blank(data[to - 1 : to])[0]:
            ahead = np.flatnonzero(blank(data[to : to + BLOCK]))
            to = to + int(ahead[0]) + 1 if len(ahead) else min(len(data), to + BLOCK)
        h, starts, _ = _hash_block(data[at:to])
        hashes.append(h)
        places.append(starts + at)
        at = to
    place = np.concatenate(places) if places else np.zeros(0, np.int64)
    out = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    return out, np.searchsorted(place, bounds)


def window_hashes(words: np.ndarray, first: np.ndarray, width: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window of `width` words inside one text; the windows of text t are out[to[t]:to[t+1]]."""
    base = int(mix(np.array([seed * 2 + 1], np.uint64))[0]) | 1
    n = np.maximum(np.diff(first) - width + 1, 0)
    to = np.concatenate(([0], np.cumsum(n)))
    if not to[-1]:
        return np.zeros(0, np.uint64), to
    out = np.empty(to[-1], np.uint64)
    inverse = pow(base, -1, 2**64)
    step, t = 1 << 15, 0
    while t < len(n):
        last = max(t + 1, int(np.searchsorted(first, first[t] + step, "right")) - 1)
        a, b = int(first[t]), int(first[last])
        for lo in range(a, b, step):  # a text longer than a block goes in overlapping pieces
            hi = min(b, lo + step)
            piece = words[lo : min(b, hi + width - 1)]
            if len(piece) < width:
                continue
            sums = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum(piece * powers(base, len(piece)), out=sums[1:])
            m = len(piece) - width + 1
            h = mix((sums[width:] - sums[:-width]) * powers(inverse, m))
            starts = lo + np.arange(m)
            owner = np.searchsorted(first, starts, "right") - 1
            ok = starts + width <= first[owner + 1]
            out[(to[owner] + starts - first[owner])[ok]] = h[ok]
        t = last
    return out, to


def shingles(texts: list[bytes], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Window hashes; a text of fewer words (but one at least) has its whole sequence as its one shingle."""
    words, first = word_hashes(texts)
    h, to = window_hashes(words, first, width)
    n = np.diff(first)
    short = np.flatnonzero((n > 0) & (n < width))
    if not len(short):
        return h, to
    counts = np.diff(to)
    counts[short] = 1
    bounds = np.concatenate(([0], np.cumsum(counts)))
    out = np.empty(bounds[-1], np.uint64)
    single = np.zeros(len(out), bool)
    single[bounds[short]] = True
    out[~single] = h
    for t in short:
        w = words[first[t] : first[t + 1]]
        out[bounds[t]] = mix(np.array([int(np.sum(w * powers(_R, len(w)), dtype=np.uint64)) ^ len(w)], np.uint64))[0]
    return out, bounds


def texts_of(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null is empty."""
    import pyarrow as pa

    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def slices(texts: list[bytes], most: int = 4 << 20):
    """Ranges of texts with about `most` bytes together, one text at least."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)
