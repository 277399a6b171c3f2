"""Periodic runs in word sequences: branching tandem repeats on an enhanced suffix array.

The suffixes of many documents are sorted together by prefix doubling; each document ends in a symbol of its own, so no
common prefix crosses a border. An interval of suffixes with `depth` common words is found from the nearest smaller
common prefixes on both sides, without a tree. A square of root length `depth` that its right neighbour does not
continue has its two halves in different children of that interval. So the suffixes of all children but the largest ask
whether the suffix `depth` words on, or back, lies in the interval too: n log n questions at most. Each hit is the
rightmost square of one run; it is rotated to the left as far as the words agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.store import bounded_batches
from assayer.llm.words import slices

#: A run has at least so many words and repeats its period so often.
LEAST_LENGTH, LEAST_EXPONENT = 6, 4
#: Bytes of text sorted together, and questions asked at a time.
SLICE, QUESTIONS = 1 << 19, 1 << 20


def _heads(key: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted keys: the first slot of each one's group, and whether the group has more than one member."""
    new = np.ones(len(key) + 1, bool)
    np.not_equal(key[1:], key[:-1], out=new[1:-1])
    heads = slots[np.maximum.accumulate(np.where(new[:-1], np.arange(len(key)), 0))]
    return heads, ~(new[:-1] & new[1:])


def suffix_array(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sa, isa, lcp): sorted suffixes, their places, and the words that lcp[k] has in common with the suffix before.

    Each document must end in a symbol that occurs nowhere else. lcp has -1 at both ends.
    """
    n = len(symbols)
    sa = np.argsort(symbols, kind="stable")
    rank, slots = np.empty(n, np.int64), np.arange(n)
    heads, open_ = _heads(symbols[sa], slots)
    rank[sa] = heads
    levels, step = [rank], 1
    slots = slots[open_]
    while len(slots):
        at = sa[slots]
        key = rank[at] * n + rank[at + step]
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        sa[slots] = at
        heads, open_ = _heads(key, slots)
        rank = rank.copy()
        rank[at] = heads
        levels.append(rank)
        slots, step = slots[open_], step * 2
    lcp = np.zeros(n + 1, np.int64)
    lcp[0] = lcp[n] = -1
    for k in range(len(levels) - 2, -1, -1):
        pair = 1 + np.flatnonzero(levels[k][sa[1:]] == levels[k][sa[:-1]])
        x, y = sa[pair - 1] + lcp[pair], sa[pair] + lcp[pair]
        more = levels[k][x] == levels[k][y]
        lcp[pair[more]] += 1 << k
    return sa, levels[-1], lcp


def _smaller(lcp: np.ndarray, at: np.ndarray, step: int) -> np.ndarray:
    """For each place in `at` the nearest place in direction `step` with a smaller value; pointers jump over pointers."""
    to = np.arange(len(lcp)) + step
    low = at[lcp[to[at]] >= lcp[at]]
    while len(low):
        to[low] = to[to[low]]
        low = low[lcp[to[low]] >= lcp[low]]
    return to


def _small_children(lcp: np.ndarray, deepest: np.ndarray, sizes: int) -> tuple[np.ndarray, ...]:
    """(from, to, left, right, depth): all children but one largest of each interval of at least `sizes` suffixes.

    The child is from..to, its interval left..right, ends included. `deepest` bounds the depths of interest by place.
    """
    inner = np.flatnonzero(lcp > 0)
    left, right = _smaller(lcp, inner, -1), _smaller(lcp, inner, 1)
    k = inner[(lcp[inner] <= deepest[inner]) & (right[inner] - left[inner] >= sizes)]
    k = k[np.argsort(left[k] * len(lcp) + right[k], kind="stable")]
    if not len(k):
        return (np.zeros(0, np.int64),) * 5
    first = np.flatnonzero(np.concatenate(([True], (left[k[1:]] != left[k[:-1]]) | (right[k[1:]] != right[k[:-1]]))))
    last = np.concatenate((first[1:], [len(k)])) - 1
    stop = np.concatenate((k[1:], [0]))
    stop[last] = right[k[last]]
    start = np.insert(k, first, left[k[first]])
    stop = np.insert(stop, first, k[first])
    of = np.insert(k, first, k[first])
    group = first + np.arange(len(first))
    size = stop - start
    largest = np.repeat(np.maximum.reduceat(size, group), np.diff(np.concatenate((group, [len(size)]))))
    tie = np.flatnonzero(size == largest)
    which = np.repeat(np.arange(len(group)), np.diff(np.concatenate((group, [len(size)]))))
    drop = tie[np.unique(which[tie], return_index=True)[1]]
    small = np.ones(len(size), bool)
    small[drop] = False
    return start[small], stop[small] - 1, left[of][small], right[of][small] - 1, lcp[of][small]


def _rotate(symbols: np.ndarray, at: np.ndarray, period: np.ndarray) -> np.ndarray:
    """How far each place can move to the left while the word there equals the one a period later."""
    at, live, width = at.copy(), np.arange(len(at)), 16
    while len(live):
        moved = np.zeros(len(live), np.int64)
        rows = max(1, QUESTIONS // width)
        for lo in range(0, len(live), rows):
            part = live[lo : lo + rows]
            back = at[part, None] - 1 - np.arange(width)
            same = (symbols[back.clip(0)] == symbols[back.clip(0) + period[part, None]]) & (back >= 0)
            moved[lo : lo + rows] = np.where(same.all(axis=1), width, same.argmin(axis=1))
        at[live] -= moved
        live, width = live[moved == width], min(4 * width, 1 << 14)
    return at


def find_runs(symbols: np.ndarray, deepest: np.ndarray, least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs, by start and period. deepest[i]: the longest period of interest where symbol i stands."""
    sa, isa, lcp = suffix_array(symbols)
    start, stop, left, right, depth = _small_children(lcp, np.append(deepest[sa], 0), least_exponent)
    size = stop - start + 1
    ends = np.cumsum(size)
    ats, periods = [], []
    lo = 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + QUESTIONS, "right")))
        child = np.repeat(np.arange(lo, hi), size[lo:hi])
        p = sa[start[child] + np.arange(len(child)) - np.repeat(ends[lo:hi] - size[lo:hi] - (ends[lo - 1] if lo else 0), size[lo:hi])]
        d = depth[child]
        for other, square in ((p + d, p), (p - d, p - d)):
            there = isa[other.clip(0)]
            hit = (other >= 0) & (there >= left[child]) & (there <= right[child]) & ((there < start[child]) | (there > stop[child]))
            e, c = square[hit], child[hit]
            for back in range(1, least_exponent - 1):  # the same root must stand before the square as often
                before = e - back * depth[c]
                there = isa[before.clip(0)]
                ok = (before >= 0) & (there >= left[c]) & (there <= right[c])
                e, c = e[ok], c[ok]
            ats.append(e), periods.append(depth[c])
        lo = hi
    at = np.concatenate(ats) if ats else np.zeros(0, np.int64)
    period = np.concatenate(periods) if periods else np.zeros(0, np.int64)
    end = at + 2 * period
    begin = _rotate(symbols, at - (least_exponent - 2) * period, period)
    order = np.lexsort((period, end, begin))
    begin, end, period = begin[order], end[order], period[order]
    new = np.ones(len(begin), bool)
    new[1:] = (begin[1:] != begin[:-1]) | (end[1:] != end[:-1])  # of equal stretches the smallest period is the run's
    new &= end - begin >= np.maximum(least_length, least_exponent * period)
    begin, end, period = begin[new], end[new], period[new]
    order = np.lexsort((period, begin))
    return begin[order], (end - begin)[order], period[order]


def _symbols(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word, equal for equal words of one text only; each text ends in one of its own. And the word counts."""
    cut = pc.ascii_split_whitespace(pa.array(texts, pa.binary()).cast(pa.large_string()))
    words = cut.values
    full = pc.greater(pc.binary_length(words), 0)
    owner = np.repeat(np.arange(len(texts)), np.diff(cut.offsets.to_numpy()))[full.to_numpy(zero_copy_only=False)]
    code = words.filter(full).dictionary_encode().indices.to_numpy().astype(np.int64)
    counts = np.bincount(owner, minlength=len(texts))
    out = np.empty(len(code) + len(texts), np.int64)
    ends = np.cumsum(counts + 1) - 1
    inner = np.ones(len(out), bool)
    inner[ends] = False
    span = int(code.max()) + 2 if len(code) else 1
    out[inner] = owner * span + code + 1
    out[ends] = np.arange(len(texts)) * span
    return out, counts


def collapse(texts: list[bytes], least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> Iterator[tuple[int, list[tuple[int, int, int]], bytes]]:
    """For each text its number of words, its runs, and what is left joined by one blank.

    A word goes if any run has it after that run's first period.
    """
    symbols, counts = _symbols(texts)
    owner = np.repeat(np.arange(len(texts)), counts + 1)
    start, length, period = find_runs(symbols, counts[owner] // least_exponent, least_length, least_exponent)
    first = np.concatenate(([0], np.cumsum(counts + 1)))
    of = np.searchsorted(first, start, "right") - 1
    edge = np.zeros(len(symbols) + 1, np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, start + length, -1)
    stays = np.cumsum(edge)[:-1] == 0
    bounds = np.searchsorted(of, np.arange(len(texts) + 1))
    for t, text in enumerate(texts):
        words, a, z = text.split(), bounds[t], bounds[t + 1]
        runs = list(zip((start[a:z] - first[t]).tolist(), length[a:z].tolist(), period[a:z].tolist(), strict=True))
        if runs:
            words = [w for w, s in zip(words, stays[first[t] : first[t] + counts[t]].tolist(), strict=True) if s]
        yield int(counts[t]), runs, b" ".join(words)


RUN = "struct<start:long,length:long,period:long>"


def collapse_runs(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> DataFrame:
    """(doc_id, n_words, runs, text): every run of every whole text, and the words that are left, joined by one blank.

    Words are runs of characters other than the six ASCII blanks. A run is a longest stretch whose words repeat with its
    smallest period, of at least `least_length` words and `least_exponent` periods (2 or more); runs come by start, then
    period. A word goes if any run has it after that run's first period.

    One row for each row, ids unchanged (null and repeated ones too); null text counts as empty: no words, no runs, an
    empty text. Other columns, whatever their names, are left out. An empty table gives an empty one. No shuffle: a text
    is one task's work, in memory of about 200 bytes for each of its words.
    """
    if least_exponent < 2:
        raise ValueError("a run repeats its period at least twice")
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [x or b"" for x in b.column(1).cast(pa.large_binary()).to_pylist()]
            for lo, hi in slices(texts, SLICE):
                found = list(collapse(texts[lo:hi], least_length, least_exponent))
                runs = [[{"start": s, "length": n, "period": q} for s, n, q in r] for _, r, _ in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(lo, hi - lo),
                        pa.array([n for n, _, _ in found], pa.int64()),
                        pa.array(runs, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))),
                        pa.array([t for _, _, t in found], pa.binary()).cast(pa.string()),
                    ],
                    ["doc_id", "n_words", "runs", "text"],
                )

    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text"))
    return src.mapInArrow(run, f"doc_id {kind}, n_words long, runs array<{RUN}>, text string")
