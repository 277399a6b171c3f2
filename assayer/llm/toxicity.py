"""Toxicity scores from a factorization machine over hashed terms, trained here in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.store import bounded_batches
from assayer.llm.words import mix, powers, slices, texts_of

#: Terms are words and word beginnings, hashed to 2**HASH_BITS places.
HASH_BITS = 20
BEGINNINGS = (4, 5, 6)
#: Labelled rows of either label that a fit looks at, at most.
SAMPLE_PER_LABEL = 8000
FACTORS, EPOCHS, BATCH = 4, 20, 64
#: Terms of a text beyond which it moves each of their factors less.
CALM = 128
#: Rows of the sample in which a term must occur, and standard deviations of its tie to the label at which it begins with half its log odds' weight.
LEAST_ROWS, TELLING = 3, 4.0
_R = 0x9E3779B97F4A7C15
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(texts: list[bytes], active: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed terms of each text (only the active places, if given); text t has out[to[t]:to[t+1]].

    A-Z are lower-cased; words are runs of letters and bytes beyond ASCII. Case aside, repeats do not count.
    """
    found, sizes = [], []
    for lo, hi in slices(texts, 1 << 18):
        data = np.frombuffer((b" ".join(texts[lo:hi]) + b" ").translate(_LOWER), np.uint8)
        bounds = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts[lo:hi]])))
        solid = np.zeros(len(data) + 2, bool)
        solid[1:-1] = data != 32
        edges = np.flatnonzero(solid[1:] != solid[:-1])
        starts, ends = edges[::2], edges[1::2]
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data + np.uint64(0xD6E8FEB86659FD93)) * powers(_R, len(data)), out=sums[1:])
        back = powers(pow(_R, -1, 2**64), len(data) + 1)[starts]
        owner = np.searchsorted(bounds, starts, "right") - 1
        keys = []
        for kind, reach in enumerate((None, *BEGINNINGS)):
            pick = slice(None) if reach is None else ends - starts >= reach
            stop = ends if reach is None else starts[pick] + reach
            h = mix((sums[stop] - sums[starts[pick]]) * back[pick] + np.uint64(kind)) >> np.uint64(64 - HASH_BITS)
            who = owner[pick]
            if active is not None:
                use = active[h]
                h, who = h[use], who[use]
            keys.append((who.astype(np.uint64) << np.uint64(HASH_BITS)) | h)
        key = np.unique(np.concatenate(keys))
        found.append((key & np.uint64((1 << HASH_BITS) - 1)).astype(np.int32))
        sizes.append(np.bincount((key >> np.uint64(HASH_BITS)).astype(np.int64), minlength=hi - lo))
    to = np.concatenate(([0], np.cumsum(np.concatenate(sizes)))) if sizes else np.zeros(1, np.int64)
    return (np.concatenate(found) if found else np.zeros(0, np.int32)), to


def _sums(x: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Sums of x over each text's terms, 0 for a text without any."""
    out = np.zeros((len(to) - 1, *x.shape[1:]), np.float64)
    some = np.flatnonzero(np.diff(to))
    if len(some):
        out[some] = np.add.reduceat(x, to[some], axis=0)
    return out


@dataclass
class Machine:
    """bias + sum of weights + sum over pairs of terms of the inner product of their factors, through a logistic curve."""

    bias: float
    weight: np.ndarray
    factor: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def __post_init__(self) -> None:
        self.active = (self.weight != 0) | (self.factor != 0).any(axis=1)

    def margin(self, ids: np.ndarray, to: np.ndarray) -> np.ndarray:
        v = self.factor[ids]
        s = _sums(v, to)
        return self.bias + _sums(self.weight[ids], to) + 0.5 * ((s * s).sum(axis=1) - _sums((v * v).sum(axis=1), to))

    def score(self, texts: list[bytes]) -> np.ndarray:
        ids, to = terms(texts, self.active)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(ids, to) + self.shift, -30, 30)))


def _start(ids: np.ndarray, to: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which terms a fit uses, whatever their tie to the label, and weights to begin with: half the log odds, drawn to zero
    as far as chance explains them."""
    size = 1 << HASH_BITS
    n, hit = np.bincount(ids, minlength=size), np.bincount(ids, np.repeat(y, np.diff(to)), minlength=size)
    share, total = y.mean(), y.sum()
    z = (hit - n * share) / np.sqrt(np.maximum(n, 1) * share * (1 - share))
    odds = np.log((hit + 0.5) / (total + 1)) - np.log((n - hit + 0.5) / (len(y) - total + 1))
    use = n >= LEAST_ROWS
    return use, np.where(use, odds / 2 * z**4 / (z**4 + TELLING**4), 0.0)


def _distinct(x: np.ndarray, seen: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.unique(x, return_inverse=True) without a sort; `seen` and `rank` are scratch space, seen all false."""
    seen[x] = True
    u = np.flatnonzero(seen)
    rank[u] = np.arange(len(u))
    seen[u] = False
    return u, rank[x]


def fit_machine(ids: np.ndarray, to: np.ndarray, y: np.ndarray, positive_share: float, seed: int = 0) -> Machine:
    """Adaptive gradient descent on the logistic loss, weights and factors drawn to zero by lasso steps, then a calibration.

    All terms of LEAST_ROWS rows have a weight and factors of their own: a term without a tie to the label by itself can
    still have one beside another. A fifth of the texts is held back to choose the
    epoch and to place the curve's slope and shift, with the share of label 1 brought back to `positive_share`.
    """
    rng = np.random.Generator(np.random.PCG64(seed))
    size = 1 << HASH_BITS
    if not len(y) or y.min() == y.max():
        p = np.clip(y.mean() if len(y) else positive_share, 1e-3, 1 - 1e-3)
        return Machine(float(np.log(p / (1 - p))), np.zeros(size, np.float32), np.zeros((size, FACTORS), np.float32))
    common, w = _start(ids, to, y)
    v = rng.normal(0, 0.02, (size, FACTORS)) * common[:, None]
    gw, gv, b, gb = np.full(size, 1e-2), np.full((size, FACTORS), 1e-2), 0.0, 1e-2
    held = rng.random(len(y)) < 0.2 if len(y) >= 200 else np.zeros(len(y), bool)
    train = np.flatnonzero(~held)
    seen, rank = np.zeros(size, bool), np.zeros(size, np.int64)
    rate, lasso, decay, group = 0.1, 3e-3, 1e-3, 2e-3
    back = np.flatnonzero(held) if held.any() and len(set(y[held])) == 2 else train
    part = [ids[to[r] : to[r + 1]] for r in back]
    judged, bounds = np.concatenate(part), np.concatenate(([0], np.cumsum([len(p) for p in part])))
    best, fitted, since = np.inf, None, 0
    for epoch in range(EPOCHS):
        order = rng.permutation(train)
        for lo in range(0, len(order), BATCH):
            rows = order[lo : lo + BATCH]
            part = [ids[to[r] : to[r + 1]] for r in rows]
            part = [p[common[p]] for p in part]
            at = np.concatenate(([0], np.cumsum([len(p) for p in part])))
            x = np.concatenate(part)
            who = np.repeat(np.arange(len(rows)), np.diff(at))
            f = v[x]
            s = _sums(f, at)
            m = b + _sums(w[x], at) + 0.5 * ((s * s).sum(axis=1) - _sums((f * f).sum(axis=1), at))
            err = 1 / (1 + np.exp(-np.clip(m, -30, 30))) - y[rows]
            u, place = _distinct(x, seen, rank)
            e = err[who] / len(rows)
            g = np.bincount(place, e, len(u))
            gw[u] += g * g
            step = rate / np.sqrt(gw[u])
            new = w[u] - step * g
            w[u] = np.sign(new) * np.maximum(np.abs(new) - step * lasso, 0)
            # a text of many terms moves all their factors the same way, so each of them less
            d = (e * np.minimum(1, CALM / np.maximum(np.diff(at), 1))[who])[:, None] * (s[who] - f)
            gr = np.stack([np.bincount(place, d[:, k], len(u)) for k in range(FACTORS)], axis=1) + decay * v[u]
            gv[u] += gr * gr
            new = v[u] - rate / 2 / np.sqrt(gv[u]) * gr
            norm = np.sqrt((new * new).sum(axis=1, keepdims=True))
            v[u] = new * np.maximum(1 - rate / 2 / np.sqrt(gv[u].mean(axis=1, keepdims=True)) * group / np.maximum(norm, 1e-12), 0)
            gb += err.mean() ** 2
            b -= rate / np.sqrt(gb) * err.mean()
        now = Machine(float(b), w.astype(np.float32), v.astype(np.float32))
        m = now.margin(judged, bounds)
        loss = np.logaddexp(0, np.where(y[back] == 1, -m, m)).mean()
        since = 0 if loss < best - 1e-4 else since + 1
        if fitted is None or loss < best:
            best, fitted = loss, now
        if epoch >= 7 and since >= 4:
            break
    m = fitted.margin(judged, bounds)
    t, share = y[back], np.clip(positive_share, 1e-4, 1 - 1e-4)
    weight = np.where(t == 1, share / max(t.mean(), 1e-9), (1 - share) / max(1 - t.mean(), 1e-9))
    slope, shift = 1.0, 0.0
    for _ in range(50):  # damped Newton steps on two numbers
        p = 1 / (1 + np.exp(-np.clip(slope * m + shift, -30, 30)))
        r, q = weight * (p - t), weight * np.maximum(p * (1 - p), 1e-6)
        grad = np.array([(r * m).sum() + 1e-2 * (slope - 1), r.sum()])
        hess = np.array([[(q * m * m).sum() + 1e-2, (q * m).sum()], [(q * m).sum(), q.sum() + 1e-9]])
        move = np.clip(np.linalg.solve(hess, grad), -0.5, 0.5)
        slope, shift = slope - move[0], shift - move[1]
    fitted.slope, fitted.shift = float(max(slope, 0.05)), float(shift)
    return fitted


def fit(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text: str = "text", label: str = "toxic", per_label: int = SAMPLE_PER_LABEL) -> Machine:
    """Fit on at most `per_label` labelled rows of either label: those of smallest hash, among ids where `usable` holds.

    `usable` is a condition on the id column. A document labelled more than once counts as toxic if any label says so;
    null ids and null labels are left out. The chosen ids and their texts' terms, both bounded, go to the driver.
    """
    bounded_batches(docs.sparkSession)
    own = labels.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{label}`").cast("int").alias("y")).where(usable & F.col("y").isNotNull() & F.col(id_col).isNotNull())
    own = own.groupBy(id_col).agg(F.max("y").alias("y"))
    shares = own.agg(F.avg("y"), F.count("*")).first()
    chosen = [own.where(F.col("y") == k).orderBy(F.xxhash64(F.lit("fit"), id_col), id_col).limit(per_label) for k in (0, 1)]
    picked = chosen[0].unionByName(chosen[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, to = terms(texts_of(b.column(2)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([ids[a:z].tobytes() for a, z in zip(to[:-1], to[1:], strict=True)], pa.binary())], ["id", "y", "terms"])

    kind = docs.schema[id_col].dataType.simpleString()
    text_rows = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text}`").alias("text"))
    found = text_rows.join(F.broadcast(picked), id_col).select(id_col, "y", "text").mapInArrow(run, f"id {kind}, y int, terms binary").toArrow()
    order = np.argsort(np.array([hash((i, t)) for i, t in zip(found.column("id").to_pylist(), [len(x) for x in found.column("terms").to_pylist()], strict=True)], np.int64), kind="stable")
    parts = [np.frombuffer(x, np.int32) for x in found.column("terms").to_pylist()]
    parts = [parts[i] for i in order]
    y = found.column("y").to_numpy().astype(np.float64)[order]
    to = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)
    ids = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    del found, parts  # the driver holds the terms once while it fits
    return fit_machine(ids, to, y, float(shares[0] or 0.0))


def score(docs: DataFrame, machine: Machine, text: str = "text", name: str = "score") -> DataFrame:
    """All columns of docs and the machine's score of the whole text, 0 to 1. Null text counts as empty.

    The model that goes to the tasks holds only the terms with a weight or a factor.
    """
    bounded_batches(docs.sparkSession)
    places = np.flatnonzero(machine.active)
    sent = docs.sparkSession.sparkContext.broadcast((machine.bias, places, machine.weight[places], machine.factor[places], machine.slope, machine.shift))
    made: list[Machine] = []

    def run(texts: pa.Array) -> pa.Array:
        if not made:
            bias, at, w, v, slope, shift = sent.value
            weight, factor = np.zeros(1 << HASH_BITS, np.float32), np.zeros((1 << HASH_BITS, FACTORS), np.float32)
            weight[at], factor[at] = w, v
            made.append(Machine(bias, weight, factor, slope, shift))
        return pa.array(made[0].score(texts_of(texts)), pa.float64())

    return docs.withColumn(name, F.arrow_udf(run, "double")(F.col(f"`{text}`")))
