"""Language identification: averaged hashed subword embeddings under a linear softmax, trained here in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm.store import bounded_batches
from assayer.llm.words import slices, texts_of

#: Subwords are runs of 2, 3 and 4 bytes (blanks included, A-Z lower-cased), hashed to 2**HASH_BITS embeddings.
SIZES, HASH_BITS, DIM = (2, 3, 4), 15, 16
#: Rows of a language, and rows in all, that a fit looks at, at most.
SAMPLE_PER_LANGUAGE, SAMPLE = 1200, 6000
EPOCHS, BATCH = 5, 32
UNKNOWN = "und"
_LOWER = bytes(b + 32 if 65 <= b <= 90 else 32 if b in (9, 10, 11, 12, 13) else b for b in range(256))
_MULTIPLIERS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def subwords(data: np.ndarray) -> list[np.ndarray]:
    """Embedding numbers of the runs that start at each byte, for each size; the last bytes start shorter runs only."""
    code = data.astype(np.uint32)
    out = []
    for n in range(2, max(SIZES) + 1):
        code = code[: len(code) - 1] | (data[n - 1 :].astype(np.uint32) << np.uint32(8 * (n - 1))) if len(code) > 1 else code[:0]
        if n in SIZES:
            out.append((code * _MULTIPLIERS[SIZES.index(n)]) >> np.uint32(32 - HASH_BITS))
    return out


def counts(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct subwords of a text and how often each occurs."""
    runs = np.concatenate(subwords(np.frombuffer(b" " + text.translate(_LOWER) + b" ", np.uint8)))
    all_counts = np.bincount(runs, minlength=1 << HASH_BITS)
    ids = np.flatnonzero(all_counts)
    return ids.astype(np.uint16), np.minimum(all_counts[ids], 65535).astype(np.uint16)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class Model:
    """Languages, one row of class scores for each subword (embedding times softmax weights), bias, calibration."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    warmth: float = 1.0
    floor: float = 0.0

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        """Mean class scores over all subwords of each text, through a softmax at the calibrated temperature."""
        out = np.zeros((len(texts), len(self.languages)))
        for lo, hi in slices(texts, 1 << 18):
            data = np.frombuffer(b"".join([b" " + t + b" " for t in texts[lo:hi]]).translate(_LOWER), np.uint8)
            edge = np.concatenate(([0], np.cumsum([len(t) + 2 for t in texts[lo:hi]])))
            total = np.zeros((hi - lo, len(self.languages)))
            number = np.zeros(hi - lo)
            for n, runs in zip(SIZES, subwords(data), strict=True):
                got = np.zeros((len(data) + 1, len(self.languages)), np.float32)
                got[: len(runs)] = self.table[runs]
                for k in range(1, n):  # runs across two texts
                    got[edge[1:] - k] = 0
                total += np.add.reduceat(got[:-1], edge[:-1], axis=0)
                number += np.maximum(edge[1:] - edge[:-1] - n + 1, 0)
            out[lo:hi] = total / np.maximum(number, 1)[:, None]
        return _softmax((out + self.bias) * self.warmth)


def fit_model(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, languages: list[str], seed: int = 0) -> Model:
    """Stochastic gradient descent on the cross entropy; a fifth is held back for temperature and rejection floor.

    The floor is the smallest confidence above which the held-back texts are right in 98 of 100 cases.
    """
    rng = np.random.Generator(np.random.PCG64(seed))
    size, classes = 1 << HASH_BITS, max(len(languages), 1)
    emb, w, b = rng.normal(0, 0.1, (size, DIM)), rng.normal(0, 0.3, (DIM, classes)), np.zeros(classes)
    if len(languages) < 2:
        return Model(languages or [UNKNOWN], np.zeros((size, classes), np.float32), b)
    held = rng.random(len(y)) < 0.2 if len(y) >= 100 else np.zeros(len(y), bool)
    train = np.flatnonzero(~held)
    acc_e, acc_w, acc_b = np.full(size, 1e-6), np.full(w.shape, 1e-6), np.full(classes, 1e-6)
    for _ in range(EPOCHS if len(y) >= 100 else 40):
        order = rng.permutation(train)
        for lo in range(0, len(order), BATCH):
            part = order[lo : lo + BATCH]
            x = np.concatenate([rows[i][0] for i in part]).astype(np.int64)
            c = np.concatenate([rows[i][1] / rows[i][1].sum(dtype=np.float64) for i in part])
            at = np.concatenate(([0], np.cumsum([len(rows[i][0]) for i in part])))
            who = np.repeat(np.arange(len(part)), np.diff(at))
            mean = np.add.reduceat(emb[x] * c[:, None], at[:-1], axis=0)
            p = _softmax(mean @ w + b)
            p[np.arange(len(part)), y[part]] -= 1
            p /= len(part)
            back = p @ w.T
            g = mean.T @ p
            acc_w += g * g
            acc_b += p.sum(axis=0) ** 2
            u, place = np.unique(x, return_inverse=True)
            grad = np.stack([np.bincount(place, c * back[who, k], len(u)) for k in range(DIM)], axis=1)
            acc_e[u] += (grad * grad).mean(axis=1)
            emb[u] -= 0.1 * grad / np.sqrt(acc_e[u])[:, None]
            w -= 0.1 * g / np.sqrt(acc_w)
            b -= 0.05 * p.sum(axis=0) / np.sqrt(acc_b)
    model = Model(languages, (emb @ w).astype(np.float32), b)
    check = np.flatnonzero(held) if held.any() else train
    z = np.stack([(model.table[rows[i][0]] * (rows[i][1] / rows[i][1].sum(dtype=np.float64))[:, None]).sum(axis=0) for i in check]) + b
    loss = {t: -np.log(np.maximum(_softmax(z * t)[np.arange(len(check)), y[check]], 1e-12)).mean() for t in np.geomspace(0.1, 30, 60)}
    model.warmth = float(min(loss, key=loss.get))
    p = _softmax(z * model.warmth)
    top, right = p.max(axis=1), p.argmax(axis=1) == y[check]
    order = np.argsort(-top)
    precision = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(precision >= 0.98)
    model.floor = float(top[order[good[-1]]]) if len(good) else 1.0
    return model


def fit(docs: DataFrame, usable: Column, text: str = "text", lang: str = "lang", id_col: str = "doc_id", per_language: int = SAMPLE_PER_LANGUAGE, most: int = SAMPLE) -> Model:
    """Fit on `per_language` rows of each language and at most `most` rows in all, chosen by a hash of the id.

    `usable` is a condition on the table's columns. Rows with null text, language or id are left out. Where there are so
    many languages that their shares would not fit, each gets an equal share of `most`; a language with fewer rows keeps
    them all. `most` languages at most can have a row, the commonest. Their counts and the chosen rows' subword counts, both bounded, go to the driver.
    """
    bounded_batches(docs.sparkSession)
    own = docs.where(usable & F.col(f"`{lang}`").isNotNull() & F.col(f"`{text}`").isNotNull() & F.col(f"`{id_col}`").isNotNull())
    own = own.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text"))
    found = {r["lang"]: r["count"] for r in own.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most).collect()}
    if not found:
        return fit_model([], np.zeros(0, np.int64), [])
    share = max(1, min(per_language, most // len(found)))
    ample = share + 6 * share**0.5 + 12  # so many are drawn that `share` of them are there
    rate = F.create_map(*[F.lit(x) for k, n in found.items() for x in (k, min(1.0, ample / n))])
    draw = F.pmod(F.xxhash64(F.lit("lang"), "id"), F.lit(1 << 30)) / F.lit(float(1 << 30))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [counts(t) for t in texts_of(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([e[k].tobytes() for e in each], pa.binary()) for k in (0, 1))], ["id", "lang", "ids", "n"])

    kind = docs.schema[id_col].dataType.simpleString()
    picked = own.where(draw < rate[F.col("lang")]).mapInArrow(run, f"id {kind}, lang string, ids binary, n binary")
    order = [F.xxhash64(F.lit("lang"), "id"), "id", "lang", "ids"]
    # a language is a group of about `ample` rows here
    ranked = picked.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    got = ranked.where(F.col("r") <= share).drop("r").orderBy(*order).toArrow()
    languages = sorted(set(got.column("lang").to_pylist()))
    y = np.array([languages.index(x) for x in got.column("lang").to_pylist()], np.int64)
    rows = [(np.frombuffer(a, np.uint16), np.frombuffer(b, np.uint16)) for a, b in zip(got.column("ids").to_pylist(), got.column("n").to_pylist(), strict=True)]
    return fit_model(rows, y, languages)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of docs, and lang_pred, lang_score and lang_accepted.

    lang_pred is the likeliest language of the whole text, or `und` where the text is null or has no letter;
    lang_score its calibrated probability (0 for `und`); lang_accepted whether that reaches the model's floor. Columns of
    docs with one of these three names are replaced; any other name may occur.
    """
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: pa.Array) -> pa.Array:
        p = sent.value.probabilities(texts_of(texts))
        best = p.argmax(axis=1) if len(p) else np.zeros(0, np.int64)
        return pa.StructArray.from_arrays([pa.array([sent.value.languages[k] for k in best], pa.string()), pa.array(p.max(axis=1) if len(p) else [], pa.float64())], ["lang", "p"])

    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.arrow_udf(run, "lang string, p double")(F.col(f"`{text}`")).alias("guess"))
    known = F.coalesce(F.col(f"row.`{text}`").rlike(r"\p{L}"), F.lit(False))
    kept = [c for c in docs.columns if c not in ("lang_pred", "lang_score", "lang_accepted")]
    return row.select(
        *[F.col(f"row.`{c}`").alias(c) for c in kept],
        F.when(known, F.col("guess.lang")).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(known, F.col("guess.p")).otherwise(0.0).alias("lang_score"),
        (known & (F.col("guess.p") >= model.floor)).alias("lang_accepted"),
    )
