"""MinHash document fingerprints: universal hash permutations, band join, verified Jaccard."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from assayer.llm.graph import components, local_roots
from assayer.llm.store import bounded_batches, keep, partitions, rows_of
from assayer.llm.words import shingles, slices, texts_of

#: Hash permutations a * x + b modulo 2**32 (a odd, so each permutes the 32-bit values), and words of a shingle.
PERMUTATIONS, WIDTH = 128, 5
#: 25 bands of 5 rows: two texts of Jaccard 0.8 share a band but for 5 cases in 100,000.
BANDS, ROWS = 25, 5
#: Texts compared in one task; larger buckets are cut into pieces that meet two by two.
TILE = 512
_RNG = np.random.Generator(np.random.PCG64(77))
_A = (_RNG.integers(0, 2**31, PERMUTATIONS, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _RNG.integers(0, 2**32, PERMUTATIONS, dtype=np.uint32)


def signatures(texts: list[bytes], width: int = WIDTH) -> np.ndarray:
    """A row of PERMUTATIONS minima for each text; a text without a word has the largest value in each place."""
    out = np.full((len(texts), PERMUTATIONS), 0xFFFFFFFF, np.uint32)
    for lo, hi in slices(texts, 1 << 19):
        h, to = shingles(texts[lo:hi], width)
        some = np.flatnonzero(np.diff(to))
        if not len(some):
            continue
        x, starts = (h >> np.uint64(32)).astype(np.uint32), to[some]
        part = np.empty((PERMUTATIONS, len(some)), np.uint32)
        v = np.empty_like(x)
        for p in range(PERMUTATIONS):
            np.multiply(x, _A[p], out=v)
            np.add(v, _B[p], out=v)
            np.minimum.reduceat(v, starts, out=part[p])
        out[lo + some] = part.T
    return out


def codes(signature: np.ndarray) -> np.ndarray:
    """The 16 bits of each minimum that a fingerprint keeps."""
    return (signature & np.uint32(0xFFFF)).astype(">u2")


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal places: the estimate of the Jaccard similarity."""
    return (a == b).mean(axis=1)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fingerprint): 128 places of 4 hex digits. Null text counts as empty; equal texts have equal fingerprints."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = codes(signatures(texts_of(b.column(1))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes().hex() for r in c], pa.string())], ["id", "fingerprint"])

    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, fingerprint string")


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's fingerprint against that of an edited text and that of the next document.

    Documents stand in descending id (null ids after all others, equal ids by text), and the first follows the last.
    The edited text is the row's text with its last floor(n / 2) code points replaced by the first as many (or all)
    of the next document. Null text is empty. One row per row; a lone row is its own successor; an empty table gives
    an empty one.

    Rows are dealt to ranges of ids whose upper ends are ids of the table, so the first row of a range is known by its
    id; it goes to the range before it as well. Texts are shuffled once and read as a stream in order, so a task holds
    a batch, not a range.
    """
    bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    rows = rows_of(docs, id_col, text).select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.coalesce("id", F.lit(-(2**63))))
    n = 4 * partitions(spark)
    ends = rows.agg(F.percentile_approx("key", [k / n for k in range(1, n)], 20 * n), F.max("key")).first()
    cuts = np.unique([*(ends[0] or []), *([] if ends[1] is None else [ends[1]])]).astype(np.int64)
    if not len(cuts):
        cuts = np.zeros(1, np.int64)

    @pandas_udf("int")
    def range_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, key.to_numpy()).astype(np.int32))

    @pandas_udf("int")
    def also_of(key: pd.Series) -> pd.Series:
        at = np.searchsorted(cuts, key.to_numpy())
        return pd.Series(np.where(cuts[np.minimum(at, len(cuts) - 1)] == key.to_numpy(), (at + 1) % len(cuts), -1).astype(np.int32))

    places = rows.withColumn("r", range_of("key")).withColumn("also", also_of("key"))
    places = places.select("id", "text", "key", F.explode(F.when(F.col("also") >= 0, F.array(F.struct(F.col("r"), F.lit(0).alias("extra")), F.struct(F.col("also").alias("r"), F.lit(1).alias("extra")))).otherwise(F.array(F.struct(F.col("r"), F.lit(0).alias("extra"))))).alias("p"))
    dealt = places.select("p.r", "p.extra", "key", "id", "text").repartition(partitions(spark), "r").sortWithinPartitions("r", "extra", F.desc("key"), "text").select("r", "extra", "id", "text")

    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row still without its successor: range, extra, id, text, codes
        for batch in batches:
            texts = batch.column(3).to_pylist()
            for lo, hi in slices(texts):
                part = batch.slice(lo, hi - lo)
                own = codes(signatures([t.encode() for t in texts[lo:hi]]))
                r, extra, ids, t = part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), texts[lo:hi]
                if held is not None:
                    r, extra, ids, t = [held[0], *r], [held[1], *extra], [held[2], *ids], [held[3], *t]
                    own = np.concatenate((held[4][None], own))
                at = [i for i in range(len(r) - 1) if not extra[i] and r[i + 1] == r[i]]
                held = (r[-1], extra[-1], ids[-1], t[-1], own[-1])
                if not at:
                    continue
                edited = []
                for i in at:
                    k = len(t[i]) // 2
                    edited.append((t[i][: len(t[i]) - k] + t[i + 1][:k]).encode())
                other = codes(signatures(edited))
                at = np.array(at)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[i] for i in at], pa.int64()),
                        pa.array([len(t[i]) for i in at], pa.int64()),
                        pa.array([hashlib.sha256(e).hexdigest() for e in edited]),
                        pa.array([own[i].tobytes().hex() for i in at]),
                        pa.array([o.tobytes().hex() for o in other]),
                        pa.array(likeness(own[at], other)),
                        pa.array(likeness(own[at], own[at + 1])),
                    ],
                    names,
                )

    schema = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.mapInArrow(run, schema).withColumnRenamed("id", "doc_id")


def _sets(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """Distinct texts: their hash as class, smallest id, rows, band keys and sorted shingle hashes."""
    bounded_batches(docs.sparkSession)
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    firsts = src.groupBy(F.xxhash64("text").alias("class"), "text").agg(F.min("id").alias("least"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = texts_of(b.column(1))
            for lo, hi in slices(texts):
                s = signatures(texts[lo:hi])[:, : BANDS * ROWS]
                h, to = shingles(texts[lo:hi], WIDTH)
                sets = [np.unique(h[a:z]).tobytes() for a, z in zip(to[:-1], to[1:], strict=True)]
                keys = [[int.from_bytes(hashlib.blake2b(bytes([k]) + s[i, k * ROWS : (k + 1) * ROWS].tobytes(), digest_size=8).digest(), "big", signed=True) for k in range(BANDS)] for i in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(2).slice(lo, hi - lo), pa.array(keys, pa.list_(pa.int64())), pa.array(sets, pa.binary())], ["class", "least", "keys", "shingles"])

    return firsts.mapInArrow(run, "class long, least long, keys array<long>, shingles binary")


def _verify(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        ids, sides = table.column("class").to_numpy(), table.column("side").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        root = np.arange(len(ids))
        for i in range(len(ids)):
            for j in range(i + 1, len(ids)):
                a, b = len(sets[i]), len(sets[j])
                if root[i] == root[j] or (sides[i] == sides[j] and sides[i] > 0) or min(a, b) < threshold * max(a, b):
                    continue
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if a + b and both >= threshold * (a + b - both):
                    root = local_roots(root, np.array([i]), np.array([j]))
        moved = np.flatnonzero(root != np.arange(len(ids)))
        return pa.table([pa.array(ids[moved]), pa.array(ids[root[moved]])], names=["a", "b"])

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = 0.8, tile: int = TILE) -> DataFrame:
    """One row per document: (doc_id, class_id), the smallest doc_id reachable over verified links.

    Two texts link if the Jaccard similarity of their five-word shingle sets is at least `threshold`; candidates share
    one of BANDS signature bands. Equal texts are one class before any comparison. Buckets that hold the same texts are
    compared once; a bucket over `tile` is cut into pieces, each pair of which is compared in a task of its own; links
    leave a task as spanning edges. Texts without a word link to each other only (as equal or as empty sets never do).
    A row with null id gets the class of its text's group. Null text counts as empty. Repeated rows all stay.
    """
    sets = keep(_sets(docs, id_col, text), "sets")
    member = sets.select("class", F.explode("keys").alias("key"))
    buckets = member.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.xxhash64("class").cast("decimal(20,0)")).alias("who")).where("n > 1")
    buckets = buckets.groupBy("n", "who").agg(F.min("key").alias("key")).withColumn("pieces", F.when(F.col("n") > tile, F.ceil(F.col("n") * 2 / tile)).otherwise(1).cast("int"))
    dealt = member.join(buckets.select("key", "pieces"), "key").withColumn("mine", F.expr("cast(pmod(xxhash64(class, 3), pieces) as int)"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    lo, hi = F.least("mine", "other"), F.greatest("mine", "other")
    dealt = dealt.select(F.xxhash64("key", lo, hi).alias("tile"), "class", F.when(lo == hi, 0).when(F.col("mine") == lo, 1).otherwise(2).alias("side"))
    edges = dealt.join(sets.select("class", "shingles"), "class").groupBy("tile").applyInArrow(_verify(threshold), "a long, b long")
    found = components(edges).withColumnRenamed("node", "class")
    placed = sets.select("class", "least").join(found, "class", "left").select("class", "least", F.coalesce("root", "class").alias("root"))
    where = placed.join(placed.groupBy("root").agg(F.min("least").alias("class_id")), "root").select("class", "class_id")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("class"))
    return rows.join(where, "class").select("doc_id", "class_id")
