"""Are the people on two sides of a split really different people?

All pairs must be compared, so the work is quadratic by definition; what moves is not. Vectors that take part in the
same comparisons and lie near the same centre are packed into blocks of floats. Blocks are dealt to strips, and a task
multiplies one strip by another: a vector moves once for each strip, about the square root of the number of tasks.
Every comparison asked for - each fold's sides, the subjects among themselves - is a scope, and a block carries the
scopes of its vectors as bits, so one product serves them all. By the triangle inequality on angles a pair of blocks
whose centres are too far apart for their radii can neither cross the threshold nor raise a maximum, and is passed over.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.scalar import dot
from assayer.operators.ranking import null_safe_join
from assayer.operators.select import seeded_sample
from assayer.session import cut_lineage

#: Bytes of a packed block, and of the blocks of a strip; centres that vectors are gathered at; rows multiplied at a time.
BLOCK_BYTES, STRIP_BYTES, CENTRES, CHUNK_ROWS = 4 << 20, 48 << 20, 64, 1024
#: Scopes in one word of bits.
WORD = 62
MASKS = ("left", "right", "own")


def unit(v: Column | str) -> Column:
    """Unit vector; a vector without direction becomes all zeros."""
    d = (F.col(v) if isinstance(v, str) else v).cast("array<double>")
    norm = F.sqrt(F.aggregate(d, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(d, lambda x: F.when(norm > 0, x / norm).otherwise(0.0))


def bits(scopes: int, which: Column) -> Column:
    """Words of bits of the scopes in an array of scope numbers."""
    one = F.lit(1).cast("long")

    def word(k: int) -> Column:
        mine = F.filter(which, lambda s: F.floor(s / WORD) == k)
        return F.aggregate(mine, F.lit(0).cast("long"), lambda a, s: a.bitwiseOR(F.call_function("shiftleft", one, (s % WORD).cast("int"))))

    words = [word(k) for k in range(-(-scopes // WORD))]
    return F.array(*words)


def _number(words: Sequence[int]) -> int:
    return sum(w << (WORD * k) for k, w in enumerate(words))


def _scopes(mask: int) -> list[int]:
    return [k for k in range(mask.bit_length()) if mask >> k & 1]


@dataclass
class _Block:
    v: np.ndarray
    centre: np.ndarray
    radius: float
    left: int
    right: int
    own: int


def _pack(table: pa.Table) -> pa.Table:
    """One row for a group of vectors: its floats, its centre, and the angle of its farthest vector."""
    v = table.column("v").combine_chunks()
    sizes = set(v.value_lengths().to_pylist())
    if len(sizes) > 1:
        raise ValueError(f"embeddings of different lengths cannot be compared: {sorted(sizes)}")
    x = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)
    mean = x.mean(axis=0)
    length = float(np.linalg.norm(mean))
    centre = mean / length if length > 0 else mean
    # a zero vector has no angle, so a block that holds one is never passed over
    straight = length > 0 and bool((np.linalg.norm(x, axis=1) > 0.5).all())
    radius = float(np.arccos(np.clip((x @ centre).min(), -1, 1))) if straight else np.pi
    first = table.slice(0, 1)
    return pa.table([*(first.column(m) for m in MASKS), pa.array([len(x)]), pa.array([x.tobytes()]), pa.array([centre.tobytes()]), pa.array([radius])], names=[*MASKS, "n", "data", "centre", "radius"])


def _multiply(threshold: float):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        i, j = key[0].as_py(), key[1].as_py()
        blocks, strips = [], table.column("strip").to_pylist()
        for r in range(table.num_rows):
            row = {c: table.column(c)[r].as_py() for c in ("n", "data", "centre", "radius", *MASKS)}
            blocks.append(_Block(np.frombuffer(row["data"]).reshape(row["n"], -1), np.frombuffer(row["centre"]), row["radius"], *(_number(row[m]) for m in MASKS)))
        one, two = [b for b, s in zip(blocks, strips, strict=True) if s == i], [b for b, s in zip(blocks, strips, strict=True) if s == j]
        best: dict[int, float] = {}
        hits: dict[int, int] = {}
        pairs: dict[int, int] = {}
        work = []
        for k, x in enumerate(one):
            for y in two[k:] if i == j else two:
                n = len(x.v) * len(y.v)
                ways = [(_scopes(x.left & y.right), n, False), (_scopes(y.left & x.right) if x is not y else [], n, False), (_scopes(x.own & y.own), (n - len(x.v)) // 2 if x is y else n, x is y)]
                for scopes, count, _ in ways:
                    for s in scopes:
                        pairs[s] = pairs.get(s, 0) + count
                if any(scopes and count for scopes, count, _ in ways):
                    apart = float(np.arccos(np.clip(x.centre @ y.centre, -1, 1))) - x.radius - y.radius if x.centre.shape == y.centre.shape else 0.0
                    work.append((float(np.cos(max(apart, 0.0))) + 1e-9, x, y, ways))
        for most, x, y, ways in sorted(work, key=lambda w: -w[0]):
            open_ = [w for w in ways if w[1] and (w[0] and most >= threshold or any(best.get(s, -np.inf) < most for s in w[0]))]
            for lo in range(0, len(x.v) if open_ else 0, CHUNK_ROWS):
                near = x.v[lo : lo + CHUNK_ROWS] @ y.v.T
                for scopes, _, half in open_:
                    part = near[np.arange(lo, lo + len(near))[:, None] < np.arange(len(y.v))[None, :]] if half else near
                    if part.size:
                        top, over = float(part.max()), int((part >= threshold).sum())
                        for s in scopes:
                            best[s], hits[s] = max(best.get(s, -np.inf), top), hits.get(s, 0) + over
        names = sorted(pairs)
        return pa.table([pa.array(names, pa.int32()), pa.array([best.get(s) for s in names], pa.float64()), pa.array([hits.get(s, 0) for s in names], pa.int64()), pa.array([pairs[s] for s in names], pa.int64())], names=["scope", "best", "hits", "pairs"])

    return run


def packed(vectors: DataFrame) -> DataFrame:
    """Blocks of vectors of equal scopes near one centre; the few centres are unit vectors of the table, chosen by hash."""
    centres = vectors.select("v").orderBy(F.xxhash64("v")).limit(CENTRES).toArrow().column("v").to_pylist()
    if len({len(c) for c in centres}) > 1:
        raise ValueError("embeddings of different lengths cannot be compared")
    c = np.array(centres) if centres else np.zeros((1, 1))

    def nearest(v: pa.Array) -> pa.Array:
        if not len(v):
            return pa.array([], pa.int32())
        if set(v.value_lengths().to_pylist()) != {c.shape[1]}:
            raise ValueError("embeddings of different lengths cannot be compared")
        return pa.array((v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1) @ c.T).argmax(axis=1).astype(np.int32))

    rows = max(1, BLOCK_BYTES // (8 * c.shape[1]))
    placed = vectors.withColumn("near", F.arrow_udf(nearest, "int")("v")).withColumn("kind", F.xxhash64(*MASKS))
    sizes = placed.groupBy("kind", "near").agg(F.ceil(F.count("*") / rows).alias("parts"))
    dealt = placed.join(sizes, ["kind", "near"]).withColumn("part", F.pmod(F.xxhash64("v", F.lit(1)), F.col("parts")))
    masks = ", ".join(f"{m} array<long>" for m in MASKS)
    return dealt.select("kind", "near", "part", *MASKS, "v").groupBy("kind", "near", "part").applyInArrow(_pack, f"{masks}, n long, data binary, centre binary, radius double")


def scope_products(vectors: DataFrame, threshold: float) -> DataFrame:
    """(scope, best, hits, pairs): the largest similarity, the pairs at or above the threshold, and all pairs of each scope.

    ``vectors`` is (v, left, right, own): unit vectors and the scopes (words of bits) in which each is compared with the
    other side, or with all others. A scope without pairs has no row.
    """
    blocks = cut_lineage(packed(vectors).withColumn("strip_key", F.xxhash64("data")))
    size, count = blocks.agg(F.coalesce(F.sum(F.octet_length("data")), F.lit(0)), F.count("*")).first()
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    strips = max(1, -(-size // STRIP_BYTES), min(count, int(np.ceil((2 * tasks) ** 0.5))))
    strip = F.pmod("strip_key", F.lit(strips)).cast("int")
    dealt = blocks.withColumn("strip", strip).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(strips - 1))))
    dealt = dealt.withColumn("i", F.least("strip", "other")).withColumn("j", F.greatest("strip", "other"))
    parts = dealt.groupBy("i", "j").applyInArrow(_multiply(threshold), "scope int, best double, hits long, pairs long")
    return parts.groupBy("scope").agg(F.max("best").alias("best"), F.sum("hits").alias("hits"), F.sum("pairs").alias("pairs"))


def missing_embeddings(ids: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Ids without a vector; a null one is none."""
    return ids.select("sample_id").join(embeddings.where(F.col("embedding").isNotNull()), "sample_id", "left_anti")


def _tolerance(tolerated: float) -> None:
    if not 0.0 <= tolerated <= 1.0:
        raise ValueError(f"tolerated rate must lie in [0, 1], got {tolerated}")


def report_columns(threshold: float, tolerated: float) -> list[Column]:
    """The report's columns from n_train, n_test and a scope's best, hits and pairs (null: nothing to compare)."""
    rate = F.when(F.col("pairs") > 0, F.col("hits") / F.col("pairs")).otherwise(0.0)
    return [
        F.col("n_train"), F.col("n_test"), F.greatest(F.lit(0.0), F.coalesce("best", F.lit(0.0))).alias("max_similarity"), F.coalesce("hits", F.lit(0)).alias("violations"),
        F.lit(threshold).alias("threshold"), F.coalesce(rate, F.lit(0.0)).alias("violation_rate"), F.lit(tolerated).alias("tolerated_rate")]


def side_vectors(folds: DataFrame, embeddings: DataFrame, scopes: int) -> DataFrame:
    """Vectors with the scopes in which they train and test, of (scope, sample_id, side); other sides take no part."""
    side = lambda name: F.collect_set(F.when(F.col("side") == name, F.col("scope")))
    ids = folds.where(F.col("side").isin("train", "test")).groupBy("sample_id").agg(side("train").alias("t"), side("test").alias("e"))
    e = embeddings.where(F.col("embedding").isNotNull()).select("sample_id", unit("embedding").alias("v"))
    return e.join(ids, "sample_id").select("v", bits(scopes, F.col("t")).alias("left"), bits(scopes, F.col("e")).alias("right"), bits(scopes, F.expr("array(-1)")).alias("own"))


def subject_vectors(embeddings: DataFrame, scopes: int, scope: int, max_subjects: int | None = None, seed: int = 0) -> DataFrame:
    """One vector for each subject, that of its first sample, compared with all others in the scope."""
    reps = embeddings.where(F.col("embedding").isNotNull()).groupBy(F.col("subject_id").alias("id")).agg(F.min_by("embedding", "sample_id").alias("e"))
    picked = reps if max_subjects is None else seeded_sample(reps, "id", max_subjects, seed)
    none = bits(scopes, F.expr("array(-1)"))
    return picked.select(unit("e").alias("v"), none.alias("left"), none.alias("right"), bits(scopes, F.array(F.lit(scope))).alias("own"))


def identity_disjoint(train: DataFrame, test: DataFrame, embeddings: DataFrame, threshold: float = 0.6, tolerated: float = 0.0) -> DataFrame:
    """One-row report over every train x test pair. Check
    :func:`missing_embeddings` first: an absent vector was never compared."""
    _tolerance(tolerated)
    sides = train.select("sample_id", F.lit("train").alias("side")).unionByName(test.select("sample_id", F.lit("test").alias("side")))
    found = scope_products(side_vectors(sides.withColumn("scope", F.lit(0)), embeddings, 1), threshold)
    n = sides.agg(F.count_if(F.col("side") == "train").alias("n_train"), F.count_if(F.col("side") == "test").alias("n_test"), F.lit(0).alias("scope"))
    return n.join(found, "scope", "left").select(*report_columns(threshold, tolerated))


def subject_partition(embeddings: DataFrame, threshold: float = 0.6, tolerated: float = 0.0, max_subjects: int | None = None, seed: int = 0) -> DataFrame:
    """Are different subject ids different people? One representative each (its
    first sample). All subjects are compared unless ``max_subjects`` asks for a
    sample drawn by hash; the report carries ``n_subjects_total`` beside it."""
    if max_subjects is not None and max_subjects < 2:
        raise ValueError(f"comparing subjects takes two of them or more; max_subjects is {max_subjects}")
    _tolerance(tolerated)
    picked = subject_vectors(embeddings, 1, 0, max_subjects, seed)
    n = picked.agg(F.count(F.lit(1)).alias("n_train"), F.count(F.lit(1)).alias("n_test"), F.lit(0).alias("scope"))
    report = n.join(scope_products(picked, threshold), "scope", "left").select(*report_columns(threshold, tolerated))
    return null_safe_join(report, embeddings.agg(F.countDistinct("subject_id").alias("n_subjects_total")), [])


def require_distinct(report: DataFrame, waived: bool = False) -> DataFrame:
    r = report.collect()[0]
    if not waived and r.violation_rate > r.tolerated_rate:
        raise ValueError(f"identity leakage: {r.violations} pairs at or above {r.threshold} (max {r.max_similarity:.4f})")
    return report


def similarity_column(a: str, b: str) -> Column:
    """The same cosine for one pair of columns, inside Catalyst."""
    return dot(unit(a), unit(b))


__all__: Sequence[str] = (
    "identity_disjoint", "missing_embeddings", "require_distinct", "scope_products", "side_vectors", "similarity_column", "subject_partition",
    "subject_vectors", "unit",
)
