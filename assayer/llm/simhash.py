"""SimHash near-duplicates by bit-sliced comparison."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.graph import components, local_roots
from assayer.llm.store import bounded_batches, keep, partitions, rows_of
from assayer.llm.words import texts_of

#: Fingerprints compared in one tile; a larger bucket is cut into pieces that meet two by two.
TILE = 8192
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: bytes, width: int = 4) -> int:
    """Bits set in over half of the shingles' XXH64 (seed 42); 0 for a text without a word."""
    words = text.lower().split()  # of bytes: A-Z only, and the six ASCII blanks
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    if n == 1:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_digest
    total = np.zeros(64, np.int64)
    for lo in range(0, n, 1 << 16):
        hi = min(n, lo + (1 << 16))
        hashed = b"".join([digest(joined[s:e], 42) for s, e in zip(starts[lo:hi].tolist(), ends[lo + width - 1 : hi + width - 1].tolist(), strict=True)])
        total += np.unpackbits(np.frombuffer(hashed, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 4) -> DataFrame:
    """(id, bits): the 64-bit fingerprint of every row's whole text, as a signed long. Null text counts as empty."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = np.array([fingerprint(t, width) for t in texts_of(b.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(f.view(np.int64))], ["id", "bits"])

    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    return src.mapInArrow(run, "id long, bits long")


def planes_of(f: np.ndarray) -> np.ndarray:
    """Bit planes of fingerprints (n rows of 64-bit words): row j holds bit j of all, 64 fingerprints to a word."""
    rows = -(-len(f) // 64) * 64
    padded = np.zeros((rows, f.shape[1]), np.uint64)
    padded[: len(f)] = f
    bits = np.unpackbits(padded.view(np.uint8), axis=1, bitorder="little")
    return np.packbits(bits.T.copy(), axis=1, bitorder="little").view(np.uint64)


class Tally:
    """Distances of many lanes at once, kept as bit planes.

    A difference bit is added by carry-save half adders. Counters begin so high that the carry out of the last plane
    says that a lane has passed the radius; such a lane is dead for good.
    """

    def __init__(self, shape: tuple[int, ...], radius: int) -> None:
        levels = int(radius + 1).bit_length()
        start = (1 << levels) - 1 - radius
        self.count = [np.full(shape, ONES if start >> k & 1 else 0, np.uint64) for k in range(levels)]
        self.dead = np.zeros(shape, np.uint64)
        self.spare = np.empty(shape, np.uint64)

    def add(self, difference: np.ndarray) -> None:
        """Takes the array over as scratch space."""
        for c in self.count:
            np.bitwise_and(c, difference, out=self.spare)
            c ^= difference
            difference, self.spare = self.spare, difference
        self.dead |= difference

    def over(self) -> bool:
        return bool((self.dead == ONES).all())


def within(planes: np.ndarray, queries: np.ndarray, radius: int) -> np.ndarray:
    """For each query a row of words whose set bits are the fingerprints at most `radius` bits away.

    When every lane of a block is dead the rest of the bits is not looked at.
    """
    tally = Tally((len(queries), planes.shape[1]), radius)
    for j, plane in enumerate(planes):
        q = ((queries[:, j // 64] >> np.uint64(j % 64)) & np.uint64(1)) * ONES
        tally.add(plane[None, :] ^ q[:, None])
        if j % 8 == 7 and tally.over():
            break
    return ~tally.dead


def close_pairs(f: np.ndarray, g: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (i, j) of f and g within the radius, for 64 of f at a time."""
    planes = planes_of(g)
    for lo in range(0, len(f), 64):
        hit = within(planes, f[lo : lo + 64], radius)
        i, j = np.nonzero(np.unpackbits(hit.view(np.uint8), axis=1, bitorder="little")[:, : len(g)]) if hit.any() else (np.zeros(0, np.int64),) * 2
        yield lo + i, j


def shifted_pairs(f: np.ndarray, key: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of equal key within the radius, keys sorted: the planes against themselves moved by 1, 2, ... places."""
    planes = planes_of(f)
    left, right, d = [], [], 1
    while d < len(f):
        same = key[d:] == key[:-d]
        if not same.any():
            break
        whole, part = divmod(d, 64)
        tally = Tally((planes.shape[1],), radius)
        tally.dead[:] = ONES
        alive = np.packbits(same, bitorder="little")
        tally.dead.view(np.uint8)[: len(alive)] ^= alive
        for j, plane in enumerate(planes):
            moved = np.zeros_like(plane)
            moved[: len(plane) - whole] = plane[whole:] >> np.uint64(part)
            if part:
                moved[: len(plane) - whole - 1] |= plane[whole + 1 :] << np.uint64(64 - part)
            tally.add(plane ^ moved)
            if j % 8 == 7 and tally.over():
                break
        at = np.flatnonzero(np.unpackbits((~tally.dead).view(np.uint8), bitorder="little"))
        left.append(at)
        right.append(at + d)
        d += 1
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64),) * 2


def tile_edges(f: np.ndarray, side: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, root) inside one bucket or tile. Rows with side 2 are compared with side 1 only, others among themselves."""
    one, two = np.flatnonzero(side != 2), np.flatnonzero(side == 2)
    other = two if len(two) else one
    root = np.arange(len(f))
    for i, j in close_pairs(f[one], f[other], radius):
        root = local_roots(root, one[i], other[j])
    moved = np.flatnonzero(root != np.arange(len(f)))
    return moved, root[moved]


def runs_of(batches: Iterator[pa.RecordBatch], rows: int = 1 << 16) -> Iterator[list[np.ndarray]]:
    """Columns of batches sorted by the first, as arrays of at least `rows` rows that never cut a run of equal keys."""
    held: list[list[np.ndarray]] = []
    count = 0
    for batch in batches:
        part = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        held.append(part)
        count += len(part[0])
        if count < rows:
            continue
        whole = [np.concatenate(c) for c in zip(*held, strict=True)]
        cut = int(np.searchsorted(whole[0], whole[0][-1]))
        if cut:
            yield [c[:cut] for c in whole]
        held, count = [[c[cut:] for c in whole]], len(whole[0]) - cut
    if count:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def bucket_edges(key: np.ndarray, f: np.ndarray, side: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs that connect what lies within the radius, bucket by bucket of the sorted keys."""
    cuts = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]))
    size = np.diff(cuts)
    small = (size > 1) & (size <= 32) & (np.maximum.reduceat(side, cuts[:-1]) == 0)
    rows = np.flatnonzero(np.repeat(small, size))
    i, j = shifted_pairs(f[rows], key[rows], radius)
    left, right = [rows[i]], [rows[j]]
    for r in np.flatnonzero((size > 1) & ~small):
        i, j = tile_edges(f[cuts[r] : cuts[r + 1]], side[cuts[r] : cuts[r + 1]], radius)
        left.append(cuts[r] + i)
        right.append(cuts[r] + j)
    return np.concatenate(left), np.concatenate(right)


def _edges_of_sorted(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, f, side in runs_of(batches):
            i, j = bucket_edges(key, f.view(np.uint64)[:, None], side, radius)
            yield pa.RecordBatch.from_arrays([pa.array(f[i]), pa.array(f[j])], ["a", "b"])

    return run


def block_keys(bits: str, radius: int, match: int = 2) -> list:
    """Keys of which two fingerprints within the radius share one: all choices of `match` of radius + match blocks."""
    blocks = radius + match
    edge = [64 * k // blocks for k in range(blocks + 1)]
    out = []
    for n, chosen in enumerate(combinations(range(blocks), match)):
        mask = sum(((1 << (edge[k + 1] - edge[k])) - 1) << edge[k] for k in chosen)
        mask -= (1 << 64) if mask >> 63 else 0
        out.append(F.xxhash64(F.lit(n), F.col(bits).bitwiseAND(F.lit(mask).cast("long"))))
    return out


def links(prints: DataFrame, radius: int = 4, tile: int = TILE) -> DataFrame:
    """Edges (a, b) that connect exactly the distinct fingerprints (column bits) linked at `radius` or fewer bits.

    By the pigeonhole two such fingerprints agree in two of radius + 2 blocks; each choice of two blocks is a key, and
    only equal keys are compared. Buckets over `tile` are cut by hash into pieces; each pair of pieces is its own
    bucket, so no task holds more than two pieces. Buckets give out spanning edges, not pairs.
    """
    spark = prints.sparkSession
    keyed = prints.select("bits", F.explode(F.array(*block_keys("bits", radius))).alias("key"))
    hot = keep(keyed.groupBy("key").count().where(F.col("count") > tile).select("key", F.ceil(F.col("count") / (tile // 2)).cast("int").alias("pieces")), "hot")
    if hot.isEmpty():
        dealt = keyed.select("key", "bits", F.lit(0).alias("side"))
    else:
        both = keyed.join(hot, "key", "left").withColumn("mine", F.expr("cast(pmod(xxhash64(bits, 7), pieces) as int)"))
        plain = both.where("pieces is null").select("key", "bits", F.lit(0).alias("side"))
        tiles = both.where("pieces is not null").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
        lo, hi = F.least("mine", "other"), F.greatest("mine", "other")
        tiles = tiles.select(F.xxhash64("key", lo, hi).alias("key"), "bits", F.when(lo == hi, 0).when(F.col("mine") == lo, 1).otherwise(2).alias("side"))
        dealt = plain.unionByName(tiles)
    dealt = dealt.repartition(partitions(spark), "key").sortWithinPartitions("key")
    return dealt.mapInArrow(_edges_of_sorted(radius), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 4, radius: int = 4) -> DataFrame:
    """One row per document: (doc_id, fingerprint, component_id).

    component_id is the smallest doc_id reachable over links of `radius` or fewer differing bits. Texts without a
    word have fingerprint zero and link like any other. Equal fingerprints are one node. Repeated rows stay, each with
    the same component; a row with null doc_id gets a fingerprint and the component of its fingerprint's group (null
    only if no row of the group has an id). An empty table gives an empty result. Extra columns are ignored.
    """
    prints = keep(fingerprints(rows_of(docs, id_col, text), id_col, text, width), "prints")
    classes = keep(prints.groupBy("bits").agg(F.min("id").alias("least")), "classes")
    found = components(links(classes, radius)).withColumnRenamed("node", "bits")
    placed = classes.join(found, "bits", "left").select("bits", "least", F.coalesce("root", "bits").alias("root"))
    smallest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    where = placed.join(smallest, "root").select("bits", "component_id")
    return prints.join(where, "bits").select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id"
    )
