"""Hard negatives by rotated one-bit codes: popcount estimates, residual intervals, integer scores of what survives.

A vector v of whole numbers is turned by a fixed random rotation and coded by the signs of its components. With c the unit
vector of those signs, v = align * c + r, where r is orthogonal to c. The remainder r is coded in the same way under the next
rotation, so that each stage leaves about 0.6 of the length that the one before it left. For an anchor q the inner product
is the sum of align * <c, q> over the stages, and <r, q>. The sum comes from popcounts of the codes under the bit planes of
q, whose rounding error is bounded by its length; <r, q> lies within |r| * |q - <c, q> c| by Cauchy and Schwarz. So every
score has an interval that is certain, and only rows whose interval reaches into the wanted range are scored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm.store import keep, partitions

#: Codes of a vector, bits of an anchor's rotated components; anchors and rows that meet in one task; anchors looked at together.
STAGES, PLANES, PIECE_ANCHORS, PIECE_ROWS, BLOCK = 3, 6, 2048, 32_768, 16
#: Vectors are scaled by this and rounded down; scaled components this large or larger are out of range.
SCALE, LARGEST = 256, 1 << 26
NEVER = np.iinfo(np.int64).min


@lru_cache(maxsize=16)
def rotation(dim: int, stage: int) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    return np.linalg.qr(np.random.Generator(np.random.PCG64([dim, stage])).standard_normal((dim, dim)))[0]


def _words(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    packed = np.packbits(bits, axis=-1, bitorder="little")
    out = np.zeros((*bits.shape[:-1], -(-bits.shape[-1] // 64) * 8), np.uint8)
    out[..., : packed.shape[-1]] = packed
    return out.view(np.uint64)


@dataclass
class Codes:
    """For each vector and stage: sign bits (vectors x stages x words), length along the code, length of what is left."""

    bits: np.ndarray
    align: np.ndarray
    rest: np.ndarray

    def part(self, at: np.ndarray) -> Codes:
        return Codes(self.bits[at], self.align[at], self.rest[at])


def encode(v: np.ndarray) -> Codes:
    root, left, stages = max(v.shape[1], 1) ** 0.5, v, []
    for k in range(STAGES):
        turned = left @ rotation(v.shape[1], k)
        align = np.abs(turned).sum(axis=1) / root
        left = (turned - np.where(turned >= 0, 1, -1) * (align / root)[:, None]) @ rotation(v.shape[1], k).T
        stages.append((_words(turned >= 0), align, np.sqrt((left * left).sum(axis=1))))
    return Codes(*(np.stack(x, axis=1) for x in zip(*stages, strict=True)))


@dataclass
class Planes:
    """An anchor block turned for one stage: bit planes of its rounded components, and what the rounding left out."""

    planes: list[np.ndarray]
    least: np.ndarray
    step: np.ndarray
    total: np.ndarray
    error: np.ndarray

    @classmethod
    def of(cls, q: np.ndarray, stage: int) -> Planes:
        turned = q @ rotation(q.shape[1], stage)
        least = turned.min(axis=1, initial=0)
        step = np.maximum((turned.max(axis=1, initial=0) - least) / ((1 << PLANES) - 1), 1e-9)
        level = np.rint((turned - least[:, None]) / step[:, None]).astype(np.int64)
        rounded = least[:, None] + step[:, None] * level
        planes = [_words((level >> b & 1).astype(bool)) for b in range(PLANES)]
        return cls(planes, least, step, rounded.sum(axis=1), np.sqrt(((turned - rounded) ** 2).sum(axis=1)))

    def along(self, bits: np.ndarray, dim: int) -> np.ndarray:
        """<c, q> of each rounded anchor with each code."""
        total = np.zeros((len(self.least), len(bits)), np.int32)
        for b, plane in enumerate(self.planes):
            for w in range(plane.shape[1]):
                total += np.bitwise_count(plane[:, w, None] & bits[None, :, w]).astype(np.int32) << b
        ones = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        return (2 * (self.least[:, None] * ones + self.step[:, None] * total) - self.total[:, None]) / max(dim, 1) ** 0.5


def survivors(q: np.ndarray, codes: Codes, wanted, stages: int = STAGES) -> tuple[np.ndarray, np.ndarray]:
    """(rows, live): rows that `wanted(low, high, rows)` keeps for some anchor after the last stage, and for which ones.

    Each stage narrows the intervals; rows that no anchor of the block keeps are not looked at again.
    """
    rows, length2 = np.arange(len(codes.bits)), (q * q).sum(axis=1)
    live = np.ones((len(q), len(rows)), bool)
    middle, slack = np.zeros(live.shape), np.zeros(live.shape)
    for k in range(stages):
        p = Planes.of(q, k)
        along = p.along(codes.bits[rows, k], q.shape[1])
        align, rest = codes.align[rows, k], codes.rest[rows, k]
        middle += align * along
        slack += align * p.error[:, None]
        near = np.maximum(np.abs(along) - p.error[:, None], 0)
        half = slack + rest * np.sqrt(np.maximum(length2[:, None] - near * near, 0))
        half += 1e-9 * np.sqrt(length2)[:, None] * (codes.align[rows].sum(axis=1) + rest) + 1e-6
        live = wanted(middle - half, middle + half, rows)
        some = live.any(axis=0)
        rows, live, middle, slack = rows[some], live[:, some], middle[:, some], slack[:, some]
    return rows, live


def scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact: in doubles where no sum can leave 2**53, else in integers."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * max(q.shape[1], 1)
    return (q.astype(float) @ v.astype(float).T).astype(np.int64) if top < 2**53 else q @ v.T


def first_of(s: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the `top` largest of each row, ties by smaller column; NEVER is no score."""
    if not s.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    k = min(top, s.shape[1])
    bar = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k, None]
    above = s > bar
    level = (s == bar) & (bar > NEVER)
    level &= np.cumsum(level, axis=1) <= k - above.sum(axis=1)[:, None]
    return np.nonzero(above | level)


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.int64).reshape(rows, -1)


@dataclass
class Members:
    """Rows of one piece, by id; equal rows count once."""

    ids: np.ndarray
    label: np.ndarray
    v: np.ndarray
    codes: Codes

    @classmethod
    def of(cls, table: pa.Table) -> Members:
        v = _matrix(table.column("v"), table.num_rows)
        ids, label, tag = (table.column(c).to_numpy() for c in ("vec_id", "label", "tag"))
        order = np.lexsort((tag, ids))
        same = np.zeros(len(order), bool)
        a, b = order[1:], order[:-1]
        same[1:] = (ids[a] == ids[b]) & (tag[a] == tag[b]) & (label[a] == label[b]) & (v[a] == v[b]).all(axis=1)
        order = order[~same]
        bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint64).reshape(table.num_rows, STAGES, -1)
        align, rest = (table.column(c).combine_chunks().flatten().to_numpy().reshape(-1, STAGES) for c in ("align", "rest"))
        return cls(ids[order], label[order], v[order], Codes(bits, align, rest).part(order))


def _positives(top: int):
    """The `top` best rows of an anchor's label in one piece of rows."""

    def run(asked: pa.Table, piece: pa.Table) -> pa.Table:
        key, other, score = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if asked.num_rows and piece.num_rows:
            member = Members.of(piece)
            q, tags, ids = _matrix(asked.column("v"), asked.num_rows), asked.column("tag").to_numpy(), asked.column("vec_id").to_numpy()
            label = asked.column("label").to_numpy()
            for one in np.unique(label):
                of, at = np.flatnonzero(label == one), np.flatnonzero(member.label == one)
                for lo in range(0, len(of), BLOCK):
                    mine = of[lo : lo + BLOCK]

                    def wanted(low, high, rows, mine=mine, at=at):
                        other = member.ids[at[rows]][None, :] != ids[mine][:, None]
                        low = np.where(other, low, -np.inf)
                        if low.shape[1] > top:  # `top` rows are certain to score this much
                            other &= high >= np.partition(low, -top, axis=1)[:, -top, None]
                        return other

                    rows, live = survivors(q[mine].astype(float), member.codes.part(at), wanted)
                    s = np.where(live, scores(q[mine], member.v[at[rows]]), NEVER)
                    i, j = first_of(s, top)
                    key.append(tags[mine[i]]), other.append(member.ids[at[rows[j]]]), score.append(s[i, j])
        return pa.table([pa.array(np.concatenate(x)) for x in (key, other, score)], names=["tag", "positive_id", "positive_score"])

    return run


def _negatives(top: int, percent: int):
    """For each positive of an anchor the `top` best rows of other labels whose score lies in its band, in one piece of rows."""

    def run(asked: pa.Table, piece: pa.Table) -> pa.Table:
        out = [[np.zeros(0, np.int64)] for _ in range(4)]
        if asked.num_rows and piece.num_rows:
            member = Members.of(piece)
            q, tags, ids = _matrix(asked.column("v"), asked.num_rows), asked.column("tag").to_numpy(), asked.column("vec_id").to_numpy()
            label, bands = asked.column("label").to_numpy(), asked.column("bands").to_pylist()
            most = max(map(len, bands))
            top_score = np.array([b + [NEVER] * (most - len(b)) for b in bands], np.int64)
            least_score = np.array([[-(-percent * x // 100) for x in b] + [0] * (most - len(b)) for b in bands], np.int64)
            ceiling, floor = top_score.max(axis=1), np.array([min(-(-percent * x // 100) for x in b) for b in bands], np.int64)
            for lo in range(0, len(q), BLOCK):
                mine = slice(lo, lo + BLOCK)

                def wanted(low, high, rows, mine=mine):
                    reach = (high >= floor[mine][:, None]) & (low <= ceiling[mine][:, None])
                    return reach & (member.label[rows][None, :] != label[mine][:, None]) & (member.ids[rows][None, :] != ids[mine][:, None])

                rows, live = survivors(q[mine].astype(float), member.codes, wanted)
                s = scores(q[mine], member.v[rows])
                for p in range(most):
                    fits = live & (s <= top_score[mine, p, None]) & (s >= least_score[mine, p, None])
                    i, j = first_of(np.where(fits, s, NEVER), top)
                    for x, part in zip(out, (tags[mine][i], np.full(len(i), p), member.ids[rows[j]], s[i, j]), strict=True):
                        x.append(part)
        return pa.table([pa.array(np.concatenate(x).astype(np.int64)) for x in out], names=["tag", "place", "negative_id", "negative_score"])

    return run


def usable(v: Column, label: Column) -> Column:
    """Neither is null, and every component is a finite number in range."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < LARGEST / SCALE))
    return F.coalesce(label.isNotNull() & v.isNotNull() & fine, F.lit(False))


def mine(vectors: DataFrame, anchors: Column, label: Column, id_col: str = "vec_id", vector: str = "embedding", positives: int = 5, negatives: int = 5, percent: int = 80) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): hard negatives of all anchors.

    Components become floor(SCALE * x), and a score is the inner product of those whole numbers. An anchor's positives are
    its `positives` best other rows of its label; of each, the `negatives` best rows of other labels come whose score is at
    most the positive's and at least `percent` hundredths of it. Higher scores come first, ties by smaller id.

    `anchors` and `label` are expressions over the columns of `vectors`. Rows with a null id, label or vector take no part,
    nor do vectors with a component that is null, not finite, or LARGEST / SCALE or more in size. Vectors of another
    length than the anchor's are not compared with it. A row is never its own id's positive or negative. Equal rows count
    once; rows that share an id only are rows of their own. Other columns are left out. An empty table gives an empty one.

    Anchors and rows are dealt by hash to pieces of bounded size, and each piece of anchors meets each piece of rows in a
    task that leaves `positives` rows for an anchor, later `negatives` for a positive. The work is anchors x rows by
    definition; codes keep it to a popcount for each plane where the interval misses.
    """
    scaled = F.transform(F.col("v"), lambda x: F.floor(x.cast("double") * SCALE).cast("int"))
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(f"`{vector}`").alias("v"), F.coalesce(anchors, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("v"), F.col("label"))).withColumn("v", scaled)
    rows = rows.withColumn("tag", F.xxhash64("vec_id", "label", "v")).withColumn("dim", F.size("v"))

    def coded(batches):
        for b in batches:
            at = {n: k for k, n in enumerate(b.schema.names)}
            v, dims = b.column(at["v"]), b.column(at["dim"]).to_numpy()
            bits, align, rest = np.empty(len(dims), object), np.zeros((len(dims), STAGES)), np.zeros((len(dims), STAGES))
            for d in np.unique(dims):
                own = np.flatnonzero(dims == d)
                c = encode(v.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(own), d))
                align[own], rest[own] = c.align, c.rest
                bits[own] = [x.tobytes() for x in c.bits]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(bits.tolist(), pa.binary()), pa.array(list(align), pa.list_(pa.float64())), pa.array(list(rest), pa.list_(pa.float64()))], [*b.schema.names, "bits", "align", "rest"])

    shape = "vec_id long, label long, v array<int>, asks boolean, tag long, dim int, bits binary, align array<double>, rest array<double>"
    table = keep(rows.mapInArrow(coded, shape), "coded")
    asked = keep(table.where("asks").select("vec_id", "label", "v", "tag", "dim").dropDuplicates(["vec_id", "tag"]), "anchors")
    count, asking = table.count(), asked.count()
    spread = max(-(-count // PIECE_ROWS), min(partitions(vectors.sparkSession), -(-count // 1024)), 1)
    groups = max(1, -(-asking // PIECE_ANCHORS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    hashed = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    right = table.drop("asks").select("*", every(groups).alias("i"), hashed(spread).alias("j"))

    def meet(left: DataFrame, f, schema: str) -> DataFrame:
        left = left.select("*", hashed(groups).alias("i"), every(spread).alias("j"))
        return left.groupBy("dim", "i", "j").cogroup(right.groupBy("dim", "i", "j")).applyInArrow(f, schema)

    best = Window.partitionBy("tag").orderBy(F.desc("positive_score"), "positive_id")
    near = meet(asked, _positives(positives), "tag long, positive_id long, positive_score long")
    near = keep(near.withColumn("place", F.row_number().over(best) - 1).where(F.col("place") < positives), "positives")
    bands = near.groupBy("tag").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "positive_score"))), lambda x: x["positive_score"]).alias("bands"))
    found = meet(asked.join(bands, "tag"), _negatives(negatives, percent), "tag long, place long, negative_id long, negative_score long")
    order = Window.partitionBy("tag", "place").orderBy(F.desc("negative_score"), "negative_id")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    named = asked.select("tag", F.col("vec_id").alias("anchor_id")).join(near, "tag")
    return found.join(named, ["tag", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
