"""Best-fit packing of documents into bins, under conflicts of source and duplicate cluster."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.store import keep

#: Words of a bin, pieces that one shard packs by itself, and the share of a bin that counts as well filled.
CAPACITY, SHARD_PIECES, WELL_FILLED = 4096, 20_000, 0.95
OUT = "row_id long, part long, first_word long, n_words long, shard int, bin int, slot int, bin_words long"


class Bins:
    """Open bins ordered by what they have left, each with bitmaps of its sources and duplicate clusters.

    A tree over the residuals 1..capacity keeps, for each range, the bits that *all* open bins of the range carry. A
    piece that conflicts with a bit held by a whole range skips it at one look, so the successor search goes on from
    tight to loose bins without visiting those that cannot take the piece. Bit 0 stands for emptiness: only ranges
    without a bin have it, and every search asks for it.
    """

    FULL = -1  # the meet of no bins: every bit set

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.size = 1 << max(capacity, 1).bit_length()
        self.sources = [self.FULL] * (2 * self.size)
        self.clusters = [self.FULL] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.of: list[tuple[int, int]] = []  # each bin's bitmaps
        self.left: list[int] = []

    def _renew(self, residual: int) -> None:
        s = c = self.FULL
        for b in self.open[residual]:
            s &= self.of[b][0]
            c &= self.of[b][1]
        k = self.size + residual
        while True:
            self.sources[k], self.clusters[k] = s, c
            k >>= 1
            if not k:
                break
            s, c = self.sources[2 * k] & self.sources[2 * k + 1], self.clusters[2 * k] & self.clusters[2 * k + 1]

    def _search(self, k: int, lo: int, hi: int, need: int, source: int, cluster: int) -> int:
        """The tightest bin with room in node k (residuals lo..hi-1) that holds neither bit, or -1."""
        stack = [(k, lo, hi)]
        while stack:
            k, lo, hi = stack.pop()
            if hi <= need or self.sources[k] & source or self.clusters[k] & cluster:
                continue
            if hi - lo > 1:
                mid = (lo + hi) // 2
                stack.append((2 * k + 1, mid, hi))
                stack.append((2 * k, lo, mid))
                continue
            for b in self.open[lo]:
                if not (self.of[b][0] & source or self.of[b][1] & cluster):
                    return b
        return -1

    def place(self, need: int, source: int, cluster: int) -> int:
        """Put a piece of `need` words with these bits into the tightest compatible bin, or a new one."""
        b = self._search(1, 0, self.size, need, source | 1, cluster | 1) if need else -1
        if b < 0:
            b = len(self.of)
            self.of.append((source, cluster))
            self.left.append(self.capacity - need)
        else:
            old = self.left[b]
            self.open[old].remove(b)
            self._renew(old)
            self.of[b] = (self.of[b][0] | source, self.of[b][1] | cluster)
            self.left[b] = old - need
        if self.left[b] > 0:
            self.open[self.left[b]].append(b)
            self._renew(self.left[b])
        return b


def pack_shard(need: list[int], source: list, cluster: list, capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Bin of each piece, its slot in the bin, and the words in each bin. Pieces are taken largest first.

    A null source or cluster conflicts with nothing.
    """
    bits: tuple[dict, dict] = ({}, {})
    bins, number = Bins(capacity), []
    where, slots = [0] * len(need), [0] * len(need)
    for i in sorted(range(len(need)), key=lambda i: -need[i]):
        own = [0 if x is None else 2 << seen.setdefault(x, len(seen)) for x, seen in zip((source[i], cluster[i]), bits, strict=True)]
        b = bins.place(need[i], *own)
        if b == len(number):
            number.append(0)
        where[i], slots[i] = b, number[b]
        number[b] += 1
    return where, slots, [capacity - x for x in bins.left]


def pack(docs: DataFrame, id_col: str = "doc_id", length: str = "n_words", source: str | None = "source", cluster: str | None = None, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """One row per piece: its document, place in the document, bin and slot.

    A document longer than `capacity` is cut into pieces of that many words and a last, shorter one. No bin holds two
    pieces of one source or of one duplicate cluster (nor, then, two pieces of one document with a cluster). Each piece
    goes to the tightest bin that has room and no conflict, largest pieces first.

    Pieces are dealt to shards by a hash of id and piece, about `shard_pieces` to a shard, so a source with a third of
    all rows is spread over all shards and a shard's work is bounded; a bin lies within one shard and is named
    (shard, bin). How many shards there are depends on the pieces alone, not on the cluster. Bins of which less than
    WELL_FILLED is used are taken apart, and the pieces of all shards' poor bins are dealt and packed once more, in shards
    with numbers of their own. Documents without words take no room and get a bin of their own kind: they are listed
    with bin -1. Null ids are packed like others, repeated rows each on their own, a null length counts as 0. An empty
    table gives an empty one.
    """
    none = F.lit(None).cast("string")
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("row_id"),
        F.greatest(F.coalesce(F.col(f"`{length}`").cast("long"), F.lit(0)), F.lit(0)).alias("n"),
        (F.col(f"`{source}`").cast("string") if source else none).alias("source"),
        (F.col(f"`{cluster}`").cast("string") if cluster else none).alias("cluster"),
    )
    pieces = rows.withColumn("part", F.explode(F.expr(f"sequence(0L, greatest(0L, cast((n - 1) div {capacity} as long)))")))
    pieces = pieces.withColumn("first_word", F.col("part") * capacity).withColumn("n_words", F.least(F.col("n") - F.col("first_word"), F.lit(capacity).cast("long")))
    columns = ["row_id", "part", "first_word", "n_words", "source", "cluster"]

    def dealt(rows: DataFrame, turn: int, before: int) -> tuple[DataFrame, int]:
        shards = max(1, -(-rows.count() // shard_pieces))
        return rows.select(*columns, F.expr(f"cast({before} + pmod(xxhash64('pack', {turn}, row_id, part, source), {shards}) as int)").alias("shard")), before + shards

    def run(table: pa.Table) -> pa.Table:
        order = table.sort_by([("n_words", "descending"), ("row_id", "ascending"), ("part", "ascending"), ("source", "ascending"), ("cluster", "ascending")])
        need = order.column("n_words").to_pylist()
        full = sum(1 for n in need if n > 0)
        where, slots, filled = pack_shard(need[:full], order.column("source").to_pylist()[:full], order.column("cluster").to_pylist()[:full], capacity)
        rest = len(need) - full
        return pa.table(
            [
                *(order.column(c).cast(pa.int64()) for c in ("row_id", "part", "first_word", "n_words")),
                order.column("shard").cast(pa.int32()),
                pa.array(where + [-1] * rest, pa.int32()),
                pa.array(slots + [0] * rest, pa.int32()),
                pa.array([filled[b] for b in where] + [0] * rest, pa.int64()),
                *(order.column(c) for c in ("source", "cluster")),
            ],
            names=["row_id", "part", "first_word", "n_words", "shard", "bin", "slot", "bin_words", "source", "cluster"],
        )

    shape = f"{OUT}, source string, cluster string"
    rows, shards = dealt(pieces, 0, 0)
    first = keep(rows.groupBy("shard").applyInArrow(run, shape), "bins")
    poor = (F.col("bin") >= 0) & (F.col("bin_words") < WELL_FILLED * capacity)
    rows, _ = dealt(first.where(poor), 1, shards)
    both = first.where(~poor).unionByName(rows.groupBy("shard").applyInArrow(run, shape))
    return both.drop("source", "cluster").withColumnRenamed("row_id", "doc_id")


def word_count(text: str = "text"):
    """Words of a text: runs of characters other than the six ASCII blanks; null has none."""
    return F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
