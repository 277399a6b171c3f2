"""Exact Jaccard links of word n-gram sets, found with R-trees over group counts.

1. A table of SLOTS counters tells how common each n-gram is, to a STEPS-th of a doubling: in a large corpus every slot is
   full of n-grams that occur once, and a passage of hundreds of documents must still stand out. Each document offers its
   rarest n-grams, just so many that two sets of the wanted similarity must have one of them in common whatever they are;
   documents meet in the buckets of what they offer.
2. The n-grams of a set are hashed into groups, and the group counts are a point: GROUPS of them, for a large set so many
   more that PER_GROUP n-grams fall into one. In each bucket an R-tree holds the points, folded to GROUPS: a box keeps the
   largest count of each group and the smallest set size. Two sets share at most the sum of the smaller counts, two boxes
   no more than the sum over their corners; pairs whose bound is too small are left out, pairs of large sets once more
   by their finer points. A bucket of more than WIDE points is cut into pieces, of which those meet that are not
   connected after all pieces are done.
3. What survives is gathered by connected candidates, so a set stands in one room however many buckets it shares with the
   others there, and verified from the sets themselves, again down an R-tree. Pairs that are already in one group are not
   looked at. A large room is cut into pieces twice, at random, which connects a large group; only the rest meets again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.graph import components, local_roots, meetings
from assayer.llm.store import bounded_batches, keep, partitions, release
from assayer.llm.words import mix, shingles, slices, texts_of

#: Words of an n-gram; two sets link at so many hundredths of their union.
WIDTH, PERCENT = 4, 85
#: Counters of n-grams, levels of a doubling, and how many doublings over the median make one hot.
SLOTS, STEPS, HOT = 1 << 19, 6, 5
#: Groups of a point, n-grams of a large set in one.
GROUPS, PER_GROUP = 128, 20
#: Sets, and n-grams in them, that are compared in one task; so many times the sets are points; members of a leaf and of a box.
TILE, TILE_GRAMS, WIDE, FAN = 512, 4 << 20, 4, 16
#: 64-bit words of the table that tells which texts are read again.
WORDS = 1 << 17


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)


def rarity(docs: DataFrame, text: str = "text", width: int = WIDTH) -> np.ndarray:
    """For each slot of n-gram hashes the doublings in its count in all documents, in STEPS-ths, repeats within one included.

    Each task counts by itself and sends its counters in blocks, so what is moved depends on the tasks, not on the text.
    """
    block = 1 << 16

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for b in batches:
            texts = [t.lower() for t in texts_of(b.column(0))]
            for lo, hi in slices(texts, 1 << 18):
                total += np.bincount(_slot(shingles(texts[lo:hi], width)[0]), minlength=SLOTS)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(SLOTS // block), pa.int32()), pa.array([x.tobytes() for x in total.reshape(-1, block)])], ["block", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in table.column("counts").to_pylist())
        level = np.minimum(STEPS * np.log2(total + 1), 255).astype(np.uint8)
        return pa.table([table.column("block").slice(0, 1), pa.array([level.tobytes()])], names=["block", "level"])

    told = docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(count, "block int, counts binary").groupBy("block").applyInArrow(add, "block int, level binary")
    level = np.zeros(SLOTS, np.uint8)
    for row in told.collect():  # SLOTS bytes in all
        level[row["block"] * block : (row["block"] + 1) * block] = np.frombuffer(row["level"], np.uint8)
    return level


def offered(size: int, percent: int) -> int:
    """So many of a set's n-grams that a set of the wanted similarity has one of them."""
    return size + (-percent * size) // 100 + 1


def _node(h: np.ndarray) -> int:
    return int(mix(np.array([mix(h + np.uint64(1)).sum(dtype=np.uint64) ^ np.uint64(len(h))], np.uint64)).view(np.int64)[0])


def _point(grams: np.ndarray) -> bytes:
    n = GROUPS
    while n * PER_GROUP < len(grams):
        n *= 2
    return np.bincount((grams % np.uint64(n)).astype(np.int64), minlength=n).astype(np.int32).tobytes()


def _packed(point: bytes) -> bytes:
    """A point as it is moved: a byte for a count, or four and one more at the end if a count needs them."""
    counts = np.frombuffer(point, np.int32)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else point + b"\0"


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw[:-1], np.int32) if len(raw) % 2 else np.frombuffer(raw, np.uint8).astype(np.int32)


def _fold(point: np.ndarray, groups: int) -> np.ndarray:
    """The counts of fewer groups; both numbers are powers of two times GROUPS."""
    return point.reshape(-1, groups).sum(axis=0)


def _prints(docs: DataFrame, id_col: str, text: str, width: int, percent: int) -> DataFrame:
    """(id, text_key, node, n, point, cold, hot): of each row its set's name, size, point, and what it offers.

    Equal sets have one node; only the first of a task offers for it. Offers in hot slots stand apart. No word: n is 0.
    """
    spark = docs.sparkSession
    level = spark.sparkContext.broadcast(rarity(docs, text, width))
    hot = int(np.median(level.value[level.value > 0])) + STEPS * HOT if level.value.any() else STEPS * HOT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            texts = [t.lower() for t in texts_of(b.column(2))]
            for lo, hi in slices(texts, 1 << 18):
                h, to = shingles(texts[lo:hi], width)
                node, size, points, cold, common = [], [], [], [], []
                for a, z in zip(to[:-1], to[1:], strict=True):
                    u = np.unique(h[a:z])
                    node.append(_node(u)), size.append(len(u))
                    if not len(u) or node[-1] in seen:
                        points.append(None), cold.append(None), common.append(None)
                        continue
                    seen.add(node[-1])
                    points.append(_packed(_point(u)))
                    rare = level.value[_slot(u)]
                    n = offered(len(u), percent)
                    best = np.argpartition((rare.astype(np.uint64) << np.uint64(56)) | (u >> np.uint64(8)), n - 1)[:n]
                    is_hot = rare[best] >= hot
                    cold.append(u[best][~is_hot].view(np.int64)), common.append(u[best][is_hot].view(np.int64))
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(node, pa.int64()), pa.array(size, pa.int64()), pa.array(points, pa.binary()), pa.array(cold, longs), pa.array(common, longs)],
                    ["id", "text_key", "node", "n", "point", "cold", "hot"],
                )

    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("text_key"), F.col(f"`{text}`").alias("text"))
    return src.mapInArrow(run, "id long, text_key long, node long, n long, point binary, cold array<long>, hot array<long>")


def _not_alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by token and node those whose token has another node, each once."""
    token, node, told = np.zeros(0, np.int64), np.zeros(0, np.int64), False
    for b in batches:
        t, n = (np.concatenate(x) for x in ((token, b.column(0).to_numpy()), (node, b.column(1).to_numpy())))
        new = np.ones(len(t), bool)
        new[1:] = (t[1:] != t[:-1]) | (n[1:] != n[:-1])
        t, n = t[new], n[new]
        if not len(t):
            continue
        twin = t[1:] == t[:-1]
        live = np.append(twin, False)
        live[1:] |= twin
        out = live.copy()
        out[0] &= not told
        yield pa.RecordBatch.from_arrays([pa.array(t[out]), pa.array(n[out])], ["token", "node"])
        token, node, told = t[-1:], n[-1:], bool(live[-1]) or (told and len(t) == 1)


class Tree:
    """An R-tree over points: members in order of halving at the widest coordinate, boxes over FAN of them, and so on up.

    A box keeps the largest count of each coordinate, and the smallest and largest size.
    """

    def __init__(self, points: np.ndarray, sizes: np.ndarray) -> None:
        self.order = self._halve(points, np.argsort(sizes, kind="stable"))
        top, low, high = points[self.order], sizes[self.order], sizes[self.order]
        self.levels = [(top, low, high)]
        while len(top) > 1:
            cut = np.arange(0, len(top), FAN)
            top, low, high = np.maximum.reduceat(top, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)
            self.levels.append((top, low, high))

    @staticmethod
    def _halve(points: np.ndarray, rows: np.ndarray) -> np.ndarray:
        out, stack = [], [rows]
        while stack:
            rows = stack.pop()
            if len(rows) <= FAN:
                out.append(rows)
                continue
            part = points[rows]
            half = -(-len(rows) // 2 // FAN) * FAN
            order = rows[np.argsort(part[:, np.argmax(part.max(axis=0) - part.min(axis=0))], kind="stable")]
            stack += [order[half:], order[:half]]
        return np.concatenate(out) if out else rows

    def pairs(self, percent: int, chunk: int = 1 << 14) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of members whose bound reaches the similarity, by position in the tree's order."""
        i = j = np.zeros(1, np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            top, low, high = self.levels[depth]
            good = [np.zeros(0, bool)]
            for lo in range(0, len(i), chunk):
                a, b = i[lo : lo + chunk], j[lo : lo + chunk]
                bound = np.minimum(np.minimum(top[a], top[b]).sum(axis=1), np.minimum(high[a], high[b]))
                good.append((100 + percent) * bound >= percent * (low[a] + low[b]))
            good = np.concatenate(good)
            i, j = i[good], j[good]
            if not depth:
                break
            below = len(self.levels[depth - 1][1])
            kids = np.arange(FAN)
            i, j = (i[:, None, None] * FAN + kids[None, :, None]), (j[:, None, None] * FAN + kids[None, None, :])
            i, j = (x.ravel() for x in np.broadcast_arrays(i, j))
            fit = (i < below) & (j < below) & ((i <= j) if depth > 1 else (i < j))
            i, j = i[fit], j[fit]
        return (i, j) if len(self.levels) > 1 else (np.zeros(0, np.int64),) * 2


def candidates(points: np.ndarray, sizes: np.ndarray, side: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows whose bound reaches the similarity, neighbours in the tree first; side 1 meets side 2 only."""
    tree = Tree(points, sizes)
    i, j = tree.pairs(percent)
    order = np.argsort(j - i, kind="stable")
    i, j = tree.order[i[order]], tree.order[j[order]]
    ok = (side[i] != side[j]) | (side[i] == 0)
    return i[ok], j[ok]


def likely(points: list[np.ndarray], sizes: np.ndarray, side: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidates over folded points, pairs of large sets also over the finest points that both have."""
    i, j = candidates(np.array([_fold(p, GROUPS) for p in points], np.int64).reshape(-1, GROUPS), sizes, side, percent)
    fine = np.minimum(*(np.array([len(p) for p in points], np.int64)[k] for k in (i, j)))
    good = np.ones(len(i), bool)
    for k in np.flatnonzero(fine > GROUPS):
        a, b = i[k], j[k]
        bound = int(np.minimum(_fold(points[a], fine[k]), _fold(points[b], fine[k])).sum())
        good[k] = (100 + percent) * bound >= percent * (sizes[a] + sizes[b])
    return i[good], j[good]


def verified(points: list[np.ndarray], sets: list[np.ndarray], side: np.ndarray, percent: int, chunk: int = 128) -> np.ndarray:
    """The group of each row over links between exact sets; pairs that are in one group already are passed over."""
    sizes = np.array([len(x) for x in sets], np.int64)
    i, j = likely(points, sizes, side, percent)
    root = np.arange(len(sets))
    lo = 0
    while lo < len(i):
        a, b = i[lo:], j[lo:]
        open_ = np.flatnonzero(root[a] != root[b])[:chunk]
        if not len(open_):
            break
        linked = []
        for x, y in zip(a[open_].tolist(), b[open_].tolist(), strict=True):
            u, v = (sets[x], sets[y]) if sizes[x] < sizes[y] else (sets[y], sets[x])
            at = np.searchsorted(v, u)
            at[at == len(v)] = 0
            both = int((v[at] == u).sum())
            linked.append(100 * both >= percent * (len(u) + len(v) - both))
        hit = open_[np.array(linked)]
        root = local_roots(root, a[hit], b[hit])
        lo += int(open_[-1]) + 1
    return root


def _columns(table: pa.Table) -> tuple:
    tile, node, side = (table.column(c).to_numpy() for c in ("tile", "node", "side"))
    order = np.lexsort((node, tile))
    raw = table.column("point").to_pylist()
    points = [_unpacked(raw[k]) for k in order]
    cuts = np.flatnonzero(np.concatenate(([True], tile[order][1:] != tile[order][:-1], [True]))) if len(tile) else np.zeros(1, np.int64)
    return order, node[order], side[order], points, cuts


def _edges(node: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]]) -> pa.Table:
    a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 2
    return pa.table([pa.array(node[a]), pa.array(node[b])], names=["a", "b"])


def _may_link(percent: int):
    """Edges that join, in each bucket, what the bounds leave."""

    def run(table: pa.Table) -> pa.Table:
        order, node, side, points, cuts = _columns(table)
        sizes, out = table.column("n").to_numpy()[order], []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            i, j = likely(points[lo:hi], sizes[lo:hi], side[lo:hi], percent)
            root = local_roots(np.arange(hi - lo), i, j)
            moved = np.flatnonzero(root != np.arange(hi - lo))
            out.append((lo + moved, lo + root[moved]))
        return _edges(node, out)

    return run


def _do_link(percent: int):
    """Edges that join, in each tile, what is linked."""

    def run(table: pa.Table) -> pa.Table:
        order, node, side, points, cuts = _columns(table)
        grams = table.column("grams").to_pylist()
        sets, out = [np.frombuffer(grams[k], np.uint64) for k in order], []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            root = verified(points[lo:hi], sets[lo:hi], side[lo:hi], percent)
            moved = np.flatnonzero(root != np.arange(hi - lo))
            out.append((lo + moved, lo + root[moved]))
        return _edges(node, out)

    return run


def _asked_for(texts: DataFrame, tiles: DataFrame) -> DataFrame:
    """The rows of texts whose text_key is one of the tiles', and few others, so that those need not be moved.

    A bit for each key in a table of at most WORDS rows; a bit that keys share lets a text through that the join drops.
    """
    word, bit = F.expr(f"pmod(text_key, {WORDS})"), "shiftleft(1L, cast(pmod(shiftright(text_key, 40), 64) as int))"
    asked = tiles.groupBy(word.alias("word")).agg(F.expr(f"bit_or({bit})").alias("bits"))
    return texts.withColumn("word", word).join(F.broadcast(asked), "word").where(f"bits & {bit} <> 0").drop("word", "bits")


def _with_sets(docs: DataFrame, text: str, tiles: DataFrame, width: int) -> DataFrame:
    """(tile, node, side, n, point, grams): each tile's sets, from a second read of the texts, which are found by their hash.

    Copies of a text fall together before it is hashed. The join is by sorting whatever the sizes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.lower() for t in texts_of(b.column(3))]
            for lo, hi in slices(texts, 1 << 18):
                h, to = shingles(texts[lo:hi], width)
                sets = [np.unique(h[a:z]) for a, z in zip(to[:-1], to[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(k).slice(lo, hi - lo) for k in range(3)), pa.array([len(u) for u in sets], pa.int64()), pa.array([_packed(_point(u)) for u in sets], pa.binary()), pa.array([u.tobytes() for u in sets], pa.binary())],
                    ["tile", "node", "side", "n", "point", "grams"],
                )

    src = docs.select(F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("text_key"), F.col(f"`{text}`").alias("text"))
    found = _asked_for(src, tiles).join(tiles.hint("merge"), "text_key").dropDuplicates(["text_key", "tile", "side"])
    return found.select("tile", "node", "side", "text").mapInArrow(run, "tile long, node long, side int, n long, point binary, grams binary")


def links(docs: DataFrame, prints: DataFrame, text: str, width: int, percent: int, tile: int | None = None) -> DataFrame:
    """Edges (a, b) of nodes that connect exactly the sets linked to each other. Tables of the way are removed."""
    spark, tile = docs.sparkSession, tile or TILE
    cold = prints.select(F.explode("cold").alias("token"), "node").repartition(partitions(spark), "token").sortWithinPartitions("token", "node")
    live = cold.mapInArrow(_not_alone, "token long, node long").unionByName(prints.select(F.explode("hot").alias("token"), "node"))
    live = keep(live.distinct(), "offers")
    buckets = live.groupBy("token").agg(F.count("*").alias("m"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("who")).where("m > 1")
    buckets = buckets.groupBy("m", "who").agg(F.min("token").alias("token"))  # tokens of the same sets are one bucket
    member = keep(live.join(buckets.select("token", "m"), "token").select(F.col("token").alias("key"), "node", "m"), "members")
    need = member.select("node").distinct()
    points = prints.where(F.col("point").isNotNull()).join(need, "node", "left_semi").groupBy("node").agg(F.min("text_key").alias("text_key"), F.max("n").alias("n"), F.max("point").alias("point"))
    points = keep(points, "points")

    def groups_of(grams: int, most: int) -> int:
        return max(partitions(spark), -(-grams // most))

    offer = points.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    wide = WIDE * tile

    def near(tiles: DataFrame) -> DataFrame:
        rows = tiles.join(points.select("node", "n", "point"), "node")
        groups = max(groups_of(offer, 4 * TILE_GRAMS), tiles.count() >> 16)
        dealt = rows.withColumn("g", F.pmod(F.xxhash64("tile", F.lit(9)), F.lit(groups)))
        return dealt.groupBy("g").applyInArrow(_may_link(percent), "a long, b long").distinct()

    part = F.when(F.col("m") <= wide, F.col("key")).otherwise(F.xxhash64("key", F.expr(f"pmod(xxhash64(node, key), cast(ceil(m / {wide}) as long))")))
    bound = keep(near(member.select(part.alias("tile"), "node", F.lit(0).alias("side"))), "bound")
    large = member.where(f"m > {wide}")
    if not large.isEmpty():
        rooted = components(bound)
        again = large.join(rooted, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"), F.lit(1.0).alias("weight"))
        again = keep(meetings(again, wide // 2), "meetings")
        if not again.isEmpty():
            first, bound = bound, keep(bound.unionByName(near(again)), "bound")
            release(first)
        release(rooted, again)
    candidate = components(bound)
    together = candidate.select(F.xxhash64("root", F.lit(1)).alias("key"), "node")
    rough = keep(together.join(points.select("node", "n", "text_key"), "node"), "rooms")
    sizes = rough.groupBy("key").agg(F.greatest(F.ceil(F.count("*") / tile), F.ceil(F.sum("n") / TILE_GRAMS)).alias("pieces"))
    rooms = keep(rough.join(sizes, "key"), "rooms")
    release(live, member, bound, rough, candidate)

    def edges(tiles: DataFrame) -> DataFrame:
        grams = tiles.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        sets = _with_sets(docs, text, tiles, width)
        dealt = sets.withColumn("g", F.pmod(F.xxhash64("tile", F.lit(9)), F.lit(groups_of(grams, TILE_GRAMS))))
        return dealt.groupBy("g").applyInArrow(_do_link(percent), "a long, b long").distinct()

    deals = rooms.withColumn("deal", F.explode(F.when(F.col("pieces") > 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    piece = F.xxhash64("key", "deal", F.expr("pmod(xxhash64(node, key, deal), pieces)"))
    found = keep(edges(deals.select("text_key", piece.alias("tile"), "node", F.lit(0).alias("side"), "n")), "links")
    if rooms.where("pieces > 1").isEmpty():  # every key was compared whole
        release(points, rooms)
        return found
    rooted = components(found)
    cut = rooms.where("pieces > 1").join(rooted, "node", "left")
    cut = cut.select("key", "node", F.coalesce("root", "node").alias("root"), F.greatest(F.lit(1.0), F.col("n") * (tile / TILE_GRAMS)).alias("weight"))
    again = keep(meetings(cut, max(tile // 2, 1)).join(points.select("node", "n", "text_key"), "node"), "meetings")
    out = found
    if not again.isEmpty():  # no piece has anything left to meet otherwise, and texts need not be read again
        out = keep(found.unionByName(edges(again)), "links")
        release(found)
    release(points, rooms, rooted, again)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row per row: (doc_id, n_shingles, component_id), over exact Jaccard links of word n-gram sets.

    A-Z are lower-cased; words are runs of characters other than the six ASCII blanks. A text of fewer words than `width`
    has its whole sequence as its one n-gram; without a word (or null) the set is empty and linked with nothing. Two sets
    link when 100 times their intersection is at least `percent` times their union. component_id is the smallest doc_id
    that links reach; an empty set's is its own id. Repeated rows all stay; a row with null id gets the component of its
    group, null if no row of it has an id. Other columns are left out. An empty table gives an empty one. N-grams are
    compared by 64-bit hashes.
    """
    bounded_batches(docs.sparkSession)
    prints = keep(_prints(docs, id_col, text, width, percent), "prints")
    found = components(links(docs, prints, text, width, percent))
    placed = prints.select("id", "node", "n").join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = placed.where("n > 0").groupBy("root").agg(F.min("id").alias("least"))
    out = placed.join(least, "root", "left")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id")).alias("component_id"))
