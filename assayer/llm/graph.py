"""Connected components of an edge table, as rounds of joins and partial aggregates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.store import keep, release


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the smallest node that can be reached.

    Alternates two star operations until the table stands still: each node's larger neighbours, then its smaller
    ones, are linked to the smallest node it sees. Rounds grow with the logarithm of the longest path. Minima are
    combined before the shuffle, so a hub with a third of all edges costs one row for each task, and the join back
    is left to adaptive skew splitting. Each round is a written table. Null ends and loops are left out.
    """
    e = keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        low = large.where("a <> b").distinct()
        root = low.groupBy("a").agg(F.min("b").alias("m"))
        small = low.join(root, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(root.withColumnRenamed("m", "b"))
        old, e = e, keep(small.where("a <> b").distinct(), "edges")
        release(old)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == mark:
            break
        mark = now
    out = e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    out._kept = e._kept
    return out


def meetings(placed: DataFrame, half: int) -> DataFrame:
    """(tile, node, side) in which nodes of one key that are in different groups meet; placed: (key, node, root, weight).

    A group of `half` or more (in weights) is cut into parts of its own, the rest of a key into parts that mix whole small
    groups. Two parts of one key meet, side 1 with side 2, unless both are of the same large group; a mixed part also
    meets itself, as side 0. So a large group is compared with the strays in its bucket, not with itself.
    """
    placed = keep(placed, "placed")  # its readers are lazy, so these tables stay with the session
    sizes = keep(placed.groupBy("key", "root").agg(F.sum("weight").alias("size")), "sizes")
    live = sizes.groupBy("key").agg(F.count("*").alias("roots"), F.sum(F.when(F.col("size") < half, F.col("size")).otherwise(0)).alias("small")).where("roots > 1")
    where = sizes.join(live, "key").select("key", "root", "size", "small")
    alone = F.col("size") >= half
    part = F.when(alone, F.expr(f"pmod(xxhash64(node, 3), cast(ceil(size / {half}) as long))")).otherwise(F.expr(f"pmod(xxhash64(root, 5), greatest(1L, cast(ceil(small / {half}) as long)))"))
    parted = placed.join(where, ["key", "root"]).select("key", "node", F.when(alone, F.col("root")).alias("of"), part.alias("part"))
    parted = keep(parted.withColumn("piece", F.xxhash64(F.col("of").isNull(), F.coalesce("of", F.lit(0)), "part")), "parted")
    pieces = parted.select("key", "piece", "of").distinct()
    other = pieces.select("key", F.col("piece").alias("piece2"), F.col("of").alias("of2"))
    meet = pieces.join(other, "key").where("piece <= piece2 and coalesce(of <> of2, true)").where("piece < piece2 or of is null")
    one, two = F.array(F.struct("piece", F.lit(0).alias("side"))), F.array(F.struct("piece", F.lit(1).alias("side")), F.struct(F.col("piece2").alias("piece"), F.lit(2).alias("side")))
    meet = meet.select("key", F.xxhash64("key", "piece", "piece2").alias("tile"), F.explode(F.when(F.col("piece") == F.col("piece2"), one).otherwise(two)).alias("m"))
    return parted.join(meet.select("key", "tile", "m.piece", "m.side"), ["key", "piece"]).select("tile", "node", "side")


def local_roots(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Join the pairs (i, j) to the groups that `root` holds; each node's root is its group's smallest index."""
    root = root.copy()
    while len(i):
        a, b = root[i], root[j]
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        live = lo < hi
        if not live.any():
            break
        i, j = i[live], j[live]
        np.minimum.at(root, hi[live], lo[live])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root
