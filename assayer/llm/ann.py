"""Nearest neighbours by inner product: hierarchical k-means tree, best-bin-first visits, calibrated recall."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm.store import keep

#: Distinct vectors that the tree is fitted on, at most; children of a node; vectors a leaf should hold; leaves at most.
SAMPLE, BRANCH, LEAF, MOST_LEAVES = 20_000, 16, 200, 1024
#: Recall to reach on the calibration queries, and how many of those there are.
RECALL, TRIALS = 0.96, 400
#: Members and queries that meet in one task, and queries multiplied at a time.
PIECE_MEMBERS, PIECE_QUERIES, BLOCK_QUERIES = 16_384, 2048, 128


def taking_part(v: Column) -> Column:
    """Not null, not zero, and no component null or not finite."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


@dataclass
class Tree:
    """Nodes of a k-means hierarchy: centre, first child (-1 for a leaf), children, leaf number."""

    centre: np.ndarray
    child: np.ndarray
    children: np.ndarray
    leaf: np.ndarray
    visits: int = 1

    @property
    def leaves(self) -> int:
        return int((self.child < 0).sum())

    def assign(self, v: np.ndarray) -> np.ndarray:
        """Leaf of each vector: the nearest child at every level."""
        at = np.zeros(len(v), np.int64)
        while True:
            inner = np.flatnonzero(self.child[at] >= 0)
            if not len(inner):
                return self.leaf[at]
            for node in np.unique(at[inner]):
                rows = inner[at[inner] == node]
                c = self.centre[self.child[node] : self.child[node] + self.children[node]]
                near = v[rows] @ c.T - 0.5 * (c * c).sum(axis=1)
                at[rows] = self.child[node] + near.argmax(axis=1)

    def visit(self, q: np.ndarray, most: int) -> list[int]:
        """The first `most` leaves in best-bin-first order: the open node of largest inner product is taken next."""
        heap, out = [(0.0, 0)], []
        while heap and len(out) < most:
            _, node = heapq.heappop(heap)
            a = int(self.child[node])
            if a < 0:
                out.append(int(self.leaf[node]))
                continue
            for k, near in enumerate((self.centre[a : a + int(self.children[node])] @ q).tolist()):
                heapq.heappush(heap, (-near, a + k))
        return out


def _means(v: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    c = v[rng.choice(len(v), k, replace=False)].copy()
    for _ in range(rounds):
        own = (v @ c.T - 0.5 * (c * c).sum(axis=1)).argmax(axis=1)
        size = np.bincount(own, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, own, v)
        c = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], c)
    return c, (v @ c.T - 0.5 * (c * c).sum(axis=1)).argmax(axis=1)


def fit_tree(sample: np.ndarray, leaf_size: float, top: int, seed: int = 0) -> Tree:
    """Split the sample until leaves are small, then widen the visits until enough true neighbours are found.

    Calibration queries are rows of the sample; their `top` nearest in it are found by brute force.
    """
    rng = np.random.Generator(np.random.PCG64(seed))
    centre, child, children, rows = [sample.mean(axis=0) if len(sample) else np.zeros(sample.shape[1])], [-1], [0], [np.arange(len(sample))]
    at = 0
    while at < len(centre):
        if len(rows[at]) > leaf_size:
            k = int(min(BRANCH, max(2, -(-len(rows[at]) // leaf_size)), len(rows[at])))
            c, own = _means(sample[rows[at]], k, rng)
            if len(np.unique(own)) > 1:
                child[at], children[at] = len(centre), k
                for j in range(k):
                    centre.append(c[j]), child.append(-1), children.append(0), rows.append(rows[at][own == j])
        at += 1
    child = np.array(child)
    leaf = np.where(child < 0, np.cumsum(child < 0) - 1, -1)
    tree = Tree(np.array(centre), child, np.array(children), leaf)
    if len(sample) < 2 or tree.leaves == 1:
        return tree
    trial = rng.choice(len(sample), min(TRIALS, len(sample)), replace=False)
    near = sample[trial] @ sample.T
    near[np.arange(len(trial)), trial] = -np.inf
    k = min(top, len(sample) - 1)
    truth = np.argpartition(-near, k - 1, axis=1)[:, :k]
    home = tree.assign(sample)
    rank = np.empty((len(trial), tree.leaves), np.int64)
    for i, t in enumerate(trial):
        rank[i, tree.visit(sample[t], tree.leaves)] = np.arange(tree.leaves)
    needed = rank[np.arange(len(trial))[:, None], home[truth]]
    while tree.visits < tree.leaves and (needed < tree.visits).mean() < RECALL:
        tree.visits = min(tree.leaves, max(tree.visits + 1, int(tree.visits * 1.1)))
    return tree


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1) if len(flat) else np.zeros((0, 1))


def _groups(sizes: dict[int, int]) -> dict[int, tuple[int, int]]:
    """Group and number of pieces of each leaf: neighbouring small leaves share a group, a large one is cut."""
    out, group, held = {}, 0, 0
    for leaf in sorted(sizes):
        if held + sizes[leaf] > PIECE_MEMBERS and held:
            group, held = group + 1, 0
        out[leaf] = (group, max(1, -(-sizes[leaf] // PIECE_MEMBERS)))
        held += sizes[leaf]
    return out


def _best(top: int):
    """The `top` best members for each query among the leaves it visits, of one group of leaves or piece of one."""

    def run(probes: pa.Table, members: pa.Table) -> pa.Table:
        names = ["query_id", "h1", "h2", "first", "score"]
        if not probes.num_rows or not members.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())], names=names)
        q, v = _matrix(probes.column("v")), _matrix(members.column("v"))
        first, leaf = members.column("first").to_numpy(), members.column("leaf").to_numpy()
        visits = probes.column("leaves").to_pylist()
        left, right, scores = [], [], []
        for lo in range(0, len(q), BLOCK_QUERIES):
            part = q[lo : lo + BLOCK_QUERIES]
            open_ = np.zeros((len(part), int(leaf.max()) + 1), bool)
            for r, seen in enumerate(visits[lo : lo + BLOCK_QUERIES]):
                open_[r, [x for x in seen if x < open_.shape[1]]] = True
            near = np.where(open_[:, leaf], part @ v.T, -np.inf)
            k = min(top, len(v))
            bar = np.partition(near, len(v) - k, axis=1)[:, len(v) - k]
            slack = np.where(np.isfinite(bar), 1e-9 * np.maximum(1, np.abs(bar)), 0)
            i, j = np.nonzero((near >= (bar - slack)[:, None]) & np.isfinite(near))
            score = (part[i] * v[j]).sum(axis=1)
            order = np.lexsort((first[j], -score, i))
            place = np.arange(len(order)) - np.searchsorted(i[order], i[order])
            best = order[place < top]
            left.append(lo + i[best]), right.append(j[best]), scores.append(score[best])
        i, j = np.concatenate(left), np.concatenate(right)
        take = lambda t, c, at: t.column(c).take(pa.array(at)).combine_chunks()
        return pa.table([take(probes, "query_id", i), *(take(members, c, j) for c in ("h1", "h2", "first")), pa.array(np.concatenate(scores))], names=names)

    return run


def neighbours(vectors: DataFrame, queries: Column, top: int = 20, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where `queries` holds, its `top` nearest other rows found.

    Nearness is the inner product in double precision; equal scores go by smaller id. Fewer rows are returned where
    there are fewer candidates. Vectors that are null, zero, or hold a null or non-finite component take no part, nor do
    rows with a null id or vectors of another length than the commonest one. Repeated ids are rows of their own, but a
    row is never its own id's neighbour. An empty table gives an empty result.

    The tree is fitted on a sample of SAMPLE distinct vectors chosen by hash; every row is indexed. Equal vectors are one entry,
    so a vector that a third of all rows share costs one row, and at most top + 1 of its ids are ever listed.
    Small leaves share a task, large ones and the queries are cut into pieces of bounded size that meet in separate
    tasks; a task leaves top + 1 rows for each of its queries, however many leaves it holds.
    """
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").alias("v"), queries.alias("asks")).where(F.col("vec_id").isNotNull() & taking_part(F.col("v")))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = sizes["d"] if sizes else 1
    rows = rows.where(F.size("v") == dim).withColumn("v", F.transform("v", lambda x: x.cast("double") + F.lit(0.0)))
    rows = rows.withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(1), "v"))
    classes = keep(rows.groupBy("h1", "h2").agg(F.min("vec_id").alias("first"), F.any_value("v").alias("v")), "vectors")
    total = classes.count()
    sample = _matrix(classes.orderBy("h2", "h1").limit(SAMPLE).select("v").toArrow().column("v")) if total else np.zeros((0, 1))
    leaves = min(MOST_LEAVES, max(1, total // LEAF))
    spark = vectors.sparkSession
    tree = spark.sparkContext.broadcast(fit_tree(sample, max(8.0, len(sample) / leaves), top))

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf = tree.value.assign(_matrix(b.column(3))) if b.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf.astype(np.int32))], ["h1", "h2", "first", "v", "leaf"])

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = [tree.value.visit(q, tree.value.visits) for q in _matrix(b.column(1))] if b.num_rows else []
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(seen, pa.list_(pa.int32()))], ["query_id", "v", "leaves"])

    member = keep(classes.select("h1", "h2", "first", "v").mapInArrow(homes, "h1 long, h2 long, first long, v array<double>, leaf int"), "members")
    asked = keep(rows.where("asks").select(F.col("vec_id").alias("query_id"), "v").distinct().mapInArrow(paths, "query_id long, v array<double>, leaves array<int>"), "asked")
    # one row for each leaf, MOST_LEAVES at most
    counted = {r["leaf"]: r["count"] for r in member.groupBy("leaf").count().collect()}
    deal = _groups(counted)
    layout = spark.createDataFrame([(leaf, g, m) for leaf, (g, m) in deal.items()], "leaf int, g long, m int")
    probe = asked.select("query_id", "v", F.explode("leaves").alias("leaf")).join(F.broadcast(layout), "leaf")
    probe = probe.groupBy("query_id", "g").agg(F.any_value("v").alias("v"), F.max("m").alias("m"), F.collect_list("leaf").alias("leaves"))
    pieces = -(-asked.count() // PIECE_QUERIES)
    left = probe.select(F.expr("g + 0L").alias("g"), F.expr(f"pmod(xxhash64(query_id), {max(1, pieces)})").alias("qp"), F.explode(F.expr("sequence(0L, m - 1L)")).alias("mp"), "query_id", "v", "leaves")
    right = member.join(F.broadcast(layout), "leaf").select(F.expr("0L + g").alias("g"), F.explode(F.expr(f"sequence(0L, {max(0, pieces - 1)}L)")).alias("qp"), F.expr("pmod(h2, m)").alias("mp"), "h1", "h2", "first", "v", "leaf")
    found = left.groupBy("g", "qp", "mp").cogroup(right.groupBy("g", "qp", "mp")).applyInArrow(_best(top + 1), "query_id long, h1 long, h2 long, first long, score double")
    each = Window.partitionBy("query_id").orderBy(F.desc("score"), "first")
    found = found.withColumn("r", F.row_number().over(each)).where(F.col("r") <= top + 1).drop("r")
    ids = rows.select("h1", "h2", "vec_id")
    for salt in (64, 8, 1):  # the smallest top + 1 ids of each distinct vector, hot ones by parts
        part = Window.partitionBy("h1", "h2", F.expr(f"pmod(xxhash64(vec_id), {salt})")).orderBy("vec_id")
        ids = ids.withColumn("r", F.row_number().over(part)).where(F.col("r") <= top + 1).drop("r")
    all_found = found.join(ids, ["h1", "h2"]).where("vec_id <> query_id")
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return all_found.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
