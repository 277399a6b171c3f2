"""Which hashes of a corpus occur elsewhere: asked chunk by chunk, answered chunk by chunk.

Documents are dealt to chunks of bounded size by their id. Each chunk sends every hash it holds once, packed into one
binary row for each hash range; a range finds what several chunks hold and answers each chunk with the hashes that
concern it; the chunk then acts on its own texts. A hash that fills a third of the corpus thus costs one entry for each
chunk, never one for each occurrence, and no list of occurrences is ever gathered.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.store import bounded_batches, chunk_count, partitions

ASK = "bucket int, chunk int, h1 binary, h2 binary, id binary, pos binary"
ANSWER = "chunk int, h1 binary"


def chunked(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(chunk, id, text, row): row holds all other columns as a struct, so that no name can clash."""
    bounded_batches(docs.sparkSession)
    n = chunk_count(docs, text)
    others = [F.col(f"`{c}`") for c in docs.columns if c != text]
    return docs.select(
        F.expr(f"cast(pmod(xxhash64(coalesce(cast(`{id_col}` as long), xxhash64(`{text}`))), {n}) as int)").alias("chunk"),
        F.col(f"`{id_col}`").cast("long").alias("id"),
        F.col(f"`{text}`").alias("text"),
        F.struct(*others).alias("row"),
    ).repartition(partitions(docs.sparkSession), "chunk")


def bucket_count(docs: DataFrame) -> int:
    """Hash ranges: a row goes from each chunk to each range at most, so there are no more of them than tasks need."""
    return partitions(docs.sparkSession)


def _ranges(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers that sorted hashes fall in, and where each begins."""
    b = ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    at = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1]))) if len(b) else np.zeros(0, np.int64)
    return b[at].astype(np.int32), np.concatenate((at, [len(b)]))


def ask(chunk: int, buckets: int, h1: np.ndarray, h2: np.ndarray | None = None, ids: np.ndarray | None = None, pos: np.ndarray | None = None) -> pa.Table:
    """One row for each range with the chunk's hashes, each once. With ids: each hash's least (id, pos) goes along."""
    zero = np.zeros(len(h1), np.int64)
    keys = [h1] if h2 is None else [zero if pos is None else pos, ids, h2, h1]
    order = np.lexsort(keys) if len(keys) > 1 else np.argsort(h1)
    new = np.ones(len(order), bool)
    new[1:] = h1[order[1:]] != h1[order[:-1]]
    if h2 is not None:
        new[1:] |= h2[order[1:]] != h2[order[:-1]]
    order = order[new]
    b, cut = _ranges(h1[order], buckets)
    pack = lambda x: [x[order[a:z]].tobytes() for a, z in zip(cut[:-1], cut[1:], strict=True)] if x is not None else [None] * len(b)
    return pa.table([pa.array(b, pa.int32()), pa.array([chunk] * len(b), pa.int32()), *(pa.array(pack(x), pa.binary()) for x in (h1, h2, ids, pos))], names=["bucket", "chunk", "h1", "h2", "id", "pos"])


def _column(table: pa.Table, name: str, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(x or b"" for x in table.column(name).to_pylist()), kind)


def _answers(chunk: np.ndarray, h1: np.ndarray) -> pa.Table:
    order = np.argsort(chunk, kind="stable")
    chunk, h1 = chunk[order], h1[order]
    at = np.flatnonzero(np.concatenate(([True], chunk[1:] != chunk[:-1]))) if len(chunk) else np.zeros(0, np.int64)
    return pa.table([pa.array(chunk[at], pa.int32()), pa.array([np.sort(x).tobytes() for x in np.split(h1, at[1:])] if len(at) else [], pa.binary())], names=["chunk", "h1"])


def _asked(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    each = np.array([len(x) // 8 for x in table.column("h1").to_pylist()], np.int64)
    return np.repeat(table.column("chunk").to_numpy().astype(np.int32), each), _column(table, "h1", np.uint64)


def answer_shared(asked: DataFrame) -> DataFrame:
    """To each chunk: its hashes that another chunk also asked about, or that it marked itself (lowest bit set)."""

    def run(table: pa.Table) -> pa.Table:
        chunk, h = _asked(table)
        plain = h & ~np.uint64(1)
        order = np.argsort(plain)
        p = plain[order]
        start = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1])))
        size = np.diff(np.concatenate((start, [len(p)])))
        marked = np.maximum.reduceat(h[order] & np.uint64(1), start) > 0
        shared = np.repeat((size > 1) | marked, size)
        return _answers(chunk[order[shared]], p[shared])

    return asked.groupBy("bucket").applyInArrow(run, ANSWER)


def answer_later(asked: DataFrame) -> DataFrame:
    """To each chunk: its hashes of which another chunk holds the least (id, pos)."""

    def run(table: pa.Table) -> pa.Table:
        chunk, h1 = _asked(table)
        h2, ids = _column(table, "h2", np.uint64), _column(table, "id", np.int64)
        pos = _column(table, "pos", np.int64)
        order = np.lexsort((pos if len(pos) else ids, ids, h2, h1))
        later = np.zeros(len(order), bool)
        later[1:] = (h1[order[1:]] == h1[order[:-1]]) & (h2[order[1:]] == h2[order[:-1]])
        return _answers(chunk[order[later]], h1[order[later]])

    return asked.groupBy("bucket").applyInArrow(run, ANSWER)


def told(table: pa.Table) -> np.ndarray:
    """All hashes of a chunk's answers, sorted."""
    return np.sort(_column(table, "h1", np.uint64))


def is_in(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known) or not len(h):
        return np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return known[at] == h
