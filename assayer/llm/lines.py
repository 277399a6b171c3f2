"""Removal of repeated lines, judged by overlapping windows of three lines."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.llm.chunks import ASK, answer_later, ask, bucket_count, chunked, is_in, told


def _windows(table: pa.Table, width: int):
    """Two hash words, row, id and first line of every window; the lines of every row."""
    texts = table.column("text").cast(pa.large_binary()).to_pylist()
    ids = table.column("id").to_pylist()
    lines = [[] if t is None else t.split(b"\n") for t in texts]
    digest = xxhash.xxh3_128_digest
    hashed, row, at = [], [], []
    for i, ls in enumerate(lines):
        n = len(ls) - width + 1
        if n > 0 and ids[i] is not None:
            hashed += [digest(b"\n".join(ls[k : k + width])) for k in range(n)]
            row.append(np.full(n, i))
            at.append(np.arange(n))
    h = np.frombuffer(b"".join(hashed), np.uint64).reshape(-1, 2)
    row = np.concatenate(row) if row else np.zeros(0, np.int64)
    at = np.concatenate(at) if at else np.zeros(0, np.int64)
    owner = np.array([0 if x is None else x for x in ids], np.int64)[row] if len(row) else np.zeros(0, np.int64)
    return h[:, 0].copy(), h[:, 1].copy(), row, owner, at, lines


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """Remove the lines covered by a window of `width` consecutive lines that occurred before.

    Returns all columns of `docs`, with `text` rewritten, plus n_lines and n_removed. Lines are cut at newlines and
    compared byte by byte. The first occurrence is that of the smallest (id, line number), over the whole table; every
    other window's lines go, overlapping windows merging to one set of covered lines. Windows are judged on the input.
    Texts of fewer lines stay as they are.

    Null text has no lines and stays null. A row with null id loses nothing and takes nothing. Repeated rows (equal
    ids) hold the same places, so they do not take from each other. An empty table gives an empty one.
    """
    rows = chunked(docs, id_col, text)
    buckets = bucket_count(docs)

    def windows(table: pa.Table) -> pa.Table:
        h1, h2, _, owner, at, _ = _windows(table, width)
        return ask(table.column("chunk")[0].as_py(), buckets, h1, h2, owner, at)

    fields = rows.schema["row"].dataType
    out_schema = T.StructType([T.StructField("row", fields), T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())])

    def act(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table([pa.array([], t) for t in (left.schema.field("row").type, pa.string(), pa.int64(), pa.int64())], names=out_schema.names)
        h1, h2, row, owner, at, lines = _windows(left, width)
        gone = is_in(h1, told(right))
        order = np.lexsort((at, owner, h2, h1))
        same = np.zeros(len(order), bool)
        same[1:] = (h1[order[1:]] == h1[order[:-1]]) & (h2[order[1:]] == h2[order[:-1]])
        head = order[~same][np.cumsum(~same) - 1] if len(order) else order
        gone[order] |= (owner[order] != owner[head]) | (at[order] != at[head])
        first = np.concatenate(([0], np.cumsum([len(x) for x in lines]))).astype(np.int64)
        cover = np.zeros(first[-1] + 1, np.int64)
        start = first[row[gone]] + at[gone]
        np.add.at(cover, start, 1)
        np.add.at(cover, start + width, -1)
        covered = np.cumsum(cover)[:-1] > 0
        total = np.concatenate(([0], np.cumsum(covered)))
        removed = total[first[1:]] - total[first[:-1]]
        out = left.column("text").to_pylist()
        for i in np.flatnonzero(removed):
            gone_here = covered[first[i] : first[i + 1]].tolist()
            out[i] = b"\n".join([x for x, g in zip(lines[i], gone_here, strict=True) if not g]).decode("utf-8", "replace")
        return pa.table([left.column("row").combine_chunks(), pa.array(out, pa.string()), pa.array(np.diff(first)), pa.array(removed.astype(np.int64))], names=out_schema.names)

    later = answer_later(rows.groupBy("chunk").applyInArrow(windows, ASK))
    done = rows.groupBy("chunk").cogroup(later.groupBy("chunk")).applyInArrow(act, out_schema)
    order = [F.col("text") if c == text else F.col(f"row.`{c}`") for c in docs.columns]
    return done.select(*[c.alias(n) for c, n in zip(order, docs.columns, strict=True)], "n_lines", "n_removed")
