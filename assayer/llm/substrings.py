"""Exact removal of long repeated passages, found through difference-cover anchors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.llm.chunks import ANSWER, ASK, answer_later, answer_shared, ask, bucket_count, chunked, is_in, told  # noqa: F401
from assayer.llm.words import texts_of, window_hashes, word_hashes

#: A perfect difference set: every distance modulo PERIOD is the difference of two of its members.
PERIOD = 31
COVER = (0, 1, 3, 8, 12, 18)


def anchor_width(window: int) -> int:
    """Words of an anchor: two equal windows share an aligned anchor that lies wholly inside both."""
    if window <= PERIOD:
        raise ValueError(f"a window needs more than {PERIOD} words")
    return window - PERIOD + 1


def _anchors(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash (lowest bit clear), word position and text of each anchor: those that start at cover positions."""
    h, to = window_hashes(words, first, width, seed=1)
    text = np.repeat(np.arange(len(to) - 1), np.diff(to))
    offset = np.arange(len(h)) - to[text]
    at = np.isin(np.arange(PERIOD), COVER)[offset % PERIOD]
    return h[at] & ~np.uint64(1), (first[text] + offset)[at], text[at]


def _read(table: pa.Table) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    texts = texts_of(table.column("text"))
    words, first = word_hashes(texts)
    known = table.column("id").is_valid().to_numpy()
    ids = table.column("id").fill_null(0).to_numpy()
    return texts, words, first, ids, known


def _candidates(words: np.ndarray, first: np.ndarray, known: np.ndarray, shared: np.ndarray, window: int):
    """Windows that hold a shared anchor in reach: their hashes, texts and first words."""
    h, place, _ = _anchors(words, first, anchor_width(window))
    seen = np.zeros(len(words) + PERIOD + 1, np.int64)
    seen[place[is_in(h, shared)] + 1] = 1
    seen = np.cumsum(seen)
    n = np.maximum(np.diff(first) - window + 1, 0)
    text = np.repeat(np.arange(len(n)), n)
    start = np.arange(len(text)) - (np.cumsum(n) - n)[text] + first[text] if len(text) else np.zeros(0, np.int64)
    ok = (seen[start + PERIOD] > seen[start]) & known[text] if len(text) else np.zeros(0, bool)
    h1, h2 = (window_hashes(words, first, window, seed)[0][ok] for seed in (2, 3))
    return h1, h2, text[ok], start[ok]


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = 50, joined: bool = False) -> DataFrame:
    """Remove every word covered by a window of `window` words that also starts in a document with a smaller id.

    Returns all columns of `docs`, with `text` rewritten, plus n_words and n_removed. Text is what is left, its words
    joined by one space; a text that loses nothing stays as it is, unless `joined`. Words are runs of bytes other than
    the six ASCII blanks, and windows are judged on the input.

    Anchors of window - 30 words are hashed at positions of a difference cover only (6 of 31). Two equal windows agree
    in an anchor at the same place in both, so only windows near an anchor that two documents share are hashed in
    full (128 bits), and the smallest id that holds each decides. Cost is linear however often a passage repeats.

    Null text has no words. A row with null id loses nothing and takes nothing. Repeated rows (equal ids) do not
    take from each other. Texts shorter than a window stay. An empty table gives an empty one.
    """
    rows = chunked(docs, id_col, text)
    buckets = bucket_count(docs)

    def anchors(table: pa.Table) -> pa.Table:
        _, words, first, ids, known = _read(table)
        h, _, owner = _anchors(words, first, anchor_width(window))
        h, owner = h[known[owner]], ids[owner[known[owner]]]
        order = np.lexsort((owner, h))
        h, owner = h[order], owner[order]
        start = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
        last = np.concatenate((start[1:], [len(h)])) - 1 if len(h) else start
        several = (owner[start] != owner[last]).astype(np.uint64)
        return ask(table.column("chunk")[0].as_py(), buckets, h[start] | several)

    def windows(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return ask(0, buckets, *(np.zeros(0, np.uint64),) * 2, np.zeros(0, np.int64))
        _, words, first, ids, known = _read(left)
        h1, h2, owner, _ = _candidates(words, first, known, told(right), window)
        return ask(left.column("chunk")[0].as_py(), buckets, h1, h2, ids[owner])

    fields = T.StructType([*rows.schema["row"].dataType.fields])
    out_schema = T.StructType([T.StructField("row", fields), T.StructField("text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])

    def cut(left: pa.Table, shared: pa.Table, later: pa.Table) -> pa.Table:
        texts, words, first, ids, known = _read(left)
        h1, h2, owner, start = _candidates(words, first, known, told(shared), window)
        gone = is_in(h1, told(later))
        order = np.lexsort((ids[owner], h2, h1))
        same = np.zeros(len(order), bool)
        same[1:] = (h1[order[1:]] == h1[order[:-1]]) & (h2[order[1:]] == h2[order[:-1]])
        group = np.cumsum(~same) - 1
        least = ids[owner[order[~same]]]
        gone[order] |= ids[owner[order]] > least[group]
        cover = np.zeros(len(words) + 1, np.int64)
        np.add.at(cover, start[gone], 1)
        np.add.at(cover, start[gone] + window, -1)
        covered = np.cumsum(cover)[:-1] > 0
        total = np.concatenate(([0], np.cumsum(covered)))
        removed = total[first[1:]] - total[first[:-1]]
        out = []
        whole = left.column("text").to_pylist()
        for i, t in enumerate(texts):
            if removed[i]:
                left_over = ~covered[first[i] : first[i + 1]]
                out.append(b" ".join([w for w, k in zip(t.split(), left_over.tolist(), strict=True) if k]).decode("utf-8", "replace"))
            elif joined and whole[i] is not None:
                out.append(b" ".join(t.split()).decode("utf-8", "replace"))
            else:
                out.append(whole[i])
        return pa.table([left.column("row").combine_chunks(), pa.array(out, pa.string()), pa.array(np.diff(first)), pa.array(removed.astype(np.int64))], names=out_schema.names)

    empty = pa.table([pa.array([], pa.int32()), pa.array([], pa.binary())], names=["chunk", "h1"])

    def act(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table([pa.array([], t) for t in (left.schema.field("row").type, pa.string(), pa.int64(), pa.int64())], names=out_schema.names)
        kind = right.column("kind").to_pylist() if right.num_rows else []
        part = {k: right.filter(pa.array([x == k for x in kind], pa.bool_())) if kind else empty for k in ("shared", "later")}
        return cut(left, part["shared"], part["later"])

    shared = answer_shared(rows.groupBy("chunk").applyInArrow(anchors, ASK))
    later = answer_later(rows.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(windows, ASK))
    both = shared.withColumn("kind", F.lit("shared")).unionByName(later.withColumn("kind", F.lit("later")))
    done = rows.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInArrow(act, out_schema)
    order = [F.col("text") if c == text else F.col(f"row.`{c}`") for c in docs.columns]
    return done.select(*[c.alias(n) for c, n in zip(order, docs.columns, strict=True)], "n_words", "n_removed")
