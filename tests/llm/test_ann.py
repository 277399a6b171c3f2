from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from assayer.llm import ann, queries

SF = "/root/testdata/sf0.1"


def brute(rows, top=20):
    ok = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    ids, m = np.array([i for i, _ in ok]), np.stack([v for _, v in ok])
    out = {}
    for i, v in ok:
        if i % 20 == 0:
            s = (m * v).sum(axis=1)
            order = [k for k in np.lexsort((ids, -s)) if ids[k] != i][:top]
            out[i] = [(int(ids[k]), float(s[k])) for k in order]
    return out


def test_recall_on_the_given_vectors(spark):
    got = {}
    for r in queries.QUERIES["op4_neighbours"](spark, SF).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    vec = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    want = brute([(r.vec_id, r.embedding) for r in vec])
    assert got.keys() == want.keys() and all(len(got[q]) == 20 for q in got)
    found = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert found / (20 * len(want)) >= 0.9
    true = {r.vec_id: np.array(r.embedding, np.float64) for r in vec}
    for q in list(got)[:20]:
        assert all(abs(s - true[q] @ true[i]) < 1e-12 for i, s in got[q])
        assert got[q] == sorted(got[q], key=lambda x: (-x[1], x[0]))


def test_small_tables_are_exact_with_hot_and_broken_vectors(spark, monkeypatch):
    monkeypatch.setattr(ann, "PIECE_MEMBERS", 7)
    monkeypatch.setattr(ann, "PIECE_QUERIES", 3)
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=4).astype(np.float32).tolist()) for i in range(150)]
    rows += [(1000 + i, [0.5, 0.5, 0.25, 1.0]) for i in range(80)]
    rows += [(500, None), (520, [0.0] * 4), (540, [1.0, None, 0.0, 0.0]), (560, [float("nan"), 1.0, 1.0, 1.0]), (580, [float("inf"), 1.0, 1.0, 1.0]), (600, [1.0, 2.0]), (None, [1.0, 1.0, 1.0, 1.0]), (620, []), (640, [-0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as first", "2 as leaf")
    got = {}
    for r in ann.neighbours(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = brute([x for x in rows if x[1] is None or len(x[1]) == 4])
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=0, atol=1e-12)


def test_fewer_candidates_ties_repeats_and_none(spark):
    kind = "vec_id long, embedding array<float>"
    one = spark.createDataFrame([(20, [1.0, 0.0])], kind)
    assert ann.neighbours(one, F.col("vec_id") % 20 == 0).count() == 0
    assert ann.neighbours(one.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    few = spark.createDataFrame([(20, [1.0, 0.0]), (3, [1.0, 0.0]), (2, [1.0, 0.0]), (9, [0.0, 1.0])], kind)
    got = [(r["rank"], r.vec_id, r.score) for r in ann.neighbours(few, F.col("vec_id") % 20 == 0).orderBy("rank").collect()]
    assert got == [(1, 2, 1.0), (2, 3, 1.0), (3, 9, 0.0)]


def test_visits_widen_until_recall(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(3000, 32))
    tree = ann.fit_tree(v, 50, 10)
    assert 1 < tree.visits <= tree.leaves
    assert sorted(tree.visit(v[0], tree.leaves)) == list(range(tree.leaves))
    assert (np.bincount(tree.assign(v), minlength=tree.leaves) > 0).all()
