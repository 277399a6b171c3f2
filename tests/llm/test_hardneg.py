"""Hard negatives against brute force in whole numbers."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.llm import hardneg

SHAPE = "vec_id long, embedding array<float>, label int"
LABEL = "if(vec_id % 7 = 0, (label + 1) % 10, label)"


def brute(rows, positives=5, negatives=5):
    kept = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole = tuple(math.floor(256 * float(np.float32(x))) for x in v)
        kept.append((i, (label + 1) % 10 if i % 7 == 0 else label, whole))
    kept = list(dict.fromkeys(kept))
    out = []
    for i, label, v in kept:
        if i % 100:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w, strict=True)), j, k) for j, k, w in kept if j != i and len(w) == len(v)]
        for p, pid, _ in sorted(x for x in scored if x[2] == label)[:positives]:
            fit = sorted(x for x in scored if x[2] != label and 80 * -p <= 100 * -x[0] <= 100 * -p)[:negatives]
            out += [(i, pid, r + 1, n, -p, -s) for r, (s, n, _) in enumerate(fit)]
    return sorted(out)


def found(spark, rows, **kw):
    df = spark.createDataFrame(rows, SHAPE)
    got = hardneg.mine(df, F.col("vec_id") % 100 == 0, F.expr(LABEL), **kw)
    return sorted(tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def vectors(n, dim, seed, spread=0.4):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, dim))
    v = centres[rng.integers(0, 6, n)] + spread * rng.standard_normal((n, dim))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return [(k, [float(x) for x in row], int(rng.integers(0, 10))) for k, row in enumerate(v.astype(np.float32))]


@pytest.mark.parametrize(("dim", "spread"), [(64, 0.2), (70, 2.0), (3, 0.5)])
def test_matches_brute_force(spark, monkeypatch, dim, spread):
    monkeypatch.setattr(hardneg, "PIECE_ROWS", 300)
    monkeypatch.setattr(hardneg, "PIECE_ANCHORS", 4)
    rows = vectors(1200, dim, dim, spread)
    want = brute(rows)
    assert found(spark, rows) == want and want


def test_intervals_hold_and_narrow_by_stage():
    rng = np.random.default_rng(5)
    for dim in (1, 5, 64, 130):
        v = rng.integers(-200, 200, (400, dim))
        v[0] = 0
        v[1:40] = v[50] + rng.integers(-3, 4, (39, dim))
        exact, seen = v[:80] @ v.T, []

        def look(low, high, rows, exact=exact, seen=seen):
            assert (low <= exact[:, rows]).all() and (exact[:, rows] <= high).all()
            seen.append((low, high))
            return np.ones(low.shape, bool)

        hardneg.survivors(v[:80].astype(float), hardneg.encode(v.astype(float)), look)
        if dim > 60:  # each stage narrows; copies of one vector and strangers do not overlap
            assert np.median(seen[2][1] - seen[2][0]) < 0.5 * np.median(seen[0][1] - seen[0][0])
            assert seen[2][0][2, 1:40].min() > np.quantile(seen[2][1][2, 51:], 0.9)


def test_rows_out_of_reach_are_not_scored():
    rng = np.random.default_rng(6)
    centre = rng.standard_normal((8, 64))
    v = np.rint(200 * (centre[np.arange(800) % 8] + 0.05 * rng.standard_normal((800, 64)))).astype(np.int64)
    bar = (v[0] @ v.T)[::8].min()
    rows, live = hardneg.survivors(v[:1].astype(float), hardneg.encode(v.astype(float)), lambda low, high, rows: high >= bar)
    assert set(range(0, 800, 8)) <= set(rows.tolist()) and len(rows) < 200 and live.all()


def test_scores_beyond_doubles_are_exact():
    v = np.array([[(1 << 26) - 1, 1], [3, (1 << 25) + 1]] * 40, np.int64).reshape(2, 80)
    want = [[sum(int(a) * int(b) for a, b in zip(x, y, strict=True)) for y in v] for x in v]
    assert hardneg.scores(v, v).tolist() == want


def test_ties_nulls_repeats_and_hot_vectors(spark):
    one = [0.5, 0.25, -0.5]
    rows = [(k, one, 3) for k in range(0, 400)] + [(k, one, 4) for k in range(400, 700)] + [(k, [0.45, 0.2, -0.4], 5) for k in range(700, 720)]
    rows += [(0, one, 3), (100, [0.4, 0.3, -0.5], 3), (800, None, 3), (801, [1.0, None, 0.0], 3), (802, [float("nan"), 0.0, 0.0], 3), (803, [float("inf"), 0.0, 0.0], 3), (804, one, None), (None, one, 3)]
    rows += [(900, [0.5, 0.25], 3), (901, [0.5, 0.25], 3), (902, [0.5, 0.2], 8), (1000, [0.0, 0.0, 0.0], 3), (1100, [], 1), (1101, [], 1)]
    assert found(spark, rows) == brute(rows)


def test_few_rows_empty_tables_and_clashing_names(spark):
    assert found(spark, []) == []
    assert found(spark, [(0, [1.0], 2)]) == []
    assert found(spark, [(0, [1.0], 1), (5, [1.0], 2), (6, [0.9], 3)]) == brute([(0, [1.0], 1), (5, [1.0], 2), (6, [0.9], 3)])
    rows = vectors(250, 8, 1)
    df = spark.createDataFrame(rows, SHAPE).selectExpr("*", "1 as v", "2 as tag", "'x' as bits", "3 as i", "4 as place")
    got = hardneg.mine(df, F.col("vec_id") % 100 == 0, F.expr(LABEL))
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)
