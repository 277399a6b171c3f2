"""Fits against plain numpy, planted shortcuts and pure noise."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.functions import scalar as X
from assayer.operators import decide as C
from assayer.operators import fit as L


def newton(x, y, c=1.0):
    x = np.column_stack([np.ones(len(x)), x])
    b, ridge = np.zeros(x.shape[1]), np.r_[0.0, np.ones(x.shape[1] - 1)] / c
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ b))
        b = b - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (p - y) + ridge * b)
    return b


def table(spark, x, y, groups=None):
    g = groups if groups is not None else [f"g{i}" for i in range(len(y))]
    return spark.createDataFrame([(f"s{i}", g[i], int(y[i]), [float(v) for v in x[i]]) for i in range(len(y))], "sample_id string, g string, label int, x array<double>")


def test_many_problems_at_once(spark):
    rng = np.random.default_rng(0)
    rows, want = [], {}
    for k in range(3):
        x, y = rng.normal(0, 1 + k, (120, 4)), rng.integers(0, 2, 120)
        x[:, 0] += y
        want[f"p{k}"] = newton(x, y)
        rows += [(f"p{k}", [float(v) for v in r], int(t), 1.0) for r, t in zip(x, y)]
    got = L.fit_logistic(spark.createDataFrame(rows, "problem string, x array<double>, y int, w double"), 4).collect()
    for r in got:
        assert [r.intercept, *r.coef] == pytest.approx(want[r.problem].tolist(), abs=1e-6)


def test_separable_unscaled_data_converges(spark):
    x = np.linspace(-4000, 4000, 80)[:, None]
    y = (x[:, 0] > 0).astype(int)
    got = L.fit_logistic(table(spark, x, y).select(F.lit("p").alias("problem"), "x", F.col("label").alias("y"), F.lit(1.0).alias("w")), 1, max_iter=60).collect()[0]
    p = 1 / (1 + np.exp(-(got.intercept + got.coef[0] * x[:, 0])))
    assert np.isfinite(p).all() and ((p > 0.5) == y).all()


def test_planted_shortcut_fires_and_noise_does_not(spark):
    rng = np.random.default_rng(2)
    n = 240
    y, groups = rng.integers(0, 2, n), [f"g{i // 6}" for i in range(n)]
    planted = np.column_stack([y * 2.0 + rng.normal(0, 0.3, n), rng.normal(0, 1, n)])
    hot = L.run_control(table(spark, planted, y, groups), "x", 2, "g", "sample_id", n_null=8, replicates=20).collect()[0]
    assert hot.auc > 0.95 and hot.p == pytest.approx(1 / 9) and hot.auc > hot.null_hi
    noise = L.run_control(table(spark, rng.normal(0, 1, (n, 2)), y, groups), "x", 2, "g", "sample_id", n_null=8, replicates=20).collect()[0]
    assert noise.null_lo - 0.1 <= noise.auc <= noise.null_hi + 0.1 and noise.p > 0.12
    assert hot.n_fit + hot.n_test == n


def test_unmeasured_rows_are_dropped(spark):
    y = [0, 1] * 20
    x = [[float("nan")] if i < 8 else [float(i % 2)] for i in range(40)]
    r = L.run_control(table(spark, x, y, [f"g{i // 2}" for i in range(40)]), "x", 1, "g", "sample_id", n_null=2, replicates=5).collect()[0]
    assert r.n_fit + r.n_test == 32


def test_one_class_is_refused(spark):
    df = table(spark, [[1.0], [2.0]], [1, 1])
    with pytest.raises(ValueError, match="one class"):
        L.fit_head(df, "x", 1)
    with pytest.raises(ValueError, match="one class only"):
        L.permutation_null(df, df, 1, "sample_id", 2)
    with pytest.raises(ValueError, match="two families"):
        L.require_two_families(df.withColumn("generator", F.lit("only")))


def test_thin_bands_are_not_fitted(spark):
    rows = [("d", "low", i / 40, i % 2) for i in range(40)] + [("d", "high", 0.5, 1)] * 30 + [("d", "medium", 0.1, i % 2) for i in range(19)]
    df = spark.createDataFrame(rows, "detector string, band string, score double, label int")
    assert {r.band: r.status for r in L.calibration_eligibility(df).collect()} == {"low": "ok", "high": "one_class", "medium": "too_few"}
    assert [r.band for r in L.fit_curves(df).collect()] == ["low"]


def test_a_768_wide_head_fits_and_scores(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 768))
    y = (x[:, 0] + x[:, 1] + 0.5 * rng.normal(size=600) > 0).astype(int)
    df = spark.createDataFrame([(i, v.tolist(), int(t)) for i, (v, t) in enumerate(zip(x, y, strict=True))], "k long, f array<double>, label int")
    h = L.fit_head(df, "f", 768)
    r = h.first()
    assert len(r.coef) == len(r.mean) == 768
    z = (x - np.array(r.mean)) / np.array(r.scale)
    p = 1 / (1 + np.exp(-(z @ np.array(r.coef) + r.intercept)))
    grad = z.T @ (p - y) + np.array(r.coef)
    assert np.abs(grad).max() < 1e-5
    one = X.linear_probability(F.col("f"), r.mean, r.scale, r.coef, r.intercept)
    got = np.array([v.p for v in df.select("k", one.alias("p")).orderBy("k").collect()])
    assert np.abs(got - p).max() < 1e-9


def test_a_fit_that_has_not_converged_is_refused(spark):
    rows = spark.createDataFrame([("a", [float(i)], i % 2, 1.0) for i in range(40)] + [("b", [0.0], 0, 1.0), ("b", [0.0], 1, 1.0)], "problem string, x array<double>, y int, w double")
    with pytest.raises(ValueError, match="did not converge in 1 steps"):
        L.fit_logistic(rows, 1, max_iter=1)
    assert all(r.converged for r in L.fit_logistic(rows, 1).collect())


def test_what_was_not_measured_is_refused_or_left_out(spark):
    part = spark.createDataFrame([("a", [1.0, float("nan")], 0, 1.0), ("a", [2.0, 1.0], 1, 1.0)], "problem string, x array<double>, y int, w double")
    with pytest.raises(ValueError, match="measured in part"):
        L.fit_logistic(part, 2)
    scores = [("d", "low", i / 40, i % 2) for i in range(40)]
    kind = "detector string, band string, score double, label int"
    clean = L.fit_curves(spark.createDataFrame(scores, kind)).first()
    dirty = L.fit_curves(spark.createDataFrame(scores + [("d", "low", float("nan"), 1), ("d", "low", float("inf"), 0), ("d", "low", None, 0)], kind)).first()
    assert [dirty.coef, dirty.intercept, dirty.prior] == pytest.approx([clean.coef, clean.intercept, clean.prior], abs=1e-9)


def test_a_score_that_is_no_number_never_decides(spark):
    curve = spark.createDataFrame([("d", "low", 9.0, 0.0, 0.5, 6.0)], "detector string, band string, coef double, intercept double, prior double, max_abs_llr double")
    bad = [float("nan"), float("inf"), float("-inf")]
    rows = spark.createDataFrame([(str(i), "d", "1", v, False, "ok", "low") for i, v in enumerate(bad)], "sample_id string, detector string, version string, score double, abstained boolean, reason string, band string")
    ev = C.to_evidence(rows, curve)
    assert all(r.abstained and r.llr == 0.0 and r.reason == "not_measured" and r.raw_score is None for r in ev.collect())
    assert {r.verdict for r in C.fuse(ev).collect()} == {"insufficient_evidence"}


def test_rows_of_one_problem_are_summed_where_they_are_and_equal_ones_once(spark, monkeypatch):
    kept, steps, busy, plain = [], [], spark.sparkContext.accumulator(0), L._partial_sums

    def spied(width):
        run = plain(width)
        steps.append(width)

        def counted(batches):
            batches = [b for b in batches if len(b)]
            yield from run(iter(batches))
            busy.add(bool(batches))

        return counted

    monkeypatch.setattr(L, "_partial_sums", spied)
    monkeypatch.setattr(L, "shared", lambda df: kept.append(df.persist()) or kept[-1])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few = spark.range(0, 800, 1, 4).selectExpr("'p' AS problem", "array(double(id % 2)) AS x", "int(id % 3 = 0) AS y", "1.0 AS w")
        L.fit_logistic(few, 1)
        steps.clear()
        busy.value = 0
        wide = spark.range(0, 400, 1, 4).selectExpr("'p' AS problem", "array(id % 2, id % 3, id % 5, id % 7, id % 11) AS x", "int(id % 13 > 5) AS y", "1.0 AS w")
        L.fit_logistic(wide, 5)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted((r.x[0], r.y, r.w) for r in kept[0].collect()) == [(0.0, 0.0, 266.0), (0.0, 1.0, 134.0), (1.0, 0.0, 267.0), (1.0, 1.0, 133.0)]
    assert busy.value == 4 * len(steps)
