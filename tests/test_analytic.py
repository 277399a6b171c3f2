"""Cases whose answers are known in advance."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.operators import curve as V
from assayer.operators import decide as C
from assayer.operators import guards as G
from assayer.operators import metrics as M
from assayer.operators import resample as B


def scored(spark, neg, pos):
    return spark.createDataFrame([(s, 0) for s in neg] + [(s, 1) for s in pos], "score double, label int")


def one(df, col):
    return df.collect()[0][col]


def test_auc_by_hand(spark):
    assert one(V.auc(scored(spark, [0.2, 0.4, 0.6], [0.3, 0.5, 0.8])), "auc") == pytest.approx(6 / 9)


def test_all_tied_is_one_half(spark):
    assert one(V.auc(scored(spark, [0.5] * 7, [0.5] * 3)), "auc") == 0.5


def test_one_class_is_null_not_zero(spark):
    r = V.tpr_at_fpr(scored(spark, [], [0.1, 0.2])).collect()[0]
    assert r.auc is None and r.tpr_at_1pct is None


def test_nan_scores_are_abstentions(spark):
    df = scored(spark, [0.1, float("nan")], [0.9, float("inf")])
    r = V.auc(df).collect()[0]
    assert (r.auc, r.n_pos, r.n_neg) == (1.0, 1, 1)


def test_tpr_threshold_is_interpolated_and_strict(spark):
    rng = np.random.default_rng(1)
    neg, pos = rng.normal(0, 1, 300).round(2).tolist(), rng.normal(1, 1, 200).round(2).tolist()
    for fpr in (0.0, 0.01, 0.1, 1.0):
        want = float((np.array(pos) > np.quantile(neg, 1 - fpr)).mean())
        assert one(V.tpr_at_fpr(scored(spark, neg, pos), (), {"t": fpr}), "t") == pytest.approx(want)


def test_budget_counts_ties_at_the_threshold(spark):
    df = scored(spark, [0.1, 0.5], [0.5, 0.9])
    r = V.catch_at_budget(df, [], {"zero": 0.0, "half": 0.5}).collect()[0]
    assert (r.zero, r.half) == (0.5, 1.0)


def test_quantiles_equal_numpy(spark):
    xs = np.random.default_rng(3).exponential(5, 501).tolist()
    df = spark.createDataFrame([(x,) for x in xs], "v double")
    r = V.quantiles(df, [], "v", {"a": 0.5, "b": 0.95, "c": 0.0, "d": 1.0}).collect()[0]
    assert [r.a, r.b, r.c, r.d] == pytest.approx(np.quantile(xs, [0.5, 0.95, 0, 1]).tolist())


def test_ece_edges(spark):
    probs = [0.0, 0.1, 0.1000001, 0.3, 0.30000000000000004, 1.0]
    labels = [0, 1, 0, 1, 1, 1]
    edges, p, y = np.linspace(0, 1, 11), np.array(probs), np.array(labels)
    want = 0.0
    for i in range(10):
        m = (p > edges[i]) & (p <= edges[i + 1]) if i else (p >= 0) & (p <= edges[1])
        if m.any():
            want += m.mean() * abs(p[m].mean() - y[m].mean())
    df = spark.createDataFrame(list(zip(probs, labels)), "score double, label int")
    assert one(M.ece(df), "ece") == pytest.approx(want)


def test_ece_refuses_what_is_no_probability(spark):
    with pytest.raises(Exception, match="not a probability"):
        M.ece(scored(spark, [1.2], [0.4])).collect()


def test_kish(spark):
    equal = spark.createDataFrame([(g,) for g in "abcd" for _ in range(5)], "g string")
    assert one(M.kish_ess(equal, "g"), "ess") == pytest.approx(4)
    assert one(M.kish_ess(equal.where("g = 'a'"), "g"), "ess") == pytest.approx(1)


def test_short_and_flat_series(spark):
    df = spark.createDataFrame([("a", 1, 3.0), ("a", 2, 4.0), ("b", 1, 2.0), ("b", 2, 2.0), ("b", 3, 2.0)], "g string, t int, v double")
    assert {r.g: r.ess for r in M.autocorrelation_ess(df, "g", "t", "v").collect()} == {"a": 2.0, "b": 1.0}


def _grouped(spark, rows_per_group, groups):
    rng = random.Random(7)
    rows = []
    for g in range(groups):
        shift = rng.gauss(0, 1)
        for _ in range(rows_per_group):
            rows.append((f"g{g}", g % 2, shift + 0.4 * (g % 2) + rng.gauss(0, 0.01)))
    return spark.createDataFrame(rows, "g string, label int, score double")


def test_grouping_widens_the_interval(spark):
    df = _grouped(spark, 50, 10).withColumn("row", F.monotonically_increasing_id().cast("string")).cache()
    by_group = B.bootstrap_ci(df, [], "g", 60).collect()[0]
    by_row = B.bootstrap_ci(df, [], "row", 60).collect()[0]
    assert (by_group.ci_hi - by_group.ci_lo) / (by_row.ci_hi - by_row.ci_lo) > 6


def test_delta_of_a_vector_with_itself_is_exactly_zero(spark):
    r = B.paired_delta_ci(_grouped(spark, 5, 8).withColumn("same", F.col("score")), [], "g", "score", "same", 20).collect()[0]
    assert (r.delta, r.ci_lo, r.ci_hi) == (0.0, 0.0, 0.0)


def test_degenerate_replicates_are_counted(spark):
    df = spark.createDataFrame([("a", 0, 0.1), ("b", 1, 0.9)], "g string, label int, score double")
    r = B.bootstrap_ci(df, [], "g", 50).collect()[0]
    assert r.n_draws == 50 and 0 < r.n_degenerate < 50 and r.ci_lo == 1.0


def test_permutation_p_counts_undefined_draws(spark):
    null = spark.createDataFrame([(0.5,), (0.9,), (None,), (0.05,)], "stat double")
    obs = spark.createDataFrame([(0.1,)], "observed double")
    assert one(B.permutation_p(null, obs), "p") == pytest.approx(3 / 5)


def test_parity_ratio_limits(spark):
    rates = lambda *f: spark.createDataFrame([(x,) for x in f], "fpr double")
    assert one(G.parity_ratio(rates(0.1)), "fpr_ratio") == 1.0
    assert one(G.parity_ratio(rates(0.0, 0.0)), "fpr_ratio") == 1.0
    assert one(G.parity_ratio(rates(0.0, 0.2)), "fpr_ratio") == float("inf")
    assert one(G.parity_ratio(rates(0.0002, 0.0016)), "fpr_ratio") == pytest.approx(8.0)


def test_empty_evidence_and_clipping(spark):
    ev = spark.createDataFrame(
        [("a", f"d{i}", "1", 6.0, 0.9, False, "ok") for i in range(5)] + [("b", "d0", "1", 0.0, None, True, "no_face")],
        "sample_id string, detector string, detector_version string, llr double, raw_score double, abstained boolean, reason string")
    samples = spark.createDataFrame([("a",), ("b",), ("c",)], "sample_id string")
    r = {x.sample_id: x for x in C.fuse(ev, samples, keep_evidence=True).collect()}
    assert (r["a"].llr_total, r["a"].verdict, r["a"].ess) == (20.0, "fake", 1.0)
    for k in "bc":
        assert (r[k].verdict, r[k].posterior, r[k].ess, r[k].n_contributing) == ("insufficient_evidence", 0.5, 0.0, 0)
    assert r["c"].evidence == []


def test_two_strong_opposites_are_out_of_distribution(spark):
    ev = spark.createDataFrame([("a", "x", "1", 5.0, 0.9, False, "ok"), ("a", "y", "1", -4.0, 0.1, False, "ok")],
                               "sample_id string, detector string, detector_version string, llr double, raw_score double, abstained boolean, reason string")
    r = C.fuse(ev).collect()[0]
    assert (r.verdict, r.disagreement) == ("out_of_distribution", 4.0)


def test_contradictory_policy_is_refused():
    with pytest.raises(ValueError):
        C.Policy(fake_threshold=-1.0, real_threshold=1.0)


def test_dataset_hash_ignores_order_and_sees_every_field(spark):
    rows = [(f"s{i}", f"v{i}", f"p{i % 3}", "g" if i % 2 else None, i % 2, "c0", "fd", "al") for i in range(40)]
    schema = "sample_id string, source_id string, subject_id string, generator string, label int, compression string, face_detector string, align string"
    h = lambda r: one(M.dataset_hash(spark.createDataFrame(r, schema)), "dataset_hash")
    base = h(rows)
    assert h(rows[::-1]) == base
    for i in range(8):
        edited = list(rows[5])
        edited[i] = 0 if i == 4 else "changed"
        assert h(rows[:5] + [tuple(edited)] + rows[6:]) != base
    assert h(rows + rows[:1]) != base
