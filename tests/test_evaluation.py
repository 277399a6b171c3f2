"""The whole evaluation on a small corpus."""

import random

import pytest
from pyspark.sql import functions as F

from assayer.operators import guards as G
from assayer.operators.resample import null_verdict
from assayer.plans import evaluation as E


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    rows, scores, emb = [], [], []
    for i in range(240):
        sub, fake = f"u{i % 12:02d}", i % 2 == 1
        gen = ("ga", "gb", "gc")[(i // 2) % 3] if fake else None
        rows.append((f"s{i}", f"v{i}", sub, gen, int(fake), ("c0", "c23", "c40")[i % 3], "one", "five", f"g{(i // 4) % 2}"))
        for d in ("good", "blind"):
            scores.append((f"s{i}", d, None if i % 20 == 0 else min(1.0, max(0.0, 0.5 + (0.3 if fake and d == "good" else 0) + rng.gauss(0, 0.1)))))
        emb.append((f"s{i}", [1.0 if k == i % 12 else 0.0 for k in range(12)]))
    return (
        spark.createDataFrame(rows, "sample_id string, source_id string, subject_id string, generator string, label int, compression string, face_detector string, align string, stratum string").cache(),
        spark.createDataFrame(scores, "sample_id string, detector string, score double").cache(),
        spark.createDataFrame(emb, "sample_id string, embedding array<double>").cache(),
    )


def test_sections(spark, corpus):
    records, scores, emb = corpus
    out = E.run_evaluation(records, scores, E.EvaluationConfig(bootstrap=20, min_genuine=10, waived=frozenset({"parity"})), emb)
    rep = {r.detector: r for r in out["report"].collect()}
    assert rep["good"].auc > 0.9 > 0.7 > rep["blind"].auc and rep["good"].ci_lo <= rep["good"].auc <= rep["good"].ci_hi
    assert rep["good"].abstention_rate == pytest.approx(0.05)
    assert {(r.fold, r.detector) for r in out["folds"].collect()} == {(g, d) for g in ("ga", "gb", "gc") for d in ("good", "blind")}
    assert all(r.status == "ok" for r in out["parity"].collect())
    assert out["worst_identity"].collect()[0].status == "ok"
    assert {r.scope for r in out["identity"].collect()} == {"corpus", "fold"}


def test_leaking_identities_are_refused(spark, corpus):
    records, scores, emb = corpus
    same = emb.withColumn("embedding", F.array(F.lit(1.0), F.lit(0.0)))
    with pytest.raises(G.GuardViolation, match="identity"):
        E.run_evaluation(records, scores, E.EvaluationConfig(bootstrap=5, waived=frozenset({"parity"})), same)
    out = E.run_evaluation(records, scores, E.EvaluationConfig(bootstrap=5, waived=frozenset({"parity", "identity"})), same)
    assert out["worst_identity"].collect()[0].status == "violation"
    with pytest.raises(G.GuardViolation, match="certified"):
        E.run_evaluation(records, scores, E.EvaluationConfig(bootstrap=5, waived=frozenset({"parity"})), emb.limit(10))


def test_a_waived_guard_goes_on_without_some_embeddings(spark, corpus):
    records, scores, emb = corpus
    some = emb.where(F.col("sample_id") != "s3")
    out = E.run_evaluation(records, scores, E.EvaluationConfig(bootstrap=5, waived=frozenset({"parity", "identity"})), some)
    assert out["missing_embeddings"].first().n == 1
    assert out["worst_identity"].first().status == "violation"
    assert {r.name: r.violations for r in out["identity"].collect()} == {"corpus": 0, "ga": 0, "gb": 0, "gc": 0}


def test_variants_attacks_and_fold_intervals(spark, corpus):
    records, scores, emb = corpus
    variants = scores.select("sample_id", "detector", F.lit("flip").alias("variant"), (1 - F.col("score")).alias("score"))
    targets = spark.createDataFrame([("good", True)], "detector string, weights_present boolean")
    attacks = spark.createDataFrame([("good", 0.25)], "detector string, adversarial_tpr double")
    cfg = E.EvaluationConfig(bootstrap=20, bootstrap_group="subject_id", waived=frozenset({"parity"}))
    out = E.run_evaluation(records, scores, cfg, None, variants, attacks, targets)
    assert {r.detector: (r.adversarial_tpr, r.adversarial_status) for r in out["report"].collect()} == {"good": (0.25, "ok"), "blind": (None, "no_target")}
    flip = {r.detector: r for r in out["variants"].collect()}
    assert flip["good"].tpr_at_1pct < 0.05 and (flip["good"].n, flip["good"].n_scored) == (240, 228)
    for r in out["folds"].collect():
        assert r.n_draws == 20 and (r.auc is None or r.ci_lo is None or r.ci_lo <= r.ci_hi)
    with pytest.raises(ValueError, match="target"):
        E.run_evaluation(records, scores, cfg, attacks=attacks)


@pytest.mark.parametrize("break_it, what", [
    (lambda r: r.withColumn("label", F.lit(2)), "malformed"),
    (lambda r: r.unionByName(r.limit(1)), "duplicate"),
    (lambda r: r.withColumn("source_id", F.concat(F.lit("v"), F.col("subject_id"), F.coalesce("generator", F.lit("r")))), "source video"),
    (lambda r: r.withColumn("compression", F.lit("c0")), "compression"),
    (lambda r: r.withColumn("align", F.when(F.col("sample_id") == "s3", "x")), "preprocessing"),
])
def test_corpus_refusals(corpus, break_it, what):
    with pytest.raises(G.GuardViolation, match=what):
        E.check_corpus(break_it(corpus[0]), E.EvaluationConfig())


def test_verdict_over_a_null(spark):
    df = spark.createDataFrame([(0.6, 0.4, 0.7), (0.72, 0.4, 0.7), (0.9, 0.4, 0.7), (None, 0.4, 0.7)], "o double, lo double, hi double")
    v = [r.v for r in df.select(null_verdict(F.col("o"), F.col("lo"), F.col("hi"), 0.75).alias("v")).collect()]
    assert v == ["inside_null", "outside_below_floor", "outside_above_floor", None]
