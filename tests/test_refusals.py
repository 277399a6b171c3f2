"""Bad input is refused by name."""

import pytest
from pyspark.sql import functions as F

from assayer import schema as K
from assayer.operators import guards as G
from assayer.operators import identity as I
from assayer.operators import metrics as M
from assayer.operators import resample as B
from assayer.operators import select as S
from assayer.operators import splits as P
from assayer.operators.curve import tpr_at_fpr
from assayer.plans.evaluation import EvaluationConfig
from assayer.sources import ingest, scans


def test_score_file(spark):
    known = spark.createDataFrame([("a",), ("b",)], "sample_id string")
    rows = lambda *r: spark.createDataFrame([(*x, 2) for x in r], "sample_id string, raw_score string, n_fields int")
    assert [r.score for r in ingest.accept_score_file(rows(("a", "1.5")), known).collect()] == [1.5]
    for bad, kind in ((("c", "0.1"), "unknown_id"), (("a", "x"), "unparsable_score"), (("a", "nan"), "non_finite_score"), (("a", "inf"), "non_finite_score")):
        with pytest.raises(ValueError, match=kind):
            ingest.accept_score_file(rows(bad), known)
    with pytest.raises(ValueError, match="duplicate_id"):
        ingest.accept_score_file(rows(("a", "0.1"), ("a", "0.1")), known)
    with pytest.raises(ValueError, match="no rows"):
        ingest.accept_score_file(rows(("a", "1")).limit(0), known)


def test_manifest_columns(spark):
    with pytest.raises(ValueError, match="domain"):
        scans.label_manifest(spark.createDataFrame([("a", "b", "real")], "item_id string, filename string, label string"))


def test_contradictory_duplicate(spark):
    df = spark.createDataFrame([("h", 0, "a"), ("h", 1, "b"), ("i", 1, "c")], "h string, label int, id string")
    with pytest.raises(ValueError, match="'a' and 'b'"):
        S.refuse_contradictions(df, "h", "label", "id")


def test_release_gate(spark):
    manifest = spark.createDataFrame([("m", True, ["f1"])], "asset_id string, commercial_use boolean, files array<string>")
    files = lambda *f: spark.createDataFrame([(x,) for x in f], "file string")
    S.require_clean_release(files("f1"), manifest)
    with pytest.raises(ValueError, match="unregistered f2"):
        S.require_clean_release(files("f1", "f2"), manifest)
    with pytest.raises(ValueError, match="no assets to check"):
        S.require_clean_release(files("f1").limit(0), manifest)


def test_runs_over_different_samples(spark):
    a = spark.createDataFrame([("f", 1), ("f", 2)], "fold string, sample_id int")
    with pytest.raises(ValueError, match="only_a"):
        S.require_same_coverage(a, a.limit(1), ["fold", "sample_id"], "fold")


def test_evaluation_only_items(spark):
    with pytest.raises(ValueError, match="kept for evaluation"):
        S.refuse_evaluation_only(spark.createDataFrame([("s1", True)], "id string, swapped boolean"), "id")


def test_guards_raise_unless_waived(spark):
    df = spark.createDataFrame([("a", "v"), ("b", "v")], "sample_id string, source_id string")
    with pytest.raises(G.GuardViolation):
        G.require(G.video_level(df), "video level")
    assert G.require(G.video_level(df), "video level", waived=True).count() == 1


def test_vacuous_grouping_is_named(spark):
    df = spark.createDataFrame([("a", "a"), ("b", "b")], "sample_id string, source_id string")
    assert G.video_level_status(df).collect()[0].status == "vacuous"


def test_null_counts_as_a_preprocessing_value(spark):
    df = spark.createDataFrame([("one", None), (None, None)], "face_detector string, align string")
    assert [r.key for r in G.mixed_preprocessing(df).collect()] == ["face_detector"]


def test_identity(spark):
    e = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.1]), ("z", [0.0, 0.0])], "sample_id string, embedding array<double>")
    pick = lambda *i: e.where(F.col("sample_id").isin(*i))
    r = I.identity_disjoint(pick("a"), pick("b", "z"), e)
    assert r.collect()[0].violations == 1
    with pytest.raises(ValueError, match="identity leakage"):
        I.require_distinct(r)
    assert [x.sample_id for x in I.missing_embeddings(spark.createDataFrame([("q",)], "sample_id string"), e).collect()] == ["q"]
    with pytest.raises(ValueError):
        I.subject_partition(e, max_subjects=1)
    with pytest.raises(ValueError):
        I.identity_disjoint(pick("a"), pick("b"), e, tolerated=1.5)


def test_sessions_and_splits(spark):
    df = spark.createDataFrame([("s", 0.5, 0), ("s", 0.6, 1)], "session_id string, score double, label int")
    with pytest.raises(ValueError, match="conflicting"):
        M.refuse_conflicting_sessions(M.session_mean(df))
    one = spark.createDataFrame([("g", 0), ("g", 1)], "g string, label int")
    with pytest.raises(ValueError, match="both classes"):
        P.require_both_classes(P.class_aware_split(one, "g", "label", 0), "label")
    flat = spark.createDataFrame([("a", "u", "s1", None, 0), ("b", "v", "s2", "g", 1)], "sample_id string, subject_id string, source_id string, generator string, label int")
    with pytest.raises(P.UnsplittableCorpus):
        P.require_measurable(P.generator_folds(flat))
    det = spark.createDataFrame([("d", "v1")], "detector string, version string")
    with pytest.raises(ValueError, match="training window"):
        P.require_outside_window(det, spark.createDataFrame([("v1", 100)], "version string, window int"), 99)
    P.require_outside_window(det, spark.createDataFrame([("v1", 100)], "version string, window int"), 100)


def test_arguments(spark):
    df = spark.createDataFrame([(0.1, 0)], "score double, label int")
    with pytest.raises(ValueError):
        tpr_at_fpr(df, (), {"t": 1.5})
    with pytest.raises(ValueError):
        M.ece(df, bins=0)
    with pytest.raises(ValueError):
        B.draws(df.withColumn("g", F.lit("x")), [], "g", 0, 0)
    with pytest.raises(G.GuardViolation):
        EvaluationConfig(threshold_source="test")


def test_curves(spark, tmp_path):
    good = spark.createDataFrame([("d", "low", 1.0, 2.0, 0.5, 6.0, 1)], K.CURVES)
    ingest.save_curves(good, str(tmp_path / "c"))
    assert ingest.load_curves(spark, str(tmp_path / "c")).collect() == good.collect()
    with pytest.raises(ValueError):
        ingest.save_curves(good.withColumn("coef", F.lit(float("nan"))), str(tmp_path / "n"))
    good.withColumn("format_version", F.lit(9)).write.parquet(str(tmp_path / "v"))
    with pytest.raises(ValueError):
        ingest.load_curves(spark, str(tmp_path / "v"))
