"""Readers and writers on real files."""

import json

import pytest
from pyspark.sql import functions as F

from assayer.operators import select as S
from assayer.sources import scans, sinks


def test_session_documents(spark, tmp_path):
    docs = {
        "s1": json.dumps({"session_id": "one", "swapped": True, "frame_count": 2, "decision": {"approved": True}, "scan": {"verdict": None}, "frames": [{"index": 0, "saved_as": "x.jpg"}, {"index": 1, "swapped": 0}]}),
        "s2": "{not json", "s3": "[1]", "s4": '{"frame_count": "many"}', "s5": '{"decision": null}',
    }
    for name, text in docs.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "results.json").write_text(text)
    good, bad = scans.good_and_rejected(scans.parse_sessions(scans.read_json_documents(spark, str(tmp_path), "results.json")))
    rows = {r.folder: r for r in good.collect()}
    assert set(rows) == {"s1", "s5"} and rows["s5"].session_id == "s5" and rows["s5"].frame_count == 0
    assert (rows["s1"].swapped, rows["s1"].approved, rows["s1"].scan_verdict) == (True, True, None)
    assert {r.folder: r.reject_reason for r in bad.collect()} == {"s2": "not_a_json_object", "s3": "not_a_json_object", "s4": "frame_count_not_an_integer"}
    assert [(r.file_name, r.label) for r in scans.explode_frames(good.where("folder = 's1'")).collect()] == [("x.jpg", 1), ("frame_01.jpg", 0)]


def test_vendor_documents(spark, tmp_path):
    docs = {"k1": {"verdict": "MANIPULATED", "score": 0.9, "models": [{"name": "a", "score": 0.2}, {"name": "a", "score": 0.7, "verdict": "MANIPULATED"}, {"name": "b", "score": 0.1}]}, "k2": {"score": 0.5}}
    for name, d in docs.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "result.json").write_text(json.dumps(d))
    r = {x.cache_key: x for x in scans.parse_vendor_results(scans.read_json_documents(spark, str(tmp_path), "result.json")).collect()}
    assert r["k1"].model_scores == {"a": 0.7, "b": 0.1} and r["k1"].n_manipulated == 1 and r["k1"].max_model_score == 0.7
    assert r["k2"].n_models == 0 and r["k2"].max_model_score is None and r["k2"].verdict == ""


def test_manifest_and_score_file(spark, tmp_path):
    m = tmp_path / "metadata.csv"
    m.write_text("item_id,filename,label,domain\n1,a.jpg, Real ,x\n2,b.jpg,FAKE,y\n3,c.jpg,,z\n")
    assert [r.label for r in scans.read_manifest(spark, str(m)).orderBy("item_id").collect()] == [0, 1, -1]
    m.write_text("item_id,filename,label\n1,a.jpg,real\n")
    with pytest.raises(ValueError, match="domain"):
        scans.read_manifest(spark, str(m))
    s = tmp_path / "s.csv"
    s.write_text("sample_id,score\na,0.5\nb,0.1,9\nc\n")
    assert {r.sample_id: r.n_fields for r in scans.read_score_file(spark, str(s)).collect()} == {"a": 2, "b": 3, "c": 1}
    s.write_text("id,score\na,0.5\n")
    with pytest.raises(ValueError, match="header"):
        scans.read_score_file(spark, str(s))


def test_labelled_and_recursive_scans(spark, tmp_path):
    for p in ("real/a/1.jpg", "fake/b/2.jpg", "other/3.jpg"):
        (tmp_path / p).parent.mkdir(parents=True)
        (tmp_path / p).write_bytes(b"x")
    files = scans.scan_labelled_files(spark, str(tmp_path), ["real", "fake"], "*.jpg")
    assert sorted(r.label_dir for r in files.select("label_dir").collect()) == ["fake", "real"]
    scans.require_all_labels(files, ["real", "fake"])
    with pytest.raises(ValueError, match="fake"):
        scans.require_all_labels(files.where("label_dir = 'real'"), ["real", "fake"])
    assert sorted(r.sample_id for r in scans.scan_files(spark, str(tmp_path)).select("sample_id").collect()) == ["fake/b/2.jpg", "other/3.jpg", "real/a/1.jpg"]
    assert "content" not in files.select("label_dir", "length").columns


def test_fold_scores_and_reports(spark, tmp_path):
    df = spark.createDataFrame([("g", "a", "u", 1, 0.5), ("h", "b", "v", 0, float("nan"))], "fold string, sample_id string, subject_id string, label int, score double")
    sinks.write_fold_scores(df, str(tmp_path / "f"))
    assert (tmp_path / "f" / "fold=g").is_dir()
    sinks.write_report(df, str(tmp_path / "r"))
    lines = {json.loads(r.value)["sample_id"]: json.loads(r.value) for r in spark.read.text(str(tmp_path / "r")).collect()}
    assert lines["b"]["score"] is None and lines["a"]["score"] == 0.5


def test_decoded_export(spark, tmp_path):
    sinks.export_decoded(spark.createDataFrame([(0, b"x"), (9, b"y")], "c int, payload binary"), {"c": ["zero"]}, str(tmp_path / "d"))
    assert {(r.c_name, bytes(r.payload)) for r in spark.read.parquet(str(tmp_path / "d")).collect()} == {("zero", b"x"), ("9", b"y")}


def test_cache_computes_each_missing_key_once(spark, tmp_path):
    items = spark.createDataFrame([("i1", "k1"), ("i2", "k2"), ("i3", "k2"), ("i4", "k3")], "id string, cache_key string")
    cache = spark.createDataFrame([("k1", [1.0])], "cache_key string, features array<double>")

    def compute(batches):
        for pdf in batches:
            pdf["features"] = [[float(len(k))] for k in pdf["cache_key"]]
            yield pdf[["cache_key", "features"]]

    full, fresh = S.with_cached_features(items, cache, compute)
    assert sorted(r.cache_key for r in fresh.collect()) == ["k2", "k3"]
    assert {r.id: r.features for r in full.collect()} == {"i1": [1.0], "i2": [2.0], "i3": [2.0], "i4": [2.0]}
    assert full.where(F.col("features").isNull()).count() == 0
