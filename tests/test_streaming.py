"""Streams must say what the batch form says."""

import os

from pyspark.sql import functions as F

from assayer.operators.decide import isolated_scorer
from assayer.plans.catalog.decisions import curves
from assayer.streaming import decisions as D
from assayer.streaming import inbox as T


def _drain(df, mode, tmp_path, name):
    out = str(tmp_path / name)
    q = df.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / f"{name}-c")).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(out)


def _parts(df, key, folder):
    """One file per value, named so the stream reads them in order."""
    for i, v in enumerate(sorted(r[0] for r in df.select(key).distinct().collect())):
        df.where(F.col(key) == v).coalesce(1).write.json(f"{folder}/{i:03d}")
        os.utime(f"{folder}/{i:03d}")


def test_settle_stream_equals_batch(spark, tmp_path):
    rows = [(s, n, sizes[s]) for n, sizes in {"a": [1, 5, 5, 5], "b": [2, 3, 4, 4], "c": [0, 0, 0, 0], "d": [1, 2, 3, 4], "e": [10, 10, 20, 20]}.items() for s in range(4)]
    snaps = spark.createDataFrame(rows, "scan long, name string, size long")
    _parts(snaps, "scan", str(tmp_path / "in"))
    stream = spark.readStream.schema(snaps.schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in" / "*"))
    got = _drain(T.settle_stream(stream), "append", tmp_path, "settled").collect()
    want = T.settled(snaps).select("name", "settled_at", "size", "outcome").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) == [("a", 2, 5, "accepted"), ("b", 3, 4, "accepted"), ("c", 1, 0, "empty"), ("c", 3, 0, "empty"), ("e", 1, 10, "accepted"), ("e", 3, 20, "accepted")]


def test_lifecycle_stream_equals_batch(spark, tmp_path):
    paths = {1: ["queued", "running", "done"], 2: ["running"], 3: ["queued", "done", "failed"], 4: ["queued", "running", "queued", "running", "failed"], 5: ["queued", "done", "running", "done", "queued"]}
    ev = spark.createDataFrame([(i, s, st) for i, p in paths.items() for s, st in enumerate(p)], "id long, seq long, status string")
    ids = ev.withColumn("id", F.col("id").cast("string"))
    _parts(ids, "seq", str(tmp_path / "in"))
    stream = spark.readStream.schema(ids.schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in" / "*"))
    got = _drain(T.lifecycle_stream(stream), "append", tmp_path, "life")
    bad = sorted((r.id, r.seq, r.was, r.status) for r in got.where("NOT legal").collect())
    assert bad == sorted(tuple(r) for r in T.illegal_transitions(ids).select("id", "seq", "was", "status").collect())
    assert got.count() == ev.count()


def test_watch_folder_takes_each_good_file_once(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    for name, data in {"a.png": b"1", "b.PNG": b"22", ".c.png": b"3", "d.png.part": b"4", "e.png": b""}.items():
        (inbox / name).write_bytes(data)
    take = lambda: T.watch_folder(spark, str(inbox)).select(T.file_name("path").alias("name"), "length")
    assert sorted(r.name for r in _drain(take(), "append", tmp_path, "w").collect()) == ["a.png", "b.PNG"]
    (inbox / "f.png").write_bytes(b"5")
    assert sorted(r.name for r in _drain(take(), "append", tmp_path, "w").collect()) == ["a.png", "b.PNG", "f.png"]


def test_decision_stream_equals_batch_and_isolates_failures(spark, tmp_path):
    items = spark.createDataFrame([(str(i), i) for i in range(30)], "sample_id string, n long")
    items.coalesce(1).write.json(str(tmp_path / "in"))

    def score(df):
        rows = isolated_scorer(df, "d_value", "1.0", lambda f: f["n"] / 30 if not (f["n"] == 7).any() else 1 / 0)
        return rows.withColumn("band", F.lit("medium"))

    stream = spark.readStream.schema(items.schema).json(str(tmp_path / "in"))
    D.decide_stream(stream, score, curves(spark), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch_id")
    want = D.decide_items(score(items), curves(spark))
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
    failed = got.where("status = 'failed'").collect()
    assert [r.id for r in failed] == ["7"] and failed[0].error and failed[0].verdict is None


def test_retention_of_zero_days_keeps_everything(spark):
    files = spark.sql("SELECT 'p' AS path, TIMESTAMP '2000-01-01' AS modified")
    none = spark.createDataFrame([], "path string, status string")
    now = F.lit("2024-01-01").cast("timestamp")
    assert T.expired(files, none, now, 0).count() == 0
    assert T.expired(files, none, now, 1).count() == 1
    assert T.expired(files, spark.createDataFrame([("p", "queued")], none.schema), now, 1).count() == 0


def test_refused_events_move_nothing_in_any_bucket(spark, many_buckets):
    paths = {1: ["queued", "done", "running", "done"], 2: ["running", "queued"], 3: ["queued", "running"] * 40 + ["done", "queued"]}
    ev = spark.createDataFrame([(i, s, st) for i, p in paths.items() for s, st in enumerate(p)], "id long, seq long, status string")
    got = {(r.id, r.seq): (r.was, r.legal) for r in T.transitions(ev).collect()}
    for i, p in paths.items():
        state = ""
        for s, status in enumerate(p):
            legal = (state, status) in T.LEGAL
            assert got[i, s] == (state, legal)
            state = T._move(state, status)
    assert [tuple(r) for r in T.current_state(ev).orderBy("id").collect()] == [(1, 3, "done"), (2, 1, "queued"), (3, 81, "queued")]


def test_a_running_submission_is_requeued_by_the_timer(spark, tmp_path):
    rows = [("a", 0, "queued", "2024-01-01 00:00"), ("a", 1, "running", "2024-01-01 01:00"), ("b", 2, "queued", "2024-01-03 00:00"), ("c", 3, "queued", "2024-01-09 00:00")]
    ev = spark.createDataFrame(rows, "id string, seq long, status string, t string").selectExpr("id", "seq", "status", "cast(t as timestamp) as event_time")
    _parts(ev, "seq", str(tmp_path / "in"))
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in" / "*"))
    got = _drain(T.lifecycle_stream(stream, "1 day"), "append", tmp_path, "timed").collect()
    assert [(r.id, r.was, r.status) for r in got if r.seq is None] == [("a", "running", "queued")]


def test_a_late_old_file_is_taken(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "new.png").write_bytes(b"1")
    take = lambda: T.watch_folder(spark, str(inbox)).select(T.file_name("path").alias("name"))
    _drain(take(), "append", tmp_path, "late")
    (inbox / "old.png").write_bytes(b"2")
    os.utime(inbox / "old.png", (1_000_000_000, 1_000_000_000))
    assert sorted(r.name for r in _drain(take(), "append", tmp_path, "late").collect()) == ["new.png", "old.png"]


def test_submissions_of_one_share_keep_their_own_state_and_timer(spark, tmp_path, monkeypatch):
    """One call of Python and one state for all; "a" and "d" run out at different times, "b" is heard again, "e" ends."""
    monkeypatch.setattr(T, "STATE_SHARES", 1)
    rows = [("a", 0, "queued", "2024-01-01 00:00"), ("b", 1, "queued", "2024-01-01 00:00"), ("d", 2, "queued", "2024-01-01 00:00"), ("e", 3, "queued", "2024-01-01 00:00"),
            ("a", 4, "running", "2024-01-01 01:00"), ("b", 5, "running", "2024-01-01 01:00"), ("e", 6, "running", "2024-01-01 01:00"), ("e", 7, "done", "2024-01-01 02:00"),
            ("d", 8, "running", "2024-01-02 00:00"), ("b", 9, "queued", "2024-01-02 00:00"), ("c", 10, "queued", "2024-01-02 12:00"), ("c", 11, "done", "2024-01-09 00:00")]
    ev = spark.createDataFrame(rows, "id string, seq long, status string, t string").selectExpr("id", "seq", "status", "cast(t as timestamp) as event_time", "cast(t as timestamp) as day")
    _parts(ev, "day", str(tmp_path / "in"))
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in" / "*")).drop("day")
    got = _drain(T.lifecycle_stream(stream, "1 day"), "append", tmp_path, "share").collect()
    assert sorted((r.id, r.was, r.status) for r in got if r.seq is None) == [("a", "running", "queued"), ("d", "running", "queued")]
    assert sorted((r.id, r.seq) for r in got if r.seq is not None and not r.legal) == [("c", 11)]
    assert spark.read.format("statestore").load(str(tmp_path / "share-c")).count() == 1


def test_states_are_as_many_as_shares_without_a_timer(spark, tmp_path, monkeypatch):
    """Two states for 60 unfinished submissions over three batches, and every event judged as the batch form does."""
    monkeypatch.setattr(T, "STATE_SHARES", 2)
    ev = spark.createDataFrame([(str(i), s, st) for i in range(60) for s, st in enumerate(["queued", "done" if i % 3 else "running", "queued"])], "id string, seq long, status string")
    _parts(ev, "seq", str(tmp_path / "in"))
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in" / "*"))
    got = _drain(T.lifecycle_stream(stream), "append", tmp_path, "untimed")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, T.transitions(ev).select(got.columns).collect()))
    assert spark.read.format("statestore").load(str(tmp_path / "untimed-c")).count() == 2
