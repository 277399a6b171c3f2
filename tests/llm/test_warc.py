from __future__ import annotations

import base64
import hashlib
import os

from assayer.llm import store, warc


def digest(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def want(rows, least=0):
    first = {}
    for i, _, h in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        first.setdefault((h or "").encode(), i)
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        if i is not None:
            other = len(b) >= least and first[b] != i
            out.append((i, len(b), digest(b), "revisit" if other else "response", first[b] if other else None))
    return sorted(out)


def found(df):
    return sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect())


FAKE = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:666>\r\nContent-Length: 4\r\n\r\nevil\r\n\r\n"
ROWS = (
    [(i, f"http://a/{i}", f"<p>page {i % 60} é</p>\r\n\r\n") for i in range(200)]
    + [(1000, None, None), (1001, "u", ""), (1002, "u\r\nX: y", "x" * 200_000), (1003, "u", FAKE), (1004, "u", "pre" + FAKE * 3 + "post"), (1005, "u", "WARC/1.0\r\n"), (1006, "u", FAKE), (1007, "u", "WARC/1.0\r\n" * 50), (1008, "u", "ends with WARC/1.0\r"), (None, "u", "nameless")]
    + [(1009, "u", FAKE.replace("Content-Length: 4", "Content-Length: 99999999")), (1010, "u", "\r\n\r\nWARC/1.0\r\n\r\n"), (1011, "u", "日本" * 1000)]
)
KIND = "page_id long, url string, html string"


def test_archives_come_back_whole(spark):
    df = spark.createDataFrame(ROWS, KIND).selectExpr("*", "1 as n", "'x' as file", "3 as first")
    assert found(warc.archive(df)) == want(ROWS)


def test_archives_are_concatenated_records_in_bounded_files(spark):
    path = store.shared_path(spark, "warc-test")
    warc.write(spark.createDataFrame(ROWS[:50], KIND).coalesce(1), path, rows_per_file=20)
    local = path.removeprefix("file:")
    files = sorted(f"{local}/{f}" for f in os.listdir(local) if f.startswith("part-"))
    assert len(files) == 3
    for f in files:
        data = open(f, "rb").read()
        at = 0
        while at < len(data):
            assert data[at:].startswith(b"WARC/1.0\r\n")
            end = data.index(b"\r\n\r\n", at)
            size = int([x for x in data[at:end].split(b"\r\n") if x.startswith(b"Content-Length")][0].split(b":")[1])
            at = end + 4 + size + 4
        assert at == len(data)


def test_small_splits_give_the_same_chain(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        assert found(warc.archive(spark.createDataFrame(ROWS, KIND).coalesce(2))) == want(ROWS)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_least_bytes_ties_and_no_pages(spark):
    rows = [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef"), (4, "u", "abcdef")]
    df = spark.createDataFrame(rows, KIND)
    got = found(warc.archive(df, least_bytes=5))
    assert [(g[0], g[3], g[4]) for g in got] == [(1, "response", None), (2, "response", None), (3, "response", None), (4, "revisit", 3), (4, "revisit", 3)]
    assert found(warc.archive(df.limit(0))) == []


def test_a_cut_file_ends_at_its_last_whole_record(spark):
    path = store.shared_path(spark, "warc-cut")
    warc.write(spark.createDataFrame(ROWS[:5], KIND).coalesce(1), path)
    local = path.removeprefix("file:")
    f = next(f"{local}/{x}" for x in os.listdir(local) if x.startswith("part-"))
    data = open(f, "rb").read()
    other = store.shared_path(spark, "warc-cut").removeprefix("file:")
    os.makedirs(other)
    open(f"{other}/cut.warc", "wb").write(data[: len(data) - 12])
    assert [r[0] for r in found(warc.read(spark, other))] == [0, 1, 2, 3]
