"""Scan, ingest-check and sink queries over text and columns of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer import fixtures as fx
from assayer.functions import scalar as X
from assayer.plans.catalog.registry import query
from assayer.session import scratch_path
from assayer.sources import ingest, scans, sinks


def _session_docs(spark, d):
    """Order rows written as session documents, some of them malformed."""
    o = fx.table(spark, d, "orders")
    k, ks = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    flag = F.when(F.col("o_orderstatus") == "F", "true").otherwise("false")
    ok = F.when(F.col("o_orderpriority") == "2-HIGH", "true").otherwise("false")
    frames = F.concat(F.lit('[{"index":0,"saved_as":"a.jpg"},{"index":1,"swapped":'), (k % 2).cast("string"), F.lit('},{"index":12}]'))
    full = F.concat(
        F.lit('{"session_id":"s'), ks, F.lit('","swapped":'), flag, F.lit(',"frame_count":'), (k % 9).cast("string"),
        F.lit(',"decision":{"approved":'), ok, F.lit('},"scan":{"verdict":"'), F.col("o_orderpriority"), F.lit('"},"frames":'), frames, F.lit("}"))
    text = (
        F.when(k % 10 == 0, "not json").when(k % 10 == 1, "[1, 2]")
        .when(k % 10 == 2, F.concat(F.lit('{"session_id":"s'), ks, F.lit('","frame_count":"many"}')))
        .when(k % 10 == 3, F.lit('{"swapped":1,"frame_count":5,"decision":null}'))
        .otherwise(full))
    return scans.once(o, F.concat(F.lit("f"), ks).alias("folder"), text.alias("text")).select("folder", "text")


@query("S1_sessions", """
SELECT CASE WHEN k % 10 = 3 THEN 'f' || k ELSE 's' || k END AS session_id, CASE WHEN k % 10 = 3 THEN true ELSE o_orderstatus = 'F' END AS swapped,
  k % 10 <> 3 AND o_orderpriority = '2-HIGH' AS approved, CASE WHEN k % 10 <> 3 THEN o_orderpriority END AS scan_verdict,
  CAST(CASE WHEN k % 10 = 3 THEN 5 ELSE k % 9 END AS INTEGER) AS frame_count FROM (SELECT *, o_orderkey AS k FROM orders) WHERE k % 10 > 2""")
def sessions(spark, d):
    good, _ = scans.good_and_rejected(scans.parse_sessions(_session_docs(spark, d)))
    return good.select("session_id", "swapped", "approved", "scan_verdict", "frame_count")


@query("S1_rejected_sessions", """
SELECT 'f' || o_orderkey AS folder, CASE WHEN o_orderkey % 10 = 2 THEN 'frame_count_not_an_integer' ELSE 'not_a_json_object' END AS reject_reason FROM orders WHERE o_orderkey % 10 < 3""")
def rejected_sessions(spark, d):
    return scans.good_and_rejected(scans.parse_sessions(_session_docs(spark, d)))[1]


@query("S2_frames", """
SELECT 's' || o_orderkey AS session_id, CAST(i AS INTEGER) AS frame_index, CASE i WHEN 0 THEN 'a.jpg' WHEN 1 THEN 'frame_01.jpg' ELSE 'frame_12.jpg' END AS file_name,
  CAST(CASE WHEN i = 1 THEN o_orderkey % 2 WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS INTEGER) AS label
FROM orders, (VALUES (0), (1), (12)) f(i) WHERE o_orderkey % 10 > 3""")
def frames(spark, d):
    good, _ = scans.good_and_rejected(scans.parse_sessions(_session_docs(spark, d)))
    return scans.explode_frames(good)


@query("S3_vendor_results", """
SELECT cache_key, CASE WHEN f > 50 THEN 'MANIPULATED' ELSE 'AUTHENTIC' END AS verdict, f / 100.0 AS score, CAST(CASE WHEN k % 5 = 0 THEN 1 ELSE 2 END AS INTEGER) AS n_models,
  CAST(CASE WHEN k % 5 = 0 THEN CASE WHEN f > 30 THEN 1 ELSE 0 END ELSE CASE WHEN f > 30 THEN 1 ELSE 0 END + CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END END AS INTEGER) AS n_manipulated,
  CASE WHEN k % 5 = 0 THEN f / 200.0 ELSE greatest(f / 200.0, (k % 100) / 100.0) END AS max_model_score
FROM (SELECT 'k' || event_id AS cache_key, event_id AS k, CAST(json_extract(props, '$.k') AS INTEGER) AS f FROM events) WHERE k % 11 <> 0""")
def vendor_results(spark, d):
    e = scans.once(fx.table(spark, d, "events").select("event_id", "props"), F.get_json_object("props", "$.k").cast("int").alias("f"))
    k, f = F.col("event_id"), F.col("f")
    name = lambda n, score, bad: F.concat(F.lit('{"name":"' + n + '","score":'), score.cast("string"), F.lit(',"verdict":"'), F.when(bad, "MANIPULATED").otherwise("AUTHENTIC"), F.lit('"}'))
    m1, m2 = name("m1", f / 200.0, f > 30), name("m2", (k % 100) / 100.0, k % 2 == 0)
    text = F.when(k % 11 == 0, '{"models":[7]}').otherwise(F.concat(
        F.lit('{"verdict":"'), F.when(f > 50, "MANIPULATED").otherwise("AUTHENTIC"), F.lit('","score":'), (f / 100.0).cast("string"),
        F.lit(',"models":['), m1, F.when(k % 5 == 0, "").otherwise(F.concat(F.lit(","), m2)), F.lit("]}")))
    docs = scans.once(e.select(F.concat(F.lit("k"), k.cast("string")).alias("folder"), "event_id", "f"), text.alias("text")).select("folder", "text")
    return scans.parse_vendor_results(docs).where(F.col("reject_reason").isNull()).select(
        "cache_key", "verdict", "score", "n_models", "n_manipulated", "max_model_score")


@query("S4_manifest", """
SELECT c_name AS item_id, c_name || '.jpg' AS filename, CASE c_custkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE -1 END AS label, 'd' || c_nationkey AS "domain" FROM customer""")
def manifest(spark, d):
    path = scratch_path(spark, "manifest")
    _raw_manifest(spark, d).write.option("header", True).csv(path)
    return scans.read_manifest(spark, path)


def _raw_manifest(spark, d):
    k = F.col("c_custkey") % 4
    raw = fx.table(spark, d, "customer").select(
        F.col("c_name").alias("item_id"), F.concat("c_name", F.lit(".jpg")).alias("filename"),
        F.when(k == 0, " Real").when(k == 1, "FAKE ").when(k == 2, "unsure").alias("label"),
        F.concat(F.lit("d"), F.col("c_nationkey").cast("string")).alias("domain"))
    return raw


def _score_lines(spark, d):
    """A score file as its reader sees it: lines of two fields or three, written and read."""
    o = fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), "o_totalprice")
    k = F.col("k")
    raw = (F.when(k % 89 == 0, "abc").when(k % 83 == 0, "nan").when(k % 79 == 0, "-inf").otherwise((F.col("o_totalprice") / 1000).cast("string")))
    ids = F.when(k % 97 == 0, F.concat(F.lit("x"), k.cast("string"))).otherwise(k.cast("string"))
    fields = F.when(k % 73 == 0, F.concat(raw, F.lit(",x"))).otherwise(raw)
    copies = F.explode(F.sequence(F.lit(1), F.when(k % 101 == 0, 2).otherwise(1)))
    path = scratch_path(spark, "scores")
    o.select(ids.alias("sample_id"), fields.alias("score"), copies.alias("_c")).drop("_c").write.option("header", True).option("quote", "").csv(path)
    return scans.read_score_file(spark, path)


def _known(spark, d):
    return fx.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("sample_id"))


@query("S5_score_file_violations", """
WITH l AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 97 = 0 THEN 'x' || o_orderkey ELSE CAST(o_orderkey AS VARCHAR) END AS sample_id, CASE WHEN o_orderkey % 101 = 0 THEN 2 ELSE 1 END AS c FROM orders)
SELECT 'duplicate_id' AS violation, sample_id, CAST(c AS BIGINT) AS n FROM l WHERE c > 1
UNION ALL SELECT 'field_count', sample_id, CAST(c AS BIGINT) FROM l WHERE k % 73 = 0
UNION ALL SELECT 'unparsable_score', sample_id, CAST(c AS BIGINT) FROM l WHERE k % 89 = 0 AND k % 73 <> 0
UNION ALL SELECT 'non_finite_score', sample_id, CAST(c AS BIGINT) FROM l WHERE (k % 83 = 0 OR k % 79 = 0) AND k % 89 <> 0
UNION ALL SELECT 'unknown_id', sample_id, CAST(c AS BIGINT) FROM l WHERE k % 97 = 0""")
def score_file_violations(spark, d):
    return ingest.score_file_violations(_score_lines(spark, d), _known(spark, d))


@query("S6_score_file_coverage", """
SELECT count(*) FILTER (e.event_id IS NOT NULL) AS covered, count(*) AS total, round(count(*) FILTER (e.event_id IS NOT NULL) / count(*), 6) AS coverage
FROM orders LEFT JOIN events e ON e.event_id = o_orderkey""")
def score_file_coverage(spark, d):
    scores = fx.table(spark, d, "events").select(F.col("event_id").cast("string").alias("sample_id"))
    return ingest.coverage(scores, _known(spark, d)).withColumn("coverage", F.round("coverage", 6))


@query("S6_missing_ids", "SELECT CAST(o_orderkey AS VARCHAR) AS sample_id FROM orders WHERE o_orderkey NOT IN (SELECT event_id FROM events)")
def missing_ids(spark, d):
    scores = fx.table(spark, d, "events").select(F.col("event_id").cast("string").alias("sample_id"))
    return ingest.missing_ids(scores, _known(spark, d))


@query("S7_aligned", "SELECT CAST(o_orderkey AS VARCHAR) AS sample_id, o_orderstatus AS status, value AS score FROM orders JOIN events ON event_id = o_orderkey")
def aligned(spark, d):
    recs = fx.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("sample_id"), F.col("o_orderstatus").alias("status"))
    scores = fx.table(spark, d, "events").select(F.col("event_id").cast("string").alias("sample_id"), F.col("value").alias("score"))
    return ingest.aligned(recs, scores)


@query("S8_label_from_path", r"SELECT page_id, regexp_extract(url, '/(en|fr|de)/', 1) AS label_dir FROM pages WHERE regexp_matches(url, '/(en|fr|de)/')")
def label_from_path(spark, d):
    return scans.label_from_path(fx.table(spark, d, "pages").select("page_id", "url"), "url", ["en", "fr", "de"]).select("page_id", "label_dir")


@query("S8_scanned_files", r"""
SELECT page_id, regexp_extract(url, '/(en|fr|de)/', 1) AS label_dir, regexp_extract(url, '/(en|fr|de)/', 1) AS folder FROM pages WHERE regexp_matches(url, '/(en|fr|de)/')""")
def scanned_files(spark, d):
    """Files written below a folder for each label, found again by a scan of the tree: the label from the path, and the path below the root."""
    labels, root = ["en", "fr", "de"], scratch_path(spark, "corpus")
    p = scans.label_from_path(fx.table(spark, d, "pages").select("page_id", "url"), "url", labels)
    for label in labels:
        p.where(F.col("label_dir") == label).select(F.col("page_id").cast("string")).write.text(f"{root}/{label}")
    scans.require_all_labels(scans.scan_labelled_files(spark, root, labels, "part-*"), labels)
    files = scans.label_from_path(scans.scan_files(spark, root, "part-*"), "path", labels)
    lines = F.explode(F.split(F.decode("content", "utf-8"), "\n"))
    return files.select("label_dir", F.split_part("sample_id", F.lit("/"), F.lit(1)).alias("folder"), lines.alias("line")).where("line <> ''").select(F.col("line").cast("long").alias("page_id"), "label_dir", "folder")


@query("S9_relative_id", r"SELECT page_id, ltrim(substr(url, length(regexp_extract(url, '^https?://[^/]+')) + 1), '/') AS sample_id FROM pages")
def relative_id(spark, d):
    p = fx.table(spark, d, "pages").withColumn("root", F.regexp_extract("url", "^https?://[^/]+", 0))
    return p.select("page_id", scans.relative_id("url", "root").alias("sample_id"))


_MAGIC = ["FFD8FFE0", "89504E470D0A1A0A", "424D", "52494646000000005745425020", "52494646000000004156492000", "00000018667479706D703432",
          "0000001466747970717420200", "1A45DFA3930000007765626D00", "1A45DFA39300006D6174726F736B61", "1A45DFA3", ""]
_MAGIC = [m if len(m) % 2 == 0 else m[:-1] for m in _MAGIC]
_SUFFIX = [".jpg", ".png", ".bmp", ".webp", ".avi", ".mp4", ".mov", ".webm", ".mkv", None, None]


@query("S10_media_suffix", "SELECT page_id, CASE page_id % 11 " + " ".join(
    f"WHEN {i} THEN " + ("NULL" if s is None else f"'{s}'") for i, s in enumerate(_SUFFIX)) + " END AS suffix FROM pages")
def media_suffix(spark, d):
    p = fx.table(spark, d, "pages")
    prefix = F.get(F.array(*[F.lit(m) for m in _MAGIC]), (F.col("page_id") % 11).cast("int"))
    content = F.unhex(F.concat(prefix, F.hex(F.encode("html", "utf-8"))))
    return p.select("page_id", X.media_suffix(content).alias("suffix"))


@query("S11_admission", """
SELECT reason, count(*) AS n FROM (SELECT CASE WHEN b > 268435456 THEN 'file_too_large' WHEN w <= 0 OR h <= 0 THEN 'invalid_dimensions' WHEN w * h > 33177600 THEN 'too_many_pixels'
  WHEN fr > 0 AND fr / CASE WHEN isfinite(fps) AND fps > 0 THEN fps ELSE 25 END > 1800 THEN 'too_long' END AS reason
 FROM (SELECT l_extendedprice * 3000 AS b, CAST(l_quantity AS BIGINT) * 180 - 180 AS w, l_partkey % 60 * 120 AS h, l_suppkey * 700 AS fr,
  CASE l_linenumber WHEN 1 THEN 0.0 WHEN 2 THEN -30.0 WHEN 3 THEN CAST('nan' AS DOUBLE) WHEN 4 THEN CAST('inf' AS DOUBLE) WHEN 5 THEN 60.0 ELSE 30.0 END AS fps FROM lineitem)) GROUP BY 1""")
def admission(spark, d):
    n = F.col("l_linenumber")
    fps = (F.when(n == 1, 0.0).when(n == 2, -30.0).when(n == 3, float("nan")).when(n == 4, float("inf")).when(n == 5, 60.0).otherwise(30.0))
    reason = X.admission_reason(
        F.col("l_extendedprice") * 3000, F.col("l_quantity").cast("bigint") * 180 - 180, F.col("l_partkey") % 60 * 120, F.col("l_suppkey") * 700, fps)
    return fx.table(spark, d, "lineitem").groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("S12_decoded_labels", """
SELECT vec_id, CASE label WHEN 0 THEN 'zero' WHEN 1 THEN 'one' WHEN 2 THEN 'two' WHEN 3 THEN 'three' ELSE CAST(label AS VARCHAR) END AS label_name FROM embeddings""")
def decoded_labels(spark, d):
    path = scratch_path(spark, "labels")
    sinks.export_decoded(fx.table(spark, d, "embeddings").select("vec_id", "label"), {"label": ["zero", "one", "two", "three"]}, path)
    return spark.read.schema("vec_id long, label int, label_name string").parquet(path).select("vec_id", "label_name")


@query("S13_curve_violations", """
SELECT 's' || s_suppkey AS detector, band, CASE WHEN v <> 1 THEN 'format_version' WHEN NOT isfinite(prior) THEN 'non_finite' ELSE 'unknown_band' END AS reason
FROM (SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'great' ELSE 'low' END AS band, CASE WHEN s_suppkey % 7 = 0 THEN 2 ELSE 1 END AS v,
  CASE WHEN s_suppkey % 3 = 0 THEN CAST('inf' AS DOUBLE) ELSE 0.5 END AS prior FROM supplier) WHERE v <> 1 OR NOT isfinite(prior) OR band = 'great'""")
def curve_violations(spark, d):
    return ingest.curve_violations(_curves(spark, d))


def _curves(spark, d):
    k = F.col("s_suppkey")
    return fx.table(spark, d, "supplier").select(
        F.concat(F.lit("s"), k.cast("string")).alias("detector"), F.when(k % 5 == 0, "great").otherwise("low").alias("band"),
        (F.col("s_acctbal") / 1000).alias("coef"), F.lit(0.0).alias("intercept"), F.when(k % 3 == 0, float("inf")).otherwise(0.5).alias("prior"),
        F.lit(6.0).alias("max_abs_llr"), F.when(k % 7 == 0, 2).otherwise(1).alias("format_version"))


@query("S13_curve_round_trip", """
SELECT 's' || s_suppkey AS detector, 'low' AS band, round(s_acctbal / 1000, 6) AS coef, 0.0::DOUBLE AS intercept, 0.5::DOUBLE AS prior, 6.0::DOUBLE AS max_abs_llr, 1 AS format_version
FROM supplier WHERE s_suppkey % 7 <> 0 AND s_suppkey % 3 <> 0 AND s_suppkey % 5 <> 0""")
def curve_round_trip(spark, d):
    c = _curves(spark, d)
    path = scratch_path(spark, "curves")
    ingest.save_curves(c.join(ingest.curve_violations(c), ["detector", "band"], "left_anti"), path)
    return ingest.load_curves(spark, path).select("detector", "band", F.round("coef", 6).alias("coef"), "intercept", "prior", "max_abs_llr", "format_version")


@query("S15_report_json", """
SELECT '{"balance":' || CASE WHEN s_suppkey % 3 = 0 THEN 'null' ELSE CAST(CAST(s_nationkey AS DOUBLE) / 4 AS VARCHAR) END || ',"key":' || s_suppkey || ',"large":' || CASE WHEN s_acctbal > 5000 THEN 'true' ELSE 'false' END || '}' AS line FROM supplier""")
def report_json(spark, d):
    k = F.col("s_suppkey")
    bad = F.when(k % 2 == 0, float("nan")).otherwise(float("-inf"))
    rows = fx.table(spark, d, "supplier").select(
        k.alias("key"), F.when(k % 3 == 0, bad).otherwise(F.col("s_nationkey") / 4.0).alias("balance"), (F.col("s_acctbal") > 5000).alias("large"))
    return rows.select(sinks.report_json(rows).alias("line"))


@query("S16_corpus_label", r"""
SELECT page_id, coalesce(list_filter(string_split(replace(p, '\', '/'), '/'), lambda x: x NOT IN ('', '.', '..'))[-1], 'unknown') AS corpus
FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN replace(url, '/', '\') || '\' WHEN 2 THEN '/../' ELSE NULL END AS p FROM pages)""")
def corpus_label(spark, d):
    p, i = fx.table(spark, d, "pages"), F.col("page_id") % 4
    path = F.when(i == 0, F.col("url")).when(i == 1, F.concat(F.replace("url", F.lit("/"), F.lit("\\")), F.lit("\\"))).when(i == 2, "/../")
    return p.select("page_id", X.corpus_label(path).alias("corpus"))
