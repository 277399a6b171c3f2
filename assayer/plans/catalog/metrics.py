"""Metric queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer import fixtures as fx
from assayer.operators import curve as V
from assayer.operators import metrics as M
from assayer.plans.catalog.registry import query


def r6(c):
    return F.round(c, 6)


def auc_sql(source: str, by: str, score: str = "score", label: str = "label") -> str:
    """Average-rank AUC, the other way round from the engine's bucket sums."""
    return f"""(SELECT {by}, CASE WHEN max(p) > 0 AND max(n) > 0 THEN (sum(CASE WHEN y = 1 THEN rk END) - max(p) * (max(p) + 1) / 2.0) / (CAST(max(p) AS DOUBLE) * max(n)) END AS auc,
  CAST(max(p) AS BIGINT) AS n_pos, CAST(max(n) AS BIGINT) AS n_neg FROM (
  SELECT {by}, {label} AS y, rank() OVER (PARTITION BY {by} ORDER BY {score}) + (count(*) OVER (PARTITION BY {by}, {score}) - 1) / 2.0 AS rk,
    sum({label}) OVER (PARTITION BY {by}) AS p, sum(1 - {label}) OVER (PARTITION BY {by}) AS n FROM {source} WHERE {score} IS NOT NULL) GROUP BY {by})"""


def tpr_sql(source: str, by: str, fpr: float, score: str = "score", label: str = "label") -> str:
    return f"""(SELECT s.{by}, CASE WHEN max(thr) IS NOT NULL AND sum({label}) > 0 THEN avg(CASE WHEN {label} = 1 THEN CASE WHEN {score} > thr THEN 1.0 ELSE 0.0 END END) END AS tpr
  FROM {source} s LEFT JOIN (SELECT {by}, quantile_cont({score}, {1.0 - fpr!r}) AS thr FROM {source} WHERE {label} = 0 AND {score} IS NOT NULL GROUP BY 1) t
  ON s.{by} IS NOT DISTINCT FROM t.{by} WHERE {score} IS NOT NULL GROUP BY 1)"""


@query("M1_auc", f"SELECT detector, round(auc, 6) AS auc, n_pos, n_neg FROM {auc_sql('fx_joined', 'detector')}", ("fx_joined",))
def auc(spark, d):
    return V.auc(fx.scored(spark, d), ["detector"]).withColumn("auc", r6("auc"))


@query("M1_auc_lineitem", "WITH li AS (SELECT l_returnflag, l_extendedprice, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS label FROM lineitem) "
       f"SELECT l_returnflag, round(auc, 6) AS auc, n_pos, n_neg FROM {auc_sql('li', 'l_returnflag', 'l_extendedprice')}")
def auc_lineitem(spark, d):
    li = fx.table(spark, d, "lineitem").select("l_returnflag", "l_extendedprice", (F.col("l_linestatus") == "O").cast("int").alias("label"))
    return V.auc(li, ["l_returnflag"], "l_extendedprice").withColumn("auc", r6("auc"))


@query("M2_tpr_at_fpr", f"""SELECT a.detector, round(a.tpr, 6) AS tpr_at_1pct, round(b.tpr, 6) AS tpr_at_10pct
FROM {tpr_sql('fx_joined', 'detector', 0.01)} a JOIN {tpr_sql('fx_joined', 'detector', 0.1)} b ON a.detector = b.detector""", ("fx_joined",))
def tpr_at_fpr(spark, d):
    t = V.tpr_at_fpr(fx.scored(spark, d), ["detector"], {"tpr_at_1pct": 0.01, "tpr_at_10pct": 0.1})
    return t.select("detector", r6("tpr_at_1pct").alias("tpr_at_1pct"), r6("tpr_at_10pct").alias("tpr_at_10pct"))


_EDGES = ", ".join(repr(i * 0.1) if i < 10 else "1.0" for i in range(11))


def ece_sql(source: str, by: str) -> str:
    return f"""(SELECT {by}, sum(n * abs(mp - my)) / sum(n) AS ece, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT {by}, greatest(len(list_filter([{_EDGES}]::DOUBLE[], lambda e: e < score)) - 1, 0) AS bin, count(*) AS n, avg(score) AS mp, avg(label) AS my
  FROM {source} WHERE score IS NOT NULL GROUP BY 1, 2) GROUP BY 1)"""


@query("M3_ece", f"SELECT detector, round(ece, 6) AS ece, n FROM {ece_sql('fx_joined', 'detector')}", ("fx_joined",))
def ece(spark, d):
    return M.ece(fx.scored(spark, d), ["detector"]).select("detector", r6("ece").alias("ece"), "n")


@query("M8_kish_ess", "SELECT label, round(pow(sum(n), 2) / sum(n * n), 6) AS ess FROM (SELECT label, \"domain\", CAST(count(*) AS DOUBLE) AS n FROM fx_records GROUP BY 1, 2) GROUP BY 1", ("fx_records",))
def kish(spark, d):
    return M.kish_ess(fx.records(spark, d), "domain", ["label"]).select("label", r6("ess").alias("ess"))


@query("M9_autocorrelation_ess", """
WITH c AS (SELECT user_id, ts, value, value - avg(value) OVER (PARTITION BY user_id) AS x FROM events),
l AS (SELECT user_id, x, lag(x) OVER (PARTITION BY user_id ORDER BY ts, value) AS px FROM c),
g AS (SELECT user_id, count(*) AS n, sum(x * px) / sum(x * x) AS rho, sqrt(sum(x * x) / count(*)) AS sd FROM l GROUP BY 1)
SELECT user_id, n, round(CASE WHEN n < 3 THEN n WHEN sd < 1e-12 THEN 1 ELSE least(n, greatest(1.0, n * (1 - greatest(-0.999, least(0.999, rho))) / (1 + greatest(-0.999, least(0.999, rho))))) END, 6) AS ess FROM g""")
def autocorrelation_ess(spark, d):
    return M.autocorrelation_ess(fx.table(spark, d, "events"), "user_id", "ts", "value").select("user_id", "n", r6("ess").alias("ess"))


@query("M10_session_max", "SELECT session_id, round(max(score), 6) AS score, CAST(round_even(avg(label), 0) AS INTEGER) AS label FROM (SELECT session_id, score, CASE WHEN t % 2 = 0 THEN label ELSE 1 END AS label FROM fx_frames) GROUP BY 1", ("fx_frames",))
def session_max(spark, d):
    f = fx.frames(spark, d).withColumn("label", F.when(F.col("t") % 2 == 0, F.col("label")).otherwise(1))
    return M.session_max(f).withColumn("score", r6("score"))


@query("M11_session_mean", "SELECT session_id, round(avg(score), 6) AS score, min(label) AS label, min(label) <> max(label) AS conflicting FROM (SELECT session_id, score, CASE WHEN t = 4 THEN 1 ELSE label END AS label FROM fx_frames) GROUP BY 1", ("fx_frames",))
def session_mean(spark, d):
    f = fx.frames(spark, d).withColumn("label", F.when(F.col("t") == 4, 1).otherwise(F.col("label")))
    return M.session_mean(f).withColumn("score", r6("score"))


_BUDGETS = {"caught_at_0": 0.0, "caught_at_2_6pct": 0.026, "caught_at_5pct": 0.05, "caught_at_10pct": 0.1}


@query("M12_catch_at_budget", """
WITH s AS (SELECT detector, score, label FROM fx_joined WHERE score IS NOT NULL),
t AS (SELECT detector, score, sum(sum(label)) OVER w AS tp, sum(sum(1 - label)) OVER w AS fp, sum(sum(label)) OVER (PARTITION BY detector) AS p, sum(sum(1 - label)) OVER (PARTITION BY detector) AS n
  FROM s GROUP BY detector, score WINDOW w AS (PARTITION BY detector ORDER BY score DESC))
SELECT detector, """ + ", ".join(f"round(coalesce(max(CASE WHEN CAST(fp AS DOUBLE) / n <= {b!r} THEN CAST(tp AS DOUBLE) / p END), 0), 6) AS {k}" for k, b in _BUDGETS.items()) + " FROM t GROUP BY 1", ("fx_joined",))
def catch_at_budget(spark, d):
    c = V.catch_at_budget(fx.scored(spark, d), ["detector"], _BUDGETS)
    return c.select("detector", *[r6(k).alias(k) for k in _BUDGETS])


@query("M13_per_band", f"""
WITH s AS (SELECT * FROM fx_frames), a AS {auc_sql('s', 'band')}, t AS {tpr_sql('s', 'band', 0.0)}
SELECT s.band, count(*) AS n, count(CASE WHEN label = 0 THEN 1 END) AS n_genuine, count(CASE WHEN label = 1 THEN 1 END) AS n_swapped,
  round(max(a.auc), 6) AS auc, round(max(t.tpr), 6) AS tpr_at_zero FROM s LEFT JOIN a ON a.band = s.band LEFT JOIN t ON t.band = s.band GROUP BY 1""", ("fx_frames",))
def per_band(spark, d):
    return M.per_band(fx.frames(spark, d)).select("band", "n", "n_genuine", "n_swapped", r6("auc").alias("auc"), r6("tpr_at_zero").alias("tpr_at_zero"))


@query("M14_abstention_by_class", "SELECT detector, coalesce(generator, 'real') AS class, count(*) FILTER (score IS NULL) AS abstained, count(*) AS total FROM fx_joined GROUP BY 1, 2", ("fx_joined",))
def abstention_by_class(spark, d):
    return M.abstention_by_class(fx.scored(spark, d))


@query("M15_abstention_reasons", "SELECT detector, CASE WHEN band = 'reject' THEN 'below_quality_floor' ELSE 'too_dark' END AS reason, count(*) AS n FROM fx_joined WHERE score IS NULL GROUP BY 1, 2", ("fx_joined",))
def abstention_reasons(spark, d):
    s = fx.scored(spark, d).withColumn("abstained", F.col("score").isNull()).withColumn("reason", F.when(F.col("band") == "reject", "below_quality_floor").otherwise("too_dark"))
    return M.abstention_reasons(s)


@query("M16_detector_report", f"""
WITH a AS {auc_sql('fx_joined', 'detector')}, t1 AS {tpr_sql('fx_joined', 'detector', 0.01)}, t2 AS {tpr_sql('fx_joined', 'detector', 0.001)}, e AS {ece_sql('fx_joined', 'detector')},
h AS (SELECT detector, count(*) AS n, avg(CASE WHEN score IS NULL THEN 1.0 ELSE 0.0 END) AS ab, quantile_cont(value * 2, 0.95) AS p95 FROM fx_joined GROUP BY 1)
SELECT h.detector, h.n, round(ab, 6) AS abstention_rate, round(auc, 6) AS auc, round(t1.tpr, 6) AS tpr_at_1pct, round(t2.tpr, 6) AS tpr_at_0p1pct, round(ece, 6) AS ece, round(p95, 6) AS p95_latency_ms
FROM h LEFT JOIN a ON a.detector = h.detector LEFT JOIN t1 ON t1.detector = h.detector LEFT JOIN t2 ON t2.detector = h.detector LEFT JOIN e ON e.detector = h.detector""", ("fx_joined",))
def detector_report(spark, d):
    s = fx.scored(spark, d).withColumn("latency_ms", F.col("value") * 2)
    rep = M.detector_report(s, ["detector"], latency="latency_ms")
    return rep.select("detector", "n", *[r6(c).alias(c) for c in ("abstention_rate", "auc", "tpr_at_1pct", "tpr_at_0p1pct", "ece", "p95_latency_ms")])


@query("M17_latency_summary", """
SELECT l_returnflag, round(avg(CASE WHEN NOT w THEN ms END), 6) AS mean, count(*) FILTER (w) AS n_warmup, round(quantile_cont(CASE WHEN NOT w THEN ms END, 0.5), 6) AS p50,
  round(quantile_cont(CASE WHEN NOT w THEN ms END, 0.95), 6) AS p95 FROM (SELECT l_returnflag, l_linenumber = 1 AS w, l_extendedprice / 100 AS ms FROM lineitem) GROUP BY 1""")
def latency_summary(spark, d):
    li = fx.table(spark, d, "lineitem").select("l_returnflag", (F.col("l_linenumber") == 1).alias("w"), (F.col("l_extendedprice") / 100).alias("latency_ms"))
    s = M.latency_summary(li, ["l_returnflag"], warmup="w")
    return s.select("l_returnflag", r6("mean").alias("mean"), "n_warmup", r6("p50").alias("p50"), r6("p95").alias("p95"))


@query("M21_tpr_by_variant", "WITH li AS (SELECT 'v' || l_linenumber AS variant, l_extendedprice AS score, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS label FROM lineitem) "
       f"SELECT variant, round(tpr, 6) AS tpr FROM {tpr_sql('li', 'variant', 0.01)}")
def tpr_by_variant(spark, d):
    li = fx.table(spark, d, "lineitem").select(
        F.concat(F.lit("v"), F.col("l_linenumber").cast("string")).alias("variant"), F.col("l_extendedprice").alias("score"), (F.col("l_linestatus") == "O").cast("int").alias("label"))
    return V.tpr_at_fpr(li, ["variant"], {"tpr": 0.01}).select("variant", r6("tpr").alias("tpr"))


@query("M22_lookup_table", "SELECT stratum, count(*) FILTER (label = 0) AS genuine, count(*) FILTER (label = 1) AS swapped FROM fx_docs GROUP BY 1", ("fx_docs",))
def lookup_table(spark, d):
    return M.lookup_accuracy(fx.docs(spark, d), "stratum")[0]


@query("M22_lookup_accuracy", """
SELECT count(*) AS distinct_keys, round(sum(greatest(a, b)) / sum(a + b), 6) AS accuracy FROM (SELECT score, count(*) FILTER (label = 0) AS a, count(*) FILTER (label = 1) AS b FROM fx_docs GROUP BY 1)""", ("fx_docs",))
def lookup_accuracy(spark, d):
    return M.lookup_accuracy(fx.docs(spark, d), "score")[1].withColumn("accuracy", r6("accuracy"))


@query("M23_single_key_status", """
SELECT l_shipmode AS grp, count(DISTINCT k) AS distinct_keys, CASE WHEN count(DISTINCT k) > 1 THEN 'not_measured' ELSE 'measured' END AS status
FROM (SELECT l_linenumber AS l_shipmode, CASE WHEN l_linenumber < 4 THEN l_returnflag ELSE 'T' END AS k FROM lineitem) GROUP BY 1""")
def single_key_status(spark, d):
    li = fx.table(spark, d, "lineitem").select(F.col("l_linenumber").alias("grp"), F.when(F.col("l_linenumber") < 4, F.col("l_returnflag")).otherwise("T").alias("k"))
    return M.single_key_status(li, "k", ["grp"])


@query("M24_aggregate_is_max_like", """
SELECT round(avg(abs(s - m)), 6) AS mean_gap, count(*) AS n, avg(abs(s - m)) <= 0.2 AS max_like
FROM (SELECT l_discount * 10 AS s, CASE WHEN l_linenumber = 7 THEN NULL ELSE greatest(l_tax * 12, l_discount * 8) END AS m FROM lineitem WHERE l_linenumber <> 6) WHERE m IS NOT NULL""")
def max_like(spark, d):
    li = fx.table(spark, d, "lineitem").select(
        F.when(F.col("l_linenumber") == 6, float("nan")).otherwise(F.col("l_discount") * 10).alias("score"),
        F.when(F.col("l_linenumber") != 7, F.greatest(F.col("l_tax") * 12, F.col("l_discount") * 8)).alias("max_model_score"))
    return M.aggregate_is_max_like(li).withColumn("mean_gap", r6("mean_gap"))


@query("M25_band_coverage", """
WITH b AS (SELECT band, count(*) AS n FROM fx_banded GROUP BY 1)
SELECT coalesce(string_agg(CASE WHEN band IN ('low', 'high') THEN band END, ',' ORDER BY band), '') AS covered_bands, coalesce(string_agg(CASE WHEN band NOT IN ('low', 'high') THEN band END, ',' ORDER BY band), '') AS uncovered_bands,
  CAST(sum(CASE WHEN band IN ('low', 'high') THEN n ELSE 0 END) AS BIGINT) AS frames_covered, CAST(sum(n) AS BIGINT) AS frames, round(sum(CASE WHEN band IN ('low', 'high') THEN n ELSE 0 END) / sum(n), 6) AS fraction_covered FROM b""", ("fx_banded",))
def band_coverage(spark, d):
    b = fx.banded(spark, d).groupBy("band").agg(F.count(F.lit(1)).alias("n"))
    fitted = spark.createDataFrame([("low",), ("high",)], "band string")
    return M.band_coverage(b, fitted).withColumn("fraction_covered", r6("fraction_covered"))


_TREE = """
l1 AS (SELECT substr(k, 1, 6) AS k, sha256(string_agg(d, chr(10) ORDER BY k)) AS d, sum(n) AS n FROM l0 GROUP BY 1),
l2 AS (SELECT substr(k, 1, 3) AS k, sha256(string_agg(d, chr(10) ORDER BY k)) AS d, sum(n) AS n FROM l1 GROUP BY 1)
SELECT sha256(string_agg(d, chr(10) ORDER BY k)) AS dataset_hash, CAST(sum(n) AS BIGINT) AS n FROM l2"""


@query("M26_dataset_hash", """
WITH r AS (SELECT sha256('{"align":null,"compression":"' || compression || '","face_detector":null,"generator":' || coalesce('"' || generator || '"', 'null') || ',"label":' || label
  || ',"sample_id":"' || sample_id || '","source_id":"' || source_id || '","subject_id":"' || subject_id || '"}') AS k FROM fx_records),
l0 AS (SELECT k, k || ':' || count(*) AS d, count(*) AS n FROM r GROUP BY k),""" + _TREE, ("fx_records",))
def dataset_hash(spark, d):
    return M.dataset_hash(fx.records(spark, d))


@query("M27_corpus_block", """
WITH c AS (SELECT "domain", count(*) AS n, count(*) FILTER (label = 0) AS r, count(*) FILTER (label = 1) AS k, count(*) FILTER (band <> 'reject') AS f FROM fx_banded GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS records, CAST(sum(r) AS BIGINT) AS reals, CAST(sum(k) AS BIGINT) AS fakes, CAST(sum(f) AS BIGINT) AS n_face_subset, CAST(sum(n) - sum(f) AS BIGINT) AS n_no_face,
  count(*) AS domains, max(n) AS largest_domain, round(pow(CAST(sum(r) AS DOUBLE), 2) / sum(r * r), 6) AS ess_reals, round(pow(CAST(sum(k) AS DOUBLE), 2) / sum(k * k), 6) AS ess_fakes FROM c""", ("fx_banded",))
def corpus_block(spark, d):
    r = fx.banded(spark, d).withColumn("has_face", F.col("band") != "reject")
    return M.corpus_block(r).withColumn("ess_reals", r6("ess_reals")).withColumn("ess_fakes", r6("ess_fakes"))


@query("M28_status_counts", "SELECT status, verdict, count(*) AS n FROM fx_submissions GROUP BY 1, 2", ("fx_submissions",))
def status_counts(spark, d):
    return M.status_counts(fx.submissions(spark, d))


@query("M29_standardiser", """
SELECT l_returnflag, CAST(i AS INTEGER) AS i, round(avg(x), 6) AS mean, round(CASE WHEN stddev_pop(x) < 1e-9 THEN 1 ELSE stddev_pop(x) END, 6) AS scale
FROM (SELECT l_returnflag, unnest([0, 1, 2]) AS i, unnest([l_quantity, l_discount, 4.0]) AS x FROM lineitem) GROUP BY 1, 2""")
def standardiser(spark, d):
    li = fx.table(spark, d, "lineitem").select("l_returnflag", F.array("l_quantity", "l_discount", F.lit(4.0)).alias("f"))
    s = M.standardiser(li, "f", 3, ["l_returnflag"])
    z = s.select("l_returnflag", F.posexplode(F.arrays_zip("mean", "scale")).alias("i", "v"))
    return z.select("l_returnflag", "i", r6("v.mean").alias("mean"), r6("v.scale").alias("scale"))


@query("M30_face_summary", """
SELECT l_orderkey, count(*) FILTER (f > 0) || '/' || count(*) AS frames_with_face, max(f) AS face_count_max FROM (SELECT l_orderkey, CAST(floor(l_quantity / 10) AS BIGINT) AS f FROM lineitem) GROUP BY 1""")
def face_summary(spark, d):
    li = fx.table(spark, d, "lineitem").select("l_orderkey", F.floor(F.col("l_quantity") / 10).alias("f"))
    return M.face_summary(li, "l_orderkey", "f")


@query("M31_family_counts", "SELECT coalesce(generator, 'real') AS family, count(*) AS n FROM fx_records GROUP BY 1", ("fx_records",))
def family_counts(spark, d):
    return M.family_counts(fx.records(spark, d))
