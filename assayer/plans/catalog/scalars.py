"""Projection, predicate and scalar-function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer import fixtures as fx
from assayer.functions import scalar as X
from assayer.operators import observations as O
from assayer.plans.catalog.registry import query
from assayer.sources.ingest import audit_violations


@query("P1_quality_band", """
SELECT l_returnflag, CASE WHEN iod < 32 OR blur < 20 THEN 'reject' WHEN NOT (ex BETWEEN 0.15 AND 0.90) THEN 'low'
  WHEN iod >= 96 AND blur >= 100 AND abs(yaw) <= 30 THEN 'high' WHEN iod >= 64 THEN 'medium' ELSE 'low' END AS band,
  count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS lines
FROM (SELECT *, l_quantity + l_partkey % 80 AS iod, l_extendedprice / 300 AS blur, l_suppkey % 70 - 20 AS yaw, l_discount * 10 AS ex FROM lineitem)
GROUP BY 1, 2""")
def quality_band(spark, d):
    li = fx.table(spark, d, "lineitem")
    band = X.quality_band(
        F.col("l_quantity") + F.col("l_partkey") % 80, F.col("l_extendedprice") / 300,
        F.col("l_suppkey") % 70 - 20, F.col("l_discount") * 10,
    )
    return li.groupBy("l_returnflag", band.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.sum("l_linenumber").alias("lines"))


@query("P2_meets_floor", """
SELECT f.floor, band, CASE WHEN f.floor = 'low' THEN band IN ('low','medium','high')
  WHEN f.floor = 'medium' THEN band IN ('medium','high') ELSE band = 'high' END AS meets, count(*) AS n
FROM fx_banded, (VALUES ('low'),('medium'),('high')) f(floor) GROUP BY 1, 2, 3""", ("fx_banded",))
def meets_floor(spark, d):
    bands = fx.banded(spark, d).groupBy("band").agg(F.count(F.lit(1)).alias("n"))
    arms = F.array(*[F.struct(F.lit(f).alias("floor"), X.meets_floor("band", f).alias("meets")) for f in ("low", "medium", "high")])
    return bands.select("band", "n", F.inline(arms))


@query("P3_worst_band", """
SELECT subject_id, CASE min(CASE WHEN generator IS DISTINCT FROM 'error' THEN CASE band WHEN 'reject' THEN 1 WHEN 'low' THEN 2 WHEN 'medium' THEN 3 ELSE 4 END END)
  WHEN 1 THEN 'reject' WHEN 2 THEN 'low' WHEN 3 THEN 'medium' WHEN 4 THEN 'high' ELSE 'unmeasured' END AS worst_band
FROM fx_banded GROUP BY 1""", ("fx_banded",))
def worst_band(spark, d):
    obs = fx.banded(spark, d)
    measured = obs.withColumn("band", F.when(~F.col("generator").eqNullSafe(F.lit("error")), F.col("band")))
    return O.worst_band(measured, "subject_id").select("subject_id", "worst_band")


@query("P4_reason_aggregate", """
SELECT c_custkey AS sample_id, CASE WHEN count(o_orderkey) = 0 THEN 'no_observations'
  WHEN bool_or(o_orderstatus = 'F') THEN 'ok'
  WHEN count(DISTINCT o_orderstatus) = 1 THEN max(CASE o_orderstatus WHEN 'O' THEN 'no_face' ELSE 'degenerate_box' END)
  ELSE 'mixed' END AS reason
FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1""")
def reason_aggregate(spark, d):
    samples = fx.table(spark, d, "customer").select(F.col("c_custkey").alias("sample_id"))
    o = fx.table(spark, d, "orders")
    st = F.col("o_orderstatus")
    obs = o.select(F.col("o_custkey").alias("sample_id"), F.when(st == "F", "ok").when(st == "O", "no_face").otherwise("degenerate_box").alias("reason"))
    return O.aggregate_reasons(samples, obs)


@query("P5_quality_floor", """
SELECT c_custkey AS sample_id, count(o_orderkey) AS n_observations,
  count(CASE WHEN o_orderstatus <> 'P' AND o_totalprice >= 250000 THEN 1 END) AS n_usable,
  CASE WHEN count(o_orderkey) = 0 THEN 'no_observations'
    WHEN count(CASE WHEN o_orderstatus <> 'P' AND o_totalprice >= 250000 THEN 1 END) > 0 THEN NULL
    WHEN count(CASE WHEN o_orderstatus <> 'P' THEN 1 END) > 0 THEN 'below_quality_floor' ELSE 'quality_not_measured' END AS reason
FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1""")
def quality_floor(spark, d):
    samples = fx.table(spark, d, "customer").select(F.col("c_custkey").alias("sample_id"))
    price = F.col("o_totalprice")
    band = F.when(price < 100000, "reject").when(price < 250000, "low").when(price < 400000, "medium").otherwise("high")
    obs = fx.table(spark, d, "orders").select(
        F.col("o_custkey").alias("sample_id"), F.when(F.col("o_orderstatus") != "P", band).alias("band"))
    return O.quality_floor(samples, obs, "medium")


@query("P6_abstentions", """
SELECT sample_id, 'd_value' AS detector, '1.0' AS version, CAST(NULL AS DOUBLE) AS score, true AS abstained, 'below_quality_floor' AS reason
FROM fx_banded WHERE band = 'reject'""", ("fx_banded",))
def abstentions(spark, d):
    return O.abstain(fx.banded(spark, d).where(F.col("band") == "reject"), "d_value", "1.0", "below_quality_floor")


@query("P7_clamped_boxes", """
SELECT ordinal, count(*) AS n, count(CASE WHEN w1 >= 2 AND h1 >= 2 THEN 1 END) AS n_kept,
  CAST(sum(CASE WHEN w1 >= 2 AND h1 >= 2 THEN w1 * h1 END) AS BIGINT) AS area, CAST(sum(CASE WHEN w1 >= 2 AND h1 >= 2 THEN x0 + y0 END) AS BIGINT) AS corner
FROM (SELECT *, least(40, x + w) - x0 AS w1, least(22, y + h) - y0 AS h1 FROM (SELECT *, greatest(0, x) AS x0, greatest(0, y) AS y0 FROM fx_detections))
GROUP BY 1""", ("fx_detections",))
def clamped_boxes(spark, d):
    det = fx.detections(spark, d)
    box = X.clamp_box(F.lit(40), F.lit(22), F.col("x"), F.col("y"), F.col("w"), F.col("h"))
    return det.withColumn("box", box).groupBy("ordinal").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("box").alias("n_kept"),
        F.sum(F.col("box.w") * F.col("box.h")).cast("bigint").alias("area"),
        F.sum(F.col("box.x") + F.col("box.y")).cast("bigint").alias("corner"),
    )


@query("P8_source_family", r"""
SELECT CASE WHEN fam = stem OR fam = '' THEN dir || '/unnumbered' ELSE dir || '/' || fam END AS family, count(*) AS n
FROM (SELECT dir, stem, regexp_replace(stem, '(?:[ _-]\(?\d+\)?|\(\d+\))$', '') AS fam FROM (
  SELECT 'n' || c_nationkey AS dir, regexp_replace(f, '^(.+)\.[^.]+$', '\1') AS stem FROM (
    SELECT c_nationkey, CASE c_custkey % 5 WHEN 0 THEN c_mktsegment || '_' || c_custkey || '.png' WHEN 1 THEN c_mktsegment || ' (' || c_custkey || ').png'
      WHEN 2 THEN c_mktsegment || '(' || c_custkey || ').jpeg' WHEN 3 THEN c_custkey || '.png' ELSE c_mktsegment || '-' || c_custkey || '.a.png' END AS f FROM customer)))
GROUP BY 1""")
def source_family(spark, d):
    c = fx.table(spark, d, "customer")
    k, seg = F.col("c_custkey").cast("string"), F.col("c_mktsegment")
    i = F.col("c_custkey") % 5
    name = (
        F.when(i == 0, F.concat(seg, F.lit("_"), k, F.lit(".png"))).when(i == 1, F.concat(seg, F.lit(" ("), k, F.lit(").png")))
        .when(i == 2, F.concat(seg, F.lit("("), k, F.lit(").jpeg"))).when(i == 3, F.concat(k, F.lit(".png")))
        .otherwise(F.concat(seg, F.lit("-"), k, F.lit(".a.png")))
    )
    fam = X.source_family(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")), name)
    return c.groupBy(fam.alias("family")).agg(F.count(F.lit(1)).alias("n"))


@query("P9_stratum_key", """
SELECT CASE WHEN c_mktsegment <> 'MACHINERY' AND c_nationkey % 5 <> 0 THEN c_mktsegment || '|' || c_nationkey END AS stratum, count(*) AS n
FROM customer GROUP BY 1""")
def stratum_key(spark, d):
    c = fx.table(spark, d, "customer")
    a = F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_mktsegment"))
    b = F.when(F.col("c_nationkey") % 5 != 0, F.col("c_nationkey").cast("string"))
    return c.groupBy(X.stratum_key(a, b).alias("stratum")).agg(F.count(F.lit(1)).alias("n"))


@query("P10_verdict_name", """
SELECT verdict, coalesce(CASE verdict WHEN 'real' THEN 'AUTHENTIC' WHEN 'fake' THEN 'MANIPULATED' END, 'UNKNOWN') AS name, count(*) AS n
FROM (SELECT CASE o_orderkey % 6 WHEN 0 THEN 'real' WHEN 1 THEN 'fake' WHEN 2 THEN 'insufficient_evidence' WHEN 3 THEN 'out_of_distribution'
  WHEN 4 THEN 'other' END AS verdict FROM orders) GROUP BY 1, 2""")
def verdict_name(spark, d):
    i = F.col("o_orderkey") % 6
    v = (F.when(i == 0, "real").when(i == 1, "fake").when(i == 2, "insufficient_evidence")
         .when(i == 3, "out_of_distribution").when(i == 4, "other"))
    o = fx.table(spark, d, "orders").groupBy(v.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))
    return o.select("verdict", X.verdict_name("verdict").alias("name"), "n")


@query("P11_model_verdict", """
SELECT l_returnflag, CASE WHEN l_linestatus = 'O' THEN NULL WHEN l_discount > 0.05 THEN 'MANIPULATED' WHEN l_discount < 0.05 THEN 'AUTHENTIC' END AS verdict, count(*) AS n
FROM lineitem GROUP BY 1, 2""")
def model_verdict(spark, d):
    li = fx.table(spark, d, "lineitem")
    llr = F.round(F.col("l_discount") * 100).cast("int") - 5
    return li.groupBy("l_returnflag", X.model_verdict(F.col("l_linestatus") == "O", llr).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query("P12_linear_score", """
SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(p), 6) AS mean_p, round(min(p), 6) AS min_p, round(max(p), 6) AS max_p FROM (
  SELECT *, 1 / (1 + exp(-(0.3 + (l_quantity - 25) / 14 * 0.8 + (l_extendedprice - 52000) / 30000 * -0.5 + (l_discount - 0.05) * 2.0))) AS p FROM lineitem)
GROUP BY 1, 2""")
def linear_score(spark, d):
    li = fx.table(spark, d, "lineitem").withColumn("f", F.array("l_quantity", "l_extendedprice", "l_discount"))
    p = X.linear_probability(F.col("f"), [25, 52000, 0.05], [14, 30000, 0.0], [0.8, -0.5, 2.0], 0.3)
    return li.withColumn("p", p).groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("p"), 6).alias("mean_p"),
        F.round(F.min("p"), 6).alias("min_p"), F.round(F.max("p"), 6).alias("max_p"))


@query("P13_feature_blocks", """
SELECT vec_id, len(embedding[1:24]) AS n_a, round(list_sum(CAST(embedding[1:24] AS DOUBLE[])), 6) AS sum_a, len(embedding[25:64]) AS n_b,
  round(list_sum(CAST(embedding[25:64] AS DOUBLE[])), 6) AS sum_b FROM embeddings""")
def feature_blocks(spark, d):
    a, b = X.feature_blocks(F.col("embedding").cast("array<double>"), 24, 64)
    total = lambda v: F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x), 6)
    return fx.table(spark, d, "embeddings").select(
        "vec_id", F.size(a).cast("bigint").alias("n_a"), total(a).alias("sum_a"), F.size(b).cast("bigint").alias("n_b"), total(b).alias("sum_b"))


@query("P14_l2_normalise", """
SELECT vec_id, round(v[1] / greatest(sqrt(list_sum(list_transform(v, lambda x: x * x))), 1e-12), 6) AS first,
  round(v[64] / greatest(sqrt(list_sum(list_transform(v, lambda x: x * x))), 1e-12), 6) AS last
FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)""")
def l2_normalise(spark, d):
    e = fx.table(spark, d, "embeddings").select("vec_id", X.l2_normalise("embedding").alias("v"))
    return e.select("vec_id", F.round(F.get("v", F.lit(0)), 6).alias("first"), F.round(F.element_at("v", -1), 6).alias("last"))


@query("P15_face_subset", """
SELECT label, count(*) AS n, round(avg(blur_var), 6) AS mean_blur FROM fx_banded WHERE band <> 'reject' GROUP BY 1""", ("fx_banded",))
def face_subset(spark, d):
    r = fx.banded(spark, d).withColumn("has_face", F.col("band") != "reject")
    return O.face_subset(r).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("blur_var"), 6).alias("mean_blur"))


@query("P16_class_column", "SELECT coalesce(generator, 'real') AS class, count(*) AS n FROM fx_records GROUP BY 1", ("fx_records",))
def class_column(spark, d):
    return fx.records(spark, d).groupBy(X.class_of("generator").alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("P18_audit_violations", """
WITH a AS (SELECT o_orderkey AS row_id, CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE 's' || o_orderkey END AS sid,
  CASE WHEN o_orderkey % 7 = 0 THEN upper(sha256(CAST(o_orderkey AS VARCHAR))) ELSE sha256(CAST(o_orderkey AS VARCHAR)) END AS sha,
  CASE o_orderkey % 5 WHEN 0 THEN 'yesterday' WHEN 1 THEN '2024-13-01T00:00:00' WHEN 2 THEN '2024-02-03T04:05:06+00:00' WHEN 3 THEN '2024-02-03' END AS created_at,
  CASE WHEN o_orderkey % 13 = 0 THEN CAST('nan' AS DOUBLE) ELSE 1.5 END AS llr, CASE WHEN o_orderkey % 17 = 0 THEN CAST('inf' AS DOUBLE) ELSE 0.5 END AS post FROM orders)
SELECT row_id, 'sample_id' AS field, 'empty' AS problem FROM a WHERE sid = ''
UNION ALL SELECT row_id, 'input_sha256', 'not_a_sha256' FROM a WHERE NOT regexp_full_match(sha, '[0-9a-f]{64}')
UNION ALL SELECT row_id, 'created_at', 'not_iso_8601' FROM a WHERE created_at IS NOT NULL AND try_cast(created_at AS TIMESTAMPTZ) IS NULL
UNION ALL SELECT row_id, 'llr_total', 'not_finite' FROM a WHERE NOT isfinite(llr)
UNION ALL SELECT row_id, 'posterior', 'not_finite' FROM a WHERE NOT isfinite(post)""")
def audit_field_violations(spark, d):
    k = F.col("o_orderkey")
    sha = F.sha2(k.cast("string"), 256)
    stamps = F.when(k % 5 == 0, "yesterday").when(k % 5 == 1, "2024-13-01T00:00:00").when(k % 5 == 2, "2024-02-03T04:05:06+00:00").when(k % 5 == 3, "2024-02-03")
    rows = fx.table(spark, d, "orders").select(
        k.alias("row_id"),
        F.when(k % 11 == 0, "").otherwise(F.concat(F.lit("s"), k.cast("string"))).alias("sample_id"),
        F.when(k % 7 == 0, F.upper(sha)).otherwise(sha).alias("input_sha256"),
        stamps.alias("created_at"),
        F.when(k % 13 == 0, F.lit(float("nan"))).otherwise(1.5).alias("llr_total"),
        F.when(k % 17 == 0, F.lit(float("inf"))).otherwise(0.5).alias("posterior"),
    )
    return audit_violations(rows)
