"""Guard queries: each returns what a refusal would name."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer import fixtures as fx
from assayer.operators import guards as G
from assayer.operators.curve import auc
from assayer.plans.catalog.metrics import auc_sql
from assayer.plans.catalog.registry import query


@query("G3_video_level", "SELECT l_orderkey AS source_id, min(l_partkey) AS first_id, max(l_partkey) AS last_id FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_partkey) > 1")
def video_level(spark, d):
    li = fx.table(spark, d, "lineitem").select(F.col("l_partkey").alias("sample_id"), F.col("l_orderkey").alias("source_id"))
    return G.video_level(li)


@query("G10_waived_findings", "SELECT l_orderkey AS source_id, min(l_partkey) AS first_id, max(l_partkey) AS last_id FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_partkey) > 1")
def waived_findings(spark, d):
    """A waived guard raises nothing and still hands over every finding."""
    return G.require(video_level(spark, d), "a source appears in several samples", waived=True)


@query("G3_video_level_status", """
SELECT CASE WHEN count(*) FILTER (source_id <> sample_id) = 0 THEN 'vacuous' WHEN count(DISTINCT sample_id) > count(DISTINCT source_id) THEN 'violation' ELSE 'ok' END AS status,
  (SELECT count(*) FROM (SELECT source_id FROM fx_records GROUP BY 1 HAVING count(DISTINCT sample_id) > 1)) AS n_violations FROM fx_records""", ("fx_records",))
def video_level_status(spark, d):
    return G.video_level_status(fx.records(spark, d))


@query("G4_missing_compression", "SELECT c AS compression FROM (VALUES ('c0'), ('c23'), ('c40'), ('raw')) v(c) WHERE c NOT IN (SELECT compression FROM fx_records)", ("fx_records",))
def missing_compression(spark, d):
    return G.missing_compression(fx.records(spark, d), ("c0", "c23", "c40", "raw"))


@query("G5_mixed_preprocessing", """
SELECT 'face_detector' AS key, min(o_orderpriority) AS low, max(o_orderpriority) AS high FROM orders HAVING count(DISTINCT o_orderpriority) > 1
UNION ALL SELECT 'align', min(CASE WHEN o_orderkey % 9 <> 0 THEN 'five_point' END), max(CASE WHEN o_orderkey % 9 <> 0 THEN 'five_point' END) FROM orders""")
def mixed_preprocessing(spark, d):
    o = fx.table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("face_detector"), F.when(F.col("o_orderkey") % 9 != 0, "five_point").alias("align"), F.lit("x").alias("codec"))
    return G.mixed_preprocessing(o, ("face_detector", "align", "codec"))


@query("G7_demographic_parity", """
SELECT stratum, round(avg(CASE WHEN label = 0 THEN CASE WHEN score > 500 THEN 1.0 ELSE 0.0 END END), 6) AS fpr, round(avg(CASE WHEN label = 1 THEN CASE WHEN score > 500 THEN 1.0 ELSE 0.0 END END), 6) AS tpr FROM fx_docs GROUP BY 1""", ("fx_docs",))
def demographic_parity(spark, d):
    r = G.demographic_parity(fx.docs(spark, d), 500.0)
    return r.select("stratum", F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr"))


@query("G7_parity_ratio", """
WITH r AS (SELECT stratum, avg(CASE WHEN label = 0 THEN CASE WHEN score > 500 THEN 1.0 ELSE 0.0 END END) AS fpr FROM fx_docs GROUP BY 1)
SELECT round(CASE WHEN count(fpr) < 2 THEN 1 WHEN min(fpr) = 0 THEN CASE WHEN max(fpr) > 0 THEN CAST('inf' AS DOUBLE) ELSE 1 END ELSE max(fpr) / min(fpr) END, 6) AS fpr_ratio,
  CASE WHEN count(fpr) < 2 THEN false WHEN min(fpr) = 0 THEN max(fpr) > 0 ELSE max(fpr) / min(fpr) > 2.0 END AS violation FROM r""", ("fx_docs",))
def parity_ratio(spark, d):
    return G.parity_ratio(G.demographic_parity(fx.docs(spark, d), 500.0)).withColumn("fpr_ratio", F.round("fpr_ratio", 6))


@query("G8_parity_report", """
WITH g AS (SELECT stratum, count(*) FILTER (label = 0) AS n FROM fx_records GROUP BY 1), k AS (SELECT s.* FROM fx_joined s JOIN g ON g.stratum = s.stratum WHERE g.n >= 150 AND s.score IS NOT NULL),
t AS (SELECT detector, quantile_cont(score, 0.99) AS thr FROM k WHERE label = 0 GROUP BY 1),
r AS (SELECT k.detector, k.stratum, avg(CASE WHEN label = 0 THEN CASE WHEN score > thr THEN 1.0 ELSE 0.0 END END) AS fpr FROM k JOIN t ON t.detector = k.detector GROUP BY 1, 2),
x AS (SELECT detector, CASE WHEN count(fpr) < 2 THEN 1 WHEN min(fpr) = 0 THEN CASE WHEN max(fpr) > 0 THEN CAST('inf' AS DOUBLE) ELSE 1 END ELSE max(fpr) / min(fpr) END AS ratio FROM r GROUP BY 1),
s AS (SELECT (SELECT count(*) FROM g WHERE n >= 150) AS ok, (SELECT count(*) FROM g WHERE n < 150) AS n_excluded)
SELECT d.detector, CASE WHEN ok < 2 THEN 'too_few_per_stratum' ELSE 'ok' END AS status, round(thr, 6) AS threshold, round(ratio, 6) AS fpr_ratio, ratio > 2.0 AS violation, n_excluded
FROM (SELECT DISTINCT detector FROM fx_scores) d CROSS JOIN s LEFT JOIN t ON t.detector = d.detector AND ok >= 2 LEFT JOIN x ON x.detector = d.detector AND ok >= 2""", ("fx_joined",))
def parity_report(spark, d):
    r = G.parity_report(fx.scored(spark, d), fx.records(spark, d))
    return r.withColumn("threshold", F.round("threshold", 6)).withColumn("fpr_ratio", F.round("fpr_ratio", 6))


@query("G9_worst_identity", """
WITH r AS (SELECT 'n' || c_nationkey AS name, max(c_acctbal) / 10000 AS sim, avg(CASE WHEN c_acctbal > 9000 THEN 1.0 ELSE 0.0 END) AS rate FROM customer GROUP BY 1)
SELECT CASE WHEN max(rate) > 0.25 THEN 'violation' ELSE 'ok' END AS status, arg_max(name, (rate, sim, name)) AS worst, round(max(rate), 6) AS violation_rate, round(arg_max(sim, (rate, sim, name)), 6) AS max_similarity FROM r""")
def worst_identity(spark, d):
    c = fx.table(spark, d, "customer").groupBy(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("name")).agg(
        (F.max("c_acctbal") / 10000).alias("max_similarity"), F.avg(F.when(F.col("c_acctbal") > 9000, 1.0).otherwise(0.0)).alias("violation_rate"))
    r = c.withColumn("scope", F.when(F.col("name") == "n0", "corpus").otherwise("fold")).withColumn("tolerated_rate", F.lit(0.25))
    w = G.worst_identity(r)
    return w.select("status", "worst", F.round("violation_rate", 6).alias("violation_rate"), F.round("max_similarity", 6).alias("max_similarity"))


@query("G11_domain_grouping", """
SELECT k, n_domains, n_records, CASE WHEN n_domains < 2 THEN 'zero_width_interval' WHEN n_domains = n_records THEN 'row_level_interval' END AS refusal
FROM (SELECT k, count(DISTINCT d) AS n_domains, count(*) AS n_records FROM (SELECT o_orderpriority AS k, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN o_orderkey ELSE o_custkey % 9 END AS d FROM orders) GROUP BY 1)""")
def domain_grouping(spark, d):
    p = F.col("o_orderpriority")
    dom = F.when(p == "1-URGENT", 0).when(p == "2-HIGH", F.col("o_orderkey")).otherwise(F.col("o_custkey") % 9)
    return G.domain_grouping(fx.table(spark, d, "orders").select(p.alias("k"), dom.alias("domain")), ["k"])


@query("G12_duplicate_ids", "SELECT l_orderkey AS sample_id, l_linenumber AS part, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_ids(spark, d):
    li = fx.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("sample_id"), F.col("l_linenumber").alias("part"))
    return G.duplicate_ids(li, ("sample_id", "part"))


@query("G13_oracle_band", f"""
SELECT detector, round(auc, 6) AS auc, CASE WHEN auc IS NULL THEN 'no_auc' WHEN auc < 0.4 THEN 'below_band' WHEN auc > 0.75 THEN 'above_band' ELSE 'inside_band' END AS verdict,
  auc IS NOT NULL AND auc BETWEEN 0.4 AND 0.75 AS passed FROM {auc_sql('fx_joined', 'detector')}""", ("fx_joined",))
def oracle_band(spark, d):
    return G.oracle_band(fx.scored(spark, d)).withColumn("auc", F.round("auc", 6))


@query("G14_control_alarm", "WITH x AS (SELECT lang AS control, CASE WHEN d.doc_id % 3 = 0 THEN 1 ELSE 0 END AS label, CASE WHEN lang = 'fr' THEN n_chars ELSE d.doc_id % 3 * -1 END AS score FROM documents d) "
       f"SELECT control, round(auc, 6) AS auc FROM {auc_sql('x', 'control')} WHERE auc >= 0.9 AND control <> 'de'")
def control_alarm(spark, d):
    k = F.col("doc_id") % 3
    x = fx.table(spark, d, "documents").select(
        F.col("lang").alias("control"), F.when(k == 0, 1).otherwise(0).alias("label"), F.when(F.col("lang") == "fr", F.col("n_chars")).otherwise(-k).alias("score"))
    c = auc(x, ["control"]).withColumn("refused", F.when(F.col("control") == "de", True))
    return G.control_alarm(c).withColumn("auc", F.round("auc", 6))


@query("G15_evidence_gate", """
WITH c AS (SELECT 's' || s_suppkey AS detector, CASE WHEN s_suppkey % 7 <> 0 THEN s_acctbal / 10000 END AS auc, 'n' || s_nationkey AS corpus,
  CASE s_suppkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'n' || s_nationkey ELSE 'n' || (s_nationkey + 3) END AS trained_on, CASE WHEN s_suppkey % 4 = 0 THEN 0.8 END AS auc_floor FROM supplier),
a AS (SELECT 'n' || n_nationkey AS id FROM nation),
w AS (SELECT detector, CASE WHEN auc IS NULL THEN 'never_measured' WHEN auc < greatest(0.3, coalesce(auc_floor, 0.3)) THEN 'below_floor' WHEN trained_on IS NULL THEN 'training_undeclared'
  WHEN trained_on = corpus THEN 'trained_on_corpus' WHEN corpus NOT IN (SELECT id FROM a) OR trained_on NOT IN (SELECT id FROM a) THEN 'unregistered_corpus' END AS reason FROM c)
SELECT detector, reason IS NULL AS gated, reason FROM w""")
def evidence_gate(spark, d):
    k = F.col("s_suppkey")
    nation = lambda x: F.concat(F.lit("n"), (F.col("s_nationkey") + x).cast("string"))
    card = fx.table(spark, d, "supplier").select(
        F.concat(F.lit("s"), k.cast("string")).alias("detector"), F.when(k % 7 != 0, F.col("s_acctbal") / 10000).alias("auc"), nation(0).alias("corpus"),
        F.when(k % 5 == 0, None).when(k % 5 == 1, nation(0)).otherwise(nation(3)).alias("trained_on"), F.when(k % 4 == 0, 0.8).alias("auc_floor"))
    assets = fx.table(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("asset_id"))
    return G.evidence_gate(card, assets, 0.3)
