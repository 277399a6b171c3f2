"""Score-to-verdict queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer import fixtures as fx
from assayer import schema as K
from assayer.functions.scalar import exact_mean
from assayer.operators import decide as C
from assayer.operators.observations import worst_band
from assayer.plans.catalog.registry import query

CURVE_ROWS = [
    ("d_value", "low", 4.0, -2.0, 0.3), ("d_value", "medium", 5.0, -1.5, 0.45), ("d_value", "high", 60.0, -1.0, 0.5),
    ("d_exposure", "medium", 3.0, -1.5, 0.4), ("d_exposure", "high", 8.0, -3.0, 1.0),
    ("d_iod", "reject", 2.0, -1.0, 0.4), ("d_iod", "medium", -9.0, 2.0, 0.35), ("d_iod", "high", -5.0, 1.0, 0.5),
]
CREATED_AT = "2024-01-01T00:00:00+00:00"

_CURVES = ", ".join(f"('{d}', '{b}', {c!r}, {i!r}, {p!r})" for d, b, c, i, p in CURVE_ROWS)

_EVIDENCE = f"""
curves(detector, band, coef, intercept, prior) AS (VALUES {_CURVES}),
broken AS (SELECT * REPLACE (CASE WHEN score IS NOT NULL AND hash_rank % 11 < 3 THEN NULL ELSE score END AS score), score IS NOT NULL AND hash_rank % 11 < 3 AS bad
  FROM (SELECT *, ('0x' || substr(md5(sample_id || detector), 1, 6))::BIGINT AS hash_rank FROM fx_joined)),
ev AS (SELECT s.sample_id, s.detector, s.band, s.score AS raw_score, s.score IS NULL OR c.coef IS NULL AS abstained,
  CASE WHEN bad THEN 'not_measured' WHEN s.score IS NULL THEN 'below_quality_floor' WHEN c.coef IS NULL THEN 'uncalibrated_for_band' ELSE 'ok' END AS reason,
  CASE WHEN s.score IS NULL OR c.coef IS NULL THEN 0.0 ELSE greatest(-6.0, least(6.0,
    CAST(c.coef AS DOUBLE) * s.score + CAST(c.intercept AS DOUBLE) - CASE WHEN c.prior > 0 AND c.prior < 1 THEN ln(CAST(c.prior AS DOUBLE) / (1 - CAST(c.prior AS DOUBLE))) ELSE 0 END)) END AS llr
  FROM broken s LEFT JOIN curves c ON c.detector = s.detector AND c.band = s.band)"""

_DECISION = _EVIDENCE + """,
f AS (SELECT sample_id, count(CASE WHEN NOT abstained THEN 1 END) AS n_contributing,
  greatest(-20.0, least(20.0, coalesce(sum(CASE WHEN NOT abstained THEN llr END), 0))) AS llr_total,
  least(coalesce(sum(CASE WHEN NOT abstained AND llr > 0 THEN llr END), 0), coalesce(sum(CASE WHEN NOT abstained AND llr < 0 THEN -llr END), 0)) AS disagreement
  FROM ev GROUP BY 1),
dec AS (SELECT *, 1 / (1 + exp(-llr_total)) AS posterior, CASE WHEN n_contributing = 0 THEN 'insufficient_evidence' WHEN disagreement >= 3.0 THEN 'out_of_distribution'
  WHEN llr_total >= 1.0 THEN 'fake' WHEN llr_total <= -1.0 THEN 'real' ELSE 'insufficient_evidence' END AS verdict FROM f)"""

_NAME = "CASE verdict WHEN 'real' THEN 'AUTHENTIC' WHEN 'fake' THEN 'MANIPULATED' ELSE 'UNKNOWN' END"


def curves(spark):
    rows = [(d, b, c, i, p, K.MAX_ABS_LLR, K.CURVE_FORMAT_VERSION) for d, b, c, i, p in CURVE_ROWS]
    return spark.createDataFrame(rows, K.CURVES)


def score_rows(spark, d):
    """Scores of which some are NaN or infinite: those must abstain."""
    draw = F.conv(F.substring(F.md5(F.concat("sample_id", "detector")), 1, 6), 16, 10).cast("bigint") % 11
    broken = F.when(draw == 0, float("nan")).when(draw == 1, float("inf")).when(draw == 2, float("-inf")).otherwise(F.col("score"))
    return fx.scored(spark, d).select(
        "sample_id", "detector", F.lit("1.0").alias("version"), F.when(F.col("score").isNotNull(), broken).alias("score"), F.col("score").isNull().alias("abstained"),
        F.when(F.col("score").isNull(), "below_quality_floor").otherwise("ok").alias("reason"), "band")


def evidence(spark, d):
    return C.to_evidence(score_rows(spark, d), curves(spark))


def decisions(spark, d, keep_evidence=True):
    return C.fuse(evidence(spark, d), keep_evidence=keep_evidence)


def r6(c):
    return F.round(c, 6) + F.lit(0.0)


@query("C1_sample_scores", "SELECT session_id, round(avg(score), 6) AS score, round(max(score), 6) AS max_score, count(*) AS n_frames FROM fx_frames GROUP BY 1", ("fx_frames",))
def sample_scores(spark, d):
    s = C.sample_scores(fx.frames(spark, d), ["session_id"])
    return s.select("session_id", F.round("score", 6).alias("score"), F.round("max_score", 6).alias("max_score"), "n_frames")


@query("C2_score_to_llr", f"WITH {_EVIDENCE} SELECT sample_id, detector, round(llr, 6) + 0.0 AS llr, round(raw_score, 6) AS raw_score, abstained, reason FROM ev", ("fx_joined",))
def score_to_llr(spark, d):
    return evidence(spark, d).select("sample_id", "detector", r6("llr").alias("llr"), F.round("raw_score", 6).alias("raw_score"), "abstained", "reason")


@query("C3_fusion", f"WITH {_DECISION} SELECT sample_id, n_contributing, round(llr_total, 6) + 0.0 AS llr_total, round(posterior, 6) AS posterior, round(disagreement, 6) AS disagreement FROM dec", ("fx_joined",))
def fusion(spark, d):
    return decisions(spark, d, False).select("sample_id", "n_contributing", r6("llr_total").alias("llr_total"), F.round("posterior", 6).alias("posterior"), F.round("disagreement", 6).alias("disagreement"))


@query("C3_fusion_discounted", """
WITH g AS (SELECT session_id AS sample_id, count(*) AS n, sum(l) AS s, count(*) / 2.0 AS ess, sum(CASE WHEN l > 0 THEN l ELSE 0 END) AS p, sum(CASE WHEN l < 0 THEN -l ELSE 0 END) AS q
  FROM (SELECT session_id, 4 * score - 3 AS l FROM fx_frames) GROUP BY 1),
t AS (SELECT *, greatest(-20.0, least(20.0, s * CASE WHEN n > 1 THEN greatest(1.0, CASE WHEN n % 2 = 0 THEN least(ess, n) ELSE 1 END) / n ELSE 1 END)) AS total FROM g)
SELECT sample_id, round(total, 6) AS llr_total, round(least(p, q), 6) AS disagreement,
  CASE WHEN least(p, q) >= 3 THEN 'out_of_distribution' WHEN total >= 1 THEN 'fake' WHEN total <= -1 THEN 'real' ELSE 'insufficient_evidence' END AS verdict FROM t""", ("fx_frames",))
def fusion_discounted(spark, d):
    fr = fx.frames(spark, d)
    ev = fr.select(
        F.col("session_id").alias("sample_id"), F.concat(F.lit("frame"), F.col("t").cast("string")).alias("detector"), F.lit("1.0").alias("detector_version"),
        (4 * F.col("score") - 3).alias("llr"), F.col("score").alias("raw_score"), F.lit(False).alias("abstained"), F.lit("ok").alias("reason"))
    per = fr.groupBy(F.col("session_id").alias("sample_id")).agg(F.count(F.lit(1)).alias("n_frames")).withColumn(
        "ess", F.when(F.col("n_frames") % 2 == 0, F.col("n_frames") / 2.0))
    out = C.fuse(ev, frames=per)
    return out.select("sample_id", F.round("llr_total", 6).alias("llr_total"), F.round("disagreement", 6).alias("disagreement"), "verdict")


@query("C4_verdicts", f"WITH {_DECISION} SELECT verdict, count(*) AS n FROM dec GROUP BY 1", ("fx_joined",))
def verdicts(spark, d):
    return decisions(spark, d, False).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


@query("C5_reasons", f"WITH {_EVIDENCE} SELECT sample_id, '{{' || string_agg('\"' || detector || '\":\"' || reason || '\"', ',' ORDER BY detector) || '}}' AS reasons FROM ev GROUP BY 1", ("fx_joined",))
def reasons(spark, d):
    return C.reasons_map(decisions(spark, d)).select("sample_id", F.to_json("reasons").alias("reasons"))


@query("C6_gated_evidence", f"WITH {_EVIDENCE} SELECT detector, CASE WHEN detector <> 'd_value' AND raw_score IS NOT NULL THEN 'uncalibrated_for_band' ELSE reason END AS reason, count(*) AS n, count(raw_score) AS n_scored FROM ev GROUP BY 1, 2", ("fx_joined",))
def gated_evidence(spark, d):
    gated = curves(spark).select("detector").distinct().where(F.col("detector") == "d_value")
    ev = C.to_evidence(score_rows(spark, d), C.gated_curves(curves(spark), gated))
    return ev.groupBy("detector", "reason").agg(F.count(F.lit(1)).alias("n"), F.count("raw_score").alias("n_scored"))


_J = "CAST(CAST(round({0}, 6) + 0.0 AS DECIMAL(20,6)) AS VARCHAR)"
_RECORD = _DECISION + f""",
e2 AS (SELECT sample_id, '[' || string_agg('{{"abstained":' || CASE WHEN abstained THEN 'true' ELSE 'false' END || ',"detector":"' || detector || '","llr":' || {_J.format('llr')}
   || ',"raw_score":' || coalesce({_J.format('raw_score')}, 'null') || ',"reason":"' || reason || '","version":"1.0"}}', ',' ORDER BY detector) || ']' AS evs,
   '{{' || string_agg('"' || detector || '":"1.0"', ',' ORDER BY detector) || '}}' AS vers FROM ev GROUP BY 1),
rec AS (SELECT d.sample_id, '{{"created_at":"{CREATED_AT}","evidence":' || evs || ',"input_sha256":"' || sha256(d.sample_id) || '","llr_total":' || {_J.format('llr_total')}
  || ',"model_versions":' || vers || ',"ood_score":' || {_J.format('disagreement')} || ',"policy_version":"{K.POLICY_VERSION}","posterior":' || {_J.format('posterior')}
  || ',"quality_band":"' || b.band || '","sample_id":"' || d.sample_id || '","schema_version":"2","stage_reasons":{{"quality":"' || CASE WHEN b.band = 'reject' THEN 'degenerate' ELSE 'ok' END
  || '"}},"threshold":1.000000,"verdict":"' || verdict || '"}}' AS record_json FROM dec d JOIN e2 ON e2.sample_id = d.sample_id JOIN fx_banded b ON b.sample_id = d.sample_id)"""


def records(spark, d):
    b = fx.banded(spark, d)
    ctx = b.select(
        "sample_id", F.sha2("sample_id", 256).alias("input_sha256"), F.col("band").alias("quality_band"),
        F.create_map(F.lit("quality"), F.when(F.col("band") == "reject", "degenerate").otherwise("ok")).alias("stage_reasons"))
    return C.audit_records(decisions(spark, d), ctx, C.Policy(), CREATED_AT)


@query("C7_audit_record", f"WITH {_RECORD} SELECT sample_id, record_json FROM rec", ("fx_joined",))
def audit_record(spark, d):
    return records(spark, d).select("sample_id", "record_json")


@query("C8_record_digest", f"WITH {_RECORD} SELECT sample_id, sha256(record_json) AS record_digest FROM rec", ("fx_joined",))
def record_digest(spark, d):
    return records(spark, d).select("sample_id", "record_digest")


@query("C9_tampered", f"WITH {_RECORD} SELECT sample_id FROM rec WHERE verdict_changed(record_json, sample_id)".replace(
    "verdict_changed(record_json, sample_id)", "CAST(sample_id AS BIGINT) % 10 = 0 AND record_json LIKE '%\"verdict\":\"fake\"%'"), ("fx_joined",))
def tampered(spark, d):
    r = records(spark, d)
    edited = F.regexp_replace("record_json", '"verdict":"fake"', '"verdict":"real"')
    return C.tampered(r.withColumn("record_json", F.when(F.col("sample_id").cast("bigint") % 10 == 0, edited).otherwise(F.col("record_json")))).select("sample_id")


_MODELS = _DECISION + """,
m AS (SELECT sample_id, string_agg(detector || '=' || CASE WHEN abstained OR llr = 0 THEN '-' WHEN llr > 0 THEN 'MANIPULATED' ELSE 'AUTHENTIC' END, ';' ORDER BY detector) AS models FROM ev GROUP BY 1),
dis AS (SELECT d.sample_id, string_agg(detector, ',' ORDER BY detector) AS who FROM ev JOIN dec d ON d.sample_id = ev.sample_id
  WHERE NOT abstained AND llr <> 0 AND (llr_total = 0 OR sign(llr) <> sign(llr_total)) GROUP BY 1)"""


@query("C10_model_list", f"WITH {_MODELS} SELECT d.sample_id, {_NAME} AS verdict, round(posterior, 6) AS score, models FROM dec d JOIN m ON m.sample_id = d.sample_id", ("fx_joined",))
def model_list(spark, d):
    text = F.concat_ws(";", F.transform("models", lambda m: F.concat_ws("=", m["name"], F.coalesce(m["verdict"], F.lit("-")))))
    return C.model_list(decisions(spark, d)).select("sample_id", "verdict", F.round("score", 6).alias("score"), text.alias("models"))


@query("C11_dissenters", f"WITH {_MODELS} SELECT d.sample_id, coalesce(who, '') AS dissenters FROM dec d LEFT JOIN dis ON dis.sample_id = d.sample_id", ("fx_joined",))
def dissenters(spark, d):
    return C.model_list(decisions(spark, d)).select("sample_id", F.concat_ws(",", "dissenting_models").alias("dissenters"))


@query("C12_simple_answer", f"""
WITH {_DECISION}, q AS (SELECT sample_id, count(*) AS n, string_agg(CASE WHEN abstained THEN detector || ':' || reason END, ';' ORDER BY detector) AS why FROM ev GROUP BY 1)
SELECT d.sample_id, CASE verdict WHEN 'fake' THEN true WHEN 'real' THEN false END AS is_deepfake,
  round(CASE verdict WHEN 'fake' THEN posterior WHEN 'real' THEN 1 - posterior END, 6) AS confidence, {_NAME} AS verdict,
  CASE WHEN verdict IN ('fake', 'real') THEN 'decided' ELSE 'insufficient_evidence' END AS reason, n AS detectors_consulted, n_contributing AS detectors_that_decided,
  CASE WHEN verdict IN ('fake', 'real') THEN '' ELSE coalesce(why, '') END AS why_no_answer
FROM dec d JOIN q ON q.sample_id = d.sample_id""", ("fx_joined",))
def simple_answer(spark, d):
    why = F.concat_ws(";", F.transform("why_no_answer", lambda x: F.concat_ws(":", x["name"], x["reason"])))
    s = C.simple_answer(decisions(spark, d))
    return s.select(
        "sample_id", "is_deepfake", F.round("confidence", 6).alias("confidence"), "verdict", "reason",
        F.col("detectors_consulted").cast("bigint").alias("detectors_consulted"),
        F.col("detectors_that_decided").cast("bigint").alias("detectors_that_decided"), why.alias("why_no_answer"))


@query("C13_content_key", "SELECT page_id, sha256(html) AS content_sha256 FROM pages")
def content_key(spark, d):
    return C.content_key(fx.table(spark, d, "pages"), "html", "page_id")


def _brittle(items):
    if (items["n_chars"] % 7 == 0).any():
        raise RuntimeError("decoder lost the stream")
    return (items["n_chars"] / 1000.0).where(items["n_chars"] % 5 != 0)


@query("C14_isolated_failures", """
SELECT reason, abstained, count(*) AS n, round(sum(CASE WHEN NOT abstained THEN n_chars / 1000.0 END), 6) AS total
FROM (SELECT n_chars, n_chars % 7 = 0 OR n_chars % 5 = 0 AS abstained, CASE WHEN n_chars % 7 = 0 THEN 'detector_error' WHEN n_chars % 5 = 0 THEN 'not_measured' ELSE 'ok' END AS reason FROM documents)
GROUP BY 1, 2""")
def isolated_failures(spark, d):
    items = fx.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("sample_id"), "n_chars")
    s = C.isolated_scorer(items, "length", "1.0", _brittle)
    return s.groupBy("reason", "abstained").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 6).alias("total"))


@query("C15_demoted", """
SELECT detector, round(tpr, 6) AS adversarial_tpr FROM (SELECT l_returnflag || l_linenumber AS detector, CASE WHEN l_linenumber <> 3 THEN avg(CASE WHEN l_discount > 0.095 THEN 1.0 ELSE 0.0 END) END AS tpr
  FROM lineitem GROUP BY l_returnflag, l_linenumber) WHERE tpr < 0.1""")
def demoted(spark, d):
    li = fx.table(spark, d, "lineitem").groupBy("l_returnflag", "l_linenumber").agg(F.avg(F.when(F.col("l_discount") > 0.095, 1.0).otherwise(0.0)).alias("t"))
    t = li.select(F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("detector"), F.when(F.col("l_linenumber") != 3, F.col("t")).alias("adversarial_tpr"))
    return C.demoted(t).select("detector", F.round("adversarial_tpr", 6).alias("adversarial_tpr"))


@query("C16_preregistered_verdict", """
WITH a AS (SELECT l_suppkey AS run, CASE WHEN l_suppkey % 6 <> 0 THEN avg(l_discount) > 0.049 END AS improved, CASE WHEN l_suppkey % 7 <> 0 THEN avg(l_tax) > 0.041 END AS inside_null,
  CASE WHEN l_suppkey % 7 <> 0 THEN 0.55 + avg(l_discount) / 2 END AS colour, l_suppkey % 5 <> 0 AS has_run, CASE WHEN l_suppkey % 5 <> 0 AND l_suppkey % 11 <> 0 THEN avg(l_quantity) / 34 END AS auc,
  CASE WHEN l_suppkey % 4 <> 0 THEN avg(l_extendedprice) / 70000 END AS frozen FROM lineitem GROUP BY 1),
q AS (SELECT *, improved AS q1, NOT inside_null AS q2, colour <= 0.53 + 0.05 AS q3, CASE WHEN has_run THEN coalesce(auc >= 0.75, false) END AS q4, auc > frozen AS q5 FROM a)
SELECT run, q1, q2, q3, q4, q5, coalesce(q1 AND q2 AND q3, false) AS ships, coalesce(q4, false) AS gate_would_open,
  coalesce(auc - 0.05 <= 0.75 AND auc + 0.05 >= 0.75, false) AS floor_inside_interval,
  concat_ws(',', CASE WHEN q1 IS NULL THEN 'q1' END, CASE WHEN q2 IS NULL THEN 'q2' END, CASE WHEN q3 IS NULL THEN 'q3' END, CASE WHEN q4 IS NULL THEN 'q4' END, CASE WHEN q5 IS NULL THEN 'q5' END) AS incomplete FROM q""")
def preregistered(spark, d):
    g = fx.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("run")).agg(
        exact_mean("l_discount").alias("di"), exact_mean("l_tax").alias("tx"), exact_mean("l_quantity").alias("qt"), exact_mean("l_extendedprice").alias("pr"))
    run = F.col("run")
    a = g.select(
        "run", F.when(run % 6 != 0, F.col("di") > 0.049).alias("improved"), F.when(run % 7 != 0, F.col("tx") > 0.041).alias("inside_null"),
        F.when(run % 7 != 0, 0.55 + F.col("di") / 2).alias("colour_auc"), (run % 5 != 0).alias("has_capture_run"),
        F.when((run % 5 != 0) & (run % 11 != 0), F.col("qt") / 34).alias("session_auc"), F.when(run % 4 != 0, F.col("pr") / 70000).alias("frozen_session_auc"),
    ).withColumn("session_ci_lo", F.col("session_auc") - 0.05).withColumn("session_ci_hi", F.col("session_auc") + 0.05)
    return C.preregistered_verdict(a).select("run", "q1", "q2", "q3", "q4", "q5", "ships", "gate_would_open", "floor_inside_interval", "incomplete")
