"""Arrival, lifecycle, plug-in and whole-evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer import fixtures as fx
from assayer import plugins as U
from assayer.operators import metrics as M
from assayer.operators.curve import auc
from assayer.operators.decide import isolated_scorer
from assayer.plans import evaluation as E
from assayer.plans.catalog.decisions import curves
from assayer.plans.catalog.metrics import auc_sql, ece_sql, r6, tpr_sql
from assayer.plans.catalog.registry import query
from assayer.plans.catalog.splits import _COS, _FOLDS, assignments, draws_sql, relabelled, weighted_auc_sql
from assayer.streaming import decisions as D
from assayer.streaming import inbox as T


@query("T1_acceptable_arrivals", """
SELECT path FROM (SELECT 'in/' || CASE doc_id % 7 WHEN 0 THEN '.d' || doc_id || '.png' WHEN 1 THEN 'd' || doc_id || '.png.PART' WHEN 2 THEN 'd' || doc_id || '.tmp' ELSE 'd' || doc_id || '.png' END AS path,
  CASE WHEN doc_id % 5 = 0 THEN 0 ELSE n_chars END AS length, doc_id FROM documents) WHERE doc_id % 7 > 2 AND length > 0""")
def acceptable_arrivals(spark, d):
    k = F.col("doc_id")
    name = F.when(k % 7 == 0, F.concat(F.lit(".d"), k, F.lit(".png"))).when(k % 7 == 1, F.concat(F.lit("d"), k, F.lit(".png.PART"))).when(k % 7 == 2, F.concat(F.lit("d"), k, F.lit(".tmp"))).otherwise(F.concat(F.lit("d"), k, F.lit(".png")))
    files = fx.table(spark, d, "documents").select(F.concat(F.lit("in/"), name).alias("path"), F.when(k % 5 == 0, 0).otherwise(F.col("n_chars")).alias("length"))
    return T.acceptable(files).select("path")


@query("T2_settled", """
WITH s AS (SELECT user_id, event_id, CAST(floor(value / 25) AS BIGINT) AS size, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
c AS (SELECT *, CASE WHEN size = lag(size) OVER (PARTITION BY user_id ORDER BY k) THEN 0 ELSE 1 END AS fresh FROM s),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY k) AS run FROM c), p AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY k) AS pos FROM r)
SELECT user_id AS name, event_id AS settled_at, size, CASE WHEN size = 0 THEN 'empty' ELSE 'accepted' END AS outcome FROM p WHERE pos % 2 = 0""")
def settled(spark, d):
    e = fx.table(spark, d, "events").select(F.col("user_id").alias("name"), F.col("event_id").alias("scan"), F.floor(F.col("value") / 25).alias("size"))
    return T.settled(e)


@query("T3_enqueued", """
SELECT substr(sha256('in/' || doc_id || '.txt|' || a), 1, 32) AS id, sha256(text) AS content_sha256, doc_id || '.txt' AS filename, 'watch' AS source, 'in/' || doc_id || '.txt' AS path, CAST(a AS INTEGER) AS event_time, 'queued' AS status
FROM documents, range(1, 3) t(a) WHERE a = 1 OR doc_id % 6 = 0""")
def enqueued(spark, d):
    k = F.col("doc_id")
    times = F.when(k % 6 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    docs = fx.table(spark, d, "documents").select(F.concat(F.lit("in/"), k, F.lit(".txt")).alias("path"), F.explode(times).alias("arrived"), "text")
    return T.enqueue(docs, "path", "arrived", F.sha2("text", 256))


_LIFE = "(SELECT event_id // 4 AS id, event_id AS seq, ts, CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'running' WHEN 'error' THEN 'failed' ELSE 'done' END AS status FROM events)"


def _life(spark, d):
    t = F.col("event_type")
    status = F.when(t == "view", "queued").when(t == "click", "running").when(t == "error", "failed").otherwise("done")
    return fx.table(spark, d, "events").select(F.floor(F.col("event_id") / 4).alias("id"), F.col("event_id").alias("seq"), F.col("ts").alias("event_time"), status.alias("status"))


_REPLAY = f"""
RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq) AS k FROM {_LIFE}),
r AS (SELECT id, seq, status, k, '' AS was, status = 'queued' AS legal FROM e WHERE k = 1
  UNION ALL SELECT e.id, e.seq, e.status, e.k, n.now AS was, (n.now, e.status) IN (('', 'queued'), ('queued', 'running'), ('running', 'done'), ('running', 'failed'), ('running', 'queued')) AS legal
  FROM (SELECT *, CASE WHEN NOT legal THEN was WHEN status IN ('done', 'failed') THEN '' ELSE status END AS now FROM r) n JOIN e ON e.id = n.id AND e.k = n.k + 1)"""


@query("T4_current_state", f"WITH {_REPLAY} SELECT id, max(seq) AS seq, arg_max(status, seq) AS status FROM r WHERE legal GROUP BY 1")
def current_state(spark, d):
    return T.current_state(_life(spark, d))


@query("T4_illegal_transitions", f"WITH {_REPLAY} SELECT id, seq, was, status FROM r WHERE NOT legal")
def illegal_transitions(spark, d):
    return T.illegal_transitions(_life(spark, d))


@query("T4_lifecycle_stream", f"WITH {_REPLAY} SELECT CAST(id AS VARCHAR) AS id, seq, was, status, legal FROM r")
def lifecycle_stream(spark, d):
    """The whole event table as a stream, through files in the shared folder."""
    life = _life(spark, d).select(F.col("id").cast("string").alias("id"), "seq", "status")
    return _drained(life, T.lifecycle_stream)


@query("T5_requeue_stream", f"""WITH {_REPLAY} SELECT CAST(r.id AS VARCHAR) AS id, 'running' AS was, 'queued' AS status FROM r JOIN events ON event_id = seq WHERE legal GROUP BY 1
HAVING arg_max(status, seq) = 'running' AND arg_max(ts, seq) + INTERVAL 2 DAYS < (SELECT max(ts) FROM events)""")
def requeue_stream(spark, d):
    """Submissions that the stream's timer puts back in the queue once the watermark has passed their two days."""
    life = _life(spark, d).select(F.col("id").cast("string").alias("id"), "seq", "status", F.col("event_time").cast("timestamp").alias("event_time"))
    return _drained(life, lambda events: T.lifecycle_stream(events, "2 days")).where("seq is null").select("id", "was", "status")


@query("T2_settle_stream", """
WITH s AS (SELECT user_id, event_id, CAST(floor(value / 25) AS BIGINT) AS size, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
c AS (SELECT *, CASE WHEN size = lag(size) OVER (PARTITION BY user_id ORDER BY k) THEN 0 ELSE 1 END AS fresh FROM s),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY k) AS run FROM c), p AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY k) AS pos FROM r)
SELECT CAST(user_id AS VARCHAR) AS name, event_id AS settled_at, size, CASE WHEN size = 0 THEN 'empty' ELSE 'accepted' END AS outcome FROM p WHERE pos % 2 = 0""")
def settle_stream(spark, d):
    e = fx.table(spark, d, "events").select(F.col("user_id").cast("string").alias("name"), F.col("event_id").alias("scan"), F.floor(F.col("value") / 25).alias("size"))
    return _drained(e, T.settle_stream)


def _drained(rows, stream):
    """Write rows to the shared folder, run them through a stream once, and read what it appended."""
    spark, out = rows.sparkSession, D.scratch(rows.sparkSession, "stream")
    rows.write.parquet(f"{out}/in")
    run = stream(spark.readStream.schema(rows.schema).parquet(f"{out}/in"))
    run.writeStream.outputMode("append").format("parquet").option("path", f"{out}/out").option("checkpointLocation", f"{out}/offsets").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(run.schema).parquet(f"{out}/out")


@query("T5_orphans", f"SELECT id, 'queued' AS status FROM {_LIFE} GROUP BY 1 HAVING arg_max(status, seq) = 'running' AND max(ts) < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 2 DAYS")
def orphans(spark, d):
    now = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    return T.orphans(_life(spark, d), now, "2 DAYS", ["seq"]).select("id", "status")


def _sixths_raise(items):
    if (items["k"] % 6 == 0).any():
        raise RuntimeError("the batch holds an item that cannot be scored")
    return (items["n"] % 100) / 100.0


@query("T6_decided_items", """
WITH e AS (SELECT CAST(page_id AS VARCHAR) AS id, page_id % 6 = 0 AS bad, greatest(-6.0, least(6.0, 5.0 * (length(html) % 100) / 100.0 - 1.5 - ln(0.45 / 0.55))) AS llr FROM pages)
SELECT id, CASE WHEN bad THEN 'failed' ELSE 'done' END AS status, CASE WHEN NOT bad THEN CASE WHEN llr >= 1 THEN 'fake' WHEN llr <= -1 THEN 'real' ELSE 'insufficient_evidence' END END AS verdict,
  CASE WHEN NOT bad THEN round(llr, 6) END AS llr_total, CASE WHEN bad THEN 'every detector raised on this item' END AS error FROM e""")
def decided_items(spark, d):
    items = fx.table(spark, d, "pages").select(F.col("page_id").cast("string").alias("sample_id"), F.length("html").alias("n"), F.col("page_id").alias("k"))
    scores = isolated_scorer(items, "d_value", "1.0", _sixths_raise).withColumn("band", F.lit("medium"))
    return D.decide_items(scores, curves(spark)).select("id", "status", "verdict", r6("llr_total").alias("llr_total"), "error")


@query("T7_queue_depth", "SELECT count(*) FILTER (status = 'queued') AS queued, count(*) FILTER (status = 'running') AS running, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'failed') AS failed FROM fx_submissions", ("fx_submissions",))
def queue_depth(spark, d):
    return T.queue_depth(M.status_counts(fx.submissions(spark, d)))


@query("T7_streaming_counts", "SELECT status, verdict, count(*) AS n FROM fx_submissions GROUP BY 1, 2", ("fx_submissions",))
def streaming_counts(spark, d):
    schema = fx.table(spark, d, "orders").schema
    o = spark.readStream.schema(schema).option("pathGlobFilter", "orders.parquet").parquet(d)
    done = F.col("o_orderstatus") == "F"
    subs = o.select(F.when(done, "done").when(F.col("o_orderstatus") == "O", "queued").otherwise("running").alias("status"), F.when(done, F.col("o_orderpriority")).alias("verdict"))
    out = D.scratch(spark, "counts")
    q = D.running_counts(subs, f"{out}/table", f"{out}/offsets")
    q.awaitTermination()
    return spark.read.schema("status string, verdict string, n bigint").parquet(f"{out}/table")


@query("T8_expired", """
SELECT o_orderkey AS path FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01 00:00:00' - INTERVAL 365 DAYS AND o_orderstatus = 'F'""")
def expired(spark, d):
    o = fx.table(spark, d, "orders")
    files = o.select(F.col("o_orderkey").alias("path"), F.col("o_orderdate").alias("modified"))
    subs = fx.submissions(spark, d).select(F.col("id").alias("path"), "status")
    return T.expired(files, subs, F.lit("1999-01-01 00:00:00").cast("timestamp_ntz"), 365).select("path")


def _observations(spark, d):
    return fx.table(spark, d, "conversations").select(
        F.concat(F.lit("c"), "conv_id").alias("sample_id"), F.when(F.col("role") == "system", "reject").when(F.col("role") == "user", "medium").otherwise("high").alias("band"), F.col("text").alias("payload"))


@query("U1_scorer_table", """
WITH o AS (SELECT 'c' || conv_id AS sample_id, role, text FROM conversations),
a AS (SELECT sample_id, avg(CASE WHEN role = 'assistant' THEN (length(text) % 100) / 100.0 END) AS s, count(*) FILTER (role = 'assistant') AS n FROM o GROUP BY 1),
b AS (SELECT sample_id, sum(CASE WHEN role <> 'system' THEN ('0x' || substr(md5(concat_ws('|', '7', text)), 1, 15))::BIGINT % 10000 END) % 10000 / 10000.0 AS s, count(*) FILTER (role <> 'system') AS n FROM o GROUP BY 1)
SELECT sample_id, 'length' AS detector, '1' AS version, round(s, 6) AS score, n = 0 AS abstained, CASE WHEN n = 0 THEN 'below_quality_floor' ELSE 'ok' END AS reason FROM a
UNION ALL SELECT sample_id, 'noise', 'synthetic-1', round(CAST(s AS DOUBLE), 6), n = 0, CASE WHEN n = 0 THEN 'below_quality_floor' ELSE 'ok' END FROM b""")
def scorer_table(spark, d):
    obs = _observations(spark, d)
    length = U.ExpressionScorer("length", "1", lambda: F.length("payload") % 100 / 100.0, "high")
    rows = U.run_scorers(obs.select("sample_id").distinct(), obs, [length, U.SyntheticScorer("noise", 7)])
    return rows.withColumn("score", r6("score"))


@query("U3_synthetic_scores", """
SELECT 'c' || conv_id AS sample_id, round(CAST(sum(('0x' || substr(md5(concat_ws('|', '3', text)), 1, 15))::BIGINT % 10000) % 10000 / 10000.0 AS DOUBLE), 6) AS score FROM conversations WHERE role <> 'system' GROUP BY 1""")
def synthetic_scores(spark, d):
    return U.SyntheticScorer("noise", 3)(_observations(spark, d)).withColumn("score", r6("score"))


@query("U6_adversarial_status", """
WITH r AS (SELECT 'd' || l_linenumber AS detector, count(*) AS n, avg(l_discount) AS t FROM lineitem GROUP BY 1)
SELECT detector, n, CASE WHEN detector NOT IN ('d1', 'd2', 'd3', 'd5') THEN round(t, 6) END AS adversarial_tpr,
  CASE WHEN detector IN ('d2', 'd1') THEN 'no_target' WHEN detector = 'd3' THEN 'weights_absent' WHEN detector = 'd5' THEN 'not_measurable' ELSE 'ok' END AS adversarial_status FROM r""")
def adversarial_status(spark, d):
    g = fx.table(spark, d, "lineitem").groupBy(F.concat(F.lit("d"), "l_linenumber").alias("detector")).agg(F.count(F.lit(1)).alias("n"), F.avg("l_discount").alias("t"))
    attacks = g.where(F.col("detector") != "d1").select("detector", F.when(F.col("detector") != "d5", r6("t")).alias("adversarial_tpr"))
    return U.adversarial_status(g.select("detector", "n"), attacks, g.where(~F.col("detector").isin("d1", "d2")).select("detector", (F.col("detector") != "d3").alias("weights_present")))


@query("U7_face_regions", """
WITH b AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY w * h DESC, ordinal, l_partkey, l_suppkey) AS rn FROM fx_detections),
c AS (SELECT frame_id, least(40, x + w) - greatest(0, x) AS cw, least(22, y + h) - greatest(0, y) AS ch FROM b WHERE rn = 1)
SELECT frame_id, CASE WHEN cw >= 2 AND ch >= 2 THEN CAST(cw * ch AS BIGINT) END AS area, CASE WHEN cw >= 2 AND ch >= 2 THEN 'ok' ELSE 'degenerate_box' END AS reason FROM c""", ("fx_detections",))
def face_regions(spark, d):
    r = U.face_regions(fx.detections(spark, d), "frame_id", 40, 22, ["ordinal", "l_partkey", "l_suppkey"])
    return r.select("frame_id", (F.col("roi.w") * F.col("roi.h")).cast("bigint").alias("area"), "reason")


_RUN_REPS = 20


@query("C17_compare_runs", f"""
WITH {_FOLDS}, s AS (SELECT a.fold, r.subject_id, a.label, r.value / (r.value + 50) AS b, r.inter_ocular_px / 120 AS c FROM asg a JOIN fx_records r ON r.sample_id = a.sample_id WHERE side = 'test'), d AS {draws_sql('s', 'fold', 'subject_id', _RUN_REPS, 0)},
x AS (SELECT 0 AS arm, s.fold, rep, b AS score, label, w FROM s JOIN d ON d.fold = s.fold AND d.subject_id = s.subject_id UNION ALL SELECT 1, s.fold, rep, c, label, w FROM s JOIN d ON d.fold = s.fold AND d.subject_id = s.subject_id),
o AS (SELECT 0 AS arm, fold, b AS score, label, 1 AS w FROM s UNION ALL SELECT 1, fold, c, label, 1 FROM s),
p AS (SELECT fold, max(CASE WHEN arm = 0 THEN stat END) AS ba, max(CASE WHEN arm = 1 THEN stat END) AS ca FROM {weighted_auc_sql('o', 'arm, fold')} GROUP BY 1),
dl AS (SELECT fold, rep, max(CASE WHEN arm = 1 THEN stat END) - max(CASE WHEN arm = 0 THEN stat END) AS stat FROM {weighted_auc_sql('x', 'arm, fold, rep')} GROUP BY 1, 2),
q AS (SELECT fold, quantile_cont(stat, 0.025) AS lo, quantile_cont(stat, 0.975) AS hi FROM dl GROUP BY 1), n AS (SELECT fold, count(*) AS n, count(*) FILTER (label = 1) AS n_fake, count(DISTINCT subject_id) AS n_subjects FROM s GROUP BY 1)
SELECT p.fold, round(ba, 6) AS baseline_auc, round(ca, 6) AS candidate_auc, round(ca - ba, 6) AS delta, round(lo, 6) AS ci_lo, round(hi, 6) AS ci_hi, n, n_fake, n_subjects,
  p.fold = (SELECT arg_min(fold, ba) FROM p) AS is_worst, CASE WHEN p.fold = (SELECT arg_min(fold, ba) FROM p) THEN ca - ba > 0 AND lo > 0 END AS improved FROM p JOIN q ON q.fold = p.fold JOIN n ON n.fold = p.fold""", ("fx_records",))
def compare_runs(spark, d):
    t = assignments(spark, d).where(F.col("side") == "test").join(fx.records(spark, d).select("sample_id", "subject_id", "value", "inter_ocular_px"), "sample_id")
    base = t.select("fold", "sample_id", "subject_id", "label", (F.col("value") / (F.col("value") + 50)).alias("score"))
    cand = t.select("fold", "sample_id", "subject_id", "label", (F.col("inter_ocular_px") / 120).alias("score"))
    c = E.compare_runs(base, cand, _RUN_REPS, check=False)
    return c.select("fold", *[r6(k).alias(k) for k in ("baseline_auc", "candidate_auc", "delta", "ci_lo", "ci_hi")], "n", "n_fake", "n_subjects", "is_worst", "improved")


def _cells(section: str, subject: str, metrics: list[str], source: str) -> str:
    names, values = ", ".join(f"'{m}'" for m in metrics), ", ".join(f"CAST({m} AS DOUBLE)" for m in metrics)
    return f"SELECT '{section}' AS section, {subject} AS subject, unnest([{names}]) AS metric, unnest([{values}]) AS value FROM {source}"


_EVAL_REPS = 12
_SCORES = ["n", "abstention_rate", "auc", "tpr_at_1pct", "tpr_at_0p1pct", "ece", "ci_lo", "ci_hi", "n_draws", "n_degenerate"]


def _report_sql(source: str, by: str) -> str:
    """All metrics of a detector table keyed by one text column, with a bootstrap interval over subjects."""
    return f"""(SELECT h.{by} AS k, h.n, ab AS abstention_rate, a.auc, t1.tpr AS tpr_at_1pct, t2.tpr AS tpr_at_0p1pct, CASE WHEN a.auc IS NOT NULL THEN e.ece END AS ece, ci_lo, ci_hi, n_draws, n_degenerate
  FROM (SELECT {by}, count(*) AS n, avg(CASE WHEN score IS NULL THEN 1.0 ELSE 0.0 END) AS ab FROM {source} GROUP BY 1) h
  LEFT JOIN {auc_sql(source, by)} a ON a.{by} = h.{by} LEFT JOIN {tpr_sql(source, by, 0.01)} t1 ON t1.{by} = h.{by} LEFT JOIN {tpr_sql(source, by, 0.001)} t2 ON t2.{by} = h.{by}
  LEFT JOIN {ece_sql(source, by)} e ON e.{by} = h.{by}
  LEFT JOIN (SELECT {by}, quantile_cont(stat, 0.025) AS ci_lo, quantile_cont(stat, 0.975) AS ci_hi, count(*) AS n_draws, count(*) FILTER (stat IS NULL) AS n_degenerate
    FROM {weighted_auc_sql(f"(SELECT s.{by}, d.rep, s.score, s.label, d.w FROM {source}_finite s JOIN {source}_draws d ON d.{by} = s.{by} AND d.subject_id = s.subject_id)", f'{by}, rep')} GROUP BY 1) c ON c.{by} = h.{by})"""


_IDENTITY = ["n_train", "n_test", "max_similarity", "violations", "threshold", "violation_rate", "tolerated_rate", "n_subjects_total"]
_PAIR = "SELECT {k}, count(*) AS pairs, count(*) FILTER (c >= 0.35) AS violations, greatest(0, max(c)) AS max_similarity"


@query("C18_evaluation", f"""
WITH {_FOLDS},
sj AS (SELECT s.detector, s.score, r.sample_id, r.subject_id, r.y AS label, r.g AS generator, r.stratum, r.exposure FROM fx_scores s JOIN r ON r.sample_id = s.sample_id),
fj AS (SELECT asg.fold || '/' || sj.detector AS fd, asg.fold, sj.detector, sj.score, sj.label, sj.subject_id FROM sj JOIN asg ON asg.sample_id = sj.sample_id WHERE side = 'test'),
sj_finite AS (SELECT * FROM sj WHERE score IS NOT NULL), fj_finite AS (SELECT * FROM fj WHERE score IS NOT NULL),
sj_draws AS {draws_sql('sj_finite', 'detector', 'subject_id', _EVAL_REPS, 4)}, fj_draws AS {draws_sql('fj_finite', 'fd', 'subject_id', _EVAL_REPS, 4)},
rep AS (SELECT *, CASE k WHEN 'd_value' THEN 'ok' WHEN 'd_exposure' THEN 'weights_absent' ELSE 'no_target' END AS status, CASE WHEN k = 'd_value' THEN (SELECT avg(exposure) FROM fx_records) END AS adversarial_tpr FROM {_report_sql('sj', 'detector')}),
fold AS (SELECT f.*, split_part(k, '/', 1) AS fold, split_part(k, '/', 2) AS detector, n_dropped FROM {_report_sql('fj', 'fd')} f JOIN (SELECT fold, count(*) FILTER (side = 'dropped') AS n_dropped FROM asg GROUP BY 1) x ON x.fold = split_part(k, '/', 1)),
va AS (SELECT detector || '/dim' AS dv, 0.8 * score + 0.1 * exposure AS score, label FROM sj UNION ALL SELECT detector || '/flip', 1 - score, label FROM sj),
vr AS (SELECT h.dv, n, n_scored, tpr AS tpr_at_1pct FROM (SELECT dv, count(*) AS n, count(score) AS n_scored FROM va GROUP BY 1) h LEFT JOIN {tpr_sql('va', 'dv', 0.01)} t ON t.dv = h.dv),
pg AS (SELECT stratum, count(*) FILTER (y = 0) AS n FROM r GROUP BY 1), pk AS (SELECT sj.* FROM sj JOIN pg ON pg.stratum = sj.stratum WHERE pg.n >= 150 AND score IS NOT NULL),
pt AS (SELECT detector, quantile_cont(score, 0.99) AS thr FROM pk WHERE label = 0 GROUP BY 1),
pr AS (SELECT pk.detector, pk.stratum, avg(CASE WHEN label = 0 THEN CASE WHEN score > thr THEN 1.0 ELSE 0.0 END END) AS fpr FROM pk JOIN pt ON pt.detector = pk.detector GROUP BY 1, 2),
px AS (SELECT detector, CASE WHEN count(fpr) < 2 THEN 1 WHEN min(fpr) = 0 THEN CASE WHEN max(fpr) > 0 THEN CAST('inf' AS DOUBLE) ELSE 1 END ELSE max(fpr) / min(fpr) END AS ratio FROM pr GROUP BY 1),
par AS (SELECT d.detector, CASE WHEN ok < 2 THEN 'too_few_per_stratum' ELSE 'ok' END AS status, thr AS threshold, ratio AS fpr_ratio, n_excluded FROM (SELECT DISTINCT detector FROM sj) d
  CROSS JOIN (SELECT count(*) FILTER (n >= 150) AS ok, count(*) FILTER (n < 150) AS n_excluded FROM pg) LEFT JOIN pt ON pt.detector = d.detector AND ok >= 2 LEFT JOIN px ON px.detector = d.detector AND ok >= 2),
em AS (SELECT CAST(vec_id AS VARCHAR) AS sample_id, embedding FROM embeddings),
pe AS (SELECT r.subject_id, arg_min(embedding, em.sample_id) AS embedding FROM em JOIN r ON r.sample_id = em.sample_id GROUP BY 1),
fp AS ({_PAIR.format(k='fold')} FROM (SELECT x.fold, {_COS} AS c FROM asg x JOIN em a ON a.sample_id = x.sample_id JOIN asg z ON z.fold = x.fold JOIN em b ON b.sample_id = z.sample_id WHERE x.side = 'train' AND z.side = 'test') GROUP BY 1),
cp AS ({_PAIR.format(k="'corpus'")} FROM (SELECT {_COS} AS c FROM pe a JOIN pe b ON a.subject_id < b.subject_id)),
idn AS (SELECT 'fold' AS scope, n.fold AS name, n_train, n_test, coalesce(max_similarity, 0) AS max_similarity, coalesce(violations, 0) AS violations, 0.35 AS threshold, coalesce(violations / pairs, 0) AS violation_rate, 0 AS tolerated_rate, NULL AS n_subjects_total
  FROM (SELECT fold, count(*) FILTER (side = 'train') AS n_train, count(*) FILTER (side = 'test') AS n_test FROM asg GROUP BY 1) n LEFT JOIN fp ON fp.fold = n.fold
  UNION ALL SELECT 'corpus', 'corpus', (SELECT count(*) FROM pe), (SELECT count(*) FROM pe), max_similarity, violations, 0.35, violations / pairs, 0, (SELECT count(*) FROM pe) FROM cp),
wi AS (SELECT arg_max(name, (violation_rate, max_similarity, name)) AS worst, max(violation_rate) AS violation_rate, arg_max(max_similarity, (violation_rate, max_similarity, name)) AS max_similarity FROM idn),
cells AS ({_cells('report', "k || '/' || status", [*_SCORES, 'adversarial_tpr'], 'rep')}
  UNION ALL {_cells('folds', "fold || '/' || detector", [*_SCORES, 'n_dropped'], 'fold')}
  UNION ALL {_cells('variants', 'dv', ['n', 'n_scored', 'tpr_at_1pct'], 'vr')}
  UNION ALL {_cells('abstention', "detector || '/' || class", ['abstained', 'total'], "(SELECT detector, coalesce(generator, 'real') AS class, count(*) FILTER (score IS NULL) AS abstained, count(*) AS total FROM sj GROUP BY 1, 2)")}
  UNION ALL {_cells('fold_sizes', 'fold', ['train_reals', 'train_fakes', 'test_reals', 'test_fakes', 'dropped'], "(SELECT fold, count(*) FILTER (side = 'train' AND label = 0) AS train_reals, count(*) FILTER (side = 'train' AND label = 1) AS train_fakes, count(*) FILTER (side = 'test' AND label = 0) AS test_reals, count(*) FILTER (side = 'test' AND label = 1) AS test_fakes, count(*) FILTER (side = 'dropped') AS dropped FROM asg GROUP BY 1)")}
  UNION ALL {_cells('worst_fold', "detector || '/' || worst", ['worst_auc'], '(SELECT detector, min(auc) AS worst_auc, arg_min(fold, auc) AS worst FROM fold GROUP BY 1)')}
  UNION ALL {_cells('parity', "detector || '/' || status", ['threshold', 'fpr_ratio', 'n_excluded'], 'par')}
  UNION ALL {_cells('missing_embeddings', "''", ['n'], '(SELECT count(*) AS n FROM r WHERE sample_id NOT IN (SELECT sample_id FROM em))')}
  UNION ALL {_cells('identity', "scope || '/' || name", _IDENTITY, 'idn')}
  UNION ALL {_cells('worst_identity', "'violation/' || worst", ['violation_rate', 'max_similarity'], 'wi')})
SELECT section, subject, metric, round(value, 6) AS value FROM cells""", ("fx_records", "fx_scores"))
def evaluation(spark, d):
    r = relabelled(fx.records(spark, d)).withColumn("face_detector", F.lit("one")).withColumn("align", F.lit("five_point"))
    cfg = E.EvaluationConfig(seed=4, bootstrap=_EVAL_REPS, bootstrap_group="subject_id", identity_threshold=0.35, waived=frozenset({"parity", "identity"}))
    scored = fx.scored(spark, d)
    perturbed = F.array(F.struct(F.lit("dim").alias("variant"), (0.8 * F.col("score") + 0.1 * F.col("exposure")).alias("score")), F.struct(F.lit("flip").alias("variant"), (1 - F.col("score")).alias("score")))
    variants = scored.select("sample_id", "detector", F.inline(perturbed))
    names = scored.groupBy("detector").agg(F.avg("exposure").alias("adversarial_tpr"))
    attacks = names.where(F.col("detector") == "d_value")
    targets = names.where(F.col("detector") != "d_iod").select("detector", (F.col("detector") == "d_value").alias("weights_present"))
    out = E.run_evaluation(r, scored.select("sample_id", "detector", "score"), cfg, fx.identities(spark, d), variants, attacks, targets)
    return E.tidy({k: v for k, v in out.items() if k != "dataset"}).withColumn("value", r6("value"))


@query("M20_session_auc", """
WITH s AS (SELECT session_id, avg(score) AS score, min(label) AS label FROM fx_frames GROUP BY 1)
SELECT round(sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) / count(*), 6) AS auc, (SELECT count(*) FROM s WHERE label = 1) AS n_pos, (SELECT count(*) FROM s WHERE label = 0) AS n_neg
FROM s a, s b WHERE a.label = 1 AND b.label = 0""", ("fx_frames",))
def session_auc(spark, d):
    return auc(M.session_mean(fx.frames(spark, d))).withColumn("auc", r6("auc"))
