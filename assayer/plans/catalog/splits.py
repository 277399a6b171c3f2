"""Split, identity and resampling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer import fixtures as fx
from assayer.operators import identity as I
from assayer.operators import metrics as M
from assayer.operators import resample as B
from assayer.operators import splits as P
from assayer.operators.curve import auc
from assayer.plans.catalog.metrics import auc_sql, r6, tpr_sql
from assayer.plans.catalog.registry import query
from assayer.plans.catalog.selection import _md5
from assayer.session import scratch_path, shared
from assayer.sources import sinks


@query("F1_record_violations", """
WITH r AS (SELECT CAST(o_orderkey AS VARCHAR) AS sample_id, CASE WHEN o_orderkey % 41 <> 0 THEN 'c' || o_custkey END AS subject_id, 'o' || (o_orderkey // 3) AS source_id,
  CASE WHEN o_orderkey % 37 = 0 THEN 2 WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 31 <> 0 THEN o_orderpriority WHEN o_orderkey % 29 = 0 THEN 'x' END AS generator FROM orders)
SELECT 'missing_subject_id' AS problem, sample_id AS key FROM r WHERE subject_id IS NULL
UNION ALL SELECT 'label_not_binary', sample_id FROM r WHERE label = 2
UNION ALL SELECT 'fake_without_generator', sample_id FROM r WHERE label = 1 AND generator IS NULL
UNION ALL SELECT 'real_with_generator', sample_id FROM r WHERE label = 0 AND generator IS NOT NULL
UNION ALL SELECT 'source_straddles', source_id FROM (SELECT DISTINCT source_id, coalesce(subject_id, '-') AS s, coalesce(generator, 'real') AS g FROM r) GROUP BY source_id HAVING count(*) > 1""")
def record_violations(spark, d):
    k, fake = F.col("o_orderkey"), F.col("o_orderstatus") == "F"
    r = fx.table(spark, d, "orders").select(
        k.cast("string").alias("sample_id"), F.when(k % 41 != 0, F.concat(F.lit("c"), "o_custkey")).alias("subject_id"),
        F.concat(F.lit("o"), F.floor(k / 3).cast("string")).alias("source_id"), F.when(k % 37 == 0, 2).when(fake, 1).otherwise(0).alias("label"),
        F.when(fake & (k % 31 != 0), F.col("o_orderpriority")).when(k % 29 == 0, "x").alias("generator"))
    return P.record_violations(r)


_SUBJECT_RANK = "row_number() OVER (ORDER BY " + _md5(4, "subject_id") + ", subject_id)"
_FOLDS = f"""
r AS (SELECT *, CASE WHEN subject_id IN ('u1', 'u2', 'u3') AND label = 0 THEN 1 ELSE label END AS y, CASE WHEN subject_id IN ('u1', 'u2', 'u3') AND label = 0 THEN 'error' ELSE generator END AS g FROM fx_records),
s0 AS (SELECT subject_id, bool_or(y = 0) AS has_real, list(DISTINCT g) FILTER (y = 1) AS gens FROM r GROUP BY 1),
s1 AS (SELECT *, {_SUBJECT_RANK} <= greatest(1, (SELECT count(*) FROM s0) // 2) AS base FROM s0),
s2 AS (SELECT subject_id, has_real, gens, CASE WHEN (SELECT count(*) FILTER (has_real) FROM s1) >= 2 AND subject_id = (SELECT min(subject_id) FROM s1 WHERE has_real)
   AND (SELECT count(DISTINCT base) FROM s1 WHERE has_real) = 1 THEN NOT base ELSE base END AS base FROM s1),
f AS (SELECT DISTINCT g AS fold FROM r WHERE y = 1),
sf AS (SELECT fold, subject_id, CASE WHEN NOT has_real AND NOT base AND NOT list_contains(gens, fold) THEN true WHEN NOT has_real AND base AND gens = [fold] THEN false ELSE base END AS train FROM s2, f),
asg AS (SELECT sf.fold, r.sample_id, r.y AS label, CASE WHEN y = 0 THEN CASE WHEN train THEN 'train' ELSE 'test' END WHEN g = sf.fold AND NOT train THEN 'test' WHEN g <> sf.fold AND train THEN 'train' ELSE 'dropped' END AS side
  FROM r JOIN sf ON sf.subject_id = r.subject_id)"""


def relabelled(df):
    hit = F.col("subject_id").isin("u1", "u2", "u3") & (F.col("label") == 0)
    return df.withColumn("generator", F.when(hit, "error").otherwise(F.col("generator"))).withColumn("label", F.when(hit, 1).otherwise(F.col("label")))


def assignments(spark, d):
    return shared(P.generator_folds(relabelled(fx.records(spark, d)), 4))


@query("F2_generator_folds", f"WITH {_FOLDS} SELECT fold, sample_id, side FROM asg", ("fx_records",))
def generator_folds(spark, d):
    return assignments(spark, d).select("fold", "sample_id", "side")


@query("F2_fold_counts", f"""WITH {_FOLDS} SELECT fold, count(*) FILTER (side = 'train' AND label = 0) AS train_reals, count(*) FILTER (side = 'train' AND label = 1) AS train_fakes,
  count(*) FILTER (side = 'test' AND label = 0) AS test_reals, count(*) FILTER (side = 'test' AND label = 1) AS test_fakes, count(*) FILTER (side = 'dropped') AS dropped FROM asg GROUP BY 1""", ("fx_records",))
def fold_counts(spark, d):
    return P.fold_counts(assignments(spark, d))


@query("F4_group_holdout", f"""
WITH g AS (SELECT subject_id, row_number() OVER (ORDER BY {_md5(2, 'subject_id')}, subject_id) AS rk, count(*) OVER () AS n FROM (SELECT DISTINCT subject_id FROM fx_records))
SELECT r.sample_id, CASE WHEN rk <= greatest(1, round_even(n * 0.3, 0)) THEN 'test' ELSE 'train' END AS side FROM fx_records r JOIN g ON g.subject_id = r.subject_id""", ("fx_records",))
def group_holdout(spark, d):
    return P.group_holdout(fx.records(spark, d).select("sample_id", "subject_id"), "subject_id", 0.3, 2).select("sample_id", "side")


_SERPENT = "n_rows DESC, {md5}"


@query("F5_class_aware_split", f"""
WITH g AS (SELECT "domain", count(*) AS n_rows, CASE WHEN min(label) <> max(label) THEN 'mixed' ELSE CAST(min(label) AS VARCHAR) END AS kind FROM fx_docs GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY {_SERPENT.format(md5=_md5(6, '"domain"'))}, "domain") AS rk FROM g)
SELECT d.sample_id, CASE WHEN ((rk - 1) % 4 IN (0, 3)) = (kind <> 'mixed') THEN 'fit' ELSE 'test' END AS side FROM fx_docs d JOIN r ON r."domain" = d."domain" """, ("fx_docs",))
def class_aware_split(spark, d):
    return P.class_aware_split(fx.docs(spark, d), "domain", "label", 6).select("sample_id", "side")


@query("F6_half_split", f"""
WITH g AS (SELECT "domain", row_number() OVER (ORDER BY {_md5(9, '"domain"')}, "domain") AS rk, count(*) OVER () AS n FROM (SELECT DISTINCT "domain" FROM fx_records))
SELECT side, count(*) AS n FROM (SELECT CASE WHEN rk <= greatest(1, n // 2) THEN 'test' ELSE 'train' END AS side FROM fx_records r JOIN g ON g."domain" = r."domain") GROUP BY 1""", ("fx_records",))
def half_split(spark, d):
    return P.half_split(fx.records(spark, d), "domain", 9).groupBy("side").agg(F.count(F.lit(1)).alias("n"))


@query("F7_group_kfold", f"""
WITH g AS (SELECT session_id, count(*) AS n_rows FROM fx_frames GROUP BY 1), r AS (SELECT *, (row_number() OVER (ORDER BY {_SERPENT.format(md5=_md5(8, 'session_id'))}, session_id) - 1) % 10 AS pos FROM g)
SELECT session_id, CAST(CASE WHEN pos < 5 THEN pos ELSE 9 - pos END AS INTEGER) AS fold FROM r""", ("fx_frames",))
def group_kfold(spark, d):
    return P.group_kfold(fx.frames(spark, d), "session_id", 5, 8).select("session_id", "fold").distinct()


_MASKS = f"""
g AS (SELECT subject_id, row_number() OVER (ORDER BY {_md5(5, 'subject_id')}, subject_id) <= greatest(1, count(*) OVER () // 2) AS is_test FROM (SELECT DISTINCT subject_id FROM fx_records)),
m AS (SELECT f.held, r.sample_id, r.subject_id, r.generator, r.label, r.value, r.inter_ocular_px, r.exposure, CASE WHEN is_test THEN 'test' ELSE 'train' END AS side FROM fx_records r JOIN g ON g.subject_id = r.subject_id,
  (SELECT DISTINCT generator AS held FROM fx_records WHERE generator IS NOT NULL) f WHERE generator IS NULL OR (is_test AND generator = f.held) OR (NOT is_test AND generator <> f.held))"""


@query("F8_doubly_disjoint", f"WITH {_MASKS} SELECT held, sample_id, side FROM m", ("fx_records",))
def doubly_disjoint(spark, d):
    return P.doubly_disjoint(fx.records(spark, d), "subject_id", 5).select("held", "sample_id", "side")


@query("F9_row_split", f"""
SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {_md5(1, 'doc_id')}, doc_id) <= greatest(1, round_even((SELECT count(*) FROM documents) * 0.25, 0)) THEN 'test' ELSE 'train' END AS side FROM documents""")
def row_split(spark, d):
    return P.row_split(fx.table(spark, d, "documents").select("doc_id"), "doc_id", 0.25, 1)


@query("F10_window_violations", """
SELECT 's' || s_suppkey AS detector, 'v' || s_nationkey AS version, n_nationkey * 400 AS "window" FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE 5000 < n_nationkey * 400""")
def window_violations(spark, d):
    det = fx.table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("detector"), F.concat(F.lit("v"), "s_nationkey").alias("version"))
    win = fx.table(spark, d, "nation").select(F.concat(F.lit("v"), "n_nationkey").alias("version"), (F.col("n_nationkey") * 400).alias("window"))
    return P.window_violations(det, win, 5000)


# --- identity ----------------------------------------------------------------

_COS = "list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])) * list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))"


def _rounded(r):
    return r.select("n_train", "n_test", r6("max_similarity").alias("max_similarity"), "violations", "threshold", r6("violation_rate").alias("violation_rate"), "tolerated_rate", *[c for c in r.columns if c == "n_subjects_total"])


@query("G1_identity_disjoint", f"""
WITH p AS (SELECT {_COS} AS c FROM (SELECT * FROM embeddings WHERE label < 6) a, (SELECT * FROM embeddings WHERE label >= 6) b)
SELECT (SELECT count(*) FROM embeddings WHERE label < 6) AS n_train, (SELECT count(*) FROM embeddings WHERE label >= 6) AS n_test, round(greatest(0, max(c)), 6) AS max_similarity,
  count(*) FILTER (c >= 0.35) AS violations, 0.35::DOUBLE AS threshold, round(count(*) FILTER (c >= 0.35) / count(*), 6) AS violation_rate, 0.01::DOUBLE AS tolerated_rate FROM p""")
def identity_disjoint(spark, d):
    e = fx.identities(spark, d)
    test = F.col("subject_id") >= "p6"
    return _rounded(I.identity_disjoint(e.where(~test), e.where(test), e, 0.35, 0.01))


@query("G1_missing_embeddings", "SELECT CAST(event_id AS VARCHAR) AS sample_id FROM events WHERE event_id NOT IN (SELECT vec_id FROM embeddings)")
def missing_embeddings(spark, d):
    return I.missing_embeddings(fx.records(spark, d), fx.identities(spark, d))


@query("G2_subject_partition", f"""
WITH s AS (SELECT 'p' || (vec_id % 300) AS subject_id, CAST(vec_id AS VARCHAR) AS sample_id, embedding FROM embeddings), r AS (SELECT subject_id, arg_min(embedding, sample_id) AS embedding FROM s GROUP BY 1),
k AS (SELECT * FROM r), p AS (SELECT {_COS} AS c FROM k a JOIN k b ON a.subject_id < b.subject_id)
SELECT (SELECT count(*) FROM k) AS n_train, (SELECT count(*) FROM k) AS n_test, round(greatest(0, max(c)), 6) AS max_similarity, count(*) FILTER (c >= 0.3) AS violations, 0.3::DOUBLE AS threshold,
  round(count(*) FILTER (c >= 0.3) / count(*), 6) AS violation_rate, 0.0::DOUBLE AS tolerated_rate, (SELECT count(*) FROM k) AS n_subjects_total FROM p""")
def subject_partition(spark, d):
    e = fx.identities(spark, d).withColumn("subject_id", F.concat(F.lit("p"), (F.col("sample_id").cast("int") % 300).cast("string")))
    return _rounded(I.subject_partition(e, 0.3, 0.0, None, 3))


# --- resampling --------------------------------------------------------------


def _hash_sql(start: str, values: list[str]) -> str:
    """A 32-bit hash folded over values: shifts are coded from 2**32 on, factors from 2**43 on, all else is taken in by xor."""
    steps = [f"({start})::UBIGINT"]
    for v in values:
        steps += [f"({v})::UBIGINT", *(f"{x}::UBIGINT" for x in (2**32 + 16, 2**43 + 0x7FEB352D, 2**32 + 15, 2**43 + 0x846CA68B, 2**32 + 16))]
    return f"list_reduce([{', '.join(steps)}], lambda x, o: CASE WHEN o >= {2**43} THEN (x * (o - {2**43})) & {2**32 - 1} WHEN o >= {2**32} THEN xor(x, x >> (o - {2**32})) ELSE xor(x, o) END)"


def draws_sql(groups: str, by: str, group: str, reps: int, seed: int) -> str:
    """(by, rep, group, w): n draws split down to single groups, range by range, bit by bit."""
    ones = f"coalesce(list_sum(list_transform(range(0, (s[1] + 31) // 32), lambda w: bit_count({_hash_sql('h', ['b[1]', 'w'])} & ((1::UBIGINT << least(s[1] - 32 * w, 32)::UBIGINT) - 1)))), 0)::BIGINT"
    step = f"""CASE WHEN s[1] = 0 OR share & ((2::BIGINT << b[1]) - 1) = 0 THEN [0, s[2]]
      ELSE list_transform([{ones}], lambda one: CASE WHEN (share >> b[1]) & 1 = 1 THEN [one, s[2] + s[1] - one] ELSE [s[1] - one, s[2]] END)[1] END"""
    taken = f"list_reduce(list_concat([[m, 0]], list_transform(range(31, -1, -1), lambda b: [b, 0])), lambda s, b: {step})[2]"
    return f"""(WITH RECURSIVE num AS (SELECT {by}, {group}, row_number() OVER (PARTITION BY {by} ORDER BY {_md5(seed, group)}, {group}) - 1 AS place, count(*) OVER (PARTITION BY {by}) AS n FROM (SELECT DISTINCT {by}, {group} FROM {groups})),
  tree AS (SELECT DISTINCT {by}, rep, 0::BIGINT AS lo, n::BIGINT AS size, n::BIGINT AS m FROM num, range(0, {reps}) t(rep) UNION ALL
    SELECT {by}, rep, unnest([lo, lo + half]), unnest([half, size - half]), unnest([went, m - went]) FROM (SELECT *, {taken} AS went FROM (SELECT *, (half << 32) // size AS share, {_hash_sql(str(seed), ['rep', 'lo', 'size', '0'])} AS h
    FROM (SELECT *, pow(2, floor(log2(size - 1)))::BIGINT AS half FROM tree WHERE size > 1 AND m > 0))))
  SELECT num.{by}, rep, num.{group}, m AS w FROM tree JOIN num ON num.{by} = tree.{by} AND num.place = tree.lo WHERE size = 1 AND m > 0)"""


def weighted_auc_sql(source: str, keys: str) -> str:
    """Weighted AUC by running sums: ``source`` has keys, score, label, w."""
    return f"""(SELECT {keys}, CASE WHEN sum(p) > 0 AND sum(n) > 0 THEN sum(p * (below + n / 2.0)) / (CAST(sum(p) AS DOUBLE) * sum(n)) END AS stat FROM (
  SELECT {keys}, score, p, n, coalesce(sum(n) OVER (PARTITION BY {keys} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (
  SELECT {keys}, score, sum(CASE WHEN label = 1 THEN w ELSE 0 END) AS p, sum(CASE WHEN label = 0 THEN w ELSE 0 END) AS n FROM {source} GROUP BY {keys}, score)) GROUP BY {keys})"""


REPS = 40


@query("M4_bootstrap_ci", f"""
WITH s AS (SELECT detector, subject_id, score, label FROM fx_joined WHERE score IS NOT NULL), d AS {draws_sql('s', 'detector', 'subject_id', REPS, 0)},
x AS (SELECT s.detector, rep, score, label, w FROM s JOIN d ON d.detector = s.detector AND d.subject_id = s.subject_id), a AS {weighted_auc_sql('x', 'detector, rep')}
SELECT detector, round(quantile_cont(stat, 0.025), 6) AS ci_lo, round(quantile_cont(stat, 0.975), 6) AS ci_hi, count(*) AS n_draws, count(*) FILTER (stat IS NULL) AS n_degenerate FROM a GROUP BY 1""", ("fx_joined",))
def bootstrap_ci(spark, d):
    b = B.bootstrap_ci(fx.scored(spark, d), ["detector"], "subject_id", REPS)
    return b.withColumn("ci_lo", r6("ci_lo")).withColumn("ci_hi", r6("ci_hi"))


@query("U4_bootstrap_mean", f"""
WITH s AS (SELECT detector, subject_id, score FROM fx_joined WHERE score IS NOT NULL), d AS {draws_sql('s', 'detector', 'subject_id', REPS, 0)},
a AS (SELECT s.detector, rep, sum(score * w) / sum(w) AS stat FROM s JOIN d ON d.detector = s.detector AND d.subject_id = s.subject_id GROUP BY 1, 2)
SELECT detector, round(quantile_cont(stat, 0.05), 6) AS ci_lo, round(quantile_cont(stat, 0.95), 6) AS ci_hi, count(*) AS n_draws, count(*) FILTER (stat IS NULL) AS n_degenerate FROM a GROUP BY 1""", ("fx_joined",))
def bootstrap_mean(spark, d):
    b = B.bootstrap_ci(fx.scored(spark, d), ["detector"], "subject_id", REPS, alpha=0.1, stat="mean")
    return b.withColumn("ci_lo", r6("ci_lo")).withColumn("ci_hi", r6("ci_hi"))


@query("U4_bootstrap_tpr", f"""
WITH s AS (SELECT 'all' AS k, session_id, score, label FROM fx_frames), d AS {draws_sql('s', 'k', 'session_id', 20, 0)},
x AS (SELECT d.rep, s.session_id, score, label, unnest(range(0, w)) AS copy FROM s JOIN d ON d.session_id = s.session_id), t AS {tpr_sql('x', 'rep', 0.1)}
SELECT round(quantile_cont(tpr, 0.025), 6) AS ci_lo, round(quantile_cont(tpr, 0.975), 6) AS ci_hi, count(*) AS n_draws, count(*) FILTER (tpr IS NULL) AS n_degenerate FROM t""", ("fx_frames",))
def bootstrap_tpr(spark, d):
    b = B.bootstrap_ci(fx.frames(spark, d), [], "session_id", 20, stat="tpr_at_fpr", fpr=0.1)
    return b.withColumn("ci_lo", r6("ci_lo")).withColumn("ci_hi", r6("ci_hi"))


@query("M5_paired_delta_ci", f"""
WITH s AS (SELECT 'all' AS k, subject_id, label, value / (value + 50) AS a, inter_ocular_px / 120 AS b FROM fx_records), d AS {draws_sql('s', 'k', 'subject_id', REPS, 0)},
x AS (SELECT 0 AS arm, rep, a AS score, label, w FROM s JOIN d ON d.subject_id = s.subject_id UNION ALL SELECT 1, rep, b, label, w FROM s JOIN d ON d.subject_id = s.subject_id),
o AS (SELECT 0 AS arm, a AS score, label, 1 AS w FROM s UNION ALL SELECT 1, b, label, 1 FROM s), p AS {weighted_auc_sql('o', 'arm')},
r AS (SELECT rep, max(CASE WHEN arm = 1 THEN stat END) - max(CASE WHEN arm = 0 THEN stat END) AS stat FROM {weighted_auc_sql('x', 'arm, rep')} GROUP BY 1)
SELECT round((SELECT stat FROM p WHERE arm = 0), 6) AS baseline_auc, round((SELECT stat FROM p WHERE arm = 1), 6) AS candidate_auc, round((SELECT stat FROM p WHERE arm = 1) - (SELECT stat FROM p WHERE arm = 0), 6) AS delta,
  round(quantile_cont(stat, 0.025), 6) AS ci_lo, round(quantile_cont(stat, 0.975), 6) AS ci_hi, count(*) AS n_draws, count(*) FILTER (stat IS NULL) AS n_degenerate FROM r""", ("fx_records",))
def paired_delta_ci(spark, d):
    r = fx.records(spark, d).select("subject_id", "label", (F.col("value") / (F.col("value") + 50)).alias("a"), (F.col("inter_ocular_px") / 120).alias("b"))
    p = B.paired_delta_ci(r, [], "subject_id", "a", "b", REPS)
    return p.select(*[r6(c).alias(c) for c in ("baseline_auc", "candidate_auc", "delta", "ci_lo", "ci_hi")], "n_draws", "n_degenerate")


@query("M6_permuted_labels", """
WITH x AS (SELECT draw, sample_id, row_number() OVER (PARTITION BY draw ORDER BY md5(concat_ws('|', '12', draw || '|' || sample_id)), draw || '|' || sample_id) AS rk FROM fx_docs, range(0, 6) t(draw))
SELECT CAST(draw AS INTEGER) AS draw, sample_id, CASE WHEN rk <= (SELECT sum(label) FROM fx_docs) THEN 1 ELSE 0 END AS label FROM x""", ("fx_docs",))
def permuted_labels(spark, d):
    return B.permuted_labels(fx.docs(spark, d), "sample_id", "label", 6, 12)


@query("M7_permutation_p", """
WITH n AS (SELECT l_returnflag AS k, l_suppkey, CASE WHEN l_suppkey % 9 <> 0 THEN avg(l_discount) * 10 END AS stat FROM lineitem GROUP BY 1, 2), o AS (SELECT l_returnflag AS k, 0.5 + avg(l_tax) / 4 AS observed FROM lineitem GROUP BY 1)
SELECT n.k, round(max(observed), 6) AS observed, round(min(stat), 6) AS null_lo, round(max(stat), 6) AS null_hi, count(*) AS n_null,
  round((count(*) FILTER (abs(stat - 0.5) >= abs(observed - 0.5)) + 1) / (count(*) + 1), 6) AS p FROM n JOIN o ON o.k = n.k GROUP BY 1""")
def permutation_p(spark, d):
    li = fx.table(spark, d, "lineitem").withColumn("k", F.col("l_returnflag"))
    n = li.groupBy("k", "l_suppkey").agg((F.avg("l_discount") * 10).alias("s")).withColumn("stat", F.when(F.col("l_suppkey") % 9 != 0, F.col("s")))
    o = li.groupBy("k").agg((0.5 + F.avg("l_tax") / 4).alias("observed"))
    p = B.permutation_p(n, o, ["k"])
    return p.select("k", r6("observed").alias("observed"), r6("null_lo").alias("null_lo"), r6("null_hi").alias("null_hi"), "n_null", r6("p").alias("p"))


# --- fold metrics ------------------------------------------------------------

_FOLD_SCORES = f"{_FOLDS}, fs AS (SELECT a.fold, s.detector, a.fold || '/' || s.detector AS fd, s.sample_id, s.score, a.label, s.subject_id FROM asg a JOIN fx_joined s ON s.sample_id = a.sample_id WHERE side = 'test')"


def fold_scores(spark, d):
    return fx.scored(spark, d).drop("label").join(assignments(spark, d).where(F.col("side") == "test"), "sample_id")


@query("S14_fold_scores", f"WITH {_FOLD_SCORES} SELECT fold, detector, sample_id, subject_id, label, round(score, 6) AS score FROM fs", ("fx_joined",))
def fold_score_rows(spark, d):
    path = scratch_path(spark, "folds")
    sinks.write_fold_scores(fold_scores(spark, d), path)
    s = sinks.read_fold_scores(spark, path)
    return s.select("fold", "detector", "sample_id", "subject_id", "label", r6("score").alias("score"))


@query("M18_fold_report", f"""
WITH {_FOLD_SCORES}, a AS {auc_sql('fs', 'fd')}, t AS {tpr_sql('fs', 'fd', 0.01)}, dr AS (SELECT fold, count(*) FILTER (side = 'dropped') AS n_dropped FROM asg GROUP BY 1),
h AS (SELECT fd, fold, detector, count(*) AS n, avg(CASE WHEN score IS NULL THEN 1.0 ELSE 0.0 END) AS ab FROM fs GROUP BY 1, 2, 3)
SELECT h.fold, h.detector, h.n, round(ab, 6) AS abstention_rate, round(auc, 6) AS auc, round(t.tpr, 6) AS tpr_at_1pct, n_dropped
FROM h LEFT JOIN a ON a.fd = h.fd LEFT JOIN t ON t.fd = h.fd JOIN dr ON dr.fold = h.fold""", ("fx_joined",))
def fold_report(spark, d):
    a = assignments(spark, d)
    s = fx.scored(spark, d).drop("label").join(a.select("sample_id", "label").distinct(), "sample_id")
    r = M.fold_report(s, a)
    return r.select("fold", "detector", "n", r6("abstention_rate").alias("abstention_rate"), r6("auc").alias("auc"), r6("tpr_at_1pct").alias("tpr_at_1pct"), "n_dropped")


@query("M19_worst_fold", f"""
WITH {_FOLD_SCORES}, a AS (SELECT split_part(fd, '/', 1) AS fold, split_part(fd, '/', 2) AS detector, auc FROM {auc_sql('fs', 'fd')})
SELECT detector, round(min(auc), 6) AS worst_auc, arg_min(fold, auc) AS worst_fold FROM a GROUP BY 1""", ("fx_joined",))
def worst_fold(spark, d):
    w = M.worst_fold(auc(fold_scores(spark, d), ["fold", "detector"]))
    return w.withColumn("worst_auc", r6("worst_auc"))


@query("M20_fold_intervals", f"""
WITH {_FOLD_SCORES}, s AS (SELECT fd, subject_id, score, label FROM fs WHERE score IS NOT NULL), d AS {draws_sql('s', 'fd', 'subject_id', 20, 0)},
x AS (SELECT s.fd, rep, score, label, w FROM s JOIN d ON d.fd = s.fd AND d.subject_id = s.subject_id), a AS {weighted_auc_sql('x', 'fd, rep')}, p AS {auc_sql('fs', 'fd')}
SELECT split_part(a.fd, '/', 1) AS fold, split_part(a.fd, '/', 2) AS detector, round(max(auc), 6) AS auc, max(n_pos) AS n_pos, max(n_neg) AS n_neg, round(quantile_cont(stat, 0.025), 6) AS ci_lo, round(quantile_cont(stat, 0.975), 6) AS ci_hi FROM a JOIN p ON p.fd = a.fd GROUP BY a.fd""", ("fx_joined",))
def fold_intervals(spark, d):
    s = fold_scores(spark, d)
    j = auc(s, ["fold", "detector"]).join(B.bootstrap_ci(s, ["fold", "detector"], "subject_id", 20), ["fold", "detector"])
    return j.select("fold", "detector", r6("auc").alias("auc"), "n_pos", "n_neg", r6("ci_lo").alias("ci_lo"), r6("ci_hi").alias("ci_hi"))
