"""Model-fitting queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from assayer import fixtures as fx
from assayer.functions.scalar import exact_mean
from assayer.operators import fit as L
from assayer.operators import resample as B
from assayer.operators import splits as P
from assayer.plans.catalog.metrics import auc_sql, ece_sql, r6
from assayer.plans.catalog.registry import query
from assayer.plans.catalog.selection import _md5
from assayer.plans.catalog.splits import _MASKS, _SERPENT, draws_sql, weighted_auc_sql

NEWTON_STEPS = 12


def newton_sql(rows: str, key: str, w: str = "1.0") -> str:
    """One-feature regularised logistic regression by unrolled Newton steps."""
    steps = [f"b0 AS (SELECT DISTINCT {key} AS k, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM {rows})"]
    for i in range(NEWTON_STEPS):
        steps.append(f"""s{i} AS (SELECT k, any_value(a) AS a, any_value(b) AS b, sum(w * (p - y)) AS ga, sum(w * (p - y) * x) + any_value(b) AS gb, sum(w * p * (1 - p)) AS haa, sum(w * p * (1 - p) * x) AS hab, sum(w * p * (1 - p) * x * x) + 1 AS hbb
  FROM (SELECT b{i}.k, a, b, r.x, r.y, {w} AS w, 1 / (1 + exp(-(a + b * r.x))) AS p FROM {rows} r JOIN b{i} ON b{i}.k = r.{key}) GROUP BY k),
b{i + 1} AS (SELECT k, a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab) AS a, b - (haa * gb - hab * ga) / (haa * hbb - hab * hab) AS b FROM s{i})""")
    return ",\n".join(steps)


def features(spark, d):
    """One informative feature, so every fit below has a plain SQL twin."""
    return fx.records(spark, d).withColumn("x", F.array(F.col("value") / 50 + F.when(F.col("generator") == "error", 0.4).otherwise(0.0)))


_X = "value / 50 + CASE WHEN generator = 'error' THEN 0.4 ELSE 0 END"


@query("L1_logistic_fits", f"""
WITH r AS (SELECT l_returnflag AS k, l_quantity / 50 AS x, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS y FROM lineitem), {newton_sql('r', 'k')}
SELECT k AS problem, round(a, 5) + 0.0 AS intercept, round(b, 5) + 0.0 AS coef FROM b{NEWTON_STEPS}""")
def logistic_fits(spark, d):
    li = fx.table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("problem"), "l_quantity", (F.col("l_linestatus") == "O").cast("int").alias("y")).agg(F.count(F.lit(1)).alias("w"))
    m = L.fit_logistic(li.select("problem", F.array(F.col("l_quantity") / 50).alias("x"), "y", "w"), 1)
    return m.select("problem", (F.round("intercept", 5) + 0.0).alias("intercept"), (F.round(F.get("coef", F.lit(0)), 5) + 0.0).alias("coef"))


@query("L2_calibration_eligibility", """
SELECT detector, band, count(*) AS n, round(avg(label), 6) AS prior, CASE WHEN count(*) < 20 THEN 'too_few' WHEN min(label) = max(label) THEN 'one_class' ELSE 'ok' END AS status
FROM fx_joined WHERE score IS NOT NULL GROUP BY 1, 2""", ("fx_joined",))
def calibration_eligibility(spark, d):
    return L.calibration_eligibility(fx.scored(spark, d)).withColumn("prior", r6("prior"))


@query("L2_platt_curves", f"""
WITH e AS (SELECT detector, band, avg(label) AS prior FROM fx_joined WHERE score IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 20 AND min(label) <> max(label)),
r AS (SELECT s.detector || '/' || s.band AS k, score AS x, label AS y FROM fx_joined s JOIN e ON e.detector = s.detector AND e.band = s.band WHERE score IS NOT NULL), {newton_sql('r', 'k')}
SELECT e.detector, e.band, round(b, 5) + 0.0 AS coef, round(a, 5) + 0.0 AS intercept, round(prior, 6) AS prior FROM e JOIN b{NEWTON_STEPS} f ON f.k = e.detector || '/' || e.band""", ("fx_joined",))
def platt_curves(spark, d):
    c = L.fit_curves(fx.scored(spark, d))
    return c.select("detector", "band", (F.round("coef", 5) + 0.0).alias("coef"), (F.round("intercept", 5) + 0.0).alias("intercept"), r6("prior").alias("prior"))


@query("L3_balanced_head", f"""
WITH m AS (SELECT avg({_X}) AS mu, stddev_pop({_X}) AS sd, count(*) AS n, sum(label) AS n1 FROM fx_records),
r AS (SELECT 'h' AS k, ({_X} - mu) / sd AS x, label AS y, n / (2.0 * CASE WHEN label = 1 THEN n1 ELSE n - n1 END) AS cw FROM fx_records, m), {newton_sql('r', 'k', 'r.cw')}
SELECT round(a, 5) + 0.0 AS intercept, round(b, 5) + 0.0 AS coef, round(mu, 5) AS mean, round(sd, 5) AS scale FROM b{NEWTON_STEPS}, m""", ("fx_records",))
def balanced_head(spark, d):
    h = L.fit_head(features(spark, d), "x", 1, balanced=True)
    only = lambda c: (F.round(F.get(c, F.lit(0)), 5) + 0.0).alias(c)
    return h.select((F.round("intercept", 5) + 0.0).alias("intercept"), only("coef"), only("mean"), only("scale"))


@query("L4_out_of_fold_scores", f"""
WITH g AS (SELECT subject_id, count(*) AS n_rows FROM fx_records GROUP BY 1), o AS (SELECT *, (row_number() OVER (ORDER BY {_SERPENT.format(md5=_md5(0, 'subject_id'))}, subject_id) - 1) % 10 AS pos FROM g),
f AS (SELECT r.sample_id, r.subject_id, r.label, {_X} AS v, CAST(CASE WHEN pos < 5 THEN pos ELSE 9 - pos END AS INTEGER) AS fold FROM fx_records r JOIN o ON o.subject_id = r.subject_id),
t AS (SELECT p.k, v, label FROM f, range(0, 5) p(k) WHERE fold <> p.k), st AS (SELECT k, avg(v) AS mu, stddev_pop(v) AS sd FROM t GROUP BY 1),
r AS (SELECT t.k, (v - mu) / sd AS x, label AS y FROM t JOIN st ON st.k = t.k), {newton_sql('r', 'k')}
SELECT sample_id, subject_id, label, fold, round(1 / (1 + exp(-(a + b * (v - mu) / sd))), 5) AS score FROM f JOIN st ON st.k = fold JOIN b{NEWTON_STEPS} n ON n.k = fold""", ("fx_records",))
def out_of_fold_scores(spark, d):
    return L.out_of_fold_scores(features(spark, d), "x", 1, "subject_id", "sample_id").withColumn("score", F.round("score", 5))


@query("L5_family_refits", f"""
WITH {_MASKS}, r AS (SELECT held AS k, {_X} AS x, label AS y FROM m WHERE side = 'train'), {newton_sql('r', 'k')}
SELECT held, sample_id, label, round(1 / (1 + exp(-(a + b * ({_X})))), 5) AS score FROM m JOIN b{NEWTON_STEPS} n ON n.k = held WHERE side = 'test'""", ("fx_records",))
def family_refits(spark, d):
    s = L.refit_folds(features(spark, d), "x", 1, "subject_id", "sample_id", 5)
    return s.select("held", "sample_id", "label", F.round("score", 5).alias("score"))


_CONTROL = f"""
g AS (SELECT "domain", count(*) AS n_rows, CASE WHEN min(label) <> max(label) THEN 'mixed' ELSE CAST(min(label) AS VARCHAR) END AS kind FROM fx_docs GROUP BY 1),
rk AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY {_SERPENT.format(md5=_md5(1, '"domain"'))}, "domain") AS rk FROM g),
sp AS (SELECT d.sample_id, d."domain" AS dom, d.score / 1000 AS x, d.label, CASE WHEN ((rk - 1) % 4 IN (0, 3)) = (kind <> 'mixed') THEN 'fit' ELSE 'test' END AS side FROM fx_docs d JOIN rk ON rk."domain" = d."domain"),
tr AS (SELECT * FROM sp WHERE side = 'fit'), te AS (SELECT * FROM sp WHERE side = 'test'),
pl AS (SELECT draw, x, CASE WHEN row_number() OVER (PARTITION BY draw ORDER BY md5(concat_ws('|', '1', draw || '|' || sample_id)), draw || '|' || sample_id) <= (SELECT sum(label) FROM tr) THEN 1 ELSE 0 END AS y FROM tr, range(0, 8) t(draw)),
r AS (SELECT 'o' AS k, x, label AS y FROM tr UNION ALL SELECT CAST(draw AS VARCHAR) AS k, x, y FROM pl), {newton_sql('r', 'k')},
s AS (SELECT n.k, dom, 1 / (1 + exp(-(a + b * x))) AS score, label FROM te, b{NEWTON_STEPS} n), p AS {auc_sql('s', 'k')}"""


def _control_docs(spark, d):
    return fx.docs(spark, d).withColumn("x", F.array(F.col("score") / 1000))


@query("L6_shortcut_control", f"""
WITH {_CONTROL}, so AS (SELECT * FROM s WHERE k = 'o'), d AS {draws_sql('so', 'k', 'dom', 40, 1)},
w AS (SELECT rep, score, label, w FROM so JOIN d ON d.dom = so.dom), q AS {weighted_auc_sql('w', 'rep')}, o AS (SELECT auc AS v FROM p WHERE k = 'o'), n AS (SELECT auc FROM p WHERE k <> 'o')
SELECT (SELECT round(v, 5) FROM o) AS auc, (SELECT round(quantile_cont(stat, 0.025), 5) FROM q) AS ci_lo, (SELECT round(quantile_cont(stat, 0.975), 5) FROM q) AS ci_hi,
  (SELECT round(min(auc), 5) FROM n) AS null_lo, (SELECT round(max(auc), 5) FROM n) AS null_hi,
  (SELECT round((count(*) FILTER (abs(auc - 0.5) >= abs(v - 0.5)) + 1) / (count(*) + 1), 5) FROM n, o) AS p,
  (SELECT count(*) FROM tr) AS n_fit, (SELECT count(*) FROM te) AS n_test""", ("fx_docs",))
def shortcut_control(spark, d):
    c = L.run_control(_control_docs(spark, d), "x", 1, "domain", "sample_id", seed=1, n_null=8, replicates=40)
    return c.select(*[F.round(k, 5).alias(k) for k in ("auc", "ci_lo", "ci_hi", "null_lo", "null_hi", "p")], "n_fit", "n_test")


@query("U5_refitted_null", f"WITH {_CONTROL} SELECT CAST(k AS INTEGER) AS draw, round(auc, 5) AS stat FROM p WHERE k <> 'o'", ("fx_docs",))
def refitted_null(spark, d):
    split = P.class_aware_split(_control_docs(spark, d).select("sample_id", "domain", "label", "x"), "domain", "label", 1)
    null = L.permutation_null(split.where("side = 'fit'"), split.where("side = 'test'"), 1, "sample_id", 8, 1)
    return null.withColumn("stat", F.round("stat", 5))


@query("L7_constant_control", """
SELECT CASE WHEN stddev_pop(length(o_orderstatus)) = 0 THEN 0.5::DOUBLE END AS auc, CAST(NULL AS DOUBLE) AS ci_lo, CAST(NULL AS DOUBLE) AS ci_hi, stddev_pop(length(o_orderstatus)) = 0 AS constant
FROM lineitem JOIN orders ON o_orderkey = l_orderkey""")
def constant_control(spark, d):
    """The length of the order status, which is one letter in every row of the table."""
    li, o = fx.table(spark, d, "lineitem"), fx.table(spark, d, "orders")
    r = li.join(o, li.l_orderkey == o.o_orderkey).select(F.col("l_suppkey").cast("string").alias("subject_id"), (F.col("l_linestatus") == "O").cast("int").alias("label"), F.array(F.length("o_orderstatus").cast("double")).alias("x"))
    return L.in_sample_control(r, "x", 1, "subject_id")


@query("L3_wide_head", """
WITH x AS (SELECT unnest(range(0, 64)) AS feature, unnest(embedding)::DOUBLE AS v FROM embeddings)
SELECT CAST(feature AS INTEGER) AS feature, round(avg(v), 6) + 0.0 AS mean, round(stddev_pop(v), 6) AS scale, 0.0::DOUBLE AS slope FROM x GROUP BY 1""")
def wide_head(spark, d):
    """64 features fitted at once: mean and spread of each, and the slope of the objective there, which is zero at the fit."""
    e = fx.table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"), (F.col("label") >= 5).cast("int").alias("label"))
    h = L.fit_head(e, "x", 64)
    z = F.zip_with(F.zip_with("x", "mean", lambda v, m: v - m), "scale", lambda v, s: v / s)
    scored = e.crossJoin(F.broadcast(h)).select("label", z.alias("z"), "mean", "scale", "coef", "intercept")
    miss = L.probability(F.col("z"), F.col("coef"), F.col("intercept")) - F.col("label")
    each = scored.select(miss.alias("e"), F.posexplode(F.arrays_zip("z", "mean", "scale", "coef")).alias("feature", "c"))
    g = each.groupBy("feature").agg(F.first("c.mean").alias("mean"), F.first("c.scale").alias("scale"), (F.sum(F.col("e") * F.col("c.z")) + F.first("c.coef")).alias("slope"))
    return g.select("feature", (F.round("mean", 6) + 0.0).alias("mean"), F.round("scale", 6).alias("scale"), (F.round("slope", 4) + 0.0).alias("slope"))


@query("L7_in_sample_control", f"""
WITH r AS (SELECT 'all' AS k, subject_id, {_X} AS x, label AS y FROM fx_records), {newton_sql('r', 'k')},
s AS (SELECT r.k, subject_id, 1 / (1 + exp(-(a + b * x))) AS score, y AS label FROM r JOIN b{NEWTON_STEPS} n ON n.k = r.k), d AS {draws_sql('s', 'k', 'subject_id', 20, 0)},
x AS (SELECT rep, score, label, w FROM s JOIN d ON d.subject_id = s.subject_id), q AS {weighted_auc_sql('x', 'rep')}, p AS {auc_sql('s', 'k')}
SELECT round(max(auc), 5) AS auc, round(quantile_cont(stat, 0.025), 5) AS ci_lo, round(quantile_cont(stat, 0.975), 5) AS ci_hi, false AS constant FROM p, q""", ("fx_records",))
def in_sample_control(spark, d):
    c = L.in_sample_control(features(spark, d), "x", 1, "subject_id", 20)
    return c.select(*[F.round(k, 5).alias(k) for k in ("auc", "ci_lo", "ci_hi")], "constant")


@query("L8_family_null", f"""
WITH {_MASKS}, tr AS (SELECT sample_id, {_X} AS x, label FROM m WHERE held = 'error' AND side = 'train'), te AS (SELECT {_X} AS x, label FROM m WHERE held = 'error' AND side = 'test'),
pl AS (SELECT draw, x, CASE WHEN row_number() OVER (PARTITION BY draw ORDER BY md5(concat_ws('|', '5', draw || '|' || sample_id)), draw || '|' || sample_id) <= (SELECT sum(label) FROM tr) THEN 1 ELSE 0 END AS y FROM tr, range(0, 6) t(draw)),
r AS (SELECT draw AS k, x, y FROM pl), {newton_sql('r', 'k')},
s AS (SELECT CAST(n.k AS INTEGER) AS draw, 1 / (1 + exp(-(a + b * x))) AS score, label FROM te, b{NEWTON_STEPS} n)
SELECT draw, round(auc, 5) AS stat FROM {auc_sql('s', 'draw')}""", ("fx_records",))
def family_null(spark, d):
    return L.null_for_family(features(spark, d), "x", 1, "subject_id", "sample_id", "error", 6, 5).withColumn("stat", F.round("stat", 5))


@query("L9_null_verdict", """
WITH a AS (SELECT l_suppkey AS run, avg(l_discount) * 14 AS obs, 0.62 + avg(l_tax) AS lo, 0.66 + avg(l_tax) AS hi FROM lineitem GROUP BY 1)
SELECT run, CASE WHEN run % 8 = 0 THEN NULL WHEN obs >= lo AND obs <= hi THEN 'inside_null' WHEN obs < 0.7 THEN 'outside_below_floor' ELSE 'outside_above_floor' END AS verdict FROM a""")
def null_verdict(spark, d):
    """Means are exact; only where one lies on a threshold do the last bits of a sum of doubles decide, as in the SQL, which adds in row order."""
    li = fx.table(spark, d, "lineitem")
    rows = li.select(F.col("l_suppkey").alias("run"), "l_discount", "l_tax", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    bounds = lambda di, tx: ((di * 14).alias("o"), (0.62 + tx).alias("lo"), (0.66 + tx).alias("hi"))
    g = rows.groupBy("run").agg(F.count(F.lit(1)).alias("n"), exact_mean("l_discount").alias("di"), exact_mean("l_tax").alias("tx")).select("run", "n", "di", "tx", *bounds(F.col("di"), F.col("tx")))
    off = F.least(*[F.abs(F.col("o") - edge) for edge in (F.col("lo"), F.col("hi"), F.lit(0.7))])
    tied = g.where(off <= (1 + F.abs("o")) * (1e-12 + 4e-16 * F.col("n"))).select("run")
    # by a hash of the run: an exchange by the run itself is left to the join, whose rows stay where they are if it is broadcast
    ordered = rows.join(tied, "run", "left_semi").repartition(F.xxhash64("run")).sortWithinPartitions("run", "file", "at")
    summed = ordered.select("run", "l_discount", "l_tax").mapInArrow(_sums_in_order, "run long, n_di long, n_tx long, di_sum double, tx_sum double")
    summed = summed.select("run", (F.col("di_sum") / F.col("n_di")).alias("di_row"), (F.col("tx_sum") / F.col("n_tx")).alias("tx_row"))
    a = g.join(summed, "run", "left").select("run", *bounds(F.coalesce("di_row", "di"), F.coalesce("tx_row", "tx")))
    obs = F.when(F.col("run") % 8 != 0, F.col("o"))
    return a.select("run", B.null_verdict(obs, F.col("lo"), F.col("hi"), 0.7).alias("verdict"))


def _sums_in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by run: of each run the counts and the sums of the other two columns, one row added after the other."""

    def told(run, n, total):
        return pa.RecordBatch.from_arrays([pa.array([run], pa.int64()), *(pa.array([int(x)]) for x in n), *(pa.array([float(x)]) for x in total)], ["run", "n_di", "n_tx", "di_sum", "tx_sum"])

    run, n, total = None, np.zeros(2, np.int64), np.zeros(2)
    for b in batches:
        if not b.num_rows:
            continue
        key = b.column(0).to_numpy(zero_copy_only=False)
        v = np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in (1, 2)], axis=1)
        there = ~np.isnan(v)
        cuts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if run is not None and key[lo] != run:
                yield told(run, n, total)
                n, total = np.zeros(2, np.int64), np.zeros(2)
            run = int(key[lo])
            n = n + there[lo:hi].sum(axis=0)
            total = np.add.accumulate(np.vstack([total, np.where(there[lo:hi], v[lo:hi], 0.0)]), axis=0)[-1]
    if run is not None:
        yield told(run, n, total)


@query("L10_calibration_report", f"""
WITH s AS (SELECT * FROM fx_joined WHERE score IS NOT NULL),
g AS (SELECT subject_id, row_number() OVER (ORDER BY {_md5(2, 'subject_id')}, subject_id) <= greatest(1, round_even(count(*) OVER () * 0.3, 0)) AS is_test FROM (SELECT DISTINCT subject_id FROM s)),
sp AS (SELECT s.detector, s.band, s.score, s.label, is_test FROM s JOIN g ON g.subject_id = s.subject_id),
e AS (SELECT detector, band FROM sp WHERE NOT is_test GROUP BY 1, 2 HAVING count(*) >= 20 AND min(label) <> max(label)),
r AS (SELECT sp.detector || '/' || sp.band AS k, score AS x, label AS y FROM sp JOIN e ON e.detector = sp.detector AND e.band = sp.band WHERE NOT is_test), {newton_sql('r', 'k')},
j AS (SELECT detector, label, 1 / (1 + exp(-(a + b * score))) AS score FROM sp JOIN b{NEWTON_STEPS} n ON n.k = detector || '/' || band WHERE is_test), u AS {auc_sql('j', 'detector')}, c AS {ece_sql('j', 'detector')},
fb AS (SELECT band, count(*) AS n FROM fx_banded GROUP BY 1), z AS (SELECT detector, count(*) FILTER (NOT is_test) AS n_fit, count(DISTINCT band) AS bands_seen FROM sp GROUP BY 1),
q AS (SELECT detector, count(*) AS bands_fitted, sum(n) AS covered FROM e JOIN fb ON fb.band = e.band GROUP BY 1)
SELECT z.detector, n_fit, n_pos + n_neg AS n_holdout, round(auc, 5) AS auc, round(ece, 5) AS ece, bands_fitted, bands_seen, round(covered / (SELECT sum(n) FROM fb), 6) AS fraction_covered
FROM z JOIN q ON q.detector = z.detector JOIN u ON u.detector = z.detector JOIN c ON c.detector = z.detector""", ("fx_joined",))
def calibration_report(spark, d):
    bands = fx.banded(spark, d).groupBy("band").agg(F.count(F.lit(1)).alias("n"))
    r = L.calibration_report(fx.scored(spark, d), "subject_id", 0.3, 2, bands)
    return r.select("detector", "n_fit", "n_holdout", F.round("auc", 5).alias("auc"), F.round("ece", 5).alias("ece"), "bands_fitted", "bands_seen", r6("fraction_covered").alias("fraction_covered"))
