"""Many small logistic regressions fitted together.

A *problem* is one regression: a band, a fold, a shuffle. Rows are long
(problem, x, y, w) and stay distributed; each Newton step is one aggregation
that yields a gradient and a Hessian per problem, solved per problem on the
executors. Only the coefficient table travels between steps, through a
checkpoint in the shared folder, so the lineage never grows and a lost executor
repeats one step.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer import schema as K
from assayer.functions.scalar import dot, finite
from assayer.operators import resample as B
from assayer.operators import splits as P
from assayer.operators.curve import auc
from assayer.operators.metrics import ece, standardiser
from assayer.operators.ranking import null_safe_join
from assayer.session import cut_lineage, shared

TOLERANCE = 1e-8
MAX_STEPS = 1000
SPREAD = 32  # partial sums of one problem meet in this many tasks before the last
NARROW = 4  # with so few features rows are likely to be equal and are counted first
PARTIAL = "problem string, part int, sums array<double>"
PARTIAL_ARROW = pa.schema([("problem", pa.string()), ("part", pa.int32()), ("sums", pa.list_(pa.float64()))])
STATE = "problem string, beta array<double>, best array<double>, loss double, step double"


def _partial_sums(width: int) -> Callable:
    """Per task and problem one array: loss, gradient and upper Hessian."""
    d = width + 1
    upper = np.triu_indices(d)

    def run(batches):
        acc: dict[str, np.ndarray] = {}
        for batch in batches:
            table = pa.table(batch).combine_chunks().sort_by("problem")
            names, sizes = (c.to_pylist() for c in pc.value_counts(table.column("problem").combine_chunks()).flatten())
            at = 0
            for problem, n in zip(names, sizes, strict=True):
                g, at = table.slice(at, n), at + n
                x = np.column_stack([np.ones(n), g.column("x").combine_chunks().flatten().to_numpy().reshape(n, width)])
                beta = np.asarray(g.column("beta")[0].as_py(), dtype=float)
                y, w = g.column("y").to_numpy(), g.column("w").to_numpy()
                z = x @ beta
                p = 1.0 / (1.0 + np.exp(-np.clip(z, -700, 700)))
                loss = float((w * (np.logaddexp(0.0, z) - y * z)).sum())
                grad = x.T @ (w * (p - y))
                hess = (x * (w * p * (1.0 - p))[:, None]).T @ x
                part = np.concatenate([[loss], grad, hess[upper]])
                acc[problem] = acc[problem] + part if problem in acc else part
        here = TaskContext.get().partitionId() % SPREAD
        for problem, part in acc.items():
            yield pa.RecordBatch.from_pydict({"problem": [problem], "part": [here], "sums": [part]}, schema=PARTIAL_ARROW)

    return run


def _added(keys: list[str]) -> Callable:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.sum(np.stack(pdf["sums"].to_numpy()), axis=0)
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "sums": [total]})

    return run


def _newton(width: int, c: float) -> Callable:
    """One damped Newton step: a step that raised the loss is halved instead."""
    d = width + 1
    upper = np.triu_indices(d)
    ridge = np.r_[0.0, np.ones(width)] / c

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in pdf.itertuples(index=False):
            v, beta = np.asarray(r.sums, dtype=float), np.asarray(r.beta, dtype=float)
            loss = v[0] + 0.5 * float((ridge * beta**2).sum())
            if r.loss is not None and np.isfinite(r.loss) and loss > r.loss + 1e-9 * (1 + abs(r.loss)):
                best = np.asarray(r.best, dtype=float)
                new, kept, kept_loss = (best + beta) / 2, best, r.loss
            else:
                h = np.zeros((d, d))
                h[upper] = v[1 + d :]
                h = h + np.triu(h, 1).T + np.diag(ridge)
                new = beta - np.linalg.lstsq(h, v[1 : 1 + d] + ridge * beta, rcond=None)[0]
                kept, kept_loss = beta, loss
            out.append((r.problem, new.tolist(), kept.tolist(), kept_loss, float(np.abs(new - beta).max())))
        return pd.DataFrame(out, columns=["problem", "beta", "best", "loss", "step"])

    def run(batches):
        for pdf in batches:
            yield step(pdf)

    return run


def fit_logistic(rows: DataFrame, width: int, c: float = 1.0, max_iter: int = MAX_STEPS) -> DataFrame:
    """(problem, intercept, coef, converged): L2 on the weights, none on the intercept.

    ``rows`` is (problem, x array<double>, y, w). The objective is
    ``c * sum(w * log loss) + |coef|^2 / 2``. A problem still moving after
    ``max_iter`` steps is refused by name; features or weights that are not
    finite are refused before the first step. Steps stop for a problem once it
    stands still, and only the others are summed again. Coefficients go to the
    rows, which stay where they are: all rows may belong to one problem.
    """
    rows = rows.select("problem", F.col("x").cast("array<double>").alias("x"), F.col("y").cast("double").alias("y"), F.col("w").cast("double").alias("w"))
    rows = shared(rows.groupBy("problem", "x", "y").agg(F.sum("w").alias("w")) if width <= NARROW else rows)
    refuse_unmeasured(rows, "x")
    zero = F.array_repeat(F.lit(0.0), width + 1)
    state = cut_lineage(rows.select("problem").distinct().select(
        "problem", zero.alias("beta"), zero.alias("best"), F.lit(None).cast("double").alias("loss"), F.lit(None).cast("double").alias("step")))
    moving = F.col("step").isNull() | (F.col("step") >= TOLERANCE)
    for _ in range(max_iter):
        live = state.where(moving)
        parts = rows.join(F.broadcast(live.select("problem", "beta")), "problem").select("problem", "x", "y", "w", "beta").mapInArrow(_partial_sums(width), PARTIAL)
        parts = parts.groupBy("problem", "part").applyInPandas(_added(["problem", "part"]), PARTIAL)
        packed = parts.groupBy("problem").applyInPandas(_added(["problem"]), "problem string, sums array<double>")
        stepped = packed.join(live.select("problem", "beta", "best", "loss"), "problem").mapInPandas(_newton(width, c), STATE)
        state = cut_lineage(stepped.unionByName(state.where(~moving)))
        if state.where(moving).isEmpty():
            break
    stuck = state.where(moving).agg(F.count(F.lit(1)).alias("n"), F.min("problem").alias("first")).first()
    rows.unpersist()
    if stuck.n:
        raise ValueError(f"{stuck.n} fit(s) did not converge in {max_iter} steps, among them {stuck.first!r}")
    return state.select("problem", F.get("beta", F.lit(0)).alias("intercept"), F.slice("beta", 2, width).alias("coef"), F.lit(True).alias("converged"))


def refuse_unmeasured(df: DataFrame, features: str) -> DataFrame:
    """Features with a NULL, NaN or infinite entry belong in no fit."""
    bad = df.where(F.col(features).isNull() | F.exists(features, lambda v: ~finite(v))).limit(1).count()
    if bad:
        raise ValueError(f"{features!r} holds rows that were measured in part only; drop or complete them before fitting")
    return df


def probability(x: Column, coef: Column, intercept: Column) -> Column:
    """Fitted probability from arrays; the expression does not grow with their width."""
    return 1.0 / (1.0 + F.exp(-(intercept + dot(x, coef))))


def weights(label: Column, n0: Column, n1: Column, balanced: bool) -> Column:
    """``balanced`` gives each class half of the total weight."""
    if not balanced:
        return F.lit(1.0)
    return (n0 + n1) / (2.0 * F.when(label == 1, n1).otherwise(n0))


# --- calibration -------------------------------------------------------------


def calibration_eligibility(scores: DataFrame, by: Sequence[str] = ("detector", "band")) -> DataFrame:
    """Which bands may be fitted, and the prior that will be taken out again."""
    s = scores.where(finite("score"))
    g = s.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("prior"), (F.min("label") != F.max("label")).alias("_two"))
    status = F.when(F.col("n") < K.MIN_FIT_SAMPLES, "too_few").when(~F.col("_two"), "one_class").otherwise("ok")
    return g.select(*by, "n", "prior", status.alias("status"))


def fit_curves(scores: DataFrame, by: Sequence[str] = ("detector", "band")) -> DataFrame:
    """Per-band Platt curves; rows with equal score and label are weighted, not repeated."""
    ok = calibration_eligibility(scores, by).where(F.col("status") == "ok").select(*by, "prior")
    key = F.concat_ws("\u0001", *by)
    cells = scores.where(finite("score")).groupBy(*by, "score", "label").agg(F.count(F.lit(1)).alias("w"))
    rows = cells.join(ok.select(*by), list(by), "left_semi").select(key.alias("problem"), F.array("score").alias("x"), F.col("label").alias("y"), "w")
    fitted = fit_logistic(rows, 1)
    return ok.withColumn("problem", key).join(fitted, "problem").select(
        *by, F.get("coef", F.lit(0)).alias("coef"), "intercept", "prior", F.lit(K.MAX_ABS_LLR).alias("max_abs_llr"),
        F.lit(K.CURVE_FORMAT_VERSION).alias("format_version"))


# --- heads, folds and controls -----------------------------------------------


def _standardise(x: str) -> Column:
    return F.zip_with(F.zip_with(x, "mean", lambda v, m: v - m), "scale", lambda v, s: v / s)


def fit_head(df: DataFrame, features: str, width: int, label: str = "label", balanced: bool = False, c: float = 1.0) -> DataFrame:
    """Standardise and fit one model; one row with mean, scale, coef, intercept."""
    n = df.agg(F.count_if(F.col(label) == 0).alias("n0"), F.count_if(F.col(label) == 1).alias("n1")).collect()[0]
    if not n.n0 or not n.n1:
        raise ValueError(f"cannot fit on one class: {n.n0} real, {n.n1} fake")
    std = shared(standardiser(df, features, width))
    z = null_safe_join(df, std, []).select(
        F.lit("head").alias("problem"), _standardise(features).alias("x"), F.col(label).alias("y"),
        weights(F.col(label), F.lit(float(n.n0)), F.lit(float(n.n1)), balanced).alias("w"))
    return null_safe_join(fit_logistic(z, width, c).drop("problem", "converged"), std, [])


def out_of_fold_scores(df: DataFrame, features: str, width: int, group: str, key: str, k: int = 5, seed: int = 0, c: float = 1.0) -> DataFrame:
    """(key, group, label, fold, score): each row scored by the fold that never saw its group.

    The standardiser and the model are per fold. A fold whose training side has
    one class scores nobody: those rows keep a NULL score.
    """
    folded = shared(P.group_kfold(df.select(key, group, "label", F.col(features).cast("array<double>").alias("_x")), group, k, seed))
    train = folded.select("fold", "_x", "label").withColumn("problem", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).where(F.col("problem") != F.col("fold"))
    usable = train.groupBy("problem").agg((F.min("label") != F.max("label")).alias("_two")).where("_two").select("problem")
    std = shared(standardiser(train.join(usable, "problem"), "_x", width, ["problem"]))
    rows = train.join(std, "problem").select(F.col("problem").cast("string").alias("problem"), _standardise("_x").alias("x"), F.col("label").alias("y"), F.lit(1.0).alias("w"))
    model = fit_logistic(rows, width, c).join(std.withColumn("problem", F.col("problem").cast("string")), "problem")
    test = folded.join(model.withColumn("fold", F.col("problem").cast("int")).drop("problem"), "fold", "left")
    return test.select(key, group, "label", "fold", probability(_standardise("_x"), F.col("coef"), F.col("intercept")).alias("score"))


def refit_folds(df: DataFrame, features: str, width: int, group: str, key: str, seed: int = 0) -> DataFrame:
    """(held, key, group, label, score): one refit per held-out family, scored on
    its doubly disjoint test rows; at least two families are required."""
    masks = shared(P.doubly_disjoint(df.select(key, group, "label", "generator", F.col(features).cast("array<double>").alias("_x")), group, seed))
    ok = shared(P.measurable_families(masks))
    train = masks.where(F.col("side") == "train").join(ok, "held")
    rows = train.select(F.col("held").alias("problem"), F.col("_x").alias("x"), F.col("label").alias("y"), F.lit(1.0).alias("w"))
    model = fit_logistic(rows, width).withColumnRenamed("problem", "held")
    test = masks.where(F.col("side") == "test").join(model, "held")
    return test.select("held", key, group, "label", probability(F.col("_x"), F.col("coef"), F.col("intercept")).alias("score"))


def require_two_families(df: DataFrame) -> None:
    n = df.where(F.col("generator").isNotNull()).select("generator").distinct().limit(2).count()
    if n < 2:
        raise ValueError(f"leave-one-family-out needs at least two families, got {n}")


def null_scores(train: DataFrame, test: DataFrame, width: int, key: str, n: int, seed: int) -> DataFrame:
    """(draw, label, score): models refitted on shuffled training labels, all
    draws in one fit, each scored on the same untouched test rows."""
    lab = B.permuted_labels(train, key, "label", n, seed)
    rows = train.select(key, "x").join(lab, key).select(F.col("draw").cast("string").alias("problem"), "x", F.col("label").alias("y"), F.lit(1.0).alias("w"))
    model = fit_logistic(rows, width)
    model = model.select(F.col("problem").cast("int").alias("draw"), "coef", "intercept")
    scored = test.select("x", "label", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("draw")).join(model, "draw")
    return scored.select("draw", "label", probability(F.col("x"), F.col("coef"), F.col("intercept")).alias("score"))


def permutation_null(train: DataFrame, test: DataFrame, width: int, key: str, n: int = 12, seed: int = 0) -> DataFrame:
    """(draw, stat): transfer AUC of every refit; an undefined one stays NULL."""
    two = train.agg(F.min("label"), F.max("label")).collect()[0]
    if two[0] == two[1]:
        raise ValueError("the training labels hold one class only, so shuffling them gives no null to compare with")
    return auc(null_scores(train, test, width, key, n, seed), ["draw"]).select("draw", F.col("auc").alias("stat"))


def run_control(df: DataFrame, features: str, width: int, group: str, key: str, seed: int = 0, n_null: int = 24, replicates: int = 200) -> DataFrame:
    """Does a shortcut feature alone separate the classes across groups?

    Rows whose features were all unmeasured are dropped, partly measured ones
    are refused, groups are split with
    both classes on both sides, and the real fit is compared with the range of
    fits on shuffled labels.
    """
    x = F.col(features).cast("array<double>")
    kept = df.where(F.exists(x, finite)).select(key, group, "label", x.alias("x"))
    refuse_unmeasured(kept, "x")
    split = shared(P.class_aware_split(kept, group, "label", seed))
    P.require_both_classes(split, "label")
    fit, test = split.where(F.col("side") == "fit"), split.where(F.col("side") == "test")
    model = fit_logistic(fit.select(F.lit("observed").alias("problem"), "x", F.col("label").alias("y"), F.lit(1.0).alias("w")), width)
    scored = shared(null_safe_join(test, model.drop("problem", "converged"), []).select(
        key, group, "label", probability(F.col("x"), F.col("coef"), F.col("intercept")).alias("score")))
    observed = auc(scored).select(F.col("auc").alias("observed"))
    null = B.permutation_p(permutation_null(fit, test, width, key, n_null, seed), observed)
    ci = B.bootstrap_ci(scored, [], group, replicates, seed).select("ci_lo", "ci_hi")
    n = split.agg(F.count_if(F.col("side") == "fit").alias("n_fit"), F.count_if(F.col("side") == "test").alias("n_test"))
    out = null_safe_join(null_safe_join(null, ci, []), n, [])
    return out.select(F.col("observed").alias("auc"), "ci_lo", "ci_hi", "null_lo", "null_hi", "p", "n_fit", "n_test")


def in_sample_control(df: DataFrame, features: str, width: int, group: str, replicates: int = 200) -> DataFrame:
    """The strongest form of a control: fitted and scored on the same rows. A
    feature with no variance is a structural .5, not a measured one."""
    spread = df.agg(*[F.stddev_pop(F.get(features, F.lit(i))).alias(f"s{i}") for i in range(width)]).collect()[0]
    if max(s or 0.0 for s in spread) == 0.0:
        return df.agg(F.lit(0.5).alias("auc"), F.lit(None).cast("double").alias("ci_lo"), F.lit(None).cast("double").alias("ci_hi"), F.lit(True).alias("constant"))
    x = df.select(group, "label", F.col(features).cast("array<double>").alias("x"))
    model = fit_logistic(x.select(F.lit("control").alias("problem"), "x", F.col("label").alias("y"), F.lit(1.0).alias("w")), width)
    scored = shared(null_safe_join(x, model.drop("problem", "converged"), []).select(group, "label", probability(F.col("x"), F.col("coef"), F.col("intercept")).alias("score")))
    ci = B.bootstrap_ci(scored, [], group, replicates, 0)
    return null_safe_join(auc(scored).select("auc"), ci, []).select("auc", "ci_lo", "ci_hi", F.lit(False).alias("constant"))


def null_for_family(df: DataFrame, features: str, width: int, group: str, key: str, held: str, n: int, seed: int = 0) -> DataFrame:
    """The permutation null of one held-out family's fold."""
    masks = shared(P.doubly_disjoint(df.select(key, group, "label", "generator", F.col(features).cast("array<double>").alias("x")), group, seed).where(F.col("held") == held))
    return permutation_null(masks.where(F.col("side") == "train"), masks.where(F.col("side") == "test"), width, key, n, seed)


def calibration_report(scores: DataFrame, group: str, fraction: float, seed: int, frames_by_band: DataFrame) -> DataFrame:
    """Per detector: fit on most subjects, judge the curves on the others."""
    split = shared(P.group_holdout(scores.where(finite("score")), group, fraction, seed))
    curves = shared(fit_curves(split.where(F.col("side") == "train")))
    held = split.where(F.col("side") == "test").join(curves.select("detector", "band", "coef", "intercept"), ["detector", "band"])
    judged = shared(held.select("detector", "label", (1.0 / (1.0 + F.exp(-(F.col("coef") * F.col("score") + F.col("intercept"))))).alias("score")))
    sizes = split.groupBy("detector").agg(F.count_if(F.col("side") == "train").alias("n_fit"), F.countDistinct("band").alias("bands_seen"))
    bands = curves.groupBy("detector").agg(F.count(F.lit(1)).alias("bands_fitted"), F.array_sort(F.collect_set("band")).alias("_b"))
    total = frames_by_band.agg(F.sum("n").alias("_t"))
    covered = curves.select("detector", "band").join(frames_by_band, "band").groupBy("detector").agg(F.sum("n").alias("_c"))
    j = sizes.join(bands, "detector", "left").join(auc(judged, ["detector"]), "detector", "left").join(ece(judged, ["detector"]).drop("n"), "detector", "left").join(covered, "detector", "left")
    return null_safe_join(j, total, []).select(
        "detector", "n_fit", (F.coalesce("n_pos", F.lit(0)) + F.coalesce("n_neg", F.lit(0))).alias("n_holdout"), "auc", F.when(F.col("auc").isNotNull(), F.col("ece")).alias("ece"),
        F.coalesce("bands_fitted", F.lit(0)).alias("bands_fitted"), "bands_seen", (F.coalesce("_c", F.lit(0)) / F.col("_t")).alias("fraction_covered"))

