"""Aggregate metrics. Every function takes ``by`` columns, so per detector,
fold, band, variant or replicate is one code path and one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assayer.functions.scalar import class_of, finite
from assayer.operators.curve import quantiles_of, tpr_at_fpr, tpr_of
from assayer.operators.ranking import BUCKET, null_safe_join, time_number, with_value_bucket
from assayer.session import shared


def ece(df: DataFrame, by: Sequence[str] = (), prob: str = "score", label: str = "label", bins: int = 10) -> DataFrame:
    """Expected calibration error over equal bins, the first closed at both ends.

    The bin is a count of literal edges below the value, so edge rounding is
    the same as comparing against the edge list. Out-of-range input fails.
    """
    p = F.col(prob).cast("double")
    cells = df.where(p.isNotNull()).groupBy(*by, p.alias("score")).agg(F.count(F.lit(1)).alias("cnt"), F.sum(F.col(label).cast("double")).alias("ones"))
    return ece_of(cells, by, bins)


def ece_of(cells: DataFrame, by: Sequence[str] = (), bins: int = 10) -> DataFrame:
    """:func:`ece` of a table of probabilities (score), their counts (cnt) and their ones."""
    if bins < 1:
        raise ValueError(f"bins must be at least 1, got {bins}")
    p = F.col("score")
    ok = F.when(finite(p) & p.between(0.0, 1.0), p).otherwise(F.raise_error(F.concat(F.lit("not a probability: "), p.cast("string"))).cast("double"))
    step = 1.0 / bins
    edges = [i * step for i in range(bins)] + [1.0]
    below = sum((F.when(F.col("_p") > e, 1).otherwise(0) for e in edges), F.lit(0))
    binned = cells.select(*by, ok.alias("_p"), "cnt", "ones").withColumn("_bin", F.greatest(below - 1, F.lit(0)))
    each = binned.groupBy(*by, "_bin").agg(F.sum("cnt").alias("_n"), F.sum(F.col("_p") * F.col("cnt")).alias("_sp"), F.sum("ones").alias("_sy"))
    return each.groupBy(*by).agg((F.sum(F.abs(F.col("_sp") - F.col("_sy"))) / F.sum("_n")).alias("ece"), F.sum("_n").alias("n"))


def kish_ess(df: DataFrame, group: str, by: Sequence[str] = ()) -> DataFrame:
    """Effective number of groups: (sum n)^2 / sum n^2 over group sizes."""
    sizes = df.groupBy(*by, group).agg(F.count(F.lit(1)).cast("double").alias("_n"))
    return sizes.groupBy(*by).agg((F.pow(F.sum("_n"), F.lit(2)) / F.sum(F.col("_n") * F.col("_n"))).alias("ess"))


def autocorrelation_ess(df: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Lag-1 effective sample size of each group's series.

    Lag products are formed inside order-preserving buckets; the pair that
    straddles two buckets is stitched from their first and last values. A
    series of any length is thereby never ordered by one task.
    """
    v = F.col(value).cast("double")
    base = df.select(group, time_number(df, order).alias("_t"), F.col(order).alias("_o"), v.alias("_v"))
    mean = base.groupBy(group).agg(F.avg("_v").alias("_m"))
    b = with_value_bucket(null_safe_join(base, mean, [group]).withColumn("_c", F.col("_v") - F.col("_m")).drop("_m"), "_t")
    w = Window.partitionBy(group, BUCKET).orderBy("_o", "_v")
    pieces = (
        b.withColumn("_prev", F.lag("_c").over(w))
        .groupBy(group, BUCKET)
        .agg(
            F.count(F.lit(1)).alias("_n"), F.sum(F.col("_c") * F.col("_prev")).alias("_cross"), F.sum(F.col("_c") * F.col("_c")).alias("_sq"),
            F.min_by("_c", F.struct("_o", "_v")).alias("_first"), F.max_by("_c", F.struct("_o", "_v")).alias("_last"),
        )
    )
    wb = Window.partitionBy(group).orderBy(BUCKET)
    g = pieces.withColumn("_seam", F.col("_first") * F.lag("_last").over(wb)).groupBy(group).agg(
        F.sum("_n").alias("n"), (F.coalesce(F.sum("_cross"), F.lit(0.0)) + F.coalesce(F.sum("_seam"), F.lit(0.0))).alias("_cross"), F.sum("_sq").alias("_sq"))
    n = F.col("n").cast("double")
    rho = F.greatest(F.lit(-0.999), F.least(F.lit(0.999), F.col("_cross") / F.col("_sq")))
    ess = F.least(n, F.greatest(F.lit(1.0), n * (1.0 - rho) / (1.0 + rho)))
    flat = F.sqrt(F.col("_sq") / n) < 1e-12
    return g.select(group, "n", F.when(n < 3, n).when(flat, 1.0).otherwise(ess).alias("ess"))


def session_max(df: DataFrame, session: str = "session_id", score: str = "score", label: str = "label") -> DataFrame:
    """Loudest frame per session; label is the mean rounded half to even."""
    return df.where(finite(score)).groupBy(session).agg(F.max(score).alias("score"), F.rint(F.avg(label)).cast("int").alias("label"))


def session_mean(df: DataFrame, session: str = "session_id", score: str = "score", label: str = "label") -> DataFrame:
    """Mean frame score per session with the session's label and a conflict flag."""
    return df.where(finite(score)).groupBy(session).agg(
        F.avg(score).alias("score"), F.min(label).alias("label"), (F.min(label) != F.max(label)).alias("conflicting"))


def refuse_conflicting_sessions(sessions: DataFrame) -> DataFrame:
    bad = [r[0] for r in sessions.where("conflicting").limit(5).collect()]
    if bad:
        raise ValueError(f"sessions with conflicting labels: {bad}")
    return sessions.drop("conflicting")


def class_counts(df: DataFrame, by: Sequence[str], label: str = "label") -> DataFrame:
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 0).alias("n_genuine"), F.count_if(F.col(label) == 1).alias("n_swapped"))


def per_band(df: DataFrame, by: Sequence[str] = ("band",)) -> DataFrame:
    """Counts, AUC and TPR at zero false alarms per band; NULL with one class."""
    s = df.where(finite("score"))
    return null_safe_join(class_counts(s, by), tpr_at_fpr(s, by, {"tpr_at_zero": 0.0}).drop("n_pos", "n_neg"), list(by))


def abstention_by_class(df: DataFrame, by: Sequence[str] = ("detector",), score: str = "score", cls: Column | None = None) -> DataFrame:
    """Abstained and total for every class, counting every row."""
    c = cls if cls is not None else class_of("generator")
    return df.groupBy(*by, c.alias("class")).agg(F.count_if(~finite(score)).alias("abstained"), F.count(F.lit(1)).alias("total"))


def abstention_reasons(df: DataFrame, by: Sequence[str] = ("detector",)) -> DataFrame:
    return df.where("abstained").groupBy(*by, "reason").agg(F.count(F.lit(1)).alias("n"))


def latency_summary(df: DataFrame, by: Sequence[str], value: str = "latency_ms", warmup: str | None = None) -> DataFrame:
    """Mean, p50 and p95 over warm rows; warm-up rows are counted, not mixed in. The input is read once."""
    by = list(by)
    cold = F.lit(False) if warmup is None else F.col(warmup)
    cells = shared(df.groupBy(*by, F.col(value).cast("double").alias("score"), cold.alias("_cold")).agg(F.count(F.lit(1)).alias("cnt")))
    warm = cells.where(~F.col("_cold") & F.col("score").isNotNull()).select(*by, "score", "cnt")
    head = cells.groupBy(*by).agg(F.coalesce(F.sum(F.when(F.col("_cold"), F.col("cnt"))), F.lit(0)).cast("bigint").alias("n_warmup"))
    mean = warm.groupBy(*by).agg((F.sum(F.col("score") * F.col("cnt")) / F.sum("cnt")).alias("mean"))
    out = null_safe_join(null_safe_join(head, mean, by, "left"), quantiles_of(warm, by, {"p50": 0.5, "p95": 0.95}), by)
    return out.select(*by, "mean", "n_warmup", "p50", "p95")


def report_cells(df: DataFrame, by: Sequence[str], latency: str | None = None, score: str = "score", label: str = "label") -> DataFrame:
    """(by, kind, score, n, pos, neg): every distinct score (kind 0, NULL for abstentions) and latency (kind 1) with its counts.

    One aggregation of one read; everything a report says comes from this table.
    """
    kinds = [F.struct(F.lit(0).alias("kind"), F.when(finite(score), F.col(score).cast("double")).alias("score"))]
    kinds += [F.struct(F.lit(1).alias("kind"), F.col(latency).cast("double").alias("score"))] if latency else []
    long = df.select(*by, F.col(label).alias("_y"), F.inline(F.array(*kinds)))
    one = lambda y: F.count_if((F.col("_y") == y) & (F.col("kind") == 0))
    return long.groupBy(*by, "kind", "score").agg(F.count(F.lit(1)).alias("n"), one(1).alias("pos"), one(0).alias("neg"))


def detector_report(df: DataFrame, by: Sequence[str] = ("detector",), latency: str | None = None, calibrated: bool = True) -> DataFrame:
    """AUC, TPR at 1 % and 0.1 %, ECE, abstention rate, p95 latency, n.

    Metrics are over rows that were scored; the abstention rate over all rows. The input is read once.
    """
    by = list(by)
    cells = shared(report_cells(df, by, latency))
    scored = cells.where((F.col("kind") == 0) & F.col("score").isNotNull())
    head = cells.where("kind = 0").groupBy(*by).agg(F.sum("n").alias("n"), (F.sum(F.when(F.col("score").isNull(), F.col("n")).otherwise(0)) / F.sum("n")).alias("abstention_rate"))
    rank = tpr_of(scored.select(*by, "score", "pos", "neg"), by, {"tpr_at_1pct": 0.01, "tpr_at_0p1pct": 0.001}).drop("n_pos", "n_neg")
    out = null_safe_join(head, rank, by, "left")
    if calibrated:
        e = ece_of(scored.select(*by, "score", F.col("n").alias("cnt"), F.col("pos").alias("ones")), by).select(*by, "ece")
        out = null_safe_join(out, e, by, "left").withColumn("ece", F.when(F.col("auc").isNotNull(), F.col("ece")))
    if latency:
        timed = cells.where((F.col("kind") == 1) & F.col("score").isNotNull()).select(*by, "score", F.col("n").alias("cnt"))
        out = null_safe_join(out, quantiles_of(timed, by, {"p95_latency_ms": 0.95}), by, "left")
    return out


def fold_report(scores: DataFrame, assignments: DataFrame, by: Sequence[str] = ("detector",)) -> DataFrame:
    """The detector report over each fold's test rows, reusing scores already
    computed, with the rows the fold dropped for identity."""
    test = assignments.where(F.col("side") == "test").select("fold", "sample_id")
    dropped = assignments.groupBy("fold").agg(F.count_if(F.col("side") == "dropped").alias("n_dropped"))
    return detector_report(scores.join(test, "sample_id"), ["fold", *by]).join(dropped, "fold")


def worst_fold(report: DataFrame, by: Sequence[str] = ("detector",)) -> DataFrame:
    """Lowest measured AUC and its fold; NULL when no fold was measurable."""
    return report.groupBy(*by).agg(F.min("auc").alias("worst_auc"), F.min_by("fold", F.struct(F.col("auc"), F.col("fold"))).alias("worst_fold"))


def lookup_accuracy(df: DataFrame, key: str, label: str = "label") -> tuple[DataFrame, DataFrame]:
    """Contingency of a header key with the label, and how well the key alone does."""
    table = df.groupBy(key).agg(F.count_if(F.col(label) == 0).alias("genuine"), F.count_if(F.col(label) == 1).alias("swapped"))
    acc = table.agg(
        F.count(F.lit(1)).alias("distinct_keys"),
        F.when(F.sum(F.col("genuine") + F.col("swapped")) > 0, F.sum(F.greatest("genuine", "swapped")) / F.sum(F.col("genuine") + F.col("swapped"))).alias("accuracy"))
    return table, acc


def single_key_status(df: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    """More than one surviving key means the shortcut is still there: not measured."""
    distinct = df.where(F.col(key).isNotNull()).groupBy(*by, key).agg(F.lit(1).alias("_x"))
    n = F.count(F.lit(1))
    return distinct.groupBy(*by).agg(n.alias("distinct_keys"), F.when(n > 1, "not_measured").otherwise("measured").alias("status"))


def aggregate_is_max_like(results: DataFrame, tolerance: float = 0.2) -> DataFrame:
    """Does the vendor's score follow its loudest model?"""
    gap = F.abs(F.col("score") - F.col("max_model_score"))
    use = results.where(finite("score") & F.col("max_model_score").isNotNull())
    return use.agg(F.avg(gap).alias("mean_gap"), F.count(F.lit(1)).alias("n")).withColumn(
        "max_like", F.coalesce(F.col("mean_gap") <= tolerance, F.lit(False)))


def band_coverage(frames_by_band: DataFrame, fitted: DataFrame) -> DataFrame:
    """Which bands have a curve and how many frames that covers."""
    j = frames_by_band.join(fitted.select("band").distinct().withColumn("_have", F.lit(True)), "band", "left")
    have = F.coalesce("_have", F.lit(False))
    return j.agg(
        F.concat_ws(",", F.array_sort(F.collect_set(F.when(have, F.col("band"))))).alias("covered_bands"),
        F.concat_ws(",", F.array_sort(F.collect_set(F.when(~have, F.col("band"))))).alias("uncovered_bands"),
        F.coalesce(F.sum(F.when(have, F.col("n"))), F.lit(0)).alias("frames_covered"),
        F.sum("n").alias("frames"),
    ).withColumn("fraction_covered", F.when(F.col("frames") > 0, F.col("frames_covered") / F.col("frames")))


IDENTIFYING = ("align", "compression", "face_detector", "generator", "label", "sample_id", "source_id", "subject_id")


def dataset_hash(records: DataFrame) -> DataFrame:
    """Order-independent SHA-256 of the identifying fields, as a hash tree.

    Row digests are hashed per six-digit prefix, those per three-digit prefix,
    and those once more. A node has at most 4,096 children and a leaf n / 16M
    rows, so no task holds the corpus; the shape never depends on the cluster.
    Equal rows fold to ``digest:count`` first, so copies cannot pile up.
    """
    have = [F.col(c) if c in records.columns else F.lit(None).cast("string").alias(c) for c in IDENTIFYING]
    row = F.sha2(F.to_json(F.struct(*have), {"ignoreNullFields": "false"}), 256)
    level = records.select(row.alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    level = level.withColumn("d", F.concat_ws(":", "k", F.col("n").cast("string")))
    for digits in (6, 3, 0):
        parent = F.substring("k", 1, digits) if digits else F.lit("")
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "d"))), lambda x: x["d"]), "\n")
        level = level.groupBy(parent.alias("p")).agg(F.sha2(joined, 256).alias("d"), F.sum("n").alias("n")).withColumnRenamed("p", "k")
    return level.select(F.col("d").alias("dataset_hash"), "n")


def corpus_block(records: DataFrame) -> DataFrame:
    """Size, balance and concentration of a corpus from one (domain, label) table."""
    cell = records.groupBy("domain", "label").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("has_face")).alias("f"))
    dom = cell.groupBy("domain").agg(
        F.sum("n").alias("n"), F.sum("f").alias("f"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("r"),
        F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("k"))
    ess = lambda c: F.when(F.sum(c) > 0, F.pow(F.sum(c).cast("double"), F.lit(2)) / F.sum(F.col(c).cast("double") * F.col(c)))
    return dom.agg(
        F.sum("n").alias("records"), F.sum("r").alias("reals"), F.sum("k").alias("fakes"), F.sum("f").alias("n_face_subset"),
        (F.sum("n") - F.sum("f")).alias("n_no_face"), F.count(F.lit(1)).alias("domains"), F.max("n").alias("largest_domain"),
        ess("r").alias("ess_reals"), ess("k").alias("ess_fakes"))


def standardiser(df: DataFrame, features: str, width: int, by: Sequence[str] = ()) -> DataFrame:
    """Mean and population spread per feature index; a near-zero spread is one.

    One vector aggregate, combined map-side, whose plan does not grow with the
    width; NULL entries are refused by the fits, not skipped here.
    """
    v = array_to_vector(F.col(features).cast("array<double>"))
    g = df.groupBy(*by).agg(F.count(features).alias("_n"), Summarizer.metrics("mean", "variance").summary(v).alias("_s"))
    spread = F.transform(vector_to_array("_s.variance"), lambda x: F.sqrt(x * (F.col("_n") - 1) / F.col("_n")))
    return g.where("_n > 0").select(*by, vector_to_array("_s.mean").alias("mean"), F.transform(spread, lambda s: F.when(s < 1e-9, 1.0).otherwise(s)).alias("scale"))


def face_summary(frames: DataFrame, key: str, faces: str) -> DataFrame:
    """``with/total`` frames and the most faces in one frame."""
    g = frames.groupBy(key).agg(F.count_if(F.col(faces) > 0).alias("_w"), F.count(F.lit(1)).alias("_n"), F.max(faces).alias("face_count_max"))
    return g.select(key, F.concat(F.col("_w").cast("string"), F.lit("/"), F.col("_n").cast("string")).alias("frames_with_face"), "face_count_max")


def family_counts(records: DataFrame) -> DataFrame:
    return records.groupBy(class_of("generator").alias("family")).agg(F.count(F.lit(1)).alias("n"))


def status_counts(submissions: DataFrame) -> DataFrame:
    return submissions.groupBy("status", "verdict").agg(F.count(F.lit(1)).alias("n"))

