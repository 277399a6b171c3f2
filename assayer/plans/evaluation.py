"""A whole evaluation and the comparison of two, as tidy tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer import plugins as U
from assayer import schema as K
from assayer.functions.scalar import finite
from assayer.operators import guards as G
from assayer.operators import identity as I
from assayer.operators import metrics as M
from assayer.operators import resample as B
from assayer.operators import splits as P
from assayer.operators.curve import tpr_at_fpr
from assayer.operators.ranking import null_safe_join
from assayer.operators.select import require_same_coverage
from assayer.session import shared


@dataclass(frozen=True)
class EvaluationConfig:
    seed: int = 0
    bootstrap: int = 1000
    bootstrap_group: str = "source_id"
    parity_at_fpr: float = 0.01
    parity_ceiling: float = 2.0
    min_genuine: int = K.MIN_GENUINE_PER_STRATUM
    identity_threshold: float = 0.6
    identity_tolerated: float = 0.0
    max_subjects: int | None = None
    required_compression: tuple[str, ...] = K.REQUIRED_COMPRESSION
    threshold_source: str = "validation"
    waived: frozenset[str] = field(default_factory=frozenset)

    def __post_init__(self) -> None:
        if self.threshold_source != "validation":
            raise G.GuardViolation(f"thresholds must come from validation, not {self.threshold_source!r}")
        unknown = self.waived - {"identity", "parity"}
        if unknown:
            raise ValueError(f"only measurements may be waived, not {sorted(unknown)}")


def check_corpus(records: DataFrame, config: EvaluationConfig) -> None:
    """The refusals that come before any score is looked at."""
    G.require(P.record_violations(records), "malformed records")
    G.require(G.duplicate_ids(records), "duplicate sample ids")
    G.require(G.video_level(records), "a source video appears in several samples")
    G.require(G.missing_compression(records, config.required_compression), "compression levels missing")
    G.require(G.mixed_preprocessing(records), "non-uniform preprocessing")


def run_evaluation(records: DataFrame, scores: DataFrame, config: EvaluationConfig = EvaluationConfig(), embeddings: DataFrame | None = None,
                   variants: DataFrame | None = None, attacks: DataFrame | None = None, targets: DataFrame | None = None) -> dict[str, DataFrame]:
    """Guards, metrics with intervals, folds, variants, identity and parity over one pass of scores.

    ``scores`` is (sample_id, detector, score[, latency_ms]); ``variants`` is (sample_id, detector, variant, score), the
    same samples after a perturbation; ``attacks`` and ``targets`` are as in :func:`adversarial_status`. Scores are
    computed elsewhere once; folds slice them. Every entry is lazy.

    A waived guard still measures. With identity waived, samples without an embedding are counted, the others are
    compared, and the status is a violation.
    """
    check_corpus(records, config)
    cols = [c for c in ("latency_ms",) if c in scores.columns]
    known = records.select(*dict.fromkeys(["sample_id", config.bootstrap_group, "subject_id", "label", "generator", "stratum"]))
    long = shared(scores.select("sample_id", "detector", "score", *cols).join(known, "sample_id"))
    folds = shared(P.generator_folds(records, config.seed))
    P.require_measurable(folds)
    interval = lambda rows, by: B.bootstrap_ci(rows, by, config.bootstrap_group, config.bootstrap, config.seed)
    report = null_safe_join(M.detector_report(long, ["detector"], latency=cols[0] if cols else None), interval(long, ["detector"]), ["detector"], "left")
    if attacks is not None and targets is None:
        raise ValueError("attack results need the table of detectors that offer a target")
    report = U.adversarial_status(report, attacks, targets)
    tests = long.join(folds.where(F.col("side") == "test").select("fold", "sample_id"), "sample_id")
    by_fold = shared(null_safe_join(M.fold_report(long, folds), interval(tests, ["fold", "detector"]), ["fold", "detector"], "left"))
    out = {
        "dataset": M.dataset_hash(records), "report": report, "abstention": M.abstention_by_class(long), "folds": by_fold,
        "fold_sizes": P.fold_counts(folds), "worst_fold": M.worst_fold(by_fold),
        "parity": G.parity_report(long, records, config.parity_at_fpr, config.parity_ceiling, config.min_genuine),
    }
    if variants is not None:
        out["variants"] = variant_report(variants, records)
    if embeddings is not None:
        missing = I.missing_embeddings(records, embeddings)
        if "identity" not in config.waived:
            G.require(missing, "no embedding, so disjointness cannot be certified")
        out["missing_embeddings"] = missing.agg(F.count(F.lit(1)).alias("n"))
        out["identity"] = identity_reports(records, folds, embeddings, config)
        worst = null_safe_join(G.worst_identity(out["identity"]), out["missing_embeddings"], [])
        out["worst_identity"] = worst.withColumn("status", F.when(F.col("n") > 0, "violation").otherwise(F.col("status"))).drop("n")
        if "identity" not in config.waived:
            G.require(out["worst_identity"].where(F.col("status") == "violation"), "identity leakage")
    if "parity" not in config.waived:
        G.require(out["parity"].where("violation"), "demographic disparity")
    return out


def variant_report(variants: DataFrame, records: DataFrame) -> DataFrame:
    """(detector, variant, n, n_scored, tpr_at_1pct): detection after each perturbation, NULL with one class."""
    rows = variants.join(records.select("sample_id", "label"), "sample_id")
    n = rows.groupBy("detector", "variant").agg(F.count(F.lit(1)).alias("n"), F.count_if(finite("score")).alias("n_scored"))
    tpr = tpr_at_fpr(rows, ["detector", "variant"], {"tpr_at_1pct": 0.01}).select("detector", "variant", "tpr_at_1pct")
    return n.join(tpr, ["detector", "variant"], "left")


def identity_reports(records: DataFrame, folds: DataFrame, embeddings: DataFrame, config: EvaluationConfig) -> DataFrame:
    """The corpus-level check and one report per fold, from one product of packed vectors: (scope, name, report columns)."""
    t, tol = config.identity_threshold, config.identity_tolerated
    names = [r[0] for r in folds.select("fold").distinct().orderBy("fold").collect()]
    number = records.sparkSession.createDataFrame([*((k, "fold", n) for k, n in enumerate(names)), (len(names), "corpus", "corpus")], "number int, scope string, name string")
    numbered = folds.join(number.where(F.col("scope") == "fold").select(F.col("name").alias("fold"), "number"), "fold").select("number", "sample_id", "side")
    named = embeddings.select("sample_id", "embedding").join(records.select("sample_id", "subject_id"), "sample_id")
    subjects = I.subject_vectors(named, len(names) + 1, len(names), config.max_subjects, config.seed)
    found = I.scope_products(I.side_vectors(numbered.withColumnRenamed("number", "scope"), embeddings, len(names) + 1).unionByName(subjects), t)
    side = lambda name: F.count_if(F.col("side") == name)
    sizes = numbered.groupBy("number").agg(side("train").alias("n_train"), side("test").alias("n_test"))
    whole = subjects.agg(F.lit(len(names)).alias("number"), F.count(F.lit(1)).alias("n_train"), F.count(F.lit(1)).alias("n_test"))
    total = named.agg(F.lit(len(names)).alias("number"), F.countDistinct("subject_id").alias("n_subjects_total"))
    out = number.join(sizes.unionByName(whole), "number").join(found.withColumnRenamed("scope", "number"), "number", "left").join(total, "number", "left")
    return out.select("scope", "name", *I.report_columns(t, tol), "n_subjects_total")


def compare_runs(baseline: DataFrame, candidate: DataFrame, replicates: int = 1000, seed: int = 0, check: bool = True) -> DataFrame:
    """Per fold: both AUCs, the paired difference with its interval, and whether
    the candidate improved the *baseline's* worst fold.

    Both inputs are (fold, sample_id, subject_id, label, score).
    """
    if check:
        require_same_coverage(baseline, candidate, ["fold", "sample_id"], "fold")
    both = shared(baseline.withColumnRenamed("score", "_b").join(candidate.select("fold", "sample_id", F.col("score").alias("_c")), ["fold", "sample_id"]))
    d = B.paired_delta_ci(both, ["fold"], "subject_id", "_b", "_c", replicates, seed)
    n = both.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 1).alias("n_fake"), F.countDistinct("subject_id").alias("n_subjects"))
    per = shared(d.join(n, "fold"))
    worst = per.agg(F.min_by("fold", F.struct("baseline_auc", "fold")).alias("worst_fold"))
    is_worst = F.col("fold") == F.col("worst_fold")
    return null_safe_join(per, worst, []).select(
        "fold", "baseline_auc", "candidate_auc", "delta", "ci_lo", "ci_hi", "n", "n_fake", "n_subjects", is_worst.alias("is_worst"),
        F.when(is_worst, (F.col("delta") > 0) & (F.col("ci_lo") > 0)).alias("improved"))


def tidy(tables: dict[str, DataFrame]) -> DataFrame:
    """Every numeric cell of an evaluation as (section, subject, metric, value)."""
    out = None
    for section, df in tables.items():
        nums = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "long", "integer")]
        keys = [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]
        cells = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in nums])
        rows = df.select(F.lit(section).alias("section"), F.concat_ws("/", *keys).alias("subject"), F.inline(cells))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("nothing to report")
    return out
