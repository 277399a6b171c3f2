"""Hygiene guards. Each measures and says what it found; ``require`` refuses.

A waived guard is a guard whose finding is kept and not raised, so measuring
and refusing are separate calls.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer import schema as K
from assayer.functions.scalar import finite
from assayer.operators.curve import auc, quantiles_of
from assayer.operators.metrics import report_cells
from assayer.operators.ranking import null_safe_join
from assayer.session import shared


class GuardViolation(ValueError):
    """A finding that makes the number it guards meaningless."""


def require(findings: DataFrame, what: str, waived: bool = False) -> DataFrame:
    """Raise on the first findings unless waived; the findings come back either way."""
    if not waived:
        bad = findings.limit(5).collect()
        if bad:
            raise GuardViolation(f"{what}: {[r.asDict() for r in bad]}")
    return findings


def video_level(df: DataFrame, sample: str = "sample_id", group: str = "source_id") -> DataFrame:
    """Groups that appear in several samples, as (group, low id, high id)."""
    g = df.groupBy(group).agg(F.min(sample).alias("first_id"), F.max(sample).alias("last_id"))
    return g.where(F.col("first_id") != F.col("last_id"))


def video_level_status(df: DataFrame, sample: str = "sample_id", group: str = "source_id") -> DataFrame:
    """``vacuous`` when groups are the sample ids themselves, else ok or violation."""
    g = df.groupBy(group).agg(
        (F.min(sample) != F.max(sample)).alias("_bad"), F.bool_or(~F.col(sample).eqNullSafe(F.col(group))).alias("_differs"))
    return g.agg(F.count_if("_bad").alias("n_violations"), F.bool_or("_differs").alias("_d")).select(
        F.when(~F.coalesce("_d", F.lit(False)), "vacuous").when(F.col("n_violations") > 0, "violation").otherwise("ok").alias("status"), "n_violations")


def missing_compression(records: DataFrame, required: Sequence[str] = K.REQUIRED_COMPRESSION) -> DataFrame:
    need = records.sparkSession.createDataFrame([(c,) for c in required], "compression string")
    return need.join(records.select("compression").distinct(), "compression", "left_anti")


def mixed_preprocessing(records: DataFrame, keys: Sequence[str] = ("face_detector", "align")) -> DataFrame:
    """Keys with more than one value, NULL counting as a value.

    ``min``/``max`` plus a NULL count decide it in one map-side aggregate.
    """
    aggs = []
    for k in keys:
        mixed = (F.min(k) != F.max(k)) | ((F.count(k) > 0) & (F.count(k) < F.count(F.lit(1))))
        aggs.append(F.struct(F.lit(k).alias("key"), F.coalesce(mixed, F.lit(False)).alias("mixed"), F.min(k).alias("low"), F.max(k).alias("high")))
    return records.agg(F.array(*aggs).alias("a")).select(F.inline("a")).where("mixed").select("key", "low", "high")


def demographic_parity(df: DataFrame, thresholds: DataFrame | float, by: Sequence[str] = (), stratum: str = "stratum",
                       score: str = "score", label: str = "label") -> DataFrame:
    """FPR and TPR per stratum at a threshold (strictly above)."""
    s = df.where(finite(score))
    if isinstance(thresholds, DataFrame):
        s = null_safe_join(s, thresholds.select(*by, "threshold"), list(by))
    else:
        s = s.withColumn("threshold", F.lit(float(thresholds)))
    hit = F.when(F.col(score) > F.col("threshold"), 1.0).otherwise(0.0)
    return s.groupBy(*by, stratum).agg(F.avg(F.when(F.col(label) == 0, hit)).alias("fpr"), F.avg(F.when(F.col(label) == 1, hit)).alias("tpr"))


def parity_ratio(rates: DataFrame, by: Sequence[str] = (), ceiling: float = 2.0) -> DataFrame:
    """Largest over smallest FPR: 1 below two strata, infinite at a zero floor."""
    lo, hi = F.min("fpr"), F.max("fpr")
    ratio = F.when(F.count("fpr") < 2, 1.0).when(lo == 0, F.when(hi > 0, float("inf")).otherwise(1.0)).otherwise(hi / lo)
    return rates.groupBy(*by).agg(ratio.alias("fpr_ratio")).withColumn("violation", F.col("fpr_ratio") > ceiling)


def parity_report(scores: DataFrame, records: DataFrame, at_fpr: float = 0.01, ceiling: float = 2.0,
                  min_genuine: int = K.MIN_GENUINE_PER_STRATUM) -> DataFrame:
    """Per detector: threshold, FPR ratio and a status.

    Strata qualify on the corpus, not on what a detector scored; a table too
    thin to compare says so by name instead of passing.
    """
    strata = shared(records.groupBy("stratum").agg(F.count_if(F.col("label") == 0).alias("_g")))
    scope = strata.agg(
        F.count_if(F.col("stratum").isNull()).alias("_null"), F.count_if(F.col("_g") >= min_genuine).alias("_ok"),
        F.count_if(F.col("_g") < min_genuine).alias("n_excluded"))
    cells = shared(report_cells(scores, ["detector", "stratum"]))
    detectors = cells.select("detector").distinct()
    kept = cells.where(F.col("score").isNotNull()).join(strata.where(F.col("_g") >= min_genuine).select("stratum"), "stratum", "left_semi")
    size = kept.groupBy("detector").agg(F.sum("neg").alias("_n0"), F.sum("pos").alias("_n1"))
    genuine = kept.where("neg > 0").groupBy("detector", "score").agg(F.sum("neg").alias("cnt"))
    thr = quantiles_of(genuine, ["detector"], {"threshold": 1.0 - at_fpr})
    over = F.when(F.col("score") > F.col("threshold"), F.col("neg")).otherwise(0)
    rates = kept.join(thr, "detector").groupBy("detector", "stratum").agg((F.sum(over) / F.nullif(F.sum("neg"), F.lit(0))).alias("fpr"))
    ratio = parity_ratio(rates, ["detector"], ceiling)
    j = detectors.join(size, "detector", "left").join(thr, "detector", "left").join(ratio, "detector", "left")
    j = null_safe_join(j, scope, [])
    status = (
        F.when(F.col("_null") > 0, "no_strata").when(F.col("_ok") < 2, "too_few_per_stratum")
        .when((F.coalesce("_n0", F.lit(0)) < 2) | (F.coalesce("_n1", F.lit(0)) < 1), "not_measurable").otherwise("ok"))
    ok = status == "ok"
    return j.select(
        "detector", status.alias("status"), F.when(ok, F.col("threshold")).alias("threshold"), F.when(ok, F.col("fpr_ratio")).alias("fpr_ratio"),
        F.when(ok, F.col("violation")).alias("violation"), "n_excluded")


def worst_identity(reports: DataFrame) -> DataFrame:
    """The report with the highest crossing rate, then similarity, with a status.

    ``reports`` has ``scope`` in {corpus, fold}; no rows means never measured.
    """
    top = F.struct("violation_rate", "max_similarity", "name")
    g = reports.agg(
        F.max_by("name", top).alias("worst"), F.max("violation_rate").alias("violation_rate"),
        F.max_by("max_similarity", top).alias("max_similarity"), F.count(F.lit(1)).alias("_n"),
        F.count_if(F.col("scope") == "fold").alias("_f"), F.bool_or(F.col("violation_rate") > F.col("tolerated_rate")).alias("_v"))
    status = F.when(F.col("_n") == 0, "not_measured").when(F.col("_v"), "violation").when(F.col("_f") == 0, "ok_corpus_only").otherwise("ok")
    return g.select(status.alias("status"), "worst", "violation_rate", "max_similarity")


def domain_grouping(records: DataFrame, by: Sequence[str] = (), domain: str = "domain") -> DataFrame:
    """Refuse one domain (no spread) and one domain per row (no grouping)."""
    d = records.groupBy(*by, domain).agg(F.count(F.lit(1)).alias("_n"))
    g = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n_domains"), F.sum("_n").alias("n_records"))
    why = F.when(F.col("n_domains") < 2, "zero_width_interval").when(F.col("n_domains") == F.col("n_records"), "row_level_interval")
    return g.withColumn("refusal", why)


def duplicate_ids(df: DataFrame, keys: Sequence[str] = ("sample_id",)) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def oracle_band(scores: DataFrame, by: Sequence[str] = ("detector",), lo: float = K.ORACLE_BAND[0], hi: float = K.ORACLE_BAND[1]) -> DataFrame:
    """A known detector must land in its published band, or nothing is reported."""
    a = auc(scores, by)
    x = F.col("auc")
    why = F.when(x.isNull(), "no_auc").when(x < lo, "below_band").when(x > hi, "above_band").otherwise("inside_band")
    return a.select(*by, "auc", why.alias("verdict"), (why == "inside_band").alias("passed"))


def control_alarm(controls: DataFrame, threshold: float = K.CONTROL_ALARM_AUC) -> DataFrame:
    """Shortcut controls that did too well; a refused control cannot fire."""
    return controls.where(~F.coalesce("refused", F.lit(False)) & (F.col("auc") >= threshold)).select("control", "auc")


def evidence_gate(card: DataFrame, assets: DataFrame, floor: float = K.AUC_FLOOR) -> DataFrame:
    """Every detector with whether it may decide and the first reason it may not.

    ``card`` is (detector, auc, corpus, trained_on, auc_floor); ``assets`` the
    registered ids.
    """
    ids = assets.select("asset_id").distinct()
    a = ids.select(F.col("asset_id").alias("corpus"), F.lit(True).alias("_c"))
    b = ids.select(F.col("asset_id").alias("trained_on"), F.lit(True).alias("_t"))
    j = card.join(a, "corpus", "left").join(b, "trained_on", "left")
    need = F.greatest(F.lit(floor), F.coalesce("auc_floor", F.lit(floor)))
    why = (
        F.when(F.col("auc").isNull(), "never_measured").when(F.col("auc") < need, "below_floor")
        .when(F.coalesce("trained_on", F.lit("")) == "", "training_undeclared").when(F.col("trained_on").eqNullSafe(F.col("corpus")), "trained_on_corpus")
        .when(F.col("_c").isNull() | F.col("_t").isNull(), "unregistered_corpus"))
    return j.select("detector", why.isNull().alias("gated"), why.alias("reason"))


def gated_detectors(card: DataFrame, assets: DataFrame, floor: float = K.AUC_FLOOR) -> DataFrame:
    return evidence_gate(card, assets, floor).where("gated").select("detector")


def registered(spark: SparkSession, ids: Sequence[str]) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "asset_id string")
