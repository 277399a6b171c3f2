"""Scores to evidence, evidence to verdicts, verdicts to audit records."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer import schema as K
from assayer.functions.scalar import finite, model_verdict, verdict_name


@dataclass(frozen=True)
class Policy:
    fake_threshold: float = K.FAKE_THRESHOLD
    real_threshold: float = K.REAL_THRESHOLD
    disagreement_ood: float = K.DISAGREEMENT_OOD
    version: str = K.POLICY_VERSION

    def __post_init__(self) -> None:
        if not self.real_threshold < self.fake_threshold:
            raise ValueError("the real threshold must lie below the fake threshold")
        if not self.disagreement_ood > 0:
            raise ValueError("the disagreement threshold must be positive")


def sample_scores(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Mean over frames as the score, the maximum kept beside it."""
    return frames.groupBy(*keys).agg(F.avg("score").alias("score"), F.max("score").alias("max_score"), F.count("score").alias("n_frames"))


def to_evidence(scores: DataFrame, curves: DataFrame) -> DataFrame:
    """Calibrated log-likelihood ratio per score row, or an abstention.

    A score that is NaN or infinite was not measured: it abstains with that
    reason, and no raw score is kept.

    ``curves`` holds one row per (detector, band); Catalyst broadcasts it when
    its measured size allows and AQE falls back to a skew-split merge join.
    """
    c = curves.select("detector", "band", "coef", "intercept", "prior", "max_abs_llr")
    j = scores.join(c, ["detector", "band"], "left")
    broken = F.col("score").isNotNull() & ~finite("score")
    silent = F.coalesce(F.col("abstained"), F.lit(False)) | ~finite("score")
    inside = (F.col("prior") > 0) & (F.col("prior") < 1)
    prior = F.when(inside, F.log(F.col("prior") / (1 - F.col("prior")))).otherwise(0.0)
    raw = F.col("coef") * F.col("score") + F.col("intercept") - prior
    llr = F.greatest(-F.col("max_abs_llr"), F.least(F.col("max_abs_llr"), raw))
    no_curve = F.col("coef").isNull()
    return j.select(
        "sample_id", "detector", F.col("version").alias("detector_version"), "band",
        F.when(silent | no_curve, 0.0).otherwise(llr).alias("llr"),
        F.when(~silent, F.col("score")).alias("raw_score"),
        (silent | no_curve).alias("abstained"),
        F.when(broken, "not_measured").when(silent, F.col("reason")).when(no_curve, "uncalibrated_for_band").otherwise("ok").alias("reason"),
    )


def fuse(evidence: DataFrame, samples: DataFrame | None = None, policy: Policy = Policy(), frames: DataFrame | None = None,
         keep_evidence: bool = False, extra: dict[str, Column] | None = None) -> DataFrame:
    """One decision per sample from a single grouping on ``sample_id``.

    ``extra`` aggregates are taken in the same grouping and come out beside the
    decision.

    ``keep_evidence`` also gathers the rows behind the decision: one per
    detector, so the array is as long as the detector list. Leave it off for
    per-frame evidence, whose length nothing bounds. ``frames`` may give ``(sample_id, n_frames,
    ess)`` for the effective-sample-size discount; ``samples`` keeps samples
    that have no evidence at all.
    """
    llr = F.when(~F.col("abstained") & finite("llr"), F.col("llr"))
    entry = F.struct("detector", F.struct("abstained", "detector", "llr", "raw_score", "reason", F.col("detector_version").alias("version")).alias("e"))
    gathered = [F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["e"]).alias("evidence")] if keep_evidence else []
    g = evidence.groupBy("sample_id").agg(
        *[c.alias(k) for k, c in (extra or {}).items()],
        F.count(llr).alias("n_contributing"),
        F.coalesce(F.sum(llr), F.lit(0.0)).alias("_sum"),
        F.coalesce(F.sum(F.when(llr > 0, llr)), F.lit(0.0)).alias("_pos"),
        F.coalesce(F.sum(F.when(llr < 0, -llr)), F.lit(0.0)).alias("_neg"),
        *gathered,
    )
    if samples is not None:
        g = samples.select("sample_id").join(g, "sample_id", "left")
    if frames is not None:
        g = g.join(frames.select("sample_id", "n_frames", "ess"), "sample_id", "left")
    else:
        g = g.withColumn("n_frames", F.lit(1)).withColumn("ess", F.lit(None).cast("double"))
    return _verdict(g, policy, list(extra or ()))


def _verdict(g: DataFrame, policy: Policy, kept: Sequence[str] = ()) -> DataFrame:
    n = F.coalesce(F.col("n_contributing"), F.lit(0))
    frames = F.coalesce(F.col("n_frames"), F.lit(1)).cast("double")
    eff = F.least(F.coalesce(F.col("ess"), F.lit(1.0)), frames)
    discount = F.when(frames > 1, F.greatest(F.lit(1.0), eff) / frames).otherwise(1.0)
    total = F.greatest(F.lit(-K.MAX_TOTAL_LLR), F.least(F.lit(K.MAX_TOTAL_LLR), F.coalesce(F.col("_sum"), F.lit(0.0)) * discount))
    d = g.withColumn("n_contributing", n.cast("bigint")).withColumn("llr_total", F.when(n > 0, total).otherwise(0.0))
    d = d.withColumn("disagreement", F.when(n > 0, F.least("_pos", "_neg")).otherwise(0.0))
    verdict = (
        F.when(F.col("n_contributing") == 0, "insufficient_evidence")
        .when(F.col("disagreement") >= policy.disagreement_ood, "out_of_distribution")
        .when(F.col("llr_total") >= policy.fake_threshold, "fake")
        .when(F.col("llr_total") <= policy.real_threshold, "real")
        .otherwise("insufficient_evidence")
    )
    ess = F.when(F.col("n_contributing") == 0, 0.0).otherwise(F.when(F.coalesce("ess", F.lit(0.0)) == 0.0, 1.0).otherwise(F.col("ess")))
    empty = F.array().cast("array<struct<abstained:boolean,detector:string,llr:double,raw_score:double,reason:string,version:string>>")
    return d.select(
        "sample_id", verdict.alias("verdict"), "llr_total", (1.0 / (1.0 + F.exp(-F.col("llr_total")))).alias("posterior"),
        "disagreement", "n_contributing", ess.alias("ess"), *([F.coalesce("evidence", empty).alias("evidence")] if "evidence" in d.columns else []), *kept,
    )


def reasons_map(decisions: DataFrame) -> DataFrame:
    """detector -> reason, in detector order."""
    m = F.map_from_entries(F.transform("evidence", lambda e: F.struct(e["detector"], e["reason"])))
    return decisions.withColumn("reasons", m)


def gated_curves(curves: DataFrame, gated: DataFrame) -> DataFrame:
    """Only detectors that passed the evidence gate keep their curves."""
    return curves.join(gated.select("detector"), "detector", "left_semi")


# --- audit -------------------------------------------------------------------


def _number(x: Column | str) -> Column:
    """Numbers in the canonical text: six fixed decimals, no exponent, no -0."""
    c = F.col(x) if isinstance(x, str) else x
    return (F.round(c, 6) + F.lit(0.0)).cast("decimal(20,6)")


def audit_records(decisions: DataFrame, context: DataFrame, policy: Policy, created_at: str) -> DataFrame:
    """Canonical JSON and its digest per sample.

    ``context`` gives ``(sample_id, input_sha256, quality_band, stage_reasons)``.
    Fields are in name order at every level and NULLs are written out.
    """
    rows = F.transform(
        "evidence",
        lambda e: F.struct(
            e["abstained"].alias("abstained"), e["detector"].alias("detector"), _number(e["llr"]).alias("llr"),
            _number(e["raw_score"]).alias("raw_score"), e["reason"].alias("reason"), e["version"].alias("version"),
        ),
    )
    versions = F.map_from_entries(F.transform("evidence", lambda e: F.struct(e["detector"], e["version"])))
    record = F.struct(
        F.lit(created_at).alias("created_at"), rows.alias("evidence"), F.col("input_sha256"), _number("llr_total").alias("llr_total"),
        versions.alias("model_versions"), _number("disagreement").alias("ood_score"), F.lit(policy.version).alias("policy_version"),
        _number("posterior").alias("posterior"), F.col("quality_band"), F.col("sample_id"), F.lit(K.AUDIT_SCHEMA_VERSION).alias("schema_version"),
        F.col("stage_reasons"), F.lit(policy.fake_threshold).cast("decimal(20,6)").alias("threshold"), F.col("verdict"),
    )
    j = decisions.join(context, "sample_id").withColumn("record_json", F.to_json(record, {"ignoreNullFields": "false"}))
    return j.withColumn("record_digest", F.sha2("record_json", 256))


def tampered(records: DataFrame) -> DataFrame:
    return records.where(~F.sha2("record_json", 256).eqNullSafe(F.col("record_digest")))


# --- projections -------------------------------------------------------------


def _dissenters(evidence: Column, total: Column) -> Column:
    speaking = F.filter(evidence, lambda e: ~e["abstained"] & (e["llr"] != 0))
    against = F.filter(speaking, lambda e: (F.signum(total) == 0) | (F.signum(e["llr"]) != F.signum(total)))
    return F.transform(against, lambda e: e["detector"])


def model_list(decisions: DataFrame) -> DataFrame:
    """Product vocabulary: verdict name, posterior, per-model rows, dissenters."""
    models = F.transform(
        "evidence",
        lambda e: F.struct(
            e["detector"].alias("name"), model_verdict(e["abstained"], e["llr"]).alias("verdict"),
            e["raw_score"].alias("score"), e["abstained"].alias("abstained"), e["reason"].alias("reason"),
        ),
    )
    return decisions.select(
        "sample_id", verdict_name("verdict").alias("verdict"), F.col("posterior").alias("score"),
        models.alias("models"), _dissenters(F.col("evidence"), F.col("llr_total")).alias("dissenting_models"),
    )


def simple_answer(decisions: DataFrame) -> DataFrame:
    """Yes, no or no answer - and when there is none, who stayed silent and why."""
    m = model_list(decisions)
    fake, real = F.col("verdict") == "MANIPULATED", F.col("verdict") == "AUTHENTIC"
    silent = F.transform(F.filter("models", lambda x: x["abstained"]), lambda x: F.struct(x["name"].alias("name"), x["reason"].alias("reason")))
    none = F.filter(silent, lambda _: F.lit(False))
    return m.select(
        "sample_id",
        F.when(fake, True).when(real, False).alias("is_deepfake"),
        F.when(fake, F.col("score")).when(real, 1 - F.col("score")).alias("confidence"),
        "verdict",
        F.when(fake | real, "decided").otherwise("insufficient_evidence").alias("reason"),
        F.size("models").alias("detectors_consulted"),
        F.size(F.filter("models", lambda x: ~x["abstained"])).alias("detectors_that_decided"),
        F.when(fake | real, none).otherwise(silent).alias("why_no_answer"),
    )


def content_key(files: DataFrame, content: str, key: str) -> DataFrame:
    return files.select(key, F.sha2(F.col(content), 256).alias("content_sha256"))


# --- scorers -----------------------------------------------------------------

SCORER_SCHEMA = "sample_id string, detector string, version string, score double, abstained boolean, reason string"


def isolated_scorer(items: DataFrame, detector: str, version: str, score: Callable[[pd.DataFrame], Sequence[float]]) -> DataFrame:
    """Run a vectorised scorer on Arrow batches; a row that raises abstains alone.

    ``score`` takes a frame and returns one number per row. A batch that raises
    is halved until only the rows at fault are left, so a clean batch costs one
    call and a bad row about two per halving.
    """

    def scored(pdf: pd.DataFrame) -> list[tuple[float | None, bool]]:
        try:
            values = np.asarray(score(pdf), dtype=float)
            if len(values) != len(pdf):
                raise ValueError("a scorer must return one number per row")
            return [(float(v), False) for v in values]
        except Exception:  # noqa: BLE001 - isolation is the point
            if len(pdf) == 1:
                return [(None, True)]
            half = len(pdf) // 2
            return scored(pdf.iloc[:half]) + scored(pdf.iloc[half:])

    def run(batches):
        for pdf in batches:
            got = scored(pdf) if len(pdf) else []
            fine = [not failed and np.isfinite(v) for v, failed in got]
            yield pd.DataFrame({
                "sample_id": pdf["sample_id"].to_numpy(), "detector": detector, "version": version,
                "score": [v if ok else None for (v, _), ok in zip(got, fine, strict=True)], "abstained": [not ok for ok in fine],
                "reason": ["detector_error" if failed else "ok" if ok else "not_measured" for (_, failed), ok in zip(got, fine, strict=True)],
            })

    return items.mapInPandas(run, schema=SCORER_SCHEMA)


def demoted(tprs: DataFrame, floor: float = K.MIN_ADVERSARIAL_TPR) -> DataFrame:
    """Detectors an attack blinds: evidence only, never a verdict. NULL is not a pass or a fail."""
    return tprs.where(F.col("adversarial_tpr") < floor)


def preregistered_verdict(a: DataFrame) -> DataFrame:
    """Five tri-state answers; NULL means the artefact does not exist.

    Spark's three-valued logic is the semantics: the first three questions ship
    the candidate only when all are TRUE, and a NULL never counts as a pass.
    """
    q2 = ~F.col("inside_null")
    q3 = F.col("colour_auc") <= F.lit(K.FROZEN_COLOUR_CONTROL + K.COLOUR_MARGIN)
    q4 = F.when(F.col("has_capture_run"), F.coalesce(F.col("session_auc") >= K.AUC_FLOOR, F.lit(False)))
    q5 = F.col("session_auc") > F.col("frozen_session_auc")
    lo, hi = F.col("session_ci_lo"), F.col("session_ci_hi")
    out = a.withColumns({"q1": F.col("improved"), "q2": q2, "q3": q3, "q4": q4, "q5": q5})
    qs = ["q1", "q2", "q3", "q4", "q5"]
    return out.withColumns({
        "ships": F.coalesce(F.col("q1") & F.col("q2") & F.col("q3"), F.lit(False)),
        "gate_would_open": F.coalesce(F.col("q4"), F.lit(False)),
        "floor_inside_interval": F.coalesce((lo <= K.AUC_FLOOR) & (hi >= K.AUC_FLOOR), F.lit(False)),
        "incomplete": F.concat_ws(",", *[F.when(F.col(q).isNull(), q) for q in qs]),
    })
