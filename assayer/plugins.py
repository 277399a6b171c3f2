"""Where users plug in: scorers, statistics, detections and attack results."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.scalar import clamp_box, meets_floor
from assayer.functions.seed import hash_int
from assayer.operators.observations import quality_floor
from assayer.operators.select import largest_detection


class Scorer(Protocol):
    """Observations in, one score row per sample out; the body may be Catalyst
    expressions or ``mapInPandas``."""

    name: str
    version: str
    min_band: str

    def __call__(self, observations: DataFrame) -> DataFrame: ...


@dataclass(frozen=True)
class ExpressionScorer:
    """Mean of an expression over the observations that meet the quality floor."""

    name: str
    version: str
    frame_score: Callable[[], Column]
    min_band: str = "low"

    def __call__(self, observations: DataFrame) -> DataFrame:
        usable = observations.where(meets_floor("band", self.min_band)).withColumn("_s", self.frame_score())
        return usable.groupBy("sample_id").agg(F.avg("_s").alias("score"))


@dataclass(frozen=True)
class SyntheticScorer:
    """Label-blind score from a hash of the payloads; duplicates accumulate."""

    name: str
    seed: int = 0
    version: str = "synthetic-1"
    min_band: str = "low"
    buckets: int = 10_000

    def __call__(self, observations: DataFrame) -> DataFrame:
        usable = observations.where(meets_floor("band", self.min_band))
        part = F.sum(hash_int(self.seed, "payload") % self.buckets)
        return usable.groupBy("sample_id").agg((part % self.buckets / self.buckets).alias("score"))


def run_scorers(samples: DataFrame, observations: DataFrame, scorers: Sequence[Scorer]) -> DataFrame:
    """The long scores table: every sample meets every scorer, scored or abstaining with a reason."""
    out = None
    for s in scorers:
        why = quality_floor(samples, observations, s.min_band).select("sample_id", F.col("reason").alias("_why"))
        rows = why.join(s(observations), "sample_id", "left").select(
            "sample_id", F.lit(s.name).alias("detector"), F.lit(s.version).alias("version"),
            F.when(F.col("_why").isNull(), F.col("score")).alias("score"),
            (F.col("_why").isNotNull() | F.col("score").isNull()).alias("abstained"),
            F.coalesce("_why", F.when(F.col("score").isNull(), "not_measured"), F.lit("ok")).alias("reason"))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no scorers given")
    return out


def face_regions(detections: DataFrame, frame: str, width: int, height: int, ties: Sequence[str]) -> DataFrame:
    """Injected detections to one clamped region per frame, or a reason."""
    best = largest_detection(detections, frame, ties)
    roi = clamp_box(F.lit(width), F.lit(height), F.col("x"), F.col("y"), F.col("w"), F.col("h"))
    return best.withColumn("roi", roi).select(frame, "roi", F.when(F.col("roi").isNull(), "degenerate_box").otherwise("ok").alias("reason"))


def adversarial_status(report: DataFrame, attacks: DataFrame | None, targets: DataFrame) -> DataFrame:
    """Attach attack results where they exist and say why where they do not.

    ``targets`` is (detector, weights_present): the detectors that offer an
    attack target at all.
    """
    if attacks is None:
        return report.select("*", F.lit(None).cast("double").alias("adversarial_tpr"), F.lit("not_requested").alias("adversarial_status"))
    j = report.join(targets.select("detector", "weights_present"), "detector", "left").join(attacks.select("detector", F.col("adversarial_tpr").alias("_t")), "detector", "left")
    status = (F.when(F.col("weights_present").isNull(), "no_target").when(~F.col("weights_present"), "weights_absent")
              .when(F.col("_t").isNull(), "not_measurable").otherwise("ok"))
    return j.select(*report.columns, F.when(status == "ok", F.col("_t")).alias("adversarial_tpr"), status.alias("adversarial_status"))
