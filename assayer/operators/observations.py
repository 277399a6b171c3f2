"""From observations of a sample to what the sample may be used for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.functions.scalar import band_of_rank, band_rank, meets_floor


def worst_band(obs: DataFrame, key: str = "sample_id", band: str = "band") -> DataFrame:
    """Lowest measured band per sample, ``unmeasured`` when none was measured."""
    return obs.groupBy(key).agg(F.min(band_rank(band)).alias("_r")).select(
        key, F.coalesce(band_of_rank(F.col("_r")), F.lit("unmeasured")).alias("worst_band")
    )


def aggregate_reasons(samples: DataFrame, obs: DataFrame, key: str = "sample_id") -> DataFrame:
    """One reason per sample; samples without observations are kept.

    ``min`` and ``max`` decide *single distinct reason* with a map-side
    aggregate, where a distinct count would shuffle twice.
    """
    per = obs.groupBy(key).agg(
        F.bool_or(F.col("reason") == "ok").alias("_ok"), F.min("reason").alias("_lo"), F.max("reason").alias("_hi")
    )
    reason = (
        F.when(F.col("_lo").isNull(), "no_observations")
        .when(F.col("_ok"), "ok")
        .when(F.col("_lo") == F.col("_hi"), F.col("_lo"))
        .otherwise("mixed")
    )
    return samples.join(per, key, "left").select(key, reason.alias("reason"))


def quality_floor(samples: DataFrame, obs: DataFrame, floor: str, key: str = "sample_id") -> DataFrame:
    """Usable observations per sample, or why there are none."""
    per = obs.groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(meets_floor("band", floor)).alias("_usable"),
        F.count("band").alias("_measured"),
    )
    n, usable, measured = (F.coalesce(c, F.lit(0)) for c in ("_n", "_usable", "_measured"))
    reason = (
        F.when(n == 0, "no_observations")
        .when(usable > 0, None)
        .when(measured > 0, "below_quality_floor")
        .otherwise("quality_not_measured")
    )
    return samples.join(per, key, "left").select(key, n.alias("n_observations"), usable.alias("n_usable"), reason.alias("reason"))


def abstain(rows: DataFrame, detector: str, version: str, reason: str) -> DataFrame:
    return rows.select(
        "sample_id",
        F.lit(detector).alias("detector"),
        F.lit(version).alias("version"),
        F.lit(None).cast("double").alias("score"),
        F.lit(True).alias("abstained"),
        F.lit(reason).alias("reason"),
    )


def face_subset(records: DataFrame) -> DataFrame:
    return records.where(F.col("has_face"))
