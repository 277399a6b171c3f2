"""Checks on tables before they are trusted: each returns its violations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer import schema as K
from assayer.functions.scalar import finite


def score_file_violations(rows: DataFrame, known: DataFrame) -> DataFrame:
    """(violation, sample_id, n) for every broken rule; empty means accepted.

    One pass over the rows plus one anti-join: duplicates, unparsable and
    non-finite scores all come from a single grouping on ``sample_id``.
    """
    value = F.expr("try_cast(trim(raw_score) AS double)")
    per_id = rows.groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("n_fields") != 2).alias("bad_fields"),
        F.count_if((F.col("n_fields") == 2) & value.isNull()).alias("unparsable"),
        F.count_if(value.isNotNull() & ~finite(value)).alias("non_finite"),
    )
    marked = per_id.join(known.select("sample_id").distinct().withColumn("_known", F.lit(True)), "sample_id", "left")
    kinds = F.array(
        F.struct(F.lit("duplicate_id").alias("violation"), F.when(F.col("n") > 1, F.col("n")).otherwise(0).alias("n")),
        F.struct(F.lit("field_count").alias("violation"), F.col("bad_fields").alias("n")),
        F.struct(F.lit("unparsable_score").alias("violation"), F.col("unparsable").alias("n")),
        F.struct(F.lit("non_finite_score").alias("violation"), F.col("non_finite").alias("n")),
        F.struct(F.lit("unknown_id").alias("violation"), F.when(F.col("_known").isNull(), F.col("n")).otherwise(0).alias("n")),
    )
    return marked.select("sample_id", F.inline(kinds)).where(F.col("n") > 0).select("violation", "sample_id", "n")


def accept_score_file(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Typed scores, or a refusal that names the first offences."""
    if rows.isEmpty():
        raise ValueError("the score file has no rows; list every sample, abstaining ones too")
    bad = score_file_violations(rows, known).limit(5).collect()
    if bad:
        raise ValueError("score file refused: " + "; ".join(f"{r.violation} {r.sample_id!r}" for r in bad))
    return rows.select("sample_id", F.col("raw_score").cast("double").alias("score"))


def coverage(scores: DataFrame, known: DataFrame) -> DataFrame:
    """One row: covered, total and their ratio; never thresholded."""
    hit = known.select("sample_id").join(scores.select("sample_id", F.lit(1).alias("_hit")).distinct(), "sample_id", "left")
    return hit.agg(
        F.count("_hit").alias("covered"),
        F.count(F.lit(1)).alias("total"),
        F.when(F.count(F.lit(1)) > 0, F.count("_hit") / F.count(F.lit(1))).alias("coverage"),
    )


def missing_ids(scores: DataFrame, known: DataFrame) -> DataFrame:
    return known.select("sample_id").join(scores, "sample_id", "left_anti")


def aligned(records: DataFrame, scores: DataFrame) -> DataFrame:
    """Records that were scored, with the score; nothing is filled in."""
    return records.join(scores, "sample_id")


def curve_violations(curves: DataFrame) -> DataFrame:
    """Stored calibration curves that must not be loaded, with the reason."""
    reason = (
        F.when(F.col("format_version") != K.CURVE_FORMAT_VERSION, "format_version")
        .when(~finite("coef") | ~finite("intercept") | ~finite("prior") | ~finite("max_abs_llr"), "non_finite")
        .when(~F.col("band").isin(*K.BANDS), "unknown_band")
    )
    return curves.withColumn("reason", reason).where(reason.isNotNull()).select("detector", "band", "reason")


def save_curves(curves: DataFrame, path: str) -> None:
    if not curve_violations(curves).isEmpty():
        raise ValueError("refusing to store a non-finite or mis-versioned calibration curve")
    curves.coalesce(1).write.mode("overwrite").parquet(path)


def load_curves(spark: SparkSession, path: str) -> DataFrame:
    curves = spark.read.schema(K.CURVES).parquet(path)
    if not curve_violations(curves).isEmpty():
        raise ValueError(f"{path} holds a curve this version cannot use")
    return curves


def audit_violations(rows: DataFrame) -> DataFrame:
    """(sample_id, field, problem) for audit inputs that must be refused."""
    v = lambda field, bad, problem: F.when(bad, F.struct(F.lit(field).alias("field"), F.lit(problem).alias("problem")))
    iso = F.col("created_at").rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?([+-]\d{2}:\d{2}|Z)?)?$")
    stamp = F.expr("try_to_timestamp(created_at)")
    problems = F.array(
        v("sample_id", F.coalesce(F.col("sample_id") == "", F.lit(True)), "empty"),
        v("input_sha256", ~F.coalesce(F.col("input_sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)), "not_a_sha256"),
        v("created_at", F.col("created_at").isNotNull() & ~(iso & stamp.isNotNull()), "not_iso_8601"),
        v("llr_total", ~finite("llr_total"), "not_finite"),
        v("posterior", ~finite("posterior"), "not_finite"),
    )
    return rows.select("row_id", F.inline(F.filter(problems, lambda p: p.isNotNull())))
