"""Writers for scores, labels and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.functions.scalar import decode_label, json_safe


FOLD_SCORES = "detector string, sample_id string, subject_id string, label int, score double, fold string"


def write_fold_scores(scores: DataFrame, path: str) -> None:
    """Out-of-fold scores of every detector, one folder per fold, for later paired comparison."""
    named = ["detector"] if "detector" in scores.columns else []
    scores.select(*named, "sample_id", "subject_id", F.col("label").cast("int").alias("label"), F.col("score").cast("double").alias("score"), "fold").write.mode("overwrite").partitionBy("fold").parquet(path)


def read_fold_scores(spark: SparkSession, path: str, fold: str | None = None) -> DataFrame:
    """What :func:`write_fold_scores` wrote; one fold reads its own folder only."""
    scores = spark.read.schema(FOLD_SCORES).parquet(path)
    return scores if fold is None else scores.where(F.col("fold") == fold)


def report_json(df: DataFrame) -> Column:
    """Rows as JSON text: fields in name order, non-finite numbers as null."""
    cols = []
    for f in sorted(df.schema.fields, key=lambda x: x.name):
        numeric = isinstance(f.dataType, (T.DoubleType, T.FloatType))
        cols.append((json_safe(f.name) if numeric else F.col(f.name)).alias(f.name))
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})


def write_report(df: DataFrame, path: str) -> None:
    df.select(report_json(df).alias("value")).write.mode("overwrite").text(path)


def decode_labels(df: DataFrame, columns: dict[str, Sequence[str]]) -> DataFrame:
    """Integer class codes to names; a code without a name stays as its digits."""
    for c, names in columns.items():
        df = df.withColumn(f"{c}_name", decode_label(names, c))
    return df


def export_decoded(df: DataFrame, columns: dict[str, Sequence[str]], path: str) -> None:
    decode_labels(df, columns).write.mode("overwrite").parquet(path)
