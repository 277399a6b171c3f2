"""From raw documents to packed training bins: five stages, each one operator of the llm subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm import lines, nearcopies, packing, store, substrings, toxicity

TOXIC_FROM = 0.7


def _measured(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents, n_chars brought up to the text."""
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")).select(columns)


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a score of 0.7 or more go. The labels of a third of the ids are never learned from."""
    usable = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1
    machine = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), usable)
    return toxicity.score(docs, machine, name="_score").where(F.col("_score") < TOXIC_FROM).drop("_score")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of three-line windows that occurred before go; every document stays."""
    return _measured(lines.drop_repeated_lines(docs), docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that of the smallest id."""
    return nearcopies.representatives(docs)


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of 50-word windows that a document of smaller id holds go; every document stays."""
    return _measured(substrings.drop_repeats(docs), docs.columns)


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of 4,096 words, no two pieces of a bin from one source or of one text."""
    rows = docs.select("doc_id", "source", packing.word_count().alias("n_words"), F.xxhash64("text").cast("string").alias("cluster"))
    return packing.pack(rows, cluster="cluster")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("substring_dedup", drop_passages),
    ("best_fit_packing", pack_bins),
]

#: The trained scores and the packing order are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each result written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
