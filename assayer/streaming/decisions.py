"""Streaming decisions: the batch pipeline inside ``foreachBatch``."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from assayer.operators import decide as C
from assayer.operators.metrics import status_counts
from assayer.session import ensure_checkpoint_dir


def decide_items(scores: DataFrame, curves: DataFrame, policy: C.Policy = C.Policy()) -> DataFrame:
    """Scores of settled items to finished rows: done with a verdict, or failed
    alone with its error text when every scorer raised on the item.

    The flag is taken in the grouping that fuses, so the scores are read, and
    the scorers run, once."""
    d = C.fuse(C.to_evidence(scores, curves), policy=policy, extra={"_f": F.bool_and(F.col("reason") == "detector_error")})
    return d.select(
        F.col("sample_id").alias("id"), F.when(F.col("_f"), "failed").otherwise("done").alias("status"), F.when(~F.col("_f"), F.col("verdict")).alias("verdict"),
        F.when(~F.col("_f"), F.col("llr_total")).alias("llr_total"), F.when(~F.col("_f"), F.col("disagreement")).alias("ood_score"),
        F.when(F.col("_f"), "every detector raised on this item").alias("error"))


def decide_stream(items: DataFrame, score: Callable[[DataFrame], DataFrame], curves: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch overwrites its own folder, so a replayed batch replaces
    its earlier attempt instead of doubling it."""

    def write(batch: DataFrame, batch_id: int) -> None:
        decide_items(score(batch), curves).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return items.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_counts(submissions: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Counts by status and verdict, kept current as submissions arrive."""

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    return status_counts(submissions).writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
