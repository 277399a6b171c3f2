"""Tables kept in the folder every executor can reach, and sizes read from the data."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.session import ensure_checkpoint_dir

#: Text that one chunk of documents holds on average; a chunk is what one task has in memory at a time.
CHUNK_BYTES = 8 << 20
#: Bytes of an Arrow batch that goes to a worker.
BATCH_BYTES = 8 << 20


def shared_path(spark: SparkSession, what: str) -> str:
    """A new folder name below the session's checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{what}-{uuid.uuid4().hex}"


def keep(df: DataFrame, what: str = "table") -> DataFrame:
    """Write a table to the shared folder and read it back: no lineage, known size, survives lost executors."""
    path = shared_path(df.sparkSession, what)
    df.write.parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    kept._kept = path
    return kept


def release(*tables: DataFrame) -> None:
    """Remove kept tables whose last reader is done."""
    for t in tables:
        jvm, conf = t.sparkSession._jvm, t.sparkSession.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(t._kept)
        path.getFileSystem(conf).delete(path, True)


def bounded_batches(spark: SparkSession) -> None:
    """Let Arrow batches go by bytes: 10,000 long texts in one would fill a worker. A smaller limit stays as it is."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name).rstrip("bB")
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def chunk_count(docs: DataFrame, text: str = "text", chunk_bytes: int = CHUNK_BYTES) -> int:
    """How many chunks bound the text in one: by bytes, and at least one for each shuffle partition."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(partitions(docs.sparkSession), -(-total // chunk_bytes))


def rows_of(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that extra ones never clash with an operator's own."""
    return docs.select(*[F.col(f"`{c}`") for c in columns])
