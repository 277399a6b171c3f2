"""Views over the test tables that stand in for records, scores and events.

Each view exists twice: as a DataFrame for Spark and as a SQL text the checking
engine runs. The two are written separately on purpose.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.functions.scalar import quality_band


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "string(event_id) AS sample_id",
        "'s' || event_id AS source_id",
        "'u' || user_id AS subject_id",
        "if(event_type IN ('view', 'click'), NULL, event_type) AS generator",
        "if(event_type IN ('view', 'click'), 0, 1) AS label",
        "elt(int(event_id % 3) + 1, 'c0', 'c23', 'c40') AS compression",
        "'g' || (user_id % 4) AS stratum",
        "'d' || (user_id % 20) AS domain",
        "double(20 + event_id % 100) AS inter_ocular_px",
        "value AS blur_var",
        "double(user_id % 60 - 10) AS yaw_deg",
        "double(regexp_extract(props, '([0-9]+)', 1)) / 100 AS exposure",
        "ts",
        "value",
    )


def banded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).withColumn("band", quality_band("inter_ocular_px", "blur_var", "yaw_deg", "exposure"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long detector scores with their record columns, from one narrow scan."""
    return banded(spark, sf_dir).selectExpr(
        "*",
        """inline(array(
          struct('d_value' AS detector, if(band = 'reject', NULL, value / (value + 50)) AS score),
          struct('d_exposure' AS detector, if(band IN ('reject', 'low'), NULL, exposure) AS score),
          struct('d_iod' AS detector, inter_ocular_px / 120 AS score)))""",
    )


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return d.join(lab, "doc_id").select(
        F.col("doc_id").cast("string").alias("sample_id"),
        F.col("source").alias("domain"),
        F.col("lang").alias("stratum"),
        F.col("quality").alias("label"),
        "toxic",
        F.col("n_chars").cast("double").alias("score"),
        F.sha2("text", 256).alias("content_sha256"),
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    n = F.length("text")
    return c.select(
        F.concat(F.lit("c"), "conv_id").alias("session_id"),
        F.col("turn").alias("t"),
        (F.col("conv_id") % 2).alias("label"),
        F.when(F.col("role") == "system", "low").when(F.col("role") == "user", "medium").otherwise("high").alias("band"),
        (n / (n + 200).cast("double")).alias("score"),
    )


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    done = F.col("o_orderstatus") == "F"
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderdate").alias("received_at"),
        F.when(done, "done").when(F.col("o_orderstatus") == "O", "queued").otherwise("running").alias("status"),
        F.when(done, F.col("o_orderpriority")).alias("verdict"),
    )


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    q = F.floor("l_quantity").cast("int")
    return li.select(
        F.col("l_orderkey").alias("frame_id"),
        F.col("l_linenumber").alias("ordinal"),
        (q - 5).alias("x"),
        (F.col("l_linenumber") * 3 - 5).alias("y"),
        q.alias("w"),
        (F.lit(10) + F.col("l_partkey") % 40).alias("h"),
        F.col("l_discount").alias("score"),
        "l_partkey",
        "l_suppkey",
    )


def identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("sample_id"),
        F.concat(F.lit("p"), F.col("label").cast("string")).alias("subject_id"),
        "embedding",
    )


# --- the same views for the checking engine ----------------------------------
_NEEDS = {"fx_banded": ("fx_records",), "fx_scores": ("fx_banded",), "fx_joined": ("fx_scores",)}

_TEXT = {
    "fx_records": """
SELECT cast(event_id AS string) sample_id, concat('s', event_id) source_id, concat('u', user_id) subject_id,
  CASE WHEN event_type IN ('view','click') THEN NULL ELSE event_type END generator,
  CASE WHEN event_type IN ('view','click') THEN 0 ELSE 1 END AS label,
  CASE event_id % 3 WHEN 0 THEN 'c0' WHEN 1 THEN 'c23' ELSE 'c40' END compression,
  concat('g', user_id % 4) stratum, concat('d', user_id % 20) AS "domain",
  cast(20 + event_id % 100 AS double) inter_ocular_px, value blur_var, cast(user_id % 60 - 10 AS double) yaw_deg,
  cast(regexp_extract(props, '([0-9]+)', 1) AS double) / 100 exposure, ts, value
FROM events""",
    "fx_banded": """
SELECT *, CASE WHEN inter_ocular_px < 32 OR blur_var < 20 THEN 'reject'
  WHEN NOT (exposure BETWEEN 0.15 AND 0.90) THEN 'low'
  WHEN inter_ocular_px >= 96 AND blur_var >= 100 AND abs(yaw_deg) <= 30 THEN 'high'
  WHEN inter_ocular_px >= 64 THEN 'medium' ELSE 'low' END band FROM fx_records""",
    "fx_scores": """
SELECT sample_id, 'd_value' detector, CASE WHEN band = 'reject' THEN NULL ELSE value/(value+50) END score FROM fx_banded
UNION ALL SELECT sample_id, 'd_exposure', CASE WHEN band IN ('reject','low') THEN NULL ELSE exposure END FROM fx_banded
UNION ALL SELECT sample_id, 'd_iod', inter_ocular_px/120 FROM fx_banded""",
    "fx_joined": """
SELECT s.detector, s.score, b.* FROM fx_scores s JOIN fx_banded b ON b.sample_id = s.sample_id""",
    "fx_docs": """
SELECT cast(d.doc_id AS string) sample_id, d.source AS "domain", d.lang stratum, l.quality AS label, l.toxic,
  cast(d.n_chars AS double) score, sha256(d.text) content_sha256
FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    "fx_frames": """
SELECT concat('c', conv_id) session_id, turn t, conv_id % 2 AS label,
  CASE role WHEN 'system' THEN 'low' WHEN 'user' THEN 'medium' ELSE 'high' END band,
  length(text) / cast(length(text) + 200 AS double) score FROM conversations""",
    "fx_submissions": """
SELECT o_orderkey id, o_orderdate received_at,
  CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'queued' ELSE 'running' END status,
  CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END verdict FROM orders""",
    "fx_detections": """
SELECT l_orderkey frame_id, l_linenumber ordinal, cast(floor(l_quantity) AS int) - 5 x, l_linenumber*3 - 5 y,
  cast(floor(l_quantity) AS int) w, 10 + l_partkey % 40 h, l_discount score, l_partkey, l_suppkey FROM lineitem""",
    "fx_embeddings": """
SELECT cast(vec_id AS string) sample_id, concat('p', label) subject_id, embedding FROM embeddings""",
}


def with_views(body: str, views: tuple[str, ...]) -> str:
    """Prefix a SQL body with the views it reads, in dependency order."""
    order: list[str] = []

    def add(v: str) -> None:
        for d in _NEEDS.get(v, ()):
            add(d)
        if v not in order:
            order.append(v)

    for v in views:
        add(v)
    if not order:
        return body
    head = ",\n".join(f"{v} AS ({_TEXT[v].strip()})" for v in order)
    text = body.strip()
    rest = ",\n" + text[4:].lstrip() if text[:4].upper() == "WITH" else "\n" + text
    return f"WITH {head}{rest}"
