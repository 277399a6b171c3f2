"""Readers. Malformed input is set aside and named; it never stops a scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer import schema as K
from assayer.functions.scalar import corpus_label

_PARENT = r"([^/\\]+)[/\\][^/\\]+$"


def read_json_documents(spark: SparkSession, root: str, file_name: str) -> DataFrame:
    """One row per ``<root>/*/<file_name>``: path, parent folder, whole text."""
    text = spark.read.text(f"{root}/*/{file_name}", wholetext=True)
    return text.select(
        F.col("_metadata.file_path").alias("path"),
        F.regexp_extract(F.col("_metadata.file_path"), _PARENT, 1).alias("folder"),
        F.col("value").alias("text"),
    )


def once(df: DataFrame, *parsed: Column) -> DataFrame:
    """Add columns that are computed once per row however often they are read.

    Predicates are not pushed through a generator, so a filter on a parsed
    field cannot drag a second copy of the parse below itself.
    """
    return df.select("*", F.inline(F.array(F.struct(*parsed))))


def _truthy(x: Column) -> Column:
    return F.coalesce(~F.lower(F.trim(x)).isin("false", "0", "0.0", "", "null", "[]", "{}"), F.lit(False))


def _is_object(text: str) -> Column:
    """A well-formed JSON object; arrays, scalars and broken text are not."""
    return F.json_object_keys(F.col(text)).isNotNull()


def parse_sessions(docs: DataFrame, text: str = "text", folder: str = "folder") -> DataFrame:
    """Session documents to columns; ``reject_reason`` is NULL on the good rows."""
    d = F.from_json(F.col(text), K.SESSION_JSON, {"mode": "PERMISSIVE"})
    count = F.expr("try_cast(_d.frame_count AS int)")
    out = once(docs, d.alias("_d"), _is_object(text).alias("_ok"))
    reason = (
        F.when(~F.col("_ok"), "not_a_json_object")
        .when(F.col("_d.frame_count").isNotNull() & count.isNull(), "frame_count_not_an_integer")
    )
    return out.select(
        F.coalesce("_d.session_id", F.col(folder)).alias("session_id"),
        F.col(folder).alias("folder"),
        _truthy(F.col("_d.swapped")).alias("swapped"),
        _truthy(F.col("_d.decision.approved")).alias("approved"),
        F.col("_d.scan.verdict").alias("scan_verdict"),
        F.coalesce(count, F.lit(0)).alias("frame_count"),
        F.col("_d.frames").alias("frames"),
        reason.alias("reject_reason"),
    )


def good_and_rejected(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    return (
        parsed.where(F.col("reject_reason").isNull()).drop("reject_reason"),
        parsed.where(F.col("reject_reason").isNotNull()).select("folder", "reject_reason"),
    )


def explode_frames(sessions: DataFrame) -> DataFrame:
    """A row per frame; the frame's own label wins over the session's."""
    return sessions.withColumn("_f", F.explode("frames")).select(
        "session_id",
        F.col("_f.index").alias("frame_index"),
        F.coalesce(F.col("_f.saved_as"), F.concat(F.lit("frame_"), F.lpad(F.col("_f.index").cast("string"), 2, "0"), F.lit(".jpg"))).alias("file_name"),
        F.coalesce(F.col("_f.swapped"), F.col("swapped").cast("int"), F.lit(0)).alias("label"),
    )


def parse_vendor_results(docs: DataFrame, text: str = "text", key: str = "folder") -> DataFrame:
    """Vendor documents to score and verdict maps plus their summaries."""
    has = F.get_json_object(F.col(text), "$.models").isNotNull()
    parsed = once(docs.withColumnRenamed(key, "cache_key"), F.from_json(F.col(text), K.VENDOR_JSON).alias("_d"), _is_object(text).alias("_ok"), has.alias("_has"))
    none = F.array().cast(K.VENDOR_JSON["models"].dataType)
    flat = parsed.select("cache_key", "_d.verdict", "_d.score", F.col("_d.models").alias("_raw"), "_ok", "_has")
    flat = flat.select("*", F.coalesce("_raw", none).alias("_m"), F.reverse(F.transform(F.coalesce("_raw", none), lambda m: m["name"])).alias("_rev"))
    # a repeated model name keeps its last entry, as a later write would
    size = F.size("_m")
    last = F.filter("_m", lambda m, i: F.array_position("_rev", m["name"]) == size - i)
    broken = (F.col("_has") & F.col("_raw").isNull()) | F.exists("_m", lambda m: m["name"].isNull() | m["score"].isNull())
    ok = F.coalesce(F.col("_ok") & ~broken, F.lit(False))
    kept = flat.select("cache_key", F.coalesce("verdict", F.lit("")).alias("verdict"), "score", F.when(ok, last).alias("_l"))
    return kept.select(
        "cache_key", "verdict", "score",
        F.map_from_entries(F.transform("_l", lambda m: F.struct(m["name"], m["score"]))).alias("model_scores"),
        F.map_from_entries(F.transform("_l", lambda m: F.struct(m["name"], F.coalesce(m["verdict"], F.lit(""))))).alias("model_verdicts"),
        F.when(F.col("_l").isNull(), "unreadable").alias("reject_reason"),
        F.size("_l").alias("n_models"),
        F.size(F.filter("_l", lambda m: m["verdict"] == "MANIPULATED")).alias("n_manipulated"),
        F.array_max(F.transform("_l", lambda m: m["score"])).alias("max_model_score"),
    )


def require_columns(df: DataFrame, required: Sequence[str], what: str) -> None:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{what} is missing the column(s) {missing}; it has {sorted(df.columns)}")


def label_manifest(raw: DataFrame) -> DataFrame:
    """Manifest rows with 0/1 labels; any other token is kept as *unlabelled*."""
    require_columns(raw, ("item_id", "filename", "label", "domain"), "manifest")
    token = F.lower(F.trim(F.coalesce("label", F.lit(""))))
    code = F.lit(K.UNLABELLED)
    for name, value in K.LABEL_TOKENS.items():
        code = F.when(token == name, value).otherwise(code)
    return raw.select("item_id", "filename", code.alias("label"), "domain")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    header = spark.read.option("header", True).csv(path).limit(0)
    require_columns(header, ("item_id", "filename", "label", "domain"), "manifest")
    return label_manifest(spark.read.option("header", True).csv(path))


def scan_labelled_files(spark: SparkSession, root: str, labels: Sequence[str], glob: str = "*") -> DataFrame:
    """Files below ``root/<label>/``; content is only read if a caller selects it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return label_from_path(files, "path", labels)


def label_from_path(files: DataFrame, path: str, labels: Sequence[str]) -> DataFrame:
    """Keep rows whose path holds a label directory, and say which."""
    found = F.regexp_extract(F.col(path), "/(" + "|".join(labels) + ")/", 1)
    return files.withColumn("label_dir", found).where(found != "")


def require_all_labels(files: DataFrame, labels: Sequence[str]) -> None:
    seen = {r[0] for r in files.select("label_dir").distinct().limit(len(labels) + 1).collect()}
    missing = [x for x in labels if x not in seen]
    if missing:
        raise ValueError(f"corpus has no files under {missing}: both halves are required")


def relative_id(path: Column | str, root: Column | str) -> Column:
    """Path below the root, however deep."""
    p = F.col(path) if isinstance(path, str) else path
    r = F.col(root) if isinstance(root, str) else root
    return F.when(p.startswith(r), F.ltrim(F.substring(p, F.length(r) + 1, F.length(p)), F.lit("/")))


def scan_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    plain = lambda p: F.regexp_replace(p, "^file:/*", "/")
    return files.withColumn("sample_id", relative_id(plain(F.col("path")), plain(F.lit(root.rstrip("/")))))


def read_score_file(spark: SparkSession, path: str) -> DataFrame:
    """Raw lines of a score file, split but unjudged, header checked exactly."""
    lines = spark.read.text(path)
    first = lines.limit(1).collect()
    if not first or first[0][0].strip() != "sample_id,score":
        raise ValueError(f"{path}: expected header 'sample_id,score', got {first[0][0] if first else 'an empty file'!r}")
    body = spark.read.option("header", True).schema("sample_id string, score string, extra string").csv(path)
    return body.select(
        "sample_id", F.col("score").alias("raw_score"),
        F.when(F.col("extra").isNotNull(), 3).when(F.col("score").isNull(), 1).otherwise(2).alias("n_fields"),
    )
