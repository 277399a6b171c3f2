"""Explicit schemas, vocabularies and fixed values."""

from __future__ import annotations

from pyspark.sql import types as T

S, D, I = T.StringType(), T.DoubleType(), T.IntegerType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


CURVES = _struct(
    ("detector", S), ("band", S), ("coef", D), ("intercept", D), ("prior", D), ("max_abs_llr", D), ("format_version", I),
)
SESSION_JSON = _struct(
    ("session_id", S), ("swapped", S), ("frame_count", S),
    ("decision", _struct(("approved", S))), ("scan", _struct(("verdict", S))),
    ("frames", T.ArrayType(_struct(("index", I), ("saved_as", S), ("swapped", I)))),
)
VENDOR_JSON = _struct(
    ("verdict", S), ("score", D), ("models", T.ArrayType(_struct(("name", S), ("score", D), ("verdict", S)))),
)

# --- fixed values: equal to the published behaviour, so results agree ---------
BANDS = ("reject", "low", "medium", "high")
VERDICT_NAMES = {
    "real": "AUTHENTIC",
    "fake": "MANIPULATED",
    "insufficient_evidence": "UNKNOWN",
    "out_of_distribution": "UNKNOWN",
}
MIN_IOD_REJECT, MIN_IOD_MEDIUM, MIN_IOD_HIGH = 32.0, 64.0, 96.0
MIN_BLUR, MIN_BLUR_HIGH = 20.0, 100.0
EXPOSURE_RANGE = (0.15, 0.90)
MAX_YAW_HIGH = 30.0
MAX_ABS_LLR, MAX_TOTAL_LLR = 6.0, 20.0
MIN_FIT_SAMPLES = 20
CURVE_FORMAT_VERSION = 1
AUDIT_SCHEMA_VERSION = "2"
MAX_PIXELS, MAX_FILE_BYTES, MAX_DURATION_S, DEFAULT_FPS = 7680 * 4320, 256 * 1024 * 1024, 1800.0, 25.0
LABEL_TOKENS = {"real": 0, "fake": 1}
UNLABELLED = -1
SNIFF_BYTES = 4096
PARTIAL_SUFFIXES = (".part", ".crdownload", ".tmp", ".partial", ".download")
STABLE_SCANS = 2
REQUIRED_COMPRESSION = ("c0", "c23", "c40")
AUC_FLOOR = 0.75
ORACLE_BAND = (0.40, 0.75)
CONTROL_ALARM_AUC = 0.90
MIN_GENUINE_PER_STRATUM = 150
MIN_ADVERSARIAL_TPR = 0.10
FROZEN_COLOUR_CONTROL, COLOUR_MARGIN = 0.530, 0.05
FAKE_THRESHOLD, REAL_THRESHOLD, DISAGREEMENT_OOD = 1.0, -1.0, 3.0
POLICY_VERSION = "assayer-default-1"
FRAME_INDEX_SUFFIX = r"(?:[ _-]\(?\d+\)?|\(\d+\))$"
# -----------------------------------------------------------------------------
