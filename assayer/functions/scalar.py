"""Scalar semantics as Catalyst expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from assayer import schema as K

INF = float("inf")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def finite(x: Column | str) -> Column:
    """TRUE for a real number; FALSE for NULL, NaN and the infinities."""
    v = _c(x).cast("double")
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(INF))


def unmeasured_to_null(x: Column | str) -> Column:
    """NULL is the only way to say *not measured*; NaN would sort above everything."""
    v = _c(x).cast("double")
    return F.when(finite(v), v)


def exact_mean(x: Column | str) -> Column:
    """The mean of decimal figures held as doubles, the same in any order of rows.

    A sum of doubles depends on which row comes first, and a mean that lies on a
    threshold then falls on either side of it. Figures of up to six places are
    summed as whole millionths, units and rest apart so that neither overflows;
    a group with any other figure is averaged as doubles.
    """
    v = _c(x).cast("double")
    scaled = F.rint(v * 1e6)
    fits = (F.abs(v) < 1e9) & (scaled / 1e6 == v)
    k = F.when(fits, scaled).cast("bigint")
    units, rest = F.sum(F.floor(k / 1_000_000)), F.sum(F.pmod(k, F.lit(1_000_000)))
    total = units.cast("decimal(20,0)") * 1_000_000 + rest.cast("decimal(20,0)")
    return F.when(F.count_if(~fits) > 0, F.avg(v)).otherwise(total.cast("double") / 1e6 / F.count(v))


def quality_band(iod: Column | str, blur: Column | str, yaw: Column | str, exposure: Column | str) -> Column:
    iod, blur, yaw, exposure = _c(iod), _c(blur), _c(yaw), _c(exposure)
    lo, hi = K.EXPOSURE_RANGE
    return (
        F.when((iod < K.MIN_IOD_REJECT) | (blur < K.MIN_BLUR), "reject")
        .when(~exposure.between(lo, hi), "low")
        .when((iod >= K.MIN_IOD_HIGH) & (blur >= K.MIN_BLUR_HIGH) & (F.abs(yaw) <= K.MAX_YAW_HIGH), "high")
        .when(iod >= K.MIN_IOD_MEDIUM, "medium")
        .otherwise("low")
    )


def band_rank(band: Column | str) -> Column:
    """1 for reject up to 4 for high; NULL for an unmeasured band, 0 for an unknown one."""
    return F.array_position(F.array(*[F.lit(b) for b in K.BANDS]), _c(band)).cast("int")


def band_of_rank(rank: Column) -> Column:
    return F.get(F.array(*[F.lit(b) for b in K.BANDS]), rank - 1)


def meets_floor(band: Column | str, floor: str) -> Column:
    return band_rank(band) >= K.BANDS.index(floor) + 1


def clamp_box(width: Column, height: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    """Intersection with the frame as a struct; NULL when thinner than two pixels."""
    x0, y0 = F.greatest(F.lit(0), x), F.greatest(F.lit(0), y)
    x1, y1 = F.least(width, x + w), F.least(height, y + h)
    box = F.struct(x0.alias("x"), y0.alias("y"), (x1 - x0).alias("w"), (y1 - y0).alias("h"))
    return F.when((x1 - x0 >= 2) & (y1 - y0 >= 2), box)


def source_family(label_dir: Column | str, filename: Column | str) -> Column:
    """Directory plus the stem without its trailing frame index."""
    stem = F.regexp_replace(_c(filename), r"^(.+)\.[^.]+$", "$1")
    family = F.regexp_replace(stem, K.FRAME_INDEX_SUFFIX, "")
    known = (family != stem) & (family != "")
    return F.concat(_c(label_dir), F.lit("/"), F.when(known, family).otherwise("unnumbered"))


def stratum_key(a: Column | str, b: Column | str) -> Column:
    a, b = _c(a), _c(b)
    return F.when(a.isNotNull() & b.isNotNull(), F.concat_ws("|", a, b))


def class_of(generator: Column | str) -> Column:
    return F.coalesce(_c(generator), F.lit("real"))


def verdict_name(verdict: Column | str) -> Column:
    v, out = _c(verdict), F.lit("UNKNOWN")
    for raw, name in K.VERDICT_NAMES.items():
        out = F.when(v == raw, name).otherwise(out)
    return out


def model_verdict(abstained: Column | str, llr: Column | str) -> Column:
    spoke = ~F.coalesce(_c(abstained), F.lit(False))
    return F.when(spoke & (_c(llr) > 0), "MANIPULATED").when(spoke & (_c(llr) < 0), "AUTHENTIC")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def linear_probability(features: Column, mean: Sequence[float], scale: Sequence[float], weights: Sequence[float], bias: float) -> Column:
    """Standardise, project, squash. The parameters travel as three array
    literals, so the expression is as small at 768 features as at one; a zero
    scale counts as one."""
    array = lambda v: F.lit([float(x) for x in v])
    slope = [float(w) / (float(s) or 1.0) for w, s in zip(weights, scale, strict=True)]
    centred = F.zip_with(features, array(mean), lambda x, m: x - m)
    return 1.0 / (1.0 + F.exp(-(dot(centred, array(slope)) + F.lit(float(bias)))))


def feature_blocks(features: Column | str, first: int, width: int) -> tuple[Column, Column]:
    """The array's leading ``first`` columns and the rest; any other width fails the job."""
    v = _c(features)
    checked = F.when(F.size(v) == width, v).otherwise(F.raise_error(F.concat(F.lit("feature width "), F.size(v).cast("string"))))
    return F.slice(checked, 1, first), F.slice(checked, first + 1, width - first)


def l2_normalise(v: Column | str, floor: float = 1e-12) -> Column:
    d = _c(v).cast("array<double>")
    norm = F.greatest(F.sqrt(F.aggregate(d, F.lit(0.0), lambda a, x: a + x * x)), F.lit(floor))
    return F.transform(d, lambda x: x / norm)


def media_suffix(content: Column | str) -> Column:
    """File type from unmistakable leading bytes, else NULL."""
    head = F.hex(F.substring(_c(content), 1, 32))
    deep = F.hex(F.substring(_c(content), 1, K.SNIFF_BYTES))
    kind = F.substring(head, 17, 8)

    def has(text: str) -> Column:
        # a hex match only counts on a byte boundary, hence the pairwise prefix
        return deep.rlike("^(?:[0-9A-F]{2})*?" + text.encode().hex().upper())

    riff = F.when(kind == "57454250", ".webp").when(kind == "41564920", ".avi")
    ebml = F.when(has("webm"), ".webm").when(has("matroska"), ".mkv")
    return F.when(F.length(_c(content)) < 12, None).otherwise(
        F.when(head.startswith("FFD8FF"), ".jpg")
        .when(head.startswith("89504E470D0A1A0A"), ".png")
        .when(head.startswith("424D"), ".bmp")
        .when(head.startswith("52494646"), riff)
        .when(F.substring(head, 9, 8) == "66747970", F.when(kind == "71742020", ".mov").otherwise(".mp4"))
        .when(head.startswith("1A45DFA3"), ebml)
    )


def admission_reason(file_bytes: Column, width: Column, height: Column, frames: Column, fps: Column) -> Column:
    """First limit a file's header breaks, or NULL when it may be decoded."""
    rate = F.when(finite(fps) & (fps > 0), fps).otherwise(F.lit(K.DEFAULT_FPS))
    return (
        F.when(file_bytes > K.MAX_FILE_BYTES, "file_too_large")
        .when((width <= 0) | (height <= 0), "invalid_dimensions")
        .when(width.cast("bigint") * height.cast("bigint") > K.MAX_PIXELS, "too_many_pixels")
        .when((frames > 0) & (frames / rate > K.MAX_DURATION_S), "too_long")
    )


def decode_label(names: Sequence[str], code: Column | str) -> Column:
    c = _c(code).cast("int")
    names_col = F.array(*[F.lit(n) for n in names])
    return F.coalesce(F.when(c >= 0, F.get(names_col, c)), c.cast("string"), F.lit("None"))


def corpus_label(path: Column | str) -> Column:
    """Last real path component on either separator; never a path."""
    parts = F.filter(F.split(F.regexp_replace(_c(path), r"\\", "/"), "/"), lambda p: ~p.isin("", ".", ".."))
    return F.coalesce(F.when(F.size(parts) > 0, F.element_at(parts, -1)), F.lit("unknown"))


def json_safe(x: Column | str) -> Column:
    return unmeasured_to_null(x)
