"""Rank metrics from one compact score table.

Rows collapse to ``(key, score) -> positives, negatives`` before any ordering,
so tied scores cost one row and map-side aggregation does most of the work.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assayer.operators.ranking import BUCKET, null_safe_join, running, with_value_bucket


def compact(df: DataFrame, by: Sequence[str], score: str = "score", label: str = "label", weight: str | None = None) -> DataFrame:
    """Distinct finite scores per key with class counts; abstentions are left out."""
    w = F.col(weight) if weight else F.lit(1)
    s = F.col(score).cast("double")
    kept = df.where(s.isNotNull() & ~F.isnan(s) & (F.abs(s) < F.lit(float("inf"))))
    return kept.groupBy(*by, s.alias("score")).agg(
        F.sum(F.when(F.col(label) == 1, w).otherwise(0)).cast("bigint").alias("pos"),
        F.sum(F.when(F.col(label) == 0, w).otherwise(0)).cast("bigint").alias("neg"),
    )


def _ratio(numerator: Column, pos: Column, neg: Column) -> Column:
    return F.when((pos > 0) & (neg > 0), numerator / (pos.cast("double") * neg.cast("double")))


def auc(df: DataFrame, by: Sequence[str] = (), score: str = "score", label: str = "label", weight: str | None = None) -> DataFrame:
    """Mann-Whitney AUC per key; NULL when a class is absent.

    Each bucket contributes its own inversions plus ``positives x negatives in
    earlier buckets``; the bucket table is all that crosses the second shuffle.
    """
    return auc_of(compact(df, by, score, label, weight), by)


def auc_of(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """:func:`auc` of an already compact table."""
    by = list(by)
    b = with_value_bucket(cells, "score", alike=("pos", "neg"))
    lower = Window.partitionBy(*by, BUCKET).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    pieces = (
        b.withColumn("_below", F.coalesce(F.sum("neg").over(lower), F.lit(0)))
        .groupBy(*by, BUCKET)
        .agg(
            F.sum("pos").alias("_p"),
            F.sum("neg").alias("_n"),
            F.sum(F.col("pos") * (F.col("_below") + F.col("neg") / 2.0)).alias("_u"),
        )
    )
    earlier = Window.partitionBy(*by).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    whole = pieces.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    out = whole.groupBy(*by).agg(
        F.sum("_p").cast("bigint").alias("n_pos"),
        F.sum("_n").cast("bigint").alias("n_neg"),
        F.sum(F.col("_u") + F.col("_p").cast("double") * F.col("_before")).alias("_num"),
    )
    return out.select(*by, _ratio(F.col("_num"), F.col("n_pos"), F.col("n_neg")).alias("auc"), "n_pos", "n_neg")


def curve(df: DataFrame, by: Sequence[str] = (), score: str = "score", label: str = "label", weight: str | None = None) -> DataFrame:
    """The full ROC table: per distinct score, counts at it, below it, in total."""
    return curve_of(compact(df, by, score, label, weight), by)


def curve_of(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return running(cells, by, ["score"], ["pos", "neg"], bucket_on="score")


def _order_stat(rank: Column, count: str) -> Column:
    """The value at a 0-based rank, read off a running-count table."""
    return F.max(F.when((F.col(count) > 0) & (F.col(f"{count}_before") <= rank), F.col("score")))


def _interpolated(q: float, count: str) -> list[Column]:
    h = (F.col(f"{count}_total") - 1) * F.lit(q)
    return [_order_stat(F.floor(h), count), _order_stat(F.ceil(h), count), F.max(h - F.floor(h))]


def quantiles(df: DataFrame, by: Sequence[str], value: str, qs: dict[str, float]) -> DataFrame:
    """Exact linear-interpolated quantiles without gathering a key's values."""
    v = F.col(value).cast("double")
    return quantiles_of(df.where(v.isNotNull()).groupBy(*by, v.alias("score")).agg(F.count(F.lit(1)).alias("cnt")), by, qs)


def quantiles_of(cells: DataFrame, by: Sequence[str], qs: dict[str, float]) -> DataFrame:
    """:func:`quantiles` of a table of values (score) and their counts (cnt)."""
    by = list(by)
    r = running(cells, by, ["score"], ["cnt"], bucket_on="score")
    parts, finals = [], []
    for i, (name, q) in enumerate(qs.items()):
        lo, hi, frac = _interpolated(q, "cnt")
        parts += [lo.alias(f"_lo{i}"), hi.alias(f"_hi{i}"), frac.alias(f"_f{i}")]
        finals.append((F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_f{i}")).alias(name))
    return r.groupBy(*by).agg(*parts).select(*by, *finals)


def tpr_at_fpr(
    df: DataFrame, by: Sequence[str] = (), fprs: dict[str, float] | None = None,
    score: str = "score", label: str = "label", weight: str | None = None,
) -> DataFrame:
    """AUC plus, per named FPR, the share of positives strictly above the
    interpolated ``1 - fpr`` quantile of the negatives. NULL without both classes."""
    fprs = fprs if fprs is not None else {"tpr_at_1pct": 0.01}
    return tpr_of(compact(df, by, score, label, weight), by, fprs)


def tpr_of(cells: DataFrame, by: Sequence[str], fprs: dict[str, float]) -> DataFrame:
    """:func:`tpr_at_fpr` of an already compact table."""
    by = list(by)
    if any(not 0.0 <= f <= 1.0 for f in fprs.values()):
        raise ValueError(f"false-positive rates must lie in [0, 1]: {fprs}")
    r = curve_of(cells, by)
    p, n = F.max("pos_total"), F.max("neg_total")
    aggs = [
        _ratio(F.sum(F.col("pos").cast("double") * (F.col("neg_before") + F.col("neg") / 2.0)), p, n).alias("auc"),
        p.alias("n_pos"),
        n.alias("n_neg"),
    ]
    for i, f in enumerate(fprs.values()):
        lo, hi, frac = _interpolated(1.0 - f, "neg")
        aggs.append((lo + (hi - lo) * frac).alias(f"_thr{i}"))
    head = r.groupBy(*by).agg(*aggs)
    # reading both counts keeps this branch on the exchange the curve came from
    above = null_safe_join(cells.select(*by, "score", "pos", "neg"), head.drop("n_pos", "n_neg"), by)
    pos, neg = F.sum("pos"), F.sum("neg")
    hits = [
        F.when((pos > 0) & (neg > 0), F.sum(F.when(F.col("score") > F.col(f"_thr{i}"), F.col("pos")).otherwise(0)) / pos).alias(name)
        for i, name in enumerate(fprs)
    ]
    return above.groupBy(*by).agg(F.first("auc").alias("auc"), pos.alias("n_pos"), neg.alias("n_neg"), *hits)


def catch_at_budget(df: DataFrame, by: Sequence[str], budgets: dict[str, float], score: str = "score", label: str = "label") -> DataFrame:
    """Best share of positives at or above any observed threshold whose share
    of negatives at or above it stays within the budget."""
    r = curve(df, by, score, label)
    tpr = (F.col("pos_total") - F.col("pos_before")) / F.greatest(F.lit(1), F.col("pos_total"))
    fpr = (F.col("neg_total") - F.col("neg_before")) / F.greatest(F.lit(1), F.col("neg_total"))
    both = (F.max("pos_total") > 0) & (F.max("neg_total") > 0)
    return r.groupBy(*by).agg(
        *[F.when(both, F.coalesce(F.max(F.when(fpr <= b, tpr)), F.lit(0.0))).alias(name) for name, b in budgets.items()]
    )
