"""Grouped bootstrap, paired differences and permutation tests.

Groups are numbered once, and rows carry their group's number. Which replicates
drew a group follows from its number alone (see draws.py), so every task makes
the draws of its own rows: nothing that grows with the replicates is joined on
or moved with rows. For the AUC rows go to their score bucket, for the mean
groups go to ranges; a task multiplies its counts by a matrix of draws and
leaves a few numbers per replicate.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assayer.functions.scalar import finite
from assayer.operators.curve import auc_of, tpr_of
from assayer.operators.draws import multiplicities
from assayer.operators.ranking import BUCKET, hash_rank, is_heavy, null_safe_join, with_value_bucket
from assayer.session import shared

STATISTICS = ("auc", "tpr_at_fpr", "mean")
MATRIX_CELLS = 8_000_000  # rows x replicates one task makes draws for at a time
COUNTED_CELLS = 1_000_000  # and multiplies with their counts at a time
RANGE_GROUPS = 4096  # groups summed together
PLAIN = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}


def numbered(groups: DataFrame, by: Sequence[str], group: str, replicates: int, seed: int) -> DataFrame:
    """(by, group, place, n): each group's number from 0 in a seeded order, and how many groups there are."""
    if replicates < 1:
        raise ValueError(f"replicates must be at least 1, got {replicates}")
    return hash_rank(groups.select(*by, group).distinct(), by, group, seed).select(*by, group, (F.col("rank") - 1).alias("place"), "n")


def draws(groups: DataFrame, by: Sequence[str], group: str, replicates: int, seed: int) -> DataFrame:
    """(by, group, reps): the replicates that drew each group, with repeats."""

    def run(n: pa.Array, place: pa.Array) -> pa.Array:
        total, at = n.to_numpy(zero_copy_only=False), place.to_numpy(zero_copy_only=False)
        reps = np.empty(len(total), object)
        for one in np.unique(total):
            own = np.flatnonzero(total == one)
            times = multiplicities(seed, int(one), at[own], replicates)
            reps[own] = [np.repeat(np.arange(replicates, dtype=np.int32), w) for w in times]
        return pa.array(reps.tolist(), pa.list_(pa.int32()))

    drawn = numbered(groups, by, group, replicates, seed).withColumn("reps", F.arrow_udf(run, "array<int>")("n", "place"))
    return drawn.where(F.size("reps") > 0).select(*by, group, "reps")


def _cells(df: DataFrame, keys: Sequence[str], group: str, score: str, label: str) -> DataFrame:
    s = F.col(score).cast("double")
    return df.where(finite(score)).groupBy(*keys, group, s.alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))


def replicate_cells(df: DataFrame, by: Sequence[str], group: str, replicates: int, seed: int, arms: Sequence[str] = (),
                    score: str = "score", label: str = "label") -> DataFrame:
    """(by, arms, rep, score, pos, neg): each replicate's compact score table.

    ``arms`` columns share one set of draws, which is what makes differences
    between arms paired.
    """
    cells = shared(_cells(df, [*by, *arms], group, score, label))
    d = draws(cells, by, group, replicates, seed)
    x = null_safe_join(cells, d, [*by, group]).withColumn("rep", F.explode("reps"))
    return shared(x.groupBy(*by, *arms, "rep", "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")))


def _typed(df: DataFrame, keys: Sequence[str], rest: str) -> tuple[pa.Schema, str]:
    """Arrow and Spark forms of plain key columns followed by `rest`."""
    kinds = {k: dict(df.dtypes)[k] for k in keys}
    if not set(kinds.values()) <= set(PLAIN):
        raise TypeError(f"keys must be plain columns, got {kinds}")
    numbers = [(name, PLAIN[{"long": "bigint"}.get(kind, kind)]) for name, kind in (x.split() for x in rest.split(", "))]
    return pa.schema([(k, PLAIN[kinds[k]]) for k in keys] + numbers), ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), rest])


def _fixed(key: tuple, keys: Sequence[str], schema: pa.Schema, replicates: int) -> list[pa.Array]:
    """A group's key once for each replicate, and the replicates."""
    return [*(pa.array([k.as_py()] * replicates, schema.field(i).type) for i, k in enumerate(key[: len(keys)])), pa.array(np.arange(replicates, dtype="int32"))]


def _count_bucket(keys: Sequence[str], replicates: int, seed: int, schema: pa.Schema) -> Callable:
    """Positives, negatives and inversions per replicate inside one bucket."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        place, groups = table.column("place").to_numpy(), table.column("n")[0].as_py()
        scores, pos, neg = (table.column(c).to_numpy() for c in ("score", "pos", "neg"))
        order = np.argsort(scores, kind="stable")
        p, n, u = np.zeros(replicates), np.zeros(replicates), np.zeros(replicates)
        step, part = max(1, MATRIX_CELLS // replicates), max(1, COUNTED_CELLS // replicates)
        last, open_ = None, np.zeros((2, 1, replicates))  # the value that later rows may still carry, and its counts
        for at in range(0, len(order), step):
            w = multiplicities(seed, groups, place[order[at : at + step]], replicates)
            for lo in range(0, len(w), part):
                rows, times = order[at + lo : at + min(lo + part, len(w))], w[lo : lo + part]
                value = scores[rows]
                heads = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1])))
                a, b = (np.add.reduceat(times * c[rows, None], heads, axis=0).astype(float) for c in (pos, neg))
                if value[0] == last:
                    a[0] += open_[0][0]
                    b[0] += open_[1][0]
                else:
                    a, b = np.concatenate((open_[0], a)), np.concatenate((open_[1], b))
                last, open_ = value[-1], np.stack((a[-1:], b[-1:]))
                a, b = a[:-1], b[:-1]
                u += (a * (n + np.cumsum(b, axis=0) - b / 2.0)).sum(axis=0)
                p, n = p + a.sum(axis=0), n + b.sum(axis=0)
        u += open_[0][0] * (n + open_[1][0] / 2.0)
        p, n = p + open_[0][0], n + open_[1][0]
        return pa.Table.from_arrays([*_fixed(key, keys, schema, replicates), pa.array(p), pa.array(n), pa.array(u)], schema=schema)

    return run


def replicate_auc(df: DataFrame, by: Sequence[str], group: str, replicates: int, seed: int, arms: Sequence[str] = (),
                  score: str = "score", label: str = "label") -> DataFrame:
    """(by, arms, rep, stat): the AUC of every replicate, NULL where undefined.

    A score carried by a large part of the cells is its own bucket and is split
    into ranges of groups: a single value has no order inside it, so its counts
    just add up. A range holds as many groups as a bucket rows: every call makes
    its draws from all groups down, so many small ones would cost far more.
    """
    cells = shared(_cells(df, [*by, *arms], group, score, label))
    rows = max(500, MATRIX_CELLS // replicates)
    keys = [*by, *arms]
    b = with_value_bucket(cells, "score", alike=("pos", "neg"), rows=rows)
    x = null_safe_join(b, numbered(cells, by, group, replicates, seed), [*by, group])
    spread = F.floor(F.col("place") / rows)
    x = x.select(*keys, BUCKET, "score", "pos", "neg", "place", "n", is_heavy(F.col(BUCKET)).alias("_heavy"), F.when(is_heavy(F.col(BUCKET)), spread).otherwise(0).alias("_range"))
    out = [*keys, BUCKET, "_heavy"]
    schema, ddl = _typed(x, out, "rep int, _p double, _n double, _u double")
    parts = x.groupBy(*out, "_range").applyInArrow(_count_bucket(out, replicates, seed, schema), ddl)
    whole = parts.groupBy(*out, "rep").agg(F.sum("_p").alias("_p"), F.sum("_n").alias("_n"), F.sum("_u").alias("_u"))
    lower = Window.partitionBy(*keys, "rep").orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("_n").over(lower), F.lit(0.0))
    inside = F.when(F.col("_heavy"), F.col("_p") * F.col("_n") / 2.0).otherwise(F.col("_u"))
    g = whole.select(*keys, "rep", "_p", "_n", (inside + F.col("_p") * below).alias("_w")).groupBy(*keys, "rep").agg(
        F.sum("_w").alias("_w"), F.sum("_p").alias("_p"), F.sum("_n").alias("_n"))
    return g.select(*keys, "rep", F.when((F.col("_p") > 0) & (F.col("_n") > 0), F.col("_w") / (F.col("_p") * F.col("_n"))).alias("stat"))


def _sum_range(keys: Sequence[str], replicates: int, seed: int, schema: pa.Schema) -> Callable:
    def run(key: tuple, table: pa.Table) -> pa.Table:
        total = np.zeros((replicates, 2))
        step = max(1, MATRIX_CELLS // replicates)
        for at in range(0, table.num_rows, step):
            part = table.slice(at, step)
            w = multiplicities(seed, part.column("n")[0].as_py(), part.column("place").to_numpy(), replicates)
            total += w.T @ np.column_stack([part.column("_s").to_numpy(), part.column("_c").to_numpy()])
        return pa.Table.from_arrays([*_fixed(key, keys, schema, replicates), pa.array(total[:, 0]), pa.array(total[:, 1])], schema=schema)

    return run


def replicate_mean(df: DataFrame, by: Sequence[str], group: str, replicates: int, seed: int, score: str = "score") -> DataFrame:
    """(by, rep, stat): the mean finite score of every replicate, from one sum and count per group."""
    s = F.col(score).cast("double")
    sums = shared(df.where(finite(score)).groupBy(*by, group).agg(F.sum(s).alias("_s"), F.count(F.lit(1)).cast("double").alias("_c")))
    x = null_safe_join(sums, numbered(sums, by, group, replicates, seed), [*by, group]).withColumn("_range", F.floor(F.col("place") / RANGE_GROUPS))
    schema, ddl = _typed(x, by, "rep int, _s double, _c double")
    parts = x.select(*by, "_range", "place", "n", "_s", "_c").groupBy(*by, "_range").applyInArrow(_sum_range(list(by), replicates, seed, schema), ddl)
    return parts.groupBy(*by, "rep").agg((F.sum("_s") / F.sum("_c")).alias("stat"))


def replicate_statistic(cells: DataFrame, keys: Sequence[str], stat: str, fpr: float = 0.01) -> DataFrame:
    """A statistic per replicate from exploded cells, NULL where it is undefined."""
    keys = [*keys, "rep"]
    if stat == "tpr_at_fpr":
        return tpr_of(cells, keys, {"stat": fpr}).select(*keys, "stat")
    raise ValueError(f"unknown statistic {stat!r}; choose from {STATISTICS}")


def interval(stats: DataFrame, by: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """Percentile interval over finite replicates; the others are counted.

    A key has one row per replicate here, so the exact percentile is small.
    """
    q = F.percentile("stat", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    g = stats.groupBy(*by).agg(q.alias("_q"), F.count(F.lit(1)).alias("n_draws"), F.count_if(F.col("stat").isNull()).alias("n_degenerate"))
    return g.select(*by, F.get("_q", F.lit(0)).alias("ci_lo"), F.get("_q", F.lit(1)).alias("ci_hi"), "n_draws", "n_degenerate")


def bootstrap_ci(df: DataFrame, by: Sequence[str], group: str, replicates: int = 1000, seed: int = 0, alpha: float = 0.05,
                 stat: str = "auc", fpr: float = 0.01, score: str = "score", label: str = "label") -> DataFrame:
    """Percentile interval of a statistic, resampling whole groups."""
    if stat == "auc":
        return interval(replicate_auc(df, by, group, replicates, seed, score=score, label=label), by, alpha)
    if stat == "mean":
        return interval(replicate_mean(df, by, group, replicates, seed, score), by, alpha)
    cells = replicate_cells(df, by, group, replicates, seed, score=score, label=label)
    return interval(replicate_statistic(cells, by, stat, fpr), by, alpha)


def paired_delta_ci(df: DataFrame, by: Sequence[str], group: str, baseline: str, candidate: str, replicates: int = 1000,
                    seed: int = 0, alpha: float = 0.05, label: str = "label") -> DataFrame:
    """AUC(candidate) - AUC(baseline) and its interval over shared draws."""
    arms = F.array(F.struct(F.lit(0).alias("arm"), F.col(baseline).alias("score")), F.struct(F.lit(1).alias("arm"), F.col(candidate).alias("score")))
    both = df.where(finite(baseline) & finite(candidate)).select(*by, F.col(group), F.col(label), F.inline(arms))
    delta = lambda c: F.max(F.when(F.col("arm") == 1, F.col(c))) - F.max(F.when(F.col("arm") == 0, F.col(c)))
    per = replicate_auc(both, by, group, replicates, seed, arms=["arm"], label=label).groupBy(*by, "rep").agg(delta("stat").alias("stat"))
    whole = _cells(both, [*by, "arm"], group, "score", label).groupBy(*by, "arm", "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    point = auc_of(whole, [*by, "arm"]).groupBy(*by).agg(
        F.max(F.when(F.col("arm") == 0, F.col("auc"))).alias("baseline_auc"), F.max(F.when(F.col("arm") == 1, F.col("auc"))).alias("candidate_auc"),
        delta("auc").alias("delta"))
    return null_safe_join(point, interval(per, by, alpha), list(by))


def permuted_labels(df: DataFrame, key: str, label: str, n: int, seed: int) -> DataFrame:
    """(draw, key, label): labels shuffled ``n`` times, class balance kept.

    A uniform permutation of a 0/1 vector is a uniform choice of which rows
    are 1, so each draw takes the first ``positives`` rows of its own order.
    """
    pos = df.agg(F.count_if(F.col(label) == 1).alias("p")).scalar()
    x = df.select(key).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    x = x.withColumn("_k", F.concat_ws("|", "draw", key))
    r = hash_rank(x, ["draw"], "_k", seed).withColumn("_p", pos)
    return r.select("draw", key, F.when(F.col("rank") <= F.col("_p"), 1).otherwise(0).alias("label"))


def permutation_p(null: DataFrame, observed: DataFrame, by: Sequence[str] = (), stat: str = "stat", centre: float = 0.5) -> DataFrame:
    """Two-sided p with the observed value counted in; undefined draws are kept
    in the denominator and never count as extreme."""
    j = null_safe_join(null, observed, list(by))
    extreme = F.abs(F.col(stat) - centre) >= F.abs(F.col("observed") - centre)
    return j.groupBy(*by).agg(
        F.first("observed").alias("observed"), F.min(stat).alias("null_lo"), F.max(stat).alias("null_hi"), F.count(F.lit(1)).alias("n_null"),
        ((F.count_if(extreme) + 1) / (F.count(F.lit(1)) + 1)).alias("p"))


def null_verdict(observed: Column, lo: Column, hi: Column, floor: float) -> Column:
    """Inside the null says nothing, whatever the number is."""
    inside = (observed >= lo) & (observed <= hi)
    return F.when(observed.isNull() | lo.isNull(), None).when(inside, "inside_null").when(observed < floor, "outside_below_floor").otherwise("outside_above_floor")
