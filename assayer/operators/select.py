"""Deduplication, selection, sampling and row expansion."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.seed import hash_hex
from assayer.operators.ranking import hash_rank, ordered_rank


def dedup_first(df: DataFrame, content: str, order: str) -> DataFrame:
    """First row per content value plus ``copies``.

    ``min_by`` aggregates map-side, so a content value copied across a third of
    the table still reaches its reducer as one row per task.
    """
    row = F.struct(*[F.col(c) for c in df.columns])
    return (
        df.groupBy(F.col(content).alias("_content"))
        .agg(F.min_by(row, F.col(order)).alias("_r"), F.count(F.lit(1)).alias("copies"))
        .select("_r.*", "copies")
    )


def contradictory_duplicates(df: DataFrame, content: str, label: str, key: str) -> DataFrame:
    """Content carried under both labels, with one offending id of each."""
    g = df.groupBy(content).agg(
        F.min(label).alias("_lo"), F.max(label).alias("_hi"),
        F.min_by(key, F.struct(label, key)).alias("first_id"),
        F.min_by(key, F.struct(-F.col(label), F.col(key))).alias("other_id"),
    )
    return g.where(F.col("_lo") != F.col("_hi")).select(content, "first_id", "other_id")


def refuse_contradictions(df: DataFrame, content: str, label: str, key: str) -> DataFrame:
    bad = contradictory_duplicates(df, content, label, key).limit(1).collect()
    if bad:
        raise ValueError(f"contradictory duplicate {bad[0][0]}: {bad[0].first_id!r} and {bad[0].other_id!r} disagree")
    return df


def skip_tally(rejected: DataFrame, reason: str = "reason") -> DataFrame:
    return rejected.where(F.col(reason).isNotNull()).groupBy(reason).agg(F.count(F.lit(1)).alias("n"))


def largest_detection(det: DataFrame, frame: str, ties: Sequence[str]) -> DataFrame:
    """Biggest box per frame; the earliest wins a tie."""
    rank = F.struct((F.col("w") * F.col("h")).alias("area"), *[(-F.col(t)).alias(t) for t in ties])
    row = F.struct(*[c for c in det.columns if c != frame])
    return det.groupBy(frame).agg(F.max_by(row, rank).alias("_r")).select(frame, "_r.*")


def seeded_sample(df: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """``k`` rows without replacement; all rows when there are no more than ``k``."""
    return hash_rank(df, [], key, seed).where(F.col("rank") <= k).drop("rank", "n")


def balanced_limit(df: DataFrame, label: str, key: str, limit: int, n_labels: int, seed: int) -> DataFrame:
    """An equal share of the limit for every class."""
    share = limit // n_labels
    return hash_rank(df, [label], key, seed).where(F.col("rank") <= share).drop("rank", "n")


def page(df: DataFrame, key: str, offset: int, limit: int) -> DataFrame:
    return df.orderBy(key).offset(offset).limit(limit)


def positional_sample(df: DataFrame, by: str, order: str, key: str, k: int, seed: int) -> DataFrame:
    """At most ``k`` rows per group, one from each of ``k`` equal stretches.

    Positions come from a distributed rank and the pick is a map-side
    ``min_by``, so a group of any size is never sorted in one place.
    """
    ranked = ordered_rank(df, [by], order, [key])
    stretch = F.floor((F.col("rank") - 1) * k / F.col("n"))
    slot = F.when(F.col("n") <= k, F.col("rank") - 1).otherwise(stretch)
    row = F.struct(*df.columns)
    picks = ranked.groupBy(F.col(by).alias("_g"), slot.alias("slot")).agg(F.min_by(row, F.struct(hash_hex(seed, key), F.col(key))).alias("_r"))
    return picks.select("_r.*", F.col("slot").cast("bigint").alias("slot"))


def first_k(df: DataFrame, by: str, order: Sequence[str], k: int) -> DataFrame:
    """First rows per group by distributed rank: one path for every ``k``, type
    of order and size of group."""
    return ordered_rank(df, [by], order[0], order[1:]).where(F.col("rank") <= k).drop("rank", "n")


def recent(df: DataFrame, n: int, status: str | None = None) -> DataFrame:
    kept = df if status is None else df.where(F.col("status") == status)
    return kept.orderBy(F.col("received_at").desc(), F.col("id").desc()).limit(n)


def couples(df: DataFrame, stratum: str, key: str, seed: int) -> DataFrame:
    """Disjoint random pairs inside each stratum; an odd one out is dropped."""
    ranked = hash_rank(df.select(stratum, key), [stratum], key, seed)
    pair = F.floor((F.col("rank") - 1) / 2).alias("pair")
    g = ranked.groupBy(stratum, pair).agg(
        F.min_by(key, "rank").alias("a"), F.max_by(key, "rank").alias("b"), F.count(F.lit(1)).alias("_n")
    )
    return g.where(F.col("_n") == 2).select(stratum, "a", "b", F.concat_ws("+", "a", "b").alias("couple_id"))


def expand_couples(
    pairs: DataFrame, techniques: Sequence[str], failed: DataFrame, synthetic: tuple[str, str] | None = None,
) -> DataFrame:
    """Two real rows per couple and one per technique that did not fail; the
    synthetic arm and its control appear together or not at all.

    ``failed`` is ``(couple_id, generator)``. The expansion is a narrow explode.
    """
    real = [F.struct(F.concat(F.lit("real/"), F.col(c).cast("string")).alias("part"), F.lit(None).cast("string").alias("generator")) for c in ("a", "b")]
    fake = [F.struct(F.lit(t).alias("part"), F.lit(t).alias("generator")) for t in (*techniques, *(synthetic or ()))]
    rows = pairs.withColumn("_p", F.explode(F.array(*real, *fake))).select(
        F.concat_ws("/", "couple_id", F.col("_p.part")).alias("sample_id"),
        F.col("couple_id").alias("subject_id"), "stratum", F.col("_p.generator").alias("generator"),
        F.when(F.col("_p.generator").isNull(), 0).otherwise(1).alias("label"),
    )
    gone = failed.select(F.col("couple_id").alias("subject_id"), "generator")
    if synthetic:
        a, b = synthetic
        both = F.when(F.col("generator").isin(a, b), F.array(F.lit(a), F.lit(b))).otherwise(F.array("generator"))
        gone = gone.select("subject_id", F.explode(both).alias("generator"))
    return rows.join(gone.distinct(), ["subject_id", "generator"], "left_anti")


def expand_real_and_derived(items: DataFrame, key: str, generator: str) -> DataFrame:
    """Each item once as itself and once as its derived counterpart."""
    arms = F.array(
        F.struct(F.lit("real").alias("arm"), F.lit(0).alias("label"), F.lit(None).cast("string").alias("generator")),
        F.struct(F.lit(generator).alias("arm"), F.lit(1).alias("label"), F.lit(generator).alias("generator")),
    )
    return items.select("*", F.inline(arms)).withColumn("sample_id", F.concat_ws("-", F.col(key).cast("string"), "arm")).drop("arm")


def refuse_evaluation_only(items: DataFrame, key: str) -> DataFrame:
    reserved = items.where(F.col("swapped")).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first")).first()
    if reserved.n:
        raise ValueError(f"{reserved.n} items are kept for evaluation, {reserved.first!r} first; remove them from the training input")
    return items


def shared_support(df: DataFrame, key: Sequence[str], label: str = "label") -> DataFrame:
    """Rows whose key value occurs in both classes."""
    both = df.groupBy(*key).agg(F.min(label).alias("_lo"), F.max(label).alias("_hi")).where(F.col("_lo") != F.col("_hi"))
    return df.join(both.select(*key), list(key), "left_semi")


def adopt_couple(rows: DataFrame, couple_of: DataFrame, key: str) -> DataFrame:
    """Give every row its couple's id, or ``solo/<id>``."""
    own = F.concat(F.lit("solo/"), F.col(key).cast("string"))
    return rows.join(couple_of, key, "left").withColumn("couple_id", F.coalesce("couple_id", own))


def missed_attacks(sessions: DataFrame) -> DataFrame:
    return sessions.where(F.col("swapped") & F.col("approved"))


def cache_key(content: Column, shape: Column, preprocess: str, encoder: str) -> Column:
    return F.sha2(F.concat_ws("|", content, shape.cast("string"), F.lit(preprocess), F.lit(encoder)), 256)


def cache_misses(items: DataFrame, cache: DataFrame, key: str = "cache_key") -> DataFrame:
    """One row per distinct key the cache lacks."""
    return items.dropDuplicates([key]).join(cache.select(key), key, "left_anti")


def cache_summary(items: DataFrame, cache: DataFrame, key: str = "cache_key") -> DataFrame:
    distinct = items.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    j = distinct.join(cache.select(key, F.lit(1).alias("_hit")), key, "left")
    return j.agg(
        F.sum("_rows").alias("n_rows"), F.count(F.lit(1)).alias("n_keys"), F.count("_hit").alias("n_hits"),
        F.count_if(F.col("_hit").isNull()).alias("n_misses"),
    )


def with_cached_features(
    items: DataFrame, cache: DataFrame, compute: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]],
    key: str = "cache_key",
) -> tuple[DataFrame, DataFrame]:
    """Every item with its feature array, and the rows to append to the cache.

    Only distinct missing keys reach the Python encoder, in Arrow batches.
    """
    fresh = cache_misses(items, cache, key).mapInPandas(compute, schema=f"{key} string, features array<double>")
    full = cache.select(key, "features").unionByName(fresh)
    return items.join(full, key, "left"), fresh


def licence_problems(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """(problem, item): files claimed twice, unregistered or non-commercial."""
    claims = manifest.select("asset_id", "commercial_use", F.explode("files").alias("file"))
    owner = claims.groupBy("file").agg(F.min_by("asset_id", "asset_id").alias("asset_id"), F.min_by("commercial_use", "asset_id").alias("commercial_use"), F.count(F.lit(1)).alias("_n"))
    twice = owner.where(F.col("_n") > 1).select(F.lit("duplicate_claim").alias("problem"), F.col("file").alias("item"))
    resolved = found.join(owner, "file", "left")
    gate = resolved.select(
        F.when(F.col("asset_id").isNull(), "unregistered").when(~F.col("commercial_use"), "non_commercial").alias("problem"),
        F.coalesce(F.col("asset_id").cast("string"), F.col("file")).alias("item"),
    ).where(F.col("problem").isNotNull())
    return twice.unionByName(gate)


def require_clean_release(found: DataFrame, manifest: DataFrame, allow_empty: bool = False) -> None:
    if not allow_empty and found.isEmpty():
        raise ValueError("no assets to check: point the scan at the release folder, or pass allow_empty for a release without any")
    bad = licence_problems(found, manifest).limit(5).collect()
    if bad:
        raise ValueError("release refused: " + "; ".join(f"{r.problem} {r.item}" for r in bad))


def coverage_difference(a: DataFrame, b: DataFrame, keys: Sequence[str], by: str) -> DataFrame:
    """Per fold, how many keys only one of two runs holds; one shuffle for both sides."""
    tagged = a.select(*keys, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(b.select(*keys, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    per = tagged.groupBy(*keys).agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    return per.groupBy(by).agg(
        F.sum(F.greatest(F.col("_a") - F.col("_b"), F.lit(0))).alias("only_a"),
        F.sum(F.greatest(F.col("_b") - F.col("_a"), F.lit(0))).alias("only_b"),
    )


def require_same_coverage(a: DataFrame, b: DataFrame, keys: Sequence[str], by: str) -> None:
    bad = coverage_difference(a, b, keys, by).where((F.col("only_a") > 0) | (F.col("only_b") > 0)).limit(5).collect()
    if bad:
        raise ValueError(f"the two runs do not cover the same samples: {[r.asDict() for r in bad]}")
