"""Identity-disjoint splits and folds.

Only group tables are ranked; rows learn their side by one equi-join on the
group. Sides depend on seeded hashes, so a split is reproducible anywhere.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.scalar import class_of
from assayer.functions.seed import hash_hex
from assayer.operators.ranking import hash_rank, running

REQUIRED = ("sample_id", "subject_id", "source_id", "label")


class UnsplittableCorpus(ValueError):
    """No fold of this corpus would measure anything."""


def record_violations(records: DataFrame) -> DataFrame:
    """(problem, key): every rule a record or a source breaks."""
    lab = F.col("label")
    flag = lambda bad, name: F.when(F.coalesce(bad, F.lit(False)), F.lit(name))
    row = F.array(
        *[flag(F.col(c).isNull(), f"missing_{c}") for c in REQUIRED],
        flag(~lab.isin(0, 1), "label_not_binary"),
        flag((lab == 1) & F.col("generator").isNull(), "fake_without_generator"),
        flag((lab == 0) & F.col("generator").isNotNull(), "real_with_generator"),
    )
    rows = records.select(F.explode(F.filter(row, lambda p: p.isNotNull())).alias("problem"), F.col("sample_id").alias("key"))
    pair = F.struct("subject_id", class_of("generator").alias("g"))
    sources = records.groupBy("source_id").agg(F.min(pair).alias("_lo"), F.max(pair).alias("_hi")).where(F.col("_lo") != F.col("_hi"))
    return rows.unionByName(sources.select(F.lit("source_straddles").alias("problem"), F.col("source_id").alias("key")))


def generator_folds(records: DataFrame, seed: int = 0) -> DataFrame:
    """(fold, sample_id, side): one fold per generator, subjects never on both sides.

    Subjects - not records - are halved by a seeded rank. If every subject with
    a real record fell on one side, the first of them moves. A subject without
    real records follows its fakes when they all point one way. A fake whose
    generator wants the other side than its subject is ``dropped``.
    """
    subjects = records.groupBy("subject_id").agg(
        F.bool_or(F.col("label") == 0).alias("has_real"),
        F.collect_set(F.when(F.col("label") == 1, F.col("generator"))).alias("gens"),
    )
    ranked = hash_rank(subjects, [], "subject_id", seed)
    ranked = ranked.withColumn("base", F.col("rank") <= F.greatest(F.lit(1), F.floor(F.col("n") / 2)))
    real = F.col("has_real")
    scope = ranked.agg(
        F.count_if(real).alias("n_real"), F.count_if(real & F.col("base")).alias("n_train"),
        F.min(F.when(real, F.col("subject_id"))).alias("first_real"),
    ).select(F.struct("*").alias("s")).scalar()
    placed = ranked.withColumn("_s", scope)
    lopsided = (F.col("_s.n_real") >= 2) & ((F.col("_s.n_train") == 0) | (F.col("_s.n_train") == F.col("_s.n_real")))
    base = F.col("base") != (lopsided & (F.col("subject_id") == F.col("_s.first_real")))
    sides = placed.select("subject_id", "has_real", "gens", base.alias("base"))
    folds = records.where(F.col("label") == 1).agg(F.array_sort(F.collect_set("generator")).alias("g")).select("g").scalar()
    j = records.select("sample_id", "subject_id", "generator", "label").join(sides, "subject_id").withColumn("_folds", folds)
    j = j.withColumn("fold", F.explode("_folds"))
    g, gens, anchored = F.col("fold"), F.col("gens"), F.col("has_real")
    only = (F.size(gens) == 1) & F.array_contains(gens, g)
    train = F.when(~anchored & ~F.col("base") & ~F.array_contains(gens, g), True).when(~anchored & F.col("base") & only, False).otherwise(F.col("base"))
    wants_test = F.col("generator") == g
    side = (
        F.when(F.col("label") == 0, F.when(train, "train").otherwise("test"))
        .when(wants_test & ~train, "test").when(~wants_test & train, "train").otherwise("dropped"))
    return j.select("fold", "sample_id", side.alias("side"), "label")


def fold_counts(assignments: DataFrame) -> DataFrame:
    """Per fold the four counts that must not be zero, and what was dropped."""
    n = lambda side, lab: F.count_if((F.col("side") == side) & (F.col("label") == lab))
    return assignments.groupBy("fold").agg(
        n("train", 0).alias("train_reals"), n("train", 1).alias("train_fakes"), n("test", 0).alias("test_reals"),
        n("test", 1).alias("test_fakes"), F.count_if(F.col("side") == "dropped").alias("dropped"))


def require_measurable(assignments: DataFrame) -> DataFrame:
    four = ("train_reals", "train_fakes", "test_reals", "test_fakes")
    empty = fold_counts(assignments).where(" OR ".join(f"{c} = 0" for c in four)).limit(5).collect()
    if empty:
        raise UnsplittableCorpus(f"folds with an empty class on a side: {[r.asDict() for r in empty]}")
    return assignments


def group_holdout(df: DataFrame, group: str, fraction: float, seed: int) -> DataFrame:
    """Whole groups to ``test`` until their share of the groups is reached."""
    groups = df.select(group).distinct()
    size = F.greatest(F.lit(1), F.rint(F.col("n") * fraction).cast("bigint"))
    return _sided(df, group, hash_rank(groups, [], group, seed), size)


def half_split(df: DataFrame, group: str, seed: int) -> DataFrame:
    groups = df.select(group).distinct()
    return _sided(df, group, hash_rank(groups, [], group, seed), F.greatest(F.lit(1), F.floor(F.col("n") / 2)))


def _sided(df: DataFrame, group: str, ranked: DataFrame, n_test: Column) -> DataFrame:
    sides = ranked.select(group, F.when(F.col("rank") <= n_test, "test").otherwise("train").alias("side"))
    return df.join(sides, group)


def row_split(df: DataFrame, key: str, fraction: float, seed: int) -> DataFrame:
    n_test = F.greatest(F.lit(1), F.rint(F.col("n") * fraction).cast("bigint"))
    return hash_rank(df, [], key, seed).withColumn("side", F.when(F.col("rank") <= n_test, "test").otherwise("train")).drop("rank", "n")


def _serpentine_rank(groups: DataFrame, by: Sequence[str], group: str, seed: int) -> DataFrame:
    """Rank groups by size, largest first, seeded among equal sizes.

    Dealt back and forth in this order, any two hands differ by the largest group at most: the spread of each round is
    the range of its sizes, and the ranges of successive rounds do not overlap.
    """
    o = groups.withColumn("_less", -F.col("n_rows")).withColumn("_hex", hash_hex(seed, group)).withColumn("_one", F.lit(1).cast("bigint"))
    o = o.withColumn("_num", (F.col("_less") * 4096 + F.conv(F.substring("_hex", 1, 3), 16, 10).cast("int")).cast("double"))
    r = running(o, by, ["_less", "_hex", group], ["_one"], bucket_on="_num")
    return r.withColumn("rank", (F.col("_one_before") + 1).cast("bigint")).drop("_less", "_hex", "_num", "_one", "_one_before", "_one_total")


def class_aware_split(df: DataFrame, group: str, label: str, seed: int) -> DataFrame:
    """Group-disjoint fit/test halves holding both classes on both sides.

    Groups of one class, of the other and mixed groups are dealt out
    separately in fit-test-test-fit order, largest first; mixed groups start on
    the test side. Any class spread over two groups therefore reaches both
    sides, and the halves differ by the largest group of each kind at most.
    Dealing by rank needs no sequential pass, so the number of groups is not
    limited.
    """
    groups = df.groupBy(group).agg(F.count(F.lit(1)).alias("n_rows"), F.min(label).alias("_lo"), F.max(label).alias("_hi"))
    groups = groups.withColumn("kind", F.when(F.col("_lo") != F.col("_hi"), "mixed").otherwise(F.col("_lo").cast("string"))).drop("_lo", "_hi")
    r = _serpentine_rank(groups, ["kind"], group, seed)
    outer = ((F.col("rank") - 1) % 4).isin(0, 3)
    fit = F.when(F.col("kind") == "mixed", ~outer).otherwise(outer)
    return df.join(r.select(group, F.when(fit, "fit").otherwise("test").alias("side")), group)


def require_both_classes(split: DataFrame, label: str) -> DataFrame:
    seen = {tuple(r) for r in split.groupBy("side", label).agg(F.lit(1)).select("side", label).limit(8).collect()}
    missing = [(s, c) for s in ("fit", "test") for c in (0, 1) if (s, c) not in seen]
    if missing:
        raise ValueError(f"no group-disjoint split has both classes on both sides; missing {missing}")
    return split


def group_kfold(df: DataFrame, group: str, k: int, seed: int) -> DataFrame:
    """``fold`` 0..k-1 per group, dealt back and forth, largest groups first.

    Any two folds differ by the rows of the largest group at most.
    """
    groups = df.groupBy(group).agg(F.count(F.lit(1)).alias("n_rows"))
    r = _serpentine_rank(groups, [], group, seed)
    at = (F.col("rank") - 1) % (2 * k)
    fold = F.when(at < k, at).otherwise(2 * k - 1 - at)
    return df.join(r.select(group, fold.cast("int").alias("fold")), group)


def doubly_disjoint(df: DataFrame, group: str, seed: int, generator: str = "generator") -> DataFrame:
    """A row per held-out family the record takes part in, with its side.

    Training rows are off the test groups and not of the held family; test rows
    are on them and real or of the held family.
    """
    halves = half_split(df, group, seed)
    families = df.where(F.col(generator).isNotNull()).agg(F.array_sort(F.collect_set(generator)).alias("g")).scalar()
    x = halves.withColumn("_g", families).withColumn("held", F.explode("_g")).drop("_g")
    real, held = F.col(generator).isNull(), F.col(generator) == F.col("held")
    keep = F.when(F.col("side") == "test", real | held).otherwise(real | ~held)
    return x.where(keep)


def measurable_families(masks: DataFrame, label: str = "label") -> DataFrame:
    """Held families with both classes on both sides."""
    g = masks.groupBy("held", "side").agg((F.min(label) != F.max(label)).alias("_both"))
    ok = g.groupBy("held").agg(F.bool_and("_both").alias("_ok"), F.count(F.lit(1)).alias("_n"))
    return ok.where(F.col("_ok") & (F.col("_n") == 2)).select("held")


def window_violations(detectors: DataFrame, windows: DataFrame, offset: int) -> DataFrame:
    """Detectors fitted on items the evaluation offset would draw again."""
    return detectors.join(windows, "version").where(F.lit(offset) < F.col("window")).select("detector", "version", "window")


def require_outside_window(detectors: DataFrame, windows: DataFrame, offset: int) -> None:
    bad = window_violations(detectors, windows, offset).limit(5).collect()
    if bad:
        raise ValueError(f"offset {offset} lies inside the training window of {[r.detector for r in bad]}")
