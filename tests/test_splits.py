"""Invariants that must hold for every seed."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.operators import splits as P

FAKES = {"pA": ["dl", "fs"], "pB": ["dl", "sg"], "pC": ["fs", "sg"], "pD": ["dl", "fs", "sg"], "pE": ["dl", "fs", "sg"]}
SEEDS = (0, 1, 2, 3)


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(f"r{i}", f"sr{i}", f"p{i}", None, 0) for i in range(1, 7)]
    rows += [(f"{p}-{g}", f"s{p}{g}", p, g, 1) for p, gs in FAKES.items() for g in gs]
    return spark.createDataFrame(rows, "sample_id string, source_id string, subject_id string, generator string, label int").cache()


@pytest.mark.parametrize("seed", SEEDS)
def test_generator_folds(corpus, seed):
    rec = {r.sample_id: r for r in corpus.collect()}
    folds = {}
    for a in P.require_measurable(P.generator_folds(corpus, seed)).collect():
        folds.setdefault(a.fold, {}).setdefault(a.side, []).append(rec[a.sample_id])
    assert set(folds) == {"dl", "fs", "sg"}
    for g, sides in folds.items():
        train, test = sides["train"], sides["test"]
        assert not {r.subject_id for r in train} & {r.subject_id for r in test}
        assert all(r.generator in (None, g) for r in test) and all(r.generator != g for r in train)
        assert sum(len(v) for v in sides.values()) == len(rec)
        assert all(r.label == 1 for r in sides.get("dropped", []))
        for side in (train, test):
            assert {r.label for r in side} == {0, 1}


def test_same_seed_same_folds(corpus):
    key = lambda s: sorted(tuple(r) for r in P.generator_folds(corpus.repartition(3), s).select("fold", "sample_id", "side").collect())
    assert key(2) == key(2)


@pytest.mark.parametrize("seed", SEEDS)
def test_class_aware_split(spark, seed):
    rows = [("hot", i % 2) for i in range(300)] + [(f"a{g}", 0) for g in range(5) for _ in range(g + 1)] + [(f"b{g}", 1) for g in range(2) for _ in range(4)] + [("m", 0), ("m", 1)]
    s = P.require_both_classes(P.class_aware_split(spark.createDataFrame(rows, "g string, label int"), "g", "label", seed), "label")
    assert s.groupBy("g").agg(F.countDistinct("side").alias("n")).where("n > 1").count() == 0
    assert s.count() == len(rows)


@pytest.mark.parametrize("seed", SEEDS[:2])
def test_one_pure_and_one_mixed_group_still_split(spark, seed):
    df = spark.createDataFrame([("p", 0), ("q", 1), ("m", 0), ("m", 1)], "g string, label int")
    P.require_both_classes(P.class_aware_split(df, "g", "label", seed), "label")


@pytest.mark.parametrize("seed", SEEDS[:2])
def test_group_folds_are_balanced(spark, seed):
    df = spark.range(1000).select((F.col("id") % 53).cast("string").alias("g"))
    sizes = [r.n for r in P.group_kfold(df, "g", 5, seed).groupBy("fold").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) <= 40


def test_holdout_size_rounds_half_to_even(spark):
    df = spark.range(5).select(F.col("id").cast("string").alias("g"))
    assert P.group_holdout(df, "g", 0.5, 1).where("side = 'test'").count() == 2
    assert P.group_holdout(df, "g", 0.01, 1).where("side = 'test'").count() == 1


@pytest.mark.parametrize("seed", [0, 1])
def test_hands_differ_by_the_largest_group_at_most(spark, seed):
    """Lognormal group sizes, over many buckets too."""
    rng = np.random.default_rng(seed)
    sizes = np.maximum(1, rng.lognormal(2.0, 1.3, 180).astype(int))
    kind = rng.integers(0, 3, 180)
    rows = [(f"g{g}", int(kind[g] == 1 or (kind[g] == 2 and i % 2))) for g in range(180) for i in range(sizes[g])]
    df = spark.createDataFrame(rows, "g string, label int")
    folds = [r.n for r in P.group_kfold(df, "g", 5, seed).groupBy("fold").agg(F.count("*").alias("n")).collect()]
    assert len(folds) == 5 and max(folds) - min(folds) <= sizes.max()
    split = P.class_aware_split(df, "g", "label", seed)
    n = {r.side: r.n for r in split.groupBy("side").agg(F.count("*").alias("n")).collect()}
    real = {g: ("mixed" if kind[g] == 2 and sizes[g] > 1 else "1" if kind[g] == 1 else "0") for g in range(180)}
    assert abs(n["fit"] - n["test"]) <= sum(max(sizes[g] for g in real if real[g] == k) for k in set(real.values()))
