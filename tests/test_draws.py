"""Multinomial draws by splitting: exact totals, the right spread, the same numbers wherever they are made."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from assayer.operators import draws as D
from assayer.operators import resample as B


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1001])
def test_counts_are_multinomial(n):
    w = D.multiplicities(5, n, np.arange(n), 3000)
    assert (w.sum(axis=0) == n).all()
    assert w.var(axis=1).mean() == pytest.approx(1 - 1 / n, abs=0.03)
    assert np.abs(w.mean(axis=1) - 1).max() * 3000**0.5 < 5.5
    if n > 2:  # groups compete for the same draws
        assert np.corrcoef(w[0], w[1])[0, 1] == pytest.approx(-1 / (n - 1), abs=0.08)


def test_any_subset_gets_the_same_numbers(monkeypatch):
    whole = D.multiplicities(9, 5000, np.arange(5000), 20)
    some = np.array([4999, 17, 17, 2048, 0])
    assert (D.multiplicities(9, 5000, some, 20) == whole[some]).all()
    monkeypatch.setattr(D, "WORDS", 3)
    assert (D.multiplicities(9, 5000, some, 20) == whole[some]).all()
    assert (D.multiplicities(10, 5000, some, 20) != whole[some]).any()
    monkeypatch.setattr(D, "CELLS", 50)
    assert (D.multiplicities(9, 5000, np.arange(5000), 20) == whole).all()


def _bucket(rows, groups):
    """A bucket of distinct groups and tied scores, and the form of what is counted in it."""
    at = np.arange(rows)
    table = {"place": pa.array(at * 7919 % groups), "n": pa.array(np.full(rows, groups)), "score": pa.array(at * 31 % 977 / 977.0), "pos": pa.array(at % 2), "neg": pa.array((at + 1) % 2)}
    kinds = [("_bucket", pa.int64()), ("rep", pa.int32()), *((c, pa.float64()) for c in ("_p", "_n", "_u"))]
    return pa.table(table), pa.schema(kinds)


def test_a_bucket_counted_in_parts_gives_the_same(monkeypatch):
    table, schema = _bucket(3000, 10_000)
    whole = B._count_bucket(["_bucket"], 8, 3, schema)((pa.scalar(1),), table)
    scores, pos, neg = (table.column(c).to_numpy() for c in ("score", "pos", "neg"))
    w = D.multiplicities(3, 10_000, table.column("place").to_numpy(), 8)
    below, ties = scores[None, :] < scores[:, None], scores[None, :] == scores[:, None]
    assert whole.column("_u").to_pylist() == [((pos * w[:, r]) @ (below + ties / 2) @ (neg * w[:, r])) for r in range(8)]
    for cells, counted in ((8 * 701, 8 * 2), (8 * 1000, 8), (100, 8 * 10_000)):
        monkeypatch.setattr(B, "MATRIX_CELLS", cells)
        monkeypatch.setattr(B, "COUNTED_CELLS", counted)
        assert B._count_bucket(["_bucket"], 8, 3, schema)((pa.scalar(1),), table).equals(whole)


def test_memory_of_a_bucket_of_many_groups():
    """Draws and products are made in parts: this bucket took 211 MB before and takes 90 MB."""
    table, schema = _bucket(100_000, 400_000)
    run = B._count_bucket(["_bucket"], 40, 0, schema)
    tracemalloc.start()
    run((pa.scalar(1),), table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6


def test_a_common_score_is_counted_in_few_calls(spark, many_buckets, monkeypatch):
    """Before, each of 1,024 shares of the groups was a call, and each call makes its draws from all groups down."""
    monkeypatch.setattr(B, "MATRIX_CELLS", 100)
    calls, count = spark.sparkContext.accumulator(0), B._count_bucket

    def counted(keys, replicates, seed, schema):
        inner = count(keys, replicates, seed, schema)

        def run(key, table):
            if key[keys.index("_heavy")].as_py():
                calls.add(1)
            return inner(key, table)

        return run

    df = spark.range(1200).select(F.when(F.col("id") % 50 == 0, F.col("id") / 1200).otherwise(0.5).alias("score"), (F.col("id") % 3 == 0).cast("int").alias("label"), F.col("id").alias("g"))
    plain = {r.rep: r.stat for r in B.replicate_auc(df, [], "g", 6, 2).collect()}
    monkeypatch.setattr(B, "_count_bucket", counted)
    assert {r.rep: r.stat for r in B.replicate_auc(df, [], "g", 6, 2).collect()} == plain
    drawn = {r.g: list(r.reps) for r in B.draws(df, [], "g", 6, 2).collect()}
    rows = df.collect()
    for rep in range(6):
        x = [(r.score, r.label) for r in rows for _ in range(drawn.get(r.g, []).count(rep))]
        p, n = (np.array([s for s, y in x if y == k]) for k in (1, 0))
        assert plain[rep] == pytest.approx(((p[:, None] > n) + (p[:, None] == n) / 2).mean())
    assert calls.value == 3


def test_parts_of_ranges_are_powers_of_two():
    size = np.concatenate((np.arange(2, 5000), 2 ** np.arange(2, 40) + 1, 2 ** np.arange(2, 40)))
    left = D.left_part(size)
    assert (np.bitwise_count(left) == 1).all() and (left < size).all() and (2 * left >= size).all()


def test_what_moves_does_not_grow_with_the_replicates(spark):
    """Rows that leave for the buckets carry their group's number, never a list."""
    df = spark.range(4000).select((F.rand(1)).alias("score"), (F.col("id") % 3 == 0).cast("int").alias("label"), (F.col("id") % 300).alias("g"))
    for stat in ("auc", "mean"):
        plans = []
        for reps in (10, 400):
            out = B.replicate_auc(df, [], "g", reps, 2) if stat == "auc" else B.replicate_mean(df, [], "g", reps, 2)
            plan = out._jdf.queryExecution().optimizedPlan().toString()
            assert "reps" not in plan and "explode" not in plan
            plans.append(plan.count("Join"))
            assert out.count() == reps
        assert plans[0] == plans[1]


def test_mean_equals_counting(spark):
    rows = [(k % 3, f"g{k % 11}", None if k % 7 == 0 else float(k % 13), k % 2) for k in range(200)]
    df = spark.createDataFrame(rows, "k int, g string, score double, label int")
    drawn = {(r.k, r.g): list(r.reps) for r in B.draws(df, ["k"], "g", 8, 3).collect()}
    got = {(r.k, r.rep): r.stat for r in B.replicate_mean(df, ["k"], "g", 8, 3).collect()}
    for key in range(3):
        for rep in range(8):
            x = [s for k, g, s, _ in rows if k == key and s is not None for _ in range(drawn.get((k, g), []).count(rep))]
            assert got[key, rep] == pytest.approx(np.mean(x))
