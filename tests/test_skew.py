"""One key, one value or one group holding most rows, over many buckets."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.functions.seed import hash_hex
from assayer.operators import curve as V
from assayer.operators import metrics as M
from assayer.operators import ranking as R
from assayer.operators import resample as B
from assayer.operators import select as S

pytestmark = pytest.mark.usefixtures("many_buckets")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = []
    for i in range(900):
        key = "hot" if i % 2 else rng.choice(["a", "b", None])
        value = 0.5 if i % 3 == 0 else round(rng.gauss(0, 1), 2)
        out.append((i, key, value, rng.randint(0, 1), f"g{0 if i % 3 else rng.randint(1, 20)}"))
    return out


@pytest.fixture
def df(spark, rows):
    return spark.createDataFrame(rows, "id long, k string, score double, label int, g string").repartition(4)


def brute_auc(rows):
    pos, neg = [r[2] for r in rows if r[3] == 1], [r[2] for r in rows if r[3] == 0]
    return float(np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg]))


def test_buckets_are_many_and_monotone(df):
    b = R.with_value_bucket(df, "score").groupBy(R.BUCKET).agg(F.min("score").alias("lo"), F.max("score").alias("hi")).orderBy(R.BUCKET).collect()
    assert len(b) > 20
    assert all(x.hi <= y.lo for x, y in zip(b, b[1:]))
    assert df.count() == 900


def test_auc_by_key(df, rows):
    got = {r.k: r.auc for r in V.auc(df, ["k"]).collect()}
    for k in {r[1] for r in rows}:
        assert got[k] == pytest.approx(brute_auc([r for r in rows if r[1] == k]))


def test_curve_metrics_by_key(df, rows):
    got = {r.k: r for r in V.tpr_at_fpr(df, ["k"], {"t": 0.05}).collect()}
    q = {r.k: r.m for r in V.quantiles(df, ["k"], "score", {"m": 0.3}).collect()}
    for k in {r[1] for r in rows}:
        part = [r for r in rows if r[1] == k]
        neg, pos = [r[2] for r in part if r[3] == 0], np.array([r[2] for r in part if r[3] == 1])
        assert got[k].t == pytest.approx(float((pos > np.quantile(neg, 0.95)).mean()))
        assert q[k] == pytest.approx(float(np.quantile([r[2] for r in part], 0.3)))


def test_ranks(df, rows):
    hashed = {r.id: r.h for r in df.select("id", hash_hex(3, "id").alias("h")).collect()}
    by_hash = {r.id: (r.rank, r.n) for r in R.hash_rank(df, ["k"], "id", 3).collect()}
    by_value = {r.id: r.rank for r in R.ordered_rank(df, ["k"], "score", ["id"]).collect()}
    for k in {r[1] for r in rows}:
        part = [r for r in rows if r[1] == k]
        for i, r in enumerate(sorted(part, key=lambda r: (hashed[r[0]], r[0])), 1):
            assert by_hash[r[0]] == (i, len(part))
        for i, r in enumerate(sorted(part, key=lambda r: (r[2], r[0])), 1):
            assert by_value[r[0]] == i


def test_series_is_stitched_across_buckets(df, rows):
    got = {r.k: r.ess for r in M.autocorrelation_ess(df.where("k IS NOT NULL"), "k", "id", "score").collect()}
    for k in ("hot", "a", "b"):
        x = np.array([r[2] for r in sorted(rows) if r[1] == k])
        c = x - x.mean()
        rho = float(c[:-1] @ c[1:] / (c @ c))
        assert got[k] == pytest.approx(min(len(x), max(1.0, len(x) * (1 - rho) / (1 + rho))))


def test_bootstrap_equals_counting(spark, df, rows):
    """Interval over replicates rebuilt from the same draws, row by row."""
    base = df.where("k = 'hot'")
    d = {r.g: list(r.reps) for r in B.draws(base, [], "g", 12, 4).collect()}
    part = [r for r in rows if r[1] == "hot"]
    stats = [brute_auc([r for r in part for _ in range(d.get(r[4], []).count(rep))]) for rep in range(12)]
    got = B.bootstrap_ci(base, [], "g", 12, 4).collect()[0]
    assert [got.ci_lo, got.ci_hi] == pytest.approx([float(np.quantile(stats, q)) for q in (0.025, 0.975)])
    assert sum(len(v) for v in d.values()) == 12 * len({r[4] for r in part})


def test_samples_are_the_first_by_hash(df, rows):
    hashed = {r.id: r.h for r in df.select("id", hash_hex(9, "id").alias("h")).collect()}
    want = sorted(hashed, key=lambda i: (hashed[i], i))[:100]
    assert {r.id for r in S.seeded_sample(df, "id", 100, 9).collect()} == set(want)
    hashed = {r.id: r.h for r in df.select("id", hash_hex(1, "id").alias("h")).collect()}
    few = {r.id for r in S.balanced_limit(df, "label", "id", 60, 2, 1).collect()}
    assert few == {i for k in (0, 1) for i in sorted((r[0] for r in rows if r[3] == k), key=lambda i: (hashed[i], i))[:30]}


def test_ties_are_cut_by_the_tie_column(df):
    b = R.with_value_bucket(df.withColumn("_num", F.col("score")), "_num")
    before = b.groupBy(R.BUCKET).count().agg(F.max("count")).collect()[0][0]
    after = R._split_ties(b, "id").groupBy(R.BUCKET).count().agg(F.max("count")).collect()[0][0]
    assert before >= 300 and after < 60


@pytest.mark.parametrize("k", [5, 2000])
def test_first_k_by_number_time_and_text(df, rows, k):
    timed = df.withColumn("t", F.timestamp_seconds(F.col("id") * 7919 % 1000)).withColumn("s", F.concat(F.lit("same-prefix-"), F.lpad(F.col("id").cast("string"), 4, "0")))
    of = lambda i: {"score": (rows[i][2], i), "t": (i * 7919 % 1000, i), "s": (f"same-prefix-{i:04d}", i)}
    for order in ("score", "t", "s"):
        got = {r.id for r in S.first_k(timed, "g", [order, "id"], k).collect()}
        want = set()
        for g in {r[4] for r in rows}:
            want |= set(sorted((r[0] for r in rows if r[4] == g), key=lambda i: of(i)[order])[:k])
        assert got == want
