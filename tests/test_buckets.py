"""Rank buckets at the constants a cluster runs with."""

from pyspark.sql import functions as F

from assayer.operators import ranking as R
from assayer.operators import resample as B


def skewed(spark, n):
    """Log-normal values, one of them far beyond all others."""
    return spark.range(n).select("id", F.when(F.col("id") == 7, 1e12).otherwise(F.exp(3 * F.randn(5))).alias("v"))


def test_no_bucket_holds_more_than_its_share(spark):
    b = R.with_value_bucket(skewed(spark, 400_000), "v", rows=2000).groupBy(R.BUCKET).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy(R.BUCKET).collect()
    assert max(r.n for r in b) <= 3 * 2000 and len(b) >= 150
    assert all(x.hi <= y.lo for x, y in zip(b, b[1:]))


def test_a_value_of_a_third_is_a_bucket_by_itself(spark):
    df = skewed(spark, 90_000).withColumn("v", F.when(F.col("id") % 3 == 0, 1.5).otherwise(F.col("v")))
    b = R.with_value_bucket(df, "v", rows=500).groupBy(R.BUCKET).agg(F.count("*").alias("n"), F.countDistinct("v").alias("d")).collect()
    assert [r.d for r in b if r.n > 1500] == [1]


def test_counting_goes_in_slices(spark, monkeypatch):
    df = skewed(spark, 3000).select((F.col("v") % 1).alias("score"), (F.col("id") % 3 == 0).cast("int").alias("label"), (F.col("id") % 40).alias("g"))
    want = sorted(map(tuple, B.replicate_auc(df, [], "g", 9, 2).collect()))
    monkeypatch.setattr(B, "MATRIX_CELLS", 100)
    assert [r[0] for r in want] == list(range(9))
    got = sorted(map(tuple, B.replicate_auc(df, [], "g", 9, 2).collect()))
    assert all(a[0] == b[0] and abs(a[1] - b[1]) < 1e-9 for a, b in zip(got, want, strict=True))
