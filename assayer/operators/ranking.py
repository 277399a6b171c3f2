"""Exact ranks and running totals that no single task has to carry.

``Window.partitionBy(key)`` sends a whole key to one task. Here a key is first
cut into order-preserving buckets, each bucket is summed, the (small) bucket
table is prefix-summed, and only then does a window run - over one bucket.

Bucket bounds come from the table itself: a quantile sketch over all rows, read
through an uncorrelated scalar subquery. Every bound is a quantile, so a bucket
holds its share of *all* rows however the values are spread and whichever key
they carry; one key holding a third of the table fills a third of the buckets.
The number of bounds used follows from the row count: buckets hold about
``ROWS_PER_BUCKET`` rows, and never more than about two of the ``CUTS`` parts of
the table, but for a single common value, which is a bucket by itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from assayer.functions.seed import HASH_BITS, hash_hex, leading_int

FAN = 16
CUTS = FAN**3  # bounds the sketch yields; a row finds its place among them in three looks at FAN each
SKETCH_ACCURACY = 10 * CUTS
ROWS_PER_BUCKET = 200_000

BUCKET = "_bucket"


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join that treats a NULL key as a value; right keys are dropped."""
    if not keys:
        # the right side is a global aggregate: exactly one row
        return left.join(F.broadcast(right), how=how, on=F.lit(True))
    extra = [c for c in right.columns if c not in keys]
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *extra)
    cond = F.lit(True)
    for i, k in enumerate(keys):
        c = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        cond = c if i == 0 else cond & c
    return left.join(renamed, cond, how).select(*left.columns, *extra)


def with_value_bucket(df: DataFrame, order: str, *, alike: Sequence[str] = (), rows: int | None = None) -> DataFrame:
    """Add a bucket number that never decreases as ``order`` grows.

    ``rows`` asks for buckets of about that many rows where the default is too big.

    ``alike`` lists the columns the caller goes on to use: reading them in the
    sketch too makes both plans share one exchange instead of two.
    """
    # the sketch wants a constant: one text literal, not CUTS + 1 of them
    steps = F.split(F.lit(",".join(str(i / CUTS) for i in range(CUTS + 1))), ",").cast("array<double>")
    counted = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.percentile_approx(F.col(order).cast("double"), steps, F.lit(SKETCH_ACCURACY)).alias("all"),
        *[F.max(c).alias(f"_{c}") for c in alike],
    )
    stride = F.greatest(F.lit(1), F.floor(F.lit(CUTS) * min(rows or ROWS_PER_BUCKET, ROWS_PER_BUCKET) / F.greatest(F.col("n"), F.lit(1)))).cast("int")
    every = lambda c, k: F.filter(c, lambda _, i: i % k == 0)
    cuts = counted.withColumn("_stride", stride).withColumn("c", every(F.col("all"), F.col("_stride")))
    stats = cuts.select(F.struct("c", every(F.col("c"), F.lit(FAN)).alias("b"), every(F.col("c"), F.lit(FAN * FAN)).alias("a"), *[f"_{c}" for c in alike]).alias("s")).scalar()
    v = F.col(order).cast("double")
    less = lambda part: F.size(F.filter(part, lambda x: x < v))
    rough = less(F.col("_stats.a"))
    at = F.col("_at")
    heavy = F.coalesce((v == F.get("_stats.c", at)) & (F.get("_stats.c", at + 1) == v), F.lit(False))
    return (
        df.select("*", stats.alias("_stats"))
        .select("*", rough.alias("_rough"))
        .select("*", F.when(F.col("_rough") > 0, (F.col("_rough") - 1) * FAN + less(F.slice("_stats.b", F.greatest(F.lit(1), (F.col("_rough") - 1) * FAN + 1), FAN)) - 1).alias("_mid"))
        .select("*", F.coalesce(F.col("_mid") * FAN + less(F.slice("_stats.c", F.greatest(F.lit(1), F.col("_mid") * FAN + 1), FAN)), F.lit(0)).alias("_at"))
        .select(*df.columns, (at.cast("bigint") * F.lit(1 << 33) + F.when(heavy, F.lit(1 << 32)).otherwise(0)).cast("bigint").alias(BUCKET))
    )


def is_heavy(bucket: Column) -> Column:
    """True where a bucket holds one value that fills several sketch cuts."""
    return F.shiftright(bucket, 32) % 2 == 1


def with_hash_bucket(df: DataFrame, hashed: str) -> DataFrame:
    """Bucket on leading hash bits; uniform by construction, so no sketch."""
    n = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("_n") / F.lit(ROWS_PER_BUCKET)))).cast("int")
    leading = F.floor(F.col(hashed) / F.pow(F.lit(2.0), F.lit(HASH_BITS) - bits))
    return df.select("*", n.alias("_n")).select(
        *df.columns, leading.cast("bigint").alias(BUCKET)
    )


def running(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str | Column],
    sums: Sequence[str],
    *,
    bucket_on: str | None = None,
) -> DataFrame:
    """Add ``<s>_before`` and ``<s>_total`` for every column in ``sums``.

    ``<s>_before`` is the sum over rows of the same key that sort strictly
    earlier. ``bucket_on`` names the leading numeric order column; leave it out
    when the frame already carries a bucket column.
    """
    by = list(by)
    b = with_value_bucket(df, bucket_on, alike=sums) if bucket_on else df
    per_bucket = b.groupBy(*by, BUCKET).agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    earlier = Window.partitionBy(*by).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    offsets = per_bucket.select(
        *by,
        BUCKET,
        *[F.coalesce(F.sum(f"_t_{s}").over(earlier), F.lit(0)).alias(f"_o_{s}") for s in sums],
        *[F.sum(f"_t_{s}").over(whole).alias(f"{s}_total") for s in sums],
    )
    local = Window.partitionBy(*by, BUCKET).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = null_safe_join(b, offsets, [*by, BUCKET])
    before = [(F.col(f"_o_{s}") + F.coalesce(F.sum(s).over(local), F.lit(0))).alias(f"{s}_before") for s in sums]
    return joined.select(*[c for c in b.columns if c != BUCKET], *[f"{s}_total" for s in sums], *before)


def hash_rank(df: DataFrame, by: Sequence[str], key: str, seed: int) -> DataFrame:
    """Add ``rank`` (1-based, seeded random order within ``by``) and ``n``."""
    hexed = df.select("*", hash_hex(seed, key).alias("_hex"))
    b = with_hash_bucket(hexed.select("*", leading_int(F.col("_hex")).alias("_h"), F.lit(1).cast("bigint").alias("_one")), "_h")
    r = running(b, by, ["_hex", key], ["_one"])
    return r.select(*df.columns, F.col("_one_total").alias("n"), (F.col("_one_before") + 1).cast("bigint").alias("rank"))


def time_number(df: DataFrame, name: str) -> Column:
    """A number that never falls as an order column grows, whatever its type.

    Text goes by its first six bytes; ties are the caller's to order. Times do
    not depend on the session time zone: a timestamp without zone is read field by field: converting it to an
    instant would step backwards at a change of clocks.
    """
    kind = df.schema[name].dataType.typeName()
    if kind == "timestamp_ntz":
        t = F.col(name)
        return (F.unix_date(t.cast("date")) * 86_400.0 + F.hour(t) * 3_600.0 + F.minute(t) * 60.0 + F.extract(F.lit("SECOND"), t).cast("double")).cast("double")
    if kind == "timestamp":
        return F.unix_micros(name).cast("double")
    if kind == "date":
        return F.unix_date(name).cast("double")
    if kind in ("string", "binary"):
        return F.conv(F.rpad(F.hex(F.substring(F.col(name).cast("binary"), 1, 6)), 12, "0"), 16, 10).cast("double")
    return F.col(name).cast("double")


def _is_number(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.NumericType)


def _split_ties(b: DataFrame, tie: str) -> DataFrame:
    """Cut the buckets of single, very common values further, by the tie column.

    Those buckets leave their low 32 bits unused; the tie column's own bucket
    number goes there. Its bounds are sketched over the tied rows alone.
    """
    heavy = is_heavy(F.col(BUCKET))
    t = b.select("*", F.when(heavy, F.col(tie)).alias("_tie")).withColumnRenamed(BUCKET, "_outer")
    inner = with_value_bucket(t, "_tie")
    at, sub = F.shiftright(F.col(BUCKET), 33), F.col(BUCKET) % F.lit(1 << 32)
    low = at * F.lit(1 << 26) + F.least(sub, F.lit((1 << 26) - 1))
    return inner.select(*[c for c in b.columns if c != BUCKET], (F.col("_outer") + F.when(is_heavy(F.col("_outer")), low).otherwise(0)).alias(BUCKET))


def ordered_rank(df: DataFrame, by: Sequence[str], order: str, ties: Sequence[str] = ()) -> DataFrame:
    """Add ``rank`` (1-based) by a numeric, time or text column, and ``n``.

    A single value that fills whole buckets is cut again by a numeric first tie.
    """
    b = df.select("*", F.lit(1).cast("bigint").alias("_one"), time_number(df, order).alias("_num"))
    b = with_value_bucket(b, "_num")
    if ties and _is_number(df, ties[0]):
        b = _split_ties(b, ties[0])
    r = running(b, by, [order, *ties], ["_one"])
    return r.select(*df.columns, F.col("_one_total").alias("n"), (F.col("_one_before") + 1).cast("bigint").alias("rank"))
