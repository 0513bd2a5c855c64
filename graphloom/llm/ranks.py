"""Distributed ranks and prefix sums with DataFrame functions: even buckets of a sort key, bucket totals, short windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a bucket, about: what one window of a prefix sum gets.
BUCKET_ROWS = 128
_FAN = 1024


def digest_key(*parts: Column) -> Column:
    """32 hex digits, even over all values; the same in any SQL dialect that has md5."""
    return F.md5(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"))


def key_bucket(key: Column, n: Column) -> Column:
    """Bucket 0 to n - 1 of a hex key, in the key's order."""
    return F.floor(F.conv(F.substring(key, 1, 8), 16, 10).cast("long") * n / F.lit(1 << 32)).cast("long")


def prefix_sums(rows: DataFrame, group: str, bucket: str, order: list, value: str, n_buckets: int, into: str) -> DataFrame:
    """rows with the sum of value over all rows of the group before each row, by bucket and then order (exclusive).

    Rows of a hot group are spread over its buckets: windows see one bucket, and the buckets' totals, which are summed the
    same way in coarser buckets while a group may have more than a few thousand.
    """
    totals = rows.groupBy(group, bucket).agg(F.sum(value).alias("_sum"))
    if n_buckets > 4 * _FAN:
        wider = f"{bucket}_"  # the bucket itself stays, however often buckets are made coarser
        coarse = totals.withColumn(wider, F.floor(F.col(bucket) / _FAN).cast("long"))
        based = prefix_sums(coarse, group, wider, [bucket], "_sum", n_buckets // _FAN + 1, "_base")
    else:
        before = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
        based = totals.withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    based = based.select(F.col(group).alias("_g"), F.col(bucket).alias("_b"), "_base")
    own = Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = rows.withColumn("_own", F.coalesce(F.sum(value).over(own), F.lit(0)))
    joined = inner.join(based, F.col(group).eqNullSafe(F.col("_g")) & (F.col(bucket) == F.col("_b")))
    return joined.select(*rows.columns, (F.col("_base") + F.col("_own")).alias(into))  # in coarser buckets, into is _base itself
