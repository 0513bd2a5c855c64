"""Dense numbers of sorted values without a window over the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dense_numbers(values: DataFrame, column: str, into: str) -> DataFrame:
    """values (distinct) with 0, 1, ... in the column's order: a distributed sort, counts of its parts, places within."""
    at = values.orderBy(F.col(column).asc_nulls_last()).withColumn("_at", F.monotonically_increasing_id()).cache()
    parts = at.groupBy(F.shiftright("_at", 33).alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each sorted part
    base = parts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    number = F.col("_base") + F.col("_at").bitwiseAND((1 << 33) - 1)
    return at.join(base, F.shiftright("_at", 33) == F.col("_part")).select(column, number.cast("int").alias(into))
