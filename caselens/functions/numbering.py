"""Row numbers per key that do not put a whole key into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number_rows(df: DataFrame, keys: list[str], order: str, out: str, block: int = 65536) -> DataFrame:
    """Rank rows 1..n per key by a unique integer column.

    A key may own a large share of the table, so rows are ranked inside blocks of the order column
    (at most ``block`` rows each) and shifted by the row count of the earlier blocks of that key.
    Only the block counts, one row per key and block, go through the per-key window.
    """
    rows = df.withColumn("_block", F.floor(F.col(order) / F.lit(block)))
    counts = rows.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*keys, "_block").orderBy(order)
    return (
        rows.withColumn("_at", F.row_number().over(inside))
        .join(shifts, [*keys, "_block"])
        .withColumn(out, (F.col("_at") + F.col("_shift")).cast("int"))
        .drop("_block", "_at", "_shift")
    )


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int, out: str = "rank") -> DataFrame:
    """First k rows per key. Spark cuts each input partition to k rows per key before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(out, rank).where(F.col(out) <= k)


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return top_per_key(df, keys, order, 1, "_first").drop("_first")
