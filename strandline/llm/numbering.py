"""Gapless numbers inside each key without sorting a key in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number_within(df: DataFrame, keys: list[str], order: Column, ties: list[str], out: str, digits: int = 3) -> DataFrame:
    """Add `out`: the row's place (from 0) inside `keys`, ordered by the hex text `order`, then `ties`.

    Each key is cut by the first `digits` hex digits of `order`; the cuts' counts give offsets, so
    a key that holds most rows is still numbered by many tasks. Rows equal in all of these are
    interchangeable. `df` should be a stored table: it is read twice.
    """
    cut = df.withColumn("_order", order).withColumn("_cut", F.substring("_order", 1, digits))
    counts = cut.groupBy(*keys, "_cut").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *[F.col(k).alias(f"_o_{k}") for k in keys],
        F.col("_cut").alias("_o_cut"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
    )
    same = F.col("_cut") == F.col("_o_cut")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_o_{k}"))
    inside = Window.partitionBy(*keys, "_cut").orderBy("_order", *ties)
    return (
        cut.withColumn("_rn", F.row_number().over(inside))
        .join(offsets, same)
        .withColumn(out, (F.col("_offset") + F.col("_rn") - 1).cast("long"))
        .drop("_order", "_cut", "_rn", "_o_cut", "_offset", *[f"_o_{k}" for k in keys])
    )
