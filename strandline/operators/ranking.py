"""Places and ranks inside keys, however many rows a key has: ranges of the order, then places inside them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

#: Rows of a value that go to one task at least; rows of a table that goes to every task.
HOT_ROWS, SMALL_TABLE = 1000, 1_000_000


def _ranged(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The rows, stored, with the number `_p` of the range of (keys, order) they fall in."""
    return materialize(df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("_p", F.spark_partition_id()), "ranges")


def _offsets(ranged: DataFrame, keys: Sequence[str], weight: Column) -> DataFrame:
    """keys, _p, _before (what earlier ranges of the key hold) and _total: a row for each key and range it reaches."""
    sizes = ranged.groupBy(*keys, "_p").agg(F.sum(weight).alias("_c"))
    every = Window.partitionBy(*keys)
    earlier = F.coalesce(F.sum("_c").over(every.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sizes.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_p").alias("_q"), earlier.alias("_before"), F.sum("_c").over(every).alias("_total"))


def _with_offsets(ranged: DataFrame, keys: Sequence[str], weight: Column) -> DataFrame:
    same = F.col("_p") == F.col("_q")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return ranged.join(_offsets(ranged, keys, weight), same).drop("_q", *[f"_k{i}" for i in range(len(keys))])


def places(df: DataFrame, keys: Sequence[str], order: Sequence[Column], place: str = "_place", total: str = "_total") -> DataFrame:
    """Adds the row's place from 0 inside its key by `order`, which should tell rows apart, and the key's number of rows."""
    r = _with_offsets(_ranged(df, keys, order), keys, F.lit(1))
    inside = F.row_number().over(Window.partitionBy(*keys, "_p").orderBy(*order)) - 1
    return r.withColumn("_in", inside).select(*df.columns, (F.col("_before") + F.col("_in")).cast("long").alias(place), *([F.col("_total").alias(total)] if total else []))


def average_ranks(counts: DataFrame, keys: Sequence[str], value: str, rank: str) -> DataFrame:
    """keys, value, rank (from 1 inside `keys`, ties averaged) and _n, stored, of counted distinct values (keys, value, _n)."""
    r = _with_offsets(_ranged(counts, keys, [F.col(value)]), keys, F.col("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*keys, "_p").orderBy(value))
    r = r.withColumn("_upto", upto).select(*keys, value, (F.col("_before") + F.col("_upto") - F.col("_n") + (F.col("_n") + 1) / 2).alias(rank), "_n")
    return materialize(r, "ranks")


def join_ranks(df: DataFrame, ranks: DataFrame, on: Sequence[str]) -> DataFrame:
    """`df` joined to `average_ranks`' result.

    A value may stand in most rows of a key (a constant score): values of more than a millionth of all rows, of which there are a
    million at most, go to every task, so no task gets the rows of such a value.
    """
    n_values, n_rows = ranks.agg(F.count("*"), F.coalesce(F.sum("_n"), F.lit(0))).first()
    if n_values <= SMALL_TABLE:
        return df.join(F.broadcast(ranks.drop("_n")), on)
    often = F.col("_n") > max(HOT_ROWS, n_rows // SMALL_TABLE)
    return df.join(F.broadcast(ranks.where(often).drop("_n")), on).unionByName(df.join(ranks.where(~often).drop("_n"), on))


def with_average_rank(df: DataFrame, keys: Sequence[str], value: str, rank: str) -> DataFrame:
    """Rows that have the value and the keys, with its rank from 1 inside `keys`, ties averaged. Equal values are counted
    first and ranked by ranges; the ranks then go back to the rows."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    return join_ranks(df, average_ranks(counts, keys, value, rank), [*keys, value])
