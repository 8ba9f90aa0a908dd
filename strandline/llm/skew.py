"""Joins in which one key may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Rows of one key that go to one task, and hot keys that are few enough to be sent to every task.
HOT_ROWS, SMALL_TABLE = 1000, 1_000_000


def hot_keys(many: DataFrame, keys: list[str]) -> tuple[DataFrame, int]:
    """(keys, _parts): the keys of more than HOT_ROWS rows (nulls aside) with the number of parts they are dealt in; and how many they are.

    The table is stored, and marked for broadcast only if its counted rows are few.
    """
    sizes = many.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > HOT_ROWS)
    hot = materialize(sizes.select(*keys, F.ceil(F.col("_n") / HOT_ROWS).cast("long").alias("_parts")), "hot")
    n = hot.count()
    return (F.broadcast(hot) if n <= SMALL_TABLE else hot), n


def join_many(many: DataFrame, one: DataFrame, keys: list[str], how: str = "inner", hot: DataFrame | None = None) -> DataFrame:
    """`many` joined to `one` on `keys`; the rows of a hot key of `many` are dealt to several tasks, each of which gets
    the key's rows of `one`. `how` is inner, left or left_semi. Hot keys are counted, so `many` is read twice, unless a
    small stored table of them (keys, _parts) is given."""
    if hot is None:
        hot, n = hot_keys(many, keys)
        if not n:
            return many.join(one, keys, how)
    else:
        n = hot.count()
        if not n:
            return many.join(one, keys, how)
        hot = F.broadcast(hot) if n <= SMALL_TABLE else hot
    part = F.pmod(F.monotonically_increasing_id(), F.coalesce("_parts", F.lit(1))).alias("_part")
    left = many.join(hot, keys, "left").select(*[F.col(c) for c in many.columns], part)
    right = one.join(hot, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return left.join(right, [*keys, "_part"], how).drop("_part")


def parts_of(counted: DataFrame, keys: list[str], n: str) -> DataFrame:
    """(keys, _parts) of the hot keys of a stored table that has each key's number of rows as `n`."""
    return counted.where(F.col(n) > HOT_ROWS).select(*keys, F.ceil(F.col(n) / HOT_ROWS).cast("long").alias("_parts"))


def pairs_within(members: DataFrame, key: str, item: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """(left, right, keys): `members` twice, so that a join on `keys` brings together every two rows of one `key`
    once in each order; a hot key is cut into parts by `item`, and each two parts meet in a task of their own."""
    hot, n = hot_keys(members, [key])
    if not n:
        return members, members, [key]
    dealt = members.join(hot, key, "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    own = F.pmod(F.xxhash64(item), F.col("_parts"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))
    left = dealt.withColumn("_i", own).withColumn("_j", other).drop("_parts")
    right = dealt.withColumn("_j", own).withColumn("_i", other).drop("_parts")
    return left, right, [key, "_i", "_j"]
