"""Statistics whose definition must hold in every engine: safe correlation, indexed percentiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import average_ranks, join_ranks
from ..session import materialize
from .quantiles import order_statistics


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation; null (not an error) where a column is constant."""
    return F.try_divide(F.covar_pop(x, y), F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)))


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str, least: int = 3) -> DataFrame:
    """keys, n, spearman: correlation of average ranks over rows with both values; null under `least` rows.

    Both columns are ranked in one ranged pass; columns of different types are compared as doubles. Rows are stored before those
    without a value are left out: a filter would be pushed below what the columns are made of, and make it again for each mention.
    """
    kind = None if df.schema[x].dataType == df.schema[y].dataType else "double"
    cast = lambda c: F.col(c) if kind is None else F.col(c).cast(kind)
    both = materialize(df.select(*keys, cast(x).alias("_x"), cast(y).alias("_y")), "pairs").where("_x IS NOT NULL AND _y IS NOT NULL")
    sides = F.explode(F.array(*[F.struct(F.lit(i).alias("side"), F.col(c).alias("v")) for i, c in enumerate(("_x", "_y"))]))
    counts = both.select(*keys, sides.alias("_s")).groupBy(*keys, F.col("_s.side").alias("_side"), F.col("_s.v").alias("_v")).agg(F.count("*").alias("_n"))
    ranks = average_ranks(counts, [*keys, "_side"], "_v", "_rank")
    ranked = both
    for i, c in enumerate(("_x", "_y")):
        one = ranks.where(F.col("_side") == i).select(*keys, F.col("_v").alias(c), F.col("_rank").alias(f"_r{c}"), "_n")
        ranked = join_ranks(ranked, one, [*keys, c])
    out = ranked.groupBy(*keys).agg(F.count("*").alias("n"), safe_corr(F.col("_r_x"), F.col("_r_y")).alias("_r"))
    return out.select(*keys, "n", F.when(F.col("n") >= least, F.col("_r")).alias("spearman"))


def indexed(df: DataFrame, keys: Sequence[str], value: str, index: Column) -> DataFrame:
    """keys, value: the element at 0-based `index` (may use _n, the key's row count) in ascending order; keys of any size."""
    return order_statistics(df, keys, value, {value: index})


def upper_median(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """sorted[n // 2]."""
    return indexed(df, keys, value, F.floor(F.col("_n") / 2))


def nearest_rank(df: DataFrame, keys: Sequence[str], value: str, p: float) -> DataFrame:
    """sorted[min(n - 1, int(p * n))]."""
    return indexed(df, keys, value, F.least(F.col("_n") - 1, F.floor(F.col("_n") * F.lit(p))))


def sign_test_p(wins: Column, losses: Column) -> Column:
    """Two-sided exact binomial p of `wins` against `losses` (ties left out before)."""
    n, k = wins + losses, F.greatest(wins, losses)
    term = F.transform(F.sequence(k.cast("int"), n.cast("int")), lambda i: F.exp(_log_choose(n, i) - n * F.log(F.lit(2.0))))
    tail = F.aggregate(term, F.lit(0.0), lambda a, x: a + x)
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * tail))


def _log_choose(n: Column, k: Column) -> Column:
    steps = F.when(k >= 1, F.sequence(F.lit(1), k.cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.lit(0.0), lambda a, j: a + F.log((n - k + j).cast("double") / j.cast("double")))
