"""Exact order statistics of keys of any size: small keys are sorted as lists, hot ones refined by counts of value ranges."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

#: Values of a key that are sorted as one list; ranges into which a hot key's values are counted in a round.
LIST_ROWS, RANGES = 50_000, 1024
#: Rows of a table that goes to every task.
SMALL_TABLE = 1_000_000


def _same(n_keys: int, one: str = "_k", two: str = "_o") -> Column:
    out = F.lit(True)
    for i in range(n_keys):
        out = out & F.col(f"{one}{i}").eqNullSafe(F.col(f"{two}{i}"))
    return out


def _known(df: DataFrame) -> DataFrame:
    """Marked for broadcast if its counted rows are few."""
    return F.broadcast(df) if df.count() <= SMALL_TABLE else df


def _share(v: Column, lo: Column, hi: Column) -> Column:
    """Where a value lies in its range, from 0 to 1: in proportion to its size if the range's ends are of one sign and
    within a factor of a million, else to its logarithm. It never falls as the value grows, so parts keep the order."""
    v, lo, hi = (c.cast("double") for c in (v, lo, hi))
    near = ((lo > 0) & (hi <= lo * 1e6)) | ((hi < 0) & (lo >= hi * 1e6))
    # No finite double's logarithm to base 2 is below -1075.
    scale = lambda x: F.when(x == 0, F.lit(0.0)).otherwise(F.signum(x) * (F.log2(F.abs(x)) + 1100))
    return F.when(near, (v - lo) / (hi - lo)).otherwise((scale(v) - scale(lo)) / (scale(hi) - scale(lo)))


def _by_lists(rows: DataFrame, keys: list[str], names: Sequence[str], n: int) -> DataFrame:
    """Keys with _at0, ... places: the values there, by a sorted list of the key's."""
    lists = rows.groupBy(*keys, *[f"_at{i}" for i in range(n)]).agg(F.array_sort(F.collect_list("_v")).alias("_s"))
    return lists.select(*keys, *[F.get("_s", F.col(f"_at{i}").cast("int")).alias(name) for i, name in enumerate(names)], F.size("_s").cast("long").alias("_n"))


def _by_ranges(rows: DataFrame, hot: DataFrame, keys: list[str], names: Sequence[str]) -> DataFrame:
    """The same for keys of any size.

    Each place wanted starts with the range from its key's least to its greatest value. A round cuts every range into
    RANGES, counts the values in each part, with their least and greatest, and goes on with the part that holds the place,
    till a range is one value. What is shuffled is counts, RANGES for each range and task at most.
    """
    n, count = len(keys), range(len(keys))
    other = [F.col(k).alias(f"_o{i}") for i, k in enumerate(keys)]
    wanted = F.explode(F.array(*[F.struct(F.lit(i).alias("q"), F.col(f"_at{i}").alias("at")) for i in range(len(names))]))
    open_ = hot.withColumn("_w", wanted).where("_w.at >= 0 AND _w.at < _n").select(*keys, "_w.q", "_w.at", F.col("_least").alias("lo"), F.col("_most").alias("hi"), F.lit(0).cast("long").alias("before"), "_n")
    open_ = materialize(open_, "ranges")
    found = open_.where("lo = hi")
    while not (left := open_.where("lo < hi")).isEmpty():
        ranges = _known(materialize(left.select(*other, "lo", "hi").distinct(), "cuts"))
        inside = rows.join(ranges, _same(n, "_k", "_o") & (F.col("_v") >= F.col("lo")) & (F.col("_v") <= F.col("hi")))
        part = F.least(F.lit(RANGES - 1), F.floor(_share(F.col("_v"), F.col("lo"), F.col("hi")) * RANGES))
        counts = inside.groupBy(*[f"_o{i}" for i in count], "lo", "hi", part.alias("part")).agg(F.count("*").alias("n"), F.min("_v").alias("least"), F.max("_v").alias("most"))
        upto = F.sum("n").over(Window.partitionBy(*[f"_o{i}" for i in count], "lo", "hi").orderBy("part"))
        counts = counts.withColumn("upto", upto).withColumnsRenamed({"lo": "_lo", "hi": "_hi"})
        at = F.col("at") - F.col("before")
        holds = _same(n, "_k", "_o") & (F.col("lo") == F.col("_lo")) & (F.col("hi") == F.col("_hi")) & (at < F.col("upto")) & (at >= F.col("upto") - F.col("n"))
        step = left.join(counts, holds).select(*keys, "q", "at", F.col("least").alias("lo"), F.col("most").alias("hi"), (F.col("before") + F.col("upto") - F.col("n")).alias("before"), "_n")
        open_ = materialize(step, "ranges")
        found = found.unionByName(open_.where("lo = hi"))
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("q") == i, F.col("lo"))).alias(name) for i, name in enumerate(names)], F.max("_n").alias("_n"))


def order_statistics(df: DataFrame, keys: Sequence[str], value: str, places: Mapping[str, Column]) -> DataFrame:
    """keys and a column for each name of `places`: the value at that 0-based place of the key's ascending order.

    A place may use `_n`, the key's number of values; one beyond them gives null. Null and not finite values are left out, and
    keys without others have no row; a null key is a key. Without keys there is one row, or none for an empty table.
    """
    return _with_counts(df, keys, value, places).drop("_n")


def _with_counts(df: DataFrame, keys: Sequence[str], value: str, places: Mapping[str, Column]) -> DataFrame:
    """`order_statistics` with _n, the key's number of values."""
    own, count, names = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], range(len(keys)), list(places)
    v = F.col(value)
    finite = v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf"))
    rows = materialize(df.where(finite).select(*own, v.alias("_v")), "values")
    inner = [f"_k{i}" for i in count]
    sizes = rows.groupBy(*inner).agg(F.count("*").alias("_n"), F.min("_v").alias("_least"), F.max("_v").alias("_most")).where("_n > 0")
    sizes = materialize(sizes.select("*", *[p.cast("long").alias(f"_at{i}") for i, p in enumerate(places.values())]), "sizes")
    small = sizes.where(F.col("_n") <= LIST_ROWS).select(*[F.col(f"_k{i}").alias(f"_o{i}") for i in count], *[f"_at{i}" for i in range(len(names))])
    found = _by_lists(rows.join(_known(small), _same(len(keys))), inner, names, len(names))
    hot = sizes.where(F.col("_n") > LIST_ROWS)
    if not hot.isEmpty():
        found = found.unionByName(_by_ranges(rows, hot, inner, names))
    return found.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], *names, "_n")


def percentiles(df: DataFrame, keys: Sequence[str], value: str, shares: Mapping[str, float], how: str = "linear") -> DataFrame:
    """keys and a column (double) for each name of `shares`, the key's percentile at that share.

    linear: between the two values about (n - 1) * share. nearest: the value at min(n - 1, int(share * n)). rounded: that at
    round(share * (n - 1)), halves to even.
    """
    n = F.col("_n")
    if how == "linear":
        places = {}
        for name, p in shares.items():
            at = (n - 1) * F.lit(float(p))
            places |= {f"_lo_{name}": F.floor(at), f"_hi_{name}": F.ceil(at)}
        both = _with_counts(df, keys, value, places)
        part = lambda p: (n - 1) * F.lit(float(p)) - F.floor((n - 1) * F.lit(float(p)))
        low = lambda name: F.col(f"_lo_{name}").cast("double")
        return both.select(*keys, *[(low(name) + (F.col(f"_hi_{name}").cast("double") - low(name)) * part(p)).alias(name) for name, p in shares.items()])
    at = {"nearest": lambda p: F.least(n - 1, F.floor(n * F.lit(float(p)))), "rounded": lambda p: F.rint((n - 1) * F.lit(float(p)))}[how]
    found = order_statistics(df, keys, value, {name: at(p) for name, p in shares.items()})
    return found.select(*keys, *[F.col(name).cast("double").alias(name) for name in shares])


def joined(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on keys that may be null, without the right side's copies of them."""
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(right.withColumnsRenamed({k: f"_r_{k}" for k in keys}), same, "left").drop(*[f"_r_{k}" for k in keys])
