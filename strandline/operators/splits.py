"""Reproducible splits, leak guards and digests."""

from __future__ import annotations

import math
from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .ranking import places


def md5_bucket(key: Column) -> Column:
    """md5(key) as a whole number mod 100, from its two halves (16^16 is 16 modulo 100)."""
    h = F.md5(key)
    high, low = (F.conv(part, 16, 10).cast("decimal(20,0)") % 100 for part in (F.substring(h, 1, 16), F.substring(h, 17, 16)))
    return ((high * 16 + low) % 100).cast("int")


def hash_split(key: Column, train: int = 80, validation: int = 10) -> Column:
    b = md5_bucket(key)
    return F.when(b < train, "train").when(b < train + validation, "validation").otherwise("test")


def salted_fraction(salt: str, key: Column) -> Column:
    """The first 8 bytes of sha1(salt:key), big-endian, over 2^64."""
    return F.conv(F.substring(F.sha1(F.concat(F.lit(salt + ":"), key)), 1, 16), 16, 10).cast("double") / F.lit(float(1 << 64))


def salted_split(salt: str, key: Column, fraction: float = 0.2) -> Column:
    return F.when(salted_fraction(salt, key) < fraction, "val").otherwise("train")


def transfer_holdout(split: Column, family: Column, held: str) -> Column:
    """A whole family goes to `transfer`."""
    return F.when(family == held, "transfer").otherwise(split)


def family_groups(df: DataFrame) -> DataFrame:
    """group, size, oversized: families (an entry without one is its own), too large if over 5 % of all."""
    group = F.coalesce("family", F.concat(F.lit("entry:"), "entry"))
    sizes = materialize(df.groupBy(group.alias("group")).agg(F.sum("length").alias("size")), "sizes")
    total = sizes.agg(F.sum("size").alias("_all"))
    return sizes.join(F.broadcast(total)).select("group", "size", (F.col("size") > 0.05 * F.col("_all")).alias("oversized"))  # one row


def _turns(lack: list[Fraction], size: int, n: int) -> list[tuple[int, int, list[int]]]:
    """(first, until, order): how n groups of one size go in turn to the split that lacks most (ties to the first): the
    groups from `first` to `until` go round the splits of `order`. Updates `lack`.

    Only so many stretches as there are splits: a split that lags takes groups alone, or in turn with others
    that lag as much, until the next one is level.
    """
    out, at = [], 0
    while at < n:
        # Splits within one group's size of the greatest lack take turns from here on, most lacking first.
        top = max(lack)
        level = sorted((i for i in range(len(lack)) if top - lack[i] < size), key=lambda i: (-lack[i], i))
        below = [x for i, x in enumerate(lack) if i not in level]
        # Whole rounds until one that is not among them would be: it joins when within one size of the greatest.
        rounds = n if not below or not size else max(1, math.ceil((top - max(below)) / size) - 1)
        took = min(n - at, rounds * len(level))
        out.append((at, at + took, level))
        for place, i in enumerate(level):
            lack[i] -= size * (took // len(level) + (place < took % len(level)))
        at += took
    return out


def family_disjoint_split(df: DataFrame, shares: Sequence[tuple[str, float]] = (("train", 0.6), ("val", 0.2), ("test", 0.2)), seed: str = "0", most: int = 5_000_000) -> DataFrame:
    """group, size, split: no family in two splits.

    Oversized groups are for the first split. The others, largest first (ties by sha256(seed:group), then name), each
    go to the split furthest below its share of the assigned residues (ties in the given order). Groups of one
    size differ in nothing else, so the driver folds over the distinct sizes and their counts (more than `most` of them
    raise an error), and a group finds its split by its number among those of its size.
    """
    groups = materialize(family_groups(df), "groups")
    total, big = groups.agg(F.sum("size"), F.sum(F.when(F.col("oversized"), F.col("size")))).first()
    sizes = groups.where("NOT oversized").groupBy("size").agg(F.count("*").alias("n"))
    if sizes.count() > most:
        raise ValueError(f"more than {most} sizes")
    lack = [Fraction(str(w)) * (total or 0) for _, w in shares]
    lack[0] -= big or 0
    plan = [(r.size_, first, until, order) for r in sizes.withColumnRenamed("size", "size_").sort(F.desc("size_")).collect() for first, until, order in _turns(lack, r.size_, r.n)]
    table = groups.sparkSession.createDataFrame(plan, "_size long, _first long, _until long, _order array<int>")
    small = groups.where("NOT oversized").withColumn("_h", F.substring(F.sha2(F.concat(F.lit(seed + ":"), "group"), 256), 1, 16))
    numbered = places(small, ["size"], [F.col("_h"), F.col("group")], total="")
    table = F.broadcast(table) if len(plan) <= 1_000_000 else table
    met = numbered.join(table, (F.col("size") == F.col("_size")) & (F.col("_place") >= F.col("_first")) & (F.col("_place") < F.col("_until")))
    turn = F.element_at("_order", (F.pmod(F.col("_place") - F.col("_first"), F.size("_order")) + 1).cast("int"))
    names = F.array(*[F.lit(s) for s, _ in shares])
    placed = met.select("group", "size", F.element_at(names, turn + 1).alias("split"))
    return placed.unionByName(groups.where("oversized").select("group", "size", F.lit(shares[0][0]).alias("split")))


def entry_holdout(df: DataFrame, seed: str = "0", fraction: float = 0.2) -> DataFrame:
    """entry, family: of each oversized family max(1, round-half-even(fraction n)) entries in sha256(seed/ribo/entry) order."""
    big = family_groups(df).where("oversized").select(F.col("group").alias("family"))
    entries = df.join(big, "family", "left_semi").select("family", "entry").distinct().withColumn("_h", F.sha2(F.concat(F.lit(f"{seed}/ribo/"), "entry"), 256))
    numbered = places(entries, ["family"], [F.col("_h"), F.col("entry")])
    return numbered.where(F.col("_place") < F.greatest(F.lit(1), F.bround(F.col("_total") * F.lit(fraction)))).select("family", "entry")


def resplit(df: DataFrame, shares: Sequence[tuple[str, float]] = (("train", 0.6), ("val", 0.2), ("test", 0.2)), seed: str = "0", held: str = "test_ribosomal") -> DataFrame:
    """entry, family, split from the metadata alone: its group's split, and `held` for the entries held out of oversized families."""
    groups = family_disjoint_split(df, shares, seed)
    entries = df.select("entry", "family").distinct().withColumn("group", F.coalesce("family", F.concat(F.lit("entry:"), "entry")))
    out = entry_holdout(df, seed).withColumn("_held", F.lit(True))
    j = entries.join(groups.select("group", "split"), "group").join(out, ["family", "entry"], "left")
    return j.select("entry", "family", F.when(F.col("_held"), F.lit(held)).otherwise(F.col("split")).alias("split"))


def shared_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def leak_guard(benchmark: DataFrame, train: DataFrame, keys: Sequence[str], fail: bool = False) -> DataFrame:
    """key, leaks: distinct values of each key that stand on both sides; raises when asked to and there are any."""
    out = None
    for k in keys:
        one = shared_keys(benchmark, train, k).agg(F.count("*").alias("leaks")).select(F.lit(k).alias("key"), "leaks")
        out = one if out is None else out.unionByName(one)
    if fail and (bad := out.where("leaks > 0").collect()):
        raise ValueError(f"leaks: {[(r.key, r.leaks) for r in bad]}")
    return out


def in_several_splits(df: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Keys that stand in more than one split."""
    return df.groupBy(key).agg(F.min(split).alias("_a"), F.max(split).alias("_b"), F.count_distinct(split).alias("splits")).where("_a < _b").select(key, "splits")


def digest(df: DataFrame, parts: Sequence[str], digits: int = 8) -> DataFrame:
    """sha1 over the distinct 'a:b' lines in order, cut to `digits`; for tables of names, such as assays or shards."""
    lines = F.array_sort(F.collect_set(F.concat_ws(":", *parts)))
    return df.agg(F.substring(F.sha1(F.array_join(lines, "\n")), 1, digits).alias("digest"), F.count_distinct(F.concat_ws(":", *parts)).alias("n"))


def content_digest(df: DataFrame, group: str, row: Column, cuts: int = 256) -> DataFrame:
    """group, rows, digest: sha1 of the sorted sha1s of `cuts` parts of a group's rows, each the sha1 of its sorted
    row hashes. Two levels keep a large group's rows in many tasks; the same rows give the same digest in any order."""
    h = F.sha1(row)
    part = F.substring(h, 1, max(1, len(f"{cuts - 1:x}")))
    parts = df.groupBy(group, part.alias("_p")).agg(F.sha1(F.array_join(F.array_sort(F.collect_list(h)), "")).alias("_d"), F.count("*").alias("_n"))
    return parts.groupBy(group).agg(F.sum("_n").alias("rows"), F.sha1(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "_p", "_d"))), "")).alias("digest"))


def split_summary(df: DataFrame, split: str = "split") -> DataFrame:
    return df.groupBy(split).agg(F.count("*").alias("rows"), F.sum("length").alias("residues"))
