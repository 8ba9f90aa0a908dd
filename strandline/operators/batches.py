"""Token-budget batches of a corpus sorted by length, in arrival order, or by bucket and assay.

Batches are ordered folds, so the rows are first numbered in their order and dealt into ranges of PART_ROWS, each of which
a task folds by itself. Range borders close a batch.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import places

BATCH = "part int, range long, batch long, rows long, tokens long, width long"
PART_ROWS = 100_000


def _fold(lengths: list[int], budget: int, most: int, quantum: int, running: bool) -> list[tuple[int, int, int]]:
    """(rows, tokens, width) of each batch: cut before a row that would take rows times width over the budget, or the count over `most`."""
    out, n, tokens, width = [], 0, 0, 0
    for x in lengths:
        w = -(-x // quantum) * quantum
        new = max(width, w) if running else w
        if n and ((n + 1) * new > budget or n >= most):
            out.append((n, tokens, width))
            n = tokens = width = 0
            new = w
        n, tokens, width = n + 1, tokens + x, new
    if n:
        out.append((n, tokens, width))
    return out


def pack_ranges(df: DataFrame, part: Column, order: list[str], budget: int, most: int, quantum: int = 1, running: bool = True) -> DataFrame:
    """part, range, batch, rows, tokens, width of the batches of each part, folded in `order`, PART_ROWS rows at a time."""

    def fold(key, pdf: pd.DataFrame) -> pd.DataFrame:
        got = _fold(pdf.sort_values("_place")["length"].tolist(), budget, most, quantum, running)
        return pd.DataFrame({"part": [key[0]] * len(got), "range": [key[1]] * len(got), "batch": range(len(got)), "rows": [g[0] for g in got], "tokens": [g[1] for g in got], "width": [g[2] for g in got]})

    names = list(dict.fromkeys([*order, "length"]))
    numbered = places(df.select(part.cast("int").alias("part"), *names), ["part"], [F.col(c) for c in order], total="")
    ranged = numbered.select("part", F.floor(F.col("_place") / PART_ROWS).alias("range"), "_place", "length")
    return ranged.groupBy("part", "range").applyInPandas(fold, BATCH)


def bucket_bounds(longest: int, ratio: float = 1.5, first: int = 32) -> list[int]:
    """Geometric upper bounds: each is the one before times `ratio`, rounded up."""
    out = [first]
    while out[-1] < longest:
        out.append(math.ceil(out[-1] * ratio))
    return out


def bucket_of(length: Column, bounds: list[int]) -> Column:
    out = F.lit(len(bounds))
    for k in range(len(bounds) - 1, -1, -1):
        out = F.when(length <= bounds[k], F.lit(k)).otherwise(out)
    return out


def report(batches: DataFrame) -> DataFrame:
    """steps, tokens, padded, padding share, widths, greatest batch."""
    padded = F.col("rows") * F.col("width")
    return batches.agg(F.count("*").alias("steps"), F.sum("tokens").alias("tokens"), F.sum(padded).alias("padded"), (1 - F.sum("tokens") / F.sum(padded)).alias("padding"), F.count_distinct("width").alias("widths"), F.max("rows").alias("most_rows"))


def single_group_batches(df: DataFrame, group: str, order: list[str], size: Column) -> DataFrame:
    """Adds `batch`: rows of one group in order, `size` at a time."""
    numbered = places(df, [group], [F.col(c) for c in order], total="")
    return numbered.withColumn("batch", F.floor(F.col("_place") / size)).drop("_place")

