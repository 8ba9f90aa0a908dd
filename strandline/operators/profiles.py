"""One-pass profiles of label and feature columns, and what departs from a declared list."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Classes of a column that are counted; a column with more has no list of classes.
CLASSES = 64
PARTS = "field string, class double, n long, over boolean, rows long, known long, nonzero long, tail long, s double, q double, least double, most double"


def _sketch(columns: Sequence[str], classes: int, tail: float):
    """For each task: a row of sums for each column, and a row for each of its classes, or a mark that there are too many."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, dict[float, int] | None] = {c: {} for c in columns}
        sums = {c: np.zeros(6) for c in columns}
        ends = {c: [np.inf, -np.inf] for c in columns}
        for pdf in frames:
            for c in columns:
                x = pd.to_numeric(pdf[c], errors="coerce").to_numpy(dtype=np.float64)
                v = x[np.isfinite(x)]
                sums[c] += (len(x), len(v), (v != 0).sum(), (v <= tail).sum(), v.sum(), (v * v).sum())
                if len(v):
                    ends[c] = [min(ends[c][0], v.min()), max(ends[c][1], v.max())]
                counts = seen[c]
                if counts is not None:
                    kinds, n = np.unique(v + 0.0, return_counts=True)
                    for k, m in zip(kinds.tolist(), n.tolist(), strict=True) if len(kinds) <= classes else ():
                        counts[k] = counts.get(k, 0) + m
                    if len(kinds) > classes or len(counts) > classes:
                        seen[c] = None
        rows: list[tuple[Any, ...]] = []
        for c in columns:
            rows.append((c, None, 0, seen[c] is None, *map(int, sums[c][:4]), *map(float, sums[c][4:]), *ends[c]))
            rows += [(c, k, n, False, 0, 0, 0, 0, 0.0, 0.0, np.inf, -np.inf) for k, n in (seen[c] or {}).items()]
        yield pd.DataFrame(rows, columns=[p.split()[0] for p in PARTS.split(", ")])

    return run


def column_profiles(df: DataFrame, columns: Sequence[str], classes: int = CLASSES, tail: float = -6.0) -> DataFrame:
    """field, rows, finite, nonzero_share, tail_share (at most `tail`), mean, sd (population), least, greatest, constant, classes,
    shares: a row for each column.

    `classes` is the number of distinct finite values and `shares` those values with their shares of the finite rows, most
    frequent first; both are null for a column with more than `classes` of them. Null, NaN and infinite values are not finite;
    a column without finite values is not constant. One pass: a task keeps at most `classes` values a column, so what is
    merged does not grow with the rows.
    """
    parts = materialize(df.select(*[F.col(c).cast("double").alias(c) for c in columns]).mapInPandas(_sketch(list(columns), classes, tail), PARTS), "profiles")
    sums = parts.where("class IS NULL").groupBy("field").agg(
        F.sum("rows").alias("rows"), F.sum("known").alias("finite"), F.sum("nonzero").alias("_nz"), F.sum("tail").alias("_t"), F.sum("s").alias("_s"), F.sum("q").alias("_q"), F.min("least").alias("least"), F.max("most").alias("greatest"), F.bool_or("over").alias("_over")
    )
    counts = parts.where("class IS NOT NULL").groupBy("field", "class").agg(F.sum("n").alias("n"))
    lists = counts.groupBy("field").agg(F.count("*").alias("_k"), F.collect_list(F.struct((-F.col("n")).alias("n"), F.col("class"))).alias("_c"))
    # An empty table may have no task, so the fields come from their list.
    fields = df.sparkSession.createDataFrame([(c,) for c in columns], "field string")
    j = fields.join(sums, "field", "left").join(lists, "field", "left").fillna(0, ["rows", "finite"]).withColumn("_few", ~F.coalesce("_over", F.lit(False)) & (F.coalesce("_k", F.lit(0)) <= classes))
    n = F.nullif(F.col("finite"), F.lit(0)).cast("double")
    mean = F.col("_s") / n
    known = F.col("finite") > 0
    shares = F.transform(F.array_sort(F.coalesce("_c", F.array().cast("array<struct<n:bigint,class:double>>"))), lambda r: F.struct(r["class"].alias("class"), (-r["n"] / F.col("finite")).alias("share")))
    return j.select(
        "field", "rows", "finite", (F.col("_nz") / n).alias("nonzero_share"), (F.col("_t") / n).alias("tail_share"), mean.alias("mean"), F.when(known, F.sqrt(F.greatest(F.col("_q") / n - mean * mean, F.lit(0.0)))).alias("sd"),
        F.when(known, F.col("least")).alias("least"), F.when(known, F.col("greatest")).alias("greatest"), (known & (F.col("least") == F.col("greatest"))).alias("constant"),
        F.when(F.col("_few"), F.coalesce("_k", F.lit(0))).alias("classes"), F.when(F.col("_few"), shares).alias("shares"),
    )


def profile_findings(profiles: DataFrame, constant: Sequence[str] = (), standard: Sequence[str] = (), shares: Mapping[str, tuple[float, float]] | None = None, least: Mapping[str, int] | None = None, most_tail: float = 0.001) -> DataFrame:
    """field, finding: where profiles depart from what is declared.

    `constant`: the columns that are constant by construction; any other that is, or one of them that is not, is a finding.
    `standard`: z-scores, whose mean is within 0.05 of 0, whose sd is between 0.95 and 1.05, and of which less than
    `most_tail` lie in the tail. `shares`: the range, ends left out, of a column's non-zero share. `least`: the fewest
    classes of a column; one with too many classes to list has enough. Columns without any finite value are a finding of their own.
    """
    f, found = F.col("field"), []
    tests = [
        ("no finite value", F.col("finite") == 0),
        ("undeclared constant", F.col("constant") & ~f.isin(list(constant) or [""])),
        ("declared constant varies", ~F.col("constant") & (F.col("finite") > 0) & f.isin(list(constant) or [""])),
        ("not standardised", f.isin(list(standard) or [""]) & ~(F.coalesce((F.abs("mean") < 0.05) & (F.col("sd") > 0.95) & (F.col("sd") < 1.05), F.lit(False)))),
        ("heavy tail", f.isin(list(standard) or [""]) & (F.col("tail_share") >= most_tail)),
    ]
    for name, (lo, hi) in (shares or {}).items():
        tests.append(("non-zero share out of range", (f == name) & ~F.coalesce((F.col("nonzero_share") > lo) & (F.col("nonzero_share") < hi), F.lit(False))))
    for name, n in (least or {}).items():
        tests.append(("too few classes", (f == name) & F.coalesce(F.col("classes") < n, F.lit(False))))
    for text, test in tests:
        found.append(F.when(F.coalesce(test, F.lit(False)), text))
    return profiles.select("field", F.explode(F.array_distinct(F.array_compact(F.array(*found)))).alias("finding"))
