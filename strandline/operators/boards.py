"""Boards of benchmark scores: category means, ranked tables, fields of submissions, and what is wrong with them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import percentiles
from ..session import materialize


def category_means(per_assay: DataFrame, expected: Mapping[str, int]) -> DataFrame:
    """category, n_expected, n_scored, signed, abs, auc, depth_baseline, baseline_undefined for every expected category.

    `per_assay` has category, spearman, auc and baseline. A correlation that is null or not a number is no score; the
    baseline is averaged over all assays of the category, an undefined one as 0, so that both stand for the same assays.
    """
    finite = lambda c: F.when(F.col(c).isNotNull() & ~F.isnan(c), F.col(c))
    base = finite("baseline")
    means = per_assay.groupBy("category").agg(
        F.count(finite("spearman")).alias("_scored"), F.avg(finite("spearman")).alias("signed"), F.avg(F.abs(finite("spearman"))).alias("abs"), F.avg(finite("auc")).alias("auc"),
        F.avg(F.coalesce(base, F.lit(0.0))).alias("depth_baseline"), F.count_if(base.isNull()).alias("_undefined"),
    )
    wanted = per_assay.sparkSession.createDataFrame(list(expected.items()), "category string, n_expected long")
    return wanted.join(means, "category", "left").select(
        "category", "n_expected", F.coalesce("_scored", F.lit(0)).alias("n_scored"), "signed", "abs", "auc", "depth_baseline", F.coalesce("_undefined", F.lit(0)).alias("baseline_undefined")
    )


def ranked_board(means: DataFrame, published: DataFrame, model: str) -> DataFrame:
    """model, a column for each category, macro, place: the run's signed means, the baseline's ('mutation count') and the
    published rows, by macro mean; a missing one comes last.

    `published` has model and a column for each category; the categories are its other columns. A macro mean needs all of them.
    """
    names = [c for c in published.columns if c not in ("model", "macro")]
    of = lambda value: [F.max(F.when(F.col("category") == c, F.col(value))).alias(c) for c in names]
    rows = means.agg(F.lit(model).alias("model"), *of("signed")).unionByName(means.agg(F.lit("mutation count").alias("model"), *of("depth_baseline")))
    every = rows.unionByName(published.select("model", *names)).withColumn("macro", sum((F.col(c) for c in names), F.lit(0.0)) / len(names))
    # A row for each model.
    return every.withColumn("place", F.row_number().over(Window.orderBy(F.desc(F.coalesce("macro", F.lit(-9.0))), "model")))


def incomplete_categories(means: DataFrame) -> DataFrame:
    """check, severity, category, detail: categories to whose mean fewer or more assays contributed than expected."""
    return means.where("n_scored <> n_expected").select(F.lit("incomplete_category").alias("check"), F.lit("CRIT").alias("severity"), "category", F.concat_ws(" of ", "n_scored", "n_expected").alias("detail"))


def field_measures(field: DataFrame, ours: DataFrame, measures: Mapping[str, str]) -> DataFrame:
    """target, n and, for each measure, best_, median_ and place_: the field's best and median, and the place of our best among
    them, one more than the number strictly better. `measures` says for each column whether 'max' or 'min' is best.

    A submission without a value has no part in that measure; where we have none, or none with a value, the place is null.
    """
    field = materialize(field.select("target", *measures), "field")
    least = {m for m, kind in measures.items() if kind == "min"}
    best = lambda m: F.min(m) if m in least else F.max(m)
    own = ours.groupBy(F.col("target").alias("_t")).agg(*[best(m).alias(f"_{m}") for m in measures])
    joined = field.join(own, F.col("target") == F.col("_t"), "left")
    better = lambda m: F.col(m) < F.col(f"_{m}") if m in least else F.col(m) > F.col(f"_{m}")
    out = joined.groupBy("target").agg(
        F.count("*").alias("n"), *[best(m).alias(f"best_{m}") for m in measures], *[F.when(F.max(f"_{m}").isNotNull(), F.count_if(better(m)) + 1).alias(f"place_{m}") for m in measures]
    )
    for m in measures:
        out = out.join(percentiles(field, ["target"], m, {f"median_{m}": 0.5}), "target", "left")
    return out


def bond_warning(geometry: DataFrame, least: float = 0.5) -> DataFrame:
    """n, mean_validity, warning: the mean over models of the halves' sum of c4_n_ok and p_p_ok, and whether it is so low that
    the models are no bonded chains. A missing share is 0; without models there is no warning."""
    both = 0.5 * (F.coalesce("c4_n_ok", F.lit(0.0)) + F.coalesce("p_p_ok", F.lit(0.0)))
    return geometry.agg(F.count("*").alias("n"), F.avg(both).alias("mean_validity")).withColumn("warning", F.coalesce(F.col("mean_validity") < least, F.lit(False)))


def source_digest(files: DataFrame, name: str, sha: str, digits: int = 16) -> DataFrame:
    """digest, n: SHA-256 over each file's name and hash in the order of the names, cut to `digits`; for a folder's files."""
    lines = F.array_sort(F.collect_list(F.struct(F.col(name).alias("a"), F.col(sha).alias("b"))))
    return files.agg(F.substring(F.sha2(F.array_join(F.transform(lines, lambda r: F.concat(r["a"], r["b"])), ""), 256), 1, digits).alias("digest"), F.count("*").alias("n"))


def verdict_of(mean_delta: Column, p: Column, spread: float) -> Column:
    """What an arm's mean delta against the spread of equal runs, and its best p, say of it. A significant loss inside the spread
    is a weak loss, not 'no effect'; a loss beyond it needs no test."""
    sure = p < 0.05
    return (
        F.when((mean_delta > spread) & sure, "keep")
        .when(mean_delta > spread, "inconclusive, leaning positive")
        .when(mean_delta < -spread, "worse")
        .when((mean_delta < 0) & sure, "worse, weakly")
        .when(F.abs(mean_delta) <= spread, "no effect")
    )


def by_category(values: Sequence[str], key: Column) -> Column:
    """The value that the number in `key` picks in turn."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))
