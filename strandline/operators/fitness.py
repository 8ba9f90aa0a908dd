"""Mutational assays: cleaning, rank targets, scores and leaderboards."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import mutations as M
from ..functions import stats
from ..functions.quantiles import joined, percentiles
from .ranking import with_average_rank


def finite_scores(df: DataFrame, score: str = "dms_score") -> DataFrame:
    x = F.col(score).try_cast("double")
    return df.withColumn(score, x).where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def excluded(df: DataFrame, reasons: DataFrame, key: str = "assay") -> DataFrame:
    """Rows whose assay is in no row of `reasons`."""
    return df.join(reasons.select(key), key, "left_anti")


def first_source_wins(first: DataFrame, second: DataFrame, key: str = "assay") -> DataFrame:
    """All of `first`, and the assays of `second` that it lacks."""
    return first.unionByName(second.join(first.select(key).distinct(), key, "left_anti"))


def reconstruct_check(df: DataFrame) -> DataFrame:
    """assay, n_mutant_rows, n_parsed, n_wt_base_ok, n_variant_ok, accepted (all equal)."""
    p = df.withColumn("_m", M.parse_mutations(F.col("mutant")))
    sums = p.groupBy("assay").agg(
        F.count("mutant").alias("n_mutant_rows"),
        F.count("_m").alias("n_parsed"),
        F.count_if(M.wild_type_agrees(F.col("wt"), F.col("_m"))).alias("n_wt_base_ok"),
        F.count_if(M.apply_mutations(F.col("wt"), F.col("_m")) == F.col("sequence")).alias("n_variant_ok"),
    )
    return sums.withColumn("accepted", (F.col("n_mutant_rows") == F.col("n_parsed")) & (F.col("n_parsed") == F.col("n_wt_base_ok")) & (F.col("n_wt_base_ok") == F.col("n_variant_ok")))


def rank_positions(df: DataFrame, score: str = "dms_score") -> DataFrame:
    """Adds `quantile`: (average rank - 1/2) / n of the score inside its assay."""
    n = df.groupBy("assay").agg(F.count("*").alias("_n"))
    ranked = with_average_rank(df, ["assay"], score, "_rank").join(n, "assay")
    return ranked.withColumn("quantile", (F.col("_rank") - 0.5) / F.col("_n")).drop("_rank", "_n")


def rank_normal(df: DataFrame, score: str = "dms_score") -> DataFrame:
    """Adds `target`: the normal quantile of the score's rank inside its assay."""
    from statistics import NormalDist

    @F.pandas_udf("float")
    def normal(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        inverse = NormalDist().inv_cdf
        for p in parts:
            yield p.map(lambda x: inverse(min(max(x, 1e-12), 1 - 1e-12)))

    return rank_positions(df, score).withColumn("target", normal("quantile")).drop("quantile")


def per_assay_summary(df: DataFrame) -> DataFrame:
    """assay, n, source (of the first row), length, least, median and greatest score."""
    sums = df.groupBy("assay").agg(
        F.count("*").alias("n"),
        F.min_by("source", F.struct("k1", "k2")).alias("source"),
        F.max(F.length("wt")).alias("length"),
        F.min("dms_score").alias("least"),
        F.max("dms_score").alias("greatest"),
    )
    middle = percentiles(df, ["assay"], "dms_score", {"median": 0.5})
    return joined(sums, middle, ["assay"]).select("assay", "n", "source", "length", "least", "median", "greatest")


def depth_baseline(df: DataFrame) -> DataFrame:
    """assay, n, spearman of minus the number of mutations and the score; null with one depth."""
    d = df.withColumn("_depth", -M.mutation_count(F.col("mutant")))
    return stats.spearman(d, ["assay"], "_depth", "dms_score")


def auc_mcc(df: DataFrame, score: str) -> DataFrame:
    """assay, auc, mcc of `score` against labels 'above the assay's median': AUC by rank sums, the better side of 1/2;
    MCC of 'score above its median', unsigned. Null where one class is empty."""
    medians = percentiles(df, ["assay"], "dms_score", {"_my": 0.5}).join(percentiles(df, ["assay"], score, {"_ms": 0.5}), "assay", "left")
    j = df.join(medians, "assay").withColumn("_y", F.col("dms_score") > F.col("_my")).withColumn("_s", F.col(score) > F.col("_ms"))
    r = with_average_rank(j, ["assay"], score, "_r")
    c = lambda a, b: F.count_if(a & b).cast("double")
    y, s = F.col("_y"), F.col("_s")
    sums = r.groupBy("assay").agg(F.count_if(y).cast("double").alias("p"), F.count_if(~y).cast("double").alias("q"), F.sum(F.when(y, F.col("_r"))).alias("rs"), c(y, s).alias("tp"), c(~y, ~s).alias("tn"), c(~y, s).alias("fp"), c(y, ~s).alias("fn"))
    auc = F.try_divide(F.col("rs") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * F.col("q"))
    root = F.sqrt((F.col("tp") + F.col("fp")) * (F.col("tp") + F.col("fn")) * (F.col("tn") + F.col("fp")) * (F.col("tn") + F.col("fn")))
    return sums.select("assay", F.greatest(auc, 1 - auc).alias("auc"), F.abs(F.try_divide(F.col("tp") * F.col("tn") - F.col("fp") * F.col("fn"), root)).alias("mcc"))


def wt_marginal_scores(df: DataFrame, logprobs: DataFrame, by: list[str]) -> DataFrame:
    """by, score: sum over a variant's mutations of logp(mt) - logp(wt) from (assay, pos, base, logp); null if one is missing."""
    m = df.withColumn("_m", F.explode(M.parse_mutations(F.col("mutant")))).select(*by, F.col("_m.pos").alias("pos"), F.col("_m.wt").alias("wt_base"), F.col("_m.mt").alias("mt_base"))
    mt = logprobs.select("assay", "pos", F.col("base").alias("mt_base"), F.col("logp").alias("l_mt"))
    wt = logprobs.select("assay", "pos", F.col("base").alias("wt_base"), F.col("logp").alias("l_wt"))
    j = m.join(mt, ["assay", "pos", "mt_base"], "left").join(wt, ["assay", "pos", "wt_base"], "left").withColumn("_d", F.col("l_mt") - F.col("l_wt"))
    return j.groupBy(*by).agg(F.when(F.count("*") == F.count("_d"), F.sum("_d")).alias("score"))


def mutation_contexts(df: DataFrame) -> DataFrame:
    """assay, variants, contexts: distinct sets of mutated places."""
    places = F.array_join(F.array_sort(F.transform(M.parse_mutations(F.col("mutant")), lambda m: m["pos"])), ",")
    return df.groupBy("assay").agg(F.count("*").alias("variants"), F.count_distinct(places).alias("contexts"))


def leaderboard(per_assay: DataFrame, published: DataFrame, model: str, categories: list[str]) -> DataFrame:
    """model, macro, place: means of |spearman| per category, then over `categories` (null if one is missing); the
    depth baseline (undefined as 0) is a row of its own; nulls last."""
    by = per_assay.groupBy("category").agg(F.avg(F.abs("spearman")).alias("v"), F.avg(F.abs(F.coalesce("baseline", F.lit(0.0)))).alias("b")).where(F.col("category").isin(categories))
    full = F.count("v") == len(categories)
    own = by.agg(F.when(full, F.avg("v")).alias("macro"), F.avg("b").alias("floor"))
    rows = own.select(F.explode(F.array(F.struct(F.lit(model).alias("model"), F.col("macro").alias("macro")), F.struct(F.lit("mutation count").alias("model"), F.col("floor").alias("macro")))).alias("r")).select("r.*")
    every = rows.unionByName(published.select("model", "macro"))
    return every.withColumn("place", F.rank().over(Window.orderBy(F.desc(F.coalesce("macro", F.lit(-9.0))))))


def scoring_problems(scored: DataFrame, score: str) -> DataFrame:
    """check, severity, assay, detail: constant scores, unscored variants, correlation that cannot be had."""
    s = scored.groupBy("assay").agg(F.count("*").alias("n"), F.count(score).alias("k"), F.min(score).alias("lo"), F.max(score).alias("hi"))
    checks: list[tuple[str, str, Column, Column]] = [
        ("constant_score", "CRIT", F.col("lo") == F.col("hi"), F.col("k")),
        ("unscored", "WARN", F.col("k") < F.col("n"), F.col("n") - F.col("k")),
        ("no_correlation", "CRIT", F.col("k") < 3, F.col("k")),
    ]
    rows = F.filter(F.array(*[F.struct(F.lit(c).alias("check"), F.lit(v).alias("severity"), d.cast("long").alias("detail"), w.alias("w")) for c, v, w, d in checks]), lambda r: F.coalesce(r["w"], F.lit(False)))
    return s.select("assay", F.explode(rows).alias("r")).select("r.check", "r.severity", "assay", "r.detail")
