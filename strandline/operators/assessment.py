"""Hits, ladders, motifs, blind-test fields and paired comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.quantiles import joined, percentiles
from .boards import verdict_of
from .ranking import places


def best_hits(hits: DataFrame) -> DataFrame:
    """Of each chain the hit with the least e-value, then the highest score, then the first."""
    w = Window.partitionBy("chain").orderBy("evalue", F.desc("score"), "pos")
    return hits.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def titration_ladders(df: DataFrame, least: int) -> DataFrame:
    """construct, ion, rows, levels, least, greatest of series with at least `least` distinct concentrations (4 places)."""
    s = df.groupBy("construct", "ion").agg(F.count("*").alias("rows"), F.count_distinct(F.round("conc", 4)).alias("levels"), F.min("conc").alias("least"), F.max("conc").alias("greatest"))
    return s.where(F.col("levels") >= least)


def ladder_monotonicity(df: DataFrame) -> DataFrame:
    """construct, ion, n, rho of concentration and mean reactivity (ties averaged), folding (rho under -0.3), first and last means."""
    keys = ["construct", "ion"]
    p = df.groupBy(*keys, "conc").agg(F.avg("reactivity").alias("r"))
    rho = stats.spearman(p.withColumn("q", F.round("r", 9)), keys, "conc", "q").withColumnRenamed("spearman", "rho")
    ends = p.groupBy(*keys).agg(F.min_by("r", "conc").alias("first_mean"), F.max_by("r", "conc").alias("last_mean"))
    return rho.join(ends, keys).select(*keys, "n", "rho", F.coalesce(F.col("rho") < -0.3, F.lit(False)).alias("folding"), "first_mean", "last_mean")


def base_profile(motifs: DataFrame, longest: int = 24) -> DataFrame:
    """kind, pos, base, n, share of each symbol among those seen at its place."""
    p = motifs.where("signature <> ''").select("kind", F.posexplode(F.split("signature", "-")).alias("pos", "base")).where(F.col("pos") < longest)
    n = p.groupBy("kind", "pos", "base").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("kind", "pos")))


def frequency_ids(df: DataFrame, value: str) -> DataFrame:
    """value, n, id: dense ids, the most frequent value first (ties by value); one row per distinct value."""
    n = df.groupBy(value).agg(F.count("*").alias("n"))
    return places(n, [], [F.desc("n"), F.col(value)], "id", total="").withColumn("id", F.col("id") + 1)


def field_summary(field: DataFrame, ours: DataFrame) -> DataFrame:
    """target, n, best and median of each measure (best rmsd is the least), and our places by tm and rmsd (null if we have none)."""
    own = ours.groupBy(F.col("target").alias("_t")).agg(F.max("tm").alias("_tm"), F.min("rmsd").alias("_rmsd"))
    j = field.join(own, F.col("target") == F.col("_t"), "left")
    return j.groupBy("target").agg(
        F.count("*").alias("n"), F.max("tm").alias("best_tm"), F.median("tm").alias("median_tm"), F.max("lddt").alias("best_lddt"), F.median("lddt").alias("median_lddt"),
        F.min("rmsd").alias("best_rmsd"), F.median("rmsd").alias("median_rmsd"), F.when(F.max("_tm").isNotNull(), F.count_if(F.col("tm") > F.col("_tm")) + 1).alias("place_tm"), F.when(F.max("_tm").isNotNull(), F.count_if(F.col("rmsd") < F.col("_rmsd")) + 1).alias("place_rmsd"),
    )


def field_report(field: DataFrame, solved: float = 0.45) -> DataFrame:
    """targets, mean_best, mean_median, solved: over targets, the mean of the best and of the median TM, and on how many the best
    reaches `solved`."""
    best = field.groupBy("target").agg(F.max("tm").alias("b"))
    t = joined(best, percentiles(field, ["target"], "tm", {"m": 0.5}), ["target"])
    return t.agg(F.count("*").alias("targets"), F.avg("b").alias("mean_best"), F.avg("m").alias("mean_median"), F.count_if(F.col("b") >= solved).alias("solved"))


def paired_sign_test(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """n, mean_delta (b - a), wins, losses, p over the keys both arms have; ties count in n alone."""
    j = a.select(key, F.col(value).alias("_a")).join(b.select(key, F.col(value).alias("_b")), key)
    d = F.col("_b") - F.col("_a")
    s = j.agg(F.count("*").alias("n"), F.avg(d).alias("mean_delta"), F.count_if(d > 0).alias("wins"), F.count_if(d < 0).alias("losses"))
    return s.withColumn("p", stats.sign_test_p(F.col("wins"), F.col("losses")))


def ab_verdict(tests: DataFrame, spread: float) -> DataFrame:
    """Adds `verdict` from mean_delta against the spread of equal runs, and p (see `boards.verdict_of`)."""
    return tests.withColumn("verdict", verdict_of(F.col("mean_delta"), F.col("p"), spread))


def partial_correlation(df: DataFrame, x: str, y: str, given: str) -> DataFrame:
    """n, raw, partial: correlation of x and y, and of what a straight line over `given` leaves of them."""
    line = lambda v: (F.regr_slope(F.col(v), F.col(given)), F.regr_intercept(F.col(v), F.col(given)))
    (sx, ix), (sy, iy) = line(x), line(y)
    fit = df.agg(sx.alias("sx"), ix.alias("ix"), sy.alias("sy"), iy.alias("iy"), stats.safe_corr(F.col(x), F.col(y)).alias("raw"), F.count("*").alias("n"))
    e = df.join(F.broadcast(fit))  # one row
    ex, ey = F.col(x) - (F.col("sx") * F.col(given) + F.col("ix")), F.col(y) - (F.col("sy") * F.col(given) + F.col("iy"))
    return e.groupBy("n", "raw").agg(stats.safe_corr(ex, ey).alias("partial"))
