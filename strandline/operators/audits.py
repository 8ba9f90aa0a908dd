"""Audits of corpora and chain tables: coverage, sensitivity, gates, manifests, weighted and shared samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.quantiles import joined, percentiles
from .ranking import places


def coverage_character(entries: DataFrame, covered: DataFrame, key: str, size: str, top: int = 34) -> DataFrame:
    """covered (yes or no), n, total, mean, greatest, top_share: the `top` largest entries' part of the total."""
    flag = covered.select(key).distinct().withColumn("_c", F.lit(True))
    e = entries.select(key, size).join(flag, key, "left").withColumn("covered", F.coalesce("_c", F.lit(False)))
    rn = F.row_number().over(Window.partitionBy("covered").orderBy(F.desc(size), key))
    big = e.withColumn("_rn", rn).where(F.col("_rn") <= top).groupBy("covered").agg(F.sum(size).alias("_top"))
    s = e.groupBy("covered").agg(F.count("*").alias("n"), F.sum(size).alias("total"), F.avg(size).alias("mean"), F.max(size).alias("greatest"))
    return s.join(big, "covered").withColumn("top_share", F.try_divide(F.col("_top"), F.col("total"))).drop("_top")


def definition_sensitivity(df: DataFrame, key: str, value: str, definitions: dict[str, Column]) -> DataFrame:
    """key, one total per definition, and delta of the last to the first."""
    names = list(definitions)
    s = df.groupBy(key).agg(*[F.sum(F.when(c, F.col(value))).alias(n) for n, c in definitions.items()])
    zero = lambda n: F.coalesce(F.col(n), F.lit(0))
    return s.select(key, *[zero(n).alias(n) for n in names], (zero(names[-1]) - zero(names[0])).alias("delta"))


def guard_sensitivity(df: DataFrame, key: str, value: str, guards: Sequence[int]) -> DataFrame:
    """guard, keys, rows, mean: the mean over keys of their mean value, for keys with at least `guard` rows."""
    per = df.groupBy(key).agg(F.count(value).alias("_n"), F.avg(value).alias("_m"))
    g = per.withColumn("guard", F.explode(F.array(*[F.lit(x) for x in guards]))).where(F.col("_n") >= F.col("guard"))
    return g.groupBy("guard").agg(F.count("*").alias("keys"), F.sum("_n").alias("rows"), F.avg("_m").alias("mean"))


def common_covered(df: DataFrame, groupings: Sequence[str], least: int) -> DataFrame:
    """Rows whose group is large enough under every grouping. Sizes are summed first, so a large group is no task's burden."""
    for g in groupings:
        big = df.groupBy(F.col(g).alias("_g")).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select("_g")
        df = df.join(big, F.col(g).eqNullSafe(F.col("_g")), "left_semi")
    return df


def equal_share_sample(df: DataFrame, shard: str, id_col: str, n: int, seed: str = "7") -> DataFrame:
    """ceil(n / shards) rows of each shard by md5(seed:id), n in total at most (by turn, then shard)."""
    shards = df.select(shard).distinct().agg(F.count("*").alias("_s"))
    h = F.md5(F.concat_ws(":", F.lit(seed), F.col(id_col).cast("string")))
    numbered = places(df.withColumn("_h", h), [shard], [F.col("_h"), F.col(id_col)], "_rn", total="")
    few = numbered.join(F.broadcast(shards)).where(F.col("_rn") < F.ceil(F.lit(n) / F.col("_s")))  # one row
    return few.orderBy("_rn", shard).limit(n).drop("_h", "_rn", "_s")


def weighted_sample(df: DataFrame, id_col: str, weight: str, n: int, seed: str = "7") -> DataFrame:
    """n rows without replacement with chances by weight (null: 1): the least -ln(u) / w with u from md5(seed:id)."""
    u = (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col(id_col).cast("string"))), 1, 13), 16, 10).cast("double") + 1) / float(1 << 52)
    w = F.coalesce(F.col(weight).cast("double"), F.lit(1.0))
    return df.where(w > 0).withColumn("_k", -F.ln(u) / w).orderBy("_k", id_col).limit(n).drop("_k")


def value_counters(df: DataFrame, fields: Sequence[str], top: int = 40) -> DataFrame:
    """field, value, n: the `top` most frequent values of each field, ties by value."""
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]))
    n = df.select(rows.alias("r")).select("r.*").where("value IS NOT NULL").groupBy("field", "value").agg(F.count("*").alias("n"))
    rn = F.row_number().over(Window.partitionBy("field").orderBy(F.desc("n"), "value"))
    return n.withColumn("_rn", rn).where(F.col("_rn") <= top).drop("_rn")


def degenerate_predictors(df: DataFrame, group: str, score: str, truth: str, least_sd: float) -> DataFrame:
    """group, n, spearman, sd, degenerate (spread under `least_sd`)."""
    s = df.groupBy(group).agg(F.stddev_pop(score).alias("sd"))
    return stats.spearman(df, [group], score, truth).join(s, group).withColumn("degenerate", F.col("sd") < least_sd)


def unobserved(modelled: DataFrame, missing: DataFrame) -> DataFrame:
    """entry, chain, n_modelled, n_missing, share missing; a chain that is wholly missing stays, with 1."""
    m = modelled.groupBy("entry", "chain").agg(F.count_distinct("seq_id").alias("_m"))
    u = missing.groupBy("entry", "chain").agg(F.count_distinct("seq_id").alias("_u"))
    j = m.join(u, ["entry", "chain"], "full").select("entry", "chain", F.coalesce("_m", F.lit(0)).alias("n_modelled"), F.coalesce("_u", F.lit(0)).alias("n_missing"))
    return j.withColumn("share", F.col("n_missing") / (F.col("n_modelled") + F.col("n_missing")))


def geometry_gate(df: DataFrame, value: str, ideal: float, tolerance: float, most_sd: float, coords: Sequence[str], furthest: float = 256.0, fail: bool = False) -> DataFrame:
    """n, median, sd (from the quartiles), far (greatest coordinate), ok; raises when asked to and it is not."""
    far = F.greatest(*[F.max(F.abs(c)) for c in coords])
    middle = percentiles(df, [], value, {"median": 0.5, "_low": 0.25, "_high": 0.75})
    g = joined(df.agg(F.count(value).alias("n"), far.alias("far")), middle, [])
    g = g.select("n", "median", ((F.col("_high") - F.col("_low")) / 1.349).alias("sd"), "far")
    g = g.withColumn("ok", (F.abs(F.col("median") - ideal) <= tolerance) & (F.col("sd") <= most_sd) & (F.col("far") <= furthest))
    if fail and not g.first().ok:
        raise ValueError(f"geometry out of bounds: {g.first().asDict()}")
    return g


def chain_metadata(residues: DataFrame, contacts: DataFrame) -> DataFrame:
    """entry, length, resolved (share with all of x, y, z), n_contacts, contacts_per_nt, fragment (under 32 residues)."""
    whole = (F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull()).cast("double")
    r = residues.groupBy("entry").agg(F.count("*").alias("length"), F.avg(whole).alias("resolved"))
    c = contacts.groupBy("entry").agg(F.count("*").alias("_c"))
    j = r.join(c, "entry", "left").withColumn("n_contacts", F.coalesce("_c", F.lit(0))).drop("_c")
    return j.withColumn("contacts_per_nt", F.col("n_contacts") / F.col("length")).withColumn("fragment", F.col("length") < 32)


def usable_chains(meta: DataFrame, shortest: int = 32, longest: int = 4608, contacts: int = 8) -> DataFrame:
    return meta.where(F.col("length").between(shortest, longest) & (F.col("n_contacts") >= contacts))


def dataset_manifest(meta: DataFrame, family: str) -> DataFrame:
    """chains, residues, least, greatest, families, largest_family (by chains, ties by name)."""
    f = meta.groupBy(family).agg(F.count("*").alias("_n"))
    s = meta.agg(F.count("*").alias("chains"), F.sum("length").alias("residues"), F.min("length").alias("least"), F.max("length").alias("greatest"))
    top = f.agg(F.count(family).alias("families"), F.min_by(family, F.struct((-F.col("_n")).alias("a"), F.col(family).alias("b"))).alias("largest_family"))
    return s.join(F.broadcast(top))


def leak_status(counters: DataFrame, assays: int, expected: int = 31) -> DataFrame:
    """key, leaks, status: ALERT where a leak was counted or the number of scored assays is not the expected one."""
    rows = counters.select("key", "leaks").unionByName(counters.sparkSession.createDataFrame([("scored_assays", abs(assays - expected))], "key string, leaks long"))
    return rows.withColumn("status", F.when(F.col("leaks") > 0, "ALERT").otherwise("OK"))


def rising_counter(df: DataFrame, value: str, as_of: Column, minutes: int = 30) -> DataFrame:
    """run_id, stage, rising (last above the one before), live (last row younger than `minutes`)."""
    w = Window.partitionBy("run_id", "stage").orderBy(F.desc("step"))
    two = df.withColumn("_r", F.row_number().over(w)).where("_r <= 2")
    at = lambda r, c: F.max(F.when(F.col("_r") == r, F.col(c)))
    t = two.groupBy("run_id", "stage").agg(at(1, value).alias("_a"), at(2, value).alias("_b"), at(1, "ts").alias("_ts"))
    # Whole seconds would put a row up to one second beside the limit on its wrong side.
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return t.select("run_id", "stage", F.coalesce(F.col("_a") > F.col("_b"), F.lit(False)).alias("rising"), (micros(as_of) - micros(F.col("_ts")) < minutes * 60_000_000).alias("live"))
