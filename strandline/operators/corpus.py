"""Filtering, deduplication, profiles and samples of sequence corpora."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..functions import stats
from .ranking import places


def filter_reason(length: Column, header: Column, least: int, most: int, drop: str | None = None, need: str | None = None) -> Column:
    """Why a record goes, by the first rule it fails: length, then a pattern it must not, then one it must match; null: kept."""
    out = F.when(~length.between(least, most), "length")
    if drop:
        out = out.when(header.rlike(drop), "annotation")
    if need:
        out = out.when(~header.rlike(need), "not_wanted")
    return out


def annotation_filter(df: DataFrame, least: int, most: int, drop: str | None = None, need: str | None = None) -> DataFrame:
    return df.withColumn("reason", filter_reason(F.length("sequence"), F.col("header"), least, most, drop, need))


def measured(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Thin rows that stand for sequences from here on: the kept columns, a 128-bit digest, length, GC and N counts.
    Sequences themselves are read once and never shuffled."""
    s = F.col("sequence")
    return df.select(*keep, F.md5(s.cast("binary")).alias("digest"), F.length(s).alias("length"), S.gc_count(s).alias("gc"), S.symbol_count(s, "N").alias("unknown"))


def dedup_exact(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key. Firsts are found by partial minima, so a common key costs no task its rows; long keys
    should be digests (`measured`)."""
    first = df.groupBy(key).agg(F.min(order).alias(order))
    return df.join(first, [key, order], "left_semi")


def ingest_counts(thin: DataFrame, known: DataFrame) -> DataFrame:
    """reason, n, share of rows (digest, id, reason): those with a reason by it; of the others those whose digest is in
    `known` (already_in_corpus), of each other digest the rows of the least id (kept), and the rest (duplicate).

    Digests are counted, so no row is joined and a common sequence costs no task its rows.
    """
    each = thin.where("reason IS NULL").groupBy("digest", "id").agg(F.count("*").alias("_n")).groupBy("digest").agg(F.sum("_n").alias("_all"), F.min_by("_n", "id").alias("_first"))
    each = each.join(known.select("digest").distinct().withColumn("_in", F.lit(True)), "digest", "left")
    rows = F.when(F.col("_in"), F.array(F.struct(F.lit("already_in_corpus").alias("reason"), F.col("_all").alias("n"))))
    rows = rows.otherwise(F.array(F.struct(F.lit("kept").alias("reason"), F.col("_first").alias("n")), F.struct(F.lit("duplicate").alias("reason"), (F.col("_all") - F.col("_first")).alias("n"))))
    counts = each.select(F.explode(rows).alias("r")).select("r.*").unionByName(thin.where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n")))
    counts = counts.groupBy("reason").agg(F.sum("n").alias("n")).where("n > 0")
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def not_in_corpus(df: DataFrame, corpus: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in no row of `corpus`."""
    return df.join(corpus.select(key), key, "left_anti")


def filter_counters(df: DataFrame) -> DataFrame:
    """reason (kept, or why not), n, share."""
    counts = df.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def composition(df: DataFrame, keys: Sequence[str], symbols: str = "ACGTUN") -> DataFrame:
    """keys, symbol, n, share: symbols counted inside each sequence, then summed."""
    sums = df.groupBy(*keys).agg(*[F.sum(c).alias(f"_{s}") for s, c in S.base_counts(F.col("sequence"), symbols).items()], F.sum(F.length("sequence")).alias("_all"))
    rows = F.explode(F.array(*[F.struct(F.lit(s).alias("symbol"), F.col(f"_{s}").alias("n")) for s in symbols]))
    return sums.select(*keys, "_all", rows.alias("r")).select(*keys, "r.symbol", "r.n", F.try_divide(F.col("r.n"), F.col("_all")).alias("share")).where("n > 0")


def chunk_profile(thin: DataFrame, keys: Sequence[str], bands: Sequence[int] = (200, 500, 1500)) -> DataFrame:
    """Per key of `measured` rows: n, median and mean length, GC and N percent over all characters, percent in each length band."""
    n = F.col("length")
    edges = [0, *bands]
    inside = [F.avg(((n >= lo) & (n < hi)).cast("double")) * 100 for lo, hi in zip(edges, bands, strict=False)] + [F.avg((n >= bands[-1]).cast("double")) * 100]
    names = [f"pct_{lo}_{hi}" for lo, hi in zip(edges, bands, strict=False)] + [f"pct_{bands[-1]}_up"]
    return thin.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.median(n).alias("median_length"),
        F.avg(n).alias("mean_length"),
        F.try_divide(F.sum("gc") * 100.0, F.sum(n)).alias("gc_pct"),
        F.try_divide(F.sum("unknown") * 100.0, F.sum(n)).alias("n_pct"),
        *[c.alias(a) for c, a in zip(inside, names, strict=True)],
    )


def corpus_stats(df: DataFrame, key: str) -> DataFrame:
    """Per key: sequences, nucleotides, least, greatest, mean and upper median length."""
    rows = df.select(key, F.length("sequence").alias("length"))
    middle = stats.upper_median(rows, [key], "length").withColumnRenamed("length", "upper_median")
    sums = rows.groupBy(key).agg(F.count("*").alias("sequences"), F.sum("length").alias("nucleotides"), F.min("length").alias("least"), F.max("length").alias("greatest"), F.avg("length").alias("mean"))
    return sums.join(middle, key, "left")


def pooled_profile(df: DataFrame, key: str) -> DataFrame:
    """Rollup: per key and pooled (null key)."""
    return df.rollup(key).agg(F.count("*").alias("n"), F.max(F.length("sequence")).alias("max_length"), F.avg(F.length("sequence")).alias("mean_length"))


def coverage_compare(df: DataFrame, key: str, in_first: Column, flag: float = 0.10) -> DataFrame:
    """Means of per-key statistics of two groups of keys, their relative difference, and whether it is under `flag`."""
    n = F.length("sequence")
    per = df.groupBy(key, in_first.alias("_first")).agg(F.avg(n).alias("mean"), F.median(n).alias("median"), F.percentile(n, 0.1).alias("p10"), F.percentile(n, 0.9).alias("p90"), (F.sum(S.gc_count(F.col("sequence"))) / F.sum(n)).alias("gc"))
    names = ["mean", "median", "p10", "p90", "gc"]
    two = per.agg(*[F.avg(F.when(side, F.col(m))).alias(f"{m}_{t}") for m in names for side, t in ((F.col("_first"), "a"), (~F.col("_first"), "b"))])
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("statistic"), F.col(f"{m}_a").alias("a"), F.col(f"{m}_b").alias("b")) for m in names]))
    return two.select(rows.alias("r")).select("r.*").withColumn("relative", F.abs(F.col("a") - F.col("b")) / F.col("b")).withColumn("close", F.col("relative") < flag)


def length_histogram(df: DataFrame, keys: Sequence[str], bounds: Sequence[int]) -> DataFrame:
    return df.groupBy(*keys, S.length_band(F.length("sequence"), bounds).alias("band")).agg(F.count("*").alias("n"))


def tv_distance(df: DataFrame, key: str, bounds: Sequence[int]) -> DataFrame:
    """Total-variation distance of each key's length histogram to the whole corpus's."""
    h = length_histogram(df, [key], bounds)
    share = h.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(key)))
    pool = h.groupBy("band").agg(F.sum("n").alias("m")).withColumn("q", F.col("m") / F.sum("m").over(Window.partitionBy())).select("band", "q")
    every = h.select(key).distinct().join(F.broadcast(pool))  # bands are a fixed handful
    return every.join(share.select(key, "band", "p"), [key, "band"], "left").groupBy(key).agg((F.sum(F.abs(F.coalesce("p", F.lit(0.0)) - F.col("q"))) / 2).alias("tv"))


def unique_tiers(df: DataFrame, key: str, tiers: dict[str, Column]) -> DataFrame:
    """Per key: rows, unique sequences, those shared with another key, and unique ones in each tier."""
    one = df.select(key, "sequence", *[c.alias(t) for t, c in tiers.items()])
    per = one.groupBy("sequence", key).agg(F.count("*").alias("_n"), *[F.max(t).alias(t) for t in tiers])
    width = per.groupBy("sequence").agg(F.count("*").alias("_keys"))
    return per.join(width, "sequence").groupBy(key).agg(F.sum("_n").alias("rows"), F.count("*").alias("unique_sequences"), F.count_if(F.col("_keys") > 1).alias("shared"), *[F.count_if(F.col(t)).alias(f"unique_{t}") for t in tiers])


# --- samples


def head_sample(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The first n rows of each key (n is small: the plan keeps n rows of a key per task before the shuffle)."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", rn).where(F.col("_rn") <= n).drop("_rn")


def stride_sample(df: DataFrame, order: str, limit: int) -> DataFrame:
    """Every floor(N / limit)-th row in order, the first `limit` of them."""
    step = F.greatest(F.lit(1), F.floor(F.col("_total") / F.lit(limit)))
    return places(df, [], [F.col(order)]).where((F.pmod("_place", step) == 0) & (F.floor(F.col("_place") / step) < limit)).drop("_place", "_total")


def hash_sample(df: DataFrame, keys: Sequence[str], id_col: str, n: int, seed: str = "7") -> DataFrame:
    """n rows of each key, uniform without replacement: the least md5(seed:id)."""
    order = F.md5(F.concat_ws(":", F.lit(seed), F.col(id_col).cast("string")))
    return head_sample(df.withColumn("_h", order), keys, ["_h", id_col], n).drop("_h")


def even_subsample(df: DataFrame, keys: Sequence[str], order: str, n: int) -> DataFrame:
    """n rows of each key at evenly spaced places: int(i * (N - 1) / (n - 1)); all rows if there are no more than n."""
    placed = places(df, keys, [F.col(order)])
    # The i-th place is the row r with i = ceil(r (n-1) / (N-1)) and int(i (N-1) / (n-1)) = r.
    i = F.ceil(F.col("_place") * F.lit(n - 1) / (F.col("_total") - 1))
    hit = F.floor(i * (F.col("_total") - 1) / F.lit(n - 1)) == F.col("_place")
    return placed.where((F.col("_total") <= n) | hit).drop("_place", "_total")


def stratified_sample(df: DataFrame, bounds: Sequence[int], n: int, id_col: str, seed: str = "7") -> DataFrame:
    """max(1, round-half-even(n * share)) rows of each length band, by md5(seed:id): band, id and need."""
    banded = df.withColumn("band", S.length_band(F.length("sequence"), bounds))
    counts = banded.groupBy("band").agg(F.count("*").alias("_c"))
    need = counts.withColumn("need", F.greatest(F.lit(1), F.bround(F.lit(float(n)) * F.col("_c") / F.sum("_c").over(Window.partitionBy()))).cast("long")).select("band", "need")
    thin = banded.select("band", id_col, F.md5(F.concat_ws(":", F.lit(seed), F.col(id_col).cast("string"))).alias("_h"))
    chosen = places(thin, ["band"], [F.col("_h"), F.col(id_col)], total="").join(need, "band").where(F.col("_place") < F.col("need"))
    return chosen.drop("_h", "_place")


def heldout_shards(df: DataFrame, group: str, name: str, n: int) -> DataFrame:
    """The last n names of each group that has more than n."""
    w = Window.partitionBy(group)
    names = df.select(group, name).distinct()
    return names.withColumn("_rn", F.row_number().over(w.orderBy(F.desc(name)))).withColumn("_c", F.count("*").over(w)).where((F.col("_rn") <= n) & (F.col("_c") > n)).select(group, name)


def interleave(df: DataFrame, shard: str, order: str, n: int) -> DataFrame:
    """Adds (cycle, turn, place): shards in groups of n, one row of each shard in turn."""
    shards = places(df.select(shard).distinct(), [], [F.col(shard)], "_s", total="")
    turns = places(df, [shard], [F.col(order)], "turn", total="")
    return turns.join(shards, shard).withColumn("cycle", F.floor(F.col("_s") / n)).withColumn("place", F.pmod("_s", F.lit(n))).drop("_s")
