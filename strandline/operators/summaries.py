"""Summaries of chains, entries and ladders by length bin, class and source, with exact tails at any size."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import joined, percentiles
from ..session import materialize


def band(value: Column, edges: Sequence[float]) -> Column:
    """'lo-hi' of the half-open band that holds the value; null outside all of them."""
    out = F.lit(None).cast("string")
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        out = F.when((value >= lo) & (value < hi), f"{lo}-{hi}").otherwise(out)
    return out


def each_and_all(df: DataFrame, keys: Sequence[str], bin_: str, aggregates: Sequence[Column], shares: Mapping[str, Mapping[str, float]], how: str = "linear") -> DataFrame:
    """Rows per (keys, bin) and per keys with bin 'all': `aggregates`, and for each value of `shares` its percentiles.

    Rows outside every bin (null) count in 'all' alone. Aggregates come from one pass over grouping sets. `df` is read
    several times, so it should be a stored table.
    """
    sets = [[F.col(k) for k in (*keys, bin_)], [F.col(k) for k in keys]]
    total = df.groupingSets(sets, *[F.col(k) for k in (*keys, bin_)]).agg(F.grouping(bin_).alias("_all"), *aggregates)
    total = total.where((F.col("_all") == 1) | F.col(bin_).isNotNull())
    out = total.withColumn(bin_, F.when(F.col("_all") == 1, "all").otherwise(F.col(bin_))).drop("_all")
    for value, wanted in shares.items():
        inside = percentiles(df.where(F.col(bin_).isNotNull()), [*keys, bin_], value, wanted, how)
        every = percentiles(df, keys, value, wanted, how).withColumn(bin_, F.lit("all"))
        out = joined(out, inside.unionByName(every), [*keys, bin_])
    return out


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, what: Column, name: str) -> DataFrame:
    """keys, name: `what` of the first k rows of each key, as an array in order. Tasks keep k rows a key before any shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) if keys else F.row_number().over(Window.orderBy(*order))
    best = df.withColumn("_place", rank).where(F.col("_place") <= k)
    packed = best.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_place", what.alias("_what")))).alias("_t"))
    return packed.select(*keys, F.transform("_t", lambda x: x["_what"]).alias(name))


def block_summary(blocks: DataFrame, edges: Sequence[int], limit: float = 20.0, worst: int = 5) -> DataFrame:
    """bin, b, n, mean_share, mean_effective, max_effective, p99, p999, over, over_share, worst: effective block counts per
    length bin and over all chains ('all').

    `blocks` has entry, b, length, effective_c and share. `over` counts chains above the limit; `worst` names the entries with
    the greatest values, ties by name.
    """
    binned = materialize(blocks.withColumn("bin", band(F.col("length"), edges)), "blocks")
    c = F.col("effective_c")
    sums = [F.count("*").alias("n"), F.avg("share").alias("mean_share"), F.avg(c).alias("mean_effective"), F.max(c).alias("max_effective"), F.count_if(c > limit).alias("over")]
    out = each_and_all(binned, ["b"], "bin", sums, {"effective_c": {"p99": 0.99, "p999": 0.999}})
    order = [F.desc("effective_c"), F.col("entry")]
    inside = top_rows(binned.where("bin IS NOT NULL"), ["b", "bin"], order, worst, F.col("entry"), "worst")
    every = top_rows(binned, ["b"], order, worst, F.col("entry"), "worst").withColumn("bin", F.lit("all"))
    out = joined(out, inside.unionByName(every), ["b", "bin"])
    return out.withColumn("over_share", F.col("over") / F.col("n"))


def contact_summary(chains: DataFrame, edges: Sequence[int]) -> DataFrame:
    """bin, n, median_length, mean and max contacts a residue, their median, p95 (nearest rank), p99 and p999, and the median density.

    `chains` has entry, length, per_nt and density.
    """
    binned = materialize(chains.withColumn("bin", band(F.col("length"), edges)), "chains")
    sums = [F.count("*").alias("n"), F.avg("per_nt").alias("mean_per_nt"), F.max("per_nt").alias("max_per_nt")]
    shares = {"length": {"median_length": 0.5}, "per_nt": {"median_per_nt": 0.5, "p99_per_nt": 0.99, "p999_per_nt": 0.999}, "density": {"median_density": 0.5}}
    out = each_and_all(binned, [], "bin", sums, shares)
    near = each_and_all(binned, [], "bin", [F.count("*").alias("_n")], {"per_nt": {"p95_per_nt": 0.95}}, "nearest").drop("_n")
    return joined(out, near, ["bin"])


def separation_summary(chains: DataFrame, edges: Sequence[int], bands: Sequence[int]) -> DataFrame:
    """bin, n, median_length, median_sep and for each band the mean over chains of the share of contacts within it.

    `chains` has entry, length, median_separation and within_<band>. A chain's median is cut to a whole number first.
    """
    binned = materialize(chains.withColumn("bin", band(F.col("length"), edges)).withColumn("_sep", F.floor("median_separation")), "chains")
    sums = [F.count("*").alias("n"), *[F.avg(f"within_{b}").alias(f"within_{b}") for b in bands]]
    return each_and_all(binned, [], "bin", sums, {"length": {"median_length": 0.5}, "_sep": {"median_sep": 0.5}})


def gradient_summary(bins: DataFrame) -> DataFrame:
    """stratum, n, span, rise, monotonic of the bin means of each stratum: greatest less least mean, last less first, and
    whether no mean is below the one before. Bins without a value are left out; `bins` has stratum, bin, n and mean."""
    known = bins.where(F.col("mean").isNotNull())
    before = F.lag("mean").over(Window.partitionBy("stratum").orderBy("bin"))
    falls = known.withColumn("_falls", F.coalesce(F.col("mean") < before, F.lit(False)))
    return falls.groupBy("stratum").agg(
        F.sum("n").alias("n"),
        (F.max("mean") - F.min("mean")).alias("span"),
        (F.max_by("mean", "bin") - F.min_by("mean", "bin")).alias("rise"),
        (~F.bool_or("_falls")).alias("monotonic"),
    )


def guard_gradients(df: DataFrame, value: str, distance: str, edges: Sequence[float], guards: Sequence[int]) -> DataFrame:
    """guard, structures, added_small, n, rise, monotonic: the gradient over entries of at least `guard` residues, for each guard.

    Values are summed by entry and bin once, and only these sums meet the guards.
    """
    binned = materialize(df, "gradient").withColumn("bin", F.lit(None).cast("int"))
    for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        binned = binned.withColumn("bin", F.when((F.col(distance) >= lo) & (F.col(distance) < hi), i).otherwise(F.col("bin")))
    sizes = binned.groupBy("entry").agg(F.count("*").alias("size"))
    guard = F.explode(F.filter(F.array(*[F.lit(g) for g in guards]), lambda g: g <= F.col("size"))).alias("guard")
    held = sizes.select("entry", "size", guard)
    counted = held.groupBy("guard").agg(F.count("*").alias("structures"), F.count_if(F.col("size") < max(guards)).alias("added_small"))
    sums = binned.where("bin IS NOT NULL").groupBy("entry", "bin").agg(F.count(value).alias("n"), F.sum(value).alias("s"))
    means = sums.join(held, "entry").groupBy("guard", "bin").agg(F.sum("n").alias("n"), (F.sum("s") / F.nullif(F.sum("n"), F.lit(0))).alias("mean"))
    found = gradient_summary(means.withColumnRenamed("guard", "stratum")).select(F.col("stratum").alias("guard"), "n", "rise", "monotonic")
    return counted.join(found, "guard", "left")


def ion_inventory(ions: DataFrame, inner: DataFrame) -> DataFrame:
    """species, n, share, mg_vs_k, mg_vs_others, phosphate_share: cations by species, and the ratios over all of them.

    `ions` has species; `inner` has phosphate (boolean), a row for each first-shell oxygen. A ratio to no ion is one to one ion.
    """
    by = ions.groupBy("species").agg(F.count("*").alias("n"))
    mg, k = F.sum(F.when(F.col("species") == "MG", F.col("n")).otherwise(0)), F.sum(F.when(F.col("species") == "K", F.col("n")).otherwise(0))
    total = by.agg(F.sum("n").alias("_all"), mg.alias("_mg"), k.alias("_k"))
    shell = inner.agg(F.count("*").alias("_o"), F.count_if("phosphate").alias("_p"))
    one = F.broadcast(total.join(F.broadcast(shell)))  # one row
    return by.join(one).select(
        "species", "n", (F.col("n") / F.col("_all")).alias("share"),
        (F.col("_mg") / F.greatest(F.col("_k"), F.lit(1))).alias("mg_vs_k"),
        (F.col("_mg") / F.greatest(F.col("_all") - F.col("_mg"), F.lit(1))).alias("mg_vs_others"),
        (F.col("_p") / F.greatest(F.col("_o"), F.lit(1))).alias("phosphate_share"),
    )


def coverage_tail(chains: DataFrame, covered: DataFrame, top: int = 34, matched: tuple[int, int] = (500, 700), limit: float = 20.0) -> DataFrame:
    """One row about the chains of greatest effective_c, against those of equal length and those a derivative covers.

    `chains` has entry, length, effective_c and modified (modified residues); `covered` has entry. Columns: chains and greatest
    value of the covered and the others; `over`: chains above the limit; `series`: the first two signs of the greatest's name;
    `in_series`: how many of the top have it; `first_other`: place of the first that has not (null: none); `all_uncovered`: none of the
    first 30 is covered; modified shares of the top, of all and of the length band; `enrichment` of the top over the band.
    """
    known = covered.select("entry").distinct().withColumn("_c", F.lit(True))
    c = materialize(chains.join(known, "entry", "left").withColumn("_c", F.coalesce("_c", F.lit(False))), "chains")
    here, value = F.col("_c"), F.col("effective_c")
    inside = F.col("length").between(*matched)
    share = lambda when: F.coalesce(F.try_divide(F.sum(F.when(when, F.col("modified"))), F.sum(F.when(when, F.col("length")))), F.lit(0.0))
    whole = c.agg(
        F.count_if(here).alias("covered"), F.coalesce(F.max(F.when(here, value)), F.lit(0.0)).alias("max_covered"),
        F.count_if(~here).alias("uncovered"), F.coalesce(F.max(F.when(~here, value)), F.lit(0.0)).alias("max_uncovered"),
        F.count_if(value > limit).alias("over"), share(F.lit(True)).alias("modified_all"), share(inside).alias("modified_matched"),
    )
    # The top is at most `top` rows, so its places are given in one task.
    best = c.orderBy(F.desc("effective_c"), "entry").limit(top).withColumn("place", F.row_number().over(Window.orderBy(F.desc("effective_c"), "entry")))
    named = best.withColumn("_s", F.substring("entry", 1, 2)).withColumn("_first", F.first("_s").over(Window.orderBy("place")))
    tail = named.agg(
        F.first("_first").alias("series"), F.count_if(F.col("_s") == F.col("_first")).alias("in_series"),
        F.min(F.when(F.col("_s") != F.col("_first"), F.col("place"))).alias("first_other"),
        F.coalesce(F.bool_and(F.when(F.col("place") <= 30, ~F.col("_c"))), F.lit(True)).alias("all_uncovered"), share(F.lit(True)).alias("modified_top"),
    )
    return whole.join(F.broadcast(tail)).withColumn("enrichment", F.col("modified_top") / F.greatest("modified_matched", F.lit(1e-9)))


def matched_controls(chains: DataFrame, covered: DataFrame, width: int, seed: str = "0") -> DataFrame:
    """band, covered, controls, modified shares of both and their enrichment: to the covered chains of each length band (`width`
    wide), as many uncovered ones by a seeded order of their names, or all if there are fewer.

    A band may hold most chains: its uncovered ones are cut by the first digits of their hash, and only the cut in which the
    last control falls is ordered.
    """
    known = covered.select("entry").distinct().withColumn("_c", F.lit(True))
    c = chains.join(known, "entry", "left").select("entry", "length", "modified", F.coalesce("_c", F.lit(False)).alias("_c"), F.floor(F.col("length") / width).cast("int").alias("band"))
    c = materialize(c.withColumn("_h", F.sha2(F.concat_ws(":", F.lit(seed), F.col("entry")), 256)).withColumn("_cut", F.substring("_h", 1, 3)), "chains")
    wanted = c.where("_c").groupBy("band").agg(F.count("*").alias("covered"), F.sum("modified").alias("_m"), F.sum("length").alias("_l"))
    others = c.where("NOT _c").join(wanted.select("band", "covered"), "band")
    cuts = others.groupBy("band", "_cut", "covered").agg(F.count("*").alias("_n"), F.sum("modified").alias("_m"), F.sum("length").alias("_l"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("band").orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cuts = cuts.withColumn("_before", before).where("_before < covered")
    whole = cuts.where("_before + _n <= covered").select("band", F.col("_n").alias("n"), "_m", "_l")
    split = cuts.where("_before + _n > covered").select("band", "_cut", (F.col("covered") - F.col("_before")).alias("_left"))
    ordered = others.join(split, ["band", "_cut"]).withColumn("_place", F.row_number().over(Window.partitionBy("band", "_cut").orderBy("_h", "entry"))).where("_place <= _left")
    part = ordered.groupBy("band").agg(F.count("*").alias("n"), F.sum("modified").alias("_m"), F.sum("length").alias("_l"))
    taken = whole.unionByName(part).groupBy("band").agg(F.sum("n").alias("controls"), F.sum("_m").alias("_cm"), F.sum("_l").alias("_cl"))
    both = wanted.join(taken, "band", "left")
    mine, control = F.coalesce(F.try_divide("_m", "_l"), F.lit(0.0)), F.coalesce(F.try_divide("_cm", "_cl"), F.lit(0.0))
    return both.select("band", "covered", F.coalesce("controls", F.lit(0)).alias("controls"), mine.alias("modified_covered"), control.alias("modified_controls"), (mine / F.greatest(control, F.lit(1e-9))).alias("enrichment"))


def entry_population(entries: DataFrame, ribosome: tuple[int, int], budget: int, largest: int = 6) -> DataFrame:
    """One row about entries with RNA: how many, residues of the greatest and at p50, p90, p99 and p999 (the value at
    round(p * (n - 1))), entries over the budget and their share, shares of entries and residues with protein, ribosome-like
    entries and their share of residues, and the names of the largest.

    `entries` has entry, rna, protein (residues). Ribosome-like has more RNA and more protein than the two numbers.
    """
    rna = materialize(entries.where("rna > 0"), "entries")
    n, protein = F.col("rna"), F.col("protein") > 0
    like = (n > ribosome[0]) & (F.col("protein") > ribosome[1])
    part = lambda when: F.coalesce(F.sum(F.when(when, n)) / F.sum(n), F.lit(0.0))
    sums = rna.agg(
        F.count("*").alias("entries"), F.max(n).alias("most"), F.count_if(n > budget).alias("over_budget"), F.avg((n > budget).cast("double")).alias("over_share"),
        F.avg(protein.cast("double")).alias("in_complex"), part(protein).alias("residues_in_complex"), F.count_if(like).alias("ribosome_like"), part(like).alias("residues_ribosome_like"),
    )
    at = percentiles(rna, [], "rna", {"p50": 0.5, "p90": 0.9, "p99": 0.99, "p999": 0.999}, "rounded")
    names = top_rows(rna, [], [F.desc("rna"), F.col("entry")], largest, F.col("entry"), "largest")
    return sums.join(F.broadcast(at)).join(F.broadcast(names))


def species_census(residues: DataFrame, types: DataFrame, standard: Sequence[str], k: int = 40) -> DataFrame:
    """comp, n, share, type, place: the k most frequent modified species (ties by name), each one's share of modified
    residues and its declared type ('?' if none). `residues` has comp, `types` comp and type."""
    n = residues.where(F.col("comp").isNotNull() & ~F.col("comp").isin(*standard)).groupBy("comp").agg(F.count("*").alias("n"))
    declared = types.where(~F.col("type").isin(".", "?", "")).groupBy("comp").agg(F.min("type").alias("type"))
    total = n.agg(F.sum("n").alias("_all"))
    best = n.orderBy(F.desc("n"), "comp").limit(k).withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "comp")))  # k rows
    return best.join(declared, "comp", "left").join(F.broadcast(total)).select("comp", "n", (F.col("n") / F.col("_all")).alias("share"), F.coalesce("type", F.lit("?")).alias("type"), "place")


def by_parent(residues: DataFrame, dictionary: DataFrame, standard: Sequence[str], parents: Sequence[str] = ("A", "C", "G", "U")) -> DataFrame:
    """parent ('?' where the dictionary names none of `parents`), kinds, residues, share: modified residues by parent base."""
    n = residues.where(F.col("comp").isNotNull() & ~F.col("comp").isin(*standard)).groupBy("comp").agg(F.count("*").alias("n"))
    known = dictionary.where(F.col("parent").isin(*parents)).groupBy("comp").agg(F.min("parent").alias("parent"))
    by = n.join(known, "comp", "left").groupBy(F.coalesce("parent", F.lit("?")).alias("parent")).agg(F.count("*").alias("kinds"), F.sum("n").alias("residues"))
    total = by.agg(F.sum("residues").alias("_all"))
    return by.join(F.broadcast(total)).select("parent", "kinds", "residues", (F.col("residues") / F.col("_all")).alias("share"))


def ladder_summary(ladders: DataFrame, folding: float = -0.3) -> DataFrame:
    """One row: ladders, with_rho, folding (rho below the limit), median_rho, sub_mm (those that start below 1), least and
    greatest concentration. `ladders` has rho, least and greatest."""
    ladders = materialize(ladders.select("rho", "least", "greatest"), "ladders")
    sums = ladders.agg(
        F.count("*").alias("ladders"), F.count("rho").alias("with_rho"), F.count_if(F.col("rho") < folding).alias("folding"),
        F.count_if(F.col("least") < 1).alias("sub_mm"), F.min("least").alias("least"), F.max("greatest").alias("greatest"),
    )
    return sums.join(F.broadcast(percentiles(ladders, [], "rho", {"median_rho": 0.5})), how="left")


def ladders_by_ion(ladders: DataFrame) -> DataFrame:
    """ion, files, least, greatest, most_levels: how many series vary each ion, and over what. `ladders` is `titration_ladders`' result."""
    return ladders.groupBy("ion").agg(F.count("*").alias("files"), F.min("least").alias("least"), F.max("greatest").alias("greatest"), F.max("levels").alias("most_levels"))


def quality_summary(index: DataFrame, bands: Sequence[tuple[float, float, float]], families: int = 10) -> DataFrame:
    """One row: entries, with_score, with_family, median and p90 (the value at int(0.9 n)) of the score, entries per weight band
    ('lo-hi:weight' -> n) and the most frequent families ('family:n', ties by name). `index` has score and family."""
    n = [F.count_if((F.col("score") >= lo) & (F.col("score") < hi)) for lo, hi, _ in bands]
    names = [f"{lo:g}-{'inf' if hi > 1e8 else format(hi, 'g')}:{w:g}" for lo, hi, w in bands]
    sums = index.agg(F.count("*").alias("entries"), F.count("score").alias("with_score"), F.count("family").alias("with_family"), F.array(*[F.concat(F.lit(f"{x}="), c.cast("string")) for x, c in zip(names, n, strict=True)]).alias("bands"))
    middle = percentiles(index, [], "score", {"median_score": 0.5})
    high = percentiles(index, [], "score", {"p90_score": 0.9}, "nearest")
    counts = index.where(F.col("family").isNotNull()).groupBy("family").agg(F.count("*").alias("_n"))
    top = top_rows(counts, [], [F.desc("_n"), F.col("family")], families, F.concat_ws(":", "family", F.col("_n").cast("string")), "top_families")
    return sums.join(F.broadcast(middle), how="left").join(F.broadcast(high), how="left").join(F.broadcast(top), how="left")
