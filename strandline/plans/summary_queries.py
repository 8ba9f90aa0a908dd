"""Queries of the summaries by length bin, class and source.

Chains are the vectors themselves: vec_id is the entry, its first 8 + vec_id % 14 points the residues.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assessment, structure, summaries
from ..session import read_table
from . import fixtures as X
from . import structure_queries as S
from .fitness_queries import ladder_monotonicity
from .registry import oracle_of, query

EDGES = [8, 12, 17, 21]
BIN = "CASE " + " ".join(f"WHEN length >= {a} AND length < {b} THEN '{a}-{b}'" for a, b in zip(EDGES, EDGES[1:], strict=False)) + " END"

CHAIN = """SELECT vec_id AS entry, CAST(k AS INTEGER) AS idx, 40 * CAST(e[3 * k + 1] AS DOUBLE) AS x, 40 * CAST(e[3 * k + 2] AS DOUBLE) AS y, 40 * CAST(e[3 * k + 3] AS DOUBLE) AS z
  FROM (SELECT vec_id, embedding AS e, unnest(range(8 + vec_id % 14)) AS k FROM embeddings)"""
CHAIN_PAIRS = f"""SELECT a.entry, a.idx AS i, b.idx AS j FROM ({CHAIN}) a JOIN ({CHAIN}) b ON a.entry = b.entry AND b.idx - a.idx >= 4
  WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= 64"""
CHAIN_SIZES = f"SELECT entry, max(idx) + 1 AS length FROM ({CHAIN}) GROUP BY entry"


def chain(spark, d):
    t = read_table(spark, d, "embeddings").select(F.col("vec_id").alias("entry"), F.col("embedding").alias("e"))
    r = t.select("entry", "e", F.explode(F.sequence(F.lit(0), (F.col("entry") % 14 + 7).cast("int"))).alias("idx"))
    at = lambda o: (F.element_at("e", 3 * F.col("idx") + o).cast("double") * 40).alias("xyz"[o - 1])
    return r.select("entry", "idx", at(1), at(2), at(3))


def chain_pairs(spark, d):
    return structure.contacts(chain(spark, d), 8.0, 4)


def chain_sizes(spark, d):
    return structure.lengths(chain(spark, d))


def rounded(df, *keep):
    """Doubles to 8 places, so that engines which add in another order agree."""
    return df.select(*[F.round(c, 8).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes])


def _each(sql: str) -> str:
    """The rows with their bin, and once more with bin 'all'."""
    return f"SELECT * FROM (SELECT {BIN} AS bin, * FROM ({sql})) WHERE bin IS NOT NULL UNION ALL SELECT 'all', * FROM ({sql})"


BLOCKS = f"""SELECT o.entry, o.b, s.length, o.n * o.b * o.b / s.length AS effective_c, o.n / (ceil(s.length / o.b) * (ceil(s.length / o.b) + 1) / 2) AS share
  FROM (SELECT entry, b, count(DISTINCT (i // b, j // b)) AS n FROM ({CHAIN_PAIRS}), (SELECT CAST(unnest([2, 4]) AS INTEGER) AS b) GROUP BY entry, b) o JOIN ({CHAIN_SIZES}) s ON s.entry = o.entry"""


def blocks(spark, d):
    sizes = chain_sizes(spark, d)
    return structure.block_occupancy(chain_pairs(spark, d), sizes, [2, 4]).join(sizes, "entry")


@query(f"""SELECT bin, b, count(*) AS n, round(avg(share), 8) AS mean_share, round(avg(effective_c), 8) AS mean_effective, round(max(effective_c), 8) AS max_effective, round(quantile_cont(effective_c, 0.99), 8) AS p99,
  round(quantile_cont(effective_c, 0.999), 8) AS p999, count_if(effective_c > 5) AS over, round(count_if(effective_c > 5) / count(*), 8) AS over_share, array_to_string(list(entry ORDER BY effective_c DESC, entry)[1:5], ',') AS worst
  FROM ({_each(BLOCKS)}) GROUP BY bin, b""")
def block_summary(spark, d):
    out = summaries.block_summary(blocks(spark, d), EDGES, 5.0, 5)
    return rounded(out.withColumn("worst", F.array_join("worst", ",")))


STATS = f"""SELECT s.entry, s.length, coalesce(c, 0) / s.length AS per_nt, 2 * coalesce(c, 0) / (s.length * (s.length - 1)) AS density
  FROM ({CHAIN_SIZES}) s LEFT JOIN (SELECT entry, count(*) AS c FROM ({CHAIN_PAIRS}) GROUP BY entry) n ON n.entry = s.entry"""


@query(f"""SELECT bin, count(*) AS n, median(length) AS median_length, round(avg(per_nt), 8) AS mean_per_nt, round(max(per_nt), 8) AS max_per_nt, round(median(per_nt), 8) AS median_per_nt,
  round(quantile_cont(per_nt, 0.99), 8) AS p99_per_nt, round(quantile_cont(per_nt, 0.999), 8) AS p999_per_nt, round(median(density), 8) AS median_density,
  round(list_sort(list(per_nt))[least(count(*) - 1, CAST(floor(count(*) * 0.95::DOUBLE) AS BIGINT)) + 1], 8) AS p95_per_nt FROM ({_each(STATS)}) GROUP BY bin""")
def contact_summary(spark, d):
    return rounded(summaries.contact_summary(structure.contact_stats(chain_pairs(spark, d), chain_sizes(spark, d)), EDGES))


SEPARATIONS = f"""SELECT n.entry, s.length, floor(m) AS sep, within_6, within_12 FROM (SELECT entry, median(j - i) AS m, avg(CAST(j - i <= 6 AS DOUBLE)) AS within_6, avg(CAST(j - i <= 12 AS DOUBLE)) AS within_12
  FROM ({CHAIN_PAIRS}) GROUP BY entry) n JOIN ({CHAIN_SIZES}) s ON s.entry = n.entry"""


@query(f"SELECT bin, count(*) AS n, round(avg(within_6), 8) AS within_6, round(avg(within_12), 8) AS within_12, median(length) AS median_length, median(sep) AS median_sep FROM ({_each(SEPARATIONS)}) GROUP BY bin")
def separation_summary(spark, d):
    s = structure.separation_shares(chain_pairs(spark, d), [6, 12]).join(chain_sizes(spark, d), "entry")
    return rounded(summaries.separation_summary(s, EDGES, [6, 12]))


GRADIENT = f"""SELECT stratum, CAST(sum(n) AS BIGINT) AS n, max(mean) - min(mean) AS span, arg_max(mean, bin) - arg_min(mean, bin) AS rise, NOT bool_or(falls) AS monotonic
  FROM (SELECT *, coalesce(mean < lag(mean) OVER (PARTITION BY stratum ORDER BY bin), false) AS falls FROM {{bins}} WHERE mean IS NOT NULL) GROUP BY stratum"""


@query(f"""WITH b AS (SELECT * FROM ({S.BINS}) WHERE bin IS NOT NULL), g AS (SELECT stratum, bin, count(z) AS n, avg(z) AS mean FROM b GROUP BY ALL UNION ALL SELECT 'all', bin, count(z), avg(z) FROM b GROUP BY bin)
  SELECT stratum, n, round(span, 8) AS span, round(rise, 8) AS rise, monotonic FROM ({GRADIENT.format(bins='g')})""")
def gradient_summary(spark, d):
    near = structure.nearest_ion(X.centre(spark, d), X.ion(spark, d))
    bins = structure.binned_gradient(S.z_scores(spark, d).join(near, ["entry", "idx"]), "z", "distance", [0, 4, 6, 8, 12, 20], "entry")
    return rounded(summaries.gradient_summary(bins))


@query(f"""WITH z AS (SELECT z.entry, z.z, distance FROM ({S.Z}) z JOIN ({S.NEAR}) n ON n.entry = z.entry AND n.idx = z.idx), h AS (SELECT entry, count(*) AS size FROM z GROUP BY entry),
  e AS (SELECT entry, size, g AS guard FROM h, (SELECT CAST(unnest([1, 45, 50, 55]) AS INTEGER) AS g) WHERE size >= g),
  b AS (SELECT guard AS stratum, CASE WHEN distance < 4 THEN 0 WHEN distance < 6 THEN 1 WHEN distance < 8 THEN 2 WHEN distance < 12 THEN 3 WHEN distance < 20 THEN 4 END AS bin, z FROM z JOIN e ON e.entry = z.entry),
  m AS (SELECT stratum, bin, count(z) AS n, avg(z) AS mean FROM b WHERE bin IS NOT NULL GROUP BY ALL), c AS (SELECT guard, count(*) AS structures, count_if(size < 55) AS added_small FROM e GROUP BY guard)
  SELECT c.guard, structures, added_small, n, round(rise, 7) AS rise, monotonic FROM c LEFT JOIN ({GRADIENT.format(bins='m')}) g ON g.stratum = c.guard""")
def guard_gradients(spark, d):
    near = structure.nearest_ion(X.centre(spark, d), X.ion(spark, d))
    out = summaries.guard_gradients(S.z_scores(spark, d).join(near, ["entry", "idx"]), "z", "distance", [0, 4, 6, 8, 12, 20], [1, 45, 50, 55])
    return out.withColumn("rise", F.round("rise", 7))


SPECIES = f"SELECT *, (['MG', 'MG', 'K', 'NA'])[(ion // 25 + entry) % 4 + 1] AS species FROM ({X.ION})"


@query(f"""WITH i AS ({SPECIES}), n AS (SELECT species, count(*) AS n FROM i GROUP BY species), t AS (SELECT sum(n) AS al, sum(n) FILTER (WHERE species = 'MG') AS mg, coalesce(sum(n) FILTER (WHERE species = 'K'), 0) AS k FROM n),
  o AS (SELECT count(*) AS o, count_if(a.k IN (1, 2)) AS p FROM i b JOIN ({X.ATOM}) a ON a.entry = b.entry WHERE a.k BETWEEN 1 AND 6 AND b.species = 'MG' AND {S.D2} <= 25)
  SELECT species, n, round(n / al, 8) AS share, round(mg / greatest(k, 1), 8) AS mg_vs_k, round(mg / greatest(al - mg, 1), 8) AS mg_vs_others, round(p / greatest(o, 1), 8) AS phosphate_share FROM n, t, o""")
def ion_inventory(spark, d):
    kind = F.element_at(F.array(*[F.lit(s) for s in ("MG", "MG", "K", "NA")]), ((F.floor(F.col("ion") / 25) + F.col("entry")) % 4 + 1).cast("int"))
    ions = X.ion(spark, d).withColumn("species", kind)
    near = structure.cell_join(ions.where("species = 'MG'"), X.atom(spark, d).where("k BETWEEN 1 AND 6"), "entry", 5.0)
    return rounded(summaries.ion_inventory(ions, near.select(F.col("r_k").isin(1, 2).alias("phosphate"))))


TAIL = f"SELECT substr(md5(CAST(entry AS VARCHAR)), 1, 2) || '_' || entry AS entry, length, effective_c, entry % 5 AS modified FROM ({BLOCKS}) WHERE b = 4"
COVERED = "SELECT substr(md5(CAST(vec_id AS VARCHAR)), 1, 2) || '_' || vec_id AS entry FROM embeddings WHERE vec_id % 3 = 0"


def tail(spark, d):
    c = blocks(spark, d).where("b = 4")
    name = F.concat(F.substring(F.md5(F.col("entry").cast("string")), 1, 2), F.lit("_"), F.col("entry"))
    return c.select(name.alias("entry"), "length", "effective_c", (F.col("entry") % 5).alias("modified"))


def covered(spark, d):
    v = read_table(spark, d, "embeddings").where("vec_id % 3 = 0")
    return v.select(F.concat(F.substring(F.md5(F.col("vec_id").cast("string")), 1, 2), F.lit("_"), F.col("vec_id")).alias("entry"))


@query(f"""WITH c AS MATERIALIZED (SELECT *, entry IN ({COVERED}) AS c FROM ({TAIL})), w AS (SELECT count_if(c) AS covered, coalesce(max(effective_c) FILTER (WHERE c), 0) AS max_covered, count_if(NOT c) AS uncovered, coalesce(max(effective_c) FILTER (WHERE NOT c), 0) AS max_uncovered,
    count_if(effective_c > 4) AS over, sum(modified) / sum(length) AS modified_all, sum(modified) FILTER (WHERE length BETWEEN 12 AND 16) / sum(length) FILTER (WHERE length BETWEEN 12 AND 16) AS modified_matched FROM c),
  b AS (SELECT *, row_number() OVER (ORDER BY effective_c DESC, entry) AS place FROM c QUALIFY place <= 34), s AS (SELECT *, substr(entry, 1, 2) AS s, first_value(substr(entry, 1, 2)) OVER (ORDER BY place) AS f FROM b),
  t AS (SELECT any_value(f) AS series, count_if(s = f) AS in_series, CAST(min(place) FILTER (WHERE s <> f) AS INTEGER) AS first_other, coalesce(bool_and(NOT c) FILTER (WHERE place <= 30), true) AS all_uncovered, sum(modified) / sum(length) AS modified_top FROM s)
  SELECT covered, round(max_covered, 8) AS max_covered, uncovered, round(max_uncovered, 8) AS max_uncovered, over, round(modified_all, 8) AS modified_all, round(modified_matched, 8) AS modified_matched, series, in_series, first_other, all_uncovered,
    round(modified_top, 8) AS modified_top, round(modified_top / greatest(modified_matched, 1e-9), 8) AS enrichment FROM w, t""")
def coverage_tail(spark, d):
    return rounded(summaries.coverage_tail(tail(spark, d), covered(spark, d), 34, (12, 16), 4.0))


@query(f"""WITH c AS MATERIALIZED (SELECT *, entry IN ({COVERED}) AS c, CAST(floor(length / 4) AS INTEGER) AS band FROM ({TAIL})), w AS (SELECT band, count(*) AS covered, sum(modified) / sum(length) AS m FROM c WHERE c GROUP BY band),
  o AS (SELECT c.*, w.covered, row_number() OVER (PARTITION BY c.band ORDER BY sha256('7:' || entry), entry) AS place FROM c JOIN w ON w.band = c.band WHERE NOT c), t AS (SELECT band, count(*) AS n, sum(modified) / sum(length) AS m FROM o WHERE place <= covered GROUP BY band)
  SELECT w.band, covered, coalesce(n, 0) AS controls, round(w.m, 8) AS modified_covered, round(coalesce(t.m, 0), 8) AS modified_controls, round(w.m / greatest(coalesce(t.m, 0), 1e-9), 8) AS enrichment FROM w LEFT JOIN t ON t.band = w.band""")
def matched_controls(spark, d):
    return rounded(summaries.matched_controls(tail(spark, d), covered(spark, d), 4, "7"))


POPULATION = """SELECT 'e' || l_orderkey AS entry, CAST(coalesce(sum(l_quantity) FILTER (WHERE l_returnflag <> 'R'), 0) AS BIGINT) AS rna, CAST(coalesce(sum(l_quantity) FILTER (WHERE l_returnflag = 'R'), 0) AS BIGINT) AS protein FROM lineitem GROUP BY l_orderkey"""


def _rounded_at(p: str) -> str:
    return f"CAST(list_sort(list(rna))[CAST(round_even((count(*) - 1) * {p}::DOUBLE, 0) AS BIGINT) + 1] AS DOUBLE)"


@query(f"""WITH e AS (SELECT * FROM ({POPULATION}) WHERE rna > 0)
  SELECT count(*) AS entries, max(rna) AS most, count_if(rna > 150) AS over_budget, round(avg(CAST(rna > 150 AS DOUBLE)), 8) AS over_share, round(avg(CAST(protein > 0 AS DOUBLE)), 8) AS in_complex,
    round(sum(rna) FILTER (WHERE protein > 0) / sum(rna), 8) AS residues_in_complex, count_if(rna > 50 AND protein > 40) AS ribosome_like, round(coalesce(sum(rna) FILTER (WHERE rna > 50 AND protein > 40), 0) / sum(rna), 8) AS residues_ribosome_like,
    {_rounded_at('0.5')} AS p50, {_rounded_at('0.9')} AS p90, {_rounded_at('0.99')} AS p99, {_rounded_at('0.999')} AS p999, array_to_string(list(entry ORDER BY rna DESC, entry)[1:6], ',') AS largest FROM e""")
def entry_percentiles(spark, d):
    part = lambda when: F.coalesce(F.sum(F.when(when, F.col("l_quantity"))), F.lit(0.0)).cast("long")
    red = F.col("l_returnflag") == "R"
    e = read_table(spark, d, "lineitem").groupBy(F.concat(F.lit("e"), "l_orderkey").alias("entry")).agg(part(~red).alias("rna"), part(red).alias("protein"))
    return rounded(summaries.entry_population(e, (50, 40), 150).withColumn("largest", F.array_join("largest", ",")))


RESIDUES = "SELECT CASE WHEN l_linenumber <= 2 THEN substr('ACGU', CAST(l_orderkey % 4 + 1 AS INTEGER), 1) ELSE 'M' || l_partkey % 60 END AS comp FROM lineitem"
COMPONENTS = "SELECT DISTINCT 'M' || p_partkey % 60 AS comp, (['RNA LINKING', 'DNA LINKING', '?'])[p_partkey % 60 % 3 + 1] AS type, (['A', 'C', 'G', 'U', 'N'])[p_partkey % 60 % 5 + 1] AS parent FROM part WHERE p_partkey % 60 <> 7"


def residues(spark, d):
    base = F.substring(F.lit("ACGU"), (F.col("l_orderkey") % 4 + 1).cast("int"), F.lit(1))
    return read_table(spark, d, "lineitem").select(F.when(F.col("l_linenumber") <= 2, base).otherwise(F.concat(F.lit("M"), F.col("l_partkey") % 60)).alias("comp"))


def components(spark, d):
    n = F.col("p_partkey") % 60
    pick = lambda names, k: F.element_at(F.array(*[F.lit(x) for x in names]), (n % k + 1).cast("int"))
    p = read_table(spark, d, "part").where(n != 7)
    return p.select(F.concat(F.lit("M"), n).alias("comp"), pick(("RNA LINKING", "DNA LINKING", "?"), 3).alias("type"), pick("ACGUN", 5).alias("parent")).distinct()


MODIFIED = f"SELECT comp, count(*) AS n FROM ({RESIDUES}) WHERE comp NOT IN ('A', 'C', 'G', 'U') GROUP BY comp"


@query(f"""SELECT n.comp, n, round(n / sum(n) OVER (), 8) AS share, coalesce(nullif(type, '?'), '?') AS type, CAST(row_number() OVER (ORDER BY n DESC, n.comp) AS INTEGER) AS place
  FROM ({MODIFIED}) n LEFT JOIN ({COMPONENTS}) c ON c.comp = n.comp QUALIFY place <= 40""")
def modification_species(spark, d):
    return rounded(summaries.species_census(residues(spark, d), components(spark, d), "ACGU", 40))


@query(f"""WITH p AS (SELECT coalesce(nullif(parent, 'N'), '?') AS parent, n FROM ({MODIFIED}) n LEFT JOIN ({COMPONENTS}) c ON c.comp = n.comp)
  SELECT parent, count(*) AS kinds, CAST(sum(n) AS BIGINT) AS residues, round(sum(n) / sum(sum(n)) OVER (), 8) AS share FROM p GROUP BY parent""")
def modification_by_parent(spark, d):
    return rounded(summaries.by_parent(residues(spark, d), components(spark, d), "ACGU"))


LADDERS = f"SELECT construct, ion, count(*) AS rows, count(DISTINCT round(conc, 4)) AS levels, min(conc) AS least, max(conc) AS greatest FROM ({X.LADDER}) GROUP BY construct, ion HAVING count(DISTINCT round(conc, 4)) >= 4"


@query(f"""SELECT count(*) AS ladders, count(rho) AS with_rho, count_if(rho < -0.3) AS folding, count_if(least < 1) AS sub_mm, min(least) AS least, max(greatest) AS greatest, round(median(rho), 8) AS median_rho
  FROM ({LADDERS}) l JOIN ({oracle_of('ladder_monotonicity')}) m ON m.construct = l.construct AND m.ion = l.ion""")
def ladder_summary(spark, d):
    both = assessment.titration_ladders(X.ladder(spark, d), 4).join(ladder_monotonicity(spark, d), ["construct", "ion"])
    return rounded(summaries.ladder_summary(both))


@query(f"SELECT ion, count(*) AS files, min(least) AS least, max(greatest) AS greatest, max(levels) AS most_levels FROM ({LADDERS}) GROUP BY ion")
def ladders_by_ion(spark, d):
    return summaries.ladders_by_ion(assessment.titration_ladders(X.ladder(spark, d), 4))


QUALITY = "SELECT CASE WHEN p_partkey % 9 <> 0 THEN p_retailprice % 50 END AS score, CASE WHEN p_partkey % 4 <> 0 THEN p_brand END AS family FROM part"


@query(f"""WITH q AS ({QUALITY}), f AS (SELECT family, count(*) AS n FROM q WHERE family IS NOT NULL GROUP BY family)
  SELECT count(*) AS entries, count(score) AS with_score, count(family) AS with_family, '0-10:1=' || count_if(score >= 0 AND score < 10) || ' 10-20:0.8=' || count_if(score >= 10 AND score < 20) || ' 20-40:0.55=' || count_if(score >= 20 AND score < 40) || ' 40-inf:0.3=' || count_if(score >= 40) AS bands,
    round(median(score), 8) AS median_score, round(list_sort(list(score) FILTER (WHERE score IS NOT NULL))[least(count(score) - 1, CAST(floor(count(score) * 0.9::DOUBLE) AS BIGINT)) + 1], 8) AS p90_score,
    (SELECT array_to_string(list(family || ':' || n ORDER BY n DESC, family)[1:10], ' ') FROM f) AS top_families FROM q""")
def quality_summary(spark, d):
    p = read_table(spark, d, "part")
    score = F.when(F.col("p_partkey") % 9 != 0, F.col("p_retailprice") % 50)
    index = p.select(score.alias("score"), F.when(F.col("p_partkey") % 4 != 0, F.col("p_brand")).alias("family"))
    out = summaries.quality_summary(index, [(0, 10, 1.0), (10, 20, 0.8), (20, 40, 0.55), (40, 1e9, 0.3)])
    return rounded(out.withColumns({c: F.array_join(c, " ") for c in ("bands", "top_families")}))
