"""Queries of the fitness, hit, titration, blind-test and motif operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import conditions as C
from ..functions import mutations as M
from ..functions import stats
from ..operators import assessment, fitness
from ..session import read_table
from . import fixtures as X
from .registry import query

RANK = "rank() OVER (PARTITION BY {k} ORDER BY {v}) + (count(*) OVER (PARTITION BY {k}, {v}) - 1) / 2.0"
CORR = "covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0)"


@query(f"""SELECT assay, count(mutant) AS n_mutant_rows, count(*) AS n_parsed, count_if(substr(mutant, 1, 1) = substr(wt, pos + 1, 1)) AS n_wt_base_ok,
  count_if(substr(wt, 1, pos) || substr(mutant, -1, 1) || substr(wt, pos + 2) = sequence) AS n_variant_ok, true AS accepted FROM ({X.FITNESS}) GROUP BY assay""")
def reconstruction_check(spark, d):
    return fitness.reconstruct_check(X.fitness(spark, d))


@query(f"SELECT assay, k1, k2, ({RANK.format(k='assay', v='dms_score')} - 0.5) / count(*) OVER (PARTITION BY assay) AS quantile FROM ({X.FITNESS})")
def rank_targets(spark, d):
    return fitness.rank_positions(X.fitness(spark, d)).select("assay", "k1", "k2", "quantile")


@query()
def rank_normal_targets(spark, d):
    """Normal quantiles: mean near 0 and spread near 1 in each assay."""
    f = fitness.rank_normal(X.fitness(spark, d))
    return f.groupBy("assay").agg(F.count("target").alias("n"), F.round(F.avg("target"), 6).alias("mean"), F.round(F.stddev_pop("target"), 4).alias("sd"))


@query(f"""SELECT assay, count(*) AS n, arg_min(source, (k1, k2)) AS source, max(length(wt)) AS length, min(dms_score) AS least, median(dms_score) AS median, max(dms_score) AS greatest FROM ({X.FITNESS}) GROUP BY assay""")
def per_assay_summary(spark, d):
    return fitness.per_assay_summary(X.fitness(spark, d))


@query(f"""WITH r AS (SELECT assay, {RANK.format(k='assay', v='x')} AS rx, {RANK.format(k='assay', v='dms_score')} AS ry FROM (SELECT assay, k1 % 101 + k2 AS x, dms_score FROM ({X.FITNESS})))
  SELECT assay, count(*) AS n, {CORR.format(x='rx', y='ry')} AS spearman FROM r GROUP BY assay""")
def assay_spearman(spark, d):
    return stats.spearman(X.fitness(spark, d).withColumn("x", F.col("k1") % 101 + F.col("k2")), ["assay"], "x", "dms_score")


MULTI = f"SELECT *, CASE WHEN k2 % 2 = 0 THEN mutant || ',' || mutant ELSE mutant END AS m2, CASE WHEN k2 % 2 = 0 THEN 2 ELSE 1 END AS depth FROM ({X.FITNESS})"


def multi(spark, d):
    return X.fitness(spark, d).withColumn("mutant", F.when(F.col("k2") % 2 == 0, F.concat_ws(",", "mutant", "mutant")).otherwise(F.col("mutant")))


@query(f"""WITH r AS (SELECT assay, {RANK.format(k='assay', v='x')} AS rx, {RANK.format(k='assay', v='dms_score')} AS ry FROM (SELECT assay, -depth AS x, dms_score FROM ({MULTI})))
  SELECT assay, count(*) AS n, {CORR.format(x='rx', y='ry')} AS spearman FROM r GROUP BY assay""")
def depth_baseline(spark, d):
    return fitness.depth_baseline(multi(spark, d))


@query(f"""WITH s AS (SELECT assay, dms_score, k1 % 101 + k2 AS s FROM ({X.FITNESS})), m AS (SELECT assay, median(dms_score) AS my, median(s) AS ms FROM s GROUP BY assay),
  j AS (SELECT s.assay, dms_score > my AS y, s > ms AS p, {RANK.format(k='s.assay', v='s')} AS r FROM s JOIN m ON s.assay = m.assay),
  a AS (SELECT assay, CAST(count_if(y) AS DOUBLE) AS n1, CAST(count_if(NOT y) AS DOUBLE) AS n0, sum(r) FILTER (WHERE y) AS rs, CAST(count_if(y AND p) AS DOUBLE) AS tp, CAST(count_if(NOT y AND NOT p) AS DOUBLE) AS tn,
    CAST(count_if(NOT y AND p) AS DOUBLE) AS fp, CAST(count_if(y AND NOT p) AS DOUBLE) AS fn FROM j GROUP BY assay)
  SELECT assay, greatest((rs - n1 * (n1 + 1) / 2) / (n1 * n0), 1 - (rs - n1 * (n1 + 1) / 2) / (n1 * n0)) AS auc, abs((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))) AS mcc FROM a""")
def auc_and_mcc(spark, d):
    return fitness.auc_mcc(X.fitness(spark, d).withColumn("s", F.col("k1") % 101 + F.col("k2")), "s")


LOGP = f"SELECT DISTINCT assay, pos, b AS base, -((pos * 7 + ascii(b)) % 13) / 4.0 AS logp FROM ({X.FITNESS}), (SELECT unnest(['A', 'C', 'G', 'U']) AS b) WHERE pos % 9 <> 4"


def logprobs(spark, d):
    p = X.fitness(spark, d).select("assay", "pos").distinct().where("pos % 9 <> 4")
    b = F.explode(F.array(*[F.lit(x) for x in "ACGU"]))
    return p.withColumn("base", b).withColumn("logp", -((F.col("pos") * 7 + F.ascii("base")) % 13) / 4.0)


@query(f"""SELECT f.assay, k1, k2, CASE WHEN count(*) = count(a.logp - b.logp) THEN sum(CASE WHEN k2 % 2 = 0 THEN 2 ELSE 1 END * (a.logp - b.logp)) END AS score FROM ({X.FITNESS}) f LEFT JOIN ({LOGP}) a ON a.assay = f.assay AND a.pos = f.pos AND a.base = f.mt
  LEFT JOIN ({LOGP}) b ON b.assay = f.assay AND b.pos = f.pos AND b.base = substr(f.wt, f.pos + 1, 1) GROUP BY f.assay, k1, k2""")
def wt_marginal_scores(spark, d):
    return fitness.wt_marginal_scores(multi(spark, d), logprobs(spark, d), ["assay", "k1", "k2"])


@query(f"SELECT assay, count(*) AS variants, count(DISTINCT CASE WHEN depth = 2 THEN pos || ',' || pos ELSE CAST(pos AS VARCHAR) END) AS contexts FROM ({MULTI}) GROUP BY assay")
def mutation_contexts(spark, d):
    return fitness.mutation_contexts(multi(spark, d))


@query(f"SELECT assay, source, count(*) AS n FROM ({X.FITNESS}) WHERE source = 'A' OR assay IN ('assay_5', 'assay_6') AND source = 'R' AND assay NOT IN (SELECT assay FROM ({X.FITNESS}) WHERE source = 'A') GROUP BY ALL")
def first_source_wins(spark, d):
    f = X.fitness(spark, d)
    return fitness.first_source_wins(f.where("source = 'A'"), f.where("source = 'R' AND assay IN ('assay_5', 'assay_6')")).groupBy("assay", "source").agg(F.count("*").alias("n"))


@query(f"SELECT assay, count(*) AS n FROM ({X.FITNESS}) WHERE assay NOT IN ('assay_1', 'assay_3') GROUP BY assay")
def excluded_assays(spark, d):
    reasons = spark.createDataFrame([("assay_1", "bad labels"), ("assay_3", "not RNA")], "assay string, reason string")
    return fitness.excluded(fitness.finite_scores(X.fitness(spark, d)), reasons).groupBy("assay").agg(F.count("*").alias("n"))


@query(f"""SELECT DISTINCT assay, CASE WHEN assay LIKE 'assay_0%' THEN 'first' WHEN assay LIKE 'assay_1%' THEN 'splicing' ELSE 'other' END AS family, CASE WHEN assay LIKE 'assay_1%' THEN 'splicing' ELSE 'ribozyme' END AS category FROM ({X.FITNESS})""")
def assay_families(spark, d):
    fam = M.first_prefix(F.col("assay"), [("assay_0", "first"), ("assay_1", "splicing")])
    return X.fitness(spark, d).select("assay").distinct().select("assay", fam.alias("family"), M.category_of(fam, F.col("assay")).alias("category"))


_SP = f"""SELECT assay, (['Ribozyme', 'tRNA', 'Aptamer'])[CAST(substr(assay, 7) AS INTEGER) % 3 + 1] AS category, {CORR.format(x='rx', y='ry')} AS spearman FROM (
  SELECT assay, {RANK.format(k='assay', v='x')} AS rx, {RANK.format(k='assay', v='dms_score')} AS ry FROM (SELECT assay, k1 % 101 + k2 AS x, dms_score FROM ({X.FITNESS}))) GROUP BY assay"""
_DB = f"""SELECT assay, {CORR.format(x='rx', y='ry')} AS baseline FROM (SELECT assay, {RANK.format(k='assay', v='x')} AS rx, {RANK.format(k='assay', v='dms_score')} AS ry FROM (SELECT assay, -depth AS x, dms_score FROM ({MULTI}))) GROUP BY assay"""


@query(f"""WITH c AS (SELECT category, avg(abs(spearman)) AS v, avg(abs(coalesce(baseline, 0))) AS b FROM ({_SP}) JOIN ({_DB}) USING (assay) GROUP BY category),
  m AS (SELECT 'ours' AS model, avg(v) AS macro FROM c UNION ALL SELECT 'mutation count', avg(b) FROM c UNION ALL SELECT 'published one', 0.31 UNION ALL SELECT 'published two', NULL)
  SELECT model, macro, rank() OVER (ORDER BY coalesce(macro, -9) DESC) AS place FROM m""")
def leaderboard(spark, d):
    f = X.fitness(spark, d).withColumn("x", F.col("k1") % 101 + F.col("k2"))
    category = F.element_at(F.array(F.lit("Ribozyme"), F.lit("tRNA"), F.lit("Aptamer")), F.substring("assay", 7, 3).cast("int") % 3 + 1)
    base = fitness.depth_baseline(multi(spark, d)).select("assay", F.col("spearman").alias("baseline"))
    per = stats.spearman(f, ["assay"], "x", "dms_score").join(base, "assay").withColumn("category", category)
    published = spark.createDataFrame([("published one", 0.31), ("published two", None)], "model string, macro double")
    return fitness.leaderboard(per, published, "ours", ["Ribozyme", "tRNA", "Aptamer"])


SCORED = f"SELECT assay, CASE WHEN assay = 'assay_2' THEN 1.0 WHEN assay = 'assay_4' AND k2 > 1 THEN NULL ELSE dms_score END AS s FROM ({X.FITNESS})"


@query(f"""WITH a AS (SELECT assay, count(*) AS n, count(s) AS k, min(s) AS lo, max(s) AS hi FROM ({SCORED}) GROUP BY assay)
  SELECT 'constant_score' AS "check", 'CRIT' AS severity, assay, k AS detail FROM a WHERE lo = hi UNION ALL SELECT 'unscored', 'WARN', assay, n - k FROM a WHERE k < n UNION ALL SELECT 'no_correlation', 'CRIT', assay, k FROM a WHERE k < 3""")
def scoring_problems(spark, d):
    s = F.when(F.col("assay") == "assay_2", 1.0).when((F.col("assay") == "assay_4") & (F.col("k2") > 1), None).otherwise(F.col("dms_score"))
    return fitness.scoring_problems(X.fitness(spark, d).select("assay", s.alias("s")), "s")


# --- hits, ladders, motifs


@query(f"SELECT chain, family, evalue, score, pos FROM ({X.HITS}) WHERE flag = '!' QUALIFY row_number() OVER (PARTITION BY chain ORDER BY evalue, score DESC, pos) = 1")
def best_hit_per_chain(spark, d):
    return assessment.best_hits(X.hits(spark, d).where("flag = '!'")).select("chain", "family", "evalue", "score", "pos")


@query(f"SELECT construct, ion, count(*) AS rows, count(DISTINCT round(conc, 4)) AS levels, min(conc) AS least, max(conc) AS greatest FROM ({X.LADDER}) GROUP BY construct, ion HAVING count(DISTINCT round(conc, 4)) >= 4")
def titration_ladders(spark, d):
    return assessment.titration_ladders(X.ladder(spark, d), 4)


@query(f"""WITH p AS (SELECT construct, ion, conc, avg(reactivity) AS r FROM ({X.LADDER}) GROUP BY ALL),
  k AS (SELECT construct, ion, {RANK.format(k='construct, ion', v='conc')} AS rx, {RANK.format(k='construct, ion', v='round(r, 9)')} AS ry FROM p),
  s AS (SELECT construct, ion, count(*) AS n, {CORR.format(x='rx', y='ry')} AS rho FROM k GROUP BY ALL),
  e AS (SELECT construct, ion, arg_min(r, conc) AS first_mean, arg_max(r, conc) AS last_mean FROM p GROUP BY ALL)
  SELECT construct, ion, n, CASE WHEN n >= 3 THEN rho END AS rho, coalesce(CASE WHEN n >= 3 THEN rho END < -0.3, false) AS folding, first_mean, last_mean FROM s JOIN e USING (construct, ion)""")
def ladder_monotonicity(spark, d):
    return assessment.ladder_monotonicity(X.ladder(spark, d))


@query(f"""WITH t AS (SELECT construct, 'chemical:Mg:' || CAST(conc AS VARCHAR) || 'mM chemical:Na:' || CAST(conc AS VARCHAR) || 'uM' AS txt, conc FROM (SELECT DISTINCT construct, conc FROM ({X.LADDER})))
  SELECT construct, txt, conc AS mg, conc / 1000 AS na FROM t""")
def extracted_conditions(spark, d):
    t = X.ladder(spark, d).select("construct", "conc").distinct()
    t = t.withColumn("txt", F.concat(F.lit("chemical:Mg:"), "conc", F.lit("mM chemical:Na:"), "conc", F.lit("uM")))
    m = t.withColumn("m", C.extract_concentrations(F.col("txt")))
    return m.select("construct", "txt", F.col("m")["Mg"].alias("mg"), F.col("m")["Na"].alias("na"))


@query(f"""WITH c AS (SELECT DISTINCT conc FROM ({X.LADDER})), i AS (SELECT conc, 0.5 * (conc / 1000 * 6 + 0.15 * 2) AS s FROM c)
  SELECT conc, s AS strength, sqrt(78.4 * 8.8541878128e-12 * 1.380649e-23 * 298.15 / (2 * 6.02214076e23 * 1.602176634e-19 * 1.602176634e-19 * 1000) / s) * 1e10 AS debye FROM i""")
def electrolyte_columns(spark, d):
    c = X.ladder(spark, d).select("conc").distinct()
    s = C.ionic_strength(F.create_map(F.lit("Mg"), F.col("conc"), F.lit("K"), F.lit(150.0)))
    return c.select("conc", s.alias("strength")).withColumn("debye", C.debye_length(F.col("strength")))


SYMS = f"SELECT motif_id, kind, CAST(unnest(range(len(string_split(signature, '-')))) AS INTEGER) AS pos, unnest(string_split(signature, '-')) AS base FROM ({X.MOTIF}) WHERE signature <> ''"


@query(f"""WITH p AS (SELECT kind, pos, base, count(*) AS n FROM ({SYMS}) GROUP BY ALL) SELECT kind, pos, base, n, n / sum(n) OVER (PARTITION BY kind, pos) AS share FROM p""")
def motif_base_profile(spark, d):
    return assessment.base_profile(X.motif(spark, d))


@query(f"WITH c AS (SELECT signature, count(*) AS n FROM ({X.MOTIF}) GROUP BY signature) SELECT signature, n, row_number() OVER (ORDER BY n DESC, signature) AS id FROM c")
def motif_vocabulary(spark, d):
    return assessment.frequency_ids(X.motif(spark, d), "signature")


# --- blind tests


@query(f"""WITH o AS (SELECT target, max(tm) AS tm, max(lddt) AS lddt, min(rmsd) AS rmsd FROM ({X.SUBMISSION}) WHERE grp % 5 = 1 GROUP BY target),
  f AS (SELECT s.target, count(*) AS n, max(s.tm) AS best_tm, median(s.tm) AS median_tm, max(s.lddt) AS best_lddt, median(s.lddt) AS median_lddt, min(s.rmsd) AS best_rmsd, median(s.rmsd) AS median_rmsd,
    CASE WHEN max(o.tm) IS NOT NULL THEN count_if(s.tm > o.tm) + 1 END AS place_tm, CASE WHEN max(o.tm) IS NOT NULL THEN count_if(s.rmsd < o.rmsd) + 1 END AS place_rmsd FROM ({X.SUBMISSION}) s LEFT JOIN o ON o.target = s.target WHERE grp % 5 <> 1 GROUP BY s.target)
  SELECT * FROM f""")
def blind_field_summary(spark, d):
    s = X.submission(spark, d)
    return assessment.field_summary(s.where("grp % 5 <> 1"), s.where("grp % 5 = 1"))


@query(f"""WITH b AS (SELECT target, max(tm) AS best, median(tm) AS med FROM ({X.SUBMISSION}) GROUP BY target) SELECT count(*) AS targets, avg(best) AS mean_best, avg(med) AS mean_median, count_if(best >= 0.45) AS solved FROM b""")
def blind_field_report(spark, d):
    return assessment.field_report(X.submission(spark, d))


ARMS = f"SELECT target, avg(tm) FILTER (WHERE model % 2 = 0) AS a, avg(tm) FILTER (WHERE model % 2 = 1) AS b FROM ({X.SUBMISSION}) GROUP BY target"


@query(f"""WITH p AS (SELECT b - a AS d FROM ({ARMS}) WHERE a IS NOT NULL AND b IS NOT NULL), c AS (SELECT count(*) AS n, avg(d) AS mean_delta, CAST(count_if(d > 0) AS BIGINT) AS wins, CAST(count_if(d < 0) AS BIGINT) AS losses FROM p),
  k AS (SELECT *, wins + losses AS t, greatest(wins, losses) AS m FROM c), g AS (SELECT n, mean_delta, wins, losses, t, unnest(range(m, t + 1)) AS i FROM k),
  s AS (SELECT n, mean_delta, wins, losses, sum(exp(lgamma(t + 1) - lgamma(i + 1) - lgamma(t - i + 1) - t * ln(2.0))) AS tail FROM g GROUP BY ALL)
  SELECT n, round(mean_delta, 9) AS mean_delta, wins, losses, round(least(1.0, 2 * tail), 9) AS p FROM s""")
def paired_sign_test(spark, d):
    s = X.submission(spark, d)
    arm = lambda k: s.where(f"model % 2 = {k}").groupBy("target").agg(F.avg("tm").alias("value"))
    t = assessment.paired_sign_test(arm(0), arm(1), "target", "value")
    return t.withColumns({"mean_delta": F.round("mean_delta", 9), "p": F.round("p", 9)})


@query(f"""WITH g AS (SELECT user_id AS k, CAST(event_id AS DOUBLE) AS step, value AS y, CAST(user_id % 17 + event_id % 5 AS DOUBLE) AS x FROM events),
  r AS (SELECT regr_slope(y, step) AS sy, regr_intercept(y, step) AS iy, regr_slope(x, step) AS sx, regr_intercept(x, step) AS ix, {CORR.format(x='x', y='y')} AS raw, count(*) AS n FROM g),
  e AS (SELECT raw, n, y - (sy * step + iy) AS ey, x - (sx * step + ix) AS ex FROM g, r)
  SELECT n, round(raw, 8) AS raw, round({CORR.format(x='ex', y='ey')}, 8) AS partial FROM e GROUP BY n, raw""")
def partial_correlation(spark, d):
    g = read_table(spark, d, "events").select(F.col("event_id").cast("double").alias("step"), F.col("value").alias("y"), (F.col("user_id") % 17 + F.col("event_id") % 5).cast("double").alias("x"))
    p = assessment.partial_correlation(g, "x", "y", "step")
    return p.select("n", F.round("raw", 8).alias("raw"), F.round("partial", 8).alias("partial"))
