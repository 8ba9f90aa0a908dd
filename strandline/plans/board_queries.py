"""Queries of boards, backbone geometry and column profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats
from ..operators import boards, fitness, geometry, profiles
from ..session import read_table
from . import fitness_queries as Q
from . import fixtures as X
from . import structure_queries as S
from . import summary_queries as Y
from .registry import oracle_of, query
from .summary_queries import rounded

EXPECTED = {"Ribozyme": 3, "tRNA": 2, "Aptamer": 3}


# --- boards

KIND = "(['Ribozyme', 'tRNA', 'Aptamer'])[CAST(substr(assay, 7) AS INTEGER) % 3 + 1]"
AUC = f"""SELECT assay, greatest(a, 1 - a) AS auc FROM (SELECT assay, (sum(r) FILTER (WHERE y) - count_if(y) * (count_if(y) + 1) / 2) / (count_if(y) * count_if(NOT y)) AS a FROM (
  SELECT assay, dms_score > median(dms_score) OVER (PARTITION BY assay) AS y, {Q.RANK.format(k='assay', v='x')} AS r FROM (SELECT assay, k1 % 101 + k2 AS x, dms_score FROM ({X.FITNESS}))) GROUP BY assay)"""
MEANS = f"""SELECT e.category, e.n AS n_expected, coalesce(s.n, 0) AS n_scored, signed, "abs", auc, depth_baseline, coalesce(u, 0) AS baseline_undefined FROM (SELECT unnest(['Ribozyme', 'tRNA', 'Aptamer']) AS category, CAST(unnest([3, 2, 3]) AS BIGINT) AS n) e
  LEFT JOIN (SELECT category, count(spearman) AS n, avg(spearman) AS signed, avg(abs(spearman)) AS "abs", avg(auc) AS auc, avg(coalesce(baseline, 0)) AS depth_baseline, count_if(baseline IS NULL) AS u
    FROM ({Q._SP}) s LEFT JOIN ({Q._DB}) d ON d.assay = s.assay LEFT JOIN ({AUC}) a ON a.assay = s.assay GROUP BY category) s ON s.category = e.category"""


def means(spark, d):
    f = X.fitness(spark, d).withColumn("x", F.col("k1") % 101 + F.col("k2"))
    base = fitness.depth_baseline(Q.multi(spark, d)).select("assay", F.col("spearman").alias("baseline"))
    category = boards.by_category(tuple(EXPECTED), F.substring("assay", 7, 3).cast("int"))
    per = stats.spearman(f, ["assay"], "x", "dms_score").join(base, "assay", "left").join(fitness.auc_mcc(f, "x"), "assay", "left")
    return boards.category_means(per.withColumn("category", category), EXPECTED)


@query(f"""SELECT category, n_expected, n_scored, round(signed, 8) AS signed, round("abs", 8) AS "abs", round(auc, 8) AS auc, round(depth_baseline, 8) AS depth_baseline, baseline_undefined FROM ({MEANS})""")
def category_means(spark, d):
    return rounded(means(spark, d))


@query(f"""SELECT 'incomplete_category' AS "check", 'CRIT' AS severity, category, n_scored || ' of ' || n_expected AS detail FROM ({MEANS}) WHERE n_scored <> n_expected""")
def incomplete_categories(spark, d):
    return boards.incomplete_categories(means(spark, d))


@query(f"""WITH c AS MATERIALIZED ({MEANS}), r AS (SELECT 'ours' AS model, {", ".join(f"max(signed) FILTER (WHERE category = '{c}') AS {c}" for c in EXPECTED)} FROM c
    UNION ALL SELECT 'mutation count', {", ".join(f"max(depth_baseline) FILTER (WHERE category = '{c}')" for c in EXPECTED)} FROM c UNION ALL SELECT 'published one', 0.31, 0.2, 0.1 UNION ALL SELECT 'published two', -0.4, NULL, 0.2 UNION ALL SELECT 'published three', -0.4, -0.5, -0.3),
  m AS (SELECT *, (Ribozyme + tRNA + Aptamer) / 3 AS macro FROM r)
  SELECT model, {", ".join(f"round({c}, 8) AS {c}" for c in EXPECTED)}, round(macro, 8) AS macro, CAST(row_number() OVER (ORDER BY coalesce(macro, -9) DESC, model) AS INTEGER) AS place FROM m""")
def signed_leaderboard(spark, d):
    published = spark.createDataFrame([("published one", 0.31, 0.2, 0.1), ("published two", -0.4, None, 0.2), ("published three", -0.4, -0.5, -0.3)], "model string, Ribozyme double, tRNA double, Aptamer double")
    return rounded(boards.ranked_board(means(spark, d), published, "ours"))


MEASURES = {"gdt": "max", "inf": "max", "lddt": "max", "rmsd": "min"}
SUBMITTED = f"SELECT *, round((tm + lddt) / 2, 6) AS gdt, CASE WHEN model % 4 <> 0 THEN round(sqrt(tm * lddt), 6) END AS inf FROM ({X.SUBMISSION})"


def _measures_sql() -> str:
    best = {m: ("min", "<") if k == "min" else ("max", ">") for m, k in MEASURES.items()}
    own = ", ".join(f"{best[m][0]}({m}) AS {m}" for m in MEASURES)
    cols = ", ".join(f"{best[m][0]}(s.{m}) AS best_{m}, median(s.{m}) AS median_{m}, CASE WHEN max(o.{m}) IS NOT NULL THEN count_if(s.{m} {best[m][1]} o.{m}) + 1 END AS place_{m}" for m in MEASURES)
    return f"WITH o AS (SELECT target, {own} FROM ({SUBMITTED}) WHERE grp % 5 = 1 AND target % 4 <> 2 GROUP BY target) SELECT s.target, count(*) AS n, {cols} FROM ({SUBMITTED}) s LEFT JOIN o ON o.target = s.target WHERE grp % 5 <> 1 GROUP BY s.target"


@query(_measures_sql())
def field_measures(spark, d):
    """GDT, INF, lDDT and RMSD of each target's field, and our places; for some targets we have none."""
    s = X.submission(spark, d).withColumns({"gdt": F.round((F.col("tm") + F.col("lddt")) / 2, 6), "inf": F.when(F.col("model") % 4 != 0, F.round(F.sqrt(F.col("tm") * F.col("lddt")), 6))})
    return boards.field_measures(s.where("grp % 5 <> 1"), s.where("grp % 5 = 1 AND target % 4 <> 2"), MEASURES)


@query("SELECT substr(sha256(string_agg(name || sha, '' ORDER BY name, sha)), 1, 16) AS digest, count(*) AS n FROM (SELECT source AS name, sha256(CAST(sum(n_chars) AS VARCHAR)) AS sha FROM documents GROUP BY source)")
def source_digest(spark, d):
    """Of the sources, as files whose hash is that of their size."""
    files = read_table(spark, d, "documents").groupBy(F.col("source").alias("name")).agg(F.sha2(F.sum("n_chars").cast("string"), 256).alias("sha"))
    return boards.source_digest(files, "name", "sha")


# --- backbone

BACKBONE = f"""SELECT p.entry, p.idx, {", ".join(f"{t}.{a} AS {t}{a}" for t in "pcn" for a in "xyz")} FROM (SELECT * FROM ({X.ATOM}) WHERE k = 0) p JOIN (SELECT * FROM ({X.ATOM}) WHERE k = 1) c ON c.entry = p.entry AND c.idx = p.idx
  JOIN (SELECT * FROM ({X.ATOM}) WHERE k = 2) n ON n.entry = p.entry AND n.idx = p.idx"""
POINT = {t: tuple(f"{t}{a}" for a in "xyz") for t in ("p", "c", "n", "np")}


def backbone(spark, d):
    a = X.atom(spark, d).where("k < 3")
    at = [F.max(F.when(F.col("k") == k, F.col(x))).alias(t + x) for k, t in enumerate("pcn") for x in "xyz"]
    return a.groupBy("entry", "idx").agg(*at)


def _apart(a: tuple, b: tuple) -> str:
    return "sqrt(" + " + ".join(f"({x} - {y}) * ({x} - {y})" for x, y in zip(a, b, strict=True)) + ")"


NEXT = f"SELECT *, {', '.join(f'lead({c}) OVER (PARTITION BY entry ORDER BY idx) AS n{c}' for c in POINT['p'])} FROM ({BACKBONE})"
BONDS = f"SELECT entry, idx, {_apart(POINT['p'], POINT['c'])} AS p_c4, {_apart(POINT['c'], POINT['n'])} AS c4_n, {_apart(POINT['p'], POINT['np'])} AS p_p FROM ({NEXT})"


CHI = S._torsion([POINT["p"], POINT["c"], POINT["n"], POINT["np"]]).removeprefix("round(").removesuffix(", 8)")


@query(f"SELECT entry, idx, round(chi, 8) AS chi, round(sin(chi), 8) AS sin_chi, round(cos(chi), 8) AS cos_chi FROM (SELECT entry, idx, {CHI} AS chi FROM ({NEXT}))")
def chi_torsions(spark, d):
    return rounded(geometry.pseudotorsions(backbone(spark, d)).select("entry", "idx", "chi", "sin_chi", "cos_chi"))


@query(f"""SELECT entry, {", ".join(f"round(avg(CAST(abs({b} - {at}) <= {off} AS DOUBLE)), 8) AS {b}_ok, round(median({b}), 8) AS {b}_median" for b, (at, off) in {"c4_n": (9.0, 3.0), "p_p": (8.5, 2.5)}.items())} FROM ({BONDS}) GROUP BY entry""")
def chain_validity(spark, d):
    """Bonds as long as those of the given points."""
    return rounded(geometry.geometry_validity(backbone(spark, d), {"c4_n": (9.0, 3.0), "p_p": (8.5, 2.5)}))


@query(f"""SELECT count(*) AS n, round(avg(v), 8) AS mean_validity, coalesce(avg(v) < 0.7, false) AS warning FROM (SELECT 0.5 * (coalesce(c4_n_ok, 0) + coalesce(p_p_ok, 0)) AS v FROM ({oracle_of('chain_validity')}))""")
def bond_warning(spark, d):
    return rounded(boards.bond_warning(geometry.geometry_validity(backbone(spark, d), {"c4_n": (9.0, 3.0), "p_p": (8.5, 2.5)}), 0.7))


@query(f"""WITH l AS ({" UNION ALL ".join(f"SELECT '{b}' AS bond, {b} AS v FROM ({BONDS}) WHERE {b} IS NOT NULL" for b in ("p_c4", "c4_n", "p_p"))}), s AS (SELECT bond, count(*) AS n, median(v) AS median, stddev_pop(v) AS sd FROM l GROUP BY bond)
  SELECT bond, n, round(median, 8) AS median, round(sd, 6) AS sd, CASE bond WHEN 'p_c4' THEN median > 3.6 AND median < 4.2 AND sd < 0.4 WHEN 'c4_n' THEN median > 5 AND median < 12 AND sd < 6 ELSE median > 5.3 AND median < 20 AND sd < 1.2 END AS ok FROM s""")
def bond_bands(spark, d):
    out = geometry.bond_bands(backbone(spark, d), {"p_c4": (3.6, 4.2, 0.4), "c4_n": (5, 12, 6), "p_p": (5.3, 20, 1.2)})
    return out.withColumns({"median": F.round("median", 8), "sd": F.round("sd", 6)})


@query(f"""WITH p AS (SELECT a.entry, a.idx, b.idx AS j, sqrt({S.D2}) AS dd FROM ({X.CENTRE}) a JOIN ({X.CENTRE}) b ON a.entry = b.entry AND abs(b.idx - a.idx) > 2 WHERE {S.D2} < 225),
  q AS (SELECT p.entry, p.idx, abs(sqrt({S.D2}) - dd) AS e FROM p JOIN ({S.MODEL}) a ON a.entry = p.entry AND a.idx = p.idx JOIN ({S.MODEL}) b ON b.entry = p.entry AND b.idx = p.j),
  s AS (SELECT entry, idx, count(*) AS pairs, avg((CAST(e < 0.5 AS DOUBLE) + CAST(e < 1 AS DOUBLE) + CAST(e < 2 AS DOUBLE) + CAST(e < 4 AS DOUBLE)) / 4) AS lddt FROM q GROUP BY ALL)
  SELECT c.entry, c.idx, coalesce(pairs, 0) AS pairs, round(lddt, 8) AS lddt FROM ({X.CENTRE}) c LEFT JOIN s ON s.entry = c.entry AND s.idx = c.idx""")
def residue_lddt(spark, d):
    c = X.centre(spark, d)
    m = c.select("entry", "idx", (F.col("x") + F.col("idx") % 3 * F.lit(0.4)).alias("x"), "y", (F.col("z") - F.col("idx") % 5 * 3 / 10).alias("z"))
    return rounded(geometry.residue_lddt(c, m, 15.0, 2))


# --- column profiles

FIELDS = ("x", "label", "always", "site", "never")
LABELS = f"SELECT x, CAST(idx % 7 AS DOUBLE) AS label, 1.5 AS always, CASE WHEN idx % 9 = 3 THEN 1.0 ELSE 0 END AS site, CAST(NULL AS DOUBLE) AS never FROM ({Y.CHAIN})"


def labels(spark, d):
    return Y.chain(spark, d).select("x", (F.col("idx") % 7).cast("double").alias("label"), F.lit(1.5).alias("always"), F.when(F.col("idx") % 9 == 3, 1.0).otherwise(0.0).alias("site"), F.lit(None).cast("double").alias("never"))


def _profile_sql() -> str:
    one = []
    for c in FIELDS:
        shares = f"(SELECT string_agg(CAST(v AS VARCHAR) || '=' || CAST(round(n / t, 6) AS VARCHAR), ' ' ORDER BY n DESC, v) FROM (SELECT {c} AS v, count(*) AS n, sum(count(*)) OVER () AS t FROM l WHERE {c} IS NOT NULL GROUP BY 1))"
        one.append(f"SELECT '{c}' AS field, count(*) AS rows, count({c}) AS finite, round(avg(CAST({c} <> 0 AS DOUBLE)), 8) AS nonzero_share, round(avg(CAST({c} <= -6 AS DOUBLE)), 8) AS tail_share, round(avg({c}), 8) AS mean, round(stddev_pop({c}), 6) AS sd, coalesce(min({c}) = max({c}), false) AS constant, CASE WHEN count(DISTINCT {c}) <= 64 THEN count(DISTINCT {c}) END AS classes, CASE WHEN count(DISTINCT {c}) <= 64 THEN coalesce({shares}, '') END AS shares FROM l")
    return f"WITH l AS MATERIALIZED ({LABELS}) " + " UNION ALL ".join(one)


@query(_profile_sql())
def column_profiles(spark, d):
    p = profiles.column_profiles(labels(spark, d), FIELDS)
    shares = F.array_join(F.transform("shares", lambda r: F.concat_ws("=", r["class"].cast("string"), F.round(r["share"], 6).cast("string"))), " ")
    return p.select("field", "rows", "finite", F.round("nonzero_share", 8).alias("nonzero_share"), F.round("tail_share", 8).alias("tail_share"), F.round("mean", 8).alias("mean"), F.round("sd", 6).alias("sd"), "constant", "classes", shares.alias("shares"))


@query("SELECT unnest(['x', 'x', 'label', 'always', 'never', 'site']) AS field, unnest(['not standardised', 'heavy tail', 'too few classes', 'undeclared constant', 'no finite value', 'declared constant varies']) AS finding FROM (SELECT count(*) FROM embeddings)")
def profile_findings(spark, d):
    p = profiles.column_profiles(labels(spark, d), FIELDS)
    return profiles.profile_findings(p, constant=["site"], standard=["x"], shares={"site": (0.001, 0.5)}, least={"label": 9, "x": 100})
