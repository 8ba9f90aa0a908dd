"""Queries of superposed models, nested Gaussian fits and chain geometry."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import functions as F

from ..operators import kernels, structure, superposition
from . import fixtures as X
from . import structure_queries as S
from . import summary_queries as Y
from .registry import query

AXES = "xyz"


# --- superposition: copies of the entries, turned, bent and stretched

COPIES = f"""SELECT CAST(entry AS VARCHAR) AS target, 'shifted' AS submission, idx, 5 - y AS x, x AS y, z FROM ({X.CENTRE})
  UNION ALL SELECT CAST(entry AS VARCHAR), 'bent', idx, x + idx % 7, y, z FROM ({X.CENTRE}) UNION ALL SELECT CAST(entry AS VARCHAR), 'mirrored', idx, -x, y, z * 1.1 FROM ({X.CENTRE}) WHERE idx % 5 <> 2"""


def reference(spark, d):
    return X.centre(spark, d).select(F.col("entry").cast("string").alias("target"), "idx", *AXES)


def copies(spark, d):
    c = reference(spark, d)
    made = lambda name, x, y, z: c.select("target", F.lit(name).alias("submission"), "idx", x.alias("x"), y.alias("y"), z.alias("z"))
    x, y, z = (F.col(a) for a in AXES)
    mirrored = made("mirrored", -x, y, z * 1.1).where("idx % 5 <> 2")
    return made("shifted", 5 - y, x, z).unionByName(made("bent", x + F.col("idx") % 7, y, z)).unionByName(mirrored)


def _rmsd_sql() -> str:
    h = {(i, j): f"(p{i}{j} - m{i} * r{j} / n)" for i in range(3) for j in range(3)}
    k = ", ".join(f"h0{i} * h0{j} + h1{i} * h1{j} + h2{i} * h2{j} AS k{i}{j}" for i, j in combinations_with_replacement(range(3), 2))
    det = lambda m: f"({m(0, 0)} * ({m(1, 1)} * {m(2, 2)} - {m(1, 2)} * {m(2, 1)}) - {m(0, 1)} * ({m(1, 0)} * {m(2, 2)} - {m(1, 2)} * {m(2, 0)}) + {m(0, 2)} * ({m(1, 0)} * {m(2, 1)} - {m(1, 1)} * {m(2, 0)}))"
    off = lambda i, j: f"(k{i}{j} - q)" if i == j else f"k{min(i, j)}{max(i, j)}"
    return f"""WITH j AS (SELECT s.target, s.submission, s.x AS m0, s.y AS m1, s.z AS m2, r.x AS r0, r.y AS r1, r.z AS r2 FROM ({COPIES}) s JOIN ({X.CENTRE}) r ON s.target = CAST(r.entry AS VARCHAR) AND s.idx = r.idx),
  s AS (SELECT target, submission, count(*) AS n, {", ".join(f"sum({v}{i}) AS {v}{i}" for v in "mr" for i in range(3))}, {", ".join(f"sum(m{i} * r{j}) AS p{i}{j}" for i in range(3) for j in range(3))},
    sum({" + ".join(f"{v}{i} * {v}{i}" for v in "mr" for i in range(3))}) AS q2 FROM j GROUP BY ALL),
  h AS (SELECT target, submission, n, q2 - ({" + ".join(f"{v}{i} * {v}{i}" for v in "mr" for i in range(3))}) / n AS spread, {", ".join(f"{x} AS h{i}{j}" for (i, j), x in h.items())} FROM s),
  k AS (SELECT *, {k}, {det(lambda i, j: f"h{i}{j}")} AS dh FROM h), q AS (SELECT *, (k00 + k11 + k22) / 3 AS q FROM k),
  p AS (SELECT *, sqrt((pow(k00 - q, 2) + pow(k11 - q, 2) + pow(k22 - q, 2) + 2 * (k01 * k01 + k02 * k02 + k12 * k12)) / 6) AS p FROM q),
  t AS (SELECT *, acos(greatest(-1, least(1, coalesce({det(off)} / nullif(2 * p * p * p, 0), 0)))) / 3 AS turn FROM p),
  e AS (SELECT *, q + 2 * p * cos(turn) AS e1, q + 2 * p * cos(turn + 2 * pi() / 3) AS e3 FROM t)
  SELECT target, submission, n AS paired, round(CASE WHEN n >= 10 THEN sqrt(greatest((spread - 2 * (sqrt(greatest(e1, 0)) + sqrt(greatest(3 * q - e1 - e3, 0)) + sign(dh) * sqrt(greatest(e3, 0)))) / n, 0)) END, 3) AS rmsd FROM e"""


@query(_rmsd_sql())
def superposition_rmsd(spark, d):
    paired = superposition.paired_residues(reference(spark, d), copies(spark, d))
    return superposition.submission_rmsd(paired).withColumn("rmsd", F.round("rmsd", 3))


@query()
def superposed_models(spark, d):
    """RMSD, TM and GDT of turned, bent and mirrored copies of each entry against it; held against a plain search in the tests."""
    return superposition.score_submissions(reference(spark, d), copies(spark, d))


# --- nested Gaussian fits: points by context, by pairing, and by both

STEPS = f"""SELECT entry * 100 + idx AS key, CASE WHEN entry % 97 = 5 THEN 'N' ELSE substr('ACGU', idx % 4 + 1, 1) END AS ctx, entry % 3 = 0 AS pair, idx % 2 = 0 AS helix, x, y, z FROM ({Y.CHAIN})"""
MODELS = {"all": (), "ctx": ("ctx",), "struct": ("pair", "helix"), "both": ("ctx", "pair", "helix")}
GAINS = {"sequence_over_global": ("all", "ctx"), "structure_over_sequence": ("ctx", "both"), "structure_over_global": ("all", "struct")}


def steps(spark, d):
    context = F.when(F.col("entry") % 97 == 5, "N").otherwise(F.substring(F.lit("ACGU"), F.col("idx") % 4 + 1, F.lit(1)))
    return Y.chain(spark, d).select((F.col("entry") * 100 + F.col("idx")).alias("key"), context.alias("ctx"), (F.col("entry") % 3 == 0).alias("pair"), (F.col("idx") % 2 == 0).alias("helix"), *AXES)


def _nll_sql() -> str:
    """In-sample fits of every model in DuckDB: the inverse of a 3 x 3 matrix by its cofactors."""
    pairs = list(combinations_with_replacement(AXES, 2))
    c = lambda a, b: f"c{min(a, b)}{max(a, b)}"
    key = {m: " || ':' || ".join(f"CAST({x} AS VARCHAR)" for x in columns) or "''" for m, columns in MODELS.items()}
    covered = ", ".join(f"count(*) OVER (PARTITION BY {key[m]}) >= 40 AS cov_{m}" for m in MODELS)
    one = []
    for m in MODELS:
        one.append(f"SELECT '{m}' AS model, {key[m]} AS g, count(*) AS n, {', '.join(f'covar_samp({a}, {b}) + {1e-3 if a == b else 0} AS c{a}{b}, covar_pop({a}, {b}) AS d{a}{b}' for a, b in pairs)} FROM common GROUP BY 2")
    cofactor = {
        "xx": f"({c('y', 'y')} * {c('z', 'z')} - {c('y', 'z')} * {c('y', 'z')})", "yy": f"({c('x', 'x')} * {c('z', 'z')} - {c('x', 'z')} * {c('x', 'z')})", "zz": f"({c('x', 'x')} * {c('y', 'y')} - {c('x', 'y')} * {c('x', 'y')})",
        "xy": f"({c('x', 'z')} * {c('y', 'z')} - {c('x', 'y')} * {c('z', 'z')})", "xz": f"({c('x', 'y')} * {c('y', 'z')} - {c('x', 'z')} * {c('y', 'y')})", "yz": f"({c('x', 'y')} * {c('x', 'z')} - {c('x', 'x')} * {c('y', 'z')})",
    }
    det = f"(cxx * {cofactor['xx']} + cxy * {cofactor['xy']} + cxz * {cofactor['xz']})"
    trace = " + ".join(f"{1 if a == b else 2} * d{a}{b} * {cofactor[a + b]}" for a, b in pairs)
    return f"""WITH s AS ({STEPS}), f AS (SELECT *, {covered} FROM s), common AS MATERIALIZED (SELECT * FROM f WHERE {" AND ".join(f"cov_{m}" for m in MODELS)}),
  about AS ({" UNION ALL ".join(f"SELECT '{m}' AS model, count_if(cov_{m}) AS n_covered, count_if(cov_{m}) / count(*) AS coverage FROM f" for m in MODELS)}),
  fits AS ({" UNION ALL ".join(one)}), nll AS (SELECT model, n, 0.5 * (({trace}) / {det} + ln({det}) + 3 * ln(2 * pi())) AS l FROM fits WHERE n >= 8),
  t AS (SELECT model, CAST(sum(n) AS BIGINT) AS n_in, sum(n * l) / sum(n) AS in_sample FROM nll GROUP BY model)
  SELECT about.model, n_covered, round(coverage, 8) AS coverage, (SELECT count(*) FROM common) AS n_common, n_in, round(in_sample, 6) AS in_sample FROM about LEFT JOIN t ON t.model = about.model"""


def nested(spark, d):
    return kernels.nested_gaussian_nll(steps(spark, d), list(AXES), MODELS, "key", 1e-3, 40, 8)


@query(_nll_sql())
def nested_gaussian_fits(spark, d):
    """Every model's coverage and in-sample fit on the steps that all cover."""
    return nested(spark, d).select("model", "n_covered", F.round("coverage", 8).alias("coverage"), "n_common", "n_in", F.round("in_sample", 6).alias("in_sample"))


@query()
def nested_gaussian_gains(spark, d):
    """What each level gains over the one before, in-sample and on held-out halves; held against a plain version in the tests."""
    return kernels.nll_gains(nested(spark, d), GAINS)
