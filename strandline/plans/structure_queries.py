"""Queries of the structure and alignment operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alignment, chemistry, kernels, structure
from ..session import materialize, read_table
from . import fixtures as X
from .registry import query

D2 = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)"
CONTACTS = f"SELECT DISTINCT a.entry, a.idx AS i, b.idx AS j FROM ({X.CENTRE}) a JOIN ({X.CENTRE}) b ON a.entry = b.entry AND b.idx - a.idx >= 4 WHERE {D2} <= 64"
SIZES = f"SELECT entry, max(idx) + 1 AS length FROM ({X.CENTRE}) GROUP BY entry"


def pairs(spark, d):
    return structure.contacts(X.centre(spark, d), 8.0, 4)


def sizes(spark, d):
    return structure.lengths(X.centre(spark, d))


@query(CONTACTS)
def contact_pairs(spark, d):
    return pairs(spark, d)


@query(f"""SELECT s.entry, length, coalesce(c, 0) AS contacts, coalesce(c, 0) / length AS per_nt, 2 * coalesce(c, 0) / (length * (length - 1)) AS density
  FROM ({SIZES}) s LEFT JOIN (SELECT entry, count(*) AS c FROM ({CONTACTS}) GROUP BY entry) n ON n.entry = s.entry""")
def contact_stats(spark, d):
    return structure.contact_stats(pairs(spark, d), sizes(spark, d))


@query(f"SELECT entry, count(*) AS n, median(j - i) AS median_separation, avg(CAST(j - i <= 8 AS DOUBLE)) AS within_8, avg(CAST(j - i <= 64 AS DOUBLE)) AS within_64 FROM ({CONTACTS}) GROUP BY entry")
def contact_separation(spark, d):
    return structure.separation_shares(pairs(spark, d), [8, 64])


@query(f"""WITH o AS (SELECT entry, b, count(DISTINCT (i // b, j // b)) AS occupied FROM ({CONTACTS}), (SELECT unnest([8, 16, 32]) AS b) GROUP BY entry, b)
  SELECT o.entry, b, occupied, occupied * b * b / length AS effective_c, occupied / (ceil(length / b) * (ceil(length / b) + 1) / 2) AS share FROM o JOIN ({SIZES}) s ON s.entry = o.entry""")
def block_occupancy(spark, d):
    return structure.block_occupancy(pairs(spark, d), sizes(spark, d), [8, 16, 32])


@query(f"SELECT DISTINCT a.entry, a.idx FROM ({X.ATOM}) a JOIN ({X.ION}) b ON a.entry = b.entry WHERE {D2} <= 9")
def ion_site_flags(spark, d):
    return structure.near_flag(X.atom(spark, d), X.ion(spark, d), 3.0)


@query(f"""SELECT * FROM (SELECT a.entry, b.ion, a.k, count_if(sqrt({D2}) <= 5.0) AS "inner", count_if(sqrt({D2}) BETWEEN 7.0 AND 10.0) AS "outer"
  FROM ({X.ATOM}) a JOIN ({X.ION}) b ON a.entry = b.entry WHERE {D2} > 0 AND {D2} <= 100 GROUP BY ALL) WHERE "inner" + "outer" > 0""")
def ion_coordination(spark, d):
    return structure.coordination(X.ion(spark, d), X.atom(spark, d), 5.0, (7.0, 10.0))


@query(f"SELECT a.entry, a.idx, min(sqrt({D2})) AS distance FROM ({X.CENTRE}) a LEFT JOIN ({X.ION}) b ON a.entry = b.entry GROUP BY a.entry, a.idx")
def nearest_ion(spark, d):
    return structure.nearest_ion(X.centre(spark, d), X.ion(spark, d))


@query(f"SELECT a.entry, a.idx, count(b.idx) AS density FROM ({X.CENTRE}) a LEFT JOIN ({X.CENTRE}) b ON a.entry = b.entry AND a.idx <> b.idx AND {D2} <= 100 GROUP BY a.entry, a.idx")
def neighbour_density(spark, d):
    return structure.neighbour_density(X.centre(spark, d), 10.0)


BF = f"SELECT entry, idx, CASE WHEN k % 10 = 9 THEN 0 ELSE abs(x) END AS b FROM ({X.ATOM}) WHERE k IN (2, 3)"
Z = f"""SELECT entry, idx, b, CASE WHEN b > 0 AND n > 1 AND s > 0 THEN (b - m) / s END AS z FROM (SELECT *, avg(CASE WHEN b > 0 THEN b END) OVER w AS m, stddev_pop(CASE WHEN b > 0 THEN b END) OVER w AS s, count(CASE WHEN b > 0 THEN b END) OVER w AS n
  FROM (SELECT entry, idx, avg(b) AS b FROM ({BF}) GROUP BY entry, idx) WINDOW w AS (PARTITION BY entry))"""


def z_scores(spark, d):
    b = X.atom(spark, d).where("k IN (2, 3)").select("entry", "idx", F.when(F.col("k") % 10 == 9, 0.0).otherwise(F.abs("x")).alias("b"))
    return structure.residue_z(b)


@query(Z)
def residue_rigidity(spark, d):
    return z_scores(spark, d)


NEAR = f"SELECT a.entry, a.idx, min(sqrt({D2})) AS distance FROM ({X.CENTRE}) a LEFT JOIN ({X.ION}) b ON a.entry = b.entry GROUP BY a.entry, a.idx"
BINS = f"""SELECT CAST(z.entry AS VARCHAR) AS stratum, z.z, CASE WHEN distance < 4 THEN 0 WHEN distance < 6 THEN 1 WHEN distance < 8 THEN 2 WHEN distance < 12 THEN 3 WHEN distance < 20 THEN 4 END AS bin FROM ({Z}) z JOIN ({NEAR}) n ON n.entry = z.entry AND n.idx = z.idx"""


@query(f"""WITH b AS (SELECT * FROM ({BINS}) WHERE bin IS NOT NULL), g AS (SELECT stratum, bin, count(z) AS n, avg(z) AS mean FROM b GROUP BY ALL UNION ALL SELECT 'all', bin, count(z), avg(z) FROM b GROUP BY bin)
  SELECT *, mean >= lag(mean) OVER (PARTITION BY stratum ORDER BY bin) AS rises FROM g""")
def binned_gradient(spark, d):
    near = structure.nearest_ion(X.centre(spark, d), X.ion(spark, d))
    return structure.binned_gradient(z_scores(spark, d).join(near, ["entry", "idx"]), "z", "distance", [0, 4, 6, 8, 12, 20], "entry")


@query(f"""WITH j AS (SELECT d.density, z.z FROM ({Z}) z JOIN (SELECT a.entry, a.idx, count(b.idx) AS density FROM ({X.CENTRE}) a LEFT JOIN ({X.CENTRE}) b ON a.entry = b.entry AND a.idx <> b.idx AND {D2} <= 100 GROUP BY a.entry, a.idx) d
    ON d.entry = z.entry AND d.idx = z.idx), r AS (SELECT covar_pop(density, z) / nullif(stddev_pop(density) * stddev_pop(z), 0) AS r FROM j)
  SELECT density, count(*) AS n, avg(z) AS mean_z, round(any_value(r), 8) AS r FROM j, r GROUP BY density HAVING count(*) >= 5""")
def density_bins(spark, d):
    dens = structure.neighbour_density(X.centre(spark, d), 10.0)
    return structure.density_bins(z_scores(spark, d).join(dens, ["entry", "idx"]), 5).withColumn("r", F.round("r", 8))


LOOPS = f"""WITH c AS (SELECT entry, idx FROM ({X.CENTRE})), e AS (SELECT DISTINCT entry, unnest([i, j]) AS idx FROM ({X.BP})),
  r AS (SELECT c.entry, c.idx, CAST(e.idx IS NOT NULL AS INTEGER) AS paired FROM c LEFT JOIN e ON c.entry = e.entry AND c.idx = e.idx),
  u AS (SELECT *, CAST(sum(paired) OVER (PARTITION BY entry ORDER BY idx) AS BIGINT) AS up FROM r),
  s AS (SELECT p.entry, p.i, p.j, b.up - a.up - 1 AS inside FROM ({X.BP}) p JOIN u a ON a.entry = p.entry AND a.idx = p.i JOIN u b ON b.entry = p.entry AND b.idx = p.j WHERE lw = 1),
  runs AS (SELECT entry, up, min(idx) AS lo, max(idx) AS hi FROM u WHERE paired = 0 GROUP BY ALL),
  f AS (SELECT DISTINCT entry, unnest([i, j]) AS e FROM s WHERE inside > 0),
  i AS (SELECT DISTINCT runs.entry, runs.up FROM runs JOIN f ON runs.entry = f.entry AND (runs.lo = f.e + 1 OR runs.hi = f.e - 1))
  SELECT u.entry, u.idx, paired, CASE WHEN paired = 1 THEN 0 WHEN EXISTS (SELECT 1 FROM s WHERE s.entry = u.entry AND inside = 0 AND u.idx > s.i AND u.idx < s.j) THEN 2
    WHEN EXISTS (SELECT 1 FROM i WHERE i.entry = u.entry AND i.up = u.up) THEN 1 ELSE 0 END AS loop FROM u"""


@query(LOOPS)
def loop_classes(spark, d):
    return structure.loop_classes(X.centre(spark, d), X.bp(spark, d))


BB = f"SELECT p.entry, p.idx, p.x AS px, p.y AS py, p.z AS pz, c.x AS cx, c.y AS cy, c.z AS cz FROM ({X.ATOM}) p JOIN ({X.ATOM}) c ON p.entry = c.entry AND p.idx = c.idx WHERE p.k = 0 AND c.k = 1"


def backbone(spark, d):
    a = X.atom(spark, d)
    kind = lambda k, n: a.where(f"k = {k}").select("entry", "idx", *[F.col(c).alias(n + c) for c in "xyz"])
    return kind(0, "p").join(kind(1, "c"), ["entry", "idx"])


def _torsion(p: list[tuple[str, str, str]]) -> str:
    v = [[f"({b[k]} - {a[k]})" for k in range(3)] for a, b in zip(p, p[1:], strict=False)]
    cross = lambda a, b: [f"({a[1]} * {b[2]} - {a[2]} * {b[1]})", f"({a[2]} * {b[0]} - {a[0]} * {b[2]})", f"({a[0]} * {b[1]} - {a[1]} * {b[0]})"]
    dot = lambda a, b: "(" + " + ".join(f"{x} * {y}" for x, y in zip(a, b, strict=True)) + ")"
    n1, n2 = cross(v[0], v[1]), cross(v[1], v[2])
    return f"round(atan2({dot(v[0], n2)} * sqrt({dot(v[1], v[1])}), {dot(n1, n2)}), 8)"


_P, _C = ("px", "py", "pz"), ("cx", "cy", "cz")
_NP, _NC, _BC = ("npx", "npy", "npz"), ("ncx", "ncy", "ncz"), ("bcx", "bcy", "bcz")


@query(f"""WITH w AS (SELECT *, {', '.join(f'lead({c}) OVER w AS n{c}' for c in (*_P, *_C))}, {', '.join(f'lag({c}) OVER w AS b{c}' for c in _C)} FROM ({BB}) WINDOW w AS (PARTITION BY entry ORDER BY idx))
  SELECT entry, idx, {_torsion([_BC, _P, _C, _NP])} AS eta, {_torsion([_P, _C, _NP, _NC])} AS theta FROM w""")
def pseudotorsions(spark, d):
    t = structure.pseudotorsions(backbone(spark, d))
    return t.select("entry", "idx", F.round("eta", 8).alias("eta"), F.round("theta", 8).alias("theta"))


@query(f"""WITH w AS (SELECT entry, sqrt((lead(px) OVER w - px) ** 2 + (lead(py) OVER w - py) ** 2 + (lead(pz) OVER w - pz) ** 2) AS dd FROM ({BB}) WINDOW w AS (PARTITION BY entry ORDER BY idx))
  SELECT entry, count(*) AS n, avg(CAST(abs(dd - 9) <= 3 AS DOUBLE)) AS valid, median(dd) AS median FROM w WHERE dd IS NOT NULL GROUP BY entry""")
def bond_validity(spark, d):
    return structure.bond_validity(backbone(spark, d), 9.0, 3.0)


MODEL = f"SELECT entry, idx, x + (idx % 3) * 0.4 AS x, y, z - (idx % 5) * 0.3 AS z FROM ({X.CENTRE})"


@query(f"""WITH p AS (SELECT a.entry, a.idx AS i, b.idx AS j, sqrt({D2}) AS dd FROM ({X.CENTRE}) a JOIN ({X.CENTRE}) b ON a.entry = b.entry AND b.idx > a.idx WHERE {D2} < 225),
  q AS (SELECT p.entry, abs(sqrt({D2}) - dd) AS e FROM p JOIN ({MODEL}) a ON a.entry = p.entry AND a.idx = p.i JOIN ({MODEL}) b ON b.entry = p.entry AND b.idx = p.j)
  SELECT entry, count(*) AS pairs, avg((CAST(e < 0.5 AS DOUBLE) + CAST(e < 1 AS DOUBLE) + CAST(e < 2 AS DOUBLE) + CAST(e < 4 AS DOUBLE)) / 4) AS lddt FROM q GROUP BY entry""")
def lddt(spark, d):
    c = X.centre(spark, d)
    m = c.select("entry", "idx", (F.col("x") + F.col("idx") % 3 * F.lit(0.4)).alias("x"), "y", (F.col("z") - F.col("idx") % 5 * 3 / 10).alias("z"))
    return structure.lddt(c, m)


@query(f"""WITH n AS (SELECT entry, idx, count(*) AS n FROM ({X.ATOM}) WHERE k < 4 GROUP BY ALL), t AS (SELECT a.entry, CAST(sum(a.n * b.n) AS BIGINT) AS pairs FROM n a JOIN n b ON a.entry = b.entry AND b.idx < a.idx - 1 GROUP BY a.entry),
  c AS (SELECT a.entry, count(*) AS c FROM ({X.ATOM}) a JOIN ({X.ATOM}) b ON a.entry = b.entry AND b.idx - a.idx > 1 WHERE a.k < 4 AND b.k < 4 AND {D2} < 4 GROUP BY a.entry)
  SELECT t.entry, coalesce(c, 0) AS clashes, pairs, coalesce(c, 0) / pairs AS score FROM t LEFT JOIN c ON c.entry = t.entry""")
def clash_score(spark, d):
    return structure.clash_score(X.atom(spark, d).where("k < 4"))


@query(f"SELECT entry, idx, round(x - avg(x) OVER w, 9) AS x, round(y - avg(y) OVER w, 9) AS y, round(z - avg(z) OVER w, 9) AS z, round(avg(x) OVER w, 9) AS mx, round(avg(y) OVER w, 9) AS my, round(avg(z) OVER w, 9) AS mz FROM ({X.CENTRE}) WINDOW w AS (PARTITION BY entry)")
def centred_coordinates(spark, d):
    return structure.center_coords(X.centre(spark, d)).select("entry", "idx", *[F.round(c, 9).alias(c) for c in ("x", "y", "z", "mx", "my", "mz")])


PRED = f"SELECT entry, i, CASE WHEN i % 4 = 1 THEN j + 1 ELSE j END AS j FROM ({X.BP}) WHERE i % 7 <> 2"


@query(f"""WITH p AS (SELECT DISTINCT entry, i, j FROM ({PRED})), r AS (SELECT DISTINCT entry, i, j FROM ({X.BP})),
  n AS (SELECT coalesce(p.entry, r.entry) AS entry, count_if(p.i IS NOT NULL AND r.i IS NOT NULL) AS tp, count_if(r.i IS NULL) AS fp, count_if(p.i IS NULL) AS fn FROM p FULL JOIN r ON p.entry = r.entry AND p.i = r.i AND p.j = r.j GROUP BY 1)
  SELECT entry, tp, fp, fn, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall, 2 * tp / nullif(2 * tp + fp + fn, 0) AS f1, CASE WHEN tp + fn > 0 THEN coalesce(tp / nullif(sqrt((tp + fp) * (tp + fn)), 0), 0) END AS inf FROM n""")
def base_pair_scores(spark, d):
    """The pairs with some left out and some off by one, against themselves."""
    b = materialize(X.bp(spark, d), "pairs")
    moved = F.when(F.col("i") % 4 == 1, F.col("j") + 1).otherwise(F.col("j")).alias("j")
    return structure.pair_confusion(b.where("i % 7 <> 2").select("entry", "i", moved), b, "entry")


@query(f"""WITH g AS (SELECT entry, i, j, i - row_number() OVER (PARTITION BY entry, i + j ORDER BY i) AS g FROM ({X.BP}))
  SELECT entry, i, j, count(*) OVER (PARTITION BY entry, i + j, g) AS run, count(*) OVER (PARTITION BY entry, i + j, g) >= 4 AS helical FROM g""")
def helix_runs(spark, d):
    return structure.helix_runs(X.bp(spark, d).select("entry", "i", "j"))


BASED = f"SELECT z.entry, z.idx, z.z, substr('ACGUN', (z.idx * 7 + z.entry) % 5 + 1, 1) AS base FROM ({Z}) z"


def based(spark, d):
    return z_scores(spark, d).withColumn("base", F.substring(F.lit("ACGUN"), ((F.col("idx") * 7 + F.col("entry")) % 5 + 1).cast("int"), F.lit(1)))


@query(f"""SELECT entry, idx, coalesce(sum(CAST(base IN ('G', 'C') AS INTEGER)) OVER w / nullif(sum(CAST(base IN ('A', 'C', 'G', 'U') AS INTEGER)) OVER w, 0), 0) AS gc FROM ({BASED}) WINDOW w AS (PARTITION BY entry ORDER BY idx ROWS BETWEEN 16 PRECEDING AND 16 FOLLOWING)""")
def local_gc(spark, d):
    return structure.local_gc(based(spark, d))


@query(f"""WITH w AS (SELECT base || lead(base, 1) OVER w || lead(base, 2) OVER w || lead(base, 3) OVER w AS k, [z, lead(z, 1) OVER w, lead(z, 2) OVER w, lead(z, 3) OVER w] AS zs FROM ({BASED}) WINDOW w AS (PARTITION BY entry ORDER BY idx)),
  u AS (SELECT CASE WHEN regexp_full_match(k, 'G[ACGU][AG]A') THEN 'GNRA' ELSE 'other' END AS class, unnest(zs) AS z FROM w WHERE k IS NOT NULL)
  SELECT class, count(z) AS n, round(avg(z), 9) AS mean_z FROM u GROUP BY class""")
def kmer_context(spark, d):
    return structure.kmer_context_mean(based(spark, d)).withColumn("mean_z", F.round("mean_z", 9))


@query()
def dot_bracket_pairs(spark, d):
    """Pairs of bracket strings made of the whole sequences, for every row; checked against a stack in the tests."""
    s = X.seq(spark, d).select("id", F.translate("sequence", "ACGTN", "(.)..").alias("ss"))
    found = structure.dot_bracket_pairs(s, "id", "ss").groupBy("id").agg(F.count("*").alias("pairs"), F.sum(F.col("j") - F.col("i")).alias("span"))
    return s.select("id").join(found, "id", "left").fillna(0, ["pairs", "span"])


# --- kernels and chemistry

def _pair_score(a: str, b: str) -> str:
    return f"CASE WHEN {a} || {b} IN ('GC', 'CG') THEN 3.0 WHEN {a} || {b} IN ('AU', 'UA') THEN 2.0 WHEN {a} || {b} IN ('GU', 'UG') THEN 0.8 ELSE 0 END"


@query(f"""WITH b AS (SELECT entry, idx, base, lead(base) OVER w AS nxt, lag(base) OVER w AS prv FROM ({BASED}) WINDOW w AS (PARTITION BY entry ORDER BY idx)), l AS (SELECT entry, count(*) AS l FROM b GROUP BY entry),
  p AS (SELECT a.entry, a.idx AS i, c.idx AS j, round({_pair_score('a.base', 'c.base')} + CASE WHEN a.prv IS NULL OR c.nxt IS NULL THEN 0 ELSE 0.6 * ({_pair_score('a.prv', 'c.nxt')} + CASE WHEN c.idx - a.idx >= 6 THEN {_pair_score('a.nxt', 'c.prv')} ELSE 0 END) END
    + 2.0 * exp(-(c.idx - a.idx) / 40.0), 9) AS score FROM b a JOIN b c ON a.entry = c.entry AND c.idx >= a.idx + 4),
  t AS (SELECT *, row_number() OVER (PARTITION BY entry ORDER BY score DESC, i, j) AS place FROM p), k AS (SELECT CAST(unnest([4, 16]) AS INTEGER) AS c)
  SELECT x.entry, k.c, avg(CAST(coalesce(t.place <= k.c * l.l, false) AS INTEGER)) AS recall FROM ({CONTACTS}) x CROSS JOIN k JOIN l ON l.entry = x.entry LEFT JOIN t ON t.entry = x.entry AND t.i = x.i AND t.j = x.j GROUP BY ALL""")
def proposal_recall(spark, d):
    return kernels.proposal_recall(based(spark, d), pairs(spark, d), [4, 16])


def placed(spark, d):
    return X.centre(spark, d).join(based(spark, d).select("entry", "idx", "base"), ["entry", "idx"])


@query()
def greedy_base_pairs(spark, d):
    """One partner per residue, most central distance first; checked against the sequential order in the tests."""
    return kernels.greedy_pairs(placed(spark, d), 12.0, 4.0)


@query()
def step_covariances(spark, d):
    s = X.centre(spark, d).withColumn("context", (F.col("entry") % 3).cast("string"))
    return kernels.step_covariance(s, "context", ["x", "y", "z"], 20).select("context", "n", F.round("condition", 6).alias("condition"), F.transform("covariance", lambda v: F.round(v, 6)).alias("covariance"))


@query()
def heldout_gaussian_nll(spark, d):
    s = X.centre(spark, d).withColumn("key", F.col("entry") * 100_000 + F.col("idx"))
    return kernels.gaussian_nll(s, "entry", ["x", "y", "z"], "key", 1e-3, 10)


COMPS = f"SELECT entry, idx, (['A', 'C', 'G', 'U', 'PSU', 'OMC', 'DT', 'I', 'XXX'])[(idx * 5 + entry) % 9 + 1] AS comp FROM ({X.CENTRE})"


def components(spark, d):
    c = F.element_at(F.array(*[F.lit(x) for x in ("A", "C", "G", "U", "PSU", "OMC", "DT", "I", "XXX")]), ((F.col("idx") * 5 + F.col("entry")) % 9 + 1).cast("int"))
    return X.centre(spark, d).select("entry", "idx", c.alias("comp"))


def dictionary(spark):
    return spark.createDataFrame([("PSU", "PSEUDOURIDINE-5'-MONOPHOSPHATE", "U"), ("OMC", "O2'-METHYLYCYTIDINE-5'-MONOPHOSPHATE", "C"), ("XXX", " ", None)], "comp string, name string, parent string")


_MEAN = [sum(v[i] for v in chemistry.BASES.values()) / 4 for i in range(len(chemistry.PROPERTIES))]
_KNOWN = {p: f"CASE parent {' '.join(f'WHEN {b!r} THEN {v[i]!r}' for b, v in chemistry.BASES.items())} ELSE {_MEAN[i]!r} END" for i, p in enumerate(chemistry.PROPERTIES)}
_KNOWN |= {
    "groove_donors": f"{_KNOWN['groove_donors']} + CAST(comp = 'PSU' AS INTEGER)", "charge": f"CASE WHEN idx = 0 THEN 0 ELSE {_KNOWN['charge']} END", "hydroxyl": f"CASE WHEN token = 'DU' THEN 0 ELSE {_KNOWN['hydroxyl']} END",
    "north": f"CASE WHEN token = 'DU' THEN 0.3 ELSE {_KNOWN['north']} END", "south": f"CASE WHEN token = 'DU' THEN 0.7 ELSE {_KNOWN['south']} END",
}


@query(f"""WITH r AS (SELECT *, CASE comp WHEN 'PSU' THEN 'U' WHEN 'OMC' THEN 'C' WHEN 'DT' THEN 'DU' WHEN 'XXX' THEN 'N' ELSE comp END AS token FROM ({COMPS})),
  p AS (SELECT *, CASE WHEN right(token, 1) IN ('A', 'C', 'G', 'U') THEN right(token, 1) END AS parent, CAST(comp NOT IN ('A', 'C', 'G', 'U') AS DOUBLE) AS modified FROM r)
  SELECT entry, idx, token, {', '.join(f"CAST(coalesce(parent = '{b}', false) AS DOUBLE) AS is_{b.lower()}" for b in 'ACGU')}, modified, {', '.join(f'CAST({v} AS DOUBLE) AS {k}' for k, v in _KNOWN.items())},
    CAST(comp = 'OMC' AS DOUBLE) AS methylated, CAST(comp = 'PSU' AS DOUBLE) AS pseudouridine, CAST(modified = 1 AND comp NOT IN ('OMC', 'PSU') AS DOUBLE) AS other_modified,
    coalesce(sum(CAST(parent IN ('G', 'C') AS INTEGER)) OVER w / nullif(sum(CAST(parent IS NOT NULL AS INTEGER)) OVER w, 0), 0) AS local_gc FROM p WINDOW w AS (PARTITION BY entry ORDER BY idx ROWS BETWEEN 16 PRECEDING AND 16 FOLLOWING)""")
def residue_chemistry(spark, d):
    """All 24 columns of every residue."""
    names = dictionary(spark)
    e = chemistry.residue_chemistry(chemistry.encode_residues(components(spark, d), names), names)
    return e.select("entry", "idx", "token", *chemistry.FEATURES)


@query()
def full_atom_pairs(spark, d):
    """Pairs by the distance of pairing atoms and the angle of ring planes; checked against a plain version in the tests."""
    base = F.element_at(F.array(*[F.lit(b) for b in "AUGC"]), ((F.col("idx") * 3 + F.col("entry")) % 4 + 1).cast("int"))
    names = F.array(*[F.lit(a) for a in ("P", "N9", "C8", "N7", "C5", "C4", "N1", "C2", "N3", "C6")])
    atoms = X.atom(spark, d).where("k < 10").select("entry", "idx", base.alias("base"), F.element_at(names, F.col("k") + 1).alias("atom"), "x", "y", "z")
    return kernels.full_atom_pairs(atoms, 25.0, 0.5)


@query(f"""WITH n AS (SELECT comp, count(*) AS n FROM ({COMPS}) WHERE comp NOT IN ('A', 'C', 'G', 'U', 'N') GROUP BY comp),
  c AS (SELECT *, CASE comp WHEN 'PSU' THEN 'pseudouridine' WHEN 'OMC' THEN 'methylation' ELSE 'unknown' END AS class FROM n), g AS (SELECT class, count(*) AS kinds, CAST(sum(n) AS BIGINT) AS residues FROM c GROUP BY class)
  SELECT *, residues / sum(residues) OVER () AS share FROM g""")
def modification_census(spark, d):
    return chemistry.modification_census(components(spark, d), dictionary(spark))


ENT = "SELECT l_orderkey AS entry, l_suppkey % 3 AS chain, l_linenumber AS seq_id, '' AS ins, CASE WHEN l_returnflag = 'R' THEN 'protein' ELSE 'rna' END AS kind FROM lineitem"


@query(f"""WITH r AS (SELECT DISTINCT * FROM ({ENT})), n AS (SELECT entry, chain, kind, count(*) AS n FROM r GROUP BY ALL),
  e AS (SELECT entry, coalesce(sum(n) FILTER (WHERE kind = 'rna'), 0) AS rna, coalesce(sum(n) FILTER (WHERE kind = 'protein'), 0) AS protein FROM n GROUP BY entry)
  SELECT count(*) AS entries, CAST(max(rna) AS BIGINT) AS most_rna, count_if(rna > 4) AS over_large, avg(CAST(protein > 0 AS DOUBLE)) AS in_complex, count_if(rna >= 2 AND protein >= 2) AS ribosome_like FROM e""")
def entry_population(spark, d):
    r = read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("entry"), (F.col("l_suppkey") % 3).alias("chain"), F.col("l_linenumber").alias("seq_id"), F.lit("").alias("ins"), F.when(F.col("l_returnflag") == "R", "protein").otherwise("rna").alias("kind"))
    return chemistry.composition_population(chemistry.entry_composition(r), (2, 2), 4)


BUF = "SELECT o_orderkey AS entry, o_totalprice / 1000 AS mg, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 150 END AS k FROM orders"


@query(f"""WITH e AS (SELECT entry, 'Mg' AS ion, mg AS mm FROM ({BUF}) UNION ALL SELECT entry, 'K', CAST(k AS DOUBLE) FROM ({BUF}) WHERE k IS NOT NULL), a AS (SELECT count(*) AS al FROM orders),
  s AS (SELECT ion, count(*) AS entries, median(mm) AS median, list_sort(list(mm)) AS v FROM e GROUP BY ion)
  SELECT ion, entries, median, v[least(entries - 1, CAST(floor(0.1 * entries) AS BIGINT)) + 1] AS p10, v[least(entries - 1, CAST(floor(0.9 * entries) AS BIGINT)) + 1] AS p90, entries / al AS share FROM s, a""")
def buffer_audit(spark, d):
    o = read_table(spark, d, "orders")
    k = F.when(F.col("o_orderkey") % 3 == 0, (F.col("o_orderkey") % 150).cast("double"))
    ions = F.map_filter(F.create_map(F.lit("Mg"), F.col("o_totalprice") / 1000, F.lit("K"), k), lambda _, v: v.isNotNull())
    return chemistry.buffer_audit(o.select(F.col("o_orderkey").alias("entry"), ions.alias("ions")))


# --- alignments

SAME = "len(list_filter(list_zip(string_split(a.aligned, ''), string_split(b.aligned, '')), lambda p: p[1] = p[2])) / length(a.aligned)"
WEIGHTS = f"SELECT a.family, a.row_no, 1.0 / count(*) AS weight FROM ({X.MSA}) a JOIN ({X.MSA}) b ON a.family = b.family WHERE {SAME} > 0.3 GROUP BY ALL"


def weights(spark, d):
    return alignment.row_weights(X.msa(spark, d), 0.3)


@query(f"SELECT family, count(*) AS rows, sum(weight) AS neff FROM ({WEIGHTS}) GROUP BY family")
def alignment_neff(spark, d):
    return alignment.neff(weights(spark, d))


MI = f"""WITH wt AS MATERIALIZED ({WEIGHTS}), cells AS MATERIALIZED (SELECT m.family, m.row_no, w.weight, CAST(unnest(range(length(m.aligned))) AS INTEGER) AS c, unnest(string_split(m.aligned, '')) AS s FROM ({X.MSA}) m JOIN wt w ON w.family = m.family AND w.row_no = m.row_no),
  tot AS (SELECT family, sum(weight) AS w FROM wt GROUP BY family), wide AS (SELECT family, max(c) + 1 AS l FROM cells GROUP BY family), kinds AS (SELECT unnest(['A', 'C', 'G', 'U', '-']) AS s), one AS (SELECT t.family, c, k.s, t.w FROM tot t JOIN (SELECT DISTINCT family, c FROM cells) x ON x.family = t.family, kinds k),
  p AS (SELECT o.family, o.c, o.s, o.w, (coalesce(sum(x.weight), 0) + 0.5 / 5) / (o.w + 0.5) AS p FROM one o LEFT JOIN cells x ON x.family = o.family AND x.c = o.c AND x.s = o.s GROUP BY o.family, o.c, o.s, o.w),
  jn AS (SELECT a.family, a.c AS i, b.c AS j, a.s AS sa, b.s AS sb, sum(a.weight) AS n FROM cells a JOIN cells b ON a.family = b.family AND a.row_no = b.row_no AND a.c < b.c GROUP BY ALL),
  q AS (SELECT a.family, a.c AS i, b.c AS j, (coalesce(jn.n, 0) + 0.5 / 25) / (a.w + 0.5) AS q, a.p AS pa, b.p AS pb FROM p a JOIN p b ON a.family = b.family AND a.c < b.c LEFT JOIN jn ON jn.family = a.family AND jn.i = a.c AND jn.j = b.c AND jn.sa = a.s AND jn.sb = b.s),
  mi AS (SELECT family, i, j, sum(q * ln(q / (pa * pb))) AS mi FROM q GROUP BY ALL), both2 AS (SELECT * FROM mi UNION ALL SELECT family, j, i, mi FROM mi),
  m AS (SELECT b.family, b.i, sum(mi) / any_value(l) AS m FROM both2 b JOIN wide ON wide.family = b.family GROUP BY ALL), al AS (SELECT b.family, sum(mi) / any_value(l * l) AS al FROM both2 b JOIN wide ON wide.family = b.family GROUP BY b.family)
  SELECT mi.family, mi.i, mi.j, mi.mi, mi.mi - a.m * b.m / al.al AS score FROM mi JOIN m a ON a.family = mi.family AND a.i = mi.i JOIN m b ON b.family = mi.family AND b.i = mi.j JOIN al ON al.family = mi.family"""


def coupling(spark, d):
    return alignment.apc_mutual_information(X.msa(spark, d), weights(spark, d))


@query(f"SELECT family, i, j, round(mi, 8) AS mi, round(score, 8) AS score FROM ({MI})")
def apc_mutual_information(spark, d):
    return coupling(spark, d).select("family", "i", "j", F.round("mi", 8).alias("mi"), F.round("score", 8).alias("score"))


TOP = f"SELECT family, i, j, row_number() OVER (PARTITION BY family ORDER BY round(score, 9) DESC, i, j) AS place FROM ({MI}) WHERE j - i >= 4 QUALIFY place <= 32"


@query(TOP)
def top_couplings(spark, d):
    return alignment.top_couplings(coupling(spark, d), 0.5, 4, 64).select("family", "i", "j", "place")


@query(f"""SELECT t.family, k, avg(CAST(c.family IS NOT NULL AS DOUBLE)) AS precision FROM ({TOP}) t CROSS JOIN (SELECT CAST(unnest([4, 8, 32]) AS INTEGER) AS k) LEFT JOIN ({X.CONSENSUS}) c ON c.family = t.family AND c.i = t.i AND c.j = t.j WHERE place <= k GROUP BY ALL""")
def coupling_precision(spark, d):
    """The best pairs of columns against the bracket pairs of each family's first row."""
    return alignment.precision_at(alignment.top_couplings(coupling(spark, d), 0.5, 4, 64), X.consensus_pairs(spark, d), [4, 8, 32])


KM = "list_distinct(list_transform(range(1, len(s) - 3), lambda i: s[i] || s[i + 1] || s[i + 2] || s[i + 3] || s[i + 4]))"
SETS = f"SELECT id, lang AS family, len(s) AS n, {KM} AS k FROM (SELECT id, lang, string_split(sequence, '') AS s FROM ({X.SEQ}))"


@query(f"""WITH r AS MATERIALIZED ({SETS}), s AS (SELECT q.id AS query, q.family, r.id AS row_no, len(list_intersect(q.k, r.k)) AS common, len(q.k) + len(r.k) AS al FROM r q JOIN r ON q.family = r.family AND q.id <> r.id WHERE q.id % 20 = 0 AND least(q.n, r.n) >= 0.5 * greatest(q.n, r.n))
  SELECT query, family, row_no, common / (al - common) AS similarity FROM s WHERE common > 0 AND common / (al - common) >= 0.10 QUALIFY row_number() OVER (PARTITION BY query, family ORDER BY common / (al - common) DESC, row_no) = 1""")
def kmer_best_rows(spark, d):
    """Every row whose id is divisible by 20 against all others of its language, whole sequences."""
    s = X.seq(spark, d).select("id", F.col("lang").alias("family"), "sequence")
    return alignment.best_rows(s.where("id % 20 = 0").withColumnRenamed("id", "query"), s.withColumnRenamed("id", "row_no"), own=True)


@query(f"""WITH c AS (SELECT family, row_no, CAST(unnest(range(length(aligned))) AS INTEGER) AS c, unnest(string_split(aligned, '')) AS s FROM ({X.MSA})),
  f AS (SELECT family, min(row_no) AS row_no FROM c GROUP BY family), g AS (SELECT c.family, c.c FROM c JOIN f ON c.family = f.family AND c.row_no = f.row_no WHERE regexp_full_match(s, '[A-Z-]') AND c.c % 7 <> 2),
  i AS (SELECT c.family, c.row_no, c.c, row_number() OVER (PARTITION BY c.family, c.row_no ORDER BY c.c) - 1 AS r FROM c JOIN g ON c.family = g.family AND c.c = g.c WHERE s <> '-')
  SELECT a.family, a.row_no, a.r AS i, b.r AS j FROM ({X.CONSENSUS}) p JOIN i a ON a.family = p.family AND a.c = p.i JOIN i b ON b.family = p.family AND b.c = p.j AND a.row_no = b.row_no""")
def projected_pairs(spark, d):
    cells = alignment.match_columns(alignment.columns(X.msa(spark, d)).where("col % 7 <> 2"))
    return alignment.project(X.consensus_pairs(spark, d), cells)
