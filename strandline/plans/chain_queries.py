"""Queries of the chain assembly operators and of label functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import conditions as C
from ..functions import sequence as S
from ..operators import assessment, audits, chains, chemistry, splits, structure
from ..session import read_table
from . import fixtures as X
from .fitness_queries import CORR, RANK
from .registry import query
from .structure_queries import CONTACTS, Z, z_scores
from .structure_queries import pairs as contact_pairs

# --- labels of chains

CHAINS = "SELECT l_orderkey AS entry, CAST(l_linenumber AS VARCHAR) AS chain, l_quantity AS length, l_partkey FROM lineitem"


def chain_table(spark, d):
    return read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("entry"), F.col("l_linenumber").cast("string").alias("chain"), F.col("l_quantity").alias("length"), "l_partkey")


@query(f"""WITH c AS (SELECT entry, chain, p_brand AS own FROM ({CHAINS}) JOIN part ON l_partkey = p_partkey WHERE CAST(chain AS INTEGER) % 3 = 0),
  e AS (SELECT o_orderkey AS entry, o_orderpriority AS label FROM orders WHERE o_orderkey % 4 <> 1),
  j AS (SELECT a.entry, a.chain, coalesce(c.own, e.label) AS family FROM ({CHAINS}) a LEFT JOIN c ON c.entry = a.entry AND c.chain = a.chain LEFT JOIN e ON e.entry = a.entry)
  SELECT entry, chain, family, CASE WHEN family LIKE 'Brand#%' THEN 'RF' || substr(family, 7) END AS accession FROM j""")
def chain_families(spark, d):
    """The chain's own label before its entry's, and accessions of labels that are an id or an accession."""
    c = chain_table(spark, d)
    p = read_table(spark, d, "part").select("p_partkey", "p_brand")
    own = c.join(p, F.col("l_partkey") == F.col("p_partkey")).where(F.col("chain").cast("int") % 3 == 0).select("entry", "chain", F.col("p_brand").alias("family"))
    by_entry = read_table(spark, d, "orders").where("o_orderkey % 4 <> 1").select(F.col("o_orderkey").alias("entry"), F.col("o_orderpriority").alias("family"))
    known = p.select(F.concat(F.lit("RF"), F.substring("p_brand", 7, 9)).alias("accession"), F.col("p_brand").alias("id")).distinct()
    return chains.family_accession(chains.label_precedence(c.select("entry", "chain"), own, by_entry), known)


@query(f"SELECT entry, chain, length FROM (SELECT *, row_number() OVER (PARTITION BY entry ORDER BY length DESC, CAST(chain AS INTEGER)) AS r FROM ({CHAINS})) WHERE r = 1")
def longest_chains(spark, d):
    c = chain_table(spark, d).withColumn("file_order", F.col("chain").cast("int"))
    return chemistry.longest_chain(c).select("entry", "chain", "length")


# --- residues

SIDE = f"SELECT entry, CASE WHEN entry % 3 = 0 THEN 'A' WHEN idx % 2 = 0 THEN 'A' ELSE 'B' END AS chain, idx AS number, x, y, z FROM ({X.CENTRE})"
MODEL_SIDE = f"SELECT entry, CASE WHEN entry % 3 = 0 THEN 'X' ELSE chain END AS chain, number, x + 1 AS x, y, z FROM ({SIDE}) WHERE number % 5 <> 2"


@query(f"""SELECT r.entry, r.chain, r.number, round(r.x, 6) AS x, round(m.x, 6) AS m_x FROM ({SIDE}) r JOIN ({MODEL_SIDE}) m ON m.entry = r.entry AND m.number = r.number AND (m.chain = r.chain OR r.entry % 3 = 0)""")
def residues_by_number(spark, d):
    """Joined by chain and number; entries of one chain under another name by number alone. Second mentions do not count."""
    c = X.centre(spark, d)
    chain = F.when((F.col("entry") % 3 == 0) | (F.col("idx") % 2 == 0), "A").otherwise("B")
    side = c.select("entry", chain.alias("chain"), F.col("idx").alias("number"), "x", "y", "z", F.col("idx").alias("file_pos"))
    again = side.where("number % 4 = 1").withColumns({"x": F.col("x") + 50, "file_pos": F.col("file_pos") + 1_000_000_000})
    model = side.where("number % 5 <> 2").withColumns({"chain": F.when(F.col("entry") % 3 == 0, "X").otherwise(F.col("chain")), "x": F.col("x") + 1})
    return chains.align_by_number(side.unionByName(again), model, "entry").select("entry", "chain", "number", F.round("x", 6).alias("x"), F.round("m_x", 6).alias("m_x"))


BACK = f"""SELECT entry, idx AS seq_id, (['A', 'C', 'G', 'U', 'XX'])[idx % 5 + 1] AS comp, (['P', 'C4''', 'N9', 'N1'])[k + 1] AS atom, x FROM ({X.ATOM}) WHERE k < 4 AND (idx + k) % 7 <> 3"""


@query(f"""SELECT entry, seq_id, round(max(x) FILTER (WHERE atom = 'P'), 6) AS px, round(max(x) FILTER (WHERE atom = 'C4'''), 6) AS cx,
  round(CASE any_value(comp) WHEN 'A' THEN max(x) FILTER (WHERE atom = 'N9') WHEN 'G' THEN max(x) FILTER (WHERE atom = 'N9') WHEN 'C' THEN max(x) FILTER (WHERE atom = 'N1') WHEN 'U' THEN max(x) FILTER (WHERE atom = 'N1')
    ELSE coalesce(max(x) FILTER (WHERE atom = 'N9'), max(x) FILTER (WHERE atom = 'N1')) END, 6) AS nx
  FROM ({BACK}) GROUP BY entry, seq_id HAVING count(*) > count(*) FILTER (WHERE atom = CASE WHEN comp IN ('A', 'G') THEN 'N1' WHEN comp IN ('C', 'U') THEN 'N9' END)""")
def backbone_picks(spark, d):
    names = F.array(*[F.lit(n) for n in ("P", "C4'", "N9", "N1")])
    comps = F.array(*[F.lit(n) for n in ("A", "C", "G", "U", "XX")])
    a = X.atom(spark, d).where("k < 4 AND (idx + k) % 7 <> 3")
    a = a.select("entry", F.lit("A").alias("chain"), F.col("idx").alias("seq_id"), F.element_at(comps, F.col("idx") % 5 + 1).alias("comp"), F.element_at(names, F.col("k") + 1).alias("atom"), "x", "y", "z", F.col("k").alias("file_pos"))
    parents = spark.createDataFrame([(b, b) for b in "ACGU"], "comp string, parent string")
    return chains.backbone(a, parents).select("entry", "seq_id", *[F.round(c, 6).alias(c) for c in ("px", "cx", "nx")])


@query(f"""WITH s AS (SELECT entry, idx AS seq FROM ({X.CENTRE})), c AS (SELECT entry, i AS seq, CASE WHEN lw = 2 THEN 'wobble' ELSE 'WC' END AS pair_class, i AS row_no FROM ({X.BP}) UNION ALL SELECT entry, j, 'closing', j + 1000000 FROM ({X.BP}))
  SELECT s.entry, s.seq, arg_max(pair_class, row_no) AS pair_class FROM s LEFT JOIN c ON c.entry = s.entry AND c.seq = s.seq GROUP BY ALL""")
def step_pair_classes(spark, d):
    steps = X.centre(spark, d).select("entry", F.lit("A").alias("chain"), F.col("idx").alias("seq"))
    b = X.bp(spark, d)
    one = b.select("entry", F.lit("A").alias("chain"), F.col("i").alias("seq"), F.when(F.col("lw") == 2, "wobble").otherwise("WC").alias("pair_class"), F.col("i").alias("row_no"))
    two = b.select("entry", F.lit("A").alias("chain"), F.col("j").alias("seq"), F.lit("closing").alias("pair_class"), (F.col("j") + 1_000_000).alias("row_no"))
    return chains.step_classes(steps, one.unionByName(two)).drop("chain")


@query(f"""WITH p AS (SELECT DISTINCT entry, unnest([i, j]) AS idx FROM ({X.BP}) WHERE lw = 1), r AS (SELECT z.entry, z.idx, z.z, p.idx IS NOT NULL AS lw1 FROM ({Z}) z LEFT JOIN p ON p.entry = z.entry AND p.idx = z.idx),
  e AS (SELECT entry, bool_or(lw1) AS k, count(*) AS l FROM r GROUP BY entry)
  SELECT r.entry, idx, r.entry % 2 = 0 AND z IS NOT NULL AND z > -6 AS rigid, k AS loop_known, r.entry % 4 = 3 OR r.entry * 60 <= 200 OR r.entry * 60 <= 3 * l AS disorder_known FROM r JOIN e ON e.entry = r.entry""")
def valid_targets(spark, d):
    """Which residues each head may learn from; entries know their method and polymer length, every fourth not the latter."""
    z = z_scores(spark, d).select("entry", "idx", "z")
    paired = X.bp(spark, d).where("lw = 1").select("entry", F.explode(F.array("i", "j")).alias("idx")).distinct().withColumn("_p", F.lit(True))
    r = z.join(paired, ["entry", "idx"], "left").withColumn("lw1", F.coalesce("_p", F.lit(False))).drop("_p")
    meta = X.centre(spark, d).select("entry").distinct().select("entry", F.when(F.col("entry") % 2 == 0, "X-ray diffraction").otherwise("EM").alias("method"), F.when(F.col("entry") % 4 != 3, F.col("entry") * 60).alias("n_polymer"))
    return chains.valid_targets(r, meta).select("entry", "idx", "rigid", "loop_known", "disorder_known")


@query(f"""WITH m AS (SELECT entry, max(idx) + 1 AS length FROM ({X.CENTRE}) GROUP BY entry), c AS (SELECT entry, count(*) AS n FROM ({CONTACTS}) GROUP BY entry), b AS (SELECT entry, count(*) AS n FROM ({X.CENTRE}) WHERE entry % 3 <> 1 OR idx > 0 GROUP BY entry)
  SELECT m.entry, m.length, c.n AS n_contacts, coalesce(b.n, 0) = m.length AS agrees FROM m JOIN c ON c.entry = m.entry LEFT JOIN b ON b.entry = m.entry WHERE m.length BETWEEN 5 AND 4608 AND c.n >= 8""")
def assembled_chains(spark, d):
    """Chains inside the length window with enough contacts; every third entry lacks a backbone row."""
    c = X.centre(spark, d).withColumn("chain", F.lit("A"))
    meta = c.groupBy("entry", "chain").agg((F.max("idx") + 1).alias("length"))
    return chains.assemble_chains(meta, c.where("entry % 3 <> 1 OR idx > 0"), contact_pairs(spark, d).withColumn("chain", F.lit("A")), 5).drop("chain")


TYPES = "CASE l_orderkey % 4 WHEN 0 THEN 'polyribonucleotide' WHEN 1 THEN 'polydeoxyribonucleotide/polyribonucleotide hybrid' WHEN 2 THEN 'polydeoxyribonucleotide' ELSE 'polypeptide(L)' END"
RAW = f"""SELECT l_orderkey AS entry, 'A' AS chain, l_suppkey % 5 AS seq_id, l_partkey % 3 AS model, CASE WHEN l_linestatus = 'O' THEN 'H' ELSE 'C' END AS element, (['O2''', 'P', 'C4'''])[l_linenumber % 3 + 1] AS atom, l_linenumber * 1000000000000 + l_partkey * 10000000 + CAST(floor(l_extendedprice) AS BIGINT) AS pos, {TYPES} AS kind FROM lineitem"""


@query(f"""WITH r AS ({RAW}), f AS (SELECT entry, arg_min(model, pos) AS m FROM r GROUP BY entry),
  a AS (SELECT r.* FROM r JOIN f ON f.entry = r.entry AND f.m = r.model WHERE element <> 'H' QUALIFY row_number() OVER (PARTITION BY r.entry, seq_id, atom ORDER BY pos) = 1),
  o AS (SELECT DISTINCT entry, seq_id FROM a WHERE atom = 'O2''')
  SELECT a.entry, a.seq_id, a.atom, a.pos FROM a LEFT JOIN o ON o.entry = a.entry AND o.seq_id = a.seq_id WHERE a.entry % 4 = 0 OR a.entry % 4 = 1 AND o.entry IS NOT NULL""")
def rna_atoms(spark, d):
    """First model, no hydrogens, one conformer, RNA chains and the hybrids' residues with an O2'."""
    l = read_table(spark, d, "lineitem")
    kinds = {0: "polyribonucleotide", 1: "polydeoxyribonucleotide/polyribonucleotide hybrid", 2: "polydeoxyribonucleotide", 3: "polypeptide(L)"}
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), (F.col("entry") % 4).cast("int"))
    names = F.array(*[F.lit(n) for n in ("O2'", "P", "C4'")])
    a = l.select(
        F.col("l_orderkey").alias("entry"), F.lit("A").alias("chain"), (F.col("l_suppkey") % 5).alias("seq_id"), F.lit("").alias("ins"), (F.col("l_partkey") % 3).alias("model"),
        F.when(F.col("l_linestatus") == "O", "H").otherwise("C").alias("element"), F.element_at(names, (F.col("l_linenumber") % 3 + 1).cast("int")).alias("atom"), (F.col("l_linenumber") * 1_000_000_000_000 + F.col("l_partkey") * 10_000_000 + F.floor("l_extendedprice")).alias("file_pos"),
    )
    entities = a.select("entry", "chain").distinct().withColumn("poly_type", kind)
    return structure.hybrid_rule(structure.first_conformers(a), entities).select("entry", "seq_id", "atom", F.col("file_pos").alias("pos"))


# --- blind tests and checks

LISTED = "SELECT source || '/' || (CASE WHEN doc_id % 3 = 0 THEN 'R1' || lpad(CAST(doc_id % 50 AS VARCHAR), 3, '0') ELSE 'PZ' || (doc_id % 40) END) || '/' || (CASE WHEN doc_id % 7 = 0 THEN 'Solution_0.pdb' WHEN doc_id % 11 = 0 THEN 'readme.txt' ELSE 'sub' || doc_id || 'TS' || (doc_id % 9) || '_' || (doc_id % 5) || '.pdb' END) AS path, doc_id FROM documents"


def listed(spark, d):
    k = F.col("doc_id")
    folder = F.when(k % 3 == 0, F.concat(F.lit("R1"), F.lpad((k % 50).cast("string"), 3, "0"))).otherwise(F.concat(F.lit("PZ"), k % 40))
    name = F.when(k % 7 == 0, "Solution_0.pdb").when(k % 11 == 0, "readme.txt").otherwise(F.concat(F.lit("sub"), k, F.lit("TS"), k % 9, F.lit("_"), k % 5, F.lit(".pdb")))
    return read_table(spark, d, "documents").select(F.concat_ws("/", "source", folder, name).alias("path"), "doc_id")


@query(f"""WITH f AS (SELECT path, split_part(path, '/', 2) AS target, lower(split_part(path, '/', 3)) AS name FROM ({LISTED})), t AS (SELECT target, min(path) FILTER (WHERE name LIKE '%solution%') AS reference, count_if(name NOT LIKE '%solution%') AS competitors FROM f WHERE name LIKE '%.pdb' GROUP BY target)
  SELECT target, CASE WHEN target LIKE 'R1%' THEN 'casp' ELSE 'puzzle' END AS kind, reference, competitors, CASE WHEN target = 'PZ1' THEN 'a switch' END AS description FROM t WHERE reference IS NOT NULL""")
def blind_test_targets(spark, d):
    return chains.blind_targets(listed(spark, d).select("path"), spark.createDataFrame([("PZ1", "a switch")], "target string, description string"))


@query(f"""WITH f AS (SELECT doc_id, split_part(path, '/', 3) AS name FROM ({LISTED})), s AS (SELECT doc_id, regexp_replace(name, '\\.[A-Za-z0-9]+$', '') AS stem FROM f)
  SELECT CASE WHEN regexp_extract(stem, 'TS(\\w+?)_(\\d+)', 1) <> '' THEN regexp_extract(stem, 'TS(\\w+?)_(\\d+)', 1) ELSE stem END AS "group", CASE WHEN regexp_extract(stem, 'TS(\\w+?)_(\\d+)', 1) <> '' THEN regexp_extract(stem, 'TS(\\w+?)_(\\d+)', 2) ELSE '?' END AS model, count(*) AS n FROM s GROUP BY ALL""")
def competitors(spark, d):
    return listed(spark, d).select(C.competitor_label(F.col("path")).alias("c")).groupBy("c.group", "c.model").agg(F.count("*").alias("n"))


ARM = f"SELECT grp % 7 AS pair, target, avg(tm) FILTER (WHERE model % 2 = 0) AS a, avg(tm) FILTER (WHERE model % 2 = 1) AS b FROM ({X.SUBMISSION}) GROUP BY ALL"


@query(f"""WITH p AS (SELECT b - a AS d FROM (SELECT target, avg(a) AS a, avg(b) AS b FROM ({ARM}) GROUP BY target) WHERE a IS NOT NULL AND b IS NOT NULL), c AS (SELECT count(*) AS n, avg(d) AS m, CAST(count_if(d > 0) AS BIGINT) AS w, CAST(count_if(d < 0) AS BIGINT) AS l FROM p),
  k AS (SELECT *, w + l AS t, greatest(w, l) AS g FROM c), s AS (SELECT n, m, sum(exp(lgamma(t + 1) - lgamma(i + 1) - lgamma(t - i + 1) - t * ln(2.0))) AS tail FROM (SELECT *, unnest(range(g, t + 1)) AS i FROM k) GROUP BY ALL)
  SELECT n, round(m, 9) AS mean_delta, round(least(1.0, 2 * tail), 9) AS p, CASE WHEN m > 0.02 AND 2 * tail < 0.05 THEN 'keep' WHEN m > 0.02 THEN 'inconclusive, leaning positive' WHEN m < -0.02 THEN 'worse' WHEN m < 0 AND 2 * tail < 0.05 THEN 'worse, weakly' WHEN abs(m) <= 0.02 THEN 'no effect' END AS verdict FROM s""")
def ab_verdict(spark, d):
    arms = X.submission(spark, d).groupBy((F.col("grp") % 7).alias("pair"), "target").agg(F.avg(F.when(F.col("model") % 2 == 0, F.col("tm"))).alias("a"), F.avg(F.when(F.col("model") % 2 == 1, F.col("tm"))).alias("b"))
    both = arms.groupBy("target").agg(F.avg("a").alias("a"), F.avg("b").alias("b")).dropna()
    t = assessment.paired_sign_test(both.select("target", F.col("a").alias("v")), both.select("target", F.col("b").alias("v")), "target", "v")
    return assessment.ab_verdict(t, 0.02).select("n", F.round("mean_delta", 9).alias("mean_delta"), F.round("p", 9).alias("p"), "verdict")


@query(f"""WITH f AS (SELECT assay, CASE WHEN assay = 'assay_2' THEN 1.0 + (k1 % 2) * 1e-6 ELSE k1 % 101 + k2 END AS x, dms_score FROM ({X.FITNESS})), r AS (SELECT assay, x, {RANK.format(k='assay', v='x')} AS rx, {RANK.format(k='assay', v='dms_score')} AS ry FROM f)
  SELECT assay, count(*) AS n, {CORR.format(x='rx', y='ry')} AS spearman, round(stddev_pop(x), 8) AS sd, stddev_pop(x) < 1e-3 AS degenerate FROM r GROUP BY assay""")
def degenerate_predictors(spark, d):
    x = F.when(F.col("assay") == "assay_2", 1.0 + F.col("k1") % 2 * F.lit(1e-6)).otherwise((F.col("k1") % 101 + F.col("k2")).cast("double"))
    return audits.degenerate_predictors(X.fitness(spark, d).withColumn("x", x), "assay", "x", "dms_score", 1e-3).withColumn("sd", F.round("sd", 8))


@query(f"""SELECT 'sequence' AS key, count(*) AS leaks, CASE WHEN count(*) > 0 THEN 'ALERT' ELSE 'OK' END AS status FROM (SELECT sequence FROM ({X.BENCH_SEQ}) INTERSECT SELECT sequence FROM ({X.SEQ}))
  UNION ALL SELECT 'id', count(*), CASE WHEN count(*) > 0 THEN 'ALERT' ELSE 'OK' END FROM (SELECT id FROM ({X.BENCH_SEQ}) INTERSECT SELECT id FROM ({X.SEQ}))
  UNION ALL SELECT 'scored_assays', abs(count(DISTINCT assay) - 7), CASE WHEN count(DISTINCT assay) <> 7 THEN 'ALERT' ELSE 'OK' END FROM ({X.FITNESS})""")
def leak_status(spark, d):
    counters = splits.leak_guard(X.bench_seq(spark, d), X.seq(spark, d), ["sequence", "id"])
    return audits.leak_status(counters, X.fitness(spark, d).select("assay").distinct().count(), 7)


# --- label functions

IONS = (("(?i)magnes| th[a-z]", "Mg"), ("(?i)sod|en[.,]", "Na"), ("(?i)pot|de ", "K"))


def _labels(column: str) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({column}, '{p}') THEN '{n}' END" for p, n in IONS) + "], lambda x: x IS NOT NULL)"


@query(f"""SELECT doc_id, CASE {' '.join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for p, n in IONS)} ELSE 'other' END AS ion, array_to_string({_labels('text')}, ' ') AS mentions,
  CASE WHEN doc_id % 3 = 0 THEN 'DMS' WHEN contains(lower(source), '2a3') THEN '2A3' WHEN contains(lower(source), 'src1') THEN 'SRC1' ELSE '?' END AS probe,
  CASE WHEN contains(upper(lang), 'E') THEN 'X-ray' ELSE 'other' END AS method, doc_id % 12 BETWEEN 5 AND 8 AS deoxy,
  regexp_replace(translate(upper(left(source || lang, 12)), 'T', 'U'), '[^ACGU-]', '-', 'g') AS aligned FROM documents""")
def label_functions(spark, d):
    """Ion classes and mentions, probes, methods, deoxy tokens and cleaned rows."""
    t = read_table(spark, d, "documents")
    notes = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("a:b"), F.lit("modifier:DMS"))).otherwise(F.array(F.lit("a:b")))
    return t.select(
        "doc_id", C.first_match(F.col("text"), IONS, "other").alias("ion"), F.array_join(C.all_matches(F.col("text"), IONS), " ").alias("mentions"), C.probe_of(notes, F.col("source"), ["2A3", "SRC1"]).alias("probe"),
        C.method_label(F.when(F.upper("lang").contains("E"), "x-ray diffraction").otherwise("nmr")).alias("method"), S.is_deoxy(F.col("doc_id") % 12).alias("deoxy"), S.clean_aligned(F.substring(F.concat("source", "lang"), 1, 12)).alias("aligned"),
    )


@query("""WITH x AS (SELECT l_partkey % 50 AS construct, 1 + l_linenumber % 3 AS v, 1.602176634e-19 * 1.602176634e-19 / (4 * pi() * 8.8541878128e-12 * 78.4 * 1.380649e-23 * 298.15) * 1e10 / 2.8 AS xi FROM lineitem),
  t AS (SELECT *, greatest(0, (1 - 1 / (v * xi)) / v) AS theta FROM x)
  SELECT construct, count(*) AS n, round(any_value(xi), 6) AS xi, round(avg(theta), 6) AS theta, round(avg(1 - v * theta), 6) AS q_eff FROM t GROUP BY construct""")
def manning_terms(spark, d):
    """Mean condensed share and effective charge of each construct's ions, whose valence changes from row to row."""
    v = read_table(spark, d, "lineitem").select((F.col("l_partkey") % 50).alias("construct"), (1 + F.col("l_linenumber") % 3).alias("valence"))
    m = v.withColumn("m", C.manning_terms(F.col("valence")))
    return m.groupBy("construct").agg(F.count("*").alias("n"), F.round(F.max("m.xi"), 6).alias("xi"), F.round(F.avg("m.theta"), 6).alias("theta"), F.round(F.avg("m.q_eff"), 6).alias("q_eff"))
