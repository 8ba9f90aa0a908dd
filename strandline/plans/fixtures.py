"""Views over the given tables that stand for corpora, assays, structures, catalogs and logs.

Each view has a DataFrame and the same thing as DuckDB SQL (a CTE body).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_table

AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BASES = "ACGTACGTACGTACGTACGTACGTAN"
HEX, HEX_BASES = "0123456789abcdef", "ACGUACGUACGUACGU"


def _letters(text: Column) -> Column:
    return F.translate(F.upper(F.regexp_replace(text, "[^A-Za-z]", "")), AZ, BASES)


def seq(spark: SparkSession, d: str) -> DataFrame:
    t = read_table(spark, d, "documents")
    return t.select(F.col("doc_id").alias("id"), F.col("source").alias("chunk"), "lang", F.concat("source", F.lit("/"), "doc_id", F.lit(" "), "lang").alias("header"), _letters(F.col("text")).alias("sequence"))


SEQ = f"""SELECT doc_id AS id, source AS chunk, lang, source || '/' || doc_id || ' ' || lang AS header,
  translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '{AZ}', '{BASES}') AS sequence FROM documents"""


def bench_seq(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "benchmark").select(F.col("item_id").alias("id"), _letters(F.col("text")).alias("sequence"))


BENCH_SEQ = f"SELECT item_id AS id, translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '{AZ}', '{BASES}') AS sequence FROM benchmark"


def fitness(spark: SparkSession, d: str) -> DataFrame:
    t = read_table(spark, d, "lineitem")
    assay = F.concat(F.lit("assay_"), F.col("l_suppkey") % 7)
    pos = (F.col("l_partkey") % 32).cast("int")
    f = t.select(
        assay.alias("assay"),
        F.col("l_returnflag").alias("source"),
        F.translate(F.md5(assay), HEX, HEX_BASES).alias("wt"),
        pos.alias("pos"),
        F.translate(F.substring(F.md5(assay), pos + 1, F.lit(1)), HEX, HEX_BASES).alias("_base"),
        F.substring(F.lit("ACGU"), (F.col("l_linenumber") % 4 + 1).cast("int"), F.lit(1)).alias("mt"),
        F.col("l_extendedprice").alias("dms_score"),
        F.col("l_orderkey").alias("k1"),
        F.col("l_linenumber").alias("k2"),
    )
    # The base is translated by itself, so that who asks for mutants alone does not translate every row's whole sequence.
    return f.withColumn("mutant", F.concat("_base", F.col("pos") + 1, "mt")).drop("_base").withColumn("sequence", F.overlay("wt", "mt", F.col("pos") + 1, F.lit(1)))


FITNESS = f"""SELECT *, substr(wt, pos + 1, 1) || (pos + 1) || mt AS mutant, substr(wt, 1, pos) || mt || substr(wt, pos + 2) AS sequence FROM (
  SELECT 'assay_' || (l_suppkey % 7) AS assay, l_returnflag AS source, translate(md5('assay_' || (l_suppkey % 7)), '{HEX}', '{HEX_BASES}') AS wt,
    CAST(l_partkey % 32 AS INTEGER) AS pos, substr('ACGU', l_linenumber % 4 + 1, 1) AS mt, l_extendedprice AS dms_score, l_orderkey AS k1, l_linenumber AS k2 FROM lineitem)"""


def hits(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("chain"), F.col("l_partkey").alias("family"), F.col("l_discount").alias("evalue"), F.col("l_extendedprice").alias("score"),
        F.col("l_linenumber").alias("pos"), F.when(F.col("l_linestatus") == "O", "!").otherwise("?").alias("flag"),
    )


HITS = "SELECT l_orderkey AS chain, l_partkey AS family, l_discount AS evalue, l_extendedprice AS score, l_linenumber AS pos, CASE WHEN l_linestatus = 'O' THEN '!' ELSE '?' END AS flag FROM lineitem"


def files(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").select(
        F.col("doc_id").alias("id"), F.col("source").alias("source_name"), F.concat("source", F.lit("/"), "doc_id", F.lit(".fa")).alias("path"),
        F.col("n_chars").alias("size_bytes"), F.when(F.col("doc_id") % 3 != 0, F.col("n_chars") % 97).alias("n_records"), (F.col("doc_id") % 2 == 0).alias("count_exact"),
    )


FILES = "SELECT doc_id AS id, source AS source_name, source || '/' || doc_id || '.fa' AS path, n_chars AS size_bytes, CASE WHEN doc_id % 3 <> 0 THEN n_chars % 97 END AS n_records, doc_id % 2 = 0 AS count_exact FROM documents"

KINDS = ("sequence", "structure", "probing", "fitness")


def sources(spark: SparkSession, d: str) -> DataFrame:
    number = F.regexp_extract("source", "([0-9]+)", 1).cast("int")
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), number % 4 + 1)
    named = read_table(spark, d, "documents").select("source").distinct().select(F.col("source").alias("name"), kind.alias("category"))
    return named.unionByName(spark.createDataFrame([("empty_source", "sequence")], "name string, category string"))


SOURCES = "SELECT DISTINCT source AS name, (['sequence', 'structure', 'probing', 'fitness'])[CAST(regexp_extract(source, '([0-9]+)', 1) AS INTEGER) % 4 + 1] AS category FROM documents UNION ALL SELECT 'empty_source', 'sequence'"


def atom(spark: SparkSession, d: str) -> DataFrame:
    """21 atoms for each residue; residues of an entry numbered by vec_id."""
    from pyspark.sql import Window

    t = read_table(spark, d, "embeddings")
    idx = (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).cast("int")
    r = t.select(F.col("label").alias("entry"), idx.alias("idx"), F.col("embedding").alias("e"))
    k = F.explode(F.sequence(F.lit(0), F.lit(20)))
    at = lambda o: (F.element_at("e", 3 * F.col("k") + o).cast("double") * 40).alias("xyz"[o - 1])
    return r.select("entry", "idx", "e", k.alias("k")).select("entry", "idx", "k", at(1), at(2), at(3))


ATOM = """SELECT entry, idx, k, 40 * CAST(e[3 * k + 1] AS DOUBLE) AS x, 40 * CAST(e[3 * k + 2] AS DOUBLE) AS y, 40 * CAST(e[3 * k + 3] AS DOUBLE) AS z FROM (
  SELECT label AS entry, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INTEGER) AS idx, embedding AS e, unnest(range(21)) AS k FROM embeddings)"""


def centre(spark: SparkSession, d: str) -> DataFrame:
    """One atom (k = 1) for each residue."""
    return atom(spark, d).where("k = 1").drop("k")


CENTRE = f"SELECT entry, idx, x, y, z FROM ({ATOM}) WHERE k = 1"


def ion(spark: SparkSession, d: str) -> DataFrame:
    """Atom 0 of every 25th residue."""
    return atom(spark, d).where("k = 0 AND idx % 25 = 3").select("entry", F.col("idx").alias("ion"), "x", "y", "z")


ION = f"SELECT entry, idx AS ion, x, y, z FROM ({ATOM}) WHERE k = 0 AND idx % 25 = 3"


def bp(spark: SparkSession, d: str) -> DataFrame:
    """Residues of an entry that are each other's nearest within 12, four places apart or more; every third has class 2."""
    from ..operators.structure import nearest_residue

    near = nearest_residue(centre(spark, d), 12.0, 4)
    other = near.select("entry", F.col("j").alias("i"), F.col("i").alias("j"))
    return near.join(other, ["entry", "i", "j"]).where("i < j").select("entry", "i", "j", F.when(F.col("i") % 3 == 0, 2).otherwise(1).alias("lw"))


_FAR = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)"
_NEAREST = f"SELECT a.entry, a.idx AS i, arg_min(b.idx, ({_FAR}, b.idx)) AS j FROM ({CENTRE}) a JOIN ({CENTRE}) b ON a.entry = b.entry AND abs(a.idx - b.idx) >= 4 WHERE {_FAR} <= 144 GROUP BY a.entry, a.idx"
BP = f"SELECT p.entry, p.i, p.j, CASE WHEN p.i % 3 = 0 THEN 2 ELSE 1 END AS lw FROM ({_NEAREST}) p JOIN ({_NEAREST}) q ON p.entry = q.entry AND p.j = q.i AND q.j = p.i WHERE p.i < p.j"


def msa(spark: SparkSession, d: str) -> DataFrame:
    """Every vector as a row of its label's alignment, a column for each component."""
    symbol = lambda x: F.substring(F.lit("ACGU-"), (F.pmod(F.floor(x.cast("double") * 8), F.lit(5)) + 1).cast("int"), F.lit(1))
    return read_table(spark, d, "embeddings").select(F.col("label").alias("family"), F.col("vec_id").alias("row_no"), F.array_join(F.transform("embedding", symbol), "").alias("aligned"))


MSA = "SELECT label AS family, vec_id AS row_no, array_to_string(list_transform(embedding, lambda x: substr('ACGU-', (CAST(floor(CAST(x AS DOUBLE) * 8) AS BIGINT) % 5 + 5) % 5 + 1, 1)), '') AS aligned FROM embeddings"


def consensus_pairs(spark: SparkSession, d: str) -> DataFrame:
    """family, i, j: bracket pairs of each family's first row, in which A opens and G closes."""
    from ..operators.structure import dot_bracket_pairs

    first = msa(spark, d).groupBy("family").agg(F.min_by("aligned", "row_no").alias("aligned"))
    return dot_bracket_pairs(first.select("family", F.translate("aligned", "ACGU-", "(.)..").alias("ss")), "family", "ss")


CONSENSUS = f"""WITH f AS (SELECT family, arg_min(aligned, row_no) AS a FROM ({MSA}) GROUP BY family), c AS (SELECT family, CAST(unnest(range(length(a))) AS INTEGER) AS pos, unnest(string_split(a, '')) AS c FROM f),
  o AS (SELECT family, pos, CASE c WHEN 'A' THEN 1 ELSE -1 END AS o FROM c WHERE c IN ('A', 'G')), d AS (SELECT *, sum(o) OVER (PARTITION BY family ORDER BY pos) AS depth FROM o),
  l AS (SELECT *, least(0, coalesce(min(depth) OVER (PARTITION BY family ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS low FROM d),
  k AS (SELECT family, pos, o, CASE WHEN o = 1 THEN depth ELSE depth + 1 END AS depth FROM l WHERE o = 1 OR depth >= low), n AS (SELECT *, row_number() OVER (PARTITION BY family, depth, o ORDER BY pos) AS nth FROM k)
  SELECT a.family, a.pos AS i, b.pos AS j FROM n a JOIN n b ON a.family = b.family AND a.depth = b.depth AND a.nth = b.nth WHERE a.o = 1 AND b.o = -1"""


def logs(spark: SparkSession, d: str) -> DataFrame:
    """Readings of a run's stage: step is the row's place by time."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return read_table(spark, d, "events").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("stage"), "ts", F.row_number().over(w).alias("step"), F.col("value").alias("metric"), F.col("event_id").alias("id"))


LOGS = "SELECT user_id AS run_id, event_type AS stage, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS step, value AS metric, event_id AS id FROM events"


def submission(spark: SparkSession, d: str) -> DataFrame:
    o, c = read_table(spark, d, "orders"), read_table(spark, d, "customer")
    p = F.col("o_totalprice")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).select(
        F.col("c_nationkey").alias("target"), F.col("o_custkey").alias("grp"), F.col("o_orderkey").alias("model"),
        (F.pmod(F.floor(p), F.lit(1000)) / 1000).alias("tm"), (F.pmod(F.floor(p / 3), F.lit(1000)) / 1000).alias("lddt"), (F.pmod(F.floor(p / 7), F.lit(400)) / 10).alias("rmsd"),
    )


SUBMISSION = """SELECT c_nationkey AS target, o_custkey AS grp, o_orderkey AS model, (CAST(floor(o_totalprice) AS BIGINT) % 1000) / 1000 AS tm,
  (CAST(floor(o_totalprice / 3) AS BIGINT) % 1000) / 1000 AS lddt, (CAST(floor(o_totalprice / 7) AS BIGINT) % 400) / 10 AS rmsd FROM orders JOIN customer ON o_custkey = c_custkey"""


def groups(spark: SparkSession, d: str) -> DataFrame:
    """Entries with a family (part brand, those of one maker together; none for every seventh) and a length."""
    l, p = read_table(spark, d, "lineitem"), read_table(spark, d, "part")
    j = l.join(p, l["l_partkey"] == p["p_partkey"]).where("l_linenumber = 1")
    return j.select(F.concat(F.lit("e"), "l_orderkey").alias("entry"), F.when(F.col("l_orderkey") % 7 != 0, F.regexp_replace("p_brand", "^Brand#1.*$", "Brand#1")).alias("family"), F.col("l_quantity").cast("long").alias("length"))


GROUPS = "SELECT 'e' || l_orderkey AS entry, CASE WHEN l_orderkey % 7 <> 0 THEN CASE WHEN p_brand LIKE 'Brand#1%' THEN 'Brand#1' ELSE p_brand END END AS family, CAST(l_quantity AS BIGINT) AS length FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber = 1"


def ladder(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "lineitem").select((F.col("l_partkey") % 50).alias("construct"), F.col("l_returnflag").alias("ion"), F.col("l_quantity").alias("conc"), F.col("l_discount").alias("reactivity"))


LADDER = "SELECT l_partkey % 50 AS construct, l_returnflag AS ion, l_quantity AS conc, l_discount AS reactivity FROM lineitem"


def motif(spark: SparkSession, d: str) -> DataFrame:
    """First letters of every eight words in a row, of all words of a text with fewer."""
    # Words' first letters are one byte each, so a signature is cut out of the bytes of them all: no list is built for a place.
    letters = F.regexp_extract_all(F.lower("text"), F.lit("([a-z])[a-z]*"), F.lit(1))
    t = read_table(spark, d, "documents").select(F.col("doc_id").alias("motif_id"), F.col("lang").alias("kind"), F.array_join(letters, "-").cast("binary").alias("w"))
    starts = F.sequence(F.lit(0), F.greatest(F.floor(F.octet_length("w") / 2) - 7, F.lit(0)).cast("int"))
    t = t.select("motif_id", "kind", "w", F.explode(starts).alias("i"))
    return t.select("motif_id", "kind", F.substring("w", 2 * F.col("i") + 1, F.lit(15)).cast("string").alias("signature"))


MOTIF = """SELECT motif_id, kind, array_to_string(w[s:s + 7], '-') AS signature FROM (SELECT motif_id, kind, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS s FROM (
  SELECT doc_id AS motif_id, lang AS kind, list_transform(regexp_extract_all(lower(text), '[a-z]+'), lambda x: substr(x, 1, 1)) AS w FROM documents))"""
