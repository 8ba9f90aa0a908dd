"""Queries of the audit operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audits, structure
from ..session import read_table
from . import fixtures as X
from .registry import query

LEN = f"SELECT id, chunk, lang, length(sequence) AS length FROM ({X.SEQ})"


def sized(spark, d):
    return X.seq(spark, d).select("id", "chunk", "lang", F.length("sequence").alias("length"))


@query(f"""WITH e AS (SELECT s.*, id IN (SELECT doc_id FROM labels) AS covered FROM ({LEN}) s), r AS (SELECT *, row_number() OVER (PARTITION BY covered ORDER BY length DESC, id) AS r FROM e)
  SELECT covered, count(*) AS n, CAST(sum(length) AS BIGINT) AS total, avg(length) AS mean, max(length) AS greatest, sum(length) FILTER (WHERE r <= 34) / sum(length) AS top_share FROM r GROUP BY covered""")
def coverage_character(spark, d):
    return audits.coverage_character(sized(spark, d), read_table(spark, d, "labels").select(F.col("doc_id").alias("id")), "id", "length")


@query(f"SELECT chunk, CAST(coalesce(sum(length) FILTER (WHERE lang = 'en'), 0) AS BIGINT) AS narrow, CAST(coalesce(sum(length) FILTER (WHERE lang IN ('en', 'de')), 0) AS BIGINT) AS wide, CAST(coalesce(sum(length) FILTER (WHERE lang IN ('en', 'de')), 0) - coalesce(sum(length) FILTER (WHERE lang = 'en'), 0) AS BIGINT) AS delta FROM ({LEN}) GROUP BY chunk")
def definition_sensitivity(spark, d):
    return audits.definition_sensitivity(sized(spark, d), "chunk", "length", {"narrow": F.col("lang") == "en", "wide": F.col("lang").isin("en", "de")})


@query(f"""WITH p AS (SELECT chunk || lang AS k, count(length) AS n, avg(length) AS m FROM ({LEN}) GROUP BY 1) SELECT guard, count(*) AS keys, CAST(sum(n) AS BIGINT) AS rows, round(avg(m), 8) AS mean FROM p, (SELECT CAST(unnest([1, 5, 20]) AS INTEGER) AS guard) WHERE n >= guard GROUP BY guard""")
def guard_sensitivity(spark, d):
    s = sized(spark, d).withColumn("k", F.concat("chunk", "lang"))
    return audits.guard_sensitivity(s, "k", "length", [1, 5, 20]).withColumn("mean", F.round("mean", 8))


@query(f"""WITH s AS (SELECT *, count(*) OVER (PARTITION BY chunk) AS a FROM ({LEN})), t AS (SELECT *, count(*) OVER (PARTITION BY lang) AS b FROM s WHERE a >= 20), u AS (SELECT *, count(*) OVER (PARTITION BY chunk, lang) AS c FROM t WHERE b >= 20) SELECT id FROM u WHERE c >= 8""")
def common_covered_subset(spark, d):
    s = sized(spark, d).withColumn("both", F.concat_ws("/", "chunk", "lang"))
    return audits.common_covered(audits.common_covered(s, ["chunk", "lang"], 20), ["both"], 8).select("id")


@query(f"""WITH r AS (SELECT id, chunk, row_number() OVER (PARTITION BY chunk ORDER BY md5('7:' || id), id) AS r FROM ({LEN})), s AS (SELECT count(DISTINCT chunk) AS s FROM r) SELECT id, chunk FROM r, s WHERE r <= ceil(90 / s) ORDER BY r, chunk LIMIT 90""")
def equal_share_sample(spark, d):
    return audits.equal_share_sample(sized(spark, d).select("id", "chunk"), "chunk", "id", 90)


@query(f"""SELECT id FROM ({LEN}) WHERE length > 0 ORDER BY round(-ln((CAST(CAST('0x' || substr(md5('7:' || id), 1, 13) AS BIGINT) AS DOUBLE) + 1) / 4503599627370496.0) / length, 15), id LIMIT 100""")
def weighted_sample(spark, d):
    return audits.weighted_sample(sized(spark, d).select("id", F.col("length")), "id", "length", 100).select("id")


@query(f"""WITH n AS (SELECT 'lang' AS field, lang AS value, count(*) AS n FROM ({LEN}) GROUP BY lang UNION ALL SELECT 'chunk', chunk, count(*) FROM ({LEN}) GROUP BY chunk) SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY field ORDER BY n DESC, value) <= 3""")
def value_counters(spark, d):
    return audits.value_counters(sized(spark, d), ["lang", "chunk"], 3)


MET = "SELECT doc_id AS entry, n_chars % 5000 AS length, source AS family, n_chars % 40 AS n_contacts FROM documents"


@query(f"""WITH u AS (SELECT * FROM ({MET}) WHERE length BETWEEN 32 AND 4608 AND n_contacts >= 8) SELECT count(*) AS chains, CAST(sum(length) AS BIGINT) AS residues, min(length) AS least, max(length) AS greatest, count(DISTINCT family) AS families,
  (SELECT family FROM u GROUP BY family ORDER BY count(*) DESC, family LIMIT 1) AS largest_family FROM u""")
def dataset_manifest(spark, d):
    m = read_table(spark, d, "documents").select(F.col("doc_id").alias("entry"), (F.col("n_chars") % 5000).alias("length"), F.col("source").alias("family"), (F.col("n_chars") % 40).alias("n_contacts"))
    return audits.dataset_manifest(audits.usable_chains(m), "family")


@query(f"""WITH a AS ({X.CENTRE}), c AS (SELECT DISTINCT a.entry, a.idx, b.idx AS j FROM a JOIN a b ON a.entry = b.entry AND b.idx - a.idx >= 4 WHERE (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 <= 64),
  n AS (SELECT entry, count(*) AS n FROM c GROUP BY entry), r AS (SELECT entry, count(*) AS length, avg(CAST(idx % 9 <> 4 AS DOUBLE)) AS resolved FROM a GROUP BY entry)
  SELECT r.entry, length, resolved, coalesce(n, 0) AS n_contacts, coalesce(n, 0) / length AS contacts_per_nt, length < 32 AS fragment FROM r LEFT JOIN n ON n.entry = r.entry""")
def chain_metadata(spark, d):
    c = X.centre(spark, d)
    holes = c.withColumn("x", F.when(F.col("idx") % 9 != 4, F.col("x")))
    return audits.chain_metadata(holes, structure.contacts(c, 8.0, 4))


@query(f"SELECT count(x) AS n, median(abs(x)) AS median, (quantile_cont(abs(x), 0.75) - quantile_cont(abs(x), 0.25)) / 1.349 AS sd, greatest(max(abs(x)), max(abs(y)), max(abs(z))) AS far, abs(median(abs(x)) - 3.4) <= 1 AND (quantile_cont(abs(x), 0.75) - quantile_cont(abs(x), 0.25)) / 1.349 <= 4 AND greatest(max(abs(x)), max(abs(y)), max(abs(z))) <= 256 AS ok FROM ({X.CENTRE})")
def geometry_gate(spark, d):
    return audits.geometry_gate(X.centre(spark, d).withColumn("v", F.abs("x")), "v", 3.4, 1.0, 4.0, ["x", "y", "z"])


@query("""WITH m AS (SELECT l_orderkey AS e, l_suppkey % 2 AS c, count(DISTINCT l_linenumber) AS m FROM lineitem WHERE l_returnflag <> 'R' GROUP BY ALL), u AS (SELECT l_orderkey AS e, l_suppkey % 2 AS c, count(DISTINCT l_linenumber) AS u FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL)
  SELECT coalesce(m.e, u.e) AS entry, coalesce(m.c, u.c) AS chain, coalesce(m, 0) AS n_modelled, coalesce(u, 0) AS n_missing, coalesce(u, 0) / (coalesce(m, 0) + coalesce(u, 0)) AS share FROM m FULL JOIN u ON m.e = u.e AND m.c = u.c""")
def unobserved_residues(spark, d):
    r = read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("entry"), (F.col("l_suppkey") % 2).alias("chain"), F.col("l_linenumber").alias("seq_id"), "l_returnflag")
    return audits.unobserved(r.where("l_returnflag <> 'R'"), r.where("l_returnflag = 'R'"))


@query(f"""WITH l AS ({X.LOGS}), n AS (SELECT max(ts) AS t FROM l), r AS (SELECT *, row_number() OVER (PARTITION BY run_id, stage ORDER BY step DESC) AS r FROM l)
  SELECT run_id, stage, coalesce(max(metric) FILTER (WHERE r = 1) > max(metric) FILTER (WHERE r = 2), false) AS rising, epoch(any_value(t)) - epoch(max(ts) FILTER (WHERE r = 1)) < 259200 AS live FROM r, n WHERE r <= 2 GROUP BY run_id, stage""")
def rising_counter(spark, d):
    f = X.logs(spark, d)
    return audits.rising_counter(f, "metric", F.lit(f.agg(F.max("ts")).first()[0]), 4320)
