"""Queries of the corpus, catalog and split operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import conditions as C
from ..functions import sequence as S
from ..operators import catalog, corpus, splits
from ..session import materialize, read_table
from . import fixtures as X
from .registry import query

RNA = "replace({0}, 'T', 'U')"
BANDS = [200, 500, 1500]
GC = "(length({0}) - length(replace({0}, 'G', ''))) + (length({0}) - length(replace({0}, 'C', '')))"
BAND = "CASE WHEN {0} < 200 THEN '0-200' WHEN {0} < 500 THEN '200-500' WHEN {0} < 1500 THEN '500-1500' ELSE '1500+' END"


def filtered(spark, d):
    f = X.seq(spark, d).withColumn("sequence", S.normalize_seq(F.col("sequence")))
    return corpus.annotation_filter(f, 50, 20000, drop=r"(?i)\bsrc1[0-4]/", need=r"(en|fr|de)$")


FILTERED = f"""SELECT *, CASE WHEN length(sequence) NOT BETWEEN 50 AND 20000 THEN 'length'
  WHEN regexp_matches(header, '(?i)\\bsrc1[0-4]/') THEN 'annotation' WHEN NOT regexp_matches(header, '(en|fr|de)$') THEN 'not_wanted' END AS reason
  FROM (SELECT id, chunk, lang, header, {RNA.format('upper(trim(sequence))')} AS sequence FROM ({X.SEQ}))"""
KEPT = f"SELECT * FROM ({FILTERED}) WHERE reason IS NULL QUALIFY id = min(id) OVER (PARTITION BY sequence)"


def kept(spark, d):
    """Thin rows of the kept sequences, each once."""
    thin = materialize(corpus.measured(filtered(spark, d).where("reason IS NULL"), ["id", "chunk"]), "kept")
    return corpus.dedup_exact(thin, "digest", "id")


@query(f"""SELECT chunk, count(*) AS n, median(length(sequence)) AS median_length, avg(length(sequence)) AS mean_length,
  sum({GC.format('sequence')}) * 100.0 / sum(length(sequence)) AS gc_pct, sum(length(sequence) - length(replace(sequence, 'N', ''))) * 100.0 / sum(length(sequence)) AS n_pct,
  avg(CAST(length(sequence) < 200 AS DOUBLE)) * 100 AS pct_0_200, avg(CAST(length(sequence) >= 200 AND length(sequence) < 500 AS DOUBLE)) * 100 AS pct_200_500,
  avg(CAST(length(sequence) >= 500 AND length(sequence) < 1500 AS DOUBLE)) * 100 AS pct_500_1500, avg(CAST(length(sequence) >= 1500 AS DOUBLE)) * 100 AS pct_1500_up
  FROM ({KEPT}) GROUP BY chunk""")
def clean_corpus_profile(spark, d):
    return corpus.chunk_profile(kept(spark, d), ["chunk"], BANDS)


@query(f"SELECT coalesce(reason, 'kept') AS reason, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM ({FILTERED}) GROUP BY reason")
def filter_counters(spark, d):
    return corpus.filter_counters(filtered(spark, d))


@query(f"""WITH r AS (SELECT *, CASE WHEN reason IS NOT NULL THEN reason WHEN sequence IN (SELECT {RNA.format('sequence')} FROM ({X.BENCH_SEQ})) THEN 'already_in_corpus'
  WHEN id > min(id) OVER (PARTITION BY sequence, reason IS NULL) THEN 'duplicate' END AS why FROM ({FILTERED}))
  SELECT coalesce(why, 'kept') AS reason, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM r GROUP BY why""")
def ingest_counters(spark, d):
    """Filters, then the anti-join against a corpus, then exact duplicates: one reason for each row."""
    thin = filtered(spark, d).select("id", "reason", F.md5(F.col("sequence").cast("binary")).alias("digest"))
    known = X.bench_seq(spark, d).select(F.md5(S.normalize_seq(F.col("sequence")).cast("binary")).alias("digest"))
    return corpus.ingest_counts(materialize(thin, "thin"), known)


@query(f"SELECT chunk, count(*) AS n, min(id) AS first_id FROM ({X.SEQ}) s WHERE NOT EXISTS (SELECT 1 FROM ({X.BENCH_SEQ}) b WHERE b.sequence = s.sequence) GROUP BY chunk")
def corpus_anti_join(spark, d):
    return corpus.not_in_corpus(X.seq(spark, d), X.bench_seq(spark, d), "sequence").groupBy("chunk").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query(f"""SELECT lang, symbol, n, n / al AS share FROM (
  SELECT lang, unnest(['A','C','G','T','U','N']) AS symbol, sum(length(sequence)) AS al,
    unnest([{', '.join(f"sum(length(sequence) - length(replace(sequence, '{c}', '')))" for c in 'ACGTUN')}]) AS n FROM ({X.SEQ}) GROUP BY lang) WHERE n > 0""")
def base_composition(spark, d):
    return corpus.composition(X.seq(spark, d), ["lang"])


@query(f"""WITH l AS (SELECT chunk, length(sequence) AS length FROM ({X.SEQ}))
  SELECT chunk, count(*) AS sequences, sum(length) AS nucleotides, min(length) AS least, max(length) AS greatest, avg(length) AS mean,
    list_sort(list(length))[count(*) // 2 + 1] AS upper_median FROM l GROUP BY chunk""")
def corpus_length_stats(spark, d):
    return corpus.corpus_stats(X.seq(spark, d), "chunk")


@query(f"SELECT lang, count(*) AS n, max(length(sequence)) AS max_length, avg(length(sequence)) AS mean_length FROM ({X.SEQ}) GROUP BY ROLLUP (lang)")
def pooled_sample_profile(spark, d):
    return corpus.pooled_profile(X.seq(spark, d), "lang")


@query(f"""WITH p AS (SELECT chunk, chunk IN ('src0','src1','src2') AS f, avg(length(sequence)) AS mean, median(length(sequence)) AS median, quantile_cont(length(sequence), 0.1) AS p10,
    quantile_cont(length(sequence), 0.9) AS p90, sum({GC.format('sequence')}) / sum(length(sequence)) AS gc FROM ({X.SEQ}) GROUP BY chunk),
  u AS (SELECT f, unnest(['mean','median','p10','p90','gc']) AS statistic, unnest([mean, median, p10, p90, gc]) AS v FROM p),
  t AS (SELECT statistic, avg(v) FILTER (WHERE f) AS a, avg(v) FILTER (WHERE NOT f) AS b FROM u GROUP BY statistic)
  SELECT statistic, a, b, abs(a - b) / b AS relative, abs(a - b) / b < 0.10 AS close FROM t""")
def coverage_comparison(spark, d):
    return corpus.coverage_compare(X.seq(spark, d), "chunk", F.col("chunk").isin("src0", "src1", "src2"))


@query(f"""WITH h AS (SELECT lang, {BAND.format('length(sequence)')} AS band, count(*) AS n FROM ({X.SEQ}) GROUP BY ALL),
  q AS (SELECT band, sum(n) / sum(sum(n)) OVER () AS q FROM h GROUP BY band), p AS (SELECT lang, band, n / sum(n) OVER (PARTITION BY lang) AS p FROM h),
  k AS (SELECT DISTINCT lang FROM h)
  SELECT k.lang, sum(abs(coalesce(p, 0) - q)) / 2 AS tv FROM k CROSS JOIN q LEFT JOIN p ON p.lang = k.lang AND p.band = q.band GROUP BY k.lang""")
def length_tv_distance(spark, d):
    return corpus.tv_distance(X.seq(spark, d), "lang", BANDS)


@query(f"""WITH p AS (SELECT sequence, lang, count(*) AS n, bool_or(length(sequence) >= 500) AS long, bool_or(chunk = 'src0') AS hot FROM ({X.SEQ}) GROUP BY sequence, lang),
  w AS (SELECT sequence, count(*) AS k FROM p GROUP BY sequence)
  SELECT lang, CAST(sum(n) AS BIGINT) AS rows, count(*) AS unique_sequences, count_if(k > 1) AS shared, count_if(long) AS unique_long, count_if(hot) AS unique_hot FROM p JOIN w USING (sequence) GROUP BY lang""")
def unique_sequence_tiers(spark, d):
    return corpus.unique_tiers(X.seq(spark, d), "lang", {"long": F.length("sequence") >= 500, "hot": F.col("chunk") == "src0"})


@query(f"SELECT chunk, id FROM ({X.SEQ}) QUALIFY row_number() OVER (PARTITION BY chunk ORDER BY id) <= 5")
def head_sample(spark, d):
    return corpus.head_sample(X.seq(spark, d).select("chunk", "id"), ["chunk"], ["id"], 5)


@query(f"""WITH n AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS r, count(*) OVER () AS t FROM ({X.SEQ})), s AS (SELECT *, greatest(1, t // 64) AS step FROM n)
  SELECT id FROM s WHERE r % step = 0 AND r // step < 64""")
def stride_sample(spark, d):
    return corpus.stride_sample(X.seq(spark, d).select("id"), "id", 64)


@query(f"SELECT chunk, id FROM ({X.SEQ}) QUALIFY row_number() OVER (PARTITION BY chunk ORDER BY md5('7:' || id), id) <= 10")
def reservoir_sample(spark, d):
    return corpus.hash_sample(X.seq(spark, d).select("chunk", "id"), ["chunk"], "id", 10)


@query(f"""WITH n AS (SELECT lang, id, row_number() OVER (PARTITION BY lang ORDER BY id) - 1 AS r, count(*) OVER (PARTITION BY lang) AS t FROM ({X.SEQ})),
  w AS (SELECT lang, unnest(list_transform(range(20), lambda i: CAST(floor(i * (t - 1) / 19) AS BIGINT))) AS r FROM (SELECT DISTINCT lang, t FROM n))
  SELECT DISTINCT lang, id FROM n JOIN w USING (lang, r)""")
def even_subsample(spark, d):
    return corpus.even_subsample(X.seq(spark, d).select("lang", "id"), ["lang"], "id", 20)


@query(f"""WITH b AS (SELECT id, {BAND.format('length(sequence)')} AS band FROM ({X.SEQ})),
  n AS (SELECT band, greatest(1, CAST(round_even(100.0 * count(*) / sum(count(*)) OVER (), 0) AS BIGINT)) AS need FROM b GROUP BY band)
  SELECT id, band, need FROM b JOIN n USING (band) QUALIFY row_number() OVER (PARTITION BY band ORDER BY md5('7:' || id), id) <= need""")
def stratified_sample(spark, d):
    return corpus.stratified_sample(X.seq(spark, d), BANDS, 100, "id").select("id", "band", "need")


@query(f"""WITH s AS (SELECT DISTINCT lang, chunk FROM ({X.SEQ})) SELECT lang, chunk FROM s
  QUALIFY row_number() OVER (PARTITION BY lang ORDER BY chunk DESC) <= 3 AND count(*) OVER (PARTITION BY lang) > 3""")
def heldout_shards(spark, d):
    return corpus.heldout_shards(X.seq(spark, d), "lang", "chunk", 3)


@query(f"""WITH s AS (SELECT chunk, row_number() OVER (ORDER BY chunk) - 1 AS s FROM (SELECT DISTINCT chunk FROM ({X.SEQ})))
  SELECT id, chunk, s // 4 AS cycle, s % 4 AS place, row_number() OVER (PARTITION BY chunk ORDER BY id) - 1 AS turn FROM ({X.SEQ}) JOIN s USING (chunk)""")
def interleave_shards(spark, d):
    return corpus.interleave(X.seq(spark, d).select("id", "chunk"), "chunk", "id", 4).select("id", "chunk", "cycle", "place", "turn")


@query(f"""SELECT id, split_part(header, ' ', 1) AS record, translate(sequence, 'Tt', 'Uu') AS rna, regexp_full_match({RNA.format('sequence')}, '[ACGUN]*') AS valid,
  CAST(ceil(length(sequence) / 64) * 64 AS BIGINT) AS padded, {BAND.format('length(sequence)')} AS band FROM ({X.SEQ})""")
def sequence_columns(spark, d):
    s = F.col("sequence")
    return X.seq(spark, d).select("id", S.record_id(F.col("header")).alias("record"), S.t2u(s).alias("rna"), S.valid_alphabet(S.normalize_seq(s)).alias("valid"), S.quantized_length(F.length(s), 64).alias("padded"), S.length_band(F.length(s), BANDS).alias("band"))


@query()
def masked_spans(spark, d):
    """Span corruption of the whole corpus: per chunk, symbols, masked and replaced ones."""
    f = X.seq(spark, d).withColumn("sequence", S.normalize_seq(F.col("sequence"))).withColumn("m", S.span_mask(F.col("sequence"), F.col("id")))
    return f.groupBy("chunk").agg(F.sum(F.length("sequence")).alias("symbols"), F.sum(S.symbol_count(F.col("m"), "#")).alias("masked"), F.count_if(F.length("m") == F.length("sequence")).alias("same_length"))


# --- catalog

UNITS = {"sequence": "sequences", "structure": "entries", "probing": "profiles", "fitness": "variants"}


@query(f"""SELECT s.name, s.category, count(f.id) AS n_files, CAST(coalesce(sum(f.size_bytes), 0) AS BIGINT) AS total_bytes
  FROM ({X.SOURCES}) s LEFT JOIN ({X.FILES}) f ON f.source_name = s.name GROUP BY s.name, s.category""")
def catalog_summary(spark, d):
    return catalog.summary(X.sources(spark, d), X.files(spark, d))


@query(f"""SELECT category, count(*) AS n_files, CAST(sum(n_records) AS BIGINT) AS records, CASE category WHEN 'sequence' THEN 'sequences' WHEN 'structure' THEN 'entries' WHEN 'probing' THEN 'profiles' ELSE 'variants' END AS unit
  FROM ({X.FILES}) f JOIN ({X.SOURCES}) s ON f.source_name = s.name WHERE n_records IS NOT NULL GROUP BY category""")
def record_counts_by_category(spark, d):
    return catalog.record_counts(X.sources(spark, d), X.files(spark, d), UNITS)


@query(f"SELECT CAST(coalesce(sum(n_records), 0) AS BIGINT) AS total FROM ({X.FILES}) f JOIN ({X.SOURCES}) s ON f.source_name = s.name WHERE category = 'sequence'")
def total_sequences(spark, d):
    return catalog.total_records(X.sources(spark, d), X.files(spark, d))


@query(f"SELECT source_name, CAST(sum(size_bytes) AS BIGINT) AS bytes, count(*) AS n FROM ({X.FILES}) GROUP BY source_name")
def bytes_by_source(spark, d):
    return catalog.bytes_by_source(X.files(spark, d))


@query(f"SELECT path, source_name, n_records, count_exact FROM ({X.FILES}) WHERE source_name = 'src3'")
def counts_of_source(spark, d):
    return X.files(spark, d).where("source_name = 'src3'").select("path", "source_name", "n_records", "count_exact")


@query(f"""SELECT source_name, count(*) AS n, count_if(e) AS exact, CAST(sum(r) AS BIGINT) AS records FROM (
  SELECT source_name, CASE WHEN id % 5 = 0 THEN id * 2 ELSE n_records END AS r, id % 5 = 0 OR count_exact AS e FROM ({X.FILES})) GROUP BY source_name""")
def upsert_exact_counts(spark, d):
    f = X.files(spark, d)
    exact = f.where("id % 5 = 0").select("path", (F.col("id") * 2).alias("exact_records"))
    return catalog.with_exact_counts(f, exact).groupBy("source_name").agg(F.count("*").alias("n"), F.count_if("count_exact").alias("exact"), F.sum("n_records").alias("records"))


@query(f"""SELECT s.name, f.n_files, f.total_bytes, f.first_path FROM ({X.SOURCES}) s LEFT JOIN (
  SELECT source_name, count(*) AS n_files, CAST(sum(size_bytes) AS BIGINT) AS total_bytes, min(path) AS first_path FROM ({X.FILES}) GROUP BY source_name) f ON s.name = f.source_name""")
def manifest_rows(spark, d):
    m = catalog.manifest(X.sources(spark, d), X.files(spark, d))
    return m.select("name", F.when(F.col("files").isNotNull(), F.size("files")).cast("long").alias("n_files"), "total_bytes", F.element_at("files", 1)["path"].alias("first_path"))


@query(f"""SELECT source_name, state, count(*) AS n, CAST(sum(size_bytes) AS BIGINT) AS bytes, array_to_string(list_sort(list(path))[1:4], ' ') AS first_paths FROM (
  SELECT *, CASE WHEN id % 11 = 0 THEN 'missing' WHEN id % 7 = 0 THEN 'resized' ELSE 'ok' END AS state FROM ({X.FILES})) GROUP BY source_name, state""")
def data_presence(spark, d):
    f = X.files(spark, d)
    now = f.where("id % 11 <> 0").withColumn("size_bytes", F.when(F.col("id") % 7 == 0, F.col("size_bytes") + 1).otherwise(F.col("size_bytes")))
    return catalog.presence(f, now).withColumn("first_paths", F.array_join("first_paths", " "))


@query(f"""WITH m AS (SELECT source_name, count(*) AS documented, count(n_records) AS measured FROM ({X.FILES}) GROUP BY source_name),
  g AS (SELECT source_name, documented, decision, CASE WHEN source_name IN ('src1', 'src2') THEN 0 ELSE measured END AS measured FROM (SELECT *, CASE WHEN source_name = 'src2' THEN 'not needed' END AS decision FROM m))
  SELECT source_name, documented, measured, CASE WHEN decision IS NOT NULL AND measured = 0 THEN 'decided' WHEN measured = 0 THEN 'MISSING' WHEN measured < 0.85 * documented THEN 'partial' ELSE 'present' END AS status FROM g""")
def inventory_gap(spark, d):
    f = X.files(spark, d)
    doc = f.groupBy("source_name").agg(F.count("*").alias("documented")).withColumn("decision", F.when(F.col("source_name") == "src2", "not needed"))
    got = f.where("source_name NOT IN ('src1', 'src2')").groupBy("source_name").agg(F.count("n_records").alias("measured"))
    return catalog.inventory_gap(doc, got, "source_name")


@query("""WITH m AS (SELECT 'documents' AS metric, CAST(count(*) AS DOUBLE) AS value FROM documents UNION ALL SELECT 'mean_chars', avg(n_chars) FROM documents UNION ALL SELECT 'share_en', avg(CAST(lang = 'en' AS DOUBLE)) FROM documents),
  e AS (SELECT * FROM (VALUES ('documents', '1000', 0.0), ('mean_chars', '2410', 0.0), ('share_en', '0.62', 0.005), ('unknown', '3.5', 0.05)) t(metric, expected, tol))
  SELECT e.metric, value, expected, value - CAST(expected AS DOUBLE) AS delta, coalesce(abs(value - CAST(expected AS DOUBLE)) <= tol + 1e-12, false) AS ok FROM e LEFT JOIN m USING (metric)""")
def expectations_check(spark, d):
    t = read_table(spark, d, "documents")
    one = t.agg(F.count("*").cast("double").alias("documents"), F.avg("n_chars").alias("mean_chars"), F.avg((F.col("lang") == "en").cast("double")).alias("share_en"))
    measured = one.unpivot([], ["documents", "mean_chars", "share_en"], "metric", "value")
    expected = spark.createDataFrame([("documents", "1000"), ("mean_chars", "2410"), ("share_en", "0.62"), ("unknown", "3.5")], "metric string, expected string")
    return catalog.expectations(measured, expected)


META = "SELECT o_orderkey AS id, o_orderpriority AS method, CASE WHEN o_totalprice > 50000 THEN o_totalprice / 40000 END AS resolution, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 60 END AS clashscore FROM orders"


def meta(spark, d):
    return read_table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("method"), F.when(F.col("o_totalprice") > 50000, F.col("o_totalprice") / 40000).alias("resolution"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderkey") % 60).alias("clashscore"))


@query(f"""WITH g AS (SELECT coalesce(method, 'all') AS stratum, avg(CAST(resolution IS NOT NULL AS DOUBLE)) AS a, avg(CAST(clashscore IS NOT NULL AS DOUBLE)) AS b FROM ({META}) GROUP BY ROLLUP (method))
  SELECT stratum, unnest(['resolution', 'clashscore']) AS field, unnest([a, b]) AS share FROM g""")
def metadata_completeness(spark, d):
    return catalog.completeness(meta(spark, d), ["resolution", "clashscore"], "method")


@query(f"""SELECT method, count(*) AS n, count_if(resolution <= 4) AS within_4, count_if(resolution <= 2.5) AS within_2_5, count_if(resolution <= 2) AS within_2, median(resolution) AS median_resolution,
  avg(CASE WHEN clashscore IS NULL THEN 0.8 WHEN clashscore < 10 THEN 1.0 WHEN clashscore < 20 THEN 0.8 WHEN clashscore < 40 THEN 0.55 ELSE 0.3 END) AS mean_weight FROM ({META}) GROUP BY method""")
def structure_quality_summary(spark, d):
    r = F.col("resolution")
    return meta(spark, d).groupBy("method").agg(F.count("*").alias("n"), F.count_if(r <= 4).alias("within_4"), F.count_if(r <= 2.5).alias("within_2_5"), F.count_if(r <= 2).alias("within_2"), F.median(r).alias("median_resolution"), F.avg(C.clash_weight(F.col("clashscore"))).alias("mean_weight"))


@query(f"""WITH a AS (SELECT lower('E' || id) AS pdb, resolution, method FROM ({META}) WHERE id % 3 <> 0), b AS (SELECT lower('e' || id) AS pdb, resolution * 2 AS resolution, clashscore FROM ({META}) WHERE id % 3 <> 1)
  SELECT coalesce(b.pdb, a.pdb) AS pdb, coalesce(b.resolution, a.resolution) AS resolution, a.method, b.clashscore FROM a FULL JOIN b ON a.pdb = b.pdb""")
def entry_metadata_merge(spark, d):
    m = meta(spark, d)
    a = m.where("id % 3 <> 0").select(F.concat(F.lit("E"), "id").alias("pdb"), "resolution", "method")
    b = m.where("id % 3 <> 1").select(F.concat(F.lit("e"), "id").alias("pdb"), (F.col("resolution") * 2).alias("resolution"), "clashscore")
    return catalog.overlay(a, b, "pdb")


def _bits(f: str) -> str:
    c = f"SELECT CAST({f} AS VARCHAR) AS v, count(*) AS n FROM orders_view GROUP BY 1"
    return f"""SELECT '{f}' AS field, count(v) AS classes, sum(n) FILTER (WHERE v IS NOT NULL) / sum(n) AS coverage,
      log2(sum(n) FILTER (WHERE v IS NOT NULL)) - sum(n * log2(n)) FILTER (WHERE v IS NOT NULL) / sum(n) FILTER (WHERE v IS NOT NULL) AS entropy FROM ({c})"""


@query(f"""WITH orders_view AS ({META}), u AS ({_bits('method')} UNION ALL {_bits('clashscore')})
  SELECT field, classes, coverage, entropy, CASE WHEN classes > 1 THEN entropy / log2(classes) * coverage ELSE 0 END AS efficiency FROM u""")
def attribute_bits(spark, d):
    return catalog.attribute_bits(meta(spark, d), ["method", "clashscore"])


# --- splits

H = "md5(header)"
MOD = f"(((CAST('0x' || substr({H}, 1, 16) AS UBIGINT) % 100) * 16 + CAST('0x' || substr({H}, 17, 16) AS UBIGINT) % 100) % 100)"


@query(f"SELECT id, CASE WHEN {MOD} < 80 THEN 'train' WHEN {MOD} < 90 THEN 'validation' ELSE 'test' END AS split FROM ({X.SEQ})")
def hash_split_md5(spark, d):
    return X.seq(spark, d).select("id", splits.hash_split(F.col("header")).alias("split"))


FRACTION = "CAST(CAST('0x' || substr(sha1('fitness:' || {0}), 1, 16) AS UBIGINT) AS DOUBLE) / 18446744073709551616.0"


@query(f"SELECT id, CASE WHEN chunk = 'src4' THEN 'transfer' WHEN {FRACTION.format('sequence')} < 0.2 THEN 'val' ELSE 'train' END AS split FROM ({X.SEQ})")
def salted_split_with_transfer(spark, d):
    s = X.seq(spark, d)
    return s.select("id", splits.transfer_holdout(splits.salted_split("fitness", F.col("sequence")), F.col("chunk"), "src4").alias("split"))


@query(f"""WITH g AS (SELECT coalesce(family, 'entry:' || entry) AS "group", CAST(sum(length) AS BIGINT) AS size FROM ({X.GROUPS}) GROUP BY 1),
  o AS (SELECT *, size > 0.05 * sum(size) OVER () AS big FROM g)
  SELECT "group", size, big AS oversized FROM o""")
def family_groups(spark, d):
    return splits.family_groups(X.groups(spark, d))


_G = f"""SELECT *, size > 0.05 * sum(size) OVER () AS big FROM (SELECT coalesce(family, 'entry:' || entry) AS "group", CAST(sum(length) AS BIGINT) AS size FROM ({X.GROUPS}) GROUP BY 1)"""
# Tenths of residues, so that shares of 0.6 and 0.2 are whole numbers.
SPLIT = f"""WITH RECURSIVE g AS MATERIALIZED ({_G}), t AS (SELECT CAST(sum(size) AS BIGINT) AS total, CAST(coalesce(sum(size) FILTER (WHERE big), 0) AS BIGINT) AS b FROM g),
  o AS MATERIALIZED (SELECT "group", size, row_number() OVER (ORDER BY size DESC, substr(sha256('0:' || "group"), 1, 16), "group") AS k FROM g WHERE NOT big),
  f AS (SELECT CAST(0 AS BIGINT) AS k, CAST('' AS VARCHAR) AS "group", CAST(0 AS BIGINT) AS size, 6 * total - 10 * b AS a, 2 * total AS v, 2 * total AS e, '' AS split FROM t UNION ALL
    SELECT o.k, o."group", o.size, CASE WHEN a >= v AND a >= e THEN a - 10 * o.size ELSE a END, CASE WHEN v > a AND v >= e THEN v - 10 * o.size ELSE v END, CASE WHEN e > a AND e > v THEN e - 10 * o.size ELSE e END,
      CASE WHEN a >= v AND a >= e THEN 'train' WHEN v >= e THEN 'val' ELSE 'test' END FROM f JOIN o ON o.k = f.k + 1)
  SELECT "group", size, split FROM f WHERE k > 0 UNION ALL SELECT "group", size, 'train' FROM g WHERE big"""


@query(SPLIT)
def family_disjoint_split(spark, d):
    return splits.family_disjoint_split(X.groups(spark, d))


BIG = f"""SELECT family, entry, row_number() OVER (PARTITION BY family ORDER BY sha256('0/ribo/' || entry), entry) AS r, count(*) OVER (PARTITION BY family) AS n FROM (SELECT DISTINCT family, entry FROM ({X.GROUPS}) WHERE family IN (
  SELECT "group" FROM (SELECT coalesce(family, 'entry:' || entry) AS "group", sum(length) AS size FROM ({X.GROUPS}) GROUP BY 1) QUALIFY size > 0.05 * sum(size) OVER ()))"""


@query(f"SELECT family, entry FROM ({BIG}) WHERE r <= greatest(1, round_even(n * 0.2, 0))")
def entry_holdout_in_giants(spark, d):
    return splits.entry_holdout(X.groups(spark, d))


@query(f"""WITH s AS ({SPLIT}), h AS (SELECT family, entry FROM ({BIG}) WHERE r <= greatest(1, round_even(n * 0.2, 0)))
  SELECT x.entry, x.family, CASE WHEN h.entry IS NOT NULL THEN 'test_ribosomal' ELSE s.split END AS split FROM (SELECT DISTINCT entry, family FROM ({X.GROUPS})) x JOIN s ON s."group" = coalesce(x.family, 'entry:' || x.entry) LEFT JOIN h ON h.family = x.family AND h.entry = x.entry""")
def resplit_entries(spark, d):
    """Every entry's split from the metadata alone; a fifth of each giant family is held out."""
    return splits.resplit(X.groups(spark, d))


@query(f"""SELECT 'sequence' AS key, count(*) AS leaks FROM (SELECT sequence FROM ({X.BENCH_SEQ}) INTERSECT SELECT sequence FROM ({X.SEQ}))
  UNION ALL SELECT 'id', count(*) FROM (SELECT id FROM ({X.BENCH_SEQ}) INTERSECT SELECT id FROM ({X.SEQ}))""")
def leak_guard(spark, d):
    return splits.leak_guard(X.bench_seq(spark, d), X.seq(spark, d), ["sequence", "id"])


@query(f"""WITH s AS (SELECT sequence, CASE WHEN {MOD} < 80 THEN 'train' WHEN {MOD} < 90 THEN 'validation' ELSE 'test' END AS split FROM ({X.SEQ}))
  SELECT md5(sequence) AS sequence, count(DISTINCT split) AS splits FROM s GROUP BY s.sequence HAVING count(DISTINCT split) > 1""")
def sequences_in_several_splits(spark, d):
    s = X.seq(spark, d).withColumn("split", splits.hash_split(F.col("header")))
    return splits.in_several_splits(s, "sequence").select(F.md5("sequence").alias("sequence"), "splits")


@query(f"""SELECT substr(sha1(array_to_string(list_sort(list(DISTINCT lang || ':' || chunk)), chr(10))), 1, 8) AS digest, count(DISTINCT lang || ':' || chunk) AS n FROM ({X.SEQ})""")
def composition_digest(spark, d):
    return splits.digest(X.seq(spark, d), ["lang", "chunk"])


@query(f"""WITH h AS (SELECT lang, sha1(id || chr(9) || sequence) AS h FROM ({X.SEQ})),
  p AS (SELECT lang, substr(h, 1, 2) AS p, count(*) AS n, sha1(array_to_string(list_sort(list(h)), '')) AS dg FROM h GROUP BY ALL)
  SELECT lang, CAST(sum(n) AS BIGINT) AS rows, sha1(array_to_string(list_sort(list(p || ':' || dg)), '')) AS digest FROM p GROUP BY lang""")
def content_digest(spark, d):
    return splits.content_digest(X.seq(spark, d), "lang", F.concat_ws("\t", F.col("id").cast("string"), "sequence"))


@query(f"SELECT CASE WHEN {MOD} < 80 THEN 'train' WHEN {MOD} < 90 THEN 'validation' ELSE 'test' END AS split, count(*) AS rows, CAST(sum(length(sequence)) AS BIGINT) AS residues FROM ({X.SEQ}) GROUP BY 1")
def split_summary(spark, d):
    s = X.seq(spark, d).withColumn("length", F.length("sequence")).withColumn("split", splits.hash_split(F.col("header")))
    return splits.split_summary(s)


@query(f"SELECT chunk FROM ({X.SEQ}) UNION SELECT 'src' || item_id FROM benchmark")
def union_ids(spark, d):
    b = read_table(spark, d, "benchmark").select(F.concat(F.lit("src"), "item_id").alias("chunk"))
    return X.seq(spark, d).select("chunk").union(b).distinct()


@query(f"SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def unlabelled_ids(spark, d):
    return read_table(spark, d, "documents").select("doc_id").subtract(read_table(spark, d, "labels").select("doc_id"))
