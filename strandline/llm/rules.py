"""Quality rules by distribution divergence (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import discard, materialize
from .words import words_of

#: Character classes in this order; what is left of the text is punctuation.
CLASSES = ("lower", "upper", "digit", "space", "symbol", "other_script", "punctuation")
#: Places that fit beside a hash in a long; longer texts are compared in full at once.
PLACE_BITS = 21
#: Common words that are learnt for a language, and languages whose references are sent to every task.
COMMON, SMALL_TABLE = 30, 10_000


def _to_tasks(table: DataFrame) -> DataFrame:
    """A stored table of a row of fixed width per language, broadcast if there are not too many."""
    return F.broadcast(table) if table.count() <= SMALL_TABLE else table


def common_words(docs: DataFrame, size: int = COMMON) -> DataFrame:
    """Per language (null is one of its own) its `size` most frequent words, lower case, over all its texts: an array,
    most frequent first, ties by code point; and the length of the longest."""
    words = docs.select(F.col("lang").cast("string").alias("_of"), F.explode(words_of(F.col("text").cast("string"))).alias("_w"))
    counts = words.groupBy("_of", F.lower("_w").alias("_w")).agg(F.count("*").alias("_n"))
    best = Window.partitionBy("_of").orderBy(F.desc("_n"), "_w")
    top = counts.withColumn("_place", F.row_number().over(best)).where(F.col("_place") <= size)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_place", "_w"))), lambda x: x["_w"])
    return top.groupBy("_of").agg(listed.alias("_listed"), F.max(F.length("_w")).alias("_longest"))


def features(docs: DataFrame, common: DataFrame, key: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """Counts of each text that the rules need, `common_words` among them; texts themselves are left behind."""
    words = words_of(F.col("_text"))
    df = docs.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_x_{c}") for c in carry], F.col("lang").cast("string").alias("_lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    df = df.join(_to_tasks(common), F.col("_lang").eqNullSafe(F.col("_of")), "left")
    df = df.withColumn("_words", words).withColumn("n_words", F.size("_words").cast("long"))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("_lines", lines).withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    # Each step strips one class, so that later steps run over short rests.
    rest = F.col("_text")
    for name, pattern in (("lower", "[a-z]+"), ("space", r"[\x20\x09-\x0D]+"), ("upper", "[A-Z]+"), ("digit", "[0-9]+"), ("symbol", "[#*$%&|<>]+"), ("other_script", r"[^\x00-\x7F]+")):
        df = df.withColumn(f"_after_{name}", F.regexp_replace(rest, pattern, "")).withColumn(f"_c_{name}", F.length(rest) - F.length(f"_after_{name}"))
        rest = F.col(f"_after_{name}")
    df = df.withColumn("_c_punctuation", F.length(rest)).withColumn("n_symbols", F.col("_c_symbol").cast("long"))
    df = df.withColumn("word_chars", (F.length("_text") - F.col("_c_space")).cast("long"))
    df = df.withColumn("_classes", F.array(*[F.col(f"_c_{c}").cast("double") for c in CLASSES]))
    # Windows of three words: hash and place in one long, sorted; neighbours of equal hash are then compared as words.
    df = df.withColumn(
        "_packed",
        F.expr(
            f"""CASE WHEN n_words < 3 THEN array() WHEN n_words > {1 << PLACE_BITS} THEN transform(sequence(0L, n_words - 3), i -> i)
            ELSE sort_array(transform(sequence(0, CAST(n_words AS INT) - 3), i ->
              shiftleft(shiftright(xxhash64(_words[i], _words[i + 1], _words[i + 2]), {PLACE_BITS}), {PLACE_BITS}) | CAST(i AS BIGINT))) END"""
        ),
    )
    df = df.withColumn(
        "_places",
        F.expr(
            f"""CASE WHEN n_words > {1 << PLACE_BITS} THEN _packed ELSE transform(filter(_packed, (x, k) ->
              (CASE WHEN k > 0 THEN shiftright(_packed[k - 1], {PLACE_BITS}) = shiftright(x, {PLACE_BITS}) ELSE false END)
              OR (CASE WHEN k < size(_packed) - 1 THEN shiftright(_packed[k + 1], {PLACE_BITS}) = shiftright(x, {PLACE_BITS}) ELSE false END)),
              x -> x & {(1 << PLACE_BITS) - 1}L) END"""
        ),
    )
    df = df.withColumn("_windows", F.expr("array_sort(transform(_places, p -> struct(concat_ws(' ', _words[CAST(p AS INT)], _words[CAST(p AS INT) + 1], _words[CAST(p AS INT) + 2]) AS s, p AS p)))"))
    df = df.withColumn(
        "_found",
        F.expr(
            """sort_array(transform(filter(_windows, (x, k) ->
              (CASE WHEN k > 0 THEN _windows[k - 1].s = x.s ELSE false END) OR (CASE WHEN k < size(_windows) - 1 THEN _windows[k + 1].s = x.s ELSE false END)), x -> x.p))"""
        ),
    )
    df = df.withColumn("n_repeat_words", F.expr("aggregate(_found, named_struct('n', 0L, 'at', -3L), (a, p) -> named_struct('n', a.n + least(3L, p - a.at), 'at', p), a -> a.n)"))
    # Common words by number, sorted: the ends of equal stretches give their counts.
    short = F.filter("_words", lambda w: F.length(w) <= F.col("_longest"))
    numbers = F.transform(short, lambda w: F.array_position("_listed", F.lower(w)).cast("int"))
    df = df.withColumn("_numbers", F.sort_array(F.filter(numbers, lambda x: x > 0)))
    df = df.withColumn(
        "_ends",
        F.expr("filter(transform(_numbers, (x, k) -> named_struct('bin', x, 'end', k + 1, 'last', CASE WHEN k < size(_numbers) - 1 THEN _numbers[k + 1] <> x ELSE true END)), e -> e.last)"),
    )
    df = df.withColumn("_common", F.expr("transform(_ends, (e, k) -> named_struct('bin', e.bin, 'n', CAST(e.end - CASE WHEN k > 0 THEN _ends[k - 1].end ELSE 0 END AS DOUBLE)))"))
    return df.select("_key", *[f"_x_{c}" for c in carry], "_lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "_classes", "_common")


def base_failed(min_words: int = 50) -> Column:
    return (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def references(table: DataFrame) -> DataFrame:
    """Per language (null is one of its own): shares of the character classes and of the common words.

    Every text that passes the base rules counts; a language is one row of fixed width.
    """
    sound = table.where(~F.col("base_failed"))
    classes = sound.groupBy("_lang").agg(F.array(*[F.sum(F.col("_classes")[i]) for i in range(len(CLASSES))]).alias("_cs"), F.sum("n_words").alias("_nw"))
    words = sound.select("_lang", F.explode("_common").alias("c")).groupBy("_lang", F.col("c.bin").alias("bin")).agg(F.sum("c.n").alias("n"))
    words = words.groupBy(F.col("_lang").alias("_l")).agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("_ws"))
    joined = classes.join(words, F.col("_lang").eqNullSafe(F.col("_l")), "left")
    total = F.greatest(F.aggregate("_cs", F.lit(0.0), lambda a, x: a + x), F.lit(1.0))
    bins = F.sequence(F.lit(1), F.lit(COMMON))
    share = F.transform(bins, lambda i: F.coalesce(F.try_element_at("_ws", i), F.lit(0.0)) / F.greatest(F.col("_nw").cast("double"), F.lit(1.0)))
    return joined.select(F.col("_lang").alias("_ref_lang"), F.transform("_cs", lambda x: x / total).alias("_ref_classes"), share.alias("_ref_common"))


def _half(p: str, q: str) -> str:
    """One bin's part of the Jensen-Shannon divergence in bits."""
    return f"(CASE WHEN {p} > 0 THEN 0.5D * {p} * log2(2.0D * {p} / ({p} + {q})) ELSE 0.0D END + CASE WHEN {q} > 0 THEN 0.5D * {q} * log2(2.0D * {q} / ({p} + {q})) ELSE 0.0D END)"


def judge(docs: DataFrame, key: str = "doc_id", carry: tuple[str, ...] = (), max_class_distance: float = 0.27, word_distance_floor: float = 0.1, word_distance_noise: float = 2.4, min_words: int = 50, min_test_words: int = 50, min_test_chars: int = 300) -> DataFrame:
    """Verdict for every row: key, counts, base_failed, class_distance, word_distance, kept.

    A document is rejected if it has under `min_words` words, if more than half of its words lie in
    repeated 3-word windows, or if its histogram of character classes (texts of `min_test_chars`
    characters or more) or of common words (`min_test_words` words or more) is further from its
    language's in Jensen-Shannon distance (base 2, so 0 to 1) than allowed: `max_class_distance`, and
    word_distance_floor + word_distance_noise / sqrt(n_words), as a short text's histogram is noisy. The references are the
    pooled histograms of all texts of that language that pass the first two rules, its common words the
    most frequent ones of all its texts; a language
    without any has none and the distances are null, which rejects nothing. Null texts have no
    words; a null lang is a language of its own; repeated rows are judged alike.
    """
    common = materialize(common_words(docs), "common")
    table = materialize(features(docs, common, key, carry).withColumn("base_failed", base_failed(min_words)), "features")
    discard(common)
    df = table.join(_to_tasks(materialize(references(table), "references")), F.col("_lang").eqNullSafe(F.col("_ref_lang")), "left")
    chars = F.greatest(F.aggregate("_classes", F.lit(0.0), lambda a, x: a + x), F.lit(1.0))
    df = df.withColumn("_p", F.transform("_classes", lambda x: x / chars)).withColumn("_total", F.greatest(F.col("n_words").cast("double"), F.lit(1.0)))
    df = df.withColumn("_js_c", F.expr(f"aggregate(arrays_zip(_p, _ref_classes), 0.0D, (a, z) -> a + {_half('z._p', 'z._ref_classes')})"))
    # Bins the text lacks add half of the reference's share each; the two rests are one more bin.
    df = df.withColumn("_seen", F.expr("transform(_common, c -> named_struct('p', c.n / _total, 'q', _ref_common[c.bin - 1]))"))
    df = df.withColumn("_p_rest", F.expr("greatest(0.0D, 1.0D - aggregate(_seen, 0.0D, (a, z) -> a + z.p))")).withColumn("_q_all", F.expr("aggregate(_ref_common, 0.0D, (a, x) -> a + x)"))
    df = df.withColumn("_q_rest", F.expr("greatest(0.0D, 1.0D - _q_all)"))
    df = df.withColumn("_js_w", F.expr(f"aggregate(_seen, 0.0D, (a, z) -> a + {_half('z.p', 'z.q')}) + 0.5D * (_q_all - aggregate(_seen, 0.0D, (a, z) -> a + z.q)) + {_half('_p_rest', '_q_rest')}"))
    df = df.withColumn("class_distance", F.sqrt(F.greatest(F.col("_js_c"), F.lit(0.0)))).withColumn("word_distance", F.sqrt(F.greatest(F.col("_js_w"), F.lit(0.0))))
    strange = ((F.col("_total") >= min_test_words) & (F.col("word_distance") > F.lit(word_distance_floor) + F.lit(word_distance_noise) / F.sqrt("_total"))) | ((chars >= min_test_chars) & (F.col("class_distance") > max_class_distance))
    kept = ~F.col("base_failed") & ~F.coalesce(strange, F.lit(False))
    return df.select(F.col("_key").alias(key), *[F.col(f"_x_{c}").alias(c) for c in carry], "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", kept.alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that `judge` keeps, with all their columns."""
    names = docs.columns
    rows = docs.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(names)], F.col("doc_id").alias("_doc"), F.xxhash64("text", "lang").alias("_hash"))
    judged = judge(docs.select("doc_id", "text", "lang", F.xxhash64("text", "lang").alias("hash")), carry=("hash",))
    out = judged.where(~F.col("kept")).select(F.col("doc_id").alias("_id"), F.col("hash").alias("_h")).distinct()
    left = rows.join(out, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_h")), "left_anti")
    return left.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(names)])


def oracle_sql(documents: str = "documents") -> str:
    """DuckDB: the same counts, references, distances and verdicts with the production parameters."""
    word = r"[^\x20\x09-\x0D]"

    def number(pattern: str) -> str:
        return f"length(text) - length(regexp_replace(text, '{pattern}', '', 'g'))"

    def js(p: str, q: str) -> str:
        return f"sum(CASE WHEN {p} > 0 THEN 0.5 * {p} * log2(2 * {p} / ({p} + {q})) ELSE 0 END + CASE WHEN {q} > 0 THEN 0.5 * {q} * log2(2 * {q} / ({p} + {q})) ELSE 0 END)"

    return f"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{word}+') AS w FROM {documents}),
win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
dup AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM dup) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, lang, len(w) AS n_words, length(text) AS chars, coalesce(rep.n, 0) AS n_repeat_words,
         len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{word}')))
           - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{word}')))) AS n_dup_lines,
         {number('[a-z]')} AS c1, {number('[A-Z]')} AS c2, {number('[0-9]')} AS c3, {number(r'[\x20\x09-\x0D]')} AS c4,
         {number('[#*$%&|<>]')} AS c5, {number(r'[^\x00-\x7F]')} AS c6
  FROM d LEFT JOIN rep ON d.doc_id = rep.doc_id),
b AS (SELECT *, chars - c1 - c2 - c3 - c4 - c5 - c6 AS c7, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
cl AS (SELECT doc_id, lang, base_failed, unnest(range(1, 8)) AS bin, unnest([c1, c2, c3, c4, c5, c6, c7]) AS n, greatest(chars, 1) AS total FROM b),
rc AS (SELECT lang, bin, sum(n) / greatest(sum(sum(n)) OVER (PARTITION BY lang), 1) AS q FROM cl WHERE NOT base_failed GROUP BY lang, bin),
jc AS (SELECT doc_id, {js('p', 'q')} AS js FROM (SELECT doc_id, cl.n / cl.total AS p, q FROM cl JOIN rc ON cl.lang IS NOT DISTINCT FROM rc.lang AND cl.bin = rc.bin) GROUP BY doc_id),
lo AS (SELECT doc_id, lang, lower(unnest(w)) AS word FROM d),
tw AS (SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, word) AS bin FROM lo GROUP BY lang, word QUALIFY bin <= {COMMON}),
cw AS (SELECT doc_id, bin, count(*) AS n FROM lo JOIN tw ON lo.word = tw.word AND lo.lang IS NOT DISTINCT FROM tw.lang GROUP BY doc_id, bin),
lw AS (SELECT lang, sum(n_words) AS total FROM b WHERE NOT base_failed GROUP BY lang),
bins AS (SELECT lang, greatest(total, 1) AS total, unnest(range(1, {COMMON + 1})) AS bin FROM lw),
rw AS (
  SELECT bins.lang, bins.bin, coalesce(sum(x.n), 0) / any_value(bins.total) AS q
  FROM bins LEFT JOIN (SELECT lang, bin, n FROM cw JOIN b USING (doc_id) WHERE NOT base_failed) x
    ON bins.lang IS NOT DISTINCT FROM x.lang AND bins.bin = x.bin GROUP BY bins.lang, bins.bin),
pq AS (
  SELECT b.doc_id, rw.bin, coalesce(cw.n, 0) / greatest(b.n_words, 1) AS p, q
  FROM b JOIN rw ON b.lang IS NOT DISTINCT FROM rw.lang LEFT JOIN cw ON cw.doc_id = b.doc_id AND cw.bin = rw.bin),
al AS (SELECT * FROM pq UNION ALL SELECT doc_id, 0, greatest(0, 1 - sum(p)), greatest(0, 1 - sum(q)) FROM pq GROUP BY doc_id),
jw AS (SELECT doc_id, {js('p', 'q')} AS js FROM al GROUP BY doc_id)
SELECT b.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(chars - c4 AS BIGINT) AS word_chars, CAST(c5 AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce((n_words >= 50 AND sqrt(greatest(jw.js, 0)) > 0.1 + 2.4 / sqrt(n_words))
         OR (chars >= 300 AND sqrt(greatest(jc.js, 0)) > 0.27), false) AS kept
FROM b LEFT JOIN jc ON b.doc_id = jc.doc_id LEFT JOIN jw ON b.doc_id = jw.doc_id
"""
