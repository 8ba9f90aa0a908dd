"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .numbering import number_within
from .words import word_count

#: Documents of a source are ordered by this many leading hex digits first: 16^3 cuts, each its own task.
CUT_DIGITS = 3
#: Groups of a few numbers each that are few enough to be sent to every task.
SMALL_GROUPS = 100_000


def source_targets(sizes: DataFrame, weights: Sequence[float] = (1, 2, 3), max_epochs: float = 3.0) -> DataFrame:
    """Words wanted from each source: source, source_size, target.

    Sources by code point (null last) take `weights` in turn and share the sum of all sizes; a
    target stops at `max_epochs` times its source's size and the excess is shared again by weight
    among the others until none is above. One row per source; each round sends three numbers to the
    driver.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    share = F.array(*[F.lit(float(w)) for w in weights])
    table = materialize(totals.withColumn("weight", F.element_at(share, (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))), "sources")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    cap = F.col("source_size") * F.lit(float(max_epochs))
    level, closed = None, -1
    while True:
        # The level rises from round to round, so a source once clamped stays clamped.
        full = F.lit(False) if level is None else F.col("weight") * F.lit(level) > cap
        clamped, size, open_weight = table.agg(F.count_if(full), F.sum(F.when(full, F.col("source_size")).otherwise(0)), F.sum(F.when(~full, F.col("weight")).otherwise(0.0))).first()
        if clamped == closed or not open_weight:
            break
        closed, level = clamped, (float(total) - float(size) * max_epochs) / open_weight
    want = F.lit(0.0) if level is None else F.least(cap, F.col("weight") * F.lit(level))
    return table.select("source", "source_size", want.alias("target"))


def mix_sources(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), max_epochs: float = 3.0, seed: int = 7, key: str = "doc_id", carry: Sequence[str] = ()) -> DataFrame:
    """How often the mix takes each document: key, size, source_size, target, repeats, taken.

    size is the text's words (null: 0). With r = target / source_size every document is taken
    floor(r) times; the fraction is a seeded order's prefix: one more copy for each document whose
    middle lies inside the first (r - floor(r)) * source_size words of its source in the order
    of md5(seed:key). So a source misses its target by at most half a document. A source of size 0
    has target 0 and gives one copy of nothing. Repeated rows and null keys or sources are ordinary.
    """
    base = docs.select(F.col(key).alias("_key"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), *carry)
    rows = materialize(base.withColumn("_order", F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("_key").cast("string"), F.lit(""))))), "sizes")
    targets = source_targets(rows, weights, max_epochs)
    cut = F.substring("_order", 1, CUT_DIGITS)
    cuts = rows.groupBy("source", cut.alias("_cut")).agg(F.sum("size").alias("_words"))
    before = Window.partitionBy("source").orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    starts = cuts.select("source", "_cut", F.coalesce(F.sum("_words").over(before), F.lit(0)).alias("_start"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(1.0))
    starts = starts.withColumnRenamed("source", "_source").join(targets, F.col("_source").eqNullSafe(F.col("source"))).withColumn("_whole", F.floor(ratio)).withColumn("_part", ratio - F.col("_whole"))
    starts = starts.select("_source", F.col("_cut").alias("_c"), "_start", "source_size", "target", "_whole", "_part")
    inside = Window.partitionBy("source", cut).orderBy("_order", "_key", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_before", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(starts, F.col("source").eqNullSafe(F.col("_source")) & (cut == F.col("_c")))
    middle = F.col("_start") + F.col("_before") + F.col("size") / 2
    extra = F.when(middle < F.col("_part") * F.col("source_size"), 1).otherwise(0)
    return placed.withColumn("repeats", (F.col("_whole") + extra).cast("int")).select(
        F.col("_key").alias(key), "source", "size", "source_size", "target", "repeats", (F.col("repeats") * F.col("size")).cast("long").alias("taken"), *carry
    )


def expand_mix(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), max_epochs: float = 3.0, seed: int = 7) -> DataFrame:
    """The mixed corpus itself: every column of `docs`, a document once for each repetition.

    Documents that the mix does not take are left out. Sizes and repetitions are found on thin rows;
    they meet the texts again by doc_id and the hash of text and source. Rows equal in all of these
    stand as often as the mix takes them together: nearly always each is taken equally often; the few groups
    that the end of a seeded order cuts in two are stored and numbered, and share their copies as evenly as can be.
    Columns keep their names and values, whatever these are; null ids, texts and sources are ordinary; an empty
    table gives no rows.
    """
    names = docs.columns
    rows = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)], F.col("doc_id").alias("_doc"), F.xxhash64("text", "source").alias("_hash"))
    thin = docs.select("doc_id", "text", "source", F.xxhash64("text", "source").alias("_hash"))
    groups = mix_sources(thin, weights, max_epochs, seed, carry=["_hash"]).groupBy("doc_id", "_hash").agg(F.min("repeats").alias("_least"), F.max("repeats").alias("_most"), F.sum("repeats").alias("_sum"), F.count("*").alias("_rows"))
    groups = materialize(groups.withColumnRenamed("doc_id", "_id").withColumnRenamed("_hash", "_h"), "repeats")
    same = F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_h"))
    even = rows.join(groups.where("_least = _most AND _most > 0"), same).withColumn("_copies", F.col("_least"))
    uneven = groups.where("_least < _most")
    if not uneven.isEmpty():
        cut = materialize(rows.join(F.broadcast(uneven) if uneven.count() <= SMALL_GROUPS else uneven, same).withColumn("_row", F.monotonically_increasing_id()), "uneven")
        numbered = number_within(cut, ["_id", "_h"], F.md5(F.col("_row").cast("string")), ["_row"], "_place")
        share = F.floor(F.col("_sum") / F.col("_rows"))
        even = even.unionByName(numbered.withColumn("_copies", (share + (F.col("_place") < F.col("_sum") - share * F.col("_rows")).cast("long")).cast("int")).select(*even.columns))
    return even.withColumn("_copy", F.explode(F.expr("CASE WHEN _copies > 0 THEN sequence(1, _copies) ELSE array() END"))).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


def oracle_sql(seed: int = 7, epochs: str = "3.0", documents: str = "documents") -> str:
    """DuckDB: the water level in closed form, then the seeded prefix of each source."""
    return f"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(length(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS o
  FROM {documents}),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST(1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS DOUBLE) AS weight FROM s),
l AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE)
             - coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * {epochs})
            / sum(weight) OVER (ORDER BY source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w),
t AS (
  SELECT source, source_size,
         least(source_size * {epochs}, weight * (SELECT arg_min(level, (source_size / weight, source)) FROM l WHERE level * weight <= source_size * {epochs})) AS target
  FROM w),
p AS (
  SELECT doc_id, size, source_size, target,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 1.0 END AS r,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY o, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size / 2 AS middle
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(r) + CASE WHEN middle < (r - floor(r)) * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM p
"""
