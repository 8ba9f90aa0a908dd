"""Catalog of sources and files, and checks of what is on disk against what was written down."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def summary(sources: DataFrame, files: DataFrame) -> DataFrame:
    """Every source with n_files and total_bytes; sources without files have 0."""
    sums = files.groupBy(F.col("source_name").alias("name")).agg(F.count("id").alias("n_files"), F.sum("size_bytes").alias("total_bytes"))
    return sources.join(sums, "name", "left").select("name", "category", F.coalesce("n_files", F.lit(0)).alias("n_files"), F.coalesce("total_bytes", F.lit(0)).alias("total_bytes"))


def record_counts(sources: DataFrame, files: DataFrame, units: dict[str, str]) -> DataFrame:
    """Per category: files with a count, records, and what a record is called there."""
    unit = F.create_map(*[F.lit(x) for kv in units.items() for x in kv])
    known = files.where("n_records IS NOT NULL").join(sources.select(F.col("name").alias("source_name"), "category"), "source_name")
    return known.groupBy("category").agg(F.count("*").alias("n_files"), F.sum("n_records").alias("records")).withColumn("unit", F.coalesce(F.try_element_at(unit, F.col("category")), F.lit("records")))


def total_records(sources: DataFrame, files: DataFrame, category: str = "sequence") -> DataFrame:
    chosen = sources.where(F.col("category") == category).select(F.col("name").alias("source_name"))
    return files.join(chosen, "source_name", "left_semi").agg(F.coalesce(F.sum("n_records"), F.lit(0)).alias("total"))


def bytes_by_source(files: DataFrame) -> DataFrame:
    return files.groupBy("source_name").agg(F.sum("size_bytes").alias("bytes"), F.count("*").alias("n"))


def with_exact_counts(files: DataFrame, exact: DataFrame) -> DataFrame:
    """Counts of `exact` (path, exact_records) take the place of capped ones, and are marked exact."""
    joined = files.join(exact, "path", "left")
    return joined.withColumn("count_exact", F.col("exact_records").isNotNull() | F.col("count_exact")).withColumn("n_records", F.coalesce("exact_records", "n_records")).drop("exact_records")


def manifest(sources: DataFrame, files: DataFrame) -> DataFrame:
    """One nested row per source: name, files in order of path (a source's files are one list), totals."""
    listed = files.groupBy(F.col("source_name").alias("name")).agg(F.array_sort(F.collect_list(F.struct("path", "size_bytes", "n_records", "count_exact"))).alias("files"), F.sum("size_bytes").alias("total_bytes"))
    return sources.join(listed, "name", "left")


def presence(expected: DataFrame, actual: DataFrame, examples: int = 4) -> DataFrame:
    """source_name, state (ok, resized, missing), n, bytes, first_paths: the first few paths in order."""
    joined = expected.join(actual.select("path", F.col("size_bytes").alias("_now")), "path", "left")
    state = F.when(F.col("_now").isNull(), "missing").when(F.col("_now") == F.col("size_bytes"), "ok").otherwise("resized")
    rows = joined.select("source_name", state.alias("state"), "path", "size_bytes")
    keys = ["source_name", "state"]
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy("path"))
    few = rows.withColumn("_rn", rn).where(F.col("_rn") <= examples).groupBy(*keys).agg(F.array_sort(F.collect_list("path")).alias("first_paths"))
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes")).join(few, keys)


def inventory_gap(documented: DataFrame, measured: DataFrame, key: str, share: float = 0.85) -> DataFrame:
    """documented count against measured: MISSING, decided, partial (under `share`) or present."""
    joined = documented.join(measured, key, "left")
    m = F.coalesce("measured", F.lit(0))
    status = F.when(F.col("decision").isNotNull() & (m == 0), "decided").when(m == 0, "MISSING").when(m < share * F.col("documented"), "partial").otherwise("present")
    return joined.select(key, "documented", m.alias("measured"), status.alias("status"))


def expectations(measured: DataFrame, expected: DataFrame) -> DataFrame:
    """metric, value, expected (text), delta, ok. The tolerance follows from how the expected value was written:
    whole numbers are exact, decimals allow half of their last place."""
    e = F.col("expected")
    decimals = F.when(F.contains(e, F.lit(".")), F.length(e) - F.instr(e, ".")).otherwise(0)
    tolerance = F.when(decimals > 0, 0.5 * F.pow(F.lit(10.0), -decimals)).otherwise(0.0)
    joined = expected.join(measured, "metric", "left")
    delta = F.col("value") - e.try_cast("double")
    return joined.select("metric", "value", "expected", delta.alias("delta"), F.coalesce(F.abs(delta) <= tolerance + 1e-12, F.lit(False)).alias("ok"))


def completeness(df: DataFrame, fields: Sequence[str], stratum: str) -> DataFrame:
    """stratum (null: all), field, share of rows where it is known."""
    sums = df.rollup(stratum).agg(F.grouping(stratum).alias("_g"), *[F.avg(F.col(f).isNotNull().cast("double")).alias(f) for f in fields])
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("share")) for f in fields]))
    return sums.select(F.when(F.col("_g") == 1, "all").otherwise(F.col(stratum).cast("string")).alias("stratum"), rows.alias("r")).select("stratum", "r.*")


def attribute_bits(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """field, classes, coverage, entropy (bits), efficiency (entropy over log2 classes, times coverage)."""
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]))
    counts = df.select(rows.alias("r")).select("r.*").groupBy("field", "value").agg(F.count("*").alias("n"))
    known = F.when(F.col("value").isNotNull(), F.col("n"))
    sums = counts.groupBy("field").agg(F.count("value").alias("classes"), F.sum("n").alias("_all"), F.sum(known).alias("_known"), F.sum(known * F.log2("n")).alias("_nlogn"))
    coverage = F.col("_known") / F.col("_all")
    entropy = F.log2("_known") - F.col("_nlogn") / F.col("_known")
    return sums.select("field", "classes", coverage.alias("coverage"), entropy.alias("entropy"), F.when(F.col("classes") > 1, entropy / F.log2("classes") * coverage).otherwise(0.0).alias("efficiency"))


def upsert_guard(df: DataFrame, what: str) -> DataFrame:
    """`df`, or an error when it has no row: a catalog is never rebuilt from nothing."""
    if df.isEmpty():
        raise ValueError(f"no {what} found; the catalog stays as it is")
    return df


def overlay(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Full outer join by lower-cased key; the second table's known fields lie over the first's."""
    a = first.select(F.lower(key).alias("_a"), *[F.col(c).alias(f"_a_{c}") for c in first.columns if c != key])
    b = second.select(F.lower(key).alias("_b"), *[F.col(c).alias(f"_b_{c}") for c in second.columns if c != key])
    out: list[Column] = [F.coalesce("_b", "_a").alias(key)]
    for c in dict.fromkeys([*first.columns, *second.columns]):
        if c != key:
            out.append(F.coalesce(*[F.col(f"_{side}_{c}") for side, t in (("b", second), ("a", first)) if c in t.columns]).alias(c))
    return a.join(b, F.col("_a") == F.col("_b"), "full").select(*out)
