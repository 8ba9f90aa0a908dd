"""Readers and writers of tables: CSV folders, JSON, Parquet shards, run logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import Paths, _list

MISSING = ("", "None", "NaN", "nan", "?")


def _stem() -> Column:
    return F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)\.[A-Za-z]+(?:\.gz)?$", 1)


def clean_names(df: DataFrame) -> DataFrame:
    """Column names without a byte-order mark or outer spaces."""
    return df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])


def read_sequence_parquet(spark: SparkSession, paths: Paths) -> DataFrame:
    """The known sequences of shards, from folders or files; no other column is read."""
    return spark.read.parquet(*_list(paths)).select("sequence").where("sequence IS NOT NULL")


def read_csv_dir(spark: SparkSession, paths: Paths) -> DataFrame:
    """assay (a file's stem) and all columns as text."""
    t = spark.read.option("header", True).csv(_list(paths))
    return clean_names(t.select(_stem().alias("assay"), *[F.col(f"`{c}`") for c in t.columns]))


def read_probing_csv(spark: SparkSession, paths: Paths) -> DataFrame:
    """sequence, experiment_type, reactivity (array of the reactivity columns in order, errors left out, blanks null)."""
    t = clean_names(spark.read.option("header", True).csv(_list(paths)))
    cols = sorted(c for c in t.columns if c.startswith("reactivity_") and "error" not in c)
    value = lambda c: F.when(~F.trim(c).isin(*MISSING), F.col(c).try_cast("double"))
    return t.select("sequence", "experiment_type", F.array(*[value(c) for c in cols]).alias("reactivity"))


def read_ss_parquet(spark: SparkSession, paths: Paths) -> DataFrame:
    """sequence, secondary_structure where both are known and of one length."""
    t = spark.read.parquet(*_list(paths)).select("sequence", "secondary_structure")
    return t.where(F.length("sequence") == F.length("secondary_structure"))


def read_inventory_csv(spark: SparkSession, paths: Paths, numbers: Sequence[str]) -> DataFrame:
    """All columns; `numbers` as doubles (null if malformed), has_* as booleans."""
    t = clean_names(spark.read.option("header", True).csv(_list(paths)))
    kind = lambda c: F.trim(c).try_cast("double") if c in numbers else F.coalesce(F.col(c) == "True", F.lit(False)) if c.startswith("has_") else F.col(c)
    return t.select(*[kind(c).alias(c) for c in t.columns])


def parse_run_logs(raw: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """run_id, stage, kind, ts, step and metrics from text columns; blank, 'None', NaN and malformed are null."""
    number = lambda c: F.nullif(F.when(~F.trim(c).isin(*MISSING), F.col(c).try_cast("double")), F.lit(float("nan")))
    return raw.select("run_id", "stage", "kind", F.col("timestamp").try_cast("timestamp").alias("ts"), F.col("step").try_cast("long").alias("step"), *[number(m).alias(m) for m in metrics])


def read_run_logs(spark: SparkSession, paths: Paths, metrics: Sequence[str]) -> DataFrame:
    return parse_run_logs(spark.read.option("header", True).csv(_list(paths)), metrics)


def read_motif_json(spark: SparkSession, paths: Paths) -> DataFrame:
    """kind (a file's stem), motif_id, signature, num_instances, alignment (map of maps) of arrays of objects."""
    schema = "motif_id string, bp_signature string, num_instances long, num_nucleotides long, chainbreak array<int>, alignment map<string,map<string,string>>"
    t = spark.read.schema(schema).option("multiLine", True).json(_list(paths))
    return t.select(_stem().alias("kind"), "motif_id", F.col("bp_signature").alias("signature"), "num_instances", "num_nucleotides", "alignment")


def json_record_counts(spark: SparkSession, paths: Paths, names: Sequence[str] = ("data", "records", "sequences")) -> DataFrame:
    """path, n_records of JSON files: a list's length, that of a known list field, or the number of keys."""
    t = spark.read.text(_list(paths), wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.trim("value").alias("v"))
    lists = [F.json_array_length(F.get_json_object("v", f"$.{n}")) for n in names]
    keys = F.size(F.json_object_keys("v"))
    return t.select("path", F.when(F.col("v").startswith("["), F.json_array_length("v")).otherwise(F.coalesce(*lists, keys)).cast("long").alias("n_records"))


def count_text_records(spark: SparkSession, paths: Paths, pattern: str, header: int = 0) -> DataFrame:
    """path, n_records: lines that match, less `header`."""
    t = spark.read.text(_list(paths)).select(F.col("_metadata.file_path").alias("path"), F.col("value").rlike(pattern).alias("hit"))
    return t.groupBy("path").agg((F.count_if("hit") - header).alias("n_records"))


# --- sinks


def write_sequence_shards(df: DataFrame, path: str, rows_per_shard: int = 250_000, by: str | None = None) -> None:
    """zstd Parquet shards (id, sequence) of at most `rows_per_shard` rows, in folders of `by` if given."""
    w = df.write.mode("errorifexists").option("compression", "zstd").option("maxRecordsPerFile", rows_per_shard)
    (w.partitionBy(by) if by else w).parquet(path)


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    df.write.mode("overwrite").option("compression", "zstd").partitionBy(split).parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_run_log(df: DataFrame, path: str, known: Sequence[str]) -> list[str]:
    """Append rows; returns the columns that were not `known` (they are written too: readers merge schemas)."""
    df.write.mode("append").parquet(path)
    return [c for c in df.columns if c not in known]
