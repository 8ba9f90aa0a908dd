"""Small session helpers: table reading, shared scratch tables, worker import path."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, and free a finished query's shuffle files early."""
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in parts:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *parts])
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return spark


#: Tables of long texts, whose rows are worth dealing to all cores first where the files are fewer than these.
LONG_ROWS = ("documents", "pages", "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. A file of one row group is read by one task, whatever its size: where a table of long texts has
    fewer files than there are cores, its rows are dealt to all of them; a table of many files is read as it lies."""
    prepare(spark)
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in LONG_ROWS and len(table.inputFiles()) < cores:
        return table.repartition(cores)
    return table


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the session names; a temporary one only for local sessions without it."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="strandline-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write `df` as Parquet under the shared scratch folder and read it back (cuts lineage)."""
    return _stored(df, label)


def materialize_by(df: DataFrame, label: str, by: str) -> DataFrame:
    """As `materialize`, in a folder for each value of the last column, `by`, that `discard` can delete alone."""
    return _stored(df, label, by)


def _stored(df: DataFrame, label: str, *by: str) -> DataFrame:
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/strandline-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._strandline_path = path
    return out


def discard(*tables: DataFrame, only: str = "") -> None:
    """Delete tables made by `materialize` that no later step reads, or `only` one folder of theirs."""
    for df in tables:
        path = getattr(df, "_strandline_path", None)
        if not path:
            continue
        spark = df.sparkSession
        jpath = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{only}" if only else path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)
