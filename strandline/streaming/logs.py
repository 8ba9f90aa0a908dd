"""Run logs as streams: tailing, rollups with a watermark, running dedup, liveness, findings."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import parse_run_logs

#: A run is thought stalled after this long without a row, so later rows are late.
WATERMARK = "45 minutes"


def stream_run_logs(spark: SparkSession, folder: str, metrics: Sequence[str]) -> DataFrame:
    """Rows of CSV logs as they are appended to the folder."""
    names = ["run_id", "stage", "kind", "timestamp", "elapsed_s", "epoch", "step", *metrics]
    raw = spark.readStream.schema(", ".join(f"`{n}` string" for n in names)).option("header", True).csv(folder)
    return parse_run_logs(raw, metrics)


def stream_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table as a stream. The source takes folders or globs, and a table may be one file: hence the glob."""
    folder, _, name = path.rstrip("/").rpartition("/")
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{folder}/[{name[0]}]{name[1:]}")


def rollup(rows: DataFrame, width: str, value: str, watermark: str = WATERMARK) -> DataFrame:
    """start, stage, n, mean in tumbling windows; late rows are left out of it."""
    r = rows.withWatermark("ts", watermark).groupBy(F.window("ts", width), "stage").agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    return r.select(F.col("window.start").alias("start"), "stage", "n", "mean")


def session_rollup(rows: DataFrame, gap: str, watermark: str = WATERMARK) -> DataFrame:
    r = rows.withWatermark("ts", watermark).groupBy(F.session_window("ts", gap), "run_id").agg(F.count("*").alias("n"))
    return r.select("run_id", F.col("session_window.start").alias("start"), "n")


def dedup(rows: DataFrame, keys: Sequence[str], watermark: str | None = None) -> DataFrame:
    """The first row of each key; with a watermark, keys are forgotten after it."""
    return rows.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(list(keys)) if watermark else rows.dropDuplicates(list(keys))


def findings(rows: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """run_id, stage, step, metric for every value that is not a finite number."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics]))
    r = rows.select("run_id", "stage", "step", pairs.alias("p"))
    v = F.col("p.value")
    return r.where(F.isnan(v) | (F.abs(v) == float("inf"))).select("run_id", "stage", "step", F.col("p.metric").alias("metric"))


def throughput(rows: DataFrame, tokens: str, elapsed: str) -> DataFrame:
    """run_id, stage, rate of the last two rows of each run's stage, updated as rows come: state is one row."""

    def update(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seen = [state.get] if state.exists else []
        for f in frames:
            seen += list(f.sort_values("step")[["step", tokens, elapsed]].dropna().itertuples(index=False, name=None))
        seen = sorted(seen)[-2:]
        if seen:
            state.update(tuple(float(x) if i else int(x) for i, x in enumerate(seen[-1])))
        if len(seen) == 2 and seen[1][2] != seen[0][2]:
            yield pd.DataFrame({"run_id": [key[0]], "stage": [key[1]], "rate": [(seen[1][1] - seen[0][1]) / (seen[1][2] - seen[0][2])]})

    return rows.select("run_id", "stage", "step", tokens, elapsed).groupBy("run_id", "stage").applyInPandasWithState(update, "run_id long, stage string, rate double", "step long, a double, b double", "update", "NoTimeout")


def run_available(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """All that is there now, as a table in memory: for tests and reports."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def run_stored(stream: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """All that is there now, as a stored table: each batch is written by its number, so that one run again takes its
    own place; a complete result is the last batch alone. No row comes to the driver."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/{'batch=' + str(number) if mode == 'append' else 'result'}")

    stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(folder)
