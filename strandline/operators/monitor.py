"""Checks of run logs: batch forms; the streaming ones are in strandline.streaming."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize

KEYS = ("run_id", "stage")


def last(df: DataFrame, value: str, k: int = 1, keys: Sequence[str] = KEYS) -> DataFrame:
    """The last k rows of each run's stage that have the value, newest first as `_r` = 1."""
    w = Window.partitionBy(*keys).orderBy(F.desc("step"))
    return df.where(F.col(value).isNotNull()).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)


def unpivot_metrics(df: DataFrame, metrics: Sequence[str], keys: Sequence[str] = (*KEYS, "step")) -> DataFrame:
    return df.unpivot(list(keys), list(metrics), "metric", "value")


def throughput(df: DataFrame, tokens: str, elapsed: str) -> DataFrame:
    """keys, rate: tokens gained over time passed between the last two rows."""
    two = last(df, tokens, 2)
    d = lambda c: F.max(F.when(F.col("_r") == 1, F.col(c))) - F.max(F.when(F.col("_r") == 2, F.col(c)))
    return two.groupBy(*KEYS).agg(d(tokens).alias("_t"), d(elapsed).alias("_e")).select(*KEYS, F.try_divide(F.col("_t"), F.nullif("_e", F.lit(0))).alias("rate"))


def rising_tail(df: DataFrame, value: str, k: int = 4) -> DataFrame:
    """keys, rising: of the last k readings the newest is above the oldest (fewer than k: false)."""
    t = last(df, value, k).groupBy(*KEYS).agg(F.count("*").alias("_n"), F.min_by(value, "_r").alias("_new"), F.max_by(value, "_r").alias("_old"))
    return t.select(*KEYS, ((F.col("_n") >= k) & (F.col("_new") > F.col("_old"))).alias("rising"))


def loss_trend(df: DataFrame, value: str, least: int = 6, factor: float = 1.05) -> DataFrame:
    """keys, n, first, second, worse: means of the two halves (the first has n div 2 rows), and whether the second is above `factor` times the first."""
    w = Window.partitionBy(*KEYS)
    r = df.where(F.col(value).isNotNull()).withColumn("_r", F.row_number().over(w.orderBy("step"))).withColumn("_n", F.count("*").over(w))
    half = F.col("_r") <= F.floor(F.col("_n") / 2)
    t = r.groupBy(*KEYS).agg(F.count("*").alias("n"), F.avg(F.when(half, F.col(value))).alias("first"), F.avg(F.when(~half, F.col(value))).alias("second"))
    return t.where(F.col("n") >= least).withColumn("worse", F.col("second") > factor * F.col("first"))


def loss_spike(df: DataFrame, value: str, sds: float = 5.0) -> DataFrame:
    """keys, last, limit, spike: the newest reading against mean + sds population deviations of the others."""
    newest = last(df, value).select(*KEYS, F.col("step").alias("_s"), F.col(value).alias("last"))
    rest = df.join(newest.select(*KEYS, "_s"), list(KEYS)).where(F.col("step") < F.col("_s")).groupBy(*KEYS).agg((F.avg(value) + sds * F.stddev_pop(value)).alias("limit"))
    return newest.drop("_s").join(rest, list(KEYS)).withColumn("spike", F.col("last") > F.col("limit"))


def check_finite(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """One CRIT finding for each row and metric that is not a finite number: keys, step, metric, value (as text)."""
    bad = unpivot_metrics(df, metrics).where(F.isnan("value") | (F.abs("value") == float("inf")))
    return bad.select(*KEYS, "step", "metric", F.col("value").cast("string").alias("value"), F.lit("CRIT").alias("severity"))


def check_floors(df: DataFrame, names: Sequence[str], gap: float = 0.005, least: int = 3) -> DataFrame:
    """keys, name, readings, greatest_gap, finding, severity (WARN): each X_acc against the X_major beside it.

    Without an X_major column or any value of it: no floor. With `least` readings or more of both, none of which are
    `gap` apart in either direction: at the floor; but a head whose X_n_class never is above 1 has no floor to beat.
    """
    has = lambda c: F.col(c) if c in df.columns else F.lit(None)
    heads = [F.struct(F.lit(x).alias("name"), F.col(f"{x}_acc").cast("double").alias("acc"), has(f"{x}_major").cast("double").alias("floor"), has(f"{x}_n_class").cast("double").alias("classes")) for x in names]
    r = df.select(*KEYS, F.explode(F.array(*heads)).alias("r")).select(*KEYS, "r.*")
    both = F.col("acc").isNotNull() & F.col("floor").isNotNull()
    t = r.groupBy(*KEYS, "name").agg(F.count("acc").alias("_acc"), F.count("floor").alias("_floor"), F.count_if(both).alias("readings"), F.max(F.abs(F.col("acc") - F.col("floor"))).alias("greatest_gap"), F.max(F.when(both, F.col("classes"))).alias("_classes"))
    stuck = (F.col("readings") >= least) & (F.col("greatest_gap") < gap) & (F.coalesce("_classes", F.lit(2.0)) > 1)
    t = t.where("_acc > 0").withColumn("finding", F.when(F.col("_floor") == 0, "no floor").when(stuck, "at the floor"))
    return t.where("finding IS NOT NULL").select(*KEYS, "name", "readings", "greatest_gap", "finding", F.lit("WARN").alias("severity"))


def macro_at_chance(df: DataFrame, value: str, classes: str, k: int = 3, factor: float = 1.15) -> DataFrame:
    """keys, latest, best, classes, severity (WARN) where each of the last k macro scores is at most factor over the
    latest number of classes; stages with fewer readings or one class are left out."""
    newest = df.where(F.col(classes).isNotNull()).groupBy(*KEYS).agg(F.max_by(F.col(classes), "step").alias("classes"))
    t = last(df, value, k).groupBy(*KEYS).agg(F.count("*").alias("_n"), F.min_by(value, "_r").alias("latest"), F.max(value).alias("best")).join(newest, list(KEYS))
    stuck = (F.col("_n") >= k) & (F.col("classes") > 1) & (F.col("best") <= F.lit(factor) / F.col("classes"))
    return t.where(stuck).select(*KEYS, "latest", "best", "classes", F.lit("WARN").alias("severity"))


def worse_than_baseline(df: DataFrame, value: str, baseline: float) -> DataFrame:
    """keys, latest, gain (percent below the baseline), finding, severity: the last row's value against what a table of
    symbol frequencies reaches (the corpus's entropy); ALERT where it cannot be read or is no better."""
    t = df.groupBy(*KEYS).agg(F.max_by(F.struct(F.col(value).alias("v")), "step").alias("l")).select(*KEYS, F.col("l.v").alias("latest"))
    unread = F.col("latest").isNull() | F.isnan("latest")
    finding = F.when(unread, "unreadable").when(F.col("latest") >= baseline, "no better than the baseline").otherwise("better than the baseline")
    gain = F.when(~unread, (F.lit(baseline) - F.col("latest")) / F.lit(baseline) * 100)
    return t.select(*KEYS, F.when(~unread, F.col("latest")).alias("latest"), gain.alias("gain"), finding.alias("finding"), F.when(finding == "better than the baseline", "OK").otherwise("ALERT").alias("severity"))


def dead_regression(df: DataFrame, value: str, least: float = 1e-4) -> DataFrame:
    return last(df, value).select(*KEYS, F.col(value).alias("last"), (F.col(value) < least).alias("dead"))


def no_lift(df: DataFrame, value: str, k: int = 5, least: int = 3, classes: str | None = None) -> DataFrame:
    """keys, n, best, no_lift: none of the last k lifts is above 0, with at least `least` rows.

    A head whose last k numbers of classes, in the column `classes`, are none above 1 has no lift to have and is exempt.
    """
    t = last(df, value, k).groupBy(*KEYS).agg(F.count("*").alias("n"), F.max(value).alias("best"))
    bad = (F.col("n") >= least) & (F.col("best") <= 0)
    if classes is None:
        return t.withColumn("no_lift", bad)
    kinds = last(df, classes, k).groupBy(*KEYS).agg(F.max(classes).alias("_classes"))
    return t.join(kinds, list(KEYS), "left").select(*KEYS, "n", "best", (bad & (F.coalesce("_classes", F.lit(2)) > 1)).alias("no_lift"))


def never_written(df: DataFrame, metrics: Sequence[str], ready: Column) -> DataFrame:
    """stage, metric: never known in a stage that has a row for which `ready` holds."""
    t = df.groupBy("stage").agg(F.bool_or(ready).alias("_ready"), *[F.count(m).alias(m) for m in metrics])
    return t.where("_ready").unpivot(["stage"], list(metrics), "metric", "n").where("n = 0").select("stage", "metric")


def liveness(df: DataFrame, as_of: Column, minutes: int = 45) -> DataFrame:
    """keys, last_ts, silent: no row for more than `minutes` before `as_of`."""
    t = df.groupBy(*KEYS).agg(F.max("ts").alias("last_ts"))
    return t.withColumn("silent", F.unix_timestamp(as_of) - F.unix_timestamp("last_ts") > minutes * 60)


def stalled(now: DataFrame, before: DataFrame, minutes: int = 20) -> DataFrame:
    """keys, stalled: the last step is what the snapshot before had, at least `minutes` later."""
    b = before.select(*KEYS, F.col("step").alias("_s"), F.col("ts").alias("_t"))
    n = now.groupBy(*KEYS).agg(F.max("step").alias("step"), F.max("ts").alias("ts"))
    late = F.unix_timestamp("ts") - F.unix_timestamp("_t") >= minutes * 60
    return n.join(b, list(KEYS)).select(*KEYS, ((F.col("step") == F.col("_s")) & late).alias("stalled"))


def series_consistency(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """stage, distinct values of each field, severity ALERT where there is more than one."""
    t = df.groupBy("stage").agg(*[F.count_distinct(f).alias(f) for f in fields])
    many = F.lit(False)
    for f in fields:
        many = many | (F.col(f) > 1)
    return t.withColumn("severity", F.when(many, "ALERT").otherwise("OK"))


def trailing_mean(df: DataFrame, value: str, steps: int = 250) -> DataFrame:
    """keys, step, mean: over st - steps < k <= st."""
    w = Window.partitionBy(*KEYS).orderBy("step").rangeBetween(-steps + 1, 0)
    return df.select(*KEYS, "step", F.avg(value).over(w).alias("mean"))


def newest_nonempty(df: DataFrame, rows: str = "rows") -> DataFrame:
    """stage, run_id of the newest record that has rows, newest_is_empty."""
    t = df.groupBy("stage").agg(F.max_by("run_id", "ts").alias("_newest"), F.max_by(F.when(F.col(rows) > 0, F.col("run_id")), F.when(F.col(rows) > 0, F.col("ts"))).alias("run_id"))
    return t.select("stage", "run_id", (~F.col("_newest").eqNullSafe(F.col("run_id"))).alias("newest_is_empty"))


def acknowledge(findings: DataFrame, known: DataFrame, most: int = 10_000) -> DataFrame:
    """Findings whose detail contains a known `part` become INFO with its `why`; none is dropped. `known` is a short
    hand-kept list of at most `most` rows (more raise an error); the first match by `part` counts."""
    if known.count() > most:
        raise ValueError(f"more than {most} known parts")
    # One row that holds the whole short list, in order of `part`.
    k = known.agg(F.array_sort(F.collect_list(F.struct("part", "why"))).alias("_known"))
    hit = F.element_at(F.filter("_known", lambda x: F.contains("detail", x["part"])), 1)
    hit = F.when(F.exists("_known", lambda x: F.contains("detail", x["part"])), hit["why"])
    t = findings.join(F.broadcast(k)).withColumn("why", hit).drop("_known")
    return t.withColumn("severity", F.when(F.col("why").isNotNull(), "INFO").otherwise(F.col("severity")))


def run_checks(spark: SparkSession, checks: dict[str, Callable[[], DataFrame]]) -> DataFrame:
    """check, severity, detail of all checks, each of which gives rows with severity and detail, stored one by one; a
    check that raises, in its plan or in its tasks, is itself a finding: BROKEN."""
    schema = "check string, severity string, detail string"
    out = spark.createDataFrame([], schema)
    for name, check in checks.items():
        try:
            found = materialize(check().select(F.lit(name).alias("check"), F.col("severity").cast("string").alias("severity"), F.col("detail").cast("string").alias("detail")), "findings")
        except Exception as e:  # noqa: BLE001 - whatever a check raises is what this reports
            found = spark.createDataFrame([(name, "BROKEN", f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}")], schema)
        out = out.unionByName(found)
    return out


def append_history(findings: DataFrame, folder: str, at: Column) -> None:
    """Append a report to the history in `folder`: reports (at, crit, warn, broken, findings) has a row for it, findings
    its rows with `at`."""
    count = lambda s: F.count_if(F.col("severity") == s)
    findings.select(at.alias("at"), "check", "severity", "detail").write.mode("append").parquet(f"{folder}/findings")
    findings.agg(count("CRIT").alias("crit"), count("WARN").alias("warn"), count("BROKEN").alias("broken"), F.count("*").alias("findings")).select(at.alias("at"), "crit", "warn", "broken", "findings").write.mode("append").parquet(f"{folder}/reports")


def history(spark: SparkSession, folder: str, table: str = "reports") -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}")


def snapshot(df: DataFrame, values: Sequence[str]) -> DataFrame:
    """keys, step, ts and the values of each stage's last row: what the next report is compared with."""
    newest = F.max_by(F.struct("step", "ts", *values), "step")
    return df.groupBy(*KEYS).agg(newest.alias("l")).select(*KEYS, "l.*")


def keep_snapshot(now: DataFrame, folder: str) -> None:
    """Put this report's snapshot in the place of the last one. `now` may read that one: it is stored first."""
    materialize(now, "snapshot").write.mode("overwrite").parquet(f"{folder}/snapshot")


def last_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/snapshot")


def report_severity(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count("*").alias("n"))


def column_liveness(df: DataFrame, metrics: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """keys, metric, rows, known, nonzero share, distinct (bounded by the group's rows), mean, sd, constant, tail (values at or under -6)."""
    u = df.unpivot(list(keys), list(metrics), "metric", "value")
    v = F.col("value")
    return u.groupBy(*keys, "metric").agg(
        F.count("*").alias("rows"), F.count(v).alias("known"), F.avg((v != 0).cast("double")).alias("nonzero"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"),
        (F.min(v) == F.max(v)).alias("constant"), F.count_if(v <= -6).alias("tail"),
    )


def rollup_windows(df: DataFrame, width: str, slide: str | None = None) -> DataFrame:
    """start, stage, n, mean: the batch twin of the streaming rollup."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return df.groupBy(w.alias("w"), "stage").agg(F.count("*").alias("n"), F.avg("metric").alias("mean")).select(F.col("w.start").alias("start"), "stage", "n", "mean")


def sessions(df: DataFrame, gap: str) -> DataFrame:
    """run_id, start, n: rows of a run that follow each other within the gap."""
    return df.groupBy(F.session_window("ts", gap).alias("w"), "run_id").agg(F.count("*").alias("n")).select("run_id", F.col("w.start").alias("start"), "n")
