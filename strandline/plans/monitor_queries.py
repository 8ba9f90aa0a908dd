"""Queries of the monitoring and batching operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..operators import batches, monitor
from ..session import prepare, scratch_root
from ..streaming import logs
from . import fixtures as X
from .registry import query

W = "WINDOW w AS (PARTITION BY run_id, stage ORDER BY step DESC)"


@query(f"""WITH r AS (SELECT *, row_number() OVER w AS r FROM ({X.LOGS}) {W})
  SELECT run_id, stage, (max(metric) FILTER (WHERE r = 1) - max(metric) FILTER (WHERE r = 2)) / nullif(max(id) FILTER (WHERE r = 1) - max(id) FILTER (WHERE r = 2), 0) AS rate FROM r WHERE r <= 2 GROUP BY ALL""")
def run_throughput(spark, d):
    return monitor.throughput(X.logs(spark, d), "metric", "id")


@query(f"""WITH r AS (SELECT *, row_number() OVER w AS r FROM ({X.LOGS}) {W})
  SELECT run_id, stage, count(*) >= 4 AND arg_min(metric, r) > arg_max(metric, r) AS rising FROM r WHERE r <= 4 GROUP BY ALL""")
def rising_tail(spark, d):
    return monitor.rising_tail(X.logs(spark, d), "metric")


@query(f"""WITH r AS (SELECT *, count(*) OVER (PARTITION BY run_id, stage) AS t FROM ({X.LOGS})), h AS (SELECT run_id, stage, count(*) AS n, avg(metric) FILTER (WHERE step <= t // 2) AS first, avg(metric) FILTER (WHERE step > t // 2) AS second FROM r GROUP BY ALL)
  SELECT *, second > 1.05 * first AS worse FROM h WHERE n >= 6""")
def loss_trend(spark, d):
    return monitor.loss_trend(X.logs(spark, d), "metric")


@query(f"""WITH m AS (SELECT *, max(step) OVER (PARTITION BY run_id, stage) AS t FROM ({X.LOGS})), g AS (SELECT run_id, stage, max(metric) FILTER (WHERE step = t) AS last, avg(metric) FILTER (WHERE step < t) + 5 * stddev_pop(metric) FILTER (WHERE step < t) AS "limit", count(*) AS n FROM m GROUP BY ALL)
  SELECT run_id, stage, last, "limit", last > "limit" AS spike FROM g WHERE n > 1""")
def loss_spike(spark, d):
    return monitor.loss_spike(X.logs(spark, d), "metric")


BAD = f"SELECT *, CASE WHEN id % 97 = 5 THEN CAST('nan' AS DOUBLE) WHEN id % 131 = 7 THEN CAST('inf' AS DOUBLE) ELSE metric END AS loss FROM ({X.LOGS})"


@query(f"SELECT run_id, stage, step, 'loss' AS metric, CASE WHEN isnan(loss) THEN 'NaN' ELSE 'Infinity' END AS value, 'CRIT' AS severity FROM ({BAD}) WHERE NOT isfinite(loss)")
def nonfinite_metrics(spark, d):
    f = X.logs(spark, d).withColumn("loss", F.when(F.col("id") % 97 == 5, float("nan")).when(F.col("id") % 131 == 7, float("inf")).otherwise(F.col("metric")))
    return monitor.check_finite(f.drop("metric"), ["loss"])


FL = f"""SELECT *, metric / 100 AS loop_acc, CASE WHEN stage <> 'click' THEN metric / 100 - (run_id % 3 - 1) * 0.004 END AS loop_major, 1 + run_id % 2 AS loop_n_class, metric / 50 AS bare_acc FROM ({X.LOGS})"""


@query(f"""WITH g AS (SELECT run_id, stage, count(loop_acc) AS a, count(loop_major) AS f, count_if(loop_acc IS NOT NULL AND loop_major IS NOT NULL) AS readings, max(abs(loop_acc - loop_major)) AS greatest_gap, max(loop_n_class) AS c FROM ({FL}) GROUP BY ALL),
  s AS (SELECT run_id, stage, 'loop' AS name, readings, greatest_gap, CASE WHEN f = 0 THEN 'no floor' WHEN readings >= 3 AND greatest_gap < 0.005 AND c > 1 THEN 'at the floor' END AS finding, 'WARN' AS severity FROM g WHERE a > 0
    UNION ALL SELECT run_id, stage, 'bare', 0, NULL, 'no floor', 'WARN' FROM ({FL}) GROUP BY run_id, stage HAVING count(bare_acc) > 0)
  SELECT run_id, stage, name, readings, round(greatest_gap, 9) AS greatest_gap, finding, severity FROM s WHERE finding IS NOT NULL""")
def accuracy_floors(spark, d):
    """Heads one step above, at and below their floor; those of an odd run have two classes."""
    f = X.logs(spark, d).withColumns({"loop_acc": F.col("metric") / 100, "bare_acc": F.col("metric") / 50, "loop_n_class": 1 + F.col("run_id") % 2})
    f = f.withColumn("loop_major", F.when(F.col("stage") != "click", F.col("loop_acc") - (F.col("run_id") % 3 - 1) * F.lit(0.004)))
    return monitor.check_floors(f, ["loop", "bare"]).withColumn("greatest_gap", F.round("greatest_gap", 9))


@query(f"""WITH r AS (SELECT *, 1 + step % 3 AS c, row_number() OVER w AS r FROM ({X.LOGS}) {W}), t AS (SELECT run_id, stage, count(*) AS n, max(metric / 100) AS best, max(metric / 100) FILTER (WHERE r = 1) AS latest, max(c) FILTER (WHERE r = 1) AS classes FROM r WHERE r <= 3 GROUP BY ALL)
  SELECT run_id, stage, latest, best, classes, 'WARN' AS severity FROM t WHERE n >= 3 AND classes > 1 AND best <= 1.15 / classes""")
def macro_at_chance(spark, d):
    f = X.logs(spark, d).withColumns({"macro": F.col("metric") / 100, "classes": 1 + F.col("step") % 3})
    return monitor.macro_at_chance(f, "macro", "classes")


BITS = f"SELECT *, CASE WHEN id % 11 <> 4 THEN metric / 25 END AS bits FROM ({X.LOGS})"


@query(f"""WITH b AS (SELECT sum(-p * log2(p)) AS h FROM (SELECT count(*) / sum(count(*)) OVER () AS p FROM ({X.LOGS}) GROUP BY stage)),
  t AS (SELECT run_id, stage, bits AS latest, round(h, 6) AS h FROM ({BITS}), b QUALIFY row_number() OVER (PARTITION BY run_id, stage ORDER BY step DESC) = 1)
  SELECT run_id, stage, latest, round((h - latest) / h * 100, 6) AS gain, CASE WHEN latest IS NULL THEN 'unreadable' WHEN latest >= h THEN 'no better than the baseline' ELSE 'better than the baseline' END AS finding, CASE WHEN latest < h THEN 'OK' ELSE 'ALERT' END AS severity FROM t""")
def worse_than_baseline(spark, d):
    """Held-out bits against the entropy of the stages' frequencies."""
    f = X.logs(spark, d)
    n = f.groupBy("stage").agg(F.count("*").alias("n"))
    entropy = n.select((F.col("n") / F.sum("n").over(Window.partitionBy())).alias("p")).agg(F.round(F.sum(-F.col("p") * F.log2("p")), 6)).first()[0]
    t = monitor.worse_than_baseline(f.withColumn("bits", F.when(F.col("id") % 11 != 4, F.col("metric") / 25)), "bits", entropy or 1.0)
    return t.withColumn("gain", F.round("gain", 6))


@query(f"""WITH r AS (SELECT *, row_number() OVER w AS r FROM ({X.LOGS}) {W}) SELECT run_id, stage, metric AS last, metric < 5 AS dead FROM r WHERE r = 1""")
def dead_regression(spark, d):
    return monitor.dead_regression(X.logs(spark, d), "metric", 5.0)


@query(f"""WITH r AS (SELECT *, row_number() OVER w AS r FROM ({X.LOGS}) {W})
  SELECT run_id, stage, count(*) AS n, max(metric - 60) AS best, count(*) >= 3 AND max(metric - 60) <= 0 AND max(1 + run_id % 3) > 1 AS no_lift FROM r WHERE r <= 5 GROUP BY ALL""")
def no_lift(spark, d):
    """Every third run has one class and is exempt."""
    f = X.logs(spark, d).withColumns({"lift": F.col("metric") - 60, "classes": 1 + F.col("run_id") % 3})
    return monitor.no_lift(f, "lift", classes="classes")


@query(f"""SELECT stage, unnest(['metric', 'other']) AS metric FROM (SELECT stage, count(metric) AS a, max(step) AS m FROM ({X.LOGS}) GROUP BY stage) WHERE m >= 2 AND a = 0 UNION ALL SELECT stage, 'other' FROM ({X.LOGS}) GROUP BY stage HAVING max(step) >= 2""")
def never_written(spark, d):
    f = X.logs(spark, d).withColumn("other", F.lit(None).cast("double"))
    return monitor.never_written(f, ["metric", "other"], F.col("step") >= 2)


@query(f"""WITH l AS ({X.LOGS}), n AS (SELECT max(ts) AS t FROM l) SELECT run_id, stage, max(ts) AS last_ts, epoch(any_value(t)) - epoch(max(ts)) > 86400 * 10 AS silent FROM l, n GROUP BY run_id, stage""")
def liveness(spark, d):
    f = X.logs(spark, d)
    return monitor.liveness(f, F.lit(f.agg(F.max("ts")).first()[0]), 14400)


@query(f"""WITH l AS ({X.LOGS}), b AS (SELECT run_id, stage, max(step) AS s, min(ts) AS t FROM l WHERE step <= 2 GROUP BY ALL), n AS (SELECT run_id, stage, max(step) AS step, max(ts) AS ts FROM l GROUP BY ALL)
  SELECT run_id, stage, step = s AND epoch(ts) - epoch(t) >= 1200 AS stalled FROM n JOIN b USING (run_id, stage)""")
def counter_stalled(spark, d):
    f = X.logs(spark, d)
    before = f.where("step <= 2").groupBy("run_id", "stage").agg(F.max("step").alias("step"), F.min("ts").alias("ts"))
    return monitor.stalled(f, before)


@query(f"SELECT stage, count(DISTINCT run_id % 4) AS a, count(DISTINCT length(stage)) AS b, CASE WHEN count(DISTINCT run_id % 4) > 1 OR count(DISTINCT length(stage)) > 1 THEN 'ALERT' ELSE 'OK' END AS severity FROM ({X.LOGS}) GROUP BY stage")
def series_consistency(spark, d):
    return monitor.series_consistency(X.logs(spark, d).withColumn("a", F.col("run_id") % 4).withColumn("b", F.length("stage")), ["a", "b"])


@query(f"SELECT run_id, stage, step, round(avg(metric) OVER (PARTITION BY run_id, stage ORDER BY step RANGE BETWEEN 9 PRECEDING AND CURRENT ROW), 8) AS mean FROM ({X.LOGS})")
def trailing_mean(spark, d):
    return monitor.trailing_mean(X.logs(spark, d), "metric", 10).withColumn("mean", F.round("mean", 8))


RUNS = f"SELECT stage, run_id, max(ts) AS ts, CASE WHEN run_id % 2 = 0 THEN 0 ELSE count(*) END AS rows FROM ({X.LOGS}) GROUP BY stage, run_id"


@query(f"SELECT stage, arg_max(run_id, ts) FILTER (WHERE rows > 0) AS run_id, arg_max(run_id, ts) IS DISTINCT FROM arg_max(run_id, ts) FILTER (WHERE rows > 0) AS newest_is_empty FROM ({RUNS}) GROUP BY stage")
def newest_nonempty_run(spark, d):
    r = X.logs(spark, d).groupBy("stage", "run_id").agg(F.max("ts").alias("ts"), F.count("*").alias("n"))
    return monitor.newest_nonempty(r.withColumn("rows", F.when(F.col("run_id") % 2 == 0, 0).otherwise(F.col("n"))))


FIND = f"SELECT 'run ' || run_id || ' of ' || stage AS detail, CASE WHEN metric > 90 THEN 'CRIT' ELSE 'WARN' END AS severity FROM ({X.LOGS}) WHERE metric > 80"


def findings(spark, d):
    f = X.logs(spark, d).where("metric > 80")
    return f.select(F.concat(F.lit("run "), "run_id", F.lit(" of "), "stage").alias("detail"), F.when(F.col("metric") > 90, "CRIT").otherwise("WARN").alias("severity"))


@query(f"SELECT severity, count(*) AS n FROM ({FIND}) GROUP BY severity")
def report_severity(spark, d):
    return monitor.report_severity(findings(spark, d))


@query(f"""SELECT detail, CASE WHEN contains(detail, 'click') OR contains(detail, 'run 1') THEN 'INFO' ELSE severity END AS severity, CASE WHEN contains(detail, 'click') THEN 'noisy' WHEN contains(detail, 'run 1') THEN 'old' END AS why FROM ({FIND})""")
def acknowledged_findings(spark, d):
    known = spark.createDataFrame([("click", "noisy"), ("run 1", "old")], "part string, why string")
    return monitor.acknowledge(findings(spark, d), known)


@query(f"""WITH f AS (SELECT 'spread' AS c, severity FROM ({FIND}) UNION ALL SELECT 'silent', 'WARN' FROM ({X.LOGS}) GROUP BY run_id, stage HAVING count(*) < 3)
  SELECT 'nightly' AS at, count_if(severity = 'CRIT') AS crit, count_if(severity = 'WARN') AS warn, 1 AS broken, count(*) + 1 AS findings FROM f""")
def findings_history(spark, d):
    """A report of three checks, of which one fails, appended and read again."""
    f = X.logs(spark, d)
    few = f.groupBy("run_id", "stage").agg(F.count("*").alias("n")).where("n < 3").select(F.lit("WARN").alias("severity"), F.concat_ws(" ", "run_id", "stage").alias("detail"))
    checks = {"spread": lambda: findings(spark, d), "silent": lambda: few, "no column": lambda: f.select("missing")}
    folder = f"{scratch_root(spark)}/history-{uuid.uuid4().hex}"
    monitor.append_history(monitor.run_checks(spark, checks), folder, F.lit("nightly"))
    return monitor.history(spark, folder)


@query(f"SELECT run_id, stage, step, ts, metric FROM ({X.LOGS}) QUALIFY row_number() OVER (PARTITION BY run_id, stage ORDER BY step DESC) = 1")
def report_snapshot(spark, d):
    """The snapshot of half the steps, put out of its place by that of all."""
    f = X.logs(spark, d)
    folder = f"{scratch_root(spark)}/report-{uuid.uuid4().hex}"
    monitor.keep_snapshot(monitor.snapshot(f.where("step <= 2"), ["metric"]), folder)
    monitor.keep_snapshot(monitor.snapshot(f, ["metric"]), folder)
    return monitor.last_snapshot(spark, folder)


@query(f"""SELECT stage, 'metric' AS metric, count(*) AS rows, count(metric) AS known, avg(CAST(metric <> 0 AS DOUBLE)) AS nonzero, round(avg(metric), 8) AS mean, round(stddev_pop(metric), 8) AS sd, min(metric) = max(metric) AS constant, count_if(metric <= -6) AS tail FROM ({X.LOGS}) GROUP BY stage""")
def column_liveness(spark, d):
    t = monitor.column_liveness(X.logs(spark, d), ["metric"], ["stage"])
    return t.withColumns({"mean": F.round("mean", 8), "sd": F.round("sd", 8)})


@query(f"SELECT time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS start, stage, count(*) AS n, round(avg(metric), 8) AS mean FROM ({X.LOGS}) GROUP BY ALL")
def windowed_rollup(spark, d):
    return monitor.rollup_windows(X.logs(spark, d), "6 hours").withColumn("mean", F.round("mean", 8))


@query(f"""WITH l AS (SELECT run_id, ts, id, CASE WHEN ts - lag(ts) OVER w <= INTERVAL '3 days' THEN 0 ELSE 1 END AS new FROM ({X.LOGS}) WINDOW w AS (PARTITION BY run_id ORDER BY ts, id)),
  s AS (SELECT *, sum(new) OVER (PARTITION BY run_id ORDER BY ts, id) AS k FROM l) SELECT run_id, min(ts) AS start, count(*) AS n FROM s GROUP BY run_id, k""")
def run_sessions(spark, d):
    return monitor.sessions(X.logs(spark, d), "3 days")


# --- batches

LEN = f"SELECT id, chunk, length(sequence) AS length FROM ({X.SEQ})"


def sized(spark, d):
    return X.seq(spark, d).select("id", "chunk", F.length("sequence").alias("length"))


def _fold(rows: str, quantum: int, running: bool) -> str:
    """SQL: the report of batches cut in turn from `rows` (part, k from 1, length), at most 24576 tokens and 256 rows."""
    new = "greatest(f.width, r.w)" if running else "r.w"
    cut = f"((f.n + 1) * {new} > 24576 OR f.n >= 256)"
    return f"""WITH RECURSIVE r AS MATERIALIZED (SELECT part, k, length, CAST(ceil(length / {quantum}) * {quantum} AS BIGINT) AS w FROM ({rows})),
  f AS (SELECT part, k, 0 AS batch, 1 AS n, length AS tokens, w AS width FROM r WHERE k = 1 UNION ALL
    SELECT r.part, r.k, CASE WHEN {cut} THEN f.batch + 1 ELSE f.batch END, CASE WHEN {cut} THEN 1 ELSE f.n + 1 END, CASE WHEN {cut} THEN r.length ELSE f.tokens + r.length END, CASE WHEN {cut} THEN r.w ELSE {new} END
    FROM f JOIN r ON r.part = f.part AND r.k = f.k + 1),
  b AS (SELECT part, batch, max(n) AS rows, max(tokens) AS tokens, arg_max(width, k) AS width FROM f GROUP BY part, batch)
  SELECT count(*) AS steps, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(rows * width) AS BIGINT) AS padded, 1 - sum(tokens) / sum(rows * width) AS padding, count(DISTINCT width) AS widths, max(rows) AS most_rows FROM b"""


@query(_fold(f"SELECT (row_number() OVER (ORDER BY length, id) - 1) // 100000 AS part, (row_number() OVER (ORDER BY length, id) - 1) % 100000 + 1 AS k, length FROM ({LEN})", 64, True))
def length_sorted_batches(spark, d):
    """Batches of a token budget over lengths in order."""
    return batches.report(batches.pack_ranges(sized(spark, d), F.lit(0), ["length", "id"], 24576, 256, 64))


@query(_fold(f"SELECT (row_number() OVER (ORDER BY id) - 1) // 100000 AS part, (row_number() OVER (ORDER BY id) - 1) % 100000 + 1 AS k, length FROM ({LEN})", 1, True))
def arrival_order_batches(spark, d):
    """The baseline: the same budget in arrival order."""
    return batches.report(batches.pack_ranges(sized(spark, d), F.lit(0), ["id"], 24576, 256))


BOUNDS = batches.bucket_bounds(65536)
_BUCKET = "CASE " + " ".join(f"WHEN length <= {b} THEN {i}" for i, b in enumerate(BOUNDS)) + f" ELSE {len(BOUNDS)} END"
_HASHED = f"SELECT *, {_BUCKET} AS b, row_number() OVER (PARTITION BY {_BUCKET} ORDER BY md5('' || id), id) - 1 AS r FROM ({LEN})"


@query(_fold(f"SELECT b * 1000000 + r // 100000 AS part, r % 100000 + 1 AS k, length FROM ({_HASHED})", 1, True))
def length_bucket_batches(spark, d):
    """Geometric buckets, shuffled by hash inside each, cut by the running greatest length."""
    f = sized(spark, d).withColumn("h", F.md5(F.col("id").cast("string"))).withColumn("b", batches.bucket_of(F.col("length"), BOUNDS))
    return batches.report(batches.pack_ranges(f, F.col("b"), ["h", "id"], 24576, 256))


@query(f"WITH b AS (SELECT chunk, (row_number() OVER (PARTITION BY chunk ORDER BY id) - 1) // 16 AS batch, length FROM ({LEN})) SELECT chunk, batch, count(*) AS rows, CAST(sum(length) AS BIGINT) AS tokens FROM b GROUP BY ALL")
def single_group_batches(spark, d):
    b = batches.single_group_batches(sized(spark, d), "chunk", ["id"], F.lit(16))
    return b.groupBy("chunk", "batch").agg(F.count("*").alias("rows"), F.sum("length").alias("tokens"))


@query(f"SELECT CAST(ceil(length / 64) * 64 AS BIGINT) AS width, count(*) AS n, CAST(sum(ceil(length / 64) * 64 - length) AS BIGINT) AS padding FROM ({LEN}) GROUP BY 1")
def quantized_padding(spark, d):
    w = S.quantized_length(F.col("length"), 64)
    return sized(spark, d).groupBy(w.alias("width")).agg(F.count("*").alias("n"), F.sum(w - F.col("length")).alias("padding"))


# --- streams


@query(f"SELECT time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS start, stage, count(*) AS n, round(avg(metric), 8) AS mean FROM ({X.LOGS}) GROUP BY ALL")
def stream_rollup(spark, d):
    """The events table read as a stream to its end; the windows are those of the batch twin."""
    prepare(spark)
    rows = logs.stream_table(spark, f"{d}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("stage"), F.col("value").alias("metric"))
    return _run(logs.rollup(rows, "6 hours", "metric"), "complete").withColumn("mean", F.round("mean", 8))


@query("SELECT user_id, event_type FROM events GROUP BY ALL")
def stream_dedup(spark, d):
    """The first event of each kind of every user; what a user has done is forgotten four years later, longer than the table lasts."""
    prepare(spark)
    rows = logs.stream_table(spark, f"{d}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    return _run(logs.dedup(rows, ["user_id", "event_type"], "1461 days").select("user_id", "event_type"), "append")


def _run(stream, mode):
    folder = f"{scratch_root(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    return logs.run_stored(stream, f"{folder}/rows", f"{folder}/state", mode)
