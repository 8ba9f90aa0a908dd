"""Live watch of runs: one that falls silent, or whose counter stands still, is reported by a timer though no row comes."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: A run is silent after this long without a row; its counter stalls after this long at one step.
SILENT_MS, STALLED_MS = 45 * 60_000, 20 * 60_000
FINDINGS = "run_id string, stage string, finding string, step long, waited_ms long"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_timers(spark: SparkSession) -> None:
    """Timers need this state store; to be called before a watching query starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class RunWatch(StatefulProcessor):
    """State of a run's stage: when its last row came, its last step and since when it is there, what was reported.

    Each row puts the timers off. A timer that goes off finds out which limit has passed, reports it once, and waits for the
    next. A run that was reported and moves again is reported as resumed. A silent run is forgotten after `forget_ms`
    more, so that state does not grow with all runs that ever were.
    """

    def __init__(self, silent_ms: int, stalled_ms: int, forget_ms: int) -> None:
        self.silent_ms, self.stalled_ms, self.forget_ms = silent_ms, stalled_ms, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("run", "at long, step long, since long, told string")

    def _put_off(self, now: int, at: int, since: int, told: list[str]) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        due = [at + self.silent_ms + (self.forget_ms if "silent" in told else 0)]
        # A counter stands still only while rows come after it reached its step.
        if "stalled" not in told and at > since:
            due.append(since + self.stalled_ms)
        self.handle.registerTimer(max(now + 1, min(due)))

    def _rows(self, key, findings: list[tuple[str, int, int]]) -> Iterator[pd.DataFrame]:
        if findings:
            yield pd.DataFrame([(str(key[0]), str(key[1]), name, step, waited) for name, step, waited in findings], columns=[c.split()[0] for c in FINDINGS.split(", ")])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        known = self.state.get() if self.state.exists() else None
        at, step, since, told = known if known else (now, -1, now, "[]")
        newest = max((int(s) for pdf in rows for s in pdf["step"].dropna()), default=step)
        reported, findings = json.loads(told), []
        if newest > step:
            if "stalled" in reported:
                findings.append(("resumed", newest, now - since))
            step, since, reported = newest, now, [r for r in reported if r != "stalled"]
        if "silent" in reported:
            findings.append(("back", step, now - at))
            reported.remove("silent")
        self.state.update((now, step, since, json.dumps(reported)))
        self._put_off(now, now, since, reported)
        yield from self._rows(key, findings)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.state.exists():
            return
        now = timerValues.getCurrentProcessingTimeInMs()
        at, step, since, told = self.state.get()
        reported, findings = json.loads(told), []
        # A timer may come late, so a run is never forgotten before it was reported.
        if now - at >= self.silent_ms + self.forget_ms and "silent" in reported:
            self.state.clear()
            return
        if now - at >= self.silent_ms and "silent" not in reported:
            findings.append(("silent", step, now - at))
            reported.append("silent")
        if now - since >= self.stalled_ms and at > since and "stalled" not in reported:
            findings.append(("stalled", step, now - since))
            reported.append("stalled")
        self.state.update((at, step, since, json.dumps(reported)))
        self._put_off(now, at, since, reported)
        yield from self._rows(key, findings)


def watch_runs(rows: DataFrame, silent_ms: int = SILENT_MS, stalled_ms: int = STALLED_MS, forget_ms: int = 24 * 3_600_000) -> DataFrame:
    """run_id, stage, finding (silent, stalled, back, resumed), step, waited_ms of streamed rows (run_id, stage, step).

    Time is the cluster's, not the rows': a run which sends nothing more is reported by its timer. Needs `use_timers`.
    """
    thin = rows.selectExpr("CAST(run_id AS STRING) AS run_id", "CAST(stage AS STRING) AS stage", "CAST(step AS LONG) AS step")
    return thin.groupBy("run_id", "stage").transformWithStateInPandas(RunWatch(silent_ms, stalled_ms, forget_ms), FINDINGS, "Update", "processingTime")
