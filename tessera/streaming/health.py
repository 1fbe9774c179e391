"""Health of components over time, and samples of the machine: one step for batch and stream.

A check reports the status of a component. Its health changes when a check says
so, and when checks stop: a component that has been silent for ``silent``
seconds is unhealthy from then on, until the next check. In a stream a timer
says so, even if nothing else comes. With event time the outcome doesn't depend
on how the checks are cut into batches, and equals that of a table.
"""

from __future__ import annotations

import os
import resource
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.monitoring import health_vote

#: Seconds without a check after which a component counts as unhealthy, and after which it is forgotten (live streams).
SILENT, FORGET = 120.0, 24 * 3600.0
OUT = "component string, at double, status string, reason string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def step(state: tuple[str, float, bool] | None, at: float, status: str, silent: float = SILENT) -> tuple[tuple[str, float, bool], list[tuple[float, str, str]]]:
    """(status, last check, whether silence was told) and the changes that a check at ``at`` makes; checks older than the last one change nothing."""
    if state is None:
        return (status, at, False), [(at, status, "first")]
    shown, last, told = state
    if at < last:
        return state, []
    out = []
    if at - last >= silent and not told:
        out.append((last + silent, "unhealthy", "silent"))
        told = True
    if status != shown or told:
        out.append((at, status, "check"))
    return (status, at, False), out


def expired(state: tuple[str, float, bool] | None, now: float, silent: float = SILENT) -> tuple[tuple[str, float, bool] | None, list[tuple[float, str, str]]]:
    """The change that a timer makes, if the component is silent still."""
    if state is None or state[2] or state[1] + silent > now:
        return state, []
    return (state[0], state[1], True), [(state[1] + silent, "unhealthy", "silent")]


def changes(checks: DataFrame, silent: float = SILENT) -> DataFrame:
    """Changes of health in a table of checks (component, at in seconds, status); silences that end after the last check of all are open and left out.

    Rows of one component are ordered in one window; of checks at the same
    instant the last by status counts last.
    """
    end = checks.agg(F.max("at")).alias("e").toDF("end_")
    order = Window.partitionBy("component").orderBy("at", "status")
    rows = checks.select("component", F.col("at").cast("double").alias("at"), "status").withColumns({"was": F.lag("status").over(order), "next": F.lead("at").over(order), "last": F.lag("at").over(order)})
    told = F.coalesce(F.col("at") - F.col("last") >= silent, F.lit(False))
    own = rows.where(F.col("was").isNull() | (F.col("status") != F.col("was")) | told).select("component", "at", "status", F.when(F.col("was").isNull(), "first").otherwise("check").alias("reason"))
    quiet = rows.crossJoin(F.broadcast(end)).where(F.coalesce("next", "end_") - F.col("at") >= silent)
    return own.unionByName(quiet.select("component", (F.col("at") + silent).alias("at"), F.lit("unhealthy").alias("status"), F.lit("silent").alias("reason")))


class HealthProcessor(StatefulProcessor):
    """The state machine of one component, with a timer at the end of the silence that is allowed."""

    def __init__(self, silent: float = SILENT, forget: float | None = None):
        self.silent, self.forget = silent, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        ttl = None if self.forget is None else int(self.forget * 1000)
        self.state = handle.getValueState("state", "status string, at double, told boolean", ttl)

    def _timer(self, at: float) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(int(at * 1000) + 1)

    def _out(self, key: tuple, rows: list[tuple[float, str, str]]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *r) for r in rows], columns=["component", "at", "status", "reason"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state, out = tuple(self.state.get()) if self.state.exists() else None, []
        every = pd.concat(list(rows)).sort_values(["at", "status"])
        for at, status in zip(every["at"], every["status"]):
            state, found = step(state, float(at), status, self.silent)
            out += found
        self.state.update(state)
        if not state[2]:
            self._timer(state[1] + self.silent)
        yield self._out(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state, out = expired(tuple(self.state.get()) if self.state.exists() else None, expiredTimerInfo.getExpiryTimeInMs() / 1000, self.silent)
        if state is not None:
            self.state.update(state)
        yield self._out(key, out)

    def close(self) -> None:
        pass


def stream_changes(checks: DataFrame, silent: float = SILENT, late: str | None = "0 seconds", forget: float = FORGET) -> DataFrame:
    """Changes of health in a stream of checks (component, ts, status).

    With ``late`` time is that of the checks; with None it is the clock's, and
    components that say nothing for ``forget`` seconds lose their state.
    """
    checks.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = checks.select("component", "ts", F.unix_micros("ts").cast("double").__truediv__(1e6).alias("at"), "status")
    if late is None:
        return rows.groupBy("component").transformWithStateInPandas(HealthProcessor(silent, forget), OUT, "append", "ProcessingTime")
    return rows.withWatermark("ts", late).groupBy("component").transformWithStateInPandas(HealthProcessor(silent), OUT, "append", "EventTime")


def overall(changed: DataFrame, at: float | None = None) -> DataFrame:
    """One row: healthy, degraded, unhealthy, total and the vote, from the last change of each component (up to ``at``)."""
    rows = changed if at is None else changed.where(F.col("at") <= at)
    last = rows.groupBy("component").agg(F.max_by("status", F.struct("at", F.col("reason") != "silent")).alias("status"))
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    found = last.agg(count("healthy"), count("degraded"), count("unhealthy"), F.count(F.lit(1)).alias("total"))
    return found.withColumn("vote", health_vote(F.col("unhealthy"), F.col("degraded"), F.col("total")))


def host_measures() -> dict[str, float]:
    """Memory of this process in MB, load of the machine in percent of its cores."""
    return {"memory_usage_mb": resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024, "cpu_usage_percent": 100.0 * os.getloadavg()[0] / max(1, os.cpu_count() or 1)}


def samples(spark: SparkSession, rows_per_second: int = 1, read=host_measures) -> DataFrame:
    """name, at, value of the machine's measures, as the alert rules watch them: a stream on the clock."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).option("numPartitions", 1).load()

    def sample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                now, found = time.time(), read()
                yield pd.DataFrame([(name, now, float(v)) for name, v in found.items()], columns=["name", "at", "value"])

    return ticks.mapInPandas(sample, "name string, at double, value double")
