"""Alert rules and their state machine, in batch and streaming with the same step."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: (rule, alert type, severity, measure, threshold): raised while the measure is over the threshold (fixed values).
RULES = (
    ("high_error_rate", "ERROR_RATE", "ERROR", "error_rate", 0.1),
    ("high_response_time", "PERFORMANCE", "WARNING", "avg_response_time_ms", 5000.0),
    ("high_memory_usage", "RESOURCE_USAGE", "WARNING", "memory_usage_mb", 1000.0),
    ("high_cpu_usage", "RESOURCE_USAGE", "WARNING", "cpu_usage_percent", 80.0),
    ("embedding_service_unhealthy", "SERVICE_HEALTH", "CRITICAL", "embedding_service_down", 0.5),
    ("database_connection_failed", "SERVICE_HEALTH", "CRITICAL", "database_down", 0.5),
    ("high_secrets_detected", "SECURITY", "WARNING", "secrets_detected_count", 10.0),
)
COOLDOWN = 900
OUT = "rule string, alert_type string, severity string, at double, event string, value double"


def step(state: tuple[float, bool], at: float, over: bool, cooldown: float = COOLDOWN) -> tuple[tuple[float, bool], str | None]:
    """(last trigger, active) and the event: triggered unless within the cooldown of the last one, resolved when the condition clears."""
    last, active = state
    if over and not active and at - last >= cooldown:
        return (at, True), "triggered"
    if not over and active:
        return (last, False), "resolved"
    return state, None


def evaluated(measures: DataFrame, rules=RULES) -> DataFrame:
    """Rows (rule, alert_type, severity, at, over, value) of measures (name, at, value) that a rule watches."""
    table = measures.sparkSession.createDataFrame(list(rules), "rule string, alert_type string, severity string, name string, threshold double")
    return measures.join(F.broadcast(table), "name").select("rule", "alert_type", "severity", F.col("at").cast("double").alias("at"), (F.col("value") > F.col("threshold")).alias("over"), F.col("value").cast("double").alias("value"))


def events(rows: DataFrame, cooldown: float = COOLDOWN) -> DataFrame:
    """Alert events of a batch of evaluated rows, rule by rule in time order."""

    def run(key: tuple, rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, out = (float("-inf"), False), []
        for part in rows:
            for r in part.sort_values("at").itertuples():
                state, event = step(state, r.at, bool(r.over), cooldown)
                if event:
                    out.append((r.rule, r.alert_type, r.severity, r.at, event, r.value))
        yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in OUT.split(", ")])

    def whole(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return next(run(key, iter([rows])))

    return rows.groupBy("rule").applyInPandas(whole, OUT)


def stream_events(rows: DataFrame, cooldown: float = COOLDOWN) -> DataFrame:
    """Alert events of a stream of evaluated rows; a rule's state is its last trigger and whether it is active."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else (float("-inf"), False)
        out = []
        for part in parts:
            for r in part.sort_values("at").itertuples():
                now, event = step(tuple(now), r.at, bool(r.over), cooldown)
                if event:
                    out.append((r.rule, r.alert_type, r.severity, r.at, event, r.value))
        state.update(tuple(now))
        yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in OUT.split(", ")])

    return rows.groupBy("rule").applyInPandasWithState(run, OUT, "last double, active boolean", "append", GroupStateTimeout.NoTimeout)
