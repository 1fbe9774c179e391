"""History of runs, logs, alerts and health: appended tables and the reports over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Severities from the worst on.
SEVERITIES = ("CRITICAL", "ERROR", "WARNING", "INFO")


def append(history: DataFrame | None, rows: DataFrame) -> DataFrame:
    """A history with further rows; columns that one side lacks are null."""
    return rows if history is None else history.unionByName(rows, allowMissingColumns=True)


def retained(history: DataFrame, ts: str, days: int) -> DataFrame:
    """Rows at most ``days`` older than the newest one."""
    newest = history.agg(F.max(ts).alias("newest_"))
    return history.join(F.broadcast(newest), F.col(ts) >= F.col("newest_") - F.make_dt_interval(F.lit(days))).drop("newest_")


def latest(history: DataFrame, groups: list[str], ts: str, tie: str, n: int) -> DataFrame:
    """The newest n rows of each group with their rank from 1."""
    order = Window.partitionBy(*groups).orderBy(F.desc(ts), F.desc(tie))
    return history.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def active_alerts(alerts: DataFrame, limit: int = 100) -> DataFrame:
    """Alerts that aren't resolved, the worst first, then the newest, then by id."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity")), F.lit(99))
    return alerts.where(F.col("resolved_at").isNull()).orderBy(F.when(rank == 0, 99).otherwise(rank), F.desc("triggered_at"), "alert_id").limit(limit)


def error_window(errors: DataFrame, groups: list[str], ts: str, minutes: int) -> DataFrame:
    """n, first, last and rate a minute of the errors within ``minutes`` of the newest one."""
    newest = errors.agg(F.max(ts).alias("newest_"))
    near = errors.join(F.broadcast(newest), F.col(ts) > F.col("newest_") - F.make_dt_interval(mins=F.lit(minutes)))
    return near.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"), F.round(F.count(F.lit(1)) / F.lit(minutes), 6).alias("per_minute"))


def log_errors(logs: DataFrame, groups: list[str], message: str) -> DataFrame:
    """Errors and different messages by group, and the most frequent message (ties: the smallest)."""
    counted = logs.groupBy(*groups, message).agg(F.count(F.lit(1)).alias("c"))
    top = F.min_by(message, F.struct(-F.col("c"), F.col(message)))
    return counted.groupBy(*groups).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("messages"), top.alias("top_message"))


def state_summary(states: DataFrame, hash_column: str) -> DataFrame:
    """Files, different contents and the largest path of each project's state."""
    return states.groupBy("project_id").agg(F.count(F.lit(1)).alias("files"), F.count_distinct(hash_column).alias("contents"), F.max("file_path").alias("last_path"))


def embedding_metrics(rows: DataFrame, groups: list[str], tokens: str, failed: Column) -> DataFrame:
    """total, failed, tokens, mean tokens and success rate of embedded rows."""
    bad = F.count(F.when(failed, 1))
    return rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("total"), bad.alias("failed"), F.sum(tokens).alias("tokens"), F.round(F.avg(tokens), 6).alias("avg_tokens"), F.round((F.count(F.lit(1)) - bad) / F.count(F.lit(1)), 6).alias("success_rate"))


def json_lines(rows: DataFrame, *columns: str) -> DataFrame:
    """One JSON object a row, its keys in the order given; what a log or metrics sink writes."""
    return rows.select(F.to_json(F.struct(*columns)).alias("line"))


def benchmark_summary(runs: DataFrame, groups: list[str], value: str, ok: Column) -> DataFrame:
    """n, ok, min, max, mean and nearest-rank median and p95 of the successful runs of each group."""
    from .monitoring import nearest_rank

    good = runs.where(ok)
    base = runs.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(ok, 1)).alias("ok"))
    facts = good.groupBy(*groups).agg(F.min(value).alias("min"), F.max(value).alias("max"), F.round(F.avg(value), 6).alias("mean"))
    return base.join(facts, groups).join(nearest_rank(good, groups, value, {"median": 0.5, "p95": 0.95}), groups)
