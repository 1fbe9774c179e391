"""Batch monitoring over request, metric and error tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Cells into which the values of a group are cut to find the one that holds a rank.
CELLS = 1024


def nearest_rank(rows: DataFrame, groups: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Nearest-rank percentiles: sorted[min(floor(p * n), n - 1)] of each group.

    A histogram of CELLS cells tells which cell holds a wanted rank; only the
    values of such cells are ordered, counted first. So no task holds a group.
    """
    good = rows.where(F.col(value).isNotNull()).select(*groups, F.col(value).alias("v_"))
    span = good.groupBy(*groups).agg(F.min("v_").alias("lo_"), F.max("v_").alias("hi_"), F.count(F.lit(1)).alias("n_"))
    lo, hi, v = (F.col(c).cast("double") for c in ("lo_", "hi_", "v_"))
    cell = F.when(hi > lo, F.coalesce(F.least(F.floor((v - lo) / (hi - lo) * CELLS), F.lit(CELLS - 1)), F.lit(0))).otherwise(F.lit(0)).cast("int")
    celled = good.join(span, groups).withColumn("cell_", cell)
    so_far = Window.partitionBy(*groups).orderBy("cell_").rowsBetween(Window.unboundedPreceding, 0)
    cells = celled.groupBy(*groups, "cell_").agg(F.count(F.lit(1)).alias("c_"), F.first("n_").alias("n_")).withColumn("up_", F.sum("c_").over(so_far))
    names = F.explode(F.array(*[F.struct(F.lit(name).alias("name_"), F.least(F.floor(F.col("n_") * F.lit(p)), F.col("n_") - 1).alias("aim_")) for name, p in shares.items()]))
    asked = cells.select(*groups, "cell_", "up_", "c_", names.alias("x_")).select(*groups, "cell_", "up_", "c_", "x_.*")
    asked = asked.where((F.col("up_") > F.col("aim_")) & (F.col("up_") - F.col("c_") <= F.col("aim_"))).select(*groups, "cell_", "name_", (F.col("aim_") - F.col("up_") + F.col("c_")).alias("aim_"))
    inside = celled.join(asked.select(*groups, "cell_").distinct(), [*groups, "cell_"], "left_semi").groupBy(*groups, "cell_", "v_").agg(F.count(F.lit(1)).alias("c_"))
    ranked = inside.withColumn("up_", F.sum("c_").over(Window.partitionBy(*groups, "cell_").orderBy("v_").rowsBetween(Window.unboundedPreceding, 0)))
    found = ranked.join(asked, [*groups, "cell_"]).where(F.col("up_") > F.col("aim_"))
    return found.groupBy(*groups).agg(*[F.min(F.when(F.col("name_") == name, F.col("v_"))).alias(name) for name in shares])


def performance(requests: DataFrame, groups: list[str]) -> DataFrame:
    """total, ok (< 400), failed, avg, p95, p99 of duration_ms by group."""
    base = requests.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("total"),
        F.count(F.when(F.col("status_code") < 400, 1)).alias("ok"),
        F.count(F.when(F.col("status_code") >= 400, 1)).alias("failed"),
        F.round(F.avg("duration_ms"), 6).alias("avg_ms"),
    )
    return base.join(nearest_rank(requests, groups, "duration_ms", {"p95": 0.95, "p99": 0.99}), groups)


def trailing(rows: DataFrame, seconds: int, value: Column, name: str, groups: list[str], ts: str = "ts", how=F.avg) -> DataFrame:
    """``rows`` with an aggregate over the last ``seconds`` of each group, the row's own instant included.

    Time is cut into buckets as long as the window, and a row takes part in its
    own and the next one, so a busy group is as many tasks as it has buckets.
    """
    size = seconds * 1_000_000
    bucket = F.floor(F.unix_micros(ts) / size)
    both = rows.withColumns({"us_": F.unix_micros(ts), "own_": bucket}).withColumn("bucket_", F.explode(F.array_distinct(F.array(F.col("own_"), F.col("own_") + 1))))
    w = Window.partitionBy(*groups, "bucket_").orderBy("us_").rangeBetween(-size, 0)
    return both.withColumn(name, F.round(how(value).over(w), 6)).where(F.col("own_").eqNullSafe(F.col("bucket_"))).drop("us_", "own_", "bucket_")


def last_of_each(rows: DataFrame, groups: list[str], n: int, ts: str, tie: str) -> DataFrame:
    """The newest n rows of each group (a ring buffer)."""
    rank = F.row_number().over(Window.partitionBy(*groups).orderBy(F.desc(ts), F.desc(tie)))
    return rows.withColumn("rn_", rank).where(F.col("rn_") <= n).drop("rn_")


def operation_stats(rows: DataFrame, operation: str, value: str, ts: str, tie: str, n: int = 100) -> DataFrame:
    """count, avg, min, max, total over the last n of each operation."""
    return last_of_each(rows, [operation], n, ts, tie).groupBy(operation).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 6).alias("avg"), F.min(value).alias("min"), F.max(value).alias("max"), F.round(F.sum(value), 6).alias("total"))


def metric_summary(rows: DataFrame, name: str, value: str, ts: str, tie: str) -> DataFrame:
    """count, min, max, avg, sum and the latest value of each metric."""
    return rows.groupBy(name).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.round(F.avg(value), 6).alias("avg"), F.round(F.sum(value), 6).alias("sum"), F.max_by(value, F.struct(ts, tie)).alias("latest"))


def prometheus(rows: DataFrame) -> DataFrame:
    """Text lines: the latest value of each name and label set; counters end in _total, histograms in _bucket."""
    labels = F.array_join(F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"'))), ",")
    latest = rows.withColumn("l_", labels).groupBy("name", "type", "l_").agg(F.max_by("value", "ts").alias("value"))
    suffix = F.when(F.col("type") == "counter", "_total").when(F.col("type") == "histogram", "_bucket").otherwise("")
    return latest.select(F.concat(F.col("name"), suffix, F.when(F.col("l_") == "", "").otherwise(F.concat(F.lit("{"), F.col("l_"), F.lit("}"))), F.lit(" "), F.col("value").cast("string")).alias("line"))


def health_vote(unhealthy: Column, degraded: Column, total: Column) -> Column:
    """unknown of nothing; healthy; degraded if under half are unhealthy; else unhealthy."""
    return F.when(total == 0, "unknown").when((unhealthy == 0) & (degraded == 0), "healthy").when(unhealthy * 2 < total, "degraded").otherwise("unhealthy")


def error_health(critical: Column, high: Column, per_minute: Column) -> Column:
    """critical errors, then many high ones or a high rate."""
    return F.when(critical > 0, "critical").when((high > 5) | (per_minute > 10), "degraded").otherwise("healthy")


def running_mean(rows: DataFrame, groups: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """``rows`` with the mean so far, from an exact decimal sum."""
    w = Window.partitionBy(*groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.round(F.sum(F.col(value).cast("decimal(18,6)")).over(w).cast("double") / F.count(F.lit(1)).over(w), 6))


def alert_summary(alerts: DataFrame) -> DataFrame:
    """Counts and mean resolution seconds by type and severity."""
    took = F.col("resolved_at").cast("double") - F.col("triggered_at").cast("double")
    return alerts.groupBy("alert_type", "severity").agg(F.count(F.lit(1)).alias("n"), F.count("resolved_at").alias("resolved"), F.round(F.avg(took), 6).alias("avg_resolution_s"))
