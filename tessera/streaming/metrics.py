"""Windowed metrics of a request stream, and incremental updates of a store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators import changes
from ..operators.store import Store


def request_windows(requests: DataFrame, late: str = "10 minutes", length: str = "5 minutes", slide: str = "1 minute") -> DataFrame:
    """Requests, failures and mean duration by sliding window and endpoint; rows later than ``late`` are out."""
    w = F.window("ts", length, slide)
    return requests.withWatermark("ts", late).groupBy(w, "endpoint").agg(F.count(F.lit(1)).alias("total"), F.count(F.when(F.col("status_code") >= 400, 1)).alias("failed"), F.avg("duration_ms").alias("avg_ms"))


def sessions(requests: DataFrame, late: str = "10 minutes", gap: str = "30 minutes") -> DataFrame:
    """Requests by user session."""
    return requests.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("total"))


def measures(windows: DataFrame) -> DataFrame:
    """name, at, value rows that the alert rules watch."""
    pairs = F.explode(F.array(F.struct(F.lit("error_rate").alias("name"), (F.col("failed") / F.col("total")).alias("value")), F.struct(F.lit("avg_response_time_ms").alias("name"), F.col("avg_ms").alias("value"))))
    return windows.select(F.unix_seconds("window.end").cast("double").alias("at"), pairs.alias("m")).select("at", "m.name", "m.value")


def update_store(changed: DataFrame, store: Store, ingest: Callable[[DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """Keep ``store`` up to date with a stream of changes (file_path, change_type, old_path, file_hash).

    Each micro-batch drops the chunks of gone and changed files and adds those
    that ``ingest`` makes of the paths to parse; a failed batch is done again
    from the checkpoint, and upserting by a deterministic id makes that safe.
    """

    def batch(rows: DataFrame, number: int) -> None:
        gone, todo = changes.work_sets(rows)
        store.replace_files(gone, ingest(todo))

    return changed.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
