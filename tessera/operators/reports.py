"""Reports of one row or one row a group: projects, runs, errors, metrics, secrets; and filtered reads of logs and alerts.

Histograms come from one pass with grouping sets and are maps of small domains
(languages, layers, severities). Windows end at the newest row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import glob_regex
from . import history, monitoring
from .stats import run_status
from .store import Store, matching


def histograms(rows: DataFrame, groups: list[str], facets: list[str], unknown: str = "unknown") -> DataFrame:
    """groups and, for each facet, a map of its values to their rows."""
    g = [F.col(c) for c in groups]
    values = rows.select(*groups, *[F.coalesce(F.col(c).cast("string"), F.lit(unknown)).alias(c) for c in facets])
    sets = values.groupingSets([[*g, F.col(c)] for c in facets], *g, *map(F.col, facets)).agg(F.count(F.lit(1)).alias("n_"))
    entry = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("key"), F.col("n_").alias("value")))
    return sets.groupBy(*groups).agg(*[F.map_from_entries(F.array_sort(F.collect_list(entry(c)))).alias(c) for c in facets])


def spelled(histogram: Column | str) -> Column:
    """``key:n`` of a histogram, comma-joined by key."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(histogram)), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",")


def project_report(chunks: DataFrame) -> DataFrame:
    """project_id (null is default), chunks, files, tokens, avg_tokens, last_updated, and histograms of language and layer_type."""
    rows = chunks.withColumn("project_id", F.coalesce("project_id", F.lit("default")))
    base = rows.groupBy("project_id").agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct(F.nullif(F.col("file_path"), F.lit(""))).alias("files"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("tokens"), F.round(F.avg("token_count"), 6).alias("avg_tokens"), F.max("last_updated").alias("last_updated"))
    return base.join(histograms(rows, ["project_id"], ["language", "layer_type"]), "project_id")


def run_report(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row of a run: files (path, error), chunks (language, layer_type, sensitivity_level, masked_count, embedding_status): counts, status, rates, histograms."""
    f = files.agg(F.count(F.lit(1)).alias("files"), F.count("error").alias("failed_files"))
    c = chunks.agg(F.count(F.lit(1)).alias("chunks"), F.count_if(F.col("embedding_status") == "completed").alias("embedded"), F.coalesce(F.sum("masked_count"), F.lit(0)).cast("long").alias("secrets"))
    share = lambda a, b: F.round(F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0), 6)
    row = f.crossJoin(c).withColumns({"status": run_status(F.col("files"), F.col("failed_files")), "success_rate": share("embedded", "chunks")})
    return row.join(histograms(chunks, [], ["language", "layer_type", "sensitivity_level"]), F.lit(True), "left")


def embedding_report(requests: DataFrame, groups: list[str], ts: str, seconds: str, ok: Column, hit: Column) -> DataFrame:
    """groups, total, failed, success_rate, avg_seconds of the successful ones, hit_rate, per_minute between the first and the last request."""
    n = F.count(F.lit(1))
    span = (F.unix_micros(F.max(ts)) - F.unix_micros(F.min(ts))) / 60e6
    return requests.groupBy(*groups).agg(n.alias("total"), F.count_if(~ok).alias("failed"), F.round(F.count_if(ok) / n, 6).alias("success_rate"), F.round(F.avg(F.when(ok, F.col(seconds))), 6).alias("avg_seconds"), F.round(F.count_if(hit) / n, 6).alias("hit_rate"), F.round(F.when(span > 0, n / span).otherwise(n.cast("double")), 6).alias("per_minute"))


def newest(rows: DataFrame, ts: str, seconds: int | None) -> DataFrame:
    """Rows of the last ``seconds`` before the newest one (all, without a window)."""
    if seconds is None:
        return rows
    end = rows.agg(F.max(ts).alias("end_"))
    return rows.crossJoin(F.broadcast(end)).where(F.unix_micros(ts) > F.unix_micros("end_") - seconds * 1_000_000).drop("end_")


def metric_summary(rows: DataFrame, name: str, value: str, ts: str, tie: str, seconds: int | None = None) -> DataFrame:
    """:func:`tessera.operators.monitoring.metric_summary` in a window."""
    return monitoring.metric_summary(newest(rows, ts, seconds), name, value, ts, tie)


def performance(requests: DataFrame, groups: list[str], ts: str = "ts", seconds: int | None = 300) -> DataFrame:
    """:func:`tessera.operators.monitoring.performance` of the last five minutes."""
    return monitoring.performance(newest(requests, ts, seconds), groups)


def error_report(errors: DataFrame, category: str | None = None, severity: str | None = None, seconds: int | None = None, ts: str = "ts") -> DataFrame:
    """One row of errors (ts, category, severity, error_type): total, first_seen, last_seen, per_minute, and histograms of the three, of those that pass the filters."""
    rows = errors if category is None else errors.where(F.col("category") == category)
    rows = newest(rows if severity is None else rows.where(F.col("severity") == severity), ts, seconds)
    span = F.lit(seconds / 60.0) if seconds else F.greatest((F.unix_micros(F.max(ts)) - F.unix_micros(F.min(ts))) / 60e6, F.lit(1.0))
    base = rows.agg(F.count(F.lit(1)).alias("total"), F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"), F.round(F.count(F.lit(1)) / span, 6).alias("per_minute"))
    return base.join(histograms(rows, [], ["category", "severity", "error_type"]), F.lit(True), "left")


def secret_report(scanned: DataFrame, path: str = "file_path", most: int = 10) -> DataFrame:
    """One row of scanned chunks: histograms of sensitivity, secret type and pattern, and the ``most`` files of highest risk (path, high chunks, secrets)."""
    levels = histograms(scanned, [], ["sensitivity_level"])
    found = scanned.select(F.explode("secrets").alias("s")).select(F.col("s.secret_type").alias("secret_type"), F.col("s.pattern_name").alias("pattern_name"))
    risky = scanned.groupBy(path).agg(F.count_if(F.col("sensitivity_level") == "HIGH").alias("high"), F.coalesce(F.sum("masked_count"), F.lit(0)).cast("long").alias("secrets")).where("high > 0").orderBy(F.desc("high"), F.desc("secrets"), path).limit(most)
    listed = risky.agg(F.array_sort(F.collect_list(F.struct((-F.col("high")).alias("o"), (-F.col("secrets")).alias("p"), F.col(path).alias("path")))).alias("x")).select(F.transform("x", lambda e: F.struct(e["path"].alias("path"), (-e["o"]).alias("high"), (-e["p"]).alias("secrets"))).alias("high_risk"))
    return listed.join(levels, F.lit(True), "left").join(histograms(found, [], ["secret_type", "pattern_name"]), F.lit(True), "left")


# filtered reads


def active_alerts(alerts: DataFrame, alert_type: str | None = None, severity: str | None = None, limit: int = 100) -> DataFrame:
    """Alerts that aren't resolved, of a type and severity if given, the worst first."""
    wanted = {k: v for k, v in (("alert_type", alert_type), ("severity", severity)) if v is not None}
    return history.active_alerts(alerts.where(matching(wanted)), limit)


def recent_logs(logs: DataFrame, ts: str, tie: str, limit: int = 100, level: str | None = None, hours: float | None = None) -> DataFrame:
    """The newest ``limit`` logs of a level within some hours of the newest of all."""
    rows = newest(logs, ts, None if hours is None else int(hours * 3600))
    return (rows if level is None else rows.where(F.col("level") == level)).orderBy(F.desc(ts), F.desc(tie)).limit(limit)


def exported_logs(logs: DataFrame, ts: str, *columns: str, level: str | None = None, hours: float | None = None) -> DataFrame:
    """Logs of a level within some hours of the newest one as JSON lines."""
    rows = newest(logs, ts, None if hours is None else int(hours * 3600))
    return history.json_lines(rows if level is None else rows.where(F.col("level") == level), *columns)


def metadata_page(rows: DataFrame, filters: dict, globs: tuple[str, ...] = (), path: str = "file_path", key: str = "chunk_id", offset: int = 0, limit: int = 100) -> DataFrame:
    """A page of the rows with the given values and a path that one of the globs fits, by key."""
    found = rows.where(matching(filters))
    if globs:
        found = found.where(F.col(path).rlike("|".join(f"(?:{glob_regex(g)})" for g in globs)))
    return found.orderBy(key).offset(offset).limit(limit)


def append_new(store: Store, rows: DataFrame) -> tuple[int, int]:
    """Append rows whose key the store doesn't have; (appended, refused). Of repeated new keys one row stays."""
    held, once = store.read(), rows.dropDuplicates([store.key])
    new = once if held is None else once.join(held.select(store.key), store.key, "left_anti")
    total, before = rows.count(), 0 if held is None else held.count()
    if not new.isEmpty():
        store.upsert(new)
    added = store.read().count() - before if store.read() is not None else 0
    return added, total - added


def rendered(rows: DataFrame, form: str = "table", width: int = 40) -> DataFrame:
    """``line`` of every row as JSON, as ``table`` cells of a fixed width, or ``simple`` (values between blanks); what a command prints."""
    if form == "json":
        return rows.select(F.to_json(F.struct(*rows.columns)).alias("line"))
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns]
    if form == "simple":
        return rows.select(F.concat_ws(" ", *text).alias("line"))
    if form != "table":
        raise ValueError(f"unknown form {form!r}")
    cell = lambda c: F.rpad(F.when(F.length(c) > width, F.concat(F.substring(c, 1, width - 2), F.lit(".."))).otherwise(c), width, " ")
    return rows.select(F.rtrim(F.concat_ws(" ", *map(cell, text))).alias("line"))
