"""Statistics, change detection, store and monitoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import layers
from ..functions import text as T
from ..operators import changes, chunks, monitoring, stats, store
from .search import docs

EST = "(length(text) // 4)::BIGINT"


def chunk_rows(spark, d):
    """``documents`` as chunks: source is the project, a made-up path the file."""
    return docs(spark, d).select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("project_id"), F.concat(F.col("source"), F.lit("/f"), (F.col("doc_id") % 50).cast("string"), F.lit(".py")).alias("file_path"), F.col("lang").alias("language"), T.token_estimate(F.col("text")).alias("token_count"), "text")


CHUNK = f"SELECT doc_id AS chunk_id, source AS project_id, source || '/f' || (doc_id % 50) || '.py' AS file_path, lang AS language, {EST} AS token_count, text FROM documents"


def parse_stats(spark, d):
    return stats.grouping_counts(chunk_rows(spark, d), "language", "project_id", tokens="token_count")


def old_state(spark, d):
    return docs(spark, d).where("doc_id % 10 <> 0").select(F.col("doc_id").alias("file_path"), F.md5("text").alias("file_hash"))


def new_state(spark, d):
    return docs(spark, d).where("doc_id % 10 <> 1").select(F.col("doc_id").alias("file_path"), F.md5(F.concat("text", F.when(F.col("doc_id") % 7 == 0, "x").otherwise(""))).alias("file_hash"))


OLD = "o AS (SELECT doc_id AS file_path, md5(text) AS h FROM documents WHERE doc_id % 10 <> 0)"
NEW = "n AS (SELECT doc_id AS file_path, md5(text || CASE WHEN doc_id % 7 = 0 THEN 'x' ELSE '' END) AS h FROM documents WHERE doc_id % 10 <> 1)"
DIFF = f"{OLD}, {NEW}, c AS (SELECT coalesce(o.file_path, n.file_path) AS file_path, CASE WHEN o.file_path IS NULL THEN 'added' WHEN n.file_path IS NULL THEN 'deleted' WHEN o.h <> n.h THEN 'modified' END AS change_type, coalesce(n.h, o.h) AS file_hash FROM o FULL OUTER JOIN n ON o.file_path = n.file_path)"


def snapshot_diff(spark, d):
    return changes.snapshot_diff(old_state(spark, d), new_state(spark, d))


def delete_set(spark, d):
    return changes.work_sets(snapshot_diff(spark, d))[0]


def process_set(spark, d):
    return changes.work_sets(snapshot_diff(spark, d))[1]


def commit_range(spark, d):
    touched = docs(spark, d).where("doc_id % 3 = 0").select(F.col("doc_id").alias("file_path"))
    return changes.commit_range(touched, old_state(spark, d).select("file_path"), new_state(spark, d))


def upsert_result(spark, d):
    old = old_state(spark, d).withColumnRenamed("file_path", "chunk_id")
    return store.upserted(old, new_state(spark, d).withColumnRenamed("file_path", "chunk_id"))


def antijoin_delete(spark, d):
    rows = docs(spark, d).select("doc_id", "source")
    return store.without(rows, docs(spark, d, "labels").where("quality = 0").select("doc_id"), "doc_id")


def delete_by_metadata(spark, d):
    return docs(spark, d).where(~store.matching({"lang": "fr"})).select("doc_id", "lang")


def requests(spark, d):
    """``events`` as requests."""
    return docs(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", F.col("event_type").alias("endpoint"), F.col("value").alias("duration_ms"), F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status_code"))


REQ = "r AS (SELECT event_id, ts, user_id, event_type AS endpoint, value AS duration_ms, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status_code FROM events)"


def perf_snapshot(spark, d):
    return monitoring.performance(requests(spark, d), ["endpoint"])


def error_rate_trailing(spark, d):
    rows = monitoring.trailing(requests(spark, d), 300, (F.col("status_code") >= 400).cast("double"), "error_rate", ["user_id"])
    return rows.select("event_id", "error_rate")


def rolling_rate_60s(spark, d):
    rows = monitoring.trailing(requests(spark, d), 60, F.col("event_id"), "n", ["endpoint"], how=F.count)
    return rows.select("event_id", F.col("n").cast("long").alias("n"))


def top_errors(spark, d):
    return docs(spark, d, "events").where("event_type = 'error'").groupBy("props").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "props").limit(10)


def operation_stats(spark, d):
    return monitoring.operation_stats(requests(spark, d), "endpoint", "duration_ms", "ts", "event_id")


def metric_summary(spark, d):
    return monitoring.metric_summary(requests(spark, d), "endpoint", "duration_ms", "ts", "event_id")


def recent_errors(spark, d):
    return monitoring.last_of_each(requests(spark, d).where("status_code >= 400"), ["user_id"], 3, "ts", "event_id").select("user_id", "event_id")


def prometheus_latest(spark, d):
    rows = docs(spark, d, "events").select(F.col("event_id").alias("ts"), F.col("event_type").alias("name"), F.when(F.col("event_type") == "click", "counter").otherwise("gauge").alias("type"), F.col("user_id").cast("double").alias("value"), F.create_map(F.lit("shard"), (F.col("user_id") % 4).cast("string")).alias("labels"))
    return monitoring.prometheus(rows)


def error_stats(spark, d):
    rows = requests(spark, d).select(F.col("endpoint").alias("category"), F.when(F.col("duration_ms") > 100, "high").otherwise("low").alias("severity"))
    return stats.grouping_counts(rows, "category", "severity")


def health_vote(spark, d):
    state = F.when(F.col("duration_ms") > 150, "unhealthy").when(F.col("duration_ms") > 100, "degraded").otherwise("healthy")
    counts = requests(spark, d).groupBy("user_id").agg(*[F.count(F.when(state == s, 1)).alias(s) for s in ("healthy", "degraded", "unhealthy")])
    return counts.withColumn("status", monitoring.health_vote(F.col("unhealthy"), F.col("degraded"), F.col("healthy") + F.col("degraded") + F.col("unhealthy")))


def alert_summary(spark, d):
    rows = docs(spark, d, "events").select(F.col("event_type").alias("alert_type"), F.when(F.col("user_id") % 2 == 0, "ERROR").otherwise("WARNING").alias("severity"), F.col("ts").cast("timestamp").alias("triggered_at"), F.when(F.col("event_id") % 3 != 0, F.timestamp_seconds(F.floor(F.col("ts").cast("timestamp").cast("double")) + F.col("user_id"))).alias("resolved_at"))
    return monitoring.alert_summary(rows.withColumn("triggered_at", F.date_trunc("second", "triggered_at")))


def update_running_mean(spark, d):
    return monitoring.running_mean(requests(spark, d).where("status_code < 400"), ["user_id"], ["ts", "event_id"], "duration_ms", "mean").select("event_id", "mean")


def pipeline_status(spark, d):
    rows = docs(spark, d).join(docs(spark, d, "labels"), "doc_id", "left").groupBy("source").agg(F.count(F.lit(1)).alias("total"), F.count(F.when(F.col("quality") == 0, 1)).alias("failed"))
    return rows.withColumn("status", stats.run_status(F.col("total"), F.col("failed"))).withColumn("success_rate", stats.rate(F.col("total") - F.col("failed"), F.col("total")))


def style_lint(spark, d):
    return docs(spark, d).select("doc_id", T.style_lint(F.col("text")).alias("s")).select("doc_id", "s.long_lines", "s.trailing_blanks", "s.mixed_indent", "s.longest_line", F.array_join("s.issues", ",").alias("issues"))


def line_metrics(spark, d):
    return docs(spark, d).select("doc_id", T.line_metrics(F.col("text")).alias("m")).select("doc_id", "m.*")


def retry_delay(spark, d):
    return docs(spark, d, "region").select("r_regionkey", T.retry_delay(F.col("r_regionkey") * 2).alias("delay"))


def durations(spark, d):
    return docs(spark, d, "events").select("event_id", T.format_duration(F.floor(F.col("value")) * 31 - 200).alias("took"))


def paths(spark, d):
    name = F.element_at(F.array(*map(F.lit, ("models.py", "views.py", "user_service.py", "settings.py", "Foo.java", "index.html", "tests/test_x.py", "utils/a.py", "urls.py", "build.gradle"))), (F.col("doc_id") % 10 + 1).cast("int"))
    folder = F.element_at(F.array(*map(F.lit, ("app", "target", "src", "venv", "lib/migrations", "node_modules", "services"))), (F.col("doc_id") % 7 + 1).cast("int"))
    return docs(spark, d).select("doc_id", F.concat_ws("/", F.col("source"), folder, name).alias("path"))


PATHS = "p AS (SELECT doc_id, source || '/' || ['app', 'target', 'src', 'venv', 'lib/migrations', 'node_modules', 'services'][(doc_id % 7 + 1)::INT] || '/' || ['models.py', 'views.py', 'user_service.py', 'settings.py', 'Foo.java', 'index.html', 'tests/test_x.py', 'utils/a.py', 'urls.py', 'build.gradle'][(doc_id % 10 + 1)::INT] AS path FROM documents)"


def layer_by_path(spark, d):
    return paths(spark, d).select("doc_id", layers.python_path_layer(F.col("path")).alias("layer"))


def layer_sql() -> str:
    when = []
    for layer, parts, stems, starts, ends in layers.PYTHON_PATHS:
        cond = [f"contains(lp, '{p}')" for p in parts] + [f"stem = '{s}'" for s in stems] + [f"starts_with(stem, '{s}')" for s in starts] + [f"ends_with(stem, '{s}')" for s in ends]
        when.append(f"WHEN {' OR '.join(cond)} THEN '{layer}'")
    return f"WITH {PATHS}, l AS (SELECT doc_id, lower(path) AS lp, regexp_replace(lower(regexp_extract(path, '([^/]*)$', 1)), '\\.[^.]*$', '') AS stem FROM p) SELECT doc_id, CASE {' '.join(when)} ELSE 'Unknown' END AS layer FROM l"


def spring_layer(spark, d):
    return docs(spark, d).select("doc_id", layers.spring_layer(F.concat(F.lit("Order"), F.element_at(F.array(*map(F.lit, ("Controller", "Service", "Dao", "Model", "Setup", "Helper", "Thing"))), (F.col("doc_id") % 7 + 1).cast("int"))), F.when(F.col("doc_id") % 5 == 0, "@Test").otherwise("x")).alias("layer"))


def ignore_predicate(spark, d):
    return paths(spark, d).select("doc_id", layers.ignored(F.col("path")).alias("ignored"))


def primary_language(spark, d):
    return layers.primary_language(paths(spark, d))


def project_type(spark, d):
    return layers.project_type(paths(spark, d))


def glob_filter(spark, d):
    return paths(spark, d).where(changes.included(F.col("path"), ("*.py",), ("venv/", "target/"))).select("doc_id")


def line_chunks(spark, d):
    return chunks.chunked(docs(spark, d), ["doc_id"]).select("doc_id", "chunk_no", "start_line", "end_line", "token_count", F.md5("content").alias("digest"))


def error_categories(spark, d):
    text = F.element_at(F.array(*map(F.lit, ("TimeoutError", "ConnectionReset", "PermissionError", "ValueError", "sqlite3.Error", "Odd"))), (F.col("doc_id") % 6 + 1).cast("int"))
    return docs(spark, d).select("doc_id", T.error_category(text).alias("category"), T.http_status(F.when(F.col("doc_id") % 2 == 0, "NOT_FOUND").otherwise("X")).alias("status"))


LS = "list_filter(string_split(text, chr(10)), lambda x: {0})"
QUERIES = {
    "parse_stats": (parse_stats, f"WITH c AS ({CHUNK}) SELECT CASE grouping(language, project_id) WHEN 1 THEN 'language' WHEN 2 THEN 'project_id' ELSE 'all' END AS facet, CASE grouping(language, project_id) WHEN 1 THEN language WHEN 2 THEN project_id ELSE '' END AS value, count(*) AS n, sum(token_count)::BIGINT AS tokens FROM c GROUP BY GROUPING SETS ((language), (project_id), ())"),
    "project_rollup": (lambda s, d: stats.project_rollup(chunk_rows(s, d)), f"WITH c AS ({CHUNK}) SELECT coalesce(project_id, 'default') AS project_id, count(*) AS chunks FROM c GROUP BY 1"),
    "project_stats": (lambda s, d: stats.project_stats(chunk_rows(s, d)), f"WITH c AS ({CHUNK}) SELECT coalesce(project_id, 'default') AS project_id, count(*) AS chunks, count(DISTINCT nullif(file_path, '')) AS files, sum(token_count)::BIGINT AS tokens, round(avg(token_count), 6) AS avg_tokens, count(DISTINCT language) AS languages FROM c GROUP BY 1"),
    "project_details": (lambda s, d: stats.project_details(docs(s, d, "nation").select(F.concat(F.lit("src"), F.col("n_nationkey").cast("string")).alias("project_id"), F.col("n_name").alias("name")), chunk_rows(s, d)), "SELECT 'src' || n_nationkey AS project_id, n_name AS name, count(doc_id) AS chunks FROM nation LEFT JOIN documents ON source = 'src' || n_nationkey GROUP BY 1, 2"),
    "size_filter": (lambda s, d: chunks.sized(chunk_rows(s, d)).select("chunk_id", "token_count"), f"SELECT * FROM (SELECT doc_id AS chunk_id, {EST} AS token_count FROM documents) WHERE token_count BETWEEN 50 AND 500"),
    "snapshot_diff": (snapshot_diff, f"WITH {DIFF} SELECT * FROM c WHERE change_type IS NOT NULL"),
    "change_histogram": (lambda s, d: changes.histogram(snapshot_diff(s, d)), f"WITH {DIFF} SELECT change_type, count(*) AS n FROM c WHERE change_type IS NOT NULL GROUP BY 1"),
    "delete_set": (delete_set, f"WITH {DIFF} SELECT file_path FROM c WHERE change_type IN ('deleted', 'modified')"),
    "process_set": (process_set, f"WITH {DIFF} SELECT file_path FROM c WHERE change_type IN ('added', 'modified')"),
    "first_scan": (lambda s, d: changes.first_scan(new_state(s, d)), f"WITH {NEW} SELECT file_path, 'added' AS change_type, h AS file_hash FROM n"),
    "commit_range": (commit_range, f"WITH {OLD}, {NEW}, t AS (SELECT doc_id AS file_path FROM documents WHERE doc_id % 3 = 0) SELECT t.file_path, CASE WHEN o.file_path IS NULL THEN 'added' WHEN n.file_path IS NULL THEN 'deleted' ELSE 'modified' END AS change_type, n.h AS file_hash FROM t LEFT JOIN o USING (file_path) LEFT JOIN n USING (file_path) WHERE o.file_path IS NOT NULL OR n.file_path IS NOT NULL"),
    "upsert_result": (upsert_result, f"WITH {OLD}, {NEW} SELECT file_path AS chunk_id, h AS file_hash FROM n UNION ALL SELECT file_path, h FROM o WHERE file_path NOT IN (SELECT file_path FROM n)"),
    "antijoin_delete": (antijoin_delete, "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)"),
    "delete_by_metadata": (delete_by_metadata, "SELECT doc_id, lang FROM documents WHERE lang IS DISTINCT FROM 'fr'"),
    "perf_snapshot_nearest_rank": (perf_snapshot, f"WITH {REQ}, s AS (SELECT endpoint, list_sort(list(duration_ms)) AS v, count(*) AS total, count(*) FILTER (WHERE status_code < 400) AS ok, round(avg(duration_ms), 6) AS avg_ms FROM r GROUP BY 1) SELECT endpoint, total, ok, total - ok AS failed, avg_ms, v[least(floor(0.95::DOUBLE * total), total - 1)::INT + 1] AS p95, v[least(floor(0.99::DOUBLE * total), total - 1)::INT + 1] AS p99 FROM s"),
    "error_rate_trailing": (error_rate_trailing, f"WITH {REQ} SELECT event_id, round(avg(CASE WHEN status_code >= 400 THEN 1.0::DOUBLE ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 300 SECONDS PRECEDING AND CURRENT ROW), 6) AS error_rate FROM r"),
    "rolling_rate_60s": (rolling_rate_60s, f"WITH {REQ} SELECT event_id, count(*) OVER (PARTITION BY endpoint ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW) AS n FROM r"),
    "top_errors": (top_errors, "SELECT props, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1 ORDER BY n DESC, props LIMIT 10"),
    "operation_stats_last100": (operation_stats, f"WITH {REQ}, k AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY endpoint ORDER BY ts DESC, event_id DESC) <= 100) SELECT endpoint, count(*) AS n, round(avg(duration_ms), 6) AS avg, min(duration_ms) AS min, max(duration_ms) AS max, round(sum(duration_ms), 6) AS total FROM k GROUP BY 1"),
    "metric_summary": (metric_summary, f"WITH {REQ} SELECT endpoint, count(*) AS n, min(duration_ms) AS min, max(duration_ms) AS max, round(avg(duration_ms), 6) AS avg, round(sum(duration_ms), 6) AS sum, arg_max(duration_ms, (ts, event_id)) AS latest FROM r GROUP BY 1"),
    "recent_errors": (recent_errors, f"WITH {REQ} SELECT user_id, event_id FROM r WHERE status_code >= 400 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 3"),
    "prometheus_latest": (prometheus_latest, "SELECT event_type || CASE WHEN event_type = 'click' THEN '_total' ELSE '' END || '{shard=\"' || (user_id % 4) || '\"} ' || arg_max(user_id::DOUBLE, event_id)::VARCHAR AS line FROM events GROUP BY event_type, user_id % 4"),
    "error_stats_grouping_sets": (error_stats, f"WITH {REQ}, e AS (SELECT endpoint AS category, CASE WHEN duration_ms > 100 THEN 'high' ELSE 'low' END AS severity FROM r) SELECT CASE grouping(category, severity) WHEN 1 THEN 'category' WHEN 2 THEN 'severity' ELSE 'all' END AS facet, CASE grouping(category, severity) WHEN 1 THEN category WHEN 2 THEN severity ELSE '' END AS value, count(*) AS n FROM e GROUP BY GROUPING SETS ((category), (severity), ())"),
    "health_vote": (health_vote, f"WITH {REQ}, h AS (SELECT user_id, count(*) FILTER (WHERE duration_ms <= 100) AS healthy, count(*) FILTER (WHERE duration_ms > 100 AND duration_ms <= 150) AS degraded, count(*) FILTER (WHERE duration_ms > 150) AS unhealthy FROM r GROUP BY 1) SELECT *, CASE WHEN unhealthy = 0 AND degraded = 0 THEN 'healthy' WHEN unhealthy * 2 < healthy + degraded + unhealthy THEN 'degraded' ELSE 'unhealthy' END AS status FROM h"),
    "alert_summary": (alert_summary, "SELECT event_type AS alert_type, CASE WHEN user_id % 2 = 0 THEN 'ERROR' ELSE 'WARNING' END AS severity, count(*) AS n, count(*) FILTER (WHERE event_id % 3 <> 0) AS resolved, round(avg(CASE WHEN event_id % 3 <> 0 THEN user_id::DOUBLE END), 6) AS avg_resolution_s FROM events GROUP BY 1, 2"),
    "update_running_mean": (update_running_mean, f"WITH {REQ} SELECT event_id, round((sum(duration_ms::DECIMAL(18, 6)) OVER w)::DOUBLE / count(*) OVER w, 6) AS mean FROM r WHERE status_code < 400 WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"),
    "pipeline_status": (pipeline_status, "WITH s AS (SELECT source, count(*) AS total, count(*) FILTER (WHERE quality = 0) AS failed FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1) SELECT *, CASE WHEN failed = 0 THEN 'success' WHEN failed >= total THEN 'error' ELSE 'partial' END AS status, round((total - failed) / total, 6) AS success_rate FROM s"),
    "style_lint": (style_lint, f"WITH t AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents) SELECT doc_id, len(list_filter(ls, lambda x: length(x) > 120))::BIGINT AS long_lines, len(list_filter(ls, lambda x: regexp_matches(x, '[ \\t]$')))::BIGINT AS trailing_blanks, len(list_filter(ls, lambda x: contains(x, chr(9)) AND contains(x, '    ')))::BIGINT AS mixed_indent, list_max(list_transform(ls, lambda x: length(x)))::BIGINT AS longest_line, array_to_string(list_slice(flatten(list_transform(ls, lambda x, i: list_filter([CASE WHEN length(x) > 120 THEN i || ':long_lines' END, CASE WHEN regexp_matches(x, '[ \\t]$') THEN i || ':trailing_blanks' END, CASE WHEN contains(x, chr(9)) AND contains(x, '    ') THEN i || ':mixed_indent' END], lambda y: y IS NOT NULL))), 1, 10), ',') AS issues FROM t"),
    "line_metrics": (line_metrics, f"WITH m AS (SELECT doc_id, len(string_split(text, chr(10)))::BIGINT AS total_lines, len({LS.format(chr(39).join(['regexp_matches(x, ', '^[ ' + chr(92) + 't' + chr(92) + 'r]*$', ')']))})::BIGINT AS blank_lines, len({LS.format(chr(39).join(['regexp_matches(x, ', '^[ ' + chr(92) + 't]*#', ')']))})::BIGINT AS comment_lines FROM documents) SELECT *, total_lines - blank_lines - comment_lines AS code_lines, round(CASE WHEN total_lines > blank_lines THEN comment_lines / (total_lines - blank_lines) ELSE 0 END, 6) AS comment_ratio FROM m"),
    "retry_delay": (retry_delay, "SELECT r_regionkey, least(pow(2.0, r_regionkey * 2), 60)::DOUBLE AS delay FROM region"),
    "format_duration": (durations, "WITH s AS (SELECT event_id, greatest(floor(value) * 31 - 200, 0)::DOUBLE AS s FROM events) SELECT event_id, format('{:d}h {:d}m {:.2f}s', floor(s / 3600)::BIGINT, floor((s % 3600) / 60)::BIGINT, s % 60) AS took FROM s"),
    "layer_by_path": (layer_by_path, layer_sql()),
    "spring_layer": (spring_layer, "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'Controller' WHEN doc_id % 7 = 1 THEN 'Service' WHEN doc_id % 7 = 2 THEN 'Repository' WHEN doc_id % 7 = 3 THEN 'Entity' WHEN doc_id % 5 = 0 THEN 'Test' WHEN doc_id % 7 = 5 THEN 'Util' ELSE 'Unknown' END AS layer FROM documents"),
    "ignore_predicate": (ignore_predicate, f"WITH {PATHS} SELECT doc_id, contains(path, '/target/') OR contains(path, '/venv/') OR contains(path, '/node_modules/') AS ignored FROM p"),
    "primary_language": (primary_language, f"WITH {PATHS}, l AS (SELECT CASE WHEN ends_with(path, '.py') THEN 'python' WHEN ends_with(path, '.java') THEN 'java' WHEN ends_with(path, '.html') THEN 'html' END AS language FROM p) SELECT language FROM l WHERE language IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, language LIMIT 1"),
    "project_type": (project_type, "SELECT false AS python, true AS java, false AS kotlin, true AS web"),
    "glob_filter": (glob_filter, f"WITH {PATHS} SELECT doc_id FROM p WHERE ends_with(path, '.py') AND NOT contains(path, '/venv/') AND NOT contains(path, '/target/')"),
    "error_categories": (error_categories, "SELECT doc_id, ['TIMEOUT', 'NETWORK', 'AUTHORIZATION', 'VALIDATION', 'DATABASE', 'UNKNOWN'][(doc_id % 6 + 1)::INT] AS category, CASE WHEN doc_id % 2 = 0 THEN 404 ELSE 500 END AS status FROM documents"),
    "line_chunks": (line_chunks, None),
}
