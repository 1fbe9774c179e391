"""Reports over ``documents`` as chunks and ``events`` as requests, errors, logs and alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import layers
from ..functions import secrets as S
from ..functions import text as T
from ..operators import reports, security, store
from .analytics import REQ, requests
from .search import docs
from .security import FOUND, LEVEL, code
from .stored import folder

H = reports.spelled
LAYERS = ("Service", "Entity", "Util")


def chunks(spark, d):
    n = F.col("doc_id")
    layer = F.element_at(F.array(*map(F.lit, LAYERS)), (n % 3 + 1).cast("int"))
    return docs(spark, d).select(n.alias("chunk_id"), F.when(n % 7 > 0, F.col("source")).alias("project_id"), F.when(n % 11 == 0, "").otherwise(F.concat("source", F.lit("/f"), (n % 20).cast("string"))).alias("file_path"), F.col("lang").alias("language"), layer.alias("layer_type"), T.token_estimate(F.col("text")).alias("token_count"), n.alias("last_updated"))


CHUNKS = """c AS (SELECT doc_id AS chunk_id, coalesce(CASE WHEN doc_id % 7 > 0 THEN source END, 'default') AS project_id, CASE WHEN doc_id % 11 = 0 THEN '' ELSE source || '/f' || doc_id % 20 END AS file_path,
 coalesce(lang, 'unknown') AS language, ['Service', 'Entity', 'Util'][(doc_id % 3 + 1)::INT] AS layer_type, (length(text) // 4)::BIGINT AS token_count, doc_id FROM documents)"""


def sql_histogram(table: str, column: str, by: str = "", name: str = "") -> str:
    """A histogram as text, in SQL; ``by`` is the condition of a group."""
    return f"(SELECT coalesce(string_agg(k || ':' || n, ',' ORDER BY k), '') FROM (SELECT coalesce({column}::VARCHAR, 'unknown') AS k, count(*) AS n FROM {table} t {by} GROUP BY 1)) AS {name or column}"


def project_report(spark, d):
    found = reports.project_report(chunks(spark, d))
    return found.withColumns({"language": H("language"), "layer_type": H("layer_type")})


def run_report(spark, d):
    files = docs(spark, d).select(F.col("doc_id").alias("path"), F.when(F.col("doc_id") % 50 == 0, "broken").alias("error"))
    rows = chunks(spark, d).withColumns({"sensitivity_level": F.when(F.col("chunk_id") % 4 == 0, "HIGH").otherwise("LOW"), "masked_count": F.col("chunk_id") % 3, "embedding_status": F.when(F.col("chunk_id") % 10 == 0, "failed").otherwise("completed")})
    return reports.run_report(files, rows).withColumns({c: H(c) for c in ("language", "layer_type", "sensitivity_level")})


def embedding_report(spark, d):
    return reports.embedding_report(requests(spark, d).withColumn("endpoint", F.col("user_id") % 10), ["endpoint"], "ts", "duration_ms", F.col("status_code") < 400, F.col("event_id") % 4 == 0)


def metric_window(spark, d):
    return reports.metric_summary(requests(spark, d), "endpoint", "duration_ms", "ts", "event_id", 86400)


def performance_window(spark, d):
    return reports.performance(requests(spark, d), ["endpoint"], seconds=2 * 86400)


def errors(spark, d):
    r = requests(spark, d)
    return r.select("ts", F.col("endpoint").alias("category"), F.when(F.col("duration_ms") > 100, "HIGH").otherwise("LOW").alias("severity"), (F.col("user_id") % 5).cast("string").alias("error_type"))


def error_report(**options):
    def run(spark, d):
        found = reports.error_report(errors(spark, d), **options)
        return found.withColumns({"first_seen": F.unix_micros("first_seen"), "last_seen": F.unix_micros("last_seen"), **{c: H(c) for c in ("category", "severity", "error_type")}})

    return run


ERRORS = "e AS (SELECT ts, event_type AS category, CASE WHEN value > 100 THEN 'HIGH' ELSE 'LOW' END AS severity, (user_id % 5)::VARCHAR AS error_type FROM events)"


def error_sql(where: str, minutes: str) -> str:
    facets = ", ".join(sql_histogram("f", c) for c in ("category", "severity", "error_type"))
    return f"WITH {ERRORS}, f AS (SELECT * FROM e WHERE {where}) SELECT count(*) AS total, epoch_us(min(ts)) AS first_seen, epoch_us(max(ts)) AS last_seen, round(count(*) / {minutes}, 6) AS per_minute, {facets} FROM f"


def secret_report(spark, d):
    found = reports.secret_report(security.scan(code(spark, d)), most=5)
    risk = F.array_join(F.transform("high_risk", lambda x: F.concat_ws(":", x["path"], x["high"].cast("string"), x["secrets"].cast("string"))), ",")
    return found.select(risk.alias("high_risk"), *[H(c).alias(c) for c in ("sensitivity_level", "secret_type")])


def alerts(spark, d):
    n = F.col("event_id")
    severity = F.element_at(F.array(*map(F.lit, ("INFO", "WARNING", "ERROR", "CRITICAL"))), (F.col("user_id") % 4 + 1).cast("int"))
    return docs(spark, d, "events").select(n.alias("alert_id"), F.col("event_type").alias("alert_type"), severity.alias("severity"), F.col("ts").cast("timestamp").alias("triggered_at"), F.when(n % 3 > 0, F.col("ts")).alias("resolved_at"))


def active_filtered(spark, d):
    return reports.active_alerts(alerts(spark, d), "click", "ERROR", 30).select("alert_id", "alert_type", "severity")


def logs(spark, d):
    return docs(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO").alias("level"), "user_id")


def recent_errors(spark, d):
    return reports.recent_logs(logs(spark, d), "ts", "event_id", 40, "ERROR", 72).select("event_id", "level")


def exported_errors(spark, d):
    return reports.exported_logs(logs(spark, d), "ts", "event_id", "level", level="ERROR", hours=48)


def metadata_page(spark, d):
    return reports.metadata_page(chunks(spark, d), {"language": "en"}, ("src1/*", "f3"), offset=5, limit=20).select("chunk_id", "file_path")


def appended(spark, d):
    """Appending rows twice: only new keys come in."""
    rows = docs(spark, d, "events").select("event_id", "user_id")
    s = store.Store(spark, folder(spark), "event_id")
    first = reports.append_new(s, rows.where("event_id % 3 < 2"))
    second = reports.append_new(s, rows.where("event_id % 3 > 0"))
    return spark.createDataFrame([(1, *first), (2, *second)], "round long, appended long, refused long")


def rendered(form):
    return lambda spark, d: reports.rendered(chunks(spark, d).select("chunk_id", "file_path", "language"), form, 8)


def config_masks(spark, d):
    """The rules of configuration files over the documents' own texts and a line of settings."""
    line = F.concat(F.lit("\npwd: s"), F.col("doc_id").cast("string"), F.lit(" api_key = 'k"), F.md5(F.col("doc_id").cast("string")), F.lit("' https://u:p"), F.col("doc_id").cast("string"), F.lit("@host/x"))
    return docs(spark, d).select("doc_id", F.md5(S.mask_settings(F.concat(F.coalesce("text", F.lit("")), line))).alias("digest"), S.settings_level(F.coalesce("text", F.lit(""))).alias("level"))


def config_sql() -> str:
    text = "coalesce(text, '') || chr(10) || 'pwd: s' || doc_id || ' api_key = ''k' || md5(doc_id::VARCHAR) || ''' https://u:p' || doc_id || '@host/x'"
    for _, pattern, put in S.SETTINGS_RULES:
        pattern, put = pattern.replace("'", "''"), put.replace("$", "\\")
        text = f"regexp_replace({text}, '{pattern}', '{put}', 'g')"
    low = "lower(coalesce(text, ''))"
    levels = " ".join("WHEN " + " OR ".join(f"contains({low}, '{x}')" for x in words) + f" THEN '{level}'" for level, _, words in S.SETTINGS_LEVELS)
    return f"SELECT doc_id, md5({text}) AS digest, CASE {levels} ELSE 'LOW' END AS level FROM documents"


def layers_and_indicators(spark, d):
    """Framework by the imports that the text's first word stands for, layer by path, and all that speaks for them."""
    n = F.col("doc_id")
    imports = F.array(F.element_at(F.array(*map(F.lit, ("django", "flask", "fastapi", "os"))), (n % 4 + 1).cast("int")))
    path = F.concat("source", F.element_at(F.array(*map(F.lit, ("/models.py", "/x.py", "/views.py"))), (n % 3 + 1).cast("int")))
    found = layers.detection(path, imports, function_name=F.when(n % 5 == 0, "test_it").otherwise("run"), decorators=F.array().cast("array<string>"))
    return docs(spark, d).select("doc_id", found.alias("x")).select("doc_id", "x.framework", "x.layer", F.array_join("x.indicators", "; ").alias("indicators"))


QUERIES = {
    "project_report": (project_report, f"""WITH {CHUNKS} SELECT project_id, count(*) AS chunks, count(DISTINCT nullif(file_path, '')) AS files, sum(token_count)::BIGINT AS tokens, round(avg(token_count), 6) AS avg_tokens, max(doc_id) AS last_updated,
 {sql_histogram('c', 'language', 'WHERE t.project_id = g.project_id')}, {sql_histogram('c', 'layer_type', 'WHERE t.project_id = g.project_id')} FROM c g GROUP BY g.project_id"""),
    "run_report": (run_report, f"WITH {CHUNKS}, x AS (SELECT *, CASE WHEN doc_id % 4 = 0 THEN 'HIGH' ELSE 'LOW' END AS sensitivity_level FROM c) SELECT count(*) AS files, count(*) FILTER (WHERE doc_id % 50 = 0) AS failed_files, count(*) AS chunks, count(*) FILTER (WHERE doc_id % 10 > 0) AS embedded, sum(doc_id % 3)::BIGINT AS secrets, 'partial' AS status, round(count(*) FILTER (WHERE doc_id % 10 > 0) / count(*), 6) AS success_rate, {sql_histogram('x', 'language')}, {sql_histogram('x', 'layer_type')}, {sql_histogram('x', 'sensitivity_level')} FROM x"),
    "embedding_report": (embedding_report, f"WITH {REQ} SELECT user_id % 10 AS endpoint, count(*) AS total, count(*) FILTER (WHERE status_code >= 400) AS failed, round(count(*) FILTER (WHERE status_code < 400) / count(*), 6) AS success_rate, round(avg(duration_ms) FILTER (WHERE status_code < 400), 6) AS avg_seconds, round(count(*) FILTER (WHERE event_id % 4 = 0) / count(*), 6) AS hit_rate, round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 60e6), 6) AS per_minute FROM r GROUP BY 1"),
    "metric_window": (metric_window, f"WITH {REQ}, w AS (SELECT * FROM r WHERE epoch_us(ts) > (SELECT max(epoch_us(ts)) FROM r) - 86400000000) SELECT endpoint, count(*) AS n, min(duration_ms) AS min, max(duration_ms) AS max, round(avg(duration_ms), 6) AS avg, round(sum(duration_ms), 6) AS sum, arg_max(duration_ms, (ts, event_id)) AS latest FROM w GROUP BY 1"),
    "performance_window": (performance_window, f"WITH {REQ}, w AS (SELECT * FROM r WHERE epoch_us(ts) > (SELECT max(epoch_us(ts)) FROM r) - 172800000000), s AS (SELECT endpoint, list_sort(list(duration_ms)) AS v, count(*) AS total, count(*) FILTER (WHERE status_code < 400) AS ok, round(avg(duration_ms), 6) AS avg_ms FROM w GROUP BY 1) SELECT endpoint, total, ok, total - ok AS failed, avg_ms, v[least(floor(total * 0.95::DOUBLE), total - 1)::INT + 1] AS p95, v[least(floor(total * 0.99::DOUBLE), total - 1)::INT + 1] AS p99 FROM s"),
    "error_report": (error_report(), error_sql("true", "greatest((epoch_us(max(ts)) - epoch_us(min(ts))) / 60e6, 1)")),
    "error_report_filtered": (error_report(category="error", severity="HIGH", seconds=10 * 86400), error_sql("category = 'error' AND severity = 'HIGH' AND epoch_us(ts) > (SELECT max(epoch_us(ts)) FROM e WHERE category = 'error' AND severity = 'HIGH') - 864000000000", "14400.0::DOUBLE")),
    "secret_report": (secret_report, f"WITH {LEVEL}, k AS (SELECT file_path, count(*) FILTER (WHERE level = 'HIGH') AS h, sum(n)::BIGINT AS n FROM l GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 5) SELECT (SELECT string_agg(file_path || ':' || h || ':' || n, ',' ORDER BY h DESC, n DESC, file_path) FROM k WHERE h > 0) AS high_risk, {sql_histogram('l', 'level', '', 'sensitivity_level')}, {sql_histogram('s', 'secret_type')}"),
    "active_filtered": (active_filtered, "SELECT event_id AS alert_id, event_type AS alert_type, 'ERROR' AS severity FROM events WHERE event_type = 'click' AND user_id % 4 = 2 AND event_id % 3 = 0 ORDER BY ts DESC, event_id LIMIT 30"),
    "recent_errors_filtered": (recent_errors, "SELECT event_id, 'ERROR' AS level FROM events WHERE event_type = 'error' AND epoch_us(ts) > (SELECT max(epoch_us(ts)) FROM events) - 259200000000 ORDER BY ts DESC, event_id DESC LIMIT 40"),
    "exported_errors": (exported_errors, "SELECT '{\"event_id\":' || event_id || ',\"level\":\"ERROR\"}' AS line FROM events WHERE event_type = 'error' AND epoch_us(ts) > (SELECT max(epoch_us(ts)) FROM events) - 172800000000"),
    "metadata_page": (metadata_page, f"WITH {CHUNKS} SELECT chunk_id, file_path FROM c WHERE language = 'en' AND (starts_with(file_path, 'src1/') OR ends_with(file_path, '/f3')) ORDER BY chunk_id LIMIT 20 OFFSET 5"),
    "appended_once": (appended, "SELECT 1::BIGINT AS round, count(*) FILTER (WHERE event_id % 3 < 2) AS appended, 0::BIGINT AS refused FROM events UNION ALL SELECT 2, count(*) FILTER (WHERE event_id % 3 = 2), count(*) FILTER (WHERE event_id % 3 = 1) FROM events"),
    "rendered_table": (rendered("table"), f"WITH {CHUNKS} SELECT rtrim(concat_ws(' ', rpad(chunk_id::VARCHAR, 8, ' '), rpad(CASE WHEN length(file_path) > 8 THEN left(file_path, 6) || '..' ELSE file_path END, 8, ' '), rpad(CASE WHEN language = 'unknown' THEN '' ELSE language END, 8, ' '))) AS line FROM c"),
    "rendered_simple": (rendered("simple"), f"WITH {CHUNKS} SELECT concat_ws(' ', chunk_id::VARCHAR, file_path, CASE WHEN language = 'unknown' THEN '' ELSE language END) AS line FROM c"),
    "config_masks": (config_masks, config_sql()),
    "layer_indicators": (layers_and_indicators, """WITH x AS (SELECT doc_id, ['django', 'flask', 'fastapi', 'unknown'][(doc_id % 4 + 1)::INT] AS framework, CASE WHEN doc_id % 5 = 0 THEN 'Test' END AS f, ['Entity', NULL, 'View'][(doc_id % 3 + 1)::INT] AS p FROM documents)
 SELECT doc_id, framework, coalesce(f, p, 'Unknown') AS layer, concat_ws('; ', CASE WHEN framework <> 'unknown' THEN 'imports suggest ' || framework END, CASE WHEN f IS NOT NULL THEN 'function pattern suggests ' || f WHEN p IS NOT NULL THEN 'path pattern suggests ' || p END) AS indicators FROM x"""),
}
