"""Security queries: ``documents`` with lines built from their columns, so that every kind of secret occurs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import secrets as S
from ..operators import security
from .search import docs


def code(spark, d):
    """Chunks whose last lines hold what their number asks for."""
    n = F.col("doc_id")
    key = F.when(n % 3 == 0, F.concat(F.lit("\napi_key = \""), F.sha1(n.cast("string").cast("binary")), F.lit('"'))).otherwise("")
    word = F.when(n % 5 == 0, F.concat(F.lit("\npassword = 'pw"), n.cast("string"), F.lit("xyz'"))).otherwise("")
    url = F.when(n % 7 == 0, "\npostgresql://bob:hunter2@db.example.net/x").otherwise("")
    pair = F.when(n % 11 == 0, "\nuser = 'bob', password = 'tiger'").otherwise("")
    path = F.concat(F.col("source"), F.lit("/f"), (n % 20).cast("string"), F.lit(".py"))
    return docs(spark, d).select(n.alias("chunk_id"), path.alias("file_path"), F.concat(F.lit("x = 1"), key, word, url, pair).alias("content"), "text")


CODE = """c AS (SELECT doc_id AS chunk_id, source || '/f' || (doc_id % 20) || '.py' AS file_path, 'x = 1' || CASE WHEN doc_id % 3 = 0 THEN chr(10) || 'api_key = "' || sha1(doc_id::VARCHAR) || '"' ELSE '' END
 || CASE WHEN doc_id % 5 = 0 THEN chr(10) || 'password = ''pw' || doc_id || 'xyz''' ELSE '' END || CASE WHEN doc_id % 7 = 0 THEN chr(10) || 'postgresql://bob:hunter2@db.example.net/x' ELSE '' END
 || CASE WHEN doc_id % 11 = 0 THEN chr(10) || 'user = ''bob'', password = ''tiger''' ELSE '' END AS content, text FROM documents)"""
#: What the lines above hold, by type and confidence; the address is an example, which lowers its confidence under the threshold.
FOUND = f"""{CODE}, s AS (SELECT chunk_id, file_path, 'api_key' AS secret_type, 0.85::DOUBLE AS confidence FROM c WHERE chunk_id % 3 = 0
 UNION ALL SELECT chunk_id, file_path, 'password', 0.7 FROM c WHERE chunk_id % 5 = 0 UNION ALL SELECT chunk_id, file_path, 'password', 0.7 FROM c WHERE chunk_id % 11 = 0)"""
LEVEL = f"""{FOUND}, l AS (SELECT c.chunk_id, c.file_path, count(secret_type) AS n, CASE WHEN bool_or(secret_type = 'api_key' AND confidence > 0.8) THEN 'HIGH' ELSE 'LOW' END AS level FROM c LEFT JOIN s USING (chunk_id) GROUP BY ALL)"""


def detect_counts(spark, d):
    return security.detect(code(spark, d)).groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"))


def by_type(spark, d):
    return security.masking_summary(security.detect(code(spark, d)))


def levels(spark, d):
    return security.scan(code(spark, d)).select("chunk_id", "sensitivity_level", F.col("masked_count").cast("long").alias("n"))


def masked(spark, d):
    return security.scan(code(spark, d)).select("chunk_id", "content")


def report(spark, d):
    return security.report(security.scan(code(spark, d))).select("total_chunks", "total_secrets", "files_with_secrets", "high", "medium", "low", "password", "api_key", F.size("recommendations").alias("n_recommendations"))


def files(spark, d):
    return security.sensitive_files(security.scan(code(spark, d)))


def real_text(spark, d):
    """The catalogue over the documents' own texts."""
    return security.detect(docs(spark, d).select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("file_path"), F.col("text").alias("content"))).select("chunk_id", "secret_type", "pattern_name", "line_number")


QUERIES = {
    "secret_detect_counts": (detect_counts, f"WITH {FOUND} SELECT chunk_id, count(*) AS n FROM s GROUP BY 1"),
    "secret_by_type": (by_type, f"WITH {FOUND} SELECT secret_type, count(*) AS n FROM s GROUP BY 1"),
    "sensitivity_level": (levels, f"WITH {LEVEL} SELECT chunk_id, level AS sensitivity_level, n FROM l"),
    "security_report": (report, f"WITH {LEVEL} SELECT count(*) AS total_chunks, sum(n)::BIGINT AS total_secrets, count(DISTINCT CASE WHEN n > 0 THEN file_path END) AS files_with_secrets, count(*) FILTER (WHERE level = 'HIGH') AS high, 0::BIGINT AS medium, count(*) FILTER (WHERE level = 'LOW') AS low, (SELECT count(*) FROM s WHERE secret_type = 'password') AS password, (SELECT count(*) FROM s WHERE secret_type = 'api_key') AS api_key, 6 AS n_recommendations FROM l"),
    "file_sensitive": (files, f"WITH {LEVEL} SELECT file_path, bool_or(level <> 'LOW') AS sensitive FROM l GROUP BY 1"),
    "mask_content": (masked, f"""WITH {CODE} SELECT chunk_id, regexp_replace(regexp_replace(regexp_replace(content, 'api_key = "[^"]*"', 'api_key = "[MASKED_API_KEY]"', 'g'), 'password = ''pw[^'']*''', 'password = ''[MASKED_PASSWORD]''', 'g'), 'password = ''tiger''', 'password = ''[MASKED_PASSWORD]''', 'g') AS content FROM c"""),
    "mask_email": (lambda s, d: docs(s, d).select("doc_id", F.sha2(S.mask_email(F.col("text")), 256).alias("digest")), "SELECT doc_id, sha256(regexp_replace(text, '[a-zA-Z0-9._%+-]+@([a-zA-Z0-9.-]+\\.[a-zA-Z]{2,})', '[MASKED_USER]@\\1', 'g')) AS digest FROM documents"),
    "mask_db_url": (lambda s, d: code(s, d).select("chunk_id", F.md5(S.mask_database_url(F.col("content"))).alias("digest")), f"WITH {CODE} SELECT chunk_id, md5(replace(content, 'bob:hunter2@', '[MASKED_USER]:[MASKED_PASSWORD]@')) AS digest FROM c"),
    "mask_credentials": (lambda s, d: code(s, d).select("chunk_id", F.md5(S.mask_credentials(F.col("content"))).alias("digest")), f"WITH {CODE} SELECT chunk_id, md5(replace(content, 'user = ''bob'', password = ''tiger''', 'user = ''[MASKED_USER]'', password = ''[MASKED_PASSWORD]''')) AS digest FROM c"),
    "secret_patterns": (lambda s, d: S.pattern_table(s).groupBy("source").agg(F.count(F.lit(1)).alias("n")), "SELECT * FROM (VALUES ('django', 10), ('flask', 6), ('fastapi', 4), ('aws', 6), ('azure', 4), ('gcp', 4), ('common', 29), ('env', 6)) t(source, n)"),
    "secret_real_text": (real_text, None),
}
