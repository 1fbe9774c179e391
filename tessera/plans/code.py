"""Parser queries: ``pages`` as templates, and literal sources numbered by document."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import parsers
from ..sources.shared import spread
from .search import docs

PYTHON = '''import os


class Order{n}Service:
    """Orders."""

    def total(self, rows: list, tax: float = 0.1) -> float:
        out = 0
        for r in rows:
            if r and r > 0:
                out += r * (1 + tax)
        return out


def helper_{n}(a, b=2):
    while a < b and b:
        a += 1
    return a
'''
JAVA = """package com.example;

@Service
public class Order{n}Service implements Runnable {
    private String url = "a { b";
    // a } in a comment
    public int total(int a, String b) {
        return a;
    }
    public void run() {
        total(1, "}");
    }
}
"""


def numbered(template: str, suffix: str):
    return lambda spark, d: docs(spark, d).select(F.concat(F.lit("src/f"), F.col("doc_id").cast("string"), F.lit(suffix)).alias("path"), F.replace(F.lit(template), F.lit("{n}"), F.col("doc_id").cast("string")).alias("text"))


def templates(spark, d):
    return docs(spark, d, "pages").select(F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.col("html").alias("text"))


def html_links(spark, d):
    return docs(spark, d, "pages").select("page_id", F.size(F.regexp_extract_all("html", F.lit('<a href="'), F.lit(0))).cast("long").alias("links"), F.size(F.regexp_extract_all("html", F.lit("<table"), F.lit(0))).cast("long").alias("tables"), F.size(F.regexp_extract_all("html", F.lit("<form"), F.lit(0))).cast("long").alias("forms"))


def written(language: str):
    """A class for each document, with a method for each line of its text that holds a letter."""
    python = language == "python"
    head, tail = ("class D{n}:", "") if python else ("class D{n} {", "\n}")
    method = ("\n    def line_", "(self, a):\n        if a:\n            return '", "'\n        return a") if python else ("\n    String line_", "(int a) {\n        if (a > 0) { return \"", "\"; }\n        return null;\n    }")

    def rows(spark, d):
        number = F.col("doc_id").cast("string")
        words = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(x, "[^A-Za-z]+", " ")))
        methods = F.transform(F.filter(words, lambda x: x != ""), lambda x, k: F.concat(F.lit(method[0]), k.cast("string"), F.lit(method[1]), x, F.lit(method[2])))
        text = F.concat(F.replace(F.lit(head), F.lit("{n}"), number), F.when(F.size(methods) > 0, F.array_join(methods, "")).otherwise("\n    pass" if python else ""), F.lit(tail))
        return docs(spark, d).where("doc_id IS NOT NULL").select(F.concat(number, F.lit(".py" if python else ".java")).alias("path"), text.alias("text"))

    return rows


def written_chunks(language: str):
    def run(spark, d):
        found = parsers.parse(spread(written(language)(spark, d)))
        return found.select("file_path", "start_line", "end_line", "function_name", "class_name", F.length("content").alias("chars"))

    return run


def written_lateral(spark, d):
    """The same by the table function, in SQL."""
    parsers.register_function(spark)
    written("java")(spark, d).createOrReplaceTempView("written_java")
    return spark.sql("SELECT p.file_path, p.function_name, p.start_line FROM written_java w, LATERAL parse_source(w.path, w.text) p WHERE p.function_name IS NOT NULL")


def written_metrics(spark, d):
    return parsers.metrics(spread(written("python")(spark, d)))


def written_symbols(spark, d):
    """Methods of the written classes, with their signatures."""
    return parsers.symbols(spread(written("python")(spark, d))).select("file_path", "kind", "name", "owner", "line", "detail")


def written_pieces(spark, d):
    """Semantic pieces of the written classes: the whole methods in them, and the largest piece against the bound. Merged parts of methods that were too large hold no whole method."""
    found = parsers.parse(spread(written("python")(spark, d)), parsers.python_pieces)
    return found.where("coalesce(metadata.of, metadata.type) = 'method'").groupBy("file_path").agg(F.sum(F.regexp_count("content", F.lit(r"def line_[0-9]+\("))).alias("methods"), F.coalesce(F.max("token_count") <= parsers.MOST, F.lit(True)).alias("bounded"))


def page_forms(spark, d):
    """Links of the pages made forms with a field, and read by the template parser."""
    form = "\n<form action=\"/$1\">\n<input name=\"$1\" type=\"text\" required>\n</form>"
    texts = docs(spark, d, "pages").select(F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.regexp_replace("html", "<li><a href=\"/([^\"&]*)\">[^<]*</a></li>", form).alias("text"))
    return parsers.parse(texts).where("metadata.element_type = 'form'").select("file_path", "start_line", "end_line", "function_name", F.col("metadata.action").alias("action"), F.col("metadata.fields").alias("fields"))


def chunk_facts(parsed):
    return parsed.select("file_path", "start_line", "end_line", "function_name", "class_name", F.col("metadata.type").alias("kind"))


LINES = """l AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(regexp_replace(x, '[^A-Za-z]+', ' ', 'g'))), lambda x: x <> '') AS ls FROM documents WHERE doc_id IS NOT NULL),
 m AS (SELECT doc_id, unnest(ls) AS x, unnest(range(len(ls)))::INT AS k FROM l)"""
FORMS = """f AS (SELECT page_id, regexp_extract_all(html, '<li><a href="/([^"&]*)">[^<]*</a></li>', 1) AS hs FROM pages),
 g AS (SELECT page_id, unnest(hs) AS h, unnest(range(len(hs)))::INT AS k FROM f)"""
QUERIES = {
    "written_python": (written_chunks("python"), f"""WITH {LINES}, c AS (SELECT doc_id, doc_id || '.py' AS file_path, len(ls) AS n, length('class D' || doc_id || ':') + coalesce(list_sum(list_transform(ls, lambda x, k: length('    def line_' || (k - 1) || '(self, a):') + length(x) + 54)), 9) AS chars FROM l)
 SELECT file_path, 1::INT AS start_line, (1 + greatest(1, 4 * n))::INT AS end_line, NULL::VARCHAR AS function_name, 'D' || doc_id AS class_name, chars::INT AS chars FROM c
 UNION ALL SELECT c.file_path, 2 + 4 * k, 5 + 4 * k, 'line_' || k, 'D' || m.doc_id, (length('    def line_' || k || '(self, a):') + length(x) + 53)::INT FROM m JOIN c USING (doc_id) WHERE 4 * n > 20"""),
    "written_java": (written_chunks("java"), f"""WITH {LINES}
 SELECT doc_id || '.java' AS file_path, 1::INT AS start_line, (2 + 4 * len(ls))::INT AS end_line, NULL::VARCHAR AS function_name, 'D' || doc_id AS class_name, (length('class D' || doc_id || ' {{') + 2 + coalesce(list_sum(list_transform(ls, lambda x, k: length('    String line_' || (k - 1) || '(int a) {{') + length(x) + 62)), 0))::INT AS chars FROM l
 UNION ALL SELECT doc_id || '.java', 2 + 4 * k, 5 + 4 * k, 'line_' || k, 'D' || doc_id, (length('String line_' || k || '(int a) {{') + length(x) + 61)::INT FROM m"""),
    "written_lateral": (written_lateral, f"WITH {LINES} SELECT doc_id || '.java' AS file_path, 'line_' || k AS function_name, 2 + 4 * k AS start_line FROM m"),
    "written_metrics": (written_metrics, f"WITH {LINES} SELECT doc_id || '.py' AS path, (1 + len(ls))::DOUBLE AS cyclomatic, len(ls)::DOUBLE AS cognitive, least(len(ls), 1)::DOUBLE AS nesting, len(ls)::DOUBLE AS functions, 0.0::DOUBLE AS hinted_returns, 0.0::DOUBLE AS hinted_parameters FROM l"),
    "written_symbols": (written_symbols, f"WITH {LINES} SELECT doc_id || '.py' AS file_path, 'class' AS kind, 'D' || doc_id AS name, NULL::VARCHAR AS owner, 1::INT AS line, '' AS detail FROM l UNION ALL SELECT doc_id || '.py', 'method', 'line_' || k, 'D' || doc_id, 2 + 4 * k, 'self:Any, a:Any' FROM m"),
    "written_pieces": (written_pieces, f"""WITH {LINES}, c AS (SELECT doc_id, k, length('    def line_' || k || '(self, a):') + length(x) + 53 AS chars, sum(length('    def line_' || k || '(self, a):') + length(x) + 54) OVER (PARTITION BY doc_id) + length('class D' || doc_id || ':') AS whole FROM m)
 SELECT doc_id || '.py' AS file_path, count(*) AS methods, true AS bounded FROM c WHERE whole // 4 > 500 AND chars // 4 BETWEEN 50 AND 500 GROUP BY doc_id"""),
    "page_forms": (page_forms, f"WITH {FORMS} SELECT page_id || '.html' AS file_path, 2 + 3 * k AS start_line, 4 + 3 * k AS end_line, 'form_' || k AS function_name, '/' || h AS action, h || ':text::True' AS fields FROM g"),
    "html_links": (html_links, "SELECT page_id, len(regexp_extract_all(html, '<a href=\"'))::BIGINT AS links, len(regexp_extract_all(html, '<table'))::BIGINT AS tables, len(regexp_extract_all(html, '<form'))::BIGINT AS forms FROM pages"),
    "html_chunks": (lambda s, d: parsers.parse(templates(s, d)).groupBy("file_path").agg(F.count(F.lit(1)).alias("chunks")), None),
    "java_chunks": (lambda s, d: chunk_facts(parsers.parse(numbered(JAVA, ".java")(s, d))), "SELECT 'src/f' || doc_id || '.java' AS file_path, x.a AS start_line, x.b AS end_line, x.f AS function_name, 'Order' || doc_id || 'Service' AS class_name, x.k AS kind FROM documents, (VALUES (3, 13, NULL, 'class'), (7, 9, 'total', 'method'), (10, 12, 'run', 'method')) x(a, b, f, k)"),
    "python_chunks": (lambda s, d: chunk_facts(parsers.parse(numbered(PYTHON, ".py")(s, d))), "SELECT 'src/f' || doc_id || '.py' AS file_path, x.a AS start_line, x.b AS end_line, CASE WHEN x.k = 'function' THEN 'helper_' || doc_id END AS function_name, CASE WHEN x.k = 'class' THEN 'Order' || doc_id || 'Service' END AS class_name, x.k AS kind FROM documents, (VALUES (4, 12, 'class'), (15, 18, 'function')) x(a, b, k)"),
    "python_ast_metrics": (lambda s, d: parsers.metrics(numbered(PYTHON, ".py")(s, d)), "SELECT 'src/f' || doc_id || '.py' AS path, 6.0::DOUBLE AS cyclomatic, 6.0::DOUBLE AS cognitive, 2.0::DOUBLE AS nesting, 2.0::DOUBLE AS functions, 0.5::DOUBLE AS hinted_returns, 2.0::DOUBLE / 5 AS hinted_parameters FROM documents"),
}
