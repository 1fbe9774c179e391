import pytest

import __spark_entry__ as entry
from tests.oracle import SF, same

CASES = [(name, q, sql) for part in entry.PARTS for name, (q, sql) in part.QUERIES.items()]


@pytest.mark.parametrize("name,query,sql", [c for c in CASES if c[2]], ids=[c[0] for c in CASES if c[2]])
def test_query_equals_sql(spark, name, query, sql):
    same(spark, query, sql)


@pytest.mark.parametrize("name,query", [c[:2] for c in CASES if not c[2]], ids=[c[0] for c in CASES if not c[2]])
def test_query_runs(spark, name, query):
    assert query(spark, SF).columns


def test_entry(spark):
    assert entry.entry(spark).columns == ["id", "score", "lang", "source", "chars"]


def test_line_chunks_equal_python(spark):
    from tessera.operators.chunks import chunked
    from tessera.operators.parsers import lines_of

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {(r.doc_id, r.chunk_no): (r.start_line, r.end_line, r.content) for r in chunked(docs, ["doc_id"]).collect()}
    want = {(d.doc_id, n): (c[2], c[3], c[8]) for d in docs.collect() for n, c in enumerate(lines_of("x", d.text))}
    assert got == want
