"""Queries against their SQL on tables that the tiny ones don't resemble."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from tessera.operators import bm25, sketches, vectors
from tessera.plans import code, operations, search
from tests.oracle import same


def test_merged_parts_of_methods_are_no_methods(spark, tmp_path):
    """The last part of a long method is short, and so is the first of the next long one: they merge, and hold no whole method."""
    short, long = "\n".join(["dans pas"] * 40), "de " * 1100
    texts = ["\n".join([short, long, short, long]), "\n".join([long, long, "ab " * 100]), None]
    pq.write_table(pa.table({"doc_id": pa.array([1, 2, 3]), "text": pa.array(texts)}), f"{tmp_path}/documents.parquet")
    same(spark, *code.QUERIES["written_pieces"], str(tmp_path))


def events(path, n):
    draw = np.random.default_rng(3)
    value = [None if k % 97 == 0 else v for k, v in enumerate(np.round(draw.exponential(50, n) - 2, 2).tolist())]
    kind = [None if k % 5 == 0 else ("error", "view")[k % 2] for k in range(n)]
    at = pa.array((draw.integers(0, 30 * 3600, n) * 1_000_000).tolist(), pa.int64()).cast(pa.timestamp("us"))
    ids = [None if k % 101 == 0 else k for k in range(n)]
    pq.write_table(pa.table({"event_id": pa.array(ids, pa.int64()), "ts": at, "user_id": pa.array([0] * n), "event_type": kind, "value": pa.array(value, pa.float64())}), f"{path}/events.parquet")


def test_window_percentiles_are_exact(spark, tmp_path):
    """Windows of many times the rows that a sketch keeps whole; negative values, nulls, and a null endpoint."""
    events(tmp_path, 60_000)
    same(spark, *operations.QUERIES["window_percentiles"], str(tmp_path))


def test_merged_percentiles_are_exact(spark, tmp_path):
    events(tmp_path, 60_000)
    same(spark, *operations.QUERIES["merged_percentiles"], str(tmp_path))


def test_exact_windows_of_odd_values(spark):
    values = [0.0, -1.0, 1e-300, float("inf"), float("-inf"), float("nan"), 1e300, -5e-324]
    counts = spark.createDataFrame([("x", 0, v, 1, 0) for v in values], "g string, bucket long, value double, n long, failed long")
    shares = {f"p{k}": (k + 1) / 8 for k in range(8)}
    got = sketches.exact_windows(counts, ["g"], 60, 60, shares).first()
    assert repr([got[p] for p in shares]) == repr([float("-inf"), -1.0, -5e-324, 0.0, 1e-300, 1e300, float("inf"), float("nan")])


def embeddings(path, n, copies=0):
    draw = np.random.default_rng(5)
    v = np.float32(draw.normal(size=(n, 16)))
    v[1::2] += v[::2][: len(v[1::2])]
    v[n - copies :] = v[:copies]
    values = [[0.0] * 16 if copies else None, None, *v[2:].tolist()]
    pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": pa.array(values, pa.list_(pa.float32())), "label": pa.array([None if k % 50 == 0 else k % 3 for k in range(n)], pa.int32())}), f"{path}/embeddings.parquet")


def joins_of_rows(df):
    return [p for p in df._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in p and "low_x" not in p]


def test_similar_pairs_meet_in_matrices(spark, tmp_path, monkeypatch):
    """Several matrices a label, copies, null and zero vectors; no join of single vectors."""
    monkeypatch.setattr(vectors, "PART", 100)
    embeddings(tmp_path, 1500, 40)
    same(spark, *search.QUERIES["similar_pairs"], str(tmp_path))
    assert not joins_of_rows(search.QUERIES["similar_pairs"][0](spark, str(tmp_path)))


def test_banded_pairs_at_a_low_bound_meet_in_matrices(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vectors, "PART", 100)
    embeddings(tmp_path, 700)
    same(spark, *search.QUERIES["similar_pairs_banded"], str(tmp_path))
    assert not joins_of_rows(search.QUERIES["similar_pairs_banded"][0](spark, str(tmp_path)))


def test_many_queries_shuffle_no_scores(spark, tmp_path, monkeypatch):
    """Several blocks of queries and of documents, copies (ties) over blocks, queries without a hit, empty and null texts."""
    monkeypatch.setattr(bm25, "QUERIES", 3)
    monkeypatch.setattr(bm25, "DOCUMENTS", 7)
    texts = [None, "", *[" ".join(f"w{k * j % 11}x" for j in range(1, 2 + k % 6)) for k in range(60)], *["same text w1x"] * 12]
    pq.write_table(pa.table({"doc_id": pa.array([None, *range(1, len(texts))], pa.int64()), "text": pa.array(texts)}), f"{tmp_path}/documents.parquet")
    asked = [*[f"w{k}x w{k + 1}x w{k}x" for k in range(8)], "same", "nothing like it", "", None]
    pq.write_table(pa.table({"item_id": pa.array(range(len(asked)), pa.int64()), "text": pa.array(asked)}), f"{tmp_path}/benchmark.parquet")
    same(spark, *search.QUERIES["bm25_multi_query"], str(tmp_path))
    same(spark, *search.QUERIES["multi_query_merge"], str(tmp_path))
    plan = search.QUERIES["bm25_multi_query"][0](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan


def test_many_queries_leave_texts_of_many_tasks_where_they_are(spark, tmp_path):
    """A table of as many files as cores isn't shuffled; documents without tokens count in the average length, and so do words of most documents in the mean."""
    texts = ["w1x", "!!", "? ?", *[" ".join(f"w{k * j % 11}x" for j in range(1, 2 + k % 6)) for k in range(60)], *["same text w1x"] * 80]
    table = pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts)})
    for k in range(8):
        (tmp_path / "documents.parquet").mkdir(exist_ok=True)
        pq.write_table(table.slice(k * 20, 20 if k < 7 else None), f"{tmp_path}/documents.parquet/{k}.parquet")
    pq.write_table(pa.table({"item_id": pa.array(range(3), pa.int64()), "text": pa.array(["w1x w2x text", "same w5x", "none"])}), f"{tmp_path}/benchmark.parquet")
    same(spark, *search.QUERIES["multi_query_merge"], str(tmp_path))
    plan = search.QUERIES["multi_query_merge"][0](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" not in plan
