"""Stored indexes against plain computations."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import bm25, vector_index
from tessera.operators.keyword_index import KeywordIndex
from tessera.operators.vector_index import VectorIndex

WORDS = [f"w{k}" for k in range(60)]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    rows = [(k, " ".join(rng.choices(WORDS, [1 / (j + 1) for j in range(60)], k=rng.randint(0, 40)))) for k in range(1500)]
    rows += [(3000 + k, "rare " * 6 + "w1") for k in range(10)] + [(4000 + k, "rare " + "w2 w3 " * 30) for k in range(60)]
    return spark.createDataFrame(rows + [(2000, None), (2001, "!")], "doc_id long, text string")


@pytest.fixture(scope="module")
def index(spark, corpus, tmp_path_factory):
    found = KeywordIndex(spark, str(tmp_path_factory.mktemp("keywords")), "1")
    assert not found.ready()
    found.build(bm25.tokenized(corpus))
    assert found.ready()
    return found


@pytest.mark.parametrize("query", ["w0 w1", "w40 w59 w0", "w59", "w3 w3 w50 nothere", "nothere", "", "w0 w1 w2 w3 w4 w5 w55"])
@pytest.mark.parametrize("filtered", [False, True])
def test_pruned_search_is_exact(corpus, index, query, filtered):
    allowed = corpus.where("doc_id % 3 = 1").select("doc_id") if filtered else None
    scores = {r.id: r.score for r in bm25.scores(bm25.tokenized(corpus), query).collect() if not filtered or r.id % 3 == 1}
    order = lambda rows: sorted(rows, key=lambda x: (-x[1], x[0]))[:7]
    got = [(r.id, r.score) for r in index.search(query, 7, allowed, first=2, direct=0).collect()]
    assert got == order([x for x in scores.items() if x[1]])
    if query not in ("", "nothere"):
        got = [(r.id, r.score) for r in index.search(query, 7, allowed, zeros=True, first=2, direct=0).collect()]
        assert got == order(scores.items())


def test_pruning_reads_less(index):
    report = index.report("rare", 5, first=2)
    assert report["segments_read"] < report["segments"] and report["postings_read"] < report["postings"]


def test_index_versions(spark, corpus, index, tmp_path):
    old, new = (KeywordIndex(spark, str(tmp_path), v) for v in "12")
    old.build(bm25.tokenized(corpus.limit(0)))
    assert old.search("w1").count() == 0 and old.size().first()["documents"] == 0
    new.build(bm25.tokenized(corpus.limit(5)))
    new.drop_others()
    assert new.ready() and not old.ready()


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8))
    rows = [(k, k % 4, (centres[k % 12] + 0.3 * rng.normal(size=8)).tolist()) for k in range(900)]
    rows += [(2000, 1, [0.0] * 8), (2001, 1, None), (2002, 1, [1.0] * 3), (None, 1, [1.0] * 8), (2003, 1, [float("nan")] * 8)]
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")


def near(rows, q, k, keep=lambda r: True):
    out = []
    for r in rows:
        if r.vec_id is not None and r.vec_id < 2000 and keep(r):
            v = np.array(r.embedding)
            out.append((-round(float(v @ q / np.linalg.norm(v) / np.linalg.norm(q)), 6), r.vec_id))
    return [i for _, i in sorted(out)[:k]]


def test_vector_index(spark, vectors, tmp_path):
    index, rows = VectorIndex(spark, str(tmp_path / "v")), vectors.collect()
    index.build(vectors)
    rng, hits = np.random.default_rng(8), 0
    for q in np.array([rows[k].embedding for k in range(0, 300, 50)]) + 0.1 * rng.normal(size=(6, 8)):
        want = near(rows, q, 10)
        assert [r.id for r in index.search(q.tolist(), 10, -1.0, exact=True, direct=0).collect()] == want
        hits += len({*want} & {r.id for r in index.search(q.tolist(), 10, -1.0).collect()})
    assert hits >= 57
    q = np.array(rows[5].embedding)
    assert index.read_share(q.tolist()) < 0.5 and index.read_share(q.tolist(), exact=True) < 1
    assert [r.id for r in index.search(q.tolist(), 10, -1.0, where=F.col("label") == 2, exact=True, direct=0).collect()] == near(rows, q, 10, lambda r: r.label == 2)
    few = spark.createDataFrame([(k,) for k in range(0, 900, 7)], "id long")
    assert [r.id for r in index.search(q.tolist(), 10, -1.0, allowed=few, exact=True, direct=0).collect()] == near(rows, q, 10, lambda r: r.vec_id % 7 == 0)

    before = {f["folder"] for f in index.batches()}
    changed = spark.createDataFrame([(5, 0, (-q).tolist()), (1500, 0, q.tolist()), (1501, 0, [0.0] * 8)], vectors.schema)
    index.insert(changed)
    index.delete(spark.createDataFrame([(17,)], "vec_id long"))
    assert before < {f["folder"] for f in index.batches()}  # nothing is written again
    present = [r for r in rows if r.vec_id not in (5, 17)] + [r for r in changed.collect() if r.vec_id != 1501]
    for _ in range(2):
        assert [r.id for r in index.search(q.tolist(), 10, -1.0, exact=True, direct=0).collect()] == near(present, q, 10)
        assert index.read().count() == 900
        index.compact()
    assert len(index.batches()) == 1
    other = VectorIndex(spark, str(tmp_path / "v"))
    other.insert(changed)
    with pytest.raises(RuntimeError):
        number = index.batches()[-1]["number"]
        index._write(number, changed, None)
    assert VectorIndex(spark, str(tmp_path / "v")).read().count() == 900


def test_banded_pairs_find_all_near_ones(spark, vectors):
    rows = [r for r in vectors.where("vec_id < 300").collect()]
    copies = spark.createDataFrame([(5000 + r.vec_id, r.label, r.embedding) for r in rows[:3]], vectors.schema)
    got = {(r.a, r.b): (r.score, r.a_copies) for r in vector_index.similar_pairs(vectors.where("vec_id < 300").unionByName(copies), 0.9, recall=0.9999).collect()}
    v = np.array([r.embedding for r in rows])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    near = np.triu(np.round(v @ v.T, 6) >= 0.9, 1)
    want = {(rows[a].vec_id, rows[b].vec_id) for a, b in zip(*np.nonzero(near))}
    assert len(want & set(got)) >= 0.999 * len(want) and set(got) <= want
    assert all(n == (2 if a < 3 else 1) for (a, _), (_, n) in got.items())
    inside = vector_index.similar_pairs(vectors.where("vec_id < 300"), 0.9, recall=0.9999, block="label").collect()
    assert inside and all(r.a % 4 == r.b % 4 for r in inside)
