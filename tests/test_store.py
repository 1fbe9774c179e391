"""The bucketed store, the embedding memo and the remote embedder."""

import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from tessera.operators import embedding, store, vectors
from tessera.operators.store import Conflict, Store
from tessera.sources.shared import Folder


def rows(spark, *r):
    return spark.createDataFrame(list(r), "chunk_id string, file_path string, n int")


def held(s):
    return sorted((r.chunk_id, r.file_path, r.n) for r in s.read().collect())


@pytest.mark.parametrize("first", [0, 1])
def test_of_two_writers_one_wins(spark, tmp_path, first):
    """Both begin from the same version and write; whichever publishes first wins, and the other leaves nothing."""
    s = Store(spark, str(tmp_path / "s"))
    s.write(rows(spark, ("a", "x", 1)))
    writers, frames = [Store(spark, s.path) for _ in "ab"], [rows(spark, (k, "y", 2)) for k in "bc"]
    base = s.manifest()
    for w in writers:
        w.manifest = lambda: base
    order = [first, 1 - first]
    writers[order[0]].upsert(frames[order[0]])
    for _ in range(2):  # a second try from the same base is no better
        with pytest.raises(Conflict):
            writers[order[1]].upsert(frames[order[1]])
    assert held(s) == [("a", "x", 1), ("bc"[order[0]], "y", 2)]
    used = set(s.manifest()["folders"].values()) | set(base["folders"].values())
    assert set(s.folder.names("rows-*")) == used


def test_only_one_of_many_creates(spark, tmp_path):
    folder, won = Folder(spark, str(tmp_path / "f")), []
    threads = [threading.Thread(target=lambda k=k: folder.create("version-1", str(k)) and won.append(k)) for k in range(16)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(won) == 1 and folder.read("version-1") == str(won[0])


def test_a_dead_writer_leaves_the_old_version(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"), grace=0)
    s.write(rows(spark, ("a", "x", 1)))
    rows(spark, ("b", "y", 2)).write.parquet(f"{s.path}/rows-dead")
    assert held(s) == [("a", "x", 1)]
    s.upsert(rows(spark, ("c", "x", 1)))
    s.vacuum()
    assert len(s.folder.names("version-*")) == 1 and "rows-dead" not in s.folder.names("rows-*")
    assert [r[0] for r in held(s)] == ["a", "c"]


def test_changes_write_what_they_touch(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"), by="file_path", buckets=16)
    s.write(rows(spark, *[(f"k{n}", f"f{n % 40}", n) for n in range(400)]))
    assert s.written == 400
    s.upsert(rows(spark, ("k7", "f7", -1), ("new", "f7", -2)))
    assert 10 < s.written < 100
    s.replace_files(rows(spark, ("", "f8", 0)).select("file_path"), rows(spark, ("k8", "f8", -3)))
    assert s.written < 100
    want = {f"k{n}": n for n in range(400) if n % 40 != 8} | {"k7": -1, "new": -2, "k8": -3}
    assert {k: n for k, _, n in held(s)} == want
    s.upsert(rows(spark, ("k8", "elsewhere", 5)))  # a key that moves to another bucket
    assert [r for r in held(s) if r[0] == "k8"] == [("k8", "elsewhere", 5)]
    s.delete_where({"file_path": "nothing"})
    assert s.version() == "v4"  # nothing was touched
    s.delete_ids(rows(spark, ("k9", "", 0)))
    assert s.get("k9").count() == 0 and s.get("k10").first().n == 10
    assert Store(spark, s.path, by="file_path").retained("n", F.lit(0)) and min(r[2] for r in held(s)) == 0


def test_a_store_grows_its_buckets(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"), buckets=1, bucket_rows=10)
    s.write(rows(spark, *[(f"k{n}", "f", n) for n in range(8)]))
    assert s.manifest()["buckets"] == 1
    s.upsert(rows(spark, *[(f"k{n}", "f", -n) for n in range(4, 40)]))
    assert s.manifest()["buckets"] == 8
    assert {k: n for k, _, n in held(s)} == {f"k{n}": n if n < 4 else -n for n in range(40)} and s.get("k3").first().n == 3


def test_columns_may_come(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    s.write(rows(spark, *[(f"k{n}", "f", n) for n in range(30)]))
    s.upsert(rows(spark, ("k1", "g", 1)).withColumn("more", F.lit("x")))
    assert Counter(r.more for r in s.read().collect()) == {None: 29, "x": 1}


def test_projects_are_made_once(spark, tmp_path):
    p = store.Projects(spark, str(tmp_path / "p"))
    row = spark.createDataFrame([("a", "one", "idle")], "project_id string, name string, status string")
    p.create(row)
    with pytest.raises(ValueError):
        p.create(row)
    p.update("a", status="active")
    assert [tuple(r) for r in p.read().collect()] == [("a", "one", "active")]


def test_memo_embeds_once_and_evicts_the_oldest(spark, tmp_path):
    now, texts = [1000.0], lambda *t: spark.createDataFrame([(k, x) for k, x in enumerate(t)], "id int, content string")
    memo = embedding.EmbeddingMemo(spark, str(tmp_path / "m"), seconds=100, most=4, clock=lambda: now[0])
    embed = vectors.hashed_embedder(8)
    out = {r.id: (r.embedding is not None, r.embedding_status) for r in memo.embed(texts("a one", "b two", "a one", " ", None), embed).collect()}
    assert out == {0: (True, "completed"), 1: (True, "completed"), 2: (True, "completed"), 3: (False, "failed"), 4: (False, "failed")}
    now[0] += 10
    memo.embed(texts("a one", "c three", "d four"), embed)
    never = F.udf(lambda c: 1 / 0, "array<float>")
    now[0] += 10
    assert memo.embed(texts("d four", "c three"), never).where("embedding_status = 'completed'").count() == 2
    now[0] += 10
    memo.embed(texts("e five", "f six"), embed)
    now[0] += 85  # the first use's rows were evicted, the second's are too old
    memo.embed(texts("c three", "e five"), embed)
    got = [(r.asked, r.hits, r.made, r.failed, r.evicted) for r in memo.stats().orderBy("use").collect()]
    assert got == [(2, 0, 2, 0, 0), (3, 1, 2, 0, 0), (2, 2, 0, 0, 0), (2, 0, 2, 0, 2), (2, 1, 1, 0, 1)]
    assert memo.rows.read().count() == 3


class Service(BaseHTTPRequestHandler):
    """Busy on every third request, broken for texts with "bad", and down at first."""

    asked, at_once, most, seen = 0, 0, 0, Counter()
    lock = threading.Lock()

    def do_POST(self):
        me = Service
        with me.lock:
            me.asked += 1
            n, me.at_once = me.asked, me.at_once + 1
            me.most = max(me.most, me.at_once)
        texts = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["input"]
        status = 500 if n == 1 else 429 if n % 3 == 0 else 422 if any("bad" in t for t in texts) else 200
        body = json.dumps({"data": [{"index": k, "embedding": [float(len(t)), 1.0]} for k, t in reversed(list(enumerate(texts)))]}).encode() if status == 200 else b""
        with me.lock:
            me.seen[status] += 1
            me.at_once -= 1
        self.send_response(status)
        if status == 429:
            self.send_header("Retry-After", "0.05")
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


def test_remote_embedder(spark):
    server = ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        embed = embedding.remote_embedder(f"http://127.0.0.1:{server.server_port}/", batch=4, at_once=3, tries=8, wait=0.01)
        texts = [f"text {k} " + "x" * k for k in range(30)] + ["a bad one"]
        got = {r.t: r.v for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select("t", embed(F.col("t")).alias("v")).collect()}
        assert got["a bad one"] is None and all(got[t] == [float(len(t)), 1.0] for t in texts[:-1])
        assert Service.seen[500] == 1 and Service.seen[429] > 0 and Service.most <= 3
        gone = embedding.RemoteClient("http://127.0.0.1:9/", tries=2, wait=0.01)
        assert gone.embed_all(["a", "b"]) == [None, None]
    finally:
        server.shutdown()
