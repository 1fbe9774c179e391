"""The facade and the commands, end to end on a small repository."""

import io
import json
import subprocess

import pytest
from pyspark.sql import functions as F

from tessera import cli
from tessera.api import Engine
from tessera.operators import parsers
from tessera.operators.store import Store
from tessera.sources import files

CODE = '''class Order{n}Service:
    """Orders of kind {n}."""

    def total(self, rows: list) -> float:
        first = sum(rows)
        second = first * {n}
        return second  # the total of all rows

    def cancel(self, reason: str) -> None:
        self.reason = reason
        self.done = True
        return None  # nothing is left to do here
'''


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("engine")
    repo = root / "repo"
    (repo / "app").mkdir(parents=True)
    for n in range(6):
        (repo / "app" / f"order_{n}.py").write_text(CODE.format(n=n) + ("api_key = 'abcdefghijklmnopqrstuvwx'\n" if n == 3 else ""))
    (repo / "app" / "copy.py").write_text(CODE.format(n=0))
    found = Engine(spark, str(root / "store"))
    found.repo = str(repo)
    found.process_repository(found.repo, "p")
    return found


def test_searches_read_the_indexes(engine):
    hit = engine.hybrid_search("Order4Service total", 3).collect()
    assert hit[0].file_path == "app/order_4.py" and "embedding" not in hit[0].asDict() and "content" in hit[0].asDict()
    assert {r.file_path for r in engine.hybrid_search("cancel reason", 20, "keyword", filters={"file_path": "app/order_1.py"}).collect()} == {"app/order_1.py"}
    assert engine.hybrid_search("total", 5, project="other").count() == 0
    vector = engine.semantic_search("Order2Service", 2, with_vector=True, with_content=False)
    assert len(vector[0]["embedding"]) == 64 and "content" not in vector[0].asDict()
    text = engine.chunks.read().where("class_name = 'Order5Service' and function_name = ''").first()["content"]
    near = engine.similar_code(text, 3, 0.5, without_file="app/order_5.py", with_content=True).collect()
    assert near and all(r.file_path != "app/order_5.py" for r in near)


def test_a_second_ingest_embeds_nothing(engine):
    engine.process_repository(engine.repo, "p")
    uses = engine.memo.stats().orderBy("use").collect()
    assert uses[0].made > 0 and uses[-1].made == 0 and uses[-1].hits == uses[-1].asked


def test_updates_reach_the_indexes(engine):
    path = f"{engine.repo}/app/order_1.py"
    before = engine.vector_index().batches()
    with open(path, "w") as f:
        f.write(CODE.format(n=77))
    assert engine.process_update(engine.repo, "p") == {"modified": 1}
    assert engine.hybrid_search("Order77Service", 1).first().file_path == "app/order_1.py"
    after = engine.vector_index().batches()
    assert after[: len(before)] == before and sum(n for _, n in after[-1]["cells"].values()) < 5
    status = engine.system_status()
    assert status["projects"] == 1 and status["vectors"]["batches"] == len(after) and status["memo"]["hits"] > 0
    found = engine.store_statistics()
    assert {(r.language, r.low <= r.estimate <= r.high) for r in found["language"].collect()} == {("python", True)}
    assert found["distinct"].first()["file_path"] == 7


def test_rejects_are_kept(engine, monkeypatch):
    from tessera.operators import vectors

    real = engine.embed
    monkeypatch.setattr(engine, "embed", lambda c: F.when(~c.contains("reject me"), real(c)))
    path = f"{engine.repo}/app/bad.py"
    with open(path, "w") as f:
        f.write(CODE.format(n=9).replace("nothing is left", "reject me: nothing is left"))
    got = engine.process_files([path], engine.repo, "p")
    assert got["rejected"] == 1 and {r.file_path for r in got["errors"].collect()} == {"app/bad.py"}
    assert engine.errors(project_id="p").first()["n"] == 1
    assert vectors.MOST_RESULTS == 100


def test_commands(engine, capsys):
    def run(*arguments):
        out = io.StringIO()
        assert cli.main(["--store", engine.path, *arguments], spark=engine.spark, out=out) == 0
        return out.getvalue().splitlines()

    rows = [json.loads(x) for x in run("--format", "json", "--limit", "2", "search", "Order4Service total")]
    assert len(rows) == 2 and rows[0]["file_path"] == "app/order_4.py"
    assert all("app/order_2.py" in x for x in run("--format", "simple", "find", "--language", "python", "--glob", "app/order_2.py"))
    assert run("status") and run("projects") and run("secrets") and run("memo")
    assert len(run("--limit", "1", "--format", "json", "find", "--offset", "1")) == 1
    assert cli.main(["--store", engine.path + "-none", "find"], spark=engine.spark) == 1


def test_tracked_files_and_states(spark, tmp_path):
    repo = tmp_path / "repo"
    repo.mkdir()
    run = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=a", "-c", "user.email=a@b.c", *a], check=True, capture_output=True, text=True).stdout
    run("init", "-q")
    for name in ("same.py", "changed.py", "gone.py"):
        (repo / name).write_text(f"x = '{name} é'\n")
    run("add", "-A")
    run("commit", "-qm", "one")
    (repo / "changed.py").write_text("other\n")
    (repo / "gone.py").unlink()
    got = {r.file_path: (r.head_hash == r.file_hash, r.file_hash) for r in files.tracked(spark, str(repo)).collect()}
    assert got["same.py"][0] and not got["changed.py"][0] and got["gone.py"][1] is None
    assert got["changed.py"][1] == run("hash-object", "changed.py").strip()

    (tmp_path / "old").mkdir()
    (tmp_path / "old" / "a.json").write_text(json.dumps({"project_id": "p", "file_hashes": {"x.py": "1", "y.py": "2"}}))
    (tmp_path / "old" / "b.json").write_text(json.dumps({"file_hashes": {"z.py": "3"}}))
    states = Store(spark, str(tmp_path / "states"), "state_id")
    assert files.import_states(spark, str(tmp_path / "old"), states) == 3
    assert {(r.project_id, r.file_path) for r in states.read().collect()} == {("p", "x.py"), ("p", "y.py"), ("default", "z.py")}
    assert sorted(p.name for p in (tmp_path / "old").glob("*.json*")) == ["a.json.backup", "b.json.backup"]


def test_pieces_merge_neighbours_of_a_type():
    def piece(kind, size):
        return parsers.row("a.py", "python", 1, 2, "x" * (4 * size), type=kind)

    merge = lambda *p: [(c[9]["type"], c[7]) for c in parsers.merged_pieces("a.py", list(p), 50, 100)]
    assert merge(piece("m", 40), piece("m", 40), piece("m", 40)) == [("merged", 80), ("m", 40)]
    assert merge(piece("m", 20), piece("m", 20), piece("f", 90)) == [("m", 20), ("m", 20), ("f", 90)]
    parts = parsers.line_parts("a.py", "\n".join(["y" * 39] * 100), 50, 90)
    assert [(c[2], c[3]) for c in parts] == [(1 + 10 * k, 10 + 10 * k) for k in range(10)]
