"""Commits as a table and as a stream."""

import subprocess

import pytest

from tessera.api import Engine
from tessera.sources import git

BODY = "def work(a):\n    first = a + 1\n    second = first * 2\n    return second  # a line of some length\n"


class Repo:
    def __init__(self, path):
        self.path = str(path)
        path.mkdir()
        self("init", "-q", "-b", "main")

    def __call__(self, *args):
        return subprocess.run(["git", "-C", self.path, "-c", "user.name=a", "-c", "user.email=a@b.c", *args], check=True, capture_output=True, text=True).stdout.strip()

    def commit(self, subject, **files):
        for name, text in files.items():
            name = name.replace("__", ".")
            if text is None:
                self("rm", "-q", name)
            else:
                with open(f"{self.path}/{name}", "w") as f:
                    f.write(text)
        self("add", "-A")
        self("commit", "-q", "--allow-empty", "-m", subject)
        return self("rev-parse", "HEAD")


@pytest.fixture
def repo(tmp_path):
    r = Repo(tmp_path / "repo")
    r.commit("first", one__py=BODY, readme__txt="x")
    r.commit("second\twith a tab", two__py=BODY.replace("work", "other"), one__py=BODY + "# more\n")
    r("mv", "one.py", "naïve.py")
    r.commit("third")
    r.commit("empty")
    r.commit("fifth", two__py=None)
    return r


def test_changes_do_not_depend_on_partitions(spark, repo):
    git.register(spark)
    read = lambda **o: [tuple(r) for r in spark.read.format("git_changes").option("path", repo.path).options(**o).load().orderBy("n", "file_path").collect()]
    one, many = read(), read(size="1")
    assert one == many
    assert [(n, path, kind, old) for n, _, _, _, path, kind, old, _ in one] == [(0, "one.py", "added", None), (0, "readme.txt", "added", None), (1, "one.py", "modified", None), (1, "two.py", "added", None), (2, "naïve.py", "renamed", "one.py"), (4, "two.py", "deleted", None)]
    assert one[2][3] == "second\twith a tab" and one[-1][-1] is None
    assert read(since=one[2][1]) == one[4:]
    commits = spark.read.format("git_commits").option("path", repo.path).option("size", "2").load().orderBy("n").collect()
    assert [(r.n, r.files) for r in commits][3:] == [(3, []), (4, ["two.py"])]


def test_contents_are_those_of_the_commit(spark, repo):
    git.register(spark)
    rows = spark.read.format("git_changes").option("path", repo.path).load().where("file_path = 'one.py'")
    assert {bytes(r.content).decode() for r in git.contents(repo.path, rows).collect()} == {BODY, BODY + "# more\n"}


def test_one_commit(spark, repo, tmp_path):
    engine = Engine(spark, str(tmp_path / "store"))
    got = engine.commit_diff(repo.path, repo("rev-parse", "HEAD~2")).collect()
    assert [(r.file_path, r.change_type, r.old_path) for r in got] == [("naïve.py", "renamed", "one.py")]


def test_a_stream_of_commits_starts_over_after_the_last_good_one(spark, repo, tmp_path, monkeypatch):
    """An old commit is stored as it was, a broken one stops the stream, and a restart goes on there, with what came meanwhile in a remote."""
    clone = Repo(tmp_path / "clone")
    clone("remote", "add", "origin", repo.path)
    clone("fetch", "-q", "origin", "main")
    clone("reset", "-q", "--hard", "origin/main")
    engine, seen = Engine(spark, str(tmp_path / "store")), []
    real = engine._replace

    def broken(rows, project, touched=None):
        if "two.py" in {r.path for r in touched.collect()} and "two.py" not in {r.path for r in rows.collect()}:
            raise ValueError("no luck")
        out = real(rows, project, touched)
        seen.append(sorted((r.file_path, r.function_name) for r in engine.chunks.read().collect()))
        return out

    monkeypatch.setattr(engine, "_replace", broken)
    query = engine.follow_commits(clone.path, "p", remote="origin")
    with pytest.raises(Exception, match="no luck"):
        query.awaitTermination(120)
    assert seen == [[("one.py", "work")], [("one.py", "work"), ("two.py", "other")], [("naïve.py", "work"), ("two.py", "other")]]
    assert engine._last_commit("p")[0] == 2  # the empty commit has nothing to do
    monkeypatch.setattr(engine, "_replace", real)
    repo.commit("sixth", six__py=BODY)
    for _ in range(2):  # what the first run had planned, then what is new
        assert engine.follow_commits(clone.path, "p", remote="origin").awaitTermination(120)
    assert sorted(r.file_path for r in engine.chunks.read().collect()) == ["naïve.py", "six.py"]
    assert engine._last_commit("p") == (5, repo("rev-parse", "HEAD"))
    assert engine.process_commits(clone.path, "p").count() == 0
