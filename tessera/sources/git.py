"""Git as a data source: tracked files, commits and changes (batch and stream), contents, remote head.

``spark.read.format("git_files").option("path", repo)`` gives file_path and
file_hash at a revision; ``git_commits`` gives commits, oldest first by number,
with their files; ``git_changes`` gives a row for each file that a commit
changed, and is a stream too. The listing of commits is cut into partitions of
``size`` commits, and each partition is one ``git log --raw`` process that is
told its commits. :func:`contents` reads files as they were at a commit.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Commits of a partition.
SIZE = 512
CHANGES = "n long, commit string, committed_at long, subject string, file_path string, change_type string, old_path string, blob string"
KINDS = {"A": "added", "C": "added", "D": "deleted", "M": "modified", "T": "modified", "R": "renamed"}


def git(repo: str, *args: str, timeout: int = 120, text_in: str | None = None) -> str:
    """Output of a git command."""
    return subprocess.run(["git", "-c", "safe.directory=*", "-C", repo, *args], check=True, capture_output=True, text=True, errors="surrogateescape", input=text_in, timeout=timeout).stdout


def readable(text: str) -> str:
    """Text without the bytes that no UTF-8 has."""
    return text.encode(errors="surrogateescape").decode(errors="replace")


@dataclass
class Commits(InputPartition):
    """Commits in order, the first with a number."""

    first: int
    names: list[str]


def listed(repo: str, revision: str, since: str | None) -> list[str]:
    """Commits after ``since`` up to ``revision``, parents first."""
    span = f"{since}..{revision}" if since else revision
    return git(repo, "rev-list", "--reverse", "--topo-order", span).split()


def parts(repo: str, revision: str, since: str | None, size: int) -> list[Commits]:
    """The same, cut into partitions and numbered from the first commit of the history."""
    names = listed(repo, revision, since)
    before = int(git(repo, "rev-list", "--count", since)) if since else 0
    return [Commits(before + k, names[k : k + size]) for k in range(0, len(names), size)]


def changes(repo: str, part: Commits) -> Iterator[tuple[int, str, int, str, list[tuple[str, str, str | None, str | None]]]]:
    """(number, commit, time, subject, [(path, change, old path, blob)]) of each commit, from one process; merges are compared with their first parent."""
    if not part.names:
        return
    form = "--format=%x01%H%x09%ct%x09%s"
    out = git(repo, "log", "--no-walk=unsorted", "--stdin", "--raw", "-r", "-z", "-M", "--root", "--no-abbrev", "--diff-merges=first-parent", form, text_in="\n".join(part.names) + "\n")
    for n, entry in enumerate(out.split("\x01")[1:]):
        head, _, raw = entry.partition("\0")
        commit, at, subject = head.split("\t", 2)
        fields, touched = iter(raw.lstrip("\n").split("\0")), []
        for field in fields:
            if not field.startswith(":"):
                continue
            _, _, _, blob, kind = field.split(" ")
            old = readable(next(fields)) if kind[0] in "RC" else None
            path = readable(next(fields))
            touched.append((path, KINDS.get(kind[0], "modified"), old if kind[0] == "R" else None, None if kind == "D" else blob))
        yield part.first + n, commit, int(at), readable(subject), touched


class _Options:
    def __init__(self, options: dict):
        self.repo, self.revision, self.since = options["path"], options.get("revision", "HEAD"), options.get("since") or None
        self.size = int(options.get("size", SIZE))
        self.remote, self.branch = options.get("remote"), options.get("branch", "main")


class _Files(_Options, DataSourceReader):
    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition):
        for entry in git(self.repo, "ls-tree", "-r", "-z", self.revision).split("\0"):
            if entry:
                facts, path = entry.split("\t", 1)
                yield (readable(path), facts.split()[2])


class _Log(_Options, DataSourceReader):
    def partitions(self):
        return parts(self.repo, self.revision, self.since, self.size) or [Commits(0, [])]


class _Commits(_Log):
    def read(self, partition):
        for n, commit, at, subject, touched in changes(self.repo, partition):
            yield (n, commit, at, subject, [t[0] for t in touched])


class _Changes(_Log):
    def read(self, partition):
        for n, commit, at, subject, touched in changes(self.repo, partition):
            for path, kind, old, blob in touched:
                yield (n, commit, at, subject, path, kind, old, blob)


class _ChangeStream(_Options, DataSourceStreamReader):
    """An offset is the last commit that was read; with a remote, a new head there is fetched and the same one costs a probe."""

    def initialOffset(self):
        return {"commit": self.since or ""}

    def latestOffset(self):
        if self.remote:
            head = remote_head(git(self.repo, "remote", "get-url", self.remote).strip(), self.branch)
            if head:
                if subprocess.run(["git", "-c", "safe.directory=*", "-C", self.repo, "cat-file", "-e", head], capture_output=True).returncode:
                    git(self.repo, "fetch", "-q", self.remote, self.branch, timeout=600)
                return {"commit": head}
        return {"commit": git(self.repo, "rev-parse", self.revision).strip()}

    def partitions(self, start, end):
        return parts(self.repo, end["commit"], start["commit"] or None, self.size) if end["commit"] and start != end else []

    def read(self, partition):
        return _Changes.read(self, partition)

    def commit(self, end):
        pass


class GitFiles(DataSource):
    """Tracked files of a revision."""

    @classmethod
    def name(cls):
        return "git_files"

    def schema(self):
        return "file_path string, file_hash string"

    def reader(self, schema):
        return _Files(self.options)


class GitCommits(DataSource):
    """Commits after ``since`` (all, if it isn't given)."""

    @classmethod
    def name(cls):
        return "git_commits"

    def schema(self):
        return "n long, commit string, committed_at bigint, subject string, files array<string>"

    def reader(self, schema):
        return _Commits(self.options)


class GitChanges(DataSource):
    """Changed files of commits after ``since``, as a table or as a stream."""

    @classmethod
    def name(cls):
        return "git_changes"

    def schema(self):
        return CHANGES

    def reader(self, schema):
        return _Changes(self.options)

    def streamReader(self, schema):
        return _ChangeStream(self.options)


def register(spark: SparkSession) -> None:
    """Make the formats known."""
    for source in (GitFiles, GitCommits, GitChanges):
        spark.dataSource.register(source)


def contents(repo: str, changed: DataFrame) -> DataFrame:
    """path, modificationTime, length, content of rows (file_path, blob, committed_at), as they were at their commit; one ``git cat-file`` process a partition."""
    schema = "path string, committed_at long, length long, content binary"

    def read(batches):
        import pyarrow as pa

        with subprocess.Popen(["git", "-c", "safe.directory=*", "-C", repo, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE) as process:
            for batch in batches:
                for path, blob, at in zip(*(c.to_pylist() for c in batch.columns)):
                    process.stdin.write(f"{blob}\n".encode())
                    process.stdin.flush()
                    head = process.stdout.readline().split()
                    if len(head) != 3:
                        raise ValueError(f"{path}: no object {blob}")
                    text = process.stdout.read(int(head[2]))
                    process.stdout.read(1)
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([at], pa.int64()), pa.array([len(text)], pa.int64()), pa.array([text], pa.binary())], names=["path", "committed_at", "length", "content"])
            process.stdin.close()

    found = changed.where("blob is not null").select("file_path", "blob", "committed_at").mapInArrow(read, schema)
    return found.select("path", F.timestamp_seconds("committed_at").alias("modificationTime"), "length", "content")


def remote_head(url: str, branch: str = "main", timeout: int = 30) -> str | None:
    """The head of a remote branch, or None."""
    try:
        out = subprocess.run(["git", "ls-remote", url, f"refs/heads/{branch}"], check=True, capture_output=True, text=True, timeout=timeout).stdout
    except (subprocess.SubprocessError, OSError):
        return None
    return out.split()[0] if out.strip() else None
