"""Facade: the calls of the service's routes and commands as Python functions."""

from __future__ import annotations

import time
from collections import OrderedDict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from .operators import bm25, changes, fusion, history, parsers, security, sketches, stats, vectors
from .operators.embedding import EmbeddingMemo
from .operators.keyword_index import KeywordIndex
from .operators.store import Projects, Store, chunk_id, matching, metadata_search, stored_rows
from .operators.vector_index import VectorIndex
from .sources import files, git
from .sources.shared import Folder


class Cache:
    """Bounded cache of results with a time to live; counts hits, misses and evictions."""

    def __init__(self, most: int, seconds: float, clock=time.monotonic):
        self.most, self.seconds, self.clock = most, seconds, clock
        self.held: OrderedDict = OrderedDict()
        self.hits = self.misses = self.evictions = 0

    def get(self, key, make):
        """The value of a key, made if it is missing or too old."""
        now = self.clock()
        if key in self.held and now - self.held[key][0] < self.seconds:
            self.hits += 1
            self.held.move_to_end(key)
            return self.held[key][1]
        self.misses += 1
        value = make()
        self.held[key] = (now, value)
        self.held.move_to_end(key)
        while len(self.held) > self.most:
            self.held.popitem(last=False)
            self.evictions += 1
        return value

    def stats(self) -> dict:
        """Counters and hit rate."""
        asked = self.hits + self.misses
        return {"size": len(self.held), "hits": self.hits, "misses": self.misses, "evictions": self.evictions, "hit_rate": self.hits / asked if asked else 0.0}


class Engine:
    """A chunk store, a project table and searches over them, under one folder."""

    def __init__(self, spark: SparkSession, path: str, dims: int = 64):
        self.spark, self.dims = spark, dims
        self.path = path.rstrip("/")
        self.chunks, self.projects, self.states = Store(spark, f"{path}/chunks", by="file_path"), Projects(spark, f"{path}/projects"), Store(spark, f"{path}/states", "state_id")
        self.rejects = Store(spark, f"{path}/rejects")
        self.embed, self.memo = vectors.hashed_embedder(dims), EmbeddingMemo(spark, f"{path}/embeddings")
        self.cache = Cache(500, 300)

    # ingest

    def _ingest(self, rows: DataFrame, project: str) -> tuple[DataFrame, DataFrame]:
        """(rows to store, rejects with their error)."""
        parsed = parsers.parse(rows).join(rows.select(F.col("path").alias("file_path"), "file_hash"), "file_path")
        named = parsed.withColumns({"project_id": F.lit(project), "project_name": F.lit(project), "last_updated": F.current_timestamp()})
        named = named.withColumn("chunk_id", chunk_id(F.col("project_id"), F.col("file_path"), F.col("start_line"), F.concat_ws(".", "class_name", "function_name")))
        embedded = self.memo.embed(security.scan(named.dropDuplicates(["chunk_id"])), self.embed)
        return stored_rows(embedded, dims=self.dims)

    def process_repository(self, root: str, project: str) -> DataFrame:
        """Read, parse, mask, embed and store a repository; statistics by language and layer."""
        rows = files.repository(self.spark, root, project)
        self._replace(rows, project)
        self._save_state(rows.select("path", "file_hash"), project)
        return stats.grouping_counts(self.chunks.read().where(F.col("project_id") == project), "language", "layer_type", tokens="token_count")

    def process_files(self, paths: list[str], root: str, project: str) -> dict:
        """The same for some files; stored, rejected, version, and the rejects as a table (``errors``)."""
        return self._replace(files.listed(self.spark, paths, root, project), project)

    def process_commits(self, repo: str, project: str) -> DataFrame:
        """Bring the store up to date commit by commit, oldest first: commit, status, error.

        Files are read as they were at their commit. The last good commit is
        kept after each; the first failure ends the run, and the next call
        begins after the last good one.
        """
        last = self._last_commit(project)
        git.register(self.spark)
        reader = self.spark.read.format("git_changes").option("path", repo)
        done = self._apply((reader.option("since", last[1]) if last else reader).load(), repo, project)
        return self.spark.createDataFrame(done, "commit string, status string, error string")

    def follow_commits(self, repo: str, project: str, remote: str | None = None, branch: str = "main", every: str | None = None) -> StreamingQuery:
        """The same as a stream that starts over after the last good commit; a failure ends the query with its error.

        ``every`` keeps it running at an interval (without it all that is there
        is done once). With a ``remote`` its head is asked each time, and fetched
        only if it is new.
        """
        git.register(self.spark)
        reader = self.spark.readStream.format("git_changes").option("path", repo)
        if remote:
            reader = reader.option("remote", remote).option("branch", branch)

        def batch(rows: DataFrame, number: int) -> None:
            for commit, status, error in self._apply(rows, repo, project):
                if status == "failed":
                    raise RuntimeError(f"commit {commit}: {error}")

        writer = reader.load().writeStream.foreachBatch(batch).option("checkpointLocation", f"{self.path}/commits-{project}")
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()

    def _progress(self) -> Store:
        return Store(self.spark, f"{self.path}/progress", "project_id", buckets=1)

    def _last_commit(self, project: str) -> tuple[int, str] | None:
        """Number and name of a project's last good commit."""
        held = self._progress().read()
        row = held.where(F.col("project_id") == project).first() if held is not None else None
        return (row["n"], row["commit"]) if row else None

    def _apply(self, rows: DataFrame, repo: str, project: str) -> list[tuple[str, str, str | None]]:
        """Apply changes commit by commit until one fails; commits that are done already are left out, so a batch may come again."""
        progress, last, done = self._progress(), self._last_commit(project), []
        rows = rows.where(F.col("n") > last[0]) if last else rows
        rows = rows.cache()
        try:
            for c in rows.groupBy("n", "commit", "committed_at").agg(F.count(F.lit(1))).orderBy("n").collect():
                try:
                    mine = rows.where((F.col("n") == c["n"]) & F.col("file_path").rlike("(" + "|".join(s.replace(".", r"\.") for s in files.SUFFIXES) + ")$"))
                    gone, todo = changes.work_sets(mine)
                    touched = gone.union(todo).distinct().withColumnRenamed("file_path", "path")
                    if not mine.isEmpty():
                        self._replace(files.committed(repo, mine, project), project, touched)
                    progress.upsert(self.spark.createDataFrame([(project, c["n"], c["commit"], c["committed_at"])], "project_id string, n long, commit string, committed_at bigint"))
                except Exception as error:  # noqa: BLE001
                    done.append((c["commit"], "failed", str(error)[:500]))
                    break
                done.append((c["commit"], "completed", None))
        finally:
            rows.unpersist()
        return done

    def commit_diff(self, repo: str, commit: str) -> DataFrame:
        """What one commit changed: file_path, change_type, old_path, file_hash."""
        git.register(self.spark)
        one = self.spark.read.format("git_changes").option("path", repo).option("revision", commit).load()
        return one.where(F.col("commit") == commit).select("file_path", "change_type", "old_path", F.col("blob").alias("file_hash"))

    def _replace(self, rows: DataFrame, project: str, touched: DataFrame | None = None) -> dict:
        """Store the chunks of some files in place of all that the project has of them (or of the ``touched`` paths)."""
        good, bad = self._ingest(rows, project)
        gone = (rows if touched is None else touched).select(F.lit(project).alias("project_id"), F.col("path").alias("file_path")).distinct()
        errors = bad.select("chunk_id", "project_id", "file_path", "error")
        if self.rejects.manifest() is not None or not errors.isEmpty():
            self.rejects.replace_files(gone, errors)
        version = self.chunks.replace_files(gone, good)
        here = lambda t: 0 if t.read() is None else t.read().join(gone, ["project_id", "file_path"], "left_semi").count()
        return {"version": version, "stored": here(self.chunks), "rejected": here(self.rejects), "errors": self.rejects.read()}

    def _save_state(self, rows: DataFrame, project: str) -> None:
        """Keep the digests of a project's files; only those that differ are written."""
        state = rows.select(F.concat_ws("|", F.lit(project), "path").alias("state_id"), F.lit(project).alias("project_id"), F.col("path").alias("file_path"), "file_hash")
        old = self.states.read()
        if old is None:
            self.states.write(state)
            return
        mine = old.where(F.col("project_id") == project)
        self.states.change((mine.join(state, "state_id", "left_anti"), ["state_id"]), state.join(mine.select("state_id", "file_hash"), ["state_id", "file_hash"], "left_anti"))

    def process_update(self, root: str, project: str) -> dict[str, int]:
        """Bring the store up to date with the files as they are; changes by type."""
        rows = files.repository(self.spark, root, project)
        now = rows.select(F.col("path").alias("file_path"), "file_hash")
        old = self.states.read()
        old = now.limit(0) if old is None else old.where(F.col("project_id") == project).select("file_path", "file_hash")
        found = changes.with_renames(changes.snapshot_diff(old, now))
        by_type = {r["change_type"]: r["n"] for r in changes.histogram(found).collect()}
        if by_type:
            gone, todo = changes.work_sets(found)
            touched = gone.union(todo).distinct().withColumnRenamed("file_path", "path")
            self._replace(rows.join(todo.withColumnRenamed("file_path", "path"), "path", "left_semi"), project, touched)
            self._save_state(now.withColumnRenamed("file_path", "path"), project)
        return by_type

    # search

    def _vector(self, text: str) -> DataFrame:
        return self.spark.createDataFrame([(text,)], "t string").select(self.embed(F.col("t")).alias("q"))

    #: Columns that a search may leave out.
    PROJECTION = {"content": "with_content", "embedding": "with_vector", "metadata": "with_metadata"}

    def _payload(self, found: DataFrame, with_content: bool = True, with_vector: bool = False, with_metadata: bool = True) -> DataFrame:
        """The chunks of a result (id, score), best first, with or without their texts, vectors and metadata."""
        let = {"with_content": with_content, "with_vector": with_vector, "with_metadata": with_metadata}
        rows = self.chunks.read()
        rows = rows.drop(*[c for c, flag in self.PROJECTION.items() if not let[flag]])
        return rows.join(F.broadcast(found.withColumnRenamed("id", "chunk_id")), "chunk_id").orderBy(F.desc("score"), "chunk_id")

    def _where(self, project: str | None, filters: dict | None):
        every = {**(filters or {}), **({"project_id": project} if project else {})}
        return matching(every) if every else None

    def semantic_search(self, query: str, k: int = 10, least: float = 0.0, project: str | None = None, filters: dict | None = None, exact: bool = False, **flags: bool) -> list:
        """The k nearest chunks: id and score, or with any projection flag (with_content, with_vector, with_metadata) the chunks."""
        key = ("semantic", query, k, least, project, tuple(sorted((filters or {}).items())), exact, tuple(sorted(flags.items())), self.chunks.version())

        def make() -> list:
            found = self.vector_index().search(self._query_vector(query), k, least, self._where(project, filters), exact=exact)
            return (self._payload(found, **flags) if flags else found).collect()

        return self.cache.get(key, make)

    def _query_vector(self, text: str) -> list[float]:
        return list(self._vector(text).first()["q"])

    def hybrid_search(self, query: str, k: int = 10, mode: str = "hybrid", alpha: float = 0.5, project: str | None = None, filters: dict | None = None, exact: bool = True, **flags: bool) -> DataFrame:
        """Fused search over the stored indexes, with the chunks' columns; filters hold for both sides."""
        where = self._where(project, filters)
        if mode == "keyword":
            allowed = None if where is None else self.chunks.read().where(where).select("chunk_id")
            return self._payload(self.keyword_index().search(query, k, allowed), **flags)
        return self._payload(fusion.stored_hybrid(self.keyword_index(), self.vector_index(), query, self._query_vector(query), k, mode, alpha, where=where, exact=exact), **flags)

    def keyword_index(self) -> KeywordIndex:
        """The keyword index of the present version, built if it isn't there; indexes of other versions go."""
        index = KeywordIndex(self.spark, f"{self.chunks.path}-keywords", self.chunks.version())
        if not index.ready():
            index.build(bm25.tokenized(self.chunks.read(), "chunk_id", "content"))
            index.drop_others()
        return index

    def vector_index(self) -> VectorIndex:
        """The vector index of the present version: changed chunks are inserted into the cells of the last one, which is made anew when a version before it is missing."""
        folder = Folder(self.spark, f"{self.path}/vectors")
        index, now = VectorIndex(self.spark, folder.path, "chunk_id"), self.chunks.version()
        rows = self.chunks.read().drop("content", "metadata")
        if not index.ready():
            index.build(rows)
        elif not folder.exists(f"indexed-{now}"):
            digest = F.xxhash64("embedding", "file_path", "file_hash", "start_line").alias("digest_")
            held = index.read().select("chunk_id", digest)
            new = rows.select("*", digest).join(held, ["chunk_id", "digest_"], "left_anti")
            gone = held.join(rows, "chunk_id", "left_anti").select("chunk_id")
            if not gone.isEmpty():
                index.delete(gone)
            if not new.isEmpty():
                index.insert(new)
        folder.create(f"indexed-{now}", "")
        return index

    def status(self) -> DataFrame:
        """Chunks, files and different contents of each project."""
        rows = self.chunks.read()
        return history.state_summary(rows.select("project_id", "file_path", F.sha2("content", 256).alias("digest")), "digest")

    def system_status(self) -> dict:
        """Version, chunks, projects, vector cells and probes, and statistics of the cache and the embedding memo."""
        rows = self.chunks.read()
        index = VectorIndex(self.spark, f"{self.path}/vectors", "chunk_id")
        uses = self.memo.uses.read()
        facts = {"version": self.chunks.version(), "chunks": sum((self.chunks.manifest() or {"rows": {}})["rows"].values()), "projects": 0 if rows is None else rows.select("project_id").distinct().count(), "rejects": sum((self.rejects.manifest() or {"rows": {}})["rows"].values()), "cache": self.cache.stats()}
        facts["vectors"] = {"cells": len(index.meta["centroids"]), "probes": index.meta["probes"], "batches": len(index.batches())} if index.ready() else None
        facts["memo"] = None if uses is None else uses.agg(F.count(F.lit(1)).alias("uses"), F.sum("asked").alias("asked"), F.sum("hits").alias("hits"), F.sum("evicted").alias("evicted")).first().asDict()
        return facts

    def store_statistics(self, most: int = 1000) -> dict[str, DataFrame]:
        """Languages, layers and sensitivities with bounds, from a sample of each project, and about how many files and contents."""
        rows = self.chunks.read()
        found = {c: sketches.sampled_counts(rows, "project_id", c, "chunk_id", most) for c in ("language", "layer_type", "sensitivity_level") if c in rows.columns}
        counted = sketches.distinct_sketches(rows.withColumn("contents", F.sha2("content", 256)), ["project_id"], ["file_path", "contents"])
        return found | {"distinct": sketches.distinct_counts(counted, ["project_id"], ["file_path", "contents"])}

    def errors(self, **filters) -> DataFrame:
        """Report on rejected chunks: their errors by kind; an empty store has none."""
        held = self.rejects.read()
        rows = self.spark.createDataFrame([], "error string, project_id string") if held is None else held
        return rows.where(matching(filters)).groupBy("project_id", "error").agg(F.count(F.lit(1)).alias("n"))

    def export(self, rows: DataFrame, path: str, *columns: str) -> None:
        """Write rows as JSON lines, as logs and metrics are exported."""
        history.json_lines(rows, *(columns or rows.columns)).write.mode("overwrite").text(path)

    def similar_code(self, snippet: str, k: int = 10, least: float = 0.7, without_file: str | None = None, project: str | None = None, exact: bool = True, **flags: bool) -> DataFrame:
        """Chunks like a snippet, without those of its own file: id and score, or with projection flags the chunks."""
        where = self._where(project, None)
        if without_file is not None:
            other = F.col("file_path") != without_file
            where = other if where is None else where & other
        found = self.vector_index().search(self._query_vector(snippet), k, least, where, exact=exact)
        return self._payload(found, **flags) if flags else found

    def metadata_search(self, filters: dict, limit: int = 100) -> DataFrame:
        """Chunks with the given values."""
        return metadata_search(self.chunks.read(), filters, limit)

    # administration

    def delete_chunks(self, filters: dict | None = None, paths: list[str] | None = None, confirm: bool = False) -> str:
        """Delete by values or files."""
        if not confirm:
            raise ValueError("deleting needs confirm=True")
        if paths:
            return self.chunks.delete_files(self.spark.createDataFrame([(p,) for p in paths], "file_path string"))
        return self.chunks.delete_where(filters or {})

    def reset(self, confirm: bool = False) -> None:
        """Empty the store."""
        if not confirm:
            raise ValueError("resetting needs confirm=True")
        for table in (self.chunks, self.projects, self.states, self.rejects):
            if table.read() is not None:
                table.reset()

    def project_stats(self) -> DataFrame:
        """Numbers of every project."""
        return stats.project_stats(self.chunks.read())

    def security_report(self) -> DataFrame:
        """Report over all stored chunks."""
        return security.report(self.chunks.read())

    def commits(self, repo: str, since: str | None = None) -> DataFrame:
        """Commits of a repository, oldest first."""
        git.register(self.spark)
        reader = self.spark.read.format("git_commits").option("path", repo)
        return (reader.option("since", since) if since else reader).load().orderBy("n")
