"""Source files as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.layers import IGNORED_FOLDERS, IGNORED_SUFFIXES, ignored, language_of
from ..operators.store import Store
from .git import contents, register
from .shared import Folder

#: Suffixes that are read by default.
SUFFIXES = (".java", ".kt", ".html", ".htm", ".xml", ".yaml", ".yml", ".properties", ".py", ".pyw")

#: Columns of listed files.
LISTED = "path string, modificationTime timestamp, length bigint, text string, file_hash string, total_lines bigint, project_id string, language string"


def _named(rows: DataFrame, root: str | None, project: str | None) -> DataFrame:
    path = F.regexp_replace("path", "^[a-z0-9]+:/*", "/")
    if root:
        path = F.regexp_replace(path, "^" + "".join(c if c.isalnum() or c in "/_-" else "\\" + c for c in root.rstrip("/")) + "/", "")
    text = F.decode("content", "UTF-8")
    lines = F.size(F.split(text, "\n")) - F.when(text.endswith("\n"), 1).otherwise(0)
    return rows.select(path.alias("path"), "modificationTime", "length", text.alias("text"), F.sha2("content", 256).alias("file_hash"), lines.cast("long").alias("total_lines"), F.lit(project).alias("project_id")).withColumn("language", language_of(F.col("path")))


def repository(spark: SparkSession, root: str, project: str | None = None, suffixes: tuple[str, ...] = SUFFIXES, folders: tuple[str, ...] = IGNORED_FOLDERS, recursive: bool = True) -> DataFrame:
    """path (relative), modificationTime, length, text, file_hash, total_lines, project_id, language of the source files under ``root``.

    Suffixes are pushed into the listing, so other files are never opened. A
    folder that isn't there has no files.
    """
    where = spark._jvm.org.apache.hadoop.fs.Path(root)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], LISTED)
    globs = "*{" + ",".join(suffixes) + "}"
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", globs).load(root)
    return _named(rows, root, project).where(~ignored(F.col("path"), folders, IGNORED_SUFFIXES))


def listed(spark: SparkSession, paths: list[str], root: str | None = None, project: str | None = None) -> DataFrame:
    """The given files; missing ones are left out."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    there = [p for p in paths if (h := jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(conf).exists(h)]
    if not there:
        return spark.createDataFrame([], LISTED)
    return _named(spark.read.format("binaryFile").load(there), root, project)


def committed(repo: str, changed: DataFrame, project: str | None = None) -> DataFrame:
    """Changed files (file_path, blob, committed_at) as they were at their commit."""
    return _named(contents(repo, changed), None, project)


def blob_hash(content: Column) -> Column:
    """The name that git gives a file with this content."""
    return F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(content).cast("string")), "UTF-8"), F.unhex(F.lit("00")), content))


def tracked(spark: SparkSession, repo: str) -> DataFrame:
    """file_path, head_hash (of the last commit) and file_hash of git's tracked files as they lie in the working tree; null where one is missing."""
    register(spark)
    head = spark.read.format("git_files").option("path", repo).load().withColumnRenamed("file_hash", "head_hash")
    here = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(repo)
    own = here.select(F.regexp_replace("path", "^[a-z0-9]+:/*" + "".join(c if c.isalnum() or c in "/_-" else "\\" + c for c in repo.strip("/")) + "/", "").alias("file_path"), blob_hash(F.col("content")).alias("file_hash"))
    return head.join(own.where(~F.col("file_path").startswith(".git/")), "file_path", "left")


def import_states(spark: SparkSession, path: str, store: Store) -> int:
    """Bring JSON state files of a folder into a store (key state_id) and rename them with .backup; the number of states. A file that fails stays as it is."""
    folder, total = Folder(spark, path), 0
    for name in [n for n in folder.names("*.json")]:
        rows = legacy_states(spark, f"{path}/{name}").withColumn("state_id", F.concat_ws("|", "project_id", "file_path"))
        total += rows.count()
        store.upsert(rows)
        folder.rename(name, f"{name}.backup")
    return total


def legacy_states(spark: SparkSession, path: str) -> DataFrame:
    """project_id, file_path, file_hash from JSON state files, one object each with a map of hashes."""
    raw = spark.read.schema("project_id string, last_commit_hash string, file_hashes map<string,string>").json(path, multiLine=True)
    return raw.select(F.coalesce("project_id", F.lit("default")).alias("project_id"), F.explode("file_hashes").alias("file_path", "file_hash"))
