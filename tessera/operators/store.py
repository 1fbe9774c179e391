"""Versioned chunk store on plain Parquet: upsert, deletes, reads.

Rows lie in buckets by the hash of a column, each bucket a folder. A version is
a small file whose name is its number alone and which lists the folder of every
bucket, the schema and the rows. A change reads and writes the buckets that it
touches and lists the others as they are; a store that outgrows its buckets
gets more of them. Version n + 1 is made by creating a file that must not exist,
so of writers that begin from the same version exactly one wins, in whatever
order they end, and the others get an error and leave nothing. Readers see the
old or the new version at any moment. Versions and folders that nothing refers
to go after a time of grace.

Everything goes through Hadoop's file system, so any shared store will do.
"""

from __future__ import annotations

import json
import time
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.shared import Folder

#: Buckets of a new store, rows of a bucket beyond which a store gets more, seconds that old versions stay.
BUCKETS, BUCKET_ROWS, GRACE = 8, 400_000, 24 * 3600


def chunk_id(project: Column, path: Column, start: Column, name: Column) -> Column:
    """A deterministic id, so that ingesting again replaces."""
    return F.sha2(F.concat_ws("|", F.coalesce(project, F.lit("default")), path, start.cast("string"), F.coalesce(name, F.lit(""))), 256)


def stored_rows(chunks: DataFrame, vector: str = "embedding", dims: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows to store, rejects): a row needs a vector (of ``dims`` components); null texts become empty, null projects default."""
    good = F.col(vector).isNotNull() & (F.size(vector) > 0) & (F.lit(True) if dims is None else F.size(vector) == dims)
    good = F.coalesce(good, F.lit(False))
    filled = {f.name: F.coalesce(F.col(f.name), F.lit("default" if f.name in ("project_id", "project_name") else "")) for f in chunks.schema if f.dataType.simpleString() == "string"}
    return chunks.where(good).withColumns(filled), chunks.where(~good).withColumn("error", F.lit("missing or unfit vector"))


def upserted(old: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with the same key; of rows of ``new`` that share a key one stays."""
    new = new.dropDuplicates([key])
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def without(old: DataFrame, gone: DataFrame, key: str = "chunk_id") -> DataFrame:
    """``old`` without the keys of ``gone``."""
    return old.join(gone.select(key).distinct(), key, "left_anti")


def matching(filters: dict) -> Column:
    """Equality with all given values; null matches null."""
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.lit(v)) for k, v in filters.items()], F.lit(True))


def metadata_search(rows: DataFrame, filters: dict, limit: int = 100, key: str = "chunk_id") -> DataFrame:
    """Rows that match, each with score 1, by key."""
    return rows.where(matching(filters)).orderBy(key).limit(min(limit, 100)).withColumn("score", F.lit(1.0))


class Conflict(RuntimeError):
    """Another writer has published the version that this one was to make."""


class Store:
    """A keyed table at a path, in buckets by the column ``by`` (the key, if not given)."""

    def __init__(self, spark: SparkSession, path: str, key: str = "chunk_id", by: str | None = None, buckets: int = BUCKETS, bucket_rows: int = BUCKET_ROWS, grace: float = GRACE):
        self.spark, self.path, self.key, self.by = spark, path.rstrip("/"), key, by or key
        self.buckets, self.bucket_rows, self.grace = buckets, bucket_rows, grace
        self.folder = Folder(spark, self.path)
        #: Rows written by the last change, for reports and tests.
        self.written = 0

    # versions

    def manifest(self) -> dict | None:
        """The present version: number, by, buckets, folders and rows by bucket, schema."""
        for name in reversed(self.folder.names("version-*")):
            try:
                return json.loads(self.folder.read(name)) | {"number": int(name[8:])}
            except ValueError:  # its writer hasn't ended
                continue
        return None

    def version(self) -> str | None:
        """Name of the present version."""
        found = self.manifest()
        return f"v{found['number']}" if found else None

    def _publish(self, base: dict | None, buckets: int, folders: dict[str, str], rows: dict[str, int], schema: StructType, made: str) -> str:
        """Make the version after ``base``, or remove what was ``made`` for it."""
        number = base["number"] + 1 if base else 1
        facts = {"by": self.by, "buckets": buckets, "folders": folders, "rows": rows, "schema": json.loads(schema.json())}
        if not self.folder.create(f"version-{number:012d}", json.dumps(facts)):
            self.folder.delete(made)
            raise Conflict(f"another writer has published version {number} of {self.path}")
        self.vacuum()
        return f"v{number}"

    def vacuum(self) -> None:
        """Remove versions but the present one, and folders that none of the rest lists, once they are older than the grace."""
        now, names = time.time(), self.folder.names("version-*")
        old = [n for n in names[:-1] if self.folder.age(n, now) > self.grace]
        for name in old:
            self.folder.delete(name)
        used = set()
        for name in [n for n in names if n not in old]:
            try:
                used |= set(json.loads(self.folder.read(name))["folders"].values())
            except ValueError:
                return
        for name in self.folder.names("rows-*"):
            if name not in used and self.folder.age(name, now) > self.grace:
                self.folder.delete(name)

    # reads

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(self.by), F.lit(buckets)).cast("int")

    def _read(self, found: dict, buckets: set[str] | None = None) -> DataFrame:
        schema = StructType.fromJson(found["schema"])
        paths = [f"{self.path}/{f}/bucket_={b}" for b, f in sorted(found["folders"].items()) if buckets is None or b in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame | None:
        """The present rows, or None before the first write."""
        found = self.manifest()
        return None if found is None else self._read(found)

    def get(self, key: str) -> DataFrame:
        """The row with a key."""
        found, only = self.manifest(), None
        if self.by == self.key and isinstance(key, str):
            import xxhash

            only = {str(((xxhash.xxh64_intdigest(key, seed=42) ^ 1 << 63) - (1 << 63)) % found["buckets"])}
        return self._read(found, only).where(F.col(self.key) == key).limit(1)

    # writes

    def _save(self, rows: DataFrame, buckets: int, name: str) -> dict[str, int]:
        """Write rows into bucket folders; rows by bucket."""
        rows.withColumn("bucket_", self._bucket(buckets)).repartition("bucket_").write.partitionBy("bucket_").parquet(f"{self.path}/{name}")
        if not self.folder.names(f"{name}/bucket_=*"):
            return {}
        held = self.spark.read.parquet(f"{self.path}/{name}").groupBy("bucket_").agg(F.count(F.lit(1)).alias("n")).collect()
        return {str(r["bucket_"]): r["n"] for r in held}

    def write(self, rows: DataFrame) -> str:
        """Make ``rows`` the present version."""
        base, name = self.manifest(), f"rows-{uuid.uuid4().hex}"
        buckets = base["buckets"] if base else self.buckets
        held = self._save(rows, buckets, name)
        self.written = sum(held.values())
        return self._grown(base, buckets, dict.fromkeys(held, name), held, rows.schema, name)

    def _grown(self, base: dict | None, buckets: int, folders: dict[str, str], rows: dict[str, int], schema: StructType, made: str) -> str:
        """Publish, in more buckets if these have become too large (which writes all rows, once they have doubled)."""
        total = sum(rows.values())
        if total > buckets * self.bucket_rows:
            while total > buckets * self.bucket_rows // 2:
                buckets *= 2
            again = f"rows-{uuid.uuid4().hex}"
            rows = self._save(self._read({"folders": folders, "schema": json.loads(schema.json())}), buckets, again)
            self.folder.delete(made)
            folders, made, self.written = dict.fromkeys(rows, again), again, self.written + total
        return self._publish(base, buckets, folders, rows, schema, made)

    def change(self, dropped: Column | tuple[DataFrame, list[str]] | None = None, new: DataFrame | None = None) -> str:
        """One version without the rows that ``dropped`` picks (a condition, or a frame and the columns that it shares), and with ``new``, whose keys replace the same ones.

        Only buckets with dropped, replaced or new rows are read and written.
        """
        base = self.manifest()
        if base is None:
            return self.write(new.dropDuplicates([self.key]))
        held, buckets = self._read(base), base["buckets"]
        bucket, staged, touched = self._bucket(buckets), None, set()
        name, stage = f"rows-{uuid.uuid4().hex}", f"rows-{uuid.uuid4().hex}"
        if new is not None:
            touched |= set(self._save(new.dropDuplicates([self.key]), buckets, stage))
            staged = self.spark.read.schema(new.schema).parquet(*[f"{self.path}/{stage}/bucket_={b}" for b in touched]) if touched else new.limit(0)
        gone = [] if dropped is None else [held.where(dropped) if isinstance(dropped, Column) else held.join(dropped[0].select(*dropped[1]).distinct(), dropped[1], "left_semi")]
        if staged is not None and touched and self.by != self.key:
            gone.append(held.join(staged.select(self.key), self.key, "left_semi"))
        for rows in gone:
            touched |= {str(r[0]) for r in rows.select(bucket.alias("b")).distinct().collect()}
        if not touched:
            self.folder.delete(stage)
            return f"v{base['number']}"
        out = self._read(base, touched)
        if dropped is not None:
            out = out.where(~F.coalesce(dropped, F.lit(False))) if isinstance(dropped, Column) else out.join(dropped[0].select(*dropped[1]), dropped[1], "left_anti")
        if staged is not None:
            out = out.join(staged.select(self.key), self.key, "left_anti").unionByName(staged, allowMissingColumns=True)
        rows = self._save(out, buckets, name)
        self.written = sum(rows.values())
        self.folder.delete(stage)
        folders = {b: f for b, f in base["folders"].items() if b not in touched} | dict.fromkeys(rows, name)
        return self._grown(base, buckets, folders, {b: n for b, n in base["rows"].items() if b not in touched} | rows, out.schema, name)

    def upsert(self, rows: DataFrame) -> str:
        """Add rows, replacing those with the same key."""
        return self.change(new=rows)

    def delete_ids(self, ids: DataFrame) -> str:
        """Drop the keys of ``ids``."""
        return self.change((ids, [self.key]))

    def delete_where(self, filters: dict) -> str:
        """Drop all matching rows, however many."""
        return self.change(matching(filters))

    def delete_files(self, files: DataFrame) -> str:
        """Drop the chunks of the files in ``files`` (file_path)."""
        return self.replace_files(files, None)

    def replace_files(self, files: DataFrame, new: DataFrame | None) -> str:
        """Put ``new`` in place of the chunks of ``files`` (file_path, and project_id if it has one)."""
        return self.change((files, [c for c in ("project_id", "file_path") if c in files.columns]), new)

    def reset(self) -> str:
        """An empty version with the same columns."""
        base = self.manifest()
        return self._publish(base, self.buckets, {}, {}, StructType.fromJson(base["schema"]), "rows-none")

    def retained(self, column: str, since: Column) -> str:
        """Drop rows older than ``since``."""
        return self.change(~F.coalesce(F.col(column) >= since, F.lit(False)))


class Projects(Store):
    """The project table, with creation, partial update and checks."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path, "project_id")

    def exists(self, project_id: str) -> bool:
        rows = self.read()
        return rows is not None and not rows.where(F.col("project_id") == project_id).isEmpty()

    def create(self, row: DataFrame) -> str:
        """Add a project; a known id is an error."""
        for r in row.select("project_id").collect():
            if self.exists(r[0]):
                raise ValueError(f"project {r[0]} exists")
        return self.upsert(row)

    def update(self, project_id: str, **changes) -> str:
        """Change some columns of a project."""
        rows = self.read()
        return self.upsert(rows.where(F.col("project_id") == project_id).withColumns({k: F.lit(v).cast(rows.schema[k].dataType) for k, v in changes.items()}))

    def list(self, status: str | None = None) -> DataFrame:
        """Projects, newest first."""
        rows = self.read()
        return (rows if status is None else rows.where(F.col("status") == status)).orderBy(F.desc("created_at"), "project_id")
