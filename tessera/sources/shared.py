"""Small files in a shared folder, by Hadoop's file system: pointers, facts and folders of tables."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Folder:
    """A folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _of(self, name: str):
        return self._path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._of(name))

    def names(self, glob: str = "*") -> list[str]:
        """Names of the entries that match."""
        return sorted(f.getPath().getName() for f in self.fs.globStatus(self._of(glob)) or [])

    def age(self, name: str, now: float) -> float:
        """Seconds since an entry was written."""
        return now - self.fs.getFileStatus(self._of(name)).getModificationTime() / 1000

    def read(self, name: str) -> str:
        """A file's text."""
        stream = self.fs.open(self._of(name))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Write a new file, and say whether it is ours: of writers that meet, one gets True."""
        self.fs.mkdirs(self._of(""))
        if self.fs.getScheme() == "file":  # Hadoop's local file system looks first and creates then
            try:
                handle = os.open(re.sub("^file:/+", "/", self._of(name).toString()), os.O_CREAT | os.O_EXCL | os.O_WRONLY, 0o644)
            except FileExistsError:
                return False
            with os.fdopen(handle, "w", encoding="utf-8") as f:
                f.write(text)
            return True
        try:
            stream = self.fs.create(self._of(name), False)
        except Exception:  # noqa: BLE001 - the class of the error depends on the file system
            if self.exists(name):
                return False
            raise
        stream.write(bytearray(text.encode()))
        stream.close()
        return True

    def rename(self, name: str, to: str) -> None:
        """Rename an entry."""
        if not self.fs.rename(self._of(name), self._of(to)):
            raise OSError(f"{name} can't be renamed to {to}")

    def delete(self, name: str) -> None:
        """Remove a file or a folder."""
        self.fs.delete(self._of(name), True)


def read_parts(spark: SparkSession, root: str, parts: list[str], schema) -> DataFrame:
    """Some partition folders of a Parquet table, without listing the others or reading a footer for the schema."""
    if not parts:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", root).parquet(*[f"{root}/{p}" for p in parts])


def spread(rows: DataFrame, *by) -> DataFrame:
    """A small scan's rows dealt to all cores, so that one file isn't one task; large scans have tasks enough and stay as they are."""
    spark = rows.sparkSession
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores, *by) if size < cores << 27 else rows


def spread_few(rows: DataFrame, *by) -> DataFrame:
    """As :func:`spread`, but a scan whose rows lie in a task for each core already isn't shuffled; finding that out reads footers only."""
    filled = rows.select(F.spark_partition_id()).distinct().count()
    return rows if filled >= rows.sparkSession.sparkContext.defaultParallelism else spread(rows, *by)
