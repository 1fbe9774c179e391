"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows and bytes that one Arrow batch may hold; long texts make batches short.
BATCH_ROWS, BATCH_BYTES = 2048, 4 << 20


def tune(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers receive, by rows and by bytes (settings of the session: Spark reads them when a plan runs)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


#: Folders made for sessions of one machine that name none, by application.
_own: dict[str, str] = {}
#: Tables written so far and not yet released: path to session.
_kept: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` names it. Where the setting is missing, a folder
    of this machine serves a session whose executors are threads of the driver;
    any other session is refused, since its executors couldn't read it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if context.applicationId not in _own:
            _own[context.applicationId] = tempfile.mkdtemp(prefix="tessera-checkpoint-")
            atexit.register(shutil.rmtree, _own[context.applicationId], True)
        folder = _own[context.applicationId]
    return folder.rstrip("/")


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage: a later stage, or a task that is run again after an
    executor was lost, reads files instead of computing everything once more.
    :func:`release` removes tables that nothing reads any more, :func:`clean`
    all of a session's.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _kept[path] = spark
    back = spark.read.schema(df.schema).parquet(path)
    back.kept_path = path
    return back


def keep_folder(spark: SparkSession, path: str) -> str:
    """Note a folder in the shared one that :func:`clean` is to remove."""
    _kept[path] = spark
    return path


def release(*tables: DataFrame) -> None:
    """Remove tables of :func:`keep` that no later plan reads."""
    for df in tables:
        _remove(getattr(df, "kept_path", None))


def clean(spark: SparkSession) -> None:
    """Remove all tables that this session keeps; for when its results are saved."""
    for path in [p for p, s in _kept.items() if s is spark]:
        _remove(path)


def _remove(path: str | None) -> None:
    spark = _kept.pop(path, None)
    if spark is not None:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def map_batches(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | Iterable[pa.RecordBatch] | None], schema: str | StructType) -> DataFrame:
    """Apply ``work`` to every Arrow batch; one input batch is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            out = work(batch)
            if isinstance(out, pa.RecordBatch):
                yield out
            elif out is not None:
                yield from out
            del out, batch
        pa.default_memory_pool().release_unused()  # the worker lives on and runs other tasks

    return df.mapInArrow(run, schema)


def batch_of(schema: pa.Schema, columns: Iterable) -> pa.RecordBatch:
    """A record batch from Python lists or numpy arrays, cast to ``schema``."""
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, type=f.type) for x, f in zip(columns, schema)], schema=schema)


def fresh(name: str, taken: Iterable[str]) -> str:
    """``name``, with underscores appended until no column (in any case) has it."""
    used = {x.lower() for x in taken}
    while name.lower() in used:
        name += "_"
    return name


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id written as text, modulo ``folds``; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(folds)


#: The six ASCII white-space characters; words are the runs between them.
WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
WORD = re.compile(rb"[^\x20\x09-\x0d]+")
