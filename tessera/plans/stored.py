"""Indexes and tables that queries keep: one for each session and set of tables, made at first use."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

from ..operators import bm25
from ..operators.keyword_index import KeywordIndex
from ..operators.vector_index import VectorIndex
from ..sources.shared import Folder, spread

#: By session and tables: the index and the folder it lies in.
_made: dict[tuple, object] = {}
_folders: dict[str, list[str]] = {}


def folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share; :func:`clean` removes it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        path = f"{base.rstrip('/')}/tessera/query-{uuid.uuid4().hex}"
    elif re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        path = tempfile.mkdtemp(prefix="tessera-query-")
        atexit.register(shutil.rmtree, path, True)
    else:
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    _folders.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def clean(spark: SparkSession) -> None:
    """Remove all that this session's queries keep."""
    application = spark.sparkContext.applicationId
    for path in _folders.pop(application, []):
        Folder(spark, path).delete("")
    for key in [k for k in _made if k[0] == application]:
        del _made[key]


def once(spark: SparkSession, name: str, d: str, make):
    """What ``make`` gives, made once for a session and its tables."""
    key = spark.sparkContext.applicationId, name, d
    if key not in _made:
        _made[key] = make()
    return _made[key]


def keyword_index(spark: SparkSession, d: str) -> KeywordIndex:
    """The keyword index of ``documents``."""

    def make() -> KeywordIndex:
        index = KeywordIndex(spark, folder(spark), "documents")
        index.build(bm25.tokenized(spread(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), "doc_id")))
        return index

    return once(spark, "keywords", d, make)


def vector_index(spark: SparkSession, d: str) -> VectorIndex:
    """The vector index of ``embeddings``."""

    def make() -> VectorIndex:
        index = VectorIndex(spark, folder(spark))
        index.build(spark.read.parquet(f"{d}/embeddings.parquet"))
        return index

    return once(spark, "vectors", d, make)
