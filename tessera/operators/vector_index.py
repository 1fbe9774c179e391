"""A stored vector index: coarse cells as folders, pruned reads, exact ranking, inserts into cells.

The centroids come from a bounded sample. A vector lies in the cell of its
nearest centroid, and cells are the partition folders of a batch of rows. A
search reads the cells nearest to the query and ranks their vectors by their
exact cosine. How many it reads is calibrated when the index is built, on
vectors of the sample, for a recall of RECALL. The exact way first scores the
nearest cells; then it reads every cell that, by its centroid and the largest
angle from it, can still hold a vector as near as the k-th found.

An insert writes a new batch of the given rows and nothing else; ids that were
there before are noted as gone from the older batches, as are deleted ones. Readers
see a batch whole or not at all: its number is a small file, written last, and
of writers that meet one gets an error. :meth:`VectorIndex.compact` makes one
batch of all.

Zero, null and non-finite vectors, null ids, and vectors of another length than
the first ones take no part. Of repeated ids within a batch one row stays.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ..sources.shared import Folder, read_parts
from .vectors import MOST_RESULTS, block_pairs, cosine, dot

#: Rows that centroids are fitted and probes calibrated on; cells at most; vectors of the sample that are searched to calibrate.
SAMPLE, MOST_CELLS, TRIALS = 20_000, 4096, 64
#: Aim of the calibration, and its share of nearest vectors (k).
RECALL, TRIAL_K = 0.97, 10
#: Cells that the exact way reads for its first threshold, and rows up to which it reads all at once.
FIRST, DIRECT = 4, 1 << 16
#: Share of all pairs that may meet by bands.
DENSE = 1 / 32


def fit_centroids(unit: np.ndarray, cells: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means of a sample; an empty cell takes the vector farthest from its centroid."""
    centres = unit[np.random.default_rng(0).choice(len(unit), cells, replace=False)].copy()
    for _ in range(rounds):
        near = unit @ centres.T
        own = near.argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, unit)
        empty = np.bincount(own, minlength=cells) == 0
        if empty.any():
            sums[empty] = unit[np.argsort(near.max(axis=1))[: empty.sum()]]
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres


def calibrated_probes(unit: np.ndarray, centres: np.ndarray, aim: float = RECALL, k: int = TRIAL_K) -> int:
    """Cells to read so that the sample's own vectors find ``aim`` of their k nearest ones in the mean."""
    asked = unit[:: max(1, len(unit) // TRIALS)][:TRIALS]
    own = (unit @ centres.T).argmax(axis=1)
    near = np.argsort(-(asked @ unit.T), axis=1, kind="stable")[:, 1 : k + 1]
    place = np.argsort(np.argsort(-(asked @ centres.T), axis=1, kind="stable"), axis=1)  # of each cell in each query's order
    needed = np.sort(np.take_along_axis(place, own[near], axis=1).ravel())
    return int(needed[min(len(needed) - 1, math.ceil(aim * len(needed)))]) + 1 if len(needed) else len(centres)


class VectorIndex:
    """An index of rows with an id and a vector, below ``path``; other columns are kept for filters."""

    def __init__(self, spark: SparkSession, path: str, id_column: str = "vec_id", vector: str = "embedding"):
        self.spark, self.path, self.id, self.vector = spark, path.rstrip("/"), id_column, vector
        self.folder = Folder(spark, self.path)
        self._meta: dict | None = None

    def ready(self) -> bool:
        return self.folder.exists("index.json")

    @property
    def meta(self) -> dict:
        """centroids, probes, schema of the rows."""
        if self._meta is None:
            self._meta = json.loads(self.folder.read("index.json"))
            self._meta["centroids"] = np.array(self._meta["centroids"])
            self._meta["schema"] = StructType.fromJson(self._meta["schema"])
        return self._meta

    def _sound(self, rows: DataFrame, dims: int | None = None) -> DataFrame:
        v = F.col(self.vector)
        good = v.isNotNull() & F.col(self.id).isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & (dot(v, v) > 0)
        return rows.where(good if dims is None else good & (F.size(v) == dims))

    def build(self, rows: DataFrame, cells: int | None = None) -> None:
        """Fit the cells and write the first batch, unless the index is there."""
        if self.ready():
            return
        sound = self._sound(rows)
        n = sound.count()
        share = min(1.0, SAMPLE / max(1, n))
        chosen = sound if share == 1 else sound.where(F.pmod(F.xxhash64(self.id), F.lit(1 << 20)) < share * (1 << 20))
        taken = [r[0] for r in chosen.select(F.col(self.vector).cast("array<double>")).limit(2 * SAMPLE).collect()]
        dims = len(taken[0]) if taken else 0
        sample = np.array([x for x in taken if len(x) == dims]).reshape(-1, dims)
        unit = sample / np.linalg.norm(sample, axis=1, keepdims=True) if dims else np.zeros((0, 0))
        cells = max(1, min(MOST_CELLS, cells or int(math.sqrt(n)), len(unit) or 1))
        centres = fit_centroids(unit, cells) if len(unit) else np.zeros((1, dims))
        self._meta = {"centroids": centres, "probes": calibrated_probes(unit, centres), "schema": rows.schema, "dims": dims}
        self._write(1, sound, None)
        if not self.folder.create("index.json", json.dumps({"centroids": centres.tolist(), "probes": self._meta["probes"], "schema": json.loads(rows.schema.json()), "dims": dims})):
            raise RuntimeError(f"another writer has built {self.path}")

    def batches(self) -> list[dict]:
        """Folder, cells with rows and angle, and whether older rows went, of every batch, oldest first."""
        return [json.loads(text) | {"number": int(n[6:])} for n in self.folder.names("batch-*") if (text := self.folder.read(n))]

    def _write(self, number: int, rows: DataFrame, gone: DataFrame | None) -> None:
        """Write one batch: rows into cells, ids gone from older ones."""
        centres, name = self.meta["centroids"], f"rows-{uuid.uuid4().hex}"
        sound = self._sound(rows, self.meta["dims"]).dropDuplicates([self.id])
        schema = rows.schema

        def cells_of(batches):
            import pyarrow as pa

            at = schema.names.index(self_vector)
            for batch in batches:
                if not batch.num_rows:
                    continue
                v = np.array(batch.column(at).to_pylist(), dtype=np.float64)
                v /= np.linalg.norm(v, axis=1, keepdims=True)
                near = v @ centres.T
                own = near.argmax(axis=1)
                angle = np.arccos(np.clip(near[np.arange(len(v)), own], -1, 1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(angle), pa.array(own.astype(np.int32))], names=[*schema.names, "angle_", "cell"])

        self_vector = self.vector
        placed = sound.mapInArrow(cells_of, StructType([*schema.fields, StructField("angle_", DoubleType()), StructField("cell", IntegerType())]))
        placed.repartition("cell").write.partitionBy("cell").parquet(f"{self.path}/{name}")
        cells = self.spark.read.parquet(f"{self.path}/{name}").groupBy("cell").agg(F.max("angle_").alias("angle"), F.count(F.lit(1)).alias("rows")).collect() if self.folder.names(f"{name}/cell=*") else []
        if gone is not None:
            gone.select(self.id).write.parquet(f"{self.path}/{name}-gone")
        facts = {"folder": name, "gone": gone is not None, "cells": {str(r["cell"]): [r["angle"], r["rows"]] for r in cells}}
        if not self.folder.create(f"batch-{number:09d}", json.dumps(facts)):
            for f in (name, f"{name}-gone"):
                self.folder.delete(f)
            raise RuntimeError(f"another writer has written batch {number} of {self.path}")

    def _rows(self, batches: list[dict], cells: set[int] | None = None) -> DataFrame:
        """The present rows of some cells (all, if not given)."""
        parts = []
        for b in batches:
            names = [f"cell={c}" for c in sorted(map(int, b["cells"])) if cells is None or c in cells]
            if names:
                schema = StructType([*self.meta["schema"].fields])
                parts.append((b["number"], read_parts(self.spark, f"{self.path}/{b['folder']}", names, schema)))
        if not parts:
            return self.spark.createDataFrame([], self.meta["schema"])
        gone = [(b["number"], self.spark.read.schema(StructType([self.meta["schema"][self.id]])).parquet(f"{self.path}/{b['folder']}-gone")) for b in batches if b["gone"]]
        out = None
        for number, rows in parts:
            for later, ids in gone:
                if later > number:
                    rows = rows.join(ids, self.id, "left_anti")
            out = rows if out is None else out.unionByName(rows)
        return out.select(*self.meta["schema"].names)

    def read(self) -> DataFrame:
        """All present rows."""
        return self._rows(self.batches())

    def insert(self, rows: DataFrame) -> None:
        """Add rows; those with a known id replace it. Only these rows are written."""
        batches = self.batches()
        known = self._rows(batches).select(self.id).join(rows.select(self.id).distinct(), self.id, "left_semi")
        self._write(batches[-1]["number"] + 1, rows.select(*self.meta["schema"].names), None if known.isEmpty() else known)

    def delete(self, ids: DataFrame) -> None:
        """Drop the rows with these ids."""
        batches = self.batches()
        self._write(batches[-1]["number"] + 1, self.spark.createDataFrame([], self.meta["schema"]), ids.where(F.col(self.id).isNotNull()).select(self.id).distinct())

    def compact(self) -> None:
        """One batch of all present rows; the older ones go, so no reader may be at work."""
        batches = self.batches()
        number = batches[-1]["number"] + 1
        rows = self.read()
        self._write(number, rows, rows.select(self.id))  # until they are removed, the older copies count as gone
        for b in batches:
            self.folder.delete(f"batch-{b['number']:09d}")
            for f in (b["folder"], f"{b['folder']}-gone"):
                self.folder.delete(f)

    def _ranked(self, rows: DataFrame, q: Sequence[float], k: int, where: Column | None, allowed: DataFrame | None) -> DataFrame:
        rows = rows if where is None else rows.where(where)
        rows = rows if allowed is None else rows.join(allowed.select(F.col(allowed.columns[0]).alias(self.id)), self.id, "left_semi")
        score = F.round(cosine(F.col(self.vector), F.array(*map(F.lit, q))), 6)
        return rows.select(F.col(self.id).alias("id"), score.alias("score")).where("score is not null").orderBy(F.desc("score"), "id").limit(k)

    def plan(self, query: Sequence[float], k: int, exact: bool = False, probes: int | None = None, where: Column | None = None, allowed: DataFrame | None = None, direct: int = DIRECT) -> tuple[list[dict], set[int] | None]:
        """The batches, and the cells that a search reads."""
        batches, q = self.batches(), np.asarray(query, dtype=np.float64)
        norm = np.linalg.norm(q)
        near = self.meta["centroids"] @ (q / norm if norm else q)
        order = np.argsort(-near, kind="stable")
        if not exact:
            return batches, set(order[: probes or self.meta["probes"]].tolist())
        if len(order) <= FIRST or sum(n for b in batches for _, n in b["cells"].values()) <= direct:
            return batches, None
        found = self._ranked(self._rows(batches, set(order[:FIRST].tolist())), q.tolist(), k, where, allowed).collect()
        least = found[-1]["score"] if len(found) == k else -2.0
        widest = {c: max(b["cells"][str(c)][0] for b in batches if str(c) in b["cells"]) for c in {int(c) for b in batches for c in b["cells"]}}
        reach = {c: math.cos(max(0.0, math.acos(max(-1.0, min(1.0, near[c]))) - a)) for c, a in widest.items()}
        return batches, {c for c, most in reach.items() if most >= least - 2e-6}

    def search(self, query: Sequence[float], k: int = 10, least: float = 0.0, where: Column | None = None, allowed: DataFrame | None = None, exact: bool = False, probes: int | None = None, direct: int = DIRECT) -> DataFrame:
        """id, score of the k nearest by cosine that pass ``where`` and are in ``allowed`` (before the cut), of them those with at least ``least``."""
        k = min(k, MOST_RESULTS)
        q = [float(x) for x in query]
        batches, cells = self.plan(q, k, exact, probes, where, allowed, direct)
        return self._ranked(self._rows(batches, cells), q, k, where, allowed).where(F.col("score") >= least)

    def read_share(self, query: Sequence[float], k: int = 10, exact: bool = False) -> float:
        """The share of the rows that a search reads."""
        batches, cells = self.plan(query, k, exact, direct=0)
        rows = [(int(c), n) for b in batches for c, (_, n) in b["cells"].items()]
        return sum(n for c, n in rows if cells is None or c in cells) / max(1, sum(n for _, n in rows))


def similar_pairs(vectors: DataFrame, least: float = 0.7, recall: float = 0.99, bits: int = 12, block: str | None = None, id_column: str = "vec_id", vector: str = "embedding", folder: str | None = None) -> DataFrame:
    """a, b, a_copies, b_copies, score of different vectors whose cosine reaches ``least``, a < b, found by random hyperplanes and checked exactly.

    Equal vectors (of a block) are one, under their smallest id, with the number
    of their copies; ids must be unique. A band is ``bits`` signs; there are as
    many bands as find a pair at ``least`` with probability ``recall`` (nearer
    pairs are surer). Only vectors that share a band meet. ``block`` limits
    pairs to rows of equal value. Where so many bands are needed that more than
    DENSE of all pairs would meet, bands spare nothing: with a shared ``folder``
    all pairs are then compared in matrices, and none is missed.
    """
    agree = (1 - math.acos(max(-1.0, min(1.0, least))) / math.pi) ** bits
    bands = max(1, math.ceil(math.log(1 - recall) / math.log(1 - agree))) if agree < 1 else 1
    v = F.col(vector)
    rows = vectors.where(F.col(id_column).isNotNull() & (dot(v, v) > 0)).select(F.col(id_column).alias("id"), v.alias("v"), (F.col(block).cast("string") if block else F.lit("")).alias("block"))
    copies = rows.groupBy("block", "v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))
    if folder and bands / 2**bits > DENSE:
        return block_pairs(copies, least, folder)

    def signs(batches):
        import pyarrow as pa

        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            out = []
            for x in batch.column(2).to_pylist():
                if len(x) not in planes:
                    planes[len(x)] = np.random.default_rng(len(x)).normal(size=(len(x), bands * bits))
                signed = (np.array(x, dtype=np.float64) @ planes[len(x)] > 0).reshape(bands, bits)
                out.append(signed @ (1 << np.arange(bits)) + (np.arange(bands) << bits))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int64()))], names=["id", "block", "bands"])

    kind = vectors.schema[id_column].dataType.simpleString()
    banded = copies.select("id", "block", "v").mapInArrow(signs, f"id {kind}, block string, bands array<long>")
    each = banded.select("block", F.explode("bands").alias("band"), "id")
    met = each.withColumnRenamed("id", "a").join(each.withColumnRenamed("id", "b"), ["block", "band"]).where("a < b").select("a", "b").distinct()
    a, b = (copies.select(F.col("id").alias(n), F.col("v").alias(f"v_{n}"), F.col("copies").alias(f"{n}_copies")) for n in "ab")
    near = met.join(a, "a").join(b, "b").withColumn("score", F.round(cosine(F.col("v_a"), F.col("v_b")), 6))
    return near.where(F.col("score") >= least).select("a", "b", "a_copies", "b_copies", "score")
