"""Exact vector search, filters before the cut, and a deterministic embedder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import code_tokens

MOST_RESULTS = 100
#: Vectors of a matrix.
PART = 1024


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine; null for a zero vector."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms)


def scores(vectors: DataFrame, query: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id, score of all vectors against the one row of ``query`` (column q)."""
    return vectors.crossJoin(F.broadcast(query.select("q").limit(1))).select(F.col(id_column).alias("id"), F.round(cosine(F.col(vector), F.col("q")), 6).alias("score"))


def search(vectors: DataFrame, query: DataFrame, k: int = 10, least: float = 0.0, where: Column | None = None, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k nearest that pass ``where`` (taken before the cut), and of them those with at least ``least``."""
    rows = vectors if where is None else vectors.where(where)
    return scores(rows, query, id_column, vector).orderBy(F.desc_nulls_last("score"), "id").limit(min(k, MOST_RESULTS)).where(F.col("score") >= least)


def vector_blocks(rows: DataFrame, folder: str) -> DataFrame:
    """``rows`` (id, block, v, copies) as matrices of at most PART vectors of one length, along the order of their blocks; written.

    Columns no (unique), low, high (the least and largest block), dims, ids, blocks, copies, vectors (bytes).
    """
    kind = rows.schema["id"].dataType.simpleString()
    wide = rows.schema["v"].dataType.simpleString() != "array<float>"
    v = F.col("v").cast("array<double>") if wide else F.col("v")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(2).value_lengths().to_numpy()
            cuts = [0, *(np.flatnonzero(sizes[1:] != sizes[:-1]) + 1).tolist(), len(sizes)]
            for start, stop in zip(cuts, cuts[1:]):
                for at in range(start, stop, PART):
                    ids, blocks, vs, copies = batch.slice(at, min(PART, stop - at)).columns
                    x = vs.flatten().to_numpy()
                    one = lambda c: pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c)
                    yield pa.RecordBatch.from_arrays([blocks.slice(0, 1), blocks.slice(len(blocks) - 1), pa.array([int(sizes[at])], pa.int32()), one(ids), one(blocks), one(copies), pa.array([x.tobytes()])], names=["low", "high", "dims", "ids", "blocks", "copies", "vectors"])

    ordered = rows.select("id", "block", v.alias("v"), "copies").repartitionByRange("block", "id").sortWithinPartitions("block", F.size("v"))
    packed = ordered.mapInArrow(pack, f"low string, high string, dims int, ids array<{kind}>, blocks array<string>, copies array<long>, vectors binary").withColumn("no", F.monotonically_increasing_id())
    packed.write.parquet(f"{folder}/blocks")
    return rows.sparkSession.read.schema(packed.schema).parquet(f"{folder}/blocks")


def block_pairs(rows: DataFrame, least: float, folder: str) -> DataFrame:
    """a, b, a_copies, b_copies, score of all pairs a < b of ``rows`` (id, block, v, copies) of one block whose cosine reaches ``least``.

    Every two matrices that share a block meet once, and only the pairs that
    reach ``least`` leave them: in single precision with room for its error,
    then checked exactly. What is stored grows with the rows, the products with
    their square (within a block). ``folder`` is shared; the matrices lie there.
    """
    spark = rows.sparkSession
    matrices = vector_blocks(rows, folder)
    wide = rows.schema["v"].dataType.simpleString() != "array<float>"
    kind, number, item = rows.schema["id"].dataType.simpleString(), np.float64 if wide else np.float32, "double" if wide else "float"
    x, y = (matrices.select(*[F.col(c).alias(f"{c}_{n}") for c in matrices.columns]) for n in "xy")
    x = x.repartition(2 * spark.sparkContext.defaultParallelism)
    # of two matrices the first leads if the sum of their numbers is even, so each leads about as many
    leads = F.when((F.col("no_x") + F.col("no_y")) % 2 == 0, F.col("no_x") <= F.col("no_y")).otherwise(F.col("no_x") > F.col("no_y"))
    met = x.join(y, leads & (F.col("low_x") <= F.col("high_y")) & (F.col("low_y") <= F.col("high_x")))

    def read(raw: pa.Scalar, dims: int) -> tuple[np.ndarray, np.ndarray]:
        v = np.frombuffer(raw.as_buffer(), dtype=number).reshape(-1, dims)
        with np.errstate(all="ignore"):
            return v, (v / np.sqrt(np.square(v, dtype=np.float64).sum(1, keepdims=True))).astype(np.float32)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
            for k in range(batch.num_rows):
                dims = get["dims_x"][k].as_py()
                if dims != get["dims_y"][k].as_py():
                    continue
                (vx, ux), (vy, uy) = (read(get[f"vectors_{n}"][k], dims) for n in "xy")
                with np.errstate(all="ignore"):
                    near = ~(ux @ uy.T < least - 1e-5 - 1e-7 * dims)  # what isn't a number stays for the exact check
                if get["no_x"][k] == get["no_y"][k]:
                    near = np.triu(near, 1)
                p, q = np.nonzero(near)
                side = [(get[f"ids_{n}"][k].values.take(pa.array(at)), get[f"blocks_{n}"][k].values.take(pa.array(at)), get[f"copies_{n}"][k].values.take(pa.array(at))) for n, at in (("x", p), ("y", q))]
                for at in range(0, len(p), PART):
                    e = min(len(p), at + PART)
                    vectors = [pa.ListArray.from_arrays(pa.array(np.arange(e - at + 1) * dims, pa.int32()), pa.array(v[z[at:e]].ravel())) for v, z in ((vx, p), (vy, q))]
                    (i, bi, ci), (j, bj, cj) = ([c.slice(at, e - at) for c in s] for s in side)
                    yield pa.RecordBatch.from_arrays([i, bi, ci, vectors[0], j, bj, cj, vectors[1]], names=["i", "bi", "ci", "vi", "j", "bj", "cj", "vj"])

    side = lambda n: f"{n} {kind}, b{n} string, c{n} long, v{n} array<{item}>"
    found = met.select(*[f"{c}_{n}" for n in "xy" for c in ("no", "dims", "ids", "blocks", "copies", "vectors")]).mapInArrow(meet, f"{side('i')}, {side('j')}").where("bi = bj AND i <> j")
    first = F.col("i") < F.col("j")
    pick = lambda m, n: F.when(first, F.col(m)).otherwise(F.col(n))
    score = F.round(cosine(pick("vi", "vj"), pick("vj", "vi")), 6).alias("score")
    return found.select(pick("i", "j").alias("a"), pick("j", "i").alias("b"), pick("ci", "cj").alias("a_copies"), pick("cj", "ci").alias("b_copies"), score).where(F.col("score") >= least)


def similar_within(vectors: DataFrame, block: str, least: float = 0.7, id_column: str = "vec_id", vector: str = "embedding", folder: str | None = None) -> DataFrame:
    """Pairs within a block whose cosine reaches ``least``; without a shared ``folder`` for blocks of a known small size."""
    if folder:
        v = F.col(vector)
        rows = vectors.where(F.col(id_column).isNotNull() & F.col(block).isNotNull() & (dot(v, v) > 0))
        return block_pairs(rows.select(F.col(id_column).alias("id"), F.col(block).cast("string").alias("block"), v.alias("v"), F.lit(1).cast("long").alias("copies")), least, folder).select("a", "b", "score")
    a, b = (vectors.select(F.col(id_column).alias(n), F.col(vector).alias(f"v_{n}"), F.col(block).alias("block")) for n in "ab")
    pairs = a.join(b, "block").where("a < b").select("a", "b", F.round(cosine(F.col("v_a"), F.col("v_b")), 6).alias("score"))
    return pairs.where(F.col("score") >= least)


def hashed_embedder(dims: int = 64) -> Callable[[Column], Column]:
    """A deterministic stand-in for an embedding model: signed feature hashing of words, unit length.

    Words are hashed in the JVM; the sums run in Arrow batches, as a model would.
    """
    @F.pandas_udf("array<float>")
    def sums(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for hashes in batches:
            out = []
            for h in hashes:
                h = np.asarray(h, dtype=np.int64)
                v = np.bincount(h % dims, weights=np.where(h < 0, -1.0, 1.0), minlength=dims)
                norm = np.sqrt((v * v).sum())
                out.append((v / norm if norm else v).astype(np.float32))
            yield pd.Series(out)

    return lambda text: sums(F.transform(code_tokens(text), lambda t: F.xxhash64(t)))


def embed_distinct(chunks: DataFrame, embed: Callable[[Column], Column], content: str = "content") -> DataFrame:
    """``chunks`` with embedding and embedding_status; equal contents are embedded once, blank ones fail and stay."""
    key = F.sha2(F.coalesce(F.col(content), F.lit("")), 256)
    keyed = chunks.withColumn("content_hash", key)
    once = keyed.where(F.trim(content) != "").select("content_hash", content).dropDuplicates(["content_hash"]).select("content_hash", embed(F.col(content)).alias("embedding"))
    return keyed.join(once, "content_hash", "left").withColumn("embedding_status", F.when(F.col("embedding").isNull(), "failed").otherwise("completed"))
