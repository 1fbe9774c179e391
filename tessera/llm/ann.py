"""Approximate nearest neighbours with an inverted multi-index (operator 8).

Every vector is cut into two halves, each half is quantised with its own
codebook, and the pair of centroids names a cell. For a query the cells are
visited by growing summed distance of their two centroids, with a heap over the
two sorted lists, until they hold the wanted share of all rows; the vectors in
them, and no others, are reranked by their exact inner product.

For the largest inner product each half gets one more component, which makes
all halves equally long (sqrt(M^2 - |x|^2), 0 for queries); then the nearest
centroid pair is the one of largest inner product.

The centroids are fitted on a bounded sample (about SAMPLE rows, chosen by a
hash), but every row is indexed; their number grows with the fourth root of the
rows, within LEAST and MOST. The share of rows to visit is calibrated: PROBES
sample queries are compared with brute force over all rows, and the smallest
share that finds TARGET of their true neighbours is taken. A share of 1 visits
every cell, which is the exact way.

Rows lie in blocks: runs of neighbouring cells of about BLOCK_ROWS rows, and a
cell of more rows (a repeated vector, say) in several blocks by a hash. A query
goes to the blocks that hold a cell it visits, with the list of these cells. A
task holds the rows of one block, lets its queries stream by, and returns the
best k of each; rows are moved once for each QUERIES queries of the whole table.

Defined results: vectors that are null or zero, hold a null or non-finite
component, or aren't as long as most take no part, as query or candidate; nor
do rows with a null id. A repeated id is several rows, and each may be a
neighbour of another. Fewer than k candidates give all of them; an empty table
gives an empty result; ties go to the smaller vec_id; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import keep, map_batches, tune

LEAST, MOST, SAMPLE, PROBES, TARGET = 64, 256, 20_000, 128, 0.94
#: Rows of a block, queries for which a block is moved once, and queries that are multiplied at a time: they bound a task's memory.
BLOCK_ROWS, QUERIES, AT_ONCE = 5000, 1 << 16, 256


def usable(rows: DataFrame, id_column: str, vector: str) -> DataFrame:
    """vec_id, v (array of double) and row (a number of its own) of the rows that take part; written."""
    v = F.col(f"`{vector}`").cast("array<double>")
    good = rows.select(F.col(f"`{id_column}`").cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    )
    size = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    same = good.where(F.size("v") == size[0]["n"]) if size else good.where(F.lit(False))
    return keep(same.withColumn("row", F.monotonically_increasing_id()), "ann-vectors")


def kmeans(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Centroids by Lloyd's rounds, begun with rows spread over the sample."""
    x = np.unique(x, axis=0)
    centers = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        nearest = np.argmin((centers**2).sum(1) - 2 * x @ centers.T, axis=1)
        size = np.bincount(nearest, minlength=len(centers))
        total = np.zeros_like(centers)
        np.add.at(total, nearest, x)
        centers[size > 0] = total[size > 0] / size[size > 0, None]
    return centers


class MultiIndex:
    """The two codebooks and the number of rows of each cell: at most MOST ** 2 counts."""

    def __init__(self, sample: np.ndarray, tops: tuple[float, float], centroids: int):
        self.half = sample.shape[1] // 2
        self.tops = tops
        self.books = [kmeans(self.longer(h, t), centroids) for h, t in zip(self.halves(sample), tops)]
        self.sizes = np.zeros((len(self.books[0]), len(self.books[1])), dtype=np.int64)

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, : self.half], x[:, self.half :]

    @staticmethod
    def longer(x: np.ndarray, top: float) -> np.ndarray:
        """Rows with the component that makes all of them ``top`` long."""
        return np.hstack([x, np.sqrt(np.maximum(0, top**2 - (x**2).sum(1)))[:, None]])

    def cells(self, x: np.ndarray) -> np.ndarray:
        """The cell of each row."""
        a, b = (np.argmin((c**2).sum(1) - 2 * self.longer(h, t) @ c.T, axis=1) for h, t, c in zip(self.halves(x), self.tops, self.books))
        return a * len(self.books[1]) + b

    def visit(self, query: np.ndarray, rows: float) -> list[int]:
        """Cells that are not empty by growing summed distance, until they hold ``rows`` rows."""
        near = []
        for h, c in zip((query[: self.half], query[self.half :]), self.books):
            d = (c**2).sum(1) - 2 * c[:, :-1] @ h
            order = np.argsort(d, kind="stable")
            near.append((order.tolist(), d[order].tolist()))
        (order_a, da), (order_b, db) = near
        sizes, width, found, held = self.sizes, len(order_b), [], 0
        heap = [(da[0] + db[0], 0, 0)]
        while heap and held < rows:
            _, i, j = heappop(heap)
            n = int(sizes[order_a[i], order_b[j]])
            if n:
                found.append(order_a[i] * width + order_b[j])
                held += n
            if j + 1 < len(db):
                heappush(heap, (da[i] + db[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(da):
                heappush(heap, (da[i + 1] + db[0], i + 1, 0))
        return found


    def lay_out(self) -> None:
        """The first block of each cell, and in how many blocks it lies."""
        flat = self.sizes.reshape(-1)
        self.parts = np.maximum(1, -(-flat // BLOCK_ROWS))
        self.first = np.zeros(len(flat), dtype=np.int64)
        block, held = 0, 0
        for cell, (n, parts) in enumerate(zip(flat.tolist(), self.parts.tolist())):
            if held and (held + n > BLOCK_ROWS or parts > 1):
                block, held = block + 1, 0
            self.first[cell] = block
            held += n
            if parts > 1:
                block, held = block + parts, 0

    def blocks(self, cells: np.ndarray) -> list[tuple[int, list[int]]]:
        """The blocks of some cells, each with those of the cells that it holds."""
        found: dict[int, list[int]] = {}
        for cell, first, parts in zip(cells.tolist(), self.first[cells].tolist(), self.parts[cells].tolist()):
            for block in range(first, first + parts):
                found.setdefault(block, []).append(cell)
        return list(found.items())


def best(rough: np.ndarray, queries: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query (a row of ``rough`` products, minus infinity where a row doesn't count) the places and exact inner products of its k best rows."""
    out = []
    for q, row in zip(queries, rough):
        at = np.flatnonzero(row > -np.inf)
        if len(at) > k:
            # the product of matrices may round otherwise than a row's own sum: leave room for that
            least = np.partition(row[at], -k)[-k]
            at = at[row[at] >= least - 1e-9 * max(1.0, abs(least))]
        score = (x[at] * q).sum(axis=1)
        order = np.lexsort((ids[at], -score))[:k]
        out.append((at[order], score[order]))
    return out


class Block:
    """The rows of one block, by cell."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, x: np.ndarray, cells: np.ndarray):
        order = np.argsort(cells, kind="stable")
        self.rows, self.ids, self.x, cells = rows[order], ids[order], x[order], cells[order]
        starts = np.flatnonzero(np.append(True, cells[1:] != cells[:-1]))
        self.span = dict(zip(cells[starts].tolist(), zip(starts.tolist(), [*starts[1:].tolist(), len(cells)])))
        self.products = 0

    def nearest(self, rows: np.ndarray, queries: np.ndarray, cells: list[list[int]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids and inner products of the k best rows of the visited cells, without the query's own row."""
        asked: dict[int, list[int]] = {}
        for n, visited in enumerate(cells):
            for cell in visited:
                asked.setdefault(cell, []).append(n)
        rough = np.full((len(queries), len(self.rows)), -np.inf)
        for cell, who in asked.items():
            if cell in self.span:
                a, b = self.span[cell]
                rough[who, a:b] = queries[who] @ self.x[a:b].T
                self.products += len(who) * (b - a)
        place = {r: n for n, r in enumerate(self.rows.tolist())}
        for n, r in enumerate(rows.tolist()):
            if r in place:
                rough[n, place[r]] = -np.inf
        return [(self.ids[at], score) for at, score in best(rough, queries, self.ids, self.x, k)]


def matrix_of(column: pa.Array) -> np.ndarray:
    """A list column as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def build(vectors: DataFrame) -> MultiIndex | None:
    """The index of ``vectors`` (vec_id, v, row): codebooks from a bounded sample, and cell sizes of all rows."""
    half = F.size("v") / 2
    norm = lambda part: F.sqrt(F.aggregate(part, F.lit(0.0), lambda a, x: a + x * x))
    half = F.floor(half).cast("int")
    facts = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(norm(F.slice("v", F.lit(1), half))).alias("a"), F.max(norm(F.slice("v", half + 1, F.size("v")))).alias("b")).first()
    if not facts["n"]:
        return None
    share = min(1.0, SAMPLE / facts["n"])
    # row numbers are distinct, so about SAMPLE rows are taken; the row of least hash in any case
    draw = F.pmod(F.xxhash64("row", F.lit(3)), F.lit(1_000_003))
    least = vectors.agg(F.min(draw)).first()[0]
    taken = vectors.where((draw < share * 1_000_003) | (draw == least)).select("row", "v").toArrow().sort_by("row")
    centroids = min(MOST, max(LEAST, int(4 * facts["n"] ** 0.25)))
    index = MultiIndex(np.vstack([matrix_of(c) for c in taken["v"].chunks if len(c)]), (facts["a"], facts["b"]), centroids)
    shared = vectors.sparkSession.sparkContext.broadcast(index)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        cell, n = np.unique(shared.value.cells(matrix_of(batch.column(1))), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int64)), pa.array(n.astype(np.int64))], names=["cell", "n"])

    counts = map_batches(vectors.select("vec_id", "v"), work, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    index.sizes.reshape(-1)[counts["cell"].to_numpy()] = counts["n"].to_numpy()
    index.lay_out()
    return index


def calibrate(vectors: DataFrame, index: MultiIndex, k: int) -> float:
    """The share of rows to visit for TARGET recall, from PROBES queries and brute force over all rows."""
    total = int(index.sizes.sum())
    share = min(1.0, 4 * PROBES / total)
    draw = F.xxhash64("row", F.lit(5))
    taken = vectors.where(F.pmod(draw, F.lit(1_000_003)) < share * 1_000_003).orderBy(draw).limit(PROBES).toArrow()
    if taken.num_rows == 0:
        return 1.0
    rows, x = taken["row"].to_numpy(), np.vstack([matrix_of(c) for c in taken["v"].chunks if len(c)])
    shared = vectors.sparkSession.sparkContext.broadcast((index, rows, x))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        index, asked, queries = shared.value
        ids, v, own = batch.column(0).to_numpy(), matrix_of(batch.column(1)), batch.column(2).to_numpy()
        cells = index.cells(v)
        rough = queries @ v.T
        rough[asked[:, None] == own[None, :]] = -np.inf
        found = best(rough, queries, ids, v, k)
        q = np.repeat(np.arange(len(queries)), [len(at) for at, _ in found])
        at = np.concatenate([at for at, _ in found])
        columns = [q, ids[at], np.concatenate([score for _, score in found]), cells[at].astype(np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["q", "vec_id", "score", "cell"])

    near = map_batches(vectors.select("vec_id", "v", "row"), work, "q long, vec_id long, score double, cell long")
    top = near.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k)
    truth = top.select("q", "cell").toArrow()
    q, cell = truth["q"].to_numpy(), truth["cell"].to_numpy()
    needed = []  # rows to visit until each true neighbour's cell is reached
    flat = index.sizes.reshape(-1)
    for n, query in enumerate(x):
        order = index.visit(query, total)
        held = dict(zip(order, np.cumsum(flat[order]).tolist()))
        needed += [held[c] for c in cell[q == n].tolist()]
    return min(1.0, float(np.quantile(needed, TARGET)) / total) if needed else 1.0


def scan_blocks(dealt: DataFrame, k: int) -> DataFrame:
    """query_row, query_id, vec_id, score of the best k of each query in each block.

    ``dealt`` has block, team, asks, row, vec_id, v, cells, and comes with the
    rows of a (block, team) together, the indexed ones (asks: 0) first.
    """
    schema = pa.schema([("query_row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, block = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, team, asks, rows, ids = (batch.column(n).to_numpy() for n in range(5))
            edge = np.append(True, (key[1:] != key[:-1]) | (team[1:] != team[:-1]) | (asks[1:] != asks[:-1]))
            starts = np.flatnonzero(edge).tolist()
            for a, b in zip(starts, [*starts[1:], batch.num_rows]):
                x, cells = matrix_of(batch.column(5).slice(a, b - a)), batch.column(6).slice(a, b - a)
                if now != (key[a], team[a]):
                    now, parts, block = (key[a], team[a]), [], None
                if not asks[a]:
                    parts.append((rows[a:b], ids[a:b], x, cells.flatten().to_numpy()))
                    continue
                if block is None:
                    if not parts:
                        continue
                    block, parts = Block(*(np.concatenate(c) for c in zip(*parts))), []
                cells = cells.to_pylist()
                for s in range(0, b - a, AT_ONCE):
                    e = min(b - a, s + AT_ONCE)
                    found = block.nearest(rows[a + s : a + e], x[s:e], cells[s:e], k)
                    n = [len(near) for near, _ in found]
                    columns = [np.repeat(rows[a + s : a + e], n), np.repeat(ids[a + s : a + e], n), *(np.concatenate(c) for c in zip(*found))]
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)

    return dealt.mapInArrow(run, "query_row long, query_id long, vec_id long, score double")


def search(rows: DataFrame, k: int = 20, every: int = 20, id_column: str = "vec_id", vector: str = "embedding", share: float | None = None) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest of each query (ids divisible by ``every``), and n_visited: the rows of the cells it visits."""
    spark = rows.sparkSession
    tune(spark)
    vectors = usable(rows, id_column, vector)
    index = build(vectors)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, n_visited long")
    total = int(index.sizes.sum())
    share = calibrate(vectors, index, k) if share is None else share
    shared = spark.sparkContext.broadcast(index)
    schema = pa.schema([("block", pa.int64()), ("asks", pa.int32()), ("row", pa.int64()), ("vec_id", pa.int64()), ("v", pa.list_(pa.float64())), ("cells", pa.list_(pa.int32())), ("n_visited", pa.int64())])

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        index, own = shared.value, batch.column(2).to_numpy()
        cells = index.cells(matrix_of(batch.column(1)))
        block = index.first[cells] + own.astype(np.uint64).astype(np.int64) * 0x9E3779B1 % 1_000_003 % index.parts[cells]
        one = pa.ListArray.from_arrays(pa.array(np.arange(len(cells) + 1, dtype=np.int32)), pa.array(cells.astype(np.int32)))
        zero = np.zeros(len(cells), dtype=np.int64)
        return pa.RecordBatch.from_arrays([pa.array(block), pa.array(zero.astype(np.int32)), batch.column(2), batch.column(0), batch.column(1), one, pa.array(zero)], names=schema.names)

    def plan(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        index = shared.value
        flat = index.sizes.reshape(-1)
        for n, q in enumerate(matrix_of(batch.column(1))):
            cells = np.array(index.visit(q, share * total))
            found = index.blocks(cells)
            same = lambda c, n=n: batch.column(c).take(pa.array([n] * len(found)))
            columns = [pa.array([b for b, _ in found], type=pa.int64()), pa.array([1] * len(found), type=pa.int32()), same(2), same(0), same(1), pa.array([c for _, c in found], type=pa.list_(pa.int32())), pa.array([int(flat[cells].sum())] * len(found), type=pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    ddl = "block long, asks int, row long, vec_id long, v array<double>, cells array<int>, n_visited long"
    asking = vectors.where(F.col("vec_id") % every == 0)
    teams = max(1, -(-asking.count() // QUERIES))
    # each query meets every row of its cells once: rows go to all teams of queries, a query to its own
    queries = keep(map_batches(asking.select("vec_id", "v", "row"), plan, ddl).withColumn("team", F.pmod(F.xxhash64("row", F.lit(7)), F.lit(teams)).cast("int")), "ann-queries")
    held = map_batches(vectors.select("vec_id", "v", "row"), place, ddl).withColumn("team", F.explode(F.sequence(F.lit(0), F.lit(teams - 1))))
    columns = ["block", "team", "asks", "row", "vec_id", "v", "cells"]
    dealt = held.select(*columns).unionAll(queries.select(*columns)).repartition("block", "team").sortWithinPartitions("block", "team", "asks")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    near = scan_blocks(dealt, k).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    visited = queries.select(F.col("row").alias("query_row"), "n_visited").distinct()
    return near.join(visited, "query_row").select("query_id", "rank", "vec_id", "score", "n_visited")
