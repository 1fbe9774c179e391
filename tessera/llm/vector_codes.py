"""Codes of vectors by exact integer Lloyd rounds with heaps (operator 12).

Every component x becomes the integer floor(SCALE * x); a vector is cut into
PARTS equal parts, each position with a codebook of at most ENTRIES entries.
Rounds assign every part to its nearest entry (squared Euclidean distance,
ties to the lower index) and move the entries to the floored means.

Heap Lloyd: the vectors lie in blocks of at most BLOCK rows, and a block keeps,
for each position and entry, a binary heap of the parts assigned to it. A
part's key is its lower bound on the distance to any other entry minus its
upper bound on that to its own, plus the drift its entry had gathered when the
part came in. As entries move, an entry's drift grows by its own step and the
largest step of the others. Only parts whose key lies below the drift may have
changed entry: they are popped, compared exactly with all entries, and pushed
into their entry's heap. The rest isn't touched. A heap is an implicit binary
tree in numpy arrays; pops and pushes go level by level over many nodes at once.

Distances, sums and means are integers, so the result depends neither on
partitions nor on the order of rows; the bounds are floating point with a
margin. A round writes its blocks as a table in the shared folder and sends
the changes of sums and counts, added up by Spark, to the driver: PARTS x
ENTRIES x (width + 1) integers, whatever the number of rows.

Defined results: rows whose vector is null, or holds null or non-finite
components, are dropped. The row of the smallest vec_id whose vector's length is
a positive multiple of PARTS sets the length; rows of another length are dropped. Null
vec_ids come after all others, and repeated ones are ordered by vector; each
row gives one row. With fewer than ENTRIES rows there are as many entries as
rows. Integers beyond LARGEST in size count as LARGEST, so that no distance
overflows; a label_error beyond the long type is null. An empty table gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from .base import keep, release, tune

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Rows of a block: what one worker holds at a time.
BLOCK = 1 << 15
#: The largest size of an integer component.
LARGEST = 1 << 26


def _sift(keys: np.ndarray, ids: np.ndarray, at: np.ndarray) -> None:
    """Move the elements at nodes of one level down to their places."""
    n = len(keys)
    while at.size:
        kid = 2 * at + 1
        inside = kid < n
        at, kid = at[inside], kid[inside]
        right = np.minimum(kid + 1, n - 1)
        kid = np.where(keys[right] < keys[kid], right, kid)
        falls = keys[kid] < keys[at]
        at, kid = at[falls], kid[falls]
        keys[at], keys[kid] = keys[kid], keys[at]
        ids[at], ids[kid] = ids[kid], ids[at]
        at = kid


def _settle(keys: np.ndarray, ids: np.ndarray, changed: np.ndarray) -> None:
    """Restore the heap after the elements at ``changed`` were replaced: these nodes and all above them, deepest level first."""
    layers = [changed]
    while layers[-1].size:
        layers.append(np.unique((layers[-1][layers[-1] > 0] - 1) // 2))
    nodes = np.unique(np.concatenate(layers))
    level = np.frexp((nodes + 1).astype(np.float64))[1]
    for depth in np.unique(level)[::-1]:
        _sift(keys, ids, nodes[level == depth])


def violated(keys: np.ndarray, drift: float) -> np.ndarray:
    """The nodes of a heap with a key below ``drift``; visits these and their children only."""
    found, at = [np.empty(0, np.int64)], np.arange(min(1, len(keys)))
    while at.size:
        at = at[keys[at] < drift]
        found.append(at)
        at = np.concatenate([2 * at + 1, 2 * at + 2])
        at = at[at < len(keys)]
    return np.concatenate(found)


def exchange(keys: np.ndarray, ids: np.ndarray, holes: np.ndarray, new_keys: np.ndarray, new_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The heap without the elements at ``holes`` and with the new ones."""
    if not holes.size and not new_ids.size:
        return keys, ids
    n = len(keys) - len(holes) + len(new_ids)
    stays = np.ones(len(keys), bool)
    stays[holes] = False
    free = np.concatenate([np.sort(holes), np.arange(len(keys), n)])
    free = free[free < n]
    tail = np.flatnonzero(stays[n:]) + n  # survivors beyond the new end fill holes too
    out_keys, out_ids = np.empty(n, keys.dtype), np.empty(n, ids.dtype)
    head = min(n, len(keys))
    out_keys[:head], out_ids[:head] = keys[:head], ids[:head]
    out_keys[free], out_ids[free] = np.concatenate([new_keys, keys[tail]]), np.concatenate([new_ids, ids[tail]])
    _settle(out_keys, out_ids, free)
    return out_keys, out_ids


class Block:
    """Integer vectors [PARTS, n, width] with their assignment and heaps."""

    def __init__(self, vectors: np.ndarray, entries: int):
        self.vectors = vectors
        parts, n, width = vectors.shape
        self.codes = np.full((parts, n), -1, np.int8)
        self.heaps = [[(np.empty(0), np.empty(0, np.uint32)) for _ in range(entries)] for _ in range(parts)]
        self.rescanned = 0

    def round(self, books: np.ndarray, drift: np.ndarray) -> np.ndarray:
        """Assign to the nearest entries of ``books``; returns the changes of (sums, counts) [parts, entries, width + 1]."""
        parts, n, width = self.vectors.shape
        entries = books.shape[1]
        change = np.zeros((parts, entries, width + 1), np.int64)
        self.rescanned = 0
        for p in range(parts):
            holes = [violated(keys, drift[p, e]) for e, (keys, _) in enumerate(self.heaps[p])]
            popped = np.concatenate([self.heaps[p][e][1][h] for e, h in enumerate(holes)]).astype(np.int64)
            if self.codes[p, 0] < 0:
                popped = np.arange(n)  # the first round
            self.rescanned += len(popped)
            old, x = self.codes[p, popped], self.vectors[p, popped].astype(np.int64)
            apart = np.empty((len(popped), entries), np.int64)
            for e in range(entries):
                apart[:, e] = ((x - books[p, e]) ** 2).sum(axis=1)
            new = apart.argmin(axis=1).astype(np.int8)  # the first of equal ones
            upper = np.sqrt(apart[np.arange(len(popped)), new].astype(np.float64))
            apart[np.arange(len(popped)), new] = np.iinfo(np.int64).max
            lower = np.sqrt(apart.min(axis=1).astype(np.float64)) if entries > 1 else np.full(len(popped), np.inf)
            key = lower - upper - 1e-9 * (np.where(np.isinf(lower), 0, lower) + upper) - 1e-6 + drift[p, new]
            moved = old != new
            whole = np.concatenate([x, np.ones((len(x), 1), np.int64)], axis=1)
            np.add.at(change[p], new[moved], whole[moved])
            left = moved & (old >= 0)
            np.subtract.at(change[p], old[left], whole[left])
            self.codes[p, popped] = new
            for e in range(entries):
                came = new == e
                self.heaps[p][e] = exchange(*self.heaps[p][e], holes[e], key[came], popped[came].astype(np.uint32))
        return change

    def errors(self, books: np.ndarray) -> np.ndarray:
        """Squared distances to the assigned entries, summed over the parts."""
        return sum(((self.vectors[p].astype(np.int64) - books[p][self.codes[p]]) ** 2).sum(axis=1) for p in range(len(books)))

    def pack(self) -> dict[str, bytes]:
        flat = [h for part in self.heaps for h in part]
        return {"vectors": self.vectors.tobytes(), "codes": self.codes.tobytes(), "sizes": np.array([len(k) for k, _ in flat], np.int32).tobytes(), "keys": np.concatenate([k for k, _ in flat]).tobytes(), "order": np.concatenate([i for _, i in flat]).tobytes()}

    @classmethod
    def unpack(cls, row: dict[str, bytes], n: int, width: int, entries: int) -> Block:
        self = cls.__new__(cls)
        self.vectors = np.frombuffer(row["vectors"], np.int32).reshape(PARTS, n, width)
        self.codes = np.frombuffer(row["codes"], np.int8).reshape(PARTS, n).copy()
        cuts = np.cumsum(np.frombuffer(row["sizes"], np.int32))[:-1]
        keys, order = np.split(np.frombuffer(row["keys"]), cuts), np.split(np.frombuffer(row["order"], np.uint32), cuts)
        self.heaps = [[(keys[p * entries + e], order[p * entries + e]) for e in range(entries)] for p in range(PARTS)]
        self.rescanned = 0
        return self


STATE = ("vectors", "codes", "sizes", "keys", "order")


def quantise(vectors: np.ndarray) -> np.ndarray:
    """Integers [PARTS, n, width] of doubles [n, PARTS * width]."""
    whole = np.clip(np.floor(SCALE * vectors), -LARGEST, LARGEST).astype(np.int32)
    return np.ascontiguousarray(whole.reshape(len(vectors), PARTS, -1).transpose(1, 0, 2))


def drift_of(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """How much the slack of each entry's parts may shrink: its own step and the largest of the others [parts, entries]."""
    step = np.sqrt(((new - old).astype(np.float64) ** 2).sum(axis=2))
    if step.shape[1] == 1:
        return step
    top = np.sort(step, axis=1)[:, -2:]
    others = np.repeat(top[:, 1:], step.shape[1], axis=1)
    others[np.arange(len(step)), step.argmax(axis=1)] = top[:, 0]
    return step + others


class Coder:
    """Fits codebooks to a table and codes its rows."""

    def __init__(self, vectors: DataFrame, rounds: int = ROUNDS):
        self.spark = vectors.sparkSession
        tune(self.spark)
        self.rounds = rounds
        sound = F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vector")).where(sound & (F.size("vector") > 0) & (F.size("vector") % PARTS == 0))
        first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(ENTRIES).collect()
        self.length = len(first[0]["vector"]) if first else 0
        self.rows = rows.where(F.size("vector") == self.length)
        if any(len(r["vector"]) != self.length for r in first):
            first = self.rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(ENTRIES).collect()
        self.books = quantise(np.array([r["vector"] for r in first]).reshape(len(first), self.length)).astype(np.int64) if first else np.zeros((PARTS, 0, 0), np.int64)
        self.sums = np.zeros((PARTS, len(first), self.length // PARTS + 1), np.int64)
        self.drift = np.zeros((PARTS, len(first)))
        kinds = {f.name: f.dataType for f in rows.schema}
        self.schema = StructType([StructField("vec_ids", ArrayType(kinds["vec_id"])), StructField("labels", ArrayType(kinds["label"])), *(StructField(n, BinaryType()) for n in (*STATE, "change")), StructField("rescanned", LongType())])
        self.result = StructType([StructField("vec_id", kinds["vec_id"]), StructField("label", kinds["label"]), StructField("code", StringType()), StructField("error", LongType())])
        #: Parts compared with all entries in each round, for reports and tests.
        self.rescans: list[int] = []

    def blocks(self) -> DataFrame:
        """The first round: cut every partition into blocks, without a shuffle."""
        books, drift, length = self.books, self.drift, self.length

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []

            def flush() -> pa.RecordBatch:
                table = pa.Table.from_batches(held).combine_chunks()
                held.clear()
                vectors = table.column("vector").combine_chunks()
                vectors = vectors.chunk(0) if isinstance(vectors, pa.ChunkedArray) else vectors
                block = Block(quantise(vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, length)), books.shape[1])
                return block_row(table.column("vec_id"), table.column("label"), block, block.round(books, drift))

            for batch in batches:
                for at in range(0, batch.num_rows, BLOCK):
                    part = batch.slice(at, BLOCK)
                    if held and sum(b.num_rows for b in held) + part.num_rows > BLOCK:
                        yield flush()
                    held.append(part)
            if sum(b.num_rows for b in held):
                yield flush()

        return self.rows.mapInArrow(run, self.schema)

    def next_blocks(self, state: DataFrame) -> DataFrame:
        """One more round over the blocks."""
        books, drift, width = self.books, self.drift, self.length // PARTS

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, labels, block in unpacked(batches, width, books.shape[1]):
                yield block_row(ids, labels, block, block.round(books, drift))

        return state.mapInArrow(run, self.schema)

    def update(self, state: DataFrame) -> None:
        """Add up the blocks' changes and move the entries."""
        shape = self.sums.shape
        size = int(np.prod(shape))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, rescanned = np.zeros(size, np.int64), 0
            for batch in batches:
                for change, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    total += np.frombuffer(change, np.int64)
                    rescanned += n
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 1, dtype=np.int32)), pa.array(np.append(total, rescanned))], names=["place", "value"])

        added = state.select("change", "rescanned").mapInArrow(run, "place int, value long").groupBy("place").agg(F.sum("value").alias("value"))
        found = {r["place"]: r["value"] for r in added.collect()}
        self.rescans.append(found[size])
        self.sums += np.array([found[k] for k in range(size)], np.int64).reshape(shape)
        count = self.sums[:, :, -1:]
        new = np.where(count > 0, self.sums[:, :, :-1] // np.maximum(count, 1), self.books)
        self.drift = self.drift + drift_of(self.books, new)
        self.books = new

    def fit(self) -> DataFrame:
        """All rounds; the blocks of the last one."""
        state = keep(self.blocks(), "codes")
        self.update(state)
        for _ in range(self.rounds - 1):
            old, state = state, keep(self.next_blocks(state), "codes")
            release(old)
            self.update(state)
        return state

    def codes(self, state: DataFrame) -> DataFrame:
        """vec_id, label, code, error by the present codebooks."""
        books, drift, width, schema = self.books, self.drift, self.length // PARTS, self.result

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, labels, block in unpacked(batches, width, books.shape[1]):
                block.round(books, drift)
                text = np.ascontiguousarray(block.codes.T).tobytes().hex()
                code = [text[k : k + 2 * PARTS] for k in range(0, len(text), 2 * PARTS)]
                yield pa.RecordBatch.from_arrays([ids.flatten(), labels.flatten(), pa.array(code), pa.array(block.errors(books))], names=schema.names)

        return state.mapInArrow(run, schema)

    def digest(self) -> str:
        """SHA-256 of all entries' components by part, entry and position."""
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


def block_row(ids: pa.ChunkedArray | pa.Array, labels: pa.ChunkedArray | pa.Array, block: Block, change: np.ndarray) -> pa.RecordBatch:
    def one(values: pa.ChunkedArray | pa.Array) -> pa.ListArray:
        if isinstance(values, pa.ListArray):
            return values
        flat = pa.concat_arrays(values.chunks) if isinstance(values, pa.ChunkedArray) else values
        return pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)

    packed = block.pack()
    columns = [one(ids), one(labels), *(pa.array([packed[n]], pa.binary()) for n in STATE), pa.array([change.tobytes()], pa.binary()), pa.array([block.rescanned], pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["vec_ids", "labels", *STATE, "change", "rescanned"])


def unpacked(batches: Iterator[pa.RecordBatch], width: int, entries: int) -> Iterator[tuple[pa.ListArray, pa.ListArray, Block]]:
    """Blocks, one at a time."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1)
            ids, labels = row.column(0), row.column(1)
            yield ids, labels, Block.unpack({n: row.column(2 + j)[0].as_py() for j, n in enumerate(STATE)}, len(ids.flatten()), width, entries)


def compress(vectors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every row with a sound vector."""
    coder = Coder(vectors, rounds)
    if not coder.length:
        return vectors.sparkSession.createDataFrame([], StructType([coder.result["vec_id"], *(StructField(n, LongType() if "error" in n else StringType()) for n in ("code", "error", "label_error", "codebooks_sha256"))]))
    state = coder.fit()
    coded = keep(coder.codes(state), "coded")
    release(state)
    totals = coded.groupBy(F.col("label").alias("of")).agg(F.try_sum("error").alias("label_error"))
    joined = coded.join(totals, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(coder.digest()).alias("codebooks_sha256"))


def duckdb_sql() -> str:
    """The same rounds as one chain of common table expressions, all distances computed."""
    steps = [
        f"""kept AS (SELECT vec_id, label, embedding, len(embedding) // {PARTS} AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(embedding) % {PARTS} = 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""x AS (SELECT vec_id, label, p, q, CAST(floor({SCALE}.0 * embedding[p * w + q + 1]) AS BIGINT) AS v
  FROM kept, range({PARTS}) t(p), range(w) u(q))""",
        f"firsts AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT {ENTRIES})",
        "book0 AS (SELECT p, e, q, v AS c FROM x JOIN firsts USING (vec_id))",
    ]
    for k in range(ROUNDS + 1):
        steps.append(f"""near{k} AS (SELECT vec_id, label, p, e, d FROM (
  SELECT vec_id, label, p, e, d, row_number() OVER (PARTITION BY vec_id, p ORDER BY d, e) AS r FROM (
    SELECT x.vec_id, any_value(x.label) AS label, x.p, b.e, CAST(sum((x.v - b.c) * (x.v - b.c)) AS BIGINT) AS d
    FROM x JOIN book{k} b ON x.p = b.p AND x.q = b.q GROUP BY x.vec_id, x.p, b.e)) WHERE r = 1)""")
        if k < ROUNDS:
            steps.append(f"""mean{k} AS (SELECT n.p, n.e, x.q, CAST(sum(x.v) AS BIGINT) AS s, count(*) AS n
  FROM near{k} n JOIN x ON x.vec_id = n.vec_id AND x.p = n.p GROUP BY n.p, n.e, x.q)""")
            steps.append(f"""book{k + 1} AS MATERIALIZED (SELECT b.p, b.e, b.q, CASE WHEN m.n IS NULL THEN b.c
    ELSE (m.s - ((m.s % m.n) + m.n) % m.n) // m.n END AS c
  FROM book{k} b LEFT JOIN mean{k} m ON m.p = b.p AND m.e = b.e AND m.q = b.q)""")
    return f"""WITH {", ".join(steps)},
coded AS (SELECT vec_id, any_value(label) AS label, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{ROUNDS} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY p, e, q)) FROM book{ROUNDS}) AS codebooks_sha256
FROM coded"""
