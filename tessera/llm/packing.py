"""Packing of tokenised documents into fixed-length sequences (operator 1).

Shortest-pack-first over the length histogram: documents are cut into pieces
of at most ``limit`` tokens, the piece lengths are counted, and the counts
alone are packed on the driver (the histogram has ``limit`` bins at most,
whatever the corpus). Each length, longest first, goes to the packs with most
room left; equal packs are kept as one pattern with a count. The patterns are
then joined back to the pieces by the rank of a piece among those of its
length. The pieces of a length are dealt into slots, as many as the number of
pieces asks for, and ranked within; a piece of the full length is a sequence of
its own, which needs no rank and moves nowhere.

Defined results: null texts are empty; an empty text still has its closing id;
repeated rows are packed once each; an empty table gives an empty result;
other columns of the input are ignored, so their names can't clash.
"""

from __future__ import annotations

from collections import defaultdict
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bytebpe
from .base import batch_of, keep, map_batches, tune

#: Tokens of a sequence; the id that closes a document.
LIMIT, END_ID = 2048, 1
#: Slots into which the pieces of each length are dealt for ranking: one for SLOT_PIECES pieces, within these bounds.
SLOT_PIECES, LEAST_SLOTS, MOST_SLOTS = 20_000, 16, 1024


def encode_pieces(docs: DataFrame, tokenizer: str, limit: int = LIMIT, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, number (of the piece, unlike any other's) and, if wanted, ids (little-endian uint32) of each piece."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    ddl = f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, number long" + ", ids binary" * with_ids

    counter: dict[int, int] = {}

    def work(batch: pa.RecordBatch):
        task = TaskContext.get().partitionId()
        schema = pa.schema([("doc_id", batch.schema.field(0).type), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("number", pa.int64()), *[("ids", pa.binary())] * with_ids])
        encoder, out, size = bytebpe.load(tokenizer), [[] for _ in schema], 0
        n = counter.get(task, task << 36)
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids = np.append(encoder.ids(text or ""), np.uint32(end_id)).astype("<u4", copy=False)
            for start in range(0, len(ids), limit):
                raw = ids[start : start + limit].tobytes()
                row = (doc_id, start, len(raw) // 4, crc32(raw), len(ids), n, raw)
                n += 1
                size += len(raw)
                for column, value in zip(out, row):
                    column.append(value)
            counter[task] = n
            if with_ids and size > 4 << 20:
                yield batch_of(schema, out)
                out, size = [[] for _ in schema], 0
        if out[0]:
            yield batch_of(schema, out)

    return map_batches(docs.select("doc_id", "text"), work, ddl)


def pack_histogram(counts: np.ndarray, limit: int = LIMIT) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns (number of packs, [(length, how many of it)]) for ``counts`` of lengths (index: length).

    As if pieces came one by one, longest first, each into the pack with most
    room; a new pack is opened only if no open one has room.
    """
    room: dict[int, list[tuple[int, tuple | None]]] = defaultdict(list)
    open_rooms = np.zeros(limit + 1, dtype=bool)
    done: list[tuple[int, tuple | None]] = []

    def put(left: int, packs: int, chain: tuple | None) -> None:
        if left == 0:
            done.append((packs, chain))
        else:
            room[left].append((packs, chain))
            open_rooms[left] = True

    for length in range(limit, 0, -1):
        rest = int(counts[length]) if length < len(counts) else 0
        while rest:
            roomy = np.flatnonzero(open_rooms[length:])
            if not len(roomy):
                each = limit // length
                if rest >= each:
                    put(limit - each * length, rest // each, (None, length, each))
                if rest % each:
                    put(limit - rest % each * length, 1, (None, length, rest % each))
                break
            left = int(roomy[-1]) + length
            packs, chain = room[left].pop()
            open_rooms[left] = bool(room[left])
            used = min(packs, rest)
            if used < packs:
                put(left, packs - used, chain)
            put(left - length, used, (chain, length, 1))
            rest -= used
    for groups in room.values():
        done += groups
    patterns = []
    for packs, chain in done:
        runs: list[list[int]] = []
        while chain is not None:
            chain, length, times = chain
            if runs and runs[-1][0] == length:
                runs[-1][1] += times
            else:
                runs.append([length, times])
        patterns.append((packs, [(a, b) for a, b in reversed(runs)]))
    return patterns


def place_table(patterns: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, pieces of this length a pack, offset), sorted by length and rank."""
    cursor: dict[int, int] = defaultdict(int)
    rows, first = [], 0
    for packs, runs in patterns:
        offset = 0
        for length, times in runs:
            rows.append((length, cursor[length], first, times, offset))
            cursor[length] += packs * times
            offset += length * times
        first += packs
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def pack_documents(docs: DataFrame, tokenizer: str, limit: int = LIMIT, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its sequence and its offset there.

    Only the counts of (length, slot) reach the driver: at most limit *
    MOST_SLOTS rows for any corpus. The pattern table that goes to the workers
    depends on the histogram's bins, not on the number of documents.
    """
    spark = docs.sparkSession
    tune(spark)
    pieces = keep(encode_pieces(docs, tokenizer, limit, end_id, with_ids), "pieces")
    partial = pieces.where(F.col("length") < limit)
    slots = min(MOST_SLOTS, max(LEAST_SLOTS, -(-partial.count() // SLOT_PIECES)))
    dealt = partial.withColumn("slot", F.pmod(F.xxhash64("number"), F.lit(slots)).cast("int"))
    seen = dealt.groupBy("length", "slot").count().toArrow()
    grid = np.zeros((limit + 1, slots), dtype=np.int64)
    grid[seen["length"].to_numpy(), seen["slot"].to_numpy()] = seen["count"].to_numpy()
    first_rank = np.cumsum(grid, axis=1) - grid
    patterns = pack_histogram(grid.sum(axis=1), limit)
    table = place_table(patterns)
    packs = sum(n for n, _ in patterns)
    shared = spark.sparkContext.broadcast((first_rank, table, (table[:, 0] << 44) + table[:, 1]))
    columns = [c for c in pieces.columns if c != "number"]
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema if f.name != "number") + ", sequence_id long, offset long"

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        first, rows, keys = shared.value
        length, slot, nth = (batch.column(batch.schema.get_field_index(x)).to_numpy() for x in ("length", "slot", "nth"))
        rank = first[length, slot] + nth - 1
        row = rows[np.searchsorted(keys, (length << 44) + rank, side="right") - 1]
        k = rank - row[:, 1]
        found = [row[:, 2] + k // row[:, 3], row[:, 4] + k % row[:, 3] * length]
        kept = [batch.column(batch.schema.get_field_index(c)) for c in columns]
        return pa.RecordBatch.from_arrays([*kept, *map(pa.array, found)], names=[*columns, "sequence_id", "offset"])

    order = Window.partitionBy("length", "slot").orderBy("number")
    ranked = dealt.withColumn("nth", F.row_number().over(order).cast("long"))
    full = pieces.where(F.col("length") == limit).select(*columns, (F.col("number") + F.lit(packs)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return map_batches(ranked, work, ddl).unionAll(full)


def padded_tokens(patterns: list[tuple[int, list[tuple[int, int]]]], limit: int = LIMIT) -> int:
    """Padding of all packs; a pack whose size is a power of two isn't padded."""
    sizes = [(packs, sum(a * b for a, b in runs)) for packs, runs in patterns]
    return sum(packs * (limit - size) for packs, size in sizes if size & (size - 1))
