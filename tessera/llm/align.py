"""Alignment of two tokenizers over a corpus (operator 11).

A text with a space before it is encoded by a byte-level vocabulary (A) and by
a piece vocabulary (B). Byte offsets at which tokens of both end cut them into
groups, and the two tokens that end there are a link. An id pair's count is the
number of links that hold it in all documents.

Id-striped dense count matrices: the pairs are dealt by B's id into STRIPES
stripes. Workers first add up what they see, then a stripe's task adds the
partial counts with ``np.add.at`` into a dense block (the stripe's B ids by all
A ids), whose row maxima give the best count of each B id. The links of the
documents are dealt in the same way, so that a stripe's counts and links meet
in one task: its block is filled once, then the links stream past it. Links of
a stripe with many are split over several tasks, each with the stripe's counts;
sums go back to the documents by row.

Long texts are encoded in pieces with the results of the whole: A as in
:mod:`tessera.llm.bytebpe`; B at spaces between other characters, which no
piece of the vocabulary spans (this is checked when it is loaded).

Defined results: null and empty texts, and texts whose tokens don't give back
their bytes (U+2581 in a text), have no tokens: all zeros, and the empty
string. Every input row gives one row, repeated rows and null ids too. An empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytebpe
from .base import keep, map_batches, shuffle_width, tune

#: Parts of the B ids; a dense block has B's ids / STRIPES rows.
STRIPES = 256
#: Characters of a text that are encoded at once.
CHUNK = 1 << 16
#: Distinct pairs that a worker adds up before it sends them, and pairs or links of one row.
HELD, ROW = 1 << 21, 1 << 16
#: Links of a stripe that one task scores, and partial sums that one task adds up at first.
SPLIT, FAN_IN = 1 << 24, 64
#: Where a text may be cut for B.
CUT = re.compile("(?<=[^ ▁]) (?=[^ ▁])")


class Pieces:
    """Encoder of a sentencepiece vocabulary."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.sizes = np.array([len(x) for x in self.bytes], np.int64)
        #: Whether no piece goes on after a space that follows something else.
        self.cuttable = not any("▁" in p.lstrip("▁") for p in pieces)

    def parts(self, text: str, chunk: int = CHUNK) -> list[str]:
        """A text cut so that the parts' tokens are those of the whole; every part's leading space is left to the encoder."""
        found, at = [], 0
        while self.cuttable and len(text) - at > chunk:
            cut = CUT.search(text, at + chunk)
            if cut is None:
                break
            found.append(text[at : cut.start()])
            at = cut.end()
        return [*found, text[at:]]

    def encode(self, texts: list[str], chunk: int = CHUNK) -> list[np.ndarray]:
        """Ids of each text."""
        parts = [self.parts(x, chunk) for x in texts]
        ids = iter(self.model.encode([p for ps in parts for p in ps], num_threads=1))
        return [np.array([n for _ in ps for n in next(ids)], np.int64) for ps in parts]


@lru_cache(maxsize=2)
def load_pieces(path: str) -> Pieces:
    """The encoder of a file, made once in each worker."""
    return Pieces(path)


@lru_cache(maxsize=4)
def written(size: int, mark: str) -> np.ndarray:
    """Every id in decimal with a mark after it."""
    return np.array([f"{k}{mark}" for k in range(size)], object)


class Aligned:
    """One text's ids in A and B, and the places of their links (``at_a[k]`` and ``at_b[k]`` end together)."""

    def __init__(self, a: np.ndarray, b: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray):
        self.a, self.b = a, b
        ends_a, ends_b = np.cumsum(sizes_a[a]), np.cumsum(sizes_b[b])
        place = np.searchsorted(ends_b, ends_a)
        place[place == len(ends_b)] = 0
        self.at_a = np.flatnonzero(ends_b[place] == ends_a) if len(ends_b) else np.empty(0, np.int64)
        self.at_b = place[self.at_a]

    def groups(self, most_a: int, most_b: int) -> str:
        """``a1,a2|b1;a3|b2,b3``."""
        if not len(self.a):
            return ""
        out = np.empty(len(self.a) + len(self.b), object)
        before_b, through_a = np.zeros(len(self.a), np.int64), np.zeros(len(self.b), np.int64)
        before_b[self.at_a[:-1] + 1] = np.diff(self.at_b, prepend=-1)[:-1]  # B tokens of earlier groups
        through_a[np.concatenate([[0], self.at_b[:-1] + 1])] = np.diff(self.at_a, prepend=-1)  # A tokens up to this group
        text_a, text_b = written(most_a, ",")[self.a], written(most_b, ",")[self.b]
        text_a[self.at_a], text_b[self.at_b] = written(most_a, "|")[self.a[self.at_a]], written(most_b, ";")[self.b[self.at_b]]
        out[np.arange(len(self.a)) + np.cumsum(before_b)] = text_a
        out[np.arange(len(self.b)) + np.cumsum(through_a)] = text_b
        return "".join(out)[:-1]


def align_text(text: str, a: np.ndarray, b: np.ndarray, encoder: bytebpe.ByteBpe, pieces: Pieces) -> Aligned:
    """The alignment of a text with these ids; no tokens if they don't give back its bytes."""
    whole = b" " + text.encode()
    if not text or encoder.encoding.decode_bytes(a) != whole or b"".join([pieces.bytes[k] for k in b.tolist()]) != whole:
        a = b = np.empty(0, np.int64)
    return Aligned(a, b, encoder.sizes, pieces.sizes)


def encode(docs: DataFrame, tokenizer_a: str, tokenizer_b: str, outputs: bool = True, chunk: int = CHUNK) -> DataFrame:
    """row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256 of every document, its distinct id pairs (``cells``: B's id times A's number of ids plus A's id) with how often they are linked (``times``), and, if asked for, ``groups`` as text."""
    tune(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder, pieces = bytebpe.load(tokenizer_a, False), load_pieces(tokenizer_b)
        texts = [x or "" for x in batch.column(2).to_pylist()]
        counts, digests, groups, cells, times = [], [], [], [], []
        for text, b in zip(texts, pieces.encode(texts, chunk)):
            found = align_text(text, encoder.ids(f" {text}", chunk) if text else b, b, encoder, pieces)
            link, count = np.unique(found.b[found.at_b].astype(np.int64) * len(encoder.sizes) + found.a[found.at_a], return_counts=True)
            counts.append((len(found.a), len(found.b), len(found.at_a), int(count.sum())))
            groups.append(found.groups(len(encoder.sizes), len(pieces.sizes)))
            digests.append(hashlib.sha256(groups[-1].encode()).hexdigest() if groups[-1] else "")
            cells.append(link.astype(np.uint64).tobytes() if len(encoder.sizes) * len(pieces.sizes) > 1 << 32 else link.astype(np.uint32).tobytes())
            times.append(count.astype(np.uint32).tobytes())
        columns = [batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in zip(*counts)), pa.array(digests), pa.array(cells, pa.binary()), pa.array(times, pa.binary()), *([pa.array(groups)] if outputs else [])]
        return pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "cells", "times", *(["groups"] if outputs else [])])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col("text").cast("string").alias("text"))
    return map_batches(rows, work, f"row long, doc_id {id_type}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, cells binary, times binary" + ", groups string" * outputs)


class Matrix:
    """The stripes of the count matrix of two vocabularies."""

    def __init__(self, tokenizer_a: str, tokenizer_b: str, stripes: int = STRIPES):
        self.width, self.height = len(bytebpe.load(tokenizer_a, False).sizes), len(load_pieces(tokenizer_b).sizes)
        self.stripes, self.kind = stripes, np.uint64 if self.width * self.height > 1 << 32 else np.uint32

    def stripe(self, cells: np.ndarray) -> np.ndarray:
        """Which stripe a pair belongs to; frequent ids are neighbours, so the rest of a division spreads them."""
        return (cells // self.kind(self.width) % self.kind(self.stripes)).astype(np.int32)

    def block(self) -> np.ndarray:
        """A stripe's dense counts."""
        return np.zeros((-(-self.height // self.stripes), self.width), np.int64)

    def place(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and column of pairs in their stripe's block."""
        b, a = np.divmod(cells.astype(np.int64), self.width)
        return b // self.stripes, a


def by_stripe(matrix: Matrix, cells: np.ndarray, *others: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Runs of at most ROW pairs of one stripe, order kept within it."""
    stripe = matrix.stripe(cells)
    order = np.argsort(stripe, kind="stable")
    starts = np.flatnonzero(np.diff(stripe[order], prepend=-1))
    for start, end in zip(starts, [*starts[1:], len(order)]):
        for at in range(start, end, ROW):
            part = order[at : min(at + ROW, end)]
            yield int(stripe[part[0]]), [x[part] for x in (cells, *others)]


def partial_counts(links: DataFrame, matrix: Matrix, fan_out: int) -> DataFrame:
    """Pairs with the sums of each task (stripe, salt, cells, counts), and how many pairs of documents were added (``entries``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = TaskContext.get().partitionId() % fan_out
        cells, counts, entries = np.empty(0, matrix.kind), np.empty(0, np.int64), np.zeros(matrix.stripes, np.int64)

        def flush() -> Iterator[pa.RecordBatch]:
            rows = [(s, salt, c.tobytes(), n.tobytes(), int(k.sum())) for s, (c, n, k) in by_stripe(matrix, cells, counts, weight(cells, entries, matrix))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64()))], names=["stripe", "salt", "cells", "counts", "entries"])

        for batch in batches:
            new = np.frombuffer(b"".join(batch.column(0).to_pylist()), matrix.kind)
            times = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32)
            entries += np.bincount(matrix.stripe(new), minlength=matrix.stripes)
            cells, back = np.unique(np.concatenate([cells, new]), return_inverse=True)
            counts = np.concatenate([counts, times.astype(np.int64)])
            summed = np.zeros(len(cells), np.int64)
            np.add.at(summed, back, counts)
            counts = summed
            if len(cells) > HELD:
                yield from flush()
                cells, counts, entries = np.empty(0, matrix.kind), np.empty(0, np.int64), np.zeros(matrix.stripes, np.int64)
        yield from flush()

    return links.select("cells", "times").mapInArrow(run, "stripe int, salt int, cells binary, counts binary, entries long")


def weight(cells: np.ndarray, entries: np.ndarray, matrix: Matrix) -> np.ndarray:
    """``entries`` of each stripe, written at the stripe's first pair."""
    out = np.zeros(len(cells), np.int64)
    stripe, first = np.unique(matrix.stripe(cells), return_index=True)
    out[first] = entries[stripe]
    return out


def total_counts(partial: DataFrame, matrix: Matrix) -> DataFrame:
    """Partial counts added in dense blocks, by stripe and salt; rows must come grouped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, key, entries = matrix.block(), None, 0

        def flush() -> Iterator[pa.RecordBatch]:
            row, a = np.nonzero(block)
            cells = ((row * matrix.stripes + key[0]) * matrix.width + a).astype(matrix.kind)
            counts, best = block[row, a], block.max(axis=1)
            for at in range(0, len(cells), ROW):
                part = slice(at, at + ROW)
                flags = counts[part] == best[row[part]]
                yield pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([cells[part].tobytes()], pa.binary()), pa.array([counts[part].tobytes()], pa.binary()), pa.array([entries if at == 0 else 0], pa.int64()), pa.array([flags.tobytes()], pa.binary())], names=["stripe", "salt", "cells", "counts", "entries", "best"])
            block[row, a] = 0

        for batch in batches:
            for stripe, salt, cells, counts, added in zip(*(c.to_pylist() for c in batch.columns)):
                if key is not None and key != (stripe, salt):
                    yield from flush()
                    entries = 0
                key, entries = (stripe, salt), entries + added
                np.add.at(block, matrix.place(np.frombuffer(cells, matrix.kind)), np.frombuffer(counts, np.int64))
        if key is not None:
            yield from flush()

    grouped = partial.repartition("stripe", "salt").sortWithinPartitions("stripe", "salt")
    return grouped.mapInArrow(run, "stripe int, salt int, cells binary, counts binary, entries long, best binary")


def count_links(links: DataFrame, matrix: Matrix) -> DataFrame:
    """The count matrix of all links: stripe, cells, counts, best (whether the count is its B id's highest), entries; a table."""
    tasks = links.rdd.getNumPartitions()
    fan_out = max(1, tasks // FAN_IN)
    partial = partial_counts(links, matrix, fan_out)
    if fan_out > 1:  # so that no stripe has the sums of all tasks to add
        partial = total_counts(partial, matrix).select("stripe", F.lit(0).alias("salt"), "cells", "counts", "entries")
    return keep(total_counts(partial, matrix), "pair-counts")


def pair_table(counted: DataFrame, matrix: Matrix) -> DataFrame:
    """The counts as rows: b_id, a_id, links, best."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        cells, counts, flags = (b"".join(batch.column(k).to_pylist()) for k in range(3))
        b, a = np.divmod(np.frombuffer(cells, matrix.kind).astype(np.int64), matrix.width)
        return pa.RecordBatch.from_arrays([pa.array(b), pa.array(a), pa.array(np.frombuffer(counts, np.int64)), pa.array(np.frombuffer(flags, bool))], names=["b_id", "a_id", "links", "best"])

    return map_batches(counted.select("cells", "counts", "best"), work, "b_id long, a_id long, links long, best boolean")


def score_links(links: DataFrame, counted: DataFrame, matrix: Matrix, split: int = SPLIT) -> DataFrame:
    """row, n_best, count_sum of every document with links."""
    spark = links.sparkSession
    load = {r["stripe"]: r["n"] for r in counted.groupBy("stripe").agg(F.sum("entries").alias("n")).collect()}  # STRIPES rows at most
    salts = {s: max(1, -(-n // split)) for s, n in load.items()}

    def deal(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        texts = batch.column(1).to_pylist()
        rows = np.repeat(batch.column(0).to_numpy(), [len(x) // np.dtype(matrix.kind).itemsize for x in texts])
        cells, times = np.frombuffer(b"".join(texts), matrix.kind), np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint32)
        out = []
        for stripe, (c, r, t) in by_stripe(matrix, cells, rows, times):
            starts = np.flatnonzero(np.diff(r, prepend=-1)).astype(np.int32)
            out.append((stripe, int(r[0]) % salts[stripe], 1, c.tobytes(), t.tobytes(), r[starts].tobytes(), starts.tobytes()))
        kinds = (pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 4)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["stripe", "salt", "kind", "cells", "numbers", "rows", "starts"]) if out else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, key, filled, best = matrix.block(), None, [], None
        for batch in batches:
            done: list[tuple[np.ndarray, ...]] = []
            for stripe, salt, kind, cells, numbers, rows, starts in zip(*(c.to_pylist() for c in batch.columns)):
                at = matrix.place(np.frombuffer(cells, matrix.kind))
                if key != (stripe, salt):
                    for old in filled:
                        block[old] = 0
                    key, filled, best = (stripe, salt), [], None
                if kind == 0:
                    block[at] = np.frombuffer(numbers, np.int64)
                    filled.append(at)
                    continue
                if best is None:
                    best = block.max(axis=1)
                count, times, first = block[at], np.frombuffer(numbers, np.uint32).astype(np.int64), np.frombuffer(starts, np.int32)
                done.append((np.frombuffer(rows, np.int64), np.add.reduceat(times * (count == best[at[0]]), first), np.add.reduceat(times * count, first)))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*done)], names=["row", "n_best", "count_sum"])

    copies = F.coalesce(F.create_map(*(x for s, n in salts.items() for x in (F.lit(s), F.lit(n))))[F.col("stripe")], F.lit(1)) if salts else F.lit(1)
    counts = counted.select("stripe", F.explode(F.sequence(F.lit(0), copies - 1)).alias("salt"), F.lit(0).alias("kind"), "cells", F.col("counts").alias("numbers"), F.lit(None).cast("binary").alias("rows"), F.lit(None).cast("binary").alias("starts"))
    dealt = map_batches(links.select("row", "cells", "times"), deal, "stripe int, salt int, kind int, cells binary, numbers binary, rows binary, starts binary")
    met = counts.union(dealt).repartition(max(shuffle_width(spark), sum(salts.values()) // 4), "stripe", "salt").sortWithinPartitions("stripe", "salt", "kind")
    return met.mapInArrow(run, "row long, n_best long, count_sum long").groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def align(docs: DataFrame, tokenizer_a: str, tokenizer_b: str, outputs: bool = False, stripes: int = STRIPES, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document; with ``outputs`` also its groups as text."""
    matrix = Matrix(tokenizer_a, tokenizer_b, stripes)
    encoded = keep(encode(docs, tokenizer_a, tokenizer_b, outputs, chunk), "aligned")
    counted = count_links(encoded, matrix)
    scored = score_links(encoded, counted, matrix)
    joined = encoded.drop("cells", "times").join(scored, "row", "left")
    zero = F.lit(0).cast("long")
    return joined.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256", *(["groups"] if outputs else []))
