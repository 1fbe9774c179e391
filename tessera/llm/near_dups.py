"""Near-duplicate documents by Order MinHash (operator 10).

A text is its sequence of five-word shingles (words lower-cased A-Z; a text of
fewer words is one shingle). Each of SKETCHES hash functions picks the
PICKED smallest shingles, labelled by occurrence, and keeps their text order,
so a sketch survives edits but not reordering. Texts that share sketches are
compared by banded alignment: with m shingles aligned of a and b, the
similarity is m / (a + b - m), and SIMILAR or more is a link. Classes are the
connected components of links and exact copies.

How groups of any size are handled: exact copies are one text from the start.
The texts of a bucket are first compared with the bucket's leader only, the one
that shares most sketches with others (in a group of edited copies: the
original), and where they aren't like it with the second and third. Then come
thorough rounds: of every bucket that holds several classes, each two texts of
different classes are compared, those that share most sketches first. Buckets
are dealt out as blocks of two parts of PART texts, so a hot bucket is many
small groups; a pair belongs to the first bucket it shares; and within a block a
link that joins two classes spares the other pairs of these. Only texts that
meet a text of another class with enough shared sketches send their shingles.
So the work is linear where leaders suffice, and grows with the square of the
number of texts in a bucket only where they are of different classes.

What may be missed: a pair of similarity 0.8 shares each sketch with
probability 0.8 ** 3, so fewer than MIN_SHARED of 24 once in 60,000. Every other
link is found or joins texts that other links have joined.

Defined results: a null text, or one without words, is like no other: a class
of its own. Every input row gives one row. Rows that repeat a doc_id and text
are one document; rows that repeat a doc_id with another text are another one.
An empty table gives an empty result. Other columns are ignored, and ids may be
of any type that can be ordered. Documents with a null id take part; the class
of such documents alone has a null id.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import fresh, keep, map_batches, release, tune

WORDS, SKETCHES, PICKED, SIMILAR = 5, 24, 3, 0.8
#: Sketches that a pair must share to be aligned; texts in one part of a bucket; from how many shared sketches on each thorough round compares.
MIN_SHARED, PART, ROUNDS = 3, 256, (12, 3)
MIX, ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
SEEDS = np.random.default_rng(11).integers(1, 1 << 63, size=SKETCHES, dtype=np.uint64)
SALTS = np.random.default_rng(12).integers(1, 1 << 63, size=WORDS, dtype=np.uint64) | np.uint64(1)


class WordHashes(dict):
    """64-bit hashes of words; begun anew when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


_words = WordHashes()


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of each number."""
    x = x * MIX
    x ^= x >> np.uint64(32)
    x *= ODD
    x ^= x >> np.uint64(29)
    return x


def shingles(text: str) -> np.ndarray:
    """Hashes of the five-word shingles of a text, in text order."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    hashes = np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=len(words))
    n = max(1, len(hashes) - WORDS + 1)
    total = np.zeros(n, dtype=np.uint64)
    for k in range(min(WORDS, len(hashes))):
        total += hashes[k : k + n] * SALTS[k]
    return mixed(total)


def labelled(s: np.ndarray) -> np.ndarray:
    """Shingles made different by the number of their earlier occurrences."""
    order = np.argsort(s, kind="stable")
    t = s[order]
    new = np.append(True, t[1:] != t[:-1])
    if new.all():
        return s
    at = np.arange(len(s))
    nth = at - np.maximum.accumulate(np.where(new, at, 0))
    out = s.copy()
    out[order] = np.where(nth > 0, mixed(t + nth.astype(np.uint64) * SALTS[0]), t)
    return out


def sketches(s: np.ndarray) -> np.ndarray:
    """The Order MinHash sketches of labelled shingles."""
    out = np.empty(SKETCHES, dtype=np.uint64)
    step = min(SKETCHES, max(1, 60_000 // len(s)))  # small working sets
    for k in range(0, SKETCHES, step):
        seeds = SEEDS[k : k + step]
        h = mixed(s[None, :] ^ seeds[:, None])
        p = min(PICKED, len(s))
        best = np.sort(np.argpartition(h, p - 1, axis=1)[:, :p], axis=1)
        total = seeds.copy()
        for j in range(p):
            total = mixed(total + s[best[:, j]])
        out[k : k + step] = total
    return out


def aligned(a: list, b: list, most: int) -> int | None:
    """Elements that match in the best alignment of two sequences with at most ``most`` gaps in all; None if it needs more.

    The band follows the furthest points reached with d gaps on each diagonal.
    """
    n, m = len(a), len(b)
    reach = {1: 0}
    for d in range(min(most, n + m) + 1):
        for k in range(-d, d + 1, 2):
            x = reach[k + 1] if k == -d or (k != d and reach.get(k - 1, -1) < reach.get(k + 1, -1)) else reach[k - 1] + 1
            y = x - k
            while x < n and y < m and a[x] == b[y]:
                x += 1
                y += 1
            reach[k] = x
            if x >= n and y >= m:
                return (n + m - d) // 2
    return None


def in_order(a: np.ndarray, b: np.ndarray) -> int:
    """Size of a common subsequence over shingles that are unique in both: a lower bound of the alignment."""
    place = {x: i for i, x in enumerate(b.tolist())}
    tails: list[int] = []
    for x in a.tolist():
        i = place.get(x)
        if i is not None:
            k = bisect_left(tails, i)
            tails[k : k + 1] = [i]
    return len(tails)


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILAR) -> float:
    """m / (a + b - m) by alignment if it is ``least`` or more, else 0."""
    total = len(a) + len(b)
    if not len(a) or not len(b):
        return 0.0
    need = int(np.ceil(least * total / (1 + least) - 1e-9))  # the m that gives `least`
    x, y = labelled(a), labelled(b)
    if min(len(a), len(b)) < need or len(np.intersect1d(x, y, assume_unique=True)) < need:
        return 0.0
    head = int(np.argmin(np.append(a[: min(len(a), len(b))] == b[: min(len(a), len(b))], False)))
    a, b = a[head:], b[head:]
    tail = int(np.argmin(np.append((a[::-1][: min(len(a), len(b))] == b[::-1][: min(len(a), len(b))]), False)))
    a, b = (a[: len(a) - tail], b[: len(b) - tail])
    same, gaps = head + tail, total - 2 * need
    m = aligned(a.tolist(), b.tolist(), gaps) if gaps <= 2000 else None
    if m is None and gaps > 2000:  # the band would be wide: first a bound that is nearly always met
        m = in_order(x[head : len(x) - tail], y[head : len(y) - tail])
        if same + m < need:
            m = aligned(a.tolist(), b.tolist(), gaps)
    if m is None or same + m < need:
        return 0.0
    return (same + m) / (total - same - m)


def row_key(doc_id: Column, text_key: Column) -> Column:
    """What rows share that are one document."""
    return F.concat(F.coalesce(doc_id.cast("string"), F.lit("~")), F.lit(":"), F.coalesce(text_key, F.lit("~")))


def sketch_table(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (md5) and sketches of every row; written."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for text in batch.column(2).to_pylist():
            s = shingles(text or "")
            found.append(sketches(labelled(s)).view(np.int64).tolist() if len(s) else None)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, type=pa.list_(pa.int64()))], names=["doc_id", "text_key", "sketch"])

    return keep(map_batches(docs.select("doc_id", F.md5("text").alias("text_key"), "text"), work, f"doc_id {id_type}, text_key string, sketch array<long>"), "omh-sketches")


def verify(pairs: DataFrame, texts: DataFrame, material: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) that are links; written.

    Pairs that share few sketches are out before any text is moved.
    """
    side = lambda table, column, end: table.select(F.col("id").alias(end), F.col(column).alias(f"{column}_{end}"))
    near = pairs.join(side(texts, "sketch", "a"), "a").join(side(texts, "sketch", "b"), "b")
    shared = F.size(F.filter(F.zip_with("sketch_a", "sketch_b", lambda x, y: x == y), lambda e: e))
    near = near.where(shared >= MIN_SHARED).select("a", "b")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b, sa, sb = (batch.column(batch.schema.get_field_index(c)) for c in ("a", "b", "shingles_a", "shingles_b"))
        good = [similarity(*(np.frombuffer(v.as_buffer(), dtype=np.uint32) for v in (x, y)), least) >= least for x, y in zip(sa, sb)]
        return pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(good, type=pa.bool_()))

    both = near.join(side(material, "shingles", "a"), "a").join(side(material, "shingles", "b"), "b").select("a", "b", "shingles_a", "shingles_b")
    return keep(map_batches(both, work, "a long, b long"), "omh-links")


def blocks(members: DataFrame, *tables: DataFrame) -> DataFrame:
    """Blocks of buckets that hold several classes: in one of them each two ``members`` (key, id, label) of a bucket meet.

    Columns key, i, j, and a list of id, label, part and the columns of ``tables`` by id. Pairs are one of part i and one of part j.
    """
    parts = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("from"), F.max("label").alias("to"))
    parts = parts.where(F.col("from") != F.col("to")).select("key", F.ceil(F.col("n") / PART).cast("int").alias("parts"))
    placed = members.join(parts, "key").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    for t in tables:
        placed = placed.join(t, "id")
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    held = F.struct("id", "label", "part", *(c for t in tables for c in t.columns if c != "id"))
    return met.groupBy("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j")).agg(F.collect_list(held).alias("members"))


def cross_pairs(batch: pa.RecordBatch, from_: int, below: int) -> Iterator[tuple]:
    """Of each block: its key, columns, and the pairs (places, shared) of different classes that share from_ to below - 1 sketches, this bucket's first."""
    key, i, j = (batch.column(k).to_numpy() for k in range(3))
    lists = batch.column(3)
    ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    columns = lists.flatten().flatten()
    ids, labels, part = (c.to_numpy() for c in columns[:3])
    sketch = columns[3].flatten().to_numpy().reshape(-1, SKETCHES)
    for k in range(batch.num_rows):
        at = np.arange(ends[k], ends[k + 1])
        x, y = at[part[at] == i[k]], at[part[at] == j[k]]
        if not len(x) or not len(y):
            continue
        same = sketch[x][:, None, :] == sketch[y][None, :, :]
        shared = np.count_nonzero(same, axis=2)
        good = (labels[x][:, None] != labels[y][None, :]) & (shared >= from_) & (shared < below)
        if i[k] == j[k]:
            good = np.triu(good, 1)
        if good.any():
            before = int(np.argmax(sketch[x[0]] == key[k]))  # the sketch that this bucket holds
            good &= ~same[:, :, :before].any(axis=2)
            p, q = np.nonzero(good)
            if len(p):
                yield key[k], ids, labels, columns, x[p], y[q], shared[p, q]


def thorough(members: DataFrame, labels: DataFrame, texts: DataFrame, material: DataFrame, from_: int, below: int, least: float) -> DataFrame:
    """Links that join the classes of all pairs of a bucket with from_ to below - 1 shared sketches; written."""
    named = keep(members.join(labels, "id", "left").select("key", "id", F.coalesce("label", "id").alias("label")), "omh-named")
    sketch = texts.select("id", "sketch")

    def meet(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for key, ids, labels, _, x, y, _ in cross_pairs(batch, from_, below):
            at = np.unique(np.concatenate([x, y]))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), key)), pa.array(ids[at]), pa.array(labels[at])], names=["key", "id", "label"])

    def join(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for _, ids, labels, columns, x, y, shared in cross_pairs(batch, from_, below):
            root, found = {}, []

            def top(label: int) -> int:
                while (up := root.get(label, label)) != label:
                    label = up
                return label

            read = lambda k: np.frombuffer(columns[4][k].as_buffer(), dtype=np.uint32)
            for k in np.argsort(-shared, kind="stable").tolist():
                a, b = int(x[k]), int(y[k])
                p, q = top(int(labels[a])), top(int(labels[b]))
                if p != q and similarity(read(a), read(b), least) >= least:
                    root[max(p, q)] = min(p, q)
                    found.append(sorted((int(ids[a]), int(ids[b]))))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(z, type=pa.int64()) for z in zip(*found)], names=["a", "b"])

    able = keep(map_batches(blocks(named, sketch), meet, "key long, id long, label long").distinct(), "omh-able")
    found = keep(map_batches(blocks(able, sketch, material), join, "a long, b long").distinct(), "omh-links")
    release(named, able)
    return found


def links(docs: DataFrame, texts: DataFrame, least: float = SIMILAR) -> tuple[DataFrame, DataFrame]:
    """Verified links (a, b) between the ids of different texts, enough to join all that belong together, and the labels of their components.

    ``texts`` has id, text_key, first_doc and sketch of each different text.
    """
    flat = texts.select("id", F.explode("sketch").alias("key"))
    common = keep(flat.join(flat.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "key"), "omh-shared")
    fame = keep(common.groupBy("id").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("fame")).where(F.col("k") >= MIN_SHARED).select("id", "fame"), "omh-fame")
    members = keep(common.select("key", "id").join(fame, "id"), "omh-members")
    release(common)

    def read(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t).astype(np.uint32).tobytes() for t in batch.column(1).to_pylist()], type=pa.binary())], names=["id", "shingles"])

    wanted = fame.select("id").join(texts, "id").select("id", row_key(F.col("first_doc"), F.col("text_key")).alias("row_key"))
    whole = docs.select(row_key(F.col("doc_id"), F.md5("text")).alias("row_key"), "text").join(wanted, "row_key")
    material = keep(map_batches(whole.select("id", "text"), read, "id long, shingles binary").dropDuplicates(["id"]), "omh-material")

    def leader(table: DataFrame, name: str, *but: str) -> DataFrame:
        """``table`` with the most famous text of each bucket that isn't one of ``but``."""
        others = table.where(F.lit(True) if not but else ~F.col("id").isin(*(F.col(x) for x in but)))
        top = others.groupBy("key").agg((-F.max(F.struct("fame", (-F.col("id")).alias("minus")))["minus"]).alias(name))
        return keep(table.join(top, "key", "left"), "omh-led")

    led = [leader(members, "l1")]
    led.append(leader(led[-1], "l2", "l1"))
    led.append(leader(led[-1].where(F.col("l2").isNotNull()), "l3", "l1", "l2"))
    release(*led[:-1])
    led = led[-1]
    pair = lambda other: [F.least("id", other).alias("a"), F.greatest("id", other).alias("b")]
    first = keep(led.where("id <> l1").select(*pair("l1")).distinct(), "omh-pairs")
    once = verify(first, texts, material, least)
    hit = once.withColumn("hit", F.lit(True))
    unlike = keep(led.where("id <> l1").select("id", "l2", "l3", *pair("l1")).join(hit, ["a", "b"], "left").where(F.col("hit").isNull()).select("id", "l2", "l3").distinct(), "omh-unlike")
    second = unlike.where("id <> l2").select(*pair("l2")).unionAll(unlike.where("id <> l3").select(*pair("l3")))
    second = keep(second.distinct().join(first, ["a", "b"], "left_anti"), "omh-pairs")
    twice = verify(second, texts, material, least)
    found = keep(once.unionAll(twice), "omh-found")
    release(led, first, once, unlike, second, twice)
    labels, below = components(found), SKETCHES + 1
    for from_ in ROUNDS:
        more = thorough(members, labels, texts, material, from_, below, least)
        if not more.isEmpty():
            old, found = found, keep(found.unionAll(more), "omh-found")
            release(old, labels)
            labels = components(found)
        release(more)
        below = from_
    release(fame, members, material)
    return found.distinct(), labels


def components(edges: DataFrame) -> DataFrame:
    """id and label (the smallest id of its component) of every id in ``edges`` (a, b)."""
    both = keep(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "omh-edges")
    labels = keep(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("label")), "omh-labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near.withColumnRenamed("a", "id"), "id").select("id", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        # a label is itself an id of the component: jump to its label
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("onward"))
        new = keep(lower.join(jump, "label", "left").select("id", "was", F.least("label", F.coalesce("onward", "label")).alias("label")), "omh-labels")
        release(labels)
        labels = new.drop("was")
        labels.kept_path = new.kept_path
        if new.where("was <> label").isEmpty():
            release(both)
            return labels


def grouped(docs: DataFrame, least: float = SIMILAR) -> tuple[DataFrame, DataFrame]:
    """The sketch table of ``docs``, and of each different text with words: text_key, class_id (the smallest doc_id of its class), stays (the row key of the document of the class that stays)."""
    tune(docs.sparkSession)
    table = sketch_table(docs)
    # of a text the sketches are always the same, so the largest is any
    texts = table.where(F.col("sketch").isNotNull()).groupBy("text_key").agg(F.min("doc_id").alias("first_doc"), F.max("sketch").alias("sketch"))
    texts = keep(texts.withColumn("id", F.monotonically_increasing_id()), "omh-texts")
    found, labels = links(docs, texts, least)
    joined = keep(texts.select("text_key", "id", "first_doc").join(labels, "id"), "omh-joined")
    first = joined.groupBy("label").agg(F.min(F.struct(F.col("first_doc").isNull().alias("none"), "first_doc", "text_key")).alias("x")).select("label", "x.first_doc", F.col("x.text_key").alias("first_key"))
    linked = joined.select("text_key", "label").join(first, "label").select("text_key", F.col("first_doc").alias("class_id"), row_key(F.col("first_doc"), F.col("first_key")).alias("stays"))
    alone = texts.join(labels, "id", "left_anti").select("text_key", F.col("first_doc").alias("class_id"), row_key(F.col("first_doc"), F.col("text_key")).alias("stays"))
    known = keep(linked.unionAll(alone), "omh-known")
    release(texts, labels, joined)
    return table, known


def classes(docs: DataFrame, least: float = SIMILAR) -> DataFrame:
    """doc_id, class_id (smallest doc_id of the class) of every row."""
    table, known = grouped(docs, least)
    rows = table.select("doc_id", F.when(F.col("sketch").isNotNull(), F.col("text_key")).alias("text_key"))
    return rows.join(known.withColumn("known", F.lit(True)), "text_key", "left").select("doc_id", F.when(F.col("known"), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"))


def one_of_each(docs: DataFrame, least: float = SIMILAR) -> DataFrame:
    """The documents of ``docs`` that stay: of each class the one with the smallest id (of several texts of that id the one of least md5), once; all columns are kept.

    Documents without words all stay. Of rows that are one document but differ in other columns any one stays.
    """
    table, known = grouped(docs, least)
    key = fresh("omh_key", docs.columns)
    wordless = table.where(F.col("sketch").isNull()).select(row_key(F.col("doc_id"), F.col("text_key")).alias(key))
    stay = known.select(F.col("stays").alias(key)).unionAll(wordless).distinct()
    keyed = docs.withColumn(key, row_key(F.col("doc_id"), F.md5("text")))
    return keyed.join(stay, key, "left_semi").dropDuplicates([key]).drop(key)
