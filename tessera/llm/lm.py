"""Language-model scoring (operator 9): a hashed maximum-entropy model.

A token's probability is that of its class, times those of the class within it
and of the token within that: DEPTH softmaxes of WIDTH branches, each over hashed
features: the last word, the last two, and the word before the last (a skip),
all by the hashes of the words themselves. The WIDTH ** DEPTH - 1 most frequent
words have places, in the order of their counts. All others share one place and
are told apart below it by a tree of the same softmaxes along the bits of the
word's hash. It has as many levels as leave LEAF words in a leaf in the mean, so
it grows with the distinct words; within a leaf words have their smoothed
unigram probability.

Counting covers all training texts (partial counts in the workers, then one
shuffle by word). The weights are trained by distributed gradient updates. The
training texts are dealt by a hash into shards of a fixed number of tokens, in
the order of that hash, whatever the partitions or cores; in each round every
shard starts from the shared weights, takes adaptive gradient steps, and returns
its weights as half-precision blocks, whose exact sums give the mean by block. A
round takes every ROUNDS-th position of the training texts, another offset in
each, so the rounds together take every position once. The rows of the weights
grow with the square root of the distinct words and the tokens of a shard with
the weights, so what is sent stays in proportion.

Scoring runs in numpy batches. The counts of the TOP most frequent words go to
the workers (a fixed bound); the other words of each text are counted there and
joined with the counts of the corpus by word, so nothing is cut off.

Defined results: a null text is empty: one end token. Every input row gives one
row. Without training texts all probabilities are 1 and the scores 0. An empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import fold_of, keep, tune

#: The end token; no word holds white space.
END = b"\n"
#: Branches of a softmax (and their bits), and softmaxes above a placed word.
WIDTH, BRANCH, DEPTH = 16, 4, 3
#: Least bits of a feature's row, and rows for the square root of the distinct words.
BITS, ROWS = 16, 32
#: Distinct words in a leaf of the tree of rare words, in the mean; the hash before a text.
LEAF, START = 1024, 0x1B873593CC9E2D51
TOP = 200_000
ROUNDS, STEP, MINIBATCH = 1, 0.15, 8192
#: Training tokens of a shard for each weight.
SHARD = 2
#: Blocks in which weights are sent and averaged.
BLOCKS = 64
#: Words a worker counts before it passes the counts on.
HELD = 300_000
LN10 = float(np.log(10.0))


def words_of(text: str | None) -> list[bytes]:
    """Words in lower case A-Z and the end token."""
    return [*(text or "").encode().lower().split(), END]


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of some texts, one after another in lower case A-Z, and how many each text has; as :func:`words_of` without the end tokens."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat, ends = parts.flatten(), parts.offsets.to_numpy().astype(np.int64) - parts.offsets[0].as_py()
    real = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0  # white space at either end leaves an empty part
    up_to = np.append(0, np.cumsum(real))
    return flat.filter(pa.array(real)), np.diff(up_to[ends])


def count_words(docs: DataFrame) -> DataFrame:
    """word, n over all rows; each worker adds up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, end = [], 0, 0

        def added() -> pa.Table:
            return pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])

        for batch in batches:
            found = pc.value_counts(split_words(batch.column(0))[0])
            end += batch.num_rows
            held.append(pa.table({"word": found.field(0).cast(pa.binary()), "n": found.field(1)}))
            rows += len(found)
            if rows > 3 * HELD:
                held = [added()]
                rows = held[0].num_rows
                if rows > HELD:
                    yield from held[0].combine_chunks().to_batches(max_chunksize=HELD // 8)
                    held, rows = [], 0
        if end:
            held.append(pa.table({"word": pa.array([END]), "n": pa.array([end], type=pa.int64())}))
            yield from added().combine_chunks().to_batches(max_chunksize=HELD // 8)

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def hash_of(word: bytes) -> int:
    """Spark's xxhash64 of a word, without sign."""
    return xxhash.xxh64_intdigest(word, seed=42)


def leaves(vocabulary: DataFrame, common: list[bytes], counts: np.ndarray, types: int) -> np.ndarray:
    """Mass of each leaf of the tree of rare words (all but ``common``): their counts, one for each, and one for an unseen word."""
    levels = 0
    while LEAF << (BRANCH * levels) < types - len(common):
        levels += 1
    mass, shift = np.ones(1 << (BRANCH * levels)), 64 - BRANCH * levels
    leaf = F.shiftrightunsigned(F.xxhash64("word"), shift) if levels else F.lit(0).cast("long")
    found = vocabulary.groupBy(leaf.alias("leaf")).agg(F.sum(F.col("n") + 1).alias("mass")).toArrow()
    mass[found["leaf"].to_numpy()] += found["mass"].to_numpy()
    for word, n in zip(common, counts.tolist()):
        mass[hash_of(word) >> shift if levels else 0] -= n + 1
    return mass


def biases(mass: np.ndarray) -> list[np.ndarray]:
    """Of each level of a tree over ``mass``, the logs of the shares of the branches of its nodes; the root first."""
    found = []
    while len(mass) > 1:
        grid = mass.reshape(-1, WIDTH)
        mass = grid.sum(1)
        with np.errstate(divide="ignore", invalid="ignore"):
            found.insert(0, np.where(grid > 0, np.log(grid / mass[:, None]), -1e9).astype(np.float32))
    return found


class Model:
    """Vocabulary, classes and weights."""

    def __init__(self, words: list[bytes], counts: np.ndarray, tokens: int, types: int, mass: np.ndarray | None = None):
        self.words, self.tokens, self.types = words, tokens, types
        self.log_counts = np.log10(counts + 1.0)
        self.size = min(len(words), WIDTH**DEPTH - 1)  # places of words; the next one is for all others
        placed = np.zeros(WIDTH**DEPTH)
        placed[: self.size] = counts[: self.size] + 1.0
        placed[self.size] = max(0, tokens - counts[: self.size].sum()) + 1.0
        self.place_bias = biases(placed)
        if mass is None:
            mass = np.array([max(0, tokens - counts[: self.size].sum()) + types - self.size + 1.0])
        #: log10 of the mass of each leaf of rare words
        self.leaf_logs, self.branch_bias = np.log10(mass), biases(mass)
        self.levels = len(self.branch_bias)
        self.hashes = np.fromiter(map(hash_of, words), dtype=np.uint64, count=len(words))
        self.bits = max(BITS, int(np.ceil(np.log2(ROWS * np.sqrt(max(1, types))))))
        self.weights = lined_up(np.zeros((1 << self.bits, WIDTH), dtype=np.float32))

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state, weights=lined_up(state["weights"]))

    def listed(self) -> tuple[pa.Array, int]:
        """The words, to be looked up in, and the rank of the end token (-1 if it isn't one)."""
        return pa.array(self.words, type=pa.binary()).cast(pa.string()), self.words.index(END) if END in self.words else -1

    def features(self, m1: np.ndarray, m2: np.ndarray) -> np.ndarray:
        """Hashes of the three features of each position, from the hashes of the two words before."""
        a, b = m1.astype(np.uint64) + np.uint64(1), m2.astype(np.uint64) + np.uint64(1)
        h = np.stack([a * np.uint64(0x9E3779B97F4A7C15), (a * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (b * np.uint64(0x165667B19E3779F9)), b * np.uint64(0xD6E8FEB86659FD93) + np.uint64(0x5851F42D4C957F2D)])
        return h ^ (h >> np.uint64(29))

    def rows(self, h: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Rows of the weights for each feature at some nodes (numbers that differ between all softmaxes)."""
        x = (h + (nodes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9FB21C651E98DF25)) * np.uint64(0xC4CEB9FE1A85EC53)
        return (x >> np.uint64(64 - self.bits)).astype(np.uint16 if self.bits <= 16 else np.uint32)

    def softmax(self, h: np.ndarray, nodes: np.ndarray, bias: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Rows, exp of the sums of weights and bias, their totals, and the log-probabilities of the entries ``own``."""
        rows = self.rows(h, nodes)
        z = np.take(self.weights, rows[0], axis=0)
        z += np.take(self.weights, rows[1], axis=0)
        z += np.take(self.weights, rows[2], axis=0)
        z += bias
        np.minimum(z, 60, out=z)
        logs = z[np.arange(len(z)), own]
        np.exp(z, out=z)
        total = z @ np.ones(WIDTH, dtype=np.float32)
        return rows, z, total, logs - np.log(total)

    def forward(self, m: np.ndarray, m1: np.ndarray, m2: np.ndarray, leaf: np.ndarray | None = None):
        """Factors (rows, exponentials, totals, own entries), and natural log-probabilities of places ``m`` after ``m1`` and ``m2``.

        With ``leaf`` those of the leaves of rare words are included.
        """
        h, logs, factors = self.features(m1, m2), np.zeros(len(m)), []

        def descend(at, h: np.ndarray, path: np.ndarray, levels: list[np.ndarray], first: int) -> None:
            for k, bias in enumerate(levels):
                here = path >> (BRANCH * (len(levels) - k - 1))
                node, own = here >> BRANCH, here & (WIDTH - 1)
                rows, e, total, found = self.softmax(h, node + (first + (k << 32)), np.take(bias, node, axis=0), own)
                logs[at] += found
                factors.append((rows, e, total, own))

        descend(slice(None), h, m, self.place_bias, 0)
        at = np.flatnonzero(m == self.size) if leaf is not None and self.levels else ()
        if len(at):
            descend(at, h[:, at], leaf[at], self.branch_bias, 1 << 40)
        return factors, logs

    def log_probs(self, m: np.ndarray, m1: np.ndarray, m2: np.ndarray, leaf: np.ndarray | None = None) -> np.ndarray:
        order, at, times = distinct(m, m1, m2, m if leaf is None else leaf)
        m, m1, m2, leaf = np.take(m, at), np.take(m1, at), np.take(m2, at), None if leaf is None else np.take(leaf, at)
        found = np.empty(len(m), dtype=np.float64)
        for s in range(0, len(m), 4096):  # what fits the caches
            e = s + 4096
            found[s:e] = self.forward(m[s:e], m1[s:e], m2[s:e], None if leaf is None else leaf[s:e])[1]
        out = np.empty(len(order), dtype=np.float64)
        out[order] = np.repeat(found, times)
        return out

    def step(self, m: np.ndarray, m1: np.ndarray, m2: np.ndarray, leaf: np.ndarray, seen: np.ndarray) -> None:
        """One adaptive gradient step; ``seen`` has the sum of squared gradients of each row."""
        w, whole = self.weights, self.weights.view(ROW).ravel()
        _, at, times = distinct(m, m1, m2, leaf)
        m, m1, m2, leaf, times = np.take(m, at), np.take(m1, at), np.take(m2, at), np.take(leaf, at), times.astype(np.float32)
        deep = np.take(times, np.flatnonzero(m == self.size))
        for k, (rows, p, total, own) in enumerate(self.forward(m, m1, m2, leaf)[0]):
            many = times if k < len(self.place_bias) else deep
            p *= (many / total)[:, None]
            p.ravel()[np.arange(0, p.size, WIDTH) + own] -= many
            for r in rows:
                at, g = summed(r, p)
                power = np.einsum("ij,ij->i", g, g)
                power /= WIDTH
                power += np.take(seen, at)
                seen[at] = power
                power += 1e-3
                g *= (STEP / np.sqrt(power))[:, None]
                new = np.take(w, at, axis=0)
                new -= g
                np.put(whole, at, new.view(ROW).ravel())  # whole rows are copied much faster than rows of numbers


#: A row of the weights as one value.
ROW = np.dtype((np.void, 4 * WIDTH))


def lined_up(x: np.ndarray) -> np.ndarray:
    """A copy that begins at a cache line; a row of weights fills one, so it lies in one and not across two."""
    raw = np.empty(x.nbytes + 64, dtype=np.uint8)
    start = -raw.ctypes.data % 64
    out = raw[start : start + x.nbytes].view(x.dtype).reshape(x.shape)
    out[:] = x
    return out


def distinct(m: np.ndarray, m1: np.ndarray, m2: np.ndarray, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions in an order that puts equal ones side by side, the first of each different one, and how often it occurs."""
    bits = max(1, len(m) - 1).bit_length()
    key = (m.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (m1.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (m2.astype(np.uint64) * np.uint64(0xFF51AFD7ED558CCD)) ^ (leaf.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    key ^= key >> np.uint64(31)
    key *= np.uint64(0x9FB21C651E98DF25)
    key >>= np.uint64(bits)
    key <<= np.uint64(bits)
    key |= np.arange(len(m), dtype=np.uint64)
    key.sort()
    order = (key & np.uint64((1 << bits) - 1)).astype(np.int64)
    key >>= np.uint64(bits)
    new = np.ones(len(m), dtype=bool)
    np.not_equal(key[1:], key[:-1], out=new[1:])
    again = np.flatnonzero(~new)
    one, other = np.take(order, again - 1), np.take(order, again)
    for x in (m, m1, m2, leaf):  # different ones whose keys are equal stay apart
        new[again] |= np.take(x, one) != np.take(x, other)
    first = np.flatnonzero(new)
    return order, np.take(order, first), np.diff(first, append=len(m))


def by_row(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers in order, and their stable order; number and place are sorted as one value, which is faster than a sort of places."""
    shift = max(1, len(r) - 1).bit_length()
    wide = np.uint32 if int(r.max(initial=0)).bit_length() + shift <= 32 else np.uint64
    key = r.astype(wide)
    key <<= wide(shift)
    key |= np.arange(len(r), dtype=wide)
    key.sort()
    order = (key & wide((1 << shift) - 1)).astype(np.int64)
    key >>= wide(shift)
    return key.astype(np.int64), order


def summed(r: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different row numbers of ``r``, and the sum of the rows of ``p`` for each."""
    ordered, order = by_row(r)
    new = np.ones(len(r) + 1, dtype=bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:-1])
    first = np.flatnonzero(new[:-1])
    g = np.take(p, np.take(order, first), axis=0)
    alone = new[:-1] & new[1:]
    rest = np.flatnonzero(~alone)
    if len(rest):  # most numbers occur once: only the others are added up
        many = np.flatnonzero(~np.take(alone, first))
        # two neighbouring numbers are added as one complex number, which takes half the time
        g[many] = np.add.reduceat(np.take(p, np.take(order, rest), axis=0).view(np.complex64), np.flatnonzero(np.take(new, rest)), axis=0).view(np.float32)
    return np.take(ordered, first), g


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Begin and end of parts of about 4 MB of text, or one text."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    at = 0
    while at < len(size):
        end, total = at, 0
        while end < len(size) and total < 4 << 20:
            total += int(size[end])
            end += 1
        yield at, end
        at = end


def places(model: Model, listed: tuple[pa.Array, int], texts: pa.Array) -> tuple:
    """All tokens of some texts: unlisted words, sizes of each text, where it begins; rank (-1: not in TOP), place, the hashes of the two words before, and leaf."""
    flat, counts = split_words(texts)
    sizes = counts + 1
    first = np.cumsum(sizes) - sizes
    rank = np.full(int(sizes.sum()), listed[1], dtype=np.int64)
    inner = np.ones(len(rank), dtype=bool)
    inner[first + counts] = False  # the end tokens
    found = pc.fill_null(pc.index_in(flat, value_set=listed[0]), -1).to_numpy(zero_copy_only=False)
    rank[inner] = found
    missing = np.flatnonzero(found < 0)
    unlisted = flat.take(pa.array(missing)).cast(pa.binary()).to_pylist()
    m = np.minimum(rank.view(np.uint64), np.uint64(model.size)).view(np.int64)  # -1 is the largest number without sign
    hashes = np.take(model.hashes, rank, mode="clip") if len(model.hashes) else np.zeros(len(rank), dtype=np.uint64)
    if listed[1] < 0:
        hashes[~inner] = hash_of(END)
    at = np.flatnonzero(inner)[missing] if len(missing) else missing
    hashes[at] = np.fromiter(map(hash_of, unlisted), dtype=np.uint64, count=len(unlisted))
    leaf = (hashes >> np.uint64(64 - BRANCH * model.levels)).view(np.int64) if model.levels else np.zeros(len(rank), dtype=np.int64)
    m1, m2 = np.empty_like(hashes), np.empty_like(hashes)
    m1[1:], m2[2:] = hashes[:-1], hashes[:-2]
    m1[first] = START
    m2[first] = START
    second = (first + 1)[sizes > 1]
    m2[second] = START
    return (unlisted, at), sizes, first, rank, m, m1, m2, leaf


def train_round(training: DataFrame, model: Model, phase: int) -> None:
    """Average the weights that all shards reach from the present ones, and put them into ``model``.

    ``training`` has text, and draw, a hash of the row.
    """
    spark = training.sparkSession
    shards = max(1, -(-model.tokens // (SHARD * model.weights.size)))
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen, listed = None, None, None
        for batch in batches:
            texts = batch.column(0)
            if len(texts) and own is None:
                own = object.__new__(Model)
                own.__dict__.update(shared.value.__dict__, weights=lined_up(shared.value.weights))
                seen, listed = np.zeros(len(own.weights), dtype=np.float32), own.listed()
            for at, end in slices(texts):
                _, _, _, _, *m = places(own, listed, texts.slice(at, end - at))
                m, m1, m2, leaf = (x[phase::ROUNDS] for x in m)
                for s in range(0, len(m), MINIBATCH):
                    own.step(*(x[s : s + MINIBATCH] for x in (m, m1, m2, leaf)), seen)
        if own is not None:
            flat = own.weights.reshape(BLOCKS, -1).astype(np.float16)
            yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), type=pa.int32()), pa.array([x.tobytes() for x in flat], type=pa.binary())], names=["block", "weights"])

    def mean(block: tuple, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = None, 0
        for part in parts:
            for raw in part["weights"]:
                x = np.frombuffer(raw, dtype=np.float16).astype(np.float64)  # their sums are exact, in any order
                total = x if total is None else total + x
                n += 1
        yield pd.DataFrame({"block": [block[0]], "weights": [(total / n).astype(np.float32).tobytes()]})

    shard = F.pmod("draw", F.lit(shards)).cast("int")
    dealt = training.repartitionById(shards, shard).sortWithinPartitions("draw")
    sent = dealt.select("text").mapInArrow(run, "block int, weights binary")
    for row in sent.groupBy("block").applyInPandas(mean, "block int, weights binary").collect():
        model.weights.reshape(BLOCKS, -1)[row["block"]] = np.frombuffer(row["weights"], dtype=np.float32)
    shared.destroy()  # its copies are on the disks of the driver and of each executor


def score(docs: DataFrame, folds: int = 7, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark = docs.sparkSession
    tune(spark)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    fold = fold_of(F.col("doc_id"), folds)
    training = docs.where(fold != held_out).select("text", F.xxhash64("doc_id", "text").alias("draw"))
    vocabulary = keep(count_words(training), "lm-words")
    facts = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count(F.lit(1)).alias("types")).first()
    top = vocabulary.orderBy(F.desc("n"), "word").limit(TOP).toArrow()
    words, counts = top["word"].to_pylist(), top["n"].to_numpy().astype(np.int64)
    placed = WIDTH**DEPTH - 1
    model = Model(words, counts, int(facts["tokens"]), int(facts["types"]), leaves(vocabulary, words[:placed], counts[:placed], int(facts["types"])))
    del top
    if model.tokens:
        for k in range(ROUNDS):
            train_round(training, model, k)
    shared = spark.sparkContext.broadcast(model)
    rare_type = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, listed, row = shared.value, None, TaskContext.get().partitionId() << 36
        for batch in batches:
            listed = listed or model.listed()
            texts = batch.column(2)
            for at, end in slices(texts):
                (unlisted, where), sizes, first, rank, m, m1, m2, leaf = places(model, listed, texts.slice(at, end - at))
                known = rank >= 0
                logs = np.where(known, model.log_counts[np.maximum(rank, 0)] if len(model.log_counts) else 0.0, 0.0)
                other = m == model.size
                lm = model.log_probs(m, m1, m2, leaf) / LN10 + np.where(other, logs - model.leaf_logs[leaf], 0.0)
                add = lambda x: np.add.reduceat(x, first)
                cuts = np.searchsorted(where, np.append(first, len(rank))).tolist()
                rare = [[{"word": w, "n": n} for w, n in Counter(unlisted[a:b]).items()] for a, b in zip(cuts, cuts[1:])]
                if listed[1] < 0:  # not even the end token is listed
                    rare = [[*x, {"word": END, "n": 1}] for x in rare]
                part = batch.slice(at, end - at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + end - at)), part.column(0), part.column(1), pa.array(sizes), pa.array(add(known.astype(np.int64))), pa.array(add(logs)), pa.array(add(lm)), pa.array(rare, type=rare_type)],
                    names=["row", "doc_id", "held_out", "n_tokens", "n_known", "logs", "lm", "rare"],
                )
                row += end - at

    ddl = f"row long, doc_id {id_type}, held_out boolean, n_tokens long, n_known long, logs double, lm double, rare array<struct<word:binary,n:long>>"
    scored = keep(docs.select("doc_id", (fold == held_out).alias("held_out"), "text").mapInArrow(run, ddl), "lm-scored")
    shared.destroy()
    rare = scored.select("row", F.explode("rare").alias("x")).select("row", "x.word", F.col("x.n").alias("times"))
    found = rare.join(vocabulary, "word").groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more_logs"))
    whole = scored.drop("rare").join(found, "row", "left").fillna(0, ["more", "more_logs"])
    all_ = float(np.log10(model.tokens + model.types + 1))
    return whole.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.col("more")).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + F.col("more_logs") - F.col("n_tokens") * F.lit(all_)).alias("base_score"),
        (F.col("lm") + F.col("more_logs")).alias("score"),
    )
