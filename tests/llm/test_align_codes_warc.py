"""Alignment, vector codes and archives against brute force, and hard input."""

import gzip
import hashlib
import heapq
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import align, bytebpe, queries, vector_codes, warc
from tests.oracle import SF, canonical, run_sql

BYTES, PIECES = queries.tokenizer_path("byte_bpe_50k.json"), queries.tokenizer_path("piece_bpe_32k.model")
PROSE = "the quick brown fox jumps over a lazy dog while many small birds sing in the old garden near our house"
TEXTS = [(1, None), (2, ""), (3, "  \n\t "), (4, "a"), (5, PROSE), (5, PROSE), (None, PROSE), (6, "x" * 9000), (7, (PROSE + "\n") * 300), (8, "é漢字 <|endoftext|> <s> naïve 12 ٣ '' don't <0x0A> \x00"), (9, "a▁b"), (10, " " * 3000 + "end "), (11, "ﬁ ﬂ é 　x")]


def plain_alignment(rows):
    """The contract, token by token, by the libraries themselves."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(BYTES)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    letters, vocab = bytebpe.byte_letters(), {n: t for t, n in a.get_vocab().items()}

    def piece(k):
        return bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode()

    texts = []
    for doc_id, text in rows:
        ia, ib = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        ba, bb = [bytes(letters[c] for c in vocab[k]) for k in ia], [piece(k) for k in ib]
        if b"".join(ba) != b"".join(bb) or (text and b"".join(ba) != (" " + text).encode()):
            ia, ib, ba, bb = [], [], [], []
        ends_a, ends_b = list(np.cumsum([len(x) for x in ba])), list(np.cumsum([len(x) for x in bb]))
        common = sorted({*ends_a} & {*ends_b})
        groups, i, j, links = [], 0, 0, []
        for end in common:
            x, y = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
            groups.append(",".join(map(str, ia[i:x])) + "|" + ",".join(map(str, ib[j:y])))
            links.append((ia[x - 1], ib[y - 1]))
            i, j = x, y
        texts.append((doc_id, len(ia), len(ib), links, ";".join(groups)))
    count = Counter(x for t in texts for x in t[3])
    top = defaultdict(int)
    for (_, y), n in count.items():
        top[y] = max(top[y], n)
    return [(d, na, nb, len(ls), len(ls), sum(count[x] == top[x[1]] for x in ls), sum(count[x] for x in ls), hashlib.sha256(g.encode()).hexdigest() if g else "", g) for d, na, nb, ls, g in texts], count, top


NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"]


def test_alignment_equals_brute_force(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumns({"row": F.lit(1), "N_A": F.lit("x"), "cells": F.lit(None).cast("int")}).repartition(3)
    want = plain_alignment(TEXTS)[0]
    for chunk, stripes in ((1 << 16, 256), (40, 7)):
        got = align.align(docs, BYTES, PIECES, outputs=True, stripes=stripes, chunk=chunk)
        assert got.columns == NAMES
        assert canonical([tuple(r) for r in got.collect()], NAMES) == canonical(want, NAMES)
    assert align.align(docs.limit(0), BYTES, PIECES).count() == 0


def test_alignment_query_equals_brute_force(spark):
    got = queries.op11_alignment(spark, SF)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = [w[:-1] for w in plain_alignment(rows)[0]]
    assert canonical([tuple(r) for r in got.collect()], NAMES[:-1]) == canonical(want, NAMES[:-1])


def test_pair_counts_with_small_flushes_and_splits(spark, monkeypatch):
    rows = [(k, f"{PROSE} {k}" if k % 3 else PROSE) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    want, count, top = plain_alignment(rows)
    monkeypatch.setattr(align, "FAN_IN", 2)
    matrix = align.Matrix(BYTES, PIECES)
    encoded = align.keep(align.encode(docs, BYTES, PIECES), "test")
    counted = align.count_links(encoded.repartition(6), matrix)
    assert {(r.a_id, r.b_id): (r.links, r.best) for r in align.pair_table(counted, matrix).collect()} == {(a, b): (n, n == top[b]) for (a, b), n in count.items()}
    scored = align.score_links(encoded, counted, matrix, split=3)
    got = {r.doc_id: (r.n_best, r.count_sum) for r in encoded.join(scored, "row").collect()}
    assert got == {w[0]: (w[5], w[6]) for w in want}


def plain_codes(rows, rounds=6):
    """Lloyd's rounds over Python integers; rows of (vec_id, label, vector)."""
    kept = [(v, label, x) for v, label, x in rows if x is not None and all(c is not None and math.isfinite(c) for c in x)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    if not kept:
        return []
    width = len(kept[0][2]) // 8
    parts = [[[math.floor(4096 * c) for c in x[p * width : (p + 1) * width]] for p in range(8)] for _, _, x in kept]
    books = [[list(parts[k][p]) for k in range(min(16, len(kept)))] for p in range(8)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(8):
            sums = defaultdict(list)
            for x in parts:
                sums[nearest(p, x[p])[1]].append(x[p])
            for e, xs in sums.items():
                books[p][e] = [sum(c) // len(xs) for c in zip(*xs)]
    digest = hashlib.sha256(",".join(str(c) for p in range(8) for e in books[p] for c in e).encode()).hexdigest()
    out, total = [], Counter()
    for (v, label, _), x in zip(kept, parts):
        near = [nearest(p, x[p]) for p in range(8)]
        out.append((v, "".join(f"{e:02x}" for _, e in near), sum(d for d, _ in near), label))
        total[label] += out[-1][2]
    return [(v, code, error, total[label], digest) for v, code, error, label in out]


CODES = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_codes_equal_brute_force(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice([None, 1, 2]), [rng.choice([-0.5, 0.0, 0.25, rng.gauss(0, 1)]) for _ in range(16)]) for k in range(300)]
    rows += [(k, 5, rows[k % 7][2]) for k in range(300, 500)]  # equal vectors: ties and unused entries
    rows += [(7, 1, rows[9][2]), (None, 1, rows[3][2]), (600, 1, None), (601, 1, [None] * 16), (602, 1, [float("nan")] * 16), (603, 1, [float("inf")] + [0.0] * 15), (604, None, [0.0] * 16)]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumns({"code": F.lit(1), "VECTOR": F.lit("x")})
    rows = [(v, label, x and [None if c is None else float(np.float32(c)) for c in x]) for v, label, x in rows]
    got = [canonical([tuple(r) for r in vector_codes.compress(frame.repartition(n)).collect()], CODES) for n in (1, 5)]
    assert got[0] == got[1] == canonical(plain_codes(rows), CODES)
    few = frame.where("vec_id < 5")
    assert canonical([tuple(r) for r in vector_codes.compress(few).collect()], CODES) == canonical(plain_codes(rows[:5]), CODES)
    assert vector_codes.compress(frame.limit(0)).columns == CODES and vector_codes.compress(frame.where("vec_id in (600, 601)")).count() == 0


def test_vectors_of_other_lengths_and_sizes(spark):
    rows = [(1, [1.0]), (2, [1.0] * 8), (3, [2.0] * 16), (4, [1e30] * 8), (5, [])]
    got = vector_codes.compress(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("label", F.lit("x"))).collect()
    assert sorted(r.vec_id for r in got) == [2, 4]


def test_codes_query_equals_sql(spark):
    rows, names = run_sql(vector_codes.duckdb_sql())
    got = queries.op12_vector_codes(spark, SF)
    assert canonical([tuple(r) for r in got.collect()], got.columns) == canonical(rows, names)


def test_heaps_pop_only_what_drift_violates():
    rng = np.random.default_rng(5)
    keys, ids = np.empty(0), np.empty(0, np.uint32)
    held: dict[int, float] = {}
    for step in range(60):
        limit = float(rng.random())
        holes = vector_codes.violated(keys, limit) if step % 2 else np.empty(0, np.int64)
        assert sorted(ids[holes]) == (sorted(i for i, k in held.items() if k < limit) if step % 2 else [])
        for i in ids[holes]:
            del held[i]
        new = rng.random(int(rng.integers(0, 40)))
        names = np.arange(step * 100, step * 100 + len(new)).astype(np.uint32)
        held |= dict(zip(names.tolist(), new.tolist()))
        keys, ids = vector_codes.exchange(keys, ids, holes, new, names)
        assert dict(zip(ids.tolist(), keys.tolist())) == held
        flat = keys.tolist()
        assert all(flat[(k - 1) // 2] <= flat[k] for k in range(1, len(flat))) and (not flat or flat[0] == heapq.nsmallest(1, flat)[0])


def test_bounds_spare_most_parts():
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 4, (16, 64))
    vectors = vector_codes.quantise(centres[rng.integers(0, 16, 4000)] + rng.normal(0, 0.05, (4000, 64)))
    books = vectors[:, :16].astype(np.int64)
    block, drift, sums, scanned = vector_codes.Block(vectors, 16), np.zeros((8, 16)), np.zeros((8, 16, 9), np.int64), []
    for _ in range(6):
        sums += block.round(books, drift)
        scanned.append(block.rescanned)
        apart = ((vectors[:, :, None, :] - books[:, None]) ** 2).sum(axis=3)
        assert (block.codes == apart.argmin(axis=2)).all()
        count = sums[:, :, -1:]
        new = np.where(count > 0, sums[:, :, :-1] // np.maximum(count, 1), books)
        drift, books = drift + vector_codes.drift_of(books, new), new
    assert scanned[0] == 32_000 and scanned[-1] < 16_000


BIG = "<p>" + "page " * 300 + "</p>"


def test_archives_round_trip(spark, tmp_path):
    rows = [(1, "http://a/", BIG), (2, "http://b/", BIG), (3, None, BIG), (3, "http://c/\r\nX: y", BIG), (4, "http://d/", "small"), (5, "http://e/", "small"), (6, "http://f/", None), (7, "http://g/", ""), (None, "http://h/", BIG), (None, None, BIG + "é"), (None, "http://i/", BIG + "é"), (8, "http://j/", "x" * 3_000_000), (9, "http://k/", "é" * 500), (10, "http://l/", "é" * 500), (11, "http://m/", "\r\n\r\nWARC/1.1\r\n" * 200), (12, "http://n/", "y" * 2000), (12, "http://n/", "y" * 2000), (13, "http://o/", "z"), (13, "http://o/", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"row": F.lit(5), "OFFSET": F.lit("z"), "digest": F.lit(None).cast("int")}).repartition(3)
    index = warc.write_archives(pages, str(tmp_path / "archives"), archive_bytes=10_000)
    assert index.count() == len(rows)
    entries = sorted(index.collect(), key=lambda r: (r.path, r.offset))
    for path in {r.path for r in entries}:  # any reader of the format sees the same records, end to end
        data, at = open(path, "rb").read(), len(warc.info(warc.DATE))
        assert gzip.decompress(data).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")
        for r in [r for r in entries if r.path == path]:
            assert r.offset == at
            at += r.length
        assert at == len(data)
    got = warc.read_records(index)
    found = got.collect()
    by_digest = defaultdict(list)
    for r in found:
        by_digest[r.payload_digest].append(r)
    texts = Counter((str(p) if p is not None else None, (h or "")) for p, _, h in rows)
    seen = Counter()
    for r in found:
        payload = r.payload if r.record_type == "response" else next(x.payload for x in by_digest[r.payload_digest] if x.payload is not None)
        assert hashlib.sha1(payload).hexdigest() == r.payload_digest and len(payload) == r.payload_bytes
        seen[r.name, payload.decode()] += 1
    assert seen == texts

    def of(html):
        return Counter((r.record_type, r.name, r.refers_to) for r in by_digest[hashlib.sha1(html.encode()).hexdigest()])

    assert of(BIG) == Counter({("response", "3", None): 1, ("revisit", "3", "3"): 1, ("revisit", "1", "3"): 1, ("revisit", "2", "3"): 1, ("revisit", None, "3"): 1})
    assert of(BIG + "é") == Counter({("response", None, None): 1, ("revisit", None, None): 1})
    assert of("small") == Counter({("response", "4", None): 1, ("response", "5", None): 1})
    assert of("é" * 500) == Counter({("response", "10", None): 1, ("revisit", "9", "10"): 1})
    assert of("y" * 2000) == Counter({("response", "12", None): 1, ("revisit", "12", "12"): 1}) and of("z") == Counter({("response", "13", None): 2})
    some = warc.read_records(index.where("page_id in (4, 8)"))
    assert sorted((r.name, len(r.payload)) for r in some.collect()) == [("4", 5), ("8", 3_000_000)]


def test_archive_query_equals_sql(spark):
    rows, names = run_sql(warc.SQL)
    got = queries.op13_warc(spark, SF)
    assert canonical([tuple(r) for r in got.collect()], got.columns) == canonical(rows, names)
    empty = spark.read.parquet(f"{SF}/pages.parquet").limit(0)
    assert warc.round_trip(empty).count() == 0


def test_ranges_merge_neighbours():
    rows = [("a", 0, 10), ("a", 10, 10), ("a", 25, 5), ("a", 1000, 5), ("a", 1005, 90), ("b", 1005, 5)]
    assert list(warc.ranges(rows, gap=5, most=50)) == [("a", 0, 30, [(0, 10), (10, 10), (25, 5)]), ("a", 1000, 1005, [(1000, 5)]), ("a", 1005, 1095, [(1005, 90)]), ("b", 1005, 1010, [(1005, 5)])]


def test_corrupt_archives_are_noticed(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", BIG)], "page_id long, url string, html string")
    index = warc.write_archives(pages, str(tmp_path / "w"))
    r = index.first()
    text = warc.record("response", "<urn:page:0:1>", "u", warc.DATE, r.digest, r.size, BIG.replace("page", "cage").encode())
    data = open(r.path, "rb").read()
    with open(r.path, "wb") as f:
        f.write(data[: r.offset] + text)
    with pytest.raises(Exception, match="another digest"):
        warc.read_records(index.withColumn("length", F.lit(len(text)))).collect()
