"""Small tests of the training-data operators: brute force, round trips, and hard input."""

import hashlib
import pickle
import re
import tracemalloc
import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import ann, language, lm, near_dups, packing, pii, quality, queries, token_counts, url_filter, wordbpe
from tests.oracle import SF, canonical, run_sql

BYTES, WORDS = queries.tokenizer_path("byte_bpe_50k.json"), queries.tokenizer_path("word_bpe_49k.json")
PROSE = "the quick brown fox jumps over a lazy dog while many small birds sing in the old garden near our house and river today"
HARD = [(1, None), (2, ""), (3, "   \n\t "), (4, "a"), (5, PROSE), (5, PROSE), (None, PROSE), (6, "x" * 70_000), (7, (PROSE + "\n") * 400), (8, "é漢字 <|endoftext|> naïve İΣ ΑΣ 12 ٣ '' don't"), (9, "!" * 3000), (10, " " * 3000 + "end")]


@pytest.fixture(scope="module")
def hard(spark):
    """Nulls, empty, very long, repeated rows, and extra columns with clashing names."""
    rows = spark.createDataFrame(HARD, "doc_id long, text string")
    return rows.withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("s"), "n_chars": F.length("text").cast("long"), "length": F.lit(1), "START": F.lit(2), "n_words": F.lit(None).cast("int"), "score": F.lit("x"), "class_id": F.lit(0), "spans": F.lit("y"), "t_": F.lit(0)})


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def test_packing_holds_every_id_once(spark, hard):
    rows = packing.pack_documents(hard, BYTES, with_ids=True).collect()
    held, total = library(BYTES), 0
    for (doc_id, text), n in Counter(HARD).items():
        ids = [*held.encode(text or "", add_special_tokens=False).ids, 1]
        mine = sorted((r.start, r.ids) for r in rows if r.doc_id == doc_id)
        assert np.concatenate([np.frombuffer(i, "<u4") for _, i in mine[::n]]).tolist() == ids
        total += n * len(ids)
    for r in rows:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(n for x in by.values() for _, n in x) == total
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
    assert packing.pack_documents(hard.limit(0), BYTES).count() == 0


def test_histogram_packs_tightly():
    counts = np.zeros(2049, dtype=np.int64)
    rng = np.random.default_rng(1)
    for n in rng.lognormal(5.5, 1, 20_000).astype(int).clip(1, 2048):
        counts[n] += 1
    patterns = packing.pack_histogram(counts)
    back = np.zeros_like(counts)
    for packs, runs in patterns:
        assert sum(a * b for a, b in runs) <= 2048
        for length, times in runs:
            back[length] += packs * times
    assert (back == counts).all()
    assert packing.padded_tokens(patterns) < 0.01 * (counts * np.arange(2049)).sum()
    one = packing.pack_histogram(np.array([0] * 100 + [1000]))
    assert sum(p for p, _ in one) == 50


def test_token_counts(spark, hard):
    held = library(BYTES)
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(hard, BYTES, chunk=500, overlap=16).collect())
    want = Counter((i, len((t or "").encode()), n := len(held.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t in HARD)
    assert got == want


def test_word_bpe(spark, hard):
    held = library(WORDS)
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in wordbpe.encode_decode(hard, WORDS).collect())
    want = Counter()
    for i, t in HARD:
        ids = held.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(held.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert got == want
    e = wordbpe.load(WORDS)
    rng = np.random.default_rng(3)
    for _ in range(400):
        word = "".join(rng.choice(list("aabeinstth'-=1"), rng.integers(0, 30)))
        assert np.frombuffer(e.encode(word)[0], "<u4").tolist() == held.encode(word, add_special_tokens=False).ids


def brute_quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = {w for w, n in Counter(windows).items() if n > 1}
    covered = {i + k for i, w in enumerate(windows) if w in many for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), len(lines))


def test_quality_measures(spark, hard):
    cols = [*quality.MEASURES, "n_lines"]
    got = Counter((r.doc_id, *(r[c] for c in cols)) for r in quality.measure(hard).collect())
    assert got == Counter((i, *brute_quality(t)) for i, t in HARD)


@pytest.mark.parametrize("name", ["op2_quality_rules", "op6_url_filter"])
def test_native_queries_equal_sql(spark, name):
    df = queries.queries()[name](spark, SF)
    rows, names = run_sql(queries.oracle_sql()[name])
    assert sorted(df.columns) == sorted(names)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(rows, names)


def test_ledger_policies_and_ablation(spark, documents):
    entries = quality.ledger(quality.measure(documents))
    judged = quality.apply_policy(entries, quality.POLICIES[2])
    kept = judged.where("kept").count()
    rows = {r.rule: r for r in quality.ablation(entries, quality.POLICIES[2]).collect()}
    for rule in quality.RULES:
        other = quality.Policy(9, quality.POLICIES[2].mask & ~(1 << rule.bit))
        bits = [r[0] for r in entries.select("failed_bits").collect()]
        assert rows[rule.name].kept_without == sum(b & other.mask == 0 for b in bits) == kept + rows[rule.name].only_this
        assert rows[rule.name].failed == sum(b >> rule.bit & 1 for b in bits)


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://a.example.ORG/es/1", "https://org/x?y", "http://x.com/de/1#f", "http://x.com/fr/", "http://example.org/en/19", "http://notorg/x", "http://o.org", "x://h" + "/s" * 5000, "http://x.com/en/7"]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumns({"host": F.lit(1), "s0": F.lit(2), "label": F.lit(3)})
    got = {r.page_id: (r.host, r.path[:9], r.rule, r.verdict) for r in url_filter.judge(rows).collect()}
    assert [got[n][2:] for n in range(12)] == [(None, "allow")] * 3 + [("example.org/es/", "block"), ("org/", "allow"), ("com/de/", "block"), ("com/fr/", "allow"), ("example.org/en/1", "block")] + [(None, "allow")] * 4
    assert got[3][:2] == ("a.example.org", "/es/1") and got[0][:2] == got[2][:2] == ("", "")
    assert url_filter.judge(rows.limit(0)).count() == 0


def test_template_tree_rejects_blocked_branches(spark):
    pages = [(i, f"http://h.net/{a}/{i}") for i, a in enumerate(["bad"] * 40 + ["good"] * 40)]
    rules = [("block", "h.net", f"/bad/{i}") for i in range(1, 4)] + [("allow", "h.net", f"/good/{i}") for i in range(40, 44)]
    rows = spark.createDataFrame(pages, "page_id long, url string")
    got = {r.page_id: r for r in url_filter.judge(rows, rules=rules).collect()}
    assert got[9].rule is None and got[9].verdict == "block" and got[9].template.startswith("/bad/")
    assert got[79].verdict == "allow" and got[79].template.startswith("/good/")


def test_language(spark, documents, hard):
    out = language.identify(documents).join(documents.select("doc_id", "lang", F.length("text").alias("n")), "doc_id").where("n > 200").collect()
    held = [r for r in out if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in out)
    got = language.identify(hard).collect()  # nothing to learn from
    assert len(got) == len(HARD) and {r.lang_pred for r in got} == {"und"}
    model = language.learn(documents)
    found = {(r.doc_id, r.a) for r in language.add_language(hard, model, "a", "b").collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (9, "und")} <= found and (5, "und") not in found
    assert language.identify(documents.limit(0)).count() == 0


def brute_pii(text):
    kinds = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")

    def good(k, m):
        digits = re.sub("[^0-9]", "", m)
        return (True, all(int(p) <= 255 for p in m.split(".")) if k == 1 else True, 14 <= len(digits) <= 19 and pii.luhn(digits), 10 <= len(digits) <= 15)[k]

    return sorted((m.start(), k, m.end()) for k, p in enumerate(kinds) for m in re.finditer(p, text) if good(k, m[0]))


def test_pii_base_spans():
    rng = np.random.default_rng(4)
    parts = ["a", "b.c", "@", "x@y.z", "1.2.3.4", "256", ".", "4111 1111 1111 1111", "+1 (234) 567-8901", " ", "-", "é", "0", "99", "@@", "+", "(", "\n", "a@b.c@d.e"]
    for _ in range(4000):
        text = "".join(rng.choice(parts, rng.integers(0, 14)))
        assert pii.base_spans(text) == brute_pii(text), text


def test_pii_bootstrap_and_redaction(spark, hard):
    seeds = [(i, f"please call office phone +1 (234) 567-89{i:02d} today or later") for i in range(30)]
    new = [(100, "please call office phone 234 567 8901 today ok"), (101, "the number 234 567 8901 is not in such a place"), (102, None)]
    rows = spark.createDataFrame(seeds + new, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find(rows).collect()}
    assert got[3].n_phone == 1 and got[3].spans == "phone:25:42"
    assert (got[100].n_phone, got[100].n_added, got[100].spans) == (0, 1, "phone:25:37")
    assert got[101].n_added == 0 and got[102].spans == "" and got[102].base_sha256 == hashlib.sha256(b"").hexdigest()
    clean = {r.doc_id: r.text for r in pii.redact(rows).collect()}
    assert clean[100] == "please call office phone [PHONE] today ok" and clean[102] is None
    assert clean[3] == "please call office phone [PHONE] today or later"
    assert Counter(r.doc_id for r in pii.find(hard).collect()) == Counter(i for i, _ in HARD)
    assert pii.redact(hard).schema == hard.schema and pii.redact(hard).count() == len(HARD)
    assert pii.find(rows.limit(0)).count() == 0


def test_near_duplicates(spark, hard):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(3000)]
    texts, truth = [], []
    for g in range(12):
        base = rng.choice(words, 200).tolist()
        texts.append(" ".join(base))
        truth.append(g)
        for _ in range(6):
            copy = list(base)
            copy[int(rng.integers(0, 200))] = "edited"
            texts.append(" ".join(copy))
            truth.append(g)
        texts.append(" ".join(base))
        truth.append(g)
    passage = " ".join(rng.choice(words, 60))
    for k in range(30):  # a shared passage is no near copy
        texts.append(passage + " " + " ".join(rng.choice(words, 120)))
        truth.append(100 + k)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dups.classes(rows).collect()}
    first = {}
    for i, g in enumerate(truth):
        first.setdefault(g, i)
    assert all(got[i] == first[g] for i, g in enumerate(truth))
    assert {r.doc_id for r in near_dups.one_of_each(rows).collect()} == set(first.values())
    odd = near_dups.classes(hard).collect()
    assert {(r.doc_id, r.class_id) for r in odd if r.doc_id in (1, 2, 3)} == {(1, 1), (2, 2), (3, 3)} and len(odd) == len(HARD)
    assert near_dups.one_of_each(hard).columns == hard.columns
    assert near_dups.classes(rows.limit(0)).count() == 0


def test_near_duplicates_of_a_group_without_a_hub(spark):
    """Edited copies whose original is not in the table: few pairs are links, and most texts are unlike any leader."""
    rng = np.random.default_rng(8)
    base, texts = [f"w{i}" for i in rng.integers(0, 3000, 400)], []
    for k in range(300):
        copy = list(base)
        for n, at in enumerate(rng.choice(400, 6, replace=False)):
            copy[at] = f"edit{k}x{n}"
        texts.append(" ".join(copy))
    s = [near_dups.shingles(t).astype(np.uint32) for t in texts]
    label = list(range(len(s)))
    for i in range(len(s)):
        for j in range(i):
            if label[i] != label[j] and near_dups.similarity(s[i], s[j]):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in near_dups.classes(rows).collect()} == dict(enumerate(label))


def test_alignment_against_brute_force():
    rng = np.random.default_rng(6)
    for _ in range(300):
        a, b = (rng.integers(0, 6, rng.integers(1, 25)).tolist() for _ in range(2))
        table = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        assert near_dups.aligned(a, b, 60) == table[-1, -1]
        m = table[-1, -1]
        s = near_dups.similarity(np.array(a, np.uint32), np.array(b, np.uint32), 0.3)
        want = m / (len(a) + len(b) - m)
        assert s == pytest.approx(want if want >= 0.3 else 0)


def test_nearest_neighbours(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = {}
    for r in ann.search(table).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    rows = table.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=float)
    hit = total = 0
    for i in np.flatnonzero(ids % 20 == 0):
        s = (x * x[i]).sum(1)
        s[i] = -np.inf
        true = set(ids[np.lexsort((ids, -s))[:20]].tolist())
        mine = sorted(got[ids[i]])
        assert [r for r, _, _ in mine] == list(range(1, 21)) and all(a[2] >= b[2] for a, b in zip(mine, mine[1:]))
        assert all(abs(sc - s[np.flatnonzero(ids == v)[0]]) < 1e-12 for _, v, sc in mine)
        hit, total = hit + len(true & {v for _, v, _ in mine}), total + 20
    assert hit >= 0.9 * total


def test_nearest_neighbours_hard_input(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [3.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (20, [0.0, 2.0]), (None, [1.0, 1.0]), (9, [1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.search(table, share=1.0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 2, 3.0), (0, 2, 1, 1.0), (0, 3, 20, 0.0), (20, 1, 2, 2.0), (20, 2, 0, 0.0), (20, 3, 1, 0.0)]
    assert ann.search(table.limit(0)).count() == 0


@pytest.mark.parametrize("top", [200_000, 50])
def test_language_model(spark, documents, monkeypatch, top):
    monkeypatch.setattr(lm, "TOP", top)
    rows = lm.score(documents).collect()
    texts = {r.doc_id: r.text for r in documents.collect()}
    tokens = {i: lm.words_of(t) for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    c = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    for r in rows:
        ws = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(ws), sum(w in c for w in ws), n)
        assert r.base_score == pytest.approx(sum(log10((c[w] + 1) / (n + v + 1)) for w in ws), rel=1e-9)
        assert r.score <= 0
    assert sum(r.score for r in rows if r.held_out) > sum(r.base_score for r in rows if r.held_out)


def test_language_model_learns_from_every_position(spark):
    """Words at odd places follow from the word before; those at even places are random."""
    rng = np.random.default_rng(9)
    texts = [" ".join(w for k in rng.integers(0, 8, 20) for w in (f"even{k}", f"odd{k}"))[: -len(" odd0")] for _ in range(8000)]
    rows = lm.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)).collect()
    # the even places cost log10(8) each; without the others learned, these cost about as much again
    assert sum(r.score for r in rows) / sum(r.n_tokens for r in rows) > -0.65 * log10(8)


def test_language_model_tells_rare_words_apart(spark, monkeypatch):
    """With 15 places, most words are beyond the classes; each at an odd place follows from the one before."""
    monkeypatch.setattr(lm, "DEPTH", 1)
    monkeypatch.setattr(lm, "LEAF", 16)
    rng = np.random.default_rng(10)
    texts = [" ".join(w for k in rng.integers(0, 600, 20) for w in (f"even{k}", f"odd{k}")) for _ in range(8000)]
    rows = lm.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)).collect()
    assert sum(r.score for r in rows) / sum(r.n_tokens for r in rows) > -0.9 * log10(600)


def test_language_model_has_a_distribution_over_rare_words(spark):
    vocabulary = spark.createDataFrame([(f"w{i}".encode(), 1600 - i) for i in range(1600)], "word binary, n long")
    mass = lm.leaves(vocabulary, [b"w0", b"w1"], np.array([1600, 1599]), 1600)
    want = np.ones(16)
    for i in range(2, 1600):
        want[lm.hash_of(f"w{i}".encode()) >> 60] += 1601 - i
    assert mass.tolist() == want.tolist()
    model = lm.Model([b"w0", b"w1"], np.array([1600, 1599]), 1_280_800, 1600, mass)
    model.weights += np.random.default_rng(3).normal(size=model.weights.shape).astype(np.float32)
    m, leaf = np.append([0, 1], np.full(16, 2)), np.append([0, 0], np.arange(16))
    assert np.exp(model.log_probs(m, np.full(18, 7), np.full(18, 8), leaf)).sum() == pytest.approx(1, rel=1e-4)


def test_language_model_does_not_depend_on_partitions(spark, documents):
    few = {r.doc_id: r.score for r in lm.score(documents.coalesce(1)).collect()}
    many = {r.doc_id: r.score for r in lm.score(documents.repartition(13)).collect()}
    assert few == pytest.approx(many, rel=1e-5)


def test_language_model_step_against_brute_force():
    """Scores and one gradient step, token by token over plain lists."""
    words = [f"w{i}".encode() for i in range(40)]
    model = lm.Model(words, np.arange(80, 40, -1), 3000, 60, np.full(16, 20.0))
    rng = np.random.default_rng(4)
    model.weights += rng.normal(0, 0.3, model.weights.shape).astype(np.float32)
    m, leaf = rng.integers(0, 41, 30), rng.integers(0, 16, 30)
    m1, m2 = (rng.integers(0, 1 << 60, 30).astype(np.uint64) for _ in range(2))
    before, changes, squares, want = model.weights.astype(float), {}, {}, []
    for i in range(30):
        h, total = model.features(m1[i : i + 1], m2[i : i + 1]), 0.0
        path = [(model.place_bias[k], m[i] >> (4 * (3 - k)), m[i] >> (4 * (2 - k)) & 15, k << 32) for k in range(3)]
        path += [(model.branch_bias[0], 0, leaf[i], 1 << 40)] if m[i] == 40 else []
        for bias, node, own, first in path:
            at = [int(r) for r in model.rows(h, np.array([node + first])).ravel()]
            z = bias[node].astype(float) + sum(before[r] for r in at)
            p = np.exp(z) / np.exp(z).sum()
            total += np.log(p[own])
            for f, r in enumerate(at):
                changes.setdefault((first, f, r), np.zeros(16))
                changes[first, f, r] += p - np.eye(16)[own]
        want.append(total)
    assert model.log_probs(m, m1, m2, leaf) == pytest.approx(want, rel=1e-4)
    seen = np.zeros(len(model.weights), dtype=np.float32)
    model.step(m, m1, m2, leaf, seen)
    for (_, _, r), g in changes.items():
        squares[r] = squares.get(r, 0) + (g * g).mean()
        before[r] -= g * lm.STEP / np.sqrt(squares[r] + 1e-3)
    assert np.abs(before - model.weights).max() < 1e-3


def test_language_model_computes_equal_positions_once(monkeypatch):
    """Copies of a position in a step and in scores; sums by row, also of numbers beyond 19 bits."""
    words = [f"w{i}".encode() for i in range(40)]
    model = pickle.loads(pickle.dumps(lm.Model(words, np.arange(80, 40, -1), 3000, 60, np.full(16, 20.0))))
    assert model.weights.ctypes.data % 64 == 0
    rng = np.random.default_rng(6)
    model.weights += rng.normal(0, 0.3, model.weights.shape).astype(np.float32)
    few = [rng.integers(0, 41, 20), *(rng.integers(0, 1 << 60, 20).astype(np.uint64) for _ in range(2)), rng.integers(0, 16, 20)]
    pick = rng.integers(0, 20, 500)
    sizes, forward = [], lm.Model.forward
    monkeypatch.setattr(lm.Model, "forward", lambda self, m, *rest: sizes.append(len(m)) or forward(self, m, *rest))
    single = np.array([model.log_probs(*(x[i : i + 1] for x in few))[0] for i in range(20)])
    sizes.clear()
    assert model.log_probs(*(x[pick] for x in few)) == pytest.approx(single[pick], rel=1e-5)
    model.step(*(x[pick] for x in few), np.zeros(len(model.weights), dtype=np.float32))
    assert sizes == [len(set(pick.tolist()))] * 2
    for top in (1 << 16, 1 << 30):
        r, p = rng.integers(top - 50, top, 300).astype(np.uint16 if top == 1 << 16 else np.uint32), rng.normal(size=(300, lm.WIDTH)).astype(np.float32)
        at, g = lm.summed(r, p)
        assert at.tolist() == sorted(set(r.tolist()))
        assert np.abs(g - [p[r == x].sum(0) for x in at]).max() < 1e-5


def test_language_model_is_a_distribution_and_takes_hard_input(spark, hard):
    model = lm.Model([b"a", b"b", lm.END], np.array([5, 3, 2]), 12, 5)
    p = np.exp([model.log_probs(np.array([m]), np.array([0]), np.array([1]))[0] for m in range(model.size + 1)])
    assert p.sum() == pytest.approx(1, rel=1e-4)
    assert Counter(r.doc_id for r in lm.score(hard).collect()) == Counter(i for i, _ in HARD)
    assert lm.score(hard.limit(0)).count() == 0
    assert [r.score for r in lm.score(hard.where("doc_id = 8")).collect()] != [None]


def test_pipeline_stages(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, texts = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    for name, stage in pipeline.STAGES[:-1]:
        before = docs.count()
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        assert docs.columns == columns and 0 < docs.count() <= before
    kept = {r.doc_id: r.text for r in docs.collect()}
    assert all(len(texts[i].split()) >= 50 for i in kept)
    assert not any(pii.base_spans(t) for t in kept.values())
    assert len({texts[i] for i in kept}) == len(kept)
    packed = pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.collect()} == set(kept)


def test_long_white_space_is_encoded_as_the_library_does(spark):
    texts = [" " * 1_000_000 + "x", "a" + "\n" * 200_000 + " y <|endoftext|>", " \t" * 60_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {i: len(library(BYTES).encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(rows, BYTES).collect()} == want
    assert sum(r.length for r in packing.pack_documents(rows, BYTES).collect()) == sum(want.values()) + len(texts)


def test_word_bpe_of_characters_newer_than_this_python():
    held, e = library(WORDS), wordbpe.load(WORDS)
    for c in (0x88F, 0xC5C, 0x1C89, 0x18E00, 0x2EBF0, 0xA7CB, 0x10D50):
        text = f"a{chr(c)}b {chr(c)}1 x!{chr(c)}"
        assert np.frombuffer(e.encode(text)[0], "<u4").tolist() == held.encode(text, add_special_tokens=False).ids


def test_empty_tables(spark, hard):
    empty = hard.limit(0)
    assert quality.apply_policy(quality.ledger(quality.measure(empty)), quality.POLICIES[2]).count() == 0
    assert token_counts.count_tokens(empty, BYTES).count() == 0
    assert wordbpe.encode_decode(empty, WORDS).count() == 0


def test_quality_keeps_columns_of_any_name(spark):
    rows = spark.createDataFrame([(1, "a b", 5, 6)], "doc_id long, text string, t_ int, h_ int")
    assert quality.measure(rows, keep=("doc_id", "t_", "h_")).select("t_", "h_", "n_words").collect() == [(5, 6, 2)]


def test_pipeline_stages_take_hard_input_and_empty_tables(spark, hard):
    pipeline = pytest.importorskip("corpus_pipeline")
    for name, stage in pipeline.STAGES:
        stage(spark, hard, SF).collect()
        assert stage(spark, hard.limit(0), SF).count() == 0, name


def test_every_language_is_learned_and_any_partitioning_learns_alike(spark):
    made = {"en": "the house and the garden", "xx": "zuq zuq wex wex", "de": "das haus und der garten"}
    rows = [(i, f"{made[c]} {i}", c) for i, c in enumerate(["en"] * 400 + ["de"] * 400 + ["xx"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    if zlib.crc32(b"800") % 5 == 0:
        docs = docs.withColumn("doc_id", F.col("doc_id") + 1)
    one, many = language.learn(docs.coalesce(1)), language.learn(docs.repartition(7))
    assert one.langs == ["de", "en", "xx"]
    assert np.array_equal(one.family_w, many.family_w)


def test_language_sample_stays_out_of_the_driver(spark):
    """The driver's Python holds weights only; these are as if all machines were fitted at one place."""
    made = {"en": "the house and the garden", "nl": "het huis en de tuin", "de": "das haus und der garten", "fr": "la maison et le jardin"}
    rows = [(i, f"{made[c]} {'abcdefgh'[i % 8]}{'klmnopq'[i % 7]}", c) for i, c in enumerate(sorted(made) * 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    tracemalloc.start()
    model = language.learn(docs)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 10e6
    learned = [(text, lang) for i, text, lang in rows if zlib.crc32(str(i).encode()) % 5]  # fewer than a sample
    x, y = np.array([language.vector_of(language.counts_of(text)) for text, _ in learned]), np.array([lang for _, lang in learned])
    assert model.families == ["germanic", "romance"] and model.pairs["germanic"] == [("de", "en"), ("de", "nl"), ("en", "nl")] and not model.pairs["romance"]
    alone = language.fit_svm(x, np.where(y == "fr", -1, 1).astype(np.float32))
    assert np.allclose(model.family_w, [alone, -alone], atol=1e-4)
    for (a, b), w in zip(model.pairs["germanic"], model.pair_w["germanic"]):
        m = np.isin(y, [a, b])
        assert np.allclose(w, language.fit_svm(x[m], np.where(y[m] == a, 1, -1).astype(np.float32)), atol=1e-4)


def test_discovered_secrets(spark):
    seeds = [(i, f'here is token = "{hashlib.sha1(str(i).encode()).hexdigest()}" for you') for i in range(8)]
    rows = spark.createDataFrame([*seeds, (100, 'here is token = "ab12cd34ef56ab12" for you'), (101, "commit ab12cd34ef56ab12 is fine")], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find(rows).collect()}
    assert got[0].secret_spans == "secret:17:57" and got[100].secret_spans == "secret:17:33" and got[101].n_added == 0
    assert got[0].spans == got[100].spans == ""  # the contract's kinds alone
    assert got[0].base_sha256 == hashlib.sha256(b"").hexdigest() and got[0].n_spans == 1


@pytest.mark.parametrize("unseen", [30, 60])
def test_ordinary_numbers_beside_a_few_phones_are_left_alone(spark, unseen):
    """Five phones and many order numbers after the same words: nothing vouches for the numbers but their own pattern."""
    rows = [(k, f"see the order ref +1 (234) 567-89{k:02d} for it") for k in range(5)]
    rows += [(100 + k, f"see the order ref {4_000_000_000 + 7919 * k} for it") for k in range(unseen)]
    rows += [(300 + k, f"see the order ref {40_000_000 + 7919 * k} for it") for k in range(unseen)]
    got = pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(r.n_added for r in got) == 0 and sum(r.n_phone for r in got) == 5


def planted_identifiers(ratio):
    """Seeds of each kind and ``ratio`` unseen ones in another form in contexts of their kind, among distractors in others and in the same ones."""
    rng = np.random.default_rng(ratio)
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))

    def card(mark):
        while not pii.luhn(x := "4" + digits(15)):
            pass
        return mark.join(x[k : k + 4] for k in range(0, 16, 4))

    quad = lambda mark: mark.join(str(x) for x in rng.integers(1, 255, 4))
    kinds = {
        "email": (("mail me at", "or else", "write to box"), lambda: f"u{digits(5)}@example.org", lambda: f"u{digits(5)}@mailhost"),
        "ip": (("logged in from", "at night", "host at address"), lambda: quad("."), lambda: quad("-")),
        "card": (("paid by card", "in full", "the card number"), lambda: card(" "), lambda: card(".")),
        "phone": (("call us on", "any time", "ring this phone"), lambda: f"+1 234 {digits(3)} {digits(4)}", lambda: f"({digits(3)}) {digits(3)}-{digits(4)}"),
    }
    rows, truth = [], set()
    for kind, ((before, after, other), seed, unseen) in kinds.items():
        for frame in (f"{before} {{}} {after}", f"{other} {{}} please"):
            for _ in range(12):
                rows.append(frame.format(seed()))
            for _ in range(12 * ratio):
                truth.add((len(rows), kind))
                rows.append(frame.format(unseen()))
            rows.append(frame.format("9" * 7))  # can't be of the kind
    for k in range(200):
        rows.append(f"item {digits(10)} was sent on day {k}; key {digits(6)}ab{digits(6)} and {quad('-')} and u{digits(4)}@somewhere in list {k}")
    return list(enumerate(rows)), truth


@pytest.mark.parametrize("ratio", [1, 3])
def test_planted_identifiers_are_discovered(spark, ratio):
    rows, truth = planted_identifiers(ratio)
    found = set()
    for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect():
        counts = Counter(x.split(":")[0] for x in r.spans.split(",") if x)
        found |= {(r.doc_id, k) for k, n in counts.items() if n > {"email": r.n_email, "ip": r.n_ip, "card": r.n_card, "phone": r.n_phone}[k]}
    right = len(found & truth)
    assert right / len(found) >= 0.95 and right / len(truth) >= 0.95, (right, len(found), len(truth))


def test_a_second_context_is_evidence(spark):
    """Strings that known patterns hold elsewhere raise a pattern that seeds alone don't carry."""
    phone = lambda k: f"(555) 010-{k:04d}"
    rows = [(k, f"call us on +1 (234) 567-89{k:02d} any time") for k in range(20)] + [(100 + k, f"call us on {phone(k)} any time") for k in range(40)]
    rows += [(200 + k, f"ask for desk +1 (234) 567-77{k:02d} over there") for k in range(5)] + [(300 + k, f"ask for desk {phone(k)} over there") for k in range(40)]
    extra = [(400, f"ask for desk {phone(900)} over there")]
    find = lambda r: {x.doc_id: x.n_added for x in pii.find(spark.createDataFrame(r, "doc_id long, text string")).collect()}
    assert find(rows + extra)[400] == 1
    assert find(rows[60:] + extra)[400] == 0


def test_many_numbers_in_a_text_take_linear_time():
    import time

    text = " ".join(f"{k:09d}" for k in range(60_000))
    began = time.time()
    assert len(pii.candidates(text, pii.base_spans(text))) > 10_000
    assert time.time() - began < 10


def test_held_out_labels_of_urls(spark):
    """Pages whose label is hidden: what the tree rejects is blocked."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    host, path = url_filter.parts(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    _, label = url_filter.longest_rule(F.col("host"), F.col("path"))
    segments = [f"s{k}" for k in range(url_filter.LEVELS)]
    typed = split.select("*", label.alias("truth"), F.when(F.crc32(F.col("page_id").cast("string")) % 5 != 0, label).alias("label"), *(c.alias(n) for c, n in zip(url_filter.typed_segments(F.col("path")), segments)))
    asked = typed.where("truth IS NOT NULL AND label IS NULL").join(url_filter.template_tree(typed), ["host", *segments])
    rejected = [r.truth for r in asked.where(F.col("template_share") >= url_filter.REJECT).collect()]
    assert len(rejected) >= 10 and set(rejected) == {"block"}


def test_only_visited_cells_are_multiplied(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 8))
    block = ann.Block(np.arange(300), np.arange(300), x, rng.integers(0, 10, 300))
    cells = [[1, 2], [2, 99], []]
    found = block.nearest(np.array([0, 500, 501]), x[:3], cells, 5)
    sizes = {c: b - a for c, (a, b) in block.span.items()}
    assert block.products == sizes[1] + 2 * sizes[2] and len(found[2][0]) == 0
    # repeated ids are several rows, each a neighbour of the others
    rows = spark.createDataFrame([(20, [1.0, 0.0]), (20, [0.9, 0.1]), (3, [0.5, 0.5]), (4, None), (5, [0.0, 0.0]), (6, [1.0, None]), (7, [1.0, float("nan")])], "vec_id long, embedding array<double>")
    got = sorted((round(r.score, 6), r.vec_id) for r in ann.search(rows).collect() if r.query_id == 20)
    assert got == [(0.5, 3), (0.5, 3), (0.9, 20), (0.9, 20)]


def classes_by_brute_force(texts):
    s = [near_dups.shingles(t).astype(np.uint32) for t in texts]
    label = list(range(len(s)))
    for i in range(len(s)):
        for j in range(i):
            if label[i] != label[j] and near_dups.similarity(s[i], s[j]):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return dict(enumerate(label))


@pytest.mark.parametrize("shared,edits", [(330, 2), (340, 3), (350, 4)])
def test_near_duplicate_pairs_inside_a_boilerplate_group(spark, shared, edits):
    """Pairs a little above 0.8 among texts that all share most of their words, just below 0.8 with any other."""
    rng = np.random.default_rng(shared)
    boiler, texts = [f"b{i}" for i in range(shared)], []
    for k in range(80):
        own = [f"o{k}x{i}" for i in range(400 - shared)]
        for twin in range(2):
            words = boiler + own
            for at in rng.choice(len(words), edits, replace=False):
                words[at] = f"e{k}x{twin}x{at}"
            texts.append(" ".join(words))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = classes_by_brute_force(texts)
    got = {r.doc_id: r.class_id for r in near_dups.classes(rows).collect()}
    assert got == want


def test_texts_that_share_an_id_and_ids_of_text(spark):
    rows = spark.createDataFrame([("a", PROSE), ("a", PROSE[::-1] + " another text altogether with other words"), ("b", PROSE), (None, PROSE), ("c", None), ("c", None)], "doc_id string, text string")
    assert Counter((r.doc_id, r.class_id) for r in near_dups.classes(rows).collect()) == Counter([("a", "a"), ("a", "a"), ("b", "a"), (None, "a"), ("c", "c"), ("c", "c")])
    assert Counter((r.doc_id, (r.text or "")[:3]) for r in near_dups.one_of_each(rows).collect()) == Counter([("a", "the"), ("a", PROSE[::-1][:3]), ("c", "")])
