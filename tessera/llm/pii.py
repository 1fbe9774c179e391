"""Personal data in whole texts (operator 4).

Fixed patterns find e-mail addresses, IP addresses, payment cards and phone
numbers. Together with secrets that their form alone gives away (SECRET) they
seed a bootstrap. Each identifier-like string of a text stands in lexical
patterns: the words beside it (two to the left and one to the right, two to the
left, or one on each side) with the marks that touch it, and without its own
form, so that a pattern can meet strings that no seed looks like. Spark scores
the graph of patterns and instances iteratively:

* A pattern's confidence is the share of its different instances that are known
  for its kind, smoothed. Seeds of the kind count one. Seeds of other kinds,
  strings that the fixed patterns tried and refused (a card number with a wrong
  check digit), and strings that can't be of the kind (its digits) count against
  it. Any other string counts as far as it is trusted.
* A string is trusted by its *other* contexts only: no pattern vouches for a string
  that vouches for the pattern, so strings that stand nowhere else don't count
  for it, however many they are. A context (all patterns of one place) has one
  vote, that of its best pattern; equal passages of many documents are one context.

Confidences start at the seeds' shares and only rise, so the rounds converge;
they end when none moves by STILL. Strings in patterns of at least CONFIDENT that SUPPORT different
seeds hold up are new identifiers of the pattern's kind, if they can be of it.

Only counted edges are shuffled, never texts. The rounds are cut by written tables.

Limits of what is a candidate, from the formats: numbers of up to 42 characters
(19 digits with marks between them), accounts of 64 and 255 characters around
the "@". Context words are looked for within REACH characters and count with
WORD of their letters.

Defined results: a null text is empty and has no spans; every input row gives
one row (repeated rows too); an empty table gives an empty result; other
columns are kept out by ``find`` and left alone by ``redact``. Spans are code
points, end exclusive; a new span never overlaps another.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .base import fresh, keep, map_batches, release, tune

#: Kinds, in the order that breaks ties; the fixed patterns have the first four, secrets come from the bootstrap alone.
KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS, SECRET_KIND = 4, 4
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
#: A run of digits can only start where the last one ended, so no start inside one is tried.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
#: Identifier-like strings: at least 7 digits with the usual marks between them, something around an "@", or a long run of letters and digits with both.
NUMBER = re.compile(r"(?<![\w+])[(]?[0-9][0-9().\x20-]{5,40}[0-9](?!\w)")
GROUPS = re.compile(r"(?<![\w.])[0-9]{1,3}([-:,_/\x20]|\x20?\.\x20?)[0-9]{1,3}\1[0-9]{1,3}\1[0-9]{1,3}(?![\w.])")
ACCOUNT = re.compile(r"(?<!\S)[^\s@]{1,64}@[^\s@]{1,255}(?!\S)")
KEY = re.compile(r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{12,}+")
#: Secrets by their form alone (fixed values of public formats): long hexadecimal strings and providers' prefixes.
SECRET = re.compile(r"[0-9a-f]{40}|[0-9a-f]{64}|sk-[A-Za-z0-9]{20,}|sk_live_[A-Za-z0-9]{16,}|gh[pousr]_[A-Za-z0-9]{36}|AKIA[0-9A-Z]{16}")
HEX = re.compile(r"[0-9a-f]{12,}|[0-9A-F]{12,}")
#: Marks that may open right before a string; they belong to the pattern as they are.
OPENERS = "\"'`([{<=:"
#: Characters on either side that are looked at for context words, and the longest part of one that counts.
REACH, WORD = 64, 24
#: The change that ends the rounds; smoothing; what a pattern needs: confidence (a quarter of its instances, up to the smoothing), and different seed instances.
STILL, SMOOTH, CONFIDENT, SUPPORT = 1e-3, 1.0, 0.23, 5


def luhn(digits: str) -> bool:
    """The check sum of card numbers."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if k % 2 == 0 else (2 * n if n < 5 else 2 * n - 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns, leftmost and not overlapping within a kind; sorted."""
    found, at, free = [], text.find("@"), 0
    while at != -1:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, 0, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
                found.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        for m in PHONE.finditer(text):
            if 10 <= sum(map(str.isdigit, m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def possible(text: str) -> int:
    """The kinds that a string can be of, as bits."""
    digits = re.sub("[^0-9]", "", text)
    groups = [int(x) for x in re.findall("[0-9]+", text) if len(x) <= 3]
    plain = not re.search("[A-Za-z@]", text)
    return (
        ("@" in text) << 0
        | (plain and len(groups) == 4 and len(re.findall("[0-9]+", text)) == 4 and max(groups) <= 255) << 1
        | (plain and 14 <= len(digits) <= 19 and luhn(digits)) << 2
        | (plain and 9 <= len(digits) <= 15) << 3
        | bool(HEX.fullmatch(text) and not text.isdigit() or SECRET.fullmatch(text)) << 4
    )


def contexts(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns around a span, most special first; words in lower case, digits as 0. Without a word to the left there are none."""
    plain = lambda part: re.sub("[0-9]+", "0", part.lower())
    before, after = text[max(0, start - REACH) : start], text[end : end + REACH]
    bare = before.rstrip(OPENERS)
    touch, words = before[len(bare) :], bare.split()
    if bare and not bare[-1].isspace():
        touch = f"+{touch}"
    left, right = [plain(x[-WORD:]) for x in words[-2:]], [plain(x[:WORD]) for x in after.split()[:1]]
    follow = "" if not after or after[0].isspace() else "+"
    if not left:
        return []
    found = [" ".join([*left, f"{touch}<>{follow}", *right])]
    if len(left) == 2:
        found.append(" ".join([*left, f"{touch}<>"]))
    if right:
        found.append(" ".join([left[-1], f"{touch}<>{follow}", *right]))
    return list(dict.fromkeys(found))


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Identifier-like strings that overlap no span and not each other; one pass over both sorted lists."""
    numbers = [m.span() for m in NUMBER.finditer(text) if sum(map(str.isdigit, m[0])) >= 7] if DIGIT.search(text) else []
    groups = [m.span() for m in GROUPS.finditer(text)] if numbers or DIGIT.search(text) else []
    accounts = [m.span() for m in ACCOUNT.finditer(text)] if "@" in text else []
    keys = [m.span() for m in KEY.finditer(text)] if numbers or DIGIT.search(text) else []
    found: list[tuple[int, int]] = []
    for more in (groups, numbers, accounts, keys):
        sure = sorted([*((s, e) for s, _, e in taken), *found])
        free, k, reach = [], 0, 0
        for s, e in more:
            while k < len(sure) and sure[k][0] < e:
                reach = max(reach, sure[k][1])
                k += 1
            if reach <= s:
                free.append((s, e))
        found += free
    return sorted(found)


def refused(instance: str) -> bool:
    """Whether the fixed patterns judge strings of this form as cards, so that one without a span failed their test; other forms are told by :func:`possible`."""
    digits = re.sub("[ -]", "", instance)
    return digits.isdigit() and 14 <= len(digits) <= 19


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, base spans and context edges of every row; written, as it is read several times.

    An edge's kind is that of a seed, -1 for an unknown string, -2 for a refused one.
    """
    tune(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    hashed = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")
    span, edge = pa.struct([("s", pa.int32()), ("k", pa.int32()), ("e", pa.int32())]), pa.struct([("s", pa.int32()), ("e", pa.int32()), ("kind", pa.int32()), ("may", pa.int32()), ("patterns", pa.list_(pa.string())), ("instance", pa.string())])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans, edges = [], []
        for text in batch.column(2).to_pylist():
            text = text or ""
            base = base_spans(text)
            spans.append([{"s": s, "k": k, "e": e} for s, k, e in base])
            rows = [(s, e, k) for s, k, e in base]
            for s, e in candidates(text, base):
                rows.append((s, e, SECRET_KIND if SECRET.fullmatch(text, s, e) else -2 if refused(text[s:e]) else -1))
            near = ((s, e, k, contexts(text, s, e), text[s:e]) for s, e, k in rows)
            edges.append([{"s": s, "e": e, "kind": k, "may": possible(i) if k == -1 else 0, "patterns": p, "instance": i} for s, e, k, p, i in near if p])
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, type=pa.list_(span)), pa.array(edges, type=pa.list_(edge))], names=["doc_id", "text_hash", "spans", "edges"])

    ddl = f"doc_id {id_type}, text_hash long, spans array<struct<s:int,k:int,e:int>>, edges array<struct<s:int,e:int,kind:int,may:int,patterns:array<string>,instance:string>>"
    return keep(map_batches(hashed, work, ddl), "pii-scan")


def pattern_edges(scanned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pattern, kind, support, known, instances) of patterns that enough seeds support, and the edges of the strings that must be judged and stand in several contexts; both written."""
    places = scanned.select(F.explode("edges").alias("x")).select("x.instance", "x.kind", "x.may", F.col("x.patterns").alias("patterns"), F.xxhash64("x.patterns").alias("context"))
    places = places.groupBy("instance", "context").agg(F.max("kind").alias("own"), F.max("may").alias("may"), F.first("patterns").alias("patterns"))
    edges = places.select(F.explode("patterns").alias("pattern"), "instance", "context", "own", "may")
    once = edges.groupBy("pattern", "instance").agg(F.max("own").alias("own"))
    # a pattern that too few different seeds support can never be trusted: it and its edges are out from the start
    seeds = once.where(F.col("own") >= 0).groupBy("pattern", "own").count()
    best = seeds.groupBy("pattern").agg(F.max_by("own", F.struct("count", -F.col("own"))).alias("kind"), F.max("count").alias("support")).where(F.col("support") >= SUPPORT)
    sizes = once.groupBy("pattern").agg(F.count(F.lit(1)).alias("instances"))
    best = keep(best.join(sizes, "pattern").withColumn("known", F.col("support").cast("double")), "pii-support")
    open_ = edges.where((F.col("own") == -1) & (F.col("may") > 0)).join(best.select("pattern", "kind"), "pattern").where(F.getbit("may", F.col("kind")) == 1)
    several = open_.groupBy("instance", "kind").agg(F.min("context").alias("low"), F.max("context").alias("high")).where("low < high").select("instance", "kind")
    return best, keep(open_.join(several, ["instance", "kind"], "left_semi").select("pattern", "kind", "instance", "context"), "pii-edges")


def trusted_patterns(scanned: DataFrame) -> DataFrame:
    """pattern, kind, support and confidence of the patterns that discover identifiers; written."""
    best, edges = pattern_edges(scanned)
    share = lambda known: known / (F.col("instances") + F.lit(SMOOTH))
    patterns = keep(best.withColumn("confidence", share(F.col("known"))), "pii-patterns")
    while not edges.isEmpty():
        # a context's vote is that of its best pattern; a string's trust in a context comes from its other contexts
        votes = edges.join(patterns.select("pattern", "confidence"), "pattern").groupBy("instance", "kind", "context").agg(F.log1p(-F.least(F.max("confidence"), F.lit(0.999))).alias("doubt"))
        whole = votes.groupBy("instance", "kind").agg(F.sum("doubt").alias("all_"))
        trust = votes.join(whole, ["instance", "kind"]).select("instance", "kind", "context", (1 - F.exp(F.col("all_") - F.col("doubt"))).alias("trust"))
        added = edges.join(trust, ["instance", "kind", "context"]).groupBy("pattern", "instance").agg(F.max("trust").alias("trust")).groupBy("pattern").agg(F.sum("trust").alias("more"))
        new = keep(patterns.join(added, "pattern", "left").select("pattern", "kind", "support", "instances", "known", F.col("confidence").alias("was"), F.greatest("confidence", share(F.col("known") + F.coalesce("more", F.lit(0.0)))).alias("confidence")), "pii-patterns")
        moved = new.agg(F.max(F.col("confidence") - F.col("was"))).first()[0]
        release(patterns)
        patterns = new
        if moved is None or moved < STILL:
            break
    trusted = keep(patterns.where(F.col("confidence") >= CONFIDENT).select("pattern", "kind", "support", "confidence"), "pii-trusted")
    release(best, edges, patterns)
    return trusted


def discovered(scanned: DataFrame) -> DataFrame:
    """doc_id, text_hash and the new spans of the documents that have any.

    The kind of a string is that of its most confident trusted pattern.
    """
    asked = scanned.select("doc_id", "text_hash", F.explode("edges").alias("x")).where((F.col("x.kind") == -1) & (F.col("x.may") > 0) | (F.col("x.kind") == SECRET_KIND))
    flat = asked.select("doc_id", "text_hash", "x.s", "x.e", F.when(F.col("x.kind") == SECRET_KIND, 1 << SECRET_KIND).otherwise(F.col("x.may")).alias("may"), F.explode("x.patterns").alias("pattern"))
    named = flat.join(trusted_patterns(scanned), "pattern").where(F.getbit("may", F.col("kind")) == 1)
    span = named.groupBy("doc_id", "text_hash", "s", "e").agg(F.max_by("kind", F.struct("confidence", -F.col("kind"))).alias("k"))
    return span.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("s", "k", "e")).alias("added"))


def spelled(spans: Column) -> Column:
    """kind:start:end, comma-joined, by start and then kind."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256, spans, secret_spans, n_spans (all of them) and n_added of every row; ``spans`` has the four kinds of the fixed patterns."""
    scanned = scan(docs)
    added = discovered(scanned).withColumnsRenamed({"doc_id": "id_", "text_hash": "hash_"})
    both = scanned.drop("edges").join(added, scanned["doc_id"].eqNullSafe(added["id_"]) & (scanned["text_hash"] == added["hash_"]), "left")
    none = F.array().cast("array<struct<s:int,k:int,e:int>>")
    count = lambda n: F.size(F.filter("spans", lambda x: x["k"] == n)).cast("long")
    more = F.coalesce("added", none)
    found = both.select("doc_id", *(count(n).alias(f"n_{k}") for n, k in enumerate(KINDS[:BASE_KINDS])), F.sha2(spelled(F.col("spans")), 256).alias("base_sha256"), spelled(F.filter(F.concat("spans", more), lambda x: x["k"] < BASE_KINDS)).alias("all_"), spelled(F.filter(more, lambda x: x["k"] >= BASE_KINDS)).alias("secret_spans"), (F.size("spans") + F.size(more)).cast("long").alias("n_spans"), F.size(more).cast("long").alias("n_added"))
    return found.withColumnRenamed("all_", "spans")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets; all columns and rows stay."""
    scanned = scan(docs)
    id_, hash_, key, extra = (fresh(x, docs.columns) for x in ("pii_id", "pii_hash", "pii_key", "pii_added"))
    added = keep(discovered(scanned), "pii-added").withColumnsRenamed({"doc_id": id_, "text_hash": hash_, "added": extra})
    keyed = docs.withColumn(key, F.xxhash64(F.coalesce("text", F.lit(""))))
    joined = keyed.join(added, keyed["doc_id"].eqNullSafe(added[id_]) & (keyed[key] == added[hash_]), "left").select(*docs.columns, extra)
    place, last = docs.columns.index("text"), len(docs.columns)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text, more in zip(batch.column(place).to_pylist(), batch.column(last).to_pylist()):
            if text:
                parts, at = [], 0
                for s, k, e in sorted([*base_spans(text), *((x["s"], x["k"], x["e"]) for x in more or ())]):
                    if e <= at:
                        continue
                    parts += [text[at : max(at, s)], f"[{KINDS[k].upper()}]" if s >= at else ""]
                    at = e
                text = "".join([*parts, text[at:]])
            out.append(text)
        columns = list(batch.columns)[:last]
        columns[place] = pa.array(out, type=columns[place].type)
        return pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:last])

    return map_batches(joined, work, StructType([*docs.schema.fields]))
