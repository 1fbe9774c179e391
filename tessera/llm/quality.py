"""Quality rules with a bitmask ledger (operator 2, DataFrame functions only).

Every rule is evaluated once. The ledger of a document holds its measurements
and ``failed_bits``, in which bit k is set if rule k failed. A policy is a
version number and the mask of the rules that reject; applying another policy,
or asking what a rule does (:func:`ablation`), needs only the ledger and
bitwise functions, never the texts again.

The work on a text stays within its row: words are hashed, the hashes of all
3-word windows are sorted with their positions in the low bits, and equal
neighbours are compared again by their words' own hashes. So nothing is
shuffled and a hot source or a long text costs what its length costs.

Defined results: null texts have no words, so they fail the rule on few words;
every input row gives one row; an empty table gives an empty result; other
columns are kept out by ``measure`` and may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Java's character class of the six ASCII white-space characters.
BLANK = r"[ \t-\r]"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """A rule fails where ``fails`` (SQL over the measurements) is true; its bit never changes."""

    bit: int
    name: str
    fails: str


#: Bits are never used again for another rule. Integer arithmetic keeps verdicts alike in every engine.
RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "repeated_lines", "2 * n_dup_lines > n_lines"),
    Rule(4, "short_words", "word_chars < 2 * n_words"),
    Rule(5, "long_words", "word_chars > 25 * n_words"),
)
BASE_MASK = 0b11


@dataclass(frozen=True)
class Policy:
    """A version of the verdict: the rules (mask) of which none may fail."""

    version: int
    mask: int


#: Version 1 asks for the two base rules only, version 2 for all.
POLICIES = {1: Policy(1, BASE_MASK), 2: Policy(2, 0b111111)}


def measure(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, the measurements, and n_lines (lines that hold a word)."""
    has_word = lambda line: line.rlike(r"[^ \t-\r]")
    kept = ["row_"]  # one struct, so that no kept column can clash with the names below
    text = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row_"), F.coalesce(F.col("text"), F.lit("")).alias("t_"))
    split = text.select(
        *kept,
        F.array_remove(F.split("t_", f"{BLANK}+"), "").alias("w_"),
        F.split("t_", "\n").alias("l_"),
        (F.length("t_") - F.length(F.regexp_replace("t_", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
    )
    hashed = split.select(
        *kept,
        "n_symbols",
        F.size("w_").alias("n_"),
        F.length(F.concat_ws("", "w_")).cast("long").alias("word_chars"),
        F.size(F.filter("l_", has_word)).cast("long").alias("n_lines"),
        F.size(F.filter(F.array_distinct("l_"), has_word)).cast("long").alias("d_"),
        F.transform("w_", lambda w: F.xxhash64(w)).alias("h_"),
        # the bits that hold a position; the rest of a key is the window's hash
        F.expr("shiftleft(1L, length(bin(size(w_)))) - 1").alias("m_"),
    )
    at = lambda a, i: F.get(F.col(a), i)
    keyed = hashed.select(
        *kept, "n_symbols", "n_", "word_chars", "n_lines", "d_", "h_", "m_",
        F.when(
            F.col("n_") >= 4,
            F.sort_array(F.transform(F.sequence(F.lit(0), F.col("n_") - 3), lambda i: F.xxhash64(at("h_", i), at("h_", i + 1), at("h_", i + 2)).bitwiseAND(F.bitwise_not("m_")).bitwiseOR(i.cast("long")))),
        ).alias("k_"),
    )

    def same(key: Column, other: Column) -> Column:
        p, q = (x.bitwiseAND(F.col("m_")).cast("int") for x in (key, other))
        return (key.bitwiseXOR(other).bitwiseAND(F.bitwise_not("m_")) == 0) & (at("h_", p) == at("h_", q)) & (at("h_", p + 1) == at("h_", q + 1)) & (at("h_", p + 2) == at("h_", q + 2))

    twice = keyed.select(
        *kept, "n_symbols", "n_", "word_chars", "n_lines", "d_",
        F.sort_array(F.transform(F.filter("k_", lambda k, j: (F.when(j > 0, same(k, at("k_", j - 1))).otherwise(False)) | (F.when(j < F.size("k_") - 1, same(k, at("k_", j + 1))).otherwise(False))), lambda k: k.bitwiseAND(F.col("m_")))).alias("p_"),
    )
    covered = F.aggregate(F.transform("p_", lambda p, j: F.least(F.lit(3).cast("long"), F.coalesce(at("p_", j + 1), p + 3) - p)), F.lit(0).cast("long"), lambda a, x: a + x)
    found = twice.select(
        *kept,
        F.col("n_").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.col("n_lines") - F.col("d_")).alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"),
        "n_lines",
    )
    # a generator of one row: filters on the measurements stay above it, or Spark
    # would push them down and repeat all the nested expressions for each use
    flat = F.struct(*(F.col("row_").getField(c).alias(c) for c in keep), *found.columns[1:])
    return found.select(F.inline(F.array(flat)))


def ledger(measured: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``measured`` with failed_bits: every rule is evaluated here and nowhere else."""
    bits = F.lit(0).cast("long")
    for rule in rules:
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("long"))
    return measured.withColumn("failed_bits", bits)


def apply_policy(entries: DataFrame, policy: Policy) -> DataFrame:
    """A ledger with base_failed, kept and policy_version."""
    hit = lambda mask: F.col("failed_bits").bitwiseAND(F.lit(mask).cast("long")) != 0
    base = hit(BASE_MASK)
    return entries.withColumns({"base_failed": base, "kept": ~base & ~hit(policy.mask), "policy_version": F.lit(policy.version)})


def ablation(entries: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each rule of the policy: documents that fail it, that only it rejects, and that are kept without it.

    The ledger is counted by failed_bits first (at most 2 ** rules rows), so
    hot sources and copies add nothing.
    """
    masked = F.col("failed_bits").bitwiseAND(F.lit(policy.mask).cast("long"))
    counts = entries.groupBy(masked.alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    asked = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in rules if policy.mask >> r.bit & 1]))
    each = counts.select("bits", "n", asked.alias("r")).select("bits", "n", "r.*")
    count = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(F.lit(0))).alias
    bit, bits = F.col("bit"), F.col("bits")
    return each.groupBy("rule").agg(
        count(bits.bitwiseAND(bit) != 0)("failed"),
        count(bits == bit)("only_this"),
        count(bits.bitwiseAND(F.bitwise_not(bit)) == 0)("kept_without"),
    )


#: DuckDB SQL of the query: the same measurements, rules and policy 2.
SQL = """
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws,
      list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS ls FROM t),
g AS (SELECT r, unnest(range(1, len(ws) - 1)) AS p, ws FROM w WHERE len(ws) >= 3),
h AS (SELECT r, p, count(*) OVER (PARTITION BY r, ws[p], ws[p + 1], ws[p + 2]) AS c FROM g),
d AS (SELECT r, p, lead(p) OVER (PARTITION BY r ORDER BY p) AS q FROM h WHERE c > 1),
s AS (SELECT r, sum(least(3, coalesce(q, p + 3) - p)) AS n FROM d GROUP BY r),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
      (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
      (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
      len(ls)::BIGINT AS n_lines FROM w LEFT JOIN s USING (r)),
f AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
      + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END
      + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 25 * n_words THEN 32 ELSE 0 END)::BIGINT AS failed_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, failed_bits,
  (failed_bits & 3) <> 0 AS base_failed, (failed_bits & 63) = 0 AS kept, 2 AS policy_version FROM f
"""
