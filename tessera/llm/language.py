"""Language identification by hierarchical discrimination (operator 7).

A text is described by the square roots of the relative frequencies of its
hashed letter pairs and triples, over the whole text. Linear support vector
machines first tell language families apart (one against the rest), then the
languages of the winning family one against one; the language with most wins
is predicted, ties going to the larger sum of margins.

The machines are fitted by tasks from a bounded, documented sample of the
labelled rows: LANGUAGE_ROWS of each language, fewer where SAMPLE_ROWS in all
would be passed, but at least one; those of least hash of id and text, so the
choice is the same at any partitioning. Every language of a labelled row with a
letter is learned. What reaches the driver are the weights, DIM numbers for each
machine; the sample doesn't.

Defined results: ``und`` with score 0 for a null text, a text without a letter,
or when no language could be learned; every input row gives one row; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .base import fold_of, map_batches, tune

DIM = 1 << 13
SAMPLE_ROWS, LANGUAGE_ROWS = 6000, 600
#: Bundles of machines that are fitted beside each other; each gets its rows of the sample once.
FITTERS = 16
#: Characters that are counted at a time.
SLICE = 1 << 20
#: Families of language codes (fixed values); another code is a family of its own.
FAMILIES = {
    "germanic": "en de nl af sv da no nb nn is fo fy lb yi",
    "romance": "fr es it pt ro ca gl oc ast la",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk tt",
    "indo-aryan": "hi bn ur pa gu mr ne si",
    "iranian": "fa ps ku tg",
    "semitic": "ar he am mt",
    "dravidian": "ta te kn ml",
    "austronesian": "id ms tl jv mg",
    "sinitic": "zh yue wuu",
}
_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """Code point -> its lower-case letter, or a blank for what is no letter; made once in each worker."""
    if not _letters:
        table = np.full(0x110000, 32, dtype=np.uint32)
        for c in range(0x30000):
            if 0xD800 <= c < 0xE000:
                continue
            if chr(c).isalpha():
                table[c] = ord(chr(c).lower()[0])
        _letters.append(table)
    return _letters[0]


def counts_of(text: str) -> np.ndarray:
    """Hashed counts of the letter pairs and triples of a whole text; runs of other characters count as one blank."""
    table, total = letter_table(), np.zeros(DIM, dtype=np.int64)
    for start in range(0, len(text), SLICE):
        c = table[np.frombuffer(text[max(0, start - 2) : start + SLICE].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        blank = c == 32
        c = c[np.append(True, ~(blank[1:] & blank[:-1]))]
        if len(c) < 2:
            continue
        pair = c[:-1] * np.uint32(0x9E3779B1) + c[1:] * np.uint32(0x85EBCA77)
        triple = pair[:-1] * np.uint32(0x27D4EB2F) + c[2:] * np.uint32(0xC2B2AE3D)
        total += np.bincount(np.concatenate([pair >> 19, triple >> 19]), minlength=DIM)
    return total


def vector_of(counts: np.ndarray) -> np.ndarray:
    """Square roots of relative frequencies: a vector of length 1."""
    return np.sqrt(counts / max(1, counts.sum())).astype(np.float32)


def fit_svm(x: np.ndarray, sign: np.ndarray, rounds: int = 120, weight: float = 1e-4) -> np.ndarray:
    """Linear machine with squared hinge loss, both sides weighted alike, by accelerated gradient steps; the last weight is the bias."""
    share = np.where(sign > 0, 0.5 / max(1, (sign > 0).sum()), 0.5 / max(1, (sign < 0).sum())).astype(np.float32)
    w = v = np.zeros(x.shape[1] + 1, dtype=np.float32)
    step = 1 / (4 + 2 * weight)  # of the loss' curvature: rows have length 1, and a bias
    for k in range(rounds):
        look = v
        gap = np.maximum(0, 1 - sign * (x @ look[:-1] + look[-1])) * share * sign
        slope = np.append(-2 * (gap @ x), -2 * gap.sum()) + 2 * weight * look
        new = (look - step * slope).astype(np.float32)
        v = (new + k / (k + 3) * (new - w)).astype(np.float32)
        w = new
    return w


class Model:
    """The learned hierarchy; small enough to go to every worker (DIM numbers for each pair within a family)."""

    def __init__(self, langs: list[str]):
        self.langs = sorted(langs)
        known = {c: name for name, codes in FAMILIES.items() for c in codes.split()}
        self.family = {c: known.get(c.replace("_", "-").split("-")[0].lower(), c) for c in self.langs}
        self.families = sorted(set(self.family.values()))
        self.pairs = {f: list(combinations([c for c in self.langs if self.family[c] == f], 2)) for f in self.families}
        self.family_w: np.ndarray | None = None
        self.pair_w: dict[str, np.ndarray] = {}

    def machines(self) -> list[dict[str, int]]:
        """The languages that each machine tells apart and their side, 1 or -1: the families', then each family's pairs."""
        rest = [{c: 1 if self.family[c] == f else -1 for c in self.langs} for f in self.families] if len(self.families) > 1 else []
        return rest + [{a: 1, b: -1} for f in self.families for a, b in self.pairs[f]]

    def fitted(self, weights: list[np.ndarray]) -> Model:
        """This model with the weights of its machines, in their order."""
        at = len(self.families) if len(self.families) > 1 else 0
        self.family_w = np.array(weights[:at]) if at else None
        for f in self.families:
            if n := len(self.pairs[f]):
                self.pair_w[f] = np.array(weights[at : at + n])
                at += n
        return self

    def predict(self, vector: np.ndarray) -> tuple[str, float]:
        """Language and a score from 0 to 1."""
        if not self.langs:
            return "und", 0.0
        sure = lambda margin: 1 / (1 + np.exp(-4.0 * float(np.clip(margin, -8, 8))))
        score, family = 1.0, self.families[0]
        if self.family_w is not None:
            margins = self.family_w[:, :-1] @ vector + self.family_w[:, -1]
            family, score = self.families[int(np.argmax(margins))], sure(margins.max())
        members = [c for c in self.langs if self.family[c] == family]
        if len(members) == 1:
            return members[0], score
        margins = self.pair_w[family][:, :-1] @ vector + self.pair_w[family][:, -1]
        wins, sums = dict.fromkeys(members, 0), dict.fromkeys(members, 0.0)
        for (a, b), m in zip(self.pairs[family], margins.tolist()):
            wins[a if m >= 0 else b] += 1
            sums[a] += m
            sums[b] -= m
        best = max(members, key=lambda c: (wins[c], sums[c], c))
        against = min(m if a == best else -m for (a, b), m in zip(self.pairs[family], margins.tolist()) if best in (a, b))
        return best, score * sure(against)


def fit_machines(sample: DataFrame, machines: list[dict[str, int]]) -> list[np.ndarray]:
    """The weights of each machine from the rows (lang, draw, cells) of its languages; a task fits a bundle of machines, and only weights reach the driver."""
    if not machines:
        return []
    deals = sorted({(c, k % FITTERS) for k, sides in enumerate(machines) for c in sides})
    dealt = sample.join(F.broadcast(sample.sparkSession.createDataFrame(deals, "lang string, bundle int")), "lang")

    def fit(group: pa.Table) -> pa.Table:
        # in any partitioning the same order, and so the same sums
        rows = sorted(zip(*(group[c].to_pylist() for c in ("lang", "draw", "cells"))))
        x = np.zeros((len(rows), DIM), dtype=np.float32)
        for row, (_, _, packed) in zip(x, rows):
            cells = np.frombuffer(packed, dtype="<u4")
            full = np.zeros(DIM, dtype=np.int64)
            full[cells[: len(cells) // 2]] = cells[len(cells) // 2 :]
            row[:] = vector_of(full)
        numbers = range(group["bundle"][0].as_py(), len(machines), FITTERS)
        found = []
        for k in numbers:
            sign = np.array([machines[k].get(lang, 0) for lang, _, _ in rows], dtype=np.float32)
            mine = sign != 0
            found.append((fit_svm(x, sign) if mine.all() else fit_svm(x[mine], sign[mine])).tobytes())
        return pa.table({"machine": pa.array(numbers, type=pa.int32()), "weights": pa.array(found, type=pa.binary())})

    fits = dealt.groupBy("bundle").applyInArrow(fit, "machine int, weights binary").collect()
    return [np.frombuffer(r["weights"], dtype=np.float32) for r in sorted(fits, key=lambda r: r["machine"])]


def learn(docs: DataFrame, folds: int = 5) -> Model:
    """The model of the rows with a lang, a letter, and fold other than 0."""
    spark = docs.sparkSession
    tune(spark)
    rows = docs.select("text", F.col("lang").cast("string").alias("lang"), fold_of(F.col("doc_id"), folds).alias("fold"), F.xxhash64("doc_id", "text").alias("draw"))
    rows = rows.where(F.col("lang").isNotNull() & (F.col("fold") != 0) & F.col("text").rlike(r"\p{L}")).drop("fold")
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"), F.min("draw").alias("least")).collect()
    if not counts:
        return Model([])
    most = max(1, min(LANGUAGE_ROWS, SAMPLE_ROWS // len(counts)))
    # rows that surely hold the `most` of least hash: about three times as many, and the very least; then exactly these
    shares = spark.createDataFrame([(r["lang"], r["least"], float(min(1.0, (3 * most + 50) / r["rows"]))) for r in counts], "lang string, least long, share double")
    near = rows.join(F.broadcast(shares), "lang").where((F.col("draw") == F.col("least")) | ((F.col("draw") / F.lit(2.0**64) + 0.5) < F.col("share")))
    chosen = near.select("lang", "text", "draw")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        packed = []
        for text in batch.column(1).to_pylist():
            c = counts_of(text)
            at = np.flatnonzero(c)
            packed.append(at.astype("<u4").tobytes() + c[at].astype("<u4").tobytes())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(packed, type=pa.binary())], names=["lang", "draw", "cells"])

    order = Window.partitionBy("lang").orderBy("draw", "cells")
    taken = map_batches(chosen, work, "lang string, draw long, cells binary").withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most).drop("nth")
    model = Model([r["lang"] for r in counts])
    return model.fitted(fit_machines(taken, model.machines()))


def add_language(docs: DataFrame, model: Model, lang: str, score: str) -> DataFrame:
    """All columns of ``docs`` with the prediction under the two given names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")
    schema = StructType([*docs.schema.fields]).add(lang, "string").add(score, "double")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        model, found = shared.value, []
        for text in batch.column(place).to_pylist():
            known = text and any(map(str.isalpha, text))
            found.append(model.predict(vector_of(counts_of(text))) if known else ("und", 0.0))
        more = [pa.array([f[0] for f in found], type=pa.string()), pa.array([f[1] for f in found], type=pa.float64())]
        return pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, lang, score])

    return map_batches(docs, work, schema)


def identify(docs: DataFrame, folds: int = 5) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    model = learn(docs, folds)
    found = add_language(docs.select("doc_id", "text"), model, "lang_pred", "score")
    return found.select("doc_id", (fold_of(F.col("doc_id"), folds) == 0).alias("held_out"), "lang_pred", "score")
