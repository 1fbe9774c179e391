"""The corpus pipeline: documents in, packed training sequences out.

Each stage works on all that its predecessor kept. All but the last return the
columns of ``documents``; the last returns the pieces of the packed sequences
with their token ids. Rows that repeat a doc_id are one document from the
near-duplicate stage on. An empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import language, near_dups, packing, pii, quality
from tessera.llm.base import fresh, keep, release, tune
from tessera.llm.queries import TOKENIZER_BYTES, tokenizer_path

#: A document stays if its language is a learned one with at least this score.
LEAST_LANGUAGE_SCORE = 0.2


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language: no text, no letter, or far from every learned language."""
    tune(spark)
    lang, score = fresh("pipeline_lang", docs.columns), fresh("pipeline_score", docs.columns)
    found = language.add_language(docs, language.learn(docs), lang, score)
    return found.where((F.col(lang) != "und") & (F.col(score) >= LEAST_LANGUAGE_SCORE)).select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that policy 2 rejects."""
    row = fresh("pipeline_row", docs.columns)
    whole = docs.select("text", F.struct(*docs.columns).alias(row))
    judged = quality.apply_policy(quality.ledger(quality.measure(whole, keep=(row,))), quality.POLICIES[2])
    return judged.where("kept").select(f"{row}.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate class."""
    return near_dups.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in the texts; n_chars follows, where it is a column."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the tokens of what is left into sequences; ids are little-endian uint32."""
    return packing.pack_documents(docs, tokenizer_path(TOKENIZER_BYTES), with_ids=True)


STAGES = [
    ("language ID", identify_language),
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_duplicates),
    ("PII", personal_data),
    ("packing", pack),
]
#: Language models, alignment and tokenizers are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each result is written and read again. :func:`tessera.llm.base.clean` removes what the result still reads."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        last, docs = docs, keep(stage(spark, docs, sf_dir), "stage")
        release(last)  # only the last stage's input is read again
    return STAGES[-1][1](spark, docs, sf_dir)
