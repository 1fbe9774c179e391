"""The queries of the training-data operators, with their production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import align, ann, language, lm, near_dups, packing, pii, quality, token_counts, url_filter, vector_codes, warc, wordbpe
from .base import table

TOKENIZER_BYTES, TOKENIZER_WORDS, TOKENIZER_PIECES = "byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies on this machine; every node has the same package."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens in sequences of 2048."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(TOKENIZER_BYTES))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path(TOKENIZER_BYTES))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule ledger of every document and the verdict of policy 2."""
    measured = quality.measure(table(spark, sf_dir, "documents"))
    return quality.apply_policy(quality.ledger(measured), quality.POLICIES[2])


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded, as digests."""
    return wordbpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path(TOKENIZER_WORDS), outputs=False)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    return language.identify(table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return pii.find(table(spark, sf_dir, "documents"))


def op10_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return near_dups.classes(table(spark, sf_dir, "documents"))


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth one."""
    return ann.search(table(spark, sf_dir, "embeddings"))


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and maximum-entropy scores of every document."""
    return lm.score(table(spark, sf_dir, "documents"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in two tokenizers, its aligned groups and how common its links are."""
    return align.align(table(spark, sf_dir, "documents"), tokenizer_path(TOKENIZER_BYTES), tokenizer_path(TOKENIZER_PIECES))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of every vector by integer codebooks."""
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Query name to function."""
    return {f.__name__: f for f in (op1_packing, op2_quality_rules, op3_token_counts, op5_bpe, op6_url_filter, op7_language_id, op4_pii, op10_near_dups, op8_ann, op9_lm_scores, op11_alignment, op12_vector_codes, op13_warc)}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the queries that SQL can express."""
    return {"op2_quality_rules": quality.SQL, "op6_url_filter": url_filter.duckdb_sql(), "op12_vector_codes": vector_codes.duckdb_sql(), "op13_warc": warc.SQL}
