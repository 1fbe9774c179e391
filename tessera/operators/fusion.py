"""Reciprocal-rank fusion and hybrid search."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import bm25, vectors
from .keyword_index import KeywordIndex
from .vector_index import VectorIndex

RANK_CONSTANT = 60


def ranked(found: DataFrame, name: str) -> DataFrame:
    """id and 0-based rank of a short result list."""
    return found.select("id", (F.row_number().over(Window.orderBy(F.desc("score"), "id")) - 1).alias(name))


def reciprocal_rank(keyword: DataFrame, semantic: DataFrame, alpha: float = 0.5, k: int = 10) -> DataFrame:
    """id, score of the k best by alpha / (60 + semantic rank) + (1 - alpha) / (60 + keyword rank); a missing side adds 0."""
    both = ranked(semantic, "rs").join(ranked(keyword, "rk"), "id", "full_outer")
    part = lambda weight, rank: F.coalesce(F.lit(weight) / (RANK_CONSTANT + F.col(rank)), F.lit(0.0))
    return both.select("id", F.round(part(alpha, "rs") + part(1 - alpha, "rk"), 9).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def hybrid(tokens: DataFrame, vector_rows: DataFrame, query: str, query_vector: DataFrame, k: int = 10, mode: str = "hybrid", alpha: float = 0.5, least: float = -1.0) -> DataFrame:
    """Both searches fetch 2k and are fused; mode semantic or keyword sets alpha to 1 or 0."""
    alpha = {"semantic": 1.0, "keyword": 0.0}.get(mode, alpha)
    keyword = bm25.search(tokens, query, 2 * k)
    semantic = vectors.search(vector_rows, query_vector, min(2 * k, vectors.MOST_RESULTS), least)
    return reciprocal_rank(keyword, semantic, alpha, k)


def stored_hybrid(keywords: KeywordIndex, near: VectorIndex, query: str, query_vector: Sequence[float] | None, k: int = 10, mode: str = "hybrid", alpha: float = 0.5, least: float = -1.0, where: Column | None = None, allowed: DataFrame | None = None, exact: bool = True) -> DataFrame:
    """The same over stored indexes, which are read at once; ``where`` (over the vectors' columns) and ``allowed`` (ids) hold for both sides before their cuts.

    Each side gives 2k rows at most (a hundred of vectors); ranks are made of them here.
    """
    alpha = {"semantic": 1.0, "keyword": 0.0}.get(mode, alpha)
    let = allowed
    if where is not None:
        inside = near.read().where(where).select(near.id)
        let = inside if allowed is None else inside.join(allowed.select(F.col(allowed.columns[0]).alias(near.id)), near.id, "left_semi")

    def words() -> list:
        return keywords.search(query, 2 * k, let, zeros=True).collect()

    def nearest() -> list:
        return near.search(query_vector, 2 * k, least, where, allowed, exact).collect() if query_vector else []

    with ThreadPoolExecutor(2) as both:
        found = [x.result() for x in (both.submit(words), both.submit(nearest))]
    scores: dict = {}
    for rows, weight in zip(found, (1 - alpha, alpha)):
        for rank, r in enumerate(rows):
            scores[r["id"]] = scores.get(r["id"], 0.0) + weight / (RANK_CONSTANT + rank)
    best = sorted(((round(s, 9), i) for i, s in scores.items()), key=lambda x: (-x[0], x[1]))[:k]
    return near.spark.createDataFrame([(i, s) for s, i in best], f"id {keywords.facts['id']}, score double")


def merged_queries(found: DataFrame, k: int = 10) -> DataFrame:
    """The k best documents over several queries' results, by their best score."""
    return found.groupBy("id").agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("n_queries")).orderBy(F.desc("score"), "id").limit(k)
