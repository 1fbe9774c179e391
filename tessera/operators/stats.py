"""Statistics of chunks, projects and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grouping_counts(rows: DataFrame, *columns: str, tokens: str | None = None) -> DataFrame:
    """facet, value, n (and tokens): one row for each value of each column, and one for all, in one pass."""
    sums = [F.count(F.lit(1)).alias("n")] + ([F.sum(tokens).alias("tokens")] if tokens else [])
    sets = rows.groupingSets([[F.col(c)] for c in columns] + [[]], *[F.col(c) for c in columns]).agg(*sums, F.grouping_id(*columns).alias("g"))
    facet, value = F.lit("all"), F.lit("")
    for k, c in enumerate(columns):
        own = ((1 << len(columns)) - 1) ^ (1 << (len(columns) - 1 - k))
        facet, value = F.when(F.col("g") == own, c).otherwise(facet), F.when(F.col("g") == own, F.coalesce(F.col(c).cast("string"), F.lit("unknown"))).otherwise(value)
    return sets.select(facet.alias("facet"), value.alias("value"), "n", *(["tokens"] if tokens else []))


def project_rollup(chunks: DataFrame) -> DataFrame:
    """project_id and its chunks; null is default."""
    return chunks.groupBy(F.coalesce("project_id", F.lit("default")).alias("project_id")).agg(F.count(F.lit(1)).alias("chunks"))


def project_stats(chunks: DataFrame) -> DataFrame:
    """Counts, distinct files, tokens and language count of each project."""
    return chunks.groupBy(F.coalesce("project_id", F.lit("default")).alias("project_id")).agg(
        F.count(F.lit(1)).alias("chunks"),
        F.count_distinct(F.when(F.col("file_path") != "", F.col("file_path"))).alias("files"),
        F.sum("token_count").alias("tokens"),
        F.round(F.avg("token_count"), 6).alias("avg_tokens"),
        F.count_distinct("language").alias("languages"),
    )


def project_details(projects: DataFrame, chunks: DataFrame) -> DataFrame:
    """Projects with their live numbers; zero where there are none."""
    return projects.join(project_rollup(chunks), "project_id", "left").fillna(0, ["chunks"])


def sampled_statistics(rows: DataFrame, column: str, most: int = 1000, seed: int = 7) -> DataFrame:
    """Approximate histogram: counts of a seeded sample, scaled to the exact total."""
    total = rows.count()
    part = rows.sample(min(1.0, most / max(1, total)), seed=seed).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    seen = part.agg(F.sum("n").alias("seen"))
    return part.crossJoin(F.broadcast(seen)).select(column, F.floor(F.col("n") * F.lit(total) / F.col("seen")).cast("long").alias("n"))


def run_status(total: Column, failed: Column) -> Column:
    """success without failures, error if all failed, else partial."""
    return F.when(failed == 0, "success").when(failed >= total, "error").otherwise("partial")


def rate(part: Column, whole: Column, empty: float = 0.0) -> Column:
    """Share, or ``empty`` of nothing."""
    return F.round(F.when(whole > 0, part / whole).otherwise(F.lit(empty)), 6)
