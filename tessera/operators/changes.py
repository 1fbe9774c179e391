"""Change detection between snapshots, and what follows from changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import glob_regex


def snapshot_diff(old: DataFrame, new: DataFrame, key: str = "file_path", digest: str = "file_hash") -> DataFrame:
    """key, change_type, digest: added, deleted or modified; unchanged rows are out, null digests are equal."""
    a, b = old.select(key, F.col(digest).alias("was"), F.lit(1).alias("in_old")), new.select(key, F.col(digest).alias("now"), F.lit(1).alias("in_new"))
    both = a.join(b, key, "full_outer")
    kind = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "deleted").when(~F.col("was").eqNullSafe(F.col("now")), "modified")
    return both.select(key, kind.alias("change_type"), F.coalesce("now", "was").alias(digest)).where(F.col("change_type").isNotNull())


def first_scan(new: DataFrame, key: str = "file_path", digest: str = "file_hash") -> DataFrame:
    """Every file as added."""
    return new.select(key, F.lit("added").alias("change_type"), digest)


def with_renames(changes: DataFrame) -> DataFrame:
    """A deleted and an added path with the same digest become one rename (file_path, change_type, old_path, file_hash)."""
    gone = changes.where("change_type = 'deleted'").groupBy("file_hash").agg(F.min("file_path").alias("old_path"), F.count(F.lit(1)).alias("n_old"))
    come = changes.where("change_type = 'added'").groupBy("file_hash").agg(F.min("file_path").alias("file_path"), F.count(F.lit(1)).alias("n_new"))
    moved = gone.join(come, "file_hash").where("n_old = 1 and n_new = 1").select("file_path", F.lit("renamed").alias("change_type"), "old_path", "file_hash")
    touched = moved.select(F.col("file_path").alias("p")).unionAll(moved.select(F.col("old_path").alias("p")))
    rest = changes.join(touched, changes["file_path"] == touched["p"], "left_anti")
    return rest.select("file_path", "change_type", F.lit(None).cast("string").alias("old_path"), "file_hash").unionAll(moved)


def included(path: Column, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> Column:
    """Whether globs let a path in: exclusion first; no inclusion glob lets all in."""
    def hit(globs: tuple[str, ...]) -> Column:
        out = F.lit(False)
        for g in globs:
            out = out | path.rlike(glob_regex(g))
        return out

    return ~hit(exclude) & (hit(include) if include else F.lit(True))


def work_sets(changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(paths whose chunks go, paths to parse); a rename drops its old path and parses the new one."""
    old = F.col("old_path") if "old_path" in changes.columns else F.lit(None).cast("string")
    gone = changes.where(F.col("change_type").isin("deleted", "modified", "renamed")).select(F.when((F.col("change_type") == "renamed") & old.isNotNull(), old).otherwise(F.col("file_path")).alias("file_path")).distinct()
    todo = changes.where(F.col("change_type").isin("added", "modified", "renamed")).select("file_path").distinct()
    return gone, todo


def commit_range(touched: DataFrame, before: DataFrame, head: DataFrame) -> DataFrame:
    """Paths touched by commits, classified by whether they were there before and are at the head."""
    t = touched.select("file_path").distinct()
    b, h = before.select("file_path", F.lit(True).alias("was")), head.select("file_path", "file_hash", F.lit(True).alias("now_"))
    both = t.join(b, "file_path", "left").join(h, "file_path", "left")
    kind = F.when(F.col("was").isNull() & F.col("now_"), "added").when(F.col("was") & F.col("now_").isNull(), "deleted").when(F.col("was") & F.col("now_"), "modified")
    return both.select("file_path", kind.alias("change_type"), "file_hash").where(F.col("change_type").isNotNull())


def needs_full_scan(states: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """project_id and whether its state is missing or as old as ``hours``."""
    old = F.col("saved_at").isNull() | (now.cast("double") - F.col("saved_at").cast("double") >= hours * 3600)
    return states.select("project_id", old.alias("full_scan"))


def histogram(changes: DataFrame) -> DataFrame:
    """Changes by type."""
    return changes.groupBy("change_type").agg(F.count(F.lit(1)).alias("n"))
