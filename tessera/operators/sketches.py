"""Windows and statistics from sketches that merge: every row is read once.

Rows are summed up by time bucket: counts, sums and a quantile sketch. Any
window is a merge of buckets, and buckets of later rows merge with stored ones,
so dashboards never go back to the rows. Distinct values are counted by
sketches that merge over versions or projects. Samples are drawn by stratum
with bounds of their error.

Where percentiles must be exact, the state is the count of every value of a
bucket, which merges too. A window first finds, from the counts of bins of
values (BINS for each doubling), the bin of each percentile's rank, and then
ranks the values of that bin only.
"""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Size of a quantile sketch, and the error of its ranks as a share of the rows (99 of 100 times); up to about K rows it is exact.
K, RANK_ERROR = 1000, 0.0028
#: Registers of a distinct sketch (2 ** LG), and its relative standard error.
LG = 12
DISTINCT_ERROR = 1.04 / math.sqrt(1 << LG)
#: Bins of values for each doubling, in exact windows; more than BINS times the largest exponent.
BINS, BEYOND = 16, 20_000


def buckets(rows: DataFrame, groups: list[str], ts: str, value: str, failed: Column, seconds: int = 60) -> DataFrame:
    """groups, bucket (start in seconds), n, failed, total, low, high and sketch of every bucket with rows."""
    start = (F.floor(F.unix_micros(ts) / F.lit(seconds * 1_000_000)) * seconds).alias("bucket")
    v = F.col(value).cast("double")
    return rows.where(F.col(ts).isNotNull() & v.isNotNull()).groupBy(*groups, start).agg(F.count(F.lit(1)).alias("n"), F.count_if(failed).alias("failed"), F.sum(v.cast("decimal(28,6)")).alias("total"), F.min(v).alias("low"), F.max(v).alias("high"), F.kll_sketch_agg_double(v, F.lit(K)).alias("sketch"))


def _merged(rows: DataFrame, *by: str | Column) -> DataFrame:
    return rows.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("failed").alias("failed"), F.sum("total").cast("decimal(28,6)").alias("total"), F.min("low").alias("low"), F.max("high").alias("high"), F.kll_merge_agg_double("sketch").alias("sketch"))


def merged(held: DataFrame | None, new: DataFrame, groups: list[str]) -> DataFrame:
    """Stored buckets with those of further rows."""
    return new if held is None else _merged(held.unionByName(new), *groups, "bucket")


def windows(held: DataFrame, groups: list[str], seconds: int, every: int = 60, shares: dict[str, float] | None = None) -> DataFrame:
    """groups, at (end in seconds), n, failed, error_rate, avg, low, high and percentiles of the trailing windows that hold a bucket.

    Buckets must be ``every`` seconds long and the window a multiple of that. A
    bucket goes to the windows that it lies in, without its rows.
    """
    ends = F.explode(F.sequence(F.col("bucket") + every, F.col("bucket") + seconds, F.lit(every).cast("long"))).alias("at")
    found = _merged(held.select("*", ends), *groups, "at")
    points = [F.kll_sketch_get_quantile_double("sketch", F.lit(p)).alias(name) for name, p in (shares or {"p95": 0.95, "p99": 0.99}).items()]
    return found.select(*groups, "at", "n", "failed", F.round(F.col("failed") / F.col("n"), 6).alias("error_rate"), F.round(F.col("total").cast("double") / F.col("n"), 6).alias("avg"), "low", "high", *points)


def value_counts(rows: DataFrame, groups: list[str], ts: str, value: str, failed: Column, seconds: int = 60) -> DataFrame:
    """groups, bucket (start in seconds), value, n, failed: the exact state, one row for each different value of a bucket."""
    start = (F.floor(F.unix_micros(ts) / F.lit(seconds * 1_000_000)) * seconds).alias("bucket")
    v = F.col(value).cast("double")
    return rows.where(F.col(ts).isNotNull() & v.isNotNull()).groupBy(*groups, start, v.alias("value")).agg(F.count(F.lit(1)).alias("n"), F.count_if(failed).alias("failed"))


def merged_counts(held: DataFrame | None, new: DataFrame, groups: list[str]) -> DataFrame:
    """Stored counts of values with those of further rows."""
    return new if held is None else held.unionByName(new).groupBy(*groups, "bucket", "value").agg(F.sum("n").alias("n"), F.sum("failed").alias("failed"))


def _bin(v: Column) -> Column:
    """A number that grows with the value."""
    size = F.floor(F.log2(F.abs(v)) * BINS) + BEYOND
    return F.when(F.isnan(v) | (v == float("inf")), F.lit(2 * BEYOND)).when(v == float("-inf"), F.lit(-2 * BEYOND)).when(v > 0, size).when(v < 0, -size).otherwise(F.lit(0)).cast("int")


def exact_windows(held: DataFrame, groups: list[str], seconds: int, every: int = 60, shares: dict[str, float] | None = None) -> DataFrame:
    """groups, at, n, failed, error_rate, total, low, high and exact nearest-rank percentiles of the trailing windows that hold a bucket, from :func:`value_counts`.

    What is dealt to all windows of a bucket are the counts of its bins, whose number
    doesn't grow with the rows, and the values of the bins that hold a percentile.
    """
    shares = shares or {"p95": 0.95, "p99": 0.99}
    held = held.withColumn("bin", _bin(F.col("value")))
    ends = F.explode(F.sequence(F.col("bucket") + every, F.col("bucket") + seconds, F.lit(every).cast("long"))).alias("at")
    sums = [F.sum("n").alias("n"), F.sum("failed").alias("failed"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high")]
    bins = held.withColumns({"total": F.col("value") * F.col("n"), "low": F.col("value"), "high": F.col("value")}).groupBy(*groups, "bucket", "bin").agg(*sums)
    bins = bins.select("*", ends).groupBy(*groups, "at", "bin").agg(*sums)
    window = Window.partitionBy(*groups, "at")
    # counts of a window's bins are few, so the whole window is one frame
    placed = bins.withColumns({"to": F.sum("n").over(window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)), "all_": F.sum("n").over(window)})
    nth = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.ceil(F.col("all_") * F.lit(Decimal(str(p)))).cast("long").alias("nth")) for name, p in shares.items()])).alias("x")
    asked = placed.select(*groups, "at", "bin", "to", "n", nth).where((F.col("x.nth") <= F.col("to")) & (F.col("x.nth") > F.col("to") - F.col("n")))
    starts = F.explode(F.sequence(F.col("at") - seconds, F.col("at") - every, F.lit(every).cast("long"))).alias("bucket_")
    asked = asked.select(*[F.col(g).alias(f"{g}_") for g in groups], "at", F.col("bin").alias("bin_"), F.col("x.name").alias("name"), (F.col("x.nth") - F.col("to") + F.col("n")).alias("nth"), starts)
    same = (F.col("bucket") == F.col("bucket_")) & (F.col("bin") == F.col("bin_"))
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"{g}_"))
    values = held.join(asked, same).groupBy(*groups, "at", "name", "nth", "value").agg(F.sum("n").alias("n"))
    up_to = F.sum("n").over(Window.partitionBy(*groups, "at", "name").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    points = values.withColumn("to", up_to).where(F.col("to") >= F.col("nth")).groupBy(*groups, "at", "name").agg(F.min("value").alias("value"))
    # of each window one side has the sums and the other the percentiles
    both = bins.unionByName(points, allowMissingColumns=True)
    found = both.groupBy(*groups, "at").agg(*sums, *[F.max(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in shares])
    return found.select(*groups, "at", "n", "failed", F.round(F.col("failed") / F.col("n"), 6).alias("error_rate"), "total", "low", "high", *shares)


def summary(held: DataFrame, groups: list[str], shares: dict[str, float]) -> DataFrame:
    """groups, n and percentiles over all buckets."""
    return _merged(held, *groups).select(*groups, "n", *[F.kll_sketch_get_quantile_double("sketch", F.lit(p)).alias(name) for name, p in shares.items()])


def distinct_sketches(rows: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """A sketch of the values of every column for each group (a version, a project): what is stored."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), *[F.hll_sketch_agg(c, F.lit(LG)).alias(c) for c in columns])


def distinct_counts(sketches: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """rows and about how many different values, over the sketches of each group; of all, if ``by`` is empty."""
    return sketches.groupBy(*by).agg(F.sum("rows").alias("rows"), *[F.hll_sketch_estimate(F.hll_union_agg(c)).alias(c) for c in columns])


def stratified(rows: DataFrame, stratum: str, key: str, most: int = 1000, seed: int = 7) -> DataFrame:
    """``most`` rows of every stratum (all of a smaller one) with of_ (its rows) and drawn_: the smallest seeded hashes of the key.

    The sample doesn't depend on partitions. Counts give a bound that leaves
    little more than ``most`` rows of a stratum to be ranked.
    """
    sizes = rows.groupBy(stratum).agg(F.count(F.lit(1)).alias("of_"))
    hashed = F.xxhash64(F.col(key), F.lit(seed))
    share = (F.lit(most) + 6 * math.sqrt(most) + 20) / F.col("of_")
    near = rows.join(sizes, rows[stratum].eqNullSafe(sizes[stratum])).drop(sizes[stratum]).withColumn("hash_", hashed).where((F.col("hash_") / F.lit(float(1 << 63)) + 1) / 2 < share)
    order = Window.partitionBy(stratum).orderBy("hash_", key)
    return near.withColumn("rank_", F.row_number().over(order)).where(F.col("rank_") <= most).withColumn("drawn_", F.least("of_", F.lit(most))).drop("hash_", "rank_")


def sampled_counts(rows: DataFrame, stratum: str, value: str, key: str, most: int = 1000, seed: int = 7, z: float = 3.0) -> DataFrame:
    """stratum, value, estimate, low, high: rows of each value, estimated from a stratified sample, with bounds at ``z`` standard errors (Wilson's interval, without those that the sample is sure of)."""
    drawn = stratified(rows, stratum, key, most, seed).groupBy(stratum, value, "of_", "drawn_").agg(F.count(F.lit(1)).alias("seen"))
    m, n, p = F.col("drawn_"), F.col("of_"), F.col("seen") / F.col("drawn_")
    z2 = z * z * F.greatest(F.lit(0.0), 1 - m / n)  # a whole stratum has no error
    centre, width = (p + z2 / (2 * m)) / (1 + z2 / m), F.sqrt(z2) * F.sqrt(p * (1 - p) / m + z2 / (4 * m * m)) / (1 + z2 / m)
    return drawn.select(stratum, value, F.round(p * n).cast("long").alias("estimate"), F.greatest(F.col("seen"), F.floor((centre - width) * n)).alias("low"), F.least(n - m + F.col("seen"), F.ceil((centre + width) * n)).alias("high"))
