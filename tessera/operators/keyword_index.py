"""A stored keyword index with block maxima: built once for a version of its rows, read by many searches.

Documents are dealt to segments of about SEGMENT, by classes of length first,
since the impact of a term depends on the length. The postings of a term in a
segment are one block: ids and impacts (the part of the BM25 score that doesn't
depend on the query), largest impact first, with the largest as its maximum.
Blocks lie in folders by a bucket of the term's hash, sorted by term and
segment, so that a search reads the pages of its few terms only.

A search prunes by block maxima: the sum over its terms of weight x maximum
bounds the scores of a segment. The segments of the highest bounds are scored
first, which gives a k-th best score; then all blocks of segments whose bound
reaches it are scored and no others. The result is exact. A filter is a
semi-join before the cut.

Tables in the folder of a version: ``blocks``, ``terms`` (df, weight) and
``documents`` (id, dl, segment); the facts are a small file, written last, which
makes the version ready. A new version of the rows has no folder yet, which is
the invalidation; :meth:`KeywordIndex.drop_others` removes stale ones.
"""

from __future__ import annotations

import json
import math

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import Folder, read_parts
from .bm25 import EPSILON, K1, B, query_terms

#: Documents of a segment, classes of length, segments scored for the first threshold.
SEGMENT, LENGTHS, FIRST = 128, 16, 16
#: Postings up to which all are scored at once: fewer than pruning would pay for. The result is the same.
DIRECT = 1 << 18
#: Postings of a bucket folder, at most so many buckets, and postings of one of its files.
BUCKET_POSTINGS, MOST_BUCKETS, FILE_POSTINGS = 1 << 19, 4096, 1 << 22


def bucket_of(term: Column, buckets: int) -> Column:
    """The bucket of a term."""
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


class KeywordIndex:
    """The index of one version of a table's rows, below ``path``."""

    def __init__(self, spark: SparkSession, path: str, version: str):
        self.spark, self.root, self.version = spark, path.rstrip("/"), version
        self.path = f"{self.root}/index-{version}"
        self.folder = Folder(spark, self.path)
        self._facts: dict | None = None

    def ready(self) -> bool:
        """Whether this version is indexed; the facts are written last."""
        return self.folder.exists("facts.json")

    @property
    def facts(self) -> dict:
        """n, avgdl, mean_idf, buckets, postings, segments, and the id's type."""
        if self._facts is None:
            self._facts = json.loads(self.folder.read("facts.json"))
        return self._facts

    def build(self, tokens: DataFrame) -> None:
        """Write the index of ``tokens`` (id, tokens, dl), unless it is there.

        Terms are counted within their documents; where the rows are dealt by
        id that takes no shuffle. An empty term stands for the document itself.
        """
        if self.ready():
            return
        for name in ("counted", "blocks", "terms", "documents"):
            self.folder.delete(name)
        each = tokens.select("id", "dl", F.explode(F.concat(F.array(F.lit("")), "tokens")).alias("term"))
        each.groupBy("id", "dl", "term").agg(F.count(F.lit(1)).cast("int").alias("tf")).write.parquet(f"{self.path}/counted")
        counted = self.spark.read.schema(f"id {tokens.schema['id'].dataType.simpleString()}, dl long, term string, tf int").parquet(f"{self.path}/counted")
        whole, posting = counted.where("term = ''"), counted.where("term <> ''")
        shares = [k / LENGTHS for k in range(1, LENGTHS)]
        row = counted.agg(F.count_if(F.col("term") == "").alias("n"), F.avg(F.when(F.col("term") == "", F.col("dl"))).alias("avgdl"), F.percentile_approx(F.when(F.col("term") == "", F.col("dl")), shares).alias("bounds"), F.count_if(F.col("term") != "").alias("postings")).first()
        n, avgdl, bounds = row["n"], row["avgdl"] or 0.0, sorted(set(row["bounds"] or []))
        buckets = min(MOST_BUCKETS, 1 << max(0, math.ceil(math.log2(max(1, row["postings"] / BUCKET_POSTINGS)))))
        inside = max(1, math.ceil(n / SEGMENT / (len(bounds) + 1)))
        length = sum((F.when(F.col("dl") > b, 1).otherwise(0) for b in bounds), F.lit(0)) if bounds else F.lit(0)
        segment = (length * F.lit(inside).cast("long") + F.pmod(F.xxhash64("id"), F.lit(inside))).alias("segment")

        idf = F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        seen = posting.groupBy("term").agg(F.count(F.lit(1)).alias("df")).withColumn("idf", idf)
        mean = seen.agg(F.avg("idf").alias("mean_idf"))
        weight = F.when(F.col("idf") < 0, F.lit(EPSILON) * F.col("mean_idf")).otherwise(F.col("idf"))
        terms = seen.crossJoin(F.broadcast(mean)).select(bucket_of(F.col("term"), buckets).alias("bucket"), "term", "df", weight.alias("weight"))
        terms.repartition("bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{self.path}/terms")

        files = max(1, math.ceil(row["postings"] / buckets / FILE_POSTINGS))
        impact = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(avgdl)))
        placed = posting.select(bucket_of(F.col("term"), buckets).alias("bucket"), "term", segment, "id", impact.alias("impact"))
        dealt = placed.withColumn("file", F.pmod("segment", F.lit(files))).repartition(buckets * files, "bucket", "file")
        block = dealt.groupBy("bucket", "file", "term", "segment").agg(F.sort_array(F.collect_list(F.struct("impact", "id")), asc=False).alias("p"))
        columns = ["term", "segment", F.col("p")[0]["impact"].alias("top"), F.size("p").alias("n"), F.col("p.id").alias("ids"), F.col("p.impact").alias("impacts")]
        block.select("bucket", *columns).sortWithinPartitions("bucket", "term", "segment").write.partitionBy("bucket").parquet(f"{self.path}/blocks")
        whole.select("id", "dl", segment).write.parquet(f"{self.path}/documents")
        self.folder.delete("counted")
        facts = {"n": n, "avgdl": avgdl, "buckets": buckets, "postings": row["postings"], "segments": inside * (len(bounds) + 1), "id": tokens.schema["id"].dataType.simpleString()}
        if not self.folder.create("facts.json", json.dumps(facts)):
            raise RuntimeError(f"another writer has built {self.path}")

    def size(self) -> DataFrame:
        """documents, avg_length."""
        return self.spark.createDataFrame([(self.facts["n"], round(self.facts["avgdl"], 6))], "documents long, avg_length double")

    def _parts(self, table: str, terms: list[str], schema: str) -> DataFrame:
        """The rows of some terms."""
        signed = lambda t: (xxhash.xxh64_intdigest(t, seed=42) ^ 1 << 63) - (1 << 63)
        buckets = sorted({signed(t) % self.facts["buckets"] for t in terms})
        there = [p for p in (f"bucket={b}" for b in buckets) if self.folder.exists(f"{table}/{p}")]
        return read_parts(self.spark, f"{self.path}/{table}", there, schema).where(F.col("term").isin(*terms))

    def weights(self, query: str) -> tuple[dict[str, float], int]:
        """Weight of each indexed term of a query, where a repeated one counts again, and the postings of all."""
        asked = query_terms(query)
        if not asked:
            return {}, 0
        rows = self._parts("terms", sorted(set(asked)), "term string, df long, weight double").collect()
        return {r["term"]: asked.count(r["term"]) * r["weight"] for r in rows}, sum(r["df"] for r in rows)

    def blocks(self, weights: dict[str, float]) -> DataFrame:
        """The blocks of some terms with their weight."""
        rows = self._parts("blocks", sorted(weights), f"term string, segment long, top double, n int, ids array<{self.facts['id']}>, impacts array<double>")
        cases = [F.when(F.col("term") == t, F.lit(w)) for t, w in weights.items()]
        return rows.withColumn("weight", F.coalesce(*cases))

    @staticmethod
    def bounds(blocks: DataFrame) -> DataFrame:
        """segment, bound of the scores in it (terms of negative weight can't raise one), postings."""
        return blocks.groupBy("segment").agg(F.sum(F.greatest(F.col("weight") * F.col("top"), F.lit(0.0))).alias("bound"), F.sum("n").alias("postings"))

    @staticmethod
    def scored(blocks: DataFrame, allowed: DataFrame | None) -> DataFrame:
        """id, score of the documents in some blocks."""
        each = blocks.select("weight", F.explode(F.arrays_zip("ids", "impacts")).alias("p")).select(F.col("p.ids").alias("id"), (F.col("weight") * F.col("p.impacts")).alias("part"))
        each = each if allowed is None else each.join(allowed.select(F.col(allowed.columns[0]).alias("id")), "id", "left_semi")
        return each.groupBy("id").agg(F.round(F.sum("part"), 6).alias("score")).where("score <> 0")

    def _pruned(self, weights: dict[str, float], k: int, allowed: DataFrame | None, first: int) -> tuple[DataFrame, float | None]:
        """The blocks that can hold one of the k best, and the threshold."""
        blocks = self.blocks(weights)
        if self.facts["segments"] <= first:
            return blocks, None
        best = [r["segment"] for r in self.bounds(blocks).orderBy(F.desc("bound"), "segment").limit(first).collect()]
        found = self.scored(blocks.where(F.col("segment").isin(*best)), allowed).orderBy(F.desc("score")).limit(k).collect() if best else []
        if len(found) < k:
            return blocks, None
        least = found[-1]["score"]
        reach = self.bounds(blocks).where(F.col("bound") >= least - 1e-5).select("segment")
        return blocks.join(reach, "segment", "left_semi"), least

    def search(self, query: str, k: int = 10, allowed: DataFrame | None = None, zeros: bool = False, first: int = FIRST, direct: int = DIRECT) -> DataFrame:
        """id, score of the k best documents, ties by id, of those in ``allowed`` (ids, its first column) if given.

        Documents without a term of the query are left out, unless ``zeros``
        asks to fill up with them.
        """
        empty = self.spark.createDataFrame([], f"id {self.facts['id']}, score double")
        weights, postings = self.weights(query)
        if not weights and not zeros:
            return empty
        falls = any(w < 0 for w in weights.values())  # a document with such terms only lies below one without any
        whole = postings <= direct or (zeros and falls)
        found = self.scored(self.blocks(weights) if whole else self._pruned(weights, k, allowed, first)[0], allowed) if weights else empty
        best = lambda rows: rows.orderBy(F.desc("score"), "id").limit(k)
        if not zeros:
            return best(found)
        hits = found if falls else best(found)
        rest = self.documents().select("id")
        rest = rest if allowed is None else rest.join(allowed.select(F.col(allowed.columns[0]).alias("id")), "id", "left_semi")
        rest = rest.join(hits, "id", "left_anti") if falls else rest.orderBy("id").limit(2 * k).join(F.broadcast(hits), "id", "left_anti")
        return best(hits.unionByName(rest.select("id", F.lit(0.0).alias("score"))))

    def documents(self) -> DataFrame:
        """id, dl, segment of all documents."""
        return self.spark.read.schema(f"id {self.facts['id']}, dl long, segment long").parquet(f"{self.path}/documents")

    def report(self, query: str, k: int = 10, allowed: DataFrame | None = None, first: int = FIRST) -> dict:
        """What a pruned search reads: segments, segments_read, postings, postings_read, threshold."""
        weights, _ = self.weights(query)
        kept, least = self._pruned(weights, k, allowed, first)
        total = lambda rows: rows.agg(F.count_distinct("segment").alias("segments"), F.coalesce(F.sum("n"), F.lit(0)).alias("postings")).first()
        every, read = total(self.blocks(weights)), total(kept)
        return {"segments": every["segments"], "segments_read": read["segments"], "postings": every["postings"], "postings_read": read["postings"], "threshold": least}

    def drop_others(self) -> None:
        """Remove the indexes of other versions."""
        root = Folder(self.spark, self.root)
        for name in root.names("index-*"):
            if name != f"index-{self.version}":
                root.delete(name)
