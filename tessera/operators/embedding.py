"""Embeddings kept by content, and a remote embedder."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import Folder
from .store import Store


def content_hash(content: str = "content") -> Column:
    """The key of a text; null is empty."""
    return F.sha2(F.coalesce(F.col(content), F.lit("")), 256)


class EmbeddingMemo:
    """A table of embeddings by content hash, with a time to live, a bound, and statistics of every use.

    A use embeds the texts that the memo doesn't hold, writes them into the
    buckets of their hashes, and joins. Beyond ``most`` rows the oldest go (of
    equal age, by hash).
    """

    def __init__(self, spark: SparkSession, path: str, seconds: float = 7 * 24 * 3600, most: int = 10_000_000, clock: Callable[[], float] = time.time):
        self.spark, self.seconds, self.most, self.clock, self.folder = spark, seconds, most, clock, Folder(spark, path)
        self.rows, self.uses = Store(spark, f"{path}/rows", "content_hash"), Store(spark, f"{path}/uses", "use", buckets=1)

    def embed(self, chunks: DataFrame, embed: Callable[[Column], Column], content: str = "content") -> DataFrame:
        """``chunks`` with content_hash, embedding and embedding_status; blank texts and those that fail have none and stay."""
        now = self.clock()
        keyed = chunks.withColumn("content_hash", content_hash(content))
        asked = keyed.where(F.trim(F.col(content)) != "").select("content_hash", F.col(content).alias("text_")).dropDuplicates(["content_hash"])
        held = self.rows.read()
        live = None if held is None else held.where(F.col("made_at") > now - self.seconds)
        missing = asked if live is None else asked.join(live.select("content_hash"), "content_hash", "left_anti")
        name = f"made-{uuid.uuid4().hex}"  # written first, so that no plan embeds a text twice
        missing.select("content_hash", embed(F.col("text_")).alias("embedding"), F.lit(now).alias("made_at")).write.parquet(f"{self.folder.path}/{name}")
        self.rows.upsert(self.spark.read.parquet(f"{self.folder.path}/{name}").where("embedding is not null"))
        self.folder.delete(name)
        made = self.rows.read()
        counts = asked.join(made.select("content_hash", "made_at"), "content_hash", "left").agg(F.count(F.lit(1)).alias("asked"), F.count_if(F.col("made_at") < now).alias("hits"), F.count_if(F.col("made_at") == now).alias("made")).first()
        known = made.where(F.col("made_at") > now - self.seconds)  # what this use reads stays until the next one
        evicted = self._evict(now)
        self.uses.upsert(self.spark.createDataFrame([(self._uses(), now, counts["asked"], counts["hits"], counts["made"], counts["asked"] - counts["hits"] - counts["made"], evicted)], "use long, at double, asked long, hits long, made long, failed long, evicted long"))
        joined = keyed.join(known.select("content_hash", "embedding"), "content_hash", "left")
        return joined.withColumn("embedding_status", F.when(F.col("embedding").isNull(), "failed").otherwise("completed"))

    def _uses(self) -> int:
        held = self.uses.read()
        return held.count() if held is not None else 0

    def _evict(self, now: float) -> int:
        """Drop what is too old, then the oldest rows beyond the bound; rows dropped."""
        held = self.rows.read()
        ages = {r["made_at"]: r["n"] for r in held.groupBy("made_at").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row for each use within the time to live
        gone, total = 0, sum(n for at, n in ages.items() if at > now - self.seconds)
        drop = F.col("made_at") <= now - self.seconds
        for at in sorted(at for at in ages if at > now - self.seconds):
            excess = total - self.most
            if excess <= 0:
                break
            if ages[at] <= excess:
                drop, total = drop | (F.col("made_at") == at), total - ages[at]
            else:
                last = held.where(F.col("made_at") == at).select("content_hash").orderBy("content_hash").offset(excess - 1).first()[0]
                drop, total = drop | ((F.col("made_at") == at) & (F.col("content_hash") <= last)), self.most
        gone = sum(ages.values()) - total
        if gone:
            self.rows.change(drop)
        return gone

    def stats(self) -> DataFrame:
        """use, at, asked, hits, made, failed, evicted and hit_rate of every use."""
        return self.uses.read().withColumn("hit_rate", F.round(F.col("hits") / F.greatest("asked", F.lit(1)), 6))


class RemoteClient:
    """Embeds texts by HTTP: posts {"input": [...]} and reads {"data": [{"index", "embedding"}]}.

    A busy answer (429) is waited out for as long as it says; other faults are
    tried again with doubled waits. A batch that keeps failing is sent text by
    text, so one bad text doesn't take the others with it.
    """

    def __init__(self, url: str, batch: int = 20, at_once: int = 4, tries: int = 4, wait: float = 0.5, longest: float = 60.0, timeout: float = 30.0, headers: dict[str, str] | None = None):
        self.url, self.batch, self.at_once, self.tries, self.wait, self.longest, self.timeout = url, batch, at_once, tries, wait, longest, timeout
        self.headers = {"Content-Type": "application/json", **(headers or {})}

    def _post(self, texts: list[str]) -> list[list[float]] | None:
        """The embeddings, or None after the last try."""
        delay, tried = self.wait, 0
        while True:
            try:
                request = urllib.request.Request(self.url, json.dumps({"input": texts}).encode(), self.headers)
                with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                    rows = json.load(answer)["data"]
                if len(rows) != len(texts):
                    raise ValueError("another number of embeddings")
                return [r["embedding"] for r in sorted(rows, key=lambda r: r["index"])]
            except urllib.error.HTTPError as error:
                if error.code in (400, 413, 422):  # the texts' own fault
                    return None
                pause = float(error.headers.get("Retry-After") or delay) if error.code == 429 else delay
            except (OSError, ValueError, KeyError):
                pause = delay
            tried, delay = tried + 1, min(delay * 2, self.longest)
            if tried >= self.tries:
                return None
            time.sleep(min(pause, self.longest))

    def embed(self, texts: list[str]) -> list[list[float] | None]:
        """The embedding of each text, None where it failed."""
        found = self._post(texts)
        if found is None and len(texts) > 1:
            return [x for t in texts for x in self.embed([t])]
        return found if found is not None else [None]

    def embed_all(self, texts: list[str]) -> list[list[float] | None]:
        """The same in batches, several at once."""
        parts = [texts[k : k + self.batch] for k in range(0, len(texts), self.batch)]
        with ThreadPoolExecutor(self.at_once) as pool:
            return [x for part in pool.map(self.embed, parts) for x in part]


def remote_embedder(url: str, **settings) -> Callable[[Column], Column]:
    """An embedder that asks a service; the number of partitions times ``at_once`` bounds the requests under way."""

    @F.pandas_udf("array<float>")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        client = RemoteClient(url, **settings)
        for texts in batches:
            yield pd.Series(client.embed_all(texts.fillna("").tolist()), dtype=object)

    return lambda text: ask(text)
