"""Token counts of whole texts (operator 3).

Overlap resynchronisation: a huge document is encoded in overlapping chunks
with token offsets, neighbours are spliced at a common edge that is proven
stable, and the overlap is widened where they don't align
(:meth:`tessera.llm.bytebpe.ByteBpe.ids`). Memory is bounded by the batch and
the longest text.

Defined results: null texts are empty and have 0 tokens; every input row gives
one row (repeated rows too); an empty table gives an empty result; other
columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytebpe
from .base import map_batches, tune

#: Characters of a chunk and of the first overlap; a text over CHUNK is encoded in chunks.
CHUNK, OVERLAP = 1 << 16, 256


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 512, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row."""
    tune(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder = bytebpe.load(tokenizer)
        texts = pc.fill_null(batch.column(1), "")
        n = [len(encoder.ids(x, chunk, overlap)) for x in texts.to_pylist()]
        size = pc.binary_length(texts).cast(pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(np.array(n, dtype=np.int64))], names=["doc_id", "n_bytes", "n_tokens"])

    counted = map_batches(docs.select("doc_id", "text"), work, f"doc_id {id_type}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
