"""Greedy line chunker with overlap, as a fold within the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATE = "struct<cur:array<string>,tok:int,start:int,out:array<struct<start_line:int,end_line:int,content:string>>>"


def _tail(lines: Column, characters: int) -> Column:
    """Trailing lines whose summed length is at most ``characters``, with their tokens."""
    kind = "struct<kept:array<string>,size:int,on:boolean>"
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("size"), F.lit(True).alias("on")).cast(kind)
    step = lambda a, x: F.when(a["on"] & (a["size"] + F.length(x) <= characters), F.struct(F.concat(F.array(x), a["kept"]).alias("kept"), (a["size"] + F.length(x)).alias("size"), F.lit(True).alias("on")).cast(kind)).otherwise(F.struct(a["kept"].alias("kept"), a["size"].alias("size"), F.lit(False).alias("on")).cast(kind))
    return F.aggregate(F.reverse(lines), start, step, lambda a: a["kept"])


def line_chunks(content: Column, least: int = 50, most: int = 500, overlap: int = 20, keep_tail: bool = False) -> Column:
    """Array of start_line, end_line, content.

    A line weighs a quarter of its characters. A chunk ends before the line
    that would take it over ``most``, if it has ``least``; the next begins with
    the lines that fit into ``overlap``. The last one needs ``least`` too
    (unless ``keep_tail``); blank ones are left out.
    """
    weight = lambda x: F.floor(F.length(x) / 4).cast("int")
    sum_of = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + weight(x))
    lines = F.split(content, "\n")
    numbered = F.transform(lines, lambda x, i: F.struct(x.alias("x"), (i + 1).alias("n")))
    chunk = lambda cur, start: F.struct(start.alias("start_line"), (start + F.size(cur) - 1).alias("end_line"), F.array_join(cur, "\n").alias("content"))

    def state(cur: Column, tok: Column, start: Column, out: Column) -> Column:
        return F.struct(cur.alias("cur"), tok.alias("tok"), start.alias("start"), out.alias("out")).cast(STATE)

    def step(a: Column, line: Column) -> Column:
        tail = _tail(a["cur"], overlap * 4)
        full = (a["tok"] + weight(line["x"]) > most) & (a["tok"] >= least)
        cut = state(F.concat(tail, F.array(line["x"])), sum_of(tail) + weight(line["x"]), line["n"] - F.size(tail), F.concat(a["out"], F.array(chunk(a["cur"], a["start"]))))
        return F.when(full, cut).otherwise(state(F.concat(a["cur"], F.array(line["x"])), a["tok"] + weight(line["x"]), a["start"], a["out"]))

    empty = state(F.array().cast("array<string>"), F.lit(0), F.lit(1), F.array())
    last = lambda a: F.when((a["tok"] >= least) | F.lit(keep_tail), F.concat(a["out"], F.array(chunk(a["cur"], a["start"])))).otherwise(a["out"])
    return F.filter(F.aggregate(numbered, empty, step, last), lambda c: c["content"].rlike(r"\S"))


def chunked(files: DataFrame, key: list[str], content: str = "text", **options) -> DataFrame:
    """One row for each chunk: the key columns, chunk number, lines, content, token_count."""
    rows = files.select(*key, F.posexplode(line_chunks(F.col(content), **options)).alias("chunk_no", "c"))
    return rows.select(*key, "chunk_no", "c.*", F.floor(F.length("c.content") / 4).cast("long").alias("token_count"))


def sized(chunks: DataFrame, least: int = 50, most: int = 500) -> DataFrame:
    """Chunks between the two sizes, both included."""
    return chunks.where(F.col("token_count").between(least, most))
