"""WARC archives written and read through an index (operator 13).

Writing: a first pass measures every page: digest, size, and the length of its
response record, a gzip member of its own. The index comes before the archives:
digests decide which records are responses and which revisits, a hash deals the
records to archives of about ARCHIVE_BYTES, and running sums of the lengths give
every record's offset; the index has archive, offset, length, url and digest of
each record and is written as a table. It holds the short records, that is
revisits and small responses, as they are; the others are made again in a second pass over the
pages, so that no copy of the payloads lies between. The archives are written by
one task each, in the order of the index. A task writes under a name of its own
and renames at the end, and what it writes follows from the tables alone, so a
task that runs twice does no harm.

Reading: the selected rows of the index are sorted by archive and offset in
Spark, and each task merges neighbours that lie at most GAP bytes apart into
reads of at most READ_BYTES, cuts the records out, and checks the digest and
length of every payload. No archive is read as a whole.

Of records with equal payloads (same SHA-1 and length) of at least ``least``
bytes, that with the largest page_id (null is the smallest; among equal ids by
url, then the last row) is the response, the others revisit it; smaller ones are all
responses. Within a batch of input only the copy that can win keeps its
payload, so a page with many copies is moved about once for each batch.

Defined results: a null html is an empty payload, a null url an empty one; line
ends in urls are written as %0D and %0A (the index keeps the url as it is). Every
input row gives one record, repeated rows and null ids too. An empty table gives
an empty result and no archives. Other columns are ignored. The archives lie in
the session's shared folder, or in a folder that the caller names, by any
scheme that pyarrow's file systems know.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .base import keep, keep_folder, map_batches, release, shared_dir, shuffle_width, tune

#: Payloads from here on are written once.
LEAST = 1000
#: About the size of an archive, where there are more than one for each shuffle partition.
ARCHIVE_BYTES = 256 << 20
#: Records that lie at most GAP bytes apart are read together, READ_BYTES at most at once (or one record).
GAP, READ_BYTES = 64 << 10, 4 << 20
#: Bytes of records that one task reads.
TASK_BYTES = 64 << 20
#: The date of the records, a parameter so that archives of equal tables are equal.
DATE = "2024-01-01T00:00:00Z"

#: Fixed values of the format.
VERSION, PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def member(text: bytes) -> bytes:
    """A gzip member; equal bytes give an equal member."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(text) + packer.flush()


def record_id(own: str, page_id: str | None) -> str:
    """A record's name holds what tells it from all others and, unless null, the page: the digest of a payload of a size that is written once, else the row."""
    return f"<urn:page:{own}>" if page_id is None else f"<urn:page:{own}:{page_id.replace('%', '%25').replace('>', '%3E').replace(chr(13), '%0D').replace(chr(10), '%0A')}>"


def page_of(name: str) -> str | None:
    """The page of a record's name."""
    page = name.removeprefix("<urn:page:").removesuffix(">").partition(":")
    return page[2].replace("%0A", "\n").replace("%0D", "\r").replace("%3E", ">").replace("%25", "%") if page[1] else None


def one_line(url: str | None) -> str:
    return (url or "").replace("\r", "%0D").replace("\n", "%0A")


def record(kind: str, name: str, url: str | None, date: str, digest: str, size: int, payload: bytes = b"", of: tuple[str, str] | None = None) -> bytes:
    """One record as a gzip member; a revisit keeps the response's head and no payload."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size + payload
    lines = [VERSION, f"WARC-Type: {kind}", f"WARC-Record-ID: {name}", f"WARC-Date: {date}", f"WARC-Target-URI: {one_line(url)}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"Content-Length: {len(block)}"]
    if of:
        lines[5:5] = [f"WARC-Refers-To: {of[0]}", f"WARC-Refers-To-Target-URI: {one_line(of[1])}", f"WARC-Profile: {PROFILE}"]
    return member("\r\n".join([*lines, "", ""]).encode() + block + b"\r\n\r\n")


def info(date: str) -> bytes:
    """The record at the head of every archive."""
    block = b"format: WARC File Format 1.1\r\n"
    head = "\r\n".join([VERSION, "WARC-Type: warcinfo", "WARC-Record-ID: <urn:info>", f"WARC-Date: {date}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}", "", ""])
    return member(head.encode() + block + b"\r\n\r\n")


def measured(batch: pa.RecordBatch, least: int, date: str) -> tuple[list[str], list[int], list[bytes | None]]:
    """Digests and sizes of a batch (row, page_id, name, url, html), and the response records of those that may become one.

    Of equal payloads that are written once only the largest page of the batch
    may (null is the smallest, then by url).
    """
    rows, ids, names, urls = (batch.column(k).to_pylist() for k in range(4))
    payloads = pc.fill_null(batch.column(4), "").cast(pa.binary()).to_pylist()
    digests, sizes = [hashlib.sha1(x).hexdigest() for x in payloads], [len(x) for x in payloads]
    order = [(i is not None, i, u is not None, u, k) for k, (i, u) in enumerate(zip(ids, urls))]
    best: dict[tuple[str, int], int] = {}
    for k, key in enumerate(zip(digests, sizes)):
        if sizes[k] >= least and (key not in best or order[k] > order[best[key]]):
            best[key] = k
    made = [record("response", record_id(digests[k] if n >= least else str(rows[k]), names[k]), urls[k], date, digests[k], n, payloads[k]) if n < least or best[digests[k], n] == k else None for k, n in enumerate(sizes)]
    return digests, sizes, made


def rows_of(pages: DataFrame) -> DataFrame:
    """row, page_id, name, url, html."""
    return pages.select(F.monotonically_increasing_id().alias("row"), "page_id", F.col("page_id").cast("string").alias("name"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))


def measure(pages: DataFrame, least: int = LEAST, date: str = DATE) -> DataFrame:
    """Every page's row number, digest and size, the length of its response record if it may become one, and the record itself if it is small."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        digests, sizes, made = measured(batch, least, date)
        columns = [*batch.columns[:4], pa.array(digests, pa.string()), pa.array(sizes, pa.int64()), pa.array([x and len(x) for x in made], pa.int64()), pa.array([x if n < least else None for x, n in zip(made, sizes)], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["row", "page_id", "name", "url", "digest", "size", "length", "short"])

    id_type = pages.schema["page_id"].dataType.simpleString()
    return map_batches(rows_of(pages), work, f"row long, page_id {id_type}, name string, url string, digest string, size long, length long, short binary")


def large_records(pages: DataFrame, least: int = LEAST, date: str = DATE) -> DataFrame:
    """digest, size, name, url and the response record of large payloads, about one for each batch that has a payload."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        digests, sizes, made = measured(batch, least, date)
        kept = [k for k, n in enumerate(sizes) if n >= least and made[k] is not None]
        take = pa.array(kept, pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([digests[k] for k in kept], pa.string()), pa.array([sizes[k] for k in kept], pa.int64()), batch.column(2).take(take), batch.column(3).take(take), pa.array([made[k] for k in kept], pa.binary())], names=["digest", "size", "name", "url", "member"])

    return map_batches(rows_of(pages), work, "digest string, size long, name string, url string, member binary")


def archive_of(archives: int, *by: str) -> Column:
    """The archive that a record is dealt to."""
    return F.pmod(F.xxhash64(*by), F.lit(archives)).cast("int")


def decide(light: DataFrame, least: int = LEAST, date: str = DATE) -> DataFrame:
    """The records without large payloads: type, length, and the bytes of short ones."""
    first = light.where(F.col("size") >= least).groupBy("digest", "size").agg(F.max(F.struct("page_id", "url", "row", "name")).alias("first"), F.count("*").alias("copies"))
    known = light.join(first.where("copies > 1").drop("copies"), ["digest", "size"], "left")
    revisit = F.col("first").isNotNull() & (F.col("first.row") != F.col("row"))
    known = known.select("row", "page_id", "name", "url", "digest", "size", "length", "short", revisit.alias("revisit"), F.when(revisit, F.col("first.name")).alias("of_name"), F.when(revisit, F.col("first.url")).alias("of_url"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        lengths, short, again = batch.column(6).to_pylist(), batch.column(7).to_pylist(), batch.column(8).to_pylist()
        for k in [k for k, x in enumerate(again) if x]:
            row, _, name, url, digest, size, _, _, _, of_name, of_url = (c[k].as_py() for c in batch.columns)
            short[k] = record("revisit", record_id(str(row), name), url, date, digest, size, of=(record_id(digest, of_name), of_url))
            lengths[k] = len(short[k])
        return pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(lengths, pa.int64()), pa.array(["revisit" if x else "response" for x in again], pa.string()), pa.array(short, pa.binary())], names=["row", "page_id", "name", "url", "digest", "size", "length", "record_type", "short"])

    return map_batches(known, work, f"row long, page_id {light.schema['page_id'].dataType.simpleString()}, name string, url string, digest string, size long, length long, record_type string, short binary")


def system(uri: str):
    """The file system of a path that executors share, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_archives(pages: DataFrame, folder: str | None = None, least: int = LEAST, date: str = DATE, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write all pages as archives; returns the index.

    The index has page_id, url, digest, size, record_type, path, offset and
    length of every record. ``folder`` must not have archives yet.
    """
    spark = pages.sparkSession
    tune(spark)
    folder = folder or keep_folder(spark, f"{shared_dir(spark)}/tessera/warc-{uuid.uuid4().hex}")
    light = keep(measure(pages, least, date), "warc-pages")
    volume = light.agg(F.sum("length")).first()[0] or 0
    archives = max(shuffle_width(spark), -(-volume // archive_bytes))
    head = info(date)
    # short records may lie anywhere; a large response lies where its payload's hash says
    decided = decide(light, least, date).withColumn("archive", F.when(F.col("short").isNull(), archive_of(archives, "digest", "size")).otherwise(archive_of(archives, "row")))
    order = [F.col("digest"), F.col("size"), F.when(F.col("short").isNull(), 0).otherwise(2).alias("kind"), F.col("row")]
    before = Window.partitionBy("archive").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = decided.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)) + F.lit(len(head)))
    index = keep(placed.withColumn("path", F.concat(F.lit(folder + "/"), F.format_string("%06d.warc.gz", "archive"))), "warc-index")
    release(light)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = system(folder)
        store.create_dir(top, recursive=True)
        out, archive, wanted, own, count, at = None, None, None, "", 0, 0

        def finish() -> pa.RecordBatch:
            out.close()
            store.move(own, f"{top}/{archive:06d}.warc.gz")
            return pa.RecordBatch.from_arrays([pa.array([archive], pa.int32()), pa.array([count], pa.int64()), pa.array([at], pa.int64())], names=["archive", "records", "bytes"])

        for batch in batches:
            for number, digest, size, kind, _, name, url, offset, text in zip(*(c.to_pylist() for c in batch.columns)):
                if kind != 1:  # a row of the index
                    if number != archive:
                        if out is not None:
                            yield finish()
                        archive, own = number, f"{top}/{number:06d}.{uuid.uuid4().hex}.part"
                        out, count, at = store.open_output_stream(own), 0, len(head)
                        out.write(head)
                    if offset != at:
                        raise ValueError(f"a record would lie at {at}, not at {offset}")
                    wanted = (digest, size, name, url) if kind == 0 else None
                if kind == 2 or wanted == (digest, size, name, url) and kind == 1:
                    out.write(text)
                    at, count, wanted = at + len(text), count + 1, None
        if out is not None:
            yield finish()

    rows = index.select("archive", *order, "name", "url", "offset", F.col("short").alias("member"))
    texts = large_records(pages, least, date).select(archive_of(archives, "digest", "size").alias("archive"), "digest", "size", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("row"), "name", "url", F.lit(0).cast("long").alias("offset"), "member")
    written = rows.union(texts).repartitionById(archives, F.col("archive")).sortWithinPartitions("archive", "digest", "size", "kind", "row").mapInArrow(write, "archive int, records long, bytes long")
    done = written.agg(F.sum("records"), F.sum(F.col("bytes") - len(head))).first()
    asked = index.agg(F.count("*"), F.sum("length")).first()
    if tuple(x or 0 for x in done) != tuple(x or 0 for x in asked):
        raise ValueError(f"{tuple(done)} records and bytes were written of {tuple(asked)}")
    return index.select("page_id", "url", "digest", "size", "record_type", "path", "offset", "length")


def parse(text: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of a record."""
    head, _, rest = text.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if first != VERSION:
        raise ValueError(f"not a record: {first[:40]!r}")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    size = int(fields["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError(f"record {fields.get('warc-record-id')} has another length")
    return fields, rest[:size]


def ranges(rows: list[tuple[str, int, int]], gap: int = GAP, most: int = READ_BYTES) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """Merge sorted (path, offset, length) into (path, start, end, records)."""
    path, start, end, inside = None, 0, 0, []
    for p, offset, length in rows:
        if inside and (p != path or offset > end + gap or offset + length - start > most):
            yield path, start, end, inside
            inside = []
        if not inside:
            path, start, end = p, offset, offset
        inside.append((offset, length))
        end = max(end, offset + length)
    if inside:
        yield path, start, end, inside


def read_records(index: DataFrame, payloads: bool = True, gap: int = GAP, most: int = READ_BYTES) -> DataFrame:
    """The records of these rows of an index: name, url, payload_bytes, payload_digest, record_type, refers_to (a page's id as text) and, if asked for, payload.

    A revisit has the size and digest of the payload that it refers to, and a
    null payload.
    """
    schema = "name string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string" + ", payload binary" * payloads

    def result(found: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*found))
        kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()][: len(columns)]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in schema.split(", ")])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, source = None, None
        for batch in batches:
            for where, start, end, inside in ranges(list(zip(*(c.to_pylist() for c in batch.columns))), gap, most):
                if where != path:
                    if source is not None:
                        source.close()
                    store, local = system(where)
                    path, source = where, store.open_input_file(local)
                data = source.read_at(end - start, start)
                found = []
                for offset, length in inside:
                    fields, block = parse(zlib.decompress(data[offset - start : offset - start + length], 31))
                    head, _, payload = block.partition(b"\r\n\r\n")
                    digest, size = fields["warc-payload-digest"].removeprefix("sha1:"), int(head.rpartition(b": ")[2])
                    kind = fields["warc-type"]
                    if kind == "response" and (hashlib.sha1(payload).hexdigest(), len(payload)) != (digest, size):
                        raise ValueError(f"{where} at {offset}: the payload has another digest or length")
                    of = fields.get("warc-refers-to")
                    found.append((page_of(fields["warc-record-id"]), fields["warc-target-uri"], size, digest, kind, of and page_of(of), payload if kind == "response" else None)[: 6 + payloads])
                yield result(found)
        if source is not None:
            source.close()

    sought = index.select("path", "offset", "length")
    volume = sought.agg(F.sum("length")).first()[0] or 0
    tasks = max(shuffle_width(index.sparkSession), -(-volume // TASK_BYTES))  # by what they read, not by the few bytes of the index
    return sought.repartition(tasks, "path").sortWithinPartitions("path", "offset").mapInArrow(read, schema)


def round_trip(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Write all pages, read all records: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    id_type = pages.schema["page_id"].dataType
    found = read_records(write_archives(pages, least=least), payloads=False)
    return found.select(F.col("name").cast(id_type).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(id_type).alias("refers_to"))


SQL = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
ranked AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS top, row_number() OVER (PARTITION BY html ORDER BY page_id DESC NULLS LAST) AS place FROM p)
SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN n >= {LEAST} AND place > 1 THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= {LEAST} AND place > 1 THEN top END AS refers_to
FROM ranked"""
