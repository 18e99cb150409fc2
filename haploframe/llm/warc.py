"""WARC archives: writing, revisit resolution by payload digest, and reading back.

Only headers (id, digest, length) are grouped: the smallest page_id of each digest that occurs more than once is the
original. The digests that occur again are broadcast if they are few, so that payloads stay where they were read.
Records that follow an original become revisit records with fresh headers and no payload. Archives are gzip files of
WARC/1.1 records in the shared folder, written by Spark's text writer with a bounded number of records each, and read
as binary files whose records are parsed by their declared lengths from a streaming decompressor.

A null page has an empty payload; payloads under ``least`` bytes are always responses; rows that repeat a page_id with
an equal payload are all responses if that id is the smallest; a page without an id is a revisit where a page with one
has an equal payload, else all such pages are responses; a null page_id or url is written as an absent field and read as
null; an empty table gives an empty archive and an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep, kept_path

LEAST = 100
#: Bounds of an archive: records, and bytes of records before compression (one longer record is an archive of its own).
RECORDS_PER_FILE, BYTES_PER_FILE = 4000, 1 << 30
#: Originals up to this number (some 100 bytes each) are broadcast, more are joined by a shuffle.
BROADCAST_ROWS = 500_000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string"


def headers(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, payload_digest and payload_bytes of every page."""
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    return p.withColumn("payload_digest", F.sha2(F.col("payload").cast("binary"), 256)).withColumn("payload_bytes", F.octet_length("payload").cast("long"))


def resolve(heads: DataFrame, least: int = LEAST) -> DataFrame:
    """Adds refers_to: the smallest page_id of an equal payload, null for the record that keeps the payload."""
    firsts = heads.filter(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    firsts = keep(firsts.select(F.col("payload_digest").alias("first_digest"), "first"), "originals")
    if firsts.count() <= BROADCAST_ROWS:
        firsts = F.broadcast(firsts)
    # Records that have no original to look for take a key of their own, so that short payloads don't gather in one task.
    key = F.when(F.col("payload_bytes") >= least, F.col("payload_digest"))
    found = heads.join(firsts, key == F.col("first_digest"), "left").drop("first_digest")
    # A page without an id is never the smallest, so it refers to the one that is.
    return found.withColumn("refers_to", F.when(F.coalesce(F.col("page_id") > F.col("first"), F.lit(True)), F.col("first"))).drop("first")


def record_id(page_id: Column) -> Column:
    h = F.md5(F.concat(F.lit("page:"), page_id.cast("string")).cast("binary"))
    return F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def records(resolved: DataFrame) -> DataFrame:
    """The text of each record up to its last line end, which the writer adds."""
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit(""))
    again = F.col("refers_to").isNotNull()
    uri = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(again, http).otherwise(F.concat(http, F.col("payload")))
    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), record_id(F.col("page_id")), F.lit(">"))), line("WARC-Date", F.lit(DATE)), line("WARC-Target-URI", uri),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))), line("WARC-Profile", F.when(again, PROFILE)),
        line("WARC-Refers-To", F.concat(F.lit("<urn:uuid:"), record_id(F.col("refers_to")), F.lit(">"))), line("Page-ID", F.col("page_id")), line("Refers-To-Page-ID", F.col("refers_to")),
        line("Payload-Length", F.col("payload_bytes")), F.lit("Content-Type: application/http; msgtype=response\r\n"), line("Content-Length", F.octet_length("block")), F.lit("\r\n"),
    )
    return resolved.withColumn("block", block).select(F.concat(head, F.col("block"), F.lit("\r\n")).alias("value"))


def write_archives(resolved: DataFrame, path: str, per_file: int = RECORDS_PER_FILE, bytes_per_file: int = BYTES_PER_FILE) -> None:
    """Gzip files below path, none with more than a number of records, nor with more bytes than the longest payload allows so many of."""
    largest = resolved.agg(F.max("payload_bytes")).first()[0] or 0
    per_file = max(1, min(per_file, bytes_per_file // (largest + 4096)))
    records(resolved).write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def parse(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of a decompressed stream."""
    held, more = bytearray(), True

    def fill(n: int) -> bool:
        nonlocal more
        while len(held) < n and more:
            part = next(chunks, None)
            if part is None:
                more = False
            else:
                held.extend(part)
        return len(held) >= n

    while fill(1):
        end, size = held.find(b"\r\n\r\n"), 0
        while end < 0:
            size = len(held) + 1
            if not fill(size):
                raise ValueError("a record header has no end")
            end = held.find(b"\r\n\r\n", max(0, size - 4))
        first, *lines = bytes(held[:end]).decode().split("\r\n")
        if not first.startswith("WARC/1."):
            raise ValueError(f"no WARC record begins with {first[:40]!r}")
        fields = dict(x.split(": ", 1) for x in lines)
        n = int(fields["Content-Length"])
        if not fill(end + 4 + n + 4) or held[end + 4 + n : end + 8 + n] != b"\r\n\r\n":
            raise ValueError("a record is shorter than it says")
        block = bytes(held[end + 4 : end + 4 + n])
        del held[: end + 8 + n]
        yield fields, block


def inflated(data: bytes, step: int = 1 << 18) -> Iterator[bytes]:
    """The decompressed bytes of a gzip file in parts, over all its members."""
    while data:
        z = zlib.decompressobj(31)
        for at in range(0, len(data), step):
            if part := z.decompress(data[at : at + step]):
                yield part
            if z.eof:
                data = z.unused_data + data[at + step :]
                break
        else:
            return


def read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    out: list[tuple] = []
    number = lambda x: None if x is None else int(x)
    pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)
    for batch in batches:
        for data in batch.column(0):
            for fields, block in parse(inflated(data.as_py())):
                kind, digest, size = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:"), int(fields["Payload-Length"])
                if kind == "response":
                    payload = memoryview(block)[block.index(b"\r\n\r\n") + 4 :]
                    if hashlib.sha256(payload).hexdigest() != digest or len(payload) != size:
                        raise ValueError(f"the payload of page {fields.get('Page-ID')} differs from its header")
                out.append((number(fields.get("Page-ID")), size, digest, kind, number(fields.get("Refers-To-Page-ID")), fields.get("WARC-Target-URI")))
                if len(out) >= 5000:
                    yield pack(out)
                    out = []
    if out:
        yield pack(out)


def read_archives(spark, path: str) -> DataFrame:
    """One row per record; a response's payload is hashed again and must agree with its header."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content").mapInArrow(read_batches, READ)


def op1_warc_revisits(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = kept_path(spark, "warc")
    write_archives(resolve(headers(pages)), path)
    return read_archives(spark, path).drop("target_uri")


ORACLE = f"""
with p as (select page_id, sha256(coalesce(html, '')) as d, strlen(coalesce(html, ''))::bigint as n from pages),
f as (select d, min(page_id) as m from p where n >= {LEAST} group by d)
select page_id, n as payload_bytes, p.d as payload_digest, case when m < page_id then 'revisit' else 'response' end as record_type, case when m < page_id then m end as refers_to
from p left join f on p.d = f.d and n >= {LEAST}
"""
