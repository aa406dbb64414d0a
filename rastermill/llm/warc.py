"""WARC archives: records written as one gzip member each, and a sequential reader.

Files are written by Spark's own writer, so a lost task's file is not left half written. Spark's text writer puts a
separator after each row: the separator is the zero byte with which a member of under 16 MB ends anyway (its size,
little-endian); a larger member is followed by an empty member, which ends so too.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns, fresh_path, join_counted, written

VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: One date for all records, so that a repeated task writes the same bytes.
DATE = "2024-01-01T00:00:00Z"
#: Uncompressed bytes of an archive by the records' mean size, and bytes of a batch of records read.
ARCHIVE_BYTES, READ_BYTES = 256 << 20, 4 << 20
#: So many payload digests (20 bytes and an id each) may be broadcast.
FEW_PAYLOADS = 200_000
EMPTY_MEMBER = gzip.compress(b"", mtime=0)


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode("ascii")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, digest: str | None = None) -> bytes:
    """A response, or a revisit of the page refers_to whose block keeps the HTTP head but not the payload."""
    digest = digest or sha1_base32(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", " ".join(url.split())))
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = b"".join(f"{k}: {v}\r\n".encode() for k, v in fields)
    return VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def members(data: bytes | pa.Buffer, step: int = 1 << 16) -> Iterator[bytes]:
    """The gzip members of an archive, one after the other, inflated a step at a time. A cut member is an error."""
    view, at = memoryview(data), 0
    while at < len(view):
        inflate, parts = zlib.decompressobj(31), []
        while not inflate.eof:
            if at >= len(view):
                raise ValueError("the archive ends within a gzip member")
            piece = view[at : at + step]
            parts.append(inflate.decompress(piece))
            at += len(piece) - len(inflate.unused_data)
        out = b"".join(parts)
        if out:
            yield out


def parse(data: bytes) -> dict:
    """One record: header fields, block by Content-Length, digests verified. ValueError says what is wrong."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not found or not lines[0].startswith(b"WARC/"):
        raise ValueError("no WARC header")
    fields = {}
    for line in lines[1:]:
        name, _, value = line.decode("utf-8").partition(":")
        fields[name.strip().lower()] = value.strip()
    size = int(fields["content-length"])
    block = rest[:size]
    if len(block) < size or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"record {fields.get('warc-record-id')}: Content-Length {size} doesn't frame its block")
    if (want := fields.get("warc-block-digest")) and want != f"sha1:{sha1_base32(block)}":
        raise ValueError(f"record {fields.get('warc-record-id')}: block digest differs")
    fields["block"] = block
    http, _, payload = block.partition(b"\r\n\r\n")
    fields["payload"], fields["payload_bytes"] = payload, len(payload)
    for line in http.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length":
            fields["payload_bytes"] = int(value)
    if fields["warc-type"] == "response":
        if fields["payload_bytes"] != len(payload):
            raise ValueError(f"record {fields.get('warc-record-id')}: payload of {len(payload)} bytes, {fields['payload_bytes']} announced")
        if (want := fields.get("warc-payload-digest")) and want != f"sha1:{sha1_base32(payload)}":
            raise ValueError(f"record {fields.get('warc-record-id')}: payload digest differs")
    return fields


def read_records(data: bytes | pa.Buffer) -> Iterator[dict]:
    yield from map(parse, members(data))


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for page_id, url, payload, refers_to in zip(*columns(batch, "page_id", "url", "payload", "refers_to"), strict=True):
            data = member(record(page_id, url, payload, refers_to))
            if data[-1]:
                data += EMPTY_MEMBER
            out.append(data[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])


def _read(with_payload: bool):
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def number(x: str | None) -> int | None:
        return int(n) if x and (n := x.strip("<>").rpartition(":")[2]) else None

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(batch.schema.get_field_index("content")):
                rows, size = [], 0
                for r in read_records(data.as_buffer()):
                    rows.append((number(r["warc-record-id"]), r["payload_bytes"], r["warc-payload-digest"].removeprefix("sha1:"), r["warc-type"], number(r.get("warc-refers-to")), r.get("warc-target-uri"), r["payload"] if with_payload else None))
                    size += 200 + (len(r["payload"]) if with_payload else 0)
                    if size > READ_BYTES:
                        yield out(rows)
                        rows, size = [], 0
                if rows:
                    yield out(rows)

    return run


def write_archives(pages: DataFrame, path: str, revisit_bytes: int = 0) -> list[str]:
    """Write (page_id, url, html) as *.warc.gz under path and return the files.

    Of pages with equal payloads of at least revisit_bytes bytes the smallest page_id is a response and the others
    revisit it. A null html is an empty payload, a null url leaves its field out, a null page_id is a response without a
    number; repeated rows of the smallest id are responses each. An empty table writes no record.
    """
    spark = pages.sparkSession
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")).withColumn("key", F.unhex(F.sha1("payload")))
    about = rows.agg(F.count("*").alias("n"), F.sum(F.length("payload")).alias("bytes")).first()
    # the payloads stay where they are: only keys of several pages, with their smallest page, go to them
    same = rows.where(F.length("payload") >= revisit_bytes).groupBy("key").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    same = written(same, "repeated-payloads")
    if same.count() <= FEW_PAYLOADS:
        met = rows.join(F.broadcast(same.drop("n")), "key", "left")
    else:
        met = join_counted(rows, same, "key", "n", "left")
    typed = met.select("page_id", "url", "payload", F.when(F.col("first_id") < F.col("page_id"), F.col("first_id")).alias("refers_to"))
    each = max(1, ARCHIVE_BYTES * about["n"] // max(1, (about["bytes"] or 0) + 500 * about["n"]))
    out = typed.mapInArrow(_write, "value binary").select(F.col("value").cast("string").alias("value"))
    out.write.option("lineSep", "\u0000").option("maxRecordsPerFile", each).text(path)
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = []
    for status in fs.listStatus(folder):  # a few names; the data stay where they are
        name = status.getPath().getName()
        if name.startswith("part-"):
            new = jvm.org.apache.hadoop.fs.Path(folder, name.removesuffix(".txt") + ".warc.gz")
            fs.rename(status.getPath(), new)
            files.append(new.toString())
    return files


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """The records of the *.warc.gz files under path, in the order of each file. A broken record fails the read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).select("content")
    out = files.mapInArrow(_read(with_payload), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary")
    return out if with_payload else out.drop("payload")


def query(pages: DataFrame) -> DataFrame:
    """op8: archives of all pages in the shared folder, read back."""
    path = fresh_path(pages.sparkSession, "warc")
    write_archives(pages, path)
    return read_archives(pages.sparkSession, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: The digest in base32: each ten hexadecimal digits are eight letters of five bits.
_BASE32 = f"""array_to_string(list_transform(range(0, 32), lambda i: substr('{_LETTERS}',
  ((('0x' || substr(h, (1 + 10 * (i // 8))::INT, 10))::BIGINT >> (35 - 5 * (i % 8))) & 31)::INT + 1, 1)), '')"""
SQL = f"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT t, min(page_id) AS first_id FROM p GROUP BY t)
SELECT page_id, strlen(p.t)::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id < page_id THEN first_id END AS refers_to, url
FROM p JOIN f ON p.t = f.t
"""
