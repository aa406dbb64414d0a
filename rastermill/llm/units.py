"""Units of documents and the exchange of their sorted hashes.

A unit is a row with some 2 MB of whole documents, their words joined by single spaces, compressed. Operators hash a
unit's word windows, send the sorted distinct hashes to buckets of the hash range, and get back, per unit, what its
bucket found out about them. A hash that stands in a third of all documents is sent once a unit, so no bucket is hot.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, split_words, trim, word_hashes

UNIT_BYTES = 2 << 20
UNIT = "unit_id long, doc_ids binary, body binary"
#: Stands for a null doc_id inside a unit; it sorts last.
NO_ID = (1 << 63) - 1


@dataclass
class Unit:
    """Documents in ascending doc_id: texts of words joined by one space, the words' two hashes, and each document's first word."""

    doc_ids: np.ndarray
    texts: list[bytes]
    hashes: np.ndarray
    first: np.ndarray

    def words(self, doc: int) -> list[bytes]:
        return self.texts[doc].split(b" ") if self.texts[doc] else []


def opened(doc_ids: bytes, body: bytes) -> Unit:
    texts = zstandard.ZstdDecompressor().decompress(body).split(b"\n")
    words, first = split_words(texts)
    return Unit(np.frombuffer(doc_ids, np.int64), texts, word_hashes(words), first)


def _units(lower: bool, limit: int):
    def packed(number: int, rows: list[tuple[int, bytes]], packer) -> tuple:
        rows.sort(key=lambda r: r[0])
        return number, np.array([i for i, _ in rows], np.int64).tobytes(), packer.compress(b"\n".join(t for _, t in rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        number, rows, size = TaskContext.get().partitionId() << 32, [], 0
        out = lambda r: pa.RecordBatch.from_arrays([pa.array([r[0]], pa.int64()), pa.array([r[1]], pa.binary()), pa.array([r[2]], pa.binary())], names=["unit_id", "doc_ids", "body"])
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for k in range(batch.num_rows):
                i, t = ids[k].as_py(), texts[k].as_py()
                data = (t or "").encode("utf-8", "surrogatepass")
                data = b" ".join((data.lower() if lower else data).split())
                if rows and size + len(data) > limit:
                    yield out(packed(number, rows, packer))
                    number, rows, size = number + 1, [], 0
                rows.append((NO_ID if i is None else i, data))
                size += len(data) + 1
        if rows:
            yield out(packed(number, rows, packer))
        trim()

    return run


def units(docs: DataFrame, lower: bool = False, limit: int = UNIT_BYTES) -> DataFrame:
    """(doc_id, text) -> units. bytes.split() cuts at space and \\x09-\\x0D only, and bytes.lower() changes A-Z only."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_units(lower, limit), UNIT)


def bucket_bounds(values: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of the non-empty buckets of ascending hashes, by their upper bits."""
    at = np.searchsorted(values, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.zeros(0, np.int64)
    edges = [0, *at.tolist(), len(values)]
    return [(b, x, y) for b, (x, y) in enumerate(zip(edges, edges[1:])) if y > x]


def narrow(values: np.ndarray) -> bytes:
    """Non-negative integers at 2, 4 or 8 bytes each."""
    top = int(values.max()) if len(values) else 0
    return values.astype(np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64).tobytes()


def wide(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(blob, {2: np.uint16, 4: np.uint32, 8: np.uint64}[len(blob) // n] if n else np.uint16).astype(np.int64)


def rows_of(table: pa.Table, *names: str) -> list[tuple]:
    return list(zip(*(table.column(n).to_pylist() for n in names), strict=True)) if table.num_rows else []


def each_unit(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Unit]]:
    for batch in batches:
        for number, ids, body in zip(*columns(batch, "unit_id", "doc_ids", "body"), strict=True):
            yield number, opened(ids, body)
    trim()
