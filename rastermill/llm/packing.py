"""Packing along a space-filling curve.

Each document's token counts are hashed into a short vector, projected to three dimensions and placed on a Hilbert
curve. The curve's order is a range sort by (Hilbert key, doc_id); each range is laid out along the curve into
sequences without a gap, documents being cut where a sequence is full. Only a range's last sequence is padded.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, partitions_of, small_batches, written

SEQUENCE = 1024
SEPARATOR_ID = 0
VECTOR, DIMENSIONS, CURVE_BITS = 256, 3, 10
#: Stored bytes of token ids to a range, so that tasks don't grow with the corpus.
RANGE_BYTES = 32 << 20
_PROJECTION = np.random.default_rng(3).normal(0, 1, (VECTOR, DIMENSIONS))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Tokenizer:
    """Ids of a byte-level BPE file of the tokenizers library, as encode(text, add_special_tokens=False) gives them.

    The same merges run in tiktoken, five times as fast; a probe at the start, any error and texts that hold the string
    of an added token go back to the library.
    """

    _PROBE = "It's  a  prøbe: 'tis 1234 words\n\n and\t signs ...\r\n 中文 \U0001f600 ende é"

    def __init__(self, path: str):
        from tokenizers import Tokenizer as Library

        self.library = Library.from_file(path)
        self.fast = None
        try:
            import public_tokenizers
            import tiktoken

            with open(path, encoding="utf-8") as f:
                vocabulary = json.load(f)["model"]["vocab"]
            alphabet = self._alphabet()
            special = {t.content for t in self.library.get_added_tokens_decoder().values()}
            self.added = re.compile("|".join(map(re.escape, sorted(special))) or "(?!)")
            ranks = {bytes(alphabet[c] for c in token): i for token, i in vocabulary.items() if token not in special}
            fast = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            if fast.encode_ordinary(self._PROBE) == self.library.encode(self._PROBE, add_special_tokens=False).ids:
                self.fast = fast
        except Exception:  # another kind of file: the library alone
            self.fast = None

    @staticmethod
    def _alphabet() -> dict[str, int]:
        """The printable stand-ins of bytes in byte-level BPE files: visible Latin-1 stands for itself, others from U+0100 on."""
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in set(own)]
        return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(other)}

    def ids(self, text: str) -> list[int]:
        if self.fast is not None and not self.added.search(text):
            try:
                return self.fast.encode_ordinary(text)
            except BaseException as e:  # a panic of the fast encoder on an extreme text
                if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                    raise
        return self.library.encode(text, add_special_tokens=False).ids


_LOADED: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    if path not in _LOADED:
        _LOADED[path] = Tokenizer(path)
    return _LOADED[path]


def hilbert(points: np.ndarray, bits: int = CURVE_BITS) -> np.ndarray:
    """Positions on the Hilbert curve of integer points (rows) with coordinates under 2^bits, after Skilling (2004)."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            x[i] = x[i] ^ t if i else x[i]
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(ids: list[np.ndarray]) -> np.ndarray:
    """Hilbert keys of token sequences: hashed counts, square roots, unit length, projection, squashed coordinates."""
    v = np.zeros((len(ids), VECTOR))
    for row, x in zip(v, ids, strict=True):
        row += np.bincount((x.astype(np.uint64) * np.uint64(2654435761) >> np.uint64(7)).astype(np.int64) % VECTOR, minlength=VECTOR)
    v = np.sqrt(v)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    y = (v - 1 / np.sqrt(VECTOR)) @ _PROJECTION
    return hilbert(np.clip(((np.tanh(y) + 1) / 2 * (1 << CURVE_BITS)).astype(np.int64), 0, (1 << CURVE_BITS) - 1))


def _tokenized(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path or default_tokenizer()).ids
        for batch in small_batches(batches, "text", 1 << 20):
            doc_ids, texts = columns(batch, "doc_id", "text")
            ids = [np.array([*encode(t or ""), SEPARATOR_ID], np.uint32) for t in texts]
            keys = curve_keys(ids)
            small = all(int(x.max()) < 1 << 16 for x in ids)
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(keys, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.astype("<u2" if small else "<u4").tobytes() for x in ids], pa.binary())], names=["doc_id", "key", "doc_tokens", "ids"])

    return run


def _packed(sequence: int):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, used = TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            out: list[list[int]] = [[] for _ in names]
            for doc_id, total, blob in zip(*columns(batch, "doc_id", "doc_tokens", "ids"), strict=True):
                ids, start = np.frombuffer(blob, "<u2" if len(blob) == 2 * total else "<u4").astype("<u4"), 0
                while start < total:
                    n = min(sequence - used, total - start)
                    for column, x in zip(out, (doc_id, start, n, zlib.crc32(ids[start : start + n]), total, number, used), strict=True):
                        column.append(x)
                    start, used = start + n, used + n
                    if used == sequence:
                        number, used = number + 1, 0
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=names)

    return run


def pack(docs: DataFrame, tokenizer_path: str | None = None, sequence: int = SEQUENCE) -> DataFrame:
    """Pieces of all documents in sequences of at most `sequence` tokens.

    A null or empty text is the separator id alone. Copies have one key; doc_id spreads them over ranges. Repeated
    doc_ids are packed each, a null doc_id as well. Token ids are written once in the shared folder, so the range sort
    and lost executors repeat no tokenizing.
    """
    ids = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_tokenized(tokenizer_path), "doc_id long, key long, doc_tokens long, ids binary"), "token-ids")
    along = ids.repartitionByRange(partitions_of(ids, RANGE_BYTES), "key", "doc_id").sortWithinPartitions("key", "doc_id", "ids")
    return along.mapInArrow(_packed(sequence), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def query(docs: DataFrame) -> DataFrame:
    """op7: as pack()."""
    return pack(docs)
