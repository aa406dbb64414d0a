"""Substring dedup: a log-structured index of window fingerprints.

Documents come in batches of ascending doc_id. A batch's windows (20 words each) are fingerprinted, sorted and sent to
buckets of the hash range, where they are merge-joined with the sorted immutable runs of all earlier batches; what is
new becomes the next run, and when the runs are many the merge writes one compacted run in their place. A match on the
64-bit key counts only if a second, independent hash of the same bytes agrees. The runs are a bucketed table in the
shared folder, so history isn't shuffled again. Each unit learns which of its windows stand earlier, and drops every
word that such a window covers.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete, fresh_path, pack_sorted, partitions, release, unpack_sorted, window_hashes, window_starts, written, written_at
from .units import NO_ID, Unit, bucket_bounds, each_unit, narrow, opened, rows_of, units, wide

WINDOW = 20
BATCHES = 4
#: With so many runs the next merge writes one compacted run.
MAX_RUNS = 2
#: Text bytes of a batch that one bucket takes on average, and fewest buckets.
BUCKET_BYTES, MIN_BITS = 4 << 20, 6
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def fingerprints(unit: Unit, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys, check tags, first words and documents of a unit's windows, in order of document and start."""
    at, doc = window_starts(unit.first, window)
    keys, tags = (window_hashes(unit.hashes[lane], window, lane) for lane in (0, 1))
    return keys[at], (tags[at] >> np.uint64(32)).astype(np.uint32), at, doc


def _ordered(keys: np.ndarray, tags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by (key, tag), and where in it each distinct pair begins."""
    order = np.argsort(keys, kind="stable")
    k, t = keys[order], tags[order]
    mixed = np.flatnonzero((k[1:] == k[:-1]) & (t[1:] != t[:-1]))
    if len(mixed):  # one key, different tags: order those rows by tag as well
        order = np.lexsort((tags, keys))
        k, t = keys[order], tags[order]
    return order, np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (t[1:] != t[:-1])])) if len(k) else np.zeros(0, np.int64)


def _prints(window: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, unit in each_unit(batches):
            keys, tags, _, doc = fingerprints(unit, window)
            order, begins = _ordered(keys, tags)
            chosen = order[begins]
            keys, tags = keys[chosen], tags[chosen]
            docs = unit.doc_ids[doc[chosen]] if len(chosen) else np.zeros(0, np.int64)
            base = int(docs.min()) if len(docs) else 0
            docs = (docs - base).view(np.uint64)  # extreme ids wrap around, and back in the merge
            parts = bucket_bounds(keys, bits)
            if parts:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b for b, _, _ in parts], pa.int32()), pa.array([number] * len(parts), pa.int64()), pa.array([base] * len(parts), pa.int64()), *(pa.array([f(x[a:z]) for _, a, z in parts], pa.binary()) for x, f in ((keys, pack_sorted), (tags, np.ndarray.tobytes), (docs, narrow)))],
                    names=["bucket", "unit_id", "base", "keys", "tags", "docs"],
                )

    return run


PRINTS = "bucket int, unit_id long, base long, keys binary, tags binary, docs binary"
MERGED = "kind int, bucket int, unit_id long, keys binary, tags binary"


def _merge(compact: bool, keep: bool):
    """kind 0: per unit, the windows that stand earlier elsewhere; kind 1: the new run of the bucket."""

    def run(new: pa.Table, old: pa.Table) -> pa.Table:
        keys, tags, docs, owner, numbers = [], [], [], [], []
        bucket = None
        for k, t in rows_of(old, "keys", "tags"):
            keys.append(unpack_sorted(k))
            tags.append(np.frombuffer(t, np.uint32))
            docs.append(np.full(len(tags[-1]), np.iinfo(np.int64).min))
            owner.append(np.full(len(tags[-1]), -1, np.int64))
        if old.num_rows:
            bucket = old.column("bucket")[0].as_py()
        for b, number, base, k, t, d in sorted(rows_of(new, "bucket", "unit_id", "base", "keys", "tags", "docs"), key=lambda r: r[1]):
            bucket = b
            keys.append(unpack_sorted(k))
            tags.append(np.frombuffer(t, np.uint32))
            docs.append(wide(d, len(tags[-1])) + base)
            owner.append(np.full(len(tags[-1]), len(numbers), np.int64))
            numbers.append(number)
        keys, tags, docs, owner = map(np.concatenate, (keys, tags, docs, owner))
        order = np.lexsort((owner, docs, tags, keys))
        keys, tags, owner = keys[order], tags[order], owner[order]
        again = np.concatenate([[False], (keys[1:] == keys[:-1]) & (tags[1:] == tags[:-1])])
        out: list[list] = [[], [], [], [], []]
        found = np.flatnonzero(again & (owner >= 0))
        found = found[np.argsort(owner[found], kind="stable")]
        edges = np.searchsorted(owner[found], np.arange(len(numbers) + 1))
        for i, number in enumerate(numbers):
            some = found[edges[i] : edges[i + 1]]
            if len(some):
                for column, x in zip(out, (0, bucket, number, pack_sorted(keys[some]), tags[some].tobytes()), strict=True):
                    column.append(x)
        fresh = ~again if compact else ~again & (owner >= 0)
        if keep and fresh.any():
            for column, x in zip(out, (1, bucket, None, pack_sorted(keys[fresh]), tags[fresh].tobytes()), strict=True):
                column.append(x)
        return pa.table([pa.array(c, k) for c, k in zip(out, (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["kind", "bucket", "unit_id", "keys", "tags"])

    return run


def _flagged(keys: np.ndarray, tags: np.ndarray, found_keys: np.ndarray, found_tags: np.ndarray) -> np.ndarray:
    """Which of the distinct ascending (key, tag) pairs are among the found ones."""
    out = np.zeros(len(keys), bool)
    at = np.searchsorted(keys, found_keys)
    fits = (at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == found_keys) & (tags[np.minimum(at, len(keys) - 1)] == found_tags) if len(keys) else np.zeros(len(at), bool)
    out[at[fits]] = True
    for i in np.flatnonzero(~fits):  # a key with several tags
        j = at[i]
        while j < len(keys) and keys[j] == found_keys[i]:
            out[j] |= tags[j] == found_tags[i]
            j += 1
    return out


def _apply(window: int, with_text: bool):
    def run(unit_rows: pa.Table, verdicts: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], [], []]
        for ids, body in rows_of(unit_rows, "doc_ids", "body"):
            unit = opened(ids, body)
            keys, tags, at, _ = fingerprints(unit, window)
            order, begins = _ordered(keys, tags)
            again = np.ones(len(keys), bool)
            again[order[begins]] = False
            distinct = _flagged_any(keys[order[begins]], tags[order[begins]], verdicts)
            again[order[begins[distinct]]] = True
            starts, n = at[again], int(unit.first[-1])
            cover = np.zeros(n + 1, np.int64)
            np.add.at(cover, starts, 1)
            np.add.at(cover, starts + window, -1)
            removed = np.cumsum(cover)[:n] > 0
            total = np.concatenate([[0], np.cumsum(removed)])
            for i, doc_id in enumerate(unit.doc_ids.tolist()):
                a, z = unit.first[i], unit.first[i + 1]
                gone = int(total[z] - total[a])
                text = unit.texts[i] if not gone else b" ".join(w for w, r in zip(unit.words(i), removed[a:z].tolist(), strict=True) if not r)
                for column, x in zip(out, (None if doc_id == NO_ID else doc_id, int(z - a), gone, hashlib.sha256(text).hexdigest(), text.decode("utf-8", "surrogatepass") if with_text else None), strict=True):
                    column.append(x)
        return pa.table([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return run


def _flagged_any(keys: np.ndarray, tags: np.ndarray, verdicts: pa.Table) -> np.ndarray:
    out = np.zeros(len(keys), bool)
    for k, t in rows_of(verdicts, "keys", "tags"):
        out |= _flagged(keys, tags, unpack_sorted(k), np.frombuffer(t, np.uint32))
    return out


class Index:
    """Sorted immutable runs of window fingerprints, as a table bucketed by hash range in the shared folder.

    add() takes a batch whose documents all come after those of earlier batches, returns its rows without repeated
    passages, and appends the batch's run. bits is fixed for an index: 2^bits hash ranges.
    """

    def __init__(self, spark: SparkSession, bits: int, window: int = WINDOW, max_runs: int = MAX_RUNS):
        self.spark, self.bits, self.window, self.max_runs = spark, bits, window, max_runs
        self.runs: list[tuple[str, str]] = []  # table name and folder
        self.count = 0
        self.tables = max(partitions(spark), 1 << max(0, bits - 2))

    def history(self) -> DataFrame:
        if not self.runs:
            return self.spark.createDataFrame([], "bucket int, keys binary, tags binary")
        return self.spark.table(self.runs[0][0]).where("kind = 1").select("bucket", "keys", "tags")

    def _append(self, merged: DataFrame, compact: bool) -> tuple[str, str]:
        """Write verdicts (kind 0) and the run (kind 1) from where the merge made them; a compacted run gets a table of its own."""
        fresh = compact or not self.runs
        name, path = (f"window_runs_{uuid.uuid4().hex}", fresh_path(self.spark, "window-runs")) if fresh else self.runs[0]
        merged.write.partitionBy("kind").bucketBy(self.tables, "bucket").mode("append").format("parquet").option("compression", "zstd").option("path", path).saveAsTable(name)
        if fresh:
            self.drop()
            self.runs = [(name, path)]
        self.count += 1
        return name, path

    def drop(self) -> None:
        for name, path in self.runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            delete(self.spark, path)
        self.runs, self.count = [], 0

    def save(self, path: str) -> None:
        """A snapshot of the runs for open() in a later session: path must be new, and is whole once its folder `index` is there.

        A snapshot is taken between batches, so one that failed halfway is never in it and can be added again.
        """
        root = path.rstrip("/")
        self.history().write.option("compression", "zstd").parquet(f"{root}/runs")
        row = [(self.bits, self.window, self.max_runs, self.count)]
        self.spark.createDataFrame(row, "bits int, window int, max_runs int, count int").coalesce(1).write.parquet(f"{root}/index")

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Index:
        """The index of a snapshot, which stays as it is: its runs are dealt over this session's buckets once."""
        root = path.rstrip("/")
        made = spark.read.parquet(f"{root}/index").first()
        index = cls(spark, made["bits"], made["window"], made["max_runs"])
        if made["count"]:
            rows = spark.read.schema("bucket int, keys binary, tags binary").parquet(f"{root}/runs")
            runs = rows.select(F.lit(1).alias("kind"), "bucket", F.lit(None).cast("long").alias("unit_id"), "keys", "tags")
            index._append(runs.repartition(index.tables, "bucket"), True)
            index.count = made["count"]
        return index

    def add(self, docs: DataFrame, keep: bool = True, with_text: bool = False) -> DataFrame:
        batch, units_path = written_at(units(docs), "units")
        prints = batch.mapInArrow(_prints(self.window, self.bits), PRINTS).repartition(self.tables, "bucket")
        compact = keep and self.count >= self.max_runs
        merged = prints.groupBy("bucket").cogroup(self.history().groupBy("bucket")).applyInArrow(_merge(compact, keep), MERGED)
        if keep:
            name, path = self._append(merged, compact)
            found = self.spark.table(name)
        else:
            found, path = written_at(merged, "verdicts")
        release(self.spark)
        verdicts = found.where("kind = 0").select("unit_id", "keys", "tags")
        out = written(batch.groupBy("unit_id").cogroup(verdicts.groupBy("unit_id")).applyInArrow(_apply(self.window, with_text), RESULT), "deduplicated")
        if keep:
            self.spark.sql(f"ALTER TABLE {name} DROP IF EXISTS PARTITION (kind = 0)")
        delete(self.spark, f"{path}/kind=0" if keep else path)
        delete(self.spark, units_path)
        release(self.spark)
        return out


def dedup(docs: DataFrame, window: int = WINDOW, batches: int = BATCHES, max_runs: int = MAX_RUNS, with_text: bool = False) -> DataFrame:
    """(doc_id, text) -> doc_id, n_words, n_removed, kept_sha256, kept (the text, if asked for).

    Words are runs of characters other than space and \\x09-\\x0D; null and empty texts have none and keep an empty
    text. A null doc_id comes last. Rows of one doc_id are taken one after the other, each on its own.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marks = [i / batches for i in range(1, batches)]
    about = rows.agg(F.sum(F.octet_length("text")).alias("bytes"), F.percentile_approx("doc_id", marks, 10_000).alias("at") if marks else F.lit(None).alias("at")).first()
    bits = max(MIN_BITS, math.ceil(math.log2(max(1, (about["bytes"] or 0) / batches / BUCKET_BYTES))) + 2)
    index, out = Index(spark, bits, window, max_runs), None
    edges = sorted(set(about["at"] or []))
    for i in range(len(edges) + 1):
        here = F.lit(True)
        if i > 0:
            here &= F.col("doc_id").isNull() | (F.col("doc_id") > edges[i - 1])
        if i < len(edges):
            here &= F.col("doc_id") <= edges[i]
        elif not i:
            here = F.lit(True)
        part = index.add(rows.where(here), keep=i < len(edges), with_text=with_text)
        out = part if out is None else out.unionByName(part)
    index.drop()
    return out


def query(docs: DataFrame) -> DataFrame:
    """op1: as dedup()."""
    return dedup(docs).drop("kept")
