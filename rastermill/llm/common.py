"""What the text operators share: tables in the shared folder, sizes, and hashing of word windows."""

from __future__ import annotations

import atexit
import ctypes
import gc
import math
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MALLOC_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)

#: Separators between words in every operator: space, tab, newline, vertical tab, form feed, carriage return.
SEPARATORS = "\\x20\\x09-\\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local master gets a temporary one; a cluster is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="rastermill-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _delete_at_exit(spark: SparkSession, path: str) -> None:
    try:
        if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
            delete(spark, path)
            return
    except Exception:  # the session has gone
        pass
    if path.startswith(("file:", "/")):  # elsewhere the cluster's clean-up of its checkpoint folder applies
        shutil.rmtree(re.sub("^file:/*", "/", path), ignore_errors=True)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete_at_exit, spark, path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df in the shared folder and read it again, so that lost executors cost no recomputation."""
    return written_at(df, name)[0]


def written_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As written(), and the path, for those who delete it when it is used up."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps whose frames are gone."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def partitions_of(df: DataFrame, each: int = 128 << 20) -> int:
    """Tasks for a shuffle of df: the session's number, or more where the files that df reads hold more than `each` bytes a task."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(partitions(df.sparkSession), min(math.ceil(size / each), 1_000_000))


#: Keys with more than this share of a table's rows are hot: at most 1 / HOT_SHARE keys can be, which bounds what is broadcast.
HOT_SHARE = 1e-4
#: No key of fewer rows is hot.
HOT_ROWS = 256


def join_counted(left: DataFrame, right: DataFrame, key: str, n: str, how: str = "inner", total: int | None = None) -> DataFrame:
    """left joined by key with right, which has one row a key and in column n (dropped) how many rows of left have the key.

    The rows of hot keys meet their one row by a broadcast of at most 1 / HOT_SHARE rows; the others are shuffled. left and right are
    read more than once, so they should be written tables. total: the sum of n, if it is known.
    """
    if how not in ("inner", "left", "left_semi"):
        raise ValueError(how)
    total = (right.agg(F.sum(n)).first()[0] or 0) if total is None else total
    values, limit = [c for c in right.columns if c not in (key, n)], max(HOT_ROWS, total * HOT_SHARE)
    if total <= limit:
        return left.join(right.select(key, *values), key, how)
    hot = right.where(F.col(n) > limit)
    marked = left.join(F.broadcast(hot.select(key, *values, F.lit(True).alias("__hot"))), key, "left")
    done = marked.where("__hot").drop("__hot")
    rest = marked.where("__hot is null").select(*left.columns)
    cold = right.where(F.col(n) <= limit).select(key, *values)
    found = rest.join(cold, key, how)
    names = left.columns if how == "left_semi" else [*left.columns, *values]
    return done.select(*names).unionByName(found.select(*names))


def join_salted(left: DataFrame, right: DataFrame, key: str, salt_by: list[str], counted: DataFrame, rows_each: int = 1024) -> DataFrame:
    """left joined by key with right, which has one, possibly wide, row a key; `counted` has left's keys, a row for a row.

    A hot key's rows are dealt over salts by the columns salt_by, about rows_each to a salt, and its row of right goes to each.
    At most 1 / HOT_SHARE keys are hot, so their list is broadcast.
    """
    total = counted.count()
    limit = max(rows_each, total * HOT_SHARE)
    hot = counted.groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") > limit).select(key, F.ceil(F.col("__n") / rows_each).cast("int").alias("__salts"))
    if total <= limit or hot.isEmpty():
        return left.join(right, key)
    hot = written(hot, "hot-keys")
    a = left.join(F.broadcast(hot), key, "left").withColumn("__salt", F.coalesce(F.pmod(F.xxhash64(*salt_by), F.col("__salts")).cast("int"), F.lit(0)))
    b = right.join(F.broadcast(hot), key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__salts"), F.lit(1)) - 1)))
    return a.drop("__salts").join(b.drop("__salts"), [key, "__salt"]).drop("__salt")


def columns(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]


def trim() -> None:
    """Give freed memory back to the system: Python workers outlive their tasks, and the next stage's need it."""
    pa.default_memory_pool().release_unused()
    if _MALLOC_TRIM is not None:
        _MALLOC_TRIM(0)


def small_batches(batches: Iterable[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterable[pa.RecordBatch]:
    """Slices of about `limit` text bytes, at least a row each, so that numpy's arrays stay small."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray([0 if not v.is_valid else len(v.as_buffer()) for v in batch.column(batch.schema.get_field_index(column))], np.int64)
        part = (np.cumsum(sizes) - sizes) // limit
        starts = np.flatnonzero(np.diff(part, prepend=-1))
        for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            yield batch.slice(a, b - a)
        trim()


# --- hashes of windows of words -------------------------------------------------------------------------------------

#: Seeds of the words' 128-bit xxhash, and odd multipliers of the two lanes in which its halves are combined.
_WORD_SEED = 0x5DEECE66D
_LANES = ((0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB), (0xD1342543DE82EF95, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53))


def split_words(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The words of texts of words joined by one space, one after the other, and each text's first word (one more at the end)."""
    cut = pc.split_pattern(pa.array(texts, pa.large_binary()), b" ")
    words, first = cut.flatten(), cut.offsets.to_numpy().astype(np.int64)
    empty = np.fromiter((not t for t in texts), bool, len(texts))
    if empty.any():  # an empty text splits into one empty word; there is no other
        words = words.filter(pc.greater(pc.binary_length(words), 0))
        first = first - np.concatenate([[0], np.cumsum(empty)])
    return words, first


def word_hashes(words: pa.Array) -> np.ndarray:
    """Two independent 64-bit hashes of each word: the halves of its 128-bit xxhash, made once for each distinct word."""
    if not len(words):
        return np.zeros((2, 0), np.uint64)
    found = words.dictionary_encode()
    digests = b"".join(xxhash.xxh3_128_digest(w, _WORD_SEED) for w in found.dictionary.to_pylist())
    return np.ascontiguousarray(np.frombuffer(digests, np.uint64).reshape(-1, 2)[found.indices.to_numpy()].T)


def _mixed(a: np.ndarray, b: np.ndarray, lane: int) -> np.ndarray:
    """A hash of the pair (a, b): one-to-one in either when the other is given, and not symmetric."""
    k, m, n = (np.uint64(x) for x in _LANES[lane])
    x = (a ^ (a >> np.uint64(32))) * k + b
    x ^= x >> np.uint64(30)
    x *= m
    x ^= x >> np.uint64(27)
    x *= n
    x ^= x >> np.uint64(31)
    return x


def window_hashes(words: np.ndarray, width: int, lane: int) -> np.ndarray:
    """The hash of words i to i + width - 1 for each i. Runs of 2, 4, 8... words are hashed from two halves each, so equal word sequences,
    and but for chance only those, have equal hashes whatever the words' bytes."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, at, run, size = None, 0, words, 1
    while size <= width:
        if width & size:
            part = run[at : at + n]
            out = part if out is None else _mixed(out, part, lane)
            at += size
        if 2 * size <= width:
            run = _mixed(run[:-size], run[size:], lane)
        size *= 2
    return _mixed(out, np.full(n, width, np.uint64), lane)


def window_starts(first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Global indexes of the words at which a window of `width` words of one document starts, and their documents."""
    n = np.maximum(np.diff(first) - width + 1, 0)
    doc = np.repeat(np.arange(len(n)), n)
    return first[:-1][doc] + np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n), doc


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending 64-bit values as differences, bytes of one rank together; Parquet's and the shuffle's codecs shrink them."""
    return np.ascontiguousarray(np.diff(values, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)
