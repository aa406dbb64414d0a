"""Document fingerprints: canonical exact digest.

Texts are normalised (NFKC), case-folded and their white space is folded; a 128-bit xxhash of the result groups
them; inside a group of equal hashes the canonical bytes themselves are compared, by minimum and maximum in a
map-side aggregation, so that a hot group costs no task more than its own rows. Different texts of one hash get
ordinals, so equal fingerprints mean equal canonical texts.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, join_counted, partitions_of, small_batches, written


def canonical(text: str) -> str:
    if text.isascii():
        return " ".join(text.lower().split())
    return " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold()).split())


def digest(text: str, bits: int = 128) -> str:
    h = xxhash.xxh3_128_hexdigest(canonical(text).encode("utf-8", "surrogatepass"))
    return h if bits == 128 else h[: bits // 4]


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many (or all) of the following text."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def _digests(bits: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "__text"):
            texts = batch.column(batch.schema.get_field_index("__text")).to_pylist()
            new = [canonical(t or "") for t in texts] if with_text else [digest(t or "", bits) for t in texts]
            kept = [n for n in batch.schema.names if n != "__text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in kept), pa.array(new, pa.string())], names=[*kept, "__new"])

    return run


def canonical_digest(df: DataFrame, text: str = "text", out: str = "digest", bits: int = 128) -> DataFrame:
    """df's columns but the text, and the digest of its canonical text. Null counts as empty. No shuffle."""
    kept = [c for c in df.columns if c not in (text, out)]
    schema = df.select(*(F.col(f"`{c}`") for c in kept)).schema.add("__new", "string")
    return df.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{text}`").alias("__text")).mapInArrow(_digests(bits, False), schema).withColumnRenamed("__new", out)


def collisions(texts: DataFrame) -> DataFrame:
    """(digest, text) rows -> (digest, canonical, ordinal) of digests under which different canonical texts stand.

    Ordinal 0 is the smallest text in byte order. Empty where the hash kept all texts apart.
    """
    canon = texts.select("digest", F.col("text").alias("__text")).mapInArrow(_digests(128, True), "digest string, __new string").withColumnRenamed("__new", "canonical")
    mixed = written(canon.groupBy("digest").agg(F.min("canonical").alias("lo"), F.max("canonical").alias("hi")).where("lo <> hi").select("digest"), "mixed")
    if mixed.isEmpty():
        return texts.sparkSession.createDataFrame([], "digest string, canonical string, ordinal int")
    each = canon.join(mixed, "digest", "left_semi").distinct()
    return each.withColumn("ordinal", F.row_number().over(Window.partitionBy("digest").orderBy("canonical")) - 1)


def _with_ordinal(digest_col, ordinal_col):
    return F.when(F.coalesce(ordinal_col, F.lit(0)) > 0, F.concat_ws("-", digest_col, ordinal_col.cast("string"))).otherwise(digest_col)


def fetch(docs: DataFrame, ids: DataFrame, broadcast_rows: int = 500_000) -> DataFrame:
    """The documents of some ids. At most `broadcast_rows` ids (8 bytes each) are broadcast; more are joined by a shuffle."""
    few = ids.limit(broadcast_rows + 1).count() <= broadcast_rows
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")


def group_by_text(docs: DataFrame, bits: int = 128) -> DataFrame:
    """(doc_id, text) -> (doc_id, fingerprint, copies, first_doc_id): rows of equal canonical text share a fingerprint.

    Null texts count as empty and form a group of their own with empty ones. Repeated rows are copies.
    """
    marks = written(canonical_digest(docs.select("doc_id", "text"), bits=bits), "marks")
    dups = written(marks.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1"), "repeated")
    flagged = join_counted(marks, dups, "digest", "n", "left_semi")
    texts = flagged.distinct().join(fetch(docs.select("doc_id", "text"), flagged.select("doc_id").distinct()), "doc_id").select("digest", "text")
    clash = written(collisions(texts), "clashes")
    if clash.isEmpty():
        final = marks.withColumn("fingerprint", F.col("digest"))
    else:
        mixed = flagged.distinct().join(docs.select("doc_id", F.col("text").alias("__text")), "doc_id").select("doc_id", "digest", "__text")
        named = mixed.mapInArrow(_digests(128, True), "doc_id long, digest string, __new string").withColumnRenamed("__new", "canonical").join(clash, ["digest", "canonical"]).select("doc_id", "digest", "ordinal").distinct()
        final = marks.join(named, ["doc_id", "digest"], "left").select("doc_id", _with_ordinal(F.col("digest"), F.col("ordinal")).alias("fingerprint"))
    final = written(final.select("doc_id", "fingerprint"), "fingerprints")
    groups = final.groupBy("fingerprint").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc_id"))
    groups = written(groups.withColumn("n", F.col("copies")), "groups")
    return join_counted(final, groups, "fingerprint", "n").select("doc_id", "fingerprint", "copies", "first_doc_id")


ROW = "doc_id long, next_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, next_fingerprint string, changed boolean"
EDGE = f"{ROW}, edge int, position int, text string"


def _row(doc_id, text, next_id, following, bits, known=None, mark=None):
    new = edited(text, following)
    own = known or digest(text, bits)
    mark = mark or digest(following, bits)
    return [doc_id, next_id, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), own, own if new == text else digest(new, bits), mark, new != text]


def _neighbours(bits: int):
    """Rows of one sorted partition, each with the next; the first and last rows go out as edges (0 and 1) with their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        position, before = TaskContext.get().partitionId(), None
        schema = pa.schema([("doc_id", pa.int64()), ("next_id", pa.int64()), ("n_chars", pa.int64()), *((n, pa.string()) for n in ("edited_sha256", "fingerprint", "edited_fingerprint", "next_fingerprint")), ("changed", pa.bool_()), ("edge", pa.int32()), ("position", pa.int32()), ("text", pa.string())])
        none = [None] * 8

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)

        for batch in small_batches(batches, "text"):
            rows = []
            for doc_id, text in zip(*columns(batch, "doc_id", "text"), strict=True):
                mark = digest(text, bits)
                if before is None:
                    rows.append([doc_id, *none[1:], 0, position, text])
                else:
                    rows.append([*_row(before[0], before[1], doc_id, text, bits, before[2], mark), None, position, None])
                before = (doc_id, text, mark)
            yield out(rows)
        if before:
            yield out([[before[0], *none[1:], 1, position, before[1]]])

    return run


def _edges(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_row(d, t, nd, nt, bits) for d, t, nd, nt in zip(*columns(batch, "doc_id", "text", "next_id", "next_text"), strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i < 3 else pa.bool_() if i == 7 else pa.string()) for i, c in enumerate(zip(*rows))], names=[x.split()[0] for x in ROW.split(", ")])

    return run


def _rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        d, t, n = columns(batch, "digest", "text", "next_text")
        yield pa.RecordBatch.from_arrays([pa.array(d, pa.string()), pa.array([edited(a, b) for a, b in zip(t, n, strict=True)], pa.string())], names=["digest", "text"])


def with_next(docs: DataFrame, bits: int = 128) -> DataFrame:
    """Fingerprints of each text, of its edited text, and of the next document in descending doc_id (the last: the first).

    One shuffle of the texts, by ranges of doc_id and a hash; a partition's last row meets the next partition's first row
    among two rows a partition. A null text is empty, a null doc_id comes last, repeated doc_ids are ordered by the
    hash of their text and the text, one document follows itself, an empty table gives no rows.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    order = [F.desc("doc_id"), F.desc("h")]  # what is sampled for the ranges: two numbers a row
    ordered = texts.repartitionByRange(partitions_of(docs), *order).sortWithinPartitions(*order, F.desc("text")).drop("h")
    base = written(ordered.mapInArrow(_neighbours(bits), EDGE), "neighbours")
    # first and last rows of the partitions, two numbers each, in one order; their texts follow by a join
    along = Window.orderBy("position", "edge")
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edges = base.where("edge is not null")
    heads = edges.select("doc_id", "position", "edge")
    heads = heads.select("*", *(F.coalesce(F.lead(c).over(along), F.first(c).over(whole)).alias(f"next_{c}") for c in ("position", "edge")))
    heads = heads.where("edge = 1").select("position", "next_position")
    following = edges.where("edge = 0").select(F.col("position").alias("next_position"), F.col("doc_id").alias("next_id"), F.col("text").alias("next_text"))
    tails = edges.where("edge = 1").select("position", "doc_id", "text").join(heads, "position").join(following, "next_position").select("doc_id", "text", "next_id", "next_text")
    rows = written(base.where("edge is null").select(*(x.split()[0] for x in ROW.split(", "))).unionByName(tails.mapInArrow(_edges(bits), ROW)), "fingerprints")

    # bytes are compared wherever two texts, edited or not, share a hash
    marks = rows.select(F.col("fingerprint").alias("digest")).union(rows.where("changed").select("edited_fingerprint"))
    dups = written(marks.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1"), "repeated")
    own = join_counted(rows.select("doc_id", F.col("fingerprint").alias("digest")), dups, "digest", "n", "left_semi").distinct()
    new = join_counted(rows.where("changed").select("doc_id", "next_id", F.col("edited_fingerprint").alias("digest")), dups, "digest", "n", "left_semi").distinct()
    ids = own.select("doc_id").union(new.select("doc_id")).union(new.select(F.col("next_id").alias("doc_id"))).distinct()
    some = written(fetch(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), ids), "flagged")
    rebuilt = new.join(some, "doc_id").join(some.select(F.col("doc_id").alias("next_id"), F.col("text").alias("next_text")), "next_id").select("digest", "text", "next_text").mapInArrow(_rebuilt, "digest string, text string")
    clash = written(collisions(own.join(some, "doc_id").select("digest", "text").unionByName(rebuilt)), "clashes")
    if clash.isEmpty():
        return rows.drop("changed")
    ordinals = []
    for side, text in (("fingerprint", own.join(some, "doc_id").select("doc_id", "digest", F.col("text").alias("__text"))), ("edited_fingerprint", None)):
        if text is None:
            pairs = new.join(some, "doc_id").join(some.select(F.col("doc_id").alias("next_id"), F.col("text").alias("next_text")), "next_id")
            text = pairs.select("doc_id", "digest", F.expr("concat(substring(text, 1, length(text) - length(text) div 3), substring(next_text, 1, int(length(text) div 3)))").alias("__text"))
        named = text.mapInArrow(_digests(128, True), "doc_id long, digest string, __new string").withColumnRenamed("__new", "canonical").join(clash, ["digest", "canonical"])
        ordinals.append((side, named.select("doc_id", F.col("digest").alias(side), F.col("ordinal").alias(f"{side}_ordinal")).distinct()))
    nexts = ordinals[0][1].select(F.col("doc_id").alias("next_id"), F.col("fingerprint").alias("next_fingerprint"), F.col("fingerprint_ordinal").alias("next_fingerprint_ordinal"))
    out = rows
    for side, frame in ordinals:
        out = out.join(frame, ["doc_id", side], "left")
    out = out.join(nexts, ["next_id", "next_fingerprint"], "left")
    own, new, following = (_with_ordinal(F.col(s), F.col(f"{s}_ordinal")) for s in ("fingerprint", "edited_fingerprint", "next_fingerprint"))
    return out.select("doc_id", "next_id", "n_chars", "edited_sha256", own.alias("fingerprint"), F.when(F.col("changed"), new).otherwise(own).alias("edited_fingerprint"), following.alias("next_fingerprint"))


def query(docs: DataFrame) -> DataFrame:
    """op6: an exact digest is like another (1.0) or not (0.0)."""
    rows = with_next(docs)
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", (F.col("fingerprint") == F.col("edited_fingerprint")).cast("double").alias("near_edited"), (F.col("fingerprint") == F.col("next_fingerprint")).cast("double").alias("near_next"))
