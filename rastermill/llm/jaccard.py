"""N-gram Jaccard join with prefixes of token combinations.

A document is the set of its distinct word shingles. Tokens are ordered by document frequency, counted over all
documents, rare first. Two sets whose overlap must be at least o share k tokens of their extended prefixes, the first
n - o + k tokens: either a rare one among them, so each rare token of the prefix is a key by itself, or only tokens of
the frequent class, so each k-combination of those is a key. A key of one document is no key. Candidates are verified
on whole sets. Long sets, whose combinations would be too many, use single tokens throughout.

Equal sets are collapsed before the join. All sets of a key's list are verified against the list's lead. A list whose
sets are then still in several components, and very many, is a corpus of its own: its tokens are ordered
anew by their frequency within it, and the prefixes by that order make shorter lists with leads of their own. What is
still apart meets in pairs of blocks, where vectors of token counts tell which pairs can reach the threshold; those are
verified as well. So no link between components is lost, and no pair is made within a component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, delete, join_counted, join_salted, pack_sorted, release, trim, unpack_sorted, window_hashes, window_starts, written, written_at
from .components import components
from .units import NO_ID, UNIT_BYTES, Unit, bucket_bounds, each_unit, narrow, opened, rows_of, units, wide

SHINGLE = 5
#: A link: 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Tokens in more documents than this are the frequent class; combinations have COMBINATION tokens.
FREQUENT = 4096
COMBINATION = 2
#: Sets of more tokens use single tokens as keys even of the frequent class; see keys_of().
LONG = 512
#: Text bytes of which one bucket counts the document frequencies, on average, and fewest buckets.
BUCKET_BYTES, MIN_BITS = 4 << 20, 4
#: Document frequencies are counted by the upper 48 bits of a token: tokens that share them count as one, which changes
#: their place in the order for all documents alike and no result.
COUNTED = np.uint64(0xFFFFFFFFFFFF0000)
#: Cells of the count vector that bounds two sets' difference, and members of a block in the closing round.
CELLS, BLOCK = 256, 512
#: Groups of more blocks than this are ordered anew first. A member's tokens, some 30 KB a document, then take less than its
#: row in each pair of blocks, some 300 bytes; in smaller groups the pairs of blocks take less. Both ways find all links.
REORDER_BLOCKS = 96


def shingle_sets(unit: Unit, width: int) -> list[np.ndarray]:
    """Ascending distinct shingle hashes of each document; a shorter document is one shingle, one without words none."""
    at, doc = window_starts(unit.first, width)
    hashes = window_hashes(unit.hashes[0], width, 0)[at]
    edges = np.searchsorted(doc, np.arange(len(unit.doc_ids) + 1))
    out = []
    for i in range(len(unit.doc_ids)):
        a, z = unit.first[i], unit.first[i + 1]
        if 0 < z - a < width:
            out.append(window_hashes(unit.hashes[0, a:z], int(z - a), 0))
        else:
            out.append(np.unique(hashes[edges[i] : edges[i + 1]]))
    return out


def digest_of(tokens: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(tokens.tobytes())


def _distinct(sets: list[np.ndarray]) -> list[np.ndarray]:
    return list({digest_of(s): s for s in sets if len(s)}.values())


COUNTS = "bucket int, unit_id long, tokens binary, counts binary"


def _counts(width: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, unit in each_unit(batches):
            tokens, counts = np.unique(np.concatenate([*_distinct(shingle_sets(unit, width)), np.zeros(0, np.uint64)]) & COUNTED, return_counts=True)
            parts = bucket_bounds(tokens, bits)
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _, _ in parts], pa.int32()), pa.array([number] * len(parts), pa.int64()), pa.array([pack_sorted(tokens[a:z]) for _, a, z in parts], pa.binary()), pa.array([narrow(counts[a:z]) for _, a, z in parts], pa.binary())], names=["bucket", "unit_id", "tokens", "counts"])

    return run


def _frequencies(table: pa.Table) -> pa.Table:
    """The tokens of a bucket that at least two documents hold, back to the units that hold them."""
    rows = rows_of(table, "bucket", "unit_id", "tokens", "counts")
    parts = [unpack_sorted(t) for _, _, t, _ in rows]
    counts = [wide(c, len(p)) for p, (_, _, _, c) in zip(parts, rows, strict=True)]
    tokens, inverse = np.unique(np.concatenate(parts), return_inverse=True)
    total = np.bincount(inverse, weights=np.concatenate(counts), minlength=len(tokens)).astype(np.int64)
    at, out = 0, ([], [], [])
    for (_, number, _, _), part in zip(rows, parts, strict=True):
        mine = total[inverse[at : at + len(part)]]
        at += len(part)
        if (many := mine > 1).any():
            for column, x in zip(out, (number, pack_sorted(part[many]), narrow(mine[many])), strict=True):
                column.append(x)
    return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())], names=["unit_id", "tokens", "counts"])


def keys_of(tokens: np.ndarray, frequency: np.ndarray, percent: int, k: int, frequent: int, long: int = LONG) -> list[int]:
    """The index keys of a set.

    Sets of more than `long` tokens have single tokens, those of at most long * 100 / percent tokens have combinations of
    frequent ones. Sizes of linked sets differ by percent at most, so two linked sets have one kind of key in common.
    """
    n = len(tokens)
    least = -(-percent * n // 100)
    order = np.lexsort((tokens, frequency))[: max(0, n - least + max(k, 1))]
    keys = [int(tokens[i].view(np.int64)) for i in order.tolist() if 1 < frequency[i] <= frequent]
    hot = [i for i in order.tolist() if frequency[i] > max(1, frequent)]
    if n > long or k < 2 or n < k:
        keys += [int(tokens[i].view(np.int64)) for i in hot]
    if k > 1 and k <= n <= long * 100 // percent:
        keys += [xxhash.xxh3_64_intdigest(b"".join(sorted(some))) - (1 << 63) for some in combinations([tokens[i].tobytes() for i in hot], k)]
    return keys


SETS = "doc_id long, n_shingles long, digest binary, keys array<long>, tokens binary, alone long, cells binary"


def _keyed(width: int, percent: int, k: int, frequent: int):
    def run(unit_rows: pa.Table, verdicts: pa.Table) -> pa.Table:
        found = rows_of(verdicts, "tokens", "counts")
        known = [unpack_sorted(t) for t, _ in found]
        many = np.concatenate([*known, np.zeros(0, np.uint64)])
        counts = np.concatenate([*(wide(c, len(t)) for t, (_, c) in zip(known, found, strict=True)), np.zeros(0, np.int64)])
        order = np.argsort(many)
        many, counts = many[order], counts[order]
        out: list[list] = [[] for _ in range(7)]
        for ids, body in rows_of(unit_rows, "doc_ids", "body"):
            unit, seen = opened(ids, body), set()
            for doc_id, tokens in zip(unit.doc_ids.tolist(), shingle_sets(unit, width), strict=True):
                keys, blob, digest, alone_, cells = [], b"", digest_of(tokens), len(tokens), b""
                if len(tokens) and digest not in seen and len(many):
                    seen.add(digest)
                    i = np.minimum(np.searchsorted(many, tokens & COUNTED), len(many) - 1)
                    frequency = np.where(many[i] == tokens & COUNTED, counts[i], 1)
                    keys = keys_of(tokens, frequency, percent, k, frequent)
                    if keys:
                        shared = tokens[frequency > 1]
                        blob, alone_ = shared.tobytes(), len(tokens) - len(shared)
                        cells = np.minimum(np.bincount((shared >> np.uint64(8)).astype(np.int64) % CELLS, minlength=CELLS), 255).astype(np.uint8).tobytes()
                for column, x in zip(out, (None if doc_id == NO_ID else doc_id, len(tokens), digest if len(tokens) else None, keys, blob, alone_, cells), strict=True):
                    column.append(x)
        trim()
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.int64(), pa.binary())
        return pa.table([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["doc_id", "n_shingles", "digest", "keys", "tokens", "alone", "cells"])

    return run


def _verified(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, np.zeros(0, np.uint64)
        for batch in batches:
            a, b, n_a, n_b, t_a, t_b = columns(batch, "a", "b", "n_a", "n_b", "t_a", "t_b")
            linked: tuple[list, list] = ([], [])
            for x, y, n, m, s, t in zip(a, b, n_a, n_b, t_a, t_b, strict=True):
                if x != last:
                    last, left = x, np.frombuffer(s, np.uint64)
                right = np.frombuffer(t, np.uint64)
                i = np.searchsorted(left, right)
                common = int((left[np.minimum(i, len(left) - 1)] == right).sum()) if len(left) else 0
                if 100 * common >= percent * (n + m - common):
                    linked[0].append(x)
                    linked[1].append(y)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in linked], names=["a", "b"])

    return run


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are links. A set in many pairs goes to many tasks."""
    spark = pairs.sparkSession
    pairs, path = written_at(pairs, "pairs")
    if pairs.isEmpty():
        return pairs
    left = sets.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("n_a"), F.col("tokens").alias("t_a"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("n_b"), F.col("tokens").alias("t_b"))
    met = join_salted(join_salted(pairs, right, "b", ["a"], pairs), left, "a", ["b"], pairs)
    links = written(met.mapInArrow(_verified(percent), "a long, b long"), "links")
    delete(spark, path)
    return links


def _room(percent: int):
    """Whether sizes and tokens that no other set has leave room for a link between rows l and r."""
    most = F.least(F.col("l.n") - F.col("l.alone"), F.col("r.n") - F.col("r.alone"))
    return most * (100 + percent) >= percent * (F.col("l.n") + F.col("r.n"))


def _close(percent: int):
    """Pairs of one block, or of two, that are in different components and whose count vectors leave room for a link."""

    def run(table: pa.Table) -> pa.Table:
        ids, label, n, alone_ = (table.column(c).to_numpy() for c in ("doc_id", "label", "n", "alone"))
        side, twice = table.column("side").to_numpy(), table.column("i")[0].as_py() != table.column("j")[0].as_py()
        cells = np.frombuffer(b"".join(table.column("cells").to_pylist()), np.uint8).reshape(-1, CELLS).astype(np.int16)
        out: tuple[list, list] = ([], [])
        for x in np.flatnonzero(side == 0):
            others = np.flatnonzero((label != label[x]) & ((side == 1) if twice else (ids > ids[x])))
            size = n[others] + n[x]
            apart = alone_[others] + alone_[x] + np.abs(n[others] - alone_[others] - n[x] + alone_[x])
            others, size = others[(100 + percent) * apart <= (100 - percent) * size], size[(100 + percent) * apart <= (100 - percent) * size]
            if len(others):
                apart = alone_[others] + alone_[x] + np.abs(cells[others] - cells[x]).sum(1)
                found = ids[others[(100 + percent) * apart <= (100 - percent) * size]]
                out[0].append(np.minimum(found, ids[x]))
                out[1].append(np.maximum(found, ids[x]))
        return pa.table([pa.array(np.concatenate([*c, np.zeros(0, np.int64)]), pa.int64()) for c in out], names=["a", "b"])

    return run


def _led(postings: DataFrame) -> DataFrame:
    """(key, doc_id, n, alone) -> the same with lead, lead_n and lead_alone, for keys of more than one document.

    A list's lead is the set with the smallest share of tokens of its own: what the others are copies of, if it is there.
    """
    lists = postings.groupBy("key").agg(F.count("*").alias("docs"), F.min_by(F.struct("doc_id", "n", "alone"), F.struct(F.col("alone") / F.col("n"), "doc_id")).alias("lead")).where("docs > 1")
    lists, _ = written_at(lists.select("key", "docs", F.col("lead.doc_id").alias("lead"), F.col("lead.n").alias("lead_n"), F.col("lead.alone").alias("lead_alone")), "lists")
    return join_counted(postings, lists, "key", "docs")


def _to_lead(groups: DataFrame, percent: int) -> DataFrame:
    """The pairs of members and leads that can be links."""
    sides = groups.where("doc_id <> lead").select(F.struct(F.col("lead").alias("doc_id"), F.col("lead_n").alias("n"), F.col("lead_alone").alias("alone")).alias("l"), F.struct("doc_id", "n", "alone").alias("r")).where(_room(percent))
    return sides.select(F.least("l.doc_id", "r.doc_id").alias("a"), F.greatest("l.doc_id", "r.doc_id").alias("b")).distinct()


def _labelled(groups: DataFrame, labels: DataFrame) -> DataFrame:
    """(grp, doc_id, n, alone) with the label of each document's component: its own id where it has no link yet."""
    named = groups.select("grp", "doc_id", "n", "alone").distinct().join(labels.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    return written(named.withColumn("label", F.coalesce("label", "doc_id")), "members")


def _mixed(named: DataFrame, block: int) -> DataFrame:
    """The groups whose members stand in several components: grp, their number docs and how many blocks they fill."""
    found = named.groupBy("grp").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("docs")).where("lo <> hi and docs > 2")
    return written(found.select("grp", "docs", F.ceil(F.col("docs") / block).cast("int").alias("blocks")), "mixed")


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = [c for c in batch.schema.names if c != "tokens"]
        lists = [np.frombuffer(t, np.int64) for t in columns(batch, "tokens")[0]]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
        tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*lists, np.zeros(0, np.int64)])))
        yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), tokens], names=[*kept, "tokens"])


def _reordered(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(grp, doc_id, n, alone) -> (key, doc_id, n, alone): prefixes by the tokens' frequency within each group.

    A key is the hash of a group and a token. Tokens that only one set of the corpus has come first in any order; they
    are counted but make no key.
    """
    met = members.join(sets.select("doc_id", "tokens"), "doc_id").select("grp", "doc_id", "n", "alone", "tokens")
    rows = met.mapInArrow(_listed, "grp long, doc_id long, n long, alone long, tokens array<long>")
    length = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - F.col("alone")
    rows = rows.withColumn("p", length.cast("int")).where("p > 0").withColumn("token", F.explode("tokens"))
    rows, path = written_at(rows.select(F.xxhash64("grp", "token").alias("key"), "grp", "doc_id", "n", "alone", "p"), "tokens-of-groups")
    counts = written(rows.groupBy("key").agg(F.count("*").alias("df")).withColumn("rows", F.col("df")), "frequencies-of-groups")
    prefix = join_counted(rows, counts, "key", "rows").groupBy("grp", "doc_id", "n", "alone", "p").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("t"))
    keys = prefix.select("doc_id", "n", "alone", F.explode(F.slice("t", F.lit(1), F.col("p"))).alias("t")).where("t.df > 1").select("t.key", "doc_id", "n", "alone").distinct()
    out = written(keys, "postings-of-groups")
    delete(rows.sparkSession, path)
    return out


def _blocks(named: DataFrame, mixed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs that can be links between components of a group, its members meeting in pairs of blocks."""
    members = join_counted(named, mixed, "grp", "docs").join(sets.select("doc_id", "cells"), "doc_id").withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    spread = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.select("grp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), "doc_id", "label", "n", "alone", "cells")
    return spread.groupBy("grp", "i", "j").applyInArrow(_close(percent), "a long, b long").distinct()


def similar_sets(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT, k: int = COMBINATION, frequent: int = FREQUENT, lower: bool = True, block: int = BLOCK, reorder_blocks: int = REORDER_BLOCKS) -> DataFrame:
    """(doc_id, text) -> doc_id, n_shingles, component_id: the smallest doc_id reachable by links.

    Words are runs of characters other than space and \\x09-\\x0D, A-Z lower-cased. A text without words, or null, is
    linked with nothing. Rows of equal sets are one class; a row with a null doc_id is linked to nothing and is its
    own (null) component. Texts that share a doc_id are one vertex of the graph; one_of_each() takes them apart.
    """
    spark = docs.sparkSession
    cut, units_path = written_at(units(docs.where("doc_id is not null"), lower), "units")
    bits = max(MIN_BITS, math.ceil(math.log2(max(1, cut.count()) * UNIT_BYTES / BUCKET_BYTES)))
    counted = cut.mapInArrow(_counts(width, bits), COUNTS).groupBy("bucket").applyInArrow(_frequencies, "unit_id long, tokens binary, counts binary")
    counted, counts_path = written_at(counted, "frequencies")
    release(spark)
    table, _ = written_at(cut.groupBy("unit_id").cogroup(counted.groupBy("unit_id")).applyInArrow(_keyed(width, percent, k, frequent), SETS), "sets")
    delete(spark, units_path)
    delete(spark, counts_path)
    # a class's keys come from one document: the smallest that has some (a unit lists each set once)
    classes = table.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.min(F.when(F.size("keys") > 0, F.col("doc_id"))).alias("keyed"))
    classes = written(classes, "classes")
    keyed = classes.where("keyed is not null").select(F.col("keyed").alias("doc_id"))
    sets = table.where("size(keys) > 0").select("doc_id", "n_shingles", "alone", "tokens", "cells").join(keyed, "doc_id", "left_semi")
    postings = table.where("size(keys) > 0").select("doc_id", F.col("n_shingles").alias("n"), "alone", "keys").join(keyed, "doc_id", "left_semi")
    postings, postings_path = written_at(postings.select("doc_id", "n", "alone", F.explode("keys").alias("key")), "postings")
    release(spark)
    groups, groups_path = written_at(_led(postings).withColumn("grp", F.col("lead")).drop("key").distinct(), "groups")
    delete(spark, postings_path)
    links = _verify(_to_lead(groups, percent), sets, percent)
    labels = written(components(links), "labels")
    # groups whose sets are still apart: large ones get shorter lists first, then all meet in blocks
    named = _labelled(groups, labels)
    mixed = _mixed(named, block)
    delete(spark, groups_path)
    large = F.col("blocks") > reorder_blocks
    if not mixed.where(large).isEmpty():
        small = join_counted(named, mixed.where(~large), "grp", "docs").select("grp", "doc_id", "n", "alone")
        large = join_counted(named, mixed.where(large), "grp", "docs").select("grp", "doc_id", "n", "alone")
        parts = written(_led(_reordered(large, sets, percent)).withColumnRenamed("key", "grp"), "parts")
        links = links.unionByName(_verify(_to_lead(parts, percent), sets, percent))
        labels = written(components(links), "labels")
        named = _labelled(parts.select("grp", "doc_id", "n", "alone").unionByName(small), labels)
        mixed = _mixed(named, block)
    late = _verify(_blocks(named, mixed, sets, percent), sets, percent)
    if not late.isEmpty():
        labels = written(components(links.unionByName(late)), "labels")
    # from linked documents to their classes, and the smallest id of all classes of a component
    ids = classes.where("keyed is not null").select(F.col("keyed").alias("id"), "digest", "rep")
    linked = written(labels.join(ids, "id").select("digest", "label", "rep"), "linked")
    smallest = written(linked.groupBy("label").agg(F.min("rep").alias("component_id"), F.count("*").alias("n")), "components")
    joined = join_counted(linked, smallest, "label", "n").select("digest", "component_id")
    named = classes.join(joined, "digest", "left").select("digest", "copies", F.coalesce("component_id", "rep").alias("component_id"))
    found = join_counted(table.select("doc_id", "n_shingles", "digest"), written(named, "named"), "digest", "copies", "left")
    out = found.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    lost = docs.where("doc_id is null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return out.unionByName(alone(lost, width, lower))


def alone(docs: DataFrame, width: int, lower: bool) -> DataFrame:
    """Rows without an id: their set sizes, and no component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, unit in each_unit(batches):
            sizes = [len(s) for s in shingle_sets(unit, width)]
            yield pa.RecordBatch.from_arrays([pa.array([None] * len(sizes), pa.int64()), pa.array(sizes, pa.int64()), pa.array([None] * len(sizes), pa.int64())], names=["doc_id", "n_shingles", "component_id"])

    return units(docs, lower).mapInArrow(run, "doc_id long, n_shingles long, component_id long")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """docs with one document of each component, that of the smallest doc_id, and all rows without an id.

    Of several rows with the id that stays, the one with the smallest text stays.
    """
    known = docs.where("doc_id is not null")
    lost = docs.where("doc_id is null")
    many = known.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    if many.isEmpty():
        found = similar_sets(known.select("doc_id", "text"), **options).where("component_id = doc_id").select("doc_id").distinct()
        return known.join(found, "doc_id", "left_semi").select(docs.columns).unionByName(lost)
    # texts of one id are sets of their own: the smallest goes by the id, each other by a hash of id and text
    order = Window.partitionBy("doc_id").orderBy("text")
    same = known.join(many, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).withColumn("__i", F.row_number().over(order))
    rows = known.join(many, "doc_id", "left_anti").withColumn("__i", F.lit(1)).unionByName(same)
    rows = written(rows.withColumn("__key", F.when(F.col("__i") == 1, F.col("doc_id").cast("long")).otherwise(F.xxhash64("doc_id", "text"))), "rows-of-ids")
    found = similar_sets(rows.select(F.col("__key").alias("doc_id"), "text"), **options).select(F.col("doc_id").alias("__key"), "component_id")
    first = rows.select("__key", "doc_id", "__i").join(found, "__key").groupBy("component_id").agg(F.min(F.struct("doc_id", "__i")).alias("k"))
    stays = first.groupBy("k.doc_id").agg(F.min("k.__i").alias("__i"))
    return rows.join(stays, ["doc_id", "__i"], "left_semi").select(docs.columns).unionByName(lost)


def query(docs: DataFrame) -> DataFrame:
    """op4: shingles of four words, similarity of 0.85 or more."""
    return similar_sets(docs, width=4, percent=85)
