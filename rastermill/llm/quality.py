"""Quality rules: counts of each whole text, and the log-likelihood ratio of hashed n-grams.

Tokens are runs of letters and digits or runs of other visible characters; their unigrams and bigrams are hashed into
a fixed number of buckets. Two multinomials over the buckets, of trusted documents and of the whole raw corpus, give
each bucket a weight; a document's score is the mean weight of its n-grams, and a fixed threshold decides. Spark's own
functions do all of it; lambda arguments hold intermediate arrays so that each is made once a row.
"""

from __future__ import annotations

import struct
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

BUCKETS = 1 << 14
#: Mean log-likelihood ratio under which a document is dropped.
THRESHOLD = -0.5
#: At most about so many trusted documents are taken (those of the smallest id hashes); they are broadcast by id.
TRUSTED_ROWS = 50_000
SMOOTHING = 0.5
_SEPARATOR = "[\\x20\\x09-\\x0D]+"
_BLANKS = " \t\n\u000b\u000c\r"
_SYMBOLS = "#*$%&|<>"
_TOKEN = "[\\p{L}\\p{N}]+|[^\\p{L}\\p{N}\\s]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once a row even where body uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def n_repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in the text."""

    def covered(starts: Column) -> Column:
        first = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(starts, first, lambda a, s: F.struct(s.alias("last"), (a["n"] + F.least(F.lit(3), s - a["last"])).alias("n")), lambda a: a["n"])

    def repeated(found: Column) -> Column:
        ordered = F.sort_array(F.transform(found, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
        starts = let(ordered, lambda a: F.transform(F.filter(a, lambda x, i: F.coalesce(x["w"] == F.get(a, i - 1)["w"], F.lit(False)) | F.coalesce(x["w"] == F.get(a, i + 1)["w"], F.lit(False))), lambda x: x["i"]))
        return covered(F.sort_array(starts))

    def windows(w: Column, of: Callable[..., Column]) -> Column:
        return F.slice(F.transform(w, lambda x, i: of(x, F.get(w, i + 1), F.get(w, i + 2))), F.lit(1), F.greatest(F.size(w) - 2, F.lit(0)))

    def counted(w: Column) -> Column:
        # Windows of different hashes differ, so texts in which no hash repeats are done; the others compare their words.
        distinct = let(windows(w, F.xxhash64), lambda h: F.size(F.array_distinct(h)) == F.size(h))
        return F.when(distinct, F.lit(0).cast("long")).otherwise(let(windows(w, lambda *x: F.concat_ws(" ", *x)), repeated))

    return let(words, counted)


def base_counts(text: Column) -> dict[str, Column]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text; zero for null."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, _SEPARATOR), "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, _BLANKS, "")) > 0)
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.translate(text, _BLANKS, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, _SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": n_repeat_words(words).cast("long"),
    }


def grams(text: Column, buckets: int = BUCKETS) -> Column:
    """The buckets of a text's unigrams and bigrams (the last token pairs with the end)."""
    bucket = lambda *x: F.pmod(F.xxhash64(*x), F.lit(buckets)).cast("int")
    tokens = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(_TOKEN), 0)
    return let(tokens, lambda t: F.concat(F.transform(t, lambda x: bucket(x)), F.transform(t, lambda x, i: bucket(x, F.get(t, i + 1)))))


def fit(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, trusted_rows: int = TRUSTED_ROWS) -> DataFrame:
    """(bucket, weight) for every bucket: log of the smoothed share among trusted documents over that in all documents.

    All documents count for the raw corpus. trusted holds doc_ids; the bound on them is a hash bound of the ids.
    """
    total = max(trusted.count(), 1)
    u = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    some = trusted.select("doc_id").where(u < F.lit((1 << 30) * min(total, trusted_rows) // total)).distinct().withColumn("trusted", F.lit(1))
    marked = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id", "left")
    counts = marked.select("trusted", F.explode(grams(F.col("text"), buckets)).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("raw"), F.count("trusted").alias("good"))
    counts = written(docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").fillna(0), "grams")
    sums = counts.agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).first()
    a, n = SMOOTHING, SMOOTHING * buckets
    weight = F.log((F.col("good") + a) / F.lit((sums["good"] or 0) + n)) - F.log((F.col("raw") + a) / F.lit((sums["raw"] or 0) + n))
    return counts.select("bucket", weight.alias("weight"))


def weight_array(weights: DataFrame) -> Column:
    """The weights in the order of their buckets as one array literal."""
    rows = weights.orderBy("bucket").collect()
    sc = weights.sparkSession.sparkContext
    array = sc._gateway.new_array(sc._jvm.double, len(rows))
    sc._jvm.java.nio.ByteBuffer.wrap(struct.pack(f">{len(rows)}d", *(r["weight"] for r in rows))).asDoubleBuffer().get(array)
    return Column(sc._jvm.org.apache.spark.sql.functions.lit(array))


def scored(docs: DataFrame, weights: DataFrame, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """docs with the base counts, base_failed, score and kept. No shuffle of documents.

    The weights, one double a bucket and so of a fixed size, become a literal array. A document without n-grams scores 0. Null texts count
    as empty; columns of the new names are replaced; repeated rows are each scored.
    """
    table = weight_array(weights)
    base = base_counts(F.col(f"`{text}`"))
    new = [*base, "score", "base_failed", "kept"]
    mean = let(grams(F.col(f"`{text}`")), lambda g: F.when(F.size(g) == 0, F.lit(0.0)).otherwise(F.aggregate(g, F.lit(0.0), lambda a, b: a + F.get(table, b)) / F.size(g)))
    rows = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in new), *(c.alias(n) for n, c in base.items()), mean.alias("score"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """op9: trusted are documents labelled of quality 1."""
    weights = fit(docs, labels.where("quality = 1").select("doc_id"))
    out = scored(docs.select("doc_id", "text"), weights)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
