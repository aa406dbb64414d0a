"""Line dedup by distinct-site spread: a line that stands on many sites is boilerplate.

HyperLogLog sketches of the sites merge by line hash in a map-side aggregation. Lines whose estimate lies near the
threshold get an exact distinct count, so the decision equals the exact one; nothing but Spark's own functions runs.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_counted, written

#: A line on so many distinct sites is boilerplate.
MIN_SITES = 10
LG_K = 12
#: So many line keys may be broadcast.
FEW_KEYS = 200_000


def _lines(text: str):
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def _key(line):
    return F.unhex(F.md5(F.trim(line)))


def spread(docs: DataFrame, site: str = "source", text: str = "text", min_sites: int = MIN_SITES) -> DataFrame:
    """(line_key, n, sites) of the boilerplate lines, n being their occurrences; sites is null where the sketch alone decided.

    Only the (line, site) pairs of lines near the threshold are counted exactly.
    """
    rows = docs.select(F.col(f"`{site}`").cast("string").alias("site"), F.explode(_lines(f"`{text}`")).alias("line")).where(F.trim("line") != "").select("site", _key(F.col("line")).alias("line_key"))
    slack = max(1.0, 5 * 1.04 / math.sqrt(1 << LG_K) * min_sites)
    sketched = rows.groupBy("line_key").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("estimate"), F.count("*").alias("n"))
    spread_ = written(sketched.where(F.col("estimate") >= min_sites - slack), "spread-lines")
    sure = spread_.where(F.col("estimate") > min_sites + slack).select("line_key", "n", F.lit(None).cast("long").alias("sites"))
    near = written(spread_.where(F.col("estimate") <= min_sites + slack).select("line_key", "n"), "near-lines")
    pairs = having(rows.where("site is not null"), near).groupBy("line_key", "site").agg(F.lit(1).alias("one"))
    exact = pairs.groupBy("line_key").agg(F.count("*").alias("sites")).where(F.col("sites") >= min_sites)
    return written(sure.unionByName(near.join(exact, "line_key").select("line_key", "n", "sites")), "boilerplate")


def having(rows: DataFrame, keys: DataFrame, few: int = FEW_KEYS) -> DataFrame:
    """The rows whose line_key is among keys (line_key, n: how many rows have it), a written table.

    Up to `few` keys (16 bytes each) are broadcast, so that no other row is shuffled; more meet the rows in a join that
    parts hot keys from the others.
    """
    if keys.count() <= few:
        return rows.join(F.broadcast(keys.select("line_key")), "line_key", "left_semi")
    return join_counted(rows, keys, "line_key", "n", "left_semi")


def remove_boilerplate(docs: DataFrame, site: str = "source", text: str = "text", min_sites: int = MIN_SITES) -> DataFrame:
    """docs without their boilerplate lines, with n_lines and n_removed (columns of these names are replaced).

    Lines are compared without spaces at their ends; other white space counts. Blank lines stay. A null text stays null and has
    no lines; a null site is no site; a document of nothing but boilerplate keeps an empty text; repeated rows are treated alike,
    and so are rows without an id.
    """
    flagged = spread(docs, site, text, min_sites).select("line_key", "n")
    # rows without an id are told apart by a hash of their text, so that they are no hot key
    nameless = F.when(F.col("doc_id").isNull(), F.xxhash64(F.col(f"`{text}`"))).otherwise(0)
    places = docs.select(F.col("doc_id").alias("__id"), nameless.alias("__nameless"), F.explode(F.array_distinct(F.transform(F.filter(_lines(f"`{text}`"), lambda x: F.trim(x) != ""), _key))).alias("line_key"))
    marks = having(places, flagged).groupBy("__id", "__nameless").agg(F.collect_set("line_key").alias("__keys"))
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    rows = docs.select(*(F.col(f"`{c}`") for c in kept)).join(marks, F.col("doc_id").eqNullSafe(F.col("__id")) & (nameless == F.col("__nameless")), "left")
    lines = F.when(F.col(f"`{text}`").isNull(), F.array().cast("array<string>")).otherwise(_lines(f"`{text}`"))
    left = F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains(F.col("__keys"), _key(x)))
    rows = rows.withColumn("__left", F.when(F.col("__keys").isNull(), lines).otherwise(left))
    new = F.when(F.col("__keys").isNull(), F.col(f"`{text}`")).otherwise(F.array_join("__left", "\n")).alias(text)
    return rows.select(*(new if c == text else F.col(f"`{c}`") for c in kept), F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size("__left")).cast("long").alias("n_removed"))


def query(docs: DataFrame) -> DataFrame:
    """op3: the cleaned text of each document, by its hash."""
    out = remove_boilerplate(docs.select("doc_id", "source", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars_kept"), F.md5(F.coalesce("text", F.lit(""))).alias("kept_md5"))


SQL = f"""
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents WHERE text IS NOT NULL),
common AS (
  SELECT trim(line, ' ') AS line FROM lines WHERE trim(line, ' ') <> '' GROUP BY 1 HAVING count(DISTINCT source) >= {MIN_SITES}),
kept AS (
  SELECT doc_id, count(*) AS n_lines, count(c.line) AS n_removed,
         coalesce(string_agg(l.line, chr(10) ORDER BY pos) FILTER (WHERE c.line IS NULL), '') AS text
  FROM lines l LEFT JOIN common c ON trim(l.line, ' ') = c.line GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed,
       length(coalesce(k.text, ''))::BIGINT AS n_chars_kept, md5(coalesce(k.text, '')) AS kept_md5
FROM documents d LEFT JOIN kept k USING (doc_id)
"""
