"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import fingerprints, jaccard, language, lines, mixing, packing, quality, substrings, toxicity, warc
from .common import table


def _on(name: str, f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(table(spark, sf_dir, name))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substrings": _on("documents", substrings.query),
    "op2_language": _on("documents", language.query),
    "op3_lines": _on("documents", lines.query),
    "op4_jaccard": _on("documents", jaccard.query),
    "op5_mixing": _on("documents", mixing.query),
    "op6_fingerprints": _on("documents", fingerprints.query),
    "op7_packing": _on("documents", packing.query),
    "op8_warc": _on("pages", warc.query),
    "op9_quality": lambda spark, sf_dir: quality.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op10_toxicity": lambda spark, sf_dir: toxicity.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
}

ORACLE_SQL: dict[str, str] = {"op3_lines": lines.SQL, "op8_warc": warc.SQL}
