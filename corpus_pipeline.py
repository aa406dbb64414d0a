"""Preparing documents for training: language ID, line dedup, near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last return the columns
of documents; the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastermill.llm import jaccard, language, lines, mixing, packing
from rastermill.llm.common import written

#: Share of the remaining tokens that the mix takes.
MIX_SHARE = 0.9


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; lang becomes the predicted one. Texts without letters go."""
    found = language.classify(docs, language.fit(docs), keep_text=True)
    return found.where(~F.col("rejected")).withColumn("lang", F.col("lang_pred")).select(docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that stand on many sites; n_chars follows the text. No document goes."""
    found = lines.remove_boilerplate(docs)
    return found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity of 0.8 or more."""
    return jaccard.one_of_each(docs).select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A mix of MIX_SHARE of the tokens by domain, language and source; no document twice."""
    return mixing.select(docs, mixing.domain_of(F.col("source")), mixing.WEIGHTS, share=MIX_SHARE, max_epochs=1, seed=17).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens, neighbours on the curve together."""
    return packing.pack(docs)


STAGES = [("language", identify_language), ("lines", dedup_lines), ("near_duplicates", drop_near_duplicates), ("mixing", mix), ("packing", pack)]

#: Compression, shingle hashes and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
