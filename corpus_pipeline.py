"""The training-data pipeline: quality rules, line dedup, near-duplicate join, decontamination, tokens.

Each stage works on all that its predecessor kept.  ``run`` writes every stage's
result to the shared folder and reads it again, so a lost executor costs one stage
at most.

Defined results: null and empty texts fail the base rule of the first stage; rows
equal in id and text are one document to line dedup and copies to the
near-duplicate join, which keeps one row of each component and tells texts with one id
apart; rows with a null id
are judged by themselves and never stand for others; further columns are handed on
as they are up to the last stage, which returns its own columns; an empty table
gives no rows, and an empty benchmark leaks nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import decontaminate, jaccard_join, line_dedup, quality_rules, sentencepiece_bpe
from lattica.llm.common import materialize
from lattica.llm.registry import PIECES, vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of good quality by weak supervision."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go, and with them documents that are nothing but copies."""
    kept = line_dedup.drop_copies(docs, counts=True).where((F.col("_lines.n_lines") == 0) | (F.col("_lines.n_dropped") < F.col("_lines.n_lines"))).drop("_lines")
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the least id."""
    return jaccard_join.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontaminate.remove_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the text that they decode to."""
    return sentencepiece_bpe.digests(docs, vocabulary(PIECES))


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("SentencePiece", pieces),
]

#: SQL expresses neither the estimates of the first stage nor the tokens of the last.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs, _ = materialize(docs, name.replace(" ", "-"))
    return docs
