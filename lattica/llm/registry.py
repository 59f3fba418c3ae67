"""Queries of the training-data operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_blocks, huffman, jaccard_join, line_dedup, prefix_trie, quality_rules, sentencepiece_bpe, substring_dedup, suffix_tree, token_counts, url_filter, vector_codes
from .common import ship

TOKENIZER = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_copies(_table(spark, sf_dir, "documents"), counts=True)
    return kept.select("doc_id", "_lines.n_lines", "_lines.n_dropped", F.md5("text").alias("text_md5"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("score", 3).alias("score"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"), url_filter.default_list(spark))


def op4_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract(_table(spark, sf_dir, "pages"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), vocabulary(TOKENIZER))


def op6_huffman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return huffman.round_trip(_table(spark, sf_dir, "documents"), vocabulary(TOKENIZER))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(_table(spark, sf_dir, "documents"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components(_table(spark, sf_dir, "documents"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.digests(_table(spark, sf_dir, "documents"), vocabulary(PIECES))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(_table(spark, sf_dir, "conversations"))


def op12_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.scores(_table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.codes(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_line_dedup,
        op2_decontaminate,
        op3_url_filter,
        op4_html_blocks,
        op5_token_counts,
        op6_huffman,
        op7_substring_dedup,
        op8_jaccard_join,
        op9_sentencepiece,
        op10_quality_rules,
        op11_prefix_trie,
        op12_suffix_tree,
        op13_vector_codes,
    )
}

ORACLES: dict[str, str] = {
    "op1_line_dedup": line_dedup.ORACLE_SQL,
    "op3_url_filter": url_filter.ORACLE_SQL,
    "op8_jaccard_join": jaccard_join.ORACLE_SQL,
    "op11_prefix_trie": prefix_trie.ORACLE_SQL,
    "op13_vector_codes": vector_codes.ORACLE_SQL,
}
