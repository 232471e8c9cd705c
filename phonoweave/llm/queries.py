"""Queries of the training-data operators over the whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from phonoweave.functions.columns import spread
from phonoweave.llm import byte_bpe, centroids, chat, decontaminate, html_text, jaccard_join, licenses, packing, quality, ranked_search, token_files, vector_dedup, wordpiece
from phonoweave.llm.common import table
from phonoweave.llm.oracle import ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]

Query = Callable[[SparkSession, str], DataFrame]


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    tools = spark.createDataFrame([chat.RESPOND], "name string, parameter string, type string, required boolean")
    return chat.link_calls(table(spark, sf_dir, "conversations"), tools)


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(spread(table(spark, sf_dir, "documents")))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.wordpiece_counts(spread(table(spark, sf_dir, "documents")), public_tokenizers.path("word_bpe_49k.json"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(spread(table(spark, sf_dir, "documents")), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.fit_and_score(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"), threshold=0.3)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(spread(table(spark, sf_dir, "documents")), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(spread(table(spark, sf_dir, "documents")))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(spread(table(spark, sf_dir, "pages")))


def op10_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.vector_components(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spread(table(spark, sf_dir, "documents")), public_tokenizers.path("word_bpe_49k.json"), end_id=0, capacity=2048)


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clusters(spread(table(spark, sf_dir, "embeddings")), k=16, width=64, rounds=3)


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"), most=20)


QUERIES: dict[str, Query] = {
    "op1_chat_format": op1_chat_format,
    "op2_licenses": op2_licenses,
    "op4_decontaminate": op4_decontaminate,
    "op8_jaccard_join": op8_jaccard_join,
    "op3_token_counts": op3_token_counts,
    "op5_token_files": op5_token_files,
    "op6_quality": op6_quality,
    "op7_byte_bpe": op7_byte_bpe,
    "op9_html_text": op9_html_text,
    "op10_vector_dedup": op10_vector_dedup,
    "op11_packing": op11_packing,
    "op12_centroids": op12_centroids,
    "op13_ranked_search": op13_ranked_search,
}
