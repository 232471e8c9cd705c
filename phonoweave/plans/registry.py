"""All queries of the engine by name, and SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from phonoweave.plans import engine_queries, learned_queries, phonetic_queries, text_queries, word_queries

QUERIES = {**text_queries.QUERIES, **phonetic_queries.QUERIES, **engine_queries.QUERIES, **word_queries.QUERIES, **learned_queries.QUERIES}
ORACLE_SQL = {**text_queries.ORACLE_SQL, **phonetic_queries.ORACLE_SQL, **engine_queries.ORACLE_SQL, **word_queries.ORACLE_SQL}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of mixed texts with languages, spans and boundaries."""
    return text_queries.tokenize(spark, sf_dir)
