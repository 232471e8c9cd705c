"""The engine on streams: conversion is stateless, so tokens and results need no watermark; evaluation sums by mode."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonoweave.operators import tokens as T
from phonoweave.operators.evaluation import score_cases, summarize
from phonoweave.plans.engine import Engine


def stream_tokens(stream: DataFrame, text: str = "text") -> DataFrame:
    """The stream with an array of tokens."""
    return stream.withColumn("tokens", T.tokens(F.col(text)))


def stream_results(stream: DataFrame, engine: Engine, text: str = "text") -> DataFrame:
    return engine.transform(stream, text)


def stream_summary(cases: DataFrame) -> DataFrame:
    """Rates by mode over a stream of cases; write it in update or complete mode."""
    return summarize(score_cases(cases), "mode")
