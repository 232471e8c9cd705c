"""Queries of what is learned from tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phonoweave.functions.columns import written
from phonoweave.operators import sounds, spelling
from phonoweave.operators.evaluation import edit_distance
from phonoweave.plans.text_queries import dealt

#: Words that sounds are learned from: those with the least hashes.
TAUGHT = 20_000


def _by_rules(words: pa.Array) -> pa.Array:
    return pa.array([None if w is None else " ".join(spelling.letter_to_sound(w)) for w in words.to_pylist()], pa.string())


def learned_sounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letter-to-sound learned from TAUGHT of four fifths of the documents' distinct words, and how it reads all the others.

    The tables hold no pronouncing dictionary, so the letter-to-sound rules say the words: what is measured is how well the rules are
    learned from words alone.
    """
    letters = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    words = dealt(spark, sf_dir).select(F.explode(letters).alias("word")).distinct()
    said = written(words.select("word", F.arrow_udf(_by_rules, "string")("word").alias("phones")), "words")
    held = F.crc32(F.col("word").cast("binary")) % 5 == 0
    taught = said.where(~held).orderBy(F.xxhash64("word"), "word").limit(TAUGHT)
    model = sounds.Sounds.of(sounds.learn(taught))
    read = sounds.read(said.where(held).withColumnRenamed("phones", "taught"), model, result="learned")
    units = lambda c: F.filter(F.split(c, " "), lambda p: p != "")
    return read.select("word", "taught", "learned", F.size(units("taught")).alias("n_phones"), edit_distance(units("taught"), units("learned")).alias("errors"))


QUERIES = {"learned_sounds": learned_sounds}
