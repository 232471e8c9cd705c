"""Lexicon sources: any table, or plain files, with overrides on top."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a text file, trimmed, without blank ones."""
    return spark.read.text(path).select(F.trim("value").alias("value")).where("value <> ''")


def json_mapping(spark: SparkSession, path: str) -> DataFrame:
    """key, values from a JSON file of one object whose values are strings or lists of strings."""
    parsed = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m"))
    rows = parsed.select(F.explode("m").alias("key", "value"))
    return rows.select("key", F.when(F.col("value").startswith("["), F.from_json("value", "array<string>")).otherwise(F.array("value")).alias("values"))


def pronouncing(spark: SparkSession, path: str) -> DataFrame:
    """word, readings from lines `WORD  PH ON ES` or `WORD(2)  ...`, readings in the order of their number; `;;;` starts comments."""
    rows = lines(spark, path).where(~F.col("value").startswith(";;;"))
    word = F.lower(F.regexp_extract("value", r"^(\S+?)(?:\((\d+)\))?\s", 1))
    number = F.coalesce(F.nullif(F.regexp_extract("value", r"^(\S+?)(?:\((\d+)\))?\s", 2), F.lit("")).cast("int"), F.lit(1))
    parsed = rows.select(word.alias("word"), number.alias("k"), F.regexp_extract("value", r"^\S+\s+(.*)$", 1).alias("reading"))
    return parsed.groupBy("word").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "reading"))), lambda x: x["reading"]).alias("readings"))


def without(lexicon: DataFrame, forced: DataFrame) -> DataFrame:
    """The lexicon without the words (column value) that are always spelled."""
    return lexicon.join(forced.select(F.lower("value").alias("word")).distinct(), "word", "left_anti")


def phrases(spark: SparkSession, path: str) -> DataFrame:
    """phrase, readings, problem from lines `phrase reading reading ...`; a problem where the counts differ."""
    parts = lines(spark, path).select(F.split("value", r"\s+").alias("p"))
    rows = parts.select(F.get("p", 0).alias("phrase"), F.slice("p", 2, F.size("p")).alias("readings"))
    return rows.withColumn("problem", F.when(F.size("readings") != F.length("phrase"), F.lit("readings and characters differ in number")))


def homographs(spark: SparkSession, path: str) -> DataFrame:
    """word, matching, other, prefix from lines `word|matching|other|prefix`; `#` starts comments; problem marks other lines."""
    rows = lines(spark, path).where(~F.col("value").startswith("#")).select(F.split("value", r"\|").alias("p"))
    part = lambda k: F.get("p", k)
    return rows.select(F.lower(part(0)).alias("word"), part(1).alias("matching"), part(2).alias("other"), part(3).alias("prefix"), F.when(F.size("p") != 4, "four fields expected").alias("problem"))


def with_overrides(base: DataFrame, override: DataFrame, key: str) -> DataFrame:
    """Rows of base, replaced by those of override with the same key; both have one row for a key."""
    both = override.withColumn("_rank", F.lit(0)).unionByName(base.withColumn("_rank", F.lit(1)))
    first = both.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("_rank")))
    return first.where("_n = 1").drop("_rank", "_n")


def readings_of_characters(spark: SparkSession, path: str) -> DataFrame:
    """char, readings from lines `char reading,reading ...`: those with a tone, each once, in their order."""
    parts = lines(spark, path).select(F.split("value", r"[\s,]+").alias("p"))
    return parts.select(F.get("p", 0).alias("char"), F.array_distinct(F.filter(F.slice("p", 2, F.size("p")), lambda r: r.rlike("[1-6]$"))).alias("readings"))


def require_sound(rows: DataFrame) -> DataFrame:
    """The rows of phrases() or homographs(); ValueError with the first problem, if there is one."""
    bad = rows.where("problem is not null").first()
    if bad is not None:
        raise ValueError(f"{bad[0]}: {bad.problem}")
    return rows.drop("problem")


def as_mapping(rows: DataFrame, most: int = 2_000_000) -> dict:
    """A lexicon of two columns as the mapping that Options take; ValueError beyond so many rows, which workers would hold."""
    got = rows.limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"a lexicon of more than {most} rows is to be joined, not held")
    return {r[0]: list(r[1]) if isinstance(r[1], list) else r[1] for r in got}
