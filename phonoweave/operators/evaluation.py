"""Corpus evaluation: edit distance, case scores, summaries, worst cases, span overlap."""

from __future__ import annotations

import random
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phonoweave.functions.columns import written


def distance(left: Sequence[str | None], right: Sequence[str | None]) -> int:
    """Levenshtein distance of two sequences of units, a row of the table at a time as the bits of two whole numbers.

    A bit of `up` (`down`) says that the table rises (falls) by one from a row to the next in the column; a null equals nothing.
    """
    if not left or not right:
        return len(left) + len(right)
    places: dict[str, int] = {}
    for k, unit in enumerate(left):
        if unit is not None:
            places[unit] = places.get(unit, 0) | 1 << k
    full, top, n = (1 << len(left)) - 1, 1 << (len(left) - 1), len(left)
    up, down = full, 0
    for unit in right:
        same = places.get(unit, 0) if unit is not None else 0
        stays = same | down
        carried = (((same & up) + up) ^ up) | same
        rises, falls = down | (full & ~(carried | up)), up & carried
        n += bool(rises & top) - bool(falls & top)
        rises, falls = (rises << 1 | 1) & full, falls << 1 & full
        up, down = falls | (full & ~(stays | rises)), rises & stays
    return n


def edit_distance(left: Column, right: Column) -> Column:
    """distance() of two arrays; null where one is."""

    def run(lefts: pa.Array, rights: pa.Array) -> pa.Array:
        return pa.array([None if a is None or b is None else distance(a, b) for a, b in zip(lefts.to_pylist(), rights.to_pylist())], pa.int32())

    return F.arrow_udf(run, "int")(left, right)


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start < b_end) & (b_start < a_end)


def units_in(units: Column, start: Column, end: Column) -> Column:
    """Units (with source_spans) that overlap a span."""
    return F.filter(units, lambda u: F.exists(u["source_spans"], lambda s: overlaps(s["start"], s["end"], start, end)))


def score_cases(cases: DataFrame) -> DataFrame:
    """Adds edits, expected_units, exact: cases have id, expected and actual (arrays of units), error."""
    scored = cases.withColumns({"expected_units": F.size("expected"), "edits": F.when(F.col("error").isNotNull(), F.size("expected")).otherwise(edit_distance(F.col("expected"), F.col("actual")))})
    return scored.withColumn("exact", F.col("error").isNull() & (F.col("edits") == 0))


def coverage(expected: DataFrame, given: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that only one side has, once each, with `problem` missing or extra; null keys are keys like others."""
    e, g = (df.select(*keys).distinct() for df in (expected, given))
    return e.exceptAll(g).withColumn("problem", F.lit("missing")).union(g.exceptAll(e).withColumn("problem", F.lit("extra")))


def ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.round(F.try_divide(part, whole), 6), F.lit(0.0))


def summarize(scored: DataFrame, by: str | None = None) -> DataFrame:
    """Counts and rates over scored cases, in all or by a column."""
    grouped = scored.groupBy(by) if by else scored.groupBy()
    sums = grouped.agg(
        F.count("*").alias("cases"), F.count(F.when(F.col("error").isNull(), 1)).alias("completed"), F.count(F.when(F.col("exact"), 1)).alias("correct"),
        F.coalesce(F.sum("edits"), F.lit(0)).alias("unit_edits"), F.coalesce(F.sum("expected_units"), F.lit(0)).alias("units"),
    )
    return sums.withColumns({"accuracy": ratio(F.col("correct"), F.col("cases")), "unit_error_rate": ratio(F.col("unit_edits"), F.col("units"))})


def case_summary(scores: DataFrame, by: str | None = None) -> DataFrame:
    """Counts and rates of plans.evaluate's scores, in all or by a column: cases, normalized texts, targets and units."""
    grouped = scores.groupBy(by) if by else scores.groupBy()
    number = lambda c: F.count(F.when(c, 1))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    sums = grouped.agg(
        F.count("*").alias("cases"), number(F.col("error").isNull()).alias("completed"), F.count("normalized_exact").alias("normalized_cases"), number(F.col("normalized_exact")).alias("_normalized"), number(F.col("exact")).alias("_exact"),
        total("targets").alias("targets"), total("targets_correct").alias("targets_correct"), total("edits").alias("unit_edits"), total("expected_units").alias("expected_units"),
    )
    rates = {
        "normalized_exact_rate": ratio(F.col("_normalized"), F.col("normalized_cases")), "pronunciation_exact_rate": ratio(F.col("_exact"), F.col("cases")),
        "target_exact_rate": ratio(F.col("targets_correct"), F.col("targets")), "unit_error_rate": ratio(F.col("unit_edits"), F.col("expected_units")),
    }
    return sums.withColumns(rates).drop("_normalized", "_exact")


def failed() -> Column:
    """Cases with an error, another normalized text than expected (null expects none) or another pronunciation."""
    return F.col("error").isNotNull() | F.coalesce(~F.col("normalized_exact"), F.lit(False)) | ~F.col("exact")


def failures(scored: DataFrame, most: int = 100) -> DataFrame:
    """The first failed cases, errors before wrong ones, in the order of id."""
    return scored.where(~F.col("exact")).orderBy(F.col("error").isNull(), "id").limit(most)


def number_rows(rows: DataFrame, keys: str | list[str], index: str) -> tuple[DataFrame, int]:
    """(rows with their position from 0 in the order of the keys, their count).

    Rows are dealt by ranges of all keys, of any type, so rows that share the first key are parted by the others; each partition
    numbers its own rows, and what the partitions before it hold is added. Partitions are written to the session's shared folder
    once, so that numbers stay what they are when a task runs again. Null keys come first; rows equal in all keys are numbered in any order.
    """
    keys = [keys] if isinstance(keys, str) else keys
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    at = F.monotonically_increasing_id()  # the partition above 33 bits of the row's place in it
    placed = written(ranged.withColumns({"__part": F.shiftright(at, 33), "__at": at.bitwiseAND(F.lit((1 << 33) - 1))}), "numbered")
    before, n = [], 0
    # A row for each partition.
    for part, count in sorted(placed.groupBy("__part").count().collect()):
        before.append((part, n))
        n += count
    offsets = rows.sparkSession.createDataFrame(before, "__part long, __before long")
    return placed.join(F.broadcast(offsets), "__part").withColumn(index, F.col("__at") + F.col("__before")).drop("__part", "__at", "__before"), n


def sample(spark: SparkSession, rows: DataFrame, index: str, n: int, most: int | None, seed: int) -> DataFrame:
    """A fixed sample by position of `index` (0 to n - 1): the same rows as Python's generator picks, in source order."""
    if most is None or most >= n:
        return rows
    picked = spark.createDataFrame([(i,) for i in sorted(random.Random(seed).sample(range(n), most))], f"{index} long")
    return rows.join(F.broadcast(picked), index, "left_semi").orderBy(index)


