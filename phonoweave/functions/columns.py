"""Small column builders."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_BLOCK = 16
#: Rows and bytes of an Arrow batch of texts handed to Python: what is made of a text is many times its size.
BATCH_ROWS, BATCH_BYTES = 1000, 1 << 22


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def literal_map(entries: Mapping) -> Column:
    return F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])


def look_up(entries: Mapping, key: Column) -> Column:
    """The entry of a small constant table; null if there is none."""
    return F.try_element_at(literal_map(entries), key)


def prefix_sums(values: Column) -> Column:
    """For each element the sum of those before it, block by block, so that a long array costs little more than its length."""

    def of(v: Column) -> Column:
        blocks = F.ceil(F.size(v) / F.lit(_BLOCK)).cast("int")
        total = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x)
        sums = F.when(blocks > 0, F.transform(F.sequence(F.lit(0), blocks - 1), lambda b: total(F.slice(v, b * _BLOCK + 1, _BLOCK)))).otherwise(F.array().cast("array<int>"))

        def with_sums(s: Column) -> Column:
            wide = F.ceil(F.size(s) / F.lit(_BLOCK)).cast("int")
            over = F.when(wide > 0, F.transform(F.sequence(F.lit(0), wide - 1), lambda b: total(F.slice(s, 1, b * _BLOCK)))).otherwise(F.array().cast("array<int>"))
            base = let(over, lambda o: F.transform(s, lambda _, b: F.get(o, F.floor(b / F.lit(_BLOCK)).cast("int")) + total(F.slice(s, F.floor(b / F.lit(_BLOCK)).cast("int") * _BLOCK + 1, F.pmod(b, F.lit(_BLOCK))))))
            return let(base, lambda start: F.transform(v, lambda _, i: F.get(start, F.floor(i / F.lit(_BLOCK)).cast("int")) + total(F.slice(v, F.floor(i / F.lit(_BLOCK)).cast("int") * _BLOCK + 1, F.pmod(i, F.lit(_BLOCK))))))

        return let(sums, with_sums)

    return let(values, of)


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that hold texts, so that Python's memory does not grow with a partition's rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt over all cores where a table has fewer partitions than there are cores, as one of a single row group has.

    For costly work on each row; tables of many partitions, and streams, stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.isStreaming or df._jdf.queryExecution().toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def written(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write the rows to the folder that all executors share, as the session names it, and read them again.

    A local session without such a folder gets one of this machine.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="phonoweave-")
        spark.sparkContext.setCheckpointDir(folder)
    path = f"{folder.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
