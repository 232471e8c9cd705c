"""Helpers that the training-data operators share: the shared folder, lineage cuts, checked broadcasts, columns."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch handed to Python: texts can be long, so a batch stays small.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that hold whole texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it. A local session without one gets a folder of this machine."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="phonoweave-")
        spark.sparkContext.setCheckpointDir(configured)
    return configured.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write the rows to the shared folder and read them again."""
    path = fresh_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder made by fresh_path(), on whatever file system it is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


class Scratch:
    """Tables of one computation, by name. drop() deletes them after their last use, the end of the block deletes the rest."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.drop(*self.paths)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write a table and read it; one of the same name goes after that."""
        path, before = fresh_path(self.spark, name), self.paths.get(name)
        df.write.parquet(path)
        if before:
            remove(self.spark, before)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables, and let Spark delete the shuffle files of queries that nothing refers to any more."""
        for name in names:
            remove(self.spark, self.paths.pop(name))
        gc.collect()
        self.spark._jvm.System.gc()


def broadcast_if_small(df: DataFrame, most_rows: int) -> DataFrame:
    """Broadcast only after counting; a larger side is left to a shuffled join, which skew handling can split."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


#: White space between words, as all word operators here take it.
BLANKS = " \t\n\x0b\f\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value, body) -> F.Column:
    """body(value) with the value computed once, however often the body uses it and the optimizer copies the expression."""
    return F.get(F.transform(F.array(value), body), 0)


def words(text) -> F.Column:
    """Array of words: runs of anything but white space, A-Z lower-cased. Empty for null and blank texts."""
    trimmed = F.btrim(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(BLANKS))
    return F.filter(F.split(trimmed, "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")


def word_hashes(text) -> F.Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def shingle_hashes(hashes, size: int) -> F.Column:
    """Array of 64-bit shingle hashes by position, from an array of word hashes; fewer words make one shingle, none make none."""

    def of(w):
        n = F.size(w)
        whole = F.transform(F.sequence(F.lit(0), n - size), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)]))
        short = F.array(F.aggregate(w, F.lit(7).cast("long"), lambda a, h: F.xxhash64(a, h)))
        return F.when(n >= size, whole).when(n > 0, short).otherwise(F.array().cast("array<bigint>"))

    return let(hashes, of)


def row_key(docs: DataFrame) -> F.Column:
    """A row's own key, never null: 128 bits of doc_id and text, so that only rows that agree in both share one."""
    parts = [docs["doc_id"].isNull(), docs["doc_id"].cast("long"), docs["text"]]
    return F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit(1), *parts).alias("b"))


def with_marks(docs: DataFrame, marks: DataFrame, most: int = 50_000) -> DataFrame:
    """Texts of the documents that have marks: row, doc_id, text, marks (all of the row's, as an array).

    marks: row (as row_key() has it) and other columns, distinct, materialized. Few marked documents are broadcast after a
    count; more are shuffled.
    """
    names = [c for c in marks.columns if c != "row"]
    grouped = marks.groupBy("row").agg(F.collect_list(F.struct(*names)).alias("marks"))
    few = marks.limit(most + 1).count() <= most
    texts = docs.select(row_key(docs).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.join(F.broadcast(grouped) if few else grouped, "row")
