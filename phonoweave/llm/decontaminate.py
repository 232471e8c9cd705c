"""Benchmark decontamination by SimHash over item-sized windows.

Words are runs of anything but ASCII white space, A-Z lower-cased; shingles are five words, weighted by their counts. For
each benchmark item of n words, windows of n words over every document are compared with it. A window without any of the
item's shingles has similarity 0, so windows are placed where a shingle of an item of that size occurs, aligned with its
place in the item. Each window gets a
64-bit SimHash. Fingerprints are cut into radius + 1 blocks, so two of them within the radius agree in a block for sure;
equal blocks of items of the same size are the candidates. Candidates within the radius are verified by the exact weighted
Jaccard similarity of their shingles, which has to reach 0.8. At that similarity the fingerprints are 10 bits apart on
average (deviation 2.9), so a radius of 22 misses about one window in 100,000. Such a radius leaves blocks of 2 or 3 bits, and
no width of fingerprint does much better: a share of 0.15 of the bits differs, so blocks have fewer than 1 / 0.15 bits. What
selects is the size of the item, by which both sides are joined, and the radius, which one in 160 unrelated pairs passes.

Null, blank and empty texts match nothing, on either side. Documents or items of fewer than five words are one shingle. A
window at a document's edge is moved inside; a document shorter than an item is one window. Rows repeated with one doc_id
and item_id give one row, that of the highest similarity and then the smallest place; null is a doc_id like others, and
contaminated_rows() tells its rows apart. Other columns are not read. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phonoweave.llm.common import Scratch, broadcast_if_small, materialize, row_key, shingle_hashes, with_marks, word_hashes

SHINGLE, SIMILARITY, RADIUS, BITS = 5, 0.8, 22, 64
#: Places of shingles, or rows of the index, that are broadcast after a count; more are joined by a shuffle.
MOST_BROADCAST = 1_000_000


def simhash(shingles: Column) -> Column:
    """64-bit fingerprint: the majority of each bit over all shingles, counts as weights."""
    n = F.size(shingles)

    def bit(b: int) -> Column:
        ones = F.aggregate(shingles, F.lit(0), lambda a, h: a + F.getbit(h, F.lit(b)).cast("int"))
        return F.when(2 * ones > n, F.shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))

    out = bit(0)
    for b in range(1, BITS):
        out = out.bitwiseOR(bit(b))
    return out


def blocks(fingerprint: Column, radius: int = RADIUS) -> Column:
    """Array of (k, v): the fingerprint in radius + 1 blocks."""
    n = radius + 1
    cuts = [BITS * k // n for k in range(n + 1)]
    return F.array(
        *[
            F.struct(F.lit(k).alias("k"), F.shiftright(fingerprint, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("v"))
            for k, (a, b) in enumerate(zip(cuts, cuts[1:]))
        ]
    )


def weighted_jaccard(left: Column, right: Column) -> Column:
    """Sum of the lesser counts over sum of the greater counts."""

    def times(a: Column, x: Column) -> Column:
        return F.size(F.filter(a, lambda y: y == x))

    least = F.aggregate(F.array_intersect(left, right), F.lit(0), lambda s, x: s + F.least(times(left, x), times(right, x)))
    return least / (F.size(left) + F.size(right) - least)


def _matches(docs: DataFrame, benchmark: DataFrame, similarity: float, radius: int, scratch: Scratch) -> DataFrame:
    items = scratch.keep(
        benchmark.select("item_id", word_hashes(F.col("text")).alias("w"))
        .where(F.size("w") > 0)
        .select("item_id", F.size("w").alias("n"), shingle_hashes(F.col("w"), SHINGLE).alias("item"))
        .distinct()
        .withColumns({"fp": simhash(F.col("item")), "item_key": F.xxhash64("item_id", "item")}),
        "leak-items",
    )
    places = broadcast_if_small(items.select("n", F.posexplode("item").alias("offset", "h")).distinct(), MOST_BROADCAST)
    texts = docs.select(row_key(docs).alias("row"), shingle_hashes(word_hashes(F.col("text")), SHINGLE).alias("s"))
    # Outer: an inner explode would first compute the array once more, for a filter.
    hits = texts.select("row", F.posexplode_outer("s").alias("p", "h")).join(places, "h")
    anchors = scratch.keep(hits.select("row", "n", (F.col("p") - F.col("offset")).alias("at")).distinct(), "leak-anchors")
    start = F.greatest(F.lit(0), F.least(F.col("at"), F.size("w") - F.col("n")))
    windows = (
        with_marks(docs, anchors)
        .select("row", "doc_id", word_hashes(F.col("text")).alias("w"), "marks")
        .select("row", "doc_id", "w", F.explode("marks").alias("m"))
        .select("row", "doc_id", "w", "m.n", "m.at")
        .select("row", "doc_id", "n", start.alias("start"), "w")
        .select("row", "doc_id", "n", "start", F.slice("w", F.col("start") + 1, F.col("n")).alias("w"))
        .distinct()
        .withColumn("window", shingle_hashes(F.col("w"), SHINGLE))
    )
    # Windows that many documents share get their fingerprint, candidates and similarity once.
    windows = scratch.keep(windows.select("row", "doc_id", "n", "start", "window", F.xxhash64("window").alias("key")), "leak-windows")
    distinct = windows.groupBy("n", "key").agg(F.first("window").alias("window"))
    distinct = scratch.keep(distinct.withColumn("fp", simhash(F.col("window"))), "leak-distinct")
    # The index holds numbers only; shingles are joined to the pairs that pass the radius.
    keyed = items.select("n", "item_key", F.col("fp").alias("item_fp"), F.explode(blocks(F.col("fp"), radius)).alias("b")).select("n", "item_key", "item_fp", "b.k", "b.v")
    # The first block in which the two agree brings the pair, the others don't bring it again.
    agree = F.array_position(F.zip_with(blocks(F.col("fp"), radius), blocks(F.col("item_fp"), radius), lambda a, b: a["v"] == b["v"]), True)
    near = (
        distinct.select("n", "key", "fp", F.explode(blocks(F.col("fp"), radius)).alias("b"))
        .select("n", "key", "fp", "b.k", "b.v")
        .join(broadcast_if_small(keyed, MOST_BROADCAST), ["n", "k", "v"])
        .where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius)
        .where(agree == F.col("k") + 1)
        .select("n", "key", "item_key")
    )
    found = (
        near.join(items.select("n", "item_key", "item_id", "item"), ["n", "item_key"])
        .join(distinct.select("n", "key", "window"), ["n", "key"])
        .withColumn("similarity", weighted_jaccard(F.col("window"), F.col("item")))
        .where(F.col("similarity") >= similarity)
        .select("n", "key", "item_id", F.round("similarity", 6).alias("similarity"))
    )
    return materialize(windows.select("row", "doc_id", "n", "start", "key").join(found, ["n", "key"]).select("row", "doc_id", "item_id", "similarity", "start"), "leak-matches")


def matches(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """row (its row_key()), doc_id, item_id, similarity, start (word place) of every window that holds an item."""
    with Scratch(docs.sparkSession) as scratch:
        return _matches(docs, benchmark, similarity, radius, scratch)


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """doc_id, item_id, similarity, start (word place of the best window): a row for each document and item that it holds."""
    return (
        matches(docs, benchmark, similarity, radius)
        .groupBy("doc_id", "item_id")
        .agg(F.max(F.struct("similarity", (-F.col("start")).alias("start"))).alias("best"))
        .select("doc_id", "item_id", "best.similarity", (-F.col("best.start")).alias("start"))
    )


def contaminated_rows(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """row: the row_key() of each row that holds an item, once."""
    return matches(docs, benchmark, similarity, radius).select("row").distinct()
