"""Packing of token sequences: a configuration linear program over the length histogram.

Documents become token ids and an end id; longer ones than a sequence are cut. How often each length occurs is all that the program
needs: its columns are patterns of lengths that fit into a sequence, each length has to be covered as often as it occurs, and
the sequences are as few as possible. It is solved by multiplicative weights: the price of a length falls exponentially
with the share of it that is covered, a knapsack table over the prices gives the best pattern with each of the least
covered lengths, and those patterns are used a little more. The solution is rounded to whole uses of full patterns, of which none takes
more than there is; what is left is solved again, and when a round places nothing more, longest first.

The histogram has at most as many numbers as a sequence has tokens, whatever the table's size, and so has the plan: runs of
equal sequences. Pieces get numbers within their length (by counts of each task, so that no length meets in one task) and
find their run by number.

Null and empty texts are the end id alone. Rows repeated with one doc_id, and null ids, are documents of their own. An empty table
gives no rows. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phonoweave.llm.common import Scratch, broadcast_if_small, fresh_path, small_batches
from phonoweave.llm.token_files import encoder_of

CAPACITY = 2048
#: Knapsack tables of a solution, patterns taken from each, and the share of a length that one use of a pattern covers.
TABLES, ANCHORS, STEP = 60, 128, 0.5
#: How fast prices fall with coverage.
STEEP = 4.0
#: Solutions at most before the rest is packed longest first.
SOLUTIONS = 6
#: Counts of a task and length that are broadcast after a count.
MOST_BROADCAST = 200_000


def knapsack(prices: np.ndarray) -> np.ndarray:
    """The most that lengths can be worth within each capacity; prices: by length, -inf for lengths that don't occur."""
    best = np.zeros(len(prices))
    for c in range(1, len(prices)):
        best[c] = max(best[c - 1], (prices[1 : c + 1] + best[c - 1 :: -1]).max() if c > 1 else prices[1] + best[0])
    return best


def _pattern(prices: np.ndarray, best: np.ndarray, anchor: int, counts: np.ndarray) -> tuple[int, ...]:
    """The best pattern with a length, by the table; of each length no more than there are."""
    room, out, used = len(prices) - 1 - anchor, [anchor], Counter([anchor])
    blocked = [anchor] if counts[anchor] == 1 else []
    while room > 0:
        if best[room] - best[room - 1] <= best[-1] * 1e-9:  # what is worth nothing is covered by others
            room -= 1
            continue
        worth = prices[1 : room + 1] + best[room - 1 :: -1] if room > 1 else prices[1:2] + best[0]
        if blocked:
            worth = worth.copy()
            worth[[b - 1 for b in blocked if b <= room]] = -np.inf
        length = int(worth.argmax()) + 1
        if worth[length - 1] == -np.inf:
            break
        out.append(length)
        used[length] += 1
        if used[length] == counts[length]:
            blocked.append(length)
        room -= length
    return tuple(sorted(out, reverse=True))


def solve(counts: np.ndarray) -> tuple[dict[tuple[int, ...], float], np.ndarray]:
    """How often each pattern is used in a fractional solution, and the share of each length that is covered."""
    there = np.flatnonzero(counts)
    coverage, uses = np.zeros(len(counts)), Counter()
    for _ in range(TABLES):
        prices = np.full(len(counts), -np.inf)
        prices[there] = there * np.exp(-STEEP * (coverage[there] - coverage[there].min()))
        best = knapsack(prices)
        short = there[np.argsort(coverage[there], kind="stable")[:ANCHORS]]
        for anchor in short[coverage[short] < 1].tolist():
            if coverage[anchor] >= 1:
                continue
            pattern = _pattern(prices, best, anchor, counts)
            times = Counter(pattern)
            lengths, n = np.array(list(times)), np.array(list(times.values()))
            use = STEP * float((counts[lengths] / n).min())
            uses[pattern] += use
            coverage[lengths] += use * n / counts[lengths]
        if coverage[there].min() >= 1:
            break
    return uses, coverage


def _longest_first(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Best fit of lengths by falling size, equal sequences at a time."""
    left, out = counts.copy(), []
    while left.any():
        room, pattern, used = len(counts) - 1, [], Counter()
        while room > 0:
            fits = np.flatnonzero(left[: room + 1] - np.bincount(list(used.elements()), minlength=len(counts))[: room + 1] > 0)
            if not len(fits):
                break
            pattern.append(int(fits[-1]))
            used[pattern[-1]] += 1
            room -= pattern[-1]
        times = min(int(left[k]) // n for k, n in used.items())
        for k, n in used.items():
            left[k] -= n * times
        out.append((tuple(pattern), times))
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how many sequences have each; every length occurs as often as in the histogram."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    out = [((capacity,), int(left[capacity]))] if left[capacity] else []
    left[capacity] = 0
    for _ in range(SOLUTIONS):
        if left @ np.arange(capacity + 1) <= capacity:
            break
        placed = 0
        uses, coverage = solve(left)
        full = sorted((p for p in uses if sum(p) == capacity), key=lambda p: (-uses[p], p))
        # Whole uses, scaled so that none of the pattern's lengths is covered more than once; in the end fractions too.
        for share in (lambda p: int(uses[p] / max(1.0, coverage[list(p)].max())), lambda p: int(np.ceil(uses[p]))):
            if placed:
                break
            for pattern in full:
                times = min(share(pattern), *(int(left[k]) // n for k, n in Counter(pattern).items()))
                if times > 0:
                    left -= times * np.bincount(pattern, minlength=capacity + 1)
                    out.append((pattern, times))
                    placed += times
        if not placed:
            break
    return out + _longest_first(left)


def runs(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, ...]:
    """(key, sequence, offset) of each place in the plan, by key: its length, and the number of its first piece of that length."""
    taken, rows, sequence = Counter(), [], 0
    for pattern, times in patterns:
        offset = 0
        for length in pattern:
            rows.append(((length << 48) + taken[length], sequence, offset))
            taken[length] += times
            offset += length
        sequence += times
    return tuple(np.array(c, np.int64) for c in zip(*sorted(rows))) if rows else tuple(np.zeros(0, np.int64) for _ in range(3))


def cut(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, keep_ids: bool) -> DataFrame:
    """Pieces of documents: doc_id, piece, start, length, ids_crc32, (ids,) task, and number within task and length."""
    end = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "number"] + (["ids"] if keep_ids else [])
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]

    def run(batches):
        task, seen = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = []
            for doc_id, raw in zip(batch.column(0).to_pylist(), encoder_of(tokenizer).encode([t or "" for t in batch.column(1).to_pylist()])):
                raw += end
                for piece, at in enumerate(range(0, len(raw), 4 * capacity)):
                    ids = raw[at : at + 4 * capacity]
                    length = len(ids) // 4
                    rows.append((doc_id, piece, at // 4, length, zlib.crc32(ids), task, seen[length], ids))
                    seen[length] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types[: len(names)])], names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, number long" + (", ids binary" if keep_ids else "")
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece; with its ids (little-endian, 32 bits) if asked."""
    spark = docs.sparkSession
    small_batches(spark)
    path = fresh_path(spark, "pack-pieces")
    made = cut(docs, tokenizer, end_id, capacity, keep_ids)
    made.write.parquet(path)
    pieces = spark.read.schema(made.schema).parquet(path)
    with Scratch(spark) as scratch:
        counts = scratch.keep(pieces.groupBy("task", "length").count(), "pack-counts")
        # At most `capacity` rows.
        histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
        before = F.sum("count").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
        path = fresh_path(spark, "pack-numbers")
        numbered = counts.select("task", "length", F.coalesce(before, F.lit(0)).alias("before"))
        numbered.write.parquet(path)
    numbers = spark.read.schema(numbered.schema).parquet(path)
    places = spark.sparkContext.broadcast(runs(plan(histogram, capacity)))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + (["ids"] if keep_ids else [])

    def place(batches):
        keys, sequences, offsets = places.value
        for batch in batches:
            key = (batch.column("length").to_numpy().astype(np.int64) << 48) + batch.column("number").to_numpy()
            at = np.searchsorted(keys, key, "right") - 1
            found = [pa.array(sequences[at] + (key - keys[at])), pa.array(offsets[at])]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *found], names=[*names, "sequence_id", "offset"])

    joined = pieces.join(broadcast_if_small(numbers, MOST_BROADCAST), ["task", "length"]).withColumn("number", F.col("number") + F.col("before"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if keep_ids else "") + ", sequence_id long, offset long"
    return joined.select(*names, "number").mapInArrow(place, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids, lengths (of its pieces in order) of pack()'s rows with ids: at most `capacity` tokens a sequence."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "length", "ids"))).alias("p"))
    return parts.select("sequence_id", F.aggregate("p", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"), F.transform("p", lambda p: p["length"]).alias("lengths"))
