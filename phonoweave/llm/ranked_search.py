"""Ranked lexical search by three phases over term-partitioned postings (TPUT).

One pass over the documents counts terms and writes postings of those that occur in an item; lists of postings are then
partitioned by term and falling score, a long list into several partitions. An item's score of a document is the sum, over the
item's terms, of the document's entries in their lists, so for each item:

1. the heads of its lists give partial sums; the documents with the largest are looked up, and their most-th largest score is a
   bound that the result reaches;
2. every list yields all entries above one level, the same for all lists of the item: a list adds at most the level, and at most its
   head, to a document that it does not yield, and the level is the highest at which these sum up to less than a share of the
   bound (LOOSE; a lower level costs longer fetches, and saves look-ups). So a document that no list yields cannot
   reach the bound. What is yielded is summed up by document, in blocks; a document whose sum and what may be hidden
   of it stay under the bound goes;
3. the rest's entries at or under the level are looked up, which makes scores exact.

Items are searched in slices of bounded size, so that their tables can be sent to every task.

Terms are maximal runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased. Null and empty texts have no terms
and count in no statistic. Rows repeated with one doc_id are documents of their own, and rows repeated with one item_id items
of their own; null ids rank first among equal scores. Items without a known term, and all items over an empty table, have no rows. Other
columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phonoweave.llm.common import Scratch, broadcast_if_small, materialize, small_batches

MOST = 20
#: Entries of a list's head, and documents that are looked up for an item's bound, as multiples of the result's.
HEADS, PROBES = 5, 5
#: The share of the bound that entries which no list yields may sum up to.
LOOSE = 0.25
#: Terms of a slice of items; entries that are summed up together; items that are at a time.
SLICE, BLOCK, ITEMS = 100_000, 400_000, 512
#: Terms of all items, and their bytes, up to which documents are filtered by a set in each task; more are joined.
MOST_TERMS, MOST_BYTES = 200_000, 8_000_000
#: Rows of tables of items, terms or candidates that are broadcast after a count.
MOST_BROADCAST = 200_000
#: Postings of an Arrow batch.
_ROWS = 100_000
_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
_POSTING = "row long, id long, term string, tf long, n long"


def terms(text: str | None) -> list[bytes]:
    """Bytes of all terms, in order: a character beyond ASCII is a run of bytes beyond ASCII."""
    return _TERM.findall((text or "").encode("utf-8", "surrogatepass").lower())


def count_terms(rows: DataFrame, wanted: frozenset[bytes] | None = None) -> DataFrame:
    """id, text to postings: row (a number of its own), id, term, tf, n (all terms of the text), of wanted terms or all.

    Each task adds a row without a term: in tf its texts with at least one term, in n their terms.
    """

    def run(batches):
        base, at, texts, total = TaskContext.get().partitionId() << 33, 0, 0, 0
        out: list[list] = [[], [], [], [], []]

        def batch():
            made = pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k == 2 else pa.int64()) for k, c in enumerate(out)], names=["row", "id", "term", "tf", "n"])
            for c in out:
                c.clear()
            return made

        for given in batches:
            for key, text in zip(given.column(0).to_pylist(), given.column(1).to_pylist()):
                found = terms(text)
                at += 1
                if not found:
                    continue
                texts, total = texts + 1, total + len(found)
                counts = Counter(found if wanted is None else filter(wanted.__contains__, found))
                out[0] += [base + at] * len(counts)
                out[1] += [key] * len(counts)
                out[2] += [t.decode("utf-8", "surrogatepass") for t in counts]
                out[3] += counts.values()
                out[4] += [len(found)] * len(counts)
                if len(out[0]) >= _ROWS:
                    yield batch()
        for column, value in zip(out, (None, None, None, texts, total)):
            column.append(value)
        yield batch()

    return rows.mapInArrow(run, _POSTING)


def _nth(df: DataFrame, by: str, value: str, n: int) -> DataFrame:
    """by, bound: the n-th largest value of each group; groups of fewer rows have none."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.col(value).desc()))
    return df.withColumn("_place", place).where(F.col("_place") <= n).where(F.col("_place") == n).select(by, F.col(value).alias("bound"))


def _score(n_docs: int, n_terms: int) -> tuple[Column, Column, Column]:
    """(w from df, m from n, entry of a list from w, tf and m); n times the documents may pass 64 bits on the way to m."""
    weight = F.floor(1000 * F.log(F.lit(float(2 * n_docs + 2)) / (2 * F.col("df") + 1).cast("double")))
    length = F.expr(f"cast((25 * cast(n as decimal(20,0)) * {n_docs}) div {max(1, n_terms)} as bigint) + 75")
    return weight.cast("long"), length, F.col("w") * F.expr("(1000000000L * tf) div (1000L * tf + 12L * m)")


def level(tops: list[int], most: int) -> int:
    """The largest level at which the sum of min(level, top) over the lists is at most `most`."""
    left, lists = most, len(tops)
    for top in sorted(tops):
        if top > left // lists:
            return left // lists
        left, lists = left - top, lists - 1
    return max(tops)


class _Slice:
    """Items of one slice as arrays: for each term the items that have it."""

    def __init__(self, own: list, bounds: dict[int, int]):
        self.items = sorted({r.item for r in own})
        place = {item: k for k, item in enumerate(self.items)}
        tops: list[list[int]] = [[] for _ in self.items]
        for r in own:
            tops[place[r.item]].append(r.times * r.top)
        self.bound = np.array([bounds.get(item, 1) for item in self.items], np.int64)
        self.level = np.array([level(t, int(LOOSE * (b - 1))) for t, b in zip(tops, self.bound.tolist())], np.int64)
        self.terms = sorted({r.term for r in own})
        number = {term: k for k, term in enumerate(self.terms)}
        self.term = np.array([number[r.term] for r in own], np.int64)
        self.item = np.array([place[r.item] for r in own], np.int64)
        self.times = np.array([r.times for r in own], np.int64)
        self.hidden = np.minimum(self.level[self.item], self.times * np.array([r.top for r in own], np.int64))
        self.rest = np.bincount(self.item, self.hidden, len(self.items)).astype(np.int64)
        # The least entry of a term's list that some item gets.
        self.least = np.full(len(self.terms), np.iinfo(np.int64).max)
        np.minimum.at(self.least, self.term, self.level[self.item] // self.times + 1)
        # Pairs of item and term, by number, for look-ups.
        self.pair = self.item * len(self.terms) + self.term
        self.order = np.argsort(self.pair)

    def under_level(self, item: np.ndarray, row: np.ndarray, terms: np.ndarray, values: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """For each pair of item and row the sum of the row's entries in the item's lists that the lists do not yield."""
        order = np.argsort(rows, kind="stable")
        terms, values, rows = terms[order], values[order], rows[order]
        begin, size = np.searchsorted(rows, row), np.searchsorted(rows, row, "right") - np.searchsorted(rows, row)
        place = np.searchsorted(np.array(self.items, np.int64), item)
        pairs, out, ends = self.pair[self.order], np.zeros(len(item), np.int64), np.cumsum(size)
        for at in range(0, int(ends[-1]) if len(ends) else 0, 1 << 20):
            k = np.arange(at, min(at + (1 << 20), int(ends[-1])))
            of = np.searchsorted(ends, k, "right")
            entry = begin[of] + k - (ends[of] - size[of])
            key = place[of] * len(self.terms) + terms[entry]
            found = np.minimum(np.searchsorted(pairs, key), len(pairs) - 1)
            has = pairs[found] == key
            of, gain = of[has], values[entry[has]] * self.times[self.order[found[has]]]
            low = gain <= self.level[place[of]]
            np.add.at(out, of[low], gain[low])
        return out

    def sums(self, terms: np.ndarray, values: np.ndarray, rows: np.ndarray, n_rows: int):
        """(row, item, sum) of all that may reach the items' bounds, from entries of the lists."""
        for first in range(0, len(self.items), ITEMS):
            mine = np.flatnonzero((self.item >= first) & (self.item < first + ITEMS))
            mine = mine[np.argsort(self.term[mine], kind="stable")]
            begin = np.searchsorted(self.term[mine], np.arange(len(self.terms) + 1))
            n_items = min(ITEMS, len(self.items) - first)
            total, known = np.zeros(n_rows * n_items, np.int64), np.zeros(n_rows * n_items, np.int64)
            fan = (begin[1:] - begin[:-1])[terms]
            ends = np.cumsum(fan)
            for at in range(0, int(ends[-1]) if len(ends) else 0, 1 << 20):  # so many pairs of entry and item at a time
                pair = np.arange(at, min(at + (1 << 20), int(ends[-1])))
                entry = np.searchsorted(ends, pair, "right")
                has = mine[begin[terms[entry]] + pair - (ends[entry] - fan[entry])]
                gain = values[entry] * self.times[has]
                keep = gain > self.level[self.item[has]]
                has, cell = has[keep], rows[entry[keep]] * n_items + self.item[has[keep]] - first
                np.add.at(total, cell, gain[keep])
                np.add.at(known, cell, self.hidden[has])
            part = slice(first, first + n_items)
            could = (total + np.tile(self.rest[part], n_rows) - known >= np.tile(self.bound[part], n_rows)) & (known > 0) | (total >= np.tile(self.bound[part], n_rows))
            found = np.flatnonzero(could & (total > 0))
            yield found // n_items, first + found % n_items, total[found]


def _ranked(lists: DataFrame, n_entries: int, own: DataFrame, scratch: Scratch, most: int) -> DataFrame:
    """The result for a slice of items; own: item, item_id, term, times."""
    spark = lists.sparkSession
    small = F.broadcast(own)

    # Phase 1: heads, and the scores of what leads in them.
    asked = F.broadcast(own.select("term").distinct())
    place = F.row_number().over(Window.partitionBy("term").orderBy(F.col("value").desc(), "id", "row"))
    heads = scratch.keep(lists.join(asked, "term", "left_semi").withColumn("_place", place).where(F.col("_place") <= HEADS * most), "search-heads")
    partial = heads.join(small, "term").groupBy("item", "id", "row").agg(F.sum(F.col("times") * F.col("value")).alias("sum"))
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.col("sum").desc(), "id", "row"))
    probes = scratch.keep(partial.withColumn("_place", place).where(F.col("_place") <= PROBES * most).select("item", "row"), "search-probes")
    theirs = lists.join(broadcast_if_small(probes.select("row").distinct(), MOST_BROADCAST), "row", "left_semi").select("row", "term", "value")
    scores = probes.join(theirs, "row").join(small.select("item", "term", "times"), ["item", "term"]).groupBy("item", "row").agg(F.sum(F.col("times") * F.col("value")).alias("sum"))
    bounds = {r["item"]: r["bound"] for r in _nth(scores, "item", "sum", most).collect()}
    tops = heads.where("_place = 1").select("term", F.col("value").alias("top"))
    # SLICE rows, or those of one item.
    of = _Slice(own.join(tops, "term").collect(), bounds)
    if not of.items:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    sent = spark.sparkContext.broadcast(of)
    terms = F.broadcast(spark.createDataFrame(list(zip(of.terms, range(len(of.terms)), of.least.tolist())), "term string, t int, least long"))

    # Phase 2: all entries above the level, summed up by document.
    block = F.pmod(F.xxhash64("row"), F.lit(-(-n_entries // BLOCK)).cast("long"))
    deep = lists.join(terms, "term").where("value >= least").select(block.alias("block"), "t", "value", "id", "row")

    def run(table: pa.Table) -> pa.Table:
        mine, out = sent.value, []
        rows, first, at = np.unique(table.column("row").to_numpy(), return_index=True, return_inverse=True)
        ids = table.column("id").take(pa.array(first)).combine_chunks()
        for row, item, total in mine.sums(table.column("t").to_numpy(), table.column("value").to_numpy(), at, len(rows)):
            out.append(pa.table({"item": pa.array(np.array(mine.items, np.int64)[item]), "id": ids.take(pa.array(row)), "row": pa.array(rows[row]), "sum": pa.array(total)}))
        return pa.concat_tables(out)

    open_ = deep.groupBy("block").applyInArrow(run, "item long, id long, row long, sum long")
    open_ = scratch.keep(open_, "search-open")

    # Phase 3: what the lists have of the rest at or under the level, again by blocks of documents.
    met = lists.join(broadcast_if_small(open_.select("row").distinct(), MOST_BROADCAST), "row", "left_semi")
    met = met.join(terms.select("term", "t"), "term").select(block.alias("block"), "t", "value", "row")

    def look_up(_: tuple, pairs: pa.Table, entries: pa.Table) -> pa.Table:
        item, row = pairs.column("item").to_numpy(), pairs.column("row").to_numpy()
        more = sent.value.under_level(item, row, *(entries.column(c).to_numpy() for c in ("t", "value", "row")))
        return pa.table({"item": pa.array(item), "id": pairs.column("id"), "row": pa.array(row), "score": pa.array(pairs.column("sum").to_numpy() + more)})

    pairs = open_.withColumn("block", block).groupBy("block")
    exact = pairs.cogroup(met.groupBy("block")).applyInArrow(look_up, "item long, id long, row long, score long")
    ids = F.broadcast(own.select("item", "item_id").distinct())
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), "id", "row"))
    ranked = exact.withColumn("rank", place).where(F.col("rank") <= most).join(ids, "item")
    return materialize(ranked.select("item_id", "rank", F.col("id").alias("doc_id"), "score"), "search-result")


def search(docs: DataFrame, items: DataFrame, most: int = MOST) -> DataFrame:
    """item_id, rank, doc_id, score: the best documents (doc_id, text) of each item (item_id, text)."""
    spark = docs.sparkSession
    small_batches(spark)
    with Scratch(spark) as scratch:
        asked = count_terms(items.select(F.col("item_id").cast("long").alias("id"), "text")).where("term is not null")
        asked = scratch.keep(asked.selectExpr("row AS item", "id AS item_id", "term", "tf AS times"), "search-items")
        known = asked.select("term").distinct()
        n, size = known.limit(MOST_TERMS + 1).agg(F.count("*"), F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()
        few = n <= MOST_TERMS and size <= MOST_BYTES
        wanted = frozenset(r.term.encode("utf-8", "surrogatepass") for r in known.collect()) if few else None

        postings = count_terms(docs.select(F.col("doc_id").cast("long").alias("id"), "text"), wanted)
        postings = scratch.keep(postings, "search-postings")
        n_docs, n_terms = postings.where("term is null").agg(F.coalesce(F.sum("tf"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
        found = postings.where("term is not null")
        if not few:
            found = found.join(known, "term", "left_semi")
        weight, length, entry = _score(n_docs, n_terms)
        weights = scratch.keep(found.groupBy("term").agg(F.count("*").alias("df")).withColumn("w", weight), "search-weights")
        lists = found.join(broadcast_if_small(weights.select("term", "w"), MOST_BROADCAST), "term").withColumn("m", length).withColumn("value", entry).where("value > 0")
        order = ["term", F.col("value").desc(), "id", "row"]
        lists = lists.select("term", "value", "id", "row").repartitionByRange(*order).sortWithinPartitions(*order)
        lists = scratch.keep(lists, "search-lists")
        scratch.drop("search-postings")
        n_entries, n_own = max(1, lists.count()), asked.count()
        slices = max(1, -(-n_own // SLICE))
        parts = [_ranked(lists, n_entries, asked.where(F.pmod(F.xxhash64("item"), F.lit(slices)) == k), scratch, most) for k in range(slices)]
        return reduce(DataFrame.union, parts)
