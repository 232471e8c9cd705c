"""Words of texts without blanks: a lattice over a dictionary's counts, the best path for all texts of a batch, tags by Viterbi.

Each word costs the negative logarithm of its share of all counts, in whole millionths, so that sums are exact; a character that
is no word costs as much as a word seen once. The best path costs least, and where two cost the same, takes the longer
word at the leftmost place where they differ.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phonoweave.functions import scan
from phonoweave.functions.phrases import PhraseTable, chain, code_points

#: Words of a dictionary that are collected and sent to every task.
MOST_WORDS = 5_000_000
UNKNOWN_TAG = "x"


def cost(n: int, total: int) -> int:
    return math.floor(1e6 * math.log(total / n))


class Lattice:
    """A segmenter: lattice(text) gives (word, tag) pairs, many(texts) those of many texts.

    counts: words and how often they occur. tags: for a word its tags and their counts; transitions: pairs of tags and their
    counts ("" before the first word). Without transitions a word takes its most frequent tag. split: phrases by
    which a word of `long` characters or more, that is none of `kept`, is cut again, longest first.
    """

    def __init__(self, counts: Mapping[str, int], tags: Mapping[str, Mapping[str, int]] | None = None, transitions: Mapping[tuple[str, str], int] | None = None, split: Sequence[str] = (), kept: Sequence[str] = (), long: int = 4):
        counts = {w: n for w, n in counts.items() if w and n > 0}
        self.table = PhraseTable(list(counts))
        total = max(1, sum(counts.values()))
        self.cost = np.array([cost(counts[w], total) for w in self.table.phrases], np.int64)
        self.unknown = cost(1, total)
        self.tags, self.transitions = tags or {}, transitions or {}
        self.split, self.kept, self.long = PhraseTable(split) if split else None, frozenset(kept), long
        self.tag_totals: dict[str, int] = {}
        self.word_totals: dict[str, int] = {}
        for (a, _), n in self.transitions.items():
            self.tag_totals[a] = self.tag_totals.get(a, 0) + n
        for by in self.tags.values():
            for t, n in by.items():
                self.word_totals[t] = self.word_totals.get(t, 0) + n

    def __call__(self, text: str) -> list[tuple[str, str]]:
        return self.many([text])[0]

    def cuts(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The length of the best path's word at each place where one begins, 0 elsewhere."""
        n = len(codes)
        if not n:
            return np.zeros(0, np.int64)
        place, length, word = self.table.occurrences(codes, at)
        price = self.cost[word]
        alone = np.ones(n, bool)
        alone[place[length == 1]] = False
        single = np.flatnonzero(alone)
        place, length = np.concatenate([place, single]), np.concatenate([length, np.ones(len(single), np.int64)])
        price = np.concatenate([price, np.full(len(single), self.unknown)])
        # Paths meet wherever no word lies across: stretches between such places are solved side by side, from their ends.
        across = np.zeros(n + 1, np.int64)
        np.add.at(across, place + 1, 1)
        np.add.at(across, place + length, -1)
        bounds = np.append(np.flatnonzero(np.cumsum(across)[:n] == 0), n)
        away = bounds[np.searchsorted(bounds, place, "right")] - place
        order = np.lexsort((-length, place, away))
        place, length, price, away = place[order], length[order], price[order], away[order]
        best, step = np.zeros(n + 1, np.int64), np.zeros(n, np.int64)
        rounds = np.searchsorted(away, np.arange(1, int(away.max()) + 2))
        ends_here = np.zeros(n + 1, bool)
        ends_here[bounds] = True
        for a, b in zip(rounds.tolist(), rounds[1:].tolist()):
            p, k = place[a:b], length[a:b]
            goal = p + k
            total = price[a:b] + np.where(ends_here[goal], 0, best[goal])
            first = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
            least = np.minimum.reduceat(total, first)
            fits = total == np.repeat(least, np.diff(np.append(first, len(p))))
            step[p[first]] = np.maximum.reduceat(np.where(fits, k, 0), first)
            best[p[first]] = least
        return np.where(chain(np.arange(n) + step, bounds[:-1]), step, 0)

    def many(self, texts: Sequence[str]) -> list[list[tuple[str, str]]]:
        codes, at = code_points(texts)
        step = self.cuts(codes, at)
        begin = np.flatnonzero(step)
        of = np.searchsorted(at, begin, "right") - 1
        out: list[list[str]] = [[] for _ in texts]
        for k, a, n in zip(of.tolist(), (begin - at[of]).tolist(), step[begin].tolist()):
            out[k] += self._again(texts[k][a : a + n])
        return [list(zip(words, self.tagged(words))) for words in out]

    def _again(self, word: str) -> list[str]:
        if self.split is None or len(word) < self.long or word in self.kept:
            return [word]
        place, length, _ = self.split.leftmost_longest(*code_points([word]))
        ends = np.ones(len(word) + 1, bool)
        for a, n in zip(place.tolist(), length.tolist()):
            ends[a + 1 : a + n] = False
        cuts = np.flatnonzero(ends).tolist()
        return [word[a:b] for a, b in zip(cuts, cuts[1:])]

    def tagged(self, words: Sequence[str]) -> list[str]:
        """The likeliest sequence of tags; equal ones by the tag's name."""
        if not self.transitions:
            return [min(by, key=lambda t: (-by[t], t)) if (by := self.tags.get(w)) else UNKNOWN_TAG for w in words]
        n_tags = len(self.word_totals) or 1
        rows: list[dict[str, tuple[float, str]]] = []
        for word in words:
            by = self.tags.get(word) or dict.fromkeys(self.word_totals, 0) or {UNKNOWN_TAG: 0}
            before = rows[-1] if rows else {"": (0.0, "")}
            row = {}
            for tag, n in by.items():
                emit = -math.log((n + 1) / (self.word_totals.get(tag, 0) + n_tags))
                row[tag] = min((c + emit - math.log((self.transitions.get((b, tag), 0) + 1) / (self.tag_totals.get(b, 0) + n_tags)), b) for b, (c, _) in before.items())
            rows.append(row)
        out, tag = [], min(rows[-1], key=lambda t: (rows[-1][t][0], t)) if rows else ""
        for row in reversed(rows):
            out.append(tag)
            tag = row[tag][1]
        return out[::-1]


def learn(tagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(word, tag, n) and (before, tag, n) from words in order: sentence, place, word, tag."""
    before = F.coalesce(F.lag("tag").over(Window.partitionBy("sentence").orderBy("place")), F.lit(""))
    pairs = tagged.select(before.alias("before"), "tag")
    return tagged.groupBy("word", "tag").agg(F.count("*").alias("n")), pairs.groupBy("before", "tag").agg(F.count("*").alias("n"))


def from_tables(words: DataFrame, transitions: DataFrame | None = None, **options) -> Lattice:
    """A lattice from (word, n) or (word, tag, n), and maybe (before, tag, n); a larger dictionary than MOST_WORDS is an error."""
    rows = words.limit(MOST_WORDS + 1).collect()
    if len(rows) > MOST_WORDS:
        raise ValueError(f"more than {MOST_WORDS} words")
    counts: dict[str, int] = {}
    tags: dict[str, dict[str, int]] = {}
    for r in rows:
        counts[r.word] = counts.get(r.word, 0) + r.n
        if "tag" in words.columns:
            tags.setdefault(r.word, {})[r.tag] = r.n
    pairs = {(r.before, r.tag): r.n for r in transitions.collect()} if transitions is not None else None
    return Lattice(counts, tags, pairs, **options)


def segment(df: DataFrame, lattice: Lattice, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, place, word, tag: a row for each word of each text; null and empty texts have none."""
    kinds, sent = dict(df.select(*keep).dtypes), df.sparkSession.sparkContext.broadcast(lattice)

    def run(batches):
        for batch in batches:
            at = 0
            for part in scan.slices(batch.column(len(keep))):
                got = sent.value.many([t or "" for t in part.to_pylist()])
                of = pa.array(np.repeat(np.arange(len(got)), [len(g) for g in got]) + at)
                flat = [w for g in got for w in g]
                columns = [pa.array([k for g in got for k in range(len(g))], pa.int32()), pa.array([w for w, _ in flat], pa.string()), pa.array([t for _, t in flat], pa.string())]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(of) for k in range(len(keep))), *columns], names=[*keep, "place", "word", "tag"])
                at += len(part)

    return df.select(*keep, F.col(text).alias("_text")).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "place int, word string, tag string"]))
