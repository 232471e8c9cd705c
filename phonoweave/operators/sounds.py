"""Letter-to-sound learned from a pronouncing lexicon.

Each letter says no phone, one or two. Which says what is found by expectation maximization: tasks give the expected counts
of (letter, phones) of their words, as whole numbers in units of 2**-20, so that sums are the same in any order; Spark adds
them up, and the next round's probabilities come from the sums. The best alignments then give n-gram counts: what a letter
says, by what a guide (the rule table, or any function of a word) expects of it, by ever wider windows of letters, and last by
what the letter before says. A word is read by the best path over those, each level interpolated with the one below (Witten and
Bell). So a small lexicon corrects its guide, and a large one leaves it behind. Training data never leave the executors; what is collected is the
table of (letter, phones), bounded by the two alphabets, and for reading the model, behind a count.

Rows without a word or phones are left out, repeated rows count once, a word with several readings teaches them all. Words
of more than twice as many phones as letters have no alignment and teach nothing. Letters never seen say what the guide expects, without one nothing. An empty
lexicon gives an empty model.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterable, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonoweave.functions.columns import written
from phonoweave.operators import spelling

#: Units of an expected count.
UNIT = 1 << 20
#: What an alignment weighs for each letter that says no, one or two phones: two are for letters such as x, not for neighbours' phones.
WEIGHTS = (1.0, 1.0, 0.01)
#: Windows of letters around a letter, by level: how many before it and how many after. All have what the guide expects of
#: it too, and the last what the letter before says. Below the first there is the guide alone.
WINDOWS = ((0, 0), (0, 1), (0, 2), (1, 2))
#: Letters before and after that any window has.
_BEFORE, _AFTER = max(b for b, _ in WINDOWS), max(a for _, a in WINDOWS)
#: Characters that stand for the edges of a word, and what parts the pieces of a context.
EDGES, PART = ("\x02", "\x03"), "\x01"
#: What a word's letters are expected to say, one each.
Guide = Callable[[str], Sequence[str]]
#: Rows of a model that a reader holds.
MOST_ENTRIES = 3_000_000
#: Cells of the tables that are filled at a time.
_CELLS = 1 << 20


class _Tables:
    """Words of one batch as arrays: the probability that letter i says k phones from place j on, for all of them in step."""

    def __init__(self, words: list[str], phones: list[list[str]], chances: Mapping[tuple[str, str], float] | None):
        self.words, self.count, self.n, self.m = words, len(words), max(map(len, words)), max(map(len, phones))
        self.letters = {"": 0} | {c: i + 1 for i, c in enumerate(sorted(set("".join(words))))}
        said = {" ".join(p[j : j + k]) for p in phones for k in (1, 2) for j in range(len(p) - k + 1)}
        self.said = ["", *sorted(said)]
        number = {s: i for i, s in enumerate(self.said)}
        table = np.zeros((len(self.letters), len(self.said) + 1))  # the last column: no such phones
        if chances is None:
            table[1:, :-1] = 1.0
        else:
            for (letter, s), p in chances.items():
                if letter in self.letters and s in number:
                    table[self.letters[letter], number[s]] = p
        table[:, :-1] *= [WEIGHTS[len(s.split())] for s in self.said]
        table[0, 0] = 1.0  # after a word's end
        self.letter = np.zeros((self.count, self.n), np.int64)
        self.what = np.full((3, self.count, self.m + 1), len(self.said), np.int64)
        self.what[0] = 0
        self.end = np.array([len(p) for p in phones])
        for b, (w, p) in enumerate(zip(words, phones)):
            self.letter[b, : len(w)] = [self.letters[c] for c in w]
            for k in (1, 2):
                self.what[k, b, : max(0, len(p) - k + 1)] = [number[" ".join(p[j : j + k])] for j in range(len(p) - k + 1)]
        self.table = table

    def chance(self, i: int) -> np.ndarray:
        """[k, word, place] for letter i."""
        return self.table[self.letter[:, i][None, :, None], self.what]

    def _step(self, row: np.ndarray, chance: np.ndarray) -> np.ndarray:
        """[k, word, place after the letter]: ways by how many phones the letter says."""
        ways = np.zeros((3, *row.shape))
        for k in range(3):
            ways[k, :, k:] = (row * chance[k])[:, : self.m + 1 - k]
        return ways

    @staticmethod
    def _scaled(row: np.ndarray) -> np.ndarray:
        top = row.max(axis=1, keepdims=True)
        return row / np.where(top > 0, top, 1.0)

    def start(self) -> np.ndarray:
        row = np.zeros((self.count, self.m + 1))
        row[:, 0] = 1.0
        return row

    def expected(self) -> np.ndarray:
        """[letter, phones] expected counts over all alignments, in units."""
        ahead = [self.start()]
        for i in range(self.n):
            ways = self._step(ahead[-1], self.chance(i))
            ahead.append(self._scaled(ways[0] + ways[1] + ways[2]))
        behind = np.zeros((self.count, self.m + 1))
        behind[np.arange(self.count), self.end] = 1.0
        counts = np.zeros(self.table.shape, np.int64)
        for i in range(self.n - 1, -1, -1):
            chance, after = self.chance(i), np.zeros((3, self.count, self.m + 1))
            for k in range(3):
                after[k, :, : self.m + 1 - k] = behind[:, k:]
            onward = chance * after
            share = ahead[i] * onward
            # One after the other, so that the sum does not depend on the words beside it.
            total = np.cumsum((share[0] + share[1] + share[2]), axis=1)[:, -1][None, :, None]
            share = np.rint(np.divide(share, total, out=np.zeros_like(share), where=total > 0) * UNIT).astype(np.int64)
            np.add.at(counts, (np.broadcast_to(self.letter[:, i][None, :, None], share.shape), self.what), share)
            behind = self._scaled(onward[0] + onward[1] + onward[2])
        return counts[:, :-1]

    def best(self) -> list[list[str] | None]:
        """What each letter says in the most probable alignment, equal ones by fewer phones from the end; None without one."""
        row, taken = self.start(), []
        for i in range(self.n):
            ways = self._step(row, self.chance(i))
            taken.append(ways.argmax(axis=0))
            row = self._scaled(ways.max(axis=0))
        place, every = self.end.copy(), np.arange(self.count)
        fine, out = row[every, place] > 0, np.zeros((self.count, self.n), np.int64)
        for i in range(self.n - 1, -1, -1):
            k = taken[i][every, place]
            place = np.maximum(place - k, 0)
            out[:, i] = self.what[k, every, place]
        return [[self.said[s] for s in out[b, : len(w)]] if fine[b] else None for b, w in enumerate(self.words)]


def _tables(batch: pa.RecordBatch, chances):
    """Words of like length together, so that tables hold little but cells of theirs."""
    rows = sorted(zip(batch.column(0).to_pylist(), (p.split(" ") for p in batch.column(1).to_pylist())), key=lambda r: (len(r[0]), len(r[1])))
    part: list = []
    for row in rows:
        size = (len(row[0]) + 1) * (max([len(r[1]) for r in part] + [len(row[1])]) + 1)
        if part and (len(part) + 1) * size > _CELLS:
            yield _Tables(*map(list, zip(*part)), chances)
            part = []
        part.append(row)
    if part:
        yield _Tables(*map(list, zip(*part)), chances)


def _pairs(lexicon: DataFrame) -> DataFrame:
    pairs = lexicon.select(F.lower("word").alias("word"), F.btrim(F.regexp_replace("phones", r"\s+", " ")).alias("phones"))
    return pairs.where((F.length("word") > 0) & (F.length("phones") > 0)).distinct()


def expected_counts(pairs: DataFrame, chances: Mapping[tuple[str, str], float] | None) -> DataFrame:
    """letter, said, n: expected counts in units, summed up by Spark; chances by (letter, said), or none for the first round."""

    def run(batches):
        for batch in batches:
            for t in _tables(batch, chances):
                counts, names = t.expected(), list(t.letters)
                letter, said = np.nonzero(counts[1:])
                yield pa.RecordBatch.from_pydict({"letter": pa.array([names[k + 1] for k in letter], pa.string()), "said": pa.array([t.said[s] for s in said], pa.string()), "n": pa.array(counts[letter + 1, said])})

    return pairs.select("word", "phones").mapInArrow(run, "letter string, said string, n long").groupBy("letter", "said").agg(F.sum("n").alias("n"))


def chances_of(counts: Iterable[tuple[str, str, int]]) -> dict[tuple[str, str], float]:
    """The share of each (letter, phones) in its letter's counts."""
    rows, total = list(counts), defaultdict(int)
    for letter, _, n in rows:
        total[letter] += n
    return {(letter, said): n / total[letter] for letter, said, n in rows if n}


def align(lexicon: DataFrame, rounds: int = 8) -> DataFrame:
    """word, said: what each letter of a lexicon's words says; lexicon: word, phones with blanks between."""
    pairs = written(_pairs(lexicon).repartition(lexicon.sparkSession.sparkContext.defaultParallelism), "lexicon")
    chances = None
    for _ in range(rounds):
        chances = chances_of(map(tuple, expected_counts(pairs, chances).collect()))  # bounded by the alphabets

    def run(batches):
        for batch in batches:
            for t in _tables(batch, chances):
                found = [(w, s) for w, s in zip(t.words, t.best()) if s is not None]
                yield pa.RecordBatch.from_pydict({"word": pa.array([w for w, _ in found], pa.string()), "said": pa.array([s for _, s in found], pa.list_(pa.string()))})

    return pairs.mapInArrow(run, "word string, said array<string>")


def guided(aligned: DataFrame, guide: Guide | None) -> DataFrame:
    """The alignments with what the guide expects of each letter, in `guide`; nothing without one."""

    def run(words: pa.Array) -> pa.Array:
        return pa.array([None if w is None else expectations(guide, w) for w in words.to_pylist()], pa.list_(pa.string()))

    return aligned.withColumn("guide", F.arrow_udf(run, "array<string>")("word"))


def expectations(guide: Guide | None, word: str) -> list[str]:
    if guide is None:
        return [""] * len(word)
    out = list(guide(word))
    if len(out) != len(word):
        raise ValueError(f"the guide expects {len(out)} letters of {word!r}")
    return out


def n_grams(aligned: DataFrame) -> DataFrame:
    """level, context, said, n: how often a letter says that in a context; aligned: word, said, guide."""
    padded = F.concat(F.lit(EDGES[0] * _BEFORE), "word", F.lit(EDGES[1] * _AFTER))
    letters = aligned.select(padded.alias("w"), "said", "guide", F.posexplode("said").alias("i", "one"))
    window = lambda before, after: F.substring(F.col("w"), F.col("i") + 1 + _BEFORE - before, F.lit(before + after + 1))
    expected, previous = F.get("guide", F.col("i")), F.when(F.col("i") > 0, F.get("said", F.col("i") - 1)).otherwise("")
    contexts = [*(F.concat_ws(PART, window(*w), expected) for w in WINDOWS[:-1]), F.concat_ws(PART, window(*WINDOWS[-1]), expected, previous)]
    rows = letters.select(F.posexplode(F.array(*contexts)).alias("level", "context"), F.col("one").alias("said"))
    return rows.groupBy("level", "context", "said").agg(F.count("*").alias("n"))


def learn(lexicon: DataFrame, rounds: int = 8, guide: Guide | None = spelling.by_letter) -> DataFrame:
    """The model of a lexicon (word, phones): rows that Sounds reads with, together with the same guide."""
    return n_grams(guided(align(lexicon, rounds), guide))


class Sounds:
    """Phones of a word by a learned model; a function of lower-case words, as EnglishBackend(sounds=) wants it."""

    def __init__(self, rows: Iterable[tuple[int, str, str, int]], guide: Guide | None = spelling.by_letter):
        self.levels: list[dict[str, dict[str, int]]] = [{} for _ in WINDOWS]
        for level, context, said, n in sorted(rows):
            self.levels[level].setdefault(context, {})[said] = n
        self.guide = guide
        self._windows: dict[tuple[str, str], dict[str, float]] = {}

    @classmethod
    def of(cls, model: DataFrame, guide: Guide | None = spelling.by_letter, most: int = MOST_ENTRIES) -> Sounds:
        """Of a model's rows; ValueError for one of more than `most`, which no worker is to hold."""
        rows = model.select("level", "context", "said", "n")
        if rows.limit(most + 1).count() > most:
            raise ValueError(f"a model of more than {most} rows: learn from fewer words")
        return cls(map(tuple, rows.collect()), guide)

    def __getstate__(self):
        return self.levels, self.guide

    def __setstate__(self, state):
        (self.levels, self.guide), self._windows = state, {}

    def _mixed(self, level: int, context: str, below: Mapping[str, float] | None) -> Mapping[str, float] | None:
        seen = self.levels[level].get(context)
        if not seen:
            return below
        total, kinds = sum(seen.values()), len(seen)
        if below is None:
            return {s: n / total for s, n in seen.items()}
        return {s: (seen.get(s, 0) + kinds * below.get(s, 0.0)) / (total + kinds) for s in {**seen, **below}}

    def _window(self, padded: str, at: int, expected: str) -> Mapping[str, float]:
        """Chances of what the letter at a place of the padded word says, whatever the one before says."""
        key = padded[at - _BEFORE : at + _AFTER + 1], expected
        got = self._windows.get(key)
        if got is None:
            got = None if self.guide is None else {expected: 1.0}
            for level, (b, a) in enumerate(WINDOWS[:-1]):
                got = self._mixed(level, padded[at - b : at + a + 1] + PART + expected, got)
            got = got or {"": 1.0}
            if len(self._windows) < 500_000:
                self._windows[key] = got
        return got

    def path(self, word: str) -> tuple[float, list[str]]:
        """The logarithm of the best path's chance, and what each letter says on it."""
        padded, top = EDGES[0] * _BEFORE + word + EDGES[1] * _AFTER, len(WINDOWS) - 1
        states: dict[str, tuple[float, tuple | None]] = {"": (0.0, None)}
        for at, expected in enumerate(expectations(self.guide, word), _BEFORE):
            plain = self._window(padded, at, expected)
            key = padded[at - WINDOWS[top][0] : at + WINDOWS[top][1] + 1] + PART + expected + PART
            known = {s: self._mixed(top, key + s, plain) for s in states if key + s in self.levels[top]}
            rest = max((s for s in states if s not in known), key=lambda s: states[s][0], default=None)
            ways = [(states[s], known.get(s, plain)) for s in (*known, *([] if rest is None else [rest]))]
            new = {}
            for said in plain:
                score, link = max(((score + math.log(chance[said]), link) for (score, link), chance in ways), key=lambda x: x[0])
                new[said] = score, (said, link)
            states = new
        score, link = max(states.values(), key=lambda s: s[0])
        out = []
        while link is not None:
            out.append(link[0])
            link = link[1]
        return score, out[::-1]

    def __call__(self, word: str) -> list[str]:
        return [p for said in self.path(word)[1] for p in said.split()]


def read(words: DataFrame, sounds: Sounds, word: str = "word", result: str = "phones") -> DataFrame:
    """words with phones, blanks between, in a new column; each row once, so hand over distinct words. Null words give null."""

    def run(values: pa.Array) -> pa.Array:
        return pa.array([None if w is None else " ".join(sounds(w.lower())) for w in values.to_pylist()], pa.string())

    return words.withColumn(result, F.arrow_udf(run, "string")(F.col(word)))
