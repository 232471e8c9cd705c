"""Normalization of text: Latin folding and validation in SQL, Unicode and written forms in Arrow UDFs."""

from __future__ import annotations

import re
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phonoweave.functions import scan, scripts

SPAN = "array<struct<start:int,end:int>>"
NORMALIZED = f"text string, sources {SPAN}"


def fold(value: str) -> str:
    """A Latin spelling without diacritics; ValueError if letters stay outside A-Z."""
    if _PLAIN.fullmatch(value):
        return value
    out = []
    for char in unicodedata.normalize("NFC", value):
        base = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))
        if char in "'-":
            out.append(char)
        elif base.isascii() and base.isalpha():
            out.append(base)
        else:
            raise ValueError(f"cannot fold {char!r}")
    return "".join(out)


_PLAIN = re.compile(r"[A-Za-z'-]*")


@cache
def latin_tables() -> tuple[str, str, str]:
    """Latin letters that fold to one ASCII letter, those letters, and the ones that do not fold to ASCII letters at all."""
    source, target, other = [], [], []
    for char, base in _folded().items():
        if base.isascii() and base.isalpha():
            if len(base) == 1:
                source.append(char)
                target.append(base)
        else:
            other.append(char)
    return "".join(source), "".join(target), "".join(other)


@cache
def _folded() -> dict[str, str]:
    """Each Latin letter beyond ASCII and what is left of it without marks."""
    letters = (chr(p) for a, b in scripts.LATIN_RANGES for p in range(max(a, 0x80), b + 1))
    return {c: "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)) for c in letters}


@cache
def ligatures() -> dict[str, str]:
    """Latin letters that fold to several ASCII letters."""
    return {c: b for c, b in _folded().items() if len(b) > 1 and b.isascii() and b.isalpha()}


def fold_latin(word: Column) -> Column:
    """The fold for precomposed Latin letters, inside the JVM; letters without an ASCII spelling stay."""
    source, target, _ = latin_tables()
    single = F.translate(word, source, target)
    spelled = single
    for char, base in ligatures().items():
        spelled = F.replace(spelled, F.lit(char), F.lit(base))
    return F.when(single.rlike(f"[{''.join(ligatures())}]"), spelled).otherwise(single)


def unify_apostrophes(word: Column) -> Column:
    return F.translate(word, "’‘", "''")


def first_unfoldable(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, char, place: the first character of a text without an ASCII spelling; no row for texts without one.

    That is a Latin letter that does not fold, or a combining mark after Latin.
    """
    kinds = dict(df.select(*keep).dtypes)

    def run(batches):
        table = scan.classes() == scan.LATIN
        bad_table = np.zeros(len(table), bool)
        bad_table[[ord(c) for c in latin_tables()[2]]] = True
        for batch in batches:
            at = 0
            for part in scan.slices(batch.column(len(keep))):
                codes, text_at, latin = scan.codes_of(part)
                place = np.flatnonzero(bad_table[codes] | ((scan.classes()[codes] == scan.MARK) & latin))
                of = np.searchsorted(text_at, place, "right") - 1
                of, first = np.unique(of, return_index=True)
                place = place[first]
                chars = pa.array([chr(c) for c in codes[place]], pa.string())
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(of + at)) for k in range(len(keep))), chars, pa.array((place - text_at[of]).astype(np.int32))], names=[*keep, "char", "place"])
                at += len(part)

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "char string, place int"])
    return df.select(*keep, F.col(text).alias("_text")).mapInArrow(run, schema)


def compatibility(value: str) -> tuple[str, list[tuple[int, int]]]:
    """NFKC on letters and numbers only, then NFC of the whole, with the source span of each character."""
    own = list(zip(range(len(value)), range(1, len(value) + 1)))
    if value.isascii() or unicodedata.is_normalized("NFKC", value):
        return value, own
    chars, spans = [], []
    for char, span in zip(value, own):
        expanded = unicodedata.normalize("NFKC", char) if not char.isascii() and unicodedata.category(char)[0] in "LN" else char
        chars.append(expanded)
        spans += [span] * len(expanded)
    text = "".join(chars)
    if unicodedata.is_normalized("NFC", text):
        return text, spans
    # Nothing composes across an ASCII character, so each one starts a stretch that is normalized and aligned by itself.
    out, sources = [], []
    for found in _STRETCH.finditer(text):
        old, near = found.group(), spans[found.start() : found.end()]
        new = unicodedata.normalize("NFC", old)
        out.append(new)
        sources += near if new == old else realign(old, new, near)
    return "".join(out), sources


def normalized_compatibility(value: str) -> str:
    """The text of compatibility() alone."""
    if value.isascii() or unicodedata.is_normalized("NFKC", value):
        return value
    wide = _WIDE.sub(lambda m: unicodedata.normalize("NFKC", m[0]) if unicodedata.category(m[0])[0] in "LN" else m[0], value)
    return unicodedata.normalize("NFC", wide)


_WIDE = re.compile(r"[^\x00-\x7f]")
_STRETCH = re.compile(r"[\x00-\x7f][^\x00-\x7f]*|[^\x00-\x7f]+")
class _Substrings:
    """All substrings of a text as a suffix automaton: for each state its longest length, its link, and where it first ends."""

    def __init__(self, text: str):
        self.next: list[dict[str, int]] = [{}]
        self.length, self.link, self.end = [0], [-1], [0]
        last = 0
        for at, char in enumerate(text, 1):
            new = self._add(self.length[last] + 1, {}, 0, at)
            state = last
            while state >= 0 and char not in self.next[state]:
                self.next[state][char] = new
                state = self.link[state]
            if state >= 0:
                goal = self.next[state][char]
                if self.length[goal] > self.length[state] + 1:  # shorter strings of the goal also end here: part them
                    part = self._add(self.length[state] + 1, dict(self.next[goal]), self.link[goal], self.end[goal])
                    self.link[goal] = part
                    while state >= 0 and self.next[state].get(char) == goal:
                        self.next[state][char] = part
                        state = self.link[state]
                    goal = part
                self.link[new] = goal
            last = new

    def _add(self, length: int, following: dict[str, int], link: int, end: int) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        self.end.append(end)
        return len(self.length) - 1

    def longest_in(self, other: str) -> tuple[int, int, int]:
        """(place in other, place in the text, length) of the longest common substring: the first in other, then in the text."""
        best, state, size = (0, 0, 0), 0, 0
        for at, char in enumerate(other, 1):
            while state and char not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if char in self.next[state]:
                state, size = self.next[state][char], size + 1
            if size > best[2]:
                best = at - size, self.end[state] - size, size
        return best


def matching_blocks(old: str, new: str) -> list[tuple[int, int, int]]:
    """(place in old, place in new, length): the longest common block, and so on to its left and right; in order."""
    out, todo = [], [(0, len(old), 0, len(new))]
    while todo:
        a, b, c, d = todo.pop()
        if a == b or c == d:
            continue
        i, j, n = (0, 0, b - a) if old[a:b] == new[c:d] else _Substrings(new[c:d]).longest_in(old[a:b])
        if n:
            out.append((a + i, c + j, n))
            todo += [(a, a + i, c, c + j), (a + i + n, b, c + j + n, d)]
    return sorted(out)


def realign(old: str, new: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Source spans of the characters of `new`, by the longest matching blocks: equal characters keep theirs, a change shares one."""
    out: list[tuple[int, int]] = []
    a = c = 0
    for i, j, n in [*matching_blocks(old, new), (len(old), len(new), 0)]:
        if j > c:  # replaced, or put in after a
            near = spans[a:i] or spans[max(0, a - 1) : a + 1]
            out += [(min(s for s, _ in near), max(e for _, e in near)) if near else (0, 0)] * (j - c)
        out += spans[i : i + n]
        a, c = i + n, j + n
    return out


def normalize_compatibility(text: Column) -> Column:
    """compatibility() as an Arrow UDF: (text, sources); spans are flat arrays, a stretch of texts at a time."""
    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
    kind = pa.struct([("text", pa.string()), ("sources", pa.list_(span))])

    def one(value: str) -> tuple[str, np.ndarray]:
        if value.isascii() or unicodedata.is_normalized("NFKC", value):
            at = np.arange(len(value), dtype=np.int32)
            return value, np.stack([at, at + 1], axis=1)
        new, spans = compatibility(value)
        return new, np.array(spans, np.int32).reshape(-1, 2)

    def run(texts: pa.Array) -> pa.Array:
        parts = []
        for part in scan.slices(texts):
            rows = [one(t or "") for t in part.to_pylist()]
            flat = np.concatenate([s for _, s in rows])
            spans = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, k])) for k in range(2)], fields=list(span))
            begin = np.cumsum([0, *(len(s) for _, s in rows)])
            parts.append(pa.StructArray.from_arrays([pa.array([t for t, _ in rows], pa.string()), pa.ListArray.from_arrays(pa.array(begin, pa.int32()), spans)], fields=list(kind)))
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    return F.arrow_udf(run, NORMALIZED)(text)
