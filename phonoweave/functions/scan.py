"""Tokens of many texts by array operations: a class for each code point, and conditions on neighbours.

It finds the tokens of scripts.TOKEN. All texts of a batch are one array of code points; token starts are where the class
changes, after marks that follow Latin and joiners inside words and numbers have taken the class beside them.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from phonoweave.functions import scripts

OTHER, SPACE, HAN, DIGIT, LATIN, MARK, PUNCTUATION, NONE = range(8)
LANGUAGES = pa.array(["sym", "space", "zh", "num", "en", "sym", "sym"])
KINDS = pa.array(["symbol", "space", "han", "number", "latin", "symbol", "punctuation"])
BOUNDARIES = pa.array(["none", "soft", "code_switch", "pause", "sentence"])
#: Bytes of text that are scanned together.
SLICE = 1 << 20


@cache
def classes() -> np.ndarray:
    """The class of each code point."""
    table = np.zeros(0x110000, np.uint8)
    for point in range(0x110000):
        category = unicodedata.category(chr(point))
        if category[0] == "P":
            table[point] = PUNCTUATION
        elif category == "Nd":
            table[point] = DIGIT
    for ranges, kind in ((scripts.MARK_RANGES, MARK), (scripts.LATIN_RANGES, LATIN), (scripts.HAN_RANGES, HAN), (scripts.SPACE_RANGES, SPACE)):
        for low, high in ranges:
            table[low : high + 1] = kind
    return table


def slices(texts: pa.Array, most: int = SLICE) -> Iterator[pa.Array]:
    """Stretches of about so many bytes; a longer text is one of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        base = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
        yield texts.slice(at, end - at)
        at = end


def _strings(data: bytes, offsets: np.ndarray) -> pa.Array:
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data))


@dataclass
class Scan:
    """Tokens of a batch, in order: `of` is the number of a token's text, `first` the first token of each text and of none."""

    data: bytes
    codes: np.ndarray
    byte: np.ndarray
    text_at: np.ndarray
    start: np.ndarray
    end: np.ndarray
    kind: np.ndarray
    of: np.ndarray
    first: np.ndarray

    def before(self, values: np.ndarray, k: int = 1, none: int = NONE) -> np.ndarray:
        """For each token the value of the k-th one before it in its text."""
        out = np.full(len(values), none, np.int64)
        out[k:] = values[: len(values) - k]
        out[self.ids() < k] = none
        return out

    def after(self, values: np.ndarray, none: int = NONE) -> np.ndarray:
        out = np.full(len(values), none, np.int64)
        out[:-1] = values[1:]
        out[self.first[1:][self.first[1:] > self.first[:-1]] - 1] = none
        return out

    def ids(self) -> np.ndarray:
        return np.arange(len(self.start)) - self.first[self.of]

    def texts(self) -> pa.Array:
        return _strings(self.data, np.append(self.byte[self.start], self.byte[-1]))

    def characters(self) -> pa.Array:
        return _strings(self.data, self.byte)

    def boundaries(self) -> np.ndarray:
        """Places in BOUNDARIES: what stands before each token, by the last one that is no space."""
        spaced = self.before(self.kind) == SPACE
        kind = np.where(spaced, self.before(self.kind, 2), self.before(self.kind))
        last_code = self.codes[self.end - 1] if len(self.end) else np.zeros(0, np.int64)
        last = np.where(spaced, self.before(last_code, 2, -1), self.before(last_code, 1, -1))
        switch = ((self.kind == HAN) & (kind == LATIN)) | ((self.kind == LATIN) & (kind == HAN))
        marks = lambda text: np.isin(last, [ord(c) for c in text])
        return np.select([(kind == NONE) | (self.kind == SPACE), marks(scripts.SENTENCE_MARKS), marks(scripts.PAUSE_MARKS), switch, spaced], [0, 4, 3, 2, 1], 0)

    def islands(self, foreign: int) -> tuple[np.ndarray, np.ndarray]:
        """(inside, opens): tokens of islands of the foreign language, which take a space between two of its tokens."""
        joins = (self.kind == SPACE) & (self.before(self.kind) == foreign) & (self.after(self.kind) == foreign)
        inside = (self.kind == foreign) | joins
        return inside, inside & (self.before(inside.astype(np.int64), 1, 0) == 0)


def codes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, where each text begins (and the end), and whether the last character that is no mark is Latin."""
    values = [t or "" for t in texts.to_pylist()]
    codes = np.frombuffer("".join(values).encode("utf-32-le", "surrogatepass"), "<u4")
    text_at = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int64)
    raw = classes()[codes]
    opens = np.zeros(len(codes) + 1, bool)
    opens[text_at] = True
    bearer = np.maximum.accumulate(np.where((raw != MARK) | opens[:-1], np.arange(len(codes)), 0)) if len(codes) else np.zeros(0, np.int64)
    return codes, text_at, raw[bearer] == LATIN


def scan(texts: pa.Array) -> Scan:
    """Null texts are empty ones."""
    codes, text_at, latin = codes_of(texts)
    byte = np.concatenate([[0], np.cumsum(1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000))])
    n = len(codes)
    raw = classes()[codes]
    opens, closes = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    opens[text_at] = True
    closes[text_at[text_at > 0] - 1] = True
    opens, closes = opens[:n], closes[:n]
    # A mark belongs to Latin if the last character that is no mark does.
    kind = np.where((raw == MARK) & latin, np.uint8(LATIN), raw)
    before, after = np.full(n, NONE, np.uint8), np.full(n, NONE, np.uint8)
    before[1:], after[:-1] = kind[:-1], raw[1:]
    before[opens], after[closes] = NONE, NONE
    for joiners, joined in ((".:/-", DIGIT), ("'’-", LATIN)):
        kind[np.isin(codes, [ord(c) for c in joiners]) & (before == joined) & (after == joined)] = joined
    single = (kind == OTHER) | (kind == PUNCTUATION) | (kind == MARK)
    change = np.ones(n, bool)
    change[1:] = kind[1:] != kind[:-1]
    start = np.flatnonzero(change | opens | single)
    of = np.searchsorted(text_at, start, "right") - 1
    return Scan("".join([t or "" for t in texts.to_pylist()]).encode("utf-8", "surrogatepass"), codes, byte, text_at, start, np.append(start[1:], n)[: len(start)], kind[start], of, np.searchsorted(start, text_at))
