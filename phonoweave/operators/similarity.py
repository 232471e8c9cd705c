"""Phonetic similarity: weighted alignment of IPA segments by articulatory features."""

from __future__ import annotations

from collections.abc import Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

#: Feature vectors by published phonetics: (consonant, place 0-8, manner 0-5, voice, aspirated, height 0-4, back 0-2, round, length or labial glide).
_CONSONANTS = {
    "p": (0, 0, 0), "b": (0, 0, 1), "t": (3, 0, 0), "d": (3, 0, 1), "k": (7, 0, 0), "ɡ": (7, 0, 1), "m": (0, 4, 1), "n": (3, 4, 1), "ŋ": (7, 4, 1),
    "f": (1, 2, 0), "v": (1, 2, 1), "θ": (2, 2, 0), "ð": (2, 2, 1), "s": (3, 2, 0), "z": (3, 2, 1), "ʃ": (4, 2, 0), "ʒ": (4, 2, 1), "ʂ": (5, 2, 0),
    "ɕ": (6, 2, 0), "x": (7, 2, 0), "h": (8, 2, 0), "t͡s": (3, 1, 0), "t͡ʃ": (4, 1, 0), "d͡ʒ": (4, 1, 1), "ʈ͡ʂ": (5, 1, 0), "t͡ɕ": (6, 1, 0), "l": (3, 3, 1),
    "ɹ": (3, 5, 1), "ɻ": (5, 5, 1), "j": (6, 5, 1), "w": (7, 5, 1), "ɥ": (6, 5, 1),
}
_VOWELS = {
    "i": (4, 0, 0), "y": (4, 0, 1), "ɪ": (3.5, 0.3, 0), "e": (3, 0, 0), "ɛ": (2, 0, 0), "æ": (1, 0, 0), "œ": (2, 0, 1), "a": (0, 1, 0), "ɐ": (0.7, 1, 0), "ə": (2, 1, 0),
    "ɚ": (2, 1.1, 0), "ɝ": (2.2, 1.1, 0), "ɵ": (3, 1, 1), "ʌ": (1.5, 1.6, 0), "ɑ": (0, 2, 0), "ɔ": (2, 2, 1), "o": (3, 2, 1), "ɤ": (3, 2, 0), "ʊ": (3.5, 1.7, 1), "u": (4, 2, 1),
}


@cache
def features(segment: str) -> tuple[float, ...]:
    """The vector of one segment; ValueError for anything else."""
    base = segment
    marks = {"ʰ": 0.0, "ʷ": 0.0, "ː": 0.0, "̩": 0.0, "̍": 0.0, "̚": 0.0}
    for mark in marks:
        if mark in base:
            marks[mark] = 1.0
            base = base.replace(mark, "")
    syllabic = marks["̩"] + marks["̍"]
    if base in _CONSONANTS:
        place, manner, voice = _CONSONANTS[base]
        return (1 - 0.5 * syllabic, place / 8, manner / 5, voice, marks["ʰ"], 0, 0, float(base in ("w", "ɥ")) + marks["ʷ"], 0.5 * marks["̚"])
    if base in _VOWELS:
        height, back, rounded = _VOWELS[base]
        return (0, 0.5, 1.2, 1, 0, height / 4, back / 2, rounded, 0.5 * marks["ː"])
    raise ValueError(f"no features for {segment!r}")


_WEIGHTS = (2.0, 1.5, 1.5, 0.5, 0.5, 1.0, 1.0, 0.5, 0.5)


def distance(left: str, right: str) -> float:
    return 0.0 if left == right else sum(w * abs(a - b) for w, a, b in zip(_WEIGHTS, features(left), features(right)))


def weight(segment: str) -> float:
    """Cost of leaving a segment out."""
    return 1.0 + 0.5 * features(segment)[0]


#: Cells of tables that are filled together; a pair with more is alone.
CELLS = 1 << 23
_MATCH, _DELETE, _INSERT = 0, 1, 2


def _moves(left: np.ndarray, right: np.ndarray, apart: np.ndarray, alone: np.ndarray, n_left: np.ndarray, n_right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(moves, distances) of pairs of padded code rows, an anti-diagonal of all tables at a time: a cell needs only the two before.

    A move is a byte; ties take the diagonal, then deletion.
    """
    pairs, m, n = len(left), left.shape[1], right.shape[1]
    moves = np.zeros((pairs, m + 1, n + 1), np.uint8)
    moves[:, 1:, 0], moves[:, 0, 1:] = _DELETE, _INSERT
    down = np.concatenate([np.zeros((pairs, 1)), np.cumsum(alone[left], axis=1)], axis=1)
    over = np.concatenate([np.zeros((pairs, 1)), np.cumsum(alone[right], axis=1)], axis=1)
    out = np.where(n_right == 0, down[np.arange(pairs), n_left], over[np.arange(pairs), n_right])
    # Costs of the last two diagonals, by row.
    older, last = np.zeros((pairs, m + 1)), np.zeros((pairs, m + 1))
    last[:, 0] = 0
    for d in range(1, m + n + 1):
        now = np.full((pairs, m + 1), np.inf)
        if d <= n:
            now[:, 0] = over[:, d]
        if d <= m:
            now[:, d] = down[:, d]
        i = np.arange(max(1, d - n), min(m, d - 1) + 1)
        if len(i):
            a, b = left[:, i - 1], right[:, d - i - 1]
            ways = np.stack([older[:, i - 1] + apart[a, b], last[:, i - 1] + alone[a], last[:, i] + alone[b]])
            move = ways.argmin(axis=0)
            moves[:, i, d - i] = move
            now[:, i] = ways.min(axis=0)
        ends = np.flatnonzero((n_left + n_right == d) & (n_left > 0) & (n_right > 0))
        out[ends] = now[ends, n_left[ends]]
        older, last = last, now
    return moves, out


def align_many(lefts: Sequence[Sequence[str]], rights: Sequence[Sequence[str]]) -> list[dict | str]:
    """For each pair align()'s result, or what is wrong with it."""
    segments = sorted({s for side in (lefts, rights) for row in side for s in row if s is not None})
    wrong: dict[str | None, str] = {None: "no features for None"}
    for s in segments:
        try:
            features(s)
        except ValueError as e:
            wrong[s] = str(e)
    known = [s for s in segments if s not in wrong]
    number = {s: k for k, s in enumerate(known)}
    apart = np.array([[distance(a, b) for b in known] for a in known]).reshape(len(known), len(known))
    alone = np.array([weight(s) for s in known])
    out: list[dict | str] = []
    for a, b in zip(lefts, rights):
        bad = next((wrong[s] for s in (*a, *b) if s in wrong), None)
        out.append("nothing to compare" if not a or not b else bad)
    sizes = np.array([[len(a), len(b)] for a, b in zip(lefts, rights)], np.int64).reshape(-1, 2)
    todo = [k for k in np.lexsort((sizes[:, 1], sizes[:, 0])).tolist() if out[k] is None]
    at = 0
    while at < len(todo):
        end, m, n = at, 0, 0
        while end < len(todo):
            m2, n2 = max(m, int(sizes[todo[end], 0])), max(n, int(sizes[todo[end], 1]))
            if end > at and (end - at + 1) * (m2 + 1) * (n2 + 1) > CELLS:
                break
            m, n, end = m2, n2, end + 1
        group = todo[at:end]
        left, right = np.zeros((len(group), m), np.int64), np.zeros((len(group), n), np.int64)
        for row, k in enumerate(group):
            left[row, : sizes[k, 0]] = [number[s] for s in lefts[k]]
            right[row, : sizes[k, 1]] = [number[s] for s in rights[k]]
        moves, costs = _moves(left, right, apart, alone, sizes[group, 0], sizes[group, 1])
        for row, k in enumerate(group):
            steps, i, j, table = [], int(sizes[k, 0]), int(sizes[k, 1]), moves[row]
            whole = max(sum(alone[left[row, :i]].tolist()), sum(alone[right[row, :j]].tolist()))
            while i or j:
                move = int(table[i, j])
                a, b = lefts[k][i - 1] if move != _INSERT else None, rights[k][j - 1] if move != _DELETE else None
                cost = alone[number[a]] if b is None else alone[number[b]] if a is None else apart[number[a], number[b]]
                steps.append(("insert" if a is None else "delete" if b is None else "match" if a == b else "substitute", a, b, float(cost)))
                i, j = i - (move != _INSERT), j - (move != _DELETE)
            got = float(costs[row])
            out[k] = {"distance": got, "maximum": whole, "score": min(1.0, max(0.0, 1 - got / whole)), "steps": steps[::-1]}
        at = end
    return out


def align(left: Sequence[str], right: Sequence[str]) -> dict:
    """Distance, the most it could be, score, and steps (operation, left, right, cost); ties take the diagonal, then deletion."""
    (got,) = align_many([left], [right])
    if isinstance(got, str):
        raise ValueError(got)
    return got


RESULT = "distance double, maximum double, score double, alignment array<struct<op:string,left:string,right:string,cost:double>>, error string"


def compare(left: Column, right: Column) -> Column:
    """align() of two arrays of IPA segments as an Arrow UDF; what can't be compared has an error instead of values."""

    kind = to_arrow_type(StructType.fromDDL(RESULT))

    def run(lefts: pa.Array, rights: pa.Array) -> pa.Array:
        rows = []
        for got in align_many(*([v or [] for v in side.to_pylist()] for side in (lefts, rights))):
            if isinstance(got, str):
                rows.append({"error": f"SimilarityError: {got}"})
            else:
                rows.append({"distance": got["distance"], "maximum": got["maximum"], "score": got["score"], "alignment": [dict(zip(("op", "left", "right", "cost"), s)) for s in got["steps"]]})
        return pa.array(rows, kind)

    return F.arrow_udf(run, RESULT)(left, right)
