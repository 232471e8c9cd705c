"""Phrases found in many texts at once: a trie in flat arrays, walked from every place of a batch in step.

States are numbered level by level, so the sorted keys of all edges (state and code point) are one array, and an edge's place in
it is the state it leads to. All occurrences of phrases, or the longest from the left, come out as arrays; Python sees no character.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np

_BITS = 21


def code_points(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, and where each begins (and the end)."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    return codes, np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)]).astype(np.int64)


def chain(following: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Mask of what is reached from the heads; following: for each element a later one, or len(following) for none."""
    n = len(following)
    reached = np.zeros(n + 1, bool)
    reached[heads] = True
    jump, before = np.append(following, n), -1
    # Each round doubles the steps that are taken at once.
    while (now := int(reached[:n].sum())) != before or (jump[:n] < n).any():
        before = now
        reached[jump[np.flatnonzero(reached)]] = True
        jump = jump[jump]
    return reached[:n]


class PhraseTable:
    """Distinct phrases, numbered in the order they come; empty ones are left out."""

    def __init__(self, phrases: Sequence[str]):
        self.phrases = list(dict.fromkeys(p for p in phrases if p))
        codes, at = code_points(self.phrases)
        size = np.diff(at)
        state, n_states, keys = np.zeros(len(size), np.int64), 1, []
        order = np.argsort(-size, kind="stable")  # what is still to go is a head of this
        left = np.searchsorted(-size[order], -np.arange(1, int(size.max(initial=0)) + 1), "right")
        for k, n in enumerate(left.tolist()):
            going = order[:n]
            distinct, inverse = np.unique((state[going] << _BITS) | codes[at[going] + k], return_inverse=True)
            state[going] = n_states + inverse
            keys.append(distinct)
            n_states += len(distinct)
        self.keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        self.value = np.full(n_states, -1, np.int64)
        self.value[state] = np.arange(len(size))
        self.first = np.zeros(1 << _BITS, np.int32)
        n_first = len(keys[0]) if keys else 0
        self.first[self.keys[:n_first]] = np.arange(1, n_first + 1)
        self.size = size

    def _walk(self, codes: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
        """(places, length, phrases) of all occurrences, shorter ones first; at: where texts begin, and the end."""
        state = self.first[codes].astype(np.int64)
        place = np.flatnonzero(state)
        state = state[place]
        end = at[np.searchsorted(at, place, "right")] if len(place) else place
        k = 1
        while len(place):
            value = self.value[state]
            ends = value >= 0
            if ends.any():
                yield place[ends], k, value[ends]
            inside = place + k < end
            place, state, end = place[inside], state[inside], end[inside]
            if not len(place):
                return
            key = (state << _BITS) | codes[place + k]
            found = np.searchsorted(self.keys, key)
            goes = self.keys[np.minimum(found, len(self.keys) - 1)] == key
            place, state, end = place[goes], found[goes] + 1, end[goes]
            k += 1

    def occurrences(self, codes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places, lengths, phrases) of all occurrences."""
        found = [(p, np.full(len(p), k, np.int64), v) for p, k, v in self._walk(codes, at)]
        return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 3

    def leftmost_longest(self, codes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places, lengths, phrases) of those that a reader takes who goes from left to right and takes the longest at each place."""
        length, phrase = np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64)
        for place, k, value in self._walk(codes, at):
            length[place], phrase[place] = k, value
        place = np.flatnonzero(length)
        taken = place[chain(np.searchsorted(place, place + length[place]), np.zeros(min(1, len(place)), np.int64))]
        return taken, length[taken], phrase[taken]


class PhraseMap:
    """Phrases to phrases of the same length, longest first from the left; what is in no phrase stays."""

    def __init__(self, pairs: Mapping[str, str]):
        for a, b in pairs.items():
            if len(a) != len(b):
                raise ValueError(f"{a!r} and {b!r} differ in length")
        self.table = PhraseTable(list(pairs))
        self.codes, self.at = code_points([pairs[p] for p in self.table.phrases])

    def convert(self, texts: Sequence[str]) -> list[str]:
        codes, at = code_points(texts)
        place, length, phrase = self.table.leftmost_longest(codes, at)
        ends = np.cumsum(length)
        inside = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - length, length)
        codes[np.repeat(place, length) + inside] = self.codes[np.repeat(self.at[phrase], length) + inside]
        whole = codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        bounds = at.tolist()
        return [whole[a:b] for a, b in zip(bounds, bounds[1:])]
