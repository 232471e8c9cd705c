"""English words outside the lexicon: segmentation into known words, letter-to-sound rules, and tags for homographs."""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence

from phonoweave.functions import lexicon

#: Letter-to-sound rules, longest spelling first at each place; written for this library.
RULES = {
    "tion": "SH AH0 N", "sion": "ZH AH0 N", "ough": "AO1", "eigh": "EY1", "igh": "AY1", "tch": "CH", "sch": "S K", "dge": "JH", "ing": "IH0 NG", "ch": "CH", "sh": "SH",
    "th": "TH", "ph": "F", "wh": "W", "ck": "K", "ng": "NG", "qu": "K W", "kn": "N", "wr": "R", "ee": "IY1", "ea": "IY1", "oo": "UW1", "ou": "AW1", "ow": "OW1", "oi": "OY1",
    "oy": "OY1", "ai": "EY1", "ay": "EY1", "au": "AO1", "aw": "AO1", "ie": "IY1", "oa": "OW1", "ue": "UW1", "ew": "UW1", "er": "ER0", "ir": "ER1", "ur": "ER1", "ar": "AA1 R",
    "or": "AO1 R", "ss": "S", "ll": "L", "tt": "T", "nn": "N", "mm": "M", "pp": "P", "rr": "R", "dd": "D", "bb": "B", "ff": "F", "gg": "G", "zz": "Z", "a": "AE1", "b": "B",
    "c": "K", "d": "D", "e": "EH1", "f": "F", "g": "G", "h": "HH", "i": "IH1", "j": "JH", "k": "K", "l": "L", "m": "M", "n": "N", "o": "AA1", "p": "P", "q": "K", "r": "R",
    "s": "S", "t": "T", "u": "AH1", "v": "V", "w": "W", "x": "K S", "y": "IY0", "z": "Z",
}
_SPELLING = re.compile("|".join(sorted(RULES, key=len, reverse=True)))
_SOUNDS = {spelling: sounds.split() for spelling, sounds in RULES.items()}


def letter_to_sound(word: str) -> list[str]:
    """Phones of a lower-case word; only the first vowel keeps primary stress, a final e after a consonant is silent."""
    if len(word) > 2 and word.endswith("e") and word[-2] not in "aeiou":
        word = word[:-1]
    phones = [p for spelling in _SPELLING.findall(word) for p in _SOUNDS[spelling]]
    first = next((k for k, p in enumerate(phones) if p[-1] == "1"), len(phones)) + 1
    return phones[:first] + [p[:-1] + "0" if p[-1] == "1" else p for p in phones[first:]]


def by_letter(word: str) -> list[str]:
    """What each letter says by the rules: a spelling's phones are its first letter's; without the choice of stress."""
    out = [""] * len(word)
    silent = len(word) > 2 and word.endswith("e") and word[-2] not in "aeiou"
    for found in _SPELLING.finditer(word[:-1] if silent else word):
        out[found.start()] = RULES[found.group()]
    return out


def segment_by_cost(word: str, unigrams: Mapping[str, int], bigrams: Mapping[tuple[str, str], int] | None = None) -> list[str]:
    """The most probable sequence of words by counts: a pair's where it was seen, else the word's own; a word never seen costs
    more with each letter. The last word is the state, so pairs count across all cuts."""
    bigrams, total = bigrams or {}, max(1, sum(unigrams.values()))
    # A word never seen has no bound of its length, so every stretch is one.

    def cost(previous: str, part: str) -> float:
        if (previous, part) in bigrams and unigrams.get(previous):
            return -math.log(min(1.0, bigrams[previous, part] / unigrams[previous]))
        seen = unigrams.get(part)
        return -math.log(seen / total) if seen else math.log(total) + (len(part) - 1) * math.log(10)

    # best[end][start]: cost of a sequence whose last word is word[start:end], and where the word before it starts.
    best: list[dict[int, tuple[float, int]]] = [{} for _ in range(len(word) + 1)]
    for end in range(1, len(word) + 1):
        for start in range(end):
            part = word[start:end]
            ways = [(cost("", part), -1)] if start == 0 else [(c + cost(word[before:start], part), before) for before, (c, _) in best[start].items()]
            if ways:
                best[end][start] = min(ways)
    out, end = [], len(word)
    start = min(best[end], key=lambda k: best[end][k]) if word else -1
    while start >= 0 and end > 0:
        out.append(word[start:end])
        end, start = start, best[end][start][1]
    return out[::-1] or [word]


_LONGEST: dict[int, tuple[Mapping, int, int]] = {}


def longest_of(known: Mapping[str, object]) -> int:
    """Letters of the longest word, kept for the mapping as long as it has as many words."""
    got = _LONGEST.get(id(known))
    if got is None or got[0] is not known or got[1] != len(known):
        if len(_LONGEST) > 16:
            _LONGEST.clear()
        got = _LONGEST[id(known)] = known, len(known), max(map(len, known), default=0)
    return got[2]


def segment(word: str, known: Mapping[str, object]) -> list[str]:
    """The word as a sequence of known words of two letters or more, the fewest; the word itself if there is none."""
    longest, n = longest_of(known), len(word)
    best, before = [0] + [n + 1] * n, [0] * (n + 1)
    for end in range(2, n + 1):
        for start in range(max(0, end - longest), end - 1):
            if best[start] + 1 < best[end] and word[start:end] in known:
                best[end], before[end] = best[start] + 1, start
    if best[n] > n:
        return [word]
    out, end = [], n
    while end:
        out.append(word[before[end] : end])
        end = before[end]
    return out[::-1]


def tag(words: Sequence[str]) -> list[str]:
    """Penn tags by a small dictionary and the word before: after to, modals and pronouns a verb, otherwise a noun."""
    tags: list[str] = []
    for word in words:
        known = lexicon.TAG_SEED.get(word.lower())
        before = tags[-1] if tags else ""
        tags.append(known or ("VB" if before in ("TO", "MD", "PRP", "UH") else "VBD" if word.lower().endswith("ed") else "NN"))
    return tags
