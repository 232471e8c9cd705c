"""Conversion of many texts at once, over token rows: each distinct word is read once, and phones are gathered by offset.

A Han run or an English word (with its tag, where a homograph asks for one) always sounds alike: neighbours that are no Han
characters end a run, for segmentation, readings and tone sandhi alike. So the tokens of a batch are encoded by a dictionary, its entries are
read, and counts, phones, lines and errors are taken from the entries' arrays. Python sees distinct words only, and
texts that are written otherwise after normalization.

A caller's function of a word may answer otherwise each time, so it is asked for each word of each text, as the converter
asks it; what follows from its answers is worked out once for each run and set of answers.

Backends that look at whole utterances, a fallback, and normalizers or processors of the caller's are no function of
the word: convert() of utterance.py serves them.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, replace
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from phonoweave.functions import phonetics as P
from phonoweave.functions import scan as S
from phonoweave.functions import scripts
from phonoweave.functions.text import latin_tables, normalized_compatibility
from phonoweave.operators import numbers
from phonoweave.operators.backends import EnglishBackend, RunBackend, Token
from phonoweave.operators.errors import PhoneticsError
from phonoweave.operators.utterance import Converter, Options

#: Words whose readings a Python worker keeps.
MOST_KEPT = 500_000


def by_word(options: Options) -> bool:
    """Whether readings are a function of the word."""
    if options.fallback is not None or options.model is not None or options.normalizers or options.processors:
        return False
    if options.english_backend is not None and type(options.english_backend) is not EnglishBackend:
        return False
    a_function = callable(options.backend) and not hasattr(options.backend, "predict")
    if options.backend is not None and not a_function and options.backend not in ("dictionary", "contextual"):
        return False
    phrases = options.phrases if options.mode == "mandarin" else options.cantonese_phrases
    return all(scripts.is_han(c) for p in phrases for c in p)


@dataclass(slots=True)
class Reading:
    """What is said for a run or word: its words and their phones, or an error; unknown: words and places of unread characters."""

    words: list[tuple[str, list[str]]]
    n_tokens: int = 1
    error: str | None = None
    unknown: tuple[tuple[str, int, int], ...] = ()


class _Unlisted:
    """An answer that is no list of readings: it fails whenever it is taken as one."""

    def __init__(self, error: Exception):
        self.error = error

    def __iter__(self):
        raise self.error


def _listed(answer) -> tuple | _Unlisted:
    try:
        return tuple(answer)
    except Exception as e:  # the converter finds it where it checks the answer
        return _Unlisted(e)


def _plain(answers: tuple) -> bool:
    """Whether equal answers are read alike."""
    return all(type(a) is tuple and all(r is None or isinstance(r, str) for r in a) for a in answers)


@cache
def _unfoldable() -> np.ndarray:
    table = np.zeros(0x110000, bool)
    table[[ord(c) for c in latin_tables()[2]]] = True
    return table


@cache
def _spoken() -> dict[str, list[str]]:
    """IPA segments of each ARPABET phone, a mark of stress before the vowel's first."""
    out = {c: i.split() for c, i in P.EN_CONSONANTS.items()}
    for vowel, ipa in P.EN_VOWELS.items():
        for stress, mark in enumerate(("", "ˈ", "ˌ")):
            first, *rest = (P.EN_UNSTRESSED.get(vowel, ipa) if stress == 0 else ipa).split()
            out[f"{vowel}{stress}"] = [mark + first, *rest]
    return out


class Reader:
    """Reads words with a converter's parts, each distinct one once."""

    def __init__(self, converter: Converter):
        self.converter, self.o = converter, converter.o
        self.seen: dict[tuple[str, str, str | tuple | None], Reading] = {}
        #: A caller's function of a word.
        self.function = converter.han.function if isinstance(converter.han, RunBackend) else None
        self.homographs = {w for w in converter.english.homographs if w in converter.english.words} if isinstance(converter.english, EnglishBackend) else set()

    def read(self, text: str, language: str, by: str | tuple | None = None) -> Reading:
        """by: a homograph's tag, or the function's answers to the words of a Han run."""
        key = text, language, by
        got = self.seen.get(key)
        if got is None:
            if len(self.seen) >= MOST_KEPT:  # the first seen are the most frequent
                self.seen = dict(itertools.islice(self.seen.items(), MOST_KEPT // 2))
            got = self.seen[key] = self._read(*key)
        return got

    @contextmanager
    def answered(self, answers: Sequence) -> Iterator[Converter]:
        """The converter with a function that gives these answers in turn."""
        rest, asked = iter(answers), self.converter.han
        self.converter.han = replace(asked, function=lambda _: next(rest))
        try:
            yield self.converter
        finally:
            self.converter.han = asked

    def _read(self, text: str, language: str, by: str | tuple | None) -> Reading:
        if isinstance(by, tuple):
            with self.answered(by):
                return self._said(text, language, None)
        return self._said(text, language, by)

    def _said(self, text: str, language: str, tag: str | None) -> Reading:
        if language == "en" and type(self.converter.english) is EnglishBackend:
            try:
                phones = self.converter.english.sound(text, tag)
                if all(map(_spoken().__contains__, phones)):
                    return Reading([(text, [s for p in phones for s in _spoken()[p]] if self.o.output == "ipa" else phones)])
            except PhoneticsError as e:
                return Reading([], 1, f"{type(e).__name__}: {e}")
        c, spans = self.converter, [(k, k + 1) for k in range(len(text))]
        tokens, at = [], 0
        try:
            for word, pos in c.segment(text) if language == "zh" else ((text, None),):
                tokens.append(Token(len(tokens), word, at, at + len(word), language, "han" if language == "zh" else "latin", "none", pos, spans[at : at + len(word)]))
                at += len(word)
            units, names = c.predict(tokens, tag)
            units = c.process(tokens, units)
            unknown = tuple((names[t.id], u.spans[0][0], u.spans[-1][1]) for t in tokens for u in units[t.id] if u.is_unknown)
            if self.o.output == "ipa":
                units = {k: [c.to_ipa(u) for u in us] for k, us in units.items()}
            return Reading([(t.text, [p for u in units[t.id] for p in c.say(u)]) for t in tokens], len(tokens), None, unknown)
        except Exception as e:  # any word's failure is its texts' data
            return Reading([], max(1, len(tokens)), f"{type(e).__name__}: {e}")

    # Texts.

    def normalized(self, text: str) -> str:
        """The converter's normalization without spans, without traditional forms and without the check of Latin letters."""
        value = normalized_compatibility(text)
        if self.o.spell_numbers:
            value = numbers.spelled(value)
        return value

    def prepare(self, runs: list[str]) -> None:
        """Cut new Han runs into words, all of them at once where the segmenter can."""
        c = self.converter
        many = getattr(c.segmenter, "many", None)
        new = [r for r in runs if (r, "zh", None) not in self.seen] if many else []
        c.cut = dict(zip(new, many(new))) if new else {}

    def words(self, run: str) -> list[str] | str:
        """The words of a Han run, or the error that kept it from being cut."""
        try:
            return [w for w, _ in self.converter.segment(run)]
        except Exception as e:  # as any failure of a word
            return f"{type(e).__name__}: {e}"

    def batch(self, texts: pa.Array) -> Batch:
        return Batch(self, texts)


class Batch:
    """The tokens of a batch of texts that are spoken, and the readings of the distinct ones."""

    def __init__(self, reader: Reader, texts: pa.Array):
        self.reader, self.given = reader, texts.to_pylist()
        self.n = len(self.given)
        self.error: list[str | None] = [None if isinstance(t, str) else "TypeError: text must be a string" for t in self.given]
        self.texts: list[str | None] = list(self.given)
        for k, t in enumerate(self.given):
            if t is not None:
                try:
                    self.texts[k] = reader.normalized(t)
                except PhoneticsError as e:
                    self.texts[k], self.error[k] = None, f"{type(e).__name__}: {e}"
        if reader.o.traditional:
            there = [k for k, t in enumerate(self.texts) if t is not None]
            for k, t in zip(there, reader.converter.traditional.convert([self.texts[k] for k in there])):
                self.texts[k] = t
        self.scan = s = S.scan(pa.array(self.texts, pa.string()))
        self._check_latin()
        kept = np.flatnonzero((s.kind == S.HAN) | (s.kind == S.LATIN))
        self.kept, self.of = kept, s.of[kept]
        words = pc.dictionary_encode(s.texts().take(pa.array(kept))) if len(kept) else pa.array([], pa.string()).dictionary_encode()
        values = words.dictionary.to_pylist()
        self.entry = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        han = np.zeros(len(values), bool)
        han[self.entry] = s.kind[kept] == S.HAN
        reader.prepare([v for v, h in zip(values, han.tolist()) if h])
        #: Answers behind readings, and texts that fail before the function has answered.
        self.answers: dict[int, tuple] = {}
        self.unanswered: set[int] = set()
        if reader.function is None:
            self.readings = [reader.read(v, "zh" if h else "en") for v, h in zip(values, han.tolist())]
        else:
            self.readings = [Reading([]) if h else reader.read(v, "en") for v, h in zip(values, han.tolist())]
            self._ask(values, han)
        self._tag(values)
        self._first_errors()

    def _check_latin(self) -> None:
        """Texts with a letter that has no ASCII spelling, or a mark after Latin, are errors, in the converter's words."""
        s = self.scan
        bad = _unfoldable()[s.codes]
        marks = S.classes()[s.codes] == S.MARK
        if marks.any():
            bad |= marks & S.codes_of(pa.array(self.texts, pa.string()))[2]
        for k in np.unique(np.searchsorted(s.text_at, np.flatnonzero(bad), "right") - 1).tolist():
            try:
                self.reader.converter.normalize(self.given[k])
            except PhoneticsError as e:
                self.error[k] = f"{type(e).__name__}: {e}"

    def _ask(self, values: list[str], han: np.ndarray) -> None:
        """Ask the function for each word, text by text and in order; a Han run gets an entry for each set of answers."""
        reader, ask = self.reader, self.reader.function
        words = [reader.words(v) if h else [] for v, h in zip(values, han.tolist())]
        numbers_of: dict[tuple[int, tuple], int] = {}
        places = np.flatnonzero(han[self.entry])
        begins = np.flatnonzero(np.diff(self.of[places], prepend=-1)).tolist()
        runs = self.entry[places].tolist()
        for begin, end in zip(begins, [*begins[1:], len(runs)]):
            text = int(self.of[places[begin]])
            if self.error[text] is not None:
                continue
            uncut = next((words[r] for r in runs[begin:end] if isinstance(words[r], str)), None)
            if uncut is not None:
                self.error[text] = uncut
                continue
            try:
                for k in range(begin, end):
                    answers = tuple([_listed(ask(w)) for w in words[runs[k]]])
                    try:
                        number = numbers_of.get((runs[k], answers))
                    except TypeError:  # a reading that can't be a key
                        number = None
                    runs[k] = self._number(values, runs[k], answers, numbers_of) if number is None else number
            except PhoneticsError as e:
                self.error[text] = f"{type(e).__name__}: {e}"
            except Exception as e:  # as ask() of backends.py has it
                self.error[text] = f"BackendError: {reader.converter.han.name}: {type(e).__name__}: {e}"
        self.entry[places] = runs
        self.unanswered = {k for k, e in enumerate(self.error) if e is not None}

    def _number(self, values: list[str], run: int, answers: tuple, numbers_of: dict) -> int:
        number = len(self.readings)
        self.answers[number] = answers
        if _plain(answers):
            numbers_of[run, answers] = number
            self.readings.append(self.reader.read(values[run], "zh", answers))
        else:
            self.readings.append(self.reader._read(values[run], "zh", answers))
        return number

    def _tag(self, values: list[str]) -> None:
        """Homographs get an entry for each tag; only texts that hold one are tagged."""
        asks = np.zeros(len(self.readings), bool)
        asks[: len(values)] = [v.lower() in self.reader.homographs for v in values]
        if not asks.any():
            return
        places = np.flatnonzero(asks[self.entry])
        numbers_of: dict[tuple[str, str], int] = {}
        for text in np.unique(self.of[places]).tolist():
            if self.error[text] is not None:
                continue
            try:
                tags = self.reader.converter.english_tags(self.texts[text])
            except PhoneticsError as e:
                self.error[text] = f"{type(e).__name__}: {e}"
                continue
            for place in places[self.of[places] == text].tolist():
                key = values[self.entry[place]], tags[int(self.kept[place] - self.scan.first[text])]
                if key not in numbers_of:
                    numbers_of[key] = len(self.readings)
                    self.readings.append(self.reader.read(key[0], "en", key[1]))
                self.entry[place] = numbers_of[key]

    def _first_errors(self) -> None:
        """A text's error is that of its first failing Han run, else of its first failing word."""
        fails = np.array([r.error is not None for r in self.readings], bool)
        if not fails.any():
            return
        if self.reader.function is not None:
            return self._answered_errors(fails)
        for kind in (S.HAN, S.LATIN):
            places = np.flatnonzero(fails[self.entry] & (self.scan.kind[self.kept] == kind))
            of, first = np.unique(self.of[places], return_index=True)
            for text, place in zip(of.tolist(), places[first].tolist()):
                self.error[text] = self.error[text] or self.readings[self.entry[place]].error

    def _answered_errors(self, fails: np.ndarray) -> None:
        """A text's error is the one of its only failing reading, else what the converter says to the same answers: it checks all runs' answers before it reads on."""
        places = np.flatnonzero(fails[self.entry])
        for text, group in itertools.groupby(places.tolist(), lambda p: int(self.of[p])):
            if text in self.unanswered:
                continue
            failing = {int(self.entry[p]) for p in group}
            if len(failing) == 1 and self.error[text] is None:
                self.error[text] = self.readings[failing.pop()].error
                continue
            first, end = np.searchsorted(self.of, [text, text + 1])
            with self.reader.answered([a for k in self.entry[first:end].tolist() for a in self.answers.get(k, ())]) as converter:
                self.error[text] = converter.result(self.given[text]).error

    # Results.

    def _sums(self, each: np.ndarray) -> np.ndarray:
        return np.bincount(self.of, each[self.entry] if len(each) else [], self.n).astype(np.int64)

    def errors(self) -> pa.Array:
        return pa.array(self.error, pa.string())

    def n_tokens(self) -> pa.Array:
        """All tokens, with Han runs as their words; none where there is an error."""
        more = self._sums(np.array([r.n_tokens - 1 for r in self.readings], np.int64))
        whole = np.diff(np.append(self.scan.first, len(self.scan.start)))[: self.n] if len(self.scan.first) == self.n else np.diff(self.scan.first)
        return pa.array(np.where([e is None for e in self.error], whole + more, 0).astype(np.int32))

    def n_phones(self) -> pa.Array:
        each = np.array([sum(len(p) for _, p in r.words) for r in self.readings], np.int64)
        return pa.array(np.where([e is None for e in self.error], self._sums(each), 0).astype(np.int32))

    def _lists(self, each: list[list[str]]) -> pa.Array:
        """For each text the entries' lists one after the other; none where there is an error."""
        flat = pa.array([v for values in each for v in values], pa.string())
        size = np.array([len(v) for v in each], np.int64)
        begin = np.cumsum(size) - size
        ok = np.array([e is None for e in self.error], bool)[self.of] if self.n else np.zeros(0, bool)
        entry, of = self.entry[ok], self.of[ok]
        n = size[entry] if len(size) else np.zeros(0, np.int64)
        ends = np.cumsum(n)
        take = np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin[entry] - (ends - n), n) if len(ends) else np.zeros(0, np.int64)
        offsets = np.concatenate([[0], np.cumsum(np.bincount(of, n, self.n).astype(np.int64))])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat.take(pa.array(take)))

    def lines(self) -> pa.Array:
        """A line `token<TAB>phones` for each word with phones."""
        return self._lists([[f"{word}\t{' '.join(phones)}" for word, phones in r.words if phones] for r in self.readings])

    def phones(self) -> pa.Array:
        """Phones of each text with blanks between."""
        said = [" ".join(p for _, phones in r.words for p in phones) for r in self.readings]
        return pc.binary_join(self._lists([[s] if s else [] for s in said]), " ")

    def normalized(self) -> pa.Array:
        """Null where normalization itself fails."""
        return pa.array([None if e is not None and e.startswith(("NormalizationError", "TypeError")) else t for t, e in zip(self.texts, self.error)], pa.string())

    def warnings(self) -> pa.Array:
        """A warning for each unread character, in the converter's words."""
        unknown = np.array([bool(r.unknown) for r in self.readings], bool)
        out: list[list[str]] = [[] for _ in range(self.n)]
        places = np.flatnonzero(unknown[self.entry]) if len(unknown) else []
        for text, group in itertools.groupby(places, lambda p: int(self.of[p])):
            if self.error[text] is not None:
                continue
            source, value = self.given[text], self.texts[text]
            spans = None if value == source else self.reader.converter.normalize(source)[1]
            for place in group:
                at = int(self.scan.start[self.kept[place]] - self.scan.text_at[text])
                for name, a, b in self.readings[self.entry[place]].unknown:
                    x, y = (at + a, at + b) if spans is None else (spans[at + a][0], spans[at + b - 1][1])
                    out[text].append(f"{name}: no reading for {value[at + a : at + b]!r} from {source[x:y]!r} at {x}-{y}")
        return pa.array(out, pa.list_(pa.string()))
