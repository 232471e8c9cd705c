"""Backends: a request for the words of one language in an utterance, answered with units for each token id.

A backend has a `name`, `traits` and `predict(request)`, which gives {token id: [Unit, ...]}. Whatever it raises becomes a
BackendError, a fallback then gets the whole request. REGISTRY names the ones that come with the library.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import NamedTuple, Protocol

from phonoweave.functions import lexicon, scripts
from phonoweave.functions import phonetics as P
from phonoweave.functions.text import fold
from phonoweave.operators import spelling
from phonoweave.operators.errors import AlignmentError, BackendError, ConfigurationError, PhoneticsError


@dataclass(slots=True)
class Token:
    id: int
    text: str
    start: int
    end: int
    language: str
    kind: str
    boundary: str
    pos: str | None
    spans: Sequence[tuple[int, int]]


@dataclass(slots=True)
class Unit:
    """What is spoken for some characters of a token; spans are theirs in the source."""

    text: str
    spans: Sequence[tuple[int, int]]
    phones: list[str]
    alphabet: str
    native: str
    tone: str | None = None
    stress: Sequence[tuple[int, int]] = ()
    is_unknown: bool = False
    contour: str = ""
    source_alphabet: str | None = None
    source_phones: Sequence[str] = ()


class Traits(NamedTuple):
    language: str
    alphabet: str
    dialect: str | None = None


class Piece(NamedTuple):
    """A token of a projection; ids are the tokens it stands for."""

    text: str
    kind: str
    ids: tuple[int, ...]


@dataclass
class Request:
    tokens: Sequence[Token]
    language: str
    dialect: str | None = None

    @property
    def targets(self) -> list[Token]:
        return [t for t in self.tokens if t.language == self.language]

    def projection(self) -> list[Piece]:
        """Target words, one placeholder for each island of the other language, anything else as context."""
        other, out = "en" if self.language == "zh" else "zh", []
        langs = [t.language for t in self.tokens] + [None]
        for k, token in enumerate(self.tokens):
            bridge = token.language == "space" and k > 0 and langs[k - 1] == other and langs[k + 1] == other
            if token.language == other or bridge:
                if out and out[-1].kind == "placeholder" and out[-1].ids[-1] == self.tokens[k - 1].id:
                    out[-1] = out[-1]._replace(ids=(*out[-1].ids, token.id))
                else:
                    out.append(Piece(scripts.PLACEHOLDERS[other], "placeholder", (token.id,)))
            else:
                out.append(Piece(token.text, "target" if token.language == self.language else "context", (token.id,)))
        return out

    def characters(self, placeholder: str, keep_context: bool) -> tuple[str, list[tuple[int, int] | None]]:
        """The projection by character, and the (token id, place) that each is from."""
        text, sources = [], []
        for piece in self.projection():
            if piece.kind == "target":
                text += piece.text
                sources += [(piece.ids[0], k) for k in range(len(piece.text))]
            elif keep_context and piece.kind == "context":
                text += piece.text
                sources += [None] * len(piece.text)
            elif keep_context or not sources or sources[-1] is not None:
                text.append(placeholder)
                sources.append(None)
        return "".join(text), sources


class Backend(Protocol):
    name: str
    traits: Traits

    def predict(self, request: Request) -> Mapping[int, list[Unit]]: ...


def ask(backend: Backend, request: Request) -> Mapping[int, list[Unit]]:
    """The backend's answer; whatever else it raises is a BackendError."""
    try:
        return backend.predict(request)
    except PhoneticsError:
        raise
    except Exception as e:
        raise BackendError(f"{backend.name}: {type(e).__name__}: {e}") from e


class WithFallback:
    """Another backend of the same traits answers the whole request when the first one fails."""

    def __init__(self, first: Backend, then: Backend):
        if first.traits != then.traits or first.name == then.name:
            raise ConfigurationError(f"{then.name} can't stand in for {first.name}")
        self.first, self.then = first, then
        self.name, self.traits = f"{first.name}->{then.name}", first.traits

    def predict(self, request: Request) -> Mapping[int, list[Unit]]:
        failures = []
        for backend in (self.first, self.then):
            try:
                return ask(backend, request)
            except BackendError as e:
                failures.append(f"{backend.name}: {e}" if not str(e).startswith(backend.name) else str(e))
        raise BackendError("; ".join(failures))


def syllable_units(char: str, spans: Sequence[tuple[int, int]], reading: str | None, dialect: str, attested: frozenset[str] | None = None) -> list[Unit]:
    """Units of one character: a reading may have several syllables, none is an unknown unit."""
    alphabet = "pinyin" if dialect == "mandarin" else "jyutping"
    if reading is None:
        return [Unit(char, spans, [], alphabet, "", is_unknown=True)]
    out = []
    for syllable in reading.split():
        try:
            *phones, tone = P.split_pinyin(syllable, True) if dialect == "mandarin" else P.split_jyutping(syllable, attested)
        except ValueError as e:
            raise BackendError(str(e)) from None
        out.append(Unit(char, spans, [p for p in phones if p], alphabet, syllable, tone))
    return out


@dataclass
class HanBackend:
    """Base of backends for Han words: readings by token, checked for number, unknown ones by the policy."""

    dialect: str = "mandarin"
    unknown: str = "strict"
    attested: frozenset[str] | None = None
    name: str = "dictionary"

    @property
    def traits(self) -> Traits:
        return Traits("zh", "pinyin" if self.dialect == "mandarin" else "jyutping", self.dialect)

    def readings(self, request: Request) -> Mapping[int, Sequence[str | None]]:
        raise NotImplementedError

    def predict(self, request: Request) -> dict[int, list[Unit]]:
        out, found = {}, self.readings(request)
        for token in request.targets:
            got = list(found.get(token.id, ()))
            if len(got) != len(token.text):
                raise AlignmentError(f"{self.name}: {len(got)} readings for {len(token.text)} characters of {token.text!r}")
            if self.unknown == "strict" and None in got:
                raise BackendError(f"{self.name}: no reading for {token.text[got.index(None)]!r}")
            out[token.id] = [u for char, span, r in zip(token.text, token.spans, got) for u in syllable_units(char, [span], r, self.dialect, self.attested)]
        return out


@dataclass
class DictionaryBackend(HanBackend):
    """Listed phrases as wholes, longest first, else the first reading of each character."""

    han: Mapping[str, Sequence[str]] = field(default_factory=dict)
    phrases: Mapping[str, str] = field(default_factory=dict)

    def __post_init__(self):
        self.longest = max(map(len, self.phrases), default=1)

    def look_up(self, text: str) -> list[str | None]:
        out, at = [], 0
        while at < len(text):
            size = next((k for k in range(min(self.longest, len(text) - at), 1, -1) if text[at : at + k] in self.phrases), 1)
            word = text[at : at + size]
            if size > 1:
                out += one_reading(self.phrases[word].split(), size)
            else:
                out.append(next(iter(self.han.get(word, ())), None))
            at += size
        return out

    def readings(self, request: Request) -> dict[int, list[str | None]]:
        return {t.id: self.look_up(t.text) for t in request.targets}


def one_reading(syllables: Sequence, size: int) -> list[str]:
    """A flat list of one syllable for each character; nested lists hold exactly one candidate."""
    out = []
    for s in syllables:
        if not isinstance(s, str):
            if len(s) != 1:
                raise BackendError(f"{len(s)} candidates where one is wanted")
            s = s[0]
        out.append(s)
    if len(out) != size:
        raise AlignmentError(f"{len(out)} readings for {size} characters")
    return out


@dataclass
class RunBackend(HanBackend):
    """A function from a word to a reading for each character, None where it knows none."""

    function: Callable[[str], Sequence[str | None]] | None = None
    name: str = "custom"

    def readings(self, request: Request) -> dict[int, Sequence[str | None]]:
        return {t.id: self.function(t.text) for t in request.targets}


@dataclass
class SequenceBackend(HanBackend):
    """A model that reads whole utterances: it gets the projection by character and gives one sentence back, a (character,
    reading or None) for each place. Characters must come back as they were sent; those it leaves out go to a dictionary."""

    model: Callable[[list[str]], Sequence[Sequence[tuple[str, str | None]]]] | None = None
    placeholder: str = "，"
    keep_context: bool = False
    dictionary: DictionaryBackend | None = None
    name: str = "polyphone"

    def readings(self, request: Request) -> dict[int, list[str | None]]:
        if self.model is None:
            raise ConfigurationError(f"{self.name} needs a model")
        text, sources = request.characters(self.placeholder, self.keep_context)
        answer = self.model([text])
        if not isinstance(answer, Sequence) or len(answer) != 1:
            raise AlignmentError(f"{self.name}: one sentence is wanted back")
        if len(answer[0]) != len(text):
            raise AlignmentError(f"{self.name}: {len(answer[0])} places for {len(text)} characters")
        out: dict[int, list[str | None]] = {t.id: [] for t in request.targets}
        for sent, source, (char, reading) in zip(text, sources, answer[0]):
            if char != sent:
                raise AlignmentError(f"{self.name}: {char!r} came back for {sent!r}")
            if source is not None:
                if reading is None and self.dictionary is not None:
                    reading = self.dictionary.look_up(char)[0]
                if isinstance(reading, str) and reading.rstrip("12345") == char:
                    reading = None  # the character itself is no reading
                if reading is not None and (not isinstance(reading, str) or not reading.strip()):
                    raise BackendError(f"{self.name}: {reading!r} is no reading of {char!r}")
                out[source[0]].append(reading)
        return out


def phrase_model(dictionary: DictionaryBackend) -> Callable[[list[str]], list[list[tuple[str, str | None]]]]:
    """A model of phrases: longest match over whole utterances, across words."""
    return lambda sentences: [list(zip(s, dictionary.look_up(s))) for s in sentences]


_APOSTROPHES = {ord("’"): "'", ord("‘"): "'"}


class EnglishBackend:
    """Words by a decision list: clitics, short capitals by letter, the lexicon, short words by letter, known parts, and
    letter-to-sound. Each part is a parameter; tags are asked for only where a word has a homograph rule."""

    name, traits = "english", Traits("en", "arpabet")

    def __init__(
        self,
        words: Mapping[str, Sequence[str]] = lexicon.ENGLISH_SEED,
        homographs: Mapping[str, tuple[str, str, str]] = lexicon.HOMOGRAPHS,
        tagger: Callable[[list[str]], Sequence[str]] = spelling.tag,
        sounds: Callable[[str], Sequence[str]] = spelling.letter_to_sound,
        parts: Callable[[str, Mapping], Sequence[str]] = spelling.segment,
    ):
        forced = {w.lower() for w in lexicon.FORCE_SPELLINGS}
        self.words = {w: r for w, r in words.items() if w not in forced}
        self.homographs, self.tagger, self.sounds, self.parts = homographs, tagger, sounds, parts
        self.seen: dict[tuple[str, str | None], tuple] = {}

    def needs_context(self, words: Sequence[str]) -> bool:
        return any(w.lower() in self.homographs and w.lower() in self.words for w in words)

    def tags(self, request: Request) -> dict[int, str]:
        """Tags of the targets, by words, placeholders and marks around them."""
        pieces = [p for p in request.projection() if not p.text.isspace()]
        tags = list(self.tagger([p.text for p in pieces]))
        if len(tags) != len(pieces) or not all(isinstance(t, str) for t in tags):
            raise BackendError("a tag is wanted for each word")
        return {p.ids[0]: t for p, t in zip(pieces, tags) if p.kind == "target"}

    def predict(self, request: Request) -> dict[int, list[Unit]]:
        targets = request.targets
        tags = self.tags(request) if self.needs_context([t.text for t in targets]) else {}
        return {i: u for t in targets for i, u in self.tagged(t, tags.get(t.id)).items()}

    def tagged(self, token: Token, tag: str | None) -> dict[int, list[Unit]]:
        """The units of one word with its tag."""
        key = token.text, tag
        got = self.seen.get(key)
        if got is None:
            got = self._read(*key)
            if len(self.seen) < 200_000:
                self.seen[key] = got
        phones, native, stress = got
        return {token.id: [Unit(token.text, token.spans, phones, "arpabet", native, None, stress)]}

    def sound(self, text: str, tag: str | None) -> list[str]:
        """ARPABET phones with stress of a word as it is written."""
        try:
            word = fold(text.translate(_APOSTROPHES))
        except ValueError as e:
            raise BackendError(str(e)) from None
        return self.pronounce(word, tag)

    def _read(self, text: str, tag: str | None) -> tuple:
        rendered = self.sound(text, tag)
        phones = [p.rstrip("012") for p in rendered]
        return phones, " ".join(rendered), [(k, int(p[-1])) for k, p in enumerate(rendered) if p[-1].isdigit()]

    def pronounce(self, word: str, tag: str | None = None) -> list[str]:
        low = word.lower()
        if low in lexicon.CLITICS:
            return lexicon.CLITICS[low].split()
        if word.isalpha() and word.isupper() and len(word) <= 3:
            return self._spell(low)
        if low in self.words:
            rule = self.homographs.get(low)
            if rule and tag is not None:
                return (rule[0] if tag.startswith(rule[2]) else rule[1]).split()
            return self.words[low][0].split()
        if word.isalpha() and (word.islower() and len(word) <= 3 or word.isupper() and len(word) <= 4):
            return self._spell(low)
        parts = list(self.parts(low, self.words))
        if len(parts) > 1:
            # A part has no tag, so a homograph takes its other reading.
            return [p for part in parts for p in (self._spell(part) if len(part) == 1 and part.isalpha() else self.pronounce(part, "" if part in self.homographs else None))]
        phones = self.sounds(re.sub("[^a-z]", "", low))
        if isinstance(phones, str) or not phones or not all(isinstance(p, str) and p for p in phones):
            raise BackendError(f"no phones for {word!r}")
        return list(phones)

    @staticmethod
    def _spell(low: str) -> list[str]:
        return [p for c in low for p in lexicon.LETTER_NAMES[c].split()]


def _dictionary(o, unknown: str) -> DictionaryBackend:
    return DictionaryBackend(o.mode, unknown, o.attested_jyutping, han=o.han, phrases=o.phrases if o.mode == "mandarin" else o.cantonese_phrases)


def _contextual(o, unknown: str) -> SequenceBackend:
    d = _dictionary(o, unknown)
    return SequenceBackend(o.mode, unknown, o.attested_jyutping, model=o.model or phrase_model(d), placeholder="\ue000", keep_context=True, name="contextual")


def _polyphone(o, unknown: str) -> SequenceBackend:
    return SequenceBackend(o.mode, unknown, o.attested_jyutping, model=o.model, dictionary=_dictionary(o, unknown))


#: Makers of backends by mode and name; the first of a mode is its default.
REGISTRY: dict[str, dict[str, Callable]] = {
    "mandarin": {"dictionary": _dictionary, "polyphone": _polyphone},
    "cantonese": {"contextual": _contextual, "dictionary": _dictionary},
}


def build(o, chosen, unknown: str) -> Backend:
    """A backend by name, from a function of a word, or as it is; None is the mode's default."""
    if chosen is None or isinstance(chosen, str):
        makers = REGISTRY[o.mode]
        if chosen is not None and chosen not in makers:
            raise ConfigurationError(f"{o.mode} has no backend {chosen!r}; it has {', '.join(makers)}")
        return makers[chosen or next(iter(makers))](o, unknown)
    if hasattr(chosen, "predict"):
        traits = getattr(chosen, "traits", None)
        if traits is None or traits.language != "zh" or traits.dialect != o.mode:
            raise ConfigurationError(f"{getattr(chosen, 'name', chosen)!r} is no backend for {o.mode}")
        return chosen
    if not callable(chosen):
        raise ConfigurationError(f"no backend: {chosen!r}")
    return RunBackend(o.mode, unknown, o.attested_jyutping, function=chosen)
