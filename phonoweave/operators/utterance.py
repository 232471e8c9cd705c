"""The whole conversion of one utterance: normalize, tokenize, segment, ask backends, check, apply sandhi, transcribe, render.

Errors are data: a result carries `error` ("Type: message") instead of phones, whatever was raised, so one bad row fails no job.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace

import pyarrow as pa

from phonoweave.functions import lexicon, scan, scripts
from phonoweave.functions import phonetics as P
from phonoweave.functions.phrases import PhraseMap
from phonoweave.functions.text import compatibility, fold
from phonoweave.operators import backends, numbers, validation
from phonoweave.operators.backends import EnglishBackend, Request, Token, Unit, WithFallback
from phonoweave.operators.errors import AlignmentError, BackendError, ConfigurationError, NormalizationError, PhoneticsError, TranscriptionError
from phonoweave.operators.sandhi import Sandhi

__all__ = ["AlignmentError", "BackendError", "ConfigurationError", "Converter", "NormalizationError", "Options", "PhoneticsError", "Result", "TranscriptionError"]


def _class(ranges) -> str:
    return "".join(re.escape(chr(a)) if a == b else f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in ranges)


_L, _M = (_class(r) for r in (scripts.LATIN_RANGES, scripts.MARK_RANGES))
_BEYOND_ASCII = re.compile(rf"(?![\x00-\x7f])[{_L}]|(?<=[{_L}])[{_M}]")
_VERBS = frozenset("看想去来是说吃走")


def identity(text: str) -> tuple[str, list[tuple[int, int]]]:
    """The normalizer that changes nothing."""
    return text, [(k, k + 1) for k in range(len(text))]


def longest_match(known: Mapping[str, str | None] | Sequence[str]) -> Callable[[str], list[tuple[str, str]]]:
    """A segmenter: longest known words first, then single characters. Tags are those of the words, else coarse ones."""
    tags = dict(known) if isinstance(known, Mapping) else dict.fromkeys(known)
    most = max(map(len, tags), default=1)

    def segment(text: str) -> list[tuple[str, str]]:
        out, at = [], 0
        while at < len(text):
            size = next((k for k in range(min(most, len(text) - at), 1, -1) if text[at : at + k] in tags), 1)
            word = text[at : at + size]
            coarse = "v" if word in _VERBS else "m" if word in lexicon.DIGITS else "n" if size > 1 else "x"
            out.append((word, tags.get(word) or coarse))
            at += size
        return out

    return segment


#: Universal tags of the coarse tags of words, for segmenters of the other tag set.
UNIVERSAL = {"v": "VERB", "m": "NUM", "n": "NOUN", "a": "ADJ", "r": "PRON", "d": "ADV", "x": "X"}


def tagged_segmenter(known, tagset: str = "hkcancor") -> Callable[[str], list[tuple[str, str]]]:
    """longest_match() with tags of a tag set: hkcancor (letters, as they are) or universal."""
    if tagset not in ("hkcancor", "universal"):
        raise ValueError(f"no tag set {tagset!r}")
    segment = longest_match(known)
    return segment if tagset == "hkcancor" else lambda text: [(w, UNIVERSAL.get(t[:1], "X")) for w, t in segment(text)]


@dataclass
class Options:
    """mode: mandarin or cantonese; output: native or ipa; unknown: strict or preserve.

    Dictionaries are parameters: han (char to readings), phrases, english (word to readings), homographs, neutral words,
    traditional (characters, and phrases, to ones of the same length; the longest first). backend and fallback are names of backends.REGISTRY, functions of a word, or
    backends; a fallback is always strict. model is what a sequence backend asks. english_backend, segmenter, normalizers
    (functions from text to text and spans, before the check of Latin letters) and processors (functions from tokens and
    units to units, run after sandhi) replace or extend what comes with the library.
    """

    mode: str = "mandarin"
    output: str = "native"
    unknown: str = "strict"
    tone_sandhi: bool = True
    traditional: bool | None = None
    spell_numbers: bool = True
    han: Mapping[str, Sequence[str]] | None = None
    phrases: Mapping[str, str] = field(default_factory=lambda: lexicon.PHRASE_SEED)
    cantonese_phrases: Mapping[str, str] = field(default_factory=dict)
    english: Mapping[str, Sequence[str]] = field(default_factory=lambda: lexicon.ENGLISH_SEED)
    homographs: Mapping[str, tuple[str, str, str]] = field(default_factory=lambda: lexicon.HOMOGRAPHS)
    simplified_to_traditional: Mapping[str, str] = field(default_factory=lambda: lexicon.TRADITIONAL)
    neutral: Sequence[str] = field(default_factory=lambda: lexicon.NEUTRAL_SEED)
    attested_jyutping: frozenset[str] | None = None
    backend: object = None
    fallback: object = None
    model: Callable | None = None
    english_backend: object = None
    segmenter: Callable[[str], list[tuple[str, str]]] | None = None
    normalizers: Sequence[Callable[[str], tuple[str, list[tuple[int, int]]]]] = ()
    processors: Sequence[Callable] = ()

    def __post_init__(self):
        for name, allowed in (("mode", ("mandarin", "cantonese")), ("output", ("native", "ipa")), ("unknown", ("strict", "preserve"))):
            if getattr(self, name) not in allowed:
                raise ConfigurationError(f"{name} must be one of {', '.join(allowed)}: {getattr(self, name)!r}")
        if self.han is None:
            k = 0 if self.mode == "mandarin" else 1
            self.han = {c: v[k].split(",") for c, v in lexicon.HAN_SEED.items() if len(c) == 1}
        if self.traditional is None:
            self.traditional = self.mode == "cantonese"
        if any(len(a) != len(b) or not a for a, b in self.simplified_to_traditional.items()):
            raise ConfigurationError("simplified_to_traditional maps characters to characters, and phrases to phrases of the same length")
        if self.traditional and self.mode == "cantonese":
            self.han = dict(self.han) | {t: self.han[s] for s, t in self.simplified_to_traditional.items() if s in self.han and len(s) == 1}
        if self.english_backend is not None and getattr(getattr(self.english_backend, "traits", None), "language", None) != "en":
            raise ConfigurationError("english_backend is no backend for English")


@dataclass
class Result:
    original: str | None
    output: str
    normalized: str | None = None
    tokens: list[Token] = field(default_factory=list)
    units: dict[int, list[Unit]] = field(default_factory=dict)
    backends: dict[int, str] = field(default_factory=dict)
    rendered: dict[int, list[list[str]]] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)
    error: str | None = None

    @property
    def phones(self) -> list[str]:
        return [p for t in self.tokens for r in self.rendered.get(t.id, ()) for p in r]

    @property
    def base_phones(self) -> list[str]:
        return [p for t in self.tokens for u in self.units.get(t.id, ()) for p in u.phones]

    def lines(self) -> list[str]:
        """A line `token<TAB>phones` for each token with phones, as they are spoken."""
        spoken = ((t.text, [p for r in self.rendered.get(t.id, ()) for p in r]) for t in self.tokens)
        return [f"{text}\t{' '.join(phones)}" for text, phones in spoken if phones]

    def reconstructed(self) -> str:
        """The source, from the tokens' spans: each character once."""
        spans = sorted({s for t in self.tokens for s in t.spans})
        return "".join(self.original[a:b] for a, b in spans) if self.original is not None else ""


class Converter:
    def __init__(self, options: Options):
        self.o = options
        self.sandhi = Sandhi(neutral=options.neutral)
        self.segmenter = options.segmenter or longest_match([*options.phrases, *self.sandhi.known])
        self.traditional = PhraseMap(options.simplified_to_traditional) if options.traditional else None
        self.cut: dict[str, list[tuple[str, str]]] = {}
        self.han = backends.build(options, options.backend, options.unknown)
        if options.fallback is not None:
            then = backends.build(options, options.fallback, "strict")
            if callable(options.fallback) and not hasattr(options.fallback, "predict"):
                then.name = "fallback"
            # What the first leaves unknown is the fallback's to answer.
            first = backends.build(options, options.backend, "strict")
            self.han = WithFallback(first, then)
        self.english = options.english_backend or EnglishBackend(options.english, options.homographs)
        self.spoken: dict[tuple, list[str]] = {}

    # Normalization.

    def normalize(self, text: str) -> tuple[str, list[tuple[int, int]]]:
        value, spans = compatibility(text)
        for extra in self.o.normalizers:
            new, sources = extra(value)
            if not isinstance(new, str) or len(new) != len(sources):
                raise NormalizationError("a normalizer gives a text and a span for each of its characters")
            value, spans = new, [(spans[a][0], spans[b - 1][1]) if b > a else (0, 0) for a, b in sources]
        if self.o.spell_numbers:
            value, spans = numbers.spell_out(value, spans)
        if self.o.traditional:
            value = self.traditional.convert([value])[0]
        if not value.isascii():
            self.check_latin(text, value, spans)
        return value, spans

    @staticmethod
    def check_latin(text: str, value: str, spans: list[tuple[int, int]]) -> None:
        """Latin letters fold to ASCII ones, and no mark is left after them."""
        fine: set[str] = set()
        for found in _BEYOND_ASCII.finditer(value):
            char = found.group()
            if char in fine:
                continue
            try:
                if scripts.is_mark(char):
                    raise ValueError
                fold(char)
                fine.add(char)
            except ValueError:
                a, b = spans[found.start()]
                raise NormalizationError(f"no ASCII spelling for {char!r} from {text[a:b]!r} at {a}-{b}") from None

    # Tokens.

    def segment(self, text: str) -> list[tuple[str, str]]:
        parts = self.cut[text] if text in self.cut else self.segmenter(text)
        if "".join(w for w, _ in parts) != text or not all(w for w, _ in parts):
            raise AlignmentError(f"the segmenter did not keep {text!r}")
        return parts

    def tokens(self, text: str, spans: list[tuple[int, int]]) -> list[Token]:
        """The tokens of scan(), Han runs cut into words; the first word inherits what stands before the run."""
        s = scan.scan(pa.array([text]))
        columns = s.texts(), scan.LANGUAGES.take(pa.array(s.kind)), scan.KINDS.take(pa.array(s.kind)), scan.BOUNDARIES.take(pa.array(s.boundaries()))
        out: list[Token] = []
        for value, lang, kind, boundary, at in zip(*(c.to_pylist() for c in columns), s.start.tolist()):
            for k, (part, pos) in enumerate(self.segment(value) if lang == "zh" else ((value, None),)):
                out.append(Token(len(out), part, at, at + len(part), lang, kind, boundary if k == 0 else "none", pos, spans[at : at + len(part)]))
                at += len(part)
        return out

    def english_tags(self, text: str) -> dict[int, str]:
        """Tags of the English words of a normalized text, by the number of their token in scan()."""
        s = scan.scan(pa.array([text]))
        rows = zip(s.texts().to_pylist(), scan.LANGUAGES.take(pa.array(s.kind)).to_pylist())
        return self.english.tags(Request([Token(k, t, 0, 0, lang, "", "none", None, ()) for k, (t, lang) in enumerate(rows)], "en"))

    # Readings.

    def predict(self, tokens: list[Token], tag: str | None = None) -> tuple[dict[int, list[Unit]], dict[int, str]]:
        """(units, names of backends) by token; tag: of a single English word that is read by itself."""
        units, names = {}, {}
        for backend, language in ((self.han, "zh"), (self.english, "en")):
            request = Request(tokens, language, self.o.mode if language == "zh" else None)
            if not request.targets:
                continue
            answer = backends.ask(backend, request) if tag is None else backend.tagged(request.targets[0], tag)
            validation.check_prediction(backend, request, answer)
            units |= answer
            names |= dict.fromkeys(answer, backend.name)
        return units, names

    def apply_sandhi(self, tokens: list[Token], units: dict[int, list[Unit]]) -> dict[int, list[Unit]]:
        """Units with the tones of connected speech; unknown ones stay as they are."""
        out = dict(units)
        runs = [list(run) for han, run in itertools.groupby(tokens, lambda t: t.language == "zh" and t.id in units) if han]
        new = self.sandhi.tones([[(t.text, [u.tone or "" for u in units[t.id]], t.pos or "") for t in run] for run in runs])
        for run, tones in zip(runs, new):
            rest = iter(tones)
            for token in run:
                out[token.id] = [u if u.is_unknown or tone == u.tone else with_tone(u, tone) for u, tone in zip(units[token.id], rest)]
        return out

    def process(self, tokens: list[Token], units: dict[int, list[Unit]]) -> dict[int, list[Unit]]:
        steps = [self.apply_sandhi] if self.o.mode == "mandarin" and self.o.tone_sandhi and any(t.language == "zh" for t in tokens) else []
        for step in [*steps, *self.o.processors]:
            before = validation.identity(units)
            units = step(tokens, units)
            validation.check_identity(getattr(step, "__name__", "processor"), before, units)
            for token in tokens:
                for unit in units.get(token.id, ()) if token.language == "zh" else ():
                    validation.check_unit(unit)
        return units

    # Transcription and rendering.

    @staticmethod
    def to_ipa(unit: Unit) -> Unit:
        if unit.alphabet == "ipa":
            return unit
        source = {"alphabet": "ipa", "source_alphabet": unit.alphabet, "source_phones": list(unit.phones)}
        if unit.is_unknown:
            return replace(unit, **source)
        if unit.alphabet == "arpabet":
            marks, out, stress = dict(unit.stress), [], []
            for i, base in enumerate(unit.phones):
                if i in marks:
                    stress.append((len(out), marks[i]))
                whole = P.EN_UNSTRESSED.get(base) if marks.get(i) == 0 else None
                segments = whole or P.EN_VOWELS.get(base) or P.EN_CONSONANTS.get(base)
                if segments is None:
                    raise TranscriptionError(f"no IPA for {base!r}")
                out += segments.split()
            return replace(unit, phones=out, stress=stress, **source)
        if unit.tone is None:
            raise TranscriptionError(f"{unit.text!r} has no tone")
        if unit.alphabet == "pinyin":
            initial, final, tone = P.split_pinyin(unit.native, True)
            whole = P.CMN_WHOLE.get(initial + final)
            apical = P.CMN_APICAL.get(initial) if final == "i" else None
            return replace(unit, phones=(whole or f"{P.CMN_INITIALS[initial]} {apical or P.CMN_FINALS[final]}").split(), contour=P.CMN_TONES[tone], **source)
        onset, final, tone = P.split_jyutping(unit.native)
        nucleus, coda = re.match(P.JYUTPING_FINAL_PATTERN, final).groups()
        key = f"{nucleus}+{coda}"
        phones = f"{P.YUE_ONSETS[onset]} {P.YUE_NUCLEUS_OVERRIDES.get(key, P.YUE_NUCLEI[nucleus])} {P.YUE_CODA_OVERRIDES.get(key, P.YUE_CODAS[coda])}".split()
        return replace(unit, phones=phones, contour=P.YUE_TONES[tone], **source)

    @staticmethod
    def render(unit: Unit) -> list[str]:
        marks = dict(unit.stress)
        if unit.alphabet == "ipa":
            out = [{1: "ˈ", 2: "ˌ"}.get(marks.get(i), "") + p for i, p in enumerate(unit.phones)]
            tail = "".join(P.TONE_LETTERS[d] for d in unit.contour)
        else:
            out = [p + str(marks.get(i, "")) for i, p in enumerate(unit.phones)]
            tail = unit.tone or ""
        return [*out[:-1], out[-1] + tail] if out else out

    def say(self, unit: Unit) -> list[str]:
        """render(), once for each reading."""
        key = unit.alphabet, unit.native, unit.tone, unit.source_alphabet
        got = self.spoken.get(key) if unit.native else None
        if got is None:
            got = self.render(unit)
            if unit.native and len(self.spoken) < 200_000:
                self.spoken[key] = got
        return got

    def result(self, text: str | None) -> Result:
        """The result of one utterance; null is an error, as any value that is no text."""
        out = Result(text, self.o.output)
        try:
            if not isinstance(text, str):
                raise TypeError("text must be a string")
            out.normalized, spans = self.normalize(text)
            tokens = self.tokens(out.normalized, spans)
            units, names = self.predict(tokens)
            units = self.process(tokens, units)
            warnings = []
            for token in tokens:
                for unit in units.get(token.id, ()):
                    if unit.is_unknown:
                        a, b = unit.spans[0][0], unit.spans[-1][1]
                        warnings.append(f"{names[token.id]}: no reading for {unit.text!r} from {text[a:b]!r} at {a}-{b}")
            if self.o.output == "ipa":
                units = {i: [self.to_ipa(u) for u in us] for i, us in units.items()}
            out.rendered = {i: [self.say(u) for u in us] for i, us in units.items()}
            out.tokens, out.units, out.backends, out.warnings = tokens, units, names, warnings
        except Exception as e:  # any row's failure is that row's data
            out.error = f"{type(e).__name__}: {e}"
        return out

    def convert(self, text: str | None) -> dict:
        """result() as the plain values of a row."""
        r = self.result(text)
        span = lambda s: [{"start": a, "end": b} for a, b in s]
        unit = lambda u, said: {
            "text": u.text, "source_spans": span(u.spans), "phones": u.phones, "rendered": said, "alphabet": u.alphabet, "native": u.native, "tone": u.tone, "contour": u.contour,
            "stress": [{"index": i, "stress": s} for i, s in u.stress], "is_unknown": u.is_unknown, "source_alphabet": u.source_alphabet, "source_phones": list(u.source_phones),
        }
        tokens = [
            {
                "id": t.id, "text": t.text, "start": t.start, "end": t.end, "language": t.language, "kind": t.kind, "boundary": t.boundary, "pos": t.pos,
                "units": [unit(u, s) for u, s in zip(r.units.get(t.id, ()), r.rendered.get(t.id, ()))], "backend": r.backends.get(t.id), "source_spans": span(t.spans),
            }
            for t in r.tokens
        ]
        return {"original": text, "normalized": r.normalized, "output": r.output, "tokens": tokens, "phones": r.phones, "base_phones": r.base_phones, "warnings": r.warnings, "error": r.error}


def with_tone(unit: Unit, tone: str) -> Unit:
    return replace(unit, tone=tone, native=unit.native[:-1] + tone)
