"""Checks of what backends and processors give: coverage, alignment, structure and agreement of units."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import lru_cache

from phonoweave.functions import phonetics as P
from phonoweave.operators.backends import Backend, Request, Token, Unit
from phonoweave.operators.errors import AlignmentError


def check_prediction(backend: Backend, request: Request, answer: Mapping[int, list[Unit]]) -> None:
    """An answer has units for each target and for nothing else, of the backend's alphabet, aligned with the token."""
    if not isinstance(answer, Mapping):
        raise AlignmentError(f"{backend.name}: a mapping is wanted, not {type(answer).__name__}")
    wanted = {t.id: t for t in request.targets}
    missing, extra = [i for i in wanted if i not in answer], [i for i in answer if i not in wanted]
    if missing or extra:
        raise AlignmentError(f"{backend.name}: missing tokens {missing}, extra tokens {extra}")
    for i, token in wanted.items():
        units = answer[i]
        if not isinstance(units, Sequence) or not units or not all(isinstance(u, Unit) for u in units):
            raise AlignmentError(f"{backend.name}: units are wanted for {token.text!r}")
        for unit in units:
            if unit.alphabet != backend.traits.alphabet:
                raise AlignmentError(f"{backend.name}: {unit.alphabet!r} where {backend.traits.alphabet!r} is wanted")
            check_unit(unit)
        check_alignment(backend.name, token, units)


def check_alignment(name: str, token: Token, units: Sequence[Unit]) -> None:
    """Units take the token's characters from left to right; only further Jyutping syllables of a character may share its place."""
    at = 0
    for k, unit in enumerate(units):
        shared = k > 0 and unit.alphabet == "jyutping" and len(unit.text) == 1 and list(unit.spans) == list(units[k - 1].spans) and unit.text == units[k - 1].text
        fresh = token.text[at : at + len(unit.text)] == unit.text and list(token.spans[at : at + len(unit.text)]) == list(unit.spans)
        if fresh and not (shared and at >= len(token.text)):
            at += len(unit.text)
        elif shared:
            if unit.native == units[k - 1].native:
                raise AlignmentError(f"{name}: {unit.text!r} of {token.text!r} is there twice")
        else:
            raise AlignmentError(f"{name}: {unit.text!r} does not lie at place {at} of {token.text!r}")
    if at != len(token.text):
        raise AlignmentError(f"{name}: units do not cover {token.text!r}")


def check_unit(unit: Unit) -> None:
    """A unit's own structure, and that its native form and its phones agree."""
    if not unit.text or len(unit.text) != len(unit.spans):
        raise AlignmentError(f"a span is wanted for each character of {unit.text!r}")
    if unit.is_unknown:
        if unit.phones or unit.native or unit.tone or unit.stress or unit.contour:
            raise AlignmentError(f"the unknown unit {unit.text!r} has phonetic data")
        return
    problem = _problem(unit.alphabet, tuple(unit.phones), unit.native, unit.tone, tuple(map(tuple, unit.stress)), unit.contour)
    if problem:
        raise AlignmentError(f"unit {unit.text!r}: {problem}")


@lru_cache(200_000)
def _problem(alphabet: str, phones: tuple, native: str, tone: str | None, stress: tuple, contour: str) -> str | None:
    places = [i for i, _ in stress]
    if not phones or not all(isinstance(p, str) and p for p in phones):
        return "no phones"
    if set(contour) - set("12345"):
        return f"tone contour {contour!r}"
    if places != sorted(set(places)) or any(not 0 <= i < len(phones) for i in places) or any(s not in (0, 1, 2) for _, s in stress):
        return f"stress {stress!r}"
    if alphabet == "arpabet":
        marks = dict(stress)
        if tone is not None or any(p[-1].isdigit() for p in phones):
            return "a tone or a digit in English phones"
        if native != " ".join(p + str(marks.get(i, "")) for i, p in enumerate(phones)):
            return f"{native!r} does not have these phones"
    elif alphabet in ("pinyin", "jyutping"):
        try:
            *parts, digit = P.split_pinyin(native, True) if alphabet == "pinyin" else P.split_jyutping(native)
        except ValueError as e:
            return str(e)
        if [p for p in parts if p] != list(phones) or digit != tone or stress:
            return f"{native!r} does not have these phones and this tone"
    return None


def identity(units: Mapping[int, Sequence[Unit]]) -> dict[int, list[tuple]]:
    """What a processor must leave as it is."""
    return {i: [(u.text, tuple(u.spans), u.alphabet, u.is_unknown) for u in us] for i, us in units.items()}


def check_identity(name: str, before: dict[int, list[tuple]], after: Mapping[int, Sequence[Unit]]) -> None:
    if identity(after) != before:
        raise AlignmentError(f"{name} changed which units there are")
