"""Written forms spelled out: numbers, signs, percentages, decimals, dates, telephone numbers and units, in Chinese or English."""

from __future__ import annotations

import re

from phonoweave.functions import scripts
from phonoweave.functions.text import realign

_DIGITS = "零一二三四五六七八九"
_ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = "_ _ twenty thirty forty fifty sixty seventy eighty ninety".split()
_NAMES = "thousand million billion trillion quadrillion quintillion sextillion septillion octillion nonillion decillion".split()
_SCALES = [(1000 ** (k + 1), name) for k, name in enumerate(_NAMES)][::-1]
#: Zeros of the largest name.
_LARGEST = 3 * len(_NAMES)
#: Units: Chinese, English.
UNITS = {"km": ("千米", "kilometers"), "cm": ("厘米", "centimeters"), "mm": ("毫米", "millimeters"), "µm": ("微米", "micrometers"), "μm": ("微米", "micrometers"), "kg": ("千克", "kilograms"), "m": ("米", "meters"), "g": ("克", "grams")}


def chinese(n: int) -> str:
    if n < 0:
        return "负" + chinese(-n)
    if n < 10:
        return _DIGITS[n]
    for unit, name in ((10**8, "亿"), (10**4, "万")):
        if n >= unit:
            high, low = divmod(n, unit)
            return chinese(high) + name + (("零" if low < unit // 10 else "") + ("一" if 10 <= low < 20 else "") + chinese(low) if low else "")
    for unit, name in ((1000, "千"), (100, "百"), (10, "十")):
        if n >= unit:
            high, low = divmod(n, unit)
            tail = ("零" if low < unit // 10 else "") + (chinese(low) if not (unit > 10 and 10 <= low < 20) else "一" + chinese(low)) if low else ""
            return ("" if unit == 10 and high == 1 else _DIGITS[high]) + name + tail
    return _DIGITS[n]


def english(n: int) -> str:
    if n < 0:
        return "negative " + english(-n)
    if n < 20:
        return _ONES[n]
    if n < 100:
        return _TENS[n // 10] + (" " + _ONES[n % 10] if n % 10 else "")
    if n < 1000:
        return _ONES[n // 100] + " hundred" + (" and " + english(n % 100) if n % 100 else "")
    for unit, name in _SCALES:
        if n >= unit:
            low = n % unit
            return english(n // unit) + " " + name + ((" and " if low < 100 else " ") + english(low) if low else "")
    return _ONES[n]


def digits(value: str, telephone: bool = False) -> str:
    return "".join("幺" if telephone and d == "1" else _DIGITS[int(d)] for d in value)


def whole(value: str, lang: str) -> str:
    """A whole number of any length, group by group: 亿 of 亿 in Chinese, the largest name of the other names in English."""
    size, one, name = (8, chinese, "亿") if lang == "zh" else (_LARGEST, english, f" {_SCALES[0][1]}")
    value = value.lstrip("0") or "0"
    cut = len(value) % size or size
    out = one(int(value[:cut]))
    for at in range(cut, len(value), size):
        low = int(value[at : at + size])
        out += name
        if low and lang == "zh":
            out += ("零" if low < 10**7 else "") + ("一" if 10 <= low < 20 else "") + chinese(low)
        elif low:
            out += (" and " if low < 100 else " ") + english(low)
    return out


_MONTHS = "January February March April May June July August September October November December".split()
_ORDINALS = {"one": "first", "two": "second", "three": "third", "five": "fifth", "eight": "eighth", "nine": "ninth", "twelve": "twelfth"}


def ordinal(n: int) -> str:
    *head, last = english(n).split(" ")
    return " ".join([*head, _ORDINALS.get(last) or (last[:-1] + "ieth" if last.endswith("y") else last + "th")])


def year(n: int) -> str:
    """A year of four digits in English."""
    high, low = divmod(n, 100)
    if high % 10 == 0 and low < 10 or high == 0:
        return english(n)
    return english(high) + (" hundred" if low == 0 else f" oh {_ONES[low]}" if low < 10 else f" {english(low)}")


def clock(parts: list[int], lang: str) -> str:
    """A time of day: hours, minutes and maybe seconds."""
    if lang == "zh":
        out = chinese(parts[0]) + "点"
        for value, name in zip(parts[1:], "分秒"):
            out += ("零" if 0 < value < 10 else "") + chinese(value) + name
        return out if any(parts[1:]) else chinese(parts[0]) + "点整"
    if not any(parts[1:]):
        return english(parts[0]) + " o'clock"
    return " ".join([english(parts[0]), *(f"oh {_ONES[v]}" if v < 10 else english(v) for v in parts[1:])])


_NUMBER = r"(?:\d{1,3}(?:,\d{3})+(?![,\d])|\d+)(?:\.\d+)?"
_WRITTEN = re.compile(
    rf"(?P<date>(?P<y>\d{{4}})(?:年(?P<mo>\d{{1,2}})月(?:(?P<d>\d{{1,2}})日)?|[-/](?P<mo2>\d{{1,2}})[-/](?P<d2>\d{{1,2}}))|\d{{4}}年)"
    rf"|(?<![\d:])(?P<time>(?:[01]?\d|2[0-4]):[0-5]\d(?::[0-5]\d)?)(?![\d:])"
    rf"|(?P<tel>(?<!\d)1\d{{10}}(?!\d))|(?P<neg>(?<![\w\d])-)?(?P<num>{_NUMBER})(?P<pct>%)?(?P<unit>(?:{'|'.join(sorted(UNITS, key=len, reverse=True))})(?![a-zA-Z]))?",
    re.A,
)


_HAN = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in scripts.HAN_RANGES) + "]")


def language_of(text: str) -> str:
    """Chinese with any Han character and for bare numbers, English otherwise."""
    if _HAN.search(text):
        return "zh"
    return "zh" if re.fullmatch(rf"\s*{_NUMBER}(?:{'|'.join(UNITS)})?\s*", text) and "%" not in text else "en"


def _spell(found: re.Match, lang: str) -> str:
    zh = lang == "zh"
    if found["date"]:
        month, day = found["mo"] or found["mo2"], found["d"] or found["d2"]
        if not zh and month and 1 <= int(month) <= 12 and 1 <= int(day or 1) <= 31:
            return " ".join([_MONTHS[int(month) - 1], *([ordinal(int(day))] if day else []), year(int(found["y"]))])
        return digits(found[0][:4]) + "年" + (chinese(int(month)) + "月" if month else "") + (chinese(int(day)) + "日" if day else "")
    if found["tel"]:
        return digits(found["tel"], True) if zh else " ".join(_ONES[int(d)] for d in found["tel"])
    if found["time"]:
        return clock([int(x) for x in found["time"].split(":")], lang)
    number, _, part = found["num"].replace(",", "").partition(".")
    out = whole(number, lang)
    if part:
        out += "点" + digits(part) if zh else " point " + " ".join(_ONES[int(d)] for d in part)
    if found["pct"]:
        out = "百分之" + out if zh else out + " percent"
    if found["neg"]:
        out = "负" + out if zh else "negative " + out
    if found["unit"]:
        out += UNITS[found["unit"]][0] if zh else " " + UNITS[found["unit"]][1]
    return out


def spell_out(text: str, spans: list[tuple[int, int]]) -> tuple[str, list[tuple[int, int]]]:
    """The text with written forms spelled out; each replaced stretch is aligned by itself."""
    lang, out, sources, at = language_of(text), [], [], 0
    for found in _WRITTEN.finditer(text):
        a, b = found.span()
        new = _spell(found, lang)
        out += [text[at:a], new]
        sources += spans[at:a] + realign(text[a:b], new, spans[a:b])
        at = b
    return "".join(out) + text[at:], sources + spans[at:]


def spelled(text: str) -> str:
    """The text of spell_out() alone."""
    if not _DIGIT.search(text):
        return text
    lang = language_of(text)
    return _WRITTEN.sub(lambda found: _spell(found, lang), text)


_DIGIT = re.compile("[0-9]")
