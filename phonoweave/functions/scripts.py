"""Character classes and the token pattern, as regular expressions that Java, RE2 and Python read alike."""

from __future__ import annotations

# Code point ranges of Han ideographs, of Unicode 17 Script=Latin, and of combining marks that may follow Latin.
HAN_RANGES = [
    (0x3007, 0x3007), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFA6D), (0xFA70, 0xFAD9), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F),
    (0x2B740, 0x2B81D), (0x2B820, 0x2CEAD), (0x2CEB0, 0x2EBE0), (0x2EBF0, 0x2EE5D), (0x2F800, 0x2FA1D), (0x30000, 0x3134A),
    (0x31350, 0x323AF), (0x323B0, 0x33479),
]
LATIN_RANGES = [
    (0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x2B8), (0x2E0, 0x2E4), (0x1D00, 0x1D25),
    (0x1D2C, 0x1D5C), (0x1D62, 0x1D65), (0x1D6B, 0x1D77), (0x1D79, 0x1DBE), (0x1E00, 0x1EFF), (0x2071, 0x2071), (0x207F, 0x207F),
    (0x2090, 0x209C), (0x212A, 0x212B), (0x2132, 0x2132), (0x214E, 0x214E), (0x2160, 0x2188), (0x2C60, 0x2C7F), (0xA722, 0xA787),
    (0xA78B, 0xA7DC), (0xA7F1, 0xA7FF), (0xAB30, 0xAB5A), (0xAB5C, 0xAB64), (0xAB66, 0xAB69), (0xFB00, 0xFB06), (0xFF21, 0xFF3A),
    (0xFF41, 0xFF5A), (0x10780, 0x10785), (0x10787, 0x107B0), (0x107B2, 0x107BA), (0x1DF00, 0x1DF1E), (0x1DF25, 0x1DF2A),
]
MARK_RANGES = [(0x300, 0x36F), (0x1AB0, 0x1AFF), (0x1DC0, 0x1DFF), (0x20D0, 0x20FF), (0xFE20, 0xFE2F)]
SPACE_RANGES = [(0x9, 0xD), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]


def in_ranges(char: str, ranges: list[tuple[int, int]]) -> bool:
    return len(char) == 1 and any(a <= ord(char) <= b for a, b in ranges)


def is_han(char: str) -> bool:
    return in_ranges(char, HAN_RANGES)


def is_latin(char: str) -> bool:
    return in_ranges(char, LATIN_RANGES)


def is_mark(char: str) -> bool:
    return in_ranges(char, MARK_RANGES)


def character_class(ranges: list[tuple[int, int]]) -> str:
    """The inside of a bracket expression with escaped code points."""
    return "".join(rf"\x{{{a:X}}}" if a == b else rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in ranges)


HAN, LATIN, MARK, SPACE = (character_class(r) for r in (HAN_RANGES, LATIN_RANGES, MARK_RANGES, SPACE_RANGES))
_SEGMENT = rf"[{LATIN}][{LATIN}{MARK}]*"
#: Tokens without loss: blanks, Han, numbers, Latin words with inner apostrophes and hyphens, any other character.
TOKEN = rf"[{SPACE}]+|[{HAN}]+|\p{{Nd}}+(?:[.:/-]\p{{Nd}}+)*|{_SEGMENT}(?:['’-]{_SEGMENT})*|[^{SPACE}]"

SENTENCE_MARKS, PAUSE_MARKS = ".。!?！？", ",，、;；:："
PLACEHOLDERS = {"zh": "<ZH>", "en": "<EN>"}
