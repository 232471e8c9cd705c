"""Phonetic inventories as small constant tables, and the scalar functions over them."""

from __future__ import annotations

import re
from collections.abc import Container
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phonoweave.functions.columns import let, look_up

# Which finals each spelled Mandarin initial takes (the syllable chart), and syllables without such a split.
PINYIN_CHART = {
    "": "a ai an ang ao e ei en eng er o ou ê",
    "b": "a ai an ang ao ei en eng i ian iang iao ie in ing o ong u",
    "p": "a ai an ang ao ei en eng i ian iao ie in ing o ou u",
    "m": "a ai an ang ao e ei en eng i ian iao ie in ing iu o ou u",
    "f": "a an ang ei en eng iao o ou u",
    "d": "a ai an ang ao e ei en eng i ia ian iao ie in ing iu ong ou u uan ui un uo",
    "t": "a ai an ang ao e ei eng i ian iao ie ing ong ou u uan ui un uo",
    "n": "a ai an ang ao e ei en eng i ia ian iang iao ie in ing iu ong ou u uan un uo v ve",
    "l": "a ai an ang ao e ei en eng i ia ian iang iao ie in ing iu o ong ou u uan un uo v ve",
    "g": "a ai an ang ao e ei en eng ong ou u ua uai uan uang ui un uo",
    "k": "a ai an ang ao e ei en eng ong ou u ua uai uan uang ui un uo",
    "h": "a ai an ang ao e ei en eng ong ou u ua uai uan uang ui un uo",
    "j": "i ia ian iang iao ie in ing iong iu u uan ue un",
    "q": "i ia ian iang iao ie in ing iong iu u uan ue un",
    "x": "i ia ian iang iao ie in ing iong iu u uan ue un",
    "zh": "a ai an ang ao e ei en eng i ong ou u ua uai uan uang ui un uo",
    "ch": "a ai an ang ao e en eng i ong ou u ua uai uan uang ui un uo",
    "sh": "a ai an ang ao e ei en eng i ou u ua uai uan uang ui un uo",
    "r": "an ang ao e en eng i ong ou u ua uan ui un uo",
    "z": "a ai an ang ao e ei en eng i ong ou u uan ui un uo",
    "c": "a ai an ang ao e ei en eng i ong ou u uan ui un uo",
    "s": "a ai an ang ao e en eng i ong ou u uan ui un uo",
    "y": "a an ang ao e i in ing o ong ou u uan ue un",
    "w": "a ai an ang ei en eng o ong u",
}
PINYIN_SPECIAL = ["m", "n", "ng", "hm", "hng"]
#: Strict finals of syllables spelled with y and w, and of contracted and umlaut spellings.
Y_FINALS = {"a": "ia", "an": "ian", "ang": "iang", "ao": "iao", "e": "ie", "i": "i", "in": "in", "ing": "ing", "o": "io", "ong": "iong", "ou": "iou", "u": "v", "uan": "van", "ue": "ve", "un": "vn"}
W_FINALS = {"a": "ua", "ai": "uai", "an": "uan", "ang": "uang", "ei": "uei", "en": "uen", "eng": "ueng", "o": "uo", "u": "u"}
CONTRACTED = {"iu": "iou", "ui": "uei", "un": "uen"}
UMLAUT = {"u": "v", "uan": "van", "ue": "ve", "un": "vn"}

# Jyutping onsets, finals, nuclei and codas.
JYUTPING_ONSETS = ["", "b", "c", "d", "f", "g", "gw", "h", "j", "k", "kw", "l", "m", "n", "ng", "p", "s", "t", "w", "z"]
JYUTPING_FINALS = (
    "a aa aai aak aam aan aang aap aat aau ai ak am an ang ap at au e ei ek em en eng eoi eon eot ep et eu i ik im in ing ip it iu "
    "m ng o oe oek oeng oet oi ok on ong ot ou u ui uk um un ung up ut yu yun yut"
).split()
JYUTPING_NUCLEI = ["a", "aa", "e", "eo", "i", "m", "ng", "o", "oe", "u", "yu"]
JYUTPING_CODAS = ["", "i", "k", "m", "n", "ng", "p", "t", "u"]

# IPA of Mandarin, Cantonese and English phones, and tone contours.
CMN_INITIALS = {
    "": "", "b": "p", "c": "t͡sʰ", "ch": "ʈ͡ʂʰ", "d": "t", "f": "f", "g": "k", "h": "x", "j": "t͡ɕ", "k": "kʰ", "l": "l", "m": "m", "n": "n", "p": "pʰ",
    "q": "t͡ɕʰ", "r": "ɻ", "s": "s", "sh": "ʂ", "t": "tʰ", "w": "w", "x": "ɕ", "y": "j", "z": "t͡s", "zh": "ʈ͡ʂ",
}
CMN_FINALS = {
    "a": "a", "ai": "a i", "an": "a n", "ang": "ɑ ŋ", "ao": "a ʊ", "e": "ɤ", "ei": "e i", "en": "ə n", "eng": "ɤ ŋ", "i": "i", "ia": "j a",
    "ian": "j ɛ n", "iang": "j ɑ ŋ", "iao": "j a ʊ", "ie": "j ɛ", "in": "i n", "ing": "i ŋ", "iong": "j ʊ ŋ", "iou": "j o ʊ", "iu": "j o ʊ",
    "o": "w o", "ong": "ʊ ŋ", "ou": "o ʊ", "u": "u", "ua": "w a", "uai": "w a i", "uan": "w a n", "uang": "w ɑ ŋ", "uei": "w e i",
    "uen": "w ə n", "ueng": "w ɤ ŋ", "ui": "w e i", "un": "w ə n", "uo": "w o", "v": "y", "van": "ɥ ɛ n", "ve": "ɥ ɛ", "vn": "y n",
}
CMN_WHOLE = {"er": "ɚ", "io": "j ɔ", "o": "ɔ", "ê": "ɛ", "hm": "h m̩", "hng": "h ŋ̍", "m": "m̩", "n": "n̩", "ng": "ŋ̍"}
CMN_APICAL = {"z": "ɹ̩", "c": "ɹ̩", "s": "ɹ̩", "zh": "ɻ̩", "ch": "ɻ̩", "sh": "ɻ̩", "r": "ɻ̩"}
CMN_TONES = {"1": "55", "2": "35", "3": "214", "4": "51", "5": ""}
YUE_ONSETS = {
    "": "", "b": "p", "c": "t͡sʰ", "d": "t", "f": "f", "g": "k", "gw": "kʷ", "h": "h", "j": "j", "k": "kʰ", "kw": "kʷʰ", "l": "l", "m": "m", "n": "n",
    "ng": "ŋ", "p": "pʰ", "s": "s", "t": "tʰ", "w": "w", "z": "t͡s",
}
YUE_NUCLEI = {"a": "ɐ", "aa": "aː", "e": "ɛ", "eo": "ɵ", "i": "i", "m": "m̩", "n": "n̩", "ng": "ŋ̍", "o": "ɔ", "oe": "œ", "u": "u", "yu": "y"}
YUE_CODAS = {"": "", "i": "i", "k": "k̚", "m": "m", "n": "n", "ng": "ŋ", "p": "p̚", "t": "t̚", "u": "u"}
YUE_NUCLEUS_OVERRIDES = {"e+i": "e", "i+k": "ɪ", "i+ng": "ɪ", "o+u": "o", "u+k": "ʊ", "u+ng": "ʊ"}
YUE_CODA_OVERRIDES = {"eo+i": "y", "o+i": "y", "u+i": "y"}
YUE_TONES = {"1": "55", "2": "25", "3": "33", "4": "21", "5": "23", "6": "22"}
EN_CONSONANTS = {
    "B": "b", "CH": "t͡ʃ", "D": "d", "DH": "ð", "F": "f", "G": "ɡ", "HH": "h", "JH": "d͡ʒ", "K": "k", "L": "l", "M": "m", "N": "n", "NG": "ŋ", "P": "p",
    "R": "ɹ", "S": "s", "SH": "ʃ", "T": "t", "TH": "θ", "V": "v", "W": "w", "Y": "j", "Z": "z", "ZH": "ʒ",
}
EN_VOWELS = {
    "AA": "ɑ", "AE": "æ", "AH": "ʌ", "AO": "ɔ", "AW": "a ʊ", "AY": "a ɪ", "EH": "ɛ", "ER": "ɝ", "EY": "e ɪ", "IH": "ɪ", "IY": "i", "OW": "o ʊ",
    "OY": "ɔ ɪ", "UH": "ʊ", "UW": "u",
}
EN_UNSTRESSED = {"AH": "ə", "ER": "ɚ"}
TONE_LETTERS = {"1": "˩", "2": "˨", "3": "˧", "4": "˦", "5": "˥"}


@cache
def pinyin_table() -> dict[str, tuple[str, str, str, str]]:
    """Syllable body: loose initial and final, strict initial and final. A strict final of '' has none."""
    found = {}
    for initial, finals in PINYIN_CHART.items():
        for final in finals.split():
            if initial == "y":
                strict = ("", Y_FINALS[final])
            elif initial == "w":
                strict = ("", W_FINALS.get(final, ""))
            elif initial in ("j", "q", "x"):
                strict = (initial, UMLAUT.get(final, CONTRACTED.get(final, final)))
            else:
                strict = (initial, CONTRACTED.get(final, final))
            found[initial + final] = (initial, final, *strict)
    for body in PINYIN_SPECIAL:
        found[body] = ("", body, "", body)
    return found


def canonical_pinyin() -> dict[tuple[str, str], tuple[str, str]]:
    """Loose and strict phones of every syllable to the strict ones."""
    out = {}
    for loose_i, loose_f, i, f in pinyin_table().values():
        if f:
            out[i, f] = out[loose_i, loose_f] = (i, f)
    return out


def pinyin_rows(spark: SparkSession) -> DataFrame:
    rows = [(body, *v) for body, v in pinyin_table().items()]
    return spark.createDataFrame(rows, "body string, loose_initial string, loose_final string, initial string, final string")


def split_pinyin(value: str, strict: bool = False) -> tuple[str, str, str]:
    """Initial, final and tone of a numbered syllable; ValueError if it is none."""
    body, tone = value[:-1], value[-1:]
    got = pinyin_table().get(body)
    if got is None or tone not in CMN_TONES or strict and not got[3]:
        raise ValueError(f"Invalid numbered pinyin syllable: {value!r}")
    return (*(got[2:] if strict else got[:2]), tone)


#: Onset, then final, longest onset first; a body that is a final alone has the empty onset.
JYUTPING_PATTERN = rf"^({'|'.join(sorted(JYUTPING_ONSETS[1:], key=lambda o: (-len(o), o)))}|)({'|'.join(sorted(JYUTPING_FINALS, key=lambda f: (-len(f), f)))})([1-6])$"
JYUTPING_FINAL_PATTERN = rf"^({'|'.join(sorted(JYUTPING_NUCLEI, key=lambda o: (-len(o), o)))})({'|'.join(sorted(JYUTPING_CODAS[1:], key=lambda f: (-len(f), f)))}|)$"


def split_jyutping(value: str, attested: Container[str] | None = None) -> tuple[str, str, str]:
    """Onset, final and tone; ValueError if the value has no such parts, or if its body is not among the attested ones."""
    found = re.match(JYUTPING_PATTERN, value)
    if not found or attested is not None and value[:-1] not in attested:
        raise ValueError(f"Invalid Jyutping syllable: {value!r}")
    return found.groups()


def split_jyutping_column(value: Column) -> Column:
    """(onset, final, tone), null if the value has no such parts."""
    part = lambda k: F.regexp_extract(value, JYUTPING_PATTERN, k)
    return F.when(value.rlike(JYUTPING_PATTERN), F.struct(part(1).alias("onset"), part(2).alias("final"), part(3).alias("tone")))


def split_final_column(final: Column) -> Column:
    part = lambda k: F.regexp_extract(final, JYUTPING_FINAL_PATTERN, k)
    return F.when(final.isin(*JYUTPING_FINALS), F.struct(part(1).alias("nucleus"), part(2).alias("coda")))


def join_segments(*parts: Column) -> Column:
    """Parts with a blank between those that are not empty."""
    return F.array_join(F.filter(F.array(*parts), lambda p: p != ""), " ")


def pinyin_ipa(initial: Column, final: Column) -> Column:
    """IPA segments, blank between them; null for phones outside the tables."""
    apical = F.when(final == "i", look_up(CMN_APICAL, initial))
    return F.coalesce(look_up(CMN_WHOLE, F.concat(initial, final)), join_segments(look_up(CMN_INITIALS, initial), F.coalesce(apical, look_up(CMN_FINALS, final))))


def jyutping_ipa(onset: Column, final: Column) -> Column:
    def of(parts: Column) -> Column:
        key = F.concat(parts["nucleus"], F.lit("+"), parts["coda"])
        nucleus = F.coalesce(look_up(YUE_NUCLEUS_OVERRIDES, key), look_up(YUE_NUCLEI, parts["nucleus"]))
        coda = F.coalesce(look_up(YUE_CODA_OVERRIDES, key), look_up(YUE_CODAS, parts["coda"]))
        return join_segments(look_up(YUE_ONSETS, onset), nucleus, coda)

    return let(split_final_column(final), of)


ARPABET_PATTERN = rf"^(?:({'|'.join(sorted(EN_VOWELS))})([0-2])?|({'|'.join(sorted(EN_CONSONANTS, key=lambda c: (-len(c), c)))}))$"


def split_arpabet(phone: Column) -> Column:
    """(base, stress); stress null without a digit; null for what is no ARPABET phone or a consonant with stress."""
    part = lambda k: F.regexp_extract(phone, ARPABET_PATTERN, k)
    base = F.concat(part(1), part(3))
    return F.when(phone.rlike(ARPABET_PATTERN), F.struct(base.alias("base"), F.try_to_number(F.nullif(part(2), F.lit("")), F.lit("9")).cast("int").alias("stress")))


def arpabet_ipa(base: Column, stress: Column) -> Column:
    return F.coalesce(F.when(stress == 0, look_up(EN_UNSTRESSED, base)), look_up({**EN_VOWELS, **EN_CONSONANTS}, base))


def tone_contour(profile: str, tone: Column) -> Column:
    """Contour digits, '' for the neutral tone."""
    return look_up({"cmn": CMN_TONES, "yue": YUE_TONES}[profile], tone)


def tone_letters(contour: Column) -> Column:
    return F.translate(contour, "".join(TONE_LETTERS), "".join(TONE_LETTERS.values()))


def with_tone(native: Column, tone: Column) -> Column:
    """The syllable with another tone digit."""
    return F.when(native.rlike("[0-9]$"), F.concat(F.regexp_replace(native, "[0-9]$", ""), tone)).otherwise(native)


def letters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def is_unpronounced(syllable: Column, char: Column) -> Column:
    """A dictionary's way to say that it has no reading: the character itself, maybe with a tone."""
    return F.regexp_replace(syllable, "[1-5]+$", "") == char
