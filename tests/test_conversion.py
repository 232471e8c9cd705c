"""Conversion by distinct words against conversion utterance by utterance."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from phonoweave.operators import backends, numbers, spelling
from phonoweave.operators.backends import EnglishBackend
from phonoweave.operators.conversion import Reader, by_word
from phonoweave.operators.errors import BackendError
from phonoweave.operators.lattice import Lattice
from phonoweave.operators.utterance import Converter, Options
from phonoweave.plans import engine_queries
from phonoweave.plans.engine import Engine

BITS = "好 中 不 一 我们去 你好 很 银行 长大 the to refuse record iPhone don't café ß 3.5% 12:30 2024-01-02 ＡＢ① é́ é , 妈妈 乐亭 𠀀 hello-world x AI OS ZZTOP 's -12km １２ they 不不好 看一看".split() + [" ", ". ", "\n", "’"]
CHOICES = [
    {"unknown": "preserve"}, {}, {"unknown": "preserve", "output": "ipa"}, {"mode": "cantonese", "unknown": "preserve"}, {"mode": "cantonese", "output": "ipa", "unknown": "preserve"},
    {"unknown": "preserve", "spell_numbers": False, "tone_sandhi": False, "backend": "dictionary"}, {"traditional": True, "unknown": "preserve"},
    {"english_backend": EnglishBackend(sounds=lambda w: ["QQ"]), "unknown": "preserve"}, {"segmenter": list, "unknown": "preserve"}, {"segmenter": Lattice({"我们": 5, "好中": 3, "不不": 1, "一": 4}, {"一": {"m": 1}}), "unknown": "preserve"},
    {"mode": "cantonese", "unknown": "preserve", "simplified_to_traditional": {"长大": "長大", "银": "銀", "我们": "我們", "一不": "壹不"}},
]


def texts(seed, n=400):
    r = random.Random(seed)
    return ["".join(r.choice(BITS) for _ in range(r.randrange(14))) for _ in range(n)] + [None, "", " "]


@pytest.mark.parametrize("options", CHOICES)
def test_equals_one_by_one(options):
    o, given = Options(**options), texts(4)
    assert by_word(o)
    batch, one = Reader(Converter(o)).batch(pa.array(given, pa.string())), Converter(o)
    got = zip(batch.normalized().to_pylist(), batch.n_tokens().to_pylist(), batch.phones().to_pylist(), batch.n_phones().to_pylist(), batch.warnings().to_pylist(), batch.errors().to_pylist(), batch.lines().to_pylist())
    for text, row in zip(given, got):
        r = one.result(text)
        assert row == (r.normalized, len(r.tokens), " ".join(r.phones), len(r.phones), r.warnings, r.error, r.lines()), text


def test_whole_utterance_options_go_one_by_one():
    for options in ({"fallback": lambda w: ["ma1"]}, {"model": lambda s: s, "backend": "polyphone"}, {"normalizers": [lambda t: (t, [])]}, {"processors": [lambda t, u: u]}, {"phrases": {"a好": "x"}}):
        assert not by_word(Options(**options))


def test_each_word_is_read_once(monkeypatch):
    calls = []
    monkeypatch.setattr(EnglishBackend, "sound", lambda self, text, tag: calls.append(text) or ["AH0"])
    reader = Reader(Converter(Options()))
    for _ in range(2):
        reader.batch(pa.array(["one two one", "two two three"]))
    assert sorted(calls) == ["one", "three", "two"]


class Fickle:
    """A function of a word whose answers are of many kinds, some of them bad, and that notes what it is asked."""

    def __init__(self, seed, bad):
        self.r, self.bad, self.asked = random.Random(seed), bad, []

    def __call__(self, word):
        self.asked.append(word)
        kind = self.r.random()
        good = [self.r.choice(["hao3", "bu4", "ma1 ma5"]) for _ in word]
        if kind > self.bad:
            return good
        if kind < self.bad / 10:
            raise BackendError("down")
        if kind < self.bad / 5:
            raise ZeroDivisionError
        n = len(word)
        return self.r.choice([[None] * n, ["hao9"] * n, [""] * n, [1] * n, [True] * n, [["hao3"]] * n, good[1:], None, 7, iter(good), "x", (x for x in good if 1 / 0), ["r5"] * n])


@pytest.mark.parametrize("bad", [0, 0.02, 0.3])
@pytest.mark.parametrize("options", [{}, {"unknown": "preserve"}, {"output": "ipa"}, {"segmenter": Lattice({"我们": 5, "好中": 3, "不不": 1, "一": 4}, {"一": {"m": 1}})}, {"segmenter": lambda run: [(run[1:], None)] if "长" in run else [(run, None)]}])
def test_a_function_says_what_it_says_one_by_one(options, bad):
    """The same words are asked in the same order, and the same comes of the answers, right and wrong ones."""
    given, whole, single = texts(7), Fickle(1, bad), Fickle(1, bad)
    o = Options(backend=whole, **options)
    assert by_word(o)
    batch, one = Reader(Converter(o)).batch(pa.array(given, pa.string())), Converter(Options(backend=single, **options))
    got = zip(batch.normalized().to_pylist(), batch.n_tokens().to_pylist(), batch.phones().to_pylist(), batch.n_phones().to_pylist(), batch.warnings().to_pylist(), batch.errors().to_pylist(), batch.lines().to_pylist())
    for text, row in zip(given, got):
        r = one.result(text)
        assert row == (r.normalized, len(r.tokens), " ".join(r.phones), len(r.phones), r.warnings, r.error, r.lines()), text
    assert whole.asked == single.asked and whole.asked


def test_a_function_is_asked_for_each_word_and_each_answer_is_read_once(monkeypatch):
    asked, read, units = [], [], backends.syllable_units
    monkeypatch.setattr(backends, "syllable_units", lambda char, *a: read.append(char) or units(char, *a))
    reader = Reader(Converter(Options(backend=lambda w: asked.append(w) or ["hao3"] * len(w))))
    for _ in range(3):
        assert reader.batch(pa.array(["好 中 好", "中 中 好中"])).n_phones().to_pylist() == [6, 8]
    assert "".join(asked) == "好中好中中好中" * 3 and sorted(read) == sorted("好中好中")


def test_engine_columns(spark):
    given = texts(9, 60)
    df = spark.createDataFrame([(k, t) for k, t in enumerate(given)], "doc_id long, text string").repartition(3)
    engine, one = Engine(unknown="preserve"), Converter(Options(unknown="preserve"))
    want = {k: one.result(t) for k, t in enumerate(given)}
    for r in df.select("doc_id", engine.summary(F.col("text")).alias("s"), engine.lines(F.col("text")).alias("l")).collect():
        w = want[r.doc_id]
        assert (r.s.normalized, r.s.n_tokens, r.s.phones, r.s.n_phones, r.s.warnings, r.s.error, r.l) == (w.normalized, len(w.tokens), " ".join(w.phones), len(w.phones), w.warnings, w.error, w.lines())
    assert {r.doc_id: r.error for r in engine.failures(df).collect()} == {k: w.error for k, w in want.items() if w.error}
    slow = Engine(unknown="preserve", processors=[lambda tokens, units: units])
    assert not slow.by_word and sorted(slow.failures(df).collect()) == sorted(engine.failures(df).collect())


def test_convert_query(spark):
    """The registered query against the converter, text by text."""
    sf = "/root/testdata/sf0.001"
    one = Converter(Options(unknown="preserve"))
    rows = {r.doc_id: (r.n_tokens, r.n_phones, r.error) for r in engine_queries.convert(spark, sf).collect()}
    for r in engine_queries.mixed(spark, sf).collect():
        w = one.result(r.text)
        assert rows[r.doc_id] == (len(w.tokens), len(w.phones), w.error)


def test_numbers_of_any_length():
    assert numbers.whole("0000", "zh") == "零" and numbers.whole("100000000", "zh") == "一亿" and numbers.whole("10000000000000010", "zh") == "一亿亿零一十"
    assert numbers.whole("1000000000000000005", "en") == "one quintillion and five"
    assert numbers.whole("5" + "0" * 66, "en") == "five decillion decillion"
    for n in (7, 15, 100, 10_015, 123_456_789, 10**8 + 10, 10**15 - 1, 10**12 + 12):
        assert numbers.whole(str(n), "zh") == numbers.chinese(n) and numbers.whole(str(n), "en") == numbers.english(n)
    long = numbers.whole("9" * 9000, "zh")
    assert long.startswith("九千九百九十九亿" if 9000 % 8 == 4 else "九千九百九十九万九千九百九十九亿") and long.count("亿") == -(-9000 // 8) - 1


def test_known_words_of_any_length():
    long = "pneumonoultramicroscopicsilicovolcanoconiosis"
    assert spelling.segment("the" + long, {"the": 1, long: 1}) == ["the", long]
    assert spelling.segment_by_cost("the" + long, {"the": 50, long: 5}) == ["the", long]
