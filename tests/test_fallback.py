"""A fallback as a second step: it sees the failed texts only, and says what the converter says."""

import pytest

from phonoweave.operators.errors import BackendError, ConfigurationError
from phonoweave.operators.utterance import Converter, Options
from phonoweave.plans.engine import Engine

TEXTS = ["好", "好不", "你好", "不 test", "", "中文 hello", None, "ß", "不不", "test", "æ 不", "你"]


def rows(spark, engine):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string").repartition(3)
    return {r.i: r for r in engine.summarize(df).collect()}


@pytest.mark.parametrize("kind", ["partly", "wrong", "breaks"])
def test_it_says_what_the_converter_says(spark, kind):
    def fallback(word):
        if kind == "breaks":
            raise ZeroDivisionError
        if "你" in word:
            raise BackendError("down")
        return ["x" if kind == "wrong" else "hao4"] * len(word)

    options = {"han": {"好": ["hao3"], "中": ["zhong1"], "文": ["wen2"]}, "backend": "dictionary", "fallback": fallback}
    whole, got = Converter(Options(**options)), rows(spark, Engine(**options))
    for i, text in enumerate(TEXTS):
        want = whole.result(text)
        assert (got[i].result.error, got[i].result.phones) == (want.error, " ".join(want.phones)), text
        assert got[i].result_by == (None if want.error else "then" if text and any(c in text for c in "不你") else "first")


def test_the_second_backend_sees_failed_texts_only(spark, tmp_path):
    def counted(word):
        with open(tmp_path / "calls", "a") as f:
            f.write(word + "\n")
        return ["hao4"] * len(word)

    got = rows(spark, Engine(han={"好": ["hao3"], "中": ["zhong1"], "文": ["wen2"]}, backend="dictionary", fallback=counted))
    calls = (tmp_path / "calls").read_text().split()
    # A character is a word here: those of 好不, 你好, 不 test, 不不 and 你, once each; the one with æ fails ahead of both.
    assert sorted(calls) == sorted("好不你好不不不你")
    assert [got[i].result_by for i in (0, 1, 5, 9)] == ["first", "then", "first", "first"]


def test_without_one_and_with_one_that_does_not_fit(spark):
    got = rows(spark, Engine(unknown="preserve"))
    assert got[0].result_by == "first" and got[6].result_by is None and got[6].result.error.startswith("TypeError")
    with pytest.raises(ConfigurationError):
        rows(spark, Engine(backend="dictionary", fallback="dictionary"))
