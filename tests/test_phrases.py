"""Phrase tables and the word lattice against plain searches."""

import itertools
import math
import random
import time

import numpy as np
import pytest

from phonoweave.functions.phrases import PhraseMap, PhraseTable, chain, code_points
from phonoweave.operators import lattice
from phonoweave.operators.lattice import Lattice

LETTERS = "ab中\U00020000"


def some(r, most, n):
    return ["".join(r.choice(LETTERS) for _ in range(r.randrange(most))) for _ in range(n)]


def plain_longest(text, phrases):
    out, at = [], 0
    while at < len(text):
        size = max((len(p) for p in phrases if p and text.startswith(p, at)), default=0)
        if size:
            out.append((at, text[at : at + size]))
        at += max(1, size)
    return out


@pytest.mark.parametrize("seed", range(8))
def test_phrases_equal_a_plain_search(seed):
    r = random.Random(seed)
    phrases, texts = some(r, 5, 12), some(r, 30, 40) + ["", "a" * 50]
    table = PhraseTable(phrases)
    codes, at = code_points(texts)
    place, length, phrase = table.leftmost_longest(codes, at)
    got = [(int(p), table.phrases[v]) for p, v in zip(place, phrase)]
    assert got == [(int(at[k]) + a, p) for k, t in enumerate(texts) for a, p in plain_longest(t, phrases)] and all(len(p) == n for (_, p), n in zip(got, length))
    place, length, phrase = table.occurrences(codes, at)
    want = [(int(at[k]) + a, p) for k, t in enumerate(texts) for a in range(len(t)) for p in set(phrases) if p and t.startswith(p, a)]
    assert sorted((int(p), table.phrases[v]) for p, v in zip(place, phrase)) == sorted(want)


def test_empty_tables_and_texts():
    for phrases, texts in (([], ["ab"]), ([""], ["ab"]), (["ab"], []), (["ab"], ["", ""])):
        assert not len(PhraseTable(phrases).leftmost_longest(*code_points(texts))[0])
    assert chain(np.array([2, 2, 3, 5, 5]), np.array([0])).tolist() == [True, False, True, True, False]


def test_conversion_keeps_lengths():
    convert = PhraseMap({"发": "發", "头发": "頭髮", "理发": "理髮", "后": "後", "皇后": "皇后"}).convert
    assert convert(["头发和出发", "皇后在后", "", "abc"]) == ["頭髮和出發", "皇后在後", "", "abc"]
    with pytest.raises(ValueError):
        PhraseMap({"a": "bc"})


def test_a_large_table():
    r = random.Random(1)
    phrases = list({"".join(chr(0x4E00 + r.randrange(3000)) for _ in range(r.randrange(2, 6))) for _ in range(400_000)})
    began = time.time()
    table = PhraseTable(phrases)
    assert time.time() - began < 20 and table.phrases == phrases
    text = "".join(r.choice(phrases) for _ in range(50_000))
    place, length, phrase = table.leftmost_longest(*code_points([text]))
    sizes, known = {len(p) for p in phrases}, set(phrases)
    at = 0
    for p, n, v in zip(place[:3000].tolist(), length.tolist(), phrase.tolist()):
        while at < p:
            assert not any(text[at : at + k] in known for k in sizes)
            at += 1
        assert n == max(k for k in sizes if text[p : p + k] in known) and table.phrases[v] == text[p : p + n]
        at = p + n


def every_path(text):
    for cuts in itertools.product((0, 1), repeat=max(0, len(text) - 1)):
        ends = [k + 1 for k, c in enumerate(cuts) if c] + [len(text)]
        yield [text[a:b] for a, b in zip([0, *ends], ends)]


@pytest.mark.parametrize("seed", range(6))
def test_best_path_equals_an_exhaustive_one(seed):
    r = random.Random(seed)
    counts = {w: r.choice([1, 2, 4, 4, 8]) for w in some(r, 5, 15) if w}
    total = sum(counts.values())
    model, texts = Lattice(counts), [t for t in some(r, 10, 60)] + [""]
    for text, got in zip(texts, model.many(texts)):
        if not text:
            assert got == []
            continue
        price = lambda words: sum(lattice.cost(counts.get(w, 1), total) for w in words)
        paths = [p for p in every_path(text) if all(len(w) == 1 or w in counts for w in p)]
        assert [w for w, _ in got] == min(paths, key=lambda p: (price(p), [-len(w) for w in p]))
        assert got == model(text)


def test_long_texts_and_words_cut_again():
    model = Lattice({"ab": 5, "ba": 5, "abab": 9, "aab": 2}, split=["ab"], kept=["abab"])
    assert [w for w, _ in model("abab")] == ["abab"]
    assert [w for w, _ in Lattice({"ab": 5, "abab": 90}, split=["ab"])("abab")] == ["ab", "ab"]
    assert sum(len(w) for w, _ in model("ab" * 30_000 + "zz")) == 60_002


def test_tags():
    tags = {"flies": {"n": 3, "v": 3}, "time": {"n": 9, "v": 1}, "fast": {"a": 2}}
    assert Lattice({}, tags).tagged(["time", "flies", "new"]) == ["n", "n", "x"]
    model = Lattice({}, tags, {("", "n"): 5, ("n", "v"): 8, ("v", "a"): 4, ("n", "n"): 1})
    words = ["time", "flies", "fast"]
    n_tags = len(model.word_totals)

    def price(path):
        return sum(-math.log((model.transitions.get((b, t), 0) + 1) / (model.tag_totals.get(b, 0) + n_tags)) - math.log((tags[w][t] + 1) / (model.word_totals[t] + n_tags)) for b, t, w in zip(["", *path], path, words))

    assert model.tagged(words) == list(min(itertools.product(*(tags[w] for w in words)), key=price)) == ["n", "v", "a"]
    assert model.tagged([]) == []


def test_lattice_from_tables(spark):
    rows = [(1, 0, "我们", "r"), (1, 1, "去", "v"), (1, 2, "北京", "n"), (2, 0, "北京", "n"), (2, 1, "大学", "n"), (3, 0, "北京大学", "n")]
    words, pairs = lattice.learn(spark.createDataFrame(rows, "sentence int, place int, word string, tag string"))
    model = lattice.from_tables(words, pairs)
    df = spark.createDataFrame([(1, "我们去北京大学"), (2, None), (3, ""), (4, "去x去")], "doc_id int, text string")
    got = [(r.doc_id, r.place, r.word, r.tag) for r in lattice.segment(df, model).orderBy("doc_id", "place").collect()]
    assert got[:3] == [(1, 0, "我们", "r"), (1, 1, "去", "v"), (1, 2, "北京大学", "n")] and [g[2] for g in got[3:]] == ["去", "x", "去"]
