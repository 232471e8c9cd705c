"""Letter-to-sound learned from a lexicon: against plain enumeration, and on words that were held out."""

import itertools
import math
import random
from collections import Counter

import pytest

from phonoweave.functions import phonetics as P
from phonoweave.operators import english, sounds, spelling
from phonoweave.operators.backends import EnglishBackend
from phonoweave.operators.evaluation import distance
from phonoweave.plans import learned_queries
from phonoweave.plans.engine import Engine

#: Common words, written for this test.
LEXICON = """
bad B AE1 D|bag B AE1 G|bake B EY1 K|ball B AO1 L|band B AE1 N D|bank B AE1 NG K|base B EY1 S|beach B IY1 CH|beam B IY1 M|bed B EH1 D|bell B EH1 L|best B EH1 S T
bike B AY1 K|bird B ER1 D|bite B AY1 T|black B L AE1 K|blame B L EY1 M|block B L AA1 K|boat B OW1 T|bone B OW1 N|bright B R AY1 T|brick B R IH1 K|bring B R IH1 NG
brown B R AW1 N|burn B ER1 N|cake K EY1 K|call K AO1 L|camp K AE1 M P|cap K AE1 P|cape K EY1 P|case K EY1 S|cat K AE1 T|chain CH EY1 N|chase CH EY1 S|cheap CH IY1 P
check CH EH1 K|chest CH EH1 S T|chin CH IH1 N|church CH ER1 CH|clean K L IY1 N|clock K L AA1 K|close K L OW1 Z|cloud K L AW1 D|coat K OW1 T|coin K OY1 N|cold K OW1 L D
cone K OW1 N|corn K AO1 R N|cream K R IY1 M|crime K R AY1 M|crop K R AA1 P|crowd K R AW1 D|cup K AH1 P|cut K AH1 T|dark D AA1 R K|date D EY1 T|deep D IY1 P|desk D EH1 S K
dish D IH1 SH|dog D AO1 G|down D AW1 N|dream D R IY1 M|dress D R EH1 S|drive D R AY1 V|drop D R AA1 P|dust D AH1 S T|east IY1 S T|face F EY1 S|fact F AE1 K T|fame F EY1 M
farm F AA1 R M|fast F AE1 S T|feel F IY1 L|fight F AY1 T|fine F AY1 N|fire F AY1 ER0|first F ER1 S T|fish F IH1 SH|five F AY1 V|flag F L AE1 G|flame F L EY1 M|flat F L AE1 T
float F L OW1 T|form F AO1 R M|fresh F R EH1 SH|frog F R AA1 G|game G EY1 M|gate G EY1 T|girl G ER1 L|goat G OW1 T|gold G OW1 L D|green G R IY1 N|ground G R AW1 N D
hand HH AE1 N D|hard HH AA1 R D|hat HH AE1 T|hate HH EY1 T|heat HH IY1 T|hill HH IH1 L|hole HH OW1 L|home HH OW1 M|hope HH OW1 P|horn HH AO1 R N|hot HH AA1 T|house HH AW1 S
jump JH AH1 M P|keep K IY1 P|king K IH1 NG|kite K AY1 T|lake L EY1 K|land L AE1 N D|lane L EY1 N|late L EY1 T|leaf L IY1 F|light L AY1 T|like L AY1 K|line L AY1 N|lip L IH1 P
lock L AA1 K|loud L AW1 D|luck L AH1 K|made M EY1 D|mail M EY1 L|make M EY1 K|man M AE1 N|mark M AA1 R K|meat M IY1 T|meet M IY1 T|might M AY1 T|mile M AY1 L|mine M AY1 N
mouse M AW1 S|mud M AH1 D|name N EY1 M|neck N EH1 K|need N IY1 D|nest N EH1 S T|night N AY1 T|nine N AY1 N|nose N OW1 Z|note N OW1 T|pain P EY1 N|park P AA1 R K|path P AE1 TH
pine P AY1 N|place P L EY1 S|plane P L EY1 N|plate P L EY1 T|rain R EY1 N|road R OW1 D|rock R AA1 K|round R AW1 N D|sail S EY1 L|same S EY1 M|seat S IY1 T|shape SH EY1 P
sharp SH AA1 R P|sheep SH IY1 P|ship SH IH1 P|short SH AO1 R T|shout SH AW1 T|side S AY1 D|sing S IH1 NG|skin S K IH1 N|sleep S L IY1 P|smile S M AY1 L|snake S N EY1 K
sound S AW1 N D|star S T AA1 R|stone S T OW1 N|storm S T AO1 R M|street S T R IY1 T|strike S T R AY1 K|strong S T R AO1 NG|sun S AH1 N|tail T EY1 L|take T EY1 K|team T IY1 M
"""
#: Words by which a fault of the model was found: what no word of the lexicon taught could not be said.
OTHERS = """
paint P EY1 N T|trade T R EY1 D|brain B R EY1 N|flight F L AY1 T|spoon S P UW1 N|moon M UW1 N|throw TH R OW1|think TH IH1 NG K|south S AW1 TH|north N AO1 R TH
winter W IH1 N T ER0|market M AA1 R K AH0 T|number N AH1 M B ER0|river R IH1 V ER0|silver S IH1 L V ER0|garden G AA1 R D AH0 N|dinner D IH1 N ER0
kitchen K IH1 CH AH0 N|slate S L EY1 T|grape G R EY1 P|shine SH AY1 N|twelve T W EH1 L V|whale W EY1 L|bench B EH1 N CH|lunch L AH1 N CH|spark S P AA1 R K
smart S M AA1 R T|sport S P AO1 R T|turn T ER1 N|shirt SH ER1 T|trust T R AH1 S T|spend S P EH1 N D|plant P L AE1 N T|stand S T AE1 N D|cheese CH IY1 Z
queen K W IY1 N|scale S K EY1 L|globe G L OW1 B|smoke S M OW1 K|pride P R AY1 D
"""
#: Words written after the model was fixed.
LATER = """
table T EY1 B AH0 L|paper P EY1 P ER0|water W AO1 T ER0|summer S AH1 M ER0|letter L EH1 T ER0|window W IH1 N D OW0|yellow Y EH1 L OW0|finger F IH1 NG G ER0|simple S IH1 M P AH0 L
mother M AH1 DH ER0|strange S T R EY1 N JH|wave W EY1 V|cave K EY1 V|grade G R EY1 D|shade SH EY1 D|slide S L AY1 D|white W AY1 T|while W AY1 L|throne TH R OW1 N|toast T OW1 S T
frost F R AO1 S T|blood B L AH1 D|crown K R AW1 N|spring S P R IH1 NG|truck T R AH1 K|thick TH IH1 K|teach T IY1 CH|peace P IY1 S|wheel W IY1 L|speed S P IY1 D
"""
WORDS, FRESH, LAST = ([tuple(entry.split(" ", 1)) for entry in words.replace("\n", "|").strip("|").split("|")] for words in (LEXICON, OTHERS, LATER))


def lexicon(spark, rows):
    return spark.createDataFrame(rows, "word string, phones string")


def every_alignment(word, phones):
    for ks in itertools.product(range(3), repeat=len(word)):
        if sum(ks) == len(phones):
            ends = list(itertools.accumulate(ks))
            yield tuple((c, " ".join(phones[e - k : e])) for c, k, e in zip(word, ks, ends))


def plain_counts(rows, chances):
    counts = Counter()
    for word, phones in rows:
        ways = {a: math.prod((chances.get(x, 0.0) if chances else 1.0) * sounds.WEIGHTS[len(x[1].split())] for x in a) for a in every_alignment(word, phones.split())}
        total = sum(ways.values())
        for a, p in ways.items():
            for x in a:
                counts[x] += p / total if total else 0
    return counts


def test_expected_counts_equal_all_alignments(spark):
    r = random.Random(1)
    rows = sorted({("".join(r.choices("abcé", k=r.randint(1, 6))), " ".join(r.choices(["A", "B", "K"], k=r.randint(1, 7)))) for _ in range(60)})
    chances = None
    for _ in range(4):
        got = {(a, b): n for a, b, n in sounds.expected_counts(lexicon(spark, rows).repartition(3), chances).collect()}
        want = plain_counts(rows, chances)
        assert all(got.get(x, 0) / sounds.UNIT == pytest.approx(n, abs=1e-3) for x, n in want.items()) and not set(got) - set(want)
        assert got == {(a, b): n for a, b, n in sounds.expected_counts(lexicon(spark, rows[::-1]).repartition(5), chances).collect()}
        chances = sounds.chances_of((a, b, n) for (a, b), n in got.items())
    teaching = [(w, p) for w, p in rows if len(p.split()) <= 2 * len(w)]
    aligned = sounds.align(lexicon(spark, [*rows, *rows[:5], ("", "A"), (None, "A"), ("a", None), ("a", " ")]), rounds=4).collect()
    assert len(aligned) == len(teaching)
    price = lambda a: math.prod(chances.get(x, 0.0) * sounds.WEIGHTS[len(x[1].split())] for x in a)
    best = {}
    for w, p in teaching:
        best.setdefault((w, p), max(map(price, every_alignment(w, p.split()))))
    for row in aligned:
        p = " ".join(s for s in row.said if s)
        assert price(tuple(zip(row.word, row.said))) == pytest.approx(best[row.word, p])


def test_the_best_path_equals_an_exhaustive_one(spark):
    model = sounds.Sounds.of(sounds.learn(lexicon(spark, WORDS[:40])))
    top = len(sounds.WINDOWS) - 1

    def chance(word, said):
        padded, total, guide = sounds.EDGES[0] * 9 + word + sounds.EDGES[1] * 9, 0.0, spelling.by_letter(word)
        for i, s in enumerate(said):
            p = float(s == guide[i])
            for level, (b, a) in enumerate(sounds.WINDOWS):
                pieces = [padded[i + 9 - b : i + 10 + a], guide[i], said[i - 1] if i else ""]
                seen = model.levels[level].get(sounds.PART.join(pieces[: 3 if level == top else 2]))
                if seen:
                    n, t = sum(seen.values()), len(seen)
                    p = (seen.get(s, 0) + t * p) / (n + t)
            total += math.log(p) if p else -math.inf
        return total

    for word in ("cab", "bone", "bach", "hand", "nab"):
        choices = [sorted({g, *model.levels[0].get(c + sounds.PART + g, ())}) for c, g in zip(word, spelling.by_letter(word))]
        score, said = model.path(word)
        assert score == pytest.approx(max(chance(word, s) for s in itertools.product(*choices))) == pytest.approx(chance(word, said))


def errors(read, rows):
    return sum(distance(read(w), p.split()) for w, p in rows) / sum(len(p.split()) for _, p in rows)


def test_held_out_words_are_read_better_than_by_the_rules(spark):
    held = WORDS[1::4]
    for taught, rows in (([w for w in WORDS if w not in held], held), (WORDS + FRESH, LAST)):
        assert not set(taught) & set(rows)
        model = sounds.Sounds.of(sounds.learn(lexicon(spark, taught)))
        learned, rules = errors(model, rows), errors(spelling.letter_to_sound, rows)
        print(f"phone errors on held-out words: learned {learned:.3f}, rules {rules:.3f}")
        assert learned < rules


def test_held_out_syllables_without_a_guide(spark):
    onsets, finals = ("b", "p", "m", "d", "t", "n", "l", "g", "k", "h"), ("a", "ai", "an", "ang", "ei", "en", "eng", "ou")
    rows = [(i + f, f"{P.CMN_INITIALS[i]} {P.CMN_FINALS[f]}") for i in onsets for f in finals]
    held = rows[::5]
    model = sounds.Sounds.of(sounds.learn(lexicon(spark, [r for r in rows if r not in held]), guide=None), guide=None)
    assert errors(model, held) < 0.05
    with pytest.raises(ValueError, match="the guide expects 1 letters"):
        sounds.Sounds([], guide=lambda w: [""])("ab")


def test_empty_lexicon_and_odd_words(spark):
    none = sounds.Sounds.of(sounds.learn(lexicon(spark, [])))
    assert none("cat") == spelling.letter_to_sound("cat") and none("") == []
    assert sounds.Sounds([], guide=None)("cat") == []
    model = sounds.Sounds.of(sounds.learn(lexicon(spark, WORDS)))
    assert model("b字ad")[:1] == ["B"] and len(model("bad" * 2000)) > 4000
    with pytest.raises(ValueError, match="more than 3 rows"):
        sounds.Sounds.of(sounds.learn(lexicon(spark, WORDS[:9])), most=3)
    rows = sounds.read(lexicon(spark, [("Bad", None), (None, None), ("", "x")]).drop("phones"), model).collect()
    assert [tuple(r) for r in rows] == [("Bad", "B AE1 D"), (None, None), ("", "")]


def test_the_engine_and_the_join_read_with_it(spark):
    model = sounds.Sounds.of(sounds.learn(lexicon(spark, WORDS)))
    backend = EnglishBackend(sounds=model)
    df = spark.createDataFrame([(1, "trake 你好")], "doc_id int, text string")
    engine = Engine(english_backend=backend)
    assert engine.by_word
    said = df.select(engine.summary(df["text"]).alias("r")).first().r
    assert said.error is None and said.phones.split()[:4] == [*model("trake")][:4]
    tokens = spark.createDataFrame([("trake", "trake")], "text string, word string").selectExpr("text", "word", "'en' AS language")
    seed = spark.createDataFrame([("the", ["DH AH0"])], "word string, readings array<string>")
    assert english.complete(english.pronounce(tokens, seed), backend).first().native == " ".join(model("trake"))


def test_the_query_reads_every_word_that_is_held_out(spark, tmp_path):
    texts = ["The band made a brick road to lake Namat, and the best", "chase chain cheap check; made brand clean", None, ""]
    spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.word: (r.taught, r.learned, r.n_phones, r.errors) for r in learned_queries.learned_sounds(spark, str(tmp_path)).collect()}
    words = {w for t in texts if t for w in __import__("re").findall("[a-z]+", t.lower())}
    import zlib

    assert set(got) == {w for w in words if zlib.crc32(w.encode()) % 5 == 0}
    for word, (taught, learned, n, wrong) in got.items():
        assert taught == " ".join(spelling.letter_to_sound(word)) and n == len(taught.split()) and wrong == distance(taught.split(), learned.split())
