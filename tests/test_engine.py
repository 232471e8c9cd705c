"""Operators of the engine on small fixtures."""

import itertools
import json
import math
import random
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from phonoweave.functions import lexicon, scan, text
from phonoweave.functions import phonetics as P
from phonoweave.functions import scripts
from phonoweave.functions.text import compatibility, fold, realign
from phonoweave.operators import english, evaluation, numbers, sandhi, similarity, spelling
from phonoweave.operators import tokens as T
from phonoweave.operators.backends import EnglishBackend, Traits, Unit
from phonoweave.operators.utterance import BackendError, ConfigurationError, Converter, Options, tagged_segmenter
from phonoweave.plans import evaluate
from phonoweave.plans.engine import Engine, to_json, to_lines
from phonoweave.sources import corpora, lexicons
from phonoweave.streaming import convert as streaming


def phones(text, **options):
    return " ".join(Converter(Options(**options)).convert(text)["phones"])


def test_inventory():
    table = P.pinyin_table()
    assert len(table) == 426
    assert P.split_pinyin("jiu4") == ("j", "iu", "4") and P.split_pinyin("xue2", True) == ("x", "ve", "2") and P.split_pinyin("lüe4".replace("ü", "v"), True) == ("l", "ve", "4")
    assert P.split_pinyin("yuan2", True) == ("", "van", "2") and P.split_pinyin("wen2", True) == ("", "uen", "2") and P.split_pinyin("ng4") == ("", "ng", "4")
    for bad in ("jiu", "jiu6", "qa1", "", "1"):
        with pytest.raises(ValueError):
            P.split_pinyin(bad)
    assert P.split_jyutping("gwong2") == ("gw", "ong", "2") and P.split_jyutping("ng5") == ("", "ng", "5") and P.split_jyutping("ngo5") == ("ng", "o", "5")
    for bad in ({"value": "zzz1"}, {"value": "bung1", "attested": {"bun"}}):
        with pytest.raises(ValueError):
            P.split_jyutping(**bad)
    for (a, b), strict in P.canonical_pinyin().items():
        assert P.canonical_pinyin()[strict] == strict


def test_every_syllable_has_ipa(spark):
    table = P.pinyin_rows(spark).where("final <> ''")
    assert table.where(P.pinyin_ipa(F.col("initial"), F.col("final")).isNull()).count() == 0
    finals = spark.createDataFrame([(o, f) for o in P.JYUTPING_ONSETS for f in P.JYUTPING_FINALS], "o string, f string")
    assert finals.where(P.jyutping_ipa(F.col("o"), F.col("f")).isNull()).count() == 0
    wrong = spark.createDataFrame([("B1",), ("AA3",), ("QQ",), ("",)], "p string")
    assert wrong.where(P.split_arpabet(F.col("p")).isNotNull()).count() == 0


def test_arrays_of_tokens_equal_rows(spark):
    r = random.Random(2)
    texts = [(k, "".join(r.choice("ab 你好，。1.’'-é\n!𠀀$") for _ in range(r.randrange(60)))) for k in range(200)] + [(900, ""), (901, None), (902, "word " * 700)]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    arrays = frame.select("doc_id", F.explode(T.tokens(F.col("text"))).alias("t")).select("doc_id", "t.*")
    names = ["doc_id", "id", "text", "start", "end", "language", "kind", "boundary"]
    got = sorted(map(tuple, arrays.select(names).collect()))
    assert got == sorted(map(tuple, T.explode_tokens(frame, columns=tuple(names[1:])).select(names).collect()))
    joined, want = {}, Converter(Options())
    for row in got:
        joined[row[0]] = joined.get(row[0], "") + row[2]
    assert all(joined.get(d, "") == (t or "") for d, t in texts)
    for d, text in texts[:60]:
        plain = [(t.text, t.language, t.kind, t.boundary) for t in want.tokens(text, [(0, 0)] * len(text)) if t.language != "zh"]
        assert plain == [(x[2], x[5], x[6], x[7]) for x in got if x[0] == d and x[5] != "zh"]


def test_scan_finds_the_tokens_of_the_pattern(spark, monkeypatch):
    r = random.Random(7)
    alphabet = "aZé 你〇，。1٣.:/-'’\u0301\u0903\n\x1c\u3000!𠀀$ªⅣß\u0000_€"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(40))) for _ in range(400)] + ["", None, "\u0301a\u0301\u0301-b\u0301’c1.2.3-4-x", "a", "1"]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    got = {x.k: (list(x.a), list(x.b)) for x in frame.select("k", T.tokens(F.col("text"))["text"].alias("a"), T.token_texts(F.col("text")).alias("b")).collect()}
    assert all(a == b for a, b in got.values()) and len(got) == len(texts)
    monkeypatch.setattr(scan, "SLICE", 30)
    parts = [x.as_py() or "" for part in scan.slices(pa.array(texts), 30) for x in part]
    assert parts == [t or "" for t in texts]


def test_projection(spark):
    frame = spark.createDataFrame([("我 love my 家，OK",)], "text string")
    zh = frame.select("text", T.projection(F.col("text"), "zh").alias("p"))
    assert zh.select(T.projection_text(F.col("p"))).first()[0] == "我 <EN> 家，<EN>"
    assert [list(x.source_ids) for x in zh.first()["p"] if x.kind == "placeholder"] == [[2, 3, 4], [8]]
    chars = zh.select(T.character_projection(F.col("text"), "zh", "#", False).alias("a"), T.character_projection(F.col("text"), "zh", "#", True).alias("b")).first()
    assert "".join(x.char for x in chars.a) == "我#家#" and "".join(x.char for x in chars.b) == "我 # 家，#"
    assert [(x.token, x.place) for x in chars.a if x.token is not None] == [(0, 0), (6, 0)]


def test_folding_and_alignment():
    assert fold("Café") == "Cafe" and fold("Ångström") == "Angstrom"
    for bad in ("straße", "søn", "ı"):
        with pytest.raises(ValueError):
            fold(bad)
    text, spans = compatibility("ﬁ１é")
    assert text == "fi1é" and spans[:3] == [(0, 1), (0, 1), (1, 2)] and len(spans) == len(text)
    assert realign("a1b", "a一百b", [(0, 1), (1, 2), (2, 3)]) == [(0, 1), (1, 2), (1, 2), (2, 3)]
    assert scripts.is_han("〇") and scripts.is_latin("é") and scripts.is_mark("́") and not scripts.is_han("a")


@pytest.mark.parametrize("text,want", [
    ("123", "一百二十三"), ("-12", "negative twelve"), ("50%", "fifty percent"), ("有50%", "有百分之五十"), ("3µm", "三微米"), ("ABC 123", "ABC one hundred and twenty three"),
    ("2024年1月2日", "二零二四年一月二日"), ("他有3.14", "他有三点一四"), ("请打13812345678", "请打幺三八幺二三四五六七八"), ("我有10010元", "我有一万零一十元"), ("a 1005", "a one thousand and five"),
    ("is 1,000", "is one thousand"), ("有12,345.5元", "有一万二千三百四十五点五元"), ("at 12:30", "at twelve thirty"), ("at 9:05", "at nine oh five"), ("在12:30", "在十二点三十分"), ("on 2024-01-22", "on January twenty second twenty twenty four"), ("in 2005/3/8", "in March eighth two thousand and five"), ("a 1,2", "a one,two"),
])
def test_written_forms(text, want):
    got, spans = numbers.spell_out(text, [(i, i + 1) for i in range(len(text))])
    assert got == want and len(spans) == len(got) and all(0 <= a < b <= len(text) for a, b in spans)


@pytest.mark.parametrize("words,want", [
    ([("不对", "44", "d")], "24"), ([("看不见", "424", "v")], "454"), ([("看一看", "414", "v")], "454"), ([("第一", "41", "m")], "41"), ([("一定", "14", "d")], "24"), ([("一天", "11", "m")], "41"),
    ([("你好", "33", "x")], "23"), ([("老鼠", "33", "n"), ("水", "3", "n")], "223"), ([("妈妈", "11", "n")], "15"), ([("我们", "32", "r")], "35"), ([("我", "3", "r"), ("们", "2", "k")], "32"), ([("看", "4", "v"), ("一", "1", "m"), ("看", "4", "v")], "454"),
    ([("女", "3", "n"), ("儿", "2", "n")], "32"), ([("花", "1", "n"), ("儿", "2", "n")], "15"), ([("很", "3", "d"), ("好", "3", "a")], "23"), ([("看看", "44", "v")], "45"),
])
def test_sandhi(words, want):
    assert "".join(sandhi.Sandhi().tones([[(t, list(n), p) for t, n, p in words], []])[0]) == want


def test_sandhi_checks_its_splitter():
    with pytest.raises(ValueError):
        sandhi.Sandhi(splitter=lambda w: ["x"]).tones([[("你好吗", ["3", "3", "5"], "")]])


def test_conversion():
    assert phones("你好 world") == "n i2 h ao3 W ER1 L D"
    assert phones("你好 hello", output="ipa") == "n i˧˥ x a ʊ˨˩˦ h ə l ˈo ʊ"
    assert phones("你好", mode="cantonese") == "n ei5 h ou2"
    assert phones("你好", tone_sandhi=False) == "n i3 h ao3"
    assert phones("银行") == "in2 h ang2"
    assert phones("AI a b") == "EY1 AY1 AH0 B IY1"
    assert phones("I record the record") == "AY1 R AH0 K AO1 R D DH AH0 R EH1 K ER0 D"
    assert phones("helloworld") == "HH AH0 L OW1 W ER1 L D"
    assert phones("") == "" and phones("，。") == ""


def test_errors_are_data():
    strict = Converter(Options()).convert("龘")
    assert strict["error"].startswith("BackendError") and strict["phones"] == []
    kept = Converter(Options(unknown="preserve")).convert("你龘")
    assert kept["error"] is None and kept["phones"] == ["n", "i3"] and len(kept["warnings"]) == 1 and kept["tokens"][-1]["units"][-1]["is_unknown"]
    assert Converter(Options()).convert("straße")["error"].startswith("NormalizationError")
    assert Converter(Options()).convert(None)["error"].startswith("TypeError")
    for bad in ({"mode": "x"}, {"output": "x"}, {"unknown": "x"}):
        with pytest.raises(ConfigurationError):
            Options(**bad)


def test_any_failure_is_data():
    long = Converter(Options(unknown="preserve")).convert("a " + "7" * 5000)
    assert long["error"] is None and len(long["phones"]) > 10_000

    def breaks(text):
        return 1 / 0

    assert Converter(Options(backend=breaks)).convert("好")["error"] == "BackendError: custom: ZeroDivisionError: division by zero"
    bad = EnglishBackend(words={"word": ["QQ1 X"]})
    assert "TranscriptionError" in Converter(Options(english_backend=bad, output="ipa")).convert("word")["error"]
    text = "x" * 30_000 + "e\u0301" + "y" * 30_000
    value, spans = compatibility(text)
    assert len(value) == len(spans) == 60_001 and spans[30_000] == (30_000, 30_002) and spans[-1] == (60_001, 60_002)


def test_backends():
    options = {"unknown": "preserve"}
    assert "needs a model" in Converter(Options(backend="polyphone")).convert("好")["error"]
    seen = []

    def model(sentences):
        seen.extend(sentences)
        return [[(c, {"好": "hao4"}.get(c)) for c in s] for s in sentences]

    got = Converter(Options(backend="polyphone", model=model, **options)).convert("你好 OK, x 你")
    assert seen == ["你好，你"] and got["phones"][:4] == ["n", "i3", "h", "ao4"]
    for answer, said in (([], "one sentence"), ([[]], "0 places"), ([[("x", "a1")]], "came back"), ([[("好", " ")]], "no reading")):
        assert said in Converter(Options(backend="polyphone", model=lambda s, a=answer: a)).convert("好")["error"]
    seen.clear()
    cantonese = {"好": "hou2 hou2", "，": None}
    many = Converter(Options(mode="cantonese", model=lambda s: (seen.extend(s), [[(c, cantonese.get(c)) for c in s[0]]])[1])).convert("好 is，好")
    assert seen == ["好 \ue000，好"] and many["error"] and "twice" in many["error"]
    cantonese["好"] = "hou2 hou3"
    assert Converter(Options(mode="cantonese", model=lambda s: [[(c, cantonese.get(c)) for c in s[0]]])).convert("好，")["phones"] == ["h", "ou2", "h", "ou3"]
    with pytest.raises(ConfigurationError, match="has no backend"):
        Converter(Options(backend="nothing"))
    with pytest.raises(ConfigurationError, match="stand in"):
        Converter(Options(backend="dictionary", fallback="dictionary"))
    whole = Converter(Options(backend="polyphone", fallback="dictionary", **options)).convert("你")
    assert whole["error"].startswith("ConfigurationError")
    none = Converter(Options(backend="polyphone", model=lambda s: 1 / 0, fallback="dictionary")).convert("你好")
    assert none["error"] is None and none["tokens"][0]["backend"] == "polyphone->dictionary"


def test_validation():
    class Wrong:
        name, traits = "wrong", Traits("zh", "pinyin", "mandarin")

        def __init__(self, make):
            self.make = make

        def predict(self, request):
            return self.make(request.targets)

    unit = lambda t, **change: Unit(**({"text": t.text, "spans": t.spans, "phones": ["h", "ao"], "alphabet": "pinyin", "native": "hao3", "tone": "3"} | change))
    cases = [
        (lambda ts: [], "mapping"), (lambda ts: {}, "missing tokens"), (lambda ts: {ts[0].id: [unit(ts[0])], 99: []}, "extra tokens"), (lambda ts: {ts[0].id: []}, "units are wanted"),
        (lambda ts: {ts[0].id: [unit(ts[0], alphabet="jyutping")]}, "where 'pinyin'"), (lambda ts: {ts[0].id: [unit(ts[0], text="")]}, "a span"), (lambda ts: {ts[0].id: [unit(ts[0], spans=[(5, 6)])]}, "does not lie"),
        (lambda ts: {ts[0].id: [unit(ts[0]), unit(ts[0])]}, "does not lie"), (lambda ts: {ts[0].id: [unit(ts[0], phones=[])]}, "no phones"), (lambda ts: {ts[0].id: [unit(ts[0], tone="4")]}, "this tone"),
        (lambda ts: {ts[0].id: [unit(ts[0], contour="17")]}, "contour"), (lambda ts: {ts[0].id: [unit(ts[0], stress=[(3, 1)])]}, "stress"), (lambda ts: {ts[0].id: [unit(ts[0], is_unknown=True)]}, "phonetic data"),
    ]
    for make, said in cases:
        assert said in Converter(Options(backend=Wrong(make))).convert("好")["error"], said
    assert Converter(Options(backend=Wrong(lambda ts: {ts[0].id: [unit(ts[0])]}))).convert("好")["phones"] == ["h", "ao3"]
    swap = lambda tokens, units: {i: [Unit("坏", u.spans, u.phones, u.alphabet, u.native, u.tone) for u in us] for i, us in units.items()}
    assert "changed which units" in Converter(Options(processors=[swap])).convert("好")["error"]
    with pytest.raises(ValueError):
        tagged_segmenter(["你好"], "other")
    assert tagged_segmenter({"你好": "l"}, "universal")("你好看") == [("你好", "X"), ("看", "VERB")]
    assert "did not keep" in Converter(Options(segmenter=lambda t: [("x", "n")])).convert("好")["error"]


def test_fallback():
    def fails(text):
        raise BackendError("down")

    assert phones("好", backend=fails, fallback=lambda t: ["hao4"] * len(t)) == "h ao4"
    both = Converter(Options(backend=fails, fallback=fails)).convert("好")
    assert both["error"] == "BackendError: custom: down; fallback: down"
    wrong = Converter(Options(backend=lambda t: ["hao4", "x"])).convert("好")
    assert wrong["error"].startswith("AlignmentError: custom: 2 readings")
    assert Converter(Options(backend=lambda t: ["hao9"])).convert("好")["error"].startswith("BackendError: Invalid")


def test_engine_frames(spark):
    frame = spark.createDataFrame([(1, "你好 world"), (2, "straße"), (3, None)], "doc_id long, text string")
    done = Engine().transform(frame)
    by = {r.doc_id: r.result for r in done.collect()}
    assert by[1].phones[:2] == ["n", "i2"] and by[2].error and by[3].error
    assert sorted(r.value for r in to_lines(done).collect()) == ["world\tW ER1 L D", "你\tn i2", "好\th ao3"]
    assert {json.loads(r.value).get("normalized_text") for r in to_json(done).collect()} == {"你好 world", None}
    with pytest.raises(Exception, match="NormalizationError"):
        Engine().transform(frame.where("doc_id = 2"), strict=True).select("result.phones").collect()
    Engine().register(spark, "phones_of")
    assert spark.sql("SELECT phones_of('你好')").first()[0] == "n i2 h ao3"
    pairs = spark.createDataFrame([("hello", "hello"), ("hello", "world"), ("你", "，")], "a string, b string")
    same, other, none = Engine().compare(pairs, "a", "b").select("similarity.*").collect()
    assert same.score == 1.0 and 0 <= other.score < 1 and none.error.startswith("SimilarityError")


def test_alignment_orders_by_sound():
    near, far = similarity.align(["p", "a"], ["b", "a"]), similarity.align(["p", "a"], ["s", "i"])
    assert near["score"] > far["score"] and [s[0] for s in similarity.align(["a"], ["a", "n"])["steps"]] == ["match", "insert"]
    segments = {s for table in (P.CMN_INITIALS, P.CMN_FINALS, P.CMN_WHOLE, P.CMN_APICAL, P.YUE_ONSETS, P.YUE_NUCLEI, P.YUE_CODAS, P.EN_CONSONANTS, P.EN_VOWELS, P.EN_UNSTRESSED) for v in table.values() for s in v.split()}
    assert all(similarity.features(s) for s in segments)


def test_spelling():
    assert spelling.segment("helloworld", {"hello": 1, "world": 1}) == ["hello", "world"] and spelling.segment("xyzzy", {}) == ["xyzzy"]
    assert spelling.letter_to_sound("shine")[0] == "SH" and spelling.tag(["to", "record", "a", "record"]) == ["TO", "VB", "DT", "NN"]


def test_segmentation_by_counts():
    unigrams = {"the": 500, "rapist": 2, "therapist": 20, "is": 300, "his": 100, "th": 1, "now": 50, "here": 60, "nowhere": 5}
    assert spelling.segment_by_cost("thisis", {"this": 90, "is": 90}) == ["this", "is"]
    assert spelling.segment_by_cost("therapist", unigrams) == ["therapist"]
    assert spelling.segment_by_cost("nowhere", {"now": 50, "here": 60, "nowhere": 1}, {("now", "here"): 49}) == ["now", "here"]
    assert spelling.segment_by_cost("", unigrams) == [""] and spelling.segment_by_cost("q", unigrams) == ["q"]
    r = random.Random(1)
    counts = {"".join(r.choice("ab") for _ in range(r.randrange(1, 4))): r.randrange(1, 40) for _ in range(8)}
    total = sum(counts.values())
    for _ in range(60):
        word = "".join(r.choice("ab") for _ in range(r.randrange(1, 8)))
        cost = lambda parts: sum(-math.log(counts[p] / total) if p in counts else math.log(total) + (len(p) - 1) * math.log(10) for p in parts)
        cuts = [[word[a:b] for a, b in zip((0, *c), (*c, len(word)))] for n in range(len(word)) for c in itertools.combinations(range(1, len(word)), n)]
        assert math.isclose(cost(spelling.segment_by_cost(word, counts)), min(map(cost, cuts)))


def test_english_frames_and_small_sources(spark, tmp_path):
    words = spark.createDataFrame([("hello", "en"), ("helloworld", "en"), ("shine", "en"), ("Straße", "en"), ("你", "zh")], "text string, language string")
    routed = english.pronounce(english.words(words), lexicon.english(spark))
    got = {r.text: r.native for r in english.complete(routed).collect()}
    assert got["helloworld"] == "HH AH0 L OW1 W ER1 L D" and got["shine"].startswith("SH") and got["Straße"] is None and "你" not in got
    a, b = (spark.createDataFrame([(k,) for k in ks], "id int") for ks in ((1, 2, 2, None), (2, 3)))
    assert sorted(map(tuple, evaluation.coverage(a, b, ["id"]).collect()), key=str) == [(1, "missing"), (3, "extra"), (None, "missing")]
    (tmp_path / "m.json").write_text('{"a": "x", "b": ["y", "z"]}')
    assert {r.key: list(r["values"]) for r in lexicons.json_mapping(spark, str(tmp_path / "m.json")).collect()} == {"a": ["x"], "b": ["y", "z"]}
    s = spark.createDataFrame([("好", "好"), ("好5", "好"), ("hao3", "好")], "s string, c string")
    assert [r[0] for r in s.select(P.is_unpronounced(F.col("s"), F.col("c"))).collect()] == [True, True, False]
    assert Converter(Options(mode="cantonese", unknown="preserve")).normalize("香港3点见")[0] == "香港三點見"
    marks = spark.createDataFrame([(1, "tiếng Ⅳ ﬁne"), (2, "smør"), (3, "a\u035c"), (4, None)], "doc_id int, text string")
    assert [r[0] for r in marks.select(text.fold_latin(F.col("text"))).collect()] == ["tieng IV fine", "smør", "a\u035c", None]
    assert sorted(map(tuple, text.first_unfoldable(marks).collect())) == [(2, "ø", 2), (3, "\u035c", 1)]


def test_edit_distance_and_summary(spark):
    r = random.Random(4)
    rows = [(k, "mandarin" if k % 2 else "cantonese", [r.choice("abc") for _ in range(r.randrange(1, 7))], [r.choice("abc") for _ in range(r.randrange(7))], "x" if k % 9 == 0 else None) for k in range(120)]
    cases = spark.createDataFrame(rows, "id long, mode string, expected array<string>, actual array<string>, error string")

    def distance(a, b):
        table = list(range(len(b) + 1))
        for i, x in enumerate(a):
            last, table[0] = i, i + 1
            for j, y in enumerate(b):
                last, table[j + 1] = table[j + 1], min(table[j + 1] + 1, table[j] + 1, last + (x != y))
        return table[-1]

    scored = evaluation.score_cases(cases)
    want = {i: len(e) if err else distance(e, a) for i, _, e, a, err in rows}
    assert {x.id: x.edits for x in scored.collect()} == want
    total = evaluation.summarize(scored).first()
    assert total.unit_edits == sum(want.values()) and total.completed == sum(err is None for *_, err in rows)
    worst = evaluation.failures(scored, 5).collect()
    assert [x.id for x in worst] == [0, 9, 18, 27, 36]
    picked = evaluation.sample(spark, spark.range(50).withColumnRenamed("id", "i"), "i", 50, 7, 42)
    assert [x.i for x in picked.collect()] == sorted(random.Random(42).sample(range(50), 7))


def test_sample_draws_from_all_rows(spark, tmp_path):
    from phonoweave.plans import phonetic_queries

    keys = [7 * k * k - 3000 for k in range(2500)]
    rows = [(k, k % 11) for k in keys]
    random.Random(3).shuffle(rows)
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long").repartition(5).write.parquet(str(tmp_path / "orders.parquet"))
    got = [(x.i, x.id) for x in phonetic_queries.eval_sample(spark, str(tmp_path)).collect()]
    assert got == [(i, keys[i]) for i in sorted(random.Random(42).sample(range(2500), 100))]
    few, n = evaluation.number_rows(spark.createDataFrame([(5,), (None,), (2,)], "id long"), "id", "i")
    assert n == 3 and sorted((x.i, x.id) for x in few.collect()) == [(0, None), (1, 2), (2, 5)]
    none, n = evaluation.number_rows(spark.range(0), "id", "i")
    assert n == 0 and none.count() == 0


def test_long_phrases_keep_all_readings(spark, tmp_path):
    readings = [f"r{k}" for k in range(90)]
    (tmp_path / "p.txt").write_text("字" * 90 + " " + " ".join(readings) + "\n好 hao3\n好好 hao3\n", "utf-8")
    got = {len(x.phrase): (x.readings, x.problem) for x in lexicons.phrases(spark, str(tmp_path / "p.txt")).collect()}
    assert got[90] == (readings, None) and got[1] == (["hao3"], None) and got[2][1] is not None


def test_sources(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"schema_version": 1, "cases": [
        {"id": "a", "mode": "mandarin", "text": "你好", "expected_native": ["ni2"]}, {"id": "b", "mode": "mandarin", "text": "你好", "targets": [{"span": [1, 2], "text": "好", "expected_native": ["hao3"]}]},
        {"id": "c", "mode": "mandarin", "text": "你好", "targets": [{"span": [1, 3], "text": "好", "expected_native": []}]}, {"id": "d", "mode": "x", "text": "你", "expected_native": []}, {"id": "e", "mode": "mandarin", "text": "你"},
        {"id": "f", "mode": "mandarin", "text": "你", "expected_native": []}, {"id": "f", "mode": "mandarin", "text": "你", "expected_native": []}]}))
    assert {r.id: r.problem for r in corpora.load_dataset(spark, str(tmp_path / "d.json")).collect()} == {"a": None, "b": None, "c": "span outside the text", "d": "unknown mode", "e": "expected_native or targets, exactly one", "f": "repeated id"}
    s = spark.createDataFrame([(0, "我▁长▁大"), (1, "bad")], "i long, value string")
    got = corpora.polyphones(s, spark.createDataFrame([(0, "zhang3")], "i long, value string")).orderBy("i").collect()
    assert got[0].id == "cpp-test-00001" and got[0].text == "我长大" and list(got[0].targets[0].span) == [1, 2] and got[1].problem
    files = spark.createDataFrame([("f1", "<sent_tag>\n你好/v/nei5hou2/\n，/w/VQ1/\n</sent_tag>\n<sent_tag>\nOK/x/ok/\n</sent_tag>\n<sent_tag>\n我/r/ngo5/\n</sent_tag>")], "name string, content string")
    cases = {r.id: r for r in corpora.cantonese(files).collect()}
    assert sorted(cases) == ["hkcancor-f1-0001", "hkcancor-f1-0003"] and cases["hkcancor-f1-0001"].text == "你好，"
    assert [(t.text, list(t.span), list(t.expected_native)) for t in cases["hkcancor-f1-0001"].targets] == [("你", [0, 1], ["nei5"]), ("好", [1, 2], ["hou2"])]
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("b.txt", "two")
        z.writestr("a.txt", "one")
    assert [(r.name, r.content) for r in corpora.archive_members(spark, str(tmp_path / "z.zip")).collect()] == [("a.txt", "one"), ("b.txt", "two")]
    (tmp_path / "dict.txt").write_text(";;; note\nRECORD  R AH0 K AO1 R D\nRECORD(2)  R EH1 K ER0 D\nAI  AY1\n")
    lex = lexicons.without(lexicons.pronouncing(spark, str(tmp_path / "dict.txt")), spark.createDataFrame([("AI",)], "value string"))
    assert [(r.word, list(r.readings)) for r in lex.collect()] == [("record", ["R AH0 K AO1 R D", "R EH1 K ER0 D"])]
    (tmp_path / "p.txt").write_text("差旅 chai1 lv3\n坏 a b\n")
    assert {r.phrase: r.problem is None for r in lexicons.phrases(spark, str(tmp_path / "p.txt")).collect()} == {"差旅": True, "坏": False}
    (tmp_path / "h.txt").write_text("# note\nREFUSE|A|B|V\nbad|x\n")
    assert {r.word: r.problem is None for r in lexicons.homographs(spark, str(tmp_path / "h.txt")).collect()} == {"refuse": True, "bad": False}
    base, over = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"), spark.createDataFrame([("b", 9)], "k string, v int")
    assert sorted(map(tuple, lexicons.with_overrides(base, over, "k").collect())) == [("a", 1), ("b", 9)]


def test_evaluation_driver(spark, tmp_path, capsys):
    cases = [
        {"id": "a", "mode": "mandarin", "text": "你好", "expected_native": ["ni2", "hao3"], "expected_normalized": "你好"}, {"id": "b", "mode": "mandarin", "text": "你好", "tone_sandhi": False, "targets": [{"span": [0, 1], "text": "你", "expected_native": ["ni3"]}, {"span": [1, 2], "text": "好", "expected_native": ["hao4"]}]},
        {"id": "c", "mode": "cantonese", "text": "你好", "expected_native": ["nei5", "hou2"], "expected_normalized": "您好"}, {"id": "d", "mode": "mandarin", "text": "龘好", "expected_native": ["da2", "hao3"]},
    ]
    path = tmp_path / "cases.json"
    path.write_text(json.dumps({"schema_version": 1, "name": "x", "cases": cases}))
    scores = {r.id: r for r in evaluate.evaluate(corpora.load_dataset(spark, str(path))).collect()}
    assert [(i, scores[i].exact, scores[i].normalized_exact, scores[i].targets, scores[i].targets_correct, scores[i].edits, scores[i].expected_units) for i in "abcd"] == [
        ("a", True, True, 1, 1, 0, 2), ("b", False, None, 2, 1, 1, 2), ("c", True, False, 1, 1, 0, 2), ("d", False, None, 1, 0, 2, 2)]
    assert scores["d"].error.startswith("BackendError") and list(scores["b"].target_results[1].actual_native) == ["hao3"]
    assert evaluate.main([str(path), "--json", "--fail-under", "0.9"], spark) == 1
    out = json.loads(capsys.readouterr().out)
    s = out["summary"]
    assert (s["cases"], s["completed"], s["normalized_cases"], s["normalized_exact_rate"], s["pronunciation_exact_rate"], s["target_exact_rate"], s["unit_error_rate"]) == (4, 3, 2, 0.5, 0.5, 0.6, 0.375)
    assert out["failure_count"] == 3 and [f["id"] for f in out["failures"]] == ["d", "b", "c"] and list(out["by_mode"]) == ["mandarin", "cantonese"]
    assert evaluate.main([str(path), "--max-cases", "2", "--seed", "1", "--fail-under", "0"], spark) == 0 and "of 2 cases" in capsys.readouterr().out
    for bad in ([], [str(path), "--corpus", "cpp"], ["--corpus", "cpp"], [str(path), "--max-cases", "0"], [str(path), "--fail-under", "2"]):
        with pytest.raises(SystemExit):
            evaluate.main(bad, spark)


def test_corpora_from_archives(spark, tmp_path, capsys):
    import hashlib
    import io
    import tarfile

    def tar(path, files):
        with tarfile.open(path, "w:gz") as t:
            for name, data in files.items():
                info = tarfile.TarInfo(name)
                info.size = len(data)
                t.addfile(info, io.BytesIO(data))

    sentences, labels = "我▁长▁大\n他▁行▁\n".encode(), b"zhang3\nxing2\n"
    tar(tmp_path / "p.tar.gz", {"x/data/test.sent": sentences, "x/data/test.lb": labels})
    cases = corpora.load_corpus(spark, "cpp", str(tmp_path / "p.tar.gz"))
    corpora.require_sound(cases)
    assert [(r.id, r.text, r.tone_sandhi, list(r.targets[0].span), list(r.targets[0].expected_native)) for r in cases.orderBy("i").collect()] == [("cpp-test-00001", "我长大", False, [1, 2], ["zhang3"]), ("cpp-test-00002", "他行", False, [1, 2], ["xing2"])]
    with pytest.raises(ValueError, match="another SHA-256"):
        corpora.load_polyphones(spark, str(tmp_path / "p.tar.gz"), {"test.lb": "0" * 64})
    tar(tmp_path / "q.tar.gz", {"test.sent": sentences})
    with pytest.raises(ValueError, match="no corpus file test.lb"):
        corpora.load_polyphones(spark, str(tmp_path / "q.tar.gz"))
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("utf8/FC-1.txt", "\ufeff<sent_tag>\n你好/v/nei5hou2/\n</sent_tag>\n")
        z.writestr("big5/FC-1.txt", "x")
    tar(tmp_path / "h.tar.gz", {"data/all.zip": inner.getvalue()})
    got = corpora.load_corpus(spark, "hkcancor", str(tmp_path / "h.tar.gz")).collect()
    assert [(r.id, r.text) for r in got] == [("hkcancor-FC-1-0001", "你好")]
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        for name, chars in (("b", "你好"), ("a", "我你"), ("B2", "他")):
            z.writestr(f"utf8/{name}.txt", "".join(f"<sent_tag>\n{c}/v/nei5/\n</sent_tag>\n" for c in chars))
    tar(tmp_path / "i.tar.gz", {"data/all.zip": inner.getvalue()})
    cases = corpora.load_corpus(spark, "hkcancor", str(tmp_path / "i.tar.gz"))
    assert [r.id.removeprefix("hkcancor-") for r in cases.orderBy("i").collect()] == ["B2-0001", "a-0001", "a-0002", "b-0001", "b-0002"]
    assert evaluate.main(["--corpus", "hkcancor", "--archive", str(tmp_path / "i.tar.gz"), "--max-cases", "3", "--seed", "1"], spark) == 0
    assert "of 3 cases" in capsys.readouterr().out
    with pytest.raises(ValueError, match="no corpus"):
        corpora.load_corpus(spark, "other", "x")
    data = (tmp_path / "p.tar.gz").read_bytes()
    digest = hashlib.sha256(data).hexdigest()
    corpora.verify_bytes(data, digest, "p")
    there = corpora.fetch(f"file://{tmp_path}/p.tar.gz", str(tmp_path / "cache"), "p.tgz", digest)
    assert corpora.fetch("file:///nowhere", str(tmp_path / "cache"), "p.tgz", digest) == there
    with pytest.raises(ValueError, match="another SHA-256"):
        corpora.fetch(f"file://{tmp_path}/p.tar.gz", str(tmp_path / "cache"), "other.tgz", "0" * 64)
    assert sorted(x.name for x in (tmp_path / "cache").iterdir()) == ["p.tgz"]
    (tmp_path / "bad.zip").write_bytes(b"")
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("a.txt", b"\xff\xfe\xfd")
    with pytest.raises(Exception, match="decode"):
        corpora.archive_members(spark, str(tmp_path / "bad.zip")).collect()
    (tmp_path / "h.txt").write_text("refuse|A|B|V\nbad|x\n")
    with pytest.raises(ValueError, match="four fields"):
        lexicons.require_sound(lexicons.homographs(spark, str(tmp_path / "h.txt")))
    (tmp_path / "c.txt").write_text("好 hao3,hao4,hao3,hao\n")
    assert lexicons.as_mapping(lexicons.readings_of_characters(spark, str(tmp_path / "c.txt"))) == {"好": ["hao3", "hao4"]}


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("你好 world\n")
    stream = spark.readStream.text(str(tmp_path / "in")).withColumnRenamed("value", "text")
    out = streaming.stream_results(streaming.stream_tokens(stream), Engine()).select(F.size("tokens").alias("n"), F.array_join("result.phones", " ").alias("phones"))
    query = out.writeStream.format("memory").queryName("converted").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [tuple(r) for r in spark.table("converted").collect()] == [(3, "n i2 h ao3 W ER1 L D")]


def test_command_line(capsys):
    from phonoweave.__main__ import main

    assert main(["你好 world"]) == 0 and capsys.readouterr().out.splitlines() == ["你\tn i2", "好\th ao3", "world\tW ER1 L D"]
    assert main(["你好", "--format", "json"]) == 0 and json.loads(capsys.readouterr().out)["phones"] == ["n", "i2", "h", "ao3"]
    assert main(["龘"]) == 1 and main(["a", "--mode", "x"]) == 2
