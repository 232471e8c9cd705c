"""Queries over syllables, phones, sandhi words and evaluation cases that are derived from the keys of orders and lineitem."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phonoweave.functions import phonetics as P
from phonoweave.functions.columns import spread
from phonoweave.operators import evaluation, sandhi
from phonoweave.plans import sql

BODIES = sorted(b for b, v in P.pinyin_table().items() if v[3])
CHARS = "不一好看月二你第"
VOWELS, CONSONANTS = sorted(P.EN_VOWELS), sorted(P.EN_CONSONANTS)


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey")


def pick(values: list[str], key: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(key, F.lit(len(values))).cast("int"))


def syllables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered pinyin: the body by order, the tone by line."""
    rows = P.pinyin_rows(spark).where(F.col("initial").isNotNull())
    numbered = F.broadcast(rows.join(F.broadcast(spark.createDataFrame(list(enumerate(BODIES)), "k int, body string")), "body"))
    keyed = items(spark, sf_dir).select("l_orderkey", "l_linenumber", F.pmod("l_orderkey", F.lit(len(BODIES))).cast("int").alias("k"), (F.pmod("l_linenumber", F.lit(5)) + 1).cast("string").alias("tone"))
    return keyed.join(numbered, "k").withColumn("native", F.concat("body", "tone"))


def split_pinyin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syllables(spark, sf_dir).select("l_orderkey", "l_linenumber", "native", "loose_initial", "loose_final", "initial", "final", "tone")


def canonical_pinyin(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(*k, *v) for k, v in P.canonical_pinyin().items()]
    table = spark.createDataFrame(rows, "loose_initial string, loose_final string, ci string, cf string")
    return syllables(spark, sf_dir).join(F.broadcast(table), ["loose_initial", "loose_final"]).groupBy("ci", "cf").agg(F.count("*").alias("n"))


def pinyin_ipa(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = syllables(spark, sf_dir)
    contour = P.tone_contour("cmn", F.col("tone"))
    ipa = P.pinyin_ipa(F.col("initial"), F.col("final"))
    rendered = F.concat(ipa, P.tone_letters(contour))
    return s.select("l_orderkey", "l_linenumber", ipa.alias("ipa"), contour.alias("contour"), rendered.alias("rendered"))


def jyutping(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.concat(pick(P.JYUTPING_ONSETS, F.col("l_orderkey")), pick(P.JYUTPING_FINALS, F.col("l_partkey")), (F.pmod("l_linenumber", F.lit(6)) + 1).cast("string"))
    return items(spark, sf_dir).select("l_orderkey", "l_linenumber", value.alias("native"))


def split_jyutping(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = jyutping(spark, sf_dir).withColumn("p", P.split_jyutping_column(F.col("native")))
    return j.select("l_orderkey", "l_linenumber", "native", "p.onset", "p.final", "p.tone")


def jyutping_ipa(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = split_jyutping(spark, sf_dir)
    f = P.split_final_column(F.col("final"))
    return j.select(
        "l_orderkey", "l_linenumber", f["nucleus"].alias("nucleus"), f["coda"].alias("coda"), P.jyutping_ipa(F.col("onset"), F.col("final")).alias("ipa"),
        P.tone_letters(P.tone_contour("yue", F.col("tone"))).alias("letters"),
    )


def arpabet(spark: SparkSession, sf_dir: str) -> DataFrame:
    vowel = F.concat(pick(VOWELS, F.col("l_partkey")), F.pmod("l_linenumber", F.lit(3)).cast("string"))
    phone = F.when(F.pmod("l_orderkey", F.lit(2)) == 0, vowel).otherwise(pick(CONSONANTS, F.col("l_partkey")))
    i = items(spark, sf_dir).select("l_orderkey", "l_linenumber", phone.alias("phone")).withColumn("p", P.split_arpabet(F.col("phone")))
    return i.select("l_orderkey", "l_linenumber", "phone", "p.base", "p.stress", P.arpabet_ipa(F.col("p.base"), F.col("p.stress")).alias("ipa"))


def with_tone(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = syllables(spark, sf_dir)
    return s.select("l_orderkey", "l_linenumber", P.with_tone(F.col("native"), (F.lit(6) - F.col("tone").cast("int")).cast("string")).alias("native"))


def render_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phones with the tone on the last one."""
    s = syllables(spark, sf_dir)
    return s.select("l_orderkey", "l_linenumber", P.join_segments(F.col("initial"), F.concat("final", "tone")).alias("phones"))


def sandhi_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two- and three-character words with tones."""
    n = F.pmod("l_linenumber", F.lit(2)) + 2
    chars = F.slice(F.array(pick(list(CHARS), F.col("l_orderkey")), pick(list(CHARS), F.floor(F.col("l_partkey") / 3)), pick(list(CHARS), F.floor(F.col("l_orderkey") / 8))), 1, n.cast("int"))
    digits = lambda key: (F.pmod(key, F.lit(4)) + 1).cast("string")
    tones = F.slice(F.array(digits(F.col("l_partkey")), digits(F.floor(F.col("l_partkey") / 4)), digits(F.floor(F.col("l_partkey") / 16))), 1, n.cast("int"))
    return items(spark, sf_dir).select("l_orderkey", "l_linenumber", chars.alias("chars"), tones.alias("tones"))


def _sandhi(rule):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        w = sandhi_words(spark, sf_dir)
        return w.select("l_orderkey", "l_linenumber", F.array_join("chars", "").alias("word"), F.array_join("tones", "").alias("before"), F.array_join(rule(F.col("chars"), F.col("tones")), "").alias("after"))

    return run


def sandhi_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules over runs of two words."""
    w = spread(sandhi_words(spark, sf_dir)).select("l_orderkey", "l_linenumber", F.array_join("chars", "").alias("word"), "tones")
    runs = w.withColumn("run", F.array(F.struct(F.col("word").alias("text"), F.lit("v").alias("pos"), "tones"), F.struct(F.lit("好").alias("text"), F.lit("a").alias("pos"), F.array(F.lit("3")).alias("tones"))))
    return runs.select("l_orderkey", "l_linenumber", "word", F.array_join(sandhi.run_sandhi(F.col("run")), "").alias("after"))


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation cases: the digits of two keys as expected and actual units, an error now and then."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    units = lambda c: P.letters(c.cast("string"))
    mode = F.when(F.pmod("o_custkey", F.lit(3)) == 0, "cantonese").otherwise("mandarin")
    error = F.when(F.pmod("o_orderkey", F.lit(50)) == 0, "BackendError: no reading")
    actual = F.when(F.pmod("o_custkey", F.lit(5)) == 0, F.col("o_orderkey")).otherwise(F.col("o_custkey"))
    return o.select(F.col("o_orderkey").alias("id"), mode.alias("mode"), units(F.col("o_orderkey")).alias("expected"), units(actual).alias("actual"), error.alias("error"))


def edit_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases(spark, sf_dir).select("id", evaluation.edit_distance(F.col("expected"), F.col("actual")).alias("edits"))


def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.summarize(evaluation.score_cases(cases(spark, sf_dir)))


def eval_by_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.summarize(evaluation.score_cases(cases(spark, sf_dir)), "mode")


def top_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.failures(evaluation.score_cases(cases(spark, sf_dir))).select("id", "mode", "error", "edits")


def target_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of an order that overlap a target span: an equi-join on the order with the span condition on top."""
    i = items(spark, sf_dir)
    units = i.select("l_orderkey", "l_linenumber", F.col("l_linenumber").alias("s"), (F.col("l_linenumber") + 1 + F.pmod("l_partkey", F.lit(2))).alias("e"))
    targets = i.select("l_orderkey", F.pmod("l_partkey", F.lit(6)).alias("ts")).groupBy("l_orderkey").agg(F.min("ts").alias("ts")).withColumn("te", F.col("ts") + 2)
    hit = units.join(targets, "l_orderkey").where(evaluation.overlaps(F.col("s"), F.col("e"), F.col("ts"), F.col("te")))
    return hit.groupBy("l_orderkey").agg(F.count("*").alias("units"), F.min("l_linenumber").cast("long").alias("first"))


def eval_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """100 cases of all, by their position in the order of id."""
    numbered, n = evaluation.number_rows(cases(spark, sf_dir).select("id", "mode"), "id", "i")
    return evaluation.sample(spark, numbered, "i", n, 100, 42).select("i", "id", "mode")


def row_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The position of every line in the order of a text key of few values, parted by two others."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_returnflag", "l_orderkey", "l_linenumber")
    return evaluation.number_rows(lines, ["l_returnflag", "l_orderkey", "l_linenumber"], "place")[0]


_KEYS = "l_orderkey, l_linenumber"
_SYLLABLES = f"""syl AS (SELECT l_orderkey, l_linenumber, body, CAST(l_linenumber % 5 + 1 AS VARCHAR) AS tone FROM lineitem JOIN (SELECT * FROM {sql.values(enumerate(BODIES), "k, body")}) ON l_orderkey % {len(BODIES)} = k),
  loose AS (SELECT *, body || tone AS native, CASE WHEN body IN ('m', 'n', 'ng', 'hm', 'hng') THEN '' ELSE regexp_extract(body, '^(zh|ch|sh|[bpmfdtnlgkhjqxrzcsyw])?', 0) END AS li FROM syl),
  lf AS (SELECT *, substr(body, length(li) + 1) AS lf FROM loose),
  strict AS (SELECT *, CASE WHEN li IN ('y', 'w') THEN '' ELSE li END AS i, CASE
    WHEN li = 'y' AND lf IN ('u', 'uan', 'ue', 'un') THEN 'v' || substr(lf, 2)
    WHEN li = 'y' AND lf IN ('i', 'in', 'ing') THEN lf
    WHEN li = 'y' THEN 'i' || lf
    WHEN li = 'w' AND lf = 'u' THEN 'u' WHEN li = 'w' THEN 'u' || lf
    WHEN li IN ('j', 'q', 'x') AND lf[1] = 'u' THEN 'v' || substr(lf, 2)
    WHEN lf = 'iu' THEN 'iou' WHEN lf = 'ui' THEN 'uei' WHEN lf = 'un' THEN 'uen' ELSE lf END AS f FROM lf)"""
_CMN_IPA = f"""ipa AS (SELECT *, coalesce(w.s, trim(a.s || ' ' || coalesce(CASE WHEN f = 'i' THEN p.s END, b.s))) AS ipa, c.s AS contour FROM strict
  LEFT JOIN (SELECT * FROM {sql.values(P.CMN_WHOLE.items(), "k, s")}) w ON w.k = i || f LEFT JOIN (SELECT * FROM {sql.values(P.CMN_INITIALS.items(), "k, s")}) a ON a.k = i
  LEFT JOIN (SELECT * FROM {sql.values(P.CMN_APICAL.items(), "k, s")}) p ON p.k = i LEFT JOIN (SELECT * FROM {sql.values(P.CMN_FINALS.items(), "k, s")}) b ON b.k = f
  LEFT JOIN (SELECT * FROM {sql.values(P.CMN_TONES.items(), "k, s")}) c ON c.k = tone)"""


def _letters(c: str) -> str:
    return f"translate({c}, '12345', '˩˨˧˦˥')"


def _list(values: list[str]) -> str:
    return "[" + ", ".join(sql.text(v) for v in values) + "]"


_JYUT = f"""jyut AS (SELECT l_orderkey, l_linenumber, {_list(P.JYUTPING_ONSETS)}[l_orderkey % 20 + 1] || {_list(P.JYUTPING_FINALS)}[l_partkey % {len(P.JYUTPING_FINALS)} + 1] || CAST(l_linenumber % 6 + 1 AS VARCHAR) AS native FROM lineitem),
  bodies AS (SELECT DISTINCT left(native, -1) AS body FROM jyut),
  cut AS (SELECT body, arg_max(o, length(o)) AS onset FROM bodies, (SELECT * FROM {sql.values([(o,) for o in P.JYUTPING_ONSETS], "o")}) WHERE starts_with(body, o) AND substr(body, length(o) + 1) IN ({", ".join(map(sql.text, P.JYUTPING_FINALS))}) GROUP BY body),
  parts AS (SELECT {_KEYS}, native, onset, substr(body, length(onset) + 1) AS final, right(native, 1) AS tone FROM jyut JOIN cut ON left(native, -1) = body)"""
_YUE = f"""finals AS (SELECT f, arg_max(n, length(n)) AS nucleus FROM (SELECT * FROM {sql.values([(f,) for f in P.JYUTPING_FINALS], "f")}), (SELECT * FROM {sql.values([(n,) for n in P.JYUTPING_NUCLEI], "n")})
    WHERE starts_with(f, n) AND substr(f, length(n) + 1) IN ({", ".join(map(sql.text, P.JYUTPING_CODAS))}) GROUP BY f),
  pairs AS (SELECT *, nucleus, substr(final, length(nucleus) + 1) AS coda FROM parts JOIN finals ON f = final)"""
_WORDS = f"""chars AS (SELECT {_KEYS}, l_linenumber % 2 + 2 AS n, substr('{CHARS}', CAST(l_orderkey % 8 + 1 AS INTEGER), 1) AS a, substr('{CHARS}', CAST(l_partkey // 3 % 8 + 1 AS INTEGER), 1) AS b, substr('{CHARS}', CAST(l_orderkey // 8 % 8 + 1 AS INTEGER), 1) AS c0,
    CAST(l_partkey % 4 + 1 AS VARCHAR) AS x, CAST(l_partkey // 4 % 4 + 1 AS VARCHAR) AS y, CAST(l_partkey // 16 % 4 + 1 AS VARCHAR) AS z0 FROM lineitem),
  w AS (SELECT *, CASE WHEN n = 3 THEN c0 ELSE '' END AS c, CASE WHEN n = 3 THEN z0 ELSE '' END AS z FROM chars)"""


def _word_sql(after: str) -> str:
    return f"WITH {_WORDS} SELECT {_KEYS}, a || b || c AS word, x || y || z AS before, {after} AS after FROM w"


def _yi(char: str, tone: str, previous: str, following: str, next_tone: str) -> str:
    digits = "'零', '一', '二', '三', '四', '五', '六', '七', '八', '九', '十', '百', '千', '万', '亿'"
    return f"CASE WHEN {char} <> '一' THEN {tone} WHEN {previous} IN ({digits}, '第', '初') OR {following} IN ({digits}) OR {following} IN ('', '月', '班', '连', '楼') THEN '1' WHEN {next_tone} = '4' THEN '2' ELSE '4' END"


#: No listed word is made of CHARS, so words are whole; 好 joins a word of two that ends in a third tone.
_CASCADE = f"""WITH {_WORDS},
  m AS (SELECT *, n = 2 AND y = '3' AS joined FROM w),
  j AS (SELECT {_KEYS}, a || b || c AS word, a, b, CASE WHEN joined THEN '好' ELSE c END AS c, CASE WHEN joined THEN 3 ELSE n END AS n, x, y, CASE WHEN joined THEN '3' ELSE z END AS z, joined FROM m),
  bu AS (SELECT * REPLACE (CASE WHEN a = '不' AND y = '4' AND NOT (n = 3 AND b = '不') THEN '2' ELSE x END AS x, CASE WHEN n = 3 AND b = '不' THEN '5' WHEN b = '不' AND z = '4' THEN '2' ELSE y END AS y) FROM j),
  yi AS (SELECT *, n = 3 AND b = '一' AND a = c AS same, {_yi("a", "x", "''", "b", "y")} AS x1, {_yi("b", "y", "a", "c", "z")} AS y1, {_yi("c", "z", "b", "''", "''")} AS z1 FROM bu),
  e AS (SELECT {_KEYS}, word, n, joined, CASE WHEN same THEN x ELSE x1 END AS x, CASE WHEN same THEN '5' WHEN n = 2 AND a = b THEN '5' ELSE y1 END AS y, CASE WHEN n = 2 THEN '' WHEN same THEN z ELSE z1 END AS z FROM yi)
  SELECT {_KEYS}, word, CASE WHEN x = '3' AND y = '3' THEN '2' ELSE x END || CASE WHEN n = 3 AND y = '3' AND z = '3' THEN '2' ELSE y END || z || CASE WHEN joined THEN '' ELSE '3' END AS after FROM e"""
_CASES = """cases AS (SELECT o_orderkey AS id, CASE WHEN o_custkey % 3 = 0 THEN 'cantonese' ELSE 'mandarin' END AS mode, CAST(o_orderkey AS VARCHAR) AS expected,
    CAST(CASE WHEN o_custkey % 5 = 0 THEN o_orderkey ELSE o_custkey END AS VARCHAR) AS actual, CASE WHEN o_orderkey % 50 = 0 THEN 'BackendError: no reading' END AS error FROM orders),
  scored AS (SELECT *, CASE WHEN error IS NOT NULL THEN length(expected) ELSE levenshtein(expected, actual) END AS edits FROM cases),
  judged AS (SELECT *, error IS NULL AND edits = 0 AS exact FROM scored)"""
_SUMMARY = """count(*) AS cases, count(*) FILTER (error IS NULL) AS completed, count(*) FILTER (exact) AS correct, CAST(coalesce(sum(edits), 0) AS BIGINT) AS unit_edits, CAST(coalesce(sum(length(expected)), 0) AS BIGINT) AS units,
  coalesce(round(count(*) FILTER (exact) / nullif(count(*), 0), 6), 0.0) AS accuracy, coalesce(round(sum(edits) / nullif(sum(length(expected)), 0), 6), 0.0) AS unit_error_rate"""

QUERIES = {
    "split_pinyin": split_pinyin, "canonical_pinyin": canonical_pinyin, "pinyin_ipa": pinyin_ipa, "split_jyutping": split_jyutping, "jyutping_ipa": jyutping_ipa,
    "arpabet_ipa": arpabet, "with_tone": with_tone, "render_native": render_native, "bu_sandhi": _sandhi(sandhi.bu_rule), "yi_sandhi": _sandhi(sandhi.yi_rule),
    "third_tone_two": _sandhi(lambda _, t: sandhi.third_rule(t)), "sandhi_cascade": sandhi_cascade, "edit_distance": edit_distance, "eval_summary": eval_summary,
    "eval_by_mode": eval_by_mode, "top_failures": top_failures, "target_overlap": target_overlap, "eval_sample": eval_sample, "row_numbers": row_numbers,
}

ORACLE_SQL = {
    "row_numbers": "SELECT l_returnflag, l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_returnflag, l_orderkey, l_linenumber) - 1 AS place FROM lineitem",
    "split_pinyin": f"WITH {_SYLLABLES} SELECT {_KEYS}, native, li AS loose_initial, lf AS loose_final, i AS initial, f AS final, tone FROM strict",
    "canonical_pinyin": f"WITH {_SYLLABLES} SELECT i AS ci, f AS cf, count(*) AS n FROM strict GROUP BY ALL",
    "pinyin_ipa": f"WITH {_SYLLABLES}, {_CMN_IPA} SELECT {_KEYS}, ipa, contour, ipa || {_letters('contour')} AS rendered FROM ipa",
    "split_jyutping": f"WITH {_JYUT} SELECT {_KEYS}, native, onset, final, tone FROM parts",
    "jyutping_ipa": f"""WITH {_JYUT}, {_YUE} SELECT {_KEYS}, nucleus, coda, concat_ws(' ', nullif(o.s, ''), coalesce(nx.s, n.s), nullif(coalesce(cx.s, c.s), '')) AS ipa, {_letters('t.s')} AS letters FROM pairs
      JOIN (SELECT * FROM {sql.values(P.YUE_ONSETS.items(), "k, s")}) o ON o.k = onset JOIN (SELECT * FROM {sql.values(P.YUE_NUCLEI.items(), "k, s")}) n ON n.k = nucleus JOIN (SELECT * FROM {sql.values(P.YUE_CODAS.items(), "k, s")}) c ON c.k = coda
      LEFT JOIN (SELECT * FROM {sql.values(P.YUE_NUCLEUS_OVERRIDES.items(), "k, s")}) nx ON nx.k = nucleus || '+' || coda LEFT JOIN (SELECT * FROM {sql.values(P.YUE_CODA_OVERRIDES.items(), "k, s")}) cx ON cx.k = nucleus || '+' || coda
      JOIN (SELECT * FROM {sql.values(P.YUE_TONES.items(), "k, s")}) t ON t.k = tone""",
    "arpabet_ipa": f"""WITH p AS (SELECT {_KEYS}, CASE WHEN l_orderkey % 2 = 0 THEN {_list(VOWELS)}[l_partkey % {len(VOWELS)} + 1] ELSE {_list(CONSONANTS)}[l_partkey % {len(CONSONANTS)} + 1] END AS base, CASE WHEN l_orderkey % 2 = 0 THEN CAST(l_linenumber % 3 AS INTEGER) END AS stress FROM lineitem)
      SELECT {_KEYS}, base || coalesce(CAST(stress AS VARCHAR), '') AS phone, base, stress, CASE WHEN stress = 0 AND base = 'AH' THEN 'ə' WHEN stress = 0 AND base = 'ER' THEN 'ɚ' ELSE s END AS ipa FROM p JOIN (SELECT * FROM {sql.values([*P.EN_VOWELS.items(), *P.EN_CONSONANTS.items()], "k, s")}) ON k = base""",
    "with_tone": f"WITH {_SYLLABLES} SELECT {_KEYS}, body || CAST(6 - CAST(tone AS INTEGER) AS VARCHAR) AS native FROM syl",
    "render_native": f"WITH {_SYLLABLES} SELECT {_KEYS}, trim(i || ' ' || f || tone) AS phones FROM strict",
    "sandhi_cascade": _CASCADE,
    "bu_sandhi": _word_sql("CASE WHEN n = 3 AND b = '不' THEN x || '5' || z ELSE (CASE WHEN a = '不' AND y = '4' THEN '2' ELSE x END) || (CASE WHEN b = '不' AND z = '4' THEN '2' ELSE y END) || z END"),
    "yi_sandhi": _word_sql(f"CASE WHEN n = 3 AND b = '一' AND a = c THEN x || '5' || z ELSE ({_yi('a', 'x', chr(39) * 2, 'b', 'y')}) || ({_yi('b', 'y', 'a', 'c', 'z')}) || (CASE WHEN n = 3 THEN {_yi('c', 'z', 'b', chr(39) * 2, chr(39) * 2)} ELSE '' END) END"),
    "third_tone_two": _word_sql("CASE WHEN n = 2 AND x = '3' AND y = '3' THEN '23' ELSE x || y || z END"),
    "edit_distance": f"WITH {_CASES} SELECT id, CAST(levenshtein(expected, actual) AS INTEGER) AS edits FROM cases",
    "eval_summary": f"WITH {_CASES} SELECT {_SUMMARY} FROM judged",
    "eval_by_mode": f"WITH {_CASES} SELECT mode, {_SUMMARY} FROM judged GROUP BY mode",
    "top_failures": f"WITH {_CASES} SELECT id, mode, error, CAST(edits AS INTEGER) AS edits FROM judged WHERE NOT exact ORDER BY error IS NULL, id LIMIT 100",
    "target_overlap": f"""WITH u AS (SELECT l_orderkey, l_linenumber, l_linenumber AS s, l_linenumber + 1 + l_partkey % 2 AS e FROM lineitem), t AS (SELECT l_orderkey, min(l_partkey % 6) AS ts FROM lineitem GROUP BY 1)
      SELECT u.l_orderkey, count(*) AS units, CAST(min(l_linenumber) AS BIGINT) AS first FROM u JOIN t ON u.l_orderkey = t.l_orderkey WHERE s < ts + 2 AND ts < e GROUP BY 1""",
}
