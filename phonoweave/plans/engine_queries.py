"""Queries that run the whole engine over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phonoweave.functions import lexicon
from phonoweave.functions import phonetics as P
from phonoweave.functions import text as texts
from phonoweave.operators import spelling
from phonoweave.plans import engine, sql
from phonoweave.plans.text_queries import HAN, LETTERS, _english_sql, dealt, mixed


def convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phones of every mixed text; texts without an ASCII spelling carry an error."""
    done = mixed(spark, sf_dir).select("doc_id", engine.Engine(unknown="preserve").summary(F.col("text")).alias("r"))
    return done.select("doc_id", "r.n_tokens", "r.n_phones", F.md5("r.phones").alias("phones"), "r.error")


def result_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = engine.Engine(unknown="preserve", spell_numbers=False).failures(dealt(spark, sf_dir))
    return bad.select("doc_id", F.split_part("error", F.lit(":"), F.lit(1)).alias("kind"))


def result_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text sink, line by line, with how often each line occurs."""
    lines = engine.Engine(unknown="preserve", spell_numbers=False).lines(F.col("text"))
    return dealt(spark, sf_dir).select(F.explode_outer(lines).alias("value")).where("value is not null").groupBy("value").agg(F.count("*").alias("n"))


def compatibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = dealt(spark, sf_dir).select("doc_id", texts.normalize_compatibility(F.col("text")).alias("r"))
    return n.select("doc_id", F.md5("r.text").alias("normalized"), (F.size("r.sources") == F.length("r.text")).alias("aligned"))


def name_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of the English letters of nations' names to their regions' names, spelled by sound."""
    n, r = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "region"))
    pairs = n.join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"]).select("n_nationkey", F.initcap(F.col("n_name")).alias("left"), F.initcap(F.col("r_name")).alias("right"))
    return engine.Engine().compare(pairs, "left", "right").select("n_nationkey", F.round("similarity.score", 6).alias("score"), F.size("similarity.alignment").alias("steps"))


def heteronyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters with more than one reading, in order."""
    return lexicon.han(spark).where(F.size("mandarin") > 1).select("char", F.array_join("mandarin", ",").alias("readings"))


#: Readings of the first backend, and of the one that answers where it fails: 不 is known to the second alone.
FIRST, THEN = {"好": "hao3", "中": "zhong1"}, {"好": "hao4", "中": "zhong4", "不": "bu4"}


def fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Han texts made of three letters of the documents: the second backend reads those that the first one can't read."""
    han = F.translate(F.regexp_replace("text", f"[^{LETTERS} ]", ""), LETTERS, HAN)
    chosen = engine.Engine(han={c: [r] for c, r in FIRST.items()}, backend="dictionary", fallback=lambda word: [THEN[c] for c in word], tone_sandhi=False)
    done = chosen.summarize(dealt(spark, sf_dir).select("doc_id", han.alias("han")), "han", "r")
    return done.select("doc_id", F.col("r_by").alias("answered"), F.md5("r.phones").alias("phones"), "r.n_phones", F.split_part("r.error", F.lit(":"), F.lit(1)).alias("error"))


QUERIES = {"fallback": fallback, "convert": convert, "result_errors": result_errors, "result_lines": result_lines, "compatibility_norm": compatibility, "name_similarity": name_similarity, "heteronyms": heteronyms}

_OTHER = texts.latin_tables()[2]


def _lines_sql() -> str:
    """Words outside the lexicon by the fewest known parts, or else by spellings, longest first."""
    rules = sql.values(spelling.RULES.items(), "spelling, sounds")
    pattern = "|".join(sorted(spelling.RULES, key=len, reverse=True))
    others = sql.values([(w, r[1]) for w, r in lexicon.HOMOGRAPHS.items()], "h, other")
    return _english_sql(
        f""", oov AS (SELECT DISTINCT lower(word) AS word FROM done WHERE route = 'segment'),
      seg AS (SELECT word, 0 AS place, []::INTEGER[] AS cuts FROM oov UNION ALL
        SELECT s.word, CAST(s.place + length(l.w) AS INTEGER), list_append(s.cuts, s.place) FROM seg s JOIN lex l ON length(l.w) >= 2 AND substr(s.word, s.place + 1, length(l.w)) = l.w),
      best AS (SELECT word, arg_min(list_append(cuts, place), (len(cuts), list_reverse(cuts))) AS cuts FROM seg WHERE place = length(word) AND len(cuts) > 1 GROUP BY word),
      pieces AS (SELECT word, unnest(range(1, len(cuts))) AS k, unnest(list_transform(range(1, len(cuts)), lambda i: substr(word, cuts[i] + 1, cuts[i + 1] - cuts[i]))) AS part FROM best),
      known AS (SELECT word, string_agg(coalesce(other, reading), ' ' ORDER BY k) AS sounds FROM pieces JOIN lex ON part = w LEFT JOIN (SELECT * FROM {others}) ON h = part GROUP BY word),
      bare AS (SELECT word, regexp_replace(word, '[^a-z]', '', 'g') AS b FROM oov WHERE word NOT IN (SELECT word FROM known)),
      shorter AS (SELECT word, CASE WHEN regexp_matches(b, '.[^aeiou]e$') THEN left(b, length(b) - 1) ELSE b END AS b FROM bare),
      spelled_out AS (SELECT word, unnest(regexp_extract_all(b, '{pattern}')) AS g, generate_subscripts(regexp_extract_all(b, '{pattern}'), 1) AS k FROM shorter),
      sounded AS (SELECT word, string_split(string_agg(sounds, ' ' ORDER BY k), ' ') AS p FROM spelled_out JOIN (SELECT * FROM {rules}) ON g = spelling GROUP BY word),
      stressed AS (SELECT word, p, list_position(list_transform(p, lambda x: right(x, 1) = '1'), true) AS f FROM sounded),
      read_ AS (SELECT word, sounds FROM known UNION ALL SELECT word, array_to_string(list_transform(p, lambda x, i: CASE WHEN i > f AND right(x, 1) = '1' THEN left(x, length(x) - 1) || '0' ELSE x END), ' ') FROM stressed)
      SELECT tok || chr(9) || coalesce(native, sounds) AS value, count(*) AS n FROM done d JOIN toks t ON t.doc_id = d.doc_id AND t.id = d.id LEFT JOIN read_ r ON r.word = lower(d.word)
      WHERE d.doc_id NOT IN (SELECT doc_id FROM documents WHERE regexp_matches(text, '[{_OTHER}]')) AND coalesce(native, sounds) IS NOT NULL GROUP BY value"""
    ).replace("WITH ", "WITH RECURSIVE ", 1)


def _fallback_sql() -> str:
    def said(readings: dict) -> str:
        cases = " ".join(f"WHEN '{c}' THEN '{' '.join(P.split_pinyin(r, True)[:2])}{r[-1]}'" for c, r in readings.items())
        return f"array_to_string(list_transform(string_split(replace(han, ' ', ''), ''), lambda c: CASE c {cases} END), ' ')"

    return f"""WITH t AS (SELECT doc_id, translate(regexp_replace(text, '[^{LETTERS} ]', '', 'g'), '{LETTERS}', '{HAN}') AS han FROM documents),
      r AS (SELECT doc_id, CASE WHEN han IS NULL THEN NULL WHEN contains(han, '不') THEN 'then' ELSE 'first' END AS answered, han FROM t)
      SELECT doc_id, answered, md5(CASE WHEN han IS NULL OR trim(han) = '' THEN '' WHEN answered = 'then' THEN {said(THEN)} ELSE {said(FIRST)} END) AS phones,
        CAST(2 * length(replace(coalesce(han, ''), ' ', '')) AS INTEGER) AS n_phones, CASE WHEN han IS NULL THEN 'TypeError' END AS error FROM r"""


ORACLE_SQL = {
    "fallback": _fallback_sql(),
    "result_lines": _lines_sql(),
    "result_errors": f"SELECT doc_id, 'NormalizationError' AS kind FROM documents WHERE regexp_matches(text, '[{_OTHER}]')",
    "compatibility_norm": "SELECT doc_id, md5(nfc_normalize(text)) AS normalized, true AS aligned FROM documents",
    "heteronyms": f"SELECT char, readings FROM {sql.values([(c, m) for c, (m, _) in lexicon.HAN_SEED.items()], 'char, readings')} WHERE contains(readings, ',')",
}
