"""Queries over document texts: tokens, projections, folding, lexicon lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phonoweave.functions import lexicon, scripts
from phonoweave.functions import text as texts
from phonoweave.functions.columns import small_batches, spread
from phonoweave.operators import english
from phonoweave.operators import tokens as T
from phonoweave.plans import sql

#: Documents hold no Han characters: letters are replaced to get mixed texts.
LETTERS, HAN = "ouq", "好中不"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def dealt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents for work that costs more than a shuffle of a small table, in small batches."""
    small_batches(spark)
    return spread(documents(spark, sf_dir))


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(spark, sf_dir).select("doc_id", F.translate("text", LETTERS, HAN).alias("text"))


PLAIN_SQL = "SELECT doc_id, text FROM documents"
MIXED_SQL = f"SELECT doc_id, translate(text, '{LETTERS}', '{HAN}') AS text FROM documents"


def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.explode_tokens(mixed(spark, sf_dir), columns=("id", "text", "start", "end", "language", "kind", "boundary"))
    return t.select("doc_id", "id", F.col("text").alias("tok"), F.col("start").alias("start_at"), F.col("end").alias("end_at"), "language", "kind", F.col("boundary").alias("boundary_before"))


def token_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.explode_tokens(dealt(spark, sf_dir), keep=(), columns=("start", "end", "language", "kind"))
    return t.groupBy("language", "kind").agg(F.count("*").alias("tokens"), F.sum(F.col("end") - F.col("start")).alias("chars"))


def boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.explode_tokens(mixed(spark, sf_dir), columns=("boundary",)).groupBy("doc_id", "boundary").agg(F.count("*").alias("n"))


def lossless(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    return d.select("doc_id", F.md5(F.array_join(T.token_texts(F.col("text")), "")).alias("joined"), (F.array_join(T.token_texts(F.col("text")), "") == F.col("text")).alias("same"))


def _projection(target: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = mixed(spark, sf_dir).select("doc_id", T.projection(F.col("text"), target).alias("p"))
        count = lambda kind: F.size(F.filter("p", lambda t: t["kind"] == kind))
        return p.select(
            "doc_id", F.md5(T.projection_text(F.col("p"))).alias("projected"), count("target").alias("targets"), count("placeholder").alias("islands"),
            F.aggregate("p", F.lit(0), lambda a, t: a + F.when(t["kind"] == "placeholder", F.size(t["source_ids"])).otherwise(0)).alias("covered"),
        )

    return run


def _projection_sql(target: str) -> str:
    foreign = "en" if target == "zh" else "zh"
    mark = scripts.PLACEHOLDERS[foreign]
    return f"""WITH {sql.tokens(MIXED_SQL)},
      marked AS (SELECT *, language = '{foreign}' OR (language = 'space' AND coalesce(l1 = '{foreign}', false) AND coalesce(n1 = '{foreign}', false)) AS inside FROM toks),
      starts AS (SELECT *, inside AND NOT coalesce(lag(inside) OVER (PARTITION BY doc_id ORDER BY id), false) AS opens FROM marked)
      SELECT d.doc_id, coalesce(md5(string_agg(CASE WHEN opens THEN '{mark}' WHEN inside THEN '' ELSE tok END, '' ORDER BY id)), md5('')) AS projected,
        CAST(count(*) FILTER (language = '{target}') AS INTEGER) AS targets, CAST(count(*) FILTER (opens) AS INTEGER) AS islands, CAST(count(*) FILTER (inside) AS INTEGER) AS covered
      FROM documents d LEFT JOIN starts s ON d.doc_id = s.doc_id GROUP BY d.doc_id"""


def _characters(keep: bool):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = mixed(spark, sf_dir).select("doc_id", T.character_projection(F.col("text"), "zh", "，", keep).alias("c"))
        return c.select("doc_id", F.md5(F.array_join("c.char", "")).alias("chars"), F.size("c").alias("n"), F.size(F.array_compact("c.place")).alias("sourced"))

    return run


def _characters_sql(keep: bool) -> str:
    body = (
        "CASE WHEN opens THEN '，' WHEN inside THEN '' ELSE tok END"
        if keep
        else "CASE WHEN language = 'zh' THEN tok WHEN inside AND NOT opens THEN '' WHEN coalesce(before, 'zh') = 'zh' THEN '，' ELSE '' END"
    )
    return f"""WITH {sql.tokens(MIXED_SQL)},
      marked AS (SELECT *, language = 'en' OR (language = 'space' AND coalesce(l1 = 'en', false) AND coalesce(n1 = 'en', false)) AS inside, lag(language) OVER (PARTITION BY doc_id ORDER BY id) AS before FROM toks),
      starts AS (SELECT *, inside AND NOT coalesce(lag(inside) OVER (PARTITION BY doc_id ORDER BY id), false) AS opens FROM marked),
      pieces AS (SELECT doc_id, id, language, tok, {body} AS piece FROM starts)
      SELECT d.doc_id, coalesce(md5(string_agg(piece, '' ORDER BY id)), md5('')) AS chars, CAST(coalesce(sum(length(piece)), 0) AS INTEGER) AS n,
        CAST(coalesce(sum(CASE WHEN language = 'zh' THEN length(tok) END), 0) AS INTEGER) AS sourced FROM documents d LEFT JOIN pieces p ON d.doc_id = p.doc_id GROUP BY d.doc_id"""


def latin_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts.first_unfoldable(dealt(spark, sf_dir))


def fold_diacritics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(spark, sf_dir).select("doc_id", F.md5(texts.fold_latin(F.col("text"))).alias("folded"))


def apostrophes(spark: SparkSession, sf_dir: str) -> DataFrame:
    curly = F.translate("text", "'e", "’‘")
    return documents(spark, sf_dir).select("doc_id", F.md5(texts.unify_apostrophes(curly)).alias("unified"))


def han_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct Han characters of each text with their readings."""
    chars = F.array_distinct(F.regexp_extract_all("text", F.lit(f"[{scripts.HAN}]"), F.lit(0)))
    d = mixed(spark, sf_dir).select("doc_id", F.explode(chars).alias("char"))
    return d.join(F.broadcast(lexicon.han(spark)), "char", "left").select("doc_id", "char", F.array_join("mandarin", ",").alias("readings"))


def heteronym_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each Han character with several readings occurs in all texts."""
    chars = mixed(spark, sf_dir).select(F.explode(F.regexp_extract_all("text", F.lit(f"[{scripts.HAN}]"), F.lit(0))).alias("char")).groupBy("char").agg(F.count("*").alias("n"))
    several = lexicon.han(spark).where(F.size("mandarin") > 1).select("char", F.array_join("mandarin", ",").alias("readings"))
    return chars.join(F.broadcast(several), "char")


def english_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words each decision of the English backend takes, and their phones."""
    words = english.folded(T.count_tokens(dealt(spark, sf_dir)))
    done = english.pronounce(words, lexicon.english(spark))
    return done.groupBy("doc_id", "route").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.size(F.split("native", " "))).alias("phones"))


def distinct_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct English words of all texts, and how often each occurs in n: what is a function of the word is found once."""
    return english.folded(T.count_tokens(dealt(spark, sf_dir), keep=()).groupBy("text").agg(F.sum("n").alias("n")))


def oov_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = distinct_words(spark, sf_dir)
    return english.pronounce(words, lexicon.english(spark)).where("route = 'segment'").groupBy(F.lower("word").alias("word")).agg(F.sum("n").alias("n"))


def english_ipa(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = distinct_words(spark, sf_dir)
    done = english.pronounce(words, lexicon.english(spark)).where("native is not null")
    return done.select("native").distinct().select("native", english.ipa(F.col("native")).alias("ipa"), english.base_phones(F.col("native")).alias("base"))


def _english_sql(tail: str) -> str:
    forced = ", ".join(sql.text(w.lower()) for w in lexicon.FORCE_SPELLINGS)
    source, target, _ = texts.latin_tables()
    return f"""WITH {sql.tokens(PLAIN_SQL)},
      lex AS (SELECT * FROM {sql.values([(w, r[0]) for w, r in lexicon.ENGLISH_SEED.items()], "w, reading")} WHERE w NOT IN ({forced})),
      letters AS (SELECT * FROM {sql.values(lexicon.LETTER_NAMES.items(), "c, name")}),
      words AS (SELECT doc_id, id, translate(translate(tok, '’‘', ''''''), {sql.text(source)}, {sql.text(target)}) AS word FROM toks WHERE language = 'en'),
      routed AS (SELECT doc_id, id, word, reading, CASE WHEN lower(word) = 'n''t' THEN 'clitic' WHEN regexp_matches(word, '^[A-Z]{{1,3}}$') THEN 'spelled' WHEN reading IS NOT NULL THEN 'lexicon'
        WHEN regexp_matches(word, '^([a-z]{{1,3}}|[A-Z]{{1,4}})$') THEN 'spelled' WHEN regexp_matches(word, '[^A-Za-z''-]') THEN 'error' ELSE 'segment' END AS route
        FROM words LEFT JOIN lex ON lower(word) = w),
      spelled AS (SELECT doc_id, id, string_agg(name, ' ' ORDER BY k) AS native FROM (SELECT doc_id, id, unnest(string_split(lower(word), '')) AS ch, generate_subscripts(string_split(lower(word), ''), 1) AS k FROM routed WHERE route = 'spelled') JOIN letters ON ch = c GROUP BY doc_id, id),
      done AS (SELECT r.doc_id, r.id, word, route, CASE route WHEN 'clitic' THEN 'AH0 N T' WHEN 'lexicon' THEN reading WHEN 'spelled' THEN native END AS native FROM routed r LEFT JOIN spelled s ON r.doc_id = s.doc_id AND r.id = s.id)
      {tail}"""


def _ipa_sql() -> str:
    from phonoweave.functions import phonetics as P

    rows = [(v + str(s), P.EN_UNSTRESSED.get(v, i) if s == 0 else i) for v, i in P.EN_VOWELS.items() for s in (0, 1, 2)] + [*P.EN_VOWELS.items(), *P.EN_CONSONANTS.items()]
    return _english_sql(
        f""", natives AS (SELECT DISTINCT native FROM done WHERE native IS NOT NULL),
      phones AS (SELECT native, unnest(string_split(native, ' ')) AS p, generate_subscripts(string_split(native, ' '), 1) AS k FROM natives),
      table_ AS (SELECT * FROM {sql.values(rows, "phone, segments")})
      SELECT native, string_agg(CASE right(p, 1) WHEN '1' THEN 'ˈ' WHEN '2' THEN 'ˌ' ELSE '' END || segments, ' ' ORDER BY k) AS ipa, string_agg(rtrim(p, '012'), ' ' ORDER BY k) AS base
      FROM phones JOIN table_ ON p = phone GROUP BY native"""
    )


QUERIES = {
    "tokenize": tokenize, "token_kinds": token_kinds, "boundaries": boundaries, "lossless": lossless, "zh_projection": _projection("zh"),
    "en_projection": _projection("en"), "char_projection_collapse": _characters(False), "char_projection_context": _characters(True),
    "latin_validate": latin_validate, "fold_diacritics": fold_diacritics, "apostrophe_norm": apostrophes, "han_scan": han_scan, "heteronym_counts": heteronym_counts,
    "english_words": english_words, "oov_words": oov_words, "english_ipa": english_ipa,
}

_SOURCE, _TARGET, _OTHER = texts.latin_tables()
ORACLE_SQL = {
    "tokenize": f"WITH {sql.tokens(MIXED_SQL)} SELECT doc_id, id, tok, start AS start_at, CAST(start + length(tok) AS INTEGER) AS end_at, language, kind, boundary AS boundary_before FROM toks",
    "token_kinds": f"WITH {sql.tokens(PLAIN_SQL)} SELECT language, kind, count(*) AS tokens, CAST(sum(length(tok)) AS BIGINT) AS chars FROM toks GROUP BY ALL",
    "boundaries": f"WITH {sql.tokens(MIXED_SQL)} SELECT doc_id, boundary, count(*) AS n FROM toks GROUP BY ALL",
    "lossless": "SELECT doc_id, md5(text) AS joined, true AS same FROM documents",
    "zh_projection": _projection_sql("zh"),
    "en_projection": _projection_sql("en"),
    "char_projection_collapse": _characters_sql(False),
    "char_projection_context": _characters_sql(True),
    "latin_validate": f"SELECT doc_id, regexp_extract(text, '[{_OTHER}]') AS char, CAST(instr(text, regexp_extract(text, '[{_OTHER}]')) - 1 AS INTEGER) AS place FROM documents WHERE regexp_matches(text, '[{_OTHER}]')",
    "fold_diacritics": f"SELECT doc_id, md5(translate(text, {sql.text(_SOURCE)}, {sql.text(_TARGET)})) AS folded FROM documents",
    "apostrophe_norm": "SELECT doc_id, md5(replace(text, 'e', '''')) AS unified FROM documents",
    "han_scan": f"WITH chars AS (SELECT DISTINCT doc_id, unnest(string_split(translate(text, '{LETTERS}', '{HAN}'), '')) AS char FROM documents) SELECT doc_id, char, readings FROM chars LEFT JOIN (SELECT * FROM {sql.values([(c, m) for c, (m, _) in lexicon.HAN_SEED.items()], 'c, readings')}) ON c = char WHERE char IN ('好', '中', '不')",
    "heteronym_counts": f"SELECT char, readings, n FROM (SELECT char, count(*) AS n FROM (SELECT unnest(string_split(translate(text, '{LETTERS}', '{HAN}'), '')) AS char FROM documents) GROUP BY char) JOIN (SELECT * FROM {sql.values([(c, m) for c, (m, _) in lexicon.HAN_SEED.items() if ',' in m], 'c, readings')}) ON c = char",
    "english_words": _english_sql("SELECT doc_id, route, count(*) AS n, CAST(sum(len(string_split(native, ' '))) AS BIGINT) AS phones FROM done GROUP BY ALL"),
    "oov_words": _english_sql("SELECT lower(word) AS word, count(*) AS n FROM done WHERE route = 'segment' GROUP BY ALL"),
    "english_ipa": _ipa_sql(),
}
