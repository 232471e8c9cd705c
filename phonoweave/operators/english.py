"""English words: the decision list of the backend as joins and expressions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phonoweave.functions import lexicon
from phonoweave.functions import phonetics as P
from phonoweave.functions.columns import look_up
from phonoweave.functions.text import fold_latin, unify_apostrophes
from phonoweave.operators.backends import EnglishBackend
from phonoweave.operators.errors import PhoneticsError

#: Rows of a lexicon that may be broadcast.
MOST_BROADCAST = 500_000


def words(tokens: DataFrame) -> DataFrame:
    """English tokens with their folded spelling in `word`."""
    return folded(tokens.where("language = 'en'"))


def folded(words: DataFrame) -> DataFrame:
    """English words in `text` with their folded spelling in `word`."""
    return words.withColumn("word", fold_latin(unify_apostrophes(F.col("text"))))


def spelled(word: Column) -> Column:
    """Letter names; null with any other character."""
    names = F.transform(P.letters(F.lower(word)), lambda c: look_up(lexicon.LETTER_NAMES, c))
    return F.when(~F.exists(names, lambda n: n.isNull()), F.array_join(names, " "))


def pronounce(tokens: DataFrame, readings: DataFrame, homographs: dict = lexicon.HOMOGRAPHS) -> DataFrame:
    """Adds `route` and `native` (ARPABET with stress, blanks between); `segment` words have no phones yet, `error` ones never.

    readings: word, readings. A tag in `pos`, where there is such a column, chooses among the readings of homographs.
    """
    small = readings.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    table = readings.select(F.col("word").alias("entry"), "readings")
    joined = tokens.join(F.broadcast(table) if small else table, F.lower("word") == F.col("entry"), "left")
    first = F.get("readings", 0)
    if "pos" in tokens.columns:
        rule = look_up({w: "|".join(r) for w, r in homographs.items()}, F.lower("word"))
        part = lambda k: F.split_part(rule, F.lit("|"), F.lit(k))
        first = F.when(rule.isNull() | F.col("pos").isNull(), first).when(F.col("pos").startswith(part(3)), part(1)).otherwise(part(2))
    route = (
        F.when(F.lower("word").isin(*lexicon.CLITICS), "clitic")
        .when(F.col("word").rlike("^[A-Z]{1,3}$"), "spelled")
        .when(F.col("entry").isNotNull(), "lexicon")
        .when(F.col("word").rlike("^([a-z]{1,3}|[A-Z]{1,4})$"), "spelled")
        .when(F.col("word").rlike("[^A-Za-z'-]"), "error")
        .otherwise("segment")
    )
    routed = joined.withColumn("route", route)
    native = F.when(F.col("route") == "clitic", look_up(lexicon.CLITICS, F.lower("word"))).when(F.col("route") == "lexicon", first).when(F.col("route") == "spelled", spelled(F.col("word")))
    return routed.withColumn("native", native).drop("entry", "readings")


def complete(routed: DataFrame, backend: EnglishBackend | None = None) -> DataFrame:
    """pronounce()'s rows with phones for words outside the lexicon too: by their known parts, or by sound.

    Each distinct word is read once and joined back; one that can't be read keeps no phones.
    """
    chosen = backend or EnglishBackend()

    def run(words: pa.Array) -> pa.Array:
        def read(word: str) -> str | None:
            try:
                return " ".join(chosen.pronounce(word))
            except PhoneticsError:
                return None

        return pa.array([read(w) for w in words.to_pylist()], pa.string())

    words = routed.where("route = 'segment'").select("word").distinct().select("word", F.arrow_udf(run, "string")("word").alias("_sound"))
    return routed.join(words, "word", "left").withColumn("native", F.coalesce("native", "_sound")).drop("_sound")


def base_phones(native: Column) -> Column:
    return F.regexp_replace(native, "[0-2]", "")


def ipa(native: Column) -> Column:
    """IPA segments with stress marks before the vowels that bear them."""

    def one(phone: Column) -> Column:
        stress = F.right(phone, F.lit(1))
        mark = F.when(stress == "1", "ˈ").when(stress == "2", "ˌ").otherwise("")
        parts = P.split_arpabet(phone)
        return F.concat(mark, P.arpabet_ipa(parts["base"], parts["stress"]))

    return F.array_join(F.transform(F.split(native, " "), one), " ")
