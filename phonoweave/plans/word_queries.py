"""Queries of phrase tables and the word lattice. The tables hold no Han text, so dictionaries are taken from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phonoweave.operators import lattice, phrases
from phonoweave.plans.text_queries import dealt

#: A dictionary of more words is joined by a shuffle.
MOST_BROADCAST = 200_000


def _benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", F.lower("text").alias("text"))


def _words(df: DataFrame) -> DataFrame:
    return df.select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0))).alias("word"))


def phrase_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the words of the benchmark, of 3 letters or more, are the longest match from the left in all documents."""
    known = _words(_benchmark(spark, sf_dir)).where(F.length("word") >= 3).select(F.col("word").alias("phrase"))
    found = phrases.find(dealt(spark, sf_dir).select(F.lower("text").alias("text")), phrases.table_of(known), keep=())
    return found.groupBy("phrase").agg(F.count("*").alias("n"), F.sum(F.col("start").cast("long")).alias("places"))


def lattice_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's letters without blanks, cut into its words by their counts in all documents."""
    items = _benchmark(spark, sf_dir)
    known = _words(items).distinct()
    small = known.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    counts = _words(dealt(spark, sf_dir).select(F.lower("text").alias("text"))).join(F.broadcast(known) if small else known, "word", "left_semi").groupBy("word").agg(F.count("*").alias("n"))
    squeezed = items.select("item_id", F.regexp_replace("text", "[^a-z]", "").alias("text"))
    return lattice.segment(squeezed, lattice.from_tables(counts), keep=("item_id",)).select("item_id", "place", "word")


QUERIES = {"phrase_counts": phrase_counts, "lattice_words": lattice_words}

ORACLE_SQL = {
    "phrase_counts": """
WITH known AS MATERIALIZED (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM benchmark),
pattern AS MATERIALIZED (SELECT string_agg(word, '|' ORDER BY length(word) DESC, word) AS p FROM known WHERE length(word) >= 3),
found AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), p)) AS phrase, unnest(regexp_split_to_array(lower(text), p)) AS gap, generate_subscripts(regexp_split_to_array(lower(text), p), 1) AS k FROM documents CROSS JOIN pattern),
placed AS (SELECT phrase, sum(length(gap)) OVER (PARTITION BY doc_id ORDER BY k) + coalesce(sum(length(phrase)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM found)
SELECT phrase, count(*) AS n, sum(start)::BIGINT AS places FROM placed WHERE phrase IS NOT NULL GROUP BY phrase""",
    "lattice_words": """
WITH RECURSIVE known AS MATERIALIZED (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM benchmark),
counts AS MATERIALIZED (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents) WHERE word IN (SELECT word FROM known) GROUP BY word),
total AS MATERIALIZED (SELECT sum(n)::BIGINT AS s FROM counts),
priced AS (SELECT word, floor(1e6 * ln(s / n))::BIGINT AS c FROM counts CROSS JOIN total),
texts AS MATERIALIZED (SELECT item_id, regexp_replace(lower(text), '[^a-z]', '', 'g') AS t FROM benchmark),
places AS (SELECT item_id, t, unnest(range(1, length(t) + 1)) AS i FROM texts),
words AS (SELECT item_id, i, length(word) AS k, c FROM places JOIN priced ON substr(t, i, length(word)) = word),
steps AS (SELECT * FROM words UNION ALL SELECT item_id, i, 1, floor(1e6 * ln(s))::BIGINT FROM places CROSS JOIN total WHERE substr(t, i, 1) NOT IN (SELECT word FROM counts)),
choices AS MATERIALIZED (SELECT item_id, i, list({'c': c, 'k': k}) AS all_ FROM steps GROUP BY item_id, i),
route AS MATERIALIZED (SELECT item_id, length(t) + 1 AS i, [0::BIGINT] AS best, []::BIGINT[] AS taken FROM texts
  UNION ALL SELECT item_id, i, list_prepend(b.c, best), list_prepend(-b.k, taken) FROM (
    SELECT r.item_id, c.i, r.best, r.taken, list_sort(list_transform(c.all_, lambda x: {'c': x.c + r.best[x.k], 'k': -x.k}))[1] AS b FROM route r JOIN choices c ON c.item_id = r.item_id AND c.i = r.i - 1)),
path AS (SELECT r.item_id, t, 1::BIGINT AS i, taken, 0 AS place FROM route r JOIN texts USING (item_id) WHERE r.i = 1 AND length(t) > 0
  UNION ALL SELECT item_id, t, i + taken[i], taken, place + 1 FROM path WHERE i + taken[i] <= length(t))
SELECT item_id, place::INTEGER AS place, substr(t, i, taken[i]) AS word FROM path""",
}
