"""Connected components by alternating star contraction, all in joins and sums.

Nothing is gathered: each round is two groupings with partial sums and one join that skew handling can split. Links end as
(node, least node of its component).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonoweave.llm.common import Scratch


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(links: DataFrame, scratch: Scratch, name: str = "links") -> DataFrame:
    """links: a, b (bigint, never null, a <> b); returns node, component for every node that has a link, kept in scratch."""
    links = scratch.keep(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), name)
    mark = _mark(links)
    while mark[0]:
        links = scratch.keep(_round(links), name)
        now = _mark(links)
        if now == mark:
            break
        mark = now
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(links.select("b", "b").distinct())


def _round(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours are tied to its least one, then its smaller ones too."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    low = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
    return small.select("e.a", "e.b").where("a <> b").distinct()
