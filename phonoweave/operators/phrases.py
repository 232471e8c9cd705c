"""Phrases of a table found in a text column, in one Arrow pass over batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonoweave.functions import scan
from phonoweave.functions.phrases import PhraseTable, code_points

#: Phrases that are collected and sent to every task.
MOST_PHRASES = 5_000_000


def table_of(phrases: DataFrame, column: str = "phrase") -> PhraseTable:
    """A larger table than MOST_PHRASES is an error; null and empty phrases are left out."""
    rows = phrases.select(column).where(F.col(column) != "").distinct().orderBy(column).limit(MOST_PHRASES + 1).collect()
    if len(rows) > MOST_PHRASES:
        raise ValueError(f"more than {MOST_PHRASES} phrases")
    return PhraseTable([r[0] for r in rows])


def find(df: DataFrame, phrases: PhraseTable, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, start (in code points), phrase: the longest phrases from the left of each text; null texts have none."""
    kinds, sent = dict(df.select(*keep).dtypes), df.sparkSession.sparkContext.broadcast(phrases)

    def run(batches):
        for batch in batches:
            at = 0
            for part in scan.slices(batch.column(len(keep))):
                codes, begins = code_points([t or "" for t in part.to_pylist()])
                place, _, phrase = sent.value.leftmost_longest(codes, begins)
                of = np.searchsorted(begins, place, "right") - 1
                found = [pa.array((place - begins[of]).astype(np.int32)), pa.array(sent.value.phrases, pa.string()).take(pa.array(phrase))]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(of + at)) for k in range(len(keep))), *found], names=[*keep, "start", "phrase"])
                at += len(part)

    return df.select(*keep, F.col(text).alias("_text")).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "start int, phrase string"]))
