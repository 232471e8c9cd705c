"""Lossless tokens, projections and encodings of a text column, by one Arrow pass: no shuffle, and usable on streams.

Null texts have no tokens.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from phonoweave.functions import scan as S
from phonoweave.functions import scripts

TOKEN = "id int, text string, start int, end int, language string, kind string, boundary string"
PROJECTED = "text string, kind string, boundary string, source_ids array<int>"
CHARACTER = "char string, token int, place int"
_PROJECTED_KINDS = pa.array(["context", "target", "placeholder"])


def token_texts(text: Column) -> Column:
    """Array of token texts by a regular expression, inside the JVM; joined they are the text."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(scripts.TOKEN), F.lit(0))


def _arrays(text: Column, schema: str, columns) -> Column:
    """An array of structs for each text; columns(scan) gives the structs' columns and where each text's begin."""
    kind = to_arrow_type(StructType.fromDDL(schema))

    def run(texts: pa.Array) -> pa.Array:
        parts = []
        for part in S.slices(texts):
            values, begin = columns(S.scan(part))
            rows = pa.StructArray.from_arrays(values, fields=list(kind))
            parts.append(pa.ListArray.from_arrays(pa.array(begin, pa.int32()), rows))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(kind))

    return F.arrow_udf(run, f"array<struct<{schema}>>")(text)


def _int(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.int32))


def _token_columns(s: S.Scan) -> dict:
    """Makers of a token's columns, by name, so that only those asked for are made."""
    base = s.text_at[s.of]
    return {
        "id": lambda: _int(s.ids()), "text": s.texts, "start": lambda: _int(s.start - base), "end": lambda: _int(s.end - base),
        "language": lambda: S.LANGUAGES.take(pa.array(s.kind)), "kind": lambda: S.KINDS.take(pa.array(s.kind)),
        "boundary": lambda: S.BOUNDARIES.take(pa.array(s.boundaries())),
    }


def tokens(text: Column) -> Column:
    """Array of (id, text, start, end, language, kind, boundary); spans are half-open, in code points."""
    return _arrays(text, TOKEN, lambda s: ([make() for make in _token_columns(s).values()], s.first))


def explode_tokens(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), columns: tuple[str, ...] = ("id", "text", "language", "kind", "boundary")) -> DataFrame:
    """A row for each token, with the columns asked for (those of TOKEN) beside those kept; made as Arrow columns, not exploded."""
    types = {c.name: c.dataType.simpleString() for c in StructType.fromDDL(TOKEN)}
    kinds = dict(df.select(*keep).dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), *(f"`{c}` {types[c]}" for c in columns)])

    def run(batches):
        for batch in batches:
            at = 0
            for part in S.slices(batch.column(len(keep))):
                s = S.scan(part)
                make = _token_columns(s)
                of = pa.array(s.of + at)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(of) for k in range(len(keep))), *(make[c]() for c in columns)], names=[*keep, *columns])
                at += len(part)

    return df.select(*keep, F.col(text).alias("_text")).mapInArrow(run, schema)


def count_tokens(df: DataFrame, kind: int = S.LATIN, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, text, n: how often a row's text has each distinct token of a kind; without columns to keep, a stretch of rows counts
    as one text. Rows of equal keep and text may follow, so counts are to be summed."""
    kinds = dict(df.select(*keep, F.col(text).alias("_text")).dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "text string, n long"])

    def run(batches):
        for batch in batches:
            at = 0
            for part in S.slices(batch.column(len(keep))):
                s = S.scan(part)
                chosen = np.flatnonzero(s.kind == kind)
                words = pc.dictionary_encode(s.texts().take(pa.array(chosen)))
                size = max(1, len(words.dictionary))
                of = s.of[chosen] if keep else np.zeros(len(chosen), np.int64)
                pairs, n = np.unique(of * size + words.indices.to_numpy(zero_copy_only=False), return_counts=True)
                row = pa.array(pairs // size + at)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(row) for k in range(len(keep))), words.dictionary.take(pa.array(pairs % size)), pa.array(n, pa.int64())], names=[*keep, "text", "n"])
                at += len(part)

    return df.select(*keep, F.col(text).alias("_text")).mapInArrow(run, schema)


def _codes(target: str) -> tuple[int, int, str]:
    own, foreign = (S.HAN, S.LATIN) if target == "zh" else (S.LATIN, S.HAN)
    return own, foreign, scripts.PLACEHOLDERS["en" if target == "zh" else "zh"]


def projection(text: Column, target: str) -> Column:
    """Array of (text, kind, boundary, source_ids): tokens of the target language, one placeholder for each foreign island, the rest as context.

    An island takes a space only between two tokens of its language.
    """
    own, foreign, mark = _codes(target)

    def columns(s: S.Scan):
        inside, opens = s.islands(foreign)
        kept = np.flatnonzero(~inside | opens)
        island = pa.array(inside[kept])
        words = pc.if_else(island, pa.scalar(mark), s.texts().take(pa.array(kept)))
        kind = _PROJECTED_KINDS.take(pa.array(np.where(inside[kept], 2, s.kind[kept] == own).astype(np.int8)))
        sources = pa.ListArray.from_arrays(pa.array(np.append(kept, len(s.start)), pa.int32()), _int(s.ids()))
        return [words, kind, S.BOUNDARIES.take(pa.array(s.boundaries()[kept])), sources], np.searchsorted(kept, s.first)

    return _arrays(text, PROJECTED, columns)


def projection_text(projected: Column) -> Column:
    return F.array_join(projected["text"], "")


def character_projection(text: Column, target: str, placeholder: str, keep_context: bool) -> Column:
    """Array of (char, token, place): characters of target tokens with their source, for models that read one character a step.

    Without context, neighbouring other tokens collapse to one placeholder; with it, context is kept by character and each
    island is one placeholder. Other characters have no source.
    """
    own, foreign, _ = _codes(target)

    def columns(s: S.Scan):
        is_target = s.kind == own
        inside, opens = s.islands(foreign)
        marks = opens if keep_context else ~is_target & (s.before(is_target.astype(np.int64), 1, 1) == 1)
        token = np.repeat(np.arange(len(s.start)), s.end - s.start)
        place = np.arange(len(s.codes)) - s.start[token]
        whole = is_target | (~inside if keep_context else False)
        kept = np.flatnonzero(whole[token] | (marks[token] & (place == 0)))
        at = token[kept]
        chars = pc.if_else(pa.array(marks[at]), pa.scalar(placeholder), s.characters().take(pa.array(kept)))
        none = ~is_target[at]
        return [chars, pa.array(s.ids()[at].astype(np.int32), mask=none), pa.array(place[kept].astype(np.int32), mask=none)], np.searchsorted(kept, s.text_at)

    return _arrays(text, CHARACTER, columns)
