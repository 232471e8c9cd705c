"""Pieces of the SQL that checks the queries."""

from __future__ import annotations

from collections.abc import Iterable

from phonoweave.functions import scripts


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def values(rows: Iterable[tuple], columns: str) -> str:
    """An inline table."""
    cell = lambda v: "NULL" if v is None else text(v) if isinstance(v, str) else str(v)
    return f"(VALUES {', '.join('(' + ', '.join(cell(v) for v in row) + ')' for row in rows)}) AS t({columns})"


#: Token rows of documents by windows: doc_id, id, tok, start, language, kind, boundary.
def tokens(source: str) -> str:
    """source: SELECT giving doc_id, text."""
    one = lambda ranges: f"^[{ranges}]"
    return f"""
      parts AS (SELECT doc_id, unnest(regexp_extract_all(text, {text(scripts.TOKEN)})) AS tok, generate_subscripts(regexp_extract_all(text, {text(scripts.TOKEN)}), 1) - 1 AS id FROM ({source})),
      langs AS (SELECT *, CASE WHEN regexp_matches(tok, {text(one(scripts.SPACE))}) THEN 'space' WHEN regexp_matches(tok, {text(one(scripts.HAN))}) THEN 'zh'
        WHEN regexp_matches(tok, '^\\p{{Nd}}') THEN 'num' WHEN regexp_matches(tok, {text(one(scripts.LATIN))}) THEN 'en' ELSE 'sym' END AS language FROM parts),
      near AS (SELECT *, CAST(coalesce(sum(length(tok)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS start,
        lag(language) OVER w AS l1, lag(language, 2) OVER w AS l2, lag(tok) OVER w AS t1, lag(tok, 2) OVER w AS t2, lead(language) OVER w AS n1
        FROM langs WINDOW w AS (PARTITION BY doc_id ORDER BY id)),
      prev AS (SELECT *, l1 = 'space' AS gap, CASE WHEN l1 = 'space' THEN t2 ELSE t1 END AS pt, CASE WHEN l1 = 'space' THEN l2 ELSE l1 END AS pl FROM near),
      toks AS (SELECT doc_id, CAST(id AS INTEGER) AS id, tok, start, language, l1, n1,
        CASE language WHEN 'space' THEN 'space' WHEN 'zh' THEN 'han' WHEN 'num' THEN 'number' WHEN 'en' THEN 'latin' ELSE CASE WHEN regexp_matches(tok, '^\\p{{P}}') THEN 'punctuation' ELSE 'symbol' END END AS kind,
        CASE WHEN pt IS NULL OR language = 'space' THEN 'none' WHEN contains({text(scripts.SENTENCE_MARKS)}, right(pt, 1)) THEN 'sentence'
          WHEN contains({text(scripts.PAUSE_MARKS)}, right(pt, 1)) THEN 'pause' WHEN (language = 'zh' AND pl = 'en') OR (language = 'en' AND pl = 'zh') THEN 'code_switch'
          WHEN gap THEN 'soft' ELSE 'none' END AS boundary FROM prev)"""
