"""SQL that gives the rows of the queries that SQL can express on whole tables."""

from __future__ import annotations

import re

from phonoweave.llm import licenses

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


CHAT = """
WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
s AS (SELECT t.*, CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind, a.turn IS NOT NULL AS answered, u.turn IS NOT NULL AS asked FROM t
  LEFT JOIN (SELECT DISTINCT conv_id, turn FROM t WHERE role = 'assistant') a ON a.conv_id = t.conv_id AND a.turn = t.turn + 1
  LEFT JOIN (SELECT DISTINCT conv_id, turn FROM t WHERE role = 'user') u ON u.conv_id = t.conv_id AND u.turn = t.turn - 1),
i AS (SELECT *, CASE kind WHEN 'call' THEN 'turn:' || turn WHEN 'result' THEN 'turn:' || (turn - 1) END AS id FROM s)
SELECT conv_id, turn, 0 AS place, kind, id, CASE kind WHEN 'message' THEN 'message' WHEN 'call' THEN CASE WHEN answered THEN 'linked' ELSE 'unanswered' END ELSE CASE WHEN asked THEN 'linked' ELSE 'orphan' END END AS status,
  turn AS order_turn, CASE WHEN kind = 'result' AND asked THEN 1 ELSE 0 END AS order_depth, 'met' AS depends, '' AS problems,
  CASE kind WHEN 'call' THEN '{"arguments":{"content":' || to_json(text) || '},"id":"' || id || '","name":"respond","role":"user","type":"call"}'
    WHEN 'result' THEN '{"content":' || to_json(text) || ',"id":"' || id || '","role":"assistant","type":"result"}'
    ELSE '{"content":' || to_json(text) || ',"role":' || to_json(role) || ',"type":"message"}' END AS json
FROM i"""


def _templates() -> str:
    rows = []
    for k, (license_id, text) in enumerate(licenses.TEMPLATES):
        n = len(re.findall(r"[^\W_]+", text))
        rows.append(f"({k}, {_text(license_id)}, {_text(text)}, {licenses.window_class(n)})")
    return f"(VALUES {', '.join(rows)}) AS t(template, license_id, text, size)"


LICENSES = f"""
WITH split AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM documents),
places AS (SELECT doc_id, len(w) AS n, unnest(generate_series(0, len(w) - 5)) AS p, unnest(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' '))) AS sh FROM split WHERE len(w) >= 5),
tsplit AS (SELECT template, license_id, size, list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM {_templates()}),
wanted AS (SELECT DISTINCT template, license_id, size, unnest(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' '))) AS sh FROM tsplit),
counts AS (SELECT template, count(*) AS t FROM wanted GROUP BY 1),
hits AS (SELECT doc_id, n, p, sh, template, license_id, size FROM places JOIN wanted USING (sh)),
starts AS (SELECT DISTINCT doc_id, size, greatest(0, least(p // (size // 2) * (size // 2), n - size)) AS start FROM hits),
found AS (SELECT h.doc_id, license_id, h.template, start, count(DISTINCT sh) AS c FROM hits h JOIN starts s ON s.doc_id = h.doc_id AND s.size = h.size AND p >= start AND p + 5 <= start + h.size GROUP BY ALL),
scored AS (SELECT doc_id, license_id, start, c / t AS containment FROM found JOIN counts USING (template) WHERE c / t >= 0.8),
best AS (SELECT doc_id, license_id, max(containment) AS m FROM scored GROUP BY ALL)
SELECT b.doc_id, b.license_id, round(m, 6) AS containment, CAST(min(start) AS INTEGER) AS start FROM best b JOIN scored s ON s.doc_id = b.doc_id AND s.license_id = b.license_id AND s.containment = m GROUP BY ALL"""

JACCARD = f"""
WITH RECURSIVE split AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM documents),
sets AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(generate_series(1, len(w) - 3), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS sh FROM split),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY 1),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sets a JOIN sets b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM met JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
edges AS (SELECT a AS x, b AS y FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS id, doc_id AS c FROM documents UNION SELECT e.y, r.c FROM reach r JOIN edges e ON r.id = e.x)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c AS component_id FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN (SELECT id, min(c) AS c FROM reach GROUP BY id) ON id = d.doc_id"""

VECTORS = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id AS id, vec_id AS c FROM embeddings UNION SELECT l.y, r.c FROM reach r JOIN links l ON r.id = l.x)
SELECT vec_id, (SELECT count(*) FROM links WHERE x = vec_id) AS n_links, c AS component_id, vec_id = c AS kept FROM embeddings JOIN (SELECT id, min(c) AS c FROM reach GROUP BY id) ON id = vec_id"""

#: Items and documents of five words at least; every window that starts where a shingle of an item of that size says so.
LEAKS = f"""
WITH split AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM documents),
places AS (SELECT doc_id, len(w) AS words, unnest(generate_series(0, len(w) - 5)) AS p, unnest(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' '))) AS sh FROM split WHERE len(w) >= 5),
isplit AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM benchmark),
items AS (SELECT item_id, len(w) AS n, unnest(generate_series(0, len(w) - 5)) AS k, unnest(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' '))) AS sh FROM isplit WHERE len(w) >= 5),
wanted AS (SELECT item_id, n, sh, count(*) AS c FROM items GROUP BY ALL),
windows AS (SELECT DISTINCT doc_id, n, words, greatest(0, least(p - k, words - n)) AS start FROM places JOIN (SELECT DISTINCT n, k, sh FROM items) i USING (sh)),
inside AS (SELECT w.doc_id, w.n, start, sh, count(*) AS c FROM windows w JOIN places p ON p.doc_id = w.doc_id AND p BETWEEN start AND start + n - 5 GROUP BY ALL),
met AS (SELECT doc_id, i.n, start, item_id, sum(least(i.c, t.c)) AS both_have FROM inside i JOIN wanted t ON t.n = i.n AND t.sh = i.sh GROUP BY ALL),
scored AS (SELECT doc_id, item_id, start, both_have / (least(n, words - start) - 4 + n - 4 - both_have) AS similarity FROM met JOIN windows USING (doc_id, n, start)),
best AS (SELECT doc_id, item_id, max(similarity) AS m FROM scored WHERE similarity >= 0.8 GROUP BY ALL)
SELECT b.doc_id, b.item_id, round(m, 6) AS similarity, CAST(min(start) AS INTEGER) AS start FROM best b JOIN scored s ON s.doc_id = b.doc_id AND s.item_id = b.item_id AND s.similarity = m GROUP BY ALL"""

#: The article element of pages that have one, whose blocks are headings and paragraphs: what the distribution has to find there.
ARTICLES = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article[^>]*>(.*)</article>', 1) AS x FROM pages),
b AS (SELECT page_id, url, list_transform(string_split_regex(x, '(?i)</?(?:p|h[1-6]|div)\b[^>]*>'), lambda t: regexp_replace(regexp_replace(t, '(?i)<br[^>]*>', ' ', 'g'), '<[^>]*>', '', 'g')) AS t FROM a),
d AS (SELECT page_id, url, list_transform(t, lambda v: trim(regexp_replace(replace(replace(replace(replace(replace(replace(v, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g'))) AS t FROM b)
SELECT page_id, url, coalesce(array_to_string(list_filter(t, lambda v: v <> ''), chr(10) || chr(10)), '') AS text, CAST(length(coalesce(array_to_string(list_filter(t, lambda v: v <> ''), chr(10) || chr(10)), '')) AS BIGINT) AS n_chars FROM d"""

def _clusters(k: int = 16, width: int = 64, rounds: int = 3) -> str:
    """Every vector against every centroid, in each round."""
    steps = [
        f"kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q FROM embeddings WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('1:' || vec_id), q) - 1)::INTEGER AS j, q AS c FROM kept WHERE vec_id IS NOT NULL QUALIFY j < {k})",
    ]
    for step in range(rounds + 1):
        steps.append(f"d{step} AS (SELECT r, j, list_sum(list_transform(list_zip(q, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM kept CROSS JOIN c{step})")
        steps.append(f"a{step} AS MATERIALIZED (SELECT r, arg_min(j, d * {k} + j)::INTEGER AS j, min(d) AS d FROM d{step} GROUP BY r)")
        if step < rounds:
            steps.append(f"p{step} AS (SELECT j, i, sum(x) AS s, count(*) AS n FROM (SELECT a.j, unnest(q) AS x, unnest(range({width})) AS i FROM kept JOIN a{step} a USING (r)) GROUP BY j, i)")
            steps.append(f"m{step} AS (SELECT j, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS c FROM p{step} GROUP BY j)")
            steps.append(f"c{step + 1} AS MATERIALIZED (SELECT c{step}.j, coalesce(m.c, c{step}.c) AS c FROM c{step} LEFT JOIN m{step} m USING (j))")
    return f"""WITH {", ".join(steps)}
SELECT k.vec_id, a.j AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.j))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM kept k JOIN a{rounds} a USING (r) JOIN c{rounds} c ON c.j = a.j"""


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SEARCH = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
s AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d WHERE len(w) > 0),
p AS (SELECT r, any_value(doc_id) AS doc_id, term, count(*) AS tf, any_value(n) AS n FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM d) GROUP BY r, term),
i AS (SELECT item, item_id, term, count(*) AS times FROM (SELECT row_number() OVER () AS item, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark) GROUP BY item, item_id, term),
f AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p CROSS JOIN s GROUP BY term, n_docs),
v AS (SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))) AS value FROM p JOIN f USING (term) CROSS JOIN s),
z AS (SELECT item, item_id, r, doc_id, sum(times * value)::BIGINT AS score FROM v JOIN i USING (term) GROUP BY item, item_id, r, doc_id)
SELECT item_id, (row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id, r))::INTEGER AS rank, doc_id, score FROM z WHERE score > 0 QUALIFY rank <= 20"""


ORACLE_SQL = {"op1_chat_format": CHAT, "op4_decontaminate": LEAKS, "op9_html_text": ARTICLES, "op2_licenses": LICENSES, "op8_jaccard_join": JACCARD, "op10_vector_dedup": VECTORS, "op12_centroids": _clusters(), "op13_ranked_search": SEARCH}
