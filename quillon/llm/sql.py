"""SQL for the queries that SQL can express, over the tables of a folder."""

from __future__ import annotations

from .common import LOWER, UPPER

_WORDS = rf"coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"

DECONTAMINATE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT row_number() OVER () AS r, coalesce(CAST(item_id AS VARCHAR), '') AS i, {_WORDS} AS w FROM benchmark),
dw AS (SELECT r, p, list(x) OVER (PARTITION BY r ORDER BY p ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS l
       FROM (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d)),
bw AS (SELECT i, size, list(x) OVER (PARTITION BY r ORDER BY p ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS l
       FROM (SELECT r, i, least(len(w), 10) AS size, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM b)),
windows AS (SELECT DISTINCT i, size, l FROM bw WHERE len(l) = size),
sizes AS (SELECT DISTINCT size FROM windows),
hits AS (SELECT r, p, windows.size, i
         FROM (SELECT r, p, sizes.size, l[1:sizes.size] AS l FROM dw, sizes WHERE len(dw.l) >= sizes.size) AS x JOIN windows USING (size, l)),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(p, p + size)) AS p FROM hits) GROUP BY r),
found AS (SELECT r, count(DISTINCT i) AS n, string_agg(DISTINCT i, ',' ORDER BY i) AS s FROM hits GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(covered.n, 0) AS n_hit, coalesce(found.n, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, covered.n IS NOT NULL AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN found USING (r)
"""

_ESCAPED = r"replace(replace({0}, '\', '\\'), '<|', '<\|')"

CHAT = f"""
WITH told AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
    UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
whole AS (
    SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
           coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS trained,
           CAST(sum(length('<|im_start|>' || replace({_ESCAPED.format('role')}, chr(10), '\\' || chr(10)) || chr(10) || {_ESCAPED.format('text')} || '<|im_end|>' || chr(10))) AS BIGINT) AS formatted_chars
    FROM told GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(trained) AS loss_chars, sha256(trained) AS loss_sha256, formatted_chars FROM whole
"""
