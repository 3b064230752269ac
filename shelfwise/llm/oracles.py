"""SQL twins of the text operators, for small tables."""

from __future__ import annotations

from shelfwise.llm import chat

PROBE = "</s>[INST] ok [/INST]"
_SPACE = r"[\x20\x09-\x0D]+"
_WORDS = "list_filter(regexp_split_to_array({}, '" + _SPACE + "'), lambda x: x <> '')"


def _escaped(c: str) -> str:
    out = f"replace({c}, '\\', '\\\\')"
    for s in chat.CONTROL:
        out = f"replace({out}, '{s}', '{s[0]}\\{s[1:]}')"
    return out


_FRAME = len(chat.START + chat.SEP + chat.END) + 1

CHAT = f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{PROBE}')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length({_escaped('role')}) + length({_escaped('text')}) + {_FRAME})::BIGINT AS formatted_chars
FROM t GROUP BY conv_id"""

PASSAGES = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
s AS (SELECT r, unnest(range(1, len(w) - 33)) AS p, w FROM d),
k AS (SELECT r, p, md5(array_to_string(w[p:p + 34], ' ')) AS k FROM s),
u AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY k) AS n FROM k) WHERE n > 1),
a AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
c AS (SELECT a.r, a.p, word, max(CASE WHEN u.p IS NULL THEN 0 ELSE 1 END) OVER (
  PARTITION BY a.r ORDER BY a.p ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM a LEFT JOIN u ON u.r = a.r AND u.p = a.p),
g AS (SELECT r, count(*) AS n, sum(gone)::BIGINT AS removed, string_agg(word, ' ' ORDER BY p) FILTER (gone = 0) AS kept FROM c GROUP BY r)
SELECT doc_id, coalesce(n, 0) AS n_words, coalesce(removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN g USING (r)"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR = f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM d),
i AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM i a JOIN i b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * m >= 75 * (na + nb - m)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, len(s) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c USING (doc_id)"""
