"""SQL counterparts of those queries that DuckDB can express."""

from __future__ import annotations

from orderloom.llm.chat import CONTROLS
from orderloom.llm.secret_scan import RULES

ORACLE: dict[str, str] = {}

_ESCAPES = " + ".join(f"(length(text) - length(replace(text, '{c}', ''))) // {len(c)}" for c in CONTROLS)

ORACLE["op4_chat"] = f"""WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(7 + sum(24 + length(role) + length(text) + CASE WHEN role = 'user' THEN 15 ELSE 0 END + {_ESCAPES}) AS BIGINT)
           AS formatted_chars
FROM turns GROUP BY conv_id"""


def _rule(place: int, kind: str, pattern: str, group: int, least: int) -> str:
    if kind == "hex":  # runs of the least length or more, which is the same and keeps the lists short
        pattern = "[0-9a-f]{24,}"
    quoted = pattern.replace("'", "''")
    return f"('{kind}', {place}, '{quoted}', {group}, {least})"


_RULES = ", ".join(_rule(i, r.kind, r.pattern, r.group, r.least) for i, r in enumerate(RULES))
_BASE = sum(r.base for r in RULES)
_TOLD = "concat(kind, ':', s, ':', s + n)"

ORACLE["op7_secret_scan"] = f"""WITH rules(kind, place, pattern, grp, least) AS (VALUES {_RULES}),
found AS (
    SELECT doc_id, kind, place, least, regexp_extract_all(coalesce(text, ''), pattern) AS m,
           regexp_extract_all(coalesce(text, ''), pattern, grp) AS v, string_split_regex(coalesce(text, ''), pattern) AS g
    FROM documents, rules),
each AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM found WHERE len(m) > 0),
spans AS (
    SELECT doc_id, kind, place, length(m[i]) AS n,
           CAST(list_sum(list_transform(g[1:i], lambda x: length(x)))
                + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s
    FROM each WHERE length(v[i]) >= least)
SELECT d.doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
       count(*) FILTER (WHERE kind = 'hex') AS n_hex,
       sha256(coalesce(string_agg({_TOLD}, ',' ORDER BY s, place) FILTER (WHERE place < {_BASE}), '')) AS base_sha256,
       coalesce(string_agg({_TOLD}, ',' ORDER BY s, place) FILTER (WHERE place IS NOT NULL), '') AS spans
FROM documents d LEFT JOIN spans USING (doc_id) GROUP BY d.doc_id"""

_PHRASE = {k: " || ' ' || ".join(["w", *(f"w{j}" for j in range(2, k + 1))]) for k in range(1, 6)}
_COUNTED = " UNION ALL ".join(
    f"SELECT lang, {phrase} AS phrase, {k} AS size, count(*) AS f FROM windows WHERE w{k if k > 1 else ''} IS NOT NULL GROUP BY ALL"
    for k, phrase in _PHRASE.items()
)
_FOLLOWING = ", ".join(f"lead(w, {k - 1}) OVER piece AS w{k}" for k in range(2, 6))

ORACLE["op11_phrases"] = f"""WITH docs AS (
    SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]') AS pieces
    FROM documents),
pieces AS (
    SELECT d, lang, generate_subscripts(pieces, 1) AS p, regexp_extract_all(unnest(pieces), '[^\\x20\\x09]+') AS words FROM docs),
words AS (SELECT d, lang, p, generate_subscripts(words, 1) AS i, unnest(words) AS w FROM pieces),
windows AS MATERIALIZED (SELECT lang, w, {_FOLLOWING} FROM words WINDOW piece AS (PARTITION BY d, p ORDER BY i)),
counts AS MATERIALIZED (SELECT * FROM ({_COUNTED}) WHERE f >= 100),
totals AS (SELECT lang, count(*) AS n FROM windows GROUP BY lang),
candidates AS MATERIALIZED (SELECT lang, phrase, size, f AS a, string_split(phrase, ' ') AS words FROM counts WHERE size >= 2),
cuts AS MATERIALIZED (
    SELECT lang, phrase, a, j, array_to_string(words[1:j], ' ') AS lhs, array_to_string(words[j + 1:size], ' ') AS rhs
    FROM (SELECT *, unnest(range(1, size)) AS j FROM candidates)),
scores AS (
    SELECT c.lang, c.phrase, c.a, c.j, x.f AS l, y.f AS r, t.n, (1000::HUGEINT * c.a * t.n) // (x.f::HUGEINT * y.f) AS score
    FROM cuts c JOIN totals t ON t.lang = c.lang
    JOIN counts x ON x.lang = c.lang AND x.phrase = c.lhs JOIN counts y ON y.lang = c.lang AND y.phrase = c.rhs),
best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inside AS (
    SELECT lang, array_to_string(words[s:s + m - 1], ' ') AS phrase, max(a) AS longer
    FROM (SELECT *, unnest(range(1, size - m + 2)) AS s FROM (SELECT *, unnest(range(2, size)) AS m FROM candidates)) GROUP BY ALL),
kept AS (
    SELECT b.* FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase
    WHERE i.longer IS NULL OR 100 * i.longer < 100 * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000"""
