"""DuckDB SQL that gives the rows of those queries that SQL can express."""

from __future__ import annotations

from . import chat, decontaminate, secrets

LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

#: From ``link(a, b)``, a < b: the smallest node that each node reaches.
REACH = """
reach(node, component) AS (
  SELECT a, b FROM link UNION SELECT b, a FROM link
  UNION
  SELECT reach.node, near.b FROM reach JOIN (SELECT a, b FROM link UNION ALL SELECT b, a FROM link) near ON reach.component = near.a
),
least AS (SELECT node, min(component) AS component FROM reach GROUP BY node)
"""

OP3 = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {LETTERS}), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM w
),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
link AS (
  SELECT p.doc_id AS a, q.doc_id AS b FROM e p JOIN e q ON p.x = q.x AND p.doc_id < q.doc_id
  GROUP BY p.doc_id, q.doc_id, p.n, q.n HAVING 100 * count(*) >= 85 * (p.n + q.n - count(*))
),
{REACH}
SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, coalesce(component, doc_id)) AS component_id, doc_id <= coalesce(component, doc_id) AS kept
FROM s LEFT JOIN least ON doc_id = node
"""

OP8 = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
link AS (
  SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.label = q.label AND p.vec_id < q.vec_id AND len(p.v) = len(q.v)
  WHERE list_cosine_similarity(p.v, q.v) >= 0.93
),
{REACH},
n AS (SELECT node, count(*) AS n FROM (SELECT a AS node FROM link UNION ALL SELECT b FROM link) GROUP BY node)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(vec_id, coalesce(component, vec_id)) AS component_id, vec_id <= coalesce(component, vec_id) AS kept
FROM embeddings LEFT JOIN least ON vec_id = least.node LEFT JOIN n ON vec_id = n.node
"""


def _length(text: str) -> str:
    """Code points of the escaped text."""
    return f"(length({text}) + length(regexp_replace({text}, '[^<>\\\\]', '', 'g')))"


OP2 = f"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\\### Assistant: </turn> ok'))
),
t AS (
  SELECT *, row_number() OVER o - 1 AS i, sum(tok) OVER o AS p, {_length('role')} + {_length('text')} + {len('<turn:>' + chr(10) + chat.END)} AS size
  FROM (SELECT *, len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+|[^\\s\\p{{L}}\\p{{N}}]')) + {chat.TURN_COST} AS tok FROM c)
  WINDOW o AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)
),
h AS (SELECT conv_id, (role = 'system')::INT AS sys, size, greatest(1, {chat.BUDGET - chat.HISTORY} - CASE WHEN role = 'system' THEN tok ELSE 0 END) AS room FROM t WHERE i = 0),
r(conv_id, i, base, last) AS (
  SELECT conv_id, 0::BIGINT, 0::HUGEINT, 0::BIGINT FROM h
  UNION ALL
  SELECT r.conv_id, t.i, CASE WHEN t.p - r.base > h.room AND t.i > r.last THEN t.p - t.tok ELSE r.base END, CASE WHEN t.p - r.base > h.room AND t.i > r.last THEN t.i ELSE r.last END
  FROM r JOIN t ON t.conv_id = r.conv_id AND t.i = r.i + 1 JOIN h ON h.conv_id = r.conv_id
),
b AS (SELECT DISTINCT r.conv_id, r.last AS b, r.base AS base, h.sys, h.size AS head FROM r JOIN h ON h.conv_id = r.conv_id WHERE r.last > 0),
again AS (
  SELECT b.conv_id, b.b, any_value(b.sys * b.head) + coalesce(sum(t.size), 0) AS size FROM b
  LEFT JOIN t ON t.conv_id = b.conv_id AND t.i >= greatest(b.sys, b.b - {chat.HISTORY_TURNS}) AND t.i < b.b AND b.base - (t.p - t.tok) <= {chat.HISTORY}
  GROUP BY b.conv_id, b.b
),
extra AS (SELECT conv_id, sum(size) AS size FROM again GROUP BY conv_id),
f AS (
  SELECT conv_id, count(*) AS n, sum(size) AS size, string_agg(role || chr(10) || text || chr(10), '' ORDER BY i) AS told,
    coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '') AS loss FROM t GROUP BY conv_id
)
SELECT f.conv_id::BIGINT AS conv_id, n::BIGINT AS n_turns, sha256(told) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, (f.size + coalesce(extra.size, 0))::BIGINT AS formatted_chars
FROM f LEFT JOIN extra ON extra.conv_id = f.conv_id
"""


def _mask(k: int, column: str) -> str:
    return " || ' ' || ".join(f"{column}[p + {i + 1}]" for i, c in enumerate(decontaminate.MASKS[k]) if c == "1")


OP5 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS h FROM documents),
q AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS item FROM benchmark),
dp AS (SELECT doc_id, h, unnest(range(0, len(h) - {decontaminate.SPAN - 1})) AS p FROM d),
qp AS (SELECT item_id, item, unnest(range(0, len(item) - {decontaminate.SPAN - 1})) AS p FROM q),
ds AS ({' UNION ALL '.join(f"SELECT doc_id, p, {k} AS k, {_mask(k, 'h')} AS seed FROM dp" for k in range(len(decontaminate.MASKS)))}),
qs AS ({' UNION ALL '.join(f"SELECT item_id, p, {k} AS k, {_mask(k, 'item')} AS seed FROM qp" for k in range(len(decontaminate.MASKS)))}),
hit AS (SELECT DISTINCT doc_id, item_id, ds.p - qs.p AS shift FROM ds JOIN qs USING (k, seed)),
win AS (SELECT hit.*, h, item, least({decontaminate.WINDOW}, len(item)) AS size, greatest(0, -shift) AS low, least(len(item), len(h) - shift) AS high FROM hit JOIN d USING (doc_id) JOIN q USING (item_id)),
starts AS (SELECT *, unnest(range(low, high - size + 1)) AS a FROM win WHERE high - low >= size),
verified AS (SELECT doc_id, item_id, size, shift, list_sum(list_transform(range(1, size + 1), lambda x: (item[a + x] = h[shift + a + x])::INT)) AS agreed FROM starts)
SELECT doc_id, item_id, max(agreed)::BIGINT AS agreed, max(size)::BIGINT AS "window", min(shift)::BIGINT AS position
FROM verified WHERE agreed >= size * {decontaminate.SHARE} GROUP BY doc_id, item_id
"""


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _found(kind: int, pattern: str, test: str) -> str:
    return f"""
  SELECT doc_id, source, {kind} AS kind, value, s AS "start", s + length(value) AS "end" FROM (
    SELECT doc_id, source, hits[i] AS value, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: length(x))), 0) AS s
    FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM (SELECT doc_id, source, regexp_extract_all(coalesce(text, ''), {_quoted(pattern)}) AS hits, string_split_regex(coalesce(text, ''), {_quoted(pattern)}) AS gaps FROM documents))
  ) WHERE {test}"""


OP7 = f"""
WITH found AS ({' UNION ALL '.join((
    _found(0, secrets.ASSIGN, f"length(regexp_extract(value, {_quoted(secrets.ASSIGN)}, 1)) >= 12"),
    _found(1, secrets.ACCESS, "length(value) >= 18"),
    _found(2, secrets.HEX, "true"),
    _found(3, secrets.TOKEN, "regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[a-z]')"),
))}),
valued AS (SELECT *, CASE WHEN kind = 0 THEN regexp_extract(value, {_quoted(secrets.ASSIGN)}, 1) ELSE value END AS v FROM found),
owners AS (SELECT v, count(DISTINCT coalesce(source, '')) <= {secrets.MAX_OWNERS} AS owned FROM valued GROUP BY v),
judged AS (SELECT doc_id, kind, owned, "start", ['assign', 'access', 'hex', 'live'][kind + 1] || ':' || "start" || ':' || "end" AS span FROM valued JOIN owners USING (v)),
told AS (
  SELECT doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
    count(*) FILTER (WHERE kind = 3 AND owned) AS n_live, count(*) FILTER (WHERE kind < 3 AND owned) AS n_owned, count(*) FILTER (WHERE kind < 3 AND NOT owned) AS n_copied,
    string_agg(span, ',' ORDER BY "start", kind) FILTER (WHERE kind < 3) AS base, string_agg(span, ',' ORDER BY "start", kind) FILTER (WHERE kind < 3 OR owned) AS spans
  FROM judged GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, coalesce(n_live, 0)::BIGINT AS n_live,
  coalesce(n_owned, 0)::BIGINT AS n_owned, coalesce(n_copied, 0)::BIGINT AS n_copied, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN told USING (doc_id)
"""

OP12 = f"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), {LETTERS}), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents
),
t AS (SELECT doc, lang, source, unnest(w) AS term FROM d),
total AS (SELECT lang, term, count(*)::HUGEINT AS n FROM t GROUP BY ALL HAVING count(DISTINCT doc) >= 30),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS n FROM total GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
own AS (SELECT t.lang, source, term, count(*)::HUGEINT AS n FROM t SEMI JOIN total ON t.lang = total.lang AND t.term = total.term GROUP BY ALL),
size AS (SELECT lang, source, sum(n)::HUGEINT AS n FROM own GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, total.term, coalesce(own.n, 0) AS n, 1 + (1000000000 * (coalesce(own.n, 0) + 5)) // (coalesce(size.n, 0) + 5 * v.v) AS p,
    1 + (1000000000 * (total.n + 5)) // (v.n + 5 * v.v) AS q
  FROM g JOIN total ON g.lang = total.lang JOIN v ON g.lang = v.lang
    LEFT JOIN own ON own.lang = g.lang AND own.source = g.source AND own.term = total.term LEFT JOIN size ON size.lang = g.lang AND size.source = g.source
),
f AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
every AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(f.value, 0) AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
    LEFT JOIN f ON f.lang = x.lang AND f.source = x.source AND f.item = y.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""

ORACLES = {"op2_chat_windows": OP2, "op3_setsketch_dedup": OP3, "op5_spaced_seed_decontamination": OP5, "op7_secret_ownership": OP7, "op8_itq_vectors": OP8, "op12_source_divergence": OP12}
