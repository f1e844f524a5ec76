"""The store as DuckDB SQL: common table expressions that the oracles of derived tables begin with."""

from __future__ import annotations

from reminisce.functions.text import CJK

_RE2 = CJK.replace("\\\\", "\\")


def est(text: str) -> str:
    """estimate_tokens as SQL."""
    rest = f"regexp_replace({text}, '[{_RE2}]', '', 'g')"
    plain = f"regexp_replace({rest}, '[\\x{{10000}}-\\x{{10ffff}}]', '', 'g')"
    return f"ceil(((length({text}) - length({rest})) * 6 + (length({rest}) - length({plain})) * 8 + length({plain})) / 4.0)::BIGINT"


def one_line(text: str, limit: int) -> str:
    flat = f"trim(regexp_replace({text}, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))"
    return f"CASE WHEN length({flat}) > {limit} THEN rtrim(substr({flat}, 1, {limit - 1})) || '…' ELSE {flat} END"


MESSAGES = f"""m AS (
  SELECT conv_id * 1000000 + turn + 1 AS message_id, conv_id AS conversation_id, turn + 1 AS seq, role, text AS content, {est('text')} AS token_count,
    sha256(role || chr(0) || text) AS identity_hash, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(conv_id * 60 + turn) AS created_at
  FROM conversations)"""

CONVERSATIONS = """c AS (
  SELECT conversation_id, 'session-' || conversation_id AS session_id,
    CASE WHEN conversation_id % 4 = 3 THEN NULL WHEN conversation_id % 7 = 0 THEN 'agent:main:cron:' || conversation_id WHEN conversation_id % 7 = 1 THEN 'agent:main:subagent:' || conversation_id ELSE 'agent:main:channel:' || (conversation_id % 12) END AS session_key,
    conversation_id % 5 <> 0 AS active, min(created_at) AS created_at, max(created_at) AS updated_at
  FROM m GROUP BY conversation_id)"""


def tail(n: int, cap: int | None = None, name: str = "t") -> str:
    test = f"rank <= {n}" + (f" AND (rank = 1 OR cum <= {cap})" if cap is not None else "")
    return f"""{name} AS (
  SELECT *, ({test}) OR coalesce(seq >= last_user, false) AS in_tail
  FROM (SELECT *, row_number() OVER w AS rank, sum(token_count) OVER (w ROWS UNBOUNDED PRECEDING)::BIGINT AS cum, max(CASE WHEN role = 'user' THEN seq END) OVER (PARTITION BY conversation_id) AS last_user
    FROM m WINDOW w AS (PARTITION BY conversation_id ORDER BY seq DESC)))"""


def _describe(noun: str, head: str) -> str:
    return f"'[' || strftime(earliest_at, '%Y-%m-%d %H:%M:%S') || ' - ' || strftime(latest_at, '%Y-%m-%d %H:%M:%S') || '] ' || n || ' {noun}: ' || ({one_line(head, 60)})"


def _condense(depth: int) -> str:
    prior = f"d{depth}"
    return f"""
p{depth} AS (SELECT *, (row_number() OVER (PARTITION BY conversation_id ORDER BY first_seq) - 1) AS p FROM {prior}),
g{depth} AS (
  SELECT conversation_id, p // 2 AS chunk, count(*) AS n, min(first_seq) AS first_seq, max(last_seq) AS last_seq, min(earliest_at) AS earliest_at, max(latest_at) AS latest_at,
    sum(descendant_count + 1)::BIGINT AS descendant_count, sum(descendant_token_count + token_count)::BIGINT AS descendant_token_count, sum(source_message_token_count)::BIGINT AS source_message_token_count, arg_min(content, first_seq) AS head
  FROM p{depth} GROUP BY ALL HAVING count(*) >= 2),
h{depth} AS (SELECT *, 'sum_' || substr(md5(conversation_id || '|{depth + 1}|' || first_seq || '|' || last_seq), 1, 16) AS summary_id, {_describe('summaries', 'head')} AS content FROM g{depth}),
d{depth + 1} AS (SELECT summary_id, conversation_id, 'condensed' AS kind, {depth + 1}::BIGINT AS depth, content, {est('content')} AS token_count, earliest_at, latest_at, descendant_count, descendant_token_count, source_message_token_count, first_seq, last_seq FROM h{depth}),
e{depth} AS (SELECT h{depth}.summary_id AS derived_id, p{depth}.summary_id AS source_id, (p % 2)::BIGINT AS ordinal FROM p{depth} JOIN h{depth} ON p{depth}.conversation_id = h{depth}.conversation_id AND p{depth}.p // 2 = h{depth}.chunk)"""


#: Depths of condensed summaries in the oracles: enough for 2 ** DEPTHS leaves in a conversation.
DEPTHS = 4

#: messages m, summaries s, links k, edges e, context x, as compact.sweep() makes them with its defaults.
STORE = f"""WITH RECURSIVE {MESSAGES},
{tail(2, name='tt')},
o AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY seq) AS place FROM tt WHERE NOT in_tail),
f AS (
  SELECT conversation_id, place, message_id, seq, 0 AS chunk, token_count AS total FROM o WHERE place = 1
  UNION ALL
  SELECT o.conversation_id, o.place, o.message_id, o.seq, CASE WHEN total + token_count > 150 OR total >= 150 THEN chunk + 1 ELSE chunk END, CASE WHEN total + token_count > 150 OR total >= 150 THEN token_count ELSE total + token_count END
  FROM f JOIN o ON o.conversation_id = f.conversation_id AND o.place = f.place + 1),
l AS (
  SELECT f.conversation_id, chunk, count(*) AS n, min(f.seq) AS first_seq, max(f.seq) AS last_seq, min(created_at) AS earliest_at, max(created_at) AS latest_at, sum(token_count)::BIGINT AS source_message_token_count, arg_min(content, f.seq) AS head
  FROM f JOIN m USING (message_id) GROUP BY ALL),
l2 AS (SELECT *, 'sum_' || substr(md5(conversation_id || '|0|' || first_seq || '|' || last_seq), 1, 16) AS summary_id, {_describe('messages', 'head')} AS content FROM l),
d0 AS (SELECT summary_id, conversation_id, 'leaf' AS kind, 0::BIGINT AS depth, content, {est('content')} AS token_count, earliest_at, latest_at, 0::BIGINT AS descendant_count, 0::BIGINT AS descendant_token_count, source_message_token_count, first_seq, last_seq FROM l2),
k AS (SELECT summary_id, message_id, (row_number() OVER (PARTITION BY f.conversation_id, f.chunk ORDER BY f.seq) - 1)::BIGINT AS ordinal FROM f JOIN l2 ON f.conversation_id = l2.conversation_id AND f.chunk = l2.chunk),
{",".join(map(_condense, range(DEPTHS)))},
s AS ({" UNION ALL ".join(f"SELECT * FROM d{i}" for i in range(DEPTHS + 1))}),
e AS ({" UNION ALL ".join(f"SELECT * FROM e{i}" for i in range(DEPTHS))}),
x AS (
  SELECT conversation_id, (row_number() OVER (PARTITION BY conversation_id ORDER BY pos) - 1)::BIGINT AS ordinal, item_type, message_id, summary_id
  FROM (SELECT conversation_id, first_seq AS pos, 'summary' AS item_type, NULL::BIGINT AS message_id, summary_id FROM s WHERE summary_id NOT IN (SELECT source_id FROM e)
    UNION ALL SELECT conversation_id, seq, 'message', message_id, NULL FROM m WHERE message_id NOT IN (SELECT message_id FROM k)))"""

#: Paths below each summary: root, node, level, path.
WALK = STORE + """,
w AS (
  SELECT summary_id AS root, summary_id AS node, 0::BIGINT AS level, '' AS path FROM s
  UNION ALL
  SELECT w.root, e.source_id, w.level + 1, w.path || '.' || format('{:04d}', e.ordinal) FROM w JOIN e ON e.derived_id = w.node)"""

CONTEXT = STORE + """,
r AS (SELECT x.conversation_id, x.ordinal, x.item_type, x.message_id, x.summary_id, coalesce(m.token_count, s.token_count, 0) AS token_count, coalesce(m.content, s.content) AS content, coalesce(m.role, 'summary') AS role, s.depth
  FROM x LEFT JOIN m USING (message_id) LEFT JOIN s ON s.summary_id = x.summary_id)"""
