"""Queries over conversations: repair and prefix trie, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from torqueline.llm import repair, trie
from torqueline.llm.base import query, table


def crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII string, bit by bit."""
    return f"""xor(list_reduce([ascii(ch)::BIGINT FOR ch IN string_split({text}, '')], lambda crc, byte:
      list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, xor(crc, byte)), 4294967295::BIGINT), 4294967295)"""


def _least(*ways: str) -> str:
    return f"list_min([{', '.join(ways)}])"


def _path(of: str, cost: str, edit: str, line: str | None = None) -> str:
    """The path ``of`` with an edit and perhaps a line more; unreachable states cost 1e9 and stay so."""
    said = f"CASE WHEN {of}.n = 0 THEN {line} ELSE {of}.said || chr(10) || {line} END" if line else f"{of}.said"
    return f"{{'cost': {of}.cost + {cost}, 'audit': {of}.audit || '{edit}', 'said': {said}, 'n': {of}.n + {1 if line else 0}}}"


_USER, _HELPER = "'user:'", "'assistant:'"
_OPENED = f"""{{'s0': a.s0, 's1': a.s1,
  's2': {_least('a.s2', _path('a.s0', '5', 'I', _USER), _path('a.s1', '5', 'I', _USER), _path('a.s3', '5', 'I', _USER))}, 's3': a.s3}}"""
_CLOSED = f"""{{'s0': o.s0, 's1': o.s1, 's2': o.s2, 's3': {_least('o.s3', _path('o.s2', '5', 'I', _HELPER))}}}"""
_CUT = "CASE WHEN x.fault = 3 THEN 5 ELSE 0 END"
_OWN, _FAR = "(x.role || ':' || x.text)", "CASE WHEN x.fault IN (1, 2) THEN 1000000000 ELSE 0 END"


def _keep(of: str, initial: str) -> str:
    return _path(of, f"{_CUT} + {_FAR} + CASE WHEN x.i = '{initial}' THEN 0 ELSE 1000000000 END", "K", _OWN)


def _rerole(of: str, role: str) -> str:
    return _path(of, f"1 + {_CUT} + {_FAR}", "R", f"('{role}:' || x.text)")


_STEP = f"""{{'s0': {_path('c.s0', '2', 'D')}, 's1': {_least(_path('c.s1', '2', 'D'), _keep('c.s0', 's'))},
  's2': {_least(_path('c.s2', '2', 'D'), *[w for s in ('c.s0', 'c.s1', 'c.s3') for w in (_keep(s, 'u'), _rerole(s, 'user'))])},
  's3': {_least(_path('c.s3', '2', 'D'), _keep('c.s2', 'a'), _rerole('c.s2', 'assistant'))}}}"""
_NONE = "{'cost': 1000000000::BIGINT, 'audit': '', 'said': '', 'n': 0::BIGINT}"
_BEGIN = "{'s0': {'cost': 0::BIGINT, 'audit': '', 'said': '', 'n': 0::BIGINT}, 's1': %s, 's2': %s, 's3': %s}" % (_NONE, _NONE, _NONE)


def _bound(value: str, name: str, body: str) -> str:
    return f"list_transform([{value}], lambda {name}: {body})[1]"


_OVER = _bound(_bound("a", "a", _OPENED), "o", _CLOSED)

# A fold over a conversation's rows keeps the least (cost, edits) for each state of the pattern.
REPAIR_SQL = rf"""
WITH src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {crc32_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind FROM conversations),
d AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(CASE kind WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM src WHERE kind <> 0),
o AS (
  SELECT *, row_number() OVER w AS pos, left(role, 1) AS i, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
         regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS ended,
         lag(left(role, 1)) OVER w AS before
  FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
f AS (SELECT *, CASE WHEN blank THEN 1 WHEN again THEN 2 WHEN NOT ended THEN 3 ELSE 0 END AS fault FROM o),
g AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
         count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au')) AS illegal,
         list({{'i': i, 'role': role, 'text': text, 'fault': fault}} ORDER BY pos) AS rows
  FROM f GROUP BY conv_id),
e AS (
  SELECT * EXCLUDE (rows), list_reduce(rows, lambda a, x: {_bound(_OVER, 'c', _STEP)}, {_BEGIN}) AS a FROM g),
z AS (SELECT * EXCLUDE (a), {_bound(_OVER, 'c', _least('c.s0', 'c.s3'))} AS best FROM e)
SELECT s.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.cost, 0)::BIGINT AS cost,
       coalesce(best.audit, '') AS audit, sha256(coalesce(best.said, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) s LEFT JOIN z ON s.conv_id IS NOT DISTINCT FROM z.conv_id
"""


@query("op12_conversation_repair", REPAIR_SQL)
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_damaged(table(spark, sf_dir, "conversations"))


TRIE_SQL = rf"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT DISTINCT conv_id, conv_id - conv_id % 20 AS base, {crc32_sql('conv_id::VARCHAR')} % 4 AS h FROM t),
r AS (
  SELECT c.conv_id, role, text, 0 AS own, pos FROM c JOIN t ON t.conv_id = c.base AND t.pos <= c.h
  UNION ALL SELECT c.conv_id, role, text, 1, pos FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h),
q AS (
  SELECT c.conv_id, coalesce(list({{'role': role, 'text': text}} ORDER BY own, pos) FILTER (role IS NOT NULL), []) AS turns
  FROM c LEFT JOIN r ON r.conv_id = c.conv_id GROUP BY c.conv_id),
p AS (SELECT conv_id, len(turns) AS size, unnest(range(len(turns) + 1)) AS depth, turns FROM q),
n AS (
  SELECT depth::BIGINT AS depth, turns[1:depth] AS path, min(conv_id) AS conv_id, count(*) AS n_convs,
         coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (size = depth), '') AS ends
  FROM p GROUP BY depth, path),
w AS (SELECT *, (n_convs - 1) * coalesce(len(regexp_extract_all(path[depth].text, '[^\x20\x09-\x0D]+')), 0) AS saved FROM n),
k AS (SELECT depth - 1 AS depth, path[1:depth - 1] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
full_ AS (SELECT w.*, coalesce(n_children, 0) AS n_children FROM w LEFT JOIN k USING (depth, path)),
up AS (SELECT path[1:d] AS path, d AS depth, saved, (n_children = 0)::INT AS leaf FROM full_, unnest(range(depth + 1)) AS u(d)),
s AS (SELECT depth, path, sum(saved)::BIGINT AS saved_tokens, sum(leaf)::BIGINT AS n_leaves FROM up GROUP BY depth, path)
SELECT f.conv_id, f.depth, a.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens, sha256(f.ends) AS ends_sha256
FROM full_ f JOIN s ON s.depth = f.depth AND s.path = f.path LEFT JOIN n a ON a.depth = f.depth - 1 AND a.path = f.path[1:f.depth - 1]
"""


@query("op13_conversation_trie", TRIE_SQL)
def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))
