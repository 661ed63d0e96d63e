"""Registered query of the conversation repair, over conversations that are damaged first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipatlas.llm import conversations
from clipatlas.llm.registry import query, table
from clipatlas.workdir import work_folder


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with a fifth of the rows dropped, emptied, cut, repeated or given to the user, by their key."""
    space = F.lit(" ")
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")])
    role, text = (F.coalesce(c, space) for c in ("role", "text"))
    kind = F.crc32(key) % 20
    changed = F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text)
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    kept = rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), changed.alias("text"), kind.alias("kind"), copies.alias("copies"))
    return kept.where("kind <> 0").select("conv_id", "turn", "role", "text", F.explode("copies").alias("copy")).drop("copy")


def _plus(value: str, cost: str, initial: str) -> str:
    return f"CASE WHEN {value} = 'x' THEN 'x' ELSE lpad((left({value}, 9)::BIGINT + {cost})::VARCHAR, 9, '0') || substr({value}, 10) || '{initial}' END"


def _least(*values: str) -> str:
    return f"least({', '.join(values)})"


_E, _S, _U, _A = (f"a[{i}]" for i in range(1, 5))
_MORE = "(CASE WHEN x[1] <> lower(x[1]) THEN 3 ELSE 0 END)"
_SYMBOL = "lower(x[1])"
_BEFORE_USER = _least(_E, _S, _A)
# A state is a text of cost and audit, or x; the list holds the states before anything, after s, after u, and after a pair.
_INSERT = f"""[{_E}, {_S}, {_least(_U, _plus(_BEFORE_USER, "3", "I"))},
  {_least(_A, _plus(_U, "3", "I"), _plus(_least(_E, _S), "6", "II"))}]"""
_GO = f"[{', '.join(_plus(v, '4', 'D') for v in (_E, _S, _U, _A))}]"
_STEP = f"""[{_plus(_E, "4", "D")},
  {_least(_plus(_S, "4", "D"), f"CASE WHEN {_SYMBOL} = 's' THEN {_plus(_E, _MORE, 'K')} ELSE 'x' END")},
  {_least(_plus(_U, "4", "D"), f"CASE WHEN {_SYMBOL} = 'u' THEN {_plus(_BEFORE_USER, _MORE, 'K')} ELSE 'x' END", _plus(_BEFORE_USER, f"3 + {_MORE}", "R"))},
  {_least(_plus(_A, "4", "D"), f"CASE WHEN {_SYMBOL} = 'a' THEN {_plus(_U, _MORE, 'K')} ELSE 'x' END", _plus(_U, f"3 + {_MORE}", "R"))}]"""
_CRC = """list_reduce([4294967295] || list_transform(range(1, length(k) + 1), lambda i: ascii(substr(k, i, 1))::BIGINT),
  lambda c, b: list_reduce([xor(c, b)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END))"""
_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

REPAIR_SQL = f"""
WITH keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
kinds AS (SELECT *, xor({_CRC}, 4294967295) % 20 AS kind FROM keyed),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM kinds WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS n FROM damaged),
seen AS (
  SELECT *, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) AS earlier,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) AS times, right(rtrim(text, {_WHITE}), 1) AS final FROM placed),
faulty AS (
  SELECT *, CASE WHEN final = '' THEN 'blank' WHEN times > 1 THEN 'duplicate' WHEN final NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM seen),
coded AS (
  SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN '-' WHEN fault = 'truncated' THEN upper(symbol) ELSE symbol END AS code
  FROM (SELECT *, CASE WHEN initial IN ('s', 'u', 'a') THEN initial ELSE 'o' END AS symbol FROM faulty)),
counted AS (
  SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (earlier IS NOT NULL AND earlier || initial NOT IN ('su', 'ua', 'au')) AS illegal,
    flatten(list([['i'], [code]] ORDER BY n)) || [['i']] AS steps
  FROM coded GROUP BY conv_id),
parsed AS (
  SELECT *, list_reduce([['000000000', 'x', 'x', 'x']] || steps, lambda a, x: CASE x[1] WHEN 'i' THEN {_INSERT} WHEN '-' THEN {_GO} ELSE {_STEP} END) AS ends FROM counted),
best AS (SELECT *, left(least(ends[1], ends[4]), 9)::BIGINT AS cost, substr(least(ends[1], ends[4]), 10) AS audit FROM parsed),
edits AS (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS i FROM best),
numbered AS (
  SELECT conv_id, i, substr(audit, i, 1) AS edit, count(*) FILTER (substr(audit, i, 1) <> 'I') OVER upto AS n, count(*) FILTER (substr(audit, i, 1) <> 'D') OVER upto AS o
  FROM edits WINDOW upto AS (PARTITION BY conv_id ORDER BY i ROWS UNBOUNDED PRECEDING)),
rows AS (
  SELECT e.conv_id, e.i, e.edit, e.o, CASE WHEN e.edit = 'I' THEN '' ELSE p.text END AS text, p.role AS own
  FROM numbered e LEFT JOIN placed p ON e.conv_id IS NOT DISTINCT FROM p.conv_id AND e.n = p.n AND e.edit <> 'I' WHERE e.edit <> 'D'),
led AS (SELECT *, max(CASE WHEN o = 1 AND edit = 'K' AND left(own, 1) = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS system FROM rows),
texts AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN own WHEN (o - system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY i) AS repaired FROM led GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN best b ON c.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN texts t ON c.conv_id IS NOT DISTINCT FROM t.conv_id
"""


@query("op13_conversations", REPAIR_SQL)
def conversations_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation, after the damage."""
    given = table(spark, sf_dir, "conversations")
    return conversations.repair_conversations(spark, damaged(given), work_folder(spark, "conversations"), given)
