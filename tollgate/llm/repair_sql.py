"""DuckDB SQL for the report of conversation repair: dynamic programming over each conversation's rows.

A state is (cost in six digits and the edits so far, the repaired turns so far); of several ways to
one state the least by text is the cheapest, and the ASCII-least of these.  Rows of one turn come by
role and text there, and by their hashes in the operator, so the tables held against it have none.
"""

from __future__ import annotations


def oracle() -> str:
    """The statement: one column of the recursive table for each thing that the repaired turns may end with."""
    def add(x, cost, edit, line=None):
        k = f"lpad(CAST(CAST(substr({x}.k, 1, 6) AS INTEGER) + {cost} AS VARCHAR), 6, '0') || substr({x}.k, 7) || '{edit}'"
        t = f"{x}.t" if line is None else f"{x}.t || {line} || chr(10)"
        return f"CASE WHEN {x} IS NOT NULL THEN {{'k': {k}, 't': {t}}} END"

    def when(cond, x):
        return f"CASE WHEN {cond} THEN {x} END"

    def least(*xs):
        return f"list_sort(list_filter([{', '.join(xs)}], lambda z: z IS NOT NULL))[1]"

    late = "CASE WHEN fault = 't' THEN 1 ELSE 0 END"
    kept, user, bot = "role || ':' || text", "'user:' || text", "'assistant:' || text"
    stays = "fault NOT IN ('b', 'd')"
    keep = lambda x, i: when(f"{stays} AND initial = '{i}'", add(x, f"({late})", "K", kept))
    rerole = lambda x, line: when(stays, add(x, f"({late} + 2)", "R", line))
    s0 = add("b0", 3, "D")
    s1 = least(add("b1", 3, "D"), keep("b0", "s"))
    s2 = least(add("e2", 3, "D"), *[keep(x, "u") for x in ("b0", "b1", "e3")], *[rerole(x, user) for x in ("b0", "b1", "e3")])
    s3 = least(add("e3", 3, "D"), keep("e2", "a"), rerole("e2", bot))
    c2 = least("b2", *[add(x, 2, "I", "'user:'") for x in ("b0", "b1", "b3")])
    c3 = least("b3", add("c2", 2, "I", "'assistant:'"))
    e2 = least("c2", add("c3", 2, "I", "'user:'"))
    end = least("b0", "b3", add("b2", 2, "I", "'assistant:'"), f"({add('u1', 2, 'I', chr(39) + 'assistant:' + chr(39))})")
    crc = """(4294967295 - list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length(name) + 1),
      lambda i: list_concat([CAST(ascii(substr(name, CAST(i AS BIGINT), 1)) AS BIGINT)], [-1, -1, -1, -1, -1, -1, -1, -1]::BIGINT[])))),
      lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END)) % 20"""
    return f"""WITH RECURSIVE named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
kinds AS (SELECT *, {crc} AS kind FROM named),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM kinds WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS place FROM damaged),
judged AS (
  SELECT *, CASE WHEN substr(role, 1, 1) IN ('s', 'u', 'a') THEN substr(role, 1, 1) ELSE 'o' END AS initial,
    CASE WHEN bare = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 THEN 'd'
         WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '.' END AS fault
  FROM (SELECT *, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM placed)),
paired AS (SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY place) || initial AS pair FROM judged),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
    count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(place) AS n
  FROM paired GROUP BY conv_id),
ids AS (SELECT DISTINCT conv_id FROM conversations),
best AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS at, {{'k': '000000', 't': ''}} AS b0, CAST(NULL AS STRUCT(k VARCHAR, t VARCHAR)) AS b1,
    CAST(NULL AS STRUCT(k VARCHAR, t VARCHAR)) AS b2, CAST(NULL AS STRUCT(k VARCHAR, t VARCHAR)) AS b3 FROM ids
  UNION ALL
  SELECT conv_id, place, {s0}, {s1}, {s2}, {s3}
  FROM (SELECT *, {e2} AS e2, c3 AS e3 FROM (SELECT *, {c3} AS c3 FROM (SELECT *, {c2} AS c2
    FROM (SELECT b.*, j.place, j.role, j.text, j.initial, j.fault FROM best b JOIN judged j ON j.conv_id IS NOT DISTINCT FROM b.conv_id AND j.place = b.at + 1))))),
ended AS (
  SELECT b.conv_id, {end} AS found
  FROM (SELECT *, {add('b1', 2, 'I', "'user:'")} AS u1 FROM best) b LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM b.conv_id WHERE b.at = coalesce(c.n, 0))
SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
  CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(substr(found.k, 1, 6) AS BIGINT) AS cost,
  substr(found.k, 7) AS audit, sha256(CASE WHEN found.t = '' THEN '' ELSE left(found.t, length(found.t) - 1) END) AS repaired_sha256
FROM ended e LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM e.conv_id"""
