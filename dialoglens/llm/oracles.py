"""DuckDB SQL that says the same as operators 11 and 12, written out round by round and turn by turn."""

from __future__ import annotations

#: A layer's state in SQL: nine digits of cost, then the audit, so that strings compare as (cost, audit).


def plus(state: str, cost: str, edit: str) -> str:
    return f"(lpad((substr({state}, 1, 9)::BIGINT + {cost})::VARCHAR, 9, '0') || substr({state}, 10) || '{edit}')"


def closed(s0: str, s1: str, s2: str, s3: str) -> str:
    """Select items ``s0`` to ``s3`` after insertions."""
    user = f"least({s2}, {plus(s0, '5', 'I')}, {plus(s1, '5', 'I')}, {plus(s3, '5', 'I')})"
    return f"{s0} AS s0, {s1} AS s1, {user} AS s2, least({s3}, {plus(user, '5', 'I')}) AS s3"


def any_of(edit: str, cost: str, *states: str) -> str:
    return f"least({', '.join(plus(s, cost, edit) for s in states)})"


CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(name) + 1), lambda i: ascii(name[i])::BIGINT)), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"
BLANKS = r"\x20\x09-\x0D"

REPAIR = rf"""
WITH RECURSIVE named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, concat(coalesce(conv_id::VARCHAR, ' '), ':', coalesce(turn::VARCHAR, ' ')) AS name FROM conversations
), harmed AS (SELECT *, {CRC} % 20 AS harm FROM named
), ids AS (SELECT DISTINCT conv_id FROM named
), rows AS (
  SELECT conv_id, turn, copy, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role, CASE harm WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM harmed, range(0, 2) t(copy) WHERE harm <> 0 AND (copy = 0 OR harm = 3)
), placed AS (
  SELECT *, row_number() OVER w AS i, substr(role, 1, 1) AS c, lag(substr(role, 1, 1)) OVER w AS before, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy)
), faulty AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^{BLANKS}]') THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][{BLANKS}]*$') THEN 'truncated' ELSE '' END AS fault FROM placed
), turns AS (
  SELECT *, fault NOT IN ('blank', 'duplicate') AS ok, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS m FROM faulty
), layers AS (
  SELECT conv_id, 0::BIGINT AS i, {closed("'000000000'", "NULL::VARCHAR", "NULL::VARCHAR", "NULL::VARCHAR")} FROM ids
  UNION ALL
  SELECT conv_id, i, {closed("n0", "n1", "n2", "n3")} FROM (
    SELECT l.conv_id, t.i, {plus("s0", "2", "D")} AS n0,
      least({plus("s1", "2", "D")}, CASE WHEN ok AND c = 's' THEN {plus("s0", "m", "K")} END) AS n1,
      least({plus("s2", "2", "D")}, CASE WHEN ok THEN {any_of("R", "m + 1", "s0", "s1", "s3")} END, CASE WHEN ok AND c = 'u' THEN {any_of("K", "m", "s0", "s1", "s3")} END) AS n2,
      least({plus("s3", "2", "D")}, CASE WHEN ok THEN {plus("s2", "m + 1", "R")} END, CASE WHEN ok AND c = 'a' THEN {plus("s2", "m", "K")} END) AS n3
    FROM layers l JOIN turns t ON l.conv_id IS NOT DISTINCT FROM t.conv_id AND t.i = l.i + 1)
), best AS (
  SELECT conv_id, substr(x, 1, 9)::BIGINT AS cost, substr(x, 10) AS audit FROM (SELECT conv_id, arg_max(least(s0, s3), i) AS x FROM layers GROUP BY conv_id)
), walk AS (
  SELECT conv_id, audit, 0::BIGINT AS k, 0::BIGINT AS i, 0 AS state, []::VARCHAR[] AS said FROM best
  UNION ALL
  SELECT conv_id, audit, k, i, state, CASE edit WHEN 'D' THEN said WHEN 'K' THEN list_append(said, role || ':' || text)
    ELSE list_append(said, CASE state WHEN 2 THEN 'user' ELSE 'assistant' END || ':' || CASE edit WHEN 'R' THEN text ELSE '' END) END
  FROM (
    SELECT w.conv_id, audit, k + 1 AS k, t.i AS i, edit, said, t.role, t.text,
      CASE edit WHEN 'D' THEN state WHEN 'K' THEN CASE t.c WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END ELSE CASE state WHEN 2 THEN 3 ELSE 2 END END AS state
    FROM (SELECT *, substr(audit, k + 1, 1) AS edit FROM walk WHERE k < length(audit)) w
    JOIN (SELECT conv_id, i, role, text, c FROM turns UNION ALL SELECT conv_id, 0, '', '', '' FROM ids) t
      ON w.conv_id IS NOT DISTINCT FROM t.conv_id AND t.i = CASE WHEN edit = 'I' THEN w.i ELSE w.i + 1 END)
), ended AS (SELECT conv_id, arg_max(said, k) AS said FROM walk GROUP BY conv_id
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND before || c NOT IN ('su', 'ua', 'au')) AS illegal FROM turns GROUP BY conv_id
)
SELECT b.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  cost, audit, sha256(array_to_string(said, chr(10))) AS repaired_sha256
FROM best b JOIN ended e ON b.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN counted c ON b.conv_id IS NOT DISTINCT FROM c.conv_id
"""


def codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """Each round assigns distinct parts and moves the entries; distances and means are whole numbers in doubles."""
    near = "(list_inner_product(a, a) - 2 * list_inner_product(a, c) + list_inner_product(c, c))"
    steps = []
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT d.p, d.a, d.n, min({near} * {entries} + e)::BIGINT AS k FROM dist d JOIN b{r} ON d.p = b{r}.p GROUP BY d.p, d.a, d.n)")
        if r < rounds:
            steps.append(f"m{r} AS (SELECT p, e, list(floor(s / n) ORDER BY i) AS c FROM (SELECT p, k % {entries} AS e, i, sum(n * a[i]) AS s, sum(n) AS n FROM a{r}, (SELECT unnest(range(1, 1 + (SELECT w FROM width))) AS i) GROUP BY 1, 2, 3) GROUP BY p, e)")
            steps.append(f"b{r + 1} AS MATERIALIZED (SELECT b{r}.p, b{r}.e, coalesce(m{r}.c, b{r}.c) AS c FROM b{r} LEFT JOIN m{r} ON b{r}.p = m{r}.p AND b{r}.e = m{r}.e)")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS r, vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: coalesce(NOT isfinite(x), true))) = 0
), width AS (SELECT max(len(v)) // {parts} AS w FROM kept
), part AS MATERIALIZED (SELECT r, p, v[p * w + 1 : p * w + w] AS a FROM kept, width, range(0, {parts}) t(p)
), dist AS MATERIALIZED (SELECT p, a, count(*) AS n FROM part GROUP BY 1, 2
), b0 AS MATERIALIZED (SELECT p, r - 1 AS e, a AS c FROM part WHERE r <= {entries}
), {", ".join(steps)}
, coded AS (SELECT r, string_agg(lpad(lower(to_hex(k % {entries})), 2, '0'), '' ORDER BY part.p) AS code, sum(k // {entries})::BIGINT AS error FROM part JOIN a{rounds} x ON part.p = x.p AND part.a = x.a GROUP BY r
), book AS (SELECT sha256(string_agg(c[i]::BIGINT::VARCHAR, ',' ORDER BY p, e, i)) AS h FROM b{rounds}, (SELECT unnest(range(1, 1 + (SELECT w FROM width))) AS i))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM kept JOIN coded USING (r), book
"""
