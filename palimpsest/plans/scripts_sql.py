"""Edit scripts in SQL (DuckDB): the greedy search as recursive tables, an independent check of the kernels.

A pair's furthest reaches are a list for each step d, one place for each diagonal k = -d, -d + 2, .. d;
the rows of all steps are the trace that the second recursion walks back. Reaches count
tokens of the old side; -1 is a diagonal that is not reached.
"""

from __future__ import annotations

#: Tables ``t`` (id, a, b, ka, kb: tokens and what they are compared by) -> ``runs`` (id, run, op, n, i, j: kind, length, places before it).
SEARCH = """
sizes AS MATERIALIZED (SELECT id, ka, kb, len(ka) AS n, len(kb) AS m FROM t),
ahead AS MATERIALIZED (SELECT id, n, m, list_reduce(
    list_prepend([list_transform(range(0, m + 2), lambda x: 0::INTEGER)], list_transform(range(0, n), lambda r: [[(n - r)::INTEGER]])),
    lambda done, e: list_prepend(list_transform(range(1, m + 3), lambda j: CASE WHEN j <= m AND ka[e[1][1]] = kb[j] THEN 1 + done[1][j + 1] ELSE 0 END::INTEGER), done)) AS eq
  FROM sizes),
steps AS (
  SELECT id, 0 AS d, [eq[1][1]::BIGINT] AS v, CASE WHEN eq[1][1] >= m THEN 1 ELSE -m - 1 END::BIGINT AS lo, CASE WHEN eq[1][1] >= n THEN -1 ELSE n + 1 END::BIGINT AS hi, eq[1][1] = n AND eq[1][1] = m AS done FROM ahead
  UNION ALL
  SELECT id, d, v,
    greatest(lo, coalesce(list_max(list_transform(list_filter(range(0, d + 1), lambda q: v[q + 1] >= 0 AND v[q + 1] - (2 * q - d) >= m), lambda q: 2 * q - d + 1)), lo)),
    least(hi, coalesce(list_min(list_transform(list_filter(range(0, d + 1), lambda q: v[q + 1] >= n), lambda q: 2 * q - d - 1)), hi)),
    abs(n - m) <= d AND (d + n - m) % 2 = 0 AND coalesce(v[(d + n - m) // 2 + 1], -1) = n
  FROM (SELECT id, d, n, m, lo, hi, list_transform(spot, lambda x: CASE WHEN x[1] < 0 THEN -1 ELSE x[1] + eq[x[1] + 1][x[1] - x[2] + 1] END) AS v
    FROM (SELECT p.id, p.d + 1 AS d, f.n, f.m, f.eq, p.lo, p.hi, list_transform(range(0, p.d + 2), lambda q:
        [CASE WHEN 2 * q - p.d - 1 < p.lo OR 2 * q - p.d - 1 > p.hi THEN -1
          WHEN CASE WHEN q > 0 THEN p.v[q] ELSE -1 END < CASE WHEN q <= p.d THEN p.v[q + 1] ELSE -1 END THEN p.v[q + 1]
          WHEN q > 0 AND p.v[q] >= 0 THEN p.v[q] + 1 ELSE -1 END, 2 * q - p.d - 1]) AS spot
      FROM steps p JOIN ahead f ON f.id = p.id WHERE NOT p.done))),
back AS (
  SELECT s.id, s.d, z.n - z.m AS k FROM steps s JOIN sizes z ON z.id = s.id WHERE s.done
  UNION ALL
  SELECT b.id, b.d - 1, b.k + CASE WHEN CASE WHEN b.d + b.k >= 2 THEN s.v[(b.d + b.k) // 2] ELSE -1 END < CASE WHEN b.k < b.d THEN s.v[(b.d + b.k) // 2 + 1] ELSE -1 END THEN 1 ELSE -1 END
  FROM back b JOIN steps s ON s.id = b.id AND s.d = b.d - 1 WHERE b.d > 0),
path AS (
  SELECT id, d, x, x - k AS y, CASE WHEN d = 0 THEN NULL WHEN k < k0 THEN 1 ELSE -1 END AS edit, CASE WHEN d = 0 THEN x WHEN k < k0 THEN x - x0 ELSE x - x0 - 1 END AS slide
  FROM (SELECT *, lag(x) OVER w AS x0, lag(k) OVER w AS k0 FROM (SELECT b.id, b.d, b.k, s.v[(b.d + b.k) // 2 + 1] AS x FROM back b JOIN steps s ON s.id = b.id AND s.d = b.d) WINDOW w AS (PARTITION BY id ORDER BY d))),
moves AS (
  SELECT id, d, 0 AS part, edit AS op, 1 AS n, x - slide - CASE WHEN edit < 0 THEN 1 ELSE 0 END AS i, y - slide - CASE WHEN edit > 0 THEN 1 ELSE 0 END AS j FROM path WHERE edit IS NOT NULL
  UNION ALL
  SELECT id, d, 1, 0, slide, x - slide, y - slide FROM path WHERE slide > 0),
runs AS MATERIALIZED (
  SELECT id, row_number() OVER (PARTITION BY id ORDER BY g) AS run, any_value(op) AS op, sum(n)::BIGINT AS n, min(i)::BIGINT AS i, min(j)::BIGINT AS j
  FROM (SELECT *, sum(CASE WHEN op = before THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY d, part) AS g FROM (SELECT *, lag(op) OVER (PARTITION BY id ORDER BY d, part) AS before FROM moves)) GROUP BY id, g)
"""


def script(pairs: str, id_: str, a: str, b: str, ka: str = "a", kb: str = "b") -> str:
    """CTEs from ``t`` to ``runs`` for pairs (old, new) with a key."""
    return f"t AS MATERIALIZED (SELECT *, {ka} AS ka, {kb} AS kb FROM (SELECT {id_} AS id, old, new, {a} AS a, {b} AS b FROM {pairs})),{SEARCH}"


#: ``runs`` -> ``found`` (id, run, op, n, value): change lists of the modes whose tokens are joined as they are.
VALUES = """,
found AS (SELECT r.id, run, op, r.n, CASE WHEN op < 0 THEN array_to_string(t.a[i + 1:i + r.n], '') ELSE array_to_string(t.b[j + 1:j + r.n], '') END AS value FROM runs r JOIN t ON t.id = r.id)
"""


def words(ws: str) -> str:
    """``runs`` -> ``found`` for words, whose tokens carry the white space on both sides; ``ws`` is the class of white space.

    A run has at its two ends what the gaps there leave it. Unchanged runs beside a gap hold a word,
    so what one gap does to a run's beginning and the next one to its end are independent.
    """
    lead, trail = (lambda x: f"regexp_extract({x}, '^[{ws}]*')"), (lambda x: f"regexp_extract({x}, '[{ws}]*$')")
    common = lambda f, x, y: f"list_max(list_filter(range(0, least(length({x}), length({y})) + 1), lambda q: {f}({x}, q) = {f}({y}, q)))"
    # The longest end of x that y begins with.
    overlap = lambda x, y: f"list_max(list_filter(range(0, least(length({x}), length({y})) + 1), lambda q: right({x}, q) = left({y}, q)))"
    off_end = lambda x, y: f"CASE WHEN ends_with({x}, {y}) THEN left({x}, length({x}) - length({y})) ELSE {x} END"
    off_start = lambda x, y: f"CASE WHEN starts_with({x}, {y}) THEN substr({x}, length({y}) + 1) ELSE {x} END"
    joined = lambda side, at: f"(SELECT t.{side}[{at} + 1] || array_to_string(list_transform(t.{side}[{at} + 2:{at} + r.n], lambda x: regexp_replace(x, '^[{ws}]+', '')), ''))"
    return f""",
raw AS MATERIALIZED (SELECT r.id, run, op, r.n, CASE WHEN op < 0 THEN {joined('a', 'i')} ELSE {joined('b', 'j')} END AS value, sum(CASE WHEN op = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY r.id ORDER BY run) AS gap FROM runs r JOIN t ON t.id = r.id),
gaps AS (
  SELECT g.*, s.value AS s, e.value AS e, {lead('d')} AS dl, {trail('d')} AS dt, {lead('i')} AS il, {trail('i')} AS it, {lead('e.value')} AS el, {trail('s.value')} AS st
  FROM (SELECT id, gap, max(value) FILTER (op < 0) AS d, max(value) FILTER (op > 0) AS i FROM raw WHERE op <> 0 GROUP BY id, gap) g
  LEFT JOIN raw s ON s.id = g.id AND s.op = 0 AND s.gap = g.gap LEFT JOIN raw e ON e.id = g.id AND e.op = 0 AND e.gap = g.gap + 1),
shares AS (
  SELECT *, CASE WHEN d IS NULL OR s IS NULL THEN 0 WHEN i IS NOT NULL THEN {common('left', 'dl', 'il')} WHEN e IS NOT NULL THEN {common('left', 'el', 'dl')} ELSE {overlap('st', 'dl')} END AS p,
    CASE WHEN d IS NULL OR e IS NULL THEN 0 WHEN i IS NOT NULL THEN {common('right', 'dt', 'it')} WHEN s IS NULL THEN {overlap('dt', 'el')} ELSE NULL END AS q0 FROM gaps),
ends AS (SELECT *, coalesce(q0, {common('right', 'substr(el, p + 1)', 'dt')}) AS q FROM shares),
settled AS MATERIALIZED (
  SELECT id, gap,
    CASE WHEN s IS NULL OR e IS NULL OR i IS NOT NULL THEN left(substr(d, p + 1), greatest(length(d) - p - q, 0)) ELSE {off_end('substr(d, p + 1)', 'right(dt, q)')} END AS d,
    CASE WHEN d IS NOT NULL THEN substr({off_end('i', 'right(dt, q)')}, p + 1) WHEN s IS NOT NULL THEN substr(i, length(il) + 1) ELSE i END AS i,
    CASE WHEN d IS NOT NULL AND i IS NOT NULL THEN il WHEN d IS NOT NULL AND e IS NOT NULL THEN el ELSE '' END AS s_off,
    CASE WHEN d IS NOT NULL AND i IS NOT NULL THEN left(i, p) WHEN d IS NOT NULL AND e IS NOT NULL THEN left(el, length(el) - q) ELSE '' END AS s_on,
    CASE WHEN d IS NOT NULL AND i IS NOT NULL THEN it WHEN i IS NOT NULL OR s IS NOT NULL THEN el ELSE '' END AS e_off,
    CASE WHEN d IS NOT NULL AND (i IS NOT NULL OR s IS NOT NULL) THEN right(dt, q) ELSE '' END AS e_on
  FROM ends),
shown AS (
  SELECT r.id, r.run, r.op, r.n, CASE WHEN r.op < 0 THEN g.d WHEN r.op > 0 THEN g.i ELSE
    CASE WHEN g.id IS NULL THEN v ELSE {off_end('v', 'g.s_off')} || g.s_on END END AS value
  FROM (SELECT r.*, CASE WHEN h.id IS NULL THEN r.value ELSE h.e_on || {off_start('r.value', 'h.e_off')} END AS v FROM raw r LEFT JOIN settled h ON r.op = 0 AND h.id = r.id AND h.gap = r.gap - 1) r
  LEFT JOIN settled g ON g.id = r.id AND g.gap = r.gap),
found AS (
  SELECT id, min(run) AS run, any_value(op) AS op, sum(n)::BIGINT AS n, string_agg(value, '' ORDER BY run) AS value
  FROM (SELECT *, sum(CASE WHEN op = was THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY run) AS g FROM (SELECT *, lag(op) OVER (PARTITION BY id ORDER BY run) AS was FROM shown WHERE value <> '')) GROUP BY id, g)
"""
