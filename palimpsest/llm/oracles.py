"""SQL (DuckDB) for the operators that SQL can express, over whole tables."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lower(text: str) -> str:
    return f"translate({text}, '{_UPPER}', '{_LOWER}')"


_SPACE_WORDS = r"[^\x20\x09-\x0D]+"
_ALNUM_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Hex digits of the text's bytes, two a byte; windows are counted from 0.
OP1 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS k FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM d)),
f AS (SELECT k, min(doc_id) AS first FROM w GROUP BY k HAVING min(doc_id) < max(doc_id)),
s AS (SELECT w.doc_id, w.i FROM w JOIN f USING (k) WHERE f.first < w.doc_id),
g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM s)),
r AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM g GROUP BY doc_id, run),
t AS (SELECT doc_id, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b, sum(b - a) AS n, count(*) AS c FROM r GROUP BY doc_id)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(c, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN c IS NULL THEN h ELSE array_to_string(list_transform(range(1, c + 2), lambda j: substr(h, 2 * CASE WHEN j = 1 THEN 0 ELSE b[j - 1] END + 1, 2 * (CASE WHEN j > c THEN length(h) // 2 ELSE a[j] END - CASE WHEN j = 1 THEN 0 ELSE b[j - 1] END))), '') END)) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)
"""

OP2 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_lower("coalesce(text, '')")}, '{_SPACE_WORDS}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (k) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, (SELECT min(b) FROM reach WHERE a = doc_id) AS component_id, (SELECT count(*) FROM l WHERE a = doc_id) AS n_links
FROM documents LEFT JOIN n USING (doc_id)
"""

OP4 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_lower("coalesce(text, '')")}, '{_ALNUM_WORDS}') AS w FROM documents),
i AS (SELECT item_id, w, least(10, len(w)) AS size FROM (SELECT item_id, regexp_extract_all({_lower('text')}, '{_ALNUM_WORDS}') AS w FROM benchmark WHERE text IS NOT NULL) WHERE len(w) > 0),
k AS (SELECT DISTINCT item_id, size, array_to_string(w[j:j + size - 1], ' ') AS k FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS j FROM i)),
q AS (SELECT doc_id, j, size, array_to_string(w[j:j + size - 1], ' ') AS k FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS j FROM d, (SELECT DISTINCT size FROM k) WHERE len(w) >= size)),
h AS (SELECT q.doc_id, q.j, q.size, k.item_id FROM q JOIN k USING (size, k)),
n AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(j, j + size)) AS p FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS c, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_hit, coalesce(c, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""

OP5 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACE_WORDS}') AS w FROM documents),
v AS (SELECT doc_id, j, array_to_string(w[j:j + 19], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS j FROM d WHERE len(w) >= 20)),
s AS (SELECT doc_id, j FROM (SELECT doc_id, j, row_number() OVER (PARTITION BY k ORDER BY doc_id, j) AS o FROM v) WHERE o > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(j, j + 20)) AS p FROM s),
t AS (SELECT doc_id, list(p) AS p, count(*) AS n FROM g GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
  sha256(CASE WHEN n IS NULL THEN array_to_string(w, ' ') ELSE array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda x: NOT list_contains(p, x)), lambda x: w[x]), ' ') END) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)
"""

ORACLES = {"op1_suffix_dedup": OP1, "op2_jaccard_join": OP2, "op4_decontamination": OP4, "op5_superkmer_dedup": OP5}
