"""Registered queries of the comparison operators, with SQL for those that SQL can express.

Each runs over whole tables. Results that hang on the fixed choice among equally short edit
scripts have SQL that makes the same choice (``scripts_sql``) where its tables stay small;
tests hold the others against slow twins.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions import columns as N
from ..functions import rules as R
from ..operators import frames as K
from ..sources import pairs as P
from . import lines as LN
from . import scripts_sql as S
from . import timeline as T

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def docs(spark: SparkSession, d: str):
    return spark.read.parquet(f"{d}/documents.parquet")


# RE2 writes code points in braces where Java takes \u; both mean the same sets.
def _re2(pattern: str) -> str:
    import re

    return re.sub(r"\\u([0-9a-f]{4})", r"\\x{\1}", pattern).replace("'", "''")


WS, W = _re2(R.WS), _re2(R.W)
SPACED = _re2("\\t\\x0B\\f \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff")
SQL_TOKENS = {
    "chars": "regexp_extract_all({t}, '(?s).')",
    "wordsWithSpace": f"regexp_extract_all({{t}}, '\\r?\\n|[{W}]+|[{SPACED}]+|[^{W}]')",
    "lines": "regexp_extract_all({t}, '[^\\n]*\\n|[^\\n]+')",
    "sentences": f"list_filter(string_split(regexp_replace({{t}}, '([.!?])([{WS}]+)', '\\1' || chr(30) || '\\2' || chr(30), 'g'), chr(30)), lambda x: x <> '')",
}
SQL_PARTS = f"regexp_extract_all({{t}}, '[{W}]+|[{WS}]+|[^{W}]')"
_space = f"regexp_matches({{x}}, '^[{WS}]')"
_solid = lambda x: _space.replace("{x}", x)


def _sql_tokens(mode: str, text: str) -> str:
    return SQL_TOKENS[mode].replace("{t}", text)


SQL_TOKENS["words"] = (
    f"(SELECT CASE WHEN len(p) = 1 AND {_solid('p[1]')} THEN p ELSE list_filter(list_transform(range(1, len(p) + 1), lambda i: CASE WHEN {_solid('p[i]')} THEN NULL ELSE "
    f"CASE WHEN i > 1 AND {_solid('p[i - 1]')} THEN p[i - 1] ELSE '' END || p[i] || CASE WHEN i < len(p) AND {_solid('p[i + 1]')} THEN p[i + 1] ELSE '' END END), lambda x: x IS NOT NULL) END "
    f"FROM (SELECT {SQL_PARTS} AS p))"
)
#: What words are compared by: the parts without the white space around them; text of white space only is one empty word.
SQL_KEYS = f"(SELECT CASE WHEN len(p) = 1 AND {_solid('p[1]')} THEN [''] ELSE list_filter(p, lambda x: NOT {_solid('x')}) END FROM (SELECT {SQL_PARTS} AS p))"
MODE_NAMES = {"chars": "chars", "words": "words", "wordsWithSpace": "words_space", "lines": "lines", "sentences": "sentences"}


def _digest(tokens):
    return F.size(tokens).cast("long").alias("n_tokens"), F.md5(F.array_join(tokens, "\x1f")).alias("digest")


def _tokens(mode):
    tokens_sql = _sql_tokens(mode, "text")

    @query(f"tokens_{MODE_NAMES[mode]}", f"SELECT doc_id, len(k)::BIGINT AS n_tokens, md5(array_to_string(k, chr(31))) AS digest FROM (SELECT doc_id, {tokens_sql} AS k FROM documents)")
    def tokens(spark, d):
        k = docs(spark, d).select("doc_id", N.tokens(mode, "text").alias("k"))
        return k.select("doc_id", *_digest(F.col("k")))


for _mode in R.MODES:
    _tokens(_mode)


def _scalar(name, column, sql):
    @query(name, f"SELECT doc_id, {sql} AS v FROM documents")
    def scalar(spark, d):
        return docs(spark, d).select("doc_id", column().alias("v"))


_trimmed = lambda s: f"regexp_replace({s}, '\\A[{WS}]+|[{WS}]+\\z', '', 'g')"
_quotes = lambda s: f"translate({s}, '“”„‘’‚', '\"\"\"''''''')"
_prepared = lambda s: _trimmed(f"regexp_replace({s}, '[{WS}]+', ' ', 'g')")
_escaped = lambda s: f"replace(replace(replace(replace(replace(regexp_replace({s}, '\\r\\n?', chr(10), 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"
_scalar("normalize_quotes", lambda: F.md5(N.normalize_quotes("text")), f"md5({_quotes('text')})")
_scalar("prepare_similarity", lambda: F.md5(N.prepare("text", html=False)), f"md5({_prepared(_quotes('text'))})")
_scalar("non_ws_length", lambda: N.solid_length("text").cast("long"), f"length(regexp_replace(text, '[{WS}]+', '', 'g'))::BIGINT")
_scalar("code_point_length", lambda: F.char_length("text").cast("long"), "length(text)::BIGINT")
_scalar("escape_html", lambda: F.md5(N.escape("text")), f"md5({_escaped('text')})")
_scalar("display_text", lambda: F.md5(N.display("text")), "md5(regexp_replace(text, '\\r\\n?', chr(10), 'g'))")
_scalar("line_count", lambda: F.size(N.split_lines("text")).cast("long"), "len(regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+'))::BIGINT")


@query("prepare_similarity_html", f"SELECT page_id, md5({_prepared(_quotes("regexp_replace(html, '<[^>]*>', ' ', 'g')"))}) AS v FROM pages")
def prepare_similarity_html(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.md5(N.prepare("html")).alias("v"))


@query(
    "similarity_scalars",
    "SELECT l_orderkey, l_linenumber, floor(l_discount * 100 + 0.5)::BIGINT AS percent, CASE WHEN s >= 1 THEN 0 WHEN s >= 0.75 THEN 1 WHEN s >= 0.5 THEN 2 WHEN s >= 0.25 THEN 3 ELSE 4 END AS heat, "
    "CASE WHEN s >= 1 THEN 0 ELSE greatest(1, 100 - floor(s * 100 + 0.5)) END::BIGINT AS changed, h AS place, (h // 100) || '.' || lpad((h % 100)::VARCHAR, 2, '0') || '%' AS shown "
    "FROM (SELECT *, l_discount * 10 AS s, (2 * l_linenumber * 10000 + 7) // 14 AS h FROM lineitem)",
)
def similarity_scalars(spark, d):
    """Percent, heat level, changed percent and minimap position over numeric columns."""
    t = spark.read.parquet(f"{d}/lineitem.parquet").withColumn("s", F.col("l_discount") * 10).withColumn("h", N.hundredths("l_linenumber", F.lit(7)))
    return t.select("l_orderkey", "l_linenumber", N.percent("l_discount").alias("percent"), N.heat_level("s").alias("heat"), N.changed_percent("s").alias("changed"), F.col("h").alias("place"), N.format_hundredths("h").alias("shown"))


DOCS, TALK, PAGES = P.PAIRS_SQL["documents"], P.PAIRS_SQL["conversations"], P.PAIRS_SQL["pages"]
#: Length of the longest common subsequence of two lists, row by row of the usual table.
LCS = "(SELECT coalesce(list_last(list_reduce(list_prepend(list_transform(range(0, len({b}) + 1), lambda x: 0::BIGINT), list_transform({a}, lambda x: list_prepend(0::BIGINT, list_transform({b}, lambda y: (x = y)::BIGINT)))), lambda r, m: list_reduce(list_transform(range(1, len(r)), lambda j: [greatest(r[j + 1], r[j] + m[j + 1])]), lambda p, q: list_append(p, greatest(list_last(p), q[1])), [0::BIGINT]))), 0::BIGINT))"


def _lcs(a: str, b: str) -> str:
    return LCS.format(a=a, b=b)


TURN, DOC = "{'conv_id': conv_id, 'turn': turn}", "{'doc_id': doc_id}"


def _script(mode: str, pairs: str, key: str) -> str:
    """SQL tables ``t`` (the pairs by ``id``) and ``runs`` (their edit scripts)."""
    keys = [SQL_KEYS.replace("{t}", c) for c in ("old", "new")] if mode == "words" else ["a", "b"]
    return "WITH RECURSIVE " + S.script(pairs, key, _sql_tokens(mode, "old"), _sql_tokens(mode, "new"), *keys)


def _found(mode: str, pairs: str = TALK, key: str = TURN) -> str:
    """SQL tables up to ``found``: change lists, with what the views count."""
    return _script(mode, pairs, key) + (S.words(WS) if mode == "words" else S.VALUES) + ", " + FOUND


#: Changes with their running number among the changed ones and their place in the new text.
FOUND = """counted AS MATERIALIZED (
  SELECT *, CASE WHEN op <> 0 THEN count(*) FILTER (op <> 0) OVER w - 1 END AS index, sum(CASE WHEN op < 0 THEN 0 ELSE length(value) END) OVER w AS stop, sum(CASE WHEN op < 0 THEN 0 ELSE length(value) END) OVER (PARTITION BY id) AS total
  FROM found WINDOW w AS (PARTITION BY id ORDER BY run ROWS UNBOUNDED PRECEDING))"""
_kind = lambda of, kind: f"coalesce(sum({of}) FILTER (op {kind} 0), 0)::BIGINT"
PER_PAIR = f"""(SELECT t.id, count(c.id)::INTEGER AS n_changes, {_kind('length(value)', '>')} AS added, {_kind('length(value)', '<')} AS removed, {_kind('length(value)', '=')} AS unchanged,
  coalesce(list({{'value': value, 'added': op > 0, 'removed': op < 0, 'count': n}} ORDER BY run) FILTER (c.id IS NOT NULL), []) AS c FROM t LEFT JOIN counted c ON c.id = t.id GROUP BY t.id)"""
_hundredths = lambda p, t: f"CASE WHEN {t} <= 0 THEN 0 ELSE (2 * {p} * 10000 + {t}) // (2 * {t}) END"


def _similarity_sql(pairs: str, key: str) -> str:
    """(id, similarity) of pairs of plain texts."""
    ready = f"(SELECT * REPLACE ({_prepared(_quotes('old'))} AS old, {_prepared(_quotes('new'))} AS new) FROM {pairs})"
    solid = lambda c: f"length(regexp_replace({c}, '[{WS}]+', '', 'g'))"
    same = "(SELECT id, sum(list_sum(list_transform(t.kb[j + 1:j + n], lambda x: length(x)))) AS same FROM runs JOIN t USING (id) WHERE op = 0 GROUP BY id)"
    return f"{_script('words', ready, key)} SELECT t.id, CASE WHEN old = '' AND new = '' THEN 1.0 WHEN old = '' OR new = '' THEN 0.0 ELSE least(2 * coalesce(same, 0) / ({solid('old')} + {solid('new')})::DOUBLE, 1.0) END::DOUBLE AS similarity FROM t LEFT JOIN {same} USING (id)"


def _per_kind(changes):
    return N.stats(changes, lambda c: c["count"])


def _line_counts(pairs_sql, key):
    a, b = _sql_tokens("lines", "old"), _sql_tokens("lines", "new")
    return f"SELECT {key}, len(b) - c AS added, len(a) - c AS removed, c AS unchanged FROM (SELECT {key}, a, b, {_lcs('a', 'b')} AS c FROM (SELECT {key}, {a} AS a, {b} AS b FROM {pairs_sql}))"


@query("token_counts_lines", _line_counts(DOCS, "doc_id"))
def token_counts_lines(spark, d):
    """Lines kept, removed and added, by the edit script."""
    s = P.document_revisions(spark, d).select("doc_id", _per_kind(K.changes("lines", "old", "new")).alias("s"))
    return s.select("doc_id", "s.added", "s.removed", "s.unchanged")


@query("edit_distance_lines", f"SELECT doc_id, added + removed AS distance FROM ({_line_counts(DOCS, 'doc_id')})")
def edit_distance_lines(spark, d):
    ops = P.document_revisions(spark, d).select("doc_id", K.operations("lines", "old", "new").alias("ops"))
    return ops.select("doc_id", F.aggregate("ops", F.lit(0).cast("long"), lambda t, x: t + F.when(x["op"] != 0, x["count"]).otherwise(0)).alias("distance"))


#: Length of the longest common subsequence of two strings: for each length the shortest beginning of ``b`` that has one, after each character of ``a``.
LCS_CHARS = "(len(list_reduce(list_prepend([0], list_transform(regexp_extract_all({a}, '(?s).'), lambda x: [unicode(x)])), lambda t, x: list_filter(list_transform(range(0, len(t) + 1), lambda k: CASE WHEN k = 0 THEN 0 ELSE least(coalesce(t[k + 1], 2147483647), coalesce(t[k] + nullif(strpos(substr({b}, t[k] + 1), chr(x[1])), 0), 2147483647)) END::INTEGER), lambda y: y < 2147483647))) - 1)"


def _distance_sql(mode: str) -> str:
    if mode == "chars":
        return f"SELECT conv_id, turn, (length(old) + length(new) - 2 * {LCS_CHARS.format(a='old', b='new')})::BIGINT AS distance FROM {TALK}"
    a, b = (SQL_KEYS.replace("{t}", c) if mode == "words" else _sql_tokens(mode, c) for c in ("old", "new"))
    return f"SELECT conv_id, turn, (len(a) + len(b) - 2 * {_lcs('a', 'b')})::BIGINT AS distance FROM (SELECT conv_id, turn, {a} AS a, {b} AS b FROM {TALK})"


def _distance(mode):
    @query(f"edit_distance_{MODE_NAMES[mode]}", _distance_sql(mode))
    def distance(spark, d):
        ops = P.conversation_revisions(spark, d).select("conv_id", "turn", K.operations(mode, "old", "new").alias("ops"))
        return ops.select("conv_id", "turn", F.aggregate("ops", F.lit(0).cast("long"), lambda t, x: t + F.when(x["op"] != 0, x["count"]).otherwise(0)).alias("distance"))


for _mode in ("chars", "words", "wordsWithSpace", "sentences"):
    _distance(_mode)


def _rebuild(side, mode):
    @query(f"rebuild_{side}_{MODE_NAMES[mode]}", f"SELECT doc_id, md5({side}) AS v FROM {DOCS}")
    def rebuild(spark, d):
        return P.document_revisions(spark, d).select("doc_id", F.md5(N.rebuilt(K.changes(mode, "old", "new"), side)).alias("v"))


for _mode in ("wordsWithSpace", "lines", "sentences"):
    _rebuild("old", _mode)
    _rebuild("new", _mode)


def _changes(mode):
    # The search in SQL keeps a table of all pairs of tokens, too large for characters.
    @query(f"changes_{MODE_NAMES[mode]}", None if mode == "chars" else f"{_found(mode)} SELECT id.conv_id AS conv_id, id.turn AS turn, n_changes, added, removed, unchanged, md5(to_json(c)::VARCHAR) AS digest FROM {PER_PAIR}")
    def changes(spark, d):
        c = P.conversation_revisions(spark, d).select("conv_id", "turn", K.changes(mode, "old", "new").alias("c"))
        return c.select("conv_id", "turn", F.size("c").alias("n_changes"), N.stats("c").alias("s"), F.md5(F.to_json("c")).alias("digest")).select("conv_id", "turn", "n_changes", "s.added", "s.removed", "s.unchanged", "digest")


for _mode in R.MODES:
    _changes(_mode)


def _change_rows(pairs, key, changes):
    c = pairs.select(*key, changes.alias("c"))
    return c.select(*key, F.size("c").alias("n_changes"), N.stats("c").alias("s"), F.md5(F.to_json("c")).alias("digest")).select(*key, "n_changes", "s.added", "s.removed", "s.unchanged", "digest")


def _option(name, tokens, key, **options):
    """Line changes of document pairs under one option; ``tokens`` of a text and the ``key`` of a token x in SQL."""
    a, b = tokens.replace("{t}", "old"), tokens.replace("{t}", "new")
    script = S.script(f"(SELECT doc_id, replace(old, chr(10), chr(13) || chr(10)) AS old, new FROM {DOCS})" if name == "strip_cr" else DOCS, DOC, a, b, *(f"list_transform({c}, lambda x: {key})" for c in "ab"))

    @query(f"changes_lines_{name}", f"WITH RECURSIVE {script}{S.VALUES}, {FOUND} SELECT id.doc_id AS doc_id, n_changes, added, removed, unchanged, md5(to_json(c)::VARCHAR) AS digest FROM {PER_PAIR}")
    def changes(spark, d):
        old = F.replace("old", F.lit("\n"), F.lit("\r\n")) if name == "strip_cr" else F.col("old")
        return _change_rows(P.document_revisions(spark, d).select("doc_id", old.alias("old"), "new"), ["doc_id"], K.changes("lines", "old", "new", **options))


_option("ignore_case", SQL_TOKENS["lines"], "lower(x)", ignoreCase=True)
_option("ignore_whitespace", SQL_TOKENS["lines"], _trimmed("x"), ignoreWhitespace=True)
# The documents hold no carriage return; a terminator and a line's content are tokens of their own.
_option("parts", "regexp_extract_all({t}, '\\n|[^\\n]+')", "x", newlineIsToken=True)
_option("strip_cr", SQL_TOKENS["lines"].replace("{t}", "replace({t}, chr(13) || chr(10), chr(10))"), "x", stripTrailingCr=True)

#: Most edits of a pair in ``changes_words_capped``.
CAP = 40
_plain = "SELECT t.id, {'value': t.old, 'added': false, 'removed': true, 'count': len(t.a)::BIGINT} AS gone, {'value': t.new, 'added': true, 'removed': false, 'count': len(t.b)::BIGINT} AS come, s.d FROM t JOIN steps s ON s.id = t.id AND s.done"


@query("changes_words_capped", f"{_found('words')} SELECT id.conv_id AS conv_id, id.turn AS turn, len(c)::INTEGER AS n_changes, md5(to_json(c)::VARCHAR) AS digest FROM (SELECT p.id, CASE WHEN w.d > {CAP} THEN list_filter([gone, come], lambda x: x.value <> '') ELSE c END AS c FROM {PER_PAIR} p JOIN ({_plain}) w ON w.id = p.id)")
def changes_words_capped(spark, d):
    """Change lists with an edit limit; beyond it the whole text is replaced."""
    c = P.conversation_revisions(spark, d).select("conv_id", "turn", K.changes("words", "old", "new", maxEditLength=CAP).alias("c"))
    return c.select("conv_id", "turn", F.size("c").alias("n_changes"), F.md5(F.to_json("c")).alias("digest"))


@query(
    "array_operations",
    f"WITH RECURSIVE {S.script(TALK, TURN, 'string_split(old, chr(32))', 'string_split(new, chr(32))')} SELECT t.id.conv_id AS conv_id, t.id.turn AS turn, coalesce(string_agg(op || ' ' || n, ',' ORDER BY run), '') AS ops FROM t LEFT JOIN runs r ON r.id = t.id GROUP BY t.id",
)
def array_operations(spark, d):
    """The edit script of any two arrays of strings."""
    ops = P.conversation_revisions(spark, d).select("conv_id", "turn", K.array_operations(F.split("old", " "), F.split("new", " ")).alias("ops"))
    return ops.select("conv_id", "turn", F.array_join(F.transform("ops", lambda x: F.concat_ws(" ", x["op"].cast("string"), x["count"].cast("string"))), ",").alias("ops"))


_badge = lambda kind, sign: f"""'<span class="diff-stat diff-stat-{kind}"><span aria-hidden="true">{sign}' || {kind} || '</span><span class="diff-sr">' || {kind} || CASE WHEN {kind} = 1 THEN ' character' ELSE ' characters' END || ' {kind}</span></span>'"""


@query("render_stats", f"""{_found('words')} SELECT id.conv_id AS conv_id, id.turn AS turn, '<div class="text-diff-stats" data-unit="codepoints">' || {_badge('added', '+')} || {_badge('removed', '−')} || {_badge('unchanged', '=')} || '</div>' AS html FROM {PER_PAIR}""")
def render_stats(spark, d):
    return P.conversation_revisions(spark, d).select("conv_id", "turn", N.render_stats(K.statistics("words", "old", "new")).alias("html"))


@query("table_functions", f"SELECT conv_id, turn, i::INTEGER AS position, md5(k[i]) AS sentence FROM (SELECT conv_id, turn, k, unnest(range(1, len(k) + 1)) AS i FROM (SELECT conv_id, turn, {_sql_tokens('sentences', 'text')} AS k FROM conversations)) WHERE regexp_replace(k[i], '[{WS}]+', '', 'g') <> ''")
def table_functions(spark, d):
    """``sentences_of`` as a LATERAL table function."""
    from ..functions import sql

    sql.register(spark)
    spark.read.parquet(f"{d}/conversations.parquet").createOrReplaceTempView("palimpsest_talk")
    return spark.sql("SELECT conv_id, turn, s.position, md5(s.text) AS sentence FROM palimpsest_talk, LATERAL sentences_of(text) s")


def _numbered(side):
    number = _sql_tokens("lines", side)

    @query(
        f"line_numbers_{side}",
        f"SELECT doc_id, i AS line_no, md5(regexp_replace(k[i], '\\r?\\n\\z', '')) AS v FROM (SELECT doc_id, k, unnest(range(1, len(k) + 1)) AS i FROM (SELECT doc_id, {number} AS k FROM {DOCS}))",
    )
    def numbered(spark, d):
        r = LN.rows(P.document_revisions(spark, d), ["doc_id"])
        return r.filter(f"{side}_no is not null").select("doc_id", F.col(f"{side}_no").cast("long").alias("line_no"), F.md5("text").alias("v"))


_numbered("old")
_numbered("new")


@query("line_stats_unified", _line_counts(DOCS, "doc_id"))
def line_stats_unified(spark, d):
    # A pair of two empty texts has no rows; it counts nothing, as its edit script does.
    pairs = P.document_revisions(spark, d)
    got = LN.stats(LN.rows(pairs, ["doc_id"]), ["doc_id"])
    return pairs.select("doc_id").join(got, "doc_id", "left").select("doc_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("added", "removed", "unchanged")])


@query("line_stats_split", _line_counts(DOCS, "doc_id"))
def line_stats_split(spark, d):
    s = P.document_revisions(spark, d).select("doc_id", K.statistics("split", "old", "new").alias("s"))
    return s.select("doc_id", "s.added", "s.removed", "s.unchanged")


def _rows(pairs: str) -> str:
    """Numbered line rows of pairs as table ``lines``, with what folding and pairing need."""
    return f"""{_script('lines', pairs, DOC)},
parts AS (SELECT r.id, run, op, unnest(range(0, r.n)) AS q, i, j, t.a, t.b FROM runs r JOIN t ON t.id = r.id),
lines AS MATERIALIZED (
  SELECT id, row_number() OVER (PARTITION BY id ORDER BY run, q) AS row_no, CASE WHEN op < 0 THEN 'removed' WHEN op > 0 THEN 'added' ELSE 'equal' END AS type,
    CASE WHEN op <= 0 THEN i + q + 1 END AS old_no, CASE WHEN op >= 0 THEN j + q + 1 END AS new_no, regexp_replace(CASE WHEN op < 0 THEN a[i + q + 1] ELSE b[j + q + 1] END, '\\r?\\n\\z', '') AS text FROM parts)"""
ROWS = _rows(DOCS)
_by_row = "(PARTITION BY id ORDER BY row_no)"
_row_json = "'{\"row_no\":' || row_no || ',\"type\":\"' || type || '\"' || coalesce(',\"old_no\":' || old_no, '') || coalesce(',\"new_no\":' || new_no, '') || ',\"text\":' || to_json(text)::VARCHAR || '}'"
BLOCKS = f"""
near AS (SELECT *, max(type <> 'equal') OVER (PARTITION BY id ORDER BY row_no ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near, max(type <> 'equal') OVER (PARTITION BY id) AS altered FROM {{lines}}),
seen AS (SELECT *, near OR altered AND coalesce(lag(near) OVER {_by_row}, true) AND coalesce(lead(near) OVER {_by_row}, true) AS shown FROM near),
cut AS (SELECT *, coalesce(lag(shown) OVER {_by_row} <> shown, false)::INTEGER AS step FROM seen),
blocks AS (SELECT *, sum(step) OVER {_by_row} AS block FROM cut)"""
HUNKS_SQL = f"""{ROWS},{BLOCKS.format(lines='lines')},
summed AS (SELECT id, block, CASE WHEN any_value(shown) THEN 'hunk' ELSE 'collapsed' END AS type, count(old_no) AS old_lines, count(new_no) AS new_lines, count(*) AS n, '[' || string_agg({_row_json}, ',' ORDER BY row_no) || ']' AS rows FROM blocks GROUP BY id, block)
SELECT id.doc_id AS doc_id, block::INTEGER AS block, type, (1 + coalesce(sum(old_lines) OVER b, 0))::BIGINT AS old_start, old_lines, (1 + coalesce(sum(new_lines) OVER b, 0))::BIGINT AS new_start, new_lines, n AS count, md5(rows) AS rows
FROM summed WINDOW b AS (PARTITION BY id ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
SPLIT_SQL = f"""{ROWS},
marked AS (SELECT *, CASE WHEN type = 'equal' OR coalesce(lag(type) OVER {_by_row}, 'equal') = 'equal' THEN 1 ELSE 0 END AS fresh FROM lines),
numbered AS (SELECT *, sum(fresh) OVER {_by_row} AS run FROM marked),
placed AS (SELECT *, row_number() OVER (PARTITION BY id, run, type ORDER BY row_no) AS place FROM numbered)
SELECT coalesce(l.id, r.id).doc_id AS doc_id, coalesce(l.run, r.run)::BIGINT AS run, coalesce(l.place, r.place)::INTEGER AS place, CASE WHEN l.type = 'equal' THEN 'equal' WHEN l.type IS NULL THEN 'added' WHEN r.type IS NULL THEN 'removed' ELSE 'modified' END AS type,
  l.old_no::VARCHAR AS left_no, md5(l.text) AS left_text, coalesce(r.new_no, l.new_no)::VARCHAR AS right_no, md5(CASE WHEN l.type = 'equal' THEN l.text ELSE r.text END) AS right_text
FROM (SELECT * FROM placed WHERE type <> 'added') l FULL JOIN (SELECT * FROM placed WHERE type = 'added') r ON l.id = r.id AND l.run = r.run AND l.place = r.place"""
MARKS_SQL = f"""{ROWS},
counted AS (SELECT *, count(new_no) OVER (PARTITION BY id ORDER BY row_no ROWS UNBOUNDED PRECEDING) AS stop, count(new_no) OVER (PARTITION BY id) AS total, row_number() OVER {_by_row} - row_number() OVER (PARTITION BY id, type = 'equal' ORDER BY row_no) AS island FROM lines),
marks AS (SELECT id, min(row_no) AS first, CASE WHEN min(type) = max(type) THEN min(type) ELSE 'modified' END AS kind, {_hundredths('(max(stop) - count(new_no))', 'max(total)')} AS top, {_hundredths('max(stop)', 'max(total)')} AS bottom FROM counted WHERE type <> 'equal' GROUP BY id, island)
SELECT id.doc_id AS doc_id, (row_number() OVER (PARTITION BY id ORDER BY first) - 1)::INTEGER AS index, kind, top::INTEGER AS top, (bottom - top)::INTEGER AS height FROM marks"""


#: Blocks are taken from all like pairs of lines, the longest first; each round drops the rows of the block it took.
CHANGED = f"""
changed AS (SELECT *, length(replace(plain, ' ', '')) AS solid, regexp_extract_all(plain, '[{W}]+|[^{W} ]') AS words, count(*) FILTER (type = 'equal') OVER {_by_row} AS region FROM (SELECT *, {_prepared('text')} AS plain FROM lines)),
few AS (SELECT id, count(*) FILTER (type = 'removed') * count(*) FILTER (type = 'added') AS pairs FROM changed GROUP BY id HAVING pairs <= 1000000),
likes AS (SELECT a.id, a.row_no AS i, b.row_no AS j, a.plain = '' AS blank FROM changed a JOIN changed b ON a.id = b.id AND a.plain = b.plain AND a.region <> b.region JOIN few ON few.id = a.id WHERE a.type = 'removed' AND b.type = 'added')"""
ROUNDS = """,
rounds AS (
  SELECT id, i, j, blank, 0::BIGINT AS size FROM likes
  UNION ALL
  (WITH runs AS (
    SELECT id, min(i) FILTER (NOT blank) AS i, min(j) FILTER (NOT blank) AS j, max(i) FILTER (NOT blank) - min(i) FILTER (NOT blank) + 1 AS size
    FROM (SELECT *, i - row_number() OVER (PARTITION BY id, j - i ORDER BY i) AS island FROM rounds WHERE size = 0) GROUP BY id, j - i, island),
  best AS (SELECT DISTINCT ON (id) id, i, j, size FROM runs WHERE size > 0 ORDER BY id, size DESC, j, i)
  SELECT id, i, j, false, size::BIGINT FROM best
  UNION ALL
  SELECT c.id, c.i, c.j, c.blank, 0::BIGINT FROM rounds c JOIN best b ON b.id = c.id WHERE c.size = 0 AND c.i NOT BETWEEN b.i AND b.i + b.size - 1 AND c.j NOT BETWEEN b.j AND b.j + b.size - 1))"""
MOVES = CHANGED + ROUNDS
#: Pairs of similar lines besides the equal ones; each two texts are compared once.
NEAR_MOVES = f"""{CHANGED.replace('likes AS', 'equals AS')},
texts AS MATERIALIZED (SELECT DISTINCT a.plain AS old, b.plain AS new FROM changed a JOIN changed b ON a.id = b.id AND a.region <> b.region JOIN few ON few.id = a.id WHERE few.pairs <= 250000 AND a.type = 'removed' AND b.type = 'added' AND a.plain <> '' AND b.plain <> '' AND a.plain <> b.plain
  AND least(a.solid, b.solid) >= 0.3 * (a.solid + b.solid) AND list_has_any(a.words, b.words)),
kin AS MATERIALIZED (SELECT id.old AS old, id.new AS new FROM ({_similarity_sql('texts', "{'old': old, 'new': new}")}) WHERE similarity >= 0.6),
likes AS (SELECT * FROM equals UNION ALL SELECT a.id, a.row_no, b.row_no, false FROM kin s JOIN changed a ON a.plain = s.old AND a.type = 'removed' JOIN changed b ON b.id = a.id AND b.plain = s.new AND b.type = 'added' AND a.region <> b.region JOIN few ON few.id = a.id WHERE few.pairs <= 250000){ROUNDS}"""
BLOCKS_MOVED = """
SELECT r.id.doc_id AS doc_id, (row_number() OVER (PARTITION BY r.id ORDER BY r.j) - 1)::INTEGER AS id, x.old_no::INTEGER AS "oldStart", y.new_no::INTEGER AS "newStart", r.size::INTEGER AS lines
FROM rounds r JOIN lines x ON x.id = r.id AND x.row_no = r.i JOIN lines y ON y.id = r.id AND y.row_no = r.j WHERE r.size > 0"""
MOVES_SQL = _rows(P.PAIRS_SQL["rotated"].replace("{mark}", "")) + "," + MOVES + BLOCKS_MOVED
NEAR_MOVES_SQL = _rows(P.PAIRS_SQL["rotated"].replace("{mark}", " and so on")) + "," + NEAR_MOVES + BLOCKS_MOVED


#: Rows with their moves: the other side's line, and the move's number by new place.
MOVED = """
taken AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY j) - 1 AS move FROM rounds WHERE size > 0),
moved AS (
  SELECT l.id, l.row_no, CASE WHEN f.move IS NOT NULL THEN 'moved-from' WHEN g.move IS NOT NULL THEN 'moved-to' ELSE l.type END AS type, l.old_no, l.new_no, l.text, coalesce(f.move, g.move) AS move,
    CASE WHEN f.move IS NOT NULL THEN (SELECT new_no FROM lines y WHERE y.id = l.id AND y.row_no = f.j + l.row_no - f.i) WHEN g.move IS NOT NULL THEN (SELECT old_no FROM lines x WHERE x.id = l.id AND x.row_no = g.i + l.row_no - g.j) END AS other
  FROM lines l LEFT JOIN taken f ON l.type = 'removed' AND f.id = l.id AND l.row_no BETWEEN f.i AND f.i + f.size - 1 LEFT JOIN taken g ON l.type = 'added' AND g.id = l.id AND l.row_no BETWEEN g.j AND g.j + g.size - 1)"""
STILL = "moved AS (SELECT *, NULL::BIGINT AS move, NULL::BIGINT AS other FROM lines)"


def _unified_sql(anchors: bool) -> str:
    """From ``moved``: table ``views`` (id, html, marks) of unified views."""
    span = lambda kind, inner: f"'<span class=\"{kind}\">' || {inner} || '</span>'"
    role = "' role=\"group\" aria-label=\"' || CASE WHEN move IS NULL THEN type || ' line ' || coalesce(old_no, new_no) WHEN type = 'moved-from' THEN 'line ' || old_no || ' moved to line ' || other ELSE 'line ' || new_no || ' moved from line ' || other END || '\"'"
    link = "CASE WHEN move IS NULL THEN '' ELSE '<a class=\"diff-move-link\"' || CASE WHEN first THEN ' id=\"td-move-' || move || '-' || type[7:] || '\"' ELSE '' END || ' href=\"#td-move-' || move || CASE type WHEN 'moved-from' THEN '-to\">moved to' ELSE '-from\">moved from' END || ' line ' || other || '</a>' END"
    anchor = "|| CASE WHEN starts THEN ' id=\"td-change-' || index || '\"' ELSE '' END" if anchors else ""
    row = f"""'<div class="diff-row diff-row-' || type || coalesce(' diff-move-' || move % 6, '') || '"' {anchor} || CASE WHEN type = 'equal' THEN '' ELSE {role} END || coalesce(' data-move="' || move || '"', '') || CASE WHEN starts THEN ' data-change-index="' || index || '"' ELSE '' END || '>'
      || {span('diff-gutter diff-gutter-old', "coalesce(old_no::VARCHAR, '')")} || {span('diff-gutter diff-gutter-new', "coalesce(new_no::VARCHAR, '')")} || '<span class="diff-sign" aria-hidden="true">' || CASE type WHEN 'equal' THEN ' ' WHEN 'removed' THEN '−' WHEN 'moved-from' THEN '−' ELSE '+' END || '</span>'
      || {span('diff-line', _escaped('text'))} || {link} || '</div>'"""
    percent = lambda h: f"{h} // 100 || '.' || lpad(({h} % 100)::VARCHAR, 2, '0') || '%'"
    return f"""{BLOCKS.format(lines='moved')},
begun AS (SELECT *, type <> 'equal' AND coalesce(lag(type) OVER {_by_row}, 'equal') = 'equal' AS starts, move IS NOT NULL AND NOT coalesce(lag(type) OVER {_by_row} = type AND lag(move) OVER {_by_row} = move, false) AS first FROM blocks),
ready AS (SELECT *, count(*) FILTER (starts) OVER {_by_row} - 1 AS index, count(new_no) OVER (PARTITION BY id ORDER BY row_no ROWS UNBOUNDED PRECEDING) AS stop, count(new_no) OVER (PARTITION BY id) AS total FROM begun),
parts_shown AS (SELECT id, block, any_value(altered) AS altered, CASE WHEN any_value(shown) THEN string_agg({row}, '' ORDER BY row_no) ELSE '<div class="diff-row diff-row-collapsed">' || count(*) || ' unchanged lines</div>' END AS html FROM ready GROUP BY id, block),
marks AS (SELECT id, index, CASE WHEN bool_and(move IS NOT NULL) THEN 'moved' WHEN min(type) = max(type) THEN min(type) ELSE 'modified' END AS kind, {_hundredths('(max(stop) - count(new_no))', 'max(total)')} AS top, {_hundredths('max(stop)', 'max(total)')} AS bottom FROM ready WHERE type <> 'equal' GROUP BY id, index),
links AS (SELECT id, string_agg('<a class="diff-minimap-mark diff-minimap-' || kind || '" href="#td-change-' || index || '" style="top:' || {percent('top')} || ';height:' || {percent('(bottom - top)')} || '" aria-label="Change ' || (index + 1) || ': ' || kind || '"></a>', '' ORDER BY index) AS links FROM marks GROUP BY id),
views AS (
  SELECT t.id, '<div class="text-diff text-diff-unified">' || coalesce(html, '<div class="diff-empty">No changes</div>') || '</div>' AS html, '<nav class="text-diff-minimap" aria-label="Change minimap">' || coalesce(links, '') || '</nav>' AS minimap
  FROM t LEFT JOIN (SELECT id, string_agg(html, '' ORDER BY block) AS html FROM parts_shown WHERE altered GROUP BY id) USING (id) LEFT JOIN links USING (id))"""


UNIFIED_SQL = f"""{ROWS},{MOVES},{MOVED},{_unified_sql(True)} SELECT id.doc_id AS doc_id, md5('<div class="text-diff-with-minimap">' || html || minimap || '</div>') AS digest FROM views"""
#: From ``ready``: ``beside``, the rows of the split view, with the parts of both lines where they are compared.
_solid_sum = lambda x: f"length(regexp_replace({x}, '[{WS}]+', '', 'g'))"
BESIDE = f"""
fresh AS (SELECT *, CASE WHEN type NOT IN ('removed', 'added') OR coalesce(lag(type) OVER {_by_row}, 'equal') NOT IN ('removed', 'added') THEN 1 ELSE 0 END AS apart FROM ready),
numbered AS (SELECT *, sum(apart) OVER {_by_row} AS run FROM fresh),
placed AS (SELECT *, row_number() OVER (PARTITION BY id, run, type ORDER BY row_no) AS place FROM numbered),
sides AS MATERIALIZED (
  SELECT coalesce(l.id, r.id) AS id, coalesce(l.run, r.run) AS run, coalesce(l.place, r.place) AS place, coalesce(l.block, r.block) AS block, coalesce(l.shown, r.shown) AS shown, coalesce(l.altered, r.altered) AS altered,
    CASE WHEN l.type IS NULL THEN r.type WHEN r.type IS NULL THEN l.type WHEN l.type = 'equal' THEN 'equal' ELSE 'modified' END AS type, l.type AS lk, l.old_no AS ln, l.text AS lt, r.type AS rk, r.new_no AS rn, r.text AS rt,
    coalesce(l.move, r.move) AS move, coalesce(l.other, r.other) AS other, coalesce(l.first, r.first) AS first, coalesce(l.starts, false) OR coalesce(r.starts, false) AS starts, coalesce(l.index, r.index) AS index
  FROM (SELECT * FROM placed WHERE old_no IS NOT NULL) l FULL JOIN (SELECT * FROM placed WHERE new_no IS NOT NULL) r ON l.id = r.id AND l.run = r.run AND l.place = r.place),
alike AS MATERIALIZED (
  WITH RECURSIVE {S.script("(SELECT id, run, place, lt AS old, rt AS new FROM sides WHERE type = 'modified' AND length(lt) <= 1000 AND length(rt) <= 1000)", "{'id': id, 'run': run, 'place': place}", _sql_tokens('wordsWithSpace', 'old'), _sql_tokens('wordsWithSpace', 'new'))}{S.VALUES},
  same AS (SELECT id, sum({_solid_sum('value')}) AS same FROM found WHERE op = 0 GROUP BY id),
  near AS (SELECT t.id FROM t LEFT JOIN same USING (id) WHERE {_solid_sum('old')} + {_solid_sum('new')} = 0 OR 2 * coalesce(same, 0) / ({_solid_sum('old')} + {_solid_sum('new')})::DOUBLE >= 0.3)
  SELECT n.id.id AS id, n.id.run AS run, n.id.place AS place,
    coalesce(list({{'value': value, 'added': false, 'removed': op < 0, 'count': f.n}} ORDER BY f.run) FILTER (op <= 0), []) AS lp, coalesce(list({{'value': value, 'added': op > 0, 'removed': false, 'count': f.n}} ORDER BY f.run) FILTER (op >= 0), []) AS rp
  FROM near n LEFT JOIN found f ON f.id = n.id GROUP BY n.id),
beside AS MATERIALIZED (SELECT s.*, lp, rp FROM sides s LEFT JOIN alike a ON a.id = s.id AND a.run = s.run AND a.place = s.place)"""


def _cell_json(side: str) -> str:
    kind, no, text, parts = (side + x for x in ("k", "n", "t", "p"))
    return f"""'{{{{"type":"' || {kind} || '","lineNo":' || {no} || ',"text":' || to_json({text})::VARCHAR || coalesce(',"parts":' || to_json({parts})::VARCHAR, '') || '}}}}'""".replace("{{", "{").replace("}}", "}")


SPLIT_HUNKS_SQL = f"""{ROWS},{STILL},{_unified_sql(False)},{BESIDE},
row_json AS (SELECT id, block, run, place, '{{"type":"' || type || '"' || coalesce(',"left":' || {_cell_json('l')}, '') || coalesce(',"right":' || {_cell_json('r')}, '') || '}}' AS row FROM beside WHERE shown),
open_json AS (SELECT id, block, string_agg(row, ',' ORDER BY run, place) AS rows FROM row_json GROUP BY id, block),
closed_json AS (SELECT id, block, any_value(shown) AS shown, count(*) AS n, count(old_no) AS olds, count(new_no) AS news, string_agg('{{"type":"' || type || '"' || coalesce(',"oldNo":' || old_no, '') || coalesce(',"newNo":' || new_no, '') || ',"text":' || to_json(text)::VARCHAR || '}}', ',' ORDER BY row_no) AS hidden FROM ready GROUP BY id, block),
at_json AS (SELECT *, 1 + coalesce(sum(olds) OVER b, 0) AS o, 1 + coalesce(sum(news) OVER b, 0) AS w FROM closed_json WINDOW b AS (PARTITION BY id ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
block_json AS (SELECT a.id, a.block, CASE WHEN a.shown THEN '{{"type":"hunk","oldStart":' || o || ',"oldLines":' || olds || ',"newStart":' || w || ',"newLines":' || news || ',"rows":[' || rows || ']}}' ELSE '{{"type":"collapsed","oldStart":' || o || ',"newStart":' || w || ',"count":' || n || ',"hidden":[' || hidden || ']}}' END AS j FROM at_json a LEFT JOIN open_json r ON r.id = a.id AND r.block = a.block)
SELECT t.id.doc_id AS doc_id, md5('[' || coalesce(string_agg(j, ',' ORDER BY block), '') || ']') AS digest FROM t LEFT JOIN block_json b ON b.id = t.id GROUP BY t.id"""


def _cell_html(side: str, which: str) -> str:
    kind, no, text, parts = (side + x for x in ("k", "n", "t", "p"))
    away = "from" if side == "l" else "to"
    there = "to" if side == "l" else "from"
    name = f"CASE WHEN {kind} LIKE 'moved%' THEN 'line ' || {no} || ' moved {there} line ' || other ELSE {kind} || ' line ' || {no} END"
    line = f"CASE WHEN {parts} IS NULL THEN {_escaped(text)} ELSE array_to_string(list_transform(list_filter({parts}, lambda x: x.value <> ''), lambda x: '<span' || CASE WHEN x.added THEN ' class=\"diff-added\"' WHEN x.removed THEN ' class=\"diff-removed\"' ELSE '' END || '>' || {_escaped('x.value')} || '</span>'), '') END"
    link = f"CASE WHEN {kind} = 'moved-{away}' THEN '<a class=\"diff-move-link\"' || CASE WHEN first THEN ' id=\"td-move-' || move || '-{away}\"' ELSE '' END || ' href=\"#td-move-' || move || '-{there}\">moved {there} line ' || other || '</a>' ELSE '' END"
    return f"""CASE WHEN {kind} IS NULL THEN '<div class="diff-cell diff-cell-{which} diff-cell-empty"></div>' ELSE '<div class="diff-cell diff-cell-{which}' || CASE WHEN {kind} = 'equal' THEN '"' ELSE ' diff-cell-' || {kind} || '" role="group" aria-label="' || {name} || '"' END || '><span class="diff-gutter">' || {no} || '</span><span class="diff-sign" aria-hidden="true">' || CASE {kind} WHEN 'equal' THEN ' ' WHEN 'removed' THEN '−' WHEN 'moved-from' THEN '−' ELSE '+' END || '</span><span class="diff-line">' || {line} || '</span>' || {link} || '</div>' END"""


SPLIT_VIEW_SQL = f"""{ROWS},{MOVES},{MOVED},{_unified_sql(True)},{BESIDE},
split_rows AS (SELECT id, block, run, place, shown, altered, '<div class="diff-row diff-row-' || type || coalesce(' diff-move-' || move % 6, '') || '"' || CASE WHEN starts THEN ' id="td-change-' || index || '"' ELSE '' END || coalesce(' data-move="' || move || '"', '') || CASE WHEN starts THEN ' data-change-index="' || index || '"' ELSE '' END || '>' || {_cell_html('l', 'old')} || {_cell_html('r', 'new')} || '</div>' AS html FROM beside),
split_blocks AS (SELECT id, block, CASE WHEN any_value(shown) THEN string_agg(html, '' ORDER BY run, place) ELSE '<div class="diff-row diff-row-collapsed">' || count(*) || ' unchanged lines</div>' END AS html FROM split_rows WHERE altered GROUP BY id, block),
split_views AS (SELECT id, string_agg(html, '' ORDER BY block) AS body FROM split_blocks GROUP BY id)
SELECT v.id.doc_id AS doc_id, md5('<div class="text-diff-with-minimap"><div class="text-diff text-diff-split">' || coalesce(body, '<div class="diff-empty">No changes</div>') || '</div>' || minimap || '</div>') AS digest FROM views v LEFT JOIN split_views s ON s.id = v.id"""
_count = lambda kind: f"(SELECT count(*) FROM lines l WHERE l.id = v.id AND l.type = '{kind}')"


def _stat_sql(kind: str, sign: str, n: str) -> str:
    return f"""'<span class="diff-stat diff-stat-{kind}"><span aria-hidden="true">{sign}' || {n} || '</span><span class="diff-sr">' || {n} || CASE WHEN {n} = 1 THEN ' line' ELSE ' lines' END || ' {kind}</span></span>'"""


TIMELINE_SQL = f"""SELECT conv_id, length(html)::INTEGER AS size, md5(html) AS digest FROM (
  SELECT c.conv_id, '<div class="text-diff-timeline" role="group" aria-label="Revision timeline">' || coalesce(string_agg(
    '<input class="diff-rev-input" type="radio" name="td-rev" id="td-rev-' || step || '"' || CASE WHEN step = steps THEN ' checked' ELSE '' END || '><label class="diff-rev-label" for="td-rev-' || step || '">' || caption || '</label><div class="diff-rev-panel" role="group" aria-label="' || caption || '"><div class="diff-rev-caption">' || caption || '</div>'
    || '<div class="text-diff-stats" data-unit="lines">' || {_stat_sql('added', '+', 'added')} || {_stat_sql('removed', '−', 'removed')} || {_stat_sql('unchanged', '=', 'same')} || '<span class="diff-stat diff-stat-similarity">' || floor(similarity * 100 + 0.5)::BIGINT || '% similar</span></div>' || html || '</div>', '' ORDER BY step), '<div class="diff-empty">Nothing to compare</div>') || '</div>' AS html
  FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN (
    SELECT *, 'v' || step || ' → v' || (step + 1) AS caption, max(step) OVER (PARTITION BY conv_id) AS steps FROM (
      SELECT x.id.conv_id AS conv_id, row_number() OVER (PARTITION BY x.id.conv_id ORDER BY x.id.turn) AS step, x.html, added, removed, same, similarity
      FROM ({_script('lines', TALK, TURN) + _rows('')[len(_script('lines', '', DOC)) :]},{STILL},{_unified_sql(False)} SELECT id, html, {_count('added')} AS added, {_count('removed')} AS removed, {_count('equal')} AS same FROM views v) x
      JOIN ({_similarity_sql(TALK, TURN)}) y ON x.id = y.id)) s ON s.conv_id = c.conv_id GROUP BY c.conv_id)"""


@query("hunks", HUNKS_SQL)
def hunks(spark, d):
    shown = LN.folded(LN.rows(P.document_revisions(spark, d), ["doc_id"]), ["doc_id"])
    return LN.hunks(shown, ["doc_id"]).withColumn("rows", F.md5(F.to_json("rows")))


@query("split_rows", SPLIT_SQL)
def split_rows(spark, d):
    shown = LN.paired(LN.rows(P.document_revisions(spark, d), ["doc_id"]), ["doc_id"])
    return shown.withColumn("left_text", F.md5("left_text")).withColumn("right_text", F.md5("right_text")).withColumn("left_no", F.col("left_no").cast("string")).withColumn("right_no", F.col("right_no").cast("string"))


@query("split_hunks", SPLIT_HUNKS_SQL)
def split_hunks(spark, d):
    return P.document_revisions(spark, d).select("doc_id", F.md5(F.to_json(K.split_hunks("old", "new"))).alias("digest"))


@query("moves", MOVES_SQL)
def moves(spark, d):
    return P.rotated_documents(spark, d).select("doc_id", F.inline(K.moves("old", "new", detectMoves=True)))


@query("moves_near", NEAR_MOVES_SQL)
def moves_near(spark, d):
    return P.rotated_documents(spark, d, " and so on").select("doc_id", F.inline(K.moves("old", "new", moveSimilarity=0.6)))


def _similarity(name, pairs, keys, html, sql=None):
    @query(name, sql)
    def similarity(spark, d):
        return pairs(spark, d).select(*keys, K.similarity("old", "new", html=html).alias("similarity"))


_similarity("similarity", P.conversation_revisions, ("conv_id", "turn"), False, f"SELECT id.conv_id AS conv_id, id.turn AS turn, similarity FROM ({_similarity_sql(TALK, TURN)})")
_similarity("similarity_documents", P.document_revisions, ("doc_id",), False)
_similarity("similarity_html", P.page_revisions, ("page_id",), True)


_level = lambda s: f"CASE WHEN {s} >= 1 THEN 0 WHEN {s} >= 0.75 THEN 1 WHEN {s} >= 0.5 THEN 2 WHEN {s} >= 0.25 THEN 3 ELSE 4 END"
_solid_only = lambda c: f"list_filter({_sql_tokens('sentences', c)}, lambda x: regexp_replace(x, '[{WS}]+', '', 'g') <> '')"
_row_of = lambda k: f"list_reduce(list_transform(range(1, m + 1), lambda j: [j::DOUBLE]), lambda row, x: list_append(row, greatest(row[x[1]::INT], above[x[1]::INT + 1], coalesce(above[x[1]::INT] + {k}[x[1]::INT], 0))), [0.0::DOUBLE])"
#: Sentences of a pair aligned by similarity: ``told`` (id, j, i, s, gone): each new sentence with the old one that it goes with
#: (null: none), and ``lost`` (id, j, i): old ones without a partner and the new sentence that they stand before. Sides of over
#: 500 sentences, which are aligned by equality alone, do not occur in the conversations.
ALIGNED = f"""sides AS MATERIALIZED (SELECT {TURN} AS id, old, new, {_solid_only('old')} AS a, {_solid_only('new')} AS b FROM {TALK}),
heads AS (SELECT *, coalesce(list_min(list_filter(range(0, least(len(a), len(b))), lambda q: a[q + 1] <> b[q + 1])), least(len(a), len(b))) AS head FROM sides),
tails AS (SELECT *, least(len(a), len(b)) - head AS room, coalesce(list_min(list_filter(range(0, least(len(a), len(b)) - head), lambda q: a[len(a) - q] <> b[len(b) - q])), least(len(a), len(b)) - head) AS tail FROM heads),
cores AS MATERIALIZED (SELECT *, len(a) - head - tail AS n, len(b) - head - tail AS m FROM tails),
texts AS MATERIALIZED (SELECT DISTINCT a[head + i] AS old, b[head + j] AS new FROM (SELECT *, unnest(range(1, m + 1)) AS j FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM cores))),
alike AS MATERIALIZED (SELECT id.old AS old, id.new AS new, similarity AS s FROM ({_similarity_sql('texts', "{'old': old, 'new': new}")})),
weights AS MATERIALIZED (SELECT id, i, any_value(n) AS n, any_value(m) AS m, list(CASE WHEN s >= 0.5 THEN s END ORDER BY j) AS w FROM (SELECT c.*, x.s FROM (SELECT *, unnest(range(1, m + 1)) AS j FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM cores)) c JOIN alike x ON x.old = c.a[c.head + c.i] AND x.new = c.b[c.head + c.j]) GROUP BY id, i),
sums AS (
  SELECT id, 0::BIGINT AS i, n, m, list_transform(range(0, m + 1), lambda x: 0::DOUBLE) AS best FROM cores WHERE n > 0 AND m > 0
  UNION ALL
  SELECT s.id, s.i + 1, s.n, s.m, {_row_of('w.w').replace('above', 's.best').replace('range(1, m + 1)', 'range(1, s.m + 1)')} FROM sums s JOIN weights w ON w.id = s.id AND w.i = s.i + 1),
steps_back AS (
  SELECT id, n AS i, m AS j, false AS hit FROM cores WHERE n > 0 AND m > 0
  UNION ALL
  SELECT id, CASE WHEN hit OR up THEN i - 1 ELSE i END, CASE WHEN hit OR NOT up THEN j - 1 ELSE j END, hit
  FROM (SELECT t.id, t.i, t.j, coalesce(h.best[t.j + 1] = g.best[t.j] + w.w[t.j], false) AS hit, h.best[t.j + 1] = g.best[t.j + 1] AS up
    FROM steps_back t JOIN sums h ON h.id = t.id AND h.i = t.i JOIN sums g ON g.id = t.id AND g.i = t.i - 1 JOIN weights w ON w.id = t.id AND w.i = t.i WHERE t.i > 0 AND t.j > 0)),
bounds AS (SELECT id, i + 1 AS i, j + 1 AS j FROM steps_back WHERE hit UNION ALL SELECT id, n + 1, m + 1 FROM cores),
spans AS (SELECT *, coalesce(lag(i) OVER w, 0) AS pi, coalesce(lag(j) OVER w, 0) AS pj FROM bounds WINDOW w AS (PARTITION BY id ORDER BY i, j)),
couples AS (
  SELECT id, i, j FROM spans UNION ALL
  SELECT id, pi + q, pj + q FROM (SELECT *, unnest(range(1, least(i - pi, j - pj))) AS q FROM spans)),
told AS MATERIALIZED (
  SELECT c.id, p.j AS j, k.i, CASE WHEN p.j <= c.head OR p.j > c.head + c.m THEN 1.0 ELSE x.s END::DOUBLE AS s
  FROM (SELECT *, unnest(range(1, len(b) + 1)) AS j FROM cores) p JOIN cores c ON c.id = p.id LEFT JOIN couples k ON k.id = p.id AND k.j = p.j - c.head AND k.j <= c.m LEFT JOIN alike x ON x.old = c.a[c.head + k.i] AND x.new = c.b[c.head + k.j]),
lost AS MATERIALIZED (SELECT s.id, s.j + c.head AS j, s.pi + q + c.head AS i FROM (SELECT *, unnest(range(least(i - pi, j - pj), i - pi)) AS q FROM spans) s JOIN cores c ON c.id = s.id)"""
HEAT_SQL = f"""WITH RECURSIVE {ALIGNED}
SELECT c.id.conv_id AS conv_id, c.id.turn AS turn, {', '.join(f"(SELECT count(*) FROM told t WHERE t.id = c.id AND coalesce({_level('s')}, 4) = {k})::INTEGER AS heat_{k}" for k in range(5))}, (SELECT count(*) FROM lost l WHERE l.id = c.id)::INTEGER AS removed, false AS exact FROM cores c"""


_heat_key = lambda k, name: f"""'<li class="diff-heat-key" data-heat="{k}"><span class="diff-heat-swatch" aria-hidden="true"></span>{name} (' || count(*) FILTER (kind = 'sentence' AND heat = {k}) || ')</li>'"""
_heat_names = ("unchanged", "lightly edited", "edited", "heavily edited", "rewritten or new")
HEAT_VIEW_SQL = f"""WITH RECURSIVE {ALIGNED},
pieces AS (SELECT id, p, k[p] AS text, regexp_replace(k[p], '[{WS}]+', '', 'g') <> '' AS solid FROM (SELECT *, unnest(range(1, len(k) + 1)) AS p FROM (SELECT id, {_sql_tokens('sentences', 'new')} AS k FROM sides))),
counted_pieces AS (SELECT *, CASE WHEN solid THEN count(*) FILTER (solid) OVER (PARTITION BY id ORDER BY p ROWS UNBOUNDED PRECEDING) END AS j FROM pieces),
events AS (
  SELECT c.id, c.p, 1 AS part, 0::BIGINT AS i, CASE WHEN solid THEN 'sentence' ELSE 'gap' END AS kind, c.text, t.i IS NULL AS added, t.s, CASE WHEN solid THEN {_level('t.s')} END AS heat FROM counted_pieces c LEFT JOIN told t ON t.id = c.id AND t.j = c.j
  UNION ALL
  SELECT l.id, coalesce(c.p, 2147483647), 0, l.i, 'removed', s.a[l.i], false, NULL, NULL FROM lost l JOIN sides s ON s.id = l.id LEFT JOIN counted_pieces c ON c.id = l.id AND c.j = l.j),
numbered AS (SELECT *, kind = 'removed' OR heat > 0 AS changed, count(*) FILTER (kind = 'removed' OR heat > 0) OVER (PARTITION BY id ORDER BY p, part, i ROWS UNBOUNDED PRECEDING) - 1 AS index,
  CASE WHEN added AND s IS NULL THEN 'new sentence' ELSE CASE heat WHEN 4 THEN 'rewritten' {' '.join(f"WHEN {k} THEN '{_heat_names[k]}'" for k in range(4))} END || ', ' || greatest(1, 100 - floor(s * 100 + 0.5)::BIGINT) || '% changed' END AS label FROM events)
SELECT c.id.conv_id AS conv_id, c.id.turn AS turn, md5('<div class="text-diff text-diff-heatmap"><div class="diff-heat-text">' || coalesce(string_agg(
  CASE WHEN kind = 'gap' THEN '<span>' || {_escaped('text')} || '</span>' WHEN kind = 'removed' THEN '<span class="diff-heat-removed" data-change-index="' || index || '" title="removed sentence"><span class="diff-sr">removed sentence: </span>' || {_escaped('text')} || '</span>'
    WHEN heat = 0 THEN '<span class="diff-heat" data-heat="0">' || {_escaped('text')} || '</span>' ELSE '<span class="diff-heat" data-heat="' || heat || '" data-change-index="' || index || '" title="' || label || '">' || {_escaped('text')} || '<span class="diff-sr"> (' || label || ')</span></span>' END, '' ORDER BY p, part, i), '')
  || '</div><ul class="diff-heat-legend" aria-label="Heat legend">' || {' || '.join(_heat_key(k, n) for k, n in enumerate(_heat_names))} || '<li class="diff-heat-key diff-heat-key-removed"><span class="diff-heat-swatch" aria-hidden="true"></span>removed (' || count(*) FILTER (kind = 'removed') || ')</li></ul></div>') AS digest
FROM cores c LEFT JOIN numbered e ON e.id = c.id GROUP BY c.id"""


@query("heatmap", HEAT_SQL)
def heatmap(spark, d):
    h = P.conversation_revisions(spark, d).select("conv_id", "turn", K.heatmap("old", "new").alias("h"))
    per = lambda test: F.size(F.filter("h.segments", test))
    at = lambda k: lambda s: (s["type"] == "sentence") & (s["heat"] == k)  # noqa: E731  a second parameter would be the element's place
    levels = [per(at(k)).alias(f"heat_{k}") for k in range(5)]
    return h.select("conv_id", "turn", *levels, per(lambda s: s["type"] == "removed").alias("removed"), F.col("h.exact").alias("exact"))


@query("heatmap_text", f"SELECT conv_id, turn, md5(new) AS v FROM {TALK}")
def heatmap_text(spark, d):
    h = P.conversation_revisions(spark, d).select("conv_id", "turn", K.heatmap("old", "new").alias("h"))
    return h.select("conv_id", "turn", F.md5(F.array_join(F.transform(F.filter("h.segments", lambda s: s["type"] != "removed"), lambda s: s["text"]), "")).alias("v"))


@query("minimap_text", f"{_found('words')} SELECT id.conv_id AS conv_id, id.turn AS turn, index::INTEGER AS index, CASE WHEN op > 0 THEN 'added' ELSE 'removed' END AS kind, top::INTEGER AS top, ({_hundredths('stop', 'total')} - top)::INTEGER AS height FROM (SELECT *, {_hundredths('(stop - CASE WHEN op < 0 THEN 0 ELSE length(value) END)', 'total')} AS top FROM counted WHERE op <> 0)")
def minimap_text(spark, d):
    return P.conversation_revisions(spark, d).select("conv_id", "turn", F.inline(N.text_marks(K.changes("words", "old", "new"))))


@query("minimap_lines", MARKS_SQL)
def minimap_lines(spark, d):
    return P.document_revisions(spark, d).select("doc_id", F.inline(K.minimap("unified", "old", "new")))


@query(
    "timeline_steps",
    "SELECT conv_id, n - 1 AS step, 'v' || (n - 1) AS from_label, 'v' || n AS to_label FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) WHERE n > 1",
)
def timeline_steps(spark, d):
    t = T.steps(spark.read.parquet(f"{d}/conversations.parquet"), "conv_id", "turn", "text")
    return t.select("conv_id", F.col("step").cast("long").alias("step"), "from_label", "to_label")


@query(
    "timeline",
    f"SELECT x.id.conv_id AS conv_id, (row_number() OVER (PARTITION BY x.id.conv_id ORDER BY x.id.turn))::INTEGER AS step, added, removed, unchanged, similarity, n_changes FROM ({_found('words')} SELECT * FROM {PER_PAIR}) x JOIN ({_similarity_sql(TALK, TURN)}) y ON x.id = y.id",
)
def timeline(spark, d):
    t = T.steps(spark.read.parquet(f"{d}/conversations.parquet"), "conv_id", "turn", "text")
    return t.select("conv_id", "step", "stats.added", "stats.removed", "stats.unchanged", "similarity", F.size("changes").alias("n_changes"))


@query("timeline_html", TIMELINE_SQL)
def timeline_html(spark, d):
    t = T.render(spark.read.parquet(f"{d}/conversations.parquet"), "conv_id", "turn", "text", mode="unified")
    return t.select("conv_id", F.length("html").alias("size"), F.md5("html").alias("digest"))


def _spans_sql(before: str, after: str, style: str) -> str:
    """Markup of words, each change as a span."""
    number = "index || '\"'"
    span = f"CASE WHEN op = 0 THEN '<span>' ELSE '<span class=\"diff-' || CASE WHEN op > 0 THEN 'added' ELSE 'removed' END || '\" data-change-index=\"' || {number}{style} || '>' END || {_escaped('value')} || '</span>'"
    return f"{_found('words')} SELECT t.id.conv_id AS conv_id, t.id.turn AS turn, md5('{before}' || coalesce(string_agg({span}, '' ORDER BY run), '') || '{after}') AS digest FROM t LEFT JOIN counted c ON c.id = t.id GROUP BY t.id"


VIEW_SQL = {
    "unified": UNIFIED_SQL,
    "split": SPLIT_VIEW_SQL,
    "heatmap": HEAT_VIEW_SQL,
    "words": _spans_sql('<div class="text-diff text-diff-words">', "</div>", ""),
    "playback_words": _spans_sql(
        '<div class="text-diff-playback-wrap"><input class="diff-replay-input" type="checkbox" id="td-replay"><label class="diff-replay" for="td-replay">Replay</label><div class="text-diff text-diff-words text-diff-playback">',
        "</div></div>",
        " || ' style=\"--td-i:' || index || '\"'",
    ),
}


def _render(view, pairs, keys, **options):
    @query(f"render_{MODE_NAMES.get(view, view)}", VIEW_SQL.get(view))
    def render(spark, d):
        return pairs(spark, d).select(*keys, F.md5(K.render(view, "old", "new", **options)).alias("digest"))


for _view in ("words", "heatmap", "playback_words"):
    _render(_view, P.conversation_revisions, ("conv_id", "turn"))
for _view in ("unified", "split"):
    _render(_view, P.document_revisions, ("doc_id",), detectMoves=True, minimap=True)


@query("render_identical", f"SELECT page_id, md5('<div class=\"text-diff text-diff-lines\">' || CASE WHEN new = '' THEN '' ELSE '<span>' || {_escaped('new')} || '</span>' END || '</div>') AS v FROM {PAGES}")
def render_identical(spark, d):
    """A text against itself: one unchanged span."""
    p = P.page_revisions(spark, d)
    return p.select("page_id", F.md5(N.render_text("lines", K.changes("lines", "new", "new"))).alias("v"))


@query("html_diff")
def html_diff(spark, d):
    h = P.page_revisions(spark, d).select("page_id", K.html_diff("old", "new").alias("h"))
    return h.select("page_id", F.md5("h.html").alias("digest"), F.regexp_count("h.html", F.lit('data-change-index="')).alias("n_changes"))


@query("html_full_replacement", f"SELECT page_id, md5('<div class=\"diff-removed\" data-change-index=\"0\">' || old || '</div><div class=\"diff-added\" data-change-index=\"1\">' || new || '</div>') AS v, true AS full FROM {PAGES}")
def html_full_replacement(spark, d):
    h = P.page_revisions(spark, d).select("page_id", K.html_diff("old", "new", similarityThreshold=2).alias("h"))
    return h.select("page_id", F.md5("h.html").alias("v"), F.col("h.fullReplacement").alias("full"))


@query("html_segments", "SELECT page_id, md5(html) AS v FROM pages")
def html_segments(spark, d):
    """The lexer loses nothing: its pieces make the page."""
    p = spark.read.parquet(f"{d}/pages.parquet").select("page_id", K.html_segments("html").alias("s"))
    return p.select("page_id", F.md5(F.array_join(F.transform("s", lambda x: x["raw"]), "")).alias("v"))


@query("html_tokens")
def html_tokens(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet").select("page_id", K.html_tokens("html").alias("t"))
    return p.select("page_id", F.size("t").alias("n_tokens"), F.md5(F.to_json("t")).alias("digest"))


@query("strip_formatting", "SELECT page_id, md5(regexp_replace(html, '</?b>', '', 'g')) AS v FROM pages")
def strip_formatting(spark, d):
    """The pages' only formatting tags are plain <b> and </b>."""
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.md5(K.strip_formatting("html")).alias("v"))


@query("navigation", "SELECT event_id, CASE WHEN event_id % 4 > 0 THEN ((user_id - 3) % (event_id % 4) + (event_id % 4)) % (event_id % 4) ELSE -1 END AS v FROM events")
def navigation(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", N.wrap_index(F.col("user_id") - 3, F.col("event_id") % 4).cast("long").alias("v"))
