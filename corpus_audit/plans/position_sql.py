"""SQL twins of the operators that need match positions.

Positions come from splitting a text at a pattern and adding up the lengths of pieces and matches; bodies are
found by folding over the braces and quotes behind a head, character by character as the definition says.
"""

from __future__ import annotations

from corpus_audit.functions import paths as P
from corpus_audit.operators import documentation, spans
from corpus_audit.plans import oracle as O


def _positions(name: str, table: str, pattern: str, group: int = 0) -> str:
    """CTEs giving (repo, path, content, found, start): start is 0-based."""
    p = O.quote(O.re2(pattern))
    return (
        f"{name}_m AS (SELECT repo, path, content, regexp_extract_all(content, {p}) AS m, "
        f"regexp_extract_all(content, {p}, {group}) AS g, string_split_regex(content, {p}) AS s FROM {table}), "
        f"{name} AS (SELECT repo, path, content, g[i] AS found, m[i] AS whole, "
        "CAST(list_sum(list_transform(s[1:i], lambda x: length(x))) + "
        "coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start "
        f"FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM {name}_m))"
    )


def _times(text: str, mark: str) -> str:
    return f"(length({text}) - length(replace({text}, {O.quote(mark)}, '')))"


def _last(text: str, mark: str) -> str:
    back = f"instr(reverse({text}), {O.quote(mark[::-1])})"
    return f"(CASE WHEN {back} = 0 THEN 0 ELSE length({text}) - {back} END)"


def _any(text: str, marks: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {O.quote(m)})" for m in marks) + ")"


_LINE = f"({_times('pre', chr(10))} + 1)"
_HIDDEN = (
    "(" + " OR ".join(f"{_times('pre', q)} % 2 = 1" for q in ("'", '"', "`"))
    + " OR contains(regexp_extract(pre, '[^\\n]*$'), '//') OR "
    + f"{_last('pre', '/*')} > {_last('pre', '*/')})"
)
_NAMES = ", ".join(
    O.quote(n) for n in spans.LIFECYCLE_METHODS + spans.TEST_METHODS + spans.KEYWORDS + spans.COMMON_METHODS
)
_SKIPPED = (
    f"(found IN ({_NAMES}) OR length(found) <= 1 OR "
    f"((starts_with(found, 'get') OR starts_with(found, 'set')) AND {_any('right(pre, 50)', ['get ', 'set '])}) OR "
    f"contains(right(pre, 100), found || ':') OR {_any('substr(content, start + 1, 50)', [': function', ': async'])} OR "
    f"{_any('(right(pre, 200) || substr(content, start + 1, 50))', ['if (', 'for (', 'while ('])})"
)
_IN_CLASS = (
    f"({_any('right(pre, 200)', ['class ', 'extends '])} AND contains(substr(content, start + 1, 100), ') {{') AND NOT "
    f"{_any('right(pre, 200)', ['if ', 'for ', 'while ', 'switch ', ' = '])} AND NOT contains(substr(content, start + 1, 100), ' = '))"
)
_KINDS = [
    ("classes", spans.CLASSES, "class"),
    ("functions", spans.FUNCTIONS, "function"),
    ("arrows", spans.ARROWS, "function"),
    ("methods", spans.METHODS, "method"),
]

SYMBOLS = (
    f"code AS MATERIALIZED (SELECT * FROM files WHERE {O.glob(P.CODE)}), "
    + ", ".join(_positions(name, "code", pattern, 1) for name, pattern, _ in _KINDS)
    + ", "
    + _positions("blocks", "code", spans.DOC_BLOCKS)
    + ", candidates AS ("
    + " UNION ALL ".join(
        f"SELECT repo, path, content, found, start, substr(content, 1, start) AS pre, {i} AS rank, '{kind}' AS kind FROM {name}"
        for i, (name, _, kind) in enumerate(_KINDS)
    )
    + f"), found_symbols AS MATERIALIZED (SELECT repo, path, found AS name, {_LINE} AS line, kind, rank, start FROM candidates "
    f"WHERE NOT {_HIDDEN} AND (kind <> 'method' OR (NOT {_SKIPPED} AND {_IN_CLASS}))), "
    f"docblocks AS (SELECT repo, path, {_LINE} AS line FROM (SELECT *, substr(content, 1, start) AS pre FROM blocks)), "
    "symbols AS MATERIALIZED (SELECT s.*, (SELECT min(abs(b.line - s.line)) FROM docblocks b WHERE b.repo = s.repo AND b.path = s.path) AS gap "
    "FROM found_symbols s), "
    "scores AS (SELECT c.repo, c.path, count(s.name) AS symbols, count(s.name) FILTER (s.gap <= 2) AS documented, "
    "CASE WHEN count(s.name) = 0 THEN 1.0 ELSE CAST(count(s.name) FILTER (s.gap <= 2) AS DOUBLE) / count(s.name) END AS score "
    "FROM code c LEFT JOIN symbols s ON s.repo = c.repo AND s.path = c.path GROUP BY c.repo, c.path)"
)
SYMBOL_ROWS = "SELECT repo, path, name, line, kind, gap FROM symbols"
ISSUE_ROWS = (
    "SELECT repo, path, name, line, kind, 'Missing documentation for ' || kind || ' `' || name || '` (line ' || line || ')' AS description "
    "FROM (SELECT *, row_number() OVER (PARTITION BY repo, path ORDER BY rank, start) AS r FROM symbols WHERE coalesce(gap > 2, true)) "
)
FIRST_ISSUE_ROWS = ISSUE_ROWS + f"WHERE r <= {documentation.ISSUES_PER_FILE}"
COVERAGE_ROWS = (
    "SELECT *, CASE WHEN coverage >= 80 THEN 'excellent' WHEN coverage >= 60 THEN 'good' WHEN coverage >= 40 THEN 'moderate' ELSE 'low' END AS band "
    "FROM (SELECT repo, CAST(sum(symbols) AS BIGINT) AS symbols, CAST(sum(documented) AS BIGINT) AS documented, "
    "count(*) FILTER (score > 0.7) AS good_files, count(*) AS files, "
    f"coalesce({O.pct('sum(documented)', 'sum(symbols)')}, 0.0) AS coverage FROM scores GROUP BY repo)"
)

# One token per brace or quote: its place, and whether a backslash stands before it.
_TOKENS = (
    "pieces AS (SELECT repo, path, unnest(string_split_regex(content, '[\"''`{}]')) AS piece, "
    "unnest(regexp_extract_all(content || '}', '[\"''`{}]')) AS ch, "
    "unnest(range(1, len(string_split_regex(content, '[\"''`{}]')) + 1)) AS i FROM styled), "
    "tokens AS (SELECT repo, path, i, ch, right(piece, 1) = chr(92) AS esc, "
    "CAST(sum(length(piece) + 1) OVER (PARTITION BY repo, path ORDER BY i) AS BIGINT) AS pos FROM pieces "
    "QUALIFY i < max(i) OVER (PARTITION BY repo, path))"
)
_FOLD = (
    "list_reduce(list_prepend({'ch': '', 'esc': false, 'pos': CAST(0 AS BIGINT), 'depth': CAST(0 AS BIGINT), 'q': '', 'e': CAST(0 AS BIGINT)}, t), "
    "lambda s, x: CASE WHEN s.e > 0 THEN s "
    "WHEN s.q = '' AND x.ch IN ('\"', '''', '`') THEN {'ch': '', 'esc': false, 'pos': s.pos, 'depth': s.depth, 'q': x.ch, 'e': s.e} "
    "WHEN s.q <> '' THEN CASE WHEN x.ch = s.q AND NOT x.esc THEN {'ch': '', 'esc': false, 'pos': s.pos, 'depth': s.depth, 'q': '', 'e': s.e} ELSE s END "
    "WHEN x.ch = '{' THEN {'ch': '', 'esc': false, 'pos': s.pos, 'depth': s.depth + 1, 'q': '', 'e': s.e} "
    "ELSE {'ch': '', 'esc': false, 'pos': s.pos, 'depth': s.depth - 1, 'q': '', 'e': CASE WHEN s.depth = 1 THEN x.pos ELSE 0 END} END).e"
)


def bodies(pattern: str) -> str:
    """CTEs ending in ``bodies`` (repo, path, whole, start, body)."""
    return (
        f"styled AS MATERIALIZED (SELECT * FROM files WHERE {O.style_source()}), {_TOKENS}, "
        + _positions("heads", "styled", pattern)
        + ", behind AS (SELECT h.repo, h.path, any_value(h.content) AS content, any_value(h.whole) AS whole, h.start, "
        "list({'ch': t.ch, 'esc': t.esc, 'pos': t.pos, 'depth': CAST(0 AS BIGINT), 'q': '', 'e': CAST(0 AS BIGINT)} ORDER BY t.i) "
        "FILTER (t.i IS NOT NULL) AS t FROM heads h LEFT JOIN tokens t ON t.repo = h.repo AND t.path = h.path AND t.pos > h.start "
        "GROUP BY h.repo, h.path, h.start), "
        f"ends AS (SELECT *, CASE WHEN t IS NULL THEN 0 ELSE {_FOLD} END AS e FROM behind), "
        "bodies AS MATERIALIZED (SELECT repo, path, whole, start, content, "
        "substr(content, start + 1, CASE WHEN e > 0 THEN e - start ELSE length(content) END) AS body FROM ends)"
    )


_EFFECT = O.test_any(spans.SIDE_EFFECTS, "body")
PURITY = (
    bodies(spans.BODY_FUNCTIONS)
    + f", facts AS (SELECT repo, {_EFFECT} AS effect, contains(body, 'return') AND NOT contains(body, 'this.') AND NOT "
    + O.test(spans.LOCAL_STATE, "body")
    + " AS clean FROM bodies), purity AS (SELECT repo, count(*) FILTER (NOT effect AND clean) AS pure, count(*) FILTER (effect) AS side_effects, "
    "count(*) FILTER (NOT effect AND NOT clean) AS impure FROM facts GROUP BY repo)"
)
RATIO_ROWS = (
    "SELECT repo, side_effects > pure * 0.3 AS high_side_effects, "
    f"{O.pct('side_effects', '(pure + side_effects)')} AS side_effect_percentage FROM purity"
)
SIZES = bodies(spans.SIZED_FUNCTIONS)
SIZE_ROWS = (
    "SELECT repo, path, head, line, lines, lines > 30 AS is_large FROM (SELECT repo, path, substr(whole, 1, 50) AS head, "
    f"{_times('substr(content, 1, start)', chr(10))} + 1 AS line, {_times('body', chr(10))} + 1 AS lines FROM bodies) WHERE lines > 20"
)


# ---- repeated property access -----------------------------------------------------------------------------

# Matches are found left to right as a walk over the dots of a piece between ``=`` and line ends.  ``again`` pairs each dot
# with the later ones that stand between like letters: how many letters before and behind both agree.  A step takes
# the first dot that has a pair behind the last match, for it the longest object name, then the longest property
# name, then the last place where both come again, and ends behind that place.
ACCESS = (
    "pieces AS MATERIALIZED (SELECT row_number() OVER () AS pid, repo, path, piece FROM (SELECT repo, path, "
    f"unnest(string_split_regex(content, '[=\\n]')) AS piece FROM files WHERE {O.style_source()}) "
    "WHERE regexp_matches(piece, '\\w\\.\\w[^\\n]*\\w\\.\\w')), "
    "dots AS MATERIALIZED (SELECT pid, p, regexp_extract(substr(piece, 1, p - 1), '\\w+$') AS a, regexp_extract(substr(piece, p + 1), '^\\w+') AS b "
    "FROM (SELECT pid, piece, unnest(range(2, length(piece))) AS p FROM pieces) WHERE substr(piece, p, 1) = '.' "
    "AND regexp_matches(substr(piece, p - 1, 3), '^\\w\\.\\w')), "
    "again AS MATERIALIZED (SELECT x.pid, x.p, y.p AS q, "
    "list_max(list_filter(range(1, least(length(x.a), length(y.a)) + 1), lambda k: right(x.a, k) = right(y.a, k))) AS suf, "
    "list_max(list_filter(range(1, least(length(x.b), length(y.b)) + 1), lambda k: left(x.b, k) = left(y.b, k))) AS pre "
    "FROM dots x JOIN dots y ON x.pid = y.pid AND right(x.a, 1) = right(y.a, 1) AND left(x.b, 1) = left(y.b, 1) AND x.p + 2 < y.p), "
    "walk AS (SELECT DISTINCT pid, CAST(1 AS BIGINT) AS pos, CAST(0 AS BIGINT) AS n FROM again UNION ALL "
    "SELECT pid, 1 - s.q - s.l, n + 1 FROM (SELECT pid, n, min({'p': p, 'm': -m, 'l': -least(pre, q - m - p - 1), 'q': -q}) AS s "
    "FROM (SELECT w.pid, n, p, q, pre, least(suf, p - pos, q - p - 2) AS m FROM walk w JOIN again g ON g.pid = w.pid) WHERE m > 0 GROUP BY pid, n)), "
    "access_features AS MATERIALIZED (SELECT repo, path, CAST(sum(found) AS BIGINT) AS repeated_access FROM pieces "
    "JOIN (SELECT pid, max(n) AS found FROM walk GROUP BY pid) USING (pid) GROUP BY repo, path)"
)
