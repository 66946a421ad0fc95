"""SQL twins of pattern features, for engines with RE2-style regular expressions.

Only patterns are shared with the Spark side; they run here in their plain form, in another regex engine,
without any of the rewrites of :mod:`corpus_audit.functions.patterns`.
"""

from __future__ import annotations

from corpus_audit.functions import paths as P
from corpus_audit.functions.patterns import Count, Derived, Has, _tokens
from corpus_audit.operators.rules import Family

_CHAR = r"[^\n\r\x{2028}\x{2029}]"

# Patterns with look-ahead, which RE2 lacks, by the numbers they leave.
_NUMBERS = {
    r"\b(?!0|1|-1)\d{2,}\b": r"len(regexp_extract_all({t}, '\b[2-9]\d+\b'))",
    r"\b(?!0|1|-1|100|200|404|500)\d{2,}\b": r"(len(regexp_extract_all({t}, '\b[2-9]\d+\b')) - "
    r"len(regexp_extract_all({t}, '\b(200|404|500)\d*\b')))",
}


def quote(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def re2(pattern: str) -> str:
    out = ""
    for token, _, in_class in _tokens(pattern.replace(r"\z", "$")):
        out += _CHAR if token == "." and not in_class else token
    return out


def test(pattern: str, text: str = "content") -> str:
    return f"regexp_matches({text}, {quote(re2(pattern))})"


def test_any(patterns: list[str], text: str = "content") -> str:
    return "(" + " OR ".join(test(p, text) for p in patterns) + ")"


def count(pattern: str, text: str = "content") -> str:
    if pattern in _NUMBERS:
        return _NUMBERS[pattern].replace("{t}", text)
    return f"len(regexp_extract_all({text}, {quote(re2(pattern))}))"


def feature(f, text: str = "content") -> str:
    if isinstance(f, Has):
        return test(f.pattern, text)
    if isinstance(f, Count):
        return count(f.pattern, text)
    assert isinstance(f, Derived) and f.sql
    return f.sql.replace("{text}", text).replace("{{", "{").replace("}}", "}")


def glob(globs: list[str], path: str = "path") -> str:
    return "(" + " OR ".join(test(P.glob_regex(g), path) for g in globs) + ")"


def source(path: str = "path") -> str:
    banned = " AND ".join(f"NOT contains({path}, {quote(b)})" for b in P.BUILD_DIRS + P.TEST_MARKS)
    return f"(({path} LIKE '%.js' OR {path} LIKE '%.ts') AND {path} NOT LIKE '.%' AND {path} NOT LIKE '%/.%' AND {banned})"


def style_source(path: str = "path") -> str:
    return f"({source(path)} AND NOT contains({path}, '.min.'))"


def features_cte(name: str, family: Family, where: str) -> str:
    columns = ", ".join(f"{feature(f)} AS {n}" for n, f in family.features.items())
    return f"{name} AS MATERIALIZED (SELECT repo, path, {columns} FROM files WHERE {where})"


def issues_sql(cte: str, family: Family) -> str:
    """UNION ALL over the rules, one scan of the feature table per rule."""
    return " UNION ALL ".join(
        f"SELECT repo, path, {quote(family.name)} AS family, {quote(r.rule_id)} AS rule_id, {quote(r.type)} AS type, "
        f"CAST({r.severity} AS VARCHAR) AS severity, {quote(r.polarity)} AS polarity, CAST({r.n} AS BIGINT) AS n, "
        f"{r.description} AS description, CAST({r.remediation} AS VARCHAR) AS remediation FROM {cte} WHERE {r.when}"
        for r in family.rules
    )


EXTENSION = "lower(regexp_extract(path, '[^/](\\.[^./]*)$', 1))"


def pct(part: str, whole: str) -> str:
    return f"round(CAST({part} AS DOUBLE) / nullif(CAST({whole} AS DOUBLE), 0) * 100, 1)"
