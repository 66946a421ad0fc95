"""Run rule families over a files table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpus_audit.operators.metrics import computed_once
from corpus_audit.operators.rules import Family, Rule, text

ISSUE_COLUMNS = [
    "repo",
    "path",
    "family",
    "rule_id",
    "type",
    "severity",
    "polarity",
    "n",
    "description",
    "remediation",
]


def features(files: DataFrame, family: Family) -> DataFrame:
    """One row per file the family applies to, one column per feature; the text is dropped."""
    content = F.col("content")
    return computed_once(
        files.where(family.applies_to(F.col("path"))),
        "repo",
        "path",
        *[f.column(content).alias(name) for name, f in family.features.items()],
    )


def _issue(family: Family, rule: Rule, scope: str) -> str:
    """SQL for the issue a rule raises on a row of features, NULL when it does not fire."""
    return (
        f"CASE WHEN {scope} AND ({rule.when}) THEN named_struct("
        f"'family', {text(family.name)}, 'rule_id', {text(rule.rule_id)}, 'type', {text(rule.type)}, "
        f"'severity', CAST({rule.severity} AS STRING), 'polarity', {text(rule.polarity)}, "
        f"'n', CAST({rule.n} AS BIGINT), 'description', {rule.description}, "
        f"'remediation', CAST({rule.remediation} AS STRING)) END"
    )


def _scopes(families) -> dict[object, str]:
    """The path predicates of the families, each with the name of its flag column."""
    return {scope: f"_scope{i}" for i, scope in enumerate(dict.fromkeys(f.applies_to for f in families))}


def measure(files: DataFrame, *families: Family, **facts: Column) -> DataFrame:
    """One row per file that a family applies to or a fact holds for, without its text: repo, path, the families'
    features, and ``facts``, named boolean expressions over the path and content of any file.

    Every feature is one expression guarded by the path predicate of the families that need it, so a file is read once
    however many families run.  Nothing is shuffled.
    """
    path, content = F.col("path"), F.col("content")
    flag_of = _scopes(families)
    wanted: dict[str, tuple[object, list[str]]] = {}
    for family in families:
        for name, feature in family.features.items():
            known, needed_by = wanted.setdefault(name, (feature, []))
            if known != feature:
                raise ValueError(f"feature {name!r} has two definitions")
            if flag_of[family.applies_to] not in needed_by:
                needed_by.append(flag_of[family.applies_to])
    marked = files.select("repo", "path", "content", *[scope(path).alias(name) for scope, name in flag_of.items()])
    if not facts:
        marked = marked.where(" OR ".join(flag_of.values()))
    features = [F.when(F.expr(" OR ".join(needed_by)), feature.column(content)).alias(name) for name, (feature, needed_by) in wanted.items()]
    return marked.select("repo", "path", *flag_of.values(), *features, *[F.coalesce(c, F.lit(False)).alias(n) for n, c in facts.items()])


def raise_issues(measured: DataFrame, *families: Family) -> DataFrame:
    """Issue rows from :func:`measure`, other columns of which are dropped."""
    flag_of = _scopes(families)
    raised = ", ".join(_issue(f, r, flag_of[f.applies_to]) for f in families for r in f.rules)
    issues = F.expr(f"array_compact(array({raised}))")
    # explode_outer keeps the optimizer from adding a size filter that evaluates every feature twice.
    return (
        measured.select("repo", "path", F.explode_outer(issues).alias("i"))
        .select("repo", "path", "i.*")
        .where(F.col("rule_id").isNotNull())
        .select(*ISSUE_COLUMNS)
    )


def detect(files: DataFrame, *families: Family) -> DataFrame:
    """Issue rows of ``families`` in one pass over the text, without a shuffle: a file becomes its feature columns, and
    those become issue rows."""
    return raise_issues(measure(files, *families), *families)
