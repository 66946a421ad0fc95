"""Queries over file contents: metrics, smells, style, security, documentation, API."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpus_audit.functions import metrics as M
from corpus_audit.functions import paths as P
from corpus_audit.functions.patterns import Count
from corpus_audit.operators import api, documentation, metrics, security, spans
from corpus_audit.operators.detect import detect, features
from corpus_audit.operators.quality_rules import ACCESS, FUNCTIONAL, MODERN, ORGANIZATION, SMELLS, STYLE
from corpus_audit.operators.rules import Family, Rule, counted, register_rule
from corpus_audit.operators.security_rules import AUTH, SECURITY
from corpus_audit.plans import derived as D
from corpus_audit.plans import oracle as O
from corpus_audit.plans import position_sql as X
from corpus_audit.plans.registry import query
from corpus_audit.sources.files import cap_per_group

CODE = O.glob(P.CODE)
CONTEXT_SQL = (
    "facts AS (SELECT repo, "
    f"coalesce(bool_or({O.glob(P.CLI_FILES)} OR ({CODE} AND {O.test(security.CLI_USE)})), false) AS cli, "
    f"coalesce(bool_or({O.glob(P.WEB_FILES)} OR ({CODE} AND {O.test(security.WEB_SERVER_USE)})), false) AS web, "
    "coalesce(bool_or(path = 'package.json' AND ((try_cast(content AS JSON) ->> '$.main') IS NOT NULL OR "
    "(try_cast(content AS JSON) ->> '$.exports') IS NOT NULL OR (try_cast(content AS JSON) ->> '$.module') IS NOT NULL)), false) AS lib, "
    f"coalesce(bool_or({O.glob(P.DOCKERFILES)}), false) AS docker, "
    f"coalesce(bool_or({O.glob(P.CODE_AND_JSON)} AND {O.test(security.PRODUCTION_USE)}), false) AS production "
    "FROM files GROUP BY repo), context AS (SELECT repo, CASE WHEN cli THEN 'cli-tool' WHEN web THEN 'web-service' "
    "WHEN lib THEN 'library' ELSE 'unknown' END AS project_type, CASE WHEN docker THEN 'containerized' "
    "WHEN production THEN 'production' ELSE 'development' END AS deployment FROM facts)"
)

# ---- metrics --------------------------------------------------------------------------------------------

_COMPLEXITY = " + ".join(["1", *[O.count(p) for p in M.BRANCH_PATTERNS]])
METRICS_CTE = (
    f"blocks AS (SELECT repo, path, len(string_split(content, chr(10))) AS lines, {_COMPLEXITY} AS complexity, "
    f"{O.count(M.FUNCTION_PATTERN)} AS functions, "
    f"list_transform(regexp_extract_all(content, {O.quote(M.BLOCK_PATTERN)}), lambda b: len(string_split(b, chr(10)))) AS b "
    f"FROM files WHERE {O.source()}), "
    "metrics AS (SELECT repo, path, lines, complexity, functions, "
    "CAST(CASE WHEN len(b) = 0 THEN 0 ELSE floor(list_sum(b) / len(b) + 0.5) END AS BIGINT) AS avg_block_length, "
    "len(list_filter(b, lambda x: x > 20)) AS long_blocks FROM blocks)"
)
METRICS_SQL = f"WITH {D.FILES_SQL}, {METRICS_CTE} "


@query("file_metrics", METRICS_SQL + "SELECT * FROM metrics")
def file_metrics(spark, sf):
    return metrics.file_metrics(D.files(spark, sf))


@query("complex_files", METRICS_SQL + "SELECT * FROM metrics WHERE complexity > 10 OR avg_block_length > 30")
def complex_files(spark, sf):
    return metrics.complex_files(metrics.file_metrics(D.files(spark, sf)))


@query(
    "complexity_by_repo",
    METRICS_SQL + "SELECT repo, count(*) AS files, CAST(sum(lines) AS BIGINT) AS total_lines, "
    "CAST(floor(sum(lines) / count(*) + 0.5) AS BIGINT) AS avg_lines, CAST(sum(complexity) AS BIGINT) AS total_complexity, "
    "max(complexity) AS max_complexity FROM metrics GROUP BY repo",
)
def complexity_by_repo(spark, sf):
    return metrics.complexity_overview(metrics.file_metrics(D.files(spark, sf)))


@query(
    "most_complex_files",
    METRICS_SQL + "SELECT * FROM (SELECT repo, path, lines, complexity, row_number() OVER (PARTITION BY repo "
    "ORDER BY complexity DESC, path) AS rank FROM metrics) WHERE rank <= 10",
)
def most_complex_files(spark, sf):
    from pyspark.sql import Window

    order = Window.partitionBy("repo").orderBy(F.col("complexity").desc(), "path")
    return (
        metrics.file_metrics(D.files(spark, sf))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= 10)
        .select("repo", "path", "lines", "complexity", "rank")
    )


@query(
    "document_line_stats",
    "SELECT lang, source, count(*) AS documents, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS lines, "
    "CAST(sum(len(list_filter(string_split(text, chr(10)), lambda l: length(l) > 120))) AS BIGINT) AS long_lines "
    "FROM documents GROUP BY lang, source",
)
def document_line_stats(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return docs.groupBy("lang", "source").agg(
        F.count(F.lit(1)).alias("documents"),
        F.sum(M.line_count(F.col("text"))).alias("lines"),
        F.sum(M.lines_longer_than(120).column(F.col("text"))).alias("long_lines"),
    )


_SRC, _TS, _JS = O.source(), f"({O.source()} AND path LIKE '%.ts')", f"({O.source()} AND path LIKE '%.js')"


@query(
    "ts_adoption",
    f"WITH {D.FILES_SQL} SELECT repo, count(*) FILTER ({_SRC}) AS sources, count(*) FILTER ({_TS}) AS ts_files, "
    f"count(*) FILTER ({_JS}) AS js_files, bool_or({O.glob(P.TSCONFIG_FILES)}) AS has_tsconfig, "
    f"{O.pct(f'count(*) FILTER ({_TS})', f'count(*) FILTER ({_SRC})')} AS ts_percentage FROM files GROUP BY repo",
)
def ts_adoption(spark, sf):
    return metrics.typescript_adoption(D.files(spark, sf))


@query(
    "type_annotation_usage",
    f"WITH {D.FILES_SQL} SELECT repo, count(*) AS ts_files, "
    f"CAST(sum({O.count(M.TYPE_ANNOTATIONS)}) AS BIGINT) AS annotations, "
    f"CAST(sum({O.count(M.ANY_TYPES)}) AS BIGINT) AS any_types FROM files WHERE {_TS} GROUP BY repo",
)
def type_annotation_usage(spark, sf):
    return metrics.type_annotation_usage(D.files(spark, sf))


_TEST = O.glob(P.TEST_FILES)


@query(
    "test_inventory",
    f"WITH {D.FILES_SQL}, t AS (SELECT repo, count(*) AS test_files, "
    f"CAST(sum({O.count(M.TEST_CASES)}) AS BIGINT) AS test_cases, "
    "bool_or(contains(content, 'jest') OR contains(content, 'describe') OR contains(content, 'it(')) AS j, "
    f"bool_or(contains(content, 'assert')) AS a FROM files WHERE {_TEST} GROUP BY repo) "
    "SELECT repo, test_files, test_cases, CASE WHEN j AND a THEN 'Jest/Mocha, Node Assert' WHEN j THEN 'Jest/Mocha' "
    "WHEN a THEN 'Node Assert' ELSE 'None detected' END AS frameworks FROM t",
)
def test_inventory(spark, sf):
    return metrics.test_inventory(D.files(spark, sf))


@query(
    "test_ratio",
    f"WITH {D.FILES_SQL}, c AS (SELECT repo, count(*) FILTER ({_TEST}) AS test_files, count(*) FILTER ({_SRC}) AS sources "
    f"FROM files GROUP BY repo), r AS (SELECT *, coalesce({O.pct('test_files', 'sources')}, 0.0) AS ratio FROM c) "
    "SELECT *, CASE WHEN test_files = 0 THEN 'none' WHEN ratio < 30 THEN 'low' WHEN ratio < 70 THEN 'moderate' "
    "ELSE 'good' END AS band FROM r",
)
def test_ratio(spark, sf):
    return metrics.test_ratio(D.files(spark, sf))


_SYNTAX_SUM = ", ".join(f"CAST(sum({O.feature(f)}) AS BIGINT) AS {n}" for n, f in M.SYNTAX.items())
SYNTAX_CTE = f"syntax AS (SELECT repo, {_SYNTAX_SUM} FROM files WHERE {O.style_source()} GROUP BY repo)"


@query("syntax_counts", f"WITH {D.FILES_SQL}, {SYNTAX_CTE} SELECT * FROM syntax")
def syntax_counts(spark, sf):
    return metrics.syntax_counts(D.files(spark, sf))


@query(
    "syntax_verdicts",
    f"WITH {D.FILES_SQL}, {SYNTAX_CTE} SELECT repo, 'avoid_var' AS verdict FROM syntax WHERE var_decls > 0 UNION ALL "
    "SELECT repo, 'consider_async_await' FROM syntax WHERE promise_chains > async_await AND promise_chains > 5 UNION ALL "
    "SELECT repo, 'use_destructuring' FROM syntax WHERE destructuring < const_decls * 0.2",
)
def syntax_verdicts(spark, sf):
    return metrics.syntax_verdicts(metrics.syntax_counts(D.files(spark, sf)))


@query("function_purity", f"WITH {D.FILES_SQL}, {X.PURITY} SELECT * FROM purity")
def function_purity(spark, sf):
    return spans.function_purity(D.files(spark, sf))


@query("side_effect_ratio", f"WITH {D.FILES_SQL}, {X.PURITY} {X.RATIO_ROWS}")
def side_effect_ratio(spark, sf):
    return spans.side_effect_ratio(spans.function_purity(D.files(spark, sf)))


@query("function_sizes", f"WITH {D.FILES_SQL}, {X.SIZES} {X.SIZE_ROWS}")
def function_sizes(spark, sf):
    return spans.function_sizes(D.files(spark, sf))


# ---- rule families --------------------------------------------------------------------------------------

SMELLS_CTE = O.features_cte("smell_features", SMELLS, O.source())
SMELLS_SQL = O.issues_sql("smell_features", SMELLS)
STYLE_PARTS = [(FUNCTIONAL, "functional_features"), (ORGANIZATION, "organization_features"), (MODERN, "modern_features")]
# Repeated access walks over positions, so twins that hold it start with WITH RECURSIVE.
ACCESS_SQL = O.issues_sql("access_features", ACCESS)
STYLE_CTE = ", ".join([*[O.features_cte(n, f, O.style_source()) for f, n in STYLE_PARTS], X.ACCESS])
STYLE_SQL = " UNION ALL ".join([*[O.issues_sql(n, f) for f, n in STYLE_PARTS], ACCESS_SQL])
RECURSIVE = f"WITH RECURSIVE {D.FILES_SQL}"
SECURITY_CTE = O.features_cte("security_features", SECURITY, CODE)
SECURITY_SQL = O.issues_sql("security_features", SECURITY)
AUTH_WHERE = O.glob(P.AUTH_FILES + P.MIDDLEWARE_FILES)
AUTH_CTE = O.features_cte("auth_features", AUTH, AUTH_WHERE)
AUTH_SQL = O.issues_sql("auth_features", AUTH)


def _features_query(name: str, family: Family, where: str):
    columns = ", ".join(family.features)
    sql = f"WITH {D.FILES_SQL}, {O.features_cte('f', family, where)} SELECT repo, path, {columns} FROM f"

    @query(name, sql)
    def run(spark, sf):
        return features(D.files(spark, sf), family)


_features_query("smell_features", SMELLS, O.source())
_features_query("functional_features", FUNCTIONAL, O.style_source())
_features_query("organization_features", ORGANIZATION, O.style_source())
_features_query("modern_features", MODERN, O.style_source())
_features_query("security_features", SECURITY, CODE)
_features_query("auth_features", AUTH, AUTH_WHERE)


@query("smells", f"WITH {D.FILES_SQL}, {SMELLS_CTE} {SMELLS_SQL}")
def smells(spark, sf):
    return detect(D.files(spark, sf), SMELLS)


@query("style_issues", f"{RECURSIVE}, {STYLE_CTE} {STYLE_SQL}")
def style_issues(spark, sf):
    return detect(D.files(spark, sf), *STYLE)


@query("repetitive_access", f"{RECURSIVE}, {X.ACCESS} {ACCESS_SQL}")
def repetitive_access(spark, sf):
    return detect(D.files(spark, sf), ACCESS)


@query("vulnerabilities", f"WITH {D.FILES_SQL}, {SECURITY_CTE}, i AS ({SECURITY_SQL}) SELECT * FROM i WHERE polarity = 'issue'")
def vulnerabilities(spark, sf):
    return detect(D.files(spark, sf), SECURITY).where(F.col("polarity") == "issue")


@query("positive_findings", f"WITH {D.FILES_SQL}, {SECURITY_CTE}, i AS ({SECURITY_SQL}) SELECT * FROM i WHERE polarity = 'positive'")
def positive_findings(spark, sf):
    return detect(D.files(spark, sf), SECURITY).where(F.col("polarity") == "positive")


@query("auth_issues", f"WITH {D.FILES_SQL}, {AUTH_CTE} {AUTH_SQL}")
def auth_issues(spark, sf):
    return detect(D.files(spark, sf), AUTH)


ALL_CTE = f"{RECURSIVE}, {SMELLS_CTE}, {STYLE_CTE}, {SECURITY_CTE}, {AUTH_CTE}, "
ALL_SQL = f"{SMELLS_SQL} UNION ALL {STYLE_SQL} UNION ALL {SECURITY_SQL} UNION ALL {AUTH_SQL}"
ALL_FAMILIES = (SMELLS, *STYLE, SECURITY, AUTH)


@query(
    "all_issues",
    f"{ALL_CTE} i AS ({ALL_SQL}) SELECT repo, family, type, count(*) AS issues, CAST(sum(n) AS BIGINT) AS occurrences, "
    "count(DISTINCT path) AS files FROM i GROUP BY repo, family, type",
)
def all_issues(spark, sf):
    per_file = (
        detect(D.files(spark, sf), *ALL_FAMILIES)
        .groupBy("repo", "family", "type", "path")
        .agg(F.count(F.lit(1)).alias("issues"), F.sum("n").alias("occurrences"))
    )
    return per_file.groupBy("repo", "family", "type").agg(
        F.sum("issues").alias("issues"),
        F.sum("occurrences").alias("occurrences"),
        F.count(F.lit(1)).alias("files"),
    )


@query(
    "issues_by_label",
    f"{ALL_CTE} i AS ({ALL_SQL}), d AS (SELECT doc_id, {D.REPO_SQL} AS repo, "
    f"replace(file, '@ID@', CAST(doc_id AS VARCHAR)) AS path FROM documents JOIN snip ON doc_id % {len(D.SNIPPETS)} = k) "
    "SELECT quality, type, count(*) AS issues FROM i JOIN d USING (repo, path) JOIN labels USING (doc_id) GROUP BY quality, type",
)
def issues_by_label(spark, sf):
    issues = detect(D.files(spark, sf), *ALL_FAMILIES).groupBy("repo", "path", "type").agg(F.count(F.lit(1)).alias("n"))
    keys = D.document_keys(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    return (
        issues.join(keys.select("repo", "path", "quality"), ["repo", "path"])
        .groupBy("quality", "type")
        .agg(F.sum("n").alias("issues"))
    )


LICENSE_WORDS = r"(?i)\blicen[sc]e"


@query(
    "custom_rule",
    f"WITH {D.FILES_SQL}, c AS (SELECT repo, path, {O.count(LICENSE_WORDS)} AS n FROM files WHERE {O.source()}) "
    "SELECT repo, path, 'license-words' AS rule_id, n, n || ' license words' AS description FROM c WHERE n > 0",
)
def custom_rule(spark, sf):
    """A rule of the user's own, next to the built-in families."""
    rule = Rule(
        "license-words", "License Words", "license_words > 0", counted("license_words", " license words"), "license_words"
    )
    mine = register_rule(Family("custom", {}, (), P.is_source), rule, {"license_words": Count(LICENSE_WORDS)})
    return detect(D.files(spark, sf), mine).select("repo", "path", "rule_id", "n", "description")


# ---- security around the rules --------------------------------------------------------------------------


@query(
    "project_context",
    f"WITH {D.FILES_SQL}, {CONTEXT_SQL} SELECT repo, project_type, deployment, project_type = 'web-service' AS user_facing, "
    "deployment <> 'development' AS is_production FROM context",
)
def project_context(spark, sf):
    return security.project_context(D.files(spark, sf))


_ADJUSTED = (
    f"adjusted AS (SELECT i.repo, path, family, rule_id, type, "
    "CASE WHEN rule_id = 'unchecked-environment' AND project_type = 'cli-tool' THEN 'Low' ELSE severity END AS severity, "
    "polarity, n, CASE WHEN rule_id = 'unchecked-environment' AND project_type = 'cli-tool' THEN "
    f"{O.quote(security.R.ENV_TEXT_CLI)} ELSE description END AS description, "
    f"CASE WHEN type = 'Information Disclosure' AND project_type = 'cli-tool' THEN {O.quote(security.R.SECRET_ADVICE_CLI)} "
    "WHEN type = 'Information Disclosure' AND project_type = 'web-service' AND deployment <> 'development' THEN "
    f"{O.quote(security.R.SECRET_ADVICE_SERVICE)} "
    f"WHEN type = 'Information Disclosure' THEN {O.quote(security.R.SECRET_ADVICE)} "
    f"WHEN rule_id = 'unchecked-environment' AND project_type = 'cli-tool' THEN {O.quote(security.R.ENV_ADVICE_CLI)} "
    f"WHEN rule_id = 'unchecked-environment' THEN {O.quote(security.R.ENV_ADVICE)} ELSE remediation END AS remediation "
    f"FROM ({SECURITY_SQL}) i JOIN context USING (repo))"
)


@query("contextual_vulnerabilities", f"WITH {D.FILES_SQL}, {CONTEXT_SQL}, {SECURITY_CTE}, {_ADJUSTED} SELECT * FROM adjusted")
def contextual_vulnerabilities(spark, sf):
    return security.issues_in_context(D.files(spark, sf), SECURITY)


_SEC = f"WITH {D.FILES_SQL}, {SECURITY_CTE}, i AS ({SECURITY_SQL}) "


@query(
    "severity_summary",
    f"WITH {D.FILES_SQL}, {CONTEXT_SQL}, {SECURITY_CTE}, {_ADJUSTED} SELECT repo, "
    + ", ".join(f"count(*) FILTER (severity = '{s}') AS {s.lower()}" for s in security.SEVERITIES)
    + " FROM adjusted WHERE polarity = 'issue' GROUP BY repo",
)
def severity_summary(spark, sf):
    return security.severity_summary(security.issues_in_context(D.files(spark, sf), SECURITY))


@query("critical_vulnerabilities", _SEC + "SELECT repo, path, type, description FROM i WHERE polarity = 'issue' AND severity = 'Critical'")
def critical_vulnerabilities(spark, sf):
    found = security.critical_issues(detect(D.files(spark, sf), SECURITY))
    return found.select("repo", "path", "type", "description")


@query(
    "top_high_issues",
    _SEC + "SELECT * FROM (SELECT repo, path, rule_id, row_number() OVER (PARTITION BY repo ORDER BY path, rule_id) AS rank "
    "FROM i WHERE polarity = 'issue' AND severity = 'High') WHERE rank <= 5",
)
def top_high_issues(spark, sf):
    found = security.top_high_issues(detect(D.files(spark, sf), SECURITY))
    return found.select("repo", "path", "rule_id", "rank")


@query("high_issues", _SEC + "SELECT repo, path, rule_id, type, description FROM i WHERE polarity = 'issue' AND severity = 'High'")
def high_issues(spark, sf):
    found = detect(D.files(spark, sf), SECURITY).where((F.col("polarity") == "issue") & (F.col("severity") == "High"))
    return found.select("repo", "path", "rule_id", "type", "description")


@query(
    "positive_summary",
    _SEC + "SELECT repo, type, count(*) AS findings, min(path) AS first_path FROM i WHERE polarity = 'positive' GROUP BY repo, type",
)
def positive_summary(spark, sf):
    return security.positive_summary(detect(D.files(spark, sf), SECURITY))


_R = [O.count(p) for p in security.ROUTE_CALLS]
_CHECKED = f"({O.test(security.VALIDATION_LIBRARIES)} OR {O.test(security.VALIDATION_WORDS)})"
ROUTES_CTE = (
    f"routes AS (SELECT repo, path, {_R[0]} AS routes, {' + '.join(_R)} AS route_matches, "
    f"CASE WHEN {_CHECKED} THEN least({' + '.join(_R)}, 1) ELSE 0 END AS validated, "
    f"{O.test(security.REQUEST_DATA)} AND NOT {_CHECKED} AS unvalidated_request, "
    f"{O.test(security.REQUEST_TO_DATABASE)} AS request_to_database FROM files WHERE {O.glob(P.ROUTE_FILES)})"
)


@query("route_validation", f"WITH {D.FILES_SQL}, {ROUTES_CTE} SELECT * FROM routes")
def route_validation(spark, sf):
    return security.route_validation(D.files(spark, sf))


@query(
    "route_issues",
    f"WITH {D.FILES_SQL}, {ROUTES_CTE} SELECT repo, path, 'Routes use request data without apparent validation' AS description "
    "FROM routes WHERE unvalidated_request UNION ALL SELECT repo, path, 'User input passed directly to database operations' "
    "FROM routes WHERE request_to_database",
)
def route_issues(spark, sf):
    return security.route_issues(security.route_validation(D.files(spark, sf)))


@query(
    "validation_coverage",
    f"WITH {D.FILES_SQL}, {ROUTES_CTE}, s AS (SELECT repo, count(*) AS route_files, CAST(sum(route_matches) AS BIGINT) AS route_matches, "
    f"CAST(sum(validated) AS BIGINT) AS validated FROM routes GROUP BY repo), c AS (SELECT *, coalesce({O.pct('validated', 'route_matches')}, 0.0) "
    "AS coverage FROM s) SELECT *, CASE WHEN coverage < 50 THEN 'low' WHEN coverage < 80 THEN 'moderate' ELSE 'good' END AS band FROM c",
)
def validation_coverage(spark, sf):
    return security.validation_coverage(security.route_validation(D.files(spark, sf)))


_ADVISORIES = ", ".join(f"({O.quote(n)}, {O.quote(v)}, {O.quote(r)})" for n, v, r in security.ADVISORIES)


@query(
    "vulnerable_deps",
    f"WITH {D.DEPENDENCIES_SQL} SELECT repo, name, version, affected, reason FROM dependencies JOIN "
    f"(VALUES {_ADVISORIES}) a(name, affected, reason) USING (name)",
)
def vulnerable_deps(spark, sf):
    return security.vulnerable_dependencies(D.dependencies(spark, sf))


@query(
    "outdated_deps",
    f"WITH {D.DEPENDENCIES_SQL} SELECT repo, name, version, 'major-zero' AS kind, name || '@' || version || ' (major version 0.x)' "
    "AS description FROM dependencies WHERE contains(version, '^0.') OR contains(version, '~0.') UNION ALL "
    "SELECT repo, name, version, 'pinned-old', name || '@' || version || ' (locked to old version)' FROM dependencies "
    "WHERE regexp_matches(version, '^[12]\\.\\d+\\.\\d+$')",
)
def outdated_deps(spark, sf):
    return security.outdated_dependencies(D.dependencies(spark, sf))


def _secrets_sql(keys: str, text: str, table: str, where: str = "true") -> str:
    parts = []
    for pattern, kind, risk in security.SECRET_PATTERNS:
        group = 1 if pattern.startswith("[") else 0
        p = O.quote(O.re2(pattern))
        parts.append(
            f"SELECT {keys}, {O.quote(kind)} AS type, substr(found, 1, 50) || CASE WHEN length(found) > 50 THEN '...' ELSE '' END AS snippet, "
            f"{O.quote(risk)} AS risk, CAST(list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) "
            f"+ {group} AS BIGINT) AS \"offset\", length(found) AS length, sha256(found) AS sha256 FROM (SELECT *, g[i] AS found FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i "
            f"FROM (SELECT {keys}, regexp_extract_all({text}, {p}) AS m, regexp_extract_all({text}, {p}, {group}) AS g, string_split_regex({text}, {p}) AS s FROM {table} WHERE {where})))"
        )
    return " UNION ALL ".join(parts)


_SECRET_WHERE = f"{O.glob(P.SECRET_FILES)} AND NOT contains(path, ''node_modules'')".replace("''", "'")


@query("exposed_secrets", f"WITH {D.FILES_SQL} " + _secrets_sql("repo, path", "content", "files", _SECRET_WHERE))
def exposed_secrets(spark, sf):
    return security.find_secrets(D.files(spark, sf))


@query("document_secrets", _secrets_sql("doc_id", "text", "documents"))
def document_secrets(spark, sf):
    return security.secrets_in(spark.read.parquet(f"{sf}/documents.parquet"), ["doc_id"], "text")


@query(
    "secrets_by_source",
    f"WITH s AS ({_secrets_sql('source, lang', 'text', 'documents')}) SELECT source, lang, type, count(*) AS secrets "
    "FROM s GROUP BY source, lang, type",
)
def secrets_by_source(spark, sf):
    found = security.secrets_in(spark.read.parquet(f"{sf}/documents.parquet"), ["source", "lang"], "text")
    return found.groupBy("source", "lang", "type").agg(F.count(F.lit(1)).alias("secrets"))


@query("page_secrets", f"WITH {D.PAGE_TEXTS_SQL} " + _secrets_sql("page_id", "html", "page_texts"))
def page_secrets(spark, sf):
    return security.secrets_in(D.page_texts(spark, sf), ["page_id"], "html")


@query("env_files", f"WITH {D.FILES_SQL} SELECT repo, path FROM files WHERE {O.glob(P.ENV_FILES)}")
def env_files(spark, sf):
    return security.env_files(D.files(spark, sf))


# ---- documentation --------------------------------------------------------------------------------------

_README = [
    "regexp_matches(content, '\\A#\\s+')" if p.startswith("^") else O.test(p) for _, _, p in documentation.README_CHECKS
]
_README[1] = f"(length(content) > 200 AND {_README[1]})"


def _listed(negate: bool) -> str:
    cases = ", ".join(
        f"CASE WHEN {'NOT ' if negate else ''}c{i} THEN {O.quote(l)} END" for i, (l, _, _) in enumerate(documentation.README_CHECKS)
    )
    return f"concat_ws('; ', {cases})"


@query(
    "readme_scores",
    f"WITH {D.FILES_SQL}, r AS (SELECT repo, path, {', '.join(f'{c} AS c{i}' for i, c in enumerate(_README))} FROM files "
    f"WHERE {O.glob(P.README_FILES)}), s AS (SELECT *, "
    + " + ".join(f"CAST(c{i} AS BIGINT) * {w}" for i, (_, w, _) in enumerate(documentation.README_CHECKS))
    + f" AS score FROM r) SELECT repo, path, score, {_listed(False)} AS passed, {_listed(True)} AS missing, "
    "CASE WHEN score >= 8 THEN 'excellent' WHEN score >= 6 THEN 'good' WHEN score >= 4 THEN 'basic' ELSE 'poor' END AS band FROM s",
)
def readme_scores(spark, sf):
    scored = documentation.readme_score(D.files(spark, sf))
    return scored.withColumn("passed", F.array_join("passed", "; ")).withColumn("missing", F.array_join("missing", "; "))


BLOCK_LINES_SQL = (
    "l AS (SELECT repo, path, unnest(string_split(content, chr(10))) AS t, "
    "unnest(range(1, len(string_split(content, chr(10))) + 1)) AS line FROM files WHERE " + CODE + "), "
    "b AS (SELECT repo, path, line FROM l WHERE contains(t, '/**')), "
    "s AS (SELECT repo, path, line, t FROM l WHERE regexp_matches(t, '(class|function)\\s+\\w+'))"
)


def _line_symbols(files):
    lines = files.where(P.is_code(F.col("path"))).select(
        "repo", "path", F.posexplode(F.split("content", "\n")).alias("pos", "t")
    )
    return lines.where(F.rlike("t", F.lit(r"(class|function)\s+\w+"))).select(
        "repo", "path", (F.col("pos") + 1).alias("line"), "t"
    )


@query("docblock_lines", f"WITH {D.FILES_SQL}, {BLOCK_LINES_SQL} SELECT repo, path, line FROM b")
def docblock_lines(spark, sf):
    return documentation.docblock_lines(D.files(spark, sf))


@query(
    "docblock_band_join",
    f"WITH {D.FILES_SQL}, {BLOCK_LINES_SQL} SELECT repo, path, line, t FROM s WHERE EXISTS (SELECT 1 FROM b WHERE b.repo = s.repo "
    "AND b.path = s.path AND abs(b.line - s.line) <= 2)",
)
def docblock_band_join(spark, sf):
    files = D.files(spark, sf)
    return documentation.documented(_line_symbols(files), documentation.docblock_lines(files)).select("repo", "path", "line", "t")


@query(
    "docblock_band_anti_join",
    f"WITH {D.FILES_SQL}, {BLOCK_LINES_SQL} SELECT repo, path, line, t FROM s WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.repo = s.repo "
    "AND b.path = s.path AND abs(b.line - s.line) <= 4)",
)
def docblock_band_anti_join(spark, sf):
    files = D.files(spark, sf)
    found = documentation.undocumented(_line_symbols(files), documentation.docblock_lines(files), 4)
    return found.select("repo", "path", "line", "t")


@query("symbols", f"WITH {D.FILES_SQL}, {X.SYMBOLS} {X.SYMBOL_ROWS}")
def symbols(spark, sf):
    return documentation.symbols(spans.file_symbols(D.files(spark, sf)))


@query("docblocks", f"WITH {D.FILES_SQL}, {X.SYMBOLS} SELECT repo, path, line FROM docblocks")
def docblocks(spark, sf):
    return documentation.docblocks(spans.file_symbols(D.files(spark, sf)))


@query("file_doc_scores", f"WITH {D.FILES_SQL}, {X.SYMBOLS} SELECT * FROM scores")
def file_doc_scores(spark, sf):
    return documentation.file_doc_scores(spans.file_symbols(D.files(spark, sf)))


@query("first_doc_issues", f"WITH {D.FILES_SQL}, {X.SYMBOLS} {X.FIRST_ISSUE_ROWS}")
def first_doc_issues(spark, sf):
    return documentation.file_doc_issues(spans.file_symbols(D.files(spark, sf)), limit=documentation.ISSUES_PER_FILE)


@query("file_doc_issues", f"WITH {D.FILES_SQL}, {X.SYMBOLS} {X.ISSUE_ROWS}")
def file_doc_issues(spark, sf):
    return documentation.file_doc_issues(spans.file_symbols(D.files(spark, sf)))


@query("doc_coverage", f"WITH {D.FILES_SQL}, {X.SYMBOLS} {X.COVERAGE_ROWS}")
def doc_coverage(spark, sf):
    return documentation.doc_coverage(documentation.file_doc_scores(spans.file_symbols(D.files(spark, sf))))


_ROUTE = O.glob(P.ROUTE_FILES)


@query(
    "api_docs",
    f"WITH {D.FILES_SQL}, g AS (SELECT repo, count(*) FILTER ({O.glob(P.API_SPEC_FILES)}) AS spec_files, "
    f"count(*) FILTER ({O.glob(P.POSTMAN_FILES)}) AS postman_files, count(*) FILTER ({_ROUTE}) AS route_files, "
    f"bool_or({_ROUTE} AND {O.test(documentation.API_MARKS)}) AS inline_docs FROM files GROUP BY repo) SELECT *, "
    "CASE WHEN inline_docs THEN 'inline documentation' WHEN route_files > 0 THEN 'routes without inline documentation' "
    "ELSE 'no routes' END AS verdict FROM g",
)
def api_docs(spark, sf):
    return documentation.api_docs(D.files(spark, sf))


@query(
    "api_doc_files",
    f"WITH {D.FILES_SQL} SELECT repo, path, CASE WHEN {O.glob(P.API_SPEC_FILES)} THEN 'specification' ELSE 'postman' END AS kind "
    f"FROM files WHERE {O.glob(P.API_SPEC_FILES)} OR {O.glob(P.POSTMAN_FILES)}",
)
def api_doc_files(spark, sf):
    return documentation.api_doc_files(D.files(spark, sf))


@query(
    "undocumented_configs",
    f"WITH {D.FILES_SQL} SELECT repo, path FROM files WHERE {O.glob(P.CONFIG_FILES)} AND NOT contains(path, 'node_modules') AND repo NOT IN "
    f"(SELECT repo FROM files WHERE {O.glob(P.DOC_FILES)} AND (contains(lower(path), 'config') OR contains(lower(path), 'setup')))",
)
def undocumented_configs(spark, sf):
    return documentation.undocumented_configs(D.files(spark, sf))


# ---- API ------------------------------------------------------------------------------------------------

API_CTE = (
    f"api AS (SELECT repo, path, {O.test_any(api.ERROR_HANDLING)} AS error_handling, {O.test_any(api.INPUT_VALIDATION)} AS input_validation, "
    f"{O.test_any(api.AUTHENTICATION)} AS authentication FROM files WHERE {O.glob(P.API_FILES)} AND {O.test_any(api.API_PATTERNS)})"
)


@query("api_report", f"WITH {D.FILES_SQL}, {API_CTE} SELECT * FROM api")
def api_report(spark, sf):
    return api.api_report(D.files(spark, sf))


API_ISSUES_SQL = (
    "SELECT repo, path, 'Missing error handling' AS description FROM api WHERE NOT error_handling UNION ALL "
    "SELECT repo, path, 'Missing input validation' FROM api WHERE NOT input_validation UNION ALL "
    "SELECT repo, path, 'Missing authentication patterns' FROM api WHERE NOT authentication"
)


@query("api_issues", f"WITH {D.FILES_SQL}, {API_CTE} {API_ISSUES_SQL}")
def api_issues(spark, sf):
    return api.api_issues(api.api_report(D.files(spark, sf)))


@query(
    "api_overview",
    f"WITH {D.FILES_SQL}, {API_CTE} SELECT repo, count(*) AS api_files, count(*) FILTER (error_handling) AS with_error_handling, "
    "count(*) FILTER (input_validation) AS with_input_validation, count(*) FILTER (authentication) AS with_authentication "
    "FROM api GROUP BY repo",
)
def api_overview(spark, sf):
    return api.api_overview(api.api_report(D.files(spark, sf)))


_FLAGS = ["is_api_file", "has_error_handling", "has_input_validation", "has_auth"]
_FLAG_PATTERNS = [api.API_PATTERNS, api.ERROR_HANDLING, api.INPUT_VALIDATION, api.AUTHENTICATION]


@query(
    "api_flags",
    f"WITH {D.FILES_SQL} SELECT repo, path, "
    + ", ".join(f"{O.test_any(p)} AS {n}" for n, p in zip(_FLAGS, _FLAG_PATTERNS))
    + f" FROM files WHERE {CODE}",
)
def api_flags(spark, sf):
    content = F.col("content")
    return (
        D.files(spark, sf)
        .where(P.is_code(F.col("path")))
        .select("repo", "path", *[getattr(api, n)(content).alias(n) for n in _FLAGS])
    )


FLAGS_CTE = (
    f"flags AS (SELECT repo, coalesce(bool_or({CODE} AND {O.test_any(api.ROUTE_PATTERNS)}), false) AS has_api_routes, "
    f"coalesce(bool_or({CODE} AND {O.test_any(api.AUTH_WORDS)}), false) AS has_auth FROM files GROUP BY repo)"
)


@query("repo_api_flags", f"WITH {D.FILES_SQL}, {FLAGS_CTE} SELECT * FROM flags")
def repo_api_flags(spark, sf):
    return api.repo_api_flags(D.files(spark, sf))
