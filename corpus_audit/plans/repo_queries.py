"""Queries over listings, dependencies, settings, reports and comments."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpus_audit.functions import paths as P
from corpus_audit.functions import values as V
from corpus_audit.operators import api, documentation, governance, metrics, profile, rollup, spans
from corpus_audit.operators.detect import detect
from corpus_audit.operators.quality_rules import SMELLS, STYLE
from corpus_audit.operators.security_rules import SECURITY
from corpus_audit.plans import derived as D
from corpus_audit.plans import oracle as O
from corpus_audit.plans import position_sql as X
from corpus_audit.plans.code_queries import (
    API_CTE,
    API_ISSUES_SQL,
    CODE,
    FLAGS_CTE,
    RECURSIVE,
    SECURITY_CTE,
    SECURITY_SQL,
    SMELLS_CTE,
    SMELLS_SQL,
    STYLE_CTE,
    STYLE_SQL,
)
from corpus_audit.plans.registry import query
from corpus_audit.sources import config, exclusions, manifests, reports
from corpus_audit.sources import files as S

FILES = f"WITH {D.FILES_SQL}"
STATS = f"WITH {D.STATS_SQL}"
EXT = O.EXTENSION

# ---- paths ----------------------------------------------------------------------------------------------

_MISC = [
    ("is_source", O.source(), P.is_source),
    ("is_style_source", O.style_source(), P.is_style_source),
    ("is_test_file", O.glob(P.TEST_FILES), P.is_test_file),
    ("in_test_dir", O.glob(P.TEST_DIRS), P.in_test_dir),
    ("is_auth", O.glob(P.AUTH_FILES), P.is_auth),
    ("is_middleware", O.glob(P.MIDDLEWARE_FILES), P.is_middleware),
    ("is_route", O.glob(P.ROUTE_FILES), P.is_route),
    ("is_api_candidate", O.glob(P.API_FILES), P.is_api_candidate),
    ("is_secret_candidate", f"{O.glob(P.SECRET_FILES)} AND NOT contains(path, 'node_modules')", P.is_secret_candidate),
    ("is_root_env", O.glob(P.ENV_FILES), P.is_root_env),
    ("is_readme", O.glob(P.README_FILES), lambda p: P.matches_glob(p, P.README_FILES)),
    ("is_config", O.glob(P.CONFIG_FILES), lambda p: P.matches_glob(p, P.CONFIG_FILES)),
    ("is_doc", O.glob(P.DOC_FILES), lambda p: P.matches_glob(p, P.DOC_FILES)),
    ("is_cli", O.glob(P.CLI_FILES), lambda p: P.matches_glob(p, P.CLI_FILES)),
    ("is_server", O.glob(P.SERVER_FILES), lambda p: P.matches_glob(p, P.SERVER_FILES)),
    ("is_web", O.glob(P.WEB_FILES), lambda p: P.matches_glob(p, P.WEB_FILES)),
    ("is_manifest", O.glob(P.MANIFESTS), lambda p: P.matches_glob(p, P.MANIFESTS)),
]


@query("path_flags", f"{FILES} SELECT repo, path, " + ", ".join(f"{sql} AS {n}" for n, sql, _ in _MISC) + " FROM files")
def path_flags(spark, sf):
    path = F.col("path")
    return D.files(spark, sf).select("repo", "path", *[fn(path).alias(n) for n, _, fn in _MISC])


@query(
    "test_files",
    f"{FILES} SELECT repo, "
    + ", ".join(f"count(*) FILTER ({O.glob([g])}) AS {n}" for n, g in zip(["test_js", "test_ts", "spec_js", "spec_ts"], P.TEST_FILES))
    + " FROM files GROUP BY repo",
)
def test_files(spark, sf):
    path = F.col("path")
    names = ["test_js", "test_ts", "spec_js", "spec_ts"]
    return D.files(spark, sf).groupBy("repo").agg(
        *[metrics.total(P.matches_glob(path, [g])).alias(n) for n, g in zip(names, P.TEST_FILES)]
    )


_NORM = (
    "norm AS (SELECT page_id, path AS raw, url_decode(CASE WHEN p = '/' THEN p ELSE rtrim(p, '/') END) AS path FROM "
    "(SELECT page_id, path, regexp_replace(replace(trim(path, ' ' || chr(9) || chr(10) || chr(13)), '\\', '/'), '/+', '/', 'g') AS p "
    "FROM page_paths))"
)


@query("normalized_paths", f"WITH {D.PAGES_SQL}, {_NORM} SELECT page_id, raw AS path, path AS normalized FROM norm")
def normalized_paths(spark, sf):
    return D.page_paths(spark, sf).withColumn("normalized", P.normalize_path(F.col("path")))


_BASE = "regexp_extract(path, '([^/]*)/?$', 1)"
_AUDIT_CHECKS = [
    ("control_characters", f"regexp_matches(raw, {O.quote(P.CONTROL_CHARACTERS)})"),
    ("traversal", "contains(path, '..')"),
    (
        "restricted_directory",
        "starts_with(path, '/') AND (" + " OR ".join(f"starts_with(lower(path), {O.quote(p)})" for p in P.RESTRICTED_FOR_OUTPUT) + ")",
    ),
    (
        "dangerous_component",
        "len(list_filter(string_split(path, '/'), lambda c: lower(c) IN (" + ", ".join(O.quote(c) for c in P.DANGEROUS_COMPONENTS) + "))) > 0",
    ),
    ("too_long", "length(path) > 260"),
    ("template", f"regexp_matches(path, {O.quote(P.TEMPLATES)})"),
    ("sensitive_name", "(" + " OR ".join(f"contains(lower({_BASE}), {O.quote(w)})" for w in P.SENSITIVE_NAMES) + ")"),
    ("unusual_characters", f"NOT regexp_matches({_BASE}, '^[a-zA-Z0-9._-]+$')"),
]
_AUDIT = ", ".join(f"CASE WHEN {c} THEN {O.quote(n)} END" for n, c in _AUDIT_CHECKS)


@query("path_audit", f"WITH {D.PAGES_SQL}, {_NORM} SELECT page_id, concat_ws(', ', {_AUDIT}) AS violations FROM norm")
def path_audit(spark, sf):
    return D.page_paths(spark, sf).select(
        "page_id", F.array_join(P.path_violations(F.col("path")), ", ").alias("violations")
    )


@query("url_extensions", f"SELECT {EXT.replace('path', 'url')} AS extension, count(*) AS pages FROM pages GROUP BY 1")
def url_extensions(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    return pages.groupBy(P.extension(F.col("url")).alias("extension")).agg(F.count(F.lit(1)).alias("pages"))


# ---- sources --------------------------------------------------------------------------------------------


@query(
    "loaded_files",
    "SELECT table_name || '.parquet' AS path, 'parquet' AS extension, true AS has_content FROM information_schema.tables "
    "WHERE table_name IN ('region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events', 'documents', 'embeddings', 'pages', "
    "'benchmark', 'labels', 'conversations')",
)
def loaded_files(spark, sf):
    """The files of the given folder, listed without reading their contents."""
    found = S.load_files(spark, sf)
    return found.select("path", F.substring_index("path", ".", -1).alias("extension"), (F.col("size") > 0).alias("has_content"))


@query("selected_files", f"{FILES} SELECT repo, path FROM files WHERE {O.glob(P.DEFAULT_INCLUDES)}")
def selected_files(spark, sf):
    return S.select_by_glob(D.files(spark, sf)).select("repo", "path")


def _excluded_sql(pattern: str) -> str:
    """One default pattern by its documented mode."""
    q = O.quote
    if pattern.endswith("/**"):
        d = pattern[:-3]
        return f"(starts_with(path, {q(d + '/')}) OR path = {q(d)})"
    if "*" in pattern:
        return f"regexp_matches(path, {q('^' + pattern.replace('.', '[.]').replace('*', '.*') + '$')})"
    return (
        f"(path = {q(pattern)} OR starts_with(path, {q(pattern + '/')}) OR contains(path, {q('/' + pattern + '/')}) "
        f"OR ends_with(path, {q('/' + pattern)}))"
    )


_DEFAULTS = "(" + " OR ".join(_excluded_sql(p) for p in exclusions.DEFAULT_EXCLUSIONS) + ")"
RULES_SQL = (
    "rule_lines AS (SELECT repo, trim(unnest(string_split(content, chr(10))), ' ' || chr(9) || chr(13)) AS pattern FROM files "
    "WHERE path = '.gitignore'), rules AS (SELECT repo, pattern FROM rule_lines WHERE pattern <> '' AND NOT starts_with(pattern, '#'))"
)
# The derived ignore files hold these four patterns.
_IGNORED = (
    "(repo IN (SELECT repo FROM rules WHERE pattern = 'docs/**') AND starts_with(path, 'docs/') OR "
    "repo IN (SELECT repo FROM rules WHERE pattern = '*.test.js') AND ends_with(path, '.test.js') OR "
    "repo IN (SELECT repo FROM rules WHERE pattern = 'controllers/') AND regexp_matches(path, '(^|/)controllers(/|$)') OR "
    "repo IN (SELECT repo FROM rules WHERE pattern = '**/session*.js') AND regexp_matches(path, '^(.*/session[^/]*[.]js.*|session[^/]*[.]js)$'))"
)
USER_PATTERNS = ["**/config/**", "swagger.yaml"]
_USER = "(path LIKE 'config/%' OR path LIKE '%/config/%' OR path = 'config' OR regexp_matches(path, '(^|/)swagger[.]yaml(/|$)'))"


@query("ignore_rules", f"{FILES}, {RULES_SQL} SELECT repo, pattern FROM rules")
def ignore_rules(spark, sf):
    return exclusions.ignore_rules(D.files(spark, sf)).select("repo", "pattern")


@query("kept_files", f"{FILES}, {RULES_SQL} SELECT repo, path FROM files WHERE NOT ({_DEFAULTS} OR {_USER} OR {_IGNORED})")
def kept_files(spark, sf):
    files = D.files(spark, sf)
    return exclusions.exclude_paths(files, exclusions.ignore_rules(files), USER_PATTERNS).select("repo", "path")


@query(
    "excluded_paths",
    f"{FILES}, {RULES_SQL}, o AS (SELECT repo, path, CASE WHEN {_DEFAULTS} THEN 'default' WHEN {_IGNORED} THEN 'ignore_file' "
    f"WHEN {_USER} THEN 'user' END AS origin FROM files) SELECT * FROM o WHERE origin IS NOT NULL",
)
def excluded_paths(spark, sf):
    files = D.files(spark, sf)
    return exclusions.excluded_paths(files, exclusions.ignore_rules(files), USER_PATTERNS)


@query(
    "exclusion_summary",
    f"{FILES}, {RULES_SQL} SELECT r.repo, 20 AS \"default\", count(pattern) AS ignore_file, 2 AS \"user\", 22 + count(pattern) AS total "
    "FROM (SELECT DISTINCT repo FROM files) r LEFT JOIN rules USING (repo) GROUP BY r.repo",
)
def exclusion_summary(spark, sf):
    files = D.files(spark, sf)
    return exclusions.exclusion_summary(files, exclusions.ignore_rules(files), USER_PATTERNS)


MANIFEST_SQL = (
    "m AS (SELECT repo, try_cast(content AS JSON) AS j FROM files WHERE path = 'package.json'), "
    "manifests AS (SELECT repo, j IS NOT NULL AS valid, j ->> '$.name' AS name, j ->> '$.main' AS main, "
    "j ->> '$.scripts.test' AS test_script FROM m), "
    "deps AS (SELECT repo, d AS name, coalesce(j -> 'devDependencies' ->> d, j -> 'dependencies' ->> d) AS version FROM "
    "(SELECT repo, j, unnest(list_distinct(list_concat(json_keys(j, '$.dependencies'), json_keys(j, '$.devDependencies')))) AS d FROM m))"
)


@query("manifests", f"{FILES}, {MANIFEST_SQL} SELECT * FROM manifests")
def parsed_manifests(spark, sf):
    return manifests.manifests(D.files(spark, sf)).select(
        "repo", "valid", "name", "main", F.element_at("scripts", F.lit("test")).alias("test_script")
    )


@query("manifest_dependencies", f"{FILES}, {MANIFEST_SQL} SELECT repo, name, version FROM deps")
def manifest_dependencies(spark, sf):
    return manifests.dependencies(manifests.manifests(D.files(spark, sf)))


_LINES_SQL = (
    "cl AS (SELECT repo, path, unnest(string_split(content, chr(10))) AS raw, "
    "unnest(range(0, len(string_split(content, chr(10))))) AS pos FROM {table}), "
    "ce AS (SELECT repo, path, pos, trim(string_split(raw, '#')[1], ' ' || chr(9) || chr(13)) AS line FROM cl), "
    "ck AS (SELECT repo, path, pos, regexp_extract(line, '^([A-Za-z_][A-Za-z0-9_]*)\\s*=\\s*(.*)$', 1) AS key, "
    "trim(regexp_extract(line, '^([A-Za-z_][A-Za-z0-9_]*)\\s*=\\s*(.*)$', 2)) AS v FROM ce WHERE "
    "regexp_matches(line, '^([A-Za-z_][A-Za-z0-9_]*)\\s*=\\s*(.*)$')), "
    "cv AS (SELECT repo, path, pos, key, CASE WHEN regexp_matches(v, '^\".*\"$') OR regexp_matches(v, '^''.*''$') "
    "THEN substr(v, 2, length(v) - 2) ELSE v END AS value FROM ck), "
    "centries AS (SELECT repo, path, key, arg_max(value, pos) AS value FROM cv GROUP BY repo, path, key)"
)


@query("env_file_entries", f"{FILES}, env AS (SELECT * FROM files WHERE path = '.env'), {_LINES_SQL.replace('{table}', 'env')} SELECT * FROM centries")
def env_file_entries(spark, sf):
    return config.config_entries(D.files(spark, sf).where(F.col("path") == ".env"))


@query("config_entries", f"WITH {D.ENTRIES_SQL}, {D.CONFIG_TEXT_SQL}, {_LINES_SQL.replace('{table}', 'config_text')} SELECT * FROM centries")
def config_entries(spark, sf):
    return config.config_entries(D.config_text(spark, sf))


@query(
    "capped_content",
    f"{FILES} SELECT repo, path, CASE WHEN strlen(content) < 512000 THEN substr(content, 1, 2000) END AS content FROM files",
)
def capped_content(spark, sf):
    return S.cap_content(D.files(spark, sf), chars=2000, below_bytes=P.TEXT_BYTES).select("repo", "path", "content")


@query("whole_content", f"{FILES} SELECT repo, path, content FROM files")
def whole_content(spark, sf):
    return S.cap_content(D.files(spark, sf)).select("repo", "path", "content")


_WANTED_SQL = (
    "wanted AS (SELECT DISTINCT 'repo' || CAST(doc_id // 50 AS VARCHAR) AS repo, "
    "CASE WHEN quality = 1 THEN 'README.md' ELSE 'src/core/f' || CAST(doc_id AS VARCHAR) || '.js' END AS path FROM labels)"
)


def _wanted(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    number = F.col("doc_id").cast("string")
    return labels.select(
        F.concat(F.lit("repo"), F.floor(F.col("doc_id") / 50).cast("string")).alias("repo"),
        F.when(F.col("quality") == 1, "README.md").otherwise(F.concat(F.lit("src/core/f"), number, F.lit(".js"))).alias("path"),
    ).distinct()


@query("listed_files", f"{FILES}, {_WANTED_SQL} SELECT repo, path FROM files SEMI JOIN wanted USING (repo, path)")
def listed_files(spark, sf):
    return S.select_files(D.files(spark, sf), _wanted(spark, sf)).select("repo", "path")


@query(
    "listed_and_found",
    f"{FILES}, {_WANTED_SQL} SELECT w.repo, count(*) AS listed, count(f.path) AS found FROM wanted w LEFT JOIN files f "
    "ON f.repo = w.repo AND f.path = w.path GROUP BY w.repo",
)
def listed_and_found(spark, sf):
    return S.listed_and_found(D.files(spark, sf), _wanted(spark, sf))


# ---- profile --------------------------------------------------------------------------------------------

_CAT = "CASE WHEN size <= 10240 THEN 'small' WHEN size <= 51200 THEN 'medium' WHEN size <= 102400 THEN 'large' ELSE 'huge' END"
_CATS = ", ".join(f"count(*) FILTER ({_CAT} = '{c}') AS {c}" for c in profile.CATEGORIES)


@query(
    "file_classes",
    f"{STATS} SELECT repo, path, size, {EXT} AS extension, {_CAT} AS size_category, size > 102400 AS is_large, "
    "CASE WHEN size < 1024 THEN CAST(size AS VARCHAR) || ' B' ELSE regexp_replace(CAST(CAST(round(size / 1024.0, 1) AS DECIMAL(20,1)) AS VARCHAR), "
    "'[.]0$', '') || ' KB' END AS human_size FROM file_stats",
)
def file_classes(spark, sf):
    return profile.file_classes(D.file_stats(spark, sf))


@query(
    "repo_summary",
    f"{STATS} SELECT repo, count(*) AS files, CAST(sum(size) AS BIGINT) AS total_size, CAST(sum(size) AS DOUBLE) / count(*) AS average_size "
    "FROM file_stats GROUP BY repo",
)
def repo_summary(spark, sf):
    return profile.repo_summary(D.file_stats(spark, sf))


@query(
    "quick_scan",
    f"{STATS} SELECT repo, count(*) AS files, CAST(sum(size) AS BIGINT) AS total_size, CAST(sum(size) AS DOUBLE) / count(*) AS average_size, "
    f"{_CATS}, count(*) > 100 OR sum(size) > 5 * 1024 * 1024 AS is_large_repo FROM file_stats GROUP BY repo",
)
def quick_scan(spark, sf):
    return profile.quick_scan(D.file_stats(spark, sf))


@query("size_distribution", f"{STATS} SELECT repo, {_CATS} FROM file_stats GROUP BY repo")
def size_distribution(spark, sf):
    return profile.size_distribution(D.file_stats(spark, sf))


@query(
    "extension_breakdown",
    f"{STATS}, c AS (SELECT repo, {EXT} AS extension, count(*) AS files FROM file_stats GROUP BY repo, extension) "
    "SELECT *, row_number() OVER (PARTITION BY repo ORDER BY files DESC, extension) AS rank FROM c",
)
def extension_breakdown(spark, sf):
    return profile.extension_breakdown(D.file_stats(spark, sf))


_LANGS = ", ".join(f"({O.quote(e)}, {O.quote(l)})" for e, l in profile.LANGUAGES.items())
_LANG_CTE = (
    f"l AS (SELECT repo, language, count(*) AS files FROM (SELECT repo, {EXT} AS extension FROM file_stats) JOIN "
    f"(VALUES {_LANGS}) v(extension, language) USING (extension) GROUP BY repo, language)"
)


@query(
    "language_distribution",
    f"{STATS}, {_LANG_CTE} SELECT repo, language, files, round(CAST(files AS DOUBLE) / sum(files) OVER (PARTITION BY repo) * 100, 1) AS percentage, "
    "row_number() OVER (PARTITION BY repo ORDER BY files DESC, language) AS rank FROM l",
)
def language_distribution(spark, sf):
    return profile.language_distribution(D.file_stats(spark, sf))


@query(
    "primary_language",
    f"{STATS}, {_LANG_CTE}, r AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY files DESC, language) AS rank FROM l) "
    "SELECT s.repo, coalesce(r.language, 'Unknown') AS primary_language FROM (SELECT DISTINCT repo FROM file_stats) s LEFT JOIN r "
    "ON r.repo = s.repo AND r.rank = 1",
)
def primary_language(spark, sf):
    return profile.primary_language(D.file_stats(spark, sf))


def _frameworks_sql(table: str) -> str:
    def has(part: str) -> str:
        return f"bool_or(contains(path, '{part}'))"

    def ext(*names: str) -> str:
        return f"bool_or({EXT} IN ({', '.join(O.quote(n) for n in names)}))"

    rules = [
        ("frontend", "Next.js", f"({ext('.jsx', '.tsx')} OR {has('package.json')}) AND {has('next.config')}"),
        ("frontend", "React", f"{ext('.jsx', '.tsx')} AND NOT {has('next.config')}"),
        ("frontend", "Vue.js", ext(".vue")),
        ("frontend", "Angular", has("angular.json")),
        ("backend", "Express.js", has("express")),
        ("backend", "Fastify", has("fastify")),
        ("backend", "Django", f"{ext('.py')} AND {has('django')}"),
        ("backend", "Flask", f"{ext('.py')} AND {has('flask')}"),
        ("backend", "FastAPI", f"{ext('.py')} AND {has('fastapi')}"),
        ("testing", "Jest", has("jest")),
        ("testing", "Cypress", has("cypress")),
        ("testing", "Playwright", has("playwright")),
        ("build", "Webpack", has("webpack")),
        ("build", "Vite", has("vite")),
        ("build", "Rollup", has("rollup")),
    ]
    return " UNION ALL ".join(
        f"SELECT repo, '{g}' AS \"group\", '{n}' AS framework FROM {table} GROUP BY repo HAVING {c}" for g, n, c in rules
    )


@query("frameworks", f"{STATS} {_frameworks_sql('file_stats')}")
def frameworks(spark, sf):
    return profile.frameworks_from_paths(D.file_stats(spark, sf))


_KNOWN = ", ".join(f"({O.quote(p)}, {O.quote(f)})" for p, f in profile.PACKAGE_FRAMEWORKS)


@query(
    "dependency_frameworks",
    f"WITH {D.DEPENDENCIES_SQL} SELECT DISTINCT repo, name, framework FROM dependencies JOIN (VALUES {_KNOWN}) k(name, framework) USING (name) "
    "WHERE version <> ''",
)
def dependency_frameworks(spark, sf):
    return profile.frameworks_from_dependencies(D.dependencies(spark, sf))


@query(
    "largest_files",
    f"{STATS} SELECT * FROM (SELECT repo, row_number() OVER (PARTITION BY repo ORDER BY size DESC, path) AS rank, path, size FROM file_stats) "
    "WHERE rank <= 10",
)
def largest_files(spark, sf):
    return profile.largest_files(D.file_stats(spark, sf))


_RECENT = f"modified > TIMESTAMP '{D.AS_OF}' - INTERVAL 30 DAYS"


@query(
    "recent_activity",
    f"{STATS} SELECT repo, count(*) FILTER ({_RECENT}) AS recent_files, CAST(count(*) FILTER ({_RECENT}) AS DOUBLE) / count(*) * 100 AS percentage "
    "FROM file_stats GROUP BY repo",
)
def recent_activity(spark, sf):
    return profile.recent_activity(D.file_stats(spark, sf), D.AS_OF)


@query(
    "line_totals",
    f"{FILES} SELECT repo, CAST(sum(len(string_split(content, chr(10)))) AS BIGINT) AS total_lines, "
    "CAST(sum(len(string_split(content, chr(10)))) AS DOUBLE) / count(*) AS average_lines FROM files GROUP BY repo",
)
def line_totals(spark, sf):
    return profile.line_totals(D.files(spark, sf))


def _insights_sql() -> str:
    binary = ", ".join(O.quote(b) for b in profile.BINARY_EXTENSIONS)
    return (
        f"c AS (SELECT repo, count(*) AS files, count(*) FILTER (size > 102400) AS big, count(*) FILTER ({EXT} IN ({binary})) AS bin "
        "FROM file_stats GROUP BY repo), s AS (SELECT repo, string_agg(path, ', ' ORDER BY path) AS paths FROM (SELECT repo, path, "
        "row_number() OVER (PARTITION BY repo ORDER BY path) AS r FROM file_stats WHERE size > 102400) WHERE r <= 3 GROUP BY repo) "
        "SELECT c.repo, 'fileSize' AS type, 'info' AS severity, big || ' large files detected (>100KB). These may need special attention during analysis.' "
        "AS message, paths FROM c JOIN s ON s.repo = c.repo WHERE big > 0 UNION ALL "
        "SELECT repo, 'scale', 'info', 'Large repository: ' || files || ' files. This is a substantial codebase.', NULL FROM c WHERE files > 100 UNION ALL "
        "SELECT repo, 'scale', 'info', 'Small repository: ' || files || ' files. This is a compact codebase.', NULL FROM c WHERE files < 10 UNION ALL "
        "SELECT repo, 'binaryFiles', 'info', bin || ' binary files detected. These will be excluded from text analysis.', NULL FROM c WHERE bin > 0"
    )


@query("insights", f"{STATS}, {_insights_sql()}")
def insights(spark, sf):
    return profile.insights(D.file_stats(spark, sf))


_IS_TEST = "(contains(lower(path), '.test.') OR contains(lower(path), '.spec.'))"


def _types_sql(table: str) -> str:
    parts = [f"count(*) FILTER (NOT {_IS_TEST} AND {EXT} = '.{n}') AS {n}" for n in ("ts", "js", "json", "md")]
    return f"SELECT repo, {', '.join(parts)}, count(*) FILTER ({_IS_TEST}) AS test FROM {table} GROUP BY repo"


@query("file_type_counts", f"{STATS} {_types_sql('file_stats')}")
def file_type_counts(spark, sf):
    return profile.file_type_counts(D.file_stats(spark, sf))


_ENTRY_NAMES = ", ".join(O.quote(n) for n in profile.ENTRY_POINTS)
_CONFIG_NAMES = ", ".join(O.quote(n) for n in profile.CONFIG_NAMES)
STRUCTURE_CTE = (
    f"{MANIFEST_SQL}, {FLAGS_CTE}, types AS ({_types_sql('files')}), "
    f"e0 AS (SELECT repo, path, list_position([{_ENTRY_NAMES}], path) AS p FROM files WHERE path IN ({_ENTRY_NAMES}) "
    "UNION ALL SELECT repo, main, 0 FROM manifests WHERE main <> ''), "
    "e1 AS (SELECT repo, path, min(p) AS p FROM e0 GROUP BY repo, path), "
    "entry AS (SELECT repo, string_agg(path, ', ' ORDER BY p) AS entry_points FROM e1 GROUP BY repo), "
    f"conf AS (SELECT repo, string_agg(path, ', ' ORDER BY list_position([{_CONFIG_NAMES}], path)) AS config_files FROM files "
    f"WHERE path IN ({_CONFIG_NAMES}) GROUP BY repo), "
    f"fw AS (SELECT repo, string_agg(framework, ', ' ORDER BY p) AS frameworks FROM (SELECT repo, framework, list_position("
    f"[{', '.join(O.quote(p) for p, _ in profile.PACKAGE_FRAMEWORKS)}], name) AS p FROM deps JOIN (VALUES {_KNOWN}) k(name, framework) USING (name)) GROUP BY repo), "
    "counts AS (SELECT repo, count(*) AS files FROM files GROUP BY repo), "
    "structure AS (SELECT repo, counts.files, fw.frameworks IS NOT NULL OR has_api_routes AS has_api, has_api_routes, has_auth, "
    "coalesce(fw.frameworks, '') AS frameworks, ts, js, test, json, md, coalesce(entry_points, '') AS entry_points, "
    "coalesce(config_files, '') AS config_files FROM flags JOIN types USING (repo) JOIN counts USING (repo) LEFT JOIN fw USING (repo) LEFT JOIN entry USING (repo) "
    "LEFT JOIN conf USING (repo))"
)


@query("entry_points", f"{FILES}, {STRUCTURE_CTE} SELECT * FROM entry")
def entry_points(spark, sf):
    files = D.files(spark, sf)
    found = profile.entry_points(files, manifests.manifests(files))
    return found.withColumn("entry_points", F.array_join("entry_points", ", "))


@query("config_files", f"{FILES}, {STRUCTURE_CTE} SELECT * FROM conf")
def config_files(spark, sf):
    return profile.config_files(D.files(spark, sf)).withColumn("config_files", F.array_join("config_files", ", "))


def _structure(spark, sf):
    files = D.files(spark, sf)
    return profile.repo_structure(files, manifests.manifests(files))


@query("repo_structure", f"{FILES}, {STRUCTURE_CTE} SELECT * FROM structure")
def repo_structure(spark, sf):
    lists = ["frameworks", "entry_points", "config_files"]
    return _structure(spark, sf).withColumns({c: F.array_join(c, ", ") for c in lists})


@query(
    "suggest_analyses",
    f"{FILES}, {STRUCTURE_CTE} SELECT repo, unnest(list_filter(['code-quality', 'documentation', "
    "CASE WHEN has_api_routes OR contains(frameworks, 'Express') THEN 'api-quality' END, 'security', "
    "CASE WHEN test > 0 OR ts > 0 THEN 'next-task' END], lambda x: x IS NOT NULL)) AS analysis FROM structure",
)
def suggest_analyses(spark, sf):
    return profile.suggest_analyses(_structure(spark, sf))


@query(
    "size_class",
    f"{STATS}, c AS (SELECT repo, count(*) AS files FROM file_stats GROUP BY repo) SELECT repo, files, "
    "CASE WHEN files > 100 THEN 'Large' WHEN files > 50 THEN 'Medium' ELSE 'Small' END AS size, "
    "CASE WHEN files > 100 THEN '5-10 minutes' WHEN files > 50 THEN '2-5 minutes' ELSE '1-2 minutes' END AS estimate, "
    "CASE WHEN files > 100 THEN 'Consider analyzing in phases or focusing on specific areas' ELSE 'Full repository analysis recommended' END AS approach FROM c",
)
def size_class(spark, sf):
    return profile.size_class(D.file_stats(spark, sf))


_DIRS = ["in_test", "in_tests", "in_spec", "in_root_tests", "in_src_tests"]
_NAMES = ["test_js", "test_ts", "spec_js", "spec_ts"]


@query(
    "test_infrastructure",
    f"{FILES}, {MANIFEST_SQL}, c AS (SELECT repo, "
    + ", ".join(f"count(*) FILTER ({O.glob([g])}) AS {n}" for n, g in zip(_NAMES + _DIRS, P.TEST_FILES + P.TEST_DIRS))
    + " FROM files GROUP BY repo), s AS (SELECT repo, test_script IS NOT NULL AND test_script <> '' AND test_script <> "
    + O.quote(metrics.NO_TEST_SCRIPT)
    + " AS has_script, len(list_filter(json_keys(j, '$.scripts'), lambda k: contains(k, 'test') AND k <> 'test')) > 0 AS other "
    "FROM manifests JOIN m USING (repo)), t AS (SELECT repo, coalesce(has_script, false) AS has_test_script, coalesce(other, false) AS has_other_test_scripts, "
    + ", ".join(_NAMES + _DIRS)
    + f", {' + '.join(_NAMES)} AS test_files, {' + '.join(_DIRS)} AS test_dir_files FROM c LEFT JOIN s USING (repo)) "
    "SELECT *, has_test_script OR test_files > 0 OR test_dir_files > 0 AS has_any_tests FROM t",
)
def test_infrastructure(spark, sf):
    files = D.files(spark, sf)
    return metrics.test_infrastructure(files, manifests.manifests(files))


# ---- issue roll-ups and reports -------------------------------------------------------------------------

_PART_LINES = 20  # small, so that the reports of the sample tables have several parts


def _parts_sql(ctes: str, issues: str) -> str:
    """Issues ``i``, their lines in numbered parts of a repository ``k``, and the number of each type ``g``."""
    return (
        f"{ctes}, i AS ({issues}), g AS (SELECT repo, type, count(*) AS issues FROM i GROUP BY repo, type), "
        f"p AS (SELECT *, (row_number() OVER (PARTITION BY repo ORDER BY type, path, rule_id, description) - 1) // {_PART_LINES} AS part FROM i), "
        "k AS (SELECT repo, type, part, list(path || ': ' || description ORDER BY path, rule_id, description) AS lines FROM p GROUP BY repo, type, part)"
    )


@query(
    "smells_by_type",
    f"{FILES}, {_parts_sql(SMELLS_CTE, SMELLS_SQL)} SELECT repo, type, part, issues, array_to_string(lines, chr(10)) AS lines FROM g JOIN k USING (repo, type)",
)
def smells_by_type(spark, sf):
    grouped = rollup.group_issues(detect(D.files(spark, sf), SMELLS), part_lines=_PART_LINES)
    return grouped.withColumn("lines", F.array_join("lines", "\n"))


@query(
    "issue_topk",
    f"{FILES}, {SMELLS_CTE}, i AS ({SMELLS_SQL}) SELECT * FROM (SELECT repo, type, path, n, row_number() OVER (PARTITION BY repo, type "
    "ORDER BY n DESC, path) AS rank FROM i) WHERE rank <= 3",
)
def issue_topk(spark, sf):
    from pyspark.sql import Window

    order = Window.partitionBy("repo", "type").orderBy(F.col("n").desc(), "path")
    issues = detect(D.files(spark, sf), SMELLS).withColumn("rank", F.row_number().over(order))
    return issues.where(F.col("rank") <= 3).select("repo", "type", "path", "n", "rank")


@query(
    "first_files",
    f"{FILES} SELECT repo, path FROM (SELECT repo, path, row_number() OVER (PARTITION BY repo ORDER BY path) AS r FROM files WHERE {CODE}) WHERE r <= 20",
)
def first_files(spark, sf):
    code = D.files(spark, sf).where(P.is_code(F.col("path"))).select("repo", "path")
    return S.cap_per_group(code, 20, ["repo"], ["path"])


def _report_sql(ctes: str, issues: str, agent: str, title: str, section: str) -> str:
    """The reports of one agent, in parts: for each type of issue its number and the lines of the part."""
    return (
        f"{RECURSIVE}, {_parts_sql(ctes, issues)}, "
        "b AS (SELECT repo, part, type, '**' || type || '** (' || issues || ' issues):' || chr(10) || '- ' || array_to_string(lines, chr(10) || '- ') || chr(10) AS body "
        "FROM g JOIN k USING (repo, type)) "
        f"SELECT repo, '{agent}' AS agent, part, '### {title}' || chr(10) || chr(10) || '#### {section}' || chr(10) || chr(10) || "
        "string_agg(body, chr(10) ORDER BY type) || chr(10) || chr(10) AS content FROM b GROUP BY repo, part"
    )


def _report(issues, agent: str, title: str, section: str):
    grouped = rollup.group_issues(issues, part_lines=_PART_LINES)
    return reports.render_reports(reports.issue_sections(grouped, agent, section, 1), title)


@query("quality_reports", _report_sql(SMELLS_CTE, SMELLS_SQL, "code-quality", "Code Quality Analysis", "Code Smells"))
def quality_reports(spark, sf):
    return _report(detect(D.files(spark, sf), SMELLS), "code-quality", "Code Quality Analysis", "Code Smells")


@query(
    "security_reports",
    _report_sql(SECURITY_CTE, f"SELECT * FROM ({SECURITY_SQL}) WHERE polarity = 'issue'", "security", "Security Analysis", "Vulnerabilities"),
)
def security_reports(spark, sf):
    found = detect(D.files(spark, sf), SECURITY).where(F.col("polarity") == "issue")
    return _report(found, "security", "Security Analysis", "Vulnerabilities")


@query("style_reports", _report_sql(STYLE_CTE, STYLE_SQL, "opinionated-style", "Style Analysis", "Style Issues"))
def style_reports(spark, sf):
    return _report(detect(D.files(spark, sf), *STYLE), "opinionated-style", "Style Analysis", "Style Issues")


@query(
    "documentation_reports",
    _report_sql(
        X.SYMBOLS,
        f"SELECT repo, path, 'Undocumented ' || kind AS type, name || ':' || line AS rule_id, description FROM ({X.ISSUE_ROWS})",
        "documentation",
        "Documentation Analysis",
        "Undocumented Symbols",
    ),
)
def documentation_reports(spark, sf):
    bare = documentation.file_doc_issues(spans.file_symbols(D.files(spark, sf)))
    issues = bare.select(
        "repo", "path", F.concat(F.lit("Undocumented "), "kind").alias("type"), F.concat_ws(":", "name", F.col("line").cast("string")).alias("rule_id"), "description"
    )
    return _report(issues, "documentation", "Documentation Analysis", "Undocumented Symbols")


@query(
    "api_reports",
    _report_sql(
        API_CTE, f"SELECT repo, path, description AS type, '' AS rule_id, description FROM ({API_ISSUES_SQL})", "api-quality", "API Quality Analysis", "API Issues"
    ),
)
def api_reports(spark, sf):
    found = api.api_issues(api.api_report(D.files(spark, sf)))
    return _report(
        found.select("repo", "path", F.col("description").alias("type"), F.lit("").alias("rule_id"), "description"), "api-quality", "API Quality Analysis", "API Issues"
    )


@query(
    "issue_union",
    f"{RECURSIVE}, {SMELLS_CTE}, {STYLE_CTE}, {SECURITY_CTE}, {X.SYMBOLS}, {API_CTE}, u AS (SELECT repo, path, type, severity FROM ({SMELLS_SQL}) UNION ALL "
    f"SELECT repo, path, type, severity FROM ({STYLE_SQL}) UNION ALL SELECT repo, path, type, severity FROM ({SECURITY_SQL}) UNION ALL "
    f"SELECT repo, path, 'Undocumented ' || kind, NULL FROM ({X.ISSUE_ROWS}) UNION ALL SELECT repo, path, description, NULL FROM ({API_ISSUES_SQL})) "
    "SELECT repo, type, severity, count(*) AS issues, min(path) AS first_path FROM u GROUP BY repo, type, severity",
)
def issue_union(spark, sf):
    """Issues of rules, of missing documentation and of APIs in one table."""
    files = D.files(spark, sf)
    bare = documentation.file_doc_issues(spans.file_symbols(files)).select("repo", "path", F.concat(F.lit("Undocumented "), "kind").alias("type"))
    calls = api.api_issues(api.api_report(files)).select("repo", "path", F.col("description").alias("type"))
    every = rollup.all_issues(detect(files, SMELLS, *STYLE, SECURITY), bare, calls)
    return every.groupBy("repo", "type", "severity").agg(F.count(F.lit(1)).alias("issues"), F.min("path").alias("first_path"))


_POS = "list_position(['api-quality', 'documentation', 'code-quality', 'security'], agent)"
_SECTION = (
    "CASE WHEN instr(content, '## Analysis Results') = 0 THEN 'No analysis results found' ELSE trim(substr(content, "
    "instr(content, '## Analysis Results') + 19, (CASE WHEN instr(content, '## Coordination') > 0 THEN instr(content, '## Coordination') "
    "ELSE length(content) + 1 END) - instr(content, '## Analysis Results') - 19), ' ' || chr(9) || chr(10) || chr(13)) END"
)
COLLECTED_SQL = (
    f"{D.REPORTS_SQL}, agents(agent) AS (VALUES ('api-quality'), ('documentation'), ('code-quality'), ('security')), "
    "wanted AS (SELECT repo, agent FROM (SELECT DISTINCT repo FROM reports), agents), "
    f"collected AS (SELECT w.repo, w.agent, {_POS.replace('agent)', 'w.agent)')} AS agent_pos, coalesce(length(content) > 0, false) AS has_content, "
    f"CASE WHEN length(content) > 0 THEN {_SECTION} ELSE 'No analysis performed' END AS section FROM wanted w LEFT JOIN reports r "
    "ON r.repo = w.repo AND r.agent = w.agent)"
)
COLLECTED = f"WITH {COLLECTED_SQL}"


@query("collected_reports", f"{COLLECTED} SELECT repo, agent, agent_pos, has_content, section FROM collected")
def collected_reports(spark, sf):
    return rollup.collect_reports(D.reports(spark, sf)).drop("content")


_T = "lower(section)"
_CRIT = [
    ("1", f"contains({_T}, 'critical') OR contains({_T}, '🚨')", "'**' || upper(agent) || '**: Critical issues detected in analysis'"),
    (
        "2",
        f"contains({_T}, 'security') AND (contains({_T}, 'vulnerability') OR contains({_T}, 'injection'))",
        "'**SECURITY**: Potential security vulnerabilities found'",
    ),
    ("3", f"contains({_T}, 'no test') OR (contains({_T}, '❌') AND contains({_T}, 'test'))", "'**QUALITY**: Testing coverage issues identified'"),
    ("4", f"contains({_T}, 'no readme') OR contains({_T}, 'no documentation')", "'**DOCUMENTATION**: Missing critical documentation'"),
]


@query(
    "critical_issues",
    f"{COLLECTED}, f AS ("
    + " UNION ALL ".join(
        f"SELECT repo, agent, agent_pos, {p} AS rule_pos, {m} AS issue FROM collected WHERE has_content AND ({c})" for p, c, m in _CRIT
    )
    + ") SELECT repo, agent, issue, row_number() OVER (PARTITION BY repo ORDER BY agent_pos, rule_pos) AS position FROM f",
)
def critical_issues(spark, sf):
    return rollup.critical_findings(rollup.collect_reports(D.reports(spark, sf)))


_PLAN = [
    (1, "Security", "Address critical security vulnerabilities", f"contains({_T}, 'critical') AND agent = 'security'"),
    (
        2,
        "Quality",
        "Implement basic testing framework and tests",
        f"contains({_T}, 'no test') OR (contains(section, 'test') AND contains(section, '❌'))",
    ),
    (
        3,
        "Documentation",
        "Create essential documentation (README, API docs)",
        f"contains({_T}, 'no readme') OR contains({_T}, 'documentation')",
    ),
    (
        4,
        "Refactoring",
        "Refactor high-complexity code and address code smells",
        f"contains({_T}, 'complexity') OR contains({_T}, 'code smell')",
    ),
]


@query(
    "action_plan",
    f"{COLLECTED}, f AS ("
    + " UNION ALL ".join(
        f"SELECT repo, agent, agent_pos, {p} AS priority, '{c}' AS category, '{a}' AS action FROM collected WHERE has_content AND ({w})"
        for p, c, a, w in _PLAN
    )
    + ") SELECT repo, row_number() OVER (PARTITION BY repo ORDER BY priority, agent_pos) AS position, priority, category, action, agent FROM f",
)
def action_plan(spark, sf):
    return rollup.action_plan(rollup.collect_reports(D.reports(spark, sf)))


@query(
    "recap_reports",
    f"{COLLECTED}, f AS ("
    + " UNION ALL ".join(
        f"SELECT repo, agent, agent_pos, {p} AS priority, '{c}' AS category, '{a}' AS action FROM collected WHERE has_content AND ({w})"
        for p, c, a, w in _PLAN
    )
    + ") SELECT repo, 'recapper' AS agent, 0 AS part, '### Recap' || chr(10) || chr(10) || '#### Action Plan' || chr(10) || chr(10) || "
    "string_agg('- ' || category || ': ' || action || ' (' || agent || ')', chr(10) ORDER BY priority, agent_pos) || chr(10) || chr(10) AS content FROM f GROUP BY repo",
)
def recap_reports(spark, sf):
    plan = rollup.action_plan(rollup.collect_reports(D.reports(spark, sf)))
    line = F.concat(F.lit("- "), "category", F.lit(": "), "action", F.lit(" ("), "agent", F.lit(")"))
    sections = plan.select(
        "repo",
        F.lit("recapper").alias("agent"),
        F.lit(1).alias("position"),
        F.lit("Action Plan").alias("section"),
        F.lpad(F.col("position").cast("string"), 6, "0").alias("item"),
        line.alias("body"),
        F.lit(0).cast("long").alias("part"),
    )
    return reports.render_reports(sections, "Recap")


@query(
    "tool_recommendations",
    f"{COLLECTED} "
    + " UNION ".join(
        f"SELECT repo, '{tool}' AS tool FROM collected WHERE contains(section, '{word}')" for word, tool in rollup.TOOL_KEYWORDS
    ),
)
def tool_recommendations(spark, sf):
    return rollup.tool_recommendations(rollup.collect_reports(D.reports(spark, sf)))


@query("agent_coverage", f"{COLLECTED} SELECT repo, count(*) FILTER (has_content) AS complete, count(*) AS expected FROM collected GROUP BY repo")
def agent_coverage(spark, sf):
    return rollup.agent_coverage(rollup.collect_reports(D.reports(spark, sf)))


@query(
    "reports_context",
    f"{COLLECTED} SELECT repo, string_agg(chr(10) || '### ' || upper(agent) || ' FINDINGS:' || chr(10) || section || chr(10), '' "
    "ORDER BY agent_pos) AS context FROM collected WHERE has_content GROUP BY repo",
)
def reports_context(spark, sf):
    return rollup.reports_context(rollup.collect_reports(D.reports(spark, sf)))


_PATTERN = O.quote(rollup.COMMENT)
COMMENTS_SQL = (
    f"{D.REPORTS_SQL}, bl AS (SELECT repo, agent, regexp_extract_all(content, {_PATTERN}) AS b FROM reports), "
    "blocks AS (SELECT repo, agent, unnest(b) AS block, unnest(range(1, len(b) + 1)) AS comment_no FROM bl), "
    f"comments AS (SELECT repo, agent, comment_no, 'comment-' || CAST(comment_no AS VARCHAR) AS comment_id, "
    f"regexp_extract(block, {_PATTERN}, 1) AS target, regexp_extract(block, {_PATTERN}, 2) AS question, "
    f"regexp_extract(block, {_PATTERN}, 3) AS context, regexp_extract(block, {_PATTERN}, 4) AS status, "
    f"CAST(regexp_extract(block, {_PATTERN}, 5) AS INT) AS round FROM blocks)"
)
COMMENTS = f"WITH {COMMENTS_SQL}"


def _comments(spark, sf):
    return rollup.parse_comments(D.reports(spark, sf))


@query("comments", f"{COMMENTS} SELECT * FROM comments")
def comments(spark, sf):
    return _comments(spark, sf)


@query("pending_questions", f"{COMMENTS} SELECT repo, agent, comment_id, target, question, round FROM comments WHERE status = 'pending'")
def pending_questions(spark, sf):
    return rollup.pending_questions(_comments(spark, sf)).select("repo", "agent", "comment_id", "target", "question", "round")


@query(
    "agent_pairs",
    f"WITH {D.REPORTS_SQL}, a AS (SELECT DISTINCT repo, agent, {_POS} AS p FROM reports) SELECT x.repo, x.agent AS first, y.agent AS second "
    "FROM a x JOIN a y ON x.repo = y.repo AND x.p < y.p",
)
def agent_pairs(spark, sf):
    return rollup.agent_pairs(D.reports(spark, sf))


@query(
    "round_counts",
    f"{COMMENTS}, e AS (SELECT DISTINCT repo, agent, target, round FROM comments) SELECT repo, least(agent, target) AS first, "
    "greatest(agent, target) AS second, count(*) AS exchanges, count(*) >= 3 AS limit_reached FROM e GROUP BY 1, 2, 3",
)
def round_counts(spark, sf):
    return rollup.round_counts(_comments(spark, sf))


@query(
    "resolved_comments",
    f"{COMMENTS} SELECT repo, agent, comment_id, CASE WHEN comment_no % 2 = 1 THEN 'answer to ' || question END AS response, "
    "CASE WHEN comment_no % 2 = 1 THEN 'resolved' ELSE status END AS status FROM comments",
)
def resolved_comments(spark, sf):
    found = _comments(spark, sf)
    responses = found.where(F.col("comment_no") % 2 == 1).select(
        "repo", "agent", "comment_id", F.concat(F.lit("answer to "), "question").alias("response")
    )
    return rollup.resolve_comments(found, responses).select("repo", "agent", "comment_id", "response", "status")


@query(
    "added_comments",
    f"{COMMENTS}, n AS (SELECT repo, agent, 'security' AS target, 'new question' AS question, 'turn' AS context, 1 AS round FROM reports WHERE agent <> 'security'), "
    "b AS (SELECT repo, agent, c.comment_no + CASE WHEN n.target IS NULL THEN 0 ELSE 1 END AS comment_no, c.target, c.question, c.context, c.status, c.round "
    "FROM comments c LEFT JOIN n USING (repo, agent) UNION ALL SELECT repo, agent, 1, target, question, context, 'pending', round FROM n) "
    "SELECT *, 'comment-' || CAST(comment_no AS VARCHAR) AS comment_id FROM b",
)
def added_comments(spark, sf):
    new = (
        D.reports(spark, sf)
        .where(F.col("agent") != "security")
        .select(
            "repo",
            "agent",
            F.lit("security").alias("target"),
            F.lit("new question").alias("question"),
            F.lit("turn").alias("context"),
            F.lit(1).alias("round"),
        )
    )
    return rollup.add_comments(_comments(spark, sf), new)


@query(
    "resolution_rate",
    f"{COMMENTS} SELECT repo, count(*) AS questions, count(*) FILTER (status = 'resolved') AS resolved, "
    "CAST(floor(CAST(count(*) FILTER (status = 'resolved') AS DOUBLE) / count(*) * 100 + 0.5) AS BIGINT) AS rate FROM comments GROUP BY repo",
)
def resolution_rate(spark, sf):
    return rollup.resolution_rate(_comments(spark, sf))


@query(
    "resolved_insights",
    f"{COMMENTS} SELECT repo, {_POS} AS agent_pos, comment_no, agent, target, question FROM comments WHERE status = 'resolved'",
)
def resolved_insights(spark, sf):
    return rollup.resolved_insights(_comments(spark, sf))


@query(
    "first_resolved_insights",
    f"{COMMENTS} SELECT * FROM (SELECT repo, row_number() OVER (PARTITION BY repo ORDER BY {_POS}, comment_no) AS rank, agent, target, question "
    "FROM comments WHERE status = 'resolved') WHERE rank <= 5",
)
def first_resolved_insights(spark, sf):
    return rollup.resolved_insights(_comments(spark, sf), k=5)


_PROMPT_PART = 20_000
_INCLUDED = O.glob(P.DEFAULT_INCLUDES)
_PROMPT_HEADER = " || ".join(
    x
    for text, value in zip(
        rollup.PROMPT_HEADER.split("%s"), ["coalesce(language, 'Node.js')", "name", "files", "coalesce(language, 'JavaScript')", *[f"CASE WHEN {c} THEN 'Yes' ELSE 'No' END" for c in ("ts > 0", "test > 0", "has_api_routes")], "''"]
    )
    for x in (" || chr(10) || ".join(O.quote(line) for line in text.split("\n")), value)
)
_AGENT_NAMES = ", ".join(f"({O.quote(k)}, {O.quote(n)})" for k, n in rollup.PROMPT_AGENTS.items())


@query(
    "prompts",
    f"{FILES}, {FLAGS_CTE}, types AS ({_types_sql('files')}), "
    "f AS (SELECT repo, path, chr(10) || '--- ' || path || ' ---' || chr(10) || coalesce(nullif(content, ''), '[File content provided separately]') || chr(10) AS frame "
    f"FROM files WHERE {_INCLUDED}), "
    "p AS (SELECT *, length(frame) AS n, coalesce(sum(length(frame)) OVER (PARTITION BY repo ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM f), "
    f"x AS (SELECT *, unnest(range(CAST(place // {_PROMPT_PART} AS BIGINT), CAST((place + n - 1) // {_PROMPT_PART} + 1 AS BIGINT))) AS part FROM p), "
    f"b AS (SELECT repo, part, string_agg(substr(frame, CAST(greatest(part * {_PROMPT_PART}, place) - place + 1 AS BIGINT), "
    f"CAST(least((part + 1) * {_PROMPT_PART}, place + n) - greatest(part * {_PROMPT_PART}, place) AS BIGINT)), '' ORDER BY place) AS body FROM x GROUP BY repo, part), "
    f"lang(ext, language) AS (VALUES {_LANGS}), l AS (SELECT repo, language, count(*) AS n FROM f JOIN lang ON {EXT} = ext GROUP BY repo, language), "
    "r AS (SELECT repo, language FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY n DESC, language) AS rank FROM l) WHERE rank = 1), "
    "c AS (SELECT repo, count(*) AS files, max(part) + 1 AS parts FROM (SELECT repo, path, max(part) AS part FROM x GROUP BY repo, path) GROUP BY repo), "
    f"q AS (SELECT repo, agent, part, parts, {_PROMPT_HEADER} || body AS prompt FROM b JOIN c USING (repo) LEFT JOIN r USING (repo) JOIN types USING (repo) "
    f"JOIN flags USING (repo), (VALUES {_AGENT_NAMES}) a(agent, name)) SELECT repo, agent, part, parts, prompt, length(prompt) AS prompt_length FROM q",
)
def prompts(spark, sf):
    files = D.files(spark, sf)
    return rollup.build_prompts(files, _structure(spark, sf), part_chars=_PROMPT_PART)


# ---- settings -------------------------------------------------------------------------------------------

ENTRIES = f"WITH {D.ENTRIES_SQL}"
_SENSITIVE = "(" + " OR ".join(f"contains(upper(key), {O.quote(w)})" for w in V.SENSITIVE_WORDS) + ")"
_PRESENT = "(value <> '')"
_TYPE = (
    "CASE WHEN value = '' THEN 'empty' WHEN regexp_matches(value, '^\\d+$') THEN 'numeric' "
    "WHEN regexp_matches(value, '(?i)^(true|false)$') THEN 'boolean' WHEN regexp_matches(value, '^https?://') THEN 'url' "
    f"WHEN regexp_matches(value, {O.quote(O.re2(V.EMAIL))}) THEN 'email' ELSE 'string' END"
)
_MASKED = (
    "CASE WHEN value = '' THEN '[EMPTY]' WHEN length(value) <= 6 THEN repeat('*', least(length(value), 8)) "
    "ELSE substr(value, 1, 3) || repeat('*', length(value) - 6) || substr(value, length(value) - 2, 3) END"
)


def _entries(spark, sf):
    return governance.last_values(D.config_entries(spark, sf), F.col("pos"))


@query("last_values", f"{ENTRIES} SELECT repo, key, value FROM entries")
def last_values(spark, sf):
    return _entries(spark, sf)


@query(
    "value_checks",
    f"{ENTRIES} SELECT pos, key, {_SENSITIVE} AS sensitive, {_MASKED} AS masked, {_TYPE} AS type FROM raw_entries",
)
def value_checks(spark, sf):
    key, value = F.col("key"), F.col("value")
    return D.config_entries(spark, sf).select(
        "pos", "key", V.is_sensitive_key(key).alias("sensitive"), V.mask_value(value).alias("masked"), V.value_type(value).alias("type")
    )


@query(
    "value_types_by_key",
    f"{ENTRIES} SELECT key, {_TYPE} AS type, count(*) AS entries FROM raw_entries GROUP BY key, type",
)
def value_types_by_key(spark, sf):
    return D.config_entries(spark, sf).groupBy("key", V.value_type(F.col("value")).alias("type")).agg(F.count(F.lit(1)).alias("entries"))


@query(
    "key_metadata",
    f"{ENTRIES} SELECT repo, key, {_PRESENT} AS present, {_SENSITIVE} AS sensitive, length(value) AS length, {_TYPE} AS type FROM entries",
)
def key_metadata(spark, sf):
    return governance.key_metadata(_entries(spark, sf))


_SUMMARY = f"count(*) AS total, count(*) FILTER ({_PRESENT}) AS present, count(*) FILTER (NOT {_PRESENT}) AS missing, count(*) FILTER ({_SENSITIVE}) AS sensitive"


@query("key_summary", f"{ENTRIES} SELECT repo, {_SUMMARY} FROM entries GROUP BY repo")
def key_summary(spark, sf):
    return governance.key_summary(_entries(spark, sf))


@query(
    "default_key_summary",
    f"{ENTRIES} SELECT repo, {_SUMMARY} FROM entries WHERE {_SENSITIVE} OR contains(key, 'API') OR contains(key, 'URL') OR contains(key, 'CONFIG') GROUP BY repo",
)
def default_key_summary(spark, sf):
    return governance.key_summary(_entries(spark, sf), only_summary_keys=True)


@query("redacted_values", f"{ENTRIES} SELECT repo, key, {_PRESENT} AS present, CASE WHEN {_SENSITIVE} THEN '[HIDDEN]' ELSE value END AS shown FROM entries")
def redacted_values(spark, sf):
    return governance.redact_table(_entries(spark, sf))


@query("masked_values", f"{ENTRIES} SELECT repo, key, {_PRESENT} AS present, CASE WHEN {_SENSITIVE} THEN {_MASKED} ELSE value END AS shown FROM entries")
def masked_values(spark, sf):
    return governance.redact_table(_entries(spark, sf), show_masked=True)


_URLISH = "(contains(lower(key), 'url') OR contains(lower(key), 'endpoint'))"
_NO_URL = f"({_URLISH} AND value <> '' AND NOT regexp_matches(value, '^https?://'))"


@query("sanitized_values", f"{ENTRIES} SELECT repo, key, value, {_NO_URL} AS url_problem FROM entries")
def sanitized_values(spark, sf):
    return governance.sanitized(_entries(spark, sf))


REQUIRED = [
    {"key": "API_KEY", "min_length": 3},
    {"key": "SERVICE_URL"},
    {"key": "DB_PASSWORD", "min_length": 6, "max_length": 20},
    {"key": "RETRIES", "required": False, "pattern": r"^\d+\z"},
    {"key": "NOT_THERE"},
]
CHECKS_SQL = (
    "every_repo AS (SELECT repo FROM entries UNION SELECT repo FROM files), "
    "v AS (SELECT repo, max(value) FILTER (key = 'API_KEY') AS a, max(value) FILTER (key = 'SERVICE_URL') AS s, "
    "max(value) FILTER (key = 'DB_PASSWORD') AS d, max(value) FILTER (key = 'RETRIES') AS r FROM every_repo LEFT JOIN entries USING (repo) GROUP BY repo), "
    "checks AS (SELECT repo, 'API_KEY' AS key, CASE WHEN coalesce(a, '') = '' THEN 'missing' WHEN length(a) < 3 THEN 'too short' ELSE 'ok' END AS state FROM v "
    "UNION ALL SELECT repo, 'SERVICE_URL', CASE WHEN coalesce(s, '') = '' THEN 'missing' WHEN NOT regexp_matches(s, '^https?://') THEN 'not a URL' ELSE 'ok' END FROM v "
    "UNION ALL SELECT repo, 'DB_PASSWORD', CASE WHEN coalesce(d, '') = '' THEN 'missing' WHEN length(d) < 6 THEN 'too short' WHEN length(d) > 20 THEN 'too long' ELSE 'ok' END FROM v "
    "UNION ALL SELECT repo, 'RETRIES', CASE WHEN coalesce(r, '') = '' THEN 'ok' WHEN NOT regexp_matches(r, '^\\d+$') THEN 'pattern mismatch' ELSE 'ok' END FROM v "
    "UNION ALL SELECT repo, 'NOT_THERE', 'missing' FROM v)"
)


@query("missing_required_keys", f"{ENTRIES}, {D.FILES_SQL}, {CHECKS_SQL} SELECT * FROM checks")
def missing_required_keys(spark, sf):
    return governance.required_key_check(_entries(spark, sf), governance.rule_rows(spark, REQUIRED), D.repositories(spark, sf))


@query(
    "configuration_validity",
    f"{ENTRIES}, {D.FILES_SQL}, {CHECKS_SQL} SELECT repo, count(*) FILTER (state = 'missing') AS missing, count(*) FILTER (state NOT IN ('missing', 'ok')) AS invalid, "
    "bool_and(state = 'ok') AS valid FROM checks GROUP BY repo",
)
def configuration_validity(spark, sf):
    return governance.configuration_validity(missing_required_keys(spark, sf))
