"""Security analytics around the rule families: context, routes, dependencies, secrets, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpus_audit.functions import paths as P
from corpus_audit.functions.patterns import Has, count_matches, matches, matches_any
from corpus_audit.operators import security_rules as R
from corpus_audit.operators.detect import measure, raise_issues
from corpus_audit.operators.metrics import percentage, total
from corpus_audit.operators.numbering import written
from corpus_audit.operators.rules import Family


# --- fixed values: project context, routes, advisories, secrets -------------------------------------
CLI_USE = r"process\.argv|commander|yargs|cli"
WEB_SERVER_USE = r"express\(\)|app\.listen|server\.listen|http\.createServer"
PRODUCTION_USE = r"NODE_ENV.*production|pm2|cluster|load.*balance"
ROUTE_CALLS = [
    r"\.(get|post|put|delete|patch)\s*\(",
    r"router\.(get|post|put|delete|patch)\s*\(",
    r"app\.(get|post|put|delete|patch)\s*\(",
]
VALIDATION_LIBRARIES = r"joi|yup|express-validator|ajv|zod"
VALIDATION_WORDS = r"validate|sanitize|escape"
REQUEST_DATA = r"req\.(body|params|query)"
REQUEST_TO_DATABASE = r"req\.(body|params|query).*\.(find|update|delete|save)"
ADVISORIES = [
    ("lodash", "<4.17.21", "Prototype pollution vulnerabilities in older versions"),
    ("moment", "<2.29.0", "ReDoS vulnerability in older versions"),
    ("request", "*", "Deprecated package with security issues"),
    ("morgan", "<1.10.0", "Log injection vulnerability"),
]
PINNED_OLD = r"^[12]\.\d+\.\d+\z"
SECRET_PATTERNS = [
    (r"""["'`]([A-Za-z0-9+/]{40,}={0,2})["'`]""", "Base64 Token", "High - Potential API key or token"),
    (r"sk_live_[a-zA-Z0-9]{24,}", "Stripe Live Key", "Critical - Live payment processing key"),
    (
        r"""(?i)(?:password|pwd|pass)\s*[:=]\s*["`'][^"`']{8,}["`']""",
        "Hardcoded Password",
        "High - Password in source code",
    ),
    (
        r"""(?i)(?:api[_-]?key|apikey)\s*[:=]\s*["`'][^"`']{10,}["`']""",
        "API Key",
        "High - API key in source code",
    ),
    (
        r"""(?i)(?:secret|token)\s*[:=]\s*["`'][^"`']{16,}["`']""",
        "Secret/Token",
        "High - Secret or token in source code",
    ),
]
SNIPPET_CHARS = 50
SEVERITIES = ["Critical", "High", "Medium", "Low"]
# --- end of fixed values -------------------------------------------------------------------------------


def _context_facts() -> dict[str, Column]:
    """What a file says about its repository, by its path and content."""
    path, content = F.col("path"), F.col("content")
    code = P.is_code(path)

    def entry(name: str):
        value = F.get_json_object(content, f"$.{name}")
        return value.isNotNull() & ~value.isin("", "false", "0")

    return {
        "_cli": P.matches_glob(path, P.CLI_FILES) | (code & matches(content, CLI_USE)),
        "_web": P.matches_glob(path, P.WEB_FILES) | (code & matches(content, WEB_SERVER_USE)),
        "_lib": (path == "package.json") & (entry("main") | entry("exports") | entry("module")),
        "_docker": P.matches_glob(path, P.DOCKERFILES),
        "_production": P.matches_glob(path, P.CODE_AND_JSON) & matches(content, PRODUCTION_USE),
    }


def _context(facts: DataFrame) -> DataFrame:
    """Context of every repository from the facts of its files."""
    known = facts.groupBy("repo").agg(*[F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in _context_facts()])
    kind = (
        F.when(F.col("_cli"), "cli-tool")
        .when(F.col("_web"), "web-service")
        .when(F.col("_lib"), "library")
        .otherwise("unknown")
    )
    deployment = (
        F.when(F.col("_docker"), "containerized").when(F.col("_production"), "production").otherwise("development")
    )
    return known.select("repo", kind.alias("project_type"), deployment.alias("deployment")).select(
        "repo",
        "project_type",
        "deployment",
        (F.col("project_type") == "web-service").alias("user_facing"),
        (F.col("deployment") != "development").alias("is_production"),
    )


def project_context(files: DataFrame) -> DataFrame:
    """Kind of project and deployment of every repository."""
    return _context(files.select("repo", *[c.alias(n) for n, c in _context_facts().items()]))


def issues_in_context(files: DataFrame, *families: Family) -> DataFrame:
    """Issues adjusted to the context of their repository, from one scan of the texts.

    Features and context facts of every file are measured in the same pass and written as narrow rows.  The context, a row
    a repository, is written too, so the optimizer knows its size: up to its limit it goes to the issue rows, beyond it
    both sides are joined by repository.
    """
    measured = written(measure(files, *families, **_context_facts()), "measured")
    context = written(_context(measured), "context")
    return with_context(raise_issues(measured, *families), context)


def with_context(issues: DataFrame, context: DataFrame) -> DataFrame:
    """Adjust severity and advice of security issues to the kind of project.

    The join runs on issue rows, which carry no text, so the corpus itself is never shuffled for it.
    """
    cli = F.coalesce(F.col("project_type") == "cli-tool", F.lit(False))
    service = F.coalesce((F.col("project_type") == "web-service") & F.col("is_production"), F.lit(False))
    secret, env = F.col("type") == "Information Disclosure", F.col("rule_id") == "unchecked-environment"
    joined = issues.join(context.select("repo", "project_type", "is_production"), "repo", "left")
    return joined.select(
        *[
            {
                "severity": F.when(env & cli, "Low").otherwise(F.col("severity")).alias("severity"),
                "description": F.when(env & cli, R.ENV_TEXT_CLI)
                .otherwise(F.col("description"))
                .alias("description"),
                "remediation": F.when(secret & cli, R.SECRET_ADVICE_CLI)
                .when(secret & service, R.SECRET_ADVICE_SERVICE)
                .when(secret, R.SECRET_ADVICE)
                .when(env & cli, R.ENV_ADVICE_CLI)
                .when(env, R.ENV_ADVICE)
                .otherwise(F.col("remediation"))
                .alias("remediation"),
            }.get(name, F.col(name))
            for name in issues.columns
        ]
    )


def route_validation(files: DataFrame) -> DataFrame:
    """Route calls, validated routes and the two input problems of every route file."""
    counts = [count_matches(F.col("content"), p) for p in ROUTE_CALLS]
    measured = files.where(P.is_route(F.col("path"))).select(
        "repo",
        "path",
        *[c.alias(f"_r{i}") for i, c in enumerate(counts)],
        matches(F.col("content"), VALIDATION_LIBRARIES).alias("_library"),
        matches(F.col("content"), VALIDATION_WORDS).alias("_manual"),
        matches(F.col("content"), REQUEST_DATA).alias("_request"),
        matches(F.col("content"), REQUEST_TO_DATABASE).alias("_database"),
    )
    matched = F.col("_r0") + F.col("_r1") + F.col("_r2")
    checked = F.col("_library") | F.col("_manual")
    return measured.select(
        "repo",
        "path",
        F.col("_r0").alias("routes"),
        matched.alias("route_matches"),
        F.when(checked, F.least(matched, F.lit(1).cast("bigint")))
        .otherwise(F.lit(0).cast("bigint"))
        .alias("validated"),
        (F.col("_request") & ~checked).alias("unvalidated_request"),
        F.col("_database").alias("request_to_database"),
    )


def route_issues(validation: DataFrame) -> DataFrame:
    found = F.array_compact(
        F.array(
            F.when(F.col("unvalidated_request"), F.lit("Routes use request data without apparent validation")),
            F.when(F.col("request_to_database"), F.lit("User input passed directly to database operations")),
        )
    )
    return validation.select("repo", "path", F.explode(found).alias("description"))


def validation_coverage(validation: DataFrame) -> DataFrame:
    sums = validation.groupBy("repo").agg(
        F.count(F.lit(1)).alias("route_files"),
        F.sum("route_matches").alias("route_matches"),
        F.sum("validated").alias("validated"),
    )
    coverage = F.coalesce(percentage(F.col("validated"), F.col("route_matches")), F.lit(0.0))
    return sums.withColumn("coverage", coverage).withColumn(
        "band",
        F.when(F.col("coverage") < 50, "low").when(F.col("coverage") < 80, "moderate").otherwise("good"),
    )


def default_advisories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ADVISORIES, "name string, affected string, reason string")


def vulnerable_dependencies(dependencies: DataFrame, advisories: DataFrame | None = None) -> DataFrame:
    """Dependencies named by an advisory; both versions are kept, neither is compared.

    The built-in list has four rows and is broadcast.  For a list of your own the optimizer chooses the
    join from its real size.
    """
    if advisories is None:
        advisories = F.broadcast(default_advisories(dependencies.sparkSession))
    return dependencies.join(advisories, "name").select("repo", "name", "version", "affected", "reason")


def outdated_dependencies(dependencies: DataFrame) -> DataFrame:
    """Dependencies on a 0.x range or pinned to an old major version."""
    version = F.col("version")
    zero = F.contains(version, F.lit("^0.")) | F.contains(version, F.lit("~0."))
    pinned = F.rlike(version, F.lit(PINNED_OLD))
    label = F.concat(F.col("name"), F.lit("@"), version)
    found = F.array_compact(
        F.array(
            F.when(zero, F.struct(F.lit("major-zero").alias("kind"), F.concat(label, F.lit(" (major version 0.x)")).alias("description"))),
            F.when(pinned, F.struct(F.lit("pinned-old").alias("kind"), F.concat(label, F.lit(" (locked to old version)")).alias("description"))),
        )
    )
    return dependencies.select("repo", "name", "version", F.explode(found).alias("f")).select(
        "repo", "name", "version", "f.kind", "f.description"
    )


def _occurrences(content: Column, pattern: str, kind: str, risk: str) -> Column:
    """The matches of a pattern with their places, which follow from the lengths of what is between them."""
    shift = 1 if pattern.startswith("[") else 0  # quotes around the text that is tested

    def placed(found):
        between = F.split(content, pattern)
        sizes = F.zip_with(between, found, lambda a, b: F.struct(F.length(a).alias("gap"), F.coalesce(F.length(b), F.lit(0)).alias("size")))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        walked = F.aggregate(
            sizes, start, lambda w, s: F.struct((w["at"] + s["gap"] + s["size"]).alias("at"), F.concat(w["out"], F.array(w["at"] + s["gap"])).alias("out"))
        )
        inner = lambda m: F.substr(m, F.lit(1 + shift), F.length(m) - 2 * shift)
        rows = F.zip_with(
            found, F.slice(walked["out"], 1, F.size(found)),
            lambda m, at: F.struct(F.lit(kind).alias("type"), inner(m).alias("found"), (at + shift).alias("offset"), F.lit(risk).alias("risk")),
        )
        return F.when(F.size(found) > 0, rows)

    # Matches are bound to a variable, so that the text is searched once, and split only where something was found.
    return F.get(F.transform(F.array(F.regexp_extract_all(content, F.lit(pattern), 0)), placed), 0)


def secrets_in(table: DataFrame, keys: list[str], text: str = "content") -> DataFrame:
    """Every secret-like match in a text column: type, risk, where it starts (from 0), its length and SHA-256, and a snippet
    of at most 50 characters.  Two secrets that begin alike differ in place and hash."""
    every = [F.coalesce(_occurrences(F.col(text), *p), F.array()) for p in SECRET_PATTERNS]
    rows = table.select(*keys, F.explode_outer(F.concat(*every)).alias("s")).where(F.col("s.type").isNotNull())
    snippet = F.concat(
        F.substring("s.found", 1, SNIPPET_CHARS), F.when(F.length("s.found") > SNIPPET_CHARS, "...").otherwise("")
    )
    return rows.select(*keys, "s.type", snippet.alias("snippet"), "s.risk", "s.offset", F.length("s.found").alias("length"), F.sha2("s.found", 256).alias("sha256"))


def find_secrets(files: DataFrame) -> DataFrame:
    return secrets_in(files.where(P.is_secret_candidate(F.col("path"))), ["repo", "path"])


def severity_summary(issues: DataFrame) -> DataFrame:
    """Issues per severity and repository."""
    return (
        issues.where(F.col("polarity") == "issue")
        .groupBy("repo")
        .agg(*[total(F.col("severity") == s).alias(s.lower()) for s in SEVERITIES])
    )


def critical_issues(issues: DataFrame) -> DataFrame:
    return issues.where((F.col("polarity") == "issue") & (F.col("severity") == "Critical"))


def top_high_issues(issues: DataFrame, k: int = 5) -> DataFrame:
    """The first ``k`` high-severity issues of every repository by path."""
    order = Window.partitionBy("repo").orderBy("path", "rule_id")
    return (
        issues.where((F.col("polarity") == "issue") & (F.col("severity") == "High"))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
    )


def positive_summary(issues: DataFrame) -> DataFrame:
    """Positive findings per repository and type, with the first file that shows each."""
    return (
        issues.where(F.col("polarity") == "positive")
        .groupBy("repo", "type")
        .agg(F.count(F.lit(1)).alias("findings"), F.min("path").alias("first_path"))
    )


def env_files(files: DataFrame) -> DataFrame:
    """Environment files at repository roots."""
    return files.where(P.is_root_env(F.col("path"))).select("repo", "path")
