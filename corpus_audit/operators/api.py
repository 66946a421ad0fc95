"""API-quality analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpus_audit.functions import paths as P
from corpus_audit.functions.patterns import matches_any
from corpus_audit.operators.metrics import total


# --- fixed values: API patterns -----------------------------------------------------------------------
API_PATTERNS = [
    r"app\.(get|post|put|patch|delete|use)\s*\(",
    r"router\.(get|post|put|patch|delete|use)\s*\(",
    r"express\(\)",
    r"app\.listen",
    r"res\.(json|send|status)",
    r"req\.(body|params|query)",
    r"(?i)middleware",
    r"(?i)route",
    r"(?i)endpoint",
    r"(?i)api",
    r"(?i)server",
]
ERROR_HANDLING = [
    r"try\s*\{[\s\S]*?catch",
    r"\.catch\s*\(",
    r"throw\s+new\s+Error",
    r"res\.status\(\d+\)\.json\(",
    r"(?i)next\([^)]*error",
    r"error\s*=>",
    r"catch\s*\(",
    r"express-async-errors",
    r"async.*catch",
]
INPUT_VALIDATION = [
    r"joi\.",
    r"yup\.",
    r"express-validator",
    r"validate\(",
    r"validator\.",
    r"req\.body\..*validate",
    r"req\.params\..*validate",
    r"req\.query\..*validate",
    r"check\(['\"]",
    r"body\(['\"]",
    r"param\(['\"]",
    r"query\(['\"]",
    r"validationResult",
    r"typeof.*===.*['\"]string['\"]",
    r"isNaN\(",
    r"parseInt\(",
    r"parseFloat\(",
]
AUTHENTICATION = [
    r"passport\.",
    r"jwt\.sign",
    r"jwt\.verify",
    r"bcrypt\.",
    r"req\.user",
    r"req\.session",
    r"(?i)authorization",
    r"authenticate",
    r"(?i)middleware.*auth",
    r"isAuthenticated",
    r"requireAuth",
    r"verifyToken",
    r"(?i)Bearer\s+token",
    r"req\.headers\.authorization",
    r"cookie-parser",
    r"express-session",
]
ROUTE_PATTERNS = [
    r"app\.(get|post|put|delete|patch)",
    r"router\.(get|post|put|delete|patch)",
    r"fastify\.(get|post|put|delete|patch)",
    r"\.route\(",
    r"@(Get|Post|Put|Delete|Patch)\(",
    r"express\(\)",
    r"createServer",
]
AUTH_WORDS = [
    r"(?i)passport",
    r"(?i)jwt",
    r"(?i)authenticate",
    r"(?i)authorization",
    r"(?i)bearer",
    r"(?i)oauth",
    r"(?i)auth.*middleware",
    r"req\.user",
    r"(?i)token.*verify",
    r"(?i)login",
    r"(?i)logout",
]
# --- end of fixed values -------------------------------------------------------------------------------


def is_api_file(text):
    return matches_any(text, API_PATTERNS)


def has_error_handling(text):
    return matches_any(text, ERROR_HANDLING)


def has_input_validation(text):
    return matches_any(text, INPUT_VALIDATION)


def has_auth(text):
    return matches_any(text, AUTHENTICATION)


def api_report(files: DataFrame) -> DataFrame:
    """Error handling, validation and authentication flags of every API file."""
    candidates = files.where(P.is_api_candidate(F.col("path"))).select(
        "repo",
        "path",
        is_api_file(F.col("content")).alias("_api"),
        has_error_handling(F.col("content")).alias("error_handling"),
        has_input_validation(F.col("content")).alias("input_validation"),
        has_auth(F.col("content")).alias("authentication"),
    )
    return candidates.where("_api").drop("_api")


def api_issues(report: DataFrame) -> DataFrame:
    """One row per flag an API file lacks."""
    gaps = F.array_compact(
        F.array(
            F.when(~F.col("error_handling"), F.lit("Missing error handling")),
            F.when(~F.col("input_validation"), F.lit("Missing input validation")),
            F.when(~F.col("authentication"), F.lit("Missing authentication patterns")),
        )
    )
    return report.select("repo", "path", F.explode(gaps).alias("description"))


def api_overview(report: DataFrame) -> DataFrame:
    return report.groupBy("repo").agg(
        F.count(F.lit(1)).alias("api_files"),
        total(F.col("error_handling")).alias("with_error_handling"),
        total(F.col("input_validation")).alias("with_input_validation"),
        total(F.col("authentication")).alias("with_authentication"),
    )


def api_flag_columns() -> list[Column]:
    """Aggregates: does any code file hold API routes, does any hold authentication words."""
    code, content = P.is_code(F.col("path")), F.col("content")
    return [
        F.coalesce(F.bool_or(F.when(code, matches_any(content, patterns))), F.lit(False)).alias(name)
        for name, patterns in (("has_api_routes", ROUTE_PATTERNS), ("has_auth", AUTH_WORDS))
    ]


def repo_api_flags(files: DataFrame) -> DataFrame:
    return files.groupBy("repo").agg(*api_flag_columns())
