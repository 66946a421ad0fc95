"""Predicates and scalar expressions over a repository-relative path."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: glob patterns that select files -------------------------------------------------
DEFAULT_INCLUDES = [
    "**/*.js",
    "**/*.ts",
    "**/*.jsx",
    "**/*.tsx",
    "**/*.json",
    "**/*.md",
    "**/package.json",
    "**/tsconfig.json",
    "**/*.config.js",
    "**/*.config.ts",
]
CODE = ["**/*.{js,ts}"]
CODE_AND_JSON = ["**/*.{js,ts,json}"]
TEST_FILES = ["**/*.test.js", "**/*.test.ts", "**/*.spec.js", "**/*.spec.ts"]
TEST_DIRS = ["test/**", "tests/**", "spec/**", "__tests__/**", "src/**/__tests__/**"]
AUTH_FILES = ["**/*{auth,login,session}*.{js,ts}"]
MIDDLEWARE_FILES = ["**/*middleware*.{js,ts}"]
ROUTE_FILES = ["**/*{route,api,controller}*.{js,ts}"]
API_FILES = [
    "**/*route*.js",
    "**/*route*.ts",
    "**/*api*.js",
    "**/*api*.ts",
    "**/*controller*.js",
    "**/*controller*.ts",
    "**/app.js",
    "**/app.ts",
    "**/server.js",
    "**/server.ts",
]
MANIFESTS = ["**/package.json"]
DOCKERFILES = ["**/Dockerfile"]
SERVER_FILES = ["**/*{server,app,index}.{js,ts}"]
CLI_FILES = ["**/cli.{js,ts}"]
WEB_FILES = ["**/*{express,koa,fastify}*.{js,ts}"]
SECRET_FILES = ["**/*.{js,ts,json,env*,config*}"]
ENV_FILES = [".env*"]
README_FILES = ["README*"]
API_SPEC_FILES = ["**/{swagger,openapi}*.{json,yaml,yml}"]
POSTMAN_FILES = ["**/*postman*.json"]
CONFIG_FILES = ["**/*.{json,yaml,yml,env*,config*}"]
DOC_FILES = ["**/{docs,doc}/**/*.md"]
TSCONFIG_FILES = ["tsconfig*.json"]
BUILD_DIRS = ["node_modules", "dist/", "build/"]
TEST_MARKS = [".test.", ".spec."]
# --- end of fixed values ---------------------------------------------------------------------------


def _expand_braces(glob: str) -> list[str]:
    m = re.search(r"\{([^{}]*)\}", glob)
    if not m:
        return [glob]
    return [
        e for option in m.group(1).split(",") for e in _expand_braces(glob[: m.start()] + option + glob[m.end() :])
    ]


def _segment_regex(segment: str) -> str:
    """One path segment; a wildcard at its start does not reach dot files."""
    out = ""
    for i, ch in enumerate(segment):
        if ch == "*":
            if i > 0:
                out += "[^/]*"
            elif segment[1:2] in ("", "."):
                out += "[^/.][^/]*"
            else:
                out += "(?:[^/.][^/]*)?"
        elif ch == "?":
            out += "[^/]" if i else "[^/.]"
        else:
            out += re.escape(ch)
    return out


def glob_regex(glob: str) -> str:
    """Whole-path regex for a shell glob (``**`` spans directories, dot files need a literal dot)."""
    alternatives = []
    for simple in _expand_braces(glob):
        segments = simple.split("/")
        out = ""
        for i, segment in enumerate(segments):
            last = i == len(segments) - 1
            if segment == "**":
                out += r"(?:[^/.][^/]*/)*[^/.][^/]*" if last else r"(?:[^/.][^/]*/)*"
            else:
                out += _segment_regex(segment) + ("" if last else "/")
        alternatives.append(out)
    return "^(?:" + "|".join(alternatives) + r")\z"


def matches_glob(path: Column, globs: list[str]) -> Column:
    """True when ``path`` matches one of ``globs`` (one compiled expression, no join).

    Globs that all start with plain text also give a prefix test, which the scan can use to skip row groups.
    """
    test = F.rlike(path, F.lit("|".join(glob_regex(g) for g in globs)))
    starts = list(dict.fromkeys(re.split(r"[*?{]", g, maxsplit=1)[0] for g in globs))
    if not all(starts):
        return test
    return reduce(lambda a, b: a | b, [F.startswith(path, F.lit(s)) for s in starts]) & test


def _contains_any(path: Column, parts: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(path, F.lit(p)) for p in parts])


def is_code(path: Column) -> Column:
    return matches_glob(path, CODE)


def is_source(path: Column) -> Column:
    """JavaScript or TypeScript outside dependency, build and test files."""
    return matches_glob(path, CODE) & ~_contains_any(path, BUILD_DIRS + TEST_MARKS)


def is_style_source(path: Column) -> Column:
    return is_source(path) & ~F.contains(path, F.lit(".min."))


def is_test_file(path: Column) -> Column:
    return matches_glob(path, TEST_FILES)


def in_test_dir(path: Column) -> Column:
    return matches_glob(path, TEST_DIRS)


def is_auth(path: Column) -> Column:
    return matches_glob(path, AUTH_FILES)


def is_middleware(path: Column) -> Column:
    return matches_glob(path, MIDDLEWARE_FILES)


def is_route(path: Column) -> Column:
    return matches_glob(path, ROUTE_FILES)


def is_api_candidate(path: Column) -> Column:
    return matches_glob(path, API_FILES)


def is_secret_candidate(path: Column) -> Column:
    return matches_glob(path, SECRET_FILES) & ~F.contains(path, F.lit("node_modules"))


def is_root_env(path: Column) -> Column:
    return matches_glob(path, ENV_FILES)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/?\z", 1)


def extension(path: Column) -> Column:
    """Lower-cased last suffix; empty for dot files and names without a dot."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]*)\z", 1))


# --- fixed values: size classes in bytes ------------------------------------------------------------
SMALL_BYTES = 10 * 1024
MEDIUM_BYTES = 50 * 1024
LARGE_BYTES = 100 * 1024
TEXT_BYTES = 500 * 1024
# --- end of fixed values ---------------------------------------------------------------------------


def size_category(size: Column) -> Column:
    return (
        F.when(size <= SMALL_BYTES, "small")
        .when(size <= MEDIUM_BYTES, "medium")
        .when(size <= LARGE_BYTES, "large")
        .otherwise("huge")
    )


def is_large(size: Column) -> Column:
    return size > LARGE_BYTES


def human_bytes(size: Column) -> Column:
    """``1.5 KB`` style text with at most one decimal."""
    step = (
        F.when(size < 1024, F.lit(0))
        .when(size < 1024**2, F.lit(1))
        .when(size < 1024**3, F.lit(2))
        .otherwise(F.lit(3))
    )
    unit = F.element_at(F.array(*[F.lit(u) for u in ("B", "KB", "MB", "GB")]), step + 1)
    value = F.round(size.cast("double") / F.pow(F.lit(1024.0), step), 1)
    text = F.when(value == F.floor(value), value.cast("bigint").cast("string")).otherwise(
        value.cast("decimal(20,1)").cast("string")
    )
    return F.concat_ws(" ", text, unit)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often ``use`` mentions it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def normalize_path(path: Column) -> Column:
    """Trim, use ``/``, collapse repeated ``/``, drop a trailing one, then undo URL encoding."""
    clean = F.regexp_replace(F.regexp_replace(F.btrim(path, F.lit(" \t\r\n")), r"\\", "/"), "/+", "/")

    def decode(body: Column) -> Column:
        def chosen(decoded: Column) -> Column:
            # Bytes that are no UTF-8 leave the path as it was.
            broken = F.contains(decoded, F.lit("\ufffd")) & ~F.contains(body, F.lit("\ufffd"))
            return F.when(decoded.isNotNull() & ~broken, decoded).otherwise(body)

        decoded = F.try_url_decode(F.replace(body, F.lit("+"), F.lit("%2B")))
        return F.when(F.contains(body, F.lit("%")), _bound(decoded, chosen)).otherwise(body)

    return _bound(_bound(clean, lambda c: F.when(c == "/", c).otherwise(F.rtrim(c, F.lit("/")))), decode)


# --- fixed values: path audit ------------------------------------------------------------------------
MAX_PATH = 260
DANGEROUS_COMPONENTS = ["..", "~", "%2e%2e", "%2e", "%2f", "%5c"]
RESTRICTED_FOR_OUTPUT = [
    "/etc",
    "/bin",
    "/usr",
    "/var",
    "/tmp",
    "/root",
    "/home",
    "c:\\windows",
    "c:\\program files",
    "c:\\users",
]
SENSITIVE_NAMES = ["password", "secret", "key", "token", "credential", ".env", ".ssh", ".git", "node_modules"]
CONTROL_CHARACTERS = r"[\x00-\x1F\x7F]"
TEMPLATES = r"\$\{.*\}|%\{.*\}"
PLAIN_NAME = r"^[a-zA-Z0-9._-]+\z"
# --- end of fixed values ---------------------------------------------------------------------------


def path_violations(path: Column, restricted: list[str] = RESTRICTED_FOR_OUTPUT) -> Column:
    """Ordered array with the name of every path check that fails."""

    def failed(norm: Column) -> Column:
        name = basename(norm)
        components = F.filter(F.split(norm, "/"), lambda c: F.lower(c).isin(DANGEROUS_COMPONENTS))
        prefix = reduce(lambda a, b: a | b, [F.startswith(F.lower(norm), F.lit(p)) for p in restricted])
        checks = [
            ("control_characters", F.rlike(F.btrim(path, F.lit(" \t\r\n")), F.lit(CONTROL_CHARACTERS))),
            ("traversal", F.contains(norm, F.lit(".."))),
            ("restricted_directory", F.startswith(norm, F.lit("/")) & prefix),
            ("dangerous_component", F.size(components) > 0),
            ("too_long", F.length(norm) > MAX_PATH),
            ("template", F.rlike(norm, F.lit(TEMPLATES))),
            ("sensitive_name", _bound(F.lower(name), lambda n: _contains_any(n, SENSITIVE_NAMES))),
            ("unusual_characters", ~F.rlike(name, F.lit(PLAIN_NAME))),
        ]
        return F.array_compact(F.array(*[F.when(test, F.lit(label)) for label, test in checks]))

    return _bound(normalize_path(path), failed)
