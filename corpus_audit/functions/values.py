"""Checks and masking for setting keys and values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: sensitive words, value formats ----------------------------------------------------
SENSITIVE_WORDS = [
    "API_KEY",
    "SECRET",
    "PASSWORD",
    "TOKEN",
    "PRIVATE_KEY",
    "CLIENT_SECRET",
    "AUTH",
    "CREDENTIAL",
    "PASS",
    "PWD",
]
SUMMARY_WORDS = ["API", "URL", "CONFIG"]
NUMERIC = r"^\d+\z"
BOOLEAN = r"(?i)^(true|false)\z"
URL = r"^https?://"
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\z"
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
HIDDEN, EMPTY = "[HIDDEN]", "[EMPTY]"
VISIBLE, MAX_STARS = 3, 8
# --- end of fixed values -----------------------------------------------------------------------------

_BLANKS = " \t\r\n\x0b\x0c"


def _holds_any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for word in words:
        out = out | F.contains(text, F.lit(word))
    return F.coalesce(out, F.lit(False))


def is_sensitive_key(key: Column) -> Column:
    return _holds_any(F.upper(key), SENSITIVE_WORDS)


def is_summary_key(key: Column) -> Column:
    """Keys shown in a summary by default."""
    return is_sensitive_key(key) | _holds_any(key, SUMMARY_WORDS)


def mask_value(value: Column, start: int = VISIBLE, end: int = VISIBLE, char: str = "*") -> Column:
    """Keep the first and last characters; short values become stars only."""
    n = F.length(value)
    short = F.repeat(F.lit(char), F.least(n, F.lit(MAX_STARS)))
    long = F.concat(
        F.substr(value, F.lit(1), F.lit(start)),
        F.repeat(F.lit(char), n - start - end),
        F.substr(value, n - end + 1, F.lit(end)),
    )
    return (
        F.when(value.isNull() | (value == ""), EMPTY).when(n <= start + end, short).otherwise(long)
    )


def value_type(value: Column) -> Column:
    return (
        F.when(value.isNull() | (value == ""), "empty")
        .when(F.rlike(value, F.lit(NUMERIC)), "numeric")
        .when(F.rlike(value, F.lit(BOOLEAN)), "boolean")
        .when(F.rlike(value, F.lit(URL)), "url")
        .when(F.rlike(value, F.lit(EMAIL)), "email")
        .otherwise("string")
    )


def clean_value(value: Column) -> Column:
    """Trimmed text without control characters; NULL becomes empty."""
    trimmed = F.btrim(F.coalesce(value, F.lit("")), F.lit(_BLANKS))
    return F.regexp_replace(trimmed, CONTROL, "")


def must_be_url(key: Column) -> Column:
    lower = F.lower(key)
    return F.contains(lower, F.lit("url")) | F.contains(lower, F.lit("endpoint"))


def is_url(value: Column) -> Column:
    """True for an absolute URL: a scheme, and for web schemes a host that parses."""
    scheme = F.rlike(value, F.lit(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"))
    web = F.rlike(value, F.lit(r"(?i)^(https?|wss?|ftp):"))
    host = F.try_parse_url(value, F.lit("HOST"))
    return F.coalesce(F.when(web, host.isNotNull()).otherwise(scheme), F.lit(False))


def url_problem(key: Column, value: Column) -> Column:
    """True when a URL-named key holds something else."""
    cleaned = clean_value(value)
    return must_be_url(key) & (cleaned != "") & ~is_url(cleaned)


def sanitize(key: Column, value: Column) -> Column:
    """Cleaned value; a URL-named key that holds no URL keeps what it had."""
    return F.when(url_problem(key, value), value).otherwise(clean_value(value))


def redact(key: Column, value: Column, show_masked: bool = False) -> Column:
    hidden = mask_value(value) if show_masked else F.lit(HIDDEN)
    return F.when(is_sensitive_key(key), hidden).otherwise(value)
