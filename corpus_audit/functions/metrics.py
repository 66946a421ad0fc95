"""Per-file metrics as expressions over the text column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpus_audit.functions.patterns import Count, Derived, braces_assigned, call_heads

# --- fixed values: what is counted ------------------------------------------------------------------
BRANCH_PATTERNS = [
    r"if\s*\(",
    r"else\s+if\s*\(",
    r"while\s*\(",
    r"for\s*\(",
    r"switch\s*\(",
    r"case\s+",
    r"catch\s*\(",
    r"&&",
    r"\|\|",
    r"\?.*:",
]
FUNCTION_PATTERN = r"(function\s+\w+|const\s+\w+\s*=\s*\([^)]*\)\s*=>|\w+\([^)]*\)\s*\{)"
BLOCK_PATTERN = r"\{[^{}]*\}"
TEST_CASES = r"it\(|test\("
TYPE_ANNOTATIONS = r":\s*(string|number|boolean|object|\w+\[\]|\w+<)"
ANY_TYPES = r":\s*any\b"
CONST_PATTERN = r"\bconst\s+"
LET_PATTERN = r"\blet\s+"
VAR_PATTERN = r"\bvar\s+"
DESTRUCTURING = r"\{[^}]*\}\s*="
TEMPLATE_LITERALS = r"`[^`]*`"
ASYNC_AWAIT = r"async\s+function|await\s+"
PROMISE_CHAINS = r"\.then\(|\.catch\("
ARROW_FUNCTIONS = r"=>\s*\{|=>\s*\w"
CLASSIC_FUNCTIONS = r"function\s+\w+"
LONG_BLOCK_LINES = 20
COMPLEX_ABOVE = 10
LONG_AVERAGE_ABOVE = 30
TRIMMED = " \t\n\r\x0b\x0c"
# --- end of fixed values ---------------------------------------------------------------------------

# The same matches, written so that each line and each pair of parentheses is walked once: a call head is found by
# the last character before its parenthesis.
_TERNARY_BY_LINE = r"(?<![^\n\r\x{2028}\x{2029}])(?>[^\n\r\x{2028}\x{2029}]*?\?)[^\n\r\x{2028}\x{2029}]*:"
_NAMED, _ARROW, _CALL = r"function\s+\w++", r"const\s+\w++\s*+=\s*+\(", r"\w\("

BRANCHES = [Count(p, _TERNARY_BY_LINE if p == r"\?.*:" else None) for p in BRANCH_PATTERNS]
FUNCTIONS = Count(FUNCTION_PATTERN, build=lambda text: call_heads(text, _NAMED, _ARROW, _CALL))


def line_count(text: Column) -> Column:
    """Pieces between newlines, a trailing empty one included."""
    without = F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
    return (F.octet_length(text) - without + 1).cast("bigint")


def lines_longer_than(limit: int) -> Derived:
    return Derived(
        lambda text: F.size(F.filter(F.split(text, "\n"), lambda l: F.length(l) > limit)).cast("bigint"),
        f"len(list_filter(string_split({{text}}, chr(10)), lambda l: length(l) > {limit}))",
    )


def _repeats(items: Column) -> Column:
    return (F.size(items) - F.size(F.array_distinct(items))).cast("bigint")


REPEATED_LINES = Derived(
    # A line is long after trimming if something is left behind 30 characters; trimming at the right walks whole lines.
    lambda text: F.aggregate(
        F.array(F.filter(F.split(text, "\n"), lambda l: F.ltrim(F.substr(F.ltrim(l, F.lit(TRIMMED)), F.lit(31)), F.lit(TRIMMED)) != "")),
        F.lit(0).cast("bigint"),
        lambda acc, kept: acc + _repeats(kept),
    ),
    "(SELECT len(k) - len(list_distinct(k)) FROM (SELECT list_filter(string_split({text}, chr(10)), "
    "lambda l: length(trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) > 30) AS k))",
)

DUPLICATE_STRINGS_PATTERN = r"\"[^\"]{10,}\"|'[^']{10,}'"
_STRINGS_BY_QUOTE = r"""["'](?:(?<=")[^"]{10,}"|(?<=')[^']{10,}')"""  # DUPLICATE_STRINGS_PATTERN, searched by its quotes
REPEATED_STRINGS = Derived(
    lambda text: F.aggregate(
        F.array(F.regexp_extract_all(text, F.lit(_STRINGS_BY_QUOTE), 0)),
        F.lit(0).cast("bigint"),
        lambda acc, found: acc + _repeats(found),
    ),
    "(SELECT len(k) - len(list_distinct(k)) FROM (SELECT regexp_extract_all({text}, "
    "'\"[^\"]{{10,}}\"|''[^'']{{10,}}''') AS k))",
)


def complexity(text: Column) -> Column:
    """One plus the number of branching tokens."""
    total = F.lit(1).cast("bigint")
    for feature in BRANCHES:
        total = total + feature.column(text)
    return total


def block_lines(text: Column) -> Column:
    """Line counts of the innermost brace blocks."""
    return F.transform(
        F.regexp_extract_all(text, F.lit(r"\{[^{}]*+\}"), 0),
        lambda b: F.octet_length(b) - F.octet_length(F.replace(b, F.lit("\n"), F.lit(""))) + 1,
    )


def average_block_length(lengths: Column) -> Column:
    """Mean rounded half up; 0 without blocks."""
    total = F.aggregate(lengths, F.lit(0).cast("bigint"), lambda acc, n: acc + n)
    n = F.size(lengths)
    return F.when(n == 0, F.lit(0).cast("bigint")).otherwise(F.floor(total / n + 0.5).cast("bigint"))


def long_blocks(lengths: Column) -> Column:
    return F.size(F.filter(lengths, lambda n: n > LONG_BLOCK_LINES)).cast("bigint")


SYNTAX = {
    "const_decls": Count(CONST_PATTERN),
    "let_decls": Count(LET_PATTERN),
    "var_decls": Count(VAR_PATTERN),
    "destructuring": Count(DESTRUCTURING, build=braces_assigned),
    "template_literals": Count(TEMPLATE_LITERALS),
    "async_await": Count(ASYNC_AWAIT),
    "promise_chains": Count(PROMISE_CHAINS),
    "arrow_functions": Count(ARROW_FUNCTIONS),
    "classic_functions": Count(CLASSIC_FUNCTIONS),
}
