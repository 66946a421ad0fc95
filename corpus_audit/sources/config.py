"""``KEY=value`` settings text as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_audit.functions.values import sanitize

# --- fixed values: entry format ----------------------------------------------------------------------
ENTRY = r"^([A-Za-z_][A-Za-z0-9_]*)\s*=\s*([^\n]*)\z"
# --- end of fixed values -----------------------------------------------------------------------------

_BLANKS = " \t\r\n\x0b\x0c"


def config_lines(files: DataFrame) -> DataFrame:
    """Every entry line: text up to the first ``#``, key, value without matching quotes."""
    lines = files.select(
        "repo",
        "path",
        F.posexplode(F.split("content", "\n")).alias("pos", "raw"),
    ).select(
        "repo", "path", "pos", F.btrim(F.substring_index("raw", "#", 1), F.lit(_BLANKS)).alias("line")
    )
    value = F.btrim(F.regexp_extract("line", ENTRY, 2), F.lit(_BLANKS))
    quoted = (F.startswith(value, F.lit('"')) & F.endswith(value, F.lit('"'))) | (
        F.startswith(value, F.lit("'")) & F.endswith(value, F.lit("'"))
    )
    bare = F.when(quoted & (F.length(value) < 2), "").when(
        quoted, F.substr(value, F.lit(2), F.length(value) - 2)
    ).otherwise(value)
    return lines.where(F.rlike("line", F.lit(ENTRY))).select(
        "repo",
        "path",
        "pos",
        F.regexp_extract("line", ENTRY, 1).alias("key"),
        sanitize(F.regexp_extract("line", ENTRY, 1), bare).alias("value"),
    )


def config_entries(files: DataFrame) -> DataFrame:
    """Entries of every settings file; the last of several entries for a key wins."""
    return (
        config_lines(files)
        .groupBy("repo", "path", "key")
        .agg(F.max_by("value", "pos").alias("value"))
    )
