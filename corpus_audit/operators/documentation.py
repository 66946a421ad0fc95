"""Documentation analytics: README scores, symbol coverage, API documents, undocumented settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpus_audit.functions import paths as P
from corpus_audit.functions.patterns import matches
from corpus_audit.operators.metrics import percentage, total


# --- fixed values: README checks (label, points, pattern) and bands ---------------------------------
README_CHECKS = [
    ("Project title", 1, r"^#\s+"),
    ("Project description", 1, r"(?i)description|about|overview"),
    ("Installation instructions", 2, r"(?i)install|setup|getting started"),
    ("Usage examples", 2, r"(?i)usage|example|how to"),
    ("API documentation", 1, r"(?i)api|endpoint|route"),
    ("Contributing guidelines", 1, r"(?i)contribut|develop|build"),
    ("License information", 1, r"(?i)license|copyright"),
    ("Testing information", 1, r"(?i)test|spec|jest|mocha"),
]
DESCRIPTION_ABOVE = 200
API_MARKS = r"(?i)@swagger|@openapi|@api"
GOOD_SCORE = 0.7
ISSUES_PER_FILE = 5
MAX_GAP = 2
# --- end of fixed values -----------------------------------------------------------------------------


def _readme_check(label: str, pattern: str) -> Column:
    test = F.rlike(F.col("content"), F.lit(r"\A#\s+")) if pattern.startswith("^") else matches(F.col("content"), pattern)
    return (F.length(F.col("content")) > DESCRIPTION_ABOVE) & test if label == "Project description" else test


def readme_score(files: DataFrame) -> DataFrame:
    """Points out of ten, the checks passed and missing, and a band, for each root README."""
    measured = files.where(P.matches_glob(F.col("path"), P.README_FILES)).select(
        "repo", "path", *[_readme_check(l, p).alias(f"_c{i}") for i, (l, _, p) in enumerate(README_CHECKS)]
    )
    flags = [(F.col(f"_c{i}"), label, points) for i, (label, points, _) in enumerate(README_CHECKS)]
    score = sum((F.when(c, points).otherwise(0) for c, _, points in flags), F.lit(0))
    return measured.select(
        "repo",
        "path",
        score.cast("bigint").alias("score"),
        F.array_compact(F.array(*[F.when(c, F.lit(l)) for c, l, _ in flags])).alias("passed"),
        F.array_compact(F.array(*[F.when(~c, F.lit(l)) for c, l, _ in flags])).alias("missing"),
        F.when(score >= 8, "excellent")
        .when(score >= 6, "good")
        .when(score >= 4, "basic")
        .otherwise("poor")
        .alias("band"),
    )


def symbols(per_file: DataFrame) -> DataFrame:
    """One row per symbol of :func:`corpus_audit.operators.spans.file_symbols`."""
    return per_file.select("repo", "path", F.explode("symbols").alias("s")).select("repo", "path", "s.*")


def docblocks(per_file: DataFrame) -> DataFrame:
    return per_file.select("repo", "path", F.explode("docblocks").alias("line"))


def docblock_lines(files: DataFrame) -> DataFrame:
    """First lines of ``/**`` blocks found line by line, without a user function.

    Meant for sources whose blocks start on a line of their own; a line counts once.
    """
    return (
        files.where(P.is_code(F.col("path")))
        .select("repo", "path", F.posexplode(F.split(F.col("content"), "\n")).alias("pos", "text"))
        .where(F.contains("text", F.lit("/**")))
        .select("repo", "path", (F.col("pos") + 1).alias("line"))
    )


def _near(blocks: DataFrame, max_gap: int) -> DataFrame:
    """Every line that a block documents: at most ``2 * max_gap + 1`` rows per block."""
    return blocks.select(
        "repo",
        "path",
        F.explode(F.sequence(F.col("line") - max_gap, F.col("line") + max_gap)).alias("line"),
    )


def documented(found: DataFrame, blocks: DataFrame, max_gap: int = MAX_GAP) -> DataFrame:
    """Symbols with a doc block starting within ``max_gap`` lines.

    The band is spelled out as lines, so this is an equi semi join on (repo, path, line): no pair of a
    symbol and a block is ever formed, however many a file holds.
    """
    return found.join(_near(blocks, max_gap), ["repo", "path", "line"], "left_semi")


def undocumented(found: DataFrame, blocks: DataFrame, max_gap: int = MAX_GAP) -> DataFrame:
    return found.join(_near(blocks, max_gap), ["repo", "path", "line"], "left_anti")


def file_doc_scores(per_file: DataFrame, max_gap: int = MAX_GAP) -> DataFrame:
    """Symbols, documented symbols and their ratio per file.

    Each symbol carries the distance to its nearest block, so nothing is shuffled.
    """
    n = F.size("symbols").cast("bigint")
    done = F.size(F.filter("symbols", lambda s: s["gap"] <= max_gap)).cast("bigint")
    return per_file.select(
        "repo",
        "path",
        n.alias("symbols"),
        done.alias("documented"),
        F.when(n == 0, 1.0).otherwise(done / n).alias("score"),
    )


def file_doc_issues(
    per_file: DataFrame, limit: int | None = None, max_gap: int = MAX_GAP
) -> DataFrame:
    """Undocumented symbols as issues, the first ``limit`` found in each file (None for all).

    Works inside each file's row, so neither a join nor a window is needed.
    """
    bare = F.filter("symbols", lambda s: F.coalesce(s["gap"] > max_gap, F.lit(True)))
    if limit is not None:
        bare = F.slice(bare, 1, limit)
    return (
        per_file.select("repo", "path", F.explode_outer(bare).alias("s"))
        .where(F.col("s.name").isNotNull())
        .select(
            "repo",
            "path",
            "s.name",
            "s.line",
            "s.kind",
            F.format_string("Missing documentation for %s `%s` (line %d)", "s.kind", "s.name", "s.line").alias(
                "description"
            ),
        )
    )


def doc_coverage(scores: DataFrame) -> DataFrame:
    """Share of documented symbols per repository with its band, and files documented well."""
    sums = scores.groupBy("repo").agg(
        F.sum("symbols").alias("symbols"),
        F.sum("documented").alias("documented"),
        F.count_if(F.col("score") > GOOD_SCORE).alias("good_files"),
        F.count(F.lit(1)).alias("files"),
    )
    coverage = F.coalesce(percentage(F.col("documented"), F.col("symbols")), F.lit(0.0))
    return sums.withColumn("coverage", coverage).withColumn(
        "band",
        F.when(F.col("coverage") >= 80, "excellent")
        .when(F.col("coverage") >= 60, "good")
        .when(F.col("coverage") >= 40, "moderate")
        .otherwise("low"),
    )


def api_docs(files: DataFrame) -> DataFrame:
    """API specification files, Postman collections and inline API comments per repository."""
    route = P.is_route(F.col("path"))
    grouped = files.groupBy("repo").agg(
        total(P.matches_glob(F.col("path"), P.API_SPEC_FILES)).alias("spec_files"),
        total(P.matches_glob(F.col("path"), P.POSTMAN_FILES)).alias("postman_files"),
        total(route).alias("route_files"),
        F.coalesce(F.bool_or(F.when(route, matches(F.col("content"), API_MARKS))), F.lit(False)).alias("inline_docs"),
    )
    verdict = (
        F.when(F.col("inline_docs"), "inline documentation")
        .when(F.col("route_files") > 0, "routes without inline documentation")
        .otherwise("no routes")
    )
    return grouped.withColumn("verdict", verdict)


def api_doc_files(files: DataFrame) -> DataFrame:
    """The specification and Postman files themselves."""
    kind = F.when(P.matches_glob(F.col("path"), P.API_SPEC_FILES), "specification").when(
        P.matches_glob(F.col("path"), P.POSTMAN_FILES), "postman"
    )
    return files.select("repo", "path", kind.alias("kind")).where(F.col("kind").isNotNull())


def undocumented_configs(files: DataFrame) -> DataFrame:
    """Settings files of repositories without a document named after configuration or setup."""
    lower = F.lower(F.col("path"))
    about_settings = P.matches_glob(F.col("path"), P.DOC_FILES) & (
        F.contains(lower, F.lit("config")) | F.contains(lower, F.lit("setup"))
    )
    configs = files.where(
        P.matches_glob(F.col("path"), P.CONFIG_FILES) & ~F.contains(F.col("path"), F.lit("node_modules"))
    ).select("repo", "path")
    covered = files.where(about_settings).select("repo").distinct()
    return configs.join(covered, "repo", "left_anti")
