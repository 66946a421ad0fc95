"""Per-file metrics and their per-repository aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpus_audit.functions import metrics as M
from corpus_audit.functions import paths as P
from corpus_audit.functions.patterns import Count



def percentage(part: Column, whole: Column) -> Column:
    """Share in percent to one decimal; NULL when there is nothing to share."""
    return F.round(F.try_divide(part.cast("double"), whole.cast("double")) * 100, 1)


def total(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0)).cast("bigint")


def computed_once(table: DataFrame, *columns: Column | str) -> DataFrame:
    """``table.select(*columns)`` whose values later filters reuse.

    A filter on an ordinary computed column is pushed below the projection, and its expression runs twice.
    Costly text expressions are therefore handed on as a one-element array, below which no filter moves.
    """
    named = [F.col(c) if isinstance(c, str) else c for c in columns]
    return table.select(F.inline(F.array(F.struct(*named))))


def file_metrics(files: DataFrame) -> DataFrame:
    """Lines, complexity, functions and block lengths of every source file."""
    measured = files.where(P.is_source(F.col("path"))).select(
        "repo",
        "path",
        M.line_count(F.col("content")).alias("lines"),
        M.complexity(F.col("content")).alias("complexity"),
        M.FUNCTIONS.column(F.col("content")).alias("functions"),
        M.block_lines(F.col("content")).alias("_blocks"),
    )
    return computed_once(
        measured,
        "repo",
        "path",
        "lines",
        "complexity",
        "functions",
        M.average_block_length(F.col("_blocks")).alias("avg_block_length"),
        M.long_blocks(F.col("_blocks")).alias("long_blocks"),
    )


def complex_files(metrics: DataFrame) -> DataFrame:
    return metrics.where(
        (F.col("complexity") > M.COMPLEX_ABOVE) | (F.col("avg_block_length") > M.LONG_AVERAGE_ABOVE)
    )


def complexity_overview(metrics: DataFrame) -> DataFrame:
    """Files, lines, mean lines (rounded half up) and complexity extremes per repository."""
    return metrics.groupBy("repo").agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("lines").alias("total_lines"),
        F.floor(F.try_divide(F.sum("lines").cast("double"), F.count(F.lit(1))) + 0.5)
        .cast("bigint")
        .alias("avg_lines"),
        F.sum("complexity").alias("total_complexity"),
        F.max("complexity").alias("max_complexity"),
    )


def typescript_adoption(files: DataFrame) -> DataFrame:
    """TypeScript and JavaScript source counts, share and configuration presence per repository."""
    source = P.is_source(F.col("path"))
    ts, js = source & F.endswith(F.col("path"), F.lit(".ts")), source & F.endswith(F.col("path"), F.lit(".js"))
    counts = files.groupBy("repo").agg(
        total(source).alias("sources"),
        total(ts).alias("ts_files"),
        total(js).alias("js_files"),
        F.bool_or(P.matches_glob(F.col("path"), P.TSCONFIG_FILES)).alias("has_tsconfig"),
    )
    return counts.withColumn("ts_percentage", percentage(F.col("ts_files"), F.col("sources")))


def type_annotation_usage(files: DataFrame) -> DataFrame:
    """Type annotations and uses of ``any`` in TypeScript sources per repository."""
    return (
        files.where(P.is_source(F.col("path")) & F.endswith(F.col("path"), F.lit(".ts")))
        .groupBy("repo")
        .agg(
            F.count(F.lit(1)).alias("ts_files"),
            F.sum(Count(M.TYPE_ANNOTATIONS).column(F.col("content"))).alias("annotations"),
            F.sum(Count(M.ANY_TYPES).column(F.col("content"))).alias("any_types"),
        )
    )


# --- fixed values: test framework words and bands ----------------------------------------------------
JEST_WORDS = ["jest", "describe", "it("]
ASSERT_WORD = "assert"
JEST_LABEL, ASSERT_LABEL = "Jest/Mocha", "Node Assert"
NO_TEST_SCRIPT = 'echo "Error: no test specified" && exit 1'
# --- end of fixed values -----------------------------------------------------------------------------


def test_inventory(files: DataFrame) -> DataFrame:
    """Test files, test cases and the test frameworks their words point to, per repository."""
    jest = F.lit(False)
    for word in JEST_WORDS:
        jest = jest | F.contains(F.col("content"), F.lit(word))
    grouped = (
        files.where(P.is_test_file(F.col("path")))
        .groupBy("repo")
        .agg(
            F.count(F.lit(1)).alias("test_files"),
            F.sum(Count(M.TEST_CASES).column(F.col("content"))).alias("test_cases"),
            F.bool_or(jest).alias("_jest"),
            F.bool_or(F.contains(F.col("content"), F.lit(ASSERT_WORD))).alias("_assert"),
        )
    )
    labels = F.concat_ws(
        ", ", F.when(F.col("_jest"), JEST_LABEL), F.when(F.col("_assert"), ASSERT_LABEL)
    )
    return grouped.select(
        "repo",
        "test_files",
        "test_cases",
        F.when(labels == "", "None detected").otherwise(labels).alias("frameworks"),
    )


def test_ratio(files: DataFrame) -> DataFrame:
    """Test files as a percentage of source files, with its band; repositories without tests say so."""
    counts = files.groupBy("repo").agg(
        total(P.is_test_file(F.col("path"))).alias("test_files"), total(P.is_source(F.col("path"))).alias("sources")
    )
    ratio = F.when(F.col("sources") == 0, F.lit(0.0)).otherwise(
        percentage(F.col("test_files"), F.col("sources"))
    )
    return counts.withColumn("ratio", ratio).withColumn(
        "band",
        F.when(F.col("test_files") == 0, "none")
        .when(F.col("ratio") < 30, "low")
        .when(F.col("ratio") < 70, "moderate")
        .otherwise("good"),
    )


def test_infrastructure(files: DataFrame, manifests: DataFrame) -> DataFrame:
    """Test scripts of the root manifest, test files by name pattern and files in test directories."""
    names = ["test_js", "test_ts", "spec_js", "spec_ts"]
    dirs = ["in_test", "in_tests", "in_spec", "in_root_tests", "in_src_tests"]
    counts = files.groupBy("repo").agg(
        *[total(P.matches_glob(F.col("path"), [g])).alias(n) for n, g in zip(names, P.TEST_FILES)],
        *[total(P.matches_glob(F.col("path"), [g])).alias(n) for n, g in zip(dirs, P.TEST_DIRS)],
    )
    scripts = manifests.select(
        "repo",
        F.element_at("scripts", F.lit("test")).alias("test_command"),
        F.exists(
            F.map_keys("scripts"), lambda k: F.contains(k, F.lit("test")) & (k != F.lit("test"))
        ).alias("_other"),
    )
    joined = counts.join(scripts, "repo", "left")
    command = F.col("test_command")
    has_script = command.isNotNull() & (command != "") & (command != NO_TEST_SCRIPT)
    test_files = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    dir_files = sum((F.col(n) for n in dirs[1:]), F.col(dirs[0]))
    return joined.select(
        "repo",
        has_script.alias("has_test_script"),
        F.coalesce("_other", F.lit(False)).alias("has_other_test_scripts"),
        *names,
        *dirs,
        test_files.alias("test_files"),
        dir_files.alias("test_dir_files"),
        (has_script | (test_files > 0) | (dir_files > 0)).alias("has_any_tests"),
    )


def syntax_counts(files: DataFrame) -> DataFrame:
    """Nine syntax counters summed per repository."""
    measured = files.where(P.is_style_source(F.col("path"))).select(
        "repo", *[feature.column(F.col("content")).alias(name) for name, feature in M.SYNTAX.items()]
    )
    return measured.groupBy("repo").agg(*[F.sum(name).alias(name) for name in M.SYNTAX])


def syntax_verdicts(counts: DataFrame) -> DataFrame:
    """One row per repository and verdict that applies to its syntax counts."""
    verdicts = F.array_compact(
        F.array(
            F.when(F.col("var_decls") > 0, F.lit("avoid_var")),
            F.when(
                (F.col("promise_chains") > F.col("async_await")) & (F.col("promise_chains") > 5),
                F.lit("consider_async_await"),
            ),
            F.when(F.col("destructuring") < F.col("const_decls") * 0.2, F.lit("use_destructuring")),
        )
    )
    return counts.select("repo", F.explode(verdicts).alias("verdict"))
