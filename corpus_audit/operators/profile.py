"""Repository profile: sizes, languages, frameworks, activity, structure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpus_audit.functions import metrics as M
from corpus_audit.functions import paths as P
from corpus_audit.operators.api import api_flag_columns
from corpus_audit.operators.metrics import total
from corpus_audit.sources.files import cap_per_group


# --- fixed values: languages, frameworks, file names, limits ----------------------------------------
LANGUAGES = {
    ".js": "JavaScript",
    ".jsx": "JavaScript (React)",
    ".ts": "TypeScript",
    ".tsx": "TypeScript (React)",
    ".py": "Python",
    ".java": "Java",
    ".cpp": "C++",
    ".c": "C",
    ".cs": "C#",
    ".go": "Go",
    ".rs": "Rust",
    ".php": "PHP",
    ".rb": "Ruby",
    ".swift": "Swift",
    ".kt": "Kotlin",
    ".scala": "Scala",
    ".html": "HTML",
    ".css": "CSS",
    ".scss": "SCSS",
    ".sass": "Sass",
    ".less": "Less",
    ".vue": "Vue.js",
    ".sql": "SQL",
    ".sh": "Shell",
    ".yaml": "YAML",
    ".yml": "YAML",
    ".json": "JSON",
    ".xml": "XML",
    ".md": "Markdown",
}
PACKAGE_FRAMEWORKS = [
    ("express", "Express"),
    ("fastify", "Fastify"),
    ("koa", "Koa"),
    ("hapi", "Hapi"),
    ("nest", "NestJS"),
    ("@nestjs/core", "NestJS"),
    ("next", "Next.js"),
    ("react", "React"),
    ("vue", "Vue"),
    ("angular", "Angular"),
]
ENTRY_POINTS = [
    "index.js",
    "index.ts",
    "app.js",
    "app.ts",
    "server.js",
    "server.ts",
    "src/index.js",
    "src/index.ts",
    "src/app.js",
    "src/app.ts",
]
CONFIG_NAMES = [
    "tsconfig.json",
    ".eslintrc.js",
    ".eslintrc.json",
    "prettier.config.js",
    ".prettierrc",
    "jest.config.js",
    "webpack.config.js",
    "vite.config.js",
    ".env",
    ".env.example",
    "docker-compose.yml",
    "Dockerfile",
]
BINARY_EXTENSIONS = [".png", ".jpg", ".jpeg", ".gif", ".ico", ".pdf", ".zip", ".tar", ".gz"]
LARGE_REPOSITORY_FILES, MEDIUM_REPOSITORY_FILES, COMPACT_REPOSITORY_FILES = 100, 50, 10
# What is noted: type and message.
INSIGHTS = {
    "sizes": ("fileSize", "%d large files detected (>100KB). These may need special attention during analysis."),
    "large": ("scale", "Large repository: %d files. This is a substantial codebase."),
    "small": ("scale", "Small repository: %d files. This is a compact codebase."),
    "binary": ("binaryFiles", "%d binary files detected. These will be excluded from text analysis."),
}
# Above so many files: size, estimate, approach.
SIZE_LABELS = [
    (LARGE_REPOSITORY_FILES, "Large", "5-10 minutes", "Consider analyzing in phases or focusing on specific areas"),
    (MEDIUM_REPOSITORY_FILES, "Medium", "2-5 minutes", "Full repository analysis recommended"),
    (None, "Small", "1-2 minutes", "Full repository analysis recommended"),
]
LARGE_REPOSITORY_BYTES = 5 * 1024 * 1024
TOP_FILES, RECENT_DAYS, SAMPLE_PATHS = 10, 30, 3
# --- end of fixed values -------------------------------------------------------------------------------

CATEGORIES = ["small", "medium", "large", "huge"]


def file_classes(stats: DataFrame) -> DataFrame:
    """Extension, size class, large flag and readable size of every file."""
    return stats.select(
        "repo",
        "path",
        "size",
        P.extension(F.col("path")).alias("extension"),
        P.size_category(F.col("size")).alias("size_category"),
        P.is_large(F.col("size")).alias("is_large"),
        P.human_bytes(F.col("size")).alias("human_size"),
    )


def repo_summary(stats: DataFrame) -> DataFrame:
    return stats.groupBy("repo").agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("size").alias("total_size"),
        F.avg(F.col("size").cast("double")).alias("average_size"),
    )


def size_distribution(stats: DataFrame) -> DataFrame:
    category = P.size_category(F.col("size"))
    return stats.groupBy("repo").agg(*[total(category == c).alias(c) for c in CATEGORIES])


def quick_scan(stats: DataFrame) -> DataFrame:
    """Counts, size classes and the large-repository flag in one aggregation."""
    category = P.size_category(F.col("size"))
    return stats.groupBy("repo").agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("size").alias("total_size"),
        F.avg(F.col("size").cast("double")).alias("average_size"),
        *[total(category == c).alias(c) for c in CATEGORIES],
        (
            (F.count(F.lit(1)) > LARGE_REPOSITORY_FILES) | (F.sum("size") > LARGE_REPOSITORY_BYTES)
        ).alias("is_large_repo"),
    )


def extension_breakdown(stats: DataFrame) -> DataFrame:
    """Files per extension with its rank in the repository, most frequent first."""
    counted = stats.groupBy("repo", P.extension(F.col("path")).alias("extension")).agg(F.count(F.lit(1)).alias("files"))
    order = Window.partitionBy("repo").orderBy(F.col("files").desc(), "extension")
    return counted.withColumn("rank", F.row_number().over(order))


def languages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LANGUAGES.items()), "extension string, language string")


def language_distribution(stats: DataFrame) -> DataFrame:
    """Files per language with the share of the files that map to one; rank 1 is the primary language.

    Extensions are counted first, so the join and the window see a few rows per repository.
    """
    by_extension = stats.groupBy("repo", P.extension(F.col("path")).alias("extension")).agg(
        F.count(F.lit(1)).alias("n")
    )
    by_language = (
        by_extension.join(F.broadcast(languages(stats.sparkSession)), "extension")
        .groupBy("repo", "language")
        .agg(F.sum("n").alias("files"))
    )
    everything = Window.partitionBy("repo")
    order = everything.orderBy(F.col("files").desc(), "language")
    return by_language.select(
        "repo",
        "language",
        "files",
        F.round(F.col("files").cast("double") / F.sum("files").over(everything) * 100, 1).alias("percentage"),
        F.row_number().over(order).alias("rank"),
    )


def primary_language(stats: DataFrame) -> DataFrame:
    """Most frequent language per repository, Unknown when no file maps to one."""
    mapped = F.element_at(
        F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair]), P.extension(F.col("path"))
    )
    counted = stats.groupBy("repo", mapped.alias("language")).agg(F.count(F.lit(1)).alias("n"))
    best = F.max_by(
        F.col("language"), F.when(F.col("language").isNotNull(), F.struct("n", _reversed("language")))
    )
    return counted.groupBy("repo").agg(F.coalesce(best, F.lit("Unknown")).alias("primary_language"))


def _reversed(name: str) -> Column:
    """Sort key that is larger for alphabetically earlier language names."""
    order = sorted(set(LANGUAGES.values()))
    ranks = F.create_map(*[F.lit(x) for i, lang in enumerate(order) for x in (lang, -i)])
    return F.element_at(ranks, F.col(name))


def frameworks_from_paths(stats: DataFrame) -> DataFrame:
    """Frameworks that file names and extensions point to: one row per repository, group and framework."""

    def ext(*names: str) -> Column:
        return P.extension(F.col("path")).isin(*names)

    def has(part: str) -> Column:
        return F.contains(F.col("path"), F.lit(part))

    # --- fixed values: framework evidence ------------------------------------------------------------
    evidence = {
        "_react": ext(".jsx", ".tsx"),
        "_manifest": has("package.json"),
        "_next": has("next.config"),
        "_vue": ext(".vue"),
        "_angular": has("angular.json"),
        "_express": has("express"),
        "_fastify": has("fastify"),
        "_python": ext(".py"),
        "_django": has("django"),
        "_flask": has("flask"),
        "_fastapi": has("fastapi"),
        "_jest": has("jest"),
        "_cypress": has("cypress"),
        "_playwright": has("playwright"),
        "_webpack": has("webpack"),
        "_vite": has("vite"),
        "_rollup": has("rollup"),
    }
    c = F.col
    verdicts = [
        ("frontend", "Next.js", (c("_react") | c("_manifest")) & c("_next")),
        ("frontend", "React", c("_react") & ~c("_next")),
        ("frontend", "Vue.js", c("_vue")),
        ("frontend", "Angular", c("_angular")),
        ("backend", "Express.js", c("_express")),
        ("backend", "Fastify", c("_fastify")),
        ("backend", "Django", c("_python") & c("_django")),
        ("backend", "Flask", c("_python") & c("_flask")),
        ("backend", "FastAPI", c("_python") & c("_fastapi")),
        ("testing", "Jest", c("_jest")),
        ("testing", "Cypress", c("_cypress")),
        ("testing", "Playwright", c("_playwright")),
        ("build", "Webpack", c("_webpack")),
        ("build", "Vite", c("_vite")),
        ("build", "Rollup", c("_rollup")),
    ]
    # --- end of fixed values ---------------------------------------------------------------------------
    flags = stats.groupBy("repo").agg(*[F.bool_or(e).alias(name) for name, e in evidence.items()])
    found = F.array_compact(
        F.array(
            *[
                F.when(v, F.struct(F.lit(g).alias("group"), F.lit(name).alias("framework")))
                for g, name, v in verdicts
            ]
        )
    )
    return flags.select("repo", F.explode(found).alias("f")).select("repo", "f.group", "f.framework")


def frameworks_from_dependencies(dependencies: DataFrame) -> DataFrame:
    """Frameworks among the dependencies (two packages may name the same one)."""
    known = dependencies.sparkSession.createDataFrame(PACKAGE_FRAMEWORKS, "name string, framework string")
    return (
        dependencies.where(F.col("version") != "")
        .join(F.broadcast(known), "name")
        .select("repo", "name", "framework")
        .distinct()
    )


def largest_files(stats: DataFrame, k: int = TOP_FILES) -> DataFrame:
    """The ``k`` largest files of every repository."""
    order = Window.partitionBy("repo").orderBy(F.col("size").desc(), "path")
    ranked = stats.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("repo", "rank", "path", "size")


def recent_activity(stats: DataFrame, as_of: str, days: int = RECENT_DAYS) -> DataFrame:
    """Files changed in the ``days`` before ``as_of``."""
    recent = F.col("modified") > F.expr(f"TIMESTAMP '{as_of}' - INTERVAL {int(days)} DAYS")
    return stats.groupBy("repo").agg(
        total(recent).alias("recent_files"),
        (total(recent).cast("double") / F.count(F.lit(1)) * 100).alias("percentage"),
    )


def line_totals(files: DataFrame) -> DataFrame:
    lines = M.line_count(F.col("content"))
    return files.groupBy("repo").agg(
        F.coalesce(F.sum(lines), F.lit(0).cast("bigint")).alias("total_lines"),
        (F.coalesce(F.sum(lines), F.lit(0)).cast("double") / F.count(F.lit(1))).alias("average_lines"),
    )


def insights(stats: DataFrame) -> DataFrame:
    """Large files (with the first three), repository scale and binary files, as rows."""
    counts = stats.groupBy("repo").agg(
        F.count(F.lit(1)).alias("_files"),
        total(P.is_large(F.col("size"))).alias("_large"),
        total(P.extension(F.col("path")).isin(BINARY_EXTENSIONS)).alias("_binary"),
    )
    first = cap_per_group(stats.where(P.is_large(F.col("size"))).select("repo", "path"), SAMPLE_PATHS, ["repo"], ["path"])
    samples = first.groupBy("repo").agg(F.array_join(F.array_sort(F.collect_list("path")), ", ").alias("_sample"))
    files, large, binary = F.col("_files"), F.col("_large"), F.col("_binary")

    def note(kind: str, count: Column, paths: Column) -> Column:
        return F.struct(F.lit(INSIGHTS[kind][0]).alias("type"), F.lit("info").alias("severity"), F.format_string(INSIGHTS[kind][1], count).alias("message"), paths.alias("paths"))

    none = F.lit(None).cast("string")
    scale = F.when(files > LARGE_REPOSITORY_FILES, note("large", files, none)).when(files < COMPACT_REPOSITORY_FILES, note("small", files, none))
    notes = F.array_compact(F.array(F.when(large > 0, note("sizes", large, F.col("_sample"))), scale, F.when(binary > 0, note("binary", binary, none))))
    return (
        counts.join(samples, "repo", "left")
        .select("repo", F.explode(notes).alias("i"))
        .select("repo", "i.type", "i.severity", "i.message", "i.paths")
    )


def file_type_columns() -> list[Column]:
    """Aggregates: test, TypeScript, JavaScript, JSON and Markdown files; a test file counts as nothing else."""
    lower, ext = F.lower(F.col("path")), P.extension(F.col("path"))
    test = F.contains(lower, F.lit(".test.")) | F.contains(lower, F.lit(".spec."))
    return [
        *[total(~test & (ext == f".{name}")).alias(name) for name in ("ts", "js")],
        total(test).alias("test"),
        *[total(~test & (ext == f".{name}")).alias(name) for name in ("json", "md")],
    ]


def file_type_counts(stats: DataFrame) -> DataFrame:
    return stats.groupBy("repo").agg(*file_type_columns())


def _present_columns(names: list[str], prefix: str) -> list[Column]:
    """Aggregates: one flag per well-known path, so no list grows with the table."""
    return [F.bool_or(F.col("path") == n).alias(f"{prefix}{i}") for i, n in enumerate(names)]


def _present(names: list[str], prefix: str) -> Column:
    """The names whose flags hold, in list order."""
    return F.array_compact(F.array(*[F.when(F.col(f"{prefix}{i}"), F.lit(n)) for i, n in enumerate(names)]))


def _with_main(main: Column, known: Column) -> Column:
    return F.array_distinct(
        F.when(F.coalesce(main != "", F.lit(False)), F.concat(F.array(main), known)).otherwise(known)
    )


def entry_points(files: DataFrame, manifests: DataFrame) -> DataFrame:
    """Main file of the manifest, then the well-known entry files that exist, in order."""
    known = (
        files.where(F.col("path").isin(ENTRY_POINTS))
        .groupBy("repo")
        .agg(*_present_columns(ENTRY_POINTS, "_e"))
        .select("repo", _present(ENTRY_POINTS, "_e").alias("_known"))
    )
    joined = known.join(manifests.select("repo", "main"), "repo", "full")
    names = _with_main(F.col("main"), F.coalesce("_known", F.array().cast("array<string>")))
    return joined.select("repo", names.alias("entry_points")).where(F.size("entry_points") > 0)


def config_files(files: DataFrame) -> DataFrame:
    """Well-known configuration files that exist, in order."""
    flags = (
        files.where(F.col("path").isin(CONFIG_NAMES)).groupBy("repo").agg(*_present_columns(CONFIG_NAMES, "_c"))
    )
    return flags.select("repo", _present(CONFIG_NAMES, "_c").alias("config_files"))


def repo_structure(files: DataFrame, manifests: DataFrame) -> DataFrame:
    """File count, API and auth flags, frameworks, file types, entry points and configuration files.

    One aggregation over the files answers everything that depends on them, so texts are read once; the
    root manifests (one row per repository) are joined to its result.
    """
    measured = files.groupBy("repo").agg(
        F.count(F.lit(1)).alias("files"),
        *api_flag_columns(),
        *file_type_columns(),
        *_present_columns(ENTRY_POINTS, "_e"),
        *_present_columns(CONFIG_NAMES, "_c"),
    )
    empty = F.array().cast("array<string>")
    listed = manifests.select(
        "repo",
        "main",
        F.array_compact(
            F.array(
                *[
                    F.when(F.element_at("dependencies", F.lit(package)) != "", F.lit(framework))
                    for package, framework in PACKAGE_FRAMEWORKS
                ]
            )
        ).alias("_frameworks"),
    )
    frameworks = F.coalesce("_frameworks", empty)
    return measured.join(listed, "repo", "left").select(
        "repo",
        "files",
        ((F.size(frameworks) > 0) | F.col("has_api_routes")).alias("has_api"),
        "has_api_routes",
        "has_auth",
        frameworks.alias("frameworks"),
        "ts",
        "js",
        "test",
        "json",
        "md",
        _with_main(F.col("main"), _present(ENTRY_POINTS, "_e")).alias("entry_points"),
        _present(CONFIG_NAMES, "_c").alias("config_files"),
    )


def suggest_analyses(structure: DataFrame) -> DataFrame:
    """Analyses worth running, in order."""
    return structure.select(
        "repo",
        F.explode(
            F.array_compact(
                F.array(
                    F.lit("code-quality"),
                    F.lit("documentation"),
                    F.when(
                        F.col("has_api_routes") | F.array_contains("frameworks", "Express"), F.lit("api-quality")
                    ),
                    F.lit("security"),
                    F.when((F.col("test") > 0) | (F.col("ts") > 0), F.lit("next-task")),
                )
            )
        ).alias("analysis"),
    )


def size_class(stats: DataFrame) -> DataFrame:
    """Large, Medium or Small by file count, with the time and approach labels."""
    counted = stats.groupBy("repo").agg(F.count(F.lit(1)).alias("files"))

    def label(k: int) -> Column:
        """The label of the first size whose files are exceeded."""
        *larger, (_, last) = [(least, labels[k]) for least, *labels in SIZE_LABELS]
        return F.coalesce(*[F.when(F.col("files") > least, text) for least, text in larger], F.lit(last))

    return counted.select("repo", "files", label(0).alias("size"), label(1).alias("estimate"), label(2).alias("approach"))
