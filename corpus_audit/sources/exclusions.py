"""Exclusion patterns: built-in ones, ignore files inside repositories, and the user's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: default exclusion patterns -------------------------------------------------------
DEFAULT_EXCLUSIONS = [
    "node_modules/**",
    "dist/**",
    "build/**",
    ".git/**",
    ".next/**",
    ".nuxt/**",
    "coverage/**",
    "out/**",
    "target/**",
    "*.log",
    "*.tmp",
    "*.temp",
    ".DS_Store",
    "Thumbs.db",
    ".vscode/**",
    ".idea/**",
    "*.min.js",
    "*.min.css",
    "bundle.js",
    "bundle.css",
]
IGNORE_FILES = [".gitignore"]
# --- end of fixed values -----------------------------------------------------------------------------

_BLANKS = " \t\r\n\x0b\x0c"


def ignore_rules(files: DataFrame, names: list[str] = IGNORE_FILES) -> DataFrame:
    """One row per pattern of the root ignore files, in file order then line order.

    Pass your own tool's ignore file names in ``names``, most specific first.
    """
    name_rank = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("path"))
    return (
        files.where(F.col("path").isin(names))
        .select(
            "repo",
            name_rank.cast("int").alias("file_rank"),
            F.posexplode(F.split("content", "\n")).alias("pos", "line"),
        )
        .select("repo", "file_rank", "pos", F.btrim("line", F.lit(_BLANKS)).alias("pattern"))
        .where((F.col("pattern") != "") & ~F.startswith("pattern", F.lit("#")))
    )


def exclusion_regex(pattern: str) -> str:
    """SQL text for the regex of the paths one exclusion pattern removes; ``pattern`` is SQL text too.

    ``dir/**`` is a directory prefix, ``**/x`` matches x below any directory, an inner ``**`` spans
    directories, other wildcards cross ``/`` but are anchored, and a plain name matches as a whole path,
    a directory anywhere, or a last component.
    """
    p = f"regexp_replace({pattern}, '/+$', '')"
    escaped = rf"regexp_replace({p}, r'([.+^$(){{}}|\[\]\\])', r'\\$1')"

    def deep(part: str) -> str:
        """``**`` spans directories, ``*`` stays inside one."""
        marked = f"replace({part}, '**', '\u0001')"
        stars = f"replace(replace({marked}, '*', '[^/]*'), '?', '[^/]')"
        return f"replace(replace({stars}, '\u0001/', '(?:.*/)?'), '\u0001', '.*')"

    directory = rf"regexp_replace({escaped}, r'/\*\*$', '')"
    tail = rf"regexp_replace({escaped}, r'^\*\*/', '')"
    flat = f"replace(replace({escaped}, '*', '.*'), '?', '.')"
    name = rf"replace({escaped}, '?', r'\?')"
    return (
        f"CASE WHEN endswith({p}, '/**') THEN concat('^', {deep(directory)}, '(?:/.*)?$') "
        f"WHEN startswith({p}, '**/') THEN concat('^(?:.*/', {deep(tail)}, '.*|', {deep(tail)}, ')$') "
        f"WHEN contains({p}, '**') THEN concat('^', {deep(escaped)}, '$') "
        f"WHEN contains({p}, '*') THEN concat('^', {flat}, '$') "
        f"ELSE concat('(?:^|/)', {name}, '(?:/|$)') END"
    )


_PATH = r"replace(path, r'\', '/')"


def is_excluded(patterns: list[str] = DEFAULT_EXCLUSIONS) -> Column:
    """True where the ``path`` column is removed by one of ``patterns``; backslashes count as ``/``.

    The regexes fold to literals while the plan is optimized, so each is compiled once.
    """
    quoted = ["'" + p.replace("\\", "\\\\").replace("'", "\\'") + "'" for p in patterns]
    return F.expr(" OR ".join(f"rlike({_PATH}, {exclusion_regex(q)})" for q in quoted) or "false")


_WILD = "[*?]"


def rule_index(rules: DataFrame) -> DataFrame:
    """Ignore-file patterns by an anchor that every path they remove has: ``repo, kind, key, always, regex``.

    ``part``: a component; ``prefix``: the path itself or a directory above it; ``top``: the first component; ``ext``:
    what follows the last dot; ``any``: no anchor.  Where the anchor says it all, ``always`` is true; the other patterns
    of an anchor are one regex.  The patterns of a repository come from its few root ignore files.
    """
    p = F.regexp_replace("pattern", "/+$", "")
    directory = F.expr("substr(_p, 1, length(_p) - 3)")
    first, tail = F.substring_index("_p", "/", 1), F.regexp_extract("_p", r"[^*?]*$", 0)
    dotted = F.contains(tail, F.lit("."))

    def anchor(kind: str, key, always=False):
        return F.struct(F.lit(kind).alias("kind"), key.alias("key"), F.lit(always).alias("always"))

    found = (
        F.when(F.endswith("_p", F.lit("/**")) & ~F.rlike(directory, F.lit(_WILD)), anchor("prefix", directory, True))
        .when(F.startswith("_p", F.lit("**/")), anchor("any", F.lit("")))
        .when(F.contains("_p", F.lit("*")) & F.contains("_p", F.lit("/")) & ~F.rlike(first, F.lit(_WILD)), anchor("top", first))
        .when(F.contains("_p", F.lit("*")) & dotted, anchor("ext", F.substring_index(tail, ".", -1)))
        .when(F.contains("_p", F.lit("*")), anchor("any", F.lit("")))
        .when((F.col("_p") != "") & ~F.contains("_p", F.lit("/")), anchor("part", F.col("_p"), True))
        .otherwise(anchor("part", first))
    )
    indexed = rules.withColumn("_p", p).select("repo", found.alias("a"), F.expr(exclusion_regex("pattern")).alias("regex"))
    return indexed.groupBy("repo", "a.kind", "a.key").agg(
        F.bool_or("a.always").alias("always"), F.array_join(F.array_sort(F.collect_set(F.when(~F.col("a.always"), F.col("regex")))), "|").alias("regex")
    )


def _anchors(path: Column) -> Column:
    """All anchors of a path under which a pattern that removes it may stand."""
    parts = F.split(path, "/")
    named = lambda kind: lambda key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: named("prefix")(F.array_join(F.slice(parts, 1, k), "/")))
    own = [named("top")(F.get(parts, 0)), named("ext")(F.substring_index(path, ".", -1)), named("any")(F.lit(""))]
    return F.concat(F.transform(F.array_distinct(parts), named("part")), above, F.array(*own))


def ignored_paths(files: DataFrame, rules: DataFrame) -> DataFrame:
    """``repo, path`` of the files that patterns of their repository's ignore files remove, each once.

    Paths meet patterns by equal anchors.  Only keys take part, no texts, and a pattern is never compared with a path
    that lacks its anchor, nor with another repository's.
    """
    keys = files.select("repo", "path", F.expr(_PATH).alias("_clean"))
    keys = keys.select("repo", "path", "_clean", F.explode(_anchors(F.col("_clean"))).alias("a")).select("repo", "path", "_clean", "a.kind", "a.key")
    # regexp_instr keeps the last compiled pattern.
    hit = F.col("always") | ((F.col("regex") != "") & F.expr("regexp_instr(_clean, regex) > 0"))
    return keys.join(rule_index(rules), ["repo", "kind", "key"]).where(hit).select("repo", "path").distinct()


def exclude_paths(
    files: DataFrame,
    rules: DataFrame | None = None,
    user: list[str] | None = None,
    defaults: list[str] = DEFAULT_EXCLUSIONS,
) -> DataFrame:
    """Files not removed by default, user or ignore-file patterns.

    Default and user patterns are plain predicates.  What ignore-file patterns remove is found among the keys alone, and
    taken out by an anti join whose way the optimizer chooses; building the plan runs no job.
    """
    kept = files.where(~is_excluded([*defaults, *(user or [])]))
    return kept if rules is None else kept.join(ignored_paths(kept, rules), ["repo", "path"], "left_anti")


def excluded_paths(files: DataFrame, rules: DataFrame, user: list[str] | None = None) -> DataFrame:
    """The removed paths and which kind of pattern removed them (first of default, ignore file, user)."""
    keys = files.select("repo", "path")
    joined = keys.join(ignored_paths(keys, rules).withColumn("_ignored", F.lit(True)), ["repo", "path"], "left")
    origin = F.when(is_excluded(DEFAULT_EXCLUSIONS), "default").when(F.col("_ignored"), "ignore_file")
    if user:
        origin = origin.when(is_excluded(user), "user")
    return joined.select("repo", "path", origin.alias("origin")).where(F.col("origin").isNotNull())


def exclusion_summary(repos: DataFrame, rules: DataFrame, user: list[str] | None = None) -> DataFrame:
    """Patterns in force per repository, by origin."""
    counted = rules.groupBy("repo").agg(F.count(F.lit(1)).alias("ignore_file"))
    return (
        repos.select("repo")
        .distinct()
        .join(counted, "repo", "left")
        .select(
            "repo",
            F.lit(len(DEFAULT_EXCLUSIONS)).cast("bigint").alias("default"),
            F.coalesce("ignore_file", F.lit(0).cast("bigint")).alias("ignore_file"),
            F.lit(len(user or [])).cast("bigint").alias("user"),
        )
        .withColumn("total", F.col("default") + F.col("ignore_file") + F.col("user"))
    )
