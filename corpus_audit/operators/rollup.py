"""Issue roll-ups, report analytics, coordination comments and prompt datasets."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpus_audit.functions import paths as P
from corpus_audit.operators.metrics import total
from corpus_audit.operators.numbering import placed
from corpus_audit.operators.profile import primary_language
from corpus_audit.sources.files import SECTION_CHARS, cap_per_group

# --- fixed values: agents, headings, keywords, comment format ----------------------------------------
SYNTHESIS_AGENTS = ["api-quality", "documentation", "code-quality", "security"]
NEXT_TASK_AGENTS = ["code-quality", "documentation", "api-quality", "security", "recapper"]
RESULTS_HEADING, COORDINATION_HEADING = "## Analysis Results", "## Coordination"
NO_RESULTS, NO_ANALYSIS = "No analysis results found", "No analysis performed"
REPORT_ABOVE = 100
COMMENT = (
    r"<!-- @([\w-]+): ([^\n]+)\nContext: ([^\n]+)\nStatus: (pending|resolved)\nRound: (\d+)\n-->"
)
MAX_ROUNDS = 3
SHOWN_RESOLVED = 5
PROMPT_AGENTS = {
    "api-quality": "API Quality",
    "documentation": "Documentation",
    "code-quality": "Code Quality",
    "security": "Security",
    "next-task": "Next Task",
}
PROMPT_HEADER = (
    "Please analyze this %s repository as the %s agent.\n\nRepository Structure:\n- Total files: %s\n"
    "- Main language: %s\n- Has TypeScript: %s\n- Has tests: %s\n- Has API routes: %s\n\nFiles to analyze:\n"
)
NO_CONTENT = "[File content provided separately]"
# Keyword rules: alternatives, each a list of word lists; of every list one word has to occur.
CRITICAL_RULES = [
    ([[["critical", "🚨"]]], "**{agent}**: Critical issues detected in analysis"),
    ([[["security"], ["vulnerability", "injection"]]], "**SECURITY**: Potential security vulnerabilities found"),
    ([[["no test"]], [["❌"], ["test"]]], "**QUALITY**: Testing coverage issues identified"),
    ([[["no readme", "no documentation"]]], "**DOCUMENTATION**: Missing critical documentation"),
]
# By priority: category, action, alternatives in lower-cased sections, alternatives in sections as written, only for this agent.
ACTION_RULES = [
    ("Security", "Address critical security vulnerabilities", [[["critical"]]], [], "security"),
    ("Quality", "Implement basic testing framework and tests", [[["no test"]]], [[["test"], ["❌"]]], None),
    ("Documentation", "Create essential documentation (README, API docs)", [[["no readme", "documentation"]]], [], None),
    ("Refactoring", "Refactor high-complexity code and address code smells", [[["complexity", "code smell"]]], [], None),
]
UNKNOWN_KIND, UNKNOWN_LANGUAGE = "Node.js", "JavaScript"
TOOL_KEYWORDS = [
    ("ESLint", "ESLint for code quality"),
    ("Jest", "Jest for testing"),
    ("TypeScript", "TypeScript for type safety"),
    ("bcrypt", "bcrypt for password hashing"),
]
# --- end of fixed values -------------------------------------------------------------------------------

PART_LINES = 100  # issue lines in one part of a report
PART_CHARS = 200_000  # characters of files in one part of a prompt


def _holds(text: Column, alternatives: list[list[list[str]]]) -> Column:
    """Whether one of the alternatives holds: of each of its word lists, one word occurs."""

    def one_of(words: list[str]) -> Column:
        return reduce(or_, [F.contains(text, F.lit(w)) for w in words])

    return reduce(or_, [reduce(and_, map(one_of, lists)) for lists in alternatives], F.lit(False))


def _fired(collected: DataFrame, rules: list[tuple[Column, dict[str, Column]]]) -> DataFrame:
    """A row of filled reports for each rule that holds: ``repo, agent, agent_pos``, the rule's ``number`` (from 1) and its columns."""
    found = [F.when(holds, F.struct(F.lit(k).alias("number"), *[c.alias(n) for n, c in columns.items()])) for k, (holds, columns) in enumerate(rules, 1)]
    rows = collected.where("has_content").select("repo", "agent", "agent_pos", F.explode_outer(F.array_compact(F.array(*found))).alias("f"))
    return rows.where(F.col("f.number").isNotNull()).select("repo", "agent", "agent_pos", "f.*")


# ---- issues ------------------------------------------------------------------------------------------


def group_issues(issues: DataFrame, k: int | None = None, part_lines: int = PART_LINES) -> DataFrame:
    """Issues per repository and type: ``repo, type, part, issues`` (of the type) and ``lines``.

    All lines of a repository, by type, path, rule and description, are numbered and cut into parts of ``part_lines``;
    every line stands in one part, so the rows of a part make a report of bounded size.  With ``k`` only the first ``k``
    lines of each type by path are taken, all in part 0; they are cut inside each task before the shuffle.
    """
    wanted = issues.select("repo", "type", "path", "rule_id", "description")
    if k is not None:
        counts = issues.groupBy("repo", "type").agg(F.count(F.lit(1)).alias("issues"))
        first = cap_per_group(wanted, k, ["repo", "type"], ["path", "rule_id", "description"])
        lines = first.groupBy("repo", "type").agg(F.array_sort(F.collect_list(F.concat_ws(": ", "path", "description"))).alias("lines"))
        return counts.join(lines, ["repo", "type"]).select("repo", "type", F.lit(0).cast("long").alias("part"), "issues", "lines")
    rows = placed(wanted, ["repo"], ["type", "path", "rule_id", "description"]).withColumn("part", F.expr(f"place div {int(part_lines)}"))
    line = F.struct("place", F.concat_ws(": ", "path", "description").alias("line"))
    parts = rows.groupBy("repo", "type", "part").agg(F.count(F.lit(1)).alias("_here"), F.array_sort(F.collect_list(line)).alias("_lines"))
    sums = parts.groupBy("repo", "type").agg(F.sum("_here").alias("issues"))
    return parts.join(sums, ["repo", "type"]).select("repo", "type", "part", "issues", F.transform("_lines", lambda x: x["line"]).alias("lines"))


def all_issues(*tables: DataFrame) -> DataFrame:
    """Detector outputs in one table; columns a table lacks are NULL."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


# ---- reports -----------------------------------------------------------------------------------------


def analysis_section(content: Column) -> Column:
    """Trimmed text between the results heading and the coordination heading."""
    start = F.locate(RESULTS_HEADING, content)
    other = F.locate(COORDINATION_HEADING, content)
    end = F.when(other > 0, other).otherwise(F.length(content) + 1)
    low, high = F.least(start, end), F.greatest(start, end)
    section = F.substr(content, low, high - low)
    body = F.when(start <= end, F.substr(section, F.lit(len(RESULTS_HEADING) + 1))).otherwise(section)
    return F.when(start == 0, NO_RESULTS).otherwise(F.btrim(body, F.lit(" \t\r\n\x0b\x0c")))


def collect_reports(reports: DataFrame, agents: list[str] = SYNTHESIS_AGENTS, above: int = 0) -> DataFrame:
    """One row per repository and expected agent; absent reports, and those of at most ``above`` characters, become
    placeholders.

    Present reports stay where they are.  Only the keys are shuffled to find the absent ones.
    """
    position = F.array_position(F.array(*[F.lit(a) for a in agents]), F.col("agent")).cast("int")
    expected = reports.where(F.col("agent").isin(agents))
    filled = F.coalesce(F.length("content") > above, F.lit(False))
    present = expected.select(
        "repo",
        "agent",
        position.alias("agent_pos"),
        F.when(filled, F.col("content")).otherwise("").alias("content"),
        F.when(filled, analysis_section(F.col("content"))).otherwise(NO_ANALYSIS).alias("section"),
        filled.alias("has_content"),
    )
    wanted = reports.select("repo").distinct().select(
        "repo", F.explode(F.array(*[F.lit(a) for a in agents])).alias("agent")
    )
    absent = wanted.join(expected.select("repo", "agent"), ["repo", "agent"], "left_anti").select(
        "repo",
        "agent",
        position.alias("agent_pos"),
        F.lit("").alias("content"),
        F.lit(NO_ANALYSIS).alias("section"),
        F.lit(False).alias("has_content"),
    )
    return present.unionByName(absent)


def critical_findings(collected: DataFrame) -> DataFrame:
    """Keyword rules over report sections: one row per rule that fires, in report order."""
    text = F.lower("section")
    rules = [(_holds(text, words), {"issue": F.replace(F.lit(message), F.lit("{agent}"), F.upper("agent"))}) for words, message in CRITICAL_RULES]
    order = Window.partitionBy("repo").orderBy("agent_pos", "number")
    return _fired(collected, rules).select("repo", "agent", "issue", F.row_number().over(order).alias("position"))


def action_plan(collected: DataFrame) -> DataFrame:
    """Prioritised actions per repository, numbered.

    A repository has at most four actions per expected agent, so the numbering window stays small.
    """
    rules = []
    for category, action, lower, written, agent in ACTION_RULES:
        holds = _holds(F.lower("section"), lower) | _holds(F.col("section"), written)
        holds = holds if agent is None else holds & (F.col("agent") == agent)
        rules.append((holds, {"category": F.lit(category), "action": F.lit(action)}))
    order = Window.partitionBy("repo").orderBy("number", "agent_pos")
    return _fired(collected, rules).select(
        "repo", F.row_number().over(order).alias("position"), F.col("number").alias("priority"), "category", "action", "agent"
    )



def tool_recommendations(collected: DataFrame) -> DataFrame:
    """Tools named in any section of a repository, once each."""
    tools = F.array_compact(
        F.array(*[F.when(F.contains("section", F.lit(word)), F.lit(tool)) for word, tool in TOOL_KEYWORDS])
    )
    return collected.select("repo", F.explode(tools).alias("tool")).distinct()


def agent_coverage(collected: DataFrame) -> DataFrame:
    """Completed and expected agents per repository."""
    return collected.groupBy("repo").agg(
        total(F.col("has_content")).alias("complete"), F.count(F.lit(1)).alias("expected")
    )


def reports_context(collected: DataFrame, chars: int | None = None) -> DataFrame:
    """Non-empty sections of a repository, cut to ``chars`` if that is given, under upper-cased headings."""
    section = F.col("section") if chars is None else F.substring("section", 1, chars)
    piece = F.concat(F.lit("\n### "), F.upper("agent"), F.lit(" FINDINGS:\n"), section, F.lit("\n"))
    return (
        collected.where("has_content")
        .select("repo", "agent_pos", piece.alias("piece"))
        .groupBy("repo")
        .agg(
            F.array_join(
                F.transform(
                    F.array_sort(F.collect_list(F.struct("agent_pos", "piece"))), lambda s: s["piece"]
                ),
                "",
            ).alias("context")
        )
    )


# ---- comments ----------------------------------------------------------------------------------------


def parse_comments(reports: DataFrame) -> DataFrame:
    """Structured comments of every report, numbered in order."""
    blocks = F.posexplode(F.regexp_extract_all("content", F.lit(COMMENT), 0)).alias("pos", "block")

    def group(i: int) -> Column:
        return F.regexp_extract("block", COMMENT, i)

    return reports.select("repo", "agent", blocks).select(
        "repo",
        "agent",
        (F.col("pos") + 1).alias("comment_no"),
        F.concat(F.lit("comment-"), (F.col("pos") + 1).cast("string")).alias("comment_id"),
        group(1).alias("target"),
        group(2).alias("question"),
        group(3).alias("context"),
        group(4).alias("status"),
        group(5).cast("int").alias("round"),
    )


def pending_questions(comments: DataFrame, target: str | None = None, round_no: int | None = None) -> DataFrame:
    out = comments.where(F.col("status") == "pending")
    if target is not None:
        out = out.where(F.col("target") == target)
    return out if round_no is None else out.where(F.col("round") == round_no)


def agent_pairs(reports: DataFrame, agents: list[str] = SYNTHESIS_AGENTS) -> DataFrame:
    """Unordered pairs of the expected agents that reported, per repository.

    The pairs of the fixed agent list are spelled out and kept where both flags hold, so rows are never
    joined with each other.
    """
    flags = reports.groupBy("repo").agg(
        *[F.bool_or(F.col("agent") == a).alias(f"_a{i}") for i, a in enumerate(agents)]
    )
    pairs = [
        F.when(
            F.col(f"_a{i}") & F.col(f"_a{j}"),
            F.struct(F.lit(agents[i]).alias("first"), F.lit(agents[j]).alias("second")),
        )
        for i in range(len(agents))
        for j in range(i + 1, len(agents))
    ]
    return flags.select("repo", F.explode(F.array_compact(F.array(*pairs))).alias("p")).select("repo", "p.*")


def round_counts(comments: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """Exchanges between two agents (one per direction and round) against the limit."""
    exchanges = comments.select("repo", "agent", "target", "round").distinct()
    return (
        exchanges.groupBy(
            "repo", F.least("agent", "target").alias("first"), F.greatest("agent", "target").alias("second")
        )
        .agg(F.count(F.lit(1)).alias("exchanges"))
        .withColumn("limit_reached", F.col("exchanges") >= max_rounds)
    )


def resolve_comments(comments: DataFrame, responses: DataFrame) -> DataFrame:
    """Attach responses (repo, agent, comment_id, response); answered comments become resolved."""
    joined = comments.join(responses, ["repo", "agent", "comment_id"], "left")
    return joined.withColumn(
        "status", F.when(F.col("response").isNotNull(), "resolved").otherwise(F.col("status"))
    )


def add_comments(comments: DataFrame, new: DataFrame) -> DataFrame:
    """Comments with ``new`` ones (repo, agent, target, question, context, round) placed first as pending.

    The newest comments of a report lead it by target, question, context and round, so older ones move back by as many
    places.  A report may have any number of new comments: they are numbered over ranges, not in one window.
    """
    order = ["target", "question", "context", "round"]
    numbered = placed(new.select("repo", "agent", *order), ["repo", "agent"], order)
    numbered = numbered.select("*", (F.col("place") + 1).cast("int").alias("comment_no"), F.lit("pending").alias("status"))
    added = new.groupBy("repo", "agent").agg(F.count(F.lit(1)).cast("int").alias("_added"))
    moved = comments.join(added, ["repo", "agent"], "left").withColumn("comment_no", F.col("comment_no") + F.coalesce("_added", F.lit(0)))
    columns = ["repo", "agent", "comment_no", "target", "question", "context", "status", "round"]
    both = moved.select(*columns).unionByName(numbered.select(*columns))
    return both.withColumn("comment_id", F.concat(F.lit("comment-"), F.col("comment_no").cast("string")))


def resolution_rate(comments: DataFrame) -> DataFrame:
    """Questions, resolved ones and the integer percentage per repository."""
    resolved = total(F.col("status") == "resolved")
    return comments.groupBy("repo").agg(
        F.count(F.lit(1)).alias("questions"),
        resolved.alias("resolved"),
        F.floor(resolved.cast("double") / F.count(F.lit(1)) * 100 + 0.5).cast("bigint").alias("rate"),
    )


def resolved_insights(comments: DataFrame, agents: list[str] = SYNTHESIS_AGENTS, k: int | None = None) -> DataFrame:
    """Resolved questions with their place in report order, or the first ``k`` of each repository, ranked."""
    position = F.array_position(F.array(*[F.lit(a) for a in agents]), F.col("agent"))
    resolved = comments.where((F.col("status") == "resolved") & F.col("agent").isin(agents))
    if k is None:
        return resolved.select("repo", position.alias("agent_pos"), "comment_no", "agent", "target", "question")
    order = Window.partitionBy("repo").orderBy(position, "comment_no")
    return (
        resolved.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("repo", "rank", "agent", "target", "question")
    )


# ---- prompts -----------------------------------------------------------------------------------------


def build_prompts(
    files: DataFrame,
    structure: DataFrame,
    agents: dict[str, str] = PROMPT_AGENTS,
    max_files: int | None = None,
    chars: int | None = None,
    part_chars: int = PART_CHARS,
) -> DataFrame:
    """Prompts of every repository and agent (key to name): ``repo, agent, part, parts, prompt, prompt_length``.

    The files that a scan includes are framed by their paths and put one after another by path; this text is cut every
    ``part_chars`` characters, and each part follows the repository's header.  Every file and character is in exactly
    one part, unless ``max_files`` or ``chars`` limits the files of a repository or the characters of a file.

    Places come from running sums of lengths, without texts; then each text meets its place and goes to its parts.  A
    part is built once, and what the header tells of its repository comes to it as a row of its own, so no task gets the
    texts of a whole repository; agents only multiply the finished text.  ``structure`` is the table of
    :func:`corpus_audit.operators.profile.repo_structure`; the header's language is that of most included files.
    """
    text = F.col("content") if chars is None else F.substring("content", 1, chars)
    shown = F.coalesce(F.when(text != "", text), F.lit(NO_CONTENT))
    frame = F.concat(F.lit("\n--- "), F.col("path"), F.lit(" ---\n"), shown, F.lit("\n"))
    framed = files.where(P.matches_glob(F.col("path"), P.DEFAULT_INCLUDES)).select("repo", "path", frame.alias("frame"))
    keys = framed.select("repo", "path", F.length("frame").cast("long").alias("n"))
    if max_files is not None:
        keys = cap_per_group(keys, max_files, ["repo"], ["path"])
    size = int(part_chars)
    places = placed(keys, ["repo"], ["path"], weight="n")
    first, last = F.expr(f"place div {size}"), F.expr(f"(place + n - 1) div {size}")
    spread = framed.join(places, ["repo", "path"]).withColumn("part", F.explode(F.sequence(first, last)))
    start = F.greatest(F.col("part") * size, F.col("place"))
    piece = F.substr("frame", (start - F.col("place") + 1).cast("int"), (F.least((F.col("part") + 1) * size, F.col("place") + F.col("n")) - start).cast("int"))
    bodies = spread.select("repo", "part", "place", piece.alias("piece")).groupBy("repo", "part").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "piece"))), lambda s: s["piece"]), "").alias("body")
    )
    facts = places.groupBy("repo").agg(F.count(F.lit(1)).alias("files"), F.expr(f"(first(total) - 1) div {size} + 1").alias("parts"))
    facts = facts.join(primary_language(places), "repo").join(structure.select("repo", "ts", "test", "has_api_routes"), "repo")
    facts = facts.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))

    def yes(flag: Column) -> Column:
        return F.when(flag, "Yes").otherwise("No")

    language = F.col("primary_language")
    fields = [
        F.when(language == "Unknown", UNKNOWN_KIND).otherwise(language), F.col("name"), F.col("files").cast("string"),
        F.when(language == "Unknown", UNKNOWN_LANGUAGE).otherwise(language), yes(F.col("ts") > 0), yes(F.col("test") > 0), yes(F.col("has_api_routes")),
    ]
    header = F.format_string(PROMPT_HEADER, *fields)
    named = F.explode(F.array(*[F.struct(F.lit(k).alias("agent"), F.lit(n).alias("name")) for k, n in agents.items()]))
    return (
        bodies.join(facts, ["repo", "part"])
        .withColumn("_agent", named)
        .select("*", "_agent.agent", "_agent.name")
        .select("repo", "agent", "part", "parts", F.concat(header, "body").alias("prompt"))
        .withColumn("prompt_length", F.length("prompt").cast("bigint"))
    )
