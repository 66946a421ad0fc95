"""Markdown reports: sections in, one document per repository and agent out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def issue_sections(grouped: DataFrame, agent: str, section: str, position: int) -> DataFrame:
    """Section rows from :func:`corpus_audit.operators.rollup.group_issues`.

    Grouped issues hold the lines of one part of a report, so a section stays small however many issues there are.
    """
    block = F.concat(
        F.lit("**"),
        F.col("type"),
        F.lit("** ("),
        F.col("issues").cast("string"),
        F.lit(" issues):\n"),
        F.array_join(F.transform("lines", lambda l: F.concat(F.lit("- "), l, F.lit("\n"))), ""),
    )
    return grouped.select(
        "repo",
        F.lit(agent).alias("agent"),
        F.lit(position).alias("position"),
        F.lit(section).alias("section"),
        F.col("type").alias("item"),
        block.alias("body"),
        "part",
    )


def bullet_sections(rows: DataFrame, agent: str, section: str, position: int, item: str) -> DataFrame:
    """Section rows that become bullets, one per row of a capped table."""
    return rows.select(
        "repo",
        F.lit(agent).alias("agent"),
        F.lit(position).alias("position"),
        F.lit(section).alias("section"),
        F.col(item).cast("string").alias("item"),
        F.concat(F.lit("- "), F.col(item).cast("string")).alias("body"),
        F.lit(0).cast("long").alias("part"),
    )


def render_reports(sections: DataFrame, title: str) -> DataFrame:
    """Markdown documents: one per repository, agent and part.

    ``sections`` rows are (repo, agent, position, section, item, body, part).  Summaries and top-k lists stand in part 0;
    issue lists come in parts of a bounded number of lines, all of which are there.
    """
    by_section = sections.groupBy("repo", "agent", "part", "position", "section").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("item", "body"))), lambda s: s["body"]), "\n"
        ).alias("text")
    )
    framed = F.concat(F.lit("#### "), F.col("section"), F.lit("\n\n"), F.col("text"), F.lit("\n\n"))
    return by_section.groupBy("repo", "agent", "part").agg(
        F.concat(
            F.lit(f"### {title}\n\n"),
            F.array_join(
                F.transform(
                    F.array_sort(F.collect_list(F.struct("position", framed.alias("framed")))),
                    lambda s: s["framed"],
                ),
                "",
            ),
        ).alias("content")
    )


def write_reports(reports: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write reports as Parquet, one directory per agent."""
    reports.write.mode(mode).partitionBy("agent").parquet(path)


def write_markdown(reports: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write report texts as plain text, one directory per agent."""
    reports.select("agent", F.col("content").alias("value")).write.mode(mode).partitionBy("agent").text(path)
