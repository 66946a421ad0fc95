"""Summaries and checks of configuration keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_audit.functions import values as V
from corpus_audit.operators.metrics import total



def last_values(entries: DataFrame, order: Column) -> DataFrame:
    """One row per (repo, key): the value that comes last by ``order``."""
    return entries.groupBy("repo", "key").agg(F.max_by("value", order).alias("value"))


def key_metadata(entries: DataFrame) -> DataFrame:
    """Presence, sensitivity, length and type per key; never the value."""
    present = F.coalesce(F.col("value") != "", F.lit(False))
    return entries.select(
        "repo",
        "key",
        present.alias("present"),
        V.is_sensitive_key(F.col("key")).alias("sensitive"),
        F.when(present, F.length("value")).otherwise(0).cast("bigint").alias("length"),
        V.value_type(F.col("value")).alias("type"),
    )


def key_summary(entries: DataFrame, only_summary_keys: bool = False) -> DataFrame:
    """Totals per repository over :func:`key_metadata`."""
    chosen = entries.where(V.is_summary_key(F.col("key"))) if only_summary_keys else entries
    return (
        key_metadata(chosen)
        .groupBy("repo")
        .agg(
            F.count(F.lit(1)).alias("total"),
            total(F.col("present")).alias("present"),
            total(~F.col("present")).alias("missing"),
            total(F.col("sensitive")).alias("sensitive"),
        )
    )


def redact_table(entries: DataFrame, show_masked: bool = False) -> DataFrame:
    present = F.coalesce(F.col("value") != "", F.lit(False))
    return entries.select(
        "repo", "key", present.alias("present"), V.redact(F.col("key"), F.col("value"), show_masked).alias("shown")
    )


def sanitized(entries: DataFrame) -> DataFrame:
    return entries.select(
        "repo", "key", V.sanitize(F.col("key"), F.col("value")).alias("value"), V.url_problem(F.col("key"), F.col("value")).alias("url_problem")
    )


RULE_SCHEMA = "key string, required boolean, min_length int, max_length int, pattern string"


def rule_rows(spark: SparkSession, rules: list[dict]) -> DataFrame:
    """A rules table from dicts with ``key`` and optionally ``required`` (default true), ``min_length``, ``max_length``, ``pattern``."""
    rows = [(r["key"], r.get("required", True), r.get("min_length"), r.get("max_length"), r.get("pattern")) for r in rules]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def required_key_check(entries: DataFrame, rules: DataFrame, repos: DataFrame | None = None) -> DataFrame:
    """State of every required key in every repository: ok, missing or why it is invalid.

    ``entries`` holds one row per (repo, key).  ``rules`` is a table of ``key, required, min_length, max_length, pattern``; a
    null ``required`` is true, other nulls ask for nothing.  The result has a row for each repository and rule, so the
    rules are spelled out for every repository; the plan is the same for any number of them.  Only entries with a named
    key are joined.  ``repos`` (one or more rows for each ``repo``) adds repositories without any entry, whose keys are all
    missing.
    """
    named = entries.select("repo", "key", "value")
    known = named.select("repo") if repos is None else named.select("repo").union(repos.select("repo"))
    one = F.struct(*[F.col(c.split()[0]) for c in RULE_SCHEMA.split(", ")])
    asked = known.distinct().select("repo", F.explode(rules.agg(F.array_sort(F.collect_list(one))).scalar()).alias("rule")).select("repo", "rule.*")
    held = named.join(rules.select("key").distinct(), "key", "left_semi").groupBy("repo", "key").agg(F.max("value").alias("value"))
    key, cleaned = F.col("key"), V.clean_value(F.col("value"))
    state = (
        F.when((F.coalesce(cleaned, F.lit("")) == "") & F.coalesce("required", F.lit(True)), "missing")
        .when(F.coalesce(cleaned, F.lit("")) == "", "ok")
        .when(V.must_be_url(key) & ~V.is_url(cleaned), "not a URL")
        .when(F.length(cleaned) < F.col("min_length"), "too short")
        .when(F.length(cleaned) > F.col("max_length"), "too long")
        .when(~F.rlike(cleaned, F.col("pattern")), "pattern mismatch")
        .otherwise("ok")
    )
    return asked.join(held, ["repo", "key"], "left").select("repo", "key", state.alias("state"))


def configuration_validity(checks: DataFrame) -> DataFrame:
    """Missing and invalid required keys and the overall verdict per repository."""
    state = F.col("state")
    return checks.groupBy("repo").agg(
        total(state == "missing").alias("missing"),
        total(~state.isin("missing", "ok")).alias("invalid"),
        F.bool_and(state == "ok").alias("valid"),
    )
