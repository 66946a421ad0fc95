"""The files table: reading it, choosing from it, limiting its text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpus_audit.functions import paths as P

FILES_SCHEMA = T.StructType(
    [
        T.StructField("repo", T.StringType(), False),
        T.StructField("path", T.StringType(), False),
        T.StructField("content", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("modified", T.TimestampType()),
    ]
)

# --- fixed values: text limits -----------------------------------------------------------------------
SECTION_CHARS = 2000
# --- end of fixed values -----------------------------------------------------------------------------


def load_files(spark: SparkSession, root: str, repo: Column | None = None) -> DataFrame:
    """Read every file under ``root`` as text, one row per file.

    ``repo`` defaults to the first directory below ``root``.  Paths are relative to the repository.  Bytes
    that are not UTF-8 become the replacement character.  Content is read only if a query uses it.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").split("://")[-1]
    relative = F.regexp_replace(F.expr("substring_index(path, '://', -1)"), "^file:/*", "/")
    relative = F.try_url_decode(F.replace(relative, F.lit("+"), F.lit("%2B")))
    below = F.element_at(F.split(relative, f"\\Q{base}\\E/", 2), -1)
    if repo is None:
        repo = F.when(F.contains(below, F.lit("/")), F.substring_index(below, "/", 1)).otherwise(F.lit(""))
        inner = F.when(
            F.contains(below, F.lit("/")), F.expr("substr(_below, instr(_below, '/') + 1)")
        ).otherwise(F.col("_below"))
    else:
        inner = F.col("_below")
    return raw.withColumn("_below", below).select(
        repo.alias("repo"),
        inner.alias("path"),
        F.make_valid_utf8(F.col("content").cast("string")).alias("content"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("modified"),
    )


def select_by_glob(files: DataFrame, globs: list[str] = P.DEFAULT_INCLUDES) -> DataFrame:
    """Files matching any glob, once each.

    All globs become one expression on the path, so a file that matches several still appears once and no
    de-duplication shuffle is needed as long as (repo, path) is a key of the table.
    """
    return files.where(P.matches_glob(F.col("path"), globs))


def select_files(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """Only the listed (repo, path) rows; paths that do not exist are dropped.

    A list that the optimizer knows to be short is broadcast and texts are filtered in place, else both sides are joined
    by key.
    """
    return files.join(wanted.select("repo", "path"), ["repo", "path"], "left_semi")


def listed_and_found(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """How many paths were listed and how many exist, per repository."""
    keys = files.select("repo", "path", F.lit(True).alias("_found"))
    return (
        wanted.select("repo", "path")
        .distinct()
        .join(keys, ["repo", "path"], "left")
        .groupBy("repo")
        .agg(F.count(F.lit(1)).alias("listed"), F.count("_found").alias("found"))
    )


def cap_content(files: DataFrame, chars: int | None = None, below_bytes: int | None = None) -> DataFrame:
    """The whole text, or its first ``chars`` characters; files of ``below_bytes`` and more keep none if that is given."""
    if chars is not None:
        files = files.withColumn("_text", F.substring("content", 1, chars))
    else:
        files = files.withColumn("_text", F.col("content"))
    if below_bytes is not None:
        size = F.col("size") if "size" in files.columns else F.octet_length("content")
        files = files.withColumn("_text", F.when(size < below_bytes, F.col("_text")))
    return files.withColumn("content", F.col("_text")).drop("_text")


def cap_per_group(table: DataFrame, k: int, by: list[str], order: list) -> DataFrame:
    """First ``k`` rows of every group.

    Spark applies the limit inside each task before the shuffle, so a group that holds most of the table
    still sends at most ``k`` rows per task.
    """
    window = Window.partitionBy(*by).orderBy(*order)
    return table.withColumn("_rank", F.row_number().over(window)).where(F.col("_rank") <= k).drop("_rank")
