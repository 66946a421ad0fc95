"""Package manifests and the dependencies they list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MANIFEST = "package.json"


def manifests(files: DataFrame) -> DataFrame:
    """Root manifest of every repository; text that is no JSON object gives NULL fields and valid=false."""
    parsed = files.where(F.col("path") == MANIFEST).select(
        "repo", F.try_parse_json("content").alias("v")
    )

    def words(name: str):
        return F.coalesce(
            F.try_variant_get("v", f"$.{name}", "map<string,string>"), F.create_map().cast("map<string,string>")
        )

    listed, dev = words("dependencies"), words("devDependencies")
    return parsed.select(
        "repo",
        F.coalesce(F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")), F.lit(False)).alias("valid"),
        F.try_variant_get("v", "$.name", "string").alias("name"),
        F.try_variant_get("v", "$.main", "string").alias("main"),
        words("scripts").alias("scripts"),
        # A package listed twice keeps the development version.
        F.map_concat(F.map_filter(listed, lambda k, _: ~F.array_contains(F.map_keys(dev), k)), dev).alias(
            "dependencies"
        ),
    )


def dependencies(parsed: DataFrame) -> DataFrame:
    """One row per dependency of every manifest."""
    return parsed.select("repo", F.explode("dependencies").alias("name", "version"))
