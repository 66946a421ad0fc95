"""Detectors on files as they arrive.

Rules look at one file at a time and keep no state, so a streaming files table goes through the very same
:func:`corpus_audit.operators.detect.detect` as a batch one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from corpus_audit.operators.detect import detect
from corpus_audit.operators.rules import Family


def issue_stream(arriving: DataFrame, *families: Family) -> DataFrame:
    """Issues of a streaming (or batch) files table."""
    return detect(arriving, *families)


def write_issue_stream(
    issues: DataFrame, path: str, name: str, checkpoint: str | None = None, **trigger
) -> StreamingQuery:
    """Append issues as Parquet by family.

    Progress is kept below ``checkpoint``, by default in the shared folder the cluster names in
    ``spark.checkpoint.dir``, so a lost executor or driver resumes without repeating or losing files.
    """
    if checkpoint is None:
        shared = issues.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared:
            raise ValueError("name a checkpoint folder or set spark.checkpoint.dir")
        checkpoint = f"{shared.rstrip('/')}/{name}"
    return (
        issues.writeStream.queryName(name)
        .format("parquet")
        .partitionBy("family")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start(path)
    )
