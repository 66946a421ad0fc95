"""Places and running sums inside groups that may hold most of a table.

A window over such a group would sort it in one task.  Here rows are sorted over ranges of group and order, so a
large group is spread; what each range holds of a group is added up once, and those few sums give every range its
offset.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.  A local session without one gets a temporary folder; on a cluster, whose
    machines don't share theirs, that is an error."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
        context.setCheckpointDir(folder)
    return folder


def written(table: DataFrame, name: str) -> DataFrame:
    """``table`` written to the shared folder and read again, so that everything built on it sees the same rows."""
    path = f"{shared_folder(table.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    table.write.parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


def placed(rows: DataFrame, group: list[str], order: list[str], weight: str | None = None) -> DataFrame:
    """``rows`` with ``place`` and ``total``: how many rows of the group come before by ``order``, and how many it has.

    With ``weight``, a column of numbers, these are its sums instead of counts.  Null groups are groups like others; rows
    that are equal in ``order`` follow each other in no set order.
    """
    ranged = rows.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    ranged = written(ranged.withColumn("_at", F.monotonically_increasing_id()), "placed").withColumn("_range", F.shiftright("_at", 33))
    size = F.count(F.lit(1)) if weight is None else F.sum(weight)
    ranges = ranged.groupBy(*group, "_range").agg(F.min("_at").alias("_first"), size.alias("_size"))
    whole = Window.partitionBy(*group)
    before = F.coalesce(F.sum("_size").over(whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select(
        *[F.col(c).alias(f"_group_{c}") for c in group], F.col("_range").alias("_of"), "_first", before.alias("_before"), F.sum("_size").over(whole).alias("total")
    )
    same = F.col("_range") == F.col("_of")
    for c in group:
        same = same & ranged[c].eqNullSafe(F.col(f"_group_{c}"))
    if weight is None:
        inside = F.col("_at") - F.col("_first")
    else:
        here = Window.partitionBy(*group, "_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
        ranged = ranged.withColumn("_inside", F.coalesce(F.sum(weight).over(here), F.lit(0)))
        inside = F.col("_inside")
    return ranged.join(ranges, same).select(*rows.columns, (inside + F.col("_before")).cast("long").alias("place"), F.col("total").cast("long").alias("total"))
