"""Running totals of groups of which one may hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def before(rows: DataFrame, group: str, chunk: str, order: list[str], value: str, name: str = "before") -> DataFrame:
    """Adds the sum of ``value`` over the rows of a group that come earlier by (chunk, order).

    Sums run within a chunk; the totals of earlier chunks are added from a table with a row for each group and chunk.
    So no task needs more than a chunk of a group, however large the group is. Group and chunk aren't null.
    """
    inner = Window.partitionBy(group, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(group).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(group, chunk).agg(F.sum(value).alias("chunk_total"))
    totals = totals.select(group, chunk, F.coalesce(F.sum("chunk_total").over(outer), F.lit(0)).alias("chunk_start"))
    own = rows.withColumn("in_chunk", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return own.join(totals, [group, chunk]).withColumn(name, F.col("chunk_start") + F.col("in_chunk")).drop("chunk_start", "in_chunk")
