"""Places of rows inside groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .lineage import settled


def numbered(rows: DataFrame, group: str, by: str, name: str) -> DataFrame:
    """``rows`` and ``name``: each one's place, from 0, by ``by`` among those of its ``group``.

    Rows are dealt by ranges of (group, by), so a very large group lies in many tasks. Each row's number in its range is
    known from the sort alone; what a group holds in earlier ranges is a sum over a row a group and range. Rows of a null
    group are numbered like others; rows equal in both columns, in any order. An empty table gives no rows.
    """
    at = F.monotonically_increasing_id()
    placed = settled(rows.repartitionByRange(group, by).sortWithinPartitions(group, by).select("*", at.alias("_at"), F.shiftright(at, 33).alias("_range")))
    parts = placed.groupBy(group, "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = F.sum("_n").over(W.partitionBy(group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    shift = parts.select(F.col(group).alias("_group"), F.col("_range").alias("_of"), (F.coalesce(earlier, F.lit(0)) - F.col("_first")).alias("_shift"))
    joined = placed.join(shift, (F.col("_range") == F.col("_of")) & F.col(group).eqNullSafe(F.col("_group")))
    return joined.withColumn(name, F.col("_at") + F.col("_shift")).drop("_at", "_range", "_group", "_of", "_shift")
