"""Places in a global order, made by all tasks together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored


def placed(rows: DataFrame, group: list[str], order: list[Column], out: str = "place") -> DataFrame:
    """The rows with their place from 0 in their group. Ties are broken arbitrarily, so order should have none.

    The rows are range-sorted over all tasks and written; each task's rows of a group are counted, and the counts of
    the tasks before give every row its place. No group and no run of equal rows meets in one task.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*map(F.asc, group), *order]
    spread = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    kept = stored(spread.withColumn("__p", F.spark_partition_id()).withColumn("__i", within), "placed")
    counts = kept.groupBy(*group, "__p").agg(F.count(F.lit(1)).alias("__n"), F.min("__i").alias("__first"))
    before = F.sum("__n").over(Window.partitionBy(*group).orderBy("__p")) - F.col("__n")
    counts = counts.select(*group, "__p", (before - F.col("__first")).alias("__by"))
    return kept.join(counts, [*group, "__p"]).withColumn(out, F.col("__i") + F.col("__by")).drop("__p", "__i", "__by")
