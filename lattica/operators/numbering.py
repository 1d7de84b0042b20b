"""Places of rows in an order of the whole table, without a window over all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.sources.shared import stage


def numbered_rows(df: DataFrame, order: list[str | Column], name: str, first: int = 0) -> tuple[DataFrame, int]:
    """The rows with their places in an order of the whole table, and how many there are.

    Sorted partitions are written once; a row's place is the number of rows in earlier partitions and its own in its
    partition.  One count per partition reaches the driver, and nothing is ordered in a single task.
    """
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stage(ordered.withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id() % (1 << 33)), "numbered")
    counts, starts, at = {r["__p"]: r["n"] for r in placed.groupBy("__p").agg(F.count(F.lit(1)).alias("n")).collect()}, [], first
    for p in sorted(counts):
        starts.append((p, at))
        at += counts[p]
    base = df.sparkSession.createDataFrame(starts, "__p int, __base long")  # one row for each task of the write above
    return placed.join(F.broadcast(base), "__p").withColumn(name, F.col("__base") + F.col("__i")).drop("__p", "__i", "__base"), at - first
