"""Reading the Parquet tables a query runs over."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The table ``name`` below ``root``: one Parquet file or a folder of them."""
    return spark.read.parquet(f"{root}/{name}.parquet")
