"""Reading the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a data folder; columns are pruned by the plan that uses it."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
