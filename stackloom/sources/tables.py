"""Reading the Parquet tables a query runs over."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` under ``sf_dir``, scanned lazily so that filters and
    column choice reach the Parquet reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
