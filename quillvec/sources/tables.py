"""Parquet tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """`{directory}/{name}.parquet`; projections and filters of the caller reach the scan."""
    return spark.read.parquet(f"{directory}/{name}.parquet")
