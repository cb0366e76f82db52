"""Ranking within groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def topk(df: DataFrame, partition: str | list[str], order: list[str | Column], k: int, rank: str = "rank") -> DataFrame:
    """The first `k` rows of each group with their rank from 1. The order has to end in a unique column."""
    w = Window.partitionBy(partition).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)
