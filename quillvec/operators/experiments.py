"""Sweeps, timing, and the comparison of result tables."""

from __future__ import annotations

import time
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillvec.functions.vectors import dims as dims_prefix
from quillvec.plans.lineage import cut


def sample_ids(n: int, size: int, seed: int = 42) -> list[int]:
    """`size` of the ids 0 to n - 1 without replacement, as the seeded legacy generator draws them."""
    return [int(i) for i in np.random.RandomState(seed).choice(n, size, replace=False)]


def sample_stream(n: int, sizes: list[int], seed: int = 42) -> list[list[int]]:
    """Several samples without replacement, one after the other from the same stream, as later experiments draw theirs after the first."""
    stream = np.random.RandomState(seed)
    return [[int(i) for i in stream.choice(n, min(size, n), replace=False)] for size in sizes]


def sampled_queries(vectors: DataFrame, ids: list[int]) -> DataFrame:
    return vectors.where(F.col("doc_id").isin(ids)).select(F.col("doc_id").alias("qid"), F.col("v").alias("qv"))


def timed(build: Callable[[], DataFrame]) -> tuple[DataFrame, float]:
    """The frame, and the seconds that computing all its rows took."""
    began = time.perf_counter()
    df = build()
    df.write.format("noop").mode("overwrite").save()
    return df, time.perf_counter() - began


def scaling(vectors: DataFrame, queries: DataFrame, method: str, build: Callable[[DataFrame, DataFrame], DataFrame], search: Callable[[DataFrame, DataFrame], DataFrame], sizes: list[int], dims: list[int]) -> DataFrame:
    """`method, N, dim, build_time, query_time` over row prefixes and dimension prefixes.

    `build(vectors, queries)` makes an index, which is written to the shared
    folder, and `search(index, queries)` answers all queries from it; each is
    timed as a whole, and the query time is divided by the number of queries.
    """
    spark, out, n = vectors.sparkSession, [], max(1, queries.count())
    for size in sizes:
        for d in dims:
            part = vectors.where(F.col("doc_id") < size).select("doc_id", dims_prefix("v", d).alias("v"))
            asked = queries.select("qid", dims_prefix("qv", d).alias("qv"))
            began = time.perf_counter()
            index = cut(build(part, asked), "index")
            built = time.perf_counter() - began
            _, searched = timed(lambda index=index, asked=asked: search(index, asked))
            out.append((method, size, d, built, searched / n))
    return spark.createDataFrame(out, "method string, N bigint, dim int, build_time double, query_time double")


def clip(value: int, least: int, most: int) -> int:
    return int(min(max(value, least), most))


def lsh_bits(dim: int, bands: int = 16) -> int:
    """Bits for a dimension: twice as many, a multiple of the bands, between the bands and 256."""
    return clip(2 * dim // bands * bands, bands, 256)


def pq_parts(dim: int, width: int = 50) -> int:
    """Subvectors for a dimension: one for each `width` components, at least two."""
    return max(2, dim // width)


def union_by_name(*frames: DataFrame) -> DataFrame:
    """All rows; a column that a frame lacks is null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def best_per_group(df: DataFrame, group: str | Column, value: str, order: list[str | Column]) -> DataFrame:
    """The row of the greatest value of each group; `order` says which goes first among equals. Null values lose."""
    w = Window.partitionBy(group).orderBy(F.desc_nulls_last(value), *order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def lookup(spark: SparkSession, keys: list[str], df: DataFrame, key: str, value: str, order: list[str | Column]) -> DataFrame:
    """`key, value` for each of `keys`: that of the first of its rows, NaN for a key without any."""
    w = Window.partitionBy(key).orderBy(*order)
    first = df.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(key, value)
    listed = spark.createDataFrame([(k,) for k in keys], f"{key} string")
    return F.broadcast(listed).join(first, key, "left").select(key, F.coalesce(F.col(value).cast("double"), F.lit(float("nan"))).alias(value))


def method_name(column: str | Column) -> Column:
    """One spelling for each method: trimmed, upper case, words joined by a hyphen."""
    c = F.col(column) if isinstance(column, str) else column
    return F.regexp_replace(F.upper(F.trim(c)), "[_ ]+", "-")
