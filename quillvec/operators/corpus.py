"""Corpus reports: counts, nulls, lengths, terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows of each value, nulls left out."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))


def null_counts(df: DataFrame) -> DataFrame:
    """One row with the number of nulls of each column and of all."""
    each = [F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]
    total = sum((F.col(c) for c in df.columns[1:]), F.col(df.columns[0]))
    return df.agg(*each).withColumn("total", total)


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)).cast("bigint"))


def summary(df: DataFrame, value: Column, name: str = "value") -> DataFrame:
    """Mean, exact median, least, greatest and sum of a number; nulls count nothing."""
    v = df.select(value.alias(name))
    return v.agg(
        F.round(F.avg(name), 6).alias("mean"), F.median(name).cast("double").alias("median"), F.min(name).cast("bigint").alias("least"),
        F.max(name).cast("bigint").alias("greatest"), F.sum(name).cast("bigint").alias("total"),
    )


def term_frequencies(df: DataFrame, tokens: str | Column) -> DataFrame:
    return df.select(F.explode(tokens).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


def top_terms(df: DataFrame, tokens: str | Column, n: int = 20) -> DataFrame:
    """The `n` most frequent terms, ties by term."""
    return term_frequencies(df, tokens).orderBy(F.desc("n"), "term").limit(n)


def vocabulary_size(df: DataFrame, tokens: str | Column) -> DataFrame:
    return df.select(F.explode(tokens).alias("term")).agg(F.countDistinct("term").alias("vocabulary"))
