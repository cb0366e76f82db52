"""Vector expressions over array columns. All arithmetic is in doubles, summed from left to right."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_doubles(v: str | Column) -> Column:
    return _col(v).cast("array<double>")


def _fold(terms: Column) -> Column:
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


def dot(a: str | Column, b: str | Column) -> Column:
    return _fold(F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: x * y))


def l2sq(a: str | Column, b: str | Column) -> Column:
    return _fold(F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: (x - y) * (x - y)))


def euclidean(a: str | Column, b: str | Column) -> Column:
    return F.sqrt(l2sq(a, b))


def norm(v: str | Column) -> Column:
    return F.sqrt(_fold(F.transform(as_doubles(v), lambda x: x * x)))


def l2_normalize(v: str | Column, epsilon: float | None = None) -> Column:
    """Unit length; a zero vector stays zero. With `epsilon` every norm gets it added instead."""
    n = norm(v)
    by = n + F.lit(epsilon) if epsilon is not None else F.when(n == 0, 1.0).otherwise(n)
    # the norm is repeated as an array: inside a lambda it would be computed again for every component
    return F.zip_with(as_doubles(v), F.array_repeat(by, F.size(_col(v))), lambda x, y: x / y)


def cosine(a: str | Column, b: str | Column) -> Column:
    """Cosine similarity, 0 where a vector is zero."""
    by = norm(a) * norm(b)
    return F.when(by > 0, dot(a, b) / by).otherwise(0.0)


def cosine_of_query(query: str | Column, v: str | Column) -> Column:
    """As `cosine`, but a zero query is an error."""
    checked = F.when(norm(query) == 0, F.raise_error(F.lit("the query vector has zero norm"))).otherwise(cosine(query, v))
    return checked.cast("double")


def dims(v: str | Column, d: int) -> Column:
    """The first `d` components; their length isn't restored."""
    return F.slice(_col(v), 1, d)


def usable_vectors(df: DataFrame, id_col: str, vector_col: str, dim: int) -> DataFrame:
    """`doc_id, v ARRAY<DOUBLE>`: one row for each id whose vector has `dim` components, none null or NaN, not all zero."""
    v = _col(vector_col)
    good = (F.size(v) == dim) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x)) & F.exists(v, lambda x: x != 0)
    # repeats go while the vectors are as narrow as they are stored
    return df.where(good).groupBy(F.col(id_col).alias("doc_id")).agg(F.first(v).alias("v")).select("doc_id", as_doubles("v").alias("v"))


def usable_unit_vectors(df: DataFrame, id_col: str, vector_col: str, dim: int) -> DataFrame:
    return usable_vectors(df, id_col, vector_col, dim).select("doc_id", l2_normalize("v").alias("v"))
