"""Passing bounded numpy data to tasks and vectors between Spark and numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a side that is held by every task: queries, centroids, hyperplanes. A larger table is refused.
MAX_HELD_ROWS = 10_000


#: Rows of a table that is broadcast.
MAX_BROADCAST_ROWS = 1_000_000


def small(df: DataFrame, most: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """`df` with a broadcast hint if it has at most `most` rows, which are counted; else as it is, to be joined by a shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def to_matrix(column: pa.ListArray) -> np.ndarray:
    """Lists of equal length as rows of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def to_lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(np.ascontiguousarray(x, np.float64).ravel()))


def held_rows(df: DataFrame, id_col: str, vector_col: str, most: int = MAX_HELD_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a small table, in id order; a table beyond `most` rows is refused."""
    rows = df.select(id_col, vector_col).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows to hold in every task")
    rows.sort(key=lambda r: r[0])
    return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float64)


def l2sq_matrix(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)[None, :], 0.0)


def first_k(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the `k` least scores of each row, ties by id; `score` has a column for each of `ids`."""
    if score.shape[1] > k:
        limit = np.partition(score, k - 1, axis=1)[:, k - 1 : k]
        row, col = np.nonzero(score <= limit)
    else:
        row, col = (g.ravel() for g in np.indices(score.shape))
    order = np.lexsort((ids[col], score[row, col], row))
    row, col = row[order], col[order]
    start = np.searchsorted(row, np.arange(score.shape[0]))
    keep = np.arange(len(row)) - start[row] < k
    return row[keep], col[keep]
