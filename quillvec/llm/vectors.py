"""Reading dirty vector columns, shared by the operators on vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def batch_matrix(column: pa.ListArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The lists of exactly `dim` finite, not all zero components as unit rows, and their row numbers."""
    lengths = np.diff(column.offsets.to_numpy())
    valid = (lengths == dim) & ~column.is_null().to_numpy(zero_copy_only=False)
    at = np.flatnonzero(valid)
    if not len(at):
        return np.zeros((0, dim), np.float32), at
    taken = column.take(pa.array(at))
    x = taken.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), dim)
    with np.errstate(all="ignore"):
        norm = np.sqrt((x * x).sum(1))
        good = np.isfinite(norm) & (norm > 0)
        return (x[good] / norm[good, None]).astype(np.float32), at[good]


def unit_vectors(df: DataFrame, id_col: str, vector_col: str, dim: int) -> DataFrame:
    """`id, node BIGINT, v BINARY`: usable vectors at unit length (32-bit floats), and a 64-bit hash of the vector.

    Null ids and vectors that are null, of another length, all zero, or with a
    null, NaN or infinite component are left out. A task gives each id only once.
    """
    x = F.col(vector_col)
    if df.select(x).schema[0].dataType.simpleString() != "array<float>":  # floats stay as narrow as they are on the way to Python
        x = x.cast("array<double>")
    rows = df.select(F.col(id_col).alias("id"), x.alias("x")).where(F.col("id").isNotNull() & (F.size("x") == dim))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            x, at = batch_matrix(batch.column(1), dim)
            ids = batch.column(0).take(pa.array(at)).to_pylist()
            keep = []
            for i, key in enumerate(ids):
                if key not in seen:
                    seen.add(key)
                    keep.append(i)
            blobs = [x[i].tobytes() for i in keep]
            node = np.array([xxhash.xxh3_64_intdigest(b) for b in blobs], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in keep], batch.schema.field(0).type), pa.array(node, pa.int64()), pa.array(blobs, pa.binary())], names=["id", "node", "v"])

    return rows.mapInArrow(read, f"id {rows.schema['id'].dataType.simpleString()}, node bigint, v binary")


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Binary rows of 32-bit floats as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dim)


def sample_matrix(units: DataFrame, n: int, rows: int, dim: int, seed: int) -> np.ndarray:
    """About `rows` of the `n` vectors, at random: the bounded sample on which an index or a start is fitted."""
    share = units if n <= rows else units.sample(fraction=rows / n, seed=seed)
    got = share.select("node", "v").limit(2 * rows).toPandas().sort_values("node")
    return np.frombuffer(b"".join(got["v"].tolist()), np.float32).reshape(-1, dim)


def squared_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None, :], 0)


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Centroids by Lloyd's rounds from spread-out starting points; empty ones restart at the farthest rows."""
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(x)))
    c = [x[rng.integers(len(x))]]
    nearest = squared_distances(x, c[0][None])[:, 0]
    for _ in range(k - 1):
        total = nearest.sum()
        pick = rng.choice(len(x), p=nearest / total) if total > 0 else rng.integers(len(x))
        c.append(x[pick])
        nearest = np.minimum(nearest, squared_distances(x, x[pick][None])[:, 0])
    c = np.array(c, np.float64)
    for _ in range(rounds):
        d = squared_distances(x, c)
        label, count = d.argmin(1), np.zeros(k)
        np.add.at(count, label, 1)
        total = np.zeros_like(c)
        order = np.argsort(label, kind="stable")
        some = np.flatnonzero(count)
        total[some] = np.add.reduceat(x[order].astype(np.float64), (np.cumsum(count) - count)[some].astype(np.int64), axis=0)
        empty = np.flatnonzero(count == 0)
        count[empty] = 1
        total[empty] = x[np.argsort(-d.min(1), kind="stable")[: len(empty)]]
        c = total / count[:, None]
    return c.astype(np.float32)
