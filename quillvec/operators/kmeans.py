"""K-means: deterministic Lloyd rounds over all rows, and MLlib's variant."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillvec.plans.lineage import cut

from .arrow import l2sq_matrix, to_matrix


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.round(l2sq_matrix(x, centers), 9).argmin(1)


def _sums(x: np.ndarray, label: np.ndarray, k: int) -> np.ndarray:
    """Rows and summed rows of each label: k x (1 + dimension)."""
    out = np.zeros((k, 1 + x.shape[1]))
    if len(x):
        order = np.argsort(label, kind="stable")
        count = np.bincount(label, minlength=k)
        some = np.flatnonzero(count)
        out[:, 0] = count
        out[some, 1:] = np.add.reduceat(x[order], (np.cumsum(count) - count)[some], axis=0)
    return out


def lloyd(docs: DataFrame, k: int, rounds: int, subspaces: int = 1, stored: bool = False) -> list[np.ndarray]:
    """Centroids of each of `subspaces` equal slices of `docs(doc_id, v)`, from the `k` least ids, after `rounds` rounds.

    The result doesn't depend on partitioning (but for the last bits of sums). A
    centroid that loses all its rows is dropped, and the others keep their
    numbers, so that rows of a dropped one are NaN. Fewer than `k` rows give as
    many centroids as rows. `stored` says that `docs` is a table that is cheap to
    read in every round; else it is written first.
    """
    docs = docs.select("doc_id", F.col("v").cast("array<double>").alias("v"))
    if not stored:
        docs = cut(docs, "lloyd")
    first = docs.orderBy("doc_id").limit(k).select("v").collect()
    if not first:
        return [np.zeros((0, 0)) for _ in range(subspaces)]
    start = np.array([r.v for r in first], np.float64)
    if start.shape[1] % subspaces:
        raise ValueError("the dimension has to be a multiple of the number of subspaces")
    books = np.split(start, subspaces, axis=1)
    return _rounds(docs.select("v"), books, rounds)


def _rounds(vectors: DataFrame, books: list[np.ndarray], rounds: int) -> list[np.ndarray]:
    """The centroids after `rounds` rounds over all rows of `vectors(v)`; only sums reach the driver."""
    subspaces, k, width = len(books), len(books[0]), books[0].shape[1]
    for _ in range(rounds):
        shared = vectors.sparkSession.sparkContext.broadcast(books)

        def step(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total = np.zeros((subspaces, k, 1 + width))
            for batch in batches:
                for s, part in enumerate(np.split(to_matrix(batch.column(0)), subspaces, axis=1)):
                    total[s] += _sums(part, _nearest(part, _filled(shared.value[s])), k)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel())], names=["slot", "value"])

        sums = np.zeros(subspaces * k * (1 + width))
        got = vectors.mapInArrow(step, "slot int, value double").groupBy("slot").agg(F.sum("value").alias("value")).toPandas()
        sums[got["slot"].to_numpy(np.int64)] = got["value"].to_numpy(float)
        sums = sums.reshape(subspaces, k, 1 + width)
        with np.errstate(invalid="ignore", divide="ignore"):
            books = [s[:, 1:] / s[:, :1] for s in sums]
        shared.unpersist()
    return books


#: Rows of the sample on which centroids are trained, rounds over it at most, and the share of the total variance by which a round moves centroids when it ends.
SAMPLE_ROWS, MOST_ROUNDS, TOLERANCE = 20_000, 100, 1e-4


def spread_out(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """`k` rows, each drawn with a chance in proportion to its squared distance from those before (k-means++), the best of a few draws."""
    centers = [x[rng.integers(len(x))]]
    nearest = l2sq_matrix(x, centers[0][None])[:, 0]
    tries = 2 + int(np.log(k)) if k > 1 else 1
    for _ in range(k - 1):
        total = nearest.sum()
        drawn = rng.choice(len(x), tries, p=nearest / total) if total > 0 else rng.integers(len(x), size=1)
        after = np.minimum(nearest[:, None], l2sq_matrix(x, x[drawn]))
        best = int(after.sum(0).argmin())
        centers.append(x[drawn[best]])
        nearest = after[:, best]
    return np.array(centers)


def train(docs: DataFrame, k: int = 200, rounds: int = 2, seed: int = 42, sample_rows: int = SAMPLE_ROWS, subspaces: int = 1) -> list[np.ndarray]:
    """Centroids of each of `subspaces` slices of the stored table `docs(doc_id, v)`, at most as many as rows.

    They are spread out and moved until they stand still on a bounded sample of
    the rows; where the sample isn't the whole table, `rounds` more go over all
    rows. An empty cell takes the row farthest from its centroid.
    """
    n = docs.count()
    some = docs if n <= sample_rows else docs.sample(fraction=sample_rows / n, seed=seed)
    held = some.select("doc_id", "v").limit(2 * sample_rows).toArrow().sort_by("doc_id").column("v").combine_chunks()
    if not len(held):
        return [np.zeros((0, 0)) for _ in range(subspaces)]
    whole = to_matrix(held)
    if whole.shape[1] % subspaces:
        raise ValueError("the dimension has to be a multiple of the number of subspaces")
    books = []
    for s, x in enumerate(np.split(whole, subspaces, axis=1)):
        c = spread_out(x, min(k, len(x)), np.random.default_rng(seed + s))
        for _ in range(MOST_ROUNDS):
            d = l2sq_matrix(x, c)
            label = d.argmin(1)
            sums = _sums(x, label, len(c))
            empty = np.flatnonzero(sums[:, 0] == 0)
            sums[empty, 0], sums[empty, 1:] = 1, x[np.argsort(-d.min(1), kind="stable")[: len(empty)]]
            moved = sums[:, 1:] / sums[:, :1]
            shift, c = ((moved - c) ** 2).sum(), moved
            if shift <= TOLERANCE * x.var(0).mean():
                break
        books.append(c)
    if n > sample_rows:
        books = _rounds(docs.select("v"), books, rounds)
    return books


def inertia(docs: DataFrame, centers: np.ndarray) -> float:
    """Summed squared distances to the nearest centroids."""
    shared = docs.sparkSession.sparkContext.broadcast(_filled(centers))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(float(l2sq_matrix(to_matrix(b.column(0)), shared.value).min(1).sum()) for b in batches if b.num_rows)
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.float64())], names=["x"])

    return float(docs.select("v").mapInArrow(add, "x double").agg(F.sum("x")).first()[0] or 0.0)


def _filled(centers: np.ndarray) -> np.ndarray:
    """Dropped centroids moved where no row is nearest to them."""
    return np.where(np.isnan(centers), 1e12, centers)


def centroid_table(docs: DataFrame, centers: np.ndarray) -> DataFrame:
    """`cid INT, cv ARRAY<DOUBLE>` of the centroids that have rows."""
    rows = [(i, c.tolist()) for i, c in enumerate(centers) if not np.isnan(c).any()]
    return docs.sparkSession.createDataFrame(rows, "cid int, cv array<double>")


def assign(docs: DataFrame, centers: np.ndarray, column: str = "cid") -> DataFrame:
    """`docs` with the number of the nearest centroid, ties by the smaller number."""
    shared = docs.sparkSession.sparkContext.broadcast(_filled(centers))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = to_matrix(batch.column(1))
            cid = _nearest(x, shared.value) if len(x) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cid, pa.int32())], names=["doc_id", "v", column])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("v").cast("array<double>")).mapInArrow(near, f"doc_id bigint, v array<double>, {column} int")


def mllib_kmeans(docs: DataFrame, k: int, seed: int = 42, max_iter: int = 20) -> np.ndarray:
    """Centroids of MLlib's k-means; with a fixed seed they still depend on partitioning."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    fitted = KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="f").fit(docs.select(array_to_vector("v").alias("f")))
    return np.array(fitted.clusterCenters())
