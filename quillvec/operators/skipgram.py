"""Skip-gram word vectors with negative sampling, from counts of the pairs of neighbouring words.

The loss of a model over a corpus is a sum over pairs of words: each pair within
the window counts as often as it occurs, and each word has `negatives` drawn
words a pair. It depends on the text by these counts alone, so a round over the
counted pairs is a round over every token. Windows of a random width and drawn
words enter with their expected weights, without a sample: a pair at distance k
counts (window + 1 - k) / window, and every word c counts with its chance to be
drawn, in proportion to its frequency to the power of 0.75.

A round solves for the vectors of the words, then for those of the contexts.
While one side stands still, each row of the other has a convex loss of its own,
so rows need no order and no shared state: the model doesn't depend on
partitions. The work of a round grows with the square of the vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillvec.plans.lineage import cut, free_shuffles

from .arrow import to_lists

#: Cells (word, context) of a block of rows, which are looked at at once.
BLOCK_CELLS = 1 << 20
#: Tokens whose pairs a task counts at once, and counted pairs that it holds.
TOKENS_AT_ONCE = 1 << 20
PAIRS_HELD = 1 << 22
#: Share of the mean curvature that is added in every direction, so that it can be inverted.
RIDGE = 1e-3


def _add_up(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts."""
    key, n = np.concatenate(keys), np.concatenate(counts)
    if not len(key):
        return key, n
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[first], np.add.reduceat(n, first)


def _near(words: np.ndarray, docs: np.ndarray, window: int, width: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each distance the pairs of words of a document, lesser word first, as keys with counts weighted in units of 1 / window."""
    keys, counts = [], []
    for k in range(1, window + 1):
        same = docs[k:] == docs[:-k]
        a, b = words[k:][same], words[:-k][same]
        key, n = np.unique(np.minimum(a, b) * width + np.maximum(a, b), return_counts=True)
        keys.append(key)
        counts.append(n * (window + 1 - k))
    return keys, counts


def _block_rows(width: int) -> int:
    return max(1, BLOCK_CELLS // width)


def count_pairs(tokens: DataFrame, vocabulary: pa.Array, window: int) -> DataFrame:
    """`block INT, at BINARY, n BINARY`: for each block of rows its cells (int32 numbers, row by row) that are pairs, and their weights (floats).

    Both directions of a pair are there; words out of the vocabulary are left out
    before the windows are laid. A block without pairs has a row too.
    """
    spark, width = tokens.sparkSession, len(vocabulary)
    rows = _block_rows(width)
    shared = spark.sparkContext.broadcast(vocabulary)

    def blocks(key: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Held pairs in both directions; a word beside itself is both directions of one cell."""
        if not len(key):
            return
        a, b = np.divmod(key, width)
        other = a != b
        key, n = _add_up([key, b[other] * width + a[other]], [np.where(other, n, 2 * n), n[other]])
        block = key // (rows * width)
        start = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        for s, e in zip(start, np.r_[start[1:], len(key)], strict=True):
            at = (key[s:e] - block[s] * rows * width).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([block[s]], pa.int32()), pa.array([np.diff(at, prepend=np.int32(0)).tobytes()], pa.binary()), pa.array([n[s:e].tobytes()], pa.binary())], names=["block", "at", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        words, docs, waiting, seen = [], [], 0, 0
        for batch in batches:
            lists = batch.column(0)
            index = pc.index_in(lists.flatten(), value_set=shared.value)
            known = index.is_valid().to_numpy(zero_copy_only=False)
            lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            words.append(pc.fill_null(index, 0).to_numpy(zero_copy_only=False)[known].astype(np.int64))
            docs.append(np.repeat(np.arange(seen, seen + len(lists)), lengths)[known])
            seen, waiting = seen + len(lists), waiting + len(words[-1])
            if waiting >= TOKENS_AT_ONCE:
                keys, counts = _near(np.concatenate(words), np.concatenate(docs), window, width)
                held = _add_up([held[0], *keys], [held[1], *counts])
                words, docs, waiting = [], [], 0
                if len(held[0]) >= PAIRS_HELD:
                    yield from blocks(*held)
                    held = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        if waiting:
            keys, counts = _near(np.concatenate(words), np.concatenate(docs), window, width)
            held = _add_up([held[0], *keys], [held[1], *counts])
        yield from blocks(*held)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def whole(block: int, keys: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
            at, n = _add_up(keys, counts)
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([at.tobytes()], pa.binary()), pa.array([(n / window).astype(np.float32).tobytes()], pa.binary())], names=["block", "at", "n"])

        now, keys, counts = None, [], []
        for batch in batches:
            for i in range(batch.num_rows):
                block, at, n = (batch.column(c)[i].as_py() for c in range(3))
                if block != now:
                    if now is not None:
                        yield whole(now, keys, counts)
                    now, keys, counts = block, [], []
                keys.append(np.cumsum(np.frombuffer(at, np.int32), dtype=np.int32))
                counts.append(np.frombuffer(n, np.int64))
        if now is not None:
            yield whole(now, keys, counts)

    names = "block int, at binary, n binary"
    none = F.lit(b"")
    counted = tokens.select("tokens").mapInArrow(count, names).unionAll(spark.range(-(-width // rows)).select(F.col("id").cast("int").alias("block"), none.alias("at"), none.alias("n")))
    # every task of a round has some blocks, of equal work
    tasks = 4 * spark.sparkContext.defaultParallelism
    pairs = cut(counted.repartition(tasks, "block").sortWithinPartitions("block").mapInArrow(add, names), "pairs")
    shared.destroy()
    return pairs


def _cells(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for i in range(batch.num_rows):
        yield batch.column(0)[i].as_py(), np.frombuffer(batch.column(1)[i].as_buffer(), np.int32), np.frombuffer(batch.column(2)[i].as_buffer(), np.float32)


def _pair_sums(pairs: DataFrame, width: int) -> np.ndarray:
    """The weight of all pairs of each word."""
    rows, sums = _block_rows(width), np.zeros(width)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, at, n in _cells(batch):
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.bincount(at // width, n, rows).tobytes()], pa.binary())], names=["block", "x"])

    for block, x in _rows(pairs.mapInArrow(total, "block int, x binary")):
        here = sums[block * rows : (block + 1) * rows]
        here[:] = np.frombuffer(x, np.float64)[: len(here)]
    return sums


class Side(NamedTuple):
    """One side's vectors, and what each of its words weighs in the expected number of drawn pairs, a product of both sides' weights."""

    vectors: np.ndarray
    weight: np.ndarray


def solve_rows(x: np.ndarray, weight: np.ndarray, fixed: Side, turn: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Rows `x` after one step down their loss, against a fixed other side.

    The direction is the gradient, turned by the inverse `turn` of a curvature that
    all rows share; its length is Newton's, but under twice that of a parabola above
    the loss (Jaakkola and Jordan), so the loss of no row ever rises. `at` and `n`
    are the cells that are pairs.
    """
    y, b, width = fixed.vectors, fixed.weight.astype(np.float32), len(fixed.vectors)
    row = at // width
    chance = x @ y.T
    logit = np.abs(chance)
    np.negative(chance, out=chance)
    with np.errstate(over="ignore"):
        np.exp(chance, out=chance)
    chance += 1
    np.reciprocal(chance, out=chance)
    here = chance.ravel()[at]
    pull = chance * b
    pull *= weight[:, None]
    pull.ravel()[at] += n * (here - 1)
    slope = pull @ y
    along = -(slope @ turn)
    squares = np.matmul(along, y.T, out=pull)
    squares *= squares
    on_pairs = n * squares.ravel()[at]

    def curvature(cells: np.ndarray) -> np.ndarray:
        pairs = np.bincount(row, on_pairs * cells.ravel()[at], len(x))
        cells *= squares
        return weight * (cells @ b) + pairs

    above = np.abs(chance - 0.5)
    np.maximum(above, 2.5e-3, out=above)
    np.maximum(logit, 1e-2, out=logit)
    above /= logit
    chance *= 1 - chance
    most = np.maximum(curvature(chance), curvature(above) / 1.9)
    down = -(slope * along).sum(axis=1)
    return (x + np.where(most > 0, down / np.where(most > 0, most, 1), 0)[:, None] * along).astype(np.float32)


def _rows(df: DataFrame) -> Iterator[tuple[int, bytes]]:
    """Block numbers and bytes, one block at a time."""
    for batch in df.toArrow().to_batches():
        yield from zip(batch.column(0).to_pylist(), (x.as_buffer() for x in batch.column(1)), strict=True)


def _inverse(m: np.ndarray) -> np.ndarray:
    """The inverse of a positive definite matrix by elimination; the threaded one of LAPACK was seen to hang in a Spark driver."""
    m = m.copy()
    for i in range(len(m)):
        pivot, column = 1 / m[i, i], m[:, i].copy()
        row = m[i] * pivot
        m -= np.outer(column, row)
        m[i], m[:, i] = row, -column * pivot
        m[i, i] = pivot
    return m


def _half_round(pairs: DataFrame, moved: Side, fixed: Side, mass: np.ndarray) -> np.ndarray:
    """The vectors of `moved` after a step of all rows; `mass` is the weight of all cells of each word of `fixed`."""
    width, size = moved.vectors.shape
    y = fixed.vectors.astype(np.float64)
    curvature = (y * mass[:, None]).T @ y
    curvature *= size / np.trace(curvature)
    turn = _inverse(curvature + RIDGE * np.eye(size)).astype(np.float32)
    rows = _block_rows(width)
    shared = pairs.sparkSession.sparkContext.broadcast((moved, fixed, turn))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, other, turned = shared.value
        for batch in batches:
            for block, at, n in _cells(batch):
                here = slice(block * rows, (block + 1) * rows)
                x = solve_rows(own.vectors[here], own.weight[here].astype(np.float32), other, turned, at, n)
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["block", "x"])

    out = np.empty_like(moved.vectors)
    for block, x in _rows(pairs.mapInArrow(step, "block int, x binary")):
        out[block * rows : (block + 1) * rows] = np.frombuffer(x, np.float32).reshape(-1, size)
    shared.destroy()
    return out


def train_skipgram(tokens: DataFrame, size: int = 100, window: int = 5, min_count: int = 2, iterations: int = 20, negatives: int = 5, seed: int = 42) -> DataFrame:
    """`word, wv ARRAY<DOUBLE>` of every word that occurs `min_count` times in `tokens(tokens)`; zero for a word without neighbours.

    The driver and each task hold both sides, 8 x `size` bytes a word.
    """
    spark = tokens.sparkSession
    counts = tokens.select(F.explode("tokens").alias("word")).groupBy("word").agg(F.count("word").alias("n")).where((F.col("n") >= min_count) & F.col("word").isNotNull())
    with free_shuffles(spark):
        counts = counts.toArrow().sort_by([("n", "descending"), ("word", "ascending")])
    vocabulary, width = counts.column("word").combine_chunks(), counts.num_rows
    vectors = np.zeros((width, size), np.float32)
    if width:
        pairs = count_pairs(tokens, vocabulary, window)
        of_word = _pair_sums(pairs, width)
        drawn = counts.column("n").to_numpy() ** 0.75
        drawn /= drawn.sum()
        start = np.random.default_rng(seed).standard_normal((width, size)) / np.sqrt(size)
        words, contexts = Side(vectors, negatives * of_word), Side(start.astype(np.float32), drawn)
        for _ in range(iterations if of_word.any() else 0):
            words = words._replace(vectors=_half_round(pairs, words, contexts, of_word + words.weight.sum() * drawn))
            contexts = contexts._replace(vectors=_half_round(pairs, contexts, words, of_word + words.weight))
        vectors = words.vectors
    return spark.createDataFrame(pa.table({"word": vocabulary, "wv": to_lists(vectors)}))
