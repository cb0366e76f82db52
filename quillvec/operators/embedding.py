"""Document vectors: pooled word vectors, tf-idf, and latent semantic indexing."""

from __future__ import annotations

import tempfile
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillvec.functions.ranking import topk
from quillvec.functions.vectors import norm
from quillvec.plans.lineage import cut, free_shuffles, sweep

from .arrow import small, to_lists


#: Rows that one partition trains on.
TRAINING_ROWS = 50_000


def train_word2vec(tokens: DataFrame, size: int = 200, window: int = 5, min_count: int = 5, seed: int = 42, iterations: int = 1, partitions: int | None = None):
    """MLlib's skip-gram model over `tokens(doc_id, tokens)`.

    A table of up to TRAINING_ROWS rows is trained in one partition, which makes
    the model repeatable; a larger one in so many that each has about that many.
    """
    from pyspark.ml.feature import Word2Vec

    if partitions is None:
        partitions = max(1, -(-tokens.count() // TRAINING_ROWS))
    model = Word2Vec(vectorSize=size, windowSize=window, minCount=min_count, seed=seed, numPartitions=partitions, maxIter=iterations, inputCol="tokens", outputCol="v")
    return model.fit(tokens.select("tokens"))


def word_vectors(model) -> DataFrame:
    """`word, wv ARRAY<DOUBLE>` of a fitted model."""
    from pyspark.ml.functions import vector_to_array

    return model.getVectors().select("word", vector_to_array("vector").alias("wv"))


def mean_pool(tokens: DataFrame, words: DataFrame, dim: int) -> DataFrame:
    """`doc_id, v`: the mean of the vectors of a document's known tokens, counted as often as they occur; zero without any.

    Tokens are counted per document and word before the join, and only sums of
    `dim` numbers are shuffled by document.
    """
    counts = tokens.select("doc_id", F.explode("tokens").alias("word")).groupBy("doc_id", "word").count()
    known = counts.join(words, "word")
    sums = [F.sum(F.col("wv")[i] * F.col("count")) for i in range(dim)]
    pooled = known.groupBy("doc_id").agg(F.sum("count").alias("n"), F.array(*sums).alias("s"))
    mean = F.transform("s", lambda x: x / F.col("n"))
    zero = F.array_repeat(F.lit(0.0), dim)
    return tokens.select("doc_id").distinct().join(pooled, "doc_id", "left").select("doc_id", F.coalesce(mean, zero).alias("v"))


def tfidf(tokens: DataFrame) -> DataFrame:
    """`doc_id, term, tf, w` with w = tf * (ln((N + 1) / (df + 1)) + 1)."""
    counts = tokens.select("doc_id", F.explode("tokens").alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    tf = cut(counts, "tf")  # counted once for both uses
    # a small vocabulary goes to the counts, which then stay where they are, the commonest terms too
    df = small(tf.groupBy("term").agg(F.count("*").alias("df")))
    n = tokens.agg(F.countDistinct("doc_id").alias("n_docs"))
    w = F.col("tf") * (F.log((F.col("n_docs") + 1) / (F.col("df") + 1)) + 1)
    return tf.join(df, "term").crossJoin(F.broadcast(n)).select("doc_id", "term", "tf", F.round(w, 6).alias("w"))


def nearest_words(model, words: DataFrame, k: int = 3) -> DataFrame:
    """`word, rank, near, similarity`: the nearest other words of each of `words(word)`, a small table, by the model's vectors."""
    return nearest_by_vectors(word_vectors(model), words, k)


def nearest_by_vectors(vectors: DataFrame, words: DataFrame, k: int = 3) -> DataFrame:
    """As `nearest_words`, by a table `vectors(word, wv)`."""
    asked = vectors.join(F.broadcast(words), "word").select(F.col("word").alias("asked"), F.col("wv").alias("av"))
    scored = vectors.join(F.broadcast(asked), F.col("word") != F.col("asked")).select("asked", "word", F.round(cosine_with_epsilon("wv", "av"), 6).alias("similarity"))
    return topk(scored, "asked", [F.desc("similarity"), "word"], k).select(F.col("asked").alias("word"), "rank", F.col("word").alias("near"), "similarity")


def cosine_with_epsilon(a: Column | str, b: Column | str, epsilon: float = 1e-10) -> Column:
    from quillvec.functions.vectors import dot

    return dot(a, b) / (norm(a) * norm(b) + F.lit(epsilon))


#: Documents that are multiplied at once, and terms of one block of sums.
DOCS_AT_ONCE = 32
TERM_BLOCK = 1024
#: Numbers of the term side, of four bytes, that driver and tasks hold at once, and rows of it that the driver turns at once.
HELD_NUMBERS = 18_000_000
ROWS_AT_ONCE = 4096


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for s in range(0, batch.num_rows, DOCS_AT_ONCE):
        yield batch.slice(s, DOCS_AT_ONCE)


def _dense(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The terms of sparse rows (columns 1 and 2: term numbers and weights), and the rows as a matrix over these terms only."""
    seen, column = np.unique(batch.column(1).flatten().to_numpy(), return_inverse=True)
    m = np.zeros((batch.num_rows, len(seen)), np.float32)
    m[np.repeat(np.arange(batch.num_rows), np.diff(batch.column(1).offsets.to_numpy())), column] = batch.column(2).flatten().to_numpy()
    return seen, m


def _spans(width: int, columns: int) -> list[tuple[int, int]]:
    """Stretches of columns, each of at most HELD_NUMBERS numbers with `width` rows, or of one column."""
    n = -(-columns // max(1, HELD_NUMBERS // width))
    ends = [columns * i // n for i in range(n + 1)]
    return list(zip(ends[:-1], ends[1:], strict=True))


def _on_disk(rows: int, columns: int) -> np.ndarray:
    """A matrix of floats in an unnamed file of the driver, which goes with the matrix; pages in memory are given back when others need it."""
    with tempfile.TemporaryFile() as f:
        return np.memmap(f, np.float32, "w+", shape=(rows, columns))


def _row_blocks(q: np.ndarray) -> Iterator[slice]:
    for s in range(0, len(q), ROWS_AT_ONCE):
        yield slice(s, s + ROWS_AT_ONCE)


def _orthonormal(q: np.ndarray) -> None:
    """Make the columns of `q` orthonormal where they lie."""
    for _ in range(2):  # again, for what rounding leaves
        r = np.zeros((0, q.shape[1]))
        for rows in _row_blocks(q):
            r = np.linalg.qr(np.vstack([r, q[rows]]), mode="r")  # in doubles, as r is
        values, turn = np.linalg.svd(r)[1:]
        kept = values > 1e-14 * values[:1]
        by = turn.T * np.where(kept, 1 / np.where(kept, values, 1), 0)
        for rows in _row_blocks(q):
            q[rows] = q[rows] @ by


@dataclass
class LSI:
    """Truncated SVD of the document-term matrix; documents are scaled left vectors, queries are projected on terms.

    The vocabulary is every term, or the `max_terms` most frequent (by documents,
    ties by term) if that is given. The driver holds the terms; the `k` + 10 numbers
    of each are floats in a file of its disk, of which HELD_NUMBERS at once, whole
    columns, are in the memory of driver and tasks. Sums are taken in doubles.
    """

    k: int = 200
    max_terms: int | None = None
    passes: int = 4
    terms: list[str] | None = None
    idf: np.ndarray | None = None
    sigma: np.ndarray | None = None
    term_vectors: np.ndarray | None = None  # terms x k, on disk
    rows: DataFrame | None = None  # doc_id, t, w: the terms of each document that has any
    documents: DataFrame | None = None  # doc_id

    def fit(self, tokens: DataFrame) -> LSI:
        """Subspace iteration from random directions: each pass over the documents multiplies them by both sides of the matrix."""
        weights = tfidf(tokens)
        vocabulary = weights.groupBy("term").agg(F.count("*").alias("df"))
        if self.max_terms is not None:
            vocabulary = vocabulary.orderBy(F.desc("df"), "term").limit(self.max_terms)
        vocabulary = vocabulary.toArrow().sort_by("term")
        self.terms = vocabulary.column("term").to_pylist()
        n, width = tokens.select("doc_id").distinct().count(), len(self.terms)
        if not width:
            raise ValueError("no terms to fit on")
        self.idf = np.log((n + 1) / (vocabulary.column("df").to_numpy() + 1)) + 1
        index = tokens.sparkSession.createDataFrame(pa.table({"term": vocabulary.column("term"), "t": pa.array(np.arange(width), pa.int32())}))
        rows = weights.join(small(index), "term").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("t", "w"))).alias("e"))
        self.rows = rows = cut(rows.select("doc_id", F.col("e.t").alias("t"), F.col("e.w").alias("w")), "lsi")
        self.documents = tokens.select("doc_id").distinct()
        del weights, vocabulary, index
        sweep(collect=True)  # the counts aren't read again
        k = min(self.k, width)
        q = _on_disk(width, min(width, k + 10))
        start = np.random.default_rng(42)
        for at in _row_blocks(q):
            q[at] = start.standard_normal(q[at].shape)
        _orthonormal(q)
        spans = _spans(*q.shape)
        for _ in range(self.passes):
            for first, last in spans:  # a column needs no other one, so it takes its own place
                self._both_sides(rows, q[:, first:last], q[:, first:last])
            _orthonormal(q)
        inner = np.zeros((q.shape[1], q.shape[1]))
        for first, last in spans:
            z = np.empty((width, last - first), np.float32)
            self._both_sides(rows, q[:, first:last], z)
            inner[:, first:last] = sum(q[at].T.astype(np.float64) @ z[at] for at in _row_blocks(q))
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        order = np.argsort(-values)
        self.sigma = np.sqrt(np.maximum(values[order[:k]], 1e-12))
        for at in _row_blocks(q):
            q[at] = q[at] @ (turn * (values > 1e-10 * values.max()))[:, order]  # less is rounding, beyond the rank
        self.term_vectors = q[:, :k]
        return self

    @staticmethod
    def _both_sides(rows: DataFrame, q: np.ndarray, out: np.ndarray) -> None:
        """Write transposed matrix times matrix times `q` to `out`, which may be `q`; only as many numbers as `q` has reach the driver."""
        width, columns = q.shape
        shared = rows.sparkSession.sparkContext.broadcast(np.array(q))

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, known = np.zeros((width, columns)), np.zeros(width, bool)
            for batch in batches:
                for part in _parts(batch):
                    seen, m = _dense(part)
                    total[seen] += m.T @ (m @ shared.value[seen])
                    known[seen] = True
            for s in range(0, width, TERM_BLOCK):
                t = np.flatnonzero(known[s : s + TERM_BLOCK]).astype(np.int32)
                if len(t):  # most terms are seldom: only those that the task saw are shuffled
                    yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([t.tobytes()], pa.binary()), pa.array([total[s + t].astype(np.float32).tobytes()], pa.binary())], names=["s", "t", "x"])

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def whole(s: int, held: np.ndarray) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([held.astype(np.float32).tobytes()], pa.binary())], names=["s", "x"])

            at, held = None, None
            for batch in batches:
                for i in range(batch.num_rows):
                    s, t, x = (batch.column(c)[i].as_py() for c in range(3))
                    if s != at:
                        if at is not None:
                            yield whole(at, held)
                        at, held = s, np.zeros((min(TERM_BLOCK, width - s), columns))
                    held[np.frombuffer(t, np.int32)] += np.frombuffer(x, np.float32).reshape(-1, columns)
            if at is not None:
                yield whole(at, held)

        with free_shuffles(rows.sparkSession):
            # each task has sums of the terms that it saw, so no more tasks than run at once
            sums = rows.coalesce(max(1, rows.sparkSession.sparkContext.defaultParallelism)).mapInArrow(step, "s int, t binary, x binary")
            blocks = sums.repartition("s").sortWithinPartitions("s").mapInArrow(added, "s int, x binary").toArrow()
        shared.destroy()
        for batch in blocks.to_batches():
            for s, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                out[s : s + TERM_BLOCK] = np.frombuffer(x.as_buffer(), np.float32).reshape(-1, columns)

    def _placed(self, first: int, last: int):
        """The term side of some components for the tasks, and what gives the places of sparse rows in these components."""
        shared = self.rows.sparkSession.sparkContext.broadcast(np.array(self.term_vectors[:, first:last]))

        def place(part: pa.RecordBatch) -> np.ndarray:
            seen, m = _dense(part)
            return m @ shared.value[seen]

        return shared, place

    @property
    def doc_vectors(self) -> DataFrame:
        """`doc_id, v`, zero for a document without terms; each task holds some components of the terms, and a document's are put together."""
        pieces = []
        for first, last in _spans(*self.term_vectors.shape):
            _, place = self._placed(first, last)

            def piece(batches: Iterator[pa.RecordBatch], first: int = first, place=place) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for part in _parts(batch):
                        yield pa.RecordBatch.from_arrays([part.column(0), pa.array([first] * part.num_rows, pa.int32()), to_lists(place(part))], names=["doc_id", "at", "v"])

            pieces.append(self.rows.mapInArrow(piece, "doc_id bigint, at int, v array<double>"))
        found = reduce(DataFrame.unionAll, pieces).groupBy("doc_id").agg(F.flatten(F.array_sort(F.collect_list(F.struct("at", "v")))["v"]).alias("v"))
        zero = F.array_repeat(F.lit(0.0), self.term_vectors.shape[1])
        return self.documents.join(found, "doc_id", "left").select("doc_id", F.coalesce("v", zero).alias("v"))

    def transform_query(self, tokens: list[str]) -> np.ndarray:
        """Inverse singular values times term vectors times the query's tf-idf; unknown terms count nothing."""
        if self.terms is None:
            raise ValueError("fit the model first")
        tf = Counter(tokens)
        at = [i for i, t in enumerate(self.terms) if t in tf]
        q = np.array([tf[self.terms[i]] * self.idf[i] for i in at])
        return (self.term_vectors[at].T @ q) / self.sigma

    def search(self, tokens: list[str], k: int = 10) -> DataFrame:
        """`rank, doc_id, score` by cosine; the projection is scaled as the documents are. Of a document only sums over its components are kept."""
        q = self.transform_query(tokens) * self.sigma
        sums = []
        for first, last in _spans(*self.term_vectors.shape):
            shared, place = self._placed(first, last)

            def measure(batches: Iterator[pa.RecordBatch], asked: np.ndarray = q[first:last], place=place) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for part in _parts(batch):
                        v = place(part).astype(np.float64)
                        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(v @ asked), pa.array((v * v).sum(axis=1))], names=["doc_id", "dot", "sq"])

            sums.append(cut(self.rows.mapInArrow(measure, "doc_id bigint, dot double, sq double"), "lsi-sums"))
            shared.destroy()
        found = reduce(DataFrame.unionAll, sums).groupBy("doc_id").agg(F.sum("dot").alias("dot"), F.sum("sq").alias("sq"))
        cosine = F.col("dot") / (F.sqrt("sq") * F.lit(float(np.linalg.norm(q))) + F.lit(1e-10))
        scored = self.documents.join(found, "doc_id", "left").select("doc_id", F.round(F.coalesce(cosine, F.lit(0.0)), 6).alias("score"))
        best = scored.orderBy(F.desc("score"), "doc_id").limit(k).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "doc_id", "score"))).alias("best"))  # k rows
        return best.select(F.posexplode("best").alias("at", "b")).select((F.col("at") + 1).alias("rank"), "b.doc_id", "b.score")
