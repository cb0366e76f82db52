"""Product quantisation with asymmetric distances, alone and on residuals within inverted lists."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillvec.functions.ranking import topk

from . import ivf
from .arrow import first_k, held_rows, l2sq_matrix, to_lists, to_matrix
from .kmeans import _filled, lloyd, train


def subvectors(docs: DataFrame, m: int, dim: int) -> DataFrame:
    """`doc_id, sub, sv`: the `m` equal slices of each vector."""
    if dim % m:
        raise ValueError("the dimension has to be a multiple of the number of subvectors")
    w = dim // m
    parts = F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: F.slice("v", i * w + 1, w))
    return docs.select("doc_id", F.posexplode(parts).alias("sub", "sv"))


@dataclass
class ProductQuantizer:
    """Codebooks of `m` subspaces with up to `k` codes each."""

    m: int = 4
    k: int = 256
    rounds: int = 3
    books: list[np.ndarray] | None = None

    def fit(self, docs: DataFrame, stored: bool = False) -> ProductQuantizer:
        self.books = lloyd(docs, self.k, self.rounds, self.m, stored)
        return self

    def fit_trained(self, docs: DataFrame) -> ProductQuantizer:
        """As `fit`, from spread-out starting points, on a stored table."""
        self.books = train(docs, self.k, subspaces=self.m)
        return self

    def _ready(self) -> list[np.ndarray]:
        if self.books is None:
            raise ValueError("fit the quantizer first")
        return self.books

    def codebook(self, docs: DataFrame) -> DataFrame:
        """`sub, code, cv`."""
        rows = [(s, c, v.tolist()) for s, book in enumerate(self._ready()) for c, v in enumerate(book) if not np.isnan(v).any()]
        return docs.sparkSession.createDataFrame(rows, "sub int, code int, cv array<double>")

    def encode(self, docs: DataFrame) -> DataFrame:
        """`doc_id, codes ARRAY<SMALLINT>`, and `cid` where `docs` has it."""
        carried = [c for c in ("cid",) if c in docs.columns]
        shared = docs.sparkSession.sparkContext.broadcast([_filled(b) for b in self._ready()])

        def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                codes = encode_matrix(to_matrix(batch.column(1)), shared.value)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1) * codes.shape[1], pa.int32()), pa.array(codes.ravel(), pa.int16()))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists, *batch.columns[2:]], names=["doc_id", "codes", *carried])

        schema = "doc_id bigint, codes array<smallint>" + "".join(f", {c} int" for c in carried)
        return docs.select(F.col("doc_id").cast("bigint"), F.col("v").cast("array<double>"), *carried).mapInArrow(code, schema)

    def adc_table(self, queries: DataFrame) -> DataFrame:
        """`qid, sub, code, d2`: squared distances of each query's slices to the codes."""
        qid, q = held_rows(queries, "qid", "qv")
        rows = []
        for s, (book, part) in enumerate(zip(self._ready(), np.split(q, self.m, axis=1), strict=True)):
            d2 = l2sq_matrix(part, book)
            rows += [(int(i), s, c, float(d2[a, c])) for a, i in enumerate(qid) for c in range(len(book)) if not np.isnan(d2[a, c])]
        return queries.sparkSession.createDataFrame(rows, "qid bigint, sub int, code int, d2 double")

    def search(self, codes: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
        """`qid, rank, doc_id, score`: least summed squared table distances over all rows of `codes`."""
        qid, q = held_rows(queries, "qid", "qv")
        tables = [np.nan_to_num(l2sq_matrix(part, book), nan=np.inf) for book, part in zip(self._ready(), np.split(q, self.m, axis=1), strict=True)]
        shared = codes.sparkSession.sparkContext.broadcast((qid, tables))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, t = shared.value
            for whole in batches:
                for start in range(0, whole.num_rows, 5_000):
                    batch = whole.slice(start, 5_000)
                    code = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
                    score = np.round(sum(t[s][:, code[:, s]] for s in range(len(t))), 6)
                    doc = batch.column(0).to_numpy()
                    row, col = first_k(score, doc, k)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(doc[col]), pa.array(score[row, col])], names=["qid", "doc_id", "score"])

        found = codes.mapInArrow(scan, "qid bigint, doc_id bigint, score double")
        return topk(found, "qid", ["score", "doc_id"], k).select("qid", "rank", "doc_id", "score")


def encode_matrix(x: np.ndarray, books: list[np.ndarray]) -> np.ndarray:
    parts = np.split(x, len(books), axis=1)
    return np.stack([np.round(l2sq_matrix(p, b), 9).argmin(1) for p, b in zip(parts, books, strict=True)], 1).astype(np.int16) if len(x) else np.zeros((0, len(books)), np.int16)


def compression_ratio(dim: int, m: int, value_bytes: int = 4, code_bytes: int = 2) -> float:
    """Bytes of a vector over bytes of its codes."""
    return value_bytes * dim / (code_bytes * m)


def residuals(assigned: DataFrame, centers: np.ndarray) -> DataFrame:
    """`doc_id, v, cid` with each vector replaced by what its centroid leaves of it."""
    shared = assigned.sparkSession.sparkContext.broadcast(_filled(centers))

    def subtract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cid = batch.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), to_lists(to_matrix(batch.column(1)) - shared.value[cid]) if len(cid) else batch.column(1), batch.column(2)], names=["doc_id", "v", "cid"])

    return assigned.select("doc_id", "v", "cid").mapInArrow(subtract, "doc_id bigint, v array<double>, cid int")


def ivfpq_search(assigned: DataFrame, queries: DataFrame, centers: np.ndarray, quantizer: ProductQuantizer, k: int = 10, n_probes: int = 1) -> DataFrame:
    """`qid, rank, doc_id, score` by quantised residuals within the probed cells; `quantizer` is fitted on residuals."""
    return ivfpq_answer(quantizer.encode(residuals(assigned, centers)), queries, centers, quantizer, k, n_probes)


def ivfpq_answer(codes: DataFrame, queries: DataFrame, centers: np.ndarray, quantizer: ProductQuantizer, k: int = 10, n_probes: int = 1) -> DataFrame:
    """As `ivfpq_search`, from the codes `doc_id, codes, cid` of the residuals."""
    probed = ivf.probes(queries, centers, n_probes)
    qid, q = held_rows(queries, "qid", "qv")
    where = {int(i): n for n, i in enumerate(qid)}
    tables = {}
    for r in probed.select("qid", "cid").collect():  # queries x n_probes tables of m x k numbers
        rest = q[where[r.qid]] - centers[r.cid]
        tables[r.qid, r.cid] = [np.nan_to_num(l2sq_matrix(p[None], b)[0], nan=np.inf) for p, b in zip(np.split(rest, quantizer.m), quantizer._ready(), strict=True)]
    by_cell: dict[int, list[int]] = {}
    for i, c in tables:
        by_cell.setdefault(c, []).append(i)
    shared = codes.sparkSession.sparkContext.broadcast((by_cell, tables))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, held = shared.value
        for batch in batches:
            doc, cid = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            code = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, quantizer.m), np.int16)
            out: list[tuple] = []
            for c in np.unique(cid).tolist():
                rows = np.flatnonzero(cid == c)
                for i in cells.get(c, ()):
                    score = np.round(sum(t[code[rows, s]] for s, t in enumerate(held[i, c])), 6)
                    _, col = first_k(score[None], doc[rows], k)
                    out.append((np.full(len(col), i), doc[rows][col], score[col]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["qid", "doc_id", "score"])

    found = codes.select("doc_id", "codes", "cid").mapInArrow(scan, "qid bigint, doc_id bigint, score double")
    return topk(found, "qid", ["score", "doc_id"], k).select("qid", "rank", "doc_id", "score")
