"""Exact nearest neighbours of a set of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillvec.functions.ranking import topk

from .arrow import first_k, held_rows, l2sq_matrix, to_matrix

#: Name of a metric: the score, and whether greater is nearer.
METRICS = {"l2": False, "l2sq": False, "cosine": True, "dot": True}
DIGITS = 6


def _scores(metric: str, x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Queries x rows, rounded, ascending from the nearest."""
    if metric in ("l2", "l2sq"):
        s = l2sq_matrix(q, x)
        return np.round(np.sqrt(s) if metric == "l2" else s, DIGITS)
    s = q @ x.T
    if metric == "cosine":
        by = np.sqrt((q * q).sum(1))[:, None] * np.sqrt((x * x).sum(1))[None, :]
        s = np.divide(s, by, out=np.zeros_like(s), where=by > 0)
    return -np.round(s, DIGITS)


def knn(docs: DataFrame, queries: DataFrame, k: int = 10, metric: str = "l2", exclude_self: bool = False) -> DataFrame:
    """`qid, rank, doc_id, score` of the `k` nearest rows of `docs(doc_id, v)` to each row of `queries(qid, qv)`.

    Scores are rounded to six digits before ranking and ties go by the smaller
    id. The queries are held by every task; each task keeps `k` rows of each
    query, so that the shuffle is bounded by queries, `k` and tasks. With
    `exclude_self` a row of the query's id is left out. A zero query is an error
    for `cosine`.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}")
    ids, q = held_rows(queries, "qid", "qv")
    schema = "qid bigint, doc_id bigint, score double"
    if not len(ids):
        return docs.sparkSession.createDataFrame([], schema).select("qid", F.lit(0).alias("rank"), "doc_id", "score")
    if metric == "cosine" and not (q * q).sum(1).all():
        raise ValueError("the query vector has zero norm")
    shared = docs.sparkSession.sparkContext.broadcast((ids, q))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, qs = shared.value
        best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        for batch in batches:
            if not batch.num_rows:
                continue
            doc = batch.column(0).to_numpy(zero_copy_only=False)
            score = _scores(metric, to_matrix(batch.column(1)), qs)
            if exclude_self:
                score[qids[:, None] == doc[None, :]] = np.inf
            row, col = first_k(score, doc, k)
            real = np.isfinite(score[row, col])
            row, col = row[real], col[real]
            best = [np.r_[a, b] for a, b in zip(best, (row, doc[col], score[row, col]), strict=True)]
            order = np.lexsort((best[1], best[2], best[0]))
            r = best[0][order]
            start = np.searchsorted(r, np.arange(len(qids)))
            best = [b[order][np.arange(len(r)) - start[r] < k] for b in best]
        yield pa.RecordBatch.from_arrays([pa.array(qids[best[0]]), pa.array(best[1]), pa.array(best[2])], names=["qid", "doc_id", "score"])

    found = docs.select(F.col("doc_id").cast("bigint"), F.col("v").cast("array<double>")).mapInArrow(search, schema)
    ranked = topk(found, "qid", ["score", "doc_id"], k)
    sign = -1.0 if METRICS[metric] else 1.0
    return ranked.select("qid", "rank", "doc_id", (F.col("score") * sign + 0.0).alias("score"))
