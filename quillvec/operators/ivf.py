"""Inverted-file search: probe the nearest cells, fetch their members, re-rank exactly."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillvec.functions.ranking import topk
from quillvec.functions.vectors import l2sq

from .arrow import held_rows, l2sq_matrix


def probes(queries: DataFrame, centers: np.ndarray, n_probes: int) -> DataFrame:
    """`qid, cid, d2, probe_rank` of the nearest cells; `n_probes` is clipped to 1 and the number of cells."""
    qid, q = held_rows(queries, "qid", "qv")
    live = np.flatnonzero(~np.isnan(centers).any(1))
    n = int(np.clip(n_probes, 1, max(1, len(live))))
    d2 = np.round(l2sq_matrix(q, centers[live]), 9) if len(qid) else np.zeros((0, len(live)))
    rows = []
    for i, row in enumerate(d2):
        for rank, j in enumerate(np.lexsort((live, row))[:n], 1):
            rows.append((int(qid[i]), int(live[j]), float(row[j]), rank))
    return queries.sparkSession.createDataFrame(rows, "qid bigint, cid int, d2 double, probe_rank int")


def candidates(assigned: DataFrame, probed: DataFrame) -> DataFrame:
    """`qid, doc_id, v, probe_rank` of all members of the probed cells; the probes are queries x n_probes rows."""
    return assigned.join(F.broadcast(probed.select("qid", "cid", "probe_rank")), "cid")


def rerank(found: DataFrame, queries: DataFrame, k: int, squared: bool = False) -> DataFrame:
    """Exact distances of candidates and the nearest `k` of each query; fewer candidates give fewer rows."""
    score = l2sq("v", "qv")
    score = F.round(score if squared else F.sqrt(score), 6)
    scored = found.join(F.broadcast(queries.select("qid", "qv")), "qid").select("qid", "doc_id", score.alias("score"))
    return topk(scored, "qid", ["score", "doc_id"], k).select("qid", "rank", "doc_id", "score")


def search(assigned: DataFrame, queries: DataFrame, centers: np.ndarray, k: int = 10, n_probes: int = 1, squared: bool = False) -> DataFrame:
    return rerank(candidates(assigned, probes(queries, centers, n_probes)), queries, k, squared)


def candidate_ratio(assigned: DataFrame, queries: DataFrame, centers: np.ndarray, n_probes: int) -> DataFrame:
    """`qid, n_candidates, candidate_ratio`: measured, 0 for a query whose cells are empty."""
    total = assigned.agg(F.count("*").alias("total"))
    sizes = assigned.groupBy("cid").count()
    probed = probes(queries, centers, n_probes)
    n = probed.join(sizes, "cid", "left").groupBy("qid").agg(F.coalesce(F.sum("count"), F.lit(0)).cast("bigint").alias("n_candidates"))
    return n.crossJoin(F.broadcast(total)).select("qid", "n_candidates", F.round(F.col("n_candidates") / F.col("total"), 6).alias("candidate_ratio"))


def sweep(assigned: DataFrame, queries: DataFrame, centers: np.ndarray, settings: list[int], k: int = 10) -> DataFrame:
    """`n_probes, qid, rank, doc_id, score` of several settings from one probing and one set of distances."""
    found = candidates(assigned, probes(queries, centers, max(settings)))
    scored = found.join(F.broadcast(queries.select("qid", "qv")), "qid").select("qid", "doc_id", "probe_rank", F.round(F.sqrt(l2sq("v", "qv")), 6).alias("score"))
    each = scored.withColumn("n_probes", F.explode(F.array([F.lit(n) for n in settings]))).where("probe_rank <= n_probes")
    return topk(each, ["n_probes", "qid"], ["score", "doc_id"], k).select("n_probes", "qid", "rank", "doc_id", "score")
