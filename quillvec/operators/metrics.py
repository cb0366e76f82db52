"""Ranked-retrieval metrics over `neighbors(qid, rank, doc_id)` and `truth(qid, rank, doc_id)`.

Every metric starts from the queries of the truth, so that a query without any
neighbour counts as 0. Ranks start at 1; a document occurs once for a query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

METRICS = ["precision_at_k", "recall_at_k", "f1_at_k", "ndcg_at_k", "average_precision", "reciprocal_rank"]


def hits(neighbors: DataFrame, truth: DataFrame, k: int | None = None) -> DataFrame:
    """`qid, rank, doc_id, truth_rank` of the neighbours found in the truth (of the first `k` on both sides)."""
    n, t = neighbors, truth
    if k is not None:
        n, t = n.where(F.col("rank") <= k), t.where(F.col("rank") <= k)
    return n.select("qid", "rank", "doc_id").join(t.select("qid", "doc_id", F.col("rank").alias("truth_rank")), ["qid", "doc_id"])


def per_query(neighbors: DataFrame, truth: DataFrame, k: int = 10, standard_average: bool = False, query_times: DataFrame | None = None, n_candidates: DataFrame | None = None, n_total: int | None = None) -> DataFrame:
    """A row of METRICS for each query of the truth; given `query_times(qid, query_time)` also `query_time`, and given `n_candidates(qid, n_candidates)` and the number of all rows also `candidate_ratio`.

    Precision and recall both divide by `k`. The average precision has no cut at
    `k` and divides by the hits found, or with `standard_average` by the size of
    the truth. The gain of rank r is 1 / log2(r + 1).
    """
    size = truth.groupBy("qid").agg(F.count("*").alias("relevant"))
    within = hits(neighbors, truth, k).groupBy("qid").agg(F.count("*").alias("n"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    order = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    anywhere = (
        hits(neighbors, truth).withColumn("seen", F.count("*").over(order)).groupBy("qid")
        .agg(F.sum(F.col("seen") / F.col("rank")).alias("precisions"), F.count("*").alias("found"), F.min("rank").alias("first"))
    )
    all_ = size.join(within, "qid", "left").join(anywhere, "qid", "left")
    p = F.coalesce(F.col("n"), F.lit(0)) / F.lit(k)
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("relevant"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    by = F.col("relevant") if standard_average else F.col("found")
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    extra = []
    if query_times is not None:
        all_ = all_.join(query_times.select("qid", "query_time"), "qid", "left")
        extra.append(F.col("query_time"))
    if n_candidates is not None and n_total:
        all_ = all_.join(n_candidates.select("qid", "n_candidates"), "qid", "left")
        extra.append(zero(candidate_ratio(F.col("n_candidates"), F.lit(n_total))).alias("candidate_ratio"))
    return all_.select(
        "qid", zero(p).alias("precision_at_k"), zero(p).alias("recall_at_k"), zero(F.when(p > 0, 2 * p * p / (p + p))).alias("f1_at_k"),
        zero(F.col("dcg") / ideal).alias("ndcg_at_k"), zero(F.col("precisions") / by).alias("average_precision"), zero(1 / F.col("first")).alias("reciprocal_rank"), *extra,
    )


def by_setting(found: DataFrame, truth: DataFrame, setting: str, k: int = 10) -> DataFrame:
    """`setting, recall_at_k, ndcg_at_k`: means over the queries of the truth for each setting of `found(setting, qid, rank, doc_id)`."""
    queries = truth.groupBy("qid").agg(F.count("*").alias("relevant"))
    grid = queries.crossJoin(F.broadcast(found.select(setting).distinct()))
    within = found.where(F.col("rank") <= k).join(truth.where(F.col("rank") <= k).select("qid", "doc_id"), ["qid", "doc_id"])
    gains = within.groupBy(setting, "qid").agg(F.count("*").alias("n"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("relevant"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    mean = lambda c: F.round(F.avg(F.coalesce(c, F.lit(0.0))), 6)
    return grid.join(gains, [setting, "qid"], "left").groupBy(setting).agg(mean(F.col("n") / k).alias("recall_at_k"), mean(F.col("dcg") / ideal).alias("ndcg_at_k"))


def dcg(neighbors: DataFrame, truth: DataFrame, k: int = 10) -> DataFrame:
    found = hits(neighbors, truth, k).groupBy("qid").agg(F.sum(1 / F.log2(F.col("rank") + 1)).alias("d"))
    return truth.select("qid").distinct().join(found, "qid", "left").select("qid", F.round(F.coalesce("d", F.lit(0.0)), 6).alias("dcg_at_k"))


def batch(metrics: DataFrame, query_times: DataFrame | None = None) -> DataFrame:
    """One row of means over queries, with `map`, `mrr`, `n_queries` and, given `query_times(qid, query_time)`, their mean and sum."""
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6)
    aggs = [mean(c).alias(c) for c in METRICS[:4]] + [mean("average_precision").alias("map"), mean("reciprocal_rank").alias("mrr"), F.count("*").alias("n_queries")]
    if query_times is not None:
        metrics = metrics.join(query_times, "qid", "left")
        aggs += [F.avg("query_time").alias("mean_query_time"), F.sum("query_time").alias("total_query_time")]
    return metrics.agg(*aggs)


def precision_recall_curve(neighbors: DataFrame, truth: DataFrame, max_k: int | None = None) -> DataFrame:
    """`qid, k, hits, relevant, recall, precision` of every query of the truth at each rank from 1 to `max_k`, or to the last rank of any neighbour.

    A query with fewer neighbours keeps its hits at the further ranks, so one
    without any counts 0 throughout.
    """
    size = truth.groupBy("qid").agg(F.count("*").alias("relevant"))
    last = neighbors.agg(F.max("rank").alias("last")) if max_k is None else neighbors.sparkSession.createDataFrame([(max_k,)], "last int")
    grid = size.crossJoin(F.broadcast(last)).select("qid", "relevant", F.explode(F.sequence(F.lit(1), F.coalesce(F.col("last"), F.lit(1)).cast("int"))).alias("k"))
    found = hits(neighbors, truth).groupBy("qid", F.col("rank").alias("k")).agg(F.count("*").alias("n"))
    order = Window.partitionBy("qid").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    curve = grid.join(found, ["qid", "k"], "left").withColumn("hits", F.sum(F.coalesce("n", F.lit(0))).over(order))
    return curve.select("qid", "k", "hits", "relevant", F.round(F.col("hits") / F.col("relevant"), 6).alias("recall"), F.round(F.col("hits") / F.col("k"), 6).alias("precision"))


def interpolated_precision(curve: DataFrame, levels: int = 10) -> DataFrame:
    """`qid, level, precision`: the greatest precision at a recall of at least level / `levels`, else 0.

    The comparison is one of integers, so that a recall of 3/10 reaches the level 0.3.
    """
    spark = curve.sparkSession
    grid = spark.range(levels + 1).select(F.col("id").alias("i"))
    all_ = curve.select("qid").distinct().crossJoin(F.broadcast(grid))
    reached = curve.join(F.broadcast(grid), F.col("hits") * levels >= F.col("i") * F.col("relevant")).groupBy("qid", "i").agg(F.max("precision").alias("p"))
    return all_.join(reached, ["qid", "i"], "left").select("qid", F.round(F.col("i") / levels, 6).alias("level"), F.coalesce("p", F.lit(0.0)).alias("precision"))


def candidate_ratio(n: Column, total: Column) -> Column:
    return n / total


def speedup(base: Column, method: Column) -> Column:
    """How many times faster; infinite where the method took no time."""
    return F.when(method == 0, F.lit(float("inf"))).otherwise(base / method)
