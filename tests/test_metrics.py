import math

import pytest

from quillvec.operators import metrics

SCHEMA = "qid bigint, rank int, doc_id bigint"


def judged(spark, cases, k, **kw):
    rows = lambda i: [(q, r, d) for q, case in enumerate(cases) for r, d in enumerate(case[i], 1)]
    got = metrics.per_query(spark.createDataFrame(rows(0), SCHEMA), spark.createDataFrame(rows(1), SCHEMA), k, **kw)
    return [r.asDict() for r in got.orderBy("qid").collect()]


def test_hand_worked_cases(spark):
    ten = list(range(1, 11))
    perfect, none, short, late, empty = judged(spark, [(ten, ten), (list(range(11, 21)), ten), ([1, 2], ten), ([9, 8, 1], [1, 2, 3]), ([], [1])], 10)
    assert all(perfect[m] == 1 for m in metrics.METRICS)
    assert all(none[m] == 0 and empty[m] == 0 for m in metrics.METRICS)
    assert (short["precision_at_k"], short["recall_at_k"], short["average_precision"], short["reciprocal_rank"]) == (0.2, 0.2, 1, 1)
    assert late["average_precision"] == pytest.approx(1 / 3, abs=1e-6) and late["reciprocal_rank"] == pytest.approx(1 / 3, abs=1e-6)


def test_short_k_and_standard_average(spark):
    (row,) = judged(spark, [([9, 8, 1], [1, 2, 3])], 3)
    ideal = 1 + 1 / math.log2(3) + 0.5
    assert row["precision_at_k"] == row["f1_at_k"] == pytest.approx(1 / 3, abs=1e-6)
    assert row["ndcg_at_k"] == pytest.approx(0.5 / ideal, abs=1e-6)
    (row,) = judged(spark, [([9, 8, 1], [1, 2, 3])], 3, standard_average=True)
    assert row["average_precision"] == pytest.approx(1 / 9, abs=1e-6)


def test_batch_curve_and_levels(spark):
    n = spark.createDataFrame([(0, r, d) for r, d in enumerate([1, 9, 2, 8, 3], 1)], SCHEMA)
    t = spark.createDataFrame([(0, r, d) for r, d in enumerate(range(1, 11), 1)], SCHEMA)
    curve = metrics.precision_recall_curve(n, t)
    assert [(r.k, r.hits) for r in curve.orderBy("k").collect()] == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 5)]
    levels = {r.level: r.precision for r in metrics.interpolated_precision(curve).collect()}
    assert len(levels) == 11 and levels[0.5] == 1.0 and levels[0.6] == 0.0
    assert metrics.precision_recall_curve(n, t, 2).count() == 2
    times = spark.createDataFrame([(0, 2.0)], "qid bigint, query_time double")
    row = metrics.batch(metrics.per_query(n, t, 10), times).first()
    assert row.n_queries == 1 and row.mean_query_time == 2.0 and row.precision_at_k == 0.5
    empty = metrics.batch(metrics.per_query(n, t.where("false"), 10)).first()
    assert empty.n_queries == 0 and empty.map == 0


def test_speedup(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(4.0, 2.0), (1.0, 0.0)], "a double, b double").select(metrics.speedup(F.col("a"), F.col("b")).alias("s"))
    assert [r.s for r in df.collect()] == [2.0, float("inf")]


def test_queries_without_neighbours_count_in_curves(spark):
    n = spark.createDataFrame([(0, 1, 1), (0, 2, 9)], SCHEMA)
    t = spark.createDataFrame([(0, 1, 1), (0, 2, 2), (7, 1, 5)], SCHEMA)
    curve = metrics.precision_recall_curve(n, t, 3)
    assert sorted((r.qid, r.k, r.hits, r.relevant) for r in curve.collect()) == [(0, 1, 1, 2), (0, 2, 1, 2), (0, 3, 1, 2), (7, 1, 0, 1), (7, 2, 0, 1), (7, 3, 0, 1)]
    levels = {(r.qid, r.level): r.precision for r in metrics.interpolated_precision(curve).collect()}
    assert len(levels) == 22 and levels[0, 0.5] == 1.0 and levels[0, 0.6] == 0.0 and {v for (q, _), v in levels.items() if q == 7} == {0.0}
    assert {r.qid for r in metrics.precision_recall_curve(n.where("false"), t).collect()} == {0, 7}


def test_query_times_and_candidates_of_each_query(spark):
    n = spark.createDataFrame([(0, 1, 1)], SCHEMA)
    t = spark.createDataFrame([(0, 1, 1), (7, 1, 5)], SCHEMA)
    times = spark.createDataFrame([(0, 0.5), (7, 0.25)], "qid bigint, query_time double")
    counts = spark.createDataFrame([(0, 30)], "qid bigint, n_candidates bigint")
    got = {r.qid: r for r in metrics.per_query(n, t, 1, query_times=times, n_candidates=counts, n_total=120).collect()}
    assert (got[0].query_time, got[0].candidate_ratio, got[0].recall_at_k) == (0.5, 0.25, 1.0)
    assert (got[7].query_time, got[7].candidate_ratio, got[7].recall_at_k) == (0.25, 0.0, 0.0)


def test_means_by_setting(spark):
    t = spark.createDataFrame([(q, r, 10 * q + r) for q in range(3) for r in range(1, 5)], SCHEMA)
    rows = [(s, q, r, 10 * q + r if r <= s else 999 + r) for s in (1, 3) for q in range(2) for r in range(1, 5)]
    found = spark.createDataFrame(rows, "s int, qid bigint, rank int, doc_id bigint")
    got = {r.s: r for r in metrics.by_setting(found, t, "s", 4).collect()}
    gain = [1 / math.log2(r + 1) for r in range(1, 5)]
    for s in (1, 3):  # the third query has no row in any setting
        assert got[s].recall_at_k == pytest.approx(2 * s / 4 / 3, abs=1e-6)
        assert got[s].ndcg_at_k == pytest.approx(2 * sum(gain[:s]) / sum(gain) / 3, abs=1e-6)
