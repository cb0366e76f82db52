import numpy as np
import pytest
from pyspark.sql import functions as F

from quillvec.functions import vectors as vx
from quillvec.operators import exact, ivf, kmeans, lsh, pq

D = 16


@pytest.fixture(scope="module")
def x():
    rng = np.random.default_rng(1)
    v = rng.standard_normal((8, D))[rng.integers(8, size=300)] + 0.4 * rng.standard_normal((300, D))
    return v / np.linalg.norm(v, axis=1)[:, None]


@pytest.fixture(scope="module")
def docs(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id bigint, v array<double>").cache()


@pytest.fixture(scope="module")
def queries(docs):
    return docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("qid"), F.col("v").alias("qv"))


def table(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.qid, {})[r.rank] = (r.doc_id, r.score)
    return {q: [v[r] for r in sorted(v)] for q, v in out.items()}


@pytest.mark.parametrize("metric", exact.METRICS)
def test_exact_like_numpy(docs, queries, x, metric):
    got = table(exact.knn(docs, queries, 7, metric))
    for q, near in got.items():
        d = {"l2": np.linalg.norm(x - x[q], axis=1), "l2sq": ((x - x[q]) ** 2).sum(1), "cosine": x @ x[q], "dot": x @ x[q]}[metric].round(6)
        order = sorted(range(len(x)), key=lambda i: (-d[i] if exact.METRICS[metric] else d[i], i))[:7]
        assert [i for i, _ in near] == order and near[0][0] == q
        assert np.allclose([s for _, s in near], d[order], atol=2e-6)


def test_self_left_out_and_small_tables(docs, queries):
    assert all(q not in [i for i, _ in near] for q, near in table(exact.knn(docs, queries, 5, "dot", exclude_self=True)).items())
    assert {len(n) for n in table(exact.knn(docs.limit(3), queries, 5)).values()} == {3}
    assert exact.knn(docs, queries.where("false")).count() == 0 and exact.knn(docs.where("false"), queries).count() == 0


def test_zero_queries_and_too_many(spark, docs, monkeypatch):
    zero = spark.createDataFrame([(1, [0.0] * D)], "qid bigint, qv array<double>")
    with pytest.raises(ValueError):
        exact.knn(docs, zero, metric="cosine")
    with pytest.raises(ValueError):
        exact.knn(docs, zero, metric="manhattan")
    pair = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0])], "a array<double>, b array<double>")
    assert pair.select(vx.cosine("a", "b").alias("c")).first().c == 0.0
    with pytest.raises(Exception, match="zero norm"):
        pair.select(vx.cosine_of_query("a", "b").alias("c")).collect()
    assert pair.select(vx.l2_normalize("a").alias("n")).first().n == [0.0, 0.0]


def test_usable_vectors(spark):
    rows = [(1, [3.0, 4.0]), (1, [3.0, 4.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [1.0]), (6, [None, 1.0])]
    df = spark.createDataFrame(rows, "doc_id bigint, x array<float>")
    assert [(r.doc_id, r.v) for r in vx.usable_unit_vectors(df, "doc_id", "x", 2).collect()] == [(1, [0.6, 0.8])]


def test_lloyd_like_numpy_whatever_the_partitions(docs, x):
    c = x[:6].copy()
    for _ in range(3):
        near = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        c = np.array([x[near == i].mean(0) for i in range(6)])
    for n in (1, 7):
        assert np.allclose(kmeans.lloyd(docs.repartition(n), 6, 3)[0], c)
    got = {r.doc_id: r.cid for r in kmeans.assign(docs, c).collect()}
    assert [got[i] for i in range(len(x))] == ((x[:, None] - c[None]) ** 2).sum(2).argmin(1).tolist()
    assert kmeans.lloyd(docs.where("false"), 6, 3)[0].shape == (0, 0)
    assert kmeans.centroid_table(docs, np.array([[1.0], [np.nan]])).count() == 1


def test_all_probes_are_exact_and_recall_grows(docs, queries):
    c = kmeans.lloyd(docs, 8, 3)[0]
    assigned = kmeans.assign(docs, c)
    truth = table(exact.knn(docs, queries, 10))
    assert table(ivf.search(assigned, queries, c, 10, 99)) == truth
    found = {}
    for r in ivf.sweep(assigned, queries, c, [1, 2, 8], 10).collect():
        found.setdefault(r.n_probes, set()).add((r.qid, r.doc_id))
    want = {(q, i) for q, near in truth.items() for i, _ in near}
    assert len(found[1] & want) <= len(found[2] & want) <= len(found[8] & want) == len(want)
    ratio = {r.qid: r.candidate_ratio for r in ivf.candidate_ratio(assigned, queries, c, 8).collect()}
    assert set(ratio.values()) == {1.0}


def test_quantizer(docs, queries, x):
    with pytest.raises(ValueError):
        pq.ProductQuantizer().encode(docs)
    with pytest.raises(ValueError):
        pq.subvectors(docs, 5, D)
    few = docs.where("doc_id < 30")
    q = pq.ProductQuantizer(4, 30, 2).fit(few)
    got = table(q.search(q.encode(few), queries.where("qid < 30"), 5))
    want = table(exact.knn(few, queries.where("qid < 30"), 5, "l2sq"))
    assert {k: [i for i, _ in v] for k, v in got.items()} == {k: [i for i, _ in v] for k, v in want.items()}
    assert q.adc_table(queries.where("qid = 0")).count() == q.codebook(few).count()
    assert pq.compression_ratio(200, 4) == 100


def test_residual_search_with_full_books(docs, queries):
    few, asked = docs.where("doc_id < 40"), queries.where("qid < 40")
    c = kmeans.lloyd(few, 4, 2)[0]
    assigned = kmeans.assign(few, c)
    q = pq.ProductQuantizer(4, 40, 1).fit(pq.residuals(assigned, c).select("doc_id", "v"))
    got, want = table(pq.ivfpq_search(assigned, asked, c, q, 5, 4)), table(exact.knn(few, asked, 5, "l2sq"))
    assert {k: [i for i, _ in v] for k, v in got.items()} == {k: [i for i, _ in v] for k, v in want.items()}


def test_hashing(docs, queries, x):
    planes = lsh.hyperplanes(D, 32)
    bits = (x @ planes.T >= 0).astype(int)
    signed = lsh.signatures(docs, planes)
    assert {r.doc_id: r.signature for r in signed.collect()} == {i: "".join(map(str, b)) for i, b in enumerate(bits)}
    pairs = {}
    for b in (4, 8):
        r = 32 // b
        keys = bits.reshape(len(x), b, r)
        found = {(i.qid, i.doc_id) for i in lsh.candidates(lsh.bands(signed, 32, b), lsh.bands(lsh.signatures(queries, planes), 32, b), ["band", "key"]).collect()}
        pairs[b] = found
        assert found == {(q, i) for q in range(0, 300, 20) for i in range(300) if (keys[q] == keys[i]).all(1).any()}
    assert pairs[4] <= pairs[8]
    with pytest.raises(ValueError):
        lsh.bands(signed, 32, 5)
    near = table(lsh.hamming_search(docs, queries, lsh.hyperplanes(D, 70), 4))
    far = (x @ lsh.hyperplanes(D, 70).T >= 0).astype(int)
    for q, got in near.items():
        d = (far != far[q]).sum(1)
        assert [i for i, _ in got] == sorted(range(300), key=lambda i: (d[i], i))[:4]


def test_tables_and_formulas(spark, docs, x):
    planes = lsh.table_hyperplanes(D, 5, 3)
    keys = lsh.table_keys(docs, planes)
    got = {(r.doc_id, r.tbl): r.key for r in keys.collect()}
    assert got[7, 2] == int("".join("1" if p @ x[7] >= 0 else "0" for p in planes[2]), 2)
    stats = lsh.table_statistics(keys).collect()
    assert len(stats) == 3 and all(abs(r.buckets * r.mean_size - 300) < 1e-3 for r in stats)
    assert lsh.parameter_grid(spark, 0.7, (5,), (10,)).first().recall == pytest.approx(1 - (1 - (1 - np.arccos(0.7) / np.pi) ** 5) ** 10, abs=1e-6)


def test_scaling_runs(docs, queries):
    from quillvec.operators import experiments as ex

    def build(v, _):
        return kmeans.assign(v, kmeans.lloyd(v, 4, 1)[0])

    def search(index, asked):
        return exact.knn(index.select("doc_id", "v"), asked, 3)

    got = ex.scaling(docs, queries, "flat", build, search, [50, 300], [8]).collect()
    assert [(r.N, r.dim) for r in got] == [(50, 8), (300, 8)] and all(r.build_time > 0 and r.query_time > 0 for r in got)


def test_trained_centroids(docs, x):
    stored = docs.select("doc_id", "v")
    (c,) = kmeans.train(stored, 8)
    within = ((x[:, None] - c[None]) ** 2).sum(2).min(1).sum()
    assert kmeans.inertia(stored, c) == pytest.approx(within)
    assert within <= 1.02 * min(((x[:, None] - kmeans.train(stored, 8, seed=s)[0][None]) ** 2).sum(2).min(1).sum() for s in range(5)) * 1.1
    assert within < ((x[:, None] - kmeans.lloyd(docs, 8, 3)[0][None]) ** 2).sum(2).min(1).sum() * 1.001
    assert len(kmeans.train(stored.limit(3), 200)[0]) == 3 and kmeans.train(stored.where("false"), 5)[0].shape == (0, 0)
    sampled = kmeans.train(stored, 8, rounds=3, sample_rows=100)[0]
    assert ((x[:, None] - sampled[None]) ** 2).sum(2).min(1).sum() < 1.3 * within
    parts = kmeans.train(stored, 10, subspaces=4)
    assert [p.shape for p in parts] == [(10, D // 4)] * 4


def test_spread_out_starts_hit_every_cluster():
    rng = np.random.default_rng(3)
    centers = 10 * np.eye(12)
    x = np.repeat(centers, 40, 0) + 0.1 * rng.standard_normal((480, 12))
    start = kmeans.spread_out(x, 12, np.random.default_rng(0))
    assert len({int(((centers - s) ** 2).sum(1).argmin()) for s in start}) == 12


def test_packed_band_keys_are_the_bands(docs, x):
    planes = lsh.hyperplanes(D, 128)
    bits = (x @ planes.T >= 0).astype(int)
    for b in (1, 4, 16):
        keys = bits.reshape(len(x), b, -1)
        got = {}
        for r in lsh.band_keys(docs, planes, b).collect():
            got.setdefault((r.band, str(r.key)), set()).add(r.doc_id)
        want = {}
        for i in range(len(x)):
            for j in range(b):
                want.setdefault((j, tuple(keys[i, j])), set()).add(i)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    with pytest.raises(ValueError):
        lsh.band_keys(docs, planes, 5)


def test_residual_sweep_keeps_the_cell(docs, queries):
    few, asked = docs.where("doc_id < 60"), queries.where("qid < 60")
    c = kmeans.lloyd(few, 4, 2)[0]
    assigned = kmeans.assign(few, c)
    left = pq.residuals(assigned, c)
    q = pq.ProductQuantizer(4, 16, 2).fit(left.select("doc_id", "v"))
    codes = q.encode(left)
    assert {r.doc_id: r.cid for r in codes.collect()} == {r.doc_id: r.cid for r in assigned.collect()}
    assert table(pq.ivfpq_answer(codes, asked, c, q, 5, 2)) == table(pq.ivfpq_search(assigned, asked, c, q, 5, 2))


def test_a_large_side_is_not_broadcast(spark):
    from quillvec.operators.arrow import small

    plan = lambda df: df._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in plan(spark.range(10).join(small(spark.range(5)), "id")) and "broadcast" not in plan(spark.range(10).join(small(spark.range(50), 20), "id"))
