import numpy as np

from quillvec.llm.neighbors import MultiIndex, similar_vectors, visit_order
from quillvec.llm.themes import named_themes, theme_report, vector_themes

SCHEMA = "doc_id bigint, doc_vectors array<float>, node string, cell int, v int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if x is None else [None if e is None else float(e) for e in x], "clash", 1, 2) for i, x in rows], SCHEMA)


def dirty(dim):
    return [(901, None), (902, [0.0] * dim), (903, [float("nan")] + [1.0] * (dim - 1)), (904, [1.0] * (dim - 2)), (905, [float("inf")] * dim), (906, [None] + [1.0] * (dim - 1)), (None, [1.0] * dim)]


def clustered(rng, n, dim, k):
    centers = rng.standard_normal((k, dim))
    x = centers[rng.integers(k, size=n)] + 0.3 * rng.standard_normal((n, dim))
    return x * rng.uniform(0.5, 3, (n, 1))


def brute(rows, k, least=None, asked=None):
    once = {}
    for i, x in rows:
        if i is not None and x is not None and len(x) == 16 and None not in list(x) and np.isfinite(np.array(x, float)).all() and np.any(x):
            once.setdefault(i, np.array(x, np.float32).astype(float))
    ids = sorted(once)
    m = np.array([once[i] / np.linalg.norm(once[i]) for i in ids]).astype(np.float32).astype(float)
    out = {}
    for n, i in enumerate(ids):
        if asked is None or i in asked:
            sim = m @ m[n]
            order = [j for j in sorted(range(len(ids)), key=lambda j: (-round(sim[j], 5), ids[j])) if j != n and (least is None or sim[j] >= least)]
            out[i] = [(ids[j], sim[j]) for j in order[:k]]
    return out


def search(spark, rows, **kw):
    out = {}
    for r in similar_vectors(frame(spark, rows), dim=16, **kw).collect():
        out.setdefault(r.id, []).append((r.rank, r.other, r.similarity))
    return {i: [(o, s) for _, o, s in sorted(v)] for i, v in out.items()}


def test_visits_come_by_summed_distance():
    rng = np.random.default_rng(0)
    a, b = np.sort(rng.random(7)), np.sort(rng.random(9))
    size = rng.integers(0, 2, 63).tolist()
    sums = {i * 9 + j: a[i] + b[j] for i in range(7) for j in range(9) if size[i * 9 + j]}
    got = visit_order(a.tolist(), b.tolist(), list(range(7)), list(range(9)), size, 20)
    assert got == sorted(sums, key=sums.get)[:20]
    assert len(visit_order(a.tolist(), b.tolist(), list(range(7)), list(range(9)), size, 1000)) == sum(size)


def test_neighbours_like_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = list(enumerate(clustered(rng, 600, 16, 9))) + dirty(16)
    rows += rows[:40]
    got, want = search(spark, rows, k=5, probes=64), brute(rows, 5)
    assert got.keys() == want.keys()
    assert all(len(v) == 5 and i not in [o for o, _ in v] for i, v in got.items())
    recall = np.mean([len({o for o, _ in got[i]} & {o for o, _ in want[i]}) / 5 for i in want])
    assert recall >= 0.9
    for i in list(want)[:50]:
        assert all(s <= w + 1e-5 for (_, s), (_, w) in zip(got[i], want[i], strict=True))


def test_limit_and_stated_queries(spark):
    rng = np.random.default_rng(2)
    x = clustered(rng, 300, 16, 5)
    rows = list(enumerate(np.vstack([x, x[:60] + 0.01 * rng.standard_normal((60, 16))])))
    got, want = search(spark, rows, k=10, min_similarity=0.99), brute(rows, 10, 0.99)
    assert {i: {o for o, _ in v} for i, v in got.items()} == {i: {o for o, _ in v} for i, v in want.items() if v}
    asked = frame(spark, rows).where("doc_id % 100 = 0")
    got = search(spark, rows, k=3, probes=500, queries=asked)
    assert {i: [o for o, _ in v] for i, v in got.items()} == {i: [o for o, _ in v] for i, v in brute(rows, 3, asked={0, 100, 200, 300}).items()}


def test_a_third_are_copies(spark):
    rng = np.random.default_rng(3)
    x = clustered(rng, 200, 16, 4)
    rows = list(enumerate(np.vstack([np.repeat(x[:1], 100, 0), x[1:]])))
    got = search(spark, rows, k=4, probes=200)
    assert [o for o, _ in got[0]] == [1, 2, 3, 4] and [o for o, _ in got[50]] == [0, 1, 2, 3]
    want = brute(rows, 4)
    assert np.mean([{o for o, _ in got[i]} == {o for o, _ in want[i]} for i in want]) > 0.95


def test_no_vectors(spark):
    assert search(spark, []) == {} and search(spark, dirty(16)) == {}
    assert search(spark, [(1, [1.0] * 16)]) == {}
    rows = [(1, [1.0] * 16), (2, [1.0] * 15 + [2.0])]
    assert search(spark, rows, queries=frame(spark, rows).where("false")) == {}
    assert vector_themes(frame(spark, dirty(16)), dim=16).count() == 0


def test_themes_of_separate_clusters(spark):
    rng = np.random.default_rng(4)
    centers = np.linalg.qr(rng.standard_normal((24, 24)))[0][:6]
    label = np.repeat(np.arange(6), [400, 300, 200, 120, 80, 60])
    x = centers[label] + 0.1 * rng.standard_normal((len(label), 24))
    far = rng.standard_normal((60, 24))
    rows = list(enumerate(np.vstack([x, far]))) + dirty(24)
    rows += rows[:30]
    themes = vector_themes(frame(spark, rows), dim=24, dimensions=16)
    got = {r.id: r.theme for r in themes.collect()}
    assert len(got) == len(label) + 60
    of = [got[i] for i in range(len(label))]
    pairs = {(a, b) for a, b in zip(label, of, strict=True) if b is not None}
    assert len(pairs) == 6 and len({b for _, b in pairs}) == 6
    assert sum(t is None for t in of) < 0.03 * len(of)
    assert sum(got[i] is None for i in range(len(label), len(label) + 60)) > 50
    report = theme_report(themes, 3).collect()
    assert sorted({(r.theme, r.size) for r in report}, key=lambda p: -p[1])[0][1] >= 390 and len(report) == 18
    labels = spark.createDataFrame([(0, " Ghost"), (1, "GHOST "), (2, "war"), (500, "sea"), (99999, "none"), (3, None)], "doc_id bigint, theme string")
    names = {r.id: r.name for r in named_themes(themes, labels).collect()}
    assert names[10] == "ghost" and names[550] == "sea" and 1100 not in names


def test_more_clusters_than_any_ceiling(spark):
    rng = np.random.default_rng(12)
    centers = rng.standard_normal((120, 24))
    label = np.repeat(np.arange(120), 50)
    x = centers[label] + 0.05 * rng.standard_normal((len(label), 24))
    themes = {r.id: r.theme for r in vector_themes(frame(spark, enumerate(x)), dim=24, dimensions=16).collect()}
    pairs = {(int(a), themes[i]) for i, a in enumerate(label) if themes[i] is not None}
    assert len({b for _, b in pairs}) == 120 and len(pairs) == 120
    assert sum(t is None for t in themes.values()) < 0.01 * len(label)


def test_small_clusters_that_the_sample_misses(spark, monkeypatch):
    monkeypatch.setattr("quillvec.llm.themes.SAMPLE_ROWS", 400)
    rng = np.random.default_rng(13)
    centers = np.linalg.qr(rng.standard_normal((24, 24)))[0]
    label = np.repeat(np.arange(24), [3000] * 4 + [40] * 20)
    x = centers[label] + 0.06 * rng.standard_normal((len(label), 24))
    themes = {r.id: r.theme for r in vector_themes(frame(spark, enumerate(x)), dim=24, dimensions=16).collect()}
    pairs = {(int(a), themes[i]) for i, a in enumerate(label) if themes[i] is not None}
    assert len({a for a, _ in pairs}) == 24 and len({b for _, b in pairs}) == 24


def test_ties_go_by_the_least_id(spark):
    rng = np.random.default_rng(21)
    # axis vectors: all pairs have similarity 0, so every neighbour is a tie, and each vector has copies
    rows = [(1000 - 3 * j - c, np.eye(16)[j]) for j in range(16) for c in range(3)]
    rng.shuffle(rows)
    got = search(spark, rows, k=4, probes=300)
    want = brute(rows, 4)
    assert {i: [o for o, _ in v] for i, v in got.items()} == {i: [o for o, _ in v] for i, v in want.items()}


def test_visits_follow_the_recall(spark):
    rng = np.random.default_rng(22)
    rows = list(enumerate(rng.standard_normal((1500, 16))))
    got, want = search(spark, rows, k=5), brute(rows, 5)
    recall = np.mean([len({o for o, _ in got.get(i, [])} & {o for o, _ in want[i]}) / 5 for i in want])
    assert recall >= 0.9


def test_blocks_and_parts_are_bounded(monkeypatch):
    monkeypatch.setattr("quillvec.llm.neighbors.BLOCK_ROWS", 40)
    monkeypatch.setattr("quillvec.llm.neighbors.ASK_ROWS", 50)
    rng = np.random.default_rng(23)
    x = rng.standard_normal((600, 8)).astype(np.float32)
    x[:200] = x[0] + 1e-3 * rng.standard_normal((200, 8))
    index = MultiIndex(x, len(x))
    cell, n = np.unique(index.cells(x), return_counts=True)
    index.fill(cell, n)
    assert index.held.max() <= 40 and abs(index.held.sum() - 600) < 1e-6 and (index.block[cell] >= 0).all()
    assert {b for c in cell for b in index.blocks_of([c])} == set(range(index.blocks))
    index.share_out(np.full(index.blocks, 180.0))
    assert (index.parts == 4).all() and len(index.task) == 4 * index.blocks and index.task.max() < index.tasks


def test_split_blocks_find_the_same(spark, monkeypatch):
    rng = np.random.default_rng(24)
    x = clustered(rng, 400, 16, 5)
    rows = list(enumerate(np.vstack([np.repeat(x[:1], 60, 0), x])))
    want = search(spark, rows, k=4, probes=400)
    for name, value in (("BLOCK_ROWS", 30), ("ASK_ROWS", 100), ("TASK_ROWS", 200)):
        monkeypatch.setattr(f"quillvec.llm.neighbors.{name}", value)
    got = search(spark, rows, k=4, probes=400)
    assert {i: [o for o, _ in v] for i, v in got.items()} == {i: [o for o, _ in v] for i, v in want.items()}
