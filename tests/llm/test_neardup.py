import random

import numpy as np
import pyarrow as pa
import pytest

from quillvec.llm.components import connected_components
from quillvec.llm.neardup import MEETINGS, _frequent, _key_pairs, join_keys, near_duplicate_groups
from quillvec.llm.words import words_of

SCHEMA = "doc_id bigint, title string, plot string, node bigint, size int, key string"


def shingles(title, plot, n):
    w = words_of(title) + words_of(plot)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute(rows, n, threshold, least=20):
    root = {}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = {}
    for doc, title, plot in rows:
        if doc is None:
            continue
        root.setdefault(doc, doc)
        if len(words_of(plot)) >= least:
            sets.setdefault(doc, shingles(title, plot, n))
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in root}


def grouped(spark, rows, n, threshold):
    df = spark.createDataFrame([(*r, 5, 6, "clash") for r in rows], SCHEMA)
    got = [tuple(r) for r in near_duplicate_groups(df, words=n, threshold=threshold).collect()]
    assert len(got) == len({a for a, _ in got})
    return dict(got)


def text(rng, n):
    return " ".join(f"w{rng.randrange(3000)}" for _ in range(n))


def edited(rng, t, share):
    return " ".join(f"x{rng.randrange(10**6)}" if rng.random() < share else w for w in t.split())


@pytest.mark.parametrize(("n", "threshold", "share"), [(3, 0.5, 0.05), (5, 0.8, 0.01)])
def test_groups_like_brute_force(spark, n, threshold, share):
    rng = random.Random(n)
    rows = []
    for i in range(60):
        base = text(rng, rng.choice([22, 30, 60, 120, 400]))
        rows += [(10 * i + k, f"Title {i}", edited(rng, base, share * k)) for k in range(4)]
    rows += [(5000, None, None), (5001, "t", ""), (5002, "t", "short text"), (None, "a", rows[0][2]), rows[0], rows[5]]
    rows += [(6000 + k, "Copy", rows[8][2]) for k in range(30)]
    assert grouped(spark, rows, n, threshold) == brute(rows, n, threshold)


def test_hot_group_of_near_copies(spark):
    rng = random.Random(5)
    base = text(rng, 90)
    rows = [(i, None, edited(rng, base, 0.03)) for i in range(400)] + [(1000 + i, None, base) for i in range(300)] + [(5000 + i, None, text(rng, 80)) for i in range(200)]
    got = grouped(spark, rows, 3, 0.5)
    assert {got[r[0]] for r in rows[:700]} == {0}
    assert all(got[5000 + i] == 5000 + i for i in range(200))


def test_very_long_text_and_empty_table(spark):
    rng = random.Random(6)
    long = text(rng, 30_000)
    assert grouped(spark, [(1, "a", long), (2, "a", edited(rng, long, 0.01)), (3, "b", text(rng, 30_000))], 3, 0.5) == {1: 1, 2: 1, 3: 3}
    assert grouped(spark, [], 3, 0.5) == {}


def test_components_of_chain_star_and_loop(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(200, 201), (201, 200), (300, 300)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    want = {i: 0 for i in range(61)} | {100 + i: 100 for i in range(50)} | {200: 200, 201: 200}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_pairs_at_the_limit_share_a_key():
    rng = np.random.default_rng(7)
    stock = np.sort(rng.integers(1, 1 << 44, 300).astype(np.uint64))
    frequent = stock, rng.permutation(300) + 1
    missed = 0
    for k in range(600):
        small, more = (64, 80, 96)[k % 3], (0, 0, 32)[k % 5 % 3]
        shared = -(-(2 * small + more) // 3)  # a third of the summed sizes: a similarity of 0.5
        n_stock = int(0.4 * small) if k % 2 else small // 8
        common = np.r_[rng.choice(stock, n_stock, replace=False), rng.integers(1, 1 << 44, shared - n_stock).astype(np.uint64)]
        pair = [np.sort(np.r_[common, rng.integers(1, 1 << 44, n - shared).astype(np.uint64)]) for n in (small, small + more)]
        sizes = np.array([len(x) for x in pair])
        t, key, *_ = join_keys(np.concatenate(pair), np.repeat([0, 1], sizes), sizes, frequent, 0.5)
        missed += len(set(key[t == 0].tolist()) & set(key[t == 1].tolist())) < MEETINGS
    assert missed == 0


def test_texts_of_a_hot_key_all_meet():
    rng = np.random.default_rng(8)
    rows = []
    for key, n in ((5, 700), (6, 1), (7, 40), (9, 300)):
        size = rng.integers(30, 90, n)
        rows += [(key, int(s), int(rng.integers(0, s // 2 + 1)), 1000 * key + i) for i, s in enumerate(size)]
    want = {
        (x[3], y[3])
        for i, x in enumerate(rows)
        for y in rows[i + 1 :]
        if x[0] == y[0] and 2 * min(x[1], y[1]) >= max(x[1], y[1]) and 3 * (min(x[1] - x[2], y[1] - y[2]) + MEETINGS - 1) >= x[1] + y[1]
    }
    rows = sorted((r for r in rows for _ in range(3)), key=lambda r: (r[0], r[1], r[3]))
    for width in (64, 1_000, 10_000):
        batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[s : s + width], strict=True)], names=["key", "size", "place", "node"]) for s in range(0, len(rows), width)]
        got = {p for b in _key_pairs(0.5)(iter(batches)) for p in zip(*(c.to_pylist() for c in b.columns[:2]), strict=True)}
        assert got == want


def test_neighbours_in_a_hot_key_far_apart(spark):
    rng = random.Random(9)
    stock = [text(rng, 12) for _ in range(6)]
    rows = [(i, None, " ".join(rng.sample(stock, 3)) + " " + text(rng, 30 + i % 30)) for i in range(400)]
    rows += [(1000 + i, None, edited(rng, rows[i][2], 0.06)) for i in range(0, 400, 7)]
    assert grouped(spark, rows, 3, 0.5) == brute(rows, 3, 0.5)


def test_one_rule_for_frequent_sequences(spark):
    rng = random.Random(10)
    stock = [text(rng, 10) for _ in range(8)]
    rows = [(i, None, " ".join(rng.sample(stock, 2 + i % 5)) + " " + text(rng, 20 + i % 40)) for i in range(1_000)]
    rows += [(5000 + i, None, edited(rng, rows[i][2], 0.06)) for i in range(0, 1_000, 9)]
    df = spark.createDataFrame(rows, "id bigint, title string, text string")
    assert len(_frequent(df.limit(900), 3, 20)[0]) and len(_frequent(df, 3, 20)[0])
    assert grouped(spark, rows, 3, 0.5) == brute(rows, 3, 0.5)


@pytest.mark.parametrize("n", [200, 1_500, 6_000, 20_000])
def test_pairs_that_share_boilerplate_with_all_others(spark, n):
    rng = np.random.default_rng(n)
    stock = [f"stock{i}" for i in range(25)]
    rows = []
    for pair in range(n // 2):
        both = [f"b{pair}x{i}" for i in range(17)]
        for side in range(2):
            own = stock + both + [f"o{pair}x{side}x{i}" for i in range(18)]
            rows.append((2 * pair + side, None, " ".join(rng.permutation(own))))
    got = grouped(spark, rows, 1, 0.5)  # 42 of 78 words: 0.538
    assert sum(got[2 * p + 1] == 2 * p for p in range(n // 2)) == n // 2
    assert all(got[2 * p] == 2 * p for p in range(n // 2))
