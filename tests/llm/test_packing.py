import itertools
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillvec.llm.packing import Plan, _best_configuration, pack_texts, plan_containers, solve_program, token_count

TOKEN = re.compile(r"[^\W_]+|[^\s]")


def first_fit(histogram, capacity):
    room = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            at = next((i for i, r in enumerate(room) if r >= length), None)
            if at is None:
                room.append(capacity - length)
            else:
                room[at] -= length
    return len(room)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 40), max_size=12), st.just(50))
def test_plans_hold_everything_once(histogram, capacity):
    plan = plan_containers(histogram, capacity)
    fill, held = defaultdict(int), defaultdict(int)
    for length, n, start, each in plan.slots:
        held[length] += n
        for r in range(n):
            fill[start + r // each] += length
    assert dict(held) == histogram
    assert all(v <= capacity for v in fill.values())
    assert plan.containers <= first_fit(histogram, capacity) + 1


def test_plan_is_tight_for_many_short_texts():
    histogram = {n: 1 + (n * 7919) % 40 for n in range(5, 200)}
    total = sum(a * b for a, b in histogram.items())
    assert plan_containers(histogram, 512).containers <= -(-total // 512) * 1.01 + 1


def test_tokens(spark):
    texts = ["Don't stop_2!", "a b c", "", None, "é½ 漢字 ☂☂", "x​y", "  \n\t\x85 ", "1,000.5"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.n for r in df.select("i", token_count(F.col("t")).alias("n")).orderBy("i").collect()]
    assert got == [len(TOKEN.findall(t or "")) for t in texts]


def packed(spark, rows, capacities):
    texts = spark.createDataFrame([(a, b, "x", 1, 2) for a, b in rows], "doc_id bigint, tokens bigint, container string, part int, piece int")
    sizes = spark.createDataFrame(capacities, "size_id int, capacity bigint")
    return [r.asDict() for r in pack_texts(texts, sizes).collect()]


def test_texts_in_containers(spark):
    rows = [(i, (i * 37) % 90) for i in range(400)] + [(1000, 250), (1001, None), (1002, 0), (1003, 100), (None, 12), (5, 185)]
    rows += [(2000 + i, 33) for i in range(300)]
    got = packed(spark, rows, [(1, 100), (2, 64), (3, None), (4, 0)])
    for size_id, capacity in ((1, 100), (2, 64)):
        mine = [r for r in got if r["size_id"] == size_id]
        fill, whole = defaultdict(int), defaultdict(list)
        for r in mine:
            fill[r["container"]] += r["tokens"]
            whole[r["doc_id"]].append(r)
        assert max(fill.values()) <= capacity and set(fill) == set(range(len(fill)))
        assert sum(fill.values()) == sum(b or 0 for _, b in rows)
        assert len(fill) <= first_fit(Counter(r["tokens"] for r in mine if r["tokens"]), capacity) + 1
        for doc, n in rows:
            if doc not in (5, None):
                assert sum(r["tokens"] for r in whole[doc]) == (n or 0)
                assert len(whole[doc]) == max(1, -(-(n or 0) // capacity))
    assert {r["size_id"] for r in got} == {1, 2}


@pytest.mark.parametrize("rows", [[], [(1, None), (2, 0)]])
def test_nothing_to_pack(spark, rows):
    assert [r["container"] for r in packed(spark, rows, [(1, 10)])] == [0] * len(rows)


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 700), st.integers(1, 30), max_size=40), st.integers(700, 3000))
def test_plan_is_never_worse_than_best_fit(histogram, capacity):
    plan = plan_containers(histogram, capacity)
    fill, held = defaultdict(int), defaultdict(int)
    for length, n, start, each in plan.slots:
        held[length] += n
        for r in range(n):
            fill[start + r // each] += length
    assert dict(held) == histogram and len(fill) == plan.containers
    assert all(v <= capacity for v in fill.values())
    assert plan.containers <= Plan(capacity).finish(list(histogram.items())).containers


def test_program_proves_its_bound():
    units, counts = np.array([24, 25, 26, 3]), np.array([18, 1, 4, 1])
    program = solve_program(units, counts, 50)
    assert (program.uses @ units <= 50).all() and ((program.times @ program.uses) >= counts - 1e-9).all()
    assert 11 <= program.bound <= 12 + 1e-9


def test_large_capacity_in_time():
    rng = np.random.default_rng(4)
    lengths, counts = np.unique(np.clip(rng.lognormal(7.5, 1.0, 200_000), 1, 32_768).astype(int), return_counts=True)
    began = time.perf_counter()
    plan = plan_containers(dict(zip(lengths.tolist(), counts.tolist(), strict=True)), 32_768)
    assert time.perf_counter() - began < 30
    assert plan.containers <= -(-int(lengths @ counts) // 32_768) * 1.01 + 1


@pytest.mark.parametrize("capacity", [524_288, 1 << 20, 1 << 40])
def test_capacities_beyond_32_bits(spark, capacity):
    rows = [(i, n) for i, n in enumerate([capacity, 5, capacity - 5, 3 * capacity + 7, capacity // 2, capacity // 2, 1])]
    got = packed(spark, rows, [(1, capacity)])
    fill = defaultdict(int)
    for r in got:
        fill[r["container"]] += r["tokens"]
    assert max(fill.values()) <= capacity and sum(fill.values()) == sum(n for _, n in rows)
    assert len(fill) == -(-sum(n for _, n in rows) // capacity)


def test_null_ids_and_sizes_and_clashing_names(spark):
    got = packed(spark, [(None, 10)] * 50 + [(7, 10)] * 50, [(None, 100), (1, 20)])
    for size_id, capacity in ((None, 100), (1, 20)):
        mine = [r for r in got if r["size_id"] == size_id]
        assert len(mine) == 100 and len({r["container"] for r in mine}) == 1000 // capacity
        assert {r["capacity"] for r in mine} == {capacity}


def test_best_configuration_like_trying_all():
    rng = np.random.default_rng(6)
    for _ in range(60):
        units = np.sort(rng.choice(np.arange(1, 14), 4, replace=False))
        counts, weights = rng.integers(1, 5, 4), rng.random(4)
        use = _best_configuration(units, counts, weights, 20)
        every = np.array(list(itertools.product(*(range(c + 1) for c in counts))))
        assert use @ units <= 20 and (use <= counts).all()
        assert abs(use @ weights - (every @ weights)[every @ units <= 20].max()) < 1e-9
