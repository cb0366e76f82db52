from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quillvec.operators import embedding, skipgram
from quillvec.queries import queries


def table(spark, docs, partitions=3):
    return spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, tokens array<string>").repartition(partitions)


def corpus(n=200, seed=3):
    rng = np.random.default_rng(seed)
    topics = [["boat", "ship", "harbor", "sail"], ["oven", "flour", "bread", "yeast"]]
    return [[str(w) for w in rng.choice(topics[i % 2], 30)] for i in range(n)]


def learned(df):
    rows = sorted(df.collect())
    return [r.word for r in rows], np.array([r.wv for r in rows])


@pytest.mark.parametrize("small", [False, True])
def test_pairs_are_all_counted_in_both_directions(spark, monkeypatch, small):
    if small:
        for name, most in (("BLOCK_CELLS", 20), ("TOKENS_AT_ONCE", 7), ("PAIRS_HELD", 5)):
            monkeypatch.setattr(skipgram, name, most)
    words = ["a", "b", "c", "d", "e", "f", "g"]
    rng = np.random.default_rng(1)
    docs = [[str(w) for w in rng.choice([*words[:-1], "unknown"], n)] for n in (0, 1, 2, 9, 40, 3)] + [None, ["a", "a", "a"]]
    expected = Counter()
    for d in docs:
        known = [w for w in d or [] if w in words]
        for i, x in enumerate(known):
            for j in range(max(0, i - 3), min(len(known), i + 4)):
                if j != i:
                    expected[words.index(x), words.index(known[j])] += (4 - abs(i - j)) / 3
    pairs, rows, got = skipgram.count_pairs(table(spark, docs), pa.array(words), 3), skipgram._block_rows(7), {}
    found = pairs.collect()
    assert sorted(r.block for r in found) == list(range(-(-7 // rows)))  # also those without a pair
    for r in found:
        for at, n in zip(np.frombuffer(r.at, np.int32), np.frombuffer(r.n, np.float32), strict=True):
            got[r.block * rows + at // 7, at % 7] = n
    assert got.keys() == expected.keys() and all(np.isclose(n, expected[k]) for k, n in got.items())
    sums = skipgram._pair_sums(pairs, 7)
    assert np.allclose(sums, [sum(n for (a, _), n in expected.items() if a == i) for i in range(7)])


def test_a_step_never_raises_the_loss_of_a_row():
    rng = np.random.default_rng(2)
    for scale in (0.01, 1, 5, 30):
        width, size = 40, 6
        x, y = (scale * rng.standard_normal((width, size)).astype(np.float32) for _ in range(2))
        n = np.where(rng.random((width, width)) < 0.2, rng.integers(1, 500, (width, width)), 0).astype(np.float32)
        weight, chance = (5 * n.sum(axis=1)).astype(np.float32), rng.dirichlet(np.ones(width))

        def loss(x, y=y, n=n, weight=weight, chance=chance):
            logit = x.astype(np.float64) @ y.T
            return (n * np.logaddexp(0, -logit) + weight[:, None] * chance * np.logaddexp(0, logit)).sum(axis=1)

        at = np.flatnonzero(n).astype(np.int32)
        before = loss(x)
        for _ in range(8):
            x = skipgram.solve_rows(x, weight, skipgram.Side(y, chance), np.eye(size, dtype=np.float32), at, n.ravel()[at])
            assert (loss(x) <= before * (1 + 1e-5) + 1e-3).all()
            before = loss(x)


def test_trained_words_know_synonyms(spark):
    words, v = learned(skipgram.train_skipgram(table(spark, corpus()), size=8, iterations=5))
    near = embedding.nearest_by_vectors(spark.createDataFrame(list(zip(words, v.tolist(), strict=True)), "word string, wv array<double>"), spark.createDataFrame([("boat",), ("oven",)], "word string"), 3).collect()
    assert {r.near for r in near if r.word == "boat"} == {"ship", "harbor", "sail"} and {r.near for r in near if r.word == "oven"} == {"flour", "bread", "yeast"}


def test_model_depends_on_counts_alone(spark):
    """Neither partitions nor repetitions of the whole corpus change it, and a word below the least count has no vector."""
    docs = [[*d, f"seldom{i}"] for i, d in enumerate(corpus(40))]
    words, v = learned(skipgram.train_skipgram(table(spark, docs, 1), size=8, iterations=6))
    assert words == sorted({"boat", "ship", "harbor", "sail", "oven", "flour", "bread", "yeast"})
    again, w = learned(skipgram.train_skipgram(table(spark, docs, 7), size=8, iterations=6))
    assert words == again and np.array_equal(v, w)
    again, w = learned(skipgram.train_skipgram(table(spark, corpus(40) * 20), size=8, iterations=6))
    assert words == again and np.allclose(v, w, atol=1e-2)


def test_tables_without_pairs(spark):
    assert skipgram.train_skipgram(table(spark, [[], None, ["once"]]), size=4).count() == 0
    words, v = learned(skipgram.train_skipgram(table(spark, [["a"], ["a"], ["b"], ["b"]]), size=4))
    assert words == ["a", "b"] and not v.any()


def test_variant_does_not_depend_on_partitions(spark, tmp_path):
    """Whatever the parts of the table and the cores, the variant's twenty rounds give the same rows."""
    docs = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(corpus(60))], "doc_id bigint, text string")
    found = []
    for parts in (1, 5):
        docs.repartition(parts).write.parquet(str(tmp_path / f"{parts}/documents.parquet"))
        found.append(sorted(queries()["e1b_word2vec"](spark, str(tmp_path / str(parts))).collect()))
    assert found[0] == found[1] and len(found[0]) == 24
