import random

from hypothesis import given, settings
from hypothesis import strategies as st

from quillvec.llm import leaks
from quillvec.llm.leaks import edit_distance, leaked_passages, piece_cuts
from quillvec.llm.words import WordHashes, hashed, words_of


def table_distance(p, t):
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        new = [i]
        for j, b in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=80), st.lists(st.integers(0, 5), max_size=90))
def test_bit_parallel_distance(p, t):
    assert edit_distance(p, t) == (table_distance(p, t) if p else 0)


def runs(text):
    w = words_of(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_leaks_like_brute_force(spark):
    rng = random.Random(3)
    words = lambda n: [f"w{rng.randrange(400)}" for _ in range(n)]
    items = [(i, words(rng.randrange(20, 70))) for i in range(40)]
    docs = []
    for d in range(200):
        body = words(rng.randrange(5, 300))
        for _ in range(rng.randrange(3)):
            item = rng.choice(items)[1]
            a = rng.randrange(len(item))
            part = [x if rng.random() > 0.06 else "zz" for x in item[a : a + rng.randrange(5, 70)]]
            body[len(body) // 2 : len(body) // 2] = part
        docs.append((d, " ".join(body)))
    docs += [(900, None), (901, ""), (902, "one two"), (None, " ".join(items[0][1])), docs[3], (903, " ".join(items[1][1] * 300))]
    table = [(i, " ".join(w)) for i, w in items] + [(100, None), (101, ""), (102, "too few"), (None, "a b c d e f"), (0, " ".join(items[0][1]))]
    got = leaked_passages(
        spark.createDataFrame([(*d, 7, "x") for d in docs], "doc_id bigint, text string, item_id int, coverage string"), spark.createDataFrame([(*t, "q") for t in table], "item_id bigint, passage string, doc_id string")
    ).collect()
    found = {(r.doc_id, r.item_id): r for r in got}
    assert len(found) == len(got)
    for d, t in docs:
        if d is None or not t:
            continue
        of_doc = runs(t)
        for i, w in items:
            share = len(runs(" ".join(w)) & of_doc) / len(runs(" ".join(w)))
            distance = table_distance(w, words_of(t)) if d < 40 else None
            if share >= 0.25 or (distance is not None and distance <= 0.25 * len(w)):
                assert abs(found[d, i].coverage - share) < 1e-9
                assert distance is None or found[d, i].distance >= distance
            elif (d, i) in found:
                assert found[d, i].distance <= 0.25 * len(w)


def test_empty_tables(spark):
    docs, items = "doc_id bigint, text string", "item_id bigint, passage string"
    one = spark.createDataFrame([(1, "a b c d e f g")], docs)
    assert leaked_passages(one, spark.createDataFrame([], items)).count() == 0
    assert leaked_passages(spark.createDataFrame([], docs), spark.createDataFrame([(1, "a b c d e f g")], items)).count() == 0
    assert [r.coverage for r in leaked_passages(one, spark.createDataFrame([(1, "A b, c d e F g")], items)).collect()] == [1.0]


def test_every_alteration_within_the_budget_is_found(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, [rng.choice(vocabulary) for _ in range(1 + i % 12)]) for i in range(60)]
    docs = []
    for d in range(300):
        words = list(items[d % 60][1])
        for _ in range(rng.randrange(len(words) // 4 + 1)):
            at, kind = rng.randrange(len(words) + 1), rng.randrange(3)
            if kind == 0:
                words.insert(at, "new")
            elif at < len(words):
                words[at : at + 1] = ["other"] if kind == 1 else []
        pad = lambda: [f"p{rng.randrange(5)}" for _ in range(rng.randrange(40))]
        docs.append((d, " ".join(pad() + words + pad())))
    got = leaked_passages(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id bigint, passage string")).collect()
    found = {(r.doc_id, r.item_id): r for r in got}
    for d, t in docs:
        for i, w in items:
            distance = table_distance(w, words_of(t))
            if distance <= len(w) // 4:
                r = found[d, i]
                assert r.distance == distance and r.form == ("whole" if not distance else "altered")
                assert (r.coverage is None) == (len(w) < 5)
            elif (d, i) in found:
                assert found[d, i].form == "part" and found[d, i].coverage >= 0.25


def test_eight_words_two_edits(spark):
    docs = spark.createDataFrame([(1, "x a b c Q d e f R h y")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "a b c d e f g h")], "item_id bigint, passage string")
    assert [(r.distance, r.form) for r in leaked_passages(docs, items).collect()] == [(2, "altered")]


def test_pieces_are_more_than_the_budget():
    for n in range(1, 200):
        for share in (0.0, 0.1, 0.25, 0.5, 0.9):
            budget = min(int(share * n), n - 1)
            cuts = piece_cuts(n, budget)
            assert len(cuts) > budget and max(size for _, size in cuts) <= 3
            assert [a for a, _ in cuts] == [sum(size for _, size in cuts[:i]) for i in range(len(cuts))] and sum(size for _, size in cuts) == n


def test_blocks_of_passages_and_of_hits(spark, monkeypatch):
    rng = random.Random(12)
    items = [(i, "the old mill by the river " + " ".join(f"w{rng.randrange(300)}" for _ in range(12))) for i in range(60)]
    docs = [(d, " ".join(f"w{rng.randrange(300)}" for _ in range(30)) + " the old mill by the river " + items[d % 60][1]) for d in range(120)]
    args = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, passage string")
    want = sorted(map(tuple, leaked_passages(*args).collect()))
    assert {(d, d % 60) for d in range(120)} <= {r[:2] for r in want}
    monkeypatch.setattr(leaks, "MAX_ITEMS", 25)
    assert sorted(map(tuple, leaked_passages(*args).collect())) == want
    flat, offsets = hashed([words_of(t) for _, t in docs], WordHashes())
    passages = leaks.Passages(items, 0.25, 0.25)
    whole = sorted(leaks._pairs(flat, offsets, passages).tolist())
    monkeypatch.setattr(leaks, "HITS_AT_ONCE", 50)
    assert sorted(leaks._pairs(flat, offsets, passages).tolist()) == whole
