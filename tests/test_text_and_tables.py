import numpy as np
import pytest
from pyspark.sql import functions as F

from quillvec import queries
from quillvec.functions import text as tx
from quillvec.functions.porter import stem
from quillvec.operators import corpus, embedding
from quillvec.operators import experiments as ex
from quillvec.sources import files


def one(spark, value, *columns):
    return spark.createDataFrame([(value,)], "t string").select(*columns).first()


def test_tokenizers(spark):
    text = "Sci-fi don't STOP 42 naïve"
    assert one(spark, text, tx.split_words("t").alias("x")).x == ["sci", "fi", "don", "t", "stop", "42"]
    assert one(spark, text, tx.word_tokens("t").alias("x")).x == ["do", "stop", "42"]
    assert one(spark, text, tx.without_stop_words(tx.split_words("t")).alias("x")).x == ["sci", "fi", "stop", "42"]
    for empty in ("", None):
        assert one(spark, empty, tx.split_words("t").alias("x")).x == [] == one(spark, empty, tx.word_tokens("t").alias("x")).x


def test_published_stems():
    pairs = "caresses caress ponies poni ties ti cats cat agreed agre motoring motor sized size hopping hop falling fall filing file happy happi relational relat generalization gener electrical electr adoption adopt rate rate controlling control probate probat cease ceas".split()
    assert [stem(w) for w in pairs[::2]] == pairs[1::2]


def test_tokenize_frame(spark):
    df = spark.createDataFrame([(1, "The cats were hopping, the cats"), (2, None), (3, "the")], "id int, t string")
    got = {r.id: r.tokens for r in tx.tokenize(df, "id", F.col("t")).collect()}
    assert got == {1: ["cat", "hop", "cat"], 2: [], 3: []}


def test_text_columns(spark):
    df = spark.createDataFrame([("A", None)], "a string, b string")
    assert df.select(tx.concat_with_nulls("a", "b").alias("x")).first().x == "A nan"
    assert one(spark, "x" * 200, tx.preview("t").alias("x")).x == "x" * 150 + "..."
    assert one(spark, None, tx.matches("t", "a").alias("x")).x is False


def test_pooling_and_weights(spark):
    tokens = spark.createDataFrame([(1, ["a", "a", "b", "zz"]), (2, ["zz"]), (3, [])], "doc_id bigint, tokens array<string>")
    words = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 3.0])], "word string, wv array<double>")
    assert {r.doc_id: r.v for r in embedding.mean_pool(tokens, words, 2).collect()} == {1: [pytest.approx(2 / 3), 1.0], 2: [0.0, 0.0], 3: [0.0, 0.0]}
    w = {(r.doc_id, r.term): (r.tf, r.w) for r in embedding.tfidf(tokens).collect()}
    assert w[1, "a"] == (2, pytest.approx(2 * (np.log(4 / 2) + 1), abs=1e-6)) and w[2, "zz"][1] == pytest.approx(np.log(4 / 3) + 1, abs=1e-6)


def test_lsi_singular_values(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [f"t{min(int(rng.exponential(6)), 29)}" for _ in range(20)]) for i in range(60)] + [(99, [])]
    tokens = spark.createDataFrame(rows, "doc_id bigint, tokens array<string>")
    with pytest.raises(ValueError):
        embedding.LSI().transform_query(["t1"])
    model = embedding.LSI(k=5, max_terms=100, passes=8).fit(tokens)
    dense = np.zeros((61, len(model.terms)))
    at = {t: i for i, t in enumerate(model.terms)}
    for n, (_, ts) in enumerate(rows):
        for t in ts:
            dense[n, at[t]] += model.idf[at[t]]
    assert np.allclose(model.sigma, np.linalg.svd(dense, compute_uv=False)[:5], rtol=1e-3)
    assert model.doc_vectors.count() == 61
    assert model.search(rows[3][1], 1).first().doc_id == 3
    assert model.search(["unknown"], 3).count() == 3


def test_lsi_keeps_every_term(spark, monkeypatch):
    rows = [(i, [f"t{(i * 7 + j) % 2_100}" for j in range(12)] + ["all"]) for i in range(2_100)]
    tokens = spark.createDataFrame(rows, "doc_id bigint, tokens array<string>")
    model = embedding.LSI(k=4, passes=1).fit(tokens)
    assert len(model.terms) == 2_101 and model.term_vectors.shape == (2_101, 4)
    kept = []
    monkeypatch.setattr(embedding.LSI, "fit", lambda self, tokens: kept.append((self.k, self.max_terms)) or model)
    monkeypatch.setattr(queries, "read_table", lambda s, d, name: tokens)
    queries.l8_lsi_search(spark, "")
    assert kept == [(200, None)]


def test_lsi_holds_some_columns_of_the_terms_at_once(spark, monkeypatch):
    from pyspark import SparkContext

    rng = np.random.default_rng(1)
    rows = [(i, [f"t{min(int(rng.exponential(12)), 79)}" for _ in range(20)]) for i in range(90)] + [(99, [])]
    tokens = spark.createDataFrame(rows, "doc_id bigint, tokens array<string>")
    sizes, broadcast = [], SparkContext.broadcast
    monkeypatch.setattr(SparkContext, "broadcast", lambda self, x: sizes.append(np.size(x)) or broadcast(self, x))
    monkeypatch.setattr(embedding, "HELD_NUMBERS", 300, raising=False)
    monkeypatch.setattr(embedding, "TERM_BLOCK", 16)
    model = embedding.LSI(k=6, passes=12).fit(tokens)
    found = {r.doc_id: r.score for r in model.search(["t1", "t3", "t3"], 91).collect()}
    assert max(sizes) <= 300 < model.term_vectors.size
    at = {t: i for i, t in enumerate(model.terms)}
    dense = np.zeros((91, len(at)))
    for n, (_, ts) in enumerate(rows):
        for t in ts:
            dense[n, at[t]] += model.idf[at[t]]
    left, sigma, right = np.linalg.svd(dense, full_matrices=False)
    assert np.allclose(model.sigma, sigma[:6], rtol=1e-3)
    q = np.zeros(len(at))
    q[at["t1"]], q[at["t3"]] = model.idf[at["t1"]], 2 * model.idf[at["t3"]]
    q, docs = right[:6] @ q, left[:, :6] * sigma[:6]
    want = docs @ q / (np.linalg.norm(docs, axis=1) * np.linalg.norm(q) + 1e-10)
    assert np.allclose([found[i] for i, _ in rows], want, atol=0.01)
    stored = {r.doc_id: r.v for r in model.doc_vectors.collect()}
    assert np.allclose(np.abs([stored[i] for i, _ in rows]), np.abs(docs), atol=0.05)


def test_lsi_of_fewer_dimensions_than_asked(spark):
    tokens = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "b"]), (3, ["c", "d", "e"])], "doc_id bigint, tokens array<string>")
    model = embedding.LSI(k=200).fit(tokens)
    assert np.isfinite(model.sigma).all() and (model.sigma > 1e-3).sum() == 2
    assert [(r.doc_id, r.score) for r in model.search(["c"], 3).collect()] == [(3, 1.0), (1, 0.0), (2, 0.0)]


def test_reports(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), (None, 4)], "k string, v int")
    assert {r.k: r.n for r in corpus.value_counts(df, "k").collect()} == {"a": 2}
    assert corpus.null_counts(df).first().asDict() == {"k": 1, "v": 1, "total": 2}
    assert corpus.shape(df).first()[:] == (3, 2)
    assert corpus.summary(df, F.col("v")).first()[:] == (2.5, 2.5, 1, 4, 5)


def test_comparisons(spark):
    runs = spark.createDataFrame([("LSH", 16, 1.0), ("LSH", 32, 1.0), ("VQ", 1, 0.4), ("PQ", 2, None)], "m string, b int, r double")
    assert {(x.m, x.b) for x in ex.best_per_group(runs, "m", "r", ["b"]).collect()} == {("LSH", 16), ("VQ", 1), ("PQ", 2)}
    got = {x.m: x.r for x in ex.lookup(spark, ["VQ", "X"], runs, "m", "r", ["b"]).collect()}
    assert got["VQ"] == 0.4 and np.isnan(got["X"])
    both = ex.union_by_name(runs.select("m", "b"), runs.select("m", "r"))
    assert both.columns == ["m", "b", "r"] and both.count() == 8
    assert [ex.lsh_bits(d) for d in (50, 100, 200)] == [96, 192, 256]
    assert ex.sample_ids(500, 50)[:4] == [361, 73, 374, 155]
    names = spark.createDataFrame([(" faiss_ivf",), ("FAISS-IVF ",), (None,)], "m string").select(ex.method_name("m").alias("m"))
    assert [r.m for r in names.collect()] == ["FAISS-IVF", "FAISS-IVF", None]
    _, seconds = ex.timed(lambda: spark.range(10))
    assert seconds > 0


def test_files(spark, tmp_path):
    (tmp_path / "1990s-movies.csv").write_text('title,plot\n"A ""b""","x\ny"\nC,\n')
    (tmp_path / "2000s-movies.csv").write_text("title,plot\nD,z\n")
    df = files.read_labelled_csv(spark, str(tmp_path / "*.csv"))
    assert {tuple(r) for r in df.collect()} == {('A "b"', "x\ny", "1990s"), ("C", None, "1990s"), ("D", "z", "2000s")}
    placed = files.with_positions(df, "decade", "title")
    assert {r.title: r.doc_id for r in placed.collect()} == {'A "b"': 0, "C": 1, "D": 2}
    vectors = spark.createDataFrame([(0, [1.0, 0.5])], "doc_id bigint, v array<double>")
    files.save_embeddings(vectors, placed, str(tmp_path / "out"))
    v, meta = files.load_embeddings(spark, str(tmp_path / "out"))
    assert [tuple(r) for r in v.collect()] == [(0, [1.0, 0.5])] and meta.count() == 3
    results = spark.createDataFrame([("VQ", 1, 8, 0.5, 0.6, 0.1, 0.01, 100, 64)], files.RESULTS["VQ"])
    files.save_results(results, str(tmp_path / "vq"))
    assert files.read_results(spark, str(tmp_path / "vq"), "VQ").collect() == results.collect()
    (tmp_path / "log.csv").write_text("timestamp,method,query_index,top_k,n_docs,dim,n_candidates,candidate_ratio,recall_at_k,n_overlap\n2025,VQ,42,10,100,64,5,0.05,0.5,5\nVQ,200,10,0.5,0.009\n")
    log = files.read_run_log(spark, str(tmp_path / "log.csv")).collect()
    assert [r._corrupt_record is None for r in log] == [True, False] and log[0].n_overlap == 5


def test_model_round_trip(spark, tmp_path):
    from pyspark.ml.feature import Word2VecModel

    tokens = spark.createDataFrame([(1, ["a", "b", "a", "c"] * 20)], "doc_id bigint, tokens array<string>")
    model = embedding.train_word2vec(tokens, size=4)
    files.save_model(model, str(tmp_path / "w2v"))
    again = embedding.word_vectors(Word2VecModel.load(str(tmp_path / "w2v"))).orderBy("word").collect()
    assert again == embedding.word_vectors(model).orderBy("word").collect() and len(again) == 3


def test_word_tokens_like_the_pattern(spark):
    import re

    splits = re.compile(r"[^\W_]+(?:-[^\W_]+)*(?='(?:s|m|d|ll|re|ve)\b)|'(?:s|m|d|ll|re|ve)\b|[^\W_]+?(?=n't\b)|n't\b|[^\W_]+(?:-[^\W_]+)*|\S")
    texts = ["I can't, won't and couldn't; they're Anna's well-known mother-in-law's", "a_b c--d 3.5% naïve l'été isn't n't 'tis 'd", "", "x" * 5000 + " don't " * 300, " a b\r\nc\td"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.x for r in df.select("i", tx.word_tokens("t").alias("x")).collect()}
    assert got == {i: [w for w in splits.findall(t.lower()) if re.fullmatch("[a-z0-9]+", w)] for i, t in enumerate(texts)}


def test_labelled_csv_round_trip(spark, tmp_path):
    rows = [("1", 'quoted "words", and\nlines'), ("2", None), ("3", "plain"), ("4", "back\\slash")]
    for label, part in (("1990s", rows[:2]), ("none", rows[2:])):
        files.save_labelled_csv(spark.createDataFrame(part, files.MOVIES), str(tmp_path), label)
    got = {r.title: (r.plot, r.decade) for r in files.read_labelled_csv(spark, f"{tmp_path}/*-movies.csv").collect()}
    assert got == {t: (p, "1990s" if t in "12" else "none") for t, p in rows}


def test_samples_from_one_stream():
    stream = np.random.RandomState(42)
    assert ex.sample_stream(500, [50, 10, 10]) == [stream.choice(500, n, replace=False).tolist() for n in (50, 10, 10)]
    assert ex.sample_stream(500, [50])[0] == ex.sample_ids(500, 50) and len(ex.sample_stream(4, [50])[0]) == 4
    assert (ex.pq_parts(50), ex.pq_parts(100), ex.pq_parts(200)) == (2, 2, 4)


def test_trained_words_know_synonyms(spark):
    import random

    rng = random.Random(5)
    topics = [["boat", "ship", "harbor", "sail"], ["oven", "flour", "bread", "yeast"]]
    docs = [(i, [rng.choice(topics[i % 2]) for _ in range(30)]) for i in range(300)]
    model = embedding.train_word2vec(spark.createDataFrame(docs, "doc_id bigint, tokens array<string>"), size=8, min_count=1, iterations=3)
    near = embedding.nearest_words(model, spark.createDataFrame([("boat",), ("oven",)], "word string"), 3).collect()
    assert {r.near for r in near if r.word == "boat"} == {"ship", "harbor", "sail"} and {r.near for r in near if r.word == "oven"} == {"flour", "bread", "yeast"}
    assert sorted(r.rank for r in near) == [1, 1, 2, 2, 3, 3]
