"""Queries over the reference's operators; `oracles` holds the SQL they are compared with.

Vectors are the usable ones of doc_vectors_w2v at unit length, one for each id,
and the query set is the table `queries`; texts are those of documents and movies.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillvec.functions import text as tx
from quillvec.functions import vectors as vx
from quillvec.functions.ranking import topk
from quillvec.operators import corpus, embedding, exact, ivf, kmeans, lsh, metrics, pq, skipgram
from quillvec.operators import experiments as ex
from quillvec.plans.lineage import cut, new_path, own
from quillvec.sources import read_table
from quillvec.sources.files import load_embeddings, read_labelled_csv, read_results, save_embeddings, save_labelled_csv, save_results, with_positions

from .oracles import oracle_sql  # noqa: F401

DIM, K = 64, 10
#: Settings of the deterministic queries, which the SQL repeats.
CELLS, ROUNDS, PQ_M, PQ_K = 8, 3, 4, 16
LSH_M, LSH_B = 128, 16
TABLE_K, TABLES = 8, 10
#: The reference's sizes: cells, lists, codes, and probes of its sweeps.
VQ_CELLS, LISTS, PQ_CODES, PROBES = 200, 100, 256, [1, 2, 5, 10, 20]
BITS = 60


def _vectors(s: SparkSession, d: str) -> DataFrame:
    return vx.usable_unit_vectors(read_table(s, d, "doc_vectors_w2v"), "doc_id", "doc_vectors", DIM)


def _queries(s: SparkSession, d: str) -> DataFrame:
    return read_table(s, d, "queries").select("qid", "qv")


def _embeddings(s: SparkSession, d: str) -> DataFrame:
    return read_table(s, d, "embeddings").select(F.col("vec_id").alias("doc_id"), vx.as_doubles("embedding").alias("v"), "label")


def _truth(s, d) -> DataFrame:
    return exact.knn(_vectors(s, d), _queries(s, d), K, "l2")


def _half(s, d) -> DataFrame:
    """A degraded ranking to be judged: nearest by the first half of the components."""
    docs = _vectors(s, d).select("doc_id", vx.dims("v", DIM // 2).alias("v"))
    return exact.knn(docs, _queries(s, d).select("qid", vx.dims("qv", DIM // 2).alias("qv")), K, "l2")


def _stored(s, d) -> DataFrame:
    """The vectors written once, for what reads them in several rounds."""
    return cut(_vectors(s, d), "vectors")


def _cells(s, d, cells: int = CELLS) -> tuple[DataFrame, np.ndarray]:
    docs = _stored(s, d)
    return docs, kmeans.lloyd(docs, cells, ROUNDS, stored=True)[0]


def _tokens(s, d) -> DataFrame:
    return read_table(s, d, "documents").select("doc_id", tx.split_words("text").alias("tokens"))


def _rounded_list(v) -> F.Column:
    return F.transform(v, lambda x: F.round(x, 6) + 0.0)


# exact search


def x1_exact_l2(s, d):
    return _truth(s, d)


def x2_exact_cosine(s, d):
    return exact.knn(_vectors(s, d), _queries(s, d), K, "cosine")


def x3_flat_l2sq(s, d):
    return exact.knn(_vectors(s, d), _queries(s, d), K, "l2sq")


def x4_similar_items(s, d):
    near = exact.knn(_vectors(s, d), _queries(s, d), 5, "dot", exclude_self=True)
    meta = read_table(s, d, "doc_metadata").groupBy("doc_id").agg(F.min("title").alias("title"), F.min("decade").alias("decade"))
    return near.join(meta, "doc_id", "left").select("qid", "rank", "doc_id", "title", "decade", "score")


def x5_dot_top5(s, d):
    return exact.knn(_vectors(s, d), _queries(s, d), 5, "dot")


def k1_cosine_columns(s, d):
    """All pairs of query and embedding, by column expressions."""
    q = _queries(s, d)
    e = _embeddings(s, d)
    return e.crossJoin(F.broadcast(q)).select("qid", "doc_id", F.round(vx.cosine_of_query("qv", "v"), 6).alias("cosine"), F.round(vx.euclidean("qv", "v"), 6).alias("distance"), F.round(vx.dot("qv", "v"), 6).alias("dot"))


def rel_dim_prefix_knn(s, d):
    return _half(s, d)


def rel_row_prefix(s, d):
    """The reference's row prefix: vectors of the ids below 500, as its scaling runs take them."""
    return _vectors(s, d).where("doc_id < 500").select("doc_id", F.round(vx.norm(vx.dims("v", 16)), 6).alias("norm16"))


# vector columns


def e5_norms(s, d):
    return read_table(s, d, "embeddings").select("vec_id", F.round(vx.norm("embedding"), 6).alias("norm"))


def e4_normalize(s, d):
    v = vx.usable_vectors(read_table(s, d, "doc_vectors_w2v"), "doc_id", "doc_vectors", DIM)
    return v.select("doc_id", F.round(F.element_at(vx.l2_normalize("v"), 1), 6).alias("first"), F.round(vx.norm(vx.l2_normalize("v")), 6).alias("norm"))


def e4b_normalize_epsilon(s, d):
    v = vx.usable_vectors(read_table(s, d, "doc_vectors_w2v"), "doc_id", "doc_vectors", DIM)
    return v.select("doc_id", F.round(F.element_at(vx.l2_normalize("v", 1e-10), 1), 6).alias("first"))


def s2_cast_vectors(s, d):
    return read_table(s, d, "embeddings").select("vec_id", F.size("embedding").alias("dim"), F.round(F.aggregate(vx.as_doubles("embedding"), F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


# inverted file


def v1_centroids(s, d):
    docs, c = _cells(s, d)
    return kmeans.centroid_table(docs, c).select("cid", F.posexplode("cv").alias("i", "x")).select("cid", "i", F.round("x", 6).alias("x"))


def v2_assign(s, d):
    docs, c = _cells(s, d)
    return kmeans.assign(docs, c).select("doc_id", "cid")


def v3_probe(s, d):
    _, c = _cells(s, d)
    return ivf.probes(_queries(s, d), c, 2).select("qid", "cid", F.round("d2", 6).alias("d2"), "probe_rank")


def v5_search(s, d):
    docs, c = _cells(s, d)
    return ivf.search(kmeans.assign(docs, c), _queries(s, d), c, K, 2)


def v6_candidate_ratio(s, d):
    docs, c = _cells(s, d)
    return ivf.candidate_ratio(kmeans.assign(docs, c), _queries(s, d), c, 2)


def b1_sweep(s, d):
    docs, c = _cells(s, d)
    return ivf.sweep(kmeans.assign(docs, c), _queries(s, d), c, [1, 2, 5], K)


def b1_sweep_metrics(s, d):
    """Mean recall of each setting of the sweep against exact search."""
    t = _truth(s, d)
    found = b1_sweep(s, d).join(t.select("qid", "doc_id"), ["qid", "doc_id"]).groupBy("n_probes", "qid").count()
    grid = t.select("qid").distinct().crossJoin(F.broadcast(s.createDataFrame([(1,), (2,), (5,)], "n_probes int")))
    return grid.join(found, ["n_probes", "qid"], "left").groupBy("n_probes").agg(F.round(F.avg(F.coalesce("count", F.lit(0)) / K), 6).alias("recall_at_k"))


def f2_ivfflat(s, d):
    docs, c = _cells(s, d)
    near = ivf.search(kmeans.assign(docs, c), _queries(s, d), c, K, 5, squared=True)
    return near.withColumn("nominal_ratio", F.round(F.lit(5 / CELLS), 6))


def _quality(s, docs: DataFrame, centers: np.ndarray) -> DataFrame:
    """Cells, rows, and the share of the variance about the mean that stays within cells."""
    one = np.array(docs.agg(*[F.avg(F.col("v")[i]) for i in range(DIM)]).first(), float)[None]
    return s.createDataFrame([(len(centers), docs.count(), round(kmeans.inertia(docs, centers) / kmeans.inertia(docs, one), 6))], "cells int, n bigint, within_share double")


def v1_mllib(s, d):
    """How well MLlib's cells fit, at the reference's number; they depend on partitioning, so there is no SQL."""
    docs = _stored(s, d)
    return _quality(s, docs, kmeans.mllib_kmeans(docs, ex.clip(docs.count(), 1, VQ_CELLS)))


def v1_trained(s, d):
    """How well cells trained from spread-out starts fit, at the reference's number; the draws have no SQL."""
    docs = _stored(s, d)
    return _quality(s, docs, kmeans.train(docs, VQ_CELLS)[0])


def v7_search_trained(s, d):
    """The ten nearest over the reference's 200 trained cells and 5 probes; the draws have no SQL."""
    docs = _stored(s, d)
    c = kmeans.train(docs, VQ_CELLS)[0]
    return ivf.search(kmeans.assign(docs, c), _queries(s, d), c, K, 5)


def v5_search_200(s, d):
    """The reference's 200 cells and 5 probes, from the least ids as SQL can."""
    docs, c = _cells(s, d, VQ_CELLS)
    return ivf.search(kmeans.assign(docs, c), _queries(s, d), c, K, 5)


def b1_sweep_200(s, d):
    """Recall, gain and share of candidates of the reference's sweep: 200 cells, probes 1 to 20."""
    docs, c = _cells(s, d, VQ_CELLS)
    assigned, q, t = kmeans.assign(docs, c), _queries(s, d), _truth(s, d)
    judged = metrics.by_setting(ivf.sweep(assigned, q, c, PROBES, K), t, "n_probes", K)
    total = docs.agg(F.count("*").alias("total"))
    sizes = ivf.probes(q, c, max(PROBES)).join(assigned.groupBy("cid").count(), "cid", "left")
    each = sizes.withColumn("n_probes", F.explode(F.array([F.lit(n) for n in PROBES]))).where("probe_rank <= n_probes").groupBy("n_probes", "qid").agg(F.sum(F.coalesce("count", F.lit(0))).alias("n"))
    ratio = each.crossJoin(F.broadcast(total)).groupBy("n_probes").agg(F.round(F.avg(F.col("n") / F.col("total")), 6).alias("candidate_ratio"))
    return judged.join(ratio, "n_probes")


def b7_ivf_sweep(s, d):
    """The inverted file of 100 lists over probes 1 to 20; the ratio is the nominal one."""
    docs, c = _cells(s, d, LISTS)
    found = ivf.sweep(kmeans.assign(docs, c), _queries(s, d), c, PROBES, K)
    return metrics.by_setting(found, _truth(s, d), "n_probes", K).withColumn("nominal_ratio", F.round(F.col("n_probes") / LISTS, 6))


def b7_ivfpq_sweep(s, d):
    """The inverted file of 100 lists with residuals in 4 x 256 codes over probes 1 to 20; SQL would take too long."""
    docs, c = _cells(s, d, LISTS)
    assigned = kmeans.assign(docs, c)
    left = cut(pq.residuals(assigned, c), "residuals")
    quantizer = pq.ProductQuantizer(PQ_M, PQ_CODES, ROUNDS).fit(left.select("doc_id", "v"), stored=True)
    codes = cut(quantizer.encode(left), "codes")
    found = [pq.ivfpq_answer(codes, _queries(s, d), c, quantizer, K, n).withColumn("n_probes", F.lit(n)) for n in PROBES]
    return metrics.by_setting(ex.union_by_name(*found), _truth(s, d), "n_probes", K).withColumn("nominal_ratio", F.round(F.col("n_probes") / LISTS, 6))


# product quantisation


def _pq(s, d, docs=None, m: int = PQ_M, k: int = PQ_K) -> pq.ProductQuantizer:
    return pq.ProductQuantizer(m, k, ROUNDS).fit(_vectors(s, d) if docs is None else docs, stored=docs is not None)


def q2_subvectors(s, d):
    return pq.subvectors(_vectors(s, d), PQ_M, DIM).select("doc_id", "sub", F.size("sv").alias("width"), F.round(vx.norm("sv"), 6).alias("norm"))


def q3_codebook(s, d):
    return _pq(s, d).codebook(_vectors(s, d)).select("sub", "code", F.posexplode("cv").alias("i", "x")).select("sub", "code", "i", F.round("x", 6).alias("x"))


def q4_encode(s, d):
    codes = _pq(s, d).encode(_vectors(s, d))
    return codes.select("doc_id", F.posexplode("codes").alias("sub", "code")).withColumn("code", F.col("code").cast("int"))


def q5_adc_table(s, d):
    return _pq(s, d).adc_table(_queries(s, d)).withColumn("d2", F.round("d2", 6))


def q7_search(s, d):
    docs = _stored(s, d)
    quantizer = _pq(s, d, docs)
    return quantizer.search(quantizer.encode(docs), _queries(s, d), K)


def q7_search_256(s, d):
    """The ten nearest by the reference's 4 x 256 codes."""
    docs = _stored(s, d)
    quantizer = _pq(s, d, docs, k=PQ_CODES)
    return quantizer.search(quantizer.encode(docs), _queries(s, d), K)


def b3_pq_sweep(s, d):
    """Recall, gain and compression of 2, 4 and 8 subvectors with 256 codes each."""
    docs, found = _stored(s, d), []
    for m in (2, 4, 8):
        quantizer = _pq(s, d, docs, m, PQ_CODES)
        found.append(quantizer.search(quantizer.encode(docs), _queries(s, d), K).withColumn("m", F.lit(m)))
    judged = metrics.by_setting(ex.union_by_name(*found), _truth(s, d), "m", K)
    return judged.withColumn("compression_ratio", F.round(4.0 * DIM / (2 * F.col("m")), 6))


def q8_compression(s, d):
    """Bytes of the stored vectors over those of their codes, as encoded."""
    docs, out = _stored(s, d), []
    for m in (2, 4, 8):
        codes = _pq(s, d, docs, m).encode(docs).agg(F.sum(F.size("codes") * 2).alias("bytes"), F.count("*").alias("n"))
        out.append(codes.select(F.lit(m).alias("m"), (F.col("n") * 4.0 * DIM / F.col("bytes")).alias("compression_ratio")))
    return ex.union_by_name(*out)


def f3_ivfpq(s, d):
    docs, c = _cells(s, d)
    assigned = kmeans.assign(docs, c)
    quantizer = pq.ProductQuantizer(PQ_M, PQ_K, ROUNDS).fit(pq.residuals(assigned, c).select("doc_id", "v"))
    return pq.ivfpq_search(assigned, _queries(s, d), c, quantizer, K, 2)


def f3_ivfpq_100(s, d):
    """The reference's 100 lists with residuals in 4 x 256 codes, 5 probes."""
    docs, c = _cells(s, d, LISTS)
    assigned = kmeans.assign(docs, c)
    left = cut(pq.residuals(assigned, c), "residuals")
    quantizer = pq.ProductQuantizer(PQ_M, PQ_CODES, ROUNDS).fit(left.select("doc_id", "v"), stored=True)
    return pq.ivfpq_answer(quantizer.encode(left), _queries(s, d), c, quantizer, K, 5)


# hashing


def h2_signatures(s, d):
    return lsh.signatures(_vectors(s, d), lsh.hyperplanes(DIM, 32))


def h3_bands(s, d):
    return lsh.bands(lsh.signatures(_vectors(s, d), lsh.hyperplanes(DIM, 32)), 32, 4)


def h4_candidates(s, d):
    return lsh.banded(_vectors(s, d), _queries(s, d), LSH_M, LSH_B)


def h5_search(s, d):
    docs, q = _stored(s, d), _queries(s, d)
    return lsh.rerank(lsh.banded(docs, q, LSH_M, LSH_B), docs, q, K)


def h7_candidate_ratio(s, d):
    docs, q = _vectors(s, d), _queries(s, d)
    n = lsh.banded(docs, q, LSH_M, LSH_B).groupBy("qid").agg(F.count("*").alias("n"))
    total = docs.agg(F.count("*").alias("total"))
    out = q.select("qid").join(n, "qid", "left").crossJoin(F.broadcast(total))
    return out.select("qid", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_candidates"), F.round(metrics.candidate_ratio(F.coalesce("n", F.lit(0)), F.col("total")), 6).alias("candidate_ratio"))


def b5_lsh_sweep(s, d):
    """Candidates of each banding of the same 128 bits."""
    docs, q = _vectors(s, d), _queries(s, d)
    planes = lsh.hyperplanes(DIM, LSH_M)
    signed, asked = lsh.signatures(docs, planes), lsh.signatures(q, planes)
    each = [lsh.candidates(lsh.bands(signed, LSH_M, b), lsh.bands(asked, LSH_M, b), ["band", "key"]).groupBy("qid").count().select(F.lit(b).alias("b_bands"), "qid", F.col("count").alias("n_candidates")) for b in (4, 8, 16, 32)]
    return ex.union_by_name(*each)


def b5_lsh_metrics(s, d):
    """Recall, gain and share of candidates of each banding of the same 128 bits."""
    docs, q, t = _stored(s, d), _queries(s, d), _truth(s, d)
    planes, found, ratios = lsh.hyperplanes(DIM, LSH_M), [], []
    total, asked = docs.agg(F.count("*").alias("total")), q.agg(F.count("*").alias("asked"))
    for b in (4, 8, 16, 32):
        near = cut(lsh.candidates(lsh.band_keys(docs, planes, b), lsh.band_keys(q, planes, b), ["band", "key"]), "candidates")
        found.append(lsh.rerank(near, docs, q, K).withColumn("b_bands", F.lit(b)))
        ratios.append(near.agg(F.count("*").alias("n")).crossJoin(total).crossJoin(asked).select(F.lit(b).alias("b_bands"), F.round(F.col("n") / F.col("total") / F.col("asked"), 6).alias("candidate_ratio")))
    return ex.union_by_name(*ratios).join(metrics.by_setting(ex.union_by_name(*found), t, "b_bands", K), "b_bands", "left").select("b_bands", F.coalesce("recall_at_k", F.lit(0.0)).alias("recall_at_k"), F.coalesce("ndcg_at_k", F.lit(0.0)).alias("ndcg_at_k"), "candidate_ratio")


def b7_hamming_sweep(s, d):
    """Recall and gain of bit signatures of 64 to 512 bits."""
    docs, q = _stored(s, d), _queries(s, d)
    found = [lsh.hamming_search(docs, q, lsh.hyperplanes(DIM, bits), K).withColumn("nbits", F.lit(bits)) for bits in (64, 128, 256, 512)]
    return metrics.by_setting(ex.union_by_name(*found), _truth(s, d), "nbits", K)


def g1_table_keys(s, d):
    return lsh.table_keys(_vectors(s, d), lsh.table_hyperplanes(DIM, TABLE_K, TABLES))


def g4_table_statistics(s, d):
    return lsh.table_statistics(g1_table_keys(s, d))


def _table_candidates(s, d):
    planes = lsh.table_hyperplanes(DIM, TABLE_K, TABLES)
    return lsh.candidates(lsh.table_keys(_vectors(s, d), planes), lsh.table_keys(_queries(s, d), planes), ["tbl", "key"])


def g5_search(s, d):
    return lsh.rerank(_table_candidates(s, d), _vectors(s, d), _queries(s, d), K)


def g7_candidate_count(s, d):
    return _table_candidates(s, d).groupBy("qid").agg(F.countDistinct("doc_id").alias("n_candidates"))


def g8_formulas(s, d):
    sim = s.range(0, 21).select(((F.col("id") - 10) / 10.0).alias("similarity"))
    return sim.select("similarity", F.round(lsh.collision_probability(F.col("similarity"), 15), 6).alias("collision"), F.round(lsh.estimated_recall(F.col("similarity"), 15, 10), 6).alias("recall"))


def g10_parameter_grid(s, d):
    return lsh.parameter_grid(s)


def g11_lsh_vs_brute(s, d):
    """Share of the exact five nearest by dot product that the tables find, and percent of rows examined."""
    near = g5_search(s, d).where("rank <= 5")
    t = x5_dot_top5(s, d)
    hit = near.select("qid", "doc_id").join(t.select("qid", "doc_id"), ["qid", "doc_id"]).groupBy("qid").agg(F.count("*").alias("h"))
    total = _vectors(s, d).agg(F.count("*").alias("total"))
    out = _queries(s, d).select("qid").join(hit, "qid", "left").join(g7_candidate_count(s, d), "qid", "left").crossJoin(F.broadcast(total))
    return out.select("qid", F.round(F.coalesce("h", F.lit(0)) / 5, 6).alias("recall_at_5"), F.round(100 * F.coalesce("n_candidates", F.lit(0)) / F.col("total"), 6).alias("percent_examined"))


def f4_hamming(s, d):
    return lsh.hamming_search(_vectors(s, d), _queries(s, d), lsh.hyperplanes(DIM, BITS), K)


# metrics


def m14_evaluate_per_query(s, d):
    return metrics.per_query(_half(s, d), _truth(s, d), K)


def m4_standard_average_precision(s, d):
    return metrics.per_query(_half(s, d), _truth(s, d), K, standard_average=True).select("qid", "average_precision")


def m15_evaluate_batch(s, d):
    return metrics.batch(metrics.per_query(_half(s, d), _truth(s, d), K))


def m6_dcg(s, d):
    return metrics.dcg(_half(s, d), _truth(s, d), K)


def m10_pr_curve(s, d):
    return metrics.precision_recall_curve(_half(s, d), _truth(s, d))


def m11_interpolated(s, d):
    return metrics.interpolated_precision(metrics.precision_recall_curve(_half(s, d), _truth(s, d)))


def m12_ratio_speedup(s, d):
    runs = read_table(s, d, "benchmark_runs")
    return runs.where("n_candidates is not null and n_docs is not null").select("run_id", F.round(metrics.candidate_ratio(F.col("n_candidates"), F.col("n_docs")), 6).alias("ratio"), F.round(metrics.speedup(F.col("n_docs").cast("double"), F.col("n_candidates").cast("double")), 6).alias("speedup")).distinct()


# text


def t1_tokens(s, d):
    return _tokens(s, d).select("doc_id", F.concat_ws(" ", "tokens").alias("tokens"))


def t5_stop_words(s, d):
    return _tokens(s, d).select("doc_id", F.concat_ws(" ", tx.without_stop_words("tokens")).alias("tokens"))


def t6_stems(s, d):
    """Stemmed tokens; there is no SQL for the stemmer."""
    docs = read_table(s, d, "documents")
    return tx.tokenize(docs, "doc_id", F.col("text")).select("doc_id", F.size("tokens").alias("n_tokens"), F.concat_ws(" ", "tokens").alias("tokens"))


def t3_word_tokens(s, d):
    """Tokens of the word tokenizer's kind; there is no SQL for its contraction rules."""
    return read_table(s, d, "documents").select("doc_id", F.concat_ws(" ", tx.word_tokens("text")).alias("tokens"))


def t7_concat_nulls(s, d):
    return read_table(s, d, "movies").select("doc_id", tx.concat_with_nulls("title", "plot").alias("text")).distinct()


def t9_token_counts(s, d):
    return corpus.summary(_tokens(s, d), F.size("tokens"))


def t10_vocabulary(s, d):
    return corpus.vocabulary_size(_tokens(s, d), "tokens")


def t11_top_terms(s, d):
    return corpus.top_terms(_tokens(s, d), "tokens", 20)


def t12_text_lengths(s, d):
    return corpus.summary(read_table(s, d, "movies"), F.length("plot"))


def l3_tfidf(s, d):
    return embedding.tfidf(_tokens(s, d))


def e2_mean_pool(s, d):
    """Pooling over a table of word vectors: here a word's vector is its length, its vowels and 1."""
    tokens = _tokens(s, d)
    words = tokens.select(F.explode("tokens").alias("word")).distinct()
    vowels = F.length(F.regexp_replace("word", "[^aeiou]", ""))
    words = words.where("length(word) > 2").select("word", F.array(F.length("word"), vowels, F.lit(1)).cast("array<double>").alias("wv"))
    pooled = embedding.mean_pool(tokens, words, 3)
    return pooled.select("doc_id", *[F.round(F.col("v")[i], 6).alias(c) for i, c in enumerate(("mean_length", "mean_vowels", "one"))])


def _frequent(tokens: DataFrame) -> DataFrame:
    return corpus.top_terms(tokens.select(tx.without_stop_words("tokens").alias("tokens")), "tokens", 20).select(F.col("term").alias("word"))


def e1_word2vec(s, d):
    """The nearest words of the twenty most frequent ones by vectors of 200 components; training has no SQL."""
    tokens = cut(_tokens(s, d), "tokens")
    return embedding.nearest_words(embedding.train_word2vec(tokens), _frequent(tokens))


def e1b_word2vec(s, d):
    """As e1 with the variant's settings: 100 components, words that occur twice, 20 rounds; negative sampling as there, over counted pairs."""
    tokens = cut(_tokens(s, d), "tokens")
    return embedding.nearest_by_vectors(skipgram.train_skipgram(tokens, size=100, min_count=2, iterations=20), _frequent(tokens))


def e3_document_vectors(s, d):
    """Documents as means of trained word vectors at unit length: the three nearest of each of the 50 least ids."""
    tokens = cut(_tokens(s, d), "tokens")
    model = embedding.train_word2vec(tokens, size=64)
    docs = cut(embedding.mean_pool(tokens, embedding.word_vectors(model), 64).select("doc_id", vx.l2_normalize("v").alias("v")), "pooled")
    asked = docs.orderBy("doc_id").limit(50).select(F.col("doc_id").alias("qid"), F.col("v").alias("qv"))
    return exact.knn(docs, asked, 3, "dot", exclude_self=True)


def l8_lsi_search(s, d):
    """Nearest documents by latent semantic indexing of the stemmed-down movie tokens; there is no SQL."""
    movies = read_table(s, d, "movies").groupBy("doc_id").agg(F.first("tokens").alias("tokens"))
    movies = movies.select("doc_id", F.filter(F.coalesce("tokens", F.array().cast("array<string>")), lambda t: F.length(F.trim(t)) > 0).alias("tokens"))
    model = embedding.LSI(k=200).fit(movies)
    return model.search(["ghost", "harvest", "letter"], K)


# relational operators


def s1_labelled_csv(s, d):
    """Texts written as one CSV file for each language, those without one too, and read back in one scan with the label from the file's name."""
    docs = read_table(s, d, "documents").select(F.col("doc_id").cast("string").alias("title"), F.col("text").alias("plot"), F.coalesce(F.lower(F.substring("lang", 1, 2)), F.lit("none")).alias("label"))
    folder, labels = new_path(s, "csv"), [r.label for r in docs.select("label").distinct().collect()]
    for x in labels:
        save_labelled_csv(docs.where(F.col("label") == x).drop("label"), folder, x)
    read = own(read_labelled_csv(s, f"{folder}/*-movies.csv"), folder)
    return read.select(F.col("title").cast("bigint").alias("doc_id"), F.coalesce(F.length("plot"), F.lit(0)).alias("n"), "decade")


def s1_labelled_parts(s, d):
    """All labelled parts of a table, each with its label as a literal, put together again; rows without a label are a part too."""
    docs = read_table(s, d, "documents").withColumn("label", F.lower(F.substring("lang", 1, 2)))
    labels = [r.label for r in docs.select("label").distinct().collect()]
    parts = [docs.where(F.col("label").eqNullSafe(F.lit(x))).select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n")).withColumn("decade", F.lit(x).cast("string")) for x in labels]
    return ex.union_by_name(*parts)


def s5_round_trip(s, d):
    """Vectors and metadata written to the shared folder and read back; vectors are stored as 32-bit floats."""
    meta = read_table(s, d, "doc_metadata").groupBy("doc_id").agg(F.min("title").alias("title"), F.min("decade").alias("decade"))
    folder = new_path(s, "embeddings")
    paths = save_embeddings(_vectors(s, d), meta, folder)
    vectors, titles = map(own, load_embeddings(s, folder), paths)
    return vectors.join(titles, "doc_id", "left").select("doc_id", F.round(vx.norm("v"), 4).alias("norm"), "title", "decade")


def s7_result_csv(s, d):
    """A result table written as CSV with a header and read back with its schema."""
    best = o5_best_per_method(s, d).select(F.col("m").alias("method"), F.col("run_id").alias("N"), F.lit(DIM).alias("dim"), F.col("recall_at_k").alias("build_time"), F.lit(0.0).alias("query_time"))
    folder = new_path(s, "results")
    save_results(best, folder)
    return own(read_results(s, folder, "scaling"), folder).select("method", F.col("N").alias("run_id"), "dim", F.col("build_time").alias("recall_at_k"))


def s3_metadata_rows(s, d):
    return corpus.shape(read_table(s, d, "doc_metadata"))


def rel_rename(s, d):
    return read_table(s, d, "doc_metadata").select("doc_id", "title", "decade").toDF("id", "name", "period").distinct()


def rel_method_filter(s, d):
    runs = read_table(s, d, "benchmark_runs").where(ex.method_name("method") == "FAISS-IVF")
    return runs.select("run_id", "top_k", F.round(F.col("recall_at_k"), 6).alias("recall_at_k")).distinct()


def rel_title_search(s, d):
    """The first movie of each pattern, in id order."""
    movies = read_table(s, d, "movies")
    found = [movies.where(tx.matches("title", p)).orderBy("doc_id").limit(1).select(F.lit(p).alias("pattern"), "doc_id") for p in ("ghost", "^the .*harbor", "ledger$")]
    return ex.union_by_name(*found)


def rel_membership(s, d):
    """Metadata of the vectors in the cells that the queries probe first."""
    docs, c = _cells(s, d)
    cells = ivf.probes(_queries(s, d), c, 1).select("cid").distinct()
    return kmeans.assign(docs, c).join(F.broadcast(cells), "cid", "left_semi").groupBy("cid").agg(F.count("*").alias("n"))


def rel_preview(s, d):
    return read_table(s, d, "documents").select("doc_id", tx.preview("text").alias("preview"), F.concat_ws(" ", F.slice(tx.split_words("text"), 1, 15)).alias("first_tokens"))


def rel_unit_conversion(s, d):
    return read_table(s, d, "benchmark_runs").select("run_id", F.round(F.col("candidate_ratio") * 1000, 6).alias("per_mille")).distinct()


def rel_positions(s, d):
    """Positions from 0 in id order, given without ranking all rows in one task."""
    ids = read_table(s, d, "documents").select(F.col("doc_id").alias("source_id"))
    return with_positions(ids, "source_id").select("source_id", "doc_id")


def a1_group_counts(s, d):
    return corpus.value_counts(read_table(s, d, "movies"), "decade")


def a3_all_null_counts(s, d):
    return corpus.null_counts(read_table(s, d, "movies"))


def a4_shape(s, d):
    return corpus.shape(read_table(s, d, "movies"))


def a5_means(s, d):
    runs = read_table(s, d, "benchmark_runs")
    return runs.groupBy("method", "top_k").agg(F.round(F.avg("recall_at_k"), 6).alias("mean_recall"), F.round(F.avg("candidate_ratio"), 6).alias("mean_ratio"), F.count("*").alias("n"))


def u1_union(s, d):
    """Result tables of different columns by name."""
    runs = read_table(s, d, "benchmark_runs").withColumn("m", ex.method_name("method"))
    vq = runs.where("m = 'VQ'").select("run_id", F.col("n_candidates").cast("double").alias("probed"), "recall_at_k")
    pq_ = runs.where("m = 'PQ'").select("run_id", F.col("dim").cast("double").alias("subvectors"), "recall_at_k")
    return ex.union_by_name(vq, pq_)


def o5_best_per_method(s, d):
    runs = read_table(s, d, "benchmark_runs").withColumn("m", ex.method_name("method")).where("m is not null").select("m", "run_id", "recall_at_k").distinct()
    return ex.best_per_group(runs, "m", "recall_at_k", ["run_id"])


def j4_lookup(s, d):
    runs = read_table(s, d, "benchmark_runs").withColumn("m", ex.method_name("method"))
    return ex.lookup(s, ["VQ", "PQ", "LSH", "FAISS-IVF", "FAISS-IVFPQ", "FAISS-LSH", "HNSW"], runs, "m", "recall_at_k", ["run_id", "logged_ts"]).select("m", F.when(F.isnan("recall_at_k"), None).otherwise(F.col("recall_at_k")).alias("recall_at_k"))


def b9_comparison(s, d):
    """The best run of each method with its cut and the speedup of its candidates against a full scan."""
    best = o5_best_per_method(s, d).withColumnRenamed("recall_at_k", "best_recall")
    runs = read_table(s, d, "benchmark_runs").groupBy("run_id").agg(F.max("n_docs").alias("n_docs"), F.max("n_candidates").alias("n_candidates"))
    return best.join(runs, "run_id").select("m", "run_id", "best_recall", F.round(metrics.speedup(F.col("n_docs").cast("double"), F.col("n_candidates").cast("double")), 6).alias("speedup"))


def j1_lookup_join(s, d):
    meta = read_table(s, d, "doc_metadata").groupBy("doc_id").agg(F.min("title").alias("title"))
    return _queries(s, d).select(F.col("qid").alias("doc_id")).join(meta, "doc_id", "left")


def u3_intersection(s, d):
    a = topk(_half(s, d), "qid", ["rank"], K, "r").groupBy("qid").agg(F.collect_set("doc_id").alias("x"))
    b = _truth(s, d).groupBy("qid").agg(F.collect_set("doc_id").alias("y"))
    return a.join(b, "qid").select("qid", F.size(F.array_intersect("x", "y")).alias("shared"))


def z2_scaling_samples(s, d):
    """The samples of 50, 10 and 10 of all embeddings, drawn after each other from one stream."""
    table = read_table(s, d, "embeddings").select("vec_id", "label")
    drawn = ex.sample_stream(table.count(), [50, 10, 10])
    return s.createDataFrame([(e, r, i) for e, ids in enumerate(drawn) for r, i in enumerate(ids)], "experiment int, draw int, vec_id bigint").join(table, "vec_id")


def b2_scaling(s, d):
    """Build and query times of the three searches over row prefixes and dimension prefixes, with the reference's rules for their sizes; times have no SQL."""
    docs, q = _stored(s, d), _queries(s, d)
    n = docs.count()
    sizes = sorted({x for x in (1_000, 2_000, 5_000, 10_000) if x < n} | {min(20_000, n)})
    held: dict = {}

    def vq_build(part, _):
        held["vq"] = kmeans.train(part, VQ_CELLS)[0]
        return kmeans.assign(part, held["vq"])

    def pq_build(part, asked):
        m = PQ_M if held["rows"] else ex.pq_parts(len(asked.first().qv), 16)
        held["pq"] = pq.ProductQuantizer(m, PQ_CODES).fit_trained(part)
        return held["pq"].encode(part)

    def lsh_build(part, asked):
        dim = len(asked.first().qv)
        held["planes"], held["part"] = lsh.hyperplanes(dim, LSH_M if held["rows"] else ex.lsh_bits(dim)), part
        return lsh.band_keys(part, held["planes"], LSH_B)

    def lsh_search(index, asked):
        return lsh.rerank(lsh.candidates(index, lsh.band_keys(asked, held["planes"], LSH_B), ["band", "key"]), held["part"], asked, K)

    methods = {
        "VQ": (vq_build, lambda index, asked: ivf.search(index, asked, held["vq"], K, 5)),
        "PQ": (pq_build, lambda index, asked: held["pq"].search(index, asked, K)),
        "LSH": (lsh_build, lsh_search),
    }
    out = []
    for by_rows, grid in ((True, (sizes, [DIM])), (False, ([min(10_000, n)], [DIM // 4, DIM // 2, DIM]))):
        for name, (build, search) in methods.items():
            held["rows"] = by_rows
            out.append(ex.scaling(docs, q, name, build, search, *grid).withColumn("experiment", F.lit("rows" if by_rows else "dim")))
    return ex.union_by_name(*out)


def z1_sample(s, d):
    """The seeded sample of 50 of the first 500 embeddings, as ids."""
    return s.createDataFrame([(i, r) for r, i in enumerate(ex.sample_ids(500, 50))], "vec_id bigint, draw int").join(read_table(s, d, "embeddings").select("vec_id", "label"), "vec_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if callable(v) and getattr(v, "__module__", "") == __name__ and k[0] != "_" and k not in ("queries", "oracle_sql")}
