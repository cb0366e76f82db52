"""Random-hyperplane hashing: banded, multi-table and Hamming search, and their formulas."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillvec.functions.ranking import topk
from quillvec.functions.vectors import cosine

from .arrow import first_k, held_rows, small, to_matrix


def hyperplanes(dim: int, n: int, seed: int = 42) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((n, dim))


def table_hyperplanes(dim: int, k: int, tables: int, seed: int = 42) -> np.ndarray:
    """`tables` x `k` x `dim`, drawn table after table from one stream."""
    rng = np.random.RandomState(seed)
    return np.stack([rng.randn(k, dim) for _ in range(tables)])


def _bits(docs: DataFrame, planes: np.ndarray, make, schema: str, names: list[str]) -> DataFrame:
    """`make(bits)` of each row's bits (projection >= 0), one list of values for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(planes)

    def hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = to_matrix(batch.column(1)) if batch.num_rows else np.zeros((0, shared.value.shape[1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), make(x @ shared.value.T >= 0)], names=names)

    return docs.select(F.col(docs.columns[0]).cast("bigint"), F.col(docs.columns[1]).cast("array<double>")).mapInArrow(hash_rows, schema)


def signatures(docs: DataFrame, planes: np.ndarray) -> DataFrame:
    """`doc_id, signature STRING` of zeros and ones; a zero vector gives ones only."""
    make = lambda b: pa.array(["".join(r) for r in np.where(b, "1", "0")], pa.string())
    return _bits(docs, planes, make, f"{docs.columns[0]} bigint, signature string", [docs.columns[0], "signature"])


def bands(signed: DataFrame, m: int, b: int) -> DataFrame:
    """`doc_id, band, key`: the signature cut into `b` keys."""
    if m % b:
        raise ValueError("the number of bits has to be a multiple of the number of bands")
    r = m // b
    keys = F.transform(F.sequence(F.lit(0), F.lit(b - 1)), lambda i: F.substring("signature", i * r + 1, F.lit(r)))
    return signed.select(signed.columns[0], F.posexplode(keys).alias("band", "key"))


def band_keys(docs: DataFrame, planes: np.ndarray, b: int) -> DataFrame:
    """`id, band, key BIGINT`: the bits of each of `b` bands as integers, which compare faster than text."""
    if len(planes) % b:
        raise ValueError("the number of bits has to be a multiple of the number of bands")
    r = len(planes) // b
    word = min(r, 62)
    cuts = list(range(0, r, word))
    name = docs.columns[0]

    def make(bits: np.ndarray) -> pa.ListArray:
        by_band = bits.reshape(len(bits), b, r).astype(np.int64)
        packed = np.stack([(by_band[:, :, c : c + word] << np.arange(min(word, r - c))).sum(2) for c in cuts], 2)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(bits) + 1) * b * len(cuts), pa.int32()), pa.array(packed.ravel(), pa.int64()))

    keys = _bits(docs, planes, make, f"{name} bigint, keys array<bigint>", [name, "keys"])
    if len(cuts) == 1:
        return keys.select(name, F.posexplode("keys").alias("band", "key"))
    words = F.transform(F.sequence(F.lit(0), F.lit(b - 1)), lambda i: F.slice("keys", i * len(cuts) + 1, F.lit(len(cuts))))
    return keys.select(name, F.posexplode(words).alias("band", "key"))


def candidates(doc_keys: DataFrame, query_keys: DataFrame, on: list[str]) -> DataFrame:
    """`qid, doc_id`, distinct, of the rows that share a key. The query side, queries x bands rows, is broadcast if it is small."""
    return doc_keys.join(small(query_keys), on).select("qid", "doc_id").distinct()


def rerank(found: DataFrame, docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    scored = found.join(docs.select("doc_id", "v"), "doc_id").join(small(queries.select("qid", "qv")), "qid")
    scored = scored.select("qid", "doc_id", F.round(cosine("qv", "v"), 6).alias("score"))
    return topk(scored, "qid", [F.desc("score"), "doc_id"], k).select("qid", "rank", "doc_id", "score")


def banded(docs: DataFrame, queries: DataFrame, m: int, b: int, seed: int = 42, dim: int = 64) -> DataFrame:
    """Candidates of every query by `b` bands over `m` hyperplanes."""
    planes = hyperplanes(dim, m, seed)
    doc_keys = band_keys(docs.select("doc_id", "v"), planes, b)
    query_keys = band_keys(queries.select("qid", "qv"), planes, b)
    return candidates(doc_keys, query_keys, ["band", "key"])


def table_keys(docs: DataFrame, planes: np.ndarray) -> DataFrame:
    """`id, tbl INT, key BIGINT`: the bits of each table as an integer, the first bit highest."""
    tables, k, dim = planes.shape
    weights = 1 << np.arange(k - 1, -1, -1, dtype=np.int64)

    def make(b: np.ndarray) -> pa.ListArray:
        keys = (b.reshape(len(b), tables, k) * weights).sum(2)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(b) + 1) * tables, pa.int32()), pa.array(keys.ravel(), pa.int64()))

    name = docs.columns[0]
    rows = _bits(docs, planes.reshape(-1, dim), make, f"{name} bigint, keys array<bigint>", [name, "keys"])
    return rows.select(name, F.posexplode("keys").alias("tbl", "key"))


def table_statistics(keys: DataFrame) -> DataFrame:
    """`tbl, buckets, mean_size, max_size` over the buckets that hold rows."""
    sizes = keys.groupBy("tbl", "key").count()
    return sizes.groupBy("tbl").agg(F.count("*").alias("buckets"), F.round(F.avg("count"), 6).alias("mean_size"), F.max("count").alias("max_size"))


def hamming_words(docs: DataFrame, planes: np.ndarray, word: int = 60) -> DataFrame:
    """`id, words ARRAY<BIGINT>`: the bits packed, `word` to an integer."""
    n = len(planes)
    cuts = list(range(0, n, word))

    def make(b: np.ndarray) -> pa.ListArray:
        packed = np.stack([(b[:, c : c + word] * (1 << np.arange(min(word, n - c), dtype=np.int64))).sum(1) for c in cuts], 1)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(b) + 1) * len(cuts), pa.int32()), pa.array(packed.ravel(), pa.int64()))

    name = docs.columns[0]
    return _bits(docs, planes, make, f"{name} bigint, words array<bigint>", [name, "words"])


def packed_bits(x: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """The bits of each row (projection >= 0), 64 to an integer."""
    bits = np.packbits(x @ planes.T >= 0, axis=1)
    return np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8))).view(np.uint64)


def hamming_search(docs: DataFrame, queries: DataFrame, planes: np.ndarray, k: int = 10) -> DataFrame:
    """`qid, rank, doc_id, score`: least differing bits over all rows, ties by id."""
    ids, q = held_rows(queries, "qid", "qv")
    shared = docs.sparkSession.sparkContext.broadcast((planes, ids, packed_bits(q, planes) if len(ids) else np.zeros((0, 1), np.uint64)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The `k` nearest of the rows seen so far for each query; a task hands on no more."""
        w, qid, asked = shared.value
        row, doc, apart = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for whole in batches:
            for start in range(0, whole.num_rows, 5_000):
                batch = whole.slice(start, 5_000)
                own = packed_bits(to_matrix(batch.column(1)), w)
                score = sum(np.bitwise_count(asked[:, None, j] ^ own[None, :, j]).astype(np.int64) for j in range(own.shape[1]))
                ids_ = batch.column(0).to_numpy()
                r, c = first_k(score, ids_, k)
                row, doc, apart = np.r_[row, r], np.r_[doc, ids_[c]], np.r_[apart, score[r, c]]
                order = np.lexsort((doc, apart, row))
                rank = np.arange(len(order)) - np.searchsorted(row[order], row[order])
                row, doc, apart = (x[order[rank < k]] for x in (row, doc, apart))
        if len(row):
            yield pa.RecordBatch.from_arrays([pa.array(qid[row]), pa.array(doc), pa.array(apart, pa.float64())], names=["qid", "doc_id", "score"])

    found = docs.select(F.col("doc_id").cast("bigint"), F.col("v").cast("array<double>")).mapInArrow(scan, "qid bigint, doc_id bigint, score double")
    return topk(found, "qid", ["score", "doc_id"], k).select("qid", "rank", "doc_id", "score")


def collision_probability(similarity: Column, k: int | Column) -> Column:
    clipped = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), similarity))
    return F.pow(1 - F.acos(clipped) / F.pi(), F.lit(k) if isinstance(k, int) else k)


def estimated_recall(similarity: Column, k: int | Column, tables: int | Column) -> Column:
    return 1 - F.pow(1 - collision_probability(similarity, k), F.lit(tables) if isinstance(tables, int) else tables)


def parameter_grid(spark: SparkSession, similarity: float = 0.7, k_values=(5, 10, 15, 20, 25), tables=(1, 5, 10, 15, 20)) -> DataFrame:
    """`k, tables, recall, buckets` of every pair of settings."""
    ks = spark.createDataFrame([(k,) for k in k_values], "k int")
    ls = spark.createDataFrame([(t,) for t in tables], "tables int")
    recall = F.round(estimated_recall(F.lit(similarity), F.col("k"), F.col("tables")), 6)
    return ks.crossJoin(ls).select("k", "tables", recall.alias("recall"), F.pow(F.lit(2.0), F.col("k")).cast("bigint").alias("buckets"))
