"""Labelled CSV scans, vectors, models and result tables on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillvec.plans.lineage import cut

MOVIES = T.StructType([T.StructField("title", T.StringType()), T.StructField("plot", T.StringType())])
METADATA = "doc_id BIGINT, title STRING, decade STRING"
_COMMON = "method STRING, {own}, recall_at_k DOUBLE, ndcg_at_k DOUBLE, candidate_ratio DOUBLE, query_time DOUBLE, N BIGINT, dim INT"
#: Schemas of accuracy and scaling tables, by method.
RESULTS = {
    "VQ": _COMMON.format(own="n_probes INT, c_clusters INT"),
    "PQ": _COMMON.format(own="m_subvectors INT, k_clusters INT") + ", compression_ratio DOUBLE",
    "LSH": _COMMON.format(own="m_hashes INT, b_bands INT, r_rows INT"),
    "FAISS": _COMMON.format(own="index_type STRING, n_clusters INT, nprobe INT, nbits INT"),
    "scaling": "method STRING, N BIGINT, dim INT, build_time DOUBLE, query_time DOUBLE",
}
RUN_LOG = "timestamp STRING, method STRING, query_index BIGINT, top_k INT, n_docs BIGINT, dim INT, n_candidates BIGINT, candidate_ratio DOUBLE, recall_at_k DOUBLE, n_overlap INT"


def read_labelled_csv(spark: SparkSession, pattern: str, label: str = "decade", suffix: str = "-movies", schema: T.StructType = MOVIES) -> DataFrame:
    """Files `{label}{suffix}.csv` in one scan, with the label taken from the file name; quoted fields may hold line breaks."""
    df = spark.read.schema(schema).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(pattern)
    return df.withColumn(label, F.regexp_extract(F.input_file_name(), rf"([^/]+){suffix}\.csv", 1))


def save_labelled_csv(df: DataFrame, folder: str, label: str, suffix: str = "-movies") -> str:
    """The counterpart of `read_labelled_csv`: `{folder}/{label}{suffix}.csv`; quotes are doubled, line breaks stay within quotes. The path."""
    path = f"{folder}/{label}{suffix}.csv"
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("quoteAll", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


def with_positions(df: DataFrame, *order: str) -> DataFrame:
    """`doc_id` from 0 in a stated order. Ranks are taken within ranges and shifted by the sizes of the ranges before, so no task ranks all rows."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # written once, so that both uses below see the same partitions
    numbered = cut(ranged.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()), "positions")
    base = numbered.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_i").alias("_first"))
    before = base.alias("a").join(base.alias("b"), F.col("b._p") < F.col("a._p"), "left").groupBy("a._p", "a._first").agg(F.coalesce(F.sum("b._n"), F.lit(0)).alias("_before"))
    out = numbered.join(F.broadcast(before.select("_p", "_first", "_before")), "_p")
    return out.withColumn("doc_id", F.col("_before") + F.col("_i") - F.col("_first")).drop("_p", "_i", "_first", "_before")


def save_embeddings(vectors: DataFrame, metadata: DataFrame, folder: str) -> tuple[str, str]:
    """Write `doc_id, v` and `doc_id, title, decade`; the two paths."""
    paths = f"{folder}/doc_vectors", f"{folder}/doc_metadata"
    vectors.select("doc_id", F.col("v").cast("array<float>").alias("v")).write.mode("overwrite").parquet(paths[0])
    metadata.select("doc_id", "title", "decade").write.mode("overwrite").parquet(paths[1])
    return paths


def load_embeddings(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    vectors = spark.read.parquet(f"{folder}/doc_vectors").select("doc_id", F.col("v").cast("array<double>").alias("v"))
    return vectors, spark.read.schema(METADATA).parquet(f"{folder}/doc_metadata")


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def save_results(df: DataFrame, path: str) -> None:
    """A result table, small by nature, as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def read_results(spark: SparkSession, path: str, method: str) -> DataFrame:
    return spark.read.schema(RESULTS[method]).option("header", True).csv(path)


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    """Run logs with ragged rows: a row that doesn't fit the schema is kept whole in `_corrupt_record`."""
    schema = RUN_LOG + ", _corrupt_record STRING"
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").csv(path)
