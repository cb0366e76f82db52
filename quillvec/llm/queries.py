"""Queries pN_... of the subpackage and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillvec.sources import read_table

from .leaks import leaked_passages
from .neardup import near_duplicate_groups
from .neighbors import similar_vectors
from .packing import pack_texts, token_count
from .quality import text_quality
from .reading import reading_levels
from .terms import term_counts, term_mark

from .themes import named_themes, theme_report, vector_themes


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    near = similar_vectors(read_table(spark, d, "doc_vectors_w2v"), k=10, min_similarity=0.88, recall=0.999)
    return near.select(F.least("id", "other").alias("doc_id_a"), F.greatest("id", "other").alias("doc_id_b")).distinct()


def p1_search(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest of every movie whose id is divisible by 100, whatever their similarity, against all rows."""
    vectors = read_table(spark, d, "doc_vectors_w2v")
    near = similar_vectors(vectors, k=10, queries=vectors.where("doc_id % 100 = 0"))
    return near.select(F.col("id").alias("doc_id"), F.col("other").alias("near_id"), "rank", F.round("similarity", 6).alias("similarity"))


def p2_quality(spark: SparkSession, d: str) -> DataFrame:
    return text_quality(read_table(spark, d, "movies")).withColumnRenamed("id", "doc_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_quality(spark, d).where("chars >= 60 and doc_id is not null and profile not in ('prose', 'empty')").select("doc_id").distinct()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return term_counts(read_table(spark, d, "movies")).select("term", term_mark().alias("mark")).where("mark is not null")


def p3_terms(spark: SparkSession, d: str) -> DataFrame:
    return term_counts(read_table(spark, d, "movies")).select("term", "occurrences", "records", term_mark().alias("mark"))


def _movie_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicate_groups(read_table(spark, d, "movies"), words=3, threshold=0.5)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    groups = _movie_groups(spark, d)
    a, b = (groups.select("group_id", F.col("id").alias(f"doc_id_{x}")) for x in "ab")
    return a.join(b, "group_id").where("doc_id_a < doc_id_b").select("doc_id_a", "doc_id_b")


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    return _movie_groups(spark, d).select(F.col("id").alias("doc_id"), "group_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    themes = vector_themes(read_table(spark, d, "doc_vectors_w2v"))
    return named_themes(themes, read_table(spark, d, "theme_labels")).select(F.col("id").alias("doc_id"), F.col("name").alias("theme"))


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """Each theme's size and its ten most typical movies."""
    themes = vector_themes(read_table(spark, d, "doc_vectors_w2v"))
    return theme_report(themes).withColumnRenamed("id", "doc_id").withColumn("log_density", F.round("log_density", 6))


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    return pack_texts(read_table(spark, d, "documents"), read_table(spark, d, "context_sizes"), tokens=token_count(F.col("text")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_containers(spark, d).where("piece > 0").select("size_id", "doc_id").distinct()


def p6_packed(spark: SparkSession, d: str) -> DataFrame:
    """What has to hold of every plan: whole texts, no container beyond its capacity, and few more containers than tokens ask for."""
    held = p6_containers(spark, d)
    texts = held.groupBy("size_id", "doc_id").agg(F.count("*").alias("pieces"), F.sum("tokens").alias("tokens")).groupBy("size_id").agg(F.count("*").alias("texts"), F.sum("pieces").alias("pieces"), F.sum("tokens").alias("tokens"))
    filled = held.groupBy("size_id", "capacity", "container").agg(F.sum("tokens").alias("n")).groupBy("size_id", "capacity").agg(F.count_if(F.col("n") > F.col("capacity")).alias("overfull"), F.count("*").alias("containers"))
    few = F.col("containers") <= F.ceil(F.col("tokens") / F.col("capacity") * 1.01) + 1
    return texts.join(filled, "size_id").select("size_id", "texts", "pieces", "tokens", "overfull", few.alias("few"))


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaked_passages(read_table(spark, d, "documents"), read_table(spark, d, "eval_items"))


def p7_coverage(spark: SparkSession, d: str) -> DataFrame:
    """The share of the passage in each text that holds a quarter of it or more."""
    return p7_leaks(spark, d).where("coverage >= 0.25").select("doc_id", "item_id", F.round("coverage", 6).alias("coverage"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_leaks(spark, d).where("coverage >= 0.25").select("doc_id", "item_id")


def p8_levels(spark: SparkSession, d: str) -> DataFrame:
    return reading_levels(read_table(spark, d, "documents"), read_table(spark, d, "reading_labels"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_levels(spark, d).where("band in ('easy', 'hard')").select("doc_id", "band")


_TERMS = r"""
WITH one AS (SELECT doc_id, any_value(tokens) AS tokens FROM movies WHERE len(tokens) > 0 AND doc_id IS NOT NULL GROUP BY doc_id),
 each AS (SELECT doc_id, lower(regexp_replace(t, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) AS term FROM (SELECT doc_id, unnest(tokens) AS t FROM one)),
 counted AS (SELECT term, CAST(count(*) AS BIGINT) AS occurrences, CAST(count(DISTINCT doc_id) AS BIGINT) AS records FROM each WHERE term <> '' GROUP BY term),
 marked AS (SELECT term, occurrences, records, CASE WHEN records * 5 > (SELECT count(*) FROM one) THEN 'common' WHEN records < 3 OR occurrences < 5 THEN 'rare' END AS mark FROM counted)
"""


_GROUPS = r"""
WITH RECURSIVE word AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(coalesce(title, '') || ' ' || plot), '[\p{L}\p{N}]+') AS w FROM movies WHERE doc_id IS NOT NULL AND len(regexp_extract_all(lower(plot), '[\p{L}\p{N}]+')) >= 20),
 piece AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM word),
 sized AS (SELECT doc_id, count(*) AS n FROM piece GROUP BY doc_id),
 met AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM piece x JOIN piece y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
 link AS (SELECT a, b FROM met JOIN sized p ON p.doc_id = a JOIN sized q ON q.doc_id = b WHERE met.n * 2 >= p.n + q.n - met.n),
 edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
 reach(a, b) AS (SELECT a, b FROM edge UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a)
"""


_LEAKS = r"""
WITH item AS (SELECT item_id, regexp_extract_all(lower(passage), '[\p{L}\p{N}]+') AS w FROM eval_items),
 item_run AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 3), lambda i: list_aggregate(w[i : i + 4], 'string_agg', ' '))) AS s FROM item),
 doc AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
 doc_run AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: list_aggregate(w[i : i + 4], 'string_agg', ' '))) AS s FROM doc),
 met AS (SELECT doc_id, item_id, count(*) AS n FROM doc_run JOIN item_run USING (s) GROUP BY 1, 2)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p1_search": p1_search, "p2_found": p2_found, "p2_quality": p2_quality, "p3_found": p3_found, "p3_terms": p3_terms, "p4_found": p4_found, "p4_groups": p4_groups, "p5_found": p5_found, "p5_report": p5_report, "p6_found": p6_found, "p6_containers": p6_containers, "p6_packed": p6_packed, "p7_found": p7_found, "p7_leaks": p7_leaks, "p7_coverage": p7_coverage, "p8_found": p8_found, "p8_levels": p8_levels}


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": _TERMS + "SELECT term, mark FROM marked WHERE mark IS NOT NULL",
        "p4_found": _GROUPS + "SELECT DISTINCT a AS doc_id_a, b AS doc_id_b FROM reach WHERE a < b",
        "p4_groups": _GROUPS + "SELECT doc_id, least(doc_id, min(b)) AS group_id FROM (SELECT DISTINCT doc_id FROM movies WHERE doc_id IS NOT NULL) m LEFT JOIN reach ON a = doc_id GROUP BY doc_id",
        "p6_found": r"SELECT size_id, doc_id FROM documents, context_sizes WHERE len(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\s\p{Z}]')) > capacity",
        "p6_packed": r"SELECT size_id, count(*) AS texts, CAST(sum(greatest(1, ceil(n / capacity))) AS BIGINT) AS pieces, CAST(sum(n) AS BIGINT) AS tokens, CAST(0 AS BIGINT) AS overfull, true AS few FROM (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}]+|[^\s\p{Z}]')) AS n FROM documents), context_sizes GROUP BY size_id",
        "p7_found": _LEAKS + "SELECT doc_id, item_id FROM met JOIN (SELECT item_id, count(*) AS runs FROM item_run GROUP BY 1) USING (item_id) WHERE n * 4 >= runs",
        "p7_coverage": _LEAKS + "SELECT doc_id, item_id, round(n / runs, 6) AS coverage FROM met JOIN (SELECT item_id, count(*) AS runs FROM item_run GROUP BY 1) USING (item_id) WHERE n * 4 >= runs",
        "p3_terms": _TERMS + "SELECT term, occurrences, records, mark FROM marked",
    }
