"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillvec.plans.lineage import own, read_cut, release, write_cut


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """`node, component`: every linked node with the least node of its component.

    Links go in any direction and may repeat; loops link nothing. Each round
    writes its edges to the shared folder, and only a count and a checksum reach
    the driver. The number of rounds grows with the logarithm of the longest
    chain. No links give no rows.
    """
    spark = links.sparkSession
    start = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct()
    path = write_cut(start, "links")
    edges, state = read_cut(spark, path, start), None
    while True:
        turned = _small_star(_large_star(edges))
        before, path = path, write_cut(turned, "links")
        release(spark, before)
        edges = read_cut(spark, path, turned)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % F.lit(1 << 40))).first()
        if now == state:
            break
        state = now
    edges = own(edges, path)
    roots = edges.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
