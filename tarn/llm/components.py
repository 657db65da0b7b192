"""Connected components by alternating large-star and small-star steps.

Nothing is collected but two numbers a round. The edges of each round are
written to the shared scratch folder, so lineage stays short. A node with very
many edges costs one row a task for its minimum (partial aggregation); minima are
written too, so that its edges meet them in a join of two plain shuffles, which
AQE can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import remove, saved, shared_dir


def _canonical(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()


def _large_star(edges: DataFrame, path: str) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = saved(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), path)
    return _canonical(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _canonical(moved.unionAll(least.select("u", F.col("m").alias("v"))))


def components(edges: DataFrame, *, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that has an edge to another one;
    component is the smallest node reachable. Null ends and loops are ignored."""
    spark = edges.sparkSession
    path = shared_dir(spark)
    now = saved(_canonical(edges.select(F.col(a).alias("u"), F.col(b).alias("v"))), f"{path}/0")
    seen, k = None, 0
    while True:
        k += 1
        now = saved(_small_star(_large_star(now, f"{path}/least{k}")), f"{path}/{k}")
        remove(spark, f"{path}/{k - 1}")
        remove(spark, f"{path}/least{k}")
        sign = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if sign == seen:
            break
        seen = sign
    centre = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(centre)
