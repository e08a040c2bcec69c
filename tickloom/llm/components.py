"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm._common import cut, join_counted, path_of, remove


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """node, component (the smallest node reachable) for each node with an edge.

    Edges are undirected; repeats and loops are ignored. Each step leaves at most one row for a node and one
    of its neighbours, so rows never exceed the edges. A node with very many neighbours is aggregated (a
    minimum and a count, before rows move), and its rows are joined to that minimum without gathering. Every
    round is written to the shared folder, and the round before it is deleted.
    """
    spark = edges.sparkSession
    a, b = F.col(src), F.col(dst)
    now = cut(edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    before, n_edges = None, now.count()
    while n_edges:
        # large star: every larger neighbour of u moves to the smallest of u and its neighbours
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = join_counted(both, least, ["u"], "n", 2 * n_edges).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: every smaller neighbour of u, and u, move to the smallest of them
        large = cut(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = join_counted(large, least, ["u"], "n", n_edges).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        after = cut(small.where("u != v").distinct())
        remove(spark, *map(path_of, (now, large)))
        now = after
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before, n_edges = mark, mark[0]
    pairs = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return pairs.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
