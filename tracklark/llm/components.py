"""Connected components of a graph given as edges, by alternating large and small stars.

Each round is a few joins and aggregations over the edges alone, written to the shared folder in place
of the round before; nothing is collected.
A vertex with very many edges is only ever an aggregation key, which is summed before the shuffle, or a join key, whose
edges are joined where they are (see skew.py).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skew import join_counted
from .storage import drop, materialize


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("u", "m"))
    return join_counted(both.where("v > u"), least, ["u"], "n", 2 * n).select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    moved = join_counted(edges, least, ["a"], "n", n).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every vertex that isn't the least of its component, from edges (a, b) with a > b."""
    edges = materialize(edges.distinct())
    mark = F.struct(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)).alias("x"))
    last = edges.select(mark.alias("m")).first()["m"]
    for _ in range(most_rounds if last["n"] else 0):
        large = materialize(_large_star(edges, last["n"]))  # a row for each edge
        before, edges = edges, materialize(_small_star(large, last["n"]))
        drop(before)
        drop(large)
        now = edges.select(mark.alias("m")).first()["m"]
        if now == last:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        last = now
    if last["n"]:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
