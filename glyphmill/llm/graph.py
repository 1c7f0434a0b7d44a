"""Connected components of an edge table by repeated contraction to the smallest neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.shared import forget, written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that an edge (a, b) names. Node ids should be spread like hashes: then each round
    leaves a constant fraction of the nodes. Nothing but row counts reaches the driver; each round is written."""
    rounds = []
    edges = written(edges.select("a", "b").where("a <> b").distinct(), "edges")
    while not edges.isEmpty():
        both = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("to")), F.struct(F.col("b").alias("node"), F.col("a").alias("to")))).alias("e")).select("e.*")
        step = written(both.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("node", "to").alias("root")), "step")
        left, right = step.select(F.col("node").alias("a"), F.col("root").alias("ra")), step.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        moved = edges.join(left, "a").join(right, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        following = written(moved, "edges")
        forget(edges.sparkSession, edges)
        edges = following
        rounds.append(step)
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = rounds[-1]
    for step in reversed(rounds[:-1]):
        later = out.select(F.col("node").alias("root"), F.col("root").alias("to"))
        out = step.join(later, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return out


def no_roots(spark) -> DataFrame:
    return spark.createDataFrame([], "node long, root long")


def extended(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) after more links (a, b): only components that the links join are looked at again."""
    spark = roots.sparkSession
    links = written(links.select("a", "b"), "links")
    if links.isEmpty():
        return roots
    a, b = roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    placed = links.join(a, "a", "left").join(b, "b", "left")
    moved = components(placed.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")))
    named = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    every = roots.unionByName(named.join(roots, "node", "left_anti").select("node", F.col("node").alias("root")))
    later = moved.select(F.col("node").alias("root"), F.col("root").alias("to"))
    out = written(every.join(later, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "roots")
    forget(spark, links)
    return out
