"""Connected components of a large edge list by alternating large-star and small-star steps (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.storage import spool


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link the neighbours of every node to the least of them: the larger ones, or the smaller ones."""
    if large:
        near = edges.select(F.col("u").alias("node"), F.col("v").alias("to")).union(edges.select(F.col("v"), F.col("u")))
    else:
        near = edges.select(F.greatest("u", "v").alias("node"), F.least("u", "v").alias("to"))
    least = near.groupBy("node").agg(F.min("to").alias("least")).select("node", F.least("node", "least").alias("least"))
    if large:
        least = spool(least, "least")  # a table of its own, so that Spark can split a node with very many neighbours
    joined = near.join(least, "node")
    if large:
        out = joined.where(F.col("to") > F.col("node")).select(F.col("to").alias("u"), F.col("least").alias("v"))
    else:
        out = joined.select(F.col("to").alias("u"), F.col("least").alias("v")).union(least.select(F.col("node").alias("u"), F.col("least").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v); the root is the least node of its component.

    Rounds go on until one changes nothing. With ``most_rounds``, more rounds
    than that are an error; unfinished components are never returned.
    """
    edges = spool(edges.select("u", "v").where("u <> v").distinct(), "edges")
    if edges.isEmpty():
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    seen, rounds = None, 0
    while True:
        if most_rounds is not None and rounds >= most_rounds:
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")
        rounds += 1
        edges = spool(_star(_star(edges, True), False), "edges")
        mark = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if mark == seen:
            break
        seen = mark
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
