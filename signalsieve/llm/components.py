"""Connected components of an edge table, by repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalsieve.llm.common import written


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    """One star step on edges (a, b) with a > b.

    Small: each node hands its lower neighbours to the least of them. Large: each node hands its
    higher neighbours to its least neighbour. Both keep components as they are.
    """
    both = edges if small else edges.union(edges.select("b", "a")).toDF("a", "b")
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    if small:
        moved = both.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        ends = least.select("a", F.col("m").alias("b"))
        moved = moved.union(ends)
    else:
        moved = both.join(least, "a").filter(F.col("b") > F.col("a"))
        moved = moved.select(F.col("b").alias("a"), F.least("m", "a").alias("b"))
    return moved.filter(F.col("a") > F.col("b")).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node``, ``component`` (the least node reachable) for every node that has an edge.

    ``edges`` has two long columns a and b in any order; loops and repeated edges do no harm. Large
    and small star steps alternate until nothing changes, which takes about the logarithm of the
    longest chain. A hub is aggregated before the shuffle, and joins on it are left to adaptive
    skew handling. Each round is written to the shared folder.
    """
    a, b = edges.columns[:2]
    edges = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter(F.col("a") > F.col("b")).distinct()
    edges = written(edges, "edges")
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before = mark(edges)
    for _ in range(rounds):
        if not before[0]:
            break
        edges = written(_stars(_stars(edges, small=False), small=True), "edges")
        now = mark(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return nodes.union(roots)
