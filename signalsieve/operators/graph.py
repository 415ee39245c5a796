"""Connected components of links between rows, by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalsieve.operators.skew import stable

#: Rounds halve what is left, so even a chain over all rows of a large table needs far fewer.
MOST_ROUNDS = 60


def _hand_over(pairs: DataFrame, upward: bool) -> DataFrame:
    """Every node hands those of its neighbours that lie ``upward`` (or not) to the least node it knows.

    ``pairs`` has (node, other) rows. Least nodes are aggregated before the shuffle; the join that
    follows is split by adaptive execution where one node has very many neighbours.
    """
    least = pairs.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("root"))
    known = pairs.join(least, "node")
    side = F.col("other") > F.col("node") if upward else F.col("other") < F.col("node")
    moved = known.filter(side).select(F.col("other").alias("node"), F.col("root").alias("other"))
    if not upward:
        moved = moved.unionByName(least.select("node", F.col("root").alias("other")))
    return moved.filter("node <> other").distinct()


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("node", "other").cast("decimal(38,0)")).alias("mark")).first()
    return row["n"], row["mark"]


def connected(links: DataFrame, rounds: int = MOST_ROUNDS) -> DataFrame:
    """``node`` and ``component`` (the least node reachable) of every node that has a link to another.

    The first two columns of ``links`` are the linked nodes, in any order; loops and repeated links do no
    harm. Nodes hand higher neighbours to their least neighbour, then lower ones, until the links
    are stars around the least node of each component. Each round is a table in the shared folder,
    so a lost executor costs one round at most.
    """
    first, second = links.columns[:2]
    pairs = links.select(F.col(first).alias("node"), F.col(second).alias("other")).filter("node <> other")
    low_first = pairs.select(F.greatest("node", "other").alias("node"), F.least("node", "other").alias("other"))
    now = stable(low_first.distinct())
    state = _state(now)
    for _ in range(rounds):
        if not state[0]:
            break
        both = now.unionByName(now.select(F.col("other").alias("node"), F.col("node").alias("other")))
        now = stable(_hand_over(_hand_over(both, upward=True), upward=False))
        before, state = state, _state(now)
        if before == state:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    members = now.select("node", F.col("other").alias("component"))
    return members.unionByName(now.select(F.col("other").alias("node"), F.col("other").alias("component")).distinct())
