"""Connected components of an edge table by alternating large-star and small-star rounds.

Every round is two groupings of the edges in Spark. A node's whole neighbourhood is never
held together: each rule needs a minimum over it, which is combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Link each node's larger (or smaller) neighbours, and itself, to the least of its neighbourhood."""
    if larger:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    # Joined on ~a, so that both sides are shuffled for the join and a node of very many edges can be split.
    linked = both.withColumn("k", F.bitwise_not("a")).join(least.select(F.bitwise_not("a").alias("k"), "m"), "k")
    if larger:
        out = linked.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges (a long, b long) -> (node long, label long): the least node reachable, for each node that has an edge.

    Self-loops and repeated edges are harmless; no edges give no rows. The edges are cut
    into a table after every round, so a lost executor costs at most one round.
    """
    edges = cut(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a is not null and b is not null and a <> b").distinct(), "edges")
    before = None
    for _ in range(rounds):
        spent, edges = edges, cut(_star(_star(edges, True), False), "edges")
        discard(spent)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots)
